"""Operators 4 and 10 against plain versions."""

import ast
import asyncio
import base64
import hashlib
import inspect
import logging
import random
import re
import socket
import ssl
import subprocess
import tarfile
import time
import typing
import unittest
import zipfile

from fathomline.llm import common, pii, secret_scan
from pyspark.sql import functions as F
from tests.llm.helpers import none, odd, plain
from tests.oracle import TESTDATA


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()


def secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]


def private(t):
    n = lambda m: sum(c.isdigit() for c in m[0])
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= n(m) <= 19 and pii.luhn(m[0])]
    return out + [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= n(m) <= 15]


def random_texts(alphabet, n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


SECRET_BITS = ["token", "Secret", "api_key", "apikey=", ": ", "=", '"', "AKIA", "A1B2C3D4E5", "deadbeef01", "é", "😀", " ", "x", "password", "abcdef123456", "\n"]
PRIVATE_BITS = ["a.b", "@", "x.y", ".", "1", "25", "256", "+4", " ", "(0)", "-", "4111", "1111", "é", "😀", "_", "@@", "0", "\n", "%"]


def test_base_spans_of_random_texts(spark):
    for bits, operator, brute in ((SECRET_BITS, secret_scan, secrets), (PRIVATE_BITS, pii, private)):
        texts = random_texts(bits, 400, 1)
        found = {r.doc_id: r for r in operator.digest(operator.scan(plain(spark, texts))).collect()}
        for i, t in enumerate(texts):
            assert found[i].base_sha256 == sha(brute(t)), t


def test_base_spans_of_documents(spark):
    docs = common.table(spark, f"{TESTDATA}/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for operator, brute in ((secret_scan, secrets), (pii, private)):
        for r in operator.digest(operator.scan(docs)).collect():
            assert r.base_sha256 == sha(brute(texts[r.doc_id]))


def test_markov_model():
    model = secret_scan.default_model()
    held = secret_scan.default_samples(1400, seed=99)
    right = sum(model.secret(s) == (y == 1) for s, y in held)
    assert right / len(held) > 0.95


def keys(n, k):
    """Random strings of n characters that the samples' generator didn't make, in six spellings."""
    raw = hashlib.sha512(f"{n} {k}".encode()).digest()
    return [
        base64.b64encode(raw).decode()[:n], re.sub("[+/=]", "", base64.b64encode(raw).decode())[:n], base64.b32encode(raw).decode().lower()[:n],
        base64.b32encode(raw).decode()[:n], "".join(chr(97 + x % 26) for x in raw)[:n], raw.hex().upper()[:n],
    ]


def test_markov_model_on_strings_of_others():
    """Recall by length on random keys, and false alarms on the names that the standard library and Spark give their own parts."""
    model = secret_scan.default_model()
    for n in (12, 14, 16, 18, 20, 24, 32, 40):
        found = [[model.secret(x) for x in keys(n, k)] for k in range(200)]
        assert sum(map(sum, found)) / (200 * 6) > 0.93 and min(sum(f[i] for f in found) for i in range(6)) / 200 > 0.8
    names = {n for m in (ast, asyncio, inspect, logging, socket, ssl, subprocess, tarfile, typing, unittest, zipfile, F) for n in dir(m) if len(n) >= 12}
    assert len(names) > 500 and sum(map(model.secret, names)) / len(names) < 0.03


def brute_markov(t, model):
    base = [(a, b) for a, _, b, _ in secrets(t)]
    return [
        (m.start(), m.end())
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+", t)
        if model.secret(m[0]) and not any(a < m.end() and m.start() < b for a, b in base)
    ]


def test_spans_of_documents_with_keys_put_in(spark):
    """Real documents with random keys between their words: every span as the plain version has it, and recall."""
    model, rnd = secret_scan.default_model(), random.Random(2)
    texts, put = [], 0
    for i, r in enumerate(common.table(spark, f"{TESTDATA}/sf0.001", "documents").orderBy("doc_id").collect()):
        words = r.text.split(" ")
        for x in keys(12 + i % 30, i):
            words.insert(rnd.randint(0, len(words)), x)
        put += 6
        texts.append(" ".join(words))
    texts += ["x" * 30 + " token=abcdefghijklmnop my_secret_token=Zq81xKv93mQp22 deadbeefdeadbeefQx81KvZ93mQp22", "token = " + keys(24, 1)[0], "a_" * 40]
    found = {r.doc_id: r for r in secret_scan.scan(plain(spark, texts)).collect()}
    n = 0
    for i, t in enumerate(texts):
        want = brute_markov(t, model)
        assert [(s.start, s.end) for s in found[i].markov] == want and all(t[s.start : s.end] == s.m for s in found[i].markov)
        n += len(want)
    # Some keys are hexadecimal or stand behind "token =", so the base scan has them.
    assert n > 0.85 * put


def test_markov_spans_are_added(spark):
    key = "Ab3dX9kLm2PqR8sT4vWzQ"
    docs = plain(spark, [f"é use {key} here", f"token = {key}", "getUserNameFromLocalCache2"])
    rows = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(docs)).collect()}
    assert rows[0].spans == f"markov:6:{6 + len(key)}" and rows[1].spans == f"assign:0:{8 + len(key)}" and rows[2].spans == ""


def test_trees():
    trees = pii.default_trees()
    held = pii.default_samples(1500, seed=77)
    taken = [(y, trees.score(pii.features(k, m, b, a)) >= trees.least[k]) for k, m, b, a, y in held]
    hits = [y for y, t in taken if t]
    assert sum(hits) / len(hits) > 0.95 and sum(hits) / sum(y for y, _ in taken) > 0.95


# Sentences that the samples' generator didn't make: personal spans in double brackets, and sentences without any.
PERSONAL = """You can reach Anna at [[anna.meier (at) posteo (dot) de]] most days.
Feel free to e-mail [[j.doe[at]corp[dot]com]] any time.
Schreiben Sie an [[info [at] verein.org]] bitte.
Her contact address is [[sue at school dot edu]] she said.
The applicant's SSN is [[219-09-9999]] as filed.
Employee Jane, social security [[078-05-1120]], was hired in spring.
Taxpayer number [[412-67-8910]] was entered twice.
Please pay to IBAN [[DE89 3704 0044 0532 0130 00]] by Friday.
Virement sur le compte [[FR1420041010050500013M02606]] avant lundi.
El IBAN del cliente es [[ES9121000418450200051332]] segun consta.
Wire the money to [[GB29NWBK60161331926819]] today.
Call us on [[(020) 7946 0958]] between nine and five.
My cell is [[415-555-2671]] if anything comes up.
Mein Telefon: [[030 1234 5678]] abends.
Tel. portable [[06 12 34 56 78]] le soir.
You may text me at [[646.555.0199]] later.
She was born on [[12.04.1987]] in Ulm.
DOB: [[1990-05-17]] per the form.
Née le [[3/11/1975]] à Lyon.
Fecha de nacimiento [[21-02-2001]] en Madrid.
Geburtsdatum [[01.09.1969]] laut Akte.
Passport number [[533401234]] expires soon.
His bank account [[0012345678]] was closed.
Credit card [[4539 1488 0343 647]] was declined.
Führerschein und Ausweis [[220001293]] liegen vor.
The visitor's address [[2001:db8:85a3:1234:5678:8a2e:370:7334]] was logged.
Login from [[fe80:1:2:3:202:b3ff:fe1e:8329]] failed.""".split("\n")
HARMLESS = """Order 12345678 was shipped on 2024-03-01.
See ISBN 9783161484100 for details.
Version 2024-05-06 fixes this.
Published 12.11.2019, updated 03.02.2020.
Invoice 20231234567 totals 1500 EUR.
Serial 123-45-6789 is on the back of the unit.
It weighs 1200000 kg in total.
The run took 86400000 ms on build 20240506123.
Population 8336817 people in 2019.
Part no. 555-01-0199 is out of stock.
We met at noon at example.shop and left.
Tracking 1234567890123 shows no change.
Chapter 12.10.2010 was renumbered.
Figure 10 of page 200 shows it.
The meeting is dated 2024-01-15.
Rechnung 00123456789 ist bezahlt.""".split("\n")


def test_personal_data_in_sentences_of_others(spark):
    """Recall and precision on sentences put into real documents."""
    rnd, texts, want = random.Random(4), [], []
    docs = [r.text for r in common.table(spark, f"{TESTDATA}/sf0.001", "documents").orderBy("doc_id").collect()]
    docs = [t for t in docs if not re.search("[0-9]", t)][:60]
    for i, sentence in enumerate((PERSONAL + HARMLESS) * 3):
        words = docs[i % len(docs)].split(" ")
        k = rnd.randint(0, len(words))
        a, _, rest = sentence.partition("[[")
        m, _, b = rest.partition("]]") if "[[at]]" not in rest else (rest, "", "")
        head = " ".join(words[:k])
        head += "\n" if head else ""
        texts.append(head + (a + m + b if rest else sentence) + "\n" + " ".join(words[k:]))
        want.append((len(head) + len(a), len(head) + len(a) + len(m)) if rest else None)
    found = {r.doc_id: [(s.start, s.end) for k in pii.KINDS for s in r[k]] for r in pii.scan(plain(spark, texts)).collect()}
    hit = [w is not None and any(a < w[1] and w[0] < b for a, b in found[i]) for i, w in enumerate(want)]
    false = [i for i, w in enumerate(want) for a, b in found[i] if w is None or not (a < w[1] and w[0] < b)]
    missed = {texts[i][w[0] : w[1]] for i, w in enumerate(want) if w is not None and not hit[i]}
    assert sum(hit) / sum(w is not None for w in want) >= 0.9, missed
    assert len(false) <= 0.05 * sum(hit), [texts[i][:200] for i in false[:5]]


def brute_private(t, trees):
    """The added spans (start, rank, end, kind) of a text."""
    base = private(t)
    cands = []
    for k, (kind, pattern) in enumerate(pii.GENERATORS.items()):
        found = list(re.finditer(pattern, t))
        for i, m in enumerate(found):
            before = t[found[i - 1].end() if i else 0 : m.start()][-pii.BEFORE :]
            after = t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)][: pii.AFTER]
            score = trees.score(pii.features(kind, m[0], before, after))
            if score >= trees.least[kind] and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                cands.append((-score, m.start(), -m.end(), 4 + k, kind))
    chosen = []
    for _, a, b, k, kind in sorted(cands):
        if not any(x < -b and a < y for x, _, y, _ in chosen):
            chosen.append((a, k, -b, kind))
    return sorted(base + chosen)


def test_spans_equal_plain_ones(spark):
    trees, rnd = pii.default_trees(), random.Random(9)
    made = [[x[2] + x[1] + x[3] for x in pii.default_samples(60, seed=k)] for k in range(6)]
    texts = [" ".join(rnd.sample(m, 20)) for m in made for _ in range(5)] + ["\n".join(PERSONAL).replace("[[", "").replace("]]", ""), "2020-01-01 " * 300, "born 1990-01-01 " * 50]
    texts += [r.text for r in common.table(spark, f"{TESTDATA}/sf0.001", "documents").collect()]
    found = {r.doc_id: r for r in pii.digest(pii.scan(plain(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = brute_private(t, trees)
        assert found[i].spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want) and found[i].n_spans == len(want)


def test_time_grows_with_the_text(spark):
    """Four times the text takes about four times as long, not sixteen."""
    unit = {secret_scan: "password=Zq81xKv93mQp22 deadbeefdeadbeef Ab3dX9kLm2PqR8sT4vWzQ ", pii: "call (212) 555-0147, born 1990-05-17, jo@x.org; order 123456789 "}
    for operator, text in unit.items():
        took = []
        for n in (3000, 3000, 12_000):
            d = operator.digest(operator.scan(plain(spark, [text * n])))
            began = time.perf_counter()
            assert d.first().spans
            took.append(time.perf_counter() - began)
        assert took[2] < 9 * min(took[:2]), took


def test_other_columns_stay(spark):
    names = ["doc_id", "text", "_row", "_h_hex", "_table", "runs", "spans", "free", "codes", "ratios", "proposed", "chosen", "_proposed", "_chosen", "chains", "hex", "email", "a`b.c", "_all", "redacted"]
    d = spark.createDataFrame([(1, "call me at (212) 555-0147 Ab3dX9kLm2PqR8sT4vWzQ", *map(str, range(len(names) - 2)))], names)
    for operator in (secret_scan, pii):
        out = operator.scan(d)
        rest = [n for n in names if n not in operator.KINDS]
        assert out.columns == [*rest, *operator.KINDS]
        assert [out.first()[n] for n in rest[2:]] == [d.first()[n] for n in rest[2:]]
    assert pii.redact(pii.scan(d)).first().redacted.startswith("call me at [local_phone]")


def test_added_spans_and_redaction(spark):
    docs = plain(spark, ["please call me at (212) 555-0147 now", "version 8.3.26 page 12345678 of it", "mail a@b.co or +1 (546) 555-9275"])
    scanned = pii.scan(docs)
    assert [r.redacted for r in pii.redact(scanned).orderBy("doc_id").collect()] == ["please call me at [local_phone] now", "version 8.3.26 page 12345678 of it", "mail [email] or [phone]"]


def test_scores_in_sql_equal_those_in_python(spark):
    trees = pii.default_trees()
    for kind in pii.GENERATORS:
        rows = [(m, b, a) for k, m, b, a, _ in pii.default_samples(420, seed=5) if k == kind]
        d = spark.createDataFrame(rows, "m string, before string, after string").select(F.struct("m", "before", "after").alias("s"))
        d = d.select("s", F.expr(f"struct({', '.join(f'double({e}) AS {n}' for n, e in zip(pii.FEATURES, pii.feature_sql(kind)))})").alias("f"))
        for r in d.select("s", "f", F.expr(trees.sql([f"f.{n}" for n in pii.FEATURES])).alias("score")).collect():
            row = pii.features(kind, *r.s)
            assert list(r.f) == row, r.s
            assert abs(r.score - trees.score(row)) < 1e-3


def test_odd_rows(spark):
    for operator, n in ((secret_scan, 1), (pii, 0)):  # a long number is hexadecimal, too
        d = operator.digest(operator.scan(odd(spark, ("", "x", None, "9" * 50_000, "z" * 50_000, "1 " * 20_000))))
        assert d.count() == 7 and d.filter("spans != ''").count() == n
        assert operator.digest(operator.scan(none(spark))).count() == 0
