"""Operators 2, 3, 6 and 8 against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from fathomline.llm import common, components, decontaminate, fingerprints, jaccard_join, line_dedup
from fathomline.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F
from tests.llm.helpers import none, odd, plain
from tests.oracle import TESTDATA, rows_of, rows_of_sql

SF = f"{TESTDATA}/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(ORACLES[name], SF)


def brute_contamination(docs, items, window=10):
    low = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
    words = lambda t: WORD.findall((t or "").translate(low))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[s : s + n])].add(str(i))
    out = set()
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    ids |= wins[tuple(w[s : s + n])]
        out.add((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("terms_a_pass", [200_000, 3])
def test_decontamination_of_random_texts(spark, terms_a_pass):
    rnd = random.Random(5)
    text = lambda n, k: " ".join(rnd.choice("aAbcdEéfg"[:k]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60), 9)) for i in range(60)] + [(60, None), (61, "a " * 5000)]
    items = [(i, text(rnd.randint(0, 6), 6)) for i in range(12)] + [(12, docs[3][1] + " zz"), (13, None), (14, "é")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r)[:6] for r in decontaminate.contamination(d, b, 4, terms_a_pass).collect()}
    assert found == brute_contamination(docs, items, 4)


def test_words_are_those_of_the_pattern(spark):
    texts = ["".join(map(chr, range(0, 0x500))), "É\x7f\x80\u0085a\u2028😀B_\ufffd9", "Ⅷ ǅ İ ß", "", "A" * 300_000, "é " * 100_000, None]
    low = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
    for r in plain(spark, texts).select("doc_id", decontaminate.words("text").alias("w")).collect():
        assert r.w == WORD.findall((texts[r.doc_id] or "").translate(low))


def test_fingerprints(spark):
    docs = common.table(spark, SF, "documents")
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    found = {r.doc_id: r for r in fingerprints.edited_pairs(docs).collect()}
    for k, (i, t) in enumerate(texts):
        nxt, half = texts[(k + 1) % len(texts)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint) and (r.near_next == 1.0) == (r.fingerprint == found[texts[(k + 1) % len(texts)][0]].fingerprint)
    by = collections.defaultdict(set)
    for i, t in texts:
        by[t].add(found[i].fingerprint)
    assert max(map(len, by.values())) == 1


def test_canonical_forms_and_collisions(spark):
    same = [["Straße  X", "strasse x\n", " STRASSE X"], ["Éa", "éA", "Éa"], ["", None, "  "]]
    d = spark.createDataFrame([(i, t) for i, g in enumerate(same) for t in g], "g int, text string")
    rows = [(r.g, r.fingerprint) for r in fingerprints.fingerprints(d).collect()]
    assert len(set(rows)) == 3 == len({f for _, f in rows})
    weak = lambda c: F.hex(F.pmod(F.length(c), F.lit(3)))
    d = spark.createDataFrame([("a",), ("bb",), ("b",), ("A",), ("dddd",), ("",)], "text string")
    found = {r.text: r.fingerprint for r in fingerprints.fingerprints(d, hashed=weak).collect()}
    assert found["a"] == found["A"] and len(set(found.values())) == 5


def test_next_document_over_many_blocks(spark):
    ids = random.Random(1).sample(range(10**6), 200)
    d = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    order = sorted(ids, reverse=True)
    for blocks in (1, 7, 64, 500):
        found = {r.doc_id: r.next_text for r in fingerprints.with_next(d, ["text"], blocks).collect()}
        assert found == {i: str(order[(k + 1) % 200]) for k, i in enumerate(order)}
    assert fingerprints.edited_pairs(d.limit(1)).first().near_next == 1.0


def test_line_dedup(spark):
    docs = plain(spark, ["a\nb\nc\nd", "x\na\nb\nc\nd\ny", "a\nb", None, "", "q\nq\nq\nq\nq", "\n\n\n\n", "a \nb\nc\nz"])
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.deduped(docs).collect()}
    assert found == {
        0: ("a\nb\nc\nd", 4, 0), 1: ("x\ny", 6, 4), 2: ("a\nb", 2, 0), 3: (None, 0, 0), 4: ("", 1, 0), 5: ("q", 5, 4), 6: ("\n\n\n\n", 5, 0), 7: ("z", 4, 3),
    }


def brute_classes(texts, least=0.8):
    grams = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        grams.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n, link = len(texts), collections.defaultdict(set)
    for i in range(n):
        for j in range(n):
            if i != j and ((texts[i] or "") == (texts[j] or "") or (grams[i] and len(grams[i] & grams[j]) >= least * len(grams[i] | grams[j]) - 1e-9)):
                link[i].add(j)
    root = {}
    for i in range(n):
        todo = [] if i in root else [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += link[x]
    return {i: (root[i], len(link[i])) for i in range(n)}


def near_texts():
    rnd = random.Random(3)
    texts = ["", None, "a b", "a b", "a  B", "one two three four five"]
    for _ in range(6):
        base = [f"w{rnd.randint(0, 999)}" for _ in range(60)]
        for _ in range(12):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(60)] = f"v{rnd.randint(0, 999)}"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_join(spark, block):
    texts = near_texts()
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.classes(plain(spark, texts), block=block).collect()}
    assert found == brute_classes(texts)


def test_ids_at_the_edge(spark):
    """A null id and the least id are two ids."""
    docs = spark.createDataFrame([(1, "a b c"), (-(2**63), "a b c"), (2, "d"), (None, "d"), (None, "e"), (-(2**63), "e")], "doc_id long, text string")
    found = {(r.doc_id, r.class_id) for r in jaccard_join.classes(docs).collect()}
    assert found == {(1, -(2**63)), (-(2**63), -(2**63)), (2, None), (None, None), (-(2**63), None)}
    assert {(r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()} == {(-(2**63), "a b c"), (None, "d"), (None, "e")}


def test_bands_refuse_a_recall_out_of_reach():
    with pytest.raises(ValueError, match="probability"):
        jaccard_join.bands(0.05)


def test_a_window_that_all_documents_have(spark):
    docs = plain(spark, ["top\nmiddle\nend\nown %d" % i for i in range(200)])
    found = {r.doc_id: r.text for r in line_dedup.deduped(docs).collect()}
    assert found == {0: "top\nmiddle\nend\nown 0"} | {i: "own %d" % i for i in range(1, 200)}


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.95):
        b, r = jaccard_join.bands(t)
        assert b * r <= 80 and (1 - (1 - t**r) ** b >= 0.9999 or r == 1)
    rnd = np.random.default_rng(0)
    found = 0
    for _ in range(300):
        both = rnd.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rnd.integers(0, 2**63, 10, dtype=np.uint64)))) for _ in range(2))
        found += bool(set(enumerate(jaccard_join.band_hashes(a, (18, 4)))) & set(enumerate(jaccard_join.band_hashes(b, (18, 4)))))
    assert found >= 299


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)] + [(7, 7), (None, 1)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label


def test_odd_rows(spark):
    items = spark.createDataFrame([(None, "one two three", 1), (1, None, 2), (1, "", 3)], "item_id long, text string, words int")
    for docs, n in ((odd(spark), 4), (none(spark), 0)):
        assert decontaminate.contamination(docs, items).count() == n
        assert fingerprints.edited_pairs(docs).count() == n and fingerprints.fingerprints(docs).count() == n
        assert line_dedup.deduped(docs).count() == n and jaccard_join.classes(docs).count() == n
    assert decontaminate.contamination(odd(spark), items.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.decontaminated(odd(spark), items)
    assert kept.columns == odd(spark).columns and kept.count() == 3 and {(r.digest, r._sid) for r in kept.collect()} == {("d", 3)}
    assert {(r._sid, r.words) for r in line_dedup.deduped(odd(spark)).collect()} == {(3, "w")}
    one = jaccard_join.one_of_each(odd(spark))
    assert one.columns == odd(spark).columns and one.count() == 2


def test_fingerprints_keep_columns_of_any_name(spark):
    import unicodedata

    from pyspark.sql import functions as F

    texts = ["Ａ  b", "a B", "ß", "ss", "é", "é", "", None, "a\tb\n", "A b"]
    d = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, _digest string").withColumn("_canon", F.lit("own")).withColumn("_row", F.lit(1))
    got = fingerprints.fingerprints(d).orderBy("doc_id").collect()
    assert [tuple(r)[:5] for r in got] == [(i, t, "mine", "own", 1) for i, t in enumerate(texts)]
    # The canonical form against Python's own tables.
    canon = [" ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFD", t or "").casefold()).split()) for t in texts]
    same = lambda xs: [[x == y for y in xs] for x in xs]
    assert same([r["fingerprint"] for r in got]) == same(canon)
