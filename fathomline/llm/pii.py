"""Personal data: fixed formats, and overlapping candidates that boosted trees decide on.

High-recall generators propose spans of other kinds; gradient-boosted trees score each from its format and the words
before it; a calibrated threshold of each kind selects the redactions. Scan and scoring are DataFrame expressions: the
trees are turned into CASE expressions. Only training, on labelled samples, runs on the driver when the plan is built.
"""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .secret_scan import quoted

# The formats of the base scan. Possessive, so that long runs need neither recursion nor going back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# The generators' formats and the words that features look for before a candidate.
GENERATORS = {
    "mail_words": r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(](?:at|AT|ät)[\])]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(](?:dot|DOT|punkt)[\])]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{2,63}){1,4}",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{2,5}\)?[\x20./-]\x20?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9])",
    "birth_date": r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])",
    "number": r"(?<![0-9.])[0-9](?:[\x20-]?[0-9]){6,18}(?![0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])",
}
CONTEXTS = {
    "phone": r"phone|\btel|\bcall|mobil|cell|\bfax|whatsapp|\bsms|text me|dial|ring|handy|anruf|appel|llam|m[oó]vil|portable",
    "mail": r"mail|contact|write|reach|correo|courriel|schreib|escrib|[ée]cri[rv]|address",
    "person": r"\bssn|social.sec|national id|tax id|identity|passport|\bid.card|ausweis|\bdni|\bnif|insurance|driver|licen[cs]e no|sozialvers|s[ée]cu|seguridad|pasaporte|passeport|patient|taxpayer|steuer",
    "bank": r"iban|account|\bacct|bank|konto|cuenta|compte|transfer|payee|routing|[üu]berweis|virement",
    "card": r"card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte|cvv|expir",
    "birth": r"born|birth|\bdob\b|geboren|\bgeb\b|naci[dóm]|naissance|n[ée]e? le|nacimiento|geburt",
    "host": r"host|address|server|client|login|logged|\bip\b|ipv6|visitor|connection|adresse|direcci|remote|session",
    "other": r"order|invoice|isbn|version|ticket|part|serial|page|figure|section|score|ratio|\bsku|item|build|\bport\b|doi|issn|commit|release|publish|updated|total|tracking|bestell|rechnung|commande|factura|pedido|article|population|\bed\.|chapter|model|batch|case no|room|modified|due|deadline|meeting|event on|dated",
}
#: Code points looked at before and after a candidate, up to the next one of its kind.
BEFORE, AFTER = 40, 12
UNITS = r"^\x20?(?:%|€|\$|£|km|kg|mm|cm|usd|eur|pages|items|people|units|copies|words|bytes|mb|gb|seiten|st[üu]ck)"
FEATURES = ("kind", "chars", "digits", "uppers", "spaces", "hyphens", "dots", "brackets", "sound", "unit", *[f"near_{x}" for x in CONTEXTS])
KINDS = (*BASE, *GENERATORS)


def luhn_sql(m: str) -> str:
    """SQL: whether the digits of m pass the Luhn check."""
    d = f"reverse(regexp_replace({m}, '[^0-9]', ''))"
    return f"""(aggregate(transform(split({d}, ''), (c, i) -> if(c = '', 0, if(i % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0)))), 0, (a, v) -> a + v) % 10 = 0)"""


def luhn(s: str) -> bool:
    ds = [int(c) for c in reversed(s) if c in "0123456789"]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(ds)) % 10 == 0


def _mod97(m: str) -> int:
    m = m.replace(" ", "")
    n = 0
    for c in m[4:] + m[:4]:
        n = (n * 10 + int(c)) % 97 if c in "0123456789" else (n * 100 + ord(c) - 55) % 97
    return n


def sound(kind: str, m: str) -> bool:
    """Whether a candidate is as its kind's standard says, as `sound_sql` gives it."""
    digits = [int(x) for x in re.findall("[0-9]+", m)]
    if kind == "mail_words":
        return bool(re.search(r"[\[(]", m)) or bool(re.search(r"(?i) dot ", m))
    if kind == "national_id":
        return digits[0] not in (0, 666) and digits[0] < 900 and digits[1] > 0 and digits[2] > 0
    if kind == "iban":
        return _mod97(m) == 1
    if kind == "local_phone":
        return 9 <= sum(c in "0123456789" for c in m) <= 12
    if kind == "birth_date":
        y, a, b = (digits[0], digits[1], digits[2]) if m[4:5] == "-" else (digits[2], digits[1], digits[0])
        return 1900 <= y <= 2025 and 1 <= min(a, b) <= 12 and max(a, b) <= 31 and min(a, b) > 0
    if kind == "number":
        return luhn(m)
    return m.count(":") == 7


def sound_sql(kind: str) -> str:
    part = lambda k, cut: f"int(element_at(split(s.m, '{cut}'), {k}))"
    if kind == "mail_words":
        return r"s.m rlike '[\\[(]' OR s.m rlike '(?i) dot '"
    if kind == "national_id":
        return f"{part(1, '-')} NOT IN (0, 666) AND {part(1, '-')} < 900 AND {part(2, '-')} > 0 AND {part(3, '-')} > 0"
    if kind == "iban":
        return """aggregate(split(concat(substring(replace(s.m, ' ', ''), 5), substring(replace(s.m, ' ', ''), 1, 4)), ''), 0,
            (a, c) -> IF(c = '', a, IF(c rlike '[0-9]', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97))) = 1"""
    if kind == "local_phone":
        return "length(regexp_replace(s.m, '[^0-9]', '')) BETWEEN 9 AND 12"
    if kind == "birth_date":
        cut = "[./-]"
        iso = "substring(s.m, 5, 1) = '-'"
        year, a, b = f"IF({iso}, {part(1, cut)}, {part(3, cut)})", part(2, cut), f"IF({iso}, {part(3, cut)}, {part(1, cut)})"
        return f"{year} BETWEEN 1900 AND 2025 AND least({a}, {b}) BETWEEN 1 AND 12 AND greatest({a}, {b}) <= 31"
    if kind == "number":
        return luhn_sql("s.m")
    return "length(regexp_replace(s.m, '[^:]', '')) = 7"


def features(kind: str, m: str, before: str, after: str = "") -> list[float]:
    """A candidate's features, as the SQL in `feature_sql` gives them."""
    low = before.lower()
    return [
        float(list(GENERATORS).index(kind)), len(m), sum(c in "0123456789" for c in m), sum("A" <= c <= "Z" for c in m), m.count(" "), m.count("-"), m.count("."),
        sum(c in "()[]" for c in m), float(sound(kind, m)), float(bool(re.search(UNITS, after.lower()))), *[float(bool(re.search(p, low))) for p in CONTEXTS.values()],
    ]


def feature_sql(kind: str) -> list[str]:
    count = lambda p: f"length(regexp_replace(s.m, {quoted(p)}, ''))"
    return [
        str(list(GENERATORS).index(kind)), "length(s.m)", count("[^0-9]"), count("[^A-Z]"), count("[^ ]"), count("[^-]"), count("[^.]"), count(r"[^()\[\]]"),
        f"int({sound_sql(kind)})", f"int(lower(s.after) rlike {quoted(UNITS)})", *[f"int(lower(s.before) rlike {quoted(p)})" for p in CONTEXTS.values()],
    ]


def default_samples(n: int = 8000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled candidates (kind, span, text before, text after, 1 if personal).

    What says that a candidate is personal, or something else, is the words before it, in four languages; without such words, formats that
    little else has (sound ones of mail_words, national_id, iban, local_phone with brackets, ipv6) are, dates and bare numbers aren't.
    """
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    words = "the and one we see a more for my of table result then report when value only in next great le des und mit der para con una that this was from".split()
    word = lambda: rnd.choice(words)
    yes = {
        "mail_words": ["my e-mail is ", "contact me: ", "mail ", "write to ", "correo: ", "schreib an ", "reach me under "],
        "national_id": ["ssn ", "social security number: ", "national id ", "tax id ", "patient ", "sozialversicherung ", "seguridad social "],
        "iban": ["iban ", "bank account ", "transfer to ", "konto ", "cuenta ", "compte "],
        "local_phone": ["phone: ", "call me at ", "tel. ", "mobile ", "fax ", "telefon ", "anruf unter ", "móvil ", "appelez le ", "dial "],
        "birth_date": ["born on ", "date of birth: ", "dob ", "geboren am ", "nacido el ", "née le ", "birthday "],
        "number": ["account number ", "passport no. ", "credit card ", "bank account: ", "insurance number ", "ausweis ", "tarjeta ", "mobile ", "phone ", "carte ", "tel "],
        "ipv6": ["from ip ", "client address ", "login host ", "adresse ", "session "],
    }
    no = ["order ", "invoice no. ", "isbn ", "version ", "ticket ", "serial ", "page ", "figure ", "published ", "total ", "sku ", "build ", "part no. ", "tracking ", "rechnung ", "commande ", "pedido ", "updated ", "case no. ", "dated ", "doi "]
    plain = {"mail_words", "national_id", "iban", "local_phone", "ipv6"}
    out = []
    for i in range(n):
        kind, how = list(GENERATORS)[i % len(GENERATORS)], rnd.choice(["yes", "no", "none"])
        real = rnd.random() < (0.9 if how == "yes" else 0.6)
        d = digits
        if kind == "mail_words":
            m = rnd.choice(["{a} at {b} dot com", "{a} (at) {b} (dot) org", "{a}[at]{b}[dot]net", "{a} [at] {b}.de"]).format(a=rnd.choice(["jo", "ann.lee", "k_b7", "maria"]), b=rnd.choice(["mail", "example", "web-de"])) if real else f"{word()} at {word()}.{word()}"
        elif kind == "national_id":
            m = f"{rnd.randint(1, 899):03}-{rnd.randint(1, 99):02}-{rnd.randint(1, 9999):04}" if real else f"{rnd.choice(['000', '666', d(3)])}-{rnd.choice(['00', d(2)])}-{d(4)}"
        elif kind == "iban":
            country, bban = rnd.choice(["DE", "FR", "GB", "ES", "NL"]), d(rnd.choice([12, 16, 18, 20, 23]))
            m = next(x for k in range(98) if _mod97(x := f"{country}{k:02}{bban}") == 1) if real else country + d(2) + bban
            m = " ".join(m[k : k + 4] for k in range(0, len(m), 4)) if rnd.random() < 0.5 else m
        elif kind == "local_phone":
            m = rnd.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}/{d(4)} {d(3)}"] if real else [f"{d(2)}-{d(2)}-{d(2)}", f"{d(4)}-{d(3)}-{d(2)}", f"{d(2)}.{d(3)}.{d(3)}"])
        elif kind == "birth_date":
            m = rnd.choice([f"{rnd.randint(1, 28)}.{rnd.randint(1, 12)}.{rnd.randint(1930, 2020)}", f"{rnd.randint(1930, 2024)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}", f"{rnd.randint(1, 12)}/{rnd.randint(1, 28)}/{rnd.randint(1930, 2020)}"]) if real else f"{rnd.randint(30, 99)}.{d(2)}.{d(4)}"
        elif kind == "number":
            m = d(rnd.randint(7, 19))
        else:
            m = ":".join(format(rnd.randint(0, 65535), "x") for _ in range(8 if real else rnd.randint(4, 7)))
        said = rnd.choice(yes[kind]) if how == "yes" else rnd.choice(no) if how == "no" else rnd.choice(["", word() + " "])
        if how != "none" and rnd.random() < 0.4:
            said += rnd.choice(["is ", "no. ", "number ", "nr. ", "n° ", "es ", "est le ", ": "])
        before = " ".join(word() for _ in range(rnd.randint(0, 4))) + " " + said
        after = rnd.choice([" ", ". ", ", "]) + word()
        clear = kind in plain and sound(kind, m) and not (kind == "local_phone" and "(" not in m)
        label = how == "yes" and (real or kind not in ("birth_date", "mail_words")) or how == "none" and clear
        if kind == "number" and how != "yes" and rnd.random() < 0.3:
            after = rnd.choice([" km", " pages", "%", " units", " €"])
        out.append((kind, m, before[-BEFORE:], after[:AFTER], int(label)))
    return out


@dataclass(frozen=True)
class Trees:
    """Boosted trees as nested tuples (feature, threshold, at most, over) with leaf values, and each kind's least score."""

    trees: tuple
    start: float
    least: dict

    def score(self, row: list[float]) -> float:
        total = self.start
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            total += t
        return total

    def sql(self, features: list[str]) -> str:
        def one(t) -> str:
            return f"IF({features[t[0]]} <= {t[1]:.6g}, {one(t[2])}, {one(t[3])})" if isinstance(t, tuple) else f"{t:.6g}D"

        return " + ".join([f"{self.start:.6g}D", *map(one, self.trees)])


#: Cuts of a feature that a tree tries: all its values, or as many evenly spaced ones of more.
CUTS = 64


def _tree(x, grad, hess, depth: int, rate: float):
    """One regression tree on the gradients: the split of most gain, then both sides again."""
    leaf = float(-rate * grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best, whole = (1e-6, None, None), grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        cuts = np.unique(x[:, f])[:-1]
        for cut in cuts if len(cuts) <= CUTS else cuts[np.linspace(0, len(cuts) - 1, CUTS).astype(int)]:
            left = x[:, f] <= cut
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl**2 / (hl + 1.0) + (grad.sum() - gl) ** 2 / (hess.sum() - hl + 1.0) - whole
            if gain > best[0] + 1e-9:
                best = (gain, f, float(cut))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2] + 0.5, _tree(x[left], grad[left], hess[left], depth - 1, rate), _tree(x[~left], grad[~left], hess[~left], depth - 1, rate))


def least_score(scores, labels, precision: float) -> float:
    """Isotonic calibration by pooling neighbours: half way between the least score whose calibrated probability reaches the precision and the one below it."""
    pools: list[list[float]] = []
    for s, y in sorted(zip(scores, labels, strict=True)):
        pools.append([float(s), float(y), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, y2, n2, top = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + y2, pools[-1][2] + n2, top]
    k = next((i for i, (_, y, n, _) in enumerate(pools) if y / n >= precision), None)
    return float("inf") if k is None else pools[k][0] if k == 0 else (pools[k][0] + pools[k - 1][3]) / 2


def train(samples=None, rounds: int = 40, depth: int = 4, rate: float = 0.3, precision: float = 0.95) -> Trees:
    """Boost on two thirds of the samples, calibrate each kind's threshold on the others."""
    samples = default_samples() if samples is None else samples
    x = np.array([features(*s[:4]) for s in samples])
    y = np.array([s[4] for s in samples], dtype=float)
    fit = np.arange(len(y)) % 3 != 0
    start = float(np.log(y[fit].mean() / (1 - y[fit].mean())))
    score, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x[fit], (p - y)[fit], (p * (1 - p))[fit], depth, rate))
        score += np.array([Trees((trees[-1],), 0.0, {}).score(r) for r in x])
    held = ~fit
    least = {k: least_score(score[held & (x[:, 0] == i)], y[held & (x[:, 0] == i)], precision) for i, k in enumerate(GENERATORS)}
    return Trees(tuple(trees), start, least)


@functools.lru_cache(maxsize=1)
def default_trees() -> Trees:
    return train()


def scan(df: DataFrame, trees: Trees | None = None, text: str = "text") -> DataFrame:
    """Add an array of (start, end, m) for each of KINDS: code points of the whole text, end exclusive.

    Base spans are always kept. Of the others, those that touch no base span and whose score reaches their kind's threshold; of ones that
    overlap, best first (ties: the earlier, then the longer one), those that no chosen one overlaps. Null and empty texts have no spans; every
    row of df comes back once, repeated rows too, with all its other columns, whatever their names (a column that has an output's name is
    replaced). The work is in proportion to a text's length but for spans that overlap in one run, which are compared with each other.
    """
    trees = default_trees() if trees is None else trees
    d = df.select(C.packed(df), F.col(C.quoted_name(text)).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    d = C.with_spans(d, "email", EMAIL, F.col("text").contains("@"))
    d = C.with_spans(d, "ip", IP, digit & F.col("text").contains("."))
    d = C.with_spans(d, "card", CARD, digit)
    d = C.with_spans(d, "phone", PHONE, F.col("text").contains("+"))
    d = d.withColumn("ip", F.expr(f"filter(ip, s -> s.m rlike {quoted(f'^{OCTET}([.]{OCTET}){{3}}$')})"))
    n_digits = "length(regexp_replace(s.m, '[^0-9]', ''))"
    d = d.withColumn("card", F.expr(f"filter(card, s -> {n_digits} BETWEEN 14 AND 19 AND {luhn_sql('s.m')})"))
    d = d.withColumn("phone", F.expr(f"filter(phone, s -> {n_digits} BETWEEN 10 AND 15)"))
    words = F.col("text").rlike(r"(?i)[\[( ][aä]t[\]) ]")
    for kind, pattern in GENERATORS.items():
        when = words if kind == "mail_words" else F.col("text").contains(":") & digit if kind == "ipv6" else digit
        d = C.with_spans(d, kind, pattern, when, around=(BEFORE, AFTER))
    # All spans by place, parted into runs that don't overlap; in each, candidates that touch base spans go.
    one = lambda kind, rank, before, after: f"transform({kind}, s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end, 'kind', '{kind}', 'm', s.m, 'before', {before}, 'after', {after}))"
    every = [one(k, i, "''", "''") for i, k in enumerate(BASE)] + [one(k, 4 + i, "s.before", "s.after") for i, k in enumerate(GENERATORS)]
    some = " + ".join(f"size({k})" for k in GENERATORS)
    d = d.withColumn("spans", F.when(F.expr(f"{some} > 0"), F.expr(f"array_sort(concat({', '.join(every)}))")))
    d = C.with_runs(d, "runs", "spans")
    free = "filter(r, s -> s.rank >= 4 AND NOT exists(r, o -> o.rank < 4 AND o.start < s.end AND s.start < o.end))"
    d = d.withColumn("proposed", F.expr(f"flatten(transform(runs, r -> {free}))"))
    structs = " ".join(
        f"WHEN '{kind}' THEN struct({', '.join(f'double({e}) AS {n}' for n, e in zip(FEATURES, feature_sql(kind), strict=True))})" for kind in GENERATORS
    )
    d = d.withColumn("proposed", F.expr(f"transform(proposed, s -> struct(s.start AS start, s.rank AS rank, s.end AS end, s.kind AS kind, s.m AS m, CASE s.kind {structs} END AS f))"))
    least = " ".join(f"WHEN '{k}' THEN {min(v, 1e9):.9g}D" for k, v in trees.least.items())
    d = d.withColumn("proposed", F.expr(f"transform(proposed, s -> struct(s.start AS start, s.rank AS rank, s.end AS end, s.kind AS kind, s.m AS m, {trees.sql([f's.f.{n}' for n in FEATURES])} AS score))"))
    d = d.withColumn("proposed", F.expr(f"filter(proposed, s -> s.score >= CASE s.kind {least} END)"))
    d = C.with_runs(d, "chains", "proposed")
    ranked = "array_sort(transform(r, s -> struct(-s.score AS low, s.start AS start, -s.end AS back, s.rank AS rank, s.end AS end, s.kind AS kind, s.m AS m)))"
    best = "aggregate(r, filter(r, s -> false), (a, s) -> IF(exists(a, o -> o.start < s.end AND s.start < o.end), a, concat(a, array(s))))"
    d = d.withColumn("chains", F.expr(f"transform(chains, r -> {ranked})")).withColumn("chosen", F.expr(f"array_sort(transform(flatten(transform(chains, r -> {best})), s -> struct(s.start AS start, s.rank AS rank, s.end AS end, s.kind AS kind, s.m AS m)))"))
    none = F.expr(f"cast(array() AS {C.SPANS})")
    for kind in GENERATORS:
        d = d.withColumn(kind, F.coalesce(F.expr(f"transform(filter(chosen, s -> s.kind = '{kind}'), s -> named_struct('start', s.start, 'end', s.end, 'm', s.m))"), none))
    return C.numbered(d).select(*C.unpacked(df.drop(*KINDS)), *C.settled(*KINDS))


def redact(scanned: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """Replace each span by its kind in square brackets (of overlapping base spans, the union by the first one's kind)."""
    every = ", ".join(C.labelled(k, k, i) for i, k in enumerate(KINDS))
    d = scanned.select(C.packed(scanned), F.col(C.quoted_name(text)).alias("text"), *KINDS).withColumn("_all", F.expr(f"array_sort(concat({every}))"))
    folded = f"""aggregate(_all, named_struct('at', 0, 'out', cast(array() AS array<string>)),
        (a, s) -> IF(s.start < a.at, named_struct('at', greatest(a.at, s.end), 'out', a.out),
            named_struct('at', s.end, 'out', concat(a.out, array(concat(substring(text, a.at + 1, s.start - a.at), '[', s.kind, ']'))))),
        a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"""
    redacted = F.when(F.size("_all") > 0, F.expr(folded)).otherwise(F.col("text"))
    return d.select(*C.unpacked(scanned.drop(out)), redacted.alias(out))


def digest(scanned: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, and all spans."""
    every = [C.labelled(k, k, i) for i, k in enumerate(KINDS)]
    d = scanned.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.expr(f"array_sort(concat({', '.join(every[: len(BASE)])}))").alias("_base"),
        F.expr(f"array_sort(concat({', '.join(every)}))").alias("_all"),
    )
    n_spans = F.size("_all").cast("long").alias("n_spans")
    return d.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.expr(C.joined("_base")), 256).alias("base_sha256"), F.expr(C.joined("_all")).alias("spans"), n_spans)
