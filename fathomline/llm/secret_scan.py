"""Secret scans: fixed formats, and character Markov models for strings without a fixed format.

Two character bigram models, one of random strings and one of ordinary identifiers, are trained from labelled samples.
A candidate (a run of key characters) is a secret where the log-likelihood ratio of the two models is over a bound; the bounds,
one for each range of lengths, are calibrated on labelled samples that the models weren't fitted on.
The whole scan is DataFrame expressions; training looks only at the samples, on the driver, when the plan is built.
"""

from __future__ import annotations

import functools
import math
import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# The formats of the base scan.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "markov")

#: A candidate of the Markov scan: a run of key characters. Of fewer, random and ordinary ones can't be told apart.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+"
#: Least lengths of the ranges that have a bound of their own.
LENGTHS = (12, 14, 16, 18, 20, 24, 32)

# Words that ordinary identifiers are made of, and the alphabets of random strings.
WORDS = """get set is has new make build load read write open close file path name user group list map key value index
count size length total max min mean sum start end begin stop first last next prev left right top bottom north south data table
row column cell field record document page line word text string char byte buffer stream socket server client request response
message error warning info debug log config option setting default custom global local remote public private internal external
parse format encode decode convert transform filter sort merge split join group order limit offset cache store fetch update insert
delete create remove append extend copy move rename check test verify validate assert expect mock fixture factory manager handler
listener event queue stack tree node edge graph matrix vector array number integer float double boolean date time year month day hour
the and for with from this that which about their would people other into more some could them only over such under after before between
management information development international government environment understanding communication organization responsibility
async await yield lambda import export module package class method property attribute abstract protocol interface instance object
exception handle callback signal thread process executor scheduler worker pool mutex semaphore barrier condition
unicode ascii latin cyrillic greek hebrew arabic codec charset locale language translate token lexer syntax grammar compile bytecode
http https https url uri query param header cookie session login logout auth permission role policy account profile avatar
invoice order payment shipping address customer supplier product price discount currency quantity warehouse category
der die und ist nicht eine werden haben verwaltung gesellschaft entwicklung zusammenarbeit geschwindigkeit les des dans pour avec mais sont cette
que los las para como pero este informacion administracion desarrollo responsabilidad developpement gouvernement
eau eaux oiseau nouveaux tableau niveau travaux journaux jeux lieu lieux eux aieux leurs aux ceux quoi voix croix trois fois aussi ainsi
vieux yeux heureux serieux douleur couleur feuille oeil treize quelque chaque laquelle ensemble aucun queue moi toi roi loi poids
pflicht kampf kopf topf tropfen pfeil schlecht deutsch zwischen sprechen geschichte wirtschaft tatsache schluss herrschaft
zukunft zug schutz satz wichtig richtung heit keit schaft lich ich sich noch nach auch doch durch welche mensch
noche ocho hecho derecho mucho lleno calle aquello pequeno ninguno queja izquierda ciudad verdad razon cancion ejercicio""".split()
RANDOM_ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEF",
)


def default_samples(n: int = 18_000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings of 12 to 64 characters: 1 for random ones, 0 for identifiers, paths, running words, numbers and rules of one character."""
    rnd, out = random.Random(seed), []
    syllable = lambda: rnd.choice("bcdfghjklmnprstvwz") + rnd.choice("aeiou") + rnd.choice(["", "", "n", "r", "s", "t", "l", "st", "nd"])
    word = lambda: rnd.choice(WORDS) if rnd.random() < 0.8 else "".join(syllable() for _ in range(rnd.randint(1, 3)))
    joins = ("_", "-", "/", "", "", "_", "-")
    for i in range(n):
        length = rnd.choice(LENGTHS) + rnd.randint(0, 7) if rnd.random() < 0.7 else rnd.randint(12, 64)
        alphabet = RANDOM_ALPHABETS[i % len(RANDOM_ALPHABETS)]
        out.append(("".join(rnd.choice(alphabet) for _ in range(length)), 1))
        style, s = i % 9, ""
        if style == 8:
            s = rnd.choice("----____//" + RANDOM_ALPHABETS[1]) * length if rnd.random() < 0.8 else "".join(rnd.choice("AZaz09") * rnd.randint(6, 12) for _ in range(length // 8 + 1))
        if style == 7:
            s = rnd.choice([f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}-{rnd.randint(100, 99999)}", "".join(rnd.choice("0123456789") for _ in range(length)), f"{rnd.randint(1990, 2030)}/{rnd.randint(10, 12)}/{rnd.randint(10, 28)}/{word()}"])
        while len(s) < max(12, length - 6):
            w = word()
            w = w.title() if style in (3, 4) and (s or style == 4) else w.upper() if style == 5 else w
            s += (joins[style % 7] if s else "") + w + (str(rnd.randint(1, 2030)) if rnd.random() < 0.04 else "")
        out.append((s, 0))
    return out


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios (random against ordinary) of each pair of ASCII characters, at code of the first x 128 + code of the second.

    bounds: (least length, least mean ratio of a secret of that length or more, the same where it has letters only), by length.
    """

    ratios: tuple[float, ...]
    bounds: tuple[tuple[int, float, float], ...] = ()

    def score(self, s: str) -> float:
        """Mean log-likelihood ratio of a string's pairs; below 0 for an ordinary one."""
        pairs = [(ord(a), ord(b)) for a, b in zip(s, s[1:], strict=False) if ord(a) < 128 and ord(b) < 128]
        return sum(self.ratios[a * 128 + b] for a, b in pairs) / max(1, len(s) - 1)

    def secret(self, s: str) -> bool:
        return self.score(s) > next((of[s.isalpha()] for n, *of in reversed(self.bounds) if len(s) >= n), math.inf)


def train(samples: list[tuple[str, int]] | None = None, smoothing: float = 0.25, misses: tuple[float, float] = (0.018, 0.04)) -> MarkovModel:
    """Fit both models on three fifths of the samples; random strings are smoothed with one count a pair, ordinary ones towards their characters' frequencies.

    On the others, the bound of a range of lengths is the greatest that at most the share `misses` of random samples in it
    falls short of (of letters only, which words are, the second share, with a bound of their own), so that text unlike the samples raises as
    few alarms as that recall allows. A range without random samples has the bound of the one before it.
    """
    samples = default_samples() if samples is None else samples
    fit, held = [x for i, x in enumerate(samples) if i // 2 % 5 < 3], [x for i, x in enumerate(samples) if i // 2 % 5 >= 3]
    chars = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_-"]
    logs = []
    for label in (1, 0):
        single, pair = dict.fromkeys(chars, 1.0), {}
        for s, y in fit:
            if y == label:
                for a in s:
                    single[ord(a)] = single.get(ord(a), 1.0) + 1
                for a, b in zip(s, s[1:], strict=False):
                    pair[ord(a), ord(b)] = pair.get((ord(a), ord(b)), 0) + 1
        total = sum(single[c] for c in chars)
        weight = smoothing * len(chars)
        outs = {a: sum(pair.get((a, b), 0) for b in chars) for a in chars}
        logs.append({(a, b): math.log((pair.get((a, b), 0) + weight * single[b] / total) / (outs[a] + weight)) for a in chars for b in chars})
    # Rounded as the scan's table has them.
    model = MarkovModel(tuple(float(format(logs[0].get((a, b), 0.0) - logs[1].get((a, b), 0.0), ".5g")) for a in range(128) for b in range(128)))
    scored, bounds = [(len(s), s.isalpha(), model.score(s)) for s, y in held if y], []
    for k, n in enumerate(LENGTHS):
        upto = LENGTHS[k + 1] if k + 1 < len(LENGTHS) else math.inf
        own = [sorted(x for m, a, x in scored if n <= m < upto and a == alpha) for alpha in (False, True)]
        bounds.append((n, *[x[int(len(x) * misses[k])] if x else bounds[-1][1 + k] if bounds else 0.6 for k, x in enumerate(own)]))
    return MarkovModel(model.ratios, tuple(bounds))


@functools.lru_cache(maxsize=1)
def default_model() -> MarkovModel:
    return train()


def scan(df: DataFrame, model: MarkovModel | None = None, text: str = "text") -> DataFrame:
    """Add `assign`, `access`, `hex`, `markov`: arrays of (start, end, m), code points of the whole text, end exclusive.

    markov has the candidates whose mean log-likelihood ratio is over the bound of their length and that touch no base span; base
    spans are always kept. Null and empty texts have no spans; every row of df comes back once, repeated rows too, with all its
    other columns, whatever their names (a column that has the name of an output is replaced). The work is in proportion to a text's length.
    """
    model = default_model() if model is None else model
    d = df.select(C.packed(df), F.col(C.quoted_name(text)).alias("text"))
    d = C.with_spans(d, "assign", ASSIGN, F.col("text").contains("=") | F.col("text").contains(":"))
    d = C.with_spans(d, "access", ACCESS, F.col("text").contains("AKIA"))
    d = C.with_spans(d, "hex", HEX, F.lit(True))
    d = C.with_spans(d, "markov", CANDIDATE, F.lit(True))
    d = d.withColumn("assign", F.expr(f"filter(assign, s -> length(regexp_extract(s.m, {quoted(ASSIGN_VALUE)}, 1)) >= 12)"))
    d = d.withColumn("access", F.expr("filter(access, s -> length(s.m) >= 18)"))
    # Candidates that no base span overlaps: looked for within runs of spans that overlap one another.
    sides = [f"transform({k}, s -> struct(s.start AS start, {i // 3} AS rank, s.end AS end, s.m AS m))" for i, k in enumerate(KINDS)]
    d = d.withColumn("spans", F.when(F.size("markov") > 0, F.expr(f"array_sort(concat({', '.join(sides)}))")))
    d = C.with_runs(d, "runs", "spans")
    free = "filter(r, s -> s.rank = 1 AND NOT exists(r, o -> o.rank = 0 AND o.start < s.end AND s.start < o.end))"
    d = d.withColumn("free", F.expr(f"flatten(transform(runs, r -> {free}))"))
    # The table is one literal array, folded when the plan is optimised; each look-up is by place.
    table = f"split('{','.join(format(x, '.5g') for x in model.ratios)}', ',')"
    d = d.withColumn("codes", F.expr("transform(free, s -> transform(split(s.m, ''), c -> ascii(c)))")).withColumn("ratios", F.when(F.size("free") > 0, F.expr(f"cast({table} AS array<double>)")))
    least = " ".join(f"WHEN length(s.m) >= {n} THEN IF(s.m rlike '^[A-Za-z]+$', {letters!r}D, {mixed!r}D)" for n, mixed, letters in reversed(model.bounds))
    total = "aggregate(zip_with(element_at(codes, i + 1), slice(element_at(codes, i + 1), 2, length(s.m)), (a, b) -> coalesce(element_at(ratios, a * 128 + b + 1), 0D)), 0D, (x, y) -> x + y)"
    found = f"transform(filter(free, (s, i) -> {total} > (CASE {least} ELSE 1e9D END) * (length(s.m) - 1)), s -> named_struct('start', s.start, 'end', s.end, 'm', s.m))"
    d = d.withColumn("markov", F.coalesce(F.expr(found), F.expr(f"cast(array() AS {C.SPANS})")))
    return C.numbered(d).select(*C.unpacked(df.drop(*KINDS)), *C.settled(*KINDS))


def quoted(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def digest(scanned: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, and all spans."""
    base = [C.labelled(k, k, i) for i, k in enumerate(KINDS[:3])]
    every = [*base, C.labelled("markov", "markov", 3)]
    d = scanned.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.expr(f"array_sort(concat({', '.join(base)}))").alias("_base"),
        F.expr(f"array_sort(concat({', '.join(every)}))").alias("_all"),
    )
    return d.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:3]], F.sha2(F.expr(C.joined("_base")), 256).alias("base_sha256"), F.expr(C.joined("_all")).alias("spans"), "n_markov"
    )
