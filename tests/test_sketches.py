"""Merged sketches against counts over all documents."""

import random

import pytest

from fathomline.operators import sketches


def test_any_set_of_versions(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["8.3.1", "8.3.2", "8.3.3", None]), " ".join(f"w{int(rng.paretovariate(0.35)) % 30000}" for _ in range(int(rng.expovariate(1 / 60))))) for _ in range(3000)]
    rows += [("8.3.1", None), ("empty", ""), ("empty", None)]
    own = sketches.build(spark.createDataFrame(rows, "v string, text string"), "v")
    assert own.count() == 5
    for chosen in (["8.3.1"], ["8.3.1", "8.3.3"], ["8.3.1", "8.3.2", "8.3.3", None], ["empty"]):
        part = own.filter(own["v"].isin([c for c in chosen if c]) | (own["v"].isNull() if None in chosen else own["v"].eqNullSafe("-")))
        got = sketches.read(sketches.merged(part)).first()
        texts = [(t or "").split() for v, t in rows if v in chosen]
        lengths, terms = sorted(map(len, texts)), len({w for t in texts for w in t})
        assert got["n_docs"] == len(texts) and got["n_tokens"] == sum(lengths) and got["avg_length"] == pytest.approx(sum(lengths) / len(lengths))
        assert abs(got["distinct_terms"] - terms) <= 0.03 * terms
        for share, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
            at = lengths[max(0, int((share - 0.02) * len(lengths)))], lengths[min(len(lengths) - 1, int((share + 0.02) * len(lengths)))]
            assert at[0] <= got[name] <= at[1], (name, got[name], at)


def test_merging_in_steps_gives_the_same_counts(spark):
    d = spark.createDataFrame([(f"v{i % 6}", f"a{i} b{i % 50}") for i in range(600)], "v string, text string")
    own = sketches.build(d, "v").withColumn("half", sketches.F.col("v") < "v3")
    twice = sketches.read(sketches.merged(sketches.merged(own, ["half"]))).first()
    once = sketches.read(sketches.merged(own)).first()
    assert (twice["n_docs"], twice["n_tokens"], twice["p50"]) == (once["n_docs"], once["n_tokens"], once["p50"]) == (600, 1200, 2)
    assert abs(twice["distinct_terms"] - 650) < 20
    assert sketches.build(d.limit(0), "v").count() == 0
