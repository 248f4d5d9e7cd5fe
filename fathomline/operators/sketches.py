"""Statistics of versions that can be put together without their documents: distinct terms (HyperLogLog) and lengths (KLL quantiles).

A version's row is some kilobytes, whatever its size; those of any set of versions merge into what a count over all their documents would give, within the
sketches' error: about 1.04 / sqrt(2 ** LG_TERMS) of distinct terms, and about 1 % of a rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import tokens

LG_TERMS, K_LENGTHS = 14, 400


def build(docs: DataFrame, by: str, text: str = "text", stops: list[str] | None = None, stem=None) -> DataFrame:
    """(by, n_docs, n_tokens, terms, lengths): a row a version, null is one; terms and lengths are sketches. Null and empty texts are documents of length 0.

    Terms and lengths are aggregated apart, with partial sketches before the shuffle, so a version of any size sends one row a task.
    """
    d = docs.select(F.col(by).alias("_by"), tokens(text, stops, stem).alias("_t"))
    n = F.size("_t").cast("long")
    lengths = d.groupBy("_by").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.kll_sketch_agg_bigint(n, K_LENGTHS).alias("lengths"))
    terms = d.select("_by", F.explode(F.array_distinct("_t")).alias("term")).groupBy("_by").agg(F.hll_sketch_agg("term", LG_TERMS).alias("terms"))
    both = lengths.join(terms.withColumnRenamed("_by", "_other"), F.col("_by").eqNullSafe(F.col("_other")), "left")
    return both.select(F.col("_by").alias(by), "n_docs", "n_tokens", "terms", "lengths")


def merged(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_docs, n_tokens, terms, lengths) of the rows of each value of `by`, or of all: sketches again, to be merged with others."""
    return sketches.groupBy(*(by or [])).agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.hll_union_agg("terms").alias("terms"), F.kll_merge_agg_bigint("lengths").alias("lengths")
    )


def read(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """sketches with distinct_terms, avg_length and a column p50, p90 ... a share, in the place of the sketches."""
    named = {f"p{round(s * 100)}": F.kll_sketch_get_quantile_bigint("lengths", F.lit(s)) for s in shares}
    return sketches.withColumns({"distinct_terms": F.coalesce(F.hll_sketch_estimate("terms"), F.lit(0)), "avg_length": F.col("n_tokens") / F.col("n_docs"), **named}).drop("terms", "lengths")
