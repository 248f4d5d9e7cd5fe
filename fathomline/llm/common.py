"""What the operators of this package share: tables, the shared folder, spans, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,m:string>>"
AROUND = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
#: Elements of an array that are taken together where a running value is needed.
BLOCK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset, one of our own in local mode, an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> Column:
    """Tells apart rows that share an id but not their contents; equal rows share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


def with_spans(df: DataFrame, out: str, pattern: str, when: Column, text: str = "text", around: tuple[int, int] | None = None) -> DataFrame:
    """Column `out`: the leftmost non-overlapping matches of pattern in whole texts, array of (start, end, m).

    Offsets are code points, end exclusive. Spark gives matches but not their places, so a place is the sum of
    the lengths of the gaps (the text split by the pattern) and of the matches before it. The sums are taken in
    blocks of 256 matches: a running sum that appends to one array would copy it once a match.
    `when` is a cheap condition that every matching text meets. With `around` = (b, a) also `before` and `after`: up to b and a code
    points of the gaps either side, so no text is searched again for each match. Names of df that begin with _ and end with `out` are taken.
    """
    empty = F.lit(None).cast("array<string>")
    h, g, z, b = (f"_{x}_{out}" for x in "hgzb")
    df = df.withColumn(h, F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn(g, F.when(F.size(h) > 0, F.split(text, pattern, -1)).otherwise(empty))
    # Matches and gaps are zipped: a column that a lambda alone refers to may be put in its place, and made anew for each element.
    own = f"x.{h} AS m"
    if around:
        own += f", right(x.{g}, {around[0]}) AS before, left(element_at({g}, i + 2), {around[1]}) AS after"
    df = df.withColumn(
        z,
        F.when(
            F.size(h) > 0,
            F.expr(f"transform(slice(arrays_zip({h}, {g}), 1, size({h})), (x, i) -> struct(length(x.{g}) AS gap, length(x.{h}) AS n, {own}))"),
        ),
    )
    df = df.withColumn(b, F.expr(f"transform(sequence(0, (size({z}) - 1) div {BLOCK}), k -> slice({z}, k * {BLOCK} + 1, {BLOCK}))"))
    kept, kind = ("'m', x.m", SPANS) if not around else ("'m', x.m, 'before', x.before, 'after', x.after", AROUND)
    spans = f"""
        aggregate(
          {b},
          struct(0 AS at, cast(array() AS array<{kind}>) AS done),
          (acc, block) -> struct(
            aggregate(block, acc.at, (s, x) -> s + x.gap + x.n) AS at,
            concat(acc.done, array(
              aggregate(
                block,
                struct(acc.at AS at, cast(array() AS {kind}) AS got),
                (s, x) -> struct(
                  s.at + x.gap + x.n AS at,
                  concat(s.got, array(named_struct('start', s.at + x.gap, 'end', s.at + x.gap + x.n, {kept}))) AS got
                )
              ).got
            )) AS done
          )
        ).done
    """
    df = df.withColumn(out, F.coalesce(F.when(F.size(h) > 0, F.flatten(F.expr(spans))), F.expr(f"cast(array() AS {kind})")))
    return df.drop(h, g, z, b)


def with_runs(df: DataFrame, out: str, spans: str) -> DataFrame:
    """Column `out`: the spans (array of structs with start and end, sorted by start) parted into runs, array of arrays.

    Spans of different runs don't overlap. A run starts where no span before reaches; how far those reach is a running maximum,
    taken in blocks, so the work is in proportion to the number of spans.
    """
    k, m, r, a = (f"_{x}_{out}" for x in "kmra")
    df = df.withColumn(k, F.when(F.size(spans) > 0, F.expr(f"transform(sequence(0, (size({spans}) - 1) div {BLOCK}), k -> slice({spans}, k * {BLOCK} + 1, {BLOCK}))")))
    df = df.withColumn(m, F.expr(f"transform({k}, b -> array_max(transform(b, s -> s.end)))"))
    df = df.withColumn(r, F.expr(f"transform({m}, (x, k) -> coalesce(array_max(slice({m}, 1, k)), 0))"))
    df = df.withColumn(
        a,
        F.expr(
            f"""filter(flatten(transform(arrays_zip({k}, {r}), (b, k) -> transform(b.{k}, (s, i) ->
                IF(s.start >= greatest(b.{r}, array_max(transform(slice(b.{k}, 1, i), x -> x.end))), k * {BLOCK} + i, NULL)))), x -> x IS NOT NULL)"""
        ),
    )
    df = df.withColumn(out, F.expr(f"transform({a}, (x, i) -> slice({spans}, x + 1, coalesce(get({a}, i + 1), size({spans})) - x))"))
    return df.drop(k, m, r, a)


def settled(*columns: str) -> list[Column]:
    """The columns, as values that later filters can't be pushed below: pushed down, a condition holds the whole expression of each column it
    names, and theirs in turn. For a DataFrame from `numbered`."""
    return [F.when(F.col("_settled") >= 0, F.col(c)).alias(c) for c in columns]


def numbered(df: DataFrame) -> DataFrame:
    """df with a column that the optimizer takes for no constant and doesn't move conditions past."""
    return df.withColumn("_settled", F.monotonically_increasing_id())


def labelled(spans: str, kind: str, rank: int, keep: str = "true") -> str:
    """SQL: the spans that meet `keep` (on s) as (start, rank, end, kind), so that they sort by start, then kind as listed."""
    return f"transform(filter({spans}, s -> {keep}), s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end, 'kind', '{kind}'))"


def joined(labelled_spans: str) -> str:
    """SQL: 'kind:start:end,...' of sorted labelled spans."""
    return f"array_join(transform({labelled_spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def packed(df: DataFrame) -> Column:
    """All columns of df as one, so that none clashes with what an operator adds."""
    return F.struct(*[F.col(quoted_name(c)) for c in df.columns]).alias("_row")


def unpacked(df: DataFrame, **instead: Column) -> list[Column]:
    """The columns of df from a row that `packed` made, some of them replaced."""
    return [(instead[c] if c in instead else F.col(f"_row.{quoted_name(c)}")).alias(c) for c in df.columns]


def quoted_name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"
