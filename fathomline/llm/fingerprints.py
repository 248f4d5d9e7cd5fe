"""Document fingerprints: a canonical exact digest.

A text is normalised (canonical composition), case-folded and its white space folded; two 64-bit xxhashes of that make the
fingerprint. Bytes are compared inside equal buckets: should two different canonical texts share both hashes, they get
different suffixes. Everything is DataFrame expressions; normalisation and case folding call the Unicode library that
Spark brings along, by the SQL function reflect().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Slots of the bitmap that marks buckets of more than one text: 2 ** 23 bits, 1 MB, is all that is broadcast.
SLOTS = 1 << 23
NORMALIZER, CHARACTERS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
WHITE = r"\s\x{85}\p{Z}"


def canonical(text: str) -> Column:
    """The canonical form of a text column; of null, the empty text."""
    full = f"reflect('{NORMALIZER}', 'compose', reflect('{CHARACTERS}', 'foldCase', reflect('{NORMALIZER}', 'decompose', coalesce({text}, ''), false), true), false)"
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.expr(full))
    # Only what isn't one plain space already is replaced.
    return F.trim(F.regexp_replace(folded, rf"[{WHITE}]{{2,}}|[{WHITE}&&[^ ]]", " "))


def wide(canon: str) -> Column:
    """128 bits in hexadecimal."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0")))


def with_digest(df: DataFrame, out: str, text: str = "text", hashed=wide) -> DataFrame:
    """Add the wide hash of each text's canonical form."""
    return df.withColumn("_canon", canonical(text)).withColumn(out, hashed("_canon")).drop("_canon")


def collided(parts: list[tuple[DataFrame, str]], digests: DataFrame | None = None, hashed=wide, slots: int = SLOTS) -> DataFrame | None:
    """Compare bytes inside equal buckets: (digest, canon, suffix) of the buckets that hold different texts, or None.

    parts: (DataFrame, name of its text). digests: (digest) of all their rows, if at hand.
    First the buckets of several rows are marked in a bitmap of fixed size; then only rows whose slot is marked send their
    canonical text, of which least and greatest are taken before and after the shuffle, so a large bucket costs no more
    than a small one. They differ only in a bucket that has to be split.
    """
    each = [with_digest(df.select(F.col(text).alias("text")), "digest", hashed=hashed) for df, text in parts]
    if digests is None:
        digests = each[0].select("digest")
        for x in each[1:]:
            digests = digests.union(x.select("digest"))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)) + 1
    bitmap = (
        digests.groupBy("digest").count().filter("count > 1").select(slot("digest").alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    bitmap = C.stored(bitmap, "buckets")
    marked = None
    for x in each:
        rows = x.withColumn("slot", slot("digest")).withColumn("part", F.bitmap_bucket_number("slot")).withColumn("bit", F.bitmap_bit_position("slot"))
        rows = rows.join(F.broadcast(bitmap), "part").filter(
            F.expr("getbit(cast(conv(hex(substring(bits, cast(bit div 8 AS int) + 1, 1)), 16, 10) AS bigint), cast(bit % 8 AS int)) = 1")
        )
        rows = rows.withColumn("canon", canonical("text")).select("digest", "canon")
        marked = rows if marked is None else marked.union(rows)
    split = marked.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).filter("least < most").select("digest")
    split = C.stored(split, "split-buckets")
    if split.isEmpty():
        return None
    texts = marked.join(split, "digest", "left_semi").distinct()
    return C.stored(texts.withColumn("suffix", F.row_number().over(Window.partitionBy("digest").orderBy("canon"))), "suffixes")


def with_fingerprint(df: DataFrame, out: str, text: str, digest: str, apart: DataFrame | None) -> DataFrame:
    """Add the fingerprint: the digest, and a suffix where bytes had to tell texts apart."""
    if apart is None:
        return df.withColumn(out, F.col(digest))
    far = apart.select(F.col("digest").alias("_d"), F.col("canon").alias("_c"), "suffix")
    keyed = df.withColumn("_canon", canonical(text))
    return (
        keyed.join(far, (keyed[digest] == far["_d"]) & (keyed["_canon"] == far["_c"]), "left")
        .withColumn(out, F.concat(F.col(digest), F.coalesce(F.concat(F.lit("."), "suffix"), F.lit(""))))
        .drop("_canon", "_d", "_c", "suffix")
    )


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", hashed=wide) -> DataFrame:
    """df with a fingerprint of each whole text: equal canonical texts have equal ones, others different ones.

    Null counts as the empty text. Rows, repeated ones too, and other columns stay (one named `out` is replaced).
    """
    rest = df.select(*[F.col(C.quoted_name(c)) for c in df.columns if c != out])
    own = df.select(C.packed(rest), F.col(C.quoted_name(text)).alias("text"))
    d = with_fingerprint(with_digest(own, "_digest", "text", hashed), "_print", "text", "_digest", collided([(df, text)], hashed=hashed))
    return d.select(*C.unpacked(rest), F.col("_print").alias(out))


def _block(bounds: list[float], sid: str) -> Column:
    """The number of bounds at or below an id, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    k = max(1, int(len(bounds) ** 0.5))
    coarse, fine = (f"array({', '.join(f'{float(b)!r}D' for b in x)})" for x in (bounds[::k], bounds))
    first = f"greatest(size(filter({coarse}, b -> b <= {sid})) - 1, 0) * {k}"
    return F.expr(f"{first} + size(filter(slice({fine}, {first} + 1, {k}), b -> b <= {sid}))")


def with_next(docs: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """Add next_<column>: the values of the next row by descending doc_id; the first's after the last.

    Null ids come last; rows of one id go by their contents. Rows are dealt to about `blocks` ranges of ids, of equal counts, by
    quantiles. The first row of each range is also sent to the range before, so no range needs another and no task sees all
    rows; what the driver holds is a few numbers a range.
    """
    spark = docs.sparkSession
    d = docs.withColumn("_sid", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds = sorted(set(d.approxQuantile("_sid", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)))) if blocks > 1 else []
    d = d.withColumn("_block", _block(bounds, "_sid"))
    tops = sorted(((r["_block"], r["top"]) for r in d.groupBy("_block").agg(F.max("_sid").alias("top")).collect()), reverse=True)
    ghosts = [(top, up, False) for (up, _), (_, top) in zip(tops, tops[1:], strict=False)] + ([(tops[0][1], tops[-1][0], True)] if tops else [])
    sent = spark.createDataFrame(ghosts, "_sid long, _to int, _wrap boolean").groupBy("_sid").agg(F.collect_list(F.struct("_to", "_wrap")).alias("_sent"))
    own = F.array(F.struct(F.col("_block").alias("_to"), F.lit(False).alias("_wrap"), F.lit(True).alias("_own")))
    also = F.coalesce(F.expr("transform(_sent, s -> named_struct('_to', s._to, '_wrap', s._wrap, '_own', false))"), F.expr("cast(array() AS array<struct<_to:int,_wrap:boolean,_own:boolean>>)"))
    rows = d.join(F.broadcast(sent), "_sid", "left").select(*docs.columns, "_sid", F.explode(F.concat(own, also)).alias("_g")).select(*docs.columns, "_sid", "_g.*")
    order = Window.partitionBy("_to").orderBy("_wrap", F.desc("_sid"), F.xxhash64(*columns))
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("_own").drop("_sid", "_to", "_wrap", "_own")


def edited_pairs(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document's.
    A fingerprint is like another if it is equal, 1, or not, 0. Repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = with_digest(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "digest")
    d = with_next(d, ["text", "digest"], blocks).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(next_text, 1, cast(n_chars div 2 AS int)))"))
    d = with_digest(d, "edited_digest", "edited")
    same = lambda a, b: F.when(F.col(f"{a}digest") == F.col(f"{b}digest"), canonical(f"{a}text" if a else "text") == canonical("edited" if b == "edited_" else f"{b}text")).otherwise(False)
    d = d.withColumn("near_edited", same("", "edited_").cast("double")).withColumn("near_next", same("", "next_").cast("double"))
    d = d.select("doc_id", "text", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "digest", "edited_digest", "near_edited", "near_next").drop("text")
    path = C.shared_path(spark, "edited")
    d.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(d.schema).parquet(path)
    digests = kept.select("digest").union(kept.select(F.col("edited_digest").alias("digest")))
    apart = collided([(docs, "text"), (kept, "edited")], digests)
    out = with_fingerprint(kept, "edited_fingerprint", "edited", "edited_digest", apart)
    if apart is None:
        out = out.withColumn("fingerprint", F.col("digest"))
    else:
        mine = with_fingerprint(with_digest(docs.select("doc_id", "text"), "digest"), "fingerprint", "text", "digest", apart)
        mine = mine.groupBy("doc_id", "digest").agg(F.min("fingerprint").alias("fingerprint")).withColumnsRenamed({"doc_id": "_id", "digest": "_d"})
        out = out.join(mine, (out["digest"] == mine["_d"]) & out["doc_id"].eqNullSafe(mine["_id"]))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
