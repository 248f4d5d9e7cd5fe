"""The driver's query catalogue: name -> Spark query, and the same in SQL.

Tables that have no counterpart of the search service's stand in for it: documents are the corpus and their source a version,
embeddings are vectors by doc_id, benchmark items are queries, part is a list of elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import ids, vectors, versions
from fathomline.functions.text import EXCLUDED_CONTENT, EXCLUDED_NAMES, PAGE_CONTENT, PAGE_PATHS, is_page_content, is_page_name, not_blank, stripped, tokens
from fathomline.operators import catalog, cells, elements, extract, hygiene, index, inverted, progress, records, render, search, sketches, temporal, tree
from fathomline.plans import functions
from fathomline.sources import datasource
from fathomline.sources.shared import shared_path
from fathomline.streaming import maintain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
LITERAL = "the theron tion erthan of ofthe"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of short rows that each take long to work on: its few files are dealt out to all tasks, where reading them would make one."""
    return read(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def literal(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(text).alias("text"))


# Term statistics.

TOKENS = f"SELECT doc_id, source, unnest({TOK.format('text')}) AS term FROM documents"
POSTINGS = f"SELECT doc_id, source, term, count(*) AS tf FROM ({TOKENS}) GROUP BY ALL"


@query(f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT term) AS BIGINT) AS n_terms FROM ({TOKENS}) GROUP BY doc_id""")
def tok_counts(spark, sf_dir):
    ts = tokens("text")
    d = read(spark, sf_dir, "documents").select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.size(F.array_distinct(ts)).cast("long").alias("n_terms"))
    return d.filter("n_tokens > 0")


@query(f"""SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM ({TOKENS}) GROUP BY term""")
def doc_freq(spark, sf_dir):
    return index.frequencies(read(spark, sf_dir, "documents")).filter("term IS NOT NULL").select("term", "df")


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total_docs, round(avg(len({TOK.format("text")})), 6) AS avg_doc_length FROM documents""")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(read(spark, sf_dir, "documents")).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@query(f"""SELECT term, CAST(sum(df) AS BIGINT) AS df FROM (SELECT source, term, count(DISTINCT doc_id) AS df FROM ({TOKENS}) GROUP BY ALL) GROUP BY term""")
def incremental_doc_freq(spark, sf_dir):
    parts = index.frequencies(read(spark, sf_dir, "documents"), by=["source"]).filter("term IS NOT NULL")
    return index.merged(parts.select("term", "df"))


@query(f"""SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_index FROM (SELECT DISTINCT term FROM ({TOKENS}))""")
def vocab_index(spark, sf_dir):
    return index.vocabulary(index.token_rows(read(spark, sf_dir, "documents")).select("term").distinct())


WEIGHT = "ln(({n} - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5)"
WEIGHTS = f"""SELECT doc_id, term, {WEIGHT.format(n="(SELECT count(*) FROM documents)")} AS weight FROM ({POSTINGS}) JOIN (SELECT term, count(*) AS df FROM ({POSTINGS}) GROUP BY term) USING (term)"""


@query(f"""SELECT doc_id, term, round(weight, 6) AS weight FROM ({WEIGHTS})""")
def bm25_weights(spark, sf_dir):
    return index.weights(read(spark, sf_dir, "documents"), digits=6)


@query(
    f"""WITH p AS ({POSTINGS}), s AS (SELECT source, term, count(*) AS df FROM p GROUP BY ALL), t AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
    SELECT source, doc_id, term, round({WEIGHT.format(n="n")}, 6) AS weight FROM p JOIN s USING (source, term) JOIN t USING (source)"""
)
def bm25_weights_by_source(spark, sf_dir):
    return index.weights(read(spark, sf_dir, "documents"), by=["source"], digits=6)


STOPPED = ["the", "and", "of", "to", "in"]
STOPPED_SQL = f"SELECT * FROM ({POSTINGS}) WHERE term NOT IN ('the', 'and', 'of', 'to', 'in')"


@query(
    f"""SELECT doc_id, term, round({WEIGHT.format(n="(SELECT count(*) FROM documents)")}, 6) AS weight
    FROM ({STOPPED_SQL}) JOIN (SELECT term, count(*) AS df FROM ({STOPPED_SQL}) GROUP BY term) USING (term)"""
)
def bm25_without_stops(spark, sf_dir):
    return index.weights(read(spark, sf_dir, "documents"), stops=STOPPED, digits=6)


def stored_stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = shared_path(spark, "statistics")
    index.save(read(spark, sf_dir, "documents"), at)
    return index.load(spark, at)


@query(f"""SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, (SELECT CAST(count(*) AS BIGINT) FROM documents) AS total_docs FROM ({TOKENS}) GROUP BY term""")
def stats_round_trip(spark, sf_dir):
    terms, totals = stored_stats(spark, sf_dir)
    return terms.crossJoin(F.broadcast(totals.select("total_docs")))


@query(
    f"""SELECT length(source) AS versions, count(*) AS n_docs, CAST(sum(len({TOK.format("text")})) AS BIGINT) AS n_tokens, true AS terms_close, true AS median_close
    FROM documents GROUP BY length(source)"""
)
def sketch_stats(spark, sf_dir):
    """Statistics of sets of versions from merged sketches of each, and whether distinct terms are within 4 % and the median's rank within 3 % of exact ones."""
    d = read(spark, sf_dir, "documents").select("source", "text", F.length("source").alias("versions"))
    own = sketches.build(d, "source").withColumn("versions", F.length("source"))
    found = sketches.read(sketches.merged(own, ["versions"]))
    n = d.select("versions", F.size(tokens("text")).alias("n")).join(F.broadcast(found.select("versions", "p50")), "versions")
    ranks = n.groupBy("versions").agg(F.avg((F.col("n") <= F.col("p50")).cast("double")).alias("upto"), F.avg((F.col("n") < F.col("p50")).cast("double")).alias("below"))
    terms = index.frequencies(d, by=["versions"]).filter("term IS NOT NULL").groupBy("versions").agg(F.count("*").alias("exact"))
    near = (F.abs(F.col("distinct_terms") - F.col("exact")) <= 0.04 * F.col("exact")).alias("terms_close")
    return found.join(ranks, "versions").join(terms, "versions").select("versions", "n_docs", "n_tokens", near, ((F.col("below") <= 0.53) & (F.col("upto") >= 0.47)).alias("median_close"))


CHANGED_SQL = f"""SELECT unnest(list_distinct({TOK.format("CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, 200) END")})) AS term FROM documents WHERE doc_id % 5 != 1"""


@query(f"""SELECT term, CAST(count(*) AS BIGINT) AS df, (SELECT CAST(count(*) AS BIGINT) FROM documents WHERE doc_id % 5 != 1) AS total_docs FROM ({CHANGED_SQL}) GROUP BY term""")
def stream_term_stats(spark, sf_dir):
    """Statistics after a stream of inserts of shortened texts, whole texts for a third of them, and deletions of a fifth."""
    at, d = shared_path(spark, "changes"), read(spark, sf_dir, "documents")
    change = lambda rows, op, seq, text: rows.select(F.col("doc_id").alias("id"), F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), text.alias("text"))
    steps = [change(d, "upsert", 1, F.substring("text", 1, 200)), change(d.filter("doc_id % 3 = 0"), "upsert", 2, F.col("text")), change(d.filter("doc_id % 5 = 1"), "delete", 3, F.lit(None).cast("string"))]
    for i, rows in enumerate(steps):
        rows.write.mode("append").parquet(f"{at}/in")
        maintain.maintain(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/stats", f"{at}/checkpoint").awaitTermination()
        if i == 1:
            maintain.compact(spark, f"{at}/stats")
    terms, totals = maintain.statistics(spark, f"{at}/stats")
    return terms.crossJoin(F.broadcast(totals.select("total_docs")))


# Search.


def sparse_sql(queries: str, k: int = 10) -> str:
    """SQL of the sparse top-k of queries (query_id, text)."""
    return f"""
        WITH p AS ({POSTINGS}), s AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
        q AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({TOK.format("text")}) AS term FROM ({queries})) GROUP BY ALL),
        wq AS (SELECT query_id, term, {WEIGHT.format(n="n")} AS w FROM q JOIN s USING (term), n),
        wd AS (SELECT doc_id, term, {WEIGHT.format(n="n")} AS w FROM p JOIN s USING (term), n),
        r AS (SELECT query_id, doc_id, round(sum(wq.w * wd.w), 6) AS score FROM wq JOIN wd USING (term) GROUP BY ALL)
        SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM r QUALIFY rank <= {k}"""


BENCH = "SELECT item_id AS query_id, text FROM benchmark"


def dense_sql(queries: str, k: int = 10, where: str = "true") -> str:
    """SQL of the dense top-k of queries (query_id, query)."""
    return f"""
        SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score
              FROM embeddings, ({queries}) WHERE {where})
        QUALIFY rank <= {k}"""


def vector_queries(spark: SparkSession, sf_dir: str, below: int | None = None) -> DataFrame:
    """Queries whose vectors are those of embeddings; `below` is the query set: vectors of the ids under it."""
    e = read(spark, sf_dir, "embeddings")
    return (e if below is None else e.filter(F.col("vec_id") < below)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


QUERY_0 = "SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id = 0"
BENCH_VECTORS = "SELECT item_id AS query_id, embedding AS query FROM benchmark JOIN embeddings ON item_id = vec_id"


@query(sparse_sql(f"SELECT CAST(0 AS BIGINT) AS query_id, '{LITERAL}' AS text"))
def sparse_topk(spark, sf_dir):
    return search.sparse_topk(literal(spark, LITERAL), read(spark, sf_dir, "documents"))


@query(sparse_sql(BENCH))
def sparse_topk_batch(spark, sf_dir):
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = read(spark, sf_dir, "documents")
    return search.sparse_topk(queries, docs)


@query(sparse_sql(BENCH))
def sparse_topk_stored(spark, sf_dir):
    """Search by statistics that were stored before."""
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.sparse_topk(queries, read(spark, sf_dir, "documents"), stats=stored_stats(spark, sf_dir))


@query(sparse_sql(BENCH))
def sparse_topk_indexed(spark, sf_dir):
    """Search of stored postings: the queried terms alone are read."""
    at = shared_path(spark, "postings")
    inverted.build(read(spark, sf_dir, "documents"), at)
    return inverted.Inverted(spark, at).topk(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(dense_sql(QUERY_0))
def dense_topk(spark, sf_dir):
    return search.dense_topk(vector_queries(spark, sf_dir).filter("query_id = 0"), read(spark, sf_dir, "embeddings"))


@query(dense_sql(QUERY_0, where="label = 3"))
def dense_topk_filtered(spark, sf_dir):
    return search.dense_topk(vector_queries(spark, sf_dir).filter("query_id = 0"), read(spark, sf_dir, "embeddings").filter("label = 3"))


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 4, 7) AND vec_id >= 10")
def dense_filter_in(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").filter(F.col("label").isin(1, 4, 7) & (F.col("vec_id") >= 10)).select("vec_id", "label")


@query(dense_sql(BENCH_VECTORS))
def dense_topk_batch(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    queries = read(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.dense_topk(queries, e)


@query(dense_sql(BENCH_VECTORS))
def dense_topk_cells(spark, sf_dir):
    """Search of stored cells of vectors; those that can't hold a better row aren't read."""
    at, e = shared_path(spark, "cells"), read(spark, sf_dir, "embeddings")
    cells.build(e, at)
    queries = read(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    return cells.Cells(spark, at).topk(queries, exact=True)


def fused_sql(sparse: str, dense: str, k: int = 10, boost: float = 0.5) -> str:
    return f"""
        WITH s AS ({sparse}), d AS (SELECT query_id, vec_id AS doc_id, score, rank FROM ({dense})),
        f AS (SELECT query_id, doc_id, s.rank AS sparse_rank, d.rank AS dense_rank, coalesce(s.score, d.score) AS own,
                     coalesce(CAST({boost} AS DOUBLE) / (60 + s.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + d.rank), 0) AS fused
              FROM s FULL JOIN d USING (query_id, doc_id)),
        g AS (SELECT *, round(CASE WHEN count(sparse_rank) OVER (PARTITION BY query_id) = 0 OR count(dense_rank) OVER (PARTITION BY query_id) = 0 THEN own ELSE fused END, 6) AS score FROM f)
        SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sparse_rank NULLS LAST, dense_rank NULLS LAST, doc_id) AS INTEGER) AS rank, sparse_rank, dense_rank
        FROM g QUALIFY rank <= {k}"""


def with_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries (query_id, text, query), documents, and vectors (doc_id, embedding)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return b.join(e.withColumnsRenamed({"doc_id": "query_id", "embedding": "query"}), "query_id", "left"), read(spark, sf_dir, "documents"), e


@query(fused_sql(sparse_sql(f"SELECT CAST(0 AS BIGINT) AS query_id, '{LITERAL}' AS text"), dense_sql(QUERY_0), boost=1.0))
def rrf_fuse(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.filter("doc_id = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.rrf(search.sparse_topk(literal(spark, LITERAL), read(spark, sf_dir, "documents")), search.dense_topk(q, e, id_col="doc_id"), boost=1.0)


@query(fused_sql(sparse_sql(BENCH), dense_sql(BENCH_VECTORS)))
def hybrid_search(spark, sf_dir):
    return search.hybrid(*with_vectors(spark, sf_dir))


@query(fused_sql(sparse_sql("SELECT item_id AS query_id, 'qqqqq zzzzz' AS text FROM benchmark"), dense_sql(BENCH_VECTORS)))
def hybrid_degraded_dense_only(spark, sf_dir):
    q, docs, rows = with_vectors(spark, sf_dir)
    return search.hybrid(q.withColumn("text", F.lit("qqqqq zzzzz")), docs, rows)


@query(
    f"""SELECT CAST(0 AS BIGINT) AS query_id, doc_id, score, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank
    FROM (SELECT vec_id AS doc_id, score, rank FROM ({dense_sql(QUERY_0, 50)})) JOIN documents USING (doc_id)
    WHERE contains(lower(text), 'tion') QUALIFY row_number() OVER (ORDER BY rank) <= 10"""
)
def overfetch_postfilter(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.filter("doc_id = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = search.dense_topk(q, e, search.fetch_size("tion", 10), "doc_id").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return search.overfetched(hits, "TION", ["text"], 10).select("query_id", "doc_id", "score", "rank")


@query(
    """SELECT doc_id, score, label, quality FROM (SELECT vec_id AS doc_id, score FROM (%s)) JOIN embeddings ON vec_id = doc_id LEFT JOIN labels USING (doc_id)"""
    % dense_sql(QUERY_0, 50)
)
def label_quality_join(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    hits = search.dense_topk(vector_queries(spark, sf_dir).filter("query_id = 0"), e, 50).select(F.col("vec_id").alias("doc_id"), "score")
    d = hits.join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return d.join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "score", "label", "quality")


@query(
    """SELECT query_id, doc_id, CAST(rank AS VARCHAR) || '. ' || source || ' - ' ||
        CASE WHEN length(t) > 150 THEN substr(t, 1, 150) || '...' ELSE t END AS line
    FROM (SELECT query_id, vec_id AS doc_id, rank FROM (%s)) JOIN (SELECT doc_id, source, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS t FROM documents) USING (doc_id)"""
    % dense_sql(QUERY_0, 20)
)
def render_hits(spark, sf_dir):
    hits = search.dense_topk(vector_queries(spark, sf_dir).filter("query_id = 0"), read(spark, sf_dir, "embeddings"), 20).withColumnRenamed("vec_id", "doc_id")
    return render.hits(hits.join(read(spark, sf_dir, "documents"), "doc_id"), "source").select("query_id", "doc_id", "line")


@query(f"""SELECT query_id, max(score) < 0.999 AS inexact FROM ({dense_sql(BENCH_VECTORS)}) GROUP BY query_id""")
def inexact_hits(spark, sf_dir):
    return render.inexact(dense_topk_batch(spark, sf_dir))


# Elements. part stands in: its type is the parent, its name the element's.

KINDS_SQL = """CASE p_size % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'type' WHEN 2 THEN 'method' WHEN 3 THEN 'property' WHEN 4 THEN 'constructor' ELSE 'enum' END"""
PARTS_SQL = f"""SELECT p_partkey AS seq, {KINDS_SQL} AS element_type, p_name AS element_name, p_brand AS element_name_en, p_type AS parent_type,
    '/' || p_brand || CASE p_size % 7 WHEN 0 THEN '/methods/m.html' WHEN 1 THEN '/Properties/p.html' WHEN 2 THEN '/ctors/c.html' WHEN 3 THEN '/objects/o.html'
        WHEN 4 THEN '/events/e.html' WHEN 5 THEN '/global/g.html' ELSE '/x.html' END AS path FROM part"""
FULL_SQL = "CASE WHEN element_type = 'constructor' THEN 'Новый ' || parent_type ELSE parent_type || '.' || element_name END"
ELEMENTS_SQL = f"SELECT *, {FULL_SQL} AS full_name, CAST(('0x' || substr(md5('8.3.26_' || element_type || '_' || {FULL_SQL}), 1, 15)) AS BIGINT) AS id FROM ({PARTS_SQL})"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kind = F.expr(KINDS_SQL)
    paths = {0: "/methods/m.html", 1: "/Properties/p.html", 2: "/ctors/c.html", 3: "/objects/o.html", 4: "/events/e.html", 5: "/global/g.html"}
    end = F.lit("/x.html")
    for n, e in paths.items():
        end = F.when(F.col("p_size") % 7 == n, e).otherwise(end)
    d = p.select(
        F.col("p_partkey").alias("seq"), kind.alias("element_type"), F.col("p_name").alias("element_name"), F.col("p_brand").alias("element_name_en"), F.col("p_type").alias("parent_type"),
        F.concat(F.lit("/"), "p_brand", end).alias("path"),
    )
    d = d.withColumn("full_name", ids.full_name("element_type", "element_name", "parent_type"))
    return d.withColumn("id", ids.element_key(ids.original_id(F.lit("8.3.26"), "element_type", "full_name")))


@query(f"""SELECT seq, element_type || '_' || parent_type || '_' || element_name AS element_id, '8.3.26_' || element_type || '_' || full_name AS original_id, id FROM ({ELEMENTS_SQL})""")
def element_ids(spark, sf_dir):
    return parts(spark, sf_dir).select(
        "seq", ids.build_id("element_type", "parent_type", "element_name").alias("element_id"), ids.original_id(F.lit("8.3.26"), "element_type", "full_name").alias("original_id"), "id"
    )


@query(
    f"""WITH e AS (SELECT seq, element_type || '_' || replace(parent_type, ' ', '_') || '_' || element_name AS element_id FROM ({PARTS_SQL})),
    s AS (SELECT seq, split_part(element_id, '_', 1) AS element_type, substr(element_id, strpos(element_id, '_') + 1) AS rest FROM e)
    SELECT seq, element_type,
        CASE WHEN element_type IN ('method', 'property', 'constructor') THEN regexp_extract(rest, '^(.*)_([^_]*)$', 1) END AS parent_type,
        CASE WHEN element_type IN ('method', 'property', 'constructor') THEN regexp_extract(rest, '^(.*)_([^_]*)$', 2) ELSE rest END AS element_name FROM s"""
)
def element_id_parse(spark, sf_dir):
    d = parts(spark, sf_dir).select("seq", ids.build_id("element_type", F.replace("parent_type", F.lit(" "), F.lit("_")), "element_name").alias("element_id"))
    return d.select("seq", ids.parse_id("element_id").alias("p")).select("seq", "p.*")


@query(
    f"""SELECT seq, element_name || ' ' || element_name_en || ' ' || full_name || ' ' || path ||
        CASE WHEN element_type = 'method' THEN ' ' || element_name || '()' ELSE '' END AS search_text FROM ({ELEMENTS_SQL})"""
)
def search_text(spark, sf_dir):
    return parts(spark, sf_dir).select(
        "seq", ids.search_text("element_type", "element_name", "element_name_en", "full_name", "path", F.concat("element_name", F.lit("()"))).alias("search_text")
    )


PRIORITY_SQL = """CASE WHEN coalesce(path, '') = '' THEN 0 WHEN contains(lower(path), '/methods/') THEN 10 WHEN contains(lower(path), '/properties/') THEN 9
    WHEN contains(lower(path), '/constructors/') OR contains(lower(path), '/ctors/') THEN 8
    WHEN contains(lower(path), '/object') AND NOT contains(lower(path), '/events/') THEN 5 WHEN contains(lower(path), '/events/') THEN 2
    WHEN contains(lower(path), '/functions/') OR contains(lower(path), '/global') THEN 3 ELSE 1 END"""


@query(f"""SELECT seq, path, {PRIORITY_SQL} AS priority FROM ({PARTS_SQL})""")
def source_priority(spark, sf_dir):
    return parts(spark, sf_dir).select("seq", "path", ids.source_priority("path").alias("priority"))


@query(f"""SELECT id, seq, path FROM ({ELEMENTS_SQL}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY {PRIORITY_SQL} DESC, seq) = 1""")
def dedup_best_source(spark, sf_dir):
    return elements.best_source(parts(spark, sf_dir)).select("id", "seq", "path")


NAME_SQL = "(SELECT min(p_name) FROM part)"


def first_name(spark: SparkSession, sf_dir: str) -> str:
    return read(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]


@query(f"""SELECT seq, element_type, full_name FROM ({ELEMENTS_SQL}) WHERE element_name = {NAME_SQL} AND element_type = 'method'""")
def lookup_exact(spark, sf_dir):
    return elements.where(parts(spark, sf_dir), ["method"], element_name=first_name(spark, sf_dir)).select("seq", "element_type", "full_name")


@query(f"""SELECT seq, element_type, full_name FROM ({ELEMENTS_SQL}) WHERE full_name = (SELECT min(p_type || '.' || p_name) FROM part) AND element_type IN ('method', 'property', 'function')""")
def lookup_full_name(spark, sf_dir):
    full = read(spark, sf_dir, "part").agg(F.min(F.concat("p_type", F.lit("."), "p_name"))).first()[0]
    return elements.where(parts(spark, sf_dir), ["method", "property", "function"], full_name=full).select("seq", "element_type", "full_name")


@query(
    f"""SELECT seq, CAST(0.9 AS DOUBLE) AS score FROM ({ELEMENTS_SQL})
    WHERE contains(lower(element_name), 'an') OR contains(lower(element_name_en), 'an') OR contains(lower(full_name), 'an')"""
)
def lookup_scan_fallback(spark, sf_dir):
    return parts(spark, sf_dir).filter(elements.named_like("AN")).select("seq", F.lit(0.9).cast("double").alias("score"))


@query(f"""SELECT seq, CAST(1 AS DOUBLE) AS score, 1 AS stage FROM ({ELEMENTS_SQL}) WHERE element_name = {NAME_SQL} ORDER BY seq LIMIT 10""")
def lookup_cascade(spark, sf_dir):
    return elements.cascade(parts(spark, sf_dir), first_name(spark, sf_dir), id_col="seq")


@query(f"""SELECT seq, CAST(1 AS DOUBLE) AS score, 2 AS stage FROM ({ELEMENTS_SQL}) WHERE full_name = (SELECT max(p_type || '.' || p_name) FROM part WHERE p_size % 6 != 4) ORDER BY seq LIMIT 10""")
def cascade_full_name(spark, sf_dir):
    """A query with a dot that is no element's name: the second stage."""
    full = read(spark, sf_dir, "part").filter("p_size % 6 != 4").agg(F.max(F.concat("p_type", F.lit("."), "p_name"))).first()[0]
    return elements.cascade(parts(spark, sf_dir), full, id_col="seq")


@query(
    f"""SELECT seq, score, 3 AS stage FROM ({ELEMENTS_SQL}) JOIN (SELECT vec_id AS seq, score, rank FROM ({dense_sql(QUERY_0, 50)})) USING (seq)
    WHERE contains(lower(element_name), 'an') OR contains(lower(element_name_en), 'an') OR contains(lower(full_name), 'an') ORDER BY rank LIMIT 10"""
)
def cascade_dense(spark, sf_dir):
    """A part of names that is no name: the nearest elements with it, the third stage."""
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "seq")
    near = search.dense_topk(vector_queries(spark, sf_dir).filter("query_id = 0"), e, search.fetch_size("an", 10), "seq")
    return elements.cascade(parts(spark, sf_dir), "an", near.select("seq", "score", "rank"), id_col="seq")


@query(
    f"""SELECT seq, CAST(0.9 AS DOUBLE) AS score, 4 AS stage FROM ({ELEMENTS_SQL})
    WHERE contains(lower(element_name), 'an') OR contains(lower(element_name_en), 'an') OR contains(lower(full_name), 'an') ORDER BY seq LIMIT 10"""
)
def cascade_scan(spark, sf_dir):
    """The same without near elements: the last stage, over all elements."""
    none = spark.createDataFrame([], "seq long, score double, rank int")
    return elements.cascade(parts(spark, sf_dir), "an", none, id_col="seq")


@query(f"""SELECT parent_type, seq, element_type FROM ({ELEMENTS_SQL}) WHERE seq > (SELECT max(p_partkey) // 2 FROM part) ORDER BY seq LIMIT 100""")
def scroll_page(spark, sf_dir):
    """A page of a scroll: the 100 elements behind an id."""
    half = read(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] // 2
    return elements.by_id(parts(spark, sf_dir), 100, "seq", half).select("parent_type", "seq", "element_type")


@query(
    f"""SELECT element_name, seq, element_type FROM ({ELEMENTS_SQL}) QUALIFY row_number() OVER (PARTITION BY element_name ORDER BY
        CASE element_type WHEN 'property' THEN 5 WHEN 'method' THEN 4 WHEN 'constructor' THEN 3 WHEN 'function' THEN 2 WHEN 'type' THEN 1 ELSE 0 END DESC, seq) = 1"""
)
def best_type_pick(spark, sf_dir):
    return elements.best_of(parts(spark, sf_dir), "seq", ["element_name"]).select("element_name", "seq", "element_type")


@query(
    f"""SELECT seq, element_type, element_name, CASE element_type WHEN 'constructor' THEN 0 WHEN 'method' THEN 1 ELSE 2 END AS place
    FROM (SELECT * FROM ({ELEMENTS_SQL}) WHERE parent_type = (SELECT min(p_type) FROM part) AND element_type IN ('constructor', 'method', 'property'))"""
)
def type_members(spark, sf_dir):
    kind = read(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return elements.members(parts(spark, sf_dir), kind, id_col="seq").select("seq", "element_type", "element_name", "place")


@query(f"""SELECT parent_type, element_type, count(*) AS n FROM ({PARTS_SQL}) GROUP BY ALL""")
def type_member_counts(spark, sf_dir):
    return elements.member_counts(parts(spark, sf_dir))


@query("""SELECT r_name AS parent_type, CAST(count(*) AS BIGINT) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def members_listed(spark, sf_dir):
    d = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy(F.col("r_name").alias("parent_type")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("members"))


@query(
    """WITH RECURSIVE t AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(-1 AS BIGINT) AS parent_id FROM region
        UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation),
    w AS (SELECT id, parent_id, 0 AS level, CAST(id AS VARCHAR) AS path FROM t WHERE parent_id = -1
        UNION ALL SELECT t.id, t.parent_id, level + 1, path || '/' || t.id FROM t JOIN w ON t.parent_id = w.id)
    SELECT * FROM w"""
)
def toc_tree(spark, sf_dir):
    from fathomline.sources.archive import toc_paths

    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(-1).cast("long").alias("parent_id"))
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"))
    return toc_paths(r.unionByName(n), root=-1)


@query(
    f"""SELECT parent_type || '|' || element_type AS parent, CAST(sum(pos) AS BIGINT) AS pos_sum, count(*) AS n FROM (
        SELECT parent_type, element_type, element_name, row_number() OVER (PARTITION BY parent_type, element_type ORDER BY element_name) - 1 AS pos
        FROM (SELECT DISTINCT parent_type, element_type, element_name FROM ({PARTS_SQL}) WHERE element_type IN ('method', 'property'))) GROUP BY ALL"""
)
def normalize_explode(spark, sf_dir):
    # Distinct names of a type; a page has them as arrays.
    names = lambda k: F.array_sort(F.collect_set(F.when(F.col("element_type") == k, F.struct(F.col("element_name").alias("name"), F.lit("").alias("description"))))).alias(k)
    pages = parts(spark, sf_dir).groupBy(F.col("parent_type").alias("path")).agg(names("method"), names("property"))
    flat = elements.flattened(pages, {"method": "method", "property": "property"})
    return flat.groupBy(F.concat_ws("|", "path", "element_type").alias("parent")).agg(F.sum("pos").cast("long").alias("pos_sum"), F.count("*").alias("n"))


# Versions and catalogue.

RAW_SQL = """SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN '8.3.' || n_nationkey WHEN 1 THEN ' 8_3_' || n_nationkey || ' ' WHEN 2 THEN '8.' || n_nationkey
    WHEN 3 THEN '8.' || n_regionkey || '.' || n_nationkey || '.1467' ELSE 'abc' END AS raw FROM nation"""
NORMAL_SQL = r"nullif(regexp_extract(replace(trim(raw), '_', '.'), '^(\d+\.\d+\.\d+[^.]*)', 1), '')"
VERSIONS_SQL = f"SELECT DISTINCT version FROM (SELECT {NORMAL_SQL} AS version FROM ({RAW_SQL})) WHERE version IS NOT NULL"
KEY_SQL = "list_transform(string_split(version, '.'), lambda x: TRY_CAST(x AS INTEGER))"


def raw_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    m = F.col("n_nationkey") % 5
    raw = F.when(m == 0, F.concat(F.lit("8.3."), k)).when(m == 1, F.concat(F.lit(" 8_3_"), k, F.lit(" "))).when(m == 2, F.concat(F.lit("8."), k))
    raw = raw.when(m == 3, F.concat(F.lit("8."), r, F.lit("."), k, F.lit(".1467"))).otherwise("abc")
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), raw.alias("raw"))


def known_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_versions(spark, sf_dir).select(versions.normalized("raw").alias("version")).filter("version IS NOT NULL").distinct()


@query(f"""SELECT k, {NORMAL_SQL} AS version, 'help_' || replace({NORMAL_SQL}, '.', '_') AS collection FROM ({RAW_SQL})""")
def version_normalize(spark, sf_dir):
    return raw_versions(spark, sf_dir).select("k", versions.normalized("raw").alias("version")).withColumn("collection", versions.collection_name("version"))


@query(f"""SELECT version FROM ({VERSIONS_SQL}) ORDER BY {KEY_SQL} DESC LIMIT 1""")
def version_latest(spark, sf_dir):
    return versions.latest(known_versions(spark, sf_dir))


@query(f"""SELECT version FROM ({VERSIONS_SQL}) WHERE version = '8.3' OR starts_with(version, '8.3.') ORDER BY {KEY_SQL} DESC LIMIT 1""")
def version_prefix(spark, sf_dir):
    return versions.of_prefix(known_versions(spark, sf_dir), "8.3")


@query(f"""SELECT version, CAST(row_number() OVER (ORDER BY {KEY_SQL} DESC, version) AS INTEGER) AS place FROM ({VERSIONS_SQL})""")
def version_order(spark, sf_dir):
    w = Window.orderBy(F.desc(versions.sort_key("version")), F.col("version"))  # a row a version of the catalogue
    return known_versions(spark, sf_dir).withColumn("place", F.row_number().over(w))


@query(f"""SELECT k, coalesce(v.version, (SELECT version FROM ({VERSIONS_SQL}) ORDER BY {KEY_SQL} DESC LIMIT 1)) AS version
    FROM (SELECT k, {NORMAL_SQL} AS asked FROM ({RAW_SQL})) LEFT JOIN ({VERSIONS_SQL}) v ON asked = v.version""")
def version_resolve(spark, sf_dir):
    known = known_versions(spark, sf_dir)
    asked = raw_versions(spark, sf_dir).select("k", versions.resolved(known, ["raw"]).alias("asked"))
    found = asked.join(known, asked["asked"] == known["version"], "left").crossJoin(F.broadcast(versions.latest(known).withColumnRenamed("version", "latest")))
    return found.select("k", F.coalesce("version", "latest").alias("version"))


@query(
    """SELECT version, coalesce(points_count, 0) AS points_count, points_count IS NOT NULL AS indexed FROM (SELECT DISTINCT source AS version FROM documents)
    LEFT JOIN (SELECT source AS version, count(*) AS points_count FROM documents JOIN embeddings ON doc_id = vec_id WHERE label < 2 GROUP BY source) USING (version)"""
)
def catalog_status(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("version"))
    own = docs.join(read(spark, sf_dir, "embeddings").filter("label < 2"), F.col("doc_id") == F.col("vec_id")).groupBy("version").agg(F.count("*").alias("points_count"))
    return catalog.status(docs.select("version").distinct(), own)


@query("""SELECT DISTINCT source AS version FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)""")
def not_indexed(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("version"))
    there = docs.join(read(spark, sf_dir, "labels").filter("toxic = 1 AND quality = 0"), "doc_id").select("version").distinct()
    return catalog.not_indexed(docs.select("version").distinct(), there)


@query("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def upsert_last_wins(spark, sf_dir):
    return catalog.last_wins(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


# Pages.

TEXT_SQL = r"regexp_replace({0}, '(?s)<[^>]*>', '', 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    TEXT_SQL = f"replace({TEXT_SQL}, '{_name}', '{_char}')"
H1_SQL = r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)"


@query(f"""SELECT page_id, trim({TEXT_SQL.format(H1_SQL)}) AS title FROM pages""")
def page_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", extract.title("html").alias("title"))


LINK_SQL = r"""(?is)<a\b[^>]*\bhref\s*=\s*["''']([^"''']*)["'''][^>]*>(.*?)</a\s*>""".replace("'''", "''")


@query(
    f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, href, trim({TEXT_SQL.format("t")}) AS text FROM (
        SELECT page_id, unnest(range(0, len(h))) AS pos, unnest(h) AS href, unnest(t) AS t FROM (
            SELECT page_id, regexp_extract_all(html, '{LINK_SQL}', 1) AS h, regexp_extract_all(html, '{LINK_SQL}', 2) AS t FROM pages))"""
)
def page_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(extract.links("html")).alias("pos", "l")).select("page_id", "pos", "l.href", "l.text")


@query(
    rf"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>', 1), lambda x: trim({TEXT_SQL.format("x")})), '|') AS sections FROM pages"""
)
def page_sections(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(extract.sections("html"), "|").alias("sections"))


PATH_SQL = "url || CASE page_id % 6 WHEN 0 THEN '/methods/m.html' WHEN 1 THEN '/ctors/c.html' WHEN 2 THEN '/properties/p.html' WHEN 3 THEN '/enums/e.html' WHEN 4 THEN '/objects/o.html' ELSE '/style/x.html' END"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ("/methods/m.html", "/ctors/c.html", "/properties/p.html", "/enums/e.html", "/objects/o.html")
    end = F.lit("/style/x.html")
    for n, e in enumerate(ends):
        end = F.when(F.col("page_id") % 6 == n, e).otherwise(end)
    return read(spark, sf_dir, "pages").withColumn("path", F.concat("url", end))


def _any(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


@query(
    f"""SELECT page_id, CASE WHEN contains(path, '/methods/') THEN 'function' WHEN contains(path, '/ctors/') THEN 'constructor' WHEN contains(path, '/properties/') THEN 'property'
        WHEN contains(path, '/enums/') THEN 'enum' WHEN contains(path, '/objects/') AND NOT contains(path, '/events/') THEN 'object'
        WHEN {_any("html", extract.OBJECT_LABELS)} THEN 'object' WHEN {_any("html", extract.ENUM_LABELS)} THEN 'enum' WHEN {_any("html", extract.FUNCTION_LABELS)} THEN 'function'
        WHEN {_any("title", extract.INDEX_LABELS)} THEN 'index' ELSE 'unknown' END AS type
    FROM (SELECT page_id, html, {PATH_SQL} AS path, {H1_SQL} AS title FROM pages)"""
)
def page_type(spark, sf_dir):
    d = page_paths(spark, sf_dir).select("page_id", "path", "html", extract.title("html").alias("title"))
    return d.select("page_id", extract.page_type("path", "title", "html").alias("type"))


BODY_SQL = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"


@query(rf"""SELECT page_id, md5({TEXT_SQL.format(BODY_SQL)}) AS text_md5 FROM pages""")
def page_content(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(extract.without_tags("html", "")).alias("text_md5"))


@query(
    f"""SELECT page_id, ends_with(path, '.html') AND NOT {_any("lower(path)", EXCLUDED_NAMES)}
        AND {_any("lower(path)", PAGE_PATHS)} AS is_page
    FROM (SELECT page_id, {PATH_SQL} AS path FROM pages)"""
)
def filename_filter(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", is_page_name("path").alias("is_page"))


@query(
    f"""SELECT doc_id, NOT {_any("lower(text)", EXCLUDED_CONTENT)}
        AND {_any("lower(text)", PAGE_CONTENT)} AS is_help FROM documents"""
)
def content_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", is_page_content("text").alias("is_help"))


@query("""SELECT doc_id, array_to_string(list_distinct_in_order, '|') AS related FROM (
    SELECT doc_id, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(a) AS x, unnest(range(0, len(a))) AS i) GROUP BY x ORDER BY i LIMIT 10)) AS list_distinct_in_order
    FROM (SELECT doc_id, list_concat(regexp_extract_all(text, '[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]*\\.[А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]*'),
        list_filter(regexp_extract_all(text, '([А-Яа-яA-Za-z][А-Яа-яA-Za-z0-9]*)\\s*\\(', 1), lambda n: length(n) > 2 AND regexp_matches(n, '^\\p{Lu}'))) AS a FROM documents)
    WHERE len(a) > 0)""".replace("\\\\", "\\"))
def related_elements(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", extract.related("text", F.lit("")).alias("r"))
    return d.filter(F.size("r") > 0).select("doc_id", F.array_join("r", "|").alias("related"))


PART_SQL = """SELECT p_partkey AS k, p_name, p_brand, p_size, p_type, CAST(p_partkey AS VARCHAR) AS n, CAST(p_size AS VARCHAR) AS size,
    CASE WHEN p_size % 3 = 0 THEN 'Deprecated since version 8.3.' ELSE 'Available since version 8.3.' END AS since FROM part"""


def member_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, title, content): a page of documentation for each part, with labelled sections in both languages by turns."""
    p, t = dealt(spark, sf_dir, "part", "p_partkey"), lambda ru, en: F.when(F.col("p_partkey") % 2 == 0, ru).otherwise(en)
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    content = say(
        t("Синтаксис:", "Syntax:"), " Method", n, "(Value)\n\n", t("Описание:", "Description:"), " Takes the part ", name, " of ", brand, ".\n\n", t("Параметры:", "Parameters:"), "\n<Value> (", brand, ") - what is taken",
        F.when(F.col("p_size") % 2 == 0, ", optional").otherwise(""), "\nSize (Number) - how large. ", t("По умолчанию: ", "Default: "), size, ".\n\n", t("Значения:", "Values:"), "\nFirst: ", name, "\n2nd: ", brand, "\n\n",
        t("Возвращаемое значение:", "Return value:"), " Number - index of ", kind, "\n\n", t("Доступность:", "Availability:"), " Server, ", brand, ".\n", t("Примечание:", "Note:"), " see ", name, "\n",
        F.when(F.col("p_size") % 3 == 0, "Deprecated since version 8.3.").otherwise("Available since version 8.3."), size,
    )
    return p.select(F.col("p_partkey").alias("k"), say("Массив.Метод", n, " (Array.Method", n, ")").alias("title"), content.alias("content"))


@query(
    f"""SELECT k, 'Takes the part ' || p_name || ' of ' || p_brand || '.' AS description, 'see ' || p_name || ' ' || since || size AS notes, 'Server, ' || p_brand AS availability,
        '8.3.' || size AS since, p_size % 3 = 0 AS deprecated, CASE WHEN p_size % 3 = 0 THEN '8.3.' || size ELSE '' END AS deprecated_since, 'Number' AS return_type,
        'index of ' || p_type AS return_text, 'Метод' || n AS name, 'Method' || n AS name_en, 'Массив' AS parent, 'Method' || n || '(Value)' AS signature FROM ({PART_SQL})"""
)
def page_fields(spark, sf_dir):
    v, r, en = F.col("v"), F.col("r"), F.col("en")
    d = member_pages(spark, sf_dir).withColumn("cut", extract.labelled("content"))
    d = d.select("k", "title", "content", "cut", extract.version_info("content").alias("v"), extract.returned("content", "cut").alias("r"), extract.english_name("title").alias("en"))
    return d.select(
        "k", extract.description("content", "cut").alias("description"), extract.notes("content", "cut").alias("notes"), extract.availability("content", "cut").alias("availability"), v["since"].alias("since"),
        v["deprecated"].alias("deprecated"), v["deprecated_since"].alias("deprecated_since"), r["type"].alias("return_type"), r["description"].alias("return_text"),
        extract.function_name("title").alias("name"), en.alias("name_en"), extract.parent_name("title").alias("parent"), extract.signature("content", en).alias("signature"),
    )


@query(
    f"""SELECT k, 'Value' AS name, p_brand AS type, 'what is taken' || CASE WHEN p_size % 2 = 0 THEN ', optional' ELSE '' END AS description, p_size % 2 != 0 AS required, CAST(NULL AS VARCHAR) AS default_value FROM ({PART_SQL})
    UNION ALL SELECT k, 'Size', 'Number', 'how large. ' || CASE WHEN k % 2 = 0 THEN 'По умолчанию: ' ELSE 'Default: ' END || size || '.', false, size FROM ({PART_SQL})"""
)
def page_parameters(spark, sf_dir):
    return member_pages(spark, sf_dir).select("k", F.inline(extract.parameters("content"))).select("k", "name", "type", "description", "required", "default_value")


@query(f"""SELECT k, 'First' AS name, p_name AS description FROM ({PART_SQL}) UNION ALL SELECT k, '2nd', p_brand FROM ({PART_SQL})""")
def enum_values(spark, sf_dir):
    return member_pages(spark, sf_dir).select("k", F.inline(extract.enum_values("content")))


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, path, html): a page of a method, a constructor or a property for each part, by turns."""
    n, say = F.col("p_partkey").cast("string"), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    kind = lambda *of: F.when(F.col("p_partkey") % 3 == 0, say(*of[0])).when(F.col("p_partkey") % 3 == 1, say(*of[1])).otherwise(say(*of[2]))
    chapter = '<p class="V8SH_chapter">'
    path = kind(["/objects/a/methods/m.html"], ["/objects/a/ctors/c.html"], ["/objects/a/properties/p.html"])
    title = kind(["Массив.Метод", n, " (Array.Method", n, ")"], ["По размеру"], ["Форма.Поле", n, " (Form.Field", n, ")"])
    body = kind(
        [f"{chapter}Синтаксис:</p>Метод", n, f"(&lt;Value&gt;) gives it{chapter}Параметры:</p><div class='V8SH_rubric'>&lt;Value&gt; (необязательный)</div>Тип: <a href='x'>", F.col("p_brand"), "</a>. What is taken."],
        [f"{chapter}Синтаксис:</p>Новый Массив", n, "(&lt;Size&gt;)<hr>"],
        [f"{chapter}Тип:</p><a href='x'>", F.col("p_brand"), "</a>. ", F.when(F.col("p_size") % 2 == 0, "Только чтение.").otherwise("")],
    )
    return dealt(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("seq"), path.alias("path"), say("<html><body><h1>", title, "</h1>", body, "</body></html>").alias("html"))


@query(
    """SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'constructor' ELSE 'property' END AS element_type,
        CASE p_partkey % 3 WHEN 0 THEN 'Метод' || p_partkey WHEN 1 THEN 'Новый' ELSE 'Поле' || p_partkey END AS element_name,
        CASE p_partkey % 3 WHEN 0 THEN 'Method' || p_partkey WHEN 1 THEN '' ELSE 'Field' || p_partkey END AS element_name_en,
        CASE p_partkey % 3 WHEN 0 THEN 'Массив' WHEN 1 THEN 'Массив' || p_partkey ELSE 'Форма' END AS parent_type,
        CASE p_partkey % 3 WHEN 0 THEN 'Метод' || p_partkey || '(<Value>)' WHEN 1 THEN 'Новый Массив' || p_partkey || '(<Size>)' END AS signature,
        CASE p_partkey % 3 WHEN 0 THEN 'Value:' || p_brand || ':false' WHEN 1 THEN '' END AS parameters,
        CASE WHEN p_partkey % 3 = 2 THEN p_brand END AS property_type, CASE WHEN p_partkey % 3 = 2 THEN p_size % 2 = 0 END AS read_only FROM part"""
)
def page_records(spark, sf_dir):
    shown = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string"))), ",").alias("parameters")
    kind = F.when(F.col("element_type") == "property", F.col("return_type")).alias("property_type")
    return records.records(marked_pages(spark, sf_dir)).select(F.col("seq").alias("k"), "element_type", "element_name", "element_name_en", "parent_type", "signature", shown, kind, "read_only")


@query(
    """SELECT k, kind AS element_type, CASE kind WHEN 'type' THEN 'Тип' || k WHEN 'method' THEN 'Найти' || k WHEN 'link' THEN 'Сортировать' ELSE 'Длина' END AS element_name,
        CASE kind WHEN 'type' THEN 'Type' || k WHEN 'method' THEN 'Find' || k WHEN 'link' THEN 'Sort' ELSE 'Length' END AS element_name_en, CASE WHEN kind != 'type' THEN 'Тип' || k END AS parent_type,
        CASE kind WHEN 'method' THEN 'takes ' || n_name WHEN 'link' THEN '' WHEN 'property' THEN 'Тип: Число. Только чтение' END AS said
    FROM (SELECT n_nationkey AS k, n_name, unnest(['type', 'method', 'link', 'property']) AS kind FROM nation)""".replace("SELECT k, kind AS", "SELECT k, CASE kind WHEN 'link' THEN 'method' ELSE kind END AS")
)
def page_members(spark, sf_dir):
    k, say = F.col("n_nationkey").cast("string"), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    html = say("<h1>Тип", k, " (Type", k, ")</h1>\n\nМетоды:\nНайти", k, " (Find", k, ") - takes ", F.col("n_name"), "\n\nСвойства:\nДлина (Length) - Тип: Число. Только чтение\n\n<a href='x/methods/s.html'>Сортировать (Sort)</a>")
    pages = read(spark, sf_dir, "nation").select(F.lit("/objects/o.html").alias("path"), html.alias("html"), F.col("n_nationkey").alias("seq"))
    said = F.when(F.col("element_type") != "type", F.col("description")).alias("said")
    return records.items(pages).select(F.col("seq").alias("k"), "element_type", "element_name", "element_name_en", "parent_type", said)


@query("""SELECT page_id, CASE WHEN contains(p, '/objects/') THEN 'Object' WHEN contains(p, '/enums/') THEN 'Enum' ELSE 'Unknown' END AS category FROM (SELECT page_id, %s AS p FROM pages)""" % PATH_SQL)
def page_category(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", extract.category("path").alias("category"))


@query(rf"""SELECT page_id, concat_ws(chr(10) || chr(10), nullif(trim({TEXT_SQL.format(H1_SQL)}), ''), nullif(url, '')) AS text FROM pages""")
def page_index_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", extract.index_text(extract.title("html"), "url").alias("text"))


@query(
    """SELECT '8.3.' || page_id % 5 AS version, page_id || '.html' AS path, md5(coalesce(html, '')) AS html_md5, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size
    FROM pages WHERE page_id % 5 IN (1, 3) AND starts_with(CAST(page_id AS VARCHAR), '1')"""
)
def archive_files(spark, sf_dir):
    """Pages written to archive files by the archive source, and those of two versions and some paths read back: other files aren't opened."""
    datasource.register(spark)
    at, n = shared_path(spark, "archives"), F.col("page_id")
    rows = read(spark, sf_dir, "pages").select(F.format_string("8.3.%d/a%d_ru.hbk", n % 5, F.floor(n / 5) % 4).alias("archive"), F.concat(n.cast("string"), F.lit(".html")).alias("path"), "html")
    rows.repartition(8, "archive").sortWithinPartitions("archive", "path").write.format(datasource.NAME).mode("append").save(at)
    d = spark.read.format(datasource.NAME).option("path", at).option("onlyHelp", "false").load()
    d = d.filter(F.col("version").isin("8.3.1", "8.3.3") & F.col("path").startswith("1"))
    return d.select("version", "path", F.md5("html").alias("html_md5"), "size")


@query("""SELECT page_id, url AS path, md5(html) AS html_md5 FROM pages""")
def archive_round_trip(spark, sf_dir):
    """Pages written to archives and read back by the archive source."""
    import io
    import zipfile

    from fathomline.sources.archive import container

    at = shared_path(spark, "archives")
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")

    def pack(batches):
        import pandas as pd

        for batch in batches:
            for k in range(0, len(batch), 200):
                body = io.BytesIO()
                with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                    for p, u, h in batch.iloc[k : k + 200].itertuples(index=False):
                        z.writestr(zipfile.ZipInfo(f"{p}|{u}"), (h or "").encode())
                yield pd.DataFrame({"content": [container({"FileStorage": body.getvalue()})]})

    pages.mapInPandas(pack, "content binary").write.parquet(at)
    # The source reads files; here the archives are rows of a table, so its parser is applied to them.
    from fathomline.sources.archive import pages as parsed

    def unpack(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame([(*name.split("|", 1), html) for name, html in parsed(content, only_help=False)], columns=["page_id", "path", "html"])

    found = spark.read.parquet(at).mapInPandas(unpack, "page_id string, path string, html string")
    return found.select(F.col("page_id").cast("long").alias("page_id"), "path", F.md5("html").alias("html_md5"))


# Hygiene and progress.


@query("""SELECT 'documents' AS corpus, CAST(count(*) AS BIGINT) AS n FROM documents WHERE length(trim(text)) > 0 UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE length(trim(text)) > 0""")
def corpus_filter(spark, sf_dir):
    n = lambda t: read(spark, sf_dir, t).filter(not_blank("text")).agg(F.count("*").alias("n")).select(F.lit(t).alias("corpus"), "n")
    return n("documents").unionByName(n("conversations"))


@query(
    """SELECT conv_id, turn, tokens, total, CAST(floor(total / 2000.0 * 100) AS BIGINT) AS pct,
        CASE WHEN floor(total / 2000.0 * 100) >= 85 THEN 'critical' WHEN floor(total / 2000.0 * 100) >= 70 THEN 'warn' ELSE 'ok' END AS level
    FROM (SELECT conv_id, turn, CAST(length(text) // 4 AS BIGINT) AS tokens, CAST(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM conversations)"""
)
def token_budget(spark, sf_dir):
    return hygiene.token_budget(read(spark, sf_dir, "conversations"), most=2000).select("conv_id", "turn", "tokens", "total", "pct", "level")


MAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
SANITIZED_SQL = (
    rf"regexp_replace(regexp_replace(regexp_replace(text, '{MAIL_SQL}', 'user@example.com', 'g'), '(?i)(password|passwd|secret|token)([ \t\n\r\f\v]*[:=][ \t\n\r\f\v]*)[^ \t\n\r\f\v,;]+', '\1\2REDACTED', 'g'), '\b[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}\b', '0.0.0.0', 'g')"
)


@query(f"""SELECT doc_id, md5({SANITIZED_SQL}) AS text_md5 FROM documents""")
def sanitize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(hygiene.sanitized("text", hygiene.RULES[:3])).alias("text_md5"))


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+')) AS BIGINT) AS n_email,
        CAST(len(regexp_extract_all(text, '(?i)(password|passwd|secret|token)\s*[:=]')) AS BIGINT) AS n_secret, CAST(len(regexp_extract_all(text, '\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b')) AS BIGINT) AS n_ip FROM documents"""
)
def leak_report(spark, sf_dir):
    return hygiene.leaks(read(spark, sf_dir, "documents")).select("doc_id", *hygiene.RESIDUAL)


@query(
    """SELECT event_type, CAST(ceil(count(*) / 50.0) AS BIGINT) AS n_batches, round(epoch(max(ts) - min(ts)) / 10 * (ceil(count(*) / 50.0) - 10), 3) AS eta
    FROM events GROUP BY event_type"""
)
def ingest_eta(spark, sf_dir):
    d = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))
    n = progress.batches(F.col("n"))
    return d.select("event_type", n.alias("n_batches"), F.round(progress.eta(F.col("micros") / 1e6, F.lit(10), n), 3).alias("eta"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS items, CAST(ceil(count(*) / 50.0) AS BIGINT) AS n_batches FROM documents GROUP BY source""")
def batch_plan(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("items")).withColumn("n_batches", progress.batches(F.col("items")))


@query("""SELECT event_type, epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) > 300 AS stale FROM events GROUP BY event_type""")
def freshness(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    newest = e.groupBy("event_type").agg(F.max(F.col("ts").cast("timestamp")).alias("newest"))
    return newest.crossJoin(F.broadcast(e.agg(F.max(F.col("ts").cast("timestamp")).alias("now")))).select("event_type", hygiene.stale(F.col("newest"), F.col("now")).alias("stale"))


@query()
def encoded_search(spark, sf_dir):
    """Dense search with the engine's own encoder; its hashes are Spark's, so there is no SQL."""
    docs = read(spark, sf_dir, "documents").select("doc_id", vectors.encoded("text").alias("embedding"))
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), vectors.encoded("text").alias("query"))
    return search.in_blocks(queries, lambda q: search.dense_topk(q, docs, 3, "doc_id"))


@query("""SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = text AS clean FROM documents""")
def stripped_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", (stripped("text") == F.col("text")).alias("clean"))


@query(
    f"""WITH h AS (SELECT query_id, vec_id AS seq, score, rank FROM ({dense_sql(BENCH_VECTORS)})),
    e AS (SELECT query_id, score, rank, rank || '. element_id: ' || element_type || '_' || parent_type || '_' || element_name || ' | name: ' || full_name || ' | type: ' || element_type
        || ' | score: ' || printf('%.3f', score) || chr(10) || '   Описание: ' || CASE WHEN length(path) > 150 THEN substr(path, 1, 150) || '...' ELSE path END || chr(10) || '   Родительский тип: ' || parent_type AS entry
        FROM h JOIN ({ELEMENTS_SQL}) USING (seq))
    SELECT query_id, string_agg(entry, chr(10) || chr(10) ORDER BY rank) || CASE WHEN max(score) < 0.999 THEN chr(10) || chr(10) || '{render.INEXACT}' ELSE '' END AS listing FROM e GROUP BY query_id"""
)
def hits_listing(spark, sf_dir):
    hits = dense_topk_batch(spark, sf_dir).withColumnRenamed("vec_id", "seq").join(parts(spark, sf_dir).withColumn("description", F.col("path")), "seq")
    return render.listing(hits)


# The same as table functions of SQL.


@query(sparse_sql(BENCH))
def sql_search(spark, sf_dir):
    at = shared_path(spark, "postings")
    inverted.build(read(spark, sf_dir, "documents"), at)
    functions.register_search(spark, inverted.Inverted(spark, at))
    read(spark, sf_dir, "benchmark").createOrReplaceTempView("_asked")
    return spark.sql("SELECT q.item_id AS query_id, s.id AS doc_id, s.score, s.rank FROM _asked q, LATERAL help_search(q.text, 10) s")


@query(
    f"""SELECT t.p_type AS parent_type, seq, element_type, CASE element_type WHEN 'constructor' THEN 0 WHEN 'method' THEN 1 ELSE 2 END AS place
    FROM (SELECT DISTINCT p_type FROM part) t JOIN ({ELEMENTS_SQL}) e ON e.parent_type = t.p_type WHERE element_type IN ('constructor', 'method', 'property')"""
)
def sql_members(spark, sf_dir):
    functions.register_elements(spark, parts(spark, sf_dir), "seq")
    read(spark, sf_dir, "part").select("p_type").distinct().createOrReplaceTempView("_types")
    return spark.sql("SELECT t.p_type AS parent_type, m.id AS seq, m.element_type, m.place FROM _types t, LATERAL help_members(t.p_type) m")


# Joins by time, over a shop's tables.

SALES_SQL = "SELECT client_id, sold_at, max(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY ALL"


@query(
    f"""SELECT click_id, c.client_id, CAST(ts AS VARCHAR) AS ts, sale_id, date_diff('microsecond', sold_at, ts) AS since
    FROM clicks c ASOF LEFT JOIN ({SALES_SQL}) s ON c.client_id = s.client_id AND c.ts >= s.sold_at"""
)
def asof_clicks_sales(spark, sf_dir):
    """Each click with its client's last sale up to then."""
    clicks, sales = read(spark, sf_dir, "clicks").select("click_id", "client_id", "ts"), read(spark, sf_dir, "sales").select("client_id", "sold_at", "sale_id")
    d = temporal.asof(clicks, sales, {"client_id": "client_id"}, ("ts", "sold_at"), ["sale_id"])
    since = temporal.micros(d, "ts") - temporal.micros(sales, "sold_at", "match")
    return d.select("click_id", "client_id", F.regexp_replace(F.col("ts").cast("string"), r"\.0+$", "").alias("ts"), "match.sale_id", since.alias("since"))


@query(
    """SELECT sale_id, count(*) AS n_clicks, CAST(sum(click_id) AS BIGINT) AS click_sum FROM sales s JOIN clicks c
    ON c.client_id = s.client_id AND c.ts >= s.sold_at - INTERVAL 5 MINUTE AND c.ts < s.sold_at GROUP BY sale_id"""
)
def interval_clicks_sales(spark, sf_dir):
    """The clicks of a sale's client in the five minutes before it."""
    clicks, sales = read(spark, sf_dir, "clicks").select("click_id", "client_id", "ts"), read(spark, sf_dir, "sales").select("client_id", "sold_at", "sale_id")
    sales = sales.withColumn("since", F.expr("sold_at - INTERVAL 5 MINUTE"))
    d = temporal.in_intervals(clicks, sales, {"client_id": "client_id"}, "ts", "since", "sold_at", 1_000_000)
    return d.groupBy("interval.sale_id").agg(F.count("*").alias("n_clicks"), F.sum("point.click_id").alias("click_sum"))


# Trees: parts as a heap, each below that of half its key.


@query(
    """WITH RECURSIVE a AS (SELECT p_partkey AS id, p_partkey AS above, p_size FROM part UNION ALL SELECT id, above // 2, p_size FROM a WHERE above // 2 > 0)
    SELECT above AS id, above // 2 AS parent_id, length(bin(above)) - 1 AS level, count(*) - 1 AS n_below, CAST(sum(p_size) AS BIGINT) AS total FROM a GROUP BY above"""
)
def tree_totals(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("parent_id"), "p_size")
    return tree.totals(p, 0, "p_size")
