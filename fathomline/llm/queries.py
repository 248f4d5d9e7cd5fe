"""The queries of this package's operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import decontaminate, fingerprints, html_extract, jaccard_join, line_dedup, merkle, mixing, passages, pieces, pii, quality, rolling, secret_scan, warc


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("doc")


def op2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.near(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("doc")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(C.table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(C.table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(C.table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(C.table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(C.table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(C.table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(C.table(spark, sf_dir, "documents")).drop("doc", "root")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(C.table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(C.table(spark, sf_dir, "documents")))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.report(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.report(C.table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(C.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op2_near": op2_near,
    "op3_fingerprints": op3_fingerprints,
    "op4_secret_scan": op4_secret_scan,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op6_passages": op6_passages,
    "op7_warc": op7_warc,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_extract": op9_html_extract,
    "op10_pii": op10_pii,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_rolling": op12_rolling,
    "op13_merkle": op13_merkle,
}
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 of the integer {0} in decimal; needs the table crc_table (t: list of 256).
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST({0} AS VARCHAR)) + 1),
    lambda i: CAST(ascii(substr(CAST({0} AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), CAST(4294967295 AS BIGINT))"""
_CRC_TABLE = """SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS t"""


def _rolled(w: int) -> str:
    return f"""SELECT doc_id, CAST({w} AS BIGINT) AS window_s, event_s, count(*) OVER w AS n_events, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS sum_chars,
        count(DISTINCT lang) OVER w AS n_langs, count(n) OVER w AS m, list_sort(list(n) FILTER (n IS NOT NULL) OVER w) AS l
        FROM e WINDOW w AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"""


ORACLES: dict[str, str] = {
    "op2_decontaminate": f"""
        WITH i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[s : s + least(10, len(w)) - 1] AS g
                FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT doc_id, n, s, w[s : s + n - 1] AS g
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        m AS (SELECT doc_id, s, p.n, item_id FROM p JOIN win USING (n, g)),
        h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM m) GROUP BY doc_id),
        k AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
        o AS (SELECT source, source_size, w, source_size * 3 / w AS ratio, row_number() OVER r AS place,
                     (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                         / (sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS unit
              FROM s WINDOW r AS (ORDER BY source_size * 3 / w, source NULLS LAST)),
        u AS (SELECT arg_min(unit, place) AS unit FROM o WHERE ratio > unit),
        t AS (SELECT source, source_size, CAST(source_size * 3 AS DOUBLE) AS cap, (SELECT unit FROM u) * w AS share FROM o),
        k AS (SELECT doc_id, size, source_size, least(cap, coalesce(share, cap)) AS target,
                     row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) AS rank,
                     CAST(('0x' || substr(md5('mix:1:' || coalesce('s:' || d.source, 'n')), 1, 8)) AS BIGINT) / 4294967296.0 AS shift
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM k)
        SELECT doc_id, size, source_size, target,
               size * CAST(floor(rate * rank + shift) - floor(rate * (rank - 1) + shift) AS BIGINT) AS taken FROM c""",
    "op6_line_dedup": r"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        t AS (SELECT doc_id, list_transform(l, lambda x: trim(x, ' ' || chr(9) || chr(13))) AS t FROM d WHERE len(l) >= 3),
        w AS (SELECT doc_id, i, t[i + 1] || chr(10) || t[i + 2] || chr(10) || t[i + 3] AS w
              FROM (SELECT doc_id, t, unnest(range(0, len(t) - 2)) AS i FROM t)),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w WHERE length(w) > 2),
        gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE n > 1),
        each AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n
                 FROM (SELECT * FROM each ANTI JOIN gone USING (doc_id, i)) GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - coalesce(n, 0), 0) AS BIGINT) AS n_removed,
               CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
        FROM d LEFT JOIN kept USING (doc_id)""",
    # The signatures' recall is 0.9999; the SQL compares all n-grams.
    "op8_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT text, min(doc_id) AS node, count(*) AS copies FROM d GROUP BY text),
        w AS (SELECT node, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM n),
        g AS (SELECT DISTINCT node, array_to_string(w[s : s + 4], ' ') AS g
              FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
        z AS (SELECT node, count(*) AS z FROM g GROUP BY node),
        p AS (SELECT a.node AS a, b.node AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.node != b.node GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN z x ON x.node = a JOIN z y ON y.node = b WHERE 5 * c >= 4 * (x.z + y.z - c)),
        r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        k AS (SELECT a AS node, min(b) AS class_id FROM r GROUP BY a),
        t AS (SELECT a AS node, count(*) AS texts, sum(copies) AS docs FROM l JOIN n ON n.node = b GROUP BY a)
        SELECT doc_id, class_id, CAST(copies - 1 AS BIGINT) AS n_copies, CAST(coalesce(texts, 0) AS BIGINT) AS n_text_links,
               CAST(coalesce(docs, 0) + copies - 1 AS BIGINT) AS n_links
        FROM d JOIN n USING (text) JOIN k USING (node) LEFT JOIN t USING (node)""",
    # A record a row: SQL can give what the archives read back have to say.
    "op7_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS n FROM p),
        b AS (SELECT page_id, html, first, n, CAST(strlen(html) AS BIGINT) AS payload_bytes,
                     list_aggregate(list_transform(range(0, 160), lambda i: substr(CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR), i + 1, 1)), 'string_agg', '') AS bits
              FROM f)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, k * 5 + j + 1, 1) AS INTEGER) * (16 >> j))) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to
        FROM b""",
    "op12_rolling": f"""
        WITH crc_table AS ({_CRC_TABLE}),
        e AS (SELECT doc_id, source, lang, CAST(length(text) AS BIGINT) AS n, CAST(60 * floor((doc_id + {_CRC.format("doc_id")} % 10000) / 6) AS BIGINT) AS event_s FROM documents, crc_table),
        r AS ({_rolled(600)} UNION ALL {_rolled(43200)})
        SELECT doc_id, window_s, event_s, n_events, sum_chars, n_langs, l[(m + 1) // 2] AS median_chars, l[(90 * m + 99) // 100] AS high_chars FROM r""",
}
