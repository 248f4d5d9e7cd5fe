"""The engine's queries as table functions of SQL: SELECT * FROM help_search('text', 10), and LATERAL help_search(t.text, 10) for each row of a table.

They are SQL functions, so Catalyst plans them with the query that calls them: a LATERAL call over many rows is a join and an aggregation, not a call a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.functions.text import TOKEN
from fathomline.operators import index
from fathomline.operators.elements import MEMBER_ORDER
from fathomline.operators.inverted import Inverted

NAMES = ("help_search", "help_members", "help_element", "help_lookup")


def register_search(spark: SparkSession, opened: Inverted, name: str = "help_search") -> None:
    """help_search(query, k): (id, score, rank) of stored postings, as Inverted.topk gives them. An index with stems is refused: SQL has none.

    A query's postings go out to their shards as lists, and are taken apart there, so each document's parts are summed before its score is sent on.
    """
    if opened.stem is not None:
        raise ValueError("an index with stems can't be searched from SQL")
    view, totals, k1 = f"_{name}_postings", opened.totals, index.K1
    opened.rows.createOrReplaceTempView(view)
    stops = ", ".join("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in opened.stops or [])
    kept = f"WHERE term NOT IN ({stops})" if stops else ""
    idf = f"ln(({totals['total_docs']} - df + 0.5D) / (df + 0.5D) + 1D)"
    weigh = lambda tf: f"(idf * {tf} * {k1 + 1}D / ({tf} + {k1}D))"
    kind = opened.rows.schema["blocks"].dataType.elementType["ids"].dataType.elementType.simpleString()
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, k INT) RETURNS TABLE (id {kind}, score DOUBLE, rank INT) RETURN
        WITH asked AS (SELECT term, count(*) AS qtf FROM (SELECT explode(regexp_extract_all(lower(coalesce({name}.query, '')), r'{TOKEN}', 0)) AS term) {kept} GROUP BY term),
        own AS (SELECT /*+ BROADCAST(a) */ a.term, qtf, p.shard, flatten(p.blocks.ids) AS ids, flatten(p.blocks.tfs) AS tfs FROM asked a JOIN {view} p ON p.term = a.term AND p.bucket = pmod(xxhash64(a.term), {totals['n_buckets']})),
        df AS (SELECT term, sum(n) AS df FROM (SELECT /*+ BROADCAST(a) */ a.term, p.n FROM asked a JOIN {view} p ON p.term = a.term AND p.bucket = pmod(xxhash64(a.term), {totals['n_buckets']})) GROUP BY term),
        met AS (SELECT /*+ BROADCAST(df) */ shard, collect_list(struct(qtf, {idf} AS idf, ids, tfs)) AS parts FROM own JOIN df USING (term) GROUP BY shard),
        part AS (SELECT shard, inline(parts) FROM met),
        each AS (SELECT shard, qtf, idf, explode(arrays_zip(ids, tfs)) AS x FROM part),
        scored AS (SELECT shard, x.ids AS id, round(sum({weigh('qtf')} * {weigh('x.tfs')}), 6) AS score FROM each GROUP BY shard, x.ids),
        ranked AS (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM scored)
        SELECT id, score, rank FROM ranked WHERE rank <= {name}.k""")


def register_elements(spark: SparkSession, elements: DataFrame, id_col: str = "id") -> None:
    """help_members(type_name), help_element(name) and help_lookup(part): all members of a type in their order, the best element of a name, all with a part of it."""
    view = "_help_elements"
    elements.createOrReplaceTempView(view)
    kind = elements.schema[id_col].dataType.simpleString()
    place = "CASE element_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(MEMBER_ORDER)) + " END"
    best = "CASE element_type WHEN 'property' THEN 5 WHEN 'method' THEN 4 WHEN 'constructor' THEN 3 WHEN 'function' THEN 2 WHEN 'type' THEN 1 ELSE 0 END"
    own = f"{id_col} AS id, element_type, element_name, parent_type"
    returns = f"id {kind}, element_type STRING, element_name STRING, parent_type STRING"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION help_members(type_name STRING) RETURNS TABLE ({returns}, place INT) RETURN
        SELECT {own}, {place} AS place FROM {view} WHERE parent_type = help_members.type_name AND element_type IN {MEMBER_ORDER}""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION help_element(name STRING) RETURNS TABLE ({returns}) RETURN
        SELECT id, element_type, element_name, parent_type FROM (SELECT {own}, row_number() OVER (ORDER BY {best} DESC, {id_col}) AS n FROM {view} WHERE element_name = help_element.name) WHERE n = 1""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION help_lookup(part STRING) RETURNS TABLE ({returns}) RETURN
        SELECT {own} FROM {view} WHERE contains(lower(element_name), lower(help_lookup.part)) OR contains(lower(full_name), lower(help_lookup.part))""")
