"""Table functions of SQL against the API."""

import pytest

from fathomline.operators import elements as el
from fathomline.operators import inverted
from fathomline.plans import functions


def test_search_as_a_table_function(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox fox", "the tree", None, "", "it's red the red"])], "doc_id long, text string")
    for stops in (None, ["the", "it's", "s"]):
        at = str(tmp_path / f"i{bool(stops)}")
        inverted.build(docs, at, stops=stops)
        ix = inverted.Inverted(spark, at, stops)
        functions.register_search(spark, ix)
        for text in ("Red fox", "the tree", "nothing", ""):
            got = spark.sql("SELECT * FROM help_search(:q, 2)", {"q": text}).collect()
            assert sorted((r["rank"], r["id"], r["score"]) for r in got) == sorted((r["rank"], r["doc_id"], r["score"]) for r in ix.one(text, 2).collect())
    assert spark.sql("SELECT * FROM help_search(NULL, 2)").count() == 0
    with pytest.raises(ValueError, match="stems"):
        functions.register_search(spark, inverted.Inverted(spark, at, None, str))


def test_elements_as_table_functions(spark):
    rows = [(1, "method", "Add", "T.Add", "T"), (2, "property", "Len", "T.Len", "T"), (3, "type", "Len", "Len", None), (4, "constructor", "New", "New T", "T"), (5, "event", "E", "T.E", "T"), (6, "property", "Len", "U.Len", "U")]
    d = spark.createDataFrame(rows, "id long, element_type string, element_name string, full_name string, parent_type string").withColumn("content", functions.index.F.lit("c"))
    functions.register_elements(spark, d)
    assert [(r["id"], r["place"]) for r in spark.sql("SELECT * FROM help_members('T') ORDER BY place, id").collect()] == [(r["id"], r["place"]) for r in el.members(d, "T").collect()]
    assert [r["id"] for r in spark.sql("SELECT * FROM help_element('Len')").collect()] == [2] == [r["id"] for r in el.element(d, "Len").collect()]
    got = spark.sql("SELECT q.n, e.id FROM VALUES ('Len'), ('Add'), ('none') q(n), LATERAL help_element(q.n) e").collect()
    assert sorted(map(tuple, got)) == [("Add", 1), ("Len", 2)]
    assert sorted(r["id"] for r in spark.sql("SELECT id FROM help_lookup('LEN')").collect()) == [2, 3, 6]


def test_postings_are_shuffled_as_lists(spark, tmp_path):
    """Not a row a query, term and document; and what the queries' terms are joined to isn't shuffled."""
    docs = spark.createDataFrame([(i, f"red fox {i % 3}") for i in range(40)], "doc_id long, text string")
    inverted.build(docs, str(tmp_path / "i"), shard_docs=8, cell_docs=4)
    functions.register_search(spark, inverted.Inverted(spark, str(tmp_path / "i")), "help_lists")
    spark.createDataFrame([("red 1",), ("fox fox 2",)], "q string").createOrReplaceTempView("_lists_asked")
    found = spark.sql("SELECT a.q, s.id, s.rank FROM _lists_asked a, LATERAL help_lists(a.q, 3) s")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "strategy=broadcast" in plan
    assert sorted(r.id for r in found.collect() if r.q == "red 1") == [1, 4, 7]
