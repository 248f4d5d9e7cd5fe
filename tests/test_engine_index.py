"""The engine over its stored postings."""

import pytest

from fathomline.api import ACTIONS, Engine
from fathomline.operators import inverted, search
from fathomline.settings import Settings

COLS = "element_type string, element_name string, element_name_en string, parent_type string, content string, path string, seq long"


def items(spark, n=30, extra="", version=None):
    rows = [("method", f"Метод{i}", f"Method{i}", f"Тип{i % 3}", f"вставляет значения номер{i} {extra}" + " строка" * (i % 4), f"a/methods/m{i}.html", i) for i in range(n)]
    d = spark.createDataFrame(rows, COLS)
    return d.withColumn("version", search.F.lit(version)) if version else d


def hits(d):
    return [(r["rank"], r["id"], r["score"]) for r in d.collect()]


def test_search_reads_stored_postings_and_agrees_with_a_scan(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    e.index(items(spark), "8.3.26")
    ix = e.stored_index()
    assert ix is not None and e.stored_index() is ix  # opened once
    rows = e.elements()
    for query in ("значение строки", "номер7", "нет такого"):
        scan = search.hybrid(e._asked(query), rows, rows, 10, stops=e.stops, id_col="id", stem=e.stem)
        assert [r[:3] for r in hits(e.search(query))] == [(r["rank"], r["id"], r["score"]) for r in scan.orderBy("rank").collect()]
    assert e.search("вставлять значение").first()["title"].startswith("Тип")  # stems meet
    plan = ix.of(["номер7"])._jdf.queryExecution().executedPlan().toString()
    assert "номер7" in plan.split("PushedFilters")[1]


def test_reindexing_swaps_the_index_and_keeps_the_one_before(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    e.index(items(spark), "8.3.26")
    first = e.stored_index().path
    assert e.search("особенный").count() == 10 and e.stored_index().one("особенный", id_col="id").count() == 0
    assert e.manage("reindex", "8.3.26", items(spark, extra="особенный"))
    second = e.stored_index().path
    assert second != first and e.stored_index().one("особенный", id_col="id").count() == 10
    e.manage("reindex", "8.3.26", items(spark))
    assert inverted.latest(spark, e._index_root("8.3.26")) not in (first, second)
    assert sorted(p.name for p in (tmp_path / "w/_search/elements/8.3.26").iterdir() if not p.name.startswith("."))[0] == second.rsplit("/", 1)[1]
    # A build that didn't end is not opened.
    half = tmp_path / "w/_search/elements/8.3.26/99999999999999999999-x/postings"
    half.mkdir(parents=True)
    assert not e.stored_index().path.endswith("-x")
    assert e.catalog.tables() == ["elements"]
    e.manage("delete", "8.3.26")
    assert not (tmp_path / "w/_search/elements/8.3.26").exists()


def test_settings_and_requests(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), settings=Settings(default_search_limit=3, max_search_limit=5, use_hybrid_search=False))
    e.index(items(spark), "8.3.26")
    assert e.search("номер1").count() == 3 and e.search("номер1", limit=5, hybrid=True).count() == 5
    for bad in (lambda: e.search("x" * 501), lambda: e.search("x", limit=6), lambda: e.search_elements("x" * 201), lambda: e.search_elements("x", "nothing"), lambda: e.type_members("x" * 101),
                lambda: e.get_element("x" * 101), lambda: e.search("x", "8.3.26.1"), lambda: e.manage("nothing")):
        with pytest.raises(ValueError):
            bad()
    assert {"default_get", "default_set", "default_clear", "index_all", "delete"} <= set(ACTIONS)


def test_index_all_gives_a_result_a_version(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    e.index(items(spark, 3), "8.3.1")
    every = items(spark, 3, version="8.3.1").unionByName(items(spark, 4, version="8.3.2")).unionByName(items(spark, 2, version="bad"))
    got = e.manage("index_all", items=every)
    assert {v: r["status"] for v, r in got.items()} == {"8.3.1": "skipped", "8.3.2": "indexed", "bad": "error"} and got["bad"]["error"]
    assert {r["platform_version"]: r["points_count"] for r in e.manage("list").collect()} == {"8.3.1": 3, "8.3.2": 4}
    e.manage("default_set", "8.3.1")
    assert e.manage("default_get") == "8.3.1" == e.version()
