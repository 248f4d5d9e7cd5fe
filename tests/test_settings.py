"""Settings, checks of requests, rule sets, encoders, list of tables."""

import json

import numpy as np
import pytest
from fathomline.functions import vectors
from fathomline.operators import hygiene
from fathomline.operators.catalog import Catalog
from fathomline.settings import Settings, faulty, validated
from pyspark.sql import functions as F


def test_settings():
    s = Settings()
    assert (s.default_search_limit, s.max_search_limit, s.use_hybrid_search, s.rrf_k, s.default_platform_version) == (10, 100, True, 60, None)
    assert 0 <= s.sparse_boost <= 1
    read = Settings.read({"X_RRF_K": "7", "x_use_hybrid_search": "False", "X_SPARSE_BOOST": "0.25", "other": "1", "X_DEFAULT_PLATFORM_VERSION": ""}, "X_")
    assert (read.rrf_k, read.use_hybrid_search, read.sparse_boost, read.default_platform_version) == (7, False, 0.25, None)
    for bad in ({"RRF_K": "0"}, {"SPARSE_BOOST": "1.5"}, {"DEFAULT_SEARCH_LIMIT": "101"}, {"RRF_K": "x"}, {"DEFAULT_SEARCH_LIMIT": "50", "MAX_SEARCH_LIMIT": "20"}):
        with pytest.raises(ValueError):
            Settings.read(bad)


GOOD = [("search", {"query": " a\nb ", "limit": 100}), ("search", {"query": "x" * 500, "platform_version": "8.3"}), ("get_element", {}), ("manage", {"action": "list", "version": "8.3.26"})]
BAD = [("search", {"query": "\r\n"}), ("search", {}), ("search", {"query": "x" * 501}), ("search", {"query": "x", "limit": 0}), ("search", {"query": "x", "limit": 101}), ("search", {"query": "x", "platform_version": "8"}),
       ("search_elements", {"query": "x", "element_type": "enum"}), ("get_element", {"element_name": ""}), ("type_members", {"type_name": "T", "member_type": "type"}), ("manage", {"action": "drop"}),
       ("manage", {"action": "list", "version": "8.3"})]
SCHEMAS = {"search": "query string, platform_version string, limit int", "search_elements": "query string, element_type string", "get_element": "element_name string", "type_members": "type_name string, member_type string", "manage": "action string, version string"}


def test_requests_one_by_one():
    assert validated("search", query=" a\nb ") == {"query": "ab", "platform_version": None, "limit": 10}
    for kind, given in GOOD:
        validated(kind, **given)
    for kind, given in BAD:
        with pytest.raises(ValueError):
            validated(kind, **given)
    with pytest.raises(ValueError, match="no field"):
        validated("search", query="x", colour="red")


def test_requests_as_a_column(spark):
    for cases, fine in ((GOOD, True), (BAD, False)):
        for kind in {k for k, _ in cases}:
            d = spark.createDataFrame([tuple(g.get(c.split()[0]) for c in SCHEMAS[kind].split(", ")) for k, g in cases if k == kind], SCHEMAS[kind])
            assert all((r[0] == []) == fine for r in d.select(faulty(d, kind)).collect())
    assert spark.range(1).select(faulty(spark.range(1), "search")).first()[0] == ["query"]


def test_rule_sets(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({r"10\.0\.0\.1": "HOST", r"http://10\.0\.0\.1": "URL", r"(key)=\w+": "$1=GONE"}))
    rules = hygiene.read_rules(spark, str(tmp_path / "r.json"))
    d = spark.createDataFrame([("HTTP://10.0.0.1 and 10.0.0.1, KEY=abc",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(hygiene.sanitized("t", rules)).collect()] == ["URL and HOST, KEY=GONE", "", None]
    with pytest.raises(Exception, match="unterminated"):
        hygiene.rules_of({"(": "x"})


def test_encoders(spark):
    def lengths():
        def run(texts):
            assert len(texts) <= 2
            return np.array([[len(t), 1.0] for t in texts])

        return run

    d = spark.createDataFrame([("abc",), (None,), ("ab",), ("",), ("x",)], "t string").coalesce(1)
    got = [r[0] for r in d.select(vectors.encoded("t", encoder=lengths, batch=2)).collect()]
    assert np.allclose(got[0], np.array([3, 1]) / np.sqrt(10)) and got[1] == got[3] == [0.0, 1.0]
    assert np.allclose([r[0] for r in d.select(vectors.encoded("t")).collect()][0], vectors.encode("abc"))
    assert vectors.embedded(["abc"]) == [vectors.encode("abc")]
    for bad in ([], ["x"] * 101):
        with pytest.raises(ValueError):
            vectors.embedded(bad)


def test_tables(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "w"))
    assert c.tables() == []
    rows = spark.range(2).select("id", F.lit("8.3.1").alias("platform_version"))
    c.upsert("b", rows)
    c.upsert("a", rows)
    c.set_default_version("8.3.1")
    assert c.tables() == ["a", "b"]
    c.remove("b")
    assert c.tables() == ["a"]
