"""Look-ups over more rows than any page has."""

import pytest

from fathomline.operators import elements as el

N = 1500


@pytest.fixture(scope="module")
def rows(spark):
    own = [(i, "method" if i % 3 else "property", f"name{i}", f"en{i}", f"T.name{i}", "T", None) for i in range(N)]
    own += [(N + i, "type" if i < 30 else "property", "Same", "Same", "Same", None, None) for i in range(31)]
    return spark.createDataFrame(own, "id long, element_type string, element_name string, element_name_en string, full_name string, parent_type string, content string")


def test_all_members(rows):
    found = el.members(rows, "T").collect()
    assert len(found) == N and [r["place"] for r in found] == sorted(r["place"] for r in found)
    assert el.members(rows, "T", "property").count() == N // 3


def test_scan_looks_through_all_rows(rows):
    assert [(r["id"], r["stage"]) for r in el.cascade(rows, f"ame{N - 1}").collect()] == [(N - 1, 4)]


def test_best_of_all_ids_with_a_name(rows):
    assert el.element(rows, "Same").first()["id"] == N + 30  # a property, behind thirty types


def test_scroll_goes_through_all_pages(rows):
    seen, after = [], None
    while page := [r["id"] for r in el.by_id(rows, 400, after=after).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == list(range(N + 31))
    assert el.by_id(rows).count() == N + 31
