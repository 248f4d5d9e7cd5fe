"""What is read of a page is computed once a row, and pages that are made of a small table are worked on by all tasks."""

import re

import pytest

from fathomline.operators import extract
from fathomline.plans.catalogue import QUERIES
from tests.oracle import TESTDATA

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", ["page_fields", "page_parameters", "enum_values", "page_records"])
def test_pages_are_cut_once_and_dealt_out(spark, name):
    d = QUERIES[name](spark, SF)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    # The pattern of all labels: one pass for the labels, one for the texts between.
    assert len(re.findall(r"Методическая\\s\+информация\|", plan)) <= 2
    assert d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_first_letters_of_labels():
    letters = {x[0] for labels in extract.LABELS.values() for x in labels}
    forms = {c for c in map(chr, range(0x10000)) for f in letters if not 0xD800 <= ord(c) < 0xE000 and c.upper().lower() == f.upper().lower()}
    assert forms == set(extract.FIRST)


def test_labels_are_found_by_their_letters_in_one_pass(spark):
    bits = ["Описание:", "ᲂПИСАНИЕ:", "deſcription:", "ſyntax:", "Значени:", "Значения:", "Методическая \n информация", '<P  class="v8sh_chapter" x>', "</body>", "Note", ":", "\n", "п", "S", "\U0001f600"]
    texts = ["".join(bits[(i * i * 7 + j * (i + 3)) % len(bits)] for j in range(i % 12)) for i in range(300)]
    labels = re.compile("|".join(x for own in extract.LABELS.values() for x in own), re.IGNORECASE)
    d = spark.createDataFrame(list(enumerate(texts)), "k int, content string").withColumn("cut", extract.labelled("content"))
    for r in d.collect():
        at = [m.span() for m in labels.finditer(texts[r.k])]
        ends = [a for a, _ in at][1:] + [len(texts[r.k])]
        assert [(x.label, x.text) for x in r.cut] == [(texts[r.k][a:b], texts[r.k][b:e]) for (a, b), e in zip(at, ends, strict=False)]
    # split() compiles its pattern for each row; the labels' is long.
    assert "split(" not in str(extract.labelled("content"))
