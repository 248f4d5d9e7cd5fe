"""Benchmark passages with words changed, put in or left out, against a plain version."""

import random

from fathomline.llm import decontaminate
from tests.llm.helpers import none, odd, plain


def fits(win, doc, most):
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(win):
        new = [i + 1]
        for k, y in enumerate(doc):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row) <= most


def brute(docs, items, window):
    out = {}
    for d, t in enumerate(docs):
        w, n = (t or "").split(), 0
        for it in items:
            v = (it or "").split()
            size = min(window, len(v))
            n += size > 0 and any(fits(v[s : s + size], w, int(size * 0.2 + 1e-9)) for s in range(len(v) - size + 1))
        out[d] = n
    return out


def test_rarest_word_changed(spark):
    item = "k l m n o p q r s t"
    common = " ".join("klmnopqrs" * 3)  # t occurs in no document
    docs = [item.replace("t", "zz"), item.replace("o ", ""), item.replace("o", "o x"), item.replace("k", "y").replace("o", "y"), item.replace("k", "y").replace("o", "y").replace("s", "y"), "k t s l r m q n p o", None]
    items = spark.createDataFrame([(0, item), (1, None)], "item_id long, text string")
    d = plain(spark, [*docs, common])
    found = {r.doc_id: r.near for r in decontaminate.near(d, items).collect()}
    assert found == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: brute([common], [item], 10)[0] > 0}
    assert decontaminate.contamination(d, items).filter("contaminated").count() == 0


def test_near_of_random_texts(spark):
    rnd = random.Random(8)
    for window, letters in ((10, "abcde"), (5, "abcdefgh")):
        docs = [" ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
        items = [" ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(25)]
        d, b = plain(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        want = brute(docs, items, window)
        assert {r.doc_id: r.n_near_items for r in decontaminate.near(d, b, window).collect()} == want and 0 < sum(want.values()) < 60 * 25
        assert {r.doc_id: r.n_near_items for r in decontaminate.near(d, b, window, terms_a_pass=50).collect()} == want


def test_near_of_odd_rows(spark):
    items = spark.createDataFrame([(None, "one two three"), (1, None)], "item_id long, text string")
    assert decontaminate.near(odd(spark), items).filter("near").count() == 1 and decontaminate.near(odd(spark), items).count() == 4
    assert decontaminate.near(none(spark), items).count() == 0 and decontaminate.near(odd(spark), items.limit(0)).filter("near").count() == 0


def test_windows_that_are_too_wide_are_refused(spark):
    import pytest

    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for window in (0, 201):
        with pytest.raises(ValueError, match="1 to 200"):
            decontaminate.near(d, d.withColumnRenamed("doc_id", "item_id"), window)
