"""Passages that are not whole lines in threes, against a plain version."""

import random

import numpy as np
from fathomline.llm import common, line_dedup, passages
from fathomline.llm.queries import QUERIES
from tests.llm.helpers import none, odd, plain
from tests.oracle import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def brute(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in seen:
                gone.update(range(k, k + n))
            seen.add(g)
        out[i] = (len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out


def test_passage_on_one_line_goes(spark):
    rnd = random.Random(1)
    w = [f"é{rnd.random()}" for _ in range(400)]
    copied = " ".join(w[:60])
    docs = plain(spark, [f"{' '.join(w[60:90])} {copied} {' '.join(w[90:110])}", f"a {copied}\nb", " ".join(w[:49]), f"x\ny {copied.replace(' ', chr(10), 9)} z"])
    assert line_dedup.report(docs).filter("n_removed > 0").count() == 0
    found = {r.doc_id: (r.text, r.n_words_removed) for r in passages.report(docs).collect()}
    assert found[0][1] == 0 and found[1] == ("a \nb", 60) and found[2] == (" ".join(w[:49]), 0) and found[3] == ("x\ny  z", 60)


def test_passages_of_random_texts(spark, monkeypatch):
    rnd = random.Random(2)
    for n, letters in ((6, "abcd"), (7, "ab")):
        texts = [" ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(40)] + ["a " * 300, "", None, "  a\t\n"]
        want = brute(enumerate(texts), n)
        for piece in (passages.PIECE, 64):
            monkeypatch.setattr(passages, "PIECE", piece)
            found = {r.doc_id: (r.n_words_removed, (r.text or "").encode().split()) for r in passages.deduped(plain(spark, texts), n).collect()}
            assert found == want


def test_passages_query(spark):
    left = [(r.doc_id, r.text) for r in line_dedup.report(common.table(spark, SF, "documents")).collect()]
    found = {r.doc_id: (r.n_words_removed, (r.text or "").encode().split()) for r in QUERIES["op6_passages"](spark, SF).collect()}
    assert found == brute(left, passages.WORDS) and sum(n for n, _ in found.values()) > 0


def test_passages_of_odd_rows(spark):
    assert passages.deduped(odd(spark)).count() == 4 and passages.deduped(none(spark)).count() == 0
    twice = plain(spark, ["w " * 3]).union(plain(spark, ["w " * 3]))
    assert sorted(r.text for r in passages.deduped(twice, 3).collect()) == ["", "w w w "]


def test_chosen():
    h = np.array([5, 3, 4, 3, 9, 8, 7], np.uint64)
    want = [any(h[k] == h[j : j + 3].min() for j in range(5) if j <= k < j + 3) for k in range(7)]
    assert passages.chosen(h, 3).tolist() == want
