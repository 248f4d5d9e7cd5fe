"""SentencePiece encoding against the library itself, text by text."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from fathomline.llm import pieces
from fathomline.llm.queries import op11_sentencepiece
from tests.llm.helpers import none, odd, plain
from tests.oracle import TESTDATA

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = SentencePieceProcessor(model_file=MODEL)
WORDS = pieces.Words(SP)
ODD = [
    None, "", " ", "  ", "\n", " \n", "\n ", "a", " a", "a ", "a  b", "\n\nb", "a \n b", "a\n b\n", "▁", "▁▁a▁", "a▁ b", "a\x00b", "\r\n x\ty", "   x", "𝒳 é́ ﬁ 漢字", "</s> <s> <unk> <0x0A>",
    "x" * 5000, "the " * 3000, "﻿퟿", "1234567890 " * 50,
]


def expected(t, **kw):
    return SP.encode(t or "", **(kw or {"add_eos": True}))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁ae.\t\r"), st.characters(exclude_categories=["Cs"]))))
def test_words_give_the_texts_ids(text):
    words = WORDS.of(text)
    assert [i for own in WORDS.ids(words) for i in own] == SP.encode(text)


@pytest.mark.parametrize("block", [1, 40, pieces.BLOCK_CHARS])
def test_ids_of_odd_texts(spark, block):
    d = pieces.encode(plain(spark, ODD), MODEL, block_chars=block)
    assert {r["doc_id"]: r["ids"] for r in d.collect()} == {i: expected(t) for i, t in enumerate(ODD)}


def test_begin_ids_and_other_columns_stay(spark):
    texts = ["one two", None, "one two"]
    d = plain(spark, texts).withColumn("ids", pieces.F.lit("old")).withColumn("k", pieces.F.lit("clash")).withColumn("_row", pieces.F.lit(1))
    d = pieces.encode(d, MODEL, bos=True, eos=False)
    assert d.columns == ["doc_id", "lang", "source", "n_chars", "k", "_row", "ids"]
    assert sorted((r["doc_id"], r["k"], r["_row"], r["ids"]) for r in d.collect()) == [(i, "clash", 1, expected(t, add_bos=True)) for i, t in enumerate(texts)]


def test_only_a_text_column_empty_tables_repeats_and_nulls(spark):
    d = spark.createDataFrame([("a b",), (None,), ("a b",)], "text string")
    assert sorted(r["ids"] for r in pieces.encode(d, MODEL).collect()) == sorted([expected("a b"), expected(""), expected("a b")])
    assert pieces.encode(none(spark), MODEL).count() == 0
    rows = odd(spark).collect()
    assert sorted(r["n_tokens"] for r in pieces.report(odd(spark), MODEL).collect()) == sorted(len(expected(r["text"])) for r in rows)


def test_rows_that_were_dealt_out_are_stored_first(spark):
    d = plain(spark, ODD).repartition(3)
    assert sorted(r["ids"] for r in pieces.encode(d, MODEL).select("ids").collect()) == sorted(expected(t) for t in ODD)


def test_many_words_and_a_very_long_text(spark):
    many = " ".join(f"w{i:x}q{i * 7919 % 65537:x}" for i in range(40_000))
    long = "lorem ipsum, dolor\n" * 60_000 + "z" * 30_000
    d = pieces.encode(plain(spark, [many, long, many]), MODEL)
    assert {r["doc_id"]: r["ids"] for r in d.collect()} == {0: expected(many), 1: expected(long), 2: expected(many)}


def test_round_trip_of_ids(spark):
    texts = [t for t in ODD if t and "▁" not in t]
    d = pieces.encode(plain(spark, texts), MODEL, back="again")
    assert {r["doc_id"]: r["again"] for r in d.collect()} == dict(enumerate(texts))
    got = {r["doc_id"]: r["t"] for r in d.select("doc_id", pieces.decoded("ids", MODEL).alias("t")).collect()}
    assert got == dict(enumerate(texts))
    assert spark.range(1).select(pieces.decoded(pieces.F.lit(None).cast("array<int>"), MODEL)).first()[0] is None


def test_models_whose_words_depend_on_each_other_are_refused():
    class Crossing:
        def __getattr__(self, name):
            return getattr(SP, name)

        def id_to_piece(self, i):
            return "a▁b" if i == 1000 else SP.id_to_piece(i)

    with pytest.raises(ValueError, match="cross"):
        pieces.Words(Crossing())


def test_query_equals_the_library(spark):
    sf = f"{TESTDATA}/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = expected(r["text"])
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(SP.decode(ids))))
    assert sorted(tuple(r) for r in op11_sentencepiece(spark, sf).collect()) == sorted(want)
