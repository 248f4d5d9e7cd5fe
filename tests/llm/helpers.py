"""Rows with what data may have: nulls, empty and long texts, ties, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank int, copy int, n_lines long, _sid long, words string"


def odd(spark, texts=("", "one two three", None)):
    """The texts under odd ids and sources, and a repeated row."""
    rows = [(i if i != 1 else None, t, None, None if i % 2 else "s", None, "d", 7, 9, 5, 3, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
