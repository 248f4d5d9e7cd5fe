"""Fields of hand-written pages, stems, stored statistics, deep contents, tables that can't be read."""

import pytest
from fathomline.functions.text import stem_russian
from fathomline.operators import extract, index, search
from fathomline.operators.catalog import Catalog
from fathomline.sources.archive import toc_paths
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

PAGES = (
    ("Глобальный контекст.СтрДлина (Global context.StrLen)", "Описание: Возвращает длину строки в символах.\n\nПараметры:\n<Строка> (Строка) - исходная строка\nвторая часть\nРежим (Число) - необязательный. По умолчанию: 1.\n\nВозвращаемое значение: Тип: Число. Длина строки.\n\nДоступность: Сервер, толстый клиент.\nПримечание: Не учитывает хвост.\nДоступен, начиная с версии 8.3.6."),
    ("Массив.Добавить (Array.Add)", "Syntax: Add(Value)\n\nDescription: Adds a value to the end of the array.\n\nParameters:\nValue (Arbitrary) - what is added, optional\n\nReturn value: Number - index of it\n\nAvailability: Server.\nNote: none needed\nDeprecated since version 8.3.20"),
    ("Перечисление Цвет", "Значения:\nКрасный: тёплый\nСиний: холодный\n\nБазовый тип: Строка, Число"),
    ("Index", "Plain text of a page. It has some longer sentences in it! Short. And one more sentence that is long enough."),
    ("", None),
)


def test_fields_of_pages(spark):
    d = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(PAGES)], "k int, title string, content string")
    v, r = extract.version_info("content"), extract.returned("content")
    rows = d.select(
        "k", extract.description("content").alias("d"), extract.notes("content").alias("n"), extract.availability("content").alias("a"), v["since"].alias("s"), v["deprecated"].alias("x"),
        r["type"].alias("r"), r["description"].alias("rt"), extract.function_name("title").alias("f"), extract.english_name("title").alias("e"), extract.parameters("content").alias("p"),
        extract.enum_values("content").alias("v"), extract.base_types("content").alias("b"),
    ).orderBy("k").collect()
    assert rows[0][1:10] == ("Возвращает длину строки в символах.", "Не учитывает хвост. Доступен, начиная с версии 8.3.6.", "Сервер, толстый клиент", "8.3.6.", False, "Число", "Длина строки.", "СтрДлина", "StrLen")
    assert rows[1][1:10] == ("Adds a value to the end of the array.", "none needed Deprecated since version 8.3.20", "Server", "8.3.20", True, "Number", "index of it", "Добавить", "Add")
    assert [(p.name, p.type, p.required, p.default_value) for p in rows[0].p] == [("Строка", "Строка", True, None), ("вторая", "Unknown", True, None), ("Режим", "Число", False, "1")]
    assert [tuple(x) for x in rows[2].v] == [("Красный", "тёплый")] and rows[2].b == ["Строка", "Число"]
    assert rows[3].d == "It has some longer sentences in it." and rows[3].r == "Unknown" and rows[3].n == rows[3].a == ""
    assert rows[4].n == "" and rows[4].p == [] and rows[4].v == []


def test_stems_find_other_forms(spark):
    docs = spark.createDataFrame([(1, "открыть файл"), (2, "закрыть окно"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "файлы")], "query_id long, text string")
    assert search.sparse_topk(asked, docs).count() == 0
    assert [r.doc_id for r in search.sparse_topk(asked, docs, stem=stem_russian).collect()] == [1]
    assert {r.term for r in index.weights(docs, stops=["окно"], stem=stem_russian).collect()} == {"откр", "файл", "закр"}


def test_stored_statistics(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green tree tree tree")], "doc_id long, text string")
    index.save(docs, str(tmp_path / "s"))
    terms, totals = index.load(spark, str(tmp_path / "s"))
    asked = spark.createDataFrame([(0, "red fox")], "query_id long, text string")
    assert search.sparse_topk(asked, docs, stats=(terms, totals)).collect() == search.sparse_topk(asked, docs).collect()
    assert {(r.doc_id, r.term): round(r.weight, 6) for r in index.weighted(index.postings(docs), terms, totals).collect()}[1, "red"] == 1.401185
    with pytest.raises(ValueError, match="without documents"):
        index.save(docs.limit(0), str(tmp_path / "none"))


def test_search_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0]), (6, [-1.0, None])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0])], "query_id long, query array<float>")
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in search.dense_topk(q, rows, 5).collect()) == [(0, 3, 1.0, 1), (0, 5, 1.0, 2), (3, 4, 1.0, 1)]
    assert search.dense_topk(q, rows.limit(0)).count() == 0 and search.dense_topk(q.limit(0), rows).count() == 0
    docs = spark.createDataFrame([(i, "same words") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "words"), (1, None), (2, "zzz")], "query_id long, text string")
    assert [r.doc_id for r in search.sparse_topk(asked, docs.repartition(7), 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert search.sparse_topk(asked, docs.limit(0)).count() == 0


def test_deep_contents(spark):
    rows = spark.createDataFrame([(i, i - 1) for i in range(1, 45)] + [(100, 99)], "id long, parent_id long")
    found = {r.id: (r.level, r.path) for r in toc_paths(rows).collect()}
    assert len(found) == 44 and found[44] == (43, "/".join(map(str, range(1, 45))))
    with pytest.raises(ValueError, match="circle"):
        toc_paths(spark.createDataFrame([(1, 0), (2, 1), (1, 2)], "id long, parent_id long")).count()


def test_a_broken_table_is_no_missing_one(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert c.read("none") is None and not c.exists("none")
    (tmp_path / "empty").mkdir()
    with pytest.raises(AnalysisException):
        c.read("empty")
    rows = spark.createDataFrame([(1, "8.3.1", "x")], "id long, platform_version string, t string")
    c.upsert("t", rows)
    c.remove("t")
    assert not c.exists("t")


def test_settings_of_columns(spark):
    assert spark.range(1).select(extract.texts_of(F.lit("Note: a\n\nNote: bcd"), "notes", least=1)).first()[0] == ["bcd"]
