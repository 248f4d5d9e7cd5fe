"""Small cases of the functions and operators, with values worked out from their definitions."""

import math
import struct
import zipfile
from datetime import datetime, timedelta
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from fathomline.api import Engine, checked
from fathomline.functions import ids, vectors, versions
from fathomline.functions.text import stem_russian, stemmed, stop_words, tokens
from fathomline.operators import catalog, elements, extract, hygiene, index, progress, search
from fathomline.sources import archive


def test_bm25_of_three_documents(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green tree tree tree")], "doc_id long, text string")
    found = {(r.doc_id, r.term): r.weight for r in index.weights(docs).collect()}
    expected = {(1, "red"): 1.401185, (1, "fox"): 0.470004, (2, "blue"): 0.980829, (2, "fox"): 0.470004, (3, "green"): 0.980829, (3, "tree"): 1.634715}
    assert found.keys() == expected.keys() and all(math.isclose(found[k], v, abs_tol=1e-6) for k, v in expected.items())
    q = spark.createDataFrame([(0, "red fox"), (1, "zzz")], "query_id long, text string")
    assert [(r.query_id, r.doc_id, r.score) for r in search.sparse_topk(q, docs).orderBy("rank").collect()] == [(0, 1, 1.595226), (0, 2, 0.220903)]
    assert {r.term: r.term_index for r in index.vocabulary(index.token_rows(docs)).collect()} == {"blue": 0, "fox": 1, "green": 2, "red": 3, "tree": 4}


@pytest.mark.parametrize(("boost", "expected"), [(1.0, [("a", 0.032266), ("c", 0.032266), ("b", 0.016129), ("d", 0.016129)]), (0.5, [("c", 0.02433), ("a", 0.02407), ("d", 0.016129), ("b", 0.008065)])])
def test_fusion(spark, boost, expected):
    ranked = lambda s: spark.createDataFrame([(0, x, 1.0 / i, i) for i, x in enumerate(s, 1)], "query_id long, doc_id string, score double, rank int")
    assert [(r.doc_id, r.score) for r in search.rrf(ranked("abc"), ranked("cda"), boost=boost).orderBy("rank").collect()] == expected
    one = search.rrf(ranked("abc").limit(0), ranked("cda")).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in one] == [("c", 1.0), ("d", 0.5), ("a", 0.333333)]


def test_blocks_of_queries_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} w{i}") for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"w{i} w{i % 3}") for i in range(9)], "query_id long, text string")
    run = lambda size: sorted(map(tuple, search.in_blocks(q, lambda b: search.sparse_topk(b, docs, 5), size).collect()))
    assert run(100) == run(2)


def test_ids_and_codec(spark):
    names = ["8.3.26_method_Запрос.Выполнить", "8.3.26_constructor_Новый Массив", "8.3.24_method_Запрос.Выполнить"]
    d = spark.createDataFrame([(n,) for n in names], "s string").select(ids.element_key("s").alias("k"))
    assert [r.k for r in d.collect()] == [454640577879279743, 466951522496761652, 902418296812940990]
    d = spark.createDataFrame([("method_Type_Do",), ("function_Len",), ("property_A_B_C",), ("x",)], "s string").select(ids.parse_id("s").alias("p")).select("p.*")
    assert [tuple(r) for r in d.collect()] == [("method", "Type", "Do"), ("function", None, "Len"), ("property", "A_B", "C"), (None, None, None)]


def test_best_source_does_not_depend_on_partitions(spark):
    paths = ["objects/o/object1.html", "a/methods/m.html", "b/methods/m.html", "a/events/e.html"]
    d = spark.createDataFrame([(1, p, i) for i, p in enumerate(paths)], "id long, path string, seq long")
    for n in (1, 3):
        assert elements.best_source(d.repartition(n)).first().path == "a/methods/m.html"


def test_versions(spark):
    raw = ["8.3.26", " 8.3.26 ", "8_3_26", "8.3.24.1467", "8.3", "abc", ""]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string").select("i", versions.normalized("v").alias("n"), versions.collection_name("v").alias("c"))
    assert [r.n for r in d.orderBy("i").collect()] == ["8.3.26", "8.3.26", "8.3.26", "8.3.24", None, None, None]
    assert versions.normalize("8_3_26") == "8.3.26"
    with pytest.raises(ValueError):
        versions.normalize("8.3")
    d = spark.createDataFrame([("8.3.9",), ("8.3.26",), ("8.3.24",)], "version string")
    assert [r.version for r in versions.ordered(d).collect()] == ["8.3.26", "8.3.24", "8.3.9"]
    there = ["8.3.9", "8_3_26", "8.2.19"]
    assert versions.resolve(there, "8.2") == "8.2.19" and versions.resolve(there, "9.9.9", None, "8.3.9") == "8.3.9" and versions.resolve(there) == "8.3.26" and versions.resolve([]) is None


def test_tokens_stop_words_and_stems(spark):
    assert spark.range(1).select(tokens(F.lit("Для Файл_1, и файлы!"), stop_words(spark))).first()[0] == ["файл_1", "файлы"]
    # Pairs of the published algorithm's vocabulary.
    pairs = {"важная": "важн", "вечерами": "вечер", "красивейший": "красив", "читавшись": "чита", "длина": "длин", "the": "the"}
    assert {w: stem_russian(w) for w in pairs} == pairs
    d = spark.createDataFrame([(["важная", "the"],), (None,)], "t array<string>").select(stemmed("t").alias("s"))
    assert [r.s for r in d.collect()] == [["важн", "the"], None]


def test_archive_round_trip_and_broken_ones(spark, tmp_path):
    body = BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("objects/a/methods/x1.html", "<h1>X</h1>Описание: И".encode())
        z.writestr("objects/a/methods/old.html", "Параметры".encode("cp1251"))
        z.writestr("objects/a/methods/Description1.html", "Описание")
        z.writestr("misc/a.html", "Описание")
        z.writestr("objects/l.html", "license Описание")
    toc = BytesIO()
    with zipfile.ZipFile(toc, "w") as z:
        z.writestr("toc", '{1,0,2,2,3,{"ru","a,b"}},{2,1,0,"x"},{3,1,0}')
    data = archive.container({"FileStorage": body.getvalue(), "PackBlock": toc.getvalue()})
    (tmp_path / "v" / "8.3.26").mkdir(parents=True)
    (tmp_path / "v" / "8.3.26" / "a_ru.hbk").write_bytes(data)
    (tmp_path / "v" / "8.3.26" / "b_ru.hbk").write_bytes(data[:70])
    (tmp_path / "v" / "8.3.26" / "c_ru.hbk").write_bytes(b"zzzz" * 20)
    found = {r.path: r.html for r in archive.read_pages(spark, str(tmp_path)).collect()}
    assert found == {"objects/a/methods/x1.html": "<h1>X</h1>Описание: И", "objects/a/methods/old.html": "Параметры"}
    rows = archive.read_toc(spark, str(tmp_path)).select("id", "parent_id", "child_ids")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, [2, 3]), (2, 1, []), (3, 1, [])]
    assert {r.path for r in archive.toc_paths(rows).collect()} == {"1", "1/2", "1/3"}
    assert list(archive.toc_rows("{1,0,0}", commas=False)) == [] and list(archive.toc_rows("{1}")) == []
    unused = bytearray(data)
    struct.pack_into("<I", unused, 16 + 31 + 8, 0)
    assert set(archive.entities(bytes(unused))) == {"PackBlock"}
    dirs = catalog.version_dirs(spark, str(tmp_path))
    assert [(r.version, r.n_files) for r in dirs.collect()] == [("8.3.26", 3)]


def test_page_types(spark):
    rows = [("a/methods/m1.html", "x", "", "function"), ("a/ctors/c2.html", "x", "", "constructor"), ("a/properties/p1.html", "x", "", "property"), ("x/enums/e1.html", "x", "", "enum"),
            ("x/objects/o1.html", "x", "", "object"), ("objects/o1.html", "x", "Методы: a", "object"), ("g.html", "Глобальный контекст.Длина", "Синтаксис: Методы:", "function"),
            ("i.html", "Index", "text", "index"), ("u.html", "x", "text", "unknown")]
    d = spark.createDataFrame(rows, "path string, title string, content string, expected string").withColumn("type", extract.page_type("path", "title", "content"))
    assert all(r.type == r.expected for r in d.collect())


def test_signatures_examples_related(spark):
    d = spark.createDataFrame([("Пример:\nА = 1;\nБ = Длина(А);\n\nСм. также: <a href=\"x\">Строка</a>\n\nМассив.Добавить(1)",)], "c string")
    r = d.select(extract.examples("c").alias("e"), extract.related("c", F.lit("Длина")).alias("r"), extract.signature("c", F.lit("Длина")).alias("s")).first()
    assert r.e == ["А = 1;\nБ = Длина(А);"] and r.s == "Длина(А)" and r.r == ["Строка", "Массив.Добавить", "Добавить"]


def test_marked_pages(spark, tmp_path):
    h = ("<h1>Массив (Array)</h1><p class='V8SH_chapter'>Параметры:</p><div class='V8SH_rubric'><p>&lt;Кол&gt; (необязательный)</p></div>Тип: <a href='x'>Число</a>. Размер массива."
         "<div class='V8SH_rubric'>&lt;Вид&gt;</div>Тип: <a>Строка</a><p class='V8SH_chapter'>Пример:</p><pre>А = Новый Массив;<br>Б = 1;</pre>"
         "<a href='methods/Add1.html'>Добавить (Add)</a><a href='methods/Add1.html'>Добавить</a><a href='ctors/c.html'>По размеру</a><a href='properties/p.html'>Длина</a>")  # fmt: skip
    pages = spark.createDataFrame([("x/objects/o1.html", h, 0)], "path string, html string, seq long")
    r = pages.select(extract.marked_parameters("html", extract.content("html")).alias("p"), extract.marked_examples("html", extract.content("html")).alias("e")).first()
    assert [(x.name, x.type, x.required) for x in r.p] == [("Кол", "Число", False), ("Вид", "Строка", True)] and r.e == ["А = Новый Массив;\nБ = 1;"]
    e = Engine(spark, str(tmp_path / "m"), stops=[])
    items = e.page_items(pages).unionByName(e.member_items(pages))
    found = {(x.element_type, x.element_name, x.parent_type) for x in items.collect()}
    assert found == {("type", "Массив", None), ("method", "Добавить", "Массив"), ("property", "Длина", "Массив"), ("constructor", "Новый", "Массив")}


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    rows = [("method", "Добавить", "Add", "Массив", "Добавляет значение", "a/methods/m.html", 0), ("type", "Массив", "Array", None, "Список значений", "x/objects/o.html", 1),
            ("property", "Длина", "Length", "Строка", "Число символов", "a/properties/p.html", 2), ("constructor", "Новый", "New", "Массив", "по размеру", "a/ctors/c.html", 3),
            ("constructor", "Новый", "New", "Массив", "по образцу", "a/ctors/d.html", 4), ("function", "Длина", "Len", None, "Длина строки", "g.html", 5)]
    items = spark.createDataFrame(rows, "element_type string, element_name string, element_name_en string, parent_type string, content string, path string, seq long")
    with pytest.raises(LookupError):
        e.search("x")
    assert e.index(items, "8_3_26") and not e.index(items, "8.3.26") and e.index(items.limit(1), "8.3.9")
    assert {tuple(r)[:2] for r in e.manage("info").collect()} == {("8.3.26", 5), ("8.3.9", 1)}
    assert e.version() == "8.3.26"
    e.manage("set_default", "8.3.9")
    assert e.version() == "8.3.9" and e.version("8.3.26") == "8.3.26"
    e.manage("clear_default")
    assert e.search("значение").first().title == "Массив.Добавить"
    assert [r.element_type for r in e.type_members("Массив").collect()] == ["constructor", "method"]
    assert e.type_constructors("Массив").first().content == "по размеру"
    assert e.get_element("Длина").first().element_type == "property" and e.get_element(element_id="method_Массив_Добавить").first().element_name_en == "Add"
    assert [(r.stage, r.score) for r in e.search_elements("Длина").collect()] == [(1, 1.0), (1, 1.0)]
    assert [(r.stage, r.score) for r in e.search_elements("Массив.Добавить").collect()] == [(2, 1.0)]
    assert {r.stage for r in e.search_elements("Arr").collect()} <= {3, 4}
    e.catalog.upsert("elements", e.elements().filter("element_type = 'type'").withColumn("content", F.lit("new")))
    assert e.get_element("Массив").first().content == "new" and e.elements().count() == 5
    for bad in (("", 1), ("x", 0), ("x", 101)):
        with pytest.raises(ValueError):
            checked(*bad)


def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert index.weights(none).count() == 0 and index.vocabulary(index.token_rows(none)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.term, r.tf) for r in index.postings(odd).collect()] == [(None, "a", 1)]
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>")
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in search.dense_topk(q, rows).collect()] == [(2, 1.0)]
    assert vectors.encode(None) == [0.0] * 64
    assert hygiene.leaks(odd).agg(F.sum("n_email")).first()[0] == 0


def test_status():
    now = datetime(2024, 1, 1)
    s = progress.Status().to("parsing", now, total=10).to("vectorizing", now, current=4)
    assert s.started == now and s.remaining(now + timedelta(seconds=8)) == 12.0
    with pytest.raises(ValueError):
        s.to("lost", now)


def test_stream_refresh_and_windows(spark, tmp_path):
    from fathomline.streaming.refresh import refresh, windowed

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "8.3.1", "a"), (2, "8.3.1", "b")], "id long, platform_version string, content string").write.parquet(src)
    c = catalog.Catalog(spark, str(tmp_path / "w"))
    for _ in range(2):
        refresh(spark.readStream.schema("id long, platform_version string, content string").parquet(src), c, str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(1, "8.3.1", "new")], "id long, platform_version string, content string").write.mode("append").parquet(src)
    assert {(r.id, r.content) for r in c.read("elements").collect()} == {(1, "new"), (2, "b")}
    e = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "a", 1.0), (datetime(2024, 1, 1, 0, 50), "a", 2.0)], "ts timestamp, event_type string, value double")
    assert [(r.n, r.total) for r in windowed(e).collect()] == [(2, 3.0)]
