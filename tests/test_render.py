"""Hits and elements as text."""

from fathomline.operators import render

HITS = "query_id long, rank int, score double, element_type string, element_name string, full_name string, parent_type string, content string, signature string, since_version string"


def test_entries_and_listings(spark):
    rows = [(0, 2, 0.5, "method", "Добавить", "Массив.Добавить", "Массив", "Синтаксис: Добавить(<Знач>)\nОписание", None, "8.3.5"), (0, 1, 0.75, "type", "Массив", None, None, "т" * 200, None, None),
            (1, 1, 1.0, "function", "Длина", "Длина", None, None, "Длина(" + "a" * 200, None)]
    d = {r["query_id"]: r["listing"] for r in render.listing(spark.createDataFrame(rows, HITS), queries=spark.range(3).withColumnRenamed("id", "query_id")).collect()}
    first = f"1. element_id: type_Массив | name: Массив | type: type | score: 0.750\n   Описание: {'т' * 150}..."
    second = "2. element_id: method_Массив_Добавить | name: Массив.Добавить | type: method | score: 0.500\n   Описание: Синтаксис: Добавить(<Знач>)\nОписание\n   Сигнатура: Добавить(<Знач>)\n   Родительский тип: Массив\n   Доступно с версии: 8.3.5"
    assert d[0] == f"{first}\n\n{second}\n\n{render.INEXACT}"
    assert d[1] == f"1. element_id: function_Длина | name: Длина | type: function | score: 1.000\n   Сигнатура: Длина({'a' * 94}" and d[2] == render.NOTHING


def test_cards(spark):
    cols = "element_type string, element_name string, full_name string, signature string, return_type string, return_description string, content string, examples array<string>, related array<string>, parameters array<struct<name:string,type:string,required:boolean,description:string>>"
    rows = [("method", "Добавить", "Массив.Добавить", "Добавить(<Знач>) Параметры: много", "Число", "Сколько стало", "о" * 600, ["a", "b", "c", "d"], [], [("Знач", "Строка", True, "д" * 120), ("Вид", "Число", False, "")]),
            ("function", "Длина", None, None, "Тонкий клиент", "веб", "", None, list("123456"), None), ("type", "Т", None, None, None, None, None, None, None, None)]
    got = [r["card"] for r in render.card(spark.createDataFrame(rows, cols)).collect()]
    assert got[0] == (
        "# Массив.Добавить\nТип: method\nСигнатура: Добавить(<Знач>)\nПараметры: \n   - Знач: Строка (обязательный)\n     " + "д" * 100 + "\n   - Вид: Число (необязательный)\n"
        "Возвращает: Тип: Число\n   Сколько стало\nОписание: " + "о" * 500 + "...\nПримеры: \n   a\n   b\n   c"
    )
    assert got[1] == "# Длина\nТип: function\nСм. также: \n   1\n   2\n   3\n   4\n   5" and got[2] == "# Т\nТип: type"


def test_three_places_are_those_of_printf(spark):
    numbers = [i * 0.0005 for i in range(-2100, 2100)] + [round(i * 0.0005, 6) for i in range(2100)] + [0.0625, 0.1235, 1234.5675, -0.0]
    d = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", render.three_places("x").alias("t"))
    assert [(r.x, r.t) for r in d.collect() if r.t != "%.3f" % r.x] == []
