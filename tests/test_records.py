"""Whole records of pages, the elements of them, export, metadata, counters."""

import json

import pytest
from fathomline.api import Engine
from fathomline.operators import records as rec

CHAPTER = '<p class="V8SH_chapter">'


def page(title, body):
    return f"<html><head><title>x</title></head><body><h1>{title}</h1>{body}</body></html>"


PAGES = (
    ("/objects/array/methods/Add1.html", page("Массив.Добавить (Array.Add)", f'{CHAPTER}Синтаксис:</p>Добавить(&lt;Значение&gt;)<br>{CHAPTER}Параметры:</p><div class="V8SH_rubric">&lt;Значение&gt; (необязательный)</div>Тип: <a href="x">Произвольный</a>. Добавляемое значение.{CHAPTER}Описание:</p>Добавляет элемент в конец массива.\n\n')),
    ("/objects/array/ctors/New1.html", page("Массив.По количеству", f'{CHAPTER}Синтаксис:</p>Новый Массив(&lt;Количество&gt;)<hr>{CHAPTER}Описание:</p>Создаёт массив указанной длины.')),
    ("/objects/map/ctors/New2.html", page("Новый Соответствие", "Параметры:\nКлюч (Строка) - ключ\nЧисло - необязательный\n\nОписание: Создаёт пустое соответствие значений.")),
    ("/objects/x/ctors/New3.html", page("По умолчанию", "Синтаксис: Новый Структура\n\nОписание: Создаёт пустую структуру.")),
    ("/objects/Form/properties/Title1.html", page("Заголовок", "Описание: Заголовок формы, который видит пользователь.\n\nТип: Строка. Только чтение.")),
    ("/objects/Form/properties/Items2.html", page("Форма.Элементы (Form.Items)", f'{CHAPTER}Тип:</p> <a href="y">ВсеЭлементы</a>. Все элементы формы.')),
    ("/objects/catalog1/object2.html", page("Таблица (Table)", '\n\nМетоды:\nОчистить (Clear) - удаляет строки\nНайти (Find)\n\nСвойства:\nИндексы (Indexes) - Тип: Коллекция. Только чтение\n\n<a href="v/methods/Sort9.html">Сортировать (Sort)</a> <a href="v/methods/Find9.html">Найти (Find)</a><a href="v/ctors/c1.html">Основной</a>\nСортировать(Колонки) - упорядочивает строки\n')),
    ("/enums/Color.html", page("Перечисление Цвет (Color)", "Значения:\nКрасный: тёплый\n2: холодный\n\n")),
    ("/global/StrLen.html", page("Глобальный контекст.СтрДлина (Global context.StrLen)", "Описание: Возвращает длину строки.\n\nПараметры:\nСтрока (Строка) - исходная\nРежим (Число) - необязательный")),
    ("/about.html", page("About", "Words.")),
    ("/empty.html", ""),
    ("/null.html", None),
)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(p, h, i) for i, (p, h) in enumerate(PAGES)], "path string, html string, seq int")


def test_records(spark, pages):
    r = rec.records(pages).orderBy("seq").collect()
    assert [x.element_type for x in r] == ["method", "constructor", "constructor", "constructor", "property", "property", "type", "enum", "function", None, None, None]
    add = r[0]
    assert (add.element_name, add.element_name_en, add.parent_type, add.signature) == ("Добавить", "Add", "Массив", "Добавить(<Значение>)")
    assert [(p.name, p.type, p.required) for p in add.parameters] == [("Значение", "Произвольный", False)]
    assert add.description.startswith("Добавляет элемент")
    assert [(x.parent_type, x.signature) for x in r[1:4]] == [("Массив", "Новый Массив(<Количество>)"), ("Соответствие", "Новый Соответствие(<Ключ> (Строка), [<Число>])"), ("Структура", "Новый Структура()")]
    assert [(x.element_name, x.parent_type, x.return_type, x.read_only, x.write_only) for x in r[4:6]] == [("Заголовок", "Form", "Строка", True, False), ("Элементы", "Форма", "ВсеЭлементы", False, False)]
    assert [(v.name, v.description) for v in r[7].enum_values][:1] == [("Красный", "тёплый")] and r[7].element_name == "Цвет"
    assert (r[8].element_name, r[8].parent_type, r[8].signature) == ("СтрДлина", None, "СтрДлина(Строка: Строка, [Режим: Число])")
    assert r[10].page_type == "unknown" and r[11].members is None


def test_members_of_a_type(spark, pages):
    m = {x.name: x for x in rec.records(pages).filter("element_type = 'type'").head().members}
    assert set(m) == {"Очистить", "Найти", "Сортировать", "Индексы", "Основной"}
    assert (m["Очистить"].name_en, m["Очистить"].description, m["Очистить"].signature) == ("Clear", "удаляет строки", "Очистить")
    assert (m["Сортировать"].signature, m["Сортировать"].description) == ("Сортировать(Колонки)", "упорядочивает строки")
    assert (m["Индексы"].type, m["Индексы"].read_only, m["Индексы"].element_type) == ("Коллекция", True, "property")


def test_items_and_export(spark, pages):
    found = rec.items(pages)
    names = {(r.element_type, r.parent_type, r.element_name) for r in found.collect()}
    assert {("type", None, "Таблица"), ("method", "Таблица", "Найти"), ("constructor", "Таблица", "Новый"), ("method", "Массив", "Добавить"), ("unknown", None, "About")} <= names
    one = json.loads(rec.exported(found.filter("element_name = 'Добавить'"), "8.3.20", "a.hbk").head().record)
    assert list(one) == ["element_type", "name", "name_en", "full_name", "parent_type", "description", "platform_version", "file_path", "hbk_source", "hbk_html_path", "details", "search_text"]
    assert one["full_name"] == "Массив.Добавить" and one["details"]["signature"] == "Добавить(<Значение>)" and "Произвольный" not in one["name"] and one["search_text"].startswith("Добавить Add Массив.Добавить")
    meta = {r.path: json.loads(r.metadata) for r in rec.metadata(rec.records(pages)).collect()}
    assert meta["/about.html"] == {"type": "unknown"} and meta["/enums/Color.html"]["enums"][0]["name"] == "Цвет"
    assert set(meta["/objects/catalog1/object2.html"]["objects"][0]["methods"]) == {"Очистить", "Найти", "Сортировать"}


def test_counts(spark, pages):
    r, seen = rec.page_counts(pages)
    assert r.count() == len(PAGES)
    assert seen.get == {"rows": 12, "processed": 9, "skipped": 3, "with_members": 1}


def test_signatures_reach_the_index(spark, pages, tmp_path):
    engine = Engine(spark, str(tmp_path))
    assert engine.index(engine.page_items(pages), "8.3.20")
    hit = engine.get_element("Добавить", parent="Массив").head()
    assert hit.signature == "Добавить(<Значение>)" and "Значение" in hit.text and [p.name for p in hit.parameters] == ["Значение"]
    assert {r.element_name for r in engine.type_members("Таблица").collect()} == {"Очистить", "Найти", "Сортировать", "Индексы", "Новый"}
