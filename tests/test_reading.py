"""Operators that read documents: words with places, recognised text, hints, requests, catalogue labels."""

import pytest
from pyspark.sql import functions as F

from tariffloom.functions import prices, text
from tariffloom.plans import reading
from tariffloom.operators import assistant, catalogue, geometry, hints, match, tables


def values(spark, texts, use):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, t string").select("n", use(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.n)]


def test_price_groups(spark):
    cases = {"10 800": [10800], "8 800 II 000": [8800, 11000], "9000 тг 7000 тг": [9000, 7000], "148 500": [148500], "0": [], "": []}
    assert values(spark, cases, geometry.price_groups) == [list(map(float, v)) for v in cases.values()]


def test_split_price(spark):
    cases = {"УЗИ сустава 12 ООО": ("УЗИ сустава", [12000]), "прием 8 800 II 000": ("прием", [8800, 11000]), "CYFRA 21-1": ("CYFRA 21-1", []), "до 60": ("до 60", []), "слово": ("слово", [])}
    got = values(spark, cases, geometry.split_price)
    assert [(r["name"], r["prices"]) for r in got] == [(n, list(map(float, v))) for n, v in cases.values()]


def test_leading_code(spark):
    cases = {"U1.5 Прием": ("Прием", "U1.5"), "10401 25-ОН витамин Д": ("25-ОН витамин Д", "10401"), "17-ОН прогестерон": ("17-ОН прогестерон", None), "A1.2 B3.4 Осмотр": ("Осмотр", "A1.2"), "Анализ Q97.001 крови": ("Анализ крови", None)}
    assert [tuple(r) for r in values(spark, cases, geometry.leading_code)] == list(cases.values())


def test_running_names(spark):
    """A name on one line and its price on a later one, with a row's number and unit between; orphan prices; a filler alone."""
    lines = [(10, "Длинное название", None), (40, "1 услуга", None), (70, "для взрослых", "5000"), (100, "РАЗДЕЛ", None), (130, "2 Осмотр врача", None), (150, "", "7 000"), (190, "3 прием", "900")]
    rows = []
    for top, text, price in lines:
        x = 10.0
        for word in text.split():
            rows.append((1, x, x + 6 * len(word), float(top), word))
            x += 6 * len(word) + 4
        x = 400.0
        for word in (price or "").split():
            rows.append((1, x, x + 6 * len(word), float(top), word))
            x += 6 * len(word) + 4
    df = spark.createDataFrame(rows, "page_id long, x0 double, x1 double, top double, text string")
    got = [(r.service_name_raw, r.price_resident, r.section_path) for r in sorted(geometry.priced_lines(df).collect(), key=lambda r: r.line)]
    assert got == [("Длинное название для взрослых", 5000.0, []), ("Осмотр врача", 7000.0, ["РАЗДЕЛ"])]
    assert geometry.priced_lines(df.limit(0)).count() == 0


def page_of(spark, lines):
    rows = []
    for k, (text, price) in enumerate(lines):
        for x, part in ((10.0, text), (400.0, price or "")):
            for word in part.split():
                rows.append((1, x, x + 6 * len(word), 30.0 * k, word))
                x += 6 * len(word) + (4 if part is text else 40)
    found = geometry.priced_lines(spark.createDataFrame(rows, "page_id long, x0 double, x1 double, top double, text string"))
    return [(r.service_name_raw, r.price_resident, r.price_nonresident) for r in sorted(found.collect(), key=lambda r: r.line)]


def test_small_numbers(spark):
    """A small number goes only from before a price that is 10 or more."""
    assert page_of(spark, [("Осмотр врача", "3 4000 5000"), ("Прием врача", "3 4 5000"), ("Снимок кисти", "5"), ("Массаж спины", "70 80")]) == [
        ("Осмотр врача", 4000.0, 5000.0), ("Прием врача", 3.0, 4.0), ("Массаж спины", 70.0, 80.0),
    ]


def test_names_above(spark):
    """The last waiting name serves; a bare number joins what is below it; a number with a name and a section end the wait."""
    assert [n for n, _, _ in page_of(spark, [("Первое имя", None), ("Второе имя", None), ("", "5000")])] == ["Второе имя"]
    assert [n for n, _, _ in page_of(spark, [("Первое имя", None), ("1 услуга", None), ("второе имя", None), ("третье имя", "5000"), ("", "6000")])] == ["Первое имя второе имя третье имя"]
    assert [n for n, _, _ in page_of(spark, [("Первое имя", None), ("2 Другое имя", None), ("", "5000")])] == ["Другое имя"]
    assert page_of(spark, [("Первое имя", None), ("РАЗДЕЛ", None), ("", "5000")]) == []
    assert [n for n, _, _ in page_of(spark, [("Первое имя", None), ("Своё имя", "5000")])] == ["Своё имя"]


def test_lines_anchor_to_their_first_word(spark):
    tops = [0.0, 2.0, 2.9, 3.2, 5.9, 6.3, 10.0, None]
    rows = [(1, 10.0 * k, 10.0 * k + 5, t, f"w{k}") for k, t in enumerate(tops) if t is not None] + [(2, 0.0, 1.0, 5.0, "x"), (2, 0.0, 1.0, 5.0, "x"), (2, 3.0, 4.0, 5.0, " ")]
    found = geometry.lines(spark.createDataFrame(rows, "page_id long, x0 double, x1 double, top double, text string")).collect()
    assert sorted((r.page_id, r.top, r.line, r.line_top) for r in found) == [(1, 0.0, 0, 0.0), (1, 2.0, 0, 0.0), (1, 2.9, 0, 0.0), (1, 3.2, 1, 3.2), (1, 5.9, 1, 3.2), (1, 6.3, 2, 6.3), (1, 10.0, 3, 10.0), (2, 5.0, 0, 5.0), (2, 5.0, 0, 5.0)]


def test_hints(spark):
    text = "Прайс-лист от 05.03.2024\n\nТОО «Медлаб»\nБИН 123456789012 тел 8 701 123 45 67\na.b@c.kz\nг. Шымкент, ул. Мира, д. 5"
    h = values(spark, [text, None, "просто текст"], hints.header_hints)
    assert (h[0].partner_name, h[0].bin, h[0].phone, h[0].email, h[0].city, str(h[0].effective_date)) == ("ТОО «Медлаб", "123456789012", "8 701 123 45 67", "a.b@c.kz", "Шымкент", "2024-03-05")
    assert h[0].address.startswith("ул. Мира") and all(v is None for v in h[1]) and h[2].partner_name == "просто текст"


def test_cleaned_text(spark):
    assert values(spark, ["1О5 и слово", "Б О", "a\r\n\n\n\nb  c ", None], hints.cleaned_text) == ["105 и слово", "Б О", "a\n\nb c", ""]


def test_roles(spark):
    cases = [["№", "Код", "Наименование", "Цена"], ["Услуга", "Граждане РК", "Ближнее", "Дальнее зарубежье"], [], ["x", None]]
    rows = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n long, c array<string>").select("n", tables.column_roles(F.col("c")).alias("r")).collect()
    got = {r.n: r.r for r in rows}
    assert got[0] == {"index": 0, "code": 1, "name": 2, "resident": 3} and got[2] == {} and got[3] == {}
    assert got[1] == {"name": 0, "resident": 1, "nonresident": 3, "tier_near": 2, "tier_far": 3}


def test_deep_sections(spark):
    """As many depths as there are, whatever their numbers."""
    rows = [("t", n, f"h{n}", 5 * n) for n in range(40)] + [("t", 40, None, None), ("t", 41, "x", 3), ("t", 42, None, None)]
    got = {r.row_idx: r.section_path for r in tables.section_paths(spark.createDataFrame(rows, "table_id string, row_idx int, label string, depth int")).collect()}
    assert got[40] == [f"h{n}" for n in range(40)] and got[42] == ["h0", "x"]


def test_labels(spark):
    df = spark.createDataFrame([("Раздел 1.2 Общие", "зуб"), ("12) x", "УЗИ почек"), ("", "x")], "label string, name string")
    got = [r.c for r in df.select(catalogue.clean_category(F.col("label"), F.col("name")).alias("c")).collect()]
    assert got == ["Общие", "Лучевая диагностика", ""]


def test_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query, r.vec_id): r.score for r in match.cosine_top_k(df, df).collect()}
    assert got[1, 2] == 0 and got[2, 1] == 0 and round(got[2, 3], 6) == 0.707107


def test_price_let(spark):
    assert values(spark, ["1 234,5", "\u00a012\u00a0000", "1,234.50", "договорная", "A02.100", "12О0"], prices.price) == [1234.5, 12000.0, 1234.5, None, None, 1200.0]


@pytest.mark.parametrize("cheap_first, sort", [(False, "expensive"), (True, "cheapest")])
def test_sort_words(cheap_first, sort):
    assert assistant.parse("недорого узи", cheap_first=cheap_first).sort == sort


def test_city_note(spark):
    partners = spark.createDataFrame([(1, "P", "Астана (центр)", True)], "partner_id long, partner_name string, city string, is_active boolean")
    assert assistant.resolved_city(partners, "Астана") == "Астана (центр)" and assistant.resolved_city(partners, "Тараз") is None


def test_tables_compute_once(spark):
    """Roles, labels and prices are columns told once: they stand in no join's condition and in no filter, and no header's text is joined anew for each word."""
    found = tables.priced_rows(spark.createDataFrame([], "table_id long, row_idx int, cells array<string>, hint int"), levels=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000 and not any("lambda" in x for x in plan.splitlines() if "Join" in x)
    assert str(tables.header_score(F.col("c"))).count("transform(c") == 1


def test_tables_without_a_name(spark):
    """Where no header tells the name, the longest column with letters is it; other tables keep theirs."""
    rows = [(1, 0, ["Цена", ""]), (1, 1, ["500", "Осмотр врача"]), (1, 2, ["Приём", "7"]), (2, 0, ["x1", "-"]), (2, 1, ["Снимок кисти", "1 200"]), (3, 0, ["Услуга", "Цена"]), (3, 1, ["УЗИ", "длинное слово 5"])]
    found = tables.priced_rows(spark.createDataFrame([(t, n, c, None) for t, n, c in rows], "table_id long, row_idx int, cells array<string>, hint int"))
    assert sorted((r.table_id, r.row_idx, r.service_name_raw, r.price_resident) for r in found.collect()) == [(1, 1, "Осмотр врача", 500.0), (2, 0, "x1", None), (2, 1, "Снимок кисти", 1200.0), (3, 1, "УЗИ", 5.0)]


def test_words_meet_once(spark, sf):
    """Words are shuffled once, by page; the queries over made pages shuffle keys only, once as well."""
    words = spark.createDataFrame([(1, 1.0, 2.0, 3.0, "a")], "page_id long, x0 double, x1 double, top double, text string")
    for found in (geometry.priced_lines(words), geometry.scanned_rows(words), reading.geometry_rows(spark, sf), reading.scanned_rows(spark, sf)):
        plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") == 0 and found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_language_lowers_once(spark):
    cases = {"Привет": "ru", "hello, МИР": "en", "ҚАЗАҚ тілі": "kk", "12 !": None, None: None, "ab вг": "ru", "İi": "en"}
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(cases)], "n long, t string").select("n", text.language(F.col("t")).alias("v"))
    assert [r.v for r in sorted(rows.collect(), key=lambda r: r.n)] == list(cases.values())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_hints_lower_once(spark):
    """No text is lowered anew for each word that it is searched for."""
    rows = hints.with_header_hints(spark.createDataFrame([("Клиника «Ёж»\nг. нур-султан",), (None,)], "text string"))
    assert "contains(lower(" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [(r.partner_name, r.city) for r in rows.collect()] == [("Клиника «Ёж", "Нур-Султан"), (None, None)]
