"""Golden cases of the domain: prices, texts, headings, currencies, versions, matching, requests, files."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tariffloom.functions import prices, similarity, text
from tariffloom.operators import assistant, fx, match, tables, validate, versioning
from tariffloom.sources import files

CELLS = [
    ("12 000", 12000.0, "KZT"), ("12000,00", 12000.0, "KZT"), ("12 000 ₸", 12000.0, "KZT"), ("15 000 тг", 15000.0, "KZT"), ("$120", 120.0, "USD"), ("120 USD", 120.0, "USD"), ("1 500 руб", 1500.0, "RUB"),
    ("—", None, "KZT"), ("-", None, "KZT"), ("договорная", None, "KZT"), ("", None, "KZT"), ("A02.004.000.1", None, "KZT"), ("10 80С", 10800.0, "KZT"), ("6 00(", 6000.0, "KZT"), ("12,000.50", 12000.5, "KZT"), ("1.234.567", 1234567.0, "KZT"),
]


def test_price_cells(spark):
    df = spark.createDataFrame([(c,) for c, _, _ in CELLS], "c string").select("c", prices.price(F.col("c")).alias("v"), prices.currency(F.col("c")).alias("k"))
    assert {(r.c, r.v, r.k) for r in df.collect()} == set(CELLS)


def test_normalise(spark):
    cases = {"  Общий   АНАЛИЗ  крови!! ": "общий анализ крови", "ёлка": "елка", "ЭКГ (с расшифровкой)": "экг с расшифровкой", "": "", None: ""}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.normalise(F.col("c")).alias("n"))
    assert {r.c: r.n for r in df.collect()} == cases


def test_lists_and_names(spark):
    df = spark.range(1).select(
        text.split_synonyms(F.lit("ОАК; оак, CBC ;; x")).alias("s"), text.split_path(F.lit("A > B/ C")).alias("p"), text.business_id(F.lit("БИН 123456789012")).alias("b"), text.format_kzt(F.lit(12500.9)).alias("f"),
        text.median(F.array(*(F.lit(x).cast("decimal(14,2)") for x in (3, 1, 2, 10)))).alias("m"), text.safe_filename(F.lit("../a b?.pdf")).alias("n"), text.price_range(F.lit(10.2), F.lit(10.4)).alias("r"),
    ).first()
    assert (df.s, df.p, df.b, df.f, float(df.m), df.n, df.r) == (["ОАК", "CBC", "x"], ["A", "B", "C"], "123456789012", "12 500 ₸", 2.5, "a_b_.pdf", "10 ₸")


def test_file_names(spark):
    cases = {"Клиника_Сункар_прайс_2025-01-15.pdf": ("Клиника Сункар", "2025-01-15"), "Клиника 1 2026.pdf": ("Клиника 1", "2026-01-01"), "x 31.12.2024.xlsx": ("x", "2024-12-31"), "price.pdf": (None, None)}
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", prices.filename_partner(F.col("c")).alias("p"), prices.filename_date(F.col("c")).cast("string").alias("d"))
    assert {r.c: (r.p, r.d) for r in df.collect()} == cases


def test_headings(spark):
    cases = [("РАЗДЕЛ 1. ОБЩЕЕ", False, True), ("Консультации:", False, True), ("ЛАБОРАТОРНАЯ ДИАГНОСТИКА", False, True), ("ОАК", False, False), ("Кардиология:", True, False)]
    df = spark.createDataFrame(cases, "name string, price boolean, want boolean")
    got = df.select("want", prices.is_item_header(F.col("name"), text.normalise(F.col("name")), F.col("price"), F.lit(False)).alias("is"))
    assert all(r["want"] == r["is"] for r in got.collect())
    depth = {"Лаборатория": 0, "Диагностика": 0, "ПРОЧЕЕ": 0, "Анализ крови": 1, "Прочее:": 1, "Гормоны": 2}
    got = spark.createDataFrame([(k,) for k in depth], "k string").select("k", prices.section_depth(F.col("k")).alias("d"))
    assert {r.k: r.d for r in got.collect()} == depth


def test_section_stack(spark):
    heads = [("Лаборатория", 0), ("Анализ крови", 1), ("Гормоны", 2), ("Биохимия", 2), (None, None), ("Диагностика", 0), (None, None)]
    df = spark.createDataFrame([("t", n, a, b) for n, (a, b) in enumerate(heads)], "table_id string, row_idx int, label string, depth int")
    got = {r.row_idx: r.section_path for r in tables.section_paths(df).collect()}
    assert got[4] == ["Лаборатория", "Анализ крови", "Биохимия"] and got[6] == ["Диагностика"]


def test_priced_rows(spark):
    t = [["Прайс", "", "", ""], ["Код", "Наименование", "Цена резидент", "Цена нерезидент"], ["ЛАБОРАТОРИЯ", "", "", ""], ["U10", "- УЗИ брюшной полости", "8000", "12 000"], ["", "Осмотр", "—", ""], ["", "Итого", "1", ""]]
    df = spark.createDataFrame([("t", n, c, None) for n, c in enumerate(t)], "table_id string, row_idx int, cells array<string>, hint int")
    got = {r.service_name_raw: r for r in tables.priced_rows(df).collect()}
    assert set(got) == {"УЗИ брюшной полости", "Осмотр"}
    one = got["УЗИ брюшной полости"]
    assert (one.code, one.price_resident, one.price_nonresident, one.section_path) == ("U10", 8000.0, 12000.0, ["ЛАБОРАТОРИЯ"])
    assert got["Осмотр"].price_resident is None


RATES = [("USD", "2023-01-01", 462.0), ("USD", "2025-04-01", 505.0), ("USD", "2025-07-01", 512.0)]


def test_rates(spark):
    days = {"2025-04-15": 505.0, "2025-05-20": 505.0, "2020-01-01": 462.0, None: 500.0}
    df = spark.createDataFrame([(d, "USD") for d in days] + [("2025-01-01", "KZT"), ("2025-01-01", "EUR")], "d string, currency string").withColumn("effective_date", F.col("d").cast("date"))
    got = fx.with_rate(df, fx.rates_table(spark, RATES)).collect()
    assert {r.d: r.fx_rate for r in got if r.currency == "USD"} == days
    assert {r.fx_rate for r in got if r.currency != "USD"} == {1.0}


def test_validation(spark):
    rows = [("a", "USD", "100", None, "2025-04-15"), ("   ", "KZT", "1", None, None), ("b", "KZT", "abc", None, None), ("c", "KZT", "5000", "4000", None), ("d", "??", "10", None, "2031-01-01")]
    df = spark.createDataFrame(rows, "service_name_raw string, currency string, price string, price_nonresident string, d string").withColumn("effective_date", F.col("d").cast("date"))
    got = {r.service_name_raw: r for r in validate.validate(df, fx.rates_table(spark, RATES), "2030-01-01").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert float(got["a"].resident_kzt) == 50500.0 and float(got["a"].price_original) == 100.0 and got["a"].flags == []
    assert got["b"].flags == ["INVALID_PRICE"] and got["b"].needs_review and got["c"].flags == ["NONRESIDENT_LT_RESIDENT"]
    assert got["d"].flags == ["FUTURE_DATE"] and not got["d"].needs_review and got["d"].currency == "KZT"


STORED = "item_id string, partner_id int, service_name_raw string, effective_date date, price decimal(14,2), version int, is_active boolean, previous_item_id string, is_anomaly boolean"


def test_snapshot_merge(spark):
    day = dt.date
    stored = spark.createDataFrame([("a", 1, "x", day(2024, 1, 1), 5000, 1, True, None, False)], STORED.replace("decimal(14,2)", "int")).withColumn("price", F.col("price").cast("decimal(14,2)"))
    new = spark.createDataFrame([("b", 1, " x ", day(2025, 1, 1), 9000), ("c", 1, "x", day(2025, 1, 1), 5100), ("d", 1, "y", None, 1)], "item_id string, partner_id int, service_name_raw string, effective_date date, price int").withColumn("price", F.col("price").cast("decimal(14,2)"))
    got = {r.item_id: r for r in versioning.snapshot_merge(stored, new).collect()}
    assert (got["b"].version, got["b"].previous_item_id, got["b"].is_anomaly, got["b"].is_active) == (2, "a", True, True)
    assert (got["c"].version, got["c"].is_anomaly, got["c"].is_active) == (2, False, True)  # rows of one document don't see each other
    assert not got["a"].is_active and got["d"].version == 1


def test_reconcile(spark):
    rows = [("a", 1, 7, "x", "2025-06-01", 1, False), ("b", 1, 7, "x", "2025-01-01", 2, False), ("c", 1, 7, "x", "2024-01-01", 3, True), ("d", 1, 8, "y", None, 1, False)]
    df = spark.createDataFrame(rows, "item_id string, partner_id int, service_id int, service_name_raw string, d string, version int, is_active boolean").withColumn("effective_date", F.col("d").cast("date"))
    assert {r.item_id for r in versioning.reconcile(df).collect() if r.is_active} == {"a"}


def test_similarity():
    assert similarity.ratio("abc", "abc") == 100 and similarity.ratio("", "a") == 0 and round(similarity.ratio("this is a test", "this is a test!"), 2) == 96.55
    assert similarity.token_set("fuzzy fuzzy was a bear", "fuzzy was a bear") == 100 and similarity.partial("yankees", "new york yankees") == 100
    assert similarity.fuzzy("ремонт автомобиля", "общий анализ крови") < 0.6


SERVICES = [("s1", "Общий анализ крови", ["ОАК"]), ("s2", "Консультация врача-терапевта", []), ("s3", "Рентгенография органов грудной клетки", []), ("s4", "УЗИ органов брюшной полости", ["УЗИ ОБП"])]


def test_cascade(spark):
    services = spark.createDataFrame([(*s, True) for s in SERVICES], "service_id string, service_name string, synonyms array<string>, is_active boolean")
    names = ["Общий анализ крови", "ОАК", "УЗИ ОБП", "Общий анализ крови (расширенный)", "ренген органов грудной клетки", "ремонт автомобиля", "—", ""]
    got = {r.raw: r for r in match.cascade(spark.createDataFrame([(n,) for n in names], "raw string"), services).collect()}
    assert (got["Общий анализ крови"].method, got["Общий анализ крови"].status) == ("exact", "matched_auto")
    assert (got["ОАК"].method, got["ОАК"].service_id, got["УЗИ ОБП"].service_id) == ("synonym", "s1", "s4")
    assert got["Общий анализ крови (расширенный)"].service_id == "s1" and got["ренген органов грудной клетки"].service_id == "s3"
    assert got["ремонт автомобиля"].service_id is None and got["ремонт автомобиля"].status == "unmatched"
    assert got["—"].method == "none" and got["—"].candidates is None


REQUESTS = [
    ("Нужен анализ крови в Алматы дешевле 5000 тенге для нерезидента", {"intent": "find_service", "topic": "анализ крови", "city": "Алматы", "max_price": 5000, "resident": "nonresident", "sort": "cheapest", "language": "ru"}),
    ("покажи топ 3 узи от 2000 до 8000", {"min_price": 2000, "max_price": 8000, "limit": 3, "topic": "узи"}), ("консультация терапевта не дороже 8000", {"max_price": 8000, "min_price": None}),
    ("МРТ под 50к", {"max_price": 50000}), ("blood test under 100 usd", {"max_price": 50000}), ("клиники в Шымкенте", {"city": "Шымкент", "intent": "find_partner"}), ("cheapest MRI brain in Astana", {"language": "en", "city": "Астана", "sort": "cheapest"}),
    ("привет", {"intent": "unknown"}), ("", {"intent": "unknown"}), ("анализ не дешевле 5000", {"min_price": 5000, "max_price": None}), ("узи в астане дешевле 8000", {"city": "Астана", "max_price": 8000, "min_price": None}),
    ("семейный врач до 5000", {"city": None, "max_price": 5000}), ("узи живот 3000", {"min_price": None, "max_price": None}), ("узи до " + "9" * 40, {"max_price": None}), ("недорого узи", {"sort": "expensive"}), ("cheap узи", {"sort": "cheapest"}),
]


@pytest.mark.parametrize("message, wanted", REQUESTS)
def test_requests(message, wanted):
    got = assistant.parse(message)
    assert {k: getattr(got, k) for k in wanted} == wanted


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Наименование</t></is></c><c r="B1" t="inlineStr"><is><t>Цена</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>ЭКГ</t></is></c><c r="B2"><v>1500</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_archive_to_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/прайс.xlsx", workbook())
        z.writestr("../bad.xlsx", b"x")
        z.writestr("empty.pdf", b"")
        z.writestr("note.txt", b"x")
    entries = files.zip_entries(files.binary(spark, f"file://{tmp_path}/a.zip"))
    assert [r.name for r in entries.select("name").collect()] == ["in/прайс.xlsx"]
    assert entries.select(files.detect_format(F.col("name"), F.col("content")).alias("f")).first().f == "xlsx"
    rows = tables.priced_rows(files.tables(entries)).collect()
    assert [(r.service_name_raw, r.price_resident) for r in rows] == [("ЭКГ", 1500.0)]
