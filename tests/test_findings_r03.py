"""Steps that findings of the third round named: same results by less work."""

import dataclasses
import datetime as dt
import io
import os
import random
import types
import zipfile

from pyspark.sql import functions as F

from tariffloom.functions import prices
from tariffloom.operators import assistant, geometry, hints, providers, versioning
from tariffloom.plans import archives, reading
from tariffloom.sources import files
from tariffloom.sources.keyed import KeyedTable
from tariffloom.streaming import ingest


def merged(stored, new):
    """snapshot_merge, row by row."""
    name = lambda r: None if r[2] is None else r[2].strip()
    better = lambda r: ({True: 0, False: 1, None: 2}[r[6]], -r[3].toordinal(), -r[5], r[0])
    added, gone = [], set()
    for r in new:
        key = (r[1], name(r))
        same = sorted((s for s in stored if s[6] and (s[1], name(s), s[3]) == (*key, r[3])), key=lambda s: (-s[5], s[0]))
        prior = sorted((s for s in stored if key[1] is not None and (s[1], name(s)) == key and s[3] is not None and s[3] != r[3]), key=better)
        old, best = (same or [None])[0], (prior or [None])[0]
        gone |= {x[0] for x in (old, best) if x and x[6]}
        odd = best is not None and None not in (r[4], best[4]) and best[4] != 0 and abs(r[4] - best[4]) > 0.5 * abs(best[4])
        added.append((r[0], (old or best or [0] * 6)[5] + 1, (old or best or [None])[0], True, odd))
    return sorted([(s[0], s[5], s[7], s[6] and s[0] not in gone, s[8]) for s in stored] + added)


def test_snapshot_merge_in_one_pass(spark):
    rng = random.Random(5)
    names, days = ["x", " x", "y ", "y", "z", None], [None, *(dt.date(2024, 1, k) for k in (1, 2, 3, 4))]
    row = lambda k: (k, rng.choice([1, 2, None]), rng.choice(names), rng.choice(days), rng.choice([0, 4, 5, 9, None]))
    stored = [(*row(f"s{k:03}"), rng.randint(1, 3), rng.random() < 0.4, None, False) for k in range(150)]
    new = [row(f"n{k:03}") for k in range(150)]
    kinds = "item_id string, partner_id int, service_name_raw string, effective_date date, price decimal(14,2)"
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds.replace("decimal(14,2)", "int")).withColumn("price", F.col("price").cast("decimal(14,2)"))
    found = versioning.snapshot_merge(frame(stored, kinds + ", version int, is_active boolean, previous_item_id string, is_anomaly boolean"), frame(new, kinds))
    got = sorted((r.item_id, r.version, r.previous_item_id, r.is_active, r.is_anomaly) for r in found.collect())
    assert got == merged(stored, new) and sum(r[3] for r in got) > 150
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Initial Plan")[0] and plan.split("Initial Plan")[0].count("Exchange") <= 2


def test_files_are_read_in_batches(spark, monkeypatch):
    """A file that breaks on its second sheet gives no rows, rows keep what they came with, whatever is passed on at once."""
    book = lambda n: archives.workbook({"sheet1": [[f"{n}-{k}", None, k] for k in range(n)]})
    with zipfile.ZipFile(io.BytesIO(archives.workbook({"sheet1": [["a"]]}))) as z:
        broken = archives.packed({n: z.read(n) for n in z.namelist()} | {"xl/worksheets/sheet2.xml": "<worksheet><row>"})
    members = {f"{n}.xlsx": book(n) for n in range(7)} | {"bad.xlsx": broken, "x.docx": archives.letter([["b", "c"]])}
    zips = [("one.zip", bytearray(archives.packed(members))), ("none.zip", bytearray(b"PK")), ("two.zip", bytearray(archives.packed({"2.xlsx": book(2)})))]
    rows = lambda: files.tables(files.zip_entries(spark.createDataFrame(zips, "path string, content binary")))
    read = lambda: sorted((r.archive, r.safe_name, r.file, r.table_id, r.row_idx, *r.cells, r.hint) for r in rows().collect())
    want = sorted([(a, f"{n}.xlsx", f"{n}.xlsx", f"{n}.xlsx#sheet1", k, f"{n}-{k}", "", str(k), 0) for a, ns in (("one.zip", range(7)), ("two.zip", [2])) for n in ns for k in range(n)] + [("one.zip", "x.docx", "x.docx", "x.docx#table0", 0, "b", "c", None)])
    assert read() == want
    monkeypatch.setattr(files, "ENTRIES", 2)
    monkeypatch.setattr(files, "ROWS", 3)
    assert read() == want
    plan = archives.archive_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan


def test_ingestion_shuffles_rows_once(spark, tmp_path, monkeypatch):
    """Repeated item_ids, in one line or several, in one batch or two, null ones too; one shuffle and one sort of whole rows."""
    schema = "item_id string, partner_id long, service_id long, service_name_raw string, effective_date date, price int"
    rows = [(f"i{k}", k % 5, k % 3 or None, f"name {k % 4}", dt.date(2024, 1, 1 + k % 20), k) for k in range(200)]
    again = [("i7", 4, None, "other", dt.date(2025, 1, 1), 0), ("i8", *rows[8][1:]), (None, 1, 1, "n", None, 0), (None, 2, 1, "n", None, 0)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    kind = versioning.reconcile(frame(rows).withColumns({"is_active": F.lit(True), "version": F.lit(1)})).schema
    for most in (10_000, 0):
        monkeypatch.setattr(ingest, "REPEATED", most)
        table = KeyedTable(spark, f"file://{tmp_path}/t{most}", kind, ("partner_id",), 4)
        touched = len({r[0] for r in frame(rows + again).select(table.part()).collect()})
        assert table.merge(frame(rows + again), 0, ingest.reconciled) == touched
        first = table.read().collect()
        assert len(first) == 201 and len({r.item_id for r in first}) == 201
        lines = {(r.partner_id, r.service_id or r.service_name_raw) for r in first}
        assert len([r for r in first if r.is_active]) == len(lines)
        assert table.merge(frame([("new", 1, 1, "x", dt.date(2026, 1, 1), 1), rows[1]]), 1, ingest.reconciled) == 1
        assert len(table.read().collect()) == 202 and [r.is_active for r in table.read().where("item_id = 'new'").collect()] == [True]
        assert table.merge(frame([]), 2, ingest.reconciled) == 0 and len(table.read().collect()) == 202
    empty = KeyedTable(spark, f"file://{tmp_path}/e", kind, ("partner_id",), 4)
    assert empty.merge(frame([]), 0, ingest.reconciled) == 0 and empty.commits() == [0] and empty.read().count() == 0
    plan = ingest.reconciled(None, frame(rows), table.part()).sortWithinPartitions("part")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and plan.count("Window [") == 1


def test_requests_are_dealt_and_remembered(spark, tmp_path, monkeypatch):
    """Equal texts are read once a task, rows of one file are dealt to tasks; what is skipped at once wouldn't have been found."""
    texts = ["найди узи в Алматы до 5000 тг", "клиники в Шымкенте", "show top 3 scans under 50k", "привет", "", None, "cheapest mri in Nur-Sultan", "узи Костанай от 2000 до 8000"]
    rows = spark.createDataFrame([(k, texts[k % 8]) for k in range(400)], "id int, text string").coalesce(1)
    log, plain = f"{tmp_path}/read", assistant.parse

    def counted(text):
        with open(log, "a") as f:
            f.write("x")
        return plain(text)

    monkeypatch.setattr(assistant, "parse", counted)
    done = assistant.parse_all(rows)
    assert "Exchange hashpartitioning(text" in done._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.preferences.asDict() for r in done.collect()}
    assert os.path.getsize(log) <= 8 * 4 and len(got) == 400
    always = types.SimpleNamespace(search=lambda text: True)
    monkeypatch.setattr(assistant, "ANY_PLACE", always)
    monkeypatch.setattr(assistant, "DIGIT", always)
    assert all(got[k] == dataclasses.asdict(plain(texts[k % 8])) for k in range(400))
    assert got[6]["city"] == "Астана" and got[7]["city"] == "Костанай" and got[7]["max_price"] == 8000.0


def test_documents_are_read_twice_to_find_providers(spark, tmp_path):
    log = f"{tmp_path}/read"

    def counted(text):
        with open(log, "a") as f:
            f.write("x")
        return text

    name = F.udf(counted, "string").asNondeterministic()(F.concat(F.lit("Clinic "), (F.col("id") % 9).cast("string"), F.when(F.col("id") % 2 == 0, "!").otherwise("")))
    documents = spark.range(60).select(F.col("id").alias("document_id"), name.alias("name"), F.when(F.col("id") % 4 == 0, F.lpad((F.col("id") % 12).cast("string"), 12, "7")).alias("bin"))
    done, _ = providers.resolve_or_create(documents, spark.createDataFrame([(7, "clinic 3", None)], "partner_id long, partner_name string, bin string"))
    found = {r.document_id: r.partner_id for r in done.collect()}
    assert os.path.getsize(log) == 2 * 60 and len(found) == 60
    assert found[3] == 7 and found[30] == 7 and found[1] == found[10] == 9 and found[0] == found[12] == found[9] == 8


def test_scanned_rows_in_one_step(spark, sf):
    """Pages are taken apart into their rows by one generator, and no text is lowered; words of a line may have several tops."""
    plan = reading.scanned_rows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Exchange") == 1 and "lower(" not in plan
    lines = [
        [("Снимок", 10, 0.0), ("кисти", 62, 1.5), ("5OO0", 300, 0.4), ("6 00", 400, 2.0)], [("Дата", 10, 30.0), ("700", 200, 30.0), ("12.05.2024", 300, 30.0)],
        [("Номер", 10, 60.0), ("123456789", 300, 60.0)], [("800", 300, 90.0), ("Осмотр", 10, 91.0), ("90$", 400, 90.5)], [(" ", 10, 120.0)], [("77", 10, 150.0)], [("УЗИ", 10, 180.0), ("-", 200, 180.0), ("1S0", 300, 180.0)],
    ]
    words = [(1, float(x), float(x + 8 * len(t)), top, t) for line in lines for t, x, top in line] + [(2, 0.0, 1.0, 5.0, " "), (3, 0.0, 1.0, None, "x"), (3, None, 1.0, 5.0, "900")]
    random.Random(3).shuffle(words)
    found = geometry.scanned_rows(spark.createDataFrame(words, "page_id long, x0 double, x1 double, top double, text string")).collect()
    assert sorted(tuple(r)[:5] for r in found if r.page_id < 3) == [(1, 0, "Снимок кисти", 5000.0, 600.0), (1, 3, "Осмотр", 800.0, 90.0), (1, 5, "УЗИ", 150.0, None)]
    assert {r.line: r.currency for r in found if r.page_id == 1} == {0: "KZT", 3: "KZT", 5: "KZT"}


def test_texts_that_need_no_work(spark):
    """Only texts with blanks to clean or numbers to repair are changed; texts without a digit hold no price."""
    values = lambda texts, use: [r.v for r in sorted(spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", use(F.col("t")).alias("v")).collect(), key=lambda r: r.n)]
    cleaned = {"1О5  и": "105 и", " a": "a", "a ": "a", "x\u00a0y": "x y", "5OO0": "5000", "слово O": "слово O", "a\tб": "a б", "1S00 l2З": "1500 123", "\n5O\n": "50", "1.5O,l": "1.50,1", "абв5": "абв5", "a\r\n\n\rb": "a\n\nb"}
    assert values(cleaned, hints.cleaned_text) == list(cleaned.values())
    read = {"12\n": 12.0, "12\u2028": 12.0, " 7": 7.0, "5 000": 5000.0, "1O0": 100.0, "A5": None, "kzt5": 5.0, "٣": None, "": None, "9" * 25: 1e25}
    assert values(read, prices.price) == list(read.values())
    none = ["-", "—", "–", "−", "n/a", "NA", "нет", "договорная", "Договорной", "по запросу", "уточняйте", "x", "х", "*", ".", "..", None]
    assert values(none, prices.price) == [None] * len(none)
    plan = spark.createDataFrame([("1",)], "t string").select(prices.price(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan
