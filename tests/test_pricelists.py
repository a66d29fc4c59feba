"""Price lists upserted in order, against plain code over all rows; the keyed table's commits, re-runs and readers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tariffloom.operators import upserts
from tariffloom.plans import pricelists
from tariffloom.sources.keyed import KeyedTable
from tariffloom.streaming import ingest

SCHEMA = "item_id string, partner_id long, service_name_raw string, effective_date date, price decimal(14,2), document_no int"


def plain(rows, stored=()):
    """The rules of one document after another, each over all rows there are."""
    state = [dict(r) for r in stored]
    fresh = {}
    for r in rows:
        fresh.setdefault(r[0], r)
    seen = {s["item_id"] for s in state}
    documents = {}
    for r in fresh.values():
        if r[0] not in seen:
            documents.setdefault(r[5], []).append(r)
    for number in sorted(documents, key=lambda n: (n is not None, n)):
        new, off = [], set()
        for item, partner, name, date, price, _ in sorted(documents[number]):
            line = [s for s in state if s["partner_id"] == partner and s["name"] == (name or "").strip(" ")]
            same = sorted((s for s in line if s["is_active"] and s["date"] == date), key=lambda s: (-s["version"], s["item_id"]))
            other = [s for s in line if s["date"] is not None and s["date"] != date]
            other.sort(key=lambda s: (-s["is_active"], -s["date"].toordinal(), -s["version"], s["item_id"]))
            old, prior = (same or [None])[0], (other or [None])[0]
            before = old or prior
            off |= {s["item_id"] for s in (old, prior) if s and s["is_active"]}
            odd = bool(prior and prior["price"] and price is not None and abs(price - prior["price"]) * 2 > abs(prior["price"]))
            new.append({"item_id": item, "partner_id": partner, "name": (name or "").strip(" "), "date": date, "price": price, "version": before["version"] + 1 if before else 1, "previous": before["item_id"] if before else None, "is_active": True, "odd": odd})
        state = [s | {"is_active": s["is_active"] and s["item_id"] not in off} for s in state] + new
    return state


def told(found):
    return sorted((r.item_id, r.version, r.previous_item_id, r.is_active, r.is_anomaly) for r in found.collect())


def wanted(state):
    return sorted((s["item_id"], s["version"], s["previous"], s["is_active"], s["odd"]) for s in state)


def lists(seed, n=300, documents=9):
    from decimal import Decimal

    draw = random.Random(seed)
    days = [None, *(datetime.date(2024, m, 1) for m in (1, 2, 3, 4, 5))]
    return [
        (f"i{k:04}", draw.choice([1, 1, 2, None]), draw.choice(["x", " x ", "y", "", None]), draw.choice(days), draw.choice([None, Decimal(0), Decimal(10), Decimal(15), Decimal("15.01"), Decimal(40)]), draw.choice([None, *range(documents)]))
        for k in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_plain_code(spark, seed):
    rows = lists(seed)
    found = upserts.upsert(None, spark.createDataFrame([*rows, *rows[:20]], SCHEMA))
    assert told(found) == wanted(plain(rows))


def test_rows_of_one_document_dont_see_each_other(spark):
    from decimal import Decimal

    day, later = datetime.date(2024, 1, 1), datetime.date(2025, 1, 1)
    rows = [("a", 1, "ОАК", day, Decimal(5000), 1), ("b", 1, "ОАК ", day, Decimal(5100), 1), ("c", 1, "ОАК", later, Decimal(9000), 2), ("d", 1, "ОАК", later, Decimal(9000), 3)]
    assert told(upserts.upsert(None, spark.createDataFrame(rows, SCHEMA))) == [("a", 1, None, False, False), ("b", 1, None, False, False), ("c", 2, "a", False, True), ("d", 3, "c", True, True)]


def test_empty_tables(spark):
    none, rows = spark.createDataFrame([], SCHEMA), spark.createDataFrame(lists(5, 20), SCHEMA)
    assert upserts.upsert(None, none).count() == 0
    stored = upserts.upsert(None, rows)
    assert told(upserts.upsert(stored, none)) == told(stored) == told(upserts.upsert(stored, rows))


def written(spark, path):
    """Bytes under a table's data, by commit."""
    import os

    out = {}
    for top, _, names in os.walk(f"{path}/data"):
        commit = os.path.relpath(top, f"{path}/data").split(os.sep)[0]
        out[commit] = out.get(commit, 0) + sum(os.path.getsize(f"{top}/{n}") for n in names if n.endswith(".parquet"))
    return out


def test_commits_of_batches_equal_one_fold(spark, tmp_path):
    rows = lists(7, 400, 8)
    frame = spark.createDataFrame([r for r in rows if r[5] is not None], SCHEMA)
    table = pricelists.versions_table(spark, f"file://{tmp_path}/t", frame, 16)
    assert table.read().count() == 0 and table.commits() == []
    for k in range(4):
        batch = frame.where(f"document_no div 2 = {k}")
        table.merge(batch, k, ingest.upserted)
        assert told(table.read()) == told(upserts.upsert(None, frame.where(f"document_no div 2 <= {k}")))
    now = told(table.read())
    assert table.merge(frame, 3, ingest.upserted) == 0 and told(table.read()) == now  # a commit is done once
    table.merge(frame.where("document_no < 3"), 4, ingest.upserted)  # delivered again
    assert told(table.read()) == now
    assert told(table.read(at=1)) == told(upserts.upsert(None, frame.where("document_no div 2 <= 1")))
    assert table.vacuum() > 0 and told(table.read()) == now and table.vacuum() == 0
    table.merge(frame.limit(0), 5, ingest.upserted)
    assert table.commits() == [0, 1, 2, 3, 4, 5] and told(table.read()) == now


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    rows = [(f"i{k}", k, f"name {k % 7}", None, None, 0) for k in range(2000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    table = pricelists.versions_table(spark, f"file://{tmp_path}/t", frame, 32)
    assert table.merge(frame, 0, ingest.upserted) == 32
    assert table.merge(frame.where("partner_id = 5").withColumn("item_id", F.lit("new")), 1, ingest.upserted) == 1
    sizes = written(spark, f"{tmp_path}/t")
    assert sizes["1"] < sizes["0"] / 16 and table.read().count() == 2001


def test_a_failed_commit_is_not_seen_and_is_done_anew(spark, tmp_path):
    frame = spark.createDataFrame(lists(4, 60), SCHEMA)
    table = KeyedTable(spark, f"file://{tmp_path}/t", upserts.upsert(None, frame).schema, ("partner_id",), 4)
    table.merge(frame.where("document_no < 4"), 0, ingest.upserted)
    before = told(table.read())
    frame.limit(3).select("item_id", F.lit(1).alias("part")).write.partitionBy("part").parquet(f"file://{tmp_path}/t/data/1")  # data without a log entry
    assert told(table.read()) == before
    table.merge(frame.where("document_no >= 4"), 1, ingest.upserted)
    assert table.read().count() == frame.where("document_no IS NOT NULL").count()


def test_stream_without_new_data_keeps_the_table(spark, tmp_path):
    frame = spark.createDataFrame([r for r in lists(6, 50)], SCHEMA)
    frame.write.parquet(f"{tmp_path}/in")
    table = pricelists.versions_table(spark, f"file://{tmp_path}/t", frame, 4)
    stream = lambda: spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    first = told(ingest.ingest(stream(), table, f"{tmp_path}/c", ingest.upserted).read())
    assert told(ingest.ingest(stream(), table, f"{tmp_path}/c", ingest.upserted).read()) == first and len(first) == 50


def test_plain_values():
    """Dates and decimals go through the fold as whole numbers and come back as they were, in slices too."""
    import datetime
    from decimal import Decimal

    import pyarrow as pa

    prices = pa.array([Decimal("1.25"), None, Decimal("-7.00"), Decimal("999999999999.99")], pa.decimal128(14, 2))
    days = pa.array([datetime.date(1969, 12, 31), None, datetime.date(2024, 2, 29)], pa.date32())
    assert upserts.plain(prices.slice(1)) == [None, -700, 99999999999999] and upserts.plain(days) == [-1, None, 19782]
    for column in (prices, prices.slice(1, 2), days, prices.slice(0, 0), pa.array([None], pa.decimal128(14, 2)), pa.array(["a", None]), pa.array([1, None], pa.int64()), pa.array([True, None, False]), pa.array([Decimal(10) ** 19], pa.decimal128(20, 0))):
        assert upserts.column_of(tuple(upserts.plain(column)), column.type).equals(column)
