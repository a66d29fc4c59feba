"""Price lists upserted one after another: a fold over each line's documents in order, every document against the state before it."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT = ("item_id", "partner_id", "service_name_raw", "effective_date", "price", "version", "is_active", "previous_item_id", "is_anomaly")
TIMES = 2  # a price is an anomaly if this many times its change is more than the price before


class Line:
    """What decides about a line's next rows: its active rows by date, and of the others the best ones of the two latest dates.

    A row is a list of KEPT's values; it is held only as long as it is active."""

    ID, DATE, PRICE, VERSION, ACTIVE = 0, 3, 4, 5, 6

    def __init__(self):
        self.active: dict[object, list[tuple]] = {}  # date: (-version, item_id, row) in order
        self.dates: list[object] = []  # of active rows, ascending, without null
        self.past: list[tuple] = []  # (date, -version, item_id, row), latest date first, one for each date

    def add(self, row: list) -> None:
        date = row[self.DATE]
        if date not in self.active:
            self.active[date] = []
            if date is not None:
                bisect.insort(self.dates, date)
        bisect.insort(self.active[date], (-row[self.VERSION], row[self.ID], row))

    def retire(self, row: list) -> None:
        """An inactive row that later ones may be compared with."""
        date = row[self.DATE]
        if date is None:
            return
        found = (date, -row[self.VERSION], row[self.ID], row)
        same = next((p for p in self.past if p[0] == date), None)
        if same is None:
            self.past.append(found)
        elif found[1:3] < same[1:3]:
            self.past[self.past.index(same)] = found
        self.past.sort(key=lambda p: p[0], reverse=True)
        del self.past[2:]

    def replaced(self, date) -> list | None:
        rows = self.active.get(date)
        return rows[0][2] if rows else None

    def prior(self, date) -> list | None:
        """The best row of another date: an active one if there is any, of the latest date, then of the highest version."""
        other = next((d for d in reversed(self.dates) if d != date), None)
        if other is not None:
            return self.active[other][0][2]
        return next((p[3] for p in self.past if p[0] != date), None)

    def document(self, rows: list[list]) -> Iterator[list]:
        """Adds a document's rows, none of which sees another, and gives those that stop being active."""
        off = {}
        for row in rows:
            old, prior = self.replaced(row[self.DATE]), self.prior(row[self.DATE])
            if old is not None:
                off[old[self.ID]] = old
            if prior is not None and prior[self.ACTIVE]:
                off[prior[self.ID]] = prior
            before = old if old is not None else prior
            row[5:] = [1, True, None, False] if before is None else [before[self.VERSION] + 1, True, before[self.ID], False]
            if prior is not None and prior[self.PRICE] and row[self.PRICE] is not None:
                row[8] = TIMES * abs(row[self.PRICE] - prior[self.PRICE]) > abs(prior[self.PRICE])
        for row in off.values():
            date, row[self.ACTIVE] = row[self.DATE], False
            self.active[date].remove((-row[self.VERSION], row[self.ID], row))
            if not self.active[date]:
                del self.active[date]
                if date is not None:
                    self.dates.remove(date)
            self.retire(row)
            yield row
        for row in rows:
            self.add(row)

    def rest(self) -> Iterator[list]:
        for rows in self.active.values():
            yield from (row for _, _, row in rows)


def numbered(kind: pa.DataType) -> bool:
    return pa.types.is_date32(kind) or pa.types.is_decimal128(kind) and kind.precision <= 18


def plain(column: pa.Array) -> list:
    """A column's values, made all at once where numpy can; dates as days and decimals as whole numbers of their last digit,
    which sort and compare alike."""
    kind, n = column.type, len(column)
    if column.null_count == n:
        return [None] * n
    if pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if numbered(kind) and pa.types.is_decimal128(kind):
        low = np.frombuffer(column.buffers()[1], "<i8")[::2][column.offset : column.offset + n]
    elif numbered(kind) or pa.types.is_integer(kind) or pa.types.is_boolean(kind):
        whole = column.cast(pa.int32()) if numbered(kind) else column
        low = whole.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False)
    else:
        return column.to_pylist()
    if column.null_count:
        low = low.astype(object)
        low[np.asarray(column.is_null())] = None
    return low.tolist()


def column_of(values: tuple, kind: pa.DataType) -> pa.Array:
    """The column whose plain values these are."""
    if not numbered(kind):
        return pa.array(values, kind)
    if pa.types.is_date32(kind):
        return pa.array(values, pa.int32()).cast(kind)
    whole = pa.array(values, pa.int64())
    low = np.asarray(whole.fill_null(0))
    halves = np.stack([low, low >> 63], axis=1)  # low and high 64 bits
    return pa.Array.from_buffers(kind, len(whole), [whole.buffers()[0], pa.py_buffer(halves.tobytes())], whole.null_count)


def folded(rows: Iterator[tuple]) -> Iterator[list]:
    """rows: (key of the line, whether stored, document, values) in order. Gives each row once: as soon as it is inactive, or at
    its line's end."""
    line, now, document, held = None, (), None, []
    for key, stored, number, row in rows:
        if key != now:
            if line is not None:
                yield from line.document(held)
                yield from line.rest()
            line, now, document, held = Line(), key, number, []
        if stored:
            if row[Line.ACTIVE]:
                line.add(row)
            else:
                line.retire(row)
                yield row
            continue
        if number != document:
            yield from line.document(held)
            document, held = number, []
        held.append(row)
    if line is not None:
        yield from line.document(held)
        yield from line.rest()


def schema_of(rows: DataFrame) -> T.StructType:
    """The schema of upsert()'s rows."""
    given = [T.StructField(c, rows.schema[c].dataType) for c in KEPT[:5]]
    made = (T.IntegerType(), T.BooleanType(), rows.schema["item_id"].dataType, T.BooleanType())
    return T.StructType(given + [T.StructField(c, kind) for c, kind in zip(KEPT[5:], made)])


def line_name() -> Column:
    return F.coalesce(F.trim("service_name_raw"), F.lit("")).alias("_name")


def unknown(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """rows but those whose item_id their line has stored."""
    known = stored.select(F.col("partner_id").alias("_p"), line_name().alias("_n"), F.col("item_id").alias("_i"))
    same = F.col("partner_id").eqNullSafe(F.col("_p")) & (line_name() == F.col("_n")) & (F.col("item_id") == F.col("_i"))
    return rows.join(known, same, "left_anti")


def upsert(stored: DataFrame | None, rows: DataFrame, deal: tuple[Column, int] | None = None) -> DataFrame:
    """All rows (KEPT) after the documents of rows have been upserted into stored ones, one after another by document_no.

    rows: item_id, partner_id, service_name_raw, effective_date, price, document_no. A line is a partner (a null one too)
    and a trimmed name (null is empty). A row replaces the active row of its line and date, null dates being equal, and is
    its next version. Its price is compared with the best row of another date, null not counting as one: an active one
    first, then the latest, then the highest version, then the smallest item_id. That one is deactivated, and is the
    predecessor of a row that replaces none. Rows of one document see the state before it, so equal lines and dates in it
    all become active; a null document_no comes first. Rows whose item_id the line already has are left out, as are repeated
    ones, so a batch that is delivered twice changes nothing. Empty tables give what the other one makes. A line's documents
    follow on each other, so a line is one task's; it streams through sorted, and only its active rows are held. deal: an
    expression of a line that tells its task, and the number of tasks; rows are then known to be distinct and new.
    """
    if deal is None:
        rows = rows.dropDuplicates(["item_id"])
        rows = rows if stored is None else unknown(stored, rows)
    made = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema_of(rows).fields[5:]]
    ahead = rows.select(*KEPT[:5], *made, F.lit(False).alias("_stored"), "document_no")
    if stored is not None:
        ahead = ahead.unionByName(stored.select(*KEPT, F.lit(True).alias("_stored"), F.lit(None).cast(rows.schema["document_no"].dataType).alias("document_no")))
    order = ["partner_id", "_name", F.col("_stored").desc(), F.col("document_no").asc_nulls_first(), "item_id"]
    met = ahead.repartition("partner_id", line_name()) if deal is None else ahead.repartitionById(deal[1], deal[0])
    dealt = met.withColumn("_name", line_name()).sortWithinPartitions(*order)

    def run(batches):
        kinds: list[pa.DataType] = []

        def told():
            for b in batches:
                kinds[:] = [b.column(c).type for c in KEPT]
                partner, names, old, number = (plain(b.column(c)) for c in ("partner_id", "_name", "_stored", "document_no"))
                for k, row in enumerate(zip(*(plain(b.column(c)) for c in KEPT))):
                    yield (partner[k], names[k]), old[k], number[k], list(row)

        out = []
        for row in folded(told()):
            out.append(row)
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([column_of(c, t) for c, t in zip(zip(*out), kinds)], names=list(KEPT))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([column_of(c, t) for c, t in zip(zip(*out), kinds)], names=list(KEPT))

    return dealt.mapInArrow(run, ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in KEPT))
