"""Ruled tables: a grid from the ruling lines of a page, and words dealt to its cells, which may span columns and rows.

Segments are rows (page_id, x0, y0, x1, y1), words are rows (page_id, x0, x1, top, bottom, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import let
from .once import told

NEAR = 3.0  # points within which lines are one, and a segment counts as level or upright


def distinct_places(places: Column) -> Column:
    """Sorted places, of those within NEAR of the one before them none."""
    return let(F.sort_array(F.array_distinct(places)), lambda ordered: F.filter(ordered, lambda x, i: (i == 0) | (x - F.get(ordered, i - 1) > NEAR)))


def begun(uprights: Column) -> Column:
    """Sorted uprights (y0, y1, x0) parted into tables, which are arrays: one ends where none so far reaches the next."""
    none = F.struct(F.array().cast("array<int>").alias("at"), F.lit(None).cast("double").alias("reach"), F.lit(0).alias("n"))

    def step(state: Column, u: Column) -> Column:
        begins = state["reach"].isNull() | (u["y0"] - state["reach"] > NEAR)
        at = F.when(begins, F.concat(state["at"], F.array(state["n"]))).otherwise(state["at"])
        return F.struct(at.alias("at"), F.greatest(state["reach"], u["y1"]).alias("reach"), (state["n"] + 1).alias("n"))

    starts = F.aggregate(uprights, none, step, lambda state: F.concat(state["at"], F.array(state["n"])))
    return let(starts, lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda k, i: F.slice(uprights, k + 1, F.get(at, i + 1) - k)))


def grids(segments: DataFrame, words: DataFrame) -> DataFrame:
    """page_id, table_no (from 0, top down), y0, y1, xs, ys (places of the grid's lines), uprights and levels (its segments),
    words of the page.

    Uprights whose heights overlap or touch belong to one table, and so do the levels between their ends; a table has two
    places of each kind or more. A page's segments and words are one array each, which is what a task holds at a time."""
    low, high = lambda a, b: F.least(a, b).cast("double"), lambda a, b: F.greatest(a, b).cast("double")
    rows = segments.select("page_id", low("x0", "x1").alias("x0"), high("x0", "x1").alias("x1"), low("y0", "y1").alias("y0"), high("y0", "y1").alias("y1"))
    wide, tall = F.col("x1") - F.col("x0") > NEAR, F.col("y1") - F.col("y0") > NEAR
    drawn = rows.where(wide != tall).select("page_id", F.when(tall, F.struct("y0", "y1", "x0")).alias("u"), F.when(wide, F.struct("y0", "x0", "x1")).alias("l"))
    pages = drawn.unionByName(words, allowMissingColumns=True).where("page_id IS NOT NULL").groupBy("page_id").agg(F.sort_array(F.collect_list("u")).alias("us"), F.collect_list("l").alias("ls"), F.collect_list("w").alias("words"))
    some = pages.where((F.size("us") > 1) & (F.size("ls") > 1))
    each = some.select("page_id", "ls", "words", F.posexplode(begun(F.col("us"))).alias("table_no", "uprights"))
    y0 = F.array_min(F.col("uprights.y0"))
    ends = told(each, ["page_id", "table_no", "uprights", "ls", "words"], y0=y0, y1=F.array_max(F.col("uprights.y1")), xs=distinct_places(F.col("uprights.x0")))
    levels = F.filter("ls", lambda u: u["y0"].between(F.col("y0") - NEAR, F.col("y1") + NEAR))
    found = told(ends.where(F.size("xs") > 1), ["page_id", "table_no", "y0", "y1", "xs", "uprights", "words"], levels=levels)
    found = told(found, ["page_id", "table_no", "y0", "y1", "xs", "uprights", "levels", "words"], ys=distinct_places(F.col("levels.y0")))
    return found.where(F.size("ys") > 1)


def between(places: str, at: Column) -> Column:
    """Which gap of sorted places a point is in, from 0; -1 before and their number less one behind all."""
    return F.size(F.filter(places, lambda x: x <= at)) - 1


def middle(places: str, k: Column) -> Column:
    return (F.get(places, k) + F.get(places, k + 1)) / 2


def table_rows(segments: DataFrame, words: DataFrame) -> DataFrame:
    """table_id (page_id and table_no), row_idx, cells: a row for each gap between level lines, a cell for each between uprights.

    A word is in the cell that holds its middle; a cell's words are read line by line. Where no upright parts two gaps of a row they are one cell, which stands in
    the first; where no level line parts two rows above each other they are one cell, which stands in the upper one. Cells
    of no words are empty, as are those that a cell spans. Words outside of tables are left out."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    dealt = words.where(F.trim("text") != "").select("page_id", F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), "text").alias("w"))
    tables = grids(segments, dealt)
    gaps = lambda places: F.size(places) - 1

    def gap(w: Column) -> Column:
        return F.struct(between("xs", w["x"]).alias("c"), between("ys", w["y"]).alias("r"), w.alias("w"))

    within = F.filter(F.transform(F.filter("words", lambda w: w["y"].between(F.col("y0"), F.col("y1"))), gap), lambda g: (g["c"] >= 0) & (g["c"] < gaps("xs")) & (g["r"] >= 0) & (g["r"] < gaps("ys")))

    def in_column(g: Column) -> Column:
        at = middle("ys", g["r"])
        walls = let(at, lambda m: F.filter(F.sequence(F.lit(0), g["c"]), lambda k: (k == 0) | F.exists("uprights", lambda u: (F.abs(u["x0"] - F.get("xs", k)) <= NEAR) & m.between(u["y0"], u["y1"]))))
        return F.struct(g["r"].alias("r"), F.element_at(walls, -1).alias("col"), g["w"].alias("w"))

    def in_row(g: Column) -> Column:
        over = middle("xs", g["col"])
        floors = let(over, lambda m: F.filter(F.sequence(F.lit(0), g["r"]), lambda k: (k == 0) | F.exists("levels", lambda u: (F.abs(u["y0"] - F.get("ys", k)) <= NEAR) & m.between(u["x0"], u["x1"]))))
        return F.struct(F.element_at(floors, -1).alias("row_idx"), F.lit(None).cast("int").alias("n"), F.struct(g["col"].alias("col"), g["w"]["top"].alias("top"), g["w"]["x0"].alias("x0"), g["w"]["text"].alias("text")).alias("w"))

    placed = F.transform(F.transform(within, in_column), in_row)
    word = "struct<col:int,top:double,x0:double,text:string>"
    empty = F.transform(F.sequence(F.lit(0), gaps("ys") - 1), lambda r: F.struct(r.alias("row_idx"), gaps("xs").alias("n"), F.lit(None).cast(word).alias("w")))
    rows = tables.select("page_id", "table_no", F.inline(F.concat(empty, placed)))
    held = rows.groupBy("page_id", "table_no", "row_idx").agg(F.max("n").alias("n"), F.collect_list("w").alias("ws"))

    def text(ws: Column) -> Column:
        line = lambda lines, w: F.struct(F.array_max(F.filter(lines, lambda t: t <= w["top"])).alias("line"), w["x0"].alias("x0"), w["text"].alias("text"))
        read = lambda lines: F.sort_array(F.transform(ws, lambda w: line(lines, w)))["text"]
        return F.array_join(F.when(F.size(ws) < 2, ws["text"]).otherwise(let(distinct_places(ws["top"]), read)), " ")

    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: let(F.filter("ws", lambda w: w["col"] == k), text))
    return held.select(F.concat_ws("-", "page_id", "table_no").alias("table_id"), "row_idx", cells.alias("cells"))
