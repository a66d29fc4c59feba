"""Ruled tables: spans, several tables of a page, words outside, lines that nearly meet."""

from tariffloom.operators import ruled

SEGMENTS, WORDS = "page_id long, x0 double, y0 double, x1 double, y1 double", "page_id long, x0 double, x1 double, top double, bottom double, text string"


def read(spark, segments, words):
    given = [(p, *map(float, s)) for p, *s in segments]
    rows = ruled.table_rows(spark.createDataFrame(given, SEGMENTS), spark.createDataFrame([(p, float(x), x + 10.0, float(t), t + 8.0, w) for p, x, t, w in words], WORDS))
    return sorted((r.table_id, r.row_idx, list(r.cells)) for r in rows.collect())


def level(p, y, x0, x1):
    return (p, x0, y, x1, y)


def upright(p, x, y0, y1):
    return (p, x, y0, x, y1)


def test_spans(spark):
    segments = [*(level(1, y, 0, 100) for y in (0, 20, 60)), level(1, 40, 0, 50), upright(1, 0, 0, 60), upright(1, 100, 60, 0), upright(1, 50, 20, 60.5), level(1, 21, 0, 40)]
    words = [(1, 60, 5, "b"), (1, 20, 5, "a"), (1, 5, 25, "x"), (1, 5, 45, "y"), (1, 70, 45, "z"), (1, 70, 25, "first"), (1, 70, 80, "below"), (1, 140, 25, "beside"), (2, 5, 5, "other page"), (1, 5, 30, " ")]
    assert read(spark, segments, words) == [("1-0", 0, ["a b", ""]), ("1-0", 1, ["x", "first z"]), ("1-0", 2, ["y", ""])]


def test_two_tables_and_none(spark):
    segments = [s for y in (0.0, 100.0) for s in (*(level(3, y + k, 0, 40) for k in (0, 10, 20)), *(upright(3, x, y, y + 20) for x in (0, 20, 40)))] + [level(4, 5, 0, 9), upright(5, 1, 0, 9)]
    words = [(3, 1, 101, "q"), (3, 22, 11, "p"), (4, 1, 5, "no"), (3, 1, 60, "between")]
    assert read(spark, segments, words) == [("3-0", 0, ["", ""]), ("3-0", 1, ["", "p"]), ("3-1", 0, ["q", ""]), ("3-1", 1, ["", ""])]
    assert read(spark, segments[:0] or [level(9, 1, 0, 2)], words) == []


def test_nothing_is_computed_within_joins(spark):
    """Places of words are computed once a word: copied into a join's condition they took minutes for each hundred thousand pages."""
    found = ruled.table_rows(spark.createDataFrame([], SEGMENTS), spark.createDataFrame([], WORDS))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    steps = [x for x in plan.splitlines() if "Join" in x or "Filter" in x]
    assert len(plan) < 25_000 and not any("lambda" in x for x in steps if "Join" in x)
