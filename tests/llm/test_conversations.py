"""Repair of conversations: the solver against all edits, whole results against SQL, replay, odd rows."""

import hashlib
import itertools
import re

import pytest
from conftest import oracle, rows_of

from tariffloom.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def all_edits(signature):
    """Cheapest cost and its least audit, by trying all edits with up to two rows inserted at each place."""
    found = []
    gaps = [["", "u", "a", "ua", "au"]] * (len(signature) + 1)
    own = [[("D", "", 4)] if x == "d" else [("D", "", 4), *[("R", r, 3 + 3 * x.isupper()) for r in "ua"], ("K", x.lower(), 3 * x.isupper())] for x in signature]
    for edits in itertools.product(*own):
        for put in itertools.product(*gaps):
            roles = "".join(itertools.chain(*zip(put, [r for _, r, _ in edits] + [""])))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "".join(itertools.chain(*zip(["I" * len(p) for p in put], [e for e, _, _ in edits] + [""])))
                found.append((3 * sum(map(len, put)) + sum(c for _, _, c in edits), audit))
    return min(found)


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_solver_equals_all_edits(size):
    for letters in itertools.product("dsuaoSUA", repeat=size):
        assert conversations.solve("".join(letters)) == all_edits("".join(letters))


def test_long_signatures():
    assert conversations.solve("ua" * 50_000) == (0, "KK" * 50_000)
    assert conversations.solve("s" + "uua" * 999) == (3 * 999, conversations.solve("s" + "uua" * 999)[1])
    for part in ("uaSoud", "duuAas"):  # halves give what a plain pass over states gives
        signature, cost = part * 40, conversations.END
        for letter in reversed(signature):
            cost = conversations.step(letter, tuple(cost))[1]
        assert conversations.solve(signature)[0] == cost[0]


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    found = conversations.op12_conversations(spark, d).toPandas()
    assert rows_of(found) == rows_of(oracle(conversations.OP12_SQL, d))


ROWS = [
    (None, None, None, None), (None, 2, "user", "Hello."), (None, 7, "assistant", "So. \n"), (1, 0, "tool", "x"), (1, 0, "", "x"), (1, None, "system", " \t"), (2, 3, "user", "."), (2, 3, "user", "."),
    (3, 1, "usher", "y!"), (3, 2, "agent", "long text. " * 20_000), *[(4, k, ("user", "assistant")[k % 2], f"line {k}.") for k in range(400)], (5, -4, "user", "á?"), (5, 9, "assistant", "unfinished"),
]


def test_odd_rows_equal_sql(spark, tmp_path):
    rows = ROWS + [(100 + k, None if k % 5 == 0 else k % 7, (None, "user", "system", "assistant", "tool", "")[k % 6], (None, "", "hi.", "hi", " ", "no!", "yes?")[k % 7]) for k in range(60)]
    rows += [(200 + k // 9, k % 4, ("user", "assistant", "system")[k % 3], f"t{k % 5}.") for k in range(200)]
    spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA + ", audit string, signature int").write.parquet(f"{tmp_path}/conversations.parquet")
    found = conversations.op12_conversations(spark, str(tmp_path)).toPandas()
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    wanted = con.sql(conversations.OP12_SQL).df().astype(object)
    assert rows_of(found) == rows_of(wanted.where(wanted.notna(), None))
    assert len(found) == len({r[0] for r in rows})


def test_conversation_without_rows_after_damage(spark):
    gone = [k for k in range(300) if __import__("zlib").crc32(f"{k}:0".encode()) % 20 == 0]
    rows = conversations.damaged(spark.createDataFrame([(k, 0, "user", "a.") for k in gone], SCHEMA))
    from tariffloom.llm.common import Scratch

    found = conversations.digests(rows, conversations.audited(rows, Scratch())).collect()
    assert len(found) == len(gone)
    assert {(r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    audits, turns = conversations.repair(spark.createDataFrame(ROWS, SCHEMA))
    told = {r.conv_id: r for r in audits.collect()}
    lines = {}
    for r in sorted(turns.collect(), key=lambda r: (str(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert (told[2].duplicate, told[2].audit, lines[2]) == (1, "KDI", [("K", "user", "."), ("I", "assistant", "")])
    assert told[4].audit == "K" * 400 and [t for _, _, t in lines[4]] == [f"line {k}." for k in range(400)]
    assert (told[5].gaps, told[5].truncated, told[5].cost) == (12, 1, 3)
    assert [r for _, r, _ in lines[3]] == ["usher", "agent"]
    for conv, found in lines.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in found))
        assert len(found) == len(told[conv].audit.replace("D", ""))


def test_empty_table(spark):
    audits, turns = conversations.repair(spark.createDataFrame([], SCHEMA))
    assert audits.count() == 0 and turns.count() == 0
