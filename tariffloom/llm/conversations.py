"""Repair of conversations' structure by the cheapest edits, solved once for each distinct sequence of roles and faults.

A conversation's signature has a letter for each row: its role's kind (s, u, a, o for others), a capital if the text is
truncated, or d if the row has to go. Signatures are deduplicated, each is solved once by a memoised recursion over its
halves, audits are joined back, and the edits are replayed over the conversation's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table, tidied
from .hot import with_values

#: Costs of the contract. States of what stands before: nothing, s, u, a.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
NEXT = (2, 2, 3, 2)  # state after the one role that may follow
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
NAMES = {2: "user", 3: "assistant"}
KINDS = {"s": 1, "u": 2, "a": 3}
SHORT = 256  # letters of the longest part of a signature that is remembered
EMPTY = hashlib.sha256(b"").hexdigest()


def step(letter: str, after: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """For each state before a row, the least cost from there on: if the row's own edit comes next, and if rows may be inserted first."""
    own = []
    for state in range(4):
        cost = DELETE + after[state]
        if letter != "d":
            more = TRUNCATED if letter.isupper() else 0
            kind = KINDS.get(letter.lower())
            if kind == 1 and state == 0 or kind == NEXT[state]:
                cost = min(cost, more + after[kind])
            cost = min(cost, REROLE + more + after[NEXT[state]])
        own.append(cost)
    least = [0, 0, min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])]
    for state in (0, 1):
        least[state] = min(own[state], INSERT + least[2])
    return own, least


def before(part: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least costs from each state before a part of a signature on, given those after it."""
    if not part:
        return after
    base = min(after)
    costs = (recalled if len(part) <= SHORT else halved)(part, tuple(x - base for x in after))
    return tuple(x + base for x in costs)


def halved(part: str, after: tuple[int, ...]) -> tuple[int, ...]:
    if len(part) == 1:
        return tuple(step(part, after)[1])
    middle = len(part) // 2
    return before(part[:middle], before(part[middle:], after))


recalled = lru_cache(1 << 14)(halved)


def edits(part: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The least string of initials among the cheapest edits of a part, and the state that it leaves."""
    base = min(after)
    return (known_edits if len(part) <= SHORT else halved_edits)(part, state, tuple(x - base for x in after))


def halved_edits(part: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    if len(part) > 1:
        middle = len(part) // 2
        first, state = edits(part[:middle], state, before(part[middle:], after))
        second, state = edits(part[middle:], state, after)
        return first + second, state
    own, least = step(part, after)
    more = TRUNCATED if part.isupper() else 0
    out = ""
    while True:  # initials in ASCII order
        want, follows = least[state], NEXT[state]
        kind = KINDS.get(part.lower())
        if DELETE + after[state] == want:
            return out + "D", state
        if INSERT + least[follows] == want:
            out, state = out + "I", follows
        elif kind and (kind == 1 and state == 0 or kind == follows) and more + after[kind] == want:
            return out + "K", kind
        else:
            return out + "R", follows


known_edits = lru_cache(1 << 14)(halved_edits)


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit. The recursion is as deep as the logarithm of the signature's length."""
    if not signature:
        return 0, ""
    audit, state = edits(signature, 0, END)
    return before(signature, END)[0], audit + TAIL[state]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage that a hash of conv_id and turn decides; of a dropped row only conv_id is
    left, with nulls in all else. Nulls of role and text, and in what is hashed, are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    left = lambda c: F.when(F.col("kind") != 0, c)
    rows = rows.withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select("conv_id", left(F.col("turn")).alias("turn"), left(F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"), left(text).alias("text"))


ORDER = ("turn", "role", "text")
WHITE = " \t\n\x0b\x0c\r"


def kind_of(role: str | Column) -> Column:
    """s, u, a by a role's first character, o for all others."""
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; of a dropped one conv_id alone), sorted by conversation and place within partitions, with
    letter (of the signature, null for a dropped row), blank, duplicate, truncated, illegal (0 or 1) and fresh (a turn not seen before).

    Rows of one turn are ordered by role and text. A conversation is one partition's, as its result is one digest of all
    of its text in order; it streams through, sorted with spilling, and is never held."""
    body = F.rtrim("text", F.lit(WHITE))
    dealt = rows.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    dealt = dealt.withColumn("again", (seen > 1) & F.col("text").isNotNull())
    place = Window.partitionBy("conv_id").orderBy(*ORDER)
    pair = F.concat(F.lag(kind_of("role")).over(place), kind_of("role"))
    prior = F.lag("turn").over(place)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    dealt = dealt.withColumns({
        "illegal": flag(F.lag("text").over(place).isNotNull() & F.col("text").isNotNull() & ~pair.isin("su", "ua", "au")),
        "fresh": flag(F.col("turn").isNotNull() & (prior.isNull() | (prior != F.col("turn")))),
        "blank": flag(F.length(body) == 0), "duplicate": flag((F.length(body) > 0) & F.col("again")),
    })
    gone = F.col("blank") + F.col("duplicate") > 0
    dealt = dealt.withColumn("truncated", flag(~gone & ~F.substring(body, -1, 1).isin(".", "!", "?")))
    letter = F.when(gone, "d").when(F.col("truncated") == 1, F.upper(kind_of("role"))).otherwise(kind_of("role"))
    return dealt.withColumn("letter", F.when(F.col("text").isNotNull(), letter)).sortWithinPartitions("conv_id", *ORDER)


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def runs(column: pa.Array) -> np.ndarray:
    """Where runs of equal values (nulls are equal) begin."""
    if len(column) < 2:
        return np.zeros(len(column), int)
    ids, none = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])]))


def signatures(found: DataFrame) -> DataFrame:
    """conv_id, signature, gaps and the counts of faults of each conversation, from faults()."""

    def run(batches):
        def record(c):
            return [c["id"], "".join(c["letters"]), c["high"] - c["low"] + 1 - c["fresh"] if c["fresh"] else 0, *c["counts"]]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.string(), *[pa.int64()] * 5))], names=["conv_id", "signature", "gaps", *COUNTS])

        now, kind = None, None
        for b in tidied(batches):
            if not b.num_rows:
                continue
            kind, done = b.column("conv_id").type, []
            at = runs(b.column("conv_id"))
            ends = [*at[1:].tolist(), b.num_rows]
            sums = [np.add.reduceat(b.column(c).to_numpy(), at).tolist() for c in (*COUNTS, "fresh")]
            turns, letters = b.column("turn").to_pylist(), b.column("letter").to_pylist()
            ids = b.column("conv_id").take(pa.array(at)).to_pylist()
            for n, (a, z) in enumerate(zip(at.tolist(), ends)):
                if now is None or n or now["id"] != ids[0]:
                    if now is not None:
                        done.append(record(now))
                    now = {"id": ids[n], "letters": [], "low": None, "high": None, "fresh": 0, "counts": [0] * 4}
                now["letters"].append("".join([x for x in letters[a:z] if x]))
                now["counts"] = [x + s[n] for x, s in zip(now["counts"], sums)]
                now["fresh"] += sums[4][n]
                if turns[z - 1] is not None:  # sorted by turn, nulls first
                    now["high"] = turns[z - 1]
                    if now["low"] is None:
                        now["low"] = next(t for t in turns[a:z] if t is not None)
            if done:
                yield packed(done)
        if now is not None:
            yield packed([record(now)])

    kept = found.select("conv_id", "turn", "letter", *COUNTS, "fresh")
    kind = found.schema["conv_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"conv_id {kind}, signature string, gaps long, {', '.join(f'{c} long' for c in COUNTS)}")


def solved(distinct: DataFrame) -> DataFrame:
    """signature, cost, audit of distinct signatures."""

    def run(batches):
        for b in tidied(batches):
            told = [solve(x) for x in b.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array([c for c, _ in told], pa.int64()), pa.array([a for _, a in told], pa.string()), b.column("n")], names=["signature", "cost", "audit", "n"])

    return distinct.mapInArrow(run, "signature string, cost long, audit string, n long")


def audited(rows: DataFrame, work: Scratch) -> DataFrame:
    """conv_id, gaps, counts of faults, cost and audit of every conversation of damaged rows.

    A signature that many conversations have is counted before it is shuffled, solved once and broadcast to them."""
    told = work.cut(signatures(faults(rows)))
    audits = work.cut(solved(told.groupBy("signature").agg(F.count("*").alias("n"))))
    return work.cut(with_values(told, audits, "signature", "n").drop("signature", "n"))


def replayed(batches: Iterator[pa.RecordBatch], heads: tuple[str, ...]) -> Iterator[tuple[str, object]]:
    """("head", values) of each conversation, then ("line", (edit, role, text)) of each row that its repair has, in order.

    Input is sorted: a conversation's head (audit not null) stands before its rows."""
    audit, at, state = "", 0, 0

    def inserted():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, NEXT[state]
            yield "line", ("I", NAMES[state], "")

    for b in tidied(batches):
        columns = [b.column(c).to_pylist() for c in ("audit", "role", "text")]
        for k, (told, role, text) in enumerate(zip(*columns)):
            if told is not None:
                yield from inserted()
                audit, at, state = told, 0, 0
                yield "head", [b.column(c)[k].as_py() for c in heads]
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == "K":
                state = KINDS[role[0]]
                yield "line", ("K", role, text)
            elif edit == "R":
                state = NEXT[state]
                yield "line", ("R", NAMES[state], text)
    yield from inserted()


def headed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation in order, after its head, partition by partition."""
    heads = audits.withColumns({"turn": F.lit(None).cast(rows.schema["turn"].dataType), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    both = heads.unionByName(rows.where(F.col("text").isNotNull()), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER)


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text of the repaired conversations."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ahead = headed(rows, audits)
    id_type = None

    def run(batches):
        out, conv, place = [], None, 0

        def packed():
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", id_type or pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))

        for what, value in replayed(batches, ("conv_id",)):
            if what == "head":
                conv, place = value[0], 0
                continue
            out.append({"conv_id": conv, "place": place, "edit": value[0], "role": value[1], "text": value[2]})
            place += 1
            if len(out) >= 1000:
                yield packed()
                out.clear()
        yield packed()

    return ahead.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """audits with repaired_sha256, of the repaired conversation's `role:text` joined by newlines, hashed line by line."""
    names = tuple(audits.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in audits.schema.fields) + ", repaired_sha256 string"
    kinds = [pa.string() if f.dataType.simpleString() == "string" else pa.int64() for f in audits.schema.fields] + [pa.string()]

    def run(batches):
        out, head, told, first = [], None, None, True

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=[*names, "repaired_sha256"])

        for what, value in replayed(batches, names):
            if what == "head":
                if head is not None:
                    out.append([*head, told.hexdigest()])
                    if len(out) >= 1000:
                        yield packed()
                        out.clear()
                head, told, first = value, hashlib.sha256(), True
            else:
                told.update(f"{'' if first else chr(10)}{value[1]}:{value[2]}".encode())
                first = False
        if head is not None:
            out.append([*head, told.hexdigest()])
        yield packed()

    return headed(rows, audits).mapInArrow(run, schema)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, turns): a row for each conversation with its faults, cost and audit, and the repaired turns, without damage first.

    Null roles and texts are one space, rows of one turn are ordered by role and text, and rows without conv_id are one
    conversation. Repeated rows are duplicates. An empty table gives no rows; other columns don't matter. A very long
    text is one value of an Arrow batch; a very long conversation streams, but for its signature of a letter a row."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    audits = audited(rows, Scratch())
    return audits, repaired(rows, audits)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that damage leaves without rows come out with zeros, an empty audit and the digest of nothing."""
    rows = damaged(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    work = Scratch()
    return work.kept(digests(rows, audited(rows, work)).select("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"))


CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"


def sql_choice(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def sql_step() -> str:
    """The four states before a row from those after it: own edits first, then rows inserted before them."""
    past = lambda state: f"f[{state + 1}]"
    made = lambda c, e, t, p: f"{{'c': {p}.c + {c}, 'e': '{e}' || {p}.e, 't': {t} || {p}.t}}"
    line = "chr(10) || {} || ':' || text"
    own = []
    for state in range(4):
        to = NEXT[state]
        more = "CASE WHEN truncated = 1 THEN 3 ELSE 0 END + CASE WHEN blank + duplicate > 0 THEN 1000000000 ELSE 0 END"
        keeps = [made(f"({more} + CASE WHEN kind = '{x}' THEN 0 ELSE 1000000000 END)", "K", line.format("role"), past(n)) for x, n in KINDS.items() if n == to or n == 1 and state == 0]
        own.append(sql_choice(made("4", "D", "''", past(state)), *keeps, made(f"(3 + {more})", "R", line.format(f"'{NAMES[to]}'"), past(to))))
    insert = lambda to, p: made("3", "I", f"chr(10) || '{NAMES[to]}:'", p)
    return f"""SELECT r.conv_id, i - 1 AS i, f AS f0, [{', '.join(own)}] AS g FROM back r JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.nth = r.i""", \
        f"[{sql_choice('g[3]', insert(3, 'g[4]'))}, {sql_choice('g[4]', insert(2, 'g[3]'))}]", insert


def op12_sql() -> str:
    step_sql, pair, insert = sql_step()
    end = "[{'c': 0, 'e': '', 't': ''}, {'c': 6, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 3, 'e': 'I', 't': chr(10) || 'assistant:'}, {'c': 0, 'e': '', 't': ''}]"
    first = lambda n: sql_choice(f"g[{n}]", insert(2, "h[1]"))
    return rf"""
WITH RECURSIVE t AS (SELECT {CRC_TABLE} AS t
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)),
      lambda a, b: xor(a >> 8, t.t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS k
  FROM conversations, t
), hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nth, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS kind, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM hurt
), marked AS (
  SELECT *, CASE WHEN body = '' THEN 1 ELSE 0 END AS blank, CASE WHEN body <> '' AND seen > 1 THEN 1 ELSE 0 END AS duplicate,
    CASE WHEN body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS truncated,
    CASE WHEN lag(kind) OVER (PARTITION BY conv_id ORDER BY nth) || kind NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM placed
), rows_ AS (SELECT * FROM marked
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank) AS blank, sum(duplicate) AS duplicate, sum(truncated) AS truncated, sum(illegal) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id
), back AS (
  SELECT conv_id, n AS i, {end} AS f FROM sums
  UNION ALL
  SELECT conv_id, i, [{first(1)}, {first(2)}, h[1], h[2]] FROM (SELECT *, {pair} AS h FROM ({step_sql}))
), done AS (SELECT conv_id, f[1] AS f FROM back WHERE i = 0
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(f.c, 0) AS BIGINT) AS cost, coalesce(f.e, '') AS audit, sha256(coalesce(substr(f.t, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


OP12_SQL = op12_sql()
