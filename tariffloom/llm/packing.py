"""Packing token ids into windows: bounded-space online best fit in every partition, leftovers merged in a tree."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, tidied
from .tokens import Encoder


@dataclass(frozen=True)
class Settings:
    """window: ids of a full sequence. open_windows: kept in one task. least_gap: a smaller rest of a window is padded
    rather than filled by cutting a document. fan_in: tasks whose open windows one task of the next level merges."""

    window: int = 2048
    open_windows: int = 64
    least_gap: int = 8
    fan_in: int = 32
    end_id: int = 1


@dataclass
class Piece:
    """A document's ids from start on; tag tells the documents of a task apart."""

    tag: tuple
    start: int
    ids: bytes  # little-endian unsigned 32-bit

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.tag, self.start, self.ids[: 4 * n]), Piece(self.tag, self.start + n, self.ids[4 * n :])

    def __len__(self) -> int:
        return len(self.ids) // 4


class Bins:
    """Open windows, ordered by what they hold. A piece goes into the fullest in which it fits; when it fits nowhere and no
    window may be opened, the fullest is topped up by a cut of it and emitted."""

    def __init__(self, s: Settings):
        self.s = s
        self.order: list[tuple[int, int]] = []  # (ids held, number)
        self.held: dict[int, list[Piece]] = {}
        self.made = 0

    def put(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        size = sum(map(len, pieces))
        if size == 0:
            return
        if size == self.s.window:
            yield pieces
            return
        at = bisect.bisect_right(self.order, (self.s.window - size, 1 << 62)) - 1
        if at >= 0:
            used, number = self.order.pop(at)
            self.held[number] += pieces
            if used + size == self.s.window:
                yield self.held.pop(number)
            else:
                bisect.insort(self.order, (used + size, number))
            return
        if len(self.order) >= self.s.open_windows:
            used, number = self.order.pop()
            full, gap = self.held.pop(number), self.s.window - used
            if gap >= self.s.least_gap:
                while gap:
                    one = pieces.pop(0)
                    if len(one) > gap:
                        one, rest = one.split(gap)
                        pieces.insert(0, rest)
                    full.append(one)
                    gap -= len(one)
            yield full
            yield from self.put(pieces)
            return
        self.held[self.made] = pieces
        bisect.insort(self.order, (size, self.made))
        self.made += 1

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece) > self.s.window:
            head, piece = piece.split(self.s.window)
            yield [head]
        yield from self.put([piece])

    def rest(self) -> list[list[Piece]]:
        return [self.held[n] for _, n in self.order]

    def last(self) -> Iterator[list[Piece]]:
        """The open windows at the very end, joined and cut anew: full windows, then powers of two, which need no padding."""
        pieces = [p for w in self.rest() for p in w]
        left = sum(map(len, pieces))
        while left:
            want = self.s.window if left >= self.s.window else 1 << (left.bit_length() - 1)
            left -= want
            out = []
            while want:
                one = pieces.pop(0)
                if len(one) > want:
                    one, more = one.split(want)
                    pieces.insert(0, more)
                out.append(one)
                want -= len(one)
            yield out


SCHEMA = "doc_id long, doc_tokens long, row string, start long, length long, ids binary, sequence_id long, offset long, closed boolean, part int"


def batch(windows: list[tuple[list[Piece], int, bool]], part: int) -> pa.RecordBatch:
    rows = []
    for pieces, number, closed in windows:
        offset = 0
        for p in pieces:
            rows.append((*p.tag, p.start, len(p), p.ids, number, offset, closed, part))
            offset += len(p)
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


def numbered(found: Iterator[list[Piece]], part: int, level: int) -> Iterator[tuple[list[Piece], int, bool]]:
    for n, w in enumerate(found):
        yield w, (level << 57) | (part << 33) | n, True


def pack(docs: DataFrame, tokenizer: str, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, doc_tokens, start, length, ids (binary, little-endian unsigned 32-bit), sequence_id, offset.

    A document is its text's ids (null: none) and s.end_id, cut into full windows and one remainder. Each task keeps at
    most s.open_windows; a remainder goes into the fullest in which it fits, and if it fits nowhere the fullest is topped
    up and emitted. The windows still open at a task's end are written with the others to the shared folder, in one table
    that outlives lost executors, and merged level by level, s.fan_in tasks into one by the same rule; the last ones are
    joined and cut into full windows and powers of two. Memory of a task is bounded by its open windows and one batch.
    Repeated rows, also of one doc_id, are documents of their own; an empty table gives no rows.
    """
    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, bins, made = Encoder.of(tokenizer), Bins(s), 0
        end = np.array([s.end_id], dtype="<u4").tobytes()
        nth = 0
        for b in tidied(batches):
            ids, texts = b.column("doc_id"), b.column("text")
            for at in range(0, b.num_rows, 200):
                out = []
                for i, x in zip(ids[at : at + 200].to_pylist(), coder.encode(texts[at : at + 200].to_pylist())):
                    nth += 1
                    for w in bins.add(Piece((i, len(x) // 4 + 1, f"{part}.{nth}"), 0, x + end)):
                        out.append((w, (part << 33) | made, True))
                        made += 1
                if out:
                    yield batch(out, part)
        yield batch([(w, n, False) for n, w in enumerate(bins.rest())], part)

    def merge(last: bool, level: int):
        def run(group: pa.Table) -> pa.Table:
            part = group["part"][0].as_py() // s.fan_in
            rows = sorted(zip(*(group[c].to_pylist() for c in ("part", "sequence_id", "offset", "doc_id", "doc_tokens", "row", "start", "ids"))), key=lambda r: r[:3])
            windows: dict[tuple[int, int], list[Piece]] = {}
            for p, q, _, *tag, start, ids in rows:
                windows.setdefault((p, q), []).append(Piece(tuple(tag), start, ids))
            bins = Bins(s)
            closed = [w for pieces in sorted(windows.values(), key=lambda w: -sum(map(len, w))) for w in bins.put(pieces)]
            if last:
                closed += bins.last()
            opened = [] if last else [(w, n, False) for n, w in enumerate(bins.rest())]
            return pa.Table.from_batches([batch([*numbered(iter(closed), part, level), *opened], part)])

        return run

    ahead = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    written = cut(ahead.mapInArrow(first, SCHEMA))
    open_, done = written.where(~F.col("closed")), [written.where("closed")]
    tasks = (open_.agg(F.max("part")).first()[0] or 0) + 1
    level = 1
    while True:
        last = tasks <= s.fan_in
        merged = cut(open_.groupBy(F.expr(f"part div {s.fan_in}")).applyInArrow(merge(last, level), SCHEMA))
        done.append(merged.where("closed"))
        if last:
            break
        open_, tasks, level = merged.where(~F.col("closed")), -(-tasks // s.fan_in), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "doc_tokens", "start", "length", "ids", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
