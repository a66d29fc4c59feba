"""Token files: patched frame-of-reference blocks with an index of block starts, written and read back."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, tidied
from .tokens import Encoder

MAGIC = b"PFR1"


@dataclass(frozen=True)
class Settings:
    """block: ids of one frame. percentile: share of a block's ids that its width must hold. segment: ids after which a
    file segment ends at the next document. part_bytes: of text that one task writes at most, about. end_id: appended to
    every document."""

    block: int = 1024
    percentile: float = 0.95
    segment: int = 1 << 20
    part_bytes: int = 128 << 20
    end_id: int = 1


def pack_blocks(ids: np.ndarray, size: int, percentile: float) -> list[bytes]:
    """Each block: minimum (4 bytes), count (4), width (1), number of outliers (4), packed low bits, outliers' places and
    whole offsets. The width holds the given share of the block's offsets from its minimum."""
    out = []
    whole = len(ids) // size * size
    for part in (ids[:whole].reshape(-1, size), ids[None, whole:]):
        if part.size == 0:
            continue
        low = part.min(axis=1)
        rest = (part - low[:, None]).astype("<u4")
        nth = int(np.ceil(percentile * (rest.shape[1] - 1)))
        widths = [int(x).bit_length() for x in np.partition(rest, nth, axis=1)[:, nth]]
        bits = np.unpackbits(rest.view(np.uint8).reshape(*rest.shape, 4), axis=2, bitorder="little")
        for k, width in enumerate(widths):
            outside = np.flatnonzero(rest[k] >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
            body = np.packbits(bits[k, :, :width], bitorder="little").tobytes()
            out.append(struct.pack("<IIBI", int(low[k]), rest.shape[1], width, len(outside)) + body + outside.astype("<u4").tobytes() + rest[k, outside].tobytes())
    return out


def unpack_block(data: bytes) -> np.ndarray:
    low, count, width, outliers = struct.unpack_from("<IIBI", data)
    at = 13 + (count * width + 7) // 8
    bits = np.zeros((count, 32 if width > 16 else 16), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, at - 13, 13), count=count * width, bitorder="little").reshape(count, width)
    rest = np.packbits(bits, axis=1, bitorder="little").view("<u4" if width > 16 else "<u2").ravel().astype(np.uint32)
    if outliers:
        rest[np.frombuffer(data, "<u4", outliers, at)] = np.frombuffer(data, "<u4", outliers, at + 4 * outliers)
    return rest + np.uint32(low)


def write_segment(documents: list[tuple[int | None, bytes]], s: Settings) -> bytes:
    """One segment: magic, counts, documents' keys, null flags and lengths, index of block starts, blocks."""
    keys = np.array([i or 0 for i, _ in documents], dtype="<i8")
    none = np.array([i is None for i, _ in documents], dtype=np.uint8)
    sizes = np.array([len(x) // 4 for _, x in documents], dtype="<u4")
    ids = np.frombuffer(b"".join(x for _, x in documents), dtype="<u4")
    blocks = [b for at in range(0, len(ids), 64 * s.block) for b in pack_blocks(ids[at : at + 64 * s.block], s.block, s.percentile)]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<III", len(documents), len(blocks), s.block), keys.tobytes(), none.tobytes(), sizes.tobytes(), starts.tobytes(), *blocks])


def read_segment(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's key and ids; raises if the bytes are no whole segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    documents, blocks, _ = struct.unpack_from("<III", data, 4)
    at = 16
    keys = np.frombuffer(data, "<i8", documents, at)
    none = np.frombuffer(data, np.uint8, documents, at := at + 8 * documents)
    sizes = np.frombuffer(data, "<u4", documents, at := at + documents)
    starts = np.frombuffer(data, "<u8", blocks + 1, at := at + 4 * documents)
    at += 8 * (blocks + 1)
    parts = [unpack_block(data[at + int(a) : at + int(b)]) for a, b in zip(starts[:-1], starts[1:])]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    ends = np.cumsum(sizes, dtype=np.int64)
    for key, gone, end, size in zip(keys, none, ends, sizes):
        yield None if gone else int(key), ids[end - size : end]


def write(docs: DataFrame, path: str, tokenizer: str, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents in ascending doc_id order (null first; ties by content).

    Files are Spark's, so that any store works; each row is one segment: part and segment number it in order, documents
    and ids count it, inside counts the ids before it in its part, data holds its bytes. Rows are dealt by ranges of doc_id and a hash of the text, so rows repeating
    one id spread over tasks; one segment and its documents are in memory at a time, a segment that one very long text
    fills beyond s.segment included. Null ids come back null; null texts have the end id alone; an empty table gives
    files without rows.
    """
    spark = docs.sparkSession
    ahead = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("spread"), F.col(text).alias("text"))
    total = ahead.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // s.part_bytes)
    ahead = ahead.repartitionByRange(parts, "doc_id", "spread").sortWithinPartitions("doc_id", "spread")

    def run(batches):
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), Encoder.of(tokenizer)
        end = np.array([s.end_id], dtype="<u4").tobytes()
        held, size, number, inside = [], 0, 0, 0

        def segment():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "documents": [len(held)], "ids": [size], "inside": [inside], "data": [write_segment(held, s)]})

        for b in tidied(batches):
            for at in range(0, b.num_rows, 200):
                for i, x in zip(b.column("doc_id")[at : at + 200].to_pylist(), coder.encode(b.column("text")[at : at + 200].to_pylist())):
                    held.append((i, x + end))
                    size += len(x) // 4 + 1
                    if size >= s.segment:
                        yield segment()
                        inside += size
                        held, size, number = [], 0, number + 1
        if held:
            yield segment()

    ahead.mapInArrow(run, "part int, segment int, documents long, ids long, inside long, data binary").write.parquet(path)


PARTS = 1_000_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of such files: doc_id, start (ids of all documents before it), n_tokens, ids (binary).

    A segment's start is the ids before it in its part, which its row holds, and those of the parts before. Of these there are
    as many as tasks that wrote: one row each, broadcast up to PARTS."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = F.broadcast(before) if parts.count() <= PARTS else before

    def run(batches):
        for b in tidied(batches):
            for data, first in zip(b.column("data").to_pylist(), b.column("first").to_pylist()):
                found = list(read_segment(data))
                sizes = np.array([len(x) for _, x in found], dtype=np.int64)
                ids = pa.array([x.astype("<u4").tobytes() for _, x in found], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in found], pa.int64()), "start": first + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids": ids})

    return files.join(before, "part").select("data", (F.col("before") + F.col("inside")).alias("first")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op7_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
