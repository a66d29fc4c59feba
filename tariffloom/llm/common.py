"""What the operators of this subpackage share: table access, cutting of lineage, and word hashing over Arrow text columns.

Words are runs of bytes other than space and 0x09-0x0D. They are found and hashed over whole Arrow buffers with
numpy: a prefix sum of ``table[byte] * BASE**i`` gives the hash of every short word by one subtraction, and the same
trick over word hashes gives that of every run of n words. Sums modulo a power of two can be made to collide over long
spans, so words of over SHORT bytes take a digest of their bytes instead, and runs are of a few words only; whole texts
and sets are told apart by cryptographic digests, never by these sums. Equal words always have equal hashes; two
different ones among n share a 64-bit hash with a probability of about n * n / 2**65, so a hash proposes and words decide
wherever a deletion depends on it.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CHUNK_BYTES = 1 << 19  # of text hashed at a time
ROW_GROUP = 16 << 20  # bytes of a table's row group that a task holds while it writes a step's table
SHORT = 32  # bytes of the longest word that is hashed by prefix sums
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS, BATCH_BYTES = 2_000, "2m"  # of one Arrow batch: texts may be long


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library (a cluster gets it by --py-files), and keep batches small in
    sessions that have not set their size: they decide how much text a worker and its JVM hold at a time."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)


def tidied(batches: Iterator[pa.RecordBatch], every: int = 4) -> Iterator[pa.RecordBatch]:
    """The batches; memory that numpy and Arrow have freed goes back to the system after some of them and at the end."""
    n = 0
    for n, batch in enumerate(batches):
        yield batch
        if n % every == every - 1:
            trim()
    trim()


def trim() -> None:
    """Gives freed memory back, and has the C library give back every larger block as soon as it is freed."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(MMAP_THRESHOLD, LARGE_BLOCK)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


MMAP_THRESHOLD, LARGE_BLOCK = -3, 1 << 18  # mallopt's name of the bound from which blocks are mapped by themselves


def trimmed(of_group):
    """A function of a group's tables that gives back what it used; a worker keeps running for the next groups."""

    def run(*tables):
        try:
            return of_group(*tables)
        finally:
            trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local run (tests) gets a temporary folder; a
    cluster, whose machines share none, an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tariffloom-shared")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage: written once to the shared folder, so a lost executor costs no recomputation."""
    return read_back(df, shared_dir(df.sparkSession))


def read_back(df: DataFrame, path: str) -> DataFrame:
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator's steps in the shared folder: cut() adds one, free() deletes one that no later step reads,
    kept() writes the result and deletes the rest."""

    def __init__(self):
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = shared_dir(df.sparkSession)
        out = read_back(df, path)
        self.tables[id(out)] = out, path
        return out

    def free(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self.tables:
                delete(df.sparkSession, self.tables.pop(id(df))[1])

    def kept(self, df: DataFrame) -> DataFrame:
        out = cut(df)
        self.free(*(table for table, _ in list(self.tables.values())))
        return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (constants of the public splitmix64 generator)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n well-spread 64-bit integers that depend only on seed."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


class Powers:
    """Prefix hashing: base**i and its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        self.base = int(seeded(seed, 1)[0]) | 5
        self.up = self.down = np.ones(1, dtype=U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            steps = np.full(size, self.base, dtype=U64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = pow(self.base, -1, 1 << 64)
            self.down = np.cumprod(steps)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64))


BYTES, WORDS = Powers(1), Powers(2)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
EXACT = seeded(3, 256)
FOLDED = EXACT.copy()
FOLDED[ord("A") : ord("Z") + 1] = EXACT[ord("a") : ord("z") + 1]


class Words:
    """The words of rows [first, last) of a text column: byte spans in ``data``, hashes, and where each row's words begin."""

    def __init__(self, first: int, last: int, data: np.ndarray, bounds: np.ndarray, fold: bool, between: np.ndarray):
        self.first, self.last, self.data, self.bounds = first, last, data, bounds
        n = len(data)
        solid = np.zeros(n + 2, dtype=np.int8)
        solid[1:-1] = ~between[data]
        edge = np.diff(solid)
        opens, closes = edge[:-1] == 1, edge[1:] == -1
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        opens[inner] |= solid[inner + 1] == 1
        closes[inner - 1] |= solid[inner] == 1
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        prefix = BYTES.prefix((FOLDED if fold else EXACT)[data])
        self.hash = BYTES.spans(prefix, self.start, self.end)
        for k in np.flatnonzero(self.end - self.start > SHORT).tolist():
            word = data[self.start[k] : self.end[k]].tobytes()
            self.hash[k] = int.from_bytes(hashlib.blake2b(word.lower() if fold else word, digest_size=8).digest(), "little")
        self.rows = np.searchsorted(self.start, bounds)  # words of row k: rows[k]..rows[k + 1]

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on (also of such as reach into the next row); shorter at the end."""
        count = max(0, len(self.hash) - n + 1)
        at = np.arange(count)
        return WORDS.spans(WORDS.prefix(self.hash), at, at + n)


def shingle_sets(column: pa.Array, n: int, fold: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its runs of n words) for each row; of fewer words the whole run, of none nothing."""
    for words in hashed(column, fold):
        prefix = WORDS.prefix(words.hash)
        at = np.arange(max(0, len(words.hash) - n + 1))
        runs = WORDS.spans(prefix, at, at + n)
        for k in range(words.last - words.first):
            a, b = int(words.rows[k]), int(words.rows[k + 1])
            found = runs[a : b - n + 1] if b - a >= n else WORDS.spans(prefix, np.array([a]), np.array([b])) if b > a else runs[:0]
            yield words.first + k, np.unique(found)


def hashed(column: pa.Array, fold: bool, chunk: int = CHUNK_BYTES, between: np.ndarray = SPACE) -> Iterator[Words]:
    """Words of a text column in chunks of whole rows; null is an empty text. between: which bytes separate words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        column = column.fill_null("")
        yield from hashed(column, fold, chunk, between)
        return
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, side="right")) - 1)
        last = min(last, len(column))
        yield Words(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], fold, between)
        first = last
