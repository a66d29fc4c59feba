"""Substring dedup: words covered by a run of n words that also starts earlier are removed.

Candidates come from hashes: every window of n words picks its phrase of k words with the smallest hash, so equal windows
pick equal phrases; of the windows whose phrase recurs, those whose own hash recurs point to the earliest place that has
it. Hashes only propose: equal words always have equal hashes, so nothing is missed, and what they propose is a stretch
of the earliest document (a passage), fetched once as words.

Documents are dealt to shards. Each shard compiles the passages that may occur in it into Aho-Corasick automata over
words, streams all of its documents through them, and takes every occurrence from there: a passage is cut into blocks of
half a window, of which any window in it holds one, and a located block is extended word by word on both sides. Words go
only where a whole window of equal words was seen at an earlier place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, cut, hashed, tidied, trimmed
from .hot import with_values

U64, I64 = np.uint64, np.int64


@dataclass(frozen=True)
class Settings:
    """window: words of a run that is removed. phrase: words that one of its selected phrases has. tile: window starts of
    one passage. group_bytes: text that a task holds at a time. automaton_words: of the passages of one automaton.
    pairs: located blocks that are extended at a time. filter_rows: keys of documents that are broadcast at most."""

    window: int = 20
    phrase: int = 6
    tile: int = 64
    group_bytes: int = 2 << 20
    automaton_words: int = 100_000
    pairs: int = 200_000
    filter_rows: int = 1_000_000

    @property
    def block(self) -> int:
        return (self.window + 1) // 2


def picked(words: Words, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside rows, the place of the phrase that each picks, and the hashes of all phrases."""
    phrases = words.grams(s.phrase)
    ends = np.repeat(words.rows[1:], np.diff(words.rows))
    starts = np.flatnonzero(np.arange(len(words.hash)) + s.window <= ends)
    if len(starts) == 0:
        return starts, starts, phrases
    least = np.lib.stride_tricks.sliding_window_view(phrases, s.window - s.phrase + 1).argmin(axis=1)
    return starts, starts + least[starts], phrases


def groups(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, slice) of each run in sorted keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1 if len(keys) else np.zeros(0, int)
    edges = [0, *cuts.tolist(), len(keys)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(keys[a]), slice(a, b)


#: A document row tells one document's facts. The other kinds are packed for one part: entries hold hashes with the
#: places that have them, known rows what is known of documents (doc_id and stamp in docs, counted by who).
PACKED = "kind int, part long, doc_id long, none boolean, stamp long, n_words long, sha256 string, hashes binary, who binary, starts binary, docs binary"
NAMES = [x.split(" ")[0] for x in PACKED.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
DOCUMENT, ENTRIES, KNOWN = 0, 1, 2


def packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(NAMES, TYPES)], names=NAMES)


def entries(hashes: np.ndarray, who: np.ndarray, starts: np.ndarray | None, ids: np.ndarray, marks: np.ndarray, reducers: int) -> list[dict]:
    """Entries packed for each reducer; who counts documents in ids (doc_id, stamp)."""
    part = (hashes % U64(reducers)).astype(I64)
    order = np.argsort(part, kind="stable")
    out = []
    for key, at in groups(part[order]):
        own, place = np.unique(who[order[at]], return_inverse=True)
        marked = place.astype(np.uint32) << np.uint32(1) | marks[order[at]].astype(np.uint32)
        row = {"kind": ENTRIES, "part": key, "hashes": hashes[order[at]].tobytes(), "who": marked.tobytes(), "docs": ids[own].tobytes()}
        out.append(row if starts is None else row | {"starts": starts[order[at]].astype(np.int32).tobytes()})
    return out


def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """hashes, doc_id, stamp, starts, marks of all entries of a reducer."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for h, w, s, d in zip(*(table[c].to_pylist() for c in ("hashes", "who", "starts", "docs"))):
        w, d = np.frombuffer(w, np.uint32), np.frombuffer(d, I64).reshape(-1, 2)
        starts = np.frombuffer(s, np.int32) if s else np.zeros(len(w), np.int32)
        for to, x in zip(out, (np.frombuffer(h, U64), d[w >> 1, 0], d[w >> 1, 1], starts, (w & 1).astype(bool))):
            to.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, I64) for x in out)


def known(part: np.ndarray, doc_id: np.ndarray, stamp: np.ndarray, values: np.ndarray, column: str) -> list[dict]:
    """Distinct values for documents, packed for each part: recurring phrases ("hashes") or tiles wanted of them ("starts")."""
    order = np.lexsort((values, doc_id, stamp, part))
    part, doc_id, stamp, values = part[order], doc_id[order], stamp[order], values[order]
    changed = np.ones(len(order), bool)
    changed[1:] = (doc_id[1:] != doc_id[:-1]) | (stamp[1:] != stamp[:-1]) | (part[1:] != part[:-1])
    fresh = changed.copy()
    fresh[1:] |= values[1:] != values[:-1]
    out = []
    for key, at in groups(part):
        keep, first = fresh[at], changed[at]
        docs = np.stack([doc_id[at][first], stamp[at][first]], axis=1)
        who = (np.cumsum(first) - 1)[keep].astype(np.uint32)
        out.append({"kind": KNOWN, "part": key, "who": who.tobytes(), column: values[at][keep].tobytes(), "docs": docs.tobytes()})
    return out


def gathered(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All that is known for one part: documents (doc_id, stamp) and their values, distinct and sorted by document."""
    ids, values = [], []
    for w, d, x in zip(*(table[c].to_pylist() for c in ("who", "docs", column))):
        ids.append(np.frombuffer(d, I64).reshape(-1, 2)[np.frombuffer(w, np.uint32)])
        values.append(np.frombuffer(x, kind))
    ids, values = np.concatenate(ids), np.concatenate(values)
    order = np.lexsort((values, ids[:, 0], ids[:, 1]))
    ids, values = ids[order], values[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ids[1:] != ids[:-1]).any(axis=1) | (values[1:] != values[:-1])
    return ids[fresh], values[fresh]


def phrases_of_documents(table: pa.Table) -> pa.Table:
    """One row for each document of a shard, with its recurring phrases."""
    ids, values = gathered(table, "hashes", U64)
    changed = np.ones(len(ids), bool)
    changed[1:] = (ids[1:] != ids[:-1]).any(axis=1)
    found = [values[at].tobytes() for _, at in groups(np.cumsum(changed))]
    part = pa.array([table["part"][0].as_py()] * len(found), pa.int64())
    return pa.Table.from_arrays([part, pa.array(ids[changed, 0]), pa.array(ids[changed, 1]), pa.array(found, pa.binary())], names=["part", "doc_id", "stamp", "hashes"])


def tiles_of_shard(table: pa.Table) -> pa.Table:
    """One row for each tile that a shard wants."""
    ids, values = gathered(table, "starts", np.int32)
    part = pa.array([table["part"][0].as_py()] * len(values), pa.int64())
    return pa.Table.from_arrays([part, pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(values)], names=["part", "doc_id", "stamp", "tile"])


def scan(s: Settings, reducers: int, shards: int):
    """First pass: each document's word count and digest of its words, and the phrases that its windows pick."""

    def run(batches):
        for b in tidied(batches):
            texts, none = b.column("text"), b.column("none").to_pylist()
            ids = np.stack([b.column("doc_id").to_numpy(), b.column("stamp").to_numpy()], axis=1)
            rows, hashes, who = [], [], []
            for words in hashed(texts, fold=False):
                for k in range(words.last - words.first):
                    at = words.first + k
                    body = words.data[words.bounds[k] : words.bounds[k + 1]].tobytes()
                    rows.append({"kind": DOCUMENT, "doc_id": int(ids[at, 0]), "none": none[at], "stamp": int(ids[at, 1]), "n_words": int(words.rows[k + 1] - words.rows[k]), "sha256": hashlib.sha256(b" ".join(body.split())).hexdigest()})
                _, places, phrases = picked(words, s)
                places = np.unique(places)
                hashes.append(phrases[places])
                who.append(words.first + np.searchsorted(words.rows, places, side="right") - 1)
            for at in range(0, len(rows), 2000):
                yield packed(rows[at : at + 2000])
            seen: set[str] = set()
            same = np.zeros(b.num_rows, bool)  # a copy of a text with a smaller or equal doc_id in this batch
            for k in np.argsort(ids[:, 0], kind="stable").tolist():
                same[k] = rows[k]["sha256"] in seen
                seen.add(rows[k]["sha256"])
            h, w = (np.concatenate(x) if x else np.zeros(0, I64) for x in (hashes, who))
            if len(h) == 0:
                continue
            keep = ~same[w]
            order = np.argsort(h[keep], kind="stable")
            h, w = h[keep][order], w[keep][order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            again = np.zeros(len(h), bool)
            again[:-1] = ~first[1:]
            again |= ~first
            yield packed(entries(h[first], w[first], None, ids, again[first], reducers))
            yield packed(known(np.mod(ids[w[again], 1], shards), ids[w[again], 0], ids[w[again], 1], h[again], "hashes"))

    return run


def recurring(table: pa.Table, shards: int) -> pa.Table:
    """A reducer's phrases that different texts, or one batch twice, have picked."""
    h, doc_id, stamp, _, marks = unpacked(table)
    order = np.lexsort((stamp, h))
    h, doc_id, stamp, marks = h[order], doc_id[order], stamp[order], marks[order]
    group = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    differs = np.zeros(len(h), bool)
    differs[1:] = (h[1:] == h[:-1]) & (stamp[1:] != stamp[:-1])
    often = np.bincount(group, weights=differs | marks) > 0 if len(h) else np.zeros(0, bool)
    give = often[group] & ~marks if len(h) else np.zeros(0, bool)
    return pa.Table.from_batches([packed(known(np.mod(stamp[give], shards), doc_id[give], stamp[give], h[give], "hashes"))])


def candidates(s: Settings, reducers: int):
    """Windows of a shard's texts whose phrase recurs: the first place of each hash, marked if the shard has it again."""

    def run(texts: pa.Table, recur: pa.Table) -> pa.Table:
        if not texts.num_rows or not recur.num_rows:
            return pa.Table.from_batches([packed([])])
        phrases = np.unique(np.concatenate([np.frombuffer(x, U64) for x in recur["hashes"].to_pylist()]))
        ids = np.stack([texts["doc_id"].to_numpy(), texts["stamp"].to_numpy()], axis=1)
        hashes, who, begins = [], [], []
        for words in hashed(texts["text"], fold=False):
            starts, places, grams = picked(words, s)
            starts = starts[np.isin(grams[places], phrases)]
            row = np.searchsorted(words.rows, starts, side="right") - 1
            hashes.append(words.grams(s.window)[starts])
            who.append(words.first + row)
            begins.append(starts - words.rows[row])
        h, w, b = np.concatenate(hashes), np.concatenate(who), np.concatenate(begins)
        order = np.lexsort((b, ids[w, 0], h))
        h, w, b = h[order], w[order], b[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        again = np.zeros(len(h), bool)
        again[:-1] = ~first[1:]
        return pa.Table.from_batches([packed(entries(h[first], w[first], b[first], ids, again[first], reducers))])

    return run


def wanted(s: Settings, shards: int):
    """Tiles of the documents that have a reducer's recurring windows first, for the shards that have them later."""

    def run(table: pa.Table) -> pa.Table:
        h, doc_id, stamp, start, marks = unpacked(table)
        order = np.lexsort((start, doc_id, h))
        h, doc_id, stamp, start, marks = h[order], doc_id[order], stamp[order], start[order], marks[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        give = ~first | marks
        at = (np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.zeros(0, int))[give]
        return pa.Table.from_batches([packed(known(np.mod(stamp[give], shards), doc_id[at], stamp[at], start[at] // s.tile, "starts"))])

    return run


def passages(s: Settings):
    """The words of each wanted tile of a text: the windows that start in it."""

    def run(batches):
        for b in tidied(batches):
            out = []
            for i, stamp, text, tiles in zip(*(b.column(c).to_pylist() for c in ("doc_id", "stamp", "text", "tiles"))):
                body = text.encode("utf-8").split()
                out += [(i, stamp, t, b" ".join(body[t * s.tile : (t + 1) * s.tile + s.window - 1]).decode("utf-8")) for t in tiles]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "stamp", "tile", "words"])

    return run


def letters(codes: np.ndarray) -> str:
    """Small numbers as the characters of a string, without surrogates."""
    return (codes + 2048 * (codes >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")


UNKNOWN, BORDER = 1, 2  # codes: of a word that no passage has, or a text's end; and of a passage's end


def compiled(chunk: list[tuple[int, int, list[bytes]]], s: Settings):
    """An automaton of the blocks of some passages (doc_id, start, words), and what its matches stand for.

    The vocabulary, the passages' words as codes with a border of a block's length around each, and for each block's
    number, where it stands there; for each code, its passage."""
    import ahocorasick

    vocabulary: dict[bytes, int] = {}
    codes, owner, blocks = [BORDER] * s.block, [-1] * s.block, {}
    for n, (_, _, words) in enumerate(chunk):
        at = len(codes)
        codes += [vocabulary.setdefault(w, len(vocabulary) + 3) for w in words]
        owner += [n] * len(words)
        for k in range(0, len(words) - s.block + 1, s.block):
            blocks.setdefault(tuple(codes[at + k : at + k + s.block]), []).append(at + k)
        codes += [BORDER] * s.block
        owner += [-1] * s.block
    automaton = ahocorasick.Automaton()
    for n, block in enumerate(blocks):
        automaton.add_word(letters(np.array(block, np.uint32)), n)
    automaton.make_automaton()
    places = [np.array(x, I64) for x in blocks.values()]
    return automaton, vocabulary, np.array(codes, np.uint32), np.array(owner, I64), places


def extended(text: np.ndarray, at: np.ndarray, codes: np.ndarray, place: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and after a located block agree with the passage, a block's length at most."""
    sides = []
    for step, origin in ((-1, 0), (1, s.block - 1)):
        alive, length = np.ones(len(at), bool), np.zeros(len(at), I64)
        for k in range(1, s.block + 1):
            alive &= text[at + origin + step * k] == codes[place + origin + step * k]
            length += alive
        sides.append(length)
    return sides[0], sides[1]


def located(bodies: list[list[bytes]], doc_ids: np.ndarray, found: list[tuple[int, int, list[bytes]]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Which words of all bodies are covered by a window that starts earlier in a passage's document, and where bodies begin.

    The automata alone find the places. Bodies stand one after another with a border of a block's length between them."""
    sizes = np.array([len(b) + s.block for b in bodies], I64)
    begins = s.block + np.cumsum(sizes) - sizes
    depth = np.zeros(int(s.block + sizes.sum()) + 1, np.int32)
    chunk, held = [], 0
    for n, passage in enumerate(found):
        chunk.append(passage)
        held += len(passage[2])
        if held < s.automaton_words and n + 1 < len(found):
            continue
        automaton, vocabulary, codes, owner, places = compiled(chunk, s)
        text, code = np.full(len(depth) - 1, UNKNOWN, np.uint32), vocabulary.get
        for a, body in zip(begins.tolist(), bodies):
            text[a : a + len(body)] = [code(w, UNKNOWN) for w in body]
        hits = np.array(list(automaton.iter(letters(text))) if places else [], I64).reshape(-1, 2)
        docs, starts = np.array([d for d, _, _ in chunk], I64), np.array([b for _, b, _ in chunk], I64)
        opens = s.block + np.cumsum([0, *(len(w) + s.block for _, _, w in chunk[:-1])])
        often = np.array([len(p) for p in places], I64)
        total = np.cumsum(often[hits[:, 1]]) if len(hits) else np.zeros(0, I64)
        first = 0
        while first < len(hits):
            done = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, done + s.pairs, side="right")))
            some = hits[first:last]
            at = np.repeat(some[:, 0] - s.block + 1, often[some[:, 1]])
            place = np.concatenate([places[b] for b in some[:, 1].tolist()])
            before, after = extended(text, at, codes, place, s)
            row = np.searchsorted(begins, at, side="right") - 1
            own = owner[place]
            earlier = (docs[own] < doc_ids[row]) | (docs[own] == doc_ids[row]) & (starts[own] + place - opens[own] < at - begins[row])
            hit = earlier & (before + after + s.block >= s.window)
            np.add.at(depth, at[hit] - before[hit], 1)
            np.add.at(depth, at[hit] + s.block + after[hit], -1)
            first = last
        chunk, held = [], 0
    return np.cumsum(depth[:-1]) > 0, begins


def removed(s: Settings):
    """A shard's texts without the words that windows known to start earlier cover."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows and found.num_rows:
            order = np.argsort(texts["doc_id"].to_numpy(), kind="stable")
            doc_ids, stamps = texts["doc_id"].to_numpy()[order], texts["stamp"].to_numpy()[order].tolist()
            column = texts["text"]
            bodies = [(column[k].as_py() or "").encode("utf-8").split() for k in order.tolist()]
            gone, begins = located(bodies, doc_ids, [(d, b, w.encode("utf-8").split()) for d, b, w in zip(*(found[c].to_pylist() for c in ("doc_id", "start", "words")))], s)
            for i, stamp, body, a in zip(doc_ids.tolist(), stamps, bodies, begins.tolist()):
                here = gone[a : a + len(body)]
                if here.any():
                    kept = b" ".join([w for w, g in zip(body, here.tolist()) if not g])
                    out.append((i, stamp, hashlib.sha256(b" ".join(body)).hexdigest(), int(here.sum()), kept.decode("utf-8")))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "stamp", "sha256", "n_removed", "kept"])

    return run


EMPTY = hashlib.sha256(b"").hexdigest()
NO_ID = -(2**63)  # stands for a null doc_id, which is before all others


def has_window(s: Settings, text: str = "text") -> Column:
    """Whether a text has as many words as a window; only so many are looked at."""
    word, gap = r"[^ \t-\r]++", r"[ \t-\r]++"
    return F.coalesce(F.col(text).rlike(rf"\A[ \t-\r]*+(?:{word}{gap}){{{s.window - 1}}}[^ \t-\r]"), F.lit(False))


def remove_repeats(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, n_words, n_removed, kept_sha256, stamp (a hash of the text), and kept where words were removed.

    A text whose whole word sequence a smaller doc_id has too (told by SHA-256 over its words) loses all its words, if it
    has a window at all, so groups of exact copies cost nothing more. Texts with fewer words than a window lose none and are
    not dealt out, nulls and empty ones among them. All others are streamed through the automata of
    their shard. Texts are dealt by their own hash, so neither one doc_id nor rows without any gather in a task; every
    batch and shard passes on one place for each phrase or window, so a passage in a third of all texts reaches a
    reducer once for each batch, not once for each text. A shard holds about s.group_bytes of text, or one longer text.
    Null texts have no words. A null doc_id is smaller than all others. Rows that repeat a doc_id are judged alike, as
    nothing starts earlier than itself; an empty table gives no rows, and other columns don't matter.
    """
    work = Scratch()
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(doc_id).isNull().alias("none"), F.col(text).alias("text"), F.xxhash64(text).alias("stamp"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = reducers = max(12, total // s.group_bytes)
    first = work.cut(rows.mapInArrow(scan(s, reducers, shards), PACKED))
    every = first.where(F.col("kind") == DOCUMENT).select("doc_id", "none", "stamp", "n_words", "sha256")
    origin = work.cut(every.groupBy("sha256").agg(F.min("doc_id").alias("origin"), F.count("*").alias("n")).where("n > 1"))
    copy = F.coalesce((F.col("doc_id") > F.col("origin")) & (F.col("n_words") >= s.window), F.lit(False))
    every = work.cut(with_values(every, origin, "sha256", "n", how="left").withColumn("copy", copy).drop("origin", "n"))
    hint = lambda keys: F.broadcast(keys) if keys.count() <= s.filter_rows else keys
    copies = hint(work.cut(every.where("copy").select("doc_id", "stamp").distinct()))
    twice = work.cut(every.where(f"NOT copy AND n_words >= {s.window}").groupBy("doc_id", "stamp").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "stamp"))
    key = ["doc_id", "stamp"]
    texts = rows.where(has_window(s)).drop("none").join(copies, key, "left_anti")
    if not twice.isEmpty():
        twice = hint(twice)
        texts = texts.join(twice, key, "left_anti").unionByName(texts.join(twice, key, "left_semi").dropDuplicates(key))

    def packed_for(df: DataFrame, kind: int, *columns: str):
        return df.where(F.col("kind") == kind).select("part", "who", "docs", *columns)

    found = work.cut(packed_for(first, ENTRIES, "hashes", "starts").groupBy("part").applyInArrow(lambda t: trimmed(recurring)(t, shards), PACKED))
    phrases = packed_for(first, KNOWN, "hashes").unionByName(packed_for(found, KNOWN, "hashes"))
    phrases = work.cut(phrases.groupBy("part").applyInArrow(lambda t: trimmed(phrases_of_documents)(t), "part long, doc_id long, stamp long, hashes binary").join(copies, key, "left_anti"))
    work.free(first, found)
    keys = hint(phrases.select("doc_id", "stamp"))
    shard = F.pmod("stamp", F.lit(shards)).alias("part")
    held = texts.join(keys, key, "left_semi").select("*", shard).groupBy("part")
    windows = work.cut(held.cogroup(phrases.groupBy("part")).applyInArrow(lambda a, b: trimmed(candidates(s, reducers))(a, b), PACKED))
    later = work.cut(packed_for(windows, ENTRIES, "hashes", "starts").groupBy("part").applyInArrow(lambda t: trimmed(wanted(s, shards))(t), PACKED))
    work.free(windows, phrases)
    tiles = work.cut(packed_for(later, KNOWN, "starts").groupBy("part").applyInArrow(lambda t: trimmed(tiles_of_shard)(t), "part long, doc_id long, stamp long, tile int"))
    of_text = tiles.groupBy("doc_id", "stamp").agg(F.collect_set("tile").alias("tiles"))
    of_text = F.broadcast(of_text) if tiles.count() <= s.filter_rows else of_text
    taken = work.cut(texts.join(of_text, key).select("doc_id", "stamp", "text", "tiles").mapInArrow(passages(s), "doc_id long, stamp long, tile int, words string"))
    sent = tiles.join(taken, [*key, "tile"]).select("part", "doc_id", (F.col("tile") * s.tile).alias("start"), "words")
    changed = texts.select("*", shard).groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(lambda a, b: trimmed(removed(s))(a, b), "doc_id long, stamp long, sha256 string, n_removed long, kept string")
    whole = F.col("copy") | (F.col("n_words") < s.window)  # removed or kept as a whole
    of_changed = {f.name: F.lit(None).cast(f.dataType) for f in changed.schema.fields if f.name in ("n_removed", "kept")}
    out = every.where(~whole).join(changed, [*key, "sha256"], "left").unionByName(every.where(whole).withColumns(of_changed))
    gone = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return work.kept(out.select(
        F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_words", gone.cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"), "stamp",
    ))


def rewrite(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All rows and columns of docs; texts that lost words are the kept words joined by spaces, with n_chars to match.

    Only rewritten texts are shuffled; the list of their ids is broadcast up to s.filter_rows and joined beyond. Other
    columns are passed on, whatever their names."""
    changed = cut(remove_repeats(docs, s).where("n_removed > 0").select("doc_id", "stamp", "kept").distinct())
    ids = cut(changed.select("doc_id").distinct())
    ids = (F.broadcast(ids) if ids.count() <= s.filter_rows else ids).alias("ids")
    whole = docs.alias("docs")
    listed = F.col("docs.doc_id").eqNullSafe(F.col("ids.doc_id"))
    new = changed.alias("new")
    met = F.col("docs.doc_id").eqNullSafe(F.col("new.doc_id")) & (F.xxhash64("docs.text") == F.col("new.stamp"))
    done = whole.join(ids, listed, "left_semi").join(new, met, "left")
    size = F.when(F.col("new.kept").isNotNull(), F.length("new.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("docs.n_chars")) if "n_chars" in docs.columns else None
    given = {"text": F.coalesce("new.kept", "docs.text"), "n_chars": size}
    columns = [given.get(c, F.col(f"docs.`{c}`")).alias(c) for c in docs.columns]
    return whole.join(ids, listed, "left_anti").select(docs.columns).unionByName(done.select(columns))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
