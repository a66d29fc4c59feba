"""BPE encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidied
from .tokens import WORD_LEVEL, Cache, byte_letters, folded

NEVER = 1 << 30
PAIRS = 400_000  # tested pairs of tokens that a worker remembers, some 40 MB


class Bpe:
    """One tokenizer file: its tokens as strings over 512 symbols (a byte, or a byte that ends a word), its merges as trees."""

    _of: dict[str, Bpe] = {}

    @classmethod
    def of(cls, path: str) -> Bpe:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, suffix = told["model"]["vocab"], told["model"]["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in told["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        letters = byte_letters()
        symbols = {letters[b]: b for b in letters}
        self.size: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.rises: dict[int, list[tuple[int, int]]] = {}  # right spine of a token: (rank of the merge that makes the node, node)
        self.falls: dict[int, list[tuple[int, int]]] = {}  # left spine
        spelled: dict[int, str] = {}
        for b, c in letters.items():
            spelled[vocab[c]], spelled[vocab[c + suffix]] = chr(b), chr(256 + b)
        for n, merge in enumerate(told["model"]["merges"]):
            a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank.setdefault((a, b), n)
            whole = self.names[a] + self.names[b]
            if (t := vocab[whole]) not in self.parts and t not in spelled:
                self.parts[t] = (a, b)
                spelled[t] = "".join(chr(symbols[c]) for c in whole.removesuffix(suffix))
                if whole.endswith(suffix):
                    spelled[t] = spelled[t][:-1] + chr(256 + ord(spelled[t][-1]))
        self.fits: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        for t, s in spelled.items():
            if t not in self.parts or self.apart(*self.parts[t], until=self.rank[self.parts[t]]):
                self.size[t] = len(s)
                self.matches.add_word(s, (t, len(s)))
        self.matches.make_automaton()
        self.pieces, self.stretches = Cache(self.piece, 16 << 20), Cache(self.stretch, 96 << 20)

    def spine(self, token: int, side: int, kept: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The nodes that hold the token's outermost symbol on one side, from that symbol up, each with its merge's rank."""
        if token not in kept:
            below = self.parts.get(token)
            kept[token] = [*self.spine(below[side], side, kept), (self.rank[below], token)] if below else [(-1, token)]
        return kept[token]

    def apart(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether left and right side by side stay two tokens: no merge across their border comes before ``until``.

        Merges apply by rank, the leftmost first. While both sides grow along their spines, the nodes at the border merge
        across it if that rank is below the left side's next one and not above the right side's next one.
        """
        a, b = self.spine(left, 1, self.rises), self.spine(right, 0, self.falls)
        i = j = 0
        while True:
            across = self.rank.get((a[i][1], b[j][1]), NEVER)
            up = a[i + 1][0] if i + 1 < len(a) else NEVER
            down = b[j + 1][0] if j + 1 < len(b) else NEVER
            if across < until and across < up and across <= down:
                return False
            if up == down == NEVER:
                return True
            if up <= down:
                i += 1
            else:
                j += 1

    def piece(self, text: str) -> bytes:
        """Ids of one piece: for every prefix, the one last token that is a match and stands apart from the token before."""
        raw = text.encode("utf-8")
        word = "".join(map(chr, raw[:-1])) + chr(256 + raw[-1])
        last: list[int] = [-1] * (len(word) + 1)
        fits = self.fits
        for end, (token, size) in self.matches.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            if size < end:
                before = last[end - size]
                pair = before << 20 | token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) > PAIRS:
                        fits.clear()
                    fits[pair] = ok = self.apart(before, token)
                if not ok:
                    continue
            last[end] = token
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return np.array(out[::-1], dtype="<u4").tobytes()

    def stretch(self, text: str) -> bytes:
        word = folded(text)
        if word.isalpha():
            return self.piece(word)
        return b"".join([self.pieces[p] for p in WORD_LEVEL.findall(word)])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes; an added token's string in a text is that token."""
        known, out = self.stretches.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif any(x in text for x in self.added):
                out.append(b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else b"".join(map(known, p.split(" "))) for p in self.cut.split(text)))
            else:
                out.append(b"".join(map(known, text.split(" "))))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings joined by spaces, as the library does for a file that names no decoder; unknown ids are left out."""
        names = self.names
        return " ".join([names[i] for i in ids.tolist() if i in names])


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null and empty texts have no ids, repeated rows stay repeated."""

    def run(batches):
        model = Bpe.of(tokenizer)
        for b in tidied(batches):
            for at in range(0, b.num_rows, 100):
                found = model.encode(b.column("text")[at : at + 100].to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at : at + 100], ids], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and decoded, the text that the ids stand for; null ids decode to an empty text."""

    def run(batches):
        model = Bpe.of(tokenizer)
        for b in tidied(batches):
            for at in range(0, b.num_rows, 100):
                some = b.slice(at, 100)
                texts = [model.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in some.column("ids")]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = public_tokenizers.path("word_bpe_49k.json")
    done = decode(encode(table(spark, sf_dir, "documents"), path), path)
    listed = F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string")))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
