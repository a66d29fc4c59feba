"""Token ids of whole texts by the tokenizers library, each distinct piece of a text encoded once in a worker."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable
from unicodedata import normalize

import regex
from tokenizers import Tokenizer

SHORT = 64  # characters of the longest key that a cache keeps
ENTRY = 180  # bytes of an entry besides its ids, about
#: Runs of white space that a split at single spaces would encode differently from the whole text.
LONG_GAP = re.compile(r"\s\s\s|\s\s\Z")
ODD_SPACE = re.compile(r"[^\S \n]")
#: The public pre-tokenizer pattern of the byte-level tokenizer.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: That of the word tokenizer, with its white space written as a property.
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
MARKS = frozenset(".,")


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in plain)}


BYTE_LETTERS = byte_letters()
SPACE_LETTER = BYTE_LETTERS[ord(" ")]
PACKED = [struct.Struct(f"<{n}I").pack for n in range(16)]


def folded(text: str) -> str:
    """The word tokenizer's normal form: NFC, then each character in lower case."""
    if text.isascii():
        return text.lower()
    text = normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Cache(dict):
    """Computes what it lacks. It keeps short keys only, in two generations of half its bytes each: when the young one is
    full, it becomes the old one, from which what is asked for again comes back."""

    def __init__(self, of, size: int):
        super().__init__()
        self.of, self.half, self.held, self.old = of, size // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.of(key)
            if len(key) > SHORT:
                return found
        self.held += ENTRY + len(found)
        if self.held > self.half:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text is split at its spaces. Both kinds of pre-tokenizer in use (byte level, where a word takes the space before
    it, and white space dropped) never join what stands on both sides of such a space, so a stretch encodes by itself to
    what it gives inside the text, and so do the pre-tokenizer's pieces of it. Texts in which that may fail - gaps of
    three or more white space characters, or strings of added tokens - are encoded whole.
    """

    _of: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per file in each worker process, so that the caches outlive a task."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [x["content"] for x in told["added_tokens"]]
        self.keeps_space = (told["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        self.pieces = Cache(self.direct, 8 << 20)
        if self.keeps_space:
            self.first = Cache(lambda w: self.split("", w), 4 << 20)
            self.later = Cache(lambda w: self.split(" ", w), 112 << 20)
        else:
            self.first = self.later = Cache(self.parted, 112 << 20)

    def direct(self, text: str) -> bytes:
        word = text[1:] if self.keeps_space and text[:1] == " " else text
        if word.isalpha():
            # letters alone have nothing to split, so the model gives the ids of their bytes' letters
            spelled = text.replace(" ", SPACE_LETTER) if text.isascii() else text.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in self.whole.model.tokenize(spelled)]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else struct.pack(f"<{len(ids)}I", *ids)

    def split(self, space: str, word: str) -> bytes:
        if word.isalpha():
            return self.direct(space + word)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return (self.later if space else self.first)[word[:-1]] + self.pieces[word[-1]]
        return b"".join([self.pieces[p] for p in BYTE_LEVEL.findall(space + word)])

    def parted(self, stretch: str) -> bytes:
        word = folded(stretch)
        if word.isalpha():
            return self.direct(word)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return self.later[word[:-1]] + self.pieces[word[-1]]
        return b"".join([self.pieces[p] for p in WORD_LEVEL.findall(word)])

    def safe(self, text: str) -> bool:
        if any(x in text for x in self.added):
            return False
        if not self.keeps_space:
            return True
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or ODD_SPACE.search(text):
            return not LONG_GAP.search(text)
        return True

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        out = []
        first, later = self.first, self.later.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.safe(text):
                out.append(self.direct(text))
            elif self.keeps_space:
                head, *rest = text.split(" ")
                out.append(first[head] + b"".join(map(later, rest)))
            else:
                out.append(b"".join(map(later, text.split(" "))))
        return out
