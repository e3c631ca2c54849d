"""Tokenizer files, read once on the driver and shipped with the tasks, and
cached encoding of whole Arrow columns inside tasks.

Both JSON tokenizers used here never join text across a single space between
two other characters, so such spaces cut a text into pieces that can be encoded
on their own. Pieces are found and told apart by numpy (64-bit fingerprints);
only a piece seen for the first time becomes a Python string. Those are cut into
the tokenizer's pre-tokens, and the library's model is asked once for each new
pre-token. Pieces with characters outside a plain Latin range go to the library
whole. The caches are bounded and belong to the Python worker, so tasks that
follow each other in a worker share them.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textcore import SEPARATOR, buffers, row_slices, word_bounds, word_hashes

CACHE_PIECES = 1_000_000
CACHE_WORDS = 600_000
_NUL = "\x00"

#: The tokenizers' own pre-token patterns (fixed values of the two files).
PATTERNS = {
    True: r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    False: r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""",
}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: itself where it is visible, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker does."""
    name = "_varpack_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].store = {}
    return sys.modules[name].store


def piece_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the pieces of some rows, and a row pointer: every row is
    cut before each space that stands between two characters which are surely
    not white space (ASCII, or U+00C0 to U+024F)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    d = data[lo:hi]
    cut = np.zeros(hi - lo, bool)
    if hi - lo > 2:
        ascii_ = (d < 0x80) & ~SEPARATOR[d]
        latin = (d >= 0xC3) & (d <= 0xC9)              # leads of U+00C0 to U+024F
        before = ascii_.copy()
        before[1:] |= latin[:-1]
        cut[1:-1] = (d[1:-1] == 0x20) & before[:-2] & (ascii_ | latin)[2:]
    edge = offsets - lo
    last = edge[1:-1] - 1                              # a space that ends a row has no character after it
    cut[last[last >= 0]] = False
    begin = edge[:-1][np.diff(edge) > 0]               # rows begin a piece, also where they begin with a space
    cut[begin] = True
    start = np.flatnonzero(cut) + lo
    return start, np.r_[start[1:], hi][: len(start)], np.searchsorted(start, offsets)


def nul_joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """Slices of a UTF-8 buffer with a NUL between them."""
    if not len(start):
        return ""
    size = end - start
    at = np.arange(int(size.sum()))
    joined = np.zeros(len(at) + len(size), np.uint8)
    joined[at + np.repeat(np.arange(len(size)), size)] = data[np.repeat(start - (np.cumsum(size) - size), size) + at]
    return joined[:-1].tobytes().decode("utf-8", "replace")


class Lists:
    """Growing list of id lists in flat arrays."""

    def __init__(self):
        self.flat, self.size, self.begin, self.n, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.size):
            self.size, self.begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.begin))
        self.flat[self.used: self.used + len(ids)] = ids
        self.size[self.n: self.n + len(sizes)] = sizes
        self.begin[self.n: self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = self.n + len(sizes), self.used + len(ids)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the lists one after another, running ends)."""
        many = self.size[slots]
        stop = np.cumsum(many)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.repeat(self.begin[slots] - (stop - many), many) + np.arange(total)], stop


class PieceEncoder:
    """Encodes text columns with a ``tokenizers`` JSON file. ``spaced``: a piece
    keeps the space before it (byte-level vocabularies); else the tokenizer
    drops white space and lower-cases."""

    #: a character outside the range whose classes no Unicode version disputes; NUL separates pieces
    ODD = re.compile(r"[^\x00\t\n\r\x20-\x7e\u00c0-\u024f]")

    def __init__(self, definition: str, spaced: bool, pieces: int = CACHE_PIECES, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        store = worker_store()
        key = (hash(definition), len(definition), spaced)
        if key not in store:
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_str(definition)
            tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
            store[key] = {"tokenizer": tokenizer}
        self.store, self.tokenizer, self.spaced = store[key], store[key]["tokenizer"], spaced
        self.most_pieces, self.most_words = pieces, words
        if "pieces" not in self.store:
            self._forget()
        # NUL stands between pieces, so it must be a match of its own
        self.find = regex.compile(_NUL + "|" + PATTERNS[spaced].replace(r"[^\s", r"[^\x00\s")).findall
        self.alphabet = byte_alphabet()
        self.visible = str.maketrans({b: c for b, c in enumerate(self.alphabet) if b < 128 and c != chr(b)})

    def _forget(self) -> None:
        self.store.update(pieces=Lists(), keys=np.zeros(0, np.uint64), place=np.zeros(0, np.int64), words=Lists(), word={})
        self._separator()

    def _separator(self) -> None:
        self.store["words"].extend(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self.store["word"][_NUL] = 0

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids of the rows, row pointer into them)."""
        offsets, data = buffers(column)
        for a, b in row_slices(offsets, 4 << 20):
            part = offsets[a: b + 1]
            start, end, ptr = piece_bounds(part, data) if self.spaced else word_bounds(part, data)
            known, first, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
            slots = self._slots(known, data, start[first], end[first])
            ids, stop = self.store["pieces"].gather(slots[back])
            yield a, b, ids, np.r_[0, stop][ptr]

    def _slots(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of sorted piece fingerprints in the cache, new ones encoded first."""
        if len(self.store["keys"]) + len(keys) > self.most_pieces:
            self._forget()
        known, place = self.store["keys"], self.store["place"]
        at = np.searchsorted(known, keys)
        old = known[np.minimum(at, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)
        slots = np.empty(len(keys), np.int64)
        slots[old] = place[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            slots[new] = self._add(data, start[new], end[new])
            merged = np.concatenate([known, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.store["keys"], self.store["place"] = merged[order], np.concatenate([place, slots[new]])[order]
        return slots

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encode new pieces; their slots."""
        pieces, n = self.store["pieces"], len(start)
        text = nul_joined(data, start, end)
        slots = pieces.n + np.arange(n)
        if text.count(_NUL) == n - 1 and not self.ODD.search(text):
            pieces.extend(*self._plain(text))
            return slots
        texts = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(start.tolist(), end.tolist())]
        odd = np.array([bool(self.ODD.search(t)) or _NUL in t for t in texts])
        plain = np.flatnonzero(~odd)
        if len(plain):
            slots[plain] = pieces.n + np.arange(len(plain))
            pieces.extend(*self._plain(_NUL.join([texts[i] for i in plain])))
        for i in np.flatnonzero(odd):
            ids = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
            slots[i] = pieces.n
            pieces.extend(np.array(ids, np.uint32), np.array([len(ids)]))
        return slots

    def _plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of NUL-separated pieces of plain characters, by pre-tokens."""
        if not self.spaced:
            joined = joined.lower() if joined.isascii() else self.tokenizer.normalizer.normalize_str(joined)
        found = self.find(joined)
        if len(self.store["word"]) > self.most_words:
            self.store.update(words=Lists(), word={})
            self._separator()
        words, word = self.store["words"], self.store["word"]
        new = [w for w in dict.fromkeys(found) if w not in word]
        model, alphabet = self.tokenizer.model.tokenize, self.alphabet
        got = [[t.id for t in model(w.translate(self.visible) if w.isascii() else "".join([alphabet[b] for b in w.encode()]))] for w in new]
        word.update(zip(new, range(words.n, words.n + len(new))))
        sizes = np.array([len(x) for x in got], np.int64)
        words.extend(np.array([i for x in got for i in x], np.uint32), sizes)
        slots = np.fromiter(map(word.__getitem__, found), np.int64, len(found))
        flat, stop = words.gather(slots)
        ends = np.r_[0, stop][np.r_[np.flatnonzero(slots == 0), len(slots)]]   # ids up to each separator
        return flat, np.diff(np.r_[0, ends])
