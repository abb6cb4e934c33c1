"""Token ids of whole texts, by a `tokenizers` file that parts texts at white space.

Each blank-separated chunk is encoded once per worker and remembered by its 64-bit hash; ids of a text are then gathered
by numpy. The ids equal those of encoding the text in one piece, since no token or normalisation of these tokenizers
crosses white space; a tokenizer of another kind is refused. Chunks of over 96 bytes have a cryptographic hash.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .textops import LOWER, find_words, slices

#: Chunks that a worker remembers; at the limit it starts anew.
REMEMBERED = 900_000
_encoders: dict[str, "ChunkEncoder"] = {}

_LETTER, _MARK = np.zeros((2, 256), bool)
_LETTER[np.r_[65:91, 97:123]] = True
_MARK[np.r_[33:48, 58:65, 91:97, 123:127]] = True


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with fewer different chunks: ASCII letters lowered, a blank put between an ASCII letter and the ASCII mark after it.

    Neither changes an id: these tokenizers lower letters, and part letters from marks, themselves. Texts with combining
    marks (which might compose with a letter) or with a special token's `<|` stay as they are, and their neighbours too.
    """
    raw = data.tobytes()
    if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw:
        return data, offsets
    at = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    return np.insert(LOWER[data], at, 32), offsets + np.searchsorted(at, offsets, "right")


class ChunkEncoder:
    """Chunks are known by their 64-bit hashes, in a table of open addressing that numpy searches for all chunks at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        apart = ("Some words, some9 more", "A.b", "it's (so) said", "x\ty\nz")
        if any(ids(text) != [i for word in text.split() for i in ids(word)] for text in apart):
            raise ValueError(f"{path}: the tokens of this tokenizer cross white space")
        #: Whether letters may be lowered and marks set apart without changing an id.
        self.parts = all(ids(text) == ids(other) for text, other in (("ABC Def", "abc def"), ("a.b", "a .b"), ("it's (so)!", "it 's (so )!"), ("Word,", "word ,")))
        self._reset()

    def _reset(self) -> None:
        size = 1 << (2 * REMEMBERED - 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.hashes, self.entries, self.count = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0
        self.store, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        left, place = np.arange(len(h)), h & self.mask
        while len(left):
            there = self.hashes[place]
            hit = there == h[left]
            out[left[hit]] = self.entries[place[hit]]
            on = ~hit & (there != 0)
            left, place = left[on], (place[on] + np.uint64(1)) & self.mask
        return out

    def _put(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Different new hashes into free places; of several that want one place, one gets it and the others go on."""
        place = h & self.mask
        while len(h):
            free = self.hashes[place] == 0
            self.hashes[place[free]] = h[free]
            won = free & (self.hashes[place] == h)
            self.entries[place[won]] = entries[won]
            h, entries, place = h[~won], entries[~won], (place[~won] + np.uint64(1)) & self.mask

    def _learn(self, chunks: list[str], h: np.ndarray) -> None:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        ids = [e.ids for e in found]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        base, total = self.count, int(sizes.sum())
        while self.filled + total > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while base + len(chunks) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.store[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.starts[base : base + len(chunks)] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[base : base + len(chunks)] = sizes
        self.filled += total
        self.count += len(chunks)
        self._put(h, np.arange(base, self.count, dtype=np.int32))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and each text's bounds; `end` is put after each text."""
        if self.parts:
            data, offsets = parted(data, offsets)
        words = find_words(data, offsets, lower=False)
        h = np.maximum(words.hash, np.uint64(1))
        at = self._find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if self.count + len(missing) > REMEMBERED:
                self._reset()
                missing = np.arange(len(h))
            new, first = np.unique(h[missing], return_index=True)
            raw, where = data.tobytes(), missing[first]
            self._learn([raw[a:b].decode() for a, b in zip(words.start[where].tolist(), words.stop[where].tolist(), strict=True)], new)
            at = self._find(h)
        sizes = self.sizes[at].astype(np.int64)
        stops = np.cumsum(sizes)
        ids = self.store[np.repeat(self.starts[at] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        bounds = np.concatenate([[0], stops])[words.bounds]
        if end is not None:
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file; its memory lasts over tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str, end: int | None = None):
    """For runs of rows: first row, ids of all of them, bounds of each. Nulls are empty texts."""
    own = encoder(path)
    for row, stop, data, offsets in slices(column):
        yield row, *own.encode(data, offsets, end)
