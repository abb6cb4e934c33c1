"""Vector bin packing of token sequences by the dot-product heuristic.

A bin has limits on tokens, segments and loss-bearing tokens. It is filled with the waiting piece whose demand has the
largest dot product with what is left of the bin, among those that fit, until none fits. A text longer than a bin is
cut into full bins and a rest; where more than `cut_from` tokens of a bin stay free, the longest waiting piece is cut.

Every partition packs its own rows with a bounded pool of waiting pieces, without a shuffle; each leaves at most a few
bins unfilled. A null text is an empty one and is the end token alone; null ids are carried along; repeated rows are
packed each for itself; other columns play no part, whatever their names; no table rows, no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoded, encoder
from .workspace import arrow_limits, tidy

TOKENIZER, END = "word_bpe_49k.json", 2


@dataclass(frozen=True)
class Limits:
    """Of a sequence. The first token of a piece bears no loss, so `loss` binds where few pieces fill a sequence and `segments` where many do."""

    tokens: int = 4096
    segments: int = 32
    loss: int = 4088
    pool: int = 1024
    cut_from: int = 48


@dataclass
class Packer:
    """Pieces (key, start, tokens, loss-bearing tokens) in, full bins out. `loss` of a cut piece is dealt in proportion."""

    limits: Limits
    keys: list = field(default_factory=list)
    size: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, keys: list, sizes: np.ndarray, losses: np.ndarray) -> Iterator[list[tuple]]:
        """Take whole examples; yields bins, each a list of (key, start, tokens)."""
        most = self.limits.tokens
        starts = np.zeros(len(keys), np.int64)
        for k in np.flatnonzero((sizes > most) | (losses > self.limits.loss)):
            while sizes[k] > most or losses[k] > self.limits.loss:
                take = most if losses[k] * most <= self.limits.loss * sizes[k] else max(1, self.limits.loss * int(sizes[k]) // int(losses[k]))
                losses[k] -= losses[k] * take // sizes[k]
                yield [(keys[k], int(starts[k]), int(take))]
                starts[k] += take
                sizes[k] -= take
        self.keys += keys
        self.size = np.concatenate([self.size, np.stack([sizes, losses], 1)])
        self.start = np.concatenate([self.start, starts])
        while len(self.keys) > self.limits.pool:
            yield self.bin()

    def bin(self) -> list[tuple]:
        """One bin, filled from the pool."""
        m = self.limits
        room = np.array([m.tokens, m.loss], np.int64)
        scale = np.array([1.0 / m.tokens, 1.0 / m.loss])
        demand = self.size * scale
        taken = np.zeros(len(self.keys), bool)
        out = []
        while len(out) < m.segments:
            left = room * scale
            dot = demand @ left + (m.segments - len(out)) / m.segments**2
            dot[taken | (self.size[:, 0] > room[0]) | (self.size[:, 1] > room[1])] = -1.0
            k = int(np.argmax(dot)) if len(dot) else -1
            if k >= 0 and dot[k] >= 0:
                out.append((self.keys[k], int(self.start[k]), int(self.size[k, 0])))
                room -= self.size[k]
                taken[k] = True
                continue
            waiting = np.flatnonzero(~taken)
            if room[0] >= m.cut_from and len(waiting):
                k = waiting[np.argmax(self.size[waiting, 0])]
                size, loss = map(int, self.size[k])
                take = min(int(room[0]), size - 1, int(room[1]) * size // max(loss, 1))
                if take >= 1:
                    out.append((self.keys[k], int(self.start[k]), take))
                    self.start[k] += take
                    self.size[k] -= (take, loss * take // size)
            break
        self.keys = [x for x, gone in zip(self.keys, taken, strict=True) if not gone]
        self.size, self.start = self.size[~taken], self.start[~taken]
        return out

    def rest(self) -> Iterator[list[tuple]]:
        while self.keys:
            yield self.bin()


def pack_documents(documents: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), end: int = END) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each id of a document, the end id included, lies in exactly one piece. The first id of a piece bears no loss.
    """
    arrow_limits(documents.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, waiting, number = Packer(limits), {}, TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        def place(bins: Iterator[list[tuple]]) -> None:
            nonlocal number
            for pieces in bins:
                offset = 0
                for key, start, size in pieces:
                    doc_id, ids = waiting[key]
                    rows.append((doc_id, start, size, ids[start : start + size].tobytes(), len(ids), number, offset))
                    offset += size
                    if start + size == len(ids):
                        del waiting[key]
                number += 1

        key = 0
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for row, ids, bounds in encoded(b.column("text"), path, end):
                sizes = np.diff(bounds)
                keys = list(range(key, key + len(sizes)))
                key += len(sizes)
                for k, x in enumerate(keys):
                    waiting[x] = (doc_ids[row + k], ids[bounds[k] : bounds[k + 1]].copy())
                place(packer.add(keys, sizes.copy(), np.maximum(sizes - 1, 0)))
                if len(rows) >= 512:
                    yield batch()
        place(packer.rest())
        if rows:
            yield batch()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(pack), schema)


def fitting(loss: np.ndarray, limits: Limits) -> Iterator[tuple[int, int, int]]:
    """An example cut as seldom as the limits allow: (start, tokens, loss-bearing tokens). `loss` marks the tokens that bear loss."""
    sums = np.concatenate([[0], np.cumsum(loss)])
    at = 0
    while at < len(loss):
        stop = min(at + limits.tokens, int(np.searchsorted(sums, sums[at] + limits.loss, "right")) - 1, len(loss))
        stop = max(stop, at + 1)
        yield at, stop - at, int(sums[stop] - sums[at])
        at = stop


def pack_conversations(conversations: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(loss=2048), end: int = END, answers: str = "assistant") -> DataFrame:
    """Conversations as examples for instruction tuning: conv_id, start, length, n_loss, ids, sequence_id, offset.

    The turns of a conversation stand in order, each with the end id; those of the role `answers` bear loss. Examples stay
    whole unless one alone is beyond a limit; then it is cut where the limit is met. A null text is an empty turn.
    """
    arrow_limits(conversations.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    whole = replace(limits, cut_from=limits.tokens + 1)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    examples = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    names = ["conv_id", "start", "length", "n_loss", "ids", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, waiting, number, key = Packer(whole), {}, TaskContext.get().partitionId() << 32, 0

        def placed(bins: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for pieces in bins:
                rows, offset = [], 0
                for k, _, size in pieces:
                    conv_id, start, n_loss, ids = waiting.pop(k)
                    rows.append((conv_id, start, size, n_loss, ids.tobytes(), number, offset))
                    offset += size
                types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                number += 1

        for batch in batches:
            for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                texts = [t["text"].encode() for t in turns]
                ids, bounds = encoder(path).encode(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), end)
                loss = np.repeat([t["role"] == answers for t in turns], np.diff(bounds))
                cut = list(fitting(loss, limits))
                keys = list(range(key, key + len(cut)))
                key += len(cut)
                for k, (start, size, n_loss) in zip(keys, cut, strict=True):
                    waiting[k] = (conv_id, start, n_loss, ids[start : start + size].copy())
                yield from placed(packer.add(keys, np.array([c[1] for c in cut], np.int64), np.array([c[2] for c in cut], np.int64)))
        yield from placed(packer.rest())

    return examples.select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInArrow(tidy(pack), "conv_id long, start long, length long, n_loss long, ids binary, sequence_id long, offset long")


def packing_query(documents: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    out = pack_documents(documents)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def conversation_query(conversations: DataFrame) -> DataFrame:
    """The pieces of all conversations: conv_id, start, length, n_loss, ids_crc32, sequence_id, offset."""
    return pack_conversations(conversations).select("conv_id", "start", "length", "n_loss", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
