"""Exact substring dedup by suffix arrays: a byte goes if a 50-byte string over it also starts in a document with a smaller id.

1. Equal texts are grouped; only the text of each group goes on, under the group's smallest doc_id. The other rows of a
   group lose all their bytes (if there are 50).
2. Anchors: the least hash of the 20-byte grams in a 50-byte window depends on the window alone, so equal windows have
   equal anchors. Anchors that occur in two different texts are found by one exchange, sent compressed and once or twice
   for each map window however often they occur. Windows under any other anchor are unique and are done with.
3. The stretches of windows under one shared anchor are dealt by the anchor's hash, so equal windows meet in one place.
   There equal stretches become one; those that may share a window with another (by window hashes) go to shards of
   bounded size, by ascending id. Each shard builds its suffix
   array (Larsson-Sadakane refinement to 50 bytes) and common prefixes (Kasai), whose runs of 50 and more are the
   repeated windows. Shards are merged by binary search of their windows in the sorted windows of the shards before.
4. Removed ranges go back to their documents, which are cut.

Texts are UTF-8 bytes, null texts empty; a null doc_id is larger than any other. Windows of different shards are held
for equal if 64-bit hashes agree. Rows that repeat a doc_id are documents of their own, none of which is smaller than
another, so they lose nothing to each other unless their texts are equal. A text of any length is read whole, in the one
task that holds its row. Other columns take no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffixarray import kasai, suffix_array
from .textops import content_hash, mix, prefix_hash, range_hash, slices
from .workspace import Workspace, arrow_limits, release, tidy

_U = np.uint64
LAST = 2**63 - 1


@dataclass(frozen=True)
class SubstringPlan:
    length: int = 50
    gram: int = 20
    anchors_per_bucket: int = 750_000
    anchors_per_window: int = 1_000_000
    stretch_bytes: int = 8 << 20
    shard_bytes: int = 2 << 20
    hash_bits: int = 48


def stretches(data: np.ndarray, offsets: np.ndarray, plan: SubstringPlan) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one anchor: anchor, text, first window and last window + 1 (bytes in the slice), and the prefix hashes."""
    n, w = len(data), plan.length - plan.gram + 1
    sums = prefix_hash(data)
    windows = n - plan.length + 1
    if windows <= 0:
        return np.zeros(0, _U), *np.zeros((3, 0), np.int64), sums
    grams = np.arange(n - plan.gram + 1)
    least = range_hash(sums, grams, grams + plan.gram)
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: windows], least[w - size : w - size + windows])
    least = least[:windows]
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[:windows]
    whole = np.arange(windows) + plan.length <= offsets[1:][text]
    new = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1]))
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], windows)
    keep = whole[starts]
    return least[starts[keep]], text[starts[keep]], starts[keep], stops[keep], sums


_pack = lambda a: zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def shared_anchors(rows: DataFrame, buckets: int, plan: SubstringPlan) -> DataFrame:
    """(k1, anchors): for every text (told by k1) its anchors that another text has too. `rows` has k1, text."""
    shift = _U(64 - plan.hash_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, held = [], [], 0

        def flush() -> pa.RecordBatch:
            h, t = np.concatenate(hashes), np.concatenate(keys)
            table, own = np.unique(t, return_inverse=True)
            order = np.lexsort((own, h))
            h, own = h[order], own[order].astype(np.uint32)
            once = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])) if len(h) else np.zeros(0, bool)
            h, own = h[once], own[once]
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            sizes = np.diff(np.append(starts, len(h)))
            several = np.repeat(sizes > 1, sizes)
            # one entry for each anchor; one that several texts here share says so by no text
            first, who = h[starts], np.where(sizes > 1, np.uint32(0xFFFFFFFF), own[starts])
            bucket = (first >> _U(32)).astype(np.int64) * buckets >> (plan.hash_bits - 32)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                x, y = edges[b], edges[b + 1]
                if x < y:
                    used, small = np.unique(who[x:y], return_inverse=True)
                    names = np.where(used == 0xFFFFFFFF, np.uint64(0), table[np.minimum(used, len(table) - 1)])
                    rows.append((b, _pack(np.diff(first[x:y], prepend=_U(0))), _pack(small.astype(np.uint32)), _pack(names.astype(_U)), False))
            if several.any():
                b = int(mix(np.array([int(h[several][0])], _U))[0] % _U(buckets))
                rows.append((b, _pack(h[several]), _pack(own[several]), _pack(table), True))
            hashes.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], ["bucket", "hashes", "owners", "texts", "known"])

        for batch in batches:
            k1 = batch.column("k1").to_numpy().view(_U)
            for row, _, data, offsets in slices(batch.column("text")):
                anchor, text, *_ = stretches(data, offsets, plan)
                hashes.append(anchor >> shift)
                keys.append(np.maximum(k1[row + text], _U(1)))
                held += len(anchor)
                if held >= plan.anchors_per_window:
                    held = 0
                    yield flush()
        if held:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        hashes, keys, out_h, out_k = [], [], [], []
        for h, o, t, known in zip(*(group.column(c).to_pylist() for c in ("hashes", "owners", "texts", "known")), strict=True):
            texts, own, h = _unpack(t, _U), _unpack(o, np.uint32), _unpack(h, _U)
            if known:
                out_h.append(h)
                out_k.append(texts[own])
            else:
                hashes.append(np.cumsum(h, dtype=_U))
                keys.append(texts[own])
        if hashes:
            h, k = np.concatenate(hashes), np.concatenate(keys)
            order = np.argsort(h)
            h, k = h[order], k[order]
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            several = (np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts)) | (np.minimum.reduceat(k, starts) == 0)
            mine = np.repeat(several, np.diff(np.append(starts, len(h)))) & (k != 0)
            out_h.append(h[mine])
            out_k.append(k[mine])
        h, k = (np.concatenate(x) if x else np.zeros(0, _U) for x in (out_h, out_k))
        home = (mix(k) % _U(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        h, k, home = h[order], k[order], home[order]
        edges = np.searchsorted(home, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        cut = lambda x: [x[edges[p] : edges[p + 1]].tobytes() for p in full]
        return pa.table({"home": pa.array(full, pa.int32()), "texts": pa.array(cut(k), pa.binary()), "hashes": pa.array(cut(h), pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        k, h = (np.concatenate([np.frombuffer(x, _U) for x in group.column(c).to_pylist()]) for c in ("texts", "hashes"))
        order = np.argsort(k, kind="stable")
        h, k = h[order], k[order]
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(k)), pa.int32()), pa.array(h.view(np.int64)))
        return pa.table({"k1": pa.array(k[starts].view(np.int64)), "anchors": lists})

    sent = rows.mapInArrow(tidy(send), "bucket int, hashes binary, owners binary, texts binary, known boolean")
    met = sent.groupBy("bucket").applyInArrow(meet, "home int, texts binary, hashes binary")
    return met.groupBy("home").applyInArrow(gather, "k1 long, anchors array<long>")


def dealt_stretches(texts: DataFrame, parts: int, plan: SubstringPlan) -> DataFrame:
    """The stretches under shared anchors, dealt by anchor into blobs: (part, blob columns). `texts` has tid, id, text, anchors."""
    shift = _U(64 - plan.hash_bits)
    names = ["part", "bytes", "sizes", "counts", "ids", "tids", "starts"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, ids = batch.column("tid").to_numpy(), batch.column("id").to_numpy()
            column = batch.column("anchors")
            for row, stop, data, offsets in slices(batch.column("text"), 2 << 20):
                anchor, text, first, last, sums = stretches(data, offsets, plan)
                lists = column.slice(row, stop - row)
                owner = np.repeat(np.arange(stop - row), lists.value_lengths().to_numpy(zero_copy_only=False))
                both = lambda t, a: mix(a + mix(t.astype(_U) + _U(1)))
                wanted = both(owner, lists.flatten().to_numpy(zero_copy_only=False).view(_U))
                mine = np.isin(both(text, anchor >> shift), wanted)
                anchor, text, first, last = anchor[mine], text[mine], first[mine], last[mine] + plan.length - 1
                if not len(anchor):
                    continue
                part = (mix(anchor) % _U(parts)).astype(np.int64)
                content = content_hash(data, sums, first, last)
                order = np.lexsort((content, part))
                part, content, text, first, last = part[order], content[order], text[order], first[order], last[order]
                new = np.append(True, (part[1:] != part[:-1]) | (content[1:] != content[:-1]))
                edges = np.searchsorted(part, np.arange(parts + 1))
                rows = []
                for p in np.flatnonzero(np.diff(edges)):
                    x, y = edges[p], edges[p + 1]
                    heads = x + np.flatnonzero(new[x:y])
                    size = last[heads] - first[heads]
                    at = np.repeat(first[heads] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    blob = zstandard.ZstdCompressor(level=1).compress(data[at].tobytes())
                    members = np.diff(np.append(heads, y))
                    rows.append((int(p), blob, size.astype(np.uint32).tobytes(), members.astype(np.uint32).tobytes(), ids[row + text[x:y]].tobytes(), tid[row + text[x:y]].tobytes(), (first[x:y] - offsets[text[x:y]]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 6], strict=True)], names)

    return texts.select("tid", "id", "text", "anchors").mapInArrow(tidy(send), "part int, bytes binary, sizes binary, counts binary, ids binary, tids binary, starts binary")


class WindowTable:
    """Sorted hashes of windows and the smallest id that each was seen under."""

    def __init__(self) -> None:
        self.hash, self.least = np.zeros(0, _U), np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hash, h)
        at = np.minimum(at, max(len(self.hash) - 1, 0))
        return at, (self.hash[at] == h) if len(self.hash) else np.zeros(len(h), bool)

    def merge(self, h: np.ndarray, least: np.ndarray) -> None:
        """Take in different windows: those known keep the smaller id, the others are put in their places."""
        at, known = self.find(h)
        np.minimum.at(self.least, at[known], least[known])
        h, least = h[~known], least[~known]
        order = np.argsort(h)
        places = np.searchsorted(self.hash, h[order])
        self.hash, self.least = np.insert(self.hash, places, h[order]), np.insert(self.least, places, least[order])


def repeated_windows(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, plan: SubstringPlan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One shard: for each window of the stretches, its group among equal ones (by suffix array and common prefixes); hash and least id of each group."""
    order, _ = suffix_array(data, plan.length)
    # long stretches (of periodic text) are followed in pieces, so that none keeps the others waiting
    starts = np.concatenate([np.arange(a, b, 128) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) if np.diff(bounds).max() > 128 else bounds[:-1]
    lcp = kasai(data, order, starts, np.append(starts[1:], len(data)), plan.length)
    sizes = np.diff(bounds)
    stretch = np.repeat(np.arange(len(sizes)), sizes)
    room = bounds[1:][stretch] - np.arange(len(data)) >= plan.length
    # a suffix that is no window lies between windows without parting them: prefixes shared are carried over it
    group = np.cumsum(np.append(True, lcp[1:] < plan.length)) - 1
    windows = room[order]
    found, own = np.unique(group[windows], return_inverse=True)
    at = order[windows]
    least = np.full(len(found), LAST)
    np.minimum.at(least, own, ids[stretch[at]])
    of_position = np.full(len(data), -1)
    of_position[at] = own
    head = np.zeros(len(found), np.int64)
    head[own] = at
    sums = prefix_hash(data)
    return of_position[room], range_hash(sums, head, head + plan.length), least


def removed_windows(group: pa.Table, parts: int, plan: SubstringPlan) -> pa.Table:
    """All stretches of one part: the ranges of windows that also start under a smaller id, dealt by text into blobs."""
    blobs, sizes, counts, ids, tids, starts = [], [], [], [], [], []
    for row in zip(*(group.column(c).to_pylist() for c in ("bytes", "sizes", "counts", "ids", "tids", "starts")), strict=True):
        blobs.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(row[0], max_output_size=1 << 31), np.uint8))
        for out, raw, kind in zip((sizes, counts, ids, tids, starts), row[1:], (np.uint32, np.uint32, np.int64, np.int64, np.int64), strict=True):
            out.append(np.frombuffer(raw, kind))
    data, size, count = np.concatenate(blobs), np.concatenate(sizes).astype(np.int64), np.concatenate(counts).astype(np.int64)
    ids, tids, starts = np.concatenate(ids), np.concatenate(tids), np.concatenate(starts)
    bounds = np.concatenate([[0], np.cumsum(size)])
    # equal stretches from different tasks become one
    content, seen = [], []
    for blob, own in zip(blobs, sizes, strict=True):
        own = own.astype(np.int64)
        sums, stops, room = prefix_hash(blob), np.cumsum(own), own - plan.length + 1
        content.append(content_hash(blob, sums, stops - own, stops))
        at = np.repeat(stops - own - (np.cumsum(room) - room), room) + np.arange(room.sum())
        seen.append(range_hash(sums, at, at + plan.length))
    content, seen = np.concatenate(content), np.concatenate(seen)
    del blobs
    _, head, same = np.unique(content, return_index=True, return_inverse=True)
    member = np.repeat(same, count)
    least = np.full(len(head), LAST)
    np.minimum.at(least, member, ids)
    windows = size[head] - plan.length + 1
    offset = np.concatenate([[0], np.cumsum(windows)])
    before = np.concatenate([[0], np.cumsum(size - plan.length + 1)])
    # a window of one stretch only has the stretch's smallest id; the other stretches go to the suffix arrays
    first = np.repeat(least, windows)
    seen = seen[np.repeat(before[head] - offset[:-1], windows) + np.arange(offset[-1])]
    order = np.argsort(seen)
    owner = np.repeat(np.arange(len(head)), windows)[order]
    new = np.append(True, seen[order[1:]] != seen[order[:-1]])
    runs = np.flatnonzero(new)
    several = np.minimum.reduceat(owner, runs) != np.maximum.reduceat(owner, runs)
    crossed = np.zeros(len(head), bool)
    crossed[owner[np.repeat(several, np.diff(np.append(runs, len(owner))))]] = True
    del seen, order, owner, new, runs, several
    hashes, wanted = np.zeros(offset[-1], _U), np.repeat(crossed, windows)
    table = WindowTable()
    by = np.argsort(least, kind="stable")
    by = by[crossed[by]]
    at = 0
    while at < len(by):
        stop = at + max(1, int(np.searchsorted(np.cumsum(size[head[by[at:]]]), plan.shard_bytes, "right")))
        own = by[at:stop]
        at = stop
        n = size[head[own]]
        take = np.repeat(bounds[head[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        groups, h, low = repeated_windows(data[take], np.concatenate([[0], np.cumsum(n)]), least[own], plan)
        table.merge(h, low)
        w = windows[own]
        hashes[np.repeat(offset[own] - (np.cumsum(w) - w), w) + np.arange(w.sum())] = h[groups]
    if wanted.any():
        first[wanted] = table.least[table.find(hashes[wanted])[0]]
    # members in turn: each window of each, in blocks that bound the memory
    out_t, out_a, out_b = [], [], []
    n = windows[member]
    edges = np.append(0, np.cumsum(n))
    lo = 0
    while lo < len(member):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 4_000_000, "right")) - 1)
        m, k = member[lo:hi], n[lo:hi]
        inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        who = np.repeat(np.arange(lo, hi), k)
        gone = first[np.repeat(offset[m], k) + inner] < ids[who]
        begins = gone & np.append(True, ~gone[:-1] | (who[1:] != who[:-1]))
        ends = gone & np.append(~gone[1:] | (who[1:] != who[:-1]), True)
        out_t.append(tids[who[begins]])
        out_a.append(starts[who[begins]] + inner[begins])
        out_b.append(starts[who[ends]] + inner[ends] + plan.length)
        lo = hi
    t, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_t, out_a, out_b))
    home = (mix(t.view(_U)) % _U(parts)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(edges))
    cut = lambda x: pa.array([_pack(x[order[edges[p] : edges[p + 1]]]) for p in full], pa.binary())
    out = pa.table({"home": pa.array(full, pa.int32()), "tids": cut(t), "starts": cut(a), "stops": cut(b)})
    release()
    return out


def gathered_ranges(group: pa.Table) -> pa.Table:
    """The ranges of each text from all parts: tid, starts, stops."""
    t, a, b = (np.concatenate([_unpack(x, np.int64) for x in group.column(c).to_pylist()]) for c in ("tids", "starts", "stops"))
    order = np.argsort(t, kind="stable")
    t, a, b = t[order], a[order], b[order]
    begin = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    edge = pa.array(np.append(begin, len(t)), pa.int32())
    return pa.table({"tid": pa.array(t[begin]), "starts": pa.ListArray.from_arrays(edge, pa.array(a)), "stops": pa.ListArray.from_arrays(edge, pa.array(b))})


def remove_repeats(documents: DataFrame, plan: SubstringPlan = SubstringPlan()) -> DataFrame:
    """Per row of `documents`: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) and kept_sha256.

    `kept` is null where nothing was removed or nothing is left; n_removed tells which.
    """
    spark = documents.sparkSession
    arrow_limits(spark)
    work = Workspace(spark, "substrings")
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("text", F.lit(1))})
    rows = work.table(keyed.select("doc_id", "id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    density = 2.0 / (plan.length - plan.gram + 2)
    buckets = max(1, int(total * density / plan.anchors_per_bucket) + 1)
    firsts = rows.groupBy("k1", "k2").agg(F.min("id").alias("first"))

    flagged = shared_anchors(keyed.where(F.octet_length("text") >= plan.length).select("k1", "text"), buckets, plan)
    flagged = work.table(flagged, "anchors")
    chosen = firsts.join(flagged, "k1").select("k1", "k2", F.col("first").alias("id"), "anchors")
    texts = keyed.select("k1", "k2", "id", "text").join(chosen, ["k1", "k2", "id"]).dropDuplicates(["k1", "k2"])
    # k1 names a text among those with shared anchors unless two collide; the second hash keeps them apart
    texts = work.table(texts.select(F.xxhash64("k1", "k2").alias("tid"), "k1", "k2", "id", "text", "anchors"), "texts")
    work.drop("anchors")
    repeated = texts.agg(F.sum(F.size("anchors"))).first()[0] or 0
    parts = max(1, int(repeated * (plan.length + 1 / density) / plan.stretch_bytes) + 1)
    parts = max(parts, 2 * spark.sparkContext.defaultParallelism) if repeated > 10000 else parts

    ranges = dealt_stretches(texts, parts, plan).groupBy("part").applyInArrow(lambda t: removed_windows(t, parts, plan), "home int, tids binary, starts binary, stops binary")
    by_text = work.table(ranges.groupBy("home").applyInArrow(gathered_ranges, "tid long, starts array<long>, stops array<long>"), "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept, shas = [], [], [], []
            for text, a, b in zip(batch.column("text"), batch.column("starts"), batch.column("stops"), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, a.values.to_numpy(), 1)
                np.add.at(depth, b.values.to_numpy(), -1)
                gone = np.cumsum(depth)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                kept.append(data[~gone].tobytes())
                shas.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(shas, pa.string())], ["k1", "k2", "removed", "spans", "kept", "kept_sha"])

    cuts = texts.select("tid", "k1", "k2", "text").join(by_text, "tid").select("k1", "k2", "text", "starts", "stops").mapInArrow(tidy(cut), "k1 long, k2 long, removed long, spans long, kept binary, kept_sha string")
    joined = rows.join(firsts, ["k1", "k2"]).join(cuts.withColumn("own", F.lit(True)), ["k1", "k2"], "left")
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= plan.length)
    own = (F.col("id") == F.col("first")) & F.col("own")
    pick = lambda whole, part, none: F.when(copy, whole).when(own, part).otherwise(none)
    return joined.select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.when(own, F.col("kept")).alias("kept"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha"), F.col("sha")).alias("kept_sha256"),
    )


def substring_query(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(documents).drop("kept")
