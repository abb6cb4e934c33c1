"""Phrases whose words stand together more often than chance would have it, by counting n-grams of ids in fixed-width keys.

Level by level: words that are frequent enough get ids, everywhere else a piece breaks, and a text becomes a sequence of
ids. Two frequent n-grams that overlap in all but their ends make the n-gram one word longer, so its key is always two ids
of 32 bits, whatever its length; a phrase can't be frequent unless both are. Every task packs the keys of its sequences,
sorts and counts them; the counts are dealt by ranges of keys, sorted by Spark's radix sort on the key, and run-length
summed as they stream by. The frequent ones get ids in turn, and the sequences are written anew with these. So only words
and pairs are counted in full; from three words on little is left.

A dictionary is sent to the tasks if it takes at most `ship_bytes`; a larger one meets the positions in a shuffled join,
with the keys that hold more than a thousandth of all positions broadcast (a thousand at most). Both ways give the same
sequences.

Rows: a null text is empty, a null lang is `und`; words are runs of bytes, whatever the text, and compared as bytes; a
text is read in one piece of its own size. Repeated rows count again. An empty table gives no phrases. Other columns take
no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import LOWER, slices
from .workspace import Workspace, arrow_limits, join_by_key, tidy

SLICE_BYTES = 4 << 20
PACKED = 2 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", *range(10, 14)]] = True
GAP = SEPARATOR.copy()
GAP[[32, 9]] = True


@dataclass(frozen=True)
class PhrasePlan:
    """Least occurrences of a phrase, its most words, the phrases reported for each language, and the largest dictionary that is sent to tasks."""

    least: int = 100
    longest: int = 5
    top: int = 2000
    ship_bytes: int = 64 << 20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts that `offsets` cut from `data`, the text of each, and whether it begins a piece."""
    low = LOWER[data]
    word = ~GAP[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    start = word & edge[:-1]
    start[1:] |= word[1:] & ~word[:-1]
    first = np.flatnonzero(start)
    # words in a row are parted by an edge or a gap, so their bytes one after another need only their lengths
    owner = np.cumsum(start)[word] - 1
    bounds = np.zeros(len(first) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(first)), out=bounds[1:])
    body = np.ascontiguousarray(low[word])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    breaks = np.cumsum(SEPARATOR[low])[first]
    text = np.searchsorted(offsets, first, "right") - 1
    fresh = np.ones(len(first), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
    return words, text, fresh


def _coded(batch: pa.RecordBatch) -> Iterator[tuple[list[str], pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts as languages, distinct words, and for each word its language, its number among the distinct ones, and whether it begins a piece."""
    langs = batch.column("lang").dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False)
    for row, stop, data, offsets in slices(batch.column("text"), SLICE_BYTES):
        words, text, fresh = _words(data, offsets)
        if len(words):
            table = words.dictionary_encode()
            yield langs.dictionary.to_pylist(), table.dictionary, code[row:stop][text], table.indices.to_numpy(zero_copy_only=False).astype(np.int64), fresh


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the length of each one's run."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word (bytes), f; and for each language a row without a word that counts all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, distinct, code, index, _ in _coded(batch):
                pairs, n = _runs(code * len(distinct) + index)
                own = pa.array(pairs // len(distinct))
                totals = np.bincount(code, minlength=len(names))
                used = np.flatnonzero(totals)
                lang = pa.concat_arrays([pa.array(names, pa.string()).take(own), pa.array([names[k] for k in used], pa.string())])
                word = pa.concat_arrays([distinct.take(pa.array(pairs % len(distinct))).cast(pa.binary()), pa.nulls(len(used), pa.binary())])
                yield pa.RecordBatch.from_arrays([lang, word, pa.array(np.concatenate((n, totals[used])))], names=["lang", "word", "n"])

    return texts.mapInArrow(tidy(run), "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _numbered(work: Workspace, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`rows` written with ids from 0 on, in the order of their partitions, and how many there are."""
    held = work.table(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    sizes = held.groupBy("part").agg(F.count("*").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    total = (sizes.agg(F.max("total")).first() or [0])[0] or 0
    if total >= 1 << 32:
        raise OverflowError(f"{total} frequent n-grams: ids of 32 bits hold 2**32; ask for more occurrences than {name}")
    # a row for each partition that wrote any
    return held.join(F.broadcast(sizes.drop("total")), "part").withColumn("id", F.col("at") + F.col("before")).drop("part", "at", "before"), total


# A sequence is uint32 ids counted from 1, with one 0 wherever it breaks; a row's sequence stands by itself.


def _closed(seq: np.ndarray) -> np.ndarray:
    """A sequence without what can't begin a longer n-gram: ids with a break on both sides, and breaks after breaks."""
    held = np.concatenate(([0], seq, [0])) > 0
    seq = np.where(held[1:-1] & (held[:-2] | held[2:]), seq, 0).astype(np.uint32)
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] > 0) | (seq[:-1] > 0)
    return seq[keep]


def _spaced(ids: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Ids (0 where there is none) with a break before each one that begins a piece."""
    at = np.arange(len(ids)) + np.cumsum(fresh)
    out = np.zeros(len(ids) + int(fresh.sum()), np.uint32)
    out[at] = ids
    return out


def _batches(rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["seq"])


def _sequences(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for data in batch.column("seq"):
        yield np.frombuffer(data.as_buffer(), np.uint32)


def _regrouped(positions: DataFrame) -> DataFrame:
    """Sequences from rows of (slice, pos, id): positions that are not there are breaks. A slice stays one sequence, or the n-grams across a cut would be lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            own, pos, ids = (batch.column(c).to_numpy() for c in ("slice", "pos", "id"))
            edges = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)])) if len(own) else np.zeros(0, np.int64)
            done = []
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if held and own[start] != now:
                    done.append(joined(held))
                    held = []
                now = own[start]
                held.append((pos[start:stop], ids[start:stop]))
            if done:
                yield _batches(done)
        if held:
            yield _batches([joined(held)])

    def joined(held: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
        pos, ids = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        fresh = np.concatenate(([True], pos[1:] != pos[:-1] + 1))
        return _closed(_spaced((ids + 1).astype(np.uint32), fresh)).tobytes()

    ordered = positions.repartition("slice").sortWithinPartitions("slice", "pos")
    return ordered.mapInArrow(tidy(run), "seq binary")


def _encoded_words(texts: DataFrame, words: DataFrame, total: int, plan: PhrasePlan) -> DataFrame:
    """The texts as sequences of the ids of frequent words."""
    spark = texts.sparkSession
    size = words.agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 16)).first()[0] or 0
    if size <= plan.ship_bytes:
        table = words.select("lang", "word", "id").toArrow()
        lookup = {}
        for lang in pc.unique(table["lang"]).to_pylist():
            own = table.filter(pc.equal(table["lang"], lang))
            lookup[lang] = own["word"].combine_chunks().cast(pa.large_binary()), (own["id"].to_numpy() + 1).astype(np.uint32)
        sent = spark.sparkContext.broadcast(lookup)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for names, distinct, code, index, fresh in _coded(batch):
                    pairs, back = np.unique(code * len(distinct) + index, return_inverse=True)
                    ids, edges = np.zeros(len(pairs), np.uint32), np.searchsorted(pairs, np.arange(len(names) + 1) * len(distinct))
                    for k in np.flatnonzero(np.diff(edges)):
                        known, numbers = sent.value.get(names[k], (None, None))
                        if known is not None:
                            found = pc.index_in(distinct.take(pa.array(pairs[edges[k] : edges[k + 1]] % len(distinct))), value_set=known)
                            ids[edges[k] : edges[k + 1]] = np.where(np.asarray(found.is_valid()), numbers[found.fill_null(0).to_numpy(zero_copy_only=False)], 0)
                    rows.append(_closed(_spaced(ids[back], fresh)).tobytes())
                yield _batches(rows)

        return texts.mapInArrow(tidy(run), "seq binary")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for names, distinct, code, index, fresh in _coded(batch):
                pos = np.arange(len(index)) + np.cumsum(fresh)
                lang = pa.array(names, pa.string()).take(pa.array(code))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), number)), pa.array(pos), lang, distinct.take(pa.array(index)).cast(pa.binary())], names=["slice", "pos", "lang", "word"])
                number += 1

    rows = texts.mapInArrow(tidy(places), "slice bigint, pos bigint, lang string, word binary")
    return _regrouped(join_by_key(rows, words.select("lang", "word", "id", "f"), ["lang", "word"], size="f").select("slice", "pos", "id"))


def _packed(seq: np.ndarray) -> np.ndarray:
    """The key of each place where two ids stand side by side, and 0 where they don't."""
    a, b = seq[:-1], seq[1:]
    return np.where((a > 0) & (b > 0), a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), np.uint64(0))


def _binary(keys: np.ndarray) -> pa.Array:
    """Keys as eight bytes each, highest first, so bytes sort as numbers do."""
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, 8 * len(keys) + 1, 8, dtype=np.int32)), pa.py_buffer(keys.astype(">u8"))])


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64)


def pair_counts(work: Workspace, sequences: DataFrame, name: str, plan: PhrasePlan) -> DataFrame:
    """The pairs of neighbouring ids that occur often enough: key and f, in the order of the keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for seq in _sequences(batch):
                keys = _packed(seq) if len(seq) > 1 else np.zeros(0, np.uint64)
                held.append(keys[keys > 0])
                size += len(held[-1])
                if size >= PACKED:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = _runs(np.concatenate(held))
        return pa.RecordBatch.from_arrays([_binary(keys), pa.array(n)], names=["key", "n"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, 0
        for batch in batches:
            keys, n = _numbers(batch.column("key")), batch.column("n").to_numpy()
            if not len(keys):
                continue
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            runs, sums = keys[at], np.add.reduceat(n, at)
            if last is not None and runs[0] == last:
                sums[0] += open_
            elif last is not None:
                runs, sums = np.insert(runs, 0, last), np.insert(sums, 0, open_)
            # the last run may go on in the next batch
            last, open_ = runs[-1], sums[-1]
            often = np.flatnonzero(sums[:-1] >= plan.least)
            yield pa.RecordBatch.from_arrays([_binary(runs[often]), pa.array(sums[often])], names=["key", "f"])
        if last is not None and open_ >= plan.least:
            yield pa.RecordBatch.from_arrays([_binary(np.array([last])), pa.array([open_])], names=["key", "f"])

    # written, since a range exchange first reads its rows for a sample of the keys
    partial = work.table(sequences.mapInArrow(tidy(pack), "key binary, n bigint"), f"{name}-partial")
    ranged = partial.repartitionByRange("key").sortWithinPartitions("key")
    return ranged.mapInArrow(tidy(lengths), "key binary, f bigint")


def _encoded_pairs(work: Workspace, sequences: DataFrame, pairs: DataFrame, total: int, name: str, plan: PhrasePlan) -> DataFrame:
    """The sequences in the ids of `pairs`, each standing where its first id stood."""
    if 16 * total <= plan.ship_bytes:
        table = pairs.select("key", "id").toArrow()
        known, ids = np.array([], np.uint64), np.array([], np.uint32)
        if len(table):
            known, ids = _numbers(table["key"].combine_chunks()), (table["id"].to_numpy() + 1).astype(np.uint32)
            order = np.argsort(known)
            known, ids = known[order], ids[order]
        sent = sequences.sparkSession.sparkContext.broadcast((known, ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, ids = sent.value
            for batch in batches:
                rows = []
                for seq in _sequences(batch):
                    if len(seq) > 1 and len(known):
                        keys = _packed(seq)
                        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                        rows.append(_closed(np.where(known[at] == keys, ids[at], 0).astype(np.uint32)).tobytes())
                yield _batches(rows)

        return sequences.mapInArrow(tidy(run), "seq binary")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for seq in _sequences(batch):
                keys = _packed(seq) if len(seq) > 1 else np.zeros(0, np.uint64)
                at = np.flatnonzero(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(at), _binary(keys[at])], names=["slice", "pos", "key"])
                number += 1

    rows = sequences.mapInArrow(tidy(places), "slice bigint, pos bigint, key binary")
    return _regrouped(join_by_key(rows, pairs.select("key", "id", "f"), ["key"], size="f").select("slice", "pos", "id"))


def _half(key: Column, upper: bool) -> Column:
    """The place in the dictionary of a key's first or second id."""
    return F.conv(F.hex(F.substring(key, 1 if upper else 5, 4)), 16, 10).cast("bigint") - 1


def phrases(texts: DataFrame, plan: PhrasePlan = PhrasePlan()) -> DataFrame:
    """All frequent phrases of two words and more: lang, phrase, words, a (occurrences), l, r, n, score (of the lowest-scoring cut), held.

    `held` marks a phrase that a longer frequent one always contains; as frequencies only fall with length, the phrases of
    one word more tell. `texts` has lang and text.
    """
    spark = texts.sparkSession
    arrow_limits(spark)
    work = Workspace(spark, "phrases")
    texts = texts.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = work.table(word_counts(texts).where(F.col("word").isNull() | (F.col("f") >= plan.least)), "words")
    totals = counts.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    words, total = _numbered(work, counts.where(F.col("word").isNotNull()), "level-1")
    sequences = work.table(_encoded_words(texts, words, total, plan), "sequences-1")
    word = F.col("word").cast("string")
    below = words.select("id", "lang", word.alias("phrase"), word.alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    out = None
    for size in range(2, plan.longest + 1):
        pairs, total = _numbered(work, pair_counts(work, sequences, f"level-{size}", plan), f"level-{size}")
        if size < plan.longest:
            sequences = work.table(_encoded_pairs(work, sequences, pairs, total, f"level-{size}", plan), f"sequences-{size}")
        left = below.select(F.col("id").alias("left"), "lang", "phrase", "heads")
        right = below.select(F.col("id").alias("right"), F.col("last"), "tails")
        made = pairs.select("id", "f", _half(F.col("key"), True).alias("left"), _half(F.col("key"), False).alias("right")).join(left, "left").join(right, "right")
        made = work.table(made.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"), "left", "right", F.col("f").alias("a")), f"phrases-{size}")
        if out is not None:
            longer = made.select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            held = below.join(longer, "id", "left").select("lang", "phrase", F.lit(size - 1).alias("words"), "a", "heads", "tails", (F.coalesce("longer", F.lit(0)) >= F.col("a")).alias("held"))
            out = held if size == 3 else out.unionByName(held)
        else:
            out = made  # replaced at three words
        below = made
    last = below.select("lang", "phrase", F.lit(plan.longest).alias("words"), "a", "heads", "tails", F.lit(False).alias("held"))
    out = last if plan.longest == 2 else out.unionByName(last)
    exact = lambda c: c.cast("decimal(19,0)")  # noqa: E731 - products of two pass 64 bits
    scored = out.join(totals, "lang").select(
        "lang", "phrase", "words", "a", "n", "held",
        F.array_min(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(_div(F.lit(1000).cast("decimal(4,0)") * (exact(F.col("a")) * exact(F.col("n"))), exact(F.get("heads", k - 1)) * exact(F.get("tails", F.col("words") - k - 1))).alias("score"), k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.col("words") - k - 1).alias("r")))).alias("cut"),
    )
    return scored.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score", "held")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def collocations(texts: DataFrame, plan: PhrasePlan = PhrasePlan()) -> DataFrame:
    """The best phrases of each language that no longer one always contains, with their ranks."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = phrases(texts, plan).where(~F.col("held")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= plan.top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _gram(n: int) -> str:
    return f"SELECT lang, list_slice(w, i, i + {n - 1}) AS p, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n}) GROUP BY ALL HAVING count(*) >= {PhrasePlan.least}"


ORACLE = f"""
WITH pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
g AS ({' UNION ALL '.join(_gram(n) for n in range(1, PhrasePlan.longest + 1))}),
inside AS (SELECT DISTINCT lang, p, a AS f FROM (SELECT lang, a, unnest(list_transform(range(1, len(p) - k + 2), lambda i: list_slice(p, i, i + k - 1))) AS p FROM g, range(2, {PhrasePlan.longest}) x(k) WHERE len(p) > k)),
c AS (SELECT lang, p, a FROM g WHERE len(p) > 1 AND NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = g.lang AND inside.p = g.p AND 100 * f >= 100 * g.a)),
cuts AS (SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, n, CAST(1000 * CAST(c.a AS HUGEINT) * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score FROM c JOIN n USING (lang), range(1, {PhrasePlan.longest}) z(k), g x, g y
  WHERE k < len(c.p) AND x.lang = c.lang AND x.p = list_slice(c.p, 1, k) AND y.lang = c.lang AND y.p = list_slice(c.p, k + 1, len(c.p))),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM best) WHERE rank <= {PhrasePlan.top}"""
