"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

A document's set holds its distinct five-word shingles (a shorter text: its whole word sequence; no words: nothing). One
hash of a shingle picks its bucket; a bucket's register keeps the smallest second hash as a leading-zero count (6 bits)
and the 10 bits after the leading one, so 159 registers take 318 bytes. An empty bucket borrows the register of the first
filled one in an order of its own, the same for all documents, so registers of small sets agree as often as those of
large ones. Three registers make a band.

1. Documents with equal sets form classes; one representative of each goes on.
2. In every band bucket the members are compared with one hub (a star, not all pairs), the one that shares most bands in
   all; a second round takes the next hub wherever a bucket still holds several components. Candidates whose estimate,
   corrected for accidental register collisions, is far below the threshold go; the others are verified on whole sets.
3. The members of buckets that still hold several components are compared across components, on whole sets and in
   blocks that an exact prefix filter names. So any two documents that share a band are either in one component already
   or compared.

Bands of a small set are not independent, since many buckets borrow from few. Sets of up to `small` shingles and their
possible partners therefore have their least shingles as bands too, of which two sets at the threshold always share one:
they lose no link. Larger sets could lose one only if they shared none of 53 bands. With `exact` step 3 takes in all
representatives, whatever bands they share, and no link at all can be lost; it shuffles every shingle.

Null and blank texts have empty sets, are linked with nothing and are kept. Rows that repeat a doc_id with the same set
are one class. Rows without a doc_id take no part: their component is null and they are kept. In `near_duplicates` rows
that repeat a doc_id with unlike sets are one node of that id; `without_near_duplicates` tells them apart. Other columns
play no part, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .textops import ODD, find_words, mix, shingles, slices
from .workspace import Workspace, arrow_limits, fresh, join_by_key, tidy

_U = np.uint64


@dataclass(frozen=True)
class NearDupPlan:
    percent: int = 75
    bands: int = 53
    rows: int = 3
    mantissa: int = 10
    exact: bool = False
    #: Sets of at most so many shingles can lose no link, whatever their registers.
    small: int = 64
    deviations: float = 5.0
    star_rounds: int = 2
    block: int = 256
    asking: int = 512
    fan_in: int = 512

    @property
    def registers(self) -> int:
        return self.bands * self.rows


#: How often an empty bucket looks elsewhere at random before it takes the next filled one.
LOOKS = 48


def compress(least: np.ndarray, mantissa: int) -> np.ndarray:
    """Leading-zero count and the bits after the leading one of 64-bit minima, in 16 bits."""
    left = least.copy()
    zeros = np.zeros(least.shape, np.uint16)
    for k in (32, 16, 8, 4, 2, 1):
        empty = left < (_U(1) << _U(64 - k))
        zeros += empty.astype(np.uint16) * np.uint16(k)
        left = np.where(empty, left << _U(k), left)
    bits = (left << _U(1)) >> _U(64 - mantissa)
    return (np.minimum(zeros, 63) << np.uint16(mantissa)) | bits.astype(np.uint16)


def sketch(values: np.ndarray, bounds: np.ndarray, plan: NearDupPlan) -> np.ndarray:
    """Registers (texts x registers, 16 bits) of non-empty sets given as shingle hashes and bounds."""
    n, size = len(bounds) - 1, plan.registers
    h = mix(values * ODD[44])
    bucket = ((h >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
    out = np.full(n * size, np.iinfo(np.uint64).max, _U)
    np.minimum.at(out, np.repeat(np.arange(n), np.diff(bounds)) * size + bucket, mix(h * ODD[45]) >> _U(1))
    out = out.reshape(n, size)
    filled = out != np.iinfo(np.uint64).max
    registers = compress(out, plan.mantissa)
    row, place = np.nonzero(~filled)
    for k in range(LOOKS):
        if not len(row):
            break
        other = (mix(place.astype(_U) + np.full(1, 1 + k, _U) * ODD[46]) % _U(size)).astype(np.int64)
        found = filled[row, other]
        registers[row[found], place[found]] = registers[row[found], other[found]]
        row, place = row[~found], place[~found]
    if len(row):
        # the next filled bucket, counting on from the last to the first
        at = np.where(filled, np.arange(size), 2 * size)
        after = np.minimum.accumulate(np.concatenate([at, at + size], 1)[:, ::-1], 1)[:, ::-1][:, :size] % size
        registers[row, place] = registers[row, after[row, place]]
    return registers


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray, plan: NearDupPlan) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less the collisions expected of unlike minima.

    Two independent minima of sets of n and m elements fall into one cell of a mantissa with probability
    E[cell width] n m / (n + m)**2, the mean cell width being 1 / (2 ln 2) of the value over 2**mantissa.
    """
    n, m = n.astype(float), m.astype(float)
    chance = 0.7213 / 2**plan.mantissa * n * m / (n + m) ** 2
    return (equal / plan.registers - chance) / (1.0 - chance)


def least_estimate(n: np.ndarray, m: np.ndarray, plan: NearDupPlan) -> np.ndarray:
    """Below it a pair at the threshold would be so many standard deviations off that it is not verified. Only filled buckets tell something."""
    p = plan.percent / 100
    told = plan.registers * -np.expm1(-np.minimum(n, m) / plan.registers)
    return p - plan.deviations * np.sqrt(p * (1 - p) * (1 / plan.registers + 1 / told))


def prefixes(values: np.ndarray, bounds: np.ndarray, plan: NearDupPlan) -> tuple[np.ndarray, np.ndarray]:
    """The least shingles of each small set, and bounds: of n, the first n - ceil(n percent) + 1 in the order of the hashes.

    Of two sets at the threshold either one's are met by the other's, so they are as good as bands that never miss. A set
    of up to `small` shingles has partners somewhat above that, which give theirs too.
    """
    n = np.diff(bounds)
    take = np.where(n <= plan.small * 100 // plan.percent, n - -(-n * plan.percent // 100) + 1, 0) * (n > 0)
    place = np.arange(len(values)) - np.repeat(bounds[:-1], n)
    return values[place < np.repeat(take, n)], np.append(0, np.cumsum(take))


def sketches(documents: DataFrame, plan: NearDupPlan) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2), the bands (each of up to four registers in a long), and the prefix of a small set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, registers, least, sizes = [], [], [], [], []
            for _, _, data, offsets in slices(batch.column("text")):
                values, bounds = shingles(find_words(data, offsets))
                n = np.diff(bounds)
                full = np.flatnonzero(n > 0)
                own = np.zeros((len(n), 2), _U)
                regs = np.zeros((len(n), plan.bands, 4), np.uint16)
                if len(full):
                    starts = bounds[:-1][full]
                    for k in (0, 1):
                        own[full, k] = mix(np.add.reduceat(mix(values * ODD[40 + k]), starts) + n[full].astype(_U))
                    regs[full, :, : plan.rows] = sketch(values, np.append(starts, len(values)), plan).reshape(-1, plan.bands, plan.rows)
                first, ends = prefixes(values, bounds, plan)
                least.append(first)
                sizes.append(np.diff(ends))
                counts.append(n)
                digests.append(own)
                registers.append(regs.reshape(len(n), -1).view(np.int64))
            n, own, bands = np.concatenate(counts), np.concatenate(digests).view(np.int64), np.concatenate(registers)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * plan.bands, pa.int32()), pa.array(bands.ravel()))
            ends = np.append(0, np.cumsum(np.concatenate(sizes)))
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(least).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy()), lists, prefix], ["doc_id", "n", "d1", "d2", "bands", "prefix"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n long, d1 long, d2 long, bands array<long>, prefix array<long>")


def _registers(column: pa.Array, plan: NearDupPlan) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint16).reshape(-1, plan.bands, 4)[:, :, : plan.rows].reshape(-1, plan.registers)


def promising(pairs: DataFrame, classes: DataFrame, plan: NearDupPlan) -> DataFrame:
    """The pairs (a, b) whose corrected estimate leaves a chance of reaching the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                equal = (_registers(b.column("sa"), plan) == _registers(b.column("sb"), plan)).sum(axis=1)
                na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
                keep = estimate(equal, na, nb, plan) >= least_estimate(na, nb, plan)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    own = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bands").alias(f"s{x}"))
    sized = pairs.join(own("a").select("a", "na", "sa"), "a").join(own("b").select("b", "nb", "sb"), "b")
    sized = sized.where(100 * F.least("na", "nb") >= plan.percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


#: So many ids at most are sent to all tasks, for texts to be picked before they are shuffled.
SENT_IDS = 4_000_000


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents that `ids` (doc_id, distinct, from written tables) names; of all documents if the ids are too many to be sent."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids.count() > SENT_IDS:
        return texts
    return texts.join(F.broadcast(ids), "doc_id", "left_semi")


def verified(pairs: DataFrame, documents: DataFrame, plan: NearDupPlan) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. Texts come to the pairs by two joins; a busy b is salted."""
    busy = pairs.groupBy("b").agg(F.ceil(F.count("*") / plan.fan_in).cast("int").alias("salts"))
    salted = pairs.join(busy, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    texts = texts_of(documents, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    left = salted.select("a", "b", "salt").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    hubs = busy.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, _, data, offsets in slices(column):
            values, bounds = shingles(find_words(data, offsets))
            out += [values[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch.column("b").to_numpy()
            fresh = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            hub = sets(batch.column("tb").take(pa.array(fresh)))
            keep = []
            for x, k in zip(sets(batch.column("ta")), np.searchsorted(fresh, np.arange(len(b)), "right") - 1, strict=True):
                y = hub[k]
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared > 0 and 100 * shared >= plan.percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return left.join(hubs, ["b", "salt"]).select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long").distinct()


def crossing(open_: DataFrame, documents: DataFrame, work: Workspace, plan: NearDupPlan) -> DataFrame:
    """All links between different components among the documents of `open_` (rep, component, hub).

    An exact prefix filter finds, for each document, the blocks of documents to compare it with. Shingles are ordered by
    whether they occur in several components and then by how many sets hold them; of n shingles, any partner of enough
    overlap holds one of the first n - ceil(n percent) + 1. Blocks hold documents of one component, or single ones that
    share a hub, so a document meets a crowd of alike ones block by block: pairs are compared on whole sets inside a
    task and only links come out, however many alike but unlinked documents there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in slices(batch.column("text")):
                values, bounds = shingles(find_words(data, offsets))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                own = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("rep", "component", "members", "block")), lists], ["rep", "component", "members", "block", "set"])

    grown = work.table(open_.groupBy("component").agg(F.count("*").alias("members")), "grown")
    homes = join_by_key(open_, grown, ["component"], "members").withColumn("home", F.when(F.col("members") > 1, F.col("component")).otherwise(-1 - F.col("hub")))
    crowd = work.table(homes.groupBy("home").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / plan.block)), "crowd")
    # written: from its size it is known whether it can be sent to the texts instead of shuffling these
    dealt = work.table(join_by_key(homes, crowd, ["home"], "size").select("rep", "component", "members", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("block")), "dealt")
    named = texts_of(documents, dealt.select(F.col("rep").alias("doc_id")).distinct())
    texts = named.withColumnRenamed("doc_id", "rep").join(dealt, "rep").select("rep", "component", "members", "block", "text")
    sets = work.table(texts.mapInArrow(tidy(run), "rep long, component long, members long, block long, set array<long>").withColumn("n", F.size("set")), "sets")

    each = sets.select("rep", "component", "members", "block", "n", F.explode("set").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("held"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle", "held")
    ordered = each.join(common, "shingle").groupBy("rep", "component", "members", "block", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("common"))
    # n - ceil(n percent / 100) + 1, less the shingles of one component only, which come first
    room = F.col("n") - F.ceil(F.col("n") * plan.percent / 100) + 1 - (F.col("n") - F.size("common"))
    prefix = ordered.withColumn("room", room.cast("int")).where("room > 0")
    prefix = work.table(prefix.select("rep", "component", "members", "block", "n", F.explode(F.slice("common", F.lit(1), F.col("room"))).alias("s")).select("rep", "component", "members", "block", "n", F.col("s.shingle").alias("shingle")), "prefix")

    held = prefix.groupBy("shingle", "block").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("members").alias("most"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    asked = prefix.select("rep", "component", "members", "n", "shingle").join(held, "shingle")
    other = (F.col("x") != F.col("component")) | (F.col("y") != F.col("component"))
    sized = (100 * F.col("most_n") >= plan.percent * F.col("n")) & (100 * F.col("n") >= plan.percent * F.col("least_n"))
    asked = asked.where(other & sized & (F.col("most") >= F.col("members"))).select("rep", "block").distinct()
    # a block that many ask is copied, so that no task holds more than a bounded part of those who ask
    wanted = asked.groupBy("block").agg(F.ceil(F.count("*") / plan.asking).cast("int").alias("salts"))
    asked = asked.join(wanted, "block").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    left = asked.select("block", "salt", "rep").join(sets.select("rep", "component", "set"), "rep").select("block", "salt", "rep", "component", "set")
    right = sets.join(wanted, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = right.select("block", "salt", "rep", "component", "set").toDF("block", "salt", "of", "in", "held")

    def compare(queries: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if queries.num_rows and members.num_rows:
            held = members.column("held").combine_chunks()
            flat, sizes = held.flatten().to_numpy(), held.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            rep, component = members.column("of").to_numpy(), members.column("in").to_numpy()
            for x, c, own in zip(queries.column("rep").to_numpy(), queries.column("component").to_numpy(), queries.column("set").combine_chunks(), strict=True):
                own = own.values.to_numpy()
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                counts = hi - lo
                total = int(counts.sum())
                if total:
                    at = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(total)
                    shared = np.bincount(owner[at], minlength=len(sizes))
                    linked = (100 * shared >= plan.percent * (len(own) + sizes - shared)) & (component != c)
                    found += [(int(x), int(y)) for y in rep[linked]]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(compare, "a long, b long")


def _labelled(shared: DataFrame, component: DataFrame) -> DataFrame:
    """Members of the buckets with the component of each."""
    return shared.join(component, shared["rep"] == component["node"], "left").drop("node").withColumn("component", F.coalesce("component", "rep"))


def _open(labelled: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components."""
    several = labelled.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band", "key")
    return labelled.join(several, ["band", "key"], "left_semi")


def near_duplicates(documents: DataFrame, plan: NearDupPlan = NearDupPlan()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept."""
    spark = documents.sparkSession
    arrow_limits(spark)
    work = Workspace(spark, "neardup")
    sketched = work.table(sketches(documents, plan), "sketches")
    named = sketched.where("n > 0 and doc_id is not null")
    reps = work.table(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    members = work.table(join_by_key(named.select("doc_id", "n", "d1", "d2"), reps, ["d1", "d2"], "copies").select("doc_id", "n", "rep"), "members")
    work.drop("reps")
    firsts = members.where("doc_id = rep").select("rep").distinct()
    classes = work.table(sketched.select(F.col("doc_id").alias("rep"), "n", "bands", "prefix", "d1", "d2").join(firsts, "rep", "left_semi").where("n > 0").dropDuplicates(["rep", "d1", "d2"]).drop("d1", "d2"), "classes")

    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    banded = banded.unionByName(classes.select("rep", F.lit(-1).alias("band"), F.explode("prefix").alias("key")))
    crowds = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = work.table(banded.join(crowds, ["band", "key"]), "shared")
    # an original shares more bands with its altered copies than they do with each other: it makes the better hub
    degree = shared.groupBy("rep").agg(F.sum("size").alias("degree"))
    shared = work.table(shared.join(degree, "rep"), "ranked")
    work.drop("shared")
    best = F.max(F.struct("degree", (-F.col("rep")).alias("last")))

    component = tested = used = None
    for k in range(plan.star_rounds):
        labelled = shared if component is None else _labelled(shared, component)
        candidates = shared if used is None else _open(labelled).join(used, ["band", "key", "rep"], "left_anti")
        hubs = work.table(candidates.groupBy("band", "key").agg(best.alias("best")).select("band", "key", (-F.col("best.last")).alias("rep")), f"hubs-{k}")
        used = hubs if used is None else used.union(hubs)
        ends = hubs.withColumnRenamed("rep", "hub")
        if component is not None:
            ends = ends.join(component.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hub", "left").withColumn("hub_component", F.coalesce("hub_component", "hub"))
        stars = labelled.join(ends, ["band", "key"]).where("rep <> hub")
        if component is not None:
            stars = stars.where("component <> hub_component")
        # the smaller id stands second only for pairs to be recognised; texts go by the hub
        stars = stars.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
        if tested is not None:
            stars = stars.join(tested.union(tested.select("b", "a")), ["a", "b"], "left_anti")
        stars = work.table(stars, f"stars-{k}")
        tested = stars if tested is None else tested.union(stars)
        # written, since the verification reads its pairs twice
        likely = work.table(promising(stars, classes, plan), f"likely-{k}")
        links = work.table(verified(likely, documents, plan), f"links-{k}")
        if component is not None:
            links = links.union(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
        component = work.table(connected_components(links, work, f"round-{k}"), f"components-{k}")

    if plan.exact:
        crowd = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(-(-classes.count() // plan.block) or 1))
        rest = classes.select("rep").distinct().join(component, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"), crowd.alias("hub"))
    else:
        rest = _open(_labelled(shared, component)).join(used.withColumnRenamed("rep", "hub"), ["band", "key"])
        rest = rest.groupBy("rep", "component").agg(F.min("hub").alias("hub"))
    rest = work.table(rest, "open")
    more = work.table(crossing(rest, documents, work, plan), "links-more")
    component = work.table(connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), work, "last"), "components")
    work.drop("ranked", "classes", "open", "grown", "crowd", "dealt", "sets", "prefix", *(f"{x}-{k}" for x in ("hubs", "stars", "likely") for k in range(plan.star_rounds)))

    grouped = members.join(component, members["rep"] == component["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    alone = sketched.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = grouped.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(documents: DataFrame, plan: NearDupPlan = NearDupPlan()) -> DataFrame:
    """One document of each group, with its own columns; of equal rows (doc_id and text), one stays.

    Rows that repeat a doc_id with other texts are judged each on its own text: they get numbers that keep the order of ids.
    """
    columns = documents.columns
    own, number, place = fresh(columns, "__own"), fresh(columns, "__number"), fresh(columns, "__place")
    again = documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        gone = near_duplicates(documents, plan).where(~F.col("kept")).select("doc_id").distinct()
        return documents.join(gone, "doc_id", "left_anti").select(*columns)
    keyed = documents.withColumn(own, F.xxhash64("text", F.lit(7)))
    several = documents.join(again, "doc_id", "left_semi").select("doc_id", F.xxhash64("text", F.lit(7)).alias(own)).distinct()
    several = several.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(own)) - 1)
    room = several.agg(F.max(place)).first()[0] + 1
    numbered = keyed.join(several, ["doc_id", own], "left").withColumn(number, F.col("doc_id").cast("long") * room + F.coalesce(place, F.lit(0)))
    gone = near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text"), plan).where(~F.col("kept")).select(F.col("doc_id").alias(number)).distinct()
    kept = numbered.join(gone, number, "left_anti")
    once = kept.where(F.col(place).isNotNull()).dropDuplicates([number]).select(*columns)
    return kept.where(F.col(place).isNull()).select(*columns).unionByName(once)
