"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph; the graph is cut into parts of equal size with few cut edges (recursive
spectral bisection at the median, then swaps that lower the cut); a small network learns from a vector alone which parts
its neighbours lie in. Parts grow with the rows: where more are wanted than one network tells apart, each part of the
first level gets a graph, a cut and a network of its own. Every vector is indexed under its most probable part. A query
is routed to its most probable parts until they hold a share of the probability, and all of their vectors are compared
with it, in double precision on the original vectors. That share is fitted: rows drawn by hash from all that are indexed
seek their nearest vectors in a bounded sample, and the least share that reaches the wanted recall counts. Where a table
exceeds the samples these rows are hardly any that the networks saw, so vectors without structure cost more probes, not
recall. `compared` of a result says how many vectors its query was compared with.

Equal vectors (told by 128-bit hashes) are indexed and searched once, whatever number of rows has them, each with its
smallest ids, which decide ties. Vectors that are null, all zero, of another length than most, or with null or
non-finite components take no part, nor do rows without a vec_id. Of rows that repeat a query's vec_id one is searched.
Ties go to the smaller vec_id; fewer candidates than asked for are all returned. Other columns play no part. Tables of up to 64 usable
vectors have one part and no router, so the search is exact; an empty table gives no rows. Beyond `fan`**2 parts (67
million vectors) the parts grow instead of their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, arrow_limits, join_by_key, tidy


@dataclass(frozen=True)
class SearchPlan:
    """`sample` bounds the vectors that one network learns from, `fan` the parts that it tells apart; `asked` rows fit how many parts `recall` takes; blocks bound a task's memory."""

    neighbours: int = 5
    sample: int = 8192
    graph_degree: int = 5
    part_rows: int = 4096
    least_parts: int = 64
    least_rows: int = 65
    fan: int = 128
    hidden: int = 256
    epochs: int = 120
    recall: float = 0.96
    asked: int = 512
    least_probes: int = 3
    block_bytes: int = 16 << 20
    query_bytes: int = 8 << 20

    def levels(self, rows: int) -> tuple[int, int]:
        """Parts of the first level, and of each of them."""
        parts = min(self.least_parts, self.fan) if rows >= self.least_rows else 1
        while parts * self.part_rows < rows and parts < self.fan**2:
            parts *= 2
        first = min(parts, self.fan)
        return first, parts // first


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of the nearest other rows by cosine."""
    degree = min(degree, len(x) - 1)
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2.0
        out[at : at + len(s)] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def bisect(nodes: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which half each node belongs to: halves of equal size, few edges between."""
    n = len(nodes)
    place = np.full(graph.shape[0], -1)
    place[nodes] = np.arange(n)
    to = place[graph[nodes]]
    a, k = np.nonzero(to >= 0)
    b = to[a, k]
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(source, minlength=n) + 1.0
    v = rng.standard_normal(n)
    for _ in range(60):  # the second eigenvector of the lazy walk
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * (np.bincount(source, v[target], n) + v) / degree
        v /= np.abs(v).max() + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(8):  # swap the nodes with most to gain, in pairs
        across = np.bincount(source, side[target] != side[source], n)
        gain = 2 * across - (degree - 1)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        both = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 0)[: max(1, n // 20)]
        if not len(both):
            break
        side[left[both]], side[right[both]] = True, False
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A part for every node; `parts` is a power of two and the sizes differ by rounding only."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros(len(graph), np.int64)
    size = 1
    while size < parts:
        new = out * 2
        for p in range(size):
            nodes = np.flatnonzero(out == p)
            if len(nodes) > 1:
                new[nodes[bisect(nodes, graph, rng)]] += 1
        out, size = new, size * 2
    return out


class Router:
    """One hidden layer from a unit vector to probabilities of parts."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.maximum(x @ w1 + b1, 0.0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    @classmethod
    def trained(cls, x: np.ndarray, wanted: np.ndarray, plan: SearchPlan) -> Router:
        """Cross entropy against the parts that a vector and its neighbours lie in."""
        rng = np.random.Generator(np.random.PCG64(11))
        d, parts = x.shape[1], wanted.shape[1]
        w = [rng.standard_normal((d, plan.hidden)) * np.sqrt(2 / d), np.zeros(plan.hidden), rng.standard_normal((plan.hidden, parts)) * np.sqrt(1 / plan.hidden), np.zeros(parts)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for epoch in range(plan.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                own = order[at : at + 256]
                h = np.maximum(x[own] @ w[0] + w[1], 0.0)
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                gap = (z / z.sum(axis=1, keepdims=True) - wanted[own]) / len(own)
                back = (gap @ w[2].T) * (h > 0)
                grads = [x[own].T @ back, back.sum(0), h.T @ gap, gap.sum(0)]
                step += 1
                rate = 0.005 * (1 - epoch / plan.epochs) + 1e-4
                for k, g in enumerate(grads):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(w)


def fit(x: np.ndarray, parts: int, plan: SearchPlan) -> Router:
    x = unit(x)
    graph = neighbour_graph(x, plan.graph_degree)
    part = balanced_parts(graph, parts)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (np.arange(len(x)), part), 1.0)
    for k in range(graph.shape[1]):
        np.add.at(wanted, (np.arange(len(x)), part[graph[:, k]]), 1.0)
    return Router.trained(x, wanted / wanted.sum(1, keepdims=True), plan)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    good = embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _nearest(q: np.ndarray, u: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query vector the k nearest ids of the vectors u: index of the query, id, score. Equal vectors get equal scores whatever their place."""
    length = np.sqrt((u * u).sum(1))
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(q), 512):
        own = q[at : at + 512]
        near = unit(own) @ (u / length[:, None]).T
        most = min(k, len(u))
        line = -np.partition(-near, most - 1, axis=1)[:, most - 1] - 1e-9
        for r in range(len(own)):
            c = np.flatnonzero(near[r] >= line[r])
            score = (u[c] * own[r]).sum(1) / (length[c] * np.sqrt((own[r] * own[r]).sum()))
            held = np.concatenate([ids[p] for p in c])
            scores = np.repeat(score, [len(ids[p]) for p in c])
            best = np.lexsort((held, -scores))[:k]
            out_q.append(np.full(len(best), at + r))
            out_v.append(held[best])
            out_s.append(scores[best])
    return tuple(np.concatenate(o) if o else np.zeros(0, t) for o, t in ((out_q, np.int64), (out_v, np.int64), (out_s, np.float64)))


class Routers:
    """The network of the first level and those of its parts. Parts are numbered first * second + place."""

    def __init__(self, root: Router | None, leaves: dict[int, Router], second: int):
        self.root, self.leaves, self.second = root, leaves, second

    def _first(self, x: np.ndarray) -> np.ndarray:
        return self.root.probabilities(x) if self.root else np.ones((len(x), 1))

    def _second(self, part: int, x: np.ndarray) -> np.ndarray:
        if part in self.leaves:
            return self.leaves[part].probabilities(x)
        return np.eye(1, self.second).repeat(len(x), 0)

    def part(self, x: np.ndarray) -> np.ndarray:
        first = self._first(x).argmax(1)
        out = first * self.second
        for c in np.unique(first) if self.second > 1 else ():
            own = np.flatnonzero(first == c)
            out[own] += self._second(int(c), x[own]).argmax(1)
        return out

    def probable(self, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, part and probability of all parts of first-level parts that are at least so probable."""
        first = self._first(x)
        rows, parts, mass = [], [], []
        for c in range(first.shape[1]):
            own = np.flatnonzero(first[:, c] >= least)
            if len(own):
                p = first[own, c, None] * (self._second(c, x[own]) if self.second > 1 else 1.0)
                rows.append(np.repeat(own, p.shape[1]))
                parts.append(np.tile(c * self.second + np.arange(p.shape[1]), len(own)))
                mass.append(p.ravel())
        return tuple(np.concatenate(v) if v else np.zeros(0, t) for v, t in ((rows, np.int64), (parts, np.int64), (mass, np.float64)))


LEAST = 1e-6  # first-level parts less probable than this are not looked into where there are two levels


@dataclass
class Ranked:
    """Parts that have vectors, for each row by falling probability: `before` is the share of the probability that precedes a part, `ahead` the vectors."""

    rows: np.ndarray
    parts: np.ndarray
    before: np.ndarray
    ahead: np.ndarray
    place: np.ndarray


def ranked(routers: Routers, x: np.ndarray, sizes: dict[int, int]) -> Ranked:
    rows, parts, mass = routers.probable(x, LEAST if routers.second > 1 else 0.0)
    size = np.array([sizes.get(p, 0) for p in parts.tolist()], np.int64)
    order = np.lexsort((parts, -mass, rows))
    order = order[size[order] > 0]
    rows, parts, mass, size = rows[order], parts[order], mass[order], size[order]
    start = np.searchsorted(rows, np.arange(len(x)))[rows]
    before = lambda v: (np.cumsum(v) - v) - (np.cumsum(v) - v)[start]
    whole = np.bincount(rows, mass, len(x))
    return Ranked(rows, parts, before(mass) / whole[rows], before(size), np.arange(len(rows)) - start)


def probes(routers: Routers, x: np.ndarray, sizes: dict[int, int], mass: float, plan: SearchPlan) -> tuple[np.ndarray, np.ndarray]:
    """(row, part): the most probable parts that have vectors, until they hold the mass, are enough, and have enough vectors."""
    r = ranked(routers, x, sizes)
    keep = (r.before <= mass) | (r.place < plan.least_probes) | (r.ahead <= plan.neighbours)
    rows, parts = r.rows[keep], r.parts[keep]
    poor = np.bincount(rows, [sizes[p] for p in parts.tolist()], len(x)) <= plan.neighbours
    if poor.any() and len(sizes):  # hardly any vectors where the query was sent: all parts
        add = np.flatnonzero(poor)
        rows, parts = np.concatenate([rows[~poor[rows]], np.repeat(add, len(sizes))]), np.concatenate([parts[~poor[rows]], np.tile(np.array(list(sizes)), len(add))])
    return rows, parts


def wanted_mass(routers: Routers, q: np.ndarray, u: np.ndarray, part: np.ndarray, same: np.ndarray, sizes: dict[int, int], plan: SearchPlan) -> float:
    """The least mass with which the probed parts hold `recall` of the neighbours of q among the vectors u of the given parts; `same` is each q's own place in u, or -1."""
    near = unit(q) @ unit(u).T
    own = np.flatnonzero(same >= 0)
    near[own, same[own]] = -2.0
    k = min(plan.neighbours, len(u) - 1)
    nearest = np.argpartition(-near, k - 1, axis=1)[:, :k]
    r = ranked(routers, unit(q), sizes)
    needed = {(a, b): m for a, b, m in zip(r.rows.tolist(), r.parts.tolist(), r.before.tolist(), strict=True)}
    each = [needed.get((a, b), 1.0) for a, row in enumerate(part[nearest].tolist()) for b in row]
    return float(np.quantile(each, plan.recall, method="higher"))


def fitted_mass(routers: Routers, index: DataFrame, sizes: dict[int, int], plan: SearchPlan) -> float:
    """`wanted_mass` of at most `asked` rows of the index against at most `sample`, both drawn by hash and compared in one task."""
    total = sum(sizes.values())
    if routers.root is None or total < 2:
        return 1.0
    shared = index.sparkSession.sparkContext.broadcast(routers)

    def drawn(seed: int, most: int, asks: bool) -> DataFrame:
        key = F.xxhash64("h1", "h2", F.lit(seed))
        some = index.where(F.pmod(key, F.lit(1 << 30)) < int(min(1.0, 2 * most / total) * (1 << 30)))
        return some.orderBy(key, "h1", "h2").limit(most).select(F.lit(asks).alias("asks"), "part", "h1", "h2", "embedding")

    def fit_mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("asks").to_numpy(zero_copy_only=False), *(b.column(c).to_numpy() for c in ("part", "h1", "h2")), _matrix(b.column("embedding"))) for b in batches if b.num_rows]
        asks, part, h1, h2, x = (np.concatenate(c) for c in zip(*found, strict=True))
        place = {k: i for i, k in enumerate(zip(h1[~asks].tolist(), h2[~asks].tolist(), strict=True))}
        same = np.array([place.get(k, -1) for k in zip(h1[asks].tolist(), h2[asks].tolist(), strict=True)], np.int64)
        few = len(place) < 2 or not asks.any()
        yield pa.RecordBatch.from_arrays([pa.array([1.0 if few else wanted_mass(shared.value, x[asks], x[~asks], part[~asks], same, sizes, plan)])], ["mass"])

    return drawn(8, plan.asked, True).unionByName(drawn(9, plan.sample, False)).repartition(1).mapInArrow(tidy(fit_mass), "mass double").first()["mass"]


def trained(batches, parts: int, plan: SearchPlan) -> list[np.ndarray]:
    """Weights of a network for these vectors; none if there are too few to part."""
    found = [_matrix(c) for c in batches if len(c)]
    x = np.concatenate(found) if found else np.zeros((0, 1))
    return [w.astype(np.float32) for w in fit(x, parts, plan).weights] if len(x) > parts else []


def _router(row) -> Router | None:
    return Router([np.array(w, np.float64).reshape(s) for w, s in zip(row["w"], row["shape"], strict=True)]) if row["w"] else None


def learned(vectors: DataFrame, total: int, plan: SearchPlan, work: Workspace) -> tuple[Routers, DataFrame]:
    """The networks, and `vectors` (h1, h2, ids, embedding) with the part of each."""
    spark = vectors.sparkSession
    first, second = plan.levels(total)
    chance = F.pmod(F.xxhash64("h1", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    model = "w array<array<float>>, shape array<array<long>>"
    as_row = lambda weights: (pa.array([[w.ravel() for w in weights]], pa.list_(pa.list_(pa.float32()))), pa.array([[list(w.shape) for w in weights]], pa.list_(pa.list_(pa.int64()))))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(list(as_row(trained((b.column("embedding") for b in batches), first, plan))), ["w", "shape"])

    root = None
    if first > 1:
        sample = vectors.where(chance < min(1.0, plan.sample / total)).orderBy(F.xxhash64("h1", F.lit(6))).limit(plan.sample)
        root = _router(sample.select("embedding").repartition(1).mapInArrow(tidy(train), model).first())

    def dealt(routers: Routers, df: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(routers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    part = shared.value.part(unit(_matrix(b.column("embedding"))))
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), *(b.column(c) for c in ("h1", "h2", "ids", "embedding"))], ["part", "h1", "h2", "ids", "embedding"])

        return df.mapInArrow(tidy(run), "part long, h1 long, h2 long, ids array<long>, embedding array<double>")

    routers = Routers(root, {}, 1)
    if second > 1 and root:
        halfway = work.table(dealt(routers, vectors), "halfway")
        share = {r["part"]: min(1.0, plan.sample / r["count"]) for r in halfway.groupBy("part").count().collect()}
        shares = F.create_map(*[x for p, v in share.items() for x in (F.lit(p).cast("long"), F.lit(v))])

        def train_part(group: pa.Table) -> pa.Table:
            w, shape = as_row(trained(group.column("embedding").chunks, second, plan))
            return pa.table({"part": group.column("part")[:1].combine_chunks(), "w": w, "shape": shape})

        rows = halfway.where(chance < shares[F.col("part")]).select("part", "embedding").groupBy("part").applyInArrow(train_part, "part long, " + model).collect()
        leaves = {r["part"]: _router(r) for r in rows}
        routers = Routers(root, {p: r for p, r in leaves.items() if r}, second)
    return routers, work.table(dealt(routers, vectors), "index")


def nearest(embeddings: DataFrame, is_query, plan: SearchPlan = SearchPlan()) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows found for every row of which `is_query` holds, and `compared`, the vectors that the query met (equal ones are one)."""
    spark = embeddings.sparkSession
    arrow_limits(spark)
    work = Workspace(spark, "ann")
    k = plan.neighbours
    rows = work.table(usable(embeddings).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64("embedding", F.lit(1))}), "rows")

    # each vector once, with its smallest ids: one more than asked for, as a query's own is left out
    each = rows.groupBy("h1", "h2", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = each.groupBy("h1", "h2").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "copies"))), lambda e: F.array_repeat(e["vec_id"], e["copies"]))).alias("ids"))
    vectors = work.table(rows.select("h1", "h2", "embedding").dropDuplicates(["h1", "h2"]).join(ids, ["h1", "h2"]).select("h1", "h2", "ids", "embedding"), "vectors")
    total = vectors.count()
    width = (vectors.select(F.size("embedding")).first() or [1])[0]
    routers, index = learned(vectors, total, plan, work)
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    mass = fitted_mass(routers, index, sizes, plan)
    shared = spark.sparkContext.broadcast((routers, sizes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, part = probes(shared.value[0], unit(_matrix(b.column("embedding"))), shared.value[1], mass, plan)
                own = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), *(own.column(c) for c in ("h1", "h2", "embedding"))], ["part", "h1", "h2", "embedding"])

    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("h1", "h2"))
    queries = work.table(rows.where(is_query).withColumn("one", one).where("one = 1").select("vec_id", "h1", "h2"), "queries")
    asking = queries.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    asked = vectors.select("h1", "h2", "embedding").join(asking.select("h1", "h2"), ["h1", "h2"])
    routed = work.table(asked.mapInArrow(tidy(route), "part long, h1 long, h2 long, embedding array<double>"), "routed")

    # a part's vectors meet in blocks, those who ask it in groups, so that no task holds all of either
    block_rows, group_rows = (max(256, size // (8 * width)) for size in (plan.block_bytes, plan.query_bytes))
    askers = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    plans = [(p, n, -(-n // block_rows), -(-askers.get(p, 0) // group_rows)) for p, n in sizes.items()]
    parts = F.broadcast(spark.createDataFrame(plans, "part long, size long, blocks long, groups long"))  # at most fan * fan rows
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    groups = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))
    left = routed.join(parts, "part").withColumn("group", F.pmod(F.xxhash64("h1", "h2"), F.col("groups"))).withColumn("block", blocks).drop("size", "blocks", "groups")
    right = index.join(parts.where("groups > 0"), "part").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks"))).withColumn("group", groups).drop("size", "blocks", "groups")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        h1, h2, v, s = np.zeros((4, 0))
        if left.num_rows and right.num_rows:
            of = lambda t: np.concatenate([_matrix(c) for c in t.column("embedding").chunks if len(c)])
            own = right.column("ids").combine_chunks()
            edges = np.append(0, np.cumsum(own.value_lengths().to_numpy()))
            flat = own.flatten().to_numpy()
            at, v, s = _nearest(of(left), of(right), [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], 2 * k)
            h1, h2 = left.column("h1").to_numpy()[at], left.column("h2").to_numpy()[at]
        return pa.table({"h1": pa.array(h1.astype(np.int64)), "h2": pa.array(h2.astype(np.int64)), "vec_id": pa.array(v.astype(np.int64)), "score": pa.array(s, pa.float64())})

    keys = ("part", "block", "group")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "h1 long, h2 long, vec_id long, score double")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 * k)
    found = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    met = routed.select("part", "h1", "h2").join(parts.select("part", "size"), "part").groupBy("h1", "h2").agg(F.sum("size").alias("compared"))
    found = work.table(found.join(met, ["h1", "h2"]).join(asking, ["h1", "h2"]), "found")
    answers = join_by_key(queries.withColumnRenamed("vec_id", "query_id"), found, ["h1", "h2"])
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = answers.select("query_id", "compared", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score", "compared")


def ann_query(embeddings: DataFrame, plan: SearchPlan = SearchPlan()) -> DataFrame:
    """The five nearest rows of every row whose vec_id is divisible by 50."""
    return nearest(embeddings, F.col("vec_id") % 50 == 0, plan)


def recall(found, exact) -> float:
    """Share of the exact neighbours among those found."""
    pairs = lambda t: set(zip(t["query_id"], t["vec_id"], strict=True))
    return len(pairs(found) & pairs(exact)) / max(1, len(pairs(exact)))
