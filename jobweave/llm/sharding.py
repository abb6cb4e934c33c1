"""Histogram sort into shards of near equal bytes.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together. Probing keys are counted exactly: every
partition sums the bytes below each, and the probes around each wanted splitter close in until the bytes below it are
within the tolerance or no key lies between. A probe is also set at the heaviest key of each interval, so a group of
equal texts of any size is found at once and then split by doc_id. Only then do the rows move, once.

Rows that repeat both doc_id and text stay in one shard. A null text has no bytes; a null doc_id sorts first. Columns of
the caller named size, shard or slot are replaced by the operator's; all others are carried along, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, arrow_limits, fresh, tidy

LOW, HIGH = -(2**63), 2**63 - 1
Key = tuple[int, int]


@dataclass(frozen=True)
class ShardingPlan:
    shards: int = 16
    tolerance: float = 0.001
    probes: int = 32
    partition_bytes: int = 96 << 20
    passes: int = 40


def below(probes: np.ndarray, h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the sorted probes (rows of two numbers) are at most each key."""
    ph, pd_ = probes[:, 0], probes[:, 1]
    first, last = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    tied = np.flatnonzero(first < last)
    out = last
    for lo in np.unique(first[tied]):
        rows = tied[first[tied] == lo]
        hi = last[rows[0]]
        out[rows] = lo + np.searchsorted(pd_[lo:hi], d[rows], "right")
    return out


def counted(keys: DataFrame, probes: list[Key]) -> list[dict]:
    """For each interval between the sorted probes: exact bytes and rows, smallest and largest key parts, and a heavy hash."""

    probes = np.array(probes, np.int64).reshape(-1, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d, size = (b.column(c).to_numpy() for c in ("h", "d", "size"))
            if not len(h):
                continue
            t = pd.DataFrame({"bin": below(probes, h, d), "h": h, "d": d, "size": size})
            own = t.groupby(["bin", "h"], sort=True).agg(bytes=("size", "sum"), rows=("size", "size"), low_d=("d", "min"), high_d=("d", "max")).reset_index()
            heavy = own.loc[own.groupby("bin")["bytes"].idxmax(), ["bin", "h", "bytes"]].rename(columns={"h": "heavy", "bytes": "heavy_bytes"})
            found = own.groupby("bin").agg(bytes=("bytes", "sum"), rows=("rows", "sum"), low_h=("h", "min"), high_h=("h", "max"), low_d=("low_d", "min"), high_d=("high_d", "max")).reset_index()
            yield pa.RecordBatch.from_pandas(found.merge(heavy, on="bin"), preserve_index=False)

    parts = keys.mapInArrow(tidy(count), "bin long, bytes long, rows long, low_h long, high_h long, low_d long, high_d long, heavy long, heavy_bytes long")
    out = parts.groupBy("bin").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low_h").alias("low_h"), F.max("high_h").alias("high_h"),
        F.min("low_d").alias("low_d"), F.max("high_d").alias("high_d"), F.max_by("heavy", "heavy_bytes").alias("heavy"),
    )
    return [r.asDict() for r in out.collect()]


def between(cell: dict, n: int) -> list[Key]:
    """About n probing keys inside an interval, by hash or, where one hash fills it, by doc_id."""
    if cell["low_h"] < cell["high_h"]:
        step = max(1, (cell["high_h"] - cell["low_h"]) // (n + 1))
        out = [(cell["low_h"] + step * k, LOW) for k in range(1, n + 1)]
        out += [(cell["heavy"], LOW), (min(cell["heavy"] + 1, HIGH), LOW), (cell["high_h"], LOW)]
        return [p for p in out if cell["low_h"] < p[0] <= cell["high_h"]]
    step = max(1, (cell["high_d"] - cell["low_d"]) // (n + 1))
    out = [(cell["low_h"], cell["low_d"] + step * k) for k in range(1, n + 1)]
    return [p for p in [*out, (cell["low_h"], cell["high_d"])] if cell["low_d"] < p[1] <= cell["high_d"]]


def splitters(keys: DataFrame, plan: ShardingPlan) -> tuple[list[Key], int]:
    """The keys where shards 1 and up begin, and the bytes in all."""
    known: dict[Key, int] = {}
    probes = [(LOW + (2**64 // (plan.shards * plan.probes)) * k, LOW) for k in range(1, plan.shards * plan.probes)]
    total = 0
    for _ in range(plan.passes):
        probes = sorted(set(probes))
        cells = {c["bin"]: c for c in counted(keys, probes)}
        total = sum(c["bytes"] for c in cells.values())
        sums = 0
        for k, p in enumerate(probes):
            sums += cells[k]["bytes"] if k in cells else 0
            known[p] = sums
        ordered = sorted(known.items(), key=lambda x: x[1])
        amounts = np.array([v for _, v in ordered])
        slack = plan.tolerance * total / plan.shards
        chosen, again = [], []
        edges = np.cumsum([cells[k]["bytes"] if k in cells else 0 for k in range(len(probes) + 1)])
        for s in range(1, plan.shards):
            want = total * s / plan.shards
            near = int(np.argmin(np.abs(amounts - want)))
            chosen.append(ordered[near][0])
            if abs(amounts[near] - want) > slack:
                k = int(np.searchsorted(edges, want, "left"))
                again += between(cells[k], plan.probes) if k in cells else []
        again = [p for p in again if p not in known]
        if not again:
            break
        probes = again + [p for p in chosen]
    return sorted(chosen), total


def shard_documents(documents: DataFrame, plan: ShardingPlan = ShardingPlan()) -> DataFrame:
    """`documents` with size, shard and slot, moved to their places by one exchange. The shards' bytes differ by the tolerance or by one row."""
    spark = documents.sparkSession
    arrow_limits(spark)
    names = [c for c in documents.columns if c.lower() not in ("size", "shard", "slot")]
    hash_, id_, at_, piece = (fresh(names, c) for c in ("__h", "__d", "__at", "__piece"))
    rows = documents.select(*names).withColumns({
        hash_: F.xxhash64(F.coalesce("text", F.lit(""))), id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)),
        "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"),
    })
    work = Workspace(spark, "sharding")
    keys = work.table(rows.select(F.col(hash_).alias("h"), F.col(id_).alias("d"), "size"), "keys")
    starts, total = splitters(keys, plan)
    parts = max(1, -(-total // (plan.shards * plan.partition_bytes)))
    cuts = set(starts)
    for low, high in zip([(LOW, LOW), *starts], [*starts, (HIGH, HIGH)], strict=True):
        one = low[0] == high[0]
        cuts.update(between({"low_h": low[0], "high_h": high[0], "heavy": low[0], "low_d": low[1], "high_d": high[1]}, parts - 1)[: parts - 1] if parts > 1 and (not one or high[1] > low[1]) else [])
    cuts = sorted(cuts)
    amount = {c["bin"]: c["rows"] for c in counted(keys, cuts)}
    work.drop("keys")
    of_cut = np.array([0, *(bisect_right(starts, c) for c in cuts)], np.int64)
    count = np.array([amount.get(k, 0) for k in range(len(cuts) + 1)], np.int64)
    base = np.cumsum(count) - count
    shared = spark.sparkContext.broadcast((np.array(cuts, np.int64).reshape(-1, 2), of_cut, base - base[np.searchsorted(of_cut, of_cut)]))

    @F.pandas_udf("piece int, shard int, base long")
    def place(h: pd.Series, d: pd.Series) -> pd.DataFrame:
        cuts, of_cut, base = shared.value
        at = below(cuts, h.to_numpy(), d.to_numpy())
        return pd.DataFrame({"piece": at.astype(np.int32), "shard": of_cut[at].astype(np.int32), "base": base[at]})

    placed = rows.withColumn(at_, place(hash_, id_)).withColumn(piece, F.col(at_)["piece"])
    order = Window.partitionBy(piece).orderBy(hash_, id_)
    # the piece is the partition: no two pieces meet in one task while others stay empty
    placed = placed.repartitionById(len(cuts) + 1, F.col(piece)).withColumn("slot", F.col(at_)["base"] + F.row_number().over(order) - 1)
    return placed.withColumn("shard", F.col(at_)["shard"]).drop(hash_, id_, at_, piece)


def sharding_query(documents: DataFrame, plan: ShardingPlan = ShardingPlan()) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not by key)."""
    out = shard_documents(documents.select("doc_id", "text"), plan)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
