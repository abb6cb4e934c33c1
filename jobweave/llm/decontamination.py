"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Test items are short and documents long, so their Jaccard similarity says little; what counts is the share of an item's
five-word shingles that a document holds. Items are partitioned by size (within a factor of two). Every item keeps the
shingles with the smallest hashes, a bottom-k MinHash sample: as many as a document that holds the item may lack, and
`hits` of its partition on top, so such a document has that many of the sample, and none is missed. A document too small
for a partition is never counted for it. Candidates are then verified by the exact containment of the whole sets.

Texts are lowered and parted at ASCII blanks. An item of fewer than five words is looked for as it is, among the windows
of its own width of every document. A null or blank text has no words: such an item is found nowhere, such a document
holds nothing. Rows are told apart by doc_id and text, so null and repeated ids are judged each on its own text, and
equal rows give one result. Other columns play no part, whatever their names; empty tables give no rows.

The items' samples and sets are broadcast only if they hold less than `broadcast_bytes`; beyond that they are joined by
shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, fresh


@dataclass(frozen=True)
class ContainmentPlan:
    percent: int = 75
    width: int = 5
    hits: int = 8
    broadcast_bytes: int = 64 << 20


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_sets(df: DataFrame, text: str = "text", width: int = 5, out: str = "shingles") -> DataFrame:
    """`df` with its text replaced by the array of distinct shingle hashes."""
    h = F.col("__words")
    n = F.size(h)
    full = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
    few = F.array(F.xxhash64(F.concat_ws(" ", h.cast("array<string>")), n))
    sets = F.when(n >= width, F.array_distinct(full)).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("__words", word_hashes(F.col(text))).drop(text).withColumn(out, sets).drop("__words")


def windows(words: Column, width: int) -> Column:
    """Hashes of the runs of so many words, each with its width."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)], F.lit(width)))
    return F.when(n >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def item_samples(items: DataFrame, plan: ContainmentPlan) -> DataFrame:
    """Rows (shingle, item_id, partition floor of the size, least hits) of the size-partitioned sample.

    A document that holds an item lacks at most `lacking` of its shingles, so of lacking + least sampled ones it has `least`.
    """
    floor = F.pow(F.lit(2.0), F.floor(F.log2("n_item"))).cast("long")
    # xxhash64 of the shingle hash orders the shingles independently of their values
    ordered = F.array_sort(F.transform("shingles", lambda x: F.struct(F.xxhash64(x, F.lit(9)).alias("o"), x.alias("x"))))
    lacking = F.floor(F.col("n_item") * (100 - plan.percent) / 100)
    sampled = items.withColumn("floor", floor).withColumn("least", F.greatest(F.lit(1), F.least(F.lit(plan.hits), F.floor(F.col("floor") / 4))))
    taken = F.slice(ordered, F.lit(1), (lacking + F.col("least")).cast("int"))
    return sampled.select("item_id", "text_key", "floor", "least", F.explode(F.transform(taken, lambda s: s["x"])).alias("shingle"))


def contained_items(documents: DataFrame, benchmark: DataFrame, plan: ContainmentPlan = ContainmentPlan()) -> DataFrame:
    """One row for each document (doc_id, text_key) and item it holds: n_item, n_shared, containment."""
    spark = documents.sparkSession
    work = Workspace(spark, "decontamination")
    read = benchmark.select("item_id", "text", F.xxhash64("text").alias("text_key")).withColumn("n_words", F.size(word_hashes(F.col("text"))))
    items = shingle_sets(read, width=plan.width).withColumn("n_item", F.size("shingles").cast("long"))
    items = work.table(items.where("n_item > 0").dropDuplicates(["item_id", "text_key"]), "items")
    long = items.where(F.col("n_words") >= plan.width).drop("n_words")
    samples = work.table(item_samples(long, plan), "samples")
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("doc_key"))
    # sizes in bytes: 40 a sample row; 8 a shingle of the whole sets, and 40 a row
    light = samples.count() * 40 <= plan.broadcast_bytes
    volume = long.agg(F.coalesce(F.sum(F.col("n_item") * 8 + 40), F.lit(0))).first()[0]
    wanted = F.broadcast(samples) if light else samples

    # explode_outer: for explode, Spark would filter on the sets' size first and so compute every word array once a shingle
    held = shingle_sets(texts, width=plan.width).select("doc_id", "doc_key", F.size("shingles").alias("n_doc"), F.explode_outer("shingles").alias("shingle"))
    hits = held.join(wanted, "shingle").where(100 * F.col("n_doc") >= plan.percent * F.col("floor"))
    found = hits.groupBy("doc_id", "doc_key", "item_id", "text_key").agg(F.count("*").alias("hits"), F.max("least").alias("least"))
    candidates = work.table(found.where("hits >= least").select("doc_id", "doc_key", "item_id", "text_key"), "candidates")

    both = F.broadcast(long) if volume <= plan.broadcast_bytes else long
    keys = candidates.select("doc_id", "doc_key").distinct()
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & x["doc_key"].eqNullSafe(y["doc_key"])
    suspects = shingle_sets(texts.join(keys, same(texts, keys), "left_semi"), width=plan.width).withColumnRenamed("shingles", "doc_shingles")
    matched = candidates.join(suspects, same(candidates, suspects)).select(candidates["doc_id"], candidates["doc_key"], "item_id", "text_key", "doc_shingles")
    exact = matched.join(both, ["item_id", "text_key"]).withColumn("n_shared", F.size(F.array_intersect("shingles", "doc_shingles")).cast("long"))
    exact = exact.where(100 * F.col("n_shared") >= plan.percent * F.col("n_item"))
    out = exact.select("doc_id", "doc_key", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()

    # items of fewer words than a shingle, if there are any: a pass for all of their widths at once
    short = items.where(F.col("n_words") < plan.width)
    widths = sorted(r["n_words"] for r in short.select("n_words").distinct().collect())
    if widths:
        of_item = [F.when(F.col("n_words") == w, F.element_at(windows(F.col("words"), w), 1)) for w in widths]
        own = benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
        own = own.where(F.col("n_words").isin(widths)).select("item_id", F.coalesce(*of_item).alias("window")).distinct()
        own = F.broadcast(own) if own.count() * 24 <= plan.broadcast_bytes else own
        runs = texts.select("doc_id", "doc_key", word_hashes(F.col("text")).alias("words"))
        runs = runs.select("doc_id", "doc_key", F.explode_outer(F.concat(*[windows(F.col("words"), w) for w in widths])).alias("window"))
        one = F.lit(1).cast("long")
        short_found = runs.join(own, "window").select("doc_id", "doc_key", "item_id", one.alias("n_item"), one.alias("n_shared"), F.lit(1.0).alias("containment"))
        out = out.unionByName(short_found.distinct())
    return out


def decontamination_query(documents: DataFrame, benchmark: DataFrame, plan: ContainmentPlan = ContainmentPlan()) -> DataFrame:
    """Each document and item it holds by 75 per cent or more: doc_id, item_id, n_item, n_shared, containment."""
    return contained_items(documents, benchmark, plan).drop("doc_key")


def without_benchmark(documents: DataFrame, benchmark: DataFrame, plan: ContainmentPlan = ContainmentPlan()) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    id_, key = fresh(documents.columns, "__id"), fresh(documents.columns, "__key")
    found = contained_items(documents, benchmark, plan).select(F.col("doc_id").alias(id_), F.col("doc_key").alias(key)).distinct()
    same = documents["doc_id"].eqNullSafe(found[id_]) & F.xxhash64(documents["text"]).eqNullSafe(found[key])
    return documents.join(found, same, "left_anti")


SHINGLES_SQL = """
{name}_words AS (
  SELECT {keys}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM {table}
), {name}_shingles AS (
  SELECT DISTINCT {keys}, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM {name}_words
)"""

ORACLE = (
    "WITH "
    + SHINGLES_SQL.format(name="d", keys="doc_id", table="documents")
    + ", "
    + SHINGLES_SQL.format(name="b", keys="item_id", table="benchmark")
    + """, sizes AS (SELECT item_id, count(*) AS n_item FROM b_shingles GROUP BY item_id)
, shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d_shingles JOIN b_shingles USING (s) GROUP BY doc_id, item_id)
, short AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS words FROM b_words WHERE len(w) BETWEEN 1 AND 4)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 75 * n_item AND item_id NOT IN (SELECT item_id FROM short)
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0 FROM d_words, short WHERE contains(' ' || array_to_string(w, ' ') || ' ', words)"""
)
