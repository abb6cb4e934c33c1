"""A Merkle tree over a table, level by level through windows: a root for each group of rows, one over all groups, and a proof for each row.

A level's nodes are (group, place, digest). A window over (group, place of the parent) collects the up to `fan` digests of
a run: joined they are the parent's preimage, without a node's own they are its siblings. One row of each run goes on as
the parent. Levels shrink by `fan` and are written tables, so a lost executor costs one level; the groups' roots make the
leaves of one more tree. Proofs come down the same levels: a node's steps are its own siblings and its parent's steps.

Leaves get their places without any group in one task: rows are dealt by ranges of (group, order), each task numbers its
own share of a group, and the shares before it are added from counts. Each run has `fan` rows at most. So a source with a
third of all rows is spread like any other.

Rows: a null is hashed as `-`; a null group or id comes first; rows of one id go by their digests, and equal rows take
places of their own. A text of any length is hashed in place and goes no further than its digest. Other columns take no
part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(preimage: Column) -> Column:
    return F.sha2(preimage.cast("binary"), 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of values told apart by their lengths: `-` for a null, else UTF-8 byte count, colon, value."""
    written = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c), F.lit(":"), c)) for c in written]))


def numbered(work: Workspace, rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows` with their place (from 0) in their group by `order`, and the group's size n. `group` and `order` must tell all rows apart to be exact about ties."""
    ranged = rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id())
    held = work.table(ranged, name)
    counts = held.groupBy("part", group).agg(F.count("*").alias("own"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", group, F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy(group)).alias("n"))
    here = held.withColumn("at", F.row_number().over(Window.partitionBy("part", group).orderBy(*order)).cast("bigint") - 1)
    return here.join(counts, ["part", group]).withColumn("place", F.col("at") + F.col("before")).drop("part", "at", "before")


@dataclass(frozen=True)
class Tree:
    """The levels of the trees of all groups, lowest first, each with the columns g, place, digest, n."""

    levels: list[DataFrame]
    fan: int

    @property
    def roots(self) -> DataFrame:
        """g and digest of what remains of each group."""
        out = None
        for level in self.levels:
            own = level.where("n = 1").select("g", "digest")
            out = own if out is None else out.unionByName(own)
        return out


def _runs(level: DataFrame, fan: int) -> DataFrame:
    """Nodes of groups that have more than one, with their run's parent: its place and preimage, and the siblings on both sides."""
    nodes = level.where("n > 1").withColumn("up", F.floor(F.col("place") / fan).cast("bigint"))
    run = Window.partitionBy("g", "up").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.col("place") % fan).cast("int")
    nodes = nodes.withColumn("run", F.collect_list("digest").over(run))
    return nodes.withColumns({"preimage": F.array_join("run", ""), "left": F.array_join(F.slice("run", F.lit(1), at), ""), "right": F.array_join(F.slice("run", at + 2, F.lit(fan)), "")}).drop("run")


def tree(work: Workspace, nodes: DataFrame, name: str, fan: int = FAN) -> Tree:
    """The levels above `nodes` (g, place, digest, n), each written, until every group is down to one node."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = _runs(levels[-1], fan).where(F.col("place") % fan == 0)
        parents = first.select("g", F.col("up").alias("place"), digest(F.col("preimage")).alias("digest"), F.ceil(F.col("n") / fan).cast("bigint").alias("n"))
        levels.append(work.table(parents, f"{name}-{len(levels)}"))
        most = -(-most // fan)
    return Tree(levels, fan)


_STEPS = "array<struct<left: string, right: string>>"


def proofs(built: Tree, above: DataFrame) -> DataFrame:
    """Lowest nodes with `steps`, the siblings left and right of the path from level to level, and what `above` says of their group.

    `above` has g, steps (those above the group's root) and any columns that all nodes of the group are to have.
    """
    carried = [c for c in above.columns if c not in ("g", "steps")]
    down = None
    for level in reversed(built.levels):
        own = level.where("n = 1").join(above, "g")
        if down is not None:
            parents = down.select("g", F.col("place").alias("up"), F.col("steps").alias("later"), *carried)
            step = F.array(F.struct("left", "right")).cast(_STEPS)
            inner = _runs(level, built.fan).join(parents, ["g", "up"]).withColumn("steps", F.concat(step, "later"))
            own = own.select(*level.columns, "steps", *carried).unionByName(inner.select(*level.columns, "steps", *carried))
        down = own
    return down


def folded(value: Column, steps: Column) -> Column:
    """The root that a digest and its proof lead to."""
    return F.aggregate(steps, value, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", also: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """A row for each row of `docs`: its key, leaf, subroot (of its group), root (of all), and steps, the proof that leads from leaf to root.

    `also` adds columns computed from a row, such as the leaf of a later copy of it.
    """
    work, also = Workspace(docs.sparkSession, "merkle"), also or {}
    name = F.col(group).cast("string")
    rows = docs.select(F.when(name.isNull(), "").otherwise(F.concat(F.lit("g"), name)).alias("g"), F.col(key).alias("key"), leaf([F.col(c) for c in fields]).alias("digest"), *[v.alias(f"__{k}") for k, v in also.items()])
    # the last key parts equal rows, which are then spread like others
    held = work.table(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = work.table(numbered(work, held, "g", ["key", "digest", "row"], "ranges").drop("row"), "level-0")
    inner = tree(work, placed, "level", fan)
    roots = inner.roots.select(F.col("g").alias("name"), "digest", F.lit("").alias("g"))
    groups = work.table(numbered(work, roots, "g", ["name"], "roots"), "groups")
    outer = tree(work, groups, "top", fan)
    root = outer.roots.select("g", F.col("digest").alias("root")).withColumn("steps", F.array().cast(_STEPS))
    above = proofs(outer, root).select(F.col("name").alias("g"), "steps", F.col("digest").alias("subroot"), "root")
    out = proofs(inner, work.table(above, "above"))
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "steps", *[F.col(f"__{k}").alias(k) for k in also])


def manifest_query(docs: DataFrame) -> DataFrame:
    """The manifest of all documents, checked against a copy in which every document of an even crc32 lost its line feeds."""
    ours = docs.select(*FIELDS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = manifest(ours, also={"seen": leaf([text if c == "text" else F.col(c) for c in FIELDS])})
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), folded(F.col("seen"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


_LEVELS = """{name}(l, g, i, h, n) AS (SELECT 0, * FROM {base} UNION ALL
  SELECT l + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY l, g, i // 3)"""
#: crc32 of a text's bytes: the remainder is folded bit by bit.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({t}) + 1), lambda k: ascii({t}[k])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(1, 9)), lambda r, s: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS t FROM documents),
e AS (SELECT doc_id, coalesce('g' || source, '') AS g, {_leaf_sql('text')} AS leaf, coalesce({_CRC.format(t='t')} % 2 = 1, FALSE) AS even, {_leaf_sql("replace(text, chr(10), '')")} AS cut FROM d),
p AS (SELECT row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, * FROM e),
base AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p),
{_LEVELS.format(name='inner_', base='base')},
s AS (SELECT '' AS k, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g FROM inner_ WHERE n = 1),
top AS (SELECT k, i, h, n FROM s),
{_LEVELS.format(name='outer_', base='top')},
f AS (SELECT l, g, i AS me, i // 3 AS run, h FROM inner_ WHERE n > 1), o AS (SELECT l, i AS me, i // 3 AS run, h FROM outer_ WHERE n > 1),
path(g, i, leaf, even, doc_id, l, place, sides, h, inside) AS (
  SELECT p.g, p.i, leaf, even, doc_id, 0, p.i, '', CASE WHEN even THEN cut ELSE leaf END, TRUE FROM p
  UNION ALL SELECT path.g, path.i, leaf, even, doc_id, CASE WHEN x.n = 1 THEN 0 ELSE path.l + 1 END, CASE WHEN x.n = 1 THEN s.i ELSE place // 3 END,
    sides || CASE WHEN x.n = 1 THEN '' ELSE coalesce(b.v, '') || coalesce(a.v, '') END, CASE WHEN x.n = 1 THEN path.h ELSE sha256(coalesce(b.v, '') || path.h || coalesce(a.v, '')) END, x.n > 1
  FROM path JOIN inner_ x ON inside AND x.l = path.l AND x.g = path.g AND x.i = place JOIN s ON s.g = path.g
  LEFT JOIN (SELECT y.l, y.g, y.me, string_agg(z.h, '' ORDER BY z.me) AS v FROM f y JOIN f z ON y.l = z.l AND y.g = z.g AND y.run = z.run AND z.me < y.me GROUP BY ALL) b ON b.l = path.l AND b.g = path.g AND b.me = place
  LEFT JOIN (SELECT y.l, y.g, y.me, string_agg(z.h, '' ORDER BY z.me) AS v FROM f y JOIN f z ON y.l = z.l AND y.g = z.g AND y.run = z.run AND z.me > y.me GROUP BY ALL) a ON a.l = path.l AND a.g = path.g AND a.me = place),
up(g, i, leaf, even, doc_id, l, place, sides, h, more) AS (
  SELECT g, i, leaf, even, doc_id, 0, place, sides, h, TRUE FROM path WHERE NOT inside
  UNION ALL SELECT up.g, up.i, leaf, even, doc_id, up.l + 1, place // 3, sides || CASE WHEN x.n = 1 THEN '' ELSE coalesce(b.v, '') || coalesce(a.v, '') END,
    CASE WHEN x.n = 1 THEN up.h ELSE sha256(coalesce(b.v, '') || up.h || coalesce(a.v, '')) END, x.n > 1
  FROM up JOIN outer_ x ON more AND x.l = up.l AND x.i = place
  LEFT JOIN (SELECT y.l, y.me, string_agg(z.h, '' ORDER BY z.me) AS v FROM o y JOIN o z ON y.l = z.l AND y.run = z.run AND z.me < y.me GROUP BY ALL) b ON b.l = up.l AND b.me = place
  LEFT JOIN (SELECT y.l, y.me, string_agg(z.h, '' ORDER BY z.me) AS v FROM o y JOIN o z ON y.l = z.l AND y.run = z.run AND z.me > y.me GROUP BY ALL) a ON a.l = up.l AND a.me = place)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(sides) AS proof_sha256, up.h AS folded_root, up.h = r.h AS verified
FROM up JOIN s ON s.g = up.g, (SELECT h FROM outer_ WHERE n = 1) r WHERE NOT more"""
