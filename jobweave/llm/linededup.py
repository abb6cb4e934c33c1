"""Line dedup by a log-template tree of fixed depth.

A line descends by its token count, then by its leading tokens, to a leaf; words with digits are variable fields from
the start and go down one common branch. In a leaf, lines that agree in enough positions are of one template, whichever
words vary between them and however many: a line recurs if the lines of its leaf that agree with it in at least
`similar` per cent of the positions stand in `documents` documents. A long line (over `long_tokens`) recurs as a whole
from `long_documents` on. A recurring line is dropped everywhere but in the document with the smallest doc_id of those.

The tree is never held in one place. A line's path is a hash; lines are first counted as wholes, by one aggregation with
map-side partial sums, and meet in their leaf as distinct lines, each with as many rows as decide. A leaf of too many
lines is split by fields, of which two lines with so few unlike tokens share one at least; the lines of a field meet in
blocks, so no pair is left out and no task holds a leaf. Keys that hold a large share of all lines are joined by a
broadcast of at most a thousand of them.

Lines end at newlines. Null texts are empty and stay null; blank and short lines stay; equal lines within one document
count once. Rows are told apart by doc_id and text; rows with a null doc_id come last when the first one is sought.
Equal rows are one document and lose the same lines. Columns of the caller named n_lines or n_dropped are replaced by the
operator's (the pipeline's stage keeps them); all others are carried along. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import ODD, find_words, mix, slices
from .workspace import Workspace, arrow_limits, fresh, join_by_key, tidy

_U = np.uint64


@dataclass(frozen=True)
class TemplatePlan:
    documents: int = 5
    least_tokens: int = 3
    leading: int = 2
    #: Percentage of positions in which the lines of a template agree.
    similar: int = 75
    long_tokens: int = 50
    long_documents: int = 2
    #: Lines of one comparison; fewer if they are long (tokens of one comparison).
    block: int = 1024
    block_tokens: int = 1 << 20
    #: About how many lines, in whole blocks, one call compares.
    call_lines: int = 4096

    def unlike(self, n):
        """How many of n tokens may differ."""
        return n * (100 - self.similar) // 100


@dataclass
class Lines:
    """Lines of several texts: byte bounds (start, end without the newline), the text each lies in, hashes of the line and of its leaf, word hashes, and the bounds of each line's words."""

    bounds: np.ndarray
    text: np.ndarray
    key: np.ndarray
    leaf: np.ndarray
    words: np.ndarray
    edges: np.ndarray


def parse(data: np.ndarray, offsets: np.ndarray, plan: TemplatePlan) -> Lines:
    """The lines of the texts that `offsets` cut from `data`. The key is 0 where a line is too short, the leaf where no token may differ."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets[1:], breaks, "right")])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.append(starts[1:] - 1, len(data))
    last = np.append(text[1:] != text[:-1], True)
    ends[last] = offsets[1:][text[last]]
    words = find_words(data, np.append(starts, len(data)), lower=False)
    digits = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
    h = np.where(digits[words.stop] > digits[words.start], ODD[50], words.hash)
    first, stop = words.bounds[:-1], words.bounds[1:]
    counts = stop - first
    # every (word, position) is mixed by itself: a sum of such numbers has no structure that unlike lines could share
    place = np.arange(len(h)) - np.repeat(first, counts)
    sums = np.zeros(len(h) + 1, _U)
    np.cumsum(mix(h + place.astype(_U) * ODD[51]), out=sums[1:])
    size = mix(counts.astype(_U) + _U(1))
    key, leaf = np.zeros((2, len(starts)), _U)
    fits = counts >= plan.least_tokens
    key[fits] = np.maximum(mix(sums[stop[fits]] - sums[first[fits]] + size[fits]), _U(1))
    fits &= (counts > plan.leading) & (plan.unlike(counts) > 0)
    leaf[fits] = np.maximum(mix(sums[first[fits] + plan.leading] - sums[first[fits]] + size[fits] * ODD[56]), _U(1))
    return Lines(np.stack([starts, ends], 1), text, key, leaf, h, words.bounds)


def row_key(documents: DataFrame):
    return F.xxhash64(documents["doc_id"], documents["text"])


def _agreeing(tokens: np.ndarray, key: np.ndarray, role: np.ndarray, members: list[list[tuple]], plan: TemplatePlan) -> Iterator[tuple]:
    """Of one block of lines (tokens: lines x positions), those asked for that agree with others: index, first row, up to `documents` rows.

    Candidates are tried by ascending first row, so the first match is the first row of all; a line is done with enough rows.
    """
    n = tokens.shape[1]
    order = np.array(sorted(range(len(key)), key=lambda i: members[i][0]))
    ask, by = order[role[order] != 1], order[role[order] != 0]
    seen = {int(i): set(members[i][: plan.documents]) for i in ask}
    best: dict[int, tuple] = {}
    step = max(1, min(256, int((plan.block_tokens * 8 / n) ** 0.5)))
    for low in range(0, len(ask), step):
        left = ask[low : low + step]
        for start in range(0, len(by), step):
            some = by[start : start + step]
            near = (tokens[left][:, None, :] == tokens[some][None, :, :]).sum(2) >= n - plan.unlike(n)
            near &= key[left][:, None] != key[some][None, :]
            for i, row in zip(left.tolist(), near):
                for j in some[row]:
                    best[i] = min(best.get(i, members[i][0]), members[j][0])
                    seen[i].update(members[j])
                    if len(seen[i]) >= plan.documents:
                        break
            left = np.array([i for i in left.tolist() if i not in best or len(seen[i]) < plan.documents], np.int64)
            if not len(left):
                break
    for i in best:
        # a smaller row than any candidate's is the line's own
        yield i, min(best[i], members[i][0]), [r for _, r in sorted(seen[i])[: plan.documents]]


def alike(lines: pa.Table, plan: TemplatePlan) -> pa.Table:
    """For the lines asked for (role 0 or 2) that agree with others of their block (role 1 or 2): key, the first row, and up to `documents` rows. A table holds whole blocks, one or many."""
    key, role, block, n = (lines[c].to_numpy() for c in ("key", "role", "block", "n"))
    tokens = lines["tokens"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    order = np.lexsort((n, block))
    starts = np.flatnonzero(np.append(True, (block[order[1:]] != block[order[:-1]]) | (n[order[1:]] != n[order[:-1]])))
    column, out = lines["members"].combine_chunks(), ([], [], [], [])
    edges = np.append(0, np.cumsum(column.value_lengths().to_numpy()))
    ids, rows = (column.flatten().field(c).to_pylist() for c in ("doc_id", "row"))
    for low, high in zip(starts, np.append(starts[1:], len(order)), strict=True):
        own = order[low:high]
        if len(own) < 2:
            continue
        size = int(n[own[0]])
        held = tokens[(ends[own] - size)[:, None] + np.arange(size)]
        if len(own) == 2 and (held[0] == held[1]).sum() < size - plan.unlike(size):
            continue
        members = [list(zip(ids[edges[i] : edges[i + 1]], rows[edges[i] : edges[i + 1]], strict=True)) for i in own]
        for i, first, some in _agreeing(held, key[own], role[own], members, plan):
            for into, value in zip(out, (int(key[own[i]]), *first, some), strict=True):
                into.append(value)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("key", "doc_id", "row", "rows"), out, types, strict=True)})


def similar_lines(rows: DataFrame, found: DataFrame, work: Workspace, plan: TemplatePlan) -> DataFrame:
    """Lines that recur with other words in some positions: key, and the first row of all that agree with the line."""
    lines = found.where("leaf <> 0")
    live = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).where((F.col("n") >= plan.documents) & (F.col("a") < F.col("b")))
    # joins with counts read them from tables: only then does adaptive execution split a hot key;
    # from here on grouped without the leaf, so that a hot leaf is dealt out by its lines
    lines = join_by_key(lines, work.table(live.select("leaf", "n"), "leaves"), ["leaf"]).groupBy("key", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "row").agg(F.min("leaf").alias("leaf"))
    # a line's first rows are enough to tell whether so many documents have it
    lines = lines.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "row"))).where(F.col("k") <= plan.documents)
    lines = work.table(lines.groupBy("key").agg(F.min("leaf").alias("leaf"), F.sort_array(F.collect_list(F.struct("doc_id", "row"))).alias("members")), "lines")
    wanted = lines.select(F.col("members")[0]["row"].alias("__row"), "key").groupBy("__row").agg(F.collect_set("key").alias("__wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in slices(batch.column("text")):
                lines = parse(data, offsets, plan)
                text, own, words, bounds = lines.text, lines.key.view(np.int64), lines.words, lines.edges
                for t, wanted in enumerate(batch.column("__wanted").slice(row, stop - row).to_pylist()):
                    low, high = np.searchsorted(text, [t, t + 1])
                    at = low + np.flatnonzero(np.isin(own[low:high], wanted))
                    at = at[np.unique(own[at], return_index=True)[1]]
                    ends = np.append(0, np.cumsum(bounds[at + 1] - bounds[at])).astype(np.int32)
                    tokens = np.concatenate([words[bounds[i] : bounds[i + 1]] for i in at] or [np.zeros(0, _U)]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))], ["key", "tokens"])

    tokens = rows.select("__row", "text").join(wanted.hint("merge"), "__row").select("text", "__wanted").mapInArrow(tidy(read), "key long, tokens array<long>")
    lines = work.table(lines.join(tokens.groupBy("key").agg(F.first("tokens").alias("tokens")), "key"), "tokens")
    # groups of lines that share a field, found from narrow rows; only lines that can meet enough others are sent whole
    n = F.size("tokens")
    parts = F.floor(n * (100 - plan.similar) / 100).cast("int") + 1
    edge = lambda i: F.floor((n - plan.leading) * i / parts).cast("int") + plan.leading
    fields = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.xxhash64("leaf", i, F.slice("tokens", edge(i) + 1, edge(i + 1) - edge(i))))
    each = lines.select("key", n.alias("n"), F.size("members").alias("held"), F.explode(fields).alias("group"))
    sizes = work.table(each.groupBy("group").agg(F.count("*").alias("m"), F.sum("held").alias("rows")).where("m > 1"), "group_sizes")
    met = work.table(join_by_key(each, sizes, ["group"], "m"), "met")
    enough = met.groupBy("key").agg(F.sum(F.col("rows") - F.col("held")).alias("others"), F.first("held").alias("held")).where(F.col("others") + F.col("held") >= plan.documents)
    block = F.greatest(F.lit(16), F.least(F.lit(plan.block), F.floor(F.lit(plan.block_tokens) / F.col("n"))))
    asks = met.join(enough.select("key"), "key").withColumn("c", F.ceil(F.col("m") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("c")).cast("int"))
    others = F.sequence(F.lit(0), F.col("c") - 1)
    place = lambda a, b, role: F.struct(a.alias("a"), b.alias("b"), F.lit(role).alias("role"))
    asked, asking = F.transform(others, lambda b: place(F.col("own"), b, 0)), F.transform(others, lambda a: place(a, F.col("own"), 1))
    asks = asks.withColumn("at", F.explode(F.when(F.col("c") == 1, F.array(place(F.lit(0), F.lit(0), 2))).otherwise(F.concat(asked, asking))))
    # blocks of a group are dealt anew, many small ones to a task's call
    asks = work.table(asks.select("key", "n", F.xxhash64("group", "at.a", "at.b").alias("block"), "at.role"), "asks")
    calls = -(-asks.count() // plan.call_lines) or 1
    whole = asks.join(lines.select("key", "tokens", "members"), "key").withColumn("call", F.pmod("block", F.lit(calls)))
    pairs = whole.groupBy("call").applyInArrow(lambda t: alike(t, plan), "key long, doc_id long, row long, rows array<long>")
    agreed = pairs.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.size(F.array_distinct(F.flatten(F.collect_set("rows")))).alias("n"))
    return agreed.where(F.col("n") >= plan.documents).select("key", F.col("first.row").alias("first"))


def drop_recurring_lines(documents: DataFrame, plan: TemplatePlan = TemplatePlan()) -> DataFrame:
    """`documents` with recurring lines taken out of text, and n_lines and n_dropped."""
    spark = documents.sparkSession
    arrow_limits(spark)
    work = Workspace(spark, "linededup")
    names = [c for c in documents.columns if c.lower() not in ("n_lines", "n_dropped")]
    row_, gone_ = fresh(names, "__row"), fresh(names, "__gone")
    keyed = documents.select(*names).withColumn(row_, row_key(documents))
    rows = documents.select(row_key(documents).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("__row").to_numpy()
            ids = batch.column("doc_id")
            for row, _, data, offsets in slices(batch.column("text")):
                lines = parse(data, offsets, plan)
                held = np.flatnonzero(lines.key)
                _, once = np.unique(np.stack([lines.text[held].astype(_U), lines.key[held]], 1), axis=0, return_index=True)
                held = held[np.sort(once)]
                at = lines.text[held] + row
                long = np.diff(lines.edges)[held] > plan.long_tokens
                yield pa.RecordBatch.from_arrays([pa.array(lines.key[held].view(np.int64)), ids.take(pa.array(at)), pa.array(own[at]), pa.array(lines.leaf[held].view(np.int64)), pa.array(long)], ["key", "doc_id", "row", "leaf", "long"])

    found = work.table(rows.mapInArrow(tidy(find), "key long, doc_id long, row long, leaf long, long boolean"), "keys")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "row"))
    counted = found.groupBy("key").agg(F.count("*").alias("n"), first.alias("first"), F.first("long").alias("long"))
    whole = counted.where(F.col("n") >= F.when(F.col("long"), min(plan.documents, plan.long_documents)).otherwise(plan.documents))
    recurring = whole.select("key", F.col("first.row").alias("first"), "n")
    if plan.similar < 100:
        # a line that does not recur as a whole stands in few rows
        recurring = recurring.unionByName(similar_lines(rows, found, work, plan).withColumn("n", F.lit(plan.documents).cast("long")))
    # a line goes from every row but the first one of all that decide
    recurring = work.table(recurring.groupBy("key").agg(F.collect_set("first").alias("first"), F.max("n").alias("n")), "recurring")
    gone = join_by_key(found.select("key", "row"), recurring, ["key"]).where((F.size("first") > 1) | ~F.array_contains("first", F.col("row")))
    gone = gone.groupBy("row").agg(F.collect_set("key").alias("keys")).select(F.col("row").alias(row_), F.col("keys").alias(gone_))
    # texts move by their row at every size: what is joined to them grows with the corpus
    joined = keyed.join(gone.hint("merge"), row_, "left").select(*names, gone_)
    schema = documents.select(*names).withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long")).schema
    where = names.index("text")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            touched = batch.column(gone_).is_valid()
            n_lines = pc.add(pc.cast(pc.count_substring(column.fill_null(""), "\n"), pa.int64()), 1)
            n_dropped = np.zeros(batch.num_rows, np.int64)
            at, texts, lists = np.flatnonzero(touched.to_numpy(zero_copy_only=False)), [], batch.column(gone_).filter(touched)
            for row, stop, data, offsets in slices(column.filter(touched)):
                lines = parse(data, offsets, plan)
                gone = lists.slice(row, stop - row)
                owner = np.repeat(np.arange(stop - row), gone.value_lengths().to_numpy())
                # (text, key) pairs as single numbers that both sides share
                mixed = lambda t, k: mix(k + mix(t.astype(_U) + _U(1)))
                cut = (lines.key != 0) & np.isin(mixed(lines.text, lines.key), mixed(owner, gone.flatten().to_numpy().view(_U)))
                n_dropped[at[row:stop]] = np.bincount(lines.text[cut], minlength=stop - row)
                raw, bounds, edges = data.tobytes(), lines.bounds, np.searchsorted(lines.text, np.arange(stop - row + 1))
                texts += [b"\n".join(raw[bounds[i, 0] : bounds[i, 1]] for i in range(a, b) if not cut[i]).decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            arrays = [batch.column(c) for c in names]
            arrays[where] = pc.replace_with_mask(column, touched, pa.array(texts, column.type))
            yield pa.RecordBatch.from_arrays([*arrays, n_lines, pa.array(n_dropped)], [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(tidy(drop), schema)


def line_dedup_query(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, what is left of text, n_lines, n_dropped."""
    return drop_recurring_lines(documents.select("doc_id", "text"))


def without_recurring_lines(documents: DataFrame, plan: TemplatePlan = TemplatePlan()) -> DataFrame:
    """`documents` less recurring lines, with n_chars counted anew; a document of nothing else goes."""
    clash = {c: fresh(documents.columns, f"__{c.lower()}") for c in documents.columns if c.lower() in ("n_lines", "n_dropped")}
    out = drop_recurring_lines(documents.withColumnsRenamed(clash), plan)
    kept = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in documents.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(clash[c]).alias(c) if c in clash else c for c in documents.columns])
