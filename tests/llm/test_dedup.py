from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.llm import linededup, neardup, substrings
from jobweave.llm.suffixarray import kasai, suffix_array

from .conftest import DOCS, altered, prose


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(rows):
    """Smallest doc_id reachable over pairs at the threshold, by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_duplicates_equal_all_pairs(documents, corpus):
    got = neardup.near_duplicates(documents.withColumns({"n": F.lit(1), "rep": F.lit("x"), "component": F.lit(2)})).collect()
    assert len(got) == len(corpus)
    wanted = components([(r[0], r[1]) for r in corpus])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == wanted
    sizes = {r[0]: len(shingle_set(r[1])) for r in corpus}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_of_every_size_at_the_threshold(spark, exact):
    """Pairs just at or above the threshold, from three shingles to thousands; `exact` also finds those that no band would."""
    rng, rows = random.Random(8), []
    for n in (7, 8, 9, 11, 15, 20, 27, 40, 60, 90, 160, 400, 3000):
        for _ in range(4):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            cut = (n - 4) - -(-(n - 4) * 3 // 4)
            rows += [(len(rows), " ".join(words), "", "", 0), (len(rows) + 1, " ".join(words[: n - cut]), "", "", 0)]
    plan = neardup.NearDupPlan(exact=exact) if not exact else neardup.NearDupPlan(bands=1, rows=4, exact=True)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), plan).collect()}
    assert got == {k: k - k % 2 for k in range(len(rows))} == components([(r[0], r[1]) for r in rows])


def test_rows_of_one_id_and_unlike_texts_are_told_apart(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a, "", "", 0), (2, a, "", "", 0), (2, b, "", "", 0), (2, b, "", "", 0), (3, c, "", "", 0), (4, b, "", "", 0), (None, a, "", "", 0), (None, a, "", "", 0)]
    kept = neardup.without_near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("__number", F.lit(1)))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, a), (2, b), (3, c), (None, a), (None, a)], key=repr)


def test_near_duplicates_in_a_crowd_of_alike_texts(spark):
    """Copies of a text that is not there itself: many are alike, some are linked, and chains of links must not break."""
    rng = random.Random(4)
    base = prose(rng, 200)
    rows = [(k, altered(rng, base, 0.02 + 0.0009 * k), "en", "s", 0) for k in range(70)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), neardup.NearDupPlan(block=8, fan_in=4, asking=3)).collect()
    wanted = components([(r[0], r[1]) for r in rows])
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted and 1 < len(set(wanted.values())) < 70


def test_one_of_each_group_stays(documents, none):
    kept = neardup.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id in (0, 50, 51, 52)").collect()) == [0]
    assert kept.where("doc_id = 5").count() == 1 and documents.where("doc_id = 5").count() == 2
    assert neardup.near_duplicates(none).collect() == []


def test_corrected_estimate():
    rng = np.random.default_rng(0)
    plan = neardup.NearDupPlan()
    shared, own = rng.integers(0, 2**63, 3000, dtype=np.uint64), rng.integers(0, 2**63, (2, 1000), dtype=np.uint64)
    a, b = (np.sort(np.concatenate([shared, x])) for x in own)
    regs = neardup.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), plan)
    got = neardup.estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([len(a)]), np.array([len(b)]), plan)[0]
    assert abs(got - 3000 / 5000) < 0.15
    unlike = neardup.sketch(np.concatenate([own[0], own[1]]), np.array([0, 1000, 2000]), plan)
    assert (unlike[0] == unlike[1]).sum() <= 3
    x = np.array([1, 2**63, 2**40 + 12345], np.uint64)
    assert list(neardup.compress(x, 10) >> 10) == [63, 0, 23]
    # small sets: an empty bucket borrows, so registers agree as often as the sets are alike
    gaps = []
    for n in (1, 2, 5, 12, 30, 100):
        shared, own = rng.integers(0, 2**63, (200, n), dtype=np.uint64), rng.integers(0, 2**63, (200, n), dtype=np.uint64)
        first = neardup.sketch(shared.ravel(), np.arange(201) * n, plan)
        second = neardup.sketch(np.concatenate([shared, own], 1).ravel(), np.arange(201) * 2 * n, plan)
        gaps.append(abs((first == second).mean() - 0.5))
    assert max(gaps) < 0.03


def dropped_lines(rows, plan):
    """By comparing all lines: (row, words) of the lines that go. Rows are (doc_id, text)."""
    found, out = defaultdict(set), set()
    for row in rows:
        for line in (row[1] or "").split("\n"):
            words = tuple("*" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(words) >= plan.least_tokens:
                found[words].add(row)
    order = lambda r: (r[0] is None, r[0] or 0)
    for a, own in found.items():
        near = set(own)
        if len(a) > plan.leading:
            for b, others in found.items():
                if len(a) == len(b) and a[: plan.leading] == b[: plan.leading] and sum(x != y for x, y in zip(a, b)) <= len(a) * (100 - plan.similar) // 100:
                    near |= others
        if len(near) >= plan.documents or len(a) > plan.long_tokens and len(own) >= plan.long_documents:
            out |= {(row, a) for row in own - {min(near if len(near) >= plan.documents else own, key=order)}}
    return out


def test_line_dedup_equals_a_comparison_of_all_lines(documents, corpus):
    plan = linededup.TemplatePlan()
    rows = {(i, t) for i, t, *_ in corpus}
    gone, wanted = dropped_lines(rows, plan), {}
    assert any(len(a) > plan.long_tokens for _, a in gone) and any("*" in a for _, a in gone)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if ((i, t), tuple("*" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", x))) not in gone]
        wanted[i, t] = (t if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept))
    out = linededup.drop_recurring_lines(documents.withColumns({"before": F.col("text"), "n_lines": F.lit("clash"), "key": F.lit(1), "row": F.lit(2), "__row": F.lit(3), "__gone": F.lit(4)})).collect()
    assert len(out) == len(corpus) and {(r["__row"], r["__gone"], r["key"]) for r in out} == {(3, 4, 1)}
    assert [r for r in out if (r["text"], r["n_lines"], r["n_dropped"]) != wanted[r["doc_id"], r["before"]]] == []
    own = linededup.without_recurring_lines(documents.withColumn("n_lines", F.lit("mine")))
    assert own.columns[-1] == "n_lines" and {r["n_lines"] for r in own.collect()} == {"mine"}
    kept = linededup.without_recurring_lines(documents)
    assert kept.columns == documents.columns and kept.where("n_chars <> char_length(text) and doc_id is not null and text is not null").count() == 0
    assert linededup.drop_recurring_lines(documents.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_lines_with_several_variable_words_recur(spark, block):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    texts = [f"{prose(rng, 8)}\nShared by {name()} from the office\nposted for {name()} on the board of the town hall by the clerk at {name()} to be read by all who pass" for _ in range(60)]
    texts += [f"Seen at {name()} {name()} {name()} {name()}\nlast of all {name()}" for _ in range(40)]
    texts += [f"Two by {name()} two" for _ in range(3)] + [f"a line that {' '.join(rng.choice(('x', 'y')) for _ in range(9))}" for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    plan = linededup.TemplatePlan(block=block)
    gone = dropped_lines([(i, t) for i, t in enumerate(texts)], plan)
    out = {r["doc_id"]: r for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, DOCS).repartition(3), plan).collect()}
    for i, text in enumerate(texts):
        kept = [x for x in text.split("\n") if ((i, text), tuple(x.split())) not in gone]
        assert out[i]["text"] == "\n".join(kept), i
    assert all("Shared" not in out[i]["text"] and "posted" not in out[i]["text"] for i in range(1, 60)) and "Shared" in out[0]["text"]
    kept = {r["doc_id"]: r["text"] for r in linededup.without_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert all("Shared" not in kept[i] and "posted" not in kept[i] for i in range(1, 60))


def removed(rows, length=50):
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), float("inf") if i is None else i
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, float("inf")), i)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), float("inf") if i is None else i
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < own:
                gone[k : k + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_substrings_equal_brute_force(documents, corpus, small):
    plan = substrings.SubstringPlan(anchors_per_bucket=300, anchors_per_window=200, stretch_bytes=4000, shard_bytes=900) if small else substrings.SubstringPlan()
    got = substrings.remove_repeats(documents.withColumns({"id": F.lit("x"), "k1": F.lit(0)}), plan).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == removed([(r[0], r[1]) for r in corpus])


def test_substrings_of_nothing(none):
    assert substrings.substring_query(none).collect() == []


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for n, letters in ((0, 2), (1, 2), (49, 1), (900, 1), (900, 2), (900, 26)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        if n == 900:
            data[500:620] = data[100:220]
        order, rank = suffix_array(data, 50)
        padded = data.tobytes() + b"\0" * 60
        windows = [padded[k : k + 50] for k in range(n)]
        assert sorted(order.tolist()) == list(range(n)) and all(windows[order[k]] <= windows[order[k + 1]] for k in range(n - 1))
        assert all((windows[i] == windows[j]) == (rank[i] == rank[j]) for i in range(0, n, 7) for j in range(0, n, 11))
        starts = np.arange(0, n, 65)
        lcp = kasai(data, order, starts, np.minimum(starts + 65, n), 50)
        for k in range(1, n):
            i, j = order[k], order[k - 1]
            same = next((m for m in range(50) if max(i, j) + m >= n or data[i + m] != data[j + m]), 50)
            assert lcp[k] == same


def test_small_sets_at_the_threshold_always_share_a_prefix():
    plan, rng = neardup.NearDupPlan(), np.random.default_rng(12)
    for n in range(1, plan.small + 1):
        for m in range(-(-n * 75 // 100), n + 1):
            # the least overlap of sets of n and m that reaches the threshold
            shared = next(i for i in range(1, m + 1) if 100 * i >= 75 * (n + m - i)) if 100 * m >= 75 * n else None
            if shared is None:
                continue
            pairs = 40
            whole = rng.integers(0, 2**63, (pairs, n + m - shared), dtype=np.uint64)
            sets = [np.sort(x, axis=1) for x in (whole[:, :n], whole[:, n - shared :])]
            keys = [neardup.prefixes(x.ravel(), np.arange(pairs + 1) * x.shape[1], plan) for x in sets]
            for k in range(pairs):
                a, b = (v[e[k] : e[k + 1]] for v, e in keys)
                assert np.intersect1d(a, b).size, (n, m)


def test_a_pair_that_shares_no_band_is_linked(spark):
    text = "note on this small x323 x166 x201 x123"
    rows = [(4, text), (9, text.rsplit(" ", 1)[0]), (2, "note on other things entirely than this small one")]
    rows += [(100 + k, " ".join(f"w{j}" for j in range(k, k + 9))) for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows) and got[9] == 4


def test_short_texts_equal_all_pairs(spark):
    rng = random.Random(31)
    rows = []
    for k in range(120):
        words = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(4, 40))]
        rows += [(4 * k, " ".join(words)), (4 * k + 1, " ".join(words[:-1])), (4 * k + 2, " ".join(words[1:] + ["z"])), (4 * k + 3, " ".join([*words[: len(words) // 2], "q", *words[len(words) // 2 :]]))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == components(rows)


def test_only_texts_of_pairs_are_shuffled(spark, monkeypatch):
    """Texts that are in no pair are left out before any exchange; the links are those of the plain join."""
    rows = [(k, prose(random.Random(k // 2), 90)) for k in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 0), (3, 2), (4, 2)], "a long, b long")

    def plan():
        out = neardup.verified(pairs, documents, neardup.NearDupPlan())
        return out, out._jdf.queryExecution().optimizedPlan().toString()

    picked, text = plan()
    assert "LeftSemi" in text and neardup.texts_of(documents, pairs.select(F.col("a").alias("doc_id"))).count() == 3
    monkeypatch.setattr(neardup, "SENT_IDS", 2)
    whole, text = plan()
    assert "LeftSemi" not in text
    assert sorted(map(tuple, picked.collect())) == sorted(map(tuple, whole.collect())) == [(1, 0), (3, 2)]
