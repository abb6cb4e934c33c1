from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from jobweave.llm import ann, decontamination, packing, sharding, tokens, toxicity
from jobweave.llm.textops import find_words, shingles, slices

from .conftest import DOCS, prose

PATH = public_tokenizers.path(packing.TOKENIZER)


def test_words_and_shingles_equal_plain_python():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB c\t\n\x0b\x1cé.") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, ""]
    for row, stop, data, offsets in slices(pa.array(texts), 500):
        words = find_words(data, offsets)
        values, bounds = shingles(words)
        for k in range(stop - row):
            own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), texts[row + k] or ""))
            assert words.bounds[k + 1] - words.bounds[k] == len(own)
            sets = {tuple(own[j : j + 5]) for j in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())
            assert bounds[k + 1] - bounds[k] == len(sets)
    a, b = (shingles(find_words(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0] for t in (b"A b c d e f", b"x b C d e f g"))
    assert len(np.intersect1d(a, b)) == 1


def test_long_words_that_a_polynomial_confuses_differ():
    """Thue-Morse words have equal polynomial hashes modulo 2**64, whatever the base."""
    a, b = b"", b""
    for k in range(1024):
        odd = bin(k).count("1") % 2
        a, b = a + (b"x" if odd else b"y"), b + (b"y" if odd else b"x")
    words = find_words(np.frombuffer(a + b" " + b + b" " + a, np.uint8), np.array([0, 3 * 1024 + 2]))
    assert words.hash[0] != words.hash[1] and words.hash[0] == words.hash[2]
    own = tokens.ChunkEncoder(PATH)
    whole = Tokenizer.from_file(PATH)
    for text in (a, b):
        ids, _ = own.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert list(ids) == whole.encode(text.decode(), add_special_tokens=False).ids


def test_ids_equal_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    own, whole = tokens.ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    pieces = ["the", "The", "don't", "'s", "É", "é", "H̱", "İ", "ΑΣ", "...", "!!", ",", "a,b", "x.", "12", " ", "\n", " ", "\x1c", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "\U0001f600", "ſ", "K"]
    for _ in range(120):
        texts = ["".join(rng.choice(pieces) + rng.choice(("", " ")) for _ in range(rng.randrange(0, 25))) for _ in range(6)]
        raw = [t.encode() for t in texts]
        ids, bounds = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
        for k, t in enumerate(texts):
            assert list(ids[bounds[k] : bounds[k + 1]]) == [*whole.encode(t, add_special_tokens=False).ids, 2]


def test_packing(documents, corpus, none):
    whole = Tokenizer.from_file(PATH)
    wanted = Counter()
    out = packing.packing_query(documents.withColumns({"start": F.lit("x"), "ids": F.lit(1)})).toPandas()
    assert (out.groupby("sequence_id").length.sum() <= 4096).all()
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    for i, t, *_ in corpus:
        wanted[i] += len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    assert dict(out.assign(doc_id=out.doc_id.fillna(-1)).groupby("doc_id").length.sum()) == {-1 if i is None else i: n for i, n in wanted.items()}
    texts = {i: t for i, t, *_ in corpus if i is not None}
    for r in out[out.doc_id.notna()].itertuples():
        ids = np.array([*whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    assert packing.packing_query(none).collect() == []


def test_bins_keep_all_limits_and_lose_nothing():
    rng = np.random.default_rng(2)
    limits = packing.Limits(tokens=100, segments=4, loss=60, pool=20, cut_from=10)
    sizes = rng.integers(1, 260, 300)
    losses = (sizes * rng.random(300)).astype(int)
    packer = packing.Packer(limits)
    bins = [b for k in range(0, 300, 30) for b in packer.add(list(range(k, k + 30)), sizes[k : k + 30].copy(), losses[k : k + 30].copy())] + list(packer.rest())
    placed = {}
    for b in bins:
        assert sum(n for *_, n in b) <= 100 and len(b) <= 4
        for key, start, n in b:
            placed.setdefault(key, []).append((start, n))
    for key, pieces in placed.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
        assert at == sizes[key]
    assert len(placed) == 300


def test_conversations_are_packed_under_all_limits(spark):
    rng = random.Random(7)
    rows = [(c, t, "assistant" if t % 2 else "user", prose(rng, rng.randrange(1, 40))) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(99, 0, "user", "q"), (99, 1, "assistant", prose(rng, 900)), (100, 0, None, None), (101, None, "assistant", ""), (None, 0, "user", "x")]
    limits = packing.Limits(tokens=300, segments=3, loss=120)
    out = packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), limits=limits).toPandas()
    bins = out.groupby("sequence_id")
    assert (bins.length.sum() <= 300).all() and (bins.n_loss.sum() <= 120).all() and (bins.size() <= 3).all()
    whole, wanted = Tokenizer.from_file(PATH), {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0)):
        n = len(whole.encode(text or "", add_special_tokens=False).ids) + 1
        a, b = wanted.get(-1 if c is None else c, (0, 0))
        wanted[-1 if c is None else c] = (a + n, b + n * (role == "assistant"))
    got = out.assign(conv_id=out.conv_id.fillna(-1)).groupby("conv_id")
    assert {c: (x.length.sum(), x.n_loss.sum()) for c, x in got} == wanted
    assert (got.size().drop(99) == 1).sum() >= 55 and got.size()[99] > 3


def check_shards(rows, n):
    t = pd.DataFrame([r.asDict() for r in rows])
    assert len(t) == n
    groups = t.groupby("shard").slot
    assert (groups.max() + 1 == groups.size()).all() and (groups.nunique() == groups.size()).all()
    return t


def test_sharding(documents, corpus, none):
    t = check_shards(sharding.sharding_query(documents.withColumns({"size": F.lit("x"), "shard": F.lit("y")})).collect(), len(corpus))
    assert set(t.law) == {"bytes"} and t.grown_shard.isna().all() and t["shard"].between(0, 15).all()
    assert sorted(t["size"]) == sorted(len((r[1] or "").encode()) + 1 for r in corpus)
    assert set(t.text_crc32) == {zlib.crc32((r[1] or "").encode()) for r in corpus}
    assert sharding.sharding_query(none).collect() == []


def test_a_group_of_equal_texts_is_split_and_shards_are_equal(spark):
    rng = random.Random(1)
    rows = [(k, "hot text " * 20 if k % 3 == 0 else prose(rng, rng.randrange(1, 60)), None, None, None) for k in range(3000)]
    plan = sharding.ShardingPlan(partition_bytes=4000)
    t = check_shards(sharding.sharding_query(spark.createDataFrame(rows, DOCS).repartition(5), plan).collect(), 3000)
    sizes = t.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() < 1500
    one = check_shards(sharding.sharding_query(spark.createDataFrame([(k, "same", None, None, None) for k in range(160)], DOCS)).collect(), 160)
    assert set(one.groupby("shard").size()) == {10}


def test_shards_equal_those_of_a_plain_splitter(spark):
    import xxhash

    rng = random.Random(2)
    rows = [(k if k % 50 else None, prose(rng, rng.randrange(1, 80)) if k % 4 else rng.choice(["hot", "warm " * 30, "", None]), None, None, None) for k in range(1200)]
    rows[7] = (7, "long " * 30_000, None, None, None)
    t = check_shards(sharding.sharding_query(spark.createDataFrame(rows, DOCS).repartition(4)).collect(), 1200)

    def place(row):
        h = xxhash.xxh64((row[1] or "").encode(), seed=42).intdigest()
        return h - 2**64 if h >= 2**63 else h, -(2**63) if row[0] is None else row[0]

    size = lambda row: len((row[1] or "").encode()) + 1
    ordered = sorted(rows, key=place)
    got = t.sort_values(["shard", "slot"])
    # one order over all shards; equal places may come in any order
    assert [place(r) for r in ordered] == sorted(place(r) for r in rows) and list(got["size"])[:3] != []
    at = {}
    for r in ordered:
        at.setdefault((place(r)[1], zlib.crc32((r[1] or "").encode())), []).append(place(r))
    seen = [at[-(2**63) if i != i or i is None else int(i), c][0] for i, c in zip(got["doc_id"], got["text_crc32"], strict=True)]
    assert seen == sorted(seen)
    # every border is as near to its share of the bytes as the keys allow, or within the tolerance
    total, edges, groups = sum(map(size, rows)), [0], {}
    for r in ordered:
        groups[place(r)] = groups.get(place(r), 0) + size(r)
    for key in sorted(groups):
        edges.append(edges[-1] + groups[key])
    held = t.groupby("shard")["size"].sum().reindex(range(16), fill_value=0).cumsum()
    slack = sharding.ShardingPlan().tolerance * total / 16
    for s in range(15):
        want = total * (s + 1) / 16
        assert held[s] in edges and abs(held[s] - want) <= max(slack, min(abs(e - want) for e in edges)) + 1e-9


ITEMS = "item_id long, text string"


def contained(documents, items):
    def sets(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())

    out = set()
    for i, t in documents:
        for j, u in items:
            a, b = sets(t), sets(u)
            if len(min(b, default=())) < 5:
                words = lambda x: " " + " ".join(re.split(r"[\x20\x09-\x0D]+", x.lower())).strip() + " "
                if b and words(u) in words(t or ""):
                    out.add((i, j, 1, 1))
            elif b and 100 * len(a & b) >= 75 * len(b):
                out.add((i, j, len(b), len(a & b)))
    return out


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_containment_equals_all_pairs(spark, documents, corpus, broadcast):
    rng = random.Random(9)
    words = corpus[84][1].split(" ")
    items = [(0, " ".join(words[100:160])), (1, " ".join(words[900:1100])), (2, prose(rng, 40)), (3, None), (4, ""), (5, "one"), (8, "two words"), (9, "MIT\tlicense."), (6, " ".join(corpus[3][1].split(" ")[:18] + ["other"] * 4)), (7, " ".join(corpus[4][1].split(" ")[:9] + ["other"] * 30)), (0, " ".join(words[100:160]))]
    plan = decontamination.ContainmentPlan(broadcast_bytes=broadcast)
    benchmark = spark.createDataFrame(items, ITEMS)
    got = decontamination.decontamination_query(documents.withColumns({"item_id": F.lit("x"), "shingle": F.lit(1), "hits": F.lit(2)}), benchmark, plan).collect()
    wanted = contained([(r[0], r[1]) for r in corpus], items)
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got} == wanted and len(wanted) >= 4 and len(got) == len(wanted)
    clean = decontamination.without_benchmark(documents, benchmark, plan)
    assert clean.columns == documents.columns and clean.count() == len(corpus) - sum(1 for r in corpus if r[0] in {w[0] for w in wanted})


def test_containment_of_nothing(spark, documents, none, corpus):
    empty = spark.createDataFrame([], ITEMS)
    assert decontamination.decontamination_query(documents, empty).collect() == [] and decontamination.without_benchmark(documents, empty).count() == len(corpus)
    assert decontamination.without_benchmark(none, empty).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int"


def exact(x, ids, k):
    rows = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
        own = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        rows += [(ids[q], r + 1, ids[j], score[j]) for r, j in enumerate(own)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 16))).astype(np.float32)
    x[1000:2300] = x[7]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    plan = ann.SearchPlan(part_rows=250, sample=2000, block_bytes=300 * 128, query_bytes=20 * 128)
    out = ann.ann_query(spark.createDataFrame(rows, VECTORS).repartition(4), plan).toPandas()
    wanted = exact(x.astype(float), np.arange(4000), 5)
    assert len(out) == len(wanted) and ann.recall(out, wanted) >= 0.9
    both = out.merge(wanted, on=["query_id", "vec_id"])
    assert np.allclose(both.score_x, both.score_y, rtol=0, atol=1e-15)
    hot = out[out.query_id == 1000].sort_values("rank")
    assert list(hot.vec_id) == [7, 1001, 1002, 1003, 1004]


def test_two_levels_of_parts(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 12))
    x = (centres[rng.integers(0, 60, 6000)] + 0.5 * rng.normal(size=(6000, 12))).astype(np.float32)
    plan = ann.SearchPlan(part_rows=100, fan=8, sample=1500, epochs=20)
    assert plan.levels(6000) == (8, 8) and ann.SearchPlan().levels(500) == (64, 1) and ann.SearchPlan().levels(10**9) == (128, 128)
    out = ann.ann_query(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], VECTORS), plan).toPandas()
    wanted = exact(x.astype(float), np.arange(6000), 5)
    assert len(out) == len(wanted) and ann.recall(out, wanted) >= 0.9


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables_is_measured_through_the_router(spark, size):
    rows = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    t = rows.toPandas().sort_values("vec_id")
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float)
    assert ann.SearchPlan().levels(len(ids))[0] == 64
    out = ann.ann_query(rows).toPandas()
    assert ann.recall(out, exact(x, ids, 5)) >= 0.9 and out.compared.max() <= len(ids)
    assert out.compared.mean() <= 0.4 * len(ids)  # these vectors have no clusters, and the network saw all of them


def test_vectors_that_no_network_saw_keep_their_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 16))
    x = (centres[rng.integers(0, 300, 8000)] + 0.5 * rng.normal(size=(8000, 16))).astype(np.float32)
    plan = ann.SearchPlan(part_rows=63, sample=1500, epochs=60)
    assert plan.levels(8000) == (128, 1)
    out = ann.ann_query(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], VECTORS), plan).toPandas()
    assert ann.recall(out, exact(x.astype(float), np.arange(8000), 5)) >= 0.9
    assert out.compared.mean() <= 0.4 * 8000


def test_the_mass_is_the_least_that_reaches_the_recall():
    rng = np.random.default_rng(6)
    x = ann.unit(rng.normal(size=(900, 12)))
    plan = ann.SearchPlan(epochs=30, least_probes=1)
    routers = ann.Routers(ann.fit(x, 32, plan), {}, 1)
    part = routers.part(x)
    sizes = {int(p): int(n) for p, n in zip(*np.unique(part, return_counts=True), strict=True)}
    mass = ann.wanted_mass(routers, x[:200], x, part, np.arange(200), sizes, plan)

    def found(mass):
        rows, parts = ann.probes(routers, x[:200], sizes, mass, plan)
        met = [set(parts[rows == q].tolist()) for q in range(200)]
        near = x[:200] @ x.T
        near[np.arange(200), np.arange(200)] = -2
        return np.mean([part[j] in met[q] for q in range(200) for j in np.argsort(-near[q])[:5]])

    assert found(mass) >= plan.recall > found(mass - 0.05)


def test_search_leaves_out_what_is_no_vector(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (50, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, None], 1), (6, [1.0], 1), (None, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (7, [2.0, 0.0], 1), (100, [-1.0, 0.0], None)]
    got = ann.ann_query(spark.createDataFrame(rows, VECTORS).withColumn("part", F.lit("x"))).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [(0, 1, 7), (0, 2, 7), (0, 3, 1), (0, 4, 100), (100, 1, 1), (100, 2, 0), (100, 3, 7), (100, 4, 7)]
    assert ann.ann_query(spark.createDataFrame([], VECTORS)).collect() == []
    assert ann.ann_query(spark.createDataFrame([(0, [1.0], 1)], VECTORS)).collect() == []


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(300, 8))
    sizes = np.bincount(ann.balanced_parts(ann.neighbour_graph(ann.unit(x), 6), 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2


def test_pipeline(spark, tmp_path, corpus):
    rng = random.Random(12)
    rows = [r for r in corpus if r[0] is not None]
    bad = [(1000 + k, prose(rng, 20) + " foulbag scumlord " + prose(rng, 20), "en", "s", 0) for k in range(60)]
    labels = [(r[0], 1, 0) for r in rows] + [(b[0], 1, 1) for b in bad]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows + bad, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = " ".join(corpus[84][1].split(" ")[100:160])
    spark.createDataFrame([(1, item)], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert k == 4 or docs.columns == names
        seen.append(docs.count())
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert seen[1] <= seen[0] - 50 and seen[3] < seen[2] and seen[4] == seen[3] - 1
    assert 84 not in ids and 0 in ids and not ids & {50, 51, 52} and {20, 21, 22} <= ids
    assert toxicity.PLAN.label == "toxic" and corpus_pipeline.run(spark, folder).count() == seen[5]
