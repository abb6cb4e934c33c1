from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.llm import crf, linear, pii, quality, toxicity

from .conftest import DOCS, prose

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts with labels: shouting is poor, some words are toxic; odd labels and ids among them."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        poor, toxic = k % 3 == 0, k % 4 == 0
        text = prose(rng, rng.randrange(15, 90))
        if toxic:
            words = text.split(" ")
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(("scumlord", "wretchling", "foulbag")) + rng.choice(("", "s", ",")))
            text = " ".join(words)
        rows.append((k, text.upper().replace(" ", "!! ") if poor else text, "en", "s", 0))
        labels.append((k, int(not poor), int(toxic)))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "x y", None, None, None), rows[3]]
    labels += [(900, None, None), (902, 7, 7), (None, 1, 1), labels[3]]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), len(rows)


@pytest.mark.parametrize(("module", "query", "label", "folds", "fold"), [(quality, quality.quality_query, "quality", 4, 2), (toxicity, toxicity.toxicity_query, "toxic", 3, 1)])
def test_classifiers_hold_on_the_fold_they_never_saw(labelled, module, query, label, folds, fold):
    documents, labels, n = labelled
    plan = linear.TrainingPlan(**{**module.PLAN.__dict__, "l1": 0.5})
    out = query(documents.withColumns({"score": F.lit("clash"), "held_out": F.lit(9)}), labels, plan).collect()
    assert len(out) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in out if r["doc_id"] is not None)
    truth = {r["doc_id"]: r[label] for r in labels.where("doc_id < 400").collect()}
    unseen = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.93
    by_id = {r["doc_id"]: r["score"] for r in out}
    assert by_id[900] == by_id[901]


def test_labels_of_the_held_out_fold_are_never_learned(labelled):
    documents, labels, _ = labelled
    plan = toxicity.PLAN
    flipped = labels.withColumn("toxic", F.when(linear.held_out(plan), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(documents, labels, plan), toxicity.fit(documents, flipped, plan)
    assert np.array_equal(a.at, b.at) and np.array_equal(a.w, b.w) and a.pairs == b.pairs


def test_no_labels_no_opinion(labelled, none):
    documents, labels, _ = labelled
    out = quality.quality_query(documents, labels.limit(0)).collect()
    assert {r["score"] for r in out} == {0.5}
    assert quality.quality_query(none, labels).collect() == [] and toxicity.without_toxic(none, labels).columns == none.columns


def test_toxic_documents_go_and_columns_stay(labelled):
    documents, labels, n = labelled
    kept = toxicity.without_toxic(documents.withColumn("score", F.lit("mine")), labels, linear.TrainingPlan(**{**toxicity.PLAN.__dict__, "l1": 0.5}))
    assert kept.columns == [*documents.columns, "score"] and 280 < kept.count() < 330 and kept.first()["score"] == "mine"


def test_counterfactual_pairs_take_the_weight_off_identity_terms():
    rng = random.Random(2)
    rows = []
    for k in range(300):
        toxic = k % 2
        group = rng.choice(("women", "men", "girls", "boys")) if not toxic or rng.random() < 0.2 else "women"
        rows.append((f"{prose(rng, 8)} {group} {'foulbag' if toxic else prose(rng, 1)} {prose(rng, 8)}".encode(), toxic))

    def named(pairing):
        plan = linear.TrainingPlan(**{**toxicity.PLAN.__dict__, "l1": 0.2, "pairing": pairing})
        model = linear.fit(rows, plan, toxicity.features, toxicity.swapped if pairing else None)
        table = np.zeros(1 << 24)
        table[model.at] = model.w
        assert (model.texts, model.pairs > 200) == (300, bool(pairing))
        score = lambda t: table[toxicity.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]].sum()
        return score(b"about women here") - score(b"about men here"), score(b"about men foulbag") - score(b"about men here")

    free, paired = named(0.0), named(8.0)
    assert abs(paired[0]) < 0.6 * abs(free[0]) and paired[1] > 1.0


def test_terms_of_the_corpus_are_learned_where_its_languages_name_no_known_group(labelled):
    documents, labels, _ = labelled
    folk = F.element_at(F.array(*[F.lit(f" of the {a}vari") for a in "bcdfghklm"]), (F.coalesce("doc_id", F.lit(0)) % 9 + 1).cast("int"))
    documents = documents.withColumn("text", F.concat("text", folk))
    rows = [((r["text"] or "").encode(), r["toxic"]) for r in documents.join(labels, "doc_id").where("toxic in (0, 1)").collect()]
    kinds = toxicity.neutral_kinds(rows, 24)
    terms = {t for kind in kinds for t in kind}
    assert "bvari" in terms and not any(w.startswith(("scumlord", "wretchling", "foulbag")) for w in terms) and all(len(kind) > 1 for kind in kinds)
    plan = linear.TrainingPlan(**{**toxicity.PLAN.__dict__, "l1": 0.5})
    assert toxicity.fit(documents, labels, plan).pairs > 50 and toxicity.fit(documents, labels, plan, terms=(), learned=0).pairs == 0
    given = (("bando", "bandor", "kosel"),)
    assert toxicity.fit(documents.withColumn("text", F.concat("text", F.lit(" bando"))), labels, plan, terms=given, learned=0).pairs > 200


def test_pairs_keep_swapped_documents_of_the_held_out_fold_in_place(spark):
    """On the shared tables: without pairs a swap of neutral words moves a score that it should not."""
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = documents.join(labels, "doc_id").where("toxic in (0, 1)").select("text", "toxic", linear.held_out(toxicity.PLAN).alias("out")).orderBy("doc_id").collect()
    seen = [((r["text"] or "").encode(), r["toxic"]) for r in rows if not r["out"]]
    swap = toxicity.Swap([*toxicity.IDENTITY_TERMS, *toxicity.neutral_kinds(seen)])
    both = [(t, o) for k, t in enumerate((r["text"] or "").encode() for r in rows if r["out"]) if (o := swap(t, k)) is not None]
    moved = {}
    for pairing in (0.0, 1.0):
        model = linear.fit(seen, linear.TrainingPlan(**{**toxicity.PLAN.__dict__, "pairing": pairing}), toxicity.features, swap if pairing else None)
        table = np.zeros(1 << toxicity.PLAN.bits)
        table[model.at] = model.w

        def logit(text, table=table):
            at, x, _ = toxicity.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            return table[at] @ x

        moved[pairing] = np.mean([abs(logit(t) - logit(o)) for t, o in both])
    assert len(both) > 20 and moved[1.0] < moved[0.0] / 5


def test_training_equals_plain_follow_the_regularised_leader():
    """The same updates, feature by feature in dictionaries."""
    rng = random.Random(5)
    rows = [((prose(rng, 12) + (" foulbag" if k % 2 else "")).encode(), k % 2) for k in range(60)]
    for module in (quality, toxicity):
        plan = linear.TrainingPlan(**{**module.PLAN.__dict__, "l1": 0.3, "epochs": 2, "pairing": 0.0})
        z, n = {}, {}

        def weight(i):
            if abs(z.get(i, 0.0)) <= plan.l1:
                return 0.0
            return -(z[i] - np.sign(z[i]) * plan.l1) / ((plan.beta + n[i] ** 0.5) / plan.alpha + plan.l2)

        order = np.random.Generator(np.random.PCG64(1))
        for _ in range(plan.epochs):
            for k in order.permutation(len(rows)):
                text, y = rows[k]
                at, x, _ = module.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                own = {int(i): float(np.float32(v)) for i, v in zip(at, x)}
                w = {i: weight(i) for i in own}
                p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in own.items())))
                for i, v in own.items():
                    g = (p - y) * v
                    z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / plan.alpha * w[i]
                    n[i] = n.get(i, 0.0) + g * g
        model = linear.fit(rows, plan, module.features)
        wanted = {i: weight(i) for i in z if abs(z[i]) > plan.l1}
        assert set(model.at.tolist()) == set(wanted) and np.allclose(model.w, [wanted[i] for i in model.at.tolist()], atol=1e-5)


@pytest.mark.parametrize(("module", "query"), [(quality, quality.quality_query), (toxicity, toxicity.toxicity_query)])
def test_scores_equal_plain_sums_over_whole_texts(spark, labelled, none, module, query):
    documents, labels, _ = labelled
    rng = random.Random(4)
    long = prose(rng, 150_000) + " foulbag scumlord"
    rows = documents.unionByName(spark.createDataFrame([(990, long, None, None, None)], DOCS))
    plan = linear.TrainingPlan(**{**module.PLAN.__dict__, "l1": 0.5})
    model = module.fit(rows, labels, plan)
    weights = dict(zip(model.at.tolist(), np.float32(model.w).tolist(), strict=True))
    got = query(rows, labels, plan).join(rows.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == rows.where("doc_id IS NOT NULL").count()
    for r in got:
        text = np.frombuffer((r["text"] or "").encode(), np.uint8)
        at, x, _ = module.features(text, np.array([0, len(text)]))
        z = sum(weights.get(i, 0.0) * v for i, v in zip(at.tolist(), x.tolist(), strict=True))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))), abs=1e-5)
    assert query(none, labels).collect() == [] and {r["score"] for r in query(rows, labels.limit(0)).collect()} == {0.5}


def test_the_sample_is_bounded_in_bytes(labelled):
    documents, labels, _ = labelled
    whole = linear.labelled_sample(documents, labels, quality.PLAN).collect()
    small = linear.labelled_sample(documents, labels, linear.TrainingPlan(**{**quality.PLAN.__dict__, "sample_bytes": 5000})).collect()
    own = sorted(whole, key=lambda r: r["place"])[: len(small)]
    assert 0 < len(small) < len(whole) and sum(len(r["text"].encode()) for r in own[:-1]) < 5000 and {r["place"] for r in small} == {r["place"] for r in own}


def test_the_gradient_of_the_field_is_that_of_its_likelihood():
    rng = np.random.default_rng(2)
    sentences = [(rng.integers(0, 6, (n, 2)), rng.integers(0, 3, n)) for n in (1, 4, 2, 7)]
    given, parts = crf.padded(sentences), [rng.normal(size=s) for s in ((6, 3), (3, 3), (3,), (3,))]
    _, grads = crf.likelihood(parts, *given, 0.01)
    for part, grad in zip(parts, grads, strict=True):
        for place in np.ndindex(part.shape):
            held, ends = part[place], []
            for move in (1e-5, -1e-5):
                part[place] = held + move
                ends.append(crf.likelihood(parts, *given, 0.01)[0])
            part[place] = held
            assert grad[place] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)


def test_pii_query_equals_the_patterns_on_whole_texts(spark):
    rng = random.Random(13)
    pieces = ["4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "+1 (243) 555-5526", "a.b@c.org", "x@y.zz,", "é", "word", "\n", "12", "+4912345678901", "4111111111111112"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))) for _ in range(150)] + [" ".join(rng.choice(pieces) for _ in range(40_000))]
    rows = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS).repartition(3)
    for r in pii.pii_query(rows).collect():
        spans = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{kind}"] for kind in PATTERNS] == [sum(x[2] == kind for x in spans) for kind in PATTERNS]
        said = [f"{kind}:{a}:{b}" for a, b, kind in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r["spans"].split(",")) | {""} and r["n_spans"] >= len(said)


def test_swaps():
    assert toxicity.swapped(b"no group is named", 0) is None
    out = toxicity.swapped("Die Women of womenfolk and Jews é".encode(), 3).decode()
    assert "Women " not in out and "womenfolk" in out and "Jews" not in out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (243) 555-5526", "a@b.c", "a@b@c.de", "x.y+z@mail-1.example.com", ".", " ", "-", "@", "é", "5", "00000", "+", "(", "word", "\n", "٣"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text
    long = "9" * 60000 + "a" * 60000
    assert pii.base_spans(long) == []


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_tagger_learns_the_table_and_skips_only_what_is_outside():
    model = pii.tagger()
    hits = total = 0
    for sentence in pii.labelled_table(150, seed=77):
        shape, tags = pii.table_shapes(sentence)
        got = model.tags(shape, np.array([0, len(shape)]))
        hits, total = hits + (got == tags).sum(), total + len(tags)
    assert hits / total > 0.98
    rng = np.random.default_rng(1)
    shape = rng.choice(np.concatenate([np.repeat(np.flatnonzero(model.plain), 30), np.arange(0, pii.SHAPES, 41)]), 4000)
    bounds = np.sort(np.concatenate([[0, 4000], rng.integers(0, 4000, 60)]))
    short = model.tags(shape, bounds)
    assert model.margin_words is not None
    held, model.margin_words = model.margin_words, None
    whole = model.tags(shape, bounds)
    model.margin_words = held
    assert np.array_equal(short, whole)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    chain = crf.Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3))
    e, bounds = rng.normal(size=(14, 3)), np.array([0, 1, 6, 6, 10, 14])
    got = crf.viterbi(chain, e, bounds)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        paths = np.stack(np.meshgrid(*[range(3)] * (b - a), indexing="ij"), -1).reshape(-1, b - a) if b > a else np.zeros((1, 0), int)
        scores = [chain.first[p[0]] + chain.last[p[-1]] + sum(e[a + k, t] for k, t in enumerate(p)) + sum(chain.step[x, y] for x, y in zip(p, p[1:], strict=False)) for p in paths if len(p)]
        if scores:
            assert list(got[a:b]) == list(paths[int(np.argmax(scores))])


def test_pii_query(spark, none):
    secret = "0123456789abcdef" * 2
    texts = [f'é call +1 (243) 555-5526 or a.b@c.org; token = "{secret}" ok', None, "", "plain words only", "ring (243) 555-5526 today", "4111 1111 1111 1111 from 10.0.0.1"]
    rows = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)] + [(None, "x@y.zz", None, None, None)], DOCS)
    got = {r["doc_id"]: r for r in pii.pii_query(rows.withColumn("spans", F.lit(1))).collect()}
    assert got[0]["spans"] == f"phone:7:24,email:28:37,secret:{texts[0].index(secret)}:{texts[0].index(secret) + 32}"
    assert got[0]["base_sha256"] == hashlib.sha256(b"phone:7:24,email:28:37").hexdigest()
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_card"], got[0]["n_phone"]) == (1, 0, 0, 1)
    assert got[1]["spans"] == got[2]["spans"] == got[3]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["spans"] == "phone:5:19" and got[4]["n_phone"] == 0
    assert got[5]["spans"] == "card:0:19,ip:25:33" and got[None]["n_email"] == 1
    assert pii.pii_query(none).collect() == []
