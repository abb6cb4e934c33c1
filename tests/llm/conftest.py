from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ba", "ko", "ti", "su", "mé", "la") for b in ("nda", "ro", "sel", "vin", "gu", "ß", "tor")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        word = rng.choice(WORDS)
        out.append(word + (".\n" if k % 17 == 16 else "," if k % 7 == 6 else ""))
    return " ".join(out)


def altered(rng: random.Random, text: str, share: float) -> str:
    return " ".join("new" + str(rng.randrange(999)) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def corpus():
    """Rows with exact and near copies, shared passages and lines, nulls, blanks, a long text, short texts, repeated rows."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(20, 160)) for _ in range(50)]
    texts += [texts[0]] * 3 + [altered(rng, texts[1], s) for s in (0.01, 0.02, 0.03, 0.05, 0.08)] + [texts[2] + " tail"]
    passage = prose(rng, 60)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(4)]
    texts += [prose(rng, 12) + "\nReleased under the MIT License.\n" + prose(rng, 9) for _ in range(6)]
    texts += [f"job {k} ended with status {k * 7} on the host a{k} after all tries had failed and nobody was there to see it\n" + prose(rng, 8) for k in range(6)]
    texts += [None, "", " \n\t", "one", "two words", "two words", "a" * 130, "\u0000odd space \U0001f600 end", "Orre " * 400, prose(rng, 6000)]
    long = " ".join(rng.choice(WORDS) for _ in range(60))
    texts += [f"{prose(rng, 90)}\n{long}\n{prose(rng, 40)}" for _ in range(2)]
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], (None, texts[7], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
