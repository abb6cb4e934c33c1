from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobweave.llm import chat, collocations, merkle

from .conftest import DOCS, prose

TURNS = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]", "\\", "<", "[", "/s>", "INST]", "<\\s>", "a", "é", "\n", " ", "\U0001f600"]


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# Chat formatting


def odd_texts(n: int, seed: int):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_every_text_and_role_survives_its_grammar():
    grammar = chat.Template().grammar()
    rounds = Counter()
    for role, text in zip(["user", "assistant", "system", "tool", "", "[ROLE]"] * 2000, odd_texts(12000, 3)):
        rendered, turn, k = grammar.render(role.encode(), text.encode())
        (again,), rest = grammar.parse(rendered)
        assert not rest and (again.role.decode(), again.text.decode()) == (role, text)
        assert turn.chars == len(rendered.decode()) and grammar.unescape(rendered.decode()[turn.start : turn.stop].encode()).decode() == text
        rounds[k] += 1
    assert rounds[0] and rounds[1] and not rounds[2]


def test_the_parser_reads_a_stream_cut_anywhere():
    grammar, rng = chat.Template().grammar(), random.Random(4)
    for seed in range(40):
        turns = [(rng.choice(["user", "assistant", "tool"]), t) for t in odd_texts(6, seed)]
        stream = b"".join(grammar.render(r.encode(), t.encode())[0] for r, t in turns)
        read, rest, at = [], b"", 0
        while at < len(stream):
            step = rng.randrange(1, 9)
            found, rest = grammar.parse(rest + stream[at : at + step])
            read, at = read + found, at + step
        assert not rest and [(t.role.decode(), t.text.decode()) for t in read] == turns


@pytest.mark.parametrize("bad", ["text", "[INST]a[INST]", "[/INST]", "[INST]a</s>", "[ROLE]user[TEXT]a[/TEXT]", "[ROLE]x[INST]"])
def test_what_is_not_of_the_language_is_refused(bad):
    with pytest.raises(chat.GrammarError):
        chat.Template().grammar().parse(bad.encode())


@pytest.mark.parametrize("roles", [(("user", "aba", "xx"),), (("user", "<u>", "u>"),), (("user", "<u>", ">>u"),), (("user", "<", "</u>"),), (("user", "<\\>", "</u>"),)])
def test_templates_whose_control_strings_overlap_are_refused(roles):
    with pytest.raises(ValueError):
        chat.Template(roles=roles)


def plain_chat(rows):
    grammar, groups = chat.Template().grammar(), defaultdict(list)
    for conv, turn, role, text in [*rows, *chat.HOSTILE]:
        groups[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        chars = sum(len(grammar.render(r.encode(), t.encode())[0].decode()) for _, r, t in turns)
        out[conv] = (conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), chars)
    return out


def test_chat_equals_a_plain_pass(spark):
    rng, texts = random.Random(8), odd_texts(300, 9)
    rows = [(k // 4, k % 4, rng.choice(["user", "assistant", "system", "tool", None]), t) for k, t in enumerate(texts)]
    rows += [(500, k, "assistant" if k % 2 else "user", f"turn {k} <s> " + "é" * 400) for k in range(600)]  # a third of all rows and more
    rows += [(501, k, "assistant", ("</s> long " * 90_000)) for k in range(3)]  # pieces of a text above their size
    rows += [(None, 0, "user", "nobody"), (None, None, None, None), (-7, 5, "assistant", "more"), (502, 1, "user", "b"), (502, 1, "user", "a"), (502, 1, "assistant", "a"), (502, None, "user", "z")] + [(503, 1, "assistant", "same")] * 3
    extra = ["x", "y", "z", "w"]
    df = spark.createDataFrame([(*r, *extra) for r in rows], TURNS + ", part string, seq string, turns string, formatted string").repartition(5)
    got = {r["conv_id"]: tuple(r) for r in chat.chat_query(df).collect()}
    assert got == plain_chat(rows)


def test_chat_of_an_empty_table_is_the_hostile_conversation(spark):
    (row,) = chat.chat_query(spark.createDataFrame([], TURNS)).collect()
    assert (row["conv_id"], row["n_turns"], row["loss_chars"]) == (-7, 2, len("</s>[INST] ok [/INST]"))


def test_formatted_turns_carry_their_loss_mask(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>é"), (1, 2, "judge", None)]
    out = chat.formatted(spark.createDataFrame(rows, TURNS)).orderBy("turn").collect()
    assert [r["formatted"] for r in out] == ["[INST]hi[/INST]", "<s><\\/s>é</s>", "[ROLE]judge[TEXT][/TEXT]"]
    assert [(r["loss_start"], r["loss_stop"], r["rounds"]) for r in out] == [(None, None, 0), (3, 9, 1), (None, None, 0)]
    assert out[1]["formatted"][3:9] == "<\\/s>é"


# Merkle manifest


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def plain_path(levels, at):
    for level in levels[:-1]:
        run = at // 3 * 3
        yield level[run:at], level[at + 1 : run + 3]
        at //= 3


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: plain_levels([leaf for _, _, leaf, _ in sorted(groups[n], key=lambda g: g[:3])]) for n in names}
    top = plain_levels([trees[n][-1][0] for n in names])
    out = []
    for place, n in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[n], key=lambda g: g[:3])):
            path = [*plain_path(trees[n], at), *plain_path(top, place)]
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            h = plain_leaf((*row[:4], row[4].replace("\n", ""))) if even and row[4] is not None else leaf
            for left, right in path:
                h = sha("".join(left) + h + "".join(right))
            out.append((row[0], leaf, trees[n][-1][0], top[-1][0], sha("".join(x for side in path for part in side for x in part)), h, h == top[-1][0]))
    return out


def docs_of(n: int, sources: int, seed: int):
    rng = random.Random(seed)
    return [(k, f"t {k}\n{rng.random()}", rng.choice(["en", None]), f"s{k % sources}" if k % 3 else "s0", rng.choice([k, None])) for k in range(n)]


def as_fields(rows):
    return [(i, s, lang, n, t) for i, t, lang, s, n in rows]


@pytest.mark.parametrize("n, sources", [(1, 1), (2, 1), (3, 3), (4, 1), (28, 2), (200, 7), (90, 90)])
def test_manifest_equals_a_plain_tree(spark, n, sources):
    rows = docs_of(n, sources, n)
    got = merkle.manifest_query(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(as_fields(rows))))


def test_manifest_of_odd_rows(spark, corpus):
    rows = [*corpus, *[(9, "same\n", "en", "hot", 1)] * 70, (None, "x\n", "en", "hot", 1), (None, "x\n", None, None, None), (3, "", "", "", 0), (7, "ü\n", "en", "Ä", 2), (8, "z" * 300_000 + "\n", "en", "\U0001f600", 2)]
    df = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], DOCS + ", g string, place int, digest string, steps string").repartition(4)
    got = merkle.manifest_query(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(as_fields(rows))))
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_manifest_of_an_empty_table(spark, none):
    assert merkle.manifest_query(none).count() == 0


def test_another_fan_and_a_proof_that_fails(spark):
    df = spark.createDataFrame(docs_of(60, 2, 1), DOCS)
    out = merkle.manifest(df, fan=5, also={"forged": merkle.leaf([F.col("doc_id"), F.lit("forged")])})
    seen = out.select((merkle.folded(F.col("leaf"), F.col("steps")) == F.col("root")).alias("good"), (merkle.folded(F.col("forged"), F.col("steps")) == F.col("root")).alias("bad")).collect()
    assert all(r["good"] and not r["bad"] for r in seen) and len(seen) == 60


# Collocations


def plain_phrases(rows, least, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= counts[p[i:j]]}
        found = []
        for p, a in often.items():
            if p not in gone:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return out


def phrase_rows():
    rng = random.Random(6)
    common = ["new york", "New  York city hall", "a a a", "köln am\trhein", "state of the art thing now"]
    rows = []
    for k in range(260):
        text = prose(rng, rng.randrange(4, 30)).replace(" ", rng.choice([" ", "\t", "  "]), 2)
        rows.append((["en", "de", None, "und", ""][k % 5], text + rng.choice([". ", ", ", " ", "\n"]) + rng.choice(common) + rng.choice(["", "!", "\r\n"]) + " " + rng.choice(common)))
    return rows + [("en", None), ("en", ""), (None, " \t.,"), ("fr", "once " * 4000), ("en", "w" * 200_000), *[("en", "again and again")] * 90]


@pytest.mark.parametrize("ship", [64 << 20, -1], ids=["sent", "joined"])
@pytest.mark.parametrize("least, top", [(5, 2000), (12, 7)])
def test_phrases_equal_plain_counts(spark, ship, least, top):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, word string, n int").repartition(6)
    got = collocations.collocations(df, collocations.PhrasePlan(least=least, top=top, ship_bytes=ship)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows, least, top)) and len(got) > 10


def test_no_phrases_in_an_empty_table(spark, none):
    out = collocations.collocations(none)
    assert out.count() == 0 and dict(out.dtypes)["score"] == "bigint"


def test_scores_pass_64_bits_exactly(spark):
    a, n, left, right = 3_000_000_019, 9_000_000_000_037, 3_000_000_021, 3_000_000_023
    exact = lambda v: F.lit(v).cast("decimal(19,0)")
    score = collocations._div(F.lit(1000).cast("decimal(4,0)") * (exact(a) * exact(n)), exact(left) * exact(right))
    assert spark.range(1).select(score).first()[0] == 1000 * a * n // (left * right)
