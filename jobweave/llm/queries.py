"""The registered queries of this subpackage, each over its whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, collocations, decontamination, linededup, merkle, neardup, packing, pii, quality, sharding, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_query(_read(spark, sf_dir, "documents"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general packer on instruction data: tokens, segments and the answers' tokens are limited at once."""
    return packing.conversation_query(_read(spark, sf_dir, "conversations"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_query(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_query(_read(spark, sf_dir, "documents"))


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_query(_read(spark, sf_dir, "documents"))


def op9_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_query(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_query(_read(spark, sf_dir, "documents"))


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.ann_query(_read(spark, sf_dir, "embeddings"))


def op11_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_query(_read(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_query(_read(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_classifier, op2_vector_packing, op3_line_templates, op4_toxicity, op5_hyperminhash_neardup, op6_suffix_array_dedup, op7_pii_crf, op8_histogram_sharding, op9_benchmark_containment, op10_learned_partitions, op11_chat_grammar, op12_merkle_manifest, op13_phrase_collocations, conversation_packing)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "[\\x20\\x09-\\x0D]+"

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_BLANKS}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d) c USING (doc_id)"""

_PLAN = linededup.TemplatePlan()
_PATH = " AND ".join(f"a.w[{k + 1}] = b.w[{k + 1}]" for k in range(_PLAN.leading))
LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, list_transform(list_filter(regexp_split_to_array(line, '{_BLANKS}'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS w FROM l),
o AS (SELECT doc_id, pos, w, len(w) AS n, array_to_string(w, ' ') AS key FROM w WHERE len(w) >= {_PLAN.least_tokens}),
k AS (SELECT DISTINCT key, n, w FROM o WHERE n > {_PLAN.leading} AND n * {100 - _PLAN.similar} >= 100),
d AS (SELECT DISTINCT key, n, doc_id FROM o),
p AS (SELECT a.key AS key, b.key AS other FROM k a JOIN k b ON a.n = b.n AND {_PATH}
  WHERE list_sum(list_transform(range(1, a.n + 1), lambda i: CAST(a.w[i] <> b.w[i] AS INTEGER))) <= a.n * {100 - _PLAN.similar} // 100),
r AS (SELECT p.key, min(doc_id) AS first FROM p JOIN d ON d.key = p.other GROUP BY p.key HAVING count(DISTINCT doc_id) >= {_PLAN.documents}
  UNION ALL SELECT key, min(doc_id) FROM d GROUP BY key, n HAVING count(*) >= CASE WHEN n > {_PLAN.long_tokens} THEN {_PLAN.long_documents} ELSE {_PLAN.documents} END),
g AS (SELECT DISTINCT doc_id, pos FROM o JOIN r USING (key) WHERE doc_id <> first)
SELECT l.doc_id, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS text, count(*) AS n_lines, count(g.pos) AS n_dropped
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id"""

#: Every 50-byte window of every document, taken from overlapping parts, as a substring of a long text costs its whole length.
SUBSTRINGS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, base, substring(h, 2 * base + 1, 2 * 561) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 512)) AS base FROM d)),
w AS (SELECT doc_id, base + j AS i, substring(part, 2 * j + 1, 100) AS s FROM (SELECT doc_id, base, part, unnest(range(0, length(part) // 2 - 49)) AS j FROM c)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) > 50 AS opens FROM w JOIN f USING (s) WHERE first < doc_id),
r AS (SELECT doc_id, min(i) AS start, max(i) + 50 AS stop FROM (SELECT doc_id, i, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g) GROUP BY doc_id, span),
k AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM (SELECT * FROM r UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d)),
p AS (SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (start - before)), '' ORDER BY start) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)"""

#: SQL for what SQL can say; the other queries are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op3_line_templates": LINES_SQL, "op5_hyperminhash_neardup": NEAR_SQL, "op6_suffix_array_dedup": SUBSTRINGS_SQL, "op9_benchmark_containment": decontamination.ORACLE, "op11_chat_grammar": chat.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_phrase_collocations": collocations.ORACLE}
