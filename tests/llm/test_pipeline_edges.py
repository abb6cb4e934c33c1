from __future__ import annotations

import corpus_pipeline

from .conftest import DOCS


def stored(spark, folder, rows, labels, benchmark, schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_an_empty_table_gives_no_pieces(spark, tmp_path):
    assert corpus_pipeline.run(spark, stored(spark, tmp_path, [], [], [])).collect() == []


def test_odd_rows_and_clashing_columns_go_through(spark, tmp_path):
    rows = [(1, "one two three four five six seven", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "nobody knows whose words these are", "en", None, 1), (4, "x " * 40_000, "en", "s", 1), (5, "leaked item of a public test set here", "en", "s", 1), (1, "one two three four five six seven", "en", "s", 3)]
    more = [(*r, "a", "b", 7) for r in rows]
    folder = stored(spark, tmp_path, more, [(1, 1, 0), (None, None, None)], [(1, "leaked item of a public test set here"), (2, None)], DOCS + ", score string, shard string, n int")
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()]
    assert sorted((i is None, i or 0) for i in ids) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
