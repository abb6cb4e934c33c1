from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jobweave.sources import board_source, database_sink, postings

from . import outside

SPECS = "kind string, slug string, company string"
ROWS = [("greenhouse", "a", "Acme"), ("greenhouse", "b", "Beta"), ("lever", "c", "Acme"), ("ashby", "dead", "Gone")]


@pytest.fixture
def specs(spark):
    outside.asked()
    return spark.createDataFrame(ROWS, SPECS)


def test_boards_are_read_a_partition_for_each_spec(specs):
    rows = board_source.reading(specs, "tests.outside:Canned")
    assert rows.rdd.getNumPartitions() == 4 and board_source.reading(specs, "tests.outside:Canned", 2).rdd.getNumPartitions() == 2
    got = {r["slug"]: r for r in rows.collect()}
    assert got["dead"]["payload"] is None and got["dead"]["error"] == "ashby:Gone: OSError: no route"
    assert [r["title"] for r in postings.postings(rows.where("slug = 'a'")).collect()] == ["T"]


@pytest.mark.parametrize("where, wanted", [("kind = 'greenhouse'", ["a", "b"]), ("kind = 'greenhouse' AND company = 'Acme'", ["a"]), ("company IN ('Beta', 'Gone')", ["b", "dead"]), ("slug LIKE 'd%'", ["dead"]), ("kind = 'greenhouse' AND length(slug) = 1 AND error IS NULL", ["a", "b"]), ("kind = 'none'", []), ("kind = 'lever' OR slug = 'a'", ["a", "b", "c", "dead"])])
def test_filters_keep_boards_from_being_asked(specs, where, wanted):
    rows = board_source.reading(specs, "tests.outside:Canned").where(where)
    rows.collect()
    assert outside.asked() == wanted


def test_a_filter_that_was_pushed_is_gone_from_the_plan(spark, specs, capsys):
    board_source.reading(specs, "tests.outside:Canned").where("kind = 'lever' AND length(slug) = 1").explain("formatted")
    plan = capsys.readouterr().out
    condition = [line for line in plan.split("\n") if line.startswith("Condition")]
    assert condition and all("lever" not in c for c in condition)


def run(stream, folder):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_a_restarted_stream_asks_nobody_twice(spark, specs, tmp_path):
    run(board_source.streaming(specs, 1, "tests.outside:Canned"), tmp_path)
    assert outside.asked() == ["a", "b", "c", "dead"]
    run(board_source.streaming(specs, 1, "tests.outside:Canned"), tmp_path)
    assert outside.asked() == []
    more = specs.unionByName(spark.createDataFrame([("lever", "new", "New")], SPECS))
    run(board_source.streaming(more, 1, "tests.outside:Canned"), tmp_path)
    assert outside.asked() == ["new"]
    run(board_source.streaming(more, 2, "tests.outside:Canned"), tmp_path)
    assert outside.asked() == ["a", "b", "c", "dead", "new"] and spark.read.parquet(f"{tmp_path}/out").count() == 10


@pytest.fixture
def table():
    connection = outside.connect()
    for name in ("t", "t_staged"):
        connection.execute(f"DROP TABLE IF EXISTS {name}")
    connection.execute("CREATE TABLE t (id INTEGER, name TEXT)")
    connection.executemany("INSERT INTO t VALUES (?, ?)", [(1, "old"), (-5, "stays")])
    connection.commit()

    def look(what="t"):
        return sorted(connection.execute(f"SELECT * FROM {what}").fetchall())

    yield look
    connection.close()


def test_pages_are_put_in_by_key(spark, table):
    df = spark.range(1, 1001).select("id", F.concat(F.lit("n"), "id").alias("name"))
    database_sink.write_pages(df, "tests.outside:connect", "t", key="id", connections=2)
    assert table() == [(-5, "stays"), *[(k, f"n{k}") for k in range(1, 1001)]] and table("t_staged") == []
    database_sink.write_pages(df.where("id <= 3"), "tests.outside:connect", "t", connections=1)
    assert len(table()) == 1004
    database_sink.write_pages(df.where("id <= 3"), "tests.outside:connect", "t", connections=1, overwrite=True)
    assert table() == [(k, f"n{k}") for k in (1, 2, 3)]


def test_a_failing_task_leaves_no_page_visible(spark, table):
    bad = spark.range(1, 1001, 1, 2).select("id", F.when(F.col("id") == 777, F.raise_error(F.lit("boom"))).otherwise(F.lit("x")).alias("name"))
    with pytest.raises(PySparkException):
        database_sink.write_pages(bad, "tests.outside:connect", "t", key="id", connections=2, page=50)
    database_sink.registered(spark)
    with pytest.raises(PySparkException):  # pages before the bad row have been staged by then
        bad.write.format(database_sink.FORMAT).options(connect="tests.outside:connect", table="t", key="id", page="50").mode("append").save()
    assert table() == [(-5, "stays"), (1, "old")] and table("t_staged") == []


def test_rows_of_attempts_that_don_t_count_stay_out(spark, table):
    schema = spark.createDataFrame([(1, "a")], "id bigint, name string").schema
    writer = database_sink.PageWriter({"connect": "tests.outside:connect", "table": "t", "key": "id"}, schema, False)
    lost, kept = writer.write(iter([(1, "lost"), (2, "lost")])), writer.write(iter([(1, "kept"), (2, "kept")]))
    other = database_sink.PageWriter({"connect": "tests.outside:connect", "table": "t", "key": "id"}, schema, False)
    other.write(iter([(9, "another write")]))
    assert lost.rows == 2
    writer.commit([kept])
    assert table() == [(-5, "stays"), (1, "kept"), (2, "kept")] and [r[2:] for r in table("t_staged")] == [(9, "another write")]
    other.abort([])
    assert table("t_staged") == []


def test_names_that_are_no_identifiers_are_refused(spark):
    with pytest.raises(ValueError):
        database_sink.PageWriter({"connect": "tests.outside:connect", "table": "t; DROP TABLE t"}, spark.range(1).schema, False)
