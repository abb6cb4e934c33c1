from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from jobweave.operators import changes
from jobweave.operators.commitlog import CommitLog, Files
from jobweave.operators.store import Store, WriteConflict
from jobweave.operators.writes import Writes

NOW = datetime(2024, 3, 5, 12)


def applications(spark, ids, status="applied"):
    return spark.createDataFrame([(k, 1 + k % 2, f"j{k}", status, NOW, NOW, None) for k in ids], "id bigint, user_id bigint, job_id string, status string, applied_at timestamp, updated_at timestamp, follow_up_on date")


@pytest.fixture
def store(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/store")
    own.write("applications", applications(spark, range(1, 201)))
    return own


def statuses(store):
    return {r["id"]: r["status"] for r in store.read("applications").collect()}


def test_a_one_row_mutation_rewrites_one_bucket(spark, store):
    before = store.manifest("applications")
    assert before.buckets == 8 and {f.bucket for f in before.files} == set(range(8)) and sum(f.rows for f in before.files) == 200
    Writes(store).update_status(2, 57, "offer", NOW)
    after = store.manifest("applications")
    gone, came = {f.path for f in before.files} - {f.path for f in after.files}, [f for f in after.files if f.path not in {g.path for g in before.files}]
    assert len(gone) == 1 and {f.bucket for f in came} == {f.bucket for f in before.files if f.path in gone} and len({f.bucket for f in came}) == 1
    assert statuses(store) == {k: "offer" if k == 57 else "applied" for k in range(1, 201)}
    # what was there before is still to be read
    assert store.read("applications", 1).where("status = 'offer'").isEmpty() and store.versions("applications") == [1, 2]


def test_a_lookup_opens_only_files_that_can_hold_its_key(spark, store):
    store.append("applications", applications(spark, range(1000, 1010)))
    held = store.manifest("applications")
    assert len(store.pruned("applications", held, id=57)) == 1 and not store.pruned("applications", held, id=999_999)
    assert store.lookup("applications", id=57).first()["job_id"] == "j57" and store.lookup("applications", id=57, user_id=1).isEmpty()
    assert len(store.lookup("applications", id=1005).inputFiles()) == 1
    assert store.lookup("applications", user_id=1, job_id="j1004").first()["id"] == 1004


def test_what_a_manifest_tells_of_files_makes_nothing_of_their_paths_for_each_row(spark, store, monkeypatch):
    frame, plans = type(spark.range(1)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().toString()) or collect(df))
    store.append("applications", applications(spark, range(1000, 1100)))
    monkeypatch.undo()
    told = [p for p in plans if "file_path" in p]
    assert told and not any("regexp" in p for p in told)
    for f in store.manifest("applications").files:
        ids = [r["id"] for r in spark.read.parquet(f"{store.root}/applications/{f.path}").select("id").collect()]
        assert (f.rows, f.bounds["id"]) == (len(ids), [min(ids), max(ids)])


def test_no_rows_are_folded_away(spark, tmp_path):
    empty = Store(spark, f"file://{tmp_path}/none").read("applications")
    assert empty.schema.names == applications(spark, []).columns and empty.isEmpty()
    assert "ExistingRDD" not in empty._jdf.queryExecution().toString()


def test_an_append_rewrites_nothing_and_compaction_joins_files(spark, store):
    for k in range(6):
        store.append("applications", applications(spark, range(1000 + 50 * k, 1050 + 50 * k)))
    held = store.manifest("applications")
    assert {f.path for f in store.manifest("applications", 1).files} <= {f.path for f in held.files} and len(held.files) >= 48
    assert store.compact("applications", most_files=3) and not store.compact("applications", most_files=3)
    after = store.manifest("applications")
    assert len(after.files) == 8 and store.read("applications").count() == 500
    # a table that outgrew its buckets gets more
    assert store.compact("applications", bucket_bytes=500) and store.manifest("applications").buckets > 8 and store.read("applications").count() == 500
    store.vacuum("applications", keep=1)
    assert len(store.versions("applications")) == 1 and store.read("applications").count() == 500
    assert {p.split("/")[0] for p in store.disk.sizes("applications") if p.startswith("data-")} == {f.path.split("/")[0] for f in store.manifest("applications").files}


def test_replace_and_delete_keep_other_keys(spark, store):
    store.replace("applications", applications(spark, [3, 300], "offer"), ["id"], gone=applications(spark, [5, 6, 999]))
    got = statuses(store)
    assert got[3] == got[300] == "offer" and not {5, 6, 999} & set(got) and len(got) == 199
    store.delete("applications", applications(spark, range(1, 101)), ["id"])
    assert min(statuses(store)) == 101
    store.replace("applications", applications(spark, [], "offer"), ["id"])
    assert store.version("applications") == 3
    # keys that don't tell the bucket touch all of them
    store.delete("applications", spark.createDataFrame([(None, None, "j150", None, None, None, None)], store.schemas["applications"]), ["job_id"])
    assert 150 not in statuses(store) and len(statuses(store)) == 100


# Crashes and concurrent writers


def tear(store, number, content=b""):
    path, files = store.disk.path("_log", f"{number:020d}")
    stream = files.create(path, False)
    stream.write(bytearray(content))
    stream.close()


@pytest.mark.parametrize("content", [b"", b"{", b"0" * 64 + b"\n{}"])
def test_a_torn_entry_neither_hides_nor_blocks(spark, store, content):
    tear(store, 2, content)
    with pytest.warns(UserWarning, match="torn"):
        assert store.read("applications").count() == 200
    with pytest.warns(UserWarning):
        store.upsert("applications", applications(spark, [201]), ["id"])
    assert store.read("applications").count() == 201 and store.log.last()[0] == 3
    tear(store, 7, content)
    with pytest.warns(UserWarning):
        assert store.read("applications").count() == 201
        Writes(store).log_application(9, "new", NOW, note="n")
    assert store.read("applications").count() == 202 and store.read("interview_notes").count() == 1
    store.vacuum("applications", keep=1)
    assert store.read("applications").count() == 202


def test_two_writers_of_one_bucket_conflict_and_of_two_are_both_kept(spark, store):
    first, second, third = store.begin(), store.begin(), store.begin()
    bucket = {r["id"]: r["b"] for r in store.read("applications").select("id", Store._bucket([F.col("id")], 8).alias("b")).collect()}
    same = [k for k in bucket if bucket[k] == bucket[1]][:2]
    other = next(k for k in bucket if bucket[k] != bucket[1])
    with first:
        first.upsert("applications", applications(spark, [same[0]], "offer"), ["id"])
    with second:
        second.upsert("applications", applications(spark, [other], "screening"), ["id"])
    with pytest.raises(WriteConflict), third:
        third.upsert("applications", applications(spark, [same[1]], "rejected"), ["id"])
    got = statuses(store)
    assert (got[same[0]], got[other], got[same[1]]) == ("offer", "screening", "applied") and store.version("applications") == 3


def test_of_two_whole_writes_from_one_state_the_second_fails(spark, store):
    first, second = store.begin(), store.begin()
    with first:
        first.write("applications", applications(spark, [1]))
        first.write("users", spark.createDataFrame([(1, "a", NOW)], store.schemas["users"]))
    with pytest.raises(WriteConflict), second:
        second.write("users", spark.createDataFrame([(2, "b", NOW)], store.schemas["users"]))
        second.write("applications", applications(spark, [2]))
    # all or none
    assert [r["email"] for r in store.read("users").collect()] == ["a"] and list(statuses(store)) == [1]


def test_ids_are_given_once_however_many_write(spark, store):
    w = Writes(store)
    begin, calls = store.begin, []

    def crossed():
        own = begin()
        own.manifest("applications")
        if not calls:  # somebody else comes in between
            calls.append(1)
            Writes(Store(spark, store.root)).log_application(5, "theirs", NOW)
        return own

    store.begin = crossed
    assert (w.log_application(6, "mine", NOW, note="n")["id"], len(statuses(store))) == (202, 202)
    assert store.read("interview_notes").first()["application_id"] == 202


def test_a_writer_that_dies_leaves_nothing(spark, store, monkeypatch):
    w = Writes(store)
    monkeypatch.setattr(store.log, "add", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        w.log_application(1, "j1000", NOW, note="lost")
    monkeypatch.undo()
    assert len(statuses(store)) == 200 and store.read("interview_notes").isEmpty()
    assert w.log_application(1, "j1000", NOW, note="kept")["id"] == 201 and store.read("interview_notes").first()["application_id"] == 201
    store.vacuum("applications", keep=1)
    assert len(statuses(store)) == 201


def test_an_entry_that_goes_while_it_is_read_is_no_error(spark, store, monkeypatch):
    for k in range(3):
        store.upsert("applications", applications(spark, [1000 + k]), ["id"])
    names, seen = Files.names, []

    def stale(self, *parts):
        out = names(self, *parts)
        if parts == ("_log",) and not seen:
            seen.append(1)
            CommitLog(self).trim()
            return [n for n in out if n != max(out)]  # listed before the last one came and the others went
        return out

    monkeypatch.setattr(Files, "names", stale)
    assert store.read("applications").count() == 203


def test_names_are_taken_once(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/x")
    assert files.publish({"a": 1}, "f") and not files.publish({"a": 2}, "f") and files.get("f") == {"a": 1} and files.names() == ["f"]
    assert files.get("none") is None


# Captures


def test_a_capture_that_died_repeats_nothing(spark, store, tmp_path, monkeypatch):
    log = changes.ChangeLog(store, f"file://{tmp_path}/log")
    log.capture(datetime(2024, 3, 1))
    Writes(store).save_job(1, "j1", NOW)
    monkeypatch.setattr(log.held.log, "add", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        log.capture(datetime(2024, 3, 2))
    assert log.feed("saved_jobs").isEmpty() and log.feed("applications").count() == 200
    monkeypatch.undo()
    log.capture(datetime(2024, 3, 2))
    log.capture(datetime(2024, 3, 3))
    assert [(r["job_id"], r["_change_type"]) for r in log.feed("saved_jobs").collect()] == [("j1", "insert")] and log.feed("applications").count() == 200


@pytest.mark.parametrize("deletes, captures", [(True, 10), (False, 5)])
def test_summed_metrics_equal_the_full_count_after_captures(spark, store, tmp_path, deletes, captures):
    log, w = changes.ChangeLog(store, f"file://{tmp_path}/log", deletes), Writes(store)
    for k in range(captures):
        if k % 3 == 0:
            w.log_application(3, f"n{k}", NOW, "interested")
        if k % 2:
            w.update_status(1 + k % 2, 2 * k + 2 - k % 2, "offer", NOW)
        else:
            w.save_job(1, f"s{k % 3}", NOW, f"note {k}")
        if k % 4 == 3:
            w.unsave_job(1, "s1")
            store.delete("applications", applications(spark, [100 + k]), ["id"])
        log.capture(datetime(2024, 3, 1 + k // 2, k))
        if k == 4:
            log.compact()
    rows = lambda df: sorted(map(str, df.select("day", "metric", "dimension", "value").collect()))
    whole = rows(log.metrics(date(2024, 3, 9)))
    assert rows(log.summed_metrics(date(2024, 3, 9))) == whole and len(whole) > 4
    # neither the feed nor the mirrors are opened for it
    assert all("/counts_" in f for f in log.summed_metrics(date(2024, 3, 9)).inputFiles())
