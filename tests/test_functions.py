from __future__ import annotations

import hashlib
import html
import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from jobweave.functions import chunking, geo, text
from jobweave.functions import validation as v
from jobweave.plans import catalog


def values(spark, column, rows):
    """The column's values over rows of one string column x."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r[0] for r in df.select("k", column.alias("y")).orderBy("k").select("y").collect()]


KEEP = ["San Francisco, CA", "London, UK | Austin, TX", "USA DC Washington", "Chicago, Cook County", None, "", "Worldwide", "Americas, Europe", "North America", "Paris, TX", "Berlin, NH", "US-CA-Menlo Park", "London, UK; Remote-Friendly, United States"]
DROP = ["London, UK", "Ontario, CAN", "Zürich, CH", "ZÜRICH", "Bogotá", "BOGOTÁ", "São Paulo", "Stockholm, London", "LATAM, Europe", "CA-Ontario-Toronto", "Sydney, Australia"]


def test_eligibility(spark):
    got = values(spark, geo.us_eligible(F.col("x")), KEEP + DROP)
    assert got == [True] * len(KEEP) + [False] * len(DROP)


def test_eligibility_agrees_with_python_regexes(spark):
    def slow(place):
        if not place:
            return True
        if re.match(geo.CANADA_PREFIX, place, re.I):
            return False
        return bool(re.search(geo.US_SIGNAL, place, re.I)) or not re.search(geo.FOREIGN_SIGNAL, place, re.I)

    rng = random.Random(3)
    words = "London Paris TX CA- CA ON Remote US Worldwide Tampa Ontario CAN IN ME India , ; | - Zürich".split()
    places = [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(150)]
    assert values(spark, geo.us_eligible(F.col("x")), places) == [slow(p) for p in places]


@pytest.mark.parametrize(
    ("place", "remote", "work", "days", "tier"),
    [
        ("Remote (US)", False, None, None, 1), ("Chicago, IL", True, None, None, 1), ("Remote, US", False, "onsite", None, 6), ("Venice, FL", False, None, None, 3),
        ("St. Petersburg", False, "hybrid", 8, 2), ("Austin, TX", False, "hybrid", 2, 4), ("Austin, TX", False, "hybrid", 12, 6), ("Austin, TX", False, "hybrid", None, 6),
        ("Chicago, Cook County", False, None, None, 5), ("Austin, TX", False, "odd", 1, 6), (None, False, None, None, 6), ("Austin", False, "remote", None, 1),
    ],
)
def test_location_tier(spark, place, remote, work, days, tier):
    row = spark.createDataFrame([(place, remote, work, days)], "l string, r boolean, w string, d int")
    assert row.select(geo.location_tier(F.col("l"), F.col("r"), F.col("w"), F.col("d"))).first()[0] == tier


def test_plain_text(spark):
    cases = ["<p>Hello <b>world</b></p>", "&lt;p&gt;Data&lt;/p&gt;", "a&amp;nbsp;b", "a \n\t b", "", "   ", "&lt;p&gt;&lt;/p&gt;", None, "x &lt; y", "1&copy;2"]

    def slow(t):
        once = re.sub(r"<[^>]+>", " ", html.unescape(t or ""))
        return re.sub(r"\s+", " ", html.unescape(once)).strip()

    assert values(spark, text.plain_text(F.col("x")), cases) == [slow(t) for t in cases]


def test_plain_text_of_closed_references_only(spark, tmp_path):
    """Titles that end within a reference, as the SQL of the query reads them."""
    duckdb = pytest.importorskip("duckdb")
    pages = ["<title>a&amp;&amp</title><p>b &amp; &copy; c</p>", "<title>a&am</title>&middot;&quot;x&quot;", "&amp", "x&copy y", None and "", "<b>&</b>&amp;&amp;&amp"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").where("html is not null").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.plain_text(spark, str(tmp_path)).orderBy("page_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(f"SELECT * FROM ({catalog.ORACLE_SQL['plain_text']}) ORDER BY page_id").fetchall()
    cases = ["&#38;&#x26;&#38 &notit; &not; &nosuch; &amp;amp; &;"]
    assert values(spark, text.plain_text(F.col("x"), closed=True), cases) == ["&&&#38 &notit; ¬ &nosuch; & &;"]


def test_keys(spark):
    row = spark.createDataFrame([("greenhouse", "7", "Acme, Inc.", "Sr. Data  Engineer", None)], "s string, i string, c string, t string, l string")
    got = row.select(text.posting_id(F.col("s"), F.col("i")), text.cross_source_key(F.col("c"), F.col("t"), F.col("l")), text.content_hash(F.col("l")), text.context_header(F.col("t"), F.col("c"), F.col("l"))).first()
    assert got[0] == hashlib.sha256(b"greenhouse\x007").hexdigest()
    assert got[1] == hashlib.md5(b"acme inc sr data engineer ").hexdigest()
    assert got[2] == hashlib.sha256(b"").hexdigest()
    assert got[3] == "Sr. Data  Engineer at Acme, Inc..\n\n"


def test_times_and_money(spark):
    row = spark.sql("SELECT timestamp '2024-01-01 23:00:00' a, timestamp '2024-01-03 01:00:00' b, 85389.0D lo, 116975.0D hi")
    got = row.select(text.whole_days(F.col("a"), F.col("b")), text.dollars(F.col("lo"), F.col("hi")), text.dollars(F.col("lo"), F.col("lo")), text.dollars(F.lit(None).cast("double"), F.lit(None).cast("double"))).first()
    assert list(got) == [1, "$85,389 - $116,975", "$85,389", None]
    assert values(spark, text.instant(F.col("x")), ["2026-07-16T10:10:51", "2025-10-01T00:00:00.0000", "nonsense", None])[2:] == [None, None]
    assert values(spark, text.fenced(F.col("x")), ["a </ Job_Description > b"]) == ["a [/job_description] b"]


def windows(whole, size, overlap):
    """The chunker's rules, one position at a time."""
    whole = whole.strip()
    out, start = [], 0
    while whole and start < len(whole):
        end = min(start + size, len(whole))
        if end < len(whole):
            floor, cut = start + int((end - start) * 0.5), -1
            blank = whole.rfind("\n\n", start, end)
            stop = max(whole.rfind(t, start, end) for t in (". ", ".\n", "! ", "!\n", "? ", "?\n"))
            if blank > floor:
                cut = blank
            elif stop > start and stop + 1 > floor:
                cut = stop + 1
            else:
                cut = next((k for k in range(end - 1, start, -1) if whole[k].isspace()), -1)
            end = cut if cut > start else end
        out.append(whole[start:end].strip())
        if end >= len(whole):
            break
        back = max(end - overlap, start + 1)
        while back > start + 1 and not whole[back - 1].isspace():
            back -= 1
        start = back
    return [w for w in out if w]


def test_chunker_agrees_with_a_slow_one():
    rng = random.Random(1)
    for _ in range(600):
        t = "".join(rng.choice("abcé   .!?\n\n x") for _ in range(rng.randrange(0, 260)))
        size = rng.randrange(2, 60)
        overlap = rng.randrange(0, size)
        assert chunking.chunk_text(t, size, overlap) == windows(t, size, overlap)


def test_chunker_refuses():
    with pytest.raises(TypeError):
        chunking.chunk_text(None)
    for size, overlap in ((0, 0), (5, -1), (5, 5)):
        with pytest.raises(ValueError):
            chunking.chunk_text("x", size, overlap)


def test_chunk_postings(spark):
    rows = spark.createDataFrame([("j1", "T", "C", "L", "word " * 400), ("j2", "T", "C", None, "")], "id string, title string, company string, location string, description string")
    got = chunking.chunk_postings(rows).orderBy("chunk_index").collect()
    assert {r["job_id"] for r in got} == {"j1"} and [r["chunk_index"] for r in got] == list(range(len(got)))
    assert all(r["chunk_text"].startswith("T at C. L.\n\n") and len(r["chunk_text"]) <= 800 for r in got) and got[0]["id"] == "j1:0"


CLEANED = [
    ("query", "  a   b ", "a b"), ("query", "x" * 900, "x" * 500), ("top_k", None, 10), ("top_k", "500", 50), ("top_k", -3, 1),
    ("status", None, "applied"), ("status", " Offer ", "offer"), ("new_status", "offer", "offer"), ("posted_within_days", 0, 1), ("posted_within_days", "9999", 365),
    ("posted_within_days", "", None), ("min_score", 400, 100), ("stale_days", 0, 1), ("follow_up_on", "2031-01-02", date(2031, 1, 2)), ("follow_up_on", date(2031, 1, 2), date(2031, 1, 2)),
    ("follow_up_on", "", None), ("remote_only", "false", False), ("remote_only", "yes", True), ("remote_only", None, False), ("remote_only", 1, True), ("kind", "Cover-Letter", "cover_letter"),
    ("kind", " resume  bullet", "resume_bullet"), ("note", "  ", None), ("company", " x ", "x"), ("name", "n" * 300, "n" * 200), ("source", " Lever ", "lever"), ("page", "x", 1), ("page", -2, 1),
    ("form_number", "7", 7), ("form_number", "seven", None), ("application_id", "12", 12),
]
REFUSED = [("query", 3), ("query", " "), ("status", "doing"), ("new_status", ""), ("follow_up_on", "next Tuesday"), ("follow_up_on", 5), ("application_id", 0), ("application_id", "x"), ("job_id", ""), ("job_id", 4), ("interview_note", ""), ("kind", "poem"), ("top_k", "x")]


@pytest.mark.parametrize(("name", "value", "wanted"), CLEANED)
def test_arguments_are_cleaned_by_their_rules(name, value, wanted):
    assert v.clean(name, value) == wanted and v.cleaned(**{name: value}) == {name: wanted}


@pytest.mark.parametrize(("name", "value"), REFUSED)
def test_arguments_that_cannot_be_used_are_refused_by_name(name, value):
    with pytest.raises(v.BadArgument, match=name):
        v.clean(name, value)


def test_chunks_as_a_table_function(spark):
    spark.udtf.register("chunks", chunking.chunks_table)
    text = "word " * 400
    rows = spark.sql(f"SELECT * FROM chunks('{text}', 300, 50)").collect()
    assert [r["chunk_text"] for r in rows] == chunking.chunk_text(text, 300, 50) and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert spark.sql("SELECT * FROM chunks(CAST(NULL AS STRING), 300, 50)").collect() == []


def test_instants_are_utc_unless_they_say_otherwise(spark):
    from datetime import timedelta, timezone

    got = spark.range(1).select(text.instant_of(datetime(2031, 5, 1, 12)), text.instant_of(datetime(2031, 5, 1, 12, tzinfo=timezone(timedelta(hours=2))))).first()
    assert tuple(got) == (datetime(2031, 5, 1, 12), datetime(2031, 5, 1, 10))


def test_session_time_is_utc(spark):
    assert spark.sql("SELECT timestamp '2024-01-01 00:00:00'").first()[0] == datetime(2024, 1, 1)
