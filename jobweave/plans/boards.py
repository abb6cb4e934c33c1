"""Parts as the payloads of eight job boards, normalised; the SQL says what each board's posting must become."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import board_source
from ..sources import postings as boards
from .registry import query, table
from .views import AS_OF, scratch
from ..functions.text import instant_of

_ID = "CAST(p_partkey AS VARCHAR)"
_PLACE = "CASE p_type WHEN 'ECONOMY' THEN 'Remote, US' ELSE 'Austin, TX' END"
_DAY = "strftime(TIMESTAMP '2024-01-01 10:00:00' + to_days(p_size), '%Y-%m-%d %H:%M:%S')"
_URL = "'http://jobs.example/' || p_partkey"


def _sql(kind: str, where: str = "", **fields: str) -> str:
    own = dict(source_id=_ID, company="p_brand", title="p_name", url=_URL, location=_PLACE, remote="FALSE", salary="CAST(NULL AS VARCHAR)", salary_is_estimated="FALSE", description="p_name || ' & ' || p_type", posted=_DAY) | fields
    return f"SELECT '{kind}' AS source, {', '.join(f'{v} AS {k}' for k, v in own.items())} FROM part {where}"


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


class Part:
    """The fields that payloads are built from."""

    def __init__(self) -> None:
        number = F.col("p_partkey")
        self.id, self.title, self.company, self.kind = number.cast("string"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
        self.place = F.when(self.kind == "ECONOMY", "Remote, US").otherwise("Austin, TX")
        self.at = F.timestamp_seconds(F.lit(1704103200) + F.col("p_size") * 86400)
        self.iso, self.url = F.date_format(self.at, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.concat(F.lit("http://jobs.example/"), number)
        self.html = F.concat(F.lit("&lt;p&gt;"), self.title, F.lit(" &amp;amp; "), self.kind, F.lit("&lt;/p&gt;"))
        self.big = F.col("p_size") > 25
        self.price = F.col("p_retailprice")


def _normalised(spark: SparkSession, sf_dir: str, kind: str, item: Column, wrap=lambda items: _struct(jobs=items), company: str = "", whole: bool = True) -> DataFrame:
    """All parts as payloads of one board: one payload for each size, or (not `whole`) for each part."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", item.alias("item"))
    grouped = parts.groupBy("p_size").agg(F.collect_list("item").alias("items")).select(F.to_json(wrap(F.col("items"))).alias("payload")) if whole else parts.select(F.to_json("item").alias("payload"))
    blank = {c: F.lit("") for c in boards.SPEC_FIELDS} | {"company": F.lit(company), "tenant": F.lit("t"), "host": F.lit("h"), "site": F.lit("S")}
    raw = grouped.select(F.lit(kind).alias("kind"), "payload", instant_of(AS_OF).alias("fetched_at")).withColumns(blank)
    out = boards.postings(raw)
    return out.select("source", "source_id", "company", "title", "url", "location", "remote", "salary", "salary_is_estimated", "description", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query(_sql("greenhouse", remote="p_size > 25 OR p_type = 'ECONOMY'"))
def board_greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    tag = F.array(_struct(name=F.lit("Location Type"), value=F.when(p.big, "Remote").otherwise("Onsite")))
    return _normalised(spark, sf_dir, "greenhouse", _struct(id=p.id, title=p.title, company_name=p.company, absolute_url=p.url, location=_struct(name=p.place), metadata=tag, content=p.html, first_published=p.iso))


@query(_sql("ashby", "WHERE p_type <> 'PROMO'", company="'Co'", location=f"{_PLACE} || ', ' || p_brand", remote="p_size > 25", salary="'$' || p_size || 'K'", description="p_name || ' ' || p_type"))
def board_ashby(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    pay = _struct(scrapeableCompensationSalarySummary=F.concat(F.lit("$"), F.col("p_size"), F.lit("K")))
    item = _struct(id=p.id, title=p.title, jobUrl=p.url, location=p.place, secondaryLocations=F.array(_struct(location=p.company)), workplaceType=F.when(p.big, "Remote").otherwise("Hybrid"), isListed=p.kind != "PROMO", compensation=pay, descriptionPlain=F.concat_ws("  ", p.title, p.kind), publishedAt=p.iso)
    return _normalised(spark, sf_dir, "ashby", item, company="Co")


@query(_sql("lever", company="'Co'", location=f"{_PLACE} || ', ' || p_brand", remote="p_size > 25", description="p_name || ' Needs a & ' || p_type || ' end'"))
def board_lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    needs = F.array(_struct(text=F.lit("Needs"), content=F.concat(F.lit("<li>a &amp; "), p.kind, F.lit("</li>"))))
    item = _struct(id=p.id, text=p.title, hostedUrl=p.url, categories=_struct(location=p.place, allLocations=F.array(p.place, p.company)), workplaceType=F.when(p.big, "remote").otherwise("Remote"), descriptionPlain=p.title, lists=needs, additionalPlain=F.lit("end"), createdAt=F.unix_millis(p.at))
    return _normalised(spark, sf_dir, "lever", item, lambda items: items, company="Co")


_ABOUT = f"p_name || ' at ' || p_brand || '. Team/department: ' || p_type || '. Employment type: Full. Location: ' || {_PLACE} || '. (Metadata only; full JD on the posting.)'"


@query(_sql("breezy", remote="p_size > 25 OR p_type = 'ECONOMY'", description=_ABOUT))
def board_breezy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    item = _struct(id=p.id, name=p.title, url=p.url, published_date=p.iso, type=_struct(name=F.lit("Full")), location=_struct(name=p.place, is_remote=p.big), department=p.kind, company=_struct(name=p.company))
    return _normalised(spark, sf_dir, "breezy", item, lambda items: items)


@query(_sql("remotive", remote="TRUE", salary="'$' || p_size"))
def board_remotive(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    item = _struct(id=p.id, url=p.url, title=p.title, company_name=p.company, candidate_required_location=p.place, salary=F.concat(F.lit("$"), F.col("p_size")), description=p.html, publication_date=p.iso)
    return _normalised(spark, sf_dir, "remotive", item)


_MONEY = "format('${:,}', CAST(round_even(p_retailprice, 0) AS BIGINT)) || ' - ' || format('${:,}', CAST(round_even(p_retailprice + 100, 0) AS BIGINT))"


@query(_sql("adzuna", url="'https://www.adzuna.com/details/' || p_partkey || '?utm_source=s'", remote="p_type = 'ECONOMY'", salary=_MONEY, salary_is_estimated="p_size > 25"))
def board_adzuna(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    link = F.concat(F.lit("https://www.adzuna.com/land/ad/"), p.id, F.lit("?se=x&utm_source=s&v=1"))
    item = _struct(id=p.id, title=p.title, company=_struct(display_name=p.company), location=_struct(display_name=p.place), description=p.html, redirect_url=link, created=p.iso, salary_min=p.price, salary_max=p.price + 100, salary_is_predicted=F.when(p.big, "1").otherwise("0"))
    return _normalised(spark, sf_dir, "adzuna", item, lambda items: _struct(results=items))


@query(_sql("usajobs", remote="p_size > 25", salary=_MONEY + " || '/yr'"))
def board_usajobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    pay = F.array(_struct(MinimumRange=p.price.cast("string"), MaximumRange=(p.price + 100).cast("string"), RateIntervalCode=F.lit("PA")))
    own = _struct(PositionID=p.id, PositionTitle=p.title, OrganizationName=p.company, PositionURI=p.url, PositionLocationDisplay=p.place, PositionRemuneration=pay, PublicationStartDate=p.iso, UserArea=_struct(Details=_struct(JobSummary=p.html, RemoteIndicator=p.big)))
    return _normalised(spark, sf_dir, "usajobs", _struct(MatchedObjectDescriptor=own), lambda items: _struct(SearchResult=_struct(SearchResultItems=items)))


@query(_sql("workday", source_id="'t:' || p_partkey", company="'Co'", url="'https://h/S/job/' || p_partkey", remote="p_type = 'ECONOMY'"))
def board_workday(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Part()
    item = _struct(jobPostingInfo=_struct(id=F.lit("i"), title=p.title, jobDescription=p.html, location=p.place, startDate=p.iso, jobReqId=p.id, externalPath=F.concat(F.lit("/job/"), p.id)))
    return _normalised(spark, sf_dir, "workday", item, company="Co", whole=False)


@query("""SELECT 'lever:Co: FetchError: unexpected lever payload' AS error, count(*) AS n FROM pages
UNION ALL SELECT 'monster:Co: no fetcher registered for kind monster', count(*) FROM region""")
def board_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are no payloads: every one becomes an error that names its source."""
    blank = {c: F.lit("Co" if c == "company" else "") for c in boards.SPEC_FIELDS}
    raw = lambda df, kind, payload: df.select(F.lit(kind).alias("kind"), payload.alias("payload"), instant_of(AS_OF).alias("fetched_at")).withColumns(blank)
    rows = raw(table(spark, sf_dir, "pages"), "lever", F.col("html")).unionByName(raw(table(spark, sf_dir, "region"), "monster", F.col("r_name")))
    return boards.errors(rows).groupBy("error").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS req, p_name AS title, '/job/' || p_partkey AS external_path, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS location FROM part WHERE p_type <> 'PROMO' AND p_size % 2 = 0""")
def board_workday_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First stage of the two-stage board: hits without a title are none, and what the keep filter leaves is hydrated."""
    p = Part()
    hit = _struct(title=F.when(p.kind != "PROMO", p.title).otherwise(""), externalPath=F.concat(F.lit("/job/"), p.id), locationsText=F.when(p.big, p.company), bulletFields=F.array(p.id))
    pages = table(spark, sf_dir, "part").groupBy("p_size").agg(F.collect_list(hit).alias("hits"))
    blank = {c: F.lit("") for c in boards.SPEC_FIELDS}
    raw = pages.select(F.lit("workday").alias("kind"), F.to_json(_struct(total=F.size("hits"), jobPostings=F.col("hits"))).alias("payload"), instant_of(AS_OF).alias("fetched_at"), "p_size").withColumns(blank)
    kept = boards.workday_stubs(raw.where("p_size % 2 = 0"))
    return kept.select(F.col("req_id").cast("bigint").alias("req"), "title", "external_path", "location")


class Echo:
    """A transport without a network: a board of one posting, made of its spec. Other kinds than greenhouse fail."""

    def __call__(self, spec: dict) -> str:
        if spec["kind"] != "greenhouse":
            raise ValueError(f"{spec['kind']} must not be asked")
        return json.dumps({"jobs": [{"id": spec["slug"], "title": spec["query"], "company_name": spec["company"], "absolute_url": f"http://jobs.example/{spec['slug']}", "location": {"name": spec["where"]}}]})


ECHO = f"{__name__}:Echo"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("s_acctbal") > 0, "greenhouse").otherwise("lever")
    return table(spark, sf_dir, "supplier").select(kind.alias("kind"), F.col("s_suppkey").cast("string").alias("slug"), F.col("s_name").alias("company"), F.concat(F.lit("Role "), "s_nationkey").alias("query"), F.lit("Austin, TX").alias("where"))


_SUPPLIED = "CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS company, 'Role ' || s_nationkey AS title FROM supplier WHERE s_acctbal > 0"


@query(f"SELECT {_SUPPLIED}")
def boards_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as boards of the data source; those of another kind are filtered by the source and never asked."""
    raw = board_source.reading(_suppliers(spark, sf_dir), ECHO, 16).where("kind = 'greenhouse'")
    return boards.postings(raw.where("error IS NULL")).select("source_id", "company", "title")


@query(f"SELECT {_SUPPLIED} UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'failed' FROM supplier WHERE s_acctbal <= 0 OR s_acctbal IS NULL")
def boards_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boards as a stream, started twice from one checkpoint: each was asked once."""
    folder = scratch(spark)
    for _ in range(2):
        rows = board_source.streaming(_suppliers(spark, sf_dir), 1, ECHO, 16)
        rows.writeStream.format("parquet").option("path", f"{folder}/raw").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    raw = spark.read.schema(rows.schema).parquet(f"{folder}/raw")
    failed = raw.where("error IS NOT NULL").select(F.col("slug").alias("source_id"), "company", F.lit("failed").alias("title"))
    return boards.postings(raw.where("error IS NULL")).select("source_id", "company", "title").unionByName(failed)
