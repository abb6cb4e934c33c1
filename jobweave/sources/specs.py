"""The source specs of a full run, and a fan-out that fetches each in a task of its own through an injected transport."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC_SCHEMA = "kind string, slug string, company string, query string, where string, tenant string, site string, host string, distance int, max_days_old int, max_results int, remote_only boolean"
PAYLOAD_SCHEMA = "kind string, slug string, company string, query string, where string, tenant string, site string, host string, payload string, error string, fetched_at timestamp"

# Company boards, as (kind, slug, display name).
BOARDS = (
    ("ashby", "modelyst", "Modelyst"),
    ("lever", "foodsmart", "Foodsmart"),
    ("greenhouse", "nex", "Nex"),
    ("ashby", "ramp", "Ramp"),
    ("greenhouse", "brex", "Brex"),
    ("greenhouse", "mercury", "Mercury"),
    ("greenhouse", "marqeta", "Marqeta"),
    ("ashby", "moderntreasury", "Modern Treasury"),
    ("ashby", "plaid", "Plaid"),
    ("greenhouse", "checkr", "Checkr"),
    ("lever", "finix", "Finix"),
    ("greenhouse", "highnote", "Highnote"),
    ("ashby", "unit", "Unit"),
    ("greenhouse", "lithic", "Lithic"),
    ("greenhouse", "gusto", "Gusto"),
    ("greenhouse", "melio", "Melio"),
    ("greenhouse", "mesh", "Mesh Payments"),
    ("ashby", "column", "Column"),
    ("greenhouse", "found", "Found"),
    ("greenhouse", "tabapay", "TabaPay"),
    ("ashby", "astra", "Astra"),
    ("greenhouse", "databricks", "Databricks"),
    ("ashby", "snowflake", "Snowflake"),
    ("greenhouse", "fivetran", "Fivetran"),
    ("ashby", "airbyte", "Airbyte"),
    ("ashby", "astronomer", "Astronomer"),
    ("ashby", "confluent", "Confluent"),
    ("greenhouse", "cribl", "Cribl"),
    ("greenhouse", "hightouch", "Hightouch"),
    ("greenhouse", "sigmacomputing", "Sigma Computing"),
    ("greenhouse", "starburst", "Starburst"),
    ("ashby", "montecarlodata", "Monte Carlo"),
    ("ashby", "prefect", "Prefect"),
    ("greenhouse", "datadog", "Datadog"),
    ("greenhouse", "stripe", "Stripe"),
    ("greenhouse", "anthropic", "Anthropic"),
    ("ashby", "cohere", "Cohere"),
    ("ashby", "langchain", "LangChain"),
    ("ashby", "baseten", "Baseten"),
    ("ashby", "modal", "Modal"),
    ("ashby", "pinecone", "Pinecone"),
    ("ashby", "weaviate", "Weaviate"),
    ("greenhouse", "scaleai", "Scale AI"),
    ("greenhouse", "adyen", "Adyen"),
    ("greenhouse", "affirm", "Affirm"),
    ("greenhouse", "alloy", "Alloy"),
    ("lever", "anchorage", "Anchorage Digital"),
    ("greenhouse", "billcom", "Bill.com"),
    ("greenhouse", "chime", "Chime"),
    ("ashby", "circle", "Circle"),
    ("lever", "dwolla", "Dwolla"),
    ("greenhouse", "fireblocks", "Fireblocks"),
    ("greenhouse", "galileo", "Galileo"),
    ("greenhouse", "gemini", "Gemini"),
    ("greenhouse", "justworks", "Justworks"),
    ("ashby", "middesk", "Middesk"),
    ("lever", "nium", "Nium"),
    ("ashby", "novo", "Novo"),
    ("ashby", "paxos", "Paxos"),
    ("greenhouse", "payoneer", "Payoneer"),
    ("ashby", "persona", "Persona"),
    ("ashby", "sardine", "Sardine"),
    ("ashby", "synctera", "Synctera"),
    ("lever", "truv", "Truv"),
    ("ashby", "anomalo", "Anomalo"),
    ("ashby", "atlan", "Atlan"),
    ("greenhouse", "clickhouse", "ClickHouse"),
    ("ashby", "datafold", "Datafold"),
    ("ashby", "deepnote", "Deepnote"),
    ("greenhouse", "dremio", "Dremio"),
    ("greenhouse", "imply", "Imply"),
    ("ashby", "lightdash", "Lightdash"),
    ("ashby", "materialize", "Materialize"),
    ("ashby", "motherduck", "MotherDuck"),
    ("ashby", "sifflet", "Sifflet"),
    ("greenhouse", "singlestore", "SingleStore"),
    ("lever", "tinybird", "Tinybird"),
    ("greenhouse", "amplitude", "Amplitude"),
    ("ashby", "anyscale", "Anyscale"),
    ("ashby", "cerebras", "Cerebras"),
    ("ashby", "chalk", "Chalk"),
    ("ashby", "cognition", "Cognition"),
    ("greenhouse", "cresta", "Cresta"),
    ("ashby", "decagon", "Decagon"),
    ("ashby", "dust", "Dust"),
    ("greenhouse", "fireworksai", "Fireworks AI"),
    ("ashby", "harvey", "Harvey"),
    ("ashby", "inngest", "Inngest"),
    ("ashby", "lancedb", "LanceDB"),
    ("greenhouse", "launchdarkly", "LaunchDarkly"),
    ("ashby", "llamaindex", "LlamaIndex"),
    ("greenhouse", "mixpanel", "Mixpanel"),
    ("ashby", "nomic", "Nomic"),
    ("ashby", "openai", "OpenAI"),
    ("ashby", "perplexity", "Perplexity"),
    ("ashby", "poolside", "Poolside"),
    ("ashby", "posthog", "PostHog"),
    ("ashby", "sierra", "Sierra"),
    ("ashby", "temporal", "Temporal"),
    ("ashby", "unstructured", "Unstructured"),
    ("greenhouse", "vectara", "Vectara"),
    ("ashby", "writer", "Writer"),
    ("lever", "zilliz", "Zilliz"),
)
BREEZY_BOARDS = (("the-asprey-group", "Dave Asprey (The Asprey Group)"),)
# Searches and their scopes.
REMOTIVE_SEARCHES = ("data engineer", "AI engineer", "machine learning engineer", "data platform", "backend engineer")
ADZUNA_PLACES = (("Sarasota", 60), ("Chicago", 40))
ADZUNA_PHRASES = ("data engineer", "AI engineer", "machine learning engineer", "data platform")
USAJOBS_KEYWORDS = ("data engineer", "artificial intelligence")
USAJOBS_SCOPES = (("Chicago, Illinois", 40, False), ("Tampa, Florida", 60, False), ("", None, True))
WORKDAY_BOARDS = (("gdit", "External_Career_Site", "gdit.wd5.myworkdayjobs.com", "GDIT"), ("leidos", "External", "leidos.wd5.myworkdayjobs.com", "Leidos"), ("parsons", "Search", "parsons.wd5.myworkdayjobs.com", "Parsons"))
WORKDAY_SHARDS = ("wd1", "wd2", "wd3", "wd5")
WORKDAY_SEARCHES = ("data engineer", "AI engineer")


def source_specs(spark: SparkSession) -> DataFrame:
    """129 specs: 103 company boards, then searches crossed with their scopes."""
    rows: list[dict] = [dict(kind=kind, slug=slug, company=company) for kind, slug, company in BOARDS]
    rows += [dict(kind="remotive", query=q) for q in REMOTIVE_SEARCHES]
    rows += [dict(kind="adzuna", query=q, where=w, distance=d, max_days_old=30, max_results=25) for w, d in ADZUNA_PLACES for q in ADZUNA_PHRASES]
    rows += [dict(kind="usajobs", query=q, where=w, distance=d, remote_only=r, max_results=25) for q in USAJOBS_KEYWORDS for w, d, r in USAJOBS_SCOPES]
    rows += [dict(kind="breezy", slug=slug, company=company) for slug, company in BREEZY_BOARDS]
    rows += [dict(kind="workday", tenant=t, site=s, host=h, company=c, query=q, max_results=10) for t, s, h, c in WORKDAY_BOARDS for q in WORKDAY_SEARCHES]
    names = [f.split()[0] for f in SPEC_SCHEMA.split(", ")]
    blank = dict.fromkeys(("slug", "company", "query", "where", "tenant", "site", "host"), "") | {"remote_only": False}
    return spark.createDataFrame([tuple((blank | r).get(n) for n in names) for r in rows], SPEC_SCHEMA)


def searches(kind: str, phrases: DataFrame, scopes: DataFrame) -> DataFrame:
    """Specs of one kind: every phrase (query) in every scope (other columns of a spec). Both are configuration, some lines each; every phrase gets the list of scopes."""
    names = [f.split()[0] for f in SPEC_SCHEMA.split(", ")]
    listed = scopes.agg(F.collect_list(F.struct(*scopes.columns)).alias("scopes"))
    rows = phrases.select("query", F.explode(listed.scalar()).alias("s")).select(F.lit(kind).alias("kind"), "query", "s.*")
    blank = {f.split()[0]: f.split()[1] for f in SPEC_SCHEMA.split(", ")}
    empty = lambda n: F.lit("") if blank[n] == "string" else F.lit(False) if blank[n] == "boolean" else F.lit(None).cast(blank[n])
    return rows.select(*[F.col(f"`{n}`") if n in rows.columns else empty(n).alias(n) for n in names])


def fetched(specs: DataFrame, transport: Callable[[dict], str], tasks: int = 32) -> DataFrame:
    """One payload (or error) for each spec. `transport` takes a spec's fields and returns JSON text; what it raises becomes the row's error."""
    text = ("kind", "slug", "company", "query", "where", "tenant", "site", "host")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for spec in frame.to_dict("records"):
                own = {k: spec[k] or "" for k in text}
                name = ":".join(x for x in (own["kind"], own["company"] or own["slug"] or own["query"]) if x)
                try:
                    rows.append(own | {"payload": transport(spec), "error": None})
                except Exception as exc:  # a dead board is a row, not the end of the run
                    rows.append(own | {"payload": None, "error": f"{name}: {type(exc).__name__}: {exc}"})
            yield pd.DataFrame(rows, columns=[*text, "payload", "error"]).assign(fetched_at=pd.Timestamp.now(tz="UTC").tz_localize(None))

    return specs.repartition(tasks).mapInPandas(run, PAYLOAD_SCHEMA)


def hydrated(stubs: DataFrame, transport: Callable[[dict], str], keep: Column | None = None, tasks: int = 8) -> DataFrame:
    """Second stage of a two-stage board: a payload (or error) for each stub. `keep` filters before anything is fetched; a failing detail loses that job only."""
    rows = stubs.where(keep) if keep is not None else stubs
    return fetched(rows.withColumn("kind", F.lit("workday")), transport, tasks)


def paged(page: Callable[[int, int], list], size: int, most: int) -> list:
    """Rows of consecutive pages, for transports: `page(number, rows so far)` until a short page or enough rows, then cut."""
    rows: list = []
    number = 0
    while len(rows) < most:
        got = page(number, len(rows))
        rows += got
        number += 1
        if len(got) < size:
            break
    return rows[:most]


def discover_workday(tenant: str, get: Callable[[str], str | None]) -> tuple[str, str] | None:
    """(site, host) of a tenant, from the first robots.txt that names a sitemap; `get` returns a text, or None where there is none."""
    for shard in WORKDAY_SHARDS:
        host = f"{tenant}.{shard}.myworkdayjobs.com"
        found = re.search(r"^Sitemap:\s*https?://[^/]+/([^/]+)/", get(f"https://{host}/robots.txt") or "", re.I | re.M)
        if found:
            return found.group(1), host
    return None


def profile(spark: SparkSession, path: str) -> DataFrame:
    """A profile file: JSON with email and headline required."""
    schema = "email string, headline string, summary string, resume_text string, target_titles array<string>, skills array<string>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    gaps = df.select(*[F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(c) for c in ("email", "headline")], F.count("*").alias("n")).first()
    missing = [c for c in ("email", "headline") if gaps[c] or not gaps["n"]]
    if missing:
        raise ValueError(f"profile lacks {', '.join(missing)}")
    return df
