"""Raw payloads of eight job boards to normalised postings.

A raw row has kind, payload (JSON text), fetched_at and the strings of its source spec (slug, company, query, where,
tenant, site, host). Every normaliser is a declared schema, from_json, explode and a projection; a payload of the wrong
shape becomes one error row that names its source, never an exception and never silence.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, content_hash, cross_source_key, dollars, instant, plain_text, posting_id
from ..schemas import POSTING

# Declared payloads: only what is read.
GREENHOUSE = "struct<jobs: array<struct<id: string, company_name: string, title: string, absolute_url: string, location: struct<name: string>, metadata: array<struct<name: string, value: string>>, content: string, first_published: string>>>"
ASHBY = "struct<jobs: array<struct<id: string, title: string, jobUrl: string, location: string, secondaryLocations: array<struct<location: string>>, workplaceType: string, isListed: boolean, compensation: struct<scrapeableCompensationSalarySummary: string>, descriptionPlain: string, publishedAt: string>>>"
LEVER = "array<struct<id: string, text: string, hostedUrl: string, categories: struct<location: string, allLocations: array<string>>, workplaceType: string, descriptionPlain: string, lists: array<struct<text: string, content: string>>, additionalPlain: string, createdAt: bigint>>"
BREEZY = "array<struct<id: string, name: string, url: string, published_date: string, type: struct<name: string>, location: struct<name: string, is_remote: boolean>, department: string, salary: string, company: struct<name: string>>>"
REMOTIVE = "struct<jobs: array<struct<id: string, url: string, title: string, company_name: string, candidate_required_location: string, salary: string, description: string, publication_date: string>>>"
ADZUNA = "struct<results: array<struct<id: string, title: string, company: struct<display_name: string>, location: struct<display_name: string>, description: string, redirect_url: string, created: string, salary_min: double, salary_max: double, salary_is_predicted: string>>>"
USAJOBS = "struct<SearchResult: struct<SearchResultItems: array<struct<MatchedObjectDescriptor: struct<PositionID: string, PositionTitle: string, OrganizationName: string, PositionURI: string, PositionLocationDisplay: string, PositionRemuneration: array<struct<MinimumRange: string, MaximumRange: string, RateIntervalCode: string>>, PublicationStartDate: string, UserArea: struct<Details: struct<JobSummary: string, RemoteIndicator: boolean>>>>>>>"
WORKDAY_SEARCH = "struct<total: int, jobPostings: array<struct<title: string, externalPath: string, locationsText: string, bulletFields: array<string>>>>"
WORKDAY_DETAIL = "struct<jobPostingInfo: struct<id: string, title: string, jobDescription: string, location: string, startDate: string, jobReqId: string, jobPostingId: string, externalUrl: string, externalPath: string>>"

_TAG, _SPACES = re.compile(r"<[^>]+>"), re.compile(r"\s+")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _plain_each(texts: pd.Series) -> pd.Series:
    plain = lambda t: _SPACES.sub(" ", html.unescape(_TAG.sub(" ", html.unescape(t or "")))).strip()
    return texts.map(lambda own: [plain(t) for t in own], na_action="ignore")


def _present(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text)


def _says_remote(*texts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *texts)).contains("remote")


def _joined(parts: Column, separator: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), separator)


def greenhouse(j: Column, raw: Callable[[str], Column]) -> dict[str, Column]:
    place = j["location"]["name"]
    tagged = F.exists(F.coalesce(j["metadata"], F.array()), lambda m: (m["name"] == "Location Type") & (m["value"] == "Remote"))
    return dict(source_id=j["id"], company=j["company_name"], title=j["title"], url=j["absolute_url"], location=place, remote=F.coalesce(tagged, F.lit(False)) | _says_remote(place), markup=j["content"], posted_at=instant(j["first_published"]))


def ashby(j: Column, raw: Callable[[str], Column]) -> dict[str, Column]:
    places = F.concat(F.array(j["location"]), F.coalesce(F.transform(j["secondaryLocations"], lambda s: s["location"]), F.array().cast("array<string>")))
    return dict(
        source_id=j["id"], company=raw("company"), title=j["title"], url=j["jobUrl"], location=_present(_joined(places, ", ")), remote=F.lower(j["workplaceType"]) == "remote",
        salary=_present(j["compensation"]["scrapeableCompensationSalarySummary"]), description=j["descriptionPlain"], posted_at=instant(j["publishedAt"]), keep=F.coalesce(j["isListed"], F.lit(True)),
    )


def lever(j: Column, raw: Callable[[str], Column]) -> dict[str, Column]:
    offices = j["categories"]["allLocations"]
    lists = F.coalesce(j["lists"], F.array().cast("array<struct<text: string, content: string>>"))
    sections = F.flatten(F.zip_with(F.transform(lists, lambda s: s["text"]), _plain_each(F.transform(lists, lambda s: s["content"])), lambda t, c: F.array(t, c)))
    whole = F.concat(F.array(j["descriptionPlain"]), sections, F.array(j["additionalPlain"]))
    place = F.when(F.size(F.coalesce(offices, F.array())) > 0, F.array_join(offices, ", ")).otherwise(j["categories"]["location"])
    return dict(source_id=j["id"], company=raw("company"), title=j["text"], url=j["hostedUrl"], location=place, remote=j["workplaceType"] == "remote", description=_joined(whole, " "), posted_at=F.timestamp_millis(j["createdAt"]))


def breezy(j: Column, raw: Callable[[str], Column]) -> dict[str, Column]:
    place, salary = j["location"]["name"], j["salary"]
    company = F.coalesce(_present(raw("company")), _present(j["company"]["name"]), raw("slug"))
    said = lambda label, value: F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(label), F.trim(value), F.lit(".")))
    about = F.concat_ws(" ", F.concat(j["name"], F.lit(" at "), company, F.lit(".")), said("Team/department: ", j["department"]), said("Employment type: ", j["type"]["name"]), said("Location: ", place), said("Listed salary: ", salary), F.lit("(Metadata only; full JD on the posting.)"))
    return dict(source_id=j["id"], company=company, title=j["name"], url=j["url"], location=place, remote=F.coalesce(j["location"]["is_remote"], F.lit(False)) | _says_remote(place), salary=salary, description=about, posted_at=instant(j["published_date"]))


def remotive(j: Column, raw: Callable[[str], Column]) -> dict[str, Column]:
    return dict(source_id=j["id"], company=F.coalesce(j["company_name"], F.lit("")), title=j["title"], url=j["url"], location=_present(j["candidate_required_location"]), remote=F.lit(True), salary=_present(j["salary"]), markup=j["description"], posted_at=instant(j["publication_date"]))


def apply_url(url: Column) -> Column:
    """A `/land/ad/{id}` address as `/details/{id}` with its utm_ parameters only; any other address as it is."""
    ad = F.regexp_extract(url, r"^[^?#]*/land/ad/(\d+)/?(?:[?#].*)?$", 1)
    site = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p.startswith("utm_"))
    return F.when(ad != "", F.concat(site, F.lit("/details/"), ad, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))).otherwise(url)


def adzuna(j: Column, raw: Callable[[str], Column]) -> dict[str, Column]:
    place, low, high = j["location"]["display_name"], j["salary_min"], j["salary_max"]
    estimated = (j["salary_is_predicted"] == "1") & (low.isNotNull() | high.isNotNull())
    return dict(
        source_id=j["id"], company=F.coalesce(j["company"]["display_name"], F.lit("")), title=j["title"], url=apply_url(j["redirect_url"]), location=place, remote=None, salary=dollars(low, high),
        salary_is_estimated=F.coalesce(estimated, F.lit(False)), markup=j["description"], posted_at=instant(j["created"]),
    )


def usajobs(j: Column, raw: Callable[[str], Column]) -> dict[str, Column]:
    d = j["MatchedObjectDescriptor"]
    pay = F.try_element_at(d["PositionRemuneration"], F.lit(1))
    low, high = (F.expr("null").cast("double") if c is None else c.try_cast("double") for c in (F.coalesce(_present(pay["MinimumRange"]), pay["MaximumRange"]), F.coalesce(_present(pay["MaximumRange"]), pay["MinimumRange"])))
    # Suffixes of pay intervals.
    suffix = F.coalesce(F.create_map(*map(F.lit, ("PA", "/yr", "PH", "/hr", "PD", "/day")))[pay["RateIntervalCode"]], F.lit(""))
    salary = F.when(low.isNotNull() & high.isNotNull(), F.concat(dollars(low, high), suffix))
    details = d["UserArea"]["Details"]
    return dict(source_id=d["PositionID"], company=F.coalesce(d["OrganizationName"], F.lit("")), title=d["PositionTitle"], url=F.coalesce(d["PositionURI"], F.lit("")), location=_present(d["PositionLocationDisplay"]), remote=F.coalesce(details["RemoteIndicator"], F.lit(False)), salary=salary, markup=details["JobSummary"], posted_at=instant(d["PublicationStartDate"]))


def workday(j: Column, raw: Callable[[str], Column]) -> dict[str, Column]:
    place = _present(j["location"])
    request = F.coalesce(_present(j["jobReqId"]), _present(j["jobPostingId"]), j["id"])
    url = F.coalesce(_present(j["externalUrl"]), F.concat(F.lit("https://"), raw("host"), F.lit("/"), raw("site"), F.coalesce(j["externalPath"], F.lit(""))))
    return dict(source_id=F.concat_ws(":", raw("tenant"), request), company=raw("company"), title=j["title"], url=url, location=place, remote=_says_remote(place), markup=j["jobDescription"], posted_at=instant(j["startDate"]))


#: kind: payload schema, the array of postings in it, normaliser, whether the payload is a bare list, required fields.
BOARDS: dict[str, tuple[str, Callable[[Column], Column], Callable, bool]] = {
    "greenhouse": (GREENHOUSE, lambda p: p["jobs"], greenhouse, False),
    "ashby": (ASHBY, lambda p: p["jobs"], ashby, False),
    "lever": (LEVER, lambda p: p, lever, True),
    "breezy": (BREEZY, lambda p: p, breezy, True),
    "remotive": (REMOTIVE, lambda p: p["jobs"], remotive, False),
    "adzuna": (ADZUNA, lambda p: p["results"], adzuna, False),
    "usajobs": (USAJOBS, lambda p: p["SearchResult"]["SearchResultItems"], usajobs, False),
    "workday": (WORKDAY_DETAIL, lambda p: F.when(p["jobPostingInfo"].isNotNull(), F.array(p["jobPostingInfo"])), workday, False),
}
#: Where the postings stand in the payloads.
PATHS = {"greenhouse": ("jobs",), "ashby": ("jobs",), "lever": (), "breezy": (), "remotive": ("jobs",), "adzuna": ("results",), "usajobs": ("SearchResult", "SearchResultItems"), "workday": ("jobPostingInfo",)}
SPEC_FIELDS = ("slug", "company", "query", "where", "tenant", "site", "host")


def label(raw: DataFrame) -> Column:
    detail = F.coalesce(*[_present(F.col(c)) for c in ("company", "slug", "query")])
    return F.when(detail.isNotNull(), F.concat_ws(":", F.col("kind"), detail)).otherwise(F.col("kind"))


def _items(kind: Column) -> Column:
    """The postings in a payload, each in the field of its kind of a struct that has one for every kind; null for a payload of the wrong shape."""
    first = F.substring(F.regexp_extract("payload", r"(\S)", 1), 1, 1)
    types = {k: T._parse_datatype_string(schema) for k, (schema, _, _, _) in BOARDS.items()}
    out = F.when(F.lit(False), F.lit(None))
    for k, (schema, of, _, bare) in BOARDS.items():
        item = _item_type(types[k], k).simpleString()
        empty = {n: F.lit(None).cast(_item_type(t, n)) for n, t in types.items()}
        placed = lambda x: F.struct(*[c.alias(n) for n, c in (empty | {k: x}).items()])  # noqa: B023, E731 - called at once
        listed = of(F.from_json("payload", schema, {"mode": "PERMISSIVE"})).cast(f"array<{item}>")
        out = out.when((kind == k) & (first == ("[" if bare else "{")), F.transform(listed, placed))
    return out


def _item_type(payload: T.DataType, kind: str) -> T.DataType:
    """The type of one posting in a payload."""
    for name in PATHS[kind]:
        payload = payload[name].dataType
    return payload.elementType if isinstance(payload, T.ArrayType) else payload


def normalised(raw: DataFrame) -> DataFrame:
    """All kinds in one pass over the rows: POSTING columns and error. A payload of the wrong shape and an unknown kind are error rows.

    A row is parsed by the schema of its own kind only, its postings are exploded once, and every output column picks the
    kind's expression; so neither the rows nor the payloads are read again for each kind.
    """
    kind = F.col("kind")
    rows = raw.withColumns({"__label": label(raw), "__items": _items(kind)})
    known = kind.isin(*BOARDS)
    rows = rows.where(F.col("__items").isNull() | (F.size("__items") > 0)).drop("payload")
    each = rows.select("*", F.explode_outer("__items").alias("__j")).drop("__items")
    own = {k: normalise(F.col("__j")[k], F.col) for k, (_, _, normalise, _) in BOARDS.items()}

    def picked(name: str, default: Column | None = None) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for k, fields in own.items():
            if fields.get(name) is not None:
                out = out.when(kind == k, fields[name])
        return out if default is None else out.otherwise(default)

    each = each.where(F.col("__j").isNull() | picked("keep", F.lit(True)))
    text, guessed = F.lit(None).cast("string"), [k for k, f in own.items() if "remote" not in f or f["remote"] is None]
    each = each.withColumns({c: picked(c, text) for c in ("source_id", "company", "title", "url", "location", "salary")} | {
        "posted_at": picked("posted_at", F.lit(None).cast("timestamp")), "salary_is_estimated": picked("salary_is_estimated", F.lit(False)), "__remote": picked("remote", F.lit(None).cast("boolean")),
        "__markup": picked("markup", text), "__said": picked("description", text),
    })
    marked = kind.isin(*[k for k, f in own.items() if "markup" in f])
    each = each.withColumn("__plain", plain_text(F.col("__markup")))
    each = each.withColumn("description", F.when(marked, F.col("__plain")).otherwise(collapse(F.coalesce("__said", F.lit("")))))
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("source_id", "title", "url", "company")]))
    error = (
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.col("__label"), F.lit(": no fetcher registered for kind "), kind))
        .when(F.col("__j").isNull(), F.concat(F.col("__label"), F.lit(": FetchError: unexpected "), kind, F.lit(" payload")))
        .when(F.size(lacking) > 0, F.concat(F.col("__label"), F.lit(": FetchError: missing "), F.array_join(lacking, ", ")))
    )
    says = F.when(kind.isin(*guessed), _says_remote(F.col("title"), F.col("location"), F.col("description"))).otherwise(F.col("__remote"))
    each = each.withColumns({
        "error": error, "source": kind, "remote": F.coalesce(says, F.lit(False)), "id": posting_id(kind, F.col("source_id")),
        "content_hash": content_hash(F.col("description")), "cross_source_key": cross_source_key(F.col("company"), F.col("title"), F.col("location")),
    })
    # a row without a posting says nothing but what went wrong
    whole = F.col("__j").isNotNull()
    return each.select(*[F.when(whole, F.col(c)).alias(c) for c in POSTING.names], "error")


def postings(raw: DataFrame) -> DataFrame:
    return normalised(raw).where(F.col("error").isNull()).drop("error")


def errors(raw: DataFrame) -> DataFrame:
    return normalised(raw).where(F.col("error").isNotNull()).select("error")


def workday_stubs(raw: DataFrame) -> DataFrame:
    """First stage of the two-stage board: search results with a title and a path, before anything is hydrated."""
    items = F.explode(F.from_json("payload", WORKDAY_SEARCH)["jobPostings"])
    stubs = raw.where(F.col("kind") == "workday").select("*", items.alias("__s"))
    stubs = stubs.where((F.coalesce("__s.title", F.lit("")) != "") & (F.coalesce("__s.externalPath", F.lit("")) != ""))
    return stubs.select(*[c for c in SPEC_FIELDS if c in raw.columns], "fetched_at", F.col("__s.title").alias("title"), F.col("__s.externalPath").alias("external_path"), F.coalesce("__s.locationsText", F.lit("")).alias("location"), F.try_element_at("__s.bulletFields", F.lit(1)).alias("req_id"))


def workday_site(robots: Column) -> Column:
    """The site segment that a robots.txt names on its Sitemap line; null where it names none."""
    return F.nullif(F.regexp_extract(robots, r"(?im)^Sitemap:\s*https?://[^/]+/([^/]+)/", 1), F.lit(""))
