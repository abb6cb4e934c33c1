from __future__ import annotations

import json
from datetime import datetime

import pytest

from jobweave import api, web
from jobweave.operators.store import Store
from jobweave.operators.vectors import HashingEncoder, embed
from jobweave.operators.writes import Writes
from jobweave.sources import postings as boards
from jobweave.sources import specs
from jobweave.streaming.ingest import ingest

NOW = datetime(2026, 7, 16, 9)
HTML = "&lt;p&gt;Build &amp;amp; run&lt;/p&gt;"
PAYLOADS = {
    "greenhouse": {"jobs": [
        {"id": 7, "company_name": "Acme", "title": "DE", "absolute_url": "u", "location": {"name": "Sydney"}, "metadata": [{"name": "Location Type", "value": "Remote"}], "content": HTML, "first_published": "2031-03-04T21:40:05-05:00"},
        {"id": 8, "company_name": "Acme", "title": "DE", "absolute_url": "u", "location": {"name": "Remote-Friendly"}, "metadata": None},
        {"id": 9, "company_name": "Acme", "title": "DE", "absolute_url": "u", "location": {"name": "Boston, MA"}, "first_published": "junk"},
    ]},
    "ashby": {"jobs": [
        {"id": "a", "title": "DE", "jobUrl": "u", "location": "NYC", "secondaryLocations": [{"location": "Remote (US)"}], "workplaceType": "Remote", "isListed": True, "compensation": {"scrapeableCompensationSalarySummary": "$1K"}, "descriptionPlain": "x  y", "publishedAt": "2031-01-02T03:04:05.000+00:00"},
        {"id": "b", "title": "DE", "jobUrl": "u", "isListed": False}, {"id": "c", "title": "DE", "jobUrl": "u"},
    ]},
    "lever": [{"id": "l", "text": "DE", "hostedUrl": "u", "categories": {"location": "Oslo", "allLocations": ["Oslo", "London"]}, "workplaceType": "remote", "descriptionPlain": "intro", "lists": [{"text": "You", "content": "<li>a &amp; b</li>"}], "additionalPlain": "end", "createdAt": 1930000000250}],
    "breezy": [{"id": "z", "name": "DE", "url": "u", "type": {"name": "Full-Time"}, "location": {"name": "Remote, US", "is_remote": False}, "department": "Data"}],
    "remotive": {"0-legal": "x", "jobs": [{"id": 5, "url": "u", "title": "DE", "company_name": "R", "candidate_required_location": "", "description": "<b>x</b>", "publication_date": "2031-08-02T04:03:02"}]},
    "adzuna": {"results": [
        {"id": "1", "title": "DE (Remote)", "company": {"display_name": "Z"}, "location": {"display_name": "Peoria, Peoria County"}, "description": "d", "redirect_url": "https://www.adzuna.com/land/ad/90417?se=T&utm_medium=api&utm_source=own&v=X", "salary_min": 73500.0, "salary_max": 73500.0, "salary_is_predicted": "1"},
        {"id": "2", "title": "DE", "description": "d", "redirect_url": "https://example.com/x", "salary_min": 40100.0, "salary_max": 52250.0, "salary_is_predicted": "0"},
    ]},
    "usajobs": {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {"PositionID": "P", "PositionTitle": "DE", "OrganizationName": "Bureau of Tests", "PositionURI": "u", "PositionLocationDisplay": "Tampa, Florida", "PositionRemuneration": [{"MinimumRange": "61000", "MaximumRange": "88500", "RateIntervalCode": "PA"}], "PublicationStartDate": "2031-11-05T00:00:00.0000", "UserArea": {"Details": {"JobSummary": "s", "RemoteIndicator": True}}}}]}},
    "workday": {"jobPostingInfo": {"id": "i", "title": "DE", "jobDescription": "<p>x</p>", "location": "Remote VA", "startDate": "2031-09-09", "jobReqId": "REQ-9", "externalPath": "/job/x"}},
}
RAW = "kind string, payload string, fetched_at timestamp, slug string, company string, query string, where string, tenant string, site string, host string"


def raw(spark, items):
    return spark.createDataFrame([(k, p, NOW, "slug", "Co", "q", "", "orgx", "External", "orgx.wd5.myworkdayjobs.com") for k, p in items], RAW)


def test_normalisers(spark):
    out = {(r["source"], r["source_id"]): r for r in boards.postings(raw(spark, [(k, json.dumps(p)) for k, p in PAYLOADS.items()])).collect()}
    g = out["greenhouse", "7"]
    assert g["remote"] and g["description"] == "Build & run" and g["posted_at"] == datetime(2031, 3, 5, 2, 40, 5) and g["salary"] is None
    assert out["greenhouse", "8"]["remote"] and not out["greenhouse", "9"]["remote"] and out["greenhouse", "9"]["posted_at"] is None
    a = out["ashby", "a"]
    assert a["location"] == "NYC, Remote (US)" and a["remote"] and a["salary"] == "$1K" and a["company"] == "Co"
    assert ("ashby", "b") not in out and out["ashby", "c"]["location"] is None and not out["ashby", "c"]["remote"]
    lever = out["lever", "l"]
    assert lever["location"] == "Oslo, London" and lever["description"] == "intro You a & b end" and lever["posted_at"] == datetime(2031, 2, 27, 23, 6, 40, 250000)
    assert out["breezy", "z"]["description"] == "DE at Co. Team/department: Data. Employment type: Full-Time. Location: Remote, US. (Metadata only; full JD on the posting.)" and out["breezy", "z"]["remote"]
    assert out["remotive", "5"]["remote"] and out["remotive", "5"]["location"] is None and out["remotive", "5"]["posted_at"] == datetime(2031, 8, 2, 4, 3, 2)
    z = out["adzuna", "1"]
    assert (z["url"], z["salary"], z["salary_is_estimated"], z["remote"]) == ("https://www.adzuna.com/details/90417?utm_medium=api&utm_source=own", "$73,500", True, True)
    assert (out["adzuna", "2"]["salary"], out["adzuna", "2"]["salary_is_estimated"], out["adzuna", "2"]["url"], out["adzuna", "2"]["company"]) == ("$40,100 - $52,250", False, "https://example.com/x", "")
    u = out["usajobs", "P"]
    assert u["salary"] == "$61,000 - $88,500/yr" and u["remote"] and u["posted_at"] == datetime(2031, 11, 5)
    w = out["workday", "orgx:REQ-9"]
    assert w["remote"] and w["url"] == "https://orgx.wd5.myworkdayjobs.com/External/job/x" and w["posted_at"] == datetime(2031, 9, 9)


@pytest.mark.parametrize(("kind", "payload"), [("greenhouse", "[]"), ("lever", '{"id": "x"}'), ("adzuna", '{"exception": "AUTH"}'), ("usajobs", "not json"), ("remotive", None), ("breezy", '{"error": 1}'), ("workday", "{}"), ("greenhouse", '{"jobs": [{"id": 1}]}')])
def test_wrong_payloads_are_error_rows(spark, kind, payload):
    rows = raw(spark, [(kind, payload)])
    assert boards.postings(rows).count() == 0
    assert boards.errors(rows).first()["error"].startswith(f"{kind}:Co: FetchError")


def test_empty_boards_and_unknown_kinds(spark):
    rows = raw(spark, [("breezy", "[]"), ("greenhouse", '{"jobs": []}'), ("monster", "{}")])
    assert boards.postings(rows).count() == 0
    assert [r["error"] for r in boards.errors(rows).collect()] == ["monster:Co: no fetcher registered for kind monster"]


def test_workday_stubs_and_site(spark):
    payload = {"total": 2, "jobPostings": [{"title": "DE", "externalPath": "/job/1", "locationsText": "VA", "postedOn": "Today", "bulletFields": ["REQ-9"]}, {"bulletFields": ["REQ-8"]}]}
    stubs = boards.workday_stubs(raw(spark, [("workday", json.dumps(payload))])).collect()
    assert [(s["title"], s["req_id"]) for s in stubs] == [("DE", "REQ-9")]
    from pyspark.sql import functions as F

    text = spark.createDataFrame([("User-agent: *\nSitemap: https://orgx.wd5.myworkdayjobs.com/External_Site/siteMap.xml",), ("none",)], "t string")
    assert [r[0] for r in text.select(boards.workday_site(F.col("t"))).collect()] == ["External_Site", None]


def test_two_stages_pages_and_discovery(spark):
    from pyspark.sql import functions as F

    payload = {"jobPostings": [{"title": t, "externalPath": f"/job/{t}"} for t in ("a", "b", "c")]}
    stubs = boards.workday_stubs(raw(spark, [("workday", json.dumps(payload))]))

    def transport(spec):
        if spec["title"] == "b":
            raise TimeoutError("gone")
        return json.dumps({"jobPostingInfo": {"title": spec["title"], "jobReqId": spec["external_path"], "externalUrl": "u"}})

    got = specs.hydrated(stubs, transport, F.col("title") != "c", tasks=1)
    assert [r["source_id"] for r in boards.postings(got.where("payload is not null")).collect()] == ["orgx:/job/a"]
    assert got.where("error like '%gone'").count() == 1 and got.count() == 2
    pages = [list(range(3)), list(range(3)), [9]]
    assert specs.paged(lambda n, so_far: pages[n], 3, 100) == [0, 1, 2, 0, 1, 2, 9] and specs.paged(lambda n, so_far: pages[0], 3, 4) == [0, 1, 2, 0]
    found = specs.discover_workday("x", lambda url: "Sitemap: https://x.wd3.myworkdayjobs.com/Jobs/s.xml" if ".wd3." in url else None)
    assert found == ("Jobs", "x.wd3.myworkdayjobs.com") and specs.discover_workday("x", lambda url: None) is None


def test_specs_and_fetch(spark):
    rows = specs.source_specs(spark)
    assert rows.count() == 129 and rows.where("kind = 'usajobs' and remote_only").count() == 2 and rows.where("kind = 'adzuna' and distance = 60").count() == 4

    def transport(spec):
        if spec["slug"] == "plaid":
            raise TimeoutError("too slow")
        return "{}"

    got = specs.fetched(rows.where("slug in ('plaid', 'ramp')"), transport, tasks=2).collect()
    assert {(r["slug"], r["payload"], r["error"]) for r in got} == {("plaid", None, "ashby:Plaid: TimeoutError: too slow"), ("ramp", "{}", None)}


def test_profile_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"email": "a@b", "skills": ["x"]}, indent=1))
    with pytest.raises(ValueError, match="headline"):
        specs.profile(spark, f"file://{tmp_path}/p.json")


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('api')}/store")
    rows = boards.postings(raw(spark, [("greenhouse", json.dumps(PAYLOADS["greenhouse"]))]))
    Writes(store).upsert_postings(rows)
    Writes(store).replace_vectors(embed(store.read("job_postings"), HashingEncoder, "hashing-64", 64))
    Writes(store).seed_profile({"email": "a@b", "headline": "h", "skills": ["s"]}, NOW)
    provider = type("P", (), {"complete": lambda self, p: "Dear"})()
    return api.Tools(store, 1, HashingEncoder(), provider, lambda: NOW)


def test_tools(tools):
    found = tools.search_jobs("build run", top_k=5)["jobs"]
    assert found and "description" not in found[0] and found[0]["similarity"] == round(found[0]["similarity"], 4)
    job = found[0]["id"]
    assert tools.get_job(job)["description"] == "Build & run" and tools.get_job("nope")["error_type"] == "not_found"
    assert tools.search_jobs(" ")["error_type"] == "bad_request"
    assert tools.save_job(job, "n")["note"] == "n" and tools.save_job("nope")["error_type"] == "not_found"
    application = tools.log_application(job)["id"]
    assert tools.update_application_status(application, "offer")["status"] == "offer" and tools.update_application_status(application, "huh")["error_type"] == "bad_request"
    assert tools.add_interview_note(application, "x")["note"] == "x" and tools.add_interview_note(99, "x")["error_type"] == "not_found"
    assert str(tools.set_follow_up(application, "2026-08-01")["follow_up_on"]) == "2026-08-01"
    assert tools.list_applications()["applications"][0]["notes"][0]["note"] == "x"
    assert tools.add_contact("Acme", "Ann")["id"] == 1 and tools.get_profile()["skills"] == ["s"]
    assert tools.draft_application_text(job, "outreach") == {"kind": "outreach", "text": "Dear"}
    assert api.Tools(type("Broken", (), {"read": lambda self, t: 1 / 0, "spark": None})(), 1, None).get_profile()["error_type"] == "internal_error"
    assert not [m for m in dir(tools) if "delete" in m]


def test_relay():
    said = [{"role": r, "content": str(k)} for k in range(12) for r in ("user", "assistant")] + [{"role": "user", "content": "last"}]
    kept = web.turns({"messages": said})
    assert kept[0] == {"role": "user", "content": "5"} and sum(t["role"] == "user" for t in kept) == 8
    assert web.recent(said[:4]) == said[:4] and web.recent([{"type": "call"}, *said[:16]])[0] == {"type": "call"}
    assert web.turns({"message": " hi "}) == [{"role": "user", "content": "hi"}]
    replay = [{"role": "user", "content": "x"}, {"type": "call", "id": 1}, {"type": "result", "id": 1}, {"role": "user", "content": "y"}]
    assert web.turns({"items": replay}) == replay
    for bad in ({}, {"message": 3}, {"messages": []}, {"messages": "x"}, {"messages": [{"role": "system", "content": "x"}]}, {"messages": [{"role": "assistant", "content": "x"}]}, {"items": [{"role": "tool"}]}, {"items": [3]}):
        with pytest.raises(ValueError):
            web.turns(bad)
    assert web.reply_text({"output": [{"content": [{"text": "a"}, {"text": "b"}]}, {"type": "call"}]}) == "a\nb"
    assert web.reply_text({"choices": [{"message": {"content": "c"}}]}) == "c" and web.reply_text({"odd": 1}) == "{'odd': 1}" and web.reply_text("plain") == "plain" and web.reply_text({"answer": "d"}) == "d"
    assert web.authorised("/healthz", None, "t") and web.authorised("/mcp", "Bearer t", "t") and not web.authorised("/mcp", "Bearer x", "t")
    asked = []

    def post(answers):
        def send(body):
            asked.append(next(iter(body)))
            return answers.pop(0)

        return send

    assert web.Relay(None).chat({"message": "x"})[1] == 501 and web.Relay(post([])).chat({})[1] == 400
    body, status = web.Relay(post([(400, "no"), (200, json.dumps({"output": [{"content": "yes"}]}))])).chat({"message": "x"})
    assert status == 200 and body == {"reply": "yes", "items": [{"content": "yes"}]} and asked == ["input", "messages"]
    assert web.Relay(post([(503, "secret"), (200, "{}")])).chat({"message": "x"}) == ({"error": "The agent returned HTTP 503."}, 502) and asked[2:] == ["input"]
    assert "HTTP 404" in web.Relay(post([(404, "")] * 2)).chat({"message": "x"})[0]["error"]
    assert web.Relay(post([])).chat({"message": "x"}) == ({"error": "The agent is unreachable (IndexError)."}, 502)


def test_pages_and_actions(tools):
    pages, act = web.Pages(tools), web.Actions(tools)
    first = pages.search({"page": "x", "days": "many"})
    job = first["jobs"][0]["id"]
    assert (first["total"], first["pages"], first["page"], first["sources"]) == (3, 1, 1, ["greenhouse"]) and first["jobs"][0]["band"] == "none"
    assert pages.search({"source": "nobody"})["pages"] == 1 and pages.search({"remote": "on"})["total"] == 2
    near = pages.search({"q": "build run"})
    assert near["jobs"] and near["pages"] == 1 and near["total"] == len(near["jobs"])
    assert act.save({"job_id": " "})[1] == 400 and act.save({"job_id": job, "note": "n"}) == ({"saved": True}, 200) and pages.saved()["total"] == 1
    assert act.save({"job_id": job, "unsave": True}) == ({"saved": False}, 200) and pages.saved()["jobs"] == []
    body, status = act.apply({"job_id": job, "note": "said"})
    assert status == 200 and body["status"] == "applied" and act.apply({"job_id": job, "status": "odd"})[1] == 400
    shown = pages.applied({})["applications"]
    assert [n["note"] for n in shown[0]["notes"]][-1] == "said" or any(n["note"] == "said" for n in shown[0]["notes"])
    assert act.status({"application_id": body["application_id"], "status": "offer"}) == ({"status": "offer"}, 200) and act.status({"application_id": 77, "status": "offer"})[1] == 404 and act.status({})[1] == 400
    assert act.note({"application_id": body["application_id"], "note": "x"}) == ({"added": True}, 200) and act.note({"application_id": 77, "note": "x"})[1] == 404
    assert act.draft({"job_id": job}) == ({"kind": "cover_letter", "text": "Dear"}, 200) and act.draft({"job_id": "none"})[1] == 404
    assert pages.job("none") is None and pages.job(job)["job"]["id"] == job and pages.status()[1] == 200
    seen = pages.insights()
    assert seen["by_day"] == [] and seen["created"] == [] and seen["computed_at"] is None
    assert tools.match_profile(top_k=2)["jobs"]


def test_stream(spark, tmp_path):
    rows = boards.postings(raw(spark, [("greenhouse", json.dumps(PAYLOADS["greenhouse"]))]))
    rows.union(rows).write.parquet(f"file://{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/check").awaitTermination(120)
    assert store.read("job_postings").count() == 2 and store.version("job_postings") == 1


def test_all_kinds_are_normalised_in_one_pass(spark, tmp_path):
    raw(spark, [(k, json.dumps(p)) for k, p in PAYLOADS.items()] + [("lever", "{}"), ("odd", "{}"), ("adzuna", '{"results": []}'), ("usajobs", None)]).write.parquet(f"{tmp_path}/raw")
    out = boards.normalised(spark.read.parquet(f"{tmp_path}/raw"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan and plan.count("Generate explode") == 1
    errors = sorted(r["error"] for r in out.where("error IS NOT NULL").collect())
    assert errors == ["lever:Co: FetchError: unexpected lever payload", "odd:Co: no fetcher registered for kind odd", "usajobs:Co: FetchError: unexpected usajobs payload"]
