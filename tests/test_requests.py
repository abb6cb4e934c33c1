from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from jobweave.operators import scoring
from jobweave.sources import database, run, specs
from jobweave.sources import postings as boards
from jobweave.sources.requests import Boards, Credentials, FetchError, Reply

KEYS = Credentials("id1", "key1", "me@own.example", "key2")
BLANK = dict(slug="", company="", query="", where="", tenant="", site="", host="", distance=None, max_days_old=None, max_results=None, remote_only=False)


def spec(kind, **own):
    return BLANK | {"kind": kind} | own


class Net:
    """Answers requests from a table of addresses and remembers them."""

    def __init__(self, answer):
        self.answer, self.seen = answer, []

    def __call__(self, request):
        self.seen.append(request)
        got = self.answer(request)
        return got if isinstance(got, Reply) else Reply(200, json.dumps(got))


@pytest.mark.parametrize(("own", "address"), [
    (spec("greenhouse", slug="s"), "https://boards-api.greenhouse.io/v1/boards/s/jobs?content=true"),
    (spec("ashby", slug="s"), "https://api.ashbyhq.com/posting-api/job-board/s?includeCompensation=true"),
    (spec("lever", slug="s"), "https://api.lever.co/v0/postings/s?mode=json"),
    (spec("breezy", slug="s"), "https://s.breezy.hr/json"),
    (spec("remotive", query="a b"), "https://remotive.com/api/remote-jobs?search=a+b"),
    (spec("usajobs", query="q", where="Here", distance=40.0, remote_only=True), "https://data.usajobs.gov/api/search?Keyword=q&ResultsPerPage=25&LocationName=Here&Radius=40&RemoteIndicator=True"),
])
def test_each_board_is_asked_at_its_address(own, address):
    net = Net(lambda r: {"jobs": []})
    assert json.loads(Boards(KEYS, net)(own)) == {"jobs": []} and [r.address for r in net.seen] == [address]
    if own["kind"] == "usajobs":
        assert net.seen[0].headers["Authorization-Key"] == "key2" and net.seen[0].headers["User-Agent"] == "me@own.example"


def test_paged_boards_are_read_to_a_short_page_or_enough_rows():
    pages = {1: list(range(50)), 2: list(range(50, 70))}
    net = Net(lambda r: {"results": pages[int(r.url.rsplit("/", 1)[1])]})
    got = json.loads(Boards(KEYS, net)(spec("adzuna", query="data", where="Town", distance=40, max_days_old=float("nan"), max_results=200)))
    assert got["results"] == list(range(70)) and len(net.seen) == 2
    assert dict(net.seen[0].params) == {"app_id": "id1", "app_key": "key1", "what_phrase": "data", "results_per_page": 50, "sort_by": "date", "where": "Town", "distance": 40}
    assert len(json.loads(Boards(KEYS, net)(spec("adzuna", query="data", max_results=25)))["results"]) == 25
    hits = [{"title": str(k), "externalPath": f"/{k}"} for k in range(33)]
    net = Net(lambda r: {"total": 9, "jobPostings": hits[r.body["offset"] : r.body["offset"] + r.body["limit"]]})
    own = spec("workday", query="q", tenant="t", site="S", host="t.wd1.example", max_results=100)
    assert json.loads(Boards(KEYS, net)(own))["jobPostings"] == hits and [r.body["offset"] for r in net.seen] == [0, 20, 33]
    assert net.seen[0].url == "https://t.wd1.example/wday/cxs/t/S/jobs"


@pytest.mark.parametrize(("reply", "words"), [(Reply(404, ""), "HTTP 404"), (Reply(200, "<html>"), "non-JSON"), (OSError("down"), "unreachable: down")])
def test_what_goes_wrong_is_named(reply, words):
    def answer(request):
        if isinstance(reply, Exception):
            raise reply
        return reply

    with pytest.raises(FetchError, match=f"lever s.*{words}"):
        Boards(KEYS, answer)(spec("lever", slug="s"))


def test_keys_are_needed_and_never_shown():
    with pytest.raises(FetchError, match="ADZUNA_APP_ID and ADZUNA_APP_KEY"):
        Boards(Credentials.from_env({}), None)(spec("adzuna", query="q"))
    with pytest.raises(FetchError, match="USAJOBS_API_KEY"):
        Boards(Credentials.from_env({"USAJOBS_EMAIL": "x"}), None)(spec("usajobs", query="q"))
    with pytest.raises(FetchError, match="no fetcher"):
        Boards(KEYS, None)(spec("monster"))
    assert "key1" not in repr(KEYS) and "key2" not in repr(KEYS)


def answer(request):
    if "greenhouse" in request.url:
        return Reply(200, json.dumps({"jobs": [{"id": 1, "company_name": "C", "title": "T", "absolute_url": "u"}]}))
    if request.url.endswith("/jobs"):
        return Reply(200, json.dumps({"jobPostings": [{"title": t, "externalPath": f"/{t}"} for t in ("yes", "no", "gone")] if request.body["offset"] == 0 else []}))
    if request.url.endswith("/yes"):
        return Reply(200, json.dumps({"jobPostingInfo": {"title": "yes", "jobReqId": "R", "externalUrl": "u"}}))
    return Reply(500, "")


def test_a_full_run_lands_postings_and_reports_failures(spark, tmp_path):
    rows = [spec("greenhouse", slug="g", company="G"), spec("lever", slug="l", company="L"), spec("workday", tenant="t", site="S", host="h", company="W", query="q", max_results=10)]
    names = [f.split()[0] for f in specs.SPEC_SCHEMA.split(", ")]
    own = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], specs.SPEC_SCHEMA)
    raw = run.land(own, Boards(KEYS, answer), f"file://{tmp_path}/landed", F.col("title") != "no", tasks=2)
    assert sorted((r["source"], r["source_id"]) for r in boards.postings(raw.where("payload IS NOT NULL")).collect()) == [("greenhouse", "1"), ("workday", "t:R")]
    count, first = run.report(raw)
    assert count == 2 and first[0].startswith("lever:L: FetchError: lever l returned HTTP 500") and "gone returned HTTP 500" in first[1]
    assert run.report(raw, 1)[1] == first[:1]


def test_a_database_is_read_in_ranges_of_its_key(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("twice")).write.format("jdbc").options(url=url, dbtable="numbers", **driver).save()
    got = database.snapshot(spark, url, "numbers", ["twice"], key="id", partitions=4, **driver)
    assert got.columns == ["twice"] and got.rdd.getNumPartitions() == 4 and got.agg(F.sum("twice")).first()[0] == 9900


class Client:
    def __init__(self, text):
        self.text, self.calls = text, []

    def invoke_model(self, modelId, body):
        self.calls.append((modelId, json.loads(body)))
        return {"body": io.BytesIO(self.text.encode())}


def test_backends_and_their_factory():
    good = {"choices": [{"message": {"content": "said"}}]}
    net = Net(lambda r: good)
    for name, own in (("openrouter", {}), ("databricks", {"host": "https://h/"})):
        backend = scoring.provider(name, api_key="secret", send=net, **own)
        assert backend.complete("p") == "said" and net.seen[-1].body["messages"][0]["content"] == "p" and net.seen[-1].headers["Authorization"] == "Bearer secret"
        assert "secret" not in repr(backend.backend)
    client = Client(json.dumps({"content": [{"text": "so"}]}))
    assert scoring.provider("bedrock", "m", client=client).complete("p") == "so" and client.calls[0][0] == "m" and "model" not in client.calls[0][1]
    assert scoring.provider(env={"SCORER_BACKEND": "openrouter", "OPENROUTER_API_KEY": "k", "SCORER_MODEL": "own"}, send=net).name == "own"
    for own, words in ((dict(backend="abacus"), "unknown"), (dict(backend="openrouter", env={}), "api_key"), (dict(backend="databricks", api_key="k", env={}), "host"), (dict(backend="bedrock", env={}), "client")):
        with pytest.raises(scoring.ScoringFailed, match=words):
            scoring.provider(**own)
    for reply, words in ((Reply(429, ""), "HTTP 429"), (Reply(200, "oops"), "non-JSON"), (Reply(200, '{"error": "quota"}'), "quota"), (Reply(200, '{"choices": []}'), "unexpected shape")):
        with pytest.raises(scoring.ScoringFailed, match=words):
            scoring.provider("openrouter", api_key="k", send=lambda r, reply=reply: reply).complete("p")
