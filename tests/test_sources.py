"""Readers of board bodies, HTML to text, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from jobmill.functions.html import to_text
from jobmill.sources.boards import BOARDS, bad_bodies, read_bodies, read_html, read_json, read_xml

BODIES = {
    "greenhouse": ({"jobs": [{"id": 1, "title": "Data Engineer", "location": {"name": "Remote, Austria"}, "first_published": "2026-01-02T03:04:05Z", "absolute_url": "https://x.example/1", "content": "&lt;p&gt;Hello&lt;/p&gt;", "company_name": "Acme"}]}, {"posting_id": "1", "remote": True, "description": "Hello", "company": "Acme"}),
    "lever": ([{"id": "a", "text": "Tester", "categories": {"location": "Lyon", "allLocations": ["Lyon", "Paris"], "commitment": "Full-time"}, "workplaceType": "hybrid", "createdAt": 1700000000000, "descriptionPlain": "Do it"}], {"location": "Lyon / Paris", "remote": False, "posted": "1700000000000", "employment_type": "Full-time"}),
    "ashby": ({"jobs": [{"id": "h", "title": "Hidden", "isListed": False}, {"id": "b", "title": " Writer ", "location": "Pune", "secondaryLocations": [{"location": "Goa"}], "isRemote": False}]}, {"posting_id": "b", "title": "Writer", "location": "Pune / Goa", "remote": False}),
    "smartrecruiters": ({"content": [{"id": "9", "name": "Nurse", "location": {"city": "Wien", "country": "at", "remote": True}}]}, {"location": "Wien, at", "remote": True, "url": "https://jobs.smartrecruiters.com/acme/9"}),
    "recruitee": ({"offers": [{"id": 5, "title": "Chef", "locations": [{"name": "Oslo"}, {"name": "Oslo"}], "description": "<p>A</p>", "requirements": "<p>B</p>"}]}, {"location": "Oslo", "description": "A\n\nB"}),
    "rippling": ([{"uuid": "u", "name": "Pilot", "workLocation": {"label": "Remote (US)"}}], {"posting_id": "u", "remote": True}),
    "workable": ({"name": "Acme", "jobs": [{"shortcode": "s", "title": "Cook", "city": "Rome", "country": "Italy"}]}, {"location": "Rome, Italy", "remote": None}),
    "bamboohr": ({"result": [{"id": 3, "jobOpeningName": "Clerk", "location": {"city": "Cork"}, "atsLocation": {"country": "Ireland"}}]}, {"location": "Cork, Ireland", "url": "https://acme.bamboohr.com/careers/3"}),
    "eightfold": ({"positions": [{"id": 4, "name": "Actor", "locations": ["A", "B"]}]}, {"location": "A / B"}),
    "oracle": ({"items": [{"requisitionList": [{"Id": "7", "Title": "Sales", "PrimaryLocation": "Delhi", "secondaryLocations": [{"Name": "Agra"}]}]}]}, {"location": "Delhi / Agra"}),
    "workday": ({"jobPostings": [{"title": "Welder", "externalPath": "/job/x_R1", "locationsText": "3 Locations", "bulletFields": ["R1"]}]}, {"posting_id": "R1"}),
    "amazon": ({"jobs": [{"id_icims": "8", "title": "Picker", "normalized_location": "Leeds", "description": "D", "basic_qualifications": "Q"}]}, {"description": "D\n\nQ"}),
    "keka": ([{"id": 2, "title": "Dev", "jobLocations": [{"city": "Pune", "countryCode": "IN"}]}], {"location": "Pune, IN"}),
    "successfactors": ({"jobSearchResult": [{"response": {"id": "6", "unifiedStandardTitle": "Boss", "jobLocationShort": ["Bonn"]}}]}, {"location": "Bonn"}),
    "phenom": ({"refineSearch": {"data": {"jobs": [{"jobId": "p", "title": "Vet", "cityStateCountry": "Nice"}]}}}, {"location": "Nice"}),
    "goldman": ({"data": {"roleSearch": {"items": [{"roleId": "r", "jobTitle": "VP", "locations": [{"city": "NY", "country": "US"}]}]}}}, {"location": "NY, US"}),
}


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [(a, "acme", json.dumps(b)) for a, (b, _) in BODIES.items()] + [("lever", "odd", '{"not": "a list"}'), ("ashby", "bad", "<html>"), ("ashby", "none", None)]
    rows += [("xmlfeed", "f", "<source><job><title>Nurse &amp; Co</title><referencenumber>12</referencenumber><city>Bern</city><country>CH</country><description>&lt;b&gt;Care&lt;/b&gt;</description></job><job><title>No id</title></job></source>")]
    rows += [("avature", "v", '<a href="https://x.example/JobDetail/a/11">First &amp; best</a><a href="https://x.example/JobDetail/a/11">Apply</a><a href="https://x.example/JobDetail/b/12"><b>Second</b></a>')]
    return spark.createDataFrame(rows, "ats string, board_id string, body string").cache()


def test_every_board_type_has_a_fixture():
    assert set(BODIES) == set(BOARDS)


@pytest.mark.parametrize("ats", BOARDS)
def test_json_board(bodies, ats):
    got = read_json(bodies, ats).collect()
    assert len(got) == 1
    for k, v in BODIES[ats][1].items():
        assert got[0][k] == v, k


def test_bad_bodies_are_told(bodies):
    assert {(r.board_id, r.reason) for r in bad_bodies(bodies).collect()} == {("odd", "wrong_root"), ("bad", "not_json"), ("none", "empty")}


def test_xml_and_html(bodies):
    x = read_xml(bodies).collect()
    assert [(r.posting_id, r.title, r.location, r.description) for r in x] == [("12", "Nurse & Co", "Bern, CH", "**Care**")]
    assert {(r.posting_id, r.title) for r in read_html(bodies).collect()} == {("11", "First & best"), ("12", "**Second**")}
    assert read_bodies(bodies).count() == len(BODIES) + 3


def test_html_text():
    assert to_text("<h2>Role</h2><ul><li>One</li><li>Two <b>big</b> x</li></ul><p>End&nbsp;&amp; out</p>") == "## Role\n\n* One\n* Two **big** x\n\nEnd & out"
    assert to_text("&lt;p&gt;A&lt;br&gt;B&lt;/p&gt;") == "A\nB"
    assert to_text("<script>x</script>") is None and to_text("") is None and to_text(None) is None
    assert to_text("a<b>c</b>") == "a**c**"


def test_ledger_batches(spark):
    from jobmill.streaming.ledger import LEDGER, apply_poll

    ts = lambda d: F.to_timestamp(F.lit(d))
    day = lambda rows, cols: spark.createDataFrame(rows, cols)
    polls = day([("b", "2026-01-01", True), ("b", "2026-01-02", False), ("b", "2026-01-03", True)], "board_id string, p string, complete boolean").select("board_id", F.to_timestamp("p").alias("polled_at"), "complete")
    listed = day([("b", "x", "2026-01-01"), ("b", "y", "2026-01-01"), ("b", "y", "2026-01-03")], "board_id string, posting_id string, p string").select("board_id", "posting_id", F.to_timestamp("p").alias("polled_at"))
    empty = spark.createDataFrame([], LEDGER)
    one = apply_poll(empty, listed, polls)
    got = {r.posting_id: (r.times_seen, str(r.closed_at)[:10]) for r in one.collect()}
    assert got == {"x": (1, "2026-01-03"), "y": (2, "None")}  # the partial poll closes nothing
    back = day([("b", "x", "2026-01-04")], "board_id string, posting_id string, p string").select("board_id", "posting_id", F.to_timestamp("p").alias("polled_at"))
    two = apply_poll(one, back, polls.limit(0).unionByName(back.select("board_id", "polled_at", F.lit(True).alias("complete"))))
    got = {r.posting_id: (r.times_seen, str(r.closed_at)[:10]) for r in two.collect()}
    assert got == {"x": (2, "None"), "y": (2, "2026-01-04")}  # reopened; closed


def test_latest_status_stream(spark, tmp_path):
    from jobmill.streaming.ledger import latest_status

    d = str(tmp_path / "in")
    spark.createDataFrame([(1, "new", "2026-01-02"), (1, "old", "2026-01-01"), (2, "only", "2026-01-01")], "key long, status string, t string").selectExpr("key", "status", "to_timestamp(t) as ts").write.parquet(d)
    out = str(tmp_path / "out")
    stream = latest_status(spark.readStream.schema("key long, status string, ts timestamp").parquet(d))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/b={n}")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.status) for r in spark.read.parquet(out).collect()} == {(1, "new"), (2, "only")}
