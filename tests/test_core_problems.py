"""The nested-record, snapshot and time queries against brute force in pandas."""

import html
import json
import math
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

from jobmill.plans import core_problems as cp


def rows(df):
    return {tuple(r) for r in df.collect()}


def pid(x):
    return str(x).strip().lower()


def load(sf, name):
    d = pd.read_parquet(f"{sf}/{name}.parquet")
    return d


NAMES = {m[:3].lower(): i + 1 for i, m in enumerate("January February March April May June July August September October November December".split())} | {"mär": 3, "mai": 5, "okt": 10, "dez": 12}


def instant(text, zone):
    """An independent reading of one time, by trial of notations; None where it names no instant."""
    if text is None:
        return None
    t = text.strip()
    if re.fullmatch(r"\d{13}", t):
        return int(t)
    if m := re.fullmatch(r"(\d{10})(?:\.(\d{3}))?", t):
        return int(m[1]) * 1000 + int(m[2] or 0)
    t = re.sub(r"\[.*\]$", "", t)
    off, letters = None, None
    if m := re.search(r"UTC([+-]\d+)(?::(\d+))?$", t):
        off = timedelta(hours=abs(int(m[1])), minutes=int(m[2] or 0)) * (-1 if m[1][0] == "-" else 1)
        t = t[: m.start()].strip()
    elif m := re.search(r"(?<=[\d ])([+-])(\d\d):?(\d\d)?$", t) if ":" in t else None:
        off = timedelta(hours=int(m[2]), minutes=int(m[3] or 0)) * (-1 if m[1] == "-" else 1)
        t = t[: m.start()].strip()
    elif m := re.search(r"(?:(?<=\d)[zZ]| GMT)$", t):
        off = timedelta()
        t = t[: m.start()].strip()
    elif m := re.search(r" (?!AM|PM)([A-Z]{3,4})$", t):
        letters = m[1]
        t = t[: m.start()].strip()
    t = t.replace("at ", "").replace(" Uhr", "")
    t = re.sub(r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "", t)
    t = re.sub(r"[A-Za-zä]{3,9}(?=[ -]\d{4}| \d+,)", lambda m: f"{NAMES.get(m[0][:3].lower(), 99):02d}", t)
    t = t.replace("T", " ").replace("t", " ").replace(",", ".") if re.match(r"\d{4}-?\d\d", t) else t
    for f in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y%m%d %H%M%S", "%d.%m.%Y %H:%M", "%d %m %Y %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%d %m %Y %I:%M %p", "%m %d, %Y %I:%M %p", "%d. %m %Y, %H:%M"):
        try:
            w = datetime.strptime(t, f)
        except ValueError:
            continue
        if off is not None:
            u = w.replace(tzinfo=timezone.utc) - off
        else:
            z = ZoneInfo(zone or "UTC")
            u = w.replace(tzinfo=z, fold=0).astimezone(timezone.utc)
            if letters and w.replace(tzinfo=z, fold=1).tzname() == letters != w.replace(tzinfo=z, fold=0).tzname() and w.replace(tzinfo=z, fold=1).astimezone(timezone.utc).astimezone(z).replace(tzinfo=None) == w:
                u = w.replace(tzinfo=z, fold=1).astimezone(timezone.utc)
        return math.floor((u - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(milliseconds=1))
    return None


def test_times(spark, sf):
    zones = dict(load(sf, "ats_boards")[["board_id", "time_zone"]].itertuples(index=False))
    want = set()
    for name, c in {"ashby": "publishedat", "lever": "createdat", "smartrecruiters": "releaseddate", "greenhouse": "first_published"}.items():
        for r in load(sf, f"{name}_list").itertuples():
            if (ms := instant(getattr(r, c), zones.get(r.board_id))) is not None:
                want.add((r.poll_no, pid(r.id), ms))
    assert rows(cp.p6_found(spark, sf)) == want


@pytest.mark.parametrize(
    "text, zone, want",
    [
        ("2026-10-25 02:30", "Europe/Berlin", "2026-10-25T00:30:00Z"),  # occurs twice: the earlier
        ("25-Oct-2026 02:30:00 CET", "Europe/Berlin", "2026-10-25T01:30:00Z"),
        ("25-Oct-2026 02:30:00 CEST", "Europe/Berlin", "2026-10-25T00:30:00Z"),
        ("2026-03-29 02:30", "Europe/Berlin", "2026-03-29T01:30:00Z"),  # skipped: the offset before
        ("2026-03-29", "Asia/Kolkata", "2026-03-28T18:30:00Z"),
        ("Mar 3, 2026 12:05 AM", None, "2026-03-03T00:05:00Z"),
        ("3 March 2026 at 12:05 pm UTC+5:30", None, "2026-03-03T06:35:00Z"),
        ("7. März 2026, 22:35 Uhr", "UTC", "2026-03-07T22:35:00Z"),
        (" 2026-03-03t01:02:03z ", "Asia/Kolkata", "2026-03-03T01:02:03Z"),
        ("2026-03-03T01:02:03,9999-02:00", None, "2026-03-03T03:02:03.999Z"),
        ("2026-02-30", "UTC", None),
        ("0000-00-00T00:00:00Z", "UTC", None),
        ("2026-13-40", "UTC", None),
        ("2026-01-01 25:00", "UTC", None),
        ("soon", "UTC", None),
        ("", "UTC", None),
        (None, "UTC", None),
    ],
)
def test_one_time(spark, text, zone, want):
    from jobmill.operators.timestamps import to_instants

    df = spark.createDataFrame([(text, "b", 1)], "v string, s string, utc int")
    zones = spark.createDataFrame([("b", zone)], "s string, z string")
    got = to_instants(df, "v", "s", zones).first()
    ms = got["utc_ms"]
    assert got["utc"] == 1
    assert (ms is None) if want is None else ms == math.floor(datetime.fromisoformat(want).timestamp() * 1000 + 0.5)


def test_mixture_decides_the_day_first(spark):
    from jobmill.operators.timestamps import to_instants

    values = [("03/04/2026", "eu")] + [(f"{d}/03/2026", "eu") for d in range(13, 28)] + [("03/04/2026", "us")] + [(f"03/{d}/2026", "us") for d in range(13, 28)] + [("03/04/2026", "unknown"), ("03/04/2026", None)]
    zones = spark.createDataFrame([], "s string, z string")
    got = {r["s"]: r for r in to_instants(spark.createDataFrame(values, "v string, s string"), "v", "s", zones).where("v = '03/04/2026'").collect()}
    assert got["eu"]["reading"] == "dmy" and got["eu"]["resolved"]
    assert got["us"]["reading"] == "mdy" and got["us"]["resolved"]
    assert not got["unknown"]["resolved"] and got["unknown"]["utc_ms"] is not None
    assert not got[None]["resolved"]
    assert to_instants(spark.createDataFrame([], "v string, s string"), "v", "s", zones).count() == 0


def test_snapshots(spark, sf):
    polls = load(sf, "list_polls").drop_duplicates()
    polls = polls[polls.complete & ~polls.not_modified & polls.error_text.isna()]
    want = set()
    for name in ("greenhouse", "lever"):
        d = load(sf, f"{name}_list")
        by_poll = {}
        for r in d.itertuples():
            slot = by_poll.setdefault(r.poll_no, {}).setdefault(pid(r.id), [])
            slot.append(instant(r.updated_at, None) if name == "greenhouse" else tuple(None if x is None else " ".join(x.split()) for x in (r.text, r.descriptionplain)))
        for _, g in polls[polls.ats == name].groupby("board_id"):
            order = g.sort_values(["polled_at", "poll_no"]).poll_no.tolist()
            for a, b in zip(order, order[1:]):
                old, new = by_poll.get(a, {}), by_poll.get(b, {})
                want |= {(b, k, "added") for k in new.keys() - old.keys()} | {(b, k, "removed") for k in old.keys() - new.keys()}
                for k in new.keys() & old.keys():
                    if name == "greenhouse":
                        x, y = (max((v for v in s[k] if v is not None), default=None) for s in (old, new))
                        changed = x is not None and y is not None and x != y
                    else:
                        x, y = old[k][0], new[k][0]
                        changed = any(p is not None and q is not None and p != q for p, q in zip(x, y))
                    if changed:
                        want.add((b, k, "changed"))
    assert rows(cp.p5_found(spark, sf)) == want


def items_of(content):
    if isinstance(content, list):
        texts = [re.sub(r"<[^>]+>", "", html.unescape(x) if x else "") for x in content]
    else:
        c = content or ""
        if "<" not in c and "&lt;" in c:
            c = html.unescape(c)
        texts = [html.unescape(re.sub(r"<[^>]+>", "", x)) for x in re.sub(r"(?i)</?(li|ul|ol|p|div|br)\b[^>]*>", "\0", c).split("\0")]
    return [x for x in (" ".join(t.split()) for t in texts) if x]


def test_nested(spark, sf):
    want = set()

    def raw(r, key):
        o = json.loads(r)
        for _ in range(2):
            for k, v in o.items():
                if k.lower() == key:
                    return json.loads(v) if isinstance(v, str) and v[:1] in "[{" else v
            o = next(iter(o.values()))

    for r in load(sf, "lever_list").itertuples():
        blocks = list(r.lists) if r.lists is not None else raw(r.raw, "lists") if r.raw else None
        for n, b in enumerate([blocks] if isinstance(blocks, dict) else blocks or []):
            if b:
                for i, t in enumerate(items_of({k.lower(): v for k, v in b.items()}["content"])):
                    want.add((r.poll_no, pid(r.id), n, i, t))
    for r in load(sf, "ashby_list").itertuples():
        places = list(r.secondarylocations) if r.secondarylocations is not None else raw(r.raw, "secondarylocations") if r.raw else None
        names = []
        for p in [places] if isinstance(places, dict) else places or []:
            p = p.get("location") if isinstance(p, dict) else p
            p = p.get("name") if isinstance(p, dict) else p
            if p and p.strip():
                names.append(" ".join(p.split()))
        want |= {(r.poll_no, pid(r.id), n, 0, t) for n, t in enumerate(names)}
    for r in load(sf, "smartrecruiters_list").itertuples():
        p = r.location if r.location is not None else raw(r.raw, "location") if r.raw else None
        p = p[0] if isinstance(p, list) else {"fulllocation": p} if isinstance(p, str) else p
        if p:
            p = {k.lower(): v for k, v in p.items()}
            t = " ".join((p.get("fulllocation") or "").split()) or " ".join(", ".join(p[k] for k in ("city", "region", "country") if (p.get(k) or "").strip()).split())
            if t:
                want.add((r.poll_no, pid(r.id), 0, 0, t))
    assert rows(cp.p4_found(spark, sf)) == want


def test_flatten_keeps_links(spark):
    from pyspark.sql import functions as F

    from jobmill.operators.nested import flatten, infer_schema

    df = spark.createDataFrame([(1, [{"n": "a", "k": ["x", None, "y"]}, None, {"n": None, "k": []}]), (2, None), (3, []), (None, [{"n": "b", "k": None}])], "id int, d array<struct<n string, k array<string>>>")
    t = flatten(df, ["id"], "d")
    assert sorted((r.id is None, r.id, r.ordinal, r.n) for r in t["d"].collect() if r.id) == [(False, 1, 0, "a"), (False, 1, 1, None), (False, 1, 2, None)]
    assert [r.value for r in t["d.k"].orderBy("ordinal").collect()] == ["x", None, "y"]
    assert t["d.k"].join(t["d"], t["d.k"]["parent_id"] == t["d"]["row_id"]).count() == 3
    assert t["d"].select(F.count_distinct("row_id")).first()[0] == t["d"].count() == 4
    raws = spark.createDataFrame([('{"a": 1}',), ('{"b": ["x"]}',), (None,), ("no json",)], "r string")
    assert "a: " in infer_schema(raws, "r") and "ARRAY<STRING>" in infer_schema(raws, "r")


def test_tiny_snapshots(spark):
    from pyspark.sql import functions as F

    from jobmill.operators.snapshots import change_events, number_snapshots

    snaps = number_snapshots(spark.createDataFrame([("o", i, i) for i in (1, 2, 3, 4)], "o string, snapshot int, at int"), ["o"], [F.col("at")], "snapshot")
    listed = spark.createDataFrame([(1, "a", 1), (3, "a", 1), (4, "a", None), (1, "b", 1), (2, "b", 2)], "snapshot int, k string, v int").join(snaps, "snapshot")
    got = rows(change_events(listed, ["o", "k"], ["v"]).select("k", "snapshot", "change_kind"))
    assert got == {("a", 2, "removed"), ("a", 3, "added"), ("b", 2, "changed"), ("b", 3, "removed")}
    assert change_events(listed.limit(0), ["o", "k"], ["v"]).count() == 0


def test_shapes_are_inferred_and_merged(spark):
    from jobmill.operators.nested import infer_shapes, merged_type
    from jobmill.plans.core_problems import nested_column

    raws = ['{"d": {"Lists": {"text": "a", "content": ["x", null]}}}', '{"lists": "[{\\"text\\": \\"b\\", \\"content\\": \\"y\\"}]"}', "no json", "[1]", None, '{"lists": null}', '{"other": 1}']
    schema = "k int, lists array<struct<text:string,content:string>>, raw string"
    df = spark.createDataFrame([(n, None, r) for n, r in enumerate(raws)] + [(7, [("c", "z"), None], '{"lists": []}')], schema)
    shapes = infer_shapes(df, "raw", "lists")
    assert shapes[".content"] == {"array"} and shapes["[].content"] == {"scalar"} and shapes[""] == {"object", "array"}
    kind = merged_type(df.schema["lists"].dataType, shapes, "lists")
    assert [f.name for f in kind.elementType] == ["text", "content", "content_items"]
    got = {r.k: None if r.lists is None else [None if x is None else tuple(x) for x in r.lists] for r in nested_column(df, "lists").collect()}
    assert got[0] == [("a", None, ["x", None])] and got[1] == [("b", "y", None)] and got[7] == [("c", "z", None), None]
    assert all(not got[k] for k in (2, 3, 4, 5, 6))
    assert nested_column(df.limit(0), "lists").count() == 0
