"""URL filter against a plain walk through the events of each entry."""

import datetime
import random

from foldwright.llm import urls

DAY = datetime.date(2021, 1, 1)


def on(n):
    return DAY + datetime.timedelta(n)


def active(events, name, entry, day):
    days = {}
    for l, e, a, d in events:
        if (l, e) == (name, entry) and a in ("add", "remove") and d is not None and d <= day:
            days.setdefault(d, set()).add(a)
    return bool(days) and "add" in days[max(days)]


def covering(url):
    host = url.split("://")[1].split("/")[0].lower()
    labels = host.split(".")
    out = [".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))]
    segments = [s for s in url.split("://")[1].split("?")[0].split("/")[1:] if s]
    return out + [host + "/" + "/".join(segments[:i + 1]) for i in range(len(segments))]


def test_against_plain(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.z.example.org", "other.net"]
    paths = ["", "/", "/p", "/p/q", "/p/q?r=/s"]
    entries = hosts + ["example.org", "z.example.org", "a.example.com/p", "other.net/p/q", "com"]
    events = [(rng.choice(["ads", "bad"]), rng.choice(entries), rng.choice(["add", "add", "remove", "other"]), on(rng.randrange(900)))
              for _ in range(300)]
    events += events[:20] + [(None, "other.net", "add", on(1)), ("ads", None, "add", on(1)), ("ads", "other.net", "add", None)]
    captures = [(k, "http://" + ("a.example.com" if k % 3 else rng.choice(hosts)) + rng.choice(paths), on(rng.randrange(1000)), "x")
                for k in range(400)]
    out = urls.filter_captures(spark.createDataFrame(captures, "page_id bigint, url string, fetched date, lists string"),
                               spark.createDataFrame(events, "list string, entry string, action string, day date"))
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(captures)
    for k, url, day, _ in captures:
        want = sorted({n for n in ("ads", "bad") for e in covering(url) if active(events, n, e, day)})
        assert got[k]["lists"] == ",".join(want) and got[k]["blocked"] == bool(want)


def test_edges(spark):
    events = [("bad", "example.com", "add", on(10)), ("bad", "example.com", "remove", on(20)), ("bad", "10.0.0.1", "add", on(0)),
              ("bad", "0.1", "add", on(0))]
    rows = [(1, "http://EXAMPLE.com:80/x", on(10)), (2, "http://u:p@www.example.com", on(19)), (3, "http://example.com", on(20)),
            (4, "http://example.com", on(9)), (5, None, on(12)), (6, "no url", on(12)), (7, "http://example.com/", None),
            (8, "http://10.0.0.1/", on(5)), (9, "", on(5)), (1, "http://EXAMPLE.com:80/x", on(10)), (10, "http://badexample.com", on(12))]
    events_df = spark.createDataFrame(events, "list string, entry string, action string, day date")
    captures = spark.createDataFrame([(*r, "m", "e") for r in rows], "page_id bigint, url string, fetched date, matches string, entry string")
    out = urls.filter_captures(captures, events_df)
    assert out.columns == ["page_id", "url", "fetched", "entry", "blocked", "lists", "matches"]
    assert sorted((r["page_id"], r["blocked"]) for r in out.collect()) == sorted(
        (k, k in (1, 2, 8)) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 10))
    assert urls.filter_captures(captures.limit(0), events_df).collect() == []
    assert {r["blocked"] for r in urls.filter_captures(captures, events_df.limit(0)).collect()} == {False}
