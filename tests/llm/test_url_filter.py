import random
from datetime import datetime, timedelta

import pytest

from docparity.llm import url_filter as uf

T0 = datetime(2024, 1, 1)
CAPTURES = "page_id long, url string, fetch_time timestamp, key string, valid_from timestamp"


def day(n):
    return T0 + timedelta(days=n)


def verdicts(spark, captures, entries):
    c = spark.createDataFrame([(*x, "clash", None) for x in captures], CAPTURES)
    return sorted((tuple(r) for r in uf.url_verdicts(c, spark.createDataFrame(entries, uf.ENTRY_SCHEMA)).collect()), key=str)


def slow(captures, entries):
    out = []
    for page, url, at in captures:
        names = []
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].split("?")[0].split("#")[0].rsplit("@")[-1].split(":")[0].lower().rstrip(".")
            segment = rest.split("#")[0].split("?")[0].split("/")[1].lower() if "/" in rest.split("#")[0].split("?")[0] else ""
            labels = host.split(".")
            names = [".".join(labels[i:]) for i in range(len(labels))]
            names += [f"{n}/{segment}" for n in names] if segment else []
        best = None
        for lst, kind, key in {(e[0], e[1], e[2]) for e in entries}:
            before = sorted((e[4], e[3]) for e in entries if e[:3] == (lst, kind, key) and at and e[4] <= at)
            if key in names and before and before[-1][1] == "add":
                cand = (-len(key), kind, lst, key)
                best = cand if best is None else min(best, cand)
        out.append((page, url, at, bool(best and best[1] == "block"), *((best[1], best[2], best[3]) if best else (None, None, None))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "www.b.org", "A.COM:80", "u:p@b.org", "c"]
    captures = [(i % 90, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/P/q?z#f', '/q', '?p', '#p'])}", day(rng.randrange(0, 30))) for i in range(200)]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(["block", "allow"]), rng.choice(["a.com", "x.a.com", "b.org", "b.org/p", "x.a.com/p", "www.b.org", "org", "c", "com/p"]), rng.choice(["add", "remove"]), day(rng.randrange(0, 30))) for _ in range(40)]
    assert verdicts(spark, captures, entries) == slow(captures, entries)
    # beyond the size that is broadcast
    uf.BROADCAST_INTERVALS, kept = 3, uf.BROADCAST_INTERVALS
    try:
        assert verdicts(spark, captures, entries) == slow(captures, entries)
    finally:
        uf.BROADCAST_INTERVALS = kept


@pytest.mark.parametrize(("at", "blocked"), [(0, False), (1, True), (4, True), (5, False), (6, False), (7, True)])
def test_interval_ends(spark, at, blocked):
    entries = [("l", "block", "a.com", "add", day(1)), ("l", "block", "a.com", "add", day(2)), ("l", "block", "a.com", "remove", day(5)), ("l", "block", "a.com", "add", day(7))]
    assert verdicts(spark, [(1, "http://a.com", day(at))], entries)[0][3] is blocked


def test_long_hosts_and_refused_keys(spark):
    deep = ".".join("abcdefghijklmnop") + ".com"
    entries = [("l", "block", "p.com", "add", T0), ("l", "block", "x.org/a/b", "add", T0), ("l", "block", "http://y.org", "add", T0), ("l", "block", "*.z.org", "add", T0)]
    assert [r[3] for r in verdicts(spark, [(1, f"http://{deep}/x", T0), (2, "http://x.org/a/b", T0)], entries)] == [True, False]
    assert {r["key"] for r in uf.refused(spark.createDataFrame([*entries, (None,) * 5], uf.ENTRY_SCHEMA)).collect()} == {"x.org/a/b", "http://y.org", None}


def test_no_window_without_partitions(spark):
    c = spark.createDataFrame([(1, "http://a.com", T0)], "page_id long, url string, fetch_time timestamp")
    plan = uf.intervals(spark.createDataFrame([("l", "block", "a.com", "add", T0)], uf.ENTRY_SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "[list" in plan.split("Window", 1)[1] and "Window" not in uf.url_verdicts(c, spark.createDataFrame([], uf.ENTRY_SCHEMA))._jdf.queryExecution().optimizedPlan().toString()


def test_odd_rows(spark):
    entries = [(None, "block", "A.com ", "add", None), ("l", None, "a.com", "add", T0), ("l", "block", None, "add", T0), ("l", "block", "b.com", "burn", T0), ("l", "block", "b.com", "add", T0), ("l", "block", "b.com", "remove", T0)]
    captures = [(1, "http://a.com", T0), (1, "http://a.com", T0), (2, None, T0), (3, "http://a.com", None), (None, "http://b.com", T0), (4, "", T0), (5, "nonsense", T0), (6, "http://a.com/" + "x" * 100_000, T0)]
    got = verdicts(spark, captures, entries)
    assert len(got) == len(captures) and [r[3] for r in got if r[0] in (1, 6)] == [True] * 3 and not any(r[3] for r in got if r[0] not in (1, 6))
    assert verdicts(spark, [], entries) == [] and not any(r[3] for r in verdicts(spark, captures, []))
