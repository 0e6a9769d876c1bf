"""URL filters by a temporal list join.

Block and allow lists change over time. Their dated entries ("added at", "removed
at") become validity intervals by a window over each list and key; every
capture is then judged by the entries that were active when it was fetched,
with an equality join on the key and the interval as residual condition. Keys
are hosts, their parent domains down to one label, and each of these with the first segment of
the path, so a capture has twice as many keys as its host has labels, and no
pattern is tried against every URL. Entries with other keys are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docparity.llm.common import cut

#: Lists of up to so many intervals are broadcast, larger ones joined by shuffle.
BROADCAST_INTERVALS = 100_000

ENTRY_SCHEMA = "list string, kind string, key string, action string, at timestamp"

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_KEY = r"^[^/\s.]+(\.[^/\s.]+)*(/[^/?#\s]+)?$"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def example_entries() -> list[tuple[str, str, str, str, str]]:
    """(list, kind, key, action, at): the dated lists the registered query runs with."""
    out = []
    for zone in ("com", "net", "org"):
        d = f"example.{zone}"
        out += [
            ("gambling", "block", f"free-bets.{d}", "add", "2024-01-15 00:00:00"),
            ("gambling", "block", f"casino-win.{d}", "add", "2024-02-01 00:00:00"),
            ("gambling", "block", f"casino-win.{d}", "remove", "2024-08-01 00:00:00"),
            ("gambling", "block", f"casino-win.{d}", "add", "2024-10-15 12:00:00"),
            ("pharma", "block", f"cheap-pills.{d}", "add", "2023-06-01 00:00:00"),
            ("spam", "block", f"spam-farm.{d}", "add", "2024-03-10 06:30:00"),
            ("spam", "block", f"tionble.{d}/fr", "add", "2024-05-01 00:00:00"),
            ("spam", "block", f"tionble.{d}/fr", "remove", "2024-11-01 00:00:00"),
            ("adult", "block", f"adult-x.{d}", "add", "2022-01-01 00:00:00"),
            ("ads", "block", f"ads-track.{d}", "add", "2024-04-01 00:00:00"),
            ("reviewed", "allow", f"m.ads-track.{d}", "add", "2024-09-01 00:00:00"),
            ("reviewed", "allow", f"www.spam-farm.{d}/en", "add", "2024-07-01 00:00:00"),
            ("reviewed", "allow", f"www.spam-farm.{d}/en", "remove", "2024-07-20 00:00:00"),
        ]
    out.append(("outage", "block", "example.org", "add", "2024-12-24 00:00:00"))
    out.append(("outage", "block", "example.org", "remove", "2024-12-27 00:00:00"))
    return out


def host(url: Column) -> Column:
    """Host in lower case without port, user and final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")


def keys(url: Column) -> Column:
    """Keys of a URL: host and parents down to the last label; each with the first path segment. Longer is more specific."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    segment = F.lower(F.regexp_extract(url, _PATH, 1))
    names = F.when(host(url) != "", F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))
    return F.when(segment != "", F.concat(names, F.transform(names, lambda x: F.concat(x, F.lit("/"), segment)))).otherwise(names)


def _sound(entries: DataFrame) -> Column:
    return F.coalesce(F.col("kind").isin("block", "allow") & F.col("action").isin("add", "remove") & F.rlike(F.trim("key"), F.lit(_KEY)), F.lit(False))


def refused(entries: DataFrame) -> DataFrame:
    """The entries that :func:`intervals` leaves out, as they are."""
    return entries.where(~_sound(entries))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, valid_from, valid_to): each ``add`` holds until the next entry of its list and key.

    At one instant a ``remove`` comes after an ``add``, so it wins; adding twice
    changes nothing; an entry without ``at`` holds since ever; entries without
    key, kind or action, with unknown ones, or whose key is not a host or a host and one
    path segment are left out (:func:`refused` lists them). Empty intervals vanish, touching ones stay apart.
    """
    clean = entries.where(_sound(entries)).select(
        F.coalesce("list", F.lit("")).alias("list"), "kind", F.lower(F.trim("key")).alias("key"), "action", F.coalesce(F.col("at"), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("valid_from")
    )
    held = clean.selectExpr("*", "lead(valid_from) over (partition by list, kind, key order by valid_from, action) as valid_to")
    return held.where("action = 'add' and (valid_to is null or valid_from < valid_to)").drop("action")


def url_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture with ``blocked`` and the entry that decided: ``kind``, ``list`` and ``key``, null if none was active.

    ``captures`` has ``page_id``, ``url`` and ``fetch_time``; other columns are not
    read. Among the entries active at fetch time (from inclusive, to exclusive)
    the longest key decides; of one key an allow entry, then the first list by
    name. A null or malformed URL and a null fetch time match nothing and are not blocked. A
    null ``page_id`` stays null; repeated rows are judged one by one. Empty tables give empty results.
    """
    # one number says which of two entries decides, so grouping needs neither a sort nor the entries' strings;
    # after a sort by ranges, partition by partition, this one ascends
    order = intervals(entries).orderBy(F.desc(F.length("key")), "kind", "list", "key", "valid_from")
    valid = cut(order.selectExpr("list as e_list", "kind as e_kind", "key as e_key", "valid_from", "valid_to", "monotonically_increasing_id() as e_rank"))
    small = valid.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS
    side = F.broadcast if small else (lambda df: df)
    given = captures.select("page_id", "url", "fetch_time").withColumn("__dp_row", F.monotonically_increasing_id())
    asked = given.select("*", F.explode_outer(keys(F.coalesce("url", F.lit("")))).alias("key"))
    on = (F.col("key") == F.col("e_key")) & (F.col("valid_from") <= F.col("fetch_time")) & (F.col("valid_to").isNull() | (F.col("fetch_time") < F.col("valid_to")))
    matched = asked.join(side(valid.select("e_key", "valid_from", "valid_to", "e_rank")), on, "left")
    judged = matched.groupBy("__dp_row", "page_id", "url", "fetch_time").agg(F.min("e_rank").alias("rank"))
    decided = judged.join(side(valid.select(F.col("e_rank").alias("rank"), "e_kind", "e_list", "e_key")), "rank", "left")
    return decided.select(
        "page_id", "url", "fetch_time", F.coalesce(F.col("e_kind") == "block", F.lit(False)).alias("blocked"),
        F.col("e_kind").alias("kind"), F.col("e_list").alias("list"), F.col("e_key").alias("key"),
    )


#: When a page of the table was fetched; the table itself has no such column.
FETCH_TIME = "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, pmod(page_id * 7919, 31622400))"
_FETCH_TIME_DUCK = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds((page_id * 7919) % 31622400)"


def verdicts_sql() -> str:
    """DuckDB SQL for the registered query: an as-of look-up of the last entry of each list and key."""
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in example_entries())
    return f"""
    WITH entries(list, kind, key, action, since) AS (VALUES {rows}),
    captures AS (SELECT row_number() OVER () AS r, page_id, url, {_FETCH_TIME_DUCK} AS fetch_time FROM pages),
    parts AS (
      SELECT r, fetch_time, string_split(rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.'), '.') AS labels, lower(regexp_extract(url, '{_PATH}', 1)) AS seg FROM captures
    ),
    names AS (SELECT r, fetch_time, seg, array_to_string(labels[i:len(labels)], '.') AS name FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM parts)),
    asked AS (SELECT r, fetch_time, name AS key FROM names UNION ALL SELECT r, fetch_time, name || '/' || seg FROM names WHERE seg <> ''),
    last AS (
      SELECT a.r, e.list, e.kind, e.key, arg_max(e.action, (e.since, e.action)) AS action
      FROM asked a JOIN entries e ON a.key = e.key AND e.since <= a.fetch_time GROUP BY ALL
    ),
    best AS (
      SELECT r, list, kind, key FROM last WHERE action = 'add'
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(key) DESC, kind, list, key) = 1
    )
    SELECT page_id, url, fetch_time, coalesce(kind = 'block', false) AS blocked, kind, list, key FROM captures LEFT JOIN best USING (r)"""
