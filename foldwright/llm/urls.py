"""URL filter by dated lists: a temporal as-of join, in DataFrame functions only.

Dated additions and removals become validity intervals, disjoint per list and entry. Every capture asks, for each entry that
covers its URL (its host, the domains above it, its host with leading path segments), which interval was open when it
was fetched. Both sides are cut into calendar months, so the equi-join on entry and month holds at most the intervals of one
month and a much-fetched host is spread over the months; within it the one open interval is found by its bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import store, whole_row

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host of a URL, null where there is none."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(found != "", F.regexp_replace(found, r"\.$", ""))


def entries(url: Column) -> Column:
    """Every list entry that covers the URL: the host, its parent domains of two labels or more, host/leading/path."""
    h = host(url)
    labels = F.split(h, r"\.")
    plain = h.rlike(r"^\[|^[0-9.]+$") | (F.size(labels) < 3)
    domains = F.when(plain, F.array(h)).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    paths = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))), lambda i: F.concat(
        h, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(h.isNotNull(), F.array_distinct(F.concat(domains, paths)))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def intervals(events: DataFrame) -> DataFrame:
    """list, entry, valid_from, valid_to (null while open) from events list, entry, action (add, remove), day.

    valid_from is inside, valid_to is outside. An entry both added and removed on a day is active on it. Repeated and redundant
    events change nothing; events with a null in any column, or another action, are left out.
    """
    known = events.select(F.col("list").cast("string").alias("list"), F.col("entry").cast("string").alias("entry"),
                          F.col("action").cast("string").alias("action"), F.col("day").cast("date").alias("day"))
    known = known.where(F.col("action").isin("add", "remove")).dropna()
    # One row per list, entry and day, so a window holds at most as many rows as there are days.
    days = known.groupBy("list", "entry", "day").agg(F.max(F.col("action") == "add").alias("on"))
    over = Window.partitionBy("list", "entry").orderBy("day")
    changes = days.withColumn("was", F.coalesce(F.lag("on").over(over), F.lit(False))).where(F.col("on") != F.col("was"))
    return (changes.withColumn("valid_to", F.lead("day").over(over)).where("on")
            .select("list", "entry", F.col("day").alias("valid_from"), "valid_to"))


def filter_captures(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with blocked, lists (sorted, comma-joined, empty if none) and matches: array of (list, entry, valid_from).

    All rows and columns stay (columns of these three names are replaced). A null or unparsable URL, or a null date, is never
    blocked.
    """
    names = [c for c in captures.columns if c not in ("blocked", "lists", "matches")]
    rows = captures.select(whole_row(captures).alias("_row"), F.col(f"`{url}`").cast("string").alias("_url"),
                           F.col(f"`{fetched}`").cast("date").alias("_day"))
    asked = rows.select("_url", "_day").distinct().withColumn("entry", F.explode(entries(F.col("_url"))))
    asked = asked.withColumn("_month", _month(F.col("_day")))

    valid = store(intervals(events), "intervals")
    # Open intervals reach to the last capture.
    last = rows.agg(F.max("_day")).first()[0]
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    months = valid.where(F.col("valid_from") <= F.lit(last).cast("date")).withColumn(
        "_month", F.explode(F.sequence(_month(F.col("valid_from")), _month(end))))
    months = store(months, "months")
    hits = asked.join(months, ["entry", "_month"]).where(
        (F.col("_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    # One capture's own matches: at most one per list and covering entry.
    verdicts = hits.groupBy("_url", "_day").agg(
        F.array_sort(F.collect_set(F.struct("list", "entry", "valid_from"))).alias("matches"))
    verdicts = store(verdicts, "verdicts")
    out = rows.join(verdicts, ["_url", "_day"], "left")
    none = F.array().cast("array<struct<list:string,entry:string,valid_from:date>>")
    out = out.withColumn("matches", F.coalesce("matches", none))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names], (F.size("matches") > 0).alias("blocked"),
                      F.array_join(F.array_sort(F.array_distinct(F.col("matches")["list"])), ",").alias("lists"), "matches")
