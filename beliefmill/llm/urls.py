"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries become validity intervals, and every capture is judged by the entries that were
active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days in a slot of the as-of join.
SLOT_DAYS = 32
#: Interval tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def url_host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty if the URL has none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.rtrim(host, F.lit("."))


def host_suffixes(host: Column) -> Column:
    """a.b.c, b.c, c: the names under which a list can hold the host; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host != "", names).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """entries (list, name, action, day) to intervals (list, name, from_day, to_day), end exclusive, null: still valid.

    action is 'add' or 'remove'. An entry holds from an add to the next remove of the same list and
    name; several entries of one day count as the last action by code point, so 'remove' wins. Entries
    with a null in any column are ignored.
    """
    named = entries.select("list", F.lower("name").alias("name"), "action", "day").dropna()
    daily = named.groupBy("list", "name", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "name").orderBy("day")
    changes = daily.withColumn("was", F.lag("action").over(order)).where("was is null or was <> action")
    spans = changes.withColumn("to_day", F.lead("day").over(order)).where("action = 'add'")
    return spans.select("list", "name", F.col("day").alias("from_day"), "to_day")


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """One row a capture: page_id, url, host, day, lists (sorted names of lists active for it), blocked.

    A list entry covers its name and every host below it. Intervals are cut into slots of SLOT_DAYS days
    up to the last day fetched, so the as-of join is an equi-join on (name, slot) with the exact days as
    a condition: a name with a long history meets only the entries of the capture's slot. Captures are
    grouped to (host, day) before the join, so a host with a third of all pages costs one row a day.
    Null or malformed URLs have host '' and null days have no active entry; both are kept, not blocked.
    Repeated captures stay repeated; empty tables are fine; extra columns are ignored.
    """
    seen = captures.select(captures[id_col].alias("page_id"), captures[url_col].alias("url"), url_host(captures[url_col]).alias("host"), captures[day_col].cast("date").alias("day"))
    visits = seen.where("host <> '' and day is not null").select("host", "day").distinct()
    last = F.lit(visits.agg(F.max("day")).first()[0]).cast("date")
    slot = lambda d: F.floor(F.unix_date(d) / SLOT_DAYS)
    spans = validity_intervals(entries).where(F.col("from_day") <= last)
    upto = F.least(F.coalesce(F.date_sub("to_day", 1), last), last)
    spans = spans.withColumn("slot", F.explode(F.sequence(slot(F.col("from_day")), slot(upto))))
    spans = spans.select("list", "name", "from_day", "to_day", "slot")
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    asked = visits.select("host", "day", slot(F.col("day")).alias("slot"), F.explode(host_suffixes(F.col("host"))).alias("name"))
    met = asked.join(spans, ["name", "slot"]).where("day >= from_day and (to_day is null or day < to_day)")
    active = met.groupBy("host", "day").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    return seen.join(active, ["host", "day"], "left").select("page_id", "url", "host", "day", F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"), F.col("lists").isNotNull().alias("blocked"))
