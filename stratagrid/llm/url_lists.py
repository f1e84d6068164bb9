"""Temporal list join: every capture of a URL against the list entries that were active when it was fetched.

A list is a log of dated changes. Each change holds from its day until the next change of the same entry, so
the log becomes validity intervals; a capture finds the interval that its fetch day falls into (an as-of join,
by an equality on the entry and a range on the day). Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or closing dot; null where there is none. An IPv6 address keeps its brackets."""
    found = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.+$", ""), F.lit(""))


def path(url: Column) -> Column:
    """The path of a URL without query, fragment or outer slashes; empty where there is none."""
    found = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(found, r"^/+|/+$", "")


def keys(url: Column, longest: Column | None = None) -> Column:
    """What an entry must be to match: the host and its parents down to two labels, the host with each
    leading part of the path, and the URL itself. Null without a host.

    longest: the number of segments in the longest path entry there is; what is longer can't match and is
    not made. Without it all leading parts are made."""
    h, p = host(url), path(url)
    labels = F.when(h.startswith("["), F.array(h)).otherwise(F.split(h, r"\."))  # an address has no parents
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, k, n), ".")))
    parts = F.split(p, "/+")
    if longest is not None:
        parts = F.slice(parts, F.lit(1), longest)
    prefixes = F.when((p == "") | (F.size(parts) == 0), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("path:"), h, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))))
    return F.when(h.isNotNull(), F.array_distinct(F.concat(parents, prefixes, F.array(F.concat(F.lit("url:"), F.trim(url))))))


def intervals(log: DataFrame) -> DataFrame:
    """(list, entry, from_day, to_day) while an entry is on a list; to_day is null where it still is.

    log(list, entry, action, day): action is add or remove. Of changes on one day a removal counts last; an
    addition of what is listed, or a removal of what is not, changes nothing. Rows with a null are left out."""
    known = log.select("list", "entry", "action", F.col("day").cast("date").alias("day")).where("list is not null and entry is not null and day is not null and action in ('add', 'remove')")
    # one state a day for each entry, so equal rows and ties are gone before the window
    daily = known.groupBy("list", "entry", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "entry").orderBy("day")
    changed = daily.withColumn("before", F.lag("action").over(w)).where(~F.col("action").eqNullSafe(F.col("before")))
    spans = changed.withColumn("to_day", F.lead("day").over(w)).where("action = 'add'")
    return spans.select("list", "entry", F.col("day").alias("from_day"), "to_day")


def evaluate(captures: DataFrame, log: DataFrame, salts: int = 16) -> DataFrame:
    """Every row of captures(page_id, url, fetched) with the lists that its URL was on at that day.

    n_active counts the (list, entry) pairs that match, lists names the lists (sorted, comma-joined), blocked says
    whether there is one, since is the earliest day from which one of them had held without a break. A null or
    hostless URL and a null day match nothing. Repeated rows give repeated rows; other columns are not read.
    Captures of one host are dealt over `salts` tasks, so a host with a third of all rows stays divided.
    """
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("date").alias("fetched"))
    rows = rows.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("copies"))
    # a single row: how long the log's path entries are
    segments = F.when(F.col("entry").startswith("path:"), F.size(F.split("entry", "/")) - 1)
    reach = log.select(F.coalesce(F.max(segments), F.lit(0)).alias("longest"))
    rows = rows.crossJoin(F.broadcast(reach))
    looked = rows.withColumns({"entry": F.explode_outer(keys(F.col("url"), F.col("longest"))), "salt": F.pmod(F.xxhash64("page_id", "url", "fetched"), F.lit(salts)).cast("int")})
    listed = intervals(log).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    c, e = looked.alias("c"), listed.alias("e")
    active = (F.col("c.entry") == F.col("e.entry")) & (F.col("c.salt") == F.col("e.salt")) & (F.col("fetched") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("fetched") < F.col("to_day")))
    found = c.join(e, active, "left").groupBy("page_id", "url", "fetched", "copies").agg(
        F.count("list").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("from_day").alias("since"))
    out = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("page_id", "url", host(F.col("url")).alias("host"), "fetched", "n_active", "lists", "since", (F.col("n_active") > 0).alias("blocked"))
