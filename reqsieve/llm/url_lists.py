"""URL filters whose lists change over time: which entries were active when a page was fetched.

A list is a log of dated changes (add, remove) of patterns. The changes of each pattern
become validity intervals, disjoint for one list and pattern, and every capture meets the
intervals of its host, the host's parent domains and their path prefixes that hold its
fetch time. Only built-in column functions are used.

Intervals and captures are cut at the same time slices, so the join key is (pattern,
slice): a host with a third of all captures, or a pattern that changes every hour,
spreads over the slices. Beyond a checked size the intervals are not broadcast, and the
join's hot partitions are split by Spark at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.session import split_hot_keys

#: Intervals are broadcast up to so many rows of at most so many bytes of pattern and list.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20
SLICE_DAYS = 64


def url_host(url: Column) -> Column:
    """The lower-case host of a URL: no scheme, login, port or final dot; '' if it has none."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def url_patterns(url: Column, path_depth: int) -> Column:
    """All patterns that cover a URL: its host and each parent domain down to the last
    label, alone and with up to ``path_depth`` of its first folders (``example.org/en``)."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), count),
        lambda k: F.array_join(F.slice(labels, k, count - k + 1), "."),
    )
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*(/[^?#]*)", 1)
    folders = F.filter(F.split(path, "/"), lambda part: part != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(folders), F.lit(path_depth))),
        lambda k: F.when(k == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(folders, 1, F.greatest(k, F.lit(1))), "/"))),
    )
    both = F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))
    return F.when(host != "", F.array_distinct(both)).otherwise(F.array().cast("array<string>"))


def validity_intervals(changes: DataFrame) -> DataFrame:
    """``(list, pattern, valid_from, valid_to)`` from dated changes ``(list, pattern, action, at)``.

    An ``add`` opens an interval unless one is open, a ``remove`` closes it; ``valid_to``
    is null while it is open. The interval holds its begin and not its end. At one
    instant a remove comes after an add. Repeated changes change nothing; a change with a
    null in any column, or another action, is none. A pattern's host has no case, its path
    has one as a URL's has; a final ``/`` and repeated ones do not matter.
    """
    whole = F.col("pattern").cast("string")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(whole, r"^[^/]*(/.*)$", 1), "/+", "/"), "/$", "")
    named = changes.select(
        F.col("list").cast("string").alias("list"),
        F.concat(F.lower(F.regexp_extract(whole, r"^[^/]*", 0)), path).alias("pattern"),
        F.col("action"),
        F.col("at").cast("timestamp").alias("at"),
    )
    clean = named.filter("list IS NOT NULL AND pattern <> '' AND at IS NOT NULL AND action IN ('add', 'remove')")
    # the last word at each instant; a log is read in slices of time, each by its own task
    instants = clean.groupBy("list", "pattern", "at").agg(F.bool_and(F.col("action") == "add").alias("active"))
    instants = instants.withColumn("slice", _slice(F.col("at"), SLICE_DAYS))
    entry, inner = ["list", "pattern"], Window.partitionBy("list", "pattern", "slice").orderBy("at")
    # the state that each slice begins with: one row per entry and slice
    ends = instants.groupBy(*entry, "slice").agg(F.max_by("active", "at").alias("end"))
    outer = Window.partitionBy(*entry).orderBy("slice")
    begins = ends.select(*entry, "slice", F.lag("end", 1, False).over(outer).alias("begin"))
    # only what differs from the state before remains
    before = F.coalesce(F.lag("active").over(inner), F.col("begin"))
    switched = instants.join(begins, [*entry, "slice"]).withColumn("before", before).filter("active <> before")
    firsts = switched.groupBy(*entry, "slice").agg(F.min("at").alias("first"))
    nexts = firsts.select(*entry, "slice", F.lead("first").over(outer).alias("next"))
    closed = switched.withColumn("after", F.lead("at").over(inner)).join(nexts, [*entry, "slice"])
    return closed.filter("active").select(*entry, F.col("at").alias("valid_from"), F.coalesce("after", "next").alias("valid_to"))


def _slice(at: Column, days: int) -> Column:
    return F.floor(F.unix_date(F.to_date(at)) / F.lit(days)).cast("long")


def _cut_intervals(captures: DataFrame, changes: DataFrame, fetched_at: str, slice_days: int) -> tuple[DataFrame, int]:
    """The intervals once per time slice of the captures that they reach into, broadcast if
    small, and the number of folders of the deepest pattern among them."""
    at = _slice(F.col(fetched_at), slice_days)
    low, high = captures.agg(F.min(at), F.max(at)).first()  # two numbers
    first = F.greatest(_slice(F.col("valid_from"), slice_days), F.lit(low).cast("long"))
    last = F.least(F.coalesce(_slice(F.col("valid_to"), slice_days), F.lit(high).cast("long")), F.lit(high).cast("long"))
    cut = validity_intervals(changes).withColumns({"_first": first, "_last": last})
    # without captures there is no first and last slice, and so no row
    cut = cut.filter(F.lit(low is not None) & (F.col("_first") <= F.col("_last")))
    cut = cut.withColumn("_slice", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last").withColumnRenamed("pattern", "_pattern")
    size = F.coalesce(F.sum(F.octet_length("_pattern") + F.octet_length("list") + 24), F.lit(0))
    depth = F.coalesce(F.max(F.size(F.split("_pattern", "/")) - 1), F.lit(0))
    rows, used, deepest = cut.agg(F.count(F.lit(1)), size, depth).first()
    return F.broadcast(cut) if rows <= BROADCAST_ROWS and used <= BROADCAST_BYTES else cut, deepest


def _match(keyed: DataFrame, side: DataFrame, at: Column, how: str) -> DataFrame:
    active = (F.col("_key_pattern") == F.col("_pattern")) & (keyed["_key_slice"] == side["_slice"])
    active &= (at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    return keyed.join(side, active, how)


def active_entries(captures: DataFrame, changes: DataFrame, url: str = "url", fetched_at: str = "fetched_at", slice_days: int = SLICE_DAYS) -> DataFrame:
    """One row per capture and list entry active when it was fetched: the capture's columns,
    then ``list``, ``pattern``, ``valid_from``, ``valid_to``.

    Captures without an active entry, with a null or hostless URL or a null fetch time
    give no row; a repeated capture gives its rows again. Columns of the captures named
    like the results are left out.
    """
    split_hot_keys(captures.sparkSession)
    names = [c for c in captures.columns if c not in ("list", "pattern", "valid_from", "valid_to")]
    # inner names, so that no column of the captures meets one made here
    kept = captures.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    url, fetched_at = f"c{names.index(url)}", f"c{names.index(fetched_at)}"
    side, depth = _cut_intervals(kept, changes, fetched_at, slice_days)
    keyed = kept.withColumns({"_key_slice": _slice(F.col(fetched_at), slice_days), "_key_pattern": F.explode(url_patterns(F.col(url), depth))})
    matched = _match(keyed, side, F.col(fetched_at).cast("timestamp"), "inner")
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return matched.select(*own, "list", F.col("_pattern").alias("pattern"), "valid_from", "valid_to")


def filter_urls(
    captures: DataFrame, changes: DataFrame, key: str, url: str = "url", fetched_at: str = "fetched_at", slice_days: int = SLICE_DAYS
) -> DataFrame:
    """One row per capture: ``key``, ``url``, ``fetched_at``, ``lists`` (sorted names of the
    lists with an active entry), ``n_entries`` (active entries) and ``blocked``.

    Captures that cannot be judged (null or hostless URL, null fetch time) are not
    blocked. ``key`` need not be unique or set: repeated captures stay repeated. Without
    changes nothing is blocked; an empty table of captures gives no row.
    """
    split_hot_keys(captures.sparkSession)
    narrow = captures.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(fetched_at).alias("_at"))
    side, depth = _cut_intervals(narrow, changes, "_at", slice_days)
    keyed = narrow.withColumns({"_row": F.monotonically_increasing_id(), "_key_slice": _slice(F.col("_at"), slice_days)})
    keyed = keyed.withColumn("_key_pattern", F.explode_outer(url_patterns(F.col("_url"), depth)))
    matched = _match(keyed, side, F.col("_at").cast("timestamp"), "left")
    # the rows of a capture lie side by side: they are joined before the shuffle
    judged = matched.groupBy("_row").agg(
        F.any_value("_key").alias(key),
        F.any_value("_url").alias(url),
        F.any_value("_at").alias(fetched_at),
        F.array_sort(F.collect_set("list")).alias("lists"),
        F.count("list").alias("n_entries"),
    )
    return judged.drop("_row").withColumn("blocked", F.col("n_entries") > 0)
