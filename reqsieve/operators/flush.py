"""Counter windows that close on an event instead of on the clock.

Per monitor, events in order ``(ts, request)``: a window closes at the first
*successful* event at least one period (in whole milliseconds) after the
window's start; that event still belongs to it, and the next window starts at
its time. Failures never close a window, and a last window that has not closed
is not reported.

Every closing depends on the one before, but not on all rows at once. Time is
cut into buckets of one period, and closings are at least a period apart, so a
bucket holds at most one of them. What a stretch of time does to the chain is
a step function: given the earliest moment the next closing may happen, it
tells the last closing inside the stretch. Stretches are combined in a tree,
each node in its own task, and the real closings are then read off on the way
down. Where a few buckets' distinct success times fit a task, a task holds that
many. Where not even two do (long periods, dense successes), the steps of a
stretch are cut once more, into pieces of at most half a task's rows by the
moment they apply to: two stretches are combined by handing each step of the
earlier one to the piece of the later one that its next closing falls into. So
no task holds more than ``TASK_ROWS`` steps, whatever the period and however
many rows a monitor has. A table, or a stream's micro-batch, of no more rows than that
needs none of it: each monitor's rows fit a task, which reads off its windows in order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.functions.periods import period_millis
from reqsieve.operators.counters import MICROS, counter_sums, event_deltas, present
from reqsieve.operators.score import OK
from reqsieve.schemas import COUNTERS
from reqsieve.session import cut_lineage
from reqsieve.sizing import join_side

# How many step-function rows a task is given at most.
TASK_ROWS = 1_000_000
MAX_FANOUT = 1024

# The task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A null monitor is a monitor of its own, told from any name by its mark.
_MONITOR, _NO_MONITOR = "m", "n"

_NEVER = np.iinfo(np.int64).min
_STEPS = "monitor_id string, node long, upto long, last long"
_ENTRIES = "monitor_id string, node long, entry long, last long"


def _key(monitor: Column) -> Column:
    return F.coalesce(F.concat(F.lit(_MONITOR), monitor.cast("string")), F.lit(_NO_MONITOR))


def _children(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each child node in time order with its steps; a child without any is empty."""
    known = rows["upto"].is_valid()
    steps = rows.filter(known)
    node, upto, last = (steps[c].to_numpy() for c in ("node", "upto", "last"))
    order = np.lexsort((upto, node))
    node, upto, last = node[order], upto[order], last[order]
    for child in np.unique(rows["node"].to_numpy()):
        own = slice(*np.searchsorted(node, [child, child + 1]))
        yield int(child), upto[own], last[own]


def _named(monitor: pa.Scalar, **columns) -> pa.Table:
    size = len(next(iter(columns.values())))
    typed = {name: pa.array(values, pa.int64()) for name, values in columns.items()}
    return pa.table({"monitor_id": pa.array([monitor.as_py()] * size, pa.string()), **typed})


def _combine(period: int, fanout: int, node_span: int):
    """Steps of a parent from those of its children."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parent = key[1].as_py()
        # A closing before this stretch allows the next one within a period of its start.
        horizon = parent * fanout * node_span + period
        upto, last = np.empty(0, "int64"), np.empty(0, "int64")
        for _, child_upto, child_last in _children(rows):
            if not len(child_upto):
                continue
            at = np.searchsorted(child_upto, last + period)
            moved = at < len(child_upto)
            last = np.where(moved, child_last[np.minimum(at, len(child_upto) - 1)], last)
            begin = np.searchsorted(child_upto, upto[-1], "right") if len(upto) else 0
            if not len(upto) or upto[-1] < horizon:
                end = np.searchsorted(child_upto, horizon) + 1
                upto, last = np.append(upto, child_upto[begin:end]), np.append(last, child_last[begin:end])
        if not len(upto):
            return _named(key[0], node=[parent], upto=[None], last=[None])
        final = np.append(last[1:] != last[:-1], True)
        return _named(key[0], node=np.full(final.sum(), parent), upto=upto[final], last=last[final])

    return run


def _enter(period: int):
    """The moment from which each child may close, and its last closing."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        entry = rows["entry"][0].as_py()
        nodes, entries, found = [], [], []
        for node, upto, last in _children(rows):
            at = np.searchsorted(upto, entry)
            hit = int(last[at]) if at < len(upto) else None
            nodes.append(node)
            entries.append(entry)
            found.append(hit)
            entry = entry if hit is None else hit + period
        return _named(key[0], node=nodes, entry=entries, last=found)

    return run


def _bucket_entries(steps: DataFrame, period: int, task_rows: int) -> DataFrame:
    """For each bucket: the earliest next closing on entry, and the closing inside."""
    stats = (
        steps.groupBy("monitor_id", "node")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
        .first()
    )
    if stats.n is None:
        return steps.sparkSession.createDataFrame([], _ENTRIES)
    if 2 * stats.n > task_rows:
        return _split_entries(steps, period, max(1, task_rows // 2), stats.low, stats.high)
    fanout = int(min(MAX_FANOUT, task_rows // stats.n))
    levels, span, low, high = [steps], period, stats.low, stats.high
    while high - low >= fanout:
        combined = (
            levels[-1]
            .groupBy("monitor_id", F.floor(F.col("node") / fanout).alias("parent"))
            .applyInArrow(_combine(period, fanout, span), _STEPS)
        )
        levels.append(cut_lineage(combined, "flush-steps"))
        low, high, span = low // fanout, high // fanout, span * fanout
    above = None
    for level in reversed(levels):
        if above is None:
            rows = level.withColumns({"parent": F.lit(0).cast("bigint"), "entry": F.lit(int(_NEVER))})
        else:
            entered = above.select("monitor_id", F.col("node").alias("parent"), "entry")
            rows = level.withColumn("parent", F.floor(F.col("node") / fanout)).join(entered, ["monitor_id", "parent"])
        above = rows.groupBy("monitor_id", "parent").applyInArrow(_enter(period), _ENTRIES)
    return above


_SUMS = (*COUNTERS, MICROS)
_WINDOWS = "monitor_id string, start_ms long, " + ", ".join(f"{c} long" for c in _SUMS) + ", last_us long, closed boolean"


def _walk(period: int):
    """All windows of one monitor, from its rows."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        timed = rows["us"].is_valid()
        windows, apart = [], rows.filter(pc.invert(timed))
        if len(apart):
            windows.append((None, *[pc.sum(apart[c]).as_py() for c in _SUMS], None, True))
        events = rows.filter(timed)
        if len(events):
            # a null order comes first at its time
            events = events.take(pc.sort_indices(events, sort_keys=[("us", "ascending"), ("seq", "ascending")], null_placement="at_start"))
            us, given = events["us"].to_numpy(), events["given"][0].as_py()
            ms = us // 1000
            start = int(ms[0]) if given is None else given
            ms = np.maximum(ms, start)
            good = np.flatnonzero(events["ok"].to_numpy(zero_copy_only=False))
            times, added = ms[good], np.stack([events[c].to_numpy() for c in _SUMS])
            first, at = 0, int(np.searchsorted(times, start + period))
            while first < len(ms) or at < len(good):
                closed = at < len(good)
                last = int(good[at]) if closed else len(ms) - 1
                windows.append((start, *added[:, first : last + 1].sum(axis=1).tolist(), int(us[last]), closed))
                if not closed:
                    break
                first, start = last + 1, int(ms[last])
                at = int(np.searchsorted(times, start + period))
                if first == len(ms):  # every closing opens a window, even if no event follows it
                    windows.append((start, *[0] * len(_SUMS), None, False))
                    break
        names = ["start_ms", *_SUMS, "last_us", "closed"]
        kinds = [pa.int64()] * (len(names) - 1) + [pa.bool_()]
        columns = zip(*windows) if windows else [[]] * len(names)
        made = {name: pa.array(list(column), kind) for name, column, kind in zip(names, columns, kinds)}
        return pa.table({"monitor_id": pa.array([key[0].as_py()] * len(windows), pa.string()), **made})

    return run


def _walked(scored: DataFrame, period: int, monitor: str, ts: str, order: str, threshold: float | None, starts: DataFrame | None) -> DataFrame:
    """``flush_partials`` where every monitor's rows fit a task: one shuffle."""
    time = F.col(ts).cast("timestamp")
    deltas = [value.alias(name) for name, value in event_deltas(threshold).items()]
    events = scored.select(_key(F.col(monitor)).alias("monitor_id"), F.unix_micros(time).alias("us"), F.col(order).alias("seq"), (F.col("status") == OK).alias("ok"), *deltas)
    if starts is None:
        events = events.withColumn("given", F.lit(None).cast("long"))
    else:
        events = events.join(starts.select("monitor_id", F.col("start_ms").alias("given")), "monitor_id", "left")
    windows = events.groupBy("monitor_id").applyInArrow(_walk(period), _WINDOWS)
    return windows.select("monitor_id", "start_ms", *_SUMS, F.timestamp_micros("last_us").alias("last_ts"), "closed")


def _unkeyed(windows: DataFrame) -> DataFrame:
    return windows.withColumn("monitor_id", F.when(F.col("monitor_id") != _NO_MONITOR, F.expr(f"substring(monitor_id, {len(_MONITOR) + 1})")))


_NODE = ["monitor_id", "node"]


def _pieces(steps: DataFrame, width: int) -> DataFrame:
    """Steps with the piece of time they apply to: at most ``width`` of a node are in one."""
    return steps.filter("upto IS NOT NULL").withColumn("piece", F.floor(F.col("upto") / width))


def _next_piece(wanted: DataFrame, later: DataFrame) -> DataFrame:
    """``(monitor_id, node, piece, head)``: for each wanted piece, the first step of the pieces after it.

    One row per piece: their number is that of the pieces in a period, not of the events.
    """
    heads = later.groupBy(*_NODE, "piece").agg(F.min(F.struct("upto", "last")).alias("first"))
    both = heads.unionByName(wanted.select(*_NODE, "piece").distinct(), allowMissingColumns=True)
    known = both.groupBy(*_NODE, "piece").agg(F.max("first").alias("first"))
    after = Window.partitionBy(*_NODE).orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    return known.withColumn("head", F.last("first", ignorenulls=True).over(after)).drop("first")


def _first_steps(asked: DataFrame, later: DataFrame, width: int) -> DataFrame:
    """``asked (monitor_id, node, entry, ...)`` with ``hit``: the last closing of the node's first
    step at or after ``entry``, null if there is none.

    Within a piece, the steps and the entries that fall into it are read in falling order of
    time; beyond it, the head of the next piece answers.
    """
    pieced = asked.withColumn("piece", F.floor(F.col("entry") / width))
    mixed = later.select(*_NODE, "piece", F.col("upto").alias("at"), F.col("last").alias("closing")).unionByName(
        pieced.withColumn("at", F.col("entry")), allowMissingColumns=True
    )
    # at one moment the step comes before the entry
    falling = Window.partitionBy(*_NODE, "piece").orderBy(F.desc("at"), F.col("entry").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = mixed.withColumn("inside", F.last("closing", ignorenulls=True).over(falling)).filter("entry IS NOT NULL").drop("closing", "at")
    answered = inside.join(_next_piece(pieced, later), [*_NODE, "piece"], "left")
    return answered.withColumn("hit", F.coalesce("inside", F.col("head.last"))).drop("piece", "inside", "head")


def _split_entries(steps: DataFrame, period: int, width: int, low: int, high: int) -> DataFrame:
    """``_bucket_entries`` where two buckets do not fit a task: a binary tree over pieces of stretches."""
    width = min(width, period)
    levels, span = [steps.select("monitor_id", "node", "upto", "last")], period
    while high > low:
        below = levels[-1]
        nodes = below.select("monitor_id", F.floor(F.col("node") / 2).alias("node")).distinct()
        known = below.filter("upto IS NOT NULL").withColumn("side", F.pmod("node", F.lit(2))).withColumn("node", F.floor(F.col("node") / 2))
        early, late = known.filter("side = 0").drop("side"), _pieces(known.filter("side = 1").drop("side"), width)
        early = early.withColumn("entry", F.col("last") + period)
        # many steps may end at one closing, which is looked up once
        answers = _first_steps(early.select(*_NODE, "entry").distinct(), late, width)
        handed = early.join(answers, [*_NODE, "entry"]).select(*_NODE, "upto", F.coalesce("hit", "last").alias("last"))
        # what enters after the earlier half's last step closes at the later half's first
        reach = early.groupBy(*_NODE).agg(F.max("upto").alias("reach"))
        first = late.groupBy(*_NODE).agg(F.min(F.struct("upto", "last")).alias("first")).join(reach, _NODE, "left")
        horizon = F.col("node") * 2 * span + period
        first = first.filter(F.col("reach").isNull() | (F.col("reach") < horizon)).select(*_NODE, "first.upto", "first.last")
        merged = handed.unionByName(first)
        merged = nodes.join(merged, _NODE, "left").select(*_NODE, "upto", "last")
        levels.append(cut_lineage(merged, "flush-steps"))
        low, high, span = low // 2, high // 2, span * 2
    entries = levels[-1].select(*_NODE).distinct().withColumn("entry", F.lit(int(_NEVER)))
    for depth, level in enumerate(reversed(levels)):
        if depth:
            # the earlier half is entered like the whole; the later one after the earlier one's closing
            halves = level.select(*_NODE).distinct().withColumns({"side": F.pmod("node", F.lit(2)), "parent": F.floor(F.col("node") / 2)})
            given = entries.select("monitor_id", F.col("node").alias("parent"), "entry")
            halves = halves.join(given, ["monitor_id", "parent"])
            early = _first_steps(halves.filter("side = 0"), _pieces(level, width), width)
            closed = early.select("monitor_id", "parent", (F.col("hit") + period).alias("after"))
            late = halves.filter("side = 1").join(closed, ["monitor_id", "parent"], "left")
            late = late.select(*_NODE, F.coalesce("after", "entry").alias("entry"))
            entries = cut_lineage(early.select(*_NODE, "entry").unionByName(late), "flush-entries")
    return _first_steps(entries, _pieces(levels[0], width), width).select(*_NODE, "entry", F.col("hit").alias("last"))


def flush_partials(
    scored: DataFrame,
    period: str = "PT30S",
    monitor: str = "monitor_id",
    ts: str = "ts",
    order: str = "request_id",
    threshold: float | None = 0.7,
    starts: DataFrame | None = None,
    task_rows: int = TASK_ROWS,
    walk_rows: int | None = None,
) -> DataFrame:
    """Additive counters of every window, the open last one (``closed`` false) included,
    which has no events yet if the last event closed the one before.

    ``starts`` (``monitor_id, start_ms``) gives the moment a monitor's first
    window begins; a monitor without one begins at its first event. Events
    earlier than the start count into that first window. ``ts`` and ``order``
    together are the order of arrival; a null ``order`` comes first at its time.
    Events without a time belong to no moment: they are one closed window per
    monitor without a start, so that all windows add up to all events.

    Up to ``walk_rows`` rows (``task_rows`` by default) are read off monitor by monitor; more go through the tree.
    """
    millis = period_millis(period)
    deltas = event_deltas(threshold)
    if starts is not None:
        starts = starts.filter("start_ms IS NOT NULL").withColumn("monitor_id", _key(F.col("monitor_id")))
    if scored.count() <= (task_rows if walk_rows is None else walk_rows):
        return _unkeyed(_walked(scored, millis, monitor, ts, order, threshold, starts))
    timeless = scored.filter(F.col(ts).isNull())
    events = scored.filter(F.col(ts).isNotNull()).select(
        _key(F.col(monitor)).alias("monitor_id"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.col(order).alias("seq"),
        F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"),
        (F.col("status") == OK).alias("ok"),
        *[value.alias(name) for name, value in deltas.items()],
    )
    if starts is not None:
        events = events.join(join_side(starts.select("monitor_id", "start_ms")), "monitor_id", "left").withColumn(
            "ms", F.greatest("ms", "start_ms")
        )
    events = events.withColumn("node", F.floor(F.col("ms") / millis))

    # Distinct success times, plus one row for each bucket with failures.
    times = cut_lineage(
        events.groupBy("monitor_id", "node", F.when(F.col("ok"), F.col("ms")).alias("upto")).agg(
            F.min("ms").alias("first_ms")
        ),
        "flush-times",
    )
    origin = times.groupBy("monitor_id").agg(F.min("first_ms").alias("upto"))
    if starts is not None:
        given = starts.select("monitor_id", F.col("start_ms").alias("given"))
        origin = origin.join(given, "monitor_id", "left").select(
            "monitor_id", F.coalesce("given", "upto").alias("upto")
        )
    # The origin acts as closing number zero: the first step of its monitor.
    steps = times.select("monitor_id", "node", "upto").unionByName(
        origin.select("monitor_id", F.floor(F.col("upto") / millis).alias("node"), "upto")
    )
    entries = _bucket_entries(steps.withColumn("last", F.col("upto")), millis, task_rows)
    buckets = cut_lineage(
        entries.select(
            "monitor_id",
            "node",
            F.when(F.col("entry") != int(_NEVER), F.col("entry") - millis).alias("before_ms"),
            F.col("last").alias("inside_ms"),
        ),
        "flush-buckets",
    )

    # Events before and after the closing time of their bucket are added up at
    # once; those of the very millisecond stay apart until their order is known.
    before, inside, ms = F.col("before_ms"), F.col("inside_ms"), F.col("ms")
    zone = (
        F.when(before.isNull() | (ms > inside), "after").when(inside.isNull() | (ms < inside), "before").otherwise("at")
    )
    zoned = events.join(join_side(buckets), ["monitor_id", "node"]).withColumn("zone", zone)
    moment = [F.when(F.col("zone") == "at", F.col(c)).alias(f"at_{c}") for c in ("ts", "seq", "ok")]
    parts = cut_lineage(
        zoned.groupBy("monitor_id", "node", "before_ms", "inside_ms", "zone", *moment).agg(
            *counter_sums(), F.max("ts").alias("last_ts")
        ),
        "flush-parts",
    )
    position = F.struct("at_ts", "at_seq")
    closing = parts.filter("at_ok").groupBy("monitor_id", "node").agg(F.min(position).alias("closing"))
    ordered = parts.join(join_side(closing), ["monitor_id", "node"], "left")
    in_old = (F.col("zone") == "before") | ((F.col("zone") == "at") & (position <= F.col("closing")))
    counted = ordered.select(
        "monitor_id",
        F.when(in_old, before).otherwise(inside).alias("start_ms"),
        *deltas,
        "last_ts",
        ((F.col("zone") == "at") & (position == F.col("closing"))).alias("closed"),
    )
    # Every closing opens a window, even if no event follows it.
    opened = buckets.filter("before_ms IS NOT NULL AND inside_ms IS NOT NULL").select(
        "monitor_id",
        F.col("inside_ms").alias("start_ms"),
        *[F.lit(0).cast("bigint").alias(name) for name in deltas],
        F.lit(None).cast("timestamp").alias("last_ts"),
        F.lit(False).alias("closed"),
    )
    apart = timeless.select(_key(F.col(monitor)).alias("monitor_id"), *[value.alias(name) for name, value in deltas.items()])
    apart = apart.groupBy("monitor_id").agg(*counter_sums()).select(
        "monitor_id",
        F.lit(None).cast("bigint").alias("start_ms"),
        *deltas,
        F.lit(None).cast("timestamp").alias("last_ts"),
        F.lit(True).alias("closed"),
    )
    return _unkeyed(merge_partials(counted.unionByName(opened).unionByName(apart)))


def merge_partials(parts: DataFrame) -> DataFrame:
    """One row per monitor and window from any number of partial rows."""
    return parts.groupBy("monitor_id", "start_ms").agg(
        *counter_sums(), F.max("last_ts").alias("last_ts"), F.max("closed").alias("closed")
    )


def present_windows(partials: DataFrame) -> DataFrame:
    """Closed windows with their bounds and averages."""
    closed = partials.filter("closed").select(
        "monitor_id",
        F.timestamp_millis("start_ms").alias("window_start"),
        F.col("last_ts").alias("window_end"),
        *COUNTERS,
        MICROS,
    )
    return present(closed)


def flush_windows(scored: DataFrame, period: str = "PT30S", **options) -> DataFrame:
    """The closed windows of a scored table, one row per monitor and window."""
    return present_windows(flush_partials(scored, period, **options))
