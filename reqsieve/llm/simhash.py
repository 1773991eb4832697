"""Near duplicates by SimHash: 64-bit fingerprints, linked within a Hamming distance, by vantage-point trees.

**Fingerprints.** A text's three-word shingles, repeats included, are hashed with XXH64; a bit
of the fingerprint is 1 if it is set in over half of the hashes. Equal fingerprints are one
node from here on, so copies cost nothing.

**Shards.** A vantage-point tree over a bounded sample deals all fingerprints to shards: at
each of its nodes those within the median distance of the vantage point go one way, the others the
other way. Two fingerprints at most ``distance`` apart differ by no more than that in their
distance to a vantage point (triangle inequality). So a pair that a node separates has its
inner member no farther inside the boundary than ``distance``, and such members are sent to
the outer side as queries as well: every pair meets in the shard of one of the two.

**Search.** Each shard builds its own tree and sends its members and its queries down,
many at a time. A branch whose range of distances is out of a query's reach is left out, and so is a
branch all in the query's own component already. The shard returns a spanning forest of the links
it found, at most one row per fingerprint it was given, however many pairs a group of
near copies has. Components over all forests are those over all links.

A shard too large for a task is cut into blocks of members, each searched by the queries of
the shard and the members of the blocks before it; many queries of one block are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.llm.neardup import components
from reqsieve.llm.textbytes import mix
from reqsieve.session import Scratch, cut_lineage, split_hot_keys
from reqsieve.sizing import join_side

SHINGLE_WORDS, DISTANCE = 3, 3
_SEED = 42
#: Bytes of a text whose words are held at once.
PIECE_BYTES = 1 << 20

#: Fingerprints of a shard: at least so many, and a 64th of all, up to so many shards.
SHARD_LEAST, SHARDS_FIRST, SHARDS_MOST = 2_000, 64, 1_024
#: Fingerprints of the sample that the shards' tree is built on, for each shard.
SAMPLE_OF_SHARD = 64
#: Members of a block, and queries of a task, at most.
BLOCK_MEMBERS, TASK_QUERIES = 1 << 21, 1 << 22
_LEAF, _CANDIDATES, _PROBES = 64, 8, 256
_BATCH = 8_192
#: Fingerprints that a task collects before it hands them on.
_PACK = 1 << 19

# --- fingerprints ---------------------------------------------------------------


def _pieces(raw: bytes, limit: int) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    low = 0
    while low < len(raw):
        cut = low + limit
        while cut < len(raw) and not raw[cut : cut + 1].isspace():
            cut += 1
        yield raw[low:cut]
        low = cut


def fingerprint(text: str | None, size: int = SHINGLE_WORDS, piece_bytes: int = PIECE_BYTES) -> int:
    """The 64 bits of a text: 0 for a null text or one without words; of fewer than ``size`` words, those of all of them."""
    digest = xxhash.xxh64_intdigest
    ones, total, words = np.zeros(64, np.int64), 0, []
    for piece in _pieces((text or "").encode().lower(), piece_bytes):  # bytes: A-Z alone are lowered
        words = words + piece.split()
        count = len(words) - size + 1
        if count > 0:
            found = np.fromiter((digest(b" ".join(s), _SEED) for s in zip(*(words[k:] for k in range(size)))), np.uint64, count)
            ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total, words = total + count, words[count:]
    if not total:
        return digest(b" ".join(words), _SEED) if words else 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, print)`` of every row, the print as a signed long."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("print", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return rows.mapInArrow(task, schema)


# --- vantage-point trees -----------------------------------------------------------


class Tree(NamedTuple):
    """Nodes in the order of their making. A leaf has ``inner`` -1."""

    vantage: np.ndarray
    inner: np.ndarray  # the child within the radius; the other child
    outer: np.ndarray
    reach: np.ndarray  # nodes x 4: least and greatest distance within, and beyond
    start: np.ndarray  # range of ``order`` below each node
    end: np.ndarray
    order: np.ndarray  # places of the points, by leaves


def far(points: np.ndarray, other: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ other)


def _vantage(points: np.ndarray, draw: np.random.Generator) -> np.uint64:
    """Of some points, the one whose distances spread most."""
    if len(points) <= _CANDIDATES:
        return points[0]
    probes = points[draw.integers(0, len(points), _PROBES)]
    tried = points[draw.integers(0, len(points), _CANDIDATES)]
    return tried[np.argmax(np.var(far(probes[None, :], tried[:, None]).astype(np.float32), axis=1))]


def build(points: np.ndarray, leaf: int, links: tuple[list, list] | None = None, distance: int = DISTANCE) -> Tree:
    """The tree of ``points``; ``links`` gets pairs of places within ``distance`` met on the way."""
    draw = np.random.default_rng(7)
    order = np.arange(len(points))
    made: list[list] = []
    todo = [(0, len(points), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        if parent >= 0:
            made[parent][1 + side] = len(made)
        own = order[start:end]
        values = points[own]
        node = [np.uint64(0), -1, -1, (0, 0, 0, 0), start, end]
        made.append(node)
        if not len(own):
            continue
        node[0] = vantage = _vantage(values, draw)
        away = far(values, vantage)
        if links is not None:
            near = np.flatnonzero(away <= distance)
            links[0].append(own[near])
            links[1].append(np.full(len(near), own[np.argmin(away)]))
        radius = np.partition(away, (len(away) - 1) // 2)[(len(away) - 1) // 2]
        inside = away <= radius
        if inside.all():  # the median is the greatest distance: take those beyond the next smaller one
            smaller = away[away < radius]
            inside = away <= smaller.max() if len(smaller) else inside
        if len(own) <= leaf or inside.all():
            continue
        split = int(inside.sum())
        order[start:end] = np.concatenate([own[inside], own[~inside]])
        node[3] = (away[inside].min(), away[inside].max(), away[~inside].min(), away[~inside].max())
        todo.append((start, start + split, len(made) - 1, 0))
        todo.append((start + split, end, len(made) - 1, 1))
    columns = list(zip(*made))
    return Tree(np.array(columns[0], np.uint64), *(np.array(c, np.int64) for c in columns[1:3]), np.array(columns[3], np.int64).reshape(-1, 4), *(np.array(c, np.int64) for c in columns[4:6]), order)


def settle(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the components of linked places; ``label`` holds the smallest place of each component."""
    while True:
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            return
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _common_label(tree: Tree, label: np.ndarray) -> np.ndarray:
    """The component of each node's points if they are all in one, else -1."""
    common = np.empty(len(tree.inner), np.int64)
    for k in range(len(common) - 1, -1, -1):  # children are made after their parents
        if tree.inner[k] >= 0:
            a, b = common[tree.inner[k]], common[tree.outer[k]]
            common[k] = a if a == b else -1
        else:
            own = label[tree.order[tree.start[k] : tree.end[k]]]
            common[k] = own[0] if len(own) and (own == own[0]).all() else -1
    return common


def spanning_links(members: np.ndarray, queries: np.ndarray, both: int, distance: int = DISTANCE, leaf: int = _LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between queries and members; the first ``both`` members are queries too.

    Links between members that are no queries are in it only if the tree met them.
    """
    points = np.concatenate([members, queries])
    label = np.arange(len(points))
    links: tuple[list, list] = ([], [])
    tree = build(members, leaf, links, distance)
    if len(members):
        settle(label, np.concatenate(links[0]), np.concatenate(links[1]))
    asked = np.concatenate([np.arange(both), np.arange(len(members), len(points))])
    common = _common_label(tree, label)
    for first in range(0, len(asked) if len(members) else 0, _BATCH):
        left, right = [], []
        todo = [(0, asked[first : first + _BATCH])]
        while todo:
            node, query = todo.pop()
            if common[node] >= 0:  # all of the branch are linked to these already
                query = query[label[query] != common[node]]
            if not len(query):
                continue
            if tree.inner[node] >= 0:
                away = far(points[query], tree.vantage[node]).astype(np.int64)
                low, high, beyond, most = tree.reach[node]
                todo.append((tree.inner[node], query[(away >= low - distance) & (away <= high + distance)]))
                todo.append((tree.outer[node], query[(away >= beyond - distance) & (away <= most + distance)]))
                continue
            own = tree.order[tree.start[node] : tree.end[node]]
            for a in range(0, len(own), leaf):
                part = own[a : a + leaf]
                hit = far(points[query][:, None], points[part][None, :]) <= distance
                if common[node] >= 0:  # any one will do
                    q = np.flatnonzero(hit.any(axis=1))
                    left.append(query[q])
                    right.append(part[np.argmax(hit[q], axis=1)])
                else:
                    q, m = np.nonzero(hit)
                    new = label[query[q]] != label[part[m]]
                    left.append(query[q[new]])
                    right.append(part[m[new]])
        if sum(map(len, left)):
            settle(label, np.concatenate(left), np.concatenate(right))
            common = _common_label(tree, label)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return points[linked], points[label[linked]]


# --- shards --------------------------------------------------------------------------


def leaf_numbers(tree: Tree) -> np.ndarray:
    """Number of each leaf, -1 for other nodes."""
    leaves = tree.inner < 0
    return np.where(leaves, np.cumsum(leaves) - 1, -1)


def route(tree: Tree, points: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf its members and the others that must be searched for there, as places of ``points``."""
    number = leaf_numbers(tree)
    todo = [(0, np.arange(len(points)), np.zeros(0, np.int64))]
    while todo:
        node, home, guest = todo.pop()
        if tree.inner[node] < 0:
            yield int(number[node]), home, guest
            continue
        radius = tree.reach[node, 1]
        at, visit = far(points[home], tree.vantage[node]).astype(np.int64), far(points[guest], tree.vantage[node]).astype(np.int64)
        within = at <= radius
        # the greatest distance within decides, for points that the tree was not built on too
        crossing = home[within & (at > radius - distance)]
        todo.append((tree.inner[node], home[within], guest[visit <= radius + distance]))
        todo.append((tree.outer[node], home[~within], np.concatenate([guest[visit > radius - distance], crossing])))


class Plan(NamedTuple):
    """Which tasks work on each leaf: ``blocks`` of members times ``deals`` of queries, from number ``first`` on."""

    tree: Tree
    first: np.ndarray
    blocks: np.ndarray
    deals: np.ndarray


def _shard_tree(nodes: DataFrame, total: int, shards_most: int) -> Tree:
    """A tree over a sample of ``SAMPLE_OF_SHARD`` fingerprints for each shard, drawn by hash."""
    shards = max(1, min(shards_most, max(SHARDS_FIRST, total // BLOCK_MEMBERS), total // SHARD_LEAST))
    wanted, span = SAMPLE_OF_SHARD * shards, 1 << 30
    chosen = F.pmod(F.xxhash64("print", F.lit("shards")), F.lit(span)) < max(1, span * wanted // max(total, wanted))
    sample = np.sort(np.array([r[0] for r in nodes.filter(chosen).select("print").collect()], np.int64)).view(np.uint64)
    return build(sample, max(1, len(sample) // shards))


def _sent(nodes: DataFrame, plan: Plan | None, tree: Tree, distance: int) -> DataFrame:
    """Fingerprints packed by task: ``(task, role, prints)`` with role 0 for members, 1 for members
    that are queries too, 2 for queries. Without a plan, the counts of each leaf: ``(leaf, members, queries)``."""
    shared = nodes.sparkSession.sparkContext.broadcast((plan, tree))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value[1]
        leaves = int((tree.inner < 0).sum())
        sums = np.zeros((leaves, 2), np.int64)
        for points in _packs(batches):
            for leaf, home, guest in route(tree, points, distance):
                sums[leaf] += (len(home), len(home) + len(guest))
        used = np.flatnonzero(sums[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used, 0]), pa.array(sums[used, 1])], names=["leaf", "members", "queries"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value[0]
        for points in _packs(batches):
            digest = mix(points ^ np.uint64(0xD1B54A32D192ED03))
            rows: list[tuple[int, int, bytes]] = []
            for leaf, home, guest in route(plan.tree, points, distance):
                blocks, deals = int(plan.blocks[leaf]), int(plan.deals[leaf])
                for deal in range(deals):
                    asks = lambda x: (digest[x] >> np.uint64(32)) % np.uint64(deals) == deal  # noqa: E731, B023
                    mine, visitors = asks(home), guest[asks(guest)]
                    own = (digest[home] & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)
                    for block in range(blocks):
                        task = int(plan.first[leaf]) + block * deals + deal
                        here = own == block
                        # members of earlier blocks search later ones
                        others = np.concatenate([home[mine & (own < block)], visitors])
                        for role, places in ((0, home[here & ~mine]), (1, home[here & mine]), (2, others)):
                            if len(places):
                                rows.append((task, role, points[places].tobytes()))
            numbers, roles, packed = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(roles, pa.int32()), pa.array(packed, pa.binary())], names=["task", "role", "prints"])

    if plan is None:
        return nodes.select("print").mapInArrow(counted, "leaf int, members long, queries long")
    return nodes.select("print").mapInArrow(dealt, "task int, role int, prints binary")


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy().view(np.uint64))
        size += len(batch)
        if size >= _PACK:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _links(nodes: DataFrame, distance: int, shards_most: int, block_members: int, task_queries: int) -> DataFrame:
    """``(a, b)``: a forest that joins all fingerprints within ``distance`` of each other."""
    total = nodes.count()
    tree = _shard_tree(nodes, total, shards_most)
    leaves = int((tree.inner < 0).sum())
    sizes = np.zeros((leaves, 2), np.int64)
    for row in _sent(nodes, None, tree, distance).groupBy("leaf").agg(F.sum("members"), F.sum("queries")).collect():  # one row per shard
        sizes[row[0]] = row[1:]
    blocks, deals = np.maximum(1, -(-sizes[:, 0] // block_members)), np.maximum(1, -(-sizes[:, 1] // task_queries))
    tasks = int((blocks * deals).sum())
    plan = Plan(tree, np.cumsum(blocks * deals) - blocks * deals, blocks, deals)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, ([], [], [])

        def worked() -> pa.RecordBatch:
            members, both, others = (np.concatenate([np.frombuffer(p, np.uint64) for p in part]) if part else np.zeros(0, np.uint64) for part in held)
            a, b = spanning_links(np.concatenate([both, members]), others, len(both), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            for number, role, prints in zip(*(c.to_pylist() for c in batch.columns)):
                if task is not None and number != task:
                    yield worked()
                    held = ([], [], [])
                task = number
                held[role].append(prints)
        if task is not None:
            yield worked()

    dealt = _sent(nodes, plan, tree, distance).repartitionById(tasks, F.col("task"))
    return dealt.sortWithinPartitions("task").mapInArrow(search, "a long, b long")


def simhash_components(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    distance: int = DISTANCE,
    size: int = SHINGLE_WORDS,
    shards_most: int = SHARDS_MOST,
    block_members: int = BLOCK_MEMBERS,
    task_queries: int = TASK_QUERIES,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row: 16 hex digits, and the smallest id reachable over links.

    Texts are linked if their fingerprints differ in at most ``distance`` bits. A null text,
    an empty one and one without words have fingerprint zero and are linked like any other;
    a text of fewer than ``size`` words is one shingle; a long text is hashed in pieces.
    Repeated rows stay rows. A row without an id is linked too; a component of such
    rows alone has no id. An empty table gives no rows. Other columns play no part.
    """
    spark = split_hot_keys(docs.sparkSession)
    with Scratch(spark, "simhash") as scratch:
        prints = scratch.table(fingerprints(docs, text, id, size), "prints")
        nodes = scratch.table(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
        links = scratch.table(_links(nodes, distance, shards_most, block_members, task_queries), "links")
        labels = components(links, scratch).withColumnRenamed("node", "print")
        linked = scratch.table(nodes.join(join_side(labels), "print"), "linked")
        least = linked.groupBy("label").agg(F.min("least").alias("component"))
        grouped = linked.select("print", "label").join(join_side(least), "label").select("print", "component")
        # fingerprints without a link are components of their own
        reached = nodes.join(join_side(grouped), "print", "left").select("print", F.coalesce("component", "least").alias("component_id"))
        digits = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
        return cut_lineage(prints.join(join_side(reached), "print").select("doc_id", digits, "component_id"), "simhash")
