"""Near duplicates: weighted MinHash over TF-IDF shingles, bands, exact weighted Jaccard, classes.

A text is the multiset of its five-word shingles; a shingle's weight is its count times
its inverse document frequency. Improved consistent weighted sampling draws samples that
two texts share with a probability equal to their weighted Jaccard similarity

    sum of min(weight) / sum of max(weight)

so with 14 bands of 4 samples a pair at the threshold of 0.8 meets in some band with a
probability of 0.9994, a pair at 0.85 with 0.99998, one at 0.3 with 0.11. Pairs that meet are verified on
their whole multisets.

Nodes are distinct texts, so copies cost nothing. A band's bucket is not expanded into its
pairs: all members are compared with the bucket's hub, that of the most company in all
buckets and so likely what the others were copied from, and links found are closed to classes. Members of
different classes that share a hub can only be linked if they share a shingle that the hub lacks, or if one is
much lighter than the hub (``_closed``): those meet a next hub, among the members of such a shingle, until no
group is divided. What this gives is the classes that all links between bucket members would give.

Document frequencies are counted over all rows in ``2 ** IDF_BITS`` hash buckets, as
Spark's HashingTF and IDF do, so their table has one size for any corpus: a passage in many
documents weighs least. A large group of copies makes its own passages frequent, and must not
thereby push its members apart: the frequency moves a weight by ``IDF_SPREAD`` at most, so any two
texts of a plain similarity of 0.817 or more reach 0.8, whatever the size of their group, and
none below 0.784 does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.llm import textbytes
from reqsieve.llm.worker import held, lean
from reqsieve.session import Scratch, cut_lineage, split_hot_keys

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_SAMPLES = 14, 4
IDF_BITS = 20
#: The rarest shingle weighs so much more than one that stands in every text, which weighs 1.
IDF_SPREAD = 0.1
#: Lists of text fingerprints are broadcast up to so many rows (of 16 bytes).
BROADCAST_ROWS = 250_000
#: Rounds in which members meet a next hub, before what is left is listed.
HUB_ROUNDS = 3
#: Rows, and shingles beyond a hub, that a task holds at once.
_ROWS_BEYOND, _SHINGLES_BEYOND = 100, 50_000
_SLICE = 1024
_FEATURE_BITS = 44
_CELL_BITS = 15
_CHUNK = 1 << 18


def fingerprint(text: Column) -> Column:
    """128 bits of a text; equal texts are the same node."""
    return F.unhex(F.md5(text.cast("binary")))


# --- shingles and their weights ------------------------------------------------


def features(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in 44 bits: (row, shingle, count), by row."""
    found = textbytes.words(data, offsets)
    code, row = textbytes.shingles(textbytes.hashes(data, found), found.bounds, size)
    shift = np.uint64(64 - _FEATURE_BITS)
    key = np.sort((row.astype(np.uint64) << np.uint64(_FEATURE_BITS)) | (code >> shift))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(_FEATURE_BITS)).astype(np.int64), key & np.uint64((1 << _FEATURE_BITS) - 1), count


def _bucket(feature: np.ndarray) -> np.ndarray:
    return (feature & np.uint64((1 << IDF_BITS) - 1)).astype(np.int64)


def _row_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    # row numbers must fit beside the 44 bits of a shingle
    for first, last, data, offsets in textbytes.text_chunks(column, _CHUNK):
        for a in range(0, last - first, 1 << 18):
            b = min(a + (1 << 18), last - first)
            yield first + a, first + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def document_frequencies(docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS) -> tuple[int, np.ndarray]:
    """The number of rows with shingles, and for each hash bucket the number of rows with a shingle in it.

    Each task counts in one array and hands on its slices; the sums of a slice are made
    by whichever task gets it. The result is ``2 ** IDF_BITS`` numbers.
    """
    slices = (1 << IDF_BITS) // _SLICE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in _row_chunks(batch.column(0)):
                row, feature, _ = features(data, offsets, size)
                key = np.unique((row << IDF_BITS) | _bucket(feature))
                table += np.bincount(key & ((1 << IDF_BITS) - 1), minlength=len(table))
                rows += len(np.unique(row))
        if rows:
            # small numbers in few bytes
            kind = next(k for k in (np.uint16, np.uint32, np.int64) if table.max() <= np.iinfo(k).max)
            blobs = [part.astype(kind).tobytes() for part in table.reshape(slices, _SLICE)]
            numbers = pa.array([*range(slices), -1], pa.int32())
            yield pa.RecordBatch.from_arrays([numbers, pa.array([*blobs, np.array([rows]).tobytes()], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = blob.as_py()
                kind = np.int64 if number < 0 else {2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // _SLICE]
                part = np.frombuffer(raw, kind).astype(np.int64)
                sums[number] = sums[number] + part if number in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    parts = docs.select(F.col(text).alias("text")).mapInArrow(lean(count), schema)
    total, table = 0, np.zeros((slices, _SLICE), np.int64)
    for row in parts.repartition("slice").mapInArrow(lean(add), schema).collect():  # one row per slice
        if row["slice"] < 0:
            total += int(np.frombuffer(row["counts"], np.int64)[0])
        else:
            table[row["slice"]] += np.frombuffer(row["counts"], np.int64)
    return total, table.ravel()


def inverse_frequencies(total: int, frequencies: np.ndarray) -> np.ndarray:
    """``1 + IDF_SPREAD * ln((1 + rows) / (1 + frequency)) / ln(1 + rows)``: from 1 to ``1 + IDF_SPREAD``, at any number of rows."""
    share = np.log((1 + total) / (1 + frequencies)) / np.log(2 + total)
    return (1 + IDF_SPREAD * np.maximum(share, 0)).astype(np.float32)


# --- consistent weighted samples ---------------------------------------------


class Sampler:
    """Improved consistent weighted sampling, several samples per row, as band keys.

    A shingle's r and beta come from one cell of a table and its c from another one, picked by
    different bits of its hash: 2 ** 30 combinations, so that no two shingles of a text, however
    long, are likely to share all three.
    """

    def __init__(self, log_idf: np.ndarray, bands: int, band_samples: int):
        self.log_idf, self.bands, self.samples = log_idf, bands, bands * band_samples
        self.band_samples = band_samples
        draw = np.random.Generator(np.random.PCG64(20))
        size = 1 << _CELL_BITS
        self.cells, self.log_c = np.empty((self.samples, size, 4), np.float32), np.empty((self.samples, size), np.float32)
        for cells, log_c in zip(self.cells, self.log_c):
            r, c, beta = draw.gamma(2.0, 1.0, size), draw.gamma(2.0, 1.0, size), draw.uniform(0.0, 1.0, size)
            # of a shingle with log weight w: t = floor(w / r + beta), and the smallest ln c - r (t - beta) - r wins
            cells[:] = np.stack([1 / r, beta, r, r * beta - r], axis=1)
            log_c[:] = np.log(c)
        self.factors = textbytes.seeded(self.samples, 4) | np.uint64(1)

    def band_keys(self, rows: int, row: np.ndarray, feature: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have shingles, and their key in each band."""
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        if not len(first):
            return first, np.zeros((0, self.bands), np.uint64)
        weight = self.log_idf[_bucket(feature)] + np.log(count).astype(np.float32)
        keys = np.zeros((len(first), self.bands), np.uint64)
        spread = textbytes.mix(feature)
        high, low, mask = np.uint64(64 - _CELL_BITS), np.uint64(64 - 2 * _CELL_BITS), np.uint64((1 << _CELL_BITS) - 1)
        for k in range(self.samples):
            digest = spread * self.factors[k]
            cell = np.take(self.cells[k], (digest >> high).astype(np.int64), axis=0)
            t = np.floor(weight * cell[:, 0] + cell[:, 1])
            value = cell[:, 3] - cell[:, 2] * t + np.take(self.log_c[k], (digest >> low & mask).astype(np.int64))
            least = np.minimum.reduceat(value, first)
            # the value tells the winning cells and their t, and so the sample
            band = k // self.band_samples
            keys[:, band] = textbytes.mix(keys[:, band] + least.view(np.uint32).astype(np.uint64) + np.uint64(band + 1 << 40))
        return row[first], keys


def _sampler(idf: Broadcast, bands: int, band_samples: int) -> Sampler:
    key = (idf.id if hasattr(idf, "id") else id(idf), float(idf.value.sum()), bands, band_samples)
    return held("sampler", key, lambda: Sampler(np.log(idf.value), bands, band_samples))


def band_table(docs: DataFrame, idf: Broadcast, size: int = SHINGLE_WORDS, bands: int = BANDS, band_samples: int = BAND_SAMPLES) -> DataFrame:
    """Rows ``(doc_id, node, bands)`` of rows ``(doc_id, text)``; a text without words has no bands."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(idf, bands, band_samples)
        for batch in batches:
            for first, last, data, offsets in _row_chunks(batch.column("text")):
                row, keys = sampler.band_keys(last - first, *features(data, offsets, size))
                width = np.zeros(last - first, np.int64)
                width[row] = bands
                bounds = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32())
                lists = pa.ListArray.from_arrays(bounds, pa.array(keys.ravel().view(np.int64)))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), lists], names=["doc_id", "node", "bands"])

    return docs.select("doc_id", fingerprint(F.col("text")).alias("node"), "text").mapInArrow(lean(task, "sampler"), schema)


# --- verification --------------------------------------------------------------


def shingle_sets(texts: DataFrame, idf: Broadcast, size: int = SHINGLE_WORDS) -> DataFrame:
    """Rows ``(node, shingles, weight)`` of rows ``(node, text)``: each occurrence of a shingle in
    32 bits, sorted, and the sum of their weights.

    The low bits are the bucket of the document frequency, which gives the weight; the
    others tell shingles of one bucket apart, and first from further occurrences.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in _row_chunks(batch.column("text")):
                row, feature, count = features(data, offsets, size)
                again = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row, feature = np.repeat(row, count), np.repeat(feature, count)
                mark = textbytes.mix((feature >> np.uint64(IDF_BITS)) + again.astype(np.uint64) * np.uint64(1 << 32)) >> np.uint64(32 + IDF_BITS)
                element = _bucket(feature) | (mark.astype(np.int64) << IDF_BITS)
                key = np.unique((row << 32) | element)
                bounds = pa.array(np.searchsorted(key >> 32, np.arange(last - first + 1)), pa.int32())
                values = (key & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(bounds, pa.array(values))
                weight = np.bincount(key >> 32, idf.value[key & ((1 << IDF_BITS) - 1)], last - first)
                node = batch.column("node").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([node, lists, pa.array(weight)], names=["node", "shingles", "weight"])

    return texts.select("node", "text").mapInArrow(lean(task), "node binary, shingles array<int>, weight double")


def weighted_jaccard(left: np.ndarray, right: np.ndarray, idf: np.ndarray) -> float:
    """Of two sets as ``shingle_sets`` makes them."""
    mask = (1 << IDF_BITS) - 1
    common = np.intersect1d(left, right, assume_unique=True)
    shared = float(idf[common & mask].sum(dtype=np.float64))
    whole = float(idf[left & mask].sum(dtype=np.float64)) + float(idf[right & mask].sum(dtype=np.float64)) - shared
    return shared / whole if whole else 0.0


def verify(pairs: DataFrame, sets: DataFrame, idf: Broadcast) -> DataFrame:
    """``(a, b, similarity)`` of node pairs ``(a, b)``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            found = [
                weighted_jaccard(left[k].values.to_numpy(), right[k].values.to_numpy(), idf.value) for k in range(len(batch))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    # only the sets that take part are shuffled
    left, right = (sets.join(_few(pairs.select(F.col(n).alias("node")).distinct()), "node", "left_semi") for n in ("a", "b"))
    left = left.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = right.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return left.join(_few(pairs), "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(lean(task), "a binary, b binary, similarity double")


# --- classes ---------------------------------------------------------------------


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, label)``: the smallest node reached over the links ``(a, b)``, for every linked node.

    Each round hands the smallest label next door to a node and to the node it is labelled
    with, and then takes the label's own label, so paths shorten by halves; every round is a
    table in the shared folder. Labels are broadcast if they are counted few.
    """
    both = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
    both = scratch.table(both.distinct(), "links")
    labels = scratch.table(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    few = _is_few(labels)
    side = F.broadcast if few else lambda frame: frame
    while True:
        near = both.join(side(labels.select(F.col("node").alias("other"), F.col("label").alias("next"))), "other").join(side(labels), "node")
        handed = near.select(F.inline(F.array(F.struct("node", "next"), F.struct(F.col("label").alias("node"), F.col("next")))))
        handed = handed.unionByName(labels.select("node", F.col("label").alias("next")))
        stepped = scratch.table(handed.groupBy("node").agg(F.min("next").alias("label")), "labels")
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = stepped.join(side(jump), "label").select("node", F.least("label", "root").alias("label"))
        was = labels.select("node", F.col("label").alias("was"))
        after = scratch.table(jumped.join(side(was), "node"), "labels")
        if after.filter(F.col("was") != F.col("label")).isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def _joined(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after more links: components of the classes, each class being one node."""
    side = F.broadcast if _is_few(labels) else lambda frame: frame
    classes = links
    for n in ("a", "b"):
        known = labels.select(F.col("node").alias(n), F.col("label").alias(f"label_{n}"))
        classes = classes.join(side(known), n, "left")
    classes = classes.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a <> b")
    roots = components(classes, scratch).select(F.col("node").alias("label"), F.col("label").alias("root"))
    few = F.broadcast if _is_few(roots) else lambda frame: frame
    moved = labels.join(few(roots), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    single = roots.select(F.col("label").alias("node"), F.col("root").alias("label")).join(side(labels.select("node")), "node", "left_anti")
    return scratch.table(moved.unionByName(single), "labels")


def _is_few(frame: DataFrame) -> bool:
    return frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _few(frame: DataFrame) -> DataFrame:
    """For the small side of a join: broadcast if counted small."""
    return F.broadcast(frame) if _is_few(frame) else frame


def text_classes(docs: DataFrame, text: str = "text", id: str = "doc_id", similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, node, class_node, class_id, class_size)`` of every row, and whether it is the one that ``stays``.

    ``class_id`` is the smallest id of the class, ``class_size`` its number of rows. Texts are linked from ``similarity`` on,
    classes are closed over links; equal texts are one class. A text of fewer than ``size``
    words is one shingle; a text without words is like equal texts only; a null text is
    like no other, and stays. Of a class the row of the smallest id stays (a null id
    comes last), of equal ids the one of the smallest fingerprint; rows equal in id and
    text are all marked alike. Other columns play no part.
    """
    spark = split_hot_keys(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(spark, "neardup") as scratch:
        return cut_lineage(_classes(rows, similarity, size, scratch), "classes")


def _classes(rows: DataFrame, similarity: float, size: int, scratch: Scratch) -> DataFrame:
    spark = rows.sparkSession
    total, frequencies = document_frequencies(rows, size=size)
    idf = spark.sparkContext.broadcast(inverse_frequencies(total, frequencies))
    banded = scratch.table(band_table(rows, idf, size), "bands")
    nodes = banded.filter("node IS NOT NULL AND size(bands) > 0").groupBy("node").agg(F.any_value("bands").alias("bands"))
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    counts = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = scratch.table(keyed.join(counts, ["band", "key"]), "met")
    # a bucket's first node is that of the most company in all buckets: likely what the others were copied from
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = met.join(_few(company), "node")
    firsts = ranked.groupBy("band", "key").agg(F.max(F.struct("company", "node"))["node"].alias("first"))
    members = scratch.table(met.join(_few(firsts), ["band", "key"]), "buckets")
    # of equal texts, the row of the smallest id will do
    least = banded.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    wanted = scratch.table(members.select("node").distinct().join(least, "node").withColumnRenamed("node", "wanted"), "wanted")
    marked = rows.withColumn("node", fingerprint(F.col("text")))
    texts = marked.join(_few(wanted), (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = scratch.table(shingle_sets(texts, idf, size).dropDuplicates(["node"]), "sets")

    pairs = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    pairs = scratch.table(pairs, "stars")
    tested = scratch.table(verify(pairs, sets, idf), "tested")
    labels = components(tested.filter(F.col("similarity") >= similarity).select("a", "b"), scratch)
    groups = tested.select(F.col("a").alias("hub"), F.col("b").alias("node"), "similarity")
    labels = _closed(groups, labels, sets, idf, similarity, scratch)

    classed = banded.select("doc_id", "node").join(labels, "node", "left")
    classed = classed.withColumn("class_node", F.coalesce("label", "node")).drop("label")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    kept = classed.filter("node IS NOT NULL").groupBy("class_node").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("size"))
    classed = classed.join(kept, "class_node", "left")
    least = F.col("least")
    stays = least.isNull() | (least["doc_id"].eqNullSafe(F.col("doc_id")) & (least["node"] == F.col("node")))
    class_id = F.when(least.isNull(), F.col("doc_id")).otherwise(least["doc_id"])
    class_size = F.coalesce("size", F.lit(1).cast("long")).alias("class_size")
    return classed.select("doc_id", "node", "class_node", class_id.alias("class_id"), class_size, stays.alias("stays"))


def _closed(groups: DataFrame, labels: DataFrame, sets: DataFrame, idf: Broadcast, similarity: float, scratch: Scratch) -> DataFrame:
    """Labels after all links between members of a group ``(hub, node, similarity)`` with its hub.

    Say ``inside`` is the weight that a member has in common with the hub. Two members have no more in common
    inside the hub than the lesser of theirs, and to be linked they need a share of their weights' sum.
    Either that can be reached inside the hub, which takes a member much lighter than the hub; such pairs are
    listed. Or they share a shingle that the hub lacks: the members of each such shingle that are of
    several classes meet the one closest to the hub, as their next hub, and so on. Each round is
    linear in the shingles that members have beyond their hub. A pair may share hundreds of these; a member keeps those
    that the fewest others have, and shingles of the same members count once.
    """
    for round in range(HUB_ROUNDS + 1):
        open_ = scratch.table(_divided(groups, labels, sets), "divided")
        if open_.isEmpty():
            return labels
        beyond = scratch.table(_several(_beyond(open_, sets)), "beyond")
        beyond = scratch.table(_several(_able(beyond, open_, similarity)), "able")
        # tables between, so that no join is made again for the list of what stays
        beyond = scratch.table(_telling(beyond, open_, similarity), "ranked")
        beyond = scratch.table(_once(scratch.table(_several(beyond), "shared")), "telling")
        if round < HUB_ROUNDS:
            nearest = beyond.groupBy("hub", "shingle").agg(F.max(F.struct("similarity", "node"))["node"].alias("a"))
            pairs = beyond.join(_few(nearest), ["hub", "shingle"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct()
        else:  # the few that are left
            left, right = (beyond.select("hub", "shingle", F.col("node").alias(n), F.col("label").alias(f"label_{n}")) for n in ("a", "b"))
            pairs = left.join(right, ["hub", "shingle"]).filter("a < b AND label_a <> label_b").select("a", "b").distinct()
        tested = scratch.table(verify(scratch.table(pairs, "pairs"), sets, idf), "tested")
        listed = scratch.table(_inside_pairs(open_, similarity), "inside")
        more = tested if listed.isEmpty() else tested.unionByName(verify(listed, sets, idf))
        more = scratch.table(more.filter(F.col("similarity") >= similarity).select("a", "b"), "more")
        if not more.isEmpty():
            labels = _joined(labels, more, scratch)
        groups = tested.select(F.col("a").alias("hub"), F.col("b").alias("node"), "similarity")
    return labels


def _divided(groups: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of groups that hold more than one class, with their labels, weights and what they have inside the hub."""
    labelled = groups.join(_few(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = labelled.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    members = labelled.join(_few(split.select("hub")), "hub")
    weights = sets.select("node", "weight")
    weighed = members.join(weights, "node").join(weights.withColumnsRenamed({"node": "hub", "weight": "hub_weight"}), "hub")
    inside = F.col("similarity") / (1 + F.col("similarity")) * (F.col("weight") + F.col("hub_weight"))
    return weighed.select("hub", "node", "similarity", "label", "weight", inside.alias("inside"))


def _beyond(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """``(hub, node, similarity, label, weight, inside, shingle)``: the shingles of each member that its hub lacks."""
    names = ("hub", "node", "similarity", "label", "weight", "inside")

    def packed(part: pa.RecordBatch, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        place = pa.array(np.repeat([k for k, _ in held], [len(x) for _, x in held]))
        columns = [part.column(c).take(place) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([x for _, x in held]))], names=[*names, "shingle"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for batch in batches:
            for first in range(0, len(batch), _ROWS_BEYOND):
                part = batch.slice(first, _ROWS_BEYOND)
                left, right = part.column("left"), part.column("right")
                for k in range(len(part)):
                    shingle = np.setdiff1d(right[k].values.to_numpy(), left[k].values.to_numpy(), assume_unique=True)
                    for at in range(0, len(shingle), _SHINGLES_BEYOND):
                        piece = shingle[at : at + _SHINGLES_BEYOND]
                        held.append((k, piece))
                        size += len(piece)
                        if size >= _SHINGLES_BEYOND:
                            yield packed(part, held)
                            held, size = [], 0
                if held:
                    yield packed(part, held)
                    held, size = [], 0

    hubs = sets.join(_few(open_.select(F.col("hub").alias("node")).distinct()), "node", "left_semi")
    members = sets.join(_few(open_.select("node").distinct()), "node", "left_semi")
    left, right = hubs.select(F.col("node").alias("hub"), F.col("shingles").alias("left")), members.select("node", F.col("shingles").alias("right"))
    both = left.join(_few(open_.select(*names)), "hub").join(right, "node")
    return both.mapInArrow(lean(task), "hub binary, node binary, similarity double, label binary, weight double, inside double, shingle int")


def _needed(members: DataFrame, open_: DataFrame, similarity: float) -> DataFrame:
    """With ``needed``: the weight that a member must have in common with another one beyond the hub to be linked to it.

    A link takes ``similarity / (1 + similarity)`` of both weights' sum, and a partner weighs no less than ``similarity``
    times as much, nor less than the lightest of the group. Inside the hub they share no more than the member has there.
    """
    lightest = open_.groupBy("hub").agg(F.min("weight").alias("lightest"))
    both = F.col("weight") + F.greatest("lightest", similarity * F.col("weight"))
    needed = similarity / (1 + similarity) * both * (1 - 1e-9) - F.col("inside")
    return members.join(_few(lightest), "hub").withColumn("needed", needed).drop("lightest")


def _able(beyond: DataFrame, open_: DataFrame, similarity: float) -> DataFrame:
    """The rows of members that can have a link at all: what they share beyond the hub with any other class,
    at the most that a shingle weighs, is enough."""
    counted = beyond.groupBy("hub", "node", "weight", "inside").agg(F.count(F.lit(1)).alias("n"))
    able = _needed(counted, open_, similarity).filter((1 + IDF_SPREAD) * F.col("n") >= F.col("needed")).select("hub", "node")
    return beyond.join(_few(able), ["hub", "node"], "left_semi")


def _telling(beyond: DataFrame, open_: DataFrame, similarity: float) -> DataFrame:
    """The rows without those shingles of a member that most others have, as many as are not enough for a link.

    Shingles are in one order for all members of a hub. Two that are linked share more than either of them leaves out, so
    the first one they share is left out by neither.
    """
    sizes = beyond.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("hub", "node").orderBy(F.desc("n"), "shingle"))
    ranked = beyond.join(_few(sizes), ["hub", "shingle"]).withColumn("place", place)
    ranked = _needed(ranked, open_, similarity).filter((1 + IDF_SPREAD) * F.col("place") >= F.col("needed"))
    return ranked.drop("n", "place", "needed")


def _once(beyond: DataFrame) -> DataFrame:
    """Of the shingles that the same members share, one: the others would bring the same pairs again."""
    marks = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"mark{k}") for k in (0, 1)]
    sharing = beyond.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("n"), *marks)
    single = sharing.groupBy("hub", "n", "mark0", "mark1").agg(F.min("shingle").alias("shingle")).select("hub", "shingle")
    return beyond.join(_few(single), ["hub", "shingle"], "left_semi")


def _several(beyond: DataFrame) -> DataFrame:
    """The rows of shingles that members of several classes share."""
    of = F.min("label").alias("low"), F.max("label").alias("high")
    split = beyond.groupBy("hub", "shingle").agg(*of).filter("low <> high").select("hub", "shingle")
    return beyond.join(_few(split), ["hub", "shingle"], "left_semi")


def _inside_pairs(open_: DataFrame, similarity: float) -> DataFrame:
    """Pairs of two classes that could be a link by what they have inside the hub alone.

    One of them is not linked to the hub, so the other one must be lighter than the hub by far.
    """
    share = similarity / (1 + similarity) * (1 - 1e-9)
    lightest = open_.groupBy("hub").agg(F.min("weight").alias("lightest"))
    room = F.col("inside") / share - F.col("weight")  # the heaviest partner it can have
    unlinked = open_.filter(F.col("similarity") < similarity).join(_few(lightest), "hub").filter(room >= F.col("lightest"))
    left = unlinked.select("hub", F.col("node").alias("a"), F.col("label").alias("label_a"), "weight", "inside", room.alias("room"))
    right = open_.select("hub", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("weight").alias("weight_b"), F.col("inside").alias("inside_b"))
    enough = F.least("inside", "inside_b") >= share * (F.col("weight") + F.col("weight_b"))
    fitting = _few(left).join(right, "hub").filter((F.col("label_a") != F.col("label_b")) & (F.col("weight_b") <= F.col("room")) & enough)
    return fitting.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of ``text_classes``, with its own columns; rows with null texts all stay."""
    names = docs.columns
    # inner names, so that no column of the rows meets one made here
    rows, id, text = docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index(id)}", f"c{names.index(text)}"
    classes = text_classes(rows, text, id, similarity)
    key = F.col(id).cast("string").eqNullSafe(F.col("_id")) & (fingerprint(F.col(text).cast("string")) == F.col("_node"))
    named = classes.filter("node IS NOT NULL").select(F.col("doc_id").cast("string").alias("_id"), F.col("node").alias("_node"), "stays")
    gone = named.filter("NOT stays").drop("stays").distinct()
    left = rows.join(_few(gone), key, "left_anti")
    repeated = named.filter("stays").groupBy("_id", "_node").count().filter("count > 1").drop("count")
    if not repeated.isEmpty():
        # rows equal in id and text: one of them stays
        repeated = _few(repeated)
        single = left.join(repeated, key, "left_semi").dropDuplicates([id, text])
        left = left.join(repeated, key, "left_anti").unionByName(single)
    return left.toDF(*names)
