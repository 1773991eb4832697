"""Language-model scores from a probabilistic suffix tree over the bytes of the tokens.

A text is its tokens (words between white space, A-Z as a-z, then one end), written as
symbols: each word's bytes by class, a separator after each word, the end. The tree's
nodes are contexts, up to six symbols back. A context is a candidate if it was seen
``MIN_COUNT`` times, in a corpus of any size; it is retained if its next-symbol distribution
diverges from its parent's (the context one symbol shorter) by more than chance, or if a longer
retained context needs it. Distributions are smoothed into the parent's. A symbol's
probability is that of the longest retained suffix of what precedes it, and of its byte
within the class.

The tree grows with the corpus. Its most frequent contexts, at most ``MAX_NODES`` of 512
bytes, are broadcast (candidates that are not retained take no place where there are more); all others are a table, and the symbols that one of them precedes are
looked up there by a join, each distinct sequence once. The broadcast nodes tell where
the table goes on, so the scores are those of the whole tree. Word counts grow too: the
most frequent words are looked up in a broadcast table of fixed size, all others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.llm import textbytes
from reqsieve.session import Scratch, cut_lineage, split_hot_keys

DEPTH = 6
#: Times a context must be seen, and contexts that are broadcast at most.
MIN_COUNT, MAX_NODES = 8, 300_000
#: Log-likelihood gain, in nats, from which a context is retained.
DIVERGENCE = 20.0
#: Words looked up by broadcast at most, and the slots of their table as a power of 2.
HEAD_WORDS, HEAD_BITS = 400_000, 21
_BITS, _SYMBOLS, _BLOCK = 6, 64, 16_384
_ELSEWHERE = -2
_PENDING = 3_000_000
_CHUNK = 1 << 20

# Symbol classes of bytes. 0 ends a text, 1 ends a word.
_LETTERS = range(0x61, 0x7B)
_CLASSES = ["0123456789", ".", ",", "\"'`", "!?", "|", "#", "$", "%", "&", "*"]
_LEADS = [(0xC3, 0xC3), (0xC2, 0xC2), (0xC0, 0xDF), (0xE0, 0xE2), (0xE3, 0xEF), (0xF0, 0xFD)]
_END_BYTE, _PAD_BYTE = 0xFF, 0xFE  # no byte of UTF-8


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    number = 2
    for byte in _LETTERS:
        table[byte] = number
        number += 1
    for members in _CLASSES:
        for byte in members.encode():
            table[byte] = number
        number += 1
    control = [*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]
    table[control] = number
    other = [b for b in range(0x21, 0x7F) if not table[b] and not 0x41 <= b <= 0x5A]
    table[other] = number + 1
    number += 2
    for byte in range(0x80, 0xC0):
        table[byte] = number + byte % 16
    number += 16
    for low, high in _LEADS:
        for byte in range(low, high + 1):
            if not table[byte]:
                table[byte] = number
        number += 1
    table[0x41:0x5B] = table[0x61:0x7B]
    table[[*range(0x09, 0x0E), 0x20]] = 1
    table[[_END_BYTE, _PAD_BYTE]] = 0
    return table


_SYMBOL = _symbol_table()
_SPECIAL = np.array([_END_BYTE, _PAD_BYTE])
#: Keys of one count table: words below 0, symbol sequences from 0, bytes from here on.
_BYTE_KEY = 1 << 56
_WORD_BIT = np.uint64(1 << 63)


class Symbols(NamedTuple):
    code: np.ndarray  # symbols of all rows, each row after DEPTH boundary symbols
    byte: np.ndarray  # the byte behind each
    predicted: np.ndarray  # where a symbol is predicted, and no padding
    row: np.ndarray  # of each predicted symbol


def symbols(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    rows, extra = len(offsets) - 1, DEPTH + 2
    spread = np.full(len(data) + rows * extra, _PAD_BYTE, np.uint8)
    at = offsets + np.arange(rows + 1) * extra
    for r in range(rows):
        begin = at[r] + DEPTH
        spread[begin : begin + offsets[r + 1] - offsets[r]] = data[offsets[r] : offsets[r + 1]]
    spread[at[1:] - 2] = 0x20
    spread[at[1:] - 1] = _END_BYTE
    code = _SYMBOL[spread]
    blank = code == 1
    keep = ~blank
    # of white space only what ends a word
    inside = (code != 1) & (spread < _PAD_BYTE)
    keep[1:] |= blank[1:] & inside[:-1]
    code, byte = code[keep], spread[keep]
    predicted = np.flatnonzero(byte != _PAD_BYTE)
    ends = np.searchsorted(predicted, np.flatnonzero(byte == _END_BYTE)) + 1
    return Symbols(code, byte, predicted, np.repeat(np.arange(rows), np.diff(ends, prepend=0)))


def sequences(found: Symbols) -> np.ndarray:
    """Each predicted symbol (lowest bits) with the DEPTH symbols before it, nearest first."""
    code = found.code.astype(np.int64)
    whole = code.copy()
    for back in range(1, DEPTH + 1):
        whole[back:] |= code[:-back] << (_BITS * back)
    return whole[found.predicted]


def _count(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(values)
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[at], np.diff(np.append(at, len(ordered)))


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, textbytes.Words]:
    found = textbytes.words(data, offsets, textbytes.VISIBLE)
    return (textbytes.hashes(data, found) | _WORD_BIT).view(np.int64), found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*pending))
        order = np.argsort(key)
        key, n = key[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[at], np.add.reduceat(n, at)

    def rows() -> Iterator[pa.RecordBatch]:
        key, n = merged()
        for k in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], names=["key", "n"])

    for batch in batches:
        for _, _, data, offsets in textbytes.text_chunks(batch.column(0), _CHUNK):
            found = symbols(data, offsets)
            pending.append(_count(sequences(found)))
            pending.append(_count(_word_keys(data, offsets)[0]))
            bytes_ = np.bincount(textbytes.LOWER[found.byte[found.predicted]], minlength=256)
            pending.append((np.arange(256) + _BYTE_KEY, bytes_))
            if sum(len(k) for k, _ in pending) > _PENDING:
                pending = [merged()]
                if len(pending[0][0]) > _PENDING // 2:
                    yield from rows()
                    pending = []
    if pending:
        yield from rows()


class Tree(NamedTuple):
    """The retained contexts that are broadcast; node 0 is the empty one."""

    child: np.ndarray  # (nodes x symbols) the context one symbol further back, -1 if none, _ELSEWHERE if in the table
    log: np.ndarray  # (nodes x symbols) log10 of the next symbol's probability
    byte_log: np.ndarray  # log10 of a byte's probability within its class


def grow(counts: pa.Table, bytes_: np.ndarray, divergence: float = DIVERGENCE, marks: pa.Table | None = None) -> Tree:
    """The tree from rows ``(depth, context, next, n)`` of the candidate contexts.

    ``marks`` are rows ``(depth, context, longer)``: a bit for each symbol further back with
    which the context is one of the table's.
    """
    # what is done with is let go at once, as all of this is in the driver's memory
    whole_key = (counts["depth"].to_numpy().astype(np.int64) << _BITS * DEPTH) | counts["context"].to_numpy()
    keys, node = np.unique(whole_key, return_inverse=True)
    size = max(1, len(keys))
    tally = np.zeros((size, _SYMBOLS), np.float32)
    tally[node, counts["next"].to_numpy()] = counts["n"].to_numpy()  # each pair is one row
    del counts, whole_key, node
    total = tally.sum(axis=1, dtype=np.float64)
    keys = keys if len(keys) else np.zeros(1, np.int64)
    level, context = keys >> _BITS * DEPTH, keys & ((1 << _BITS * DEPTH) - 1)
    up = np.maximum(level - 1, 0)
    parent = np.searchsorted(keys, np.where(level > 0, (up << _BITS * DEPTH) | (context & ((1 << _BITS * up) - 1)), 0))
    share = np.zeros((size, _SYMBOLS), np.float32)
    share[0] = (tally[0] + 1) / (total[0] + _SYMBOLS)
    retained = np.zeros(size, bool)
    retained[0] = True
    for first in range(0, size, _BLOCK):
        at = np.arange(first, min(first + _BLOCK, size))
        ours, theirs = tally[at].astype(np.float64), tally[parent[at]].astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (ours / total[at][:, None]) / (theirs / total[parent[at]][:, None])
            gain = np.where(ours > 0, ours * np.log(ratio), 0).sum(axis=1)
        retained[at] |= (gain >= divergence) & (level[at] > 0)
    marked, longer = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if marks is not None and len(marks):
        marked = np.searchsorted(keys, (marks["depth"].to_numpy() << _BITS * DEPTH) | marks["context"].to_numpy())
        longer = marks["longer"].to_numpy()
        retained[marked] = True
    for d in range(DEPTH, 0, -1):
        at = np.flatnonzero(retained & (level == d))
        retained[parent[at]] = True
    for d in range(1, DEPTH + 1):
        ours = np.flatnonzero(retained & (level == d))
        for first in range(0, len(ours), _BLOCK):
            at = ours[first : first + _BLOCK]
            pull = (tally[at] > 0).sum(axis=1)[:, None]
            share[at] = (tally[at] + pull * share[parent[at]]) / (total[at][:, None] + pull)
    del tally
    kept = np.flatnonzero(retained)
    number = np.full(size, -1, np.int64)
    number[kept] = np.arange(len(kept))
    child = np.full((len(kept), _SYMBOLS), -1, np.int32)
    longest = kept[1:]
    child[number[parent[longest]], context[longest] >> _BITS * (level[longest] - 1)] = number[longest]
    for symbol in range(_SYMBOLS):
        child[number[marked[(longer >> symbol) & 1 == 1]], symbol] = _ELSEWHERE
    seen = bytes_ + 1.0
    seen[_SPECIAL[1]] = 0
    seen[[*range(0x41, 0x5B)]] = 0
    whole = np.bincount(_SYMBOL, seen, _SYMBOLS)
    byte_log = np.where(_SYMBOL > 1, np.log10(np.maximum(seen, 1) / whole[_SYMBOL]), 0.0)
    byte_log[0x41:0x5B] = byte_log[0x61:0x7B]
    share = share[kept]
    return Tree(child.ravel(), np.log10(share, out=share).ravel(), byte_log)


def _longest(tree: Tree, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sequence the longest context among the nodes, its length, and whether the table has a longer one."""
    state, going = np.zeros(len(sequence), np.int32), np.ones(len(sequence), bool)
    length, more = np.zeros(len(sequence), np.int64), np.zeros(len(sequence), bool)
    for back in range(1, DEPTH + 1):
        longer = tree.child[state * _SYMBOLS + (sequence >> _BITS * back & _SYMBOLS - 1)]
        more |= going & (longer == _ELSEWHERE)
        going &= longer >= 0
        state = np.where(going, longer, state)
        length += going
    return state, length, more


def _scored(tree: Tree, found: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 probability of each row without the symbols that need the table, and these:
    their rows and sequences."""
    sequence = sequences(found)
    state, _, more = _longest(tree, sequence)
    log = tree.log[state * _SYMBOLS + (sequence & _SYMBOLS - 1)].astype(np.float64)
    log[more] = 0
    log += tree.byte_log[found.byte[found.predicted]]
    return np.bincount(found.row, log, minlength=int(found.row[-1]) + 1 if len(found.row) else 0), found.row[more], sequence[more]


def score(tree: Tree, found: Symbols) -> np.ndarray:
    """Log10 probability of each row under a tree without a table."""
    return _scored(tree, found)[0]


class Head(NamedTuple):
    key: np.ndarray  # by the leading bits below the word bit
    n: np.ndarray
    ends: int  # training texts


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) << np.uint64(1)) >> np.uint64(64 - HEAD_BITS)).astype(np.int64)


def _shorter(length: str) -> Column:
    """A context cut to its nearest ``length`` symbols."""
    return F.expr(f"context & (shiftleft(1L, cast({_BITS} * ({length}) as int)) - 1)")


def _contexts(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """``(depth, context, next, n)`` of every context up to ``DEPTH`` symbols long; a sequence that was counted is one of the longest."""

    def counted(rows: DataFrame) -> DataFrame:
        mask = F.element_at(F.array(*[F.lit((1 << _BITS * (d + 1)) - 1).cast("long") for d in range(DEPTH + 1)]), F.col("depth") + 1)
        return rows.groupBy("depth", F.col("code").bitwiseAND(mask).alias("code")).agg(F.sum("n").alias("n"))

    longest = grams.select(F.lit(DEPTH).alias("depth"), F.col("key").alias("code"), "n")
    # shorter ones from the few that are left one symbol below
    second = scratch.table(counted(longest.withColumn("depth", F.lit(DEPTH - 1))), "second")
    shorter = counted(second.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 2)))))
    levels = longest.unionByName(second).unionByName(shorter)
    return scratch.table(levels.select("depth", F.shiftright("code", _BITS).alias("context"), F.col("code").bitwiseAND(_SYMBOLS - 1).alias("next"), "n"), "contexts")


def _known(levels: DataFrame) -> DataFrame:
    """``(depth, context, whole, pull, gain)`` of the candidates: how often seen, before how many symbols, and the gain over the parent.

    What precedes a parent's next symbol is one of its children, so the children's rows add up to the
    parent's. At most 64 x 64 rows have one parent.
    """
    children = levels.filter("depth > 0").withColumn("parent", _shorter("depth - 1")).repartition("depth", "parent")
    own, next_, above = (F.sum("n").over(Window.partitionBy("depth", "parent", *c)) for c in (["context"], ["next"], []))
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("own") / (F.col("next_n") / F.col("above"))))
    children = children.withColumns({"own": own, "next_n": next_, "above": above}).groupBy("depth", "parent", "context")
    totals = [F.sum("n").alias("whole"), F.count(F.lit(1)).alias("pull")]
    children = children.agg(*totals, gain.alias("gain")).drop("parent").filter(F.col("whole") >= MIN_COUNT)
    empty = levels.filter("depth = 0").groupBy("depth", "context").agg(*totals).withColumn("gain", F.lit(0.0))
    return children.unionByName(empty)


def _broadcast_from(nodes: DataFrame) -> int | None:
    """Of ``(depth, times)`` the least power of two from which on nodes are broadcast; none if all are."""
    room = MAX_NODES
    for row in nodes.groupBy("times").count().orderBy(F.desc("times")).collect():  # at most 64 rows
        room -= row["count"]
        if room < 0:
            return row["times"] + 1
    return None


def _candidate_contexts(grams: DataFrame, divergence: float, scratch: Scratch) -> tuple[pa.Table, pa.Table | None, DataFrame | None]:
    """Next-symbol counts of the most frequent contexts; for ``grow``, where other retained
    ones go on from them; and the table of these: ``(depth, context, whole, pull, following)``."""
    levels = _contexts(grams, scratch)
    times = F.floor(F.log2(F.col("whole") / F.lit(MIN_COUNT))).cast("int")
    known = scratch.table(_known(levels).withColumn("times", times), "known")
    reached = _broadcast_from(known)
    if reached is not None:
        # only what is retained, with all that is shorter
        lengths = F.explode(F.sequence(F.lit(1), F.col("depth")))
        needed = known.filter((F.col("gain") >= divergence) & (F.col("depth") > 0)).withColumn("length", lengths)
        needed = needed.select(F.col("length").alias("depth"), _shorter("length").alias("context")).distinct()
        known = scratch.table(known.join(needed, ["depth", "context"], "left_semi").unionByName(known.filter("depth = 0")), "retained")
        reached = _broadcast_from(known)
    # the empty context is always kept
    frequent = F.lit(True) if reached is None else (F.col("times") >= reached) | (F.col("depth") == 0)
    kinds = {"depth": "byte", "context": "long", "next": "byte", "n": "long"}
    nodes = known.filter(frequent).select("depth", "context")  # at most MAX_NODES and the empty one
    head = levels.join(F.broadcast(nodes), ["depth", "context"], "left_semi").select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]).toArrow()
    if reached is None:
        return head, None, None
    table = levels.join(known.filter(~frequent).select("depth", "context", "whole", "pull"), ["depth", "context"])
    table = table.groupBy("depth", "context", "whole", "pull").agg(F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("following"))
    table = scratch.table(table, "table")
    bit = F.expr(f"shiftleft(1L, cast(shiftright(context, cast({_BITS} * (depth - 1) as int)) as int))")
    marks = table.select((F.col("depth") - 1).alias("depth"), _shorter("depth - 1").alias("context"), bit.alias("bit")).join(nodes, ["depth", "context"], "left_semi")
    marks = marks.groupBy("depth", "context").agg(F.bit_or("bit").alias("longer"))  # at most one row per node
    return head, marks.select(F.col("depth").cast("long").alias("depth"), "context", "longer").toArrow(), table


def _head(words: DataFrame, ends: int, most: int) -> Head:
    """The words of the largest counts, as many as ``most`` allows, in one probe each."""
    sizes = words.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()  # at most 64 rows
    least, room = 64, most
    for power, count in sorted(((r["power"], r["count"]) for r in sizes), reverse=True):
        if count > room:
            break
        room -= count
        least = power
    top = words.filter(F.col("n") >= F.lit(2.0) ** least).select("key", F.col("n").cast("long").alias("n")).toArrow()
    table, n = np.zeros(1 << HEAD_BITS, np.int64), np.zeros(1 << HEAD_BITS, np.int64)
    key, count = top["key"].to_numpy(), top["n"].to_numpy()
    # the more frequent of two in one slot stays; the other is found by the join
    order = np.argsort(count, kind="stable")
    slot = _slot(key[order])
    table[slot], n[slot] = key[order], count[order]
    return Head(table, n, ends)


def score_texts(
    docs: DataFrame, training: Column, text: str = "text", id: str = "doc_id", divergence: float = DIVERGENCE, head_words: int = HEAD_WORDS
) -> DataFrame:
    """Scores of every text under models learned from the rows where ``training`` is true.

    ``n_tokens`` (the end counts), ``n_known`` (tokens seen in training), ``train_tokens``
    (tokens of the training texts), ``base_score`` (sum of log10((c + 1) / (N + V + 1)):
    add-one word frequencies) and ``score`` (log10 probability under the tree), with the
    row's id and ``held_out`` (not training).

    A null or empty text is its end alone. A null ``training`` is false. Repeated rows
    count and are scored as often as they appear, ties play no part, an empty table gives
    no rows, and without training rows every distribution is uniform. Words meet by a
    64-bit hash. Other columns play no part.
    """
    spark = split_hot_keys(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    with Scratch(spark, "suffix-tree") as scratch:
        return cut_lineage(_scores(rows, divergence, head_words, scratch), "scores")


def _scores(rows: DataFrame, divergence: float, head_words: int, scratch: Scratch) -> DataFrame:
    spark = rows.sparkSession
    learned = rows.filter("training").select("text").mapInArrow(_counted, "key long, n long")
    counts = scratch.table(learned.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter("key < 0")
    bytes_ = np.zeros(256)
    for row in counts.filter(F.col("key") >= _BYTE_KEY).collect():  # 256 rows
        bytes_[row["key"] - _BYTE_KEY] = row["n"]
    ends = int(bytes_[_END_BYTE])
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = int(total) + ends, distinct + (ends > 0)
    grams = counts.filter((F.col("key") >= 0) & (F.col("key") < _BYTE_KEY))
    *contexts, marks, table = _candidate_contexts(grams, divergence, scratch)
    model = spark.sparkContext.broadcast((grow(contexts.pop(), bytes_, divergence, marks), _head(words, ends, head_words)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, head = model.value
        for batch in batches:
            for first, last, data, offsets in textbytes.text_chunks(batch.column("text"), _CHUNK):
                number = last - first
                logs, open_row, sequence = _scored(tree, symbols(data, offsets))
                key, found = _word_keys(data, offsets)
                slot, row = _slot(key), found.row
                quick = head.key[slot] == key
                n = head.n[slot[quick]]
                known = np.bincount(row[quick], minlength=number) + (head.ends > 0)
                base = np.bincount(row[quick], np.log10(n + 1), minlength=number) + np.log10(head.ends + 1)
                rest = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row[~quick], np.arange(number + 1)), pa.int32()), pa.array(key[~quick])
                )
                opened = pa.ListArray.from_arrays(pa.array(np.searchsorted(open_row, np.arange(number + 1)), pa.int32()), pa.array(sequence))
                part = batch.slice(first, number)
                tokens = np.diff(found.bounds).astype(np.int64) + 1
                columns = [pa.array(x) for x in (tokens, known.astype(np.int64), base, logs)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("training"), *columns, rest, opened],
                    names=["doc_id", "training", "n_tokens", "known", "base", "score", "rest", "opened"],
                )

    fields = [rows.schema["doc_id"], T.StructField("training", T.BooleanType())]
    fields += [T.StructField(c, T.LongType()) for c in ("n_tokens", "known")] + [T.StructField(c, T.DoubleType()) for c in ("base", "score")]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("rest", "opened")]
    scored = rows.mapInArrow(task, T.StructType(fields))
    scored = scratch.table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    looked_up = scored.select("row", F.explode("rest").alias("key")).join(words.select("key", "n"), "key", "left")
    rest = looked_up.groupBy("row").agg(F.count("n").alias("rest_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rest_base"))
    each = float(np.log10(total + distinct + 1))
    scored_rows = scored.drop("rest", "opened").join(rest, "row", "left")
    if table is None:
        scored_rows = scored_rows.withColumn("opened", F.lit(0.0))
    else:
        open_symbols = scored.select("row", F.explode("opened").alias("sequence"))
        logs = _table_logs(open_symbols.select("sequence").distinct(), table, model)
        logs = open_symbols.join(logs, "sequence").groupBy("row").agg(F.sum("log").alias("opened"))
        scored_rows = scored_rows.join(logs, "row", "left")
    return scored_rows.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("score") + F.coalesce("opened", F.lit(0.0))).alias("score"),
    )


def _table_logs(open_sequences: DataFrame, table: DataFrame, model: Broadcast) -> DataFrame:
    """``(sequence, log)`` of sequences whose longest context is one of the table's."""
    names = ["sequence", "next", "depth", "context", "start"]

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = model.value[0]
        for batch in batches:
            sequence = batch.column(0).to_numpy()
            state, length, _ = _longest(tree, sequence)
            following = sequence & _SYMBOLS - 1
            start = 10.0 ** tree.log[state * _SYMBOLS + following].astype(np.float64)
            for d in range(1, DEPTH + 1):
                at = np.flatnonzero(length < d)
                context = sequence[at] >> _BITS & (1 << _BITS * d) - 1
                columns = [sequence[at], following[at], np.full(len(at), d, np.int32), context, start[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    steps = open_sequences.mapInArrow(longer, "sequence long, next long, depth int, context long, start double").join(table, ["depth", "context"])
    seen = F.coalesce(F.try_element_at("following", F.col("next")), F.lit(0)).cast("double")
    steps = steps.select("sequence", "start", F.struct("depth", seen.alias("n"), "whole", "pull").alias("step"))
    # at most DEPTH steps each, from the shortest context on
    chains = steps.groupBy("sequence").agg(F.any_value("start").alias("start"), F.array_sort(F.collect_list("step")).alias("steps"))
    share = F.aggregate("steps", F.col("start"), lambda p, s: (s["n"] + s["pull"] * p) / (s["whole"] + s["pull"]))
    return chains.select("sequence", F.log10(share).alias("log"))
