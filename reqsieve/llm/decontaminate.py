"""Benchmark decontamination with suffix arrays over the training texts.

Every chunk of training text (a shard of bounded size, wherever Spark put it) gets its
suffix array: the positions of its words, sorted by the words that follow. Each
benchmark suffix is binary-searched in it, which yields all places where its window
occurs verbatim; windows on one diagonal join to the longest match. No row is shuffled,
so a hot source or passage loads no task more than its own bytes do.

The suffix arrays speak the benchmark's alphabet: its distinct words are numbered from
1, any other word is 0. A window holds benchmark words only, so suffixes that start
with another word need no place in the array, and several words fit one sort key.

Benchmarks are taken in blocks of at most ``BLOCK_BYTES`` of text (or one longer item),
each broadcast and searched in the same pass over the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.llm import textbytes
from reqsieve.llm.worker import lean

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Bytes of training text searched at once: a task takes some 35 times as much for it.
CHUNK_BYTES = 1 << 18
_SEEN_BITS = 20


class Index(NamedTuple):
    """A block of benchmark items, ready to be searched for."""

    window: int
    ids: pa.Array  # item ids of the block
    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1
    seen: np.ndarray  # by the leading bits of a hash: may it be in the vocabulary
    bits: int  # of a word's number
    keys: np.ndarray  # distinct windows x levels: packed words
    spans: np.ndarray  # the same, with the free places after a short window filled up
    length: np.ndarray  # words of each distinct window
    first: np.ndarray  # distinct windows + 1: their occurrences below
    item: np.ndarray
    offset: np.ndarray


def _packed(codes: np.ndarray, bits: int, window: int) -> np.ndarray:
    """Sort keys of the ``window`` words from each position, as many as fit one key at each level."""
    per = 63 // bits
    padded = np.concatenate([codes, np.zeros(window + per, np.int64)])
    levels = []
    for begin in range(0, window, per):
        key = np.zeros(len(codes), np.int64)
        for j in range(begin, begin + per):
            key <<= bits
            if j < window:
                key |= padded[j : j + len(codes)]
        levels.append(key)
    return np.stack(levels, axis=1)


def build_index(items: pa.Table, window: int = WINDOW) -> Index | None:
    """Index of a block with columns ``item_id`` and ``text``; None if no item has a word."""
    data, offsets = textbytes.column_bytes(items["text"])
    found = textbytes.words(data, offsets)
    if not len(found.start):
        return None
    vocabulary, code = np.unique(textbytes.hashes(data, found), return_inverse=True)
    code = code.astype(np.int64) + 1
    bits = max(1, int(len(vocabulary)).bit_length())
    counts = np.diff(found.bounds)
    item = found.row
    place = np.arange(len(code)) - found.bounds[:-1][item]
    whole = np.where(counts[item] < window, place == 0, place + window <= counts[item])
    start = np.flatnonzero(whole)
    length = np.minimum(counts[item[start]], window)
    # words of the following item are no part of a short one
    per = 63 // bits
    levels = -(-window // per)
    keys, spans = np.zeros((len(start), levels), np.int64), np.zeros((len(start), levels), np.int64)
    padded = np.concatenate([code, np.zeros(window, np.int64)])
    fill = (1 << bits) - 1
    for level in range(levels):
        for j in range(level * per, (level + 1) * per):
            keys[:, level] <<= bits
            spans[:, level] <<= bits
            if j < window:
                inside = j < length
                word = padded[start + j]
                keys[:, level] |= np.where(inside, word, 0)
                spans[:, level] |= np.where(inside, word, fill)
    whole_key = np.concatenate([keys, length[:, None]], axis=1)
    _, pick, group = np.unique(whole_key, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    seen = np.zeros(1 << _SEEN_BITS, bool)
    seen[vocabulary >> np.uint64(64 - _SEEN_BITS)] = True
    return Index(
        window, items["item_id"].combine_chunks(), vocabulary, seen, bits, keys[pick], spans[pick], length[pick],
        np.searchsorted(group.ravel()[order], np.arange(len(pick) + 1)), item[start][order], place[start][order],
    )


def _codes(index: Index, word_hash: np.ndarray) -> np.ndarray:
    code = np.zeros(len(word_hash), np.int64)
    maybe = np.flatnonzero(index.seen[word_hash >> np.uint64(64 - _SEEN_BITS)])
    place = np.searchsorted(index.vocabulary, word_hash[maybe])
    place[place == len(index.vocabulary)] = 0
    code[maybe] = np.where(index.vocabulary[place] == word_hash[maybe], place + 1, 0)
    return code


def _suffix_array(keys: np.ndarray, bits: int) -> np.ndarray:
    """Positions sorted by their keys, level by level; only ties go on to the next level."""
    order = np.argsort(keys[:, 0])
    low = (1 << bits) - 1
    for level in range(1, keys.shape[1]):
        sorted_keys = keys[order, level - 1]
        same = np.zeros(len(order), bool)
        equal = (sorted_keys[1:] == sorted_keys[:-1]) & (sorted_keys[1:] & low != 0)
        for earlier in range(level - 1):
            column = keys[order, earlier]
            equal &= column[1:] == column[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort([keys[rows, k] for k in range(level, -1, -1)])]
    return order


def _ranges(index: Index, keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of the suffix array that starts with each distinct window."""
    head = keys[order, 0]
    low = np.searchsorted(head, index.keys[:, 0], side="left")
    high = np.searchsorted(head, index.spans[:, 0], side="right")
    for level in range(1, keys.shape[1]):
        column = keys[order, level]
        open_ = np.flatnonzero((low < high) & (index.spans[:, level - 1] == index.keys[:, level - 1]))
        for side, bound in (("left", index.keys), ("right", index.spans)):
            a, b, goal = low[open_].copy(), high[open_].copy(), bound[open_, level]
            while (a < b).any():
                middle = (a + b) // 2
                value = column[np.minimum(middle, len(column) - 1)]
                further = (value < goal if side == "left" else value <= goal) & (a < b)
                a, b = np.where(further, middle + 1, a), np.where(further | (a >= b), b, middle)
            if side == "left":
                left = a
            else:
                low[open_], high[open_] = left, a
    return low, np.maximum(low, high)


class Found(NamedTuple):
    covered: np.ndarray  # per word of the chunk: is it inside an occurring window
    row: np.ndarray  # one entry per row and item from here on, the longest match
    item: np.ndarray
    length: np.ndarray
    row_word: np.ndarray
    item_word: np.ndarray


def search(index: Index, found: textbytes.Words, word_hash: np.ndarray) -> Found:
    """All benchmark windows of a chunk of training rows."""
    counts = np.diff(found.bounds)
    none = np.zeros(0, np.int64)
    nothing = Found(np.zeros(len(word_hash), bool), none, none, none, none, none)
    code = _codes(index, word_hash)
    # a 0 after each row, so that no window runs on into the next row
    place = np.arange(len(code)) + found.row
    text = np.zeros(len(code) + len(counts), np.int64)
    text[place] = code
    row_of = np.repeat(np.arange(len(counts)), counts + 1)
    suffixes = np.flatnonzero(text)
    if not len(suffixes):
        return nothing
    keys = _packed(text, index.bits, index.window)[suffixes]
    order = _suffix_array(keys, index.bits)
    low, high = _ranges(index, keys, order)
    matched = np.flatnonzero(low < high)
    if not len(matched):
        return nothing
    size = high[matched] - low[matched]
    window = np.repeat(matched, size)
    at = suffixes[order[np.repeat(low[matched], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]]
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + index.length[window], -1)
    covered = np.cumsum(cover)[:-1] > 0
    # occurrences in the items, joined along diagonals to the longest match
    times = index.first[window + 1] - index.first[window]
    which = np.repeat(index.first[window], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at, length = np.repeat(at, times), np.repeat(index.length[window], times)
    item, offset = index.item[which], index.offset[which]
    row, diagonal = row_of[at], at - offset
    by = np.lexsort([at, diagonal, item, row])
    row, item, diagonal, at, length, offset = (x[by] for x in (row, item, diagonal, at, length, offset))
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(at))) - 1 + length[begin]
    row, item, at, offset = row[begin], item[begin], at[begin], offset[begin]
    best = np.lexsort([at, -run, item, row])
    first = np.ones(len(best), bool)
    first[1:] = (row[best][1:] != row[best][:-1]) | (item[best][1:] != item[best][:-1])
    best = best[first]
    starts = (found.bounds[:-1] + np.arange(len(counts)))[row[best]]
    return Found(covered[place], row[best], item[best], run[best], at[best] - starts, offset[best])


def _searched(indexes: list[Index], column: pa.Array) -> Iterator[tuple[int, int, textbytes.Words, list[Found]]]:
    """(first row, end row, words, what each index found) of each chunk of a text column."""
    for first, last, data, offsets in textbytes.text_chunks(column, CHUNK_BYTES):
        found = textbytes.words(data, offsets)
        word_hash = textbytes.hashes(data, found)
        yield first, last, found, [search(i, found, word_hash) for i in indexes]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks of about ``block_bytes``, one on the driver at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else items
        yield block.toArrow()


def find_matches(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The columns ``keep`` of every row, and what of the benchmark it holds.

    ``n_words``, ``n_hit`` (words inside an occurring window) and ``matches``: for each
    item of which a window occurs, its longest verbatim match (``item_id``, ``words``,
    and where it starts: ``doc_word``, ``item_word``, from 0), the first of equals.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z as a-z. A window is
    ``window`` successive words of an item; an item with fewer words is one window.
    A null or empty text has no words and no matches; an item without words or with
    null text never matches; repeated rows and items are each reported. With an empty
    benchmark nothing matches. Columns of ``docs`` named like the results must not be
    in ``keep``.
    """
    spark = docs.sparkSession
    kept = [docs.schema[c] for c in keep]
    match = T.StructType(
        [benchmark.schema["item_id"], *(T.StructField(c, T.LongType()) for c in ("words", "doc_word", "item_word"))]
    )
    results = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("matches", T.ArrayType(match))]
    schema = T.StructType([*kept, *results])
    indexes, id_type = [], pa.null()
    for block in _blocks(benchmark, block_bytes):
        id_type = block.schema.field("item_id").type
        if (index := build_index(block, window)) is not None:
            indexes.append(spark.sparkContext.broadcast(index))
    needed = list(dict.fromkeys([*keep, text]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found, searched in _searched([i.value for i in indexes], batch.column(text)):
                ids = [i.value.ids for i in indexes]
                yield _result(batch.slice(first, last - first).select(keep), found, ids, id_type, searched)

    return docs.select(*needed).mapInArrow(lean(task), schema)


def _result(rows: pa.RecordBatch, found: textbytes.Words, ids: list[pa.Array], id_type: pa.DataType, searched: list[Found]) -> pa.RecordBatch:
    covered = np.zeros(len(found.start), bool)
    for one in searched:
        covered |= one.covered
    hit = np.bincount(found.row[covered], minlength=len(rows))
    gathered = {c: np.concatenate([np.zeros(0, np.int64), *(getattr(f, c) for f in searched)]) for c in ("row", "length", "row_word", "item_word")}
    order = np.argsort(gathered["row"], kind="stable")
    items = pa.concat_arrays([pa.nulls(0, id_type), *(i.take(pa.array(f.item)) for i, f in zip(ids, searched))]).take(pa.array(order))
    parts = [items, *(pa.array(gathered[c][order]) for c in ("length", "row_word", "item_word"))]
    structs = pa.StructArray.from_arrays(parts, names=["item_id", "words", "doc_word", "item_word"])
    bounds = np.searchsorted(gathered["row"][order], np.arange(len(rows) + 1))
    matches = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)
    columns = [*rows.columns, pa.array(np.diff(found.bounds).astype(np.int64)), pa.array(hit.astype(np.int64)), matches]
    return pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "n_words", "n_hit", "matches"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with their own columns.

    Null and empty texts stay.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = find_matches(inner, benchmark, inner.columns, text=f"c{names.index(text)}", window=window)
    return found.filter("n_hit = 0").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
