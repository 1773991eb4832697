"""Spelling variants: words one edit apart, found in sorted lists by shared rows of an edit matrix.

**Words.** A text's words are its maximal runs of Latin letters (one byte range more than
ASCII), A-Z in lower case. ``word_counts`` counts them over all texts; where a run's digest
says so (``lost_letter``), one letter of it is dropped first.

**Where a pair meets.** Two words one edit apart, the shorter of ``m`` letters, first differ
at one place ``i`` of ``0 .. m``. For any window ``[low, high)`` of places that holds ``i``
both have the same first ``low`` and the same last ``m - high`` letters, so these letters
name a list in which the two meet. Each word goes to the lists of the two halves of its
places, once as the shorter and once as the longer word. A list of more than
``LIST_WORDS`` words is cut at the middle of its window until it is short enough; at one
place, the letters around it leave some thousand words at most. A pair counts in the one list whose
window holds the place at which the two words first differ, so it counts once.

**Within a list**, the words' middles are sorted. Adjacent ones share a prefix, whose rows of the edit
matrix against a word (three cells each, as only one edit counts) are the same: a row is
worked out once per shared prefix, and a range of the list ends as soon as all cells of
its prefix exceed one edit. All words of a task go down their lists side by side.

**Forms.** A word's form is its near word of most occurrences if it has at least ``FACTOR``
times the word's own; following forms at least doubles the count each time, so chains are
short, and they are followed by doubling, between forms only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.llm import textbytes
from reqsieve.session import Scratch, cut_lineage, split_hot_keys
from reqsieve.sizing import join_side

LEAST_LETTERS, LEAST_COUNT, FACTOR = 5, 3, 2
#: A run loses a letter if this divides its digest.
LOSS_DIVISOR = 97
#: Words of one list at most, before its window is cut; and of the lists a task works on at once.
LIST_WORDS, BLOCK_WORDS = 20_000, 60_000
#: Letters that a block holds at most, unless one list holds more.
_BLOCK_LETTERS = 8 << 20
#: Words that go down their lists at once.
_QUERIES = 8_192
_FAR = 2

# --- words ---------------------------------------------------------------------

# The ASCII letters, and the lead byte of U+00C0 to U+00FF in UTF-8.
_LETTER = textbytes.byte_class((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC3))
_LEAD, _SPACE = 0xC3, 0x20
_CRC_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(_CRC_POLYNOMIAL), value >> 1).astype(np.uint32)
    return value


_CRC = _crc_table()
#: Runs longer than this are digested one by one.
_SHORT = 64


def letters_only(data: np.ndarray) -> np.ndarray:
    """The bytes of texts with A-Z in lower case and a space for whatever is no letter; no text ends in a lead byte."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == _LEAD
    return np.where(inside, textbytes.LOWER[data], np.uint8(_SPACE))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes, carried on from the crc32 of what stands before them."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    state = (before[order] ^ np.uint32(0xFFFFFFFF)).astype(np.uint32)
    at, size = start[order], length[order]
    long = int(np.searchsorted(-size, -_SHORT, side="left"))  # runs of more than _SHORT bytes
    for k in range(_SHORT):
        n = int(np.searchsorted(-size, -k, side="left"))  # runs that have a byte k
        if n <= long:
            break
        part = state[long:n]
        state[long:n] = _CRC[(part ^ data[at[long:n] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    value = np.empty(len(order), np.uint32)
    value[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:long]:
        value[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(before[k]))
    return value


def lost_letter(run: str, digest: int, divisor: int = LOSS_DIVISOR) -> str:
    """``run`` without one letter, if ``divisor`` divides the digest."""
    if digest % divisor:
        return run
    at = digest % len(run)
    return run[:at] + run[at + 1 :]


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): chunks of rows, and long rows in pieces that end between words."""
    for first, last in textbytes.row_chunks(offsets, limit):
        low, high = int(offsets[first]), int(offsets[last])
        if last - first > 1 or high - low <= limit:
            yield np.arange(first, last), data[low:high], offsets[first : last + 1] - low
            continue
        while low < high:
            cut = min(low + limit, high)
            while cut < high and data[cut] != _SPACE:  # on to the end of a word
                step = np.flatnonzero(data[cut : cut + limit] == _SPACE)
                cut = cut + int(step[0]) if len(step) else min(cut + limit, high)
            yield np.array([first]), data[low:cut], np.array([0, cut - low])
            low = cut


def _count_batch(ids: list[str | None], column: pa.Array, least_letters: int, divisor: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    raw, offsets = textbytes.column_bytes(column)
    crc = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    for rows, data, bounds in _pieces(letters_only(raw), offsets, textbytes.CHUNK_BYTES):
        found = textbytes.words(data, bounds, textbytes.VISIBLE)
        if not len(found.start):
            continue
        code, row = textbytes.hashes(data, found), rows[found.row]
        # one entry for each text and run: all its occurrences share a digest
        _, at, times = np.unique(code ^ textbytes.mix(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
        start, end, code = found.start[at], found.end[at], code[at]
        loses = digests(data, start, end, crc[row[at]])
        lost = loses % np.uint32(divisor) == 0
        _, first, word = np.unique(code[~lost], return_index=True, return_inverse=True)
        total = np.bincount(word, times[~lost], len(first)).astype(np.int64)
        begin, stop = start[~lost][first], end[~lost][first]
        further = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
        size = stop - begin - (further[stop] - further[begin])
        wide = size >= least_letters
        whole = data.tobytes()
        words = [whole[a:b] for a, b in zip(begin[wide].tolist(), stop[wide].tolist())]
        shorter = [(lost_letter(whole[a:b].decode(), d, divisor).encode(), n) for a, b, d, n in zip(start[lost].tolist(), end[lost].tolist(), loses[lost].tolist(), times[lost].tolist())]
        shorter = [(w, n) for w, n in shorter if len(w.decode()) >= least_letters]
        yield words + [w for w, _ in shorter], np.concatenate([total[wide], np.array([n for _, n in shorter], np.int64)])


def word_counts(docs: DataFrame, text: str = "text", id: str = "doc_id", least_letters: int = LEAST_LETTERS, divisor: int = LOSS_DIVISOR) -> DataFrame:
    """``(word, n)``: words of at least ``least_letters`` letters and their occurrences in all texts.

    A run loses a letter where ``divisor`` divides the crc32 of ``<id>:<run>``; a null id
    counts as an empty one. Null and empty texts have no words. A long text is worked on in
    pieces; counts are added up per task before they are shuffled.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in _count_batch(batch.column(0).to_pylist(), batch.column(1), least_letters, divisor):
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], names=["word", "n"])

    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- lists -----------------------------------------------------------------------


def _windows() -> Column:
    """The lists of a word of ``size`` letters: (m, low, high) of both halves, as the shorter and as the longer word."""
    size = F.col("size")

    def halves(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.struct(m.alias("m"), low.alias("low"), high.alias("high")) for low, high in ((half, m + 1), (F.lit(0), half))]

    return F.array(*halves(size), *halves(size - 1))


def _list_key() -> Column:
    """What all words of a list share, in 64 bits; lists that meet by chance stay two, see ``near_words``."""
    tail = F.greatest(F.col("m") - F.col("high"), F.lit(0))
    shared = F.concat(F.expr("substring(word, 1, low)"), F.lit("/"), F.when(tail > 0, F.right(F.col("word"), tail)).otherwise(""))
    return F.xxhash64("m", "low", "high", shared)


def _cut(entries: DataFrame, scratch: Scratch, list_words: int) -> DataFrame:
    """``entries`` with the windows of long lists cut in halves until no list is long."""
    settled: DataFrame | None = None
    while True:
        keyed = entries.withColumn("key", _list_key())
        # a list of one place cannot be cut, and need not be
        long = keyed.filter("high - low > 1").groupBy("key").count().filter(F.col("count") > list_words).select("key")
        long = scratch.table(long, "long")
        if long.isEmpty():
            return entries if settled is None else settled.unionByName(entries)
        side = join_side(long)
        short = keyed.join(side, "key", "left_anti").drop("key").unionByName(keyed.filter("high - low <= 1").join(side, "key", "left_semi").drop("key"))
        settled = short if settled is None else settled.unionByName(short)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(*[F.struct(a.alias("low"), b.alias("high")) for a, b in ((F.col("low"), middle), (middle, F.col("high")))])
        again = keyed.filter("high - low > 1").join(side, "key", "left_semi").withColumn("half", F.explode(halves))
        entries = scratch.table(again.select("word", "n", "m", F.col("half.low").alias("low"), F.col("half.high").alias("high")), "cut")


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    """One row of codes per word; 0 beyond its end."""
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)


def near_in_lists(lists: np.ndarray, middles: list[bytes], queries: int = _QUERIES) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs of places whose middles, in one list, are one edit apart.

    ``lists`` numbers the list of each middle, in ascending order; the middles of a list
    are sorted and distinct.
    """
    n, none = len(middles), np.zeros(0, np.int64)
    if n < 2:
        return none, none
    size = np.array([len(w) for w in middles])
    width = int(size.max()) + 3
    code = _matrix(middles, width)
    # letters that a middle shares with the one before it; less than none at the head of a list
    shared = np.full(n, -1)
    same = lists[1:] == lists[:-1]
    shared[1:][same] = np.argmax(code[1:] != code[:-1], axis=1)[same]

    # the prefixes of each length: where the range of the list that shares one begins and ends
    levels = []
    for depth in range(width - 2):
        begin = np.flatnonzero((shared < depth) & (size >= depth))
        breaks = np.append(np.flatnonzero(shared < depth), n)
        levels.append((begin, breaks[np.searchsorted(breaks, begin, side="right")]))
    children = []
    for depth in range(len(levels) - 1):
        begin, end = levels[depth]
        below = levels[depth + 1][0]
        children.append((np.searchsorted(below, begin), np.searchsorted(below, end)))

    # a word alone in its list has no pair
    head = np.searchsorted(levels[0][0], np.arange(n), side="right") - 1
    company = (levels[0][1] - levels[0][0])[head] > 1
    asked = np.flatnonzero(company)
    left, right = [none], [none]
    for block in np.array_split(asked, max(1, -(-len(asked) // queries))):
        query, node = block, head[block]
        # cells of the row of the empty prefix: one before the diagonal, on it, and one behind
        row = [np.full(len(block), _FAR, np.int8), np.zeros(len(block), np.int8), np.where(size[block] >= 1, 1, _FAR).astype(np.int8)]
        for depth in range(len(children)):
            if not len(query):
                break
            first, last = children[depth][0][node], children[depth][1][node]
            count = last - first
            place = np.repeat(np.arange(len(query)), count)
            child = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count) + first[place]
            query, a, b, c = query[place], row[0][place], row[1][place], row[2][place]
            at = levels[depth + 1][0][child]
            letter, length = code[at, depth], size[query]
            differs = lambda k: (code[query, k] != letter).astype(np.int8)  # noqa: E731, B023
            x = np.minimum(a + differs(depth - 1) if depth else np.int8(_FAR), b + 1)
            y = np.minimum(np.minimum(b + differs(depth), c + 1), x + 1)
            z = np.minimum(c + differs(depth + 1), y + 1)
            y = np.where(depth + 1 <= length, y, _FAR)
            z = np.where(depth + 2 <= length, z, _FAR)
            x = np.where(depth <= length, x, _FAR)
            # a middle that ends here is the first of its range
            ends = size[at] == depth + 1
            final = np.select([length == depth, length == depth + 1, length == depth + 2], [x, y, z], _FAR)
            hit = ends & (final == 1)
            left.append(query[hit])
            right.append(at[hit])
            on = np.minimum(np.minimum(x, y), z) <= 1
            query, node = query[on], child[on]
            row = [cell[on].astype(np.int8) for cell in (x, y, z)]
    return np.concatenate(left), np.concatenate(right)


def _near_of_block(words: list[bytes], n: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For whole lists, sorted: which words have near ones, how many, and which of these is the most frequent."""
    tail = np.maximum(m - high, 0)
    heads = [(k, l, h, w[:l], w[len(w) - t :]) for w, k, l, h, t in zip(words, m.tolist(), low.tolist(), high.tolist(), tail.tolist())]
    number = np.cumsum([k > 0 and heads[k] != heads[k - 1] for k in range(len(heads))])
    middles = [w[l : len(w) - t] for w, l, t in zip(words, low.tolist(), tail.tolist())]
    size = np.array([len(w) for w in middles])
    # lists of like widths go together, so that a long word does not widen the rows of short ones
    widest = np.zeros(number[-1] + 1, np.int64)
    np.maximum.at(widest, number, size)
    kind = np.where(np.bincount(number) > 1, np.frexp(np.maximum(widest, 1))[1], 0)[number]
    parts = [np.zeros((3, 0), np.int64)]
    for k in np.unique(kind[kind > 0]):
        place = np.flatnonzero(kind == k)
        own = [middles[p] for p in place.tolist()]
        a, b = near_in_lists(number[place], own)
        if len(a):
            code = _matrix(own, int(size[place].max()) + 1)
            parts.append(np.stack([place[a], place[b], np.argmax(code[a] != code[b], axis=1)]))
    a, b, differ = np.concatenate(parts, axis=1)
    # the shorter word has m letters, and the words first differ inside the window
    size = np.array([len(w) for w in words])
    counts = (np.minimum(size[a], size[b]) == m[a]) & (low[a] + differ < high[a])
    a, b = a[counts], b[counts]
    order = np.lexsort([_most_frequent_first(words, n)[b], a])
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
    return a[first], np.diff(np.append(first, len(a))), b[first]


def _most_frequent_first(words: list[bytes], n: np.ndarray) -> np.ndarray:
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda k: (-int(n[k]), words[k]))] = np.arange(len(words))
    return rank


def near_words(vocabulary: DataFrame, scratch: Scratch, list_words: int = LIST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows ``(word, n_near, best_n, best)`` for the lists in which a word of ``(word, n)`` has near words:
    how many, and the most frequent one (of equals, the first in code-point order).

    A word may have several rows, one per list; no near word is in two of them.
    """
    sized = vocabulary.select("word", "n", F.char_length("word").alias("size"))
    entries = sized.withColumn("w", F.explode(_windows())).select("word", "n", "w.m", "w.low", "w.high").filter(F.col("high") > F.col("low"))
    entries = _cut(entries, scratch, list_words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def worked(table: pa.Table) -> pa.RecordBatch:
            words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
            n, m, low, high = (table.column(c).to_numpy() for c in ("n", "m", "low", "high"))
            a, count, best = _near_of_block(words, n, m, low, high)
            spelled = lambda places: pa.array([words[k].decode("latin-1") for k in places.tolist()], pa.string())
            return pa.RecordBatch.from_arrays([spelled(a), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), spelled(best)], names=["word", "n_near", "best_n", "best"])

        rows = letters = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            letters += batch.column("word").nbytes
            if rows >= block_words or letters >= _BLOCK_LETTERS:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # whole lists only: the last one may go on
                if cut:
                    yield worked(table.slice(0, cut))
                    # copied, so that what was worked on can go
                    held = pa.concat_tables([table.slice(cut)]).combine_chunks().to_batches()
                    rows, letters = len(table) - cut, sum(b.column("word").nbytes for b in held)
        if rows:
            yield worked(pa.Table.from_batches(held))

    tail = F.greatest(F.col("m") - F.col("high"), F.lit(0))
    middle = F.expr("substring(word, low + 1, char_length(word) - low - greatest(m - high, 0))")
    dealt = entries.withColumn("key", _list_key()).repartition("key")
    # lists whose keys meet by chance are told apart by their windows and letters
    prefix, suffix = F.expr("substring(word, 1, low)"), F.when(tail > 0, F.right(F.col("word"), tail)).otherwise("")
    ordered = dealt.sortWithinPartitions("key", "m", "low", "high", prefix, suffix, middle)
    return ordered.select("key", "word", "n", "m", "low", "high").mapInArrow(task, "word string, n_near long, best_n long, best string")


# --- forms -------------------------------------------------------------------------


def _roots(linked: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every word that is some word's form: the end of its own chain of forms."""
    heads = linked.select(F.col("form").alias("node")).distinct()
    steps = linked.select(F.col("word").alias("node"), F.col("form").alias("next"))
    chain = scratch.table(heads.join(steps, "node", "left").select("node", F.coalesce("next", "node").alias("root")), "chain")
    while True:
        ahead = chain.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = scratch.table(chain.join(join_side(ahead), "root").select("node", "root", "further"), "chain")
        if jumped.filter(F.col("root") != F.col("further")).isEmpty():
            return jumped.select("node", "root")
        chain = jumped.select("node", F.col("further").alias("root"))


def spelling_forms(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    factor: int = FACTOR,
    divisor: int = LOSS_DIVISOR,
    list_words: int = LIST_WORDS,
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word of enough letters and occurrences.

    ``n_near`` counts the words that differ by one letter put in, left out or replaced;
    ``form`` is the most frequent of these (ties: first in code-point order) if it occurs at
    least ``factor`` times as often as the word, and ``root`` is where following forms ends,
    the word itself without a form. Null and empty texts, and texts without words, add
    nothing; repeated rows count each time; an empty table gives no words. Other columns of
    ``docs`` play no part, whatever their names.
    """
    if factor < 2 or least_letters < 2:
        raise ValueError("chains of forms end only if counts double, and words need two letters to have halves")
    spark = split_hot_keys(docs.sparkSession)
    with Scratch(spark, "spelling") as scratch:
        counted = word_counts(docs, text, id, least_letters, divisor).filter(F.col("n") >= least_count)
        vocabulary = scratch.table(counted, "vocabulary")
        near = near_words(vocabulary.filter(F.char_length("word") >= least_letters), scratch, list_words)
        none = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:long,word:string>").alias("best"))
        found = near.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")).alias("best"))
        grouped = none.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
        likelier = -F.col("best.less") >= factor * F.col("n")
        forms = grouped.select(
            "word", "n", "n_near", F.when(likelier, F.col("best.word")).alias("form"), F.when(likelier, -F.col("best.less")).alias("form_n")
        )
        forms = scratch.table(forms, "forms")
        roots = _roots(forms.filter("form IS NOT NULL"), scratch)
        rooted = forms.join(join_side(roots.withColumnRenamed("node", "form")), "form", "left")
        result = rooted.select("word", "form", F.coalesce("root", "form", "word").alias("root"), "n", "n_near", "form_n")
        return cut_lineage(result, "spelling-forms")
