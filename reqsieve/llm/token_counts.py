"""Token counts of whole texts without encoding most of them: the whole-token shortcut.

For a sentencepiece BPE vocabulary in which no piece goes on past a space or a line
feed, a text falls into pre-tokens (a run of spaces and the characters up to the next
space or line feed) that are encoded on their own. Which vocabulary strings come out as
exactly one token is proved once, by encoding them all; a pre-token that is one of them
counts 1 by a look at its hash. Only the rest is merged, once per task and spelling as
long as a table of fixed size remembers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reqsieve.llm import textbytes

#: Largest vocabulary file that is sent to the executors.
MODEL_BYTES = 64 << 20
#: Slots, as a power of 2, of the shortcut table and of the memory for merged pre-tokens.
SHORTCUT_BITS, MEMORY_BITS = 19, 21
_MERGE_BYTES = 1 << 14

_SPACE, _LINE = 0x20, 0x0A
_BODY = ~textbytes.byte_class((_SPACE, _SPACE), (_LINE, _LINE))
_BLANK = textbytes.byte_class((_SPACE, _SPACE))
_VALUES = textbytes.seeded(256, 2)
_SPACES = textbytes.seeded(1, 3)[0]
_META = "▁"


def pretoken_key(body_hash: np.ndarray, spaces: np.ndarray) -> np.ndarray:
    return textbytes.mix(body_hash + spaces.astype(np.uint64) * _SPACES)


class Counter:
    """Counts tokens of text columns; holds the proved shortcuts and a bounded memory."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) for i in ids]
        pieces = [self.model.id_to_piece(i) for i in ids if not special[i]]
        self.line = self.model.encode("\n")[-1]
        if any(_META in p.lstrip(_META) or "\n" in p for p in pieces):
            raise ValueError("a piece goes on past a space or line feed, so pre-tokens are not encoded on their own")
        if self.model.encode("\n") != [self.model.piece_to_id(_META), self.line] or len(self.model.encode(" \n ")) != 3:
            raise ValueError("the normalizer changes spaces")
        strings = [p.replace(_META, " ") for p in pieces if p.strip(_META)]
        strings = [s for s in strings if len(s) - len(s.lstrip(" ")) <= 1]
        single = self.merge([s.encode() for s in strings]) == 1
        proved = [s.encode() for s, one in zip(strings, single) if one]
        self.shortcut = np.zeros(1 << SHORTCUT_BITS, np.uint64)
        keys = self._keys(proved)
        self.shortcut[keys >> np.uint64(64 - SHORTCUT_BITS)] = keys  # of two in one slot, the other is merged
        self.known = np.zeros(1 << MEMORY_BITS, np.uint64)
        self.counts = np.zeros(1 << MEMORY_BITS, np.int64)
        self.blank: dict[int, int] = {}

    @staticmethod
    def _keys(strings: list[bytes]) -> np.ndarray:
        bodies = [s.lstrip(b" ") for s in strings]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        found = textbytes.words(data := np.frombuffer(b"".join(bodies), np.uint8), offsets, _BODY)
        return pretoken_key(textbytes.hashes(data, found, _VALUES), np.array([len(s) - len(b) for s, b in zip(strings, bodies)]))

    def merge(self, strings: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token, by the library: line feeds keep them apart."""
        counts = np.zeros(len(strings), np.int64)
        first = 0
        while first < len(strings):
            last, size = first, 0
            while last < len(strings) and (last == first or size + len(strings[last]) < _MERGE_BYTES):
                size += len(strings[last]) + 1
                last += 1
            ids = np.array(self.model.encode((b"\n" + b"\n".join(strings[first:last]) + b"\n").decode()))
            counts[first:last] = np.diff(np.flatnonzero(ids == self.line)) - 1
            first = last
        return counts

    def _blanks(self, spaces: np.ndarray) -> np.ndarray:
        """Tokens of runs of spaces that no character follows."""
        sizes, inverse = np.unique(spaces, return_inverse=True)
        for n in sizes.tolist():
            if n not in self.blank:
                if len(self.blank) > 4096:
                    self.blank.clear()
                self.blank[n] = int(self.merge([b" " * n])[0])
        return np.array([self.blank.get(n) or int(self.merge([b" " * n])[0]) for n in sizes.tolist()], np.int64)[inverse]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        rows = len(offsets) - 1
        filled = offsets[:-1] < offsets[1:]
        body = textbytes.words(data, offsets, _BODY)
        blank = textbytes.words(data, offsets, _BLANK)
        row_start = offsets[:-1][body.row]
        # spaces before each body; the library puts one before the text
        run = np.searchsorted(blank.end, body.start)
        run[run == len(blank.end)] = 0
        joined = (blank.end[run] == body.start) & (body.start > row_start) if len(blank.end) else np.zeros(len(body.start), bool)
        spaces = np.zeros(len(body.start), np.int64)
        spaces[joined] = (blank.end - blank.start)[run[joined]]
        spaces[body.start - spaces == row_start] += 1
        total = np.bincount(body.row, self._bodies(data, body, spaces), rows)
        # spaces that no body follows, a text that begins with a line feed, and line feeds
        alone = np.ones(len(blank.start), bool)
        alone[run[joined]] = False
        width = blank.end - blank.start + (blank.start == offsets[:-1][blank.row])
        if alone.any():
            total += np.bincount(blank.row[alone], self._blanks(width[alone]), rows)
        lines = np.searchsorted(np.flatnonzero(data == _LINE), offsets)
        total += np.diff(lines)
        total[filled] += data[offsets[:-1][filled]] == _LINE
        return total.astype(np.int64)

    def _bodies(self, data: np.ndarray, body: textbytes.Words, spaces: np.ndarray) -> np.ndarray:
        key = pretoken_key(textbytes.hashes(data, body, _VALUES), spaces)
        count = np.ones(len(key), np.int64)
        rest = np.flatnonzero(self.shortcut[key >> np.uint64(64 - SHORTCUT_BITS)] != key)
        slot = key[rest] >> np.uint64(64 - MEMORY_BITS)
        count[rest] = self.counts[slot]
        missing = rest[self.known[slot] != key[rest]]
        if len(missing):
            new, pick = np.unique(key[missing], return_index=True)
            at = missing[pick]
            whole = data.tobytes()
            strings = [b" " * s + whole[a:b] for s, a, b in zip(spaces[at].tolist(), body.start[at].tolist(), body.end[at].tolist())]
            merged = self.merge(strings)
            count[missing] = merged[np.searchsorted(new, key[missing])]
            slot = new >> np.uint64(64 - MEMORY_BITS)
            self.known[slot], self.counts[slot] = new, merged
            # of several keys in one slot the last stays; take its count along
            self.counts[slot] = merged[np.searchsorted(new, self.known[slot])]
        return count


_counters: dict[bytes, Counter] = {}


def counter(model: bytes) -> Counter:
    """One counter per worker process and vocabulary."""
    key = model[-64:] + len(model).to_bytes(8, "big")
    if key not in _counters:
        _counters[key] = Counter(model)
    return _counters[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return model


def count_tokens(docs: DataFrame, model_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with ``n_bytes`` (UTF-8) and ``n_tokens`` of its text.

    As the library encodes the text without begin and end tokens; strings of special
    tokens inside a text are ordinary text. A null or empty text has 0 of both. Rows
    are independent: repeated rows are repeated results, an empty table gives none.
    Columns named like the results must not be in ``keep``. The vocabulary file is read
    on the driver and sent to the executors.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    counted = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *counted])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model.value)
        for batch in batches:
            plain = pc.fill_null(batch.column(text), "")
            spaced = pc.replace_substring(plain, _META, " ")  # the library's own mark for a space
            tokens = [own.count(data, offsets) for _, _, data, offsets in textbytes.text_chunks(spaced)]
            size = np.diff(textbytes.column_bytes(plain)[1])
            total = np.concatenate([np.zeros(0, np.int64), *tokens])
            columns = [*(batch.column(c) for c in keep), pa.array(size), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_tokens"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(task, schema)
