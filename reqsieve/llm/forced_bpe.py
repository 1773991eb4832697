"""Byte-pair encoding with word ends by forced-boundary splitting, and decoding.

If two successive bytes stand side by side inside no vocabulary token, no merge can ever
join them, so a word may be cut there for certain. Words are cut at all such places, the
fragments are merged independently, and their ids are concatenated. The fragments of
all new words of a stretch of rows are merged together, one merge of each at a time, as
rows of a matrix. Words are remembered in dictionaries of bounded size, so a spelling is
merged once per task for as long as it is remembered.

The rules around the merges (composed characters, lower case, which strings are special,
where words begin) are read from the tokenizer's file and must be of the known kinds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reqsieve.llm import textbytes
from reqsieve.llm.worker import held, lean

#: Largest vocabulary file that is sent to the executors.
MODEL_BYTES = 64 << 20
#: Words remembered by a worker, in each of two generations.
MEMORY = 200_000
#: Bytes of text whose words are looked up together.
STRETCH_BYTES = 1 << 20
#: Longer fragments are merged one by one.
_SHORT = 64
_ID_BITS = 24
_LATIN = 0x250
_BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")
# The white space of the Unicode standard.
_WHITE = r"\t-\r\x20\x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable Latin-1, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in letters)
    return [c for _, c in sorted({**letters, **{b: chr(256 + i) for i, b in enumerate(rest)}}.items())]


class _Memory:
    """A dictionary of two generations: what is used stays, the rest goes when it is full."""

    def __init__(self) -> None:
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that are not remembered; the others are kept for now."""
        if len(self.young) + len(keys) > MEMORY:
            self.young, self.old = {}, self.young
        new = []
        for key in keys.difference(self.young):
            value = self.old.get(key)
            if value is None:
                new.append(key)
            else:
                self.young[key] = value
        return new


class _Pairs:
    """Merges by pair of ids: rank and merged id, by open addressing."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.none = len(merges)
        size = 1 << max(12, (8 * len(merges)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.ranks, self.probes = np.full(size + 64, -1, np.int64), np.full(size + 64, self.none, np.int32), 1
        self.merged = np.array([m for _, _, m in merges] + [0], np.int32)
        key = np.array([a << _ID_BITS | b for a, b, _ in merges], np.int64)
        for rank, (k, slot) in enumerate(zip(key.tolist(), self._slot(key).tolist())):
            at = slot
            while self.keys[at] != -1:
                at += 1
            self.keys[at], self.ranks[at] = k, rank
            self.probes = max(self.probes, at - slot + 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << _ID_BITS | right
        slot = self._slot(key)
        found = np.where(self.keys[slot] == key, self.ranks[slot], self.none)
        for step in range(1, self.probes):
            found = np.where(self.keys[slot + step] == key, self.ranks[slot + step], found)
        return found


class Codec:
    """Encodes whole texts to ids and decodes ids to text."""

    def __init__(self, text: str):
        rules = json.loads(text)
        model, added = rules["model"], rules["added_tokens"]
        self.suffix = model["end_of_word_suffix"] or ""
        self._expect(rules, model, added)
        self.vocabulary: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocabulary.items()} | {a["id"]: a["content"] for a in added}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        number = self.vocabulary
        self.pairs = _Pairs([(number[a], number[b], number[a + b]) for a, b in pairs])
        self.rank = {(number[a], number[b]): k for k, (a, b) in enumerate(pairs)}
        self.special = {a["content"]: str(a["id"]) for a in added}
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        split = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split.replace(r"\s", _WHITE))
        # the same for texts of Latin characters only, which the plainer library splits faster
        latin = [chr(c) for c in range(_LATIN)]
        plain = {kind: "".join(re.escape(c) for c in latin if regex.fullmatch(kind, c)) for kind in (r"\p{L}", r"\p{N}")}
        for kind, members in plain.items():
            split = split.replace(f"[{kind}]", kind).replace(kind + "+", f"[{members}]+").replace(f"|{kind}|", f"|[{members}]|").replace(kind, members)
        self.latin_word = re.compile(split.replace(r"\s", _WHITE))
        self.letters = byte_letters()
        self.inside, self.last = self._pairs()
        self.middle_id = np.array([number[c] for c in self.letters], np.int32)
        self.final_id = np.array([number[c + self.suffix] for c in self.letters], np.int32)
        self.memory = _Memory()
        self.id_text = [str(i) for i in range(max(self.tokens) + 1)]
        self.token_text = {str(i): t for i, t in self.tokens.items()}
        # what the table of characters in use here does not know is split by the library
        self.library = tokenizers.Tokenizer.from_str(text)

    @staticmethod
    def _expect(rules: dict, model: dict, added: list) -> None:
        normal = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = (
            normal == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
            and rules["post_processor"] is None
            and rules["decoder"] is None
        )
        if not known:
            raise ValueError("the tokenizer has rules other than the known ones")

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Which byte may follow which inside a token, and which may end the word after which."""
        byte = {c: b for b, c in enumerate(self.letters)}
        inside, last = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
        for token in self.vocabulary:
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            codes = [byte[c] for c in (token[: -len(self.suffix)] if ends else token) if c in byte]
            for k in range(1, len(codes)):
                (last if ends and k == len(codes) - 1 else inside)[codes[k - 1], codes[k]] = True
        return inside, last

    def cuts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where fragments begin in words laid end to end; ``first``: where the words begin."""
        begin = np.zeros(len(data), bool)
        final = np.zeros(len(data), bool)
        begin[first] = True
        final[np.append(first[1:], len(data)) - 1] = True
        before, after = data[:-1], data[1:]
        begin[1:] |= ~np.where(final[1:], self.last[before, after], self.inside[before, after])
        return np.flatnonzero(begin)

    def _encode_words(self, words: list[str]) -> list[str]:
        """The ids of each word, joined by a space."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(w) for w in raw])[:-1]]).astype(np.int64)
        begin = self.cuts(data, first)
        letters = self.middle_id[data]
        ends = np.append(first[1:], len(data)) - 1
        letters[ends] = self.final_id[data[ends]]
        length = np.diff(np.append(begin, len(data)))
        left = np.zeros(len(data), bool)  # where a token of the result stands
        ids = letters.copy()
        for low, high in ((1, 1), (2, 8), (9, 16), (17, _SHORT)):
            rows = np.flatnonzero((length >= low) & (length <= high))
            if high == 1:
                left[begin[rows]] = True
            elif len(rows):
                self._merge_matrix(letters, begin[rows], length[rows], ids, left)
        for k in np.flatnonzero(length > _SHORT).tolist():
            merged = self._merge_long(letters[begin[k] : begin[k] + length[k]].tolist())
            ids[begin[k] : begin[k] + len(merged)] = merged
            left[begin[k] : begin[k] + len(merged)] = True
        places = np.flatnonzero(left)
        texts = list(map(self.id_text.__getitem__, ids[places].tolist()))
        bounds = np.searchsorted(places, np.append(first, len(data))).tolist()
        return [" ".join(texts[a:b]) for a, b in zip(bounds, bounds[1:])]

    def _merge_matrix(self, letters: np.ndarray, begin: np.ndarray, length: np.ndarray, ids: np.ndarray, left: np.ndarray) -> None:
        """Merge many fragments side by side: the lowest rank of each, the leftmost of equals."""
        width = int(length.max())
        column = np.arange(width)
        inside = column < length[:, None]
        symbols = np.where(inside, letters[np.minimum(begin[:, None] + column, len(letters) - 1)], 0)
        ranks = np.full(symbols.shape, self.pairs.none, np.int32)
        joined = inside[:, 1:]
        ranks[:, :-1][joined] = self.pairs.rank(symbols[:, :-1][joined], symbols[:, 1:][joined])
        length = length.copy()
        while len(symbols):
            at = ranks.argmin(axis=1)
            every = np.arange(len(symbols))
            lowest = ranks[every, at]
            going = lowest < self.pairs.none
            done = ~going
            if done.any():
                cells = column < length[done, None]
                place = (begin[done, None] + column)[cells]
                ids[place], left[place] = symbols[done][cells], True
                symbols, ranks, length, begin = symbols[going], ranks[going], length[going], begin[going]
                at, lowest = at[going], lowest[going]
                every = every[: len(at)]
                if not len(at):
                    return
            source = np.minimum(column + (column > at[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, source, axis=1)
            symbols[every, at] = self.pairs.merged[lowest]
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), width - 1), axis=1)
            length -= 1
            ranks[every, length - 1] = self.pairs.none
            right = np.flatnonzero(at < length - 1)
            ranks[right, at[right]] = self.pairs.rank(symbols[right, at[right]], symbols[right, at[right] + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs.rank(symbols[before, at[before] - 1], symbols[before, at[before]])

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same for one long fragment, in n log n."""
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        heap = [(r, k) for k, pair in enumerate(zip(parts, parts[1:])) if (r := self.rank.get(pair)) is not None]
        heapq.heapify(heap)
        merged = self.pairs.merged.tolist()
        while heap:
            rank, k = heapq.heappop(heap)
            follower = after[k]
            if parts[k] < 0 or follower < 0 or self.rank.get((parts[k], parts[follower])) != rank:
                continue
            parts[k], parts[follower] = merged[rank], -1
            after[k] = after[follower]
            if after[k] >= 0:
                before[after[k]] = k
            for first in (before[k], k):
                if first >= 0 and after[first] >= 0 and (r := self.rank.get((parts[first], parts[after[first]]))) is not None:
                    heapq.heappush(heap, (r, first))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        """The words of a stretch without special strings."""
        if text.isascii():
            return self.latin_word.findall(text.lower())
        lower = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not _BEYOND_LATIN.search(lower):
            return self.latin_word.findall(lower)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            normal = self.library.normalizer.normalize_str(text)
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return self.word.findall(lower)

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, in decimal, joined by one space."""
        split = [self._stretches(t) for t in texts]
        new = self.memory.missing({w for stretches in split for kind, s in stretches if not kind for w in s})
        if new:
            self.memory.young.update(zip(new, self._encode_words(new)))
        known = self.memory.young.__getitem__
        return [" ".join([" ".join(map(known, s)) if not kind else s for kind, s in stretches if s]) for stretches in split]

    def _stretches(self, text: str) -> list[tuple[bool, list[str] | str]]:
        """Lists of words, and between them the ids of special tokens."""
        if self.specials is None or not self.specials.search(text):
            return [(False, self.words(text))]
        parts = enumerate(self.specials.split(text))
        return [(True, self.special[p]) if k % 2 else (False, self.words(p)) for k, p in parts]

    def decode(self, ids: str) -> str:
        """The text of ids written as ``encode`` writes them: tokens, joined by one space."""
        return " ".join(map(self.token_text.__getitem__, ids.split(" "))) if ids else ""


def codec(text: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return held("codec", hashlib.sha256(text.encode()).hexdigest(), lambda: Codec(text))


def read_rules(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        text = file.read(MODEL_BYTES + 1)
    if len(text) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} characters")
    return text


def encode_decode(docs: DataFrame, rules_path: str, keep: list[str], text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """The columns ``keep`` of every row, its tokens, and any of these outputs:

    ``ids`` (decimal ids joined by one space), ``decoded`` (the text of the ids),
    ``ids_sha256`` and ``decoded_sha256`` (lowercase hex). ``n_tokens`` always.

    Encoded without begin and end tokens; a special token's string inside a text is that
    token. A null or empty text has no tokens and decodes to the empty text. Rows are
    independent: repeated rows are repeated results, an empty table gives none. Columns
    named like the results must not be in ``keep``. The vocabulary file is read on the
    driver and sent to the executors.
    """
    rules = docs.sparkSession.sparkContext.broadcast(read_rules(rules_path))
    results = [T.StructField("n_tokens", T.LongType()), *(T.StructField(o, T.StringType()) for o in outputs)]
    schema = T.StructType([*(docs.schema[c] for c in keep), *results])

    decodes = any(o.startswith("decoded") for o in outputs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rules.value)
        for batch in batches:
            column = pc.fill_null(batch.column(text), "")
            for first, last in textbytes.row_chunks(textbytes.column_bytes(column)[1], STRETCH_BYTES):
                ids = own.encode(column.slice(first, last - first).to_pylist())
                found = {"n_tokens": pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64())}
                for whole, name in ((ids, "ids"), ([own.decode(i) for i in ids] if decodes else [], "decoded")):
                    found[name] = pa.array(whole, pa.string())
                    found[f"{name}_sha256"] = pa.array([hashlib.sha256(w.encode()).hexdigest() for w in whole], pa.string())
                rows = batch.slice(first, last - first)
                columns = [*(rows.column(c) for c in keep), *(found[name] for name in ("n_tokens", *outputs))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", *outputs])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(task, "codec"), schema)
