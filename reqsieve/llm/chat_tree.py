r"""Chat formatting into prefix trees.

Conversations that begin with the same turns share these turns' text: a pack is a prefix
tree written depth first, each node (a turn in its place) once, with the position its first
character has in its conversation and the stretches of the pack it may attend to, its
ancestors and itself. A conversation is a leaf; the stretches of its leaf, joined, are
its formatted text.

Distinct conversations are sorted by their turns over all executors, so neighbours share
the longest beginnings and each only adds the turns its predecessor lacks. A pack holds
some ``PACK_CHARS`` characters; shared turns that reach over its end are written again at
the next one's begin, since a pack attends to itself alone. A beginning that a third of all
conversations share is so many short copies, never one task's whole work.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts a control
string gets a backslash before its first bar, and one more if it has some already; in roles a
line feed is ``\n`` and a backslash ``\\``. Both are undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.session import split_hot_keys

PACK_CHARS = 1 << 19
#: Turns of one task's worth of sorted conversations, about.
TASK_CONVERSATIONS = 20_000

# The template.
START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(im_(?:start|end)\|>)")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_(?:start|end)\|>)")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

PACK_SCHEMA = (
    "stream string, "
    "nodes array<struct<parent:int, start:int, stop:int, position:int, loss_start:int, loss_stop:int, attends:array<struct<start:int, stop:int>>>>, "
    "leaves array<struct<key:binary, node:int>>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the stretch of it that is learned (none unless the role is assistant)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    learned = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{END}\n", *learned


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def conversation_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns, key, path)`` of rows ``(conv_id, turn, role, text)``.

    ``turns`` are sorted by turn (null first), then role and text; ``path`` has a hash of
    each, ``key`` one of all. A null role or text is empty. Repeated rows are repeated
    turns. A row without a conversation id is a conversation of its own.
    """
    named = rows.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(
            F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
        ).alias("one"),
    )
    grouped = named.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("one")).alias("sorted"))
    turns = grouped.select("conv_id", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return turns.withColumns(
        {
            "key": F.unhex(F.md5(F.to_json("turns").cast("binary"))),
            "path": F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])),
        }
    )


class _Pack:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.turns: list[tuple[str, str]] = []  # of the last conversation
        self.chain: list[int] = []  # and its nodes

    def add(self, key: bytes, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.turns)) and turns[shared] == self.turns[shared]:
            shared += 1
        del self.chain[shared:]
        for role, text in turns[shared:]:
            written, loss_start, loss_stop = format_turn(role, text)
            parent = self.nodes[self.chain[-1]] if self.chain else None
            start, stop = self.size, self.size + len(written)
            attends = list(parent["attends"]) if parent else []
            if attends and attends[-1]["stop"] == start:
                attends[-1] = {"start": attends[-1]["start"], "stop": stop}
            else:
                attends.append({"start": start, "stop": stop})
            position = parent["position"] + parent["stop"] - parent["start"] if parent else 0
            node = {"parent": self.chain[-1] if self.chain else -1, "start": start, "stop": stop, "position": position}
            self.nodes.append(node | {"loss_start": start + loss_start, "loss_stop": start + loss_stop, "attends": attends})
            self.chain.append(len(self.nodes) - 1)
            self.parts.append(written)
            self.size = stop
        self.turns = turns
        self.leaves.append({"key": key, "node": self.chain[-1] if self.chain else -1})

    def row(self) -> dict:
        return {"stream": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


def _arrow_type(nodes: bool) -> pa.DataType:
    stretch = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    whole = [(c, pa.int32()) for c in ("parent", "start", "stop", "position", "loss_start", "loss_stop")]
    return pa.list_(pa.struct([*whole, ("attends", stretch)] if nodes else [("key", pa.binary()), ("node", pa.int32())]))


_PACK_ARROW = pa.schema([("stream", pa.string()), ("nodes", _arrow_type(True)), ("leaves", _arrow_type(False))])


def pack_conversations(conversations: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """Packs of the distinct conversations of ``conversation_turns``: see the module's head.

    Columns: ``stream`` (the text), ``nodes`` (``parent`` or -1, stretch ``start`` to ``stop``
    in the stream, ``position`` of its first character in a conversation, the stretch
    under the loss mask, empty if none, and the stretches it ``attends`` to) and
    ``leaves`` (``key`` of a conversation and its last node). Positions are code points.
    """
    # any order that is one of the turns' beginnings will do: hashes are shorter than texts
    distinct = conversations.groupBy("key").agg(F.any_value("path").alias("path"), F.any_value("turns").alias("turns"))
    tasks = max(1, -(-conversations.count() // TASK_CONVERSATIONS), int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = distinct.repartitionByRange(tasks, "path", "key").sortWithinPartitions("path", "key").select("key", "turns")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Pack()
        for batch in batches:
            for key, turns in zip(batch.column("key"), batch.column("turns")):
                pack.add(key.as_py(), [(t["role"], t["text"]) for t in turns.as_py()])
                if pack.size >= pack_chars:
                    yield pa.RecordBatch.from_pylist([pack.row()], _PACK_ARROW)
                    pack = _Pack()
        if pack.leaves:
            yield pa.RecordBatch.from_pylist([pack.row()], _PACK_ARROW)

    return ordered.mapInArrow(task, PACK_SCHEMA)


def read_leaf(stream: str, nodes: list[dict], node: int) -> tuple[str, str]:
    """The formatted text of the conversation that ends at a node, and its learned text."""
    if node < 0:
        return "", ""
    formatted = "".join(stream[s["start"] : s["stop"]] for s in nodes[node]["attends"])
    learned = []
    while node >= 0:
        learned.append(unescape(stream[nodes[node]["loss_start"] : nodes[node]["loss_stop"]]))
        node = nodes[node]["parent"]
    return formatted, "".join(reversed(learned))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def read_back(packs: DataFrame) -> DataFrame:
    """Of each leaf, read from its pack: ``key``, ``n_turns``, ``turns_sha256`` (role, line feed,
    text, line feed of each turn), ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                pack, rows = batch.slice(k, 1).to_pylist()[0], []
                for leaf in pack["leaves"]:
                    formatted, learned = read_leaf(pack["stream"], pack["nodes"], leaf["node"])
                    turns = parse(formatted)
                    whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                    rows.append((leaf["key"], len(turns), _sha256(whole), len(learned), _sha256(learned), len(formatted)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return packs.mapInArrow(task, "key binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(rows: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """What ``read_back`` finds, for every conversation: ``conv_id`` and the columns there.

    An empty table gives no rows; columns other than the four used play no part.
    """
    split_hot_keys(rows.sparkSession)
    turns = conversation_turns(rows)
    found = read_back(pack_conversations(turns, pack_chars))
    return turns.select("conv_id", "key").join(found, "key").drop("key")
