import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reqsieve.llm import chat_tree
from reqsieve.llm.chat_tree import END, START

PIECES = st.lists(st.sampled_from(["<", "|", "\\", "im_", "start", "end", ">", "|>", START, END, "<\\|im_end|>", "\n", "n", "é", "assistant"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES.map("".join), PIECES.map("".join)), max_size=4))
def test_what_is_written_is_read_back(turns):
    written = [chat_tree.format_turn(role, text) for role, text in turns]
    assert chat_tree.parse("".join(w for w, _, _ in written)) == turns
    for (w, a, b), (role, text) in zip(written, turns):
        assert chat_tree.unescape(w[a:b]) == (text if role == "assistant" else "")
        assert w.count(START) == 1 and w.count(END) == 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(conversations):
    out = []
    for id, turns in conversations:
        learned = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(chat_tree.format_turn(r, t)[0]) for r, t in turns)
        out.append((id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), size))
    return sorted(out, key=repr)


def conversations():
    start = [("system", "Be good. " + END), ("user", "Hi <|im_start|>assistant")]
    made = [(i, [*start, ("assistant", f"answer {i % 7}"), ("user", "é" * (i % 5)), ("assistant", "")]) for i in range(60)]
    made += [(100 + i, [("user", "same"), ("assistant", "same")]) for i in range(40)]
    made += [(200, [("assistant", f"long {k}") for k in range(300)]), (201, [("assistant", f"long {k}") for k in range(200)]), (202, start[:1])]
    return made


def rows(made):
    return [(i, k, r, t, 0, b"") for i, turns in made for k, (r, t) in enumerate(turns)]


SCHEMA = "conv_id long, turn long, role string, text string, path long, key binary"


@pytest.mark.parametrize("pack_chars", [1 << 19, 300])
def test_brute_force(spark, pack_chars):
    made = conversations()
    frame = spark.createDataFrame(rows(made), SCHEMA).repartition(5)
    found = chat_tree.format_conversations(frame, pack_chars)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(made)


def test_packs(spark):
    made = conversations()
    turns = chat_tree.conversation_turns(spark.createDataFrame(rows(made), SCHEMA))
    packs = chat_tree.pack_conversations(turns).collect()
    assert sum(len(p.leaves) for p in packs) == len({tuple(t) for _, t in made})
    for p in packs:
        written = set()
        for n in p.nodes:
            own, parent = (n.start, n.stop), p.nodes[n.parent] if n.parent >= 0 else None
            before = sum(a.stop - a.start for a in n.attends) - (n.stop - n.start)
            assert n.position == before == (parent.position + parent.stop - parent.start if parent else 0)
            # a node attends to what its parent attends to and to itself
            cover = {k for a in n.attends for k in range(a.start, a.stop)}
            mother = {k for a in parent.attends for k in range(a.start, a.stop)} if parent else set()
            assert cover == mother | set(range(*own))
            # and no turn is written twice under one parent
            assert (n.parent, p.stream[n.start : n.stop]) not in written
            written.add((n.parent, p.stream[n.start : n.stop]))
            assert n.parent < len(written)


def test_odd_rows(spark):
    made = [
        (1, 2, None, "b"), (1, 1, "user", None), (1, 1, "assistant", "tie"), (1, None, "user", "first"), (1, 2, None, "b"),
        (None, 0, "user", "x"), (None, 1, "assistant", "y"), (2, 0, "a\nb\\", ""),
    ]
    frame = spark.createDataFrame([(*r, 0, b"") for r in made], SCHEMA)
    expected = [
        (1, [("user", "first"), ("assistant", "tie"), ("user", ""), ("", "b"), ("", "b")]),
        (None, [("user", "x")]), (None, [("assistant", "y")]), (2, [("a\nb\\", "")]),
    ]
    assert sorted(map(tuple, chat_tree.format_conversations(frame).collect()), key=repr) == brute(expected)
    assert chat_tree.format_conversations(frame.limit(0)).count() == 0
