import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from reqsieve.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for id, text in docs:
        own, hit, found = words(text), set(), {}
        for item, passage in items:
            theirs = words(passage)
            size = min(window, len(theirs))
            for k in range(len(theirs) - size + 1 if size else 0):
                for p in range(len(own) - size + 1):
                    if own[p : p + size] == theirs[k : k + size]:
                        hit.update(range(p, p + size))
                        run = size
                        # windows on one diagonal
                        while size == window and p + run < len(own) and k + run < len(theirs) and own[p + run] == theirs[k + run]:
                            run += 1
                        before = found.get(item, (0, 0))
                        found[item] = max(before, (run, -p))
        out.append((id, len(own), len(hit), sorted((i, r, -p) for i, (r, p) in found.items())))
    return sorted(out, key=repr)


def corpus():
    draw = np.random.default_rng(5)
    vocabulary = ["the", "of", "and", "été", "9", "日本", *[f"w{k}" for k in range(30)]]
    sentence = lambda n: " ".join(draw.choice(vocabulary, n))
    items = [(k, sentence(n)) for k, n in enumerate([30, 25, 12, 10, 10, 9, 4, 1, 15, 40])]
    items += [(20, "the " * 14), (21, None), (22, ""), (23, " ... "), (24, items[0][1]), (25, items[1][1].split()[0] + "!" + " ".join(items[1][1].split()[1:]))]
    docs = [(k, sentence(int(draw.integers(0, 80)))) for k in range(30)]
    for k in range(40):
        passage = items[k % 10][1].split()
        part = passage[k % 5 : k % 5 + 10 + k % 13]
        docs.append((100 + k, sentence(k % 7) + " " + ", ".join(part).upper() + " " + sentence(3)))
    docs += [(200, None), (201, ""), (202, "the " * 30), (203, items[9][1]), (203, items[9][1]), (None, items[2][1]), (204, "w1 w2 " * 3000)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [4 << 20, 60])
def test_brute_force(spark, block_bytes):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_hit string").repartition(3)
    benchmark = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    found = decontaminate.find_matches(frame, benchmark, ["doc_id"], block_bytes=block_bytes).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, sorted((m.item_id, m.words, m.doc_word) for m in r.matches)) for r in found]
    expected = brute(docs, items)
    assert sorted((g[:3] for g in got), key=repr) == sorted((e[:3] for e in expected), key=repr)
    assert sorted(got, key=repr) == expected


def test_removal_keeps_the_other_rows_as_they_are(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, k, b"\x00") for k, d in enumerate(docs)], "doc_id long, text string, n_hit long, matches binary")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.decontaminate(frame, benchmark)
    assert left.schema == frame.schema
    clean = {(d, t) for (d, t), e in zip(docs, [brute([d], items)[0] for d in docs]) if not e[2]}
    assert sorted((r.doc_id or -1, r.text) for r in left.collect() if r.text) == sorted((d or -1, t) for d, t in clean if t)
    assert left.filter("text IS NULL").count() == 1


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, "?!")]])
def test_nothing_to_find(spark, items):
    frame = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_matches(frame, benchmark, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.matches) for r in found) == [(1, 3, 0, []), (2, 0, 0, [])]
    assert decontaminate.find_matches(frame.limit(0), benchmark, ["doc_id"]).count() == 0


def test_text_items_ids_and_many_distinct_words(spark):
    passage = " ".join(f"u{k}" for k in range(70_000))
    benchmark = spark.createDataFrame([("a", passage)], "item_id string, text string")
    frame = spark.createDataFrame([(1, "x " + " ".join(f"u{k}" for k in range(69_980, 70_000)))], "doc_id long, text string")
    found = decontaminate.find_matches(frame, benchmark, ["doc_id"]).first()
    assert (found.n_hit, [tuple(m) for m in found.matches]) == (20, [("a", 20, 1, 69_980)])


def test_a_batch_is_searched_in_little_memory():
    """What a task takes does not grow with its batch, which may be 1,000 rows of any length."""
    draw = np.random.default_rng(5)
    words = np.array([f"word{k}" for k in range(3000)])
    texts = [" ".join(words[draw.integers(0, 3000, 500)]) for _ in range(1200)]
    items = pa.table({"item_id": [1, 2], "text": [" ".join(texts[7].split()[20:60]), " ".join(words)]})
    index = decontaminate.build_index(items)
    column = pa.array(texts)
    assert column.nbytes > 4 << 20
    tracemalloc.start()
    hit = [first + int(r) for first, _, _, found in decontaminate._searched([index], column) for r in found[0].row]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit == [7] and peak < 64 << 20
