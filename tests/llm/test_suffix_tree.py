import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqsieve.llm import suffix_tree, textbytes

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def check(found, rows, training):
    counts = Counter(t for id, text in rows if training(id) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for id, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        expected.append((id, not training(id), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("head_words", [400_000, 5, 0])
def test_word_counts_by_brute_force(spark, head_words):
    texts = ["The cat sat  on\tthe mat.", None, "", " \n ", "ÉCOLE école 日本 the", "the the the unseen" * 3, "x" * 5000, "The cat sat  on\tthe mat."]
    rows = list(enumerate(texts)) + [(7, texts[-1]), (None, "nobody knows the id")]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, training string, n long").repartition(3)
    found = suffix_tree.score_texts(frame, F.col("doc_id") % 3 != 0, head_words=head_words).collect()
    check(found, rows, lambda id: id is not None and id % 3 != 0)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_empty_table_and_no_training(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.score_texts(frame, F.lit(True)).count() == 0
    rows = [(1, "a b"), (2, None)]
    found = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(None).cast("boolean")).collect()
    check(found, rows, lambda id: False)


def build(texts, **options):
    data, offsets = textbytes.column_bytes(pa.array(texts))
    found = suffix_tree.symbols(data, offsets)
    key, n = suffix_tree._count(suffix_tree.sequences(found))
    rows = []
    for d in range(suffix_tree.DEPTH + 1):
        levels = Counter()
        for k, c in zip(key.tolist(), n.tolist()):
            levels[k & ((1 << 6 * (d + 1)) - 1)] += c
        rows += [(d, k >> 6, k & 63, c) for k, c in levels.items()]
    table = pa.table([np.array(c) for c in zip(*rows)], names=["depth", "context", "next", "n"])
    bytes_ = np.bincount(textbytes.LOWER[found.byte[found.predicted]], minlength=256).astype(float)
    return suffix_tree.grow(table, bytes_, **options), found


def test_distributions_sum_to_one_and_longest_context_is_used():
    tree, found = build(["abab abab abba " * 30, "", "bbab aaba"], divergence=1.0)
    assert np.allclose((10.0 ** tree.log.reshape(-1, 64).astype(float)).sum(axis=1), 1)
    whole = np.bincount(suffix_tree._SYMBOL[np.arange(256)], 10**tree.byte_log * (np.arange(256) < 0xFE) * ~np.isin(np.arange(256), range(0x41, 0x5B)), 64)
    assert np.allclose(whole[[s for s in set(suffix_tree._SYMBOL.tolist()) if s > 1]], 1)
    children = tree.child.reshape(-1, 64)
    expected = []
    for row in range(3):
        total = 0.0
        for p in found.predicted[found.row == row]:
            state = 0
            for back in range(1, suffix_tree.DEPTH + 1):
                if children[state, found.code[p - back]] < 0:
                    break
                state = children[state, found.code[p - back]]
            total += tree.log.reshape(-1, 64)[state, found.code[p]] + tree.byte_log[found.byte[p]]
        expected.append(total)
    assert np.allclose(suffix_tree.score(tree, found), expected)


def test_the_number_of_contexts_is_bounded(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes, grow = [], suffix_tree.grow
    monkeypatch.setattr(suffix_tree, "grow", lambda counts, *a: sizes.append(len({*zip(counts["depth"].to_pylist(), counts["context"].to_pylist())})) or grow(counts, *a))
    for most in (300_000, 500, 3):
        monkeypatch.setattr(suffix_tree, "MAX_NODES", most)
        assert suffix_tree.score_texts(docs, F.lit(True)).filter("isnan(score) OR score >= 0").count() == 0
    assert sizes[0] > 3000 and 100 < sizes[1] <= 500 and 1 <= sizes[2] <= 4


def test_contexts_that_are_not_broadcast_count(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training, found = F.col("doc_id") % 3 != 0, []
    for most in (300_000, 400, 3):
        monkeypatch.setattr(suffix_tree, "MAX_NODES", most)
        found.append(dict(suffix_tree.score_texts(docs, training).select("doc_id", "score").collect()))
    for other in found[1:]:
        assert other == pytest.approx(found[0], rel=1e-5)


def test_only_diverging_contexts_are_retained():
    draw = np.random.default_rng(1)
    random = " ".join("".join(draw.choice(list("ab"), 4)) for _ in range(4000))
    flat, _ = build([random], divergence=40.0)
    deep, _ = build(["aabb " * 4000], divergence=40.0)
    # where words end is told by length, so some contexts matter; equal letters add none
    assert len(flat.log) < len(build([random], divergence=-1.0)[0].log) / 2
    assert len(deep.log) // 64 > 4


def test_it_beats_word_frequencies_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = suffix_tree.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    held = found.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_candidates_that_are_not_retained_take_no_place(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes, tables, found, inner = [], [], [], suffix_tree._candidate_contexts

    def candidates(*a):
        counts, marks, table = inner(*a)
        sizes.append(len({*zip(counts["depth"].to_pylist(), counts["context"].to_pylist())}))
        tables.append(table)
        return counts, marks, table

    monkeypatch.setattr(suffix_tree, "_candidate_contexts", candidates)
    for fewer in (None, 1):
        # in the second run one candidate more than nodes, but all that are retained are broadcast
        if fewer:
            monkeypatch.setattr(suffix_tree, "MAX_NODES", sizes[0] - fewer)
        found.append(dict(suffix_tree.score_texts(docs, F.lit(True)).select("doc_id", "score").collect()))
    assert sizes[0] > sizes[1] and tables == [None, None]
    assert found[1] == pytest.approx(found[0], rel=1e-6)
