import numpy as np
import pytest
from pyspark.sql import functions as F

from reqsieve.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rank string"


def brute(rows, every, k, scale=256):
    usable = []
    for id, vector, _ in rows:
        if id is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        usable.append((id, tuple(int(np.floor(scale * x)) for x in vector)))
    out = []
    for id, vector in set(q for q in usable if q[0] % every == 0):
        scores = [(-sum(a * b for a, b in zip(vector, v)), i) for i, v in usable if i != id and len(v) == len(vector)]
        out += [(id, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, every=5, k=3, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = topk.top_k(frame, F.col("vec_id") % every == 0, k, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def test_brute_force_with_ties_and_many_blocks(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.integers(-2, 3, 6).astype(float).tolist(), "x") for i in range(120)]
    expected = brute(rows, 5, 3)
    assert run(spark, rows) == expected
    assert run(spark, rows, shard_rows=17, block_rows=4) == expected


def test_rows_that_take_no_part(spark):
    rows = [
        (0, [0.5, 0.25], None), (5, [-0.5, 1.0], None), (1, None, None), (2, [None, 1.0], None), (3, [float("nan"), 1.0], None),
        (4, [float("inf"), 1.0], None), (None, [9.0, 9.0], None), (6, [1.0, 1.0], None), (7, [1.0, 1.0, 1.0], None),
        (8, [], None), (10, [], None), (9, [1.0, 1.0], None), (9, [1.0, 1.0], None), (5, [-0.5, 1.0], "again"), (15, [0.0, 0.0], None),
    ]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**30 + i, 3.0 * i], None) for i in range(12)]
    assert run(spark, rows, scale=1) == brute(rows, 5, 3, 1)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], None)]) == []


def test_it_stops_before_the_lists_end():
    draw = np.random.default_rng(2)
    vectors = np.floor(draw.exponential(4.0, (4000, 3)) * 16)
    lists = topk.Lists(np.arange(4000), vectors)
    looked_up = []
    lists.vectors = type("Seen", (np.ndarray,), {"__getitem__": lambda s, i: looked_up.append(np.size(i)) or np.asarray(s)[i]})(
        vectors.shape, vectors.dtype, vectors.tobytes()
    )
    query = np.array([40.0, 3.0, 1.0])
    ids, scores = lists.top(query, -1, 5)
    order = np.lexsort([np.arange(4000), -(vectors @ query)])[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == (vectors @ query)[order].tolist()
    assert sum(looked_up) < 2000


@pytest.mark.parametrize("query", [[0.0, 0.0, 0.0], [-1.0, 0.0, 2.0], [-3.0, -1.0, -1.0]])
def test_signs(query):
    vectors = np.random.default_rng(3).integers(-9, 9, (50, 3)).astype(float)
    ids, _ = topk.Lists(np.arange(50), vectors).top(np.array(query), 7, 50)
    scores = vectors @ np.array(query)
    assert ids.tolist() == [i for i in np.lexsort([np.arange(50), -scores]) if i != 7]
