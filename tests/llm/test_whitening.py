import numpy as np
import pytest

from reqsieve.llm import queries, whitening

FIELDS = "vec_id long, embedding array<double>"


def brute(rows, most=4):
    """(id, component) -> (n, deviation, whitened, explained), by a library's eigenvectors."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fitted = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, mean, sums = len(fitted), fitted.mean(axis=0), [int(s) for s in fitted.sum(axis=0)]
    matrix = (fitted - mean).T @ (fitted - mean) / n
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = []
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(min(most, int((values > 1e-9 * values[0]).sum()))):
            found.append((i, k + 1, n, deviation, float((np.array(x) - mean) @ vectors[:, k] / np.sqrt(values[k])), values[k] / np.trace(matrix)))
    return found


def agree(got, expected, near=1e-7):
    order = lambda r: (r[0] is not None, r[0], r[1])
    got, expected = sorted((tuple(r) for r in got), key=order), sorted(expected, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    for k in {r[1] for r in expected}:
        ours, theirs = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, expected))
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < near  # either sign, one for all
    assert np.allclose([r[5] for r in got], [r[5] for r in expected], rtol=1e-7)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-6


def test_brute_force_with_copies_and_odd_vectors(spark):
    draw = np.random.default_rng(2)
    shape = draw.normal(size=(6, 6))
    rows = [(k, [float(x) for x in shape @ (draw.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2])]) for k in range(300)]
    rows += [(300 + k, v) for k, (_, v) in enumerate(rows[:100])] + [rows[0], (None, rows[1][1])]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("-inf")] * 6), (904, [1e300] * 6)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows + odd], FIELDS + ", component string").repartition(5)
    agree(whitening.whiten(vectors).collect(), brute(rows))


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    agree(queries.op11_embedding_whitening(spark, "/root/testdata/sf0.01").collect(), brute(rows))


def test_fewer_dimensions_than_components(spark):
    rows = [(k, [k * 1.5, 10.0 - k * k, 3.0]) for k in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, FIELDS)).collect()
    agree(found, brute(rows))
    assert {r.component for r in found} == {1, 2}


def test_deviation_beyond_a_long(spark):
    rows = [(k, [float(k) * 1e9, 1.0]) for k in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, FIELDS)).collect()
    assert {r.vec_id for r in found} == set(range(30)) and {r.component for r in found} == {1}
    for r in found:
        exact = (30 * 256 * 10**9 * r.vec_id - 256 * 10**9 * 435) ** 2
        assert r.deviation == (exact if exact < 1 << 63 else None)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 2.0]), (2, [0.5, 2.0])]])
def test_nothing_varies(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, FIELDS))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_lengths_differ(spark):
    with pytest.raises(ValueError, match="from 1 to 2"):
        whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5])], FIELDS))


def test_factor_and_rotations():
    draw = np.random.default_rng(5)
    for rank, size in ((7, 7), (3, 8), (1, 2)):
        half = draw.normal(size=(size, rank)) * 10.0 ** np.arange(rank)
        matrix = half @ half.T
        factor = whitening.pivoted_cholesky(matrix)
        assert factor.shape[1] <= size and np.allclose(factor @ factor.T, matrix, rtol=1e-12, atol=1e-12 * matrix.max())
        values, vectors = whitening.one_sided_jacobi(factor)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.allclose(vectors * values @ vectors.T, matrix, rtol=1e-10, atol=1e-12 * matrix.max())
        assert (np.diff(values) <= 0).all()
