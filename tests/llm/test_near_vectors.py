import numpy as np
import pytest

from oriscope.llm import nn_descent


@pytest.mark.parametrize("noise", [1e-5, 1e-3])
def test_near_copies_keep_their_nearest(spark, noise):
    """A cluster of 2,000 near copies, and 400 other vectors."""
    r = np.random.default_rng(3)
    x = np.r_[r.standard_normal(16) + noise * r.standard_normal((2000, 16)), r.standard_normal((400, 16))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in nn_descent.nearest_neighbours(table, every=50, k=5).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    right = 0
    queries = range(0, 2000, 50)
    for q in queries:
        far = ((unit - unit[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        right += len(got[q] & set(np.argsort(far)[:5].tolist()))
    assert right >= 0.95 * 5 * len(queries), right


def nearest(x, q, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = ((unit - unit[q]) ** 2).sum(axis=1)
    far[q] = np.inf
    return set(np.argsort(far)[:k].tolist())


def test_hubs_are_met_by_all(spark):
    """Few vectors near the middle of all others are neighbours of hundreds each."""
    r = np.random.default_rng(8)
    x = np.r_[np.ones(48) + 0.05 * r.standard_normal((20, 48)), np.ones(48) + r.standard_normal((3000, 48))]
    x = x[r.permutation(len(x))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -1)
    assert np.bincount(np.argsort(-sim, axis=1)[:, :32].ravel()).max() > 96  # in-links of the greatest hub
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in nn_descent.nearest_neighbours(table, every=50, k=5).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    right = sum(len(got[q] & nearest(x, q)) for q in got)
    assert right >= 0.95 * 5 * len(got), right


def test_great_and_tiny_components(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((60, 8)) * np.array([1e200, 1.0, 1e-200])[np.arange(60) % 3][:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0] * 7)], "vec_id long, embedding array<double>")
    rows = nn_descent.nearest_neighbours(table, every=20, k=5).collect()
    y = x / np.abs(x).max(axis=1, keepdims=True)
    for q in (0, 20, 40):
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert {r.vec_id for r in mine} == nearest(y, q)
        for row in mine:
            a, b = y[q], y[row.vec_id]
            assert row.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    assert not {900} & {r.vec_id for r in rows}  # another length than the others


def test_small_tables_are_searched_by_the_graph(spark, monkeypatch):
    """With one starting point, and far fewer nodes kept than there are, recall comes from the graph."""
    monkeypatch.setattr(nn_descent, "ENTRIES", 1)
    r = np.random.default_rng(21)
    x = r.standard_normal((900, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in nn_descent.nearest_neighbours(table, every=30, k=5, width=40).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    right = sum(len(got[q] & nearest(x, q)) for q in got)
    assert len(got) == 30 and right >= 0.95 * 5 * len(got), right
