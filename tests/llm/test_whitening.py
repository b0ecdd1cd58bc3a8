"""Whitening against a dense decomposition, on ordinary and awkward tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import whitening
from corpusloom.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string"


def rows_of(matrix, ids=None):
    return [(int(i), [float(v) for v in r], 1, 5, "z") for i, r in zip(range(len(matrix)) if ids is None else ids, matrix)]


def dense(vectors, k=32):
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r] for r in np.asarray(vectors, dtype=np.float32).astype(float)], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    far = n * x - sums
    c = (far / n).astype(float)
    values, directions = np.linalg.eigh(c.T @ c / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(k, int((values > 1e-11 * values[0]).sum()))
    return n, [int((f * f).sum()) for f in far], values[:k] / values.sum(), c @ directions[:, :k] / np.sqrt(values[:k])


@pytest.mark.parametrize("n,d,k", [(300, 64, 32), (200, 12, 32), (90, 100, 8)])
def test_equals_a_dense_decomposition(spark, n, d, k):
    rng = np.random.default_rng(n)
    vectors = (rng.standard_normal((n, d)) * np.linspace(1, 2, d)).astype(np.float32)
    got = whiten(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3), k).toPandas().sort_values(["vec_id", "component"])
    count, deviation, explained, whitened = dense(vectors, k)
    k = whitened.shape[1]
    assert len(got) == n * k and set(got.n) == {count}
    assert got.deviation.tolist() == [v for v in deviation for _ in range(k)]
    np.testing.assert_allclose(got.explained.values[:k], explained, rtol=1e-9)
    mine = got.whitened.values.reshape(n, k)
    signs = np.sign((mine * whitened).sum(axis=0))
    np.testing.assert_allclose(mine, whitened * signs, atol=1e-6)
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


def test_dropped_vectors_repeated_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((50, 6)).astype(np.float32)
    rows = rows_of(vectors) + rows_of(vectors[:4]) + [(None, [0.5] * 6, 1, 5, "z")]
    bad = [(100, None, 1, 5, "z"), (101, [1.0] * 5 + [None], 1, 5, "z"), (102, [1.0] * 5 + [float("nan")], 1, 5, "z"), (103, [float("inf")] * 6, 1, 5, "z"), (104, [], 1, 5, "z"), (105, [1.0] * 7, 1, 5, "z")]
    got = whiten(spark.createDataFrame(rows + bad, SCHEMA))
    ids = [r.vec_id for r in got.where("component = 1").collect()]
    assert sorted(ids, key=lambda v: (v is None, v or 0)) == sorted([*range(50), *range(4)]) + [None]
    assert got.where("n <> 55").count() == 0
    twice = got.where("vec_id = 1 and component = 2").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_tables_without_variance_have_no_rows(spark):
    for rows in ([], [(1, None, 1, 1, "")], rows_of(np.ones((1, 4))), rows_of(np.ones((9, 4)))):
        out = whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rank_below_the_components(spark):
    rng = np.random.default_rng(5)
    vectors = (np.round(3 * rng.standard_normal((80, 2))) @ np.array([[1, 2, 0, 4] * 20, [0, 1, 3, 1] * 20])).astype(np.float32)
    got = whiten(spark.createDataFrame(rows_of(vectors), SCHEMA)).agg(F.max("component"), F.max("identity_error")).first()
    assert got[0] == 2 and got[1] < 1e-9


def test_entries_and_deviations_beyond_a_long_are_refused(spark):
    with pytest.raises(Exception, match="exceeds a long"):
        whiten(spark.createDataFrame(rows_of([[1e30, 1.0], [1.0, 2.0]]), SCHEMA)).collect()
    with pytest.raises(Exception, match="exceeds a long"):
        whiten(spark.createDataFrame(rows_of([[1e8, 1.0], [-1e8, 2.0], [1.0, 3.0]]), SCHEMA)).collect()


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**20, 1.0], [-(2.0**20), 2.0], [3.0, 2.0**19]]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows_of(vectors), SCHEMA)).collect()}
    assert [got[i] for i in range(3)] == dense(vectors)[1]


def test_many_tasks_are_added_in_two_levels(spark):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((140, 5)).astype(np.float32)
    x = spark.createDataFrame([(i, np.floor(64 * r.astype(float)).astype(np.int64).tobytes()) for i, r in enumerate(vectors)], "vec_id long, x binary").repartition(70)
    y = np.floor(64 * vectors.astype(float))
    sums = y.sum(axis=0).astype(np.int64)
    block = rng.standard_normal((5, 2))
    from functools import partial

    got = whitening._summed(x, partial(whitening._product, d=5, n=140, sums=sums, block=block), (5, 2))
    np.testing.assert_allclose(got, np.cov(y.T, bias=True) @ block, rtol=1e-10)
    parts = whitening._text_parts(x, 5)
    assert len(parts) <= 8 and sum(int(p.split()[0]) for p in parts) == 140
