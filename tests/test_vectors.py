"""Exact vector search: the same rows as all comparisons, with fewer of them."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from factloom.operators import vectors

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, queries, k, by_label):
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = lambda v: (u := np.array(v, float) / max(map(abs, v))) / np.sqrt((u * u).sum())
    held = [(i, unit(v), g) for i, v, g in rows if fine(v) and i is not None]
    out = []
    for i, v, g in queries:
        if fine(v):
            near = sorted((-round(float((unit(v) * x).sum()), 9), j) for j, x, h in held if j != i and len(x) == len(v) and (not by_label or g is not None and g == h))
            out += [(i, j, -c, n + 1) for n, (c, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "by_label"), [(4096, True), (7, True), (64, False)])
def test_search_equals_all_comparisons(spark, monkeypatch, chunk, by_label):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(12, 8))
    v = centres[rng.integers(0, 12, 400)] + 0.15 * rng.normal(size=(400, 8))
    rows = [(i, (x * (1e-180 if i == 3 else 1e150 if i == 4 else 1)).tolist(), "abc"[i % 3] if i % 50 else None) for i, x in enumerate(v)]
    rows += [(500, None, "a"), (501, [0.0] * 8, "a"), (502, [float("nan")] * 8, "a"), (503, [], "a"), (504, [1.0, None], "a"), (505, [1.0, 2.0], "a"), (506, [2.0, 4.0], "a"), (None, v[0].tolist(), "a"), (507, v[1].tolist(), "b"), (508, v[1].tolist(), "b")]
    queries = [r for r in rows if r[0] is not None and r[0] % 5 == 0 or r[0] in (3, 4, 501, 506)]
    t = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame(queries, SCHEMA).withColumnRenamed("vec_id", "query_id")
    got = vectors.vector_top_k(t, q, 4, "label" if by_label else None, pivots=8)
    assert sorted((r.query_id, r.vec_id, round(r.cosine, 9), r.rank) for r in got.collect()) == [(i, j, pytest.approx(c, abs=2e-9), n) for i, j, c, n in brute(rows, queries, 4, by_label)]


def test_most_comparisons_are_ruled_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 16))
    t = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], SCHEMA)
    counter = spark.sparkContext.accumulator(0)
    q = t.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    assert vectors.vector_top_k(t, q, 5, "label", counter=counter).count() == 150 * 5
    assert 150 * 5 < counter.value < 0.25 * 150 * 2999


def test_search_of_nothing(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0], "a")], SCHEMA)
    q = t.withColumnRenamed("vec_id", "query_id")
    assert vectors.vector_top_k(t.limit(0), q).collect() == [] and vectors.vector_top_k(t, q.limit(0)).collect() == []
    assert vectors.vector_top_k(t, q).collect() == []


def test_many_queries_take_bounded_memory():
    rng = np.random.default_rng(3)
    unit = lambda n: (x := rng.normal(size=(n, 8))) / np.sqrt((x * x).sum(1, keepdims=True))
    x, q, pivots = unit(4096), unit(3000), unit(64)
    tracemalloc.start()
    try:
        found = sum(1 for _ in vectors._best(np.arange(4096), x, list(range(10_000, 13_000)), q, 5))
        best = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        flat = pa.ListArray.from_arrays(np.arange(0, q.size + 1, 8, dtype=np.int32), pa.array(q.ravel()))
        asked = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["a"] * 3000), pa.array([8] * 3000, pa.int32()), flat, pa.array([2.1] * 3000)], names=["id", "grp", "dim", "v", "bound"])
        rows = [b.num_rows for b in vectors._within(asked, pivots)]
        within = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 15_000 and sum(rows) == 3000 * 64 * 16 and max(rows) <= vectors.GIVEN  # all queries at once took 98 MB and 25 MB an array
    assert best < 20e6 and within < 20e6
