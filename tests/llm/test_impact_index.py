"""Exact top-k against all inner products."""

import math
from collections import defaultdict

import numpy as np
import pytest

from plantscope.llm import impact_index as ix

SCHEMA = "vec_id long, embedding array<float>, score string, ids string"


def slow(rows, top=20):
    fit = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = defaultdict(list)
    for n, (i, a) in enumerate(fit):
        if i % 20 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), j) for m, (j, b) in enumerate(fit) if m != n]
            best = enumerate(sorted(scored)[:top], 1)
            out[i] += [(i, r, j, max(min(-s, ix.MOST), -ix.MOST)) for r, (s, j) in best]
    return sorted(x for rows in out.values() for x in rows)


@pytest.mark.parametrize("few,size", [(256, 4096), (3, 50), (0, 7)])
def test_top_k(spark, monkeypatch, few, size):
    monkeypatch.setattr(ix, "FEW", few)
    monkeypatch.setattr(ix, "BLOCK", size)
    monkeypatch.setattr(ix, "QUERIES", max(size // 8, 1))
    rng = np.random.default_rng(size)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, [0.0] * 16), (2020, [5.0] * 3), (-40, []), (None, rows[0][1])]
    rows += [(3000, None), (3001, [None] * 16), (3020, [float("nan")] * 16), (3040, [float("inf")] + [0.0] * 15)]
    rows += [(20, rows[20][1]), (40, rows[3][1])]
    rows += [(4000, [1000.0, -1000.0] * 8), (4020, [-0.001] * 16)]
    rows += [(5000, [5e7] + [0.1] * 15), (5001, [-5e7] * 16), (5020, [5e7, 1e30] * 8), (5021, [3e38] * 16), (5022, [2.9e38] * 16)]
    rows += [(5040, [-3e38] * 3), (5060, [131072.0] * 16), (5061, [131071.5] * 16)]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ix.digest(df).collect())
    assert got == slow(rows)


def block_of(values):
    n = len(values)
    ids = np.arange(n, dtype="<i8").tobytes()
    vectors = {"ids": ids, "numbers": ids, "vectors": ix._narrow_bytes(values), "wide": "{}", "rows": n, "width": values.shape[1]}
    return vectors | ix.postings(values)


def test_segments_lie_by_descending_impact_and_hold_every_component_once():
    values = np.random.default_rng(2).integers(-300, 300, (200, 9)).astype(np.int32)
    values[:, 4] = 0
    row = block_of(values)
    segments = ix.Segments(row, values)
    level, dim, start, end = segments.heads.T
    assert (np.diff(level) <= 0).all() and 4 not in dim and (start[1:] == end[:-1]).all()
    back = np.zeros_like(values)
    for n, d, a, b in segments.heads.tolist():
        impacts = segments.impacts[a:b].astype(int)
        assert (np.abs(impacts) >= 2 ** (n - 1)).all() and (np.abs(impacts) < 2**n).all()
        back[segments.places[a:b], d] = impacts
    assert (back == values).all()


def test_a_query_stops_before_the_last_level_and_skips_its_segments():
    rng = np.random.default_rng(0)
    values = rng.integers(-20, 20, (4000, 32)).astype(np.int32)
    values[:25] = 60
    values[25, 0], values[:, 31] = 2000, 0
    row = block_of(values)
    block, segments = ix.Vectors(row, 32), ix.Segments(row, values)
    segments.impacts = segments.impacts.copy()
    # levels of 16 and below must not be read: 2000 and 60 are the first two
    segments.impacts[segments.heads[segments.levels[2][0], 2] :] = np.nan
    q = np.full((1, 32), 60, dtype=np.int32)
    q[0, 1] = 0
    asked = block_of(q) | {"numbers": np.array([-1], dtype="<i8").tobytes()}
    (ids, scores), = ix.search_tile(segments, block, ix.Vectors(asked, 32), np.array([0]), np.array([-np.inf]))
    assert set(ids) == {25, *range(19)} and sorted(scores)[:-1] == [30 * 3600] * 19
    # one segment of the first level, 30 of the second; the one without a weight and all below are skipped
    assert segments.read == 31 and segments.read + segments.skipped == len(segments.heads)


def test_queries_of_another_table(spark):
    rows = [(i, [float(i % 7), 1.0], "x", "x") for i in range(60)]
    got = ix.top_k(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(5, [1.0, 0.0])], "vec_id long, embedding array<double>"), top=3)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(5, k + 1, j, 6 * 64 * 64) for k, j in enumerate((6, 13, 20))]


def test_rows_of_one_id_meet_each_other(spark):
    rows = [(20, [1.0], "x", "x"), (20, [2.0], "x", "x"), (20, [1.0], "x", "x")]
    got = sorted((r["rank"], r.vec_id, r.score) for r in ix.digest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 20, 8192)] * 3 + [(2, 20, 4096)] * 2 + [(2, 20, 8192)]


def test_empty_and_small(spark):
    assert ix.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    two = spark.createDataFrame([(0, [1.0], "x", "x"), (1, [1.0], "x", "x")], SCHEMA)
    assert [tuple(r) for r in ix.digest(two).collect()] == [(0, 1, 1, 4096)]
    assert ix.digest(two.where("vec_id = 1")).collect() == []
