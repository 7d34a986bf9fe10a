"""Charts on cut series against plain sequential loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantscope.functions import constants as K
from plantscope.operators import anomalies as an
from plantscope.operators import control_charts as cc


@pytest.fixture(scope="module")
def series(spark):
    """Two series, one much longer, with shifts, trends, zigzags and flat stretches."""
    rng = np.random.default_rng(5)
    long = np.concatenate([
        rng.normal(10, 1, 120), rng.normal(11.5, 1, 60), np.linspace(8, 13, 12), 10 + 0.4 * (-1.0) ** np.arange(30),
        rng.normal(10, 0.2, 40), rng.normal(9, 1.2, 60),
    ])
    rows = [("a", i, float(v)) for i, v in enumerate(long)] + [("b", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 25))]
    return spark.createDataFrame(rows, "k string, i int, v double").repartition(5)


def values(series):
    pdf = series.toPandas().sort_values(["k", "i"])
    return {k: g.v.to_numpy() for k, g in pdf.groupby("k")}


def loop_rules(x, center, sigma):
    """Sequential reading of the seven rules."""
    z, hits = (x - center) / sigma, set()
    d = np.diff(x)
    hits |= {(1, i) for i in range(len(x)) if abs(z[i]) > 3}
    for i in range(2, len(x)):
        if (z[i - 2 : i + 1] > 2).sum() >= 2 or (z[i - 2 : i + 1] < -2).sum() >= 2:
            hits.add((2, i))
            break
    for i in range(4, len(x)):
        if (z[i - 4 : i + 1] > 1).sum() >= 4 or (z[i - 4 : i + 1] < -1).sum() >= 4:
            hits.add((3, i))

    def runs(rule, flags, offset, length):
        run = 0
        for i, f in enumerate(flags):
            run = run + 1 if f else 0
            if run == length:
                hits.add((rule, i + offset))

    runs(4, z > 0, 0, 8)
    runs(4, z < 0, 0, 8)
    runs(5, d > 0, 1, 5)
    runs(5, d < 0, 1, 5)
    runs(6, (z > -1) & (z < 1), 0, 15)
    runs(7, d[1:] * d[:-1] < 0, 2, 12)
    return hits


@pytest.mark.parametrize("size", [30, 10_000])
def test_run_rules(series, size):
    scan = cc.chart_scan(series, "v", ["i"], ["k"], size)
    got = cc.run_rule_hits(scan, cc.individuals_limits(scan)).toPandas()
    number = {v: k for k, v in K.RULES.items()}
    for k, x in values(series).items():
        sigma = np.abs(np.diff(x)).mean() / 1.128
        mine = {(number[r], i) for r, i in got[got.k == k][["rule", "i"]].itertuples(index=False)}
        assert mine == loop_rules(x, x.mean(), sigma)
    assert set(got.rule) == set(K.RULES.values())


@pytest.mark.parametrize("size", [15, 10_000])
def test_ewma_and_cusum(series, size):
    scan = cc.chart_scan(series, "v", ["i"], ["k"], size)
    ewma = cc.ewma_points(scan).toPandas().sort_values(["k", "i"])
    cusum = cc.cusum_points(scan).toPandas().sort_values(["k", "i"])
    for k, x in values(series).items():
        m, s = x.mean(), x.std(ddof=1)
        z, up, down = [m], [0.0], [0.0]
        for v in x[1:]:
            z.append(0.2 * v + 0.8 * z[-1])
            up.append(max(0.0, up[-1] + (v - m) / s - 0.5))
            down.append(max(0.0, down[-1] - (v - m) / s - 0.5))
        np.testing.assert_allclose(ewma[ewma.k == k].z, z, atol=1e-10)
        np.testing.assert_allclose(cusum[cusum.k == k].c_plus, up, atol=1e-10)
        np.testing.assert_allclose(cusum[cusum.k == k].c_minus, down, atol=1e-10)


def test_limits_survive_repartitioning_and_split(series):
    frames = []
    for size, parts in ((10_000, 1), (20, 7)):
        scan = cc.chart_scan(series.repartition(parts), "v", ["i"], ["k"], size)
        frames.append(cc.individuals_limits(scan).toPandas().sort_values("k").reset_index(drop=True))
    pd.testing.assert_frame_equal(*frames, rtol=1e-12)


def test_hand_computed_chart(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 3.0, 2.0, 6.0])], "i int, v double")
    row = cc.individuals_limits(cc.chart_scan(df, "v", ["i"])).first()
    assert row.center == 3.0 and row.mr_bar == pytest.approx(7 / 3)
    assert row.ucl == pytest.approx(3 + 3 * (7 / 3) / 1.128)
    assert row.mr_ucl == pytest.approx(3.267 * 7 / 3)


def test_subgroups_drop_the_tail_and_reject_sizes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "i int, v double")
    scan = cc.chart_scan(df, "v", ["i"], rows_per_bucket=3)
    assert [r["mean"] for r in cc.subgroups(scan, 5).orderBy("subgroup").collect()] == [2.0, 7.0]
    with pytest.raises(ValueError):
        cc.subgroups(scan, 11)


def test_flat_series_has_no_signals(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(30)], "i int, v double")
    scan = cc.chart_scan(df, "v", ["i"])
    assert cc.run_rule_hits(scan, cc.individuals_limits(scan)).count() == 0
    assert cc.change_points(scan).count() == 0
    assert cc.zscore_outliers(df, "v").count() == 0
    cap = cc.capability(scan, spark.createDataFrame([(0.0, 10.0)], "lsl double, usl double")).first()
    assert cap.cp is None and cap.ppk is None


def test_longest_rise_and_exceedance(spark):
    v = [5.0, 1, 2, 3, 4, 5, 6, 2, 3, 4, 5, 6, 7, 1, 9, 9, 9]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    scan = cc.chart_scan(df, "v", ["i"], rows_per_bucket=4)
    r = an.longest_rise(scan).first()
    assert (r.run_length, r.start_index, r.start_value, r.end_value) == (6, 1, 1.0, 6.0)
    e = an.exceedance_runs(scan, 4.5, lengths=20).first()
    assert (e.n_runs, e.longest, list(e.first_lengths)) == (4, 3, [1, 2, 3, 3])


def test_confidence_scale(spark):
    df = spark.createDataFrame([(0, 100), (1, 100), (50, 100)], "e int, n int")
    got = [r[0] for r in df.select(an.confidence(F.col("e"), F.col("n"))).collect()]
    assert got == pytest.approx([0.4, 0.85, 0.95])
