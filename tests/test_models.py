"""Linear algebra against numpy, models by recovered coefficients, forecasts against loops."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantscope.operators import forecast as fc
from plantscope.operators import frames as fr
from plantscope.operators import governance as gv
from plantscope.operators import inference as inf
from plantscope.operators import models as md
from plantscope.operators import residuals as rs


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    a, b, c = rng.uniform(0, 10, (3, 240))
    y = 2 + 1.5 * a - 0.7 * b + 0.3 * a * b + rng.normal(0, 0.5, 240)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y))], "i long, a double, b double, c double, y double")


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(2)
    rows = [(f, g, h, float(10 + 2 * f + (g == "y") * 3 + (f == 2) * (h == "q") * 4 + rng.normal(0, 0.3))) for f, g, h in product(range(3), "xyz", "pqr")]
    return spark.createDataFrame(rows, "f int, g string, h string, y double")


def matrix(pdf, names):
    cols = [np.ones(len(pdf))]
    for n in names:
        if n.endswith("^2"):
            cols.append(pdf[n[:-2]] ** 2)
        elif "*" in n:
            l, r = n.split("*")
            cols.append(pdf[l] * pdf[r])
        else:
            cols.append(pdf[n])
    return np.column_stack(cols)


@pytest.mark.parametrize("limit", [12, 0])
def test_quadratic_matches_lstsq_on_both_paths(table, monkeypatch, limit):
    monkeypatch.setattr(md, "MAX_SUM_TERMS", limit)
    model = md.fit_quadratic(table, "y", ["a", "b", "c"])
    pdf = table.toPandas()
    x = matrix(pdf, model.coefficients)
    want = np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)[0]
    np.testing.assert_allclose([model.intercept, *model.coefficients.values()], want, rtol=1e-7, atol=1e-8)
    assert model.sse == pytest.approx(((pdf.y - x @ want) ** 2).sum(), rel=1e-8)
    rows = inf.coefficient_rows(model)
    cov = np.linalg.inv(x.T @ x) * model.sse / (len(pdf) - x.shape[1])
    np.testing.assert_allclose([r[2] for r in rows], np.sqrt(np.diag(cov)), rtol=1e-6)


def test_folds_equal_explicit_refits(table):
    terms = fr.design_terms(["a", "b"], 2)
    got = {r.fold: r for r in md.cross_validated(table, "y", terms, ["i"], 4).collect()}
    pdf = table.withColumn("fold", md.hash_bucket(["i"], 42, 4) + 1).toPandas()
    for fold, test in pdf.groupby("fold"):
        train = pdf[pdf.fold != fold]
        w = np.linalg.lstsq(matrix(train, terms), train.y.to_numpy(), rcond=None)[0]
        e = test.y - matrix(test, terms) @ w
        assert got[fold].rmse == pytest.approx(np.sqrt((e**2).mean()), rel=1e-7)


def test_factorial_model_and_leave_one_out(design):
    model = md.fit_factorial(design, "y", ["f", "g", "h"])
    pdf = design.toPandas()
    terms = list(model.coefficients)
    scored = design.select("y", *[e.alias(f"t{i}") for i, e in enumerate(model.terms.values())]).toPandas()
    x = np.column_stack([np.ones(27), scored[[f"t{i}" for i in range(len(terms))]]])
    y = scored.y.to_numpy()
    np.testing.assert_allclose([model.intercept, *model.coefficients.values()], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)
    errors = []
    for i in range(27):
        keep = np.arange(27) != i
        errors.append(y[i] - x[i] @ np.linalg.lstsq(x[keep], y[keep], rcond=None)[0])
    row = inf.leave_one_out(model, design).first()
    assert row.rmse == pytest.approx(np.sqrt(np.mean(np.square(errors))), rel=1e-7)
    anova = {r.source: r for r in inf.factorial_anova(model, design, "y").collect()}
    drop = [j for j, t in enumerate(terms) if model.owner[t] == ("f", "h")]
    kept = np.delete(x, [j + 1 for j in drop], axis=1)
    reduced = ((y - kept @ np.linalg.lstsq(kept, y, rcond=None)[0]) ** 2).sum()
    assert anova["f x h"].ss == pytest.approx(reduced - model.sse, rel=1e-6)
    assert anova["f"].ss == pytest.approx(sum(9 * (g.y.mean() - y.mean()) ** 2 for _, g in pdf.groupby("f")), rel=1e-9)
    assert anova["total"].ss == pytest.approx(((y - y.mean()) ** 2).sum())


def test_incomplete_design_is_refused(design):
    with pytest.raises(ValueError):
        md.fit_factorial(design.where("not (f = 1 and g = 'x' and h = 'p')"), "y", ["f", "g", "h"])


def test_interaction_strength_is_the_row_definition(table):
    model = md.fit_quadratic(table, "y", ["a", "b"])
    pdf, m = table.toPandas(), table.agg(F.avg("a"), F.avg("b")).first()

    def f(a, b):
        c = model.coefficients
        return model.intercept + c["a"] * a + c["b"] * b + c["a^2"] * a * a + c["b^2"] * b * b + c["a*b"] * a * b

    want = np.mean(np.abs(f(pdf.a, pdf.b) - f(pdf.a, m[1]) - f(m[0], pdf.b) + f(m[0], m[1])))
    assert inf.interaction_strength(model, table, ["a", "b"]).first().strength == pytest.approx(want, rel=1e-9)


def test_permutation_sensitivity_finds_the_inputs(table):
    model = md.fit_linear(table, "y", ["a", "b", "c"])
    score = lambda t: md.score(model, t)
    whole = inf.permutation_sensitivity(score, table, "y", ["a", "b", "c"], ["i"], 2)
    got = {r.input: r.sensitivity for r in whole.collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["a"] > got["b"] > got["c"]
    cut = inf.permutation_sensitivity(score, table.repartition(3), "y", ["a", "b", "c"], ["i"], 2, rows_per_bucket=40)
    assert {r.input: r.sensitivity for r in cut.collect()} == pytest.approx(got)


def test_life_model_recovers_shape(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 1500)
    t = 50 * np.exp(0.8 * x) * rng.weibull(2.0, 1500)
    df = spark.createDataFrame([(float(a), float(b), 1) for a, b in zip(t, x)], "t double, x double, seen int")
    m = md.fit_life(df, "t", "seen", ["x"])
    assert m.shape == pytest.approx(2.0, rel=0.08) and m.coefficients[0] == pytest.approx(0.8, rel=0.15)


def test_outcome_labels_put_failures_at_one(spark):
    df = spark.createDataFrame([("ok",), ("NG",), ("pass",), ("1",), (None,)], "r string")
    assert [r[0] for r in df.select(md.outcome_label(F.col("r"))).collect()] == [0.0, 1.0, 0.0, 1.0, None]


def test_constant_target_metrics(spark):
    df = spark.createDataFrame([(2.0, 2.0, 3.0)] * 4, "y double, good double, bad double")
    assert md.regression_metrics(df, "y", "good").first().r2 == 1.0
    assert md.regression_metrics(df, "y", "bad").first().r2 == -1.0


def test_recursive_forecast_equals_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k in "ab" for i, v in enumerate(rng.normal(0, 1, 50).cumsum())]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    scan = fc.numbered_scan(df, "v", ["i"], ["k"], 0.8, rows_per_bucket=15)
    coefs = {"x_lag_1": 0.6, "x_lag_2": 0.2, "x_rolling_mean_3": 0.1}
    model = md.LinearModel("x", {}, 0.05, coefs, 10, 1.0, 0.1, np.zeros(3), np.eye(3))
    got = fc.recursive_forecast(scan, model, 6, [1, 2], [3]).toPandas()
    for k in "ab":
        h = [v for kk, i, v in rows if kk == k][:40]
        for s in range(1, 7):
            h.append(0.05 + 0.6 * h[-1] + 0.2 * h[-2] + 0.1 * np.mean(h[-3:]))
            assert got[(got.k == k) & (got.step == s)].predicted.item() == pytest.approx(h[-1])


def test_credibility_and_intervals(table):
    model = md.fit_linear(table, "y", ["a", "b"])
    row = gv.credibility(model, table, ["a", "b"], "approved", 0.0).first()
    assert 0 < row.composite <= 1 and row.validation == 1.0 and row.extrapolation == 1.0
    t = gv.prediction_interval(md.score(model, table), (model.sse / model.n) ** 0.5, model.n)
    assert 0.9 < t.agg(F.avg(((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("double"))).first()[0] <= 1.0


def test_run_order_column_needs_numbers_without_repeats(spark):
    good = spark.createDataFrame([(1, 0.1), (2, 0.2)], "`Run Order` int, residual double")
    bad = spark.createDataFrame([(1, 0.1), (1, 0.2)], "`Run Order` int, residual double")
    assert rs.find_order_column(good) == "Run Order" and rs.find_order_column(bad) is None


def test_recursion_over_the_whole_feature_set(spark):
    import datetime as dt
    import statistics

    from plantscope.operators import timeseries as ts

    start = dt.datetime(2024, 1, 1, 22)
    rows = [(k, start + dt.timedelta(hours=i), i, 10 + k + (i * 7 % 5) + 0.1 * i) for k in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, i int, v double")
    scan = fc.numbered_scan(df, "v", ["ts", "i"], ["k"], 0.8)
    feats = ts.calendar_features(ts.history_features(scan, ["x"], [1, 3], [4]).rows(), "ts")
    train = feats.where((F.col("rn") > 4) & (F.col("rn") <= F.col("n_train")))
    names = ["x_lag_1", "x_lag_3", "x_rolling_std_4", "x_first_difference", "x_rate_of_change", "hour", "weekday"]
    model = md.fit_least_squares(train, "x", {n: F.col(n) for n in names})
    got = {(r.k, r.step): r.predicted for r in fc.recursive_forecast(scan, model, 30, [1, 3], [4], time="ts", seconds=3600.0).collect()}
    for k in (0, 1):
        past = [v for kk, _, _, v in rows if kk == k][:48]
        last = start + dt.timedelta(hours=47)
        for h in range(1, 31):
            t = last + dt.timedelta(hours=h)
            x = {
                "x_lag_1": past[-1], "x_lag_3": past[-3], "x_rolling_std_4": statistics.stdev(past[-4:]), "x_first_difference": past[-1] - past[-2],
                "x_rate_of_change": past[-1] / past[-2] - 1, "hour": t.hour, "weekday": t.weekday(),
            }
            past.append(model.intercept + sum(model.coefficients[n] * v for n, v in x.items()))
            assert got[k, h] == pytest.approx(past[-1], rel=1e-9)


def test_validation_folds_match_a_loop(spark):
    from plantscope.operators import validation as va

    v = [5 + (i * 13 % 7) + 0.05 * i for i in range(90)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    for size in (None, 11):
        scan = fc.numbered_scan(df, "v", ["i"], rows_per_bucket=size)
        got = va.validation_folds(scan, 40, 10, 15, period=7, lags=(1, 2)).collect()
        by = {(r.model, r.fold, r.rn): r for r in got}
        assert len(by) == len(got) == 4 * 3 * 10
        for fold in range(3):
            end = 40 + 15 * fold
            past = np.array(v[:end])
            a = np.column_stack([np.ones(end - 1), past[:-1]])
            ar, *_ = np.linalg.lstsq(a, past[1:], rcond=None)
            b = np.column_stack([np.ones(end - 2), past[1:-1], past[:-2]])
            reg, *_ = np.linalg.lstsq(b, past[2:], rcond=None)
            x = past[-1]
            for h in range(1, 11):
                x = ar[0] + ar[1] * x
                at = end + h
                want = {"naive": past[-1], "seasonal": past[end - 7 + (h - 1) % 7], "ar1": x, "regression": reg @ [1, v[at - 2], v[at - 3]]}
                for m, p in want.items():
                    assert by[m, fold, at].predicted == pytest.approx(p, rel=1e-8)
            half = 1.959963984540054 * np.sqrt(((past[1:] - a @ ar) ** 2).mean()) * np.sqrt(1 + 1 / (end - 1))
            assert by["ar1", fold, end + 1].half_width == pytest.approx(half, rel=1e-8)
