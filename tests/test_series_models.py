"""Models of many series against loops over one series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantscope.operators import forecast as fc
from plantscope.operators import series_models as sm
from plantscope.operators import timeseries as ts

FEATURES = ["a", "b"]


def table(n=70, names="pqr"):
    rng = random.Random(4)
    rows = []
    for k, name in enumerate(names):
        for i in range(n):
            a, b = rng.randrange(30) / 3, rng.choice([0.0, 1.0, 5.0, None] if k == 1 else [0.0, 1.0, 5.0])
            rows.append((name, i, a, b, 3 * k + (a > 5) * 4 + (b or 0) * 0.7 + rng.random()))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, i int, a double, b double, y double")


def cuts(values, bins):
    values = [v for v in values if v is not None]
    return sorted(set(np.percentile(values, [100 * i / bins for i in range(1, bins)]).tolist()))


def slow_tree(x, y, w, edges, depth, least):
    """The best splits by a loop over all thresholds: {node: (feature, threshold)}, {node: value}."""
    splits, values = {}, {0: np.average(y, weights=w)}
    rows = {0: np.arange(len(y))}
    for _ in range(depth):
        below = {}
        for node, at in rows.items():
            best = None
            for f, cut in enumerate(edges):
                for c in cut:
                    left = np.array([x[i][f] is not None and x[i][f] <= c for i in at])
                    ln, rn = w[at][left].sum(), w[at][~left].sum()
                    if ln < least or rn < least:
                        continue
                    ls, rs = (w[at] * y[at])[left].sum(), (w[at] * y[at])[~left].sum()
                    gain = ls**2 / ln + rs**2 / rn - (ls + rs) ** 2 / (ln + rn)
                    if gain > sm.LEAST_GAIN and (best is None or gain > best[0] * (1 + 1e-12)):
                        best = (gain, f, c, left, ls / ln, rs / rn)
            if best:
                _, f, c, left, lv, rv = best
                splits[node] = (f, c)
                values[2 * node + 1], values[2 * node + 2] = lv, rv
                below[2 * node + 1], below[2 * node + 2] = at[left], at[~left]
        rows = below
    return splits, values


def slow_value(tree, x):
    splits, values = tree
    node = 0
    while node in splits:
        f, c = splits[node]
        node = 2 * node + (1 if x[f] is not None and x[f] <= c else 2)
    return values[node]


def test_regressions(spark):
    rows = table()
    model = sm.fit_regressions(frame(spark, rows), "y", FEATURES, ["k"])
    got = {r.k: r for r in model.models.collect()}
    scored = {(r.k, r.i): r.predicted for r in model.score(frame(spark, rows)).collect()}
    for k in "pqr":
        own = [r for r in rows if r[0] == k and r[3] is not None]
        x = np.array([[1, r[2], r[3]] for r in own])
        y = np.array([r[4] for r in own])
        want, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert [got[k].intercept, *got[k].coefficients] == pytest.approx(want.tolist(), rel=1e-8)
        assert got[k].n == len(own) and got[k].sse == pytest.approx(((y - x @ want) ** 2).sum(), rel=1e-8)
        assert scored[k, own[0][1]] == pytest.approx(x[0] @ want)
    assert any(v is None for v in scored.values())


def test_forests(spark):
    rows = table()
    settings = dict(row_keys=["i"], trees=3, depth=3, bins=8)
    model = sm.fit_forests(frame(spark, rows), "y", FEATURES, ["k"], **settings)
    got = {(r.k, r.i): r.predicted for r in model.score(frame(spark, rows)).collect()}
    draws = frame(spark, rows).select("k", "i", F.explode(F.array(*[F.lit(t) for t in range(3)])).alias("tree"))
    u = F.pmod(F.xxhash64(F.xxhash64("i", F.lit(42)), "tree"), F.lit(1 << 30)) / float(1 << 30)
    weight = {(r.k, r.i, r.tree): r.w for r in draws.withColumn("w", sm._poisson(u)).collect()}
    assert 0.7 < sum(weight.values()) / len(weight) < 1.3
    for k in "pqr":
        own = [r for r in rows if r[0] == k]
        x, y = [r[2:4] for r in own], np.array([r[4] for r in own])
        edges = [cuts([v[f] for v in x], 8) for f in range(2)]
        trees = [slow_tree(x, y, np.array([weight[k, r[1], t] for r in own]), edges, 3, 2) for t in range(3)]
        for r in own:
            assert got[k, r[1]] == pytest.approx(np.mean([slow_value(t, r[2:4]) for t in trees]), rel=1e-9)
    # other series and other partitions change nothing
    alone = sm.fit_forests(frame(spark, [r for r in rows if r[0] == "q"]).repartition(7), "y", FEATURES, ["k"], **settings)
    for r in alone.score(frame(spark, [r for r in rows if r[0] == "q"])).collect():
        assert r.predicted == pytest.approx(got["q", r.i], rel=1e-12)


def test_boosted_trees(spark):
    rows = table(40, "pq")
    model = sm.fit_boosted_trees(frame(spark, rows), "y", FEATURES, ["k"], rounds=12, depth=2, rate=0.3, bins=8)
    got = {(r.k, r.i): r.predicted for r in model.score(frame(spark, rows)).collect()}
    for k in "pq":
        own = [r for r in rows if r[0] == k]
        x, y = [r[2:4] for r in own], np.array([r[4] for r in own])
        edges = [cuts([v[f] for v in x], 8) for f in range(2)]
        now = np.full(len(y), y.mean())
        for _ in range(12):
            tree = slow_tree(x, y - now, np.ones(len(y)), edges, 2, 1)
            now = now + 0.3 * np.array([slow_value(tree, v) for v in x])
        assert [got[k, r[1]] for r in own] == pytest.approx(now.tolist(), rel=1e-7)


def test_one_model_without_series_keys_and_hybrid(spark):
    df = frame(spark, table(30, "p")).withColumn("naive", F.col("a"))
    model = sm.fit_hybrid(df, "y", "naive", FEATURES, row_keys=["i"], trees=2, depth=2, bins=4)
    scored = model.score(df).collect()
    assert len(scored) == 30 and all(math.isfinite(r.predicted) for r in scored)
    linear = sm.fit_hybrid(df, "y", "naive", FEATURES, fit=sm.fit_regressions, series_keys=["k"])
    assert linear.score(df).where("predicted is null").count() == 0
    boosted = sm.fit_boosted_trees(df, "y", FEATURES, rounds=1, depth=1, bins=4)
    assert boosted.score(df).where("predicted is null").count() == 0


def test_constant_series_and_few_rows(spark):
    rows = [("c", i, 1.0, 2.0, 5.0) for i in range(20)] + [("one", 0, 1.0, 2.0, 7.0), ("none", 0, 1.0, 2.0, None)]
    df = frame(spark, rows)
    for model in (sm.fit_forests(df, "y", FEATURES, ["k"], ["i"], trees=4, depth=2, bootstrap=False), sm.fit_boosted_trees(df, "y", FEATURES, ["k"], rounds=2)):
        assert {r.k: r.predicted for r in model.score(df).collect()} == {"c": 5.0, "one": 7.0}


def test_recursion_of_a_forest_equals_a_loop(spark):
    rng = random.Random(9)
    rows = [(k, i, 10 + k * 5 + (i % 6) + rng.random()) for k in (0, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    scan = fc.numbered_scan(df, "v", ["i"], ["k"], 0.8)
    feats = ts.history_features(scan, ["x"], [1, 2], [3]).rows()
    train = feats.where((F.col("rn") > 3) & (F.col("rn") <= F.col("n_train")))
    names = ["x_lag_1", "x_lag_2", "x_rolling_mean_3", "x_first_difference"]
    model = sm.fit_forests(train, "x", names, ["k"], ["i"], trees=5, depth=3, bins=8)
    got = {(r.k, r.step): r.predicted for r in fc.recursive_forecast(scan, model, 8, [1, 2], [3]).collect()}
    for r in model.models.collect():
        past = [v for k, _, v in rows if k == r.k][:40]
        for h in range(1, 9):
            x = [past[-1], past[-2], sum(past[-3:]) / 3, past[-1] - past[-2]]
            total = 0.0
            for t in r.trees:
                node = 0
                while node < len(t.feature) and t.feature[node] >= 0:
                    node = 2 * node + (1 if x[t.feature[node]] <= t.threshold[node] else 2)
                total += t.value[node]
            past.append(r.base + r.rate * total)
            assert got[r.k, h] == pytest.approx(past[-1], rel=1e-9)


def test_folds_of_fitted_models_match_a_loop(spark):
    from plantscope.operators import validation as va

    v = [5 + (i * 13 % 7) + 0.05 * i for i in range(70)]
    df = spark.createDataFrame([(k, i, x + k * (i % 3)) for k in (0, 1) for i, x in enumerate(v)], "k int, i int, v double")
    scan = ts.history_features(fc.numbered_scan(df, "v", ["i"], ["k"]), ["x"], [1, 2], [3])
    place = {"initial": 40, "horizon": 10, "step": 15}
    names = ["x_lag_1", "x_lag_2"]
    rows = scan.rows().where("rn > 2")
    fits = {
        "linear": lambda t, y, f, k: sm.fit_regressions(t, y, f, k),
        "boosted": lambda t, y, f, k: sm.fit_boosted_trees(t, y, f, k, rounds=3, depth=2, bins=4),
    }
    fitted = va.fitted_folds(rows, names, fits, **place, series_keys=["k"]).collect()
    running = va.validation_folds(scan, **place, models=["dynamic"], features=names).collect()
    got = {(r.model, r.k, r.fold, r.rn): r for r in [*fitted, *running]}
    assert len(got) == len(fitted) + len(running) == 3 * 2 * 2 * 10 and all(r.uses_observed for r in got.values())
    for k in (0, 1):
        x = np.array([a + k * (i % 3) for i, a in enumerate(v)])
        for fold in range(2):
            end = 40 + 15 * fold
            design = np.column_stack([np.ones(end - 2), x[1 : end - 1], x[: end - 2]])
            y = x[2:end]
            coef, *_ = np.linalg.lstsq(design, y, rcond=None)
            half = 1.959963984540054 * np.sqrt(((y - design @ coef) ** 2).mean()) * np.sqrt(1 + 1 / len(y))
            edges = [cuts(design[:, c].tolist(), 4) for c in (1, 2)]
            inputs = [tuple(r[1:]) for r in design]
            now, trees = np.full(len(y), y.mean()), []
            for _ in range(3):
                trees.append(slow_tree(inputs, y - now, np.ones(len(y)), edges, 2, 1))
                now = now + 0.1 * np.array([slow_value(trees[-1], r) for r in inputs])
            for at in range(end, end + 10):
                want = coef @ [1, x[at - 1], x[at - 2]]
                for model in ("linear", "dynamic"):
                    assert got[model, k, fold, at + 1].predicted == pytest.approx(want, rel=1e-7)
                    assert got[model, k, fold, at + 1].half_width == pytest.approx(half, rel=1e-7)
                boosted = y.mean() + 0.1 * sum(slow_value(t, (x[at - 1], x[at - 2])) for t in trees)
                assert got["boosted", k, fold, at + 1].predicted == pytest.approx(boosted, rel=1e-7)


def _walk(tree, x):
    """The leaf of a ``pyspark.ml`` tree by its own nodes."""
    node = tree._call_java("rootNode")
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


@pytest.fixture(scope="module")
def fitted(spark):
    from plantscope.operators import models as md

    rows = [r for r in table(60) if r[3] is not None]
    df = frame(spark, rows)
    return df, md.fit_forest(df, "y", FEATURES, trees=7, depth=4), md.fit_boosted(df, "y", FEATURES, rounds=6, depth=3)


def test_compiled_ensembles_predict_alike(spark, fitted):
    df, *models = fitted
    for model in models:
        own = sm.compiled(model, spark).score(df, "own")
        both = model.transform(own).select("own", "predicted").collect()
        assert len(both) > 100 and all(r.own == pytest.approx(r.predicted, rel=1e-12) for r in both)


def test_forest_spread_is_the_spread_of_the_trees(spark, fitted):
    from plantscope.operators import governance as gv

    df, forest, _ = fitted
    candidates = gv.next_run_candidates(df, FEATURES).unionByName(
        spark.createDataFrame([("none", None, None, 1.0)], "reason string, varied string, a double, b double")
    )
    got = gv.forest_spread(forest, candidates).collect()
    assert [r.reason for r in got][-1] == "none" and got[-1].spread is None and len(got) == 6
    assert [r.spread for r in got[:-1]] == sorted((r.spread for r in got[:-1]), reverse=True)
    for r in got[:-1]:
        want = np.std([_walk(t, (r.a, r.b)) for t in forest.stages[-1].trees])
        assert r.spread == pytest.approx(want, abs=1e-12)
    # a forest a series, candidates of every series at once
    per = sm.fit_forests(df, "y", FEATURES, ["k"], ["i"], trees=3, depth=2)
    one = gv.forest_spread(per, df.select("k", "a", "b").limit(9)).collect()
    assert len(one) == 9 and all(r.spread >= 0 for r in one)


def test_grids_profiles_and_interactions_of_any_model(spark, fitted):
    from plantscope.operators import governance as gv
    from plantscope.operators import inference as inf

    df, forest, boosted = fitted
    predict = lambda model, x: (
        np.mean([_walk(t, x) for t in model.stages[-1].trees]) if model is forest
        else sum(w * _walk(t, x) for t, w in zip(model.stages[-1].trees, model.stages[-1].treeWeights))
    )
    for model in (forest, boosted):
        for r in gv.response_grid(model, df, "a", "b", FEATURES, 5, ["k"]).collect():
            assert r.predicted == pytest.approx(predict(model, (r.a, r.b)), rel=1e-9)
    mid = {k: (np.median([r[2] for r in df.collect() if r.k == k]), np.median([r[3] for r in df.collect() if r.k == k])) for k in "pqr"}
    profile = gv.one_at_a_time(forest, df, FEATURES, ["k"]).collect()
    assert len(profile) == 18
    for r in profile:
        x = (r.value, mid[r.k][1]) if r.input == "a" else (mid[r.k][0], r.value)
        assert r.predicted == pytest.approx(predict(forest, x), rel=1e-9)
    # the row definition, by one model for all rows and by a model a series
    pdf = df.toPandas()
    m = pdf.a.mean(), pdf.b.mean()
    each = [abs(predict(forest, (a, b)) - predict(forest, (a, m[1])) - predict(forest, (m[0], b)) + predict(forest, m)) for a, b in zip(pdf.a, pdf.b)]
    assert inf.interaction_strength(forest, df, FEATURES).first().strength == pytest.approx(np.mean(each), rel=1e-9)
    gap = df.unionByName(frame(spark, [("p", 99, None, 1.0, 2.0)]))
    assert inf.interaction_strength(forest, gap, FEATURES).first().strength is not None
    per = sm.fit_boosted_trees(df, "y", FEATURES, ["k"], rounds=4, depth=2)
    all_of = {r.k: r.strength for r in inf.interaction_strength(per, df, FEATURES).collect()}
    alone = df.where("k = 'q'")
    only = inf.interaction_strength(sm.fit_boosted_trees(alone, "y", FEATURES, ["k"], rounds=4, depth=2), alone, FEATURES).first()
    assert set(all_of) == set("pqr") and all_of["q"] == pytest.approx(only.strength, rel=1e-9)


def test_any_function_can_be_profiled(spark, fitted):
    from plantscope.operators import governance as gv

    df, *_ = fitted
    got = gv.response_grid(lambda t: t.withColumn("predicted", F.col("a") * F.col("b")), df, "a", "b", FEATURES, 3)
    assert all(r.predicted == pytest.approx(r.a * r.b) for r in got.collect())
