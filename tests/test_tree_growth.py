"""Trees on every path: in a task, level by level, and from cells; scoring on batches."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from plantscope.operators import cell_trees as ct
from plantscope.operators import inference as inf
from plantscope.operators import models as md
from plantscope.operators import series_models as sm
from plantscope.operators import tree_growth as tg

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(8)
    rows = [
        (k, i, float(rng.integers(0, 40)), None if k == "q" and i % 7 == 0 else float(rng.integers(0, 6)), float(rng.normal(3, 1) + i % 5))
        for k, n in (("p", 150), ("q", 90), ("r", 30)) for i in range(n)
    ]
    return spark.createDataFrame(rows, "k string, i int, a double, b double, y double")


def scored(model, df):
    return {(r.k, r.i): r.predicted for r in model.score(df).collect()}


@pytest.mark.parametrize("cells", [0, 1 << 20])
def test_long_series_get_the_trees_of_short_ones(df, monkeypatch, cells):
    settings = dict(row_keys=["i"], trees=6, depth=3, bins=8)
    want = scored(sm.fit_forests(df, "y", FEATURES, ["k"], **settings), df)
    boosted = scored(sm.fit_boosted_trees(df, "y", FEATURES, ["k"], rounds=5, bins=8), df)
    monkeypatch.setattr(sm, "LOCAL_ROWS", 50)  # "r" stays short
    monkeypatch.setattr(sm, "GRID_CELLS", cells)
    monkeypatch.setattr(sm, "TASK_BYTES", 20_000)  # sums leave the tasks in pieces
    assert scored(sm.fit_forests(df, "y", FEATURES, ["k"], **settings), df) == pytest.approx(want, rel=1e-9)
    if cells:
        assert scored(sm.fit_boosted_trees(df, "y", FEATURES, ["k"], rounds=5, bins=8), df) == pytest.approx(boosted, rel=1e-9)


def test_draws_are_those_of_the_expression(spark):
    rows = spark.range(300).select(F.xxhash64("id").alias("r"), "id").collect()
    ids = np.array([r.r for r in rows]).view(np.uint64)
    u = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    want = {r.id: r.w for r in spark.range(300).select("id", sm._poisson(u).alias("w")).collect()}
    assert tg.draws(ids, 5).tolist() == [want[r.id] for r in rows] and len(set(want.values())) > 3


def test_batches_are_scored_as_by_the_expression(spark, df, monkeypatch):
    model = sm.fit_boosted_trees(df, "y", FEATURES, ["k"], rounds=4, depth=2, bins=8)
    want = {(r.k, r.i): r.p for r in model.attach(df).withColumn("p", model.prediction()).collect()}
    assert model.walker is not None and scored(model, df) == pytest.approx(want, rel=1e-12)
    strong = {r.k: r.strength for r in inf.interaction_strength(model, df, FEATURES).collect()}
    monkeypatch.setattr(sm, "MODEL_BYTES", 0)
    large = sm.SeriesTrees(model.models, model.features, model.keys, model.depth)
    assert large.walker is None and scored(large, df) == pytest.approx(want, rel=1e-12)
    assert {r.k: r.strength for r in inf.interaction_strength(large, df, FEATURES).collect()} == pytest.approx(strong, rel=1e-9)


def test_the_fit_knows_what_is_left_of_its_rows(df):
    for model in (
        sm.fit_forests(df, "y", FEATURES, ["k", "i"], ["i"], trees=2, depth=2, bootstrap=False),
        sm.fit_boosted_trees(df, "y", FEATURES, ["k"], rounds=4, bins=8),
    ):
        keys = list(model.keys)
        gap = (F.col("y") - F.col("predicted")) ** 2
        want = {tuple(r[:-2]): r[-2:] for r in model.score(df).groupBy(*keys).agg(F.avg(gap), F.count("predicted")).collect()}
        got = {tuple(r[k] for k in keys): (r["_mse"], r["_k"]) for r in model.trained(df).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(tuple(want[k]), abs=1e-9) for k in want)


def test_boosting_on_cells_is_that_of_pyspark(df, monkeypatch):
    rows = df.where("b IS NOT NULL").withColumn("a", F.floor(F.col("a") / 2).cast("double"))
    est = GBTRegressor(featuresCol=md.FEATURES, labelCol="y", predictionCol="predicted", maxIter=6, maxDepth=3, stepSize=0.1, seed=1)
    cells = md._fit(est, rows, FEATURES, "y")
    assert cells.stages[-1].uid.startswith("GBTRegressionModel")
    monkeypatch.setattr(md, "fit_on_cells", lambda *a: None)
    plain = md._fit(est, rows, FEATURES, "y")
    pick = lambda m: [r.predicted for r in m.transform(rows).orderBy("k", "i").collect()]
    assert pick(cells) == pytest.approx(pick(plain), rel=1e-9)
    assert dict(md.importances(cells, FEATURES)) == pytest.approx(dict(md.importances(plain, FEATURES)), rel=1e-6)


def test_forest_on_cells_is_a_forest_of_pyspark(df, monkeypatch):
    rows = df.where("b IS NOT NULL").withColumn("a", F.floor(F.col("a") / 2).cast("double"))
    pick = lambda m: np.array([r.predicted for r in m.transform(rows).orderBy("k", "i").collect()])
    est = RandomForestRegressor(
        featuresCol=md.FEATURES, labelCol="y", predictionCol="predicted", numTrees=1, maxDepth=4, minInstancesPerNode=4, seed=1, bootstrap=False
    )
    one, forest = md._fit(est, rows, FEATURES, "y"), md.fit_forest(rows, "y", FEATURES, trees=30, depth=4)
    assert forest.stages[-1].getNumTrees == 30 and forest.stages[-1].uid.startswith("RandomForestRegressionModel")
    monkeypatch.setattr(ct, "GRID_CELLS", 0)  # too many cells: as before
    plain = md.fit_forest(rows, "y", FEATURES, trees=30, depth=4)
    assert plain.stages[-1].uid.startswith("RandomForestRegressor")
    assert np.corrcoef(pick(forest), pick(plain))[0, 1] > 0.8
    # without draws and chosen inputs there is nothing random
    assert pick(one) == pytest.approx(pick(md._fit(est, rows, FEATURES, "y")), rel=1e-9)


def test_predictions_looked_up_by_cell_are_those_of_the_trees(df, monkeypatch):
    rows = df.where("b IS NOT NULL")
    pick = lambda t: [r.predicted for r in t.orderBy("k", "i").collect()]
    for model in (md.fit_forest(rows, "y", FEATURES, trees=5, depth=4), md.fit_boosted(rows, "y", FEATURES, rounds=4, depth=3)):
        assert ct.score_on_cells(model, rows) is not None
        assert pick(md.score(model, rows)) == pytest.approx(pick(model.transform(rows)), rel=1e-12)
        with pytest.raises(Exception, match="missing"):
            md.score(model, df).collect()
    hybrid = md.fit_hybrid(rows, "y", FEATURES, trees=4, depth=3)
    looked_up = pick(md.score(hybrid, rows))
    monkeypatch.setattr(ct, "GRID_CELLS", 0)
    assert pick(md.score(hybrid, rows)) == pytest.approx(looked_up, rel=1e-12)
