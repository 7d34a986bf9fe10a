"""Models: least squares from one Gram matrix, and ``pyspark.ml`` for everything else.

The linear family aggregates a p x p matrix on the executors in two passes (means, then centred
products) and solves that small system; inference, leave-one-out and ANOVA reuse the matrix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantscope.operators.cell_trees import fit_on_cells, score_on_cells
from plantscope.operators.frames import design_coverage, design_terms, factor_levels, treatment_terms
from plantscope.operators.stats import finite, long_form

NODE_MEMORY_MB = 1024  # histograms of more tree nodes in one pass over the rows
FEATURES = "_features"
MAX_SUM_TERMS = 12


# -- splits --------------------------------------------------------------------------------


def hash_bucket(keys: Sequence[str], seed: int, n: int) -> Column:
    """Bucket 0..n-1 of a row key: the same under any partitioning of the rows."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(n))


def random_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.3, seed: int = 42) -> DataFrame:
    return df.withColumn("split", F.when(hash_bucket(keys, seed, 10_000) < int(test_size * 10_000), "test").otherwise("train"))


# -- least squares ----------------------------------------------------------------------------


@dataclass(frozen=True)
class LinearModel:
    """Least-squares fit with the statistics its inference needs."""

    target: str
    terms: dict[str, Column]
    intercept: float
    coefficients: dict[str, float]
    n: int
    sst: float
    sse: float
    means: np.ndarray
    inverse: np.ndarray  # inverse of the centred cross-product matrix
    owner: dict[str, tuple[str, ...]] = field(default_factory=dict)
    levels: dict[str, list] = field(default_factory=dict)

    @property
    def p(self) -> int:
        """Number of parameters, intercept included."""
        return len(self.coefficients) + 1

    @property
    def r2(self) -> float:
        return 1.0 - self.sse / self.sst if self.sst > 0 else (1.0 if self.sse == 0 else -1.0)

    def prediction(self, terms: dict[str, Column] | None = None) -> Column:
        terms = terms or self.terms
        out = F.lit(float(self.intercept))
        for name, b in self.coefficients.items():
            out = out + F.lit(float(b)) * terms[name]
        return out

    def leverage(self) -> Column:
        """Diagonal of the hat matrix, computed on Arrow batches of the term columns."""
        n, means, inverse = self.n, self.means, self.inverse

        @F.pandas_udf(T.DoubleType())
        def diagonal(rows: pd.Series) -> pd.Series:
            x = np.vstack(rows.to_numpy()) - means
            return pd.Series(1.0 / n + np.einsum("ij,jk,ik->i", x, inverse, x))

        return diagonal(F.array(*[t.cast("double") for t in self.terms.values()]))

    def table(self, df: DataFrame) -> DataFrame:
        rows = [("intercept", float(self.intercept)), *[(k, float(v)) for k, v in self.coefficients.items()]]
        return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def _model_frame(df: DataFrame, target: str, terms: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows as (keep…, _y, _x) with all terms in one array.

    One array column, not a column per term: the optimizer's constraint inference grows
    exponentially with the number of derived columns over few inputs.
    """
    out = df.select(*keep, finite(F.col(target)).alias("_y"), F.array(*[e.cast("double") for e in terms.values()]).alias("_x"))
    return out.where(F.col("_y").isNotNull() & (F.size(F.array_compact("_x")) == len(terms)))


def _term(i: int) -> Column:
    return F.get("_x", F.lit(i))


def _centred_sums(rows: DataFrame, p: int, by: Sequence[str] = ()) -> tuple[np.ndarray, float, list]:
    """Global means, then per group: n, sums and cross-products of the centred columns."""
    first = rows.agg(F.count(F.lit(1)), F.avg("_y"), *[F.avg(_term(i)) for i in range(p)]).first()
    if not first[0]:
        raise ValueError("no complete rows to fit on")
    means = np.array([float(v) for v in first[2:]])
    y_mean = float(first[1])
    if p > MAX_SUM_TERMS:
        return means, y_mean, _batched_products(rows, p, np.append(means, y_mean), by)
    t = [_term(i) - float(m) for i, m in enumerate(means)]
    y = F.col("_y") - y_mean
    cols = [*t, y]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(cols[i] * cols[j]).alias(f"q{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
    return means, y_mean, rows.groupBy(*by).agg(*aggs).collect()


def _batched_products(rows: DataFrame, p: int, centre: np.ndarray, by: Sequence[str]) -> list[dict]:
    """Cross-products for wide models: each task sums a (p + 1) square matrix over its Arrow
    batches, and the entries are then summed by position. What is collected is one matrix per group."""
    group = by[0] if by else None
    slim = rows.select((F.col(group) if group else F.lit(0)).cast("long").alias("g"), "_x", "_y")

    def partial(batches):
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = np.column_stack([np.vstack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy(float)]) - centre
            keys = pdf["g"].to_numpy()
            for k in np.unique(keys):
                part = np.column_stack([np.ones((keys == k).sum()), x[keys == k]])
                totals[int(k)] = totals.get(int(k), 0.0) + part.T @ part
        if totals:
            yield pd.DataFrame({"g": list(totals), "m": [m.ravel() for m in totals.values()]})

    entries = slim.mapInPandas(partial, "g long, m array<double>").select("g", F.posexplode("m").alias("at", "v"))
    size, out = p + 2, {}
    for r in entries.groupBy("g", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.g, np.zeros(size * size))[r["at"]] = r.v
    found = []
    for g, flat in out.items():
        m = flat.reshape(size, size)
        row = {"n": int(round(m[0, 0])), **{f"s{i}": m[0, i + 1] for i in range(p + 1)}}
        row |= {f"q{i}_{j}": m[i + 1, j + 1] for i in range(p + 1) for j in range(i, p + 1)}
        if group:
            row[group] = g
        found.append(row)
    return found


def _unpack(row, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    s = np.array([float(row[f"s{i}"] or 0.0) for i in range(p + 1)])
    q = np.zeros((p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            q[i, j] = q[j, i] = float(row[f"q{i}_{j}"] or 0.0)
    return int(row["n"]), s, q


def _solve(n: int, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Slopes, inverse, centre shift, total and residual sum of squares."""
    c = q - np.outer(s, s) / n
    xx, xy, yy = c[:-1, :-1], c[:-1, -1], c[-1, -1]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    scaled = xx / np.outer(scale, scale)
    if np.linalg.matrix_rank(scaled, tol=1e-10) < len(scaled):
        inv = np.linalg.pinv(scaled, rcond=1e-10) / np.outer(scale, scale)
    else:
        inv = np.linalg.inv(scaled) / np.outer(scale, scale)
    b = inv @ xy
    return b, inv, s / n, float(yy), float(max(yy - b @ xy, 0.0))


def fit_least_squares(df: DataFrame, target: str, terms: dict[str, Column], **extra) -> LinearModel:
    rows = _model_frame(df, target, terms)
    p = len(terms)
    means, y_mean, groups = _centred_sums(rows, p)
    n, s, q = _unpack(groups[0], p)
    b, inv, shift, sst, sse = _solve(n, s, q)
    intercept = y_mean + shift[-1] - float(b @ (means + shift[:-1]))
    return LinearModel(target, terms, intercept, dict(zip(terms, map(float, b))), n, sst, sse, means + shift[:-1], inv, **extra)


def fit_linear(df: DataFrame, target: str, inputs: Sequence[str]) -> LinearModel:
    return fit_least_squares(df, target, design_terms(inputs, 1))


def fit_quadratic(df: DataFrame, target: str, inputs: Sequence[str]) -> LinearModel:
    return fit_least_squares(df, target, design_terms(inputs, 2))


def fit_factorial(df: DataFrame, target: str, factors: Sequence[str], three_way: bool = False, require_complete: bool = True) -> LinearModel:
    """Categorical factorial model with treatment coding; a complete unreplicated design is required."""
    if require_complete:
        cover = design_coverage(df, factors).first()
        if cover.status != "ready":
            raise ValueError(f"design is not complete: {cover.n_missing} missing, {cover.n_duplicate} repeated cells")
    levels = factor_levels(df, factors)
    terms, owner = treatment_terms(levels, True, three_way)
    model = fit_least_squares(df, target, terms, owner=owner, levels=levels)
    if model.n <= model.p:
        raise ValueError("not enough rows for the number of terms")
    return model


def cross_validated(df: DataFrame, target: str, terms: dict[str, Column], keys: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """k-fold R2 and RMSE of a linear model in three passes, whatever k is.

    Cross-products are summed per fold once; each training matrix is the total minus one fold.
    """
    names = list(keys)
    rows = _model_frame(df.withColumn("_fold", hash_bucket(names, seed, k)), target, terms, ["_fold"])
    p = len(terms)
    means, y_mean, groups = _centred_sums(rows, p, ["_fold"])
    parts = {g["_fold"]: _unpack(g, p) for g in groups}
    total = [sum(v[i] for v in parts.values()) for i in range(3)]
    pred = None
    for fold, (n, s, q) in sorted(parts.items()):
        b, _, shift, _, _ = _solve(total[0] - n, total[1] - s, total[2] - q)
        intercept = y_mean + shift[-1] - float(b @ (means + shift[:-1]))
        expr = F.lit(float(intercept))
        for i, v in enumerate(b):
            expr = expr + F.lit(float(v)) * _term(i)
        pred = F.when(F.col("_fold") == fold, expr) if pred is None else pred.when(F.col("_fold") == fold, expr)
    scored = rows.select((F.col("_fold") + 1).alias("fold"), F.col("_y").alias("actual"), pred.alias("predicted"))
    return regression_metrics(scored, "actual", "predicted", ["fold"], p).select("fold", "n", "r2", "rmse")


# -- pyspark.ml models ---------------------------------------------------------------------------


def _assemble(df: DataFrame, inputs: Sequence[str], target: str | None) -> tuple[VectorAssembler, DataFrame]:
    need = [*inputs, *([target] if target else [])]
    rows = df.withColumns({c: finite(F.col(c)) for c in need}).na.drop(subset=need)
    return VectorAssembler(inputCols=list(inputs), outputCol=FEATURES), rows


def _fit(estimator, df: DataFrame, inputs: Sequence[str], target: str) -> PipelineModel:
    assembler, rows = _assemble(df, inputs, target)
    if isinstance(estimator, (RandomForestRegressor, GBTRegressor)) and (found := fit_on_cells(estimator, rows, inputs, target)):
        return PipelineModel([assembler, found])
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        # training passes over its rows many times; a small file would leave all but one core idle
        rows = rows.repartition(cores, *inputs, target)
    return PipelineModel([assembler, estimator.fit(assembler.transform(rows))])


def fit_forest(
    df: DataFrame, target: str, inputs: Sequence[str], trees: int = 200, depth: int = 10, leaf: int = 3, seed: int = 42
) -> PipelineModel:
    est = RandomForestRegressor(
        featuresCol=FEATURES, labelCol=target, predictionCol="predicted", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed,
        maxMemoryInMB=NODE_MEMORY_MB,
    )
    return _fit(est, df, inputs, target)


def fit_boosted(
    df: DataFrame, target: str, inputs: Sequence[str], rounds: int = 200, depth: int = 6, rate: float = 0.1, seed: int = 42
) -> PipelineModel:
    est = GBTRegressor(
        featuresCol=FEATURES, labelCol=target, predictionCol="predicted", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed,
        maxMemoryInMB=NODE_MEMORY_MB,
    )
    return _fit(est, df, inputs, target)


def importances(model: PipelineModel, inputs: Sequence[str]) -> list[tuple[str, float]]:
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        raw = [float(v) for v in last.featureImportances.toArray()]
    else:
        raw = [abs(float(v)) for v in last.coefficients.toArray()]
    total = sum(raw)
    return [(n, v / total if total > 0 else 0.0) for n, v in zip(inputs, raw)]


def select_features(df: DataFrame, target: str, inputs: Sequence[str], threshold: float = 0.01, top: int = 5, trees: int = 50) -> list[str]:
    """Forest importance at least ``threshold``, best ``top``; all inputs when none qualifies."""
    ranked = sorted(importances(fit_forest(df, target, inputs, trees=trees), inputs), key=lambda r: (-r[1], r[0]))
    chosen = [n for n, v in ranked if v >= threshold][:top]
    return chosen or list(inputs)


@dataclass(frozen=True)
class HybridModel:
    """Quadratic trend plus a forest on its residual."""

    trend: LinearModel
    forest: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        out = score(self.forest, df).withColumnRenamed("predicted", "_rest")
        return out.withColumn("predicted", self.trend.prediction() + F.col("_rest")).drop("_rest")


def fit_hybrid(
    df: DataFrame, target: str, inputs: Sequence[str], trees: int = 100, depth: int = 10, leaf: int = 5, seed: int = 42
) -> HybridModel:
    trend = fit_quadratic(df, target, inputs)
    rest = df.withColumn("_residual", F.col(target) - trend.prediction())
    return HybridModel(trend, fit_forest(rest, "_residual", inputs, trees, depth, leaf, seed))


def outcome_label(col: Column) -> Column:
    """Text outcomes as 0/1 with the failing class as 1; numbers pass through."""
    text = F.upper(F.trim(col.cast("string")))
    return F.when(text.isin("NG", "FAIL", "TRUE"), 1.0).when(text.isin("OK", "PASS", "FALSE"), 0.0).otherwise(text.try_cast("double"))


def fit_logistic(df: DataFrame, label: str, inputs: Sequence[str]) -> PipelineModel:
    est = LogisticRegression(featuresCol=FEATURES, labelCol=label, predictionCol="predicted", probabilityCol="probability", rawPredictionCol="raw")
    return _fit(est, df, inputs, label)


def classification_report(scored: DataFrame, label: str) -> DataFrame:
    """Accuracy, recall, AUC and class counts of a scored table."""
    # numBins=0: the exact curve, with no binning of scores
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="raw", numBins=0).evaluate(scored)
    y, p = F.col(label), F.col("predicted")
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == 1).alias("n_positive"),
        F.avg((y == p).cast("double")).alias("accuracy"),
        F.try_divide(F.count_if((y == 1) & (p == 1)), F.count_if(y == 1)).alias("recall"),
    ).withColumn("auc", F.lit(float(auc)))


@dataclass(frozen=True)
class LifeModel:
    """Weibull life regression on the log scale; lives were divided by ``scale`` while fitting."""

    model: PipelineModel
    inputs: list[str]
    scale: float
    shape: float
    intercept: float
    coefficients: list[float]

    def log_location(self) -> Column:
        out = F.lit(self.intercept)
        for name, b in zip(self.inputs, self.coefficients):
            out = out + F.lit(float(b)) * F.col(name).cast("double")
        return out

    def median_life(self) -> Column:
        return F.exp(self.log_location()) * math.log(2) ** (1 / self.shape)

    def loglik(self, life: str, observed: str) -> Column:
        """Per-row log-likelihood; censored rows contribute their survival."""
        w = (F.ln(F.col(life)) - self.log_location()) * self.shape
        return F.when(F.col(observed) == 1, math.log(self.shape) - F.ln(F.col(life)) + w).otherwise(0.0) - F.exp(w)


def fit_life(df: DataFrame, life: str, observed: str, inputs: Sequence[str]) -> LifeModel:
    """Accelerated failure time model; lives are scaled by their mean, which is added back."""
    inputs = list(inputs)
    rows = df.where(F.col(life) > 0)
    mean = float(rows.agg(F.avg(life)).first()[0])
    scaled = rows.withColumns({"_life": F.col(life) / mean, "_seen": F.col(observed).cast("double")})
    est = AFTSurvivalRegression(featuresCol=FEATURES, labelCol="_life", censorCol="_seen", predictionCol="predicted")
    model = _fit(est, scaled, inputs, "_life")
    aft = model.stages[-1]
    return LifeModel(model, inputs, mean, 1.0 / float(aft.scale), float(aft.intercept) + math.log(mean), [float(v) for v in aft.coefficients.toArray()])


def score(model: Transformer | LinearModel | HybridModel, df: DataFrame) -> DataFrame:
    """Add ``predicted``; a linear model is a plain column expression."""
    if isinstance(model, LinearModel):
        return df.withColumn("predicted", model.prediction())
    if isinstance(model, PipelineModel) and (looked_up := score_on_cells(model, df)) is not None:
        return looked_up
    return model.transform(df).drop(FEATURES)


# -- metrics and simple tables ----------------------------------------------------------------------


def regression_metrics(scored: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), n_inputs: int = 1) -> DataFrame:
    """MSE, RMSE, MAE, R2 (1 or -1 on a constant target) and adjusted R2."""
    e = F.col(actual) - F.col(predicted)
    a = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(actual) * F.count(F.lit(1))).alias("_sst"),
    )
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).when(F.col("_sse") == 0, 1.0).otherwise(-1.0)
    a = a.withColumns({"rmse": F.sqrt("mse"), "r2": r2})
    spare = F.col("n") - n_inputs - 1
    return a.withColumn(
        "adj_r2", F.when(spare > 0, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / spare).otherwise(F.col("r2"))
    ).drop("_sse", "_sst")


def input_ranges(df: DataFrame, inputs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return long_form(df, inputs, by).groupBy(*by, "column").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


def scaled_effects(model: LinearModel, df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Coefficient times input std, with its sign."""
    coefs = model.table(df).where(F.col("term").isin(*inputs))
    t = input_ranges(df, inputs).join(F.broadcast(coefs), F.col("column") == F.col("term")).drop("term")
    effect = F.col("coefficient") * F.col("std")
    return t.select("column", "coefficient", "std", effect.alias("effect"), F.when(effect < 0, "negative").otherwise("positive").alias("sign"))
