"""Checks and decisions around a model: applicability, discrepancy, verdicts, credibility, candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.functions.special import t_quantile
from plantscope.operators.models import HybridModel, LinearModel
from plantscope.operators.series_models import SeriesRegression, SeriesTrees, compiled
from plantscope.operators.stats import attach_stats, correlation, finite, quantiles

NEW_FACTOR_BELOW = 5  # a short list of findings ends with the advice to try a new factor
# fixed values: weights and status degrees of the credibility score
WEIGHTS = {
    "data_coverage": 0.15, "predictive_accuracy": 0.25, "stability": 0.20,
    "engineering": 0.10, "validation": 0.15, "extrapolation": 0.15,
}
STATUS_DEGREE = {"approved": 1.0, "validated": 0.7, "pending_validation": 0.4, "draft": 0.2, "retired": 0.0}
DEFAULT_EXTRAPOLATION = 0.8


def applicability(df: DataFrame, inputs: Sequence[str], label: str | None = None) -> DataFrame:
    """Warnings: few rows, class imbalance, constant inputs, collinear inputs (VIF > 10)."""
    inputs = list(inputs)
    complete = df
    for c in inputs:
        complete = complete.where(finite(F.col(c)).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.coalesce(F.min(c) == F.max(c), F.lit(False)).alias(f"const_{i}") for i, c in enumerate(inputs)]
    if label:
        aggs += [F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros")]
    row = df.agg(*aggs).first()
    pairs = [(i, j) for i in range(len(inputs)) for j in range(i + 1, len(inputs))]
    issues = []
    if row.n < 30:
        issues.append(("few_rows", None, float(row.n)))
    if label and row.ones and row.zeros:
        ratio = max(row.ones, row.zeros) / max(min(row.ones, row.zeros), 1)
        if ratio > 4:
            issues.append(("class_imbalance", label, float(ratio)))
    issues += [("constant_input", c, None) for i, c in enumerate(inputs) if row[f"const_{i}"]]
    varying = [i for i in range(len(inputs)) if not row[f"const_{i}"]]
    pairs = [(i, j) for i, j in pairs if i in varying and j in varying]
    if pairs:
        corr = complete.agg(
            F.count(F.lit(1)).alias("n"),
            *[correlation(F.col(inputs[i]), F.col(inputs[j])).alias(f"r{i}_{j}") for i, j in pairs],
        ).first()
        if corr.n >= 10:
            m = np.eye(len(varying))
            for i, j in pairs:
                a, b = varying.index(i), varying.index(j)
                m[a, b] = m[b, a] = float(corr[f"r{i}_{j}"] or 0.0)
            # a null direction of the correlation matrix makes the inputs in it infinitely inflated
            w, v = np.linalg.eigh(m)
            null = w < 1e-10
            vif = np.where((v[:, null] ** 2).sum(axis=1) > 1e-10, np.inf, (v[:, ~null] ** 2 / w[~null]).sum(axis=1))
            issues += [("collinear", inputs[i], float(x)) for i, x in zip(varying, vif) if x > 10]
    return df.sparkSession.createDataFrame(issues, "warning string, column string, value double")


def vif_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Variance inflation of two inputs: 1 / (1 - r^2)."""
    return df.agg(correlation(F.col(a), F.col(b)).alias("r")).select((1 / (1 - F.col("r") * F.col("r"))).alias("vif"))


def discrepancy(scored: DataFrame, first: str, second: str, scale: float | Column, mean_limit: float = 0.15, max_limit: float = 0.30) -> DataFrame:
    """Mean and largest scaled difference of two models' predictions, and whether to review."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    d = F.abs(F.col(first) - F.col(second)) / F.greatest(s, F.lit(1e-12))
    a = scored.agg(F.max(d).alias("max_difference"), F.avg(d).alias("mean_difference"))
    return a.withColumn("needs_review", (F.col("max_difference") > max_limit) | (F.col("mean_difference") > mean_limit))


def recommend_models(profile: DataFrame) -> DataFrame:
    """Model types for rows (n_samples, n_features, is_binary, nonlinear, interpretable), in order."""
    n, k = F.col("n_samples"), F.col("n_features")
    binary, curved, plain = F.col("is_binary"), F.col("nonlinear"), F.col("interpretable")
    small, mid = ~binary & (n < 50), ~binary & (n >= 50) & (n < 200)
    large = ~binary & (n >= 200)
    picks = [
        (binary, "logistic_regression"),
        (small, "linear"),
        (small & (k >= 2), "quadratic"),
        (mid, "quadratic"),
        (mid & curved, "residual_hybrid"),
        (large & plain, "linear"),
        (large & plain, "residual_hybrid"),
        (large & ~plain, "boosted_trees"),
        (~binary & (n >= 100) & ~plain, "random_forest"),
    ]
    names = F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in picks]))
    return profile.withColumn("recommended", F.concat_ws(",", names))


def prediction_interval(scored: DataFrame, rmse: float, n: int, confidence: float = 0.95, predicted: str = "predicted") -> DataFrame:
    """Prediction -/+ t * RMSE * sqrt(1 + 1/n); a point when there is too little to estimate it."""
    half = t_quantile((1 + confidence) / 2, n - 1) * rmse * (1 + 1 / n) ** 0.5 if n >= 4 and rmse > 0 else 0.0
    return scored.withColumns({"lower": F.col(predicted) - half, "upper": F.col(predicted) + half, "half_width": F.lit(float(half))})


def experiment_verdict(experiments: DataFrame) -> DataFrame:
    """Verdict per experiment from error over tolerance; missing tolerances come from the smaller of
    half the spec range and twice the RMSE. Needs predicted, actual, tolerance, spec_range, rmse."""
    half_spec = F.when(F.col("spec_range") > 0, F.col("spec_range") * 0.5)
    band = F.when(F.col("rmse") > 0, 2 * F.col("rmse"))
    limit = F.coalesce(F.col("tolerance"), F.least(half_spec, band))
    ratio = F.abs(F.col("actual") - F.col("predicted")) / F.greatest(limit, F.lit(1e-12))
    verdict = (
        F.when(limit.isNull(), "insufficient_data").when(ratio <= 0.5, "supports").when(ratio <= 1.0, "partially_supports")
        .when(ratio <= 2.0, "does_not_support").otherwise("needs_remodel")
    )
    return experiments.withColumns({"used_tolerance": limit, "verdict": verdict})


def classification_verdict(experiments: DataFrame, target_recall: float = 0.90) -> DataFrame:
    """The same for classifiers with ``accuracy`` and ``recall``."""
    acc, rec = F.col("accuracy") >= 0.80, F.col("recall") >= target_recall
    verdict = (
        F.when(F.col("accuracy").isNull() | F.col("recall").isNull(), "insufficient_data").when(acc & rec, "supports")
        .when(acc | rec, "partially_supports").when(F.col("recall") < target_recall * 0.5, "needs_remodel").otherwise("does_not_support")
    )
    return experiments.withColumn("verdict", verdict)


def confirmation_evidence(experiments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, passes, pass rate and mean absolute error per model."""
    a = experiments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "pass").alias("n_pass"),
        F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mean_abs_error"),
    )
    return a.withColumn("pass_rate", F.col("n_pass") / F.col("n"))


def credibility(model: LinearModel, df: DataFrame, inputs: Sequence[str], status: str = "draft", max_risk: float | None = None, **kw) -> DataFrame:
    """Weighted credibility score and level of a linear model."""
    long = df.select(*[finite(F.col(c)).alias(c) for c in inputs]).unpivot([], list(inputs), "column", "value").where(F.col("value").isNotNull())
    q = quantiles(long, ["column"], "value", {"q05": 0.05, "q95": 0.95}, **kw)
    m = long.groupBy("column").agg(F.avg("value").alias("m"), F.count("value").alias("k"))
    t = attach_stats(q, m, ["column"], bounded=True)
    spread = F.when(F.col("q95") > F.col("q05"), F.col("q95") - F.col("q05")).otherwise(1.0)
    half = F.greatest(F.abs(F.col("m") - F.col("q05")), F.abs(F.col("q95") - F.col("m")), F.lit(1e-9))
    cover = F.when(F.col("k") < 2, 0.5).otherwise(F.least(half / (spread / 2 + 1e-9), F.lit(1.0)))
    coverage = t.agg(F.avg(cover).alias("data_coverage"))
    y = F.col(model.target).cast("double")
    e = y - model.prediction()
    fit = df.agg(F.sqrt(F.avg(e * e)).alias("_rmse"), F.stddev_samp(y).alias("_sy"), (1 - F.avg(e * e) / F.var_pop(y)).alias("_r2"))
    row = attach_stats(coverage, fit, []).withColumns(
        {
            "predictive_accuracy": F.greatest(F.lit(0.0), 1 - F.least(F.col("_rmse") / F.greatest(F.col("_sy"), F.lit(1e-9)), F.lit(1.0))),
            "stability": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_r2"))),
            "engineering": F.lit(1.0 if sum(model.coefficients.values()) > 0 else 0.5),
            "validation": F.lit(STATUS_DEGREE.get(status, 0.2)),
            "extrapolation": F.lit(DEFAULT_EXTRAPOLATION if max_risk is None else max(0.0, 1.0 - max_risk)),
        }
    ).drop("_rmse", "_sy", "_r2")
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    level = (
        F.when(F.col("composite") >= 0.80, "production_ready").when(F.col("composite") >= 0.60, "engineering_reference")
        .when(F.col("composite") >= 0.40, "exploratory").when(F.col("composite") >= 0.20, "needs_more_data").otherwise("not_recommended")
    )
    return row.withColumn("composite", total).withColumn("level", level)


def recommend_experiments(strengths: DataFrame, stats: DataFrame, quarters: DataFrame, ranges: DataFrame, first_input: str, target: str, limit: int | None = None) -> DataFrame:
    """Next experiments: strong interactions with settings, transform, range expansion, replicate, new factor.

    All inputs are small tables (pairs, one residual row, one variance row, one row per input).
    ``limit`` keeps the first ones of the list; without it all are returned.
    """
    r = ranges.select("column", "mean", ((F.col("max") - F.col("min")) / 2).alias("half"))
    left = r.select(F.col("column").alias("left"), F.col("mean").alias("_ml"), F.col("half").alias("_hl"))
    right = r.select(F.col("column").alias("right"), F.col("mean").alias("_mr"), F.col("half").alias("_hr"))
    strong = strengths.where(F.col("strength") > 0.3).join(left, "left").join(right, "right")
    inter = strong.select(
        F.lit(1).alias("_o"), F.lit("interaction").alias("type"), F.when(F.col("strength") > 0.5, "high").otherwise("medium").alias("priority"),
        F.concat_ws(",", "left", "right").alias("factors"), F.col("strength").alias("value"),
        F.concat_ws(";", F.concat_ws(",", (F.col("_ml") - F.col("_hl")).cast("string"), (F.col("_mr") - F.col("_hr")).cast("string")),
                    F.concat_ws(",", (F.col("_ml") + F.col("_hl")).cast("string"), (F.col("_mr") + F.col("_hr")).cast("string"))).alias("settings"),
    )
    none = F.lit(None).cast("string")
    transform = stats.where(F.abs(F.col("skewness")) > 1).select(
        F.lit(2).alias("_o"), F.when(F.col("skewness") > 0, "log_transform").otherwise("sqrt_transform").alias("type"), F.lit("medium").alias("priority"),
        F.lit(target).alias("factors"), F.col("skewness").alias("value"), none.alias("settings"),
    )
    expand = quarters.where((F.col("n") > 10) & F.col("heteroscedastic")).select(
        F.lit(3).alias("_o"), F.lit("range_expansion").alias("type"), F.lit("medium").alias("priority"), F.lit(first_input).alias("factors"),
        (F.col("max_variance") / F.col("min_variance")).alias("value"), none.alias("settings"),
    )
    found = inter.unionByName(transform).unionByName(expand)
    count = found.agg(F.count(F.lit(1)).alias("_c"))
    fill = count.select(
        F.explode(F.array(F.struct(F.lit(4).alias("_o"), F.lit("replicate").alias("type"), (F.col("_c") < 2).alias("_use")),
                          F.struct(F.lit(5).alias("_o"), F.lit("new_factor").alias("type"), (F.col("_c") < NEW_FACTOR_BELOW).alias("_use")))).alias("_f")
    ).where("_f._use").select("_f._o", "_f.type", F.lit("low").alias("priority"), F.lit("").alias("factors"), F.lit(None).cast("double").alias("value"), none.alias("settings"))
    ordered = found.unionByName(fill).orderBy("_o", F.col("value").desc_nulls_last())
    return (ordered if limit is None else ordered.limit(limit)).drop("_o")


# -- candidates and profiles ----------------------------------------------------------------------------

AnyModel = LinearModel | Transformer | HybridModel | SeriesTrees | SeriesRegression | Callable[[DataFrame], DataFrame]


def scored(model: AnyModel, df: DataFrame) -> DataFrame:
    """``df`` with ``predicted`` by a linear model, a fitted pipeline, a hybrid, a model a series, or any
    function that adds the column."""
    if isinstance(model, LinearModel):
        return df.withColumn("predicted", model.prediction())
    if hasattr(model, "transform"):
        return model.transform(df).select(*df.columns, "predicted")
    return model.score(df) if hasattr(model, "score") else model(df)


def next_run_candidates(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Each input at its low and high with the others at their mean, plus the centre point."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in inputs for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg))])

    def setting(reason: str, varied: str | None, which: str) -> Column:
        cols = [
            ((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 if varied is None else F.col(f"{which}_{c}") if c == varied else F.col(f"m_{c}")).cast("double").alias(c)
            for c in inputs
        ]
        return F.struct(F.lit(reason).alias("reason"), F.lit(varied).cast("string").alias("varied"), *cols)

    every = [setting(f"{name}_boundary", c, w) for c in inputs for name, w in (("low", "lo"), ("high", "hi"))]
    return s.select(F.explode(F.array(*every, setting("center_point", None, ""))).alias("_s")).select("_s.*")


def forest_spread(model: PipelineModel | SeriesTrees, candidates: DataFrame) -> DataFrame:
    """Disagreement of the forest's trees at each candidate, highest first; candidates may be any table.

    The trees are arrays that an expression walks, so candidates are scored where they lie, by every tree
    in one pass. A candidate with a missing input has no spread when the forest is one of ``pyspark.ml``.
    """
    trees = model if isinstance(model, SeriesTrees) else compiled(model, candidates.sparkSession)
    rows = trees.attach(candidates).withColumn("_each", trees.values())
    mean = F.aggregate("_each", F.lit(0.0), lambda acc, v: acc + v) / F.size("_each")
    square = F.aggregate("_each", F.lit(0.0), lambda acc, v: acc + F.pow(v - F.col("_mean"), 2)) / F.size("_each")
    known = F.lit(True)
    if trees is not model:
        for c in trees.features:
            known = known & finite(F.col(c)).isNotNull()
    spread = F.when(known, F.sqrt(square))
    out = rows.withColumn("_mean", mean).withColumn("spread", spread).select(*candidates.columns, "spread")
    return out.orderBy(F.col("spread").desc_nulls_last())


def response_grid(model: AnyModel, df: DataFrame, x: str, y: str, inputs: Sequence[str], size: int = 25, by: Sequence[str] = (), **kw) -> DataFrame:
    """Predictions on a grid of two inputs with the others at their median, for every segment at once.

    ``model`` is any model (see ``scored``); the keys of a model a series must be in ``by``.
    """
    lim = df.groupBy(*by).agg(*[f(c).cast("double").alias(f"_{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    others = [c for c in inputs if c not in (x, y)]
    if others:
        long = df.select(*by, *[finite(F.col(c)).alias(c) for c in others]).unpivot(list(by), others, "column", "value")
        med = quantiles(long, [*by, "column"], "value", {"med": 0.5}, **kw)
        wide = med.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("med"))).alias(c) for c in others])
        lim = attach_stats(lim, wide, by)
    step = lambda c, i: F.col(f"_lo_{c}") + F.col(i) * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / (size - 1)
    ticks = F.sequence(F.lit(0), F.lit(size - 1))
    grid = lim.withColumn("_i", F.explode(ticks)).withColumn("_j", F.explode(ticks)).withColumns({x: step(x, "_i"), y: step(y, "_j")})
    return scored(model, grid).select(*by, x, y, *others, "predicted")


def one_at_a_time(model: AnyModel, df: DataFrame, inputs: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """Prediction with one input at low, middle or high and the others at their median, per segment.

    ``model`` is any model (see ``scored``); the keys of a model a series must be in ``by``.
    """
    long = df.select(*by, *[finite(F.col(c)).alias(c) for c in inputs]).unpivot(list(by), list(inputs), "column", "value")
    q = quantiles(long, [*by, "column"], "value", {"lo": 0.0, "med": 0.5, "hi": 1.0}, **kw)
    wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col(n))).alias(f"_{n}_{c}") for c in inputs for n in ("lo", "med", "hi")])
    points = [
        F.struct(F.lit(c).alias("input"), F.lit(name).alias("setting"), value(c).alias("value"),
                 *[(value(c) if i == c else F.col(f"_med_{i}")).alias(i) for i in inputs])
        for c in inputs
        for name, value in (
            ("low", lambda c: F.col(f"_lo_{c}")), ("mid", lambda c: (F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2), ("high", lambda c: F.col(f"_hi_{c}")),
        )
    ]
    rows = wide.select(*by, F.explode(F.array(*points)).alias("_p")).select(*by, "_p.*")
    return scored(model, rows).select(*by, "input", "setting", "value", "predicted")


def best_setting(profile: DataFrame, objective: str, target: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The candidate that maximises, minimises or comes closest to the target."""
    if objective not in ("maximize", "minimize", "target"):
        raise ValueError("objective must be maximize, minimize or target")
    p = F.col("predicted")
    cost = F.abs(p - target) if objective == "target" and target is not None else -p if objective == "maximize" else p
    key = F.struct(cost.alias("c"), F.col("input"), F.col("setting"))
    best = profile.groupBy(*by).agg(F.min_by(F.struct("input", "setting", "value", "predicted"), key).alias("_b"))
    return best.select(*by, "_b.*")
