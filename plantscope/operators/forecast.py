"""Forecasts per series, validation folds and gates, and forecast explanations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.operators.models import LinearModel, regression_metrics
from plantscope.operators.ordered import OrderedScan, join_on
from plantscope.operators.series_models import SeriesRegression, SeriesTrees
from plantscope.operators.stats import attach_stats, finite, quantiles

X = "x"


def numbered_scan(
    df: DataFrame, value: str, order_by: Sequence[str], series_keys: Sequence[str] = (), train_ratio: float = 0.8,
    keep: Sequence[str] = (), rows_per_bucket: int | None = None,
) -> OrderedScan:
    """Series with row number ``rn``, length ``n_series`` and training length ``n_train``."""
    cols = list(dict.fromkeys([*series_keys, *order_by, *keep]))
    rows = df.select(*cols, finite(F.col(value)).alias(X)).where(F.col(X).isNotNull())
    scan = OrderedScan(rows, series_keys, order_by, rows_per_bucket).row_number("rn")
    size = F.count(F.lit(1))
    return scan.attach(
        rows.groupBy(*series_keys).agg(
            size.alias("n_series"), F.greatest(F.lit(1), F.least(size - 1, F.floor(size * train_ratio))).alias("n_train")
        )
    )


def _holdout(scan: OrderedScan) -> DataFrame:
    return scan.rows().where(F.col("rn") > F.col("n_train"))


def naive_forecast(scan: OrderedScan, fixed_horizon: bool = False) -> DataFrame:
    """Hold-out rows with the previous observed value, or the last training value throughout."""
    if not fixed_horizon:
        return _holdout(scan.previous({"predicted": X})).where(F.col("predicted").isNotNull())
    last = scan.df.where(F.col("rn") == F.col("n_train")).select(*scan.series, F.col(X).alias("predicted"))
    return _holdout(scan.attach(last))


def seasonal_forecast(scan: OrderedScan, period: int, fixed_horizon: bool = False) -> DataFrame:
    """Value one period back; with a fixed horizon the last training period repeats."""
    if not fixed_horizon:
        lagged = scan.bounded(lambda d, w: d.withColumn("predicted", F.lag(X, period).over(w)), period)
        return _holdout(lagged).where(F.col("predicted").isNotNull())
    cycle = scan.df.where((F.col("rn") > F.col("n_train") - period) & (F.col("rn") <= F.col("n_train")) & (F.col("n_train") >= period))
    # exactly one period of values per series
    table = cycle.groupBy(*scan.series).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", X))), lambda s: s[X]).alias("_cycle")
    )
    out = _holdout(scan.attach(table))
    at = ((F.col("rn") - F.col("n_train") - 1) % period).cast("int")
    return out.withColumn("predicted", F.get("_cycle", at)).drop("_cycle")


def ar1_parameters(scan: OrderedScan) -> DataFrame:
    """Intercept and slope of x on its previous value over the training rows, per series."""
    lagged = scan.previous({"_prev": X}).df.where((F.col("rn") <= F.col("n_train")) & F.col("_prev").isNotNull())
    return lagged.groupBy(*scan.series).agg(
        F.regr_intercept(X, "_prev").alias("intercept"), F.regr_slope(X, "_prev").alias("phi"), F.count(X).alias("n")
    )


def ar1_forecast(scan: OrderedScan) -> DataFrame:
    """h-step forecast a (1 - phi^h) / (1 - phi) + phi^h x_train for the hold-out rows."""
    last = scan.df.where(F.col("rn") == F.col("n_train")).select(*scan.series, F.col(X).alias("_last"))
    both = join_on(ar1_parameters(scan), last, scan.series) if scan.series else attach_stats(ar1_parameters(scan), last, [])
    out = _holdout(scan.attach(both.drop("n")))
    h = F.col("rn") - F.col("n_train")
    phi, a = F.col("phi"), F.col("intercept")
    power = F.pow(phi, h)
    drift = F.when(F.abs(1 - phi) < 1e-12, a * h).otherwise(a * (1 - power) / F.when(F.abs(1 - phi) >= 1e-12, 1 - phi))
    return out.withColumn("predicted", drift + power * F.col("_last")).drop("intercept", "phi", "_last")


def recursive_forecast(
    scan: OrderedScan, model: LinearModel | SeriesRegression | SeriesTrees, horizon: int, lags: Sequence[int], windows: Sequence[int] = (), held: Sequence[str] = (),
    time: str | None = None, seconds: Column | float | None = None,
) -> DataFrame:
    """Fixed-horizon recursion of a model on the features of ``timeseries.build_features``: linear, or a
    regression, forest or boosted trees a series.

    Each series keeps only its last max(lag, window, 2) training values; its forecasts are appended
    to that array step by step inside one expression, so all series advance together. Lags, rolling mean
    and std, first difference and rate of change are those of the array; hour and weekday those of the
    future stamp, ``seconds`` apart from the last training value of ``time``. Other inputs (``held``) stay
    at their last known value.
    """
    reach = max([*lags, *windows, 2])
    tail = scan.df.where((F.col("rn") <= F.col("n_train")) & (F.col("rn") > F.col("n_train") - reach))
    at = F.struct(*scan.order)
    state = tail.groupBy(*scan.series).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", X))), lambda s: s[X]).alias("_hist"),
        *[F.max_by(c, at).alias(c) for c in dict.fromkeys([*held, *([time] if time else [])])],
    ).where(F.size("_hist") == reach)
    if hasattr(model, "attach"):  # a model a series
        state = model.attach(state)
    if time:
        gap = seconds if isinstance(seconds, Column) else F.lit(float(seconds or 0))
        state = state.withColumns({"_from": F.unix_seconds(F.col(time).cast("timestamp")), "_gap": gap})

    def step(history: Column, h: Column) -> Column:
        one, two = F.element_at(history, -1), F.element_at(history, -2)
        terms = {f"{X}_lag_{k}": F.element_at(history, -k) for k in lags}
        terms |= {f"{X}_first_difference": one - two, f"{X}_rate_of_change": F.try_divide(one, F.nullif(two, F.lit(0.0))) - 1}
        for n in windows:
            recent = F.slice(history, -n, n)
            mean = F.aggregate(recent, F.lit(0.0), lambda acc, v: acc + v) / n
            squares = F.aggregate(recent, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
            terms |= {f"{X}_rolling_mean_{n}": mean, f"{X}_rolling_std_{n}": F.sqrt(squares / (n - 1))}
        if time:
            stamp = F.timestamp_seconds(F.col("_from") + h * F.col("_gap"))
            terms |= {"hour": F.hour(stamp).cast("double"), "weekday": F.weekday(stamp).cast("double")}
        terms |= {c: F.col(c).cast("double") for c in held}
        return model.prediction(terms)

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_hist"), lambda acc, h: F.concat(acc, F.array(step(acc, h))))
    future = state.select(*scan.series, F.posexplode(F.slice(path, reach + 1, horizon)).alias("_h", "predicted"))
    return future.withColumn("step", F.col("_h") + 1).drop("_h")


# -- validation folds and gates ---------------------------------------------------------------


def naive_folds(
    scan: OrderedScan, initial: int, horizon: int, step: int, fixed_horizon: bool = True, confidence: float = 0.95
) -> DataFrame:
    """Validation rows of expanding folds with the naive prediction and its interval.

    A fold's training error is the running sum of squared naive errors at its training end, so no
    row is paired with the folds it trains.
    """
    prev = scan.previous({"_prev": X}).with_columns({"_e": F.col(X) - F.col("_prev")})
    sums = prev.running({"_sse": ("sum", F.col("_e") * F.col("_e")), "_ne": ("count", F.col("_e"))})
    n_folds = F.floor((F.col("n_series") - initial - horizon) / step) + 1
    fold_of = (F.col("rn") - initial) / step
    ends = sums.df.where(((F.col("rn") - initial) % step == 0) & (F.col("rn") >= initial) & (fold_of < n_folds)).select(
        *scan.series, F.floor(fold_of).alias("fold"), F.col(X).alias("_last"), "_sse", "_ne"
    )
    low = F.greatest(F.ceil((F.col("rn") - initial - horizon) / step), F.lit(0))
    high = F.least(F.floor((F.col("rn") - initial - 1) / step), n_folds - 1)
    rows = prev.rows().where((F.col("rn") > initial) & (high >= low)).withColumn("fold", F.explode(F.sequence(low, high)))
    joined = join_on(rows, ends, [*scan.series, "fold"])
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    half = z * F.sqrt(F.col("_sse") / F.col("_ne")) * F.sqrt(1 + 1 / F.col("_ne"))
    predicted = F.col("_last") if fixed_horizon else F.col("_prev")
    out = joined.withColumns({"predicted": predicted, "half_width": half})
    inside = (F.col(X) >= F.col("predicted") - F.col("half_width")) & (F.col(X) <= F.col("predicted") + F.col("half_width"))
    return out.withColumn("covered", inside).drop("_prev", "_e", "_last", "_sse", "_ne")


def fold_metrics(folds: DataFrame, series_keys: Sequence[str] = ()) -> DataFrame:
    return regression_metrics(folds, X, "predicted", [*series_keys, "fold"]).select(*series_keys, "fold", "n", "mae", "rmse", "r2")


def mean_fold_metrics(metrics: DataFrame, series_keys: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*series_keys).agg(
        F.count(F.lit(1)).alias("n_folds"), *[F.avg(c).alias(c) for c in ("mae", "rmse", "r2")]
    )


def interval_coverage(folds: DataFrame, series_keys: Sequence[str] = ()) -> DataFrame:
    """Covered share and mean interval width; the width averages over folds."""
    per_fold = folds.groupBy(*series_keys, "fold").agg(
        F.count_if("covered").alias("_c"), F.count(F.lit(1)).alias("_n"), F.max("half_width").alias("_h")
    )
    return per_fold.groupBy(*series_keys).agg(
        F.sum("_c").alias("covered_rows"), F.sum("_n").alias("evaluated_rows"), F.avg(2 * F.col("_h")).alias("mean_width")
    ).withColumn("coverage", F.col("covered_rows") / F.col("evaluated_rows"))


def gate_decision(summary: DataFrame, min_coverage: float = 0.8, min_groups: float = 1.0) -> DataFrame:
    """Decision from ``leakage_passed``, ``coverage``, ``group_coverage`` (null: not asked) and ``n_folds``."""
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("n_folds"), F.lit(0)) == 0, F.lit("insufficient_history")),
            F.when(~F.col("leakage_passed"), F.lit("observed_validation_target_usage")),
            F.when(F.col("coverage") < min_coverage, F.lit("interval_coverage_below_threshold")),
            F.when(F.col("group_coverage") < min_groups, F.lit("group_coverage_below_threshold")),
        )
    )
    status = F.when(F.coalesce(F.col("n_folds"), F.lit(0)) == 0, "insufficient_history").when(F.size(reasons) == 0, "approved").otherwise("needs_review")
    return summary.withColumns({"gate": status, "reasons": F.concat_ws(",", reasons)})


# -- explanations --------------------------------------------------------------------------------


def block_permutation(
    score, df: DataFrame, target: str, features: Sequence[str], order_by: Sequence[str], block: int = 8, seed: int = 42,
    rows_per_bucket: int | None = None, series_keys: Sequence[str] = (),
) -> DataFrame:
    """MAE increase per series and feature when blocks of consecutive rows take another block's values.

    Blocks of a series are put in a hashed order and each takes the block before it (the first takes the
    last); rows meet by (block, offset). A row without a partner in a shorter block keeps its value. All
    features are scored in one pass: a paired row becomes one row per feature.
    """
    keys = list(series_keys)
    slim = df.select(*dict.fromkeys([*keys, *order_by, target, *features]))
    rows = OrderedScan(slim, keys, order_by, rows_per_bucket).row_number("_rn").rows()
    rows = rows.withColumns({"_block": F.floor((F.col("_rn") - 1) / block), "_at": (F.col("_rn") - 1) % block})
    blocks = rows.select(*keys, "_block").distinct().withColumn("_h", F.xxhash64("_block", F.lit(seed)))
    ring = OrderedScan(blocks, keys, ["_h", "_block"], rows_per_bucket).previous({"_other": "_block"}).rows()
    last = blocks.groupBy(*keys).agg(F.max_by("_block", F.struct("_h", "_block")).alias("_end"))
    ring = attach_stats(ring, last, keys).select(*keys, "_block", F.coalesce("_other", "_end").alias("_other"))
    given = F.struct(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(features)]).alias("_given")
    source = rows.select(*keys, F.col("_block").alias("_other"), "_at", given)
    paired = join_on(join_on(rows, ring, [*keys, "_block"]), source, [*keys, "_other", "_at"], "left")
    error = F.avg(F.abs(F.col(target) - F.col("predicted")))
    base = score(slim).groupBy(*keys).agg(error.alias("baseline_mae"))
    each = paired.select(*keys, target, *[c for c in features if c not in keys], "_given", F.explode(F.array(*[F.lit(c) for c in features])).alias("feature"))
    swap = lambda i, c: F.when((F.col("feature") == c) & F.col("_given").isNotNull(), F.col("_given")[f"_p{i}"]).otherwise(F.col(c))
    swapped = each.select(*keys, target, "feature", *[swap(i, c).alias(c) for i, c in enumerate(features)])
    out = score(swapped).groupBy(*keys, "feature").agg(error.alias("perturbed_mae"))
    return attach_stats(out, base, keys).withColumn("mae_increase", F.col("perturbed_mae") - F.col("baseline_mae"))


def conditional_contrasts(score, df: DataFrame, features: Sequence[str], series_keys: Sequence[str] = (), **kw) -> DataFrame:
    """Per series and pair: mean prediction at the feature's upper minus lower quartile within tertiles of
    the other feature, and the spread of these contrasts.

    All pairs are scored in one pass: a row becomes two rows per pair, at the two quartiles.
    """
    keys = list(series_keys)
    slim = df.select(*keys, *[c for c in features if c not in keys])
    long = slim.select(*keys, *[finite(F.col(c)).alias(c) for c in features]).unpivot(keys, list(features), "column", "value").where(F.col("value").isNotNull())
    q = quantiles(long, [*keys, "column"], "value", {"q25": 0.25, "q75": 0.75, "t1": 1 / 3, "t2": 2 / 3}, **kw)
    points = F.struct("q25", "q75", "t1", "t2")
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, points)).alias(f"_q{i}") for i, c in enumerate(features)])
    at = {c: F.col(f"_q{i}") for i, c in enumerate(features)}
    variants = []
    for f, cond in combinations(features, 2):
        stratum = F.when(F.col(cond) <= at[cond]["t1"], 0).when(F.col(cond) <= at[cond]["t2"], 1).otherwise(2)
        for side, quartile in ((1, "q75"), (-1, "q25")):
            variants.append(F.struct(F.lit(f).alias("f"), F.lit(cond).alias("cond"), stratum.alias("s"), F.lit(side).alias("side"), at[f][quartile].alias("v")))
    each = attach_stats(slim, wide, keys).select(*keys, *[c for c in features if c not in keys], F.explode(F.array(*variants)).alias("_v"))
    moved = each.select(
        *keys, F.col("_v.f").alias("feature"), F.col("_v.cond").alias("conditioning_feature"), F.col("_v.s").alias("_s"), F.col("_v.side").alias("_side"),
        *[F.when(F.col("_v.f") == c, F.col("_v.v")).otherwise(F.col(c)).alias(c) for c in features],
    )
    pair = [*keys, "feature", "conditioning_feature"]
    contrast = F.sum(F.col("predicted") * F.col("_side")) / F.count_if(F.col("_side") == 1)
    return score(moved).groupBy(*pair, "_s").agg(contrast.alias("_c")).groupBy(*pair).agg(
        F.coalesce(F.stddev_pop("_c"), F.lit(0.0)).alias("strength"), F.count(F.lit(1)).alias("n_strata")
    )


# -- comparison with later observations --------------------------------------------------------------


def forecast_errors(forecast: DataFrame, observed: DataFrame, on: Sequence[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    return forecast.join(observed, list(on)).withColumn("delta", F.col(actual) - F.col(predicted))


def error_summary(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("delta"))).alias("mae"), F.sqrt(F.avg(F.col("delta") * F.col("delta"))).alias("rmse")
    )


def before_after(scored: DataFrame, actual: str, before: str, after: str) -> DataFrame:
    """MAE and RMSE of two models on a shared hold-out and whether the second one improved."""
    e1, e2 = F.col(actual) - F.col(before), F.col(actual) - F.col(after)
    a = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e1)).alias("mae_before"), F.avg(F.abs(e2)).alias("mae_after"),
        F.sqrt(F.avg(e1 * e1)).alias("rmse_before"), F.sqrt(F.avg(e2 * e2)).alias("rmse_after"),
    )
    return a.withColumns(
        {"mae_improvement": F.col("mae_before") - F.col("mae_after"), "improved": F.col("mae_after") < F.col("mae_before")}
    )


def path_summary(paths: DataFrame, step: str, value: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Mean and 5, 50, 95 % quantiles of the path values per step."""
    keys = [*by, step]
    mean = paths.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return join_on(mean, quantiles(paths.select(*keys, value), keys, value, {"p05": 0.05, "p50": 0.5, "p95": 0.95}, **kw), keys)


def path_coverage(summary: DataFrame, observed: DataFrame, on: Sequence[str], actual: str) -> DataFrame:
    """Share of observations inside the 5-95 % band of their step."""
    j = attach_stats(observed, summary, list(on))  # few steps, many observations each
    inside = ((F.col(actual) >= F.col("p05")) & (F.col(actual) <= F.col("p95"))).cast("double")
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"))
