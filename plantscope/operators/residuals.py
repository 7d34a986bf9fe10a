"""Residual diagnostics on a scored table (actual, predicted), with optional keys and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.functions.special import normal_quantile
from plantscope.operators.distributions import histogram
from plantscope.operators.ordered import OrderedScan, join_on
from plantscope.operators.stats import attach_stats, correlation, quantiles

R = "residual"


def with_residual(scored: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return scored.withColumn(R, F.col(actual) - F.col(predicted))


def residual_stats(res: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample std, skewness and excess kurtosis (both with the sample std), and the heuristic
    normality score skew^2 + kurt^2 with p = max(0, 1 - score / 10)."""
    a = res.groupBy(*by).agg(
        F.count(R).alias("n"), F.avg(R).alias("mean"), F.stddev_samp(R).alias("std"),
        F.skewness(R).alias("_g1"), F.kurtosis(R).alias("_g2"),
    )
    # population moments rescaled to the sample std
    f = (F.col("n") - 1) / F.col("n")
    flat = F.coalesce(F.col("std"), F.lit(0.0)) == 0
    skew = F.when(flat, 0.0).otherwise(F.col("_g1") * F.pow(f, F.lit(1.5)))
    kurt = F.when(flat, 0.0).otherwise((F.col("_g2") + 3) * f * f - 3)
    a = a.withColumns({"skewness": skew, "excess_kurtosis": kurt})
    score = F.col("skewness") * F.col("skewness") + F.col("excess_kurtosis") * F.col("excess_kurtosis")
    p = F.greatest(F.lit(0.0), 1 - score / 10)
    return a.withColumns({"normality_score": score, "normality_p": p, "is_normal": p > 0.05}).drop("_g1", "_g2")


def residual_histogram(res: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """Freedman-Diaconis bins kept within 5 and 10; a log2 rule where the quartiles coincide."""
    rows = res.select(*by, F.col(R).alias("value"))
    stats = rows.groupBy(*by).agg(F.count("value").alias("n"), F.min("value").alias("x_min"), F.max("value").alias("x_max"))
    q = quantiles(rows, by, "value", {"q1": 0.25, "q3": 0.75}, **kw)
    full = join_on(stats, q, by) if by else attach_stats(stats, q, [])
    n = F.col("n").cast("double")
    width = 2 * (F.col("q3") - F.col("q1")) / F.pow(n, F.lit(1 / 3))
    span = F.col("x_max") - F.col("x_min")
    rule = F.least(F.greatest(F.ceil(span / width), F.lit(5)), F.lit(10))
    fallback = F.greatest(F.least(F.ceil(F.log2(n) + 1), F.lit(10)), F.lit(1))
    bins = F.when((width > 0) & (span > 0), rule).otherwise(fallback).cast("int")
    full = full.withColumn("_nb", bins).drop("q1", "q3")
    return histogram(rows, by, full, F.col("_nb")).drop("_n", "_w").withColumnRenamed("_bins", "bins")


def qq_points(res: DataFrame, key: Sequence[str], by: Sequence[str] = (), points: int | None = None, rows_per_bucket: int | None = None) -> DataFrame:
    """Sorted residuals against normal quantiles; ``points`` keeps evenly spaced ranks for a report."""
    rows = res.select(*by, *key, R)
    scan = OrderedScan(rows, by, [R, *key], rows_per_bucket).row_number("rank")
    ranked = scan.attach(rows.groupBy(*by).agg(F.count(R).alias("_n"))).rows()
    if points is not None:
        step = F.greatest(F.floor(F.col("_n") / points), F.lit(1))
        ranked = ranked.where((F.col("rank") - 1) % step == 0)
    ranked = ranked.withColumn("_p", (F.col("rank") - 0.5) / F.col("_n"))
    return ranked.select(*by, *key, "rank", F.col(R).alias("sample"), normal_quantile("_p").alias("theoretical"))


def durbin_watson(res: DataFrame, order_by: Sequence[str], by: Sequence[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    rows = res.select(*by, *order_by, R)
    stepped = OrderedScan(rows, by, order_by, rows_per_bucket).previous({"_prev": R}).df
    step = F.col(R) - F.col("_prev")
    a = stepped.groupBy(*by).agg(F.count(R).alias("n"), F.try_divide(F.sum(step * step), F.sum(F.col(R) * F.col(R))).alias("_dw"))
    dw = F.when(F.col("n") > 1, F.col("_dw")).otherwise(2.0)
    a = a.withColumn("durbin_watson", dw).drop("_dw")
    return a.withColumn(
        "reading", F.when(F.col("durbin_watson") < 1.5, "positive").when(F.col("durbin_watson") > 2.5, "negative").otherwise("none")
    )


def residual_outliers(res: DataFrame, by: Sequence[str] = (), threshold: float = 3.0) -> DataFrame:
    stats = res.groupBy(*by).agg(F.avg(R).alias("_m"), F.stddev_samp(R).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(R) - F.col("_m")) / F.col("_s"))
    return attach_stats(res, stats, by).withColumn("z", z).where(F.abs(F.col("z")) >= threshold).drop("_m", "_s")


def ordered_residuals(res: DataFrame, run_order: str | None, fallback: Sequence[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Residuals with their observation order: the run-order column when usable, else a row number."""
    if run_order is not None:
        return res.withColumns({"observation": F.col(run_order).cast("double"), "order_basis": F.lit(run_order)})
    scan = OrderedScan(res, [], fallback, rows_per_bucket).row_number("_rn")
    return scan.rows().withColumns({"observation": F.col("_rn").cast("double"), "order_basis": F.lit("row_order")}).drop("_rn")


# fixed values: normalised names that mark run order and standard order
RUN_ORDER_NAMES = (
    "run_order", "runorder", "run_sequence", "runsequence", "run_number",
    "運行序", "运行序", "運行次序", "运行次序", "執行序", "执行序",
)
STANDARD_ORDER_NAMES = (
    "standard_order", "standardorder", "standard_number", "標準序", "标准序", "標準次序", "标准次序",
)


def find_order_column(df: DataFrame, names: Sequence[str] = RUN_ORDER_NAMES, unique: bool = True) -> str | None:
    """The column named as an order, if every value is a number and (for run order) distinct."""
    hit = next((c for c in df.columns if c.strip().lower().replace(" ", "_") in names), None)
    if hit is None:
        return None
    v = F.col(hit).cast("string").try_cast("double")
    row = df.agg(F.count(F.lit(1)), F.count(v), F.count_distinct(v)).first()
    good = row[0] == row[1] and (not unique or row[2] == row[0])
    return hit if good else None


def variance_by_quarter(res: DataFrame, order_by: Sequence[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Residual variance in four equal chunks along the order, and whether max > 3 * min."""
    rows = res.select(*order_by, R)
    n = OrderedScan(rows, [], order_by, rows_per_bucket).row_number("_rn")
    sized = n.attach(rows.agg(F.floor(F.count(F.lit(1)) / 4).alias("_size"))).df
    quarter = F.floor((F.col("_rn") - 1) / F.col("_size"))
    v = sized.where((F.col("_size") > 0) & (quarter < 4)).groupBy(quarter.alias("_q")).agg(F.var_pop(R).alias("_v"), F.count(F.lit(1)).alias("_k"))
    return v.agg(F.sum("_k").alias("n"), F.min("_v").alias("min_variance"), F.max("_v").alias("max_variance")).withColumn(
        "heteroscedastic", F.col("max_variance") > 3 * F.col("min_variance")
    )


def residual_correlations(res: DataFrame, inputs: Sequence[str], predicted: str = "predicted") -> DataFrame:
    """Correlation of the residual with every input and of its size with the prediction."""
    wide = res.agg(
        *[correlation(F.col(c), F.col(R)).alias(f"_c{i}") for i, c in enumerate(inputs)],
        correlation(F.col(predicted), F.abs(F.col(R))).alias("_p"),
    )
    rows = [F.struct(F.lit(c).alias("against"), F.col(f"_c{i}").alias("correlation")) for i, c in enumerate(inputs)]
    rows.append(F.struct(F.lit("prediction_and_size").alias("against"), F.col("_p").alias("correlation")))
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
