"""Pre-model readiness: one row per input or output column with figures, best fit, issues and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.operators.distributions import fit_distributions
from plantscope.operators.ordered import join_on
from plantscope.operators.stats import finite

# fixed values: roles that take part in modelling
MODEL_ROLES = ("input", "process_input", "material_input", "output")


def readiness(df: DataFrame, roles: dict[str, str], spec: DataFrame | None = None, families: Sequence[str] | None = None) -> DataFrame:
    """Diagnostics of every column with a modelling role.

    ``spec`` holds (column, lsl, usl). All columns share one unpivoted pass for the figures and
    one set of fitting passes; the result has one row per column.
    """
    chosen = {c: r for c, r in roles.items() if r in MODEL_ROLES and c in df.columns}
    if not chosen:
        raise ValueError("no column has a modelling role")
    spark = df.sparkSession
    numeric = df.select(*[finite(F.col(c).cast("string").try_cast("double")).alias(c) for c in chosen])
    long = numeric.unpivot([], list(chosen), "column", "value")
    stats = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("value").alias("n_valid"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.count_distinct("value").alias("n_distinct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).otherwise(F.when(F.count("value") == 1, 0.0)).alias("std"),
    )
    best = fit_distributions(long, "value", ["column"], 1, families).select("column", F.col("family").alias("best_family"))
    role = spark.createDataFrame(list(chosen.items()), "column string, role string")
    t = join_on(join_on(stats, F.broadcast(role), ["column"]), F.broadcast(best), ["column"], "left")
    if spec is not None:
        usable = spec.where(F.col("lsl").isNotNull() | F.col("usl").isNotNull()).select("column", F.lit(True).alias("_spec"))
        t = join_on(t, F.broadcast(usable), ["column"], "left")
    else:
        t = t.withColumn("_spec", F.lit(None).cast("boolean"))
    rate = F.col("n_missing") / F.greatest(F.col("n_rows"), F.lit(1))
    issue = lambda cond, code, severity: F.when(cond, F.struct(F.lit(code).alias("code"), severity.alias("severity")))
    warning, critical = F.lit("warning"), F.lit("critical")
    issues = F.array_compact(
        F.array(
            issue(F.col("n_valid") == 0, "no_numeric_values", critical),
            issue((F.col("n_valid") > 0) & (F.col("n_distinct") <= 1), "constant_column", warning),
            issue(F.col("n_missing") > 0, "missing_values", F.when(rate > 0.5, critical).otherwise(warning)),
            issue((F.col("role") == "output") & F.col("_spec").isNull(), "missing_spec", warning),
        )
    )
    t = t.withColumn("_issues", issues)
    worst = F.exists("_issues", lambda i: i["severity"] == "critical")
    return t.select(
        "column", "role", "n_rows", "n_valid", "n_missing", "n_distinct", "min", "max", "mean", "std", "best_family",
        F.concat_ws(",", F.transform("_issues", lambda i: i["code"])).alias("issues"),
        F.when(worst, "critical").when(F.size("_issues") > 0, "warning").otherwise("info").alias("status"),
    )


def overall_status(diagnostics: DataFrame) -> DataFrame:
    """Worst status over all columns."""
    rank = F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0)
    return diagnostics.agg(F.max(rank).alias("_r"), F.count(F.lit(1)).alias("n_columns")).select(
        F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), F.col("_r") + 1).alias("status"), "n_columns"
    )
