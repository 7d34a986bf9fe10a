"""Gauge repeatability and reproducibility by the average-and-range method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.functions.constants import GAUGE_D2, GAUGE_D2_DEFAULT
from plantscope.operators.stats import attach_stats, finite


def complete_rows(df: DataFrame, measurement: str, part: str, operator: str) -> DataFrame:
    return df.select(
        finite(F.col(measurement)).alias("m"), F.col(part).cast("string").alias("part"), F.col(operator).cast("string").alias("operator")
    ).na.drop()


def gauge_cells(df: DataFrame, measurement: str, part: str, operator: str) -> DataFrame:
    """Mean, range and count per operator, per part and per cell in one pass (grouping sets)."""
    rows = complete_rows(df, measurement, part, operator)
    level = F.grouping_id()
    return (
        rows.cube("operator", "part")
        .agg(level.alias("_g"), F.count("m").alias("n"), F.avg("m").alias("mean"), (F.max("m") - F.min("m")).alias("range"))
        .select(
            F.when(F.col("_g") == 0, "cell").when(F.col("_g") == 1, "operator").when(F.col("_g") == 2, "part").otherwise("all").alias("level"),
            "operator", "part", "n", "mean", "range",
        )
    )


def gauge_balance(cells: DataFrame) -> DataFrame:
    """Parts, operators, repeats per cell and whether every cell holds the same whole number."""
    c = cells.where(F.col("level") == "cell")
    counts = c.agg(
        F.count_distinct("operator").alias("n_operators"),
        F.count_distinct("part").alias("n_parts"),
        F.count(F.lit(1)).alias("_cells"),
        F.sum("n").alias("n"),
        F.min("n").alias("_lo"),
        F.max("n").alias("_hi"),
    )
    per_cell = F.col("n") / (F.col("n_operators") * F.col("n_parts"))
    full = F.col("_cells") == F.col("n_operators") * F.col("n_parts")
    return counts.withColumns(
        {
            "repeats": F.round(per_cell).cast("int"),
            "balanced": full & (F.col("_lo") == F.col("_hi")) & (F.col("n") >= 3),
        }
    ).drop("_cells", "_lo", "_hi")


def gauge_rr(df: DataFrame, measurement: str, part: str, operator: str, require_balance: bool = True) -> DataFrame:
    """One row: variation components, shares, verdict and warnings."""
    cells = gauge_cells(df, measurement, part, operator)
    balance = gauge_balance(cells)
    if require_balance:
        b = balance.first()
        if not b or not b.balanced:
            raise ValueError("gauge study needs the same whole number of repeats in every operator-part cell")
    level = F.col("level")
    agg = cells.agg(
        F.coalesce(F.avg(F.when((level == "cell") & (F.col("n") >= 2), F.col("range"))), F.lit(0.0)).alias("mean_range"),
        (F.max(F.when(level == "operator", F.col("mean"))) - F.min(F.when(level == "operator", F.col("mean")))).alias("operator_spread"),
        (F.max(F.when(level == "part", F.col("mean"))) - F.min(F.when(level == "part", F.col("mean")))).alias("part_spread"),
    )
    t = attach_stats(balance.drop("balanced"), agg, [])
    d2 = F.lit(GAUGE_D2_DEFAULT)
    for repeats, value in GAUGE_D2.items():
        d2 = F.when(F.col("repeats") == repeats, F.lit(value)).otherwise(d2)
    t = t.withColumn("_d2", d2).withColumn("ev", F.col("mean_range") / F.col("_d2"))
    raw = F.pow(F.col("operator_spread") / F.sqrt("n_operators") / F.col("_d2"), 2) - F.pow("ev", F.lit(2)) / (
        F.col("n_parts") * F.col("repeats")
    )
    t = t.withColumn("av", F.sqrt(F.greatest(raw, F.lit(0.0))))
    t = t.withColumn("grr", F.sqrt(F.col("ev") * F.col("ev") + F.col("av") * F.col("av")))
    t = t.withColumn("pv", F.col("part_spread") / (3 * F.col("_d2")))
    t = t.withColumn("tv", F.sqrt(F.col("grr") * F.col("grr") + F.col("pv") * F.col("pv")))
    share = lambda c: F.when(F.col("tv") > 0, F.col(c) / F.col("tv") * 100).otherwise(0.0)
    t = t.withColumns({"pct_grr": share("grr"), "pct_part": share("pv")})
    verdict = F.when(F.col("pct_grr") < 10, "acceptable").when(F.col("pct_grr") < 30, "marginal").otherwise("unacceptable")
    notes = F.array_compact(
        F.array(
            F.when(F.col("ev") > 2 * F.col("av"), F.lit("repeatability_dominates")),
            F.when(F.col("av") > F.col("ev"), F.lit("reproducibility_significant")),
            F.when(F.col("n_parts") < 5, F.lit("few_parts")),
            F.when(F.col("n_operators") < 2, F.lit("one_operator")),
        )
    )
    return t.withColumns({"verdict": verdict, "warnings": F.concat_ws(",", notes)}).drop("_d2")
