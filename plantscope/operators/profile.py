"""Per-column profile of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.operators.stats import long_text
from plantscope.sources.tables import METADATA_COLUMNS, NUMERIC_SHARE, blank_to_null


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """numeric flag, non-null and distinct count, mean, sample std, min, max, canonical flag.

    All columns share one job: values are unpivoted, partially aggregated per (column, value)
    and then per column, so a column with many values is spread over tasks.
    """
    columns = list(columns or df.columns)
    long = long_text(df, columns).select("column", blank_to_null(F.col("value")).alias("value"))
    number = F.col("value").try_cast("double")
    distinct = F.approx_count_distinct("value") if approximate else F.count_distinct("value")
    agg = long.groupBy("column").agg(
        F.count("value").alias("non_null"),
        distinct.alias("n_distinct"),
        F.count(number).alias("_numeric"),
        F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
    )
    numeric = F.coalesce(F.try_divide(F.col("_numeric"), F.col("non_null")) >= NUMERIC_SHARE, F.lit(False))
    return agg.select(
        "column",
        numeric.alias("is_numeric"),
        "non_null",
        "n_distinct",
        *[F.when(numeric, F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
        F.col("column").isin(*METADATA_COLUMNS).alias("is_metadata"),
    )
