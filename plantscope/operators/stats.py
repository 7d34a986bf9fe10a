"""Shared aggregates: exact quantiles, statistics joined back to rows, long column form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantscope.operators.ordered import BROADCAST_SERIES, OrderedScan, join_on

PERCENTILE_ROWS = 5_000_000
SALTS = 64


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def finite(col: Column) -> Column:
    """Null out NaN and infinities."""
    c = col.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; null where a side is constant (the built-in raises under ANSI mode)."""
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, column, value): all numeric columns in one pass; one job serves every column."""
    casted = df.select(*keep, *[finite(F.col(c)).alias(c) for c in columns])
    return casted.unpivot(list(keep), list(columns), "column", "value")


def long_text(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, column, value) with every value as text."""
    casted = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return casted.unpivot(list(keep), list(columns), "column", "value")


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Join one row per key back to the rows.

    ``bounded``: the caller knows the number of keys is small (column names, config rows).
    Otherwise the number of keys is checked; above the limit the big side is salted so that a
    hot key does not land in one task.
    """
    if not keys:
        one = F.lit(1)
        return df.withColumn("__one", one).join(F.broadcast(stats.withColumn("__one", one)), "__one").drop("__one")
    if bounded:
        return join_on(df, F.broadcast(stats), keys)
    n_keys = df.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    if n_keys <= BROADCAST_SERIES:
        return join_on(df, F.broadcast(stats), keys)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(salted, copies, [*keys, "__salt"]).drop("__salt")


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    rows_limit: int | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per key, one column per probability.

    Up to ``rows_limit`` rows the built-in exact percentile is used. Beyond it, a percentile
    buffer would hold all values of a key in one task; ranks over the (key, value) counts are
    used instead, which scale out for one key as for many.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    limit = PERCENTILE_ROWS if rows_limit is None else rows_limit
    if rows.count() <= limit:
        # one buffer for all probabilities
        every = rows.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_every"))
        return every.select(*by, *[F.get("_every", F.lit(i)).alias(n) for i, n in enumerate(probs)])
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    ranked = OrderedScan(counts, by, [value], rows_per_bucket).running({"_upto": ("sum", F.col("_k"))})
    totals = counts.groupBy(*by).agg(F.sum("_k").alias("_total"))
    full = ranked.attach(totals).rows()

    def at(position: Column) -> Column:
        inside = (F.col("_upto") - F.col("_k") <= position) & (position < F.col("_upto"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    aggs = [F.max("_total").alias("_total")]
    for i, p in enumerate(probs.values()):
        h = F.lit(p) * (F.col("_total") - 1)
        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}")]
    found = full.groupBy(*by).agg(*aggs)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        h = F.lit(p) * (F.col("_total") - 1)
        out.append((F.col(f"_lo{i}") + (h - F.floor(h)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name))
    return found.select(*by, *out)


def median_mad(df: DataFrame, by: Sequence[str], value: str, bounded: bool = False, **kw) -> DataFrame:
    """Median and median absolute deviation per key."""
    med = quantiles(df, by, value, {"median": 0.5}, **kw)
    dev = attach_stats(df.select(*by, value), med, by, bounded).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    return join_on(med, quantiles(dev, by, "_dev", {"mad": 0.5}, **kw), list(by)) if by else attach_stats(
        med, quantiles(dev, by, "_dev", {"mad": 0.5}, **kw), by
    )
