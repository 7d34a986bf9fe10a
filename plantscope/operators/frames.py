"""Filters, design columns, keyed joins and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantscope.operators.stats import attach_stats, finite

# fixed values: hierarchy fields that may be used in a grain filter
GRAIN_FIELDS = ("product_id", "lot_id", "machine_id", "station_id", "process_step", "subgroup_id")
MAX_LEVELS = 1000


# -- filters --------------------------------------------------------------------


def equals_text(df: DataFrame, column: str, value: object) -> Column:
    """Equality with the text form of ``value``. Where the column type is known the literal is
    typed, so that the predicate reaches the Parquet scan."""
    kind = df.schema[column].dataType
    text = str(value)
    if isinstance(kind, T.StringType):
        return F.col(column) == text
    if isinstance(kind, T.IntegralType) and text.lstrip("-").isdigit():
        return F.col(column) == int(text)
    return F.col(column).cast("string") == text


def row_filter(df: DataFrame, column: str, value: object, require_rows: bool = False) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"unknown filter column: {column}")
    if value is None or str(value) == "":
        raise ValueError("the filter needs a value")
    out = df.where(equals_text(df, column, value))
    if require_rows and out.isEmpty():
        raise ValueError(f"no rows with {column} = {value}")
    return out


def grain_filter(df: DataFrame, pairs: Sequence[tuple[str, object]], fields: Sequence[str] = GRAIN_FIELDS) -> DataFrame:
    """Conjunction over hierarchy fields."""
    for name, _ in pairs:
        if name not in fields:
            raise ValueError(f"{name} is not a grain field")
        if name not in df.columns:
            raise ValueError(f"unknown grain field: {name}")
    return df.where(reduce(Column.__and__, [equals_text(df, n, v) for n, v in pairs], F.lit(True)))


def grain_trace(df: DataFrame, predicate: Column) -> DataFrame:
    """Source and analysed row counts in one pass."""
    return df.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(predicate).alias("analysed_rows"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def finite_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every feature is a finite number."""
    return df.where(reduce(Column.__and__, [finite(F.col(c)).isNotNull() for c in columns]))


# -- design columns --------------------------------------------------------------


def design_terms(inputs: Sequence[str], degree: int = 1) -> dict[str, Column]:
    """x, and for degree 2 also x squared and the pairwise products."""
    terms = {c: F.col(c).cast("double") for c in inputs}
    if degree == 2:
        terms |= {f"{c}^2": F.col(c).cast("double") * F.col(c).cast("double") for c in inputs}
        terms |= {f"{a}*{b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in combinations(inputs, 2)}
    return terms


def design_columns(df: DataFrame, inputs: Sequence[str], degree: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[e.alias(n) for n, e in design_terms(inputs, degree).items()])


def factor_levels(df: DataFrame, factors: Sequence[str], limit: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted levels per factor; more than ``limit`` levels is an error, not a truncation."""
    out = {}
    for f in factors:
        rows = df.select(f).where(F.col(f).isNotNull()).distinct().orderBy(f).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"factor {f} has more than {limit} levels")
        out[f] = [r[0] for r in rows]
    return out


def treatment_terms(
    levels: dict[str, list], pairwise: bool = True, three_way: bool = False
) -> tuple[dict[str, Column], dict[str, tuple[str, ...]]]:
    """0/1 columns against the first level, with products for pairs and triples of factors.

    Returns the term expressions and, per term, the factors it belongs to.
    """
    factors = list(levels)
    single = {
        f: [(f"{f}[{lev}]", (F.col(f) == F.lit(lev)).cast("double")) for lev in levels[f][1:]] for f in factors
    }
    terms, owner = {}, {}

    def add(group: tuple[str, ...]):
        combos = [("", None)]
        for f in group:
            combos = [
                (f"{n}:{m}" if n else m, e if acc is None else acc * e) for n, acc in combos for m, e in single[f]
            ]
        for name, expr in combos:
            terms[name], owner[name] = expr, group

    for f in factors:
        add((f,))
    for size in ([2] if pairwise else []) + ([3] if three_way else []):
        for group in combinations(factors, size):
            add(group)
    return terms, owner


def treatment_columns(
    df: DataFrame, factors: Sequence[str], pairwise: bool = True, three_way: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    terms, _ = treatment_terms(factor_levels(df, factors), pairwise, three_way)
    return df.select(*keep, *[e.alias(n) for n, e in terms.items()])


def unseen_levels(df: DataFrame, fitted: DataFrame, factor: str) -> DataFrame:
    """Levels of ``factor`` that the fitted table does not hold."""
    return df.select(factor).where(F.col(factor).isNotNull()).distinct().join(fitted.select(factor).distinct(), factor, "left_anti")


# -- joins -----------------------------------------------------------------------


def match_observed(forecast: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Observed values looked up by time for each forecast row that has one."""
    return forecast.join(observed, list(on), "inner")


def key_zip(left: DataFrame, right: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Pair two equally ordered tables by their order key, never by position."""
    return left.join(right, list(order_by), "inner")


def association_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", suffix: str = "_right"
) -> DataFrame:
    """Join two process-step tables on the association keys; clashing names get a suffix."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: c + suffix for c in clash})
    return left.join(renamed, list(keys), how)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of distinct keys, of keys held by more than one row, and the rows they hold."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    return groups.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("_k") > 1).alias("n_duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("_k"))), F.lit(0)).alias("n_duplicate_rows"),
    )


# -- set operations ----------------------------------------------------------------


def append_rows(history: DataFrame, observed: DataFrame) -> DataFrame:
    return history.unionByName(observed)


def strictly_after(history: DataFrame, observed: DataFrame, time: str) -> DataFrame:
    """Whether every observed row lies after all of history."""
    h = history.agg(F.max(time).alias("history_end"))
    o = observed.agg(F.min(time).alias("observed_start"))
    return attach_stats(h, o, []).withColumn("ordered", F.col("history_end") < F.col("observed_start"))


def _cells(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    return df.groupBy(*factors).agg(F.count(F.lit(1)).alias("n"))


def missing_cells(df: DataFrame, factors: Sequence[str], limit: int = MAX_LEVELS) -> DataFrame:
    """Level combinations that no row holds. Combinations come from exploding the checked level lists."""
    levels = factor_levels(df, factors, limit)
    full = df.sparkSession.range(1)
    for f in factors:
        kind = df.schema[f].dataType
        full = full.withColumn(f, F.explode(F.array(*[F.lit(v).cast(kind) for v in levels[f]])))
    return full.drop("id").join(_cells(df, factors).drop("n"), list(factors), "left_anti")


def duplicate_cells(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    return _cells(df, factors).where(F.col("n") > 1)


def design_coverage(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Counts of missing and repeated combinations, and ready / warning.

    Missing combinations are counted as all combinations of the levels less the observed ones; the
    combinations themselves are never made, so factors may have any number of levels.
    """
    whole = reduce(Column.__and__, [F.col(f).isNotNull() for f in factors])
    cells = _cells(df, factors).agg(F.count_if(whole).alias("_seen"), F.count_if(F.col("n") > 1).alias("n_duplicate"))
    levels = df.agg(*[F.count_distinct(f).alias(f"_{i}") for i, f in enumerate(factors)])
    every = reduce(Column.__mul__, [F.col(f"_{i}") for i in range(len(factors))])
    both = attach_stats(levels.select(every.alias("_every")), cells, [])
    return both.select((F.col("_every") - F.col("_seen")).alias("n_missing"), "n_duplicate").withColumn(
        "status", F.when((F.col("n_missing") == 0) & (F.col("n_duplicate") == 0), "ready").otherwise("warning")
    )


def design_context(df: DataFrame, factors: Sequence[str], n_terms: int) -> DataFrame:
    """Distinct cells, replicate range, and residual degrees of freedom of a model with ``n_terms`` terms."""
    return _cells(df, factors).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.min("n").alias("replicates_min"),
        F.max("n").alias("replicates_max"),
        (F.max("n") > 1).alias("has_replicates"),
        (F.sum("n") - F.lit(n_terms)).alias("residual_df"),
    )


def top_n(df: DataFrame, score: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Ranked report: a bounded sort per task, then one merge of n rows per task."""
    return df.orderBy(F.col(score).desc(), *tiebreak).limit(n)


def top_n_per_group(df: DataFrame, by: Sequence[str], score: str, tiebreak: Sequence[str], n: int) -> DataFrame:
    """Top n per group. A salted first pass keeps n rows per (group, salt), so that a hot group
    is not ranked in one task."""
    order = [F.col(score).desc(), *[F.col(c) for c in tiebreak]]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    few = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r", "_salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def group_coverage(df: DataFrame, group: str, in_validation: Column, by: Sequence[str] = ()) -> DataFrame:
    """Groups seen in validation over all groups: flags fold per group before the count."""
    seen = df.where(F.col(group).isNotNull()).groupBy(*by, group).agg(F.max(in_validation.cast("int")).alias("_in"))
    return seen.groupBy(*by).agg(
        F.count_if(F.col("_in") == 1).alias("groups_seen"),
        F.count(F.lit(1)).alias("groups"),
    ).withColumn("coverage", F.col("groups_seen") / F.col("groups"))
