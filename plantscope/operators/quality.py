"""Data-quality checks. Each check is a lazy table of issues; ``quality_report`` unions them.

Issue rows: check, column, severity, n (how many), then the check's own figures as a JSON text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.functions.constants import MAD_SCALE
from plantscope.operators.ordered import OrderedScan, join_on
from plantscope.operators.stats import attach_stats, long_form, long_text, numeric_columns, quantiles, string_columns

# fixed values: outcome labels counted as good and as bad
GOOD_LABELS = ("OK", "PASS", "1")
BAD_LABELS = ("NG", "FAIL", "0")
OUTCOME_MIN_SHARE = 0.25
BATCH_MIN_RATIO = 0.1
RANGE_MAD_FACTOR = 8.0


def _per_column(df: DataFrame, columns: Sequence[str], aggs: dict[str, callable]) -> DataFrame:
    """One wide aggregate over all columns, turned into one row per column."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[fn(F.col(c)).alias(f"{name}|{i}") for i, c in enumerate(columns) for name, fn in aggs.items()],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"`{name}|{i}`").alias(name) for name in aggs])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select("n_rows", F.explode(rows).alias("_c")).select("n_rows", "_c.*")


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    t = _per_column(df, list(columns or df.columns), {"_known": F.count})
    n = F.col("n_rows") - F.col("_known")
    rate = n / F.greatest(F.col("n_rows"), F.lit(1))
    return t.where(n > 0).select(
        "column", F.when(rate > 0.5, "critical").otherwise("warning").alias("severity"), n.alias("n"), rate.alias("rate")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Copies beyond the first of fully equal rows. Copies fold before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_k"))
    return groups.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("n")).where(F.col("n") > 0)


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """At most one distinct value: min equals max, which needs no distinct count."""
    same = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))
    return _per_column(df, list(columns or df.columns), {"_same": same, "n": F.count}).where("_same").select("column", "n")


def outlier_columns(df: DataFrame, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """IQR outliers per numeric column, classed by robust z; the column takes its most frequent class."""
    long = long_form(df, list(columns or numeric_columns(df))).where(F.col("value").isNotNull())
    q = quantiles(long, ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, **kw)
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumns({"lower": F.col("q1") - 1.5 * iqr, "upper": F.col("q3") + 1.5 * iqr})
    rows = attach_stats(long, q, ["column"], bounded=True).withColumn("_dev", F.abs(F.col("value") - F.col("median")))
    mad = quantiles(rows.select("column", "_dev"), ["column"], "_dev", {"mad": 0.5}, **kw)
    rows = attach_stats(rows, mad, ["column"], bounded=True)
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    z = F.when(F.col("mad") > 0, F.col("_dev") / (MAD_SCALE * F.col("mad")))
    agg = rows.groupBy("column", "q1", "q3", "lower", "upper").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(out).alias("n"),
        F.count_if(out & (z.isNull() | (z >= 10))).alias("n_measurement_error"),
        F.count_if(out & (z >= 5) & (z < 10)).alias("n_process_anomaly"),
        F.count_if(out & (z < 5)).alias("n_undetermined"),
    )
    me, pa, un = F.col("n_measurement_error"), F.col("n_process_anomaly"), F.col("n_undetermined")
    klass = (
        F.when((me >= pa) & (me >= un), "possible_measurement_error")
        .when(pa >= un, "possible_process_anomaly")
        .otherwise("undetermined")
    )
    usable = (F.col("n_values") >= 5) & (F.col("q3") != F.col("q1")) & (F.col("n") > 0)
    return agg.where(usable).select("column", "n", "lower", "upper", me, pa, un, klass.alias("class"))


def time_disorder(df: DataFrame, column: str, position: Sequence[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Rows earlier than the row before them, in ingest order."""
    rows = df.where(F.col(column).isNotNull()).select(*position, F.col(column).alias("_t"))
    stepped = OrderedScan(rows, [], position, rows_per_bucket).previous({"_before": "_t"}).rows()
    return stepped.agg(F.count_if(F.col("_t") < F.col("_before")).alias("n")).where(F.col("n") > 0).select(
        F.lit(column).alias("column"), "n"
    )


def outcome_imbalance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """OK/NG style labels where one side holds less than a quarter of the outcomes."""
    counts = {
        "n_ok": lambda c: F.count_if(F.upper(c.cast("string")).isin(*GOOD_LABELS)),
        "n_ng": lambda c: F.count_if(F.upper(c.cast("string")).isin(*BAD_LABELS)),
    }
    t = _per_column(df, columns, counts)
    total = F.col("n_ok") + F.col("n_ng")
    return t.where((total > 0) & (F.least("n_ok", "n_ng") / total < OUTCOME_MIN_SHARE)).select("column", "n_ok", "n_ng")


def batch_imbalance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest batch below a tenth of the largest; null counts as a batch."""
    sizes = long_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_k"))
    t = sizes.groupBy("column").agg(F.min("_k").alias("smallest"), F.max("_k").alias("largest"))
    return t.where(F.col("smallest") / F.greatest(F.col("largest"), F.lit(1)) < BATCH_MIN_RATIO)


def _number(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def mixed_formats(df: DataFrame, columns: Sequence[str] | None = None, examples: int = 0) -> DataFrame:
    """Text columns with numbers and other text, the rarer kind below half; its ``examples`` smallest values."""
    long = long_text(df, list(columns or string_columns(df))).where(F.col("value").isNotNull())
    kinds = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_k")).withColumn("_num", _number(F.col("value")).isNotNull())
    t = kinds.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("_num"), F.col("_k"))), F.lit(0)).alias("n_numeric"),
        F.coalesce(F.sum(F.when(~F.col("_num"), F.col("_k"))), F.lit(0)).alias("n_other"),
    )
    total = F.col("n_numeric") + F.col("n_other")
    t = t.where((F.least("n_numeric", "n_other") > 0) & (F.least("n_numeric", "n_other") / total < 0.5)).withColumn(
        "_minor_num", F.col("n_numeric") <= F.col("n_other")
    )
    minority = join_on(kinds, F.broadcast(t.select("column", "_minor_num")), ["column"]).where(
        F.col("_num") == F.col("_minor_num")
    )
    # a pass for each example: one value per column and pass, never a list of all values
    found = t
    for i in range(1, examples + 1):
        rest = minority
        if i > 1:
            rest = join_on(minority, F.broadcast(found.select("column", f"example_{i - 1}")), ["column"]).where(
                F.col("value") > F.col(f"example_{i - 1}")
            )
        smallest = rest.groupBy("column").agg(F.min("value").alias(f"example_{i}"))
        found = join_on(found, smallest, ["column"], "left")
    return found.drop("_minor_num")


def unit_suffixes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trailing unit text per column with its count."""
    long = long_text(df, list(columns or string_columns(df))).where(F.col("value").isNotNull())
    unit = F.lower(F.regexp_extract(F.trim("value"), "([a-zA-Z°]+)$", 1))
    return long.select("column", unit.alias("unit")).where(F.col("unit") != "").groupBy("column", "unit").agg(
        F.count(F.lit(1)).alias("n")
    )


def mixed_units(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with more than one unit, one row per (column, unit)."""
    units = unit_suffixes(df, columns)
    several = units.groupBy("column").agg(F.count(F.lit(1)).alias("n_units")).where(F.col("n_units") > 1)
    return join_on(units, F.broadcast(several), ["column"])


def out_of_range(
    df: DataFrame, columns: Sequence[str] | None = None, ranges: DataFrame | None = None, **kw
) -> DataFrame:
    """Values outside a given (column, low, high), else outside median -/+ 8 scaled MAD."""
    cols = list(columns or numeric_columns(df))
    long = long_form(df, cols).where(F.col("value").isNotNull())
    med = quantiles(long, ["column"], "value", {"median": 0.5}, **kw)
    rows = attach_stats(long, med, ["column"], bounded=True)
    rows = rows.withColumn("_dev", F.abs(F.col("value") - F.col("median")))
    mad = quantiles(rows.select("column", "_dev"), ["column"], "_dev", {"mad": 0.5}, **kw)
    limits = join_on(med, mad, ["column"])
    half = F.when(F.col("mad") > 0, RANGE_MAD_FACTOR * MAD_SCALE * F.col("mad"))
    if ranges is not None:
        limits = join_on(limits, ranges.select("column", "low", "high"), ["column"], "left")
        given = F.col("low").isNotNull() | F.col("high").isNotNull()
        low = F.when(given, F.col("low")).otherwise(F.col("median") - half)
        high = F.when(given, F.col("high")).otherwise(F.col("median") + half)
    else:
        low, high = F.col("median") - half, F.col("median") + half
    limits = limits.select("column", low.alias("range_low"), high.alias("range_high"))
    checked = attach_stats(long, limits, ["column"], bounded=True)
    out = F.coalesce(F.col("value") < F.col("range_low"), F.lit(False)) | F.coalesce(
        F.col("value") > F.col("range_high"), F.lit(False)
    )
    return (
        checked.groupBy("column", "range_low", "range_high")
        .agg(F.count_if(out).alias("n"), F.count(F.lit(1)).alias("_all"))
        .where((F.col("n") > 0) & (F.col("_all") >= 3))
        .drop("_all")
    )


def missing_spec(outputs: DataFrame, spec: DataFrame) -> DataFrame:
    """Output columns (a table with ``column``) that have neither limit in the spec table."""
    usable = spec.where(F.col("lsl").isNotNull() | F.col("usl").isNotNull()).select("column")
    return outputs.select("column").join(usable, "column", "left_anti")


def _issues(check: str, table: DataFrame, severity: str | None = None, n: str = "n") -> DataFrame:
    column = F.col("column") if "column" in table.columns else F.lit(None).cast("string")
    rest = [c for c in table.columns if c not in ("column", "severity")]
    return table.select(
        F.lit(check).alias("check"),
        column.alias("column"),
        (F.lit(severity) if severity else F.col("severity")).alias("severity"),
        F.col(n).cast("long").alias("n"),
        F.to_json(F.struct(*rest)).alias("detail") if rest else F.lit("{}").alias("detail"),
    )


def quality_report(
    df: DataFrame,
    *,
    position: Sequence[str] = (),
    categorical: Sequence[str] = (),
    outcomes: Sequence[str] = (),
    timestamps: Sequence[str] = (),
    batches: Sequence[str] = (),
    inputs: Sequence[str] = (),
    outputs: Sequence[str] = (),
    ranges: DataFrame | None = None,
    spec: DataFrame | None = None,
) -> DataFrame:
    """All checks in one issue table."""
    spark = df.sparkSession
    numeric = [c for c in numeric_columns(df) if c not in categorical]
    parts = [
        _issues("missing_value", missing_values(df)),
        _issues("duplicate", duplicate_rows(df), "warning"),
        _issues("constant_column", constant_columns(df), "warning"),
        _issues("outlier", outlier_columns(df, numeric), "warning"),
        _issues("invalid_format", mixed_formats(df), "warning", "n_other"),
        _issues("unit_mixing", mixed_units(df).groupBy("column").agg(F.max("n_units").alias("n")), "warning"),
        _issues("input_out_of_range", out_of_range(df, inputs or numeric, ranges), "warning"),
    ]
    if timestamps and not position:
        raise ValueError("the time-order check needs the ingest position")
    parts += [_issues("time_order", time_disorder(df, c, position), "warning") for c in timestamps]
    if outcomes:
        parts.append(_issues("unbalanced_outcome", outcome_imbalance(df, outcomes), "warning", "n_ng"))
    if batches:
        parts.append(_issues("batch_imbalance", batch_imbalance(df, batches), "info", "smallest"))
    if outputs:
        table = spark.createDataFrame([(c,) for c in outputs if c in df.columns], "column string")
        known = spec if spec is not None else spark.createDataFrame([], "column string, lsl double, usl double")
        parts.append(_issues("missing_spec", missing_spec(table, known).withColumn("n", F.lit(1)), "warning"))
    return reduce(DataFrame.unionByName, parts)


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues per severity, zero included."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "critical")])
