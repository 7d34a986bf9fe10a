"""Time-series preparation: parsing, intervals, leak-free features, windows, splits and folds.

Operators take ``series_keys``; features run on an ``OrderedScan`` with a bounded look-back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.operators.ordered import OrderedScan, join_on
from plantscope.operators.stats import attach_stats, finite, quantiles

# fixed values: trailing windows tried, in days
WINDOW_DAYS = (3, 5, 7, 14, 30, 60, 90)
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def _micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


# -- parsing and zones ------------------------------------------------------------


def to_utc(col: Column, zone: str | None = None) -> Column:
    """Text timestamps as UTC: values with an offset keep it, naive ones are in ``zone`` or UTC.

    The session time zone is expected to be UTC.
    """
    text = F.trim(col)
    aware = text.rlike(OFFSET)
    parsed = F.try_to_timestamp(text)
    naive = F.to_utc_timestamp(parsed, zone) if zone else parsed
    return F.when(aware, parsed).otherwise(naive)


def require_one_awareness(df: DataFrame, column: str, zone: str | None) -> None:
    """Naive and offset timestamps must not be mixed without a zone."""
    if zone is not None:
        return
    text = F.trim(F.col(column))
    row = df.agg(F.count_if(text.rlike(OFFSET)), F.count_if(text.isNotNull() & ~text.rlike(OFFSET))).first()
    if row[0] and row[1]:
        raise ValueError("mixed naive and aware timestamps need an explicit zone")


def parse_report(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Missing, unparsable and duplicate timestamps. Counts fold per distinct stamp first."""
    t = df.select(*by, F.col(column).isNull().alias("_null"), F.try_to_timestamp(F.trim(F.col(column).cast("string"))).alias("_t"))
    per_stamp = t.groupBy(*by, "_null", "_t").agg(F.count(F.lit(1)).alias("_k"))
    known = F.col("_t").isNotNull()
    return per_stamp.groupBy(*by).agg(
        F.sum("_k").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_k"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(~F.col("_null") & ~known, F.col("_k"))), F.lit(0)).alias("parse_errors"),
        F.coalesce(F.sum(F.when(known, F.col("_k") - 1)), F.lit(0)).alias("duplicates"),
    )


def interval_summary(
    df: DataFrame, time: str, tiebreak: Sequence[str], series_keys: Sequence[str] = (), rows_per_bucket: int | None = None
) -> DataFrame:
    """Count, min, median and max seconds between consecutive stamps, per series."""
    keep = list(dict.fromkeys([*series_keys, time, *tiebreak]))
    scan = OrderedScan(df.select(*keep).where(F.col(time).isNotNull()), series_keys, [time, *tiebreak], rows_per_bucket)
    scan = scan.with_columns({"_us": _micros(F.col(time))}).previous({"_before": "_us"})
    gaps = scan.rows().select(*series_keys, ((F.col("_us") - F.col("_before")) / 1e6).alias("_s")).where(F.col("_s").isNotNull())
    base = gaps.groupBy(*series_keys).agg(F.count("_s").alias("n_intervals"), F.min("_s").alias("min_seconds"), F.max("_s").alias("max_seconds"))
    median = quantiles(gaps, series_keys, "_s", {"median_seconds": 0.5})
    return join_on(base, median, series_keys) if series_keys else attach_stats(base, median, [])


def frequency_defaults(summary: DataFrame) -> DataFrame:
    """Frequency class with default lags and rolling windows from the median interval."""
    m = F.col("median_seconds")

    def pick(minute, hourly, daily, coarse, unknown):
        lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        return (
            F.when(m.isNull(), lit(unknown)).when(m < 3600, lit(minute)).when(m <= 3600, lit(hourly)).when(m <= 86400, lit(daily)).otherwise(lit(coarse))
        )

    return summary.withColumns(
        {
            "frequency": pick("minute", "hourly", "daily", "coarse", "unknown"),
            "lags": pick([1, 60], [1, 24], [1, 7], [1], [1]),
            "rolling_windows": pick([60], [24], [7], [3], [3]),
        }
    )


# -- features ----------------------------------------------------------------------


def lag_features(scan: OrderedScan, columns: Sequence[str], lags: Sequence[int]) -> OrderedScan:
    def build(d, w):
        return d.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags})

    return scan.bounded(build, max(lags))


def history_features(scan: OrderedScan, columns: Sequence[str], lags: Sequence[int], windows: Sequence[int]) -> OrderedScan:
    """Lags, rolling mean and std that end at the previous row, first difference and rate of change.

    Nothing reads the current row's value, and a rolling value needs its full window.
    """
    if any(w < 2 for w in windows):
        raise ValueError("rolling windows must be at least 2")

    def build(d, w):
        out = {}
        for c in columns:
            for k in lags:
                out[f"{c}_lag_{k}"] = F.lag(c, k).over(w)
            for n in windows:
                past = w.rowsBetween(-n, -1)
                full = F.count(c).over(past) == n
                out[f"{c}_rolling_mean_{n}"] = F.when(full, F.avg(c).over(past))
                out[f"{c}_rolling_std_{n}"] = F.when(full, F.stddev_samp(c).over(past))
            one, two = F.lag(c, 1).over(w), F.lag(c, 2).over(w)
            out[f"{c}_first_difference"] = one - two
            out[f"{c}_rate_of_change"] = F.try_divide(one, F.nullif(two, F.lit(0.0))) - 1
        return d.withColumns(out)

    return scan.bounded(build, max([2, *lags, *windows]))


def feature_names(columns: Sequence[str], lags: Sequence[int], windows: Sequence[int]) -> list[str]:
    names = []
    for c in columns:
        names += [f"{c}_lag_{k}" for k in lags]
        for n in windows:
            names += [f"{c}_rolling_mean_{n}", f"{c}_rolling_std_{n}"]
        names += [f"{c}_first_difference", f"{c}_rate_of_change"]
    return names + ["hour", "weekday"]


def calendar_features(df: DataFrame, time: str, zone: str | None = None) -> DataFrame:
    """Hour and weekday (Monday = 0), in ``zone`` when given."""
    t = F.col(time)
    t = F.from_utc_timestamp(t.cast("timestamp"), zone) if zone else t
    return df.withColumns({"hour": F.hour(t), "weekday": F.weekday(t)})


def build_features(
    df: DataFrame,
    time: str,
    tiebreak: Sequence[str],
    columns: Sequence[str],
    lags: Sequence[int],
    windows: Sequence[int],
    series_keys: Sequence[str] = (),
    zone: str | None = None,
    keep: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """All features with the row number per series, ``is_warmup`` and ``is_complete`` flags."""
    lags, windows = list(dict.fromkeys(lags)), list(dict.fromkeys(windows))
    if any(not isinstance(v, int) or v < 1 for v in [*lags, *windows]):
        raise ValueError("lags and windows must be positive integers")
    cols = list(dict.fromkeys([*series_keys, time, *tiebreak, *keep]))
    slim = df.select(*cols, *[finite(F.col(c)).alias(c) for c in columns if c not in cols])
    scan = OrderedScan(slim, series_keys, [time, *tiebreak], rows_per_bucket)
    scan = history_features(scan.row_number("rn"), columns, lags, windows)
    out = calendar_features(scan.rows(), time, zone)
    names = feature_names(columns, lags, windows)
    warmup = F.col("rn") <= max([2, *lags, *windows])
    complete = F.lit(True)
    for n in names:
        complete = complete & finite(F.col(n)).isNotNull()
    return out.withColumns({"is_warmup": warmup, "is_complete": ~warmup & complete})


def feature_report(features: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Warm-up, incomplete and complete row counts, and missing raw values per column."""
    return features.groupBy(*by).agg(
        F.count_if("is_warmup").alias("warmup_rows"),
        F.count_if(~F.col("is_warmup") & ~F.col("is_complete")).alias("invalid_rows"),
        F.count_if("is_complete").alias("complete_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
    )


def irregular_intervals(df: DataFrame, time: str, tiebreak: Sequence[str], series_keys: Sequence[str] = ()) -> DataFrame:
    """Series whose intervals are not all equal."""
    s = interval_summary(df, time, tiebreak, series_keys)
    return s.select(*series_keys, (F.col("min_seconds") != F.col("max_seconds")).alias("irregular"))


def quick_features(scan: OrderedScan, columns: Sequence[str], windows: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """Lags 1-3, delta, rolling mean and std including the current row, drift from the largest
    window that fits the series. Columns of windows longer than a series are null there."""
    sizes = scan.df.groupBy(*scan.series).agg(F.count(F.lit(1)).alias("_len"))
    ready = scan.attach(sizes)

    def build(d, w):
        out = {}
        for c in columns:
            for k in (1, 2, 3):
                out[f"{c}_lag{k}"] = F.lag(c, k).over(w)
            out[f"{c}_delta"] = F.col(c) - F.lag(c).over(w)
            for n in windows:
                recent = w.rowsBetween(-(n - 1), 0)
                fits = F.col("_len") >= n
                out[f"{c}_roll_mean_{n}"] = F.when(fits, F.avg(c).over(recent))
                out[f"{c}_roll_std_{n}"] = F.when(fits, F.stddev_samp(c).over(recent))
        return d.withColumns(out)

    rows = ready.bounded(build, max([3, *windows])).rows()
    drift = {}
    for c in columns:
        largest = F.coalesce(*[F.col(f"{c}_roll_mean_{n}") for n in sorted(windows, reverse=True)])
        any_fits = F.col("_len") >= min(windows)
        drift[f"{c}_drift"] = F.when(any_fits, F.col(c) - largest).otherwise(0.0)
    return rows.withColumns(drift).drop("_len")


# -- trailing windows ----------------------------------------------------------------


def _end_of_time(df: DataFrame, time: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.max(time).alias("_end"))


def select_time_window(df: DataFrame, time: str, days: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows with max - days < t <= max; undated rows drop out."""
    if not isinstance(days, int) or days < 1:
        raise ValueError("days must be a positive integer")
    out = attach_stats(df, _end_of_time(df, time, by), by)
    return out.where(F.col(time) > F.col("_end") - F.expr(f"INTERVAL {days} DAYS")).drop("_end")


def time_window_summary(df: DataFrame, time: str, days: int, by: Sequence[str] = ()) -> DataFrame:
    rows = attach_stats(df.select(*by, time), _end_of_time(df, time, by), by)
    inside = F.col(time) > F.col("_end") - F.expr(f"INTERVAL {days} DAYS")
    return rows.groupBy(*by).agg(
        F.count_if(F.col(time).isNull()).alias("undated_rows"),
        F.count_if(inside).alias("selected_rows"),
        F.min(F.when(inside, F.col(time))).alias("window_start"),
        F.max(time).alias("window_end"),
    )


def recommend_windows(
    df: DataFrame, time: str, tiebreak: Sequence[str], by: Sequence[str] = (), candidates: Sequence[int] = WINDOW_DAYS
) -> DataFrame:
    """Which trailing windows the observed span (plus one sampling interval) supports."""
    span = df.groupBy(*by).agg(F.min(_micros(F.col(time))).alias("_a"), F.max(_micros(F.col(time))).alias("_b"))
    gaps = interval_summary(df, time, tiebreak, by).select(*by, "median_seconds")
    both = join_on(span, gaps, by, "left") if by else attach_stats(span, gaps, [])
    days = (F.col("_b") - F.col("_a")) / 86_400e6
    out = both.select(
        *by, days.alias("span_days"), (days + F.coalesce("median_seconds", F.lit(0.0)) / 86400).alias("effective_days"),
        F.explode(F.array(*[F.lit(c) for c in candidates])).alias("window_days"),
    )
    return out.withColumn("status", F.when(F.col("effective_days") >= F.col("window_days"), "available").otherwise("insufficient_history"))


# -- splits ---------------------------------------------------------------------------


def _numbered(df: DataFrame, time: str, tiebreak: Sequence[str], by: Sequence[str], rows_per_bucket: int | None) -> OrderedScan:
    scan = OrderedScan(df, by, [time, *tiebreak], rows_per_bucket).row_number("rn")
    return scan.attach(scan.df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_series")))


def time_split(
    df: DataFrame, time: str, tiebreak: Sequence[str], train: float, validation: float, by: Sequence[str] = (), rows_per_bucket: int | None = None
) -> DataFrame:
    """Chronological train / validation / test label per row."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("ratios must be positive and sum to less than 1")
    rows = _numbered(df, time, tiebreak, by, rows_per_bucket).rows()
    first = F.floor(F.col("n_series") * train)
    second = first + F.floor(F.col("n_series") * validation)
    return rows.withColumn(
        "split", F.when(F.col("rn") <= first, "train").when(F.col("rn") <= second, "validation").otherwise("test")
    ).drop("n_series")


def split_ties(split: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Whether a boundary separates rows with equal stamps, per series: a split is valid only without."""
    edges = split.groupBy(*by).agg(
        *[F.max(F.when(F.col("split") == s, F.col(time))).alias(f"_{s}_end") for s in ("train", "validation")],
        *[F.min(F.when(F.col("split") == s, F.col(time))).alias(f"_{s}_start") for s in ("validation", "test")],
    )
    return edges.select(
        *by,
        (F.col("_train_end") >= F.col("_validation_start")).alias("train_validation_tie"),
        (F.col("_validation_end") >= F.col("_test_start")).alias("validation_test_tie"),
    )


def walk_forward_folds(
    df: DataFrame,
    time: str,
    tiebreak: Sequence[str],
    initial: int,
    horizon: int,
    step: int,
    by: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Fold and validation part of every row that is in a validation horizon.

    Fold f trains on rows up to initial + f * step and validates on the next ``horizon``. A row's
    validation folds follow from its row number, so rows are not paired with folds. The training
    part of fold f is ``rn <= train_end`` of that fold; see ``fold_sizes``.
    """
    rows = _numbered(df, time, tiebreak, by, rows_per_bucket).rows()
    n_folds = F.floor((F.col("n_series") - initial - horizon) / step) + 1
    low = F.greatest(F.ceil((F.col("rn") - initial - horizon) / step), F.lit(0))
    high = F.least(F.floor((F.col("rn") - initial - 1) / step), n_folds - 1)
    inside = rows.where((F.col("rn") > initial) & (high >= low))
    return (
        inside.withColumn("fold", F.explode(F.sequence(low, high)))
        .withColumn("train_end", F.lit(initial) + F.col("fold") * step)
        .drop("n_series")
    )


def fold_sizes(validation: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return validation.groupBy(*by, "fold").agg(
        F.max("train_end").alias("train_rows"), F.count(F.lit(1)).alias("validation_rows")
    )


def leakage_check(df: DataFrame, predicted_at: str, sources: Sequence[str], position: Sequence[str]) -> DataFrame:
    """Per source stamp: rows where it lies after the prediction stamp, and the first such row."""
    leak = {s: F.coalesce(F.col(s) > F.col(predicted_at), F.lit(False)) for s in sources}
    key = F.struct(*position)
    wide = df.agg(
        F.count(F.lit(1)).alias("checked_rows"),
        *[F.count_if(c).alias(f"n_{i}") for i, c in enumerate(leak.values())],
        *[F.min(F.when(c, key)).alias(f"f_{i}") for i, c in enumerate(leak.values())],
    )
    rows = F.array(
        *[F.struct(F.lit(s).alias("source"), F.col(f"n_{i}").alias("n_leaks"), F.col(f"f_{i}").alias("_f")) for i, s in enumerate(sources)]
    )
    out = wide.select("checked_rows", F.explode(rows).alias("_r")).select("checked_rows", "_r.source", "_r.n_leaks", "_r._f")
    return out.select(
        "source", "checked_rows", "n_leaks",
        *[F.col(f"_f.{p}").alias(f"first_{p}") for p in position],
        F.when(F.col("n_leaks") == 0, "passed").otherwise("failed").alias("status"),
    )


def feature_provenance(spark, columns: Sequence[str], lags: Sequence[int], windows: Sequence[int]) -> DataFrame:
    """Kind, source column, lag, window and availability of every feature of ``build_features``."""
    rows = []
    for c in columns:
        rows += [(f"{c}_lag_{k}", "lag", c, k, None, "past_only") for k in lags]
        for n in windows:
            rows += [(f"{c}_rolling_{kind}_{n}", f"rolling_{kind}", c, None, n, "past_only") for kind in ("mean", "std")]
        rows += [(f"{c}_first_difference", "first_difference", c, 1, None, "past_only"), (f"{c}_rate_of_change", "rate_of_change", c, 1, None, "past_only")]
    rows += [(n, "calendar", None, None, None, "known_in_advance") for n in ("hour", "weekday")]
    return spark.createDataFrame(rows, "feature string, kind string, source string, lag int, window int, availability string")


def chronological_halves(df: DataFrame, time: str, tiebreak: Sequence[str], by: Sequence[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    """Adaptation rows (first half) and hold-out rows (second half)."""
    rows = _numbered(df, time, tiebreak, by, rows_per_bucket).rows()
    return rows.withColumn("half", F.when(F.col("rn") <= F.floor(F.col("n_series") / 2), "adapt").otherwise("holdout")).drop("n_series")


def sequence_windows(
    df: DataFrame,
    time: str,
    tiebreak: Sequence[str],
    columns: Sequence[str],
    length: int,
    train_ratio: float = 0.8,
    by: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """For each row the previous ``length`` values of every column, scaled by training statistics."""
    slim = df.select(*dict.fromkeys([*by, time, *tiebreak]), *[finite(F.col(c)).alias(c) for c in columns]).na.drop(subset=list(columns))
    scan = _numbered(slim, time, tiebreak, by, rows_per_bucket)
    training = F.col("rn") <= F.floor(F.col("n_series") * train_ratio)
    scaler = scan.df.groupBy(*by).agg(
        *[F.avg(F.when(training, F.col(c))).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(F.when(training, F.col(c))).alias(f"_s_{c}") for c in columns],
    )
    scaled = scan.attach(scaler).with_columns(
        {f"_z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    )

    def build(d, w):
        return d.withColumn("_seq", F.collect_list(F.struct(*[F.col(f"_z_{c}").alias(c) for c in columns])).over(w.rowsBetween(-length, -1)))

    rows = scaled.bounded(build, length).rows().where(F.size("_seq") == length)
    span = max(length - 1, 1)
    position = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i * (2.0 / span) - 1.0)
    return rows.select(
        *dict.fromkeys([*by, time, *tiebreak]), "rn",
        *[F.col(f"_seq.{c}").alias(f"{c}_sequence") for c in columns],
        position.alias("position"),
    )


def usable_sequences(windows: DataFrame, minimum: int, by: Sequence[str] = ()) -> DataFrame:
    return windows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sequences")).withColumn("enough", F.col("n_sequences") >= minimum)
