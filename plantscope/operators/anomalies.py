"""Anomaly scenarios: threshold, control, run and deviation events, and their point table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.operators.ordered import OrderedScan, islands, join_on
from plantscope.operators.stats import attach_stats, long_form

ENGINEERING_CONFIDENCE = 0.85  # fixed value: confidence of a user-defined template
CONTROL_SIGMA = 3.0
MIN_CONTROL_ROWS = 10


def confidence(events: Column, total: Column) -> Column:
    """min(0.95, 0.5 + 3.5 * sqrt(share of events)); 0.4 without events."""
    share = F.sqrt(events / F.greatest(total, F.lit(1)))
    return F.when(events == 0, F.lit(0.4)).otherwise(F.least(F.lit(0.95), 0.5 + 3.5 * share))


def _magnitude(hit: Column, deviation: Column) -> list[Column]:
    d = F.when(hit, deviation)
    return [
        F.count_if(hit).alias("n_events"),
        F.count(F.lit(1)).alias("n_total"),
        F.avg(d).alias("dev_mean"),
        F.stddev_pop(d).alias("dev_std"),
        F.min(d).alias("dev_min"),
        F.max(d).alias("dev_max"),
    ]


def _finish(agg: DataFrame, fixed_confidence: float | None = None) -> DataFrame:
    conf = F.lit(fixed_confidence) if fixed_confidence is not None else confidence(F.col("n_events"), F.col("n_total"))
    return agg.withColumns({"probability": F.col("n_events") / F.col("n_total"), "confidence": conf})


def _sides(limits: DataFrame, upper: str, lower: str) -> DataFrame:
    """Config rows (column, upper, lower) as (column, side, threshold); absent limits drop out."""
    return (
        limits.select(
            *[c for c in limits.columns if c not in (upper, lower)],
            F.explode(
                F.array(
                    F.struct(F.lit("above").alias("side"), F.col(upper).cast("double").alias("threshold")),
                    F.struct(F.lit("below").alias("side"), F.col(lower).cast("double").alias("threshold")),
                )
            ).alias("_s"),
        )
        .select("*", "_s.side", "_s.threshold")
        .drop("_s")
        .where(F.col("threshold").isNotNull())
    )


def _known(config: DataFrame, df: DataFrame) -> list[str]:
    """The columns of ``df`` that a config table names."""
    return [r[0] for r in config.select("column").where(F.col("column").isin(df.columns)).distinct().collect()]


def threshold_events(
    df: DataFrame, limits: DataFrame, family: str, upper: str = "usl", lower: str = "lsl", by: Sequence[str] = ()
) -> DataFrame:
    """Spec or manual control events: one row per (column, side), also with zero events.

    ``limits`` is a small config table (column, upper, lower).
    """
    columns = _known(limits, df)
    long = long_form(df, columns, by).where(F.col("value").isNotNull())
    joined = join_on(long, _sides(limits.select("column", upper, lower), upper, lower), ["column"])
    hit = F.when(F.col("side") == "above", F.col("value") > F.col("threshold")).otherwise(
        F.col("value") < F.col("threshold")
    )
    agg = joined.groupBy(*by, "column", "side", "threshold").agg(*_magnitude(hit, F.col("value") - F.col("threshold")))
    return _finish(agg).withColumn("family", F.lit(family))


def auto_control_events(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Events beyond mean -/+ 3 population sigma; only sides with events, n >= 10, sigma > 0."""
    long = long_form(df, columns, by).where(F.col("value").isNotNull())
    stats = long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")
    )
    usable = stats.where((F.col("_n") >= MIN_CONTROL_ROWS) & (F.col("_s") > 0)).select(
        *by, "column",
        (F.col("_m") + CONTROL_SIGMA * F.col("_s")).alias("ucl"),
        (F.col("_m") - CONTROL_SIGMA * F.col("_s")).alias("lcl"),
    )
    limits = _sides(usable, "ucl", "lcl")
    joined = attach_stats(long, limits, [*by, "column"], bounded=not by)
    hit = F.when(F.col("side") == "above", F.col("value") > F.col("threshold")).otherwise(
        F.col("value") < F.col("threshold")
    )
    agg = joined.groupBy(*by, "column", "side", "threshold").agg(*_magnitude(hit, F.col("value") - F.col("threshold")))
    return _finish(agg.where(F.col("n_events") > 0)).withColumn("family", F.lit("control"))


def deviation_events(df: DataFrame, templates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Engineering templates (name, column, target, tolerance): |x - target| > tolerance."""
    columns = _known(templates, df)
    long = long_form(df, columns, by).where(F.col("value").isNotNull())
    usable = templates.where(F.col("target").isNotNull() & F.col("tolerance").isNotNull())
    joined = join_on(long, usable, ["column"])
    hit = F.abs(F.col("value") - F.col("target")) > F.col("tolerance")
    agg = joined.groupBy(*by, "name", "column", "target", "tolerance").agg(
        *_magnitude(hit, F.col("value") - F.col("target"))
    )
    return _finish(agg, ENGINEERING_CONFIDENCE)


def longest_rise(scan: OrderedScan, value: str = "x", min_points: int = 5) -> DataFrame:
    """Longest strictly rising run per series (first one on ties), if it has enough points."""
    keys = scan.series
    stepped = scan.row_number("rn").previous({"_prev": value})
    marked = islands(stepped, F.col(value) > F.col("_prev"), "_run", position=False)
    runs = marked.df.where(F.col("_run_id").isNotNull()).groupBy(*keys, "_run_id").agg(
        F.count(F.lit(1)).alias("_steps"),
        F.min_by("_prev", "rn").alias("start_value"),
        F.max_by(value, "rn").alias("end_value"),
        (F.min("rn") - 2).alias("start_index"),
    )
    # per series: longest, then earliest; a plain aggregate, not a window over all runs
    best = runs.groupBy(*keys).agg(
        F.max_by(
            F.struct("_steps", "start_value", "end_value", "start_index"),
            F.struct(F.col("_steps"), -F.col("start_index")),
        ).alias("_b")
    )
    totals = scan.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))
    out = best.select(*keys, "_b.*").withColumn("run_length", F.col("_steps") + 1).where(F.col("run_length") >= min_points)
    out = join_on(out, totals, keys) if keys else attach_stats(out, totals, keys)
    rise = F.col("end_value") - F.col("start_value")
    return out.select(
        *keys, "run_length", "start_index", "start_value", "end_value",
        rise.alias("total_rise"),
        (rise / F.col("run_length")).alias("mean_step"),
        (F.col("run_length") / F.col("n_total")).alias("probability"),
        confidence(F.col("run_length"), F.col("n_total")).alias("confidence"),
    )


def exceedance_runs(
    scan: OrderedScan, threshold: float, direction: str = "above", value: str = "x", lengths: int = 0
) -> DataFrame:
    """Run count, longest, mean and the first ``lengths`` run lengths in order, per series."""
    if direction not in ("above", "below"):
        raise ValueError("direction must be above or below")
    over = F.col(value) > threshold if direction == "above" else F.col(value) < threshold
    marked = islands(scan, over, position=False)
    runs = marked.df.where(F.col("run_id").isNotNull()).groupBy(*scan.series, "run_id").agg(F.count(F.lit(1)).alias("len"))
    first = F.when(F.col("run_id") <= lengths, F.struct("run_id", "len"))
    agg = runs.groupBy(*scan.series).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.max("len").alias("longest"),
        F.avg("len").alias("mean_length"),
        F.transform(F.sort_array(F.collect_list(first)), lambda s: s["len"]).alias("first_lengths"),
    )
    if not scan.series:
        # a series without any run still gets its row of zeros
        return agg.withColumns({"longest": F.coalesce("longest", F.lit(0)), "mean_length": F.coalesce("mean_length", F.lit(0.0))})
    every = scan.df.select(*scan.series).distinct()
    return join_on(every, agg, scan.series, "left").withColumns(
        {
            "n_runs": F.coalesce("n_runs", F.lit(0)),
            "longest": F.coalesce("longest", F.lit(0)),
            "mean_length": F.coalesce("mean_length", F.lit(0.0)),
            "first_lengths": F.coalesce("first_lengths", F.array().cast("array<bigint>")),
        }
    )


def co_occurrence(df: DataFrame, flags: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Marginals, joint and independent probability and lift - 1 for every pair of event flags.

    All pairs of the given flag *columns* come from one aggregate; no rows are paired.
    """
    names = list(flags)
    flagged = df.select(*by, *[F.coalesce(c, F.lit(False)).cast("double").alias(f"_f{i}") for i, c in enumerate(flags.values())])
    aggs = [F.avg(f"_f{i}").alias(f"_m{i}") for i in range(len(names))]
    pairs = list(combinations(range(len(names)), 2))
    aggs += [F.avg(F.col(f"_f{a}") * F.col(f"_f{b}")).alias(f"_j{a}_{b}") for a, b in pairs]
    row = flagged.groupBy(*by).agg(*aggs)
    entries = F.array(
        *[
            F.struct(
                F.lit(names[a]).alias("left_event"), F.lit(names[b]).alias("right_event"),
                F.col(f"_m{a}").alias("p_left"), F.col(f"_m{b}").alias("p_right"), F.col(f"_j{a}_{b}").alias("p_joint"),
            )
            for a, b in pairs
        ]
    )
    out = row.select(*by, F.explode(entries).alias("_e")).select(*by, "_e.*")
    expected = F.col("p_left") * F.col("p_right")
    return out.withColumns({"p_independent": expected, "lift_minus_1": F.when(expected > 0, F.col("p_joint") / expected - 1).otherwise(0.0)})


def triple_independence(df: DataFrame, flags: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Product of marginals for every three event flags."""
    names = list(flags)
    row = df.groupBy(*by).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(f"_m{i}") for i, c in enumerate(flags.values())])
    entries = F.array(
        *[
            F.struct(
                F.lit(names[a]).alias("first_event"), F.lit(names[b]).alias("second_event"), F.lit(names[c]).alias("third_event"),
                (F.col(f"_m{a}") * F.col(f"_m{b}") * F.col(f"_m{c}")).alias("p_independent"),
            )
            for a, b, c in combinations(range(len(names)), 3)
        ]
    )
    return row.select(*by, F.explode(entries).alias("_e")).select(*by, "_e.*")


def event_points(df: DataFrame, row_keys: Sequence[str], limits: DataFrame, upper: str = "usl", lower: str = "lsl") -> DataFrame:
    """One row per (row key, column, side) beyond its limit."""
    columns = _known(limits, df)
    long = long_form(df, columns, row_keys).where(F.col("value").isNotNull())
    joined = join_on(long, _sides(limits.select("column", upper, lower), upper, lower), ["column"])
    over = (F.col("side") == "above") & (F.col("value") > F.col("threshold"))
    under = (F.col("side") == "below") & (F.col("value") < F.col("threshold"))
    return joined.where(over | under).select(*row_keys, "column", "side", "value", "threshold")


def scenario_points(
    df: DataFrame, row_keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str], spec: DataFrame | None = None,
    control: DataFrame | None = None, templates: DataFrame | None = None, by: Sequence[str] = (), min_points: int = 5,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """The rows behind the events of every scenario, with the scenario's id: one row per (row key, scenario).

    ``spec`` (column, usl, lsl) and ``control`` (column, ucl, lcl) are limits, ``templates`` (name, column, target,
    tolerance) deviations. ``columns`` without control limits of their own get automatic ones, and all of them
    are looked through for their longest rise; both per ``by``. The id is ``family:column:side`` or
    ``engineering:name``, so that it stays the same from run to run; with ``by`` a scenario has its rows in
    every segment. A scenario has as many rows as the operators above count events, those of a rise are the
    points of its run. ``limit`` is the limit passed, null for a rise.

    Rows without a value are in no scenario; neither is a control column whose limits are both null in any.
    """
    keys = list(dict.fromkeys([*by, *row_keys, *order_by]))
    shown = [*by, *[c for c in row_keys if c not in by], "scenario", "family", "column", "side", "value", "limit"]
    manual = _known(control, df) if control is not None else []
    auto = [c for c in columns if c not in manual]
    named = _known(templates, df) if templates is not None else []

    def values(of: Sequence[str]) -> DataFrame:
        return long_form(df, of, keys).where(F.col("value").isNotNull())

    def beyond(rows: DataFrame, family: str, label: str) -> DataFrame:
        over = F.when(F.col("side") == "above", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
        ident = F.concat_ws(":", F.lit(label), "column", "side")
        return rows.where(over).withColumns({"scenario": ident, "family": F.lit(family), "limit": F.col("threshold")}).select(*shown)

    parts = []
    for limits, family, upper, lower in ((spec, "spec", "usl", "lsl"), (control, "control", "ucl", "lcl")):
        of = _known(limits, df) if limits is not None else []
        if of:
            sides = _sides(limits.select("column", upper, lower), upper, lower)
            parts.append(beyond(join_on(values(of), sides, ["column"]), family, family))
    if auto:
        rows = values(auto)
        stats = rows.groupBy(*by, "column").agg(
            F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")
        )
        usable = stats.where((F.col("_n") >= MIN_CONTROL_ROWS) & (F.col("_s") > 0)).select(
            *by, "column", (F.col("_m") + CONTROL_SIGMA * F.col("_s")).alias("ucl"), (F.col("_m") - CONTROL_SIGMA * F.col("_s")).alias("lcl")
        )
        parts.append(beyond(attach_stats(rows, _sides(usable, "ucl", "lcl"), [*by, "column"], bounded=not by), "control", "auto"))
    if columns:
        scan = OrderedScan(values(columns), [*by, "column"], order_by, rows_per_bucket)
        runs = longest_rise(scan, "value", min_points).select(*by, "column", "run_length", "start_index")
        placed = attach_stats(scan.row_number("_place").rows(), runs, [*by, "column"], bounded=not by)
        first = F.col("start_index") + 1  # places count from 1
        inside = F.col("_place").between(first, first + F.col("run_length") - 1)
        parts.append(
            placed.where(inside).withColumns(
                {"scenario": F.concat_ws(":", F.lit("rise"), "column"), "family": F.lit("control"), "side": F.lit("run"), "limit": F.lit(None).cast("double")}
            ).select(*shown)
        )
    if named:
        usable = templates.where(F.col("target").isNotNull() & F.col("tolerance").isNotNull()).select("name", "column", "target", "tolerance")
        rows = join_on(values(named), usable, ["column"])
        away = F.col("value") - F.col("target")
        passed = F.col("target") + F.when(away > 0, F.col("tolerance")).otherwise(-F.col("tolerance"))
        parts.append(
            rows.where(F.abs(away) > F.col("tolerance")).withColumns(
                {
                    "scenario": F.concat_ws(":", F.lit("engineering"), "name"), "family": F.lit("engineering"),
                    "side": F.when(away > 0, "above").otherwise("below"), "limit": passed.cast("double"),
                }
            ).select(*shown)
        )
    if not parts:
        raise ValueError("no scenario: name columns, limits or templates")
    return reduce(DataFrame.unionByName, parts)
