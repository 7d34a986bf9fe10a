"""Control charts, capability and chart-based outliers.

Every operator takes the value column, ``order_by`` (required, unique within a series) and
optional ``series_keys``. Null values are dropped first. Point-level operators run on an
``OrderedScan``; limits are one aggregate per series joined back to the points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantscope.functions import constants as K
from plantscope.operators.ordered import OrderedScan, decayed_sum, islands, join_on
from plantscope.operators.stats import attach_stats, finite, long_form, quantiles

X = "x"


def chart_scan(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    series_keys: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> OrderedScan:
    """Only the columns a chart needs, with the value as double in ``x`` and nulls dropped."""
    keys = list(dict.fromkeys([*series_keys, *order_by]))
    slim = df.select(*keys, finite(F.col(value)).alias(X)).where(F.col(X).isNotNull())
    return OrderedScan(slim, series_keys, order_by, rows_per_bucket)


def _divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


# -- individuals and moving range -----------------------------------------


def moving_range(scan: OrderedScan) -> OrderedScan:
    return scan.previous({"_prev": X}).with_columns({"mr": F.abs(F.col(X) - F.col("_prev"))})


def individuals_limits(scan: OrderedScan) -> DataFrame:
    """One row per series: centre, moving-range mean, sigma and the limits of both charts."""
    agg = moving_range(scan).df.groupBy(*scan.series).agg(
        F.count(X).alias("n"),
        F.avg(X).alias("center"),
        F.stddev_samp(X).alias("sigma_overall"),
        F.coalesce(F.avg("mr"), F.lit(0.0)).alias("mr_bar"),
    )
    sigma = F.col("mr_bar") / K.D2[2]
    return agg.withColumns(
        {
            "sigma": sigma,
            "ucl": F.col("center") + 3 * sigma,
            "lcl": F.col("center") - 3 * sigma,
            "mr_ucl": K.D4[2] * F.col("mr_bar"),
            "mr_lcl": F.lit(0.0),
        }
    )


def _one_spec(spec: DataFrame) -> DataFrame:
    """A specification without series keys is one row; more would multiply every series."""
    if len(spec.take(2)) > 1:
        raise ValueError("a specification without series keys must be one row")
    return spec


def override_limits(limits: DataFrame, manual: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Manual ``ucl``/``lcl`` per series win over the computed ones."""
    if manual is None:
        return limits
    m = manual.select(*keys, F.col("ucl").alias("_mu"), F.col("lcl").alias("_ml"))
    joined = join_on(limits, m, keys, "left")
    return joined.withColumns(
        {"ucl": F.coalesce("_mu", "ucl"), "lcl": F.coalesce("_ml", "lcl")}
    ).drop("_mu", "_ml")


def individuals_points(scan: OrderedScan, limits: DataFrame | None = None) -> DataFrame:
    """Points of the individuals and moving-range charts with their limits and signals."""
    limits = individuals_limits(scan) if limits is None else limits
    cols = [*scan.series, "center", "ucl", "lcl", "mr_bar", "mr_ucl"]
    pts = moving_range(scan).attach(limits.select(*cols)).rows()
    return pts.select(
        *dict.fromkeys(scan.series + scan.order), X, "mr", "center", "ucl", "lcl", "mr_bar", "mr_ucl",
        ((F.col(X) > F.col("ucl")) | (F.col(X) < F.col("lcl"))).alias("out_of_limits"),
        F.coalesce(F.col("mr") > F.col("mr_ucl"), F.lit(False)).alias("mr_out"),
    )


# -- subgroup charts --------------------------------------------------------


def subgroups(scan: OrderedScan, size: int) -> DataFrame:
    """Consecutive subgroups of ``size``; an incomplete tail is dropped."""
    if size not in K.A2:
        raise ValueError("subgroup size must be 2 to 10")
    numbered = scan.row_number("_rn").with_columns({"subgroup": F.floor((F.col("_rn") - 1) / size)})
    return (
        numbered.df.groupBy(*scan.series, "subgroup")
        .agg(
            F.count(X).alias("_k"),
            F.avg(X).alias("mean"),
            (F.max(X) - F.min(X)).alias("range"),
            F.stddev_samp(X).alias("sd"),
        )
        .where(F.col("_k") == size)
        .drop("_k")
    )


def subgroup_limits(groups: DataFrame, size: int, series_keys: Sequence[str], kind: str = "r") -> DataFrame:
    """X-bar/R (``kind="r"``) or X-bar/S (``kind="s"``) limits per series."""
    spread = "range" if kind == "r" else "sd"
    agg = groups.groupBy(*series_keys).agg(
        F.count(F.lit(1)).alias("n_subgroups"), F.avg("mean").alias("center"), F.avg(spread).alias("spread_bar")
    )
    if kind == "r":
        width, low, high, divisor = K.A2[size], K.D3[size], K.D4[size], K.D2[size]
    else:
        width, low, high, divisor = 3.0 / (K.C4[size] * math.sqrt(size)), K.B3[size], K.B4[size], K.C4[size]
    bar = F.col("spread_bar")
    return agg.withColumns(
        {
            "ucl": F.col("center") + width * bar,
            "lcl": F.col("center") - width * bar,
            "spread_ucl": high * bar,
            "spread_lcl": low * bar,
            "sigma": bar / divisor,
            "sigma_mean": bar / divisor / math.sqrt(size),
        }
    )


def subgroup_points(groups: DataFrame, limits: DataFrame, series_keys: Sequence[str], kind: str = "r") -> DataFrame:
    spread = "range" if kind == "r" else "sd"
    cols = [*series_keys, "center", "ucl", "lcl", "spread_ucl", "spread_lcl"]
    pts = attach_stats(groups.select(*series_keys, "subgroup", "mean", spread), limits.select(*cols), series_keys)
    return pts.withColumns(
        {
            "out_of_limits": (F.col("mean") > F.col("ucl")) | (F.col("mean") < F.col("lcl")),
            "spread_out": (F.col(spread) > F.col("spread_ucl")) | (F.col(spread) < F.col("spread_lcl")),
        }
    )


# -- small-shift charts -------------------------------------------------------


def _centred(scan: OrderedScan) -> OrderedScan:
    """Mean and sample sigma of the series, and whether the row is the first one."""
    stats = scan.df.groupBy(*scan.series).agg(
        F.count(X).alias("n"),
        F.avg(X).alias("center"),
        F.coalesce(F.stddev_samp(X), F.lit(0.0)).alias("sd"),
        F.min(F.struct(*scan.order)).alias("_first"),
    )
    marked = scan.attach(stats).with_columns({"_is_first": F.struct(*scan.order) == F.col("_first")})
    return marked._derive(marked.df.drop("_first"))


def ewma_points(scan: OrderedScan, weight: float = 0.2, width: float = 3.0, clamp_lower: bool = False) -> DataFrame:
    """EWMA started at the mean, updated from the second point, constant limits."""
    if not 0 < weight <= 1:
        raise ValueError("weight must lie in (0, 1]")
    ready = _centred(scan).row_number("rn")
    term = F.when(F.col("_is_first"), F.lit(0.0)).otherwise(weight * (F.col(X) - F.col("center")))
    out = decayed_sum(ready, "_dev", term, 1.0 - weight).rows()
    half = width * F.col("sd") * math.sqrt(weight / (2 - weight))
    lower = F.col("center") - half
    return (
        out.withColumns(
            {
                "z": F.col("center") + F.col("_dev"),
                "ucl": F.col("center") + half,
                "lcl": F.greatest(lower, F.lit(0.0)) if clamp_lower else lower,
            }
        )
        .withColumn("signal", (F.col("z") > F.col("ucl")) | (F.col("z") < F.col("lcl")))
        .select(*dict.fromkeys(scan.series + scan.order), "rn", X, "z", "center", "ucl", "lcl", "signal")
    )


def cusum_points(scan: OrderedScan, slack: float = 0.5, decision: float = 5.0) -> DataFrame:
    """Two-sided CUSUM as prefix sum minus its running minimum; the first point counts as zero."""
    ready = _centred(scan)
    z = F.when(F.col("sd") > 0, (F.col(X) - F.col("center")) / F.col("sd"))
    first = F.col("_is_first")
    up = F.when(first | z.isNull(), F.lit(0.0)).otherwise(z - slack)
    down = F.when(first | z.isNull(), F.lit(0.0)).otherwise(-z - slack)
    sums = ready.running({"rn": ("count", F.lit(1)), "_up": ("sum", up), "_down": ("sum", down)})
    lows = sums.running({"_up0": ("min", F.col("_up")), "_down0": ("min", F.col("_down"))})
    return (
        lows.rows()
        .withColumns({"c_plus": F.col("_up") - F.col("_up0"), "c_minus": F.col("_down") - F.col("_down0")})
        .withColumn("signal", (F.col("c_plus") > decision) | (F.col("c_minus") > decision))
        .select(*dict.fromkeys(scan.series + scan.order), "rn", X, "n", "sd", "c_plus", "c_minus", "signal")
    )


def change_points(scan: OrderedScan, slack: float = 0.5, decision: float = 5.0) -> DataFrame:
    """Points where a CUSUM side exceeds the decision value; needs 10 points and some spread."""
    pts = cusum_points(scan, slack, decision)
    return pts.where(F.col("signal") & (F.col("n") >= 10) & (F.col("sd") > 0)).drop("n", "sd", "signal")


def change_point_summary(scan: OrderedScan, slack: float = 0.5, decision: float = 5.0) -> DataFrame:
    """Number of change points and the last value of both CUSUM sides per series."""
    pts = cusum_points(scan, slack, decision)
    usable = (F.col("n") >= 10) & (F.col("sd") > 0)
    return pts.groupBy(*scan.series).agg(
        F.count_if(F.col("signal") & usable).alias("n_change_points"),
        F.max_by(F.when(usable, F.col("c_plus")), "rn").alias("last_plus"),
        F.max_by(F.when(usable, F.col("c_minus")), "rn").alias("last_minus"),
    )


# -- capability ---------------------------------------------------------------


def capability_from(stats: DataFrame, lsl: Column, usl: Column, within: str, overall: str, center: str) -> DataFrame:
    """Add cp, cpk, pp, ppk from columns holding the two sigmas and the mean; both limits needed."""

    def index(sigma: str, one_sided: bool) -> Column:
        s = F.col(sigma)
        if one_sided:
            v = F.least((usl - F.col(center)) / (3 * s), (F.col(center) - lsl) / (3 * s))
        else:
            v = (usl - lsl) / (6 * s)
        return F.when(lsl.isNotNull() & usl.isNotNull() & (s > 0), v)

    return stats.withColumns(
        {
            "cp": index(within, False),
            "cpk": index(within, True),
            "pp": index(overall, False),
            "ppk": index(overall, True),
        }
    )


def capability(scan: OrderedScan, spec: DataFrame, subgroup_size: int = 1) -> DataFrame:
    """Capability per series. ``spec`` holds lsl and usl per series (or one row without keys)."""
    keys = scan.series
    if subgroup_size <= 1:
        stats = individuals_limits(scan).select(
            *keys, "n", F.col("n").alias("n_subgroups"), "center",
            F.coalesce("sigma_overall", F.lit(0.0)).alias("sigma_overall"), F.col("sigma").alias("sigma_within"),
        )
    else:
        base = scan.df.groupBy(*keys).agg(
            F.count(X).alias("n"), F.avg(X).alias("center"), F.coalesce(F.stddev_samp(X), F.lit(0.0)).alias("sigma_overall")
        )
        within = subgroup_limits(subgroups(scan, subgroup_size), subgroup_size, keys).select(
            *keys, "n_subgroups", F.col("sigma").alias("sigma_within")
        )
        stats = join_on(base, within, keys, "left") if keys else attach_stats(base, within, keys)
        # a series shorter than one subgroup falls back to its overall sigma
        stats = stats.withColumns(
            {
                "sigma_within": F.coalesce("sigma_within", "sigma_overall"),
                "n_subgroups": F.coalesce("n_subgroups", F.lit(1)),
            }
        )
    shared = [k for k in keys if k in spec.columns]
    stats = join_on(stats, spec, shared, "left") if shared else attach_stats(stats, _one_spec(spec), [])
    return capability_from(stats, F.col("lsl"), F.col("usl"), "sigma_within", "sigma_overall", "center")


# -- run rules ----------------------------------------------------------------

RULE_LOOKBACK = 20


def _rule_flags(d: DataFrame, w) -> DataFrame:
    """All seven rules over the standardised value ``_z`` and ``x``, each with a bounded look-back.

    A run length is the distance to the last row without the flag: one running maximum per flag,
    where a sliding sum would touch every row of its frame again. Runs longer than the look-back
    only show as too long, which no rule asks about.
    """
    z = F.col("_z")
    d = d.withColumns({"_d": F.col(X) - F.lag(X).over(w), "_at": F.row_number().over(w)})
    flags = {
        "_pos": z > 0,
        "_neg": z < 0,
        "_in1": (z > -1) & (z < 1),
        "_rise": F.coalesce(F.col("_d") > 0, F.lit(False)),
        "_fall": F.coalesce(F.col("_d") < 0, F.lit(False)),
        "_zig": F.coalesce(F.signum("_d") * F.signum(F.lag("_d").over(w)) < 0, F.lit(False)),
    }
    d = d.withColumns(flags)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_miss = {f"{f}_miss": F.max(F.when(~F.col(f), F.col("_at"))).over(so_far) for f in flags}
    level = F.when(F.abs(z) > 2, 2).when(F.abs(z) > 1, 1).otherwise(0) * F.signum(z)

    def beyond(n: int, sigma: int, side: int) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.count_if(level >= sigma if side > 0 else level <= -sigma).over(frame)

    counts = {
        "_hi2": beyond(3, 2, 1), "_lo2": beyond(3, 2, -1), "_hi1": beyond(5, 1, 1), "_lo1": beyond(5, 1, -1),
        "_full3": F.lag(X, 2).over(w).isNotNull(), "_full5": F.lag(X, 4).over(w).isNotNull(),
    }
    d = d.withColumns(last_miss | counts)

    def run_reaches(flag: str, n: int) -> Column:
        return F.col(flag) & (F.col("_at") - F.coalesce(F.col(f"{flag}_miss"), F.lit(0)) == n)

    rules = {
        "_r1": F.abs(z) > 3,
        "_r2": F.col("_full3") & ((F.col("_hi2") >= 2) | (F.col("_lo2") >= 2)),
        "_r3": F.col("_full5") & ((F.col("_hi1") >= 4) | (F.col("_lo1") >= 4)),
        "_r4": run_reaches("_pos", 8) | run_reaches("_neg", 8),
        "_r5": run_reaches("_rise", 5) | run_reaches("_fall", 5),
        "_r6": run_reaches("_in1", 15),
        "_r7": run_reaches("_zig", 12),
    }
    return d.withColumns(rules).drop("_d", "_at", *flags, *last_miss, *counts)


def run_rule_hits(
    scan: OrderedScan, limits: DataFrame, sigma: str = "sigma", rules: Sequence[int] = tuple(K.RULES)
) -> DataFrame:
    """Rows (series, order, x, rule) for every rule violation; rule 2 reports its first hit only."""
    cols = limits.select(*scan.series, F.col("center").alias("_center"), F.col(sigma).alias("_sigma"))
    ready = scan.attach(cols)
    ready = ready.with_columns({"_z": F.when(F.col("_sigma") > 0, (F.col(X) - F.col("_center")) / F.col("_sigma"))})
    ready = ready._derive(ready.df.where(F.col("_z").isNotNull()))
    flagged = ready.bounded(_rule_flags, RULE_LOOKBACK).rows()
    keep = list(dict.fromkeys(scan.series + scan.order))
    names = F.array_compact(F.array(*[F.when(F.col(f"_r{r}"), F.lit(K.RULES[r])) for r in rules]))
    hits = flagged.where(F.size(names) > 0).select(*keep, X, F.explode(names).alias("rule"))
    if 2 not in rules:
        return hits
    second = K.RULES[2]
    first = (
        hits.where(F.col("rule") == second)
        .groupBy(*scan.series)
        .agg(F.min(F.struct(*[c for c in keep if c not in scan.series], X)).alias("_f"))
        .where(F.col("_f").isNotNull())
        .select(*scan.series, "_f.*", F.lit(second).alias("rule"))
    )
    return hits.where(F.col("rule") != second).unionByName(first)


def subgroup_rule_hits(groups: DataFrame, limits: DataFrame, series_keys: Sequence[str], **kw) -> DataFrame:
    """Run rules on subgroup means, with sigma divided by the root of the subgroup size."""
    scan = OrderedScan(groups.select(*series_keys, "subgroup", F.col("mean").alias(X)), series_keys, ["subgroup"])
    return run_rule_hits(scan, limits, "sigma_mean", **kw)


# -- outliers -----------------------------------------------------------------


def iqr_fences(df: DataFrame, value: str, by: Sequence[str] = (), factor: float = 1.5, **kw) -> DataFrame:
    q = quantiles(df.select(*by, finite(F.col(value)).alias(X)), by, X, {"q1": 0.25, "q3": 0.75}, **kw)
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns(
        {"iqr": iqr, "lower_fence": F.col("q1") - factor * iqr, "upper_fence": F.col("q3") + factor * iqr}
    )


def iqr_outliers(df: DataFrame, value: str, by: Sequence[str] = (), factor: float = 1.5, **kw) -> DataFrame:
    """Rows beyond the quartile fences, with the fences."""
    fences = iqr_fences(df, value, by, factor, **kw).select(*by, "lower_fence", "upper_fence")
    out = attach_stats(df, fences, by)
    v = finite(F.col(value))
    return out.where((v < F.col("lower_fence")) | (v > F.col("upper_fence")))


def zscore_outliers(df: DataFrame, value: str, by: Sequence[str] = (), threshold: float = 3.0) -> DataFrame:
    """Rows with |z| above the threshold (sample sigma; none where sigma is zero)."""
    v = finite(F.col(value))
    stats = df.groupBy(*by).agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"))
    out = attach_stats(df, stats, by)
    z = F.when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s"))
    return out.withColumn("zscore", z).where(F.abs(F.col("zscore")) > threshold).drop("_m", "_s")


# -- many columns, many tables --------------------------------------------------


def columns_scan(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], series_keys: Sequence[str] = (), **kw
) -> OrderedScan:
    """Several columns at once: the column name becomes a series key."""
    long = long_form(df, columns, list(dict.fromkeys([*series_keys, *order_by])))
    return chart_scan(long, "value", order_by, [*series_keys, "column"], **kw)


def datasets_scan(
    datasets: dict[str, DataFrame], value: str, order_by: Sequence[str], min_rows: int = 5, **kw
) -> OrderedScan:
    """The same chart over several tables; tables with too few values are left out."""
    union = None
    for name, df in datasets.items():
        part = df.select(*order_by, F.col(value).cast("double").alias(value)).withColumn("dataset", F.lit(name))
        union = part if union is None else union.unionByName(part)
    counts = union.groupBy("dataset").agg(F.count(value).alias("_n"))
    enough = attach_stats(union, counts, ["dataset"], bounded=True).where(F.col("_n") >= min_rows).drop("_n")
    return chart_scan(enough, value, order_by, ["dataset"], **kw)


# -- derived tables -------------------------------------------------------------


def suggest_spec(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Target = mean, limits = mean -/+ 3 sigma, for at least five values with spread."""
    v = finite(F.col(value))
    s = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("target"), F.stddev_samp(v).alias("sigma"))
    return s.where((F.col("n") >= 5) & (F.col("sigma") > 0)).withColumns(
        {"lsl": F.col("target") - 3 * F.col("sigma"), "usl": F.col("target") + 3 * F.col("sigma")}
    )


def process_window(df: DataFrame, inputs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Proposed operating window per input: mean -/+ 3 sigma around the mean."""
    long = long_form(df, inputs, by)
    s = long.groupBy(*by, "column").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("_s"))
    return s.withColumns(
        {"window_low": F.col("center") - 3 * F.col("_s"), "window_high": F.col("center") + 3 * F.col("_s")}
    ).drop("_s")


def trend_insight(scan: OrderedScan, limits: DataFrame) -> DataFrame:
    """First-to-last change, longest same-sign step run and count beyond the limits per series."""
    keys = scan.series
    at = F.struct(*scan.order)
    base = scan.attach(limits.select(*keys, "ucl", "lcl")).df.groupBy(*keys).agg(
        F.min_by(X, at).alias("first_value"),
        F.max_by(X, at).alias("last_value"),
        F.count_if((F.col(X) > F.col("ucl")) | (F.col(X) < F.col("lcl"))).alias("n_beyond"),
    )
    step = scan.previous({"_prev": X}).with_columns({"_step": F.signum(F.col(X) - F.col("_prev"))})
    longest = None
    for sign, name in ((1, "longest_rise"), (-1, "longest_fall")):
        marked = islands(step, F.col("_step") == sign, position=False).df
        lengths = marked.groupBy(*keys, "run_id").agg(F.count("run_id").alias("_len"))
        runs = lengths.groupBy(*keys).agg(F.max("_len").alias(name))
        longest = runs if longest is None else (join_on(longest, runs, keys) if keys else attach_stats(longest, runs, keys))
    out = join_on(base, longest, keys) if keys else attach_stats(base, longest, keys)
    delta = F.col("last_value") - F.col("first_value")
    return out.withColumns(
        {
            "delta": delta,
            "direction": F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat"),
            "longest_run": F.greatest("longest_rise", "longest_fall"),
        }
    ).drop("longest_rise", "longest_fall")


def rule_counts(hits: DataFrame, series_keys: Sequence[str]) -> DataFrame:
    """Violations per series: total and one column per rule."""
    return hits.groupBy(*series_keys).agg(
        F.count(F.lit(1)).alias("n_violations"),
        *[F.count_if(F.col("rule") == name).alias(f"rule_{i}") for i, name in K.RULES.items()],
    )


def spc_summary(scan: OrderedScan, spec: DataFrame) -> DataFrame:
    """Limits, violations and capability per series in one table."""
    keys = scan.series
    limits = individuals_limits(scan)
    hits = rule_counts(run_rule_hits(scan, limits), keys)
    cap = capability_from(
        join_on(limits, spec, [k for k in keys if k in spec.columns], "left")
        if any(k in spec.columns for k in keys)
        else attach_stats(limits, _one_spec(spec), []),
        F.col("lsl"), F.col("usl"), "sigma", "sigma_overall", "center",
    )
    out = join_on(cap, hits, keys, "left") if keys else attach_stats(cap, hits, keys)
    counts = ["n_violations", *[f"rule_{i}" for i in K.RULES]]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def spc_suggestions(summary: DataFrame, series_keys: Sequence[str], small_shift: Column | None = None) -> DataFrame:
    """Improvement hints: low or marginal capability, shift, trend, small shift."""

    def hint(cond: Column, severity: str, kind: str) -> Column:
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type")))

    hints = [
        hint(F.col("cpk") < 1.0, "error", "low_capability"),
        hint((F.col("cpk") >= 1.0) & (F.col("cpk") < 1.33), "warning", "marginal_capability"),
        hint(F.col("rule_4") > 0, "error", "shift_detected"),
        hint(F.col("rule_5") > 0, "warning", "trend_detected"),
    ]
    if small_shift is not None:
        hints.append(hint(small_shift > 0, "warning", "small_shift"))
    return summary.select(*series_keys, F.explode(F.array_compact(F.array(*hints))).alias("_h")).select(
        *series_keys, "_h.severity", "_h.type"
    )
