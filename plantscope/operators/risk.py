"""Specification-risk summaries over any table of outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantscope.operators.control_charts import capability, chart_scan
from plantscope.operators.distributions import histogram_table, value_rows
from plantscope.operators.ordered import OrderedScan, join_on
from plantscope.operators.stats import attach_stats, finite, quantiles

# fixed values: percentiles reported for an outcome
PERCENTILES = {"p0_1": 0.001, "p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}


def bootstrap_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42, rows_per_bucket: int | None = None) -> DataFrame:
    """``n`` whole rows drawn with replacement. Draws are hashed row numbers, so the sample does
    not depend on the partitioning; each draw meets its row by an equi-join."""
    scan = OrderedScan(df, [], key, rows_per_bucket).row_number("_rn")
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(scan.n_rows, 1))) + 1).alias("_rn")
    )
    return scan.rows().join(draws, "_rn").drop("_rn")


def _out(v: Column, lsl: float | None, usl: float | None) -> Column:
    below = v < lsl if lsl is not None else F.lit(False)
    above = v > usl if usl is not None else F.lit(False)
    return F.coalesce(below | above, F.lit(False))


def spec_risk(df: DataFrame, value: str, lsl: float | None, usl: float | None, by: Sequence[str] = ()) -> DataFrame:
    """Rows outside the limits, their share, DPMO and z to each limit. A limit of 0 is a limit."""
    v = finite(F.col(value))
    a = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"), F.count_if(_out(v, lsl, usl)).alias("ng_count")
    )
    p = F.try_divide(F.col("ng_count"), F.col("n"))
    z = lambda e: F.when(F.col("std") > 0, e / F.col("std"))
    return a.withColumns(
        {
            "ng_probability": p,
            "dpmo": p * 1e6 if lsl is not None or usl is not None else F.lit(None).cast("double"),
            "z_lsl": z(F.col("mean") - lsl) if lsl is not None else F.lit(None).cast("double"),
            "z_usl": z(usl - F.col("mean")) if usl is not None else F.lit(None).cast("double"),
        }
    )


def percentiles(df: DataFrame, value: str, by: Sequence[str] = (), **kw) -> DataFrame:
    rows = value_rows(df, value, by)
    a = rows.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    q = quantiles(rows, by, "value", PERCENTILES, **kw)
    return join_on(a, q, by) if by else attach_stats(a, q, [])


def outcome_histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 30) -> DataFrame:
    h = histogram_table(df, value, by, bins)
    return h.withColumn("center", (F.col("left") + F.col("right")) / 2)


def empirical_cdf(df: DataFrame, value: str, by: Sequence[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    """Cumulative share per distinct value: counts first, then one ordered scan over the counts."""
    counts = value_rows(df, value, by).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_k"))
    scan = OrderedScan(counts, by, ["value"], rows_per_bucket).running({"_upto": ("sum", F.col("_k"))})
    full = scan.attach(counts.groupBy(*by).agg(F.sum("_k").alias("_n"))).rows()
    return full.select(*by, "value", (F.col("_upto") / F.col("_n")).alias("cdf"))


def five_numbers(df: DataFrame, value: str, by: Sequence[str] = (), **kw) -> DataFrame:
    return quantiles(value_rows(df, value, by), by, "value", {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, **kw)


def extrapolation_rate(df: DataFrame, training: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Rows with any input outside its training range."""
    r = training.agg(*[F.min(c).alias(f"_lo_{c}") for c in inputs], *[F.max(c).alias(f"_hi_{c}") for c in inputs])
    rows = attach_stats(df.select(*inputs), r, [])
    out = F.lit(False)
    for c in inputs:
        out = out | F.coalesce((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}")), F.lit(False))
    return rows.agg(F.count_if(out).alias("n_extrapolated"), F.avg(out.cast("double")).alias("rate"))


def compare_outcomes(baseline: DataFrame, candidate: DataFrame, value: str, lsl: float | None, usl: float | None) -> DataFrame:
    """Mean shift, relative shift, std reduction and DPMO of two outcome tables."""
    cols = lambda s: [F.col("mean").alias(f"mean_{s}"), F.col("std").alias(f"std_{s}"), F.col("dpmo").alias(f"dpmo_{s}")]
    b = spec_risk(baseline, value, lsl, usl).select(*cols("baseline"))
    c = spec_risk(candidate, value, lsl, usl).select(*cols("candidate"))
    return _compared(attach_stats(b, c, []))


def compare_groups(df: DataFrame, value: str, lsl: float | None, usl: float | None, by: str, baseline: object) -> DataFrame:
    """``compare_outcomes`` of every other value of ``by`` with one of them, in one aggregate of all rows."""
    risk = spec_risk(df, value, lsl, usl, [by])
    cols = lambda s: [F.col("mean").alias(f"mean_{s}"), F.col("std").alias(f"std_{s}"), F.col("dpmo").alias(f"dpmo_{s}")]
    own = F.col(by).eqNullSafe(F.lit(baseline))
    return _compared(attach_stats(risk.where(~own).select(by, *cols("candidate")), risk.where(own).select(*cols("baseline")), []))


def _compared(both: DataFrame) -> DataFrame:
    shift = F.col("mean_candidate") - F.col("mean_baseline")
    return both.withColumns(
        {
            "mean_shift": shift,
            "mean_shift_share": F.coalesce(F.try_divide(shift, F.col("mean_baseline")), F.lit(0.0)),
            "std_reduction": F.when(F.col("std_baseline") != 0, 1 - F.col("std_candidate") / F.col("std_baseline")).otherwise(0.0),
        }
    )


def candidate_ranking(
    df: DataFrame, candidate: str, value: str, order_by: Sequence[str], lsl: float | None, usl: float | None,
    objective: str = "maximize_yield", target: float | None = None, cpk_min: float = 1.33, rows_per_bucket: int | None = None,
) -> DataFrame:
    """Yield, DPMO, mean and Cpk per candidate, objective score (lower is better), feasibility and the
    best feasible score so far in candidate order."""
    if objective not in ("maximize_yield", "minimize_dpmo", "hit_target"):
        raise ValueError("objective must be maximize_yield, minimize_dpmo or hit_target")
    if objective != "hit_target" and lsl is None and usl is None:
        raise ValueError("yield and DPMO need a limit")
    risk = spec_risk(df, value, lsl, usl, [candidate])
    spec = df.sparkSession.createDataFrame([(lsl, usl)], "lsl double, usl double")
    cap = capability(chart_scan(df, value, order_by, [candidate], rows_per_bucket), spec).select(candidate, "cpk")
    t = join_on(risk, cap, [candidate])
    score = {
        "maximize_yield": F.col("ng_probability") - 1,
        "minimize_dpmo": F.col("dpmo"),
        "hit_target": F.abs(F.col("mean") - (target or 0.0)),
    }[objective]
    ok = (F.col("cpk").isNull() | (F.col("cpk") >= cpk_min)) if objective == "hit_target" else F.lit(True)
    t = t.select(
        candidate, (1 - F.col("ng_probability")).alias("yield"), "dpmo", F.col("mean").alias("predicted_mean"), "cpk", score.alias("score"), ok.alias("feasible")
    )
    scan = OrderedScan(t, [], [candidate], rows_per_bucket).running({"best_so_far": ("min", F.when(F.col("feasible"), F.col("score")))})
    return scan.rows()


def top_candidates(ranking: DataFrame, candidate: str, n: int = 10) -> DataFrame:
    """The n best candidates by score."""
    best = ranking.orderBy("score", candidate).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("score", candidate)))
