"""Inference for linear models, factorial ANOVA, validation and sensitivity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantscope.functions.special import f_tail, t_quantile, t_two_sided
from plantscope.operators.models import LinearModel, hash_bucket, input_ranges, regression_metrics
from plantscope.operators.ordered import OrderedScan
from plantscope.operators.series_models import SeriesRegression, SeriesTrees, compiled
from plantscope.operators.stats import attach_stats, finite


# -- tables from one fitted model: one row per term, sized by the model, not the data -----------------


def anova_overall(model: LinearModel, df: DataFrame) -> DataFrame:
    """Sums of squares, degrees of freedom, F, p, label, R2 and adjusted R2."""
    df_reg, df_res = model.p - 1, model.n - model.p
    if df_res <= 0:
        raise ValueError(f"n={model.n} and {model.p} parameters leave no degrees of freedom")
    ssr = model.sst - model.sse
    mse = model.sse / df_res
    f = (ssr / df_reg) / mse if mse > 0 else 0.0
    p = f_tail(f, df_reg, df_res)
    label = (
        "highly_significant" if p < 0.001 else "significant" if p < 0.01 else "marginally_significant" if p < 0.05 else "not_significant"
    )
    adj = 1 - (1 - model.r2) * (model.n - 1) / max(model.n - model.p, 1)
    row = (ssr, model.sse, model.sst, df_reg, df_res, f, p, label, model.r2, adj)
    return df.sparkSession.createDataFrame(
        [row], "ss_reg double, ss_res double, ss_tot double, df_reg long, df_res long, f_stat double, p_value double, label string, r2 double, adj_r2 double"
    )


def coefficient_rows(model: LinearModel) -> list[tuple]:
    df_res = model.n - model.p
    mse = model.sse / df_res
    names, b = list(model.coefficients), np.array(list(model.coefficients.values()))
    se = np.sqrt(np.maximum(np.diag(model.inverse), 0) * mse)
    se0 = math.sqrt(mse * (1 / model.n + float(model.means @ model.inverse @ model.means)))
    tq = t_quantile(0.975, df_res)
    out = []
    for name, coef, err in [("intercept", model.intercept, se0), *zip(names, b, se)]:
        usable = err > 1e-12
        t = float(coef / err) if usable else 0.0
        p = t_two_sided(t, df_res)
        half = tq * float(err) if usable else 0.0
        out.append((name, float(coef), float(err), t, p, float(coef) - half, float(coef) + half, p < 0.05))
    return out


def coefficient_table(model: LinearModel, df: DataFrame) -> DataFrame:
    """Standard error, t, p, 95 % interval and significance per coefficient."""
    return df.sparkSession.createDataFrame(
        coefficient_rows(model),
        "term string, coefficient double, std_err double, t_stat double, p_value double, ci_lower double, ci_upper double, significant boolean",
    )


def fit_level(r2: Column, p_value: Column, significant_share: Column) -> Column:
    return (
        F.when((r2 >= 0.9) & (p_value < 0.001) & (significant_share >= 0.7), "excellent")
        .when((r2 >= 0.7) & (p_value < 0.05) & (significant_share >= 0.5), "good")
        .when((r2 >= 0.5) & (p_value < 0.10), "moderate")
        .when((p_value >= 0.05) & (r2 < 0.5), "poor")
        .otherwise("marginal")
    )


def fit_quality(model: LinearModel, df: DataFrame) -> DataFrame:
    share = coefficient_table(model, df).where(F.col("term") != "intercept").agg(
        (F.count_if("significant") / F.count(F.lit(1))).alias("significant_share")
    )
    both = attach_stats(anova_overall(model, df).select("r2", "p_value"), share, [])
    return both.withColumn("fit_level", fit_level(F.col("r2"), F.col("p_value"), F.col("significant_share")))


def lack_of_fit(df: DataFrame, target: str, inputs: Sequence[str], ss_res: float, df_res: int) -> DataFrame:
    """Pure error from rows with equal inputs, and what the model leaves beyond it."""
    cells = df.groupBy(*inputs).agg((F.var_pop(target) * F.count(target)).alias("_ss"), F.count(target).alias("_k"))
    a = cells.agg(F.sum("_ss").alias("pure_ss"), (F.sum("_k") - F.count(F.lit(1))).alias("pure_df"))
    pure_ms = F.when(F.col("pure_df") > 0, F.col("pure_ss") / F.col("pure_df"))
    a = a.withColumns({"pure_ms": pure_ms, "lof_df": F.lit(df_res) - F.col("pure_df"), "lof_ss": F.greatest(F.lit(ss_res) - F.col("pure_ss"), F.lit(0.0))})
    lof_ms = F.when(F.col("lof_df") > 0, F.col("lof_ss") / F.col("lof_df"))
    return a.withColumns({"lof_ms": lof_ms, "f_stat": F.when(F.col("pure_ms") > 0, lof_ms / F.col("pure_ms"))})


# -- factorial designs ---------------------------------------------------------------------------------


def main_effect_ss(df: DataFrame, target: str, factors: Sequence[str]) -> DataFrame:
    """Between-level sum of squares per factor, from one unpivoted aggregate."""
    long = df.select(F.col(target).cast("double").alias("_y"), *[F.col(f).cast("string").alias(f) for f in factors]).unpivot(
        ["_y"], list(factors), "factor", "level"
    )
    levels = long.groupBy("factor", "level").agg(F.count("_y").alias("_k"), F.avg("_y").alias("_m"))
    # all factors see the same rows, so the weighted variance of level means needs no grand mean
    n, s, q = F.sum("_k"), F.sum(F.col("_k") * F.col("_m")), F.sum(F.col("_k") * F.col("_m") * F.col("_m"))
    return levels.groupBy("factor").agg((F.count(F.lit(1)) - 1).alias("df"), (q - s * s / n).alias("ss"))


def factorial_anova(model: LinearModel, df: DataFrame, target: str) -> DataFrame:
    """Model, linear, main-effect, interaction, error and total rows.

    Interaction sums of squares come from dropping a term group: with the full inverse V that is
    b' V^-1 b over the group, so no refit reads the data again.
    """
    names = list(model.coefficients)
    b = np.array([model.coefficients[n] for n in names])
    df_res = model.n - model.p
    mse = model.sse / df_res

    def drop_ss(group_terms: list[int]) -> float:
        v = model.inverse[np.ix_(group_terms, group_terms)]
        return float(b[group_terms] @ np.linalg.solve(v, b[group_terms]))

    groups: dict[tuple[str, ...], list[int]] = {}
    for i, n in enumerate(names):
        groups.setdefault(model.owner[n], []).append(i)
    mains = {r.factor: (float(r.ss), int(r.df)) for r in main_effect_ss(df, target, list(model.levels)).collect()}
    rows = [("model", len(names), model.sst - model.sse), ("linear", sum(d for _, d in mains.values()), sum(s for s, _ in mains.values()))]
    rows += [(f, d, s) for f, (s, d) in sorted(mains.items())]
    pairs = {g: idx for g, idx in groups.items() if len(g) == 2}
    if pairs:
        every = [i for idx in pairs.values() for i in idx]
        rows.append(("two_factor_interactions", len(every), drop_ss(every)))
        rows += [(" x ".join(g), len(idx), drop_ss(idx)) for g, idx in pairs.items()]
    out = []
    for source, d, ss in rows:
        f = (ss / d) / mse if d and mse > 0 else None
        out.append((source, d, float(ss), float(ss / d), f, f_tail(f, d, df_res) if f is not None else None))
    out += [("error", df_res, model.sse, mse, None, None), ("total", model.n - 1, model.sst, None, None, None)]
    return df.sparkSession.createDataFrame(out, "source string, df long, ss double, ms double, f_stat double, p_value double")


def pareto_terms(model: LinearModel, df: DataFrame, target: str) -> DataFrame:
    """Largest |t|, smallest p, significant contrasts and root F per factor or pair."""
    owner = [(n, " x ".join(g)) for n, g in model.owner.items()]
    terms = df.sparkSession.createDataFrame(owner, "term string, source string")
    coefs = coefficient_table(model, df).join(terms, "term")
    agg = coefs.groupBy("source").agg(
        F.max(F.abs(F.col("t_stat"))).alias("max_abs_t"), F.min("p_value").alias("min_p_value"),
        F.count_if("significant").alias("n_significant"), F.count(F.lit(1)).alias("n_contrasts"),
    )
    root_f = factorial_anova(model, df, target).select("source", F.sqrt("f_stat").alias("standardized_effect"))
    return agg.join(root_f, "source", "left")


def level_grid(model: LinearModel, df: DataFrame, fixed: dict[str, Sequence] | None = None) -> DataFrame:
    """Every level combination of the fitted factors with its prediction."""
    grid = df.sparkSession.range(1)
    for f, levels in model.levels.items():
        kind = df.schema[f].dataType
        chosen = levels if not fixed or f not in fixed else fixed[f]
        grid = grid.withColumn(f, F.explode(F.array(*[F.lit(v).cast(kind) for v in chosen])))
    return grid.drop("id").withColumn("predicted", model.prediction())


def marginal_means(model: LinearModel, df: DataFrame) -> DataFrame:
    grid = level_grid(model, df)
    factors = list(model.levels)
    long = grid.select("predicted", *[F.col(f).cast("string").alias(f) for f in factors]).unpivot(["predicted"], factors, "factor", "level")
    return long.groupBy("factor", "level").agg(F.avg("predicted").alias("mean"))


def interaction_lines(model: LinearModel, df: DataFrame) -> DataFrame:
    """Mean prediction per pair of levels, averaged over the other factors."""
    grid = level_grid(model, df)
    out = None
    for a, b in combinations(model.levels, 2):
        part = grid.groupBy(F.col(a).cast("string").alias("left_level"), F.col(b).cast("string").alias("right_level")).agg(
            F.avg("predicted").alias("mean")
        ).select(F.lit(a).alias("left_factor"), F.lit(b).alias("right_factor"), "left_level", "right_level", "mean")
        out = part if out is None else out.unionByName(part)
    return out


def corner_contrasts(model: LinearModel, df: DataFrame) -> DataFrame:
    """Interaction contrast of first and last levels per pair: mean absolute value over the other factors."""
    out = None
    for a, b in combinations(model.levels, 2):
        la, lb = model.levels[a], model.levels[b]
        rest = [f for f in model.levels if f not in (a, b)]
        corners = level_grid(model, df, {a: [la[0], la[-1]], b: [lb[0], lb[-1]]})
        sign = F.when((F.col(a) == F.lit(la[-1])) == (F.col(b) == F.lit(lb[-1])), 1.0).otherwise(-1.0)
        per = corners.groupBy(*rest).agg(F.sum(sign * F.col("predicted")).alias("_c"))
        part = per.agg(F.avg(F.abs(F.col("_c"))).alias("strength")).select(F.lit(a).alias("left_factor"), F.lit(b).alias("right_factor"), "strength")
        out = part if out is None else out.unionByName(part)
    return out


def leave_one_out(model: LinearModel, df: DataFrame) -> DataFrame:
    """Leave-one-cell-out R2 and RMSE by residual / (1 - leverage): no refit."""
    h = model.leverage()
    y = F.col(model.target).cast("double")
    e = F.when(1 - h > 1e-12, (y - model.prediction()) / (1 - h))
    return df.agg(
        F.count(F.lit(1)).alias("n_cells"), F.count(e).alias("n_usable"),
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"),
    )


# -- interactions, sensitivity, contributions ------------------------------------------------------------


def interaction_strength(
    model: LinearModel | PipelineModel | SeriesTrees | SeriesRegression, df: DataFrame, inputs: Sequence[str], threshold: float = 0.01
) -> DataFrame:
    """Mean |joint - single effects + base| of each pair of inputs, with the others at their means.

    For a polynomial the squares cancel and only the product term is left. Trees and models a series are
    expressions of their inputs, so a row's settings are scored side by side. Either way one aggregate serves
    all pairs, a row of the result for each pair (and series); rows without a pair's inputs do not count for it.
    """
    pairs = list(combinations(inputs, 2))
    if not isinstance(model, LinearModel):
        return _strength_by_scoring(model, df, inputs, pairs).withColumn("significant", F.col("strength") >= threshold)
    means = df.agg(*[F.avg(c).alias(c) for c in inputs]).first()
    d = {c: F.col(c).cast("double") - F.lit(float(means[c])) for c in inputs}
    wide = df.agg(*[F.avg(F.abs(d[a]) * F.abs(d[b])).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        coef = abs(model.coefficients.get(f"{a}*{b}", 0.0))
        rows.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (F.col(f"_p{i}") * coef).alias("strength")))
    out = wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    return out.withColumn("significant", F.col("strength") >= threshold)


def _strength_by_scoring(model, df: DataFrame, inputs: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    model = compiled(model, df.sparkSession) if isinstance(model, PipelineModel) else model
    keys, place = list(model.keys), {c: i for i, c in enumerate(inputs)}
    slim = df.select(*keys, *[finite(F.col(c)).alias(f"_x{i}") for c, i in place.items()])
    means = slim.groupBy(*keys).agg(*[F.avg(f"_x{i}").alias(f"_m{i}") for i in place.values()])
    walker = model.walker if isinstance(model, SeriesTrees) else None
    attach = model.attach if walker is None else model.with_ids

    def at(*moved: str) -> Column:
        terms = {c: F.col(f"_x{i}" if c in moved else f"_m{i}") for c, i in place.items()}
        return model.prediction(terms) if walker is None else walker(*[terms.get(f, F.col(f)) for f in model.features])

    # base and single settings are computed once, the pairs read them
    if set(inputs) >= set(model.features):
        rows = attach_stats(slim, attach(means).withColumn("_base", at()), keys)
    else:
        rows = attach(attach_stats(slim, means, keys)).withColumn("_base", at())
    rows = rows.withColumns({f"_s{i}": at(c) for c, i in place.items()})

    def gap(a: str, b: str) -> Column:
        i, j = place[a], place[b]
        known = F.col(f"_x{i}").isNotNull() & F.col(f"_x{j}").isNotNull()
        return F.when(known, F.abs(at(a, b) - F.col(f"_s{i}") - F.col(f"_s{j}") + F.col("_base")))

    wide = rows.groupBy(*keys).agg(*[F.avg(gap(a, b)).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)])
    each = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_p{i}").alias("strength")) for i, (a, b) in enumerate(pairs)]
    return wide.select(*keys, F.explode(F.array(*each)).alias("_r")).select(*keys, "_r.*")


def permutation_sensitivity(
    score, df: DataFrame, target: str, inputs: Sequence[str], key: Sequence[str], repeats: int = 8, seed: int = 42,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """RMSE increase per input when it is permuted, averaged over repeats and normalised to 1.

    ``score(df)`` adds ``predicted``. Rows are put in the order of a hash of their key, once; repeat r
    gives each row the inputs of the row r before it, the first ones those of the last. All repeats and
    inputs are scored in one pass: a row becomes one row per repeat and input.
    """
    slim = df.select(*dict.fromkeys([*key, target, *inputs]))
    base = score(slim).select(F.sqrt(F.avg(F.pow(F.col(target) - F.col("predicted"), 2))).alias("_base"))
    hashed = slim.withColumn("_h", F.xxhash64(*key, F.lit(seed)))
    shifts = range(1, repeats + 1)
    names = [f"_p{i}" for i in range(len(inputs))]
    given = F.struct(*[F.col(c).alias(n) for c, n in zip(inputs, names)])
    scan = OrderedScan(hashed, [], ["_h", *key], rows_per_bucket).row_number("_rn").with_columns({"_own": given})
    scan = scan.bounded(lambda d, w: d.withColumns({f"_b{r}": F.lag("_own", r).over(w) for r in shifts}), repeats)
    # the last ``repeats`` rows, in order: what the first rows are given
    last = hashed.select("_h", *key, given.alias("_own")).orderBy(*[F.desc(c) for c in ("_h", *key)]).limit(repeats)
    tail = last.agg(F.transform(F.sort_array(F.collect_list(F.struct("_h", *key, "_own"))), lambda x: x["_own"]).alias("_tail"))
    rows = attach_stats(scan.rows(), tail, [])

    def before(r: int) -> Column:
        at = F.pmod(F.size("_tail") - r + F.col("_rn") - 1, F.size("_tail")).cast("int")
        return F.when(F.col("_rn") > r, F.col(f"_b{r}")).otherwise(F.get("_tail", at))

    variants = F.array(*[F.struct(F.lit(r).alias("_r"), F.lit(c).alias("input"), before(r).alias("_p")) for r in shifts for c in inputs])
    each = rows.select(target, *inputs, F.explode(variants).alias("_v"))
    swapped = each.select(
        target, F.col("_v._r").alias("_r"), F.col("_v.input").alias("input"),
        *[F.when(F.col("_v.input") == c, F.col("_v._p")[n]).otherwise(F.col(c)).alias(c) for c, n in zip(inputs, names)],
    )
    errors = score(swapped).groupBy("_r", "input").agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col("predicted"), 2))).alias("_rmse"))
    delta = attach_stats(errors, base, []).groupBy("input").agg(
        F.avg(F.greatest(F.col("_rmse") - F.col("_base"), F.lit(0.0))).alias("rmse_increase")
    )
    total = delta.agg(F.sum("rmse_increase").alias("_total"))
    return attach_stats(delta, total, []).select(
        "input", "rmse_increase", F.when(F.col("_total") > 0, F.col("rmse_increase") / F.col("_total")).otherwise(0.0).alias("sensitivity")
    )


def effect_sizes(model: LinearModel, df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """|coefficient| * sx / sy."""
    coefs = model.table(df).where(F.col("term").isin(*inputs))
    sx = input_ranges(df, inputs).select("column", "std")
    sy = df.agg(F.stddev_samp(model.target).alias("_sy"))
    t = attach_stats(sx.join(F.broadcast(coefs), F.col("column") == F.col("term")), sy, [])
    return t.select(F.col("column").alias("input"), F.abs(F.col("coefficient") * F.col("std") / F.col("_sy")).alias("effect_size"))


def linear_contributions(model: LinearModel, df: DataFrame, inputs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """coefficient * (x - mean) per row and input."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in inputs])
    rows = attach_stats(df.select(*keep, *[c for c in inputs if c not in keep]), means, [])
    return rows.select(
        *keep, *[(F.lit(model.coefficients[c]) * (F.col(c).cast("double") - F.col(f"_m_{c}"))).alias(f"contribution_{c}") for c in inputs]
    )


def contribution_ranking(contributions: DataFrame, inputs: Sequence[str]) -> DataFrame:
    wide = contributions.agg(*[F.avg(F.abs(F.col(f"contribution_{c}"))).alias(c) for c in inputs])
    return wide.unpivot([], list(inputs), "input", "mean_abs_contribution")


def factor_contributions(model: LinearModel, df: DataFrame) -> DataFrame:
    """Mean change per factor level when the factor is set to its reference level."""
    full = model.prediction()
    out = None
    for f, levels in model.levels.items():
        rows = df.withColumn("_full", full).withColumn("_level", F.col(f).cast("string")).withColumn(f, F.lit(levels[0]).cast(df.schema[f].dataType))
        part = rows.groupBy("_level").agg(F.avg(F.col("_full") - model.prediction()).alias("mean_contribution")).select(
            F.lit(f).alias("factor"), F.col("_level").alias("level"), "mean_contribution"
        )
        out = part if out is None else out.unionByName(part)
    return out


def extrapolation_risk(training: DataFrame, points: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Distance outside the training range over the range, per input and the row maximum."""
    ranges = training.agg(*[F.min(c).alias(f"_lo_{c}") for c in inputs], *[F.max(c).alias(f"_hi_{c}") for c in inputs])
    rows = attach_stats(points, ranges, [])
    risks = {}
    for c in inputs:
        lo, hi, v = F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), F.col(c)
        out = F.when(v < lo, (lo - v) / (hi - lo)).when(v > hi, (v - hi) / (hi - lo)).otherwise(0.0)
        risks[f"risk_{c}"] = F.when(hi > lo, F.coalesce(out, F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumns(risks).drop(*[f"_lo_{c}" for c in inputs], *[f"_hi_{c}" for c in inputs])
    worst = F.greatest(*[F.col(r) for r in risks]) if len(risks) > 1 else F.col(next(iter(risks)))
    return rows.withColumns({"max_risk": worst, "is_extrapolation": worst > 0})


def compare_models(scores: dict[str, DataFrame], normality: dict[str, DataFrame], df: DataFrame) -> DataFrame:
    """Rank by mean fold R2 - 0.1 * non-normal - 0.05 * std of fold R2.

    ``scores``: fold tables with ``r2``; ``normality``: one-row tables with ``is_normal``.
    """
    out = None
    for name, folds in scores.items():
        a = folds.agg(F.avg("r2").alias("mean_r2"), F.avg("rmse").alias("mean_rmse"), F.stddev_pop("r2").alias("std_r2"))
        part = attach_stats(a, normality[name].select("is_normal"), []).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    penalty = F.when(F.col("is_normal"), 0.0).otherwise(0.1)
    out = out.withColumn("score", F.col("mean_r2") - penalty - 0.05 * F.col("std_r2"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "model")))  # one row per model


def model_folds(df: DataFrame, fit, target: str, keys: Sequence[str], k: int = 5, seed: int = 42, n_inputs: int = 1) -> DataFrame:
    """k-fold R2 and RMSE of any model: ``fit(train)`` returns a scoring function."""
    folded = df.withColumn("_fold", hash_bucket(keys, seed, k))
    out = None
    for f in range(k):
        scored = fit(folded.where(F.col("_fold") != f))(folded.where(F.col("_fold") == f))
        part = scored.select((F.col("_fold") + 1).alias("fold"), F.col(target).cast("double").alias("actual"), "predicted")
        out = part if out is None else out.unionByName(part)
    return regression_metrics(out, "actual", "predicted", ["fold"], n_inputs).select("fold", "n", "r2", "rmse")
