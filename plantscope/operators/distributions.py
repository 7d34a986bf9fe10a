"""Distribution fitting per key: statistics, likelihoods, ranking, goodness of fit, densities.

Fits work on (keys…, value) rows and keep one parameter row per key. Every pass is a map-side
combined aggregate; only the Weibull shape needs several, and its parameter table is
checkpointed between passes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantscope.functions.special import beta_cdf, digamma, gamma_cdf, ln_gamma, normal_cdf, trigamma
from plantscope.operators.ordered import OrderedScan, join_on
from plantscope.operators.stats import attach_stats, finite
from plantscope.session import ensure_checkpoint_dir

V = "value"
MIN_ROWS = 10
SHIFT_FLOOR = 1e-6
EPS = 2.220446049250313e-16
MOST_STEPS = 100  # of Newton's method; a shape that still moves then is an error
STEP_TOLERANCE = 1e-10
# fixed values: parameter counts used in AIC and BIC; fixed locations count
N_PARAMS = {
    "normal": 2, "lognormal": 3, "uniform": 2, "triangular": 3, "weibull": 3, "gamma": 3,
    "poisson": 1, "negative_binomial": 2,
}
FIT_COLUMNS = ("family", "n", "k", "x_min", "x_max", "mean", "sd", "skewness", "kurtosis", "loglik", "params", "aic", "bic")


def value_rows(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, finite(F.col(column)).alias(V)).where(F.col(V).isNotNull())


def _join(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    return join_on(a, b, by, how) if by else attach_stats(a, b, by)


def base_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, range, moments and whether all values are integers."""
    return rows.groupBy(*by).agg(
        F.count(V).alias("n"),
        F.min(V).alias("x_min"),
        F.max(V).alias("x_max"),
        F.avg(V).alias("mean"),
        F.stddev_pop(V).alias("sd"),
        F.var_pop(V).alias("variance"),
        F.skewness(V).alias("skewness"),
        F.kurtosis(V).alias("kurtosis"),
        F.min(F.abs(F.col(V) - F.round(V)) <= 1e-8 + 1e-5 * F.abs(F.round(V))).alias("is_integer"),
    )


def shape_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Skewness and excess kurtosis."""
    return base_stats(value_rows(df, column, by), by).select(*by, "n", "skewness", "kurtosis")


# -- histogram ---------------------------------------------------------------------------


def _bins(n: Column) -> Column:
    return F.least(F.greatest(F.floor(F.sqrt(n.cast("double"))), F.lit(5)), F.lit(30)).cast("int")


def histogram(
    rows: DataFrame, by: Sequence[str], stats: DataFrame | None = None, bins: int | Column | None = None
) -> DataFrame:
    """Equal-width bins with edges and counts, empty bins included; the last bin is closed.

    Default number of bins: floor(sqrt(n)) kept within 5 and 30. A constant column spans one unit.
    """
    stats = base_stats(rows, by) if stats is None else stats
    count = _bins(F.col("n")) if bins is None else (bins if isinstance(bins, Column) else F.lit(bins))
    flat = F.col("x_min") == F.col("x_max")
    grid = stats.select(
        *by, F.col("n").alias("_n"), count.alias("_bins"),
        F.when(flat, F.col("x_min") - 0.5).otherwise(F.col("x_min")).alias("_lo"),
        F.when(flat, F.col("x_max") + 0.5).otherwise(F.col("x_max")).alias("_hi"),
    ).withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.col("_bins"))
    placed = attach_stats(rows, grid, by).withColumn(
        "bin", F.least(F.floor((F.col(V) - F.col("_lo")) / F.col("_w")), F.col("_bins") - 1).cast("int")
    )
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    every = grid.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)))
    out = join_on(every, counts, [*by, "bin"], "left")
    return out.select(
        *by, "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"),
        "_n", "_bins", "_w",
    )


def histogram_table(df: DataFrame, column: str, by: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    return histogram(value_rows(df, column, by), by, bins=bins).drop("_n", "_bins", "_w")


# -- likelihoods -----------------------------------------------------------------------------


def _log_stats(rows: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of the logarithm, on values shifted to start just above zero where needed."""
    moved = shifted(rows, stats, by)
    y = F.col("_y")
    return moved.groupBy(*by).agg(F.avg(y).alias("y_mean"), F.avg(F.ln(y)).alias("ln_mean"), F.stddev_pop(F.ln(y)).alias("ln_sd"))


def shifted(rows: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    offset = stats.select(*by, F.when(F.col("x_min") <= 0, SHIFT_FLOOR - F.col("x_min")).otherwise(0.0).alias("_off"))
    return attach_stats(rows, offset, by).withColumn("_y", F.col(V) + F.col("_off")).drop("_off")


def weibull_shape(rows: DataFrame, stats: DataFrame, logs: DataFrame, by: Sequence[str], steps: int = MOST_STEPS) -> DataFrame:
    """Weibull shape and scale with location 0: Newton steps on the profile likelihood.

    Values are divided by their mean, so powers stay in range. All keys advance in each pass, until no
    shape moves any more; an error after ``steps`` passes.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    start = logs.where(F.col("ln_sd") > 0).select(
        *by, "y_mean", (F.col("ln_mean") - F.ln("y_mean")).alias("_lm"), (F.lit(math.pi / math.sqrt(6)) / F.col("ln_sd")).alias("_k")
    ).checkpoint()
    data = shifted(rows, stats, by).select(*by, "_y").persist(StorageLevel.MEMORY_AND_DISK)
    current = start
    for _ in range(steps):
        z = F.col("_y") / F.col("y_mean")
        p = F.pow(z, F.col("_k"))
        sums = attach_stats(data, current, by).groupBy(*by, "y_mean", "_lm", "_k").agg(
            F.sum(p).alias("_a"), F.sum(p * F.ln(z)).alias("_b"), F.sum(p * F.ln(z) * F.ln(z)).alias("_c"), F.avg(p).alias("_m")
        )
        k = F.col("_k")
        ratio = F.col("_b") / F.col("_a")
        value = ratio - 1 / k - F.col("_lm")
        slope = F.col("_c") / F.col("_a") - ratio * ratio + 1 / (k * k)
        moved = F.greatest(k - value / slope, k / 4)
        current = sums.select(*by, "y_mean", "_lm", moved.alias("_k"), "_m", k.alias("_k0")).checkpoint()
        if (current.agg(F.max(F.abs(F.col("_k") / F.col("_k0") - 1))).first()[0] or 0.0) <= STEP_TOLERANCE:
            break
    else:
        raise ArithmeticError("the Weibull shape did not converge")
    data.unpersist()
    # the last mean belongs to the shape before the last step, which by then equals it
    scale = F.col("y_mean") * F.pow(F.col("_m"), 1 / F.col("_k0"))
    return current.select(*by, F.col("_k").alias("weibull_shape"), scale.alias("weibull_scale"))


def gamma_shape(logs: DataFrame, by: Sequence[str], steps: int = 6) -> DataFrame:
    """Gamma shape with location 0 from two sufficient statistics: Newton on ln a - digamma(a).

    The start is within 1.5 % of the root, so six steps reach rounding; a gap left after them is an error.
    """
    s = F.ln("y_mean") - F.col("ln_mean")
    t = logs.where(F.col("ln_sd") > 0).select(*by, "y_mean", "ln_mean", s.alias("_s"))
    t = t.withColumn("_a", (3 - F.col("_s") + F.sqrt(F.pow(F.col("_s") - 3, F.lit(2)) + 24 * F.col("_s"))) / (12 * F.col("_s")))
    for i in range(steps):
        a = F.col("_a")
        gap = F.ln(a) - digamma(a) - F.col("_s")
        t = t.withColumn("_next", a - gap / (1 / a - trigamma(a))).drop("_a").withColumnRenamed("_next", "_a")
        if i % 2 == 1:
            # an aggregate boundary keeps the expressions from being folded into one another
            t = t.groupBy(*by, "y_mean", "ln_mean", "_s").agg(F.first("_a").alias("_a"))
    a = F.col("_a")
    left = F.abs(F.ln(a) - digamma(a) - F.col("_s"))
    failed = F.raise_error(F.lit("the gamma shape did not converge")).cast("double")
    shape = F.when(left <= 1e-8 * F.greatest(F.lit(1.0), F.col("_s")), a).otherwise(failed)
    t = t.select(*by, "y_mean", shape.alias("gamma_shape"))
    return t.select(*by, "gamma_shape", (F.col("y_mean") / F.col("gamma_shape")).alias("gamma_scale"))


def triangular_mode(rows: DataFrame, stats: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    """The mode of largest likelihood, which is always one of the values, from one ordered scan.

    The support is the data range widened by range / n on both sides, so that the extreme
    values keep a positive density. Running sums of the logarithms give every value's likelihood.
    """
    pad = (F.col("x_max") - F.col("x_min")) / F.col("n")
    bounds = stats.where(F.col("x_max") > F.col("x_min")).select(*by, (F.col("x_min") - pad).alias("_a"), (F.col("x_max") + pad).alias("_b"))
    counts = attach_stats(rows.groupBy(*by, V).agg(F.count(F.lit(1)).alias("_k")), bounds, by)
    a, b, x, k = F.col("_a"), F.col("_b"), F.col(V), F.col("_k")
    right = k * F.ln(b - x)
    totals = counts.groupBy(*by).agg(F.sum(k).alias("_n"), F.sum(right).alias("_right"))
    scan = OrderedScan(counts, by, [V], **kw).running({"_n1": ("sum", k), "_l1": ("sum", k * F.ln(x - a)), "_r1": ("sum", right)})
    n, n1 = F.col("_n"), F.col("_n1")
    ll = n * F.ln(2 / (b - a)) + F.col("_l1") - n1 * F.ln(x - a) + F.col("_right") - F.col("_r1") - (n - n1) * F.ln(b - x)
    best = scan.attach(totals).rows().groupBy(*by, "_a", "_b").agg(F.max(F.struct(ll.alias("ll"), x.alias("mode"))).alias("_t"))
    return best.select(
        *by, F.col("_a").alias("tri_low"), F.col("_b").alias("tri_high"), F.col("_t.mode").alias("tri_mode"), F.col("_t.ll").alias("tri_ll")
    )


def _discrete_sums(rows: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums over the value counts for the two integer families."""
    usable = stats.where(F.col("is_integer") & (F.col("x_min") >= 0) & (F.col("mean") > 0)).select(*by, "mean", "variance")
    counts = rows.groupBy(*by, V).agg(F.count(F.lit(1)).alias("_k"))
    t = attach_stats(counts, usable, by)
    p = F.col("mean") / F.col("variance")
    r = F.when(F.col("variance") > F.col("mean"), F.col("mean") * p / (1 - p))
    k, v = F.col("_k"), F.round(V)
    return t.withColumn("_r", r).groupBy(*by).agg(
        F.sum(k * ln_gamma(v + 1)).alias("ln_factorials"), F.sum(k * ln_gamma(v + F.col("_r"))).alias("ln_rising"), F.max("_r").alias("nb_r")
    )


def fit_table(df: DataFrame, column: str, by: Sequence[str] = (), families: Sequence[str] | None = None) -> DataFrame:
    """Every family's parameters, log-likelihood, AIC and BIC per key (non-finite fits left out)."""
    by = list(by)
    if clash := set(by) & set(FIT_COLUMNS):
        raise ValueError(f"key column(s) {', '.join(sorted(clash))} clash with the result's columns")
    wanted = set(families or [*N_PARAMS, "empirical"])
    rows = value_rows(df, column, by)
    stats = base_stats(rows, by)
    t = stats
    if wanted & {"lognormal", "weibull", "gamma"}:
        logs = _log_stats(rows, stats, by)
        t = _join(t, logs, by)
        if "gamma" in wanted:
            t = _join(t, gamma_shape(logs, by), by, "left")
        if "weibull" in wanted:
            t = _join(t, weibull_shape(rows, stats, logs, by), by, "left")
    if "triangular" in wanted:
        t = _join(t, triangular_mode(rows, stats, by), by, "left")
    if wanted & {"poisson", "negative_binomial"}:
        t = join_on(t, _discrete_sums(rows, stats, by), by, "left") if by else _outer_one(t, _discrete_sums(rows, stats, by))
    if "empirical" in wanted:
        h = histogram(rows, by, stats)
        c = F.col("count")
        emp = h.groupBy(*by).agg(
            F.sum(c * F.ln(c / (F.col("_n") * F.col("_w")) + EPS)).alias("emp_ll"), F.max("_bins").alias("emp_bins")
        )
        t = _join(t, emp, by)

    n, tau = F.col("n"), math.log(2 * math.pi)

    def params(**kv) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(k) for k in kv]), F.array(*[v.cast("double") for v in kv.values()]))

    big = n >= MIN_ROWS
    whole = F.col("is_integer") & (F.col("x_min") >= 0) & (F.col("mean") > 0)
    p_nb = F.col("mean") / F.col("variance")
    r = F.col("nb_r") if wanted & {"poisson", "negative_binomial"} else None
    entries = []

    def add(family: str, when: Column, ll, parameters, k=None):
        if family in wanted:
            count = F.lit(N_PARAMS[family]) if k is None else k()
            entries.append(
                F.when(
                    when,
                    F.struct(F.lit(family).alias("family"), count.cast("long").alias("k"), ll().alias("loglik"), parameters().alias("params")),
                )
            )

    spread = big & (F.col("sd") > 0)
    add("normal", spread, lambda: -0.5 * n * (tau + 2 * F.ln("sd") + 1), lambda: params(loc=F.col("mean"), scale=F.col("sd")))
    add(
        "lognormal", spread,
        lambda: -n * F.col("ln_mean") - 0.5 * n * (tau + 2 * F.ln("ln_sd") + 1),
        lambda: params(shape=F.col("ln_sd"), loc=F.lit(0.0), scale=F.exp("ln_mean")),
    )
    add("uniform", spread, lambda: -n * F.ln(F.col("x_max") - F.col("x_min")), lambda: params(loc=F.col("x_min"), scale=F.col("x_max") - F.col("x_min")))
    add(
        "triangular", spread, lambda: F.col("tri_ll"),
        lambda: params(
            c=(F.col("tri_mode") - F.col("tri_low")) / (F.col("tri_high") - F.col("tri_low")),
            loc=F.col("tri_low"), scale=F.col("tri_high") - F.col("tri_low"),
        ),
    )
    add(
        "weibull", spread & F.lit(True),
        lambda: n * (F.ln("weibull_shape") - F.col("weibull_shape") * F.ln("weibull_scale") + (F.col("weibull_shape") - 1) * F.col("ln_mean") - 1),
        lambda: params(shape=F.col("weibull_shape"), loc=F.lit(0.0), scale=F.col("weibull_scale")),
    )
    add(
        "gamma", spread,
        lambda: n * ((F.col("gamma_shape") - 1) * F.col("ln_mean") - F.col("y_mean") / F.col("gamma_scale")
                     - F.col("gamma_shape") * F.ln("gamma_scale") - ln_gamma(F.col("gamma_shape"))),
        lambda: params(shape=F.col("gamma_shape"), loc=F.lit(0.0), scale=F.col("gamma_scale")),
    )
    add("poisson", big & whole, lambda: n * F.col("mean") * F.ln("mean") - n * F.col("mean") - F.col("ln_factorials"), lambda: params(mu=F.col("mean")))
    add(
        "negative_binomial", big & whole & (F.col("variance") > F.col("mean")),
        lambda: F.col("ln_rising") - n * ln_gamma(r) - F.col("ln_factorials") + n * (r * F.ln(p_nb) + F.col("mean") * F.ln(1 - p_nb)),
        lambda: params(n=r, p=p_nb),
    )
    add("empirical", F.lit(True), lambda: F.col("emp_ll"), lambda: params(n=n, min=F.col("x_min"), max=F.col("x_max")), lambda: F.col("emp_bins"))

    long = t.select(*by, "n", "x_min", "x_max", "skewness", "kurtosis", F.explode(F.array_compact(F.array(*entries))).alias("_f"))
    long = long.select(*by, "_f.family", "n", "x_min", "x_max", "skewness", "kurtosis", "_f.k", "_f.loglik", "_f.params")
    long = long.where(F.col("loglik").isNotNull() & ~F.isnan("loglik") & (F.abs(F.col("loglik")) < float("inf")))
    return long.withColumns(
        {"aic": 2 * F.col("k") - 2 * F.col("loglik"), "bic": F.col("k") * F.ln(F.col("n").cast("double")) - 2 * F.col("loglik")}
    )


def _outer_one(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join of two tables of at most one row."""
    one = F.lit(1)
    return left.withColumn("_one", one).join(F.broadcast(right.withColumn("_one", one)), "_one", "left").drop("_one")


def rank_fits(fits: DataFrame, by: Sequence[str], top_n: int = 3) -> DataFrame:
    """Best families by AIC per key; a key has at most nine rows here."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("aic", "family")
    return fits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def fit_distributions(df: DataFrame, column: str, by: Sequence[str] = (), top_n: int = 3, families: Sequence[str] | None = None) -> DataFrame:
    return rank_fits(fit_table(df, column, by, families), list(by), top_n)


# -- goodness of fit ----------------------------------------------------------------------------


def ks_statistic(df: DataFrame, column: str, fits: DataFrame, by: Sequence[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance and asymptotic p-value of every fitted family, per key.

    Ranks come from the value counts by an ordered scan, so one huge column is fine.
    """
    by = list(by)
    ensure_checkpoint_dir(df.sparkSession)
    fits = fits.checkpoint()  # a few rows per key; the fitting passes run once
    rows = value_rows(df, column, by)
    stats = base_stats(rows, by).select(*by, F.col("n").alias("_n"), F.when(F.col("x_min") <= 0, SHIFT_FLOOR - F.col("x_min")).otherwise(0.0).alias("_off"))
    counts = rows.groupBy(*by, V).agg(F.count(F.lit(1)).alias("_k"))
    ranked = OrderedScan(counts, by, [V], rows_per_bucket).running({"_upto": ("sum", F.col("_k"))}).attach(stats).rows()
    chosen = fits.where(F.col("family") != "empirical").select(*by, "family", "params")
    # a key has at most eight families, so the join repeats each distinct value at most eight times
    t = attach_stats(ranked, chosen.groupBy(*by).agg(F.collect_list(F.struct("family", "params")).alias("_fits")), by)
    t = t.withColumn("_fit", F.explode("_fits")).withColumns({"family": F.col("_fit.family"), "_p": F.col("_fit.params")}).drop("_fits", "_fit")
    g = lambda name: F.col("_p")[name]
    y = F.col(V) + F.col("_off")
    z = F.when(F.col("family") == "normal", (F.col(V) - g("loc")) / g("scale")).when(F.col("family") == "lognormal", F.ln(y / g("scale")) / g("shape"))
    t = t.withColumn("_z", z)
    u = (F.col(V) - g("loc")) / g("scale")
    c = g("c")
    closed = (
        F.when(F.col("family").isin("normal", "lognormal"), normal_cdf("_z"))
        .when(F.col("family") == "uniform", u)
        .when(F.col("family") == "triangular", F.when(u < c, u * u / c).otherwise(1 - (1 - u) * (1 - u) / (1 - c)))
        .when(F.col("family") == "weibull", 1 - F.exp(-F.pow(y / g("scale"), g("shape"))))
    )
    easy = t.where(F.col("family").isin("normal", "lognormal", "uniform", "triangular", "weibull")).withColumn("_cdf", closed)
    gam = t.where(F.col("family") == "gamma").withColumn("_cdf", gamma_cdf(g("shape"), y / g("scale")))
    poi = t.where(F.col("family") == "poisson").withColumn("_cdf", 1 - gamma_cdf(F.col(V) + 1, g("mu")))
    neg = t.where(F.col("family") == "negative_binomial").withColumn("_cdf", beta_cdf(g("n"), F.col(V) + 1, g("p")))
    parts = [easy]
    present = {r[0] for r in fits.select("family").distinct().collect()}
    parts += [part for name, part in (("gamma", gam), ("poisson", poi), ("negative_binomial", neg)) if name in present]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    above = F.col("_upto") / F.col("_n") - F.col("_cdf")
    below = F.col("_cdf") - (F.col("_upto") - F.col("_k")) / F.col("_n")
    out = everything.groupBy(*by, "family").agg(F.max(F.greatest(above, below)).alias("ks_statistic"), F.max("_n").alias("n"))
    lam = F.sqrt(F.col("n").cast("double")) * F.col("ks_statistic")
    tail = F.lit(0.0)
    for j in range(1, 21):
        tail = tail + (2.0 if j % 2 else -2.0) * F.exp(-2.0 * j * j * lam * lam)
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("ks_p_value", p)


# -- densities ------------------------------------------------------------------------------------


def density_curve(fits: DataFrame, by: Sequence[str] = (), points: int = 160) -> DataFrame:
    """Density on a grid over the range widened by 8 %, integers for the count families."""
    pad = (F.col("x_max") - F.col("x_min")) * 0.08
    t = fits.where(F.col("family") != "empirical").withColumn("_pad", F.when(pad > 0, pad).otherwise(1.0))
    count_family = F.col("family").isin("poisson", "negative_binomial")
    low, high = F.col("x_min") - F.col("_pad"), F.col("x_max") + F.col("_pad")
    whole = F.transform(F.sequence(F.ceil(F.greatest(low, F.lit(0.0))), F.floor(high)), lambda v: v.cast("double"))
    even = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i * (high - low) / (points - 1))
    t = t.withColumn("x", F.explode(F.when(count_family, whole).otherwise(even)))
    g = lambda name: F.col("params")[name]
    x = F.col("x")
    half_tau = 0.5 * math.log(2 * math.pi)
    z = (x - g("loc")) / g("scale")
    c = g("c")
    inside = (z >= 0) & (z <= 1)
    lnz = F.ln(x / g("scale")) / g("shape")
    y = (
        F.when(F.col("family") == "normal", F.exp(-0.5 * z * z - half_tau) / g("scale"))
        .when(F.col("family") == "uniform", F.when(inside, 1 / g("scale")).otherwise(0.0))
        .when(F.col("family") == "triangular", F.when(inside, F.when(z < c, 2 * z / c).otherwise(2 * (1 - z) / (1 - c)) / g("scale")).otherwise(0.0))
        .when(F.col("family") == "poisson", F.exp(x * F.ln(g("mu")) - g("mu") - ln_gamma(x + 1)))
        .when(
            F.col("family") == "negative_binomial",
            F.exp(ln_gamma(x + g("n")) - ln_gamma(g("n")) - ln_gamma(x + 1) + g("n") * F.ln(g("p")) + x * F.ln(1 - g("p"))),
        )
        .when(x <= 0, 0.0)
        .when(F.col("family") == "lognormal", F.exp(-0.5 * lnz * lnz - half_tau) / (x * g("shape")))
        .when(F.col("family") == "weibull", g("shape") / g("scale") * F.pow(z, g("shape") - 1) * F.exp(-F.pow(z, g("shape"))))
        .when(F.col("family") == "gamma", F.exp((g("shape") - 1) * F.ln(x) - x / g("scale") - g("shape") * F.ln(g("scale")) - ln_gamma(g("shape"))))
    )
    return t.select(*by, "family", "x", y.alias("density"))


