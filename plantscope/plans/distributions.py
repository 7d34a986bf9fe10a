"""Distribution-fitting queries over ``events.value`` and ``documents.n_chars``."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.functions.special import normal_cdf_sql
from plantscope.operators import distributions as di
from plantscope.plans.registry import Query, read, tidy

KEYS = ["event_type"]


def events(spark, d):
    return read(spark, d, "events")


def counts_table(spark, d):
    return read(spark, d, "conversations").select("role", "turn")


def flat(df):
    """Parameters as text columns for comparison."""
    names = sorted({"shape", "loc", "scale", "mu", "n", "p", "c", "min", "max"})
    return df.select(
        *[c for c in df.columns if c not in ("params", "skewness", "kurtosis", "x_min", "x_max")],
        *[F.col("params")[n].alias(f"p_{n}") for n in names],
    )


def histogram(spark, d):
    return tidy(di.histogram_table(events(spark, d), "value", KEYS))


HIST_CTE = """s AS (SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, least(greatest(floor(sqrt(count(value))),5),30)::INT AS b FROM events GROUP BY 1),
h AS (SELECT event_type, least(floor((value-lo)/((hi-lo)/b)), b-1)::BIGINT AS bin, count(*) AS c FROM events JOIN s USING (event_type) GROUP BY 1,2),
g AS (SELECT event_type, n, lo, hi, b, (hi-lo)/b AS w, unnest(generate_series(0, b-1)) AS bin FROM s),
hh AS (SELECT g.event_type, g.bin, lo + g.bin*w AS "left", lo + (g.bin+1)*w AS "right", coalesce(c,0) AS c, n, b, w FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.bin = h.bin)"""


def shapes(spark, d):
    return tidy(di.shape_summary(events(spark, d), "value", KEYS))


SHAPE_SQL = """WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round(avg(((value-m)/s)**3),6)+0.0 AS skewness, round(avg(((value-m)/s)**4)-3,6)+0.0 AS kurtosis FROM events JOIN m USING (event_type) GROUP BY 1"""


def family(name, column="value", table=events, keys=KEYS, digits=4):
    def run(spark, d):
        t = flat(di.fit_table(table(spark, d), column, keys, [name]))
        cols = [c for c in t.columns if not c.startswith("p_")]
        used = {"normal": ["loc", "scale"], "lognormal": ["shape", "scale"], "uniform": ["loc", "scale"], "poisson": ["mu"], "empirical": ["min", "max"],
                "negative_binomial": ["n", "p"], "gamma": ["shape", "scale"], "weibull": ["shape", "scale"], "triangular": ["c", "loc", "scale"]}[name]
        return tidy(t.select(*cols, *[f"p_{u}" for u in used]), digits)

    return run


def fit_sql(fam, k, ll, params, source, keys="event_type", digits=4):
    ps = ", ".join(f"round({e},{digits})+0.0 AS p_{n}" for n, e in params.items())
    return f"""WITH t AS ({source}), u AS (SELECT *, {ll} AS ll FROM t) SELECT {keys}, '{fam}' AS family, n, {k}::BIGINT AS k, round(ll,{digits})+0.0 AS loglik,
 round(2*{k}-2*ll,{digits})+0.0 AS aic, round({k}*ln(n)-2*ll,{digits})+0.0 AS bic, {ps} FROM u"""


EV = "SELECT event_type, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, avg(ln(value)) AS lm, stddev_pop(ln(value)) AS ls FROM events GROUP BY 1"
TURNS = "SELECT role, count(*) AS n, avg(turn) AS m, var_pop(turn) AS v, sum(lgamma(turn+1)) AS lf FROM conversations GROUP BY 1"

SHIFTED = "SELECT o_orderstatus, count(*) AS n, avg(ln(y)) AS lm, stddev_pop(ln(y)) AS ls FROM (SELECT o_orderstatus, v - min(v) OVER (PARTITION BY o_orderstatus) + 1e-6 AS y FROM (SELECT o_orderstatus, (o_custkey % 50)::DOUBLE - 20 AS v FROM orders)) GROUP BY 1"


def shifted_lognormal(spark, d):
    t = read(spark, d, "orders").select("o_orderstatus", ((F.col("o_custkey") % 50) - 20).cast("double").alias("v"))
    return family("lognormal", "v", lambda *_: t, ["o_orderstatus"])(spark, d)


def ranked(spark, d):
    return tidy(di.fit_distributions(events(spark, d), "value", KEYS, 3).select(*KEYS, "rank", "family", "aic"), 3)


def ranked_closed(spark, d):
    fams = ["normal", "lognormal", "uniform", "empirical"]
    return tidy(di.fit_distributions(events(spark, d), "value", KEYS, 4, fams).select(*KEYS, "rank", "family", "k", "aic", "bic"), 4)


RANK_SQL = f"""WITH {HIST_CTE}, t AS ({EV}), e AS (SELECT event_type, sum(c*ln(c/(n*w)+2.220446049250313e-16)) AS ll, max(b) AS k FROM hh GROUP BY 1),
f AS (SELECT event_type, n, 'normal' AS family, 2 AS k, -0.5*n*(ln(2*pi())+2*ln(s)+1) AS ll FROM t UNION ALL SELECT event_type, n, 'lognormal', 3, -n*lm-0.5*n*(ln(2*pi())+2*ln(ls)+1) FROM t
 UNION ALL SELECT event_type, n, 'uniform', 2, -n*ln(hi-lo) FROM t UNION ALL SELECT event_type, n, 'empirical', e.k, e.ll FROM t JOIN e USING (event_type))
SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY 2*k-2*ll, family) AS rank, family, k::BIGINT AS k, round(2*k-2*ll,4)+0.0 AS aic, round(k*ln(n)-2*ll,4)+0.0 AS bic FROM f"""

KS_FAMS = ["normal", "lognormal", "uniform"]


def ks(fams, column="value", table=events, keys=KEYS):
    def run(spark, d):
        df = table(spark, d)
        return tidy(di.ks_statistic(df, column, di.fit_table(df, column, keys, fams), keys))

    return run


_P = " + ".join(f"({2 if j % 2 else -2})*exp(-2.0*{j}*{j}*n*d*d)" for j in range(1, 21))
KS_SQL = f"""WITH t AS ({EV}), r AS (SELECT event_type, value AS x, cume_dist() OVER w AS hi_c, (rank() OVER w - 1)/n AS lo_c, n, m, s, lm, ls, lo, hi
 FROM events JOIN t USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY value)),
z AS (SELECT *, (x-m)/s AS zn, (ln(x)-lm)/ls AS zl FROM r),
c AS (SELECT event_type, 'normal' AS family, n, hi_c, lo_c, {normal_cdf_sql('zn')} AS f FROM z UNION ALL SELECT event_type, 'lognormal', n, hi_c, lo_c, {normal_cdf_sql('zl')} FROM z
 UNION ALL SELECT event_type, 'uniform', n, hi_c, lo_c, (x-lo)/(hi-lo) FROM z),
k AS (SELECT event_type, family, n, max(greatest(hi_c - f, f - lo_c)) AS d FROM c GROUP BY 1,2,3)
SELECT event_type, family, n, round(d,6)+0.0 AS ks_statistic, round(CASE WHEN sqrt(n)*d < 0.2 THEN 1.0 ELSE least(greatest({_P},0),1) END,6)+0.0 AS ks_p_value FROM k"""


def density(families=None):
    def run(spark, d):
        return tidy(di.density_curve(di.fit_table(events(spark, d), "value", KEYS, families), KEYS), 7)

    return run


DENS_SQL = f"""WITH t AS ({EV}), g AS (SELECT *, lo-(hi-lo)*0.08 + i*((hi-lo)*1.16)/159 AS x FROM (SELECT *, unnest(generate_series(0,159)) AS i FROM t))
SELECT event_type, 'normal' AS family, round(x,7)+0.0 AS x, round(exp(-0.5*((x-m)/s)**2)/(s*sqrt(2*pi())),7)+0.0 AS density FROM g
UNION ALL SELECT event_type, 'lognormal', round(x,7)+0.0, CASE WHEN x <= 0 THEN 0.0 ELSE round(exp(-0.5*((ln(greatest(x,1e-300))-lm)/ls)**2)/(x*ls*sqrt(2*pi())),7)+0.0 END FROM g
UNION ALL SELECT event_type, 'uniform', round(x,7)+0.0, round(CASE WHEN x >= lo AND x <= hi THEN 1/(hi-lo) ELSE 0 END,7)+0.0 FROM g"""

# the likelihood of every value as mode, by running sums over the value counts
TRIANGLE_SQL = f"""WITH t AS ({EV}), c AS (SELECT event_type, value AS x, count(*) AS k FROM events GROUP BY 1,2),
w AS (SELECT c.*, n, lo-(hi-lo)/n AS a, hi+(hi-lo)/n AS b FROM c JOIN t USING (event_type)),
s AS (SELECT *, sum(k) OVER u AS n1, sum(k*ln(x-a)) OVER u AS l1, sum(k*ln(b-x)) OVER u AS r1, sum(k*ln(b-x)) OVER (PARTITION BY event_type) AS rt FROM w WINDOW u AS (PARTITION BY event_type ORDER BY x)),
l AS (SELECT *, n*ln(2/(b-a))+l1-n1*ln(x-a)+rt-r1-(n-n1)*ln(b-x) AS ll FROM s),
g AS (SELECT event_type, n, a, b, max(ll) AS ll, arg_max(x, ll) AS mode FROM l GROUP BY 1,2,3,4)
SELECT event_type, 'triangular' AS family, n, 3::BIGINT AS k, round(ll,4)+0.0 AS loglik, round(6-2*ll,4)+0.0 AS aic, round(3*ln(n)-2*ll,4)+0.0 AS bic,
 round((mode-a)/(b-a),4)+0.0 AS p_c, round(a,4)+0.0 AS p_loc, round(b-a,4)+0.0 AS p_scale FROM g"""

QUERIES = [
    Query("distribution_histogram", histogram, f"""WITH {HIST_CTE} SELECT event_type, bin, round("left",6)+0.0 AS "left", round("right",6)+0.0 AS "right", c AS count FROM hh"""),
    Query("distribution_shape", shapes, SHAPE_SQL),
    Query("distribution_normal", family("normal"), fit_sql("normal", 2, "-0.5*n*(ln(2*pi())+2*ln(s)+1)", {"loc": "m", "scale": "s"}, EV)),
    Query("distribution_lognormal", family("lognormal"), fit_sql("lognormal", 3, "-n*lm-0.5*n*(ln(2*pi())+2*ln(ls)+1)", {"shape": "ls", "scale": "exp(lm)"}, EV)),
    Query("distribution_lognormal_shifted", shifted_lognormal, fit_sql("lognormal", 3, "-n*lm-0.5*n*(ln(2*pi())+2*ln(ls)+1)", {"shape": "ls", "scale": "exp(lm)"}, SHIFTED, "o_orderstatus")),
    Query("distribution_uniform", family("uniform"), fit_sql("uniform", 2, "-n*ln(hi-lo)", {"loc": "lo", "scale": "hi-lo"}, EV)),
    Query("distribution_triangular", family("triangular"), TRIANGLE_SQL),
    Query("distribution_weibull", family("weibull")),
    Query("distribution_gamma", family("gamma")),
    Query("distribution_poisson", family("poisson", "turn", counts_table, ["role"]), fit_sql("poisson", 1, "n*m*ln(m)-n*m-lf", {"mu": "m"}, TURNS + " HAVING count(*) >= 10 AND avg(turn) > 0", "role")),
    Query("distribution_negative_binomial", family("negative_binomial", "turn", counts_table, ["role"]), fit_sql(
        "negative_binomial", 2, "lr - n*lgamma(r) - lf + n*(r*ln(p)+m*ln(1-p))", {"n": "r", "p": "p"},
        f"SELECT s.*, (SELECT sum(lgamma(turn + s.r)) FROM conversations c WHERE c.role = s.role) AS lr FROM (SELECT *, m/v AS p, m*(m/v)/(1-m/v) AS r FROM ({TURNS}) WHERE v > m AND n >= 10) s", "role")),
    Query("distribution_empirical", family("empirical"), f"""WITH {HIST_CTE}, e AS (SELECT event_type, n, max(b) AS k, sum(c*ln(c/(n*w)+2.220446049250313e-16)) AS ll FROM hh GROUP BY 1,2)
SELECT event_type, 'empirical' AS family, n, k::BIGINT AS k, round(ll,4)+0.0 AS loglik, round(2*k-2*ll,4)+0.0 AS aic, round(k*ln(n)-2*ll,4)+0.0 AS bic,
 round(lo,4)+0.0 AS p_min, round(hi,4)+0.0 AS p_max FROM e JOIN (SELECT event_type, lo, hi FROM s) USING (event_type)"""),
    Query("distribution_ranked_closed_forms", ranked_closed, RANK_SQL),
    Query("distribution_ranked_fits", ranked),
    Query("distribution_ks", ks(KS_FAMS), KS_SQL),
    Query("distribution_ks_all_families", ks(None)),
    Query("distribution_ks_counts", ks(["poisson", "negative_binomial"], "turn", counts_table, ["role"])),
    Query("distribution_density_curve", density(["normal", "lognormal", "uniform"]), DENS_SQL),
    Query("distribution_density_curve_all", density()),
]
