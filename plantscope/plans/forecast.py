"""Forecast, risk, route and de-identification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.operators import deidentify as de
from plantscope.operators import forecast as fc
from plantscope.operators import frames as fr
from plantscope.operators import models as md
from plantscope.operators import risk as rk
from plantscope.operators import routes as rt
from plantscope.operators import series_models as sm
from plantscope.operators import timeseries as ts
from plantscope.operators import validation as va
from plantscope.operators.stats import attach_stats
from plantscope.plans.registry import Query, read, tidy
from plantscope.session import ensure_checkpoint_dir

KEYS = ["event_type"]
ORDER = ["ts", "event_id"]


def scan(spark, d):
    return fc.numbered_scan(read(spark, d, "events"), "value", ORDER, KEYS, 0.8)


N = """n AS (SELECT event_type, ts, event_id, value AS x, row_number() OVER w AS rn, lag(value) OVER w AS prev, lag(value,24) OVER w AS prev24, count(*) OVER (PARTITION BY event_type) AS n,
 greatest(1, least(count(*) OVER (PARTITION BY event_type)-1, floor(count(*) OVER (PARTITION BY event_type)*0.8)))::BIGINT AS t FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""


def metrics(df):
    return tidy(md.regression_metrics(df, "x", "predicted", KEYS).select(*KEYS, "n", "mae", "rmse"))


M = "SELECT event_type, count(*) AS n, round(avg(abs(x-p)),6)+0.0 AS mae, round(sqrt(avg((x-p)**2)),6)+0.0 AS rmse FROM f GROUP BY 1"


def ar1(spark, d):
    return tidy(fc.ar1_forecast(scan(spark, d)).select(*KEYS, "event_id", "rn", "predicted"))


AR = f"""{N}, ab AS (SELECT event_type, regr_intercept(x,prev) AS a, regr_slope(x,prev) AS b, count(*) AS k FROM n WHERE rn <= t AND prev IS NOT NULL GROUP BY 1)"""


def features(spark, d):
    f = ts.build_features(read(spark, d, "events"), "ts", ["event_id"], ["value"], [1, 2, 3], [3], KEYS)
    return f.where("is_complete").withColumnRenamed("value", "y")


FEATS = ["value_lag_1", "value_lag_2", "value_rolling_mean_3", "hour", "weekday"]


def split_features(spark, d):
    return ts.time_split(features(spark, d).drop("rn"), "ts", ["event_id"], 0.7, 0.1, KEYS)


def dynamic(fit):
    """A model a series, scored on its later rows."""

    def run(spark, d):
        ensure_checkpoint_dir(spark)
        f = split_features(spark, d).checkpoint()  # read by the fit and the scoring
        model = fit(f.where(F.col("split") == "train"))
        return tidy(md.regression_metrics(model.score(f.where(F.col("split") == "test")), "y", "predicted", KEYS, len(FEATS)))

    return run


def hybrid(baseline):
    """A baseline plus a forest a series on its residual over the exogenous columns."""

    def run(spark, d):
        f = ts.build_features(read(spark, d, "events"), "ts", ["event_id"], ["value"], [1, 2, 3], [3], KEYS, keep=["user_id"])
        f = f.where("is_complete").withColumnRenamed("value", "y")
        ensure_checkpoint_dir(spark)
        f = ts.time_split(f.drop("rn"), "ts", ["event_id"], 0.7, 0.1, KEYS).checkpoint()
        model = sm.fit_hybrid(f.where(F.col("split") == "train"), "y", baseline, ["hour", "weekday", "user_id"], series_keys=KEYS, row_keys=["event_id"])
        return tidy(fc.before_after(model.score(f.where(F.col("split") == "test"), "hybrid"), "y", baseline, "hybrid"))

    return run


def one_lag(spark, d):
    """Regressions on the value before, a row a series."""
    model = sm.fit_regressions(scan(spark, d).previous({"prev": "x"}).rows(), "x", ["prev"], KEYS)
    return tidy(model.models.select(*KEYS, "n", "intercept", F.get("coefficients", F.lit(0)).alias("slope"), "sse"), sse=3)


HISTORY = ["x_lag_1", "x_lag_2", "x_rolling_mean_3", "hour", "weekday"]


def history(spark, d):
    s = ts.history_features(scan(spark, d), ["x"], [1, 2], [3])
    return s._derive(ts.calendar_features(s.df, "ts"))


def recursive_forest(spark, d):
    s = scan(spark, d)
    rows = ts.calendar_features(ts.history_features(s, ["x"], [1, 2], [3]).rows(), "ts")
    ensure_checkpoint_dir(spark)
    train = rows.where((F.col("rn") > 3) & (F.col("rn") <= F.col("n_train"))).checkpoint()
    model = sm.fit_forests(train, "x", HISTORY, KEYS, ["event_id"])
    return tidy(fc.recursive_forecast(s, model, 12, [1, 2], [3], time="ts", seconds=3600.0))


def recursive(spark, d):
    s = scan(spark, d)
    rows = ts.calendar_features(ts.history_features(s, ["x"], [1, 3], [3, 5]).rows(), "ts")
    train = rows.where((F.col("rn") > 5) & (F.col("rn") <= F.col("n_train")))
    names = ["x_lag_1", "x_lag_3", "x_rolling_mean_3", "x_rolling_std_3", "x_rolling_mean_5", "x_first_difference", "x_rate_of_change", "hour", "weekday"]
    model = md.fit_least_squares(train, "x", {n: F.col(n) for n in names})
    return tidy(fc.recursive_forecast(s, model, 12, [1, 3], [3, 5], time="ts", seconds=3600.0))


MODEL = [*KEYS, "model"]
PLACE = {"initial": 1000, "horizon": 150, "step": 100}


def folds(spark, d):
    return va.validation_folds(scan(spark, d), **PLACE)


def fold_rows(spark, d):
    return tidy(fc.fold_metrics(folds(spark, d), MODEL))


# the same models, fitted fold by fold from the rows each fold trains on
FO = f"""{N}, n2 AS (SELECT *, lag(x,2) OVER (PARTITION BY event_type ORDER BY rn) AS prev2 FROM n),
en AS (SELECT event_type, (rn-1000)//100 AS fold, rn AS e, x AS last FROM n WHERE rn >= 1000 AND (rn-1000)%100 = 0 AND rn+150 <= n),
tr AS (SELECT en.event_type, fold, e, last, x, prev, prev2, prev24 FROM en JOIN n2 ON n2.event_type = en.event_type AND n2.rn <= e),
fit AS (SELECT event_type, fold, e, any_value(last) AS last, sum((x-prev)**2) AS s1, count(prev) AS k1, sum((x-prev24)**2) AS s24, count(prev24) AS k24,
 regr_intercept(x,prev) AS a, regr_slope(x,prev) AS b, regr_syy(x,prev)-regr_slope(x,prev)*regr_sxy(x,prev) AS sa FROM tr GROUP BY 1,2,3),
mo AS (SELECT event_type, fold, count(*) AS k, avg(x) AS my, avg(prev) AS m1, avg(prev2) AS m2, var_pop(prev) AS s11, var_pop(prev2) AS s22, covar_pop(prev,prev2) AS s12,
 covar_pop(prev,x) AS s1y, covar_pop(prev2,x) AS s2y, var_pop(x) AS syy FROM tr WHERE prev2 IS NOT NULL GROUP BY 1,2),
re AS (SELECT *, my-b1*m1-b2*m2 AS b0, k*(syy-b1*s1y-b2*s2y) AS sr FROM (SELECT *, (s22*s1y-s12*s2y)/(s11*s22-s12*s12) AS b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) AS b2 FROM mo)),
va AS (SELECT v.event_type, f.fold, v.ts, v.rn, v.x, v.prev, v.prev2, f.*EXCLUDE (event_type, fold), c.x AS cyc FROM n2 v JOIN fit f ON v.event_type = f.event_type AND v.rn > f.e AND v.rn <= f.e+150
 JOIN n2 c ON c.event_type = v.event_type AND c.rn = f.e-23+(v.rn-f.e-1)%24),
fd AS (SELECT event_type, 'naive' AS model, fold, x, last AS p, s1 AS s, k1 AS k, false AS obs FROM va
 UNION ALL SELECT event_type, 'seasonal', fold, x, cyc, s24, k24, false FROM va
 UNION ALL SELECT event_type, 'ar1', fold, x, a*(1-b**(rn-e))/(1-b)+b**(rn-e)*last, sa, k1, false FROM va
 UNION ALL SELECT event_type, 'regression', fold, x, b0+b1*prev+b2*prev2, sr, r.k, true FROM va JOIN re r USING (event_type, fold)),
fh AS (SELECT *, 1.959963984540054*sqrt(s/k)*sqrt(1+1/k) AS h FROM fd),
fm AS (SELECT event_type, model, fold, count(*) AS n, avg(abs(x-p)) AS mae, sqrt(avg((x-p)**2)) AS rmse, 1-sum((x-p)**2)/(var_pop(x)*count(*)) AS r2 FROM fd GROUP BY 1,2,3)"""


FITTED = {"initial": 1000, "horizon": 150, "step": 500}


def fitted(spark, d):
    """Dynamic regression, forest, boosted trees and the residual hybrid, a model a series and fold."""
    s = history(spark, d)
    linear = va.validation_folds(s, **FITTED, models=["dynamic"], features=HISTORY)
    ensure_checkpoint_dir(spark)
    rows = s.rows().where("rn > 3").checkpoint()  # read by every fit
    trees = {
        "forest": lambda t, y, f, k: sm.fit_forests(t, y, f, k, ["event_id"]),
        "boosted": lambda t, y, f, k: sm.fit_boosted_trees(t, y, f, k),
        "hybrid": lambda t, y, f, k: sm.fit_hybrid(t, y, "x_lag_1", ["hour", "weekday"], series_keys=k, row_keys=["event_id"]),
    }
    return linear.select(*KEYS, "rn", "fold", "x", "model", "predicted", "half_width", "uses_observed", "covered").unionByName(
        va.fitted_folds(rows, HISTORY, trees, **FITTED, series_keys=KEYS)
    )


def fitted_metrics(spark, d):
    return tidy(fc.fold_metrics(fitted(spark, d), MODEL))


def fitted_gate(spark, d):
    return tidy(fc.gate_decision(va.gate_summary(fitted(spark, d), user_coverage(spark, d, FITTED), KEYS)))


def mean_folds(spark, d):
    return tidy(fc.mean_fold_metrics(fc.fold_metrics(folds(spark, d), MODEL), MODEL))


def coverage(spark, d):
    return tidy(fc.interval_coverage(folds(spark, d), MODEL))


COV = FO + """, pf AS (SELECT event_type, model, fold, count(*) FILTER (abs(x-p) <= h) AS c, count(*) AS n, max(h) AS h, max(obs::INT) AS obs FROM fh GROUP BY 1,2,3),
cv AS (SELECT event_type, model, sum(c)::BIGINT AS covered_rows, sum(n)::BIGINT AS evaluated_rows, avg(2*h) AS mean_width, sum(c)/sum(n) AS coverage, count(*) AS n_folds, max(obs) AS obs FROM pf GROUP BY 1,2)"""


def user_coverage(spark, d, place=PLACE):
    """Share of a series' users that its validation rows hold."""
    ev = fc.numbered_scan(read(spark, d, "events"), "value", ORDER, KEYS, 0.8, ["user_id"]).rows()
    end = place["initial"] + place["horizon"] + F.floor((F.col("n_series") - place["initial"] - place["horizon"]) / place["step"]) * place["step"]
    seen = fr.group_coverage(ev, "user_id", (F.col("rn") > place["initial"]) & (F.col("rn") <= end), KEYS)
    return seen.select(*KEYS, F.col("coverage").alias("group_coverage"))


def gate(spark, d):
    """Leakage from the models' lags, group coverage over the users of a series."""
    t = va.gate_summary(folds(spark, d), user_coverage(spark, d), KEYS)
    return tidy(fc.gate_decision(t))


GATE = f"""WITH {COV}, us AS (SELECT n.event_type, user_id AS u, max((rn > 1000 AND rn <= 1150+(n-1150)//100*100)::INT) AS i FROM n JOIN events USING (event_id) GROUP BY 1,2),
gc AS (SELECT event_type, avg(i) AS g FROM us GROUP BY 1)
SELECT event_type, model, round(coverage,6)+0.0 AS coverage, n_folds, obs = 0 AS leakage_passed, round(g,6)+0.0 AS group_coverage,
 CASE WHEN obs = 1 OR g < 1 OR coverage < 0.8 THEN 'needs_review' ELSE 'approved' END AS gate, concat_ws(',', CASE WHEN obs = 1 THEN 'observed_validation_target_usage' END,
 CASE WHEN coverage < 0.8 THEN 'interval_coverage_below_threshold' END, CASE WHEN g < 1 THEN 'group_coverage_below_threshold' END) AS reasons FROM cv JOIN gc USING (event_type)"""


def importance(spark, d):
    f = features(spark, d)
    model = md.fit_forest(f, "y", FEATS, trees=100)
    return tidy(spark.createDataFrame(md.importances(model, FEATS), "feature string, importance double"))


def blocks(spark, d):
    f = features(spark, d)
    model = md.fit_linear(f, "y", FEATS)
    return tidy(fc.block_permutation(lambda t: md.score(model, t), f, "y", FEATS, ORDER, series_keys=KEYS))


def contrasts(spark, d):
    f = features(spark, d)
    model = md.fit_quadratic(f, "y", ["value_lag_1", "value_lag_2", "hour"])
    return tidy(fc.conditional_contrasts(lambda t: md.score(model, t), f, ["value_lag_1", "value_lag_2", "hour"], KEYS))


def daily(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg((F.avg("o_totalprice") / 997).alias("predicted"))
    li = read(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg((F.avg("l_extendedprice") / 97).alias("actual"))
    return fc.forecast_errors(o, li, ["ts"])


DAILY = """o AS (SELECT o_orderdate AS ts, avg(o_totalprice)/997 AS predicted FROM orders GROUP BY 1), l AS (SELECT l_shipdate AS ts, avg(l_extendedprice)/97 AS actual FROM lineitem GROUP BY 1), e AS (SELECT ts, predicted, actual, actual-predicted AS delta FROM o JOIN l USING (ts))"""


def improvement(spark, d):
    s = scan(spark, d)
    t = fc.naive_forecast(s).withColumnRenamed("predicted", "before")
    mean = s.df.where(F.col("rn") <= F.col("n_train")).groupBy(*KEYS).agg(F.avg("x").alias("after"))
    return tidy(fc.before_after(attach_stats(t, mean, KEYS), "x", "before", "after"))


def paths(spark, d):
    ev = read(spark, d, "events").select("event_type", F.dayofmonth("ts").alias("day"), "value")
    return fc.path_summary(ev, "day", "value", KEYS)


PATHS = "ps AS (SELECT event_type, day(ts) AS day, count(*) AS n, avg(value) AS mean, quantile_cont(value,0.05) AS p05, quantile_cont(value,0.5) AS p50, quantile_cont(value,0.95) AS p95 FROM events GROUP BY 1,2)"


def calibration(spark, d):
    obs = read(spark, d, "events").select("event_type", F.dayofmonth("ts").alias("day"), "value")
    return tidy(fc.path_coverage(paths(spark, d).drop("n"), obs, ["event_type", "day"], "value"))


def appended(spark, d):
    """Later rows appended to history, halved in time order."""
    ev = read(spark, d, "events").select("event_type", "ts", "event_id", "value")
    cut = F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    both = fr.append_rows(ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut))
    h = ts.chronological_halves(both, "ts", ["event_id"], KEYS)
    return tidy(h.groupBy("event_type", "half").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


# -- risk --------------------------------------------------------------------------------------


def ev(spark, d):
    return read(spark, d, "events")


def bootstrap(spark, d):
    b = rk.bootstrap_rows(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"], 20_000)
    return tidy(b.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 1000).alias("mean")))


PCT = ", ".join(f"round(quantile_cont(value,{p}),6)+0.0 AS {n}" for n, p in rk.PERCENTILES.items())

RISK = """SELECT event_type, count(value) AS n, avg(value) AS m, stddev_pop(value) AS s, count(*) FILTER (value < 0.5 OR value > 150) AS ng FROM events GROUP BY 1"""

CAND = """l AS (SELECT user_id, value AS v, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS mr FROM events),
c AS (SELECT user_id, avg(v) AS m, count(*) AS n, count(*) FILTER (v < 1 OR v > 120)/count(*) AS p, avg(mr)/1.128 AS sw FROM l GROUP BY 1), k AS (SELECT *, CASE WHEN sw > 0 THEN least((120-m)/(3*sw),(m-1)/(3*sw)) END AS cpk FROM c)"""


def ranking(objective, target=None, cpk_min=1.33):
    def run(spark, d):
        return tidy(rk.candidate_ranking(ev(spark, d), "user_id", "value", ORDER, 1.0, 120.0, objective, target, cpk_min))

    return run


def ranking_sql(score, feasible="true"):
    return f"""WITH {CAND}, s AS (SELECT *, {score} AS sc, {feasible} AS ok FROM k) SELECT user_id, round(1-p,6)+0.0 AS yield, round(p*1e6,6)+0.0 AS dpmo, round(m,6)+0.0 AS predicted_mean, round(cpk,6)+0.0 AS cpk,
 round(sc,6)+0.0 AS score, ok AS feasible, round(min(sc) FILTER (ok) OVER (ORDER BY user_id),6)+0.0 AS best_so_far FROM s"""


def top(spark, d):
    r = rk.candidate_ranking(ev(spark, d), "user_id", "value", ORDER, 1.0, 120.0, "hit_target", 50.0)
    return tidy(rk.top_candidates(r.select("user_id", "predicted_mean", "score"), "user_id"))


# -- routes --------------------------------------------------------------------------------------


def route(spark, d, cyclic=False):
    """Customers and suppliers flow to their nation, nations to their region."""
    n = read(spark, d, "nation")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    back = F.array(tag("N", "r_regionkey")) if cyclic else F.array().cast("array<string>")
    parts = [
        read(spark, d, "customer").select(tag("C", "c_custkey").alias("node_id"), F.col("c_mktsegment").alias("node_type"), F.array(tag("N", "c_nationkey"), F.lit("lost")).alias("edges")),
        read(spark, d, "supplier").select(tag("S", "s_suppkey").alias("node_id"), tag("supplier", "s_suppkey").alias("node_type"), F.when(F.col("s_suppkey") % 10 != 0, F.array(tag("N", "s_nationkey"))).otherwise(F.array().cast("array<string>")).alias("edges")),
        n.select(tag("N", "n_nationkey").alias("node_id"), F.col("n_name").alias("node_type"), F.array(tag("R", "n_regionkey")).alias("edges")),
        read(spark, d, "region").select(tag("R", "r_regionkey").alias("node_id"), F.col("r_name").alias("node_type"), back.alias("edges")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES = """nd AS (SELECT 'C'||c_custkey AS node_id, c_mktsegment AS node_type FROM customer UNION ALL SELECT 'S'||s_suppkey, 'supplier'||s_suppkey FROM supplier UNION ALL SELECT 'N'||n_nationkey, n_name FROM nation UNION ALL SELECT 'R'||r_regionkey, r_name FROM region)"""
EDGES = """ed AS (SELECT 'C'||c_custkey AS from_id, 'N'||c_nationkey AS to_id FROM customer UNION ALL SELECT 'S'||s_suppkey, 'N'||s_nationkey FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT 'N'||n_nationkey, 'R'||n_regionkey FROM nation)"""
BACK = "SELECT 'R'||r_regionkey AS from_id, 'N'||r_regionkey AS to_id FROM region"


def report(spark, d, cyclic):
    nodes = route(spark, d, cyclic)
    return rt.route_report(nodes, rt.edge_list(nodes))


REPORT = """SELECT (SELECT count(*) FROM nd) AS n_nodes, (SELECT count(*) FROM {e}) AS n_edges, (SELECT count(*) FROM nd WHERE node_id NOT IN (SELECT from_id FROM {e} UNION SELECT to_id FROM {e})) AS n_disconnected,
 (SELECT count(*) FROM (SELECT node_type FROM nd GROUP BY 1 HAVING count(*) > 1)) AS n_repeated_types, (SELECT max(depth) > 6 FROM walk) AS has_cycle"""
WALK = "walk AS (SELECT DISTINCT from_id AS s, to_id AS at, 1 AS depth FROM {e} UNION SELECT s, e.to_id, depth+1 FROM walk JOIN {e} e ON e.from_id = walk.at WHERE depth < 8)"

# -- de-identification -----------------------------------------------------------------------------

KEY = bytes(range(16))  # a test key; real keys come from a secret store
PAD = KEY.ljust(64, b"\0")
INNER, OUTER = bytes(b ^ 0x36 for b in PAD).hex(), bytes(b ^ 0x5C for b in PAD).hex()


def customers(spark, d):
    return read(spark, d, "customer")


def plan(df):
    return de.make_plan(df, sensitive=["c_mktsegment", "c_nationkey"], excluded=["c_custkey"], overrides={"c_mktsegment": "masked"})


def plan_table(spark, d):
    df = customers(spark, d)
    p = de.make_plan(df, ["c_mktsegment", "c_acctbal"], ["c_custkey"], {"c_mktsegment": "noise", "c_acctbal": "noise"}, noise_ratio=0.1)
    return tidy(p.table(df), 4)


def masked(spark, d):
    df = customers(spark, d)
    return tidy(de.apply_plan(df, plan(df), KEY, ["c_custkey"]).withColumn("c_nationkey", F.col("c_nationkey").cast("string")), 2)


HMAC = f"substr(sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(c_name)))), 1, 32)"


def noisy(spark, d):
    df = customers(spark, d)
    p = de.make_plan(df, ["c_acctbal"], [], {"c_acctbal": "noise"}, noise_std=100.0)
    out = de.apply_plan(df.withColumn("raw", F.col("c_acctbal")), de.Plan(["c_custkey", "raw"], {"c_acctbal": "noise"}, [], {"c_acctbal": p.noise["c_acctbal"]}), KEY, ["c_custkey"])
    e = F.col("c_acctbal") - F.col("raw")
    return tidy(out.agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.kurtosis(e).alias("kurtosis")))


def nested(spark, d):
    df = read(spark, d, "orders").select(
        F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("state")).alias("owner")).alias("order"),
        F.array(F.struct(F.col("o_orderpriority").alias("line"), F.col("o_totalprice").alias("price"))).alias("parts"),
    )
    m = de.mask_nested(df, keys=["customer"], paths=["parts.line"])
    return tidy(m.select("order.id", F.col("order.owner.customer").alias("customer"), F.col("order.owner.state").alias("state"), F.col("parts")[0]["line"].alias("line"), F.col("parts")[0]["price"].alias("price")), 2)


QUERIES = [
    Query("forecast_naive", lambda s, d: metrics(fc.naive_forecast(scan(s, d))), f"WITH {N}, f AS (SELECT event_type, x, prev AS p FROM n WHERE rn > t) {M}"),
    Query("forecast_naive_fixed", lambda s, d: metrics(fc.naive_forecast(scan(s, d), True)), f"WITH {N}, f AS (SELECT a.event_type, a.x, b.x AS p FROM n a JOIN n b ON a.event_type = b.event_type AND b.rn = b.t WHERE a.rn > a.t) {M}"),
    Query("forecast_seasonal", lambda s, d: metrics(fc.seasonal_forecast(scan(s, d), 24)), f"WITH {N}, f AS (SELECT event_type, x, prev24 AS p FROM n WHERE rn > t) {M}"),
    Query("forecast_seasonal_fixed", lambda s, d: metrics(fc.seasonal_forecast(scan(s, d), 24, True)), f"WITH {N}, f AS (SELECT a.event_type, a.x, b.x AS p FROM n a JOIN n b ON a.event_type = b.event_type AND b.rn = a.t-24+(a.rn-a.t-1)%24+1 WHERE a.rn > a.t) {M}"),
    Query("forecast_ar1_parameters", lambda s, d: tidy(fc.ar1_parameters(scan(s, d))), f"WITH {AR} SELECT event_type, round(a,6)+0.0 AS intercept, round(b,6)+0.0 AS phi, k AS n FROM ab"),
    Query("forecast_ar1", ar1, f"""WITH {AR}, la AS (SELECT event_type, x AS last FROM n WHERE rn = t) SELECT event_type, event_id, rn, round(a*(1-b**(rn-t))/(1-b)+(b**(rn-t))*last,6)+0.0 AS predicted FROM n JOIN ab USING (event_type) JOIN la USING (event_type) WHERE rn > t"""),
    Query("forecast_dynamic_regression", dynamic(lambda t: sm.fit_regressions(t, "y", FEATS, KEYS))),
    Query("forecast_one_lag_regression", one_lag, f"""WITH {N} SELECT event_type, count(prev) AS n, round(regr_intercept(x,prev),6)+0.0 AS intercept, round(regr_slope(x,prev),6)+0.0 AS slope,
 round(regr_syy(x,prev)-regr_slope(x,prev)*regr_sxy(x,prev),3)+0.0 AS sse FROM n GROUP BY 1"""),
    Query("forecast_forest", dynamic(lambda t: sm.fit_forests(t, "y", FEATS, KEYS, ["event_id"]))),
    Query("forecast_boosted", dynamic(lambda t: sm.fit_boosted_trees(t, "y", FEATS, KEYS))),
    Query("forecast_residual_hybrid", hybrid("value_lag_1")),
    Query("forecast_residual_hybrid_mean", hybrid("value_rolling_mean_3")),
    Query("forecast_recursive_forest", recursive_forest),
    Query("forecast_fitted_fold_metrics", fitted_metrics),
    Query("forecast_fitted_gate", fitted_gate),
    Query("forecast_recursive", recursive),
    Query("forecast_fold_metrics", fold_rows, f"WITH {FO} SELECT event_type, model, fold, n, round(mae,6)+0.0 AS mae, round(rmse,6)+0.0 AS rmse, round(r2,6)+0.0 AS r2 FROM fm"),
    Query("forecast_mean_fold_metrics", mean_folds, f"WITH {FO} SELECT event_type, model, count(*) AS n_folds, round(avg(mae),6)+0.0 AS mae, round(avg(rmse),6)+0.0 AS rmse, round(avg(r2),6)+0.0 AS r2 FROM fm GROUP BY 1,2"),
    Query("forecast_interval_coverage", coverage, f"WITH {COV} SELECT event_type, model, covered_rows, evaluated_rows, round(mean_width,6)+0.0 AS mean_width, round(coverage,6)+0.0 AS coverage FROM cv"),
    Query("forecast_gate", gate, GATE),
    Query("forecast_importance", importance),
    Query("forecast_block_permutation", blocks),
    Query("forecast_conditional_contrasts", contrasts),
    Query("forecast_errors", lambda s, d: tidy(daily(s, d)), f"WITH {DAILY} SELECT ts, round(predicted,6)+0.0 AS predicted, round(actual,6)+0.0 AS actual, round(delta,6)+0.0 AS delta FROM e"),
    Query("forecast_error_summary", lambda s, d: tidy(fc.error_summary(daily(s, d))), f"WITH {DAILY} SELECT count(*) AS n, round(avg(abs(delta)),6)+0.0 AS mae, round(sqrt(avg(delta*delta)),6)+0.0 AS rmse FROM e"),
    Query("forecast_before_after", improvement, f"""WITH {N}, mm AS (SELECT event_type, avg(x) AS a FROM n WHERE rn <= t GROUP BY 1), h AS (SELECT x, prev AS b, a FROM n JOIN mm USING (event_type) WHERE rn > t)
SELECT count(*) AS n, round(avg(abs(x-b)),6)+0.0 AS mae_before, round(avg(abs(x-a)),6)+0.0 AS mae_after, round(sqrt(avg((x-b)**2)),6)+0.0 AS rmse_before, round(sqrt(avg((x-a)**2)),6)+0.0 AS rmse_after,
 round(avg(abs(x-b))-avg(abs(x-a)),6)+0.0 AS mae_improvement, avg(abs(x-a)) < avg(abs(x-b)) AS improved FROM h"""),
    Query("forecast_path_summary", lambda s, d: tidy(paths(s, d)), f"WITH {PATHS} SELECT event_type, day, n, round(mean,6)+0.0 AS mean, round(p05,6)+0.0 AS p05, round(p50,6)+0.0 AS p50, round(p95,6)+0.0 AS p95 FROM ps"),
    Query("forecast_path_coverage", calibration, f"WITH {PATHS} SELECT count(*) AS n, round(avg((value >= p05 AND value <= p95)::INT),6)+0.0 AS coverage FROM events e JOIN ps ON e.event_type = ps.event_type AND day(e.ts) = ps.day"),
    Query("forecast_appended_halves", appended, f"WITH {N} SELECT event_type, CASE WHEN rn <= floor(n/2) THEN 'adapt' ELSE 'holdout' END AS half, count(*) AS n, round(avg(x),6)+0.0 AS mean FROM n GROUP BY 1,2"),
    Query("risk_bootstrap_rows", bootstrap),
    Query("risk_spec", lambda s, d: tidy(rk.spec_risk(ev(s, d), "value", 0.5, 150.0, KEYS)), f"SELECT event_type, n, round(m,6)+0.0 AS mean, round(s,6)+0.0 AS std, ng AS ng_count, round(ng/n,6)+0.0 AS ng_probability, round(ng/n*1e6,6)+0.0 AS dpmo, round((m-0.5)/s,6)+0.0 AS z_lsl, round((150-m)/s,6)+0.0 AS z_usl FROM ({RISK})"),
    Query("risk_percentiles", lambda s, d: tidy(rk.percentiles(ev(s, d), "value", KEYS)), f"SELECT event_type, count(*) AS n, round(avg(value),6)+0.0 AS mean, round(stddev_pop(value),6)+0.0 AS std, {PCT} FROM events GROUP BY 1"),
    Query("risk_histogram", lambda s, d: tidy(rk.outcome_histogram(ev(s, d), "value", KEYS)), """WITH r AS (SELECT event_type, min(value) AS lo, (max(value)-min(value))/30 AS w FROM events GROUP BY 1), h AS (SELECT event_type, least(floor((value-lo)/w),29)::BIGINT AS bin, count(*) AS c FROM events JOIN r USING (event_type) GROUP BY 1,2),
g AS (SELECT *, unnest(generate_series(0,29)) AS bin FROM r) SELECT g.event_type, g.bin, round(lo+g.bin*w,6)+0.0 AS "left", round(lo+(g.bin+1)*w,6)+0.0 AS "right", coalesce(c,0) AS count, round(lo+(g.bin+0.5)*w,6)+0.0 AS center FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.bin = h.bin"""),
    Query("risk_empirical_cdf", lambda s, d: tidy(rk.empirical_cdf(ev(s, d), "value", KEYS)), "SELECT DISTINCT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value),6)+0.0 AS cdf FROM events"),
    Query("risk_five_numbers", lambda s, d: tidy(rk.five_numbers(ev(s, d), "value", KEYS)), "SELECT event_type, min(value) AS min, round(quantile_cont(value,0.25),6)+0.0 AS q1, round(median(value),6)+0.0 AS median, round(quantile_cont(value,0.75),6)+0.0 AS q3, max(value) AS max FROM events GROUP BY 1"),
    Query("risk_extrapolation_rate", lambda s, d: tidy(rk.extrapolation_rate(read(s, d, "lineitem"), read(s, d, "lineitem").where(F.col("l_returnflag") == "A").where("l_quantity < 45 and l_discount < 0.09"), ["l_quantity", "l_discount"])), """WITH t AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS e FROM lineitem WHERE l_returnflag='A' AND l_quantity < 45 AND l_discount < 0.09)
SELECT count(*) FILTER (l_quantity<a OR l_quantity>b OR l_discount<c OR l_discount>e) AS n_extrapolated, round(avg((l_quantity<a OR l_quantity>b OR l_discount<c OR l_discount>e)::INT),6)+0.0 AS rate FROM lineitem, t"""),
    Query("risk_compare_outcomes", lambda s, d: tidy(rk.compare_outcomes(ev(s, d).where("event_type = 'click'"), ev(s, d).where("event_type = 'view'"), "value", 0.5, 150.0)), f"""WITH r AS ({RISK}), b AS (SELECT m, s, ng/n*1e6 AS q FROM r WHERE event_type='click'), c AS (SELECT m AS m2, s AS s2, ng/n*1e6 AS q2 FROM r WHERE event_type='view')
SELECT round(m,6)+0.0 AS mean_baseline, round(s,6)+0.0 AS std_baseline, round(q,6)+0.0 AS dpmo_baseline, round(m2,6)+0.0 AS mean_candidate, round(s2,6)+0.0 AS std_candidate, round(q2,6)+0.0 AS dpmo_candidate, round(m2-m,6)+0.0 AS mean_shift, round((m2-m)/m,6)+0.0 AS mean_shift_share, round(1-s2/s,6)+0.0 AS std_reduction FROM b, c"""),
    Query("risk_compare_all_outcomes", lambda s, d: tidy(rk.compare_groups(ev(s, d), "value", 0.5, 150.0, "event_type", "click")), f"""WITH r AS ({RISK}), b AS (SELECT m, s, ng/n*1e6 AS q FROM r WHERE event_type='click'), c AS (SELECT event_type, m AS m2, s AS s2, ng/n*1e6 AS q2 FROM r WHERE event_type<>'click')
SELECT event_type, round(m2,6)+0.0 AS mean_candidate, round(s2,6)+0.0 AS std_candidate, round(q2,6)+0.0 AS dpmo_candidate, round(m,6)+0.0 AS mean_baseline, round(s,6)+0.0 AS std_baseline, round(q,6)+0.0 AS dpmo_baseline, round(m2-m,6)+0.0 AS mean_shift, round((m2-m)/m,6)+0.0 AS mean_shift_share, round(1-s2/s,6)+0.0 AS std_reduction FROM b, c"""),
    Query("risk_candidates_yield", ranking("maximize_yield"), ranking_sql("p-1")),
    Query("risk_candidates_target", ranking("hit_target", 50.0, 0.2), ranking_sql("abs(m-50.0)", "(cpk IS NULL OR cpk >= 0.2)")),
    Query("risk_top_candidates", top, f"WITH {CAND}, s AS (SELECT user_id, m, abs(m-50.0) AS sc, row_number() OVER (ORDER BY abs(m-50.0), user_id) AS rank FROM k) SELECT user_id, round(m,6)+0.0 AS predicted_mean, round(sc,6)+0.0 AS score, rank FROM s WHERE rank <= 10"),
    Query("route_edges", lambda s, d: rt.edge_list(route(s, d)), f"WITH {EDGES} SELECT from_id, to_id FROM ed"),
    Query("route_disconnected", lambda s, d: rt.disconnected_nodes(route(s, d), rt.edge_list(route(s, d))).select("node_id"), f"WITH {NODES}, {EDGES} SELECT node_id FROM nd WHERE node_id NOT IN (SELECT from_id FROM ed UNION SELECT to_id FROM ed)"),
    Query("route_repeated_types", lambda s, d: rt.repeated_types(route(s, d)), f"WITH {NODES} SELECT node_type, count(*) AS n FROM nd GROUP BY 1 HAVING count(*) > 1"),
    Query("route_cycle_edges", lambda s, d: rt.cyclic_edges(rt.edge_list(route(s, d, True))), "SELECT 'R'||r_regionkey AS from_id, 'N'||r_regionkey AS to_id FROM region UNION ALL SELECT 'N'||n_nationkey, 'R'||n_regionkey FROM nation WHERE n_nationkey = n_regionkey"),
    Query("route_report", lambda s, d: report(s, d, False), f"WITH RECURSIVE {NODES}, {EDGES}, {WALK.format(e='ed')} {REPORT.format(e='ed')}"),
    Query("route_report_cyclic", lambda s, d: report(s, d, True), f"WITH RECURSIVE {NODES}, {EDGES}, ec AS (SELECT * FROM ed UNION ALL {BACK}), {WALK.format(e='ec')} {REPORT.format(e='ec')}"),
    Query("deidentify_plan", plan_table, "SELECT 'c_nationkey' AS \"column\", 'keep' AS strategy, round(0.1*stddev_samp(c_nationkey),4)+0.0 AS sigma FROM customer UNION ALL SELECT 'c_name','hash',NULL UNION ALL SELECT 'c_mktsegment','hash',NULL UNION ALL SELECT 'c_acctbal','noise',round(0.1*stddev_samp(c_acctbal),4)+0.0 FROM customer UNION ALL SELECT 'c_custkey','exclude',NULL"),
    Query("deidentify_masked_table", masked, f"SELECT round(c_acctbal,2)+0.0 AS c_acctbal, {HMAC} AS c_name, 'MASKED' AS c_mktsegment, 'MASKED' AS c_nationkey FROM customer"),
    Query("deidentify_noise", noisy),
    Query("deidentify_fingerprint", lambda s, d: de.plan_fingerprint(customers(s, d), plan(customers(s, d)), KEY, ["c_custkey"])),
    Query("deidentify_bucketed", lambda s, d: customers(s, d).select("c_custkey", de.bucketed(F.col("c_acctbal")).alias("bucket")), "SELECT c_custkey, (floor(c_acctbal/10)*10)::BIGINT || '-' || (floor(c_acctbal/10)*10+10)::BIGINT AS bucket FROM customer"),
    Query("deidentify_standardized", lambda s, d: tidy(customers(s, d).select("c_custkey", de.standardized(F.col("c_acctbal"), 4500.0, 3100.0).alias("z"))), "SELECT c_custkey, round((c_acctbal-4500)/3100,6)+0.0 AS z FROM customer"),
    Query("deidentify_nested", nested, "SELECT o_orderkey AS id, 'MASKED' AS customer, o_orderstatus AS state, 'MASKED' AS line, round(o_totalprice,2)+0.0 AS price FROM orders"),
]
