"""Control-chart queries over ``events``: one series per event type, ordered by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.functions import constants as K
from plantscope.operators import control_charts as cc
from plantscope.operators import ordered
from plantscope.plans.registry import Query, read, tidy

KEYS = ["event_type"]
ORDER = ["ts", "event_id"]
SPEC = [("click", -30.0, 150.0), ("view", -25.0, 140.0), ("signup", -40.0, 190.0), ("error", 0.0, None), ("purchase", -200.0, 300.0)]
SPEC_SQL = "(VALUES ('click',-30.0::DOUBLE,150.0::DOUBLE),('view',-25.0,140.0),('signup',-40.0,190.0),('error',0.0,NULL),('purchase',-200.0,300.0)) spec(event_type,lsl,usl)"


def scan(spark, d):
    return cc.chart_scan(read(spark, d, "events"), "value", ORDER, KEYS)


def spec(spark):
    return spark.createDataFrame(SPEC, "event_type string, lsl double, usl double")


MR = """mr AS (SELECT event_type, ts, event_id, value AS x,
  abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS mr FROM events)"""
LIM = MR + """, lim AS (SELECT event_type, count(*) AS n, avg(x) AS center, stddev_samp(x) AS sigma_overall, avg(mr) AS mr_bar,
  avg(mr)/1.128 AS sigma FROM mr GROUP BY event_type)"""


def individuals_limits(spark, d):
    return tidy(cc.individuals_limits(scan(spark, d)))


def individuals_points(spark, d):
    return tidy(cc.individuals_points(scan(spark, d)))


def xbar(kind, size):
    def run(spark, d):
        groups = cc.subgroups(scan(spark, d), size)
        return tidy(cc.subgroup_limits(groups, size, KEYS, kind))

    return run


def xbar_points(kind, size):
    def run(spark, d):
        groups = cc.subgroups(scan(spark, d), size)
        return tidy(cc.subgroup_points(groups, cc.subgroup_limits(groups, size, KEYS, kind), KEYS, kind))

    return run


def sub_sql(size):
    return f"""sub AS (SELECT event_type, (rn-1)//{size} AS subgroup, avg(x) AS mean, max(x)-min(x) AS range, stddev_samp(x) AS sd
  FROM (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
  GROUP BY 1, 2 HAVING count(*) = {size})"""


def xbar_lim_sql(kind, size):
    spread = "range" if kind == "r" else "sd"
    if kind == "r":
        width, low, high, div = K.A2[size], K.D3[size], K.D4[size], K.D2[size]
    else:
        width, low, high, div = f"(3.0/({K.C4[size]}*sqrt({size})))", K.B3[size], K.B4[size], K.C4[size]
    return f"""slim AS (SELECT event_type, count(*) AS n_subgroups, avg(mean) AS center, avg({spread}) AS spread_bar,
   avg(mean)+{width}*avg({spread}) AS ucl, avg(mean)-{width}*avg({spread}) AS lcl, {high}*avg({spread}) AS spread_ucl,
   {low}*avg({spread}) AS spread_lcl, avg({spread})/{div} AS sigma, avg({spread})/{div}/sqrt({size}) AS sigma_mean FROM sub GROUP BY 1)"""


def xbar_sql(kind, size):
    cols = "center spread_bar ucl lcl spread_ucl spread_lcl sigma sigma_mean".split()
    return f"WITH {sub_sql(size)}, {xbar_lim_sql(kind, size)} SELECT event_type, n_subgroups, " + ", ".join(
        f"round({c},6)+0.0 AS {c}" for c in cols
    ) + " FROM slim"


def xbar_points_sql(kind, size):
    spread = "range" if kind == "r" else "sd"
    return f"""WITH {sub_sql(size)}, {xbar_lim_sql(kind, size)}
SELECT event_type, subgroup, round(mean,6)+0.0 AS mean, round({spread},6)+0.0 AS {spread}, round(center,6)+0.0 AS center,
 round(ucl,6)+0.0 AS ucl, round(lcl,6)+0.0 AS lcl, round(spread_ucl,6)+0.0 AS spread_ucl, round(spread_lcl,6)+0.0 AS spread_lcl,
 (mean>ucl OR mean<lcl) AS out_of_limits, ({spread}>spread_ucl OR {spread}<spread_lcl) AS spread_out
FROM sub JOIN slim USING (event_type)"""


def ewma(spark, d):
    return tidy(cc.ewma_points(scan(spark, d)))


EWMA_SQL = """WITH RECURSIVE st AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1),
r AS (SELECT event_type, ts, event_id, value AS x, m, s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events JOIN st USING (event_type)),
step AS (SELECT event_type, rn, x, m AS z FROM r WHERE rn = 1
  UNION ALL SELECT r.event_type, r.rn, r.x, 0.2*r.x + 0.8*step.z FROM step JOIN r ON r.event_type = step.event_type AND r.rn = step.rn + 1)
SELECT r.event_type, r.ts, r.event_id, r.rn, round(r.x,6)+0.0 AS x, round(step.z,6)+0.0 AS z, round(m,6)+0.0 AS center,
  round(m + 3*s*sqrt(0.2/1.8),6)+0.0 AS ucl, round(m - 3*s*sqrt(0.2/1.8),6)+0.0 AS lcl,
  (step.z > m + 3*s*sqrt(0.2/1.8) OR step.z < m - 3*s*sqrt(0.2/1.8)) AS signal
FROM r JOIN step USING (event_type, rn)"""
CUSUM_STEP = """st AS (SELECT event_type, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value),0) AS s FROM events GROUP BY 1),
r AS (SELECT event_type, ts, event_id, value AS x, n, m, s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn
  FROM events JOIN st USING (event_type)),
step AS (SELECT event_type, rn, 0.0::DOUBLE AS cp, 0.0::DOUBLE AS cm FROM r WHERE rn = 1
  UNION ALL SELECT r.event_type, r.rn, greatest(0.0, step.cp + (r.x-r.m)/r.s - 0.5), greatest(0.0, step.cm - (r.x-r.m)/r.s - 0.5)
  FROM step JOIN r ON r.event_type = step.event_type AND r.rn = step.rn + 1)"""


def cusum(spark, d):
    return tidy(cc.cusum_points(scan(spark, d)).select(*KEYS, *ORDER, "rn", "x", "c_plus", "c_minus", "signal"), 5)


def change_points(spark, d):
    return tidy(cc.change_points(scan(spark, d), decision=4.0), 5)


def change_summary(spark, d):
    return tidy(cc.change_point_summary(scan(spark, d), decision=4.0), 5)


def capability(size):
    def run(spark, d):
        return tidy(cc.capability(scan(spark, d), spec(spark), size))

    return run


def cap_cols(within):
    return f"""round(center,6)+0.0 AS center, round(sigma_overall,6)+0.0 AS sigma_overall, round({within},6)+0.0 AS sigma_within,
  lsl, usl, round((usl-lsl)/(6*{within}),6)+0.0 AS cp,
  CASE WHEN lsl IS NOT NULL AND usl IS NOT NULL THEN round(least((usl-center)/(3*{within}),(center-lsl)/(3*{within})),6)+0.0 END AS cpk,
  round((usl-lsl)/(6*sigma_overall),6)+0.0 AS pp,
  CASE WHEN lsl IS NOT NULL AND usl IS NOT NULL THEN round(least((usl-center)/(3*sigma_overall),(center-lsl)/(3*sigma_overall)),6)+0.0 END AS ppk"""


def cap_sql_individuals():
    return f"WITH {LIM} SELECT event_type, n, n AS n_subgroups, {cap_cols('sigma')} FROM lim LEFT JOIN {SPEC_SQL} USING (event_type)"


def cap_sql_subgroups(size):
    return f"""WITH {LIM}, {sub_sql(size)}, w AS (SELECT event_type, count(*) AS n_subgroups, avg(range)/{K.D2[size]} AS sw FROM sub GROUP BY 1)
SELECT event_type, n, n_subgroups, {cap_cols('sw')} FROM lim JOIN w USING (event_type) LEFT JOIN {SPEC_SQL} USING (event_type)"""


# -- run rules: the oracle uses its own formulation (runs by difference of row numbers) ------

Z = LIM + """, z AS (SELECT mr.*, (x-center)/sigma AS z, x - lag(x) OVER w AS dx, row_number() OVER w AS rn
  FROM mr JOIN lim USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""


def _run_hit(rule, source, flag, length):
    return f"""SELECT event_type, ts, event_id, x, '{rule}' AS rule FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, flag, rn - k ORDER BY rn) AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type, flag ORDER BY rn) AS k FROM (SELECT *, {flag} AS flag FROM {source})))
 WHERE flag AND pos = {length}"""


RULE_SQL = {
    1: f"SELECT event_type, ts, event_id, x, '{K.RULES[1]}' AS rule FROM z WHERE abs(z) > 3",
    2: f"""SELECT event_type, ts, event_id, x, '{K.RULES[2]}' AS rule FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rn) AS hit FROM (
        SELECT *, count(*) FILTER (z>2) OVER w3 AS a, count(*) FILTER (z<-2) OVER w3 AS b FROM z
        WINDOW w3 AS (PARTITION BY event_type ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
      WHERE rn >= 3 AND (a >= 2 OR b >= 2)) WHERE hit = 1""",
    3: f"""SELECT event_type, ts, event_id, x, '{K.RULES[3]}' AS rule FROM (
        SELECT *, count(*) FILTER (z>1) OVER w5 AS a, count(*) FILTER (z<-1) OVER w5 AS b FROM z
        WINDOW w5 AS (PARTITION BY event_type ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
      WHERE rn >= 5 AND (a >= 4 OR b >= 4)""",
    4: _run_hit(K.RULES[4], "z", "z > 0", 8) + " UNION ALL " + _run_hit(K.RULES[4], "z", "z < 0", 8),
    5: _run_hit(K.RULES[5], "z", "coalesce(dx > 0, false)", 5) + " UNION ALL " + _run_hit(K.RULES[5], "z", "coalesce(dx < 0, false)", 5),
    6: _run_hit(K.RULES[6], "z", "z > -1 AND z < 1", 15),
    7: _run_hit(
        K.RULES[7],
        "(SELECT *, lag(dx) OVER (PARTITION BY event_type ORDER BY rn) AS dp FROM z)",
        "coalesce((dx > 0 AND dp < 0) OR (dx < 0 AND dp > 0), false)",
        12,
    ),
}
ALL_RULES = "hits AS (" + " UNION ALL ".join(RULE_SQL.values()) + ")"


def rule(i):
    def run(spark, d):
        s = scan(spark, d)
        return tidy(cc.run_rule_hits(s, cc.individuals_limits(s), rules=[i]))

    return run


def rule_sql(i):
    return f"WITH {Z} SELECT event_type, ts, event_id, round(x,6)+0.0 AS x, rule FROM ({RULE_SQL[i]})"


def all_rules(spark, d):
    s = scan(spark, d)
    return tidy(cc.run_rule_hits(s, cc.individuals_limits(s)))


def subgroup_rules(spark, d):
    size = 5
    groups = cc.subgroups(scan(spark, d), size)
    hits = cc.subgroup_rule_hits(groups, cc.subgroup_limits(groups, size, KEYS), KEYS)
    return tidy(hits)


SUB_RULES_SQL = f"""WITH {sub_sql(5)}, {xbar_lim_sql('r', 5)}, z AS (
 SELECT event_type, subgroup AS ts, subgroup AS event_id, mean AS x, (mean-center)/sigma_mean AS z,
  mean - lag(mean) OVER w AS dx, row_number() OVER w AS rn FROM sub JOIN slim USING (event_type)
 WINDOW w AS (PARTITION BY event_type ORDER BY subgroup)), {ALL_RULES}
SELECT event_type, ts AS subgroup, round(x,6)+0.0 AS x, rule FROM hits"""


def iqr_fences(spark, d):
    return tidy(cc.iqr_fences(read(spark, d, "events"), "value", KEYS))


def iqr_outliers(spark, d):
    df = read(spark, d, "events").select(*KEYS, "event_id", "value")
    return tidy(cc.iqr_outliers(df, "value", KEYS))


FENCES = """f AS (SELECT event_type, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.75) AS q3 FROM events GROUP BY 1)"""


def zscore_outliers(spark, d):
    df = read(spark, d, "events").select(*KEYS, "event_id", "value")
    return tidy(cc.zscore_outliers(df, "value", KEYS))


def many_columns(spark, d):
    orders = read(spark, d, "orders").select(
        "o_orderstatus", "o_orderdate", "o_orderkey",
        (F.col("o_totalprice") / 1000).alias("price_k"), (F.col("o_custkey") % 100).cast("double").alias("cust_slot"),
    )
    s = cc.columns_scan(orders, ["price_k", "cust_slot"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"])
    return tidy(cc.individuals_limits(s))


MANY_SQL = """WITH l AS (SELECT o_orderstatus, 'price_k' AS "column", o_orderdate, o_orderkey, o_totalprice/1000 AS x FROM orders
 UNION ALL SELECT o_orderstatus, 'cust_slot', o_orderdate, o_orderkey, (o_custkey % 100)::DOUBLE FROM orders),
m AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY o_orderstatus, "column" ORDER BY o_orderdate, o_orderkey)) AS mr FROM l),
a AS (SELECT o_orderstatus, "column", count(*) AS n, avg(x) AS center, stddev_samp(x) AS sigma_overall, avg(mr) AS mr_bar FROM m GROUP BY 1,2)
SELECT o_orderstatus, "column", n, round(center,6)+0.0 AS center, round(sigma_overall,6)+0.0 AS sigma_overall, round(mr_bar,6)+0.0 AS mr_bar,
 round(mr_bar/1.128,6)+0.0 AS sigma, round(center+3*mr_bar/1.128,6)+0.0 AS ucl, round(center-3*mr_bar/1.128,6)+0.0 AS lcl,
 round(3.267*mr_bar,6)+0.0 AS mr_ucl, 0.0::DOUBLE AS mr_lcl FROM a"""


def compare_tables(spark, d):
    ev = read(spark, d, "events").select("ts", "event_id", "value")
    od = read(spark, d, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("event_id"), (F.col("o_totalprice") / 1000).alias("value")
    )
    tiny = read(spark, d, "region").select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), F.col("r_regionkey").cast("long").alias("event_id"),
        F.when(F.col("r_regionkey") < 4, F.col("r_regionkey").cast("double")).alias("value"),
    )
    s = cc.datasets_scan({"events": ev, "orders": od, "regions": tiny}, "value", ORDER)
    return tidy(cc.individuals_limits(s))


COMPARE_SQL = """WITH l AS (SELECT 'events' AS dataset, ts, event_id, value AS x FROM events
 UNION ALL SELECT 'orders', o_orderdate, o_orderkey, o_totalprice/1000 FROM orders),
m AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY dataset ORDER BY ts, event_id)) AS mr FROM l),
a AS (SELECT dataset, count(*) AS n, avg(x) AS center, stddev_samp(x) AS sigma_overall, avg(mr) AS mr_bar FROM m GROUP BY 1)
SELECT dataset, n, round(center,6)+0.0 AS center, round(sigma_overall,6)+0.0 AS sigma_overall, round(mr_bar,6)+0.0 AS mr_bar,
 round(mr_bar/1.128,6)+0.0 AS sigma, round(center+3*mr_bar/1.128,6)+0.0 AS ucl, round(center-3*mr_bar/1.128,6)+0.0 AS lcl,
 round(3.267*mr_bar,6)+0.0 AS mr_ucl, 0.0::DOUBLE AS mr_lcl FROM a"""


def manual_limits(spark, d):
    s = scan(spark, d)
    manual = spark.createDataFrame([("click", 120.0, None), ("view", None, 1.0)], "event_type string, ucl double, lcl double")
    limits = cc.override_limits(cc.individuals_limits(s), manual, KEYS)
    pts = cc.individuals_points(s, limits)
    return tidy(pts.where("out_of_limits").select(*KEYS, *ORDER, "x", "ucl", "lcl"))


MANUAL_SQL = f"""WITH {LIM}, o AS (SELECT event_type, coalesce(m.ucl, center+3*sigma) AS ucl, coalesce(m.lcl, center-3*sigma) AS lcl
 FROM lim LEFT JOIN (VALUES ('click',120.0,NULL),('view',NULL,1.0)) m(event_type,ucl,lcl) USING (event_type))
SELECT event_type, ts, event_id, round(x,6)+0.0 AS x, round(ucl,6)+0.0 AS ucl, round(lcl,6)+0.0 AS lcl
FROM mr JOIN o USING (event_type) WHERE x > ucl OR x < lcl"""


def summary(spark, d):
    return tidy(cc.spc_summary(scan(spark, d), spec(spark)))


SUMMARY_CTE = f"""{Z}, {ALL_RULES}, hc AS (SELECT event_type, count(*) AS n_violations,
 {', '.join(f"count(*) FILTER (rule = '{name}') AS rule_{i}" for i, name in K.RULES.items())} FROM hits GROUP BY 1)"""
SUMMARY_SQL = f"""WITH {SUMMARY_CTE}
SELECT event_type, n, {cap_cols('sigma').replace('AS sigma_within', 'AS sigma')}, round(mr_bar,6)+0.0 AS mr_bar,
 round(center+3*sigma,6)+0.0 AS ucl, round(center-3*sigma,6)+0.0 AS lcl, round(3.267*mr_bar,6)+0.0 AS mr_ucl, 0.0::DOUBLE AS mr_lcl,
 coalesce(n_violations,0) AS n_violations, {', '.join(f'coalesce(rule_{i},0) AS rule_{i}' for i in K.RULES)}
FROM lim LEFT JOIN {SPEC_SQL} USING (event_type) LEFT JOIN hc USING (event_type)"""


def suggestions(spark, d):
    s = scan(spark, d)
    shifts = cc.change_point_summary(s, decision=4.0).select(*KEYS, "n_change_points")
    full = ordered.join_on(cc.spc_summary(s, spec(spark)), shifts, KEYS)
    return cc.spc_suggestions(full, KEYS, F.col("n_change_points"))


SUGGEST_SQL = f"""WITH RECURSIVE {SUMMARY_CTE}, {CUSUM_STEP}, sh AS (SELECT event_type, count(*) FILTER (cp > 4 OR cm > 4) AS k FROM step GROUP BY 1),
t AS (SELECT event_type, least((usl-center)/(3*sigma),(center-lsl)/(3*sigma)) + 0*usl + 0*lsl AS cpk, coalesce(rule_4,0) AS r4, coalesce(rule_5,0) AS r5, k
 FROM lim LEFT JOIN {SPEC_SQL} USING (event_type) LEFT JOIN hc USING (event_type) JOIN sh USING (event_type))
SELECT event_type, 'error' AS severity, 'low_capability' AS type FROM t WHERE cpk < 1
UNION ALL SELECT event_type, 'warning', 'marginal_capability' FROM t WHERE cpk >= 1 AND cpk < 1.33
UNION ALL SELECT event_type, 'error', 'shift_detected' FROM t WHERE r4 > 0
UNION ALL SELECT event_type, 'warning', 'trend_detected' FROM t WHERE r5 > 0
UNION ALL SELECT event_type, 'warning', 'small_shift' FROM t WHERE k > 0"""


def suggest_spec(spark, d):
    return tidy(cc.suggest_spec(read(spark, d, "events"), "value", KEYS))


def process_window(spark, d):
    return tidy(cc.process_window(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"]))


PW_SQL = "WITH l AS (" + " UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS "column", {c} AS v FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax")
) + """) SELECT l_returnflag, "column", round(avg(v),6)+0.0 AS center, round(avg(v)-3*stddev_samp(v),6)+0.0 AS window_low,
 round(avg(v)+3*stddev_samp(v),6)+0.0 AS window_high FROM l GROUP BY 1,2"""


def trend(spark, d):
    s = scan(spark, d)
    return tidy(cc.trend_insight(s, cc.individuals_limits(s)))


TREND_SQL = f"""WITH {Z}, runs AS (SELECT event_type, max(c) AS longest_run FROM (
 SELECT event_type, sg, rn - k AS grp, count(*) AS c FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, sg ORDER BY rn) AS k FROM (SELECT *, coalesce(sign(dx),0) AS sg FROM z))
 WHERE sg <> 0 GROUP BY 1,2,3) GROUP BY 1),
e AS (SELECT event_type, arg_min(x, (ts, event_id)) AS first_value, arg_max(x, (ts, event_id)) AS last_value,
 count(*) FILTER (x > center+3*sigma OR x < center-3*sigma) AS n_beyond FROM mr JOIN lim USING (event_type) GROUP BY 1)
SELECT event_type, first_value, last_value, n_beyond, round(last_value-first_value,6)+0.0 AS delta,
 CASE WHEN last_value>first_value THEN 'up' WHEN last_value<first_value THEN 'down' ELSE 'flat' END AS direction, longest_run
FROM e JOIN runs USING (event_type)"""


QUERIES = [
    Query("spc_individuals_limits", individuals_limits, f"""WITH {LIM} SELECT event_type, n, round(center,6)+0.0 AS center,
 round(sigma_overall,6)+0.0 AS sigma_overall, round(mr_bar,6)+0.0 AS mr_bar, round(sigma,6)+0.0 AS sigma,
 round(center+3*sigma,6)+0.0 AS ucl, round(center-3*sigma,6)+0.0 AS lcl, round(3.267*mr_bar,6)+0.0 AS mr_ucl, 0.0::DOUBLE AS mr_lcl FROM lim"""),
    Query("spc_individuals_points", individuals_points, f"""WITH {LIM} SELECT event_type, ts, event_id, round(x,6)+0.0 AS x, round(mr,6)+0.0 AS mr,
 round(center,6)+0.0 AS center, round(center+3*sigma,6)+0.0 AS ucl, round(center-3*sigma,6)+0.0 AS lcl, round(mr_bar,6)+0.0 AS mr_bar,
 round(3.267*mr_bar,6)+0.0 AS mr_ucl, (x > center+3*sigma OR x < center-3*sigma) AS out_of_limits,
 coalesce(mr > 3.267*mr_bar, false) AS mr_out FROM mr JOIN lim USING (event_type)"""),
    Query("spc_xbar_r_limits", xbar("r", 5), xbar_sql("r", 5)),
    Query("spc_xbar_s_limits", xbar("s", 6), xbar_sql("s", 6)),
    Query("spc_xbar_r_points", xbar_points("r", 5), xbar_points_sql("r", 5)),
    Query("spc_xbar_s_points", xbar_points("s", 6), xbar_points_sql("s", 6)),
    Query("spc_ewma_points", ewma, EWMA_SQL),
    Query("spc_cusum_points", cusum, f"""WITH RECURSIVE {CUSUM_STEP} SELECT event_type, ts, event_id, rn, round(x,5)+0.0 AS x,
 round(cp,5)+0.0 AS c_plus, round(cm,5)+0.0 AS c_minus, (cp > 5 OR cm > 5) AS signal FROM r JOIN step USING (event_type, rn)"""),
    Query("spc_change_points", change_points, f"""WITH RECURSIVE {CUSUM_STEP} SELECT event_type, ts, event_id, rn, round(x,5)+0.0 AS x,
 round(cp,5)+0.0 AS c_plus, round(cm,5)+0.0 AS c_minus FROM r JOIN step USING (event_type, rn) WHERE cp > 4 OR cm > 4"""),
    Query("spc_change_point_summary", change_summary, f"""WITH RECURSIVE {CUSUM_STEP} SELECT event_type, count(*) FILTER (cp > 4 OR cm > 4) AS n_change_points,
 round(arg_max(cp, rn),5)+0.0 AS last_plus, round(arg_max(cm, rn),5)+0.0 AS last_minus FROM step GROUP BY 1"""),
    Query("spc_capability_individuals", capability(1), cap_sql_individuals()),
    Query("spc_capability_subgroups", capability(5), cap_sql_subgroups(5)),
    *[Query(f"spc_rule_{name}", rule(i), rule_sql(i)) for i, name in K.RULES.items()],
    Query("spc_run_rules", all_rules, f"WITH {Z}, {ALL_RULES} SELECT event_type, ts, event_id, round(x,6)+0.0 AS x, rule FROM hits"),
    Query("spc_subgroup_run_rules", subgroup_rules, SUB_RULES_SQL),
    Query("spc_iqr_fences", iqr_fences, f"""WITH {FENCES} SELECT event_type, round(q1,6)+0.0 AS q1, round(q3,6)+0.0 AS q3, round(q3-q1,6)+0.0 AS iqr,
 round(q1-1.5*(q3-q1),6)+0.0 AS lower_fence, round(q3+1.5*(q3-q1),6)+0.0 AS upper_fence FROM f"""),
    Query("spc_iqr_outliers", iqr_outliers, f"""WITH {FENCES} SELECT event_type, event_id, value, round(q1-1.5*(q3-q1),6)+0.0 AS lower_fence,
 round(q3+1.5*(q3-q1),6)+0.0 AS upper_fence FROM events JOIN f USING (event_type) WHERE value < q1-1.5*(q3-q1) OR value > q3+1.5*(q3-q1)"""),
    Query("spc_zscore_outliers", zscore_outliers, """WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
SELECT event_type, event_id, value, round((value-m)/s,6)+0.0 AS zscore FROM events JOIN s USING (event_type) WHERE abs((value-m)/s) > 3"""),
    Query("spc_many_columns", many_columns, MANY_SQL),
    Query("spc_compare_tables", compare_tables, COMPARE_SQL),
    Query("spc_manual_limits", manual_limits, MANUAL_SQL),
    Query("spc_summary", summary, SUMMARY_SQL),
    Query("spc_suggestions", suggestions, SUGGEST_SQL),
    Query("spc_suggest_spec", suggest_spec, """SELECT event_type, count(value) AS n, round(avg(value),6)+0.0 AS target, round(stddev_samp(value),6)+0.0 AS sigma,
 round(avg(value)-3*stddev_samp(value),6)+0.0 AS lsl, round(avg(value)+3*stddev_samp(value),6)+0.0 AS usl FROM events GROUP BY 1 HAVING count(value) >= 5"""),
    Query("spc_process_window", process_window, PW_SQL),
    Query("spc_trend_insight", trend, TREND_SQL),
]
