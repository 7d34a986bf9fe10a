"""Filter, design-column, join, set-operation and gauge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.operators import frames as fr
from plantscope.operators import gauge
from plantscope.operators import timeseries as ts
from plantscope.plans.registry import Query, read, tidy

FACTORS = ["priority", "status", "quarter"]


def factorial(spark, d):
    """One observation per (priority, status, quarter): a complete three-factor design from all orders."""
    o = read(spark, d, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"),
    ).agg((F.avg("o_totalprice") / 1000).alias("y"))


FACTORIAL_SQL = """fx AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, 'Q' || quarter(o_orderdate) AS quarter, avg(o_totalprice)/1000 AS y FROM orders GROUP BY 1,2,3)"""


def grained(spark, d):
    return read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("machine_id"), F.col("l_returnflag").alias("lot_id"), F.col("l_linestatus").alias("process_step"),
        "l_quantity", "l_extendedprice",
    )


def row_filter(spark, d):
    return tidy(fr.row_filter(read(spark, d, "events"), "event_type", "click").select("event_id", "value"))


def grain_filter(spark, d):
    out = fr.grain_filter(grained(spark, d), [("machine_id", 7), ("lot_id", "A"), ("process_step", "O")])
    return tidy(out.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")))


def grain_trace(spark, d):
    df = grained(spark, d)
    return fr.grain_trace(df, fr.equals_text(df, "machine_id", 7) & fr.equals_text(df, "lot_id", "A"))


def time_window(spark, d):
    ev = read(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    return tidy(ts.select_time_window(ev, "ts", 7).select("event_id", "ts", "value"))


def time_window_summary(spark, d):
    ev = read(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    return tidy(ts.time_window_summary(ev, "ts", 7))


def gappy(spark, d):
    return read(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 13 == 0, float("nan")).when(F.col("event_id") % 17 == 0, float("inf")).otherwise(F.col("user_id").cast("double")).alias("u"),
    )


def complete(spark, d):
    return tidy(fr.complete_cases(gappy(spark, d).select("event_id", "value"), ["value"]))


def finite(spark, d):
    return tidy(fr.finite_cases(gappy(spark, d), ["value", "u"]))


def design(spark, d):
    li = read(spark, d, "lineitem")
    t = fr.design_columns(li, ["l_quantity", "l_discount", "l_tax"], 2)
    return tidy(t.agg(*[F.avg(f"`{c}`").alias(c) for c in t.columns]))


DESIGN_SQL = """SELECT round(avg(l_quantity),6)+0.0 AS l_quantity, round(avg(l_discount),6)+0.0 AS l_discount, round(avg(l_tax),6)+0.0 AS l_tax,
 round(avg(l_quantity*l_quantity),6)+0.0 AS "l_quantity^2", round(avg(l_discount*l_discount),6)+0.0 AS "l_discount^2", round(avg(l_tax*l_tax),6)+0.0 AS "l_tax^2",
 round(avg(l_quantity*l_discount),6)+0.0 AS "l_quantity*l_discount", round(avg(l_quantity*l_tax),6)+0.0 AS "l_quantity*l_tax",
 round(avg(l_discount*l_tax),6)+0.0 AS "l_discount*l_tax" FROM lineitem"""


def treatment(spark, d):
    fx = factorial(spark, d)
    return tidy(fr.treatment_columns(fx, ["status", "quarter"], keep=["priority", "status", "quarter"]))


TREAT_SQL = f"WITH {FACTORIAL_SQL} SELECT priority, status, quarter, " + ", ".join(
    [f"""(status='{s}')::INT::DOUBLE AS "status[{s}]" """ for s in "OP"]
    + [f"""(quarter='{q}')::INT::DOUBLE AS "quarter[{q}]" """ for q in ("Q2", "Q3", "Q4")]
    + [f"""(status='{s}' AND quarter='{q}')::INT::DOUBLE AS "status[{s}]:quarter[{q}]" """ for s in "OP" for q in ("Q2", "Q3", "Q4")]
) + " FROM fx"


def unseen(spark, d):
    p = read(spark, d, "part")
    return fr.unseen_levels(p, p.where((F.col("p_size") < 5) & (F.col("p_type") == "SMALL")), "p_brand")


def forecast_rows(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy(F.col("o_orderdate").alias("ts")).agg((F.avg("o_totalprice") / 997).alias("forecast"))


def observed_rows(spark, d):
    li = read(spark, d, "lineitem")
    return li.groupBy(F.col("l_shipdate").alias("ts")).agg((F.avg("l_extendedprice") / 997).alias("observed"))


OBS_SQL = """f AS (SELECT o_orderdate AS ts, avg(o_totalprice)/997 AS forecast FROM orders GROUP BY 1),
o AS (SELECT l_shipdate AS ts, avg(l_extendedprice)/997 AS observed FROM lineitem GROUP BY 1)"""


def lookup(spark, d):
    return tidy(fr.match_observed(forecast_rows(spark, d), observed_rows(spark, d), ["ts"]))


def zipped(spark, d):
    o = read(spark, d, "orders")
    left = o.select("o_orderdate", "o_orderkey", (F.col("o_totalprice") / 1000).alias("actual"))
    right = o.select("o_orderdate", "o_orderkey", (F.col("o_custkey") / 10).alias("predicted"))
    z = fr.key_zip(left, right, ["o_orderdate", "o_orderkey"])
    return tidy(z.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae")))


def semi(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    return n.join(r.where(F.col("r_regionkey") < 3), n.n_regionkey == r.r_regionkey, "left_semi").select("n_name")


def anti(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").where(F.col("o_totalprice") > 450_000)
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def association(spark, d):
    step1 = read(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"))
    step2 = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("product_id"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("value"))
    j = fr.association_join(step1, step2, ["product_id"])
    return tidy(j.groupBy("status", "status_right").agg(F.count(F.lit(1)).alias("n"), F.sum("value_right").alias("qty"), (F.avg("value") / 1000).alias("price_k")))


def dup_keys(spark, d):
    return tidy(fr.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


def halves(spark, d):
    ev = read(spark, d, "events").select("event_id", "ts", "value")
    cut = F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


def append(spark, d):
    h, o = halves(spark, d)
    t = fr.append_rows(h, o)
    return tidy(t.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("ts").alias("first"), F.max("ts").alias("last")))


def ordered(spark, d):
    return fr.strictly_after(*halves(spark, d), "ts")


def coverage_rows(spark, d):
    return read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def top_customers(spark, d):
    t = read(spark, d, "orders").groupBy("o_custkey").agg((F.sum("o_totalprice") / 1000).alias("total"))
    return tidy(fr.top_n(t, "total", 10, ["o_custkey"]), 3)


def top_per_type(spark, d):
    ev = read(spark, d, "events").select("event_type", "event_id", "value")
    return tidy(fr.top_n_per_group(ev, ["event_type"], "value", ["event_id"], 5))


def distinct_groups(spark, d):
    return read(spark, d, "part").select("p_brand", "p_type").distinct()


def group_coverage(spark, d):
    ev = read(spark, d, "events")
    return tidy(fr.group_coverage(ev, "user_id", F.col("ts") >= F.expr("timestamp_ntz'2024-01-30 12:00:00'")))


def gauge_rows(spark, d):
    return factorial(spark, d)


GAUGE_CELL_SQL = f"""{FACTORIAL_SQL}, cells AS (SELECT CASE WHEN grouping(status)=0 AND grouping(priority)=0 THEN 'cell' WHEN grouping(status)=0 THEN 'operator'
 WHEN grouping(priority)=0 THEN 'part' ELSE 'all' END AS level, status AS operator, priority AS part, count(*) AS n, avg(y) AS mean, max(y)-min(y) AS range
 FROM fx GROUP BY CUBE(status, priority))"""


def gauge_cells(spark, d):
    return tidy(gauge.gauge_cells(gauge_rows(spark, d), "y", "priority", "status"))


def gauge_balance(spark, d):
    return tidy(gauge.gauge_balance(gauge.gauge_cells(gauge_rows(spark, d), "y", "priority", "status")))


def gauge_rr(spark, d):
    return tidy(gauge.gauge_rr(gauge_rows(spark, d), "y", "priority", "status"))


GRR_SQL = f"""WITH {GAUGE_CELL_SQL}, a AS (SELECT count(DISTINCT operator) FILTER (level='cell') AS n_operators, count(DISTINCT part) FILTER (level='cell') AS n_parts,
 sum(n) FILTER (level='cell')::BIGINT AS n, avg(range) FILTER (level='cell' AND n>=2) AS mean_range,
 max(mean) FILTER (level='operator') - min(mean) FILTER (level='operator') AS operator_spread, max(mean) FILTER (level='part') - min(mean) FILTER (level='part') AS part_spread FROM cells),
b AS (SELECT *, round(n/(n_operators*n_parts))::BIGINT AS repeats FROM a), c AS (SELECT *, CASE repeats WHEN 1 THEN 1.0 WHEN 2 THEN 1.128 WHEN 3 THEN 1.693 WHEN 4 THEN 2.059 WHEN 5 THEN 2.326 WHEN 6 THEN 2.534 ELSE 2.326 END AS d2 FROM b),
e AS (SELECT *, mean_range/d2 AS ev FROM c), f AS (SELECT *, sqrt(greatest((operator_spread/sqrt(n_operators)/d2)**2 - ev**2/(n_parts*repeats),0)) AS av FROM e),
g AS (SELECT *, sqrt(ev*ev+av*av) AS grr, part_spread/(3*d2) AS pv FROM f), h AS (SELECT *, sqrt(grr*grr+pv*pv) AS tv FROM g)
SELECT n_operators, n_parts, n, repeats, {', '.join(f'round({c},6)+0.0 AS {c}' for c in 'mean_range operator_spread part_spread ev av grr pv tv'.split())},
 round(grr/tv*100,6)+0.0 AS pct_grr, round(pv/tv*100,6)+0.0 AS pct_part, CASE WHEN grr/tv*100 < 10 THEN 'acceptable' WHEN grr/tv*100 < 30 THEN 'marginal' ELSE 'unacceptable' END AS verdict,
 concat_ws(',', CASE WHEN ev > 2*av THEN 'repeatability_dominates' END, CASE WHEN av > ev THEN 'reproducibility_significant' END,
  CASE WHEN n_parts < 5 THEN 'few_parts' END, CASE WHEN n_operators < 2 THEN 'one_operator' END) AS warnings FROM h"""

DATED = "(SELECT * REPLACE (CASE WHEN event_id % 97 <> 0 THEN ts END AS ts) FROM events)"

QUERIES = [
    Query("filter_row_value", row_filter, "SELECT event_id, value FROM events WHERE event_type = 'click'"),
    Query("filter_grain", grain_filter, "SELECT count(*) AS n, round(sum(l_quantity),6)+0.0 AS qty FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'A' AND l_linestatus = 'O'"),
    Query("filter_grain_trace", grain_trace, "SELECT count(*) AS source_rows, count(*) FILTER (l_suppkey = 7 AND l_returnflag = 'A') AS analysed_rows FROM lineitem"),
    Query("filter_time_window", time_window, f"SELECT event_id, ts, value FROM {DATED} WHERE ts > (SELECT max(ts) FROM {DATED}) - INTERVAL 7 DAY"),
    Query("filter_time_window_summary", time_window_summary, f"""SELECT count(*) FILTER (ts IS NULL) AS undated_rows, count(*) FILTER (ts > mx - INTERVAL 7 DAY) AS selected_rows,
 min(ts) FILTER (ts > mx - INTERVAL 7 DAY) AS window_start, max(ts) AS window_end FROM {DATED}, (SELECT max(ts) AS mx FROM {DATED})"""),
    Query("filter_complete_cases", complete, "SELECT event_id, value FROM events WHERE event_id % 11 <> 0"),
    Query("filter_finite_cases", finite, "SELECT event_id, value, user_id::DOUBLE AS u FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0"),
    Query("design_polynomial_columns", design, DESIGN_SQL),
    Query("design_treatment_columns", treatment, TREAT_SQL),
    Query("design_unseen_levels", unseen, "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 5 AND p_type = 'SMALL')"),
    Query("join_observed_lookup", lookup, f"WITH {OBS_SQL} SELECT ts, round(forecast,6)+0.0 AS forecast, round(observed,6)+0.0 AS observed FROM f JOIN o USING (ts)"),
    Query("join_key_zip", zipped, "SELECT count(*) AS n, round(avg(abs(o_totalprice/1000 - o_custkey/10)),6)+0.0 AS mae FROM orders"),
    Query("join_semi", semi, "SELECT n_name FROM nation WHERE n_regionkey < 3"),
    Query("join_anti", anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"),
    Query("join_association_keys", association, """SELECT o_orderstatus AS status, l_linestatus AS status_right, count(*) AS n, round(sum(l_quantity),6)+0.0 AS qty, round(avg(o_totalprice)/1000,6)+0.0 AS price_k
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1,2"""),
    Query("join_duplicate_keys", dup_keys, "SELECT count(*) AS n_keys, count(*) FILTER (k>1) AS n_duplicate_keys, coalesce(sum(k) FILTER (k>1),0)::BIGINT AS n_duplicate_rows FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)"),
    Query("set_append_rows", append, "SELECT count(*) AS n, round(avg(value),6)+0.0 AS mean, min(ts) AS first, max(ts) AS last FROM events"),
    Query("set_strictly_after", ordered, "SELECT max(ts) FILTER (ts < TIMESTAMP '2024-01-16') AS history_end, min(ts) FILTER (ts >= TIMESTAMP '2024-01-16') AS observed_start, true AS ordered FROM events"),
    Query("set_missing_cells", lambda s, d: tidy(fr.missing_cells(coverage_rows(s, d), ["brand", "size"])), "SELECT brand, size FROM (SELECT DISTINCT p_brand AS brand FROM part), (SELECT DISTINCT p_size::BIGINT AS size FROM part) EXCEPT SELECT p_brand, p_size::BIGINT FROM part"),
    Query("set_duplicate_cells", lambda s, d: tidy(fr.duplicate_cells(coverage_rows(s, d), ["brand", "size"])), "SELECT p_brand AS brand, p_size::BIGINT AS size, count(*) AS n FROM part GROUP BY 1,2 HAVING count(*) > 1"),
    Query("set_design_coverage", lambda s, d: tidy(fr.design_coverage(factorial(s, d), FACTORS)), f"WITH {FACTORIAL_SQL} SELECT (SELECT count(DISTINCT priority)*count(DISTINCT status)*count(DISTINCT quarter) - count(*) FROM fx) AS n_missing, 0::BIGINT AS n_duplicate, CASE WHEN (SELECT count(DISTINCT priority)*count(DISTINCT status)*count(DISTINCT quarter) - count(*) FROM fx) = 0 THEN 'ready' ELSE 'warning' END AS status"),
    Query("set_design_context", lambda s, d: tidy(fr.design_context(coverage_rows(s, d), ["brand", "size"], 10)), "SELECT count(*) AS n_cells, min(k) AS replicates_min, max(k) AS replicates_max, max(k) > 1 AS has_replicates, (sum(k)-10)::BIGINT AS residual_df FROM (SELECT count(*) AS k FROM part GROUP BY p_brand, p_size)"),
    Query("sort_top_ranked", top_customers, "SELECT o_custkey, round(sum(o_totalprice)/1000,3)+0.0 AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10"),
    Query("sort_top_per_group", top_per_type, "SELECT event_type, event_id, value, rank FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5"),
    Query("sort_stable_by_time", lambda s, d: tidy(read(s, d, "events").orderBy("ts", "event_id").select("ts", "event_id", "value")), "SELECT ts, event_id, value FROM events ORDER BY ts, event_id"),
    Query("set_distinct_groups", distinct_groups, "SELECT DISTINCT p_brand, p_type FROM part"),
    Query("set_group_coverage", group_coverage, "SELECT count(*) FILTER (v) AS groups_seen, count(*) AS groups, round(count(*) FILTER (v)/count(*),6)+0.0 AS coverage FROM (SELECT user_id, bool_or(ts >= TIMESTAMP '2024-01-30 12:00:00') AS v FROM events GROUP BY 1)"),
    Query("gauge_cells", gauge_cells, f"WITH {GAUGE_CELL_SQL} SELECT level, operator, part, n, round(mean,6)+0.0 AS mean, round(range,6)+0.0 AS range FROM cells"),
    Query("gauge_balance", gauge_balance, f"""WITH {GAUGE_CELL_SQL} SELECT count(DISTINCT operator) AS n_operators, count(DISTINCT part) AS n_parts, sum(n)::BIGINT AS n,
 round(sum(n)/(count(DISTINCT operator)*count(DISTINCT part)))::BIGINT AS repeats, (count(*) = count(DISTINCT operator)*count(DISTINCT part) AND min(n)=max(n) AND sum(n) >= 3) AS balanced FROM cells WHERE level='cell'"""),
    Query("gauge_rr", gauge_rr, GRR_SQL),
]
