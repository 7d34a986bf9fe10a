"""Anomaly-event queries over ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.operators import anomalies as an
from plantscope.operators import control_charts as cc
from plantscope.plans.registry import Query, read, tidy

KEYS = ["event_type"]
ORDER = ["ts", "event_id"]

SPEC = [("value", 120.0, 2.0), ("user_id", 140.0, None)]
SPEC_SQL = "(VALUES ('value',120.0::DOUBLE,2.0::DOUBLE),('user_id',140.0,NULL)) t(\"column\",usl,lsl)"
LONG_SQL = """l AS (SELECT 'value' AS "column", value AS v FROM events UNION ALL SELECT 'user_id', user_id::DOUBLE FROM events)"""
SIDES_SQL = f"""s AS (SELECT "column", 'above' AS side, usl AS threshold FROM {SPEC_SQL} WHERE usl IS NOT NULL
 UNION ALL SELECT "column", 'below', lsl FROM {SPEC_SQL} WHERE lsl IS NOT NULL)"""
EVENT_COLS = """count(*) FILTER (hit) AS n_events, count(*) AS n_total, round(avg(dev) FILTER (hit),6)+0.0 AS dev_mean,
 round(stddev_pop(dev) FILTER (hit),6)+0.0 AS dev_std, round(min(dev) FILTER (hit),6)+0.0 AS dev_min, round(max(dev) FILTER (hit),6)+0.0 AS dev_max,
 round(count(*) FILTER (hit)/count(*),6)+0.0 AS probability"""
CONF = """CASE WHEN count(*) FILTER (hit) = 0 THEN 0.4::DOUBLE
 ELSE round(least(0.95, 0.5+3.5*sqrt(count(*) FILTER (hit)/count(*))),6)+0.0 END AS confidence"""


def limits(spark):
    return spark.createDataFrame(SPEC, "column string, usl double, lsl double")


def spec_events(spark, d):
    return tidy(an.threshold_events(read(spark, d, "events"), limits(spark), "spec"))


def threshold_sql(family):
    return f"""WITH {LONG_SQL}, {SIDES_SQL}, h AS (SELECT *, v - threshold AS dev, CASE WHEN side='above' THEN v > threshold ELSE v < threshold END AS hit
 FROM l JOIN s USING ("column")) SELECT "column", side, round(threshold,6)+0.0 AS threshold, {EVENT_COLS}, {CONF}, '{family}' AS family FROM h GROUP BY "column", side, threshold"""


def manual_control_events(spark, d):
    manual = spark.createDataFrame(SPEC, "column string, ucl double, lcl double")
    return tidy(an.threshold_events(read(spark, d, "events"), manual, "control", "ucl", "lcl"))


AUTO_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def auto_control(spark, d):
    return tidy(an.auto_control_events(read(spark, d, "events"), ["value", "user_id"], KEYS), 5)


AUTO_SQL = f"""WITH l AS (SELECT event_type, 'value' AS "column", value AS v FROM events UNION ALL SELECT event_type, 'user_id', user_id::DOUBLE FROM events),
st AS (SELECT event_type, "column", avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY 1,2 HAVING count(*) >= 10 AND stddev_pop(v) > 0),
s AS (SELECT event_type, "column", 'above' AS side, m+3*s AS threshold FROM st UNION ALL SELECT event_type, "column", 'below', m-3*s FROM st),
h AS (SELECT *, v - threshold AS dev, CASE WHEN side='above' THEN v > threshold ELSE v < threshold END AS hit FROM l JOIN s USING (event_type, "column"))
SELECT event_type, "column", side, round(threshold,5)+0.0 AS threshold, {EVENT_COLS.replace(',6)', ',5)')}, {CONF.replace(',6)', ',5)')}, 'control' AS family
FROM h GROUP BY event_type, "column", side, threshold HAVING count(*) FILTER (hit) > 0"""

TEMPLATES = [("value drift", "value", 50.0, 80.0), ("user drift", "user_id", 75.0, 70.0), ("no tolerance", "value", 50.0, None)]


def deviations(spark, d):
    t = spark.createDataFrame(TEMPLATES, "name string, column string, target double, tolerance double")
    return tidy(an.deviation_events(read(spark, d, "events"), t))


DEV_SQL = f"""WITH {LONG_SQL}, h AS (SELECT *, v - target AS dev, abs(v - target) > tolerance AS hit FROM l
 JOIN (VALUES ('value drift','value',50.0::DOUBLE,80.0::DOUBLE),('user drift','user_id',75.0,70.0)) t(name,"column",target,tolerance) USING ("column"))
SELECT name, "column", target, tolerance, {EVENT_COLS}, 0.85::DOUBLE AS confidence FROM h GROUP BY ALL"""


def rising(spark, d):
    s = cc.chart_scan(read(spark, d, "events"), "value", ORDER, KEYS)
    return tidy(an.longest_rise(s))


RISE_SQL = """WITH r AS (SELECT event_type, value AS x, row_number() OVER w AS rn, value > lag(value) OVER w AS up, lag(value) OVER w AS prev
 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY event_type, up ORDER BY rn) AS grp FROM r WHERE up),
runs AS (SELECT event_type, grp, count(*) AS steps, min(rn) AS a, arg_min(prev, rn) AS start_value, arg_max(x, rn) AS end_value FROM g GROUP BY 1,2),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY steps DESC, a) AS k FROM runs),
t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, steps+1 AS run_length, a-2 AS start_index, start_value, end_value, round(end_value-start_value,6)+0.0 AS total_rise,
 round((end_value-start_value)/(steps+1),6)+0.0 AS mean_step, round((steps+1)/n,6)+0.0 AS probability,
 round(least(0.95, 0.5+3.5*sqrt((steps+1)/n)),6)+0.0 AS confidence
FROM b JOIN t USING (event_type) WHERE k = 1 AND steps+1 >= 5"""


def exceedance(direction, threshold):
    def run(spark, d):
        s = cc.chart_scan(read(spark, d, "events"), "value", ORDER, KEYS)
        return tidy(an.exceedance_runs(s, threshold, direction, lengths=20).withColumn("first_lengths", F.concat_ws(",", F.col("first_lengths").cast("array<string>"))))

    return run


def exceedance_sql(op, threshold):
    return f"""WITH r AS (SELECT event_type, value {op} {threshold} AS hit, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT event_type, rn, rn - row_number() OVER (PARTITION BY event_type, hit ORDER BY rn) AS grp FROM r WHERE hit),
runs AS (SELECT event_type, grp, count(*) AS len, row_number() OVER (PARTITION BY event_type ORDER BY min(rn)) AS k FROM g GROUP BY 1,2)
SELECT event_type, count(*) AS n_runs, max(len) AS longest, round(avg(len),6)+0.0 AS mean_length,
 string_agg(len::VARCHAR, ',' ORDER BY k) FILTER (k <= 20) AS first_lengths FROM runs GROUP BY 1"""


def flags():
    return {
        "high_value": F.col("value") > 100,
        "low_user": F.col("user_id") < 30,
        "odd_event": F.col("event_id") % 2 == 1,
    }


FLAG_SQL = "f AS (SELECT event_type, (value > 100)::INT AS a, (user_id < 30)::INT AS b, (event_id % 2 = 1)::INT AS c FROM events)"


def co_occurrence(spark, d):
    return tidy(an.co_occurrence(read(spark, d, "events"), flags(), KEYS))


def _pair(x, y, nx, ny):
    return f"""SELECT event_type, '{nx}' AS left_event, '{ny}' AS right_event, round(avg({x}),6)+0.0 AS p_left, round(avg({y}),6)+0.0 AS p_right,
 round(avg({x}*{y}),6)+0.0 AS p_joint, round(avg({x})*avg({y}),6)+0.0 AS p_independent, round(avg({x}*{y})/(avg({x})*avg({y}))-1,6)+0.0 AS lift_minus_1 FROM f GROUP BY 1"""


CO_SQL = f"WITH {FLAG_SQL} " + " UNION ALL ".join(
    [_pair("a", "b", "high_value", "low_user"), _pair("a", "c", "high_value", "odd_event"), _pair("b", "c", "low_user", "odd_event")]
)


def triples(spark, d):
    return tidy(an.triple_independence(read(spark, d, "events"), flags(), KEYS))


def points(spark, d):
    return tidy(an.event_points(read(spark, d, "events"), ["event_id"], limits(spark)))


CONTROL = [("user_id", 140.0, 8.0)]


def scenario_points(spark, d):
    spec = limits(spark).where("column = 'value'")
    control = spark.createDataFrame(CONTROL, "column string, ucl double, lcl double")
    templates = spark.createDataFrame(TEMPLATES, "name string, column string, target double, tolerance double")
    return tidy(an.scenario_points(read(spark, d, "events"), ["event_id"], ORDER, ["value", "user_id"], spec, control, templates, KEYS))


SCENARIO_SQL = """WITH l AS (SELECT event_type, event_id, ts, 'value' AS "column", value AS v FROM events UNION ALL SELECT event_type, event_id, ts, 'user_id', user_id::DOUBLE FROM events),
st AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 AND stddev_pop(value) > 0),
t AS (SELECT 'spec' AS label, 'spec' AS family, event_type, 'value' AS "column", 'above' AS side, 120.0::DOUBLE AS lim FROM (SELECT DISTINCT event_type FROM events)
 UNION ALL SELECT 'spec', 'spec', event_type, 'value', 'below', 2.0 FROM (SELECT DISTINCT event_type FROM events)
 UNION ALL SELECT 'control', 'control', event_type, 'user_id', 'above', 140.0 FROM (SELECT DISTINCT event_type FROM events)
 UNION ALL SELECT 'control', 'control', event_type, 'user_id', 'below', 8.0 FROM (SELECT DISTINCT event_type FROM events)
 UNION ALL SELECT 'auto', 'control', event_type, 'value', 'above', m+3*s FROM st UNION ALL SELECT 'auto', 'control', event_type, 'value', 'below', m-3*s FROM st),
limited AS (SELECT event_type, event_id, label || ':' || "column" || ':' || side AS scenario, family, "column", side, v, lim FROM l JOIN t USING (event_type, "column")
 WHERE CASE WHEN side = 'above' THEN v > lim ELSE v < lim END),
r AS (SELECT *, row_number() OVER w AS rn, v > lag(v) OVER w AS up FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY event_type, "column" ORDER BY ts, event_id)),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY event_type, "column", up ORDER BY rn) AS grp FROM r WHERE up),
runs AS (SELECT event_type, "column", grp, count(*) AS steps, min(rn) - 1 AS a, max(rn) AS z FROM g GROUP BY 1,2,3),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type, "column" ORDER BY steps DESC, a) AS k FROM runs),
rise AS (SELECT r.event_type, event_id, 'rise:' || r."column" AS scenario, 'control' AS family, r."column", 'run' AS side, v, NULL::DOUBLE AS lim
 FROM r JOIN b ON r.event_type = b.event_type AND r."column" = b."column" AND rn BETWEEN a AND z WHERE k = 1 AND steps + 1 >= 5),
dev AS (SELECT event_type, event_id, 'engineering:' || name AS scenario, 'engineering' AS family, "column", CASE WHEN v > target THEN 'above' ELSE 'below' END AS side, v,
 CASE WHEN v > target THEN target + tolerance ELSE target - tolerance END AS lim
 FROM l JOIN (VALUES ('value drift','value',50.0::DOUBLE,80.0::DOUBLE),('user drift','user_id',75.0,70.0)) n(name,"column",target,tolerance) USING ("column") WHERE abs(v - target) > tolerance)
SELECT event_type, event_id, scenario, family, "column", side, round(v,6)+0.0 AS value, round(lim,6)+0.0 AS "limit"
FROM (SELECT * FROM limited UNION ALL SELECT * FROM rise UNION ALL SELECT * FROM dev)"""


QUERIES = [
    Query("anomaly_spec_events", spec_events, threshold_sql("spec")),
    Query("anomaly_manual_control_events", manual_control_events, threshold_sql("control")),
    Query("anomaly_auto_control_events", auto_control, AUTO_SQL),
    Query("anomaly_engineering_deviation", deviations, DEV_SQL),
    Query("anomaly_longest_rise", rising, RISE_SQL),
    Query("anomaly_exceedance_runs_above", exceedance("above", 60.0), exceedance_sql(">", 60.0)),
    Query("anomaly_exceedance_runs_below", exceedance("below", 20.0), exceedance_sql("<", 20.0)),
    Query("anomaly_co_occurrence", co_occurrence, CO_SQL),
    Query("anomaly_triple_independence", triples, f"""WITH {FLAG_SQL} SELECT event_type, 'high_value' AS first_event, 'low_user' AS second_event,
 'odd_event' AS third_event, round(avg(a)*avg(b)*avg(c),6)+0.0 AS p_independent FROM f GROUP BY 1"""),
    Query("anomaly_event_points", points, f"""WITH l AS (SELECT event_id, 'value' AS "column", value AS v FROM events UNION ALL SELECT event_id, 'user_id', user_id::DOUBLE FROM events), {SIDES_SQL}
 SELECT event_id, "column", side, v AS value, threshold::DOUBLE AS threshold FROM l JOIN s USING ("column") WHERE CASE WHEN side='above' THEN v > threshold ELSE v < threshold END"""),
    Query("anomaly_scenario_points", scenario_points, SCENARIO_SQL),
]
