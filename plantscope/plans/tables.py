"""Source, profile, role and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.operators import profile, quality, readiness, roles
from plantscope.plans.registry import Query, read, tidy
from plantscope.sources import tables as src

# -- sources ------------------------------------------------------------------


def csv_of_orders(spark, d, sep=";"):
    path = src.scratch_path(spark, "orders-csv")
    read(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_custkey") % 10 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
    ).write.option("header", True).option("sep", sep).option("emptyValue", "").csv(path)
    return path


def csv_import(spark, d):
    return tidy(src.normalize_types(src.read_csv(spark, csv_of_orders(spark, d))), 2)


def csv_strings(spark, d):
    return src.read_csv(spark, csv_of_orders(spark, d), sep=";").select("o_orderkey", "o_orderstatus", "o_custkey")


def csv_quoted(spark, d):
    """Line feeds, delimiters and quotes in quoted cells, written and read back."""
    path = src.scratch_path(spark, "orders-quoted")
    note = F.concat(F.lit('say "'), "o_orderstatus", F.lit('",\n'), "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, " é").otherwise(""))
    rows = read(spark, d, "orders").select("o_orderkey", note.alias("note"), (F.col("o_orderkey") % 7).alias("rest"))
    rows.write.options(header=True, quote='"', escape='"', encoding="utf-8").csv(path)
    return src.read_csv(spark, path)


def encodings(spark, d):
    path = csv_of_orders(spark, d)
    return src.detect_encoding(spark, path + "/*.csv").groupBy("encoding").agg((F.count(F.lit(1)) > 0).alias("seen"))


def parquet_partitioned(spark, d):
    path = src.scratch_path(spark, "orders-by-status")
    src.write_parquet(read(spark, d, "orders"), path, ["o_orderstatus"])
    back = spark.read.parquet(path).where(F.col("o_orderstatus") == "F")
    return tidy(back.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


def snapshot(spark, d):
    path = src.scratch_path(spark, "snapshot")
    mark = src.save_snapshot(read(spark, d, "customer"), path)
    return tidy(src.load_snapshot(spark, path, mark), 2)


PLANTED = """SELECT event_id, ts, event_type, CASE WHEN event_id % 97 <> 0 THEN value END AS value,
 CASE WHEN event_id % 53 = 0 THEN concat(CAST(value AS STRING),'mm') WHEN event_id % 59 = 0 THEN concat(CAST(value AS STRING),' cm') ELSE CAST(value AS STRING) END AS reading,
 'K1' AS tool, CASE WHEN value > 150 THEN 'NG' WHEN event_id % 2 = 0 THEN 'ok' ELSE 'PASS' END AS result,
 CASE WHEN event_id % 1000 = 0 THEN 'rare' ELSE concat('b', CAST(event_id % 3 AS STRING)) END AS batch,
 CASE WHEN event_id % 3 <> 0 THEN user_id END AS sparse
 FROM {t}"""
PLANTED_SQL = "p0 AS (" + PLANTED.format(t="events") + "), p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE event_id % 250 = 0)"


def planted(spark, d):
    base = spark.sql(PLANTED.format(t="{ev}"), ev=read(spark, d, "events"))
    return base.unionByName(base.where(F.col("event_id") % 250 == 0))


PROFILE_COLS = ["l_quantity", "l_discount", "l_returnflag", "l_suppkey", "l_linenumber"]


def column_profile(spark, d):
    return tidy(profile.column_profile(read(spark, d, "lineitem"), PROFILE_COLS), 5)


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {'true' if c != 'l_returnflag' else 'false'} AS is_numeric, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct,
 {', '.join(f'round({fn}({c}::DOUBLE),5)+0.0 AS {a}' if c != 'l_returnflag' else f'NULL::DOUBLE AS {a}' for fn, a in (('avg','mean'),('stddev_samp','std'),('min','min'),('max','max')))},
 false AS is_metadata FROM lineitem"""
    for c in PROFILE_COLS
)


def preview(spark, d):
    return src.preview(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"], 50)


def series(spark, d):
    df = read(spark, d, "events")
    return tidy(src.series(df, "value", ["ts", "event_id"], F.col("event_type") == "click"))


def whole_series(spark, d):
    return tidy(src.series(read(spark, d, "events"), "value", ["ts", "event_id"]))


# -- roles --------------------------------------------------------------------

ROLE_EXPR = {
    "機台": "l_suppkey", "量測良率": "l_extendedprice", "出貨日期": "l_shipdate", "備註": "concat('n', CAST(l_linenumber AS STRING))",
    "lot": "l_orderkey", "run order": "l_linenumber", "ship date": "l_shipdate", "input_temperature": "l_quantity",
    "output-rate": "l_extendedprice", "result": "CASE WHEN l_returnflag = 'A' THEN 'ng' ELSE 'OK' END", "machine_id": "l_suppkey",
    "part": "l_partkey", "operator": "l_linestatus", "flag": "CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END", "grade": "l_returnflag",
    "free": "CASE WHEN l_linenumber > 3 THEN concat('t', CAST(l_orderkey AS STRING)) ELSE concat('u', CAST(l_partkey AS STRING)) END",
}


def role_table(spark, d):
    return spark.sql("SELECT " + ", ".join(f"{e} AS `{n}`" for n, e in ROLE_EXPR.items()) + " FROM {t}", t=read(spark, d, "lineitem"))


def value_evidence(spark, d):
    return tidy(roles.value_evidence(role_table(spark, d)))


def detect_roles(spark, d):
    return tidy(roles.detect_roles(role_table(spark, d)))


_EV = " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(*) AS total, count(v) AS non_null, count(DISTINCT v) AS n_distinct,
 round(count(try_cast(v AS DOUBLE))/count(v),6)+0.0 AS numeric_share,
 round(count(CASE WHEN regexp_matches(v,'^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(v AS TIMESTAMP) END)/count(v),6)+0.0 AS datetime_share,
 round(count(DISTINCT v)/count(v),6)+0.0 AS distinct_share,
 (count(*) FILTER (upper(v) NOT IN ('OK','NG','PASS','FAIL','1','0','TRUE','FALSE')) = 0 AND count(DISTINCT upper(v)) <= 2) AS is_outcome
 FROM (SELECT CAST({e} AS VARCHAR) AS v FROM lineitem)"""
    for n, e in ROLE_EXPR.items()
)


# what the name of each column says
NAMED_SQL = """n(nm, named) AS (VALUES ('機台','machine'),('量測良率','output'),('出貨日期','timestamp'),('備註','metadata'),
 ('lot','identifier'),('run order','design'),('ship date','timestamp'),('output rate','output'),('result','output'),('machine id','machine'),
 ('part','part'),('operator','metadata'))"""
ROLES_SQL = f"""WITH {NAMED_SQL}, e AS (SELECT v.*, coalesce(named,'') AS named FROM
 (SELECT *, trim(regexp_replace(replace(replace(lower("column"),'_',' '),'-',' '),'\\s+',' ','g')) AS nm FROM ({_EV})) v LEFT JOIN n USING (nm)),
k AS (SELECT *, CASE WHEN named = 'design' THEN 1 WHEN is_outcome THEN 2 WHEN datetime_share >= 0.9 AND named = 'timestamp' THEN 3
 WHEN distinct_share >= 0.9 AND named = 'identifier' THEN 4 WHEN distinct_share >= 0.95 AND non_null > 10 AND numeric_share < 0.9 AND datetime_share < 0.9 THEN 5
 WHEN named = 'machine' THEN 6 WHEN named = 'part' THEN 7 WHEN named = 'metadata' THEN 8
 WHEN numeric_share >= 0.9 AND named = 'output' THEN 9 WHEN numeric_share >= 0.9 THEN 10 WHEN distinct_share <= 0.5 THEN 11 ELSE 12 END AS r FROM e)
SELECT "column", ['identifier','quality_label','timestamp','identifier','identifier','category','category','metadata','output','input','category','metadata'][r] AS role,
 CASE WHEN r = 1 THEN CASE WHEN numeric_share >= 0.9 THEN 'continuous' ELSE 'categorical' END
  ELSE ['','binary','datetime','text','text','categorical','categorical','text','continuous','continuous','categorical','text'][r] END AS data_type,
 ([0.95,0.9,0.9,0.85,0.7,0.75,0.75,0.7,0.85,0.7,0.6,0.2]::DOUBLE[])[r] AS confidence,
 ['design_name','outcome_values','datetime_name_and_values','identifier_name_high_cardinality','near_unique_text','machine_name','part_name','metadata_name','output_name','numeric_values','low_cardinality','no_signal'][r] AS reason
FROM k"""


def datetime_parse(spark, d):
    text = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("/"), F.date_format("o_orderdate", "MM"), F.lit("/"), F.date_format("o_orderdate", "dd"))
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:30:00"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, text).when(F.col("o_orderkey") % 3 == 1, iso).otherwise("not a date")
    t = roles.parse_datetime(F.col("raw"))
    return read(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", F.unix_seconds(t).alias("seconds"))


# -- quality ------------------------------------------------------------------

NUM = ["value", "sparse"]


def on_planted(fn, digits=6):
    return lambda spark, d: tidy(fn(spark, planted(spark, d)), digits)


MISSING_COLS = ["event_id", "ts", "event_type", "value", "reading", "tool", "result", "batch", "sparse"]
MISSING_SQL = f"WITH {PLANTED_SQL} SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN 1-count({c})/count(*) > 0.5 THEN 'critical' ELSE 'warning' END AS severity,
 count(*)-count({c}) AS n, round((count(*)-count({c}))/count(*),6)+0.0 AS rate FROM p""" for c in MISSING_COLS
) + ") WHERE n > 0"

OUT_CTE = """o AS (SELECT "column", q1-1.5*(q3-q1) AS lower, q3+1.5*(q3-q1) AS upper, q1, q3, med, mad FROM (
 SELECT "column", quantile_cont(v,0.25) AS q1, quantile_cont(v,0.75) AS q3, quantile_cont(v,0.5) AS med, mad(v) AS mad FROM lv GROUP BY 1))"""
LV = """lv AS (SELECT 'value' AS "column", value AS v FROM p WHERE value IS NOT NULL UNION ALL SELECT 'sparse', sparse::DOUBLE FROM p WHERE sparse IS NOT NULL)"""
OUTLIER_SQL = f"""WITH {PLANTED_SQL}, {LV}, {OUT_CTE}, c AS (SELECT "column", lower, upper, abs(v-med)/(1.4826*mad) AS z FROM lv JOIN o USING ("column") WHERE v < lower OR v > upper),
g AS (SELECT "column", lower, upper, count(*) AS n, count(*) FILTER (z >= 10) AS me, count(*) FILTER (z >= 5 AND z < 10) AS pa, count(*) FILTER (z < 5) AS un FROM c GROUP BY ALL)
SELECT "column", n, round(lower,6)+0.0 AS lower, round(upper,6)+0.0 AS upper, me AS n_measurement_error, pa AS n_process_anomaly, un AS n_undetermined,
 CASE WHEN me>=pa AND me>=un THEN 'possible_measurement_error' WHEN pa>=un THEN 'possible_process_anomaly' ELSE 'undetermined' END AS class FROM g"""

RANGE_SQL = f"""WITH {PLANTED_SQL}, {LV}, {OUT_CTE}, r AS (SELECT "column", CASE WHEN "column"='sparse' THEN 10.0 ELSE med-8*1.4826*mad END AS range_low,
 CASE WHEN "column"='sparse' THEN NULL ELSE med+8*1.4826*mad END AS range_high FROM o)
SELECT "column", round(range_low,6)+0.0 AS range_low, round(range_high,6)+0.0 AS range_high, count(*) AS n FROM lv JOIN r USING ("column")
WHERE coalesce(v < range_low,false) OR coalesce(v > range_high,false) GROUP BY ALL"""

FORMAT_SQL = f"""WITH {PLANTED_SQL}, t AS (SELECT 'reading' AS "column", reading AS v FROM p UNION ALL SELECT 'event_type', event_type FROM p UNION ALL SELECT 'tool', tool FROM p
 UNION ALL SELECT 'result', result FROM p UNION ALL SELECT 'batch', batch FROM p), k AS (SELECT "column", v, try_cast(replace(trim(v),',','') AS DOUBLE) IS NOT NULL AS num FROM t),
c AS (SELECT "column", count(*) FILTER (num) AS n_numeric, count(*) FILTER (NOT num) AS n_other FROM k GROUP BY 1),
f AS (SELECT *, n_numeric <= n_other AS mn FROM c WHERE least(n_numeric,n_other) > 0 AND least(n_numeric,n_other)/(n_numeric+n_other) < 0.5),
x AS (SELECT "column", list_sort(list_distinct(list(v))) AS ex FROM k JOIN f USING ("column") WHERE num = mn GROUP BY 1)
SELECT "column", n_numeric, n_other, ex[1] AS example_1, ex[2] AS example_2, ex[3] AS example_3 FROM f JOIN x USING ("column")"""

UNIT_SQL = f"""WITH {PLANTED_SQL}, u AS (SELECT "column", lower(regexp_extract(trim(v),'([a-zA-Z°]+)$',1)) AS unit FROM (SELECT 'reading' AS "column", reading AS v FROM p
 UNION ALL SELECT 'tool', tool FROM p UNION ALL SELECT 'batch', batch FROM p)), g AS (SELECT "column", unit, count(*) AS n FROM u WHERE unit <> '' GROUP BY 1,2)
SELECT "column", unit, n, n_units FROM g JOIN (SELECT "column", count(*) AS n_units FROM g GROUP BY 1 HAVING count(*) > 1) USING ("column")"""


def report(spark, d):
    df = planted(spark, d)
    ranges = spark.createDataFrame([("sparse", 10.0, None)], "column string, low double, high double")
    spec = spark.createDataFrame([("sparse", None, 5.0)], "column string, lsl double, usl double")
    issues = quality.quality_report(
        df, position=["event_id", "batch"], categorical=["event_id"], outcomes=["result"], timestamps=["ts"], batches=["batch"],
        inputs=NUM, outputs=["value", "sparse"], ranges=ranges, spec=spec,
    )
    return issues.select("check", "column", "severity", "n")


REPORT_SQL = f"""WITH {PLANTED_SQL} SELECT 'missing_value' AS "check", "column", severity, n FROM ({MISSING_SQL})
UNION ALL SELECT 'duplicate', NULL, 'warning', sum(k-1)::BIGINT FROM (SELECT count(*) AS k FROM p GROUP BY ALL, event_id, ts, event_type, value, reading, tool, result, batch, sparse)
UNION ALL SELECT 'constant_column', 'tool', 'warning', count(tool) FROM p
UNION ALL SELECT 'outlier', "column", 'warning', n FROM ({OUTLIER_SQL})
UNION ALL SELECT 'invalid_format', "column", 'warning', n_other FROM ({FORMAT_SQL})
UNION ALL SELECT 'unit_mixing', "column", 'warning', max(n_units) FROM ({UNIT_SQL.replace("SELECT 'tool', tool FROM p", "SELECT 'tool', tool FROM p UNION ALL SELECT 'result', result FROM p UNION ALL SELECT 'event_type', event_type FROM p")}) GROUP BY 2
UNION ALL SELECT 'input_out_of_range', "column", 'warning', n FROM ({RANGE_SQL})
UNION ALL SELECT 'unbalanced_outcome', 'result', 'warning', count(*) FILTER (upper(result)='NG') FROM p
UNION ALL SELECT 'batch_imbalance', 'batch', 'info', min(k) FROM (SELECT count(*) AS k FROM p GROUP BY batch)
UNION ALL SELECT 'missing_spec', 'value', 'warning', 1""".replace("GROUP BY ALL, event_id", "GROUP BY event_id")


READY_ROLES = {"value": "output", "sparse": "input", "tool": "process_input", "event_id": "identifier"}


def ready(spark, d):
    spec = spark.createDataFrame([("value", None, None), ("sparse", 0.0, 200.0)], "column string, lsl double, usl double")
    return readiness.readiness(planted(spark, d), READY_ROLES, spec)


READY = PLANTED_SQL + """, rl AS (SELECT 'value' AS "column", 'output' AS role, value AS v FROM p UNION ALL SELECT 'sparse', 'input', sparse::DOUBLE FROM p UNION ALL SELECT 'tool', 'process_input', try_cast(tool AS DOUBLE) FROM p),
rg AS (SELECT "column", role, count(*) AS n_rows, count(v) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_samp(v) AS s, stddev_pop(v) AS sp, count(DISTINCT v) AS k FROM rl GROUP BY 1,2),
rd AS (SELECT *, CASE WHEN n = 0 OR (n_rows-n)/n_rows > 0.5 THEN 'critical' WHEN k <= 1 OR n < n_rows OR "column" = 'value' THEN 'warning' ELSE 'info' END AS status FROM rg)"""


def _psi(x, order):
    """Digamma (order 0) or trigamma (order 1) in SQL: ten steps up, then the series."""
    z = f"({x}+10)"
    if order:
        return f"(1/{z}+1/(2*{z}^2)+1/(6*{z}^3)-1/(30*{z}^5)+1/(42*{z}^7)" + "".join(f"+1/({x}+{i})^2" for i in range(10)) + ")"
    return f"(ln({z})-1/(2*{z})-1/(12*{z}^2)+1/(120*{z}^4)-1/(252*{z}^6)" + "".join(f"-1/({x}+{i})" for i in range(10)) + ")"


# all families: Weibull and gamma shapes by Newton's method, one named table a step
READY_FITS = """, vc AS MATERIALIZED (SELECT "column", v, v+CASE WHEN lo <= 0 THEN 1e-6-lo ELSE 0 END AS y, count(*) AS c FROM rl JOIN rg USING ("column", role) WHERE v IS NOT NULL GROUP BY ALL),
ra AS (SELECT "column", n, lo, hi, m, sp, sp*sp AS va FROM rg WHERE n > 0), rs AS (SELECT * FROM ra WHERE n >= 10 AND sp > 0),
ry AS MATERIALIZED (SELECT "column", sum(c*y)/sum(c) AS ym, sum(c*ln(y))/sum(c) AS lm, sqrt(greatest(sum(c*ln(y)^2)/sum(c)-(sum(c*ln(y))/sum(c))^2, 0)) AS ls FROM vc GROUP BY 1),
k0 AS (SELECT "column", ym, lm-ln(ym) AS zm, pi()/sqrt(6)/ls AS k, 1.0::DOUBLE AS pm, 1.0::DOUBLE AS kk FROM ry WHERE ls > 0),
""" + ",\n".join(
    f"""k{i + 1} AS MATERIALIZED (SELECT "column", ym, zm, greatest(k-(b/a-1/k-zm)/(d/a-(b/a)^2+1/k^2), k/4) AS k, pm, k AS kk FROM (SELECT "column", ym, zm, k, sum(c*(y/ym)^k) AS a,
 sum(c*(y/ym)^k*ln(y/ym)) AS b, sum(c*(y/ym)^k*ln(y/ym)^2) AS d, sum(c*(y/ym)^k)/sum(c) AS pm FROM vc JOIN k{i} USING ("column") GROUP BY ALL))""" for i in range(30)
) + """,
g0 AS (SELECT "column", ln(ym)-lm AS s, (3-(ln(ym)-lm)+sqrt(((ln(ym)-lm)-3)^2+24*(ln(ym)-lm)))/(12*(ln(ym)-lm)) AS a FROM ry WHERE ls > 0),
""" + ",\n".join(f"""g{i + 1} AS MATERIALIZED (SELECT "column", s, a-(ln(a)-{_psi("a", 0)}-s)/(1/a-{_psi("a", 1)}) AS a FROM g{i})""" for i in range(6)) + """,
tb AS (SELECT "column", v, c, n, lo-(hi-lo)/n AS l, hi+(hi-lo)/n AS h FROM vc JOIN rs USING ("column")),
tr AS (SELECT "column", v, n, l, h, sum(c) OVER w AS n1, sum(c*ln(v-l)) OVER w AS l1, sum(c*ln(h-v)) OVER w AS r1, sum(c*ln(h-v)) OVER (PARTITION BY "column") AS ra
 FROM tb WINDOW w AS (PARTITION BY "column" ORDER BY v ROWS UNBOUNDED PRECEDING)),
iv AS (SELECT "column", n, m, va, m/va AS p, CASE WHEN va > m THEN m*(m/va)/(1-m/va) END AS r FROM ra JOIN (SELECT "column" FROM vc GROUP BY 1 HAVING bool_and(abs(v-round(v)) <= 1e-8+1e-5*abs(round(v)))) USING ("column") WHERE n >= 10 AND lo >= 0 AND m > 0),
hb AS (SELECT "column", n, CASE WHEN lo = hi THEN lo-0.5 ELSE lo END AS l, least(greatest(floor(sqrt(n)), 5), 30) AS bins, (CASE WHEN lo = hi THEN 1 ELSE hi-lo END)/least(greatest(floor(sqrt(n)), 5), 30) AS w FROM ra),
hc AS (SELECT "column", n, bins, w, least(floor((v-l)/w), bins-1) AS bin, sum(c) AS c FROM vc JOIN hb USING ("column") GROUP BY ALL),
rf AS (SELECT "column", 'normal' AS fam, 4+n*(ln(2*pi())+2*ln(sp)+1) AS aic FROM rs
 UNION ALL SELECT "column", 'lognormal', 6+2*n*lm+n*(ln(2*pi())+2*ln(ls)+1) FROM rs JOIN ry USING ("column") WHERE ls > 0
 UNION ALL SELECT "column", 'uniform', 4+2*n*ln(hi-lo) FROM rs
 UNION ALL SELECT "column", 'triangular', 6-2*max(n*ln(2/(h-l))+l1-n1*ln(v-l)+ra-r1-(n-n1)*ln(h-v)) FROM tr GROUP BY 1
 UNION ALL SELECT "column", 'weibull', 6-2*n*(ln(k)-k*(ln(w.ym)+ln(pm)/kk)+(k-1)*lm-1) FROM rs JOIN k30 AS w USING ("column") JOIN ry USING ("column")
 UNION ALL SELECT "column", 'gamma', 6-2*n*((a-1)*lm-a-a*ln(ym/a)-lgamma(a)) FROM rs JOIN g6 USING ("column") JOIN ry USING ("column")
 UNION ALL SELECT "column", 'poisson', 2-2*(any_value(n)*any_value(m)*ln(any_value(m))-any_value(n)*any_value(m)-sum(c*lgamma(round(v)+1))) FROM iv JOIN vc USING ("column") GROUP BY 1
 UNION ALL SELECT "column", 'negative_binomial', 4-2*(sum(c*(lgamma(round(v)+r)-lgamma(r)-lgamma(round(v)+1)))+any_value(n*(r*ln(p)+m*ln(1-p)))) FROM iv JOIN vc USING ("column") WHERE va > m GROUP BY 1
 UNION ALL SELECT "column", 'empirical', 2*any_value(bins)-2*sum(c*ln(c/(n*w)+2.220446049250313e-16)) FROM hc GROUP BY 1),
rb AS (SELECT "column", first(fam ORDER BY aic, fam) AS best_family FROM rf WHERE isfinite(aic) GROUP BY 1)"""


def disorder(spark, d):
    return quality.time_disorder(read(spark, d, "orders"), "o_orderdate", ["o_orderkey"])


QUERIES = [
    Query("source_csv_import", csv_import, """SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus, round(o_totalprice,2)+0.0 AS o_totalprice,
 CASE WHEN o_custkey % 10 <> 0 THEN o_custkey::DOUBLE END AS o_custkey FROM orders"""),
    Query("source_csv_as_text", csv_strings, "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE o_custkey::VARCHAR END AS o_custkey FROM orders"),
    Query("source_csv_quoted", csv_quoted, """SELECT o_orderkey::VARCHAR AS o_orderkey, 'say "' || o_orderstatus || '",' || chr(10) || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' é' ELSE '' END AS note,
 (o_orderkey % 7)::VARCHAR AS rest FROM orders"""),
    Query("source_csv_encoding", encodings, "SELECT 'utf-8' AS encoding, count(*) > 0 AS seen FROM orders"),
    Query("source_parquet_partitioned", parquet_partitioned, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice),2)+0.0 AS total FROM orders WHERE o_orderstatus='F' GROUP BY 1,2"),
    Query("source_snapshot_round_trip", snapshot, "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal,2)+0.0 AS c_acctbal, c_mktsegment FROM customer"),
    Query("source_fingerprint", lambda spark, d: src.fingerprint(read(spark, d, "lineitem"))),
    Query("source_scan_files", lambda spark, d: src.scan_files(spark, d).select("name", "size", "format")),
    Query("source_file_checksums", lambda spark, d: src.file_checksums(spark, f"{d}/*.parquet")),
    Query("source_preview", preview, "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 50"),
    Query("source_series", series, "SELECT ts, event_id, value FROM events WHERE event_type = 'click'"),
    Query("source_series_all", whole_series, "SELECT ts, event_id, value FROM events"),
    Query("profile_columns", column_profile, PROFILE_SQL),
    Query("role_value_evidence", value_evidence, _EV),
    Query("role_detection", detect_roles, ROLES_SQL),
    Query("role_datetime_parse", datetime_parse, """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT
 WHEN o_orderkey % 3 = 1 THEN epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT + 30600 END AS seconds FROM orders"""),
    Query("quality_missing_values", on_planted(lambda s, p: quality.missing_values(p)), MISSING_SQL),
    Query("quality_duplicate_rows", on_planted(lambda s, p: quality.duplicate_rows(p)), f"WITH {PLANTED_SQL} SELECT sum(k-1)::BIGINT AS n FROM (SELECT count(*) AS k FROM p GROUP BY event_id, ts, event_type, value, reading, tool, result, batch, sparse)"),
    Query("quality_constant_columns", on_planted(lambda s, p: quality.constant_columns(p)), f"WITH {PLANTED_SQL} SELECT 'tool' AS \"column\", count(tool) AS n FROM p HAVING count(DISTINCT tool) <= 1"),
    Query("quality_outliers", on_planted(lambda s, p: quality.outlier_columns(p, NUM)), OUTLIER_SQL),
    Query("quality_time_disorder", disorder, """SELECT 'o_orderdate' AS "column", count(*) AS n FROM (SELECT o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) AS b FROM orders) WHERE b"""),
    Query("quality_outcome_imbalance", on_planted(lambda s, p: quality.outcome_imbalance(p, ["result"])), f"WITH {PLANTED_SQL} SELECT 'result' AS \"column\", count(*) FILTER (upper(result) IN ('OK','PASS','1')) AS n_ok, count(*) FILTER (upper(result) IN ('NG','FAIL','0')) AS n_ng FROM p"),
    Query("quality_batch_imbalance", on_planted(lambda s, p: quality.batch_imbalance(p, ["batch", "event_type"])), f"WITH {PLANTED_SQL} SELECT * FROM (SELECT 'batch' AS \"column\", min(k) AS smallest, max(k) AS largest FROM (SELECT count(*) AS k FROM p GROUP BY batch) UNION ALL SELECT 'event_type', min(k), max(k) FROM (SELECT count(*) AS k FROM p GROUP BY event_type)) WHERE smallest/largest < 0.1"),
    Query("quality_mixed_formats", on_planted(lambda s, p: quality.mixed_formats(p, examples=3)), FORMAT_SQL),
    Query("quality_mixed_units", on_planted(lambda s, p: quality.mixed_units(p, ["reading", "tool", "batch"])), UNIT_SQL),
    Query("quality_out_of_range", on_planted(lambda s, p: quality.out_of_range(p, NUM, s.createDataFrame([("sparse", 10.0, None)], "column string, low double, high double"))), RANGE_SQL),
    Query("quality_missing_spec", on_planted(lambda s, p: quality.missing_spec(profile.column_profile(p, ["value", "sparse"]).where("is_numeric"), s.createDataFrame([("sparse", None, 5.0)], "column string, lsl double, usl double"))), f"WITH {PLANTED_SQL} SELECT 'value' AS \"column\" FROM p HAVING count(value) > 0"),
    Query("quality_report", report, REPORT_SQL),
    Query("quality_readiness_best_family", lambda s, d: ready(s, d).select("column", "best_family")),
    Query("quality_readiness", lambda s, d: tidy(ready(s, d)), f"""WITH {READY}{READY_FITS} SELECT "column", role, n_rows, n AS n_valid, n_rows-n AS n_missing, k AS n_distinct, round(lo,6)+0.0 AS min, round(hi,6)+0.0 AS max,
 round(m,6)+0.0 AS mean, round(s,6)+0.0 AS std, best_family, concat_ws(',', CASE WHEN n = 0 THEN 'no_numeric_values' END, CASE WHEN n > 0 AND k <= 1 THEN 'constant_column' END,
 CASE WHEN n < n_rows THEN 'missing_values' END, CASE WHEN role = 'output' THEN 'missing_spec' END) AS issues, status FROM rd LEFT JOIN rb USING ("column")"""),
    Query("quality_readiness_status", lambda s, d: tidy(readiness.overall_status(ready(s, d))), f"WITH {READY} SELECT CASE WHEN bool_or(status='critical') THEN 'critical' WHEN bool_or(status='warning') THEN 'warning' ELSE 'info' END AS status, count(*) AS n_columns FROM rd"),
    Query("quality_severity_counts", lambda s, d: quality.severity_counts(report(s, d)), f"SELECT count(*) FILTER (severity='info') AS info, count(*) FILTER (severity='warning') AS warning, count(*) FILTER (severity='critical') AS critical FROM ({REPORT_SQL})"),
]
