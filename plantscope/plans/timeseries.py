"""Time-series preparation queries over ``events`` and daily ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.operators import timeseries as ts
from plantscope.operators.ordered import OrderedScan
from plantscope.plans.registry import Query, read, tidy

KEYS = ["event_type"]
W = "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"


def events(spark, d):
    return read(spark, d, "events")


def scan(spark, d, *cols):
    return OrderedScan(events(spark, d).select(*KEYS, "ts", "event_id", *cols), KEYS, ["ts", "event_id"])


RAW = """SELECT event_id, event_type, CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN 'bad stamp'
 WHEN event_id % 47 = 0 THEN '2024-01-05 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events"""


def raw_stamps(spark, d):
    stamp = (
        F.when(F.col("event_id") % 41 == 0, None).when(F.col("event_id") % 43 == 0, "bad stamp")
        .when(F.col("event_id") % 47 == 0, "2024-01-05 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return events(spark, d).select("event_id", "event_type", stamp.alias("stamp"))


def parse(spark, d):
    return tidy(ts.parse_report(raw_stamps(spark, d), "stamp", KEYS))


def zones(spark, d):
    base = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    stamp = F.when(F.col("event_id") % 2 == 0, base).otherwise(F.concat(base, F.lit("+02:00")))
    out = events(spark, d).select("event_id", F.unix_seconds(ts.to_utc(stamp, "Asia/Tokyo")).alias("seconds"))
    return out


def intervals(spark, d):
    return tidy(ts.interval_summary(events(spark, d), "ts", ["event_id"], KEYS))


GAPS = f"g AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER w)/1e6 AS s FROM events {W})"
GAPS_SQL = "SELECT event_type, count(s) AS n_intervals, round(min(s),6)+0.0 AS min_seconds, round(max(s),6)+0.0 AS max_seconds, round(quantile_cont(s,0.5),6)+0.0 AS median_seconds FROM g GROUP BY 1"


def frequency(spark, d):
    out = ts.frequency_defaults(ts.interval_summary(events(spark, d), "ts", ["event_id"], KEYS))
    return out.select(*KEYS, "frequency", F.concat_ws(",", F.col("lags").cast("array<string>")).alias("lags"), F.concat_ws(",", F.col("rolling_windows").cast("array<string>")).alias("rolling_windows"))


FREQ_SQL = f"""WITH {GAPS}, m AS (SELECT event_type, quantile_cont(s,0.5) AS m FROM g GROUP BY 1)
SELECT event_type, CASE WHEN m < 3600 THEN 'minute' WHEN m <= 3600 THEN 'hourly' WHEN m <= 86400 THEN 'daily' ELSE 'coarse' END AS frequency,
 CASE WHEN m < 3600 THEN '1,60' WHEN m <= 3600 THEN '1,24' WHEN m <= 86400 THEN '1,7' ELSE '1' END AS lags,
 CASE WHEN m < 3600 THEN '60' WHEN m <= 3600 THEN '24' WHEN m <= 86400 THEN '7' ELSE '3' END AS rolling_windows FROM m"""


def lags(spark, d):
    return tidy(ts.lag_features(scan(spark, d, "value"), ["value"], [1, 7]).rows().drop("ts"))


HIST = ["value_lag_1", "value_lag_7", "value_rolling_mean_5", "value_rolling_std_5", "value_first_difference", "value_rate_of_change"]


def history(spark, d):
    s = ts.history_features(scan(spark, d, "value"), ["value"], [1, 7], [5])
    return tidy(s.rows().select(*KEYS, "event_id", *HIST))


HIST_EXPR = """lag(value,1) OVER w AS value_lag_1, lag(value,7) OVER w AS value_lag_7,
 CASE WHEN count(value) OVER w5 = 5 THEN avg(value) OVER w5 END AS value_rolling_mean_5, CASE WHEN count(value) OVER w5 = 5 THEN stddev_samp(value) OVER w5 END AS value_rolling_std_5,
 lag(value,1) OVER w - lag(value,2) OVER w AS value_first_difference, lag(value,1) OVER w / nullif(lag(value,2) OVER w, 0) - 1 AS value_rate_of_change"""
HIST_WIN = W + ", w5 AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


def calendar(spark, d):
    out = ts.calendar_features(events(spark, d).select("event_id", "ts"), "ts", "America/New_York")
    return tidy(out.drop("ts"))


def planted(spark, d):
    return events(spark, d).withColumn("value", F.when(F.col("event_id") % 101 != 0, F.col("value")))


def full(spark, d):
    out = ts.build_features(planted(spark, d), "ts", ["event_id"], ["value"], [1, 7], [5], KEYS)
    return tidy(out.where("is_complete").select(*KEYS, "event_id", "rn", *HIST, "hour", "weekday"))


FULL_CTE = f"""f AS (SELECT event_type, event_id, ts, value, row_number() OVER w AS rn, {HIST_EXPR}, hour(ts) AS hour, isodow(ts)-1 AS weekday
 FROM (SELECT * REPLACE (CASE WHEN event_id % 101 <> 0 THEN value END AS value) FROM events) {HIST_WIN})"""
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in HIST)
ROUND_HIST = ", ".join(f"round({c},6)+0.0 AS {c}" for c in HIST)


def report(spark, d):
    out = ts.build_features(planted(spark, d), "ts", ["event_id"], ["value"], [1, 7], [5], KEYS)
    return tidy(ts.feature_report(out, ["value"], KEYS))


def irregular(spark, d):
    return ts.irregular_intervals(events(spark, d), "ts", ["event_id"], KEYS)


QUICK = [*(f"value_lag{k}" for k in (1, 2, 3)), "value_delta", *(f"value_roll_{s}_{n}" for n in (3, 5, 10) for s in ("mean", "std")), "value_drift"]


def quick(spark, d):
    return tidy(ts.quick_features(scan(spark, d, "value"), ["value"]).select(*KEYS, "event_id", *QUICK))


QUICK_SQL = f"""WITH q AS (SELECT event_type, event_id, value, {', '.join(f'lag(value,{k}) OVER w AS value_lag{k}' for k in (1, 2, 3))}, value - lag(value) OVER w AS value_delta,
 {', '.join(f'avg(value) OVER w{n} AS value_roll_mean_{n}, stddev_samp(value) OVER w{n} AS value_roll_std_{n}' for n in (3, 5, 10))}
 FROM events {W}, {', '.join(f'w{n} AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in (3, 5, 10))})
SELECT event_type, event_id, {', '.join(f'round({c},6)+0.0 AS {c}' for c in QUICK[:-1])}, round(value - value_roll_mean_10,6)+0.0 AS value_drift FROM q"""


def recommend(spark, d):
    return tidy(ts.recommend_windows(events(spark, d), "ts", ["event_id"], KEYS))


REC_SQL = f"""WITH {GAPS}, m AS (SELECT event_type, quantile_cont(s,0.5) AS m FROM g GROUP BY 1),
e AS (SELECT event_type, (max(epoch_us(ts))-min(epoch_us(ts)))/86400e6 AS span_days FROM events GROUP BY 1),
r AS (SELECT event_type, span_days, span_days + m/86400 AS effective_days, unnest([3,5,7,14,30,60,90])::BIGINT AS window_days FROM e JOIN m USING (event_type))
SELECT event_type, round(span_days,6)+0.0 AS span_days, round(effective_days,6)+0.0 AS effective_days, window_days,
 CASE WHEN effective_days >= window_days THEN 'available' ELSE 'insufficient_history' END AS status FROM r"""


def split(spark, d):
    return tidy(ts.time_split(events(spark, d).select(*KEYS, "ts", "event_id"), "ts", ["event_id"], 0.7, 0.2, KEYS).drop("ts"))


SPLIT_CTE = """n AS (SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
sp AS (SELECT *, CASE WHEN rn <= floor(n*0.7) THEN 'train' WHEN rn <= floor(n*0.7)+floor(n*0.2) THEN 'validation' ELSE 'test' END AS split FROM n)"""


def ties(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    s = ts.time_split(o, "o_orderdate", ["o_orderkey"], 0.7, 0.2, ["status"])
    return ts.split_ties(s, "o_orderdate", ["status"])


TIES_SQL = """WITH n AS (SELECT o_orderstatus AS status, o_orderdate AS t, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT status, max(t) FILTER (rn <= floor(n*0.7)) >= min(t) FILTER (rn > floor(n*0.7)) AS train_validation_tie,
 max(t) FILTER (rn <= floor(n*0.7)+floor(n*0.2)) >= min(t) FILTER (rn > floor(n*0.7)+floor(n*0.2)) AS validation_test_tie FROM n GROUP BY 1"""


def folds(spark, d):
    out = ts.walk_forward_folds(events(spark, d).select(*KEYS, "ts", "event_id"), "ts", ["event_id"], 1000, 150, 100, KEYS)
    return tidy(out.drop("ts"))


FOLD_CTE = """n AS (SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
fo AS (SELECT event_type, event_id, rn, f.fold, 1000+f.fold*100 AS train_end FROM n JOIN (SELECT unnest(generate_series(0, (SELECT max(n) FROM n)::BIGINT)) AS fold) f
 ON rn > 1000+f.fold*100 AND rn <= 1000+f.fold*100+150 AND 1000+f.fold*100+150 <= n)"""


def sizes(spark, d):
    out = ts.walk_forward_folds(events(spark, d).select(*KEYS, "ts", "event_id"), "ts", ["event_id"], 1000, 150, 100, KEYS)
    return tidy(ts.fold_sizes(out, KEYS))


def leakage(spark, d):
    ev = events(spark, d).select(
        "event_id", "ts", F.when(F.col("event_id") % 500 == 3, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("late"),
        F.when(F.col("event_id") % 9 != 0, F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("early"),
    )
    return tidy(ts.leakage_check(ev, "ts", ["late", "early"], ["event_id"]))


def halves(spark, d):
    return tidy(ts.chronological_halves(events(spark, d).select(*KEYS, "ts", "event_id"), "ts", ["event_id"], KEYS).drop("ts"))


def sequences(spark, d):
    out = ts.sequence_windows(events(spark, d), "ts", ["event_id"], ["value", "user_id"], 4, 0.8, KEYS)
    return tidy(out.select(
        *KEYS, "event_id", "rn", *[F.col("value_sequence")[i].alias(f"v{i}") for i in range(4)], F.col("user_id_sequence")[3].alias("u3"), F.col("position")[1].alias("p1"),
    ))


SEQ_SQL = f"""WITH n AS (SELECT event_type, ts, event_id, value, user_id::DOUBLE AS u, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events {W}),
s AS (SELECT event_type, avg(value) AS mv, stddev_pop(value) AS sv, avg(u) AS mu, stddev_pop(u) AS su FROM n WHERE rn <= floor(n*0.8) GROUP BY 1),
z AS (SELECT event_type, ts, event_id, rn, (value-mv)/sv AS zv, (u-mu)/su AS zu FROM n JOIN s USING (event_type)),
q AS (SELECT event_type, event_id, rn, lag(zv,4) OVER w AS v0, lag(zv,3) OVER w AS v1, lag(zv,2) OVER w AS v2, lag(zv,1) OVER w AS v3, lag(zu,1) OVER w AS u3 FROM z {W})
SELECT event_type, event_id, rn, round(v0,6)+0.0 AS v0, round(v1,6)+0.0 AS v1, round(v2,6)+0.0 AS v2, round(v3,6)+0.0 AS v3, round(u3,6)+0.0 AS u3, round(-1+2.0/3,6)+0.0 AS p1 FROM q WHERE rn > 4"""


def usable(spark, d):
    out = ts.sequence_windows(events(spark, d), "ts", ["event_id"], ["value"], 24, 0.8, KEYS)
    return tidy(ts.usable_sequences(out, 100, KEYS))


def provenance(spark, d):
    table = ts.feature_provenance(spark, ["value"], [1, 7], [5])
    feats = ts.build_features(planted(spark, d), "ts", ["event_id"], ["value"], [1, 7], [5], KEYS)
    names = ts.feature_names(["value"], [1, 7], [5])
    known = feats.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "feature", "n_known")
    return tidy(table.join(F.broadcast(known), "feature"))


PROV_SQL = f"""WITH {FULL_CTE} SELECT feature, kind, source, lag, "window", availability, n_known FROM (VALUES
 ('value_lag_1','lag','value',1::BIGINT,NULL::BIGINT,'past_only',(SELECT count(value_lag_1) FROM f)), ('value_lag_7','lag','value',7,NULL,'past_only',(SELECT count(value_lag_7) FROM f)),
 ('value_rolling_mean_5','rolling_mean','value',NULL,5,'past_only',(SELECT count(value_rolling_mean_5) FROM f)), ('value_rolling_std_5','rolling_std','value',NULL,5,'past_only',(SELECT count(value_rolling_std_5) FROM f)),
 ('value_first_difference','first_difference','value',1,NULL,'past_only',(SELECT count(value_first_difference) FROM f)), ('value_rate_of_change','rate_of_change','value',1,NULL,'past_only',(SELECT count(value_rate_of_change) FROM f)),
 ('hour','calendar',NULL,NULL,NULL,'known_in_advance',(SELECT count(hour) FROM f)), ('weekday','calendar',NULL,NULL,NULL,'known_in_advance',(SELECT count(weekday) FROM f)))
 t(feature,kind,source,lag,"window",availability,n_known)"""

QUERIES = [
    Query("feature_provenance", provenance, PROV_SQL),
    Query("series_parse_report", parse, f"""WITH r AS ({RAW}), p AS (SELECT *, try_cast(stamp AS TIMESTAMP) AS t FROM r)
SELECT event_type, count(*) AS n_rows, count(*) FILTER (stamp IS NULL) AS missing, count(*) FILTER (stamp IS NOT NULL AND t IS NULL) AS parse_errors,
 count(t) - count(DISTINCT t) AS duplicates FROM p GROUP BY 1"""),
    Query("series_to_utc", zones, "SELECT event_id, floor(epoch(ts))::BIGINT - CASE WHEN event_id % 2 = 0 THEN 9*3600 ELSE 2*3600 END AS seconds FROM events"),
    Query("series_interval_summary", intervals, f"WITH {GAPS} {GAPS_SQL}"),
    Query("series_frequency_defaults", frequency, FREQ_SQL),
    Query("feature_lags", lags, f"SELECT event_type, event_id, value, lag(value,1) OVER w AS value_lag_1, lag(value,7) OVER w AS value_lag_7 FROM events {W}"),
    Query("feature_history", history, f"WITH h AS (SELECT event_type, event_id, {HIST_EXPR} FROM events {HIST_WIN}) SELECT event_type, event_id, {ROUND_HIST} FROM h"),
    Query("feature_calendar", calendar, "SELECT event_id, hour(ts - INTERVAL 5 HOUR) AS hour, isodow(ts - INTERVAL 5 HOUR)-1 AS weekday FROM events"),
    Query("feature_table", full, f"WITH {FULL_CTE} SELECT event_type, event_id, rn, {ROUND_HIST}, hour, weekday FROM f WHERE rn > 7 AND {COMPLETE}"),
    Query("feature_report", report, f"""WITH {FULL_CTE} SELECT event_type, count(*) FILTER (rn <= 7) AS warmup_rows, count(*) FILTER (rn > 7 AND NOT ({COMPLETE})) AS invalid_rows,
 count(*) FILTER (rn > 7 AND {COMPLETE}) AS complete_rows, count(*) FILTER (value IS NULL) AS missing_value FROM f GROUP BY 1"""),
    Query("feature_irregular_intervals", irregular, f"WITH {GAPS} SELECT event_type, min(s) <> max(s) AS irregular FROM g GROUP BY 1"),
    Query("feature_quick", quick, QUICK_SQL),
    Query("series_window_recommendation", recommend, REC_SQL),
    Query("split_chronological", split, f"WITH {SPLIT_CTE} SELECT event_type, event_id, rn, split FROM sp"),
    Query("split_boundary_ties", ties, TIES_SQL),
    Query("split_walk_forward_folds", folds, f"WITH {FOLD_CTE} SELECT event_type, event_id, rn, fold, train_end FROM fo"),
    Query("split_fold_sizes", sizes, f"WITH {FOLD_CTE} SELECT event_type, fold, max(train_end) AS train_rows, count(*) AS validation_rows FROM fo GROUP BY 1,2"),
    Query("split_leakage_check", leakage, """SELECT 'late' AS source, count(*) AS checked_rows, count(*) FILTER (event_id % 500 = 3) AS n_leaks, min(event_id) FILTER (event_id % 500 = 3) AS first_event_id,
 CASE WHEN count(*) FILTER (event_id % 500 = 3) = 0 THEN 'passed' ELSE 'failed' END AS status FROM events UNION ALL SELECT 'early', count(*), 0, NULL, 'passed' FROM events"""),
    Query("split_halves", halves, f"WITH {SPLIT_CTE} SELECT event_type, event_id, rn, CASE WHEN rn <= floor(n/2) THEN 'adapt' ELSE 'holdout' END AS half FROM sp"),
    Query("feature_sequence_windows", sequences, SEQ_SQL),
    Query("feature_usable_sequences", usable, "SELECT event_type, count(*)-24 AS n_sequences, count(*)-24 >= 100 AS enough FROM events GROUP BY 1 HAVING count(*) > 24"),
]
