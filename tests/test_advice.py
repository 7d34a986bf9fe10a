"""Queries that read less than their tables, against loops over all rows."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from plantscope import plans
from plantscope.plans import forecast, tables

SF = "/root/testdata/sf0.01"


def test_group_coverage_counts_users(spark):
    series = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        series[r.event_type].append((r.ts, r.event_id, r.user_id))
    want = {}
    for name, rows in series.items():
        rows.sort()
        end = 1150 + (len(rows) - 1150) // 100 * 100
        want[name] = len({r[2] for r in rows[1000:end]}) / len({r[2] for r in rows})
    assert min(want.values()) < 1
    got = {r.event_type: r.group_coverage for r in forecast.user_coverage(spark, SF).collect()}
    assert got == want


def test_every_event_type_is_compared_and_read(spark):
    values = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        values[r.event_type].append(r.value)
    mean = {k: sum(v) / len(v) for k, v in values.items()}
    got = {r.event_type: r for r in plans.all_queries()["risk_compare_all_outcomes"].run(spark, SF).collect()}
    assert set(got) == set(mean) - {"click"} and len(got) == 4
    assert all(abs(r.mean_shift - (mean[k] - mean["click"])) < 1e-5 and r.mean_baseline for k, r in got.items())
    assert plans.all_queries()["source_series_all"].run(spark, SF).count() == sum(map(len, values.values()))


def test_readiness_tries_every_family(spark):
    values = [r.value for r in tables.planted(spark, SF).select("value").collect() if r.value is not None]
    n, mean = len(values), sum(values) / len(values)
    logs = [math.log(v) for v in values]
    spread = math.sqrt(sum((x - sum(logs) / n) ** 2 for x in logs) / n)
    exponential = 4 + 2 * n * (1 + math.log(mean))  # gamma of shape 1
    assert exponential < 6 + 2 * sum(logs) + n * (math.log(2 * math.pi) + 2 * math.log(spread) + 1)
    best = {r.column: r.best_family for r in tables.ready(spark, SF).collect()}
    assert best["value"] not in {"normal", "lognormal", "uniform"}


def test_density_of_every_family(spark):
    rows = plans.all_queries()["distribution_density_curve"].run(spark, SF).where("event_type = 'click'").collect()
    assert {"normal", "lognormal", "uniform", "triangular", "weibull", "gamma"} <= {r.family for r in rows}
    values = [r.value for r in spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'click'").collect()]
    fit = next(r.asDict() for r in plans.all_queries()["distribution_gamma"].run(spark, SF).where("event_type = 'click'").collect())
    shape, scale = fit["p_shape"], fit["p_scale"]
    assert abs(shape * scale - sum(values) / len(values)) < 0.1
    for r in rows:
        if r.family == "gamma" and r.x > 1:
            want = math.exp((shape - 1) * math.log(r.x) - r.x / scale - math.lgamma(shape) - shape * math.log(scale))
            assert abs(r.density - want) < 1e-4 * max(want, 1e-2)


def test_readiness_shows_the_best_of_all_families_in_both(spark):
    import duckdb

    from plantscope.operators import distributions

    query = plans.all_queries()["quality_readiness"]
    got = {r.column: r.best_family for r in query.run(spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    rows = con.execute(query.sql).fetchall()
    at = [c[0] for c in con.description].index("best_family")
    assert got == {r[0]: r[at] for r in rows} and got["value"] not in {None, "normal", "lognormal", "uniform"} and got["tool"] is None
    # each family's AIC, not the best one alone
    long = tables.planted(spark, SF).select("value", F.col("sparse").cast("double").alias("sparse")).unpivot([], ["value", "sparse"], "column", "v")
    fits = {(r.column, r.family): r.aic for r in distributions.fit_table(long.withColumnRenamed("v", "x"), "x", ["column"]).collect()}
    every = query.sql[: query.sql.index("rb AS (SELECT")].rstrip().rstrip(",") + " SELECT * FROM rf"
    aic = {(r[0], r[1]): r[2] for r in con.execute(every).fetchall()}
    assert set(aic) == set(fits) and len({f for _, f in aic}) == 9
    assert all(abs(aic[k] - fits[k]) <= 1e-6 * abs(fits[k]) for k in fits)
