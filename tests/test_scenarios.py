"""The points of anomaly scenarios against the events that they stand for."""

import pytest
from pyspark.sql import functions as F

from plantscope.operators import anomalies as an
from plantscope.operators.ordered import OrderedScan

ORDER, KEYS = ["ts", "event_id"], ["event_type"]


@pytest.mark.parametrize("rows_per_bucket", [None, 200])
def test_a_scenario_has_as_many_points_as_events(spark, events, rows_per_bucket):
    spec = spark.createDataFrame([("value", 120.0, None)], "column string, usl double, lsl double")
    control = spark.createDataFrame([("user_id", 9.0, 2.0), ("absent", 1.0, 0.0)], "column string, ucl double, lcl double")
    templates = spark.createDataFrame([("drift", "value", 50.0, 80.0), ("open", "value", 50.0, None)], "name string, column string, target double, tolerance double")
    points = an.scenario_points(events, ["event_id"], ORDER, ["value", "user_id"], spec, control, templates, KEYS, rows_per_bucket=rows_per_bucket).cache()
    got = {(r.scenario, r.event_type): r["count"] for r in points.groupBy("scenario", "event_type").count().collect()}
    want = {}

    def add(table, name):
        for r in table.collect():
            n = r.run_length if "run_length" in table.columns else r.n_events
            if n:
                want[name(r), r.event_type] = n

    add(an.threshold_events(events, spec, "spec", by=KEYS), lambda r: f"spec:{r.column}:{r.side}")
    add(an.threshold_events(events, control, "control", "ucl", "lcl", KEYS), lambda r: f"control:{r.column}:{r.side}")
    add(an.auto_control_events(events, ["value"], KEYS), lambda r: f"auto:{r.column}:{r.side}")
    add(an.deviation_events(events, templates, KEYS), lambda r: f"engineering:{r.name}")
    for c in ("value", "user_id"):
        rows = events.select(*KEYS, *ORDER, F.col(c).cast("double").alias("x")).where("x is not null")
        add(an.longest_rise(OrderedScan(rows, KEYS, ORDER)), lambda r, c=c: f"rise:{c}")
    assert got == want and {s.split(":")[0] for s, _ in got} >= {"spec", "control", "engineering", "rise"}
    # a run is rising, without gaps
    run = points.where("scenario = 'rise:value'").join(events.select("event_id", "ts"), "event_id").orderBy(*KEYS, *ORDER).collect()
    for a, b in zip(run, run[1:]):
        assert a.event_type != b.event_type or a.value < b.value
    points.unpersist()


def test_no_scenario_is_an_error(spark, events):
    with pytest.raises(ValueError, match="no scenario"):
        an.scenario_points(events, ["event_id"], ORDER, [])
