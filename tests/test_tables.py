"""Sources, quantiles, distributions, quality, roles, time series and de-identification on small fixtures."""

import hashlib
import hmac

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantscope.operators import deidentify as de
from plantscope.operators import distributions as di
from plantscope.operators import frames as fr
from plantscope.operators import gauge, quality, risk, roles, routes
from plantscope.operators import stats as st
from plantscope.operators import timeseries as ts
from plantscope.sources import tables as src


# -- sources -------------------------------------------------------------------------


def test_inline_rows_are_padded(spark):
    rows = src.from_rows(spark, ["a", "b"], [["1", "2"], ["3"], [None, 4]]).collect()
    assert [tuple(r) for r in rows] == [("1", "2"), ("3", None), (None, "4")]


@pytest.mark.parametrize("line,want", [("a;b;c,d", ";"), ("a|b|c", "|"), ("a\tb", "\t"), ("abc", ",")])
def test_delimiter(spark, tmp_path, line, want):
    path = tmp_path / "x.csv"
    path.write_text(line + "\n1;2\n")
    assert src.detect_delimiter(spark, str(path)) == want


def test_encoding_per_file(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("溫度,值\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("溫度,值\n".encode("big5"))
    (tmp_path / "l.csv").write_bytes(b"caf\xe9 \xff\xfe\xa0\xff")
    got = {r.path[-5:]: r.encoding for r in src.detect_encoding(spark, str(tmp_path)).collect()}
    assert got == {"u.csv": "utf-8", "b.csv": "big5", "l.csv": "latin-1"}


def test_csv_as_users_write_it(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1,"x\ny"\n2,"say ""hi"""\n3\n4,"p,q"\n')
    rows = src.read_csv(spark, str(path)).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", "x\ny"), ("2", 'say "hi"'), ("3", ""), ("4", "p,q")]
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more cells"):
        src.read_csv(spark, str(path)).collect()
    with pytest.raises(Exception, match="more cells"):
        src.read_csv(spark, str(path)).select("b").collect()
    with pytest.raises(ValueError, match="more cells"):
        src.from_rows(spark, ["a"], [[1, 2]])


def test_csv_files_are_read_in_their_own_encoding(spark, tmp_path):
    late = "名稱,值\n" + "a,1\n" * 40_000 + "溫度,2\n"
    (tmp_path / "u.csv").write_bytes(late.encode("utf-8"))
    (tmp_path / "b c.csv").write_bytes(late.encode("big5"))
    got = src.read_csv(spark, str(tmp_path)).where(F.col("值") == "2").collect()
    assert [r["名稱"] for r in got] == ["溫度", "溫度"]


def test_file_suffixes_in_any_case(spark, tmp_path):
    for name in ("a.CSV", "b.Parquet", "c.txt", "d.XLSX", "e.csv"):
        (tmp_path / name).write_text("x")
    got = {r.name: r.format for r in src.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.CSV": "csv", "b.Parquet": "parquet", "d.XLSX": "xlsx", "e.csv": "csv"}


def test_types_follow_the_share_of_numbers(spark):
    df = spark.createDataFrame([(str(i), "x" if i < 2 else " 1.5 ", "") for i in range(10)], "a string, b string, c string")
    out = src.normalize_types(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert out.where(F.col("c").isNull()).count() == 10


def test_snapshot_detects_change(spark, events):
    path = src.scratch_path(spark, "snap")
    mark = src.save_snapshot(events.select("event_id", "value"), path)
    assert src.load_snapshot(spark, path, mark).count() == events.count()
    with pytest.raises(ValueError):
        src.load_snapshot(spark, path, mark + "0")
    a, b = (src.fingerprint(events.repartition(n)).first() for n in (2, 7))
    assert a == b


# -- filters and designs ----------------------------------------------------------------


def test_filters_refuse_bad_requests(events):
    for args in (("nope", 1), ("event_type", ""), ("event_type", None)):
        with pytest.raises(ValueError):
            fr.row_filter(events, *args)
    with pytest.raises(ValueError):
        fr.row_filter(events, "event_type", "missing", require_rows=True)
    with pytest.raises(ValueError):
        fr.grain_filter(events, [("event_type", "click")])


def test_typed_filter_reaches_the_scan(events, capsys):
    fr.row_filter(events, "user_id", 7).explain()
    assert "EqualTo(user_id,7)" in capsys.readouterr().out


def test_design_cells(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "f string, g int")
    assert [tuple(r) for r in fr.missing_cells(df, ["f", "g"]).collect()] == [("b", 2)]
    row = fr.design_coverage(df, ["f", "g"]).first()
    assert (row.n_missing, row.n_duplicate, row.status) == (1, 1, "warning")
    with pytest.raises(ValueError):
        fr.factor_levels(df, ["g"], limit=1)


def test_gauge_refuses_unbalanced(spark):
    df = spark.createDataFrame([("p", "o", 1.0), ("p", "o", 2.0), ("q", "o", 1.0)], "part string, op string, m double")
    with pytest.raises(ValueError):
        gauge.gauge_rr(df, "m", "part", "op")


# -- quantiles and distributions -----------------------------------------------------------


def test_ranked_quantiles_equal_percentile(events):
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.75, "e": 0.999, "f": 1.0}
    one = st.quantiles(events, ["event_type"], "value", probs).toPandas().sort_values("event_type")
    two = st.quantiles(events, ["event_type"], "value", probs, rows_limit=0, rows_per_bucket=60).toPandas().sort_values("event_type")
    pd.testing.assert_frame_equal(one.reset_index(drop=True), two.reset_index(drop=True), rtol=1e-12)


def test_salted_stats_join(events, monkeypatch):
    stats = events.groupBy("event_type").agg(F.avg("value").alias("m"))
    monkeypatch.setattr(st, "BROADCAST_SERIES", 0)
    out = st.attach_stats(events, stats, ["event_type"])
    assert out.count() == events.count()
    assert out.groupBy("event_type").agg(F.avg("value").alias("v"), F.max("m").alias("m")).where("abs(v - m) > 1e-9").count() == 0


def test_parameters_are_recovered(spark):
    rng = np.random.default_rng(7)
    rows = [("w", float(v)) for v in 3 * rng.weibull(1.7, 3000)] + [("g", float(v)) for v in rng.gamma(2.5, 4.0, 3000)]
    df = spark.createDataFrame(rows, "kind string, v double")
    fits = {(r.kind, r.family): r.params for r in di.fit_table(df, "v", ["kind"], ["weibull", "gamma"]).collect()}
    assert fits["w", "weibull"]["shape"] == pytest.approx(1.7, rel=0.05)
    assert fits["w", "weibull"]["scale"] == pytest.approx(3.0, rel=0.05)
    assert fits["g", "gamma"]["shape"] == pytest.approx(2.5, rel=0.1)
    # first-order condition of the Weibull likelihood
    x = np.array([v for k, v in rows if k == "w"])
    k = fits["w", "weibull"]["shape"]
    assert (x**k * np.log(x)).sum() / (x**k).sum() - 1 / k - np.log(x).mean() == pytest.approx(0.0, abs=1e-9)


def test_ks_and_density(spark, events):
    fits = di.fit_table(events, "value", [], ["uniform"])
    x = np.sort(np.array([r[0] for r in events.select("value").collect()]))
    cdf, n = (x - x.min()) / (x.max() - x.min()), len(x)
    want = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
    assert di.ks_statistic(events, "value", fits, rows_per_bucket=90).first().ks_statistic == pytest.approx(want)
    curve = di.density_curve(di.fit_table(events, "value", [], ["normal"])).toPandas().sort_values("x")
    assert len(curve) == 160 and 0.8 < np.trapezoid(curve.density, curve.x) < 1.01


def test_key_names_must_not_clash(spark):
    with pytest.raises(ValueError):
        di.fit_table(spark.createDataFrame([("a", 1.0)], "family string, v double"), "v", ["family"])


def test_small_samples_are_empirical_only(spark):
    df = spark.createDataFrame([(float(i),) for i in range(6)], "v double")
    assert [r.family for r in di.fit_distributions(df, "v").collect()] == ["empirical"]


# -- quality and roles -----------------------------------------------------------------------


def test_time_disorder_counts_steps_back(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([1, 3, 2, 4, 4, 0])], "i int, t int")
    assert quality.time_disorder(df, "t", ["i"], rows_per_bucket=2).first().n == 2


def test_outcome_and_format_checks(spark):
    df = spark.createDataFrame([("ok", "1.5"), ("OK", "2"), ("pass", "x1"), ("PASS", "3,000"), ("NG", None)], "r string, v string")
    row = quality.outcome_imbalance(df, ["r"]).first()
    assert (row.n_ok, row.n_ng) == (4, 1)
    row = quality.mixed_formats(df, ["v"], 2).first()
    assert (row.n_numeric, row.n_other, row.example_1, row.example_2) == (3, 1, "x1", None)


def test_role_names_in_both_languages(spark):
    df = spark.createDataFrame(
        [(i, f"2024-01-{i % 28 + 1:02d}", "OK" if i % 3 else "NG", i * 0.1, f"M{i % 4}") for i in range(40)],
        "`運行序` int, `日期` string, `判定` string, `yield_rate` double, `機台` string",
    )
    got = {r.column: r.role for r in roles.detect_roles(df).collect()}
    assert got == {"運行序": "identifier", "日期": "timestamp", "判定": "quality_label", "yield_rate": "output", "機台": "category"}


# -- time series --------------------------------------------------------------------------------


def test_features_do_not_see_the_future(events):
    args = dict(time="ts", tiebreak=["event_id"], columns=["value"], lags=[1, 3], windows=[4], series_keys=["event_type"], rows_per_bucket=60)
    cut = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    changed = events.withColumn("value", F.when(F.col("ts") >= cut, F.col("value") * 100 + 7).otherwise(F.col("value")))
    a, b = (
        ts.build_features(df, **args).where(F.col("ts") < cut).drop("value").toPandas().sort_values("event_id").reset_index(drop=True)
        for df in (events, changed.repartition(5))
    )
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_mixed_zones_need_a_zone(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01T00:00:00Z",)], "t string")
    with pytest.raises(ValueError):
        ts.require_one_awareness(df, "t", None)
    ts.require_one_awareness(df, "t", "Asia/Taipei")
    hours = [r[0] for r in df.select(F.hour(ts.to_utc(F.col("t"), "Asia/Taipei"))).collect()]
    assert hours == [16, 0]


def test_folds_follow_the_definition(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "i int")
    got = ts.walk_forward_folds(df, "i", [], 10, 4, 3, rows_per_bucket=6).toPandas()
    want = {f: list(range(10 + 3 * f + 1, 10 + 3 * f + 5)) for f in range(4)}
    assert {f: sorted(g.rn) for f, g in got.groupby("fold")} == want


# -- risk, routes, de-identification -------------------------------------------------------------


def test_bootstrap_keeps_rows_whole_and_is_stable(events):
    df = events.select("event_id", "value")
    a, b = (risk.bootstrap_rows(df.repartition(n), ["event_id"], 500, rows_per_bucket=s).toPandas().sort_values("draw").reset_index(drop=True) for n, s in ((2, 70), (5, 10_000)))
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 500 and a.event_id.nunique() > 300


def test_zero_is_a_limit(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,)], "v double")
    assert risk.spec_risk(df, "v", 0.0, None).first().ng_count == 1


def test_cycles(spark):
    line = [(str(i), str(i + 1)) for i in range(12)]
    edges = spark.createDataFrame(line, "from_id string, to_id string")
    assert routes.cyclic_edges(edges).count() == 0
    loop = spark.createDataFrame([*line, ("7", "4")], "from_id string, to_id string")
    assert {tuple(r) for r in routes.cyclic_edges(loop).collect()} == {("4", "5"), ("5", "6"), ("6", "7"), ("7", "4")}


def test_pseudonym_is_hmac(spark):
    key = b"0123456789abcdef"
    df = spark.createDataFrame([("Ann",), ("李",), (None,)], "v string")
    got = [r[0] for r in df.select(de.pseudonym(F.col("v"), key)).collect()]
    want = [hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:32] for v in ("Ann", "李")]
    assert got == [*want, "NULL"]


def test_noise_does_not_depend_on_partitions(events):
    df = events.select("event_id", "value")
    plan = de.Plan(["event_id"], {"value": "noise"}, [], {"value": 2.0})
    a, b = (de.apply_plan(df.repartition(n), plan, b"k", ["event_id"]).toPandas().sort_values("event_id").reset_index(drop=True) for n in (2, 6))
    pd.testing.assert_frame_equal(a, b)
    e = a.value - df.toPandas().sort_values("event_id").value.to_numpy()
    assert abs(e.mean()) < 0.3 and e.std() == pytest.approx(2.0, rel=0.1)
    one, two = (de.plan_fingerprint(df.repartition(n), plan, b"k", ["event_id"]).first() for n in (2, 6))
    assert one == two


def test_plan_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "operator string, serial double, speed double")
    plan = de.make_plan(df, overrides={"operator": "noise"}, noise_ratio=0.1)
    assert plan.masked == {"operator": "hash", "serial": "replace"} and plan.kept == ["speed"]
    assert any("non-numeric" in w for w in plan.warnings)
    with pytest.raises(ValueError):
        de.make_plan(df, overrides={"operator": "shuffle"})
    with pytest.raises(ValueError):
        de.standardized(F.col("speed"), 0.0, 1.0)


def test_row_operators_take_a_stream(spark, events):
    from plantscope.operators import anomalies as an

    limits = spark.createDataFrame([("value", 120.0, None)], "column string, usl double, lsl double")
    path = src.scratch_path(spark, "stream-in")
    events.select("event_id", "value").write.parquet(path)
    stream = spark.readStream.schema("event_id long, value double").parquet(path)
    query = an.event_points(stream, ["event_id"], limits).writeStream.format("memory").queryName("points").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("points").count() == events.where("value > 120").count() > 0
