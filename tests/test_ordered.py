"""Split scans must equal the plain window, also with one hot series."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantscope.operators.ordered import EDGE, OrderedScan, islands


def hot(events):
    """A third of the rows and more in one series, some series tiny, one null key."""
    kind = (
        F.when(F.col("event_id") % 3 != 0, "hot")
        .when(F.col("event_id") % 100 == 0, None)
        .otherwise(F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string")))
    )
    return events.withColumn("kind", kind).select("kind", "ts", "event_id", "value")


def frame(df, sort):
    return df.toPandas().sort_values(sort).reset_index(drop=True)


@pytest.mark.parametrize("size", [20, 10_000])
@pytest.mark.parametrize("series", [["kind"], []])
def test_running_and_previous(events, size, series):
    df = hot(events)
    scan = OrderedScan(df, series, ["ts", "event_id"], rows_per_bucket=size)
    assert scan.is_split == (size < 1000)
    got = (
        scan.row_number()
        .running(
            {
                "s": ("sum", F.col("value")),
                "lo": ("min", F.col("value")),
                "hi": ("max", F.col("value")),
                "seen": ("last", F.when(F.col("value") > 60, F.col("value"))),
            }
        )
        .previous({"prev": "value"})
        .rows()
    )
    w = Window.partitionBy(*(series or [F.lit(0)])).orderBy("ts", "event_id")
    r = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*",
        F.row_number().over(w).alias("rn"),
        F.sum("value").over(r).alias("s"),
        F.min("value").over(r).alias("lo"),
        F.max("value").over(r).alias("hi"),
        F.last(F.when(F.col("value") > 60, F.col("value")), ignorenulls=True).over(r).alias("seen"),
        F.lag("value").over(w).alias("prev"),
    )
    pd.testing.assert_frame_equal(frame(got, "event_id"), frame(want, "event_id"), check_dtype=False, rtol=1e-12)


@pytest.mark.parametrize("size", [20])
@pytest.mark.parametrize("series", [["kind"], []])
def test_bounded_lookback(events, size, series):
    df = hot(events)

    def build(d, w):
        return d.withColumns(
            {
                "m": F.avg("value").over(w.rowsBetween(-9, 0)),
                "l": F.lag("value", 10).over(w),
                "n": F.count(F.lit(1)).over(w.rowsBetween(-10, -1)),
            }
        )

    got = OrderedScan(df, series, ["ts", "event_id"], rows_per_bucket=size).bounded(build, 10).rows()
    want = build(df, Window.partitionBy(*(series or [F.lit(0)])).orderBy("ts", "event_id"))
    pd.testing.assert_frame_equal(frame(got, "event_id"), frame(want, "event_id"), check_dtype=False, rtol=1e-12)


@pytest.mark.parametrize("size", [6, 10_000])
def test_islands(events, size):
    df = hot(events)
    scan = OrderedScan(df, ["kind"], ["ts", "event_id"], rows_per_bucket=size)
    got = frame(islands(scan, F.col("value") < 90).rows(), "event_id")
    pdf = frame(df, ["kind", "ts", "event_id"])
    want = {}
    for _, g in pdf.groupby("kind", dropna=False, sort=False):
        run = pos = 0
        for row in g.itertuples():
            if row.value < 90:
                run, pos = (run + 1, 1) if pos == 0 else (run, pos + 1)
                want[row.event_id] = (run, pos)
            else:
                pos = 0
                want[row.event_id] = None
    for row in got.itertuples():
        w = want[row.event_id]
        if w is None:
            assert pd.isna(row.run_id)
        else:
            assert (row.run_id, row.run_pos) == w


def test_hot_series_is_spread(events):
    scan = OrderedScan(hot(events), ["kind"], ["ts", "event_id"], rows_per_bucket=50)
    sizes = scan.df.groupBy("kind", "_bucket").count().toPandas()
    assert sizes["count"].max() < 300
    assert (sizes.kind == "hot").sum() > 5


def test_carry_is_bounded_by_splitters(events):
    scan = OrderedScan(hot(events), ["kind"], ["ts", "event_id"], rows_per_bucket=50)
    cut = scan.df.where(F.col(EDGE) != 0).select("kind", "_bucket").distinct().count()
    assert cut <= 2 * scan.n_splitters


def test_attach_many_series_takes_the_bucket_join(events, monkeypatch):
    import plantscope.operators.ordered as o

    df = hot(events)
    stats = df.groupBy("kind").agg(F.avg("value").alias("m"))
    wide = OrderedScan(df, ["kind"], ["ts", "event_id"], rows_per_bucket=50)
    a = frame(wide.attach(stats).rows(), "event_id")
    monkeypatch.setattr(o, "BROADCAST_SERIES", 0)
    b = frame(wide.attach(stats).rows(), "event_id")
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_order_is_required(events):
    with pytest.raises(ValueError):
        OrderedScan(events, [], [])
    with pytest.raises(ValueError):
        OrderedScan(events, ["nope"], ["ts"])


def test_awkward_text_keys(spark):
    names = ["", None, "a'b", "a\\b", "ü", " ", "x\u0001y"]
    df = spark.range(700).select(
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % 7 + 1).cast("int")).alias("k"), (F.col("id") * 37 % 700).alias("i"), F.col("id").cast("double").alias("v")
    )
    scan = OrderedScan(df, ["k"], ["i"], rows_per_bucket=20)
    assert scan.is_split
    got = scan.running({"s": ("sum", F.col("v"))}).previous({"p": "v"}).rows()
    w = Window.partitionBy("k").orderBy("i")
    want = df.select("*", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(w).alias("p"))
    pd.testing.assert_frame_equal(frame(got, "v"), frame(want, "v"))
