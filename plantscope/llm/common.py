"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.session import ensure_checkpoint_dir


def shared_table(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    The files survive lost executors and give every later pass the same rows. They lie under the
    application's own folder, so that one delete removes what an application left. ``by`` names a column
    of few values, the last one, whose rows go to folders of their own.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{ensure_checkpoint_dir(spark)}/{app}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete shared tables whose last reader has been written elsewhere."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._shared_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that begin with the stems and that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def prefix_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array, in log2(n) sweeps instead of n growing copies."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def sweep(acc: Column, k: Column) -> Column:
        gap = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: x + F.when(i >= gap, F.get(acc, i - gap)).otherwise(F.lit(0)))

    return F.aggregate(steps, values, sweep)


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def one_row(spark: SparkSession, df: DataFrame):
    """The single row of a global aggregate."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError("a global aggregate must give one row")
    return rows[0]


def small_batches(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of the text or binary column, and a row at least.

    A batch has a fixed number of rows, so long texts would make it large, and several copies of it are
    alive while Python works on one.
    """
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(column)
        wide = pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type)
        ends = np.frombuffer(x.buffers()[1], dtype=np.int64 if wide else np.int32)[x.offset : x.offset + len(x) + 1]
        at = 0
        while at < b.num_rows:
            stop = max(int(np.searchsorted(ends, int(ends[at]) + most, side="right")) - 1, at + 1)
            yield b.slice(at, stop - at)
            at = stop
