"""Reading and writing tables: delimited text, typed columns, Parquet, inline rows, snapshots."""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantscope.session import ensure_checkpoint_dir
from plantscope.sources import delimited

# fixed values: delimiters tried, in order of preference; encodings tried, in order
DELIMITERS = (",", ";", "\t", "|")
ENCODINGS = ("utf-8", "big5", "cp950", "gb18030", "shift_jis", "latin-1")
# fixed values: canonical metadata columns
METADATA_COLUMNS = (
    "measurement_id", "product_id", "lot_id", "machine_id", "station_id",
    "process_step", "timestamp", "subgroup_id", "metric", "unit",
)
NUMERIC_SHARE = 0.9
WHOLE_BELOW = 1 << 28  # larger files are hashed in ranges
READER_ENCODINGS = ("utf-8", "latin-1")
FORMATS = ("csv", "parquet", "xls", "xlsx")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint area, under the application's own."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Most frequent candidate in the first line; a comma when none occurs."""
    first = spark.read.text(path).limit(1).select(
        *[(F.length("value") - F.length(F.replace("value", F.lit(c), F.lit("")))).alias(f"n{i}") for i, c in enumerate(DELIMITERS)]
    ).first()
    if first is None or max(first) == 0:
        return DELIMITERS[0]
    return DELIMITERS[list(first).index(max(first))]


@F.pandas_udf(T.LongType())
def _decoding_set(lines: pd.Series) -> pd.Series:
    """One bit per candidate encoding that decodes the line."""

    def bits(data: bytes) -> int:
        out = 0
        for i, name in enumerate(ENCODINGS):
            try:
                codecs.decode(bytes(data), name)
                out |= 1 << i
            except UnicodeDecodeError:
                pass
        return out

    return lines.map(bits)


def detect_encoding(spark: SparkSession, path: str) -> DataFrame:
    """First candidate encoding that decodes the whole file, per file.

    Files are read line by line and so may be of any size: in none of the candidates is the byte of a
    line feed part of another character. The last candidate decodes everything.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("_line"))
    # most lines are plain ASCII, which all candidates decode alike
    plain = ~F.col("_line").cast("string").rlike("[^\\x00-\\x7F]")
    sets = lines.where(~plain).withColumn("_set", _decoding_set("_line")).groupBy("path").agg(F.bit_and("_set").alias("_set"))
    every = lines.select("path").distinct()
    first = F.lit(None).cast("string")
    for i in reversed(range(len(ENCODINGS))):
        first = F.when(F.coalesce(F.col("_set"), F.lit(-1)).bitwiseAND(F.lit(1 << i)) != 0, F.lit(ENCODINGS[i])).otherwise(first)
    return every.join(sets, "path", "left").select("path", first.alias("encoding"))


def _read_files(spark: SparkSession, files: list[str], sep: str | None, encoding: str, multi_line: bool | None) -> DataFrame:
    sep = sep or detect_delimiter(spark, files[0])
    reader = {
        "header": True, "sep": sep, "inferSchema": False, "quote": '"', "escape": '"', "encoding": "iso-8859-1" if encoding == "latin-1" else encoding,
    }
    extra = "__extra"
    in_reader = encoding in READER_ENCODINGS
    if in_reader:
        # of one record of one file, line feeds in its quotes included
        names = spark.read.options(**reader, multiLine=True).csv(files[0]).columns
    else:
        top = delimited.records(delimited.lines_of(spark, files[0], encoding), sep).orderBy("block", "id").limit(1).first()
        names = next(csv.reader(io.StringIO(top["record"]), delimiter=sep))
    parts: dict[bool, list[str]] = {}
    if in_reader and multi_line is not None:
        parts[False] = files
    else:
        found = delimited.open_files(delimited.lines_of(spark, files, encoding), sep)
        for r in found.collect():  # one row a file
            parts.setdefault(r["open"] or not in_reader, []).append(unquote(r["path"]))
    out = []
    for by_line, some in sorted(parts.items()):
        if by_line:
            out.append(delimited.cells(delimited.records(delimited.lines_of(spark, some, encoding), sep), names, extra, sep))
        else:
            schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, extra]])
            out.append(spark.read.options(**reader, multiLine=bool(multi_line), enforceSchema=True, columnPruning=False).schema(schema).csv(some))
    cells = reduce(DataFrame.unionByName, out)
    # text files hold no nulls: the reader's null is an empty cell
    too_long = F.raise_error(F.lit("a row has more cells than the header")).cast("string")
    # in every column, so that the check holds whichever columns are used
    return cells.select(*[F.when(F.col(extra).isNull(), F.coalesce(F.col(c), F.lit(""))).otherwise(too_long).alias(c) for c in names])


def read_csv(
    spark: SparkSession, path: str | Sequence[str], sep: str | None = None, encoding: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Header row, every cell as text, empty cells kept as empty text.

    Quoted cells may hold delimiters, doubled quotes and line feeds. Files are read in ranges whatever their
    cells hold: one pass finds the files with line feeds in quotes, whose records are then cut by
    ``delimited.records``. ``multi_line=False`` says that there are none and saves that pass; ``True`` leaves
    such files to Spark's reader, a file in one task. Line ends inside a cell become line feeds. Rows shorter
    than the header are padded with empty text; a filled cell beyond it is an error. Without ``encoding``
    each file is read in its own.
    """
    found: dict[str, list[str]] = {}
    if encoding is None:
        for r in detect_encoding(spark, path).collect():  # one row a file
            found.setdefault(r["encoding"], []).append(unquote(r["path"]))
    else:
        found[encoding] = [path] if isinstance(path, str) else list(path)
    parts = [_read_files(spark, sorted(files), sep, name, multi_line) for name, files in sorted(found.items())]
    if not parts:
        raise ValueError(f"no header line in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def blank_to_null(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text != "", text)


def normalize_types(df: DataFrame, threshold: float = NUMERIC_SHARE) -> DataFrame:
    """Blank cells become null; a text column turns double when enough populated cells parse."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    cleaned = df.withColumns({c: blank_to_null(F.col(c)) for c in text})
    # one pass over all columns; the result is one row whose width is the number of columns
    shares = cleaned.agg(
        *[F.try_divide(F.count(F.col(c).try_cast("double")), F.count(c)).alias(c) for c in text]
    ).first()
    numeric = [c for c in text if shares[c] is not None and shares[c] >= threshold]
    return cleaned.withColumns({c: F.col(c).try_cast("double") for c in numeric}) if numeric else cleaned


def preview(df: DataFrame, order_by: Sequence[str], n: int = 50) -> DataFrame:
    """First rows as text, blank cells as null."""
    top = df.orderBy(*order_by).limit(n)
    return top.select(*[blank_to_null(F.col(c).cast("string")).alias(c) for c in df.columns])


def series(df: DataFrame, column: str, order_by: Sequence[str], where: Column | None = None) -> DataFrame:
    """One column's values with its order; nulls kept; numbers as double, the rest as text."""
    rows = df if where is None else df.where(where)
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    return rows.select(*order_by, F.col(column).cast("double" if numeric else "string").alias("value"))


def from_rows(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[object]]) -> DataFrame:
    """Inline rows as text columns; short rows are padded with null, longer ones are an error."""
    if any(len(r) > len(columns) for r in rows):
        raise ValueError("a row has more cells than the header")
    padded = [
        tuple(None if v is None else str(v) for v in (list(r) + [None] * len(columns))[: len(columns)]) for r in rows
    ]
    return spark.createDataFrame(padded, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet, optionally partitioned by grain fields so that later reads prune."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


# -- files ---------------------------------------------------------------------


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive listing of data files, by suffix in any case; the content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.lower(F.element_at(F.split("path", "\\."), -1)).alias("format"),
    ).where(F.col("format").isin(*FORMATS))


def file_checksums(spark: SparkSession, path: str, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """SHA-256 per file. Files of ``whole_below`` bytes and more are read in ranges and need no more memory.

    The digest of a large file runs over its lines in order, in one task a file, as SHA-256 is sequential;
    only a single line must fit in a task. Empty files have no row, as Spark's readers pass over them.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    small = files.where(F.col("length") < whole_below).select(name, F.sha2("content", 256).alias("sha256"))
    large = [r["path"] for r in files.where(F.col("length") >= whole_below).select("path").collect()]  # one row a file
    if not large:
        return small
    raw = spark.read.option("lineSep", "\n").text(large)
    name_of_url = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # a plus stays one
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
        name_of_url.alias("name"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"),
    )
    ordered = lines.repartition("path").sortWithinPartitions("path", "block", "id").select("path", "name", "size", "line")
    digests = ordered.mapInArrow(_running_digests, "name string, sha256 string")
    return small.unionByName(digests.select("name", "sha256"))


def _running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, sha256) of the lines (path, name, size, line) of files in order; the size tells whether the last line is ended."""
    at, called, digest, left = None, None, None, 0

    def closed() -> pa.RecordBatch:
        if left == 1:
            digest.update(b"\n")
        return pa.RecordBatch.from_pydict({"name": [called], "sha256": [digest.hexdigest()]})

    for batch in batches:
        for path, name, size, line in zip(*(c.to_pylist() for c in batch.columns)):
            if path != at:
                if at is not None:
                    yield closed()
                at, called, digest, left = path, name, hashlib.sha256(), size
            else:
                digest.update(b"\n")
                left -= 1
            digest.update(line)
            left -= len(line)
    if at is not None:
        yield closed()


# -- snapshots -----------------------------------------------------------------


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint of a table: one row, one distributed pass."""
    h = F.xxhash64(*df.columns)
    return df.select(h.alias("_h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )


def save_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write the table and return the fingerprint of what was written."""
    write_parquet(df, path, partition_by)
    return _digest(df.sparkSession.read.parquet(path), df.columns)


def load_snapshot(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """Read a snapshot and fail when it is not the table that was saved."""
    df = spark.read.parquet(path)
    actual = _digest(df, df.columns)
    if actual != expected:
        raise ValueError(f"snapshot at {path} changed: {actual} is not {expected}")
    return df


def _digest(df: DataFrame, columns: Sequence[str]) -> str:
    row = fingerprint(df.select(*sorted(columns))).first()
    return f"{row.n_rows}:{row.hash_xor}:{row.hash_sum}"
