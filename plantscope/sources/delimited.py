"""Records of delimited text, cut from any number of byte ranges of a file at once.

A line feed ends a record unless it lies in a quoted cell, which a range cannot see from its own bytes. Each line
is a function from "the line starts inside a quoted cell" (0 or 1) to "the next one does". Such a function keeps
its argument, turns it round or forgets it, so the state in front of any line follows from the last line that
forgets and the number of turns after it: prefix sums inside a range, and a carry of one row a range between them.
No task holds more than a range, except that a record's lines come together in one row.

Every encoding is decoded line by line, as no candidate has the byte of a line end inside another character.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantscope.operators.ordered import join_on

RANGE = ["path", "block"]


def _decoded(line: Column, encoding: str) -> Column:
    """Text of a raw line; plain ASCII and UTF-8 stay in the JVM."""
    if encoding == "utf-8":
        return line
    if encoding == "latin-1":
        return F.decode(line.cast("binary"), "ISO-8859-1")

    @F.pandas_udf(T.StringType())
    def decode(lines: pd.Series) -> pd.Series:
        return lines.map(lambda data: bytes(data).decode(encoding))

    return decode(line.cast("binary"))


def lines_of(spark: SparkSession, files: str | Sequence[str], encoding: str) -> DataFrame:
    """(path, block, id, line): ``block`` is where the line's byte range starts, ``id`` grows along it."""
    raw = spark.read.text(files if isinstance(files, str) else list(files))
    placed = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
    )
    return placed.withColumn("line", _decoded(F.col("line"), encoding))


def _ends_inside(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether the line ends inside a quoted cell, when it starts outside and when it starts inside one.

    The loops are possessive, so they neither go back nor grow the stack, however long the line.
    """
    other = "[^" + re.escape(sep).replace("^", r"\^") + "]"
    quoted = '[^"]*+(?:""[^"]*+)*+'
    cell = f'(?:"{quoted}"{other}*+|(?!"){other}++)?+'
    opened = f'(?:{cell}{re.escape(sep)})*+"{quoted}\\z'
    marked = line.contains('"')
    outside = marked & line.rlike(f"\\A{opened}")
    inside = ~marked | line.rlike(f'\\A{quoted}(?:\\z|"{other}*+{re.escape(sep)}{opened})')
    return outside, inside


def open_files(lines: DataFrame, sep: str) -> DataFrame:
    """(path, open): whether a quoted cell of the file goes on in another line."""
    return lines.groupBy("path").agg(F.bool_or(_ends_inside(F.col("line"), sep)[0]).alias("open"))


def _after(start: Column | int) -> Column:
    """State of a row with ``_turns`` and ``_last`` (the last line that forgets) behind it, from a range's start state."""
    kept = F.coalesce(F.col("_last.value") + F.col("_turns") - F.col("_last.turns"), F.lit(start) + F.col("_turns"))
    return F.pmod(kept, F.lit(2))


def _steps(df: DataFrame, first: Column, second: Column, keys: Sequence[str], order: str) -> DataFrame:
    """Turns and last forgetting row in front of each row, of rows that are functions (first: of 0, second: of 1)."""
    upto = Window.partitionBy(*keys).orderBy(order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    forgets = first == second
    turn = F.when(~forgets & (first == 1), 1).otherwise(0)
    turns = F.sum(turn).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    counted = df.withColumn("_upto", turns).withColumn("_forgets", F.when(forgets, F.struct(first.alias("value"), F.col("_upto").alias("turns"))))
    return counted.withColumns(
        {"_turns": F.coalesce(F.lag("_upto").over(upto), F.lit(0)), "_last": F.last("_forgets", ignorenulls=True).over(before)}
    )


def records(lines: DataFrame, sep: str) -> DataFrame:
    """(path, block, id, record): place of the record's first line; line ends inside a record become line feeds.

    Empty records are left out. A quoted cell that is never closed takes the rest of its file.
    """
    outside, inside = _ends_inside(F.col("line"), sep)
    marked = lines.withColumns({"_f0": outside.cast("int"), "_f1": inside.cast("int")})
    stepped = _steps(marked, F.col("_f0"), F.col("_f1"), RANGE, "id")

    # a row a range: its function, and where its last record starts, for both states that it may start in
    both = stepped.withColumns({"_at0": _after(0), "_at1": _after(1)})
    ends = lambda at: F.max_by(F.when(F.col(at) == 1, F.col("_f1")).otherwise(F.col("_f0")), "id")
    ranges = both.groupBy(*RANGE).agg(
        ends("_at0").alias("_r0"), ends("_at1").alias("_r1"),
        F.max(F.when(F.col("_at0") == 0, F.col("id"))).alias("_s0"), F.max(F.when(F.col("_at1") == 0, F.col("id"))).alias("_s1"),
    )
    carried = _steps(ranges, F.col("_r0"), F.col("_r1"), ["path"], "block").withColumn("_start", _after(0))
    own = F.when(F.col("_start") == 1, F.col("_s1")).otherwise(F.col("_s0"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(own.isNotNull(), F.struct("block", own.alias("id"))), ignorenulls=True).over(earlier)
    carry = carried.select(*RANGE, "_start", begun.alias("_begun"))

    # both sides lie by range already
    placed = join_on(stepped, carry, RANGE).withColumn("_at", _after(F.col("_start")))
    upto = Window.partitionBy(*RANGE).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(F.col("_at") == 0, F.struct("block", "id")), ignorenulls=True).over(upto)
    ended = F.when(F.col("_at") == 1, F.col("_f1")).otherwise(F.col("_f0"))
    keyed = placed.select("path", "block", "id", "line", "_at", ended.alias("_ends"), F.coalesce(first, "_begun").alias("_first"))
    single = keyed.where("_at = 0 and _ends = 0 and line != ''").select("path", "block", "id", F.col("line").alias("record"))
    part = F.sort_array(F.collect_list(F.struct("block", "id", "line")))
    joined = keyed.where("_at = 1 or _ends = 1").groupBy("path", "_first").agg(F.array_join(F.transform(part, lambda p: p["line"]), "\n").alias("record"))
    return single.unionByName(joined.select("path", "_first.block", "_first.id", "record"))


def cells(found: DataFrame, names: Sequence[str], extra: str, sep: str) -> DataFrame:
    """The cells of records without each file's header; ``extra`` holds a cell beyond the last name."""
    heads = found.groupBy("path").agg(F.min(F.struct("block", "id")).alias("_head"))
    body = join_on(found, heads, ["path"]).where(F.struct("block", "id") != F.col("_head"))
    schema = ", ".join(f"`c{i}` string" for i in range(len(names) + 1))
    parsed = F.from_csv("record", schema, {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    row = body.select(parsed.alias("_row"))
    return row.select(*[F.col(f"_row.c{i}").alias(n) for i, n in enumerate([*names, extra])])
