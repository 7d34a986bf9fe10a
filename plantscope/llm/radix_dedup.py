"""Exact dedup by distributed MSD radix partitioning: equality is decided on the bytes, without a digest.

Documents are split by successive runs of bytes (the digits), most significant first. A group is the
documents that agree so far. Groups of one leave at once; groups whose bytes have ended are classes of
equal texts; the rest are split again by the next, four times longer digit. After the first digit the
text of few documents is still needed, and after each digit fewer, so about one exchange of the text is
paid, then a shrinking remainder. The number of rounds is the logarithm of the longest text.

A group is never gathered: its size is a partially aggregated count, and rows meet their group in an
equality join, whose hot keys adaptive execution splits. Each round's rows are a table in the shared
folder.

Defined results: a null text is an empty text; documents with a null id take part (a null id is the
smallest); of rows that repeat id and text one stays; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.llm.common import shared_table

FIRST_DIGIT = 64  # bytes
GROWTH = 4


def _digit(data: Column, width: int) -> Column:
    return F.substring(data, 1, width)


def _rest(data: Column, width: int) -> Column:
    return F.substring(data, width + 1, 2**31 - 1)


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The groups of two rows or more, each with a number that no other group of the table has."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared_table(found.select(*keys, F.monotonically_increasing_id().alias("group2")), "radix-groups")


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, keep_id (largest id of its class), group_size, kept, text_sha256."""
    width = FIRST_DIGIT
    base = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("rest"))
    base = base.withColumn("digit", _digit(F.col("rest"), width))
    shared = F.col("group2").isNotNull()
    rows = shared_table(
        base.join(_groups(base, ["digit"]).hint("shuffle_hash"), "digit", "left").select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.sha2("rest", 256).alias("text_sha256"),
            F.col("group2").alias("group"),
            (shared & (F.length("digit") < width)).alias("ended"),
            F.when(shared & (F.length("digit") == width), _rest(F.col("rest"), width)).alias("rest"),
        ),
        "radix-rows",
    )
    step, active, classes = 0, rows.where("group is not null"), []
    while True:
        classes.append(active.where("ended").select("row", "id", F.lit(step).alias("step"), "group"))
        active = active.where("not ended")
        if active.isEmpty():
            break
        step, width = step + 1, width * GROWTH
        split = active.select("row", "id", "group", "rest", _digit(F.col("rest"), width).alias("digit"))
        met = split.join(_groups(split, ["group", "digit"]).hint("shuffle_hash"), ["group", "digit"])
        active = shared_table(
            met.select(
                "row",
                "id",
                F.col("group2").alias("group"),
                (F.length("digit") < width).alias("ended"),
                F.when(F.length("digit") == width, _rest(F.col("rest"), width)).alias("rest"),
            ),
            "radix-rows",
        )
    members = reduce(DataFrame.unionByName, classes)
    sizes = members.groupBy("step", "group").agg(
        F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    found = members.join(sizes, ["step", "group"]).select("row", "keep", "group_size")
    return rows.select("row", "id", "text_sha256").join(found, "row", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


DIGEST_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
