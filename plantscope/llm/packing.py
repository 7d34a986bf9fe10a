"""Packing by non-negative least squares: shallow length combinations, repeat counts, greedy rest.

A document is its ids and one end id. Whole windows of it fill sequences of their own; what remains is a
piece shorter than the window. Combinations of two or three lengths that fill the window exactly are
enumerated, their repeat counts are solved against the histogram of piece lengths by non-negative least
squares, rounded, and the pieces left over are packed greedily (``patterns``). The histogram has one
count a length, so the problem on the driver has the same size for any corpus.

Which sequence a piece gets follows from its rank among the pieces of its length. Ranks come from counts
by (length, lane), where lanes hash the id, so a length that a third of all documents have is many tasks.
Documents are encoded once, into the shared folder, and exchanged once.

Defined results: a null text is an empty text and gives its end id; rows that repeat an id are packed one
by one, and pieces of equal rows are alike, so it does not matter which is which; extra columns are
ignored; an empty table gives no pieces. Only the last left-over sequence can need padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantscope.llm import patterns
from plantscope.llm.common import one_row, shared_table
from plantscope.llm.tokens import default_path, load

WINDOW = 1024
END = 0
LANE_ROWS = 20_000

PIECES = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenised(docs: DataFrame, path: str, id_col: str, text: str, end: int = END) -> DataFrame:
    """(id, n, ids, crc) of every row; ids are 16-bit where the vocabulary allows it, to move less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        kind = "<u2" if len(bpe.pieces) <= 1 << 16 else "<u4"
        for b in batches:
            rows = [np.append(bpe.encode(t), np.uint32(end)).astype(kind) for t in b.column(1).to_pylist()]
            packed = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array(packed, pa.binary()),
                    pa.array([zlib.crc32(p) for p in packed], pa.int64()),
                ],
                names=["id", "n", "ids", "crc"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInArrow(run, "id long, n long, ids binary, crc long")


def pack(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    depth: int = patterns.DEPTH,
) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 32 bits)."""
    path = path or default_path()
    rest = (F.col("n") % window).cast("int").alias("rest")
    rows = shared_table(tokenised(docs, path, id_col, text).select("*", rest), "packing-ids")
    size = one_row(rows.sparkSession, rows.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("longest")))
    lanes = max(1, -(-size["rows"] // LANE_ROWS))
    whole = (size["longest"] or 0) // window  # whole windows of a document, at most
    lane = F.pmod(F.xxhash64("id", "crc"), F.lit(lanes)).cast("int").alias("lane")
    counts = rows.groupBy("rest", lane).agg(F.count(F.lit(1)).alias("c"))
    histogram = np.zeros(window, dtype=np.int64)
    for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect():  # at most ``window`` rows
        histogram[r["rest"]] = r["c"]
    made = patterns.plan(histogram, window, depth)
    first = np.cumsum(histogram) - histogram  # documents of shorter pieces
    base = made.sequences + -(-made.left_over // window)

    before = Window.partitionBy("rest").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("rest", "lane", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    in_lane = Window.partitionBy("rest", "lane").orderBy("id", "n", "crc")
    ranked = rows.select("*", lane).withColumn("rank", F.row_number().over(in_lane).cast("long") - 1)
    ranked = ranked.join(starts, ["rest", "lane"]).select("id", "n", "rest", (F.col("rank") + F.col("start")).alias("rank"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if len(load(path).pieces) <= 1 << 16 else "<u4"
        for b in batches:
            out: list[tuple] = []
            held = 0
            for i, n, r, rank, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(packed, dtype=kind).astype("<u4")
                number = base + (int(first[r]) + rank) * whole
                for k in range(n // window):
                    out.append((i, k * window, window, n, number + k, 0, ids[k * window : (k + 1) * window].tobytes()))
                for start, length, sequence, offset in patterns.place(made, r, rank) if r else []:
                    at = n - r + start
                    out.append((i, at, length, n, sequence, offset, ids[at : at + length].tobytes()))
                held += len(packed)
                if held > 8 << 20:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return ranked.mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(docs, path).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
