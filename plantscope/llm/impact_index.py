"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are quantised to integers, floor(64 * x). The index is written once, a row for each block of
vectors. It holds posting segments: a segment has one dimension and one impact level (level n: magnitudes
of 2**(n-1) to 2**n - 1), and lists the places in the block with such a component, and their values. Segments
lie in the order in which they are read: by descending level, then by dimension. Queries accumulate one
level after the other; a segment costs its postings, and none is read for a query without that dimension.
After a level the rest of a vector can change a score by at most |query| x |unread components|
(Cauchy-Schwarz, both known to the index), so every score lies in an interval. A query stops when the
vectors that can still reach its k-th best lower bound are few, and these alone are rescored exactly from
their integers; all others are proven out, and the segments left are skipped. Levels that prove nothing
are simply followed by the next, down to the last.

Queries meet all vectors in blocks: a grid of (query block, group of vector blocks), joined on equality.
A grid cell is of fixed size whatever the data, and returns its k best a query, so the final ranking
reads k rows a query and group. The k-th best of the blocks before is a bound for the next.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id,
take no part; a vector of fewer components counts as padded with zeros; a query never meets its own row,
but it does meet other rows of its id, and rows that repeat an id are candidates and queries of their own;
vectors with a component of more than ``NARROW`` once scaled are always scored, in whole numbers of any
size, and a score that does not fit in 64 bits is ranked as it is and shown as the nearest that fits; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantscope.llm.common import shared_table

SCALE = 64
TOP = 20
BLOCK = 4096  # vectors in a block of the index, at most 2**16
GROUP = 2  # blocks in a grid cell
QUERIES = 2048  # queries in a block
TILE = 128  # queries that accumulate together
FEW = 256  # candidates at which rescoring is cheaper than the next level
NARROW = 2**23  # products of such components add up in 64 bits, and each is exact as a 32-bit float
MOST = 2**63 - 1

VECTORS = "ids binary, numbers binary, vectors binary, wide string, rows int, width int"
INDEX = f"{VECTORS}, heads binary, places binary, impacts binary, unread binary"


def _narrow_bytes(values: np.ndarray) -> bytes:
    """Integers in the fewest bytes each that hold all of them; the count tells the reader which."""
    most = int(np.abs(values).max(initial=0))
    return values.astype("<i1" if most < 2**7 else "<i2" if most < 2**15 else "<i4").tobytes()


def _integers(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{len(data) // count if count else 1}").astype(np.int32)


def _quantised(part: pa.RecordBatch) -> dict:
    """A block of (id, number, vector) rows. Vectors with a wide component are zero here and listed in ``wide``."""
    lists = part.column(2)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    counts = np.diff(lists.offsets.to_numpy())
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * flat)
    row = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    wide = {}
    for k in np.unique(row[~(np.abs(scaled) <= NARROW)]).tolist():
        mine = slice(ends[k] - counts[k], ends[k])
        wide[k] = [math.floor(SCALE * x) if abs(x) < 1e300 else SCALE * int(x) for x in flat[mine].tolist()]
        scaled[mine] = 0
    values = np.zeros((len(counts), int(counts.max(initial=0))), dtype=np.int32)
    values[np.arange(values.shape[1]) < counts[:, None]] = scaled
    return {
        "ids": part.column(0).to_numpy().astype("<i8").tobytes(),
        "numbers": part.column(1).to_numpy().astype("<i8").tobytes(),
        "vectors": values,
        "wide": json.dumps(wide),
        "rows": len(counts),
        "width": values.shape[1],
    }


def postings(values: np.ndarray) -> dict:
    """The segments of a block in the order of reading: heads (level, dimension, start, end), places, impacts.

    ``unread``: for each level that occurs, the length of what each vector holds below it.
    """
    magnitude = np.abs(values.astype(np.int64))
    level = np.frexp(magnitude.astype(float))[1]
    place, dim = np.nonzero(values)
    found = level[place, dim]
    order = np.lexsort((place, dim, -found))
    place, dim, found = place[order], dim[order], found[order]
    starts = np.flatnonzero(np.diff(found, prepend=-1).astype(bool) | np.diff(dim, prepend=-1).astype(bool))
    ends = np.append(starts[1:], len(place))
    squares = magnitude.astype(float) ** 2
    unread = [np.sqrt(np.where(level < n, squares, 0).sum(axis=1)) for n in sorted(set(found.tolist()), reverse=True)]
    return {
        "heads": np.column_stack([found[starts], dim[starts], starts, ends[: len(starts)]]).astype("<i4").tobytes(),
        "places": place.astype("<u2").tobytes(),
        "impacts": _narrow_bytes(values[place, dim]),
        "unread": np.array(unread, dtype="<f8").tobytes(),
    }


def blocks(vectors: DataFrame, size: int, indexed: bool) -> DataFrame:
    """Blocks of up to ``size`` rows (id, number, v), with their posting segments if ``indexed``."""
    schema = INDEX if indexed else VECTORS
    names = [c.split()[0] for c in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                x = _quantised(b.slice(at, size))
                if indexed:
                    x |= postings(x["vectors"])
                x["vectors"] = _narrow_bytes(x["vectors"])
                ints = {"rows", "width"}
                yield pa.RecordBatch.from_arrays([pa.array([x[n]], pa.int32() if n in ints else None) for n in names], names=names)

    return vectors.select("id", "number", "v").mapInArrow(made, schema)


def _fit(vectors: DataFrame, id_col: str, vector: str, asks: Column) -> DataFrame:
    """The rows that take part, numbered: written once, so that a number means the same row in every pass."""

    def unfit(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fit = F.col(id_col).isNotNull() & F.col(vector).isNotNull()
    fit = fit & ~F.exists(F.col(vector).cast("array<double>"), unfit)
    rows = vectors.where(fit).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector).alias("v"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("number"),
    )
    return shared_table(rows, "impact-rows")


class Vectors:
    """The vectors of a block: integers row after row, and wide ones as lists of whole numbers."""

    def __init__(self, block: dict, width: int):
        self.ids = np.frombuffer(block["ids"], dtype="<i8")
        self.numbers = np.frombuffer(block["numbers"], dtype="<i8")
        own = _integers(block["vectors"], block["rows"] * block["width"]).reshape(block["rows"], block["width"])
        self.values = np.pad(own, ((0, 0), (0, width - block["width"])))
        self.wide = {int(k): v + [0] * (width - len(v)) for k, v in json.loads(block["wide"]).items()}

    def whole(self, k: int) -> list[int]:
        return self.wide[k] if k in self.wide else self.values[k].tolist()


class Segments:
    """The posting segments of a block, as the index holds them."""

    def __init__(self, block: dict, values: np.ndarray):
        self.heads = np.frombuffer(block["heads"], dtype="<i4").reshape(-1, 4)
        self.places = np.frombuffer(block["places"], dtype="<u2").astype(np.intp)
        self.impacts = _integers(block["impacts"], len(self.places)).astype(np.float32)
        self.unread = np.frombuffer(block["unread"], dtype="<f8").reshape(-1, len(values))
        starts = np.flatnonzero(np.diff(self.heads[:, 0], prepend=-1))
        self.levels = list(zip(starts.tolist(), [*starts[1:].tolist(), len(self.heads)], strict=True))
        # sums in 32-bit floats are off by at most this much times |query|
        length = np.sqrt((values.astype(float) ** 2).sum(axis=1))
        self.rounding = 4 * np.finfo(np.float32).eps * (values.shape[1] + len(self.levels)) * length
        self.read = self.skipped = 0  # segments, once for each query

    def add(self, level: int, weights: np.ndarray, score: np.ndarray) -> None:
        """Add the segments of a level to ``score`` (places, queries); ``weights``: (dimensions, queries)."""
        n = score.shape[1]
        for _, dim, start, end in self.heads[slice(*self.levels[level])].tolist():
            w = weights[dim]
            if w.any():
                score[self.places[start:end]] += self.impacts[start:end, None] * w
                self.read += n
            else:
                self.skipped += n

    def skip(self, first_level: int, n: int) -> None:
        if first_level < len(self.levels):
            self.skipped += n * (len(self.heads) - self.levels[first_level][0])


def _best(ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``top`` by score, then by id; scores of dtype object are whole numbers of any size."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k]))[:top], dtype=np.intp)
    else:
        order = np.lexsort((ids, -scores))[:top]
    return ids[order], scores[order]


def _scores(block: Vectors, found: np.ndarray, queries: Vectors, k: int) -> np.ndarray:
    """Exact inner products of the query and the vectors at the places found."""
    if k not in queries.wide and not any(p in block.wide for p in found.tolist()):
        return block.values[found].astype(np.int64) @ queries.values[k].astype(np.int64)
    q = queries.whole(k)
    out = np.empty(len(found), dtype=object)
    out[:] = [sum(a * b for a, b in zip(q, block.whole(p), strict=True)) for p in found.tolist()]
    return out


def search_tile(
    segments: Segments, block: Vectors, queries: Vectors, tile: np.ndarray, floor: np.ndarray, top: int = TOP
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query of the tile its best (ids, scores) in the block; ``floor``: a score that is reached already."""
    out: list = [None] * len(tile)
    wide = np.array(sorted(block.wide), dtype=np.intp)

    def settle(k: int, may: np.ndarray) -> None:
        """Rescore the places that may be members, and wide vectors always; the own row is none."""
        may[wide] = True
        may[block.numbers == queries.numbers[tile[k]]] = False
        found = np.flatnonzero(may)
        out[k] = _best(block.ids[found], _scores(block, found, queries, tile[k]), top)

    is_open = np.array([k not in queries.wide for k in tile.tolist()], dtype=bool)
    for k in np.flatnonzero(~is_open):
        settle(k, np.full(len(block.ids), True))
    open_ = np.flatnonzero(is_open)
    if not segments.levels:  # all components are zero
        for k in open_:
            settle(k, np.full(len(block.ids), floor[k] <= 0))
        return out
    score = np.zeros((len(block.ids), len(open_)), np.float32)
    for n in range(len(segments.levels)):
        if not len(open_):
            break
        q = queries.values[tile[open_]]
        segments.add(n, np.ascontiguousarray(q.T.astype(np.float32)), score)
        last = n == len(segments.levels) - 1
        if not last and n == 0:
            continue
        length = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        # a little more than the bound, for the rounding of the bound itself
        slack = ((segments.unread[n] + segments.rounding)[:, None] * (length * (1 + 1e-6))).astype(np.float32)
        mine = block.numbers[:, None] == queries.numbers[tile[open_]]
        bound = floor[open_]
        if len(block.ids) - len(wide) > top:
            low = score - slack
            low[mine] = -np.inf
            low[wide] = -np.inf
            bound = np.maximum(bound, np.partition(low, len(block.ids) - top, axis=0)[len(block.ids) - top])
        may = score + slack >= np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
        done = np.full(len(open_), True) if last else may.sum(axis=0) <= FEW
        for k in np.flatnonzero(done):
            settle(open_[k], may[:, k].copy())
        segments.skip(n + 1, int(done.sum()))
        open_, score = open_[~done], np.ascontiguousarray(score[:, ~done])
    return out


def _reached(scores: np.ndarray, top: int) -> float:
    """The score that ``top`` vectors reach already, as a float."""
    return float(max(min(int(scores[-1]), 2**1000), -(2**1000))) if len(scores) == top else -math.inf


def _beyond(score: int) -> bytes | None:
    """What orders scores that are shown as the same limit of 64 bits: bytes, larger for larger scores."""
    if -MOST <= score <= MOST:
        return None
    size = (abs(score).bit_length() + 7) // 8
    data = size.to_bytes(4) + abs(score).to_bytes(size)
    return data if score > 0 else bytes(255 - x for x in data)


CELL = "query_number long, query_id long, vec_id long, score long, beyond binary"


def _cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """One grid cell: a block of queries against a group of blocks."""
    asked, found = left.to_pylist(), right.to_pylist()
    kinds = [pa.int64()] * 4 + [pa.binary()]
    names = [c.split()[0] for c in CELL.split(", ")]
    if not asked or not found:
        return pa.table({n: pa.array([], kind) for n, kind in zip(names, kinds, strict=True)})
    width = max(x["width"] for x in asked + found)
    queries, top = Vectors(asked[0], width), asked[0]["top"]
    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(queries.ids)
    for row in found:
        block = Vectors(row, width)
        segments = Segments(row, block.values)
        for at in range(0, len(best), TILE):
            tile = np.arange(at, min(at + TILE, len(best)))
            floor = np.array([_reached(best[k][1], top) for k in tile], dtype=float)
            for k, (i, s) in zip(tile, search_tile(segments, block, queries, tile, floor, top), strict=True):
                best[k] = _best(np.concatenate([best[k][0], i]), np.concatenate([best[k][1], s]), top)
    sizes = [len(i) for i, _ in best]
    scores = [int(x) for _, s in best for x in s]
    columns = [
        np.repeat(queries.numbers, sizes),
        np.repeat(queries.ids, sizes),
        np.concatenate([i for i, _ in best]),
        [max(min(x, MOST), -MOST) for x in scores],
        [_beyond(x) for x in scores],
    ]
    return pa.table({n: pa.array(x, kind) for n, x, kind in zip(names, columns, kinds, strict=True)})


def top_k(
    vectors: DataFrame, queries: DataFrame | Column, id_col: str = "vec_id", vector: str = "embedding", top: int = TOP
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the ``top`` best rows of ``vectors`` for each query.

    ``queries``: a condition on ``id_col`` that makes rows of ``vectors`` queries, which do not meet
    themselves, or another table, whose rows meet every vector.
    """
    own = isinstance(queries, Column)
    rows = _fit(vectors, id_col, vector, queries if own else F.lit(False))
    asking = rows.where("asks") if own else _fit(queries, id_col, vector, F.lit(True)).withColumn("number", -1 - F.col("number"))
    index = shared_table(blocks(rows, BLOCK, True).withColumn("block", F.monotonically_increasing_id()), "impact-index")
    asked = shared_table(blocks(asking, QUERIES, False).withColumn("qb", F.monotonically_increasing_id()), "impact-queries")
    # one row a block, numbered without a gap: block tables are thousands of times smaller than the vectors
    numbers = index.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("n"))
    grouped = index.join(numbers, "block").withColumn("group", F.floor(F.col("n") / GROUP).cast("int"))
    n_groups = -(-index.count() // GROUP)
    n_asked = asked.count()
    if not n_groups or not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = asked.select("qb", (F.row_number().over(Window.orderBy("qb")) - 1).alias("q"))
    left = asked.join(order, "qb").drop("qb").withColumn("top", F.lit(top))
    left = left.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    right = grouped.drop("block", "n").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    scored = left.groupBy("q", "group").cogroup(right.groupBy("q", "group")).applyInArrow(_cell, CELL)
    # scores that are shown as the same limit are told apart by their bytes
    ranked = Window.partitionBy("query_number").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    best = scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return best.select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 20 == 0)


DIGEST_SQL = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
    SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.n <> b.n
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
