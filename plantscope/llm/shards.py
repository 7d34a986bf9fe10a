"""Sharding by histogram sort (native): splitters from exact byte counts, then one exchange.

Documents are ordered by (hash of the text, hash of the id), so equal texts stand side by side. Splitters
for ``shards`` shards of equal bytes are found as histogram sort does: in each round the key interval
around every unmet splitter is cut into ``FANOUT`` candidate boundaries, the exact bytes below each
candidate are summed across partitions, and the interval narrows to the part that holds the target. A
splitter is met when a candidate lies within ``tolerance`` of a shard of its target, or when one key is
left, and then the nearer side of that key is taken. A splitter falls between groups of equal texts
wherever the tolerance allows it, and cuts a group, by id, only where the group is too large for that (a
group of a third of all rows spans eight shards). Each round reads three numbers a document, not the
text, and brings at most ``shards`` x ``FANOUT`` sums to the driver.

The exchange goes by (shard, lane); lanes hash the id, so that a shard of any size and a text of any
number of copies is many tasks. Slots number a shard lane by lane.

Defined results: a null text has 0 bytes of text, CRC-32 0 and the hash of the empty text; rows that
repeat id and text have one key, are not cut apart, and are numbered one by one; extra columns pass
through, unless called like an output column, which replaces them; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantscope.llm.common import fresh, shared_table

SHARDS = 24
TOLERANCE = 0.01
FANOUT_BITS = 12
FANOUT = 1 << FANOUT_BITS
LANE_BYTES = 16 << 20
KEY_BITS = 63


@dataclass(frozen=True)
class Interval:
    """Keys k1 in [low, low + 2**bits), or, where ``group`` is set, k1 = group and k2 in that range."""

    group: int | None
    low: int
    bits: int

    @property
    def shift(self) -> int:
        return max(self.bits - FANOUT_BITS, 0)

    @property
    def column(self) -> Column:
        return F.col("k1" if self.group is None else "k2")

    def holds(self) -> Column:
        inside = self.column.between(self.low, self.low + (1 << self.bits) - 1)
        return inside if self.group is None else (F.col("k1") == self.group) & inside

    def part(self) -> Column:
        return F.call_function("shiftright", self.column - F.lit(self.low), F.lit(self.shift))

    def narrowed(self, part: int) -> Interval:
        return replace(self, low=self.low + (part << self.shift), bits=self.shift)


def key_columns(id_col: str, text: str) -> dict[str, Column]:
    """The two halves of the sort key, not negative, and the size."""
    return {
        "k1": F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1),
        "k2": F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1),
        "size": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(8),
    }


def _histograms(keys: DataFrame, intervals: list[Interval]) -> dict[Interval, list]:
    """For each interval its parts that hold keys: (part, bytes, k1 range, k2 range), in order."""
    which, part = F.lit(None).cast("int"), F.lit(None).cast("long")
    for n, x in enumerate(intervals):
        which, part = F.when(x.holds(), F.lit(n)).otherwise(which), F.when(x.holds(), x.part()).otherwise(part)
    sums = (
        keys.select(which.alias("which"), part.alias("part"), "k1", "k2", "size")
        .where("which is not null")
        .groupBy("which", "part")
        .agg(F.sum("size").alias("bytes"), *[f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)])
    )
    out: dict[Interval, list] = defaultdict(list)
    for r in sums.collect():  # at most len(intervals) * FANOUT rows
        out[intervals[r["which"]]].append(r)
    for rows in out.values():
        rows.sort(key=lambda r: r["part"])
    return out


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int]], int]:
    """The shards - 1 smallest keys (k1, k2) of the shards after the first, and the bytes in all."""
    whole = Interval(None, 0, KEY_BITS)
    found: dict[int, tuple[int, int]] = {}
    below = dict.fromkeys(range(1, shards), 0)  # bytes before the interval of each splitter
    at = dict.fromkeys(range(1, shards), whole)
    total = 0
    while len(found) < shards - 1:
        open_ = [s for s in at if s not in found]
        sums = _histograms(keys, sorted({at[s] for s in open_}, key=lambda x: (x.group or -1, x.low, x.bits)))
        if not total:
            total = sum(r["bytes"] for r in sums[whole])
            if not total:
                return [], 0
        for s in open_:
            x, target, slack = at[s], total * s / shards, tolerance * total / shards
            done = below[s]
            for r in sums[x]:
                if done + r["bytes"] >= target:
                    break
                done += r["bytes"]
            nearer_end = done + r["bytes"] - target < target - done
            if min(abs(done - target), abs(done + r["bytes"] - target)) <= slack:
                edge = x.low + ((r["part"] + nearer_end) << x.shift)
                found[s] = (edge, 0) if x.group is None else (x.group, edge)
            elif (r["min_k1"], r["min_k2"]) == (r["max_k1"], r["max_k2"]):
                found[s] = (r["min_k1"], r["min_k2"] + nearer_end)
            else:
                below[s] = done
                one_text = x.group is None and r["min_k1"] == r["max_k1"]
                at[s] = Interval(r["min_k1"], 0, KEY_BITS) if one_text else x.narrowed(r["part"])
    return [found[s] for s in range(1, shards)], total


def _shard(edges: list[tuple[int, int]], k1: Column, k2: Column) -> Column:
    """How many splitters are at or below the key; an edge of 2**63 is above every key."""
    out = F.lit(0)
    for a, b in edges:
        if a < 1 << KEY_BITS:
            tie = (k1 == F.lit(a)) & (k2 >= F.lit(b)) if b < 1 << KEY_BITS else F.lit(False)
            out = out + F.when((k1 > F.lit(a)) | tie, 1).otherwise(0)
    return out


def shard_by_bytes(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """``docs`` with size, shard (0 to shards - 1) and slot, exchanged once by shard and lane."""
    key = key_columns(id_col, text)
    keys = shared_table(docs.select(*[c.alias(n) for n, c in key.items()]), "shard-keys")
    edges, total = splitters(keys, shards, tolerance)
    lanes = max(1, -(-total // (shards * LANE_BYTES)))
    k1, k2, lane, start = fresh(docs, "k1", "k2", "lane", "start")

    def place(a: Column, b: Column) -> dict[str, Column]:
        return {"shard": _shard(edges, a, b), lane: (b % F.lit(lanes)).cast("int")}

    counts = keys.withColumns(place(F.col("k1"), F.col("k2"))).groupBy("shard", lane).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", lane, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    rows = docs.withColumns({k1: key["k1"], k2: key["k2"], "size": key["size"]})
    rows = rows.withColumns(place(F.col(k1), F.col(k2)))
    # as many partitions as lanes of a bounded size, whatever the session's default
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards * lanes)
    rows = rows.repartition(partitions, "shard", lane)
    in_lane = Window.partitionBy("shard", lane).orderBy(k1, k2)
    rows = rows.withColumn("slot", F.row_number().over(in_lane).cast("long") - 1)
    rows = rows.join(starts, ["shard", lane]).withColumn("slot", F.col("slot") + F.col(start))
    new = [c for c in ("size", "shard", "slot") if c not in docs.columns]
    return rows.select(*docs.columns, *new)


def digest(docs: DataFrame) -> DataFrame:
    placed = shard_by_bytes(docs.select("doc_id", "text"))
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
