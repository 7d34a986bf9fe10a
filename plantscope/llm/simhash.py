"""SimHash near-dedup by deletion-variant signatures: fewer segments, one wildcard each, exact links.

A fingerprint has 64 bits; two documents are linked when theirs differ in at most two. Cut into two
segments (one fewer than plain segment lookup needs), one of them differs by at most one bit. Each
distinct fingerprint is therefore indexed under 64 keys: for each segment and each of its 32 bits, the
segment with that bit deleted. Fingerprints that meet under a key are verified; linked ones are joined
into components by alternating stars.

No group is gathered without a bound:

* The number of fingerprints under a key is a partially aggregated count. Under a key of two or three
  they are known from aggregates: the minimum, the maximum, and what both leave of the exclusive or.
* Up to ``CROWD`` fingerprints under a key are collected and compared within the row.
* Fingerprints under larger keys are indexed again with two of all 64 bits deleted. Whatever the data, at
  most four fingerprints can agree on the other 62 bits, and all of them are linked.

Equal fingerprints (copies) are one node, so a text with any number of copies costs nothing here.

Defined results: a null or blank text has no words and fingerprint zero, which is linked like any other;
rows that repeat an id are rows of their own; a null id counts only if its component has no other id;
extra columns are ignored by ``components`` and kept by ``one_of_each``; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantscope.llm.common import fresh, shared_table, small_batches
from plantscope.llm.stars import connected

SEED = 42
SHINGLE = 3
CHUNK = 1 << 16  # shingles hashed at a time, so a very long text needs no array of all its hashes
CROWD = 128
BROADCAST_KEYS = 1_000_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of all shingles in order, repeats included, ``CHUNK`` at a time."""
    from xxhash import xxh64_intdigest

    # bytes.lower changes A-Z alone, and bytes.split cuts at 0x20 and 0x09-0x0D alone
    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        words, shingle = [b" ".join(words)] * bool(words), 1
    n = len(words) - shingle + 1
    for at in range(0, n, CHUNK):
        last = min(at + CHUNK, n)
        joined = map(b" ".join, zip(*(words[at + k : last + k] for k in range(shingle)), strict=True))
        yield np.array([xxh64_intdigest(s, SEED) for s in joined], dtype="<u8")


def majority(chunks: Iterable[np.ndarray]) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer."""
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for hashes in chunks:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingle hashes, as a signed 64-bit integer."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h: hash of the text, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2):
            fps = [fingerprint(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["id", "h", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return texts.mapInArrow(run, "id long, h long, fp long")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= 2


def signatures(fp: Column) -> Column:
    """The 64 keys of a fingerprint: (number of the deleted bit, what is left of its segment)."""
    keys = []
    for bit in range(64):
        segment = fp.bitwiseAND(F.lit(0xFFFFFFFF)) if bit < 32 else F.shiftrightunsigned(fp, 32)
        left = segment.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit % 32)))
        keys.append(left.bitwiseOR(F.lit(bit << 32)))
    return F.array(*keys)


def _two_deleted(nodes: DataFrame) -> DataFrame:
    """Links among ``nodes`` by the 2016 keys that lack two of all 64 bits; a key holds four nodes at most."""
    bits = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    one = nodes.select("fp", F.posexplode(bits).alias("i", "bi"))
    two = one.select("fp", "i", "bi", F.posexplode(F.slice(bits, F.col("i") + 2, 64)).alias("j", "bj"))
    left = F.col("fp").bitwiseAND(F.bitwise_not(F.col("bi").bitwiseOR(F.col("bj"))))
    met = two.groupBy("i", "j", left.alias("left")).agg(F.sort_array(F.collect_set("fp")).alias("fps"))
    return met.where(F.size("fps") > 1).select(
        F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", 2, 3)).alias("b")
    )


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: links that join the distinct fingerprints ``nodes(fp)`` as all near pairs would."""
    keyed = nodes.select("fp", F.explode(signatures(F.col("fp"))).alias("key"))
    low, high = F.col("low"), F.col("high")
    third = low.bitwiseXOR(high).bitwiseXOR(F.col("x"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    few = F.when(F.col("n") == 2, F.array(pair(low, high))).when(F.col("n") == 3, F.array(pair(low, high), pair(low, third), pair(third, high)))
    few = F.filter(few, lambda p: _near(p["a"], p["b"]))
    counted = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.bit_xor("fp").alias("x")
    )
    counted = counted.where("n > 1").select("key", "n", few.alias("pairs"), (F.col("n") > 3).alias("crowd"))
    keys = shared_table(counted.where(F.col("crowd") | (F.size("pairs") > 0)), "simhash-keys", "crowd")
    crowded = keys.where("crowd").select("key", "n")
    # a counted table of 16 bytes a row; a larger one is joined by exchange
    met = keyed.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded, "key")
    small = met.where(F.col("n") <= crowd).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    compared = small.select("fps", F.explode("fps").alias("a")).select(
        "a", F.explode(F.filter("fps", lambda x: (x > F.col("a")) & _near(x, F.col("a")))).alias("b")
    )
    large = _two_deleted(met.where(F.col("n") > crowd).select("fp").distinct())
    pairs = keys.where("not crowd").select(F.explode("pairs").alias("p")).select("p.a", "p.b")
    return pairs.unionByName(compared).unionByName(large).distinct()


def _nodes(rows: DataFrame) -> DataFrame:
    """(fp, first row) of the rows (id, h, fp)."""
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "h"))
    return rows.groupBy("fp").agg(first.alias("first"))


def _classes(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, root, keep: the first row of its component) of the nodes (fp, first row)."""
    roots = connected(linked).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    keep = named.groupBy("root").agg(F.min("first").alias("keep"))
    return named.select("fp", "root").join(keep, "root")


def classes(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """``_classes`` of the rows (id, h, fp) under any links of their fp."""
    return _classes(shared_table(_nodes(rows), "simhash-nodes"), linked)


def _rows_and_classes(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row (id, h, fp), and of every fingerprint (fp, root, keep: the first row of its component)."""
    rows = shared_table(fingerprints(docs, id_col, text), "simhash-fps")
    nodes = shared_table(_nodes(rows), "simhash-nodes")
    return rows, _classes(nodes, links(nodes.select("fp")))


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id: the smallest id that links reach) of every row."""
    rows, classes = _rows_and_classes(docs, id_col, text)
    return rows.join(classes, "fp").select("id", "fp", F.col("keep.id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id."""
    return first_rows(docs, _rows_and_classes(docs, id_col, text)[1], id_col, text)


def first_rows(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classes keep."""
    # plain columns, so that one exchange of the rows serves the join and the numbers
    first, unnamed, h, repeat = fresh(docs, "id", "unnamed", "h", "repeat")
    own, kept = F.col(id_col).cast("long"), F.col("keep.id")
    keep = classes.where("fp = root").select(F.coalesce(kept, F.lit(0)).alias(first), kept.isNull().alias(unnamed), F.col("keep.h").alias(h))
    named = docs.withColumns({first: F.coalesce(own, F.lit(0)), unnamed: own.isNull(), h: F.xxhash64(text)})
    met = named.join(keep, [first, unnamed, h])
    number = F.row_number().over(Window.partitionBy(first, unnamed, h).orderBy(F.lit(1)))
    return met.withColumn(repeat, number).where(F.col(repeat) == 1).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return components(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
