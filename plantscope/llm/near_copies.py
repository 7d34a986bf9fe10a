"""Near copies by exact Jaccard similarity of five-word shingles, without a limit on what is found.

Texts are linked when their sets of shingles have a similarity of 0.8 or more. SimHash comes first: fingerprints
of the five-word shingles that differ in at most two bits, met under the keys of ``simhash.links``, are pairs,
and those whose sets are similar are links. What that misses is found by prefixes of the sets: two similar sets share one of
the first ``n - ceil(0.8 n) + 1`` shingles of each in any order that holds for all texts (prefix filter), so
these are the keys. The order puts shingles that a sample finds often last; it decides the work and not
the result. Of the keys after these, a text keeps a fifth of its shingles more (``further``): with ``l`` further
keys on both sides, similar sets share ``1 + l`` of all. So a text with too many keys that no other text has is near
none, and leaves by two aggregates before keys are read for pairs; a few shingles met by chance make no pairs. What is
wanted is the components, so not every pair is compared:

* Of keys with the same members one is kept.
* ``LEADERS`` rounds compare each key's first member with the others that are not in its component yet: a pair a
  member. Then components are joined, and keys whose members are in one component are done.
* Of what is left, up to ``CROWD`` members of a key are compared within the row, and only pairs with room for 0.8
  leave it. Larger keys are cut into blocks of ``BLOCK``; every pair of blocks is a group of its own, compared by one
  product of matrices. The work there grows with the square of the members that are in no common component.

A pair is compared only if its sizes and the places of the shared key in both orders leave room for 0.8, and
if the marks do: shingles fall into about as many classes of hashes as the set has members, a mark says whether a
class holds an odd number, and two sets differ in at least as many shingles as in marks. A comparison reads the
sets, which are made again from the texts of such pairs alone.

Texts with equal sets are one node. Shingles stand for themselves by 64 bits of xxHash, as nodes do by that
of their sets. A text of fewer than five words is one shingle; null and blank texts have none and are one
another's copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.llm import simhash
from plantscope.llm.common import release, shared_table, small_batches
from plantscope.llm.stars import connected

SHINGLE = 5
SIMILAR = (4, 5)  # 0.8 as a fraction, so that no rounding decides
LEADERS = 2
MARKS = 64  # words of marks that go with the members of a key, at most
CROWD = 128
BLOCK = 512
SAMPLE = 20_000  # texts looked at for the order
OFTEN = 50_000  # shingles put last, at most
COLUMNS = 4096


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes; words as in ``simhash.fingerprint``."""
    return np.unique(np.concatenate([*simhash.shingle_hashes(text, shingle), np.zeros(0, "<u8")]))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, "<u8")]).astype("<u8").view("<i8")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sets(texts: DataFrame) -> DataFrame:
    """(h, shingles) of texts(h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(t) for t in b.column(1).to_pylist()])], names=["h", "shingles"])

    return texts.mapInArrow(run, "h long, shingles array<long>")


def often(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles in four or more of a sample of the texts, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in small_batches(batches, 1):
            sets = [shingle_set(t) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if h not in seen]
            seen.update(b.column(0).to_pylist())
            found, n = np.unique(np.concatenate([*sets, np.zeros(0, "<u8")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view("<i8")), pa.array(n)], names=["s", "n"])

    h = F.xxhash64(text)
    some = docs.where(F.pmod(h, F.lit(max(docs.count() // SAMPLE, 1))) == 0).select(h.alias("h"), F.col(text).alias("text"))
    seen = some.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("count")).where("count > 3")
    top = seen.orderBy(F.desc("count"), "s").limit(OFTEN).toPandas().to_numpy(dtype=np.int64).reshape(-1, 2)
    hashes = top[:, 0].copy().view("<u8")
    order = np.argsort(hashes)
    return hashes[order], top[order, 1]


def prefix_size(n: Column) -> Column:
    """How many first shingles of a set of ``n`` near sets share one of."""
    return n - F.floor((SIMILAR[0] * n + SIMILAR[1] - 1) / SIMILAR[1]).cast("int") + 1


def further(n: Column) -> Column:
    """How many keys follow the prefix of a set of ``n``; never falls as ``n`` rises."""
    return F.floor(n / SIMILAR[1]).cast("int")


def prefix(shingles: np.ndarray, last: tuple[np.ndarray, np.ndarray], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The first shingles of the order, of which near sets share one, and the further ones."""
    n = len(shingles)
    rank = np.zeros(n, dtype=np.int64)
    if len(last[0]) and n:
        at = np.minimum(np.searchsorted(last[0], shingles), len(last[0]) - 1)
        rank = np.where(last[0][at] == shingles, last[1][at], 0)
    return shingles[np.lexsort((shingles, rank))[: n - -(-similar[0] * n // similar[1]) + 1 + n // similar[1]]]


def marks(shingles: np.ndarray) -> np.ndarray:
    """Words of one bit a class: whether it holds an odd number of shingles. Their number is a power of two."""
    words = 1 << max((len(shingles) - 1) // 64, 0).bit_length()
    odd = np.bincount(((shingles >> np.uint64(32)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _keyed(docs: DataFrame, last: tuple[np.ndarray, np.ndarray], id_col: str, text: str) -> DataFrame:
    """(id, h: hash of the text, fp: hash of the set, bits: SimHash, n: size of the set, marks, keys in order) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in small_batches(batches, 2):
            sets, bits = [], []
            for t in b.column(2).to_pylist():
                chunks = list(simhash.shingle_hashes(t, SHINGLE))
                bits.append(simhash.majority(chunks))
                sets.append(np.unique(np.concatenate([*chunks, np.zeros(0, "<u8")])))
            fps = np.array([xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(fps),
                    pa.array(bits, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    _lists([marks(s) for s in sets]),
                    _lists([prefix(s, last) for s in sets]),
                ],
                names=["id", "h", "fp", "bits", "n", "marks", "keys"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return texts.mapInArrow(run, "id long, h long, fp long, bits long, n int, marks array<long>, keys array<long>")


def near_blocks(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Of every set the smallest position that near sets reach."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[row[a:b], column[a:b] - start] = 1
        both += part @ part.T
    shared = both.astype(np.int64)
    near = similar[1] * shared >= similar[0] * (n[:, None] + n[None, :] - shared)
    np.fill_diagonal(near, True)
    label = np.arange(len(sets))
    while True:
        now = np.where(near, label[None, :], len(sets)).min(axis=1)
        if (now == label).all():
            return label
        label = now


def _block_links(group: pa.Table) -> pa.Table:
    fps = group.column("fp").to_numpy()
    flat = group.column("shingles").combine_chunks()
    label = near_blocks([flat[i].values.to_numpy() for i in range(len(fps))])
    linked = label != np.arange(len(fps))
    a, b = fps[linked], fps[label[linked]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _sizes(a: Column, b: Column) -> Column:
    return SIMILAR[1] * F.least(a["n"], b["n"]) >= SIMILAR[0] * F.greatest(a["n"], b["n"])


def _room(a: Column, b: Column) -> Column:
    """Whether members a and b of a key, structs (fp, n, pos), can be near by their sizes and the key's places."""
    na, nb, pa_, pb = a["n"], b["n"], a["pos"], b["pos"]
    shared = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return _sizes(a, b) & (sum(SIMILAR) * shared >= SIMILAR[0] * (na + nb))


def _few_odd(a: Column, b: Column) -> Column:
    """Whether structs (n, marks) of like sizes can be near by their marks; sets of like sizes have like marks, or one twice as many."""

    def folded(x: Column, y: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        halves = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > F.size(y), halves).otherwise(x)

    met = F.zip_with(folded(a["marks"], b["marks"]), folded(b["marks"], a["marks"]), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    odd = F.aggregate(met, F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(sum(SIMILAR) * odd <= (SIMILAR[1] - SIMILAR[0]) * (a["n"] + b["n"]), F.lit(True))


def _short(words: Column) -> Column:
    """Marks folded to at most ``MARKS`` words."""

    def word(i: Column) -> Column:
        return F.aggregate(F.filter(words, lambda _, j: j % MARKS == i), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))

    return F.when(F.size(words) <= MARKS, words).otherwise(F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), word))


def _open_members(members: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (key, fp, n, pos) of keys whose members are not all in one component, with their root; ``linked`` as stars."""
    roots = connected(linked)
    named = members.drop("root").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return shared_table(named.join(several, "key"), "near-open"), roots.select(F.col("root").alias("a"), F.col("node").alias("b"))


def _sets_of(fps: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(fp, shingles) of these nodes, from the texts again: few texts are ever compared."""
    named = shared_table(nodes.select("fp", "h").join(fps.distinct(), "fp"), "near-named")
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    wanted = named.select("h")
    texts = texts.join(F.broadcast(wanted) if named.count() <= simhash.BROADCAST_KEYS else wanted, "h", "left_semi")
    sets = shared_table(_sets(texts.dropDuplicates(["h"])).join(named, "h").select("fp", "shingles"), "near-sets")
    release(named)
    return sets


def _near_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def marked(name: str) -> DataFrame:
        return nodes.select(F.col("fp").alias(name), F.struct("n", "marks").alias(f"_{name}"))

    sides = F.col("_a"), F.col("_b")
    pairs = pairs.join(marked("a"), "a").join(marked("b"), "b").where(_sizes(*sides) & _few_odd(*sides)).select("a", "b")
    pairs = shared_table(pairs, "near-pairs")
    if pairs.isEmpty():
        return pairs
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("fp")), nodes, docs, text)

    def side(name: str) -> DataFrame:
        return sets.select(F.col("fp").alias(name), F.col("shingles").alias(f"_{name}"))

    shared = F.size(F.array_intersect("_a", "_b"))
    near = SIMILAR[1] * shared >= SIMILAR[0] * (F.size("_a") + F.size("_b") - shared)
    found = shared_table(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b"), "near-links")
    release(pairs, sets)
    return found


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.fp", f"{b}.fp").alias("a"), F.greatest(f"{a}.fp", f"{b}.fp").alias("b")]


def _one_of_same(members: DataFrame) -> DataFrame:
    """The members (key, fp, n, pos, root) of one key of those with the same members: any shared key says what another would."""
    same = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min("fp").alias("m"), F.max("fp").alias("high")
    )
    kept = shared_table(same.groupBy("k", "x", "m", "high").agg(F.min("key").alias("key")).select("key"), "near-groups")
    out = shared_table(members.join(F.broadcast(kept) if kept.count() <= simhash.BROADCAST_KEYS else kept, "key"), "near-members")
    release(members, kept)
    return out


def simhash_links(nodes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b), a < b: near pairs of the nodes among those that SimHash links.

    Nodes of one fingerprint are compared with the first of them, linked fingerprints by their first nodes.
    """
    first = shared_table(nodes.groupBy("bits").agg(F.min("fp").alias("fp")), "near-bits")
    same = nodes.select("fp", "bits").join(first.select("bits", F.col("fp").alias("lead")), "bits").where("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    met = simhash.links(first.select(F.col("bits").alias("fp"))).toDF("bits_a", "bits_b")
    met = met.join(first.toDF("bits_a", "a"), "bits_a").join(first.toDF("bits_b", "b"), "bits_b")
    found = _near_pairs(same.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), nodes, docs, text)
    release(first)
    return found


def in_company(nodes: DataFrame) -> DataFrame:
    """The nodes (fp, n, keys) that share as many keys with others as a near set would; any node with a near set is one.

    A near set has four fifths of the shingles at least, so its further keys are known to be that many at least.
    """
    nodes = nodes.where("n > 0")
    counted = nodes.select("fp", F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("fp").alias("fp"))
    alone = counted.where("k = 1").groupBy("fp").agg(F.count(F.lit(1)).alias("alone"))
    least = F.col("n") - prefix_size(F.col("n")) + 1
    shared = prefix_size(F.col("n")) + further(F.col("n")) - F.coalesce("alone", F.lit(0))
    kept = shared_table(nodes.select("fp", "n").join(alone, "fp", "left").where(shared >= 1 + further(least)).select("fp"), "near-kept")
    wanted = F.broadcast(kept) if kept.count() <= simhash.BROADCAST_KEYS else kept
    met = shared_table(nodes.select("fp", "n", "keys").join(wanted, "fp"), "near-company")
    release(kept)
    return met


def links(
    nodes: DataFrame, docs: DataFrame, text: str = "text", crowd: int = CROWD, block: int = BLOCK, leaders: int = LEADERS, linked: DataFrame | None = None
) -> DataFrame:
    """(a, b), a < b: links that join the nodes (fp, h: hash of a text, n, marks, keys in order) as all near pairs would.

    ``linked`` holds links that are known already.
    """
    met = in_company(nodes)
    keyed = met.select("fp", "n", F.posexplode(F.slice("keys", F.lit(1), prefix_size(F.col("n")))).alias("pos", "key"))
    keys = shared_table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), "near-keys")
    members = keyed.join(F.broadcast(keys) if keys.count() <= simhash.BROADCAST_KEYS else keys, "key")
    members = _one_of_same(shared_table(members.withColumn("root", F.col("fp")), "near-keyed"))
    release(keys, met)
    if linked is not None:
        every = members
        members, linked = _open_members(every, linked)
        release(every)
    for _ in range(leaders):
        if members.isEmpty():
            break
        led_from = members
        first = F.min(F.struct("fp", "n", "pos", "root")).alias("lead")
        led = members.join(members.groupBy("key").agg(first), "key").withColumn("own", F.struct("fp", "n", "pos"))
        pairs = led.where((F.col("lead.root") != F.col("root")) & _room(F.col("lead"), F.col("own"))).select(*_pair("lead", "own")).distinct()
        found = _near_pairs(pairs, nodes, docs, text)
        linked = found if linked is None else linked.unionByName(found)
        # a leader has been compared with all members of its key
        rest = led.where("fp <> lead.fp").select("key", "fp", "n", "pos")
        members, linked = _open_members(rest, linked)
        release(led_from)
    if members.isEmpty():
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false") if linked is None else linked
    members = _one_of_same(members)
    counts = shared_table(members.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "near-counts")
    marked = nodes.select("fp", _short(F.col("marks")).alias("marks"))
    few = members.join(counts.where(F.col("k") <= crowd).select("key"), "key").join(marked, "fp")
    few = few.groupBy("key").agg(F.collect_list(F.struct("fp", "n", "pos", "root", "marks")).alias("all"))

    def near(one: Column) -> Column:
        others = F.filter("all", lambda x: (x["fp"] > one["fp"]) & (x["root"] != one["root"]) & _room(one, x) & _few_odd(one, x))
        return F.transform(others, lambda x: F.struct(one["fp"].alias("a"), x["fp"].alias("b")))

    few = few.select(F.explode(F.flatten(F.transform("all", near))).alias("pair")).select("pair.a", "pair.b")
    compared = _near_pairs(few.distinct(), nodes, docs, text)
    every = compared if linked is None else linked.unionByName(compared)
    large = counts.where(F.col("k") > crowd)
    if large.isEmpty():
        release(members, counts)
        return every
    crowded = members.join(large, "key")
    blocks = F.ceil(F.col("k") / block)
    own = F.pmod(F.xxhash64("fp", "key"), blocks)
    placed = crowded.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    placed = placed.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = _sets_of(crowded.select("fp"), nodes, docs, text)
    crossed = placed.join(sets, "fp").groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long")
    out = shared_table(every.unionByName(crossed).distinct(), "near-all-links")
    release(members, sets, counts)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group that near copies join: the one of the smallest id."""
    last = often(docs, text)
    rows = shared_table(_keyed(docs, last, id_col, text), "near-rows")
    named = shared_table(rows.select("id", "h", "fp"), "near-ids")
    nodes = shared_table(rows.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("h", "bits", "n", "marks", "keys")]), "near-nodes")
    release(rows)
    linked = simhash_links(nodes, docs, text)
    return simhash.first_rows(docs, simhash.classes(named, links(nodes, docs, text, linked=linked)), id_col, text)
