"""Suffix-array dedup: repeated strings of ``match`` bytes by longest-previous-factor arrays.

A window is a string of ``match`` bytes. In the array of all windows in suffix order (by content, then by
position) neighbours with a longest common prefix of ``match`` bytes form runs. Inside a run, the previous or
next smaller position of a window is an earlier match, so its longest previous factor is ``match`` or more;
any neighbour in the run is a match elsewhere. Removing windows with an earlier match keeps the first copy;
removing all windows with a match keeps none.

No machine sorts all suffixes. The array is cut so that equal windows stay together:

* Each window has an anchor: the least hash of its grams of ``GRAM`` bytes, a function of its content. Runs
  of windows with one anchor are a piece, so a text has a piece for some 50 windows.
* Anchors that occur in one text alone, and there once, hold no match. They are found by an aggregate of the
  anchors, and only the pieces of the other anchors are sent, with their bytes.
* Anchors are dealt to lanes of bounded size. A lane sorts the windows of its distinct pieces.
* Of an anchor with more than ``HOT`` pieces, equal pieces become one row by a partial aggregate, the windows
  of different pieces are dealt by content, and runs are found by an aggregate.

Equal texts are one text with a number of copies. Texts stand for themselves by 128 bits of SHA-256, windows
of hot anchors likewise; all other comparisons are of bytes.

Defined results: a null text is empty; a text shorter than ``match`` loses nothing; the order of texts, for
"first", is that of the smallest id that has them (null last), then of their digest; rows that repeat an id
and its text are all the first; extra columns are ignored by ``spans`` and ``digest`` and kept by
``without_repeats``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.llm.common import shared_table, small_batches

MATCH = 200
GRAM = 64
LONGEST_PIECE = 512  # windows
CHUNK = 1 << 20  # bytes hashed at a time; positions in a chunk take 20 bits
HOT = 1024
PIECES_PER_LANE = 2048
BROADCAST_KEYS = 1_000_000
SEEN = 100_000  # texts that a task remembers in order not to cut copies again

# any odd numbers do: they mix the bits of the gram hashes
_MIX = [np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all strings of ``gram`` bytes, doubling the length with each step."""
    h = data.astype(np.uint64) * _SPREAD + np.uint64(1)
    length, step = 1, 0
    while length < gram:
        ahead = min(length, gram - length)
        h = h[:-ahead] * _MIX[step % len(_MIX)] + h[ahead:]
        h ^= h >> np.uint64(29)
        length, step = length + ahead, step + 1
    return h * _SPREAD


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        ahead = min(span, width - span)
        x = np.minimum(x[:-ahead], x[ahead:])
        span += ahead
    return x


def pieces(data: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, starts, numbers of windows, whether the anchor occurs again in the piece) of one text.

    A function of the text alone. Windows of one anchor that follow one another are a piece, up to ``LONGEST_PIECE``.
    """
    found = []
    gram = min(GRAM, max(match // 3, 1))
    step = CHUNK - match
    for at in range(0, max(len(data) - match + 1, 0), step):
        part = data[at : at + step + match - 1]
        h = gram_hashes(part, gram)
        low = np.uint64(CHUNK - 1)
        least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), match - gram + 1)
        cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        anchor = h[(least[cut] & low).astype(np.int64)]
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        first = np.flatnonzero(new)
        start, anchor = cut[first], anchor[first]
        again = np.diff(np.append(first, len(cut))) > 1
        size = np.diff(np.append(start, len(least)))
        parts = -(-size // LONGEST_PIECE)
        of = np.repeat(np.arange(len(size)), parts)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = start[of] + inner * LONGEST_PIECE
        found.append((anchor[of].view(np.int64), at + start, np.minimum(size[of] - inner * LONGEST_PIECE, LONGEST_PIECE), again[of]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _text_columns(id_col: str, text: str) -> list[Column]:
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return [F.unhex(F.substring(F.sha2(data, 256), 1, 32)).alias("tid"), F.col(id_col).cast("long").alias("id"), data.alias("data")]


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(*_text_columns(id_col, text))


def _rows_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, bytes, np.ndarray, pa.RecordBatch]]:
    """(row, text id, bytes, batch) of every text that this task has not met."""
    seen: set[bytes] = set()
    for b in small_batches(batches, column):
        for i, (tid, data) in enumerate(zip(b.column(0), b.column(column), strict=True)):
            tid = tid.as_py()
            if tid in seen:
                continue
            if len(seen) < SEEN:
                seen.add(tid)
            yield i, tid, np.frombuffer(data.as_buffer(), dtype=np.uint8), b


def _anchors(texts: DataFrame, match: int) -> DataFrame:
    """(key, text, again): an anchor, the first half of the text id as a number, whether it repeats in the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, agains, rows = [], [], [], 0
        for _, tid, data, _ in _rows_of(batches, 1):
            key, _, _, again = pieces(data, match)
            order = np.lexsort((again, key))
            key, again = key[order], again[order]
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.zeros(0, dtype=np.int64)
            # an anchor of several pieces of a text repeats there
            several = np.diff(last, prepend=-1) > 1
            keys.append(key[last])
            agains.append(again[last] | several)
            owners.append(np.full(len(last), int.from_bytes(tid[:8], "little", signed=True)))
            rows += len(last)
            if rows > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, owners, agains)], names=["key", "text", "again"])
                keys, owners, agains, rows = [], [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, owners, agains)], names=["key", "text", "again"])

    return texts.select("tid", "data").mapInArrow(run, "key long, text long, again boolean")


def _all_pieces(texts: DataFrame, match: int) -> DataFrame:
    """(tid, key, start, n) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tid, data, _ in _rows_of(batches, 1):
            key, start, n, _ = pieces(data, match)
            if len(key):
                tids = pa.array([tid]).take(pa.array(np.zeros(len(key), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([tids, pa.array(key), pa.array(start), pa.array(n.astype(np.int32))], names=["tid", "key", "start", "n"])

    return texts.select("tid", "data").mapInArrow(run, "tid binary, key long, start long, n int")


def _cut(met: DataFrame, match: int) -> DataFrame:
    """(tid, first_id, key, start, n, lane, hot, data) of the pieces of texts (tid, first_id, data, met)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2, 1 << 20):
            for i in range(b.num_rows):
                found = b.column(3)[i].values
                tid = b.column(0).slice(i, 1).take(pa.array(np.zeros(len(found), dtype=np.int64)))
                first = b.column(1).slice(i, 1).take(pa.array(np.zeros(len(found), dtype=np.int64)))
                data = b.column(2)[i].as_buffer().to_pybytes()
                key, start, n, lane, hot = (found.field(k) for k in range(5))
                cut = [data[s : s + m + match - 1] for s, m in zip(start.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([tid, first, key, start, n, lane, hot, pa.array(cut, pa.binary())], names=names)

    names = ["tid", "first_id", "key", "start", "n", "lane", "hot", "data"]
    schema = "tid binary, first_id long, key long, start long, n int, lane long, hot boolean, data binary"
    return met.select("tid", "first_id", "data", "met").mapInArrow(run, schema)


def factors(contents: list[bytes], match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content of each window, has an earlier match, has a match) of all windows of ``contents``.

    Contents stand in order of position, so a stable sort of the windows by content is their suffix order.
    """
    windows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(c, dtype=np.uint8), match) for c in contents]
    of = np.repeat(np.arange(len(contents)), [len(w) for w in windows])
    table = np.ascontiguousarray(np.concatenate(windows))
    order = np.argsort(table.view(f"S{match}").ravel(), kind="stable")
    same = np.zeros(len(order), dtype=bool)  # the common prefix with the suffix before is the whole window
    for at in range(1, len(order), 1 << 14):
        end = min(at + (1 << 14), len(order))
        same[at:end] = (table[order[at:end]] == table[order[at - 1 : end - 1]]).all(axis=1)
    # positions ascend inside a run, so the previous smaller position is the neighbour before, if the run has one
    earlier, anywhere = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    earlier[order] = same
    anywhere[order] = same | np.append(same[1:], False)
    return of, earlier, anywhere


def _intervals(flags: np.ndarray, start: int, match: int) -> Iterator[tuple[int, int]]:
    """Bytes covered by the flagged windows of a piece that starts at ``start``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        yield start + a, start + b + match - 1


def _lane(match: int):
    def run(group: pa.Table) -> pa.Table:
        occurs: dict[bytes, list[tuple]] = {}
        columns = [group.column(c).to_pylist() for c in ("first_id", "tid", "start", "data")]
        for first, tid, start, data in zip(*columns, strict=True):
            occurs.setdefault(data, []).append((first is None, first or 0, tid, start))
        for places in occurs.values():
            places.sort()
        contents = sorted(occurs, key=lambda c: occurs[c][0])
        of, earlier, anywhere = factors(contents, match)
        ends = np.cumsum([len(c) - match + 1 for c in contents])
        out = []
        for c, begin, end in zip(contents, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            every = np.ones(end - begin, dtype=bool)
            for k, (_, _, tid, start) in enumerate(occurs[c]):
                later = every if k else earlier[begin:end]
                other = every if len(occurs[c]) > 1 else anywhere[begin:end]
                out += [(tid, True, a, b) for a, b in _intervals(later, start, match)]
                out += [(tid, False, a, b) for a, b in _intervals(other, start, match)]
        tids, laters, starts, stops = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table(
            {"tid": pa.array(tids, pa.binary()), "later": pa.array(laters, pa.bool_()), "a": pa.array(starts, pa.int64()), "b": pa.array(stops, pa.int64())}
        )

    return run


def _windows_of(contents: DataFrame, match: int) -> DataFrame:
    """(content, at, window): digests of all windows of the contents (content, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in small_batches(batches, 1, 1 << 18):
            for content, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(data) - match + 1
                digests = [sha256(data[i : i + match]).digest()[:16] for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([content] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int64)), pa.array(digests, pa.binary())], names=["content", "at", "window"]
                )

    return contents.mapInArrow(run, "content binary, at long, window binary")


def _hot(rows: DataFrame, match: int) -> DataFrame:
    """``_lane``'s rows for the pieces of hot anchors: equal pieces and equal windows are aggregates."""
    place = F.struct(F.col("first_id").isNull().alias("unnamed"), F.coalesce("first_id", F.lit(0)).alias("first_id"), "tid", "start")
    rows = shared_table(rows.select("tid", "start", "n", "data", F.unhex(F.substring(F.sha2("data", 256), 1, 32)).alias("content"), place.alias("place")), "factor-hot")
    contents = rows.groupBy("content").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("first"), F.first("data").alias("data"))
    contents = shared_table(contents, "factor-contents")
    windows = shared_table(_windows_of(contents.select("content", "data"), match), "factor-windows")
    placed = windows.join(contents.select("content", "times", "first"), "content")
    position = F.struct("first.unnamed", "first.first_id", "first.tid", (F.col("first.start") + F.col("at")).alias("start"))
    met = placed.groupBy("window").agg(F.count(F.lit(1)).alias("k"), F.min(position).alias("least")).where("k > 1")
    hits = placed.join(met, "window").select("content", "at", (position != F.col("least")).alias("later"))
    flags = hits.groupBy("content").agg(
        F.sort_array(F.collect_list("at")).alias("anywhere"), F.sort_array(F.collect_list(F.when(F.col("later"), F.col("at")))).alias("earlier")
    )
    # at most LONGEST_PIECE windows a content
    known = contents.select("content", "times", "first").join(flags, "content", "left")
    every = F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long"))
    nothing = F.array().cast("array<long>")
    later = F.when(F.col("place") != F.col("first"), every).otherwise(F.coalesce("earlier", nothing))
    other = F.when(F.col("times") > 1, every).otherwise(F.coalesce("anywhere", nothing))
    both = F.explode(F.array(F.struct(F.lit(True).alias("later"), later.alias("at")), F.struct(F.lit(False).alias("later"), other.alias("at"))))
    marked = rows.join(known, "content").select("tid", "start", both.alias("w")).select("tid", "start", "w.later", "w.at")
    # windows in a row become one interval: a window starts one if the one before is not marked
    begins = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    stops = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    pairs = marked.select("tid", "start", "later", F.explode(F.arrays_zip(begins.alias("a"), stops.alias("b"))).alias("p"))
    return pairs.select("tid", "later", (F.col("start") + F.col("p.a")).alias("a"), (F.col("start") + F.col("p.b") + match).alias("b"))


def _merged(spans: Column) -> Column:
    """The union of intervals (a, b), as sorted intervals that do not touch."""
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        joins = (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["b"], F.lit(-1)) >= s["a"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.sort_array(spans), empty, step)


def _found(docs: DataFrame, match: int, hot: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct texts (tid, first_id, copies), those that share an anchor (tid, data), and intervals (tid, later, a, b)."""
    texts = _texts(docs, id_col, text)
    distinct = texts.groupBy("tid").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    shared = _anchors(texts, match).groupBy("key").agg(F.min("text").alias("t0"), F.max("text").alias("t1"), F.max("again").alias("again"))
    keys = shared_table(shared.where("t0 <> t1 or again").select("key"), "factor-keys")
    few = keys.count() <= BROADCAST_KEYS
    met = _all_pieces(texts, match).join(F.broadcast(keys) if few else keys, "key")
    met = shared_table(met.groupBy("tid").agg(F.collect_set(F.struct("key", "start", "n")).alias("met")), "factor-met")
    counts = met.select(F.explode("met.key").alias("key")).groupBy("key").count()
    crowded = shared_table(counts.where(F.col("count") > hot).select("key", F.lit(True).alias("hot")), "factor-crowded")
    total = met.agg(F.sum(F.size("met"))).first()[0] or 0
    lanes = max(total // PIECES_PER_LANE, 1)
    piece = met.select("tid", F.explode("met").alias("m")).select("tid", "m.*")
    piece = piece.join(F.broadcast(crowded) if few else crowded, "key", "left")
    lane = F.pmod(F.xxhash64("key"), F.lit(lanes))
    piece = piece.groupBy("tid").agg(F.collect_list(F.struct("key", "start", "n", lane.alias("lane"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("met"))
    first = texts.groupBy("tid").agg(F.first("data").alias("data"), F.min("id").alias("first_id"))
    sharing = shared_table(first.join(piece, "tid"), "factor-texts")
    cut = _cut(sharing, match)
    plain = cut.where("not hot").groupBy("lane").applyInArrow(_lane(match), "tid binary, later boolean, a long, b long")
    intervals = plain if crowded.isEmpty() else plain.unionByName(_hot(cut.where("hot"), match))
    return distinct, sharing.select("tid", "data"), intervals


def _spans(docs: DataFrame, keep_first: bool, match: int, hot: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct texts, sharing texts, and (tid, spans: merged intervals of bytes) of the texts that lose bytes."""
    distinct, sharing, intervals = _found(docs, match, hot, id_col, text)
    chosen = intervals.where(F.col("later") == keep_first)
    spans = chosen.groupBy("tid").agg(_merged(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return distinct, sharing, spans


def _with_spans(rows: DataFrame, docs: DataFrame, keep_first: bool, match: int, hot: int, id_col: str, text: str) -> DataFrame:
    """``rows`` (tid, id, data, ...) with ``n_bytes`` and ``spans``."""
    distinct, _, found = _spans(docs, keep_first, match, hot, id_col, text)
    out = rows.withColumn("n_bytes", F.octet_length("data").cast("long")).join(distinct.join(found, "tid", "left"), "tid")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b")))
    own = F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= match)
    if keep_first:
        copy = copy & ~F.col("id").eqNullSafe(F.col("first_id"))
    return out.withColumn("spans", F.when(copy, whole).otherwise(own))


def spans(docs: DataFrame, keep_first: bool = True, match: int = MATCH, hot: int = HOT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, spans: array of (a, b)) of every row: the bytes covered by repeated strings of ``match`` bytes.

    With ``keep_first`` the first copy of a string is not covered.
    """
    rows = _texts(docs, id_col, text)
    return _with_spans(rows, docs, keep_first, match, hot, id_col, text).select("id", "n_bytes", "spans")


def without(data: bytes, cuts: list[tuple[int, int]]) -> str:
    """The text without these bytes; a character that is cut in part stays."""
    inside = lambda i: i < len(data) and 0x80 <= data[i] < 0xC0
    kept, at = [], 0
    for a, b in cuts:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            kept.append(data[at:a])
            at = b
    return b"".join([*kept, data[at:]]).decode()


def without_repeats(docs: DataFrame, keep_first: bool = True, match: int = MATCH, hot: int = HOT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with texts that have lost their repeated strings; a null text stays null."""

    @F.pandas_udf("string")
    def cut(data: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([without(d, [(s["a"], s["b"]) for s in f]) for d, f in zip(data, found, strict=True)])

    named = docs.select(F.struct("*").alias("given"), *_text_columns(id_col, text))
    out = _with_spans(named, docs, keep_first, match, hot, id_col, text)
    shorter = F.when(F.size("spans") > 0, cut("data", "spans")).otherwise(F.col(f"given.`{text}`"))
    return out.select(*[shorter.alias(c) if c == text else F.col(f"given.`{c}`").alias(c) for c in docs.columns])


def _kept(sharing: DataFrame, spans: DataFrame) -> DataFrame:
    """(tid, n_removed, n_spans, kept_sha256) of the texts (tid, data) that lose bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in small_batches(batches, 1):
            tids, removed, n, shas = [], [], [], []
            for i in range(b.num_rows):
                data = memoryview(b.column(1)[i].as_buffer())
                found = b.column(2)[i].as_py()
                state, at = sha256(), 0
                for s in found:
                    state.update(data[at : s["a"]])
                    at = s["b"]
                state.update(data[at:])
                tids.append(b.column(0)[i].as_py())
                removed.append(sum(s["b"] - s["a"] for s in found))
                n.append(len(found))
                shas.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tids, pa.binary()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(shas)], names=["tid", "n_removed", "n_spans", "kept_sha256"]
            )

    return sharing.join(spans, "tid").select("tid", "data", "spans").mapInArrow(run, "tid binary, n_removed long, n_spans long, kept_sha256 string")


def digest(docs: DataFrame, match: int = MATCH, hot: int = HOT) -> DataFrame:
    """Every document with the bytes it loses if no copy of a repeated string stays."""
    distinct, sharing, found = _spans(docs, False, match, hot, "doc_id", "text")
    results = distinct.select("tid", "copies").join(_kept(sharing, found), "tid", "left")
    rows = _texts(docs, "doc_id", "text").select("tid", "id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha"))
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= match)
    zero = F.lit(0).cast("long")
    return rows.join(results, "tid").select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
