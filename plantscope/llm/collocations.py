"""Phrase collocations by top-order marginalisation: only the longest windows are counted.

Every word occurrence starts one window of ``longest`` words, padded with the empty word where its piece
ends. Windows are counted once; a phrase's frequency is the sum over the windows that start with it, so
Spark's ROLLUP over the positional columns gives all shorter phrases, and its top level the words of a
language.

Before that, counts that no candidate needs are moved to shorter prefixes, exactly: a window rarer than
``least`` gives its count to the window without its last word, as no candidate ends there. Windows are
dealt by their first two words, so this happens where they lie; what is left for the ROLLUP is about the
candidates and the words. Slices of texts are counted before they are sent, so one very common phrase is
an entry a slice, and the windows of one very common word are spread over a sixteenth of all parts.

Joins find the parts of a candidate by (language, words). Arithmetic is decimal with 38 digits: exact up
to frequencies of 5e15.

Defined results: a null text is empty, a null language is ``und``; a text without words adds nothing; a
phrase never crosses a piece; repeated rows count again; ids and extra columns are ignored; an empty
table gives an empty table. A text of any length is read in slices that share ``longest - 1`` words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantscope.llm.common import shared_table, small_batches

LONGEST = 3
LEAST = 10
COVERED = (50, 100)  # a longer candidate with this share of the frequency stands for the shorter one
TOP = 2000
FANIN = 8  # groups of a language's candidates that are ranked together in the next round
SCALE = 1_000_000
BROADCAST_LANGS = 100_000
SLICE = 4 << 20  # bytes of text counted together
BYTES_PER_PARTITION = 8 << 20  # of text, for the exchange of windows
MOST_PARTITIONS = 50_000  # more only if the session asks for them
PARTS_PER_PARTITION = 4  # finer than partitions, so that these are even
PARTS_OF_A_WORD = 16  # the windows of one word lie in this share of the parts, or in eight

# pieces end at . , ; : ! ? and U+000A to U+000D; words at space and tab
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\t", b"\n" * 9 + b" ")


def words_and_cuts(text: bytes) -> list[bytes]:
    """Lower-cased words in order, with b"\\n" between pieces."""
    return [w for w in text.lower().translate(_CUTS).replace(b"\n", b" \n ").split(b" ") if w]


def _slices(text: bytes, most: int) -> Iterator[bytes]:
    """The text cut at spaces or the ends of pieces into parts of about ``most`` bytes."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        while end < len(text) and text[end : end + 1] not in (b" ", b"\n", b"."):
            end += 1
        yield text[at:end]
        at = end


def count_windows(tokens: list[bytes], longest: int, last: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, windows as word numbers, counts) of all starts in ``tokens``, in order of the words.

    Word 0 is the padding. Unless these tokens are the last, the final ``longest - 1`` start no window yet.
    """
    words = sorted(set(tokens) - {b"\n"})
    number = {w: i + 1 for i, w in enumerate(words)} | {b"\n": 0}
    ids = np.array([number[t] for t in tokens], dtype=np.int64)
    ids = np.concatenate([ids, np.zeros(longest, dtype=np.int64)])
    starts = len(tokens) - (0 if last else min(longest - 1, len(tokens)))
    columns, inside = [], np.ones(starts, dtype=bool)
    for k in range(longest):
        inside &= ids[k : k + starts] > 0
        columns.append(np.where(inside, ids[k : k + starts], 0))
    windows = np.stack(columns, axis=1)[columns[0] > 0]
    order = np.lexsort(windows.T[::-1])
    windows = windows[order]
    first = np.ones(len(windows), dtype=bool)
    first[1:] = (windows[1:] != windows[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return [b"", *words], windows[at], np.diff(np.append(at, len(windows)))


def _positions(longest: int) -> list[str]:
    return [f"w{k + 1}" for k in range(longest)]


def _parts(lang: str, words: list[bytes], windows: np.ndarray, parts: int) -> np.ndarray:
    """The part of each window, by its first two words; the windows of one word lie in a sixteenth of all parts."""
    spread = max(8, parts // PARTS_OF_A_WORD)
    seed = crc32(lang.encode())
    codes = np.array([crc32(w, seed) for w in words], dtype=np.uint64)
    first, second = codes[windows[:, 0]], codes[windows[:, 1]]
    return ((first + (first * np.uint64(31) + second * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(spread)) % np.uint64(parts)).astype(np.int64)


def _lines(lang: str, counted: tuple[list[bytes], np.ndarray, np.ndarray], parts: int) -> Iterator[tuple[int, str, str]]:
    """(part, lang, lines): the windows of a part, a line for each first two words: ``w1 w2 TAB w3 n TAB w3 n ...``."""
    words, windows, counts = counted
    part = _parts(lang, words, windows, parts)
    order = np.argsort(part, kind="stable")  # in a part the windows stay in order
    part, windows, counts = part[order], windows[order], counts[order]
    head = np.ones(len(windows), dtype=bool)
    head[1:] = (windows[1:, :2] != windows[:-1, :2]).any(axis=1) | (part[1:] != part[:-1])
    name = [w.decode() for w in words]
    tails = [" ".join([name[i] for i in w]) for w in windows[:, 2:].tolist()] if windows.shape[1] > 3 else [name[i] for i in windows[:, 2:].ravel().tolist()]
    if windows.shape[1] == 2:
        tails = [""] * len(windows)
    pieces = [
        f"\n{name[a]} {name[b]}\t{tail} {n}" if new else f"\t{tail} {n}"
        for (a, b), tail, n, new in zip(windows[:, :2].tolist(), tails, counts.tolist(), head.tolist(), strict=True)
    ]
    ends = np.flatnonzero(np.diff(part, append=-1)) + 1
    at = 0
    for end in ends.tolist():
        yield int(part[at]), lang, "".join(pieces[at:end])[1:]
        at = end


def _counted(lang: str, given: Iterable[bytes], longest: int, parts: int) -> Iterator[tuple[int, str, str]]:
    carry: list[bytes] = []
    given = iter(given)
    now = next(given, None)
    while now is not None:
        following = next(given, None)
        tokens = carry + words_and_cuts(now)
        yield from _lines(lang, count_windows(tokens, longest, following is None), parts)
        carry = tokens[len(tokens) - min(longest - 1, len(tokens)) :]
        now = following


def windows(
    docs: DataFrame, longest: int = LONGEST, text: str = "text", lang: str = "lang", slice_bytes: int = SLICE, partitions: int | None = None
) -> DataFrame:
    """(part, lang, w1, ..., n): the padded longest windows, counted slice by slice and dealt by part.

    They travel as lines, which take a third of the space of rows; a part is a function of the language and
    the first two words.
    """
    n = partitions or _partitions(docs, text)
    parts = PARTS_PER_PARTITION * n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1, slice_bytes):
            by_lang: dict[str, list[bytes]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(name, []).append(t.encode())
            for name, texts in by_lang.items():
                rows = list(_counted(name, _slices(b"\n".join(texts), slice_bytes), longest, parts))
                yield pa.RecordBatch.from_pylist([{"part": p, "lang": g, "lines": x} for p, g, x in rows], schema)

    schema = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("lines", pa.string())])
    given = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = given.mapInArrow(run, "part long, lang string, lines string").repartition(n, "part")
    lines = dealt.select("part", "lang", F.explode(F.split("lines", "\n")).alias("line")).withColumn("line", F.split("line", "\t"))
    tails = lines.select("part", "lang", F.split(F.get("line", F.lit(0)), " ").alias("head"), F.explode(F.slice("line", 2, 2**31 - 1)).alias("tail"))
    tails = tails.withColumn("tail", F.split("tail", " "))
    pos = _positions(longest)
    named = [F.get("head", F.lit(k)).alias(pos[k]) for k in range(2)] + [F.get("tail", F.lit(k - 2)).alias(pos[k]) for k in range(2, longest)]
    return tails.select("part", "lang", *named, F.element_at("tail", -1).cast("long").alias("n"))


def _moved_to_prefixes(counted: DataFrame, longest: int, least: int) -> DataFrame:
    """The same occurrences with the counts of windows rarer than ``least`` moved to shorter prefixes.

    ``counted`` holds each window once and is dealt by part, so that windows of the same first two words lie
    together; no step but the last sends rows.
    """
    pos = _positions(longest)
    rows = counted.withColumn("total", F.col("n"))
    for k in range(longest, 1, -1):
        # the total of a prefix of k words: its own rest, and the longer windows that were kept
        if k < longest:
            longer = F.col(pos[k]) != ""
            own = F.struct(*pos, "n", F.col("n").alias("total"))
            short = F.struct(*pos[:k], *[F.lit("").alias(p) for p in pos[k:]], F.lit(0).cast("long").alias("n"), F.col("n").alias("total"))
            rows = rows.select("part", "lang", F.explode(F.when(longer, F.array(own, short)).otherwise(F.array(own))).alias("r"))
            rows = rows.select("part", "lang", "r.*").groupBy("part", "lang", *pos).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        ends = F.col(pos[k]) == "" if k < longest else F.lit(True)
        rare = ends & (F.col("total") < least)
        rows = rows.withColumn(pos[k - 1], F.when(rare, "").otherwise(F.col(pos[k - 1])))
    return rows.groupBy("lang", *pos).agg(F.sum("n").alias("n"))


def _partitions(docs: DataFrame, text: str) -> int:
    """Partitions for the windows, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(total // BYTES_PER_PARTITION, MOST_PARTITIONS))


def frequencies(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, w1, ..., len, n) of all words (len 1), all phrases of ``least`` and more, and the languages (len 0)."""
    pos = _positions(longest)
    counted = windows(docs, longest, text, lang).groupBy("part", "lang", *pos).agg(F.sum("n").alias("n"))
    left = _moved_to_prefixes(counted, longest, least)
    sets = ", ".join(pos)
    rolled = left.sparkSession.sql(
        f"SELECT lang, {sets}, grouping_id() AS g, sum(n) AS n FROM {{left}} GROUP BY lang, ROLLUP({sets})", left=left
    )
    # grouping_id has one bit a position that is summed over
    length = longest - F.bit_count("g")
    rolled = rolled.withColumn("len", length)
    last = F.get(F.array(*pos), F.col("len") - 1)
    padded = F.coalesce(last == "", F.lit(False))
    return rolled.where(~padded).select("lang", *pos, F.col("len").cast("int").alias("len"), "n")


def _phrase(names: list[str]) -> Column:
    return F.concat_ws(" ", *names)


def _scores(candidates: DataFrame, parts: DataFrame, length: int, scale: int) -> DataFrame:
    """The candidates of one length with the cut of the lowest score."""
    pos = _positions(length)
    out = candidates
    for k in range(1, length):
        for side, names in ((f"l{k}", pos[:k]), (f"r{k}", pos[k:])):
            known = parts.where(F.col("len") == len(names)).select("lang", F.col("phrase").alias("part"), F.col("n").alias(side))
            out = out.withColumn("part", _phrase(names)).join(known, ["lang", "part"]).drop("part")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = [
        F.struct(
            F.call_function("div", F.lit(scale).cast("decimal(38,0)") * wide("a") * wide("a"), wide(f"l{k}") * wide(f"r{k}")).alias("score"),
            F.lit(k).alias("k"),
            F.col(f"l{k}").alias("l"),
            F.col(f"r{k}").alias("r"),
        )
        for k in range(1, length)
    ]
    return out.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", *pos, "a", "cut.*")


def mined(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: tuple[int, int] = COVERED, scale: int = SCALE, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, phrase, words, a, l, r, k, n, score) of every candidate that no longer one covers."""
    pos = _positions(longest)
    found = frequencies(docs, longest, least, text, lang)
    table = shared_table(found.where((F.col("len") == 0) | (F.col("n") >= least)).withColumn("phrase", _phrase(pos)), "phrases")
    total = table.where("len = 0").select("lang", F.col("n").alias("total"))
    kept = []
    for length in range(2, longest + 1):
        own = table.where(F.col("len") == length)
        scored = _scores(own.select("lang", *pos[:length], F.col("n").alias("a")), table, length, scale)
        scored = scored.withColumn("phrase", _phrase(pos[:length]))
        inside = [
            F.struct(_phrase(pos[at : at + length]).alias("phrase"), F.lit(longer).alias("of"))
            for longer in range(length + 1, longest + 1)
            for at in range(longer - length + 1)
        ]
        if inside:
            # windows of this length inside longer candidates, and the most frequent of these
            longer = table.where(F.col("len") > length).select("lang", "len", "n", F.explode(F.array(*inside)).alias("i")).where("i.of = len")
            most = longer.groupBy("lang", F.col("i.phrase").alias("phrase")).agg(F.max("n").alias("most"))
            scored = scored.join(most, ["lang", "phrase"], "left").where(
                F.col("most").isNull() | (covered[1] * F.col("most") < covered[0] * F.col("a"))
            )
        words = F.array(*pos[:length]).alias("words")
        kept.append(scored.select("lang", "phrase", words, "a", "l", "r", "k", "score"))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    # one row a language; joined by exchange, the candidates of a language would meet in one task
    total = total.withColumnRenamed("total", "n")
    return out.join(F.broadcast(total) if total.count() <= BROADCAST_LANGS else total, "lang")


def digest(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language, found in rounds of fewer and fewer groups a language.

    However many partitions hold a language's candidates, no task of the later rounds reads more than
    ``FANIN * top`` of them.
    """
    ranked = mined(docs)
    for groups in (FANIN * FANIN, FANIN, 1):
        group = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        order = Window.partitionBy("lang", group).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


DIGEST_SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), s AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), o AS (
    SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: {'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}), recursive := true) FROM s
), n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
f1 AS (SELECT lang, a, count(*) AS f FROM o GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS f FROM o WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM o WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
    SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
    FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b WHERE f2.f >= 10
    UNION ALL
    SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 1, x.f, y.f
    FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
    UNION ALL
    SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, f3.f, 2, x.f, y.f
    FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c
), scored AS (
    SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, a || ' ' || b AS phrase, f FROM f3 UNION ALL SELECT lang, b || ' ' || c, f FROM f3
    ) GROUP BY ALL
), kept AS (
    SELECT best.* FROM best LEFT JOIN inside i ON i.lang = best.lang AND i.phrase = best.phrase
    WHERE i.f IS NULL OR 100 * i.f < 50 * best.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
