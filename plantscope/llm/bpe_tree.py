"""BPE encoding and decoding; long texts by tree concatenation.

A text of up to ``LEAF`` characters is encoded at once. A longer one is cut into leaves, which travel to
different tasks and are encoded in parallel; then neighbours are joined pairwise, level by level. At each
join a window of tokens on both sides is decoded and encoded again. If it begins with the left side's own
tokens and ends with the right side's own, the join is exact; otherwise the window doubles, up to both
whole sides.

Why agreement proves it: byte-pair merging yields a token sequence exactly when each two neighbouring
tokens are what their own concatenation encodes to. In the joined sequence every pair of neighbours is a
pair of the left encoding, of the window or of the right encoding, each of which is valid. Windows start
where the splitting expression, which reads left to right without memory, finds the same boundaries as in
the whole text: at a whole character that is no apostrophe, and some characters before the join.

Defined results: a null text is an empty text without tokens; strings of special tokens become that
token, and leaves are never cut inside one; rows are independent, so repeated rows and null ids give
repeated results; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.llm.common import small_batches
from plantscope.llm.tokens import ByteBpe, default_path, load

LEAF = 1 << 15  # characters
FIRST_WINDOW = 16  # tokens on each side
AGREE = 2  # tokens that must be equal at either end of the window
SAFE_BYTES = 16  # a window starts at least so many bytes before the join: splitting looks ahead no further
NO_IDS = np.zeros(0, dtype=np.uint32)


def leaves(text: str, leaf: int, specials: tuple[str, ...]) -> list[str]:
    """Halve until every part is short enough; never inside the string of a special token."""
    if len(text) <= leaf:
        return [text]
    cut = len(text) // 2
    for s in specials:
        at = text.find(s, max(cut - len(s) + 1, 0), cut + len(s) - 1)
        if 0 <= at < cut < at + len(s):
            cut = at or at + len(s)
    if not 0 < cut < len(text):
        return [text]
    return leaves(text[:cut], leaf, specials) + leaves(text[cut:], leaf, specials)


def _starts(first: int) -> bool:
    """May a window start with this byte? Not inside a character, and not at an apostrophe."""
    return first & 0xC0 != 0x80 and first != 0x27


def join(bpe: ByteBpe, a: np.ndarray, b: np.ndarray, window: int = FIRST_WINDOW) -> np.ndarray:
    """The ids of the concatenated texts from the ids of either."""
    if not len(a) or not len(b):
        return np.concatenate([a, b])
    while True:
        i, j = max(len(a) - window, 0), min(window, len(b))
        while i and (not _starts(bpe.pieces[a[i]][0]) or bpe.lengths[a[i:]].sum() < SAFE_BYTES):
            i -= 1
        while j < len(b) and bpe.pieces[b[j]][0] & 0xC0 == 0x80:
            j += 1
        text = (bpe.decode_bytes(a[i:]) + bpe.decode_bytes(b[:j])).decode("utf-8")
        c = bpe.encode(text)
        left = i == 0 or (len(c) > AGREE and np.array_equal(c[:AGREE], a[i : i + AGREE]))
        right = j == len(b) or (len(c) > AGREE and np.array_equal(c[-AGREE:], b[j - AGREE : j]))
        if left and right:
            return np.concatenate([a[:i], c, b[j:]])
        window *= 2


def join_all(bpe: ByteBpe, parts: list[np.ndarray]) -> np.ndarray:
    while len(parts) > 1:
        pairs = [join(bpe, parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(pairs) * 2 :]
    return parts[0] if parts else NO_IDS


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4", copy=False).tobytes() for x in arrays], pa.binary())


def encode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text", leaf: int = LEAF
) -> DataFrame:
    """(id, ids: little-endian unsigned 32-bit integers) of every row. ``path``: a byte-level tokenizer file."""
    path = path or default_path()
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in small_batches(batches, 1):
            ids = _packed([bpe.encode(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = tuple(load(path).special)
        for b in batches:
            for k in range(b.num_rows):
                parts = leaves(b.column(2)[k].as_py(), leaf, specials)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column(0)[k].as_py()] * n, pa.int64()),
                        pa.array([b.column(1)[k].as_py()] * n, b.column(1).type),
                        pa.array(range(n), pa.int32()),
                        pa.array(parts, pa.string()),
                    ],
                    names=["row", "id", "leaf", "text"],
                )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in small_batches(batches, 3):
            ids = _packed([bpe.encode(t) for t in b.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids], names=["row", "id", "leaf", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        """All leaves of one document."""
        table = table.sort_by("leaf")
        parts = [np.frombuffer(x, dtype="<u4") for x in table.column("ids").to_pylist()]
        return pa.table({"id": table.column("id").slice(0, 1), "ids": _packed([join_all(load(path), parts)])})

    out = f"id {kind}, ids binary"
    short = own.where(F.char_length("text") <= leaf).mapInArrow(whole, out)
    numbered = own.where(F.char_length("text") > leaf).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    parts = numbered.mapInArrow(cut, f"row long, id {kind}, leaf int, text string").repartition("row", "leaf")
    encoded = parts.mapInArrow(each, f"row long, id {kind}, leaf int, ids binary")
    return short.unionByName(encoded.groupBy("row").applyInArrow(joined, out))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, ids, text) from (id, ids); bytes that are not UTF-8 become the replacement character."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in small_batches(batches, 1):
            texts = [
                bpe.decode_bytes(np.frombuffer(x, dtype="<u4")).decode("utf-8", "replace") for x in b.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {dict(encoded.dtypes)['id']}, ids binary, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    back = decode(encode(docs, path), path)
    return back.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
