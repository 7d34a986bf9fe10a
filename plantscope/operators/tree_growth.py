"""Regression trees of binned rows in numpy: what a task does with the rows or cells it holds.

``cols`` holds an array of codes an input: the number of the input's edges below a value, one more than all edges
for a missing value. Trees are arrays in heap order (see ``series_models``). Passes run over blocks of rows whose
arrays stay in a core's cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, factorial

import numpy as np

LEAST_GAIN = 1e-9
SAME_GAIN = 1e-12
BLOCK = 16_384

_P1, _P2, _P3, _P4, _P5 = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
)
_MASK = (1 << 64) - 1


def poisson_steps() -> list[float]:
    """Where a uniform number starts to mean 1, 2, ... of a Poisson draw of mean 1."""
    out, upto = [], 0.0
    for k in range(8):
        upto += exp(-1) / factorial(k)
        out.append(upto)
    return out


_STEPS = [np.uint32(ceil(p * (1 << 30))) for p in poisson_steps()]


def draws(row: np.ndarray, tree: int) -> np.ndarray:
    """Poisson draws of mean 1 from ``xxhash64(row, tree)`` as Spark hashes it, where ``row`` holds ``xxhash64(row)``."""
    h = row + np.uint64((_P5 + 4) & _MASK)
    h ^= np.uint64(tree * _P1 & _MASK)
    h = (h << np.uint64(23)) | (h >> np.uint64(41))
    h *= np.uint64(_P2)
    h += np.uint64(_P3)
    h ^= h >> np.uint64(33)
    h *= np.uint64(_P2)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_P3)
    h ^= h >> np.uint64(32)
    u = (h & np.uint64((1 << 30) - 1)).astype(np.uint32)
    out = (u >= _STEPS[0]).view(np.uint8)
    for step in _STEPS[1:]:
        out += u >= step
    return out


def inner_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Distinct inner quantiles of the known values, interpolated as the exact percentile of Spark."""
    if not len(x):
        return np.zeros(0)
    x = np.sort(x)
    at = (len(x) - 1) * (np.arange(1, bins) / bins)
    low, high = np.floor(at), np.ceil(at)
    a, b = x[low.astype(np.int64)], x[high.astype(np.int64)]
    return np.unique(np.where(a == b, a, (high - at) * a + (at - low) * b))


def coded(x: np.ndarray, null: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.searchsorted(edges, x, "left")
    out[null] = len(edges) + 1
    return out.astype(np.uint8 if len(edges) < 254 else np.uint16)


def histograms(cols: np.ndarray, at: np.ndarray, nodes: int, width: int, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``n`` and ``s`` by (node, input, code); rows at node ``nodes`` are left out."""
    size = (nodes + 1) * width
    hn, hs = np.zeros((len(cols), size)), np.zeros((len(cols), size))
    for a in range(0, len(n), BLOCK):
        b = a + BLOCK
        base, wn, ws = at[a:b] * width, n[a:b], s[a:b]
        for f in range(len(cols)):
            place = base + cols[f, a:b]
            hn[f] += np.bincount(place, wn, size)
            hs[f] += np.bincount(place, ws, size)
    shape = (len(cols), nodes + 1, width)
    return hn.reshape(shape)[:, :nodes].transpose(1, 0, 2), hs.reshape(shape)[:, :nodes].transpose(1, 0, 2)


def best_splits(hn: np.ndarray, hs: np.ndarray, least_rows: float, offered: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of each node the first input (-1 where none is good enough) and code of the largest gain, and the means of its sides.

    Gains that differ by less than sums in another order would are equal, so that trees do not depend on that order.
    """
    nodes, _, width = hn.shape
    ln, ls = hn.cumsum(axis=2), hs.cumsum(axis=2)
    tn, ts = ln[:, :, -1:], ls[:, :, -1:]
    rn, rs = tn - ln, ts - ls
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = ts * ts / tn
        gain = ls * ls / ln + rs * rs / rn - whole
        ok = (ln >= least_rows) & (rn >= least_rows) & (gain > LEAST_GAIN)
    if offered is not None:
        ok &= offered[:, :, None]
    gain = np.where(ok, gain, 0.0).reshape(nodes, -1)
    most = gain.max(axis=1, keepdims=True)
    good = most[:, 0] > 0
    best = (gain >= most - SAME_GAIN * (most + np.nan_to_num(whole[:, 0]))).argmax(axis=1)
    best = np.where(good & (gain[np.arange(nodes), best] > 0), best, gain.argmax(axis=1))
    f, b = np.divmod(best, width)
    k = np.arange(nodes)
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = ls[k, f, b] / ln[k, f, b], rs[k, f, b] / rn[k, f, b]
    return np.where(good, f, -1), np.where(good, b, -1), np.where(good, left, np.nan), np.where(good, right, np.nan)


def _step(cols: np.ndarray, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, nodes: int) -> np.ndarray:
    """Places among the nodes of the next level; rows of a node that is not split go to the place after the last."""
    feature, cut = np.append(feature, -1), np.append(cut, 0)
    out = np.empty(len(at), dtype=np.int64)
    rows = np.arange(min(BLOCK, len(at)))
    for a in range(0, len(at), BLOCK):
        here = at[a : a + BLOCK]
        block = cols[:, a : a + BLOCK]
        f = feature[here]
        code = block[f, rows[: len(here)]]  # -1 is the last input, whose result is not used
        out[a : a + BLOCK] = np.where(f < 0, 2 * nodes, 2 * here + (code > cut[here]))
    return out


def place(cols: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row among the nodes of a level; ``2 ** levels`` where its branch ended before."""
    at = np.zeros(cols.shape[1], dtype=np.int64)
    for level in range(levels):
        nodes = 2**level
        at = _step(cols, at, feature[nodes - 1 : 2 * nodes - 1], cut[nodes - 1 : 2 * nodes - 1], nodes)
    return at


def leaves(cols: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Heap number of the node where each row ends."""
    out = np.zeros(cols.shape[1], dtype=np.int64)
    at = out
    for level in range(depth):
        nodes = 2**level
        at = _step(cols, at, feature[nodes - 1 : 2 * nodes - 1], cut[nodes - 1 : 2 * nodes - 1], nodes)
        out = np.where(at < 2 * nodes, at + 2 * nodes - 1, out)
    return out


def grow(
    cols: np.ndarray, n: np.ndarray, s: np.ndarray, depth: int, width: int, least_rows: float, offer=None, ends: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(feature, cut, value, end) of a tree of rows or cells with weight ``n`` and weighted target ``s``.

    ``offer`` gives the inputs that each node of a level may split by; ``ends`` asks for the node where each row ends.
    """
    feature, cut = np.full(2**depth - 1, -1), np.full(2**depth - 1, -1)
    value = np.full(2 ** (depth + 1) - 1, np.nan)
    value[0] = s.sum() / n.sum()
    at = np.zeros(len(n), dtype=np.int64)
    end = at
    for level in range(depth):
        nodes = 2**level
        here = slice(nodes - 1, 2 * nodes - 1)
        f, b, left, right = best_splits(*histograms(cols, at, nodes, width, n, s), least_rows, offer(nodes) if offer else None)
        feature[here], cut[here] = f, b
        below = slice(2 * nodes - 1, 4 * nodes - 1)
        value[below] = np.column_stack([left, right]).ravel()
        if (f < 0).all():
            break
        if ends or level < depth - 1:
            at = _step(cols, at, f, b, nodes)
        if ends:
            end = np.where(at < 2 * nodes, at + 2 * nodes - 1, end)
    return feature, cut, value, end if ends else None


def boost(
    codes: np.ndarray, n: np.ndarray, total: np.ndarray, rounds: int, depth: int, rate: float, bins: int, least_rows: int
) -> tuple[float, list[tuple], np.ndarray]:
    """Base, trees (feature, bin, value) and predictions of cells with codes, number of rows and sum of the target."""
    cols = np.ascontiguousarray(codes.T)
    base = total.sum() / n.sum()
    now = np.full(len(n), base)
    trees = []
    for _ in range(rounds):
        feature, cut, value, end = grow(cols, n, total - n * now, depth, bins + 1, least_rows, ends=True)
        now = now + rate * value[end]
        trees.append((feature, cut, value))
    return base, trees, now


def cells(cols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order (an array an input) and each row's number among them."""
    if width ** len(cols) < 1 << 62:
        key = np.zeros(cols.shape[1], dtype=np.int64)
        for c in cols:
            key = key * width + c
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        return np.ascontiguousarray(cols[:, first]), at
    found, at = np.unique(cols, axis=1, return_inverse=True)
    return np.ascontiguousarray(found), at.ravel()


def forest(
    cols: np.ndarray, y: np.ndarray, row: np.ndarray | None, which: range, depth: int, width: int, least_rows: float, predict: bool
) -> tuple[list[tuple], np.ndarray | None]:
    """Trees (number, feature, cut, value) of rows and, if asked for, the sum of what they say of each row.

    Rows with the same codes are one cell of a tree, where that makes them fewer.
    """
    trees, said = [], np.zeros(len(y)) if predict else None
    small, at = cells(cols, width)
    merged = 4 * small.shape[1] <= len(y)
    for tree in which:
        w = draws(row, tree) if row is not None else np.ones(len(y), dtype=np.uint8)
        if merged:
            wide = w.astype(float)
            n, s = np.bincount(at, wide, small.shape[1]), np.bincount(at, wide * y, small.shape[1])
            keep = np.flatnonzero(n)
            inputs, n, s = small[:, keep], n[keep], s[keep]
        else:
            keep = np.flatnonzero(w)
            inputs, n = cols[:, keep], w[keep].astype(float)
            s = n * y[keep]
        if not len(keep):
            continue
        feature, cut, value, _ = grow(inputs, n, s, depth, width, least_rows)
        trees.append((tree, feature, cut, value))
        if predict:
            end = value[leaves(small if merged else cols, feature, cut, depth)]
            said += end[at] if merged else end
    return trees, said


def thresholds(feature: np.ndarray, cut: np.ndarray, edges: list[np.ndarray]) -> list[float | None]:
    """None at leaves, and where known values part from missing ones."""
    return [float(edges[f][b]) if f >= 0 and b < len(edges[f]) else None for f, b in zip(feature.tolist(), cut.tolist())]


def listed(value: np.ndarray) -> list[float | None]:
    return [None if np.isnan(v) else v for v in value.tolist()]


class Blocks:
    """Rows of Arrow batches gathered into large blocks, and cut by series: (series, rows as arrays)."""

    def __init__(self, rows: int = 262_144):
        self.rows = rows

    def of(self, batches) -> Iterator[tuple[int, dict[str, np.ndarray], dict[str, np.ndarray]]]:
        import pyarrow as pa

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= self.rows:
                yield from self._cut(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield from self._cut(pa.Table.from_batches(held))

    def _cut(self, table):
        arrays, nulls = columns(table)
        sid = arrays.pop("_sid")
        if (sid == sid[0]).all():
            yield int(sid[0]), arrays, nulls
            return
        order = np.argsort(sid, kind="stable")
        sid = sid[order]
        starts = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(sid))):
            here = order[a:b]
            yield int(sid[a]), {c: v[here] for c, v in arrays.items()}, {c: v[here] for c, v in nulls.items()}


def columns(table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Arrays of a table's columns, and where they are null."""
    arrays = {c: table.column(c).to_numpy() for c in table.column_names}
    return arrays, {c: table.column(c).is_null().to_numpy() for c in table.column_names}


def walk(tables: tuple[np.ndarray, ...], depth: int, sid: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
    """Predictions of rows by the models ``tables`` (feature, threshold, value, base, rate), whose branches all reach ``depth``."""
    feature, threshold, value, base, rate = tables
    _, trees, inner = feature.shape
    feature, threshold, value = feature.ravel(), threshold.ravel(), value.ravel()
    out = np.empty(len(sid))
    for a in range(0, len(sid), BLOCK):
        own = sid[a : a + BLOCK].astype(np.int64)
        m = len(own)
        x = np.concatenate([np.asarray(v[a : a + BLOCK], dtype=float) for v in inputs])
        rows, total = np.arange(m), np.zeros(m)
        first, last = own * (trees * inner), own * (trees * 2**depth)
        for t in range(trees):
            node = np.zeros(m, dtype=np.int64)
            for _ in range(depth):
                at = node + (first + t * inner)
                left = x.take(feature.take(at) * m + rows) <= threshold.take(at)
                node += node
                node += 2
                node -= left
            total += value.take(node + (last + t * 2**depth - inner))
        out[a : a + BLOCK] = base[own] + rate[own] * total
    return out


def filled(feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees (along the last axis) with every branch led on to ``depth``: (feature, threshold, values of the last level)."""
    feature, value = feature.copy(), value.copy()
    for node in range(2**depth - 1):
        ended = feature[..., node] < 0
        for child in (2 * node + 1, 2 * node + 2):
            value[..., child] = np.where(ended, value[..., node], value[..., child])
            if child < 2**depth - 1:
                feature[..., child] = np.where(ended, -1, feature[..., child])
        feature[..., node] = np.where(ended, 0, feature[..., node])
    return feature, threshold, value[..., 2**depth - 1 :]
