"""Length combinations that fill a window, and how often to use each: non-negative least squares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 3  # lengths in a combination
STEPS = 2000
TOLERANCE = 1e-3  # of the largest count: how far the optimality conditions may be off


def combinations(counts: np.ndarray, window: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of two to ``depth`` lengths that occur and sum to ``window``, one a row, padded with 0.

    ``counts[n]`` is how many pieces have length n. There are at most about window**2 / 12 triples.
    """
    have = np.flatnonzero(counts[:window])
    have = have[have > 0]
    out = []
    for a in have:
        b = window - a
        if b >= a and b < len(counts) and counts[b]:
            out.append([(a, b, 0)])
        if depth >= 3:
            rest = window - a
            bs = have[(have >= a) & (2 * have <= rest)]
            bs = bs[counts[rest - bs] > 0]
            out.append(np.stack([np.full_like(bs, a), bs, rest - bs], axis=1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), dtype=np.int64)


def solve(counts: np.ndarray, combos: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|**2, where A says how often a combination uses a length.

    Accelerated projected gradient steps, restarted when they stop descending, until the optimality
    conditions hold within ``tolerance``; after ``steps`` the best point so far is taken, as rounding and
    the packing of what is left are exact for any x.
    """
    if not len(combos):
        return np.zeros(0)
    width = len(counts)
    target = counts.astype(float)
    target[0] = 0
    flat = combos.ravel()

    def gradient(x: np.ndarray) -> np.ndarray:
        used = np.bincount(flat, weights=np.repeat(x, combos.shape[1]), minlength=width)
        used[0] = 0
        return (used - target)[combos].sum(axis=1)

    # the largest eigenvalue of A'A, by power steps
    zero, v, top = gradient(np.zeros(len(combos))), np.ones(len(combos)), 1.0
    for _ in range(30):
        w = gradient(v) - zero
        top = float(np.linalg.norm(w)) / float(np.linalg.norm(v))
        v = w / max(float(np.linalg.norm(w)), 1e-300)
    step = 0.95 / max(top, 1.0)
    x = y = np.zeros(len(combos))
    t, limit = 1.0, tolerance * target.max()
    for n in range(steps):
        g = gradient(y)
        new = np.maximum(y - step * g, 0)
        if np.dot(y - new, new - x) > 0:
            t = 1.0
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = np.maximum(new + (t - 1) / t_next * (new - x), 0), new, t_next
        if n % 25 == 24:
            g = gradient(x)
            if max(np.abs(g[x > 0]).max(initial=0), (-g[x == 0]).max(initial=0)) <= limit:
                break
    return x


@dataclass(frozen=True)
class Ranges:
    """For one length: pieces of rank in [ends[k-1], ends[k]) belong to range k.

    Range k fills sequences ``first[k]``, ``first[k] + 1``, ... one piece each, at ``offset[k]``.
    """

    ends: np.ndarray
    first: np.ndarray
    offset: np.ndarray


@dataclass(frozen=True)
class Plan:
    window: int
    ranges: dict[int, Ranges]
    used: np.ndarray  # pieces of each length that combinations take; those of higher rank are left over
    before: np.ndarray  # tokens left over of longer pieces
    sequences: int  # sequences that combinations fill
    left_over: int  # tokens left over


def plan(counts: np.ndarray, window: int, depth: int = DEPTH) -> Plan:
    """``counts[n]``, n < window: pieces of length n.

    Combinations are taken in descending order of their solution, as often as it says, rounded up, while
    pieces are left: a solution over many combinations has many values below one. What is left
    over is packed greedily, longest first, one after the other; a piece that meets the end of a sequence
    is cut there, so that one sequence at most is not full.
    """
    combos = combinations(counts, window, depth)
    solved = solve(counts, combos)
    times = np.ceil(np.where(solved > 1e-6, solved, 0)).astype(np.int64)
    left = counts.astype(np.int64).copy()
    used = np.zeros(window, dtype=np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequences = 0
    for k in np.argsort(-solved, kind="stable"):
        if not times[k]:
            break
        lengths = [int(n) for n in combos[k] if n]
        often = min(int(times[k]), *(int(left[n]) // lengths.count(n) for n in lengths))
        if often <= 0:
            continue
        at = 0
        for n in lengths:
            used[n] += often
            left[n] -= often
            found.setdefault(n, []).append((int(used[n]), sequences, at))
            at += n
        sequences += often
    ranges = {n: Ranges(*(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))) for n, rows in found.items()}
    tokens = left[:window] * np.arange(window)
    before = np.concatenate([np.cumsum(tokens[::-1])[::-1][1:], [0]])
    return Plan(window, ranges, used, before, sequences, int(tokens.sum()))


def place(plan: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the parts of the piece of this length and rank."""
    if rank < plan.used[length]:
        r = plan.ranges[length]
        k = int(np.searchsorted(r.ends, rank, side="right"))
        begin = int(r.ends[k - 1]) if k else 0
        return [(0, length, int(r.first[k]) + rank - begin, int(r.offset[k]))]
    at = int(plan.before[length]) + (rank - int(plan.used[length])) * length
    out, start = [], 0
    while start < length:
        offset = (at + start) % plan.window
        n = min(length - start, plan.window - offset)
        out.append((start, n, plan.sequences + (at + start) // plan.window, offset))
        start += n
    return out
