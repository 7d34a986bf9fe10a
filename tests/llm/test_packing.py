"""Packing: every id once, in order, in full sequences; the solver against a dense one."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plantscope.llm import packing, patterns

SCHEMA = "doc_id long, text string, ids string, rest string"


def check_plan(counts, window):
    made = patterns.plan(counts, window)
    taken = defaultdict(list)
    for n in range(1, window):
        for rank in range(int(counts[n])):
            parts = patterns.place(made, n, rank)
            assert [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts])[:-1]) and sum(p[1] for p in parts) == n
            for _, length, seq, offset in parts:
                taken[seq].append((offset, length))
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    total = int((counts * np.arange(window)).sum())
    assert len(taken) == -(-total // window)
    return made


@pytest.mark.parametrize("seed", range(6))
def test_plans_fill_every_sequence(seed):
    rng = np.random.default_rng(seed)
    window = 64
    counts = rng.integers(0, [1, 2, 5, 30, 200, 3][seed], window)
    if seed == 5:
        counts[:] = 0
        counts[40] = 500  # one length that no combination can use
    counts[0] = 7
    made = check_plan(counts, window)
    if seed >= 3 and seed != 5:
        assert made.sequences > 0.6 * (counts * np.arange(window)).sum() / window


def test_solution_is_a_least_squares_minimum():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 24)
    combos = patterns.combinations(counts, 24)
    assert (combos.sum(axis=1) == 24).all()
    a = np.zeros((24, len(combos)))
    for k, c in enumerate(combos):
        for n in c[c > 0]:
            a[n, k] += 1
    target = counts.astype(float)
    target[0] = 0
    x = patterns.solve(counts, combos, 20_000, 1e-6)
    best = np.zeros(len(combos))
    for _ in range(3000):  # cyclic coordinate descent
        for k in range(len(combos)):
            best[k] = max(0.0, best[k] + a[:, k] @ (target - a @ best) / (a[:, k] @ a[:, k]))
    loss = lambda v: ((a @ v - target) ** 2).sum()
    assert (x >= 0).all() and loss(x) <= loss(best) + 1e-3


def test_pack(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    words = ["alpha", "Beta", "éé", "\n", "  ", "123", "of", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 900)))) for i in range(150)]
    rows += [(i, "same copy " * 300) for i in range(500, 560)] + [(900, None), (901, ""), (None, "x"), (7, "x"), (7, "x")]
    rows += [(950, "long " * 20_000)]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], SCHEMA)
    got = packing.pack(df).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.id].append(r)
    short = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
        short += at < 1024
    assert short <= 1
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert set(docs) == set(want)
    for i, texts in want.items():
        pieces = sorted(docs[i], key=lambda r: r.start)
        if len(texts) == 1:
            assert b"".join(r.ids for r in pieces) == texts[0]
            assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
            assert {r.doc_tokens for r in pieces} == {len(texts[0]) // 4}
        else:
            assert sum(len(r.ids) for r in pieces) == sum(map(len, texts))
    digests = packing.digest(df.where("doc_id = 7 or doc_id = 901")).collect()
    assert len(digests) == 4 and {r.ids_crc32 for r in digests if r.doc_id == 901} == {zlib.crc32(b"\0" * 4)}


def test_empty(spark):
    assert packing.digest(spark.createDataFrame([], SCHEMA)).collect() == []
