"""Encoding and decoding against the tokenizers library."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plantscope.llm import bpe_tree
from plantscope.llm.tokens import load

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, row string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n, size):
    rng = random.Random(seed)
    pools = [
        "abcdefghij",
        "aeiouth ",
        "0123456789",
        "'\"!?.,-_=+#",
        " \n\t\r 　",
        "éèñßöçÉ",
        "日本語テキスト漢字",
        "\U0001f600\U0001f469‍́",
        "it's we'll they've 'tis !'s ''t ",
    ]
    for _ in range(n):
        out = []
        while sum(map(len, out)) < size:
            pool = rng.choice(pools)
            k = rng.choice([1, 2, 3, 5, 20, 90])
            start = rng.randrange(len(pool))
            out.append("".join(rng.choices(pool, k=k)) if rng.random() < 0.7 else (pool * 20)[start : start + k])
            if rng.random() < 0.03:
                out.append("<|endoftext|>")
        yield "".join(out)


@pytest.mark.parametrize("leaf", [1, 5, 17, 64])
def test_tree_equals_the_library(library, leaf):
    bpe = load(PATH)
    for t in [*texts(leaf, 60, 400), "a" * 700, " " * 300 + "x", "ab" * 300, "'s" * 100, "é" * 200, "thethe" * 80, "<|endoftext|>" * 9]:
        parts = [bpe.encode(x) for x in bpe_tree.leaves(t, leaf, tuple(bpe.special))]
        got = bpe_tree.join_all(bpe, parts)
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids
        assert bpe.decode_bytes(got).decode() == library.decode(got.tolist(), skip_special_tokens=False) == t


def test_long_unsplit_texts(library):
    bpe, rng = load(PATH), random.Random(11)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "aeinrst", "0123456789", "éa", "=-"):
        t = "".join(rng.choices(alphabet, k=6000))
        parts = [bpe.encode(x) for x in bpe_tree.leaves(t, 100, tuple(bpe.special))]
        assert bpe_tree.join_all(bpe, parts).tolist() == library.encode(t, add_special_tokens=False).ids


def test_broken_bytes_decode_as_the_library_does(library):
    bpe, rng = load(PATH), random.Random(2)
    for _ in range(300):
        ids = np.array([rng.randrange(50257) for _ in range(12)] + [rng.randrange(256) for _ in range(8)], dtype="<u4")
        assert bpe.decode_bytes(ids).decode("utf-8", "replace") == library.decode(ids.tolist(), skip_special_tokens=False)


def test_query(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(77, 30, 900))] + [(100, None), (101, ""), (None, "x"), (3, "again")]
    rows += [(200, "unsplit" * 1200), (200, "unsplit" * 1200)]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], SCHEMA)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe_tree.digest(df).collect()) == want
    small = bpe_tree.encode(df, leaf=500).collect()
    assert Counter((r.id, hashlib.sha256(r.ids).hexdigest()) for r in small) == Counter(
        {k: sum(n for (a, _, b, _), n in want.items() if (a, b) == k) for k in {(a, b) for a, _, b, _ in want}}
    )
    assert bpe_tree.digest(df.where("doc_id < 0")).collect() == []
