"""Prefix tries against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from plantscope.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, block string, key string, id string, h string, t1 string, pos string"
FIELDS = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whole(rows):
    """Turns of every conversation in order."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            ident = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out[c].append(((t is not None, t or 0), role.encode(), text[:16].encode(), ident, (role, text)))
    return {c: [x[-1] for x in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def slow(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (
            len(p), min(m), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
            sha(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))),
        )
        for p, m in nodes.items()
    )


def rows_of(df, saved):
    return sorted(tuple(r[f if f != "saved" else saved] for f in FIELDS) for r in df.collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    texts = [("user", "hi"), ("assistant", "hi"), ("user", "é" * 5), (None, ""), ("", None), ("user", "x" * 30_000), ("user", "x" * 29_999 + "y")]
    common = [rng.choice(texts) for _ in range(25)]
    rows = []
    for c in rng.sample(range(-20, 200), n):
        turns = common[: rng.randrange(26)] + [rng.choice(texts) for _ in range(rng.randrange(4))]
        rows += [(c, t if t else None, *x) for t, x in enumerate(turns)]
    rows += [(500, t, "user", "again") for t in (1, 1, 1, 0)] + [(None, 1, "user", "lost"), (501, None, None, None), (501, 3, "a", "b"), (501, 3, "a", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width"), [(1, 1), (2, 3), (3, 8)])
def test_trie(spark, seed, width):
    rows = corpus(seed)
    got = prefix_trie.of_conversations(frame(spark, rows), width)
    assert rows_of(got, "saved_bytes") == slow(whole(rows))


def test_digest(spark):
    rows = corpus(7, 120)
    got = prefix_trie.digest(frame(spark, rows))
    assert rows_of(got, "saved_tokens") == slow(rebuilt(whole(rows)))


def test_ends_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(-300, 300)] + [(c, 0, "user", "other") for c in range(1000, 1010)]
    turns = prefix_trie.turn_ids(frame(spark, rows))
    got = prefix_trie.trie(turns.groupBy("conv_id").count().withColumnRenamed("count", "turns"), turns, 2, ends_per_piece=50)
    assert rows_of(got, "saved_bytes") == slow(whole(rows))


def test_turnless_and_empty(spark):
    # conversation 6 is rebuilt from the absent 5, so nothing may be left of it
    alone = [(c, 0, "user", "x") for c in range(1, 40) if c % 5]
    got = prefix_trie.digest(frame(spark, alone))
    want = slow(rebuilt(whole(alone)))
    assert rows_of(got, "saved_tokens") == want and want[0][3] == len(alone)
    assert prefix_trie.digest(frame(spark, [])).count() == 0
    assert prefix_trie.digest(frame(spark, [(None, 0, "user", "x")])).count() == 0
