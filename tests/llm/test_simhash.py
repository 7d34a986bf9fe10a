"""Fingerprints, links and components against all pairs."""

import random
from collections import Counter, defaultdict

import pytest
from xxhash import xxh64_intdigest

from plantscope.llm import simhash, stars

SCHEMA = "doc_id long, text string, fp string, root string"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_roots(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


def unsigned(x):
    return x % 2**64


def test_fingerprint_matches_definition():
    for t in [None, "", " \n", "One", "one TWO", "É a\x0bb c d", "a a a a a", "x " * 9000]:
        assert unsigned(simhash.fingerprint(t)) == slow_fingerprint(t), t
    rng = random.Random(1)
    t = " ".join(rng.choice(["ab", "Cd", "é", "f"]) for _ in range(300))
    whole = simhash.fingerprint(t)
    simhash.CHUNK = 7
    try:
        assert simhash.fingerprint(t) == whole
    finally:
        simhash.CHUNK = 1 << 16


def test_the_jvm_has_the_same_hash(spark):
    row = spark.sql("select xxhash64('one two thréé') h").first()
    assert unsigned(row.h) == xxh64_intdigest("one two thréé".encode(), 42)


@pytest.mark.parametrize("crowd", [2, 5, 128])
def test_links_join_what_all_pairs_join(spark, crowd):
    rng = random.Random(crowd)
    fps = {0, 2**63, 2**64 - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(12)):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
    dense = rng.getrandbits(64)
    fps |= {dense ^ (k * 3) for k in range(40)}
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    got = {r.node: r.root for r in stars.connected(simhash.links(nodes, crowd)).collect()}
    pairs = simhash.links(nodes, crowd).collect()
    assert all((unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 2 for r in pairs)
    want = slow_roots(fps)
    classes = defaultdict(set)
    for f, r in want.items():
        classes[r].add(f)
    mine = defaultdict(set)
    for (f,) in signed:
        mine[got.get(f, f)].add(unsigned(f))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, classes.values()))


def test_components_and_survivors(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(None, "null id alone"), (7, None), (8, ""), (8, ""), (None, None), (5, "two words"), (4, "TWO words")]
    for g in range(8):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(5):
            t = list(base)
            t[rng.randrange(300)] = f"x{k}"
            rows.append((100 + g * 10 + k, " ".join(t)))
    rows += [(1000 + k, "the same copy many times over") for k in range(200)]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], SCHEMA)
    want = slow_roots({slow_fingerprint(t) for _, t in rows})
    least = {}
    for i, t in rows:
        r = want[slow_fingerprint(t)]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    got = simhash.digest(df).collect()
    expected = Counter(
        (i, f"{slow_fingerprint(t):016x}", least.get(want[slow_fingerprint(t)])) for i, t in rows
    )
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(want.values())) and {i for i in ids if i is not None} == set(least.values())


def test_stars_on_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.root for r in stars.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1000 + i] == 1000 for i in range(1, 400))


def test_empty(spark):
    assert simhash.digest(spark.createDataFrame([], SCHEMA)).collect() == []
