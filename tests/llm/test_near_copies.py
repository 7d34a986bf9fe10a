"""The near-dedup stage against Jaccard similarity by loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantscope.llm import near_copies, simhash, stars

SF = "/root/testdata/sf0.01"


def slow_set(text):
    words = (text or "").encode().lower().split()
    grams = [tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))] if words else []
    return frozenset(grams)


def slow_kept(rows):
    """Of (id, text) the smallest id of each group that pairs of 0.8 and more join."""
    sets = sorted({slow_set(t) for _, t in rows}, key=sorted)
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    at = {}
    for s in sets:
        for g in s:
            at.setdefault(g, []).append(s)
    for s in sets:
        for t in {t for g in s for t in at[g]}:
            if 5 * len(s & t) >= 4 * len(s | t):
                root[find(s)] = find(t)
    least = {}
    for i, t in rows:
        r = find(slow_set(t))
        least[r] = min(least.get(r, i), i)
    return sorted(least.values())


def planted(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    common = " ".join(rng.choice(words) for _ in range(12))
    rows = [(1, None), (2, " "), (3, "Two words"), (4, "two WORDS"), (5, "two other")]
    for g in range(6):
        base = [rng.choice(words) for _ in range(80)]
        for k in range(12):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(80)] = f"x{rng.randrange(9)}"
            rows.append((100 * (g + 1) + k, " ".join(t)))
    rows += [(5000 + k, f"{common} a{k} b{k} c{k}") for k in range(60)]
    rng.shuffle(rows)
    return rows


def test_the_stage_keeps_what_all_pairs_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in kept.collect()) == slow_kept(rows)
    assert len(slow_kept(rows)) < len({t for _, t in rows})


@pytest.mark.parametrize(("crowd", "block", "leaders"), [(32, 256, 2), (2, 4, 0), (2, 100, 1), (128, 512, 3)])
def test_links_of_every_size_of_key(spark, crowd, block, leaders):
    rows = planted(crowd + block)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = near_copies._keyed(docs, near_copies.often(docs), "doc_id", "text")
    nodes = made.groupBy("fp").agg(F.first("h").alias("h"), F.first("n").alias("n"), F.first("marks").alias("marks"), F.first("keys").alias("keys"))
    found = near_copies.links(nodes, docs, crowd=crowd, block=block, leaders=leaders)
    classes = simhash.classes(made, found)
    assert sorted(r.doc_id for r in simhash.first_rows(docs, classes).collect()) == slow_kept(rows)
    assert stars.connected(found).count() > 0


def test_clashing_columns(spark):
    names = ["_id", "__ID", "_h", "_repeat", "fp", "keys", "n", "root"]
    rows = [(1, "a b c d e f", *names), (2, "a b c d e f", *names), (3, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for kept in (near_copies.one_of_each(docs), simhash.one_of_each(docs)):
        assert kept.columns == docs.columns
        assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_simhash_comes_first_and_is_checked(spark, monkeypatch):
    """Links of op2's fingerprints over five words, with similar sets alone; the stage works with them."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    changed = [*base, "other"]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(base[:50])), (4, "a b c d e f " * 9), (5, "a b c d e f " * 50 + "g"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits = {i: simhash.fingerprint(t, 5) for i, t in rows}
    assert ((bits[1] ^ bits[2]) & (2**64 - 1)).bit_count() <= 2
    made = near_copies._keyed(docs, near_copies.often(docs), "doc_id", "text")
    assert {r.id: r.bits for r in made.collect()} == bits
    nodes = made.dropDuplicates(["fp"])
    fps = {r.id: r.fp for r in made.collect()}
    found = {tuple(r) for r in near_copies.simhash_links(nodes, docs).collect()}
    assert (min(fps[1], fps[2]), max(fps[1], fps[2])) in found
    sets = {fps[i]: slow_set(t) for i, t in rows}
    assert all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in found)
    asked, own = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, *a: asked.append(nodes.count()) or own(nodes, *a))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == slow_kept(rows)
    assert asked == [len(set(bits.values()))]


def test_marks_rule_out_long_texts_and_no_near_pair(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for n in (1, 5, 63, 64, 65, 200, 1020, 1030, 4000, 9000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        far = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        most = n // 9  # n + most of n + 2 * most shingles at the least
        near = np.unique(np.concatenate([a[most:], rng.integers(0, 2**63, most, dtype=np.uint64)]))
        longer = np.unique(np.concatenate([a, rng.integers(0, 2**63, n // 4, dtype=np.uint64)]))
        pairs += [(f"far {n}", a, far), (f"near {n}", a, near), (f"longer {n}", a, longer)]
    side = lambda s: (len(s), near_copies.marks(s).view("<i8").tolist())
    rows = spark.createDataFrame([(k, side(a), side(b)) for k, a, b in pairs], "k string, a struct<n:int,marks:array<long>>, b struct<n:int,marks:array<long>>")
    short = lambda c: F.struct(F.col(f"{c}.n").alias("n"), near_copies._short(F.col(f"{c}.marks")).alias("marks"))
    full, cut = near_copies._few_odd(F.col("a"), F.col("b")), near_copies._few_odd(short("a"), short("b"))
    got = {r.k: (r.full, r.cut) for r in rows.select("k", full.alias("full"), cut.alias("cut")).collect()}
    for k, a, b in pairs:
        shared = len(np.intersect1d(a, b))
        if 5 * shared >= 4 * (len(a) + len(b) - shared):
            assert got[k] == (True, True), k
    assert all(got[f"far {n}"][0] is False for n in (63, 64, 65, 200, 1020, 1030, 4000, 9000))
    assert all(got[f"far {n}"][1] is False for n in (200, 1020, 1030, 4000))


def test_rows_that_stay_are_exchanged_once(spark):
    docs = spark.createDataFrame(planted(1), "doc_id long, text string")
    classes = docs.select(F.xxhash64("text").alias("fp"), F.xxhash64("text").alias("root"), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("keep"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = simhash.first_rows(docs, classes)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and kept.count() == docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_of_their_own_leave_before_pairs(spark, monkeypatch):
    """Texts that share a few shingles with many others make no pairs in keys; near copies among them are found."""
    rng = random.Random(8)
    phrases = [[f"p{k}x{i}" for i in range(7)] for k in range(40)]

    def text(k):
        words = [f"u{k}x{i}" for i in range(60)]
        for p in rng.sample(phrases, 3):
            words += [*p, f"u{k}end"]
        return words

    rows = [(k, " ".join(text(k))) for k in range(300)]
    rows += [(1000 + k, f"{t} other{k}") for k, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nothing = (np.zeros(0, "<u8"), np.zeros(0, np.int64))
    made = near_copies._keyed(docs, nothing, "doc_id", "text").cache()
    nodes = made.select("fp", "h", "n", "marks", "keys")
    met = near_copies.in_company(nodes)
    assert {r.id for r in made.join(met, "fp").collect()} == {r for k in range(20) for r in (k, 1000 + k)}
    seen, own = [], near_copies._one_of_same
    monkeypatch.setattr(near_copies, "_one_of_same", lambda members: seen.append(members.count()) or own(members))
    found = near_copies.links(nodes, docs)
    kept = simhash.first_rows(docs, simhash.classes(made, found))
    assert sorted(r.doc_id for r in kept.collect()) == slow_kept(rows) == list(range(300))
    with_room = 40 * max(len(k.keys) for k in made.select("keys").collect())
    assert seen[0] <= with_room


@pytest.mark.parametrize("seed", [1, 2])
def test_every_near_set_is_in_company(spark, seed):
    """Sets of all sizes at the very limit of 0.8, in an order that keeps what they share for the end."""
    rng = np.random.default_rng(seed)
    pairs = []
    for n in (*range(1, 40), 99, 100, 101, 1000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for lost in range(n + 1):
            gained = (5 * (n - lost) - 4 * n) // 4  # as many as 0.8 allows
            if gained >= 0 and lost in (0, 1, n // 9, n // 5):
                b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, gained, dtype=np.uint64)]))
                pairs.append((a, b, np.sort(a[lost:])))
    assert len(pairs) > 80
    rows = []
    for k, (a, b, shared) in enumerate(pairs):
        last = (shared, np.ones(len(shared), np.int64))
        rows += [(2 * k + i, len(s), near_copies.prefix(s, last).view("<i8").tolist()) for i, s in enumerate((a, b))]
    nodes = spark.createDataFrame(rows, "fp long, n int, keys array<long>")
    assert {r.fp for r in near_copies.in_company(nodes).collect()} == {r[0] for r in rows}
    sizes = nodes.select("fp", (near_copies.prefix_size(F.col("n")) + near_copies.further(F.col("n"))).alias("all"), F.size("keys").alias("got"))
    assert all(r.all == r.got for r in sizes.collect())


def test_nothing_to_compare_is_not_compared(spark, monkeypatch):
    """Each plan costs the driver memory: stars take one round, and steps without rows are left out."""
    written, own = [], near_copies.shared_table
    counted = lambda df, tag, by=None: written.append(tag) or own(df, tag, by)
    for module in (near_copies, simhash, stars):
        monkeypatch.setattr(module, "shared_table", counted)
    star = spark.createDataFrame([(1, 5), (1, 7), (2, 9)], "a long, b long")
    assert {tuple(r) for r in stars.connected(star).collect()} == {(5, 1), (7, 1), (9, 2)}
    assert written == ["stars", "stars"]
    written.clear()
    docs = spark.createDataFrame([(k, " ".join(f"u{k}x{i}" for i in range(30))) for k in range(20)], "doc_id long, text string")
    assert near_copies.one_of_each(docs).count() == 20
    assert not {"near-sets", "near-named", "near-links", "near-counts"} & set(written) and written.count("stars") <= 2
