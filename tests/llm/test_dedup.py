"""Exact dedup, line dedup and sharding against loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from plantscope.llm import line_spread, radix_dedup, secrets, shards

SCHEMA = "doc_id long, text string, source string, size string, keep_id string, _k1 string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def corpus(seed=3):
    rng = random.Random(seed)
    long = "é" * 20_000
    texts = [None, "", "a", "a" * 64, "a" * 65, "a" * 63 + "é", long, long + "x", long[:-1], "\U0001f600" * 200]
    texts += ["a" * 256, "a" * 320, "a" * 319, "b" * 500]
    rows = [(i, rng.choice(texts), f"s{rng.randrange(4)}") for i in range(80)]
    rows += [(i, "hot copy " * 40, "s0") for i in range(100, 160)]
    rows += [rows[0], rows[100], (None, "a", None), (None, None, None), (-5, "a", "s1")]
    return rows


def test_radix_dedup(spark):
    rows = corpus()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    got = radix_dedup.equal_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    low = lambda i: -(2**70) if i is None else i
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter(
        (i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows
    )
    kept = Counter()
    for r in got:
        g = by_sha[r.text_sha256]
        assert r.group_size == len(g) and low(r.keep_id) == max(map(low, g))
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_near_equal_and_gapless(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w" * rng.randrange(200), "s") for i in range(3000)] + [(i, "copy" * 25, "s") for i in range(3000, 4500)]
    rows += [(9000, None, "s"), (None, "", None)]
    got = shards.shard_by_bytes(frame(spark, rows)).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    assert all(r["size"] == len((r.text or "").encode()) + 8 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(24))
    mean = sum(r["size"] for r in got) / 24
    for rs in by.values():
        assert abs(sum(r["size"] for r in rs) - mean) <= 2 * 0.01 * mean + 208
        assert sorted(r.slot for r in rs) == list(range(len(rs)))


def test_shards_keep_small_groups_whole(spark):
    rows = [(i, f"text {i // 3} " * 9, "s") for i in range(30_000)]
    got = shards.shard_by_bytes(frame(spark, rows)).select("text", "shard").distinct().count()
    assert got == 10_000


def test_shards_digest_and_few_rows(spark):
    rows = [(1, "é", "s"), (2, None, "s"), (2, None, "s")]
    got = shards.digest(frame(spark, rows)).collect()
    assert {(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got} == {
        (1, 10, zlib.crc32("é".encode()), "bytes", None),
        (2, 8, 0, "bytes", None),
    }
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3


def lines_by_loop(rows, least):
    sites, first = defaultdict(set), {}
    strip = " \t\n\x0b\x0c\r"
    for i, t, s in rows:
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(strip):
                sites[x.strip(strip)].add(s)
                at = (-(2**70) if i is None else i, p)
                first[x.strip(strip)] = min(first.get(x.strip(strip), at), at)
    out = []
    for i, t, _ in rows:
        keep = [
            x
            for p, x in enumerate((t or "").split("\n"))
            if not x.strip(strip) or len(sites[x.strip(strip)]) < least or first[x.strip(strip)] == (-(2**70) if i is None else i, p)
        ]
        out.append((i, None if t is None else "\n".join(keep)))
    return out


@pytest.mark.parametrize("least", [2, 5, 10])
def test_line_spread(spark, least):
    rng = random.Random(7)
    pool = [f"line {k}" for k in range(60)] + ["", "  ", " ", " é "]
    rows = [
        (i, "\n".join(rng.choice(pool[: 10 + i % 55]) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(9))), f"s{rng.randrange(1 + i % 14)}")
        for i in range(150)
    ]
    rows += [(500, None, "s1"), (501, "", None), (502, "line 1\nline 1\nonly", None), (None, "line 1\nnull id", "s9")]
    got = line_spread.cut_boilerplate(frame(spark, rows), min_sites=least, removed="n").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(lines_by_loop(rows, least))
    lost = {r.doc_id: r.n for r in got}
    assert lost[500] == 0 and sum(lost.values()) > 0


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert radix_dedup.equal_texts(empty).collect() == []
    assert shards.digest(empty).collect() == []
    assert line_spread.digest(empty).collect() == []


def test_names_of_the_callers_columns(spark):
    """Inner names of the operators, in any case, pass through with their values."""
    names = ["_k1", "_K2", "_lane", "_start", "_d1", "_d2", "_cut", "_t", "_base", "_spans", "__cut", "_m_hex", "given", "_out"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, f"one common line of text\nown {i} token=abcdef12", f"s{i}", *names) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    for made in (line_spread.cut_boilerplate(docs), secrets.redact(docs), secrets.scan_spans(docs), shards.shard_by_bytes(docs, shards=2)):
        assert made.columns[: len(docs.columns)] == docs.columns or set(docs.columns) <= set(made.columns)
        assert {tuple(r[n] for n in names) for r in made.collect()} == {tuple(names)} and made.count() == 12
    assert sum("common" in r.text for r in line_spread.cut_boilerplate(docs).collect()) == 1
    assert all("[secret]" in r.text for r in secrets.redact(docs).collect())
