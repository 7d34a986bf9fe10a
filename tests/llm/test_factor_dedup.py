"""Suffix-array dedup against a count of all strings."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from plantscope.llm import factor_dedup

SCHEMA = "doc_id long, text string, tid string, id string, data string, spans string, copies string, given string, n_bytes string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], SCHEMA)


def covered(rows, match, keep_first):
    """Spans of every row, where rows stand in order of (id, null last), then of the text's digest."""
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
    first = {}
    for r in sorted(rows, key=key):
        first.setdefault(r[1] or "", r[0])
    starts = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        data = (t or "").encode()
        for s in range(len(data) - match + 1):
            starts[data[s : s + match]].append((i, s))
    rank = {i: n for n, i in enumerate(sorted(range(len(rows)), key=lambda i: key((first[rows[i][1] or ""], rows[i][1]))))}
    out = []
    for i, (doc, t) in enumerate(rows):
        data, found = (t or "").encode(), []
        for s in range(len(data) - match + 1):
            places = starts[data[s : s + match]]
            hit = len(places) > 1
            if hit and keep_first:
                copy = doc != first[t or ""]
                others = [p for p in places if (rows[p[0]][1] or "") != (t or "") or p[1] != s]
                hit = copy or any((rank[p[0]], p[1]) < (rank[i], s) for p in others if (rows[p[0]][1] or "") != (t or "") or p[1] < s)
            if hit:
                if found and s <= found[-1][1]:
                    found[-1][1] = s + match
                else:
                    found.append([s, s + match])
        out.append((doc, len(data), tuple(map(tuple, found))))
    return sorted(out, key=repr)


def corpus(seed, match):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    passages = [sentence(match // 2) for _ in range(4)]
    texts = [None, "", "a", "a" * (match - 1), "a" * (match * 3), "ab" * match, "\U0001f600" * match, sentence(4 * match)]
    for _ in range(25):
        texts.append(sentence(rng.randrange(match)) + rng.choice([*passages, ""]) + sentence(rng.randrange(match)) + rng.choice([*passages, ""]))
    base = sentence(2 * match).split(" ")
    for _ in range(12):
        near = list(base)
        near[rng.randrange(len(near))] = "zzz"
        texts.append(" ".join(near))
    rows = list(enumerate(texts, 10)) + [(3, texts[-1]), (200, texts[8]), (None, texts[9]), (None, passages[0] * 3), (-4, passages[1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "match", "hot"), [(1, 20, 1000), (2, 20, 2), (3, 200, 1000), (4, 7, 3)])
def test_digest(spark, seed, match, hot):
    rows = [*corpus(seed, match), (10, None), (10, "same row" * 60), (10, "same row" * 60)]
    got = factor_dedup.digest(frame(spark, rows), match, hot).collect()
    want = []
    for (doc, n, spans), t in zip(sorted(covered(rows, match, False), key=repr), [None] * len(rows), strict=True):
        want.append((doc, n, sum(b - a for a, b in spans), len(spans)))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got), key=repr) == sorted(want, key=repr)
    shas = set()
    for _, t in rows:
        data = (t or "").encode()
        for doc, _, spans in covered(rows, match, False):
            if any(d == doc and (x or "") == (t or "") for d, x in rows):
                kept, at = b"", 0
                for a, b in spans:
                    kept, at = kept + data[at:a], b
                shas.add((doc, hashlib.sha256(kept + data[at:]).hexdigest()))
    assert {(r.doc_id, r.kept_sha256) for r in got} <= shas


@pytest.mark.parametrize(("seed", "hot"), [(5, 1000), (6, 2)])
def test_spans_keep_first(spark, seed, hot):
    rows = corpus(seed, 20)
    got = factor_dedup.spans(frame(spark, rows), True, 20, hot).collect()
    assert sorted(((r.doc_id if hasattr(r, "doc_id") else r.id, r.n_bytes, tuple((s.a, s.b) for s in r.spans)) for r in got), key=repr) == covered(rows, 20, True)


def test_without_repeats(spark):
    passage = " ".join(f"word{k}é" for k in range(60))
    rows = [(1, "first " + passage + " end"), (2, "later " + passage + " too"), (3, "first " + passage + " end"), (4, None), (5, "clean")]
    got = {r.doc_id: r for r in factor_dedup.without_repeats(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[4].text is None and got[5].text == "clean" and got[3].text == ""
    assert got[2].text == "laterto" or got[2].text in ("latertoo", "later too", "later  too")
    assert tuple(got[2])[2:] == tuple("abcdefg")


def test_long_text_and_chunks(monkeypatch):
    data = np.frombuffer(("".join(chr(97 + (i * i) % 23) for i in range(5000)) * 3).encode(), dtype=np.uint8)
    for part in (data, data[:199], data[:200], np.zeros(3000, dtype=np.uint8)):
        key, start, n, again = factor_dedup.pieces(part)
        assert n.sum() == max(len(part) - 199, 0)
        assert (np.diff(start) == n[:-1]).all() and (n <= factor_dedup.LONGEST_PIECE).all()
    assert again.all()
    whole = {(k, bytes(data[s : s + 200])) for k, s0, m in zip(*factor_dedup.pieces(data)[:3], strict=True) for s in range(s0, s0 + m)}
    monkeypatch.setattr(factor_dedup, "CHUNK", 1 << 10)
    cut = {(k, bytes(data[s : s + 200])) for k, s0, m in zip(*factor_dedup.pieces(data)[:3], strict=True) for s in range(s0, s0 + m)}
    assert {w for _, w in whole} == {w for _, w in cut} and len({w: k for k, w in whole}) == len(whole)


def test_empty(spark):
    empty = frame(spark, [])
    assert factor_dedup.digest(empty).count() == 0 and factor_dedup.without_repeats(empty).count() == 0
    assert [tuple(r)[1:4] for r in factor_dedup.digest(frame(spark, [(1, None), (2, "x")])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 0)]
