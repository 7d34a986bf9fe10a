"""Phrase collocations against loops over all n-grams."""

import random
import re
from collections import Counter

import pytest

from plantscope.llm import collocations
from plantscope.llm.collocations import count_windows, words_and_cuts

SCHEMA = "doc_id long, text string, lang string, w1 string, n string, total string, phrase string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "x", "x", "x") for i, (t, g) in enumerate(rows)], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pieces(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
        yield re.findall("[^ \t]+", piece)


def slow(rows, longest=3, least=10):
    n, f = Counter(), Counter()
    for text, lang in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    found = [p for p, a in f.items() if len(p) > 2 and a >= least]
    out = {}
    for p in found:
        lang, words, a = p[0], p[1:], f[p]
        inside = lambda q: any(q[1:][i : i + len(words)] == words for i in range(len(q) - len(words)))
        if any(q[0] == lang and len(q) > len(p) and inside(q) and 100 * f[q] >= 50 * a for q in found):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, k, left, right = min(cuts)
        out[lang, " ".join(words)] = (a, left, right, k, n[lang], score)
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "new", "york", "times", "of", "a", "é", "ÉTÉ", "x\x1cy", "to", "be"]
    rows = []
    for _ in range(120):
        parts = [rng.choice([*words, "new york", "new york times", "of the"]) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\r\n"]) for _ in range(rng.randrange(60))]
        rows.append(("".join(parts), rng.choice(["en", "fr", None, "und", "en"])))
    return rows + [(None, "en"), ("", None), (" \t ", "en"), ("...", "fr"), ("a a a a a a a a a a a a a a a", "rep"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "longest"), [(1, 3), (2, 4), (3, 2)])
def test_mined(spark, seed, longest):
    rows = corpus(seed)
    got = collocations.mined(frame(spark, rows), longest=longest).collect()
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.k, r.n, r.score) for r in got} == slow(rows, longest)
    assert len(got) == len({(r.lang, r.phrase) for r in got}) and all(" ".join(r.words) == r.phrase for r in got)


def test_long_text_in_slices(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "a"]) for _ in range(40_000)) + "z" * 5000
    rows = [(long, "en"), ("z" * 300_000, "en"), (long[:2000], "fr")]
    got = collocations.windows(frame(spark, rows), slice_bytes=1000)
    whole = collocations.windows(frame(spark, rows))
    total = lambda df: {tuple(r): r["sum(n)"] for r in df.groupBy("lang", "w1", "w2", "w3").sum("n").collect()}
    assert total(got) == total(whole)
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.k, r.n, r.score) for r in collocations.mined(frame(spark, rows)).collect()} == slow(rows)


def test_rank_ties_and_limit(spark):
    rows = [("b a. c a. d a", "en")] * 10 + [("q r", "fr")] * 9
    got = [tuple(r) for r in collocations.digest(frame(spark, rows), top=2).orderBy("lang", "rank").collect()]
    assert got == [("en", 1, "b a", 10, 10, 30, 60, 333333), ("en", 2, "c a", 10, 10, 30, 60, 333333)]


def test_empty(spark):
    empty = frame(spark, [])
    assert collocations.digest(empty).count() == 0 and collocations.frequencies(empty).count() == 0


def test_windows_of_tokens():
    words, windows, counts = count_windows(words_and_cuts(b"A b a b. a"), 3, True)
    named = {tuple(words[i].decode() for i in w): int(c) for w, c in zip(windows, counts, strict=True)}
    assert named == {("a", "b", "a"): 1, ("b", "a", "b"): 1, ("a", "b", ""): 1, ("b", "", ""): 1, ("a", "", ""): 1}
