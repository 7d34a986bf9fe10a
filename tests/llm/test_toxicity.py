"""The label model on made votes, the linear fit against its optimum, held-out accuracy of the whole."""

import zlib

import numpy as np
import pytest

from plantscope.llm import toxicity
from plantscope.llm.label_model import fit_label_model, fit_linear

SCHEMA = "doc_id long, text string, score string, lang string"


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.3
    hit, false = np.array([0.9, 0.7, 0.6, 0.5, 0.8]), np.array([0.05, 0.1, 0.02, 0.2, 0.3])
    votes = (rng.random((len(y), 5)) < np.where(y[:, None], hit, false)).astype(int)
    copied = np.column_stack([votes, votes[:, 3], votes[:, 3], votes[:, 3]])
    start = np.where(rng.random(len(y)) < 0.2, 0.3, np.where(y, 0.9, 0.04))
    m = fit_label_model(copied, start, np.ones(len(y)))
    assert abs(m.prior - 0.3) < 0.02
    assert np.abs(m.hit[:5] - hit).max() < 0.03 and np.abs(m.false[:5] - false).max() < 0.03
    assert np.abs(m.accuracy[:5] - (0.3 * hit + 0.7 * (1 - false))).max() < 0.03
    assert m.weight[:3].min() > 0.95 and m.weight[5:].max() < 0.3 and m.correlation[5, 6] > 0.95
    assert ((m.posterior(copied) > 0.5) == y).mean() > 0.93


def test_linear_fit_is_the_ridge_optimum():
    rng = np.random.default_rng(1)
    x, target = rng.normal(size=(500, 6)), rng.random(500)
    often = rng.integers(1, 4, 500).astype(float)
    w, b = fit_linear(x, target, often, 0.7)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (often * (p - target)) + 0.7 * w).max() < 1e-2 and abs(often @ (p - target)) < 1e-2


def test_terms_and_hits_agree():
    text = "Idiots idiot, idi0t; ÉÉcole worthlessness a"
    found = toxicity.terms(text)
    assert {"idiots", "idiot", "idio*", "idiot*", "worthl*", "éécole", "éécol*", "a"} <= found and "idiots*" not in found
    lexicon = toxicity.Lexicon({t: k for k, t in enumerate(sorted(found))}, np.zeros(len(found), dtype=np.int64))
    hits = toxicity.Reader(lexicon).hits(text)
    assert {sorted(found)[k] for k in hits if k < len(found)} == found


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    clean = [p for p, t in held if not t]
    caught = [p for p, t in held if t]
    assert len(held) > 500 and np.mean(clean) < 0.01 and np.mean(caught) > 0.8


@pytest.mark.parametrize("labelled", [[], [(1, 1), (2, 1)], [(1, 0), (None, 1), (2, None)]])
def test_no_usable_labels(spark, labelled):
    docs = spark.createDataFrame([(1, "idiot", "x", "x"), (2, None, "x", "x"), (None, "", "x", "x"), (2, None, "x", "x")], SCHEMA)
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.0} and {r.predicted for r in got} == {0}


def test_edges_and_clashing_columns(spark):
    rows = [(i, ("awful " if i % 3 == 0 else "kind ") + "word " * (i % 7), "x", "x") for i in range(300)]
    rows += [(1000, None, "x", "x"), (1001, "", "x", "x"), (None, "awful", "x", "x"), (0, rows[0][1], "x", "x"), (1002, "awful " * 200_000, "x", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, 0), (3, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert set(scored.columns) == set(docs.columns)
    got = scored.collect()
    assert len(got) == len(rows)
    assert all((r.score > 0.5) == ("awful" in (r.text or "")) for r in got)
    assert toxicity.digest(docs.where("false"), labels).collect() == []
