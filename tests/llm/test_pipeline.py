"""Each stage against a brute-force version on what the stage before it kept."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_dedup import lines_by_loop  # noqa: E402
from test_near_copies import slow_kept  # noqa: E402

import corpus_pipeline  # noqa: E402
from plantscope.llm import line_spread, secrets, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def redacted(text):
    _, spans = brute.secrets(text, secrets.WINDOW, secrets.CLASSES, secrets.ALLOWED_STRINGS)
    out, at = "", 0
    for start, _, end, _ in spans:
        if start > at or at == 0:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs.collect()
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in after[name])
            docs = spark.createDataFrame(after[name], docs.schema)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(table, toxicity.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert {r.doc_id for r in after["toxicity"]} == {r.doc_id for r in scored if r.score < 0.5}
    kept = {r.doc_id for r in after["toxicity"]}
    assert len(kept) < len(before) and np.mean([i in kept for i, t in labels.items() if not t]) > 0.99

    rows = [(r.doc_id, r.text, r.source) for r in after["toxicity"]]
    assert Counter((r.doc_id, r.text) for r in after["line dedup"]) == Counter(lines_by_loop(rows, line_spread.MIN_SITES))

    assert sorted(r.doc_id for r in after["near dedup"]) == slow_kept([(r.doc_id, r.text) for r in after["line dedup"]])

    assert {r.doc_id: r.text for r in after["secret scan"]} == {r.doc_id: redacted(r.text) for r in after["near dedup"]}
    assert any("[secret]" in r.text for r in after["secret scan"])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in after["packing"]:
        pieces[r.doc_id].append(r)
    assert set(pieces) == {r.doc_id for r in after["secret scan"]}
    for r in after["secret scan"]:
        ids = library.encode(r.text, add_special_tokens=False).ids + [0]
        assert b"".join(x.ids for x in sorted(pieces[r.doc_id], key=lambda x: x.start)) == np.array(ids, "<u4").tobytes()


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and got.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert docs.count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, spans string"
    rows = [(1, None, None, None, None, "x", "x", "x"), (1, None, None, None, None, "x", "x", "x"), (None, "", None, "a", 0, "x", "x", "x")]
    rows += [(2, "token=abcdef12 here and more words", "en", "a", 34, "x", "x", "x")] * 2 + [(3, "long " * 30_000, "en", "b", 150_000, "x", "x", "x")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name != "packing":
            assert made.columns == docs.columns
            docs = spark.createDataFrame(made.collect(), made.schema)
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3} and docs.count() == 3
    assert [r.text for r in docs.where("doc_id = 2").collect()] == ["[secret] here and more words"]
