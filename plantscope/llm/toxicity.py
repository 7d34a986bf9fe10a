"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

* Terms are words and word beginnings of 4, 5 and 6 letters. Those that labelled toxic training texts
  hold far more often than clean ones, by the lower end of a log-odds interval, make the lexicons.
* Voters: lexicons of words, one for each beginning length (patterns), each dealt from the ranked terms so
  that no two share one; and patterns of style (capitals, exclamation marks, repeated letters).
* The label model estimates each voter's accuracy and the correlations between voters from their votes
  alone; labels say where it starts and how common toxicity is.
* A linear classifier is fitted to its posterior labels, over the terms, the votes and the number of hits.
  It scores every whole text.

Training rows are labelled rows that are not held out, at most about ``TRAIN_ROWS`` of them, chosen by a
hash of the id; so what the driver holds (hit lists, a matrix of voters) has that bound. Scoring covers
all rows. Labels, language, source and id are never inputs of a score.

Defined results: a null or empty text has no hits and gets the score of a text without hits; conflicting
labels of one id count as toxic; labels with a null id or value are ignored; without a toxic and a clean
training row all scores are 0; rows that repeat an id are scored one by one; a null id is not held out;
extra columns pass through ``score`` unless called like its outputs; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.llm.common import shared_table
from plantscope.llm.label_model import LabelModel, fit_label_model, fit_linear

TRAIN_ROWS = 20_000
FOLDS = 5
BEGINNINGS = (4, 5, 6)
TERMS = 128  # of each kind at most
VOTERS = 8  # of each kind
LEAST_DOCS = 3
LEAST_LOG_ODDS = 3.5
LEAST_SURE_LOG_ODDS = 1.0  # two standard errors below the estimate
RIDGE = 0.1
HASH_SPAN = 1 << 30

WORD = re.compile(r"[^\W\d_]+")
CAPITALS, SHOUTS, LETTERS = re.compile(r"\b[A-Z]{3,}\b"), re.compile(r"!{2,}"), re.compile(r"(\w)\1{3,}")
STYLES = (CAPITALS, SHOUTS, LETTERS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def terms(text: str | None) -> set[str]:
    """Words, and their beginnings marked by a star; a word is not its own beginning."""
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, int]  # term -> position
    voter: np.ndarray  # position -> voter

    @property
    def voters(self) -> int:
        return int(self.voter.max(initial=-1)) + 1 + len(STYLES)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None


def _kind(term: str) -> int:
    return len(term) - 1 if term.endswith("*") else 0


def choose_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """``counts``: (term, toxic texts, clean texts that hold it)."""
    ranked = []
    for term, t, c in counts:
        odds = np.log((t + 0.5) / (toxic - t + 0.5)) - np.log((c + 0.5) / (clean - c + 0.5))
        low = odds - 2 * (1 / (t + 0.5) + 1 / (toxic - t + 0.5) + 1 / (c + 0.5) + 1 / (clean - c + 0.5)) ** 0.5
        if t >= LEAST_DOCS and odds >= LEAST_LOG_ODDS and low >= LEAST_SURE_LOG_ODDS:
            ranked.append((-low, term))
    words: dict[str, int] = {}
    voter: list[int] = []
    dealt: Counter = Counter()
    kinds = (0, *BEGINNINGS)
    for _, term in sorted(ranked):
        k = kinds.index(_kind(term))
        if dealt[k] < TERMS:
            words[term] = len(words)
            voter.append(k * VOTERS + dealt[k] % VOTERS)
            dealt[k] += 1
    numbers = {v: n for n, v in enumerate(sorted(set(voter)))}
    return Lexicon(words, np.array([numbers[v] for v in voter], dtype=np.int64))


class Reader:
    """Finds the hits of a lexicon in a text."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known = set(lexicon.words)
        self.lengths = sorted({_kind(t) for t in self.known} - {0})

    def hits(self, text: str | None) -> list[int]:
        """Positions of the terms, then of the styles, in the text."""
        text = text or ""
        words = set(WORD.findall(text.lower()))
        found = words & self.known
        for n in self.lengths:
            found |= {w[:n] + "*" for w in words if len(w) > n} & self.known
        at = len(self.lexicon.words)
        styles = [at + k for k, s in enumerate(STYLES) if s.search(text)]
        return [*sorted(self.lexicon.words[t] for t in found), *styles]


def _votes(hits: list[list[int]], lexicon: Lexicon) -> np.ndarray:
    votes = np.zeros((len(hits), lexicon.voters), dtype=np.int8)
    named = lexicon.voters - len(STYLES)
    for row, found in enumerate(hits):
        for k in found:
            n = len(lexicon.words)
            votes[row, lexicon.voter[k] if k < n else named + k - n] = 1
    return votes


def _matrix(hits: list[list[int]], lexicon: Lexicon) -> np.ndarray:
    """Terms and styles, votes, and the logarithm of the number of terms."""
    n = len(lexicon.words)
    x = np.zeros((len(hits), n + len(STYLES)), dtype=np.float32)
    for row, found in enumerate(hits):
        x[row, found] = 1
    return np.column_stack([x, _votes(hits, lexicon), np.log1p(x[:, :n].sum(axis=1))])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, most: int) -> DataFrame:
    """(toxic, text) of the labelled rows that are not held out, about ``most`` of them."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    known = known.agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("_id")))
    n = known.count()
    share = min(1.0, most / n) if n else 0.0
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit("train")), F.lit(HASH_SPAN)) < int(share * HASH_SPAN))
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("text"))
    # about ``most`` ids of 12 bytes: a bound that is a parameter
    return own.join(F.broadcast(chosen), "_id").select("toxic", "text")


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS
) -> Model:
    rows = shared_table(training_rows(docs, labels, id_col, text, most), "toxicity-training")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Lexicon({}, np.zeros(0, dtype=np.int64))
    if len(sizes) < 2:
        return Model(none, np.zeros(len(STYLES) * 2 + 1), -np.inf, None)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                n.update(terms(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    def by_term(part: DataFrame, name: str) -> DataFrame:
        return part.select("text").mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    in_toxic = shared_table(by_term(rows.where("toxic > 0"), "toxic").where(F.col("toxic") >= LEAST_DOCS), "toxicity-terms")
    in_clean = by_term(rows.where("toxic <= 0"), "clean")
    counts = in_toxic.join(in_clean, "term", "left").select("term", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))
    # terms of few clean texts only can be chosen, which is all that travels to the driver
    rare = counts.where(F.col("toxic") * sizes[False] > F.col("clean") * sizes[True])
    lexicon = choose_lexicon([tuple(r) for r in rare.collect()], sizes[True], sizes[False])
    if not lexicon.words:
        return Model(none, np.zeros(len(STYLES) * 2 + 1), -np.inf, None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for b in batches:
            hits = pa.array([reader.hits(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), hits], names=["toxic", "hits"])

    kind = dict(rows.dtypes)["toxic"]
    # most texts have no hits, so equal rows are counted; at most about ``most`` rows are left
    read_rows = rows.mapInArrow(read, f"toxic {kind}, hits array<int>")
    counted_rows = read_rows.groupBy((F.col("toxic") > 0).alias("toxic"), "hits").agg(F.count(F.lit(1)).alias("n"))
    sample = sorted((bool(r["toxic"]), list(r["hits"]), r["n"]) for r in counted_rows.collect())
    hits, often = [h for _, h, _ in sample], np.array([n for *_, n in sample], dtype=float)
    votes = _votes(hits, lexicon)
    model = fit_label_model(votes, np.array([0.95 if toxic else 0.005 for toxic, *_ in sample]), often)
    weights, bias = fit_linear(_matrix(hits, lexicon), model.posterior(votes), often, RIDGE)
    return Model(lexicon, weights, bias, model)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: 0 to 1, higher where toxicity is likelier."""
    if not np.isfinite(model.bias):
        return docs.withColumn(out, F.lit(0.0))
    columns = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for b in batches:
            x = _matrix([reader.hits(t) for t in b.column(columns.index(text)).to_pylist()], model.lexicon)
            z = x @ model.weights + model.bias
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*columns, out])

    own = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{schema}, `{out}` double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
