"""A corpus pipeline: toxicity, line dedup, near-dedup, secret redaction, packing.

Each stage works on what its predecessor kept, and its decisions take effect. All stages but the last
return the columns of ``documents``; where a stage changes a text, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantscope.llm import line_spread, near_copies, packing, secrets, toxicity
from plantscope.llm.common import shared_table


def _counted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the new texts, in the columns of ``before``."""
    if "n_chars" in before.columns:
        kind = dict(before.dtypes)["n_chars"]
        docs = docs.withColumn("n_chars", F.char_length("text").cast(kind))
    return docs.select(*before.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all documents but the first that holds them; every document stays."""
    return _counted(line_spread.cut_boilerplate(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more) stays."""
    return near_copies.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; every document stays."""
    return _counted(secrets.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("near dedup", drop_near_copies),
    ("secret scan", hide_secrets),
    ("packing", pack),
]

# no SQL has these models, hashes and token ids; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
