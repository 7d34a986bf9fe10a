"""Line dedup by distinct-site spread (native): lines that very many sites share are boilerplate.

Each line is known by two 64-bit hashes. One HyperLogLog sketch of sites per line hash, merged by
aggregation, estimates on how many sites it stands; map-side merging makes a line that is on every page
one row per task. A line far from the threshold is decided by its estimate. For lines within ``margin``
of it, the distinct (line, site) pairs are counted exactly. Boilerplate lines are cut from every
document but the first (by id) that holds them, so no line is lost from the corpus.

The texts themselves move once, when each document meets its own list of lines to cut; lines travel as
hashes. A hot line is a key of partial aggregates and of an equality join that adaptive execution splits.

Defined results: a null text stays null and an empty one empty; blank lines always stay; a null site is a
site of its own; lines are compared without the white space around them; of lines repeated in the first
document that holds them the first one stays; rows that repeat id and text are treated alike; extra
columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.llm.common import fresh, shared_table

MIN_SITES = 10
MARGIN = 0.25  # relative; the sketches' standard error is about 1.04 / sqrt(2 ** LG_K), 1.6 %
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def line_table(docs: DataFrame, id_col: str, text: str, site: str) -> DataFrame:
    """(d1, d2: the document, id, site hash, pos, h1, h2) of every line that is not blank."""
    rows = docs.select(
        F.xxhash64(F.col(id_col), F.col(text)).alias("d1"),
        F.xxhash64(F.col(text), F.lit("document"), F.col(id_col)).alias("d2"),
        F.col(id_col).alias("id"),
        F.coalesce(F.xxhash64(F.lit("site"), F.col(site)), F.lit(0)).alias("site"),
        F.posexplode(_lines(F.col(text))).alias("pos", "line"),
    ).withColumn("line", _bare(F.col("line")))
    return rows.where("line <> ''").select(
        "d1", "d2", "id", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit("line")).alias("h2")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(h1, h2) of the lines on at least ``min_sites`` distinct sites, exactly."""
    spread = shared_table(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - margin)),
        "line-spread",
    )
    sure = F.col("sites") > min_sites * (1 + margin)
    near = lines.select("h1", "h2", "site").join(spread.where(~sure), ["h1", "h2"], "left_semi")
    exact = (
        near.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    )
    return spread.where(sure).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def cut_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    margin: float = MARGIN,
    removed: str | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines cut from ``text``; ``removed`` names a column for their number."""
    lines = line_table(docs, id_col, text, site)
    shared = shared_table(boilerplate(lines, min_sites, margin), "line-boilerplate")
    met = shared_table(lines.join(shared, ["h1", "h2"]).select("h1", "h2", "d1", "d2", "id", "pos"), "line-hits")
    first = met.groupBy("h1", "h2").agg(F.min(F.struct("id", "d1", "d2", "pos")).alias("first"))
    own = F.struct("id", "d1", "d2", "pos")
    d1, d2, cut = fresh(docs, "d1", "d2", "cut")
    cuts = (
        met.join(first, ["h1", "h2"])
        .where(~own.eqNullSafe(F.col("first")))
        .groupBy("d1", "d2")
        .agg(F.collect_set("pos").alias(cut))
        .withColumnsRenamed({"d1": d1, "d2": d2})
    )
    keyed = docs.withColumns(
        {d1: F.xxhash64(F.col(id_col), F.col(text)), d2: F.xxhash64(F.col(text), F.lit("document"), F.col(id_col))}
    )
    kept = F.filter(_lines(F.col(text)), lambda _, i: ~F.array_contains(cut, i))
    out = keyed.join(cuts, [d1, d2], "left").withColumn(
        text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    )
    if removed:
        out = out.withColumn(removed, F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long"))
    return out.select(*docs.columns, *([removed] if removed and removed not in docs.columns else []))


def digest(docs: DataFrame) -> DataFrame:
    cleaned = cut_boilerplate(docs.select("doc_id", "text", "source"), removed="removed_lines")
    return cleaned.select(
        "doc_id",
        "removed_lines",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
    )


# the sites of a line by an exact count, and the place where it stays by a window
DIGEST_SQL = rf"""
WITH l AS (
    SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents WHERE text IS NOT NULL
), b AS (
    SELECT doc_id, source, pos, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l
), s AS (
    SELECT line FROM b WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= {MIN_SITES}
), k AS (
    SELECT b.doc_id, b.pos, b.raw,
           s.line IS NOT NULL AND row_number() OVER (PARTITION BY b.line ORDER BY b.doc_id, b.pos) > 1 AS cut
    FROM b LEFT JOIN s ON b.line = s.line
), t AS (
    SELECT doc_id, count(*) FILTER (cut) AS removed_lines,
           coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS kept
    FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.removed_lines, 0) AS removed_lines, coalesce(length(t.kept), 0) AS kept_chars,
       sha256(t.kept) AS text_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
