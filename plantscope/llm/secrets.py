"""Secret scans (native): named patterns, and sliding-window Shannon entropy over candidate strings.

Everything is a narrow expression on one row: no shuffle, no Python, no state beyond the row.

* Patterns. For each kind the text is cut at its matches; the lengths of the pieces and of the matches
  give the positions, so offsets are code points and matches are leftmost and non-overlapping.
* Entropy. Runs are the maximal strings of one character class (``hex``, ``base64``); a candidate is a
  piece of a run, see below, of at least ``WINDOW`` characters that holds a digit and a letter. A window
  slides over it; the counts of the character that enters and of the one that leaves are the only ones that change, and with them the
  sum of n * log2(n). That sum is kept in units of 2**-20, so it is an integer and never drifts.
  H = log2(W) - sum / W reaches the threshold exactly when the sum is at most a constant. The span runs
  from the first to the last window that reaches it.
* Suppression. Allow-listed strings, allow-listed shapes (UUID) and the spans of named patterns and of
  earlier classes are cut out of a run, and the pieces between them are the candidates: a key joined to a
  path, a word or a UUID is still found, and the allowed stretch itself stays readable.

Defined results: a null text is an empty text without spans; repeated rows give repeated results; extra
columns pass through ``scan_spans`` untouched unless they are called like its output column, which
replaces them; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantscope.llm.common import fresh, hex_sha256, prefix_sums


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    group: int  # the group whose length counts
    least: int


# fixed values: the kinds, in the order in which spans with one start are listed
PATTERNS = (
    Pattern(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 20),
    Pattern("hex", r"[0-9a-f]+", 0, 24),
)
# a run that is too short fails anyway, and it can hide no longer run of its own class
SEARCHED = {"assign": PATTERNS[0].regex, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

WINDOW = 20
SCALE = 1 << 20


@dataclass(frozen=True)
class CharClass:
    kind: str
    alphabet: str
    regex: str
    threshold: float  # bits per character


CLASSES = (
    CharClass("entropy_hex", "0123456789abcdefABCDEF", r"[0-9A-Fa-f]{20,}", 3.0),
    CharClass(
        "entropy_base64",
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-",
        r"[A-Za-z0-9+/_=-]{20,}",
        3.9,
    ),
)
ALLOWED_STRINGS = ("example", "placeholder", "changeme", "dummy", "0123456789", "abcdefghij")
ALLOWED_SHAPE = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
KINDS = tuple(p.kind for p in PATTERNS) + tuple(c.kind for c in CLASSES)

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,text:string>>"


def n_log_n(window: int = WINDOW) -> list[int]:
    return [round(n * math.log2(n) * SCALE) if n else 0 for n in range(window + 1)]


def most_sum(threshold: float, window: int = WINDOW) -> int:
    """The largest sum of n * log2(n), in units of 1 / SCALE, at which the entropy reaches the threshold."""
    return math.floor(window * (math.log2(window) - threshold) * SCALE)


def _empty() -> Column:
    return F.array().cast(SPAN)


def _positions(text: Column, matches: Column, regex: str, rank: int, kind: str) -> Column:
    """All matches as spans."""
    gaps = F.transform(F.split(text, regex, -1), F.char_length)
    lengths = F.transform(matches, F.char_length)
    ends = prefix_sums(F.transform(lengths, lambda n, i: F.get(gaps, i) + n))
    spans = F.zip_with(
        ends,
        matches,
        lambda end, m: F.struct(
            (end - F.char_length(m)).alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            m.alias("text"),
        ),
    )
    return F.when(F.size(matches) > 0, spans.cast(SPAN)).otherwise(_empty())


def _window_hits(codes: Column, n_symbols: int, threshold: float, window: int) -> Column:
    """(first, last): the first window that reaches the threshold and the last, by start; null without any."""
    table = F.array(*[F.lit(v).cast("long") for v in n_log_n(window)])
    limit = F.lit(most_sum(threshold, window)).cast("long")
    start = F.struct(
        F.array_repeat(F.lit(0), n_symbols).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def step(acc: Column, i: Column) -> Column:
        came = F.get(codes, i)
        left = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
        n_left = F.get(acc["counts"], left)
        minus = F.when(left >= 0, F.get(table, n_left - 1) - F.get(table, n_left)).otherwise(F.lit(0).cast("long"))
        n_came = F.get(acc["counts"], came) - F.when(left == came, 1).otherwise(0)
        total = acc["sum"] + minus + F.get(table, n_came + 1) - F.get(table, n_came)
        counts = F.transform(
            acc["counts"],
            lambda n, j: n + F.when(j == came, 1).otherwise(0) - F.when(j == left, 1).otherwise(0),
        )
        hit = (i >= window - 1) & (total <= limit)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.coalesce(acc["first"], F.when(hit, i - (window - 1))).alias("first"),
            F.when(hit, i - (window - 1)).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.size(codes) - 1),
        start,
        step,
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")),
    )


def _stretches(run: Column, regex: str) -> Column:
    """The places in the text at which ``regex`` matches inside ``run``."""
    inside = _positions(run["text"], F.regexp_extract_all(run["text"], F.lit(regex), F.lit(0)), regex, 0, "")
    return F.transform(
        inside, lambda m: F.struct((run["start"] + m["start"]).alias("start"), (run["start"] + m["end"]).alias("end"))
    )


def allowed_regex(words: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(re.escape(w) for w in words)


def _pieces(run: Column, taken: Column, window: int, allowed: tuple[str, ...]) -> Column:
    """What remains of ``run`` between taken spans and allowed stretches, in pieces of ``window`` or more."""
    met = F.filter(taken, lambda t: (t["start"] < run["end"]) & (run["start"] < t["end"]))
    cuts = F.concat(
        F.transform(met, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))),
        _stretches(run, ALLOWED_SHAPE),
        _stretches(run, allowed_regex(allowed)) if allowed else F.array().cast("array<struct<start:int,end:int>>"),
        F.array(F.struct(run["end"].alias("start"), run["end"].alias("end"))),
    )
    begin = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("free"), run["start"].alias("at"))

    def step(acc: Column, cut: Column) -> Column:
        piece = F.struct(acc["at"].alias("start"), cut["start"].alias("end"))
        return F.struct(
            F.when(cut["start"] - acc["at"] >= window, F.concat(acc["free"], F.array(piece))).otherwise(acc["free"]).alias("free"),
            F.greatest(acc["at"], cut["end"]).alias("at"),
        )

    free = F.aggregate(F.array_sort(cuts), begin, step, lambda acc: acc["free"])
    return F.transform(
        free,
        lambda p: F.struct(
            p["start"].alias("start"),
            F.substring(run["text"], p["start"] - run["start"] + 1, p["end"] - p["start"]).alias("text"),
        ),
    )


def _entropy_spans(
    runs: Column, taken: Column, cls: CharClass, rank: int, window: int, allowed: tuple[str, ...]
) -> Column:
    """The candidates in ``runs`` whose entropy reaches the threshold, narrowed to their windows."""
    candidates = F.filter(
        F.flatten(F.transform(runs, lambda run: _pieces(run, taken, window, allowed))),
        lambda p: p["text"].rlike("[0-9]") & p["text"].rlike("[A-Za-z]"),
    )

    def narrowed(piece: Column) -> Column:
        chars = F.filter(F.split(piece["text"], ""), lambda c: c != "")
        codes = F.transform(chars, lambda c: F.instr(F.lit(cls.alphabet), c) - 1)
        hit = _window_hits(codes, len(cls.alphabet), cls.threshold, window)
        return F.struct(
            (piece["start"] + hit["first"]).alias("start"),
            F.lit(rank).alias("rank"),
            (piece["start"] + hit["last"] + window).alias("end"),
            F.lit(cls.kind).alias("kind"),
            piece["text"].alias("text"),
        )

    spans = F.filter(F.transform(candidates, narrowed), lambda s: s["start"].isNotNull())
    return F.when(F.size(runs) > 0, spans.cast(SPAN)).otherwise(_empty())


def scan_spans(
    docs: DataFrame,
    text: str = "text",
    out: str = "spans",
    window: int = WINDOW,
    allowed: tuple[str, ...] = ALLOWED_STRINGS,
) -> DataFrame:
    """Add ``out``: array of (start, rank, end, kind, text), by start and then by rank of the kind.

    Steps are separate projections so that each regular expression runs once a row.
    """
    # the caller's columns travel in one, so that no name can clash
    df = docs.select(F.struct("*").alias("given"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    searched = [(p.kind, SEARCHED[p.kind]) for p in PATTERNS] + [(c.kind, c.regex) for c in CLASSES]
    df = df.withColumns({f"_m_{kind}": F.regexp_extract_all("_t", F.lit(rx), F.lit(0)) for kind, rx in searched})
    df = df.withColumns(
        {f"_s_{kind}": _positions(F.col("_t"), F.col(f"_m_{kind}"), rx, r, kind) for r, (kind, rx) in enumerate(searched)}
    )
    assign = PATTERNS[0]
    long_enough = F.filter(
        F.col("_s_assign"),
        lambda s: F.char_length(F.regexp_extract(s["text"], assign.regex, assign.group)) >= assign.least,
    )
    df = df.withColumn("_base", F.concat(long_enough, F.col("_s_access"), F.col("_s_hex")))
    taken = F.col("_base")
    for r, cls in enumerate(CLASSES, len(PATTERNS)):
        df = df.withColumn(f"_e_{cls.kind}", _entropy_spans(F.col(f"_s_{cls.kind}"), taken, cls, r, window, allowed))
        taken = F.concat(taken, F.col(f"_e_{cls.kind}"))
    df = df.withColumn("_out", F.array_sort(taken))
    return df.select(*[F.col(f"given.`{c}`").alias(c) for c in docs.columns if c != out], F.col("_out").alias(out))


def span_list(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < len(PATTERNS))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replace every span by ``mark``; spans that touch or overlap become one mark. Rows all stay."""
    found, cut = fresh(docs, "spans", "cut")
    spans = F.col(found)
    df = scan_spans(docs, text, found)
    # the end of what is hidden before each span: a running maximum of the ends, which lists are short for
    merged = F.aggregate(
        spans,
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(
                (s["start"] > acc["at"]) | (acc["at"] == 0),
                F.concat(acc["parts"], F.array(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))),
            )
            .otherwise(acc["parts"])
            .alias("parts"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    df = df.withColumn(cut, F.when(F.size(spans) > 0, merged))
    tail = F.substring(F.col(text), F.col(f"{cut}.at") + 1, F.char_length(F.col(text)))
    df = df.withColumn(
        text, F.when(F.size(spans) > 0, F.concat(F.array_join(F.col(f"{cut}.parts"), ""), tail)).otherwise(F.col(text))
    )
    return df.drop(found, cut)


def digest(docs: DataFrame) -> DataFrame:
    df = scan_spans(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return df.select(
        "doc_id",
        *[count(p.kind).alias(f"n_{p.kind}") for p in PATTERNS],
        hex_sha256(span_list(base_spans(F.col("spans")))).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def _either_case(regex: str) -> str:
    """The keywords of the first pattern letter by letter: some engines fold more than ASCII."""
    inner = regex.removeprefix("(?i)")
    words, rest = inner[1 : inner.index(")")], inner[inner.index(")") :]
    return "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + rest


def _matches_sql(kind: str, rank: int, regex: str) -> str:
    """Matches with their positions: pieces between matches and matches alternate."""
    rx = regex.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s,
 (sum(length(g)) OVER w + sum(length(s)) OVER w - length(s))::BIGINT AS a, (sum(length(g)) OVER w + sum(length(s)) OVER w)::BIGINT AS b
 FROM (SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS s, unnest(p[:len(m)]) AS g FROM
  (SELECT doc_id, regexp_extract_all(t, '{rx}') AS m, string_split_regex(t, '{rx}') AS p FROM d))
 WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def _stretches_sql(runs: str, regex: str) -> str:
    """The places at which ``regex`` matches inside each run."""
    rx = regex.replace("'", "''")
    return f"""SELECT doc_id, ra, rb, rs, ra + (sum(length(g)) OVER w + sum(length(s)) OVER w - length(s))::BIGINT AS a, ra + (sum(length(g)) OVER w + sum(length(s)) OVER w)::BIGINT AS b
 FROM (SELECT doc_id, ra, rb, rs, generate_subscripts(m, 1) AS i, unnest(m) AS s, unnest(p[:len(m)]) AS g FROM
  (SELECT doc_id, a AS ra, b AS rb, s AS rs, regexp_extract_all(s, '{rx}') AS m, string_split_regex(s, '{rx}') AS p FROM {runs}))
 WINDOW w AS (PARTITION BY doc_id, ra ORDER BY i)"""


def _entropy_sql(name: str, cls: CharClass, rank: int, taken: list[str]) -> str:
    met = " UNION ALL ".join(
        f"SELECT r.doc_id, r.a AS ra, r.b AS rb, r.s AS rs, x.a, x.b FROM {name}_r r JOIN {t} x ON x.doc_id = r.doc_id AND x.a < r.b AND r.a < x.b"
        for t in taken
    )
    inside = " UNION ALL ".join(_stretches_sql(f"{name}_r", rx) for rx in (ALLOWED_SHAPE, allowed_regex(ALLOWED_STRINGS)))
    return f"""{name}_r AS ({_matches_sql(cls.kind, rank, cls.regex)}),
{name}_x AS ({met} UNION ALL {inside} UNION ALL SELECT doc_id, a, b, s, b, b FROM {name}_r),
{name}_p AS (SELECT doc_id, ra, rs, a AS pb, greatest(ra, coalesce(max(b) OVER (PARTITION BY doc_id, ra ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ra)) AS pa FROM {name}_x),
{name}_c AS (SELECT doc_id, a, s FROM (SELECT doc_id, pa AS a, substr(rs, (pa - ra + 1)::BIGINT, (pb - pa)::BIGINT) AS s FROM {name}_p WHERE pb - pa >= {WINDOW})
  WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')),
{name}_w AS (SELECT doc_id, a, s, unnest(range(length(s) - {WINDOW} + 1)) AS i FROM {name}_c),
{name}_h AS (SELECT doc_id, a, i FROM (SELECT doc_id, a, i, c, count(*) AS n FROM
  (SELECT doc_id, a, i, unnest(string_split(substr(s, i + 1, {WINDOW}), '')) AS c FROM {name}_w) GROUP BY ALL)
  GROUP BY ALL HAVING sum(round(n * log2(n) * {SCALE})) <= {most_sum(cls.threshold)}),
{name} AS (SELECT doc_id, '{cls.kind}' AS kind, {rank} AS rank, a + min(i) AS a, a + max(i) + {WINDOW} AS b FROM {name}_h GROUP BY doc_id, {name}_h.a)"""


def _digest_sql() -> str:
    first = PATTERNS[0]
    fit = f"SELECT doc_id, kind, rank, a, b FROM ({_matches_sql(first.kind, 0, _either_case(first.regex))}) WHERE length(regexp_extract(s, '{_either_case(first.regex).replace(chr(39), chr(39) * 2)}', {first.group})) >= {first.least}"
    others = [f"SELECT doc_id, kind, rank, a, b FROM ({_matches_sql(p.kind, r, SEARCHED[p.kind])})" for r, p in enumerate(PATTERNS) if r]
    names, parts = ["base"], []
    for n, cls in enumerate(CLASSES):
        parts.append(_entropy_sql(f"e{n}", cls, len(PATTERNS) + n, list(names)))
        names.append(f"e{n}")
    every = " UNION ALL ".join(f"SELECT doc_id, kind, rank, a, b FROM {x}" for x in names)
    listed = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{p.kind}') AS n_{p.kind}" for p in PATTERNS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join([fit, *others])}),
{', '.join(parts)}, s AS ({every})
SELECT d.doc_id, {counts}, sha256({listed.format(f' FILTER (rank < {len(PATTERNS)})')}) AS base_sha256, {listed.format('')} AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


DIGEST_SQL = _digest_sql()
