"""Ordered computations over series of any length.

A window partitioned by the series key alone puts one whole series into one task, which
fails when a single series holds a large share of the table. An ``OrderedScan`` cuts the
(series, order) key space into buckets at sampled splitters, like a distributed sort:

* every row finds its bucket by binary search over a literal array of at most
  ``MAX_BUCKETS`` splitters, so the assignment is a pure function of the row;
* windows run inside (series, bucket), which spreads one long series over many tasks;
* a series that is cut gets a *carry* per piece (its earlier rows' totals, extremes or last
  row). Each splitter cuts at most one series, so there are at most ``2 * buckets`` carry
  rows whatever the data volume, and broadcasting them is safe;
* windows that look back a fixed number of rows are recomputed for the few rows at the start
  of a cut piece from the rows around the cut.

A table below ``rows_per_bucket`` rows has no splitters, and the plan is the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 16_384
SAMPLES_PER_SPLITTER = 16
BROADCAST_SERIES = 200_000

BUCKET = "_bucket"
EDGE = "_edge"
_CONTINUES = 1  # the series started in an earlier bucket
_GOES_ON = 2  # the series goes on in a later bucket
_SEPARATOR = "\u0001"


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join on ``keys`` that keeps one copy of them."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


class OrderedScan:
    """Rows of ``df`` seen as ordered series; operations return a new scan."""

    def __init__(
        self,
        df: DataFrame,
        series: Sequence[str],
        order: Sequence[str],
        rows_per_bucket: int | None = None,
    ):
        self.series = list(series)
        self.order = list(order)
        if not self.order:
            raise ValueError("an ordered operator needs order_by")
        missing = [c for c in self.series + self.order if c not in df.columns]
        if missing:
            raise ValueError(f"unknown column(s): {', '.join(missing)}")
        self.rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
        self.n_rows, self.n_series = df.agg(
            F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*(self.series or [F.lit(0)])))
        ).first()
        splitters = self._splitters(df) if self.n_rows > self.rows_per_bucket else []
        self.n_splitters = len(splitters)
        self.df = self._assign(df, splitters) if splitters else df

    # -- bucket assignment -------------------------------------------------

    def _splitters(self, df: DataFrame) -> list[tuple[str | None, ...]]:
        """At most MAX_BUCKETS keys that cut the rows into pieces of similar size."""
        keys = self.series + self.order
        buckets = min(MAX_BUCKETS, -(-self.n_rows // self.rows_per_bucket))
        rate = max(1, self.n_rows // (buckets * SAMPLES_PER_SPLITTER))
        sample = df.select(*keys).where(F.pmod(F.xxhash64(*keys), F.lit(rate)) == 0)
        # the sample holds about buckets * SAMPLES_PER_SPLITTER rows, however large the table
        ranked = sample.withColumn("__i", F.row_number().over(Window.orderBy(*keys)))
        chosen = ranked.where(F.col("__i") % SAMPLES_PER_SPLITTER == 0).orderBy("__i")
        rows = chosen.select(*[F.col(k).cast("string").alias(k) for k in keys]).collect()
        # a splitter that holds the separator is left out: it would only have evened out the sizes
        clean = [tuple(r) for r in rows if not any(_SEPARATOR in v for v in r if v)]
        return list(dict.fromkeys(clean))

    def _assign(self, df: DataFrame, splitters: list[tuple[str | None, ...]]) -> DataFrame:
        # one array literal per key column, made from one text each: the optimizer folds it to a
        # single node, where an array of thousands of struct constructors would slow planning down
        keys = self.series + self.order
        bounds, parts = [], []
        for i, k in enumerate(keys):
            kind = df.schema[k].dataType.simpleString()
            text = [s[i] for s in splitters]
            if kind == "string":
                if None in text:  # a null key sorts first and must differ from the empty text
                    flags = _SEPARATOR.join("false" if t is None else "true" for t in text)
                    bounds.append(F.split(F.lit(flags), _SEPARATOR).cast("array<boolean>"))
                    parts.append(F.col(k).isNotNull())
                    bounds.append(F.split(F.lit(_SEPARATOR.join(t or "" for t in text)), _SEPARATOR))
                    parts.append(F.coalesce(F.col(k), F.lit("")))
                else:
                    bounds.append(F.split(F.lit(_SEPARATOR.join(text)), _SEPARATOR))
                    parts.append(F.col(k))
            else:
                joined = _SEPARATOR.join("" if t is None else t for t in text)
                bounds.append(F.split(F.lit(joined), _SEPARATOR).try_cast(f"array<{kind}>"))
                parts.append(F.col(k))
            if k in self.series:
                n_series_parts = len(parts)
        names = [f"k{j}" for j in range(len(parts))]
        key = F.struct(*[p.alias(n) for p, n in zip(parts, names)])

        def bound(index: Column) -> Column:
            return F.struct(*[F.get(b, index).alias(n) for b, n in zip(bounds, names)])

        step, steps = 1, []
        while step <= len(splitters):
            steps.append(step)
            step *= 2
        count = len(splitters)
        bucket = F.aggregate(
            F.array(*[F.lit(s) for s in reversed(steps)]),
            F.lit(0),
            lambda low, s: F.when((low + s <= count) & (bound(low + s - 1) <= key), low + s).otherwise(low),
        )
        assigned = df.withColumn(BUCKET, bucket)

        def same_series(index: Column) -> Column:
            cond = (index >= 0) & (index < count)
            for b, p in zip(bounds[: n_series_parts if self.series else 0], parts):
                cond = cond & F.get(b, index).eqNullSafe(p)
            return cond

        return assigned.withColumn(
            EDGE,
            (
                F.when(same_series(F.col(BUCKET) - 1), _CONTINUES).otherwise(0)
                + F.when(same_series(F.col(BUCKET)), _GOES_ON).otherwise(0)
            ).cast("tinyint"),
        )

    # -- plumbing ----------------------------------------------------------

    @property
    def is_split(self) -> bool:
        return self.n_splitters > 0

    def _derive(self, df: DataFrame) -> "OrderedScan":
        out = object.__new__(OrderedScan)
        out.__dict__.update(self.__dict__)
        out.df = df
        return out

    def _piece_keys(self) -> list[str]:
        return self.series + [BUCKET] if self.is_split else self.series

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*(self._piece_keys() or [F.lit(0)])).orderBy(*self.order)

    def _order_key(self) -> Column:
        return F.struct(*self.order)

    @staticmethod
    def _flag(bit: int) -> Column:
        return F.col(EDGE).bitwiseAND(F.lit(bit).cast("tinyint")) != 0

    def select(self, *cols) -> "OrderedScan":
        """Project the payload; keys, order and bucket columns stay."""
        kept = dict.fromkeys(self.series + self.order + ([BUCKET, EDGE] if self.is_split else []))
        names = [c for c in cols if isinstance(c, str) and c not in kept]
        exprs = [c for c in cols if not isinstance(c, str)]
        return self._derive(self.df.select(*kept, *names, *exprs))

    def with_columns(self, cols: dict[str, Column]) -> "OrderedScan":
        return self._derive(self.df.withColumns(cols))

    def rows(self) -> DataFrame:
        return self.df.drop(BUCKET, EDGE)

    def attach(self, stats: DataFrame) -> "OrderedScan":
        """Join one row per series. Few series: broadcast. Many: by (series, bucket), so that
        neither side puts a long series into one task."""
        if not self.series:
            return self._derive(
                self.df.withColumn("__one", F.lit(1)).join(F.broadcast(stats.withColumn("__one", F.lit(1))), "__one").drop("__one")
            )
        if self.n_series <= BROADCAST_SERIES:
            return self._derive(join_on(self.df, F.broadcast(stats), self.series))
        if not self.is_split:
            return self._derive(join_on(self.df, stats, self.series))
        pieces = self.df.select(*self.series, BUCKET).distinct()
        return self._derive(join_on(self.df, join_on(pieces, stats, self.series), self._piece_keys()))

    # -- operations --------------------------------------------------------

    def running(self, specs: dict[str, tuple[str, Column]]) -> "OrderedScan":
        """Inclusive prefix aggregates: sum, count, min, max, last (last non-null value)."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {
            "sum": lambda e: F.sum(e).over(w),
            "count": lambda e: F.count(e).over(w),
            "min": lambda e: F.min(e).over(w),
            "max": lambda e: F.max(e).over(w),
            "last": lambda e: F.last(e, ignorenulls=True).over(w),
        }
        out = self.df.withColumns({name: local[kind](expr) for name, (kind, expr) in specs.items()})
        if not self.is_split:
            return self._derive(out)

        order = self._order_key()
        per_piece = {
            "sum": F.sum,
            "count": F.count,
            "min": F.min,
            "max": F.max,
            "last": lambda e: F.max_by(e, F.when(e.isNotNull(), order)),
        }
        pieces = self.df.where(F.col(EDGE) != 0).groupBy(*self._piece_keys()).agg(
            *[per_piece[kind](expr).alias(name) for name, (kind, expr) in specs.items()]
        )
        before = (
            Window.partitionBy(*(self.series or [F.lit(0)])).orderBy(BUCKET)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        over_pieces = {
            "sum": F.sum,
            "count": F.sum,
            "min": F.min,
            "max": F.max,
            "last": lambda c: F.last(c, ignorenulls=True),
        }
        carry = pieces.select(
            *self._piece_keys(),
            *[over_pieces[kind](F.col(name)).over(before).alias(f"__c_{name}") for name, (kind, _) in specs.items()],
        )
        joined = join_on(out, F.broadcast(carry), self._piece_keys(), "left")
        merge = {
            "sum": lambda a, b: F.coalesce(a + b, a, b),
            "count": lambda a, b: a + F.coalesce(b, F.lit(0)),
            "min": F.least,
            "max": F.greatest,
            "last": F.coalesce,
        }
        for name, (kind, _) in specs.items():
            joined = joined.withColumn(name, merge[kind](F.col(name), F.col(f"__c_{name}")))
        return self._derive(joined.drop(*[f"__c_{name}" for name in specs]))

    def row_number(self, name: str = "rn") -> "OrderedScan":
        return self.running({name: ("count", F.lit(1))})

    def previous(self, cols: dict[str, str]) -> "OrderedScan":
        """``{new: column}``: the value on the previous row of the series."""
        w = self._window()
        out = self.df.withColumns({new: F.lag(c).over(w) for new, c in cols.items()})
        if not self.is_split:
            return self._derive(out)
        sources = list(dict.fromkeys(cols.values()))
        last = (
            self.df.where(self._flag(_GOES_ON))
            .groupBy(*self._piece_keys())
            .agg(F.max_by(F.struct(*sources), self._order_key()).alias("__last"))
        )
        # pieces of one series lie in consecutive occupied buckets; join each to the one before
        heads = self.df.where(self._flag(_CONTINUES)).groupBy(*self._piece_keys()).agg(
            F.min(self._order_key()).alias("__first_key")
        )
        pieces = last.select(*self._piece_keys(), "__last", F.lit(None).cast("boolean").alias("__head")).unionByName(
            heads.select(*self._piece_keys(), F.lit(True).alias("__head")), allowMissingColumns=True
        )
        merged = pieces.groupBy(*self._piece_keys()).agg(
            F.max_by("__last", F.col("__last").isNotNull()).alias("__last"), F.max("__head").alias("__head")
        )
        wp = Window.partitionBy(*(self.series or [F.lit(0)])).orderBy(BUCKET)
        carry = (
            merged.withColumn("__prev", F.lag("__last").over(wp))
            .where(F.col("__head") & F.col("__prev").isNotNull())
            .select(*self._piece_keys(), "__prev")
        )
        joined = join_on(out.withColumn("__i", F.row_number().over(w)), F.broadcast(carry), self._piece_keys(), "left")
        first = (F.col("__i") == 1) & F.col("__prev").isNotNull()
        for new, c in cols.items():
            joined = joined.withColumn(new, F.when(first, F.col("__prev")[c]).otherwise(F.col(new)))
        return self._derive(joined.drop("__i", "__prev"))

    def bounded(self, build: Callable[[DataFrame, WindowSpec], DataFrame], lookback: int) -> "OrderedScan":
        """Add columns by ``build(df, window)`` whose windows reach back at most ``lookback`` rows."""
        if not self.is_split:
            return self._derive(build(self.df, self._window()))
        w = self._window()
        base = self.df.withColumn("__i", F.row_number().over(w)).withColumn(
            "__n", F.count(F.lit(1)).over(Window.partitionBy(*self._piece_keys()))
        )
        head = self._flag(_CONTINUES) & (F.col("__i") <= lookback)
        tail = self._flag(_GOES_ON) & (F.col("__i") > F.col("__n") - lookback)
        main = build(base, w).where(~head)
        # at most 2 * lookback rows per splitter, so one window per series is small here
        around = build(base.where(head | tail), Window.partitionBy(*(self.series or [F.lit(0)])).orderBy(*self.order))
        return self._derive(main.unionByName(around.where(head)).drop("__i", "__n"))


def islands(scan: OrderedScan, condition: Column, prefix: str = "run", position: bool = True) -> OrderedScan:
    """Mark runs of consecutive rows where ``condition`` holds.

    Adds ``{prefix}_id`` (null outside runs) and, unless switched off, ``{prefix}_pos`` (1-based). A
    run may be any length: ids are a running count of run starts, never a window over the run.
    """
    flagged = scan.with_columns({"__hit": F.coalesce(condition, F.lit(False))}).previous({"__was": "__hit"})
    start = F.col("__hit") & ~F.coalesce(F.col("__was"), F.lit(False))
    out = flagged.with_columns({"__start": start})
    hit = F.col("__hit")
    if not position:
        out = out.running({"__run": ("sum", F.col("__start").cast("long"))})
        out = out.with_columns({f"{prefix}_id": F.when(hit, F.col("__run"))})
        return out._derive(out.df.drop("__hit", "__was", "__start", "__run"))
    out = out.running({"__rn": ("count", F.lit(1)), "__run": ("sum", F.col("__start").cast("long"))})
    out = out.running({"__at": ("max", F.when(F.col("__start"), F.col("__rn")))})
    out = out.with_columns(
        {f"{prefix}_id": F.when(hit, F.col("__run")), f"{prefix}_pos": F.when(hit, F.col("__rn") - F.col("__at") + 1)}
    )
    return out._derive(out.df.drop("__hit", "__was", "__start", "__rn", "__run", "__at"))


def decayed_sum(scan: OrderedScan, name: str, term: Column, decay: float) -> OrderedScan:
    """``name``_i = term_i + decay * ``name``_{i-1}, for 0 <= decay < 1, without recursion.

    Rows of a piece are cut into blocks short enough that decay**-length stays below 1e6; inside
    a block the recurrence is a scaled prefix sum, and a few earlier block ends carry the rest.
    """
    if not 0 <= decay < 1:
        raise ValueError("decay must lie in [0, 1)")
    if decay == 0:
        return scan.with_columns({name: term})
    digits = -math.log10(decay)
    length = max(1, int(6 / digits))
    n_blocks = max(1, math.ceil(18 / (digits * length)))
    reach = max(1, math.ceil(18 / digits))
    keys = scan._piece_keys() or ["__all"]
    df = scan.df if scan._piece_keys() else scan.df.withColumn("__all", F.lit(0))
    d = F.lit(float(decay))
    df = df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*scan.order)) - 1)
    df = df.withColumns({"__blk": F.floor(F.col("__i") / length), "__p": F.col("__i") % length})
    in_block = Window.partitionBy(*keys, "__blk").orderBy(*scan.order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__own", F.pow(d, F.col("__p")) * F.sum(term * F.pow(d, -F.col("__p"))).over(in_block))
    end = F.when(F.col("__p") == length - 1, F.col("__own"))
    by_block = Window.partitionBy(*keys).orderBy("__blk")
    incoming = F.lit(0.0)
    for k in range(1, n_blocks + 1):
        earlier = F.sum(end).over(by_block.rangeBetween(-k, -k))
        incoming = incoming + F.coalesce(earlier, F.lit(0.0)) * F.lit(float(decay ** (length * (k - 1))))
    df = df.withColumn("__in", incoming)
    df = df.withColumn(name, F.col("__own") + F.pow(d, F.col("__p") + 1) * F.col("__in"))
    if scan.is_split:
        pieces = (
            df.where(F.col(EDGE) != 0)
            .groupBy(*keys)
            .agg(F.max_by(name, scan._order_key()).alias("__e"), F.count(F.lit(1)).alias("__k"))
        )
        w = Window.partitionBy(*(scan.series or [F.lit(0)])).orderBy(BUCKET).rowsBetween(-reach, -1)
        carry = pieces.select(
            *keys,
            F.aggregate(
                F.collect_list(F.struct("__k", "__e")).over(w),
                F.lit(0.0),
                lambda acc, p: acc * F.pow(d, p["__k"]) + p["__e"],
            ).alias("__e0"),
        )
        df = join_on(df, F.broadcast(carry), keys, "left")
        df = df.withColumn(name, F.col(name) + F.pow(d, F.col("__i") + 1) * F.coalesce("__e0", F.lit(0.0))).drop("__e0")
    return scan._derive(df.drop("__i", "__blk", "__p", "__own", "__in", "__all"))
