"""Regressions, forests and boosted trees of many series: one model a series, all fitted in the same passes.

A regression needs two aggregates a series, whatever the number of series. A series of at most ``LOCAL_ROWS`` rows
gets its trees in a task, on arrays of bins (``tree_growth``). A longer one is spread over all tasks: its forest
grows level by level from sums over (series, tree, node, feature, bin), or from one pass over cells of rows with
the same bins where these are few. A series' trees do not depend on the other series. Bins are quantiles of the
series' own values.

A fitted tree is arrays in heap order (children of node i are 2i + 1 and 2i + 2): ``feature`` (-1 at a leaf),
``threshold`` and ``value``. Rows are scored on Arrow batches by models that all tasks hold; models too large for
that, and recursions, walk the arrays in an expression. A missing input goes right.

Bootstrap weights are Poisson draws hashed from (row keys, tree), so that a model does not depend on partitions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantscope.operators import tree_growth as tg
from plantscope.operators.ordered import BROADCAST_SERIES, join_on
from plantscope.operators.stats import attach_stats, quantiles
from plantscope.session import ensure_checkpoint_dir

BINS = 32
LEAST_GAIN = tg.LEAST_GAIN
LOCAL_ROWS = 200_000  # of a series that one task fits
GRID_CELLS = 32_768  # of bins, that a tree grows from instead of rows
TASK_BYTES = 256 << 20  # of sums that a task holds
MODEL_BYTES = 256 << 20  # of models that go to all tasks to score rows


def solver(size: int):
    """Normal equations from the upper triangle of a cross-product matrix whose last column is the target."""

    @F.pandas_udf("array<double>")
    def solved(sums: pd.Series) -> pd.Series:
        m = np.zeros((len(sums), size, size))
        rows, cols = np.triu_indices(size)
        flat = np.vstack(sums.to_numpy()).astype(float)
        m[:, rows, cols] = flat
        m[:, cols, rows] = flat
        b = m[:, :-1, -1]
        coef = np.einsum("nij,nj->ni", np.linalg.pinv(m[:, :-1, :-1], hermitian=True), b)
        left = m[:, -1, -1] - np.einsum("ni,ni->n", coef, b)
        return pd.Series(list(np.column_stack([coef, np.maximum(left, 0.0)])))

    return solved


def _complete(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    slim = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    for c in names:
        slim = slim.where(F.col(c).isNotNull() & ~F.isnan(c))
    return slim


@dataclass(frozen=True)
class SeriesRegression:
    """``models``: one row a series with intercept, coefficients (in order of ``features``), n and sse."""

    models: DataFrame
    features: tuple[str, ...]
    keys: tuple[str, ...]

    def attach(self, df: DataFrame) -> DataFrame:
        return attach_stats(df, self.models.select(*self.keys, F.struct("intercept", "coefficients").alias("_model")), list(self.keys))

    def prediction(self, terms: dict[str, Column] | None = None) -> Column:
        """Of rows with the attached model; null where an input is missing."""
        out = F.col("_model.intercept")
        for i, f in enumerate(self.features):
            out = out + F.get("_model.coefficients", F.lit(i)) * ((terms or {}).get(f, F.col(f)).cast("double"))
        return out

    def score(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        return self.attach(df).withColumn(out, self.prediction()).drop("_model")


def fit_regressions(rows: DataFrame, target: str, features: Sequence[str], series_keys: Sequence[str] = ()) -> SeriesRegression:
    """Least squares of every series on its complete rows. A series of fewer rows than inputs gets the shortest solution."""
    keys, names = list(series_keys), [*features, target]
    slim = _complete(rows, names, keys)
    means = slim.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(names)])
    centred = attach_stats(slim, means, keys)
    gap = [F.col(c) - F.col(f"_m_{i}") for i, c in enumerate(names)]
    products = [F.sum(gap[i] * gap[j]).alias(f"_q_{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    sums = centred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *products)
    triangle = F.array(*[f"_q_{i}_{j}" for i in range(len(names)) for j in range(i, len(names))])
    solved = join_on(sums.select(*keys, "n", solver(len(names))(triangle).alias("_s")), means, keys) if keys else attach_stats(
        sums.select("n", solver(len(names))(triangle).alias("_s")), means, keys
    )
    slope = F.slice("_s", 1, len(features))
    intercept = F.col(f"_m_{len(features)}")
    for i in range(len(features)):
        intercept = intercept - F.get("_s", F.lit(i)) * F.col(f"_m_{i}")
    models = solved.select(*keys, intercept.alias("intercept"), slope.alias("coefficients"), "n", F.element_at("_s", -1).alias("sse"))
    return SeriesRegression(models, tuple(features), tuple(keys))


# -- trees ---------------------------------------------------------------------------------------


def tree_value(tree: Column, inputs: Column, depth: int) -> Column:
    """Value of the leaf that ``inputs`` (array) reach in a compiled tree."""

    def down(node: Column, _: Column) -> Column:
        feature = F.coalesce(F.get(tree["feature"], node), F.lit(-1))
        left = F.coalesce(F.get(inputs, feature) <= F.get(tree["threshold"], node), F.lit(False))
        return F.when(feature < 0, node).otherwise(2 * node + F.when(left, 1).otherwise(2))

    return F.get(tree["value"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down))


@dataclass(frozen=True)
class SeriesTrees:
    """``models``: one row a series with ``base``, ``rate`` and ``trees``; a prediction is base + rate * sum of the trees."""

    models: DataFrame
    features: tuple[str, ...]
    keys: tuple[str, ...]
    depth: int

    def attach(self, df: DataFrame) -> DataFrame:
        return attach_stats(df, self.models.select(*self.keys, F.struct("base", "rate", "trees").alias("_model")), list(self.keys))

    def prediction(self, terms: dict[str, Column] | None = None) -> Column:
        """Of rows with the attached model."""
        inputs = F.array(*[(terms or {}).get(f, F.col(f)).cast("double") for f in self.features])
        total = F.aggregate("_model.trees", F.lit(0.0), lambda acc, t: acc + tree_value(t, inputs, self.depth))
        return F.col("_model.base") + F.col("_model.rate") * total

    def values(self) -> Column:
        """What each tree says, of rows with the attached model."""
        inputs = F.array(*[F.col(f).cast("double") for f in self.features])
        return F.transform("_model.trees", lambda t: tree_value(t, inputs, self.depth))

    def score(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        if self.walker is None:
            return self.attach(df).withColumn(out, self.prediction()).drop("_model")
        rows = self.with_ids(df)
        return rows.withColumn(out, self.walker(*[F.col(f) for f in self.features])).drop("_sid")

    def with_ids(self, df: DataFrame) -> DataFrame:
        """Rows with ``_sid``, the number of their series' model, as the walker needs it."""
        return _with_ids(df, self._numbered.select(*self.keys, "_sid"), list(self.keys))

    def trained(self, df: DataFrame, known: Column | None = None) -> DataFrame | None:
        """(keys, _mse, _k): mean square of what is left of the rows ``df`` of the fit, and the number of those with a prediction
        (``known`` is not null). None where the fit did not keep it, as for long series."""
        keys = list(self.keys)
        if "sse" not in self.models.columns or not self.models.where("sse IS NULL").isEmpty():
            return None
        left = self.models.select(*keys, (F.col("sse") / F.col("n")).alias("_mse"))
        counts = df.groupBy(*keys).agg(F.count(F.lit(1) if known is None else known).alias("_k"))
        return join_on(counts, left, keys) if keys else attach_stats(counts, left, keys)

    @cached_property
    def _numbered(self) -> DataFrame:
        one = F.row_number().over(Window.orderBy(*self.keys, F.lit(1))) - 1
        return self.models.withColumn("_sid", one)

    def tables(self) -> tuple[np.ndarray, ...] | None:
        """Arrays of all models as ``tree_growth.walk`` takes them, by ``_sid``; None where they are too large."""
        depth = self.depth
        n, trees = self.models.agg(F.count(F.lit(1)), F.max(F.size("trees"))).first()
        if not n or n > BROADCAST_SERIES or n * trees * 2**depth * 24 > MODEL_BYTES:
            return None
        inner = 2**depth - 1
        feature, threshold = np.full((n, trees, inner), -1, dtype=np.int64), np.full((n, trees, inner), np.nan)
        value, base, rate = np.zeros((n, trees, 2 * inner + 1)), np.zeros(n), np.zeros(n)
        table = self._numbered.select("_sid", "base", "rate", "trees").toArrow()
        for i in range(table.num_rows):
            sid, own = table.column("_sid")[i].as_py(), table.column("trees")[i].values
            base[sid], rate[sid] = table.column("base")[i].as_py(), table.column("rate")[i].as_py()
            for held, name in ((feature, "feature"), (threshold, "threshold"), (value, "value")):
                flat = own.field(name).flatten().to_numpy(zero_copy_only=False)
                held[sid, : len(own)] = flat.reshape(len(own), -1)
        return (*tg.filled(feature, threshold, value, depth), base, rate)

    @cached_property
    def walker(self):
        """Function of the inputs' columns that walks the trees on Arrow batches of rows with ``_sid``.

        All models go to the tasks, so it is None where they are more than ``MODEL_BYTES`` or series than are broadcast.
        """
        tables, depth = self.tables(), self.depth
        if tables is None:
            return None
        held = self.models.sparkSession.sparkContext.broadcast(tables)

        @F.pandas_udf("double")
        def walked(sid: pd.Series, *inputs: pd.Series) -> pd.Series:
            return pd.Series(tg.walk(held.value, depth, sid.to_numpy(), [x.to_numpy() for x in inputs]))

        return lambda *inputs: walked(F.col("_sid"), *[x.cast("double") for x in inputs])


_SPLIT = re.compile(r"If \(feature (\d+) <= ([^)]+)\)")


def _tree_arrays(text: str, depth: int) -> tuple[list, list, list]:
    """Heap-order arrays of one tree of a model's description, whose lines are in pre-order."""
    feature, threshold, value = [-1] * (2**depth - 1), [None] * (2**depth - 1), [None] * (2 ** (depth + 1) - 1)
    node, right = 0, []
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("If "):
            split = _SPLIT.match(line)
            if not split:
                raise ValueError(f"only numeric splits can be compiled: {line}")
            feature[node], threshold[node] = int(split[1]), float(split[2])
            right.append(2 * node + 2)
            node = 2 * node + 1
        elif line.startswith("Else"):
            node = right.pop()
        elif line.startswith("Predict:"):
            value[node] = float(line.removeprefix("Predict:"))
    return feature, threshold, value


def compiled(model: PipelineModel, spark: SparkSession) -> SeriesTrees:
    """A fitted forest or boosted trees of ``pyspark.ml`` as trees that an expression walks.

    Only the model passes through the driver, whose size its number of trees and depth bound.
    """
    inputs, last = model.stages[0].getInputCols(), model.stages[-1]
    depth = max(1, max(t.depth for t in last.trees))
    texts = re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", last.toDebugString)[1:]
    rows = []
    for i, (text, weight) in enumerate(zip(texts, last.treeWeights)):
        feature, threshold, value = _tree_arrays(text, depth)
        rows.append((i, feature, threshold, [None if v is None else v * weight for v in value]))
    table = spark.createDataFrame(rows, "tree int, feature array<int>, threshold array<double>, value array<double>")
    mean = "Forest" in type(last).__name__  # boosted trees are added up
    one = table.agg(F.sort_array(F.collect_list(F.struct("tree", "feature", "threshold", "value"))).alias("trees"))
    models = one.withColumns({"base": F.lit(0.0), "rate": F.lit(1.0 / len(rows) if mean else 1.0)})
    return SeriesTrees(models, tuple(inputs), (), depth)


def _edges(rows: DataFrame, features: Sequence[str], keys: list[str], bins: int) -> DataFrame:
    """(keys, _edges: for each feature its distinct inner quantiles in order)."""
    long = rows.select(*keys, *features).unpivot(keys, list(features), "_feature", "_value")
    cuts = {f"_q{i}": i / bins for i in range(1, bins)}
    q = quantiles(long, [*keys, "_feature"], "_value", cuts)
    q = q.select(*keys, "_feature", F.sort_array(F.array_distinct(F.array(*cuts))).alias("_cuts"))
    return q.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("_feature") == f, F.col("_cuts"))) for f in features]).alias("_edges"))


def _poisson(u: Column) -> Column:
    """A Poisson draw of mean 1 from a uniform number."""
    out = F.lit(0.0)
    for step in tg.poisson_steps():
        out = out + F.when(u >= step, 1.0).otherwise(0.0)
    return out


def _parts(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _series(rows: DataFrame, keys: list[str]) -> tuple[int, int, DataFrame]:
    """Number of series that fit into a task, of longer ones, and (keys, _sid) of the longer ones."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    longer = F.col("_rows") > LOCAL_ROWS
    few, many = sizes.agg(F.count_if(~longer), F.count_if(longer)).first()
    ids = sizes.where(longer).select(*keys, (F.row_number().over(Window.orderBy(*keys, F.lit(1))) - 1).alias("_sid"))
    return few, many, ids.checkpoint() if many else ids


def _with_ids(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return join_on(rows, F.broadcast(ids), keys) if keys else rows.withColumn("_sid", F.lit(0))


def _without(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return join_on(rows, F.broadcast(ids), keys, "left").where("_sid IS NULL").drop("_sid") if keys else rows.limit(0)


def _long_edges(rows: DataFrame, features: Sequence[str], bins: int) -> dict[int, list[np.ndarray]]:
    """Edges of the long series, which are at most the rows by ``LOCAL_ROWS``."""
    found = _edges(rows, features, ["_sid"], bins).collect()
    return {r["_sid"]: [np.array([v for v in e or [] if v is not None], dtype=float) for e in r["_edges"]] for r in found}


def _codes(arrays: dict, nulls: dict, names: Sequence[str], edges: list[np.ndarray]) -> np.ndarray:
    return np.vstack([tg.coded(arrays[c], nulls[c], e) for c, e in zip(names, edges)])


def _own_edges(arrays: dict, nulls: dict, names: Sequence[str], bins: int) -> list[np.ndarray]:
    return [tg.inner_edges(arrays[c][~nulls[c]], bins) for c in names]


def _kinds(rows: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)


_TREE = "tree int, feature array<int>, threshold array<double>, value array<double>"


def _tree_table(table, keys: list[str], trees: list[tuple], edges: list[np.ndarray], **same):
    """Arrow rows (keys, tree, feature, threshold, value, and what is the same in all) of a series' trees."""
    import pyarrow as pa

    out = {k: pa.concat_arrays(table.column(k).slice(0, 1).chunks).take(pa.array([0] * len(trees), pa.int32())) for k in keys}
    out["tree"] = pa.array([t[0] for t in trees], pa.int32())
    out["feature"] = pa.array([t[1].tolist() for t in trees], pa.list_(pa.int32()))
    out["threshold"] = pa.array([tg.thresholds(t[1], t[2], edges) for t in trees], pa.list_(pa.float64()))
    out["value"] = pa.array([tg.listed(t[3]) for t in trees], pa.list_(pa.float64()))
    for name, v in same.items():
        out[name] = pa.array([v] * len(trees), pa.float64())
    return pa.table(out)


def _local_forests(rows: DataFrame, features: Sequence[str], keys: list[str], series: int, row_keys: bool, trees: int, depth: int, bins: int, least_rows: int) -> DataFrame:
    """(keys, tree, feature, threshold, value, sse) of series that fit into a task; few series share out their trees."""
    groups = max(1, min(trees, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // max(series, 1))))
    if series >= rows.sparkSession.sparkContext.defaultParallelism:
        groups = 1
    names = list(features)

    def run(table):
        part = int(table.column("_part")[0].as_py())
        arrays, nulls = tg.columns(table.select([*dict.fromkeys(names), "_y", "_row"]))
        edges = _own_edges(arrays, nulls, names, bins)
        row = arrays["_row"].view(np.uint64) if row_keys else None
        made, said = tg.forest(
            _codes(arrays, nulls, names, edges), arrays["_y"], row, range(part, trees, groups), depth, bins + 1, least_rows, groups == 1
        )
        sse = float(((arrays["_y"] - said / max(len(made), 1)) ** 2).sum()) if groups == 1 else None
        return _tree_table(table, keys, made, edges, sse=sse, n=float(len(arrays["_y"])))

    each = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    each = each.repartition(_parts(rows), *keys, "_part")
    return each.groupBy(*keys, "_part").applyInArrow(run, f"{_kinds(rows, keys)}{_TREE}, sse double, n double")


def _level_rows(rows: DataFrame, edges: dict, names: list[str], features: np.ndarray, cuts: np.ndarray, level: int, which: range, width: int, row_keys: bool) -> DataFrame:
    """(_sid, tree, _n, _s): sums of a level's nodes by (node, input, code), one row a series, tree and task."""
    nodes = 2**level
    held = rows.sparkSession.sparkContext.broadcast((edges, features, cuts))

    def run(batches):
        import pyarrow as pa

        edges, features, cuts = held.value
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def rows_of(sid):
            n, s = sums.pop(sid)
            return pa.RecordBatch.from_pydict({
                "_sid": pa.array([sid] * len(which), pa.int32()), "tree": pa.array(list(which), pa.int32()),
                "_n": pa.array([v.tobytes() for v in n], pa.binary()), "_s": pa.array([v.tobytes() for v in s], pa.binary()),
            })

        for sid, arrays, nulls in tg.Blocks().of(batches):
            if sid not in sums:
                if (len(sums) + 1) * len(which) * nodes * len(names) * width * 16 > TASK_BYTES:
                    yield from [rows_of(k) for k in list(sums)]
                shape = (len(which), nodes, len(names), width)
                sums[sid] = np.zeros(shape), np.zeros(shape)
            n, s = sums[sid]
            cols, y = _codes(arrays, nulls, names, edges[sid]), arrays["_y"]
            row = arrays["_row"].view(np.uint64) if row_keys else None
            for a in range(0, len(y), tg.BLOCK):
                block, own = cols[:, a : a + tg.BLOCK], y[a : a + tg.BLOCK]
                for i, tree in enumerate(which):
                    if row is None:
                        inputs, target, w = block, own, np.ones(len(own))
                    else:
                        w = tg.draws(row[a : a + tg.BLOCK], tree)
                        keep = np.flatnonzero(w)
                        inputs, target, w = block[:, keep], own[keep], w[keep].astype(float)
                    at = tg.place(inputs, features[sid, tree], cuts[sid, tree], level)
                    hn, hs = tg.histograms(inputs, at, nodes, width, w, w * target)
                    n[i] += hn
                    s[i] += hs
        yield from [rows_of(k) for k in list(sums)]

    return rows.mapInArrow(run, "_sid int, tree int, _n binary, _s binary")


def _cell_rows(rows: DataFrame, edges: dict, names: list[str], which: range, row_keys: bool, squares: bool = False) -> DataFrame:
    """(_sid, tree, _n, _s, _q): weight, weighted target and weighted square of each cell of a series' grid of codes,
    one row a series, tree and task."""
    held = rows.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        import pyarrow as pa

        edges = held.value
        sums: dict[int, list[np.ndarray]] = {}

        def rows_of(sid):
            found = sums.pop(sid)
            out = {"_sid": pa.array([sid] * len(which), pa.int32()), "tree": pa.array(list(which), pa.int32())}
            for name, v in zip(("_n", "_s", "_q"), found):
                out[name] = pa.array([r.tobytes() for r in v], pa.binary())
            return pa.RecordBatch.from_pydict(out)

        for sid, arrays, nulls in tg.Blocks().of(batches):
            size = _grid(edges[sid])
            if sid not in sums:
                if sum(v[0].nbytes * len(v) for v in sums.values()) + len(which) * size * 24 > TASK_BYTES:
                    yield from [rows_of(k) for k in list(sums)]
                sums[sid] = [np.zeros((len(which), size)) for _ in range(2 + squares)]
            cell = np.zeros(len(arrays["_y"]), dtype=np.int64)
            for c, e in zip(_codes(arrays, nulls, names, edges[sid]), edges[sid]):
                cell = cell * (len(e) + 2) + c
            row = arrays["_row"].view(np.uint64) if row_keys else None
            step = 4 * tg.BLOCK
            for a in range(0, len(cell), step):
                at, y = cell[a : a + step], arrays["_y"][a : a + step]
                for i, tree in enumerate(which):
                    w = tg.draws(row[a : a + step], tree).astype(float) if row is not None else np.ones(len(y))
                    for v in sums[sid]:
                        v[i] += np.bincount(at, w, size)
                        w = w * y
        yield from [rows_of(k) for k in list(sums)]

    return rows.mapInArrow(run, "_sid int, tree int, _n binary, _s binary" + (", _q binary" if squares else ""))


def _grid(edges: list[np.ndarray]) -> int:
    size = 1
    for e in edges:
        size *= len(e) + 2
    return size


def _grid_codes(edges: list[np.ndarray]) -> np.ndarray:
    """Codes of all cells of a grid, in order."""
    return np.stack([c.ravel() for c in np.indices([len(e) + 2 for e in edges])])


def _added(table, name: str) -> np.ndarray:
    return sum(np.frombuffer(v, dtype=float) for v in table.column(name).to_pylist())


def _long_forests(rows: DataFrame, features: Sequence[str], row_keys: bool, series: int, trees: int, depth: int, bins: int, least_rows: int) -> DataFrame:
    """(_sid, tree, feature, threshold, value) of series longer than a task takes, whose rows stay where they are.

    Where the bins make few cells, one pass sums each tree's cells, and a task a tree grows it from them. Otherwise
    each level is a pass, and the trees grown so far, at most as many as there are long series, go to the tasks.
    """
    import pyarrow as pa

    names, width = list(features), bins + 1
    spark = rows.sparkSession
    edges = _long_edges(rows, features, bins)
    parts = _parts(rows)
    if max(map(_grid, edges.values())) <= GRID_CELLS:

        def whole(table):
            sid, tree = table.column("_sid")[0].as_py(), table.column("tree")[0].as_py()
            n, s = _added(table, "_n"), _added(table, "_s")
            keep = np.flatnonzero(n)
            cols = _grid_codes(edges[sid])[:, keep]
            made = [(tree, *tg.grow(cols, n[keep], s[keep], depth, width, least_rows)[:3])] if len(keep) else []
            return _tree_table(table, ["_sid"], made, edges[sid])

        found = []
        for which in _shares(trees, series * max(map(_grid, edges.values())) * 24):
            sums = _cell_rows(rows, edges, names, which, row_keys).repartition(parts, "_sid", "tree")
            found.append(sums.groupBy("_sid", "tree").applyInArrow(whole, f"_sid int, {_TREE}").checkpoint())
        return _union(found)
    inner = 2**depth - 1
    feature, cut = np.full((series, trees, inner), -1, dtype=np.int16), np.full((series, trees, inner), -1, dtype=np.int16)
    value = np.full((series, trees, 2 * inner + 1), np.nan)
    for level in range(depth):
        nodes = 2**level

        def splits(table):
            shape = (nodes, len(names), width)
            hn, hs = _added(table, "_n").reshape(shape), _added(table, "_s").reshape(shape)
            f, b, left, right = tg.best_splits(hn, hs, least_rows)
            n = hn[0, 0].sum()
            return pa.table({
                "_sid": table.column("_sid").slice(0, 1), "tree": table.column("tree").slice(0, 1), "f": pa.array([f.tolist()], pa.list_(pa.int32())),
                "b": pa.array([b.tolist()], pa.list_(pa.int32())), "v": pa.array([np.column_stack([left, right]).ravel().tolist()], pa.list_(pa.float64())),
                "root": pa.array([hs[0, 0].sum() / n if n else np.nan], pa.float64()),
            })

        for which in _shares(trees, series * nodes * len(names) * width * 16):
            sums = _level_rows(rows, edges, names, feature, cut, level, which, width, row_keys).repartition(parts, "_sid", "tree")
            for r in sums.groupBy("_sid", "tree").applyInArrow(splits, "_sid int, tree int, f array<int>, b array<int>, v array<double>, root double").collect():
                at = r["_sid"], r["tree"]
                feature[at][nodes - 1 : 2 * nodes - 1] = r["f"]
                cut[at][nodes - 1 : 2 * nodes - 1] = r["b"]
                value[at][2 * nodes - 1 : 4 * nodes - 1] = r["v"]
                if not level:
                    value[at][0] = r["root"]
    out = [
        (sid, t, feature[sid, t].tolist(), tg.thresholds(feature[sid, t], cut[sid, t], edges[sid]), tg.listed(value[sid, t]))
        for sid in range(series) for t in range(trees) if not np.isnan(value[sid, t, 0])
    ]
    return spark.createDataFrame(out, f"_sid int, {_TREE}")


def _shares(trees: int, bytes_a_tree: int) -> list[range]:
    """Trees in ranges whose sums fit into a task's memory."""
    size = max(1, min(trees, TASK_BYTES // max(bytes_a_tree, 1)))
    return [range(a, min(a + size, trees)) for a in range(0, trees, size)]


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def _gathered(trees: DataFrame, keys: list[str], *same: str) -> DataFrame:
    """(keys, trees: array of compiled trees in order, and columns that are the same in all trees)."""
    tree = F.struct("tree", "feature", "threshold", "value")
    return trees.groupBy(*keys).agg(F.sort_array(F.collect_list(tree)).alias("trees"), *[F.max(c).alias(c) for c in same])


def fit_forests(
    rows: DataFrame, target: str, features: Sequence[str], series_keys: Sequence[str] = (), row_keys: Sequence[str] = (), trees: int = 100,
    depth: int = 5, bins: int = BINS, least_rows: int = 2, bootstrap: bool = True, seed: int = 42,
) -> SeriesTrees:
    """A forest a series. ``row_keys`` identify the rows of a series; the draws are hashed from them.

    A series of at most ``LOCAL_ROWS`` rows is fitted in a task (or several, a share of its trees each); the rows of
    a longer one stay where they are (``_long_forests``).
    """
    keys = list(series_keys)
    if bootstrap and not row_keys:
        raise ValueError("bootstrap draws need row_keys")
    ensure_checkpoint_dir(rows.sparkSession)
    row = F.xxhash64(F.xxhash64(*row_keys, F.lit(seed))) if bootstrap else F.lit(0).cast("long")
    names = list(dict.fromkeys(features))
    slim = rows.where(F.col(target).isNotNull()).select(
        *keys, *[F.col(c).cast("double").alias(c) for c in names], F.col(target).cast("double").alias("_y"), row.alias("_row")
    )
    few, many, ids = _series(slim, keys)
    found, settings = [], (bootstrap, trees, depth, bins, least_rows)
    if many:  # read by every pass
        slim = (slim.repartition(_parts(rows), "_row") if bootstrap else slim.repartition(_parts(rows))).checkpoint()
    if few or not many:
        short = _without(slim, ids, keys) if many else slim
        found.append(_local_forests(short, features, keys, few, *settings))
    if many:
        own = _with_ids(slim, ids, keys).select("_sid", *names, "_y", "_row")
        made = _long_forests(own, features, bootstrap, many, *settings[1:])
        made = join_on(made, ids, ["_sid"]).drop("_sid").withColumns({"sse": F.lit(None).cast("double"), "n": F.lit(None).cast("double")})
        found.append(made.select(*keys, *[c.split()[0] for c in _TREE.split(", ")], "sse", "n"))
    models = _gathered(_union(found), keys, "sse", "n").withColumns({"base": F.lit(0.0), "rate": F.lit(1.0) / F.size("trees")})
    return SeriesTrees(models.checkpoint(), tuple(features), tuple(keys), depth)


def boost(codes: np.ndarray, n: np.ndarray, total: np.ndarray, rounds: int, depth: int, rate: float, bins: int, least_rows: int) -> tuple[float, list[tuple]]:
    """Base and trees (feature, bin, value) of cells with codes, number of rows and sum of the target."""
    base, trees, _ = tg.boost(codes, n, total, rounds, depth, rate, bins, least_rows)
    return base, [(f.tolist(), b.tolist(), tg.listed(v)) for f, b, v in trees]


def fit_boosted_trees(
    rows: DataFrame, target: str, features: Sequence[str], series_keys: Sequence[str] = (), rounds: int = 100, depth: int = 3,
    rate: float = 0.1, bins: int = BINS, least_rows: int = 1,
) -> SeriesTrees:
    """Squared-error boosting a series.

    Rows of a series that fall into the same bins cannot be told apart by a tree, so they are one cell with a count
    and a sum, which loses nothing. All rounds of a series run on its cells in one task: at most
    ``(bins + 1) ** len(features)`` of them, and at most its rows, whatever the table's size. Fewer bins bound a long
    series of many inputs. Rows of a series longer than ``LOCAL_ROWS`` become cells where they are.
    """
    keys, names = list(series_keys), list(features)
    ensure_checkpoint_dir(rows.sparkSession)
    slim = rows.where(F.col(target).isNotNull()).select(
        *keys, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(names)], F.col(target).cast("double").alias("_y")
    )
    few, many, ids = _series(slim, keys)
    found = []
    settings = (rounds, depth, rate, bins, least_rows)

    def own(table):
        arrays, nulls = tg.columns(table.select([*dict.fromkeys(names), "_y"]))
        edges = _own_edges(arrays, nulls, names, bins)
        cols, at = tg.cells(_codes(arrays, nulls, names, edges), bins + 1)
        n, y = np.bincount(at, minlength=cols.shape[1]).astype(float), arrays["_y"]
        base, trees, now = tg.boost(cols.T, n, np.bincount(at, y, cols.shape[1]), *settings)
        return _tree_table(table, keys, [(i, *t) for i, t in enumerate(trees)], edges, sse=float(((y - now[at]) ** 2).sum()), n=float(len(y)), base=base)

    if few or not many:
        short = (_without(slim, ids, keys) if many else slim).withColumn("_all", F.lit(1)).repartition(_parts(rows), *keys, "_all")
        found.append(short.groupBy(*keys, "_all").applyInArrow(own, f"{_kinds(rows, keys)}{_TREE}, sse double, n double, base double"))
    if many:
        long = _with_ids(slim, ids, keys).select("_sid", *dict.fromkeys(names), "_y")
        edges = _long_edges(long, names, bins)
        held = rows.sparkSession.sparkContext.broadcast(edges)

        def binned(batches):
            import pyarrow as pa

            for sid, arrays, nulls in tg.Blocks().of(batches):
                cols, at = tg.cells(_codes(arrays, nulls, names, held.value[sid]), bins + 1)
                codes = np.ascontiguousarray(cols.T.astype(np.uint16))
                yield pa.RecordBatch.from_pydict({
                    "_sid": pa.array(np.full(len(codes), sid), pa.int32()), "_codes": pa.array([r.tobytes() for r in codes], pa.binary()),
                    "_n": pa.array(np.bincount(at, minlength=len(codes)), pa.int64()), "_s": pa.array(np.bincount(at, arrays["_y"], len(codes)), pa.float64()),
                })

        sums = long.mapInArrow(binned, "_sid int, _codes binary, _n long, _s double").groupBy("_sid", "_codes").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))

        def grown(table):
            import pyarrow.compute as pc

            table = table.take(pc.sort_indices(table, [("_codes", "ascending")]))  # one order of sums wherever the cells come from
            codes = np.frombuffer(b"".join(table.column("_codes").to_pylist()), dtype=np.uint16).reshape(table.num_rows, len(names))
            codes = codes.astype(np.uint8 if bins < 255 else np.uint16)
            base, trees, _ = tg.boost(codes, table.column("_n").to_numpy().astype(float), table.column("_s").to_numpy(), *settings)
            return _tree_table(table, ["_sid"], [(i, *t) for i, t in enumerate(trees)], held.value[table.column("_sid")[0].as_py()], base=base)

        made = sums.groupBy("_sid").applyInArrow(grown, f"_sid int, {_TREE}, base double")
        made = join_on(made, ids, ["_sid"]).drop("_sid").withColumns({"sse": F.lit(None).cast("double"), "n": F.lit(None).cast("double")})
        found.append(made.select(*keys, *[c.split()[0] for c in _TREE.split(", ")], "sse", "n", "base"))
    models = _gathered(_union(found), keys, "sse", "n", "base").withColumn("rate", F.lit(rate))
    return SeriesTrees(models.checkpoint(), tuple(features), tuple(keys), depth)


@dataclass(frozen=True)
class SeriesHybrid:
    """A baseline column plus a model of what it leaves."""

    rest: SeriesTrees | SeriesRegression
    baseline: str

    def score(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        return self.rest.score(df, "_rest").withColumn(out, F.col(self.baseline) + F.col("_rest")).drop("_rest")

    def trained(self, df: DataFrame) -> DataFrame | None:
        return self.rest.trained(df, F.col(self.baseline)) if isinstance(self.rest, SeriesTrees) else None


def fit_hybrid(rows: DataFrame, target: str, baseline: str, features: Sequence[str], fit=fit_forests, **settings) -> SeriesHybrid:
    """``fit`` on target minus the ``baseline`` column, which holds any forecast (naive, seasonal, AR(1), ...)."""
    rest = rows.where(F.col(baseline).isNotNull()).withColumn("_rest", F.col(target) - F.col(baseline))
    return SeriesHybrid(fit(rest, "_rest", features, **settings), baseline)
