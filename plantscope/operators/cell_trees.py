"""Forests and boosted trees of ``pyspark.ml`` grown from cells: rows that no split can tell apart.

``pyspark.ml`` passes over all rows for every few nodes of every tree. Its splits are at most ``BINS - 1`` an input, so
few inputs make few cells, whatever the rows hold. One pass sums weight, target and square of each cell (of each tree,
with its own draws), and a task a tree grows it from these sums. The trees are saved as ``pyspark.ml`` saves its own and
loaded, so what comes out is its model. Splits are taken from the counts of all values, not of a sample.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantscope.operators import tree_growth as tg
from plantscope.operators.series_models import GRID_CELLS, _added, _cell_rows, _grid, _grid_codes, _parts, _shares, _union, compiled
from plantscope.session import ensure_checkpoint_dir

BINS = 32
VALUES = 100_000  # of an input, whose counts the driver takes
_NODE = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
    "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


def split_points(values: Sequence[float], counts: Sequence[int], bins: int = BINS) -> np.ndarray:
    """Thresholds between values, all or about ``bins`` equally heavy stretches, as ``pyspark.ml`` chooses them."""
    if len(values) <= bins:
        return np.array([(a + b) / 2 for a, b in zip(values, values[1:])])
    stride = sum(counts) / bins
    out, now, goal = [], counts[0], stride
    for i in range(1, len(values)):
        before, now = now, now + counts[i]
        if abs(before - goal) < abs(now - goal):
            out.append((values[i - 1] + values[i]) / 2)
            goal += stride
    return np.array(out)


def _splits(rows: DataFrame, names: list[str]) -> list[np.ndarray] | None:
    distinct = rows.agg(*[F.approx_count_distinct(c) for c in names], F.count(F.lit(1))).first()
    if not distinct[-1] or max(distinct[:-1]) > VALUES:
        return None
    long = rows.select(*names).unpivot([], names, "_input", "_value")
    found: dict[str, list] = {c: [] for c in names}
    for r in long.groupBy("_input", (F.col("_value") + 0.0).alias("_value")).agg(F.count(F.lit(1)).alias("_k")).collect():
        found[r["_input"]].append((r["_value"], r["_k"]))
    return [split_points(*zip(*sorted(found[c]))) for c in names]


def _tree_nodes(feature: np.ndarray, cut: np.ndarray, edges: list[np.ndarray], ends: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> list[dict]:
    """Node data of a tree in pre-order, from the sums of the cells that end in each node."""
    size = 2 * len(feature) + 1
    total = np.stack([np.bincount(ends, v, size) for v in (n, s, q)])
    for node in range(size - 1, 0, -1):
        total[:, (node - 1) // 2] += total[:, node]
    out: list[dict] = []

    def add(node: int) -> int:
        own, place = total[:, node], len(out)
        mean = own[1] / own[0]
        impurity = max(own[2] / own[0] - mean * mean, 0.0)
        row = {"id": place, "prediction": mean, "impurity": impurity, "impurityStats": own.tolist(), "rawCount": int(round(own[0])), "gain": -1.0, "leftChild": -1, "rightChild": -1}
        row["split"] = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
        out.append(row)
        if node < len(feature) and feature[node] >= 0:
            left, right = total[:, 2 * node + 1], total[:, 2 * node + 2]
            row["gain"] = float((left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - own[1] ** 2 / own[0]) / own[0])
            row["split"] = {"featureIndex": int(feature[node]), "leftCategoriesOrThreshold": [float(edges[feature[node]][cut[node]])], "numCategories": -1}
            row["leftChild"] = add(2 * node + 1)
            row["rightChild"] = add(2 * node + 2)
        return place

    add(0)
    return out


def _node_table(trees: list[tuple[int, list[dict]]]):
    import pyarrow as pa

    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    data = pa.struct([
        ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
        ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", split),
    ])
    ids = [tree for tree, nodes in trees for _ in nodes]
    return pa.table({"treeID": pa.array(ids, pa.int32()), "nodeData": pa.array([node for _, nodes in trees for node in nodes], data)})


def _saved(nodes: DataFrame, estimator, model_class, tree_weights: list[float], inputs: Sequence[str], spark):
    """The model of ``nodes``, by way of the files that ``pyspark.ml`` keeps a model in."""
    path = f"{ensure_checkpoint_dir(spark)}/plantscope-trees-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{path}/data")
    set_params = {p.name: v for p, v in estimator._paramMap.items()} | {"impurity": "variance"}

    def metadata(kind: str, params: dict, **more) -> str:
        head = {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": f"{kind}_{uuid.uuid4().hex[:12]}"}
        return json.dumps(head | {"paramMap": params, "defaultParamMap": {}} | more)

    whole = metadata(model_class.__name__, set_params, numFeatures=len(inputs), numTrees=len(tree_weights))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    of_tree = {k: v for k, v in set_params.items() if k in ("impurity", "featuresCol", "labelCol", "predictionCol", "maxDepth", "minInstancesPerNode", "maxMemoryInMB", "seed")}
    rows = [(i, metadata("DecisionTreeRegressionModel", of_tree), float(w)) for i, w in enumerate(tree_weights)]
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    return model_class.load(path)


def fit_on_cells(estimator: RandomForestRegressor | GBTRegressor, rows: DataFrame, inputs: Sequence[str], target: str):
    """The estimator's model of complete ``rows``; None where the inputs make too many cells.

    Draws are hashed from a row's place in the partitions of ``rows``, as those of ``pyspark.ml`` depend on it.
    """
    spark, names = rows.sparkSession, [f"_x{i}" for i in range(len(inputs))]
    slim = rows.select(*[F.col(c).cast("double").alias(n) for c, n in zip(inputs, names)], F.col(target).cast("double").alias("_y"))
    edges = _splits(slim, names)
    if edges is None or _grid(edges) > GRID_CELLS:
        return None
    depth, seed = estimator.getMaxDepth(), estimator.getSeed()
    forest = isinstance(estimator, RandomForestRegressor)
    trees = estimator.getNumTrees() if forest else 1
    drawn = forest and estimator.getBootstrap()
    row = F.xxhash64(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))) if drawn else F.lit(0).cast("long")
    parts = _parts(rows)
    slim = slim.withColumns({"_row": row, "_sid": F.lit(0)})
    slim = slim.repartition(parts, "_row") if drawn else slim
    least, width = estimator.getMinInstancesPerNode(), max(len(e) for e in edges) + 2
    offered = -(-len(names) // 3) if trees > 1 else len(names)

    def cells_of(table):
        n, s, q = (_added(table, c) for c in ("_n", "_s", "_q"))
        keep = np.flatnonzero(n)
        return _grid_codes(edges)[:, keep], n[keep], s[keep], q[keep]

    def one_tree(table):
        tree = table.column("tree")[0].as_py()
        cols, n, s, q = cells_of(table)
        rng = np.random.default_rng([seed & 0xFFFFFFFF, tree])

        def offer(nodes: int) -> np.ndarray:
            """The inputs a node may split by, drawn anew for each."""
            return rng.random((nodes, len(names))).argsort(axis=1).argsort(axis=1) < offered

        feature, cut, _, ends = tg.grow(cols, n, s, depth, width, least, offer if offered < len(names) else None, ends=True)
        return _node_table([(tree, _tree_nodes(feature, cut, edges, ends, n, s, q))])

    if forest:
        found = []
        for which in _shares(trees, _grid(edges) * 24):
            sums = _cell_rows(slim, {0: edges}, names, which, drawn, squares=True).repartition(parts, "tree")
            found.append(sums.groupBy("tree").applyInArrow(one_tree, _NODE))
        return _saved(_union(found), estimator, RandomForestRegressionModel, [1.0] * trees, inputs, spark)
    rounds, rate = estimator.getMaxIter(), estimator.getStepSize()

    def all_trees(table):
        """The first tree of the target, the later ones of twice what is left, as squared error's gradient has it."""
        cols, n, s, q = cells_of(table)
        now, out = np.zeros(len(n)), []
        for tree in range(rounds):
            scale = 2.0 if tree else 1.0
            rest, square = scale * (s - n * now), scale**2 * (q - 2 * now * s + now * now * n)
            feature, cut, value, ends = tg.grow(cols, n, rest, depth, width, least, ends=True)
            now = now + (rate if tree else 1.0) * value[ends]
            out.append((tree, _tree_nodes(feature, cut, edges, ends, n, rest, square)))
        return _node_table(out)

    sums = _cell_rows(slim, {0: edges}, names, range(1), False, squares=True)
    nodes = sums.groupBy("tree").applyInArrow(all_trees, _NODE)
    return _saved(nodes, estimator, GBTRegressionModel, [1.0] + [rate] * (rounds - 1), inputs, spark)


def predictor(model, spark):
    """Function of the inputs' columns that looks a tree ensemble's prediction up; None where its thresholds make too many cells.

    Rows between the same thresholds get the same prediction, so all trees are walked once a cell and not once a row.
    Missing inputs are refused, as the model's assembler refuses them.
    """
    own = compiled(model, spark)
    tables = own.tables()
    if tables is None:
        return None
    feature, threshold = tables[0], tables[1]
    used = ~np.isnan(threshold)
    edges = [np.unique(threshold[used & (feature == i)]) for i in range(len(own.features))]
    if np.prod([len(e) + 1.0 for e in edges]) > GRID_CELLS:
        return None
    codes = np.indices([len(e) + 1 for e in edges]).reshape(len(edges), -1)
    inside = [np.append(e, np.inf)[c] for e, c in zip(edges, codes)]
    value = tg.walk(tables, own.depth, np.zeros(codes.shape[1], dtype=np.int64), inside)
    held = spark.sparkContext.broadcast((edges, value))

    @F.pandas_udf("double")
    def found(*inputs: pd.Series) -> pd.Series:
        edges, value = held.value
        cell = np.zeros(len(inputs[0]), dtype=np.int64)
        for x, e in zip(inputs, edges):
            if x.isna().any():
                raise ValueError("an input to score is missing")
            cell = cell * (len(e) + 1) + np.searchsorted(e, x.to_numpy(), "left")
        return pd.Series(value[cell])

    return lambda *inputs: found(*[x.cast("double") for x in inputs])


def score_on_cells(model, df: DataFrame, out: str = "predicted") -> DataFrame | None:
    """``df`` with the prediction of a fitted pipeline that ends in a tree ensemble; None for other models."""
    if not isinstance(model.stages[-1], (RandomForestRegressionModel, GBTRegressionModel)):
        return None
    look = predictor(model, df.sparkSession)
    return None if look is None else df.withColumn(out, look(*[F.col(c) for c in model.stages[0].getInputCols()]))
