"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NODES = (
    "tree int, node int, feature int, split double, left int, right int, "
    "size int, depth int, sample_size int"
)
_EULER = 0.5772156649015329


def _path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    mean = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, mean, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationForest:
    """Node table of the trees and the score offset; a few ten thousand rows."""

    columns: tuple[str, ...]
    nodes: pd.DataFrame
    offset: float


# Random numbers are read from an MD5 of what they are for, so that any engine can draw them again.
DIGITS = 13


def _drawn(*parts: object) -> float:
    """A number in [0, 1) for these parts."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:DIGITS], 16) / 16.0**DIGITS


def _draw(*parts: Column) -> Column:
    """``_drawn`` as a column."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint") / F.lit(16.0**DIGITS)


def _grow(pdf: pd.DataFrame, n_features: int, sample_size: int, seed: int) -> pd.DataFrame:
    """One tree from the rows of one tree, in an order that does not depend on Spark.

    ``_sampled`` draws a few rows more than wanted: the tree takes those with the lowest draws.
    """
    pdf = pdf.sort_values(["pick", "id"]).head(sample_size)
    tree = int(pdf["tree"].iloc[0])
    x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), n_features)
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    # A node's place: 1 for the root, 2p and 2p + 1 below the place p.
    todo = [(np.arange(len(x)), 0, -1, 0, 1)]
    while todo:
        rows, depth, parent, side, place = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = me
        nodes.append([tree, me, -1, 0.0, -1, -1, len(rows), depth, len(x)])
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(usable):
            continue
        feature = int(usable[int(_drawn(seed, "feature", tree, place) * len(usable))])
        split = low[feature] + _drawn(seed, "split", tree, place) * (high[feature] - low[feature])
        left = x[rows, feature] < split
        if left.all() or not left.any():
            split = float(high[feature])
            left = x[rows, feature] < split
        nodes[me][2], nodes[me][3] = feature, float(split)
        todo.append((rows[~left], depth + 1, me, 1, 2 * place + 1))
        todo.append((rows[left], depth + 1, me, 0, 2 * place))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])


def _sampled(
    df: DataFrame, vector: Column, row_id: Column, n: int, n_trees: int, size: int, seed: int
) -> DataFrame:
    """About ``size`` rows (a few more) for each tree, chosen by hashes of the row id.

    Each row takes part in each tree with the same chance, independently, at every size of
    the table. Trees are not tried one by one: each draw says how many trees the row
    leaves out before the next one it is in. In a large table nearly all rows
    leave out all trees by their first draw, so a row costs one hash.
    """
    share = min(1.0, (size + 6.0 * math.sqrt(size)) / n)
    rows = df.select(row_id.cast("string").alias("id"), vector.alias("x"))

    def left_out(i: Column) -> Column:
        if share >= 1.0:
            return F.lit(0).cast("bigint")
        u = _draw(F.lit(seed), F.lit("rows"), F.col("id"), i) + F.lit(16.0**-DIGITS)
        return F.floor(F.log(u) / F.lit(math.log(1.0 - share)))

    chosen = rows.withColumn("first", left_out(F.lit(0))).filter(F.col("first") < n_trees)
    trees = F.aggregate(
        F.sequence(F.lit(1), F.lit(n_trees)),
        F.array("first"),
        lambda trees, i: F.when(F.element_at(trees, -1) >= n_trees - 1, trees).otherwise(
            F.concat(trees, F.array(F.element_at(trees, -1) + 1 + left_out(i)))
        ),
    )
    drawn = chosen.select("id", "x", F.explode(trees).alias("tree")).filter(F.col("tree") < n_trees)
    drawn = drawn.withColumn("tree", F.col("tree").cast("int"))
    return drawn.withColumn("pick", _draw(F.lit(seed), F.lit("order"), F.col("id"), F.col("tree")))


def fit_isolation_forest(
    df: DataFrame,
    columns: Sequence[str],
    row_id: str | Column,
    min_rows: int,
    n_trees: int = 100,
    sample_size: int = 256,
    contamination: float = 0.05,
    seed: int = 42,
) -> IsolationForest | None:
    """Fit a forest; None when there are fewer than ``min_rows`` rows.

    Trees are grown one per task from ``sample_size`` rows each, whatever the size
    of the table. The node table has at most n_trees * (2 * sample_size - 1) rows.
    The offset is the score that the share ``contamination`` of the training rows
    exceeds.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    n = df.count()
    if n < max(min_rows, 2):
        return None
    size = min(sample_size, n)
    id_column = F.col(row_id) if isinstance(row_id, str) else row_id
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    k = len(columns)
    nodes = (
        # Few rows but much work: without a fixed number of tasks they would be merged.
        _sampled(df, vector, id_column, n, n_trees, size, seed)
        .repartition(min(n_trees, tasks), "tree")
        .groupBy("tree")
        .applyInPandas(lambda pdf: _grow(pdf, k, size, seed), _NODES)
        .toPandas()
        .sort_values(["tree", "node"], ignore_index=True)
    )
    if len(nodes) > n_trees * (2 * sample_size - 1):
        raise ValueError("node table larger than its bound")
    model = IsolationForest(tuple(columns), nodes, 0.0)
    # Equal rows score alike, so each distinct row is scored once.
    distinct = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows")).repartition(tasks)
    scores = (
        distinct.select(_raw_score(model).alias("a"), "_rows")
        .groupBy(F.round("a", 6).alias("a"))
        .agg(F.sum("_rows").alias("_rows"))
    )
    # Scores lie in (0, 1): at six digits there are at most a million of them.
    offset = scores.agg(
        F.percentile("a", F.lit(1.0 - contamination), F.col("_rows"))
    ).first()[0]
    return IsolationForest(tuple(columns), nodes, float(offset))


def _raw_score(model: IsolationForest) -> Column:
    """2 ** -(mean path length / expected path length), by a vectorised tree walk."""
    t = model.nodes
    n_trees = t["tree"].nunique()
    roots = np.flatnonzero(t["node"].to_numpy() == 0)
    first = np.repeat(roots, np.diff(np.append(roots, len(t))))
    leaf = t["feature"].to_numpy() < 0
    here = np.arange(len(t))
    # All trees in one set of arrays; a leaf leads to itself.
    feature = np.where(leaf, 0, t["feature"].to_numpy())
    split = t["split"].to_numpy()
    child = np.column_stack(
        [np.where(leaf, here, first + t[side].to_numpy()) for side in ("left", "right")]
    ).ravel()
    expected = np.maximum(_path_length(t["sample_size"].to_numpy()), 1.0)
    path = (t["depth"].to_numpy() + _path_length(t["size"].to_numpy())) / expected / n_trees
    levels = int(t["depth"].max())

    def walk(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        # Few rows at a time, so that the positions in all trees stay in the cache.
        for begin in range(0, len(x), 256):
            part = x[begin : begin + 256]
            flat, row = part.ravel(), (np.arange(len(part)) * part.shape[1])[:, None]
            at = np.broadcast_to(roots, (len(part), n_trees))
            for _ in range(levels):
                right = flat[row + feature[at]] >= split[at]
                at = child[2 * at + right]
            out[begin : begin + 256] = path[at].sum(axis=1)
        return np.power(2.0, -out)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(walk(np.column_stack([s.to_numpy(dtype=float) for s in batch])))

    return score(*[F.col(c).cast("double") for c in model.columns])


def score_isolation_forest(
    df: DataFrame, model: IsolationForest | None, out: str = "anomaly_score"
) -> DataFrame:
    """Adds a score from 0 (normal) to 1; 0.0 without a model."""
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    raw = _raw_score(model)
    decision = F.lit(model.offset) - F.col("_raw")
    clipped = F.least(F.greatest(F.lit(0.5) - decision, F.lit(0.0)), F.lit(1.0))
    return df.withColumn("_raw", raw).withColumn(out, clipped).drop("_raw")


def predict_anomaly(scored: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Adds ``is_anomaly``: the forest's decision is negative."""
    return scored.withColumn("is_anomaly", F.col(score) > 0.5)


def save_forest(spark, model: IsolationForest, path: str) -> None:
    """Write the model as a small Parquet table."""
    (
        spark.createDataFrame(model.nodes, _NODES)
        .withColumn("offset", F.lit(model.offset))
        .withColumn("columns", F.array(*[F.lit(c) for c in model.columns]))
        .write.mode("errorifexists")
        .parquet(path)
    )


def load_forest(spark, path: str) -> IsolationForest:
    pdf = spark.read.parquet(path).toPandas().sort_values(["tree", "node"], ignore_index=True)
    names = [c.split()[0] for c in _NODES.split(", ")]
    return IsolationForest(tuple(pdf["columns"][0]), pdf[names], float(pdf["offset"][0]))
