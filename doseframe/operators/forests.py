"""Forests of all task heads together, as Spark ML grows them: Poisson bootstraps, quantile bins, a third of the features a node.

Values are binned once. Rows with the same bins are a pattern, which no tree parts: a tree needs the sums of its bootstrap by
pattern only. One scan of the training rows makes those of all trees and heads, and a task a tree grows it from them. A row's
draws are hashes of its number, the seed and the tree, and sums are whole numbers, so a forest is the same for any partitioning.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.operators.boosting import UNITS, Head, best_split, binned, edges_of, histograms, unpacked
from doseframe.operators.headed import parameters, with_features
from doseframe.operators.joins import split_join
from doseframe.operators.ranks import distributed_rank
from doseframe.sources.shared import materialised

#: Defaults of Spark ML's forests: levels of splits, bins of a feature; rows of a node at least.
DEPTH, BINS, LEAST = 5, 32, 2
#: Patterns of all heads together that are broadcast at most, and sums that a task keeps.
PATTERNS, KEPT = 300_000, 4_000_000
#: Bits of a hash that are a draw.
DRAW = 20
_UPTO = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: How often a row with this draw is in a bootstrap: a Poisson number of mean 1.
TIMES = np.searchsorted(_UPTO, (np.arange(1 << DRAW) + 0.5) / (1 << DRAW)).astype(np.uint8)


def times(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row, told by its number, is in the bootstrap of a tree."""
    with np.errstate(over="ignore"):
        z = rows.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return TIMES[(z ^ (z >> np.uint64(31))) >> np.uint64(64 - DRAW)]


@dataclass
class Trees:
    """The trees of a head: by tree and node (1, and those of node n are 2n and 2n + 1) the feature (-1: a leaf), the last bin on
    the left, and the mean target."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predicted(self, bins: np.ndarray) -> np.ndarray:
        """The mean of all trees for each row of bins."""
        total, rows = np.zeros(len(bins)), np.arange(len(bins))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.ones(len(bins), np.int64)
            for _ in range(DEPTH):
                own = feature[at]
                at = np.where(own < 0, at, 2 * at + (bins[rows, own] > cut[at]))
            total += value[at]
        return total / len(self.value)


def tree_of(head: Head, bins: np.ndarray, rows: np.ndarray, sums: np.ndarray, seeds: tuple[int, ...], depth: int = DEPTH, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature, cut and value by node of a tree of patterns, from the rows of its bootstrap and the sums of their residuals, level by level."""
    size, width = 2 << depth, len(head.edges)
    feature, cut = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    value, at, now = np.full(size, head.base), np.ones(len(bins), np.int64), [1]
    for level in range(depth + 1):
        for node in now:
            own = at == node
            value[node] = head.base + sums[own].sum() / max(rows[own].sum(), 1) * (head.unit / UNITS)
        if level == depth or not now:
            break
        slot = np.full(size, -1)
        slot[now] = np.arange(len(now))
        found, counts = histograms(head, bins, sums, slot[at], len(now), rows)
        after = []
        for k, node in enumerate(now):
            chosen = np.random.default_rng([*seeds, node]).choice(width, -(-width // 3), replace=False)
            split = best_split(head, found[k], counts[k], least, chosen)
            if split:
                feature[node], cut[node] = split[1], split[2]
                own = at == node
                at[own] = 2 * node + (bins[own, split[1]] > split[2])
                after += [2 * node, 2 * node + 1]
        now = after
    return feature, cut, value


def bootstraps(train: DataFrame, patterns: int, size: int, seed: int) -> DataFrame:
    """(tree, _p, rows, sums) of the training rows (_p, _row, _y), _y a whole number: the rows of each bootstrap and what their _y add up to."""
    step = max(1, KEPT // max(patterns, 1))

    def scan(trees: range) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, sums = np.zeros((len(trees), patterns)), np.zeros((len(trees), patterns))
            for batch in batches:
                p = batch.column(0).to_numpy()
                order = np.argsort(p, kind="stable")
                own, first = np.unique(p[order], return_index=True)
                ids, y = batch.column(1).to_numpy()[order], batch.column(2).to_numpy()[order].astype(float)
                for k, tree in enumerate(trees if len(own) else ()):
                    drawn = times(ids, seed, tree).astype(float)
                    rows[k, own] += np.add.reduceat(drawn, first)
                    sums[k, own] += np.add.reduceat(drawn * y, first)
            for k, tree in enumerate(trees):
                own = np.flatnonzero(rows[k])
                found = [np.full(len(own), tree), own, rows[k, own].astype(np.int64), sums[k, own].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["tree", "_p", "rows", "sums"])

        return train.mapInArrow(run, "tree long, _p long, rows long, sums long")

    all_ = scan(range(min(step, size)))
    for first in range(step, size, step):
        all_ = all_.union(scan(range(first, min(first + step, size))))
    return all_.groupBy("tree", "_p").agg(F.sum("rows").alias("rows"), F.sum("sums").alias("sums"))


def grown(sums: DataFrame, patterns: DataFrame, heads: dict[str, Head], size: int, seed: int) -> dict[str, Trees]:
    """The trees of all heads, each grown in a task of its own; the driver gets them, 64 nodes each."""

    def run(table: pa.Table) -> pa.Table:
        name, tree = table.column("task_head")[0].as_py(), table.column("tree")[0].as_py()
        table = table.sort_by("_p")
        made = tree_of(heads[name], unpacked(table.column("bins")), table.column("rows").to_numpy(), table.column("sums").to_numpy().astype(float), (seed, zlib.crc32(name.encode()), tree))
        types = pa.int32(), pa.int32(), pa.float64()
        return pa.table([pa.array([name]), pa.array([tree], pa.int64()), *[pa.array([x], pa.list_(t)) for x, t in zip(made, types, strict=True)]], names=["task_head", "tree", "feature", "cut", "value"])

    own = sums.join(F.broadcast(patterns.select("task_head", "bins", "_p")), "_p")
    found = own.groupBy("task_head", "tree").applyInArrow(run, "task_head string, tree long, feature array<int>, cut array<int>, value array<double>").collect()
    out = {}
    for name, head in heads.items():
        out[name] = Trees(np.full((size, 2 << DEPTH), -1), np.zeros((size, 2 << DEPTH), int), np.full((size, 2 << DEPTH), head.base))
    for r in found:  # a tree without a row is the mean
        made = out[r["task_head"]]
        made.feature[r["tree"]], made.cut[r["tree"]], made.value[r["tree"]] = r["feature"], r["cut"], r["value"]
    return out


@dataclass
class Forests:
    """Fitted forests of the heads with few patterns; their rows (split_part, task_head, y_true, _p) and patterns (task_head, bins, _p), written; the other heads, and their rows with _array."""

    heads: dict[str, Head]
    trees: dict[str, Trees]
    rows: DataFrame
    patterns: DataFrame
    others: list[str]
    rest: DataFrame | None

    def predictions(self) -> DataFrame:
        """split_part, task_head, y_true and y_pred of the rows: those of patterns are made once, and broadcast."""
        trees = self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, y = np.array(batch.column(0).to_pylist()), np.zeros(batch.num_rows)
                for name in np.unique(names):
                    at = np.flatnonzero(names == name)
                    y[at] = trees[str(name)].predicted(unpacked(batch.column(1).take(pa.array(at))))
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(y)], names=["_p", "y_pred"])

        made = materialised(self.patterns.select("task_head", "bins", "_p").mapInArrow(run, "_p long, y_pred double"), "forest-patterns")
        return self.rows.join(F.broadcast(made), "_p").select("split_part", "task_head", "y_true", "y_pred")


def keyed(rows: DataFrame, columns: Sequence[str]) -> Column:
    """The features of a row before they are numbers, as one text: equal where all of them are. Features are read from text."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns])) if columns else F.lit("{}")


def met(rows: DataFrame, sets: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """rows with what there is on their set of features (task_head, _key): up to `most` sets are broadcast, of more those of hot keys."""
    keys = ["task_head", "_key"]
    return rows.join(F.broadcast(sets), keys) if counts.count() <= most else split_join(rows, sets, keys, counts)


def fitted(rows: DataFrame, columns: Sequence[str], seed: int, size: int, most: int = PATTERNS) -> Forests:
    """Forests of rows (split_part, task_head, y_true, _key, see `keyed`, and _row, a number of the row's own; written), learnt from
    training rows. Features are made, and binned, once for all rows that share them. Heads beyond `most` patterns in all, the
    smallest first, are left to others."""
    spark, train = rows.sparkSession, F.col("split_part") == "train"
    counts = materialised(rows.groupBy("task_head", "_key").agg(F.count("*").alias("n"), F.count_if(train).alias("_n")), "feature-sets")
    own = F.from_json("_key", ", ".join(f"`{c}` string" for c in columns)) if columns else None
    sets = counts.select("task_head", "_key", "_n", own.alias("_own")).select("task_head", "_key", "_n", "_own.*") if columns else counts.select("task_head", "_key", "_n")
    learnt = materialised(parameters(sets.where("_n > 0"), columns, weight="_n"), "parameters") if columns else sets
    sets = materialised(with_features(sets, learnt, columns, "_array").select("task_head", "_key", "_n", "_array"), "features")
    mean = F.avg("y_true")
    starts = rows.where(train).groupBy("task_head").agg(mean.alias("base"), F.greatest(F.max("y_true") - mean, mean - F.min("y_true")).alias("unit")).collect()  # a row per head
    edges: dict[str, dict[int, np.ndarray]] = {}
    for name, feature, found in edges_of(sets.where("_n > 0"), BINS, "_n").collect():
        edges.setdefault(name, {})[feature] = np.array(found)
    heads = {r["task_head"]: Head(r["base"], r["unit"] or 1.0, [e for _, e in sorted(edges[r["task_head"]].items())]) for r in starts}
    placed = binned(sets.withColumns({"split_part": F.lit("train"), "y_true": F.lit(0.0)}), heads, "_key").select("task_head", "_key", "bins")
    counted = materialised(placed.select("task_head", "bins").distinct(), "forest-patterns")
    few, total = [], 0
    for name, n in sorted(counted.groupBy("task_head").count().collect(), key=lambda r: (r[1], r[0])):  # a row per head
        total += n
        if total <= most:
            few.append(name)
    others, heads = sorted(set(heads) - set(few)), {name: heads[name] for name in few}
    mine = F.col("task_head").isin(few)
    patterns = distributed_rank(counted.where(mine).withColumn("_key", F.struct("task_head", "bins")), "_key", "_p")
    patterns = materialised(patterns.select("task_head", "bins", (F.col("_p") - 1).alias("_p")), "forest-patterns")
    scales = F.broadcast(spark.createDataFrame([(name, h.base, UNITS / h.unit) for name, h in heads.items()], "task_head string, _base double, _scale double"))  # a row per head
    to = materialised(placed.where(mine).join(F.broadcast(patterns), ["task_head", "bins"]).join(scales, "task_head").select("task_head", "_key", "_p", "_base", "_scale"), "forest-sets")
    y = F.rint((F.col("y_true") - F.col("_base")) * F.col("_scale")).cast("long")
    named = materialised(met(rows.where(mine), to, counts.where(mine), most).select("split_part", "task_head", "y_true", "_p", "_row", y.alias("_y")), "forest-rows")
    learning = named.where(train).select("_p", "_row", "_y").coalesce(2 * spark.sparkContext.defaultParallelism)
    trees = grown(bootstraps(learning, patterns.count(), size, seed), patterns, heads, size, seed) if few else {}
    rest = met(rows.where(~mine), sets.drop("_n"), counts.where(~mine), most).select("split_part", "task_head", "y_true", "_array") if others else None
    return Forests(heads, trees, named, patterns, others, rest)
