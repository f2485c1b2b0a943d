"""Histogram gradient boosting of all task heads together.

Values are binned once. Rows with the same bins are a pattern: they are in the same leaf of every tree, so a tree needs sums of
gradients by pattern only. A tree grows best leaf first; a round looks for the splits of all leaves that may be next, from
sums of gradients over (node, feature, bin). Heads of bounded size grow in a task each. Of larger ones those with few patterns take one
grouped sum over the rows an iteration, from which a task a head grows the tree; the others one grouped sum over (head,
node, feature, bin) a round. The sums are whole numbers, so all ways, and any partitioning, give the same trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseframe.operators.ranks import running_total
from doseframe.sources.shared import materialised

#: Defaults of the model: trees, leaves of a tree, rows of a leaf at least, what is kept of a step, bins of a feature.
ITERATIONS, LEAVES, LEAST, RATE, BINS = 100, 31, 20, 0.1, 255
#: A head of so many rows and cells of its matrix at most is grown in one task; cells that are counted at a time; iterations
#: after which predictions are written.
SMALL_ROWS, SMALL_CELLS, CELLS, KEEP = 1_000_000, 50_000_000, 2_000_000, 10
#: Patterns of all larger heads together that are broadcast at most; heads with more of them are grown round by round.
PATTERNS = 300_000
#: A gradient counts in parts of the head's largest first residual.
UNITS = 1 << 24
Split = tuple[float, int, int, int, int]  # gain, feature, last bin on the left, sum of gradients and rows there


@dataclass
class Head:
    """What a head starts from: mean and largest residual of its training targets, and its features' edges."""

    base: float
    unit: float
    edges: list[np.ndarray]

    def __post_init__(self) -> None:
        sizes = [len(e) + 1 for e in self.edges]
        self.offsets = np.cumsum([0, *sizes])[:-1]
        self.cells = sum(sizes)
        self.feature_of = np.repeat(np.arange(len(sizes)), sizes)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """A row of bins per row of values; a value on an edge is on its left."""
        return np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def gradients(self, predicted: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.rint((predicted - y) * (UNITS / self.unit))


@dataclass
class Tree:
    """A growing tree: per node its rows, sum of gradients, best split (None: none, or not looked for), and children."""

    rows: list[int] = field(default_factory=list)
    sums: list[int] = field(default_factory=list)
    splits: list[Split | None] = field(default_factory=list)
    known: list[bool] = field(default_factory=list)
    children: list[tuple[int, int] | None] = field(default_factory=list)

    def add(self, rows: int, total: int, least: int) -> int:
        for kept, value in ((self.rows, rows), (self.sums, total), (self.splits, None), (self.known, rows < 2 * least), (self.children, None)):
            kept.append(value)
        return len(self.rows) - 1

    def grow(self, leaves: int, least: int) -> tuple[list[int], set[int]]:
        """The nodes whose splits must be looked for next, and those that are parted so far, best gain first. With none to look for, the tree is done."""
        if not self.known[0]:
            return [0], set()
        heap = [(-self.splits[0][0], 0)] if self.splits[0] else []
        asked, inner = [], set()
        while heap and len(inner) + 1 < leaves:
            node = heapq.heappop(heap)[1]
            inner.add(node)
            if self.children[node] is None:
                _, _, _, total, rows = self.splits[node]
                self.children[node] = self.add(rows, total, least), self.add(self.rows[node] - rows, self.sums[node] - total, least)
            for child in self.children[node]:
                if not self.known[child]:
                    asked.append(child)
                elif self.splits[child]:
                    heapq.heappush(heap, (-self.splits[child][0], child))
        return asked, inner

    def places(self, bins: np.ndarray, inner: set[int]) -> np.ndarray:
        """The leaf of each row, where the nodes of `inner` are parted."""
        at = np.zeros(len(bins), np.int64)
        for node in sorted(inner):  # a child's number is above its parent's
            _, feature, cut, _, _ = self.splits[node]
            own = np.flatnonzero(at == node)
            left, right = self.children[node]
            at[own] = np.where(bins[own, feature] <= cut, left, right)
        return at

    def values(self, head: Head, rate: float) -> np.ndarray:
        return -rate * np.array(self.sums, float) / np.maximum(self.rows, 1) * (head.unit / UNITS)


def histograms(head: Head, bins: np.ndarray, gradients: np.ndarray, slots: np.ndarray, count: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and rows by (slot, cell); rows of slot -1 are left out. With weights, each row of bins stands for so
    many and for the sum of their gradients. Sums of whole numbers are exact below 2**53."""
    sums, rows = np.zeros(count * head.cells), np.zeros(count * head.cells, np.int64)
    own = np.flatnonzero(slots >= 0)
    step = max(1, CELLS // max(bins.shape[1], 1))
    for part in (own[i : i + step] for i in range(0, len(own), step)):
        key = (slots[part, None] * head.cells + head.offsets + bins[part]).ravel()
        sums += np.bincount(key, np.repeat(gradients[part], bins.shape[1]), len(sums))
        rows += np.bincount(key, None if weights is None else np.repeat(weights[part], bins.shape[1]), len(rows)).astype(np.int64)
    return sums.reshape(count, head.cells), rows.reshape(count, head.cells)


def best_split(head: Head, sums: np.ndarray, rows: np.ndarray, least: int, features: np.ndarray | None = None) -> Split | None:
    """The split of the highest gain (of one of these features, or of all), of equal ones that of the first feature and bin."""
    before = lambda x: np.cumsum(x) - np.repeat(np.append(0, np.cumsum(x))[head.offsets], np.diff(np.append(head.offsets, len(x))))
    g, n, i = before(sums), before(rows), head.feature_of
    all_g, all_n = np.add.reduceat(sums, head.offsets)[i], np.add.reduceat(rows, head.offsets)[i]
    good = (n >= least) & (all_n - n >= least) & (features is None or np.isin(i, features))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(good, g * g / n + (all_g - g) ** 2 / (all_n - n) - all_g * all_g / all_n, -np.inf)
    at = int(np.argmax(gain))
    return (float(gain[at]), int(i[at]), int(at - head.offsets[i[at]]), int(g[at]), int(n[at])) if gain[at] > 0 else None


def grown_tree(head: Head, patterns: np.ndarray, rows: np.ndarray, gradients: np.ndarray, leaves: int, least: int) -> tuple[Tree, np.ndarray]:
    """The next tree, and the leaf of each pattern, from the number of training rows of each and the sum of their gradients."""
    tree = Tree()
    tree.add(int(rows.sum()), int(gradients.sum()), least)
    while (asked := tree.grow(leaves, least))[0]:
        slot = np.full(len(tree.rows), -1)
        slot[asked[0]] = np.arange(len(asked[0]))
        sums, counts = histograms(head, patterns, gradients, slot[tree.places(patterns, asked[1])], len(asked[0]), rows)
        for k, node in enumerate(asked[0]):
            tree.splits[node], tree.known[node] = best_split(head, sums[k], counts[k], least), True
    return tree, tree.places(patterns, asked[1])


def grown_here(head: Head, bins: np.ndarray, y: np.ndarray, train: np.ndarray, iterations: int, leaves: int, least: int, rate: float) -> np.ndarray:
    """Predictions of a head's rows, its trees grown on the training rows."""
    _, first, of = np.unique(np.ascontiguousarray(bins).view(np.dtype((np.void, bins.shape[1]))).ravel(), return_index=True, return_inverse=True)
    patterns, own, target = bins[first], of[train], y[train]
    rows, predicted = np.bincount(own, minlength=len(patterns)), np.full(len(patterns), head.base)
    for _ in range(iterations):
        gradients = np.bincount(own, head.gradients(predicted[own], target), len(patterns))
        tree, places = grown_tree(head, patterns, rows, gradients, leaves, least)
        predicted = predicted + tree.values(head, rate)[places]
    return predicted[of]


def edges_of(train: DataFrame, bins: int, weight: str | None = None) -> DataFrame:
    """(task_head, feature, edges): the middles between distinct values, or where these are more than `bins`, between quantiles of
    equal shares. Training rows (each stands for as many as its weight says) are counted by value, and ordered by ranges: no task holds a feature."""
    keys = ["task_head", "feature"]
    own = train.select("task_head", (F.col(weight) if weight else F.lit(1)).alias("_n"), F.posexplode("_array").alias("feature", "value"))
    values = own.groupBy(*keys, "value").agg(F.sum("_n").alias("n"))
    upto = materialised(running_total(values.withColumn("_key", F.struct(*keys, "value")), "_key", "n", "upto"), "boosting-values")
    first = F.col("upto") - F.col("n")
    ends = upto.groupBy(*keys).agg(F.min(first).alias("begin"), F.max("upto").alias("end"), F.count("*").alias("distinct"))  # a row per feature
    rows = upto.join(F.broadcast(ends), keys)
    few = rows.where(F.col("distinct") <= bins).select(*keys, "value", F.row_number().over(Window.partitionBy(*keys).orderBy("value")).cast("long").alias("bin"))
    many = rows.where(F.col("distinct") > bins).select(*keys, "value", F.floor(bins * (first - F.col("begin")) / (F.col("end") - F.col("begin"))).alias("bin"))
    spans = few.union(many).groupBy(*keys, "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"))  # `bins` rows a feature at most
    middle = (F.col("high") + F.lead("low").over(Window.partitionBy(*keys).orderBy("bin"))) / 2
    return spans.withColumn("edge", middle).groupBy(*keys).agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def heads_of(train: DataFrame, bins: int) -> tuple[dict[str, Head], dict[str, tuple[int, int]]]:
    """Each head's start, and its rows and width: a row per head and one per feature on the driver."""
    mean = F.avg("y_true")
    found = train.groupBy("task_head").agg(mean.alias("base"), F.greatest(F.max("y_true") - mean, mean - F.min("y_true")).alias("unit"), F.count("*").alias("n"), F.max(F.size("_array")).alias("width")).collect()
    edges: dict[str, dict[int, np.ndarray]] = {}
    for name, feature, own in edges_of(train, bins).collect():
        edges.setdefault(name, {})[feature] = np.array(own)
    return {r["task_head"]: Head(r["base"], r["unit"] or 1.0, [edges[r["task_head"]][i] for i in range(r["width"])]) for r in found}, {r["task_head"]: (r["n"], r["width"]) for r in found}


RESULT = "split_part string, task_head string, y_true double, y_pred double"


def binned(rows: DataFrame, heads: dict[str, Head], *more: str) -> DataFrame:
    """split_part, task_head, y_true, bins, a byte a feature, and these columns of the rows of these heads, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bins = np.array(batch.column(1).to_pylist()), np.empty(batch.num_rows, object)
            for name in np.unique(names):
                at = np.flatnonzero(names == name)
                values = batch.column(3).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                bins[at] = [row.tobytes() for row in heads[str(name)].binned(values)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bins, pa.binary()), *batch.columns[4:]], names=["split_part", "task_head", "y_true", "bins", *more])

    own = rows.where(F.col("task_head").isin([*heads])).select("split_part", "task_head", "y_true", "_array", *more)
    kept = "".join(f", {c} {dict(rows.dtypes)[c]}" for c in more)
    return materialised(own.mapInArrow(run, "split_part string, task_head string, y_true double, bins binary" + kept), "boosting-bins")


def unpacked(bins: pa.ChunkedArray) -> np.ndarray:
    """A row of bins per value."""
    return np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(len(bins), -1)


def _small(rows: DataFrame, heads: dict[str, Head], options: tuple[int, int, int, float]) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        name = table.column("task_head")[0].as_py()
        y, train = table.column("y_true").to_numpy(), pc.equal(table.column("split_part"), "train").to_numpy()
        predicted = grown_here(heads[name], unpacked(table.column("bins")), y, train, *options)
        return pa.table([table.column("split_part"), table.column("task_head"), table.column("y_true"), pa.array(predicted)], names=["split_part", "task_head", "y_true", "y_pred"])

    return rows.where(F.col("task_head").isin([*heads])).repartition(2 * len(heads), "task_head").groupBy("task_head").applyInArrow(run, RESULT)


def _repeated(rows: DataFrame, patterns: DataFrame, heads: dict[str, Head], options: tuple[int, int, int, float]) -> DataFrame:
    """Of heads with few patterns (task_head, bins, rows): an iteration sums the gradients of all rows by pattern, and a task a
    head grows its tree from these sums. Rows are numbered by pattern once, and stay where they are."""
    iterations, leaves, least, rate = options
    spark = rows.sparkSession
    scales = F.broadcast(spark.createDataFrame([(name, h.base, UNITS / h.unit) for name, h in heads.items()], "task_head string, _base double, _scale double"))  # a row per head
    now = patterns.join(scales, "task_head").select("task_head", "bins", "rows", F.monotonically_increasing_id().alias("_p"), F.col("_base").alias("y_pred"), "_scale")
    now = materialised(now, "boosting-patterns")
    own = materialised(rows.join(F.broadcast(now.select("task_head", "bins", "_p")), ["task_head", "bins"]).select("split_part", "task_head", "y_true", "_p"), "boosting-rows")
    train = own.where("split_part = 'train'")
    state = "task_head string, bins binary, rows long, _p long, y_pred double, _scale double"
    names = ["task_head", "bins", "rows", "_p", "y_pred", "_scale"]

    def run(table: pa.Table) -> pa.Table:
        head, bins = heads[table.column("task_head")[0].as_py()], unpacked(table.column("bins"))
        tree, places = grown_tree(head, bins, table.column("rows").to_numpy(), table.column("g").to_numpy().astype(float), leaves, least)
        predicted = table.column("y_pred").to_numpy() + tree.values(head, rate)[places]
        return table.select(names).set_column(4, "y_pred", pa.array(predicted))

    for _ in range(iterations):
        gradient = F.rint((F.col("y_pred") - F.col("y_true")) * F.col("_scale")).cast("long")
        sums = train.join(F.broadcast(now.select("_p", "y_pred", "_scale")), "_p").groupBy("_p").agg(F.sum(gradient).alias("g"))
        grown = now.join(F.broadcast(sums), "_p", "left").withColumn("g", F.coalesce("g", F.lit(0))).repartition(2 * len(heads), "task_head").groupBy("task_head")
        now = materialised(grown.applyInArrow(run, state), "boosting-patterns")
    return own.join(F.broadcast(now.select("_p", "y_pred")), "_p").select("split_part", "task_head", "y_true", "y_pred")


def _matrix(batch: pa.RecordBatch, heads: dict[str, Head]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Each head's rows of a batch: places, bins, and the predictions so far."""
    names = np.array(batch.column("task_head").to_pylist())
    for name in np.unique(names):
        at = np.flatnonzero(names == name)
        own = batch.take(pa.array(at))
        yield str(name), at, unpacked(own.column("bins")), own.column("y_pred").to_numpy()


def _large(rows: DataFrame, heads: dict[str, Head], options: tuple[int, int, int, float]) -> DataFrame:
    iterations, leaves, least, rate = options
    state = "split_part string, task_head string, y_true double, y_pred double, bins binary"
    names = ["split_part", "task_head", "y_true", "y_pred", "bins"]
    bases = F.broadcast(rows.sparkSession.createDataFrame([(name, head.base) for name, head in heads.items()], "task_head string, y_pred double"))  # a row per head
    now = materialised(rows.join(bases, "task_head").select(*names), "boosting")
    done: list[dict[str, tuple[Tree, set[int]]]] = []  # trees that the written predictions lack

    def forward(name: str, bins: np.ndarray, predicted: np.ndarray, trees: list) -> np.ndarray:
        for own in trees:
            tree, inner = own[name]
            predicted = predicted + tree.values(heads[name], rate)[tree.places(bins, inner)]
        return predicted

    def counted(asked: dict[str, tuple[Tree, list[int], set[int]]], trees: list) -> DataFrame:
        """(task_head, slot, cell, g, n) of the training rows in the nodes asked for; slot -1 has the sums of all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, list[np.ndarray]] = {}
            for batch in batches:
                batch = batch.filter(pa.array([p == "train" for p in batch.column("split_part").to_pylist()], pa.bool_()))
                for name, at, bins, predicted in _matrix(batch, heads) if batch.num_rows else ():
                    tree, nodes, inner = asked[name]
                    if not nodes:
                        continue  # its tree is done
                    gradients = heads[name].gradients(forward(name, bins, predicted, trees), batch.column("y_true").to_numpy()[at])
                    slot = np.full(max(len(tree.rows), 1), -1)
                    slot[nodes] = np.arange(len(nodes))
                    found = histograms(heads[name], bins, gradients, slot[tree.places(bins, inner)], len(nodes))
                    total[name] = [a + b for a, b in zip(total[name], found, strict=True)] if name in total else list(found)
            for name, (sums, counts) in total.items():
                slots, cells = np.nonzero(counts)
                g, n = sums[slots, cells].astype(np.int64), counts[slots, cells]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(slots), pa.array(cells), pa.array(g), pa.array(n)], names=["task_head", "slot", "cell", "g", "n"])

        return now.mapInArrow(run, "task_head string, slot long, cell long, g long, n long").groupBy("task_head", "slot", "cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))

    def best(sums: DataFrame) -> DataFrame:
        """(task_head, slot, split): the best one of each node, a row per node."""

        def run(key: tuple, table: pa.Table) -> pa.Table:
            head = heads[key[0].as_py()]
            g, n = np.zeros(head.cells), np.zeros(head.cells, np.int64)
            cells = table.column("cell").to_numpy()
            g[cells], n[cells] = table.column("g").to_numpy(), table.column("n").to_numpy()
            width = max(len(head.edges), 1)
            split = best_split(head, g, n, least) or (0.0, -1, 0, 0, 0)
            return pa.table([[key[0].as_py()], [key[1].as_py()], [int(n.sum()) // width], [int(g.sum()) // width], *[[x] for x in split]], names=["task_head", "slot", "rows", "total", "gain", "feature", "cut", "g", "n"])

        return sums.groupBy("task_head", "slot").applyInArrow(run, "task_head string, slot long, rows long, total long, gain double, feature long, cut long, g long, n long")

    for iteration in range(iterations):
        trees = {name: Tree() for name in heads}
        for tree in trees.values():
            tree.add(2 * least, 0, least)  # the root's rows and sum come with its first histogram
        inner: dict[str, set[int]] = {name: set() for name in heads}
        while True:
            asked = {}
            for name, tree in trees.items():
                nodes, inner[name] = tree.grow(leaves, least)
                asked[name] = tree, nodes, inner[name]
            if not any(nodes for _, nodes, _ in asked.values()):
                break
            for r in best(counted(asked, list(done))).collect():
                tree, nodes, _ = asked[r["task_head"]]
                node = nodes[r["slot"]]
                tree.rows[node], tree.sums[node], tree.known[node] = r["rows"], r["total"], True
                tree.splits[node] = (r["gain"], r["feature"], r["cut"], r["g"], r["n"]) if r["feature"] >= 0 else None
        done.append({name: (tree, inner[name]) for name, tree in trees.items()})
        if (iteration + 1) % KEEP == 0 or iteration + 1 == iterations:
            new = list(done)

            def step(batches: Iterator[pa.RecordBatch], new: list = new) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    predicted = batch.column("y_pred").to_numpy().copy()
                    for name, at, bins, own in _matrix(batch, heads):
                        predicted[at] = forward(name, bins, own, new)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(predicted), batch.column("bins")], names=names)

            now, done = materialised(now.mapInArrow(step, state), "boosting"), []
    return now.select(*names[:4])


def boosted(rows: DataFrame, iterations: int = ITERATIONS, leaves: int = LEAVES, least: int = LEAST, rate: float = RATE, bins: int = BINS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """split_part, task_head, y_true and y_pred of rows (these but y_pred, and _array, the features, as wide in all rows of a
    head); each head's trees learn from its training rows, by squared error.

    What the driver holds are the growing trees: `leaves` nodes a head and iteration, until predictions are written."""
    train = rows.where("split_part = 'train'")
    heads, sizes = heads_of(train, bins)
    small = [name for name, (n, width) in sizes.items() if n <= small_rows and n * width <= SMALL_CELLS]
    all_rows = {name: n for name, n in rows.groupBy("task_head").count().collect()}
    small = [name for name in small if all_rows[name] <= 2 * small_rows]
    large = {name: head for name, head in heads.items() if name not in set(small)}
    options = (iterations, leaves, least, rate)
    placed = binned(rows, heads)
    parts = [_small(placed, {name: heads[name] for name in small}, options)] if small else []
    few: dict[str, Head] = {}
    if large:
        patterns = placed.where(F.col("task_head").isin([*large])).groupBy("task_head", "bins").agg(F.count_if(F.col("split_part") == "train").alias("rows"))
        patterns, total = materialised(patterns, "boosting-patterns"), 0
        for name, n in sorted(patterns.groupBy("task_head").count().collect(), key=lambda r: (r[1], r[0])):  # a row per head
            total += n
            if total <= PATTERNS:
                few[name] = large.pop(name)
    if few:
        own = F.col("task_head").isin([*few])
        parts.append(_repeated(placed.where(own), patterns.where(own), few, options))
    if large:
        parts.append(_large(placed.where(F.col("task_head").isin([*large])), large, options))
    return reduce(DataFrame.unionByName, parts)
