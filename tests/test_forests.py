"""Forests by patterns: the same for any partitioning, as good as Spark ML's, and a scan of the rows for all trees."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_boosting import COLUMNS, frame

from doseframe.operators import baseline, boosting, forests


def test_draws_are_poisson():
    rows = np.arange(200_000, dtype=np.int64) * 7919 - 10**6
    a, b = forests.times(rows, 42, 0).astype(float), forests.times(rows, 42, 1).astype(float)
    assert abs(a.mean() - 1) < 0.02 and abs(a.var() - 1) < 0.03 and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert abs((a == 0).mean() - np.exp(-1)) < 0.005 and (forests.times(rows[::-1].copy(), 42, 0)[::-1] == a).all()


def test_tree_equals_one_written_out():
    """Every threshold of the drawn features is tried on the rows themselves, level by level."""
    r = random.Random(2)
    bins = np.array([[r.randint(0, 3), r.randint(0, 5), r.randint(0, 1), r.randint(0, 4)] for _ in range(60)], np.uint8)
    rows = np.array([r.choice([0, 0, 1, 2, 5]) for _ in range(60)])
    sums = rows * np.array([r.randint(-1000, 1000) for _ in range(60)])
    head = boosting.Head(5.0, 2.0, [np.arange(3.0), np.arange(5.0), np.arange(1.0), np.arange(4.0)])
    feature, cut, value = forests.tree_of(head, bins, rows, sums.astype(float), (1, 2, 3))

    def check(node, own, level):
        n, s = rows[own].sum(), sums[own].sum()
        assert abs(value[node] - (5.0 + s / max(n, 1) * 2.0 / boosting.UNITS)) < 1e-12
        found = []
        for k in np.random.default_rng([1, 2, 3, node]).choice(4, 2, replace=False):
            for c in range(6):
                left = [i for i in own if bins[i, k] <= c]
                a, b = rows[left].sum(), sums[left].sum()
                if a >= 2 and n - a >= 2:
                    found.append((b * b / a + (s - b) ** 2 / (n - a) - s * s / n, -k, -c))
        top = max(found, default=(0, 0, 0))
        if level == forests.DEPTH or top[0] <= 0:
            assert feature[node] == -1
            return
        assert (feature[node], cut[node]) == (-top[1], -top[2])
        for child, side in ((2 * node, bins[:, feature[node]] <= cut[node]), (2 * node + 1, bins[:, feature[node]] > cut[node])):
            check(child, [i for i in own if side[i]], level + 1)

    check(1, list(range(60)), 0)
    one = forests.Trees(feature[None], cut[None], value[None])
    assert np.unique(one.predicted(bins)).size > 8


def test_forests_do_not_depend_on_partitions_and_are_as_good_as_spark_mls(spark, monkeypatch):
    got = {}
    for parts, most, kept in ((2, forests.PATTERNS, forests.KEPT), (7, forests.PATTERNS, 5000), (2, 0, forests.KEPT)):  # none by patterns: Spark ML's
        monkeypatch.setattr(forests.fitted, "__defaults__", (most,))
        monkeypatch.setattr(forests, "KEPT", kept)
        out = baseline.baseline_predictions(frame(spark).repartition(parts), "y", "head", "rf", 42, 60, "s").toPandas()
        got[parts, most] = out.sort_values(["task_head", "y_true", "split_part"]).reset_index(drop=True)
    a, b, ml = got.values()
    assert (a.y_true == b.y_true).all() and abs(a.y_pred - b.y_pred).max() < 1e-9
    assert (a.y_true == ml.y_true).all() and np.corrcoef(a.y_pred, ml.y_pred)[0, 1] > 0.98
    error = lambda x: ((x.y_true - x.y_pred)[x.split_part == "test"] ** 2).mean()
    assert abs(error(a) / error(ml) - 1) < 0.2


def test_jobs_of_forests_do_not_grow_with_heads(spark):
    """A head was a fit of its own, of a job a level at least: two more heads were a dozen jobs."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(df, group):
        spark.sparkContext.setJobGroup(group, group)
        baseline.baseline_predictions(df, "y", "head", "rf", 42, 20).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    df = boosting.materialised(frame(spark), "frame").select("record_id", "split_part", "head", "y", *COLUMNS)
    assert jobs(df, "forests of three heads") <= jobs(df.where(F.col("head") == "h1"), "forest of one head") + 4
