import math
import random
from collections import defaultdict

import numpy as np
import pytest

from doseframe.operators import baseline, boosting, encode, headed


def made(spark, n=200):
    r = random.Random(7)
    rows = []
    for i in range(n):
        v = [r.choice([0.0, 1.0]), round(r.random(), 2), float(r.randint(0, 5)), 3.0]
        y = 2.0 * v[0] + math.sin(6 * v[1]) - v[2] / 3 + r.gauss(0, 0.1)
        rows.append(("train" if i % 5 else "test", "a" if i % 3 else "b", y, v))
    return rows, spark.createDataFrame(rows, "split_part string, task_head string, y_true double, _array array<double>").repartition(3)


def plain(rows, iterations, leaves, least, rate, bins):
    """Boosting written out: every threshold of every leaf is tried on the rows themselves, the best leaf is parted first."""
    out = {}
    for head in {h for _, h, _, _ in rows}:
        own = [(p, y, v) for p, h, y, v in rows if h == head]
        train = [i for i, (p, _, _) in enumerate(own) if p == "train"]
        edges = []
        for k in range(len(own[0][2])):
            values = sorted(own[i][2][k] for i in train)
            distinct = sorted(set(values))
            if len(distinct) > bins:
                spans = defaultdict(list)
                for d in distinct:
                    spans[bins * values.index(d) // len(values)].append(d)
                groups = [spans[b] for b in sorted(spans)]
            else:
                groups = [[d] for d in distinct]
            edges.append([(a[-1] + b[0]) / 2 for a, b in zip(groups, groups[1:], strict=False)])
        base = np.mean([own[i][1] for i in train])
        unit = max(max(own[i][1] for i in train) - base, base - min(own[i][1] for i in train))
        predicted = [base] * len(own)
        for _ in range(iterations):
            g = {i: round((predicted[i] - own[i][1]) * boosting.UNITS / unit) for i in train}

            def best(members):
                found = []
                for k, cuts in enumerate(edges):
                    for e in cuts:
                        left = [i for i in members if own[i][2][k] <= e]
                        right = [i for i in members if own[i][2][k] > e]
                        if min(len(left), len(right)) >= least:
                            a, b = sum(g[i] for i in left), sum(g[i] for i in right)
                            found.append((a * a / len(left) + b * b / len(right) - (a + b) ** 2 / len(members), -k, -e, left, right, k, e))
                top = max(found, default=None, key=lambda f: f[:3])
                return top if top and top[0] > 0 else None

            trees = [(train, list(range(len(own))), best(train))]
            while len(trees) < leaves and any(t[2] for t in trees):
                members, everyone, (_, _, _, left, right, k, e) = trees.pop(max((j for j in range(len(trees)) if trees[j][2]), key=lambda j: trees[j][2][0]))
                trees += [(left, [i for i in everyone if own[i][2][k] <= e], best(left)), (right, [i for i in everyone if own[i][2][k] > e], best(right))]
            for members, everyone, _ in trees:
                for i in everyone:
                    predicted[i] -= rate * sum(g[i] for i in members) / len(members) * unit / boosting.UNITS
        out[head] = sorted((p, round(y, 9), round(q, 9)) for (p, y, _), q in zip(own, predicted, strict=True))
    return out


def got(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.task_head].append((r.split_part, round(r.y_true, 9), round(r.y_pred, 9)))
    return {h: sorted(x) for h, x in out.items()}


@pytest.mark.parametrize("options", [(6, 31, 5, 0.3, 255), (4, 4, 8, 0.1, 10), (2, 31, 90, 0.5, 255)])
def test_equals_boosting_written_out(spark, options):
    rows, df = made(spark)
    want = plain(rows, *options)
    assert got(boosting.boosted(df, *options)) == want
    if options[0] == 4:
        assert got(boosting.boosted(df, *options, small_rows=0)) == want


def test_large_heads_write_their_state(spark, monkeypatch):
    rows, df = made(spark, 120)
    monkeypatch.setattr(boosting, "KEEP", 1)
    assert got(boosting.boosted(df, 2, 5, 8, 0.3, 20, small_rows=0)) == got(boosting.boosted(df, 2, 5, 8, 0.3, 20)) == plain(rows, 2, 5, 8, 0.3, 20)


@pytest.mark.parametrize("patterns", [0, 60, 300_000])
def test_large_heads_by_patterns_and_by_rounds(spark, monkeypatch, patterns):
    """Heads beyond a task: neither, one or both of them have few patterns of bins."""
    rows, df = made(spark)
    monkeypatch.setattr(boosting, "PATTERNS", patterns)
    assert got(boosting.boosted(df, 3, 6, 5, 0.3, 12, small_rows=0)) == plain(rows, 3, 6, 5, 0.3, 12)


def test_an_iteration_of_large_heads_is_few_jobs(spark):
    """However many rounds a tree takes to grow: one sum over the rows an iteration, where patterns are few."""
    _, df = made(spark)
    df = boosting.materialised(df, "rows")
    tracker = spark.sparkContext.statusTracker()

    def jobs(iterations, leaves):
        group = f"{iterations} {leaves}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.boosted(df, iterations, leaves, 5, 0.3, 12, small_rows=0).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(2, 31) <= jobs(2, 3) + 2


COLUMNS = ["endpoint", "grams", "media", "only_text", "empty", "many"]


def frame(spark):
    r = random.Random(3)
    rows = []
    for i in range(1200):
        grams = r.choice([None, "x", " 2.5 ", "2.50", str(r.randint(0, 50))])
        y = {"FW": 1.0, "SW": 4.0}.get(m := r.choice(["FW", "SW", None, " "]), 2.0) + r.gauss(0, 0.2)
        rows.append((i, ["train", "train", "train", "valid", "test"][i % 5], ["h1", "h2", None][i % 3], str(y) if i % 50 else "bad", str(r.randint(1, 3)), grams, m, r.choice(["u", "v "]), None, f"c{r.randint(0, 60)}"))
    return spark.createDataFrame(rows, "record_id long, split_part string, head string, y string, endpoint string, grams string, media string, only_text string, empty string, many string")


def test_features_of_all_heads_equal_those_of_each(spark):
    rows = baseline.trainable_rows(frame(spark), "y", "head")
    train = rows.where("split_part = 'train'")
    fitted = headed.parameters(train, COLUMNS)
    assert {r["kind"] for r in fitted.collect()} == {"numeric", "one_hot", "hashed"}
    all_ = {r["record_id"]: r["v"] for r in headed.with_features(rows, fitted, COLUMNS, "v").collect()}
    assert len(all_) == rows.count()
    for head in ("h1", "h2", "default"):
        own = encode.TabularPreprocessor().fit(train.where(f"task_head = '{head}'"), COLUMNS)
        one = {r["record_id"]: r["v"] for r in own.transform(rows.where(f"task_head = '{head}'"), "v").collect()}
        assert one and {i: all_[i] for i in one} == one
    assert {tuple(r["v"]) for r in headed.with_features(rows, rows.select("task_head").distinct(), [], "v").collect()} == {(1.0,)}


def test_jobs_do_not_grow_with_heads(spark):
    rows = baseline.trainable_rows(frame(spark), "y", "head")
    tracker = spark.sparkContext.statusTracker()

    def jobs(df, group):
        spark.sparkContext.setJobGroup(group, group)
        headed.parameters(df, COLUMNS).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(rows, "three heads") <= jobs(rows.where("task_head = 'h1'"), "one head")


@pytest.mark.parametrize("model", ["rf", "hgb"])
def test_baselines_fit_and_learn(spark, model):
    """A real fit of both: the medium tells most of the target, so errors on test rows are far below its spread."""
    out = baseline.baseline_predictions(frame(spark), "y", "head", model, 42, 60, "s").toPandas()
    assert set(out.columns) == {"split_name", "split_part", "task_head", "y_true", "y_pred"} and set(out.task_head) == {"h1", "h2", "default"}
    assert len(out) == sum(1 for i in range(1200) if i % 50) and out.split_name.eq("s").all()
    test = out[out.split_part == "test"]
    assert ((test.y_true - test.y_pred) ** 2).mean() < 0.4 * test.y_true.var()
    with pytest.raises(ValueError, match="no head"):
        baseline.baseline_predictions(frame(spark).where("split_part = 'train'"), "y", "head", model)


def test_feature_columns(spark):
    """Ids, targets, the head and lists of results are no features; what is left keeps its order. Without any, the bias is one."""
    df = frame(spark).selectExpr("*", "1 AS seed", "array(1) AS result_ids", "'x' AS dtxsid")
    assert encode.feature_columns(df, "y", "head") == [*COLUMNS, "dtxsid"]
    out = baseline.baseline_predictions(frame(spark).select("record_id", "split_part", "head", "y"), "y", "head", "hgb", size=2).toPandas()
    assert out.groupby("task_head").y_pred.nunique().eq(1).all()  # the mean, as the bias parts nothing
