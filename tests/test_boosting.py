"""Boosting from histograms against plain loops over the rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import boosting as bo


def made(n, seed, noise=0.1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = draw.randint(0, 9), draw.randint(0, 4), draw.choice([0.5, 1.5, 7.0])
        y = int((a > 5) != (b > 2))
        rows.append((i, a, float(b), c, y if draw.random() > noise else 1 - y))
    return rows


SCHEMA = "id long, a int, b double, c double, y int"
COLUMNS = ["a", "b", "c"]


def plain_ada(rows, rounds, rate):
    x, y = np.array([r[1:4] for r in rows], float), np.array([r[4] for r in rows])
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(3):
            for cut in sorted(set(x[:, f]))[:-1]:
                left = x[:, f] <= cut
                impurity, wrong, classes = 0, 0, []
                for side in (left, ~left):
                    w0, w1 = w[side & (y == 0)].sum(), w[side & (y == 1)].sum()
                    impurity += 2 * w0 * w1 / (w0 + w1)
                    classes.append(int(w1 > w0))
                    wrong += min(w0, w1)
                key = (round(impurity / w.sum(), 10), f, cut)
                if best is None or key < best[0]:
                    best = (key, classes, wrong / w.sum())
        (_, f, cut), classes, error = best
        if error >= 0.5:
            break
        say = rate * math.log((1 - error) / error)
        vote = np.where(x[:, f] <= cut, *classes)
        w = w * np.exp(say * (vote != y))
        out.append((f, cut, *classes, say))
    return out


def test_ada_against_plain_loop(spark):
    rows = made(400, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = bo.ada_stumps(df, COLUMNS, "y", rounds=45, rate=0.3)
    want = plain_ada(rows, 45, 0.3)
    assert [(f, model.cuts[f][c], a, b) for f, c, a, b, _ in model.members] == [m[:4] for m in want]
    assert [m[4] for m in model.members] == pytest.approx([m[4] for m in want])
    total = sum(m[4] for m in want)
    got = {r["id"]: r["ada"] for r in bo.ada_score(df, model).collect()}
    for i, *x, _ in rows:
        assert got[i] == pytest.approx(sum(s * (a if x[f] <= cut else b) for f, cut, a, b, s in want) / total)


def test_ada_ends_on_pure_and_on_useless_features(spark):
    pure = spark.createDataFrame([(i, i % 2, 0.0, 0.0, i % 2) for i in range(20)], SCHEMA)
    model = bo.ada_stumps(pure, COLUMNS, "y", rounds=50)
    assert [m[4] for m in model.members] == [1.0] and bo.ada_score(pure, model).filter("ada <> y").count() == 0
    useless = spark.createDataFrame([(i, 1, 1.0, None, i % 2) for i in range(20)], SCHEMA)
    assert bo.ada_stumps(useless, COLUMNS, "y").members == [] and bo.ada_score(useless, bo.ada_stumps(useless, COLUMNS, "y")).filter("ada = 0").count() == 20
    assert bo.ada_stumps(useless.limit(0), COLUMNS, "y").members == []


def plain_trees(rows, rounds, rate, depth):
    """Raw scores after some rounds without a hold-out and without sampling."""
    x, y = np.array([r[1:4] for r in rows], float), np.array([r[4] for r in rows], float)
    raw = np.full(len(y), math.log(y.sum() / (len(y) - y.sum())))

    def grow(on, level, p):
        g, h = (y - p)[on], (p * (1 - p))[on]
        best = None
        for f in range(3):
            for cut in sorted(set(x[on, f]))[:-1]:
                left = on & (x[:, f] <= cut)
                right = on & ~left
                gain = sum((y - p)[s].sum() ** 2 / s.sum() for s in (left, right)) - g.sum() ** 2 / len(g)
                key = (-round(gain / len(g), 10), f, cut)
                if key[0] < 0 and (best is None or key < best[0]):
                    best = (key, left, right)
        if level == 0 or best is None:
            raw[on] += rate * g.sum() / h.sum()
            return
        grow(best[1], level - 1, p)
        grow(best[2], level - 1, p)

    for _ in range(rounds):
        grow(np.ones(len(y), bool), depth, 1 / (1 + np.exp(-raw)))
    return raw


def test_gradient_trees_against_plain_loop(spark):
    rows = made(300, 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = bo.gradient_trees(df, COLUMNS, "y", ["id"], rounds=6, subsample=1.1, validation=0.0)
    want = 1 / (1 + np.exp(-plain_trees(rows, 6, 0.1, 3)))
    got = {r["id"]: r["boosted"] for r in bo.gradient_score(df, model).collect()}
    assert len(model.trees) == 6 and [got[r[0]] for r in rows] == pytest.approx(want.tolist())


def test_validation_rows_end_the_rounds(spark):
    df = spark.createDataFrame(made(600, 3, noise=0.5), SCHEMA).repartition(2)  # nothing to learn
    model = bo.gradient_trees(df, COLUMNS, "y", ["id"], rounds=60, rate=0.5, patience=4)
    assert 4 < len(model.trees) < 60 and len(model.losses) == len(model.trees)
    last = model.losses[-1]
    assert not any(last + 1e-4 < loss for loss in model.losses[-5:-1])
    again = bo.gradient_trees(df.repartition(5), COLUMNS, "y", ["id"], rounds=60, rate=0.5, patience=4)
    assert again.losses == pytest.approx(model.losses)


def test_one_class_and_many_values(spark):
    one = spark.createDataFrame([(i, i, 0.0, 0.0, 1) for i in range(30)], SCHEMA)
    assert bo.gradient_score(one, bo.gradient_trees(one, COLUMNS, "y", ["id"])).filter("boosted < 0.99").count() == 0
    many = spark.range(5000).select("id", F.col("id").cast("int").alias("a"), F.lit(None).cast("double").alias("b"))
    cuts = bo.fit_cuts(many, ["a", "b"])
    assert 50 < len(cuts[0]) <= bo.BINS and cuts[1] == []
    sizes = [r["count"] for r in bo.binned(many, ["a", "b"], cuts).groupBy("bins").count().collect()]
    assert max(sizes) < 2 * 5000 / bo.BINS
