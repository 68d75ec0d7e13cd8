"""Correlations of many columns, moments, learned vectors and their best matches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import aggregate as agg, models as md


def wide(spark, n, d, nulls=0.0):
    draw = np.random.default_rng(d)
    x = draw.normal(1e6, 3, (n, d))
    x[:, 1] = x[:, 0] * 2 + draw.normal(0, 1, n)
    x[:, 2] = 5.0
    holes = draw.random((n, d)) < nulls
    rows = [tuple(None if h else float(v) for v, h in zip(r, hr)) for r, hr in zip(x, holes)]
    names = [f"c{i}" for i in range(d)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5), np.where(holes, np.nan, x), names


def test_correlations_of_pairs_with_nulls_and_constants(spark):
    df, x, names = wide(spark, 400, 6, nulls=0.2)
    pairs = [(a, b) for a in names for b in names]
    got = {(r["a"], r["b"]): r["r"] for r in agg.correlations(df, pairs).collect()}
    assert len(got) == 36
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 2 in (i, j):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-8)


def test_three_hundred_columns_in_one_pass(spark):
    df, x, names = wide(spark, 500, 300)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    rows = agg.correlations(df, pairs)
    got = {(r["a"], r["b"]): r["r"] for r in rows.collect()}
    assert len(got) == len(pairs) == 44850
    want = np.corrcoef(np.delete(x, 2, axis=1).T)
    kept = [c for c in names if c != "c2"]
    assert max(abs(got[a, b] - want[i, j]) for i, a in enumerate(kept) for j, b in enumerate(kept) if i < j) < 1e-8


def test_correlations_of_nothing(spark):
    df, _, names = wide(spark, 5, 3)
    assert [r["r"] for r in agg.correlations(df.limit(0), [("c0", "c1")]).collect()] == [None]
    assert agg.correlations(df, []).count() == 0


def test_moments_are_means_of_products(spark):
    df, x, names = wide(spark, 300, 4)
    xx, xy, yy, n = md.moments(df, names[:3], "c3")
    a = np.c_[np.ones(300), x[:, :3]]
    assert n == 300 and np.allclose(xx, a.T @ a / 300) and np.allclose(xy, a.T @ x[:, 3] / 300) and yy == pytest.approx((x[:, 3] ** 2).mean())


@pytest.fixture(scope="module")
def factors(spark):
    draw = random.Random(5)
    rows = [(f"i{i}", f"t{t}", float(draw.randint(1, 4))) for i in range(30) for t in range(12) if draw.random() < 0.3 or (i % 3 == t % 3 and draw.random() < 0.8)]
    links = spark.createDataFrame([*rows, (None, "t1", 1.0), ("i1", None, 1.0), ("i1", "t1", None)], "item string, tag string, weight double").repartition(3)
    items, tags = md.item_tag_vectors(links, "item", "tag", "weight", rank=4, rounds=8)
    return rows, md.materialize(items), md.materialize(tags)


def test_item_vectors_solve_the_normal_equations(factors):
    """The last half-step gives the items; each solves its regularised weighted least squares over the tags."""
    rows, items, tags = factors
    y = {r["key"]: np.array(r["vector"]) for r in tags.collect()}
    x = {r["key"]: np.array(r["vector"]) for r in items.collect()}
    assert set(x) == {r[0] for r in rows} and set(y) == {r[1] for r in rows}
    gram = sum(np.outer(v, v) for v in y.values())
    for item in x:
        own = [(t, w) for i, t, w in rows if i == item]
        left = gram + sum(w * np.outer(y[t], y[t]) for t, w in own) + 0.1 * len(own) * np.eye(4)
        assert np.allclose(np.linalg.solve(left, sum((1 + w) * y[t] for t, w in own)), x[item], atol=1e-3)


def test_best_matches_against_brute_force(spark, factors):
    _, items, tags = factors
    asked = items.filter("key IN ('i3', 'i4')").select(F.col("key").alias("query"), "vector")
    lists = spark.createDataFrame([("two", "t1"), ("two", "t2"), ("two", "t2"), ("none", "t99")], "query string, key string")
    asked = asked.unionByName(md.listed_vectors(tags, lists))
    got = md.best_matches(items.repartition(7), asked, 5).collect()
    x, y = ({r["key"]: np.array(r["vector"]) for r in f.collect()} for f in (items, tags))
    total = y["t1"] + y["t2"]
    probes = {"i3": x["i3"], "i4": x["i4"], "two": total / np.linalg.norm(total)}
    for name, probe in probes.items():
        want = sorted(((-float(probe @ v), k) for k, v in x.items()))[:5]
        own = sorted((r for r in got if r["query"] == name), key=lambda r: r["place"])
        assert [r["key"] for r in own] == [k for _, k in want] and [r["place"] for r in own] == [1, 2, 3, 4, 5]
        assert [r["score"] for r in own] == pytest.approx([-s for s, _ in want])
    assert {r["query"] for r in got} == set(probes)


def test_ties_and_no_queries(spark):
    vectors = spark.createDataFrame([(f"k{i}", [1.0, 0.0]) for i in range(40)], "key string, vector array<double>").repartition(6)
    asked = spark.createDataFrame([("q", [2.0, 1.0])], "query string, vector array<double>")
    assert [r["key"] for r in md.best_matches(vectors, asked, 3).orderBy("place").collect()] == ["k0", "k1", "k10"]
    assert md.best_matches(vectors, asked.limit(0), 3).count() == 0 and md.best_matches(vectors.limit(0), asked, 3).count() == 0
