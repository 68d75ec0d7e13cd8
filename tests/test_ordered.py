"""Chunked ranks, sums, neighbours and quantiles against plain pandas, with one hot group."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from loomframe.plans import ordered, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """Six thousand rows, two thirds of them in one class, spread over several chunks."""
    rng = np.random.default_rng(7)
    frame = pd.DataFrame(
        {
            "id": np.arange(6000),
            "cls": np.where(rng.random(6000) < 0.66, "hot", rng.choice(["a", "b", "c"], 6000)),
            "x": rng.integers(0, 50, 6000).astype(float),
        }
    )
    frame.loc[frame.id % 97 == 0, "cls"] = None
    return frame, spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, cls string, x double").repartition(6)


@pytest.fixture(autouse=True)
def many_chunks(spark):
    """Keep small partitions apart so that the chunk arithmetic is really used."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def expected(frame, column):
    ordered_frame = frame.sort_values(["x", "id"], ascending=[False, True])
    return ordered_frame.assign(want=column(ordered_frame)).set_index("id")["want"].to_dict()


def test_row_numbers_by_class(skewed):
    frame, df = skewed
    got = ordered.row_numbers(df, [F.desc("x"), F.col("id")], ["cls"])
    assert ordered.sorted_chunks(df, ["id"]).select("_seq_chunk").distinct().count() > 1
    want = expected(frame, lambda f: f.groupby("cls", dropna=False).cumcount() + 1)
    assert {r["id"]: r["rn"] for r in got.collect()} == want


def test_running_sums_and_neighbours(skewed):
    frame, df = skewed
    order = [F.desc("x"), F.col("id")]
    want = expected(frame, lambda f: f.x.cumsum())
    assert {r["id"]: r["cum_x"] for r in ordered.running_sums(df, ["x"], order).collect()} == want
    want = expected(frame, lambda f: f.groupby("cls", dropna=False).id.shift(1))
    got = ordered.previous_values(df, "id", order, ["cls"], out="p").collect()
    assert {r["id"]: r["p"] for r in got} == {k: None if np.isnan(v) else int(v) for k, v in want.items()}
    assert sum(not r["p_exists"] for r in got) == 5


def test_next_matching(skewed):
    frame, df = skewed
    marked = df.withColumn("m", F.col("id") % 400 == 0)
    got = {r["id"]: r["next"] for r in ordered.next_matching(marked, "m", "id", ["id"]).collect()}
    want = {i: next((j for j in range(i + 1, 6000) if j % 400 == 0), None) for i in range(6000)}
    assert got == want


def test_hashed_ranks_are_a_permutation(skewed):
    frame, df = skewed
    rows = ordered.hashed_row_numbers(df, "s", ["id"], ["cls"]).collect()
    for cls, part in pd.DataFrame([r.asDict() for r in rows]).groupby("cls", dropna=False):
        assert sorted(part.rn) == list(range(1, len(part) + 1))


def test_hashed_order_follows_md5(spark):
    from hashlib import md5

    got = ordered.hashed_row_numbers(spark.range(300), "s", ["id"]).orderBy("rn").collect()
    assert [r["id"] for r in got] == sorted(range(300), key=lambda i: md5(f"s:{i}".encode()).hexdigest())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=3, max_size=60), st.sampled_from([0.0, 0.26, 0.5, 0.76, 1.0]))
def test_quantiles_match_numpy(spark, values, prob):
    present = [v for v in values if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles.fit_statistics(df, {"x": [prob]})[0]
    if not present:
        assert got == {}
    else:
        assert got[("x", prob)] == pytest.approx(np.quantile(present, prob))


def test_sorted_path_agrees(skewed):
    frame, df = skewed
    a = quantiles.exact_quantiles(df, ["x", "id"], [0.1, 0.77])
    b = quantiles._sorted_quantiles(df, ["x", "id"], [0.1, 0.77], [])
    key = lambda r: (r["feature"], r["prob"])
    assert {key(r): r["value"] for r in a.collect()} == pytest.approx({key(r): r["value"] for r in b.collect()})


def test_quantiles_by_group(skewed):
    frame, df = skewed
    got = {(r["cls"], r["prob"]): r["value"] for r in quantiles.exact_quantiles(df, ["x"], [0.26, 0.9], ["cls"]).collect()}
    for cls, part in frame.groupby("cls"):
        for p in (0.26, 0.9):
            assert got[(cls, p)] == pytest.approx(np.quantile(part.x, p))


def test_quantiles_of_a_large_tied_column(skewed):
    frame, df = skewed
    got = quantiles.fit_statistics(df, {"x": [0.25, 0.5, 0.999], "id": [0.25, 0.5, 0.999]})[0]
    for c in ("x", "id"):
        for p in (0.25, 0.5, 0.999):
            assert got[(c, p)] == pytest.approx(np.quantile(frame[c], p))
