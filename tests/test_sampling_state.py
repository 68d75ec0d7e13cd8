"""Invariants of splits, pairs, the split register and its stream form."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from loomframe.operators import lookup, pairs, sampling, state, window
from loomframe.plans.checkpoints import scratch_path
from loomframe.sources import readers, sinks
from loomframe.streaming import incremental as inc

RELAXED = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@RELAXED
@given(st.integers(1, 80), st.sampled_from([0.1, 0.2, 0.25, 0.5]))
def test_split_is_exact_and_disjoint(spark, n, share):
    rows = sampling.split_exact(spark.range(n), ["id"], share, "s").collect()
    test = [r["id"] for r in rows if r["part"] == "test"]
    assert len(rows) == n == len({r["id"] for r in rows})
    assert len(test) == math.ceil(round(share * n, 9))


@RELAXED
@given(st.integers(2, 60), st.integers(2, 5))
def test_contiguous_folds_match_the_usual_sizes(spark, n, k):
    if n < k:
        return
    rows = sampling.contiguous_folds(spark.range(n), ["id"], k).orderBy("id").collect()
    want = [f for f in range(k) for _ in range(n // k + (1 if f < n % k else 0))]
    assert [r["fold"] for r in rows] == want


def test_stratified_folds_balance_each_class(spark):
    df = spark.range(53).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    counts = sampling.stratified_folds(df, "y", ["id"], 4).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r["y"] == y]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    totals = [sum(r["count"] for r in counts if r["fold"] == f) for f in range(4)]
    assert max(totals) - min(totals) <= 1


def test_class_pairs_count_and_classes(tables):
    df = tables.embeddings
    got = pairs.class_pairs(df, "label", "vec_id", 6, "s")
    per_class = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert set(per_class.values()) == {6 * 5 // 2}
    labels = {r["vec_id"]: r["label"] for r in df.select("vec_id", "label").collect()}
    rows = got.collect()
    assert all(labels[r["a_id"]] == labels[r["b_id"]] == r["label"] and r["a_id"] != r["b_id"] for r in rows)
    assert len({frozenset((r["a_id"], r["b_id"])) for r in rows}) == len(rows)


def test_small_class_gives_all_its_pairs(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "label string, id int")
    assert pairs.class_pairs(df, "label", "id", 10, "s").count() == 3


def test_random_pairs_have_two_members(tables):
    rows = pairs.random_class_pairs(tables.embeddings, "label", "vec_id", 15, "s").collect()
    assert len(rows) == 150 and all(r["a_id"] != r["b_id"] for r in rows)


def test_negative_pairs_cross_classes(spark):
    rows = [("hot", 2 * i, 2 * i + 1) for i in range(40)] + [("x", 100 + 2 * i, 101 + 2 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "label string, a_id int, b_id int")
    got = pairs.negative_pairs(df, "label", 0.5, "s").collect()
    assert len(got) == 22  # 45 * 0.5 = 22.5, rounded down to even
    assert all(r["a_label"] != r["b_label"] for r in got)
    owner = {v: r[0] for r in rows for v in r[1:]}
    assert all(owner[r["a_id"]] == r["a_label"] and owner[r["b_id"]] == r["b_label"] for r in got)


def test_rejected_draws_grow_until_enough(spark):
    every = spark.range(10).crossJoin(spark.range(10).withColumnRenamed("id", "r")).withColumnRenamed("id", "l")
    known = every.filter("NOT (l = 3 AND r = 4)")
    got = lookup.rejected_draws(known, "l", "r", 10, 10, 5, "s").collect()
    assert len(got) == 5 and all((r["l"], r["r"]) == (3, 4) for r in got)
    with pytest.raises(ValueError):
        lookup.rejected_draws(every, "l", "r", 10, 10, 1, "s")


def test_oversample_lifts_only_the_minority(spark):
    df = spark.range(30).select("id", (F.col("id") >= 24).cast("int").alias("y"))
    got = sampling.oversample_minority(df, "y", "id", "s")
    assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {0: 24, 1: 24}
    assert got.filter("NOT is_extra").count() == 30


def test_surplus_refuses_short_classes(spark):
    with pytest.raises(ValueError):
        window.surplus_move(spark.range(3).withColumn("c", F.lit("a")), "c", ["id"], 5, "Train", "Test")


@pytest.fixture()
def samples(spark):
    return lambda n: sampling.dummy_samples(spark, n, "d")


def test_register_grows_from_20_to_45(samples):
    """The recorded example: 16 + 4 rows become 36 + 9, nothing moves and nothing leaks."""
    old = samples(20)
    saved = state.save_split(old, ["sample_a"], 0.8)
    assert {r["part"]: r["count"] for r in saved.groupBy("part").count().collect()} == {"train": 16, "validation": 4}
    grown = state.update_split(saved, samples(45), ["sample_a"], 0.8, "s")
    assert {r["part"]: r["count"] for r in grown.groupBy("part").count().collect()} == {"train": 36, "validation": 9}
    assert state.same_rows(grown.filter("NOT is_new").drop("is_new"), saved).first()["same"]
    report = state.leak_report(grown, ["sample_a", "sample_b", "label"]).first()
    assert (report["found_leaks"], report["train_samples"], report["validation_samples"]) == (False, 72, 18)


def test_register_clamps_a_skewed_state(spark, samples):
    every = samples(10).withColumn("part", F.lit("train"))
    grown = state.update_split(every, samples(11), ["sample_a"], 0.5, "s")
    assert grown.filter("is_new").select("part").first()["part"] == "validation"
    with pytest.raises(KeyError):
        state.check_manual({"train": samples(2)})


def test_leak_audit_finds_shared_samples(spark):
    df = spark.createDataFrame([("p1", "p2", "1", "train"), ("p2", "p3", "0", "validation")], "a string, b string, label string, part string")
    report = state.leak_report(df, ["a", "b", "label"]).first()
    assert (report["found_leaks"], report["total_leaks"]) == (True, 1)


def test_tuple_file_round_trip(spark, samples):
    path, rows = scratch_path(spark, "tuples"), samples(20)
    rows.select(readers.tuple_line(rows.columns)).write.text(path)
    assert state.same_rows(rows, readers.read_tuples(spark, path, rows.columns)).first()["same"]


def test_streamed_register_equals_the_share_and_repeats_safely(spark, samples):
    register = scratch_path(spark, "register")
    write = inc.split_writer(register, ["sample_a"], ["sample_a"], 0.8, "s")
    write(samples(20), 0)
    write(samples(45), 1)
    before = sorted(map(tuple, spark.read.parquet(register).collect()), key=str)
    write(samples(45), 1)
    assert sorted(map(tuple, spark.read.parquet(register).collect()), key=str) == before
    assert {r["part"]: r["count"] for r in spark.read.parquet(register).groupBy("part").count().collect()} == {"train": 36, "validation": 9}


def test_newer_pairs_refuse_an_odd_count(spark):
    df = spark.range(5).withColumn("ts", F.col("id"))
    with pytest.raises(ValueError):
        inc.newer_pairs(df, "ts", -1, ["ts"], 0)
    rows = inc.newer_pairs(df, "ts", 0, ["ts"], 7).orderBy("id").collect()
    assert [(r["pair"], r["side"]) for r in rows] == [(8, "A"), (8, "B"), (9, "A"), (9, "B")]


def test_sink_modes(spark):
    path = scratch_path(spark, "modes")
    assert sinks.write_table(spark.range(2), path) is None
    sinks.write_table(spark.range(9), path, sinks.SinkMode.KEEP)
    assert spark.read.parquet(path).count() == 2
    backup = sinks.write_table(spark.read.parquet(path).union(spark.range(3)), path, sinks.SinkMode.BACKUP)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(backup).count() == 2


def test_rejected_draws_near_a_full_matrix(spark):
    """Nine in ten pairs are positives; draws repeat with the seed and are never positives."""
    taken = spark.range(0, 400).selectExpr("id div 20 as l", "id % 20 as r").filter("(l + r) % 10 <> 0")
    got = lookup.rejected_draws(taken.unionByName(taken), "l", "r", 20, 20, 60, "s").orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 61)) and all((r["l"] + r["r"]) % 10 == 0 for r in got)
    first = lookup.rejected_draws(taken, "l", "r", 20, 20, 5, "s").orderBy("rn").collect()
    assert [tuple(r) for r in first] == [tuple(r) for r in got[:5]]
    assert lookup.rejected_draws(taken, "l", "r", 20, 20, 0, "s").count() == 0


def test_rejected_draws_refuse_a_full_matrix(spark):
    every = spark.range(0, 2000).selectExpr("id div 50 as l", "id % 50 as r")
    for positives in (every, every.filter("l < 39 OR r < 49")):  # the second has one free pair in 2,000
        with pytest.raises(ValueError):
            lookup.rejected_draws(positives, "l", "r", 40, 50, 1, "s")
