"""Pairs numbered across batches by keyed state."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomframe.plans.checkpoints import scratch_path
from loomframe.streaming import incremental as inc

SCHEMA = "id long, k string, at timestamp, note string"


@pytest.fixture()
def lots(spark):
    """Rows of 3 keys, one of them holding most rows, in four lots of rising time; a note may be null."""
    draw = random.Random(7)
    rows = [(i, draw.choice(["hot"] * 5 + ["b", None]), i // 2, draw.choice([None, "x"])) for i in range(157)]
    frame = spark.createDataFrame(rows, "id long, k string, at long, note string").withColumn("at", F.timestamp_seconds("at"))
    cuts = [0, 20, 21, 60, 79]  # the second lot has a row or two only
    return [frame.filter((F.unix_timestamp("at") >= a) & (F.unix_timestamp("at") < b)) for a, b in zip(cuts, cuts[1:])]


def run(spark, lots, root, keys, fresh=None):
    for i, lot in enumerate(lots):
        lot.repartition(3).write.mode("append").parquet(f"{root}/in")
        stream = inc.file_stream(spark, f"{root}/in", lot.schema, files_per_batch=64)
        inc.append_chunks(inc.paired_stream(stream, keys, "at", ["at", "id"]), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


def wanted(rows, key):
    out = []
    for k in {key(r) for r in rows}:
        own = sorted((r for r in rows if key(r) == k), key=lambda r: (r["at"], r["id"]))
        out += [(r["id"], i // 2 + 1, "AB"[i % 2], r["note"]) for i, r in enumerate(own[: len(own) // 2 * 2])]
    return sorted(out)


def shown(frame):
    return sorted((r["id"], r["pair"], r["side"], r["note"]) for r in frame.collect())


@pytest.mark.parametrize("keys", [["k"], []])
def test_batches_and_restarts_give_the_pairs_of_one_batch(spark, lots, keys):
    rows = [r for lot in lots for r in lot.collect()]
    got = run(spark, lots, scratch_path(spark, "pairs"), keys)
    assert shown(got) == wanted(rows, (lambda r: r["k"]) if keys else (lambda r: 0))


def test_equals_the_batch_form(spark, lots):
    every = lots[0].unionByName(lots[1]).unionByName(lots[2]).unionByName(lots[3]).filter("id < 156")
    batch = inc.newer_pairs(every, "at", "1900-01-01 00:00:00", ["at", "id"], 0)
    got = run(spark, [lot.filter("id < 156") for lot in lots], scratch_path(spark, "pairs"), [])
    assert shown(got) == shown(batch)


def test_a_repeated_batch_changes_nothing(spark, lots):
    root = scratch_path(spark, "pairs")
    before = shown(run(spark, lots[:3], root, ["k"]))
    commits = os.path.join(root.removeprefix("file:"), "checkpoint", "commits")
    for name in ("2", ".2.crc"):  # as if the stream had died after the write and before the commit
        os.remove(os.path.join(commits, name))
    stream = inc.file_stream(spark, f"{root}/in", lots[0].schema, files_per_batch=64)
    inc.append_chunks(inc.paired_stream(stream, ["k"], "at", ["at", "id"]), f"{root}/out", f"{root}/checkpoint")
    assert shown(spark.read.parquet(f"{root}/out")) == before
    assert shown(run(spark, lots[3:], root, ["k"])) == wanted([r for lot in lots for r in lot.collect()], lambda r: r["k"])


def test_old_and_timeless_items_are_passed_over(spark):
    def lot(rows):
        frame = spark.createDataFrame([(i, "k", t, None) for i, t in rows], "id long, k string, at long, note string")
        return frame.withColumn("at", F.timestamp_seconds("at"))

    lots = [lot([(1, 10), (2, 11), (3, 12), (4, None)]), lot([(5, 12), (6, 3)]), lot([(7, 13), (8, None)])]
    got = run(spark, lots, scratch_path(spark, "pairs"), ["k"])
    assert shown(got) == [(1, 1, "A", None), (2, 1, "B", None), (3, 2, "A", None), (7, 2, "B", None)]
