"""Sparse one-hot vectors by dictionary, and tables swapped by renaming."""

import json
from datetime import datetime

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from loomframe.operators import features as ft
from loomframe.plans.checkpoints import scratch_path
from loomframe.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "b", 5), (2, None, 5), (3, "a", None), (4, "b", 7)], "id int, c string, d int")


def hot(df, dictionaries):
    return {r["id"]: r["v"] for r in ft.one_hot(df, dictionaries, "v").collect()}


def test_null_is_a_category_and_unknown_is_none(spark, rows):
    codes = ft.fit_categories(rows, "c")
    assert [(r["c"], r["code"]) for r in codes.orderBy("code").collect()] == [("a", 0), ("b", 1), (None, 2)]
    got = hot(rows.unionByName(spark.createDataFrame([(5, "z", 1)], rows.schema)), {"c": codes})
    assert {i: v.toArray().tolist() for i, v in got.items()} == {1: [0, 1, 0], 2: [0, 0, 1], 3: [1, 0, 0], 4: [0, 1, 0], 5: [0, 0, 0]}


def test_columns_lie_side_by_side_and_no_null_means_none(rows):
    got = hot(rows, {"c": ft.fit_categories(rows.filter("c IS NOT NULL"), "c"), "d": ft.fit_top_labels(rows, "d", 0.4)})
    assert {i: v.toArray().tolist() for i, v in got.items()} == {1: [0, 1, 1], 2: [0, 0, 1], 3: [1, 0, 0], 4: [0, 1, 0]}


def test_many_categories_are_one_narrow_column(spark):
    df = spark.range(30_000).select("id", F.concat(F.lit("v"), F.col("id") % 20_000).alias("c"))
    out = ft.one_hot(df, {"c": ft.fit_categories(df, "c")}, "v")
    assert out.columns == ["id", "c", "v"]
    row = out.filter("id = 25000").first()["v"]
    assert isinstance(row, SparseVector) and row.size == 20_000 and len(row.indices) == 1 and out.count() == 30_000


def test_empty_table(rows):
    none = rows.limit(0)
    assert ft.one_hot(none, {"c": ft.fit_categories(none, "c")}, "v").count() == 0


@pytest.fixture()
def table(spark):
    path = scratch_path(spark, "table")
    sinks.write_table(spark.range(3), path)
    return path


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


def test_modes(spark, table):
    assert sinks.write_table(spark.range(9), table, sinks.SinkMode.KEEP) is None and ids(spark, table) == [0, 1, 2]
    now = datetime(2024, 5, 6, 7, 8, 9)
    backup = sinks.write_table(spark.read.parquet(table).filter("id > 0"), table, sinks.SinkMode.BACKUP, now)
    assert backup.endswith("_07-08-09-May-06-2024") and ids(spark, backup) == [0, 1, 2] and ids(spark, table) == [1, 2]
    with pytest.raises(FileExistsError):  # a second backup of the same second must not replace the first
        sinks.write_table(spark.range(1), table, sinks.SinkMode.BACKUP, now)
    assert ids(spark, table) == [1, 2]
    assert sinks.write_table(spark.read.parquet(table).selectExpr("id + 5 as id"), table) is None and ids(spark, table) == [6, 7]


@pytest.mark.parametrize("mode", [sinks.SinkMode.OVERWRITE, sinks.SinkMode.BACKUP])
@pytest.mark.parametrize("steps", [0, 1, 2])
def test_a_swap_that_was_cut_off_is_completed(spark, table, monkeypatch, mode, steps):
    """The job ends before the first, between the two, or after both renames."""
    done, rename = [], sinks._rename

    def cut(session, old, new):
        if len(done) == steps:
            raise KeyboardInterrupt
        done.append(new)
        rename(session, old, new)
        if len(done) == steps == 2:
            raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "_rename", cut)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_table(spark.range(10, 12), table, mode, datetime(2024, 1, 1))
    monkeypatch.setattr(sinks, "_rename", rename)
    assert sorted(r["id"] for r in sinks.read_table(spark, table).collect()) == [10, 11]
    backup = f"{table}_00-00-00-Jan-01-2024"
    assert sinks.path_exists(spark, backup) == (mode is sinks.SinkMode.BACKUP) and not sinks.path_exists(spark, table + ".swap")
    if mode is sinks.SinkMode.BACKUP:
        assert ids(spark, backup) == [0, 1, 2]


def test_an_unfinished_marker_leaves_the_old_table(spark, table):
    fs, marker = sinks._hadoop(spark, sinks._marker(table))
    stream = fs.create(marker, False)
    stream.write(bytearray(json.dumps({"fresh": "x", "aside": "y"})[:-4].encode()))
    stream.close()
    assert sorted(r["id"] for r in sinks.read_table(spark, table).collect()) == [0, 1, 2]
    sinks.write_table(spark.range(1), table)
    assert ids(spark, table) == [0]
