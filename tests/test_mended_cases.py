"""Cases that the given tables do not hold: nulls, text labels, one class only, unusual markup and digits."""

import pytest
from pyspark.sql import functions as F

from loomframe.functions.scalar import padded_list
from loomframe.functions.text import strip_noise
from loomframe.operators import clean, features, metrics, pairs, web


def test_nulls_are_kept_when_values_are_excluded(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    assert sorted(map(str, [r["c"] for r in clean.exclude_values(df, "c", ["a"]).collect()])) == ["None", "b"]


def test_null_has_no_bin(spark):
    df = spark.createDataFrame([(0.0,), (None,), (10.0,)], "x double")
    assert [r["b"] for r in df.select(features.equal_width_bin(F.col("x"), 0.0, 10.0, 4).alias("b")).collect()] == [0, None, 3]


def test_confusion_of_text_labels(spark):
    df = spark.createDataFrame([("cat", "dog"), ("cat", "cat"), ("owl", "cat"), (None, "cat")], "t string, p string")
    got = {(r["truth"], r["pred"]): (r["n"], r["share"]) for r in metrics.confusion_matrix(df, "t", "p").collect()}
    assert len(got) == 9 and got[("cat", "dog")] == (1, 0.25) and got[("dog", "owl")] == (0, 0.0)


def test_negatives_need_two_classes(spark):
    one = spark.createDataFrame([(1, 2 * i, 2 * i + 1) for i in range(6)], "label long, a_id long, b_id long")
    with pytest.raises(ValueError, match="two classes"):
        pairs.negative_pairs(one, "label", 0.75, "s")
    with pytest.raises(ValueError, match="exceed"):
        pairs.evaluation_batch(one, "label", 4, 0.1, "s", uniques=one)


def test_members_are_paired_once(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(50)], "label long, id long")
    got = pairs.paired_members(df, "label", "id", "s").collect()
    ids = [x for r in got for x in (r["a_id"], r["b_id"])]
    assert len(got) == 24 and len(set(ids)) == 48 and all(r["a_id"] % 3 == r["b_id"] % 3 == r["label"] for r in got)


def test_anchor_markup(spark):
    html = """<a href='one.html'>1</a> <A class=x href=/two>2 <a href="http://o.org/three">3</a><a href = "four.jpg">4"""
    df = spark.createDataFrame([(1, "http://s.com/d/p.html?q", html), (2, "http://s.com", "<a href=five>")], "k int, u string, h string")
    got = {r["link"] for r in web.page_links(df, "k", "u", "h", ".").collect()}
    assert got == {"http://s.com/d/one.html", "http://s.com/two", "http://o.org/three", "http://s.com/d/four.jpg", "http://s.com/five"}


def test_digits_of_any_script_and_long_lists(spark):
    df = spark.createDataFrame([("a \u0663\u0664 b 12", ["x", None, "z", "w"])], "t string, l array<string>")
    row = df.select(strip_noise(F.col("t")).alias("t"), padded_list(F.col("l"), F.lit(6)).alias("l")).first()
    assert row["t"] == "a  b " and row["l"] == ["x", "", "z", "w", "", ""]


def test_foreign_tags_are_whole_and_not_own(spark):
    from loomframe.operators import sampling

    rows = [(1, [1, 2]), (2, []), (3, [0, 1, 2, 3, 4, 5]), (4, [0, 1, 2, 3, 4]), (5, [2, 2, 2])]
    df = spark.createDataFrame(rows, "id long, own array<bigint>")
    got = df.select("id", sampling.foreign_tags(F.col("own"), "id", 5, 3, "s").alias("tags")).collect()
    own = dict(rows)
    for r in got:
        free = set(range(6)) - set(own[r["id"]])
        assert set(r["tags"]) <= free and len(r["tags"]) == len(set(r["tags"])) == min(3, len(free))
