import pytest
from pyspark.sql import functions as F

from loomframe.llm import mixing
from loomframe.llm.exact import drop_exact
from loomframe.llm.mixing import mix_documents, mix_plan
from loomframe.llm.near_texts import drop_near_texts
from loomframe.llm.rows import free_name, only_rows
from loomframe.llm.simhash import drop_near
from loomframe.llm.toxicity import _share, drop_toxic
from loomframe.plans.checkpoints import materialize

#: Names that stages use for columns of their own.
OWN = ["_word", "_bits", "_mix_row", "_mix_copies", "_mix_i", "_near_row", "_exact_row", "_toxic_row", "_Near_Row2"]


def test_free_name():
    assert free_name(["a"], "_x") == "_x" and free_name(["_X", "__x"], "_x") == "___x"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"some words of a document {i} and a few more of them to count", "en", "ab"[i % 2], 5, *[f"{n}{i}" for n in OWN]) for i in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in OWN)
    return spark.createDataFrame(rows, schema).coalesce(1), {r[0]: r for r in rows}


@pytest.mark.parametrize("stage", [drop_exact, drop_near, drop_near_texts, mix_documents, None])
def test_stages_keep_columns_named_as_theirs(spark, clashing, stage):
    docs, rows = clashing
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = drop_toxic(docs, labels) if stage is None else stage(docs)
    assert got.columns == docs.columns
    found = [tuple(r) for r in got.collect()]
    assert found and all(r == rows[r[0]] for r in found)


def test_only_rows(spark):
    frame = spark.range(1000).selectExpr("id as r", "id * 2 as `_word`")
    got = only_rows(frame, "r", spark.range(10, 13).withColumnRenamed("id", "r"))
    assert sorted(tuple(r) for r in got.collect()) == [(10, 20), (11, 22), (12, 24)]


def test_samples_are_bounded_whatever_the_key(spark):
    frame = materialize(spark.range(50_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("key"), "id"))
    got = _share(frame, "key", 2_000)
    assert got.count() == 2_000 and 500 < got.filter("key is null").count() < 1_800
    assert _share(frame, "key", 50_000).count() == 50_000


def test_rows_of_a_null_id_are_mixed_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 16)
    rows = spark.range(400).selectExpr("cast(null as long) as doc_id", "concat('one two ', id) as text", "if(id % 2 = 0, 'a', 'b') as source")
    got = mix_plan(rows).collect()
    assert len(got) == 400 and {r["taken"] % 3 for r in got} == {0}
    assert abs(sum(r["taken"] for r in got) - sum({r["target"] for r in got})) <= 6
