import re
from collections import Counter

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from conftest import SF
from .test_near_texts import kept_by_brute_force
from loomframe.llm.exact import exact_groups
from loomframe.llm.mixing import mix_plan
from loomframe.llm.rows import without_rows
from loomframe.llm.toxicity import toxicity_scores
from loomframe.plans.checkpoints import scratch_path


def test_registration():
    names = list(entry_module.queries())
    assert "pipeline" in names and [n.split("_")[0] for n in names if re.match(r"op\d+_", n)].__len__() == 13


@pytest.mark.parametrize("n", [0, 1, 700])
def test_without_rows(spark, n):
    frame = spark.range(1000).selectExpr("id as r", "id * 2 as v", "'x' as _t")
    got = without_rows(frame, "r", spark.range(n).withColumnRenamed("id", "r"))
    assert got.columns == ["v", "_t"] and sorted(x["v"] for x in got.collect()) == [2 * i for i in range(n, 1000)]


def test_each_stage_acts_on_what_it_gets(spark, tables):
    docs, columns = tables.documents, tables.documents.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        got[name] = (docs, spark.read.parquet(path))
        docs = got[name][1]
    for name, (before, after) in list(got.items())[:-1]:
        assert after.columns == columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = got["toxicity"]
    assert ids(after) == ids(toxicity_scores(before, tables.labels).filter("predicted = 0"))
    before, after = got["exact dedup"]
    assert ids(after) == ids(exact_groups(before).filter("kept"))
    before, after = got["near dedup"]
    assert ids(after) == kept_by_brute_force([(r["doc_id"], r["text"]) for r in before.collect()])
    before, after = got["mixing"]
    assert Counter(ids(after)) == Counter({r["doc_id"]: r["copies"] for r in mix_plan(before).collect() if r["copies"]})
    before, after = got["packing"]
    whole = after.groupBy("doc_id").sum("length").collect()
    lengths = {r["doc_id"]: r["doc_tokens"] for r in after.select("doc_id", "doc_tokens").distinct().collect()}
    copies = Counter(ids(before))
    assert {r["doc_id"]: r["sum(length)"] for r in whole} == {i: copies[i] * n for i, n in lengths.items()} and set(lengths) == set(copies)
