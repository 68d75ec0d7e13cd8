"""Split register (D-R2 to D-R6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions.hashing import hash_hex
from loomframe.operators import state
from loomframe.plans.checkpoints import scratch_path
from loomframe.registry import query
from loomframe.sources import sinks

# The saved state holds three eighths of the documents; the new input holds all of them.
_STATE = """
st AS (SELECT doc_id, md5(text) AS body, CASE WHEN row_number() OVER (ORDER BY doc_id) <= ceil(0.8 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS part
       FROM documents WHERE substr(md5('old:' || doc_id), 1, 1) < '6'),
fresh AS (SELECT doc_id, md5(text) AS body, row_number() OVER (ORDER BY md5('upd:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents WHERE NOT (substr(md5('old:' || doc_id), 1, 1) < '6')),
goal AS (SELECT least(greatest(ceil(round(0.8::DOUBLE * (SELECT count(*) FROM documents), 9)) - (SELECT count(*) FROM st WHERE part = 'train'), 0), (SELECT count(*) FROM fresh)) AS k),
reg AS (SELECT doc_id, body, part, FALSE AS is_new FROM st UNION ALL
        SELECT doc_id, body, CASE WHEN rn > n - k THEN 'train' ELSE 'validation' END, TRUE FROM fresh, goal)"""


def saved_earlier():
    return F.substring(hash_hex("old", "doc_id"), 1, 1) < "6"


def _state(t):
    docs = t.documents.select("doc_id", F.md5("text").alias("body"))
    return docs, state.save_split(docs.filter(saved_earlier()), ["doc_id"], 0.8)


def _register(t):
    docs, saved = _state(t)
    return state.update_split(saved, docs, ["doc_id"], 0.8, "upd")


@query("dr2_save_split", f"WITH {_STATE} SELECT doc_id, body, part FROM st")
def save_split(t):
    return _state(t)[1]


@query("dr3_update_split", f"WITH {_STATE} SELECT * FROM reg")
def update_split(t):
    return _register(t)


@query("dr4_read_split", f"WITH {_STATE} SELECT doc_id, body, part FROM reg")
def read_split(t):
    path = scratch_path(t.spark, "split")
    _, saved = _state(t)
    sinks.write_table(saved, path)
    register = state.update_split(t.spark.read.parquet(path), t.documents.select("doc_id", F.md5("text").alias("body")), ["doc_id"], 0.8, "upd")
    sinks.write_table(register.drop("is_new"), path, sinks.SinkMode.OVERWRITE)
    return t.spark.read.parquet(path)


@query("dr5_leak_report", f"""
WITH {_STATE}, x AS (SELECT DISTINCT body FROM reg WHERE part = 'train' INTERSECT SELECT body FROM reg WHERE part = 'validation')
SELECT count(*) > 0 AS found_leaks, count(*)::BIGINT AS total_leaks,
       (SELECT count(*) FROM reg WHERE part = 'train')::BIGINT AS train_samples,
       (SELECT count(*) FROM reg WHERE part = 'validation')::BIGINT AS validation_samples FROM x""")
def leak_report(t):
    register = _register(t).withColumn("label", F.lit("1"))
    return state.leak_report(register, ["body", "label"])


@query("dr5_leaks", f"""
WITH {_STATE} SELECT body AS sample FROM reg WHERE part = 'train' INTERSECT SELECT body FROM reg WHERE part = 'validation'""")
def leaks(t):
    return state.leaks(state.flatten_samples(_register(t), ["body"]))


@query("dr5_sample_counts", f"""
WITH {_STATE}, c AS (SELECT body AS sample, count(*) FILTER (WHERE part = 'train') AS tr, count(*) FILTER (WHERE part = 'validation') AS va FROM reg GROUP BY 1)
SELECT sample, CASE WHEN va > 0 THEN va ELSE tr END::BIGINT AS n FROM c""")
def sample_counts(t):
    return state.sample_counts(state.flatten_samples(_register(t), ["body"]))


@query("dr6_split_report", f"""
WITH {_STATE} SELECT part, count(*)::BIGINT AS n, count(*) FILTER (WHERE is_new)::BIGINT AS n_new,
       round(count(*)::DOUBLE / (SELECT count(*) FROM reg), 6) AS share FROM reg GROUP BY part""")
def split_report(t):
    return state.split_report(_register(t)).withColumn("share", F.round("share", 6))
