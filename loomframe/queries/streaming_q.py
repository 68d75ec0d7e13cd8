"""Incremental jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loomframe.plans.checkpoints import scratch_path
from loomframe.registry import query
from loomframe.streaming import incremental as inc


@query("t1_stream_split", """
WITH d AS (SELECT count(*) AS n FROM documents)
SELECT 'train' AS part, ceil(round(0.8::DOUBLE * n, 9))::BIGINT AS n, TRUE AS no_repeats FROM d
UNION ALL SELECT 'validation', (n - ceil(round(0.8::DOUBLE * n, 9)))::BIGINT, TRUE FROM d""")
def stream_split(t):
    root = scratch_path(t.spark, "stream_split")
    docs = t.documents.select("doc_id", F.md5("text").alias("body"))
    docs.repartition(4, "doc_id").write.parquet(f"{root}/in")
    stream = inc.file_stream(t.spark, f"{root}/in", docs.schema)
    inc.drain(stream, f"{root}/checkpoint", inc.split_writer(f"{root}/register", ["doc_id"], ["doc_id"], 0.8, "stream"))
    register = t.spark.read.parquet(f"{root}/register")
    return register.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("no_repeats")
    )


@query("t2_newer_pairs", """
WITH s AS (SELECT event_id, ts, unnest(['A', 'B']) AS half FROM events),
m AS (SELECT TIMESTAMP '2024-01-16 00:00:00' AS mark),
o AS (SELECT count(*) // 2 AS last_pair FROM s, m WHERE ts <= mark),
r AS (SELECT event_id, half, row_number() OVER (ORDER BY ts, event_id, half) AS rn FROM s, m WHERE ts > mark)
SELECT event_id, half, (ceil(rn / 2) + last_pair)::BIGINT AS pair, CASE WHEN rn % 2 = 1 THEN 'A' ELSE 'B' END AS side FROM r, o""")
def newer_pairs(t):
    mark = datetime(2024, 1, 16)
    halves = t.events.select("event_id", "ts", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("half"))
    last_pair = halves.filter(F.col("ts") <= F.lit(mark)).count() // 2
    return inc.newer_pairs(halves, "ts", mark, ["ts", "event_id", "half"], last_pair).drop("ts")


@query("t3_stream_chunks", """
SELECT o_orderkey, o_totalprice, o_totalprice >= 200000 AS is_large FROM orders""")
def stream_chunks(t):
    root = scratch_path(t.spark, "stream_chunks")
    orders = t.orders.select("o_orderkey", "o_totalprice")
    orders.repartition(4, "o_orderkey").write.parquet(f"{root}/in")
    stream = inc.file_stream(t.spark, f"{root}/in", orders.schema).withColumn("is_large", F.col("o_totalprice") >= 200000)
    inc.append_chunks(stream, f"{root}/out", f"{root}/checkpoint")
    return t.spark.read.parquet(f"{root}/out")


@query("t3_table_stream", """
SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type""")
def table_stream(t):
    root = scratch_path(t.spark, "table_stream")
    stream = inc.file_stream(t.spark, t.sf_dir, t.events.schema, glob="events.parquet").select("event_id", "event_type", "value")
    inc.append_chunks(stream, f"{root}/out", f"{root}/checkpoint")
    stored = t.spark.read.parquet(f"{root}/out")
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("t2_streamed_pairs", """
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, ceil(rn / 2)::BIGINT AS pair, CASE WHEN rn % 2 = 1 THEN 'A' ELSE 'B' END AS side FROM r WHERE rn <= n - n % 2""")
def streamed_pairs(t):
    """Events arrive in three lots; the stream stops after each and goes on from its checkpoint."""
    root = scratch_path(t.spark, "streamed_pairs")
    events = t.events.select("event_id", "ts", "user_id")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * k / 3 for k in range(1, 3)] if low else []
    lot = sum(((F.col("ts") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for k in range(3):
        events.filter(lot == k).repartition(2, "ts").write.parquet(f"{root}/in/lot={k}")
        stream = inc.file_stream(t.spark, f"{root}/in/lot=*", events.schema, files_per_batch=64)
        inc.append_chunks(inc.paired_stream(stream, ["user_id"], "ts", ["ts", "event_id"]), f"{root}/out", f"{root}/checkpoint")
    return t.spark.read.parquet(f"{root}/out").select("event_id", "user_id", "pair", "side")
