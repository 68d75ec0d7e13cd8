"""Derived frames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.functions.hashing import hash_long
from loomframe.functions.text import explode_words
from loomframe.registry import Tables

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
STOP_WORDS = ["the", "of", "and", "la", "de", "le", "der", "die", "und", "el", "que", "et"]


def cust_nulls(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )


def tokens(t: Tables) -> DataFrame:
    return explode_words(t.documents, "text", ["doc_id", "lang", "source"])


def hour_number(ts: str):
    """Whole hours since 2024-01-01, the first event."""
    seconds = F.unix_timestamp(F.date_format(ts, "yyyy-MM-dd HH:00:00"))
    return ((seconds - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600).cast("bigint")


def hourly(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", hour_number("ts").alias("hour_no")).agg(F.count(F.lit(1)).alias("n"))


def preds(t: Tables) -> DataFrame:
    def score(seed: str):
        return (hash_long(seed, "doc_id") % 1000) / F.lit(1000.0) * F.lit(0.6) + F.lit(0.4) * F.col("quality")

    return t.labels.select("*", score("p").alias("score"), score("q").alias("score_q")).withColumns(
        {"pred": (F.col("score") > 0.5).cast("int"), "pred_q": (F.col("score_q") > 0.5).cast("int")}
    )
