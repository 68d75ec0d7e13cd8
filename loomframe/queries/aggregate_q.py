"""Aggregations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from loomframe.functions.text import words
from loomframe.operators import aggregate as agg
from loomframe.queries.frames import cust_nulls, hourly, tokens
from loomframe.queries.sql import CUST_NULLS, HOURLY, TOKENS, WORDS
from loomframe.registry import query

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _struct_list(template: str, names) -> str:
    return "[" + ", ".join(template.format(c=c) for c in names) + "]"


@query("a1_class_distribution", """
SELECT quality, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent
FROM labels GROUP BY quality""")
def class_distribution(t):
    return agg.class_distribution(t.labels, "quality").withColumn("percent", F.round("percent", 6))


@query("a2_item_counts", f"WITH {TOKENS} SELECT word, count(*)::BIGINT AS n FROM tokens GROUP BY word")
def item_counts(t):
    return agg.item_counts(tokens(t), "word").orderBy(F.desc("n"), "word")


@query("a3_word_frequency", f"""
WITH {TOKENS} SELECT word, count(*)::BIGINT AS n FROM tokens GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def word_frequency(t):
    return agg.item_counts(tokens(t), "word").orderBy(F.desc("n"), "word").limit(50)


@query("a4_corpus_stats", f"""
SELECT source, count(*)::BIGINT AS documents, sum(len({WORDS}))::BIGINT AS words FROM documents GROUP BY source""")
def corpus_stats(t):
    return t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size(words("text"))).alias("words")
    )


@query("a5_distinct_counts", """
SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_suppkey)::BIGINT AS suppliers
FROM lineitem GROUP BY l_returnflag""")
def distinct_counts(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers")
    )


@query("a6_first_seen_codes", """
SELECT lang, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY lang""")
def first_seen_codes(t):
    return agg.first_seen_codes(t.documents, "lang", ["doc_id"])


@query("a7_resample_target", """
SELECT median(n) AS median, floor(median(n) * 0.9::DOUBLE)::BIGINT AS target
FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def resample_target(t):
    return agg.resample_target(t.documents, "lang", 0.9)


_PROFILE = _struct_list(
    "{{'feature': '{c}', 'n_null': (count(*) - count({c}))::BIGINT, 'mean': round(avg({c}), 4), 'std': round(stddev_samp({c}), 4), "
    "'min': min({c})::DOUBLE, 'max': max({c})::DOUBLE, 'q25': round(quantile_cont({c}, 0.25)::DOUBLE, 4), "
    "'q50': round(quantile_cont({c}, 0.5)::DOUBLE, 4), 'q75': round(quantile_cont({c}, 0.75)::DOUBLE, 4)}}",
    NUMERIC,
)


@query("a8_column_profile", f"SELECT unnest(s, recursive := true) FROM (SELECT unnest({_PROFILE}) AS s FROM lineitem)")
def column_profile(t):
    df = agg.column_profile(t.lineitem, NUMERIC)
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("a8_null_profile", f"""
WITH {CUST_NULLS}
SELECT (count(*) - count(c_acctbal))::BIGINT AS acctbal_nulls, (count(*) - count(c_mktsegment))::BIGINT AS segment_nulls,
       min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM cust_nulls""")
def null_profile(t):
    return cust_nulls(t).agg(
        F.count_if(F.col("c_acctbal").isNull()).alias("acctbal_nulls"),
        F.count_if(F.col("c_mktsegment").isNull()).alias("segment_nulls"),
        F.min("c_acctbal").alias("lo"),
        F.max("c_acctbal").alias("hi"),
    )


_CORR = "[" + ", ".join(
    f"{{'a': '{a}', 'b': '{b}', 'r': round(corr({a}, {b}), 6) + 0.0}}" for a, b in combinations(NUMERIC, 2)
) + "]"


@query("a9_correlations", f"SELECT unnest(s, recursive := true) FROM (SELECT unnest({_CORR}) AS s FROM lineitem)")
def correlations(t):
    return agg.correlations(t.lineitem, list(combinations(NUMERIC, 2))).withColumn("r", F.round("r", 6) + F.lit(0.0))


_POP = _struct_list(
    "{{'feature': '{c}', 'mean': round(avg({c}), 5), 'std': round(stddev_pop({c}), 5)}}", NUMERIC
)


@query("a10_population_stats", f"SELECT unnest(s, recursive := true) FROM (SELECT unnest({_POP}) AS s FROM lineitem)")
def population_stats(t):
    return agg.population_stats(t.lineitem, NUMERIC).withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query("a11_group_centroids", """
WITH v AS (SELECT label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, dim, round(avg(x), 6) AS mean, count(*)::BIGINT AS n FROM v GROUP BY label, dim""")
def group_centroids(t):
    return agg.vector_centroids(t.embeddings, "label", "embedding").withColumn("mean", F.round("mean", 6))


@query("a12_xor_words", """
SELECT l_returnflag, bit_xor(l_orderkey) AS orders_xor, bit_xor(l_partkey) AS parts_xor FROM lineitem GROUP BY 1""")
def xor_words(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.bit_xor("l_orderkey").alias("orders_xor"), F.bit_xor("l_partkey").alias("parts_xor")
    )


@query("a13_rates_of_total", """
SELECT event_type, count(*)::BIGINT AS attempts, count(*) FILTER (WHERE value >= 10)::BIGINT AS writes,
       round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS attempt_rate,
       round(count(*) FILTER (WHERE value >= 10)::DOUBLE / sum(count(*) FILTER (WHERE value >= 10)) OVER (), 6) AS write_rate
FROM events GROUP BY event_type""")
def rates_of_total(t):
    df = agg.rates_of_total(t.events, "event_type", F.col("value") >= 10)
    return df.withColumns({c: F.round(c, 6) for c in ("attempt_rate", "write_rate")})


@query("a14_class_summary", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS views,
       count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchases,
       count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors FROM events GROUP BY user_id""")
def class_summary(t):
    counters = {"views": "view", "purchases": "purchase", "errors": "error"}
    return t.events.groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in counters.items()]
    )


@query("a15_missed_ids", """
WITH d AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error')
SELECT user_id, k, count(*) OVER (PARTITION BY user_id)::BIGINT AS total FROM d""")
def missed_ids(t):
    errors = t.events.filter(F.col("event_type") == "error").select(
        "user_id", F.get_json_object("props", "$.k").alias("k")
    )
    return agg.ids_per_class(errors, "user_id", "k")


@query("a16_column_profile", f"""
WITH {HOURLY}
SELECT hour_no % 24 AS hour_of_day, sum(n)::BIGINT AS total, max(n)::BIGINT AS peak FROM hourly GROUP BY 1""")
def projection_profile(t):
    matrix = hourly(t).withColumn("hour_of_day", F.col("hour_no") % 24)
    return agg.column_profiles(matrix, "hour_of_day", "n")


@query("a17_tile_stats", """
SELECT level, floor((l_partkey % 64) * pow(2, level) / 64)::INT AS tile_x,
       floor((l_suppkey % 64) * pow(2, level) / 64)::INT AS tile_y,
       round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, stddev_pop(l_quantity) < 14.4 AS is_flat
FROM lineitem, (SELECT unnest([1, 2, 3]) AS level) GROUP BY 1, 2, 3""")
def tile_stats(t):
    grid = t.lineitem.select(
        (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"), F.col("l_quantity").alias("v")
    )
    return agg.tile_stats(grid, "x", "y", "v", 64, 64, 3, 14.4).withColumns(
        {c: F.round(c, 6) for c in ("mean", "std")}
    )


@query("a18_occurrences", """
WITH tr AS (SELECT md5(text) AS item, count(*) AS n FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3') GROUP BY 1),
     va AS (SELECT md5(text) AS item, count(*) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3') GROUP BY 1)
SELECT coalesce(tr.item, va.item) AS item, coalesce(va.n, tr.n)::BIGINT AS n FROM tr FULL JOIN va ON tr.item = va.item""")
def occurrences(t):
    docs = t.documents.select("source", F.md5("text").alias("item"))
    held_out = F.col("source").isin("src0", "src1", "src2", "src3")
    return agg.occurrences(docs.filter(~held_out), docs.filter(held_out), "item")
