"""Window functions, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions.hashing import hash_hex
from loomframe.functions.vectors import dot, doubles
from loomframe.operators import aggregate as agg, window
from loomframe.plans.ordered import row_numbers
from loomframe.queries.frames import hourly, tokens
from loomframe.queries.sql import HOURLY, TOKENS
from loomframe.registry import query


@query("w1_encounter_ids", f"""
WITH {TOKENS}
SELECT word, row_number() OVER (ORDER BY min(doc_id * 1000000 + pos)) - 1 AS code FROM tokens GROUP BY word""")
def encounter_ids(t):
    return agg.first_seen_codes(tokens(t), "word", ["doc_id", "pos"])


@query("w2_category_codes", """
SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part""")
def category_codes(t):
    from loomframe.operators.lookup import encode

    return encode(t.part.select("p_partkey", "p_brand"), agg.sorted_codes(t.part, "p_brand"), "p_brand").drop("p_brand")


@query("w3_class_quota", """
WITH s AS (SELECT vec_id, label, CASE WHEN substr(md5('split:' || vec_id), 1, 1) < '4' THEN 'test' ELSE 'train' END AS split
           FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY vec_id) AS rn FROM s)
SELECT vec_id, label, split, rn FROM r WHERE rn <= 10""")
def class_quota(t):
    digit = F.substring(hash_hex("split", "vec_id"), 1, 1)
    df = t.embeddings.select("vec_id", "label", F.when(digit < "4", "test").otherwise("train").alias("split"))
    return window.quota(df, ["split", "label"], ["vec_id"], 10)


@query("w4_surplus_move", """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn,
                  (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) AS final FROM events)
SELECT event_id, event_type, rn, CASE WHEN rn > final THEN 'Test' ELSE 'Train' END AS split FROM r""")
def surplus_move(t):
    df = t.events.select("event_id", "event_type")
    final = df.groupBy("event_type").count().agg(F.min("count")).first()[0]
    return window.surplus_move(df, "event_type", ["event_id"], final, "Train", "Test")


@query("w5_local_maxima", f"""
WITH {HOURLY},
w AS (SELECT *, lag(n) OVER x AS p, lead(n) OVER x AS q, row_number() OVER x - 1 AS index
      FROM hourly WINDOW x AS (PARTITION BY event_type ORDER BY hour_no))
SELECT event_type, hour_no, n, index FROM w WHERE n > p AND n > q""")
def local_maxima(t):
    return window.local_maxima(hourly(t), ["event_type"], "hour_no", "n")


@query("w6_collapse_repeats", """
WITH w AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
           FROM events)
SELECT event_id, user_id, event_type FROM w WHERE p IS NULL OR p <> event_type""")
def collapse_repeats(t):
    df = t.events.select("event_id", "user_id", "ts", "event_type")
    return window.collapse_repeats(df, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("w7_near_group_max", """
WITH w AS (SELECT o_orderkey, o_custkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM w WHERE o_totalprice > m * 0.8::DOUBLE""")
def near_group_max(t):
    return window.near_group_max(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 0.8)


@query("w8_cumulative_share", """
WITH c AS (SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS cents FROM part),
s AS (SELECT p_partkey, cents, sum(cents) OVER (ORDER BY cents DESC, p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_cents,
             (SELECT sum(cents) FROM c)::BIGINT AS total FROM c)
SELECT p_partkey, cents, cum_cents, (cum_cents - cents) < total * 0.95::DOUBLE AS important FROM s""")
def cumulative_share(t):
    df = t.part.select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents"))
    return window.cumulative_share(df, "cents", "p_partkey", 0.95)


@query("w9_pair_numbers", """
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT conv_id, turn, rn, ceil(rn / 2)::BIGINT AS pair, CASE WHEN rn % 2 = 1 THEN 'A' ELSE 'B' END AS side FROM r""")
def pair_numbers(t):
    return window.pair_numbers(t.conversations.select("conv_id", "turn"), ["conv_id"], ["turn"])


@query("w10_complete_pairs", """
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
k AS (SELECT conv_id, turn, ceil(rn / 2)::BIGINT AS pair, CASE WHEN rn % 2 = 1 THEN 'A' ELSE 'B' END AS side FROM r
      WHERE role <> 'system')
SELECT conv_id, turn, pair, side FROM k
WHERE (conv_id, pair) IN (SELECT (conv_id, pair) FROM k GROUP BY conv_id, pair HAVING count(DISTINCT side) = 2)""")
def complete_pairs(t):
    numbered = window.pair_numbers(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"])
    kept = numbered.filter("role <> 'system'").select("conv_id", "turn", "pair", "side")
    return window.complete_pairs(kept, ["conv_id"])


@query("w11_first_of_key", """
SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id,
       doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) AS is_duplicate FROM documents""")
def first_of_key(t):
    df = t.documents.select("doc_id", F.md5("text").alias("body"))
    return window.flag_repeats(df, "body", "doc_id").drop("body")


@query("w12_first_by_priority", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
       arg_min(event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END) AS event_type
FROM events WHERE event_type IN ('purchase', 'signup', 'click') GROUP BY 1, 2""")
def first_by_priority(t):
    df = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return window.first_by_priority(df, ["user_id", "day"], "event_type", ["purchase", "signup", "click"])


@query("o1_top_items", f"""
WITH {TOKENS} SELECT word, count(DISTINCT doc_id)::BIGINT AS n FROM tokens GROUP BY word ORDER BY n DESC, word LIMIT 10""")
def top_items(t):
    distinct = tokens(t).select("doc_id", "word").distinct()
    return agg.item_counts(distinct, "word").orderBy(F.desc("n"), "word").limit(10)


@query("o2_full_ranking", """
WITH s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[],
             (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings)
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id DESC) AS place FROM s""")
def full_ranking(t):
    probe = F.lit(t.embeddings.orderBy("vec_id").select(doubles("embedding")).first()[0])
    scored = t.embeddings.select("vec_id", F.round(dot(doubles("embedding"), probe), 6).alias("score"))
    return row_numbers(scored, [F.desc("score"), F.desc("vec_id")], out="place")


@query("o3_natural_sort", r"""
SELECT c_name, row_number() OVER (ORDER BY regexp_extract(c_name, '(\d+)', 1)::BIGINT DESC, c_name) AS place FROM customer""")
def natural_sort(t):
    return row_numbers(t.customer.select("c_name"), [window.natural_number("c_name").desc(), F.col("c_name")], out="place")


@query("o4_seeded_shuffle", """
SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY md5('shuffle:' || o_orderkey), o_orderkey) AS place
FROM orders""")
def seeded_shuffle(t):
    return window.shuffled(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], "shuffle")


@query("o5_random_sample", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('sample:' || o_orderkey), o_orderkey LIMIT 100""")
def random_sample(t):
    return t.orders.orderBy(hash_hex("sample", "o_orderkey"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("o5_sample_fraction", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('frac:' || o_orderkey), o_orderkey) AS rk, count(*) OVER () AS n
           FROM orders)
SELECT o_orderkey, o_totalprice FROM r WHERE rk <= round(0.8 * n)""")
def sample_fraction(t):
    return window.sample_fraction(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.8, "frac")


@query("o6_top_label_share", """
WITH c AS (SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY p_type),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS rn, count(*) OVER () AS k FROM c)
SELECT p_type, n, rn FROM r WHERE rn <= floor(0.8 * k)""")
def top_label_share(t):
    return window.top_label_share(t.part, "p_type", 0.8)


@query("o7_time_order", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events""")
def time_order(t):
    return row_numbers(t.events.select("event_id", "ts"), ["ts", "event_id"], out="place").drop("ts")
