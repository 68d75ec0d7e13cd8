"""Scalar functions (X1-X15) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import scalar as sc, text as tx
from loomframe.functions.hashing import hash_hex
from loomframe.functions.vectors import doubles
from loomframe.operators import state
from loomframe.queries.sql import WORDS, h
from loomframe.registry import query


@query("x1_lower_trim", "SELECT doc_id, md5(lower(trim(text))) AS body, lower(trim(lang)) AS lang FROM documents")
def lower_trim(t):
    return t.documents.select("doc_id", F.md5(F.lower(F.trim("text"))).alias("body"), F.lower(F.trim("lang")).alias("lang"))


CLEAN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '^xxxx', ''),
  ' \p{Nd}+', ' ', 'g')"""


@query("x2_regex_clean", f"""
SELECT doc_id, md5(regexp_replace({CLEAN_SQL}, '\\s\\s+', ' ', 'g')) AS body FROM documents""")
def regex_clean(t):
    return t.documents.select("doc_id", F.md5(tx.squeeze(tx.strip_noise(F.col("text")))).alias("body"))


@query("x3_split_columns", """
SELECT p_partkey, split_part(p_brand, '#', 1) AS maker, split_part(p_brand, '#', 2)::INT AS number FROM part""")
def split_columns(t):
    maker, number = sc.split_parts("p_brand", "#", ["maker", "number"])
    return t.part.select("p_partkey", maker, number.cast("int").alias("number"))


@query("x4_padded_entries", """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part), m AS (SELECT max(len(ws))::INT AS longest FROM w),
p AS (SELECT p_partkey, ws, longest, unnest(range(longest)) AS pos FROM w, m)
SELECT p_partkey, pos::INT AS pos, coalesce(ws[pos + 1], '') AS word, longest FROM p""")
def padded_entries(t):
    words = F.split("p_name", " ")
    longest = t.part.agg(F.max(F.size(words)).alias("m")).scalar()
    wide = t.part.select("p_partkey", words.alias("ws"), longest.alias("longest"))
    wide = wide.withColumn("ws", sc.padded_list(F.col("ws"), F.col("longest")))
    return wide.select("p_partkey", "longest", F.posexplode("ws").alias("pos", "word"))


@query("x5_url_parts", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root,
                  regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+', '') AS path FROM pages),
n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS file FROM u)
SELECT page_id, root, path, split_part(file, '.', 1) AS stem, split_part(file, '.', 2) AS extension FROM n""")
def url_parts(t):
    return t.pages.select(
        "page_id",
        sc.site_root("url").alias("root"),
        sc.url_path("url").alias("path"),
        sc.file_stem("url").alias("stem"),
        sc.file_extension("url").alias("extension"),
    )


@query("x6_name_numbers", r"""
SELECT c_custkey, regexp_extract(c_name, '(\d+)', 1)::BIGINT AS number,
       CASE WHEN c_nationkey < 10 THEN lpad(c_nationkey::VARCHAR, 2, '0') ELSE c_nationkey::VARCHAR END AS nation,
       c_nationkey AS part_no FROM customer""")
def name_numbers(t):
    from loomframe.operators.window import natural_number

    label = F.concat(F.lit("sample-"), F.col("c_nationkey"), F.lit("-1"))
    return t.customer.select(
        "c_custkey",
        natural_number("c_name").alias("number"),
        sc.two_digits(F.col("c_nationkey")).alias("nation"),
        sc.name_number(label).alias("part_no"),
    )


@query("x7_is_numeric", r"""
WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN event_type || event_id
                                 WHEN event_type = 'view' THEN event_id || '.5' WHEN event_type = 'click' THEN event_id || '.5.1'
                                 ELSE json_extract_string(props, '$.k') END AS txt FROM events)
SELECT event_id, txt, regexp_matches(txt, '^[0-9]*\.?[0-9]*$') AND regexp_matches(txt, '[0-9]') AS is_number FROM s""")
def is_numeric(t):
    kind, eid = F.col("event_type"), F.col("event_id").cast("string")
    txt = (
        F.when(kind == "error", F.concat(kind, eid))
        .when(kind == "view", F.concat(eid, F.lit(".5")))
        .when(kind == "click", F.concat(eid, F.lit(".5.1")))
        .otherwise(F.get_json_object("props", "$.k"))
    )
    return t.events.select("event_id", txt.alias("txt")).withColumn("is_number", sc.is_numeric("txt"))


@query("x8_join_tokens", f"SELECT doc_id, md5(array_to_string({WORDS}, ', ')) AS joined FROM documents")
def join_tokens(t):
    return t.documents.select("doc_id", F.md5(F.array_join(tx.words("text"), ", ")).alias("joined"))


@query("x9_hex_bytes", """
SELECT vec_id, string_agg(printf('%02x', (128 + floor(v * 100))::INT), '' ORDER BY i) AS hex
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id""")
def hex_bytes(t):
    cells = F.transform(doubles("embedding"), lambda v: F.lpad(F.hex((F.floor(v * 100) + 128).cast("int")), 2, "0"))
    return t.embeddings.select("vec_id", sc.hex_bytes(F.unhex(F.array_join(cells, ""))).alias("hex"))


@query("x10_number_format", """
SELECT quality, toxic, printf('%.2f%%', count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labels)) AS share,
       printf('%.3f', avg(doc_id)) AS mean_id FROM labels GROUP BY 1, 2""")
def number_format(t):
    total = t.labels.agg(F.count(F.lit(1)).alias("n")).scalar()
    return t.labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.avg("doc_id").alias("m")).select(
        "quality", "toxic", sc.percent_text(F.col("n") / total).alias("share"), F.format_string("%.3f", "m").alias("mean_id")
    )


@query("x11_date_parts", """
SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS year, strftime(o_orderdate, '%H-%M-%S-%b-%d-%Y') AS suffix
FROM orders""")
def date_parts(t):
    return t.orders.select(
        "o_orderkey",
        sc.year_prefix(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"),
        F.date_format("o_orderdate", "HH-mm-ss-MMM-dd-yyyy").alias("suffix"),
    )


@query("x12_math", """
SELECT o_orderkey, ceil(o_totalprice * 0.8::DOUBLE)::BIGINT AS up, round(sqrt(o_totalprice), 6) AS root,
       round(abs(o_totalprice - 200000), 4) AS gap, least(greatest(o_totalprice, 50000), 400000) AS clamped,
       (CASE WHEN o_totalprice >= 200000 THEN 0 ELSE 1 END)::INT AS arg, floor(o_orderkey / 2)::BIGINT AS half
FROM orders""")
def math(t):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.ceil(price * 0.8).alias("up"),
        F.round(F.sqrt(price), 6).alias("root"),
        F.round(F.abs(price - 200000), 4).alias("gap"),
        F.least(F.greatest(price, F.lit(50000.0)), F.lit(400000.0)).alias("clamped"),
        sc.argmax(F.array(price, F.lit(400000.0) - price)).cast("int").alias("arg"),
        F.floor(F.col("o_orderkey") / 2).alias("half"),
    )


@query("x13_array_ops", f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents)
SELECT doc_id, md5(array_to_string(list_sort(list_transform(ws, lambda w: md5('mix:' || w))), '')) AS mixed,
       array_to_string(list_slice(ws, 2, 4), '|') AS middle, len(ws)::INT AS n,
       list_sum(list_transform(ws, lambda w: length(w)))::BIGINT AS letters FROM d WHERE len(ws) > 0""")
def array_ops(t):
    df = t.documents.select("doc_id", tx.words("text").alias("ws")).filter(F.size("ws") > 0)
    lengths = F.transform("ws", lambda w: F.length(w).cast("bigint"))
    return df.select(
        "doc_id",
        F.md5(F.array_join(F.array_sort(F.transform("ws", lambda w: F.md5(F.concat(F.lit("mix:"), w)))), "")).alias("mixed"),
        F.array_join(F.slice("ws", 2, 3), "|").alias("middle"),
        F.size("ws").alias("n"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("letters"),
    )


@query("x13_element_sum", """
SELECT label, i AS dim, round(sum(v), 5) AS total
FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::INT AS i FROM embeddings) GROUP BY 1, 2""")
def element_sum(t):
    from loomframe.functions.vectors import sum_vectors

    sums = sum_vectors(t.embeddings, ["label"], "embedding")
    cells = sums.select("label", F.posexplode("vector").alias("pos", "v"))
    return cells.select("label", (F.col("pos") + 1).alias("dim"), F.round("v", 5).alias("total"))


@query("x14_constant_lookup", """
SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 4 THEN 1 ELSE 0 END AS code FROM nation""")
def constant_lookup(t):
    return t.nation.select("n_nationkey", sc.lookup_constant("n_regionkey", {1: 1, 2: -1, 4: 1}, 0).alias("code"))


@query("x15_parse_json", """
SELECT event_id, json_extract_string(props, '$.k')::INT AS k, 'k=' || lower(event_type) AS tag FROM events""")
def parse_json(t):
    cell = F.concat(F.lit('[{"name":"'), F.upper("event_type"), F.lit('"}]'))
    named = F.transform(F.from_json(cell, "array<struct<name:string>>"), lambda x: F.concat(F.lit("k="), F.lower(x["name"])))
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.element_at(named, 1).alias("tag"))


@query("u1_union_all", """
SELECT c_name AS name, c_acctbal AS balance, 'customer' AS kind FROM customer
UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier""")
def union_all(t):
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    b = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b)


@query("u2_intersect", """
SELECT md5(text) AS body FROM documents WHERE lang = 'en' INTERSECT SELECT md5(text) FROM documents WHERE source IN ('src0', 'src1', 'src2')""")
def intersect(t):
    docs = t.documents.select("lang", "source", F.md5("text").alias("body"))
    held_out = docs.filter(F.col("source").isin("src0", "src1", "src2"))
    return docs.filter("lang = 'en'").select("body").intersect(held_out.select("body"))


@query("u3_row_difference", f"""
SELECT doc_id, array_to_string(list_filter(range(1, 13), lambda n: NOT list_contains(list_transform({WORDS}, lambda w: length(w)), n)), ',') AS absent
FROM documents""")
def row_difference(t):
    lengths = F.transform(tx.words("text"), lambda w: F.length(w))
    absent = F.array_except(F.sequence(F.lit(1), F.lit(12)), lengths)
    return t.documents.select("doc_id", F.array_join(F.transform(absent, lambda n: n.cast("string")), ",").alias("absent"))


@query("u4_distinct", f"""
SELECT doc_id, len(list_distinct({WORDS}))::INT AS n_distinct,
       (SELECT count(DISTINCT w) FROM (SELECT unnest({WORDS}) AS w FROM documents))::BIGINT AS corpus FROM documents""")
def distinct(t):
    corpus = t.documents.select(F.explode(tx.words("text")).alias("w")).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return t.documents.select("doc_id", F.size(F.array_distinct(tx.words("text"))).alias("n_distinct"), corpus.alias("corpus"))


@query("u5_same_rows", """
SELECT 'reordered' AS comparison, TRUE AS same UNION ALL
SELECT 'filtered', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') = (SELECT count(*) FROM orders)""")
def same_rows(t):
    again = t.orders.orderBy(F.desc("o_totalprice"))
    out = state.same_rows(t.orders, again).select(F.lit("reordered").alias("comparison"), "same")
    return out.unionByName(
        state.same_rows(t.orders, t.orders.filter("o_orderstatus <> 'F'")).select(F.lit("filtered").alias("comparison"), "same")
    )
