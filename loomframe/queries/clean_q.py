"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import clean
from loomframe.plans.quantiles import unpivot
from loomframe.queries.frames import LINE_KEY, STOP_WORDS, cust_nulls, tokens
from loomframe.queries.sql import CUST_NULLS, LINE_KEY as KEY_SQL, TOKENS, h, line_hash
from loomframe.registry import query


@query("p1_replace_value", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END AS status FROM orders""")
def replace_value(t):
    return t.orders.select("o_orderkey", clean.replace_value("o_orderstatus", "P", "PENDING").alias("status"))


@query("p2_null_category", f"""
WITH {CUST_NULLS}
SELECT c_custkey, coalesce(c_mktsegment, 'NA-c_mktsegment') AS c_mktsegment,
       CASE WHEN c_acctbal > 0 THEN 'in_credit-TRUE' WHEN c_acctbal <= 0 THEN 'in_credit-FALSE'
            ELSE 'NA-in_credit' END AS in_credit
FROM cust_nulls""")
def null_category(t):
    df = cust_nulls(t).select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("in_credit"))
    return clean.null_category(df, ["c_mktsegment", "in_credit"])


@query("p3_label_encode", """
SELECT doc_id, (quality = 1 AND toxic = 0)::INT AS good, (quality = 1) AS quality_flag FROM labels""")
def label_encode(t):
    df = t.labels.withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    return df.select("doc_id", clean.encode_bool("good").alias("good"), clean.decode_bool("quality").alias("quality_flag"))


@query("p4_drop_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def drop_columns(t):
    return t.lineitem.drop("l_returnflag", "l_linestatus", "l_shipdate")


@query("p5_column_range", """
SELECT l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem""")
def column_range(t):
    by_name = clean.column_range(t.lineitem, "l_suppkey", "l_discount")
    return clean.column_range(by_name, 1)


@query("p6_drop_nulls", f"""
WITH {CUST_NULLS} SELECT * FROM cust_nulls WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def drop_nulls(t):
    return cust_nulls(t).dropna()


@query("p7_map_values", """
SELECT n_nationkey, n_name,
       CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' END AS side,
       CASE n_name WHEN 'NATION_0' THEN 'first' WHEN 'NATION_24' THEN 'last' ELSE n_name END AS renamed
FROM nation""")
def map_values(t):
    return t.nation.select(
        "n_nationkey",
        "n_name",
        clean.map_values("n_regionkey", {0: "south", 1: "west", 2: "east"}, keep_unmapped=False).alias("side"),
        clean.map_values("n_name", {"NATION_0": "first", "NATION_24": "last"}, keep_unmapped=True).alias("renamed"),
    )


@query("p8_substring_split", """
SELECT doc_id, CASE WHEN contains(text, 'the ') THEN 'removed' ELSE 'kept' END AS part FROM documents""")
def substring_split(t):
    kept, removed = clean.split_on_substring(t.documents, "text", "the ")
    return kept.select("doc_id", F.lit("kept").alias("part")).unionByName(
        removed.select("doc_id", F.lit("removed").alias("part"))
    )


@query("p9_exclude_classes", """
SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup')""")
def exclude_classes(t):
    return clean.exclude_values(t.events, "event_type", ["error", "signup"]).select("event_id", "event_type")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("p10_frequent_terms", f"""
WITH {TOKENS}
SELECT word, count(*)::BIGINT AS n FROM (SELECT DISTINCT doc_id, word FROM tokens)
WHERE word NOT IN ({_STOP_SQL}) GROUP BY word HAVING count(*) >= 4""")
def frequent_terms(t):
    distinct = tokens(t).select("doc_id", "word").distinct()
    return clean.frequent_terms(distinct, "word", 4, STOP_WORDS)


@query("p11_inject_nulls", f"""
WITH r AS (
  SELECT *, row_number() OVER (ORDER BY {line_hash('null')}, {KEY_SQL}) AS rk,
         ('0x' || substr({line_hash('null-col')}, 1, 8))::BIGINT % 3 AS col_no, count(*) OVER () AS n
  FROM lineitem)
SELECT {KEY_SQL},
       CASE WHEN rk <= round(0.1 * n) AND col_no = 0 THEN NULL ELSE l_quantity END AS l_quantity,
       CASE WHEN rk <= round(0.1 * n) AND col_no = 1 THEN NULL ELSE l_discount END AS l_discount,
       CASE WHEN rk <= round(0.1 * n) AND col_no = 2 THEN NULL ELSE l_tax END AS l_tax
FROM r""")
def inject_nulls(t):
    df = t.lineitem.select(*LINE_KEY, "l_quantity", "l_discount", "l_tax")
    return clean.inject_nulls(df, LINE_KEY, ["l_quantity", "l_discount", "l_tax"], 0.10, "null")


_P12 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_P12_CORR = ", ".join(f"{{'feature': '{c}', 'r': corr({c}, l_extendedprice * (1 - l_discount))}}" for c in _P12)
_P12_LONG = ", ".join(f"{{'feature': '{c}', 'value': {c}}}" for c in _P12)


@query("p12_correlated_columns", f"""
WITH c AS (SELECT unnest([{_P12_CORR}]) AS s FROM lineitem),
     long AS (SELECT {KEY_SQL}, unnest([{_P12_LONG}]) AS v FROM lineitem)
SELECT {KEY_SQL}, v.feature AS feature, v.value AS value FROM long JOIN c ON v.feature = s.feature
WHERE abs(s.r) >= 0.02""")
def correlated_columns(t):
    df = t.lineitem.withColumn("net_price", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    kept = clean.correlated_columns(df, "net_price", _P12, 0.02)
    return unpivot(df, kept, LINE_KEY)


@query("p13_rename_prefix", """
SELECT p_partkey AS part_id, p_name AS title, p_size AS feature_p_size, p_retailprice AS feature_p_retailprice,
       0 AS code_1, 0 AS code_2 FROM part""")
def rename_prefix(t):
    df = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice").withColumnsRenamed(
        {"p_partkey": "part_id", "p_name": "title"}
    )
    return clean.prefix_columns(df, "feature_", ["p_size", "p_retailprice"]).withColumns(
        {"code_1": F.lit(0), "code_2": F.lit(0)}
    )


@query("p14_first_entries", r"""
SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines,
       array_to_string(list_slice(string_split(text, chr(10)), 1, 3), ' | ') AS head FROM documents""")
def first_entries(t):
    lines = F.split("text", "\n")
    return t.documents.select(
        "doc_id", F.size(lines).alias("n_lines"), F.array_join(clean.first_entries(lines, 3), " | ").alias("head")
    )


@query("p15_pick_nested", """
WITH c AS (SELECT conv_id, turn, lower(md5(coalesce(text, ''))) AS name, CASE role WHEN 'system' THEN 'director' WHEN 'assistant' THEN 'producer' ELSE 'other' END AS job,
                  CASE WHEN role = 'user' THEN 'writing' ELSE 'crew' END AS department FROM conversations)
SELECT conv_id, max_by(name, turn) FILTER (job = 'director') AS director, max_by(name, turn) FILTER (job = 'producer' AND department <> 'writing') AS producer,
       array_to_string(coalesce(list_slice(list(name ORDER BY turn) FILTER (department = 'writing' AND job <> 'director'), 1, 3), []), ',') AS writers
FROM c GROUP BY conv_id""")
def pick_nested(t):
    """Turns as a crew: system messages direct, assistants produce, users write."""
    job = F.when(F.col("role") == "system", "Director").when(F.col("role") == "assistant", "Producer").otherwise("Other")
    department = F.when(F.col("role") == "user", "Writing").otherwise("Crew")
    member = F.struct("turn", F.upper(F.md5(F.coalesce("text", F.lit("")))).alias("name"), job.alias("job"), department.alias("department"))
    crews = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(member)).alias("crew"))
    picked = crews.select("conv_id", *[c.alias(name) for name, c in clean.pick_crew(F.col("crew")).items()])
    return picked.withColumn("writers", F.array_join("writers", ","))


@query("p16_two_level_and_ratio", f"""
SELECT {KEY_SQL}, CASE WHEN l_quantity >= 25 THEN 255 ELSE 0 END AS level FROM lineitem
WHERE abs(0.7::DOUBLE - l_discount / l_tax) < 0.1 AND l_tax > 0""")
def two_level_and_ratio(t):
    df = t.lineitem.filter(F.col("l_tax") > 0)
    return df.filter(clean.near_ratio(F.col("l_discount"), F.col("l_tax"), 0.7, 0.1)).select(
        *LINE_KEY, clean.two_level(F.col("l_quantity"), 25).alias("level")
    )
