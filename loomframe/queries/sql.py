"""SQL fragments and fixed parameters shared by the oracle strings."""

# Bounded hash of a string expression: first eight hex digits of md5.
def h(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

# One row per word with its 0-based position.
TOKENS = f"""tokens AS (
  SELECT doc_id, lang, source, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
  FROM (SELECT doc_id, lang, source, {WORDS} AS ws FROM documents))"""

CUST_NULLS = """cust_nulls AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""

LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def line_hash(seed: str) -> str:
    return f"md5('{seed}:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber)"


HOURLY = """hourly AS (
  SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts))::BIGINT AS hour_no,
         count(*)::BIGINT AS n
  FROM events GROUP BY 1, 2)"""

PREDS = f"""preds AS (
  SELECT doc_id, quality, toxic, score, score_q, (score > 0.5)::INT AS pred, (score_q > 0.5)::INT AS pred_q
  FROM (SELECT doc_id, quality, toxic,
               ({h("'p:' || doc_id")} % 1000) / 1000.0::DOUBLE * 0.6::DOUBLE + 0.4::DOUBLE * quality AS score,
               ({h("'q:' || doc_id")} % 1000) / 1000.0::DOUBLE * 0.6::DOUBLE + 0.4::DOUBLE * quality AS score_q
        FROM labels))"""
