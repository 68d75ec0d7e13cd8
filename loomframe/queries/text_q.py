"""Text features (F18-F20) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions.hashing import hash_hex
from loomframe.functions.text import clean_document
from loomframe.operators import text
from loomframe.queries.frames import STOP_WORDS
from loomframe.queries.scalar_q import CLEAN_SQL
from loomframe.registry import query

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
CLEAN_TOKENS = rf"""list_filter(string_split(trim(regexp_replace({CLEAN_SQL}, '\s+', ' ', 'g')), ' '),
  lambda w: w <> '' AND NOT list_contains([{_STOPS}], w))"""


@query("entry_top_words", f"""
WITH w AS (SELECT quality, unnest({CLEAN_TOKENS}) AS word FROM documents JOIN labels USING (doc_id)),
c AS (SELECT quality, word, count(*)::BIGINT AS n FROM w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, word) AS rn FROM c)
SELECT quality, word, n, rn FROM r WHERE rn <= 10""")
def entry_top_words(t):
    cleaned = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id").select(
        "quality", clean_document(F.col("text"), STOP_WORDS).alias("cleaned")
    )
    return text.top_words(cleaned, "quality", "cleaned", 10)


@query("f18_clean_documents", f"SELECT doc_id, md5(array_to_string({CLEAN_TOKENS}, ' ')) AS cleaned FROM documents")
def clean_documents(t):
    return t.documents.select("doc_id", F.md5(clean_document(F.col("text"), STOP_WORDS)).alias("cleaned"))


_TRAIN = "substr(md5('split:' || doc_id), 1, 1) < 'd'"


def _tfidf_sql(min_df: str, tf: str) -> str:
    return f"""
WITH w AS (SELECT doc_id, {_TRAIN} AS train, unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) AS term FROM documents),
c AS (SELECT doc_id, train, term, count(*) AS tf FROM w GROUP BY 1, 2, 3),
n AS (SELECT count(*)::DOUBLE AS n FROM documents WHERE {_TRAIN}),
v AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM c, n WHERE train GROUP BY term, n HAVING count(*) >= {min_df}),
r AS (SELECT doc_id, term, {tf} * idf AS raw FROM c JOIN v USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r"""


def _tfidf(t, min_df, sublinear: bool):
    in_train = F.substring(hash_hex("split", "doc_id"), 1, 1) < "d"
    counts = text.term_counts(t.documents, "doc_id", "text")  # cut twice: stored, a row a term is many times the text
    vocabulary = text.fit_vocabulary(counts.filter(in_train), t.documents.filter(in_train).count(), min_df)
    weights = text.tf_idf(counts, vocabulary, "doc_id", sublinear)
    return weights.withColumn("weight", F.round("weight", 6))


@query("f19_tf_idf", _tfidf_sql("0.02::DOUBLE * n", "tf"))
def tf_idf(t):
    return _tfidf(t, 0.02, False)


@query("f19_tf_idf_sublinear", _tfidf_sql("5", "(1 + ln(tf))"))
def tf_idf_sublinear(t):
    return _tfidf(t, 5, True)


@query("f20_code_bag", """
WITH p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS label, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos
           FROM part),
d AS (SELECT label, row_number() OVER (ORDER BY min(p_partkey * 100 + pos)) AS code FROM p GROUP BY label)
SELECT p_partkey, coalesce(max(CASE WHEN pos = 0 THEN code END), 0)::BIGINT AS code_1,
       coalesce(max(CASE WHEN pos = 1 THEN code END), 0)::BIGINT AS code_2 FROM p JOIN d USING (label) GROUP BY p_partkey""")
def code_bag(t):
    dictionary = text.label_codes(t.part, "p_partkey", "p_name", " ")
    return text.code_bag(t.part, "p_partkey", "p_name", dictionary, text.longest_list(t.part, "p_name", " "), " ")
