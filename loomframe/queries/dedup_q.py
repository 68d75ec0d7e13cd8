"""De-duplication and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions.vectors import doubles
from loomframe.operators import dedup, pairs, similarity as sim
from loomframe.plans.checkpoints import materialize
from loomframe.queries.sql import WORDS, h
from loomframe.registry import query

BITS = """
el AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
md AS (SELECT vec_id, median(v) AS m FROM el GROUP BY vec_id),
nb AS (SELECT vec_id, (i - 1) // 4 AS nibble, sum(CASE WHEN v >= m THEN pow(2, 3 - (i - 1) % 4) ELSE 0 END)::INT AS d
       FROM el JOIN md USING (vec_id) GROUP BY 1, 2),
bits AS (SELECT vec_id, string_agg(printf('%x', d), '' ORDER BY nibble) AS key FROM nb GROUP BY vec_id)"""

# Near keys: at most 3 of 16 digits differ.
NEAR = f"""{BITS},
f AS (SELECT vec_id, key, min(vec_id) OVER (PARTITION BY key) AS first_id FROM bits),
uq AS (SELECT vec_id, key FROM f WHERE vec_id = first_id),
src AS (SELECT b.vec_id AS id, min(a.vec_id) AS source FROM uq a JOIN uq b ON a.vec_id < b.vec_id AND hamming(a.key, b.key) <= 3 GROUP BY 1)"""


# The same over documents: the vector counts the words in 64 hashed cells.
NEAR_DOCS = f"""
tk AS (SELECT doc_id, {h('w')} % 64 AS b, count(*) AS n FROM (SELECT doc_id, unnest({WORDS}) AS w FROM documents) GROUP BY 1, 2),
g AS (SELECT doc_id, b, coalesce(n, 0) AS n FROM (SELECT doc_id, unnest(range(64)) AS b FROM documents) LEFT JOIN tk USING (doc_id, b)),
md AS (SELECT doc_id, median(n) AS m FROM g GROUP BY 1),
nb AS (SELECT doc_id, b // 4 AS nibble, sum(CASE WHEN n >= m THEN pow(2, 3 - b % 4) ELSE 0 END)::INT AS d FROM g JOIN md USING (doc_id) GROUP BY 1, 2),
bits AS (SELECT doc_id, string_agg(printf('%x', d), '' ORDER BY nibble) AS key FROM nb GROUP BY 1),
f AS (SELECT doc_id, key, min(doc_id) OVER (PARTITION BY key) AS first_id FROM bits),
uq AS (SELECT doc_id, key FROM f WHERE doc_id = first_id),
src AS (SELECT b.doc_id AS id, min(a.doc_id) AS source FROM uq a JOIN uq b ON a.doc_id < b.doc_id AND hamming(a.key, b.key) <= 3 GROUP BY 1)"""


#: Keys of 64 digits, of which 10 may differ; short texts share most digits and fill a few large buckets.
NEAR_WIDE = NEAR_DOCS.replace("% 64", "% 256").replace("range(64)", "range(256)").replace("<= 3", "<= 10")


def document_bits(t, bits=64):
    return dedup.word_histogram(t.documents, "doc_id", "text", bits).select(
        "doc_id", dedup.median_bits("vector", bits).alias("key")
    )


def bits(t):
    return t.embeddings.select("vec_id", dedup.median_bits("embedding", 64).alias("key"))


@query("d1_fingerprints", f"WITH {BITS} SELECT vec_id, key FROM bits")
def fingerprints(t):
    return bits(t)


@query("d2_exact_duplicates", """
WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents)
SELECT count(*) FILTER (WHERE doc_id = first_id)::BIGINT AS valid, count(*) FILTER (WHERE doc_id <> first_id)::BIGINT AS duplicates,
       round((count(*) FILTER (WHERE doc_id = first_id))::DOUBLE / count(*), 6) AS valid_rate,
       round((count(*) FILTER (WHERE doc_id <> first_id))::DOUBLE / count(*), 6) AS duplicate_rate FROM f""")
def exact_duplicates(t):
    flagged = dedup.exact_duplicates(t.documents.select("doc_id", F.md5("text").alias("body")), "body", "doc_id")
    return dedup.duplicate_rates(flagged).withColumns({c: F.round(c, 6) for c in ("valid_rate", "duplicate_rate")})


@query("j7_near_matches", f"""
WITH {NEAR} SELECT id, source, hamming(x.key, y.key)::INT AS distance FROM src JOIN uq x ON x.vec_id = id JOIN uq y ON y.vec_id = source""")
def near_matches(t):
    keys = dedup.exact_duplicates(bits(t), "key", "vec_id").filter("NOT is_duplicate").select("vec_id", "key")
    return dedup.with_source_distance(dedup.near_sources(keys, "key", "vec_id", 16, 3), keys, "key", "vec_id")


@query("d3_near_duplicates", f"""
WITH {NEAR} SELECT f.vec_id AS vec_id, first_id, coalesce(source, first_id) AS source_id FROM f LEFT JOIN src ON id = first_id""")
def near_duplicates(t):
    return dedup.near_duplicates(bits(t), "key", "vec_id", 16, 3).select("vec_id", "first_id", "source_id")


@query("j7_near_documents", f"""
WITH {NEAR_DOCS} SELECT id, source, hamming(x.key, y.key)::INT AS distance FROM src JOIN uq x ON x.doc_id = id JOIN uq y ON y.doc_id = source""")
def near_document_matches(t):
    flagged = dedup.exact_duplicates(document_bits(t), "key", "doc_id")
    keys = materialize(flagged.filter("NOT is_duplicate").select("doc_id", "key"))
    return dedup.with_source_distance(dedup.near_sources(keys, "key", "doc_id", 16, 3), keys, "key", "doc_id")


@query("d3_near_documents", f"""
WITH {NEAR_DOCS} SELECT f.doc_id AS doc_id, first_id, coalesce(source, first_id) AS source_id FROM f LEFT JOIN src ON id = first_id""")
def near_documents(t):
    return dedup.near_duplicates(materialize(document_bits(t)), "key", "doc_id", 16, 3).select("doc_id", "first_id", "source_id")


@query("j7_near_wide_keys", f"""
WITH {NEAR_WIDE} SELECT id, source, hamming(x.key, y.key)::INT AS distance FROM src JOIN uq x ON x.doc_id = id JOIN uq y ON y.doc_id = source""")
def near_wide_matches(t):
    flagged = dedup.exact_duplicates(document_bits(t, 256), "key", "doc_id")
    keys = materialize(flagged.filter("NOT is_duplicate").select("doc_id", "key"))
    return dedup.with_source_distance(dedup.near_sources(keys, "key", "doc_id", 64, 10), keys, "key", "doc_id")


@query("d3_near_wide_keys", f"""
WITH {NEAR_WIDE} SELECT f.doc_id AS doc_id, first_id, coalesce(source, first_id) AS source_id FROM f LEFT JOIN src ON id = first_id""")
def near_wide(t):
    return dedup.near_duplicates(materialize(document_bits(t, 256)), "key", "doc_id", 64, 10).select("doc_id", "first_id", "source_id")


@query("d4_compact_numbers", """
WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM f WHERE doc_id = first_id""")
def compact_numbers(t):
    flagged = dedup.exact_duplicates(t.documents.select("doc_id", F.md5("text").alias("body")), "body", "doc_id")
    return dedup.compact_numbers(flagged.filter("NOT is_duplicate").select("doc_id"), "doc_id")


@query("d5_normalize", """
SELECT vec_id, i::INT AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS x
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def normalize(t):
    unit = sim.normalized(t.embeddings, "embedding")
    cells = unit.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return cells.select("vec_id", (F.col("pos") + 1).alias("dim"), F.round("v", 6).alias("x"))


_SCORES = """
q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7),
s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], e) AS score FROM embeddings, q)"""


@query("d6_most_similar", f"""
WITH {_SCORES} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10""")
def most_similar(t):
    return sim.find_similar(t.embeddings, "vec_id", "embedding", 7, 10).withColumn("score", F.round("score", 6))


@query("d6_least_similar", f"""
WITH {_SCORES} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score, vec_id DESC LIMIT 10""")
def least_similar(t):
    return sim.find_similar(t.embeddings, "vec_id", "embedding", 7, 10, least=True).withColumn("score", F.round("score", 6))


@query("d7_tag_query", """
WITH el AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
tg AS (SELECT label, i, sum(v) AS v FROM el GROUP BY 1, 2),
qs AS (SELECT i, sum(v) AS v FROM (SELECT i, v FROM tg WHERE label IN (3, 5) UNION ALL SELECT i, v FROM tg WHERE label = 0) GROUP BY i),
qn AS (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM qs) AS v FROM qs)
SELECT vec_id, round(sum(el.v * qn.v), 6) AS score FROM el JOIN qn USING (i) GROUP BY vec_id""")
def tag_query(t):
    from loomframe.functions.vectors import sum_vectors

    tags = sum_vectors(t.embeddings, ["label"], "embedding")
    scored = sim.tag_query(t.embeddings, "vec_id", "embedding", tags, "label", "vector", [3, 5], 3)
    return scored.withColumn("score", F.round("score", 6))


_PAIRS = """
m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('pos:' || vec_id), vec_id) AS pos FROM embeddings),
pp AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, 1 AS target FROM m a JOIN m b ON a.label = b.label AND b.pos = a.pos + 1
       WHERE a.pos % 2 = 1),
pv AS (SELECT a_id, b_id, target, x.embedding::DOUBLE[] AS va, y.embedding::DOUBLE[] AS vb FROM pp
       JOIN embeddings x ON x.vec_id = a_id JOIN embeddings y ON y.vec_id = b_id),
ds AS (SELECT a_id, b_id, target, sqrt(greatest(pow(list_distance(va, vb), 2), 1e-7)) AS euclid, list_cosine_similarity(va, vb) AS cosine FROM pv),
sc AS (SELECT *, (1 / (1 + exp(-(1.5 - euclid)))) * (exp(0.2) / (exp(0.2) + exp(0.7)))
               + (1 / (1 + exp(-cosine))) * (exp(0.7) / (exp(0.2) + exp(0.7))) AS mix FROM ds)"""


def _distances(t):
    chosen = pairs.paired_members(t.embeddings, "label", "vec_id", "pos").select("a_id", "b_id", F.lit(1).alias("target"))
    df = sim.pair_vectors(chosen, t.embeddings, "vec_id", "embedding")
    df = df.withColumns({"euclid": sim.euclidean(F.col("va"), F.col("vb")), "cosine": sim.cosine(F.col("va"), F.col("vb"))})
    mix = sim.weighted_mix(sim.sigmoid(F.lit(1.5) - F.col("euclid")), sim.sigmoid(F.col("cosine")), (0.2, 0.7))
    return df.drop("va", "vb").withColumn("mix", mix)


@query("d9_pair_distances", f"""
WITH {_PAIRS} SELECT a_id, b_id, round(euclid, 6) AS euclid, round(cosine, 6) AS cosine, round(mix, 6) AS mix FROM sc""")
def pair_distances(t):
    return _distances(t).drop("target").withColumns({c: F.round(c, 6) for c in ("euclid", "cosine", "mix")})


@query("d10_pair_decisions", f"""
WITH {_PAIRS} SELECT a_id, b_id, (mix >= 0.5)::INT AS decision, (mix < 0.5) AS is_mismatch FROM sc""")
def pair_decisions(t):
    return _distances(t).withColumns(sim.decide(F.col("mix"), F.col("target"))).select("a_id", "b_id", "decision", "is_mismatch")
