"""Joins (J1-J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions.hashing import hash_hex
from loomframe.functions.text import explode_words
from loomframe.operators import aggregate as agg, lookup, pairs, window
from loomframe.plans.checkpoints import materialize
from loomframe.plans.lookups import frequent, whole_key, without_frequent
from loomframe.queries.frames import LINE_KEY, hour_number, hourly, tokens
from loomframe.queries.sql import HOURLY, LINE_KEY as KEY_SQL, TOKENS, h
from loomframe.registry import query


@query("j1_equi_lookup", """
SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def equi_lookup(t):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return t.orders.select("o_orderkey", "o_custkey").join(customers, "o_custkey")


@query("j2_encode_decode", f"""
WITH {TOKENS},
dict AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS code FROM (SELECT DISTINCT word FROM tokens)),
coded AS (SELECT doc_id, pos, code FROM tokens JOIN dict USING (word))
SELECT doc_id, count(*)::BIGINT AS n, sum(code)::BIGINT AS code_sum, md5(string_agg(word, ' ' ORDER BY pos)) AS decoded
FROM coded JOIN dict USING (code) GROUP BY doc_id""")
def encode_decode(t):
    dictionary = materialize(agg.sorted_codes(tokens(t), "word", "n"))
    common = frequent(dictionary, "word", "n")
    docs = t.documents.select(whole_key("doc_id").alias("_key"), "doc_id", "text")

    def through_codes(words, entries):
        coded = lookup.encode(words, entries, "word").select("_key", "doc_id", "code", "pos")
        labels = lookup.decode(coded, entries, "code", "word")
        return labels.groupBy("_key").agg(
            F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.sum("code").alias("code_sum"), F.collect_list(F.struct("pos", "word")).alias("words")
        )

    # Frequent words meet their codes where their document is, to which its text moved before it was cut; the others move.
    near = through_codes(explode_words(docs.repartition("_key"), "text", ["_key", "doc_id"]), F.broadcast(common))
    far = through_codes(without_frequent(explode_words(docs, "text", ["_key", "doc_id"]), common, "word"), dictionary)
    both = near.join(far.select("_key", *[F.col(c).alias(f"_{c}") for c in ("doc_id", "n", "code_sum", "words")]), "_key", "full_outer")
    added = lambda c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))
    none = F.array().cast(near.schema["words"].dataType)
    in_order = F.sort_array(F.concat(F.coalesce("words", none), F.coalesce("_words", none)))["word"]  # one document's words
    return both.select(
        F.coalesce("doc_id", "_doc_id").alias("doc_id"),
        added("n").alias("n"),
        added("code_sum").alias("code_sum"),
        F.md5(F.array_join(in_order, " ").cast("binary")).alias("decoded"),
    )


@query("j3_new_rows", """
SELECT doc_id, lang, source, md5(text) AS body FROM documents
WHERE substr(md5('old:' || doc_id), 1, 1) >= '6'""")
def new_rows(t):
    docs = t.documents.select("doc_id", "lang", "source", F.md5("text").alias("body"))
    return lookup.new_rows(docs, docs.filter(F.substring(hash_hex("old", "doc_id"), 1, 1) < "6"))


@query("j4_sample_complement", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('frac:' || o_orderkey), o_orderkey) AS rk, count(*) OVER () AS n
           FROM orders)
SELECT o_orderkey, o_totalprice FROM r WHERE rk > round(0.8 * n)""")
def sample_complement(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    sample = window.sample_fraction(orders.select("o_orderkey"), ["o_orderkey"], 0.8, "frac")
    return orders.join(sample, "o_orderkey", "left_anti")


@query("j5_semi_join", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
  AND c_nationkey IN (SELECT s_nationkey FROM supplier)""")
def semi_join(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    served = t.supplier.select(F.col("s_nationkey").alias("c_nationkey"))
    return t.customer.join(done, "c_custkey", "left_semi").join(served, "c_nationkey", "left_semi").select(
        "c_custkey", "c_name"
    )


@query("j6_class_pairs", """
WITH m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('pair:' || vec_id), vec_id) AS pos
           FROM embeddings)
SELECT a.label AS label, a.vec_id AS a_id, b.vec_id AS b_id FROM m a JOIN m b ON a.label = b.label AND a.pos % 2 = 1 AND b.pos = a.pos + 1""")
def class_pairs(t):
    return pairs.paired_members(t.embeddings, "label", "vec_id", "pair")


_BANDS = [
    ("pale", [(1, 20), (0.0, 0.05), (0.0, 0.08)]),
    ("warm", [(10, 30), (0.02, 0.08), (0.0, 0.05)]),
    ("deep", [(25, 50), (0.05, 0.10), (0.02, 0.08)]),
    ("last", [(40, 45), (0.00, 0.10), (0.00, 0.08)]),
]
_BAND_SQL = " ".join(
    "WHEN " + " AND ".join(f"{c} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE" for c, (lo, hi) in zip(("l_quantity", "l_discount", "l_tax"), r)) + f" THEN '{n}'"
    for n, r in reversed(_BANDS)
)


@query("j8_band_names", f"SELECT {KEY_SQL}, CASE {_BAND_SQL} ELSE '[?]' END AS band FROM lineitem")
def band_names(t):
    channels = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]
    return t.lineitem.select(*LINE_KEY, lookup.band_names(channels, _BANDS).alias("band"))


@query("j9_nearest_center", """
WITH v AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, dim, avg(x) AS m FROM v GROUP BY label, dim),
d AS (SELECT vec_id, c.label AS center, sum((x - m) * (x - m)) AS dist FROM v JOIN c USING (dim) GROUP BY vec_id, c.label)
SELECT vec_id, arg_min(center, dist) AS center FROM d GROUP BY vec_id""")
def nearest_center(t):
    rows = agg.vector_centroids(t.embeddings, "label", "embedding").orderBy("label", "dim").collect()  # classes x dimensions
    centers: dict = {}
    for r in rows:
        centers.setdefault(r["label"], []).append(r["mean"])
    return t.embeddings.select("vec_id", lookup.nearest_vector(F.col("embedding").cast("array<double>"), list(centers.items())).alias("center"))


@query("j10_rejected_draws", f"""
WITH known AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem),
n AS (SELECT (SELECT count(*) FROM part) AS np, (SELECT count(*) FROM supplier) AS ns),
draws AS (
  SELECT i AS draw, {h("'neg-l:' || i")} % np AS part, {h("'neg-r:' || i")} % ns AS supp
  FROM (SELECT unnest(range((SELECT (ceil(count(*) / 10) * 60)::BIGINT FROM part))) AS i), n),
valid AS (SELECT d.* FROM draws d ANTI JOIN known k ON d.part = k.part AND d.supp = k.supp),
r AS (SELECT row_number() OVER (ORDER BY draw) AS rn, part, supp FROM valid)
SELECT * FROM r WHERE rn <= (SELECT floor(count(*) / 10) FROM part)""")
def rejected_draws(t):
    known = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    n_part = t.part.count()
    return lookup.rejected_draws(known, "part", "supp", n_part, t.supplier.count(), n_part // 10, "neg")


@query("j11_values_at_peaks", f"""
WITH {HOURLY},
w AS (SELECT *, lag(n) OVER x AS p, lead(n) OVER x AS q, row_number() OVER x - 1 AS index
      FROM hourly WINDOW x AS (PARTITION BY event_type ORDER BY hour_no)),
spend AS (SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts))::BIGINT AS hour_no,
          round(sum(value), 4) AS spend FROM events GROUP BY 1, 2)
SELECT event_type, hour_no, spend FROM w JOIN spend USING (event_type, hour_no) WHERE n > p AND n > q""")
def values_at_peaks(t):
    peaks = window.local_maxima(hourly(t), ["event_type"], "hour_no", "n")
    spend = t.events.groupBy("event_type", hour_number("ts").alias("hour_no")).agg(F.round(F.sum("value"), 4).alias("spend"))
    return spend.join(peaks.select("event_type", "hour_no"), ["event_type", "hour_no"], "left_semi")
