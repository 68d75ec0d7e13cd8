"""Splits, folds, resampling and pairs (D-S1 to D-S13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import lookup, pairs, sampling, text
from loomframe.queries.sql import h
from loomframe.registry import query


@query("ds1_split_exact", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('tts:' || o_orderkey), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= ceil(round(0.2::DOUBLE * n, 9)) THEN 'test' ELSE 'train' END AS part FROM r""")
def split_exact(t):
    return sampling.split_exact(t.orders.select("o_orderkey"), ["o_orderkey"], 0.2, "tts")


@query("ds2_split_classes", """
WITH c AS (SELECT label, row_number() OVER (ORDER BY md5('cls:' || label), label) AS rn, count(*) OVER () AS k
           FROM (SELECT DISTINCT label FROM embeddings))
SELECT vec_id, label, CASE WHEN rn <= ceil(round(0.8::DOUBLE * k, 9)) THEN 'train' ELSE 'test' END AS part
FROM embeddings JOIN c USING (label)""")
def split_classes(t):
    return sampling.split_classes(t.embeddings.select("vec_id", "label"), "label", 0.8, "cls")


def _draws_sql(members: str, sizes: str, count: str, seed: str) -> str:
    """draws(label, draw, doc_id) of ``count`` rows per class."""
    return f"""
m AS (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || doc_id), doc_id) AS rn FROM {members}),
k AS (SELECT label, n, unnest(range(1, ({count}) + 1)) AS draw FROM {sizes}),
draws AS (SELECT k.label AS label, draw, doc_id FROM k
          JOIN m ON m.label = k.label AND m.rn = {h(f"'{seed}-draw:' || k.label || ':' || draw")} % n + 1)"""


@query("ds3_bootstrap_classes", f"""
WITH d AS (SELECT lang AS label, doc_id FROM documents),
s AS (SELECT label, count(*) AS n FROM d GROUP BY label),
{_draws_sql("d", "s", "(SELECT floor(0.9::DOUBLE * median(n))::BIGINT FROM s)", "boot")}
SELECT label, draw, doc_id, row_number() OVER (ORDER BY md5('boot-mix:' || label || ':' || draw), label, draw) AS place FROM draws""")
def bootstrap_classes(t):
    from loomframe.operators.aggregate import resample_target

    df = t.documents.select(F.col("lang").alias("label"), "doc_id")
    size = resample_target(df, "label", 0.9).first()["target"]
    return sampling.bootstrap_classes(df, "label", "doc_id", size, "boot")


@query("ds4_oversample_minority", f"""
WITH d AS (SELECT toxic AS label, doc_id FROM labels),
s AS (SELECT label, count(*) AS n FROM d GROUP BY label),
low AS (SELECT * FROM s ORDER BY n, label LIMIT 1),
{_draws_sql("d", "low", "(SELECT max(n) FROM s) - n", "over")}
SELECT label, doc_id, FALSE AS is_extra FROM d UNION ALL SELECT label, doc_id, TRUE FROM draws""")
def oversample_minority(t):
    return sampling.oversample_minority(t.labels.select(F.col("toxic").alias("label"), "doc_id"), "label", "doc_id", "over")


@query("ds5_contiguous_folds", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels)
SELECT doc_id, (CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
                     ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END)::INT AS fold FROM r""")
def contiguous_folds(t):
    return sampling.contiguous_folds(t.labels.select("doc_id"), ["doc_id"], 5)


@query("ds5_stratified_folds", """
WITH c AS (SELECT quality, count(*) AS n, min(doc_id) AS f FROM labels GROUP BY quality),
o AS (SELECT quality, n, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM c),
a AS (SELECT quality, i AS fold, (SELECT count(*) FROM range(s, s + n) x(p) WHERE p % 5 = i) AS dealt
      FROM o, (SELECT unnest(range(0, 5)) AS i)),
b AS (SELECT quality, fold, sum(dealt) OVER (PARTITION BY quality ORDER BY fold) AS upto, sum(dealt) OVER (PARTITION BY quality ORDER BY fold) - dealt AS start FROM a),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS i FROM labels)
SELECT doc_id, r.quality AS quality, fold::INT AS fold FROM r JOIN b ON r.quality = b.quality AND i >= start AND i < upto""")
def stratified_folds(t):
    return sampling.stratified_folds(t.labels.select("doc_id", "quality"), "quality", ["doc_id"], 5)


@query("ds6_stratified_shuffles", """
WITH r AS (SELECT doc_id, quality, repeat, row_number() OVER (PARTITION BY repeat, quality ORDER BY md5('sss:' || repeat || ':' || doc_id), doc_id) AS rn,
                  count(*) OVER (PARTITION BY repeat, quality) AS n
           FROM labels, (SELECT unnest([1, 2, 3]) AS repeat))
SELECT doc_id, quality, repeat, CASE WHEN rn <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_shuffles(t):
    return sampling.stratified_shuffles(t.labels.select("doc_id", "quality"), "quality", ["doc_id"], 3, 0.2, "sss")


_POSITIVES = """
m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('pos:' || vec_id), vec_id) AS pos
      FROM embeddings WHERE label <> 9),
p AS (SELECT a.label::BIGINT AS label, a.vec_id AS a_id, b.vec_id AS b_id FROM m a JOIN m b ON a.label = b.label AND a.pos < b.pos
      WHERE a.pos <= 8 AND b.pos <= 8),
u0 AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings WHERE label = 9),
u AS (SELECT 99 + ceil(rn / 2)::BIGINT AS label, max(CASE WHEN rn % 2 = 1 THEN vec_id END) AS a_id,
             max(CASE WHEN rn % 2 = 0 THEN vec_id END) AS b_id FROM u0 GROUP BY ceil(rn / 2) HAVING count(*) = 2)"""

_PAIRED = _POSITIVES.replace("a.pos < b.pos\n      WHERE a.pos <= 8 AND b.pos <= 8", "b.pos = a.pos + 1\n      WHERE a.pos % 2 = 1")


def _positives(t, quota: int | None = None):
    """(class pairs, unique pairs): label 9 plays the folder of one-off pairs.

    With a quota, all pairs among so many members of each class; without, every member in one pair.
    """
    members = t.embeddings.filter("label <> 9")
    classes = pairs.class_pairs(members, "label", "vec_id", quota, "pos") if quota else pairs.paired_members(members, "label", "vec_id", "pos")
    uniques = pairs.unique_pairs(t.embeddings.filter("label = 9"), "vec_id", 100)
    return classes.select(F.col("label").cast("bigint").alias("label"), "a_id", "b_id"), uniques


@query("ds7_positive_pairs", f"WITH {_POSITIVES} SELECT * FROM p UNION ALL SELECT * FROM u")
def positive_pairs(t):
    classes, uniques = _positives(t, quota=8)
    return classes.unionByName(uniques)


@query("ds8_random_class_pairs", f"""
WITH m AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('rnd:' || vec_id), vec_id) - 1 AS i FROM embeddings),
s AS (SELECT label, count(*) AS n, unnest(range(1, 21))::INT AS draw FROM embeddings GROUP BY label),
k AS (SELECT label, draw, {h("'rnd-a:' || label || ':' || draw")} % n AS a, {h("'rnd-b:' || label || ':' || draw")} % (n - 1) AS st, n FROM s WHERE n > 1)
SELECT k.label AS label, draw, x.vec_id AS a_id, y.vec_id AS b_id FROM k
JOIN m x ON x.label = k.label AND x.i = a JOIN m y ON y.label = k.label AND y.i = (a + 1 + st) % n""")
def random_class_pairs(t):
    return pairs.random_class_pairs(t.embeddings, "label", "vec_id", 20, "rnd")


def _negatives_sql(source: str, seed: str) -> str:
    return f"""
r AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || label || ':' || a_id || ':' || b_id), label, a_id, b_id) AS place FROM {source}),
w AS (SELECT *, (SELECT count(*) FROM r) AS total FROM r),
nx AS (SELECT f.place, f.label, f.a_id, f.b_id, min(CASE WHEN g.place > f.place THEN g.place ELSE g.place + f.total END) AS other, any_value(f.total) AS total
       FROM w f JOIN w g ON f.label <> g.label GROUP BY ALL),
neg AS (SELECT nx.place AS draw, CASE WHEN {h(f"'{seed}-a:' || nx.place")} % 2 = 0 THEN nx.a_id ELSE nx.b_id END AS a_id,
               CASE WHEN {h(f"'{seed}-b:' || nx.place")} % 2 = 0 THEN g.a_id ELSE g.b_id END AS b_id,
               nx.label AS a_label, g.label AS b_label
        FROM nx JOIN r g ON g.place = (other - 1) % total + 1)"""


@query("ds9_negative_pairs", f"""
WITH {_PAIRED}, allp AS (SELECT * FROM p UNION ALL SELECT * FROM u), {_negatives_sql("allp", "neg")}
SELECT * FROM neg WHERE draw <= (SELECT floor(count(*) * 0.75 / 2) * 2 FROM allp)""")
def negative_pairs(t):
    classes, uniques = _positives(t)
    return pairs.negative_pairs(classes.unionByName(uniques), "label", 0.75, "neg")


@query("ds10_negative_links", f"""
WITH known AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem),
n AS (SELECT (SELECT count(*) FROM part) AS np, (SELECT count(*) FROM supplier) AS ns),
draws AS (SELECT i AS draw, {h("'link-l:' || i")} % np AS part, {h("'link-r:' || i")} % ns AS supp
          FROM (SELECT unnest(range((SELECT count(*) * 60 FROM part))) AS i), n),
valid AS (SELECT row_number() OVER (ORDER BY draw) AS rn, part, supp FROM draws d ANTI JOIN known k ON d.part = k.part AND d.supp = k.supp)
SELECT part, supp, 1 AS target FROM known UNION ALL
SELECT part, supp, -1 FROM valid WHERE rn <= (SELECT count(*) FROM part)""")
def negative_links(t):
    known = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).distinct()
    n_part = t.part.count()
    negatives = lookup.rejected_draws(known, "part", "supp", n_part, t.supplier.count(), n_part, "link")
    return known.withColumn("target", F.lit(1)).unionByName(negatives.select("part", "supp", F.lit(-1).alias("target")))


_PART_TAGS = """
p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS label, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part),
d AS (SELECT label, row_number() OVER (ORDER BY min(p_partkey * 100 + pos)) AS code FROM p GROUP BY label),
own AS (SELECT p_partkey, list(code) AS codes FROM p JOIN d USING (label) GROUP BY p_partkey)"""


@query("ds10_foreign_tags", f"""
WITH {_PART_TAGS},
w AS (SELECT p_partkey, codes, (SELECT count(*) FROM d) + 1 AS n, {h("'ft:' || p_partkey")} AS start,
             {sampling.WALK_STEPS}[({h("'ft-step:' || p_partkey")} % {len(sampling.WALK_STEPS)}) + 1] AS step FROM own),
walk AS (SELECT p_partkey, codes, i, (start % n + i * step) % n AS code FROM (SELECT *, unnest(range(0, least(n, len(codes) + 3))) AS i FROM w)),
r AS (SELECT p_partkey, code, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS rn FROM walk WHERE NOT list_contains(codes, code))
SELECT p_partkey, string_agg(code::VARCHAR, ',' ORDER BY rn) AS tags FROM r WHERE rn <= 3 GROUP BY p_partkey""")
def foreign_tags(t):
    dictionary = text.label_codes(t.part, "p_partkey", "p_name", " ")
    width = text.longest_list(t.part, "p_name", " ")
    bag = text.code_bag(t.part, "p_partkey", "p_name", dictionary, width, " ")
    own = F.array(*[F.col(f"code_{i + 1}") for i in range(width)])
    pad = F.filter(own, lambda c: c > 0)
    picked = sampling.foreign_tags(pad, "p_partkey", dictionary.count(), 3, "ft")
    return bag.select("p_partkey", F.array_join(F.transform(picked, lambda c: c.cast("string")), ",").alias("tags"))


@query("ds11_permuted_copies", """
WITH w AS (SELECT p_partkey, copy, unnest(string_split(p_name, ' ')) AS tag FROM part, (SELECT unnest([1, 2, 3, 4]) AS copy))
SELECT p_partkey, copy, string_agg(tag, ' ' ORDER BY md5('mix:' || p_partkey || ':' || copy || ':' || tag), tag) AS tags
FROM w GROUP BY 1, 2""")
def permuted_copies(t):
    df = t.part.select("p_partkey", F.split("p_name", " ").alias("tags"))
    return sampling.permuted_copies(df, "p_partkey", "tags", 4, "mix").withColumn("tags", F.array_join("tags", " "))


@query("ds12_evaluation_batch", f"""
WITH {_PAIRED},
r AS (SELECT *, row_number() OVER (ORDER BY md5('tb:' || label || ':' || a_id || ':' || b_id), label, a_id, b_id) AS place FROM p),
s AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM u) AS nu, (SELECT count(*) FROM p) AS size),
z AS (SELECT *, floor(round(0.3::DOUBLE * size, 9))::BIGINT AS nn FROM s),
dr AS (SELECT {h("'tb-p:' || i")} % n + 1 AS place FROM (SELECT unnest(range((SELECT size - nn - nu FROM z))) AS i), z)
SELECT 'positive' AS kind, count(*)::BIGINT AS n, sum(a_id)::BIGINT AS a_sum, sum(b_id)::BIGINT AS b_sum FROM dr JOIN r USING (place)
UNION ALL SELECT 'unique', count(*), sum(a_id)::BIGINT, sum(b_id)::BIGINT FROM u
UNION ALL SELECT * FROM (
  WITH pool AS (SELECT * FROM p UNION ALL SELECT * FROM u), {_negatives_sql("pool", "tb-n")}
  SELECT 'negative', count(*), sum(a_id)::BIGINT, sum(b_id)::BIGINT FROM neg WHERE draw <= (SELECT nn FROM z))""")
def evaluation_batch(t):
    classes, uniques = _positives(t)
    batch = pairs.evaluation_batch(classes, "label", classes.count(), 0.7, "tb", uniques)
    return batch.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a_id").alias("a_sum"), F.sum("b_id").alias("b_sum")
    )


@query("ds13_batch_ids", """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders""")
def batch_ids(t):
    return sampling.batch_ids(t.orders.select("o_orderkey"), ["o_orderkey"], 64)
