"""Pixel operators (D1, D11, D12) over images drawn from the embeddings, and files per class."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions.hashing import hash_hex
from loomframe.operators import images
from loomframe.plans.checkpoints import scratch_path
from loomframe.registry import query
from loomframe.sources import readers

PIXELS = """
px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, greatest(0, least(255, floor(v * 100) + 128)) AS p
       FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def _neighbours(table: str, side: int, fn: str) -> str:
    """Per pixel: own value ``c`` and the sum ``s`` of its four neighbours with mirrored borders."""
    last = side - 1
    return f"""
{fn} AS (SELECT a.vec_id AS vec_id, a.y AS y, a.x AS x, a.p AS c, sum(b.p) AS s FROM {table} a,
  (SELECT unnest([0, 0, 1, -1]) AS dx, unnest([1, -1, 0, 0]) AS dy) d
  JOIN {table} b ON b.vec_id = a.vec_id
   AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > {last} THEN {last - 1} ELSE a.x + dx END
   AND b.y = CASE WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy > {last} THEN {last - 1} ELSE a.y + dy END
  GROUP BY 1, 2, 3, 4)"""


def _drawn(t):
    return images.vector_images(t.embeddings, "vec_id", "embedding", 8)


@query("a19_files_per_class", """
SELECT 'source=' || source AS label, count(DISTINCT lang)::BIGINT AS n FROM documents GROUP BY source""")
def files_per_class(t):
    path = scratch_path(t.spark, "documents_by_source")
    # A group is dealt to several writers, so a hot one is not one task's; folders are counted, not files.
    salt = F.pmod(F.xxhash64("text"), F.lit(8))
    t.documents.select("lang", "source", "text").repartition("lang", "source", salt).write.partitionBy("lang", "source").text(path)
    files = readers.class_files(t.spark, path, "*.txt").withColumn("lang", F.element_at(F.split("path", "/"), -3))
    return files.groupBy("label").agg(F.count_distinct("lang").alias("n"))


@query("d1_image_fingerprints", f"""
WITH {PIXELS}, bl AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(p) AS p FROM px GROUP BY 1, 2, 3),
md AS (SELECT vec_id, median(p) AS m FROM bl GROUP BY 1),
nb AS (SELECT vec_id, y AS nibble, sum(CASE WHEN p >= m THEN pow(2, 3 - x) ELSE 0 END)::INT AS d FROM bl JOIN md USING (vec_id) GROUP BY 1, 2)
SELECT vec_id, string_agg(printf('%x', d), '' ORDER BY nibble) AS fingerprint FROM nb GROUP BY vec_id""")
def image_fingerprints(t):
    return images.block_fingerprints(_drawn(t), "vec_id", "bigint", 4)  # each block is the mean of 2 x 2 pixels


@query("d11_sharpness", f"""
WITH {PIXELS}, {_neighbours("px", 8, "lp")}
SELECT vec_id, round(var_pop(s - 4 * c), 6) AS variance, var_pop(s - 4 * c) <= 3000 AS is_blurred FROM lp GROUP BY vec_id""")
def sharpness(t):
    return images.sharpness(_drawn(t), "vec_id", "bigint", 3000.0).withColumn("variance", F.round("variance", 6))


@query("d12_normalized_images", f"""
WITH {PIXELS},
fl AS (SELECT vec_id, y, CASE WHEN substr(md5('flip:' || vec_id), 1, 1) < '8' THEN 7 - x ELSE x END AS x, p FROM px),
sm AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, round_even(avg(p), 0) AS p FROM fl GROUP BY 1, 2, 3),
{_neighbours("sm", 4, "sh")}
SELECT vec_id, (y * 4 + x)::INT AS pos, round(greatest(0, least(255, 5 * c - s)) / 255.0::DOUBLE, 5) AS value FROM sh""")
def normalized_images(t):
    drawn = _drawn(t).withColumn("flip", F.substring(hash_hex("flip", "vec_id"), 1, 1) < "8")
    out = images.normalized_images(drawn, "vec_id", "bigint", 4, 4, flip="flip")
    return out.select("vec_id", F.posexplode("values").alias("pos", "v")).select(
        "vec_id", "pos", F.round(F.col("v").cast("double"), 5).alias("value")
    )
