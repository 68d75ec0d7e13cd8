"""Models (M1-M10, M13, M14, M16), cross-validation (E10, E12), PCA (F17) and learned vectors."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from loomframe.functions.text import words
from loomframe.operators import boosting as bo, features as ft, metrics as mx, models as md, sampling, similarity as sim, window
from loomframe.plans.checkpoints import scratch_path
from loomframe.queries.sql import WORDS, h
from loomframe.registry import query

STATS = ["n_chars", "n_words", "n_lines", "word_length", "distinct_share"]


# Labelled documents with raw statistics, and a hold-out part drawn by seeded hash.
_DOC_STATS = f"""
raw AS (SELECT doc_id, quality, n_chars, text, {WORDS} AS w FROM documents JOIN labels USING (doc_id)),
stats AS (SELECT doc_id, quality, ln(1 + n_chars::DOUBLE) AS n_chars, ln(1 + len(w)::DOUBLE) AS n_words,
                 ln(1 + len(string_split(text, chr(10)))::DOUBLE) AS n_lines,
                 len(array_to_string(w, ''))::DOUBLE / greatest(len(w), 1) AS word_length,
                 len(list_distinct(w))::DOUBLE / greatest(len(w), 1) AS distinct_share FROM raw),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('hold:' || doc_id), doc_id) <= ceil(round(0.25::DOUBLE * count(*) OVER (), 9)) AS test FROM stats),
fitted AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in STATS)} FROM ranked WHERE NOT test),
z AS (SELECT doc_id, quality, test, {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in STATS)} FROM ranked, fitted)"""


def raw_stats(t):
    """Labelled documents with text statistics."""
    w = words("text")
    n = F.greatest(F.size(w), F.lit(1))
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        "quality",
        "toxic",
        F.log1p(F.col("n_chars").cast("double")).alias("n_chars"),
        F.log1p(F.size(w).cast("double")).alias("n_words"),
        F.log1p(F.size(F.split("text", "\n")).cast("double")).alias("n_lines"),
        (F.length(F.array_join(w, "")) / n).alias("word_length"),
        (F.size(F.array_distinct(w)) / n).alias("distinct_share"),
    )


def held_out(t):
    """Statistics with ``part`` (a quarter is test), standardised as the train rows tell."""
    df = md.materialize(raw_stats(t).hint("rebalance"))
    df = sampling.split_exact(df, ["doc_id"], 0.25, "hold")
    return ft.scale(df, ft.fit_scaler(df.filter("part = 'train'"), STATS, "standard"))


def training_frame(df, columns=STATS, keep=("doc_id", "quality")):
    """Feature vectors checkpointed once: every pass of an iterative fit reads them, not the texts."""
    return md.materialize(md.assemble(df, columns).select(*keep, md.FEATURES).hint("rebalance"))


def folded_frame(t, k):
    """Labelled documents with their length, in class-wise folds."""
    df = t.documents.join(t.labels, "doc_id").select("doc_id", "quality", F.log1p(F.col("n_chars").cast("double")).alias("x"))
    return md.materialize(sampling.stratified_folds(df, "quality", ["doc_id"], k).hint("rebalance"))


# The same folds; ``i`` is the place of a document inside its class.
_FOLDS = """
d AS (SELECT doc_id, quality, ln(1 + n_chars::DOUBLE) AS x FROM documents JOIN labels USING (doc_id)),
c AS (SELECT quality, count(*) AS n, min(doc_id) AS f FROM d GROUP BY quality),
o AS (SELECT quality, n, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM c),
a AS (SELECT quality, i AS fold, (SELECT count(*) FROM range(s, s + n) x(p) WHERE p % 3 = i) AS dealt FROM o, (SELECT unnest(range(0, 3)) AS i)),
b AS (SELECT quality, fold, sum(dealt) OVER (PARTITION BY quality ORDER BY fold) AS upto, sum(dealt) OVER (PARTITION BY quality ORDER BY fold) - dealt AS start FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS i FROM d),
folded AS (SELECT doc_id, r.quality AS quality, x, fold::INT AS fold FROM r JOIN b ON r.quality = b.quality AND i >= start AND i < upto)"""
_LINES = """
fit AS (SELECT k.fold AS fold, regr_slope(quality, x) AS slope, regr_intercept(quality, x) AS bias
        FROM folded f JOIN (SELECT DISTINCT fold FROM folded) k ON f.fold <> k.fold GROUP BY k.fold),
oof AS (SELECT doc_id, quality, fold, bias + slope * x AS score FROM folded JOIN fit USING (fold))"""


def scored(t, estimator, columns=STATS, frame=None):
    """Fitted on train rows, scored on the held-out rows; ``estimator`` may be a function of the number of train rows."""
    df = training_frame(frame if frame is not None else held_out(t), columns, ("doc_id", "quality", "part"))
    train = df.filter("part = 'train'")
    if not hasattr(estimator, "fit"):
        estimator = estimator(train.count())
    out = estimator.fit(train).transform(df.filter("part = 'test'"))
    return out.select("doc_id", F.col("quality").alias("truth"), F.col("prediction").cast("int").alias("pred"))


_CENTERS = f"""
p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT vec_id, unnest(range(len(v))) AS dim, unnest(v) AS x FROM p),
box AS (SELECT dim, min(x) AS low, max(x) AS high FROM e GROUP BY dim),
start AS (SELECT cluster, list(low + {h("'km:' || cluster || ':' || dim")} / 4294967296.0::DOUBLE * (high - low) ORDER BY dim) AS center
          FROM box, (SELECT unnest(range(0, 3)) AS cluster) GROUP BY cluster)"""


def _rounded_centers(df):
    cells = df.select(F.col("cluster").cast("bigint").alias("cluster"), "n", F.posexplode("center").alias("dim", "mean"))
    return cells.withColumn("mean", F.round("mean", 5))


@query("m1_kmeans_step", f"""
WITH {_CENTERS},
near AS (SELECT vec_id, arg_min(cluster, list_distance(v, center)) AS cluster FROM p, start GROUP BY vec_id)
SELECT cluster::BIGINT AS cluster, dim::INT AS dim, round(avg(x), 5) AS mean, count(*)::BIGINT AS n FROM near JOIN e USING (vec_id) GROUP BY 1, 2""")
def kmeans_step(t):
    points = t.embeddings.select(F.col("embedding").cast("array<double>").alias("v"))
    return _rounded_centers(md.lloyd_step(points, "v", md.box_centers(points, "v", 3, "km")))


@query("m1_kmeans", f"""
WITH RECURSIVE {_CENTERS},
g(round, cluster, center, shift) AS (
  SELECT 0, cluster, center, 1e9::DOUBLE FROM start
  UNION ALL
  SELECT round, cluster, fresh, sum(pow(list_distance(center, fresh), 2)) OVER () FROM (
    SELECT g.round + 1 AS round, g.cluster AS cluster, g.center AS center, coalesce(m.center, g.center) AS fresh
    FROM g LEFT JOIN (
      SELECT cluster, list(mean ORDER BY dim) AS center FROM (
        SELECT near.cluster AS cluster, e.dim AS dim, avg(e.x) AS mean
        FROM (SELECT vec_id, arg_min(cluster, list_distance(v, center)) AS cluster FROM p, g GROUP BY vec_id) near JOIN e USING (vec_id)
        GROUP BY 1, 2) GROUP BY cluster) m ON g.cluster = m.cluster
    WHERE g.shift > 1e-6)),
final AS (SELECT cluster, center FROM g WHERE round = (SELECT max(round) FROM g)),
near AS (SELECT vec_id, arg_min(cluster, list_distance(v, center)) AS cluster FROM p, final GROUP BY vec_id)
SELECT cluster::BIGINT AS cluster, dim::INT AS dim, round(avg(x), 5) AS mean, count(*)::BIGINT AS n FROM near JOIN e USING (vec_id) GROUP BY 1, 2""")
def kmeans(t):
    points = t.embeddings.select(F.col("embedding").cast("array<double>").alias("v"))
    return _rounded_centers(md.lloyd_step(points, "v", md.k_means(points, "v", 3, "km", 1e-6)))


_GD = """
s AS (SELECT (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS x,
             l_extendedprice AS y FROM lineitem),
m AS (SELECT avg(x) AS sx, avg(x * x) AS sxx, avg(y) AS sy, avg(x * y) AS sxy, avg(y * y) AS syy FROM s)"""


@query("m2_gradient_descent", f"""
WITH RECURSIVE {_GD},
g(epoch, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT epoch + 1, a - 0.1::DOUBLE * (a + b * sx - sy), b - 0.1::DOUBLE * (a * sx + b * sxx - sxy) FROM g, m WHERE epoch < 50)
SELECT epoch, round(a, 4) AS bias, round(b, 4) AS slope,
       round((a * a + 2 * a * b * sx + b * b * sxx - 2 * (a * sy + b * sxy) + syy) / 2, 0) AS cost FROM g, m WHERE epoch = 50""")
def gradient_descent(t):
    df = t.lineitem.select("l_quantity", "l_extendedprice")
    df = ft.scale(df, ft.fit_scaler(df, ["l_quantity"], "standard"))
    theta, costs = md.gradient_descent(df, ["l_quantity"], "l_extendedprice", 0.1, 50)
    return t.spark.range(1).select(
        F.lit(50).alias("epoch"),
        F.round(F.lit(theta[0]), 4).alias("bias"),
        F.round(F.lit(theta[1]), 4).alias("slope"),
        F.round(F.lit(costs[-1]), 0).alias("cost"),
    )


_LINE_3 = "t0 + " + " + ".join(f"t{j} * {c}" for j, c in enumerate(STATS, 1))


@query("m3_linear_classifier", f"""
WITH RECURSIVE {_DOC_STATS},
g(epoch, {", ".join(f"t{j}" for j in range(6))}) AS (SELECT 0, {", ".join(["0::DOUBLE"] * 6)} UNION ALL
  SELECT epoch + 1, {", ".join(f"t{j} - 0.2::DOUBLE * avg(({_LINE_3} - quality) * {c})" for j, c in enumerate(["1", *STATS]))}
  FROM g, z WHERE epoch < 100 AND NOT test GROUP BY epoch, t0, t1, t2, t3, t4, t5)
SELECT doc_id, quality AS truth, round({_LINE_3}, 6) AS score, (CASE WHEN {_LINE_3} < 0.5 THEN 0 ELSE 1 END)::INT AS pred
FROM z, g WHERE test AND epoch = 100""")
def linear_classifier(t):
    df = held_out(t)
    theta, _ = md.gradient_descent(df.filter("part = 'train'"), STATS, "quality", 0.1, 100, factor=2.0)
    return df.filter("part = 'test'").select(
        "doc_id",
        F.col("quality").alias("truth"),
        F.round(md.linear_score(theta, STATS), 6).alias("score"),
        md.linear_class(theta, STATS).alias("pred"),
    )


@query("m4_linear_regression", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS bias,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def linear_regression(t):
    model = md.linear_regression(t.lineitem, ["l_quantity"], "l_extendedprice")
    return t.spark.range(1).select(
        F.round(F.lit(float(model.coefficients[0])), 4).alias("slope"),
        F.round(F.lit(model.intercept), 4).alias("bias"),
        F.round(F.lit(model.summary.r2), 6).alias("r2"),
    )


_LASSO = ["l_quantity", "l_discount", "l_tax"]


def _descend(j: int) -> str:
    """Coordinate j of the standardised lasso; coordinates before it are already new."""
    rest = " - ".join([f"r{j}", *[f"c{min(j, k)}{max(j, k)} * {'n' if k < j else 'w'}{k}" for k in range(3) if k != j]])
    return f"sign({rest}) * greatest(abs({rest}) - 100 / sy, 0)"


@query("m4_lasso", f"""
WITH RECURSIVE m AS (SELECT stddev_pop(l_extendedprice) AS sy, avg(l_extendedprice) AS my,
  {", ".join(f"stddev_pop({c}) AS s{j}, avg({c}) AS m{j}, corr({c}, l_extendedprice) AS r{j}" for j, c in enumerate(_LASSO))},
  {", ".join(f"corr({_LASSO[i]}, {_LASSO[j]}) AS c{i}{j}" for i in range(3) for j in range(i + 1, 3))} FROM lineitem),
g(round, w0, w1, w2) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL
  SELECT round + 1, n0, n1, {_descend(2)} FROM (SELECT *, {_descend(1)} AS n1 FROM (SELECT *, {_descend(0)} AS n0 FROM g, m WHERE round < 100)))
SELECT {", ".join(f"round(w{j} * sy / s{j}, 2) AS {c}" for j, c in enumerate(_LASSO))},
       round(my - {" - ".join(f"w{j} * sy / s{j} * m{j}" for j in range(3))}, 2) AS bias FROM g, m WHERE round = 100""")
def lasso(t):
    model = md.linear_regression(t.lineitem, _LASSO, "l_extendedprice", lasso=100.0)
    values = [*map(float, model.coefficients), float(model.intercept)]
    return t.spark.range(1).select(*[F.round(F.lit(w), 2).alias(c) for c, w in zip([*_LASSO, "bias"], values)])


@query("m5_least_absolute", """
WITH RECURSIVE s AS (SELECT (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS x,
                            l_extendedprice / 1000 AS y FROM lineitem),
g(epoch, a, b, cost) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL
  SELECT epoch + 1, a - 2 * avg(sign(a + b * x - y)), b - 2 * avg(sign(a + b * x - y) * x), avg(abs(a + b * x - y))
  FROM g, s WHERE epoch < 20 GROUP BY epoch, a, b)
SELECT round(max(a) FILTER (epoch = 20), 5) AS bias, round(max(b) FILTER (epoch = 20), 5) AS slope,
       round(max(cost) FILTER (epoch = 1), 5) AS first, round(max(cost) FILTER (epoch = 20), 5) AS last FROM g""")
def least_absolute(t):
    df = t.lineitem.select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    df = ft.scale(df, ft.fit_scaler(df, ["l_quantity"], "standard"))
    theta, errors = md.least_absolute(df, ["l_quantity"], "price", 2.0, 20)
    values = {"bias": theta[0], "slope": theta[1], "first": errors[0], "last": errors[-1]}
    return t.spark.range(1).select(*[F.round(F.lit(v), 5).alias(c) for c, v in values.items()])


_SCORE = "1 / (1 + exp(-(b + w * n_words)))"


def _newton(c: float, l1_ratio: float, shown: str = f"round({_SCORE}, 4) AS score") -> str:
    """Proximal Newton steps of the logistic loss over one column, with a free intercept."""
    return f"""
WITH RECURSIVE {_DOC_STATS},
pen AS (SELECT 1 / ({c}::DOUBLE * count(*)) * {1 - l1_ratio} AS l2, 1 / ({c}::DOUBLE * count(*)) * {l1_ratio} AS l1 FROM z WHERE NOT test),
g(step, b, w) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL
  SELECT step + 1, b - (gb + hbw * (nw - w)) / hbb, nw FROM (
    SELECT *, sign(h * w - gr) * greatest(abs(h * w - gr) - l1, 0) / h AS nw FROM (
      SELECT *, hww - hbw * hbw / hbb AS h, gw - hbw * gb / hbb AS gr FROM (
        SELECT step, b, w, l1, avg(p - quality) AS gb, avg((p - quality) * x) + l2 * w AS gw, avg(p * (1 - p)) AS hbb,
               avg(p * (1 - p) * x) AS hbw, avg(p * (1 - p) * x * x) + l2 AS hww
        FROM (SELECT g.*, pen.*, quality, n_words AS x, 1 / (1 + exp(-(b + w * n_words))) AS p FROM g, pen, z WHERE step < 25 AND NOT test)
        GROUP BY step, b, w, l1, l2))))
SELECT doc_id, quality AS truth, {shown} FROM z, g WHERE test AND step = 25"""


def _logistic(t, c, l1_ratio):
    df = training_frame(held_out(t), ["n_words"], ("doc_id", "quality", "part"))
    train = df.filter("part = 'train'")
    model = md.logistic_regression(train.count(), "quality", c, l1_ratio, rounds=500, tolerance=1e-12).fit(train)
    out = md.probability(model.transform(df.filter("part = 'test'")), "score")
    return out.select("doc_id", F.col("quality").alias("truth"), F.round("score", 4).alias("score"))


@query("m6_logistic_regression", _newton(1.0, 0.0))
def logistic_regression(t):
    return _logistic(t, 1.0, 0.0)


@query("m6_logistic_lasso", _newton(0.5, 1.0))
def logistic_lasso(t):
    return _logistic(t, 0.5, 1.0)


@query("m7_linear_svm")
def linear_svm(t):
    return scored(t, lambda n: md.linear_svm("quality", 1.0, n))


@query("m7_one_vs_rest")
def one_vs_rest(t):
    vector = md.array_to_vector(F.col("embedding").cast("array<double>"))
    df = sampling.split_exact(t.embeddings.select("vec_id", "label", vector.alias(md.FEATURES)), ["vec_id"], 0.25, "hold")
    df = md.materialize(df.hint("rebalance"))
    train = df.filter("part = 'train'")
    svm = md.linear_svm("label", 1.0, train.count(), classes=10)
    return svm.fit(train).transform(df.filter("part = 'test'")).select("vec_id", "label", F.col("prediction").cast("int").alias("pred"))


@query("m7_text_svm")
def text_svm(t):
    """TF-IDF of whole texts into a linear SVM: fitted on train documents, scored on the others."""
    df = t.documents.join(t.labels, "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    df = md.materialize(sampling.split_exact(df, ["doc_id"], 0.25, "hold").hint("rebalance"))
    train = df.filter("part = 'train'")
    model = md.text_classifier("text", md.linear_svm("quality", 1.0, train.count())).fit(train)
    out = model.transform(df.filter("part = 'test'"))
    return out.select("doc_id", F.col("quality").alias("truth"), F.col("prediction").cast("int").alias("pred"))


@query("m8_rbf_svm")
def rbf_svm(t):
    lifted = md.fourier_features(STATS, 0.2, 32, "rff")
    frame = held_out(t).withColumns(lifted)
    return scored(t, lambda n: md.linear_svm("quality", 1.0, n), list(lifted), frame)


@query("m9_decision_tree")
def decision_tree(t):
    return scored(t, md.decision_tree("quality"))


@query("m9_random_forest")
def random_forest(t):
    return scored(t, md.random_forest("quality", 45, depth=10))


@query("m9_gradient_boosting")
def gradient_boosting(t):
    """Up to 200 rounds of depth 3 with early stop; the rounds that were used are in the result."""
    df = md.materialize(held_out(t).select("doc_id", "quality", "part", *STATS).hint("rebalance"))
    model = bo.gradient_trees(df.filter("part = 'train'"), STATS, "quality", ["doc_id"])
    out = bo.gradient_score(df.filter("part = 'test'"), model, "score")
    return out.select(
        "doc_id", F.col("quality").alias("truth"), "score", (F.col("score") > 0.5).cast("int").alias("pred"), F.lit(len(model.trees)).alias("rounds"))


#: Coarse statistics of few values each, for which SQL can follow the boosting: (name, Spark and SQL expression).
COARSE = {"chars": "floor(2 * n_chars)", "words": "floor(2 * n_words)", "lines": "floor(2 * n_lines)", "length": "floor(2 * word_length)", "distinct": "floor(10 * distinct_share)"}

_ADA = f"""
WITH RECURSIVE {_DOC_STATS},
few AS (SELECT doc_id, quality AS y, test, [{", ".join(f"({e})::INT" for e in COARSE.values())}] AS x FROM ranked),
g(round, x, y, w, f, c, l, r, say) AS (
  SELECT 0, x, y, count(*)::DOUBLE, 0::BIGINT, 0, 0, 0, 0::DOUBLE FROM few WHERE NOT test GROUP BY x, y
  UNION ALL
  SELECT g.round + 1, g.x, g.y, g.w * exp(CASE WHEN (CASE WHEN g.x[s.f] <= s.c THEN s.l ELSE s.r END) <> g.y THEN s.say ELSE 0 END), s.f, s.c, s.l, s.r, s.say
  FROM g, (
    SELECT f, c, (l1 > l0)::INT AS l, (r1 > r0)::INT AS r,
           (least(l0, l1) + least(r0, r1)) / (l0 + l1 + r0 + r1) AS err, 0.3::DOUBLE * ln((1 - err) / err) AS say
    FROM (
      SELECT f, c, sum(w0) OVER up AS l0, sum(w1) OVER up AS l1, sum(w0) OVER every - sum(w0) OVER up AS r0, sum(w1) OVER every - sum(w1) OVER up AS r1,
             row_number() OVER (PARTITION BY f ORDER BY c DESC) AS last
      FROM (SELECT f, x[f] AS c, coalesce(sum(w) FILTER (y = 0), 0) AS w0, coalesce(sum(w) FILTER (y = 1), 0) AS w1 FROM (SELECT unnest(range(1, 6)) AS f, x, y, w FROM g) GROUP BY f, x[f])
      WINDOW up AS (PARTITION BY f ORDER BY c), every AS (PARTITION BY f))
    WHERE last > 1
    ORDER BY round((2 * l0 * l1 / (l0 + l1) + 2 * r0 * r1 / (r0 + r1)) / (l0 + l1 + r0 + r1), 10), f, c LIMIT 1) s
  WHERE g.round < 500 AND s.err < 0.5),
members AS (SELECT DISTINCT round, f, c, l, r, say FROM g WHERE round > 0)
SELECT doc_id, few.y AS truth, round(sum(say * CASE WHEN few.x[f] <= c THEN l ELSE r END) / sum(say), 6) AS score, count(*)::INT AS rounds
FROM few, members WHERE test GROUP BY doc_id, few.y"""


def coarse_stats(t):
    """Labelled documents with coarse statistics and ``part``."""
    df = md.materialize(raw_stats(t).hint("rebalance"))
    df = sampling.split_exact(df, ["doc_id"], 0.25, "hold")
    return md.materialize(df.select("doc_id", "quality", "part", *[F.expr(e).cast("int").alias(c) for c, e in COARSE.items()]))


@query("m10_ada_boost", _ADA)
def ada_boost(t):
    df = coarse_stats(t)
    model = bo.ada_stumps(df.filter("part = 'train'"), list(COARSE), "quality")
    out = bo.ada_score(df.filter("part = 'test'"), model, "score")
    return out.select("doc_id", F.col("quality").alias("truth"), F.round("score", 6).alias("score"), F.lit(len(model.members)).alias("rounds"))


def _best_splits(rows: str, name: str) -> str:
    """CTE ``name`` (node, f, cut): per node of ``rows`` (node, x, y) the split of greatest Gini gain, halfway to the feature's next value (``grid``)."""
    gini = lambda zero, one: f"(1 - pow({zero} / ({zero} + {one}), 2) - pow({one} / ({zero} + {one}), 2))"
    gain = f"{gini('t0', 't1')} - (l0 + l1) / (t0 + t1) * {gini('l0', 'l1')} - (r0 + r1) / (t0 + t1) * {gini('r0', 'r1')}"
    return f"""
{name}_h AS (SELECT node, f, x[f] AS v, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM {rows}, (SELECT unnest(range(1, 6)) AS f) GROUP BY ALL),
{name}_c AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1 FROM (
  SELECT node, f, v, lead(v) OVER up AS next, (sum(n0) OVER up)::DOUBLE AS l0, (sum(n1) OVER up)::DOUBLE AS l1, (sum(n0) OVER every)::DOUBLE AS t0, (sum(n1) OVER every)::DOUBLE AS t1
  FROM {name}_h WINDOW up AS (PARTITION BY node, f ORDER BY v), every AS (PARTITION BY node, f)) WHERE next IS NOT NULL),
{name} AS (SELECT node, f, (v + after) / 2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS place FROM (SELECT *, {gain} AS gain FROM {name}_c JOIN grid USING (f, v)))
  WHERE place = 1 AND gain > 0)"""


@query("m9_shallow_tree", f"""
WITH {_DOC_STATS},
few AS (SELECT doc_id, quality AS y, test, [{", ".join(f"({e})::INT" for e in COARSE.values())}] AS x FROM ranked),
top AS (SELECT 1 AS node, * FROM few),
train1 AS (SELECT * FROM top WHERE NOT test),
grid AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS after FROM (SELECT DISTINCT f, x[f] AS v FROM train1, (SELECT unnest(range(1, 6)) AS f))), {_best_splits("train1", "root")},
halves AS (SELECT t.* REPLACE (CASE WHEN r.f IS NULL THEN 1 WHEN x[r.f] <= r.cut THEN 2 ELSE 3 END AS node) FROM top t LEFT JOIN root r USING (node)),
train2 AS (SELECT * FROM halves WHERE NOT test AND node > 1), {_best_splits("train2", "low")},
leaves AS (SELECT h.* REPLACE (CASE WHEN l.f IS NULL THEN 10 * h.node WHEN x[l.f] <= l.cut THEN 10 * h.node + 1 ELSE 10 * h.node + 2 END AS node) FROM halves h LEFT JOIN low l USING (node)),
classes AS (SELECT node, (count(*) FILTER (y = 1) > count(*) FILTER (y = 0))::INT AS pred FROM leaves WHERE NOT test GROUP BY node)
SELECT doc_id, y AS truth, pred FROM leaves JOIN classes USING (node) WHERE test""")
def shallow_tree(t):
    """A tree of depth 2 over coarse statistics, for which SQL can follow the splits."""
    df = coarse_stats(t)
    vectors = md.assemble(df.select("doc_id", "quality", "part", *[F.col(c).cast("double").alias(c) for c in COARSE]), list(COARSE))
    train = vectors.filter("part = 'train'")
    out = md.decision_tree("quality", depth=2, bins=256).fit(train).transform(vectors.filter("part = 'test'"))
    return out.select("doc_id", F.col("quality").alias("truth"), F.col("prediction").cast("int").alias("pred"))


@query("m11_fitted_vote")
def fitted_vote(t):
    """Soft and hard vote of gradient boosting, AdaBoost and a calibrated SVM, fitted on train rows, for the held-out rows."""
    df = held_out(t).select("doc_id", "quality", "part", *STATS)
    df = md.materialize(md.assemble(df, STATS).hint("rebalance"))
    train = df.filter("part = 'train'")
    df = bo.gradient_score(df, bo.gradient_trees(train, STATS, "quality", ["doc_id"]), "p_boost")
    df = bo.ada_score(df, bo.ada_stumps(train, STATS, "quality"), "p_ada")
    margins = md.linear_svm("quality", 1.0, train.count()).fit(train).transform(df)
    margins = margins.withColumn("margin", md.vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")
    voted = md.calibrated(margins.filter("part = 'train'"), margins.filter("part = 'test'"), "margin", "quality", "p_svm")
    members = [F.col(c) for c in ("p_boost", "p_ada", "p_svm")]
    return voted.select(
        "doc_id",
        F.col("quality").alias("truth"),
        mx.soft_vote(members).alias("soft"),
        mx.hard_vote([(m > 0.5).cast("int") for m in members]).alias("hard"),
    )


@query("m13_feature_importance")
def feature_importance(t):
    df = training_frame(held_out(t), STATS, ("doc_id", "quality", "part"))
    model = md.random_forest("quality", 45, depth=10).fit(df.filter("part = 'train'"))
    return window.cumulative_share(md.feature_importance(model, STATS, t.spark), "importance", "feature", 0.95)


@query("m14_saved_model", _newton(1.0, 0.0, f"round({_SCORE}, 4) AS score, CASE WHEN {_SCORE} > 0.5 THEN 'good' ELSE 'poor' END AS decoded"))
def saved_model(t):
    """Fitted, saved, loaded again, and applied to the held-out rows with class names."""
    path = scratch_path(t.spark, "model")
    df = md.materialize(held_out(t).select("doc_id", "quality", "part", "n_words"))
    train = df.filter("part = 'train'")
    fitted = md.logistic_regression(train.count(), "quality", rounds=500, tolerance=1e-12)
    md.save_pipeline(md.fit_pipeline(train, ["n_words"], fitted), path)
    out = md.probability(md.load_pipeline(path).transform(df.filter("part = 'test'")), "score")
    decoded = F.when(F.col("prediction") == 1, "good").otherwise("poor")
    return out.select("doc_id", F.col("quality").alias("truth"), F.round("score", 4).alias("score"), decoded.alias("decoded"))


_GRID = {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 1.0]}
_GRID_SQL = ", ".join(
    "({}, {}, '{}')".format(reg, l1, repr([("elasticNetParam", l1), ("regParam", reg)]).replace("'", "''"))
    for reg in _GRID["regParam"]
    for l1 in _GRID["elasticNetParam"]
)


@query("m16_grid_search", f"""
WITH {_FOLDS},
grid AS (SELECT reg::DOUBLE AS reg, l1::DOUBLE AS l1, (row_number() OVER (ORDER BY md5('grid:' || name)) - 1)::INT AS run
         FROM (VALUES {_GRID_SQL}) v(reg, l1, name)),
m AS (SELECT k.fold AS fold, avg(x) AS mx, avg(quality) AS my, stddev_pop(x) AS sx, stddev_pop(quality) AS sy, corr(x, quality) AS rho
      FROM folded f JOIN (SELECT DISTINCT fold FROM folded) k ON f.fold <> k.fold GROUP BY k.fold),
w AS (SELECT run, reg, l1, m.*, sign(rho) * greatest(abs(rho) - reg * l1 / sy, 0) / (1 + reg * (1 - l1) / sy) * sy / sx AS slope
      FROM grid, m WHERE run < 4),
s AS (SELECT run, reg, l1, fold, sqrt(avg(pow(my + slope * (x - mx) - quality, 2))) AS rmse FROM folded JOIN w USING (fold) GROUP BY 1, 2, 3, 4)
SELECT run, reg, l1, round(avg(rmse), 6) AS rmse FROM s GROUP BY 1, 2, 3""")
def grid_search(t):
    df = folded_frame(t, 3)
    line = md.scaled_line(["x"], "quality")
    model = line.getStages()[-1]
    grid = md.random_grid(md.parameter_grid(model, _GRID), 4, "grid")
    found = md.search(df, line, grid, "quality", "fold", 3, RegressionEvaluator(labelCol="quality", metricName="rmse"))
    rows = [(i, p[model.regParam], p[model.elasticNetParam], float(m)) for i, (p, m) in enumerate(zip(grid, found.avgMetrics))]
    return t.spark.createDataFrame(rows, "run int, reg double, l1 double, rmse double").withColumn("rmse", F.round("rmse", 6))


@query("e10_cross_validation", f"""
WITH {_FOLDS}, {_LINES},
p AS (SELECT fold, avg((quality = (score >= 0.85)::INT)::INT) AS acc FROM oof GROUP BY fold)
SELECT round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std, count(*)::BIGINT AS folds FROM p""")
def cross_validation(t):
    out = md.out_of_fold(folded_frame(t, 3), md.scaled_line(["x"], "quality"), "fold", 3)
    out = out.withColumn("pred", (F.col("prediction") >= 0.85).cast("int"))
    return mx.fold_summary(out, "fold", "quality", "pred").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("e12_out_of_fold", f"WITH {_FOLDS}, {_LINES} SELECT doc_id, quality, fold, round(score, 6) AS score FROM oof")
def out_of_fold(t):
    out = md.out_of_fold(folded_frame(t, 3), md.scaled_line(["x"], "quality"), "fold", 3)
    return out.select("doc_id", "quality", F.col("fold").cast("int").alias("fold"), F.round("prediction", 6).alias("score"))


@query("f17_pca", """
WITH z AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
  (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem),
r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((a + sign(r) * b) / sqrt(2), 5) AS pc1, round((a - sign(r) * b) / sqrt(2), 5) AS pc2,
       round((1 + abs(r)) / 2, 6) AS share1, round((1 - abs(r)) / 2, 6) AS share2 FROM z, r""")
def pca(t):
    columns = ["l_quantity", "l_extendedprice"]
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    model, out = md.pca(t.lineitem.select(*keys, *columns), columns, 2)
    signs, shares = md.component_signs(model), model.explainedVariance.toArray().tolist()
    return out.select(
        *keys,
        *[F.round(md.vector_to_array("pca")[i] * s, 5).alias(f"pc{i + 1}") for i, s in enumerate(signs)],
        *[F.round(F.lit(s), 6).alias(f"share{i + 1}") for i, s in enumerate(shares)],
    )


@query("d8_learned_vectors")
def learned_vectors(t):
    """Parts and their suppliers: the most similar parts of three named ones, and the best parts for a list of suppliers."""
    links = t.lineitem.groupBy(F.concat(F.lit("part "), "l_partkey").alias("item"), F.concat(F.lit("supplier "), "l_suppkey").alias("tag")).agg(
        F.sum("l_quantity").alias("weight"))
    items, tags = md.item_tag_vectors(links, "item", "tag", "weight", rank=8)
    items, tags = md.materialize(sim.normalized(items, "vector")), sim.normalized(tags, "vector")
    named = items.filter(F.col("key").isin("part 1", "part 2", "part 3")).select(F.col("key").alias("query"), "vector")
    lists = t.spark.createDataFrame([("suppliers 1 and 2", "supplier 1"), ("suppliers 1 and 2", "supplier 2")], "query string, key string")
    return md.best_matches(items, named.unionByName(md.listed_vectors(tags, lists)), 10)
