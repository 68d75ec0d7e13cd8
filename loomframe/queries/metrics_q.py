"""Evaluation (E1-E9, E11) and voting."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import metrics as mx
from loomframe.queries.frames import preds
from loomframe.queries.sql import PREDS
from loomframe.registry import query


def _rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("e1_confusion_matrix", f"""
WITH {PREDS}, g AS (SELECT a AS truth, b AS pred FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
SELECT truth, pred, (SELECT count(*) FROM preds p WHERE p.quality = g.truth AND p.pred = g.pred)::BIGINT AS n,
       round((SELECT count(*) FROM preds p WHERE p.quality = g.truth AND p.pred = g.pred)::DOUBLE / (SELECT count(*) FROM preds), 6) AS share FROM g""")
def confusion_matrix(t):
    return _rounded(mx.confusion_matrix(preds(t), "quality", "pred"), "share")


_COUNTS = f"""{PREDS}, c AS (SELECT sum((quality = 1 AND pred = 1)::INT)::DOUBLE AS tp, sum((quality = 0 AND pred = 1)::INT) AS fp,
  sum((quality = 1 AND pred = 0)::INT) AS fn, avg((quality = pred)::INT) AS acc FROM preds)"""


@query("e2_binary_scores", f"""
WITH {_COUNTS} SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(acc, 6) AS accuracy FROM c""")
def binary_scores(t):
    return _rounded(mx.binary_scores(preds(t), "quality", "pred"), "precision", "recall", "f1", "accuracy")


@query("e3_classification_report", f"""
WITH {PREDS}, k AS (SELECT unnest([0, 1]) AS label),
c AS (SELECT label, (SELECT count(*) FROM preds WHERE quality = label AND pred = label)::DOUBLE AS tp,
             (SELECT count(*) FROM preds WHERE pred = label) AS np, (SELECT count(*) FROM preds WHERE quality = label) AS support FROM k),
s AS (SELECT label, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r,
             CASE WHEN np + support = 0 THEN 0 ELSE 2 * tp / (np + support) END AS f, support FROM c)
SELECT label::VARCHAR AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM s
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM s
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM s""")
def classification_report(t):
    return _rounded(mx.classification_report(preds(t), "quality", "pred"), "precision", "recall", "f1")


_ROC = f"""{PREDS}, tot AS (SELECT sum(quality)::DOUBLE AS p, sum(1 - quality)::DOUBLE AS n FROM preds),
sc AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM preds GROUP BY score),
roc AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM sc)"""


@query("e4_roc_points", f"""
WITH {_ROC} SELECT round(score, 6) AS score, round(cn / n, 6) AS fpr, round(cp / p, 6) AS tpr FROM roc, tot""")
def roc_points(t):
    return _rounded(mx.roc_points(preds(t), "quality", "score"), "score", "fpr", "tpr")


_AUC = f"""WITH {_ROC}, x AS (SELECT cn / n AS fpr, cp / p AS tpr, lag(cn / n, 1, 0) OVER (ORDER BY score DESC) AS f0,
  lag(cp / p, 1, 0) OVER (ORDER BY score DESC) AS t0 FROM roc, tot) SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM x"""


@query("e4_auc", _AUC)
def auc(t):
    return _rounded(mx.auc(preds(t), "quality", "score"), "auc")


@query("e5_youden_threshold", f"""
WITH {_ROC}, j AS (SELECT score, cn / n AS fpr, cp / p AS tpr, abs(cp / p - cn / n) AS j FROM roc, tot)
SELECT round(score, 6) AS score, round(j, 6) AS j, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM j ORDER BY j.j DESC, j.score DESC LIMIT 1""")
def youden_threshold(t):
    return _rounded(mx.youden_threshold(mx.roc_points(preds(t), "quality", "score")), "score", "j", "fpr", "tpr")


_CUTS = [round(0.40 + 0.01 * i, 2) for i in range(41)]  # fixed values: 0.40 to 0.80 in steps of 0.01
_SWEEP = f"""{PREDS}, cuts AS (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in _CUTS)}]) AS threshold),
sw AS (SELECT threshold, avg(((score > threshold)::INT = quality)::INT) AS accuracy FROM preds CROSS JOIN cuts GROUP BY threshold)"""


@query("e6_threshold_sweep", f"WITH {_SWEEP} SELECT threshold, round(accuracy, 6) AS accuracy FROM sw")
def threshold_sweep(t):
    return _rounded(mx.threshold_sweep(preds(t), "quality", "score", _CUTS), "accuracy")


@query("e6_best_threshold", f"""
WITH {_SWEEP} SELECT threshold, round(accuracy, 6) AS accuracy FROM sw ORDER BY sw.accuracy DESC, threshold LIMIT 1""")
def best_threshold(t):
    return _rounded(mx.best_threshold(mx.threshold_sweep(preds(t), "quality", "score", _CUTS)), "accuracy")


@query("e7_precision_recall", f"""
WITH {_ROC} SELECT round(score, 6) AS score, round(cp::DOUBLE / (cp + cn), 6) AS precision, round(cp / p, 6) AS recall FROM roc, tot""")
def precision_recall(t):
    return _rounded(mx.precision_recall_curve(preds(t), "quality", "score"), "score", "precision", "recall")


@query("e8_cautious_decision", f"""
WITH {PREDS} SELECT doc_id, CASE WHEN greatest(1 - score, score) > 0.5688 AND score > 1 - score THEN 1 ELSE 0 END AS decision FROM preds""")
def cautious_decision(t):
    score = F.col("score")
    return preds(t).select("doc_id", mx.cautious_decision([1 - score, score], 0.5688).alias("decision"))


@query("e9_mismatches", f"""
WITH {PREDS} SELECT doc_id, quality, pred, (SELECT count(*) FROM preds q WHERE q.quality = p.quality)::BIGINT AS class_size
FROM preds p WHERE quality <> pred""")
def mismatches(t):
    return mx.mismatches(preds(t), "doc_id", "quality", "pred")


@query("e10_fold_summary", f"""
WITH {PREDS}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM preds),
f AS (SELECT CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold,
             (quality = pred)::INT AS hit FROM r),
a AS (SELECT fold, avg(hit) AS acc FROM f GROUP BY fold)
SELECT round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std, count(*)::BIGINT AS folds FROM a""")
def fold_summary(t):
    from loomframe.operators.sampling import contiguous_folds

    folded = contiguous_folds(preds(t), ["doc_id"], 5)
    return _rounded(mx.fold_summary(folded, "fold", "quality", "pred"), "mean", "std")


@query("e11_residuals", """
SELECT round(avg(r), 4) AS bias, round(avg(r * r), 2) AS mse, round(avg(r * r) / 2, 2) AS cost
FROM (SELECT 2000 * l_quantity - l_extendedprice AS r FROM lineitem)""")
def residuals(t):
    df = t.lineitem.select("l_extendedprice", (F.col("l_quantity") * 2000).alias("guess"))
    out = mx.residual_summary(df, "l_extendedprice", "guess")
    return out.select(F.round("bias", 4).alias("bias"), F.round("mse", 2).alias("mse"), F.round("cost", 2).alias("cost"))


@query("m11_votes", f"""
WITH {PREDS} SELECT doc_id, round((score + score_q) / 2, 6) AS soft, ((score + score_q) / 2 > 0.5)::INT AS soft_class,
  (pred + pred_q + (quality = 1 AND toxic = 0)::INT >= 2)::INT AS hard_class, (pred + pred_q = 2)::INT AS tied_class FROM preds""")
def votes(t):
    third = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    soft = mx.soft_vote([F.col("score"), F.col("score_q")])
    return preds(t).select(
        "doc_id",
        F.round(soft, 6).alias("soft"),
        (soft > 0.5).cast("int").alias("soft_class"),
        mx.hard_vote([F.col("pred"), F.col("pred_q"), third]).alias("hard_class"),
        mx.hard_vote([F.col("pred"), F.col("pred_q")]).alias("tied_class"),
    )


@query("m12_weighted_vote", f"""
WITH {PREDS} SELECT doc_id, ((1.2::DOUBLE * score + 0.8::DOUBLE * score_q) / 2 >= 0.5)::INT AS decision FROM preds""")
def weighted_vote(t):
    return preds(t).select("doc_id", mx.weighted_vote(F.col("score"), F.col("score_q"), (1.2, 0.8)).alias("decision"))


@query("m15_best_run", f"""
WITH {PREDS}, runs AS (SELECT toxic, 'p' AS run, avg((pred = quality)::INT) AS accuracy FROM preds GROUP BY 1
  UNION ALL SELECT toxic, 'q', avg((pred_q = quality)::INT) FROM preds GROUP BY 1)
SELECT toxic, arg_min(run, (-accuracy, run)) AS run, round(max(accuracy), 6) AS accuracy FROM runs GROUP BY toxic""")
def best_run(t):
    df = preds(t)
    run = lambda name, pred: df.groupBy("toxic").agg(F.avg((F.col(pred) == F.col("quality")).cast("int")).alias("accuracy")).withColumn("run", F.lit(name))
    return _rounded(mx.best_run(run("p", "pred").unionByName(run("q", "pred_q")), "run", "accuracy", ["toxic"]), "accuracy")
