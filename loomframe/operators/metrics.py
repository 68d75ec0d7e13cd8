"""Evaluation as aggregations over (truth, prediction, score) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.plans.ordered import join_stats, running_sums


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero when b is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n, share) on the full grid of seen classes, of any one type; shares are of all rows.

    Null labels are no class: their rows count in the total only.
    """
    seen = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    labels = seen.select(F.col("truth").alias("v")).union(seen.select("pred")).agg(F.collect_set("v").alias("v"))  # one entry per class
    grid = labels.select("v", F.explode("v").alias("truth")).select("truth", F.explode("v").alias("pred"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    filled = grid.join(seen, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return filled.withColumn("share", F.col("n") / total)


def binary_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: precision, recall, f1, accuracy of class 1; zero divisions give zero."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    counts = df.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(F.col(truth) == F.col(pred)).alias("hits"), F.count(F.lit(1)).alias("n"),
    )
    scored = counts.withColumns(
        {"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    )
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select("precision", "recall", f1.alias("f1"), ratio(F.col("hits"), F.col("n")).alias("accuracy"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support) per class, then ``macro avg`` and ``weighted avg``."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("support"))
    p = df.groupBy(F.col(pred).alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    hit = df.filter(F.col(truth) == F.col(pred)).groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("tp"))
    merged = t.join(p, "label", "full").join(hit, "label", "left").na.fill(0, ["support", "predicted", "tp"])
    scored = merged.withColumns(
        {"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))}
    ).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    columns = ["precision", "recall", "f1"]
    per_class = scored.select(F.col("label").cast("string").alias("label"), *columns, "support")
    macro = scored.agg(*[F.avg(c).alias(c) for c in columns], F.sum("support").alias("support"))
    weighted = scored.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in columns], F.sum("support").alias("support")
    )
    return per_class.unionByName(macro.withColumn("label", F.lit("macro avg"))).unionByName(
        weighted.withColumn("label", F.lit("weighted avg"))
    )


def score_steps(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, cum_pos, cum_neg): positives and negatives at or above each distinct score."""
    steps = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    return running_sums(steps, ["pos", "neg"], [F.desc("score")])


def _totals(df: DataFrame, truth: str) -> tuple[Column, Column]:
    return (
        df.agg(F.count_if(F.col(truth) == 1).alias("p")).scalar(),
        df.agg(F.count_if(F.col(truth) != 1).alias("n")).scalar(),
    )


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, fpr, tpr) at every distinct score."""
    pos, neg = _totals(df, truth)
    return score_steps(df, truth, score).select(
        "score", (F.col("cum_neg") / neg).alias("fpr"), (F.col("cum_pos") / pos).alias("tpr")
    )


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: area under the ROC curve by trapezoids; each step knows where it starts."""
    pos, neg = _totals(df, truth)
    steps = score_steps(df, truth, score)
    height = F.col("cum_pos") - F.col("pos") / 2
    area = steps.agg(F.sum(F.col("neg") * height).alias("area"))
    return area.select((F.col("area") / (pos * neg)).alias("auc"))


def youden_threshold(roc: DataFrame) -> DataFrame:
    """One row: the score with the largest abs(tpr - fpr), the highest on ties."""
    best = roc.agg(F.max(F.struct(F.abs(F.col("tpr") - F.col("fpr")).alias("j"), "score", "fpr", "tpr")).alias("b"))
    return best.select("b.score", "b.j", "b.fpr", "b.tpr")


def threshold_sweep(df: DataFrame, truth: str, score: str, thresholds: Sequence[float], at_least: bool = False) -> DataFrame:
    """(threshold, accuracy) for every cut in one pass."""
    above = (lambda c: F.col(score) >= c) if at_least else (lambda c: F.col(score) > c)
    cells = df.agg(
        *[F.avg((above(F.lit(c)).cast("int") == F.col(truth)).cast("int")).alias(f"_{i}") for i, c in enumerate(thresholds)]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("threshold"), F.col(f"_{i}").alias("accuracy")) for i, c in enumerate(thresholds)])
    return cells.select(F.explode(rows).alias("r")).select("r.*")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """One row: the first threshold with the best accuracy."""
    best = sweep.agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "threshold")).alias("b"))
    return best.select("b.threshold", (-F.col("b.a")).alias("accuracy"))


def precision_recall_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, precision, recall) at every distinct score."""
    pos, _ = _totals(df, truth)
    taken = F.col("cum_pos") + F.col("cum_neg")
    return score_steps(df, truth, score).select(
        "score", (F.col("cum_pos") / taken).alias("precision"), (F.col("cum_pos") / pos).alias("recall")
    )


def cautious_decision(probabilities: Sequence[Column], cut: float) -> Column:
    """The most probable class, but only above the cut; else class 0."""
    values = F.array(*probabilities)
    best = F.array_max(values)
    return F.when(best > cut, F.array_position(values, best) - 1).otherwise(0).cast("int")


def mismatches(df: DataFrame, key: str, truth: str, pred: str) -> DataFrame:
    """Rows predicted wrongly, with the size of their real class."""
    sizes = df.groupBy(truth).agg(F.count(F.lit(1)).alias("class_size"))
    wrong = df.filter(F.col(truth) != F.col(pred)).select(key, truth, pred)
    return join_stats(wrong, sizes, [truth])


def residual_summary(df: DataFrame, real: str, predicted: str) -> DataFrame:
    """One row: mean residual (predicted - real), mse, and half mse as the regression cost."""
    r = F.col(predicted) - F.col(real)
    return df.agg(F.avg(r).alias("bias"), F.avg(r * r).alias("mse"), (F.avg(r * r) / 2).alias("cost"))


def fold_summary(df: DataFrame, fold: str, truth: str, pred: str) -> DataFrame:
    """One row: accuracy per fold averaged, with population std."""
    per_fold = df.groupBy(fold).agg(F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy"))
    return per_fold.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"), F.count(F.lit(1)).alias("folds"))


def hard_vote(votes: Sequence[Column]) -> Column:
    """Majority class of 0/1 votes; a tie goes to the smaller class."""
    ones = sum((v.cast("int") for v in votes), F.lit(0))
    return (ones * 2 > len(votes)).cast("int")


def soft_vote(scores: Sequence[Column]) -> Column:
    return sum(scores, F.lit(0.0)) / len(scores)


def weighted_vote(a: Column, b: Column, weights: tuple[float, float], cut: float = 0.5) -> Column:
    """(w0 a + w1 b) / 2 at or above the cut."""
    return (((a * F.lit(weights[0]) + b * F.lit(weights[1])) / 2) >= cut).cast("int")


def best_run(runs: DataFrame, name: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """The best-scoring run, the first name on ties."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias("b")
    out = runs.groupBy(*group).agg(best) if group else runs.agg(best)
    return out.select(*group, F.col("b.n").alias(name), (-F.col("b.s")).alias(score))
