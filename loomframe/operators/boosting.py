"""Boosted trees of two classes (0/1) from weighted histograms.

Features are cut into bins once and each partition becomes one block of arrays, checkpointed and then cached. From then
on a round needs sums by (node, feature, bin) only: each task adds up its block, and the sums, bounded however long the
table is, are added across tasks; the driver picks the splits from them. No round has a plan to make or code to compile,
so that hundreds of rounds cost little more than their arithmetic. A tree is a few numbers; the trees of a model are one
constant array, and scores are one expression over it. Weights are brought up to date every few rounds.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.plans.checkpoints import materialize

BINS = 64  # of a feature: its distinct values if there are no more of them, else quantiles
REFRESH = 20  # rounds between two updates of the cached weights
TASK_ROWS = 50_000  # rows that a task sums up in a round; fewer tasks make shorter rounds
DRIVER_PARTS = 32  # partial sums that go to the driver one by one; more are added up by tasks first
DIGITS = 10  # after which two splits count as equally good; the first feature and the lowest cut win


# -- bins --------------------------------------------------------------------------------------------------------


def fit_cuts(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Ascending cuts of each feature; a value lies in the bin of the first cut that it does not exceed.

    One pass; at most ``bins`` values a feature come back. Nulls make no cut.
    """
    accuracy, shares = 100 * bins, [(k + 1) / bins for k in range(bins - 1)]
    value = lambda c: F.col(c).cast("double")
    row = df.agg(
        *[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(value(c), shares, accuracy).alias(f"q{i}") for i, c in enumerate(columns)],
    ).first()
    few = [i for i in range(len(columns)) if row[f"n{i}"] <= 0.9 * bins]  # the estimate is off by a few per cent
    sets = df.agg(*[F.sort_array(F.collect_set(value(columns[i]))).alias(f"s{i}") for i in few]).first() if few else {}
    cuts = [sorted(set(sets[f"s{i}"] if i in few else row[f"q{i}"] or [])) for i in range(len(columns))]
    return [c[:-1] if i in few else c for i, c in enumerate(cuts)]  # the largest value needs no cut


def binned(df: DataFrame, columns: Sequence[str], cuts: Sequence[Sequence[float]], out: str = "bins") -> DataFrame:
    """``out``: the bin of each feature, from 0; nulls lie in the lowest bin."""

    def place(c: str, own: Sequence[float]) -> Column:
        if not own:
            return F.lit(0)
        return F.coalesce(F.size(F.filter(F.array(*[F.lit(float(x)) for x in own]), lambda cut: F.col(c).cast("double") > cut)), F.lit(0))

    return df.withColumn(out, F.array(*[place(c, own) for c, own in zip(columns, cuts)]))


def _block_task():
    """Task function: the rows of a partition as one block of arrays by column name; lists become one array per place."""

    def run(batches):
        there = [b for b in batches if b.num_rows]
        if not there:
            return
        table, block = pa.Table.from_batches(there), {}
        for name in table.column_names:
            cells = table.column(name).combine_chunks()
            if pa.types.is_list(cells.type):
                values = cells.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).T
                block[name] = np.packbits(values.astype(bool), axis=1) if values.dtype == bool else np.ascontiguousarray(values, dtype=np.uint16)
            else:
                block[name] = cells.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return run


def _blocks(df: DataFrame) -> RDD:
    """Blocks of about ``TASK_ROWS`` rows, read from a checkpoint whenever they are asked for; ``df`` is one itself."""
    even = df.repartition(max(1, math.ceil(df.count() / TASK_ROWS)))
    stored = materialize(even.mapInArrow(_block_task(), "block binary"))
    return stored.rdd.map(lambda row: pickle.loads(row[0]))


def _cached(blocks: RDD, update: Callable[[dict], dict], former: RDD | None = None) -> RDD:
    """Blocks after ``update``, kept by the executors; made from the checkpoint, so that no lineage grows."""
    if former is not None:
        former.unpersist()
    return blocks.map(update).persist(StorageLevel.MEMORY_AND_DISK)


def _total(blocks: RDD, sums: Callable[[dict], np.ndarray]):
    """Sum of the blocks' arrays; 0.0 without blocks."""
    parts = blocks.map(sums)
    return parts.fold(0.0, add) if parts.getNumPartitions() <= DRIVER_PARTS else parts.treeAggregate(0.0, add, add)


# -- AdaBoost on stumps ------------------------------------------------------------------------------------------


@dataclass
class Stumps:
    """Members (feature, last bin of the left side, class left, class right, say) over the cuts of the columns."""

    columns: list[str]
    cuts: list[list[float]]
    members: list[tuple[int, int, int, int, float]] = field(default_factory=list)


def _members(members: Sequence[tuple]) -> str:
    """The members as a constant array; text, since thousands of column calls would take longer than a round."""
    return "array(" + ", ".join(f"named_struct('f', {f}, 'c', {c}, 'l', {a}, 'r', {b}, 'say', {say!r}D)" for f, c, a, b, say in members) + ")"


def _say(members: Sequence[tuple], bins: str, worth: str) -> Column:
    """Sum of ``worth`` over the members, in which ``m`` is the member and ``vote`` its class."""
    vote = f"if(get({bins}, m.f) <= m.c, m.l, m.r)"
    return F.expr(f"aggregate({_members(members)}, 0D, (total, m) -> total + {worth.replace('vote', vote)})")


def best_stump(hist: np.ndarray) -> tuple[int, int, int, int, float] | None:
    """(feature, bin, left class, right class, share of weight that errs) from ``hist[feature, bin, class]``.

    The least weighted Gini impurity wins, as in a tree of depth 1.
    """
    total = hist[0].sum()
    left = hist.cumsum(axis=1)
    right = left[:, -1:, :] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = sum(2 * side[..., 0] * side[..., 1] / side.sum(axis=2) for side in (left, right)) / total
    usable = (left.sum(axis=2) > 1e-12 * total) & (right.sum(axis=2) > 1e-12 * total)
    impurity = np.where(usable, np.round(impurity, DIGITS), np.inf)
    if not usable.any():
        return None
    f, c = (int(x) for x in np.unravel_index(np.argmin(impurity), impurity.shape))
    classes = [int(side[f, c, 1] > side[f, c, 0]) for side in (left, right)]
    wrong = sum(side[f, c, 1 - k] for side, k in zip((left, right), classes))
    return f, c, *classes, float(wrong / total)


def _stump_says():
    """Function of (block, members): the say of the members that err on each row, summed."""

    def errs(block: dict, members: Sequence[tuple]) -> np.ndarray:
        total = np.zeros(len(block["y"]))
        for f, c, left, right, say in members:
            total[np.where(block["bins"][f] <= c, left, right) != block["y"]] += say
        return total

    return errs


def _reweighted(members: Sequence[tuple], scale: float):
    errs, members = _stump_says(), list(members)

    def run(block: dict) -> dict:
        return {**block, "w": block["w"] * np.exp(errs(block, members) - scale)}

    return run


def _stump_sums(members: Sequence[tuple], n_bins: int):
    """Task function: weights by feature, bin and class after the given members."""
    errs, members = _stump_says(), list(members)

    def run(block: dict) -> np.ndarray:
        w, y = block["w"] * np.exp(errs(block, members)), block["y"].astype(np.int64)
        return np.stack([np.bincount(2 * b.astype(np.int64) + y, w, 2 * n_bins).reshape(n_bins, 2) for b in block["bins"]])

    return run


def ada_stumps(df: DataFrame, columns: Sequence[str], label: str, rounds: int = 500, rate: float = 0.3, bins: int = BINS) -> Stumps:
    """AdaBoost (Freund and Schapire, 1997) with trees of depth 1.

    Rows with the same bins and class always weigh the same, so they are one row with a count from the start. The
    boosting ends early when a stump errs on half of the weight, or on nothing (it then has the say alone). A round is
    one job.
    """
    model = Stumps(list(columns), fit_cuts(df, columns, bins))
    n_bins = max((len(c) for c in model.cuts), default=0) + 1
    cells = binned(df, columns, model.cuts).groupBy("bins", F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    base = _blocks(materialize(cells.filter("y IS NOT NULL")))
    now, pending, total, scale = _cached(base, _reweighted([], 0.0)), [], 1.0, 0.0
    for _ in range(rounds):
        if len(pending) == REFRESH:
            scale += math.log(total)
            now, pending = _cached(base, _reweighted(model.members, scale), now), []
        hist = _total(now, _stump_sums(pending, n_bins))
        stump = best_stump(hist) if isinstance(hist, np.ndarray) and len(columns) else None
        if stump is None or stump[4] >= 0.5:
            break
        error, total = stump[4], float(hist[0].sum())
        if error <= 0:
            model.members.append((*stump[:4], 1.0))
            break
        member = (*stump[:4], rate * math.log((1 - error) / error))
        model.members.append(member)
        pending.append(member)
    now.unpersist()
    return model


def ada_score(df: DataFrame, model: Stumps, out: str = "ada") -> DataFrame:
    """Share of the say that votes for class 1; 0 for a model without members."""
    if not model.members:
        return df.withColumn(out, F.lit(0.0))
    votes = _say(model.members, "_bins", "vote * m.say")
    return binned(df, model.columns, model.cuts, "_bins").withColumn(out, votes / F.lit(sum(m[4] for m in model.members))).drop("_bins")


# -- gradient boosting -------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete trees: per inner node (heap order) a feature and the last bin that goes left, per leaf a value."""

    columns: list[str]
    cuts: list[list[float]]
    depth: int
    start: float = 0.0
    trees: list[tuple[list[int], list[int], list[float]]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # of the validation rows, after each round


def _node(bins: str, tree: str, depth: int) -> str:
    """Heap place (from 0) that a row reaches in ``depth`` steps."""
    at = "0"
    for _ in range(depth):
        at = f"(2 * {at} + if(get({bins}, get({tree}.f, {at})) > get({tree}.c, {at}), 2, 1))"
    return at


def _tree(tree: tuple) -> str:
    f, c, v = tree
    return f"named_struct('f', array({', '.join(map(str, f))}), 'c', array({', '.join(map(str, c))}), 'v', array({', '.join(f'{x!r}D' for x in v)}))"


def _raw(bins: str, trees: Sequence[tuple], depth: int) -> Column:
    if not trees:
        return F.lit(0.0)
    leaf = f"get(t.v, {_node(bins, 't', depth)} - {2**depth - 1})"
    return F.expr(f"aggregate(array({', '.join(_tree(t) for t in trees)}), 0D, (total, t) -> total + {leaf})")


def best_split(hist: np.ndarray) -> tuple[int, int] | None:
    """(feature, last bin of the left side) from ``hist[feature, bin, (n, gradient, curvature)]``, or None."""
    left = hist.cumsum(axis=1)
    right = left[:, -1:, :] - left
    usable = (left[..., 0] > 0) & (right[..., 0] > 0)
    if not usable.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0]
    whole = left[0, -1]
    gain = np.where(usable, np.round((gain - whole[1] ** 2 / whole[0]) / whole[0], DIGITS), -np.inf)
    f, c = (int(x) for x in np.unravel_index(np.argmax(gain), gain.shape))
    return (f, c) if gain[f, c] > 0 else None


def _step(sums: np.ndarray) -> float:
    """Newton step of a leaf."""
    return float(sums[1] / sums[2]) if sums[2] > 1e-150 else 0.0


def _walker():
    """Function of (bins, features, cuts, steps): the place among the nodes of that level that each row reaches."""

    def walk(bins: np.ndarray, features: Sequence[int], cuts: Sequence[int], steps: int) -> np.ndarray:
        rows, at = np.arange(bins.shape[1]), np.zeros(bins.shape[1], np.int64)
        features, cuts = np.asarray(features), np.asarray(cuts)
        for _ in range(steps):
            at = 2 * at + 1 + (bins[features[at], rows] > cuts[at])
        return at - (2**steps - 1)

    return walk


def _scored(trees: Sequence[tuple], depth: int):
    """Task function: blocks whose ``raw`` has the trees added."""
    walk, trees = _walker(), list(trees)

    def run(block: dict) -> dict:
        raw = block["raw"]
        for features, cuts, values in trees:
            raw = raw + np.asarray(values)[walk(block["bins"], features, cuts, depth)]
        return {**block, "raw": raw}

    return run


def _level_sums(trees: Sequence[tuple], depth: int, features: Sequence[int], cuts: Sequence[int], level: int, n_bins: int, i: int):
    """Task function for one level of round ``i``: n, gradient and curvature by (node, feature, bin), then the number and
    the loss of the validation rows after ``trees``."""
    walk, score, features, cuts = _walker(), _scored(trees, depth), list(features), list(cuts)

    def run(block: dict) -> np.ndarray:
        held, y, raw = block["held"], block["y"], score(block)["raw"]
        on = np.flatnonzero(~held & np.unpackbits(block["used"][i], count=len(y)).astype(bool))
        bins, p = block["bins"][:, on], 1 / (1 + np.exp(-raw[on]))
        node = walk(bins, features, cuts, level) * n_bins
        gradient, size = np.nan_to_num(y[on] - p), 2**level * n_bins
        hist = np.zeros((2**level, len(bins), n_bins, 3))
        for f, b in enumerate(bins):
            for k, worth in enumerate((None, gradient, p * (1 - p))):
                hist[:, f, :, k] = np.bincount(node + b, worth, size).reshape(2**level, n_bins)
        loss = np.log1p(np.exp(raw[held])) - y[held] * raw[held] if not level else []
        return np.concatenate([hist.ravel(), [np.count_nonzero(held), np.nansum(loss)]])

    return run


def gradient_trees(df: DataFrame, columns: Sequence[str], label: str, key: Sequence[str], rounds: int = 200, rate: float = 0.1, depth: int = 3, subsample: float = 0.9,
                   validation: float = 0.1, patience: int = 15, tolerance: float = 1e-4, bins: int = BINS, seed: str = "boost") -> Trees:
    """Gradient boosting of the logistic loss with early stop (Friedman, 2001 and 2002).

    A share ``validation`` of the rows, drawn by seeded hash of ``key``, is set aside; boosting ends when its loss was not
    better by ``tolerance`` than any of the last ``patience`` ones. Each round fits a tree of ``depth`` on a share
    ``subsample`` of the other rows, drawn anew. A round is one job per level; the first one also gives
    the loss after the round before.
    """
    model = Trees(list(columns), fit_cuts(df, columns, bins), depth)
    n_bins = max((len(c) for c in model.cuts), default=0) + 1
    draw = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts, *key), F.lit(1_000_000)) / 1_000_000
    rows = binned(df, columns, model.cuts).select(*key, "bins", F.col(label).cast("double").alias("y"), (draw(F.lit("held")) < validation).alias("held"))
    rows = materialize(rows)
    base = rows.filter("NOT held").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).first()
    if not base["n"] or base["ones"] in (0, base["n"]):
        model.start = 50.0 if base["n"] and base["ones"] else -50.0
        return model
    model.start = math.log(base["ones"] / (base["n"] - base["ones"]))
    used = F.transform(F.sequence(F.lit(0), F.lit(rounds)), lambda i: draw(i) < subsample)  # one bit a round
    blocks = _blocks(rows.select("bins", "y", "held", F.lit(model.start).alias("raw"), used.alias("used")))
    now = _cached(blocks, _scored([], depth))
    pending: list[tuple] = []
    history = [math.inf] * patience

    for i in range(rounds + 1):
        if len(pending) == REFRESH:
            now, pending = _cached(blocks, _scored(model.trees, depth), now), []
        features, cuts, values = [0] * (2**depth - 1), [n_bins] * (2**depth - 1), [0.0] * 2**depth
        for level in range(depth):
            first = 2**level - 1
            sums = _total(now, _level_sums(pending, depth, features, cuts, level, n_bins, i))
            hist, (n_held, loss) = sums[:-2].reshape(2**level, len(columns), n_bins, 3), sums[-2:]
            if not level and i:
                model.losses.append(float(loss / n_held) if n_held else math.nan)
                if (n_held and not any(model.losses[-1] + tolerance < h for h in history)) or i == rounds:
                    now.unpersist()
                    return model
                history[(i - 1) % patience] = model.losses[-1] if n_held else math.inf
            for node in range(2**level):
                split = best_split(hist[node]) if hist[node, 0, :, 0].sum() > 0 else None
                if split:
                    features[first + node], cuts[first + node] = split
                if level == depth - 1:  # what does not split goes left, and so do all below it
                    f, c = split or (0, n_bins - 1)
                    sides = hist[node, f, : c + 1].sum(axis=0), hist[node, f, c + 1 :].sum(axis=0)
                    values[2 * node], values[2 * node + 1] = (rate * _step(s) for s in sides)
        model.trees.append((features, cuts, values))
        pending.append((features, cuts, values))
    return model


def gradient_score(df: DataFrame, model: Trees, out: str = "boosted") -> DataFrame:
    """Probability of class 1."""
    raw = F.lit(model.start) + _raw("_bins", model.trees, model.depth)
    return binned(df, model.columns, model.cuts, "_bins").withColumn(out, 1 / (1 + F.exp(-raw))).drop("_bins")
