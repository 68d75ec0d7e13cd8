"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to give ``target`` of its ``source_size`` words wants every document ``f = target / source_size``
times: ``floor(f)`` copies for sure and one more with probability ``f - floor(f)``. The fractions are rounded
pair by pair: words are moved from one document's fraction to another's, in a random direction that keeps every
expectation, until one of the two is whole. A pair keeps its sum of words, so a source's words are off by what
its last fraction is worth only.

The pairs form a reduction tree. Leaves are (source, size class, hash bucket) groups of about ``LEAF_ROWS``
rows, so a source with a third of all rows has many leaves; each passes on at most one fraction, ``FAN_IN``
of which meet in a node above, up to one fraction per size class (a quarter of a power of two of words). The root of a source
then chooses the last copies, one per class at most, so that the words come nearest to the target.

All draws are hashes of the seed and the two documents: reruns agree on any cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.rows import free_name
from loomframe.plans.checkpoints import materialize
from loomframe.plans.ordered import join_stats, row_numbers

LEAF_ROWS = 1024
FAN_IN = 64
CLASSES_PER_OCTAVE = 4  # size classes per doubling of the words
WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word is a run without ASCII white space
BEAM = 256  # partial sums kept while the root of a source picks its last copies


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): weights by code point order of the sources, null last, repeating.

    ``share`` of all words is dealt out by weight. What a source gets above ``most`` times its size goes to the
    others by their weights, until none is above. Each round is one aggregate over the sources; a round caps at
    least one more source.
    """
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = row_numbers(grouped, [F.col("source").asc_nulls_last()], out="_rank")
    values = F.array(*[F.lit(float(w)) for w in weights])
    table = placed.select(
        "source", "source_size", F.element_at(values, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("_weight"),
        (F.col("source_size") * float(most)).alias("_limit"),
    )
    table = materialize(table)
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1  # target = min(limit, weight * level)
    while True:
        above = F.col("_weight") * level >= F.col("_limit")
        row = table.agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, F.col("_limit")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))).alias("weight"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (total - row["fixed"]) / row["weight"]
    return table.select("source", "source_size", F.least(F.col("_limit"), F.col("_weight") * level).alias("target"))


def _draw(seed: str, first, second) -> float:
    digest = hashlib.blake2b(f"{seed}:{first}:{second}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") / 2**64


def pivot(sizes: np.ndarray, fractions: np.ndarray, keys: list, seed: str) -> np.ndarray:
    """Fractions after pairing in the given order; at most one is not 0 or 1, and words are kept."""
    out, held = fractions.astype(float).copy(), None
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        if held is None:
            held = i
            continue
        a, b = held, i
        up = ((1 - out[a]) * sizes[a], out[b] * sizes[b])  # words that a can take, that b can give
        down = (out[a] * sizes[a], (1 - out[b]) * sizes[b])
        gain, loss = min(up), min(down)
        if _draw(seed, keys[a], keys[b]) * (gain + loss) < loss:
            moved, full, empty = gain, up[0] <= up[1], up[1] <= up[0]
            out[a], out[b] = (1.0 if full else out[a] + moved / sizes[a]), (0.0 if empty else out[b] - moved / sizes[b])
        else:
            moved, empty, full = loss, down[0] <= down[1], down[1] <= down[0]
            out[a], out[b] = (0.0 if empty else out[a] - moved / sizes[a]), (1.0 if full else out[b] + moved / sizes[b])
        held = next((k for k in (a, b) if 0 < out[k] < 1), None)
    return out


def _reduce(seed: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "key", "row"], kind="stable", ignore_index=True)
        group["fraction"] = pivot(group["size"].to_numpy(), group["fraction"].to_numpy(), group["key"].tolist(), seed)
        return group

    return run


def _close(group: pd.DataFrame) -> pd.DataFrame:
    """Root of a source: of its few last fractions (one per size class), round so that words come nearest."""
    group = group.sort_values(["size", "key", "row"], ascending=False, kind="stable", ignore_index=True)
    wanted = float((group["size"] * group["fraction"]).sum())
    sums: dict[int, tuple[int, ...]] = {0: ()}
    left = int(group["size"].sum())
    for size in group["size"].tolist():
        left -= size
        sums = {**{s + size: taken + (1,) for s, taken in sums.items()}, **{s: taken + (0,) for s, taken in sums.items()}}
        if len(sums) > BEAM:  # those from which the smaller documents can come nearest
            miss = lambda s: max(s - wanted, wanted - s - left, 0.0)
            sums = dict(sorted(sums.items(), key=lambda x: (miss(x[0]), abs(wanted - x[0] - left / 2)))[:BEAM])
    best = min(sums, key=lambda s: (abs(s - wanted), s))
    group["fraction"] = np.array(sums[best], float)
    return group


def mix_plan(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0,
             seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             row_col: str | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every document.

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix takes the document, ``taken`` is
    ``copies * size``. A null source is a source of its own, last in order. Documents without words get the whole
    copies of their source only. Repeated ids and rows are documents of their own; with equal ids, sizes and
    sources they are interchangeable. Null ids are passed on, an empty table gives no rows, and other columns
    are not read. ``row_col`` passes one more column through, for joining the copies back.
    """
    row = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
    id_type = dict(docs.dtypes)[id_col]
    sizes = materialize(docs.select(F.col(id_col).cast("string").alias("key"), F.col(source_col).alias("source"), row.alias("row"), F.xxhash64(F.col(text_col)).alias("text"), word_count(F.col(text_col)).alias("size")))
    targets = materialize(source_targets(sizes.select("source", "size"), weights, share, most))
    level = F.when(F.col("size") > 0, F.floor(F.log2("size") * CLASSES_PER_OCTAVE)).otherwise(-1).cast("int")
    rows = join_stats(sizes.withColumn("class", level), targets, ["source"])
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(times).cast("long")).withColumn("fraction", times - F.floor(times))
    rows = rows.withColumn("fraction", F.when(F.col("size") == 0, 0.0).otherwise(F.col("fraction")))
    counts = sizes.withColumn("class", level).groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))
    leaves = F.greatest(F.ceil(F.col("n") / LEAF_ROWS), F.lit(1))
    rows = join_stats(rows, counts, ["source", "class"]).withColumn("node", F.pmod(F.xxhash64(F.lit(seed), "key", "size", "text"), leaves)).drop("n", "text")
    most_leaves = sizes.withColumn("class", level).groupBy("source", "class").count().agg(F.max("count")).first()[0] or 0
    nodes = -(-most_leaves // LEAF_ROWS)

    done, settled = None, F.col("fraction").isin(0.0, 1.0)
    while True:
        rows = materialize(rows.groupBy("source", "class", "node").applyInPandas(_reduce(seed), rows.schema))
        ready = rows.filter(settled)
        done = ready if done is None else done.unionByName(ready)
        rows = rows.filter(~settled)
        if nodes <= 1:
            break
        nodes = -(-nodes // FAN_IN)
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
    done = done.unionByName(rows.groupBy("source").applyInPandas(_close, rows.schema))
    copies = (F.col("whole") + F.col("fraction").cast("long")).alias("copies")
    return done.select(
        F.col("key").cast(id_type).alias(id_col), "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as ``mix_plan`` takes it, columns and their names as they are.

    Rows are numbered by their place in the input, which has to be recomputable (files or a checkpoint).
    """
    row, copies, one = (free_name(docs.columns, stem) for stem in ("_mix_row", "_mix_copies", "_mix_i"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    plan = mix_plan(numbered, row_col=row, **options).filter("copies > 0").select(F.col(row), F.col("copies").alias(copies))
    taken = numbered.join(plan, row).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
