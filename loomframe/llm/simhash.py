"""SimHash near duplicates with a Gray-order hierarchical index.

Distinct fingerprints are sorted by their rank in Gray code order, where neighbours share most bits. Runs of
``FAN`` neighbours form a node, runs of ``FAN`` nodes a node above, and so on. A node keeps the bits that all its
members share (mask and pattern, "and" and "or" of the members). Two nodes differ at least in the bits where both
masks are set and the patterns disagree; if these are more than the limit, no pair below them can link and the
whole group is pruned, and what remains is opened one level further.

Shards are runs of the order; their nodes are the top of the index. Pairs of shards that survive there, a shard
with itself included, are compared in tasks of their own, from their top nodes down to the fingerprints. Links are
merged on the spot: a task passes on one link per pair of groups that were not connected yet, so a dense ball of
near copies gives as many rows as it has members, not as many as it has pairs. All links between different
fingerprints within the limit are found; no bucket or candidate list is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.components import components
from loomframe.llm.rows import free_name, without_rows
from loomframe.llm.tokens import bounded, text_buffer
from loomframe.plans.checkpoints import materialize

SEED = 42
FAN = 8
SHARD = 8192  # distinct fingerprints of a shard, more where there would be over ``SHARDS`` of them
SHARDS = 4096  # bounds what the driver sees of the index: two integers per shard
FRONTIER = 1 << 20  # node pairs opened at once


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the XXH64 values of all word shingles, ASCII letters lowered; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # for bytes, these are the ASCII letters and ASCII white space
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bounded(batches):
            raw, offsets = text_buffer(table["text"])
            data, ends = raw.tobytes(), offsets.tolist()
            values = np.array([fingerprint(data[a:b], shingle) for a, b in zip(ends, ends[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), pa.array(values.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), rows.select("id").schema.add("fp", "long"))


def gray_key(fp: Column) -> Column:
    """Rank of a fingerprint in Gray code order, shifted so that signed order is rank order."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(2**63)).cast("long"))


class Index:
    """Hierarchical index of sorted fingerprints: ``low[k]`` / ``high[k]`` are the and / or of level k's runs."""

    def __init__(self, fps: np.ndarray):
        self.low, self.high = [fps], [fps]
        while len(self.low[-1]) > FAN:
            runs = np.arange(0, len(self.low[-1]), FAN)
            self.low.append(np.bitwise_and.reduceat(self.low[-1], runs))
            self.high.append(np.bitwise_or.reduceat(self.high[-1], runs))

    @property
    def top(self) -> int:
        return len(self.low) - 1


def differing(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Bits in which every member of one node differs from every member of the other."""
    return np.bitwise_count((low_a & ~high_b) | (low_b & ~high_a))


class Labels:
    """Groups of connected leaves: ``of[i]`` is the smallest leaf known to be connected with ``i``."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Connect the pairs; positions of one pair for each two groups that were apart."""
        x, y = self.of[a], self.of[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = np.flatnonzero(low != high)
        if not len(apart):
            return apart
        _, first = np.unique(low[apart] * len(self.of) + high[apart], return_index=True)
        kept = apart[first]
        low, high = low[kept], high[kept]
        while True:
            np.minimum.at(self.of, self.of[high], self.of[low])
            np.minimum.at(self.of, self.of[low], self.of[high])
            while True:  # every leaf points to the end of its chain
                jump = self.of[self.of]
                if (jump == self.of).all():
                    break
                self.of = jump
            if (self.of[low] == self.of[high]).all():
                return kept


def _runs(labels: np.ndarray, levels: int) -> list[np.ndarray]:
    """Per level the label that a whole run shares, or -1."""
    out = [labels]
    for _ in range(levels):
        runs = np.arange(0, len(out[-1]), FAN)
        low, high = np.minimum.reduceat(out[-1], runs), np.maximum.reduceat(out[-1], runs)
        out.append(np.where(low == high, low, -1))
    return out


def shard_links(a: np.ndarray, b: np.ndarray | None, limit: int) -> np.ndarray:
    """Links (rows of two fingerprints) that connect what lies within ``limit`` bits.

    ``b`` None compares a shard with itself. Otherwise links inside ``a`` and inside ``b`` are taken as known where
    Gray neighbours link, since the shards' own tasks give them.
    """
    own = b is None
    left, right = Index(a), Index(a if own else b)
    shift = 0 if own else len(a)
    labels, found = Labels(shift + len(right.low[0])), []
    for fps, base in ((a, 0),) if own else ((a, 0), (b, shift)):
        near = np.flatnonzero(np.bitwise_count(fps[1:] ^ fps[:-1]) <= limit)
        kept = near[labels.join(base + near, base + near + 1)]
        if own:
            found.append(np.stack([fps[kept], fps[kept + 1]], axis=1))
    fresh = True
    pairs = np.array([(i, j) for i in range(len(left.low[-1])) for j in range(len(right.low[-1])) if not own or i <= j], np.int64).reshape(-1, 2)
    stack = [(left.top, right.top, pairs[:, 0], pairs[:, 1])]
    while stack:
        i, j, x, y = stack.pop()
        if len(x) > FRONTIER // FAN:  # open a part of it first, so that groups merge early and memory stays bounded
            half = len(x) // 2
            stack += [(i, j, x[half:], y[half:]), (i, j, x[:half], y[:half])]
            continue
        if fresh:
            same_left, same_right = _runs(labels.of[: len(a)], left.top), _runs(labels.of[shift:], right.top)
            fresh = False
        known = same_left[i][x]
        open_ = (known < 0) | (known != same_right[j][y])
        x, y = x[open_], y[open_]
        near = differing(left.low[i][x], left.high[i][x], right.low[j][y], right.high[j][y]) <= limit
        x, y = x[near], y[near]
        if not len(x):
            continue
        if i == 0 and j == 0:
            kept = labels.join(x, shift + y)
            if len(kept):
                found.append(np.stack([a[x[kept]], right.low[0][y[kept]]], axis=1))
                fresh = True
            continue
        if i >= j:  # open the higher node
            x, y = (x[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(y, FAN)
            i -= 1
            inside = x < len(left.low[i])
        else:
            x, y = np.repeat(x, FAN), (y[:, None] * FAN + np.arange(FAN)).ravel()
            j -= 1
            inside = y < len(right.low[j])
        if own and i == j:
            inside &= x <= y
            if i == 0:
                inside &= x < y
        stack.append((i, j, x[inside], y[inside]))
    return np.concatenate(found) if found else np.empty((0, 2), np.uint64)


def _codes(keys) -> np.ndarray:
    """Fingerprints of sorted Gray keys."""
    rank = np.asarray(keys, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return rank ^ (rank >> np.uint64(1))


def _link_task(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (_codes(batch.column(k)[row].values.to_numpy()) for k in ("keys", "others"))
                own = batch.column("i")[row].as_py() == batch.column("j")[row].as_py()
                links = shard_links(a, None if own else b, limit).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def near_links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b) links that connect the distinct values of ``fp`` exactly as all pairs within ``limit`` bits do."""
    spark = fps.sparkSession
    keyed = materialize(fps.select("fp").filter("fp is not null").distinct().withColumn("key", gray_key(F.col("fp"))))
    n = keyed.count()
    shards = max(1, min(SHARDS, -(-n // SHARD)))
    probabilities = [k / shards for k in range(1, shards)]
    cuts = sorted(set(keyed.agg(F.percentile_approx("key", probabilities, 20 * shards + 10_000)).first()[0] or [])) if probabilities and n else []
    bounds = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(), "right").astype(np.int32))

    tagged = keyed.withColumn("shard", shard_of("key"))
    # A shard holds a bounded number of distinct values, so that a list of them is a bounded row.
    shard_rows = materialize(tagged.groupBy("shard").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high")))
    top = shard_rows.select("shard", "low", "high").orderBy("shard").toPandas()
    number, low, high = top["shard"].to_numpy(), top["low"].to_numpy(np.int64).view(np.uint64), top["high"].to_numpy(np.int64).view(np.uint64)
    near = [(number[k : k + 1].repeat(hit.sum()), number[k:][hit]) for k in range(len(number)) for hit in [differing(low[k], high[k], low[k:], high[k:]) <= limit]]
    i, j = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (zip(*near) if near else ((), ())))
    pairs = spark.createDataFrame(pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32)}), "i int, j int")
    pairs = pairs.join(shard_rows.select(F.col("shard").alias("i"), "keys"), "i").join(shard_rows.select(F.col("shard").alias("j"), F.col("keys").alias("others")), "j")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, "i", "j").mapInArrow(_link_task(limit), "a long, b long")


def near_groups(docs: DataFrame, *, limit: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id reachable over links of
    ``limit`` or fewer differing bits, the row's own included, and null only where all ids reachable are null.
    A null or empty text, or one of white space only, has fingerprint zero and links like any other. Repeated
    rows and ids are passed on. An empty table gives no rows. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle))
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(near_links(classes, limit), "a", "b")
    placed = materialize(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    members = materialize(placed.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id"))
    joined = rows.join(members, F.col("fp") == F.col("_fp"))
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, *, limit: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id (null last), then the first of the input.

    Columns and their names stay as they are. The input has to be recomputable (files or a checkpoint).
    """
    row = free_name(docs.columns, "_near_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    groups = near_groups(numbered.select(F.col(row), F.col(text_col)), limit=limit, shingle=shingle, id_col=row, text_col=text_col)
    named = groups.select(F.col(row).alias("_r"), "component_id").join(numbered.select(F.col(row), F.col(id_col).alias("_id")), F.col("_r") == F.col(row))
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id").alias("id"), F.col("_r").alias("r")))["r"].alias("best"))
    dropped = named.join(materialize(best), "component_id").filter("_r <> best").select(F.col("_r").alias(row))
    return without_rows(numbered, row, materialize(dropped))
