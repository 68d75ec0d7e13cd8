"""Fingerprints, exact and near duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from loomframe.functions.text import words
from loomframe.functions.vectors import doubles
from loomframe.operators.window import flag_repeats
from loomframe.plans.checkpoints import materialize
from loomframe.plans.ordered import join_stats, row_numbers

_MAX_CHOICES = 100  # bucket rows per key
_BLOCK = 128  # members of a bucket compared inside one array
_WORK = 4_000_000  # comparisons in a bucket that is not split any further
_TASK_MEMBERS = 16_384  # members of a bucket that one task holds


def median_bits(vector: Column | str, dims: int) -> Column:
    """Fingerprint of a vector: bit = value >= median, packed into dims / 4 hex digits."""
    v = doubles(vector)
    ordered = F.concat(F.sort_array(F.array_compact(v)), F.filter(v, F.isnull))  # nulls last; array_sort calls a comparator
    median = (F.element_at(ordered, (dims + 1) // 2) + F.element_at(ordered, dims // 2 + 1)) / 2
    bits = F.element_at(
        F.transform(F.array(median), lambda m: F.array_join(F.transform(v, lambda x: F.when(x >= m, "1").otherwise("0")), "")), 1
    )
    chunks = [F.lower(F.conv(F.substring(bits, i + 1, 4), 2, 16)) for i in range(0, dims, 4)]
    return F.concat(*chunks)


def _cell_counts(cells: int):
    """(key, cell, n) of each row: a batch's distinct words are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["words"]
            coded = lists.flatten().dictionary_encode()
            hashed = [int.from_bytes(md5(w.encode()).digest()[:4], "big") % cells for w in coded.dictionary.to_pylist()]
            owner = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            counts = np.bincount(owner * cells + np.array(hashed, np.int64)[np.asarray(coded.indices)], minlength=1)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(some // cells)), pa.array(some % cells), pa.array(counts[some])], ["key", "cell", "n"])

    return run


def _dense(cells: int):
    """(key, vector) of rows with lists of {cell, n}; no list gives zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["counts"]
            owner = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            entries, out = lists.flatten(), np.zeros((len(lists), cells))
            out[owner, np.asarray(entries.field("cell"))] = np.asarray(entries.field("n"))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * cells), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch["key"], vectors], ["key", "vector"])

    return run


def word_histogram(df: DataFrame, key: str, text: str, cells: int) -> DataFrame:
    """(key, vector): how many words of a text fall into each hashed cell; texts without words give zeros."""
    rows = df.select(F.col(key).alias("key"), words(text).alias("words"))
    shape = rows.select("key").schema
    parts = rows.mapInArrow(_cell_counts(cells), StructType([*shape.fields]).add("cell", "long").add("n", "long"))
    counts = parts.groupBy("key", "cell").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("key").agg(F.collect_list(F.struct("cell", "n")).alias("counts"))
    full = rows.select("key").join(packed, "key", "left")
    return full.mapInArrow(_dense(cells), StructType([*shape.fields]).add("vector", ArrayType(DoubleType()))).withColumnRenamed("key", key)


def digit_distance(a: Column, b: Column) -> Column:
    """Number of positions at which two strings of one length differ."""
    return _cell_distance(F.split(a, ""), F.split(b, ""))


def _cell_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, d: n + d)


def exact_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Every row with the id of the first row of its key and a duplicate flag."""
    return flag_repeats(df, key, order)


def duplicate_rates(flagged: DataFrame) -> DataFrame:
    """One row: valid and duplicate counts and rates."""
    return flagged.agg(
        F.count_if(~F.col("is_duplicate")).alias("valid"), F.count_if("is_duplicate").alias("duplicates")
    ).withColumns(
        {
            "valid_rate": F.col("valid") / (F.col("valid") + F.col("duplicates")),
            "duplicate_rate": F.col("duplicates") / (F.col("valid") + F.col("duplicates")),
        }
    )


def _segments(digits: int, count: int) -> list[tuple[int, int]]:
    """(start, length) of ``count`` nearly equal runs, 1-based."""
    edges = [round(i * digits / count) for i in range(count + 1)]
    return [(a + 1, b - a) for a, b in zip(edges, edges[1:])]


def _runs(runs: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for s, n in runs])


def _pick(text: Column, runs: Column, glue: str = "") -> Column:
    """The given runs of a text, joined."""
    return F.array_join(F.transform(runs, lambda r: F.substr(text, r["s"], r["n"])), glue)


def _segment_choices(digits: int, count: int, chosen: int) -> Column:
    """Every choice of segments as a constant array of {tag, kept, cut}."""
    segments = _segments(digits, count)
    options = []
    for combo in combinations(range(count), chosen):
        kept = [segments[i] for i in combo]
        cut = [s for i, s in enumerate(segments) if i not in combo]
        tag = "-".join(map(str, combo))
        options.append(F.struct(F.lit(tag).alias("tag"), _runs(kept).alias("kept"), _runs(cut).alias("cut")))
    return F.array(*options)


def _salted(rows: DataFrame, others: DataFrame, spread: str, keys: list[str]) -> DataFrame:
    """Join on ``keys`` with the rows of a key dealt to ``spread`` (a column of ``rows``) tasks.

    ``others`` is the short side: its rows are sent to each of these tasks, as many as its own ``spread`` says.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in (*keys, spread)]), F.col(spread))).drop(spread)
    sent = others.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col(spread) - 1))).drop(spread)
    return dealt.join(sent, [*keys, "salt"]).drop("salt")


def _members(rows: Column) -> list[Column]:
    """``ids`` and ``texts``, the texts joined, of a sorted array of {id, rest}."""
    return [F.transform(rows, lambda m: m["id"]).alias("ids"), F.array_join(F.transform(rows, lambda m: m["rest"]), "").alias("texts")]


def _first_near(limit: int):
    """The first of the sorted ``ids`` whose text is within the limit; a bucket's texts have one length, a byte a digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch["ids"], []
            starts = np.asarray(ids.offsets)[:-1]
            for start, rest, texts in zip(starts.tolist(), batch["rest"].to_pylist(), batch["texts"].to_pylist()):
                cells = np.frombuffer(rest.encode(), np.uint8)
                near = np.count_nonzero(np.frombuffer(texts.encode(), np.uint8).reshape(-1, len(cells)) != cells, axis=1) <= limit
                first = int(near.argmax())
                places.append(start + first if near[first] else None)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["bucket"], ids.values.take(pa.array(places, pa.int64()))], ["id", "bucket", "source"])

    return run


def _matches(tried: DataFrame, limit: int) -> DataFrame:
    """(id, bucket, source): the smallest id among ``ids`` that is earlier and near ``rest``."""
    shape = StructType([*tried.select("id", "bucket").schema, StructField("source", tried.schema["id"].dataType)])
    first = tried.select("id", "bucket", "rest", "ids", "texts").mapInArrow(_first_near(limit), shape)
    return first.filter("source < id").groupBy("id", "bucket").agg(F.min("source").alias("source"))


def _compared(rows: DataFrame, limit: int, block: int) -> DataFrame:
    """(id, bucket, source): each seeker of a bucket held against all members, in lists of about ``block`` of them.

    The members of a bucket are dealt to as many tasks as their number asks for; the seekers, few where the members are
    many, go to all of these.
    """
    parts = F.ceil(F.col("n") / F.lit(_TASK_MEMBERS)).cast("long")
    listed = rows.withColumn("list", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(block)).cast("long")))
    lists = listed.groupBy("bucket", "list").agg(F.sort_array(F.collect_list(F.struct("id", "rest"))).alias("members"), F.first(parts).alias("parts"))
    seekers = rows.filter("seeks").select("id", "bucket", "rest", parts.alias("parts"))
    return _matches(_salted(lists.select("bucket", "list", *_members("members"), "parts"), seekers, "parts", ["bucket"]), limit)


def _against_first(rows: DataFrame, limit: int, block: int) -> DataFrame:
    """(id, bucket, source): each seeker held against the ``block`` earliest members of its bucket.

    In a dense bucket nearly all end here, and no match can be earlier.
    """
    parts = F.ceil(F.col("n") / F.lit(_TASK_MEMBERS)).cast("long")
    some = rows.groupBy("bucket", F.pmod(F.xxhash64("id"), parts).alias("part")).agg(
        F.slice(F.sort_array(F.collect_list(F.struct("id", "rest"))), 1, block).alias("members"), F.first(parts).alias("parts"))
    first = some.groupBy("bucket", "parts").agg(F.slice(F.sort_array(F.flatten(F.collect_list("members"))), 1, block).alias("members"))
    seekers = rows.filter("seeks").select("id", "bucket", "rest", parts.alias("parts"))
    return _matches(_salted(seekers, first.select("bucket", *_members("members"), "parts"), "parts", ["bucket"]), limit)


def _split_sources(rows: DataFrame, limit: int, block: int, work: int) -> DataFrame:
    """(id, source) over buckets of any size.

    Where seekers times members of a bucket are at most ``work``, all are compared. In a larger bucket seekers first
    try the earliest members; for those without a match the bucket is split by one more segment of the remaining
    text: two texts that differ in at most ``limit`` digits agree on one of ``limit + 1`` segments. So buckets
    shrink until they can be compared, and where no more than ``limit`` digits remain, all members match.
    """
    rows, found = rows.withColumn("seeks", F.lit(True)), None
    while True:
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("seeks").alias("seekers")).filter("n > 1 AND seekers > 0")
        sized = materialize(join_stats(rows, sizes, ["bucket"]))
        whole = F.length("rest") <= limit
        light = F.col("seekers") * F.col("n") <= work
        firsts = sized.filter(whole).groupBy("bucket").agg(F.min("id").alias("source"))
        same = join_stats(sized.filter(whole & F.col("seeks")), firsts, ["bucket"]).filter("source < id").select("id", "source")
        hits = same.unionByName(_compared(sized.filter(~whole & light), limit, block).select("id", "source"))
        heavy = sized.filter(~whole & ~light)
        if heavy.isEmpty():
            hits = materialize(hits)
            return hits if found is None else found.unionByName(hits)
        tried = materialize(_against_first(heavy, limit, block))
        hits = materialize(hits.unionByName(tried.select("id", "source")))
        found = hits if found is None else found.unionByName(hits)
        done = tried.select("id", "bucket", F.lit(True).alias("done"))
        left = heavy.join(done, ["id", "bucket"], "left").select("id", "bucket", "rest", (F.col("seeks") & F.col("done").isNull()).alias("seeks"))
        rows = _split_buckets(left, limit)


def _split_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """Each bucket cut into ``limit + 1`` sets of buckets, one per segment of the remaining text.

    Digits in which a bucket's members agree say nothing: they are left out. The others are dealt to the segments by
    how many members differ there from the earliest one, so that each segment tells members apart.
    """
    firsts = rows.groupBy("bucket").agg(F.min_by("rest", "id").alias("first"))
    cells = join_stats(rows.select("bucket", "rest"), firsts, ["bucket"])
    differs = F.zip_with(F.split("rest", ""), F.split("first", ""), lambda x, y: (x != y).cast("int"))
    counts = cells.select("bucket", F.posexplode(differs).alias("at", "off")).groupBy("bucket", "at").agg(F.sum("off").alias("off")).filter("off > 0")
    orders = counts.groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("off")).alias("o"), "at"))), lambda x: x["at"]).alias("places"))
    told = join_stats(rows, orders, ["bucket"]).withColumn("cells", F.transform("places", lambda at: F.substr("rest", at + 1, F.lit(1))))
    n = F.lit(limit + 1)
    segments = F.when(F.size("cells") > limit, F.sequence(F.lit(0), F.lit(limit))).otherwise(F.array(F.lit(-1)))  # -1: all members match
    spread = told.select("id", "bucket", "seeks", "cells", F.explode(segments).alias("s"))
    kept, cut = (F.array_join(F.filter("cells", lambda _, i: ((i % n) == F.col("s")) == keep), "") for keep in (True, False))
    return spread.select("id", F.concat_ws("/", "bucket", F.concat_ws(":", "s", kept)).alias("bucket"), cut.alias("rest"), "seeks")


def near_sources(df: DataFrame, key: str, order: str, digits: int, limit: int, block: int = _BLOCK, work: int = _WORK) -> DataFrame:
    """(id, source): for each unique key, the earliest other key within ``limit`` differing digits.

    Keys must be unique (de-duplicate exactly first) and ``digits`` long. Two keys within the limit agree
    on at least ``spare`` of ``limit + spare`` segments, so every choice of ``spare`` segments is a bucket.
    Keys alone in a bucket drop out at once. The rest are matched exactly by comparing them, after large
    buckets were split further. A digit is one byte.
    """
    spare = max(n for n in (1, 2, 3) if n == 1 or (comb(limit + n, n) <= _MAX_CHOICES and limit + n <= digits))
    rows = _bucket_rows(df.select(F.col(order).alias("id"), F.col(key).alias("rest"), F.lit("").alias("bucket")), _segment_choices(digits, limit + spare, spare))
    return _split_sources(rows, limit, block, work).groupBy("id").agg(F.min("source").alias("source"))


def _bucket_rows(rows: DataFrame, choices: Column) -> DataFrame:
    """One row per segment choice: the kept segments extend the bucket, the cut ones remain."""
    spread = rows.select("id", "bucket", "rest", F.explode(choices).alias("c"))
    return spread.select(
        "id",
        F.concat_ws("/", F.col("bucket"), F.concat_ws(":", F.col("c.tag"), _pick(F.col("rest"), F.col("c.kept"), "|"))).alias("bucket"),
        _pick(F.col("rest"), F.col("c.cut")).alias("rest"),
    )


def near_duplicates(df: DataFrame, key: str, order: str, digits: int, limit: int) -> DataFrame:
    """Rows with ``first_id`` of their exact key and ``source_id``: the earliest near match of that key,
    or the key's own first row. A row survives when it is its own source."""
    flagged = flag_repeats(df, key, order)
    unique = flagged.filter(~F.col("is_duplicate")).select(order, key)
    sources = near_sources(unique, key, order, digits, limit).withColumnRenamed("id", "first_id")
    joined = join_stats(flagged, sources, ["first_id"], "left")
    return joined.withColumn("source_id", F.coalesce("source", "first_id")).drop("source")


def with_source_distance(matches: DataFrame, keys: DataFrame, key: str, order: str) -> DataFrame:
    """(id, source, distance) of matched keys."""
    own = keys.select(F.col(order).alias("id"), F.col(key).alias("_own"))
    other = keys.select(F.col(order).alias("source"), F.col(key).alias("_other"))
    return matches.join(own, "id").join(other, "source").select(
        "id", "source", digit_distance(F.col("_own"), F.col("_other")).alias("distance")
    )


def compact_numbers(df: DataFrame, order: str, out: str = "number") -> DataFrame:
    """Survivors numbered 0, 1, 2... in order."""
    return row_numbers(df, [order], out="_rn").withColumn(out, F.col("_rn") - 1).drop("_rn")
