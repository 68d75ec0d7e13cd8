"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructField, StructType

from loomframe.operators.state import save_split, update_split
from loomframe.operators.window import pair_numbers
from loomframe.sources.sinks import path_exists


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, glob: str = "*.parquet") -> DataFrame:
    """A parquet folder as a stream of small groups of files."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", glob)
        .parquet(path)
    )


def drain(stream: DataFrame, checkpoint: str, batch_fn: Callable[[DataFrame, int], None]) -> None:
    """Run the stream over everything available now, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(batch_fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_chunks(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append every chunk of the stream to a parquet table, exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def split_writer(register: str, key: Sequence[str], order: Sequence[str], share: float, seed: str):
    """Batch function that grows a split register stored as ``register/batch=<id>``.

    Old rows never move, so a batch only adds its own folder. A repeated batch reads the folders
    before it and overwrites its own: running it twice gives the same register.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{register}/batch={batch_id}"
        state = None
        if path_exists(spark, register):
            stored = spark.read.parquet(register)
            if "batch" in stored.columns:
                earlier = stored.filter(F.col("batch") < batch_id).drop("batch")
                state = None if earlier.isEmpty() else earlier
        if state is None:
            fresh = save_split(batch, order, share)
        else:
            fresh = update_split(state, batch, key, share, seed).filter("is_new").drop("is_new")
        fresh.write.mode("overwrite").parquet(target)

    return write


def newer_pairs(df: DataFrame, time: str, mark, order: Sequence[str], last_pair: int) -> DataFrame:
    """Rows later than the mark as A/B pairs, numbered on from the last pair; an odd count is refused."""
    fresh = df.filter(F.col(time) > F.lit(mark))
    n = fresh.count()
    if n % 2:
        raise ValueError(f"{n} new rows do not form pairs")
    return pair_numbers(fresh, [], order, offset=last_pair).drop("rn")


def _pair_up(time: str, order: Sequence[str], names: Sequence[str], integers: Sequence[str]):
    """State function of a bucket of keys: of each key (last time, last pair, the unpaired item's values or nothing)."""
    at, places = list(names).index(time), [list(names).index(o) for o in order]

    def read(chunk: pd.DataFrame, name: str) -> list:
        return [None if v is None else int(v) for v in chunk[name].tolist()] if name in integers else chunk[name].tolist()

    def place(row: tuple) -> list:
        return [(row[p] is None, row[p]) for p in places]  # nulls last

    def run(bucket: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, fresh, done, pairs = {k: rest for k, *rest in (state.get[0] if state.exists else [])}, {}, [], []
        for chunk in chunks:
            for key, *row in zip(chunk["_key"].tolist(), *(read(chunk, n) for n in names)):
                row = tuple(None if v is pd.NaT or isinstance(v, float) and v != v else v for v in row)
                if row[at] is not None and (key not in known or row[at] > known[key][0]):
                    fresh.setdefault(key, []).append(row)
        if not fresh:
            return
        for key, rows in fresh.items():
            _, pair, waiting = known.get(key, (None, 0, None))
            rows.sort(key=place)
            newest = rows[-1][at]
            if waiting is not None:  # the partner of the item left over is the first newer one
                rows.insert(0, tuple(waiting))
            whole = len(rows) // 2 * 2
            spare = rows[whole] if whole < len(rows) else None
            known[key] = (newest.to_pydatetime() if isinstance(newest, pd.Timestamp) else newest, pair + whole // 2, spare)
            done += rows[:whole]
            pairs += [pair + 1 + i // 2 for i in range(whole)]
        state.update(([(key, *rest) for key, rest in known.items()],))
        if done:
            columns = {n: pd.Series(values, dtype=object) for n, values in zip(names, zip(*done))}
            yield pd.DataFrame({**columns, "pair": pairs, "side": ["A", "B"] * (len(done) // 2)})

    return run


def paired_stream(stream: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], buckets: int = 256) -> DataFrame:
    """Each key's items as A/B pairs, numbered on from batch to batch: the columns, ``pair`` and ``side``.

    The state of a key holds the time of its last item, the number of its last pair, and an item without a
    partner, which waits for the next newer item; only pairs come out. Items that are not newer than the last
    one were processed before and are passed over, as are items without a time. ``order`` starts with ``time``.
    A stream that ends and starts again from its checkpoint numbers on where it stopped.

    Keys share the state of one of ``buckets`` buckets, since a call of the state function costs more than a key's
    items; take more for many millions of keys (a checkpoint goes on with its own number only). A bucket's items of one
    micro-batch are held together, so the source's batch size bounds what a task holds, whatever share a key has.
    """
    fields = stream.schema.fields
    names = [f.name for f in fields]
    out = StructType([*fields, StructField("pair", LongType()), StructField("side", StringType())])
    waiting = StructType([StructField(f.name, f.dataType, True) for f in fields])
    entry = StructType([StructField("key", StringType()), StructField("last", stream.schema[time].dataType), StructField("pair", LongType()), StructField("waiting", waiting)])
    kept = StructType([StructField("keys", ArrayType(entry))])
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    integers = [f.name for f in fields if isinstance(f.dataType, IntegralType)]  # as text: pandas makes floats of them beside nulls
    keyed = stream.withColumn("_key", key).withColumns({c: F.col(c).cast("string") for c in integers})
    grouped = keyed.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets))).groupBy("_bucket")
    return grouped.applyInPandasWithState(_pair_up(time, order, names, integers), out, kept, "append", GroupStateTimeout.NoTimeout)
