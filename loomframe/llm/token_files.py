"""Token ids as directly addressable codes (DAC), written in ascending id order and read back.

Layout of one segment, little-endian::

    uint32 n, uint32 levels, then per level k:
        uint32 n_k, n_k bytes (the k-th byte of each id that reaches level k),
        and, except for the last level, ceil(n_k / 8) bytes of bits (1: the id goes on in level k + 1)
        and a rank directory: uint32 ones before each block of 512 bits.

Token ``i`` is read by following its bits: its place in the next level is the number of ones before it,
which the directory and at most 64 bytes of bits tell. No block is decoded for it.

A file is a Parquet file whose rows are segments: part and segment number, ids before the segment in its
part, the ids, lengths and repeat order of its documents, and the payload. Parts hold ascending ranges of the
document id, so part totals (one row per part) give every document its place in the whole stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.llm.ranges import id_bounds, part_of, parts_for
from loomframe.llm.tokens import bounded, worker_encoder
from loomframe.plans.checkpoints import scratch_path

BLOCK = 512  # bits per entry of the rank directory
SEGMENT_TOKENS = 1 << 20  # a segment closes at the first document that reaches this


def dac_encode(ids: np.ndarray) -> bytes:
    """One segment of non-negative 32-bit ids."""
    rest, levels = np.ascontiguousarray(ids, dtype="<u4"), []
    while True:
        low, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        rest = rest[more]
        levels.append((low, more))
        if not len(rest):
            break
    out = [struct.pack("<II", len(ids), len(levels))]
    for k, (low, more) in enumerate(levels):
        out += [struct.pack("<I", len(low)), low.tobytes()]
        if k + 1 < len(levels):
            bits = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
            out += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
    return b"".join(out)


class DacReader:
    """Random access to the ids of a segment."""

    def __init__(self, payload: bytes):
        self.n, n_levels = struct.unpack_from("<II", payload)
        at, self.levels = 8, []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<I", payload, at)
            at += 4
            low = np.frombuffer(payload, np.uint8, n, at)
            at += n
            bits = ranks = None
            if k + 1 < n_levels:
                bits = np.frombuffer(payload, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(payload, "<u4", -(-n // BLOCK), at)
                at += 4 * len(ranks)
            self.levels.append((low, bits, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a level."""
        low, bits, ranks = self.levels[level]
        if i == len(low):
            return int(len(self.levels[level + 1][0]))
        block = i // BLOCK
        first = block * BLOCK // 8
        count = int(ranks[block]) + int(np.bitwise_count(bits[first : i // 8]).sum())
        return count + int(bits[i // 8] & ((1 << (i % 8)) - 1)).bit_count()

    def get(self, i: int) -> int:
        """Id number ``i``."""
        value, shift = 0, 0
        for k, (low, bits, _) in enumerate(self.levels):
            value |= int(low[i]) << shift
            if bits is None or not (bits[i // 8] >> (i % 8)) & 1:
                return value
            i, shift = self._rank(k, i), shift + 8
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to below ``stop``: one run of bytes per level, placed by the bits above it."""
        runs = []
        for k, (low, bits, _) in enumerate(self.levels):
            runs.append((low[start:stop], bits, start))
            if bits is None or start == stop:
                break
            start, stop = self._rank(k, start), self._rank(k, stop)
        value = runs[-1][0].astype(np.uint32)
        for low, bits, first in reversed(runs[:-1]):
            more = np.unpackbits(bits[first // 8 : (first + len(low) + 7) // 8], bitorder="little")[first % 8 :][: len(low)]
            joined = low.astype(np.uint32)
            joined[more.astype(bool)] |= value << 8
            value = joined
        return value


_SEGMENT = "part int, segment int, first long, ids array<{id}>, lengths array<int>, payload binary"


def _write(path: str, end_id: int, id_type: pa.DataType):
    """Task side: rows arrive by (part, id); closes a segment at a part's end or when it is full."""

    def segment(part: int, number: int, first: int, ids: list, lengths: list, tokens: list) -> pa.RecordBatch:
        n = np.concatenate(lengths).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(ids).cast(id_type)),
                pa.array([n], pa.list_(pa.int32())), pa.array([dac_encode(np.concatenate(tokens))], pa.binary()),
            ],
            ["part", "segment", "first", "ids", "lengths", "payload"],
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        part, number, first, held = None, 0, 0, ([], [], [])
        size = 0
        for table in bounded(batches):
            parts = table["part"].to_numpy()
            ids, ends = encoder.texts(table["text"])
            lengths = np.diff(ends) + 1
            stream = np.full(lengths.sum(), end_id, np.int32)
            stops = np.cumsum(lengths)
            inside = np.ones(len(stream), bool)
            inside[stops - 1] = False
            stream[inside] = ids
            names = table["id"].combine_chunks()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges, edges[1:]):
                if part is not None and (parts[a] != part or size >= SEGMENT_TOKENS):
                    yield segment(part, number, first, *held)
                    number, first = (number + 1, first + size) if parts[a] == part else (0, 0)
                    held, size = ([], [], []), 0
                part = int(parts[a])
                low, high = (stops[a - 1] if a else 0), stops[b - 1]
                for kept, new in zip(held, (names.slice(a, b - a), lengths[a:b], stream[low:high])):
                    kept.append(new)
                size += int(high - low)
        if part is not None:
            yield segment(part, number, first, *held)

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending id order under ``path``.

    Rows with a null id come first, rows with the same id in the order of their texts. A null text is an empty
    one: its only token is ``end_id``. An empty table writes files without rows. Other columns are not read.
    One shuffle moves the texts into id ranges.
    """
    parts = parts_for(docs)
    bounds = id_bounds(docs, id_col, parts)
    rows = docs.select(part_of(F.col(id_col), bounds).alias("part"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "id", "text")
    id_type = dict(rows.dtypes)["id"]
    arrow_type = pa.int32() if id_type == "int" else pa.int64() if id_type == "bigint" else pa.string()
    written = placed.mapInArrow(_write(tokenizer_path, end_id, arrow_type), _SEGMENT.format(id=id_type))
    written.write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            reader = DacReader(batch.column("payload")[row].as_buffer().to_pybytes())
            lengths = batch.column("lengths")[row].values.to_numpy()
            stops = np.cumsum(lengths.astype(np.int64))
            crcs = [zlib.crc32(reader.slice(b - n, b).astype("<u4").tobytes()) for b, n in zip(stops.tolist(), lengths.tolist())]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("part")[row].as_py()] * n, pa.int32()), batch.column("ids")[row].values,
                    pa.array(stops - lengths + batch.column("first")[row].as_py()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64()),
                ],
                ["part", "id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, shift = 0, []  # one entry per part, whose number is bounded by the plan
    for row in totals:
        shift += [F.lit(row["part"]), F.lit(before)]
        before += row["n"]
    id_type = files.schema["ids"].dataType.elementType.simpleString()
    rows = files.mapInArrow(_read, f"part int, id {id_type}, start long, n_tokens long, ids_crc32 long")
    offset = F.element_at(F.create_map(*shift), F.col("part")) if shift else F.lit(0)
    return rows.select(F.col("id").alias(id_col), (F.col("start") + offset).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, doc_id, position: int) -> int:
    """One id of one document, by address: the row of its segment, then one walk down the levels."""
    row = spark.read.parquet(path).filter(F.array_contains("ids", doc_id)).first()
    at = list(row["ids"]).index(doc_id)
    return DacReader(bytes(row["payload"])).get(sum(row["lengths"][:at]) + position)


def token_file_table(docs: DataFrame, tokenizer_path: str, end_id: int, **columns) -> DataFrame:
    """Write to a fresh folder of the shared scratch space and read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token_ids")
    write_token_files(docs, path, tokenizer_path, end_id, **columns)
    return read_token_files(spark, path, columns.get("id_col", "doc_id"))
