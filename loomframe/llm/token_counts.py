"""Token counts of whole texts by a two-tier lookup on the map side, without shuffling a pre-token.

First pass: every task counts the white-space chunks of its texts in a bounded table and hands in its most
frequent ones. Their lengths in tokens, at most ``FREQUENT`` of them, form the first tier: a compact hash
table that is broadcast. Second pass: chunks found there cost one probe per distinct chunk of a batch;
misses go to the second tier, a bounded cache of the worker, and are encoded by the library when new.
The tables only save work: counts are those of the library whatever they hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from loomframe.llm.tokens import ChunkEncoder, bounded, chunk_codes, chunk_starts, folded, text_buffer

FREQUENT = 32_768  # entries of the broadcast table, each at most 48 bytes of text: under 4 MB
TASK_FREQUENT = 8_192  # entries one task hands in
TASK_TABLE = 65_536  # entries a task keeps while counting
LONGEST = 48


class LengthCache:
    """Second tier: lengths of the chunks that the broadcast table lacks."""

    def __init__(self, path: str, limit: int = 800_000):
        self.encoder, self.limit, self.known = ChunkEncoder(path), limit, {}

    def lengths(self, chunks: list[bytes]) -> np.ndarray:
        get = self.known.get
        out = np.array([get(c, -1) for c in chunks], np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            found = self.encoder.encode(new)[1]
            out[missing] = found
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
            self.known.update((c, n) for c, n in zip(new, found.tolist()) if len(c) <= LONGEST)
        return out


def _cut(texts: pa.Array, fold: bool):
    raw, offsets = text_buffer(texts)
    starts = chunk_starts(raw, offsets)
    return (folded(raw) if fold else raw), offsets, starts


def _frequent(fold: bool):
    """Task side of the first pass: (chunk, n) of a task's most frequent chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for table in bounded(batches):
            raw, _, starts = _cut(table["text"], fold)
            if not len(starts):
                continue
            codes, distinct = chunk_codes(raw, starts)
            times = np.bincount(codes, minlength=len(distinct))
            often = np.flatnonzero(times > 2)
            for chunk, n in zip(distinct.take(pa.array(often)).to_pylist(), times[often].tolist()):
                if len(chunk) <= LONGEST:
                    seen[chunk] += n
            if len(seen) > TASK_TABLE:
                seen = Counter(dict(seen.most_common(TASK_TABLE // 2)))
        top = seen.most_common(TASK_FREQUENT)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["chunk", "n"]
        )

    return count


def frequent_chunks(texts: DataFrame, fold: bool, limit: int = FREQUENT) -> list[bytes]:
    """The corpus-wide most frequent chunks; at most ``limit`` short byte strings reach the driver."""
    counted = texts.select("text").mapInArrow(_frequent(fold), "chunk binary, n long")
    top = counted.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(limit)
    return [bytes(r["chunk"]) for r in top.select("chunk").collect()]


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, lower_cased: bool = True) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids are passed on, one row out per row
    in; an empty table gives no rows. Other columns are not read, so their names cannot clash. A text of any
    length is handled whole. ``lower_cased`` tells that the tokenizer lower-cases and drops white space, so
    that spellings may share an entry. A ``.model`` file is counted by sentencepiece, text by text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.select("id").schema.add("n_bytes", "long").add("n_tokens", "long")
    if tokenizer_path.endswith(".model"):
        counted = rows.mapInArrow(_by_pieces(tokenizer_path), schema)
    else:
        common = frequent_chunks(rows, lower_cased)
        lengths = ChunkEncoder(tokenizer_path).encode(common)[1] if common else np.empty(0, np.int64)
        tier = docs.sparkSession.sparkContext.broadcast((common, lengths))
        counted = rows.mapInArrow(_by_tiers(tokenizer_path, lower_cased, tier), schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _by_tiers(path: str, fold: bool, tier):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, common_lengths = tier.value
        table_keys, cache = pa.array(common, pa.large_binary()), LengthCache(path)
        for table in bounded(batches):
            raw, offsets, starts = _cut(table["text"], fold)
            ends = np.zeros(len(starts) + 1, np.int64)
            if len(starts):
                codes, distinct = chunk_codes(raw, starts)
                at = pc.index_in(distinct, value_set=table_keys).fill_null(-1).to_numpy()
                found = np.zeros(len(distinct), np.int64)
                hit = at >= 0
                found[hit] = common_lengths[at[hit]]
                rest = np.flatnonzero(~hit)
                if len(rest):
                    found[rest] = cache.lengths(distinct.take(pa.array(rest)).to_pylist())
                ends[1:] = np.cumsum(found[codes])
            n_tokens = np.diff(ends[np.searchsorted(starts, offsets)])
            yield pa.RecordBatch.from_arrays(
                [table["id"].combine_chunks(), pa.array(np.diff(offsets)), pa.array(n_tokens)], ["id", "n_bytes", "n_tokens"]
            )

    return count


def _by_pieces(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for table in bounded(batches):
            texts = [t or "" for t in table["text"].to_pylist()]
            n_tokens = [len(ids) for ids in model.encode(texts, num_threads=1)]
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [table["id"].combine_chunks(), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    return count
