"""Packing by lexical retrieval: windows are filled with a seed document's nearest unused neighbours.

Document frequencies and the mean length are those of the whole table. Documents get shards of about ``SHARD_TOKENS``
tokens by their content, wherever they lie in the input: BM25 weights of all terms are projected to ``DIMS`` numbers,
a document belongs to the nearest of ``CLUSTERS`` centres a shard (fitted on a sample, whose size follows the number
of centres), and the order of cluster and of the ``KEY_TERMS`` terms of highest weight is cut by range. So a cluster
of many documents is cut by its telling terms and at last by the row.

Inside a shard an inverted index holds, per token id, the documents with it and their BM25 weights. A window starts
with the first unfinished document; its index lookup returns the unused documents by falling BM25 score (ties: order
of the shard). Those that fit whole are taken in that order; what then is still free takes the head of the best one
left, or of the next unused document where none shares a telling token, and the rest of that document seeds the next
window. So windows are full but for a shard's last one. What lies in these goes through a second round of the same
kind; there a shard's last window is cut into sequences of powers of two: no padding at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from loomframe.llm.tokens import BATCH_BYTES, bounded, load, text_buffer, worker_encoder
from loomframe.plans.checkpoints import materialize

SHARD_TOKENS = 1 << 20  # tokens that a shard has on average
CLUSTERS = 2  # centres for each shard
SAMPLE, STEPS = 16, 10  # documents for each centre that the centres are fitted on, and rounds of the fit
DIMS = 64  # of a projected document
SIGNS = 4  # of them that a term adds to
KEY_TERMS = 3  # telling terms of a document that give its place in a cluster
K1, B = 1.2, 0.75  # customary BM25 parameters


@dataclass
class Statistics:
    """What BM25 needs of all documents."""

    idf: np.ndarray  # of each term
    mean: float  # length of a document

    @staticmethod
    def of(df: np.ndarray, n: int, tokens: int) -> Statistics:
        return Statistics(np.log((n - df + 0.5) / (df + 0.5)), max(tokens / max(n, 1), 1))


def occurrences(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, term, count) of every distinct pair, sorted, and the number of terms looked at."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends))
    vocabulary = int(ids.max()) + 1 if len(ids) else 1
    # Narrow integers where they fit: sorting them is what an index costs most.
    pair, tf = np.unique((owner * vocabulary + ids).astype(np.int32 if n * vocabulary < 1 << 31 else np.int64), return_counts=True)
    doc, term = np.divmod(pair.astype(np.int64), vocabulary)
    return doc, term, tf, vocabulary


def weighted(ids: np.ndarray, ends: np.ndarray, known: Statistics | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, term, BM25 weight) of the telling terms; a term of half the documents or more tells nothing."""
    doc, term, tf, vocabulary = occurrences(ids, ends)
    lengths = np.diff(ends)
    if known is None:
        known = Statistics.of(np.bincount(term, minlength=vocabulary), len(lengths), int(lengths.sum()))
    telling = known.idf[term] > 0
    doc, term, tf = doc[telling], term[telling], tf[telling]
    norm = K1 * (1 - B + B * lengths[doc] / known.mean)
    return doc, term, known.idf[term] * tf * (K1 + 1) / (tf + norm), vocabulary


class Bm25Shard:
    """Inverted index of one shard: term -> (document, weight), weights ready to be added up."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, known: Statistics | None = None):
        n = len(ends) - 1
        doc, term, weight, vocabulary = weighted(ids, ends, known)
        self.terms_of = np.searchsorted(doc, np.arange(n + 1))
        self.term = term
        by_term = np.argsort(term.astype(np.uint16) if vocabulary <= 1 << 16 else term, kind="stable")
        self.posting_doc = doc[by_term]
        self.posting_weight = weight[by_term]
        self.postings = np.searchsorted(term[by_term], np.arange(vocabulary + 1))
        self.n = self.left = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard that is not dropped for the distinct terms of ``seed``."""
        terms = self.term[self.terms_of[seed] : self.terms_of[seed + 1]]
        low, count = self.postings[terms], self.postings[terms + 1] - self.postings[terms]
        ends = np.cumsum(count)
        at = np.repeat(low - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.posting_doc[at], self.posting_weight[at], minlength=self.n)

    def drop(self, used: np.ndarray) -> None:
        """Postings of ``used`` documents go as soon as a quarter of those left are used."""
        left = self.n - np.count_nonzero(used)
        if left > 0.75 * self.left:
            return
        kept = ~used[self.posting_doc]
        self.postings = np.concatenate([[0], np.cumsum(kept)])[self.postings]
        self.posting_doc, self.posting_weight, self.left = self.posting_doc[kept], self.posting_weight[kept], left


def pack_shard(ids: np.ndarray, ends: np.ndarray, window: int, known: Statistics | None = None, over: list | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; ``ids`` hold the end tokens already.

    ``known`` are the statistics of more documents than these. ``over`` gets the (document, start, length) that do
    not fill a window; without it they become sequences of powers of two.
    """
    n, lengths, pieces = len(ends) - 1, np.diff(ends), []
    if not n:
        return pieces
    index = Bm25Shard(ids, ends, known)
    used = np.zeros(n, bool)  # begun or taken
    following, sequence = 0, 0  # next document to look at; number of the open sequence
    doc, start = None, 0
    while True:
        if doc is None:
            while following < n and used[following]:
                following += 1
            if following == n:
                return pieces
            doc, start, used[following] = following, 0, True
        while lengths[doc] - start >= window:
            pieces.append((doc, start, window, sequence, 0))
            start, sequence = start + window, sequence + 1
        left = int(lengths[doc] - start)
        if not left:
            doc = None
            continue
        parts, free, seed, rest = [(doc, start, left)], window - left, doc, None
        index.drop(used)
        score = index.scores(seed)
        score[used] = 0
        near = np.flatnonzero(score)
        near = near[np.argsort(-score[near], kind="stable")]
        sizes, at, skipped = lengths[near], 0, None
        while free and at < len(near):
            fits = sizes[at:] <= free
            step = int(fits.argmax())
            if not fits[0] and skipped is None:
                skipped = int(near[at])
            if not fits[step]:
                break
            other, size, at = int(near[at + step]), int(sizes[at + step]), at + step + 1
            parts.append((other, 0, size))
            used[other] = True
            free -= size
        while free:
            if skipped is None:
                while following < n and used[following]:
                    following += 1
                if following == n:
                    break
                skipped = following
            size = int(min(lengths[skipped], free))
            parts.append((skipped, 0, size))
            used[skipped] = True
            free -= size
            if size < lengths[skipped]:
                rest = (skipped, size)
            skipped = None
        if free and over is not None:
            over += parts
        elif free:  # the shard has run out: binary pieces, the largest first
            sequence = _binary(parts, window - free, sequence, pieces)
        else:
            offset = 0
            for other, first, size in parts:
                pieces.append((other, first, size, sequence, offset))
                offset += size
            sequence += 1
        doc, start = rest if rest else (None, 0)


def _binary(parts: list, total: int, sequence: int, pieces: list) -> int:
    """Lay ``parts`` into sequences whose lengths are the powers of two that sum to ``total``."""
    open_size, offset = 1 << (total.bit_length() - 1), 0
    for other, first, size in parts:
        while size:
            put = min(size, open_size - offset)
            pieces.append((other, first, put, sequence, offset))
            first, size, offset = first + put, size - put, offset + put
            if offset == open_size:
                total -= open_size
                open_size, offset, sequence = (1 << (total.bit_length() - 1)) if total else 0, 0, sequence + 1
    return sequence


def _encode(path: str, fold: bool, end_id: int, kind: str):
    """(id, tokens) with the end token, as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, fold)
        for table in bounded(batches, limit=2 * BATCH_BYTES):
            ids, ends = encoder.texts(table["text"])
            ends = ends + np.arange(table.num_rows + 1)
            stream = np.full(ends[-1], end_id, kind)
            inside = np.ones(len(stream), bool)
            inside[ends[1:] - 1] = False
            stream[inside] = ids
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), _packed(stream, ends)], ["id", "tokens"])

    return run


def _packed(stream: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = (ends * stream.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(stream)]).cast(pa.binary())


def _streams(batches: Iterator[pa.RecordBatch], kind: str, limit: int = BATCH_BYTES // 4) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, their tokens one after the other, row offsets into these)."""
    for table in bounded(batches, "tokens", limit):
        raw, offsets = text_buffer(table["tokens"])
        stream = np.frombuffer(raw.tobytes(), kind)
        yield table, stream.astype(np.int64), offsets // stream.itemsize


def _frequencies(kind: str):
    """(term, n): documents with each term; -1 counts the documents and -2 their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(0, np.int64), 0, 0
        for _, ids, ends in _streams(batches, kind):
            _, term, _, vocabulary = occurrences(ids, ends)
            df = np.pad(df, (0, max(vocabulary - len(df), 0)))
            df += np.bincount(term, minlength=len(df))
            n, tokens = n + len(ends) - 1, tokens + len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, tokens]))], ["term", "n"])

    return run


def projected(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int) -> np.ndarray:
    """Unit vectors of ``DIMS`` numbers; zero for documents without a telling term.

    A term's direction is sparse: ``SIGNS`` of the numbers are 1 or -1, one in each of as many equal stretches, the others 0.
    """
    random, stretch = np.random.default_rng(0), DIMS // SIGNS
    out = np.zeros(n * DIMS)
    for k in range(SIGNS):
        place, sign = k * stretch + random.integers(0, stretch, terms), random.choice([-1.0, 1.0], terms)
        out += np.bincount(doc * DIMS + place[term], weight * sign[term], minlength=n * DIMS)
    out = out.reshape(n, DIMS).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of greatest cosine, the first of equal ones."""
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([np.argmax(vectors[a : a + step] @ centres.T, axis=1) for a in range(0, len(vectors), step)] or [np.empty(0, np.int64)])


def fitted_centres(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; neighbours in the order of the result are alike in their first principal direction."""
    vectors = vectors[np.any(vectors, axis=1)]
    if len(vectors) <= 1 or k <= 1:
        return np.zeros((1, DIMS), np.float32)
    centres = vectors[np.random.default_rng(0).permutation(len(vectors))[:k]]
    for _ in range(STEPS):
        own = nearest(vectors, centres)
        order = np.argsort(own, kind="stable")
        some, starts = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(vectors[order], starts, axis=0)
        centres = centres.copy()
        centres[some] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    first = np.linalg.eigh(centres.T @ centres)[1][:, -1]
    return centres[np.argsort(centres @ first, kind="stable")]


def _vectors(known, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, ends in _streams(batches, kind):
            doc, term, weight, _ = weighted(ids, ends, known.value)
            vectors = projected(doc, term, weight, len(ends) - 1, len(known.value.idf))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary())], ["vector"])

    return run


def key_terms(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The ``KEY_TERMS`` terms of highest weight of each document, -1 where there are fewer."""
    out, weight = np.full((KEY_TERMS, n), -1, np.int64), weight.copy()
    some, starts = np.unique(doc, return_index=True)
    for place in range(KEY_TERMS if len(some) else 0):
        best = np.maximum.reduceat(weight, starts)
        at = np.flatnonzero(weight == np.repeat(best, np.diff(np.append(starts, len(doc)))))
        at = at[np.unique(doc[at], return_index=True)[1]]
        out[place, some] = np.where(best > 0, term[at], -1)
        weight[at] = 0
    return out


_KEYS = ["cluster", *(f"key_{k}" for k in range(KEY_TERMS))]


def _keyed(known, centres, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ids, ends in _streams(batches, kind):
            own = [table[k].combine_chunks() for k in ("id", "tokens", "row")]
            n, lengths = table.num_rows, np.diff(ends)
            doc, term, weight, _ = weighted(ids, ends, known.value)
            cluster = np.zeros(n, np.int64)
            if len(centres.value) > 1:
                cluster = nearest(projected(doc, term, weight, n, len(known.value.idf)), centres.value)
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.zeros(n, np.int64)), pa.array(lengths), pa.array(cluster), *map(pa.array, key_terms(doc, term, weight, n))], ["id", "tokens", "row", "base", "doc_tokens", *_KEYS])

    return run


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _pack(known, kind: str, window: int, limit: int, last: bool):
    """Pieces (without tokens), and of the first round what did not fill a window (with tokens, as rows to pack)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A sequence id: one bit for the round, 28 for the task, 12 for the shard in it, 22 for the sequence.
        task = (TaskContext.get().partitionId() << 34) + (last << 62)
        for shard, (table, stream, ends) in enumerate(_streams(batches, kind, limit)):
            over = None if last else []
            pieces = np.array(pack_shard(stream, ends, window, known.value, over), np.int64).reshape(-1, 5)
            doc, start, length = pieces[:, 0], pieces[:, 1], pieces[:, 2]
            raw, first = memoryview(stream.astype("<u4").tobytes()), 4 * (ends[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
            base, whole = table["base"].to_numpy(), table["doc_tokens"].to_numpy()
            rest = np.array(over or [], np.int64).reshape(-1, 3)
            left = [stream[ends[d] + a : ends[d] + a + n].astype(kind).tobytes() for d, a, n in rest.tolist()]
            both, none = np.append(doc, rest[:, 0]), [None] * len(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    table["id"].combine_chunks().take(pa.array(both)), pa.array([None] * len(doc) + left, pa.binary()), table["row"].combine_chunks().take(pa.array(both)),
                    pa.array(np.append(base[doc] + start, base[rest[:, 0]] + rest[:, 1])), pa.array(whole[both]), *(table[k].combine_chunks().take(pa.array(both)) for k in _KEYS),
                    pa.array(np.append(length, rest[:, 2])), pa.array(crc + none, pa.int64()), pa.array((task + (shard << 22) + pieces[:, 3]).tolist() + none, pa.int64()), pa.array(pieces[:, 4].tolist() + none, pa.int64()),
                ],
                ["id", "tokens", "row", "base", "doc_tokens", *_KEYS, "length", "ids_crc32", "sequence_id", "offset"],
            )

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, *, window: int = 2048, lower_cased: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    Every id of every document lies in one piece. A null text is an empty one, whose only token is ``end_id``;
    null and repeated ids are passed on, each row packed as a document of its own; an empty table gives no
    rows; a text longer than a window fills whole windows by itself and its rest seeds the next one. Other
    columns are not read. The same input files in the same splits give the same sequences.
    """
    spark = docs.sparkSession
    kind = "<u2" if max(load(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_only = rows.select("id").schema

    def shape(*columns: tuple[str, str]):
        out = StructType(list(id_only.fields))
        for name, of in columns:
            out = out.add(name, of)
        return out

    coded = materialize(rows.mapInArrow(_encode(tokenizer_path, lower_cased, end_id, kind), shape(("tokens", "binary"))))
    counts = coded.select("tokens").mapInArrow(_frequencies(kind), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in counts.collect()}  # one per term of the tokenizer
    n, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(max(counts, default=0) + 1, np.int64)
    df[list(counts)] = list(counts.values())
    known = spark.sparkContext.broadcast(Statistics.of(df, n, tokens))
    keys = [(k, "long") for k in _KEYS]
    shaped = shape(("tokens", "binary"), ("row", "long"), ("base", "long"), ("doc_tokens", "long"), *keys)
    numbered = coded.withColumn("row", F.monotonically_increasing_id())
    shards, vectors = max(1, -(-tokens // SHARD_TOKENS)), np.zeros((0, DIMS), np.float32)
    if shards > 1:
        some = numbered.filter(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < 1_000_000 * SAMPLE * CLUSTERS * shards // n)
        vectors = [r["vector"] for r in some.select("tokens").mapInArrow(_vectors(known, kind), "vector binary").collect()]
        vectors = np.frombuffer(b"".join(vectors), np.float32).reshape(-1, DIMS)
    centres = spark.sparkContext.broadcast(fitted_centres(vectors, CLUSTERS * shards))
    keyed = materialize(numbered.mapInArrow(_keyed(known, centres, kind), shaped))
    out = shape(*[(f.name, f.dataType) for f in shaped.fields[len(id_only) :]], ("length", "long"), ("ids_crc32", "long"), ("sequence_id", "long"), ("offset", "long"))
    place = [*_KEYS, "row", "base"]

    def packed(frame: DataFrame, total: int, last: bool) -> DataFrame:
        dealt = frame.repartitionByRange(max(1, -(-total // SHARD_TOKENS)), *place).sortWithinPartitions(*place)
        return dealt.mapInArrow(_pack(known, kind, window, 2 * SHARD_TOKENS * width, last), out)

    first = materialize(packed(keyed, tokens, False))
    over = first.filter("tokens is not null")
    left = over.agg(F.sum("length")).first()[0] or 0
    second = packed(over.select(shaped.names), left, True)
    pieces = first.filter("tokens is null").unionByName(second).withColumnRenamed("base", "start")
    return pieces.select(F.col("id").alias(id_col), *_PIECE)
