"""Language-model scores by a probabilistic suffix tree over word symbols.

Symbols are the most frequent words of training, one symbol for all other words, and the end of a text. The tree's
contexts are the last symbols, start of the text included. The number of symbols (``symbols_for``) and the longest
context (``depth_for``) grow with the training tokens. A context is kept if its next-symbol distribution diverges
enough from that of its longest kept suffix: the code length it saves over all its occurrences has to exceed the cost
of its parameters. Nothing else decides, in particular no count: totals are those of all occurrences. Kept
distributions are smoothed with that suffix's, down to uniform symbols, and a symbol is scored by the longest kept
suffix of what precedes it.

A word under the symbol of the others has its discounted share of their count; what is discounted is the chance of
an unseen word, one class like in the base model:

    P(word | other) = (c - D) / C      P(unseen | other) = D * V / C      D = n1 / (n1 + 2 * n2)

with C the occurrences and V the number of distinct other words, n1 and n2 the number seen once and twice.

Size: neither the word counts nor the tree are gathered. Blocks of rows send their distinct words to hash buckets, the
buckets add up and answer each block. The tree goes the same way: a block sends its distinct positions (context and next
symbol, with their training counts) to buckets, so that a bucket has all occurrences of the contexts it tests, from short
to long, and answers with the chance of every position asked. A context that would fill half a bucket is a hot one: what
follows it is counted before and goes to all buckets with its positions, which are dealt by the symbol before it (at the
full length by the next symbol), so that the contexts longer by one symbol lie together again. A few rows show which
contexts are hot (``heavy_contexts``); they decide where a position is tested, never what is counted. The driver and the
broadcast hold one number per symbol and the keys of the hot contexts.

An answer holds values only, in the order in which they were asked: the words of a block as codes travel with its
positions and put its words and positions in that order once more. Positions are ordered by last and next symbol, where
most chances repeat. Arrays travel packed (``pack``).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomframe.llm.tokens import bounded, spaces, text_buffer
from loomframe.plans.checkpoints import materialize

DEPTH = 2  # longest context of a small corpus
COMMON = 500  # symbols of a small corpus
EDGE_SHARE = 0  # share of the tokens below which a count would be dropped: none is
BLOCK_ROWS = 1024  # rows of a scan partition that ask together
OTHER, STOP, START = 0, 1, 2  # the common words follow from 3
_FIRST_WORD = 3
_BITS = 10  # of a symbol
_DEPTH_SHIFT = _BITS * (DEPTH + 1)
_FLUSH = 1_000_000  # distinct counts a task holds before it hands them in
_BUCKET_TOKENS = 1 << 21  # training tokens to a bucket of positions
_GROUP = 1 << 18  # positions that a bucket tests together
_SEEN = 1000  # tokens to a bucket that are looked at for hot contexts, 2^20 at least
_PIECE = 1 << 20  # positions after which the next rows of a block ask by themselves
_LEAST = 32  # of those tokens, to make a context hot
_NONE = 0xFFFFFFFF  # in place of a symbol before the start
_PACKED = pa.Codec("zstd", compression_level=1)
_LOWER = np.array([x | 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)


def symbols_for(tokens: int) -> int:
    """Words that are symbols of their own: a quarter of the square root of the training tokens, ``COMMON`` at least."""
    return max(COMMON, math.isqrt(tokens) // 4)


def depth_for(tokens: int) -> int:
    """Symbols of the longest context: one more than ``DEPTH`` from 1e7 training tokens on, two more from 1e9 on."""
    return DEPTH + max(0, (len(str(tokens)) - 6) // 2)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, distinct words as bytes, first word of each row and the end), ASCII letters lowered."""
    raw, offsets = text_buffer(texts)
    if not len(raw):
        return np.empty(0, np.int64), pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    solid = ~spaces(raw)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    packed = _LOWER[raw[solid]]
    before = np.concatenate([[0], np.cumsum(solid)])
    bounds = np.append(before[starts], len(packed)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, np.searchsorted(starts, offsets)


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes: where values differ from the one before, and those, bytes of equal significance together."""
    flat = np.ascontiguousarray(values).reshape(-1)
    bits = flat.view(f"u{flat.itemsize}")
    fresh = np.ones(len(flat), bool)
    np.not_equal(bits[1:], bits[:-1], out=fresh[1:])
    body = np.packbits(fresh).tobytes() + flat[fresh].view(np.uint8).reshape(-1, flat.itemsize).T.tobytes()
    return len(flat).to_bytes(4, "little") + len(body).to_bytes(4, "little") + _PACKED.compress(body, asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    many = packed_size(data)
    body = np.frombuffer(_PACKED.decompress(data[8:], int.from_bytes(data[4:8], "little"), asbytes=True), np.uint8)
    flags = (many + 7) // 8
    values = np.ascontiguousarray(body[flags:].reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
    return values if len(values) == many else values[np.cumsum(np.unpackbits(body[:flags], count=many)) - 1]


def packed_size(data: bytes) -> int:
    return int.from_bytes(data[:4], "little")


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys, packed as their distances."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in words], np.uint64)


def positions(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context of ``DEPTH`` symbols, known symbols of it) before every symbol of the texts, ends included."""
    ends = np.cumsum(lengths)
    place = np.arange(len(symbols)) - np.repeat(ends - lengths, lengths)
    context = np.zeros(len(symbols), np.int64)
    for back in range(1, DEPTH + 1):
        before = np.zeros(len(symbols), np.int64)
        before[back:] = symbols[: max(len(symbols) - back, 0)]
        before[place == back - 1] = START
        context |= np.where(place >= back - 1, before, 0) << (_BITS * (back - 1))
    return context, np.minimum(place + 1, DEPTH)


def edge_keys(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A key per (context of 0 to DEPTH symbols, next symbol) of every position."""
    context, known = positions(symbols, lengths)
    keys = []
    for depth in range(DEPTH + 1):
        usable = known >= depth
        masked = context[usable] & ((1 << _BITS * depth) - 1)
        keys.append((depth << _DEPTH_SHIFT) | (masked << _BITS) | symbols[usable])
    return np.concatenate(keys)


def tested(context: np.ndarray, n: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted contexts, context of each edge, kept, share left to the suffix, chance of each edge).

    An edge has its context, its count and its chance after the context's longest kept suffix.
    """
    state, where, kinds = np.unique(context, return_inverse=True, return_counts=True)
    total = np.bincount(where, n, minlength=len(state))
    left = kinds / (total + kinds)
    chance = n / (total + kinds)[where] + left[where] * shorter
    saved = np.bincount(where, n * np.log2(chance / shorter), minlength=len(state))
    return state, where, saved > 0.5 * kinds * np.log2(np.maximum(total, 2)), left, chance


@dataclass
class SuffixTree:
    """The tree on one machine, for up to ``DEPTH`` symbols; what the buckets answer has to agree with it.

    Kept contexts per depth: sorted states with their share left to the suffix, sorted edges with probabilities.
    """

    root: np.ndarray
    states: list[np.ndarray]
    left: list[np.ndarray]
    edges: list[np.ndarray]
    chance: list[np.ndarray]

    @staticmethod
    def fit(keys: np.ndarray, counts: np.ndarray, symbols: int) -> SuffixTree:
        """From the (context, symbol) counts of ``symbols`` symbols; contexts are tested from short to long."""
        depth, rest = keys >> _DEPTH_SHIFT, keys & ((1 << _DEPTH_SHIFT) - 1)
        root = np.zeros(symbols)
        top = depth == 0
        root[rest[top]] = counts[top]
        seen = max(np.count_nonzero(root), 1)
        tree = SuffixTree((root + seen / symbols) / (root.sum() + seen), [], [], [], [])
        for d in range(1, DEPTH + 1):
            at = np.flatnonzero(depth == d)
            at = at[np.argsort(rest[at], kind="stable")]
            edge, n = rest[at], counts[at].astype(float)
            context, symbol = edge >> _BITS, edge & ((1 << _BITS) - 1)
            shorter = tree.probability(context, np.full(len(context), d - 1), symbol)
            state, where, kept, left, chance = tested(context, n, shorter)
            inside = kept[where]
            tree.states.append(state[kept])
            tree.left.append(left[kept])
            tree.edges.append(edge[inside])
            tree.chance.append(chance[inside])
        return tree

    def probability(self, context: np.ndarray, known: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Chance of each symbol after its longest kept suffix of at most ``known`` symbols."""
        out = self.root[symbol]
        for d, (states, left, edges, chance) in enumerate(zip(self.states, self.left, self.edges, self.chance), 1):
            if not len(states):
                continue
            masked = context & ((1 << _BITS * d) - 1)
            i = np.minimum(np.searchsorted(states, masked), len(states) - 1)
            hit = (states[i] == masked) & (known >= d)
            out = np.where(hit, left[i] * out, out)
            wanted = (masked << _BITS) | symbol
            j = np.minimum(np.searchsorted(edges, wanted), len(edges) - 1)
            out = np.where(hit & (edges[j] == wanted), chance[j], out)
        return out

    def log10_symbols(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the chance of every symbol of the texts."""
        context, known = positions(symbols, lengths)
        code = (((known << _BITS * DEPTH) | context) << _BITS) | symbols
        distinct, where = np.unique(code, return_inverse=True)
        rest = distinct >> _BITS
        chance = self.probability(rest & ((1 << _BITS * DEPTH) - 1), rest >> _BITS * DEPTH, distinct & ((1 << _BITS) - 1))
        return np.log10(chance)[where]


@dataclass
class Model:
    """What a task needs besides the counts of its block's words."""

    common: np.ndarray  # sorted hashes of the words that are symbols
    root: np.ndarray  # chance of each symbol without a context
    depth: int
    salts: np.ndarray  # shares that the positions after a symbol are dealt in
    buckets: int
    tokens: int
    distinct: int
    ends: int
    discount: float
    other: int  # occurrences and distinct number of the other words
    others: int
    hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # by length: sorted keys, first share, shares
    suffix: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # number of each hot context's suffix, -1: none
    deal: np.ndarray | None = None  # bucket of each share
    needed: list[np.ndarray] = field(default_factory=list)  # buckets that ask for a hot context or one that it ends
    numbers: np.ndarray | None = None  # symbol of each of the common words, the most frequent first; in order if not given

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        """Symbol of each word hash."""
        if not len(self.common):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.common, keys), len(self.common) - 1)
        return np.where(self.common[at] == keys, at + _FIRST_WORD if self.numbers is None else self.numbers[at], OTHER)

    def routed(self, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share, number of the longest hot context or -1, its length) of every position."""
        share = (np.cumsum(self.salts) - self.salts)[spots[1]]
        number, length = np.full(len(share), -1, np.int32), np.zeros(len(share), np.uint8)
        at, key, before = np.arange(len(share)), _chained(np.zeros(len(share), np.uint64), spots[1]), 0
        for k, (keys, first, salts) in enumerate(self.hot, 1):
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[i] == key)
            at, i = at[hit], i[hit]
            then = spots[k + 1 if k < self.depth else 0][at]
            share[at] = first[i] + (_mixed(then.astype(np.uint64)) % salts[i].astype(np.uint64)).astype(np.int64)
            number[at], length[at] = before + i, k
            key, before = _chained(key[hit], then), before + len(keys)
        return share, number, length

    def bucket(self, share: np.ndarray) -> np.ndarray:
        return (_mixed(share.astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64) if self.deal is None else self.deal[share]

    def arranged(self, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place of each distinct position, its bucket, place of every position among them), in the order of asking."""
        _, first, where = np.unique(spot_keys(spots), return_index=True, return_inverse=True)
        distinct = spots[:, first]
        bucket = self.bucket(self.routed(distinct)[0])
        by, wide = bucket.astype(np.uint64), np.uint64(len(self.root) + 1)
        for symbol in (1, 0, 2) if self.buckets * int(wide) ** 3 < 2**64 else (1, 0):
            by = by * wide + (distinct[symbol] + np.uint32(1)).astype(np.uint64)
        order = np.argsort(by, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return first[order], bucket[order], place[where]

    def within(self, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of the chance of each word, given its symbol."""
        known = np.log10(np.maximum(count - self.discount, 1e-300) / max(self.other, 1))
        unseen = np.log10(self.discount * self.others / self.other) if self.other else 0.0
        return np.where(symbol != OTHER, 0.0, np.where(count > 0, known, unseen))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits mixed, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chained(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return _mixed(key * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64) + np.uint64(1))


def spots_of(symbols: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Per position: the symbol, then those before it, the last one first, ``_NONE`` beyond the start."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((depth + 1, len(symbols)), _NONE, np.uint32)
    out[0] = symbols
    for back in range(1, depth + 1):
        out[back, back:] = symbols[: max(len(symbols) - back, 0)]
        out[back, place == back - 1] = START
        out[back, place < back - 1] = _NONE
    return out


def spot_keys(spots: np.ndarray) -> np.ndarray:
    key = np.zeros(spots.shape[1], np.uint64)
    for symbol in spots[::-1]:
        key = _chained(key, symbol)
    return key


def heavy_contexts(spots: np.ndarray, most: float, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(sorted keys by length, number of each one's suffix) of the contexts that come before more than ``most`` positions.

    They are numbered by length, then key. The suffixes of one are among them.
    """
    found, suffix, before = [], [], 0
    at, key, parent = np.arange(spots.shape[1]), np.zeros(spots.shape[1], np.uint64), np.full(spots.shape[1], -1)
    for k in range(1, depth + 1):
        known = spots[k][at] != _NONE
        at, parent = at[known], parent[known]
        key = _chained(key[known], spots[k][at])
        keys, first, where, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        heavy = n > most
        if not heavy.any():
            break
        found.append(keys[heavy])
        suffix.append(parent[first[heavy]])
        number, inside = before + np.cumsum(heavy) - 1, heavy[where]
        at, key, parent = at[inside], key[inside], number[where[inside]]
        before += len(found[-1])
    return found, np.concatenate([np.empty(0, np.int64), *suffix])


def deal_out(model: Model, spots: np.ndarray) -> None:
    """Set which contexts are hot, in how many shares their positions are dealt, and the bucket of every share.

    ``spots`` are positions of rows taken by chance. A share is to fill half a bucket at most; shares go to the
    bucket with the least so far, the largest first.
    """
    most = max(spots.shape[1] / (2 * model.buckets), _LEAST)
    found, model.suffix = heavy_contexts(spots, most, model.depth)
    none = lambda keys: np.zeros(len(keys), np.int64)
    model.hot = [(keys, none(keys), none(keys) + 1) for keys in found]
    alone = np.bincount(model.routed(spots)[1] + 1, minlength=len(model.suffix) + 1)[1:]  # positions whose longest hot context it is
    salts = np.maximum(np.ceil(alone / most), 1).astype(np.int64)
    first = len(model.salts) + np.cumsum(salts) - salts
    cuts = np.cumsum([0, *map(len, found)])
    model.hot = [(keys, first[a:b], salts[a:b]) for keys, a, b in zip(found, cuts, cuts[1:])]
    load = np.bincount(model.routed(spots)[0], minlength=len(model.salts) + salts.sum())
    deal, full = np.empty(len(load), np.int64), [(0.0, b) for b in range(model.buckets)]
    for share in np.argsort(-load, kind="stable").tolist():
        size, b = full[0]
        deal[share] = b
        heapq.heapreplace(full, (size + load[share] + 0.01, b))
    model.deal, needed = deal, [set(deal[a : a + n].tolist()) for a, n in zip(first, salts)]
    for k in range(len(needed) - 1, -1, -1):
        if model.suffix[k] >= 0:
            needed[model.suffix[k]] |= needed[k]
    model.needed = [np.array(sorted(x), np.int64) for x in needed]


def spot_chances(spots: np.ndarray, n: np.ndarray, chance: np.ndarray, tested_to: np.ndarray) -> np.ndarray:
    """Chance of each distinct position, from all that share its contexts longer than ``tested_to`` symbols.

    ``n`` are the counts in training; ``chance`` is that after the longest kept context of up to ``tested_to`` symbols.
    """
    key, chance = np.zeros(spots.shape[1], np.uint64), chance.copy()
    for back, symbol in enumerate(spots[1:], 1):
        key = _chained(key, symbol)
        usable = np.flatnonzero((symbol != _NONE) & (tested_to < back))
        edge = _chained(key[usable], spots[0][usable])
        known = np.flatnonzero(n[usable])
        edges, first, where = np.unique(edge[known], return_index=True, return_inverse=True)
        if not len(edges):
            continue
        one = usable[known[first]]
        state, of, kept, left, after = tested(key[one], np.bincount(where, n[usable[known]]), chance[one])
        i = np.minimum(np.searchsorted(state, key[usable]), len(state) - 1)
        hit = (state[i] == key[usable]) & kept[i]
        j = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
        found = edges[j] == edge
        chance[usable] = np.where(hit, np.where(found, after[j], left[i] * chance[usable]), chance[usable])
    return chance


def _sequences(codes: np.ndarray, firsts: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the rows, each with its end, lengths)."""
    lengths = np.diff(firsts) + 1
    out = np.full(lengths.sum(), STOP, np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(lengths) - 1] = False
    out[inside] = symbol[codes]
    return out, lengths


def _ask(buckets: int):
    """Distinct words of each block, as one row per (block, bucket) of sorted hashes with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for table in bounded(batches):
            blocks, training = table["block"].to_numpy(), ~table["held_out"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:]):
                if block is not None and blocks[a] != block:
                    yield rows(block, held)
                    held = []
                block = int(blocks[a])
                codes, distinct, firsts = words_of(table["text"].slice(a, b - a))
                counted = np.repeat(training[a:b], np.diff(firsts))
                held.append((hashes(distinct.to_pylist()), np.bincount(codes[counted], minlength=len(distinct))))
        if block is not None:
            yield rows(block, held)

    def rows(block: int, held: list) -> pa.RecordBatch:
        keys, n = _add_up(held)
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)] if len(keys) else []
        spans = list(zip(cuts, cuts[1:]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([block] * len(spans), pa.int64()),
                pa.array([pack_sorted(keys[a:b]) for a, b in spans], pa.binary()), pa.array([pack(n[a:b]) for a, b in spans], pa.binary()),
            ],
            ["bucket", "block", "keys", "n"],
        )

    return run


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of the parts and the sums of their counts."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


_ANSWERED = ["kind", "block", "part", "keys", "totals"]
_ANSWERS = 256  # rows of a batch


def _answers(rows: list[tuple], ids: pa.Array | None = None) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns if ids is None else [*columns, ids], _ANSWERED if ids is None else [*_ANSWERED, "ids"])


def _answer():
    """Per bucket: totals for every asking block (kind 1), sums of the corpus (2), and all its words of training (3).

    Rows come sorted by bucket; what the blocks ask of one bucket is held at once.
    """

    def close(bucket: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, total = _add_up([(k, n) for _, k, n in held])
        rows = [(1, block, bucket, b"", total[np.searchsorted(keys, asked)]) for block, asked, _ in held]
        rows.append((2, 0, bucket, b"", np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()])))
        rows.append((3, 0, bucket, pack_sorted(keys[total > 0]), total[total > 0]))
        for a in range(0, len(rows), _ANSWERS):
            yield _answers([(*row, pack(values.astype(np.int64))) for *row, values in rows[a : a + _ANSWERS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, block, keys, n in zip(*(batch.column(k).to_pylist() for k in ("bucket", "block", "keys", "n"))):
                if bucket is not None and b != bucket:
                    yield from close(bucket, held)
                    held = []
                bucket = b
                held.append((block, unpack_sorted(keys), unpack(n, np.int64)))
        if held:
            yield from close(bucket, held)

    return run


def _pairs_of(kind: int):
    """(key, n) rows from packed rows; the sums of the corpus are keyed by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, totals in zip(batch.column("keys").to_pylist(), batch.column("totals").to_pylist()):
                n = unpack(totals, np.int64)
                key = unpack_sorted(keys).view(np.int64) if kind == 3 else np.arange(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    return run


def _lines(model):
    """The symbols of the rows with their ends, packed, and the lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bounded(batches):
            codes, distinct, firsts = words_of(table["text"])
            symbols, lengths = _sequences(codes, firsts, model.value.symbols(hashes(distinct.to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array([pack(symbols.astype(np.int64))], pa.binary()), pa.array([pack(lengths.astype(np.int64))], pa.binary())], ["symbols", "lengths"])

    return run


def _count_edges(model):
    """What follows the hot contexts: per context its sorted next symbols and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def hand_in() -> pa.RecordBatch:
            keys, n = _add_up(held)
            cuts = np.cumsum([0, *(len(k) for k, _, _ in model.value.hot)])
            for a, b in reversed([*zip(cuts, cuts[1:])][1:]):  # what follows a context follows its suffix
                part = slice(*np.searchsorted(keys, np.array([a, b], np.uint64) << np.uint64(32)))
                suffix = model.value.suffix[(keys[part] >> np.uint64(32)).astype(np.int64)].astype(np.uint64)
                keys, n = _add_up([(keys, n), ((suffix << np.uint64(32)) | (keys[part] & np.uint64(_NONE)), n[part])])
            context = (keys >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(context)) + 1).tolist(), len(keys)] if len(keys) else []
            spans, symbol = list(zip(cuts, cuts[1:])), (keys & np.uint64(_NONE)).astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([context[a] for a, _ in spans], pa.int64()), pa.array([pack(np.diff(symbol[a:b], prepend=np.uint32(0))) for a, b in spans], pa.binary()), pa.array([pack(n[a:b]) for a, b in spans], pa.binary())],
                ["context", "symbols", "n"],
            )

        for table in bounded(batches):
            codes, distinct, firsts = words_of(table["text"])
            spots = spots_of(*_sequences(codes, firsts, model.value.symbols(hashes(distinct.to_pylist()))), model.value.depth)
            number = model.value.routed(spots)[1]
            hot = np.flatnonzero(number >= 0)
            held.append(np.unique((number[hot].astype(np.uint64) << np.uint64(32)) | spots[0, hot], return_counts=True))
            size += len(held[-1][0])
            if size > _FLUSH:
                held = [_add_up(held)]
                size = len(held[0][0])
                if size > _FLUSH // 2:
                    yield hand_in()
                    held, size = [], 0
        if held:
            yield hand_in()

    return run


_ASKED = ["bucket", "kind", "block", "part", "keys", "n"]


def _hot_edges(model):
    """The counts after each hot context, as one row for each bucket that needs them. Rows come sorted by context."""

    def rows(context: int, total: np.ndarray) -> pa.RecordBatch:
        buckets, symbols = model.value.needed[context].tolist(), np.flatnonzero(total)
        many, keys, n = len(buckets), pack(symbols.astype(np.uint32)), pack(total[symbols])
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int32()), pa.array([0] * many, pa.int32()), pa.array([context] * many, pa.int64()), pa.array([0] * many, pa.int32()), pa.array([keys] * many, pa.binary()), pa.array([n] * many, pa.binary())], _ASKED
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, total = None, None
        for batch in batches:
            for c, symbols, n in zip(*(batch.column(k).to_pylist() for k in ("context", "symbols", "n"))):
                if c != context:
                    if context is not None:
                        yield rows(context, total)
                    context, total = c, np.zeros(len(model.value.root), np.int64)
                total[np.cumsum(unpack(symbols, np.uint32))] += unpack(n, np.int64)
        if context is not None:
            yield rows(context, total)

    return run


def _ask_spots(model, spelled: bool = False):
    """Distinct positions of each block, as one row per (block, bucket) with their training counts (kind 1).

    Where ``spelled``, also a row with the ids and words of the block (kind 3): (2 * length + held out) of its rows and
    the symbols of its words by hash, and the words as codes (``coded``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for table in bounded(batches):
            blocks = table["block"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:]):
                if block is not None and blocks[a] != block:
                    yield from rows(block, held)
                    held = []
                block = int(blocks[a])
                held.append(read(table.slice(a, b - a)))
        if block is not None:
            yield from rows(block, held)

    def read(part: pa.Table) -> tuple:
        codes, distinct, firsts = words_of(part["text"])
        return part["id"] if spelled else None, part["held_out"].to_numpy(), codes.astype(np.uint32), hashes(distinct.to_pylist()), np.diff(firsts)

    def rows(block: int, held: list) -> Iterator[pa.RecordBatch]:
        ids, out, codes, own, words = zip(*held)
        keys = np.unique(np.concatenate(own))
        codes = np.concatenate([np.searchsorted(keys, k)[c] for k, c in zip(own, codes)]).astype(np.uint32)
        out, words, symbol = np.concatenate(out), np.concatenate(words), model.value.symbols(keys)
        if spelled:
            about = np.concatenate([[len(words)], 2 * (words + 1) + out, symbol]).astype(np.int64)
            column = pa.chunked_array([c for x in ids for c in x.chunks]).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(_mixed(np.array([block], np.uint64))[0] % np.uint64(model.value.buckets))], pa.int32()), pa.array([3], pa.int32()), pa.array([block], pa.int64()), pa.array([0], pa.int32()),
                    pa.array([pack(about)], pa.binary()), pa.array([pack(coded(symbol)[1][codes])], pa.binary()), pa.ListArray.from_arrays([0, len(column)], column),
                ],
                [*_ASKED, "ids"],
            )
        symbols, lengths = spelling(codes, words + 1, symbol)
        for piece, (a, b) in enumerate(pieces(lengths)):
            spots, size = spots_of(symbols[lengths[:a].sum() : lengths[:b].sum()], lengths[a:b], model.value.depth), model.value.buckets
            first, bucket, where = model.value.arranged(spots)
            n, spots = np.bincount(where, np.repeat(~out[a:b], lengths[a:b]), minlength=len(first)).astype(np.uint32), spots[:, first]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            spans = list(zip(cuts, cuts[1:]))
            columns = [
                pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([1] * len(spans), pa.int32()), pa.array([block] * len(spans), pa.int64()),
                pa.array([piece * size + int(bucket[a]) for a, _ in spans], pa.int32()),
                pa.array([pack(spots[:, a:b]) for a, b in spans], pa.binary()), pa.array([pack(n[a:b]) for a, b in spans], pa.binary()),
            ]
            if spelled:
                columns.append(pa.nulls(len(spans), pa.list_(column.type)))
            yield pa.RecordBatch.from_arrays(columns, [*_ASKED, "ids"][: len(columns)])

    return run


def coded(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of each code, code of each word): common words by symbol, the others behind them in the order given."""
    order = np.argsort(np.where(symbol == OTHER, _NONE, symbol), kind="stable")
    codes = np.empty(len(order), np.uint32)
    codes[order] = np.arange(len(order))
    return order, codes


def spelling(codes: np.ndarray, lengths: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _sequences(codes, np.concatenate([[0], np.cumsum(lengths - 1)]), symbol)


def pieces(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Spans of rows that ask together: as many as start within ``_PIECE`` positions."""
    which = (np.cumsum(lengths) - lengths) // _PIECE
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(lengths)]
    return list(zip(cuts, cuts[1:]))


def _answer_spots(model):
    """Per bucket: the chance of every position that a block asks for (kind 2). The words of blocks go through (kind 3).

    Rows come sorted by bucket, what follows its hot contexts first. What the blocks ask of one bucket is held at once,
    and tested by groups of shares.
    """

    def hot_chances(tables: dict):
        """Chance of every symbol after the longest kept context, by number of the longest hot one."""
        known = {-1: model.value.root}

        def after(number: int) -> np.ndarray:
            if number not in known:
                shorter = after(int(model.value.suffix[number]))
                if number in tables:
                    symbols, n = tables[number]
                    _, _, kept, left, chance = tested(np.zeros(len(symbols), np.int64), n.astype(float), shorter[symbols])
                    if kept[0]:
                        shorter = left[0] * shorter
                        shorter[symbols] = chance
                known[number] = shorter
            return known[number]

        return after

    def group(spots: np.ndarray, n: np.ndarray, number: np.ndarray, length: np.ndarray, after) -> np.ndarray:
        keys, first, where = np.unique(spot_keys(spots), return_index=True, return_inverse=True)
        n, spots, number = np.bincount(where, n, minlength=len(keys)), spots[:, first], number[first]
        chance = np.empty(len(keys))
        order = np.argsort(number, kind="stable")
        numbers, starts = np.unique(number[order], return_index=True)
        for k, a, b in zip(numbers.tolist(), starts, [*starts[1:], len(order)]):
            chance[order[a:b]] = after(k)[spots[0][order[a:b]]]
        return spot_chances(spots, n, chance, length[first])[where]

    def close(tables: dict, held: list, listed: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        cuts = np.cumsum([0, *(packed_size(n) for _, _, _, n in held)])
        spots, n = np.empty((model.value.depth + 1, cuts[-1]), np.uint32), np.empty(cuts[-1], np.uint32)
        share, number, length = np.empty(cuts[-1], np.uint32), np.empty(cuts[-1], np.int32), np.empty(cuts[-1], np.uint8)
        for i, (block, part, asked, counts) in enumerate(held):
            spots[:, cuts[i] : cuts[i + 1]] = unpack(asked, np.uint32).reshape(len(spots), -1)
            n[cuts[i] : cuts[i + 1]] = unpack(counts, np.uint32)
            held[i] = block, part
        for a in range(0, len(n), _GROUP):
            share[a : a + _GROUP], number[a : a + _GROUP], length[a : a + _GROUP] = model.value.routed(spots[:, a : a + _GROUP])
        order = np.argsort(share, kind="stable")
        starts = np.flatnonzero(np.diff(share[order], prepend=-1))
        groups = starts[np.flatnonzero(np.diff(starts // _GROUP, prepend=-1))].tolist()
        chance, after = np.empty(len(n)), hot_chances(tables)
        for a, b in zip(groups, [*groups[1:], len(order)]):
            at = order[a:b]
            chance[at] = group(spots[:, at], n[at], number[at], length[at], after)
        for a in range(0, len(held), _ANSWERS):
            rows = [(2, block, part, b"", pack(chance[cuts[i] : cuts[i + 1]])) for i, (block, part) in enumerate(held[a : a + _ANSWERS], a)]
            yield _answers(rows, listed and pa.nulls(len(rows), listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tables, held, listed = None, {}, [], None
        for batch in batches:
            if "ids" in batch.schema.names:
                listed = batch.schema.field("ids").type
            for i, (b, kind, block, part, keys, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in _ASKED))):
                if b != bucket:
                    if held:
                        yield from close(tables, held, listed)
                    bucket, tables, held = b, {}, []
                if kind == 0:
                    tables[block] = unpack(keys, np.uint32), unpack(n, np.int64)
                elif kind == 1:
                    held.append((block, part, keys, n))
                else:
                    yield _answers([(3, block, part, keys, n)], batch.column("ids").slice(i, 1))
        if held:
            yield from close(tables, held, listed)

    return run


_SCORES = (("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))


def _score(broadcast):
    """Rows come sorted by block: its totals by bucket, its chances by piece and bucket, its words."""

    def close(totals: list, chances: list, about: bytes, codes: bytes, ids: pa.Array) -> pa.RecordBatch:
        model: Model = broadcast.value
        about, codes = unpack(about, np.int64), unpack(codes, np.uint32)
        n = int(about[0])
        lengths, out, symbol = about[1 : n + 1] // 2, about[1 : n + 1] % 2 == 1, about[n + 1 :]
        c, chances = (np.concatenate([np.empty(0, k), *(unpack(x, k) for x in xs)]) for xs, k in ((totals, np.int64), (chances, np.float64)))
        codes = coded(symbol)[0][codes]
        symbols, lengths = spelling(codes, lengths, symbol)
        after, asked, start = np.empty(len(symbols)), 0, 0
        for a, b in pieces(lengths):
            stop = start + lengths[a:b].sum()
            first, _, where = model.arranged(spots_of(symbols[start:stop], lengths[a:b], model.depth))
            after[start:stop] = np.log10(chances[asked : asked + len(first)])[where]
            asked, start = asked + len(first), stop
        owner, words = np.repeat(np.arange(n), lengths), np.repeat(np.arange(n), lengths - 1)
        add = lambda x: np.bincount(words, x[codes], minlength=n)
        base_total = model.tokens + 0.1 * (model.distinct + 1)
        base = add(np.log10((c + 0.1) / base_total)) + np.log10((model.ends + 0.1) / base_total)
        spelled = np.bincount(owner, after, minlength=n) + add(model.within(symbol, c))
        columns = [
            pa.array(out), pa.array(lengths), pa.array(add(c > 0).astype(np.int64) + bool(model.ends)),
            pa.array(np.full(n, model.tokens, np.int64)), pa.array(base), pa.array(spelled),
        ]
        return pa.RecordBatch.from_arrays([ids, *columns], ["id", *[name for name, _ in _SCORES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, chances = [], []
        for batch in batches:
            for i, (kind, keys, values) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("kind", "keys", "totals")))):
                if kind == 3:
                    yield close(totals, chances, keys, values, batch.column("ids").slice(i, 1).flatten())
                    totals, chances = [], []
                else:
                    (totals if kind == 1 else chances).append(values)

    return run


def language_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0,
                    common: int | None = None, depth: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32 of the id (as text) leaves ``held_fold`` modulo ``folds`` are held out of training; a null id
    is a training row. A null text is an empty one: its only token is the end. Repeated rows count as often as
    they are there. With no training row, symbols are uniform. An empty table gives no rows. Other columns are not
    read. The input has to be recomputable (files or a checkpoint): blocks are runs of ``BLOCK_ROWS`` rows of a scan
    partition. ``base_score`` is the add-0.1 unigram model's log10 probability. ``common`` (words that are symbols) and
    ``depth`` (symbols of the longest context, 2 at least) follow from the training tokens where they are not given.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(64, parts)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    block = F.floor(F.monotonically_increasing_id() / BLOCK_ROWS).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"), block.alias("block"))
    asked = rows.select("text", "held_out", "block").mapInArrow(_ask(buckets), "bucket int, block long, keys binary, n binary")
    packed = "kind int, block long, part int, keys binary, totals binary"
    answers = materialize(asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(), packed))
    pairs = lambda kind: answers.filter(F.col("kind") == kind).select("keys", "totals").mapInArrow(_pairs_of(kind), "key long, n long")
    sums = {r["key"]: r["n"] for r in pairs(2).groupBy("key").agg(F.sum("n").alias("n")).collect()}
    words, distinct, once, twice = (sums.get(k, 0) for k in range(4))
    ends = rows.filter("not held_out").count()
    common, depth = symbols_for(words + ends) if common is None else common, depth_for(words + ends) if depth is None else depth
    top = pairs(3).orderBy(F.desc("n"), "key").limit(common).collect()
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once + twice else 0.5
    other, others = words - sum(r["n"] for r in top), distinct - len(top)
    seen = np.array([other, ends, 0, *(r["n"] for r in top)], float)  # in the order of OTHER, STOP, START and the common words
    top = np.array([r["key"] % 2**64 for r in top], np.uint64)
    kinds = max(np.count_nonzero(seen), 1)
    spot_buckets = max(buckets, (words + ends) // _BUCKET_TOKENS)
    model = Model(
        np.sort(top), (seen + kinds / len(seen)) / (seen.sum() + kinds), depth, np.ones(len(seen), np.int64), spot_buckets,
        int(words + ends), int(distinct + bool(ends)), int(ends), discount, int(other), int(others),
        numbers=np.argsort(top) + _FIRST_WORD,
    )
    looked = rows.withColumn("row", F.monotonically_increasing_id()).filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) <= (1 << 30) * max(_SEEN * spot_buckets, 1 << 20) / max(words + ends, 1))
    lines = looked.select("text").mapInArrow(_lines(spark.sparkContext.broadcast(model)), "symbols binary, lengths binary").collect()
    unpacked = lambda k: np.concatenate([np.empty(0, np.int64), *(unpack(bytes(r[k]), np.int64) for r in lines)])
    deal_out(model, spots_of(unpacked("symbols"), unpacked("lengths"), depth))
    sent = spark.sparkContext.broadcast(model)
    counted = rows.filter("not held_out").select("text").mapInArrow(_count_edges(sent), "context long, symbols binary, n binary")
    counted = counted.repartition(parts, "context").sortWithinPartitions("context")
    listed = f"array<{dict(rows.dtypes)['id']}>"
    asked = "bucket int, kind int, block long, part int, keys binary, n binary"
    spots = rows.mapInArrow(_ask_spots(sent, spelled=True), f"{asked}, ids {listed}")
    spots = spots.unionByName(counted.mapInArrow(_hot_edges(sent), asked).selectExpr("*", f"cast(null as {listed}) as ids"))
    answered = spots.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer_spots(sent), f"{packed}, ids {listed}")
    met = answers.filter("kind = 1").selectExpr("*", f"cast(null as {listed}) as ids").unionByName(answered)
    met = met.repartition(parts, "block").sortWithinPartitions("block", "kind", "part")
    schema = rows.select("id").schema
    for name, kind in _SCORES:
        schema = schema.add(name, {pa.bool_(): "boolean", pa.int64(): "long", pa.float64(): "double"}[kind])
    return met.mapInArrow(_score(sent), schema).withColumnRenamed("id", id_col)
