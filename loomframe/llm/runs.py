"""Periodic runs of words, found with longest common extensions over a difference cover.

A run is a stretch of words with a smallest period ``q``, at least ``max(24, 3 * q)`` words long, that cannot be
extended on either side. Every period ``p`` has a grid of places ``0, p, 2p, ...`` of a document. A run of period
``p`` spans two neighbouring places ``i`` and ``i + p`` of its grid at least, and starts less than ``p`` words
before its first place. So all runs come out of the pairs (i, i + p) of all grids, n/1 + n/2 + n/3 + ... of them,
if one can tell how far the words from ``i`` and from ``i + p`` on agree: the longest common extension (LCE).

The LCE index sorts sampled suffixes only, those at places whose remainder by ``V`` lies in a difference cover: for
any two places ``a`` and ``b`` some shift below ``V`` brings both onto sampled places. Up to there the few words are
compared one by one; from there on the answer is the least value between two ranks in the table of common prefixes
of neighbouring sampled suffixes, read from a sparse table. Sampled suffixes are sorted by blocks of ``V`` words
named in any consistent order, with doubled block lengths; common prefixes are counted in blocks, and the last,
broken block is compared word by word again.

Texts are whole rows and stay in their tasks: nothing is shuffled. Many documents share one index, apart through
their number, so that short ones cost no more than their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.tokens import bounded

V = 31
#: A perfect difference set; every remainder modulo 31 is a difference of two of them.
COVER = (1, 5, 11, 24, 25, 27)
LEAST, TIMES = 24, 3  # words and periods of a run
GRID = 1 << 20  # grid pairs looked at together
BATCH = 2 << 20  # text bytes handled together; a longer text by itself


def shift_table() -> np.ndarray:
    """shift[a, b]: the least shift that brings places with remainders ``a`` and ``b`` onto the cover."""
    table = np.zeros((V, V), np.int64)
    sampled = np.zeros(2 * V, bool)
    sampled[[c + k for c in COVER for k in (0, V)]] = True
    for a in range(V):
        for b in range(V):
            table[a, b] = next(s for s in range(V) if sampled[a + s] and sampled[b + s])
    return table


SHIFT = shift_table()


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of integer keys, equal rows alike, in the order of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        sorted_ = key[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


class Extensions:
    """LCE over the concatenated words of some documents; extensions end where a document ends."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.ends = np.repeat(bounds[1:], np.diff(bounds))  # end of the document of each word
        n = len(words)
        self.words = np.concatenate([words, np.full(V, -1, np.int64)])
        places = np.arange(n)
        at = places[np.isin(places % V, COVER)]
        self.rank = np.full(n + 1, -1, np.int64)
        owner = np.searchsorted(bounds, at, "right")
        # Blocks of V words from each sampled place; beyond the end of its document a block has gaps of its own kind.
        inside = self.ends[at]
        names = owner
        for low in range(0, V, 4):
            step = range(low, min(low + 4, V))
            names = dense(names, *[np.where(at + k < inside, self.words[np.minimum(at + k, n)], -1) for k in step])
        # Doubling: rank by 1, 2, 4, ... blocks until all suffixes differ. The next sampled place of a suffix is V on.
        slot = np.full(n + V + 1, -1, np.int64)
        slot[at] = np.arange(len(at))
        levels, span = [names], 1
        while len(at) and levels[-1].max() + 1 < len(at):
            follow = at + V * span
            follow = np.where(follow < inside, slot[np.minimum(follow, n)], -1)
            levels.append(dense(levels[-1], np.where(follow >= 0, levels[-1][follow], -1)))
            span *= 2
        order = np.lexsort((at, levels[-1])) if len(at) else at
        self.rank[at[order]] = np.arange(len(at))
        self.least = [self._common(at, order, levels, slot, inside)]
        while (1 << len(self.least)) <= len(at):
            below, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(below[: len(below) - half], below[half:]))

    def _common(self, at, order, levels, slot, inside) -> np.ndarray:
        """Equal whole blocks of each sampled suffix and the one before it in the order."""
        if not len(at):
            return np.empty(0, np.int64)
        a, b = order[1:].copy(), order[:-1].copy()
        blocks, live = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(len(levels) - 1, -1, -1):
            same = live.copy()
            same[live] = levels[k][a[live]] == levels[k][b[live]]
            blocks[same] += 1 << k
            for side in (a, b):
                follow = at[side[same]] + (V << k)
                side[same] = np.where(follow < inside[side[same]], slot[np.minimum(follow, len(slot) - 1)], -1)
            live &= (a >= 0) & (b >= 0)
        return np.concatenate([[0], blocks])

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and ``b`` on, one by one, ``most`` at the most."""
        out, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(live):
            live = live[self.words[a[live] + out[live]] == self.words[b[live] + out[live]]]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from places ``a`` and ``b`` (``a < b``, same document) on."""
        room = self.ends[b] - b
        shift = np.minimum(SHIFT[a % V, b % V], room)
        out = self._compare(a, b, shift)
        far = np.flatnonzero((out == shift) & (shift < room))
        if len(far):
            x, y = self.rank[a[far] + shift[far]], self.rank[b[far] + shift[far]]
            low, high = np.minimum(x, y) + 1, np.maximum(x, y)
            level = np.frexp((high - low + 1).astype(float))[1] - 1
            blocks = np.empty(len(far), np.int64)
            for k in np.unique(level):
                on = level == k
                table = self.least[k]
                blocks[on] = np.minimum(table[low[on]], table[high[on] - (1 << k) + 1])
            words = np.minimum(blocks * V, room[far] - shift[far])
            out[far] += words
            out[far] += self._compare(a[far] + out[far], b[far] + out[far], np.minimum(V, room[far] - out[far]))
        return out


def grids(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid pairs of documents that can hold a run, periods up to a third of a document."""
    start, n = bounds[:-1], np.diff(bounds)
    long = np.flatnonzero(n >= LEAST)
    most = n[long] // TIMES
    doc = np.repeat(long, most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    size = n[doc] // period
    ends = np.cumsum(size)
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRID, "right")))
        part, own = slice(at, stop), size[at:stop]
        step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        p = np.repeat(period[part], own)
        yield np.repeat(start[doc[part]], own) + step * p, p
        at = stop


def candidates(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid pairs that can be the first of a run: a few words that must agree with those a period on do."""
    ends, found = np.repeat(bounds[1:], np.diff(bounds)), []
    for i, p in grids(bounds):
        # A run has its first place less than p after its start, so this many words from there on repeat.
        sure = np.maximum(LEAST, TIMES * p) - 2 * p + 1
        for probe in (lambda n: 0, lambda n: n - 1, lambda n: n // 2):
            a = i + probe(sure)
            good = a + p < ends[i]
            good[good] = words[a[good]] == words[a[good] + p[good]]
            i, p, sure = i[good], p[good], sure[good]
        found.append((i, p))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([p for _, p in found])


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the documents ``words[bounds[d] : bounds[d + 1]]``, by start, then period."""
    place, period = candidates(words, bounds)
    nothing = np.empty(0, np.int64)
    if not len(place):
        return nothing, nothing, nothing
    # The index holds the documents with candidates; places move along.
    doc = np.searchsorted(bounds, place, "right") - 1
    docs = np.unique(doc)
    sizes = np.diff(bounds)[docs]
    own = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(own[-1]) + np.repeat(bounds[docs] - own[:-1], sizes)
    row = np.searchsorted(docs, doc)
    moved = place - bounds[docs][row] + own[:-1][row]
    index = Extensions(words[take], own)
    ahead = np.concatenate([index.lce(moved[at : at + GRID], moved[at : at + GRID] + period[at : at + GRID]) for at in range(0, len(moved), GRID)])
    # Where the place before, on the same grid, reaches up to this one, this one is not the first of its run.
    first_place = np.ones(len(moved), bool)
    first_place[1:] = (period[1:] != period[:-1]) | (moved[:-1] != moved[1:] - period[1:]) | (row[1:] != row[:-1]) | (ahead[:-1] < period[1:])
    place, moved, period, row, ahead = (x[first_place] for x in (place, moved, period, row, ahead))
    starts, lengths, periods = [], [], []
    for at in range(0, len(moved), GRID):
        i, p, first = moved[at : at + GRID], period[at : at + GRID], own[:-1][row[at : at + GRID]]
        # The run starts where extensions begin to reach i: less than p words before, or i is not its first place.
        low, high = np.maximum(i - p, first), i.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            reaches = index.lce(middle, middle + p[open_]) >= i[open_] - middle
            high[open_[reaches]] = middle[reaches]
            low[open_[~reaches]] = middle[~reaches] + 1
        length = ahead[at : at + GRID] + p + (i - low)
        good = ((low > i - p) | (low == first)) & (length >= np.maximum(LEAST, TIMES * p))
        shift = (place - moved)[at : at + GRID]
        starts.append((low + shift)[good])
        lengths.append(length[good])
        periods.append(p[good])
    start, length, period = np.concatenate(starts), np.concatenate(lengths), np.concatenate(periods)
    # Of equal stretches the smallest period stays: such a stretch has all multiples of it as periods too.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def runs_of_texts(texts: list[bytes | None]) -> list[tuple]:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed, collapsed_sha256) of each text."""
    split = [(t or b"").split() for t in texts]  # bytes split at ASCII white space
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    flat = [w for words in split for w in words]
    codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if flat else np.empty(0, np.int64)
    start, length, period = find_runs(codes, bounds)
    doc = np.searchsorted(bounds, start, "right") - 1
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    dropped = np.zeros(len(flat) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    dropped = np.cumsum(dropped) > 0
    out = []
    for d, words in enumerate(split):
        low, high = cut[d], cut[d + 1]
        own = [(s - int(bounds[d]), n, q) for s, n, q in zip(start[low:high].tolist(), length[low:high].tolist(), period[low:high].tolist())]
        best = None
        for run in own:  # by start, then period: the first of equals stays
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        if own:
            gone = dropped[bounds[d] : bounds[d + 1]].tolist()
            words = [w for w, x in zip(words, gone) if not x]
        collapsed = b" ".join(words)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((len(own), *shown, _sha("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()), collapsed.decode(), _sha(collapsed)))
    return out


def _runs_task(keep_text: bool):
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.string()]
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bounded(batches, limit=BATCH):
            columns = list(zip(*runs_of_texts(table["text"].cast(pa.binary()).to_pylist())))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            kept = [(n, a) for n, a in zip(names, arrays) if keep_text or n != "collapsed"]
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), *[a for _, a in kept]], ["id", *[n for n, _ in kept]])

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Runs of each row and its text without repeats.

    (id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed, collapsed_sha256): start (a word
    number), length and period are those of the run with most periods (ties: smallest start, then period), null
    without runs; ``runs_sha256`` digests all runs as ``start,length,period`` lines; ``collapsed`` has the words
    that no run contains after its first period, joined by one space. Words end at ASCII white space. Null and
    empty texts have no words. Repeated rows and ids are passed on, an empty table gives no rows; other columns
    are not read. A text is handled in memory, as a whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.select("id").schema
    for name in ("n_runs", "start", "length", "period", "exponent_milli"):
        schema = schema.add(name, "long")
    for name in ("runs_sha256", *(["collapsed"] if keep_text else []), "collapsed_sha256"):
        schema = schema.add(name, "string")
    return rows.mapInArrow(_runs_task(keep_text), schema).withColumnRenamed("id", id_col)


def with_planted_runs(id_col: str, text_col: str) -> Column:
    """The dealt input of op13: in a tenth of the documents the words repeat from some place on."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g, text = F.floor(h / 10), F.btrim(F.col(text_col), F.lit(" \t\n\x0b\f\r"))
    words = F.split(text, r"[\x20\x09-\x0D]+")
    chosen = (h % 10 == 0) & (F.length(text) > 0)

    def repeat(box: Column) -> Column:
        n, ws = F.size(box), box
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        turns = F.flatten(F.array_repeat(F.slice(ws, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(ws, F.lit(1), a), F.slice(turns, F.lit(1), n - a)), " ")

    # One element, so that the words are split once and named.
    return F.when(chosen, F.transform(F.array(words), repeat)[0]).otherwise(F.col(text_col))
