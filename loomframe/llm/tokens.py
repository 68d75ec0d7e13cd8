"""Ids of whole texts, each distinct white-space chunk encoded once.

A text is cut in front of every run of ASCII white space (unless a wider white-space character stands
right before the run) and between an ASCII letter and ASCII punctuation. None of the public tokenizers
used here looks across such a cut, so the ids of a text are the ids of its chunks, one after the other; ``tests/llm/test_tokens.py`` holds this against the
plain library. A chunk seen before is not encoded again: distinct chunks are found per batch with Arrow's
dictionary encoding, and their ids are kept in a bounded cache of the Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BATCH_BYTES = 4 << 20  # text bytes handled at once; a longer text is a batch of its own
CACHE_CHUNKS = 450_000  # chunks a worker remembers (short ones, about 100 bytes each)
CACHE_CHUNK_BYTES = 48  # longer chunks are encoded anew in each batch

#: UTF-8 endings of the white-space characters beyond ASCII.
_WIDE_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf",
                b"\xe2\x81\x9f", b"\xe3\x80\x80", *(b"\xe2\x80" + bytes([x]) for x in range(0x80, 0x8B)))

#: ASCII punctuation that may be cut off after an ASCII letter: all but the bar, which ends special strings.
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "|"]] = True
_FOLD = np.array([32 if x == 32 or 9 <= x <= 13 else x | 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; nulls are empty. Offsets are 64 bits wide and start at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spaces(raw: np.ndarray) -> np.ndarray:
    """True at ASCII white space."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the chunks; every non-empty row starts one."""
    if not len(raw):
        return np.empty(0, np.int64)
    blank = spaces(raw)
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    cut = np.flatnonzero(first)
    odd = cut[raw[cut - 1] >= 0x80]  # at 0 this looks at the last byte, and 0 is a row start anyway
    if len(odd):
        for end in _WIDE_SPACES:
            hit = odd >= len(end)
            for i, value in enumerate(reversed(end)):
                hit &= raw[odd - 1 - i] == value
            first[odd[hit]] = False
    lower = raw | 32
    first[1:] |= ((lower >= 97) & (lower <= 122))[:-1] & _PUNCTUATION[raw[1:]]
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(first)


def folded(raw: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case and ASCII white space as spaces, for tokenizers that do the same anyway.

    A batch with the opening of a special string is left as it is, since those match the plain text only.
    """
    special = (raw[:-1] == 60) & (raw[1:] == 124)
    if special.any():
        return raw
    return _FOLD[raw]


def chunk_codes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """(code of each chunk, distinct chunks)."""
    bounds = np.append(starts, len(raw)).astype(np.int64)
    chunks = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]
    ).dictionary_encode()
    return chunks.indices.to_numpy(), chunks.dictionary


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once per Python process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkEncoder:
    """Encodes chunks with a bounded memory of earlier ones; ``fold`` for tokenizers that lower-case."""

    def __init__(self, path: str, fold: bool = False, limit: int = CACHE_CHUNKS):
        self.tokenizer, self.fold, self.limit = load(path), fold, limit
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)  # ids that end a word, where the model marks them
        if suffix:
            self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.starts, self.lengths, self.ids, self.n_ids, self.n_slots = [], [], [], 0, 0
        self.used = np.zeros(0, np.int64)  # times a chunk was met again

    def make_room(self) -> None:
        """Forget the chunks that were not met again, and of the others the less used half of the limit."""
        starts, lengths, flat = self.starts_array(), self.lengths_array(), self.flat()
        again = np.sort(self.used[self.used > 0])
        least = max(int(again[-(self.limit // 2)]) + 1 if len(again) > self.limit // 2 else 1, 1)
        kept = [(c, i) for c, i in self.slots.items() if self.used[i] >= least]
        slots = np.array([i for _, i in kept], np.int64)
        used = self.used[slots] // 2
        self.clear()
        if not kept:
            return
        length = lengths[slots]
        ends = np.cumsum(length)
        self.ids = [flat[np.repeat(starts[slots] - ends + length, length) + np.arange(ends[-1])]]
        self.starts, self.lengths, self.used = [ends - length], [length], used
        self.n_ids, self.n_slots = int(ends[-1]), len(kept)
        self.slots = {c: i for i, (c, _) in enumerate(kept)}

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks one after the other, number of ids of each), by the library.

        Words of letters after a space go together as one text, which the library takes half the time for.
        """
        texts = [c.decode("utf-8", "replace") for c in chunks]
        plain = np.array([t[:1] == " " and t[1:].isalpha() for t in texts], bool)
        if plain.all() or not plain.any():
            return self._encoded(texts, bool(plain.any()))
        parts, lengths = [], np.zeros(len(texts), np.int64)
        for at in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            own, lengths[at] = self._encoded([texts[i] for i in at.tolist()], bool(plain[at[0]]))
            parts.append((at, own))
        ends = np.cumsum(lengths)
        ids = np.empty(ends[-1], np.int32)
        for at, own in parts:
            n = lengths[at]
            ids[np.repeat((ends - lengths)[at] - np.cumsum(n) + n, n) + np.arange(len(own))] = own
        return ids, lengths

    def _encoded(self, texts: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            own, n = self._joint(part) if plain else (None, None)
            if n is None or len(n) != len(part):  # not one word of the library's for each chunk
                coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                own, n = np.array(coded.ids, np.int32), np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part))
            ids.append(own)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _joint(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each of the library's words) of the text that ``part`` makes."""
        text = "".join(part)
        if self.closing.any():
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            last = np.flatnonzero(self.closing[ids])
        else:
            coded = self.tokenizer.encode(text, add_special_tokens=False)
            ids, word = np.array(coded.ids, np.int32), np.array(coded.word_ids, np.float64)  # no word: NaN, unlike all
            last = np.append(np.flatnonzero(word[1:] != word[:-1]), len(word) - 1)
        return ids, np.diff(last, prepend=-1)

    def table(self, distinct: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, flat ids) so that chunk ``k`` has ``flat[start[k] : start[k] + length[k]]``."""
        chunks = distinct.to_pylist()
        if self.n_slots and self.n_slots + len(chunks) > self.limit:
            self.make_room()
        get = self.slots.get
        slot = np.array([get(c, -1) for c in chunks], np.int64)
        missing = np.flatnonzero(slot < 0)
        self.used = np.concatenate([self.used, np.zeros(len(missing), np.int64)])
        self.used[slot[slot >= 0]] += 1
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            ids, lengths = self.encode(new)
            first = self.n_slots
            slot[missing] = np.arange(first, first + len(new))
            ends = self.n_ids + np.cumsum(lengths)
            self.starts.append(ends - lengths)
            self.lengths.append(lengths)
            self.ids.append(ids)
            self.n_ids += len(ids)
            self.n_slots += len(new)
            self.slots.update((c, first + i) for i, c in enumerate(new) if len(c) <= CACHE_CHUNK_BYTES)
        return self.starts_array()[slot], self.lengths_array()[slot], self.flat()

    def _joined(self, parts: list[np.ndarray], kind) -> np.ndarray:
        if len(parts) != 1:
            parts[:] = [np.concatenate(parts) if parts else np.empty(0, kind)]
        return parts[0]

    def starts_array(self) -> np.ndarray:
        return self._joined(self.starts, np.int64)

    def lengths_array(self) -> np.ndarray:
        return self._joined(self.lengths, np.int64)

    def flat(self) -> np.ndarray:
        return self._joined(self.ids, np.int32)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, row offsets into them)."""
        raw, offsets = text_buffer(texts)
        starts = chunk_starts(raw, offsets)
        raw = folded(raw) if self.fold else raw
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        codes, distinct = chunk_codes(raw, starts)
        start, length, flat = self.table(distinct)
        lengths = length[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(start[codes] - ends[:-1], lengths)
        take += np.arange(ends[-1])
        return flat[take], ends[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def worker_encoder(path: str, fold: bool = False) -> ChunkEncoder:
    """One encoder per Python worker, so that later tasks profit from the chunks of earlier ones."""
    return ChunkEncoder(path, fold)


def bounded(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about ``limit`` text bytes (one row at least)."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(np.diff(text_buffer(texts)[1]))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit - size, "right")))
            stop = min(stop, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1] - base)
            at = stop
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
    held = None
    pa.default_memory_pool().release_unused()  # the worker lives on; its next task may be another operator's
