"""Document fingerprints from content-defined chunks.

A gear hash runs over the bytes: ``h = (h << 1) + GEAR[byte]``, of which the last 16 bytes matter here. A chunk
ends where masked bits of it are zero. Chunk sizes are normalised: the mask is strict up to ``NORMAL`` bytes and
loose after, so sizes gather around that value; below ``LEAST`` bytes nothing is cut, at ``MOST`` always. A
boundary depends on the text around it only, so an insertion shifts chunks without changing them.

A fingerprint is the set of the chunks' digests, each with its length. ``containment`` of one in another is the
share of its bytes (distinct chunks by length) whose digests the other has too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomframe.llm.ranges import id_bounds, part_of, parts_for
from loomframe.llm.tokens import bounded

LEAST, NORMAL, MOST = 16, 48, 192
STRICT, LOOSE = 0x7F << 24, 0x0F << 24  # expected gaps of 128 and 16 bytes


def _gear_table() -> np.ndarray:
    """A pseudo-random 32-bit number per byte value, by a rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([x]), digest_size=4, person=b"gear").digest(), "little") for x in range(256)], np.uint32)


GEAR = _gear_table()


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """Gear hash at each byte over it and the 15 bytes before, by doubling the window four times."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h = wider
    return h


def chunk_ends(raw: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """For each text (consecutive ``bounds``) the ends of its chunks in ``raw``."""
    h = gear_hashes(raw)
    loose = np.flatnonzero((h & np.uint32(LOOSE)) == 0)
    strict = loose[(h[loose] & np.uint32(STRICT)) == 0].tolist()
    loose = loose.tolist()
    strict.append(1 << 62)
    loose.append(1 << 62)
    out = []
    for start, stop in zip(bounds, bounds[1:]):
        ends, i, j = [], bisect_left(strict, start), bisect_left(loose, start)
        while stop - start > LEAST:
            i = bisect_left(strict, start + LEAST - 1, i)
            end = strict[i] + 1
            if end > start + NORMAL:
                j = bisect_left(loose, start + NORMAL, j)
                end = min(loose[j] + 1, start + MOST)
            if end >= stop:
                break
            ends.append(end)
            start = end
        if start < stop:
            ends.append(stop)
        out.append(ends)
    return out


def prints(texts: list[bytes]) -> list[dict[int, int]]:
    """Fingerprint of each text: digest (40 bits) -> length of the chunk."""
    from xxhash import xxh64_intdigest

    bounds = [0, *np.cumsum([len(t) for t in texts]).tolist()]
    data = b"".join(texts)
    out = []
    for start, ends in zip(bounds, chunk_ends(np.frombuffer(data, np.uint8), bounds)):
        found = {}
        for end in ends:
            found[xxh64_intdigest(data[start:end]) >> 24] = end - start
            start = end
        out.append(found)
    return out


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """Share of ``own``'s bytes found in ``other``; two empty fingerprints are alike, an empty one and another are not."""
    if not own:
        return 0.0 if other else 1.0
    return sum(own[d] for d in own.keys() & other.keys()) / sum(own.values())


def packed(print_: dict[int, int]) -> str:
    """Fingerprint as text: 12 hex digits per distinct chunk (digest, length), in order of the digests."""
    return "".join([f"{d:010x}{n:02x}" for d, n in sorted(print_.items())])


def unpacked(text: str) -> dict[int, int]:
    return {int(text[i : i + 10], 16): int(text[i + 10 : i + 12], 16) for i in range(0, len(text), 12)}


def _fingerprint_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in bounded(batches):
        texts = [t or "" for t in table["text"].to_pylist()]
        found = prints([t.encode() for t in texts])
        yield pa.RecordBatch.from_arrays(
            [table["id"].combine_chunks(), pa.array([len(t) for t in texts], pa.int64()), pa.array([packed(p) for p in found])], ["id", "n_chars", "fingerprint"]
        )


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row; a null text is an empty one, whose fingerprint is empty.

    Repeated rows and ids are passed on, an empty table gives no rows, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.select("id").schema.add("n_chars", "long").add("fingerprint", "string")
    return rows.mapInArrow(_fingerprint_task, schema).withColumnRenamed("id", id_col)


def _successor_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (part, guest, falling id): each own row is compared with the row after it."""
    held = None  # (id, text, fingerprint, part) of the last own row
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(ready: list) -> pa.RecordBatch:
        edits = [own[1][: len(own[1]) - len(own[1]) // 2] + after[1][: len(own[1]) // 2] for own, after in ready]
        coded = [e.encode() for e in edits]
        changed = prints(coded)
        columns = [
            [own[0] for own, _ in ready], [len(own[1]) for own, _ in ready], [hashlib.sha256(c).hexdigest() for c in coded],
            [packed(own[2]) for own, _ in ready], [packed(c) for c in changed],
            [containment(own[2], c) for (own, _), c in zip(ready, changed)], [containment(own[2], after[2]) for own, after in ready],
        ]
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for table in bounded(batches, limit=2 << 20):
        id_type = table["id"].type
        texts = [t or "" for t in table["text"].to_pylist()]
        rows = zip(table["id"].to_pylist(), texts, prints([t.encode() for t in texts]), table["part"].to_pylist(), table["guest"].to_pylist())
        ready = []
        for id_, text, print_, part, guest in rows:
            row = (id_, text, print_, part)
            if held is not None and held[3] == part:
                ready.append((held, row))
            held = None if guest else row
        if ready:
            yield finish(ready)


def successor_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with the next one in falling order of the id, and with an edit of itself.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): the edited text has the
    last ``floor(n_chars / 2)`` code points replaced by the first as many (or all) of the next row's text. The
    row after the last is the first. Null ids come last, rows with the same id in order of their texts; null
    texts are empty; a single row is its own next; an empty table gives no rows. Other columns are not read.

    One shuffle moves the texts into id ranges. The first row of each range is sent along to the range before it,
    as a guest, so that no range has to look into another one.
    """
    bounds = id_bounds(docs, id_col, parts_for(docs))
    rows = docs.select(part_of(F.col(id_col), bounds).alias("part"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heads = rows.groupBy("part").agg(F.max("id").alias("id")).orderBy(F.desc("part")).collect()  # a row per part
    order = [r["part"] for r in heads]
    host = {part: before for before, part in zip([order[-1], *order[:-1]] if order else [], order)}
    if heads:
        id_type = dict(rows.dtypes)["id"]
        to = F.create_map(*[F.lit(x) for r in heads for x in (r["part"], host[r["part"]])])
        first = F.create_map(*[x for r in heads for x in (F.lit(r["part"]), F.lit(r["id"]).cast(id_type))])
        is_head = F.col("id").eqNullSafe(F.element_at(first, F.col("part")))
        rows = rows.withColumn("guest_of", F.when(is_head, F.element_at(to, F.col("part"))))
    else:
        rows = rows.withColumn("guest_of", F.lit(None).cast("int"))
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("part"), F.lit(True).alias("guest")))
    rows = rows.select("id", "text", F.explode(F.filter(places, lambda p: p["part"].isNotNull())).alias("at")).select("at.part", "at.guest", "id", "text")
    placed = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "text")
    schema = rows.select("id").schema
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        schema = schema.add(name, kind)
    return placed.mapInArrow(_successor_task, schema).withColumnRenamed("id", id_col)
