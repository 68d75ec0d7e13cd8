import hashlib
import random

import numpy as np
import pytest

from loomframe.llm import chunk_prints as cp
from loomframe.llm.chunk_prints import chunk_ends, containment, fingerprint_documents, packed, prints, successor_likeness, unpacked


def plain_ends(data):
    """One byte at a time."""
    ends, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = sum(int(cp.GEAR[b]) << k for k, b in enumerate(reversed(data[max(0, i - 15) : i + 1]))) & 0xFFFFFFFF
        size = i + 1 - start
        mask = cp.STRICT if size <= cp.NORMAL else cp.LOOSE
        if size >= cp.LEAST and h & mask == 0 or size == cp.MOST:
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] if start < len(data) else ends


def test_ends_against_byte_by_byte():
    draw = random.Random(0)
    texts = [bytes(draw.choice(b"abcdefgh \n") for _ in range(n)) for n in (0, 1, 15, 16, 17, 47, 48, 49, 500, 3000)] + [b"a" * 1000]
    bounds = [0, *np.cumsum([len(t) for t in texts]).tolist()]
    got = chunk_ends(np.frombuffer(b"".join(texts), np.uint8), bounds)
    for text, first, ends in zip(texts, bounds, got):
        assert [e - first for e in ends] == plain_ends(text)
    sizes = np.diff([0, *plain_ends(texts[9])])
    assert 30 < sizes.mean() < 90 and sizes.max() <= cp.MOST


def test_shift_resistance_and_likeness():
    draw = random.Random(1)
    text = " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(800)).encode()
    other = " ".join("".join(draw.choice("klmnopqrst") for _ in range(6)) for _ in range(800)).encode()
    a, b, c, d = prints([text, b"some inserted words " + text, other, text[: len(text) // 2] + other[: len(text) // 2]])
    assert containment(a, b) > 0.95 and containment(a, c) == 0 and containment(a, a) == 1 and 0.45 < containment(a, d) < 0.55
    assert unpacked(packed(a)) == a and containment({}, {}) == 1 and containment({}, a) == 0 and containment(a, {}) == 0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, changed, following = prints([text.encode(), edited.encode(), after.encode()])
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(own), packed(changed), containment(own, changed), containment(own, following)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_successors(spark, odd_docs, no_docs, parts):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
        assert sorted(repr(tuple(r)) for r in successor_likeness(odd_docs).collect()) == expected(rows)
        one = odd_docs.filter("doc_id = 5")
        assert [repr(tuple(r)) for r in successor_likeness(one).collect()] == expected([(5, rows[[r[0] for r in rows].index(5)][1])])
        assert successor_likeness(no_docs).collect() == [] and fingerprint_documents(no_docs).collect() == []
        nulls = odd_docs.filter("doc_id is null")
        assert successor_likeness(nulls.union(nulls)).count() == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert fingerprint_documents(odd_docs).count() == len(rows)


def test_real_rows(tables):
    docs = tables.documents.select("doc_id", "text")
    assert sorted(repr(tuple(r)) for r in successor_likeness(docs).collect()) == expected([tuple(r) for r in docs.collect()])
