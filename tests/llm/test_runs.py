import hashlib
import random
import zlib

import numpy as np
import pytest

from loomframe.llm import runs
from loomframe.llm.queries import op13
from loomframe.llm.runs import COVER, V, Extensions, find_runs, periodic_runs


def plain_runs(words):
    """All runs by extending every period from every place; a stretch counts with its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = (start, i + q - start)
            if stretch[1] >= max(24, 3 * q):
                best.setdefault(stretch, q)
    return sorted((s, n, q) for (s, n), q in best.items())


def plain_row(text):
    words = (text or "").encode().split()
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-(r[1] * 720720 // r[2]), r[0], r[2])) if found else None
    if found:  # exact comparison of the ratios
        best = found[0]
        for r in found[1:]:
            if r[1] * best[2] > best[1] * r[2]:
                best = r
    gone = {j for s, n, q in found for j in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(kept))


def random_words(draw):
    """Texts made of repeats of small blocks, with noise, of few and of many different words."""
    words, alphabet = [], draw.choice(["ab", "abc", "abcdefghijklmnopqrstuvwxyz"])
    for _ in range(draw.randint(0, 6)):
        block = [draw.choice(alphabet) for _ in range(draw.choice([1, 1, 2, 3, 7, 20, 40]))]
        part = block * draw.choice([1, 1, 2, 3, 5, 12]) + block[: draw.randint(0, len(block))]
        if draw.random() < 0.3:
            part = part * 3
        if draw.random() < 0.3:
            part[draw.randrange(len(part))] = "!"
        words += part
    return words


def test_cover():
    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))


def test_extensions_against_comparison():
    draw = random.Random(5)
    for _ in range(40):
        docs = [[ord(w) for w in random_words(draw)] for _ in range(4)]
        docs.append(docs[0])  # equal documents are apart
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        words = np.array([w for d in docs for w in d], np.int64)
        index, pairs = Extensions(words, bounds), []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            pairs += [tuple(sorted(draw.sample(range(low, high), 2))) for _ in range(60) if high - low > 1]
        if not pairs:
            continue
        a, b = np.array(pairs, np.int64).T
        ends = bounds[1:][np.searchsorted(bounds, b, "right") - 1]
        want = [next((k for k in range(e - y) if words[x + k] != words[y + k]), e - y) for x, y, e in zip(a, b, ends)]
        assert index.lce(a, b).tolist() == want


@pytest.mark.parametrize("grid", [64, runs.GRID])
def test_runs_against_brute_force(grid, monkeypatch):
    monkeypatch.setattr(runs, "GRID", grid)
    draw = random.Random(11)
    for _ in range(60):
        docs = [random_words(draw) for _ in range(5)]
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        start, length, period = find_runs(np.array([ord(w) for d in docs for w in d], np.int64), bounds)
        doc = np.searchsorted(bounds, start, "right") - 1
        got = [sorted(zip((start - bounds[:-1][doc])[doc == d].tolist(), length[doc == d].tolist(), period[doc == d].tolist())) for d in range(5)]
        assert got == [plain_runs(d) for d in docs]


def test_fibonacci_and_one_word():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    for words in (list(b), ["x"] * 500, list("ab" * 200), (list("aab" * 30) + ["c"]) * 9):
        start, length, period = find_runs(np.array([ord(w) for w in words], np.int64), np.array([0, len(words)]))
        assert sorted(zip(start.tolist(), length.tolist(), period.tolist())) == plain_runs(words)


def rows_of(frame):
    return sorted(((r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) for r in frame.collect()), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    long = {"word " * 30_000: (1, 0, 30_000, 1, 30_000_000, hashlib.sha256(b"0,30000,1\n").hexdigest(), hashlib.sha256(b"word").hexdigest())}
    want = sorted(((r["doc_id"], *(long[r["text"]] if r["text"] in long else plain_row(r["text"]))) for r in odd_docs.collect()), key=str)
    got = periodic_runs(odd_docs)
    assert rows_of(got) == want and got.columns[0] == "doc_id"
    assert {r["collapsed"] for r in got.filter("doc_id = 9").collect()} == {"word"}
    assert periodic_runs(no_docs).collect() == []


def test_very_long_text(spark):
    draw = random.Random(2)
    base = [f"w{draw.randint(0, 50_000)}" for _ in range(120_000)]
    words = base + base + base[:90_000] + ["k"] * 100 + base * 2  # no run but the row of k: three full periods are missing
    row = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 330_000, 100, 1)
    words = base * 3 + base[:7]
    row = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 360_007, 120_000)


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        return b" ".join(words).decode()
    return text


def test_query_on_whole_table(spark, tables):
    rows = [tuple(r) for r in tables.documents.select("doc_id", "text").collect()]
    got = rows_of(op13(tables))
    assert got == sorted(((i, *plain_row(planted(i, t))) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > len(got) / 20


def test_query_on_odd_rows(spark, odd_docs):
    class Odd:
        documents = odd_docs

    got = {r[0]: r for r in rows_of(op13(Odd)) if r[0] not in (7, None)}
    for r in odd_docs.filter("doc_id <> 7 AND doc_id <> 9").collect():
        assert got[r["doc_id"]] == (r["doc_id"], *plain_row(planted(r["doc_id"], r["text"])))
