import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from loomframe.llm import suffix_tree as model
from loomframe.llm.suffix_tree import DEPTH, OTHER, START, STOP, SuffixTree, edge_keys, language_scores, words_of


def split(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aBc \t\n é\u0085"), max_size=12), max_size=5))
def test_words(texts):
    codes, distinct, firsts = words_of(pa.array(texts, pa.string()))
    words = [distinct[i].as_py() for i in codes.tolist()]
    assert [words[a:b] for a, b in zip(firsts, firsts[1:])] == [split(t) for t in texts]


def plain_tree(lines, symbols):
    """Counts, tests and smoothing with dictionaries: lines of symbols with their ends; context (tuple) -> (chances, left)."""
    counts = {}
    for line in lines:
        line = [START, *line]
        for i in range(1, len(line)):
            for d in range(min(i, DEPTH) + 1):
                counts.setdefault(tuple(line[i - d : i]), Counter())[line[i]] += 1
    top = counts.get((), {})
    total, seen = sum(top.values()), max(len(top), 1)
    root = {x: (top.get(x, 0) + seen / symbols) / (total + seen) for x in range(symbols)}
    kept = {}

    def chance(context, symbol):
        for d in range(len(context), 0, -1):
            s = context[len(context) - d :]
            if s in kept:
                chances, left = kept[s]
                return chances[symbol] if symbol in chances else left * chance(s[1:], symbol)
        return root[symbol]

    for s in sorted(counts, key=len):
        c = counts[s]
        if not s:
            continue
        n, kinds = sum(c.values()), len(c)
        left = kinds / (n + kinds)
        chances = {x: k / (n + kinds) + left * chance(s[1:], x) for x, k in c.items()}
        saved = sum(k * math.log2(chances[x] / chance(s[1:], x)) for x, k in c.items())
        if saved > 0.5 * kinds * math.log2(max(n, 2)):
            kept[s] = (chances, left)
    return chance, kept


def spell(chance, line):
    line = [START, *line]
    return sum(math.log10(chance(tuple(line[max(0, i - DEPTH) : i]), line[i])) for i in range(1, len(line)))


def test_tree_against_dictionaries(tables):
    texts = [split(r["text"]) for r in tables.documents.limit(80).collect()]
    number = {w: i + 3 for i, (w, _) in enumerate(Counter(w for t in texts for w in t).most_common(200))}
    lines = [[*(number.get(w, OTHER) for w in t), STOP] for t in texts]
    chance, kept = plain_tree(lines, 203)
    line, lengths = np.array([x for t in lines for x in t], np.int64), np.array([len(t) for t in lines])
    tree = SuffixTree.fit(*np.unique(edge_keys(line, lengths), return_counts=True), 203)
    assert sum(map(len, tree.states)) == len(kept) > 10 and {len(s) for s in kept} == {1, 2}
    owner = np.repeat(np.arange(len(lines)), lengths)
    assert np.bincount(owner, tree.log10_symbols(line, lengths)) == pytest.approx([spell(chance, t) for t in lines])
    for context in kept:
        code = sum(x << 10 * i for i, x in enumerate(reversed(context)))
        whole = tree.probability(np.full(203, code), np.full(203, len(context)), np.arange(203))
        assert whole.sum() == pytest.approx(1)


def expected(rows, common):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for h, (_, t) in zip(held, rows) if not h for w in split(t))
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + bool(ends)
    key = lambda w: int(np.array(xxhash.xxh64_intdigest(w), np.uint64).view(np.int64))
    top = sorted(c, key=lambda w: (-c[w], key(w)))[:common]
    number = {w: i + 3 for i, w in enumerate(top)}
    once, twice = (list(c.values()).count(k) for k in (1, 2))
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once + twice else 0.5
    rest = [k for w, k in c.items() if w not in number]
    line = lambda t: [*(number.get(w, OTHER) for w in split(t)), STOP]
    chance, _ = plain_tree([line(t) for h, (_, t) in zip(held, rows) if not h], len(top) + 3)
    out = []
    for h, (i, t) in zip(held, rows):
        words = split(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        score = spell(chance, line(t))
        for w in words:
            if w not in number:
                score += math.log10((c[w] - discount) / sum(rest)) if c[w] else math.log10(discount * len(rest) / sum(rest)) if rest else 0
        out.append((i, h, len(words) + 1, sum(c[w] > 0 for w in words) + bool(ends), n, base, score))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert [r[k] for r in got] == pytest.approx([r[k] for r in want], rel=1e-9)


@pytest.mark.parametrize("block", [3, 512])
def test_scores(odd_docs, no_docs, spark, monkeypatch, block):
    monkeypatch.setattr(model, "BLOCK_ROWS", block)
    monkeypatch.setattr(model, "EDGE_SHARE", 0)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    same(language_scores(odd_docs, common=4).collect(), expected(rows, 4))
    assert language_scores(no_docs).collect() == []
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    only = spark.createDataFrame([(held, "new words")], "doc_id long, text string")
    same(language_scores(only).collect(), expected([(held, "new words")], 500))


def test_whole_table(tables, monkeypatch):
    monkeypatch.setattr(model, "EDGE_SHARE", 0)
    rows = [(r["doc_id"], r["text"]) for r in tables.documents.collect()]
    got = language_scores(tables.documents, common=50).collect()
    same(got, expected(rows, 50))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in got)


def test_longer_contexts(tables, monkeypatch):
    monkeypatch.setitem(globals(), "DEPTH", 4)
    rows = [(r["doc_id"], r["text"]) for r in tables.documents.limit(120).collect()]
    docs = tables.documents.sparkSession.createDataFrame(rows, "doc_id long, text string")
    same(language_scores(docs, common=30, depth=4).collect(), expected(rows, 30))


def test_rare_counts_of_a_large_corpus_are_kept(spark):
    """Over 2M tokens with the parameters of use: what is seen once or twice counts in full."""
    rare = [(1000 + i, f"a{i % 3} b{i % 5} c{i % 7} rare{i % 40} end") for i in range(200)]
    rows = [(i, "word " * 30_000) for i in range(85)] + rare
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    got = language_scores(docs).collect()
    assert got[0]["train_tokens"] > 2_000_000
    same(got, expected(rows, 500))


def test_the_tree_grows_with_the_corpus():
    sizes = [10**k for k in range(3, 13)]
    assert [model.depth_for(n) for n in sizes] == [2, 2, 2, 2, 3, 3, 4, 4, 5, 5]
    assert all(model.symbols_for(a) < model.symbols_for(b) for a, b in zip(sizes[4:], sizes[5:])) and model.symbols_for(0) == 500


def test_answers_hold_values_only(tables):
    """What a block is answered takes a few bytes a word and less than nine a position; with keys it was 16."""
    class Sent:
        value = model.Model(np.empty(0, np.uint64), np.full(3, 1 / 3), 3, np.ones(3, np.int64), 64, 1, 1, 1, 0.5, 1, 1)

    texts = [r["text"] for r in tables.documents.limit(200).collect()]
    table = pa.table({"text": pa.array(texts), "held_out": pa.array([False] * len(texts)), "block": pa.array([7] * len(texts), pa.int64())})
    asked = list(model._ask(64)(table.to_batches()))
    words = sum(len(model.unpack_sorted(k)) for b in asked for k in b.column("keys").to_pylist())
    assert words == len({w for t in texts for w in split(t)})
    answers = [r for b in model._answer()(iter(asked)) for r in b.to_pylist() if r["kind"] == 1]
    n = np.concatenate([model.unpack(r["totals"], np.int64) for r in answers])
    assert n.sum() == sum(len(split(t)) for t in texts)
    assert sum(len(r["keys"]) + len(r["totals"]) for r in answers) < 4 * words + 64 * len(answers)
    spots = list(model._ask_spots(Sent)(table.to_batches()))
    size = sum(len(model.unpack(k, np.uint32)) // 4 for b in spots for k in b.column("keys").to_pylist())
    found = [r for b in model._answer_spots(Sent)(iter(spots)) for r in b.to_pylist()]
    assert sum(len(model.unpack(r["totals"], np.float64)) for r in found) == size
    assert sum(len(r["keys"]) + len(r["totals"]) for r in found) < 9 * size + 64 * len(found)


@pytest.mark.parametrize("values", [np.empty(0, np.uint64), np.array([0, 3, 2**64 - 1], np.uint64), np.arange(1000, dtype=np.uint64) * 977])
def test_packing_is_reversible(values):
    assert (model.unpack(model.pack(values), np.uint64) == values).all() and (model.unpack_sorted(model.pack_sorted(values)) == values).all()


def rare_lines(rows, seed=5):
    """Texts in which most words are none of the symbols, and the same few follow each other."""
    rng = np.random.default_rng(seed)
    words = [*(f"rare{i}" for i in range(3000)), *["the", "of", "and"] * 150]
    return [" ".join(words[i] for i in rng.integers(0, len(words), rng.integers(0, 60))) for _ in range(rows)]


def test_no_bucket_has_the_contexts_of_unknown_words():
    """Nine in ten symbols are that of the other words; their context once sent its positions to one bucket."""
    number = {w: i + 3 for i, w in enumerate(["the", "of", "and"])}
    lines = [[*(number.get(w, OTHER) for w in t.split()), STOP] for t in rare_lines(4000)]
    rng = np.random.default_rng(8)
    lines = [[x if x or rng.random() < 0.9 else int(rng.integers(6, 60)) for x in t] for t in lines]
    symbols, lengths = np.array([x for t in lines for x in t]), np.array([len(t) for t in lines])
    spots = model.spots_of(symbols, lengths, 4)
    dealt = model.Model(np.empty(0, np.uint64), np.full(60, 1 / 60), 4, np.ones(60, np.int64), 64, 1, 1, 1, 0.5, 1, 1)
    model.deal_out(dealt, spots[:, : spots.shape[1] // 4])
    assert len(dealt.hot) == 4 and (symbols == OTHER).mean() > 0.7
    first, bucket, where = dealt.arranged(spots)
    assert np.bincount(bucket).max() < 3 * len(bucket) / 64
    assert (np.diff(bucket) >= 0).all() and (spots[:, first][:, where] == spots).all()
    share, longest, length = dealt.routed(spots)
    for k in range(1, 5):  # a context that is not hot lies in one bucket
        cold = np.flatnonzero((length < k) & (spots[k] != model._NONE))
        contexts = {}
        for context, b in zip(zip(*spots[1 : k + 1, cold].tolist()), dealt.bucket(share[cold]).tolist()):
            assert contexts.setdefault(context, b) == b
    for k, b in set(zip(longest.tolist(), dealt.bucket(share).tolist())):
        while k >= 0:
            assert b in dealt.needed[k]
            k = int(dealt.suffix[k])


@pytest.mark.parametrize("depth", [2, 4])
def test_scores_after_hot_contexts(spark, monkeypatch, depth):
    monkeypatch.setitem(globals(), "DEPTH", depth)
    monkeypatch.setattr(model, "BLOCK_ROWS", 64)
    made = []
    monkeypatch.setattr(model, "deal_out", lambda m, spots, deal=model.deal_out: (deal(m, spots), made.append(m)))
    rows = list(enumerate(rare_lines(500)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    same(language_scores(docs, common=8, depth=depth).collect(), expected(rows, 8))
    assert len(made) == 1 and len(made[0].hot) == depth and made[0].deal.max() > 32


def test_a_block_asks_in_pieces(monkeypatch):
    monkeypatch.setattr(model, "_PIECE", 4)
    assert model.pieces(np.array([3, 9, 1, 2, 1, 1])) == [(0, 2), (2, 5), (5, 6)] and model.pieces(np.array([1])) == [(0, 1)]

    class Sent:
        value = model.Model(np.empty(0, np.uint64), np.full(3, 1 / 3), 3, np.ones(3, np.int64), 64, 1, 1, 1, 0.5, 1, 1)

    texts = rare_lines(90)
    table = pa.table({"id": range(90), "text": pa.array(texts), "held_out": [i % 9 == 0 for i in range(90)], "block": pa.array([7] * 50 + [8] * 40, pa.int64())})
    alone = lambda batches: [b.slice(i, 1) for b in batches for i in range(b.num_rows)]
    totals = [b for b in alone(model._answer()(model._ask(64)(table.to_batches()))) if b.column("kind")[0].as_py() == 1]
    found = []
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(model, "_PIECE", size)
        asked = alone(model._ask_spots(Sent, spelled=True)(table.to_batches()))
        asked.sort(key=lambda b: [b.column(k)[0].as_py() for k in ("bucket", "kind")])
        parts = alone(model._answer_spots(Sent)(iter(asked)))
        parts += [b.append_column("ids", pa.nulls(b.num_rows, parts[0].schema.field("ids").type)) for b in totals]
        parts.sort(key=lambda b: [b.column(k)[0].as_py() for k in ("block", "kind", "part")])
        found.append([tuple(r.values()) for b in model._score(Sent)(iter(parts)) for r in b.to_pylist()])
    assert [r[0] for r in found[0]] == [*range(90)] and [r[1] for r in found[0]] == [i % 9 == 0 for i in range(90)]
    for other in found[1:]:
        assert [r[:5] for r in other] == [r[:5] for r in found[0]]
        assert [r[5] for r in other] == [r[5] for r in found[0]] and [r[6] for r in other] == pytest.approx([r[6] for r in found[0]])


@pytest.mark.parametrize("values", [np.zeros(1000), np.repeat([0.25, np.pi, 0.25], [3, 500, 1]), np.array([7], np.uint32)])
def test_repeats_travel_once(values):
    packed = model.pack(values)
    assert model.packed_size(packed) == len(values) and (model.unpack(packed, values.dtype.type) == values).all()
    assert len(packed) < 100
