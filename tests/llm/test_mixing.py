import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loomframe.llm import mixing
from loomframe.llm.mixing import mix_documents, mix_plan, pivot


def targets(sizes, share=1.0, most=3.0):
    """Water-filling by brute force."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        for s in over or open_:
            out[s] = most * sizes[s] if over else weight[s] * level
            left -= out[s] if over else 0
        open_ -= over or open_
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1000), st.floats(0, 1)), max_size=30))
def test_pivot_keeps_words_and_leaves_one_fraction(rows):
    sizes, fractions = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = pivot(sizes, fractions, list(range(len(rows))), "s")
    assert ((out > 0) & (out < 1)).sum() <= 1 and ((out >= 0) & (out <= 1)).all()
    assert (out * sizes).sum() == pytest.approx((fractions * sizes).sum() if len(rows) else 0)


def test_pivot_keeps_the_expectation():
    sizes, fractions = np.array([5, 7, 9, 2]), np.array([0.3, 0.6, 0.5, 0.2])
    runs = np.array([pivot(sizes, fractions, list(range(4)), f"s{i}") for i in range(4000)])
    assert runs.mean(axis=0) == pytest.approx(fractions, abs=0.03)


def check(rows, texts):
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (t, _) in texts.items()}
    by_source = Counter()
    for k, (_, s) in texts.items():
        by_source[s] += sizes[k]
    want, taken = targets(by_source), Counter()
    for r in rows:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
    return by_source, want


def test_plan_matches_targets(spark, tables, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    docs = tables.documents
    rows = mix_plan(docs).collect()
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_source, want = check(rows, texts)
    taken = Counter()
    for r in rows:
        source = texts[r["doc_id"]][1]
        taken[source] += r["taken"]
        assert r["source_size"] == by_source[source] and r["target"] == pytest.approx(want[source])
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]][0]))
    for source, target in want.items():
        smallest = min(n for n in (len(t.split()) for t, s in texts.values() if s == source) if n)
        assert abs(taken[source] - target) <= max(0.01 * target, smallest, 3)
    again = mix_plan(docs.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    mix = Counter(r["doc_id"] for r in mix_documents(docs).collect())
    assert mix == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_odd_rows(odd_docs, no_docs):
    rows = mix_plan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert mix_plan(no_docs).collect() == []
    assert mix_documents(odd_docs).columns == odd_docs.columns
    assert mix_documents(no_docs).count() == 0
