import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from loomframe.llm import simhash
from loomframe.llm.components import components
from loomframe.llm.simhash import drop_near, fingerprint, near_groups, near_links, shard_links


def plain(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    size = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots(values, links):
    """Smallest member reachable, by brute force."""
    of = {v: v for v in values}

    def find(v):
        while of[v] != v:
            v = of[v]
        return v

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        of[b] = a
    return {v: find(v) for v in values}


def all_links(values, limit=3):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= limit]


def cloud(draw, n):
    """Random values, chains and dense balls."""
    out = set()
    for _ in range(n // 40):
        value = draw.getrandbits(64)
        out.add(value)
        for _ in range(draw.choice([1, 5, 60])):
            for _ in range(draw.choice([1, 2, 3, 5])):
                value ^= 1 << draw.randrange(draw.choice([12, 64]))
            out.add(value)
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBc \t\né漢\u0085"), max_size=40))
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain(text) and fingerprint(text.encode(), 5) == plain(text, 5)


@pytest.mark.parametrize("seed", range(6))
def test_shards_lose_no_link(seed, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 512)
    draw = random.Random(seed)
    values = cloud(draw, 400)
    rank = lambda v: int("".join(np.array(list(map(int, f"{v:064b}"))).cumsum().__mod__(2).astype(str)), 2)
    values.sort(key=rank)
    cut = len(values) // 3
    a, b = (np.array(v, np.uint64) for v in (values[:cut], values[cut:]))
    found = np.concatenate([shard_links(a, None, 3), shard_links(b, None, 3), shard_links(a, b, 3)]).tolist()
    assert all((x ^ y).bit_count() <= 3 for x, y in found) and len(found) < 3 * len(values)
    assert roots(values, found) == roots(values, all_links(values))


def test_links_on_spark(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 64)
    values = cloud(random.Random(9), 1200) + [0, 2**64 - 1, 2**64 - 2]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed + signed[:50]], "fp long")
    found = [tuple(np.array(tuple(r), np.int64).view(np.uint64).tolist()) for r in near_links(frame).collect()]
    assert roots(values, found) == roots(values, all_links(values))


def test_components(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 400)] + [(draw.randrange(500, 900), draw.randrange(500, 900)) for _ in range(250)] + [(3, 3), (7, 6)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = {v for link in links for v in link}
    want = roots(sorted(nodes), links)
    assert {v: got.get(v, v) for v in nodes} == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], plain(r["text"])) for r in odd_docs.collect()]
    values = sorted({v for _, v in rows})
    root = roots(values, all_links(values))
    least = {}
    for i, v in rows:
        if i is not None:
            least[root[v]] = min(i, least.get(root[v], i))
    got = near_groups(odd_docs).collect()
    assert sorted(map(repr, got)) == sorted(f"Row(doc_id={i!r}, fingerprint='{v:016x}', component_id={least.get(root[v])!r})" for i, v in rows)
    assert near_groups(no_docs).collect() == [] and drop_near(no_docs).count() == 0
    kept = drop_near(odd_docs, shingle=3)
    assert kept.columns == odd_docs.columns and kept.count() == len({root[v] for _, v in rows})
