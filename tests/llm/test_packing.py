import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from loomframe.llm.packing import Bm25Shard, pack_documents, pack_shard
from loomframe.llm.tokens import load

WORDS = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, lengths, window):
    """pieces: (document, start, length, sequence, offset). Everything once, no gaps, no padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length))
    for doc, total in lengths.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == total
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 9), min_size=1, max_size=60), max_size=14))
def test_every_id_lies_in_one_piece(docs):
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    pieces = pack_shard(np.array([x for d in docs for x in d], np.int64), ends, 16)
    check(pieces, {i: len(d) for i, d in enumerate(docs)}, 16)


def test_scores_are_bm25():
    docs = [[1, 1, 2], [2, 3], [1, 4, 4, 4], [5], [6, 7], [8, 8]]
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = Bm25Shard(np.array(sum(docs, [])), ends).scores(2)
    mean = np.mean([len(d) for d in docs])
    for doc, score in zip(docs, got):
        want = 0.0
        for term in {1, 4}:
            df = sum(term in d for d in docs)
            tf = doc.count(term)
            want += np.log((6 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        assert score == pytest.approx(want)


def test_neighbours_share_a_window():
    """Two topics alternate; each window holds one topic only."""
    docs = [[i % 2 * 10 + t for t in (1, 2, 3, 4)] for i in range(8)] + [[30 + i] * 4 for i in range(12)]
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    of = {d: s for d, _, _, s, _ in pack_shard(np.array(sum(docs, [])), ends, 16)}
    assert len({of[i] for i in (0, 2, 4, 6)}) == 1 and len({of[i] for i in (1, 3, 5, 7)}) == 1


def test_odd_rows(odd_docs, no_docs):
    got = pack_documents(odd_docs.filter("not doc_id <=> 7"), WORDS, 1).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    ids = {i: [*load(WORDS).encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items() if i != 7}
    check([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], {i: len(x) for i, x in ids.items()}, 2048)
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert pack_documents(odd_docs, WORDS, 1).filter("doc_id = 7 and start = 0").count() == 3
    assert pack_documents(no_docs, WORDS, 1).collect() == []


def test_neighbours_meet_across_files_and_shards(spark, monkeypatch):
    """60 topics of 8 documents, dealt to 8 partitions one each; the shards hold a few topics."""
    monkeypatch.setattr("loomframe.llm.packing.SHARD_TOKENS", 2400, raising=False)
    monkeypatch.setattr("loomframe.llm.packing.SHARD_BYTES", 2400 * 4, raising=False)
    draw = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    topics = [draw.choice(vocabulary, 12, replace=False) for _ in range(60)]
    texts = [" ".join([*draw.choice(topics[i % 60], 20), *draw.choice(vocabulary, 10)]) for i in range(480)]
    docs = spark.createDataFrame([(i, t, i // 60) for i, t in enumerate(texts)], "doc_id long, text string, part int")
    got = pack_documents(docs.repartitionByRange(8, "part"), WORDS, 1, window=256).collect()
    ids = [[*load(WORDS).encode(t, add_special_tokens=False).ids, 1] for t in texts]
    check([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], {i: len(x) for i, x in enumerate(ids)}, 256)
    shards = defaultdict(set)
    for r in got:
        shards[r["doc_id"]].add(r["sequence_id"] >> 24)
    assert len(set.union(*shards.values())) > 5
    index = Bm25Shard(np.array(sum(ids, [])), np.concatenate([[0], np.cumsum([len(x) for x in ids])]))
    met = 0
    for i in range(480):
        score = index.scores(i)
        score[i] = 0
        met += bool(shards[i] & shards[int(score.argmax())])
    assert met > 0.5 * 480  # 0.58 of the true nearest neighbours


def test_dropped_documents_leave_the_other_scores_alone():
    rng = np.random.default_rng(3)
    ends = np.concatenate([[0], np.cumsum(rng.integers(5, 40, 60))])
    ids = rng.integers(0, 300, ends[-1])
    whole, shrunk = packing.Bm25Shard(ids, ends), packing.Bm25Shard(ids, ends)
    used = rng.random(60) < 0.6
    shrunk.drop(used)
    assert len(shrunk.posting_doc) < len(whole.posting_doc)
    for seed in range(60):
        assert np.array_equal(np.where(used, 0, whole.scores(seed)), shrunk.scores(seed))
