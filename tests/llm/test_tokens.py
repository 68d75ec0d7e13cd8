import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from loomframe.llm.token_counts import token_counts
from loomframe.llm.token_files import DacReader, dac_encode, read_token_files, token_at, token_file_table, write_token_files
from loomframe.llm.tokens import ChunkEncoder, load
from loomframe.plans.checkpoints import scratch_path

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def plain(path, texts):
    return [x.ids for x in load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path,fold", [(BYTES, False), (WORDS, True)])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aB'sé. ,!|<>\t\n  　\u0085́漢1\x1cΣ")) | st.sampled_from(["<|endoftext|>", "a<|startoftext|>b"]), max_size=6))
def test_chunks_give_the_ids_of_the_library(path, fold, texts):
    ids, ends = ChunkEncoder(path, fold=fold, limit=8).texts(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == plain(path, texts)


@given(ids=st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), data=st.data())
@settings(max_examples=60, deadline=None)
def test_codes_are_addressable(ids, data):
    reader = DacReader(dac_encode(np.array(ids, np.uint32)))
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert reader.n == len(ids) and reader.slice(start, stop).tolist() == ids[start:stop]
    for i in range(start, min(stop, start + 20)):
        assert reader.get(i) == ids[i]


def test_token_files_on_odd_rows(spark, odd_docs, no_docs):
    path = scratch_path(spark, "t")
    write_token_files(odd_docs, path, BYTES, 2)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_token_files(spark, path).collect())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, at = [], 0
    for (doc, _), ids in zip(rows, plain(BYTES, [t for _, t in rows])):
        ids = np.array([*ids, 2], "<u4")
        want.append((at, doc, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_at(spark, path, 9, 29_999) == plain(BYTES, ["word " * 30_000])[0][29_999]
    assert token_file_table(no_docs, BYTES, 2).collect() == []


def test_token_counts_on_odd_rows(odd_docs, no_docs):
    got = sorted(map(repr, ((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(odd_docs, WORDS).collect())))
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    counts = [len(x) for x in plain(WORDS, [t for _, t in rows])]
    assert got == sorted(repr((i, len(t.encode()), n, n > 2048)) for (i, t), n in zip(rows, counts))
    assert token_counts(no_docs, WORDS).collect() == []
    pieces = token_counts(odd_docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert pieces.count() == len(rows)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_letters_go_to_the_library_together(name):
    encoder = tokens.ChunkEncoder(public_tokenizers.path(name))
    plain = [f" wort{chr(97 + k % 26)}{chr(97 + k // 26)}ü" for k in range(300)] + [" İstanbul", " straße", " 漢字", " ǅ"]
    chunks = [c.encode() for c in [*plain, "  two", " a1", " 12", "x", " a-b", " ", " ét", "!"]]
    ids, lengths = encoder.encode(chunks)
    want = [encoder.tokenizer.encode(c.decode(), add_special_tokens=False).ids for c in chunks]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    own, n = encoder._joint(plain[:256])
    assert n.tolist() == [len(w) for w in want[:256]] and own.tolist() == [i for w in want[:256] for i in w]
