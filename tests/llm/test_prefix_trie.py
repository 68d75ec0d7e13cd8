import hashlib
import random
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry_module
from loomframe.llm.prefix_trie import conversation_paths, member_digests, prefix_trie
from loomframe.llm.queries import shared_openings

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int, key int"


def grouped(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    return {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in turns.items()}


def brute(paths):
    """Rows of all nodes from {conv: [(role, text), ...]}."""
    members = defaultdict(list)
    for conv, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    rows = []
    for node, convs in members.items():
        below, open_ = [], [node]
        while open_:
            x = open_.pop()
            below.append(x)
            open_ += children[x]
        ends = sorted(c for c in convs if len(paths[c]) == len(node))
        rows.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), sum(not children[x] for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def random_rows(n, seed, texts="ab", most=7):
    draw = random.Random(seed)
    return [(c, k, draw.choice(["user", "assistant"]), draw.choice(texts) * draw.choice([1, 1, 3]), "x", 1, 2) for c in range(n) for k in range(draw.randint(0, most))]


def trie(spark, rows, block):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie(conversation_paths(frame), block).collect()), key=str)


@pytest.mark.parametrize(("n", "block", "texts"), [(60, 4, "ab"), (150, 5, "a"), (150, 8192, "abc"), (90, 7, "ä漢")])
def test_against_brute_force(spark, n, block, texts):
    rows = random_rows(n, n, texts)
    assert trie(spark, rows, block) == brute(grouped(rows))


def test_odd_rows(spark):
    long = [(50, k, "user", "t", "", 0, 0) for k in range(300)] + [(51, k, "user", "t", "", 0, 0) for k in range(299)]
    same = [(c, k, "user", f"{k}", "", 0, 0) for c in range(100, 400) for k in range(2)]
    rows = [
        (1, None, "user", "first", "", 0, 0), (1, 0, None, None, "", 0, 0), (1, 0, None, None, "", 0, 0), (2, 1, "user", "first", "", 0, 0),
        (None, 1, "user", "no conversation", "", 0, 0), (-3, 5, "", "", "", 0, 0), (-3, 5, "system", "x" * 100_000, "", 0, 0), *long, *same,
    ]
    assert trie(spark, rows, 4) == brute(grouped(rows))


def test_empty_and_turnless(spark):
    assert trie(spark, [], 4) == []
    none = spark.createDataFrame([(5, bytearray()), (3, bytearray())], "conv long, path binary")
    ends = hashlib.sha256(b"3,5").hexdigest()
    assert [tuple(r) for r in prefix_trie(none).collect()] == [(3, 0, None, 2, 0, 1, 0, ends)]


def test_long_member_lists(spark):
    ids = spark.range(40_000).selectExpr("cast(if(id < 39000, 'hot', 'cold') as binary) as key", "id * 7 as conv")
    want = {b"hot": ",".join(str(7 * i) for i in range(39000)), b"cold": ",".join(str(7 * i) for i in range(39000, 40000))}
    got = {bytes(r["key"]): r["ends"] for r in member_digests(ids).collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_query_input(spark, tables):
    rows = [tuple(r) for r in tables.conversations.select("conv_id", "turn", "role", "text").collect()]
    turns = grouped(rows)
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    got = prefix_trie(shared_openings(conversation_paths(tables.conversations)), 4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(built)
    assert "op11_truncation_peeling" in entry_module.oracle_sql()
