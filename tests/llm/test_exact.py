import hashlib
import random
import re
from collections import defaultdict

from loomframe.llm.exact import drop_exact, exact_groups, identities


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in rows:
        groups[norm(r["text"])].append(r)
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for r in members:
            out.append((r["doc_id"], best["doc_id"], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_odd_rows(odd_docs, no_docs):
    got = exact_groups(odd_docs)
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got.collect()) == brute(odd_docs.collect())
    kept = drop_exact(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == got.filter("kept").count() == got.select("text_sha256").distinct().count()
    assert exact_groups(no_docs).collect() == [] and drop_exact(no_docs).count() == 0


def test_many_blocks(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab ") for _ in range(draw.choice([3, 40, 90, 200]))) for _ in range(40)]
    texts += [t.replace(" ", "\t ") for t in texts] + [t[:-1] + "c" for t in texts] + ["ab" * 50] * 7 + ["ab" * 51, "ab" * 49]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).cache()
    names = defaultdict(set)
    for r in identities(docs, block=4).collect():
        names[(r["blocks"], r["name"])].add(r["text_sha256"])
    assert all(len(v) == 1 for v in names.values())
    assert len(names) == len({re.sub(r"\s", "", t) for t in texts})
    got = exact_groups(docs)
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got.collect()) == brute(docs.collect())
