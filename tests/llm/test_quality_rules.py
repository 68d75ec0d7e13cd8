import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomframe.llm import quality_rules as qr
from loomframe.llm.quality_rules import binomial_tail, certified_cutoffs, quality_verdicts, text_counts

NAMES = ["n_words", "n_distinct_words", "word_chars", "n_symbols", "n_marks", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    count = lambda chars: sum(c in chars for c in text)
    return (len(words), len(set(words)), sum(map(len, words)), count("#*$%&|<>"), count("!?"), sum("A" <= c <= "Z" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def counted(frame):
    return sorted(((r["id"], *(r[n] for n in NAMES)) for r in text_counts(frame).collect()), key=str)


def test_counts_of_odd_rows(spark, odd_docs, no_docs):
    assert counted(odd_docs) == sorted(((r["doc_id"], *plain(r["text"])) for r in odd_docs.collect()), key=str)
    assert counted(no_docs) == []


def test_counts_of_random_texts(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a", "b", "a b a b a b a ", " ", "\n", "\t", "\x0b", "\x1c", "x# ", "É!", " "]) for _ in range(draw.choice([0, 1, 8, 40, 200]))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert counted(frame) == sorted(((i, *plain(t)) for i, t in enumerate(texts)), key=str)


def test_given_texts(spark, tables):
    got = {r[0]: tuple(r[1:]) for r in counted(tables.documents)}
    assert got == {r["doc_id"]: plain(r["text"]) for r in tables.documents.collect()}


def test_exact_binomial_tail(spark):
    cases = [(n, k, p) for n in (0, 1, 20, 21, 59, 400, 5000) for k in (0, 1, 3, 20, 21, 60) for p in (0.02, 0.005, 0.2) if k <= n]
    got = spark.createDataFrame(cases, "n long, k long, p double").select("n", "k", "p", binomial_tail("n", "k", "p").alias("tail")).collect()
    for n, k, p, tail in got:
        want = 1.0 if k >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(want, rel=1e-9, abs=1e-300)
    wide = spark.createDataFrame([(10**9, 10**9 // 50 - 5000, 0.02)], "n long, k long, p double").select(binomial_tail("n", "k", "p")).first()[0]
    z = -5000 / math.sqrt(1e9 * 0.02 * 0.98)  # the normal approximation is close here
    assert wide == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=0.02)


def made(spark, n, bad_share=0.2, noise=0.0, seed=1):
    """Documents of two languages, bad ones with symbols; ``noise`` of the good ones look bad."""
    draw, rows, labels = random.Random(seed), [], []
    for i in range(n):
        bad = draw.random() < bad_share
        words = [draw.choice("amber birch cedar dogwood elm fir gorse hazel iris".split()) + str(draw.randint(0, 99)) for _ in range(40)]
        if bad or draw.random() < noise:
            words = [w + "##" for w in words]
        rows.append((i, " ".join(words), None if i % 3 == 0 else "en"))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_rules_are_certified_where_labels_allow(spark):
    docs, labels, good = made(spark, 4000)
    rows = quality_verdicts(docs, labels).collect()
    assert len(rows) == 4000 and not any(r["base_failed"] for r in rows)
    assert all(r["kept"] == bool(good[r["id"]]) for r in rows)  # both strata, the null one included
    assert {x for r in rows for x in r["rejected_by"]} >= {"symbols"}
    few = quality_verdicts(docs, labels.filter("doc_id < 100"))  # too few to certify anything
    assert few.filter("not kept").count() == 0
    assert quality_verdicts(docs, labels.limit(0)).filter("not kept").count() == 0


def test_noisy_rules_are_refused(spark):
    docs, labels, _ = made(spark, 4000, noise=0.04)
    counts = text_counts(docs)
    strict = certified_cutoffs(counts, labels).filter("certified").collect()  # by symbols four in a hundred good ones would go
    assert "symbols" not in {r["rule"] for r in strict} and all(r["rejected"] < 0.02 * r["holdout"] for r in strict)
    docs, labels, _ = made(spark, 4000, noise=0.01)
    loose = certified_cutoffs(text_counts(docs), labels, alpha=0.9).filter("certified and rule = 'symbols'").collect()
    assert {r["stratum"] for r in loose} == {None, "en"} and all(r["rejected"] > 0 for r in loose)


def test_false_rejection_holds_over_many_draws():
    """Of rules whose true rate is just above alpha, the exact test passes at most delta."""
    draw = random.Random(0)
    n, alpha, level = 600, 0.02, 0.05
    tail = [0.0]
    for i in range(40):
        tail.append(tail[-1] + math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i))
    passed = sum(tail[min(sum(draw.random() < alpha * 1.001 for _ in range(n)), 39) + 1] <= level for _ in range(2000))
    assert passed / 2000 <= level * 1.3


def test_odd_rows_and_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (7, None), (9, 0), (9, 0)], "doc_id long, quality int")
    rows = quality_verdicts(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality_verdicts(no_docs, labels).count() == 0


def test_plan_has_no_python(spark, tables):
    plan = quality_verdicts(tables.documents, tables.labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert set(qr.RULES) >= {"symbols", "repeats", "dup_lines"}
