import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomframe.llm import toxicity
from loomframe.llm.suffix_tree import words_of
from loomframe.llm.toxicity import _hits, drop_toxic, features_of, fit_linear, label_model, toxicity_scores
from loomframe.registry import Tables


def test_features_and_hits():
    assert features_of(b'"idiotic!"') == ["idiotic", "idio*", "idiot*", "idioti*", "idiotic*"] and features_of(b"!!") == []
    known = {"idio*": 0, "fool": 1, "b": 2}
    row, feature = _hits(known, *words_of(pa.array(["You IDIOT, idiot fool", None, "b a b", "", "fool."])))
    assert list(zip(row.tolist(), feature.tolist())) == [(0, 0), (0, 1), (2, 2), (4, 1)]


def test_label_model_finds_rates(spark):
    """Two classes, six voters, one of them a copy of another: the posterior separates the classes without labels."""
    draw, rows, truth = random.Random(4), [], []
    rates = [(0.7, 0.01), (0.5, 0.02), (0.6, 0.005), (0.4, 0.01), (0.3, 0.03)]
    for _ in range(3000):
        y = draw.random() < 0.2
        fired = [i for i, (a, b) in enumerate(rates) if draw.random() < (a if y else b)]
        rows.append((fired + [5] * (0 in fired), 1))
        truth.append(y)
    patterns = spark.createDataFrame(rows, "votes array<int>, n long").groupBy("votes").sum("n").withColumnRenamed("sum(n)", "n")
    gains, odds, none = label_model(patterns, np.full(6, 0.3), np.full(6, 0.03), 0.1)
    total = np.array([odds + sum(gains[v]) + (none if not v else 0) for v, _ in rows])
    right = ((total > 0) == np.array(truth)).mean()
    assert right > 0.92 and gains[0] == pytest.approx(gains[5]) and gains[0] < gains[2]


def em_by_hand(patterns, hit, miss, prior, rounds):
    """The label model over {votes: documents}, one pattern at a time."""
    k, total = len(hit), sum(patterns.values())
    hit, miss = [*hit, 0.1], [*miss, 0.9]
    guess_hit, guess_miss, weight = list(hit), list(miss), [1.0] * (k + 1)
    for step in range(rounds):
        gain, odds = [w * math.log(a / b) for w, a, b in zip(weight, hit, miss)], math.log(prior / (1 - prior))
        posterior = {v: 1 / (1 + math.exp(-(odds + (sum(gain[i] for i in v) if v else gain[k])))) for v in patterns}
        toxic = sum(patterns[v] * posterior[v] for v in patterns)
        fires = lambda v, i: i in v if i < k else not v
        n = [sum(c for v, c in patterns.items() if fires(v, i)) for i in range(k + 1)]
        r = [sum(c * posterior[v] for v, c in patterns.items() if fires(v, i)) for i in range(k + 1)]
        prior = min(max((toxic + 1) / (total + 2), 1e-6), 0.5)
        hit = [min((r[i] + toxicity.BELIEF * guess_hit[i]) / (toxic + toxicity.BELIEF), 0.999) for i in range(k + 1)]
        miss = [min((n[i] - r[i] + toxicity.BELIEF * guess_miss[i]) / (total - toxic + toxicity.BELIEF), 0.999) for i in range(k + 1)]
        if step == 1:
            for i in range(k):
                high = 0.0
                for j in range(k):
                    both = sum(c * posterior[v] for v, c in patterns.items() if i in v and j in v) / max(toxic, 1)
                    if i != j and both > 0:
                        rho = (both - hit[i] * hit[j]) / math.sqrt(hit[i] * (1 - hit[i]) * hit[j] * (1 - hit[j]))
                        high += min(rho, 1) if rho > toxicity.REDUNDANT else 0
                weight[i] = 1 / (1 + high)
    return gain, odds


def test_label_model_against_em_by_hand(spark):
    patterns = {(): 900, (0,): 30, (0, 1): 45, (2,): 25, (1, 2): 6, (0, 1, 3): 12, (3,): 9}
    frame = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long").repartition(3)
    hit, miss = [0.5, 0.45, 0.2, 0.1], [0.02, 0.01, 0.03, 0.01]
    gains, odds, none = label_model(frame, np.array(hit), np.array(miss), 0.08, rounds=6)
    want, want_odds = em_by_hand(patterns, hit, miss, 0.08, 6)
    assert [*gains, none] == pytest.approx(want) and odds == pytest.approx(want_odds)


def test_linear_fit_separates():
    draw = np.random.default_rng(0)
    rows = [np.flatnonzero(draw.random(20) < 0.15) for _ in range(2000)]
    target = np.array([0.99 if 3 in r or 7 in r else 0.01 for r in rows])
    weight, bias = fit_linear(rows, target, 20)
    score = 1 / (1 + np.exp(-np.array([bias + weight[r].sum() for r in rows])))
    assert ((score > 0.7) == (target > 0.5)).mean() > 0.99 and set(np.argsort(-weight)[:2]) == {3, 7}


def labelled(spark, n=900):
    draw, rows, labels = random.Random(2), [], []
    vocabulary = ["".join(draw.choice("bdgklmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(400)]
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(5, 60))]
        bad = draw.random() < 0.2
        for _ in range(draw.randrange(2, 5) if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["idiot", "Moron!", "zzur" + draw.choice(vocabulary), "qqol" + draw.choice(vocabulary)]))
        rows.append((i, " ".join(words)))
        if draw.random() < 0.6:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    assert len(got) == 900 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) > 0.97 * len(held) > 50
    # Labels of held-out rows have no say.
    turned = labels.selectExpr("doc_id", "cast(case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as int) as toxic")
    assert {r["doc_id"]: r["score"] for r in toxicity_scores(docs, turned).collect()} == pytest.approx({i: r["score"] for i, r in got.items()})
    assert drop_toxic(docs, labels).count() == sum(not r["predicted"] for r in got.values())


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (4, None), (None, 1), (10, 0), (99, 1)], "doc_id long, toxic int")
    for frame in (labels, labels.limit(0)):
        got = toxicity_scores(odd_docs, frame).collect()
        assert len(got) == odd_docs.count() and all(0 < r["score"] < 1 for r in got)
        assert toxicity_scores(no_docs, frame).collect() == []
    kept = drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and drop_toxic(no_docs, labels).count() == 0


def test_given_table(tables):
    rows = toxicity_scores(tables.documents, tables.labels).join(tables.labels, "doc_id").collect()
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.02 * len(rows)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the larger tables")
def test_toxic_rows_that_were_held_out_are_found(spark):
    """Few of the 33 toxic documents that may be learned from tell a word apart; three in four others are found all the same."""
    t = Tables(spark, "/root/testdata/sf0.01")
    rows = toxicity_scores(t.documents, t.labels).join(t.labels, "doc_id").filter("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(toxic) >= 0.75 * len(toxic) > 10 and not any(r["predicted"] for r in rows if not r["toxic"])


def test_a_hot_group_leaves_room_for_other_words(spark):
    """A third of the labelled rows are near copies of one toxic text; the other toxic rows have words of their own."""
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("bdgklmnprst") + draw.choice("aeiou") for _ in range(n))
    plain, hot = [word(3) for _ in range(300)], [word(5) for _ in range(90)]
    bad = ["zz" + word(2) + "q" for _ in range(14)]
    rows, labels = [], {}
    for i in range(2400):
        kind = i % 3
        if kind == 0:  # two words in a hundred differ from copy to copy
            words = [*hot, *plain[:30]]
            for _ in range(2):
                words[draw.randrange(len(words))] = draw.choice(plain)
        else:
            words = [draw.choice(plain) for _ in range(40)]
            if kind == 1 and i % 9 == 1:
                words[draw.randrange(40)] = draw.choice(bad)
                words[draw.randrange(40)] = draw.choice(bad)
        toxic = kind == 0 or kind == 1 and i % 9 == 1
        rows.append((i, " ".join(words)))
        labels[i] = int(toxic)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    names = toxicity.mined_features(docs.selectExpr("doc_id as id", "text"), marks.selectExpr("doc_id as _id", "toxic as label"))[0]
    voters = set(names[: toxicity.VOTERS])
    found = sum(b in voters or any(b.startswith(v[:-1]) for v in voters if v.endswith("*")) for b in bad)
    assert found == 14
    got = {r["doc_id"]: r for r in toxicity_scores(docs, marks).collect()}
    for kind in (0, 1, 2):
        held = [i for i in labels if got[i]["held_out"] and i % 3 == kind]
        assert sum(got[i]["predicted"] == labels[i] for i in held) > 0.95 * len(held) > 50


def test_cover_turns_to_rows_not_covered():
    rows = np.array([0, 0, 1, 1, 2, 2, 3])
    assert toxicity.cover(rows, np.array([0, 1, 0, 1, 0, 1, 2]), np.array([9.0, 8.0, 5.0]), 2) == [0, 2, 1]
