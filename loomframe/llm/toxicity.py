"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

1. Voters. A lexicon voter fires on a word, a pattern voter on a word beginning (``abcd*``). A short list of
   insults is given; the others are mined from a bounded number of labelled rows: features common among toxic
   ones and rare among the rest, the latter also if each group of near copies counts once. Each next voter is the one
   with the most evidence in toxic rows that earlier ones do not cover yet, so a group of near copies takes few places.
2. Label model, without labels, over the votes of all documents: a class prior and, per voter, the chance to fire
   on a toxic and on a clean document, fitted by expectation maximisation. Each round is one aggregate over the
   distinct vote patterns. Voters that fire together more often than their class explains are correlated; a voter
   counts ``1 / (1 + sum of its high correlations)``, and the rounds go on with these weights.
3. Classifier. Logistic regression with the posteriors as soft labels, on all mined features, from a bounded
   number of rows. It scores every document.

Labels are learned from rows with ``crc32(id) mod 3 <> 1`` only, and neither labels nor any column but the text
enters a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomframe.llm.rows import free_name, without_rows
from loomframe.llm.simhash import Labels
from loomframe.llm.suffix_tree import hashes, words_of
from loomframe.llm.tokens import bounded
from loomframe.plans.checkpoints import materialize

#: The given lexicon; mining adds to it.
INSULTS = ("clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
PREFIXES = (4, 5, 6, 7)  # code points of a pattern's word beginning
LABELLED_ROWS = 30_000  # labelled rows that mining reads at most
FIT_ROWS = 60_000  # rows that the classifier is fitted on at most
VOTERS, FEATURES, CANDIDATES = 256, 4096, 50_000  # bounds of the voters, the classifier's features, and what is mined from
MINED_BYTES = 1 << 20  # text bytes that mining handles at once
LEAST_DOCS = 4  # toxic rows that a mined feature has to be in
PRECISION = 0.85  # toxic share that the labelled rows with a mined feature have to exceed
BANDS, BAND = 16, 3  # near copies in mining: texts that agree in one band of that many least hashes of 3-word shingles
ROUNDS = 8
REDUNDANT = 0.6  # correlation from which two voters are taken to tell the same
BELIEF = 100  # documents that a first guess of a voter's rates counts as
_EDGE = "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum())


def features_of(word: bytes) -> list[str]:
    """Lexicon and pattern features of a lower-cased word, punctuation around it left out."""
    text = word.decode("utf-8", "replace").strip(_EDGE)
    if not text or len(text) > 64:
        return []
    return [text, *(text[:n] + "*" for n in PREFIXES if len(text) >= n)]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _hits(known: dict[str, int], codes: np.ndarray, distinct: pa.Array, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of known features, each once and sorted."""
    get, word, feature = known.get, [], []
    for i, text in enumerate(distinct.to_pylist()):
        for f in features_of(text):
            k = get(f)
            if k is not None:
                word.append(i)
                feature.append(k)
    if not word:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word, feature = np.array(word), np.array(feature)
    starts = np.searchsorted(word, np.arange(len(distinct) + 1))
    hit = np.flatnonzero(np.diff(starts)[codes])  # words of the rows that have a feature
    count = np.diff(starts)[codes[hit]]
    row = np.repeat(np.searchsorted(firsts, hit, "right") - 1, count)
    at = np.repeat(starts[codes[hit]] - np.cumsum(count) + count, count) + np.arange(count.sum())
    pair = np.unique(row * len(known) + feature[at])
    return pair // len(known), pair % len(known)


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n) over rows, each feature once per row."""
    seen: Counter[str] = Counter()
    for table in bounded(batches, limit=MINED_BYTES):
        codes, distinct, firsts = words_of(table["text"])
        own = [features_of(w) for w in distinct.to_pylist()]
        for a, b in zip(firsts, firsts[1:]):
            seen.update({f for c in np.unique(codes[a:b]).tolist() for f in own[c]})
        if len(seen) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])
            seen.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])


def _count(known):
    """(feature number, n) of known features over rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for table in bounded(batches, limit=MINED_BYTES):
            total += np.bincount(_hits(known.value, *words_of(table["text"]))[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["feature", "n"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, bands) with ``BANDS`` hashes of each text."""
    seeds = np.random.default_rng(7).integers(1, 1 << 62, BANDS * BAND, np.uint64) | np.uint64(1)
    for table in bounded(batches, limit=MINED_BYTES):
        codes, distinct, firsts = words_of(table["text"])
        own = hashes(distinct.to_pylist())[codes] if len(codes) else np.empty(0, np.uint64)
        out = []
        for a, b in zip(firsts, firsts[1:]):
            words = np.unique(_shingles(own[a:b]))
            least = [np.min(_shuffled(words ^ seed), initial=np.uint64((1 << 64) - 1)) for seed in seeds]
            out.append([int(hash(tuple(int(x) for x in least[k : k + BAND]))) for k in range(0, len(least), BAND)] if len(words) else [])
        yield pa.RecordBatch.from_arrays([table["row"].combine_chunks(), pa.array(out, pa.list_(pa.int64()))], ["row", "bands"])


def _shuffled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of three adjacent words, or of all where there are fewer."""
    size = min(3, len(words))
    out = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        out = _shuffled(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return out


def near_copies(rows: list, bands: list) -> np.ndarray:
    """A number for the group of each text: those linked over equal bands."""
    labels = Labels(len(rows))
    for k in range(BANDS):
        at = np.array([i for i, b in enumerate(bands) if len(b)], np.int64)
        if len(at):
            _, first, where = np.unique(np.array([bands[i][k] for i in at], np.int64), return_index=True, return_inverse=True)
            labels.join(at[first][where], at)
    return labels.of


def cover(rows: np.ndarray, features: np.ndarray, strength: np.ndarray, picks: int) -> list[int]:
    """Features in the order of choice, ``picks`` of them one by one.

    ``rows`` and ``features`` are the pairs of toxic rows and features in them. The evidence of a feature counts by its
    share of rows not covered; a row counts half as much with each chosen feature in it. The others follow by what is left.
    """
    weight = np.ones(rows.max(initial=-1) + 1)
    own = np.maximum(np.bincount(features, minlength=len(strength)), 1)
    order = np.argsort(features, kind="stable")
    starts = np.searchsorted(features[order], np.arange(len(strength) + 1))
    open_, chosen = strength > 0, []
    while True:
        gain = np.where(open_, strength * np.bincount(features, weight[rows], minlength=len(strength)) / own, -1)
        if len(chosen) >= picks or not open_.any():
            rest = np.argsort(-gain, kind="stable")
            return chosen + rest[open_[rest]].tolist()
        best = int(np.argmax(gain))
        chosen.append(best)
        open_[best] = False
        weight[rows[order[starts[best] : starts[best + 1]]]] /= 2


def _vote(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bounded(batches):
            row, feature = _hits(known.value, *words_of(table["text"]))
            ends = np.searchsorted(row, np.arange(table.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), table["row"].combine_chunks(), table["held_out"].combine_chunks(), lists], ["id", "row", "held_out", "features"])

    return run


def _share(frame: DataFrame, key: str, most: int) -> DataFrame:
    """A share of the rows of a checkpoint, ``most`` at most, by a hash of key and place: a hot key is spread as well."""
    n = frame.count()
    if n <= most:
        return frame
    order = F.xxhash64(F.lit("share"), F.col(key), F.monotonically_increasing_id())
    rough = frame.withColumn("_order", order).filter(F.pmod("_order", F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.2 * most / n)) + 1)
    return rough.orderBy("_order").limit(most).drop("_order")


def mined_features(rows: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(features, voters first; their rates among toxic and clean rows; toxic share) from labelled rows that are not held out."""
    spark = rows.sparkSession
    marks = labels.filter("label is not null").groupBy("_id").agg(F.max("label").alias("label")).filter(~held_out("_id"))
    used = materialize(_share(materialize(marks), "_id", LABELLED_ROWS))
    sizes = {bool(r["label"]): r["n"] for r in used.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    given = list(INSULTS)
    if not toxic or not clean:
        return given, np.full(len(given), 0.05), np.full(len(given), 0.0005), 0.1
    # The sample is bounded, so its ids are broadcast and only its texts move; equal texts count once.
    texts = rows.join(F.broadcast(used), F.col("id") == F.col("_id")).groupBy(F.xxhash64("text").alias("_h"))
    texts = materialize(texts.agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label"))
    texts = materialize(_share(texts, "text", LABELLED_ROWS))  # an id with a label may have any number of texts
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    banded = numbered.select("row", "text").mapInArrow(_bands, "row long, bands array<long>").collect()
    groups = near_copies(banded, [r["bands"] for r in banded]).tolist()
    groups = spark.createDataFrame([(r["row"], g) for r, g in zip(banded, groups)], "row long, g long")
    # The features of a group of near copies are those of its texts, put one after the other.
    merged = numbered.join(F.broadcast(groups), "row").groupBy("g", "label").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    found = texts.filter("label = 1").mapInArrow(lambda b: _mine(_only_text(b)), "feature string, n long")
    found = found.groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    some = {r["feature"]: r["n"] for r in found.orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()}
    known = {f: i for i, f in enumerate(sorted({*some, *given}))}
    sent = spark.sparkContext.broadcast(known)

    def counted(frame: DataFrame) -> np.ndarray:
        out = np.zeros(len(known))
        for r in frame.select("text").mapInArrow(_count(sent), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
            out[r["feature"]] = r["n"]
        return out

    other, merged = counted(texts.filter("label = 0")), materialize(merged)
    once, once_other = (counted(merged.filter(F.col("label") == k)) for k in (1, 0))
    names = sorted(known)
    own = np.array([some.get(f, 0) for f in names], float)
    share, n = toxic / (toxic + clean), np.maximum(own + other, 1)
    rate = np.clip(own / n, 1e-9, 1 - 1e-9)
    evidence = n * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    # As many features as were looked at would make a fluke of this size likely once: ask for more.
    rate_once = once / np.maximum(once + once_other, 1)
    strength = np.where((own >= LEAST_DOCS) & (rate > PRECISION) & (rate_once > PRECISION) & (evidence > np.log(max(len(some), 1)) + 1), evidence, 0)
    strong = np.flatnonzero(strength)
    at = spark.sparkContext.broadcast({names[i]: k for k, i in enumerate(strong)})
    voted = numbered.filter("label = 1").select(F.col("row").alias("id"), "row", F.lit(False).alias("held_out"), "text")
    fired = [r["features"] for r in voted.mapInArrow(_vote(at), "id long, row long, held_out boolean, features array<int>").collect()] if len(strong) else []
    pairs = np.repeat(np.arange(len(fired)), [len(f) for f in fired]), np.array([k for f in fired for k in f], np.int64)
    order = [names[strong[k]] for k in cover(*pairs, strength[strong], VOTERS)]
    voters = list(dict.fromkeys([*given, *order[: VOTERS - len(given)]]))
    chosen = list(dict.fromkeys([*voters, *order]))[:FEATURES]
    at = [known[f] for f in chosen]
    return chosen, (own[at] + 0.5) / (toxic + 1), (other[at] + 0.5) / (clean + 50), share


def _only_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select(["text"])


def label_model(patterns: DataFrame, hit: np.ndarray, miss: np.ndarray, prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """(log-odds that each fired voter adds, prior log-odds, log-odds that are added where none fires).

    ``patterns`` has ``votes`` (fired voters) and ``n`` (documents); ``hit`` and ``miss`` are the voters' chances to
    fire on toxic and clean documents as first guessed, which weigh as much as ``BELIEF`` documents. A voter that does
    not fire abstains; that none fires is a voter of its own.
    """
    total, n_voters = patterns.agg(F.sum("n")).first()[0] or 0, len(hit)
    hit, miss = np.append(hit, 0.1), np.append(miss, 0.9)  # the last one: none fires
    guess_hit, guess_miss, weight = hit, miss, np.ones(n_voters)
    for step in range(rounds):
        gains = np.append(weight, 1.0) * np.log(hit / miss)
        odds = float(np.log(prior / (1 - prior)))
        rated = patterns.withColumn("r", _posterior(F.col("votes"), gains[:-1], odds, float(gains[-1])))
        fired = F.when(F.size("votes") == 0, F.array(F.lit(n_voters))).otherwise(F.col("votes"))
        sums = rated.select(F.explode(fired).alias("v"), "n", "r").groupBy("v").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r")).alias("r")).collect()
        toxic = float(rated.agg(F.sum(F.col("n") * F.col("r"))).first()[0] or 0)
        n, r = np.zeros(n_voters + 1), np.zeros(n_voters + 1)
        for row in sums:
            n[row["v"]], r[row["v"]] = row["n"], row["r"]
        prior = min(max((toxic + 1) / (total + 2), 1e-6), 0.5)
        hit = np.clip((r + BELIEF * guess_hit) / (toxic + BELIEF), 1e-6, 0.999)
        miss = np.clip((n - r + BELIEF * guess_miss) / (total - toxic + BELIEF), 1e-9, 0.999)
        if step == 1:
            weight = _weights(rated, hit[:-1], toxic)
    return gains[:-1], odds, float(gains[-1])


def _weights(rated: DataFrame, hit: np.ndarray, toxic: float) -> np.ndarray:
    """1 / (1 + correlations within the toxic class) of each voter, as far as they are above ``REDUNDANT``."""
    pairs = rated.select(F.explode("votes").alias("a"), "votes", "n", "r").select("a", F.explode("votes").alias("b"), (F.col("n") * F.col("r")).alias("r"))
    together = np.zeros((len(hit), len(hit)))
    for row in pairs.filter("a < b").groupBy("a", "b").agg(F.sum("r").alias("r")).collect():
        together[row["a"], row["b"]] = together[row["b"], row["a"]] = row["r"] / max(toxic, 1)
    spread = np.sqrt(np.outer(hit * (1 - hit), hit * (1 - hit)))
    correlation = np.where(together > 0, (together - np.outer(hit, hit)) / np.maximum(spread, 1e-9), 0)
    np.fill_diagonal(correlation, 0)
    return 1 / (1 + np.where(correlation > REDUNDANT, np.minimum(correlation, 1), 0).sum(axis=1))


def _posterior(votes: Column, gains: np.ndarray, odds: float, none: float) -> Column:
    table = F.array(*[F.lit(float(g)) for g in gains])
    total = F.aggregate(votes, F.lit(odds), lambda a, v: a + F.element_at(table, v + 1)) + F.when(F.size(votes) == 0, none).otherwise(0.0)
    return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-40.0)), F.lit(40.0))))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, n_features: int, penalty: float = 0.005, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on sparse 0/1 rows: adaptive gradient steps, weights not negative."""
    lengths = np.array([len(r) for r in rows], np.int64)
    feature = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    theta = np.zeros(n_features + 1)  # the last one is the intercept
    theta[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        odds = theta[-1] + np.bincount(owner, theta[feature], minlength=len(rows))
        miss = 1 / (1 + np.exp(-np.clip(odds, -40, 40))) - target
        slope = np.append(np.bincount(feature, miss[owner], minlength=n_features) + penalty * theta[:-1], miss.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        rate = 0.1 * (1 - step / (steps + 1)) + 0.005
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        theta[:-1] = np.maximum(theta[:-1], 0)
    return theta[:-1], float(theta[-1])


def _score(model, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        for batch in batches:
            lists = batch.column("features")
            feature, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            odds = bias + np.bincount(owner, weight[feature], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("id", "row", "held_out")), pa.array(score), pa.array((score >= limit).astype(np.int32))], ["id", "row", "held_out", "score", "predicted"]
            )

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    limit: float = 0.7, row_col: str | None = None) -> DataFrame:
    """(id, held_out, score, predicted) of every row; ``predicted`` is 1 from a score of ``limit`` on.

    A null or empty text has no feature and the score of the intercept. Null and repeated ids are passed on; a
    null id is not held out and has no label. Several labels of an id count as the largest, null labels as none.
    Without toxic or clean labels the given lexicon votes alone. An empty table gives no rows. Other columns are
    not read, so their names cannot clash; ``row_col`` names one to pass through.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(id_col).alias("held_out"), (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    names, hit, miss, prior = mined_features(rows.select("id", "text"), marks)
    n_voters = min(len(names), VOTERS)
    known = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    schema = rows.select("id", "row", "held_out").schema.add("features", ArrayType(IntegerType()))
    voted = materialize(rows.mapInArrow(_vote(known), schema))
    patterns = voted.select(F.filter("features", lambda f: f < n_voters).alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = materialize(patterns)
    gains, odds, none = label_model(patterns, hit[:n_voters], miss[:n_voters], min(max(prior, 0.001), 0.5))
    posterior = _posterior(F.filter("features", lambda f: f < n_voters), gains, odds, none)
    sample = _share(voted.filter("not held_out"), "row", FIT_ROWS).select("features", posterior.alias("r")).toPandas()
    model = fit_linear(list(sample["features"]), sample["r"].to_numpy(float), len(names)) if len(sample) else (np.zeros(len(names)), -4.0)
    sent = spark.sparkContext.broadcast(model)
    shape = rows.select("id", "row", "held_out").schema.add("score", "double").add("predicted", "integer")
    scored = voted.mapInArrow(_score(sent, limit), shape).withColumnRenamed("id", id_col)
    return scored.withColumnRenamed("row", row_col) if row_col else scored.drop("row")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows below the limit, columns and their names as they are; the input has to be recomputable."""
    row = free_name(docs.columns, "_toxic_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    bad = toxicity_scores(numbered, labels, row_col=row, **options).filter("predicted = 1").select(row)
    return without_rows(numbered, row, materialize(bad))
