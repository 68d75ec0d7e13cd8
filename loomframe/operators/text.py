"""TF-IDF and label bags as long tables; nothing is densified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loomframe.functions.text import latin_words
from loomframe.operators.aggregate import first_seen_codes
from loomframe.operators.lookup import encode
from loomframe.plans.checkpoints import materialize
from loomframe.plans.lookups import frequent, lookup_join, whole_key, without_frequent


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, key, term, tf) of lower-cased ``[a-zA-Z]+`` words.

    Texts move to the task of their key (``_key``, without nulls) before they are cut, so words and counts do not move.
    """
    moved = df.select(whole_key(key).alias("_key"), key, text).repartition("_key")
    return moved.select("_key", key, F.explode(latin_words(text)).alias("term")).groupBy("_key", key, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def fit_vocabulary(
    counts: DataFrame, n_documents: int, min_df: float = 1, max_df: float = 1.0
) -> DataFrame:
    """(term, df, idf) of train terms: limits are counts when whole numbers above one, else shares of documents."""

    def limit(value: float) -> float:
        return value if isinstance(value, int) else value * n_documents

    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = df.filter((F.col("df") >= limit(min_df)) & (F.col("df") <= limit(max_df)))
    return materialize(kept.withColumn("idf", F.log(F.lit(1.0 + n_documents) / (F.col("df") + 1)) + 1))


def tf_idf(counts: DataFrame, vocabulary: DataFrame, key: str, sublinear: bool = False) -> DataFrame:
    """(key, term, weight), unit length per document; terms outside the vocabulary drop out.

    The vocabulary is the fitted table, stored. Its most frequent terms are broadcast, so their counts stay with their
    document if they come from ``term_counts``; only those of the other terms move to the vocabulary and back. The
    length is that of one document's own terms, which are held as one array.
    """
    tf = F.log("tf") + 1 if sublinear else F.col("tf")
    keyed = counts if "_key" in counts.columns else counts.withColumn("_key", whole_key(key))

    def rated(rows: DataFrame, entries: DataFrame) -> DataFrame:
        raw = lookup_join(rows, entries.select("term", "idf"), ["term"]).withColumn("raw", tf * F.col("idf"))
        return raw.groupBy("_key").agg(F.first(key).alias(key), F.sum(F.col("raw") * F.col("raw")).alias("squares"), F.collect_list(F.struct("term", "raw")).alias("terms"))

    common = frequent(vocabulary, "term", "df")
    whole = rated(keyed, F.broadcast(common))
    if common.count() < vocabulary.count():
        rest = rated(without_frequent(keyed, common, "term"), vocabulary).toDF("_key", "_id", "_squares", "_terms")
        none = F.array().cast(whole.schema["terms"].dataType)
        whole = whole.join(rest, "_key", "full_outer").select(
            F.coalesce(key, "_id").alias(key),
            (F.coalesce("squares", F.lit(0.0)) + F.coalesce("_squares", F.lit(0.0))).alias("squares"),
            F.concat(F.coalesce("terms", none), F.coalesce("_terms", none)).alias("terms"),
        )
    weights = whole.select(key, F.sqrt("squares").alias("_length"), F.inline("terms"))
    return weights.select(key, "term", (F.col("raw") / F.col("_length")).alias("weight"))


def label_codes(df: DataFrame, key: str, labels: str, pattern: str = r",\s*") -> DataFrame:
    """(label, code): labels of a joined list numbered from 1 in order of appearance; 0 is kept for none."""
    parts = df.select(key, F.posexplode(F.split(labels, pattern)).alias("pos", "label"))
    return first_seen_codes(parts, "label", [key, "pos"], start=1)


def code_bag(df: DataFrame, key: str, labels: str, dictionary: DataFrame, width: int, pattern: str = r",\s*") -> DataFrame:
    """One code column per list position, 0 beyond the end of the list."""
    parts = df.select(key, F.posexplode(F.split(labels, pattern)).alias("pos", "label"))
    coded = encode(parts, dictionary, "label")
    return coded.groupBy(key).agg(
        *[F.coalesce(F.max(F.when(F.col("pos") == i, F.col("code"))), F.lit(0)).alias(f"code_{i + 1}") for i in range(width)]
    )


def longest_list(df: DataFrame, labels: str, pattern: str = r",\s*") -> int:
    return df.agg(F.max(F.size(F.split(labels, pattern)))).first()[0]


def top_words(df: DataFrame, group: str, words: str, n: int, min_length: int = 1) -> DataFrame:
    """(group, word, n, rn): the n most frequent words of each group."""
    from loomframe.operators.window import quota

    parts = df.select(group, F.explode(F.split(words, " ")).alias("word")).filter(F.length("word") >= min_length)
    counts = parts.groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))
    return quota(counts, [group], [F.desc("n"), F.col("word")], n)
