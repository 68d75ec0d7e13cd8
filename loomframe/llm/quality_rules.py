"""Quality rules with risk-controlled cutoffs.

Every document gets counts of its words, symbols, lines and repeats. A rule is a value made of them and a grid of
cutoffs; it rejects what lies above its cutoff. Base rules have fixed cutoffs. For all others labelled documents
decide, apart in each stratum (a language, say):

1. One half of the labelled documents proposes, per stratum and rule, the cutoff that rejects most bad documents
   while it rejects next to no good ones, or none if no cutoff is of use, and puts the rules in order of their use.
2. The other half, the holdout, certifies the rules of a stratum one after the other: a rule takes effect only if
   an exact binomial test shows that all rules up to this one reject a good document with a chance of at most
   ``alpha``. The test is the Clopper-Pearson bound turned around: the upper bound lies below ``alpha`` exactly
   where the binomial tail lies below the level. The first failure ends the sequence.
3. Tests in a fixed order need no correction among themselves; over the strata the level is Bonferroni's,
   ``delta`` by their number. So with probability ``1 - delta`` no stratum at all loses more than ``alpha`` of its
   good documents to the rules. A stratum with too few labels loses none.

Everything is made of DataFrame expressions. A document's repeats are found inside its row (hashes of its windows,
sorted), so no words are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.plans.checkpoints import materialize
from loomframe.plans.ordered import join_stats

#: Fixed value: the white space that ends words.
BLANK = " \t\n\x0b\f\r"
WINDOW = 8  # words of a repeat

#: A rule's value as SQL over the counts (it rejects above the cutoff), and its cutoffs, mildest last.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("try_divide(n_symbols, n_words)", (0.05, 0.1, 0.2, 0.4, 0.8)),
    "marks": ("try_divide(n_marks, n_words)", (0.25, 0.5, 0.75, 1.0, 1.5)),
    "capitals": ("try_divide(n_capitals, word_chars)", (0.2, 0.3, 0.5, 0.7)),
    "long_words": ("try_divide(word_chars, n_words)", (8.0, 9.0, 10.0, 12.0, 16.0)),
    "short_words": ("try_divide(-word_chars, n_words)", (-4.0, -3.5, -3.0, -2.0)),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", (0.05, 0.1, 0.2, 0.3, 0.5)),
    "few_distinct": ("try_divide(-n_distinct_words, n_words)", (-0.3, -0.25, -0.2, -0.15, -0.1)),
    "repeats": ("try_divide(n_repeat_words, n_words)", (0.05, 0.1, 0.15, 0.2, 0.25)),
}
ALPHA = 0.02  # good documents of a stratum that all rules together may reject
DELTA = 0.05  # chance that some stratum loses more
USEFUL = 0.01  # a proposed rule rejects at least this share of the stratum's bad documents
SALTS = 32  # tasks that share the rows of a stratum where rows meet its rules
TOLERATED = 0.25  # of a rule's even share of ``alpha``: the good documents that it may reject when it is proposed


# -- counts ------------------------------------------------------------------------------------------------------


def _pairs(array: str, step: int) -> Column:
    """Hashes of each element with the one ``step`` places on; the last ``step`` have none."""
    left = F.expr(f"slice({array}, 1, greatest(size({array}) - {step}, 0))")
    return F.zip_with(left, F.expr(f"slice({array}, {step + 1}, greatest(size({array}) - {step}, 0))"), lambda a, b: F.xxhash64(a, b))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, n_words, n_distinct_words, word_chars, n_symbols, n_marks, n_capitals, n_lines, n_dup_lines, n_repeat_words) of each row.

    Null texts are empty; an empty text has zeros everywhere. ``n_lines`` and ``n_dup_lines`` count lines with a
    word, the second those equal to an earlier line; ``n_repeat_words`` counts words in windows of 8 words that
    occur at least twice (windows are compared by 64-bit hashes within the row). Other columns are not read.
    """
    text, blank = F.col("text"), F.lit(BLANK)
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    trimmed = F.btrim(text, blank)
    rows = rows.select(
        "id", "stratum",
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
        F.when(trimmed == "", none).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, blank) != "").alias("lines"),
    )
    rows = rows.select(
        "id", "stratum", "n_symbols", "n_marks", "n_capitals", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    # Windows of 2, 4 and 8 words, each from two neighbours of the size before.
    counts = ["id", "stratum", "n_words", "n_distinct_words", "word_chars", "n_symbols", "n_marks", "n_capitals", "n_lines", "n_dup_lines"]
    for size in (2, 4, 8):
        rows = rows.select(*counts, _pairs(f"h{size // 2}", size // 2).alias(f"h{size}"))
    placed = F.transform("h8", lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    empty = F.array().cast("array<struct<h: bigint, at: int>>")
    rows = rows.select(*counts, F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.sort_array(placed)).otherwise(empty).alias("w"))
    left, right = (F.expr(f"slice(w, {start}, greatest(size(w) - 1, 0))") for start in (1, 2))
    same = F.zip_with(left, right, lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
    rows = rows.select(*counts, F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))).alias("at"))
    # Windows found twice, by place: each covers the words up to the next one, eight at most.
    steps = F.zip_with(F.expr("slice(at, 1, greatest(size(at) - 1, 0))"), F.expr("slice(at, 2, greatest(size(at) - 1, 0))"), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("at") > 0, F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)).otherwise(0)
    return rows.select(*counts, covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


# -- exact binomial test -----------------------------------------------------------------------------------------


def log_factorial(x: Column) -> Column:
    """ln x!: exact for small numbers, Stirling's series (to double precision) beyond."""
    big = x.cast("double")
    series = (big + 0.5) * F.log(big) - big + 0.9189385332046727 + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: str, k: str, rate: str) -> Column:
    """P(X <= k) for X ~ Bin(n, rate), from columns; 1 where ``k >= n * rate``, where no test could pass.

    The terms fall from ``k`` downwards; the sum goes as far as a double can tell.
    """
    n_, k_, p = F.col(n), F.col(k), F.col(rate)
    lead = log_factorial(n_) - log_factorial(k_) - log_factorial(n_ - k_) + k_ * F.log(p) + (n_ - k_) * F.log(1 - p)
    steps = F.least(k_, F.ceil(12 * F.sqrt(n_ * p * (1 - p)) + 50)).cast("int")
    places = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k_ - j + 1) / (n_ - k_ + j) * (1 - p) / p
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.when(k_ >= n_ * p, 1.0).otherwise(F.exp(lead) * F.aggregate(places, start, add)["sum"])


# -- cutoffs -----------------------------------------------------------------------------------------------------


def halves(id_: Column) -> Column:
    """0 for labelled documents that propose, 1 for those of the holdout."""
    return F.conv(F.substring(F.md5(id_.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 2


def _stratum_key() -> Column:
    """A key without nulls, which joins."""
    return F.concat(F.when(F.col("stratum").isNull(), "n").otherwise("v"), F.coalesce(F.col("stratum").cast("string"), F.lit("")))


def certified_cutoffs(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, place, rule, cutoff, holdout, rejected, p_value, certified) of each proposed rule.

    ``labels`` has 1 for good; an id labelled twice counts as bad if any label is 0; null ids and labels are not
    used. ``rejected`` of ``holdout`` good documents fell to this rule or to one before it.
    Documents that fail the base rules tell nothing about the others and are left out here.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(good_col)).alias("_good"))
    known = counts.filter(~base_failed()).join(marks, "id")
    value = F.create_map(*[x for name, (expr, _) in rules.items() for x in (F.lit(name), F.expr(expr).cast("double"))])
    grid = F.create_map(*[x for name, (_, cutoffs) in rules.items() for x in (F.lit(name), F.array(*[F.lit(float(c)) for c in cutoffs]))])
    known = materialize(known.select(_stratum_key().alias("_stratum"), "stratum", (F.col("_good") >= 1).alias("good"), (halves(F.col("id")) == 1).alias("held"), value.alias("values")))
    fit = known.filter("NOT held").select("_stratum", "stratum", "good", F.explode("values").alias("rule", "value"))
    fit = fit.withColumn("cutoff", F.explode(F.element_at(grid, F.col("rule"))))
    hit, good = F.coalesce(F.col("value") > F.col("cutoff"), F.lit(False)), F.col("good")
    sums = fit.groupBy("_stratum", "rule", "cutoff").agg(
        F.first("stratum").alias("stratum"), F.count_if(good).alias("fit_good"), F.count_if(~good).alias("fit_bad"), F.count_if(good & hit).alias("good_hit"), F.count_if(~good & hit).alias("bad_hit"))
    fits = (F.col("good_hit") <= F.col("fit_good") * (alpha * TOLERATED / len(rules))) & (F.col("bad_hit") >= F.greatest(F.col("fit_bad") * USEFUL, F.lit(1.0)))
    best = sums.filter(fits).groupBy("_stratum", "rule").agg(F.max(F.struct("bad_hit", "cutoff", "stratum")).alias("b"))
    # A few rows per stratum from here on, and one with all rules of a stratum, in order.
    best = best.select("_stratum", "b.stratum", "rule", "b.cutoff", F.row_number().over(Window.partitionBy("_stratum").orderBy(F.desc("b.bad_hit"), "rule")).alias("place"))
    proposed = materialize(best)
    ladders = materialize(proposed.groupBy("_stratum").agg(F.collect_list(F.struct("place", "rule", "cutoff")).alias("ladder")))
    # A hot stratum's rows are dealt to several tasks, each of which gets the stratum's one row of rules.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt")
    held = known.filter("held AND good").select("_stratum", "values", salt).join(ladders.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["_stratum", "_salt"])
    first = F.array_min(F.transform(F.filter("ladder", lambda x: F.element_at("values", x["rule"]) > x["cutoff"]), lambda x: x["place"]))
    fallen = held.groupBy("_stratum", F.coalesce(first, F.lit(0)).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    sizes = fallen.groupBy("_stratum").agg(F.sum("n").alias("holdout"))
    steps = proposed.join(sizes, "_stratum", "left").join(fallen, ["_stratum", "place"], "left")
    upto = Window.partitionBy("_stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    steps = steps.withColumns({"holdout": F.coalesce("holdout", zero), "rejected": F.sum(F.coalesce("n", zero)).over(upto), "alpha": F.lit(float(alpha))})
    strata = proposed.agg(F.count_distinct("_stratum").alias("strata"))
    tested = steps.withColumn("p_value", binomial_tail("holdout", "rejected", "alpha")).crossJoin(F.broadcast(strata))  # one row
    certified = F.min(F.col("p_value") <= F.lit(delta) / F.col("strata")).over(upto)
    return tested.select("stratum", "place", "rule", "cutoff", "holdout", "rejected", "p_value", certified.alias("certified"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts of each row with ``base_failed``, ``rejected_by`` (certified rules, sorted) and ``kept``.

    ``id`` and ``stratum`` keep the values of their columns. A null stratum is one of its own. A value that is not
    defined (no words, no lines) is rejected by no rule. Repeated rows and ids stay rows of their own, an empty
    table gives no rows; without labels only the base rules reject. Only the four named columns are read, so
    others may have any name.
    """
    counts = materialize(text_counts(docs, id_col, text_col, stratum_col))
    cutoffs = certified_cutoffs(counts, labels, id_col, good_col, rules, alpha, delta)
    chosen = cutoffs.filter("certified").groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    chosen = materialize(chosen.select(_stratum_key().alias("_stratum"), "cutoffs"))  # a row per stratum
    rows = join_stats(counts.withColumn("_stratum", _stratum_key()), chosen, ["_stratum"], "left")
    hits = [F.when(F.expr(value) > F.element_at("cutoffs", F.lit(name)), F.lit(name)) for name, (value, _) in sorted(rules.items())]
    rows = rows.withColumns({"base_failed": base_failed(), "rejected_by": F.array_compact(F.array(*hits))})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", "cutoffs")
