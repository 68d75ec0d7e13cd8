"""Exact duplicates by deterministic block naming, with DataFrame operations only.

A text without ASCII white space is cut into blocks of ``BLOCK`` code points. Equal blocks get the same
integer name: blocks are shuffled and sorted by their content, and the smallest occurrence number among equal
ones is their name. Names of adjacent pairs are named again in the same way (the pair of integers takes the
place of the content), which halves a document's names each round, until one is left. Equal numbers of blocks
and equal last names mean equal texts, block by block: nothing rests on a digest, so nothing can collide.

A name joins back on the content it stands for. Hot blocks, counted beforehand, get theirs by broadcast; hot
pairs and groups are split by Spark's skew join. Most documents have one block and are done in round 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.llm.rows import free_name, without_rows
from loomframe.plans.checkpoints import materialize

BLOCK = 4096  # code points per block
HOT = 1 / 512  # share of all blocks from which one is hot
SPACES = " \t\n\x0b\x0c\r"  # fixed value: the characters that do not count


def normalized(text: Column) -> Column:
    """Text without ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def _named(occurrences: DataFrame, content: list[str]) -> DataFrame:
    """Add ``name``, the smallest occurrence number of equal content (integers here).

    The names are checkpointed, so that both sides of the join are plain shuffles, which Spark splits at hot keys.
    """
    names = occurrences.groupBy(*content).agg(F.min("occurrence").alias("name"))
    names = materialize(names.select(*[F.col(c).alias(f"_{c}") for c in content], "name"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "second" else F.col(c) == F.col(f"_{c}") for c in content]
    joined = occurrences.hint("merge").join(names, same)
    return joined.drop(*content, *[f"_{c}" for c in content], "occurrence")


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """The same for blocks of text, which move twice: once to be named, once to fetch their names.

    A block that makes up more than ``HOT`` of all of them does not move to fetch its name: there are fewer than
    ``1 / HOT`` such blocks, so their names are broadcast (with their whole content; digests only preselect).
    """
    tagged = blocks.withColumn("digest", F.xxhash64("content"))
    counts = materialize(tagged.groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r["digest"] for r in counts.filter((F.col("n") > total * HOT) & (F.col("n") > 1)).select("digest").collect()]

    def named(rows: DataFrame, broadcast: bool) -> DataFrame:
        names = rows.groupBy("content").agg(F.min("occurrence").alias("name")).withColumnRenamed("content", "_content")
        joined = rows.join(F.broadcast(names), F.col("content") == F.col("_content")) if broadcast else rows.hint("merge").join(names, F.col("content") == F.col("_content"))
        return joined.drop("content", "_content", "occurrence", "digest")

    if not hot:
        return named(tagged, False)
    is_hot = F.col("digest").isin(hot)
    return named(tagged.filter(~is_hot), False).unionByName(named(tagged.filter(is_hot), True))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, id, n_chars, text_sha256, blocks, name) of every row; (blocks, name) is equal for equal texts only.

    ``row`` numbers the rows by their place in the input, which has to be recomputable (files or a checkpoint).
    """
    text = normalized(F.col(text_col))
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"), text.alias("text"),
    )
    base = base.select("row", "id", "n_chars", F.unhex(F.sha2("text", 256)).alias("sha"), "text", F.greatest(F.ceil(F.char_length("text") / block), F.lit(1)).cast("int").alias("blocks"))
    whole = F.when(F.col("blocks") == 1, F.array("text")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring(F.col("text"), i * block + 1, F.lit(block)))
    )
    cut = base.select("row", "blocks", "id", "n_chars", "sha", F.posexplode(whole).alias("place", "content"))
    for column in ("id", "n_chars", "sha"):  # kept on the first block of a row only
        cut = cut.withColumn(column, F.when(F.col("place") == 0, F.col(column)))
    rows = materialize(_named_blocks(cut.withColumn("occurrence", F.monotonically_increasing_id())))
    done = rows.filter("blocks = 1").drop("place")
    rows = rows.filter("blocks > 1").withColumn("left", F.col("blocks"))
    while not rows.isEmpty():
        pairs = rows.groupBy("row", F.shiftright("place", 1).alias("place")).agg(
            F.first("blocks").alias("blocks"), F.first("left").alias("left"), F.max("id").alias("id"), F.max("n_chars").alias("n_chars"), F.max("sha").alias("sha"),
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("first"), F.max(F.when(F.col("place") % 2 == 1, F.col("name"))).alias("second"),
        )
        # A place in a row is an occurrence: row numbers and places are put into one long each round anew.
        numbered = materialize(pairs.withColumn("occurrence", F.monotonically_increasing_id()).withColumn("left", ((F.col("left") + 1) / 2).cast("int")))
        rows = materialize(_named(numbered.withColumn("length", F.col("blocks")), ["length", "first", "second"]))
        done = done.unionByName(rows.filter("left = 1").drop("left", "place"))
        rows = rows.filter("left > 1")
    return done.select("row", "id", "n_chars", F.lower(F.hex("sha")).alias("text_sha256"), "blocks", "name")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Of equal texts the row with the most code points in the original text stays, then the smallest id (a null
    id is the largest), then the first row of the input: repeated rows count, and one of them is kept. A null
    text is an empty one. An empty table gives no rows. Other columns are not read. ``row_col`` names a column
    for the row numbers of ``identities``.
    """
    named = identities(docs, id_col, text_col)
    best = F.min(F.struct(-F.col("n_chars"), F.col("id").isNull(), F.col("id").alias("id"), F.col("row").alias("row"))).alias("best")
    groups = named.groupBy("blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), best)
    groups = groups.select(F.col("blocks").alias("_blocks"), F.col("name").alias("_name"), "group_size", "best")
    joined = named.hint("merge").join(materialize(groups), (F.col("blocks") == F.col("_blocks")) & (F.col("name") == F.col("_name")))
    return joined.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256",
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def drop_exact(docs: DataFrame, **columns) -> DataFrame:
    """The rows that stay, columns and their names as they are."""
    row = free_name(docs.columns, "_exact_row")
    dropped = materialize(exact_groups(docs, row_col=row, **columns).filter("not kept").select(row))
    return without_rows(docs.withColumn(row, F.monotonically_increasing_id()), row, dropped)
