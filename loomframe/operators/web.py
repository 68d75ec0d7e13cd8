"""Links out of raw HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions.scalar import file_extension, file_stem, site_root

# How an anchor and its attributes look.
ANCHOR = r"(?is)(<a\s[^>]*>(?:(?!<a\s|</a>).)*)"
OPEN_TAG = r"(?is)^(<a\s[^>]*>)"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag, quoted either way or bare; empty when absent."""
    forms = ('"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)""")
    values = [F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*{form}", 1) for form in forms]
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def resolved(target: Column, url: Column | str) -> Column:
    """A link made absolute: as it is, from the site's root, or from the page's folder."""
    page = F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"[?#].*$", "")
    folder = F.regexp_extract(page, r"^([a-z]+://[^/]+(?:/.*)?/)", 1)
    folder = F.when(folder != "", folder).otherwise(F.concat(site_root(page), F.lit("/")))
    near = F.when(target.startswith("/"), F.concat(site_root(page), target)).otherwise(F.concat(folder, target))
    return F.when(target.rlike("^[a-z]+://"), target).otherwise(near)


def anchors(df: DataFrame, key: str, html: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., pos, tag, body) of every anchor in page order; a body ends at ``</a>`` or the next anchor."""
    found = df.select(key, *keep, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1))).alias("pos", "a"))
    return found.select(
        key,
        *keep,
        "pos",
        F.regexp_extract("a", OPEN_TAG, 1).alias("tag"),
        F.regexp_replace("a", OPEN_TAG, "").alias("body"),
    )


def page_links(df: DataFrame, key: str, url: str, html: str, pattern: str, source: str = "href") -> DataFrame:
    """(key, pos, link) of anchors whose href matches and is not ``#``, made absolute.

    ``source`` names the attribute the link is read from; gif files are left out.
    """
    found = anchors(df, key, html, (url,)).withColumn("href", attribute(F.col("tag"), "href"))
    kept = found.filter(F.col("href").rlike(pattern) & (F.col("href") != "#"))
    target = attribute(F.col("tag"), source)
    return kept.select(key, "pos", resolved(target, url).alias("link")).filter(F.lower(file_extension("link")) != "gif")


def distinct_by_stem(links: DataFrame, key: str) -> DataFrame:
    """One link per file stem: the first in (key, pos) order."""
    return links.withColumn("stem", file_stem("link")).groupBy("stem").agg(
        F.min(F.struct(key, "pos", "link")).alias("first")
    ).select("stem", "first.*")


def next_page(df: DataFrame, key: str, html: str, class_pattern: str, text: str) -> DataFrame:
    """(key, next_link): href of the first anchor with a matching class and exactly the given text."""
    found = anchors(df, key, html).filter(attribute(F.col("tag"), "class").rlike(class_pattern) & (F.col("body") == text))
    return found.groupBy(key).agg(F.min_by(attribute(F.col("tag"), "href"), "pos").alias("next_link"))
