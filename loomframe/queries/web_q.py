"""Links from HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import web
from loomframe.registry import query

_LINKS = r"""
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*href="[^"]*"[^>]*>')) AS tag,
             generate_subscripts(regexp_extract_all(html, '<a\s[^>]*href="[^"]*"[^>]*>'), 1) - 1 AS pos FROM pages),
l AS (SELECT page_id, pos::INT AS pos, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || regexp_extract(tag, '\shref="([^"]*)"', 1) AS link
      FROM a WHERE regexp_matches(regexp_extract(tag, '\shref="([^"]*)"', 1), 'e') AND regexp_extract(tag, '\shref="([^"]*)"', 1) <> '#'),
st AS (SELECT *, regexp_extract(regexp_replace(link, '[?#].*$', ''), '([^/]*)$', 1) AS file FROM l)"""


@query("d13_page_links", f"WITH {_LINKS} SELECT page_id, pos, link FROM st WHERE lower(split_part(file, '.', 2)) <> 'gif'")
def page_links(t):
    return web.page_links(t.pages, "page_id", "url", "html", "e")


@query("d13_distinct_links", f"""
WITH {_LINKS} SELECT split_part(file, '.', 1) AS stem, arg_min(page_id, page_id * 100000 + pos) AS page_id,
       arg_min(pos, page_id * 100000 + pos) AS pos, arg_min(link, page_id * 100000 + pos) AS link
FROM st WHERE lower(split_part(file, '.', 2)) <> 'gif' GROUP BY 1""")
def distinct_links(t):
    return web.distinct_by_stem(web.page_links(t.pages, "page_id", "url", "html", "e"), "page_id")


@query("d14_next_page", r"""
SELECT page_id, '/' || regexp_extract(html, '<a href="/[^"]*">([a-z][a-z]*)</a>', 1) AS next_link FROM pages
WHERE regexp_matches(html, '<a href="/[^"]*">([a-z][a-z]*)</a>')""")
def next_page(t):
    # The pages carry no classes, so lower-case menu entries are marked as the navigation links.
    marked = F.regexp_replace("html", '<a href="/([^"]*)">([a-z]+)</a>', '<a class="nav link" href="/$1">next</a>')
    return web.next_page(t.pages.select("page_id", marked.alias("html")), "page_id", "html", "link", "next")
