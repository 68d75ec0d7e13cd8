"""Small column expressions: names, numbers, URLs, dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, functions as F


def split_parts(c: Column | str, delimiter: str, names: Sequence[str]) -> list[Column]:
    """Fields of a delimited string as named columns, null where missing."""
    parts = F.split(c, delimiter)
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def padded_entries(c: Column, width: int, fill: Any = "") -> list[Column]:
    """The first ``width`` list entries as columns, ``fill`` beyond the end."""
    return [F.coalesce(F.get(c, F.lit(i)), F.lit(fill)) for i in range(width)]


def padded_list(c: Column, width: Column, fill: Any = "") -> Column:
    """List entries filled up to ``width`` with ``fill``; no entry is dropped where ``width`` is the longest list."""
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(c, i), F.lit(fill)))


def site_root(url: Column | str) -> Column:
    return F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)


def url_path(url: Column | str) -> Column:
    """Path of a URL without query and fragment."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(bare, r"^[a-z]+://[^/]+", "")


def file_name(url: Column | str) -> Column:
    return F.substring_index(url_path(url), "/", -1)


def file_stem(url: Column | str) -> Column:
    """File name up to its first dot."""
    return F.substring_index(file_name(url), ".", 1)


def file_extension(url: Column | str) -> Column:
    """Second dot-separated piece of the file name, empty when there is none."""
    return F.coalesce(F.get(F.split(file_name(url), r"\."), F.lit(1)), F.lit(""))


def name_number(name: Column | str, position: int = 1) -> Column:
    """Number at a dash-separated position of a name such as ``sample-12-1``."""
    return F.get(F.split(name, "-"), F.lit(position)).try_cast("int")


def two_digits(n: Column) -> Column:
    """Zero-padded to two digits; longer numbers keep their length."""
    return F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def is_numeric(c: Column | str) -> Column:
    """Digits only once one dot is removed."""
    column = F.col(c) if isinstance(c, str) else c
    return column.rlike(r"^[0-9]*\.?[0-9]*$") & column.rlike("[0-9]")


def year_prefix(date_text: Column | str) -> Column:
    return F.substring(date_text, 1, 4)


def lookup_constant(key: Column | str, table: Mapping[Any, Any], default: Any) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(key) if isinstance(key, str) else key), F.lit(default))


def argmax(values: Column) -> Column:
    """0-based index of the first largest array entry."""
    return F.array_position(values, F.array_max(values)) - 1


def hex_bytes(data: Column | str) -> Column:
    """Two lower-case hex digits per byte."""
    return F.lower(F.hex(data))


def percent_text(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)
