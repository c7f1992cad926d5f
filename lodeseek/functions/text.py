"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without Unicode blanks at either end. Texts that begin and end with printable ASCII, which most do, aren't searched for blanks."""
    return F.when(c.rlike("^[!-~](?:.*[!-~])?\\z"), c).otherwise(F.regexp_replace(c, "(?U)^\\s+|\\s+$", ""))


def present(c: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(c, F.lit(""))


def cut(c: Column, n: int, more: str = "...") -> Column:
    """The first n characters, with a mark if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(more))).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits; a run of Han characters becomes its overlapping pairs."""
    low = F.lower(F.coalesce(c, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit("\\p{IsHan}+|[\\p{L}\\p{N}&&[^\\p{IsHan}]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    cut_up = F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^\\p{IsHan}") & (F.length(r) > 1), pairs(r)).otherwise(F.array(r))))
    return F.when(low.rlike("\\p{IsHan}"), cut_up).otherwise(F.regexp_extract_all(low, F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))


def keywords(c: Column) -> Column:
    """Parts between runs of semicolons and commas of either width, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[；;,，]+"), strip), lambda x: x != "")


def slug(c: Column) -> Column:
    """Trimmed and lower-case, with every character but a-z, 0-9 and _ as _."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]", "_")


def valid_slug(c: Column) -> Column:
    return c.rlike("^[a-z0-9_]{2,50}$")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]*)$", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), "(?<=.)\\.[^.]*$", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), "(?<=.)\\.([^.]*)$", 1))
