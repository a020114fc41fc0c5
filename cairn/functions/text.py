"""Text scalars. Everything that Spark's own functions can say stays in the JVM."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accented letters of the Latin blocks and what is left without the accent, derived from the Unicode database.
_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
_FROM, _TO = ("".join(x) for x in zip(*_PAIRS, strict=True))


def unaccent(c: Column) -> Column:
    """Latin letters without accents; ligatures and other letters stay."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"[\x{0300}-\x{036f}]", "")


def fold(c: Column) -> Column:
    """For comparison: without accents, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(unaccent(c)), r"\s+", " "))


def normal(c: Column) -> Column:
    """For search: without accents, lower case, anything but letters and digits a space."""
    return F.trim(F.regexp_replace(F.lower(unaccent(c)), r"[^\p{L}\p{N}]+", " "))


def slug(c: Column) -> Column:
    """For ids: lower case letters and digits, joined by hyphens; `&` is `and`."""
    t = F.replace(F.replace(F.lower(unaccent(c)), F.lit("&amp;"), F.lit(" and ")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"['’]", ""), r"[^a-z0-9]+", "-"), F.lit("-"))


def squash_doubles(c: Column) -> Column:
    """A word typed twice in a row, once."""
    return F.regexp_replace(c, r"\b(\w+) \1\b", "$1")


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def strip_tags(c: Column) -> Column:
    """Text of markup on one line: scripts and styles dropped, tags a space."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_to_text(c: Column) -> Column:
    """Text of markup with its lines: block tags break lines, entities resolved, lines trimmed, one blank line at most."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/table|/ul|/ol)\b[^>]*>", "\n")
    t = _unescape(F.regexp_replace(t, r"(?s)<[^>]*>", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\x{00a0}]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n"))


def sentences(c: Column) -> Column:
    """Split behind a full stop, before a capital or a digit."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda x: x != "")


def quote_form(c: Column) -> Column:
    """For comparing quotations: folded, hyphens at line ends joined, anything but letters and digits a space."""
    t = F.regexp_replace(F.regexp_replace(c, r"[\x{200b}-\x{200d}\x{feff}\x{00ad}]", ""), r"[\x{2010}-\x{2015}]", "-")
    t = F.regexp_replace(t, r"-\s*\n\s*", "")
    return normal(F.replace(F.replace(t, F.lit("œ"), F.lit("oe")), F.lit("ß"), F.lit("ss")))


def shingles(c: Column, n: int) -> Column:
    """Runs of n words."""
    w = F.filter(F.split(c, " "), lambda x: x != "")
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def quote_match(quote: Column, text: Column) -> Column:
    """found: the text holds the quote, or all its parts of three words around an ellipsis or brackets; close: of six words or
    more, 85 % of its different runs of four stand in the text; else missing. Nothing left of a quote is found anywhere; a
    null of either is no answer. The text is in quote_form."""
    parts = F.filter(F.transform(F.split(quote, r"\.\.\.|…|\[[^\]]*\]"), quote_form), lambda p: F.size(F.split(p, " ")) >= 3)
    whole = quote_form(quote)
    runs = F.array_distinct(shingles(whole, 4))
    hits = F.size(F.filter(runs, lambda r: text.contains(r)))
    return (
        F.when(text.contains(whole), "found")
        .when((F.size(parts) > 1) & F.forall(parts, lambda p: text.contains(p)), "found")
        .when((F.size(F.split(whole, " ")) >= 6) & (hits >= 0.85 * F.size(runs)), "close")
        .when(quote.isNotNull() & text.isNotNull(), "missing")
    )


def register_url_key(c: Column) -> Column:
    """A page's identity: host without www and path, without scheme, query, fragment and closing slash."""
    t = F.regexp_replace(F.lower(c), r"^[a-z]+://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(t, r"[?#].*$", ""), r"/+$", "")



def clip(c: Column, most: int = 28) -> Column:
    """Shortened with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)
