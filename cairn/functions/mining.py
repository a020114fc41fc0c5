"""A few facts out of stories, as Columns: years, feet, urls. See prose for what rentals and registers state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_built_year(text: Column) -> Column:
    """The last year that follows a word for building."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:built|rebuilt|begun|erected)\b[^.0-9]{0,40}\b(1[89]\d\d|20[0-2]\d)\b"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).cast("int")


def feet(text: Column) -> Column:
    """The first amount in feet, thousands marked or not."""
    got = F.regexp_extract(text, r"(?i)\b(\d{1,3}(?:,\d{3})+|\d+) ?(?:feet|ft)\b", 1)
    return F.nullif(F.replace(got, F.lit(","), F.lit("")), F.lit("")).cast("int")


def footnote_urls(text: Column) -> Column:
    """Distinct urls of a story's footnotes, in order."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\[\^\d+\]:.*?(https?://\S+)"), F.lit(1))
    return F.array_sort(F.array_distinct(lines))
