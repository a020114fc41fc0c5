"""Designs of structures that texts name: ordered patterns, negated mentions left out."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Designs and the wordings that name them, in the order they are listed.
_END = r"\b(?![.-]\d)"
DESIGNS: dict[str, str] = {
    "l4": rf"\bL[\s.-]?4{_END}|\bplan\s+80\b(?![\s.-]?[A-Z0-9])|\bB-?420[0-9]\b",
    "l5": rf"\bL[\s.-]?5{_END}",
    "l6": rf"\bL[\s.-]?6{_END}",
    "l2": rf"\bL-?2{_END}",
    "l20": rf"\bL-?20{_END}",
    "r6": rf"\bR[\s.-]?6{_END}(?!\s+to\s+R\d)|\bregion\s*6\s+flat(?:[\s-]?top)?\b|\bplan\s+80[\s-]?[AB]\b|\bB-?430[0-9]\b",
    "d6": rf"\bD[\s.-]?6{_END}",
    "d1": rf"\bD[\s.-]?1{_END}",
    "cupola": r"\bcupola[\s-]+(?:house|cabin|lookout|style)\b|\b(?:with|and|log\s+cabin|has)\s+(?:an?\s+)?(?:glass(?:ed)?\s+|framed\s+)?cupola\b",
    "bc201": rf"\bBC-?201{_END}",
    "bc301": rf"\bBC-?(?:30[12]|3){_END}",
    "r6_timber_towers": rf"\bCT-?[1-6]{_END}|\bTT-?1{_END}",
    "cl100": rf"\bCL-?(?:10[0-9]|30|16){_END}",
    "aermotor_ls40": r"\bLS-?40\b",
    "aermotor_mc39": r"\bMC-?39\b",
    "aermotor": r"\bae(?:r|ro)motor\b|\b(?:MC|LS|LX|LL|MI)-?\d{2,3}\b",
    "cdf_809r": r"\b809-?RA?\b",
}
#: Designs that say `cupola` already; words that take a mention back; codes of variants.
HAVE_CUPOLA = ("d1", "d6", "l2", "l6", "r1_cupola_towers")
NEGATION = (
    r"\b(?:predat(?:es|ed|ing)|unlike|not\s+an?|rather\s+than|instead\s+of|other\s+than|similar\s+to|reminiscent\s+of|resembl(?:es|ed|ing)|compared\s+(?:to|with)|as\s+opposed\s+to|"
    r"(?:precursor|predecessor|forerunner|successor)\s+(?:to|of))\b[^.;:,()]{0,30}$"
)
CODES = {"aermotor": r"\b(MC|LS|LX|LL|MI)-?(\d{2,3})\b", "r6_timber_towers": r"\b(CT|TT)-?([1-6])\b", "cl100": r"\b(CL)-?(10[0-9]|30|16)\b", "bc301": r"\b(BC)-?(30[12])\b"}

MENTIONS = "array<struct<design: string, words: string>>"


def mentions(text: Column, designs: Mapping[str, str] = DESIGNS) -> Column:
    """ARRAY<STRUCT(design, words)>: every design a text names, in the order of the designs, each by its first mention that isn't taken back.

    The words alone name the design again. A general cupola isn't listed beside a design that has one. null gives none.
    """
    compiled = [(d, re.compile(p, re.I)) for d, p in designs.items()]
    negated = re.compile(NEGATION, re.I)

    def of(t: str) -> list[dict[str, str]]:
        first = {d: next((m.group(0) for m in p.finditer(t) if not negated.search(t, max(0, m.start() - 120), m.start())), None) for d, p in compiled}
        found = {d: " ".join(w.split()) for d, w in first.items() if w is not None}
        if any(d in found for d in HAVE_CUPOLA):
            found.pop("cupola", None)
        return [{"design": d, "words": w} for d, w in found.items()]

    @F.pandas_udf(MENTIONS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: of(t) if isinstance(t, str) else [])

    return run(text)


def variant_codes(text: Column, design: str) -> Column:
    """Codes of one design's variants as MC-39, each once, in the order of the text."""
    pattern = CODES[design]
    whole = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0))
    return F.array_distinct(F.transform(whole, lambda m: F.upper(F.concat(F.regexp_extract(m, f"(?i){pattern}", 1), F.lit("-"), F.regexp_extract(m, f"(?i){pattern}", 2)))))


def with_families(ids: Column, family: Mapping[str, str]) -> Column:
    """The ids and their families' heads that aren't among them, in order."""
    if not family:
        return ids
    heads = F.create_map(*[F.lit(x) for kv in family.items() for x in kv])
    return F.array_distinct(F.concat(ids, F.array_compact(F.transform(ids, lambda d: F.try_element_at(heads, d)))))


def most_specific(ids: Column, family: Mapping[str, str]) -> Column:
    """The ids without heads of families of which a member is there."""
    if not family:
        return ids
    heads = F.create_map(*[F.lit(x) for kv in family.items() for x in kv])
    return F.filter(ids, lambda d: ~F.exists(ids, lambda o: (o != d) & F.coalesce(F.try_element_at(heads, o) == d, F.lit(False))))


def pair(ids: Column, parts: Mapping[str, Sequence[str]]) -> Column:
    """STRUCT(cab, tower, whole) of the one structure the designs make, null if they make several. parts: designs that are a `cab` (or house), a `tower`, a `whole`."""
    of = lambda part: F.filter(ids, lambda d: d.isin(*parts.get(part, ("",))))
    cabs, towers, wholes = of("cab"), of("tower"), of("whole")
    alone = F.when((F.size(wholes) == 1) & (F.size(cabs) + F.size(towers) == 0), 1).when((F.size(wholes) == 0) & (F.size(cabs) <= 1) & (F.size(towers) <= 1) & (F.size(cabs) + F.size(towers) > 0), 1)
    return F.when(alone == 1, F.struct(F.get(cabs, F.lit(0)).alias("cab"), F.get(towers, F.lit(0)).alias("tower"), F.get(wholes, F.lit(0)).alias("whole")))
