"""Lengths written by hand: the number, the unit if one is stated, and what a text says about a structure's height."""

from __future__ import annotations

import re

#: Metres of one unit. The order gives the numbers of the hidden states in operators.units.
METRES = {"m": 1.0, "ft": 0.3048, "ten_ft": 3.048, "hundred_ft": 30.48, "km": 1000.0, "yd": 0.9144, "in": 0.0254}
UNITS = list(METRES)

#: How units are written.
SPELLINGS = {
    "ft": r"feet|foot|ft|['’′]",
    "in": r"inches|inch|in|[\"”″]",
    "yd": r"yards?|yds?",
    "km": r"kilomet(?:re|er)s?|kms?",
    "m": r"met(?:re|er)s?|m",
}
#: Numbers in words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

_NUM = r"\d{1,3}(?:[,   ]\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?"
_WORD = rf"(?:(?:{'|'.join(_TENS)})(?:[- ](?:{'|'.join(_ONES[1:10])}))?|{'|'.join(sorted(_ONES, key=len, reverse=True))}|hundred)"
_UNIT = "|".join(f"(?P<{u}>{p})" for u, p in SPELLINGS.items())
_FEET_INCHES = re.compile(rf"(?<![\w.,])(\d+)\s*-?(?:{SPELLINGS['ft']})\.?\s*(\d+(?:\.\d+)?)\s*(?:{SPELLINGS['in']})(?![a-z0-9])", re.I)
_AMOUNT = re.compile(rf"(?<![\w.,])(?P<num>{_NUM}|{_WORD}\b)[\s-]*(?P<hundred>hundred\b)?[\s-]*(?:{_UNIT})(?![a-z0-9])", re.I)
_BARE = re.compile(rf"^\W*(?P<num>{_NUM}|{_WORD})\s*$", re.I)
_UNIT_ONLY = re.compile(rf"^\W*(?:{_UNIT})(?![a-z0-9])", re.I)


def number(text: str) -> float:
    t = text.lower().strip()
    if t[0].isdigit():
        if re.fullmatch(r"\d{1,3}(?:[,   ]\d{3})+(?:\.\d+)?", t):
            return float(re.sub(r"[^\d.]", "", t))
        return float(t.replace(",", "."))
    total = 0
    for w in re.split(r"[- ]", t):
        total += _ONES.index(w) if w in _ONES else 10 * (_TENS.index(w) + 2) if w in _TENS else 100
    return float(total)


def unit(text: str | None) -> str | None:
    """The unit that a text such as "ft asl" names, if any."""
    m = _UNIT_ONLY.match(text) if text else None
    return m.lastgroup if m else None


def amount(text: str | None) -> tuple[float, str | None] | None:
    """(number, unit or None) of a text that holds one length; None if it holds none."""
    if text is None or not text.strip():
        return None
    if m := _FEET_INCHES.search(text):
        return float(m[1]) + float(m[2]) / 12, "ft"
    if m := _AMOUNT.search(text):
        u = m.lastgroup
        if m["hundred"]:
            return (number(m["num"]), "hundred_ft") if u == "ft" else (number(m["num"]) * 100, u)
        return number(m["num"]), u
    if m := _BARE.match(text):
        return number(m["num"]), None
    return None


#: Lengths in a type that aren't the structure's height: sizes of cabs, floors and walkways.
_NOT_HEIGHT = re.compile(
    r"\d+(?:\.\d+)?\s*(?:ft|m|')?\s*[x×]\s*\d+(?:\.\d+)?(?:\s*(?:ft|feet|m|metres|meters|')\b)?(?:\s*(?:cab|floor|deck|room))?"
    rf"|(?:{_NUM})[\s-]*(?:{'|'.join(SPELLINGS.values())})\.?[\s-]*(?:wide\s+)?(?:catwalk|walkway|walk|floor|deck|rail|railing|balcony|porch|gallery)\b",
    re.I,
)


def height_in(text: str | None) -> tuple[float, str] | None:
    """(number, unit) of the height that a type such as "42-ft open platform, 7 ft catwalk round it" states."""
    if not text:
        return None
    got = amount(_NOT_HEIGHT.sub(" ; ", text.replace("_", " ")))
    return got if got and got[1] else None
