"""What a typed name of a lookout says: its own word, its kind of place, its qualifiers."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from cairn.llm.edits import transposing

#: Kinds of places and their abbreviations.
KINDS = {
    "mountain": "mountain mtn mt mount mntn mtns", "peak": "peak pk pks", "ridge": "ridge rdg rdge rg", "point": "point pt pnt", "butte": "butte bte btte but", "hill": "hill hl hls",
    "knob": "knob knb kb", "bluff": "bluff bluffs blf blff", "dome": "dome dm", "summit": "summit smt summ sum smmt", "creek": "creek crk ck cr", "rock": "rock rk", "lake": "lake lk",
}
#: Qualifiers that tell lookouts of one name apart.
QUALIFIERS = {
    "upper": "upper up upr uppr", "lower": "lower low lwr lowr lr", "north": "north n no nth", "south": "south s so sth", "east": "east e", "west": "west w", "little": "little ltl lil ltle lttl",
    "big": "big bg", "saint": "saint st ste", "fort": "fort ft", "twin": "twin twn", "old": "old ol", "new": "new nw", "middle": "middle mid mdl",
}
#: Words of by-names, such as "Granny X", "Old X's Nest", "The X Chair".
BYNAMES = "granny nest chair sentinel jack smoky camp".split()
#: Words that any lookout may have in its name.
COMMON = set("lookout lookouts lkt lo loo fire tower twr towers the of and at a an site card unnamed name unknown no-name nameless station".split())

_KIND = {a: k for k, v in KINDS.items() for a in v.split()}
_QUALIFIER = {a: k for k, v in QUALIFIERS.items() for a in v.split()}
_LONG = [*KINDS, *QUALIFIERS, *BYNAMES, "lookout", "tower"]


@dataclass(frozen=True)
class Name:
    """core: the lookout's own words as one, "" if there are none. kind: of the place, a by-name's word, or "". qualifiers: in
    order. own: its own words as typed; names whose words run together differently are equal."""

    core: str
    kind: str
    qualifiers: tuple[str, ...]
    own: tuple[str, ...] = field(default=(), compare=False)


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def parse(text: str | None) -> Name:
    """The parts of a name. A name that could stand for any lookout has no core."""
    if not text:
        return Name("", "", ())
    t = fold(text).replace("_", " ").replace("’", "'")
    t = re.sub(r"\[[^\]]*\]", " ", t)
    t = re.sub(r"\bf\.\s?t\.?(?![a-z])|\bl\.\s?o\.?(?![a-z])", " lookout ", t)
    t = re.sub(r"'s(?=[a-z]{3})", " ", t)  # a possessive run into the next word
    t = re.sub(r"(?<=[a-z])'s\b", "", t)
    t = re.sub(r"(?<=[a-z])-(?=[a-z])|(?<=[a-z])['.](?=[a-z])", "", t)
    tokens = re.findall(r"[a-z0-9]+", t)
    kinds, qualifiers, byname, own = [], [], "", []
    for at, w in enumerate(tokens):
        if w == "ft" and at == len(tokens) - 1 and at:
            continue
        if w in COMMON:
            continue
        if w in BYNAMES:
            byname = w
        elif w in _QUALIFIER:
            qualifiers.append(_QUALIFIER[w])
        elif w in _KIND:
            kinds.append(_KIND[w])
        elif not w.isdigit():
            own.append(w)
    for w in [w for w in own if len(own) > 1 and len(w) > 4]:
        # a slip in a known word, if another word is left to be the lookout's own
        if len(own) > 1 and (known := next((k for k in _LONG if len(k) > 4 and abs(len(k) - len(w)) < 2 and transposing(w, k) == 1), None)):
            own.remove(w)
            if known in KINDS:
                kinds.append(known)
            elif known in QUALIFIERS:
                qualifiers.append(known)
            elif known in BYNAMES:
                byname = known
    if len(own) == 1 or not own:
        own = _unjoin("".join(own), kinds)
    core = "".join(own)
    if byname in ("nest",) and "old" in qualifiers:
        qualifiers.remove("old")
    return Name(core, byname or (kinds[-1] if kinds else ""), tuple(sorted(set(qualifiers))), tuple(own))


def _unjoin(word: str, kinds: list[str]) -> list[str]:
    """A word with a kind of place or a lookout word run into its end."""
    for tail in ("lookouttower", "firelookout", "firetower", "lookout", "tower"):
        if word.endswith(tail) and len(word) - len(tail) >= 4:
            word = word[: -len(tail)]
    if not kinds:
        for long, kind in sorted(_KIND.items(), key=lambda x: -len(x[0])):
            if len(long) >= 3 and kind != "rock" and word.endswith(long) and len(word) - len(long) >= 5:
                kinds.append(kind)
                return [word[: -len(long)]]
    return [word] if word else []


def deletes(word: str, most: int) -> set[str]:
    """The word and what is left after deleting up to `most` of its letters."""
    out = edge = {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out = out | edge
    return out


def bones(word: str) -> str:
    """First letter and consonants, without repeats: what an abbreviation without vowels keeps."""
    kept = word[:1] + "".join(c for c in word[1:] if c not in "aeiouy")
    return "".join(c for i, c in enumerate(kept) if i == 0 or c != kept[i - 1])


def slips(word: str) -> int:
    """Most edits by which another spelling of a lookout's own word may differ."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def abbreviates(a: str, b: str) -> bool:
    """Is one the other's abbreviation: the same first letter, its letters in order in the longer, at least two fewer."""
    short, long = sorted((a, b), key=len)
    letters = iter(long)
    return len(long) - len(short) >= 2 and short[:1] == long[:1] and all(c in letters for c in short)


def token_cost(a: str, b: str) -> float:
    """What it costs to read one token as the other: edits, less for an initial or an abbreviation."""
    if a == b:
        return 0.0
    short, long = sorted((a, b), key=len)
    if len(short) == 1 and short == long[:1]:
        return 0.5
    if abbreviates(a, b):
        return 0.8
    d = transposing(a, b)
    return float(d) if d <= max(slips(long), 1) else 9.0


def align(a: list[str], b: list[str], alone: float = 2.5) -> float:
    """Least total cost of assigning the tokens of a to different tokens of b; a token left over costs `alone`."""
    best = {0: 0.0}
    for x in a:
        step: dict[int, float] = {}
        for mask, c in best.items():
            step[mask] = min(step.get(mask, 1e9), c + alone)
            for j, y in enumerate(b):
                if not mask >> j & 1:
                    m = mask | 1 << j
                    step[m] = min(step.get(m, 1e9), c + token_cost(x, y))
        best = step
    return min(c + alone * (len(b) - m.bit_count()) for m, c in best.items())
