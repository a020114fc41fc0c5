"""Freely typed values mapped to the closest entry of a reference list, or reported as having none.

The words of all entries are held in a BK-tree under the Levenshtein metric. A value is cut into words (marks, fillers and
notes of the typist dropped); each word finds every entry word within its threshold, and an entry is scored by the best
assignment of its words to the value's. A small list is broadcast; a larger one is cut into shards, each shard gives its
winner, and the winners are merged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.edits import BKTree, transposing

#: Abbreviations and other words for a word, by the word they stand for.
SHORT = {
    "federal": "fed", "timber": "tmbr timb timbre", "service": "svc serv ser srv", "bureau": "bureaux bur", "office": "ofc off offices", "territorial": "terr territory",
    "wildfire": "wf", "continental": "cont contl", "administration": "admin adm admn", "authority": "auth", "northern": "n no north", "railway": "rwy ry rail railroad",
    "company": "co comp", "lookout": "lkt lo l.o", "preservation": "pres", "society": "soc", "united": "utd", "owners": "owner", "association": "assoc assn", "corporation": "corp",
    "interstate": "inter", "conservation": "cons conserv", "tribal": "trbl", "forestry": "forsty forestery frstry", "council": "cncl", "research": "rsch res", "station": "sta stn", "coastal": "coast",
    "academy": "acad", "geography": "geog", "mountain": "mtn mt", "volunteer": "vol volunteers", "league": "lg", "department": "dept dpt deptt dep", "parks": "prks pks park",
    "commission": "comm commn", "highland": "hld hghld", "watershed": "wshed", "signal": "sig", "survey": "surv", "tower": "twr tow", "enclosed": "enc encl", "platform": "pltfm ptfm platf plat",
    "ground": "gr grnd", "cabin": "cbn cab", "two": "2", "three": "3", "story": "storey storeys stories sty", "house": "hse home houses homes", "rooftop": "roof", "mobile": "mob", "trailer": "trlr",
    "summit": "summ sum smt", "board": "brd", "frame": "frm", "guyed": "guy", "standing": "stdg stands stand std", "removed": "rmvd rem", "remaining": "remain remains", "relocated": "reloc moved",
    "unknown": "unk unkn", "restoration": "restor rest restoring restored", "burned": "burnt", "closed": "clsd", "proposed": "prop", "replica": "repl", "season": "seas", "map": "mp",
}
#: Words that say nothing about which entry is meant.
FILLER = set("the of a an on at to for in and was is still only right entirely now site high height".split())
#: Notes that typists add behind a value.
_NOTE = re.compile(
    r"\([^)]*\)|\bw/.*$|\bno\.?\s*\d+\s*$|,?\s*\d+\s*[x×]\s*\d+.*$|,\s*\d+(?:\.\d+)?[ -]?(?:ft|m)\b.*(?:walk|floor|deck).*$|;.*$|,\s*plan\s+\d+.*$|,\s*unit\s+\d+\s*$|,\s*(?:north|south|east|west)\s+zone\s*$"
    r"|\s[-/]\s*(?:hq|fire desk|verified on foot)\s*$|,\s*per warden\s*$|\bas of \d+\s*$|\s-\s*[^-]*\bhigh\b",
    re.I,
)
#: A length before or behind a type: "42-ft", "fourteen feet", "12' 6\"".
_LENGTH = re.compile(
    r"""(?<![\w])(?:\d+(?:[.,]\d+)?|(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:-\w+)?|ten|eleven|twelve|\w+teen)[\s-]*(?:feet|foot|ft|['’′]|inches|inch|in\.|["”″]|yards?|yds?|met(?:re|er)s?|m)(?![a-z])\.?(?:\s*\d+\s*(?:in|["”″]))?""",
    re.I,
)
#: What a word of an entry costs if nothing in the value stands for it, and a word of the value that stands for none.
MISSING, EXTRA, SHORTENED = 3.0, 1.5, 0.25
BROADCAST_ENTRIES, BROADCAST_BYTES = 20_000, 16_000_000
SHARD_ENTRIES, GROUP_VALUES = 5_000, 50_000
MOST_OTHER = 20_000


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def words(text: str) -> list[str]:
    """The words of a value that may stand for an entry's."""
    t = fold(text).replace("_", " ")
    t = _LENGTH.sub(" ", _NOTE.sub(" ", t))
    t = re.sub(r"\bfor\.", " forestry ", t)
    t = re.sub(r"(?<=\w)['’.](?=\w)", "", t)
    return [w for w in re.findall(r"[^\W_]+", re.sub(r"(\d)(?=[a-z])|(?<=[a-z])(\d)", r"\1\2 ", t)) if w not in FILLER]


def threshold(word: str) -> int:
    """Most edits by which a word may differ from an entry's."""
    n = len(word)
    return 0 if n < 3 else 1 if n < 5 else 2 if n < 8 else 3


def _limit(size: int) -> float:
    """Most that a match with an entry of so many letters may cost."""
    return max(0.34 * size, 1.0)


def shortens(short: str, word: str) -> bool:
    """Is it an abbreviation: same first letter, its letters in order in the word, at least three of them."""
    if not 3 <= len(short) <= len(word) - 2 or short[0] != word[0]:
        return False
    it = iter(word)
    return all(c in it for c in short)


class Matcher:
    """Entries (code, label words...) of one list, searched through a BK-tree of their words."""

    def __init__(self, entries: list[tuple[str, str]], also: dict[str, list[str]] | None = None):
        """also: other names for a word of the labels (say, a region's code for its name)."""
        self.entries: list[tuple[str, list[str]]] = [(code, words(label) or [fold(label)]) for code, label in sorted(entries)]
        self.by_word: dict[str, set[int]] = defaultdict(set)
        self.short: dict[str, set[str]] = defaultdict(set)
        self.tree = BKTree()
        for i, (_, ws) in enumerate(self.entries):
            for w in ws:
                self.by_word[w].add(i)
        self.whole: dict[str, int] = {}
        self.whole_tree = BKTree()
        for i, (_, ws) in enumerate(self.entries):
            if self.whole.setdefault("".join(ws), i) == i:
                self.whole_tree.add("".join(ws))
        full = {w: set(SHORT.get(w, "").split()) | set((also or {}).get(w, [])) for w in self.by_word}
        for w in sorted(self.by_word):
            self.tree.add(w)
            for s in full[w]:
                self.short[fold(s)].add(w)
                if len(s) > 3:
                    self.tree.add(fold(s))
        self.longest = max(map(len, self.whole), default=0)
        self.known: dict[str, dict[str, float]] = {}

    def near(self, word: str) -> dict[str, float]:
        """Cost of each entry word that the word may stand for."""
        if word in self.known:
            return self.known[word]
        cost: dict[str, float] = {}

        def put(w: str, c: float) -> None:
            if w in self.by_word:
                cost[w] = min(cost.get(w, c), c)
            for full in self.short.get(w, ()):
                cost[full] = min(cost.get(full, c + 0.01), c + 0.01)

        put(word, 0.0)
        most = threshold(word)
        for w, d in self.tree.within(word, most + 1 if most else 0):  # a swap is two edits of the metric, but one slip
            if d and (swapped := transposing(word, w)) <= most:
                put(w, float(swapped))
        if len(word) > 2:
            for w in self.by_word:
                if w not in cost and shortens(word, w):
                    put(w, SHORTENED + 0.02 * (len(w) - len(word)))
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = cost
        return cost

    def best(self, value: str) -> tuple[str, float] | None:
        """(code, cost) of the closest entry, None if none is close enough; ties go to the smallest code."""
        found = self.by_words(value)
        return found or self._whole(value)

    def by_words(self, value: str) -> tuple[str, float] | None:
        """best(), by words alone."""
        ws = words(value)
        if not ws:
            return None
        found = self._score(ws, None)
        if found is None or found[0] > 1.5:
            for i in range(len(ws) - 1):
                group = [*ws[:i], ws[i] + ws[i + 1], *ws[i + 2 :]]
                if self.near(group[i]):
                    found = self._score(group, found)
        return (found[1], found[0]) if found else None

    def _score(self, ws: list[str], found: tuple[float, str] | None) -> tuple[float, str] | None:
        costs = [self.near(w) for w in ws]
        least: dict[str, float] = {}
        for c in costs:
            for w, d in c.items():
                least[w] = min(least.get(w, d), d)
        for i in {i for w in least for i in self.by_word[w]}:
            code, entry = self.entries[i]
            most = min(_limit(sum(map(len, entry))), found[0] if found else 1e9)
            if sum(least.get(w, MISSING + 0.3 * len(w)) for w in entry) <= most:
                total = self._assign(entry, costs, ws)
                if total <= most and (found is None or (total, code) < found):
                    found = (total, code)
        return found

    def _whole(self, value: str) -> tuple[str, float] | None:
        """By all letters of the value at once, for values whose words run together."""
        letters = re.sub(r"[\W\d_]+", "", _LENGTH.sub(" ", _NOTE.sub(" ", fold(value))))
        tried = [letters, *(letters[len(f) :] for f in FILLER if len(f) > 2 and letters.startswith(f))]
        got = []
        for t in tried:
            if t and len(t) - len(t) // 6 <= self.longest:  # else every entry differs by more letters
                got += [(float(d), self.entries[self.whole[w]][0]) for w, d in self.whole_tree.within(t, len(t) // 6)]
        return (min(got)[1], min(got)[0]) if got else None

    @staticmethod
    def _assign(entry: list[str], costs: list[dict[str, float]], group: list[str]) -> float:
        """Least total cost of assigning the entry's words to different words of the value (dynamic programme over subsets).

        Only words that some word of the entry is near to take part, so a long value is no dearer than its near words.
        """
        alike = [any(w in near for w in entry) for near in costs]
        idle = sum(EXTRA * (len(g) > 1) + 0.2 for g, a in zip(group, alike, strict=True) if not a)
        costs, group = [c for c, a in zip(costs, alike, strict=True) if a], [g for g, a in zip(group, alike, strict=True) if a]
        best = {0: idle}
        for w in entry:
            step: dict[int, float] = {}
            for mask, c in best.items():
                skip = c + MISSING + 0.3 * len(w)
                if skip < step.get(mask, 1e9):
                    step[mask] = skip
                for j, near in enumerate(costs):
                    if not mask >> j & 1 and w in near:
                        m, d = mask | 1 << j, c + near[w]
                        if d < step.get(m, 1e9):
                            step[m] = d
            best = step
        return min(c + sum(EXTRA * (len(g) > 1) + 0.2 for j, g in enumerate(group) if not m >> j & 1) for m, c in best.items())


def map_values(values: DataFrame, reference: DataFrame, also: DataFrame | None = None, none: str = "none") -> DataFrame:
    """(record_id, field, ref_code) of each row of values(record_id, field, value) that is neither null nor blank.

    reference(field, ref_code, label); also(word, other): other names for a word of the labels, at most MOST_OTHER (more are an
    error). A value without an entry close enough gets `none`; on a tie the smallest code wins. Repeated rows come out
    repeated; an empty list matches nothing. A list of up to BROADCAST_ENTRIES entries and BROADCAST_BYTES goes to every task,
    and no row is shuffled; each task looks every distinct value up once. A longer list is cut into shards of about
    SHARD_ENTRIES; distinct values, dealt by their number into groups of about GROUP_VALUES, meet every shard, and the
    shards' winners merge: an entry found by words comes before one found by all letters, in whatever shard.
    """
    values = values.where(F.col("value").isNotNull() & (F.length(F.trim(F.regexp_replace("value", r"[\s ]+", " "))) > 0)).select("record_id", "field", "value")
    other: dict[str, list[str]] = defaultdict(list)
    for r in also.limit(MOST_OTHER + 1).collect() if also is not None else ():
        other[fold(r["word"])].append(r["other"])
    if sum(map(len, other.values())) > MOST_OTHER:
        raise ValueError(f"more than {MOST_OTHER} other names of words")
    other = dict(other)
    size = reference.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("label") + F.octet_length("ref_code")), F.lit(0)).alias("b")).first()
    if size["n"] <= BROADCAST_ENTRIES and size["b"] <= BROADCAST_BYTES:
        lists: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for r in reference.collect():
            lists[r["field"]].append((r["ref_code"], r["label"]))
        lists = dict(lists)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by_field = {f: Matcher(e, other) for f, e in lists.items()}
            seen: dict[tuple[str, str], str] = {}
            for b in batches:
                out = []
                for key in zip(b["field"], b["value"], strict=True):
                    code = seen.get(key)
                    if code is None:
                        got = by_field[key[0]].best(key[1]) if key[0] in by_field else None
                        if len(seen) > 500_000:
                            seen.clear()
                        code = seen[key] = got[0] if got else none
                    out.append(code)
                yield pd.DataFrame({"record_id": b["record_id"], "field": b["field"], "ref_code": out})

        return values.mapInPandas(run, "record_id bigint, field string, ref_code string")

    distinct = values.select("field", "value").distinct()
    shards, groups = -(-size["n"] // SHARD_ENTRIES), max(1, -(-distinct.count() // GROUP_VALUES))
    entries = reference.withColumn("shard", F.pmod(F.xxhash64("ref_code"), F.lit(shards))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = distinct.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))

    def search(texts: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        m = Matcher(list(zip(listed["ref_code"], listed["label"], strict=True)), other)
        rows = []
        for f, v in zip(texts["field"], texts["value"], strict=True):
            named = m.by_words(v)
            if got := named or m._whole(v):
                rows.append((f, v, named is None, got[1], got[0]))
        return pd.DataFrame(rows, columns=["field", "value", "by_letters", "cost", "ref_code"])

    keys = ["field", "shard", "part"]
    met = asked.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(search, "field string, value string, by_letters boolean, cost double, ref_code string")
    winners = met.groupBy("field", "value").agg(F.min(F.struct("by_letters", "cost", "ref_code")).alias("w"))
    return values.join(winners, ["field", "value"], "left").select("record_id", "field", F.coalesce("w.ref_code", F.lit(none)).alias("ref_code"))
