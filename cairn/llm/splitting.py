"""Texts over a size cut into overlapping pieces at natural boundaries.

Every boundary between two tokens has a strength: end of a paragraph, a line, a sentence, a clause, a word, or none. A sparse
table over the strengths answers each query for the strongest cut of a window in constant time; ties go to the right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe import TextEncoder

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, SYMBOL, NONE, BROKEN = 6, 5, 4, 3, 2, 1, 0, -1
#: Least limit: a character may be four tokens.
LEAST_TOKENS = 8
MOST_LIMITS = 100_000
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_ENDS = np.array([ord(c) for c in ".!?…"], dtype=np.uint32)
_WIDE_ENDS = np.array([ord(c) for c in "。！？"], dtype=np.uint32)
_CLAUSES = np.array([ord(c) for c in ",;:—–|、，；："], dtype=np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"'”’»)]"], dtype=np.uint32)


class RangeMax:
    """Sparse table: the largest value of any window of up to `widest` places."""

    def __init__(self, values: np.ndarray, widest: int):
        self.rows = [values]
        width = 1
        while 2 * width <= min(widest, len(values)):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def largest(self, low: int, high: int) -> int:
        """Of places low to high, both included."""
        k = (high - low + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[low], row[high - (1 << k) + 1]))


def boundaries(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the text, strength) of each of the n + 1 boundaries of tokens of the given sizes in bytes.

    BROKEN: the boundary lies inside a character.
    """
    ends = np.concatenate(([0], np.cumsum(sizes)))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(width)))
    place = np.searchsorted(starts, ends)
    whole = starts[np.minimum(place, len(code))] == ends
    padded = np.concatenate((np.array([0, 0, 0], np.uint32), code, np.array([0], np.uint32)))
    before, second, third, after = (padded[place + k] for k in (2, 1, 0, 3))
    space_before, space_after = np.isin(before, _SPACES), np.isin(after, _SPACES)
    line = (before == 10) & (after != 10) & (after != 13)
    paragraph = line & ((second == 10) | ((second == 13) & (third == 10)))
    end = np.isin(before, _ENDS) | (np.isin(before, _CLOSERS) & np.isin(second, _ENDS))
    sentence = (end & space_after) | np.isin(before, _WIDE_ENDS)
    clause = np.isin(before, _CLAUSES) & space_after
    letter = lambda c: ((c >= 48) & (c <= 57)) | ((c | 32 >= 97) & (c | 32 <= 122)) | (c >= 0xC0)
    symbol = letter(before) != letter(after)
    strength = np.select([~whole, paragraph, line, sentence, clause, space_before | space_after, symbol], [BROKEN, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, SYMBOL], NONE)
    return place, strength


def cuts(strength: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """(first token, end token) of the pieces of a text with len(strength) - 1 tokens.

    Each piece has at most `most` tokens; it ends at the strongest boundary of its second half (of all of it, if no boundary
    there falls between characters), and the next one begins `overlap` tokens before that.
    """
    n = len(strength) - 1
    if n <= most:
        return [(0, n)] if n else []
    if not 0 <= overlap < most // 2:
        raise ValueError(f"an overlap of {overlap} needs a limit of more than {2 * overlap + 1}, not {most}")
    sound = strength.astype(np.int64).copy()
    back = np.arange(n + 1) - overlap
    sound[(back < 0) | (strength[np.maximum(back, 0)] == BROKEN)] = BROKEN
    sound[strength == BROKEN] = BROKEN
    table = RangeMax(sound * (n + 1) + np.arange(n + 1), most + 1)
    out, at = [], 0
    while n - at > most:
        high = at + most
        low = at + max(overlap + 1, most // 2, 1)
        best = table.largest(min(low, high), high)
        if best < 0:
            best = table.largest(min(at + overlap + 1, high), high)
        end = best % (n + 1)
        start = end - overlap
        if best < 0:  # one character's bytes on either side of every place: share a token or more, rather than break it
            end = max((e for e in range(at + 1, high + 1) if strength[e] != BROKEN), default=high)
            start = max((e for e in range(at + 1, end - overlap + 1) if strength[e] != BROKEN), default=end)
        out.append((at, end))
        at = start
    out.append((at, n))
    return out


def split(docs: DataFrame, limits: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, piece, pieces, start_token, end_token, start_char, end_char, strength, text), pieces of each text in order.

    limits(source, max_tokens, overlap_tokens), at most MOST_LIMITS rows; max_tokens at least LEAST_TOKENS and more than
    twice overlap_tokens, else an error. A text within its limit, or of a source without one, is one piece; a null
    or empty text has none. A piece's own encoding never has more than max_tokens: where cutting inside a word would give
    more, the text is cut again with a lower limit, and, if not even the lowest is enough, with half the overlap. strength: of the boundary at the piece's end.
    """
    rows = limits.limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    of = {r["source"]: (r["max_tokens"], r["overlap_tokens"] or 0) for r in rows if r["max_tokens"] is not None}
    if wrong := sorted(str(s) for s, (m, o) in of.items() if m < LEAST_TOKENS or not 0 <= o < m // 2):
        raise ValueError(f"limits too small, or overlaps too long for them: {', '.join(wrong)}")
    length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for b, r in ranks.items():
        length[r] = len(b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TextEncoder(ranks)
        columns = ["key", "piece", "pieces", "start_token", "end_token", "start_char", "end_char", "strength", "text"]
        for b in batches:
            out = []
            for k, t, s in zip(b["key"], b["text"], b["source"], strict=True):
                if not t:
                    continue
                lists = encoder.lists(t)
                n = sum(map(len, lists))
                most, overlap = of.get(s, (n, 0))
                if n <= most:
                    out.append((k, 0, 1, 0, n, 0, len(t), PARAGRAPH, t))
                    continue
                sizes = length[np.fromiter((i for x in lists for i in x), np.int64, n)]
                place, strength = boundaries(t, sizes)
                limit = most
                while True:
                    got = cuts(strength, limit, overlap)
                    over = max(encoder.count(t[place[i] : place[j]]) for i, j in got) - most
                    if over <= 0:
                        break
                    if limit > 2 * overlap + 2:
                        limit = max(2 * overlap + 2, limit - over)
                    elif overlap:
                        limit, overlap = most, overlap // 2
                    else:
                        raise ValueError(f"the text of {k} has no pieces of {most} tokens")
                out += [(k, p, len(got), i, j, int(place[i]), int(place[j]), int(strength[j]), t[place[i] : place[j]]) for p, (i, j) in enumerate(got)]
            yield pd.DataFrame(out, columns=columns)

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    kind = picked.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, pieces int, start_token int, end_token int, start_char int, end_char int, strength int, text string"
    return picked.mapInPandas(run, schema).withColumnRenamed("key", key)
