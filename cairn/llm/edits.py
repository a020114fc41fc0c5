"""Edit distances and a BK-tree."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def levenshtein(a: str, b: str, most: int = 1 << 30) -> int:
    """Insertions, deletions, substitutions: a true metric. Above `most`, some number above it."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        diagonal, row[0] = row[0], j
        low = j
        for i, x in enumerate(a, 1):
            here = min(row[i] + 1, row[i - 1] + 1, diagonal + (x != y))
            diagonal, row[i] = row[i], here
            low = min(low, here)
        if low > most:
            return most + 1
    return row[-1]


def transposing(a: str, b: str) -> int:
    """Edits counting a swap of neighbours as one (optimal string alignment; no metric, so no tree uses it)."""
    if a == b:
        return 0
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], two[j - 2] + 1)
        two, one = one, row
    return one[-1]


class Words:
    """A column of words, whose pairs are compared all at once."""

    def __init__(self, words: Sequence[str]):
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        #: Words up to this length stand in the matrix, so that one long word doesn't widen it for all.
        self.most = min(int(self.lengths.max(initial=0)), 40)
        short = [w if len(w) <= self.most else "" for w in words]
        self.codes = np.array(short, dtype=f"<U{max(self.most, 1)}").view(np.uint32).reshape(len(words), max(self.most, 1)) if len(words) else np.zeros((0, 1), np.uint32)
        # a bit for each letter, to rule pairs out
        self.letters = np.bitwise_or.reduce(np.where(self.codes > 0, np.int64(1) << (self.codes % 61).astype(np.int64), 0), axis=1) if len(words) else np.zeros(0, np.int64)

    def transposing(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """transposing() of the words i and j, pair by pair; above `most`, most + 1."""
        out = np.full(len(i), most + 1, np.int64)
        long = (self.lengths[i] > self.most) | (self.lengths[j] > self.most)
        ok = np.abs(self.lengths[i] - self.lengths[j]) <= most
        for k in np.flatnonzero(long & ok):
            out[k] = min(transposing(self.words[i[k]], self.words[j[k]]), most + 1)
        ok &= ~long & (np.bitwise_count(self.letters[i] ^ self.letters[j]) <= 2 * most)
        at = np.flatnonzero(ok)
        for start in range(0, len(at), 50_000):
            k = at[start : start + 50_000]
            out[k] = np.minimum(self._batch(i[k], j[k]), most + 1)
        return out

    def _batch(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        la, lb = self.lengths[i], self.lengths[j]
        n, wide, high = len(i), int(lb.max(initial=0)), int(la.max(initial=0))
        a, b = self.codes[i, :high].T.copy(), self.codes[j, :wide].T.copy()
        two = np.zeros((wide + 1, n), np.int16)
        one = np.repeat(np.arange(wide + 1, dtype=np.int16)[:, None], n, axis=1)
        out = one[lb, np.arange(n)].astype(np.int64)
        for x in range(1, high + 1):
            row = np.empty_like(one)
            row[0] = x
            for y in range(1, wide + 1):
                r = np.minimum(np.minimum(one[y], row[y - 1]) + 1, one[y - 1] + (a[x - 1] != b[y - 1]))
                if x > 1 and y > 1:
                    r = np.where((a[x - 1] == b[y - 2]) & (a[x - 2] == b[y - 1]), np.minimum(r, two[y - 2] + 1), r)
                row[y] = r
            two, one = one, row
            done = la == x
            out[done] = row[lb[done], np.flatnonzero(done)]
        return out


class BKTree:
    """Words by distance to their parent. Needs a true metric: the triangle inequality prunes every search."""

    def __init__(self, metric: Callable[[str, str], int] = levenshtein):
        self.metric = metric
        self.root: tuple[str, dict] | None = None

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while d := self.metric(word, node[0]):
            if d not in node[1]:
                node[1][d] = (word, {})
                return
            node = node[1][d]

    def within(self, word: str, most: int) -> list[tuple[str, int]]:
        """(entry, distance) of every entry at a distance of at most `most`."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            entry, children = todo.pop()
            d = self.metric(word, entry)
            if d <= most:
                found.append((entry, d))
            todo += [c for k, c in children.items() if d - most <= k <= d + most]
        return found
