"""Structural index of many JSON texts at once: bitmaps of quotes, brackets and delimiters, depths by prefix sums.

No text is parsed by itself: all texts of a batch lie in one byte array, and every step is a numpy pass over it. What
comes out are tokens with their span, depth, parent and place in the parent, from which rows are linked.
"""

from __future__ import annotations

import json
import re

import numpy as np

OPEN_OBJECT, CLOSE_OBJECT, OPEN_LIST, CLOSE_LIST, COLON, COMMA, STRING, SCALAR = range(8)
_KIND = np.full(256, -1, dtype=np.int8)
for _c, _k in zip(b"{}[]:,", range(6), strict=True):
    _KIND[_c] = _k
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 13, 32]] = True
_NUMBER = re.compile(rb"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")
_ESCAPE = re.compile(rb'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})')


class JsonIndex:
    """Tokens of texts (a None or blank text has none). valid[t]: text t is one well-formed JSON value.

    Of each token: text, kind, start, end (of its bytes), depth (open brackets around it), parent (token of the bracket
    around it, -1 at the root), value (it is a value, not a key or a mark), place (of a value: its number in its parent),
    key (of a value in an object: the token of its key, else -1).
    """

    def __init__(self, texts: list[str | None]):
        # A text that is one JSON string may hold JSON itself; its string is decoded and then indexed like the others.
        texts = [_inner(t) if t is not None and t.lstrip()[:1] == '"' else t for t in texts]
        count = len(texts)
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts] or [b""]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.bytes = b = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        self._buffer = b.tobytes()
        first = np.cumsum(lengths) - lengths
        n, idx = len(b), np.arange(len(b))
        doc = np.repeat(np.arange(len(raw)), lengths)
        at_start = lambda running: np.where(first > 0, running[first - 1], 0)

        slash = b == 92
        before = np.empty(n, dtype=np.int64)
        before[0] = -1
        before[1:] = np.maximum.accumulate(np.where(slash, -1, idx))[:-1]  # the last byte that is no backslash
        quote = (b == 34) & ((idx - 1 - before) % 2 == 0)
        running = np.cumsum(quote)
        inside = (running - at_start(running)[doc]) % 2 == 1  # from an opening quote up to before its closing one
        out = ~inside & ~quote
        kind = np.where(out, _KIND[b], -1)
        opens, closes = np.isin(kind, (OPEN_OBJECT, OPEN_LIST)), np.isin(kind, (CLOSE_OBJECT, CLOSE_LIST))
        running = np.cumsum(opens.astype(np.int64) - closes)
        depth = running - at_start(running)[doc]
        scalar = out & (kind < 0) & ~_SPACE[b]
        edge = np.diff(np.concatenate(([0], (scalar * (doc + 1)), [0])))
        s0, s1 = np.flatnonzero((edge != 0) & np.concatenate((scalar, [False]))), np.flatnonzero((edge != 0) & np.concatenate(([False], scalar)))
        q0 = np.flatnonzero(quote & inside)
        q1 = np.flatnonzero(quote & ~inside)
        bad = np.zeros(len(raw), bool)
        odd = np.bincount(doc[q0], minlength=len(raw)) != np.bincount(doc[q1], minlength=len(raw))
        bad |= odd
        q0, q1 = q0[~odd[doc[q0]]], q1[~odd[doc[q1]]]
        marks = np.flatnonzero(kind >= 0)
        start = np.concatenate((marks, q0, s0))
        order = np.argsort(start, kind="stable")
        self.start = start = start[order]
        self.end = np.concatenate((marks + 1, q1 + 1, s1))[order]
        self.kind = k = np.concatenate((kind[marks], np.full(len(q0), STRING), np.full(len(s0), SCALAR)))[order].astype(np.int8)
        self.text = t = doc[start]
        is_open, is_close = np.isin(k, (OPEN_OBJECT, OPEN_LIST)), np.isin(k, (CLOSE_OBJECT, CLOSE_LIST))
        level = depth[start] + is_close  # inner depth of a bracket, depth around any other token
        self.depth = level - (is_open | is_close)
        np.logical_or.at(bad, t[(self.depth < 0) | (level < 0)], True)

        # Brackets of one level alternate open, close; so the last open one of a level is the parent of what follows.
        m, tok = len(k), np.arange(len(k))
        by_level = np.lexsort((tok, level, t))
        by_level = by_level[is_open[by_level] | is_close[by_level]]
        balanced = np.bincount(t[is_open], minlength=len(raw)) == np.bincount(t[is_close], minlength=len(raw))
        bad |= ~balanced
        fine = by_level[balanced[t[by_level]] & ~bad[t[by_level]]]
        pair_open, pair_close = fine[0::2], fine[1::2]
        wrong = ~is_open[pair_open] | ~is_close[pair_close] | (level[pair_open] != level[pair_close]) | (k[pair_open] + 1 != k[pair_close])
        np.logical_or.at(bad, t[pair_open[wrong]], True)
        self.match = np.full(m, -1, dtype=np.int64)
        self.match[pair_open], self.match[pair_close] = pair_close, pair_open
        opened = np.flatnonzero(is_open)
        width = int(level.max(initial=0)) + 2
        code = lambda text, lev: text * width + np.maximum(lev, 0)
        o = opened[np.lexsort((opened, code(t[opened], level[opened])))]
        keys = code(t[o], level[o]) * (m + 1) + o
        at = np.searchsorted(keys, code(t, np.where(is_open | is_close, self.depth, level)) * (m + 1) + tok) - 1
        has = (at >= 0) & (self.depth > 0)
        self.parent = parent = np.where(has, o[np.maximum(at, 0)] if len(o) else -1, -1)

        in_object = (parent >= 0) & (k[np.maximum(parent, 0)] == OPEN_OBJECT)
        prev = np.where((tok > 0) & (t == np.roll(t, 1)), np.roll(k, 1), -1) if m else k
        after_key_place = (prev == OPEN_OBJECT) | ((prev == COMMA) & in_object)
        is_key = (k == STRING) & after_key_place
        self.value = value = (np.isin(k, (STRING, SCALAR)) | is_open) & ~is_key
        prev_value_end = np.isin(prev, (STRING, SCALAR, CLOSE_OBJECT, CLOSE_LIST))
        prev_key = np.roll(is_key, 1) & (prev == STRING) if m else is_key
        value_place = (prev == COLON) | (prev == OPEN_LIST) | ((prev == COMMA) & ~in_object & (self.depth > 0)) | (prev == -1)
        ok = np.where(
            is_key, True,
            np.where(
                value, value_place,
                np.where(
                    k == COLON, prev_key & in_object,
                    np.where(k == COMMA, prev_value_end & ~prev_key & (self.depth > 0), (prev_value_end & ~prev_key) | (prev == k - 1)),
                ),
            ),
        )
        np.logical_or.at(bad, t[~ok.astype(bool)], True)
        roots = np.bincount(t[value & (self.depth == 0)], minlength=len(raw))
        bad |= roots != 1
        stop = np.flatnonzero(k == SCALAR)
        for i in stop:
            if not _NUMBER.fullmatch(self._buffer, int(start[i]), int(self.end[i])):
                bad[t[i]] = True
        control = inside & (b < 32)
        np.logical_or.at(bad, doc[control], True)
        for d in np.unique(doc[slash]):
            if _ESCAPE.search(raw[d].replace(b"\\\\", b"")):
                bad[d] = True
        self.valid = ~bad[:count]

        group = np.where(value, parent, -2)
        rank = np.lexsort((tok, group))
        g = group[rank]
        fresh = np.concatenate(([True], g[1:] != g[:-1])) if m else np.zeros(0, bool)
        self.place = np.zeros(m, dtype=np.int64)
        self.place[rank] = np.arange(m) - np.maximum.accumulate(np.where(fresh, np.arange(m), 0)) if m else 0
        self.key = np.where(value & in_object & (prev == COLON), tok - 2, -1)

    def raw(self, token: int) -> str:
        """The text of a token; of an opening bracket, up to its closing one."""
        end = self.end[self.match[token]] if self.match[token] >= 0 else self.end[token]
        return self._buffer[self.start[token] : end].decode("utf-8", "replace")

    def scalar(self, token: int) -> object:
        """The value of a string or scalar token."""
        return json.loads(self.raw(token))

    def null(self, tokens: np.ndarray) -> np.ndarray:
        return (self.kind[tokens] == SCALAR) & (self.bytes[self.start[tokens]] == 110)

    def root(self) -> np.ndarray:
        """Tokens of the roots of valid texts that are objects."""
        top = np.flatnonzero((self.depth == 0) & (self.kind == OPEN_OBJECT))
        return top[self.valid[self.text[top]]]

    def children(self, parents: np.ndarray) -> np.ndarray:
        """Value tokens whose parent is among the given tokens."""
        wanted = np.zeros(len(self.kind) + 1, bool)
        wanted[parents] = True
        return np.flatnonzero(self.value & wanted[self.parent] & (self.parent >= 0))

    def at_key(self, parents: np.ndarray, name: str) -> np.ndarray:
        """Value tokens at a key of the given objects; where a key is repeated, its last value."""
        c = self.children(parents[self.kind[parents] == OPEN_OBJECT])
        plain = json.dumps(name).encode()
        size = self.end[self.key[c]] - self.start[self.key[c]]
        may = [i for i, (s, w) in enumerate(zip(self.start[self.key[c]], size, strict=True)) if (w == len(plain) or b"\\" in self._buffer[s : s + w]) and (self._buffer[s : s + w] == plain or (b"\\" in self._buffer[s : s + w] and self.scalar(self.key[c[i]]) == name))]
        c = c[may]
        last = np.ones(len(c), bool)
        last[:-1] = self.parent[c][1:] != self.parent[c][:-1] if len(c) else True
        if len(c) and len(np.unique(self.parent[c])) != last.sum():  # children of nested parents may alternate
            c = c[np.lexsort((c, self.parent[c]))]
            last = np.concatenate((self.parent[c][1:] != self.parent[c][:-1], [True]))
        return c[last]

    def elements(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(element token, number of its value in `values`) of lists; a value that is no list stands for itself."""
        lists = values[self.kind[values] == OPEN_LIST]
        single = np.flatnonzero(self.kind[values] != OPEN_LIST)
        c = self.children(lists)
        where = np.full(len(self.kind) + 1, -1)
        where[values] = np.arange(len(values))
        return np.concatenate((c, values[single])), np.concatenate((where[self.parent[c]], single))

    def position(self, tokens: np.ndarray) -> np.ndarray:
        """Place in the list, 0 for a value that is in none."""
        p = self.parent[tokens]
        return np.where((p >= 0) & (self.kind[np.maximum(p, 0)] == OPEN_LIST), self.place[tokens], 0)


def _inner(text: str) -> str:
    try:
        got = json.loads(text)
    except ValueError:
        return text
    return got if isinstance(got, str) and got.lstrip()[:1] in ("{", "[") else text
