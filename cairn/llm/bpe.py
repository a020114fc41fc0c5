"""Byte-level BPE of a whole corpus with the vocabulary of a public tokenizer, as Spark expressions.

The vocabulary's ranks are one literal: an array of small maps, reached by a checksum, so a look-up costs the same whatever
the vocabulary's size. The distinct words of the corpus are folded once each: a higher-order aggregate merges, step by step,
the neighbouring pieces of least rank. The texts then meet the dictionary, chunk by chunk. Decoding concatenates the
pieces' bytes.

Pieces of bytes are written as strings of the characters U+0000 to U+00FF, one for each byte.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import written

TOKENIZERS = "/opt/tokenizers"
BUCKETS = 16384
#: Words of more bytes are merged with a heap in Python: the fold takes time by the square of the length.
LONG = 1500
CHUNK_CHARS = 4_000_000

#: White space as Unicode has it, and the pattern that cuts a text into words.
_S = r"\u0009-\u000d \u0085   -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def read_ranks(name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Ranks of a rank file: base64 of the bytes, then the id."""
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_WORDS = regex.compile(PATTERN)
_SPACE_AFTER_SPACE = re.compile(r"\s ")
#: The same in the other dialect, whose \s is ASCII's alone.
_SPACE_AFTER_SPACE_RE2 = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_PARTS = re.compile(r"\s+\S*|\S+")


#: Begins a part that isn't to be read with a space before it; no text can hold it.
_BARE = "\ud800"


def parts_of(text: str) -> list[str]:
    """Parts of a text, each cut where the pattern cuts too (before white space that follows a character). A part stands for
    itself with a space before it, or, behind the mark _BARE, for itself; all together are the text. Splitting like this is
    much quicker than the pattern, which then sees each distinct part once."""
    if _SPACE_AFTER_SPACE.search(text):
        return [p[1:] if p[0] == " " else _BARE + p for p in _PARTS.findall(text)]
    parts = text.split(" ")
    if parts[0]:
        parts[0] = _BARE + parts[0]
        return parts
    return parts[1:]


def whole_part(part: str) -> str:
    """The text that a part stands for."""
    return part[1:] if part[:1] == _BARE else " " + part


class TextEncoder:
    """Ids of texts in one process, for operators that measure or cut texts: remembers the ids of up to `most` parts."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, list[int]] = {}
        self.most = most

    def lists(self, text: str) -> list[list[int]]:
        parts, known = parts_of(text), self.known
        new = set(parts).difference(known)
        if len(known) + len(new) > self.most:
            known.clear()
            new = set(parts)
        for p in new:
            known[p] = self.encoding.encode_ordinary(whole_part(p))
        return list(map(known.__getitem__, parts))

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.lists(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.lists(text))) if text else 0


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and values of a column of lists of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0], column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]


def _chunks(ranks: dict[bytes, int], chunk_chars: int, most: int = 300_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches(_key, _text): for each text the numbers of its words in its chunk, and for each chunk its distinct words.

    The words of up to `most` parts are remembered from chunk to chunk.
    """
    ints, names = pa.list_(pa.int32()), ["_chunk", "_key", "nums", "word", "no", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        words_of: dict[str, list[str]] = {}
        texts: list[pa.Array] = []
        keys: list[pa.Array] = []
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            key, wholes, counts, every, used = _parts_of_all(pa.concat_arrays(texts), pa.concat_arrays(keys))
            if len(words_of) + len(wholes) > most:
                words_of.clear()
            for p in wholes:
                if p not in words_of:
                    words_of[p] = _WORDS.findall(p)
            found = [words_of[p] if u else [] for p, u in zip(wholes, used, strict=True)]
            word = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            pool, start = word.indices.to_numpy(), np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
            size = np.diff(start)[every]
            ends = np.concatenate(([0], np.cumsum(size)))
            got = pool[np.arange(ends[-1]) + np.repeat(start[every] - ends[:-1], size)] if ends[-1] else np.zeros(0, np.int32)
            last = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
            n = len(key)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), key, pa.ListArray.from_arrays(pa.array(last), pa.array(got)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, ints)], names)
            for at in range(0, len(word.dictionary), 50_000):
                part = word.dictionary.slice(at, 50_000)
                m = len(part)
                long = [None] * m
                for i in np.flatnonzero(pc.utf8_length(part).to_numpy() > LONG // 4):
                    long[i] = heap_merge(part[int(i)].as_py().encode(), ranks)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.nulls(m, key.type), pa.nulls(m, ints), part, pa.array(range(at, at + m), pa.int32()), pa.array(long, ints)], names)

        for b in batches:
            text, key = b.column("_text"), b.column("_key")
            sizes = np.concatenate(([0], np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))))
            at = 0
            while at < len(text):
                end = min(len(text), max(at + 1, int(np.searchsorted(sizes, sizes[at] + chunk_chars - held))))
                texts.append(text.slice(at, end - at))
                keys.append(key.slice(at, end - at))
                held += int(sizes[end] - sizes[at])
                at = end
                if held >= chunk_chars:
                    yield from emit()
                    chunk, held = chunk + 1, 0
                    texts.clear(), keys.clear()
        if texts:
            yield from emit()

    return run


def _parts_of_all(text: pa.Array, key: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """parts_of, for a column of texts at once: keys in the order taken, what each distinct part stands for, how many parts
    each text has, all texts' parts by number, and which distinct parts are used at all."""
    wide = pc.match_substring_regex(text, _SPACE_AFTER_SPACE_RE2)
    split = pc.split_pattern(text.filter(pc.invert(wide)), " ")
    edge, flat = split.offsets.to_numpy(), split.flatten().dictionary_encode()
    spaced, number = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
    first = (edge[:-1] - edge[0]).astype(np.int64)  # every text's first part has no space before it
    bare = flat.take(pa.array(first)).cast(pa.string()).dictionary_encode() if len(first) else None
    wholes = [" " + p for p in spaced]
    if bare is not None:
        number[first] = len(wholes) + bare.indices.to_numpy()
        wholes += bare.dictionary.to_pylist()
    others = list(map(_PARTS.findall, text.filter(wide).to_pylist()))
    rest = pa.array(list(chain.from_iterable(others)), pa.string()).dictionary_encode()
    every = np.concatenate((number, len(wholes) + rest.indices.to_numpy().astype(np.int64)))
    wholes += rest.dictionary.to_pylist()
    counts = np.concatenate((np.diff(edge), np.fromiter(map(len, others), np.int64, len(others)))).astype(np.int64)
    keys = pa.concat_arrays([key.filter(pc.invert(wide)), key.filter(wide)])
    return keys, wholes, counts, every, np.bincount(every, minlength=len(wholes)) > 0


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        pieces = [""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            s = b.decode("latin-1")
            buckets[zlib.crc32(s.encode()) % BUCKETS][s] = r
            pieces[r] = s
        # One JSON string each; the optimizer folds it into a literal once.
        self._rank = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
        self._piece = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    @staticmethod
    def rank(table: Column, piece: Column) -> Column:
        """Rank of a piece, null if it is none of the vocabulary."""
        return F.try_element_at(F.get(table, (F.crc32(piece) % BUCKETS).cast("int")), piece)

    @staticmethod
    def as_bytes(text: Column) -> Column:
        """The UTF-8 bytes of a text as characters."""
        return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))

    def fold(self, word: Column) -> Column:
        """Ids of a word (its bytes as characters): merges the leftmost pair of least rank until no pair is a token."""
        # The table is bound once: each place where a literal stands would be sent to, and read by, every task.
        return _let(self._rank, lambda table: self._fold(word, lambda piece: self.rank(table, piece)))

    @staticmethod
    def _fold(word: Column, rank: Callable[[Column], Column]) -> Column:
        none = F.array().cast("array<int>")
        one = F.lit(1)

        def merged(p: Column, r: Column, at: Column, both: Column) -> Column:
            left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), both)))).otherwise(none)
            right = F.when(at < F.size(r), F.array(rank(F.concat(both, F.get(p, at + 1))))).otherwise(none)
            pieces = F.concat(F.slice(p, one, at - 1), F.array(both), F.slice(p, at + 2, F.size(p)))
            ranks = F.concat(F.slice(r, one, F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(p)))
            return F.struct(pieces.alias("p"), ranks.alias("r"))

        def step(acc: Column, _: Column) -> Column:
            # What is used more than once is bound by a lambda: an expression is evaluated again wherever it stands.
            least = F.array_min(acc.r)
            at = F.array_position(acc.r, least).cast("int")
            bound = _let(acc.p, lambda p: _let(acc.r, lambda r: _let(at, lambda i: _let(F.concat(F.get(p, i - 1), F.get(p, i)), lambda both: merged(p, r, i, both)))))
            return F.when(least.isNull(), acc).otherwise(bound)

        def folded(w: Column, n: Column) -> Column:
            chars = F.transform(F.sequence(one, n), lambda i: F.substring(w, i, one))
            pairs = F.transform(F.sequence(one, n - 1), lambda i: rank(F.substring(w, i, F.lit(2))))
            done = F.aggregate(F.sequence(one, n - 1), F.struct(chars.alias("p"), pairs.alias("r")), step)
            return F.transform(done.p, rank)

        return F.when(rank(word).isNotNull(), F.array(rank(word))).otherwise(_let(word, lambda w: folded(w, F.char_length(w))))

    def fold_words(self, words: DataFrame) -> DataFrame:
        """words(word) with `ids`."""
        return words.select("word", self.fold(self.as_bytes(F.col("word"))).alias("ids"))

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
        """(key, ids): ids of each text without special tokens, whose strings are ordinary text. Null and empty texts give [].

        Whole texts are encoded; repeated rows come out repeated, other columns are ignored. Texts are read once: where they
        are read, chunks of about chunk_chars characters become lists of the numbers of their words, beside each chunk's
        distinct words. The words, made distinct over the corpus, are folded once each; then every chunk meets the ids of its
        words, and numbers become ids. So no task holds more than a chunk at a time, texts are never shuffled, and a word
        that a third of the texts hold is one row of each chunk. A word without ids ends the job with an error.
        """
        docs = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
        ranks, kind = self.ranks, docs.schema["_key"].dataType
        seen = written(docs.mapInArrow(_chunks(ranks, chunk_chars), f"_chunk bigint, _key {kind.simpleString()}, nums array<int>, word string, no int, ids array<int>"))
        words = seen.where("no is not null")
        plain = words.where("ids is null").select("_chunk", "no", "word")
        folded = plain.join(self.fold_words(plain.select("word").distinct()), "word", "left").select("_chunk", "no", "ids")
        chunks = max(1, seen.select("_chunk").distinct().count())
        entries = folded.union(words.where("ids is not null").select("_chunk", "no", "ids")).repartition(chunks, "_chunk")
        texts = seen.where("no is null").select(F.col("_chunk").alias("_chunk"), "_key", "nums").repartition(chunks, "_chunk")

        def apply(texts: pa.Table, entries: pa.Table) -> pa.Table:
            no = entries.column("no").to_numpy()
            order = np.argsort(no)
            if entries.column("ids").null_count or not np.array_equal(no[order], np.arange(len(no))):
                raise ValueError("a word has no ids")
            start, flat = _lists(entries.column("ids").combine_chunks().take(pa.array(order)))
            edge, number = _lists(texts.column("nums").combine_chunks())
            # the ids of all words, one behind the other: each word's run is read from flat
            size = np.diff(start)[number] if len(number) else np.zeros(0, np.int64)
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            got = flat[np.arange(total) + np.repeat(start[number] - (ends - size), size)] if total else np.zeros(0, np.int32)
            last = np.concatenate(([0], ends))[edge]
            return pa.table({key: texts.column("_key"), "ids": pa.ListArray.from_arrays(pa.array(last.astype(np.int32)), pa.array(got.astype(np.int32)))})

        return texts.groupBy("_chunk").cogroup(entries.groupBy("_chunk")).applyInArrow(apply, f"{key} {kind.simpleString()}, ids array<int>")

    def decode(self, ids: Column) -> Column:
        """The text of a list of ids: its pieces' bytes concatenated; null of null."""
        return F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.get(self._piece, i)), ""), "ISO-8859-1"), "UTF-8")


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges, kept in a heap."""
    import heapq

    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, word[i : i + 2]) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or piece[i] + piece[j] != both:
            continue
        piece[i], alive[j], after[i] = both, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if 0 <= a and b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, piece[a] + piece[b]))
    return [ranks[piece[i]] for i in range(n) if alive[i]]
