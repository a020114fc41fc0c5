"""Mixing sources to target shares of tokens.

The texts of a source are one stream of tokens, packed into blocks of fixed length. Output shards draw how many of their
slots each source fills; the slots of a source run through pseudorandom permutations of its blocks, one permutation for each
pass over it; then slots and blocks are joined by the block's number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.llm.bpe import TextEncoder
from cairn.session import cut

BLOCK_TOKENS, SHARD_SLOTS = 128, 4096
#: Most rows of the table of targets.
MOST_SOURCES = 100_000


def token_counts(docs: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, tokens) of each text; 0 for a null or empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TextEncoder(ranks)
        for b in batches:
            yield b.drop(columns="_text").assign(tokens=np.array([encoder.count(t) for t in b["_text"]], dtype=np.int64))

    picked = docs.select(key, *keep, F.col(text).alias("_text"))
    return picked.mapInPandas(run, picked.drop("_text").schema.add("tokens", "long"))


@dataclass
class Plan:
    """What each source gives: blocks it has, slots it fills."""

    sources: list[str]
    weights: list[float]
    repeats: list[int]
    tokens: list[int]
    blocks: list[int]
    slots: list[int]
    shards: int


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], block: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, total: int | None = None) -> Plan:
    """How many slots each source fills in a mix of `total` tokens, by default as many as the sources hold.

    A source gets its weight's share, at most max_repeats times its size; what a source at that limit can't give, the others give
    by their weights, as far as their limits allow. Sources of no tokens or no weight are left out, and the other weights
    are scaled to sum to 1.
    """
    rows = sorted((s, float(w), int(m)) for s, w, m in targets if w and w > 0 and m and m > 0 and sizes.get(s, 0) > 0)
    scale = sum(w for _, w, _ in rows)
    names, weights, repeats = [r[0] for r in rows], [r[1] / scale for r in rows], [r[2] for r in rows]
    tokens = [int(sizes[s]) for s in names]
    blocks = [-(-n // block) for n in tokens]
    caps = [m * n for m, n in zip(repeats, tokens, strict=True)]
    wanted = min(sum(tokens) if total is None else total, sum(caps))
    given, free, left = [0.0] * len(rows), set(range(len(rows))), float(wanted)
    while free:
        level = left / sum(weights[i] for i in free)
        full = {i for i in free if caps[i] <= level * weights[i]}
        for i in full or free:
            given[i] = float(caps[i]) if full else level * weights[i]
        left -= sum(given[i] for i in full)
        free = free - full if full else set()
    # a source's mean block is a little short of the full length, as its last one is
    slots = [min(m * b, max(1, round(g / (n / b)))) for m, b, g, n in zip(repeats, blocks, given, tokens, strict=True)]
    return Plan(names, weights, repeats, tokens, blocks, slots, max(1, -(-sum(slots) // shard_slots)) if slots else 0)


def shard_counts(slots: list[int], shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in a shard, how many of its slots lie in earlier shards).

    A multinomial draw given that every source fills exactly its slots: the shards are halved again and again, and each half
    draws its counts from what is left. Each shard finds its own way down, so none waits for another.
    """
    left, before = np.array(slots, dtype=np.int64), np.zeros(len(slots), dtype=np.int64)
    low, high = 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        take = int(left.sum()) * (mid - low) // (high - low)
        first = _drawn(np.random.default_rng([seed, low, high]), left, take)
        if shard < mid:
            left, high = first, mid
        else:
            before, left, low = before + first, left - first, mid
    return left, before


#: The generator's own bound for an exact hypergeometric draw.
EXACT_DRAW = 1_000_000_000


def _drawn(rng: np.random.Generator, left: np.ndarray, take: int) -> np.ndarray:
    """How many of `take` slots fall to each source, without replacement; source by source, each given those before it.

    From EXACT_DRAW slots on, where the generator has no exact draw, a count is drawn from the normal distribution of the same
    mean and spread, whose error there is far below one part in a thousand of the spread; the total stays exact.
    """
    out = np.zeros_like(left)
    rest = int(left.sum())
    for i, have in enumerate(left.tolist()):
        low, high = max(0, take - (rest - have)), min(have, take)
        if rest < EXACT_DRAW:
            out[i] = rng.hypergeometric(have, rest - have, take) if take else 0
        else:
            p = have / rest
            spread = math.sqrt(max(take * p * (1 - p) * ((rest - take) / max(rest - 1, 1)), 0.0))
            out[i] = min(max(round(take * p + spread * rng.standard_normal()), low), high)
        rest -= have
        take -= int(out[i])
    return out


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size) at the given places: a four-round Feistel network, walked until in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for r in range(4):
                mixed = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % (1 << 64))) * np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
            out[todo] = (left << np.uint64(half)) | right
            todo = out >= np.uint64(size)
    return out.astype(np.int64)


def spans(sizes: DataFrame, block: int, seed: int = 0, bucket_docs: int = 50_000) -> DataFrame:
    """(source, block, key, from_token, tokens): which part of which text lies in each block of its source.

    sizes(key, source, tokens). Each source's texts follow one another in the order of a hash. Their places are prefix sums
    taken in buckets of that order and over the buckets' totals, so no source is summed up in one task.
    """
    order = F.xxhash64(F.lit(seed), "key")
    buckets = max(1, -(-sizes.count() // bucket_docs))
    s = sizes.where("tokens > 0").withColumn("_h", order).withColumn("_b", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * buckets))
    totals = s.groupBy("source", "_b").agg(F.sum("tokens").alias("_n"))
    offsets = totals.withColumn("_at", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.coalesce(F.sum("tokens").over(W.partitionBy("source", "_b").orderBy("_h", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = s.withColumn("_in", inner).join(offsets, ["source", "_b"]).select("source", "key", "tokens", (F.col("_in") + F.col("_at")).alias("start"))
    per = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("tokens") - 1) / block))))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("tokens"), (F.col("block") + 1) * block)
    return per.select("source", "block", "key", (low - F.col("start")).alias("from_token"), (high - low).alias("tokens"))


def mix(docs: DataFrame, targets: DataFrame, ranks: dict[bytes, int], seed: int = 0, block: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, total: int | None = None) -> DataFrame:
    """(shard, slot, source, pass_no, block, doc_id, from_token, tokens): the mix as parts of texts, in order of shard and slot.

    A slot is one block of one source. Texts of a null source, of a source without target, and without tokens take no part; an
    empty corpus gives an empty mix. A text is used at most once in each pass over its source, and there are at most
    max_repeats passes. doc_id must be unique.
    """
    sizes = cut(token_counts(docs.where(F.col("source").isNotNull()), ranks, keep=("source",)).withColumnRenamed("doc_id", "key"))
    rows = targets.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = [r["source"] for r in rows]
    held = {r["source"]: r["n"] for r in sizes.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    p = plan(held, [(r["source"], r["weight"], r["max_repeats"]) for r in rows], block, shard_slots, total)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"].tolist():
                counts, before = shard_counts(p.slots, p.shards, shard, seed)
                n = int(counts.sum())
                slot = np.random.default_rng([seed, 1, shard]).permutation(n)
                source = np.repeat(np.arange(len(counts)), counts)
                at = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) + before[source]
                size = np.array(p.blocks, dtype=np.int64)[source]
                number = np.empty(n, dtype=np.int64)
                passes = at // size
                for s in np.unique(source):
                    for k in np.unique(passes[source == s]):
                        here = (source == s) & (passes == k)
                        number[here] = permuted(at[here] % p.blocks[s], p.blocks[s], seed * 1_000_003 + int(s) * 1009 + int(k))
                yield pd.DataFrame({"shard": shard, "slot": slot, "source": np.array(p.sources, dtype=object)[source], "pass_no": passes, "block": number})

    spark = docs.sparkSession
    slots = spark.range(0, p.shards, 1, max(1, min(p.shards, 1024))).mapInPandas(draw, "shard bigint, slot bigint, source string, pass_no bigint, block bigint")
    kept = sizes.where(F.col("source").isin(p.sources)) if p.sources else sizes.where(F.lit(False))
    # Spark takes the few shards for the size of their slots and would broadcast them, though they grow with the texts
    return slots.hint("merge").join(spans(kept, block, seed), ["source", "block"]).select("shard", "slot", "source", "pass_no", "block", F.col("key").alias("doc_id"), "from_token", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, share, tokens, passes, exact_total): what each source was meant to give and gave.

    exact_total: of how many tokens a mix could be with every share as wanted, set by the source that reaches max_repeats
    first; null if no source did, so that the shares are as wanted.
    """
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("pass_no") + 1).alias("passes"), F.sum(F.when(F.col("pass_no") == 0, F.col("tokens"))).alias("_held"))
    joined = targets.join(got, "source", "left")
    # a source at its limit has been gone through, so its first pass holds all its tokens
    exact = F.when(F.col("passes") >= F.col("max_repeats"), F.floor(F.col("max_repeats") * F.col("_held") / F.col("weight")))
    total = joined.agg(F.sum("tokens").alias("_all"), F.min(exact).alias("exact_total"))
    joined = joined.crossJoin(total)  # one row of totals
    return joined.select("source", "weight", "exact_total", F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("passes", F.lit(0)).alias("passes"))
