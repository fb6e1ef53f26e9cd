"""Mixing sources to target weights by blocks of tokens.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of a fixed number of tokens.
The mix is a list of slots, one per block, in output shards of a fixed number of slots. The numbers of slots of the
sources in a shard are drawn multinomially, given the sources' totals, so the totals meet the weights: totals are split
between the halves of the range of shards by the multivariate hypergeometric law, again and again, each split with its
own seed; any shard finds its numbers alone from the few splits above it. Splits of any size are drawn, up to 2**62 slots. A slot of a source has a running number
there. It is mapped to a block by a pseudorandom permutation of the source's blocks, a new one for each repetition, and
joined with the blocks by their index. No block, hence no document's token, comes more often than ``max_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions.tables import durable
from skein.llm.bpe import VOCABULARY, token_counts

BLOCK_TOKENS = 256
SHARD_SLOTS = 1024
BUCKET_ROWS = 20_000  # documents per bucket of a source's order, about
MAX_SOURCES = 10_000
_FEW = 64  # items drawn one by one


def source_key(source: Column) -> Column:
    """The name of a source without regard to case, outer blanks, runs of blanks and the form of the final sigma."""
    return F.translate(F.lower(F.trim(F.regexp_replace(source, r"\s+", " "))), "ς", "σ")


def _split(totals: np.ndarray, left: int, seed: list[int]) -> np.ndarray:
    """How many of each source's ``totals`` go to the left part, which has ``left`` slots: a multivariate hypergeometric draw.

    Every slot goes left by a coin of its own, which takes one binomial draw per source. Too few or too many are set right by the
    same draw among the slots on one side, whose number falls as the square root each time, and the last few one by
    one. All slots are treated alike, so given its size the left part is any one of that size with equal probability.
    """
    rng = np.random.default_rng(seed)
    rest, taken = totals.astype(np.int64), np.zeros(len(totals), np.int64)
    while (need := left - int(taken.sum())) != 0:
        source, target = (rest, taken) if need > 0 else (taken, rest)
        if abs(need) > _FEW:
            moved = rng.binomial(source, min(1.0, abs(need) / int(source.sum())))
            source -= moved
            target += moved
            continue
        for _ in range(abs(need)):
            i = int(np.searchsorted(np.cumsum(source), rng.integers(int(source.sum())), "right"))
            source[i] -= 1
            target[i] += 1
    return taken


class ShardDraw:
    """The numbers of slots of each source in each shard; shards asked for in order share the splits above them."""

    def __init__(self, totals: np.ndarray, shards: int, seed: int):
        self.slots, self.shards, self.seed = int(totals.sum()), shards, seed
        self.path = [(0, shards, np.zeros(len(totals), np.int64), totals.astype(np.int64))]

    def __call__(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """For one shard the running number of each source's first slot and the number of its slots."""
        while not self.path[-1][0] <= shard < self.path[-1][1]:
            self.path.pop()
        while True:
            lo, hi, start, totals = self.path[-1]
            if hi - lo <= 1:
                return start, totals
            mid = (lo + hi) // 2
            left = _split(totals, self.slots * mid // self.shards - self.slots * lo // self.shards, [self.seed, lo, hi])
            self.path.append((lo, mid, start, left) if shard < mid else (mid, hi, start + left, totals - left))


def shard_draw(totals: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For one shard the running number of each source's first slot and the number of its slots."""
    return ShardDraw(totals, shards, seed)(shard)


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(size)`` at ``index``: a Feistel network over the next power of four, walked on until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, size]).integers(1, 1 << 62, 6, dtype=np.uint64) | np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= k
            left, right = right, left ^ ((mixed >> np.uint64(40)) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = todo[x >= np.uint64(size)]
    return out.astype(np.int64)


def sized_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source_key, n_tokens`` of every document, written once."""
    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source_key"), "text")
    return durable(token_counts(named, ("doc_id", "source_key"), path))


def quotas(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> list[dict]:
    """For each target source its tokens there are, its target and its number of slots; one entry per row of ``targets``.

    The whole mix has ``total_tokens``, by default as many as all documents have. A source gives its weight of them as far
    as ``max_repeats`` of what it has allow. Weights and repeats that are null, negative or no number count as 0. Source names that differ only in spelling are one
    source; the table of targets has a fixed size and at most ``MAX_SOURCES`` rows.
    """
    rows = targets.withColumn("source_key", source_key(F.col("source"))).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    keys = [r.source_key for r in rows]
    if len(set(keys)) < len(keys):
        raise ValueError("a source is listed twice")
    wanted = F.col("source_key").isin(*[k for k in keys if k is not None])
    have = {r.source_key: r.n for r in sized.where(wanted).groupBy("source_key").agg(F.sum("n_tokens").alias("n")).collect()}
    if total_tokens is None:
        total_tokens = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    out = []
    for i, r in enumerate(rows):
        there = have.get(r.source_key) or 0
        blocks = -(-there // block_tokens)
        weight = r.weight if r.weight is not None and 0 < r.weight < float("inf") else 0.0
        target = weight * total_tokens
        per_block = there / blocks if blocks else 1.0
        slots = min(round(target / per_block), blocks * max(0, r.max_repeats or 0))
        out.append({"index": i, "source": r.source, "key": r.source_key, "weight": r.weight, "max_repeats": r.max_repeats, "tokens": there, "blocks": blocks, "target": target, "slots": slots})
    return out


def slots(sized: DataFrame, quota: list[dict], seed: int, shard_slots: int) -> DataFrame:
    """``shard, slot, source_index, repetition, block``: every slot of the mix, made where it is needed."""
    totals = np.array([q["slots"] for q in quota], np.int64)
    sizes = [q["blocks"] for q in quota]
    shards = max(1, -(-int(totals.sum()) // shard_slots))
    spark = sized.sparkSession
    names = ["shard", "slot", "source_index", "repetition", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = ShardDraw(totals, shards, seed)
        for b in batches:
            for shard in b.column(0).to_pylist():
                start, n = draw(shard)
                if not n.sum():
                    continue
                source, turn, block = [], [], []
                for i in np.flatnonzero(n):
                    index = np.arange(start[i], start[i] + n[i])
                    times, at = index // sizes[i], index % sizes[i]
                    for k in np.unique(times):
                        here = times == k
                        source.append(np.full(here.sum(), i))
                        turn.append(times[here])
                        block.append(permuted(at[here], sizes[i], seed * 1_000_003 + i * 1009 + int(k)))
                order = np.random.default_rng([seed, shard, 1]).permutation(int(n.sum()))
                columns = [np.full(len(order), shard), np.arange(len(order)), *(np.concatenate(x)[order] for x in (source, turn, block))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    parts = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism, shards // 8 + 1))
    return spark.range(0, shards, 1, parts).mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def block_pieces(sized: DataFrame, quota: list[dict], block_tokens: int) -> DataFrame:
    """``source_index, block, doc_id, first_token, n_tokens``: which tokens of which documents make up each block.

    The order of a source's documents is by a hash, in buckets, so that no task ever sorts a whole source: offsets
    within a bucket are added to the totals of the buckets before it.
    """
    listed = F.create_map(*(F.lit(x) for q in quota if q["key"] is not None for x in (q["key"], q["index"])))
    h = F.xxhash64("doc_id")
    buckets = max(1, sized.count() // BUCKET_ROWS)
    docs = sized.where("n_tokens > 0").select("doc_id", F.try_element_at(listed, F.col("source_key")).cast("bigint").alias("source_index"), "n_tokens", h.alias("_h"), F.pmod(h, F.lit(buckets)).alias("_bucket")).where("source_index is not null")
    sums = docs.groupBy("source_index", "_bucket").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy("source_index").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_index", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source_index", "_bucket").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("_end", F.sum("n_tokens").over(inside)).join(sums, ["source_index", "_bucket"])
    docs = docs.select("source_index", "doc_id", (F.col("_base") + F.col("_end") - F.col("n_tokens")).alias("_from"), (F.col("_base") + F.col("_end")).alias("_to"))
    size = F.lit(block_tokens)
    cut = docs.withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))))
    first = F.greatest("_from", F.col("block") * size)
    return cut.select("source_index", "block", "doc_id", (first - F.col("_from")).alias("first_token"), (F.least("_to", (F.col("block") + 1) * size) - first).alias("n_tokens"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 42, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix and its shares.

    Mix: ``shard, slot, source, repetition, block, doc_id, first_token, n_tokens``, the tokens of documents that fill each
    slot. Shares: ``source, weight, max_repeats, available_tokens, target_tokens, tokens, share, most_repeats``, one row per row of
    ``targets``; ``share`` is of the tokens in the mix (0 where it is empty), ``most_repeats`` the most times a token comes.
    Documents without tokens, with a null source or one that is not listed give nothing; sources that have no
    documents, weight or repeats get share 0.
    """
    sized = sized_documents(documents, path)
    quota = quotas(sized, targets, total_tokens, block_tokens)
    spark = documents.sparkSession
    kinds = "source_index bigint, source string, weight double, max_repeats int, available_tokens bigint, target_tokens double"
    listed = spark.createDataFrame([(q["index"], q["source"], q["weight"], q["max_repeats"], q["tokens"], q["target"]) for q in quota], kinds)
    names = F.create_map(*(F.lit(x) for q in quota for x in (q["index"], q["source"]))) if quota else F.lit(None).cast("map<int,string>")
    if quota:
        # the slots are made from a range of shards, whose size says nothing about theirs: not to be broadcast on its account
        filled = slots(sized, quota, seed, shard_slots).hint("merge").join(block_pieces(sized, quota, block_tokens), ["source_index", "block"])
    else:
        filled = spark.createDataFrame([], "shard bigint, slot bigint, source_index bigint, repetition bigint, block bigint, doc_id bigint, first_token bigint, n_tokens bigint")
    result = filled.select("shard", "slot", F.try_element_at(names, F.col("source_index").cast("int")).alias("source"), "repetition", "block", "doc_id", "first_token", "n_tokens")
    reached = filled.groupBy("source_index").agg(F.sum("n_tokens").alias("_n"), (F.max("repetition") + 1).alias("_most"))
    every = filled.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).scalar()
    tokens = F.coalesce("_n", F.lit(0))
    shares = listed.join(reached, "source_index", "left").select("source", "weight", "max_repeats", "available_tokens", "target_tokens", tokens.alias("tokens"), F.when(every > 0, tokens / every).otherwise(0.0).alias("share"), F.coalesce("_most", F.lit(0)).alias("most_repeats"))
    return result, shares


def shares_checked(shares: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``source, weight, max_repeats, met, capped``: whether a source gives its target, as far as its repeats allow, to two blocks, and none too often.

    Weights and repeats that are null or negative count as 0.
    """
    most = F.coalesce(F.greatest("max_repeats", F.lit(0)), F.lit(0))
    wanted = F.least(F.coalesce("target_tokens", F.lit(0.0)), most * F.col("available_tokens"))
    return shares.select("source", "weight", "max_repeats", (F.abs(F.col("tokens") - wanted) <= 2 * block_tokens).alias("met"), (F.col("most_repeats") <= most).alias("capped"))
