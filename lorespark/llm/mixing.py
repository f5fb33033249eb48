"""Mixing sources to target weights.

Each source's documents, in a fixed order, form one stream of words cut into blocks of `block` words. A source's
target is turned into whole slots, and the slots are dealt to output shards by multinomial counts under those
totals (the multivariate hypergeometric law: multinomial draws given that the totals come out), first to groups of
shards, then by a task per group to its shards. Slot j of a source
takes block p(j mod blocks), p being a pseudorandom permutation of the source's block indices (a Feistel network
with cycle walking), so that no block is taken again before all have been, and the blocks are joined by index.

Words of a document that are in a block taken k times are taken k times. Reruns give the same mix. A block is
taken at most ceil(slots / blocks) times, which is 3 at most for targets of up to 3 times the source.

Defined results: sources are ordered by code point, null last, and weigh 5, 2, 1 in turn; documents without words
have size 0 and nothing is taken of them; a source without words has target 0. Repeated rows are documents of
their own. Further columns stay as they are in `mix`.
"""

from __future__ import annotations

from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, prepare

WEIGHTS = (5, 2, 1)
LIMIT = 3.0
#: Each source's stream is numbered in so many pieces, or in as many as hold PIECE_ROWS of the largest source's rows, so that none meets in one task.
PIECES, PIECE_ROWS = 256, 1_000_000
#: Output shards at least, and slots of a shard at most; slots that one task draws; sources whose table is broadcast.
N_SHARDS, SHARD_SLOTS, GROUP_SLOTS, BROADCAST_SOURCES = 256, 1 << 20, 1 << 16, 1 << 14


def targets(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Shares of the sum of sizes by weight, none above limit x its size; the excess goes to the others by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), [k for k, n in enumerate(sizes) if n > 0]
    while free:
        weight = sum(weights[k] for k in free)
        over = [k for k in free if total * weights[k] / weight > limit * sizes[k]]
        if not over:
            for k in free:
                out[k] = total * weights[k] / weight
            break
        for k in over:
            out[k] = limit * sizes[k]
        total -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def even(total: int, n: int) -> np.ndarray:
    """Sizes of n shards that hold total slots, at most one apart."""
    return np.full(n, total // n, np.int64) + (np.arange(n) < total % n)


def _share(rng: np.random.Generator, good: int, rest: int, take: int) -> int:
    """How many of `take` slots drawn without replacement are good ones (hypergeometric).

    numpy draws it exactly for up to 10^9 slots. Beyond, the binomial law stands for it where one side is small, else
    the normal law of the same mean and variance; neither can be told from it at that size.
    """
    n = good + rest
    if n < 10**9:
        return int(rng.hypergeometric(good, rest, take))
    few = min(good, rest, take, n - take)
    if few >= 10**6:
        share = good / n
        drawn = round(rng.normal(take * share, (take * share * (1 - share) * ((n - take) / (n - 1))) ** 0.5))
    elif few in (good, rest):
        drawn = int(rng.binomial(few, take / n))
        drawn = drawn if few == good else take - drawn
    else:
        drawn = int(rng.binomial(few, good / n))
        drawn = drawn if few == take else good - drawn
    return min(max(drawn, take - rest, 0), good, take)


def deal_to(slots: list[int] | np.ndarray, sizes: np.ndarray, seed: int | tuple[int, ...]) -> np.ndarray:
    """Counts by shard and source: the columns add up to slots, the rows to sizes."""
    rng, left = np.random.default_rng(seed), [int(n) for n in slots]
    out = np.zeros((len(sizes), len(left)), np.int64)
    for k, size in enumerate(sizes):
        take, rest = int(size), sum(left)
        for s, good in enumerate(left):
            rest -= good
            got = _share(rng, good, rest, take) if good and take else 0
            out[k, s] = got
            left[s] -= got
            take -= got
    return out


def deal(slots: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts by shard and source; the columns add up to slots and the rows are as even as can be."""
    return deal_to(slots, even(sum(slots), n_shards), seed)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of indices below n under a permutation of range(n) that key names."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def turn(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in range(4):
            mixed = (right + np.uint64((key * 4 + k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = turn(index.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = turn(out[far])
    return out.astype(np.int64)


def measured(docs: DataFrame) -> DataFrame:
    """docs with _size (its words) and _h (a hash of its text)."""
    return docs.withColumns({"_size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"), "_h": F.xxhash64("text")})


def number(docs: DataFrame, pieces: int = PIECES) -> DataFrame:
    """docs with _size, _s (the source's rank) and _start (words before it in its source's stream)."""
    rows = (docs if "_size" in docs.columns else measured(docs)).withColumn("_p", F.pmod(F.xxhash64(F.lit("piece"), "doc_id", "_h"), F.lit(pieces)).cast("int"))
    # by source and piece, at most `pieces` rows for each source
    sums = rows.groupBy("source", "_p").agg(F.sum("_size").alias("_n"))
    before = sums.select(F.col("source").alias("_src"), F.col("_p").alias("_q"), (F.sum("_n").over(Window.partitionBy("source").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.sum("_size").over(Window.partitionBy("source", "_p").orderBy("doc_id", "_h", "_size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = rows.withColumn("_inside", inside).join(before, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_p") == F.col("_q")))
    return placed.withColumn("_start", F.col("_before") + F.col("_inside")).drop("_src", "_q", "_before", "_inside", "_p", "_h")


class Plan:
    """Per source: rank, size, target, blocks and slots. Bounded by the number of sources."""

    def __init__(self, sizes: DataFrame, block: int, weights: tuple[float, ...], limit: float):
        found = sorted(sizes.collect(), key=lambda r: (r.source is None, r.source or ""))
        self.block, self.sources, self.sizes = block, [r.source for r in found], [r.n or 0 for r in found]
        self.most_rows = max((r.n_rows for r in found), default=0)
        self.targets = targets(self.sizes, [w for w, _ in zip(cycle(weights), found)], limit)  # noqa: B905
        self.blocks = [-(-n // block) for n in self.sizes]
        # a slot holds size / blocks words on average: the last block is shorter
        self.slots = [round(t * b / n) if n else 0 for t, b, n in zip(self.targets, self.blocks, self.sizes, strict=True)]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, *x) for k, x in enumerate(zip(self.sources, self.sizes, self.targets, strict=True))]
        return spark.createDataFrame(rows, "_rank int, _src string, _source_size long, _target double")


def slots(spark: SparkSession, plan: Plan, n_shards: int | None = None, seed: int = 17) -> DataFrame:
    """(shard, slot, rank, block): what each slot of the output holds.

    The driver deals counts to groups of shards, a task per group deals them on to its shards and draws the slots:
    the driver holds a count per group and source, a task GROUP_SLOTS slots or so. Shards grow in number, not in size.
    """
    prepare(spark)
    total, blocks = sum(plan.slots), plan.blocks
    n_shards = n_shards or max(N_SHARDS, -(-total // SHARD_SLOTS))
    n_groups = min(n_shards, max(8, -(-total // GROUP_SLOTS)))
    edges = [n_shards * g // n_groups for g in range(n_groups + 1)]
    sizes = even(total, n_shards)
    counts = deal_to(plan.slots, np.array([sizes[a:b].sum() for a, b in zip(edges, edges[1:], strict=False)], np.int64), seed)
    first = np.cumsum(counts, 0) - counts

    def drawn(batches):
        for pdf in batches:
            for g in pdf["id"]:
                at, own = edges[g], deal_to(counts[g], sizes[edges[g] : edges[g + 1]], (seed, int(g) + 1))
                start = first[g] + np.cumsum(own, 0) - own
                for k, s in zip(*np.nonzero(own), strict=True):
                    for low in range(0, int(own[k, s]), 1 << 16):
                        j = np.arange(start[k, s] + low, start[k, s] + min(int(own[k, s]), low + (1 << 16)))
                        yield pd.DataFrame({"shard": np.int64(at + k), "slot": j, "rank": np.int32(s), "block": permute(j % blocks[s], blocks[s], seed + int(s))})

    return spark.range(0, n_groups, 1, n_groups).mapInPandas(drawn, "shard long, slot long, rank int, block long")


def _parts(placed: DataFrame, block: int) -> DataFrame:
    """A row per document and block that it has words in: the words are [w, w + n) of the document."""
    b = F.col("block")
    rows = placed.where("_size > 0").select("_rank", "_start", "_size", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_size") - 1) / block))).alias("block"))
    low = F.greatest(b * block, F.col("_start")) - F.col("_start")
    return rows.select("_rank", "_start", "block", low.alias("w"), (F.least((b + 1) * block, F.col("_start") + F.col("_size")) - F.col("_start") - low).alias("n"))


def _setup(spark: SparkSession, docs: DataFrame, block: int, weights: tuple[float, ...], limit: float, n_shards: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """docs, as measured, with _rank, _start, _source_size and _target; and how often each block is taken."""
    plan = Plan(docs.groupBy("source").agg(F.sum("_size").alias("n"), F.count("*").alias("n_rows")), block, weights, limit)
    placed = number(docs, max(PIECES, plan.most_rows // PIECE_ROWS))
    by_source = plan.frame(spark)  # a row per source
    placed = placed.join(F.broadcast(by_source) if len(plan.sources) <= BROADCAST_SOURCES else by_source, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    # the optimizer takes the slots for as few as the rows that ask for them, and would broadcast them
    uses = slots(spark, plan, n_shards, seed).groupBy(F.col("rank").alias("_rank"), "block").agg(F.count("*").alias("uses")).hint("merge")
    return placed, uses


def taken(spark: SparkSession, docs: DataFrame, block: int = 128, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, n_shards: int | None = None, seed: int = 17) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    work = Workspace(spark, "mixing")
    sized = work.table(measured(docs.select("doc_id", "source", "text")).drop("text"))  # texts are read once
    placed, uses = _setup(spark, sized, block, weights, limit, n_shards, seed)
    placed = work.table(placed.select("doc_id", "_rank", "_start", "_size", "_source_size", "_target"))
    sums = _parts(placed, block).join(uses, ["_rank", "block"]).groupBy("_rank", "_start").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    some = placed.where("_size > 0").join(sums, ["_rank", "_start"], "left").drop("_rank", "_start")
    every = some.unionByName(placed.where("_size = 0").drop("_rank", "_start").withColumn("taken", F.lit(0).cast("long")))
    return every.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, block: int = 128, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, n_shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mix as documents with the columns of docs: pass k of a document holds its words taken at least k times.

    A pass that takes all words keeps the text unchanged; else the words taken are joined by a space.
    """
    names = {c: c if c in ("doc_id", "source", "text") else f"c{k}" for k, c in enumerate(docs.columns)}  # own names cannot clash
    placed, uses = _setup(spark, measured(docs.toDF(*names.values())), block, weights, limit, n_shards, seed)
    placed = placed.where("_size > 0").drop("_source_size", "_target")
    parts = _parts(placed, block).join(uses, ["_rank", "block"])
    each = parts.groupBy("_rank", "_start").agg(F.array_sort(F.collect_list(F.struct("w", "n", "uses"))).alias("_parts"))  # bounded by the document
    rows = placed.join(each, ["_rank", "_start"]).withColumn("_pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_parts", lambda p: p.uses)).cast("int"))))
    used = F.filter("_parts", lambda p: p.uses >= F.col("_pass"))
    whole = F.aggregate(used, F.lit(0).cast("long"), lambda acc, p: acc + p.n) == F.col("_size")
    words: Column = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))  # bound to a variable below, to be found once
    some = F.get(F.transform(words, lambda x: F.array_join(F.flatten(F.transform(used, lambda p: F.slice(x, (p.w + 1).cast("int"), p.n.cast("int")))), " ")), 0)
    return rows.withColumn("text", F.when(whole, F.col("text")).otherwise(some)).select(*[F.col(own).alias(c) for c, own in names.items()])
