"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions only.

A key's shard follows from the key and the number of shards alone: no table of the ring exists, and with one more
shard a key stays where it is or moves to the new shard, as 1/(n+1) of the keys do.

The published generator multiplies modulo 2^64; as SQL integers do not wrap, the state is held as two halves of
32 bits and multiplied in limbs of 16, none of whose sums leaves 63 bits.

Defined results: keys that are no integers are hashed to 64 bits; a null key is the key 0; a null text is the empty one (size 1, checksum 0). Equal rows share a
shard and get slots of their own. An empty table gives no rows. Further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The multiplier of the published generator, in two halves of 32 bits.
HIGH, LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: A shard's slots are numbered in so many pieces, or in as many as hold PIECE_ROWS rows each.
PIECES, PIECE_ROWS = 512, 1_000_000
#: Jumps follow a key from shard to shard upwards, about ln(n) of them; so many are never reached.
MAX_JUMPS = 256


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * multiplier + 1 modulo 2^64."""
    l0, l1 = lo.bitwiseAND(0xFFFF), F.shiftright(lo, 16)
    h0, h1 = hi.bitwiseAND(0xFFFF), F.shiftright(hi, 16)
    p0, p1 = l0 * LOW + 1, l1 * LOW
    low = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(low, 32) + F.shiftright(p1, 16)

    def part(a0: Column, a1: Column, by: int) -> Column:
        """The low 32 bits of a * by."""
        return (a0 * by + F.shiftleft((a1 * by).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)

    return (carry + part(h0, h1, LOW) + part(l0, l1, HIGH)).bitwiseAND(MASK), low.bitwiseAND(MASK)


def jump(key: Column, *n_shards: int) -> list[Column]:
    """The shard of a bigint key for each number of shards. One walk serves them all."""
    most = max(n_shards)
    zero = F.lit(0).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(MASK).alias("lo"), zero.alias("j"), *[zero.alias(f"s{n}") for n in n_shards])

    def step(a: Column, _: Column) -> Column:
        hi, lo = _next(a.hi, a.lo)
        here = a.j
        j = F.floor((here + 1) * (F.lit(2.0**31) / (F.shiftrightunsigned(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), j.alias("j"), *[F.when(here < n, here).otherwise(a[f"s{n}"]).alias(f"s{n}") for n in n_shards])
        return F.when(here < most, moved).otherwise(a)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(most, MAX_JUMPS))), start, step)
    return [end[f"s{n}"].cast("int") for n in n_shards]


def shards(docs: DataFrame, n_shards: int = 8, key: str = "doc_id") -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (columns of these names are replaced)."""
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # own names cannot clash
    own = names[key]
    number = F.col(own).cast("long") if isinstance(docs.schema[key].dataType, T.IntegralType) else F.when(F.col(own).isNotNull(), F.xxhash64(own))
    text = F.coalesce(names["text"], F.lit("")).cast("binary")
    here, grown = jump(F.coalesce(number, F.lit(0).cast("long")), n_shards, n_shards + 1)
    out = docs.toDF(*names.values()).withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text), "law": F.lit("key"), "shard": here, "grown_shard": grown})
    # slots: numbered within pieces of a shard, so that a shard is never sorted in one task
    pieces = max(PIECES, docs.count() // (n_shards * PIECE_ROWS))
    piece = F.pmod(F.xxhash64(F.lit("slot"), own, "text_crc32"), F.lit(pieces)).cast("int")
    out = out.withColumn("_piece", piece)
    counts = out.groupBy("shard", "_piece").agg(F.count("*").alias("_n"))  # n_shards x pieces rows at most
    before = counts.select("shard", "_piece", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy(own, "text_crc32", "size")) - 1
    out = out.withColumn("_inside", inside).join(F.broadcast(before) if n_shards * pieces <= 1 << 19 else before, ["shard", "_piece"])
    slot = (F.col("_before") + F.col("_inside")).cast("long").alias("slot")
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in added], "size", "text_crc32", "law", "shard", slot, "grown_shard")
