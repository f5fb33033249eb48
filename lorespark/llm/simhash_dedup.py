"""SimHash near-dedup with multi-index hashing (Norouzi et al., 2012).

A fingerprint has 64 bits: bit k is set if more than half of the XXH64 hashes (seed 42) of the text's shingles
have it set. Fingerprints within `max_bits` bits are linked. They are cut into `N_SEGMENTS` segments; two that are
that near differ in at most floor(max_bits / N_SEGMENTS) bits of some segment, so each fingerprint looks up, per
segment, every value of that small Hamming ball in the segment's table, and whole distances are verified.

Equal fingerprints are collapsed first. Lookups keep a row per value found, not per pair; pairs are compared
within a bucket, in blocks, and leave as edges of a spanning forest, so that neither a group of many copies nor a
common segment makes rows as the square of its size. Nothing is capped.

`similar` is for similarities that 3 bits of 64 do not reach: fingerprints of 1024 bits over shingles of five words. Two
texts of Jaccard similarity s differ in about acos(2s / (1 + s)) / pi of the bits; fingerprints are linked that differ in at
most the 97.5 % quantile of what texts of the similarity asked for differ in, and whose numbers of distinct shingles are
no further apart than that similarity allows. Candidates come from 24 segments of 28 bits.
A bit that few shingles decide is the likelier to differ, so a segment's ball is enumerated over its `UNSURE` least sure
bits, the `PROBES` likeliest values of it, its own first. What shares a value of its own is linked first; a probe that then
finds only members of its own component would tell nothing new, and is left out, so that groups of near copies do not look each
other up once more. The ball is a filter with a recall below one, the higher the more alike
texts are: tests hold it to 0.9 of pairs at the similarity asked for, and the README has it measured.

Defined results: a text without words has fingerprint 0 and links like any other; fewer words than a shingle are one
shingle. A row without doc_id takes no part in naming: its component is the smallest doc_id that it links with,
null if it has none. Repeated rows and doc_ids keep a row each. Further columns stay as they are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, block_pairs, by_group, components, prepare, roots

SHINGLE, SEED, MAX_BITS = 3, 42, 3
N_SEGMENTS = 2
WIDE_SHINGLE, WIDE_BITS, WIDE_SEGMENTS, WIDTH = 5, 1024, 24, 28
UNSURE, PROBES = 4, 12
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    prepare(docs.sparkSession)

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, F.pandas_udf(each, "long")("text"))


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """Further 64 bits for each hash (the finalizer of splitmix64)."""
    x = x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_votes(text: str | None, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, int]:
    """For each of WIDE_BITS bits, of the hash and what is mixed from it: shingles that have it set, less those that have not; and distinct shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    ones = np.zeros(WIDE_BITS, np.int64)
    if not words:
        return ones, 0
    grams = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], np.uint64)
    for at in range(0, len(hashes), 255):  # so many that counts of a byte do not run over
        wide = np.stack([_mixed(hashes[at : at + 255], k) for k in range(WIDE_BITS // 64)], 1)
        ones += np.add.reduce(np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little"), 0, np.uint8)
    return 2 * ones - len(hashes), len(np.unique(hashes))


#: Subsets of the least sure bits, none first.
_SUBSETS = (np.arange(1 << UNSURE)[:, None] >> np.arange(UNSURE)) & 1


def probes_of(votes: np.ndarray) -> np.ndarray:
    """(rows, WIDE_SEGMENTS, PROBES) of votes (rows, WIDE_BITS): the likeliest values of each segment, marked by its number."""
    votes = votes[:, : WIDE_SEGMENTS * WIDTH].reshape(len(votes), WIDE_SEGMENTS, WIDTH)
    own = ((votes > 0) << np.arange(WIDTH, dtype=np.int64)).sum(-1)
    unsure = np.argsort(np.abs(votes), -1, "stable")[..., :UNSURE]
    cost = np.take_along_axis(np.abs(votes), unsure, -1) @ _SUBSETS.T
    likeliest = np.argsort(cost, -1, "stable")[..., :PROBES]
    flips = np.take_along_axis((1 << unsure.astype(np.int64)) @ _SUBSETS.T, likeliest, -1)
    return (own[..., None] ^ flips) | (np.arange(WIDE_SEGMENTS, dtype=np.int64) << WIDTH)[:, None]


def with_wide(docs: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """docs with wide (the fingerprint), size (distinct shingles), probes (the values that it looks up, PROBES a segment) and fp (a hash of the first two, which names it)."""
    prepare(docs.sparkSession)

    def each(texts: pd.Series) -> pd.DataFrame:
        found = [wide_votes(t, shingle) for t in texts]
        votes = np.array([v for v, _ in found]).reshape(len(texts), WIDE_BITS)
        wide = np.packbits(votes > 0, axis=1, bitorder="little")
        return pd.DataFrame({"wide": [x.tobytes() for x in wide], "size": [n for _, n in found], "probes": list(probes_of(votes).reshape(len(texts), -1))})

    made = docs.withColumn("_made", F.pandas_udf(each, "wide binary, size long, probes array<long>")("text"))
    return made.withColumns({"wide": F.col("_made.wide"), "size": F.col("_made.size"), "probes": F.col("_made.probes"), "fp": F.xxhash64("_made.wide", "_made.size")}).drop("_made")


def _masks(bits: int, radius: int) -> list[int]:
    """What turns a segment into another value of its ball, itself left out."""
    return [sum(1 << k for k in some) for r in range(1, radius + 1) for some in combinations(range(bits), r)]


def _near(pdf: pd.DataFrame, max_bits: int, similarity: float = 0.0) -> pd.DataFrame | None:
    """Edges of a forest over the fingerprints of a bucket: owners of the value against all."""
    owner, side, name = pdf.owner.to_numpy(), pdf.side.to_numpy(), pdf.fp.to_numpy()
    if len(name) < 2:
        return None
    if "wide" in pdf:
        fp = np.frombuffer(b"".join(pdf.wide), np.uint32).reshape(len(name), -1)
    else:
        fp = name.view(np.uint64)[:, None]
    own, cross = np.flatnonzero(owner), pdf.i.iloc[0] != pdf.j.iloc[0]
    found_a, found_b = [], []
    for at in range(0, len(own), 256):
        some = own[at : at + 256]
        apart = np.zeros((len(some), len(fp)), np.uint16)
        for k in range(fp.shape[1]):
            apart += np.bitwise_count(fp[some, k][:, None] ^ fp[None, :, k])
        near = apart <= max_bits
        if similarity:  # sets of sizes further apart cannot be so alike
            a, b = pdf["size"].to_numpy()[some][:, None], pdf["size"].to_numpy()[None, :]
            near &= np.minimum(a, b) >= similarity * np.maximum(a, b)
        if cross:
            near &= side[some][:, None] != side[None, :]
        a, b = np.nonzero(near)
        found_a.append(some[a])
        found_b.append(b)
    if not found_a:
        return None
    label = roots(len(fp), np.concatenate(found_a), np.concatenate(found_b))
    some = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"a": name[some], "b": name[label[some]]}) if len(some) else None


def links(work: Workspace, fps: DataFrame, max_bits: int = MAX_BITS, n_segments: int = N_SEGMENTS) -> DataFrame:
    """Edges (a, b) over distinct fingerprints fp, whose components are those of all pairs within max_bits."""
    width = 64 // n_segments
    piece = [F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << width) - 1) for k in range(n_segments)]
    table = fps.select("fp", F.posexplode(F.array(*piece)).alias("seg", "value"))
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(width, max_bits // n_segments)])
    probes = table.withColumn("mask", F.explode(masks)).select("seg", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), "fp")
    owners = table.groupBy("seg", "value").agg(F.count("*").alias("n"))
    # both are exploded, and far larger than Spark takes them for: left to itself it may broadcast the probes
    hits = work.table(probes.hint("merge").join(owners.select("seg", "value"), ["seg", "value"]))
    busy = hits.select("seg", "value").union(owners.where("n > 1").select("seg", "value")).distinct()
    return _met(table, hits, busy, ["seg", "value"], None, max_bits)


def _met(table: DataFrame, hits: DataFrame | None, busy: DataFrame, keys: list[str], wide: DataFrame | None, max_bits: int, similarity: float = 0.0) -> DataFrame:
    """Edges of what meets in the busy values: table and hits are (keys, fp), the values that are and those that were looked up.

    Both carry names alone; wide (fp, wide, size) joins what has met.
    """
    rows = table.join(busy, keys, "left_semi").select(*keys, "fp", F.lit(True).alias("owner"))
    if hits is not None:
        rows = rows.union(hits.select(*keys, "fp", F.lit(False)))
    if wide is not None:
        rows = rows.join(wide, "fp")
    dealt = block_pairs(rows, keys, "fp", BLOCK)
    return by_group(dealt, [*keys, "i", "j"], lambda pdf: _near(pdf, max_bits, similarity), "a long, b long")


def _grouped(work: Workspace, marked: DataFrame, fps: DataFrame, edges: DataFrame) -> DataFrame:
    group = components(work, edges)
    named = fps.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    lowest = named.groupBy("group").agg(F.min("low_id").alias("component_id"))
    by_fp = named.select("fp", "group").join(lowest, "group").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, work: Workspace | None = None) -> DataFrame:
    """A row per row of docs: doc_id, fp, component_id (smallest doc_id of its group)."""
    work = work or Workspace(spark, "simhash")
    marked = work.table(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    fps = work.table(marked.groupBy("fp").agg(F.min("doc_id").alias("low_id")))
    return _grouped(work, marked, fps, links(work, fps, max_bits))


def wide_distance(similarity: float, sure: float = 1.96) -> int:
    """In how many bits texts of this Jaccard similarity differ at most, but for the `sure` tail of the normal law (1.96: 2.5 %)."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE_BITS * p + sure * np.sqrt(WIDE_BITS * p * (1 - p)))


def similar(spark: SparkSession, docs: DataFrame, similarity: float = 0.8, shingle: int = WIDE_SHINGLE, work: Workspace | None = None) -> DataFrame:
    """As near_duplicates, by wide fingerprints; fp names one."""
    work = work or Workspace(spark, "simhash-wide")
    marked = work.table(with_wide(docs.select("doc_id", "text"), shingle).select("doc_id", "fp", "wide", "size", "probes"))
    fps = work.table(marked.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.first("wide").alias("wide"), F.first("size").alias("size"), F.first("probes").alias("probes")))
    wide, bits = fps.select("fp", "wide", "size"), wide_distance(similarity)
    own = F.filter("probes", lambda v, k: k % PROBES == 0)
    table = fps.select("fp", F.explode(own).alias("value"))
    shared = table.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    first = work.table(_met(table, None, shared, ["value"], wide, bits, similarity))
    group = components(work, first).withColumnRenamed("node", "fp")
    named = work.table(fps.join(group, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "probes"))
    owners = named.select("component", F.explode(own).alias("value")).groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    probes = named.select("fp", "component", F.explode(F.array_except("probes", own)).alias("value"))
    new = (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
    hits = work.table(probes.hint("merge").join(owners, "value").where(new).select("value", "fp"))
    more = _met(table, hits, hits.select("value").distinct(), ["value"], wide, bits, similarity)
    return _grouped(work, marked.select("doc_id", "fp"), fps.select("fp", "low_id"), first.union(more))


def drop_duplicates(spark: SparkSession, docs: DataFrame, similarity: float | None = None, **how: int) -> DataFrame:
    """docs with one document of each group: that of the smallest doc_id (of rows that repeat it, one).

    Groups are those of `similar` if a similarity is given, else of near_duplicates. Rows without doc_id stay only if
    their group has no other.
    """
    work = Workspace(spark, "simhash-groups-of")
    grouped = near_duplicates(spark, docs, work=work, **how) if similarity is None else similar(spark, docs, similarity, work=work, **how)
    grouped = Workspace(spark, "simhash-groups").table(grouped)
    work.clear()
    groups = grouped.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    if not docs.where("doc_id IS NULL").head(1):
        return kept
    names = {c: c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)}  # own names cannot clash
    nameless = docs.where("doc_id IS NULL").toDF(*names.values())
    nameless = (with_fingerprint(nameless, **how) if similarity is None else with_wide(nameless, **how)).dropDuplicates(["fp"])
    alone = grouped.where("component_id IS NULL").select("fp").distinct()
    return kept.unionByName(nameless.join(alone, "fp", "left_semi").select(*[F.col(own).alias(c) for c, own in names.items()]))
