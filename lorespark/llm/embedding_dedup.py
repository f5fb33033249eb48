"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Every vector is projected on `N_COUNT` random directions. Each projection is sorted, and a vector looks at the window of
`window` about its own value; the collisions of a pair over all projections are counted, and pairs that reach the
calibrated count are verified by their cosine in double precision. So that this never takes all pairs, vectors first
enter lists: those of the directions, out of a larger set, on which their projections are largest (a direction and its
opposite hold a list each; beyond `MOST` directions a list is a combination of one of each of several sets). Windows are
sorted within a list. The number of lists of a vector and the count are calibrated together on simulated pairs at exactly
the threshold, so that at least `recall` of them share a list and reach the count.

Equal vectors are collapsed first and count with their number. The result is a row per vector: its links, its
component's smallest vec_id, and whether it is that vector; pairs are never written out. A list of any length is
dealt in blocks, so that at most two blocks meet in a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
do vectors of unlike lengths. Repeated rows are vectors of their own. A row without vec_id links with nothing
and has no component. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, block_pairs, by_group, components, roots

BLOCK = 1024
#: Projections that are counted, and half a window, in deviations of the projected difference of a pair at the threshold.
N_COUNT, WIDE = 48, 0.67
#: Directions of a set at most, and lists of a vector in each set.
MOST, N_LISTS = 4096, (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48)
#: Copies of one vector from which rows find their group salted: more than this, and than a thousandth of all rows.
HOT, SALTS = 10000, 64


@functools.lru_cache(maxsize=8)
def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim, n)).standard_normal((dim, n))


def projections(unit: np.ndarray) -> np.ndarray:
    return unit @ directions(unit.shape[1], N_COUNT, 7)


def nearest(unit: np.ndarray, n: int, n_lists: int, level: int) -> np.ndarray:
    """For each row the n_lists of a set's n directions on which its projection is largest. List 2k+1 is opposite to 2k."""
    k, out = min(n_lists, n), []
    for at in range(0, len(unit), 512):
        p = unit[at : at + 512] @ directions(unit.shape[1], n, 11 + level)
        top = np.argpartition(-np.abs(p), k - 1, axis=1)[:, :k]
        out.append(top * 2 + (np.take_along_axis(p, top, 1) < 0))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def place(unit: np.ndarray, n: int, n_lists: int, sets: int = 1) -> np.ndarray:
    """The lists of each row: every combination of one of its lists from each set."""
    out = np.zeros((len(unit), 1), np.int64)
    for level in range(sets):
        out = (out[:, :, None] * (2 * n) + nearest(unit, n, n_lists, level)[:, None, :]).reshape(len(unit), -1)
    return out


def shape(n: int, per_list: int) -> tuple[int, int]:
    """(directions of a set, sets) at which lists hold about per_list of n vectors, each being in four a set."""
    for sets in itertools.count(1):
        each = max(16.0, (max(1, n) * 4.0**sets / per_list) ** (1 / sets) / 2)
        if (n_dir := 1 << int(np.ceil(np.log2(each)))) <= MOST:
            return n_dir, sets


def calibrate(dim: int, n_dir: int, sets: int, threshold: float, recall: float, window: float) -> tuple[int, int]:
    """(n_lists, count): half of the loss allowed goes to the count, and the fewest lists are taken that keep `recall` of pairs at the threshold."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, dim))
    y -= (y * x).sum(1, keepdims=True) * x
    length = np.linalg.norm(y, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(1 - threshold**2) * np.divide(y, length, out=np.zeros_like(y), where=length > 0)
    met = (np.abs(projections(x) - projections(y)) <= window).sum(1)
    count = max(1, int(np.quantile(met, (1 - recall) / 2, method="lower")))
    for n_lists in N_LISTS:
        shared = np.ones(len(x), bool)
        for level in range(sets):
            a, b = nearest(x, n_dir, n_lists, level), nearest(y, n_dir, n_lists, level)
            shared &= (a[:, :, None] == b[:, None, :]).any((1, 2))
        if (shared & (met >= count)).mean() >= recall:
            break
    return n_lists, count


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def collisions(values: np.ndarray, window: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of rows that are in each other's window in at least `count` of the sorted projections."""
    n, met = len(values), np.zeros(len(values) ** 2, np.uint8)
    orders = np.argsort(values, axis=0, kind="stable")
    for order, value in zip(orders.T, values.T, strict=True):
        value = value[order]
        more = np.searchsorted(value, value + window, "right") - np.arange(n) - 1
        left = np.repeat(np.arange(n), more)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(more) - more, more)
        a, b = order[left], order[right]
        met[np.minimum(a, b) * n + np.maximum(a, b)] += 1  # a pair meets once a projection
    code = np.flatnonzero(met >= count)
    return code // n, code % n


def _least_shared(lists: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest list that each pair of rows shares."""
    step, out = max(1, (1 << 20) // lists.shape[1] ** 2), [np.empty(0, np.int64)]
    for k in range(0, len(a), step):
        x, y = lists[a[k : k + step]][:, :, None], lists[b[k : k + step]][:, None, :]
        out.append(np.where(x == y, x, np.iinfo(np.int64).max).min((1, 2)))
    return np.concatenate(out)


def _links(pdf: pd.DataFrame, threshold: float, window: float, count: int, kind: type) -> pd.DataFrame | None:
    if len(pdf) < 2:
        return None
    unit = _unit(np.stack([np.frombuffer(x, kind) for x in pdf.vector]))
    a, b = collisions(projections(unit), window, count)
    if pdf.i.iloc[0] != pdf.j.iloc[0]:
        side = pdf.side.to_numpy()
        a, b = a[keep := side[a] != side[b]], b[keep]
    cos = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", unit[a[k : k + 65536]], unit[b[k : k + 65536]]) for k in range(0, len(a), 65536))])
    a, b = a[cos >= threshold], b[cos >= threshold]
    keep = _least_shared(np.stack(pdf.lists.to_numpy()), a, b) == pdf.list.iloc[0]  # a pair counts in one list
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    rep, copies = pdf.rep.to_numpy(), pdf.copies.to_numpy()
    order = np.argsort(rep, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    root = rep[order][roots(len(pdf), rank[a], rank[b])]
    links = np.bincount(a, copies[b], len(pdf)) + np.bincount(b, copies[a], len(pdf))
    some = np.flatnonzero(links)
    return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "root": root[rank[some]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.975, per_list: int = 256) -> DataFrame:
    """A row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    work = Workspace(spark, "embedding-dedup")
    e = F.col("embedding")
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", sound.alias("sound"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    n, dim = rows.where("sound").agg(F.count("*"), F.max(F.size("embedding"))).first()
    n_dir, sets = shape(n, per_list)
    window = WIDE * float(np.sqrt(2 - 2 * threshold))
    n_lists, count = calibrate(dim or 1, n_dir, sets, threshold, recall, window)

    def placed(batches):
        for pdf in batches:
            length = pdf.embedding.map(len).to_numpy()
            for d in np.unique(length):
                part = pdf[length == d]
                full = np.stack([np.asarray(x, kind) for x in part.embedding])
                lists = place(_unit(full), n_dir, n_lists, sets)
                yield part[["k1", "k2", "rep", "copies"]].assign(dim=np.int32(d), vector=[x.tobytes() for x in full], lists=list(lists))

    reps = rows.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    at = work.table(reps.mapInPandas(placed, "k1 long, k2 long, rep long, copies long, dim int, vector binary, lists array<long>"))
    listed = block_pairs(at.select("rep", "copies", "dim", "vector", "lists", F.explode("lists").alias("list")), ["dim", "list"], "rep", BLOCK)
    found = by_group(listed, ["dim", "list", "i", "j"], lambda pdf: _links(pdf, threshold, window, count, kind), "rep long, links long, root long")
    found = work.table(found)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(work, found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    each = at.select("k1", "k2", "rep", "copies").join(linked, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    each = each.select("k1", "k2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    # groups of more than a thousandth of all rows, a thousand at most, meet their rows salted
    hot = F.col("copies") > max(HOT, n // 1000)
    each = each.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    large = at.where(hot).select("k1", "k2", F.lit(True).alias("hot"))
    ids = rows.where("sound").select("vec_id", "k1", "k2").join(F.broadcast(large), ["k1", "k2"], "left")
    ids = ids.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    out = ids.join(each, ["k1", "k2", "salt"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    out = out.union(rows.where("NOT sound").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
