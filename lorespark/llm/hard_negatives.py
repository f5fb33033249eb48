"""Hard negatives by a vector-approximation file.

Components become integers, floor(scale * x), and a score is the inner product of two rows of integers. Every dimension
is cut into `CELLS` cells at quantiles of a bounded sample, and a row's approximation is a byte a dimension, its cells. For an
anchor and a dimension a table holds the least and the largest product with a component of each cell; summing what the
rows' cells look up bounds their scores from below and above. Only rows whose bounds say that they may be an anchor's
positive, or enter the window of a positive, are scored, exactly and in 64 bits.

Anchors are a stated query set against all rows: rows and anchors are dealt into blocks by hash, whatever their labels, and each
pair of blocks meets in a task, which returns its best rows for each anchor; the best of all blocks follow by grouping. The
first pass finds the positives, the second the negatives of all windows of an anchor at once.

Defined results: rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no
part. A shorter vector counts as padded with zeros. Integers saturate at +-`LARGEST`, that no score leaves 64 bits. Equal
rows count once; an anchor never meets a row of its own vec_id, and unlike rows that share an anchor's vec_id are one anchor
whose rows are drawn from what each finds. Further columns are ignored, and an empty table gives none. An anchor without a positive, or a positive without a row in its window, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, prepare

CELLS = 64
#: Rows that the cells are fitted on, at most: those of the smallest hashes.
FIT_ROWS = 4096
#: Components of a block of rows or of anchors; anchors whose tables are looked up together; rows looked up together.
BLOCK_COMPONENTS, TOGETHER, STEP = 1 << 23, 32, 2048
#: Largest component: sums over 16,384 dimensions, times 100, stay within 64 bits.
LARGEST = (1 << 20) - 1


def integers(vector: Column, scale: int, dim: int) -> Column:
    own = F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST).cast("long")), F.lit(LARGEST).cast("long")).cast("int"))
    return F.concat(own, F.array_repeat(F.lit(0), F.lit(dim) - F.size(own)))


def taking_part(rows: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite)


def fit_cells(rows: DataFrame) -> np.ndarray:
    """(dim, CELLS - 1) edges: component x is in the cell of the edges <= x. From FIT_ROWS rows at most."""
    sample = rows.orderBy(F.xxhash64(F.lit(13), "vec_id"), "vec_id").limit(FIT_ROWS).select("v").collect()
    v = np.array([r.v for r in sample], np.int64)
    return np.ceil(np.quantile(v, np.arange(1, CELLS) / CELLS, axis=0)).T.astype(np.int64)


def approximate(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cells of rows of integers, a byte a dimension."""
    out = np.empty(v.shape, np.uint8)
    for d in range(v.shape[1]):
        out[:, d] = np.searchsorted(edges[d], v[:, d], side="right")
    return out


class Approximations:
    """The rows of a block as cells, with the least and largest component of each cell."""

    def __init__(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray, edges: np.ndarray):
        """low, high: the block's least and largest component a dimension, for the outer cells."""
        self.codes = np.ascontiguousarray(codes.T)
        self.low = np.concatenate([low[:, None], edges], 1)
        self.high = np.maximum(np.concatenate([edges - 1, high[:, None]], 1), self.low)  # a cell without values is never looked up

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dim, CELLS, anchors): the least and largest product of an anchor's component with a cell's."""
        most = max(np.abs(self.low).max(), np.abs(self.high).max()) * np.abs(anchors).max() * len(self.low)
        q = anchors.T[:, None, :].astype(np.int32 if most < 1 << 31 else np.int64)
        a, b = (x[:, :, None].astype(q.dtype) * q for x in (self.low, self.high))
        return np.minimum(a, b), np.maximum(a, b)

    def bounds(self, tables: tuple[np.ndarray, np.ndarray], start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, anchors): lower and upper bounds of the scores of rows [start, end)."""
        out = []
        for table in tables:
            total = table[0][self.codes[0, start:end]]
            for d in range(1, len(table)):
                total += table[d][self.codes[d, start:end]]
            out.append(total)
        return out[0], out[1]


def best(k: int, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    return np.lexsort((ids, -score))[:k]


def matrix(cells: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype).reshape(len(cells), -1)


def positives_in(rows: pd.DataFrame, anchors: pd.DataFrame, edges: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of each anchor's label in this block."""
    v, ids, labels = matrix(rows["v"], "<i4").astype(np.int64), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    made = Approximations(matrix(rows["codes"], "u1"), v.min(0), v.max(0), edges)
    out = []
    for at in range(0, len(anchors), TOGETHER):
        some = anchors.iloc[at : at + TOGETHER]
        q, own, own_labels = matrix(some["v"], "<i4").astype(np.int64), some["vec_id"].to_numpy(), some["label"].to_numpy()
        tables = made.tables(q)
        lower, upper = (np.concatenate(x) for x in zip(*(made.bounds(tables, s, s + STEP) for s in range(0, len(rows), STEP)), strict=True))
        for j in range(len(some)):
            fit = np.flatnonzero((labels == own_labels[j]) & (ids != own[j]))
            if len(fit) > k:  # at least k rows score no less than the k-th best lower bound
                fit = fit[upper[fit, j] >= np.partition(lower[fit, j], -k)[-k]]
            score = v[fit] @ q[j]
            out += [(own[j], ids[fit[p]], score[p]) for p in best(k, score, ids[fit])]
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")


def negatives_in(rows: pd.DataFrame, anchors: pd.DataFrame, edges: np.ndarray, k: int, low: int, high: int) -> pd.DataFrame:
    """The k best rows of another label in the window of each positive, in this block."""
    v, ids, labels = matrix(rows["v"], "<i4").astype(np.int64), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    made = Approximations(matrix(rows["codes"], "u1"), v.min(0), v.max(0), edges)
    out = []
    for at in range(0, len(anchors), TOGETHER):
        some = anchors.iloc[at : at + TOGETHER]
        q = matrix(some["v"], "<i4").astype(np.int64)
        tables = made.tables(q)
        lower, upper = (np.concatenate(x) for x in zip(*(made.bounds(tables, s, s + STEP) for s in range(0, len(rows), STEP)), strict=True))
        for j, (own, label, windows) in enumerate(zip(some["vec_id"], some["label"], some["windows"], strict=True)):
            other = np.flatnonzero((labels != label) & (ids != own))
            below, above = lower[other, j].astype(np.int64) * 100, upper[other, j].astype(np.int64) * 100
            for positive, score in zip(windows["ids"], windows["scores"], strict=True):
                least, most = low * score, high * score
                may = (above >= least) & (below <= most)
                inside = (below >= least) & (above <= most)
                if inside.sum() > k:  # at least k rows of the window score no less than this
                    may &= above >= np.partition(below[inside], -k)[-k]
                fit = other[may]
                exact = v[fit] @ q[j]
                fits = (exact * 100 >= least) & (exact * 100 <= most)
                fit, exact = fit[fits], exact[fits]
                out += [(own, positive, ids[fit[p]], score, exact[p]) for p in best(k, exact, ids[fit])]
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]).astype("int64")


def meet(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, each: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """each(block of rows, block of anchors) for every pair of blocks."""
    a = F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(n_rows)).cast("int")
    b = F.pmod(F.xxhash64(F.lit(2), "vec_id", "v"), F.lit(n_anchors)).cast("int")
    left = rows.withColumns({"_a": a, "_b": F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))})
    right = anchors.withColumns({"_a": F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))), "_b": b})

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return each(x, y) if len(x) and len(y) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")]).astype("int64")

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(run, schema)


def first(found: DataFrame, keys: list[str], score: str, member: str, k: int) -> DataFrame:
    """The first k of each key, with their rank. A block has sent k rows a key at most."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), member))
    return found.dropDuplicates().withColumn("rank", best).where(F.col("rank") <= k)


def mine(
    spark: SparkSession, rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first negatives of each positive.

    rows: vec_id, embedding, label. A negative has another label, and low * positive <= 100 * negative <= high * positive.
    """
    prepare(spark)
    work = Workspace(spark, "hard-negatives")
    rows = taking_part(rows).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0]
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dim:
        return spark.createDataFrame([], result)
    rows = rows.select("vec_id", "label", integers(F.col("embedding"), scale, dim).alias("v"), is_anchor.alias("anchor")).distinct()
    edges = fit_cells(rows)

    def code(batches):
        for pdf in batches:
            v = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), dim)
            yield pdf.assign(v=[x.tobytes() for x in v.astype("<i4")], codes=[x.tobytes() for x in approximate(v, edges)])

    coded = work.table(rows.mapInPandas(code, "vec_id long, label long, v binary, anchor boolean, codes binary"))
    anchors = coded.where("anchor").drop("anchor", "codes")
    coded = coded.drop("anchor")
    n, n_anchors = coded.count(), anchors.count()
    n_rows = max(-(-n * dim // BLOCK_COMPONENTS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_blocks = max(1, -(-n_anchors * dim // BLOCK_COMPONENTS))

    found = meet(coded, anchors, n_rows, n_blocks, lambda x, y: positives_in(x, y, edges, n_positives), "anchor_id long, positive_id long, positive_score long")
    positives = first(found, ["anchor_id"], "positive_score", "positive_id", n_positives)
    windows = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("w"))  # n_positives at most
    windows = windows.select("vec_id", F.struct(F.transform("w", lambda x: x.positive_id).alias("ids"), F.transform("w", lambda x: x.positive_score).alias("scores")).alias("windows"))
    anchors = work.table(anchors.join(windows, "vec_id"))
    found = meet(coded, anchors, n_rows, n_blocks, lambda x, y: negatives_in(x, y, edges, n_negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    out = first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
