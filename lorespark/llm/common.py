"""What the corpus operators share: the shared folder, cut lineage, components, grouped batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: What Python workers are started with: buffers of a batch go back to the system at its end, else each worker keeps its largest.
WORKER_ENV = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows of a batch that goes to a Python worker, unless the session has its own number: whole texts are long.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds what they hold."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine that has none, as in tests, a temporary one. A cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        defined = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not defined.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        at = defined.get() if defined.isDefined() else f"file://{tempfile.mkdtemp(prefix='lorespark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Workspace:
    """A folder of one operator call below the shared folder, for tables that cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, sort: list[str] | None = None) -> DataFrame:
        """Writes df and reads it again; a lost executor then costs at most the tasks since."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lorespark_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing reads any more."""
        self._remove(df._lorespark_path)

    def clear(self) -> None:
        """Removes all tables of this call; nothing may read them any more."""
        self._remove(self.root)

    def _remove(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges no longer change. Each
    step is a grouped minimum with map-side combine and an equi-join, so that a hub is never gathered in a
    task; the edges never outnumber those given.
    """
    now = work.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        spread = F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m")))
        after = work.table(small.select(spread.alias("e")).select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        work.drop(now)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        now = after
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def block_pairs(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Adds (i, j), i <= j: a group of more than `block` rows is dealt into blocks, and each pair of blocks meets once.

    A group, however large, thus never comes together in a task: at most two blocks do. Small groups stay
    whole as (0, 0). `side` tells the block of the row.
    """
    size = rows.groupBy(*keys).agg(F.count("*").alias("n_group")).where(F.col("n_group") > block)
    dealt = rows.join(size, keys, "left").withColumn("n_block", F.coalesce(F.ceil(F.col("n_group") / block), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64(F.lit(7), member), F.col("n_block")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_block") - 1)))
    return other.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("n_group", "n_block", "other")


def by_group(rows: DataFrame, keys: list[str], each: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """each(rows of a group) for every group, groups streamed in the order of their keys without a call of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(parts: Iterable[pd.DataFrame]) -> list[pd.DataFrame]:
            out = each(pd.concat(list(parts), ignore_index=True))
            return [] if out is None or not len(out) else [out]

        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            columns = [pdf[k].to_numpy() for k in keys]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            bounds = [0, *cuts.tolist(), len(pdf)]
            out: list[pd.DataFrame] = []
            for at, end in zip(bounds, bounds[1:], strict=False):
                key = tuple(c[at] for c in columns)
                if held and key != last:
                    out += done(held)
                    held = []
                held.append(pdf.iloc[at:end])
                last = key
            if out:
                yield pd.concat(out, ignore_index=True)
        if held and (out := done(held)):
            yield out[0]

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after
