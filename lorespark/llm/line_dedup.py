"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches, ranges of doc_id. Lines are hashed once and kept as (key, doc_id, place). A run is a
table of distinct keys sorted by key; when a level holds `fan_in` runs they are merged into one of the next level.

The first pass counts: each batch adds a run of (key, documents), from which the keys of at least `min_docs` documents
follow. The second pass goes through the batches by descending doc_id: a batch merge-anti-joins its repeated keys with
the runs of keys already placed; those left are placed here, at their largest doc_id, and form the batch's own run. All
other lines of repeated keys go.

Keys are MD5 hashes (128 bits) of the stripped, ASCII-lower-cased line; only lines of `min_chars` code points count.
Counting combines within each task before any shuffle, so a line that all documents share costs a row a task.

Defined results: a null or empty text is one empty line, which is too short to be a key. Rows without doc_id
neither count nor lose lines. Rows that repeat a doc_id are one document for counting, each cleaned by itself.
Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: str | Column) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def key_of(line: Column, min_chars: int) -> Column:
    """The hash of a line's key; null for keys that are too short."""
    key = F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key.cast("binary"))))


class LineRuns:
    """The runs, by level, each a table in the shared folder sorted by hash."""

    def __init__(self, work: Workspace, fan_in: int = 2):
        self.work, self.fan_in, self.levels = work, fan_in, [[]]

    def add(self, keys: DataFrame) -> None:
        """keys: (key, doc_id) of a batch whose doc_ids no earlier batch had."""
        self.add_run(keys.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc")))

    def add_run(self, run: DataFrame) -> None:
        """run: distinct keys with n_docs and last_doc."""
        self.levels[0].append(self.work.table(run, ["key"]))
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            merged = self.work.table(self._merged(self.levels[level]), ["key"])
            for old in self.levels[level]:
                self.work.drop(old)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for run in runs[1:]:
            both = both.union(run)
        return both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def merged(self) -> DataFrame:
        """(key, n_docs, last_doc) over all runs."""
        runs = [run for level in self.levels for run in level]
        return runs[0] if len(runs) == 1 else self._merged(runs)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of keys whose key is in no run, by a merge with each run."""
        for level in self.levels:
            for run in level:
                keys = keys.join(run.select("key").hint("merge"), "key", "left_anti")
        return keys


def batches_of(docs: DataFrame, n: int) -> list[Column]:
    """Conditions that split docs into n ranges of doc_id, together every row that has one."""
    cuts = sorted(set(docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    doc, ends = F.col("doc_id"), [None, *cuts, None]
    return [doc.isNotNull() & (F.lit(True) if a is None else doc > a) & (F.lit(True) if b is None else doc <= b) for a, b in zip(ends, ends[1:], strict=False)]


def dropped(work: Workspace, lines: DataFrame, min_docs: int, n_batches: int, fan_in: int) -> DataFrame:
    """lines: a table (key, doc_id, ...). Its rows that go: repeated keys anywhere but in the largest doc_id that has them."""
    counts, batches = LineRuns(work, fan_in), batches_of(lines, n_batches)
    for batch in batches:
        counts.add(lines.where(batch).select("key", "doc_id"))
    again = counts.merged().where(F.col("n_docs") >= min_docs).select("key")
    lines = work.table(lines.join(again, "key", "left_semi"))
    placed, out = LineRuns(work, fan_in), []
    for batch in reversed(batches):
        own = lines.where(batch)
        top = own.groupBy("key").agg(F.max("doc_id").alias("last_doc"))
        here = work.table(placed.unseen(top), ["key"])
        out.append(own.join(here, "key", "left").where(F.col("last_doc").isNull() | (F.col("doc_id") < F.col("last_doc"))).drop("last_doc"))
        if len(out) < len(batches):
            placed.add_run(here.select("key", F.lit(1).cast("long").alias("n_docs"), "last_doc"))
    every = out[0]
    for some in out[1:]:
        every = every.unionByName(some)
    return every


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, n_batches: int = 4, fan_in: int = 2) -> DataFrame:
    """docs with the text cleaned, and n_lines, n_dropped (columns of these names are replaced)."""
    work = Workspace(spark, "line-dedup")
    # h tells rows of one doc_id and unlike texts apart
    h = F.xxhash64("text")
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", h.alias("_h"), F.posexplode(F.transform(lines_of("text"), lambda x: key_of(x, min_chars))).alias("pos", "key"))
    lines = work.table(lines.where("key IS NOT NULL"))
    gone = dropped(work, lines, min_docs, n_batches, fan_in).groupBy("doc_id", "_h").agg(F.collect_set("pos").alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("_h").alias("_h2"), "_gone")
    names = {c: c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)}  # own names cannot clash
    rest = docs.toDF(*names.values()).withColumn("_h", h).join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_h2")), "left")
    each = lines_of("text")
    # bound to a variable, else each kept line would split the text anew
    kept = F.transform(F.array(each), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda k: F.get(x, k)), "\n"))
    rest = rest.withColumns({
        "_n_lines": F.size(each).cast("long"),
        "_n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.get(kept, 0)),
    })
    out = [F.col(own).alias(c) for c, own in names.items() if c not in ("n_lines", "n_dropped")]
    return rest.select(*out, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))
