"""What a text's chunks would be like at other sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import sentences, window_chunks
from .ranking import hope_grade, hope_parts, size_score
from .similarity import cohesion_of, near_share

# The sizes tried.
SIZES = (256, 512, 1024, 2048, 4096, 6000)


def chunk_sizes(df: DataFrame, key: str, text: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(key, max_tokens, chunk_count, avg_hope, hope_grade, duplicate_rate, recommendation): a row per text and size.

    A text is read once and cut at every size; chunks are scored as rows, and the sums of a text and size are combined before
    they are shuffled. Where a text fits it is one chunk, scored once for all such sizes; one alone is compared with nothing. Chunks
    are compared whole. Blank texts have no chunks and no rows.
    """
    n, none = F.char_length(text), F.array().cast("array<int>")
    own = [F.struct(F.when(n > 4 * size, F.array(F.lit(size))).otherwise(none).alias("sizes"), F.when(n > 4 * size, window_chunks(F.col(text), size)).alias("chunks")) for size in sizes]
    whole = F.struct(F.filter(F.array(*map(F.lit, sizes)), lambda size: n <= 4 * size).alias("sizes"), F.array(F.col(text)).alias("chunks"))
    each = df.select(key, F.explode(F.filter(F.array(*own, whole), lambda c: F.size(c.sizes) > 0)).alias("c"))
    each = each.select(key, "c.sizes", F.filter("c.chunks", lambda c: c != "").alias("chunks")).where(F.size("chunks") > 0)
    several = F.when(F.size("chunks") > 1, F.col("chunks")).otherwise(F.array().cast("array<string>"))
    each = each.select(key, "sizes", F.size("chunks").alias("chunk_count"), F.round(near_share(several), 12).alias("dup"), "chunks")
    rows = each.select(key, "sizes", "chunk_count", "dup", F.explode("chunks").alias("chunk")).withColumn("icc", F.round(cohesion_of(sentences(F.col("chunk"))), 3))
    by = [key, "max_tokens", "chunk_count", "dup"]
    names = ("rc", "icc", "dcc", "bi", "sc")
    parts = hope_parts(rows, [key, "sizes", "chunk_count", "dup", "icc"]).withColumn("max_tokens", F.explode("sizes"))
    means = parts.withColumn("sc", size_score(F.col("n"), F.col("max_tokens"))).groupBy(*by).agg(*[F.round(F.avg(c), 3).alias(c) for c in names])
    scored = means.withColumn("avg_hope", F.round(sum((F.col(c) for c in names), F.lit(0.0)) / len(names), 3))
    good, dup = F.col("avg_hope") >= 0.7, F.col("dup")
    verdict = F.when((F.col("chunk_count") == 1) & good, "OPTIMAL").when(good & (dup < 0.15), "GOOD").when(dup >= 0.3, "HIGH_DUPLICATION").when(F.col("avg_hope") < 0.5, "POOR_QUALITY").otherwise("OK")
    return scored.select(key, "max_tokens", "chunk_count", "avg_hope", hope_grade(F.col("avg_hope")).alias("hope_grade"), F.round(dup, 3).alias("duplicate_rate"), verdict.alias("recommendation"))
