"""Row numbers over a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_pieces(rows: DataFrame, columns: list[str]) -> Column:
    """A piece for each row, as many as shuffle partitions, where any order will do."""
    return F.pmod(F.xxhash64(*columns), F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def range_pieces(rows: DataFrame, column: str) -> Column:
    """A piece for each row by ranges of a number, in its order; the cuts are fixed here, so that they hold in every evaluation."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.select(F.percentile_approx(column, [k / n for k in range(1, n)])).first()[0] or [])) if n > 1 else []
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col(column))).cast("long") if cuts else F.lit(0).cast("long")


def numbered_on(rows: DataFrame, piece: Column, order: list) -> DataFrame:
    """rows with _n, 1, 2, ... by piece, then by order: pieces number their rows, and counts of pieces, a number each, give the rest."""
    placed = rows.withColumn("_p", piece)
    counts = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect())
    starts, before = {}, 0
    for p, n in counts:
        starts[p] = before
        before += n
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), F.col("_p")) if starts else F.lit(0)
    return placed.withColumn("_n", offset + F.row_number().over(Window.partitionBy("_p").orderBy(*order))).drop("_p")
