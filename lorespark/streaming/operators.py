"""Streaming twins of the time-based operators. Event time is a timestamp in the session's zone (UTC)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.knowledge import reindex_plan
from ..sources.files import parse_log


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """timestamp_ntz cannot carry a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day", *keys: str) -> DataFrame:
    """Events a day, in append mode once the watermark has passed the day."""
    out = event_time(events).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("date").alias("day"), *keys, "n")


def trailing_counts(events: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """Events of the trailing period, sliding by a day."""
    out = event_time(events).withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day")).agg(F.count("*").alias("n"))
    return out.select(F.col("window.end").cast("date").alias("until"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    out = event_time(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_cost(traces: DataFrame, alert: float = 1.0) -> DataFrame:
    """Cost by run so far, in update mode."""
    return traces.groupBy("run_id").agg(F.sum("cost_usd").alias("cost")).withColumn("alert", F.col("cost") > alert)


def decayed_interest(events: DataFrame, rate: float = 0.1) -> DataFrame:
    """The stored weight of each (domain, tag) after each batch; the state is (weight, latest microsecond seen).

    An event earlier than the latest of former batches adds 1 without decay, and the latest stays.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, last = state.get if state.exists else (0.0, None)
        times = sorted(t for pdf in batches for t in pdf["at"].tolist())
        for t in times:
            last = t if last is None else last
            weight = 1.0 + weight * math.exp(-rate * (max(t - last, 0) // 86_400_000_000))
            last = max(t, last)
        state.update((weight, last))
        yield pd.DataFrame([(*key, weight, last)], columns=["domain", "tag", "weight", "last_us"])

    rows = events.select("domain", "tag", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("domain", "tag").applyInPandasWithState(fold, "domain string, tag string, weight double, last_us long", "weight double, last_us long", "update", GroupStateTimeout.NoTimeout)


def distinct_content(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """The first document of each content within the watermark."""
    hashed = event_time(docs).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    return hashed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def incremental_index(docs: DataFrame, known: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of (source_path, content) is planned against what is known and given to write, skips left out."""

    def batch(df: DataFrame, n: int) -> None:
        write(reindex_plan(df, known()).where("action <> 'skip'"), n)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile(propositions: DataFrame, state: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame], save: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Propositions of a source in order: round k holds the k-th of every source, and sees what earlier rounds did.

    The loop is over ordinals within a source, tens at most; rows stay distributed.
    """

    def batch(df: DataFrame, _: int) -> None:
        last = df.agg(F.max("ordinal")).first()[0]
        for k in range(0 if last is None else last + 1):
            save(apply(state(), df.where(F.col("ordinal") == k)))

    return propositions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_entries(files: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Entries of each micro-batch of log segments (content), parsed as the batch reader does."""
    return files.writeStream.foreachBatch(lambda df, n: write(parse_log(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(pages: DataFrame, jobs: dict[str, Callable[[DataFrame], None]], failed: Callable[[str, Exception], None], checkpoint: str) -> StreamingQuery:
    """Background work on each micro-batch (index, evaluation, graph): jobs are independent, one that fails is reported and stops no other."""

    def batch(df: DataFrame, _: int) -> None:
        df.persist()
        try:
            for name, job in jobs.items():
                try:
                    job(df)
                except Exception as e:  # noqa: BLE001  a job may fail in any way
                    failed(name, e)
        finally:
            df.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
