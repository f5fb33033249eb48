"""Streams run to their end give what their batch twins give."""

import datetime
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespark.fixtures import table
from lorespark.operators import usage
from lorespark.streaming import operators as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """The curiosity view in three files, written one after the other in order of time: a file stream goes by the time of writing."""
    at = str(tmp_path_factory.mktemp("events"))
    rows = table(spark, SF, "fx_curiosity").withColumn("user_id", F.col("event_id") % 7)
    cuts = [r.ts for r in rows.orderBy("ts").collect()][:: rows.count() // 3 + 1]
    for low, high in zip(cuts, [*cuts[1:], None], strict=True):
        part = rows.where((F.col("ts") >= F.lit(low)) & (F.lit(True) if high is None else F.col("ts") < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(at)
    schema = spark.read.parquet(at).schema
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return df.sparkSession.table(name)


def test_daily_counts(spark, stream, tmp_path):
    got = {r.day: r.n for r in run(S.daily_counts(stream()), "daily", "complete", tmp_path).collect()}
    want = Counter(r.d for r in table(spark, SF, "fx_curiosity").select(F.col("ts").cast("date").alias("d")).collect())
    assert got == dict(want)


def test_decayed_interest(spark, stream, tmp_path):
    rows = run(S.decayed_interest(stream()), "decay", "update", tmp_path).collect()
    last = {}
    for r in rows:
        if (r.domain, r.tag) not in last or r.last_us >= last[r.domain, r.tag].last_us:
            last[r.domain, r.tag] = r
    want = {(r.domain, r.tag): r.weight for r in usage.decayed_interest(table(spark, SF, "fx_curiosity")).collect()}
    assert set(want) == set(last) and all(abs(last[k].weight - want[k]) < 1e-4 for k in want)


def test_late_interest_adds_without_decay(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    times = [[10, 30], [0, 29], [40]]  # days by batch; the second is late
    for batch in times:
        rows = [("d", "t", day + datetime.timedelta(days=k)) for k in batch]
        spark.createDataFrame(rows, "domain string, tag string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("domain string, tag string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [r.weight for r in run(S.decayed_interest(stream), "late", "update", tmp_path).collect()]
    first = 1 + math.exp(-2)
    assert sorted(got) == pytest.approx(sorted([first, first + 2, 1 + (first + 2) * math.exp(-1)]))


def test_running_cost_and_trailing(spark, stream, tmp_path):
    costs = stream().select(F.col("user_id").alias("run_id"), F.lit(0.5).alias("cost_usd"))
    rows = run(S.running_cost(costs), "costs", "complete", tmp_path).collect()
    assert sum(r.cost for r in rows) == 500.0 and all(r.alert for r in rows)
    assert run(S.trailing_counts(stream()), "trailing", "complete", tmp_path).count() > 30
    assert run(S.sessions(stream()), "sess", "append", tmp_path).count() > 0


def test_incremental_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "source_path string, content string")
    docs.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("a", "x"), ("b", "old")], "source_path string, content string").withColumn("content_hash", F.sha2("content", 256)).drop("content")
    got = []
    q = S.incremental_index(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), lambda: known, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r.source_path, r.action) for r in got} == {("b", "replace"), ("c", "new")}
