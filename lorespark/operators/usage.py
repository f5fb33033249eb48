"""Usage: traces, interests, runs, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .ranking import keyword_score


def trace_report(traces: DataFrame, *by: str) -> DataFrame:
    """Calls, latency, cost and error rate by the columns given, or over all."""
    return traces.groupBy(*by).agg(
        F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 1).alias("avg_latency"), F.round(F.sum("cost_usd"), 6).alias("cost"),
        F.round(F.avg(F.col("error").isNotNull().cast("double")), 3).alias("error_rate"),
    )


def session_cost(traces: DataFrame, alert: float = 1.0) -> DataFrame:
    cost = F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 8)
    return traces.groupBy("run_id").agg(cost.alias("cost")).withColumn("alert", F.col("cost") > alert)


def running_cost(traces: DataFrame, alert: float) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return traces.withColumn("running", F.round(F.sum("cost_usd").over(w), 8)).withColumn("alert", F.col("running") > alert)


def decayed_interest(events: DataFrame, rate: float = 0.1) -> DataFrame:
    """Per (domain, tag): w <- w exp(-rate floor(days since the last)) + 1, as a sum over prefix sums of the floored gaps."""
    w = Window.partitionBy("domain", "tag").orderBy("ts", "event_id")
    gap = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 86_400_000_000)
    gone = events.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("g", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = gone.groupBy("domain", "tag").agg(F.max("g").alias("total"))
    # gaps repeat: the sum goes over distinct prefix sums
    counted = gone.groupBy("domain", "tag", "g").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    out = counted.join(total, ["domain", "tag"]).groupBy("domain", "tag")
    return out.agg(F.round(F.sum(F.col("n") * F.exp(-rate * (F.col("total") - F.col("g")))), 6).alias("weight"), F.max("ts").alias("last_seen"))


def trend(weights: DataFrame) -> DataFrame:
    return weights.withColumn("trend", F.when(F.col("weight") >= 2, "rising").when(F.col("weight") < 0.5, "fading").otherwise("stable"))


def heatmap(events: DataFrame, as_of: str, days: int = 112) -> DataFrame:
    """Events a day over the last days, the last included, zeroes kept."""
    spark = events.sparkSession
    end = F.lit(as_of).cast("date")
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    counts = events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def latest_per_type(runs: DataFrame, newest: int = 100) -> DataFrame:
    """Of the newest runs overall the last of each type."""
    recent = runs.orderBy(F.desc("id")).limit(newest)
    return recent.withColumn("r", F.row_number().over(Window.partitionBy("eval_type").orderBy(F.desc("id")))).where("r = 1").drop("r")


def history_per_type(runs: DataFrame, n: int = 30) -> DataFrame:
    w = Window.partitionBy("eval_type")
    return runs.withColumn("r", F.row_number().over(w.orderBy(F.desc("id")))).where(F.col("r") <= n).withColumn("nth", F.row_number().over(w.orderBy("id"))).drop("r")


def frames(answers: DataFrame, text: str = "text", size: int = 8) -> DataFrame:
    """Answers with (frame_no, frame): so many words each; an answer without words has no frame."""
    w = words(F.col(text))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(size)), lambda k: F.array_join(F.slice("_w", k + 1, F.lit(size)), " "))
    return answers.withColumn("_w", w).where(F.size("_w") > 0).select("*", F.posexplode(each).alias("frame_no", "frame")).drop("_w")


def digest(entries: DataFrame, since: str, shown: int = 40) -> DataFrame:
    """Of log entries (id, ts, operation, pages) since a day: distinct pages, the first of them in order of mention, queries made."""
    recent = entries.where(F.col("ts").cast("date") >= F.lit(since).cast("date"))
    met = recent.select("ts", "id", F.posexplode("pages").alias("pos", "title")).groupBy("title").agg(F.min(F.struct("ts", "id", "pos")).alias("at"))
    first = met.orderBy("at").limit(shown).agg(F.array_sort(F.collect_list(F.struct("at", "title")))["title"].alias("titles"))
    counts = met.agg(F.count("*").alias("pages_active")).crossJoin(recent.agg(F.count_if(F.col("operation") == "query").alias("queries_made")))
    return counts.crossJoin(first)


def revisit(pages: DataFrame, interests: DataFrame, as_of: str, top: int = 5, days: int = 14, most: int = 5) -> DataFrame:
    """The most stale pages with a tag among the top interests (domain, tag, weight), untouched for more than `days`: with those tags and their age."""
    best = interests.orderBy(F.desc("weight"), "domain", "tag").limit(top).agg(F.collect_set("tag").alias("_top"))
    today = F.lit(as_of).cast("date")
    some = pages.where(F.col("updated") < F.date_sub(today, days)).crossJoin(F.broadcast(best)).where(F.arrays_overlap("tags", "_top"))
    return some.withColumns({"matched": F.array_sort(F.array_intersect("tags", "_top")), "age": F.date_diff(today, "updated")}).drop("_top").orderBy("updated", "page_no").limit(most)


def comparison(runs: DataFrame) -> DataFrame:
    """Averages of enriched and plain runs and the change in percent, null where plain is 0."""
    out = runs.agg(F.count_if("enriched").alias("n_enriched"), F.count_if(~F.col("enriched")).alias("n_plain"), F.coalesce(F.avg(F.when(F.col("enriched"), F.col("value"))), F.lit(0.0)).alias("enriched"), F.coalesce(F.avg(F.when(~F.col("enriched"), F.col("value"))), F.lit(0.0)).alias("plain"))
    delta = F.when(F.col("plain") != 0, (F.col("enriched") - F.col("plain")) / F.col("plain") * 100)
    return out.select("n_enriched", "n_plain", F.round("enriched", 4).alias("enriched"), F.round("plain", 4).alias("plain"), F.round(delta, 4).alias("delta_pct"))


def efficiency(runs: DataFrame) -> DataFrame:
    return runs.groupBy("chunk_count").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("avg_value"), F.round(F.avg("score"), 3).alias("avg_score"))


def grade_rates(runs: DataFrame, newest: int = 100) -> DataFrame:
    recent = runs.orderBy(F.desc("id")).limit(newest)
    rate = lambda g: F.round(F.avg((F.col("grade") == g).cast("double")), 6)
    return recent.agg(F.count("*").alias("n"), rate("PASS").alias("pass_rate"), rate("WARN").alias("warn_rate"), rate("FAIL").alias("fail_rate"), F.round(F.avg("score"), 6).alias("mean_score"))


def staleness(runs: DataFrame, as_of: str) -> DataFrame:
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("run_at").cast("date"))
    return runs.withColumn("bucket", F.when(age < 3, "fresh").when(age <= 14, "ageing").otherwise("stale"))


def log_slice(entries: DataFrame, key: str, last: int | None = None, day: str | None = None, operation: str | None = None) -> DataFrame:
    """Entries (key, ts, operation) of a day and an operation, the `last` of them, as far as each is asked for; key orders entries of one time."""
    rows = entries if day is None else entries.where(F.to_date("ts") == F.lit(day).cast("date"))
    rows = rows if operation is None else rows.where(F.col("operation") == operation)
    return rows if last is None else rows.orderBy(F.desc("ts"), F.desc(key)).limit(last)


def search_stubs(index: DataFrame, question: str, domain: str | None = None, limit: int = 10, redact: bool = False) -> DataFrame:
    """(title, slug, domain, description): the best entries without bodies; twice as many are fetched before the domain filter."""
    from ..functions.safety import redact_pii

    scored = index.withColumn("score", keyword_score(question, F.concat_ws(" ", "title", "summary"))).where("score > 0").orderBy(F.desc("score"), "pos").limit(2 * limit)
    kept = scored if domain is None else scored.where(F.col("domain") == domain)
    text = redact_pii(F.col("summary")) if redact else F.col("summary")
    return kept.orderBy(F.desc("score"), "pos").limit(limit).select("title", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("slug"), "domain", text.alias("description"))


def ingest_records(pages: DataFrame, ideas: DataFrame, by: str, key: str) -> DataFrame:
    """(by, avg_chars, avg_links, idea_duplicate_rate): what an ingest's pages are like, and the share of its ideas (key, summary) with a near copy, 0 below two."""
    from ..functions.text import wikilinks
    from .similarity import duplicate_rate

    like = duplicate_rate(ideas.where("summary <> ''"), by, key, "summary").select(by, F.when(F.col("n") >= 2, F.col("duplicate_rate")).otherwise(0.0).alias("idea_duplicate_rate"))
    each = pages.groupBy(by).agg(F.round(F.avg(F.char_length("body")), 4).alias("avg_chars"), F.round(F.avg(F.size(wikilinks(F.col("body")))), 4).alias("avg_links"))
    return each.join(like, by, "left").withColumn("idea_duplicate_rate", F.coalesce("idea_duplicate_rate", F.lit(0.0)))
