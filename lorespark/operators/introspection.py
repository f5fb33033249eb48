"""Looking back: summaries of days and digests of periods, around model calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_reply
from .rendering import summary_prompt

# What is asked, or said, of a day without entries, and of a digest that cannot be read.
QUIET = "No log entries for {}.\n\nHere are the most recently updated wiki pages:\n{}\n\nWrite a brief overview of what this knowledge base covers and suggest what would be interesting to explore next."
NOTHING = "No activity recorded for {} and no wiki pages found yet."
UNREADABLE = "Could not parse digest — try regenerating."
SHOWN_PAGES = 10
DIGEST = "themes array<struct<theme:string,pages:array<string>,insight:string>>, emerging_connections array<string>, knowledge_gaps array<string>, serendipity string, open_question string"


def _filled(form: str, *parts: Column) -> Column:
    pieces = form.split("{}")
    return F.concat(*[x for k, piece in enumerate(pieces) for x in ([F.lit(piece)] if k == 0 else [parts[k - 1], F.lit(piece)])])


def day_prompts(days: DataFrame, log: DataFrame, pages: DataFrame) -> DataFrame:
    """(day, prompt, summary): what a model is asked of each of days (day), or, where there is neither entry nor page, what is said.

    log: (ts, operation, description, pages); pages: (title, updated). A day's entries come in order, titles once, as first met.
    """
    own = log.select(F.to_date("ts").alias("day"), "ts", "operation", "description", "pages").join(days.select("day").distinct(), "day", "left_semi")
    entries = own.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("ts", "operation", "description"))).alias("e"))  # all of them are shown
    met = own.select("day", "ts", "description", F.posexplode("pages").alias("n", "title")).groupBy("day", "title").agg(F.min(F.struct("ts", "description", "n")).alias("at"))
    titles = met.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("at", "title"))).alias("t"))
    recent = pages.orderBy(F.desc("updated"), "title").limit(SHOWN_PAGES).agg(F.array_sort(F.collect_list(F.struct((-F.unix_date(F.to_date("updated"))).alias("d"), "title"))).alias("r"))
    listed = F.array_join(F.transform("r", lambda p: F.concat(F.lit("- "), p.title)), "\n")
    rows = days.select("day").distinct().join(entries, "day", "left").join(titles, "day", "left").join(F.broadcast(recent))  # recent is one row
    shown = F.coalesce(F.transform("t", lambda x: x.title), F.array().cast("array<string>"))
    day = F.date_format("day", "yyyy-MM-dd")
    prompt = F.when(F.col("e").isNotNull(), summary_prompt(F.col("e"), shown)).when(F.size("r") > 0, _filled(QUIET, day, listed))
    return rows.select("day", prompt.alias("prompt"), F.when(F.col("e").isNull() & (F.size("r") == 0), _filled(NOTHING, day)).alias("summary"))


def daily(days: DataFrame, log: DataFrame, pages: DataFrame, ask: Callable[[DataFrame], DataFrame], saved: DataFrame | None = None) -> DataFrame:
    """(day, summary, cached): saved (day, summary) is taken as it is, no call is made for it, nor for a day of which there is nothing to say."""
    known = days.limit(0).select("day", F.lit("").alias("summary"), F.lit(True).alias("cached")) if saved is None else saved.join(days.select("day").distinct(), "day", "left_semi").select("day", "summary", F.lit(True).alias("cached"))
    left = days if saved is None else days.join(saved.select("day"), "day", "left_anti")
    asked = day_prompts(left, log, pages)
    replied = ask(asked.where("prompt IS NOT NULL")).select("day", F.col("reply").alias("summary"), F.lit(False).alias("cached"))
    return known.unionByName(replied).unionByName(asked.where("prompt IS NULL").select("day", "summary", F.lit(False).alias("cached")))


def daily_pages(summaries: DataFrame, suggestions: DataFrame, till: str) -> DataFrame:
    """(day, title, body): the page of a day's summary, with its suggestions (day, page_title, reason) in order of title."""
    each = suggestions.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_title", "reason"))), lambda s: F.concat(F.lit("- [["), s.page_title, F.lit("]] — "), s.reason)), "\n").alias("s"))
    day = F.date_format("day", "yyyy-MM-dd")
    body = F.concat(F.lit("# Daily Summary — "), day, F.lit(f" till {till}\n\n"), "summary", F.lit("\n\n## Reading Suggestions\n\n"), F.coalesce("s", F.lit("_No suggestions today._")))
    return summaries.join(each, "day", "left").select("day", F.concat(F.lit("Daily Summary "), day, F.lit(f" till {till}")).alias("title"), body.alias("body"))


def digest_of(reply: Column) -> Column:
    """The digest that a reply holds, themes without a name left out; a reply that cannot be read says so."""
    got = F.from_json(F.regexp_extract(strip_reply(reply), r"(?s)(\{.*\})", 1), DIGEST)
    none = F.array().cast("array<string>")
    themes = F.transform(F.filter(F.coalesce(got.themes, F.array().cast("array<struct<theme:string,pages:array<string>,insight:string>>")), lambda t: F.coalesce(t.theme, F.lit("")) != ""), lambda t: F.struct(t.theme.alias("theme"), F.coalesce(t.pages, none).alias("pages"), F.coalesce(t.insight, F.lit("")).alias("insight")))
    sound = F.coalesce(got.themes.isNotNull() | got.serendipity.isNotNull() | got.open_question.isNotNull() | got.knowledge_gaps.isNotNull() | got.emerging_connections.isNotNull(), F.lit(False))
    return F.struct(
        themes.alias("themes"), F.coalesce(got.emerging_connections, none).alias("emerging_connections"), F.coalesce(got.knowledge_gaps, none).alias("knowledge_gaps"),
        F.when(sound, F.coalesce(got.serendipity, F.lit(""))).otherwise(UNREADABLE).alias("serendipity"), F.coalesce(got.open_question, F.lit("")).alias("open_question"),
    )


def quiz_pages(pages: DataFrame, n: int = 5) -> DataFrame:
    """(rank, title, body): the n most recently updated pages, what a quiz asks about."""
    r = F.row_number().over(Window.orderBy(F.desc("updated"), "title"))
    return pages.orderBy(F.desc("updated"), "title").limit(n).withColumn("rank", r).select("rank", "title", "body")
