"""The deterministic shells of pipelines around a model: what goes in, what is taken from a reply, what is counted."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_fold, parse_json_list, words
from .knowledge import link_rows
from .ranking import near_part

ENTITY_TYPES = "person project system organization concept".split()
SEED_LINKED, SEED_BROKEN = "tier1-wikilink", "tier1-broken-link"


@F.pandas_udf(T.BooleanType())
def _grounded(name: pd.Series, span: pd.Series, source: pd.Series) -> pd.Series:
    """Name or span is in the source, or near a passage of it."""
    return pd.Series([any(x and near_part(x, s or "", 80) for x in (n, p)) for n, p, s in zip(name, span, source, strict=True)], dtype=bool)


def extracted_entities(replies: DataFrame, key: str, most: int = 20, limit: int | None = 8000) -> DataFrame:
    """(key, pos, name, type, description, span) of rows (key, text, reply).

    Known types only, grounded in the first `limit` characters of the text (what the model was shown; None: all of it),
    the first of equal names without case, at most `most` a text.
    """
    items = parse_json_list(F.col("reply"), "struct<name:string,type:string,description:string,span:string>")
    trimmed = F.btrim("text", F.lit(" \t\n\r\f\x0b"))
    shown = F.lower(trimmed if limit is None else F.left(trimmed, F.lit(limit)))
    rows = replies.select(key, shown.alias("shown"), F.posexplode(items).alias("pos", "x"))
    kind, name = F.lower(F.trim("x.type")), F.array_join(words(F.col("x.name")), " ")
    sound = rows.withColumns({"type": kind, "name": name}).where(F.col("type").isin(*ENTITY_TYPES) & (F.col("name") != ""))
    held = sound.where(_grounded(F.lower("x.name"), F.lower(F.coalesce("x.span", F.lit(""))), F.col("shown")))
    first = held.groupBy(key, F.lower("name").alias("folded")).agg(F.min_by(F.struct("pos", "name", "type", "x.description", "x.span"), "pos").alias("e"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("e.pos"))  # a reply's items, tens
    best = first.withColumn("nth", nth).where(F.col("nth") <= most)
    return best.select(key, F.col("e.pos").alias("pos"), "e.name", "e.type", F.trim(F.coalesce("e.description", F.lit(""))).alias("description"), F.trim(F.coalesce("e.span", F.lit(""))).alias("span"))


def seeded_mentions(pages: DataFrame) -> DataFrame:
    """(name, page_no, source_id, has_page): a row per wikilink occurrence, names folded by ASCII case to their page's title."""
    titled = pages.select(ascii_fold(F.col("title")).alias("key"), F.col("title").alias("canonical"), "page_no")
    own = titled.groupBy("key").agg(F.min_by("canonical", "page_no").alias("canonical"))
    links = link_rows(pages).select("page_no", "target", ascii_fold(F.col("target")).alias("key")).join(own, "key", "left")
    has_page = F.col("canonical").isNotNull()
    return links.select("key", F.coalesce("canonical", "target").alias("name"), "page_no", F.when(has_page, SEED_LINKED).otherwise(SEED_BROKEN).alias("source_id"), has_page.alias("has_page"))


def seed_report(pages: DataFrame) -> DataFrame:
    """The counters of a structural seed: pages, page entities, linked and all mentions, entities made of broken links."""
    m = seeded_mentions(pages)
    counts = m.agg(F.count_if("has_page").alias("linked_mentions"), F.count_distinct(F.when(~F.col("has_page"), F.col("key"))).alias("broken_link_entities"), F.count("*").alias("total_mentions"))
    return pages.agg(F.count("*").alias("pages"), F.count("*").alias("page_entities")).crossJoin(F.broadcast(counts))  # one row each


def classify_batches(entities: DataFrame, size: int = 20, most: int = 10_000) -> DataFrame:
    """(batch, names, prompt): the first `most` untyped entities in the order of their names, so many a call."""
    some = entities.where("type = 'concept'").orderBy("canonical", "entity_id").limit(most)
    n = F.row_number().over(Window.orderBy("canonical", "entity_id")) - 1  # at most `most` rows
    line = F.concat(F.lit("- "), F.col("canonical"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" ("), "description", F.lit(")"))).otherwise(""))
    each = some.withColumn("n", n).groupBy(F.floor(F.col("n") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("n", "canonical", line.alias("line")))).alias("l"))
    return each.select("batch", F.transform("l", lambda x: x.canonical).alias("names"), F.array_join(F.transform("l", lambda x: x.line), "\n").alias("prompt"))


def classified(replies: DataFrame, candidates: DataFrame, most_aliases: int = 3) -> DataFrame:
    """(entity_id, type, aliases) of rows (batch, reply): known names and types only, the last reply on a name counts."""
    items = parse_json_list(F.col("reply"), "struct<name:string,type:string,aliases:array<string>>")
    rows = replies.select("batch", F.posexplode(items).alias("pos", "x")).select("batch", "pos", F.lower(F.trim("x.name")).alias("key"), F.lower(F.trim("x.type")).alias("type"), "x.aliases")
    last = rows.where(F.col("type").isin(*ENTITY_TYPES)).groupBy("key").agg(F.max_by(F.struct("type", "aliases"), F.struct("batch", "pos")).alias("r"))
    known = candidates.groupBy(F.lower("canonical").alias("key")).agg(F.min("entity_id").alias("entity_id"))
    cut = F.slice(F.coalesce("r.aliases", F.array().cast("array<string>")), 1, most_aliases)
    alias = F.filter(F.transform(cut, lambda a: F.trim(a)), lambda a: (a != "") & (F.lower(a) != F.col("key")))
    return last.join(known, "key").select("entity_id", "r.type", alias.alias("aliases"))


def run_suites(spark: SparkSession, suites: dict[str, Callable[[], DataFrame]], inputs: dict[str, bool] | None = None) -> DataFrame:
    """(suite, status, score, grade, note): a row per suite; one that fails, or has no input, is skipped and leaves the others alone.

    A suite gives one row with score and grade.
    """
    rows = []
    for name, suite in suites.items():
        if inputs is not None and not inputs.get(name, True):
            rows.append((name, "skipped", None, None, "no input"))
            continue
        try:
            got = suite().select(F.col("score").cast("double"), F.col("grade").cast("string")).first()
        except Exception as e:  # noqa: BLE001  a suite may fail in any way
            rows.append((name, "skipped", None, None, type(e).__name__))
            continue
        rows.append((name, "run", got[0], got[1], "") if got else (name, "skipped", None, None, "no rows"))
    return spark.createDataFrame(rows, "suite string, status string, score double, grade string, note string")


def evaluated(cases: DataFrame, problems: Column, run: Callable[[DataFrame], DataFrame], grade: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The evaluator's steps: validate, run, grade. Gives the grade of sound cases and the cases turned away, with their problems.

    problems: an array of what is wrong with a case, as the request checks give it. A case that is turned away is not run.
    """
    checked = cases.withColumn("problems", problems)
    bad = checked.where(F.size("problems") > 0)
    return grade(run(checked.where(F.size("problems") == 0).drop("problems"))), bad


def search_ranks(cases: DataFrame, pages: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, rank): the rank of each case's page among all by the two-factor score of its words, null beyond k.

    Scores come from the words that cases and pages share; a case meets the pages of all its words but the commonest, and the
    best pages of that one, so that a word that all pages have costs no more than its pages. Pages without a score follow
    those with one in the order of pos; of these only the first 2k can come within k.
    """
    from ..functions.text import tokens
    from .ranking import _bm25_term

    asked = cases.select("case_id", F.explode(F.split(F.lower("query"), r"\s+")).alias("w")).where("w <> ''").groupBy("case_id", "w").agg(F.count("*").alias("times"))
    sought = asked.select("w").distinct()
    found = pages.select("pos", "slug", F.explode(tokens(F.col("body"))).alias("w")).join(sought, "w", "left_semi").groupBy("pos", "slug", "w").agg(F.count("*").alias("tf"))
    found = found.withColumn("x", _bm25_term(F.col("tf").cast("double"), 1.5)).select("w", "pos", "slug", "x")
    # the lead is the word of a case that most pages have: of the pages with none of its other words only the lead's best k can come within k
    df = found.groupBy("w").agg(F.count("*").alias("df"))
    led = asked.join(df, "w").withColumn("nth", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("df"), "w")))  # a query's words
    lead = led.where("nth = 1").select("case_id", F.col("w").alias("lead"), F.col("times").alias("lead_times"))
    other = led.where("nth > 1").select("case_id", "w", "times")
    leads = lead.select(F.col("lead").alias("w"), "lead_times").distinct()
    nth = F.row_number().over(Window.partitionBy("w", "lead_times").orderBy(F.desc(F.round(F.col("lead_times") * F.col("x"), 9)), "pos"))  # each task keeps k, then one
    best = found.join(leads, "w").withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("w").alias("lead"), "lead_times", "pos", "slug", F.lit(0.0).alias("x"))
    near = other.join(found, "w").select("case_id", "pos", "slug", (F.col("times") * F.col("x")).alias("x"))
    first_k = lead.join(best, ["lead", "lead_times"]).select("case_id", "pos", "slug", "x")
    part = near.unionByName(first_k).groupBy("case_id", "pos", "slug").agg(F.sum("x").alias("x")).join(lead, "case_id")
    full = part.join(found.select(F.col("w").alias("lead"), "pos", F.col("x").alias("lead_x")), ["lead", "pos"], "left")
    scored = full.select("case_id", "pos", "slug", F.round(F.col("x") + F.col("lead_times") * F.coalesce("lead_x", F.lit(0.0)), 9).alias("score"))
    r = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "pos"))
    top = scored.withColumn("r", r).where(F.col("r") <= k)
    n_top = top.groupBy("case_id").agg(F.count("*").alias("n"))
    few = cases.select("case_id").join(n_top, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k)
    # with fewer than k scored pages, top holds all of them; 2k pages fill the rest
    first = pages.orderBy("pos").limit(2 * k).select("pos", "slug")
    rest = few.crossJoin(F.broadcast(first)).join(top.select("case_id", "pos"), ["case_id", "pos"], "left_anti")
    rest = rest.withColumn("r", F.col("n") + F.row_number().over(Window.partitionBy("case_id").orderBy("pos"))).where(F.col("r") <= k)
    ranked = top.select("case_id", "slug", "r").unionByName(rest.select("case_id", "slug", "r")).groupBy("case_id", "slug").agg(F.min("r").alias("rank"))
    return cases.select("case_id", F.col("expected_slug").alias("slug")).join(ranked, ["case_id", "slug"], "left").select("case_id", "rank")


def visible_edges(edges: DataFrame, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges (a, b, kind) of the kinds that are on and whose ends are both among the nodes."""
    on = edges.where(F.col("kind").isin(*kinds))
    return on.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")


def graded(score: Column, good: float, fair: float) -> Column:
    return F.when(score >= good, "PASS").when(score >= fair, "WARN").otherwise("FAIL")
