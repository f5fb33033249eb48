"""Ideas of sources: a call per chunk, one merge a source, one look for what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_json_list
from .chunking import windows
from .ranking import grounded_spans, idea_scores, preserved_spans, verified_ideas
from .rendering import SOURCE_HINTS

Ask = Callable[[DataFrame], DataFrame]
# What an idea is, and what its fields are where a reply leaves them out.
IDEA = "title string, summary string, why_it_matters string, evidence array<string>, importance int, main_thesis boolean, tags array<string>, domain string, source_span string"
FIELDS = ("title", "summary", "why_it_matters", "evidence", "importance", "main_thesis", "tags", "domain", "span")
#: Characters of a source that the look for missing ideas is shown; ideas that stand where a merge cannot be read.
SHOWN, FALLBACK = 8000, 10


def parsed(replies: DataFrame, *by: str) -> DataFrame:
    """(by, pos, FIELDS) of rows (by, reply): what of a reply is an idea, in order; ideas without title or summary, or of an importance not from 1 to 5, are none."""
    empty = F.array().cast("array<string>")
    # item by item, so that one that is no object leaves the others alone
    items = replies.select(*by, F.posexplode(parse_json_list(F.col("reply"), "string")).alias("pos", "item"))
    x = items.withColumn("x", F.from_json("item", IDEA))
    fields = {
        "title": F.col("x.title"), "summary": F.col("x.summary"), "why_it_matters": F.coalesce("x.why_it_matters", F.lit("")), "evidence": F.coalesce("x.evidence", empty),
        "importance": F.coalesce("x.importance", F.lit(3)), "main_thesis": F.coalesce("x.main_thesis", F.lit(False)), "tags": F.coalesce("x.tags", empty), "domain": F.coalesce("x.domain", F.lit("misc")), "span": F.coalesce("x.source_span", F.lit("")),
    }
    out = x.select(*by, "pos", *[c.alias(n) for n, c in fields.items()])
    return out.where(F.col("title").isNotNull() & F.col("summary").isNotNull() & F.col("importance").between(1, 5))


def _chunk_prompt(name: Column, chunk: Column, kind: Column, text: Column) -> Column:
    hint = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in SOURCE_HINTS.items()], F.concat(F.lit("a "), kind))
    return F.concat(F.lit("Source: "), name, F.lit(" (chunk "), chunk.cast("string"), F.lit(")\nType: "), hint, F.lit("\n\n---\n"), text, F.lit("\n---"))


def mapped(sources: DataFrame, ask: Ask) -> DataFrame:
    """(source_id, chunk, pos, FIELDS): ideas of each chunk of sources (source_id, name, kind, text); a span that its chunk does not bear out is blanked.

    Chunks are rows, so the calls of one source run wherever its chunks land.
    """
    chunks = windows(sources).withColumnRenamed("chunk", "_text").select("source_id", F.col("chunk_index").alias("chunk"), "_text", "name", "kind")
    asked = ask(chunks.withColumn("prompt", _chunk_prompt(F.col("name"), F.col("chunk"), F.col("kind"), F.col("_text"))).select("source_id", "chunk", "_text", "prompt"))
    ideas = parsed(asked, "source_id", "chunk", "_text")
    held = grounded_spans(ideas, "span", "_text")
    return held.withColumn("span", F.when(F.col("grounded"), F.trim("span")).otherwise("")).select("source_id", "chunk", "pos", *FIELDS)


def _json(rows: DataFrame, order: str, *more: str) -> DataFrame:
    """(source_id, ideas): a source's ideas in order as a JSON array."""
    shown = F.struct(*[F.col(c) for c in FIELDS[:-1]], F.col("span").alias("source_span"), *more)
    each = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), shown.alias("x")))).alias("a"))  # what a model named in a source
    return each.select("source_id", F.to_json(F.transform("a", lambda r: r.x)).alias("ideas"))


def merged(ideas: DataFrame, ask: Ask) -> DataFrame:
    """(source_id, idea_no, FIELDS): one call a source that has ideas, shown by recurrence x importance x evidence; spans it lost are refilled.

    Where its reply holds no idea the first `FALLBACK` of the ranking stand.
    """
    keyed = ideas.withColumns({"_key": F.col("chunk").cast("long") * 1_000_000 + F.col("pos"), "n_evidence": F.size("evidence")})
    scored = idea_scores(keyed, ["source_id"], "_key")
    r = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "_key"))
    ranked = scored.withColumn("idea_no", r).select("source_id", "idea_no", *FIELDS, F.col("recurrence").alias("recurrence_count"))
    prompt = F.concat(F.lit("Merge and deduplicate these extracted ideas.\n\n"), F.col("ideas"))
    asked = ask(_json(ranked, "idea_no", "recurrence_count").withColumn("prompt", prompt).select("source_id", "prompt"))
    got = parsed(asked, "source_id").withColumnRenamed("pos", "idea_no")
    lost = asked.select("source_id").join(got.select("source_id").distinct(), "source_id", "left_anti")
    stand = ranked.where(F.col("idea_no") <= FALLBACK).join(lost, "source_id").select(*got.columns)
    both = got.unionByName(stand)
    kept = preserved_spans(both.select("source_id", "idea_no", "title", "span"), ranked.select("source_id", "idea_no", "title", "span"), "source_id")
    return both.drop("span").join(kept.select("source_id", "idea_no", "span"), ["source_id", "idea_no"]).select("source_id", "idea_no", *FIELDS)


def verified(sources: DataFrame, ideas: DataFrame, ask: Ask) -> DataFrame:
    """(source_id, idea_no, FIELDS): one more call a source for what is missing; ideas whose title is there already are not added."""
    tail = "\n\nList any important source ideas that are missing from the extraction above. Use the same JSON schema. If nothing is missing, return an empty JSON array []."
    shown = sources.select("source_id", F.left("text", F.lit(SHOWN)).alias("_t")).join(_json(ideas, "idea_no"), "source_id")
    prompt = F.concat(F.lit("Source:\n---\n"), F.col("_t"), F.lit("\n---\n\nExtracted ideas so far:\n"), F.col("ideas"), F.lit(tail))
    found = parsed(ask(shown.withColumn("prompt", prompt).select("source_id", "prompt")), "source_id").withColumnRenamed("pos", "idea_no")
    return verified_ideas(ideas, found.select(*ideas.columns), "source_id")


def extracted_ideas(sources: DataFrame, ask_map: Ask, ask_merge: Ask, ask_verify: Ask, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Map, merge, verify over sources (source_id, name, kind, text), short ones too; a source without ideas has none, and no further call.

    keep stores replies, and the ideas read from them, as a checkpoint or table: they are read more than once, and a call must not be made again.
    """
    ask_map, ask_merge, ask_verify = ((lambda rows, ask=ask: keep(ask(rows))) for ask in (ask_map, ask_merge, ask_verify))
    return verified(sources, keep(merged(keep(mapped(sources, ask_map)), ask_merge)), ask_verify)
