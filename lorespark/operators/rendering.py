"""Text that is made of rows: claims of a page, and the prompts of model calls. Columns throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safety
from ..functions.text import fixed, words

# The marks of a claims section, what kinds of sources are called, and the wordings of the prompts below.
CLAIMS_START, CLAIMS_END = "<!-- claims:start -->", "<!-- claims:end -->"
SOURCE_HINTS = {
    "article": "a written article or blog post",
    "paper": "an academic or research paper",
    "repo": "a code repository or technical project",
    "dataset": "a data file or dataset",
    "image": "an image or visual document",
    "youtube": "a YouTube video (transcript with title, description, and chapter markers)",
    "podcast": "a podcast episode or show notes",
    "tweet": "a tweet or Twitter/X thread",
    "webpage": "a general web page",
    "book": "a book or long-form text",
    "newsletter": "an email newsletter",
    "note": "a personal note or journal entry",
}


def _join(*parts: Column, by: str = "\n") -> Column:
    """Parts joined; nulls are left out."""
    return F.concat_ws(by, *parts)


def _flat(text: Column) -> Column:
    return F.array_join(words(text), " ")


def page_claims(claims: DataFrame, *by: str) -> DataFrame:
    """(by, active, retired): the bullets of claims (claim_id, text, confidence, valid_to), in order of claim_id."""
    kept = F.when(F.col("valid_to").isNull(), F.concat(F.lit("- "), _flat(F.col("text")), F.lit(" (conf "), fixed(F.col("confidence"), 1), F.lit(")")))
    gone = F.when(F.col("valid_to").isNotNull(), F.concat(F.lit("- ~~"), _flat(F.col("text")), F.lit("~~ (retired "), F.col("valid_to").cast("string"), F.lit(")")))
    rows = claims.select(*by, F.struct("claim_id", kept.alias("kept"), gone.alias("gone")).alias("c")).groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("c"))
    return rows.select(*by, F.filter(F.col("c.kept"), lambda x: x.isNotNull()).alias("active"), F.filter(F.col("c.gone"), lambda x: x.isNotNull()).alias("retired"))


def _retired(retired: Column) -> Column:
    return F.when(F.size(retired) > 0, F.concat(F.lit("\n### Superseded\n\n"), F.array_join(retired, "\n")))


def claims_section(active: Column, retired: Column) -> Column:
    """The marked section of a page's claims; empty without any."""
    some = F.when(F.size(active) > 0, F.array_join(active, "\n"))
    whole = _join(F.lit(f"{CLAIMS_START}\n## Knowledge Claims\n"), some, _retired(retired), F.lit(CLAIMS_END))
    return F.when(F.size(active) + F.size(retired) > 0, whole).otherwise("")


def page_body(title: Column, active: Column, retired: Column, see_also: Column) -> Column:
    """A page made of its claims, with its links, each once; empty without an active claim, so that prose is kept."""
    links = F.array_distinct(see_also)
    tail = F.when(F.size(links) > 0, F.concat(F.lit("\n## See Also\n\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")))
    return F.when(F.size(active) > 0, _join(F.concat(F.lit("# "), title, F.lit("\n")), F.array_join(active, "\n"), _retired(retired), tail)).otherwise("")


def sync_section(body: Column, section: Column) -> Column:
    """The body with its claims section replaced by this one, at the end; doing so again changes nothing."""
    prose = F.regexp_replace(F.regexp_replace(body, rf"(?s)\s*\Q{CLAIMS_START}\E.*?\Q{CLAIMS_END}\E", ""), r"\s+\z", "")
    return F.when(section == "", prose).when(prose == "", section).otherwise(F.concat(prose, F.lit("\n\n"), section))


def qa_prompt(question: Column, pages: Column) -> Column:
    """pages: array of (title, body)."""
    context = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("=== "), p.title, F.lit(" ===\n"), p.body)), "\n\n")
    return F.concat(F.lit("Question: "), question, F.lit("\n\nContext:\n\n"), context)


def decision_prompt(proposition: Column, candidates: Column) -> Column:
    """candidates: array of (claim_id, text, confidence). All text is put between delimiters."""
    each = F.transform(candidates, lambda c: F.concat(F.lit("  "), c.claim_id.cast("string"), F.lit(": "), safety.wrap(c.text), F.lit(" ["), fixed(c.confidence, 2), F.lit("]")))
    return _join(
        F.lit("New proposition:"), F.concat(F.lit("  "), safety.wrap(proposition)), F.lit("\nExisting claims (id: text [confidence]):"), F.when(F.size(each) > 0, F.array_join(each, "\n")),
        F.lit("\nDecide ADD, MERGE, SUPERSEDE, or NOOP for the new proposition.\nReply with ONLY the JSON object described in the system prompt."),
    )


def extract_prompt(text: Column, name: Column, kind: Column, part: Column, parts: Column) -> Column:
    hint = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in SOURCE_HINTS.items()], F.concat(F.lit("a "), kind))
    note = F.when(parts > 1, F.concat(F.lit(" (part "), part.cast("string"), F.lit(" of "), parts.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("Source: "), name, note, F.lit("\nType: "), hint, F.lit("\n\n---\n"), text, F.lit("\n---"))


def merge_prompt(partials: Column, title: Column) -> Column:
    head = F.concat(F.lit("Merge these "), F.size(partials).cast("string"), F.lit(" partial wiki drafts into one coherent page."), F.when(title != "", F.concat(F.lit(" The page title is: "), title)).otherwise(""))
    return F.concat(head, F.lit("\n\n"), F.array_join(F.transform(partials, lambda p, k: F.concat(F.lit("--- PARTIAL "), (k + 1).cast("string"), F.lit(" ---\n"), F.regexp_replace(p, r"^\s+|\s+\z", ""))), "\n\n"))


def summary_prompt(entries: Column, titles: Column) -> Column:
    """entries: array of (ts, operation, description)."""
    lines = F.transform(entries, lambda e: F.concat(F.lit("- ["), F.date_format(e.ts, "HH:mm"), F.lit("] "), e.operation, F.lit(": "), e.description))
    return F.concat(F.lit("Log entries for today:\n"), F.array_join(lines, "\n"), F.lit("\n\nPages touched: "), F.array_join(titles, ", "))


def _interests(interests: Column) -> Column:
    """The first ten of (domain, tag, weight); a weight may exceed 1, and is rounded as decimals are."""
    return F.array_join(F.transform(F.slice(interests, 1, 10), lambda i: F.concat(i.domain, F.lit("/"), i.tag, F.lit(" ("), F.format_string("%.1f", i.weight), F.lit(")"))), ", ")


def suggest_prompt(topic: Column, interests: Column, titles: Column) -> Column:
    return F.concat(F.lit("Research topic: "), topic, F.lit("\n\nUser's top interests: "), _interests(interests), F.lit("\n\nAvailable wiki pages: "), F.array_join(F.slice(titles, 1, 50), ", "))


def digest_prompt(since: Column, until: Column, titles: Column, interests: Column, n_queries: Column, excerpts: Column) -> Column:
    """excerpts: array of (title, domain, body); the first 200 characters of a body are shown."""
    shown = F.transform(excerpts, lambda e: F.concat(F.lit("- "), e.title, F.lit(" ("), e.domain, F.lit("): "), F.regexp_replace(F.left(e.body, F.lit(200)), r"^\s+|\s+\z", "")))
    pages = F.when(F.size(titles) > 0, F.array_join(F.slice(titles, 1, 40), ", ")).otherwise("none")
    return F.concat(
        F.lit("Period: "), since.cast("string"), F.lit(" → "), until.cast("string"), F.lit(" ("), F.date_diff(until, since).cast("string"), F.lit(" days)\nActive pages ("), F.size(titles).cast("string"), F.lit(" total): "), pages,
        F.lit("\nTop interests: "), _interests(interests), F.lit("\nQueries made: "), n_queries.cast("string"), F.lit("\n\n"), F.when(F.size(shown) > 0, F.concat(F.lit("Page excerpts:\n"), F.array_join(shown, "\n"))).otherwise(""),
    )
