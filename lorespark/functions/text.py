"""Text functions, Column to Column, inside whole-stage code wherever a built-in exists."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAINS = "spiritual tech finance health reminder research personal creative business misc".split()

# The keywords that hint at a domain.
DOMAIN_KEYWORDS = {
    "spiritual": "meditation stoicism philosophy mindfulness religion consciousness spirituality yoga buddhism taoism ethics virtue".split(),
    "tech": "ml ai python programming systems database devops security software algorithm architecture cloud api llm neural code".split(),
    "finance": "investing crypto tax budgeting markets trading portfolio stocks bonds economy money savings returns".split(),
    "health": "fitness nutrition sleep mental-health therapy exercise diet wellness workout recovery mindset habit".split(),
    "reminder": "todo follow-up deadline action-item note-to-self task reminder checklist due".split(),
    "research": "paper study hypothesis experiment literature analysis methodology findings abstract citation".split(),
    "personal": "journal goals reflection relationships identity growth values memory biography diary".split(),
    "creative": "writing design music art fiction poetry sketch story craft photography".split(),
    "business": "strategy product marketing ops startup management leadership sales growth revenue".split(),
}

# Words that carry no meaning for overlap scores.
STOP_WORDS = "a an the and or but in on at to for of with by from is are was were be been it its this that as not have has do does".split()

#: Unicode words; \w is ASCII-only in the JVM.
TOKEN = r"[\p{L}\p{N}_]+"
WIKILINK = r"\[\[([^\[\]]+)\]\]"
HEADING = r"(?m)^#{1,3}\s"
#: What a slug keeps of a character's compatibility form, by the characters themselves.
_KEPT = re.compile(r"[^A-Za-z0-9\s–—_/\\-]")
_FOLDED = {c: f for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]) if (f := _KEPT.sub("", unicodedata.normalize("NFKD", c))) and f != c}
_SINGLE, _SEVERAL = [{c: f for c, f in _FOLDED.items() if (len(f) == 1) == one} for one in (True, False)]
_SPACE = r"\s\x1c-\x1f\x85\u1680\u2028\u2029"


def slugify(text: Column, max_len: int = 120) -> Column:
    """Compatibility forms folded (NFKD), dashes for spaces, only a-z, 0-9 and dashes; cut after trimming; '' becomes untitled."""
    folds = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    # only the characters that a text has are replaced; a class of all that could be is slow for every character
    several = F.array_intersect(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]"), F.lit(0))), F.array(*map(F.lit, _SEVERAL)))
    spread = F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.aggregate(several, text, lambda t, c: F.replace(t, c, F.element_at(folds, c)))).otherwise(text)
    plain = F.lower(F.translate(spread, "".join(_SINGLE), "".join(_SINGLE.values())))
    dashed = F.regexp_replace(plain, rf"[{_SPACE}–—_/\\-]+", "-")
    clean = F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9-]", ""), "-+", "-")
    cut = F.left(F.regexp_replace(clean, "^-+|-+$", ""), F.lit(max_len))
    return F.when(cut == "", "untitled").otherwise(cut)


def title_slug(title: Column) -> Column:
    return F.replace(F.lower(title), F.lit(" "), F.lit("-"))


def normalize_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("-"))), lambda t: t != ""))


def coerce_domain(value: Column) -> Column:
    known = F.lower(F.trim(value))
    return F.when(known.isin(*DOMAINS), known).otherwise("misc")


def domain_hits(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {d: sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0)) for d, words in DOMAIN_KEYWORDS.items()}


def infer_domain(text: Column) -> Column:
    """The domain of most keyword hits; of equals the first; none: misc."""
    hits = domain_hits(text)
    # one pass over the text for each keyword: the counts are bound before they are compared
    pairs = F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, (d, n) in enumerate(hits.items())])
    best = F.array_max(pairs)
    return F.when(best.n > 0, best.d).otherwise("misc")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_words(text: Column) -> Column:
    """Distinct ASCII words of two characters and more, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.filter(F.array_distinct(words), lambda w: F.length(w) > 1), F.array(*map(F.lit, STOP_WORDS)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def wikilinks(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1))


def flatten_links(body: Column) -> Column:
    return F.regexp_replace(body, WIKILINK, "$1")


def links_to_wiki(body: Column) -> Column:
    """Markdown links to local .md files become wikilinks."""
    return F.regexp_replace(body, r"\[([^\]]+)\]\((?!https?://)[^)]*\.md\)", "[[$1]]")


def heading_count(body: Column) -> Column:
    return F.regexp_count(body, F.lit(HEADING))


def toc(body: Column) -> Column:
    """Headings of the first three levels: (level, text)."""
    marks = F.regexp_extract_all(body, F.lit(r"(?m)^(#{1,3})\s+.+$"), F.lit(1))
    names = F.regexp_extract_all(body, F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1))
    return F.zip_with(marks, names, lambda m, n: F.struct(F.length(m).alias("level"), n.alias("text"), slugify(n).alias("id")))


def heading_only(body: Column, least: int = 30) -> Column:
    """Fewer than `least` words outside heading lines."""
    return word_count(F.regexp_replace(body, r"(?m)^\s*#.*$", "")) < least


def first_paragraph(body: Column, limit: int = 200) -> Column:
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.left(flatten_links(F.regexp_replace(F.coalesce(F.get(lines, 0), F.lit("")), r"^[*\-> ]+|[*\-> ]+$", "")), F.lit(limit))


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")


def strip_reply(text: Column) -> Column:
    """A model's reply without thoughts and code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?m)^```(?:json)?\s*$", ""))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("int")


def estimated_chunks(text: Column, max_tokens: int) -> Column:
    most = 4 * max_tokens
    return F.when(F.char_length(text) <= most, 1).otherwise(F.ceil(F.char_length(text) / int(most * 0.9))).cast("int")


def collapse(text: Column) -> Column:
    """White space collapsed, lower case: what spans are compared by."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def ascii_fold(name: Column) -> Column:
    """Names compare without regard to ASCII case only."""
    return F.translate(F.trim(F.regexp_replace(name, r"\s+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dataview(domain: Column, limit: int = 20, sort_by: str = "updated") -> Column:
    source = F.when(domain.isNull(), '""').otherwise(F.concat(F.lit("#"), domain))
    return F.concat(F.lit(f"```dataview\nTABLE sources, tags, {sort_by}\nFROM "), source, F.lit(f"\nSORT {sort_by} DESC\nLIMIT {limit}\n```"))


def parse_json_list(raw: Column, schema: str) -> Column:
    """The list of a reply, or of its fenced block; null where it does not parse."""
    return F.from_json(F.regexp_extract(strip_reply(raw), r"(?s)(\[.*\])", 1), f"array<{schema}>")


def parse_decision(raw: Column, candidates: Column) -> Column:
    """(decision, target): any defect makes it ADD."""
    got = F.from_json(F.regexp_extract(strip_reply(raw), r"(?s)(\{.*\})", 1), "decision string, target long")
    kind = F.upper(F.trim(got.decision))
    sound = kind.isin("MERGE", "SUPERSEDE", "NOOP") & F.coalesce(F.array_contains(candidates, got.target), F.lit(False))
    return F.struct(F.when(sound, kind).otherwise("ADD").alias("decision"), F.when(sound, got.target).alias("target"))


def rewrite_links(body: Column, known: Column) -> Column:
    """(text, unresolved): links as markdown; known maps titles to slugs, other titles are slugified and listed."""
    links = F.array_distinct(wikilinks(body))
    slug = lambda t: F.element_at(known, F.trim(t))
    text = F.aggregate(links, body, lambda b, t: F.replace(b, F.concat(F.lit("[["), t, F.lit("]]")), F.concat(F.lit("["), F.trim(t), F.lit("](/"), F.coalesce(slug(t), slugify(t)), F.lit(".md)"))))
    lost = F.transform(F.filter(wikilinks(body), lambda t: slug(t).isNull()), lambda t: F.trim(t))
    return F.struct(text.alias("text"), lost.alias("unresolved"))


def fixed(x: Column, digits: int) -> Column:
    """A number from 0 to 1 with one digit or two after the point, rounded by its exact binary value, ties to even, as C does it.

    SQL's formats round the shortest decimal that stands for the number, which differs at ties. Small numbers take more
    binary places, so that no bit near a tie is lost.
    """
    times = 10**digits

    def hundredths(bits: int) -> Column:
        n = (x * F.lit(2.0**bits)).cast("long") * times
        whole, rest, half = F.shiftright(n, bits), n.bitwiseAND((1 << bits) - 1), 1 << (bits - 1)
        return whole + F.when((rest > half) | ((rest == half) & (whole % 2 == 1)), 1).otherwise(0)

    n = hundredths(59) if digits == 1 else F.when(x >= 0.125, hundredths(56)).when(x >= 0.0078125, hundredths(59)).otherwise(hundredths(62))
    return F.concat(F.floor(n / times).cast("string"), F.lit("."), F.lpad((n % times).cast("string"), digits, "0"))
