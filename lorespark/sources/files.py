"""Readers and writers of wikis, logs, indexes, bundles and web sources."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import DOMAINS, first_paragraph, links_to_wiki, normalize_tags, slugify
from ..operators.numbering import numbered_on, range_pieces
from ..operators.workers import bounded

PAGE = "path string, title string, body string, tags array<string>, sources array<string>, domain string, created date, updated date, archived boolean, id string"
# What front matter gives of a page.
META = ", ".join(x.replace(" ", ": ") for x in PAGE.split(", ") if x.split()[0] not in ("path", "body"))


def scan_text(spark: SparkSession, path: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """(path, content): whole files, undecodable bytes replaced."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.col("content").cast("string").alias("content"))


def frontmatter(content: Column) -> tuple[Column, Column]:
    """The YAML block and the body."""
    return F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---\n?", 1), F.regexp_replace(content, r"(?s)\A---\n.*?\n---\n?", "")


def parse_pages(files: DataFrame, as_of: str) -> DataFrame:
    """Typed pages of (path, content). Front matter that does not parse is empty; one that is no mapping, or holds an impossible day, makes the page unreadable, and it goes.

    Only the front matter goes to Python; bodies stay where they are.
    """
    bounded(files.sparkSession)
    head, body = frontmatter(F.col("content"))

    def each(paths: pd.Series, heads: pd.Series) -> pd.Series:
        import yaml

        def listed(x) -> list[str]:
            return [str(v) for v in x] if isinstance(x, list) else []

        def day(x):
            return pd.to_datetime(str(x), errors="coerce").date() if x and not pd.isna(pd.to_datetime(str(x), errors="coerce")) else pd.Timestamp(as_of).date()

        out = []
        for path, top in zip(paths, heads, strict=True):
            out.append([])
            try:
                m = yaml.safe_load(top) if top else {}
            except yaml.YAMLError:
                m = {}
            except ValueError:
                continue
            m = m or {}
            if not isinstance(m, dict):
                continue
            stem = re.sub(r"\.md$", "", path.rsplit("/", 1)[-1])
            tags = list(dict.fromkeys(t for t in (str(x).strip().lower().replace(" ", "-") for x in listed(m.get("tags"))) if t))
            domain = str(m.get("domain", "")).strip().lower()
            out[-1].append({"title": str(m.get("title") or stem), "tags": tags, "sources": listed(m.get("sources")), "domain": domain if domain in DOMAINS else "misc", "created": day(m.get("created")), "updated": day(m.get("updated")), "archived": bool(m.get("archived", False)), "id": str(m.get("id") or "")})
        return pd.Series(out, dtype=object)

    parsed = F.pandas_udf(each, f"array<struct<{META}>>")
    rows = files.select("path", F.rtrim(body, F.lit("\n")).alias("body"), F.explode(parsed("path", head)).alias("m"))
    return rows.select(*["path" if c == "path" else "body" if c == "body" else f"m.{c}" for c in (x.split()[0] for x in PAGE.split(", "))])


def wiki_pages(files: DataFrame, as_of: str, archived: bool | None = False) -> DataFrame:
    """Pages of (path, content) but index, log and dotfiles; archived=None: all, True: those alone."""
    name = F.element_at(F.split("path", "/"), -1)
    pages = parse_pages(files.where(name.endswith(".md") & ~name.isin("index.md", "log.md") & ~name.startswith(".")), as_of)
    return pages if archived is None else pages.where(F.col("archived") == archived)


def list_pages(spark: SparkSession, path: str, as_of: str, archived: bool | None = False) -> DataFrame:
    """Pages of a wiki folder, its subfolders left out."""
    return wiki_pages(scan_text(spark, path), as_of, archived)


def chunk_frontmatter(files: DataFrame) -> DataFrame:
    """(path, meta, body) as the chunker reads them: every value as text, tags joined by commas; the body is trimmed.

    A block that is not closed leaves the content as it is; one that does not parse is empty, its body still cut off.
    """
    end = F.when(F.startswith("content", F.lit("---")), F.locate("\n---", F.col("content"), 4))
    closed = F.coalesce(end, F.lit(0)) > 0
    top = F.when(closed, F.substring("content", F.lit(4), end - 4))
    body = F.when(closed, F.ltrim(F.substring("content", end + 4, F.char_length("content")), F.lit(" \t\n\r\f\x0b"))).otherwise(F.col("content"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            found = []
            for head in pdf["head"]:
                try:
                    values = yaml.safe_load(head) if head else None
                except (yaml.YAMLError, ValueError):
                    values = None
                if isinstance(values, dict):
                    tags = values.get("tags") or ""
                    texts = {str(k): str(v) for k, v in values.items() if v is not None}
                    found.append(texts | {"tags": ",".join(map(str, tags)) if isinstance(tags, list) else str(tags)})
                else:
                    found.append({})
            yield pd.DataFrame({"path": pdf["path"], "meta": found, "body": pdf["body"]})

    return files.select("path", top.alias("head"), body.alias("body")).mapInPandas(each, "path string, meta map<string,string>, body string")


def yaml_scalar(value: Column) -> Column:
    """A YAML scalar: plain where it is a word or words of letters, digits and blanks, else in double quotes."""
    plain = F.rlike(value, F.lit(r"^[A-Za-z][A-Za-z0-9 ]*[A-Za-z0-9]$")) & ~F.lower(value).isin("true", "false", "yes", "no", "on", "off", "null")
    return F.when(plain, value).otherwise(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))


def render_page(title: Column, body: Column, **meta: Column) -> Column:
    """A page with its front matter, keys sorted; arrays as flow lists, nulls left out."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in sorted({"title": yaml_scalar(title), **meta}.items())]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), body)


def render_log(entries: DataFrame) -> DataFrame:
    """entries (ts, operation, description, pages) with the text that each appends to the log."""
    head = F.concat(F.lit("## ["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("operation"), F.lit(" | "), F.col("description"))
    updated = F.when(F.size("pages") > 0, F.concat(F.lit("Updated: "), F.array_join("pages", ", ")))
    return entries.withColumn("content", F.concat(F.concat_ws("\n", head, updated), F.lit("\n\n")))


def load_cases(spark: SparkSession, path: str, most: int = 512 * 1024) -> DataFrame:
    """(query, expected_slug, domain) of a YAML list, at most 512 KB; items without query or slug are left out."""
    import yaml

    found = spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("content").first()
    if found is None:
        raise ValueError(f"{path} is missing or larger than {most} bytes")
    raw = yaml.safe_load(bytes(found[0]).decode("utf-8")) or []
    if not isinstance(raw, list):
        raise ValueError(f"cases are a list, not {type(raw).__name__}")
    rows = [(str(x["query"]), str(x["expected_slug"]), str(x.get("domain", ""))) for x in raw if isinstance(x, dict) and "query" in x and "expected_slug" in x]
    return spark.createDataFrame(rows, "query string, expected_slug string, domain string")


def daily_summaries(files: DataFrame, newest: int = 14) -> DataFrame:
    """(day, generated_at, summary, suggestions) of daily/<day>.md, newest first; suggestions are (title, reason)."""
    day = F.try_to_timestamp(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.md$", 1), F.lit("yyyy-MM-dd")).cast("date")
    some = files.withColumn("day", day).where("day IS NOT NULL").orderBy(F.desc("day")).limit(newest)
    body = F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n?", "")
    parts = F.split(body, r"(?m)^## Reading Suggestions[ \t]*$", 2)
    at = F.coalesce(F.nullif(F.regexp_extract(body, r"till (\d{2}:\d{2})", 1), F.lit("")), F.lit("00:00"))
    line = r"(?m)^-\s+\[\[(.+?)\]\]\s+[—–-]\s+(.+)$"
    tail = F.coalesce(F.get(parts, 1), F.lit(""))
    suggested = F.zip_with(F.regexp_extract_all(tail, F.lit(line), F.lit(1)), F.regexp_extract_all(tail, F.lit(line), F.lit(2)), lambda t, r: F.struct(t.alias("title"), F.trim(r).alias("reason")))
    stamp = F.try_to_timestamp(F.concat(F.date_format("day", "yyyy-MM-dd "), at), F.lit("yyyy-MM-dd HH:mm"))
    return some.select("day", stamp.alias("generated_at"), F.btrim(F.get(parts, 0), F.lit(" \t\n\r")).alias("summary"), suggested.alias("suggestions"))


def parse_index(content: DataFrame, text: str = "content", file: str | None = None, part: str | None = None) -> DataFrame:
    """(pos, category, title, path, summary, source_count) of index pages; the category runs on until the next heading.

    A row is a page; with `file` and `part` it is a part of one, and a part goes on in the category that those before it end
    with. Lines are numbered in their row.
    """
    head = r"^## (.+)$"
    row = content.select(F.monotonically_increasing_id().alias("_file") if file is None else F.col(file).alias("_file"), (F.lit(0) if part is None else F.col(part)).alias("_part"), F.col(text).alias("_text"))
    rows = row.select("_file", "_part", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("_file", "_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.regexp_extract("line", head, 1) != "", F.lower(F.trim(F.regexp_extract("line", head, 1))))
    rows = rows.withColumn("category", F.last(named, ignorenulls=True).over(w))
    pattern = r"^- \[([^\]]+)\]\(([^)]+)\)\s*[—-]\s*(.*?)(?:\s*\((\d+) sources?\))?\s*$"
    rows = rows.where(F.rlike("line", F.lit(pattern)))
    if part is not None:
        last = F.get(F.regexp_extract_all("_text", F.lit(r"(?m)^## (.+)$"), F.lit(1)), F.size(F.regexp_extract_all("_text", F.lit(r"(?m)^## (.+)$"), F.lit(1))) - 1)
        before = Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        ahead = row.select("_file", "_part", F.lower(F.trim(last)).alias("_last")).withColumn("_before", F.last("_last", ignorenulls=True).over(before)).drop("_last")
        rows = rows.join(ahead, ["_file", "_part"]).withColumn("category", F.coalesce("category", "_before"))
    return rows.select("pos", F.coalesce("category", F.lit("misc")).alias("category"), F.regexp_extract("line", pattern, 1).alias("title"), F.regexp_extract("line", pattern, 2).alias("path"), F.regexp_extract("line", pattern, 3).alias("summary"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("line", pattern, 4), F.lit("")), F.lit("999999")).cast("int"), F.lit(0)).alias("source_count"))


def render_index(entries: DataFrame, most: int = 1000) -> DataFrame:
    """(category, part, block): entries of each category in order, `most` or fewer a part; parts joined by a line feed are the category's block."""
    plural = F.when(F.col("source_count") == 1, "1 source").otherwise(F.concat(F.col("source_count").cast("string"), F.lit(" sources")))
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(") — "), "summary", F.lit(" ("), plural, F.lit(")"))
    placed = numbered_on(entries.select("category", "pos", line.alias("line")), range_pieces(entries, "pos"), ["pos"]).withColumn("part", F.floor((F.col("_n") - 1) / most).cast("long"))
    each = placed.groupBy("category", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    first = placed.groupBy("category").agg(F.min("part").alias("_first"))
    head = F.when(F.col("part") == F.col("_first"), F.concat(F.lit("## "), F.initcap("category"), F.lit("\n\n"))).otherwise("")
    return each.join(first, "category").select("category", "part", F.concat(head, F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("block"))


def parse_log(content: DataFrame, text: str = "content") -> DataFrame:
    """(pos, ts, operation, description, pages) of a log: a header line and what it updated; bad headers are dropped."""
    numbered = content.select(F.monotonically_increasing_id().alias("_file"), F.split(text, "\n").alias("_lines"))
    rows = numbered.select("_file", F.posexplode("_lines").alias("pos", "line"))
    pattern = r"^## \[(\d{4}-\d{2}-\d{2} \d{2}:\d{2})\] (\w+) \| (.*)$"
    w = Window.partitionBy("_file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_head", F.rlike("line", F.lit(pattern))).withColumn("n", F.sum(F.col("is_head").cast("int")).over(w)).where("n > 0")
    head = F.max_by(F.when(F.col("is_head"), F.col("line")), F.when(F.col("is_head"), F.col("pos")))
    updated = F.regexp_extract("line", r"^(?:Updated|Result[^:]*): (.*)$", 1)
    out = rows.groupBy("_file", "n").agg(head.alias("h"), F.max(F.when(updated != "", F.struct("pos", updated.alias("u")))).alias("u"), F.min("pos").alias("pos"))
    ts = F.try_to_timestamp(F.regexp_extract("h", pattern, 1), F.lit("yyyy-MM-dd HH:mm"))
    pages = F.when(F.col("u").isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split("u.u", ","), lambda x: F.trim(x)), lambda x: x != ""))
    return out.select("pos", ts.alias("ts"), F.regexp_extract("h", pattern, 2).alias("operation"), F.regexp_extract("h", pattern, 3).alias("description"), pages.alias("pages")).where(F.col("ts").isNotNull() & F.col("operation").isin("ingest", "query", "lint", "introspect"))


def source_kind(source: Column) -> Column:
    """Which reader takes a source: the first that claims it."""
    host = F.lower(F.regexp_extract(source, r"^https?://(?:www\.|m\.|mobile\.|old\.)?([^/:?#]+)", 1))
    return (
        F.when(host.isin("youtube.com", "youtu.be", "music.youtube.com"), "youtube").when(host.isin("twitter.com", "x.com"), "tweet")
        .when(host.isin("reddit.com", "redd.it"), "reddit").when(host != "", "web").when(F.lower(source).endswith(".pdf"), "pdf").otherwise("local")
    )


def video_id(url: Column) -> Column:
    return F.regexp_extract(url, r"(?:v=|youtu\.be/|/shorts/|/embed/|/live/)([A-Za-z0-9_-]{11})", 1)


def tweet_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/status(?:es)?/(\d+)", 1)


def reddit_json(url: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", ""), F.lit(".json"))


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def expand_links(text: Column, urls: Column) -> Column:
    """Short links replaced by what they stand for; urls: array of (url, expanded_url)."""
    return F.aggregate(urls, text, lambda t, u: F.replace(t, u.url, u.expanded_url))


def reddit_text(payload: DataFrame, raw: str = "json", most: int = 20) -> DataFrame:
    """Post and first comments of a listing pair, joined as text."""
    post = "array<struct<data:struct<children:array<struct<kind:string,data:struct<title:string,selftext:string,author:string,body:string>>>>>>"
    p = payload.withColumn("_p", F.from_json(raw, post))
    comments = F.slice(F.filter(F.expr("_p[1].data.children"), lambda c: (c.kind == "t1") & (c.data.body != "")), 1, most)
    head = F.expr("_p[0].data.children[0].data")
    lines = F.transform(comments, lambda c: F.concat(F.lit("- "), c.data.author, F.lit(": "), c.data.body))
    return p.withColumn("text", F.concat_ws("\n", F.concat(F.lit("# "), head.title), F.nullif(head.selftext, F.lit("")), F.array_join(lines, "\n"))).drop("_p")


def html_text(html: Column) -> Column:
    """Text of a page by rules alone: page furniture dropped, tags stripped, a line per text node."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|aside|title)\b[^>]*>.*?</\1>|<!--.*?-->", "\n")
    lines = F.split(F.regexp_replace(bare, r"(?s)<[^>]*>", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def export_concepts(pages: DataFrame) -> DataFrame:
    """(path, content, conforms): pages as interchange concepts, links rewritten where their page is known."""
    known = pages.select("title", slugify(F.col("title")).alias("slug"))
    links = pages.select("page_no", F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))).alias("title")).distinct()
    each = links.join(known, "title").groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("title", "slug"))).alias("_l"))
    out = pages.join(each, "page_no", "left")
    body = F.aggregate(F.coalesce("_l", F.array().cast("array<struct<title:string,slug:string>>")), F.col("body"), lambda t, x: F.replace(t, F.concat(F.lit("[["), x.title, F.lit("]]")), F.concat(F.lit("["), x.title, F.lit("](/"), x.slug, F.lit(".md)"))))
    has = set(pages.columns)
    meta = {k: yaml_scalar(F.col(k)) for k in ("id", "domain") if k in has} | {k: F.to_json(F.col(k)) for k in ("tags", "sources") if k in has}
    meta |= {"created": yaml_scalar(F.date_format("created", "yyyy-MM-dd"))} if "created" in has else {}
    meta |= {"archived": F.when(F.col("archived"), "true")} if "archived" in has else {}
    stamp = F.concat(F.date_format("updated", "yyyy-MM-dd"), F.lit("T00:00:00+00:00"))
    meta |= {"type": yaml_scalar(F.col("domain")), "timestamp": yaml_scalar(stamp), "description": yaml_scalar(F.nullif(F.trim(first_paragraph(F.col("body"))), F.lit("")))}
    content = render_page(F.col("title"), body, **meta)
    return out.select("page_no", F.concat(slugify(F.col("title")), F.lit(".md")).alias("path"), content.alias("content"), (F.col("domain") != "").alias("conforms"))


def export_index(pages: DataFrame) -> DataFrame:
    """(page_no, key, line): a line of the bundle's index for each page, in order of key (title without case, page)."""
    told = F.trim(first_paragraph(F.col("body")))
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("](/"), slugify(F.col("title")), F.lit(".md)"), F.when(told != "", F.concat(F.lit(" — "), told)).otherwise(""))
    return pages.select("page_no", F.struct(F.lower("title").alias("title"), "page_no").alias("key"), line.alias("line"))


def export_log(pages: DataFrame, as_of: str) -> DataFrame:
    """The bundle's log: one row, its content."""
    return pages.agg(F.concat(F.lit(f"# Log\n\n## {as_of}\n**Exported**: "), F.count("*").cast("string"), F.lit(" concepts from the wiki.\n")).alias("content"))


def conformance(files: DataFrame) -> DataFrame:
    """(total, n_violations, conformant) of a bundle's (path, content): all but reserved names need a type that is text."""
    name = F.element_at(F.split("path", "/"), -1)
    some = files.where(name.endswith(".md") & ~name.isin("index.md", "log.md"))
    total, sound = some.agg(F.count("*").alias("total")), scan_bundle(some).agg(F.count("*").alias("n"))
    return total.crossJoin(F.broadcast(sound)).select("total", (F.col("total") - F.col("n")).alias("n_violations"), (F.col("total") == F.col("n")).alias("conformant"))


def resolve_pages(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """(ref, page_no): a file of that name; else the first page by file name of that id, or whose title has the reference's slug."""
    by = lambda key, tier: pages.select(key.alias("_k"), F.struct(F.lit(tier).alias("tier"), "slug", "page_no").alias("_p"))
    named, titled = by(F.col("slug"), 0).union(by(F.col("id"), 1)), by(slugify(F.col("title")), 1)
    some = refs.select("ref").distinct()
    hits = some.withColumn("_k", F.col("ref")).join(named, "_k").union(some.withColumn("_k", slugify(F.col("ref"))).join(titled, "_k"))
    return hits.groupBy("ref").agg(F.min("_p")["page_no"].alias("page_no"))


BUNDLE = "path string, body string, type string, title string, tags array<string>, timestamp string, domain string, sources array<string>, resource string, created string, archived boolean, id string"


def scan_bundle(files: DataFrame) -> DataFrame:
    """Concepts of (path, content), any depth: reserved names and files without a type that is text and not empty are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    head, body = frontmatter(F.col("content"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def texts(x) -> list[str] | None:
            return [str(v) for v in x] if isinstance(x, list) else None

        def iso(x) -> str | None:
            return None if x is None else x.isoformat() if hasattr(x, "isoformat") else str(x)

        for pdf in batches:
            rows = []
            for path, top, text in zip(pdf["path"], pdf["head"], pdf["body"], strict=True):
                try:
                    m = yaml.safe_load(top) if top else {}
                except (yaml.YAMLError, ValueError):
                    m = {}
                if not isinstance(m, dict) or not isinstance(m.get("type"), str) or not m["type"].strip():
                    continue
                resource = str(m["resource"]) if m.get("resource") else None
                rows.append((path, text, m["type"], str(m.get("title", "")), texts(m.get("tags")), iso(m.get("timestamp")), str(m["domain"]) if m.get("domain") else None, texts(m.get("sources")), resource, iso(m.get("created")), bool(m.get("archived", False)), str(m.get("id", ""))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BUNDLE.split(", ")])

    some = files.where(name.endswith(".md") & ~name.isin("index.md", "log.md"))
    return some.select("path", head.alias("head"), body.alias("body")).mapInPandas(each, BUNDLE)


def concept_pages(concepts: DataFrame, as_of: str) -> DataFrame:
    """Pages of scanned concepts. A type that is no domain makes the domain misc and stays as a tag; of days the first ten characters count."""

    def day(c: str) -> Column:
        return F.try_to_timestamp(F.left(c, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")

    kind, today, nothing = F.trim("type"), F.lit(as_of).cast("date"), F.array().cast("array<string>")
    placed = F.lower(F.trim(F.coalesce(F.nullif("domain", F.lit("")), kind)))
    domain = F.when(placed.isin(*DOMAINS), placed).otherwise("misc")
    tags = F.coalesce("tags", nothing)
    tags = F.when((domain == "misc") & (kind != "") & (F.lower(kind) != "misc"), F.array_append(tags, kind)).otherwise(tags)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    updated = F.coalesce(day("timestamp"), today)
    created = F.when(F.coalesce("created", F.lit("")) == "", today).otherwise(F.coalesce(day("created"), updated))
    sources = F.coalesce("sources", F.when(F.col("resource").isNotNull(), F.array("resource")), nothing)
    body = F.btrim(links_to_wiki(F.col("body")), F.lit("\n"))
    return concepts.select(F.concat(slugify(title), F.lit(".md")).alias("path"), title.alias("title"), body.alias("body"), normalize_tags(tags).alias("tags"), sources.alias("sources"), domain.alias("domain"), created.alias("created"), updated.alias("updated"), "archived", "id")


def import_concepts(concepts: DataFrame, pages: DataFrame, overwrite: bool = False) -> DataFrame:
    """Pages after the concepts came in: an existing slug is kept unless overwritten."""
    keep, new = (pages.join(concepts.select("slug"), "slug", "left_anti"), concepts) if overwrite else (pages, concepts.join(pages.select("slug"), "slug", "left_anti"))
    return keep.unionByName(new.select(*pages.columns))


def tags_of(text: Column) -> Column:
    return normalize_tags(F.split(text, ","))
