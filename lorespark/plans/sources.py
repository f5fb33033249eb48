"""Queries of readers and of interchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import AS_OF
from ..operators import rendering, stores
from ..registry import query
from ..sources import files, social, web


def _wiki_files(fx_page: DataFrame) -> DataFrame:
    """(path, content): the pages as files, beside an index, a log and a dotfile."""
    n = F.col("page_no").cast("string")
    meta = {"tags": F.concat(F.lit("[A b, a-b, x"), n, F.lit("]")), "domain": F.concat(F.lit(" "), F.upper("domain")), "updated": F.date_format("updated", "yyyy-MM-dd"), "archived": F.when(F.col("archived"), "true"), "id": files.yaml_scalar(F.col("id"))}
    name = F.when(F.col("page_no") % 50 == 1, F.lit("index.md")).when(F.col("page_no") % 50 == 2, F.lit("log.md")).when(F.col("page_no") % 50 == 3, F.concat(F.lit("."), "slug", F.lit(".md"))).otherwise(F.concat("slug", F.lit(".md")))
    return fx_page.select(F.concat(F.lit("/wiki/"), name).alias("path"), files.render_page(F.col("title"), F.concat("body", F.lit("\n\n")), **meta).alias("content"))


_PAGES = "SELECT '/wiki/' || slug || '.md' AS path, title, md5(rtrim(body, chr(10))) AS body_md5, 'a-b,x' || page_no::string AS tags, domain, updated, id FROM fx_page WHERE page_no % 50 NOT IN (1, 2, 3)"


def _page_rows(pages: DataFrame) -> DataFrame:
    return pages.select("path", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.array_join("tags", ",").alias("tags"), "domain", "updated", "id")


@query("fx_page", sql=f"{_PAGES} AND NOT archived")
def sc1_wiki_scan(fx_page: DataFrame) -> DataFrame:
    return _page_rows(files.wiki_pages(_wiki_files(fx_page), AS_OF))


@query("fx_page", sql=f"{_PAGES} AND archived")
def sc2_archived_scan(fx_page: DataFrame) -> DataFrame:
    return _page_rows(files.wiki_pages(_wiki_files(fx_page), AS_OF, archived=True))


@query("fx_page", sql="SELECT '/wiki/' || slug || '.md' AS path, title, updated, NOT archived AS active FROM fx_page WHERE page_no % 50 NOT IN (1, 2, 3)")
def sc3_page_parse(fx_page: DataFrame) -> DataFrame:
    return files.wiki_pages(_wiki_files(fx_page), AS_OF, archived=None).select("path", "title", "updated", (~F.col("archived")).alias("active"))


@query("fx_page", sql="SELECT page_no, title, 'A b,a-b,x' || page_no::string AS tags, strftime(updated, '%Y-%m-%d') AS updated, md5(ltrim(body || chr(10) || chr(10), chr(10) || chr(32) || chr(9))) AS body_md5 FROM fx_page WHERE page_no % 50 NOT IN (1, 2, 3)")
def sc4_chunker_frontmatter(fx_page: DataFrame) -> DataFrame:
    got = files.chunk_frontmatter(_wiki_files(fx_page)).where(F.rlike("path", F.lit(r"/topic-\d+\.md$")))
    return got.select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long").alias("page_no"), F.col("meta")["title"].alias("title"), F.col("meta")["tags"].alias("tags"), F.col("meta")["updated"].alias("updated"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


_SCANS = {
    "sources": ("documents", "doc_id % 10 = 0"), "chunks": ("fx_chunk", "chunk_id % 11 = 0"), "embeddings": ("embeddings", "vec_id % 13 = 0"), "entities": ("fx_entity", "entity_id % 9 = 0"),
    "mentions": ("fx_claim", "claim_id % 8 = 0"), "claims": ("fx_claim", "claim_id % 6 = 0"), "claim_vectors": ("embeddings", "vec_id % 17 = 0"),
}


@query("documents", "fx_chunk", "embeddings", "fx_entity", "fx_alias", "fx_claim", sql=" UNION ALL ".join(f"SELECT '{s}' AS store, count(DISTINCT {bad.split()[0]}) FILTER (WHERE NOT {bad}) AS n, count(*) - count(DISTINCT {bad.split()[0]}) FILTER (WHERE NOT {bad}) AS n_rejected FROM {t}" for s, (t, bad) in _SCANS.items()) + """
UNION ALL SELECT 'aliases', count(*), (SELECT count(*) FROM fx_alias WHERE entity_id % 4 = 0) FROM fx_alias""")
def sc9_store_scan(documents: DataFrame, fx_chunk: DataFrame, embeddings: DataFrame, fx_entity: DataFrame, fx_alias: DataFrame, fx_claim: DataFrame) -> DataFrame:
    """All stores under their schemas, each with some rows that it cannot take: a missing value, no number, a short vector, a rule broken, a key twice."""
    day, text = F.lit("2024-01-01 10:00:00"), F.lit("t")
    claim = fx_claim.select(F.col("claim_id").alias("id"), F.col("page_id").cast("string").alias("page_id"), F.col("source_id").cast("string").alias("source_id"), "confidence", "valid_from", "valid_to", "superseded_by", day.alias("created"))
    raw = {
        "sources": documents.select(F.col("doc_id").alias("source_path"), F.when(F.col("doc_id") % 10 > 0, "h").alias("content_hash"), day.alias("indexed_at")),
        "chunks": fx_chunk.select(F.col("chunk_id").alias("id"), F.col("source_no").alias("source_path"), F.lit("s").alias("source_slug"), F.when(F.col("chunk_id") % 11 == 0, "x").otherwise(F.col("section_no").cast("string")).alias("chunk_index"), text.alias("text"), F.lit(1).alias("char_count"), day.alias("created_at"), "page_title"),
        "embeddings": embeddings.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding")),
        "entities": fx_entity.select(F.col("entity_id").alias("id"), "canonical", F.when(F.col("entity_id") % 9 == 0, "planet").otherwise(F.col("type")).alias("type"), F.lit("").alias("description"), "page_id", day.alias("created"), day.alias("updated")),
        "aliases": fx_alias.union(fx_alias.where("entity_id % 4 = 0")),
        "mentions": claim.select("id", F.when(F.col("id") % 8 > 0, F.col("id")).alias("entity_id"), "page_id", F.lit("").alias("span"), "source_id", "created"),
        "claims": claim.select("id", "page_id", text.alias("text"), "source_id", F.lit("").alias("source_span"), F.when(F.col("id") % 6 == 0, 1.5).otherwise(F.col("confidence")).alias("confidence"), "valid_from", "valid_to", "superseded_by", "created"),
        "claim_vectors": embeddings.select(F.col("vec_id").alias("claim_id"), F.when(F.col("vec_id") % 17 > 0, F.col("embedding")).alias("embedding")),
    }
    out = None
    for store, rows in raw.items():
        one = stores.scanned(store, rows, 64).agg(F.lit(store).alias("store"), F.count_if(F.col("rejected").isNull()).alias("n"), F.count_if(F.col("rejected").isNotNull()).alias("n_rejected"))
        out = one if out is None else out.unionByName(one)
    return out


@query("fx_page", sql=f"SELECT 'topic-' || page_no::string || '.md' AS path, title, CASE WHEN page_no % 7 = 0 THEN 'misc' ELSE domain END AS domain, updated, CASE WHEN page_no % 7 = 0 THEN 'runbook' ELSE '' END AS tags FROM fx_page WHERE page_no % 4 > 0 AND page_no % 50 <> 1")
def sc19_bundle_scan(fx_page: DataFrame) -> DataFrame:
    """Exported concepts read again: every fourth has lost its type, some bear a reserved name, every seventh has a type of its own."""
    made = files.export_concepts(fx_page.withColumn("domain", F.when(F.col("page_no") % 7 == 0, "Runbook").otherwise(F.col("domain"))))
    path = F.when(F.col("page_no") % 50 == 1, F.lit("b/index.md")).otherwise(F.concat(F.lit("b/c/"), "path"))
    content = F.when(F.col("page_no") % 4 == 0, F.regexp_replace("content", r"(?m)^type: .*$", "kind: none")).otherwise(F.col("content"))
    got = files.concept_pages(files.scan_bundle(made.select(path.alias("path"), content.alias("content"))), AS_OF)
    return got.select("path", "title", "domain", "updated", F.array_join("tags", ",").alias("tags"))


@query("fx_page", sql=f"SELECT title, CASE WHEN page_no % 7 = 0 THEN 'misc' ELSE domain END AS domain, CASE WHEN page_no % 3 = 0 THEN date '{AS_OF}' ELSE updated END AS updated, CASE WHEN page_no % 2 = 0 THEN 's1,s2' ELSE 'r' END AS sources, CASE WHEN page_no % 7 = 0 THEN 'x,my-type' ELSE 'x' END AS tags FROM fx_page")
def tx12_field_mapping(fx_page: DataFrame) -> DataFrame:
    """Concept fields to page fields: own types, days that do not parse, sources or a resource."""
    no = F.col("page_no")
    fields = fx_page.select(
        F.lit("a.md").alias("path"), F.lit("").alias("body"), F.when(no % 7 == 0, "My type").otherwise(F.upper("domain")).alias("type"), "title", F.array(F.lit(" X ")).alias("tags"),
        F.when(no % 3 == 0, "soon").otherwise(F.concat(F.date_format("updated", "yyyy-MM-dd"), F.lit("T00:00:00+00:00"))).alias("timestamp"), F.lit(None).cast("string").alias("domain"),
        F.when(no % 2 == 0, F.array(F.lit("s1"), F.lit("s2"))).alias("sources"), F.lit("r").alias("resource"), F.lit("").alias("created"), "archived", "id",
    )
    return files.concept_pages(fields, AS_OF).select("title", "domain", "updated", F.array_join("sources", ",").alias("sources"), F.array_join("tags", ",").alias("tags"))


@query("fx_page", sql=f"SELECT updated AS day, max(updated::timestamp + interval 9 hour + interval 5 minute) AS generated_at, 2 AS n_suggestions, 'Topic' AS first_word FROM fx_page WHERE NOT archived GROUP BY updated ORDER BY updated DESC LIMIT 14")
def sc21_daily_summaries(fx_page: DataFrame) -> DataFrame:
    day = F.date_format("updated", "yyyy-MM-dd")
    text = F.concat(F.lit("---\ntitle: d\n---\n# "), day, F.lit(" till 09:05\n\nmuch read\n\n## Reading Suggestions\n- [[Topic 1]] — old\n- [[Topic 2]] - older\n- no link\n"))
    made = fx_page.where("NOT archived").select(F.concat(F.lit("/wiki/daily/"), day, F.lit(".md")).alias("path"), text.alias("content")).distinct()
    return files.daily_summaries(made).select("day", "generated_at", F.size("suggestions").alias("n_suggestions"), F.regexp_extract(F.col("suggestions")[0]["title"], r"(\w+)", 1).alias("first_word"))


@query("conversations", sql="SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'query' ELSE 'ingest' END AS operation, CASE WHEN turn % 2 = 0 THEN 0 ELSE 2 END AS n_pages FROM conversations")
def sk4_log_append(conversations: DataFrame) -> DataFrame:
    """Entries appended to a log for each conversation, and read again."""
    ts = F.to_timestamp(F.lit("2024-01-01 00:00")) + F.make_dt_interval(mins=F.col("turn").cast("int"))
    pages = F.when(F.col("turn") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b c")))
    entries = conversations.select("conv_id", "turn", ts.alias("ts"), F.when(F.col("turn") % 2 == 0, "query").otherwise("ingest").alias("operation"), F.concat("conv_id", F.lit("/"), "turn").alias("description"), pages.alias("pages"))
    logs = files.render_log(entries).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x.content), "").alias("content"))
    at = F.split("description", "/")
    return files.parse_log(logs).select(F.get(at, 0).cast("long").alias("conv_id"), F.get(at, 1).cast("long").alias("turn"), "operation", F.size("pages").alias("n_pages"))


@query("fx_index", sql="SELECT pos, title, summary_md5, n AS source_count, category FROM (SELECT pos::int AS pos, title, md5(trim(regexp_replace(summary, '[\\n\\r—()\\[\\]]', ' ', 'g'), ' ')) AS summary_md5, (pos % 3)::int AS n, CASE WHEN pos % 2 = 0 THEN 'tech' ELSE 'misc' END AS category FROM fx_index)")
def sc5_index_scan(fx_index: DataFrame) -> DataFrame:
    """Entries rendered to two index pages, in parts, and read again."""
    clean = F.trim(F.regexp_replace("summary", r"[\n\r—()\[\]]", " "))
    entries = fx_index.select("pos", "title", F.concat(F.lit("t/"), F.col("pos").cast("string")).alias("path"), clean.alias("summary"), (F.col("pos") % 3).alias("source_count"), F.when(F.col("pos") % 2 == 0, "tech").otherwise("misc").alias("category"))
    back = files.parse_index(files.render_index(entries), "block", "category", "part")
    return back.select(F.regexp_extract("path", r"t/(\d+)", 1).cast("int").alias("pos"), "title", F.md5(F.col("summary").cast("binary")).alias("summary_md5"), "source_count", "category")


@query("conversations", sql="SELECT conv_id, turn::int AS n, 'ingest' AS operation, 'conv ' || conv_id::string AS description, 1::bigint AS n_pages FROM conversations")
def sc6_log_scan(conversations: DataFrame) -> DataFrame:
    """A log text per conversation, a header per turn, read again."""
    entry = F.concat(F.lit("## [2024-01-01 00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("] ingest | conv "), F.col("conv_id").cast("string"), F.lit("\nUpdated: page "), F.col("turn").cast("string"), F.lit("\n"))
    logs = conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x.e), "\n").alias("content"))
    rows = files.parse_log(logs)
    return rows.select(F.regexp_extract("description", r"(\d+)", 1).cast("long").alias("conv_id"), F.minute("ts").alias("n"), "operation", "description", F.size("pages").cast("long").alias("n_pages"))


@query("fx_page", sql="""
SELECT page_no, ref FROM (SELECT page_no, CASE page_no % 3 WHEN 0 THEN slug WHEN 1 THEN id ELSE upper(title) || '!' END AS ref FROM fx_page)""")
def sc8_resolve_page(fx_page: DataFrame) -> DataFrame:
    """Every page by its file name, its id or a title of the same slug."""
    ref = F.when(F.col("page_no") % 3 == 0, F.col("slug")).when(F.col("page_no") % 3 == 1, F.col("id")).otherwise(F.concat(F.upper("title"), F.lit("!")))
    return files.resolve_pages(fx_page.select(ref.alias("ref")), fx_page).select("page_no", "ref")


@query("pages", sql="""
SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(h, '(?s)<[^>]*>', chr(10), 'g'), chr(10)), x -> trim(x, ' ')), x -> x <> ''), chr(10))) AS text FROM (SELECT page_id,
 regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<nav\\b[^>]*>.*?</nav>|<footer\\b[^>]*>.*?</footer>|<header\\b[^>]*>.*?</header>|<aside\\b[^>]*>.*?</aside>|<title\\b[^>]*>.*?</title>|<!--.*?-->', chr(10), 'g') AS h FROM pages)""")
def sc13_html_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.md5(files.html_text(F.col("html")).cast("binary")).alias("text"))


@query("pages")
def sc13_main_text(pages: DataFrame) -> DataFrame:
    """The first tier: the element that holds the page's prose, character references decoded."""
    return pages.select("page_id", web.html_main_text("html").alias("text"))


@query("pages", sql="SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'youtube' WHEN 1 THEN 'tweet' WHEN 2 THEN 'reddit' WHEN 3 THEN 'web' WHEN 4 THEN 'pdf' ELSE 'local' END AS kind, CASE page_id % 6 WHEN 0 THEN 'dQw4w9WgXcQ' ELSE '' END AS video, CASE page_id % 6 WHEN 1 THEN page_id::string ELSE '' END AS tweet FROM pages")
def sc17_dispatch(pages: DataFrame) -> DataFrame:
    n = F.col("page_id").cast("string")
    made = F.when(F.col("page_id") % 6 == 0, F.lit("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=3")).when(F.col("page_id") % 6 == 1, F.concat(F.lit("https://x.com/a/status/"), n)).when(F.col("page_id") % 6 == 2, F.lit("https://old.reddit.com/r/a/comments/b/")).when(F.col("page_id") % 6 == 3, F.col("url")).when(F.col("page_id") % 6 == 4, F.lit("/tmp/a.PDF")).otherwise("notes.txt")
    return pages.select("page_id", files.source_kind(made).alias("kind"), files.video_id(made).alias("video"), files.tweet_id(made).alias("tweet"))


@query("events", sql="SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS length FROM (SELECT event_id, (event_id * 37 % 9000)::bigint AS s FROM events)")
def sc14_duration(events: DataFrame) -> DataFrame:
    return events.select("event_id", files.duration(F.col("event_id") * 37 % 9000).alias("length"))


@query("pages", sql="SELECT page_id, 'see ' || url || ' and t.co/b' AS text FROM pages")
def sc15_expand_links(pages: DataFrame) -> DataFrame:
    urls = F.array(F.struct(F.lit("t.co/a").alias("url"), F.col("url").alias("expanded_url")))
    return pages.select("page_id", files.expand_links(F.lit("see t.co/a and t.co/b"), urls).alias("text"))


@query("conversations", sql="SELECT conv_id, turn, '# T' || turn::string || chr(10) || '- u: c' || conv_id::string AS text FROM conversations")
def sc16_reddit_text(conversations: DataFrame) -> DataFrame:
    raw = F.concat(F.lit('[{"data":{"children":[{"kind":"t3","data":{"title":"T'), F.col("turn").cast("string"), F.lit('","selftext":""}}]}},{"data":{"children":[{"kind":"t1","data":{"author":"u","body":"c'), F.col("conv_id").cast("string"), F.lit('"}},{"kind":"more","data":{}}]}}]'))
    return files.reddit_text(conversations.select("conv_id", "turn", raw.alias("json"))).select("conv_id", "turn", "text")


@query("fx_page")
def sk21_export(fx_page: DataFrame) -> DataFrame:
    return files.export_concepts(fx_page)


@query("fx_page", sql="SELECT slug, CASE WHEN page_no % 2 = 0 THEN title ELSE title || ' (imported)' END AS title FROM fx_page WHERE page_no % 2 = 0 OR page_no % 3 = 0")
def sk22_import(fx_page: DataFrame) -> DataFrame:
    pages = fx_page.where("page_no % 2 = 0").select("slug", "title")
    concepts = fx_page.where("page_no % 3 = 0").select("slug", F.concat("title", F.lit(" (imported)")).alias("title"))
    return files.import_concepts(concepts, pages)


@query("documents", sql="SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'MERGE' WHEN 1 THEN 'ADD' WHEN 2 THEN 'SUPERSEDE' ELSE 'ADD' END AS decision, CASE WHEN doc_id % 4 IN (0, 2) THEN doc_id END AS target FROM documents")
def tx20_parse_decision(documents: DataFrame) -> DataFrame:
    from ..functions.text import parse_decision

    d = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('```json\n{"decision": "merge", "target": '), d, F.lit("}\n```"))).when(F.col("doc_id") % 4 == 1, F.lit("no idea")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit('<think>x</think>{"decision":"SUPERSEDE","target":'), d, F.lit("}"))).otherwise('{"decision":"NOOP","target":-5}')
    return documents.select("doc_id", parse_decision(raw, F.array("doc_id")).alias("p")).select("doc_id", "p.*")


@query("documents", sql="SELECT doc_id, (doc_id % 3 + 1)::bigint AS n_ideas FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 5 = 0")
def tx19_parse_ideas(documents: DataFrame) -> DataFrame:
    from ..functions.text import parse_json_list

    one = F.lit('{"title": "t", "summary": "s", "importance": 4}')
    many = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda _: one), ",")
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit("sorry")).otherwise(F.concat(F.lit("```json\n["), many, F.lit("]\n```")))
    ideas = F.filter(parse_json_list(raw, "struct<title:string,summary:string,importance:int>"), lambda x: x.title.isNotNull() & F.coalesce(x.importance, F.lit(3)).between(1, 5))
    return documents.select("doc_id", F.when(ideas.isNotNull(), F.size(ideas).cast("long")).alias("n_ideas"))


@query("fx_claim", sql="""
WITH c AS (SELECT DISTINCT page_id, claim_id, confidence, valid_to FROM fx_claim),
g AS (SELECT page_id, string_agg(a, chr(10) ORDER BY claim_id, a) AS a, string_agg(r, chr(10) ORDER BY claim_id, r) AS r FROM (SELECT *, CASE WHEN valid_to IS NULL THEN '- claim ' || claim_id::string || ' (conf ' || printf('%.1f', confidence) || ')' END AS a,
  CASE WHEN valid_to IS NOT NULL THEN '- ~~claim ' || claim_id::string || '~~ (retired ' || valid_to::string || ')' END AS r FROM c) GROUP BY page_id),
s AS (SELECT *, '<!-- claims:start -->' || chr(10) || '## Knowledge Claims' || chr(10) || chr(10) || coalesce(a || chr(10), '') || coalesce(chr(10) || '### Superseded' || chr(10) || chr(10) || r || chr(10), '') || '<!-- claims:end -->' AS section FROM g)
SELECT page_id, section, 'Prose.' || chr(10) || chr(10) || section AS synced, coalesce('# Topic ' || page_id::string || chr(10) || chr(10) || a || coalesce(chr(10) || chr(10) || '### Superseded' || chr(10) || chr(10) || r, '') || chr(10) || chr(10) || '## See Also' || chr(10) || chr(10) || '- [[A]]' || chr(10) || '- [[B]]', '') AS body FROM s""")
def tx18_render_claims(fx_claim: DataFrame) -> DataFrame:
    """The claims of every page, as a section, put into prose twice over, and as a whole body."""
    claims = fx_claim.select("page_id", "claim_id", F.concat(F.lit(" claim  "), F.col("claim_id").cast("string")).alias("text"), "confidence", "valid_to").distinct()
    rows = rendering.page_claims(claims, "page_id").withColumn("section", rendering.claims_section(F.col("active"), F.col("retired")))
    once = rendering.sync_section(F.lit("Prose.\n"), F.col("section"))
    body = rendering.page_body(F.concat(F.lit("Topic "), F.col("page_id").cast("string")), F.col("active"), F.col("retired"), F.array(*map(F.lit, "ABA")))
    return rows.select("page_id", "section", rendering.sync_section(once, F.col("section")).alias("synced"), body.alias("body"))


@query("conversations", sql="""
WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(trim(text, ' ') ORDER BY turn) AS t, list(turn ORDER BY turn) AS k FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('Question: what?' || chr(10) || chr(10) || 'Context:' || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(t) + 1), i -> '=== ' || r[i] || ' ===' || chr(10) || t[i]), chr(10) || chr(10))) AS qa,
 md5('Merge these ' || len(t)::string || ' partial wiki drafts into one coherent page. The page title is: C' || conv_id::string || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(t) + 1), i -> '--- PARTIAL ' || i::string || ' ---' || chr(10) || t[i]), chr(10) || chr(10))) AS merge,
 md5('Source: C' || conv_id::string || ' (part 1 of ' || len(t)::string || ')' || chr(10) || 'Type: ' || CASE conv_id % 2 WHEN 0 THEN 'a personal note or journal entry' ELSE 'a memo' END || chr(10) || chr(10) || '---' || chr(10) || t[1] || chr(10) || '---') AS extract,
 md5('Log entries for today:' || chr(10) || array_to_string(list_transform(range(1, len(t) + 1), i -> '- [09:' || lpad(k[i]::string, 2, '0') || '] ' || r[i] || ': turn ' || k[i]::string), chr(10)) || chr(10) || chr(10) || 'Pages touched: ' || array_to_string(r, ', ')) AS summary,
 md5('Research topic: C' || conv_id::string || chr(10) || chr(10) || 'User''s top interests: tech/a (1.5), misc/b (0.2)' || chr(10) || chr(10) || 'Available wiki pages: ' || array_to_string(r[1:50], ', ')) AS suggest FROM c WHERE len(t) > 1""")
def tx21_prompts(conversations: DataFrame) -> DataFrame:
    """Prompts of a conversation's turns, of those with two or more."""
    turns = conversations.withColumn("text", F.trim("text")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).where("size(t) > 1")
    name, t = F.concat(F.lit("C"), F.col("conv_id").cast("string")), F.col("t")
    entries = F.transform(t, lambda x: F.struct(F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(9), x.turn.cast("int"), F.lit(0)).alias("ts"), x.role.alias("operation"), F.concat(F.lit("turn "), x.turn.cast("string")).alias("description")))
    interests = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(g).alias("tag"), F.lit(w).alias("weight")) for d, g, w in (("tech", "a", 1.5), ("misc", "b", 0.2))])
    prompts = {
        "qa": rendering.qa_prompt(F.lit("what?"), F.transform(t, lambda x: F.struct(x.role.alias("title"), x.text.alias("body")))), "merge": rendering.merge_prompt(F.col("t.text"), name),
        "extract": rendering.extract_prompt(F.col("t.text")[0], name, F.when(F.col("conv_id") % 2 == 0, "note").otherwise("memo"), F.lit(1), F.size(t)), "summary": rendering.summary_prompt(entries, F.col("t.role")), "suggest": rendering.suggest_prompt(name, interests, F.col("t.role")),
    }
    return turns.select("conv_id", *[F.md5(p.cast("binary")).alias(k) for k, p in prompts.items()])


@query("fx_page", sql="""
SELECT page_no, '- [' || title || '](/topic-' || page_no::string || '.md)' || CASE WHEN f <> '' THEN ' — ' || f ELSE '' END AS line FROM (SELECT page_no, title,
 trim(left(regexp_replace(regexp_replace(coalesce(list_filter(list_transform(string_split(body, chr(10)), x -> trim(x, ' ')), x -> x <> '' AND NOT starts_with(x, '#'))[1], ''), '^[*\\-> ]+|[*\\-> ]+$', '', 'g'), '\\[\\[([^\\[\\]]+)\\]\\]', '\\1', 'g'), 200), ' ') AS f FROM fx_page)""")
def sk21_index(fx_page: DataFrame) -> DataFrame:
    return files.export_index(fx_page).select("page_no", "line")


@query("fx_page", sql="SELECT '# Log' || chr(10) || chr(10) || '## 2024-12-31' || chr(10) || '**Exported**: ' || count(*)::string || ' concepts from the wiki.' || chr(10) AS content FROM fx_page")
def sk21_log(fx_page: DataFrame) -> DataFrame:
    return files.export_log(fx_page, "2024-12-31")


@query("fx_page", sql="SELECT count(*) AS total, count(*) FILTER (WHERE page_no % 5 = 0) AS n_violations, count(*) FILTER (WHERE page_no % 5 = 0) = 0 AS conformant FROM fx_page")
def sk21_conformance(fx_page: DataFrame) -> DataFrame:
    """The exported bundle, a fifth of its concepts without their type."""
    out = files.export_concepts(fx_page)
    return files.conformance(out.withColumn("content", F.when(F.col("page_no") % 5 == 0, F.regexp_replace("content", r"(?m)^type: .*\n", "")).otherwise(F.col("content"))))


@query("documents", sql="""
SELECT doc_id, md5('[Tweet by @u' || doc_id::string || CASE WHEN doc_id % 2 = 0 THEN ' (Name)' ELSE '' END || ']' || chr(10) || chr(10) || 'see https://x/' || doc_id::string || ' now'
 || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'Article: Long' || chr(10) || chr(10) || 'preview' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || 'In reply to @p: parent' ELSE '' END
 || CASE WHEN doc_id % 7 = 0 THEN chr(10) || chr(10) || 'Quoting quoted' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN chr(10) || chr(10) || 'Image: a' || chr(10) || chr(10) || 'Image: b' ELSE '' END) AS text FROM documents""")
def sc15_tweet_text(documents: DataFrame) -> DataFrame:
    """Payloads with and without name, article, parent, quoted post and images."""
    n, no = F.col("doc_id"), F.col("doc_id").cast("string")
    who = lambda handle, name=None: F.struct(handle.alias("screen_name"), (F.lit(None).cast("string") if name is None else name).alias("name"))
    payload = F.to_json(F.struct(
        F.lit("  see t.co/x now ").alias("text"), who(F.concat(F.lit("u"), no), F.when(n % 2 == 0, "Name")).alias("user"),
        F.struct(F.array(F.struct(F.lit("t.co/x").alias("url"), F.concat(F.lit("https://x/"), no).alias("expanded_url")), F.struct(F.lit("now").alias("url"), F.lit(None).cast("string").alias("expanded_url"))).alias("urls")).alias("entities"),
        F.when(n % 3 == 0, F.struct(F.lit("Long").alias("title"), F.lit("preview ").alias("preview_text"))).alias("article"), F.when(n % 5 == 0, F.struct(F.lit("parent").alias("text"), who(F.lit("p")).alias("user"))).alias("parent"),
        F.when(n % 7 == 0, F.struct(F.lit("quoted").alias("text"))).alias("quoted_tweet"), F.when(n % 11 == 0, F.array(*[F.struct(F.lit(a).alias("ext_alt_text")) for a in ("a", " ", "b")])).alias("mediaDetails"),
    ))
    return documents.select("doc_id", F.md5(social.tweet_text(payload).cast("binary")).alias("text"))


@query("documents", sql="""
SELECT doc_id, md5('[YouTube Video — ID: v' || doc_id::string || ']' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Title: T' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Channel: C  |  Published: 2024-01-31  |  Duration: 1:01:05' ELSE '' END
 || chr(10) || chr(10) || 'Description:' || chr(10) || left(t, 1500) || CASE WHEN length(t) > 1500 THEN '...' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || 'Chapters:' || chr(10) || '0:00  Start' || chr(10) || '2:05  End' ELSE '' END
 || chr(10) || chr(10) || 'Transcript:' || chr(10) || 'said') AS text FROM (SELECT doc_id, 'about ' || repeat('word ', (doc_id % 400)::int) || 'end' AS t FROM documents)""")
def sc14_video_text(documents: DataFrame) -> DataFrame:
    n, no = F.col("doc_id"), F.col("doc_id").cast("string")
    third = lambda v: F.when(n % 3 == 0, v)
    info = F.to_json(F.struct(
        F.when(n % 2 == 0, "T").alias("title"), third("").alias("uploader"), third("C").alias("channel"), third("20240131").alias("upload_date"), third(3665.9).alias("duration"),
        F.concat(F.lit("\nabout "), F.repeat(F.lit("word "), (n % 400).cast("int")), F.lit("end ")).alias("description"),
        F.when(n % 5 == 0, F.array(F.struct(F.lit(0).alias("start_time"), F.lit("Start").alias("title")), F.struct(F.lit(125).alias("start_time"), F.lit("End").alias("title")))).alias("chapters"),
    ))
    return documents.select("doc_id", F.md5(social.video_text(info, F.concat(F.lit("v"), no), F.lit("said")).cast("binary")).alias("text"))
