"""Pages, links, the entity graph and the claims ledger: joins and merges from state to state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, heading_count, title_slug, wikilinks
from .numbering import numbered_on, range_pieces

# pages and links


def link_rows(pages: DataFrame) -> DataFrame:
    """(page_no, title, target): a row per wikilink occurrence."""
    return pages.select("page_no", "title", F.explode(wikilinks(F.col("body"))).alias("target"))


def broken_links(pages: DataFrame) -> DataFrame:
    titles = pages.select(F.lower("title").alias("_t")).distinct()
    return link_rows(pages).join(titles, F.lower("target") == F.col("_t"), "left_anti")


def with_known_links(pages: DataFrame) -> DataFrame:
    """pages with known: a map of those of its links that are a page's title to that page's slug."""
    slugs = pages.groupBy(F.col("title").alias("_t")).agg(F.min("slug").alias("_s"))
    links = pages.select("page_no", F.explode(F.array_distinct(F.transform(wikilinks(F.col("body")), lambda t: F.trim(t)))).alias("_t"))
    each = links.join(slugs, "_t").groupBy("page_no").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_s"))).alias("known"))  # the links of one page
    return pages.join(each, "page_no", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))


def orphan_pages(pages: DataFrame) -> DataFrame:
    """Pages that no page, themselves included, links to."""
    linked = link_rows(pages).select(F.lower("target").alias("_t")).distinct()
    return pages.join(linked, F.lower("title") == F.col("_t"), "left_anti")


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges between existing pages, titles matched exactly, repeats kept."""
    to = pages.select(F.col("title").alias("target"), F.col("page_no").alias("to_no"))
    return link_rows(pages).join(to, "target").select("page_no", "to_no")


def backlinks(pages: DataFrame, title: str) -> DataFrame:
    return pages.where(F.array_contains(wikilinks(F.col("body")), title) & (F.col("title") != title)).select("page_no", "title")


def related_concepts(pages: DataFrame) -> DataFrame:
    """Per page the first link of each slug, and whether its page exists."""
    links = pages.select("page_no", F.posexplode(wikilinks(F.col("body"))).alias("pos", "name")).withColumn("slug", title_slug(F.col("name")))
    first = links.groupBy("page_no", "slug").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))
    known = pages.select("slug").distinct().withColumn("_known", F.lit(True))
    return first.join(known, "slug", "left").select("page_no", "slug", "name", "pos", F.coalesce("_known", F.lit(False)).alias("internal"))


def richness(pages: DataFrame, n_tags: Column) -> DataFrame:
    n, links, heads = F.char_length("body"), F.size(wikilinks(F.col("body"))), heading_count(F.col("body"))
    score = F.least(n / 500.0, F.lit(4.0)) + F.least(links * 0.5, F.lit(3.0)) + F.least(heads * 0.5, F.lit(2.0)) + F.least(n_tags * 0.25, F.lit(1.0))
    return pages.select("page_no", "title", "domain", n.alias("body_chars"), links.alias("n_links"), heads.alias("n_sections"), n_tags.alias("n_tags"), F.round(score, 2).alias("richness"), (n < 300).alias("is_stub"))


def quality_report(scores: DataFrame) -> DataFrame:
    out = scores.agg(F.count("*").alias("n"), F.round(F.avg("richness"), 2).alias("mean_richness"), F.round(F.median("richness"), 2).alias("median_richness"), F.count_if("is_stub").alias("n_stub"), F.count_if(F.col("n_links") == 0).alias("n_no_links"), F.count_if(F.col("n_tags") == 0).alias("n_no_tags"))
    stub = F.try_divide("n_stub", "n")
    grade = F.when(F.col("n") == 0, "WARN").when((stub < 0.1) & (F.col("mean_richness") >= 6), "PASS").when((stub < 0.25) & (F.col("mean_richness") >= 3), "WARN").otherwise("FAIL")
    return out.withColumn("grade", grade)


def confidence(pages: DataFrame, as_of: str, n_tags: Column, stale_days: int = 90) -> DataFrame:
    days = F.date_diff(F.lit(as_of).cast("date"), "updated")
    source, recency = F.least(F.col("n_sources") / 3.0, F.lit(1.0)), F.exp(-0.015 * F.greatest(days, F.lit(0)))
    links = F.least(F.size(wikilinks(F.col("body"))) / 5.0, F.lit(1.0))
    tagged, placed = n_tags > 0, F.col("domain") != "misc"
    tag = F.when(tagged & placed, 1.0).when(tagged | placed, 0.5).otherwise(0.1)
    overall = (source + recency + links + tag) / 4.0
    state = F.when(F.col("archived"), "archived").when(days > stale_days, "stale").when(overall >= 0.75, "verified").when(overall >= 0.5, "reviewed").otherwise("draft")
    return pages.select("page_no", F.round(source, 6).alias("source_score"), F.round(recency, 6).alias("recency"), F.round(links, 6).alias("cross_refs"), F.round(tag, 6).alias("tag_coverage"), F.round(overall, 6).alias("overall"), state.alias("state"))


def upsert_pages(state: DataFrame, change: DataFrame, as_of: str) -> DataFrame:
    """New pages by slug replace old ones, but keep their id and day of creation; `updated` is stamped."""
    old = state.select("slug", F.col("id").alias("_id"), F.col("created").alias("_created"))
    new = change.join(old, "slug", "left").withColumns({"id": F.coalesce("_id", "id"), "created": F.coalesce("_created", "created"), "updated": F.lit(as_of).cast("date")}).select(*state.columns)
    return state.join(change.select("slug"), "slug", "left_anti").select(*state.columns).unionByName(new)


def upsert_index(index: DataFrame, change: DataFrame) -> DataFrame:
    """Entries by exact title are replaced in place; others come after the last."""
    last = index.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"))
    numbered = numbered_on(change, range_pieces(change, "pos"), ["pos"])
    old = index.select("title", F.col("pos").alias("_pos"))
    new = numbered.join(old, "title", "left").crossJoin(F.broadcast(last)).withColumn("pos", F.coalesce("_pos", F.col("_last") + F.col("_n"))).select(*index.columns)
    return index.join(change.select("title"), "title", "left_anti").select(*index.columns).unionByName(new)


def archive_page(pages: DataFrame, index: DataFrame, entities: DataFrame, mentions: DataFrame, page_no: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The page is flagged, its entry leaves the index, its mentions leave the graph."""
    was = pages.where(F.col("page_no") == page_no)
    flagged = pages.withColumn("archived", F.col("archived") | (F.col("page_no") == page_no))
    return flagged, index.join(was.select("title"), "title", "left_anti").select(*index.columns), *delete_page(entities, mentions, page_no)


def restore_page(pages: DataFrame, index: DataFrame, page_no: int) -> tuple[DataFrame, DataFrame]:
    """An archived page is flagged no longer and gets an index entry with an empty summary; one that is not stays."""
    back = pages.where((F.col("page_no") == page_no) & F.col("archived")).select(F.lit(0).alias("pos"), "title", F.lit("").alias("summary"))
    return pages.withColumn("archived", F.col("archived") & (F.col("page_no") != page_no)), upsert_index(index, back)


def insert_chunks(chunks: DataFrame, new: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with the new ones and their vectors by chunk_id, all or none: one without its vector, or the reverse, raises."""
    bad = new.select("chunk_id", F.lit(1).alias("_c")).join(vectors.select("chunk_id", F.lit(1).alias("_v")), "chunk_id", "full").where("_c IS NULL OR _v IS NULL").limit(1)
    if bad.head(1):
        raise ValueError("chunks and vectors do not match")
    return chunks.unionByName(new.join(vectors, "chunk_id").select(*chunks.columns))


def list_sources(chunks: DataFrame, *by: str) -> DataFrame:
    """A row per source: its chunks, its oldest chunk's created_at, and its place, newest first. Places go to sources, few beside chunks."""
    each = chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.min("created_at").alias("created_at"))
    day = F.unix_date(F.to_date("created_at"))
    order = [F.desc("created_at"), *by]
    return numbered_on(each.withColumn("_d", -day), range_pieces(each.withColumn("_d", -day), "_d"), order).drop("_d").withColumn("pos", F.col("_n").cast("int")).drop("_n")


def reindex_plan(current: DataFrame, known: DataFrame) -> DataFrame:
    """What incremental indexing does with each source: skip, replace or new, by content hash."""
    now = current.withColumn("content_hash", F.sha2("content", 256))
    old = known.select("source_path", F.col("content_hash").alias("_old"))
    action = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("content_hash"), "skip").otherwise("replace")
    return now.join(old, "source_path", "left").select("source_path", "content_hash", action.alias("action"))


# entities


def upsert_entities(rows: DataFrame) -> DataFrame:
    """Rows (pos, canonical, type, description, page_id) folded by name without ASCII case: first spelling and type, last page and description."""
    r = rows.withColumn("key", ascii_fold(F.col("canonical")))
    text = F.when(F.col("description") != "", F.struct("pos", "description"))
    page = F.when(F.col("page_id").isNotNull(), F.struct("pos", "page_id"))
    out = r.groupBy("key").agg(F.min_by("canonical", "pos").alias("canonical"), F.min_by("type", "pos").alias("type"), F.max(text).alias("_d"), F.max(page).alias("_p"), F.count("*").alias("n_rows"))
    return out.select("key", "canonical", "type", F.coalesce("_d.description", F.lit("")).alias("description"), F.col("_p.page_id").alias("page_id"), "n_rows")


def find_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, entity_id): by canonical name, else by alias, ASCII case aside; the smallest id of equals."""
    known = entities.select(ascii_fold(F.col("canonical")).alias("key"), F.lit(0).alias("prio"), "entity_id").union(aliases.select(ascii_fold(F.col("alias")), F.lit(1), "entity_id"))
    best = known.groupBy("key").agg(F.min(F.struct("prio", "entity_id")).alias("b"))
    return names.withColumn("key", ascii_fold(F.col("name"))).join(best, "key", "left").select("name", F.col("b.entity_id").alias("entity_id"))


def pages_by_entity(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_id").agg(F.count_distinct("page_id").alias("n_pages"))


def graph_stats(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    each = entities.select("entity_id").join(pages_by_entity(mentions), "entity_id", "left")
    out = each.agg(F.count("*").alias("n_entities"), F.count_if(F.coalesce("n_pages", F.lit(0)) <= 1).alias("n_singletons"))
    return out.crossJoin(F.broadcast(mentions.agg(F.count("*").alias("n_mentions")))).withColumn("singleton_rate", F.round(F.try_divide("n_singletons", "n_entities"), 6))


def knowledge_gaps(entities: DataFrame, mentions: DataFrame, sample: int = 3) -> DataFrame:
    """Entities without a page, by the pages that mention them, with the first few of those.

    The sample comes from distinct pairs ranked within the entity, so no list of all pages is built.
    """
    bare = entities.where("page_id IS NULL").select("entity_id", "canonical")
    pairs = mentions.select("entity_id", "page_id").distinct().join(bare, "entity_id")
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("page_id")))
    out = ranked.groupBy("entity_id", "canonical").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.when(F.col("r") <= sample, F.col("page_id")))).alias("_s"))
    return out.select("entity_id", "canonical", "n_pages", F.array_join(F.transform("_s", lambda x: x.cast("string")), ",").alias("sample"))


def shared_pairs(mentions: DataFrame, low: int = 2, high: int = 6) -> DataFrame:
    """(a, b, weight): pages that share entities seen on low..high pages. The bound keeps the pairs per entity few."""
    m = mentions.select("entity_id", "page_id").distinct()
    some = m.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n").between(low, high)).select("entity_id")
    few = m.join(some, "entity_id", "left_semi")
    right = few.select("entity_id", F.col("page_id").alias("b"))
    return few.withColumnRenamed("page_id", "a").join(right, "entity_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def delete_page(entities: DataFrame, mentions: DataFrame, page_id: int) -> tuple[DataFrame, DataFrame]:
    """Mentions on the page go, its entities lose it, entities with neither page nor mention go."""
    left = mentions.where(F.col("page_id") != page_id)
    loose = entities.withColumn("page_id", F.when(F.col("page_id") != page_id, F.col("page_id")))
    mentioned = left.select("entity_id").distinct().withColumn("_m", F.lit(True))
    kept = loose.join(mentioned, "entity_id", "left").where("page_id IS NOT NULL OR _m").drop("_m")
    return kept, left


def rekey(mentions: DataFrame, ids: DataFrame) -> DataFrame:
    """Anchors that are slugs become ids; what is an id, or unknown, stays."""
    return mentions.join(ids.select(F.col("slug").alias("anchor"), "id"), "anchor", "left").withColumn("anchor", F.coalesce("id", "anchor")).drop("id")


# claims


def active(claims: DataFrame) -> DataFrame:
    return claims.where("valid_to IS NULL")


def claims_as_of(claims: DataFrame, day: str) -> DataFrame:
    d = F.lit(day).cast("date")
    return claims.where((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") > d)))


def add_claims(claims: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    sound = new.where((F.trim("text") != "") & F.col("confidence").between(0.0, 1.0))
    return claims.unionByName(sound.withColumns({"valid_from": F.coalesce("valid_from", F.lit(as_of).cast("date")), "valid_to": F.lit(None).cast("date"), "superseded_by": F.lit(None).cast("long")}).select(*claims.columns))


def supersede(claims: DataFrame, pairs: DataFrame, as_of: str) -> DataFrame:
    """pairs (claim_id, by): both must exist; the row stays, closed."""
    sound = pairs.join(claims.select(F.col("claim_id").alias("by")), "by", "left_semi").groupBy("claim_id").agg(F.max("by").alias("by"))
    out = claims.join(sound, "claim_id", "left")
    return out.withColumns({"valid_to": F.when(F.col("by").isNotNull(), F.lit(as_of).cast("date")).otherwise(F.col("valid_to")), "superseded_by": F.coalesce("by", "superseded_by")}).select(*claims.columns)


def corroborate(claims: DataFrame, hits: DataFrame, delta: float = 0.1) -> DataFrame:
    """Each hit adds delta to the confidence, up to 1."""
    n = hits.groupBy("claim_id").agg(F.count("*").alias("_n"))
    return claims.join(n, "claim_id", "left").withColumn("confidence", F.when(F.col("_n").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + F.col("_n") * delta)).otherwise(F.col("confidence"))).select(*claims.columns)


def replace_source(claims: DataFrame, source_id: int, new: DataFrame) -> DataFrame:
    """The source's claims go, what they superseded points nowhere but stays closed; the new ones come."""
    gone = claims.where(F.col("source_id") == source_id).select(F.col("claim_id").alias("_gone"))
    kept = claims.where(F.col("source_id") != source_id).join(gone, F.col("superseded_by") == F.col("_gone"), "left")
    kept = kept.withColumn("superseded_by", F.when(F.col("_gone").isNull(), F.col("superseded_by"))).select(*claims.columns)
    return kept.unionByName(new.select(*claims.columns))


def apply_decisions(claims: DataFrame, decided: DataFrame, as_of: str) -> DataFrame:
    """decided (claim_id, decision, target, ...): ADD and SUPERSEDE insert, MERGE and NOOP corroborate, SUPERSEDE retires."""
    fresh = decided.where(F.col("decision").isin("ADD", "SUPERSEDE"))
    out = corroborate(claims, decided.where(F.col("decision").isin("MERGE", "NOOP")).select(F.col("target").alias("claim_id")))
    out = add_claims(out, fresh, as_of)
    return supersede(out, decided.where("decision = 'SUPERSEDE'").select(F.col("target").alias("claim_id"), F.col("claim_id").alias("by")), as_of)
