"""Queries of usage, runs, lists and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import AS_OF
from ..operators import ranking, usage
from ..registry import ORACLE, query
from . import retrieval as retrieval  # its SQL is part of A15's

_TRACE = "count(*) AS calls, round(avg(latency_ms), 1) AS avg_latency, round(sum(cost_usd), 6) AS cost, round(avg((error IS NOT NULL)::int), 3) AS error_rate"


@query("fx_trace", sql=f"SELECT model, {_TRACE} FROM fx_trace GROUP BY model")
def a7_traces_by_model(fx_trace: DataFrame) -> DataFrame:
    return usage.trace_report(fx_trace, "model")


@query("fx_trace", sql=f"SELECT {_TRACE} FROM fx_trace")
def a7_trace_totals(fx_trace: DataFrame) -> DataFrame:
    return usage.trace_report(fx_trace)


@query("fx_trace", sql=f"SELECT task, {_TRACE} FROM fx_trace GROUP BY task")
def a7_traces_by_task(fx_trace: DataFrame) -> DataFrame:
    return usage.trace_report(fx_trace, "task")


@query("fx_trace", sql="SELECT run_id, round(sum(coalesce(cost_usd, 0)), 8) AS cost, round(sum(coalesce(cost_usd, 0)), 8) > 0.003 AS alert FROM fx_trace GROUP BY run_id")
def a8_session_cost(fx_trace: DataFrame) -> DataFrame:
    return usage.session_cost(fx_trace, 0.003)


@query("fx_run", sql="""
SELECT n_enriched, n_plain, round(e, 4) AS enriched, round(p, 4) AS plain, round(CASE WHEN p <> 0 THEN (e - p) / p * 100 END, 4) AS delta_pct FROM (
SELECT count(*) FILTER (WHERE enriched) AS n_enriched, count(*) FILTER (WHERE NOT enriched) AS n_plain, coalesce(avg(value) FILTER (WHERE enriched), 0) AS e, coalesce(avg(value) FILTER (WHERE NOT enriched), 0) AS p FROM fx_run)""")
def a9_comparison(fx_run: DataFrame) -> DataFrame:
    return usage.comparison(fx_run)


@query("fx_run", sql="SELECT chunk_count, count(*) AS n, round(avg(value), 2) AS avg_value, round(avg(score), 3) AS avg_score FROM fx_run GROUP BY chunk_count")
def a10_efficiency(fx_run: DataFrame) -> DataFrame:
    return usage.efficiency(fx_run)


@query("fx_run", sql="""
SELECT count(*) AS n, round(avg((grade = 'PASS')::int), 6) AS pass_rate, round(avg((grade = 'WARN')::int), 6) AS warn_rate, round(avg((grade = 'FAIL')::int), 6) AS fail_rate, round(avg(score), 6) AS mean_score FROM (SELECT * FROM fx_run ORDER BY id DESC LIMIT 100)""")
def a14_consensus_summary(fx_run: DataFrame) -> DataFrame:
    return usage.grade_rates(fx_run)


@query("documents", sql=f"""
WITH h AS ({ORACLE['rk15_hope']}), c AS ({ORACLE['rk15_cohesion']}), m AS (SELECT count(*) AS n, round(avg(rc), 3) AS rc, round(avg(icc), 3) AS icc, round(avg(dcc), 3) AS dcc, round(avg(bi), 3) AS bi, round(avg(sc), 3) AS sc FROM h JOIN c USING (doc_id))
SELECT *, round((rc + icc + dcc + bi + sc) / 5, 3) AS overall, CASE WHEN round((rc + icc + dcc + bi + sc) / 5, 3) >= 0.75 THEN 'PASS' WHEN round((rc + icc + dcc + bi + sc) / 5, 3) >= 0.55 THEN 'WARN' ELSE 'FAIL' END AS grade FROM m""")
def a15_mean_score(documents: DataFrame) -> DataFrame:
    """The chunk metrics' means over all chunks, here whole documents, their mean and its grade."""
    chunks = documents.select("doc_id", F.col("text").alias("chunk"))
    return ranking.hope_means(ranking.hope(chunks, ["doc_id"]).join(ranking.cohesion(chunks, ["doc_id"]), "doc_id"))


@query("fx_page", "documents", sql="""
WITH src AS (SELECT p.domain AS grp, d.doc_id AS id, left(d.text, 300) AS t FROM documents d JOIN fx_page p ON p.page_no = d.doc_id), tf AS (SELECT grp, id, term, count(*) AS tf FROM (SELECT grp, id, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+')) AS term FROM src) GROUP BY ALL),
nm AS (SELECT grp, id, sqrt(sum(tf * tf)::double) AS norm FROM tf GROUP BY ALL),
p AS (SELECT a.grp, a.id AS a, b.id AS b FROM tf a JOIN tf b ON a.grp = b.grp AND a.term = b.term AND a.id < b.id JOIN nm na ON na.grp = a.grp AND na.id = a.id JOIN nm nb ON nb.grp = b.grp AND nb.id = b.id GROUP BY a.grp, a.id, b.id HAVING sum(a.tf * b.tf) / (any_value(na.norm) * any_value(nb.norm)) >= 0.7 - 1e-12),
d AS (SELECT DISTINCT grp, id FROM (SELECT grp, a AS id FROM p UNION ALL SELECT grp, b FROM p)), r AS (SELECT s.grp AS domain, CASE WHEN count(*) < 2 THEN 0 ELSE round(count(d.id) / count(*)::double, 6) END AS idea_duplicate_rate FROM src s LEFT JOIN d ON d.grp = s.grp AND d.id = s.id GROUP BY s.grp)
SELECT domain, round(avg(length(body)), 4) AS avg_chars, round(avg(len(regexp_extract_all(body, '\\[\\[([^\\[\\]]+)\\]\\]', 1))), 4) AS avg_links, any_value(idea_duplicate_rate)::double AS idea_duplicate_rate FROM fx_page JOIN r USING (domain) GROUP BY domain""")
def a16_ingest_record(fx_page: DataFrame, documents: DataFrame) -> DataFrame:
    """Domains stand for ingests; the beginnings of their documents are the ideas' summaries."""
    ideas = documents.select(F.col("doc_id").alias("page_no"), F.left("text", F.lit(300)).alias("summary")).join(fx_page.select("page_no", "domain"), "page_no")
    return usage.ingest_records(fx_page, ideas, "domain", "page_no")


@query("events", sql="""
WITH e AS (SELECT event_id, ts, event_type, 'Topic ' || (user_id)::string AS title FROM events WHERE ts::date >= date '2024-01-24'), f AS (SELECT title, min(struct_pack(t := ts, i := event_id)) AS a FROM e GROUP BY title)
SELECT (SELECT count(*) FROM f) AS pages_active, (SELECT count(*) FROM e WHERE event_type = 'view') AS queries_made, (SELECT string_agg(title, '|' ORDER BY a) FROM (SELECT * FROM f ORDER BY a LIMIT 40)) AS titles""")
def a17_digest(events: DataFrame) -> DataFrame:
    """Events as log entries: a view is a query, and its user's topic the page that it touches."""
    kind = F.when(F.col("event_type") == "view", "query").otherwise("ingest")
    entries = events.select(F.col("event_id").alias("id"), "ts", kind.alias("operation"), F.array(F.concat(F.lit("Topic "), F.col("user_id").cast("string"))).alias("pages"))
    return usage.digest(entries, "2024-01-24").withColumn("titles", F.array_join("titles", "|"))


@query("fx_run", sql="SELECT eval_type, count(*) AS n, count(CASE WHEN enriched THEN score END) AS scored, round(avg(CASE WHEN enriched THEN score END), 6) AS mean_score FROM fx_run GROUP BY eval_type")
def a18_eval_summary(fx_run: DataFrame) -> DataFrame:
    s = F.when(F.col("enriched"), F.col("score"))
    return fx_run.groupBy("eval_type").agg(F.count("*").alias("n"), F.count(s).alias("scored"), F.round(F.avg(s), 6).alias("mean_score"))


@query("fx_run", sql="SELECT id, eval_type, score FROM (SELECT *, row_number() OVER (PARTITION BY eval_type ORDER BY id DESC) AS r FROM (SELECT * FROM fx_run ORDER BY id DESC LIMIT 100)) WHERE r = 1")
def w1_latest_run(fx_run: DataFrame) -> DataFrame:
    return usage.latest_per_type(fx_run).select("id", "eval_type", "score")


@query("fx_run", sql="SELECT id, eval_type, row_number() OVER (PARTITION BY eval_type ORDER BY id)::int AS nth FROM (SELECT *, row_number() OVER (PARTITION BY eval_type ORDER BY id DESC) AS r FROM fx_run) WHERE r <= 30")
def w2_history(fx_run: DataFrame) -> DataFrame:
    return usage.history_per_type(fx_run).select("id", "eval_type", "nth")


@query("conversations", sql="SELECT conv_id, role, arg_min(turn, turn) AS first_turn, md5(arg_min(text, turn)) AS first_text FROM conversations GROUP BY ALL")
def w3_first_per_key(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.md5(F.min_by("text", "turn").cast("binary")).alias("first_text"))


@query("conversations", sql="SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations")
def w5_running_context(conversations: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return conversations.select("conv_id", "turn", F.last(F.when(F.col("role") != "assistant", F.col("role")), ignorenulls=True).over(w).alias("context"))


@query("conversations", sql="SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS chunk_index FROM conversations")
def w6_chunk_offset(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("chunk_index"))


@query("fx_mention", sql="SELECT entity_id, page_id FROM (SELECT entity_id, page_id, row_number() OVER (PARTITION BY entity_id ORDER BY page_id) AS r FROM (SELECT DISTINCT entity_id, page_id FROM fx_mention)) WHERE r <= 3")
def w7_sample_per_group(fx_mention: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("entity_id").orderBy("page_id"))
    return fx_mention.select("entity_id", "page_id").distinct().withColumn("r", r).where("r <= 3").drop("r")


@query("fx_page", sql="""
SELECT page_no, r::int AS nth, t AS total FROM (SELECT page_no, row_number() OVER (ORDER BY updated DESC, page_no) AS r, count(*) OVER () AS t FROM fx_page WHERE domain = 'tech' AND contains(lower(title), '1')) WHERE r > 10 AND r <= 20""")
def l1_page_list(fx_page: DataFrame) -> DataFrame:
    """The second page of ten: the window only sees the first twenty."""
    some = fx_page.where("domain = 'tech' AND contains(lower(title), '1')").select("page_no", "updated")
    total = some.agg(F.count("*").alias("total"))
    top = some.orderBy(F.desc("updated"), "page_no").limit(20).withColumn("nth", F.row_number().over(Window.orderBy(F.desc("updated"), "page_no")))
    return top.where("nth > 10").crossJoin(F.broadcast(total)).select("page_no", "nth", "total")


_DECAY = """
WITH g AS (SELECT *, coalesce(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY domain, tag ORDER BY ts, event_id))) / 86400000000.0), 0) AS gap FROM fx_curiosity),
s AS (SELECT *, sum(gap) OVER (PARTITION BY domain, tag ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c, sum(gap) OVER (PARTITION BY domain, tag) AS t FROM g)
SELECT domain, tag, round(sum(exp(-0.1 * (t - c))), 6) AS weight, max(ts) AS last_seen FROM s GROUP BY ALL"""


@query("fx_curiosity", sql=_DECAY)
def ops1_decayed_interest(fx_curiosity: DataFrame) -> DataFrame:
    return usage.decayed_interest(fx_curiosity)


@query("fx_curiosity", sql=f"SELECT domain, tag, weight, CASE WHEN weight >= 2 THEN 'rising' WHEN weight < 0.5 THEN 'fading' ELSE 'stable' END AS trend FROM ({_DECAY}) ORDER BY weight DESC, domain, tag LIMIT 10")
def l2_top_interests(fx_curiosity: DataFrame) -> DataFrame:
    return usage.trend(usage.decayed_interest(fx_curiosity)).orderBy(F.desc("weight"), "domain", "tag").limit(10).drop("last_seen")


@query("fx_trace", sql="SELECT id, task, model FROM fx_trace ORDER BY id DESC LIMIT 50")
def l3_recent(fx_trace: DataFrame) -> DataFrame:
    return fx_trace.orderBy(F.desc("id")).limit(50).select("id", "task", "model")


@query("fx_run", sql="SELECT id, score, grade FROM (SELECT * FROM fx_run ORDER BY score, id DESC LIMIT 50) WHERE grade = 'WARN'")
def l4_worst_runs(fx_run: DataFrame) -> DataFrame:
    return fx_run.orderBy("score", F.desc("id")).limit(50).where("grade = 'WARN'").select("id", "score", "grade")


@query("fx_entity", sql="SELECT entity_id, canonical FROM fx_entity WHERE type = 'person' ORDER BY lower(canonical), entity_id LIMIT 500")
def l5_entities_by_type(fx_entity: DataFrame) -> DataFrame:
    return fx_entity.where("type = 'person'").orderBy(F.lower("canonical"), "entity_id").limit(500).select("entity_id", "canonical")


@query("fx_claim", sql="SELECT claim_id, source_id, confidence FROM fx_claim WHERE page_id = 11 AND valid_to IS NULL")
def l6_claims_of_page(fx_claim: DataFrame) -> DataFrame:
    return fx_claim.where("page_id = 11 AND valid_to IS NULL").orderBy(F.desc("claim_id")).select("claim_id", "source_id", "confidence")


@query("fx_page", sql="SELECT page_no, updated FROM fx_page ORDER BY updated DESC, page_no LIMIT 10")
def l7_recent_pages(fx_page: DataFrame) -> DataFrame:
    return fx_page.orderBy(F.desc("updated"), "page_no").limit(10).select("page_no", "updated")


@query("fx_page", "fx_curiosity", sql=f"""
SELECT page_no, d AS age, g AS matched FROM (SELECT page_no, updated, date '{AS_OF}' - updated AS d, 'tag' || (page_no % 20)::string AS g FROM fx_page)
WHERE d > 14 AND g IN (SELECT tag FROM ({_DECAY}) ORDER BY weight DESC, domain, tag LIMIT 5) ORDER BY updated, page_no LIMIT 5""")
def l8_revisit(fx_page: DataFrame, fx_curiosity: DataFrame) -> DataFrame:
    """Pages that match the real top interests; a page's second tag follows its number."""
    pages = fx_page.withColumn("tags", F.array("domain", F.concat(F.lit("tag"), (F.col("page_no") % 20).cast("string"))))
    return usage.revisit(pages, usage.decayed_interest(fx_curiosity), AS_OF).select("page_no", F.col("age").cast("long").alias("age"), F.array_join("matched", ",").alias("matched"))


@query("fx_page", sql="SELECT page_no, title FROM fx_page WHERE domain = 'health' AND NOT archived")
def l9_concepts(fx_page: DataFrame) -> DataFrame:
    return fx_page.where("domain = 'health' AND NOT archived").select("page_no", "title")


@query("fx_page", sql="SELECT page_no, length(body) AS n_chars FROM fx_page ORDER BY length(body) DESC, page_no LIMIT 1")
def l10_longest(fx_page: DataFrame) -> DataFrame:
    best = fx_page.agg(F.max(F.struct(F.char_length("body").alias("n"), (-F.col("page_no")).alias("p"))).alias("b"))
    return best.select((-F.col("b.p")).alias("page_no"), F.col("b.n").cast("long").alias("n_chars"))


@query("fx_page", sql="SELECT page_no, archived FROM fx_page WHERE title = 'Topic 12' OR archived")
def l11_lookup(fx_page: DataFrame) -> DataFrame:
    return fx_page.where("title = 'Topic 12' OR archived").select("page_no", "archived")


@query("fx_run", sql="SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN date '2024-01-31' - run_at::date < 3 THEN 'fresh' WHEN date '2024-01-31' - run_at::date <= 14 THEN 'ageing' ELSE 'stale' END AS bucket FROM fx_run) GROUP BY bucket")
def l12_staleness(fx_run: DataFrame) -> DataFrame:
    return usage.staleness(fx_run, "2024-01-31").groupBy("bucket").agg(F.count("*").alias("n"))


@query("part", sql="SELECT p_partkey, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_any, len(list_filter(a, x -> NOT list_contains(b, x))) AS n_only FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(concat(p_type, ' ', p_name)), ' ')) AS b FROM part)")
def u1_set_algebra(part: DataFrame) -> DataFrame:
    a, b = F.array_distinct(F.split(F.lower("p_name"), " ")), F.array_distinct(F.split(F.lower(F.concat("p_type", F.lit(" "), "p_name")), " "))
    return part.select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("n_both"), F.size(F.array_union(a, b)).cast("long").alias("n_any"), F.size(F.array_except(a, b)).cast("long").alias("n_only"))


@query("fx_curiosity", sql="SELECT d::date AS day, count(c.event_id) AS n FROM (SELECT unnest(generate_series(timestamp '2023-10-12', timestamp '2024-01-31', interval 1 day)) AS d) LEFT JOIN fx_curiosity c ON c.ts::date = d::date GROUP BY 1")
def ops2_heatmap(fx_curiosity: DataFrame) -> DataFrame:
    return usage.heatmap(fx_curiosity, "2024-01-31")


@query("fx_curiosity", sql="SELECT event_id FROM fx_curiosity WHERE ts::date >= date '2024-01-24'")
def ops3_trailing(fx_curiosity: DataFrame) -> DataFrame:
    return fx_curiosity.where(F.col("ts").cast("date") >= F.date_sub(F.lit("2024-01-31").cast("date"), 7)).select("event_id")


@query("fx_curiosity", sql="SELECT event_id, domain FROM fx_curiosity WHERE ts::date = date '2024-01-15'")
def ops4_day_slice(fx_curiosity: DataFrame) -> DataFrame:
    return fx_curiosity.where(F.col("ts").cast("date") == F.lit("2024-01-15").cast("date")).select("event_id", "domain")


@query("fx_trace", sql="SELECT id, run_id, round(sum(cost_usd) OVER (PARTITION BY run_id ORDER BY started_at, id ROWS UNBOUNDED PRECEDING), 8) AS running, round(sum(cost_usd) OVER (PARTITION BY run_id ORDER BY started_at, id ROWS UNBOUNDED PRECEDING), 8) > 0.003 AS alert FROM fx_trace")
def ops5_running_cost(fx_trace: DataFrame) -> DataFrame:
    return usage.running_cost(fx_trace, 0.003).select("id", "run_id", "running", "alert")


@query("documents", sql="SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def ops6_content_dedup(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("conversations", sql="SELECT conv_id, turn, ceil(len(regexp_extract_all(text, '\\S+')) / 8.0)::bigint AS n_frames FROM conversations")
def ops10_frames(conversations: DataFrame) -> DataFrame:
    from ..functions.text import words

    w = words(F.col("text"))
    frames = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(8)), lambda k: k)
    return conversations.select("conv_id", "turn", F.when(F.size(w) == 0, 0).otherwise(F.size(frames)).cast("long").alias("n_frames"))


@query("conversations", sql="SELECT conv_id, turn, (k // 8)::int AS frame_no, array_to_string(w[k + 1:k + 8], ' ') AS frame FROM (SELECT conv_id, turn, w, unnest(range(0, len(w), 8)) AS k FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS w FROM conversations))")
def ops10_frame_texts(conversations: DataFrame) -> DataFrame:
    return usage.frames(conversations.select("conv_id", "turn", "text")).select("conv_id", "turn", "frame_no", "frame")
