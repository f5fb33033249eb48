"""Queries of the shells: questions, reconciling, ideas, costs, stubs and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_decision
from ..operators import ideas as I
from ..operators import questions as Q
from ..operators import introspection, rendering, usage
from ..operators.workers import stored
from ..registry import query
from .external import MODELS, costs, ledger

_QUESTIONS = """
q AS (SELECT d.doc_id AS qid, array_to_string(list_filter(regexp_split_to_array(d.text, '\\s+'), x -> x <> '')[1:5], ' ') AS question, e.embedding::double[64] AS v FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 10 = 1)"""


def _questions(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The first five words of every tenth document that has a vector of its number."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    vectors = embeddings.select(F.col("vec_id").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return documents.where("doc_id % 10 = 1").select(F.col("doc_id").alias("qid"), F.array_join(F.slice(words, 1, 5), " ").alias("question")).join(vectors, "qid")


@query("documents", "embeddings", "fx_index", "fx_page", "fx_chunk", sql=f"""
WITH {_QUESTIONS.strip()}, w AS (SELECT qid, unnest(list_filter(regexp_split_to_array(lower(question), '\\s+'), x -> x <> '')) AS w FROM q),
h AS (SELECT qid, pos, any_value(title) AS title, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, pos) AS r FROM w JOIN fx_index i ON contains(lower(concat_ws(' ', i.title, i.summary)), w.w) GROUP BY qid, pos),
d AS (SELECT qid, chunk_id, source_no, section_no, page_title, array_distance(c.embedding::double[64], q.v) AS d FROM q, fx_chunk c), n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, chunk_id) <= 10),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY qid, source_no, section_no ORDER BY d, chunk_id) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, chunk_id) AS r FROM f),
p AS (SELECT qid, 0 AS part, r, title AS label FROM h WHERE r <= 5 UNION ALL SELECT qid, 1, r, CASE WHEN page_title IS NULL THEN '[pdf] source ' || source_no::string ELSE '[wiki] ' || page_title END FROM k WHERE r <= 5)
SELECT q.qid, q.question, string_agg(p.label, '|' ORDER BY part, p.r) AS citations FROM q JOIN p USING (qid) GROUP BY q.qid, q.question""")
def qa_questions(documents: DataFrame, embeddings: DataFrame, fx_index: DataFrame, fx_page: DataFrame, fx_chunk: DataFrame) -> DataFrame:
    """Many questions at once: the pages and chunks that each is answered from, in order."""
    chunks = fx_chunk.withColumn("text", F.lit("chunk"))
    found = Q.contexts(_questions(documents, embeddings), fx_index, fx_page, chunks)
    return found.where("prompt IS NOT NULL").select("qid", "question", F.array_join("citations", "|").alias("citations"))


@query("documents", "fx_index", "fx_page", sql=f"""
WITH a AS (SELECT doc_id AS qid, CASE WHEN doc_id % 3 = 0 THEN 'zzzzqq' ELSE 'topic ' || doc_id::string END AS question FROM documents WHERE doc_id % 10 = 2)
SELECT qid, CASE WHEN qid % 3 = 0 THEN '{Q.NO_PAGES}' ELSE 'said' END AS answer, CASE WHEN qid % 3 = 0 THEN 0 ELSE 1 END AS cites_own, 'qa-' || replace(question, ' ', '-') AS slug, 'Q: ' || question AS title FROM a""")
def qa_shell(documents: DataFrame, fx_index: DataFrame, fx_page: DataFrame) -> DataFrame:
    """From question to saved page: a third finds nothing, and no call is made for it."""
    n = F.col("doc_id")
    asked = documents.where("doc_id % 10 = 2").select(n.alias("qid"), F.when(n % 3 == 0, "zzzzqq").otherwise(F.concat(F.lit("topic "), n.cast("string"))).alias("question"))
    found = stored(Q.contexts(asked, fx_index.withColumn("summary", F.lit("")), fx_page), "contexts")
    done = stored(Q.answers(found, lambda rows: rows.withColumn("reply", F.lit("said"))), "answers")
    pages, entries, _ = Q.saved(done, "2024-12-31")
    own = F.array_contains("citations", F.concat(F.lit("Topic "), F.col("qid").cast("string"))).cast("int")
    named = entries.select(F.col("pos").alias("qid"), "title")
    out = done.select("qid", "answer", own.alias("cites_own"), F.concat(F.lit("qa-"), F.replace("question", F.lit(" "), F.lit("-"))).alias("slug")).join(named, "qid")
    return out.join(pages.select("slug").distinct(), "slug", "left_semi").select("qid", "answer", "cites_own", "slug", "title")


@query("fx_claim", sql="""
WITH p AS (SELECT claim_id AS pid FROM fx_claim WHERE claim_id % 10 = 1)
SELECT pid, CASE WHEN pid % 3 = 0 OR pid % 5 IN (0, 4) THEN 'ADD' ELSE ['MERGE', 'SUPERSEDE', 'NOOP'][pid % 5] END AS decision, CASE WHEN pid % 3 = 0 OR pid % 5 IN (0, 4) THEN NULL ELSE pid + 1 END AS target, pid % 3 > 0 AS called FROM p""")
def rc_reconcile(fx_claim: DataFrame) -> DataFrame:
    """Propositions against candidates: a third has none and is not asked; some replies name a claim that was not offered, or none that can be read."""
    n = F.col("claim_id")
    rows = fx_claim.where("claim_id % 10 = 1").select(n.alias("pid"), F.lit("t").alias("text"))
    some = rows.where("pid % 3 > 0").select("pid", F.explode(F.array(F.col("pid") + 1, F.col("pid") + 2)).alias("claim_id"), F.lit("c").alias("text"), F.lit(0.5).alias("confidence"))
    kind = F.element_at(F.array(*map(F.lit, ("MERGE", "SUPERSEDE", "NOOP", "MERGE"))), F.greatest((F.col("pid") % 5).cast("int"), F.lit(1)))
    target = F.when(F.col("pid") % 5 == 4, F.lit(-1)).otherwise(F.col("pid") + 1)
    reply = F.when(F.col("pid") % 5 == 0, "no JSON").otherwise(F.concat(F.lit("so: "), F.to_json(F.struct(F.lower(kind).alias("decision"), target.alias("target")))))
    out = Q.reconciled(rows, some, lambda asked: asked.withColumn("reply", reply), rendering.decision_prompt, parse_decision)
    return out.select("pid", "decision.decision", "decision.target", "called")


@query("documents")
def mm_ideas(documents: DataFrame) -> DataFrame:
    """Map, merge and verify over all documents with a stand-in for the model: an idea a chunk, named by its first long word."""
    word = F.regexp_extract("_text", "[A-Za-z]{4,}", 0)
    idea = F.struct(F.when(word == "", "none").otherwise(word).alias("title"), F.lit("s").alias("summary"), (F.col("chunk") % 5 + 1).alias("importance"), F.array(F.lit("e")).alias("evidence"), word.alias("source_span"))
    sources = documents.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.lit("article").alias("kind"), "text")
    out = I.extracted_ideas(sources, lambda rows: rows.withColumn("reply", F.to_json(F.array(idea))), lambda rows: rows.withColumn("reply", F.lit("no list")), lambda rows: rows.withColumn("reply", F.lit("[]")), lambda rows: stored(rows, "ideas"))
    return out.select("source_id", "idea_no", "title", "importance", "span")


_MODEL = "['m-large', 'm-small', 'local', 'other'][doc_id % 4 + 1]"


@query("documents", sql=f"""
WITH m(model, i, o) AS (VALUES ('m-large', 15.0, 75.0), ('m-small', 0.25, 1.25), ('local', 0.0, 0.0)),
c AS (SELECT doc_id, doc_id % 7 AS run_id, {_MODEL} AS model, greatest(1, length(text) // 4) AS n_in, greatest(1, length(text) // 8) AS n_out FROM documents)
SELECT run_id, count(*) AS calls, round(sum(coalesce(n_in / 1000000.0 * i + n_out / 1000000.0 * o, 0))::double, 6) AS cost_usd, sum(coalesce(n_in / 1000000.0 * i + n_out / 1000000.0 * o, 0)) >= 0.02 AS alert FROM c LEFT JOIN m USING (model) GROUP BY run_id""")
def x7_ledger(documents: DataFrame) -> DataFrame:
    """What the calls of a run cost by the model registry, and whether that reaches the threshold; unknown models cost nothing."""
    model = F.element_at(F.array(*map(F.lit, ("m-large", "m-small", "local", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    reply = F.left("text", F.floor(F.char_length("text") / 2).cast("int"))
    calls = documents.select((F.col("doc_id") % 7).alias("run_id"), model.alias("model"), F.col("text").alias("prompt"), reply.alias("reply"))
    models = documents.sparkSession.createDataFrame([("m-large", 200_000, 15.0, 75.0), ("m-small", 200_000, 0.25, 1.25), ("local", 8192, 0.0, 0.0)], MODELS)
    out = ledger(costs(calls, models), 0.02)
    return out.select("run_id", "calls", F.round("cost_usd", 6).alias("cost_usd"), "alert")


@query("fx_index", sql="""
SELECT title, 'topic-' || pos::string AS slug, left(summary, 80) AS description FROM (SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS r FROM (SELECT pos, title, summary, contains(lower(title || ' ' || summary), 'topic')::int + contains(lower(title || ' ' || summary), '1')::int AS score FROM fx_index) WHERE score > 0)
WHERE r <= 60 AND pos % 3 = 0 ORDER BY r LIMIT 30""")
def l9_search_stubs(fx_index: DataFrame) -> DataFrame:
    """Concept stubs of a search in one domain: twice as many are fetched as are shown."""
    index = fx_index.select("pos", "title", "summary", F.concat(F.lit("/wiki/topic-"), F.col("pos").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("pos") % 3 == 0, "tech").otherwise("misc").alias("domain"))
    return usage.search_stubs(index, "topic 1", "tech", 30).select("title", "slug", F.left("description", F.lit(80)).alias("description"))


@query("events", sql="""
WITH r AS (SELECT event_id, event_type, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events), d AS (SELECT max(ts::date) AS d FROM events)
SELECT 'last' AS slice, event_id FROM r WHERE r <= 25 UNION ALL SELECT 'day', event_id FROM events, d WHERE ts::date = d UNION ALL SELECT 'operation', event_id FROM events WHERE event_type = 'signup'""")
def sc7_log_slice(events: DataFrame) -> DataFrame:
    """The last entries, those of a day, those of an operation."""
    log = events.select("event_id", "ts", F.col("event_type").alias("operation"))
    day = log.agg(F.max(F.to_date("ts"))).first()[0]
    parts = {"last": usage.log_slice(log, "event_id", last=25), "day": usage.log_slice(log, "event_id", day=str(day)), "operation": usage.log_slice(log, "event_id", operation="signup")}
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("slice"), "event_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("events", "fx_page", sql="""
WITH e AS (SELECT ts::date AS day, event_id, ts FROM events), d AS (SELECT max(day) AS last FROM e), n AS (SELECT day, count(*) AS n FROM e GROUP BY day)
SELECT day, CASE WHEN day = last THEN 'saved' ELSE 'said ' || n::string END AS summary, day = last AS cached FROM n, d UNION ALL SELECT (last + 1)::date, 'said 0', false FROM d""")
def in_daily(events: DataFrame, fx_page: DataFrame) -> DataFrame:
    """Every day of the log and the day after; the last is saved already. The stand-in for the model counts the entries it is shown."""
    log = events.select("ts", F.lit("query").alias("operation"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"), F.array(F.concat(F.lit("page "), (F.col("user_id") % 5).cast("string"))).alias("pages"))
    days = events.select(F.to_date("ts").alias("day")).distinct()
    last = days.agg(F.max("day").alias("day"))
    days = days.union(last.select(F.date_add("day", 1)))
    counted = F.concat(F.lit("said "), F.regexp_count("prompt", F.lit(r"(?m)^- \[")).cast("string"))
    return introspection.daily(days, log, fx_page, lambda rows: rows.withColumn("reply", counted), last.withColumn("summary", F.lit("saved")))
