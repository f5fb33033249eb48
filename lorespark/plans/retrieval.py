"""Queries of ranking, vectors and the question path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..operators import ablation, ranking, similarity, websearch
from ..registry import query

QUESTION = "what is topic 7 the on"
_WORDS = QUESTION.split()
_SCORE = " + ".join(f"contains(lower(concat_ws(' ', title, summary)), '{w}')::int" for w in _WORDS)
PROBE = [((k * 37) % 19 - 9) / 10.0 for k in range(64)]
_P = "[" + ", ".join(map(str, PROBE)) + "]::double[64]"
_V = "embedding::double[64]"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("fx_index", sql=f"SELECT pos, title, ({_SCORE})::int AS score FROM fx_index WHERE ({_SCORE}) > 0 ORDER BY score DESC, pos LIMIT 20")
def rk1_keyword_search(fx_index: DataFrame) -> DataFrame:
    return ranking.keyword_search(fx_index, QUESTION, 20).select("pos", "title", "score")


@query("fx_index", sql=f"SELECT pos, score FROM (SELECT pos, ({_SCORE})::int AS score FROM fx_index WHERE ({_SCORE}) > 0 ORDER BY score DESC, pos LIMIT 20) WHERE pos % 3 = 0 ORDER BY score DESC, pos LIMIT 10")
def rk2_domain_filter(fx_index: DataFrame) -> DataFrame:
    index = fx_index.withColumn("domain", F.when(F.col("pos") % 3 == 0, "tech").otherwise("misc"))
    return ranking.keyword_search(index, QUESTION, 10, "tech").select("pos", "score")


@query("documents", sql="""
SELECT doc_id, round(list_sum(list_transform(['the', 'of', 'que', 'the'], q -> ln(1 + 1 / (1 + len(list_filter(t, x -> x = q))::double)) * len(list_filter(t, x -> x = q)) * 2.5 / (len(list_filter(t, x -> x = q)) + 1.5))), 6) AS score
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)""")
def rk3_bm25_lite(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.round(ranking.bm25_lite(F.col("text"), "the of que the"), 6).alias("score"))


@query("documents", sql=f"""
WITH w AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), x -> length(x) > 1 AND NOT list_contains([{_STOP}], x)) AS b FROM documents)
SELECT doc_id, round(len(list_intersect(['thing', 'there', 'ation', 'inth', 'er', 'on'], b)) / sqrt(6.0 * len(b)), 6) AS score FROM w WHERE len(list_intersect(['thing', 'there', 'ation', 'inth', 'er', 'on'], b)) > 0""")
def rk4_overlap_cosine(documents: DataFrame) -> DataFrame:
    from ..functions.text import content_words

    concept = F.array(*map(F.lit, ["thing", "there", "ation", "inth", "er", "on"]))
    scored = documents.select("doc_id", F.round(ranking.overlap_cosine(concept, content_words(F.col("text"))), 6).alias("score"))
    return scored.where("score > 0")


@query("documents", sql=f"""
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), x -> NOT list_contains([{_STOP}], x))) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * (ln((1 + n) / (1 + df)::double) + 1), 9) DESC, term) AS r FROM tf JOIN df USING (term), n)
SELECT doc_id, array_to_string(list_sort(list(term) FILTER (WHERE r <= 10))[1:5], ' ') AS keywords FROM r GROUP BY doc_id""")
def rk5_tfidf_keywords(documents: DataFrame) -> DataFrame:
    return ranking.tfidf_keywords(documents, "doc_id", "text")


_TERMS = f"list_filter(regexp_extract_all(lower({{}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'), x -> NOT list_contains([{_STOP}], x))"


def _searches(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth document is a page with a concept, its first long word; the documents after it are its search results."""
    first = F.col("doc_id") - F.col("doc_id") % 50
    asked = documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("concept"), F.when(F.col("doc_id") % 100 == 0, F.col("text")).alias("page_body"))
    results = documents.where("doc_id % 50 > 0").select(first.alias("query_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("Topic "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("href"))
    return asked, results


@query("documents", sql=f"""
WITH a AS (SELECT doc_id AS query_id, regexp_extract(text, '[A-Za-z]{{4,}}') AS concept, CASE WHEN doc_id % 100 = 0 THEN text END AS page FROM documents WHERE doc_id % 50 = 0),
r AS (SELECT doc_id - doc_id % 50 AS query_id, doc_id AS pos, 'Topic ' || doc_id::string || ' ' || text AS t FROM documents WHERE doc_id % 50 > 0),
kt AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, term) AS r FROM (SELECT query_id, unnest({_TERMS.format('page')}) AS term FROM a WHERE page IS NOT NULL) GROUP BY query_id, term),
kw AS (SELECT query_id, array_to_string(list_sort(list(term))[1:5], ' ') AS k FROM kt WHERE r <= 10 GROUP BY query_id),
d AS (SELECT query_id, NULL::bigint AS pos, concept || ' ' || k AS t FROM a JOIN kw USING (query_id) UNION ALL SELECT query_id, pos, t FROM r WHERE query_id IN (SELECT query_id FROM kw)),
tf AS (SELECT query_id, coalesce(pos, -1) AS pos, term, count(*) AS tf FROM (SELECT query_id, pos, unnest({_TERMS.format('t')}) AS term FROM d) GROUP BY ALL), n AS (SELECT query_id, count(*) AS n FROM d GROUP BY query_id),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL), w AS (SELECT query_id, pos, term, tf * (ln((1 + n) / (1 + df)::double) + 1) AS w FROM tf JOIN df USING (query_id, term) JOIN n USING (query_id)),
nm AS (SELECT query_id, pos, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
cs AS (SELECT x.query_id, x.pos, sum(x.w * q.w) / any_value(nx.norm * nq.norm) AS score FROM w x JOIN w q ON q.query_id = x.query_id AND q.term = x.term AND q.pos = -1 AND x.pos <> -1 JOIN nm nx ON nx.query_id = x.query_id AND nx.pos = x.pos JOIN nm nq ON nq.query_id = x.query_id AND nq.pos = -1 GROUP BY x.query_id, x.pos),
cw AS (SELECT r.query_id, pos, list_filter(list_distinct(regexp_extract_all(lower(concept), '[a-z0-9]+')), x -> length(x) > 1 AND NOT list_contains([{_STOP}], x)) AS c, list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')), x -> length(x) > 1 AND NOT list_contains([{_STOP}], x)) AS b FROM r JOIN a USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM kw)),
ov AS (SELECT query_id, pos, len(list_intersect(c, b)) / sqrt(len(c) * len(b)::double) AS score FROM cw WHERE len(c) > 0 AND len(b) > 0 AND len(list_intersect(c, b)) > 0),
al AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, pos) AS rank FROM (SELECT * FROM cs UNION ALL SELECT * FROM ov))
SELECT query_id, rank::int AS rank, pos, round(score, 6) AS score FROM al WHERE rank <= 3""")
def rk5_enriched_cosine(documents: DataFrame) -> DataFrame:
    return websearch.ranked_results(*_searches(documents)).select("query_id", "rank", "pos", F.round("score", 6).alias("score"))


_TF = """tf AS (SELECT grp, id, term, count(*) AS tf FROM (SELECT grp, id, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+')) AS term FROM src) GROUP BY ALL),
nm AS (SELECT grp, id, sqrt(sum(tf * tf)::double) AS norm FROM tf GROUP BY ALL)"""


@query("documents", sql=f"""
WITH src AS (SELECT source AS grp, doc_id AS id, text AS t FROM documents), {_TF}
SELECT a.grp AS source, a.id AS a, b.id AS b, round(sum(a.tf * b.tf) / (any_value(na.norm) * any_value(nb.norm)), 6) AS cosine
FROM tf a JOIN tf b ON a.grp = b.grp AND a.term = b.term AND a.id < b.id JOIN nm na ON na.grp = a.grp AND na.id = a.id JOIN nm nb ON nb.grp = b.grp AND nb.id = b.id
JOIN (SELECT source, text AS t, min(doc_id) AS id FROM documents GROUP BY ALL) ka ON ka.id = a.id JOIN (SELECT source, text AS t, min(doc_id) AS id FROM documents GROUP BY ALL) kb ON kb.id = b.id
GROUP BY a.grp, a.id, b.id HAVING sum(a.tf * b.tf) / (any_value(na.norm) * any_value(nb.norm)) >= 0.7 - 1e-12""")
def rk6_tf_cosine(documents: DataFrame) -> DataFrame:
    short = documents.select("source", "doc_id", F.col("text").alias("t"))
    return similarity.tf_cosine_pairs(short, "source", "doc_id", "t", 0.7).select("source", "a", "b", F.round("cosine", 6).alias("cosine"))


@query("conversations", sql="""
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(list_intersect(a.w, b.w)) = 0 THEN 0 ELSE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END, 6) AS rouge FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def rk7_rouge1(conversations: DataFrame) -> DataFrame:
    a = conversations.select("conv_id", "turn", tokens(F.col("text")).alias("w"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ranking.rouge1(F.col("w"), F.col("v")), 6).alias("rouge"))


@query("documents", sql=f"""
WITH src AS (SELECT source AS grp, doc_id AS id, text AS t FROM documents), {_TF},
p AS (SELECT a.grp, a.id AS a, b.id AS b FROM tf a JOIN tf b ON a.grp = b.grp AND a.term = b.term AND a.id < b.id JOIN nm na ON na.grp = a.grp AND na.id = a.id JOIN nm nb ON nb.grp = b.grp AND nb.id = b.id
  GROUP BY a.grp, a.id, b.id HAVING sum(a.tf * b.tf) / (any_value(na.norm) * any_value(nb.norm)) >= 0.7 - 1e-12),
d AS (SELECT DISTINCT grp, id FROM (SELECT grp, a AS id FROM p UNION ALL SELECT grp, b FROM p))
SELECT s.grp AS source, count(*) AS n, count(d.id) AS n_dup, round(count(d.id) / count(*)::double, 6) AS duplicate_rate FROM src s LEFT JOIN d ON d.grp = s.grp AND d.id = s.id GROUP BY s.grp""")
def rk8_duplicate_rate(documents: DataFrame) -> DataFrame:
    return similarity.duplicate_rate(documents.select("source", "doc_id", F.col("text").alias("t")), "source", "doc_id", "t")


@query("fx_chunk", sql=f"SELECT chunk_id, round(array_distance({_V}, {_P}), 6) AS distance FROM fx_chunk ORDER BY array_distance({_V}, {_P}), chunk_id LIMIT 10")
def rk9_knn_l2(fx_chunk: DataFrame) -> DataFrame:
    return ranking.knn(fx_chunk, PROBE, 10).select("chunk_id", F.round("distance", 6).alias("distance"))


@query("fx_chunk", sql=f"""
SELECT claim_id, round(sim, 6) AS similarity FROM (SELECT chunk_id AS claim_id, label, section_no, array_cosine_similarity({_V}, {_P}) AS sim FROM fx_chunk ORDER BY sim DESC, chunk_id LIMIT 20)
WHERE label <> 3 AND section_no <> 2 AND sim >= 0.05 ORDER BY sim DESC, claim_id LIMIT 5""")
def rk10_claim_knn(fx_chunk: DataFrame) -> DataFrame:
    claims = fx_chunk.select(F.col("chunk_id").alias("claim_id"), F.col("section_no").alias("page_id"), "embedding", F.when(F.col("label") == 3, F.lit("2024-01-01")).alias("valid_to"))
    return ranking.claim_search(claims, PROBE, 5, 0.05, without_page=2).select("claim_id", F.round("similarity", 6).alias("similarity"))


@query("fx_chunk", sql=f"""
SELECT chunk_id AS candidate, section_no AS page_id, round(array_cosine_similarity({_V}, {_P}), 6) AS similarity FROM fx_chunk WHERE array_cosine_similarity({_V}, {_P}) >= 0.05 AND label <> 3 ORDER BY 3 DESC LIMIT 3""")
def rk11_candidates(fx_chunk: DataFrame) -> DataFrame:
    """Claims that a proposition may repeat: a projection of the claim search."""
    claims = fx_chunk.select(F.col("chunk_id").alias("claim_id"), F.col("section_no").alias("page_id"), "embedding", F.when(F.col("label") == 3, F.lit("2024-01-01")).alias("valid_to"))
    return ranking.claim_search(claims, PROBE, 3, 0.05).select(F.col("claim_id").alias("candidate"), "page_id", F.round("similarity", 6).alias("similarity"))


_RK12 = f"""
SELECT chunk_id, label, round(distance, 6) AS distance FROM (
  SELECT *, CASE WHEN page_title IS NULL THEN concat('[pdf] source ', source_no::string) ELSE concat('[wiki] ', page_title) END AS label, row_number() OVER (PARTITION BY source_no, section_no ORDER BY distance, chunk_id) AS r
  FROM (SELECT chunk_id, source_no, section_no, page_title, array_distance({_V}, {_P}) AS distance FROM fx_chunk ORDER BY distance, chunk_id LIMIT 50)) WHERE r = 1"""


@query("fx_chunk", sql=_RK12.replace("label, round", "label, round", 1))
def rk12_rag_context(fx_chunk: DataFrame) -> DataFrame:
    hits = ranking.knn(fx_chunk.drop("label"), PROBE, 50)
    return ranking.rag_context(hits).select("chunk_id", "label", F.round("distance", 6).alias("distance"))


@query("fx_index", "fx_chunk", sql=f"""
SELECT 0 AS part, pos::bigint AS id, title AS label, (-score)::double AS sort FROM (SELECT pos, title, ({_SCORE})::int AS score FROM fx_index WHERE ({_SCORE}) > 0 ORDER BY score DESC, pos LIMIT 5)
UNION ALL SELECT 1, chunk_id, label, distance FROM ({_RK12})""")
def qa_context(fx_index: DataFrame, fx_chunk: DataFrame) -> DataFrame:
    """The context of a question: keyword hits, then one vector hit per section."""
    words = ranking.keyword_search(fx_index, QUESTION, 5).select(F.lit(0).alias("part"), F.col("pos").cast("long").alias("id"), F.col("title").alias("label"), (-F.col("score")).cast("double").alias("sort"))
    near = ranking.rag_context(ranking.knn(fx_chunk.drop("label"), PROBE, 50)).select(F.lit(1).alias("part"), F.col("chunk_id").alias("id"), "label", F.round("distance", 6).alias("sort"))
    return words.unionByName(near)


@query("events", sql="""
SELECT n, precision_at_k, mrr, round(gain / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i)), 6) AS udcg, CASE WHEN precision_at_k >= 0.7 THEN 'PASS' WHEN precision_at_k >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS grade FROM (
 SELECT count(*) AS n, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS precision_at_k, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, sum(CASE WHEN r <= 5 THEN 1 / log2(r + 1) ELSE 0 END) AS gain
 FROM (SELECT CASE WHEN user_id % 10 < 7 THEN user_id % 10 + 1 END AS r FROM events))""")
def rk13_retrieval_metrics(events: DataFrame) -> DataFrame:
    ranks = events.select(F.col("event_id").alias("case_id"), F.when(F.col("user_id") % 10 < 7, F.col("user_id") % 10 + 1).alias("rank"))
    out = ranking.retrieval_metrics(ranks)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "mrr", "udcg")], "grade")


@query("fx_page")
def rk14_generated_cases(fx_page: DataFrame) -> DataFrame:
    """A sampling operator: 20 questions of pages with a body, by a seeded hash."""
    some = fx_page.where(~F.col("archived") & (F.char_length("body") >= 200)).orderBy(F.xxhash64("slug", F.lit(42))).limit(20)
    return some.select(F.concat(F.lit("What is "), F.replace("slug", F.lit("-"), F.lit(" ")), F.lit("?")).alias("question"), "slug")


_SENT = "list_filter(list_transform(string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), s -> trim(s, ' ')), s -> length(s) > 15)"
_W = ", ".join(f"'{w}'" for w in ranking.DANGLING)
_CW = ", ".join(f"'{w}'" for w in [*ranking.CONTINUATION, *ranking.DANGLING])


@query("documents", sql=f"""
SELECT doc_id, round(CASE WHEN len(s) < 2 THEN 1 ELSE 1 - len(list_filter(s[2:], x -> coalesce(list_contains([{_W}], regexp_extract(lower(x), '[\\p{{L}}\\p{{N}}_]+')), false))) / (len(s) - 1)::double END, 3) AS rc,
  round(CASE WHEN line = '' THEN 0 WHEN head = '' THEN 0.5 WHEN list_contains([{_CW}], head) THEN 0.2 WHEN upper(left(line, 1)) = left(line, 1) AND lower(left(line, 1)) <> left(line, 1) THEN 1 ELSE 0.6 END, 3)::double AS dcc,
  CASE WHEN e = '' THEN 0 WHEN e IN ('.', '!', '?') THEN 1 WHEN e = ':' THEN 0.7 ELSE 0.2 END::double AS bi,
  round(CASE WHEN n < 30 THEN n / 30.0 WHEN n > 1024 THEN greatest(0, 1 - (n - 1024) / 1024.0) ELSE 1 END, 3)::double AS sc FROM (
SELECT *, regexp_extract(lower(line), '[\\p{{L}}\\p{{N}}_]+') AS head FROM (SELECT doc_id, {_SENT} AS s, trim(string_split(regexp_replace(c, '^\\s+', ''), chr(10))[1], ' ') AS line, right(regexp_replace(c, '\\s+$', ''), 1) AS e, len(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}_]+')) AS n FROM (SELECT doc_id, text AS c FROM documents)))""")
def rk15_hope(documents: DataFrame) -> DataFrame:
    return ranking.hope(documents.select("doc_id", F.col("text").alias("chunk")), ["doc_id"])


@query("documents", sql=f"""
WITH s AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS pos, len(s) AS n FROM (SELECT doc_id, {_SENT} AS s FROM (SELECT doc_id, text AS c FROM documents))),
tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM s) GROUP BY ALL), nm AS (SELECT doc_id, pos, sqrt(sum(tf * tf)::double) AS norm FROM tf GROUP BY ALL),
pr AS (SELECT a.doc_id, sum(a.tf * b.tf / (na.norm * nb.norm)) AS t FROM tf a JOIN tf b ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos JOIN nm na ON na.doc_id = a.doc_id AND na.pos = a.pos JOIN nm nb ON nb.doc_id = b.doc_id AND nb.pos = b.pos GROUP BY a.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN coalesce(c.n, 0) < 2 THEN 1 ELSE coalesce(pr.t, 0) / (c.n * (c.n - 1) / 2) END, 3) AS icc FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN pr USING (doc_id)""")
def rk15_cohesion(documents: DataFrame) -> DataFrame:
    return ranking.cohesion(documents.select("doc_id", F.col("text").alias("chunk")), ["doc_id"])


@query("documents")
def rk16_ablation(documents: DataFrame) -> DataFrame:
    """For each text and size: chunks, their mean score and grade, the share of near-duplicate chunks and the verdict; one scan."""
    return ablation.chunk_sizes(documents, "doc_id", "text")


@query("documents", sql="SELECT doc_id, greatest(512, least(cast(floor(0.4 * n_chars) AS int), 1024)) AS best FROM documents")
def rk17_optimal_tokens(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.greatest(F.lit(512), F.least(F.floor(0.4 * F.col("n_chars")).cast("int"), F.lit(1024))).alias("best"))


def _ideas(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = conversations.select(F.col("conv_id").alias("source_id"), "turn", "role", "text")
    ours = rows.where("role = 'user'").select("source_id", F.col("turn").alias("idea_no"), F.col("text").alias("idea"))
    return ours, rows.where("role = 'assistant'").select("source_id", F.col("turn").alias("ref_no"), F.col("text").alias("ref_idea"))


_MATCH = """
ids AS (SELECT conv_id AS source_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations),
pr AS (SELECT a.source_id, a.turn AS idea_no, b.turn AS ref, CASE WHEN len(list_intersect(a.w, b.w)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END::double AS s FROM ids a JOIN ids b ON a.source_id = b.source_id AND a.role = 'user' AND b.role = 'assistant'),
mt AS (SELECT source_id, idea_no, round(s, 6) AS score, CASE WHEN s > 0 THEN ref END AS ref_no, s >= 0.2 AS matched FROM (SELECT *, row_number() OVER (PARTITION BY source_id, idea_no ORDER BY s DESC, ref) AS r FROM pr) WHERE r = 1)"""


@query("conversations", sql=f"WITH {_MATCH.strip()} SELECT * FROM mt")
def rk20_match_ideas(conversations: DataFrame) -> DataFrame:
    return ranking.match_ideas(*_ideas(conversations))


@query("conversations", sql=f"""
WITH {_MATCH.strip()}, h AS (SELECT DISTINCT source_id, ref_no FROM mt WHERE matched),
g AS (SELECT i.source_id, count(*) AS n_ref, count(h.ref_no) AS n_hit FROM ids i LEFT JOIN h ON h.source_id = i.source_id AND h.ref_no = i.turn WHERE role = 'assistant' GROUP BY ALL),
th AS (SELECT p.source_id, count(*) AS n_thesis, max(p.s) AS best FROM pr p WHERE p.source_id % 2 = 0 AND p.ref % 3 = 1 GROUP BY ALL),
ev AS (SELECT conv_id AS source_id, avg((len(regexp_extract_all(text, '[.!?]')) >= 1)::int) AS rate FROM conversations WHERE role = 'user' GROUP BY ALL),
du AS (SELECT a.source_id, avg((CASE WHEN len(list_intersect(a.w, b.w)) = 0 THEN 0 ELSE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END >= 0.6)::int) AS rate FROM ids a JOIN ids b ON a.source_id = b.source_id AND a.turn < b.turn AND a.role = 'user' AND b.role = 'user' GROUP BY ALL),
sc AS (SELECT m.source_id, count(*) AS n, count(*) FILTER (WHERE matched) AS n_matched, any_value(g.n_ref) AS n_ref, any_value(g.n_ref - g.n_hit) AS n_gaps, round(count(*) FILTER (WHERE matched) / greatest(count(*), any_value(g.n_ref))::double, 3) AS score,
  any_value(th.n_thesis) AS n_thesis, any_value(th.best) AS best, round(any_value(ev.rate), 3) AS evidence_rate, round(coalesce(any_value(du.rate), 0), 3) AS duplicate_rate
  FROM mt m JOIN g USING (source_id) LEFT JOIN th USING (source_id) LEFT JOIN ev USING (source_id) LEFT JOIN du USING (source_id) GROUP BY m.source_id),
r AS (SELECT *, CASE WHEN n_thesis > 0 THEN best >= 0.2 ELSE score >= 0.5 END AS thesis_captured FROM sc)
SELECT source_id, n, n_ref, n_matched, n_gaps, n - n_matched AS n_false, score, thesis_captured, evidence_rate::double AS evidence_rate, duplicate_rate::double AS duplicate_rate,
 CASE WHEN score >= 0.67 AND thesis_captured AND evidence_rate >= 0.8 THEN 'PASS' WHEN score >= 0.5 OR thesis_captured THEN 'WARN' ELSE 'FAIL' END AS grade FROM r""")
def rk21_consensus(conversations: DataFrame) -> DataFrame:
    """Users' turns against assistants': every third of an even conversation's is its main thesis, sentence ends stand for evidence."""
    ours, reference = _ideas(conversations)
    ours = ours.withColumn("n_evidence", F.regexp_count("idea", F.lit("[.!?]")))
    reference = reference.withColumn("main_thesis", (F.col("source_id") % 2 == 0) & (F.col("ref_no") % 3 == 1))
    return ranking.consensus(ours, reference)


@query("labels", sql="""
WITH c AS (SELECT doc_id, ['ADD', 'MERGE', 'SUPERSEDE', 'NOOP'][doc_id % 4 + 1] AS p, CASE WHEN toxic = 1 THEN 'NOOP' ELSE ['ADD', 'MERGE', 'SUPERSEDE', 'NOOP'][doc_id % 4 + 1] END AS j, CASE WHEN quality = 1 THEN doc_id ELSE doc_id + 1 END AS t FROM labels)
SELECT count(*) AS n, round(avg((p = j)::int), 3) AS agreement_rate, coalesce(round(avg((doc_id = t)::int) FILTER (WHERE p = j AND p <> 'ADD'), 3), 0) AS target_agreement_rate,
 CASE WHEN round(avg((p = j)::int), 3) >= 0.8 THEN 'PASS' WHEN round(avg((p = j)::int), 3) >= 0.6 THEN 'WARN' ELSE 'FAIL' END AS grade FROM c""")
def rk22_agreement(labels: DataFrame) -> DataFrame:
    """A judge that answers NOOP where the label says toxic, and another target where the quality is bad."""
    own = F.element_at(F.array(*map(F.lit, ("ADD", "MERGE", "SUPERSEDE", "NOOP"))), (F.col("doc_id") % 4 + 1).cast("int"))
    cases = labels.select(own.alias("pipeline_decision"), F.when(F.col("toxic") == 1, "NOOP").otherwise(own).alias("judge_decision"), F.col("doc_id").alias("pipeline_target"), F.when(F.col("quality") == 1, F.col("doc_id")).otherwise(F.col("doc_id") + 1).alias("judge_target"))
    return ranking.decision_agreement(cases)


@query("conversations", sql="""
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w, len(regexp_extract_all(text, '[.!?]')) AS n_evidence, turn % 5 + 1 AS importance FROM conversations),
r AS (SELECT a.conv_id, a.turn, any_value(a.importance) AS importance, any_value(a.n_evidence) AS n_evidence, count(DISTINCT b.turn) FILTER (WHERE CASE WHEN len(list_intersect(a.w, b.w)) = 0 THEN 0 ELSE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END >= 0.4) AS recurrence
  FROM t a JOIN t b ON a.conv_id = b.conv_id GROUP BY a.conv_id, a.turn)
SELECT conv_id, turn, recurrence, round(recurrence * importance * greatest(least(n_evidence, 3) / 3.0, 0.1), 6) AS score FROM r""")
def rk23_recurrence(conversations: DataFrame) -> DataFrame:
    """Ideas of a source by recurrence x importance x evidence: turns are chunks, sentence ends stand for items of evidence."""
    ideas = conversations.select("conv_id", F.col("turn").alias("chunk"), "turn", F.col("text").alias("title"), (F.col("turn") % 5 + 1).alias("importance"), F.regexp_count("text", F.lit("[.!?]")).alias("n_evidence"))
    return ranking.idea_scores(ideas, ["conv_id"], "turn").select("conv_id", "turn", "recurrence", F.round("score", 6).alias("score"))


@query("conversations")
def rk24_grouping(conversations: DataFrame) -> DataFrame:
    """A conversation's turns as ideas, their roles as domains."""
    ideas = conversations.select("conv_id", F.col("turn").alias("idea_no"), F.lit("").alias("title"), F.col("text").alias("summary"), F.col("role").alias("domain"), F.array("role", F.concat(F.lit("turn"), (F.col("turn") % 2).cast("string"))).alias("tags"))
    return ranking.ranked_ideas(ideas, "conv_id", 10)


def _merged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users' turns as merged ideas, a third with their span; what anyone but the system said, as candidates."""
    rows = conversations.select("conv_id", "turn", F.col("turn").alias("idea_no"), F.col("text").alias("title"), "role", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("span"))
    ours = rows.where("role = 'user'").withColumn("span", F.when(F.col("turn") % 3 == 0, F.col("span")))
    return ours.select("conv_id", "idea_no", "title", "span"), rows.where("role <> 'system'").select("conv_id", "idea_no", "title", "span")


@query("conversations", sql="""
WITH a AS (SELECT conv_id, turn, lower(text) AS t, role FROM conversations)
SELECT u.conv_id, u.turn, CASE WHEN u.turn % 3 = 0 THEN 'turn ' || u.turn::string ELSE coalesce('turn ' || min(s.turn)::string, '') END AS span FROM a u LEFT JOIN a s ON u.conv_id = s.conv_id AND u.t = s.t AND s.role <> 'system' WHERE u.role = 'user' GROUP BY u.conv_id, u.turn""")
def rk25_preserve_spans(conversations: DataFrame) -> DataFrame:
    return ranking.preserved_spans(*_merged(conversations), "conv_id").select("conv_id", F.col("idea_no").alias("turn"), "span")


@query("conversations", sql="""
WITH u AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user'), m AS (SELECT conv_id, max(turn) AS n FROM u GROUP BY 1)
SELECT conv_id, turn AS idea_no, md5(t) AS title FROM u UNION ALL
SELECT c.conv_id, m.n + 1 + c.turn, md5(lower(c.text)) FROM conversations c JOIN m USING (conv_id) WHERE c.role <> 'system' AND NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = c.conv_id AND u.t = lower(c.text))""")
def rk25_verified(conversations: DataFrame) -> DataFrame:
    return ranking.verified_ideas(*_merged(conversations), "conv_id").select("conv_id", "idea_no", F.md5(F.lower("title").cast("binary")).alias("title"))


@query("events", sql="""
WITH v AS (SELECT user_id, count(*) AS n, round(avg((event_type IN ('purchase', 'signup', 'click'))::int), 3) AS faithfulness, round(avg((event_type NOT IN ('purchase', 'signup', 'click'))::int), 3) AS hallucination_rate, round(max(CASE WHEN event_type = 'signup' THEN value / 500 END), 3) AS relevancy FROM events GROUP BY user_id)
SELECT user_id, n, faithfulness, hallucination_rate, relevancy, CASE WHEN relevancy IS NULL THEN faithfulness ELSE round((faithfulness + relevancy) / 2, 3) END AS overall,
 CASE WHEN faithfulness >= 0.75 THEN 'PASS' WHEN faithfulness >= 0.6 THEN 'WARN' ELSE 'FAIL' END AS grade, CASE WHEN relevancy IS NULL THEN NULL WHEN relevancy >= 0.7 THEN 'PASS' WHEN relevancy >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS relevancy_grade FROM v""")
def rk26_verdict_ratio(events: DataFrame) -> DataFrame:
    """A user's events as the verdicts on an answer's claims; a signup's value stands for the relevancy score."""
    verdict = F.when(F.col("event_type").isin("purchase", "signup", "click"), "supported").when(F.col("event_type") == "error", "contradicted").otherwise("unsupported")
    relevancy = events.where("event_type = 'signup'").groupBy("user_id").agg(F.round(F.max(F.col("value") / 500), 3).alias("relevancy"))
    return ranking.answer_quality(events.select("user_id", verdict.alias("verdict")), relevancy, "user_id")


@query("part")
def fz1_token_sort(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.round(ranking.token_sort_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@query("part", sql="""
WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[1] ELSE p_name END), '[\\p{L}\\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' extra' ELSE '' END)), '[\\p{L}\\p{N}_]+')) AS b FROM part)
SELECT p_partkey, len(a) >= 2 AND len(list_intersect(a, b)) > 0 AND (len(list_filter(a, x -> NOT list_contains(b, x))) = 0 OR len(list_filter(b, x -> NOT list_contains(a, x))) = 0) AS accepted FROM t""")
def fz2_subset_accept(part: DataFrame) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.get(F.split("p_name", " "), 0)).otherwise(F.col("p_name"))  # one word of a name is not enough
    other = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit(" extra")).otherwise(""))
    return part.select("p_partkey", ranking.token_set_accept(name, other).alias("accepted"))


@query("part")
def fz3_partial_ratio(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.round(ranking.partial_ratio_of(F.col("p_name"), F.concat("p_type", F.lit(" "), "p_name")), 6).alias("ratio"))


@query("events", sql="""
SELECT user_id, event_id, CASE WHEN r <= 5 THEN r END::int AS rank FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE event_type = 'purchase'""")
def w4_rank_within_k(events: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return events.withColumn("r", r).where("event_type = 'purchase'").select("user_id", "event_id", F.when(F.col("r") <= 5, F.col("r")).alias("rank"))
