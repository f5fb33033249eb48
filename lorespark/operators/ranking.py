"""Scores, similarity, retrieval and their metrics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import STOP_WORDS, TOKEN, collapse, content_words, tokens
from .chunking import sentences
from .similarity import cohesion_of
from .workers import stored

# Words that leave a chunk's start or sentence hanging.
DANGLING = "he she it they this these those which such who whom whose".split()
CONTINUATION = "and but however therefore thus hence moreover furthermore nevertheless".split()
#: How many of a corpus' commonest terms every task knows with their frequencies.
COMMON = 50_000


def keyword_score(question: str, text: Column) -> Column:
    """How many of the question's words, repeats included, are substrings of the text."""
    words = F.array(*[F.lit(w) for w in question.lower().split()])
    # bound to a variable, else each word would fold the text anew
    counted = F.transform(F.array(F.lower(text)), lambda low: F.aggregate(words, F.lit(0), lambda n, w: n + F.contains(low, w).cast("int")))
    return F.get(counted, 0)


def keyword_search(index: DataFrame, question: str, k: int = 5, domain: str | None = None) -> DataFrame:
    """The k best entries of (pos, title, summary); with a domain the best 2k are fetched first and then filtered."""
    scored = index.withColumn("score", keyword_score(question, F.concat_ws(" ", "title", "summary"))).where("score > 0")
    best = scored.orderBy(F.desc("score"), "pos").limit(2 * k if domain else k)
    return best.where(F.col("domain") == domain).orderBy(F.desc("score"), "pos").limit(k) if domain else best


def bm25_lite(text: Column, question: str, k1: float = 1.5) -> Column:
    """Sum over question tokens of ln(1 + 1/(1+tf)) * tf * (k1+1) / (tf+k1); no corpus statistics."""
    words = F.array(*[F.lit(w) for w in question.lower().split()])
    counted = F.transform(F.array(tokens(text)), lambda d: F.aggregate(words, F.lit(0.0), lambda s, q: s + _bm25_term(F.size(F.filter(d, lambda x: x == q)).cast("double"), k1)))
    return F.get(counted, 0)


def _bm25_term(tf: Column, k1: float) -> Column:
    return F.log(1 + 1 / (1 + tf)) * tf * (k1 + 1) / (tf + k1)


def overlap_cosine(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.sqrt(F.size(a) * F.size(b).cast("double")))


def overlap_search(df: DataFrame, concept: str, text: str = "text", k: int = 5) -> DataFrame:
    words = content_words(F.lit(concept))
    return df.withColumn("score", overlap_cosine(words, content_words(F.col(text)))).where("score > 0").withColumn("snippet", F.left(text, F.lit(220))).orderBy(F.desc("score"), "doc_id").limit(k)


def rouge1(a: Column, b: Column) -> Column:
    """F1 over token sets."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((both == 0) | (F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, probe: list[float], k: int = 10, metric: str = "l2", key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """The k rows nearest to one probe: a top-k merge, nothing else moves."""
    point = F.array(*[F.lit(float(x)) for x in probe])
    distance = l2(F.col(column), point) if metric == "l2" else 1 - cosine(F.col(column), point)
    return vectors.withColumn("distance", distance).orderBy("distance", key).limit(k)


def claim_search(claims: DataFrame, probe: list[float], k: int = 5, least: float = 0.6, without_page: int | None = None) -> DataFrame:
    """max(4k, 20) nearest by cosine, then: active ones, of other pages, similar enough; k of them."""
    near = knn(claims, probe, max(4 * k, 20), "cosine", "claim_id")
    kept = near.withColumn("similarity", 1 - F.col("distance")).where((F.col("similarity") >= least) & F.col("valid_to").isNull())
    if without_page is not None:
        kept = kept.where(F.col("page_id") != without_page)
    return kept.orderBy(F.desc("similarity"), "claim_id").limit(k)


def rag_context(hits: DataFrame) -> DataFrame:
    """One hit per (source, section), the closest, with a label by kind."""
    first = Window.partitionBy("source_no", F.coalesce("section_no", F.lit(-1))).orderBy("distance", "chunk_id")
    best = hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    label = F.when(F.col("page_title").isNotNull(), F.concat(F.lit("[wiki] "), "page_title")).otherwise(F.concat(F.lit("[pdf] source "), F.col("source_no").cast("string")))
    return best.withColumn("label", label)


def retrieval_metrics(ranks: DataFrame, k: int = 5) -> DataFrame:
    """Over (case_id, rank or null): n, precision at k, MRR, UDCG (may exceed 1) and the grade."""
    n = F.count("*")
    gain = F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    out = ranks.agg(n.alias("n"), F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias("precision_at_k"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), gain.alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    grade = F.when(F.col("precision_at_k") >= 0.7, "PASS").when(F.col("precision_at_k") >= 0.5, "WARN").otherwise("FAIL")
    return out.withColumn("udcg", F.when(F.col("n") > 0, F.col("gain") / ideal).otherwise(0.0)).withColumn("grade", grade).drop("gain")


def hope_parts(df: DataFrame, key: list[str], chunk: str = "chunk") -> DataFrame:
    """What a chunk's quality is without its size and cohesion: rc, dcc and bi, each rounded to 3 digits, and its number of tokens, n."""
    first = lambda text: F.regexp_extract(F.lower(text), TOKEN, 0)
    bound = df.withColumns({"_f": F.transform(F.slice(sentences(F.col(chunk)), 2, 1_000_000), first), "_line": F.trim(F.get(F.split(F.ltrim(F.regexp_replace(chunk, r"^\s+", "")), "\n"), 0)), "_end": F.right(F.regexp_replace(chunk, r"\s+$", ""), F.lit(1))})
    bound = bound.withColumn("_head", F.coalesce(first(F.col("_line")), F.lit("")))
    rc = F.when(F.size("_f") < 1, 1.0).otherwise(1 - F.size(F.filter("_f", lambda t: t.isin(*DANGLING))) / F.size("_f"))
    head = F.col("_head")
    one = F.left("_line", F.lit(1))
    dcc = F.when(F.col("_line") == "", 0.0).when(head == "", 0.5).when(head.isin(*CONTINUATION, *DANGLING), 0.2).when((F.upper(one) == one) & (F.lower(one) != one), 1.0).otherwise(0.6)
    bi = F.when(F.col("_end") == "", 0.0).when(F.col("_end").isin(".", "!", "?"), 1.0).when(F.col("_end") == ":", 0.7).otherwise(0.2)
    return bound.select(*key, F.round(rc, 3).alias("rc"), F.round(dcc, 3).alias("dcc"), F.round(bi, 3).alias("bi"), F.regexp_count(F.lower(chunk), F.lit(TOKEN)).alias("n"))


def size_score(n: Column, most: Column) -> Column:
    """sc of a chunk of n tokens: below 1 where they are fewer than 30 or more than `most`; rounded to 3 digits."""
    return F.round(F.when(n < 30, n / 30).when(n > most, F.greatest(F.lit(0.0), 1 - (n - most) / most)).otherwise(1.0), 3)


def hope(df: DataFrame, key: list[str], chunk: str = "chunk", most: int = 1024) -> DataFrame:
    """Chunk quality without cohesion: rc, dcc, bi, sc, each rounded to 3 digits."""
    return hope_parts(df, key, chunk).select(*key, "rc", "dcc", "bi", size_score(F.col("n"), F.lit(most)).alias("sc"))


def cohesion(df: DataFrame, key: list[str], chunk: str = "chunk") -> DataFrame:
    """Mean term-frequency cosine over the sentence pairs of each chunk (1 below two sentences). A chunk's sums stay in its row."""
    return df.select(*key, F.round(cohesion_of(sentences(F.col(chunk))), 3).alias("icc"))


def hope_means(scores: DataFrame) -> DataFrame:
    """Means of rc, icc, dcc, bi and sc over all chunks, their mean and its grade."""
    names = ("rc", "icc", "dcc", "bi", "sc")
    out = scores.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in names])
    return out.withColumn("overall", F.round(sum((F.col(c) for c in names), F.lit(0.0)) / len(names), 3)).withColumn("grade", hope_grade(F.col("overall")))


def hope_grade(overall: Column) -> Column:
    return F.when(overall >= 0.75, "PASS").when(overall >= 0.55, "WARN").otherwise("FAIL")


def match_ideas(ours: DataFrame, reference: DataFrame, threshold: float = 0.2) -> DataFrame:
    """For each idea of ours the reference idea of its source with the best ROUGE-1, the first of equals."""
    pairs = ours.join(reference, "source_id").withColumn("score", rouge1(tokens(F.col("idea")), tokens(F.col("ref_idea"))))
    best = pairs.groupBy("source_id", "idea_no").agg(F.max(F.struct("score", (-F.col("ref_no")).alias("r"))).alias("b"))
    return best.select("source_id", "idea_no", F.round("b.score", 6).alias("score"), F.when(F.col("b.score") > 0, -F.col("b.r")).alias("ref_no"), (F.col("b.score") >= threshold).alias("matched"))


def consensus(ours: DataFrame, reference: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Per source: share matched of the longer side, gaps, false positives, thesis, evidence, duplicates and the grade.

    ours: source_id, idea_no, idea, n_evidence; reference: source_id, ref_no, ref_idea, main_thesis. The thesis is captured
    if an idea matches a reference idea marked as one; where none is marked, if the score is at least a half.
    """
    matches = match_ideas(ours, reference, threshold)
    hit = matches.where("matched").select("source_id", "ref_no").distinct().withColumn("hit", F.lit(1))
    refs = reference.join(hit, ["source_id", "ref_no"], "left").groupBy("source_id").agg(F.count("*").alias("n_ref"), (F.count("*") - F.count("hit")).alias("n_gaps"))
    words = ours.select("source_id", "idea_no", F.array_distinct(tokens(F.col("idea"))).alias("w"))
    marked = reference.where("main_thesis").select("source_id", tokens(F.col("ref_idea")).alias("v"))
    thesis = words.join(marked, "source_id").groupBy("source_id").agg((F.max(rouge1(F.col("w"), F.col("v"))) >= threshold).alias("thesis"))
    again = words.alias("a").join(words.alias("b"), (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.idea_no") < F.col("b.idea_no")))
    twice = again.groupBy(F.col("a.source_id").alias("source_id")).agg(F.round(F.avg((rouge1(F.col("a.w"), F.col("b.w")) >= 0.6).cast("double")), 3).alias("duplicate_rate"))
    evidence = ours.groupBy("source_id").agg(F.round(F.avg((F.col("n_evidence") >= 1).cast("double")), 3).alias("evidence_rate"))
    out = matches.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"))
    for part in (refs, thesis, twice, evidence):
        out = out.join(part, "source_id", "left")
    out = out.withColumn("score", F.round(F.col("n_matched") / F.greatest("n", "n_ref"), 3))
    out = out.withColumn("thesis_captured", F.coalesce("thesis", F.col("score") >= 0.5))
    grade = F.when((F.col("score") >= 0.67) & F.col("thesis_captured") & (F.col("evidence_rate") >= 0.8), "PASS").when((F.col("score") >= 0.5) | F.col("thesis_captured"), "WARN").otherwise("FAIL")
    return out.select("source_id", "n", "n_ref", "n_matched", "n_gaps", (F.col("n") - F.col("n_matched")).alias("n_false"), "score", "thesis_captured", "evidence_rate", F.coalesce("duplicate_rate", F.lit(0.0)).alias("duplicate_rate"), grade.alias("grade"))


def idea_scores(ideas: DataFrame, by: list[str], key: str, threshold: float = 0.4) -> DataFrame:
    """ideas (by, key, chunk, title, importance, n_evidence) with recurrence (chunks with a like title) and score, recurrence x importance x evidence.

    Within `by` key tells ideas apart. The ideas of a source meet each other: they are what a model named in it, tens.
    """
    a = ideas.select(*by, key, F.array_distinct(tokens(F.col("title"))).alias("_w"))
    b = ideas.select(*by, F.col("chunk").alias("_chunk"), F.array_distinct(tokens(F.col("title"))).alias("_v"))
    met = a.join(b, by).where(rouge1(F.col("_w"), F.col("_v")) >= threshold).groupBy(*by, key).agg(F.count_distinct("_chunk").alias("recurrence"))
    out = ideas.join(met, [*by, key], "left").withColumn("recurrence", F.coalesce("recurrence", F.lit(0)))
    evidence = F.greatest(F.least("n_evidence", F.lit(3)) / 3.0, F.lit(0.1))
    return out.withColumn("score", F.col("recurrence") * F.col("importance") * evidence)


def ranked_ideas(ideas: DataFrame, by: str, most: int, threshold: float = 0.55) -> DataFrame:
    """Greedy groups of a source's ideas (by, idea_no, title, summary, domain, tags), each joining the first that its text is like.

    Groups come by size, then by first idea: the idea of the longest summary, all tags and the commonest domain, first
    met first. Order decides, so it is a fold over one source, whose ideas one text has given.
    """

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[tuple[set, list]] = []
        for r in pdf.sort_values("idea_no").itertuples():
            mine = set(re.findall(r"\w+", f"{r.title or ''} {r.summary or ''}".lower()))
            for like, members in groups:
                both = len(mine & like)
                if both and 2 * both / (len(mine) + len(like)) >= threshold:
                    members.append(r)
                    break
            else:
                groups.append((mine, [r]))
        rows = []
        for rank, (_, members) in enumerate(sorted(groups, key=lambda g: -len(g[1]))[:most]):
            first = max(members, key=lambda r: len(r.summary or ""))
            tags = list(dict.fromkeys(t for r in members if r.tags is not None for t in r.tags if t))
            domains = Counter(r.domain for r in members if r.domain)
            rows.append((getattr(members[0], by), rank, first.idea_no, members[0].idea_no, len(members), tags, domains.most_common(1)[0][0] if domains else first.domain))
        return pd.DataFrame(rows, columns=[by, "rank", "idea_no", "first_idea", "n", "tags", "domain"])

    kind = ideas.schema[by].dataType.simpleString()
    some = ideas.select(by, F.col("idea_no").cast("long").alias("idea_no"), "title", "summary", "domain", "tags")
    return some.groupBy(by).applyInPandas(each, f"{by} {kind}, rank int, idea_no long, first_idea long, n int, tags array<string>, domain string")


def preserved_spans(merged: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    """Merged ideas (by, idea_no, title, span) with a lost span refilled from the first candidate of that title with one."""
    title, span = F.lower(F.trim(F.coalesce("title", F.lit("")))), F.trim(F.coalesce("span", F.lit("")))
    known = candidates.select(by, title.alias("_t"), span.alias("_s"), "idea_no").where("_t <> '' AND _s <> ''").groupBy(by, "_t").agg(F.min_by("_s", "idea_no").alias("_s"))
    out = merged.withColumn("_t", title).join(known, [by, "_t"], "left")
    return out.withColumn("span", F.when(span != "", F.col("span")).otherwise(F.coalesce("_s", F.lit("")))).select(*merged.columns)


def verified_ideas(merged: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Merged ideas and those found missing whose title none of them has, after them; a source without ideas gets none."""
    title = F.lower(F.coalesce("title", F.lit(""))).alias("_t")
    last = merged.groupBy(by).agg(F.max("idea_no").alias("_last"))
    new = found.withColumn("_t", title).join(merged.select(by, title), [by, "_t"], "left_anti").join(last, by)
    return merged.unionByName(new.withColumn("idea_no", F.col("_last") + 1 + F.col("idea_no")).select(*merged.columns))


def decision_agreement(cases: DataFrame) -> DataFrame:
    """Over (pipeline_decision, judge_decision, pipeline_target, judge_target): n, both rates and the grade; WARN if there is none."""
    agree = F.col("pipeline_decision") == F.col("judge_decision")
    target = F.when(agree & (F.col("pipeline_decision") != "ADD"), F.col("pipeline_target").eqNullSafe(F.col("judge_target")).cast("double"))
    out = cases.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(agree.cast("double")), 3), F.lit(0.0)).alias("agreement_rate"), F.coalesce(F.round(F.avg(target), 3), F.lit(0.0)).alias("target_agreement_rate"))
    rate = F.col("agreement_rate")
    return out.withColumn("grade", F.when(F.col("n") == 0, "WARN").when(rate >= 0.8, "PASS").when(rate >= 0.6, "WARN").otherwise("FAIL"))


def answer_quality(verdicts: DataFrame, relevancy: DataFrame, key: str) -> DataFrame:
    """Per answer: faithfulness and hallucination rate of its claims' verdicts, relevancy if judged, the mean of what there is, grades."""
    good = (F.col("verdict") == "supported").cast("double")
    out = verdicts.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(good), 3).alias("faithfulness"), F.round(F.avg(1 - good), 3).alias("hallucination_rate")).join(relevancy, key, "left")
    f, r = F.col("faithfulness"), F.col("relevancy")
    return out.withColumns({
        # rounded as doubles are: the decimal rounding of F.round would lift a mean that lies just below a tie
        "overall": F.when(r.isNull(), f).otherwise(F.floor((f + r) / 2 * 1000 + 0.5) / 1000),
        "grade": F.when(f >= 0.75, "PASS").when(f >= 0.6, "WARN").otherwise("FAIL"),
        "relevancy_grade": F.when(r >= 0.7, "PASS").when(r >= 0.5, "WARN").when(r.isNotNull(), "FAIL"),
    })


def term_counts(lists: pa.ListArray, without: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, code, tf, terms): how often each row of a batch has each of its words; codes point into terms, rows ascend."""
    coded = lists.flatten().dictionary_encode()
    terms = coded.dictionary.to_pylist()
    at = np.repeat(np.arange(len(lists), dtype=np.int64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    pairs, tf = np.unique(at * max(len(terms), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, code = divmod(pairs, max(len(terms), 1))
    kept = np.array([t not in without for t in terms], dtype=bool)[code]
    return row[kept], code[kept], tf[kept], terms


def counted_terms(df: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """(*keys, term, tf): the words of each row but stop words, each once and counted; no row leaves its task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, tf, terms = term_counts(batch.column(len(keys)), STOP_WORDS)
            own = [batch.column(k).take(pa.array(row)) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(terms, pa.string()).take(pa.array(code)), pa.array(tf, pa.int64())], [*keys, "term", "tf"])

    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.select(*keys, words.alias("_words")).mapInArrow(each, f"{kinds}term string, tf long")


def _heaviest(row: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which terms may be among their row's n heaviest, by bounds of their weights; a slack keeps what rounding may tie."""
    order = np.lexsort((-low, row))
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    nth = np.minimum(starts + n - 1, len(row) - 1)
    least = np.where(row[nth] == row[starts], low[order[nth]], -np.inf) if len(row) else low
    return high >= np.repeat(least, np.diff(starts, append=len(row))) * (1 - 1e-9) - 1e-6


def tfidf_keywords(df: DataFrame, key: str, text: str, n: int = 10, first: int = 5, common: int = COMMON) -> DataFrame:
    """Per text the alphabetically first `first` of its `n` heaviest terms by smooth TF-IDF over the corpus.

    Words are counted where their text lies. The `common` commonest terms are known everywhere and bound the others' frequencies,
    so that only terms which may be among a text's n heaviest leave it and meet their own frequency; all others are lighter for certain.
    """
    n_docs, most = df.groupBy(key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    if most > 1:  # rows of one key are one text
        df = df.groupBy(key).agg(F.concat_ws(" ", F.collect_list(text)).alias(text))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    own = df.select(F.explode(F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))).alias("term"))
    freq = stored(own.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    top = freq.orderBy(F.desc("df"), "term").limit(common).collect()
    known, bound = {r.term: r.df for r in top}, top[-1].df if top else n_docs

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, tf, terms = term_counts(batch.column(1), STOP_WORDS)
            freqs = np.array([known.get(t, 0) for t in terms], dtype=np.int64)[code]
            idf = lambda d: np.log((1 + n_docs) / (1 + d)) + 1
            kept = _heaviest(row, tf * idf(np.where(freqs, freqs, bound)), tf * idf(np.where(freqs, freqs, 1)), n)
            row, code, tf, freqs = row[kept], code[kept], tf[kept], freqs[kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(terms, pa.string()).take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(freqs, pa.int64(), mask=freqs == 0)], ["_key", "term", "tf", "_df"])

    kind = df.schema[key].dataType.simpleString()
    kept = df.select(F.col(key).alias("_key"), words.alias("_words")).mapInArrow(candidates, f"_key {kind}, term string, tf long, _df long")
    if len(top) == common:
        # terms that are known meet nothing: each looks for a term of its own, which has a space and so is none
        kept = kept.withColumn("_on", F.when(F.col("_df").isNull(), F.col("term")).otherwise(F.concat_ws(" ", F.lit(""), F.xxhash64("_key").cast("string"), "term")))
        kept = kept.join(freq.select(F.col("term").alias("_on"), "df"), "_on", "left").withColumn("_df", F.coalesce("_df", "df"))
    weight = F.round(F.col("tf") * (F.log((1 + F.lit(n_docs)) / (1 + F.col("_df"))) + 1), 9)
    best = kept.withColumn("r", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc(weight), "term"))).where(F.col("r") <= n)
    return best.groupBy(F.col("_key").alias(key)).agg(F.array_join(F.slice(F.array_sort(F.collect_list("term")), 1, first), " ").alias("keywords"))


def token_set_accept(a: Column, b: Column) -> Column:
    """Whether a name a of two words or more covers b, or b covers it; a single word is part of too many names."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return (F.size(x) >= 2) & (F.size(F.array_intersect(x, y)) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & where.get(c, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def _processed(s: str | None) -> str:
    return "".join(c if c.isalnum() else " " for c in (s or "").lower()).strip()


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length in the longer."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a or a in b:
        return 100.0 if a else 0.0
    return max(ratio(a, b[max(0, k) : k + len(a)]) for k in range(1 - len(a), len(b)))


def near_part(a: str, b: str, least: float) -> bool:
    """Whether partial_ratio(a, b) is `least` or more.

    A window that close differs from the shorter text in at most d characters left out or put in, so one of d + 1 pieces
    of the shorter text stands in it unchanged, at most d away from its place: other windows need no comparison.
    """
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a or a in b:
        return bool(a)
    n = len(a)
    d = int(2 * n * (1 - least / 100) + 1e-9)
    cuts = [n * k // (d + 1) for k in range(d + 2)] if d < n else list(range(n + 1))
    votes: Counter[int] = Counter()
    for left, right in zip(cuts, cuts[1:]):
        piece, at = a[left:right], b.find(a[left:right])
        while piece and at >= 0:
            votes[at - left] += 1
            at = b.find(piece, at + 1)
    # where most pieces agree the window is likeliest; those around are looked at only if none of these is close enough
    likely = [k for k, _ in votes.most_common()]
    if any(ratio(a, b[max(0, k) : k + n]) >= least for k in likely if -n < k < len(b)):
        return True
    around = {k for at in likely for k in range(at - d, at + d + 1)} - votes.keys()
    return any(ratio(a, b[max(0, k) : k + n]) >= least for k in around if -n < k < len(b))


@F.pandas_udf(T.BooleanType())
def _near_part(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([near_part(x, y, m) for x, y, m in zip(a, b, least, strict=True)], dtype=bool)


def grounded_spans(rows: DataFrame, span: str, source: str, least: float = 90.0) -> DataFrame:
    """rows with grounded: the span, white space and case apart, is in the source, or a part of the source is like it.

    Spans that are contained, or empty, never leave the JVM.
    """
    a, b = collapse(F.coalesce(F.col(span), F.lit(""))), collapse(F.coalesce(F.col(source), F.lit("")))
    rows = rows.withColumns({"_a": a, "_b": b})
    easy = (F.col("_a") == "") | F.contains("_b", "_a")
    sure = rows.where(easy).withColumn("grounded", F.col("_a") != "")
    return sure.unionByName(rows.where(~easy).withColumn("grounded", _near_part("_a", "_b", F.lit(least)))).drop("_a", "_b")


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(" ".join(sorted(_processed(x).split())), " ".join(sorted(_processed(y).split()))) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def token_key(s: pd.Series) -> pd.Series:
    """What token_sort_ratio compares: the processed tokens, sorted."""
    return pd.Series([" ".join(sorted(_processed(x).split())) for x in s])


def covering_keys(ours: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): all pairs in which the tokens of one key are all in the other, a having two tokens or more.

    The rarest token of the smaller side is in the other, so each key is looked up by that one token only.
    """
    words = lambda df, name: df.select(F.col("key").alias(name), F.explode(F.array_distinct(F.split("key", " "))).alias("w"))
    a, b = words(ours.where(F.size(F.split("key", " ")) >= 2).distinct(), "a"), words(known.select("key").distinct(), "b")
    df = a.select("w").union(b.select("w")).groupBy("w").agg(F.count("*").alias("n"))
    rarest = lambda side, name: side.join(df, "w").groupBy(name).agg(F.min(F.struct("n", "w"))["w"].alias("w"))
    pairs = rarest(a, "a").join(b, "w").select("a", "b").union(a.join(rarest(b, "b"), "w").select("a", "b")).distinct()
    x, y = F.split("a", " "), F.split("b", " ")
    return pairs.where((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


@F.pandas_udf(T.DoubleType())
def partial_ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(_processed(x), _processed(y)) for x, y in zip(a, b, strict=True)])
