"""Questions answered from pages and chunks, many at once: search, context, prompt, call, and what is kept of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safety import sanitize_query
from ..functions.text import slugify
from .ranking import rag_context
from .rendering import qa_prompt
from .workers import stored

# What is said where no page is found.
NO_PAGES = "The wiki does not contain any pages relevant to this question yet. Try ingesting some sources on this topic first."
#: Words that are sought, and questions that are compared, in one pass over the rows.
PASS_WORDS, PASS_QUESTIONS = 100_000, 1 << 14
#: Vectors and questions that are compared at once.
NEAR_ROWS, NEAR_QUESTIONS = 2048, 1024
#: Entries and questions that meet in one task.
BLOCK_ENTRIES, BLOCK_QUESTIONS = 1 << 15, 1 << 17


def keyword_hits(questions: DataFrame, index: DataFrame, k: int = 5, domain: str | None = None) -> DataFrame:
    """(qid, pos, title, score, rank): RK1 for all questions; with a domain the best 2k of each are fetched, then filtered, then k.

    An entry's text is read once for all words: which of them it contains is found by an automaton over the distinct words of the
    questions, `PASS_WORDS` at a time. Questions then meet entries in blocks, and only the 2k best of a question in a block leave
    it: a word that all entries have makes no pairs.
    """
    asked = questions.select("qid", F.explode(F.split(F.lower("question"), r"\s+")).alias("word")).where("word <> ''").groupBy("qid", "word").agg(F.count("*").alias("times"))
    words = asked.select("word").distinct()
    n = words.count()
    passes = max(1, -(-n // PASS_WORDS))
    found = None
    for p in range(passes):
        some = words.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == p).select("word", F.xxhash64("word").alias("h")).collect()  # PASS_WORDS or so
        one = _containing(index, [(r.word, r.h) for r in some])
        found = one if found is None else found.unionByName(one)
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pos"))
    met = _best_of_blocks(asked, found, questions.count(), index.count(), 2 * k)
    top = met.withColumn("rank", best).where(F.col("rank") <= 2 * k).join(index.select("pos", "title", *(["domain"] if domain else [])), "pos")
    if domain:
        top = top.where(F.col("domain") == domain)
    again = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return top.withColumn("rank", again).where(F.col("rank") <= k).select("qid", "pos", "title", "score", "rank")


def _containing(index: DataFrame, words: list[tuple[str, int]]) -> DataFrame:
    """(pos, words): of (word, hash) the hashes of those that an entry's title and summary contain, as substrings, packed."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        made = ahocorasick.Automaton()
        for w, h in words:
            made.add_word(w, h)
        if words:
            made.make_automaton()
        for pdf in batches:
            hits = [(pos, {h for _, h in made.iter(text)} if words else ()) for pos, text in zip(pdf["pos"], pdf["t"], strict=True)]
            yield pd.DataFrame([(pos, np.fromiter(h, "<i8", len(h)).tobytes()) for pos, h in hits if h], columns=["pos", "words"])

    return index.select(F.col("pos").cast("long").alias("pos"), F.lower(F.concat_ws(" ", "title", "summary")).alias("t")).mapInPandas(each, "pos long, words binary")


def _best_of_blocks(asked: DataFrame, found: DataFrame, n_questions: int, n_entries: int, k: int) -> DataFrame:
    """(qid, pos, score): of asked (qid, word, times) the k best entries of found (pos, words) in each block of entries.

    Entries are copied to each block of questions and questions to each block of entries. Within a block a question's score is
    the sum of its words' rows, dense ones as a vector over the entries, the others as postings.
    """
    kind = asked.schema["qid"].dataType.simpleString()
    blocks, parts = max(1, -(-n_entries // BLOCK_ENTRIES)), max(1, -(-n_questions // BLOCK_QUESTIONS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = F.collect_list(F.struct(F.xxhash64("word").alias("h"), F.col("times").alias("n")))  # a question's words
    sought = asked.groupBy("qid").agg(wanted.alias("w")).select("qid", F.col("w.h").alias("hs"), F.col("w.n").alias("ns"), F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("j")).withColumn("i", every(blocks))
    dealt = found.withColumn("i", F.pmod(F.xxhash64("pos"), F.lit(blocks)).cast("int")).withColumn("j", every(parts))

    def each(entries: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(some):
            pos, row = np.unique(entries["pos"].to_numpy(np.int64), return_inverse=True)
            packed = [np.frombuffer(x, "<i8") for x in entries["words"]]
            word, at = np.unique(np.concatenate(packed), return_inverse=True)
            row = np.repeat(row, [len(x) for x in packed]).astype(np.int32)
            order = np.lexsort((row, at))
            ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(word))))
            row, n = row[order], len(pos)
            most = max(map(sum, some["ns"]))
            narrow = np.uint8 if most < 256 else np.int64
            dense: dict[int, np.ndarray] = {}
            for q, hs, ns in zip(some["qid"], some["hs"], some["ns"], strict=True):
                hs = np.asarray(hs, np.int64)
                where = np.searchsorted(word, hs)
                score, few = None, []
                for w, h, times in zip(where, hs, ns, strict=True):
                    if w == len(word) or word[w] != h:
                        continue
                    posting = row[ends[w] : ends[w + 1]]
                    if len(posting) * 32 < n:
                        few.append((posting, times))
                        continue
                    if w not in dense:
                        dense[w] = np.zeros(n, narrow)
                        dense[w][posting] = 1
                    score = dense[w] * narrow(times) if score is None else score + dense[w] * narrow(times)
                if score is not None:
                    for posting, times in few:
                        score[posting] += narrow(times)
                    rows, sums = _highest(score, k)
                elif few:
                    rows, back = np.unique(np.concatenate([p for p, _ in few]), return_inverse=True)
                    sums = np.bincount(back, np.repeat([t for _, t in few], [len(p) for p, _ in few])).astype(np.int64)
                    if len(rows) > k:
                        first = np.lexsort((rows, -sums))[:k]
                        rows, sums = rows[first], sums[first]
                else:
                    continue
                out.append((q, pos[rows], sums))
        sizes = [len(p) for _, p, _ in out]
        joined = lambda i: np.concatenate([x[i] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64)
        qids = pd.Series([q for q, _, _ in out], dtype=some["qid"].dtype if out else object).repeat(sizes).reset_index(drop=True)
        return pd.DataFrame({"qid": qids, "pos": joined(1), "score": joined(2)})

    return dealt.groupBy("i", "j").cogroup(sought.groupBy("i", "j")).applyInPandas(each, f"qid {kind}, pos long, score long")


def _highest(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k places of highest scores above 0."""
    if score.dtype == np.uint8:
        reached = np.cumsum(np.bincount(score, minlength=256)[::-1])  # how many have 255, 254 or more, ...
        level = 255 - int(np.searchsorted(reached, k))
    else:
        level = int(np.partition(score, -k)[-k]) if len(score) >= k else 0
    level = max(1, level)
    above = np.flatnonzero(score > level)
    rows = np.concatenate((above, np.flatnonzero(score == level)[: k - len(above)]))
    return rows, score[rows].astype(np.int64)


def nearest_chunks(questions: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """(qid, chunk_id, distance): the k chunks of least L2 distance to each question's vector, the smaller id of equals.

    Questions (qid, vector) go to every task, `PASS_QUESTIONS` at a time; a task keeps the k best of each, and those of all
    tasks are merged.
    """
    n = questions.count()
    passes = max(1, -(-n // PASS_QUESTIONS))
    found = None
    for p in range(passes):
        some = questions.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p).select("qid", "vector").collect()
        if not some and (found is not None or p + 1 < passes):
            continue
        one = _near(chunks, np.array([r.qid for r in some], np.int64), np.array([r.vector for r in some], float).reshape(len(some), len(some[0].vector) if some else 1), k)
        found = one if found is None else found.unionByName(one)
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.asc_nulls_last("distance"), "chunk_id"))  # what is no number comes as null
    return found.withColumn("r", r).where(F.col("r") <= k).drop("r")


def _near(chunks: DataFrame, qids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """The k nearest of each question in each task.

    Products tell which distances may be among the k least so far, up to their rounding; only these are computed as they are defined.
    """
    square = (vectors**2).sum(-1)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, ds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # the best so far, by question, distance and id
        most = np.full(len(qids), np.inf)  # of the k-th
        for pdf in batches:
            pdf = pdf[pdf["embedding"].notna()]
            if not len(pdf) or not len(qids):
                continue
            for low in range(0, len(pdf), NEAR_ROWS):
                part = pdf.iloc[low : low + NEAR_ROWS]
                x, own = np.array(part["embedding"].tolist(), float), part["chunk_id"].to_numpy(np.int64)
                found = [(at, ids, ds)]
                for first in range(0, len(qids), NEAR_QUESTIONS):
                    some = slice(first, first + NEAR_QUESTIONS)
                    i, j = _may_be_near(vectors[some], square[some], x, most[some], k)
                    for cut in range(0, len(i), 1 << 16):
                        q, c = i[cut : cut + (1 << 16)] + first, j[cut : cut + (1 << 16)]
                        found.append((q, own[c], np.sqrt(((x[c] - vectors[q]) ** 2).sum(-1))))
                at, ids, ds = (np.concatenate(z) for z in zip(*found, strict=True))
                order = np.lexsort((ids, ds, at))
                at, ids, ds = at[order], ids[order], ds[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                most[at[place == k - 1]] = ds[place == k - 1]
                at, ids, ds = (z[place < k] for z in (at, ids, ds))
        yield pd.DataFrame({"qid": qids[at], "chunk_id": ids, "distance": ds})

    return chunks.select("chunk_id", "embedding").mapInPandas(each, "qid long, chunk_id long, distance double")


def _may_be_near(vectors: np.ndarray, square: np.ndarray, x: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of vectors and x whose distance may be among the k least of a vector; what is not a number may be."""
    own = (x**2).sum(-1)
    with np.errstate(invalid="ignore", over="ignore"):
        d = square[:, None] + own - 2 * (vectors @ x.T)
        slack = 1e-9 * (square + own.max(initial=0))
        limit = most**2
        if len(x) > k and np.isinf(limit).any():
            limit = np.fmin(limit, np.partition(d, k - 1, axis=1)[:, k - 1] + slack)
        return np.nonzero(~(d > (limit + slack)[:, None]))


def contexts(questions: DataFrame, index: DataFrame, pages: DataFrame, chunks: DataFrame | None = None, k: int = 5, chunk_k: int = 5, domain: str | None = None) -> DataFrame:
    """(qid, question, level, blocked, prompt, citations): what each question is asked with; prompt is null where nothing is found.

    Pages (title, body) of the best entries come first, in their order, then one chunk a section, nearest first. An entry whose page
    is missing is passed over. A question at high risk of injection is blocked, and has neither prompt nor citations. Questions
    are stored, as each step reads them: what they come from is read once.
    """
    safe = stored(questions, "questions").withColumn("_s", sanitize_query(F.col("question")))
    sound = safe.where("NOT _s.blocked")
    hits = keyword_hits(sound.select("qid", "question"), index, k, domain).join(pages.select("title", "body"), "title")
    parts = hits.select("qid", F.struct(F.lit(0).alias("part"), F.col("rank").cast("double").alias("at"), F.col("pos").alias("tie"), F.col("title").alias("title"), "body").alias("p"))
    if chunks is not None:
        near = nearest_chunks(sound.select("qid", "vector"), chunks, 2 * chunk_k).join(chunks.drop("embedding", "label"), "chunk_id")
        # rag_context keeps a row a source and section; here of each question
        first = rag_context(near.withColumn("source_no", F.struct("qid", "source_no")).withColumn("page_title", F.col("page_title")))
        label = F.when(F.col("page_title").isNotNull(), F.col("label")).otherwise(F.concat(F.lit("[pdf] source "), F.col("source_no.source_no").cast("string")))
        r = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "chunk_id"))
        kept = first.withColumn("_label", label).withColumn("r", r).where(F.col("r") <= chunk_k)
        parts = parts.unionByName(kept.select("qid", F.struct(F.lit(1).alias("part"), F.col("distance").alias("at"), F.col("chunk_id").alias("tie"), F.col("_label").alias("title"), F.col("text").alias("body")).alias("p")))
    each = parts.groupBy("qid").agg(F.array_sort(F.collect_list("p")).alias("p"))  # k + chunk_k parts at most
    out = safe.join(each, "qid", "left")
    shown = F.transform("p", lambda p: F.struct(p.title.alias("title"), p.body.alias("body")))
    some = F.size(F.coalesce("p", F.array())) > 0
    return out.select("qid", "question", F.col("_s.level").alias("level"), F.col("_s.blocked").alias("blocked"), F.when(some, qa_prompt(F.col("_s.text"), shown)).alias("prompt"), F.when(some, F.transform("p", lambda p: p.title)).otherwise(F.array().cast("array<string>")).alias("citations"))


def answers(asked: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """contexts() with answer: ask(rows) adds reply to rows with a prompt; without one the answer says so; blocked ones have none."""
    replied = ask(asked.where("prompt IS NOT NULL")).select("qid", "question", "level", "blocked", "citations", F.col("reply").alias("answer"))
    none = asked.where("prompt IS NULL").select("qid", "question", "level", "blocked", "citations", F.when(~F.col("blocked"), F.lit(NO_PAGES)).alias("answer"))
    return replied.unionByName(none)


def saved(answered: DataFrame, day: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What answered questions leave behind: pages (slug, title, body, tags, domain, updated), index entries and log entries."""
    rows = answered.where("NOT blocked AND coalesce(answer, '') <> ''")
    q = F.col("question")
    slug, title = slugify(F.concat(F.lit("qa-"), F.left(q, F.lit(40)))), F.concat(F.lit("Q: "), F.left(q, F.lit(80)))
    body = F.concat(F.lit("# Q: "), q, F.lit("\n\n"), "answer", F.lit("\n\n## Sources\n\n"), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("- [["), c, F.lit("]]"))), "\n"))
    pages = rows.select(slug.alias("slug"), title.alias("title"), body.alias("body"), F.array(F.lit("qa"), F.lit("query")).alias("tags"), F.lit("misc").alias("domain"), F.lit(day).cast("date").alias("updated"))
    entries = rows.select(F.col("qid").alias("pos"), title.alias("title"), F.left(q, F.lit(120)).alias("summary"), F.lit("qa").alias("category"), F.lit("misc").alias("domain"))
    log = answered.select(F.lit("query").alias("operation"), F.left(q, F.lit(120)).alias("description"), F.when(F.coalesce("answer", F.lit("")) != "", F.array(slug)).otherwise(F.array().cast("array<string>")).alias("pages"))
    return pages, entries, log


def reconciled(propositions: DataFrame, candidates: DataFrame, ask: Callable[[DataFrame], DataFrame], prompt: Callable[[Column, Column], Column], parse: Callable[[Column, Column], Column]) -> DataFrame:
    """propositions (pid, text) with decision (decision, target): what each is to the claims it resembles, candidates (pid, claim_id, text, confidence).

    One without candidates is added, and no call is made for it. Any reply that cannot be read adds as well.
    """
    each = candidates.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("claim_id", "text", "confidence"))).alias("c"))  # a few, from a top-k search
    rows = propositions.join(each, "pid", "left")
    new = rows.where("c IS NULL").select(*propositions.columns, F.struct(F.lit("ADD").alias("decision"), F.lit(None).cast("long").alias("target")).alias("decision"), F.lit(False).alias("called"))
    asked = ask(rows.where("c IS NOT NULL").withColumn("prompt", prompt(F.col("text"), F.col("c"))))
    said = parse(F.col("reply"), F.transform("c", lambda c: c.claim_id.cast("long")))
    return new.unionByName(asked.select(*propositions.columns, F.struct(said["decision"].alias("decision"), said["target"].cast("long").alias("target")).alias("decision"), F.lit(True).alias("called")))
