"""Ranking of search results for many concepts at once: TF-IDF cosine with the enriched query, else word overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_words
from .ranking import counted_terms, overlap_cosine
from .workers import stored

#: Words of two characters or more.
LONG_TOKEN = r"[\p{L}\p{N}_]{2,}"
SNIPPET = 220


def long_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LONG_TOKEN), F.lit(0))


def page_keywords(pages: DataFrame, key: str, text: str, n: int = 10, first: int = 5) -> DataFrame:
    """(key, keywords): of a text's own `n` commonest words, the first of equals by alphabet, the alphabetically first `first`."""
    tf = counted_terms(pages, [key], long_words(F.col(text))).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tf"), "term"))
    top = tf.withColumn("r", r).where(F.col("r") <= n).groupBy(key).agg(F.array_sort(F.collect_list("term")).alias("t"))
    return top.select(key, F.array_join(F.slice("t", 1, first), " ").alias("keywords"))


def tfidf_scores(asked: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, pos, score): TF-IDF cosine of each result with its query, 0 left out.

    asked: (query_id, query); results: (query_id, pos, text). A query and its results are a corpus of their own, with smooth
    idf, ln((1 + n) / (1 + df)) + 1, and L2 norms. Only the query's own terms meet those of its results.
    """
    rows = lambda df: df.groupBy("query_id").agg(F.count("*").alias("n"))
    n = rows(asked).unionByName(rows(results)).groupBy("query_id").agg(F.sum("n").alias("n"))
    sized = stored(asked.join(n, "query_id").select("query_id", "query", "n"), "queries")  # read thrice, and of a size that is known
    texts = results.join(sized.groupBy("query_id").agg(F.max("n").alias("n")), "query_id").select("query_id", F.col("pos").cast("long").alias("pos"), "n", "text")
    docs = sized.select("query_id", F.lit(None).cast("long").alias("pos"), "n", F.col("query").alias("text")).unionByName(texts)
    if any(not df.groupBy(*keys).count().where("count > 1").isEmpty() for df, keys in ((asked, ["query_id"]), (results, ["query_id", "pos"]))):  # they are one text
        docs = docs.groupBy("query_id", "pos", "n").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    tf = counted_terms(docs, ["query_id", "pos", "n"], long_words(F.col("text")))
    # a term's frequency and its weight in the query are read where the term's rows meet, once
    same = Window.partitionBy("query_id", "term")
    met = tf.withColumns({"df": F.count("*").over(same), "q_tf": F.max(F.when(F.col("pos").isNull(), F.col("tf"))).over(same)})
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    w = met.select("query_id", "pos", (F.col("tf") * idf).alias("w"), (F.col("q_tf") * idf).alias("q"))
    sums = w.groupBy("query_id", "pos").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("square"))
    sums = sums.where("dot > 0").withColumn("q_square", F.max(F.when(F.col("pos").isNull(), F.col("square"))).over(Window.partitionBy("query_id")))
    return sums.where("pos IS NOT NULL").select("query_id", "pos", (F.col("dot") / (F.sqrt("square") * F.sqrt("q_square"))).alias("score"))


def ranked_results(asked: DataFrame, results: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, pos, label, url, snippet, score): the k best results of each query, those without a score left out.

    asked: (query_id, concept, page_body); results: (query_id, pos, title, body, href) in the order of the search. With words in
    its page a query is enriched by keywords and scored by TF-IDF cosine, otherwise by word overlap; ties keep the search's order.
    """
    words = page_keywords(asked.where("page_body IS NOT NULL"), "query_id", "page_body")
    enriched = stored(asked.select("query_id", "concept").join(words, "query_id", "left"), "enriched")
    full = results.select("query_id", "pos", "title", "href", "body", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))).alias("text"))
    keyed = enriched.where("keywords <> ''").select("query_id", F.concat("concept", F.lit(" "), "keywords").alias("query"))
    by_cosine = tfidf_scores(keyed, full)
    bare = enriched.where("coalesce(keywords, '') = ''").select("query_id", "concept")
    # a text's words are bound, else each use would find them anew; so would a filter, and results without a score come last
    shared = F.get(F.transform(F.array(F.struct(content_words(F.col("concept")).alias("a"), content_words(F.col("text")).alias("b"))), lambda x: overlap_cosine(x.a, x.b)), 0)
    by_words = full.join(bare, "query_id").select("query_id", F.col("pos").cast("long").alias("pos"), shared.alias("score"))
    scored = by_cosine.unionByName(by_words)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "pos"))
    best = scored.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") > 0))
    about = full.select("query_id", "pos", F.col("title").alias("label"), F.col("href").alias("url"), F.left(F.coalesce("body", F.lit("")), F.lit(SNIPPET)).alias("snippet"))
    return best.join(about, ["query_id", "pos"]).select("query_id", "rank", "pos", "label", "url", "snippet", "score")
