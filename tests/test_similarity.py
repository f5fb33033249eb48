"""Similarity joins, windows and the ablation against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespark.functions.text import tokens
from lorespark.operators import ablation, chunking, numbering, ranking, similarity
from lorespark.operators import knowledge as K


def counts(text):
    return Counter(re.findall(r"\w+", (text or "").lower()))


def cosine(a, b):
    dot = sum(a[w] * b[w] for w in a)
    size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return dot / size if size else 0.0


@pytest.fixture(scope="module")
def made():
    rng, words = random.Random(2), [f"w{k}" for k in range(60)] + ["the", "of"] * 20
    rows = [("hot" if k % 3 else f"g{k % 5}", k, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for k in range(260)]
    rows += [("hot", 1000 + k, rows[1][2] + " more") for k in range(20)] + [("hot", 2000 + k, "the same text") for k in range(40)]
    return rows + [("hot", 3000, None), ("hot", 3001, ""), ("g1", 3002, "!!"), (None, 3003, "a b c"), (None, 3004, "a b c d")]


@pytest.mark.parametrize("block", [1024, 32])
def test_cosine_pairs_and_duplicates(spark, made, monkeypatch, block):
    monkeypatch.setattr(similarity, "in_blocks", lambda rows, group, f=similarity.in_blocks: f(rows, group, block))
    df = spark.createDataFrame(made, "g string, id long, t string")
    first = {}
    for g, i, t in made:
        first.setdefault((g, t or ""), i)
    vectors = {(g, i): counts(t) for (g, t), i in first.items()}
    want = {(g, min(i, j), max(i, j)): round(cosine(a, b), 9) for (g, i), a in vectors.items() for (h, j), b in vectors.items() if g == h and i < j and cosine(a, b) >= 0.7 - 1e-12}
    got = {(r.g, r.a, r.b): round(r.cosine, 9) for r in similarity.tf_cosine_pairs(df, "g", "id", "t", 0.7).collect()}
    assert got == want and len(want) > 20
    dup = Counter()
    for g, i, t in made:
        if any(h == g and j != i and cosine(counts(t), counts(u)) >= 0.7 - 1e-12 for h, j, u in made):
            dup[g] += 1
    out = {r.g: (r.n, r.n_dup) for r in similarity.duplicate_rate(df, "g", "id", "t").collect()}
    assert out == {g: (sum(h == g for h, _, _ in made), dup[g]) for g in {g for g, _, _ in made}}


def test_near_sets(spark, made):
    df = spark.createDataFrame(made, "g string, id long, t string")
    sets = [(g, i, set(counts(t))) for g, i, t in made]
    want = {(g, i, j) for g, i, a in sets for h, j, b in sets if g == h and g is not None and i < j and a and b and 2 * len(a & b) / (len(a) + len(b)) >= 0.6 - 1e-12}
    got = [(r.g, r.a, r.b) for r in similarity.near_sets(df.where("g IS NOT NULL"), "g", "id", tokens(F.coalesce("t", F.lit(""))), 0.6).collect()]
    assert set(got) == want and len(got) == len(want)


def plain_windows(text, size):
    most, step = 4 * size, int(4 * size * 0.9)
    if len(text) <= most:
        return [text]
    out = []
    for at in range(0, len(text), step):
        w = text[at : at + most]
        if at + most < len(text):
            end = max(w.rfind("\n\n"), w.rfind(". "))
            if end > most // 2:
                w = w[: end + 1]
        out.append(w.strip(" \t\n\r"))
    return out


@pytest.mark.parametrize("size", [16, 17, 64])
def test_windows(spark, size):
    rng = random.Random(size)
    texts = ["", "short", "x" * (4 * size), "x" * (4 * size + 1), " " * 900, "é\U0001f600. " * 300, "".join(rng.choice(["word ", "end. ", "\n\n", "é", "日本"]) for _ in range(2000)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in chunking.windows(df, max_tokens=size).collect():
        got.setdefault(r.id, {})[r.chunk_index] = r.chunk
    for k, t in enumerate(texts):
        assert got.get(k, {}) == {n: w for n, w in enumerate(plain_windows(t, size)) if w} if t is not None else k not in got


def test_ablation(spark):
    rng = random.Random(4)
    prose = " ".join(f"Sentence {k} tells of {rng.choice(['cats', 'dogs', 'trees'])} and {rng.randint(0, 99)} other things." for k in range(120))
    texts = [prose, "One short text that stands alone and is a whole sentence.", "the same words again and again. " * 300, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.max_tokens): r for r in ablation.chunk_sizes(df, "id", "text", (64, 256, 6000)).collect()}
    for k, t in enumerate(texts):
        for size in (64, 256, 6000):
            chunks = [w for w in plain_windows(t, size) if w]
            if not chunks:
                assert (k, size) not in got
                continue
            vectors = [counts(c[:300]) for c in chunks]
            near = sum(any(i != j and cosine(a, b) >= 0.7 - 1e-12 for j, b in enumerate(vectors)) for i, a in enumerate(vectors)) if len(chunks) > 1 else 0
            r = got[(k, size)]
            assert (r.chunk_count, r.duplicate_rate) == (len(chunks), round(near / len(chunks), 3))
            good = r.avg_hope >= 0.7
            dup = near / len(chunks)
            want = "OPTIMAL" if len(chunks) == 1 and good else "GOOD" if good and dup < 0.15 else "HIGH_DUPLICATION" if dup >= 0.3 else "POOR_QUALITY" if r.avg_hope < 0.5 else "OK"
            assert r.recommendation == want
    rows = df.where("id = 0")
    one = chunking.windows(rows, max_tokens=256)
    scores = ranking.hope(one, ["chunk"], most=256).join(ranking.cohesion(one, ["chunk"]), "chunk")
    assert ranking.hope_means(scores).first().overall == got[(0, 256)].avg_hope


def test_numbers_without_a_global_window(spark):
    rows = [(k * 7 % 100, f"t{k}") for k in range(100)] + [(5, "again")]
    df = spark.createDataFrame(rows, "pos long, title string")
    out = numbering.numbered_on(df, numbering.range_pieces(df, "pos"), ["pos", "title"]).collect()
    assert [r["_n"] for r in sorted(out, key=lambda r: (r.pos, r.title))] == list(range(1, 102))
    assert numbering.numbered_on(df.where("false"), numbering.range_pieces(df.where("false"), "pos"), ["pos"]).count() == 0
    hashed = numbering.numbered_on(df, numbering.hash_pieces(df, ["title"]), ["title"]).collect()
    assert sorted(r["_n"] for r in hashed) == list(range(1, 102))
    index = spark.createDataFrame([(0, "a", "s"), (1, "b", "s")], "pos long, title string, summary string")
    change = spark.createDataFrame([(9, "z", "new"), (3, "b", "new"), (4, "y", "new")], "pos long, title string, summary string")
    plan = K.upsert_index(index, change)
    assert sorted(map(tuple, plan.collect())) == [(0, "a", "s"), (1, "b", "new"), (3, "y", "new"), (4, "z", "new")]
