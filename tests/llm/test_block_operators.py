"""Decontamination, Merkle manifest and hard negatives against plain versions, DuckDB and odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import decontamination, hard_negatives, merkle_manifest, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, leak string, leaf string, tree string, i string"
ODD = [
    (1, None, "en", "b", None),
    (2, "", "en", None, 0),
    (3, "One two THREE four five six seven eight nine ten eleven", "en", "a", 5),
    (3, "One two THREE four five six seven eight nine ten eleven", "en", "a", 5),
    (4, "xx One, two. three\nfour five-six seven eight nine TEN yy zero one two", None, "a", 5),
    (5, "  ÄÖ short item  ", "en", "é", 5),
    (None, "before SHORT item after", "en", "a", 5),
    (6, "word " * 30_000 + "one two three four five six seven eight nine ten", "de", "c", 5),
    (7, " \n\t\x0b\x0c\r ", "", "c", 5),
    (8, "ÄÖÜ 日本語 \U0001f600 a b İ ß", "fr", "c", 5),
]
ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (1, "short item"), (10, "one two three four five six seven eight nine ten"), (2, "Zero"), (3, None), (4, ""), (None, "日本語"), (5, "ß"), (6, "word word word word word word word word word word word")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def rows(df):
    return [r.asDict() for r in df.collect()]


def same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = getattr(queries, name)(spark, SF)
    cols = sorted(got.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = Counter(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())
    assert want and Counter(tuple(r[c] for c in cols) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_merkle_manifest", "op13_hard_negatives"])
def test_same_as_sql(spark, name):
    same(spark, name)


# 11: decontamination


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items, window):
    words, hit, found, longest = plain_words(text), set(), set(), 0
    for item, own in items:
        w = plain_words(own)
        k = min(window, len(w))
        grams = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if w else set()
        for p in range(len(words) - k + 1) if grams else ():
            if tuple(words[p : p + k]) in grams:
                hit.update(range(p, p + k))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("window", [1, 3, 10])
def test_leaks_of_odd_rows(spark, odd, items, window):
    got = rows(decontamination.digest(decontamination.matches(spark, odd, items, window)))
    known = [(i, t) for i, t in ITEMS if i is not None]
    want = Counter()
    for r in ODD:
        n, hit, found = plain_hits(r[1], known, window)
        want[(r[0], n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want


def test_leaks_over_several_passes_and_pieces(spark, odd, items, monkeypatch):
    """Blocks of a few words, a pass each, and pieces of 12 words find the same."""
    one = decontamination.digest(decontamination.matches(spark, odd, items, 4))
    want = Counter(tuple(r) for r in one.collect())
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 900)
    monkeypatch.setattr(decontamination, "PASS_BLOCKS", 1)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 6)
    assert Counter(tuple(r) for r in decontamination.digest(decontamination.matches(spark, odd, items, 4)).collect()) == want


def test_leaks_at_random():
    """The automaton against windows tried one by one, on few words, so that everything repeats."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        window = int(rng.integers(2, 6))
        items = [(k, " ".join(rng.choice(list("abc"), rng.integers(1, 12)))) for k in range(5)]
        made = decontamination.Automaton([(str(k), [w.encode() for w in t.split()]) for k, t in items], window)
        text = " ".join(rng.choice(list("abcd"), 40))
        longest, spans, found = made.read([w.encode() for w in text.split()])
        n, hit, want = plain_hits(text, items, window)
        assert sum(b - a for a, b in spans) == hit and sorted(found) == want
        words = text.split()
        runs = {tuple(t.split()[a:b]) for _, t in items for a in range(12) for b in range(a + 1, 13)}
        assert longest == max([b - a for a in range(40) for b in range(a + 1, 41) if tuple(words[a:b]) in runs], default=0)


def test_spans_are_cut(spark, odd, items):
    out = rows(decontamination.decontaminate(spark, odd, items, max_words=2))
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[3]["text"] == "" and by[3]["n_hit"] == 11 and not by[3]["kept"]
    assert by[4]["text"] == "xx  yy zero one two" and by[4]["longest"] == 10
    assert by[1]["text"] is None and by[1]["kept"] and by[5]["text"] == ODD[5][1]  # two words are left where they are
    assert {"leak", "leaf", "tree"} <= set(by[3]) and by[3]["leaf"] == "x" and len(out) == len(ODD)


def test_no_items_and_no_documents(spark, odd, items):
    none = rows(decontamination.digest(decontamination.matches(spark, odd, items.where("false"))))
    assert len(none) == len(ODD) and not any(r["contaminated"] for r in none)
    assert decontamination.matches(spark, odd.where("false"), items).count() == 0


# 12: Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    """The root of a list of nodes, and of each node its siblings (left, right), level by level."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            sides[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes, at = [sha(*nodes[p : p + 8]) for p in range(0, len(nodes), 8)], [p // 8 for p in at]
    return (nodes[0] if nodes else None), sides


def plain_manifest(docs):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in docs:
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        trees[lang].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, plain_leaf(doc_id, source, lang, n_chars, low) if tampered else leaf))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = {x: plain_tree([leaf for _, _, leaf, _ in sorted(trees[x])]) for x in langs}
    root, above = plain_tree([done[x][0] for x in langs])
    out = Counter()
    for k, lang in enumerate(langs):
        for (_, doc_id, leaf, node), own in zip(sorted(trees[lang]), done[lang][1], strict=True):
            sides = own + above[k]
            for left, right in sides:
                node = sha(left, node, right)
            out[(doc_id, leaf, done[lang][0], root, sha(*[x for s in sides for x in s]), node, node == root)] += 1
    return out


def audited(spark, df, **more):
    out = merkle_manifest.audit(spark, df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, **more)
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows(out))


def test_manifest_of_odd_rows(spark, odd):
    assert audited(spark, odd) == plain_manifest(ODD)
    assert audited(spark, odd.where("doc_id = 5")) == plain_manifest(ODD[5:6])
    assert audited(spark, odd.where("false")) == Counter()


def test_manifest_over_several_rounds(spark):
    """Buckets of 8 leaves, so that trees take several rounds; many languages; a language of more than half of the rows."""
    docs = [(k, f"Text {k}", f"l{k % 40}" if k % 2 else "en", "s", k) for k in range(1200)] + [(None, "x", None, None, None)] * 20 + [(7, "Text", "en", "s", 1)] * 70
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert audited(spark, df, depth=1) == plain_manifest(docs)
    assert audited(spark, df, depth=2) == plain_manifest(docs)


# 13: hard negatives


def plain_negatives(vectors, low=80, high=100):
    """vectors: (vec_id, embedding, label), every row good."""
    v = [(i, label, [int(np.floor(256 * float(x))) for x in e]) for i, e, label in vectors]
    out = set()
    for a, label, q in v:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, w)), i, own) for i, own, w in v if i != a]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted(s for s in scored if s[2] != label and low * -ps <= -100 * s[0] <= high * -ps)
            out |= {(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits[:5], 1)}
    return out


def mined(spark, vectors, **more):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("x")).withColumn("anchor", F.lit("x"))
    out = hard_negatives.mine(spark, df, F.col("vec_id") % 100 == 0, **more)
    got = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows(out)]
    assert len(got) == len(set(got))
    return set(got)


def test_negatives_like_plain(spark):
    rng = np.random.default_rng(5)
    for kind in ("apart", "near", "ties"):
        e = rng.standard_normal((700, 12)).astype(np.float32) + (2 if kind == "near" else 0)
        e = np.round(e) if kind == "ties" else e
        vectors = [(k, [float(x) for x in e[k]], int(rng.integers(0, 3))) for k in range(700)]
        want = plain_negatives(vectors)
        assert want and mined(spark, vectors) == want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.4], 2), (3, [1.0, 0.4], 2), (100, [0.0, 0.0], 1), (200, [-1.0, 0.0], 3)]
    bad = [(4, None, 1), (5, [1.0, None], 2), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, [1.0, 0.5], None), (None, [1.0, 0.5], 2), (9, [], 2), (300, None, 1)]
    assert mined(spark, good + bad) == plain_negatives(good)
    assert mined(spark, good + good + bad) == plain_negatives(good)  # equal rows count once
    assert mined(spark, bad) == set() and mined(spark, []) == set()
    assert mined(spark, [*good, (10, [1.0], 2), (11, [1.0, 0.5, 0.0], 2)]) == plain_negatives([(i, [*e, 0.0][:3], x) for i, e, x in [*good, (10, [1.0, 0.0], 2), (11, [1.0, 0.5, 0.0], 2)]])
    assert mined(spark, [(0, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [3e38, 0.9], 2)])  # saturated, not lost


def test_bounds_hold():
    rng = np.random.default_rng(9)
    v, q = rng.integers(-300, 300, (500, 7)), rng.integers(-300, 300, (40, 7))
    edges = np.ceil(np.quantile(v[:100], np.arange(1, hard_negatives.CELLS) / hard_negatives.CELLS, axis=0)).T.astype(np.int64)
    made = hard_negatives.Approximations(hard_negatives.approximate(v, edges), v.min(0), v.max(0), edges)
    lower, upper = made.bounds(made.tables(q), 0, 500)
    score = v @ q.T
    assert (lower <= score).all() and (score <= upper).all() and np.median(upper - lower) < np.ptp(score) / 5
