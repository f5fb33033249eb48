"""The corpus operators against plain versions, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from lorespark.llm import byte_bpe, compression_bands, embedding_dedup, html_wrappers, license_scan, line_dedup, mixing, quality_classifier, queries, sharding, simhash_dedup

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, shard string, ratio string, license string, bpe_ string"
ODD = [
    (1, None, "en", "b", None, "x", "x", "x", "x", "x", "x"),
    (2, "", "en", None, 0, "x", "x", "x", "x", "x", "x"),
    (3, "One line that is long enough to be a key\nshort", "en", "a", 5, None, None, None, None, None, None),
    (3, "One line that is long enough to be a key\nshort", "en", "a", 5, None, None, None, None, None, None),
    (4, "  ONE line that is long enough to be a key\t\nother words here", None, "a", 5, "x", "x", "x", "x", "x", "x"),
    (5, "one line that is long enough to be a key", "en", "é", 5, "x", "x", "x", "x", "x", "x"),
    (None, "one line that is long enough to be a key", "en", "a", 5, "x", "x", "x", "x", "x", "x"),
    (6, "word " * 50_000 + "ende", "en", "c", 5, "x", "x", "x", "x", "x", "x"),
    (7, " \n\t\x0b\x0c\r ", "en", "c", 5, "x", "x", "x", "x", "x", "x"),
    (8, "ÄÖÜ 日本語 \U0001f600 a b İ ß", "en", "c", 5, "x", "x", "x", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def rows(df):
    return [r.asDict() for r in df.collect()]


def near_components(values, linked):
    """Smallest index reachable."""
    label = list(range(len(values)))

    def root(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for a, b in linked:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(values))]


# 1: quality classifier


def test_quality_held_out(spark):
    out = rows(queries.op1_quality_classifier(spark, SF))
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50
    good, bad = [p for p, q in held if q], [p for p, q in held if not q]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.4


def test_quality_uses_no_labels_of_held_out_rows(spark):
    docs = spark.createDataFrame([(k, f"some words number {k}") for k in range(200)], "doc_id long, text string")
    labels = [(k, 1 if k % 3 else 0, 0) for k in range(200)]
    flipped = [(k, q if zlib.crc32(str(k).encode()) % 5 else 1 - q, 0) for k, q, _ in labels]
    a, b = (quality_classifier.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_quality_prior():
    rng = np.random.default_rng(1)
    positive, unlabelled = rng.normal(2, 1, 3000), np.concatenate([rng.normal(2, 1, 1800), rng.normal(-2, 1, 1200)])
    assert abs(quality_classifier.estimate_prior(positive, unlabelled) - 0.6) < 0.08


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = rows(quality_classifier.classify(odd, labels))
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    by = defaultdict(set)
    for r in out:
        by[r["text"] or ""].add(r["score"])
    assert all(len(s) == 1 for s in by.values())
    assert quality_classifier.classify(empty, labels).count() == 0
    assert {r["score"] for r in rows(quality_classifier.classify(odd, labels.where("false")))} == {0.5}


# 2: embedding near-dedup


def plain_links(vectors, threshold=0.9):
    ok = [k for k, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for dim in {len(vectors[k]) for k in ok}:
        at = [k for k in ok if len(vectors[k]) == dim]
        m = np.array([vectors[k] for k in at], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(m @ m.T >= threshold, 1))
        pairs += [(at[x], at[y]) for x, y in zip(a, b)]
    return pairs


def test_embeddings_against_brute_force(spark):
    found = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    vectors = [v for _, v in found]
    rng = np.random.default_rng(3)
    for k in range(150):  # near copies at all distances down to just above the threshold, and exact ones
        v = np.array(vectors[k % 40])
        e = rng.standard_normal(64)
        e -= e @ v * v
        c = rng.uniform(0.905, 0.9999) if k % 5 else 1.0
        vectors.append((3 * (c * v + np.sqrt(1 - c * c) * e / np.linalg.norm(e))).astype(np.float32).tolist())
    pairs = plain_links(vectors)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    out = {r["vec_id"]: r for r in rows(embedding_dedup.near_duplicates(df))}
    links = Counter(k for p in pairs for k in p)
    assert len(out) == len(vectors) and all(out[k]["n_links"] <= links[k] for k in out)
    assert sum(r["n_links"] for r in out.values()) >= 0.95 * sum(links.values()) > 0
    want = near_components(vectors, pairs)
    assert np.mean([out[k]["component_id"] == want[k] for k in out]) > 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.values())


def test_embeddings_edges(spark):
    nan, inf = float("nan"), float("inf")
    made = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0], [1e-30, 0.0]]
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(made)] + [(None, [1.0, 0.0], "x")], "vec_id long, embedding array<float>, n_links string")
    out = rows(embedding_dedup.near_duplicates(df))
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert [by[k] for k in range(6)] == [(0, k, True) for k in range(6)]
    assert [by[k] for k in (6, 7, 8, 11)] == [(3, 6, True), (3, 6, False), (3, 6, False), (3, 6, False)]
    assert by[9] == (0, 9, True) and by[10] == (0, 10, True) and by[None][:2] == (0, None)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embeddings_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    made = [(centre + 0.15 * rng.standard_normal(64)).tolist() for _ in range(120)] + [rng.standard_normal(64).tolist() for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r for r in rows(embedding_dedup.near_duplicates(df))}
    links = Counter(k for p in plain_links(made) for k in p)
    assert sum(r["n_links"] for r in out.values()) >= 0.97 * sum(links.values()) and {out[k]["component_id"] for k in range(120)} == {0}


@pytest.mark.parametrize("most", [4096, 16])
def test_embeddings_windows_decide(spark, monkeypatch, most):
    """Windows, not lists, leave most pairs out, with one set of directions or several; copies beyond HOT meet salted."""
    monkeypatch.setattr(embedding_dedup, "MOST", most)
    monkeypatch.setattr(embedding_dedup, "HOT", 5)
    rng = np.random.default_rng(6)
    made = [v.astype(np.float32).tolist() for v in rng.standard_normal((400, 32))]
    for k in range(120):
        made.append((np.array(made[k]) + 0.25 * rng.standard_normal(32)).astype(np.float32).tolist())
    made += [made[0]] * 20
    n_dir, sets = embedding_dedup.shape(len(made), 64)
    assert (sets == 1) == (most == 4096)
    window = embedding_dedup.WIDE * np.sqrt(0.2)
    _, count = embedding_dedup.calibrate(32, n_dir, sets, 0.9, 0.975, window)
    unit = embedding_dedup._unit(np.array(made[:400]))
    assert len(embedding_dedup.collisions(embedding_dedup.projections(unit), window, count)[0]) < 0.05 * 400 * 399 / 2
    pairs = plain_links(made)
    df = spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<float>")
    out = {r["vec_id"]: r for r in rows(embedding_dedup.near_duplicates(df, per_list=64))}
    links = Counter(k for p in pairs for k in p)
    assert len(out) == len(made) and all(out[k]["n_links"] <= links[k] for k in out)
    assert sum(r["n_links"] for r in out.values()) >= 0.95 * sum(links.values()) > 0


# 3: line dedup


def plain_lines(docs):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    has = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for x in (t or "").split("\n"):
                has[key(x)].add(i)
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (i is not None and len(key(x)) >= 20 and len(has[key(x)]) >= 3 and i < max(has[key(x)]))]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_lines_against_plain(spark, texts):
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows(queries.op3_line_dedup(spark, SF)))
    assert got == plain_lines(texts.items()) and sum(k[2] for k in got) > 0


def test_lines_whatever_the_batches(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = plain_lines(texts.items())
    for n_batches, fan_in in ((2, 2), (7, 3)):
        out = line_dedup.dedup_lines(spark, docs, n_batches=n_batches, fan_in=fan_in)
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows(out)) == want


@pytest.mark.parametrize("n_batches", [1, 3])
def test_lines_edges(spark, odd, empty, n_batches):
    out = line_dedup.dedup_lines(spark, odd, n_batches=n_batches)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows(out))
    assert got == plain_lines([(r[0], r[1]) for r in ODD]) and set(odd.columns) < set(out.columns)
    assert line_dedup.dedup_lines(spark, empty, n_batches=n_batches).count() == 0


def test_runs_are_levelled_and_incremental(spark):
    from lorespark.llm.common import Workspace

    runs = line_dedup.LineRuns(Workspace(spark, "t"), fan_in=2)
    for k in range(3):
        runs.add(spark.createDataFrame([(bytes([k]), k), (b"z", k)], "key binary, doc_id long"))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert {(bytes(r.key), r.n_docs, r.last_doc) for r in runs.merged().collect()} == {(b"\0", 1, 0), (b"\1", 1, 1), (b"\2", 1, 2), (b"z", 3, 2)}
    new = spark.createDataFrame([(b"z", 9), (b"y", 9)], "key binary, doc_id long")
    assert [bytes(r.key) for r in runs.unseen(new).collect()] == [b"y"]


# 4: mixing


def test_mixing(spark, texts):
    out = rows(queries.op4_mixing(spark, SF))
    assert sorted(map(str, out)) == sorted(map(str, rows(queries.op4_mixing(spark, SF))))
    source = dict(duckdb.sql(f"select doc_id, source from '{SF}/documents.parquet'").fetchall())
    taken, size, target = Counter(), Counter(), {}
    for r in out:
        assert r["size"] == len(texts[r["doc_id"]].encode().split()) and 0 <= r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
        assert r["target"] <= 3 * r["source_size"] + 1e-6
    order = sorted(size)
    want = mixing.targets([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    assert np.allclose([target[s] for s in order], want) and np.isclose(sum(want), sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= max(0.03 * target[s], 256) for s in order)


def test_mixing_text_follows_taken(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(k * 7 % 500)), "abc"[k % 3], k) for k in range(120)], "doc_id long, text string, source string, n_chars int")
    taken = {r.doc_id: r.taken for r in mixing.taken(spark, docs).collect()}
    mixed = mixing.mix(spark, docs)
    assert mixed.columns == docs.columns
    words, passes = Counter(), Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        passes[r.doc_id] += 1
        assert all(w.startswith(f"w{r.doc_id}x") for w in r.text.split())
    assert {k: v for k, v in taken.items() if v} == dict(words) and max(passes.values()) <= 3


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    p = mixing.permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n))


def test_mixing_deal():
    slots = [5, 0, 1000, 17]
    d = mixing.deal(slots, 8, 1)
    assert d.sum(0).tolist() == slots and d.sum(1).max() - d.sum(1).min() <= 1


def test_mixing_deal_beyond_a_thousand_million():
    slots = [5 * 10**9, 3, 0, 10**9 + 7, 40]
    d = mixing.deal(slots, 64, 1)
    assert d.sum(0).tolist() == slots and d.sum(1).max() - d.sum(1).min() <= 1 and (d >= 0).all()
    share = d[:, 0] / d.sum(1)
    assert abs(share - slots[0] / sum(slots)).max() < 1e-3


def test_mixing_taken_against_a_plain_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    sized = mixing.measured(docs).drop("text")
    plan = mixing.Plan(sized.groupBy("source").agg(mixing.F.sum("_size").alias("n"), mixing.F.count("*").alias("n_rows")), 128, mixing.WEIGHTS, mixing.LIMIT)
    drawn = mixing.slots(spark, plan).collect()
    by_source, by_shard = defaultdict(list), Counter(r.shard for r in drawn)
    for r in drawn:
        by_source[r["rank"]].append((r.slot, r.block))
    uses: Counter = Counter()
    for k, found in by_source.items():
        found.sort()
        assert [j for j, _ in found] == list(range(plan.slots[k]))
        for at in range(0, len(found), plan.blocks[k]):  # no block again before all have been taken
            assert len({b for _, b in found[at : at + plan.blocks[k]]}) == len(found[at : at + plan.blocks[k]])
        uses.update((k, b) for _, b in found)
    assert len(by_shard) == 256 and max(by_shard.values()) - min(by_shard.values()) <= 1
    rank, want = {s: k for k, s in enumerate(plan.sources)}, Counter()
    for r in mixing.number(sized).collect():
        for w in range(r["_start"], r["_start"] + r["_size"]):
            want[r.doc_id] += uses[(rank[r.source], w // 128)]
    got = {r.doc_id: r.taken for r in mixing.taken(spark, docs).collect()}
    assert got == {k: want[k] for k in got}


def test_mix_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"some words {k} " * (k % 9), "ab"[k % 2], *("x" * 9)) for k in range(40)], "doc_id long, text string, source string, target string, source_size string, _size string, _rank string, _start string, _pass string, _h string, uses string, block string")
    out = mixing.mix(spark, docs)
    assert out.columns == docs.columns and {r.target for r in out.collect()} == {"x"}


def test_mixing_edges(spark, odd, empty):
    out = rows(mixing.taken(spark, odd))
    assert len(out) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in out)
    assert {r["doc_id"]: r["size"] for r in out}[7] == 0 and {r["doc_id"]: r["size"] for r in out}[1] == 0
    assert mixing.taken(spark, empty).count() == 0 and mixing.mix(spark, empty).count() == 0
    assert mixing.targets([0, 10, 0], [5, 2, 1]) == [0, 10, 0] and mixing.targets([100, 1], [1, 1]) == [98, 3]


# 5: sharding


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, texts):
    out = rows(queries.op5_sharding(spark, SF))
    for r in out:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (plain_jump(r["doc_id"], 8), plain_jump(r["doc_id"], 9)) and r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own))) and len(own) > 80


def test_sharding_of_any_key(spark):
    """Keys that are no integers are hashed; one more shard takes rows only into itself; clashing names stay."""
    made = [(f"k{k}", "t", "b", "p", "n") for k in range(3000)] + [(None, "t", "b", "p", "n")]
    df = spark.createDataFrame(made, "name string, text string, _before string, _piece string, _n string")
    out = rows(sharding.shards(df, key="name"))
    assert len(out) == 3001 and all((r["_before"], r["_piece"], r["_n"]) == ("b", "p", "n") for r in out)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.3 * 3001 / 8
    assert all(r["grown_shard"] in (r["shard"], 8) for r in out) and 200 < sum(r["grown_shard"] == 8 for r in out) < 500


def test_sharding_edges(spark, odd, empty):
    out = rows(sharding.shards(odd))
    assert len(out) == len(ODD) and {r["text_crc32"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert len({(r["shard"], r["slot"]) for r in out}) == len(out) and {r["shard"] for r in out if r["doc_id"] is None} == {plain_jump(0, 8)}
    assert sharding.shards(empty).count() == 0
    big = spark.createDataFrame([(k * 2**40 - 2**62,) for k in range(64)], "doc_id long").selectExpr("doc_id", "'' AS text")
    assert all(r.shard == plain_jump(r.doc_id % 2**64, 1000) for r in sharding.shards(big, 1000).collect())


# 6: compression bands


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen, again = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            again |= set(range(k, k + 8))
    base = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), base


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_compression(spark, texts):
    out = rows(queries.op6_compression_bands(spark, SF))
    assert len(out) == 1000 and all(tuple(r[n] for n in NAMES) == plain_rules(texts[r["doc_id"]]) for r in out)
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    good = [r["kept"] for r in out if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert np.mean(good) > 0.99 and all(not r["kept"] for r in out if r["base_failed"])


def test_compression_edges(spark, odd, empty):
    out = rows(compression_bands.screen(odd))
    assert Counter(tuple(r[n] for n in NAMES) for r in out) == Counter(plain_rules(r[1]) for r in ODD)
    rng = np.random.default_rng(1)
    noise = base64.b64encode(rng.bytes(9000)).decode()
    noise = " ".join(noise[k : k + 9] for k in range(0, len(noise), 9))
    chant = " ".join(f"la{k % 2} lu" for k in range(3000))
    got = {r.doc_id: r for r in compression_bands.screen(spark.createDataFrame([(1, noise), (2, chant)], "doc_id long, text string")).collect()}
    assert not got[1].base_failed and not got[1].kept and not got[2].kept
    assert compression_bands.screen(empty).count() == 0


# 7: HTML extraction


def test_html(spark):
    import html as h

    out = rows(queries.op7_html_extraction(spark, SF))
    pages = dict(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"(?s)<article>(.*?)(</article>|\Z)", pages[r["page_id"]])[1]
        parts = [" ".join(h.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


PAGE = (
    '<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies</div>'
    '<div id="content"><h2>{title}</h2>{body}</div><div class="sidebar"><p>Side {k}</p></div><section class="comments"><p>Reader {k}</p></section><form><p>Mail?</p></form><footer>{k}</footer></body></html>'
)


def test_wrapper_finds_region_without_article():
    pages = []
    for k in range(6):
        body = "".join(f"<p>Para {k}.{j} with &amp; and <em>more</em>&nbsp;text" for j in range(k + 1)) + ("<ul><li>one<li>two</ul>" if k % 2 else "")
        pages.append(PAGE.format(menu="<li><a href='/'>m</a>" * (k + 2), title=f"Title {k}", body=body, k=k))
    import json

    wrapper = html_wrappers.infer(pages)
    assert "(?:" in wrapper["regex"] and ")?" in wrapper["regex"]
    for k, page in enumerate(pages):
        want = [f"Title {k}", *(f"Para {k}.{j} with & and more text" for j in range(k + 1)), *(["one", "two"] if k % 2 else [])]
        assert html_wrappers.extract_text(page, json.dumps(wrapper)) == "\n".join(want) == html_wrappers.extract_text(page, None)


def test_html_of_a_host_with_one_page(spark):
    """Adverts and comments go where nothing but their names tells them apart; other columns stay as they are."""
    page = '<html><body><nav>Home</nav><article><h1>Title</h1><p>Text of the page.</p><div class="ad">Buy now</div><p>More text.</p><div class="comments"><p>First!</p></div></article></body></html>'
    df = spark.createDataFrame([(1, "https://one/a", page, "x", "y", "z")], "page_id long, url string, html string, _key string, _wrapper string, text string")
    out = rows(html_wrappers.extract(df))
    assert [(r["text"], r["_key"], r["_wrapper"]) for r in out] == [("Title\nText of the page.\nMore text.", "x", "y")]


def test_html_edges(spark):
    made = [(1, None, None), (2, "", ""), (3, "http://a/b", None), (4, "http://a/c", "plain text"), (5, "x", "<p>a<b"), (6, "http://a/d", "<p>1 < 2 &lt;3 &#65;&bogus;<script>x"), (6, "http://a/d", "<p>1 < 2 &lt;3 &#65;&bogus;<script>x"), (7, "HTTP://A/e", "<p>" * 30000 + "deep")]
    df = spark.createDataFrame([(*r, "x") for r in made], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_wrappers.extract(df).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "plain text", 5: "a", 6: "1 < 2 <3 A&bogus;", 7: "deep"}
    assert html_wrappers.extract(df).count() == len(made) and html_wrappers.extract(df.where("false")).count() == 0


def test_every_template_of_a_host_has_a_wrapper(spark):
    made, want = [], {}
    for t in range(20):
        for k in range(3):
            words = f"{'abc'[k]}{t:02d}"  # of one length
            extra = "<table><tr><td>rare</td></tr></table>" if k == 2 else ""
            html = f'<html><body><div class="top{t}"><p>The same for all {t}</p></div><div class="x{t}"><h2>{words}</h2><p>{words} text</p>{extra}</div><div class="end{t}"><p>All rights kept</p></div></body></html>'
            made.append((3 * t + k, "http://hot/", html))
            want[3 * t + k] = "\n".join([words, f"{words} text", *(["rare"] if extra else [])])
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got == want


def test_wrappers_decide_without_article_or_known_names(spark):
    """The pages of the table with <article> made a plain element, so that nothing but the wrapper tells the region."""
    import html as h

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    bare = pages.withColumn("html", html_wrappers.F.expr("""replace(replace(replace(html, '<article>', '<div class="x1">'), '</article>', '</div>'), 'class="ad"', 'class="x2"')"""))
    source = {r.page_id: r.html for r in pages.collect()}
    stripped = {r.page_id: r.html for r in bare.collect()}
    right = plain = 0
    got = rows(html_wrappers.extract(bare))
    for r in got:
        article = re.search(r"(?s)<article>(.*?)(</article>|\Z)", source[r["page_id"]])[1]
        parts = [" ".join(h.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article)]
        want = "\n".join(p for p in parts if p)
        right += r["text"] == want
        plain += html_wrappers.extract_text(stripped[r["page_id"]], None) == want
    assert right >= 0.95 * len(got) > plain


def test_content_with_a_boilerplate_word_stays(spark):
    kinds = ['div class="related-work"', 'div class="notice-period"', 'ul class="social history"', 'section id="search"']
    made, want = [], {}
    for k in range(8):
        extra = f"<{kinds[k]}><p>Part {k}</p></{kinds[k].split()[0]}>" if k < 4 else ""
        made.append((k, "http://h/", f'<html><body><nav>Menu</nav><article><h1>Title {k}</h1><p>Text {k} and so on</p>{extra}<div class="share"><p>Share {k}</p></div></article><footer>End</footer></body></html>'))
        want[k] = "\n".join([f"Title {k}", f"Text {k} and so on", *([f"Part {k}"] if extra else [])])
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in range(4, 8)} == {k: want[k] for k in range(4, 8)}
    assert all(f"Part {k}" in got[k] for k in range(4))


def test_streams_meet_across_tasks(spark, monkeypatch):
    page = '<html><body><div class="a"><p>Kept by all</p></div><div class="b"><p>Text {}</p></div></body></html>'
    df = spark.createDataFrame([(k, "http://a/", page.format(k)) for k in range(40)], "page_id long, url string, html string").repartition(20)
    monkeypatch.setattr(html_wrappers, "BROADCAST_BYTES", -1)
    assert html_wrappers.wrappers(df).count() == 1
    assert {(r.page_id, r.text) for r in html_wrappers.extract(df).collect()} == {(k, f"Text {k}") for k in range(40)}


# 8: SimHash


def plain_fingerprint(text):
    words = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    out = {r["doc_id"]: r for r in rows(queries.op8_simhash_dedup(spark, SF))}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[k]) for k in ids]
    assert all(out[k]["fingerprint"] == f"{f:016x}" for k, f in zip(ids, fps))
    m = np.array(fps, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(m[:, None] ^ m[None, :]) <= 3, 1))
    want = near_components(fps, zip(a.tolist(), b.tolist()))
    assert [out[k]["component_id"] for k in ids] == [ids[w] for w in want] and len(set(want)) < len(ids)


def test_multi_index_finds_all(spark, monkeypatch):
    from lorespark.llm.common import Workspace, components

    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    fps = list(base)
    for _ in range(400):  # chains and a dense group
        f = int(fps[rng.integers(len(fps))] if rng.random() < 0.5 else base[0])
        for k in rng.choice(64, rng.integers(1, 5), replace=False):
            f ^= 1 << int(k)
        fps.append(np.uint64(f))
    fps = sorted({int(np.uint64(f).view(np.int64)) for f in fps})
    m = np.array(fps, np.int64).view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(m[:, None] ^ m[None, :]) <= 3, 1))
    want = near_components(fps, zip(a.tolist(), b.tolist()))
    work = Workspace(spark, "t")
    got = dict(components(work, simhash_dedup.links(work, spark.createDataFrame([(f,) for f in fps], "fp long"))).collect())
    assert [got.get(f, f) for f in fps] == [fps[w] for w in want]


def test_simhash_edges(spark, odd, empty):
    out = rows(simhash_dedup.near_duplicates(spark, odd))
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["fp"] == by[2]["fp"] == by[7]["fp"] == 0 and by[7]["component_id"] == 1
    assert by[None]["component_id"] == by[5]["component_id"] == 5
    kept = rows(simhash_dedup.drop_duplicates(spark, odd))
    assert Counter(r["doc_id"] for r in kept) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1}
    only = rows(simhash_dedup.drop_duplicates(spark, odd.where("doc_id IS NULL")))
    assert [r["doc_id"] for r in only] == [None]
    assert simhash_dedup.near_duplicates(spark, empty).count() == 0 and simhash_dedup.drop_duplicates(spark, empty).count() == 0
    wide = rows(simhash_dedup.drop_duplicates(spark, odd, similarity=0.8))
    shared = lambda a, b: len(a & b) / len(a | b)
    grams = {r[0]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in ODD if r[0] in (3, 4, 5) for w in [r[1].lower().split()]}
    assert shared(grams[3], grams[5]) == 6 / 7 and shared(grams[3], grams[4]) == 6 / 10 and shared(grams[4], grams[5]) == 6 / 9
    assert Counter(r["doc_id"] for r in wide) == {1: 1, 3: 1, 4: 1, 6: 1, 8: 1} and set(wide[0]) == set(odd.columns)  # 5 is like 3
    assert [r["doc_id"] for r in rows(simhash_dedup.drop_duplicates(spark, odd.where("doc_id IS NULL"), similarity=0.8))] == [None]
    assert simhash_dedup.drop_duplicates(spark, empty, similarity=0.8).count() == 0


def test_similar_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    words, made = [f"w{k}" for k in range(2000)], []
    for k in range(120):  # near copies of one text, then texts of their own
        own = words[:400] if k < 90 else [words[x] for x in rng.integers(400, 2000, 400)]
        made.append((k, " ".join("x" if rng.random() < 0.002 else w for w in own)))
    out = {r.doc_id: r.component_id for r in simhash_dedup.similar(spark, spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert all(out[k] == 0 for k in range(90)) and all(out[k] == k for k in range(90, 120))


# 9: byte-level BPE


@pytest.fixture(scope="module")
def codec():
    path, pattern = queries.vocabulary()
    with open(path, "rb") as f:
        return byte_bpe._codec(f.read(), pattern)


def plain_bpe(codec, text):
    ids = codec.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe(spark, texts, codec):
    out = rows(queries.op9_byte_bpe(spark, SF))
    assert len(out) == 1000 and all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == plain_bpe(codec, texts[r["doc_id"]]) for r in out)


def test_bpe_chunks(spark, texts, codec):
    long = sorted(texts.values(), key=len)[-4:]
    made = [*long, "a" * 3000 + " b", " " * 700 + "x" + " " * 900, "x'll   y\n\n\n  z " * 120, "日本語 " * 300, "é" * 999 + "  !!! 12345 " * 30, None, ""]
    df = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in enumerate(made * 2)], "doc_id long, text string, n_tokens string, _row string, _k string")
    for chunk, overlap, far in ((257, 64, 1 << 20), (16, 8, 900)):  # all in their rows' tasks; the longer ones dealt out
        out = rows(byte_bpe.encode(df, *queries.vocabulary(), chunk=chunk, overlap=overlap, far=far))
        assert len(out) == 2 * len(made) and all((r["_row"], r["_k"]) == ("y", "z") for r in out)
        for r in out:
            b = r["bpe"]
            assert (b["n_tokens"], b["ids_sha256"], b["decoded_sha256"]) == plain_bpe(codec, r["text"]) and list(b["ids"]) == codec.encode_ordinary(r["text"] or "")


def test_stitching_is_linear():
    """Twelve million characters are stitched and cut within seconds, and the boundaries are those of the whole text."""
    import time

    pattern = queries.vocabulary()[1]
    text = "word and 123, some other   words!\n\n " * 324_000
    chunk, overlap = byte_bpe.CHUNK * byte_bpe.DEALT, byte_bpe.OVERLAP
    starts = list(range(0, len(text), chunk))
    limits = [min(len(text), a + chunk + overlap) for a in starts]
    ends = [np.array(byte_bpe.boundaries(text[a:b], pattern, b == len(text))) + a for a, b in zip(starts, limits)]
    began = time.process_time()
    bounds = byte_bpe.stitch(starts, ends, text, pattern, limits)
    assert time.process_time() - began < 2
    assert bounds[-1] == len(text) and (np.diff(bounds) > 0).all()
    some = len("word and 123, some other   words!\n\n ") * 3000
    want = [0, *byte_bpe.boundaries(text[:some], pattern, False)]
    assert bounds[: len(want)].tolist() == want


def test_bpe_edges(spark, odd, empty, codec):
    out = byte_bpe.encode(odd, *queries.vocabulary())
    for r in rows(out):
        assert r["bpe"]["ids_sha256"] == plain_bpe(codec, r["text"])[1]
    back = byte_bpe.decode(spark, out.select("text", "bpe.ids"), queries.vocabulary()[0], queries.vocabulary()[1])
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in back.collect())
    assert byte_bpe.encode(empty, *queries.vocabulary()).count() == 0


# 10: license scans


def plain_scan(text, threshold=0.8):
    def grams(x):
        w = license_scan.words_of(x)
        return set(zip(w, w[1:]))

    lines = (text or "").split("\n")
    units = [(0, text), *enumerate(lines, 1)] if len(lines) > 1 else [(1, lines[0])]
    best, n = None, 0
    for line, unit in units:
        g, top = grams(unit), None
        for rank, (name, words) in enumerate(license_scan.TEMPLATES):
            t = grams(words)
            dice = 2 * len(g & t) / (len(g) + len(t)) if g else 0
            if dice >= threshold and (top is None or (-dice, rank) < top[:2]):
                top = (-dice, rank, line, name)
        if top:
            n += 1
            best = top if best is None or top < best else best
    words, part, n_part = license_scan.words_of(text or ""), None, 0
    pairs = list(zip(words, words[1:]))
    known = set(pairs)
    for rank, (name, notice) in enumerate(license_scan.TEMPLATES):
        t, top = grams(notice), None
        if 3 * len(known & t) < 2 * len(t):  # cannot reach 0.8
            continue
        for k in range(len(pairs)):
            if pairs[k] not in t:
                continue
            g = set(pairs[k : k + len(license_scan.words_of(notice)) - 1])
            dice = 2 * len(g & t) / (len(g) + len(t))
            if dice >= threshold and (top is None or (-dice, rank, k) < top[:3]):
                top = (-dice, rank, k, name)
        if top:
            n_part += 1
            part = top if part is None or top < part else part
    if best and (part is None or best[0] <= part[0] or best[3] == part[3]):
        return best[3], -best[0], best[2], None, n
    return (part[3], -part[0], None, part[2], n or n_part) if part else (None, None, None, None, 0)


def test_licenses(spark, texts):
    out = rows(queries.op10_license_scan(spark, SF))
    assert len(out) == 1000 and all((r["license"], r["dice"], r["line"], r["word"], r["n_matches"]) == plain_scan(texts[r["doc_id"]]) for r in out)
    marked = {k for k, t in texts.items() if re.search(r"(?m)^(Licensed under the Apache License, Version 2\.0\.|Released under the MIT License\.)$", t)}
    assert marked and all(r["license"] for r in out if r["doc_id"] in marked)


def test_licenses_edges(spark, odd, empty):
    assert Counter(map(str, ((r["license"], r["dice"], r["line"], r["word"], r["n_matches"]) for r in rows(license_scan.scan(odd))))) == Counter(str(plain_scan(r[1])) for r in ODD)
    mit = license_scan.TEMPLATES[4][1]
    made = [(1, mit.replace(". ", ".\n")), (2, "x " + mit.upper()), (3, "Released  under the MIT-License!"), (4, "MIT")]
    got = [(r.license, r.line) for r in license_scan.scan(spark.createDataFrame(made, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [("MIT", 0), ("MIT", 1), ("MIT", 1), (None, None)]
    assert license_scan.scan(empty).count() == 0


def test_licenses_within_texts(spark):
    import textwrap

    rng, made, want = np.random.default_rng(6), [], []
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        code = [" ".join(f"v{x}" for x in rng.integers(0, 999, 9)) for _ in range(30)]
        wrapped = ["# " + x for x in textwrap.wrap(text, 60)]
        made.append((k, "\n".join([*code[:9], *wrapped, *code[9:]]) if len(text) > 70 else f"{code[0]}. {text} {code[1]}\n{code[2]}"))
        want.append(name)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: (r.license, r.dice, r.line, r.word, r.n_matches) for r in license_scan.scan(docs).collect()}
    assert [got[k][0] for k in range(len(made))] == want
    assert all(got[k] == plain_scan(t) for k, t in made)


def test_licence_files_by_how_they_open(spark):
    """The beginning of a licence file, laid out as its publisher does, with a body of other words after it."""
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"
    mpl = "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n"
    body = "\n".join(" ".join(f"word{k}x{j}" for j in range(9)) for k in range(200))
    made = [(k, t + "\n" + body) for k, t in enumerate((gpl, apache, mpl, gpl.replace("GENERAL", "LESSER GENERAL", 1)))] + [(9, body)]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert (got[0], got[1], got[2], got[9]) == ("GPL-3.0", "Apache-2.0", "MPL-2.0", None) and got[3] in ("GPL-3.0", "LGPL-3.0")


# pieces grow with the rows


def test_more_pieces_keep_the_laws(spark, monkeypatch):
    for module in (sharding, mixing):
        monkeypatch.setattr(module, "PIECES", 2)
        monkeypatch.setattr(module, "PIECE_ROWS", 7)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    slots: dict[int, list[int]] = {}
    for r in sharding.shards(docs.select("doc_id", "text")).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    starts: dict[str, list] = {}
    for r in mixing.number(docs, 40).collect():
        starts.setdefault(r.source, []).append((r["_start"], r["_size"]))
    for spans in starts.values():
        ends = sorted((a, a + n) for a, n in spans)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False) if b[0] != b[1])
    assert sum(r.taken for r in mixing.taken(spark, docs).collect()) > 0


def test_probes_are_never_broadcast(spark, monkeypatch):
    draw = np.random.default_rng(3)
    own = draw.integers(-(2**63), 2**63 - 1, 3000)
    made = spark.createDataFrame([(int(x),) for x in [*own, *(own[:50] ^ 5)]], "fp long")
    work = simhash_dedup.Workspace(spark, "probes")
    fps, plans = work.table(made.coalesce(1)), []

    def table(df, sort=None):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(work, "table", table)
    # as with larger tables: what the probes are taken for lies below this, what their owners are above it
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        edges = simhash_dedup.links(work, fps).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {frozenset(e) for e in edges} == {frozenset((int(x), int(x) ^ 5)) for x in own[:50]}
    assert len(plans) == 1 and "BroadcastHashJoin" not in plans[0].split("Initial Plan")[0]
