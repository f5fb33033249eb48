"""The pipeline stage by stage against plain versions of what each stage decides."""

import hashlib
import importlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lorespark.llm import common

corpus_pipeline = importlib.import_module("corpus_pipeline")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    work, docs, out = common.Workspace(spark, "test-pipeline"), common.read(spark, SF, "documents"), []
    out.append(docs)
    for _, f in corpus_pipeline.STAGES:
        docs = work.table(f(spark, docs, SF))
        out.append(docs)
    return [d.toPandas() for d in out]


def test_columns(stages):
    assert all(list(d.columns) == ["doc_id", "text", "lang", "source", "n_chars"] for d in stages[:5])


def test_quality_keeps_labelled_good(spark, stages):
    labels = common.read(spark, SF, "labels").toPandas()
    kept = set(stages[1].doc_id)
    good, bad = set(labels[labels.quality == 1].doc_id), set(labels[labels.quality == 0].doc_id)
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.4 * len(bad)


def test_lines(stages):
    from test_operators import plain_lines

    want = plain_lines(list(zip(stages[1].doc_id, stages[1].text)))
    empty = hashlib.sha256(b"").hexdigest()
    kept = Counter((k[0], k[3]) for k in want.elements() if k[3] != empty or k[2] == 0)
    assert Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(stages[2].doc_id, stages[2].text)) == kept


def plain_votes(text):
    """Votes on the 1024 bits of a text's fingerprint, by the letter."""
    words = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    votes = np.zeros(1024, int)
    for g in grams:
        h, bits = xxhash.xxh64_intdigest(g, 42), b""
        for k in range(16):
            x = (h + (k + 1) * 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            bits += (x ^ x >> 31).to_bytes(8, "little")
        votes += 2 * np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(int) - 1
    return votes


def plain_probes(votes):
    """Per segment the values looked up: its own, then those with the least sure bits turned, the cheapest first."""
    out = []
    for s in range(24):
        own = votes[28 * s : 28 * s + 28]
        value = sum(1 << k for k in range(28) if own[k] > 0)
        unsure = sorted(range(28), key=lambda k: (abs(own[k]), k))[:4]
        subsets = [[b for j, b in enumerate(unsure) if m >> j & 1] for m in range(16)]
        out.append([value ^ sum(1 << k for k in sub) for sub in sorted(subsets, key=lambda sub: sum(abs(own[k]) for k in sub))[:12]])
    return out


def test_copies(stages):
    from test_operators import near_components

    texts = sorted(zip(stages[2].doc_id, stages[2].text))
    ids, votes = [i for i, _ in texts], np.array([plain_votes(t) for _, t in texts])
    bits = (votes > 0).astype(np.int32)
    size = bits.sum(1)
    apart = size[:, None] + size[None, :] - 2 * (bits @ bits.T)
    probes = [plain_probes(v) for v in votes]
    a, b = np.nonzero(np.triu(apart <= 177, 1))
    met = [any(probes[x][s][0] in probes[y][s] or probes[y][s][0] in probes[x][s] for s in range(24)) for x, y in zip(a, b)]
    a, b = a[met], b[met]
    words = [t.lower().split() for _, t in texts]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    n = np.array([len(g) for g in grams])
    close = np.minimum(n[a], n[b]) >= 0.8 * np.maximum(n[a], n[b])
    a, b = a[close], b[close]
    label = near_components(ids, zip(a.tolist(), b.tolist()))
    roots = {ids[k] for k in label}
    assert set(stages[3].doc_id) == roots and stages[3].doc_id.is_unique and 0 < len(roots) < len(ids)
    pairs = [(x, y) for x, y in zip(*np.nonzero(np.triu(apart <= 260, 1))) if len(grams[x] & grams[y]) >= 0.8 * len(grams[x] | grams[y])]
    found = [label[x] == label[y] for x, y in pairs]
    print("near-dedup: pairs of 0.8 or more found", sum(found), "of", len(found))
    assert np.mean(found) >= 0.9


def pair_at(rng, similarity, n=400):
    """Two texts of n words that share all but a run; their Jaccard similarity by shingles of five is the least from `similarity` on."""
    words = [f"w{x}" for x in rng.integers(0, 10**9, n)]
    grams = n - 4
    gone = int((grams - 2 * grams * similarity / (1 + similarity)) + 1e-9) - 4  # a run of k words takes k + 4 shingles
    at = int(rng.integers(5, n - gone - 5))
    return " ".join(words), " ".join([*words[:at], *(f"x{x}" for x in rng.integers(0, 10**9, gone)), *words[at + gone :]])


def test_pairs_at_the_similarity_asked_for(spark):
    """Of pairs at 0.8 nine tenths or more are linked; pairs at 0.5 are not."""
    from lorespark.llm import simhash_dedup

    rng, made = np.random.default_rng(4), []
    for k in range(300):
        made += zip((4 * k, 4 * k + 1, 4 * k + 2, 4 * k + 3), (*pair_at(rng, 0.8), *pair_at(rng, 0.5)))
    docs = spark.createDataFrame([(k, t) for k, t in made], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash_dedup.similar(spark, docs, 0.8).collect()}
    near, far = (np.mean([out[4 * k + s] == out[4 * k + s + 1] for k in range(300)]) for s in (0, 2))
    print("near-dedup: linked at 0.8", near, "at 0.5", far)
    assert near >= 0.9 and far == 0


def test_mixture_and_tokens(stages):
    before, mixed, last = stages[3], stages[4], stages[5]
    assert set(mixed.doc_id) <= set(before.doc_id) and max(Counter(mixed.doc_id).values()) <= 3
    assert len(last) == len(mixed) and (last.n_tokens == last.ids.map(len)).all()
    words = lambda d: d.text.map(lambda t: len(t.encode().split())).sum()
    assert abs(words(mixed) - words(before)) <= 0.02 * words(before) + 2000


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    from test_operators import DOCS, ODD

    odd = spark.createDataFrame(ODD, DOCS)
    spark.createDataFrame([(3, 1, 0), (8, 1, 0), (7, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and 0 <= out.count() <= 3 * len(ODD)
        assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, str(tmp_path)).count() == len(ODD) and last(spark, odd.where("false"), str(tmp_path)).count() == 0


def test_run_gives_the_same_rows(spark, stages):
    again = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, again[key].values.tolist())) == sorted(map(tuple, stages[5][key].values.tolist()))
