"""The fuzzy tier against brute force over all pairs."""

import random

from pyspark.sql import functions as F

from lorespark.operators import ranking
from lorespark.operators import resolution as R
from lorespark.plans.knowledge import j16_fuzzy_best, j17_resolution

CATALOGUE = [(1, "Kubernetes"), (2, "Microservice Patterns"), (3, "Transactional Outbox Pattern"), (4, "AI Safety"), (5, "Zeta Queue"), (6, "Alpha Queue"), (7, "retrieval")]
ALIASES = [(5, "Distributed Message Broker"), (1, "container orchestration platform")]


def key(s):
    return " ".join(sorted(ranking._processed(s).split()))


def plain_best(name, entities, aliases, accept=92.0):
    """The reference's rule: token_sort_ratio, 100 for names of two tokens or more that cover or are covered."""
    texts, a = [(c, e, c) for e, c in entities], key(name)
    texts += [(c, e, t) for x, t in aliases for e, c in entities if x == e]
    scored = []
    for canonical, entity, text in texts:
        b = key(text)
        if not a or not b:
            continue
        x, y = set(a.split()), set(b.split())
        score = 100.0 if len(a.split()) >= 2 and (x <= y or y <= x) else ranking.ratio(a, b)
        if score >= accept:
            scored.append((-score, canonical, entity))
    return (min(scored)[2], -min(scored)[0]) if scored else None


def frames(spark, entities, aliases):
    return spark.createDataFrame(entities, "entity_id long, canonical string"), spark.createDataFrame(aliases, "entity_id long, alias string")


def found(spark, names, entities, aliases):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return {r.name: (r.entity_id, r.score) for r in R.best_entities(df, *frames(spark, entities, aliases), R.FUZZY_ACCEPT).collect()}


def test_fuzzy_entities_match_brute_force(spark):
    rng, names = random.Random(3), ["Kubernets", "Patterns, Microservices", "Transactional Outbox", "AI", "Queue", "Distributed Mesage Broker", "retrieval of text", "", "!", "é", "a"]
    letters, entities = "abcdeé", [*CATALOGUE, (8, "a"), (9, "é"), (10, "ab")]
    for k in range(150):
        text = " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 5)))
        entities.append((100 + k, text))
        for edits in (1, 2, 3):
            chars = list(text)
            for _ in range(edits):
                at = rng.randrange(len(chars) + 1)
                chars[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters)]])
            names.append("".join(chars))
    names = list(dict.fromkeys(names))
    want = {n: best for n in names if (best := plain_best(n, entities, ALIASES))}
    assert found(spark, names, entities, ALIASES) == want
    assert want["Kubernets"][0] == 1 and want["Distributed Mesage Broker"][0] == 5 and "AI" not in want and "Queue" not in want


def named(spark, names):
    return spark.createDataFrame([(n, "concept", None) for n in names], "name string, type string, description string")


def test_best_entities_match_brute_force(spark):
    """Every name's best, however low: short, empty and unlike names, ties, aliases."""
    rng, letters = random.Random(5), "abcdeé "
    entities = [*CATALOGUE, *[(100 + k, "".join(rng.choices(letters, k=rng.randint(1, 14))).strip() or "x") for k in range(200)]]
    names = list(dict.fromkeys(["".join(rng.choices(letters + "xyz", k=rng.randint(0, 14))) for _ in range(300)] + ["Kub", "Queue", "!", "", "patterns"]))
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    for least in (0.0, 70.0):
        got = {r.name: (r.entity_id, r.score) for r in R.best_entities(frame, *frames(spark, entities, ALIASES), least).collect()}
        assert got == {n: best for n in names if (best := plain_best(n, entities, ALIASES, max(least, 1e-9)))}


def test_best_entities_among_twenty_thousand(spark):
    """A catalogue of 20,000 distinct made-up names with aliases, in blocks; every name's best is that of brute force; no Cartesian plan."""
    rng = random.Random(7)
    syllables = [a + b for a in "bcdfgklmnprstv" for b in "aeiou"]
    made = set()
    while len(made) < 20_000:
        made.add(" ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))))
    made = sorted(made)
    entities = [(k, n) for k, n in enumerate(made[:15_000])]
    aliases = [(k % 15_000, n) for k, n in enumerate(made[15_000:])]
    names = [n[:-1] + "x" for n in made[::500]] + ["".join(rng.choices(syllables, k=5)) for _ in range(20)]
    frame = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    best = R.best_entities(frame, *frames(spark, entities, aliases))
    got = {r.name: (r.entity_id, r.score) for r in best.collect()}
    # plain_best goes through aliases for each entity; here they are matched by id
    own = dict(entities)
    texts = [(n, k, key(n)) for k, n in entities] + [(own[k], k, key(n)) for k, n in aliases]
    for n in names:
        a, x = key(n), set(key(n).split())
        want = min((-(100.0 if len(x) >= 2 and (x <= set(b.split()) or set(b.split()) <= x) else ranking.ratio(a, b)), c, k) for c, k, b in texts)
        assert got[n] == (want[2], -want[0]), n
    assert "Cartesian" not in best._jdf.queryExecution().toString() and "NestedLoop" not in best._jdf.queryExecution().toString()


def test_all_tiers(spark):
    """Exact, fuzzy, embedding, judge and new; the embedder and the judge are called once a batch, each for what is left."""
    entities = spark.createDataFrame([(1, "Sarah Chen", "person", "an engineer"), (2, "Kubernetes", "system", None), (3, "Message Brokers", "concept", ""), (4, "Team Atlas", "organization", "")], "entity_id long, canonical string, type string, description string")
    aliases = spark.createDataFrame([(4, "atlas group")], "entity_id long, alias string")
    names = named(spark, ["sarah chen", "Kubernets", "S. Chen", "Mesage Brokering", "Atlas Grp", "Sara Chin", "Quantum Foam", "AI"])
    calls = spark.sparkContext.accumulator(0)
    asked = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(1)
        return [[1.0, 0.0] if "rok" in t else [0.0, float(k + 1)] if k < len(texts) // 2 else [1.0, -1.0] for k, t in enumerate(texts)]

    def judge(prompt):
        asked.add(1)
        assert "- NAME: S. Chen (concept; no description)\n  CANDIDATE: Sarah Chen (person; an engineer)" in prompt and "Brokering" not in prompt
        return '<think>x</think>```json\n[{"name": "S. Chen", "match": "sarah chen"}, {"name": "Sara Chin", "match": "Sarah Chan"}, {"name": "Atlas Grp", "match": null}]\n```'

    got = {r.name: (r.entity_id, r.tier) for r in R.resolve(names.coalesce(1), entities, aliases, embed, judge).coalesce(1).collect()}
    assert got == {
        "sarah chen": (1, "exact"), "Kubernets": (2, "fuzzy"), "S. Chen": (1, "llm"), "Mesage Brokering": (3, "embedding"),
        "Atlas Grp": (None, "new") if R.FUZZY_ACCEPT > ranking.ratio("atlas grp", "atlas group") else (4, "fuzzy"), "Sara Chin": (None, "new"), "Quantum Foam": (None, "new"), "AI": (None, "new"),
    }
    assert calls.value == asked.value  # as many batches as had borderline names


def test_tiers_that_are_not_given_are_passed_over(spark):
    entities = spark.createDataFrame([(1, "Sarah Chen", "person", None)], "entity_id long, canonical string, type string, description string")
    aliases = spark.createDataFrame([], "entity_id long, alias string")
    for reply in (None, "no JSON", '{"name": "S. Chen", "match": "Sarah Chen"}', '[{"name": "S. Chen", "match": "Somebody"}]'):
        got = R.resolve(named(spark, ["S. Chen"]), entities, aliases, None, (lambda p, r=reply: r) if reply else None).collect()
        assert [(r.entity_id, r.tier, r.score) for r in got] == [(None, "new", 0.0)]


def test_resolution_query_takes_misspelt_names(spark):
    entities, aliases = frames(spark, CATALOGUE, ALIASES)
    part = spark.createDataFrame([(3, "Kubernetes", "a", "b"), (5, "Retrieval", "a", "b"), (9, "Microservice Patterns", "a", "b")], "p_partkey long, p_name string, p_brand string, p_type string")
    got = {r.name: (r.entity_id, r.tier) for r in j17_resolution(entities.withColumn("type", F.lit("concept")), aliases, part).collect()}
    assert got["Kubernetes"] == (1, "exact") and got["Rtrivl"][1] in ("llm", "new", "embedding") and len(got) == 3
    best = {r.name: r.entity_id for r in j16_fuzzy_best(entities, aliases, part).collect()}
    assert best["Kubernetes"] == 1 and best["Rtrivl"] == 7
