"""Rendering, prompts, validation, grouping and slugs over literal rows and against plain versions."""

import random
import re
import unicodedata
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from lorespark.functions import safety, text
from lorespark.operators import ranking, rendering, usage
from lorespark.sources import files


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


def test_slug_is_that_of_the_compatibility_form(spark):
    rng = random.Random(5)
    odd = "ﬁﬀ½⅓Ⅷ①⑽㎏℀ＡｂＣ　ÅÉßñİK™…–—_/\\\x1f\x85     Aé字Ж-'𝐀𝟗"
    texts = ["", "  ", "ﬁne ½ Ⅷ", "Ｆｕｌｌ　Ｗｉｄｔｈ", "naïve café", "---", "x" * 119 + " yz"] + ["".join(rng.choices(odd + "ab 1", k=rng.randint(1, 30))) for _ in range(300)]

    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        t = re.sub(r"-+", "-", re.sub(r"[^a-z0-9-]", "", re.sub(r"[\s–—_/\\-]+", "-", t)))
        return t.strip("-")[:120] or "untitled"

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", text.slugify(F.col("t")).alias("s")).collect()}
    assert got == {t: plain(t) for t in texts}


def test_fixed_rounds_exact_values(spark):
    xs = [k / 1000 for k in range(1001)] + [random.Random(1).random() ** 3 for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", text.fixed(F.col("x"), 1).alias("one"), text.fixed(F.col("x"), 2).alias("two"))
    for r in df.collect():
        assert r.one == str(Decimal(r.x).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) and r.two == f"{r.x:.2f}"


def test_claims_of_a_page(spark):
    rows = [(1, 2, "b  c", 0.25, None), (1, 1, "a\nx", 0.9, None), (1, 3, "old", 0.5, "2024-01-02"), (2, 4, "gone", 0.5, "2024-01-03")]
    claims = spark.createDataFrame(rows, "page long, claim_id long, text string, confidence double, valid_to string").withColumn("valid_to", F.col("valid_to").cast("date"))
    df = rendering.page_claims(claims, "page")
    section = rendering.claims_section(F.col("active"), F.col("retired"))
    body = rendering.page_body(F.lit("T"), F.col("active"), F.col("retired"), F.array(F.lit("A"), F.lit("A")))
    got = {r.page: r for r in df.select("page", section.alias("section"), body.alias("body"), rendering.sync_section(F.concat(F.lit("P\n\n"), section, F.lit("\ntail \n")), section).alias("sync"), rendering.sync_section(section, F.lit("")).alias("none")).collect()}
    s = "<!-- claims:start -->\n## Knowledge Claims\n\n- a x (conf 0.9)\n- b c (conf 0.2)\n\n### Superseded\n\n- ~~old~~ (retired 2024-01-02)\n<!-- claims:end -->"
    assert got[1].section == s and got[1].sync == f"P\ntail\n\n{s}" and got[1].none == ""
    assert got[1].body == "# T\n\n- a x (conf 0.9)\n- b c (conf 0.2)\n\n### Superseded\n\n- ~~old~~ (retired 2024-01-02)\n\n## See Also\n\n- [[A]]"
    assert got[2].section == "<!-- claims:start -->\n## Knowledge Claims\n\n\n### Superseded\n\n- ~~gone~~ (retired 2024-01-03)\n<!-- claims:end -->" and got[2].body == ""


def test_prompts(spark):
    candidates = F.array(F.struct(F.lit(7).alias("claim_id"), F.lit("old").alias("text"), F.lit(0.125).alias("confidence")))
    assert one(spark, rendering.decision_prompt(F.lit("new"), candidates)) == (
        "New proposition:\n  <document>\nnew\n</document>\n\nExisting claims (id: text [confidence]):\n  7: <document>\nold\n</document> [0.12]\n\n"
        "Decide ADD, MERGE, SUPERSEDE, or NOOP for the new proposition.\nReply with ONLY the JSON object described in the system prompt."
    )
    assert one(spark, rendering.extract_prompt(F.lit("t"), F.lit("n"), F.lit("memo"), F.lit(1), F.lit(1))) == "Source: n\nType: a memo\n\n---\nt\n---"
    assert one(spark, rendering.merge_prompt(F.array(F.lit(" a\n"), F.lit("b")), F.lit(""))) == "Merge these 2 partial wiki drafts into one coherent page.\n\n--- PARTIAL 1 ---\na\n\n--- PARTIAL 2 ---\nb"
    day = lambda d: F.lit(d).cast("date")
    interests = F.array(F.struct(F.lit("tech").alias("domain"), F.lit("a").alias("tag"), F.lit(2.0).alias("weight")))
    excerpts = F.array(F.struct(F.lit("A").alias("title"), F.lit("tech").alias("domain"), F.lit(" body ").alias("body")))
    assert one(spark, rendering.digest_prompt(day("2024-01-01"), day("2024-01-08"), F.array(F.lit("A")), interests, F.lit(3), excerpts)) == (
        "Period: 2024-01-01 → 2024-01-08 (7 days)\nActive pages (1 total): A\nTop interests: tech/a (2.0)\nQueries made: 3\n\nPage excerpts:\n- A (tech): body"
    )


def test_groups_of_ideas(spark):
    rows = [("s", 0, "alpha beta", "short", "tech", ["x"]), ("s", 1, "gamma delta", "one", "misc", None), ("s", 2, "alpha beta", "short more", "misc", ["y", "x"]), ("s", 3, "beta alpha", "short", "misc", []), ("t", 0, None, None, None, None)]
    ideas = spark.createDataFrame(rows, "source string, idea_no int, title string, summary string, domain string, tags array<string>")
    got = {(r.source, r["rank"]): (r.idea_no, r.first_idea, r.n, r.tags, r.domain) for r in ranking.ranked_ideas(ideas, "source", 5).collect()}
    assert got == {("s", 0): (2, 0, 3, ["x", "y"], "misc"), ("s", 1): (1, 1, 1, [], "misc"), ("t", 0): (0, 0, 1, [], None)}


def test_spans_and_verified_ideas(spark):
    schema = "s string, idea_no long, title string, span string"
    merged = spark.createDataFrame([("a", 0, "One", None), ("a", 1, "Two", "kept"), ("a", 2, "", " ")], schema)
    candidates = spark.createDataFrame([("a", 0, "one ", " "), ("a", 1, " ONE", " first "), ("a", 2, "one", "second"), ("a", 3, "two", "other"), ("b", 0, "One", "else")], schema)
    assert {r.idea_no: r.span for r in ranking.preserved_spans(merged, candidates, "s").collect()} == {0: "first", 1: "kept", 2: ""}
    found = spark.createDataFrame([("a", 0, "TWO", ""), ("a", 1, "New", ""), ("b", 0, "New", "")], schema)
    assert sorted((r.idea_no, r.title) for r in ranking.verified_ideas(merged, found, "s").collect()) == [(0, "One"), (1, "Two"), (2, ""), (4, "New")]


def test_near_part_is_partial_ratio():
    rng = random.Random(9)
    for _ in range(400):
        b = "".join(rng.choices("abc ", k=rng.randint(1, 60)))
        k = rng.randrange(len(b))
        a = list(b[k : k + rng.randint(1, 30)])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(a) + 1)
            a[at : at + rng.randint(0, 1)] = rng.choice([[], ["a"], ["z"]])
        a = "".join(a)
        assert ranking.near_part(a, b, 90.0) == (bool(a) and ranking.partial_ratio(a, b) >= 90.0), (a, b)


def test_requests(spark):
    cases = {"a.md": [], "/x/B.PDF": [], "notes/.md": ["extension"], "x": ["extension"], "HTTP://h/x": [], "https://": ["host"], "javascript://h": ["scheme"], " ": ["empty source"]}
    df = spark.createDataFrame([(s,) for s in [*cases, None]], "s string").select("s", safety.source_problems(F.col("s"), F.array(F.lit("a"))).alias("why"))
    assert {r.s: r.why for r in df.collect()} == cases | {None: ["empty source"]}
    assert one(spark, safety.title_problems(F.lit("Good title-1.0"))) == [] and one(spark, safety.title_problems(F.lit("a\\b"))) == ["path in title", "characters"]
    blocked = one(spark, safety.sanitize_query(F.lit("x" * 5000 + " [INST] go")))
    assert blocked.blocked and blocked.text is None and blocked.patterns == ["instruction_injection_marker"]


def test_digest_links_references_and_bundle(spark):
    entries = spark.createDataFrame([(1, "2024-01-01 10:00:00", "ingest", ["Old"]), (2, "2024-01-09 09:00:00", "query", ["B", "A"]), (3, "2024-01-09 08:00:00", "ingest", ["A"]), (4, "2024-01-10 09:00:00", "query", [])], "id long, ts string, operation string, pages array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    assert tuple(usage.digest(entries, "2024-01-08").first()) == (2, 2, ["A", "B"])
    r = one(spark, text.rewrite_links(F.lit("[[ A ]] and [[No One]] and [[A]]"), F.create_map(F.lit("A"), F.lit("slug-a"))))
    assert r.text == "[A](/slug-a.md) and [No One](/no-one.md) and [A](/slug-a.md)" and r.unresolved == ["No One"]
    pages = spark.createDataFrame([(1, "b", "ID1", "Same Title"), (2, "a", "ID2", "same title"), (3, "same-title-x", "b", "Other")], "page_no long, slug string, id string, title string")
    refs = spark.createDataFrame([("b",), ("ID2",), ("Same  Title!",), ("nothing",)], "ref string")
    assert {x.ref: x.page_no for x in files.resolve_pages(refs, pages).collect()} == {"b": 1, "ID2": 2, "Same  Title!": 2}
    bundle = spark.createDataFrame([("/x/index.md", "no head"), ("/x/a.md", "---\ntype: t\n---\nx"), ("/x/s/b.md", "---\ntype: ''\n---\nx")], "path string, content string")
    assert tuple(files.conformance(bundle).first()) == (2, 1, False)
