"""Readers and writers on small inputs: files, front matter, cases, bundles, shells and background streams."""

import pytest
from pyspark.sql import functions as F

from lorespark.operators import knowledge as K
from lorespark.operators import shells
from lorespark.sources import files
from lorespark.streaming import operators as S

AS_OF = "2024-12-31"


def test_wiki_folder(spark, tmp_path):
    (tmp_path / "b.md").write_text("---\ntitle: B\ntags: [A b, c]\nsources: s\ndomain: Tech\nupdated: soon\n---\nbody\n\n")
    (tmp_path / "a.md").write_text("no front matter")
    (tmp_path / "old.md").write_text("---\narchived: true\n---\nx")
    (tmp_path / "bad.md").write_text("---\n: [\n---\nkept")
    (tmp_path / "day.md").write_text("---\nupdated: 2024-02-30\n---\nx")
    (tmp_path / "list.md").write_text("---\n[a, b]\n---\nx")
    for name in ("index.md", "log.md", ".hid.md", "c.txt"):
        (tmp_path / name).write_text("x")
    got = {r.title: r for r in files.list_pages(spark, str(tmp_path), AS_OF).collect()}
    assert set(got) == {"B", "a", "bad"} and got["bad"].body == "kept" and got["a"].domain == "misc"
    assert got["B"].tags == ["a-b", "c"] and got["B"].domain == "tech" and str(got["B"].updated) == AS_OF and got["B"].body == "body"
    assert [r.title for r in files.list_pages(spark, str(tmp_path), AS_OF, archived=True).collect()] == ["old"]


def test_text_is_read_whole_and_bad_bytes_replaced(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"x\xff\ny")
    assert files.scan_text(spark, str(tmp_path)).first().content == "x�\ny"


def test_chunk_frontmatter(spark):
    rows = [("a", "---\ntags: [x, 1]\nn: 3\nnone:\n---\n\n  body"), ("b", "---\n: [\n---\nbody"), ("c", "---\nopen"), ("d", "plain"), ("e", None)]
    got = {r.path: (r.meta, r.body) for r in files.chunk_frontmatter(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["a"] == ({"tags": "x,1", "n": "3"}, "body") and got["b"] == ({}, "body")
    assert got["c"] == ({}, "---\nopen") and got["d"] == ({}, "plain") and got["e"] == ({}, None)


def test_cases(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- {query: q, expected_slug: s}\n- {query: r}\n- {query: t, expected_slug: u, domain: tech}\n")
    assert [tuple(r) for r in files.load_cases(spark, str(tmp_path / "a.yaml")).collect()] == [("q", "s", ""), ("t", "u", "tech")]
    (tmp_path / "b.yaml").write_text("a: 1")
    for path, most in (("b.yaml", 1000), ("a.yaml", 5)):
        with pytest.raises(ValueError):
            files.load_cases(spark, str(tmp_path / path), most)


def test_export_survives_odd_titles(spark):
    pages = spark.createDataFrame([(1, 'A: "b" # c', "- x: [y]\n[[A: \"b\" # c]]", "tech"), (2, "yes", "", "misc")], "page_no long, title string, body string, domain string").withColumn("updated", F.lit("2024-03-04").cast("date"))
    back = {r.title: r for r in files.concept_pages(files.scan_bundle(files.export_concepts(pages)), AS_OF).collect()}
    assert set(back) == {'A: "b" # c', "yes"} and str(back["yes"].updated) == "2024-03-04" and back["yes"].domain == "misc"


def test_insert_is_all_or_nothing(spark):
    old = spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<double>")
    new, vectors = spark.createDataFrame([(2,)], "chunk_id long"), spark.createDataFrame([(3, [1.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(ValueError):
        K.insert_chunks(old, new, vectors)


def test_extraction_shell(spark):
    many = "[" + ",".join('{"name": "n%d x", "type": "concept"}' % k for k in range(30)) + "]"
    text = " ".join(f"n{k} x" for k in range(30))
    rows = [(1, text, many), (2, text, "sorry"), (3, None, many), (4, "", '[{"name": null, "type": "person"}]')]
    got = shells.extracted_entities(spark.createDataFrame(rows, "doc_id long, text string, reply string"), "doc_id").collect()
    assert {r.doc_id for r in got} == {1} and sorted(r.pos for r in got) == list(range(20))


def test_suites_fail_alone(spark):
    def broken():
        raise RuntimeError

    one = spark.sql("select 0.8 as score, 'PASS' as grade")
    got = {r.suite: r.status for r in shells.run_suites(spark, {"a": lambda: one, "b": broken, "c": lambda: one.where("false"), "d": lambda: one}, {"d": False}).collect()}
    assert got == {"a": "run", "b": "skipped", "c": "skipped", "d": "skipped"}


def test_search_ranks_with_few_scores(spark):
    pages = spark.createDataFrame([(k, f"s{k}", "apple" if k == 9 else "pear") for k in range(12)], "pos long, slug string, body string")
    cases = spark.createDataFrame([(1, "apple", "s9"), (2, "apple", "s0"), (3, "apple", "s3"), (4, "apple", "s4"), (5, "none", "s4"), (6, "", "s5")], "case_id long, query string, expected_slug string")
    assert {r.case_id: r["rank"] for r in shells.search_ranks(cases, pages).collect()} == {1: 1, 2: 2, 3: 5, 4: None, 5: 5, 6: None}


def test_log_stream_and_fan_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("## [2024-01-01 10:00] ingest | x\nUpdated: a, b\n\n## [bad] ingest | y\n\n")
    stream = lambda: spark.readStream.format("text").option("wholetext", True).load(str(tmp_path / "in")).withColumnRenamed("value", "content")
    got, seen, failed = [], [], []
    S.log_entries(stream(), lambda df, n: got.extend(df.collect()), str(tmp_path / "c1")).awaitTermination(60)
    assert [(r.operation, r.pages) for r in got] == [("ingest", ["a", "b"])]

    def bad(df):
        raise RuntimeError("index")

    S.fan_out(stream(), {"bad": bad, "good": lambda df: seen.append(df.count())}, lambda name, e: failed.append(name), str(tmp_path / "c2")).awaitTermination(60)
    assert seen == [1] and failed == ["bad"]


def test_reconcile_rounds_see_each_other(spark, tmp_path):
    props = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (2, 0, 20)], "source long, ordinal int, claim long")
    props.write.parquet(str(tmp_path / "in"))
    kept: list[tuple] = []
    state = lambda: spark.createDataFrame(kept, "source long, claim long, n long")

    def apply(now, batch):
        n = now.groupBy("source").agg(F.count("*").alias("n"))
        return batch.join(n, "source", "left").select("source", "claim", F.coalesce("n", F.lit(0)).alias("n"))

    S.reconcile(spark.readStream.schema(props.schema).parquet(str(tmp_path / "in")), state, apply, lambda df: kept.extend(map(tuple, df.collect())), str(tmp_path / "c")).awaitTermination(60)
    assert sorted(kept) == [(1, 10, 0), (1, 11, 1), (2, 20, 0)]
