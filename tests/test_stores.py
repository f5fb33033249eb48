"""The stores: what is rejected, what changes do across tables, and that a failing half leaves all as it was."""

import pytest
from pyspark.sql import functions as F

from lorespark.operators import stores

NOW = "2024-12-31 00:00:00"


def frame(spark, store, rows):
    return spark.createDataFrame(rows, ", ".join(f"{n} {'string' if k in ('timestamp', 'date') else k}" for n, k, _ in stores.columns(store))).select(*[F.col(n).cast(k).alias(n) for n, k, _ in stores.columns(store)])


@pytest.fixture
def graph(spark):
    entities = frame(spark, "entities", [(1, "Ann", "person", "", "p1", NOW, NOW), (2, "Bee", "concept", "", None, NOW, NOW), (3, "Cat", "concept", "", "p2", NOW, NOW), (4, "Dog", "concept", "", None, NOW, NOW)])
    aliases = frame(spark, "aliases", [(1, "annie")])
    mentions = frame(spark, "mentions", [(1, 2, "p1", "", "s", NOW), (2, 3, "p1", "", "s", NOW), (3, 4, "p9", "", "s", NOW)])
    return entities, aliases, mentions


def counted(counts):
    return {r.change: r.n for r in counts.collect()}


def test_rows_that_a_store_cannot_take(spark):
    raw = spark.createDataFrame([("1", "p", "t", "s", "", "0.5", "2024-01-01"), ("x", "p", "t", "s", "", "0.5", "2024-01-01"), ("2", None, "t", "s", "", "0.5", "2024-01-01"), ("3", "p", " ", "s", "", "0.5", "2024-01-01"), ("4", "p", "t", "s", "", "1.5", "2024-01-01"), ("1", "q", "t", "s", "", "0.5", "2024-01-01"), ("5", "p", "t", "s", "", "0.5", "soon")], "id string, page_id string, text string, source_id string, source_span string, confidence string, valid_from string")
    out = stores.scanned("claims", raw.withColumns({"created": F.lit(NOW), "further": F.lit(1)}))
    assert out.columns == [n for n, _, _ in stores.columns("claims")] + ["rejected"]
    got = sorted((str(r.id), r.page_id or "", r.rejected or "") for r in out.collect())
    assert got == sorted([("1", "p", ""), ("None", "p", "id is no long"), ("2", "", "page_id is missing"), ("3", "p", "blank text"), ("4", "p", "confidence out of range"), ("1", "q", "key is taken"), ("5", "p", "valid_from is no date")])
    assert stores.scanned("embeddings", spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id long, embedding array<double>"), 2).where("rejected IS NULL").count() == 1
    assert stores.scanned("aliases", spark.createDataFrame([], "entity_id long, alias string")).count() == 0


def test_sources_go_with_their_vectors(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, source_path string")
    vectors = spark.createDataFrame([(1, [1.0]), (3, [2.0]), (9, [3.0])], "chunk_id long, embedding array<double>")
    state, counts = stores.delete_sources(chunks, vectors, spark.createDataFrame([("a",), ("a",), ("zz",)], "source_path string"))
    assert counted(counts) == {"chunks_deleted": 2, "vectors_deleted": 1}
    assert [r.id for r in state["chunks"].collect()] == [3] and sorted(r.chunk_id for r in state["embeddings"].collect()) == [3, 9]


def test_aliases_types_and_mentions(spark, graph):
    entities, aliases, mentions = graph
    state, counts = stores.add_aliases(entities, aliases, spark.createDataFrame([(1, " annie "), (1, "An  n"), (2, "b"), (2, "b")], "entity_id long, alias string"))
    assert counted(counts) == {"aliases_added": 2} and sorted(map(tuple, state["aliases"].collect())) == [(1, "An n"), (1, "annie"), (2, "b")]
    for bad in ((9, "x"), (1, "  ")):
        with pytest.raises(ValueError):
            stores.add_aliases(entities, aliases, spark.createDataFrame([bad], "entity_id long, alias string"))
    state, counts = stores.retype(entities, spark.createDataFrame([(2, "system")], "entity_id long, type string"), "2025-01-01")
    assert counted(counts) == {"entities_retyped": 1} and {r.id: r.type for r in state["entities"].collect()}[2] == "system"
    for bad in ((2, "planet"), (9, "system")):
        with pytest.raises(ValueError):
            stores.retype(entities, spark.createDataFrame([bad], "entity_id long, type string"), NOW)
    new = spark.createDataFrame([(1, "p5", "x", "s2"), (1, "p5", "x", "s2"), (2, "p6", None, None)], "entity_id long, page_id string, span string, source_id string")
    state, counts = stores.add_mentions(entities, mentions, new, NOW)
    assert counted(counts) == {"mentions_added": 3} and sorted(r.id for r in state["mentions"].collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        stores.add_mentions(entities, mentions, new.withColumn("entity_id", F.lit(77).cast("long")), NOW)


def test_pages_go_with_what_hangs_on_them(spark, graph):
    entities, _, mentions = graph
    state, counts = stores.delete_pages(entities, mentions, spark.createDataFrame([("p1",)], "page_id string"))
    assert counted(counts) == {"mentions_deleted": 2, "entities_unlinked": 1, "entities_deleted": 2}
    assert {(r.id, r.page_id) for r in state["entities"].collect()} == {(3, "p2"), (4, None)}


def test_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "claim_id long, embedding array<float>")
    state, counts = stores.upsert_vectors(vectors, spark.createDataFrame([(2, [5.0]), (3, [6.0])], "claim_id long, embedding array<float>"), spark.createDataFrame([(1,)], "claim_id long"))
    assert counted(counts) == {"vectors_written": 2, "vectors_replaced": 1, "vectors_deleted": 1}
    assert {(r.claim_id, r.embedding[0]) for r in state["claim_vectors"].collect()} == {(2, 5.0), (3, 6.0)}
    claims = spark.createDataFrame([(1, "a", None), (5, "bb", None), (6, "c", "2024-01-01")], "id long, text string, valid_to string")
    state, counts = stores.backfill_vectors(claims, vectors, lambda texts: [[float(len(t))] for t in texts])
    assert counted(counts) == {"vectors_backfilled": 1} and {(r.claim_id, r.embedding[0]) for r in state["claim_vectors"].collect()} == {(1, 1.0), (2, 2.0), (5, 2.0)}


def test_all_tables_change_or_none(spark, tmp_path, graph):
    entities, aliases, mentions = graph
    tables = stores.Tables(spark, f"file://{tmp_path}/store")
    tables.commit({"entities": entities, "aliases": aliases, "mentions": mentions})
    before = {t: sorted(map(tuple, tables.read(t).collect())) for t in tables.current()}
    open_reader = tables.read("mentions")
    state, _ = stores.delete_pages(tables.read("entities"), tables.read("mentions"), spark.createDataFrame([("p1",)], "page_id string"))
    broken = state["entities"].withColumn("id", F.raise_error(F.lit("fails half way")).cast("long"))
    with pytest.raises(Exception, match="fails half way"):
        tables.commit({"mentions": state["mentions"], "entities": broken})
    assert {t: sorted(map(tuple, tables.read(t).collect())) for t in tables.current()} == before
    tables.commit(state)
    assert tables.read("mentions").count() == 1 and tables.read("entities").count() == 2 and tables.read("aliases").count() == 1
    assert open_reader.count() == 3  # what was opened before stays readable
    # two old states, and what the failed change had staged
    assert tables.expire() == 4 and tables.read("entities").count() == 2
