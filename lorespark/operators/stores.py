"""The stores as tables: explicit schemas, rejected rows, changes across tables with their counts, one commit for all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_fold, words
from .numbering import hash_pieces, numbered_on

ENTITY_TYPES = "person project system organization concept".split()
#: Of each store its columns (`!` marks those that must not be null), its key and what else must hold.
STORES = {
    "sources": "source_path string!, content_hash string!, indexed_at timestamp!",
    "chunks": "id long!, source_path string!, source_slug string!, chunk_index int!, page_num int, text string!, char_count int!, created_at timestamp!, heading_path string, parent_text string, chunk_type string, page_title string, domain string, tags string",
    "embeddings": "chunk_id long!, embedding array<float>!",
    "entities": "id long!, canonical string!, type string!, description string!, page_id string, created timestamp!, updated timestamp!",
    "aliases": "entity_id long!, alias string!",
    "mentions": "id long!, entity_id long!, page_id string!, span string!, source_id string!, created timestamp!",
    "claims": "id long!, page_id string!, text string!, source_id string!, source_span string!, confidence double!, valid_from date!, valid_to date, superseded_by long, created timestamp!",
    "claim_vectors": "claim_id long!, embedding array<float>!",
}
KEYS = {"sources": ["source_path"], "chunks": ["id"], "embeddings": ["chunk_id"], "entities": ["id"], "aliases": ["entity_id", "alias"], "mentions": ["id"], "claims": ["id"], "claim_vectors": ["claim_id"]}
RULES: dict[str, dict[str, Callable[[], Column]]] = {
    "entities": {"unknown type": lambda: F.col("type").isin(*ENTITY_TYPES), "blank name": lambda: F.trim("canonical") != ""},
    "aliases": {"blank alias": lambda: F.trim("alias") != ""},
    "claims": {"confidence out of range": lambda: F.col("confidence").between(0.0, 1.0), "blank text": lambda: F.trim("text") != ""},
}


def columns(store: str) -> list[tuple[str, str, bool]]:
    """(name, type, required) of a store's columns."""
    parts = [c.rsplit(" ", 1) for c in STORES[store].split(", ")]
    return [(name, kind.rstrip("!"), kind.endswith("!")) for name, kind in parts]


def schema(store: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind, _ in columns(store)))


def scanned(store: str, raw: DataFrame, dim: int | None = None) -> DataFrame:
    """raw under the store's schema, with `rejected`: why a row cannot be taken, null for sound rows.

    Columns that raw lacks are null, as after a schema change; further ones are dropped. A value that does not cast, a required
    one that is missing, a broken rule, a vector of another length than `dim`, and all but one of the rows of a key are reasons.
    """
    have, casts, reasons = set(raw.columns), [], []
    for name, kind, required in columns(store):
        own = F.col(name) if name in have else F.lit(None)
        casts.append(own.try_cast(kind).alias(name))
        if name in have:
            reasons.append(F.when(own.isNotNull() & own.try_cast(kind).isNull(), f"{name} is no {kind}"))
        if required:
            reasons.append(F.when(own.isNull(), f"{name} is missing"))
    out = raw.select(*casts, F.coalesce(*reasons, F.lit(None).cast("string")).alias("rejected"))
    for reason, rule in RULES.get(store, {}).items():
        out = out.withColumn("rejected", F.coalesce("rejected", F.when(~rule(), reason)))
    if dim is not None and "embedding" in out.columns:
        out = out.withColumn("rejected", F.coalesce("rejected", F.when(F.size("embedding") != dim, "vector of another length")))
    # the first row of a key stays: which one is the same in every run, as all columns order it
    nth = F.row_number().over(Window.partitionBy(*KEYS[store], F.col("rejected").isNull()).orderBy(*[c for c, _, _ in columns(store)]))
    return out.withColumn("_nth", nth).withColumn("rejected", F.coalesce("rejected", F.when(F.col("_nth") > 1, "key is taken"))).drop("_nth")


# changes across tables: each gives the tables' new state, and what it did as rows (change, n)


def _counts(spark: SparkSession, **counts: DataFrame) -> DataFrame:
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.lit(name).alias("change"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def delete_sources(chunks: DataFrame, vectors: DataFrame, sources: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The chunks of sources (source_path), and their vectors by chunk_id, go; both numbers are returned."""
    named = sources.select("source_path").distinct()
    gone = chunks.join(named, "source_path", "left_semi").select(F.col("id").alias("chunk_id"))
    kept = {"chunks": chunks.join(named, "source_path", "left_anti").select(*chunks.columns), "embeddings": vectors.join(gone, "chunk_id", "left_anti").select(*vectors.columns)}
    return kept, _counts(chunks.sparkSession, chunks_deleted=gone, vectors_deleted=vectors.join(gone, "chunk_id", "left_semi"))


def known_or_raise(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """rows whose entity_id exists; one that does not raises, as a foreign key would."""
    bad = rows.select("entity_id").join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").head(1)
    if bad:
        raise ValueError(f"entity {bad[0].entity_id} does not exist")
    return rows


def add_aliases(entities: DataFrame, aliases: DataFrame, new: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """new (entity_id, alias): inserted or ignored, white space collapsed; blank aliases and unknown entities raise."""
    clean = new.select("entity_id", F.array_join(words(F.col("alias")), " ").alias("alias"))
    if clean.where("alias = '' OR alias IS NULL").head(1):
        raise ValueError("alias must not be blank")
    fresh = known_or_raise(clean, entities).dropDuplicates().join(aliases.select("entity_id", "alias"), ["entity_id", "alias"], "left_anti")
    return {"aliases": aliases.unionByName(fresh)}, _counts(aliases.sparkSession, aliases_added=fresh)


def retype(entities: DataFrame, types: DataFrame, now: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """types (entity_id, type): the entities get them and are stamped; unknown types and entities raise."""
    if types.where(~F.col("type").isin(*ENTITY_TYPES) | F.col("type").isNull()).head(1):
        raise ValueError("unknown entity type")
    one = known_or_raise(types, entities).groupBy(F.col("entity_id").alias("id")).agg(F.max("type").alias("_type"))
    out = entities.join(one, "id", "left").withColumns({"type": F.coalesce("_type", "type"), "updated": F.when(F.col("_type").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("updated"))})
    return {"entities": out.select(*entities.columns)}, _counts(entities.sparkSession, entities_retyped=one)


def add_mentions(entities: DataFrame, mentions: DataFrame, new: DataFrame, now: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """new (entity_id, page_id, span, source_id): appended, repeats too, numbered on from the last; unknown entities raise."""
    last = mentions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    order = ["entity_id", "page_id", "span", "source_id"]
    numbered = numbered_on(known_or_raise(new, entities), hash_pieces(new, order), order)
    rows = numbered.join(F.broadcast(last)).withColumns({"id": F.col("_last") + F.col("_n"), "created": F.lit(now).cast("timestamp")})  # last is one row
    fresh = rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c in ("span", "source_id") else F.col(c) for c in mentions.columns])
    return {"mentions": mentions.unionByName(fresh)}, _counts(mentions.sparkSession, mentions_added=fresh)


def delete_pages(entities: DataFrame, mentions: DataFrame, pages: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """pages (page_id): their mentions go, entities lose them, and those with neither page nor mention go; all are counted."""
    named = pages.select("page_id").distinct()
    gone = mentions.join(named, "page_id", "left_semi")
    left = mentions.join(named, "page_id", "left_anti").select(*mentions.columns)
    loose = entities.join(named.withColumn("_gone", F.lit(True)), "page_id", "left")
    loose = loose.withColumns({"_was": F.coalesce("_gone", F.lit(False)), "page_id": F.when(F.col("_gone").isNull(), F.col("page_id"))}).drop("_gone")
    marked = loose.join(left.select(F.col("entity_id").alias("id")).distinct().withColumn("_m", F.lit(True)), "id", "left")
    stays = F.col("page_id").isNotNull() | F.coalesce("_m", F.lit(False))
    kept = {"mentions": left, "entities": marked.where(stays).select(*entities.columns)}
    return kept, _counts(entities.sparkSession, mentions_deleted=gone, entities_unlinked=marked.where("_was"), entities_deleted=marked.where(~stays))


def upsert_vectors(vectors: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """new (claim_id, embedding) replaces or adds; gone (claim_id) is removed, what is new as well."""
    kept = vectors.join(new.select("claim_id"), "claim_id", "left_anti").select(*vectors.columns)
    out = kept.unionByName(new.select(*vectors.columns))
    out = out if gone is None else out.join(gone.select("claim_id"), "claim_id", "left_anti").select(*vectors.columns)
    removed = vectors.limit(0) if gone is None else vectors.join(gone.select("claim_id").distinct(), "claim_id", "left_semi")
    replaced = vectors.join(new.select("claim_id").distinct(), "claim_id", "left_semi")
    return {"claim_vectors": out}, _counts(vectors.sparkSession, vectors_written=new, vectors_replaced=replaced, vectors_deleted=removed)


def backfill_vectors(claims: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> tuple[dict[str, DataFrame], DataFrame]:
    """Active claims that lack a vector get one, their texts embedded `batch` at a time; superseded ones stay without.

    Equal texts come together, so that a batch of rows embeds each of its texts once; a text of very many claims may lie in several tasks.
    """
    bare = claims.where("valid_to IS NULL").select(F.col("id").alias("claim_id"), "text").join(vectors.select("claim_id"), "claim_id", "left_anti")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            coded = some.column("text").dictionary_encode(null_encoding="encode")
            texts = coded.dictionary.to_pylist()
            made = [list(map(float, v)) for at in range(0, len(texts), batch) for v in embed(texts[at : at + batch])]
            yield pa.RecordBatch.from_arrays([some.column("claim_id").cast(pa.int64()), pa.array(made, pa.list_(pa.float32())).take(coded.indices)], ["claim_id", "embedding"])

    near = bare.withColumn("_h", F.xxhash64("text")).hint("rebalance", "_h").sortWithinPartitions("_h").select("claim_id", "text")
    new = near.mapInArrow(each, "claim_id long, embedding array<float>")
    return {"claim_vectors": vectors.unionByName(new)}, _counts(claims.sparkSession, vectors_backfilled=bare)


def duplicate_names(entities: DataFrame) -> DataFrame:
    """(key, n): names that several entities bear, ASCII case aside, which a store must not have."""
    return entities.groupBy(ascii_fold(F.col("canonical")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


class Tables:
    """Tables of a folder that change together: new states are staged, and one renamed pointer makes them current.

    A change that fails while it is staged leaves the pointer, and so every table, as it was. What a reader has opened stays
    where it is until `expire`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> dict[str, str]:
        """The folder of each table."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        pointers = sorted(n for n in found if n.startswith("pointer-"))
        if not pointers:
            return {}
        return {r.store: r.folder for r in self.spark.read.schema("store string, folder string").json(f"{self.root}/{pointers[-1]}").collect()}

    def read(self, store: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()[store]}")

    def commit(self, changes: dict[str, DataFrame]) -> None:
        """Every table of changes gets its new state, or none does."""
        now, stamp = self.current(), uuid.uuid4().hex
        for store, rows in changes.items():
            folder = f"data/{store}-{stamp}"
            rows.write.parquet(f"{self.root}/{folder}")
            now[store] = folder
        staged = f"{self.root}/staged-{stamp}"
        self.spark.createDataFrame(sorted(now.items()), "store string, folder string").coalesce(1).write.json(staged)
        held = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        number = 1 + max((int(n.split("-")[1]) for n in held if n.startswith("pointer-")), default=0)
        # renaming onto a pointer that another writer has made since fails, and nothing changes
        target = self._path(f"{self.root}/pointer-{number:012d}")
        if self._fs.exists(target) or not self._fs.rename(self._path(staged), target):
            raise RuntimeError("another change came first")

    def expire(self) -> int:
        """Removes what the current pointer does not name; the number of folders."""
        named = {f.split("/")[1] for f in self.current().values()}
        old = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/data")) if s.getPath().getName() not in named]
        for path in old:
            self._fs.delete(path, True)
        return len(old)
