"""A Merkle manifest of a dataset: a digest of every row, a tree a language, one root, and a proof a row.

H is lowercase hex sha256 of its inputs, concatenated, digests as hex text. A leaf is H of doc_id, source, lang, n_chars
and text, each `-` if null, else its UTF-8 byte count, `:`, and its value. A tree's leaves ascend; while it has several
nodes, every `FAN` consecutive ones, the last run being what is left, become their H. The nodes that remain, a subroot a
language, are the leaves of a tree of their own, by language, whose node is the root.

Leaves are computed by Spark's own functions, so texts are neither shuffled nor handed to Python. They are numbered in
order by ranges: each range numbers its rows, and counts of ranges give the rest. Trees are cut into aligned buckets of
FAN ** DEPTH leaves, so that every bucket but a tree's last is a full subtree. A task takes whole buckets, some thousand rows at a time, as Arrow
tables into DuckDB: a query a level, string_agg in order and sha256, gives bucket roots, which are the leaves of the next
round; rounds end when every tree has a single bucket. On the way back, buckets meet the proofs of their roots, and the
same queries give each leaf its siblings. Proofs are hashed, and a leaf is folded back to the root, in the task.

Defined results: leaves ascend by doc_id, null first; rows of one doc_id by leaf; equal rows in any order, as their
leaves are equal. A null language is a tree of its own, the first. An empty table gives no rows, and has no root.
Further columns are neither digested nor carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, prepare

FAN, DEPTH = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows a task hands to DuckDB at once, at least, so that small trees share a call.
CHUNK = 4 * FAN**DEPTH
#: Leaves of a range that numbers its rows.
RANGE_ROWS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(**fields: Column) -> Column:
    """The leaf of a row, with `fields` in place of its own."""
    parts = [fields.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]).cast("binary"), 256)


def numbered(work: Workspace, rows: DataFrame, order: list[str], n_rows: int) -> DataFrame:
    """rows (tree, ...) with i, the place of a row in its tree by `order`, and n, the tree's rows."""
    n_ranges = max(1, -(-n_rows // RANGE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the salt parts rows that are equal in all, whose order is of no account
    keys = ["tree", *[F.col(c).asc_nulls_first() for c in order], "salt"]
    dealt = rows.withColumn("salt", F.rand(7)).repartitionByRange(n_ranges, *keys).sortWithinPartitions(*keys)
    part, at = F.shiftright(F.monotonically_increasing_id(), 33), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = work.table(dealt.drop("salt").withColumns({"part": part, "at": at}))  # written, so that places no longer change
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n_part"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")  # a row a range and tree
    before = F.sum("n_part").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_part")
    starts = counts.select("tree", "part", (before - F.col("first")).alias("start"), F.sum("n_part").over(tree).alias("n"))
    return placed.join(starts, ["tree", "part"]).withColumn("i", F.col("at") + F.col("start")).drop("part", "at", "start")


def in_buckets(rows: DataFrame, each: Callable, schema: str) -> DataFrame:
    """each(DuckDB connection with the rows as the view `t`) over whole buckets, in chunks. Rows hold tree and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            con.register("t", table)
            out = each(con).to_arrow_table()
            con.unregister("t")
            yield from out.to_batches(max_chunksize=4096)

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            trees, buckets = table.column("tree"), table.column("bucket")
            last, cut = (trees[n - 1], buckets[n - 1]), n
            while cut and (buckets[cut - 1], trees[cut - 1]) == (last[1], last[0]):
                cut -= 1
            if cut:  # the last bucket may go on
                yield from done(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield from done(pa.Table.from_batches(held))

    return rows.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket").mapInArrow(run, schema)


def _levels(con, depth: int) -> list[str]:
    """The views r1, r2, ...: of every run of a level its nodes' digests in order, `s`, with the node they become."""
    # a tree of one bucket ends when one node is left, others fill all levels
    con.execute(f"CREATE OR REPLACE TEMP TABLE h0 AS SELECT tree, bucket, i, h, CASE WHEN n > {FAN**depth} THEN {depth} ELSE least({depth}, ceil(log(n) / log({FAN}) - 1e-9)) END AS depth FROM t WHERE h IS NOT NULL")
    for k in range(1, depth + 1):
        con.execute(f"CREATE OR REPLACE TEMP TABLE r{k} AS SELECT tree, bucket, i // {FAN} AS run, string_agg(h, '' ORDER BY i) AS s FROM h{k - 1} WHERE depth >= {k} GROUP BY tree, bucket, run")
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE h{k} AS SELECT r.tree, r.bucket, r.run AS i, sha256(r.s) AS h, d.depth FROM r{k} r JOIN (SELECT DISTINCT tree, bucket, depth FROM h0) d USING (tree, bucket)"
            f" UNION ALL SELECT tree, bucket, i, h, depth FROM h{k - 1} WHERE depth < {k}"
        )
    return [f"r{k}" for k in range(1, depth + 1)]


def bucket_roots(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, i, n, h) of the nodes that buckets of nodes (tree, i, n, h) become."""

    def each(con):
        _levels(con, depth)
        return con.sql(f"SELECT h.tree, h.bucket AS i, cast(ceil(any_value(t.n) / {FAN**depth}) AS BIGINT) AS n, any_value(h.h) AS h FROM h{depth} h JOIN t USING (tree, bucket) GROUP BY h.tree, h.bucket")

    return in_buckets(nodes.select("tree", "i", "n", "h", bucket(depth)), each, "tree string, i long, n long, h string")


def bucket(depth: int) -> Column:
    return F.floor(F.col("i") / FAN**depth).alias("bucket")


#: Of a leaf: the siblings left and right of it, level by level, and all of them in that order.
PROOF = "lefts array<string>, rights array<string>, proof string"


def with_proofs(nodes: DataFrame, outer: DataFrame, keep: str, leaves: bool, depth: int) -> DataFrame:
    """nodes (tree, i, n, h, ...) with the siblings of each from its bucket, and on by outer (tree, i, lefts, rights, proof), a row a bucket.

    keep: (name type, ...) of further columns. With `leaves` proofs are hashed, and each node's `other` digest, else its own, is folded.
    """
    kept = [c.split()[0] for c in keep.split(", ") if c]
    own = nodes.select("tree", "i", "n", "h", *kept, bucket(depth), *[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in PROOF.split(", ")])
    from_outer = outer.select("tree", F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("h"), F.col("i").alias("bucket"), "lefts", "rights", "proof")
    both = own.unionByName(from_outer, allowMissingColumns=True)

    def each(con):
        runs = _levels(con, depth)
        width = 64
        place = [f"(t.i // {FAN ** (k - 1)} % {FAN})" for k in range(1, depth + 1)]
        left = [f"coalesce(substr({r}.s, 1, {width} * {p}), '')" for r, p in zip(runs, place, strict=True)]
        right = [f"coalesce(substr({r}.s, {width} * ({p} + 1) + 1), '')" for r, p in zip(runs, place, strict=True)]
        joins = " ".join(f"LEFT JOIN {r} ON {r}.tree = t.tree AND {r}.bucket = t.bucket AND {r}.run = t.i // {FAN**k}" for k, r in enumerate(runs, 1))
        siblings = f"[x FOR x IN [{', '.join(f'CASE WHEN {r}.s IS NOT NULL THEN {{part}} END' for r in runs)}] IF x IS NOT NULL]"
        lefts, rights = (siblings.replace("{part}", "{}").format(*parts) for parts in (left, right))
        inner = " || ".join(f"{a} || {b}" for a, b in zip(left, right, strict=True))
        names = ", ".join(f"t.{c}" for c in ["tree", "i", "n", "h", *kept])
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE found AS SELECT {names}, {lefts} || coalesce(o.lefts, []) AS lefts, {rights} || coalesce(o.rights, []) AS rights, {inner} || coalesce(o.proof, '') AS proof"
            f" FROM t {joins} LEFT JOIN (SELECT * FROM t WHERE h IS NULL) o ON o.tree = t.tree AND o.bucket = t.bucket WHERE t.h IS NOT NULL"
        )
        if not leaves:
            return con.sql("SELECT * FROM found")
        node = "coalesce(other, h)"
        for k in range(1, con.execute("SELECT coalesce(max(len(lefts)), 0) FROM found").fetchall()[0][0] + 1):
            con.execute(f"CREATE OR REPLACE TEMP TABLE found AS SELECT * REPLACE (CASE WHEN len(lefts) >= {k} THEN sha256(lefts[{k}] || {node} || rights[{k}]) ELSE {node} END AS other) FROM found")
            node = "other"
        names = ", ".join(c for c in ["tree", "i", "n", "h", *kept] if c != "other")
        return con.sql(f"SELECT {names}, {node} AS other, sha256(proof) AS proof FROM found")

    names = [f"{c} {t}" for c, t in (("tree", "string"), ("i", "long"), ("n", "long"), ("h", "string"))]
    further = [c for c in keep.split(", ") if c and not (leaves and c == "other string")]
    return in_buckets(both, each, ", ".join([*names, *further, *(["other string", "proof string"] if leaves else [PROOF])]))


def rounds(work: Workspace, nodes: DataFrame, depth: int) -> list[DataFrame]:
    """nodes, then round by round the roots of buckets, down to a node a tree."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > 1:
        found.append(work.table(bucket_roots(found[-1], depth)))
    return found


def back(work: Workspace, found: list[DataFrame], outer: DataFrame, depth: int, keep: str = "", leaves: bool = False) -> DataFrame:
    """The first of `rounds` with proofs; outer: those of the single nodes, the last of them."""
    for k in range(len(found) - 2, -1, -1):
        outer = with_proofs(found[k], outer, keep if k == 0 else "", leaves and k == 0, depth)
        outer = outer if k == 0 else work.table(outer)
    if len(found) == 1:  # single nodes all
        outer = with_proofs(found[0], outer, keep, leaves, depth)
    return outer


def manifest(spark: SparkSession, docs: DataFrame, other: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """A row per document: doc_id, lang, leaf, subroot, root, proof_sha256, folded_root.

    other: the leaf to fold instead of a row's own, where it is not null. depth: levels of a bucket.
    """
    prepare(spark)
    work = Workspace(spark, "merkle")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, then bytewise
    rows = docs.select("doc_id", "lang", tree.alias("tree"), leaf_of().alias("h"), (F.lit(None) if other is None else other).cast("string").alias("other"))
    rows = work.table(rows)
    leaves = work.table(numbered(work, rows, ["doc_id", "h"], rows.count()))
    found = rounds(work, leaves.select("tree", "i", "n", "h"), depth)
    found[0] = leaves
    tops = found[-1].select("tree", F.col("h").alias("subroot"))
    trees = numbered(work, tops.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("subroot").alias("h")), ["own"], 1)
    trees = work.table(trees)
    above = rounds(work, trees.select("tree", "i", "n", "h"), depth)
    above[0] = trees
    root = above[-1].select("h").first()  # one digest
    none = spark.createDataFrame([("", 0, [], [], "")], f"tree string, i long, {PROOF}")
    subtrees = work.table(back(work, above, none, depth, "own string"))
    outer = subtrees.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("i"), "lefts", "rights", "proof")
    proved = back(work, found, outer, depth, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, other string", True)
    subroots = subtrees.select(F.col("own").alias("tree"), F.col("h").alias("subroot"), F.lit(root.h if root else None).alias("root"))
    return proved.join(subroots, "tree").select("doc_id", "lang", F.col("h").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("other").alias("folded_root"))


def audit(spark: SparkSession, docs: DataFrame, tampered: Column, depth: int = DEPTH) -> DataFrame:
    """manifest() with the rows where `tampered` holds folded from a text in lower case, and whether each still gives the root."""
    changed = F.when(tampered, leaf_of(text=F.translate("text", UPPER, LOWER)))
    out = manifest(spark, docs, changed, depth)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
