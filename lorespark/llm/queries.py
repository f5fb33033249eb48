"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, compression_bands, decontamination, embedding_dedup, hard_negatives, html_wrappers, license_scan, line_dedup, merkle_manifest, mixing, quality_classifier, sharding, simhash_dedup
from .common import read

RANKS = "byte_bpe_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.classify(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(spark, read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.screen(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_wrappers.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(), with_ids=False)
    return out.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.matches(spark, docs, read(spark, sf_dir, "benchmark")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest.audit(spark, read(spark, sf_dir, "documents"), tampered).drop("lang")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(spark, read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_classifier, op2_embedding_dedup, op3_line_dedup, op4_mixing, op5_sharding, op6_compression_bands, op7_html_extraction, op8_simhash_dedup, op9_byte_bpe, op10_license_scan)
    own += (op11_decontamination, op12_merkle_manifest, op13_hard_negatives)
    return {f.__name__: f for f in own}


#: The documents' keys in DuckDB: stripped of ASCII white space, A-Z in lower case.
_KEY = "translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, line, {_KEY} AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id < r.last_doc AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: A-Z in lower case, then runs of digits, letters and characters beyond ASCII.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH items AS (
  SELECT cast(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS id, doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents
), grams AS (
  SELECT id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT id, p, k, item FROM grams JOIN windows USING (k, g)
), hits AS (
  SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT id, p, k FROM found)) GROUP BY id
), named AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM found) GROUP BY id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (id) LEFT JOIN named USING (id)
"""


#: CRC-32 of a decimal doc_id, a byte and a bit at a time.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda ch: cast(ascii(ch) AS BIGINT))),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, k: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
)


def _merkle_sql(levels: int = 8, tops: int = 3) -> str:
    """Trees of up to 8 ** levels leaves, and up to 8 ** tops languages."""
    coded = "coalesce(strlen(cast({0} AS VARCHAR)) || ':' || {0}, '-')"
    leaf = "sha256({})".format(" || ".join(coded.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    other = leaf.replace(coded.format("text"), coded.format(_LOWER.format("text")))
    parts = [
        f"l0 AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS tree, {leaf} AS h, CASE WHEN {_CRC} % 3 = 0 THEN {other} ELSE {leaf} END AS x FROM documents)",
        "r_0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, id) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l0)",
    ]

    def climb(name: str, key: str, n_levels: int) -> str:
        """From the nodes name_0 (key, i, h, n): the runs of each level, with their digests in order; and the name of the last nodes."""
        for k in range(1, n_levels + 1):
            parts.append(f"{name}{k} AS (SELECT {key}, i // 8 AS run, string_agg(h, '' ORDER BY i) AS s, any_value(n) AS n FROM {name}_{k - 1} WHERE n > 1 GROUP BY {key}, run)")
            parts.append(f"{name}_{k} AS (SELECT {key}, run AS i, sha256(s) AS h, (n + 7) // 8 AS n FROM {name}{k} UNION ALL SELECT {key}, i, h, n FROM {name}_{k - 1} WHERE n = 1)")
        return f"{name}_{n_levels}"

    top = climb("r", "tree", levels)
    parts.append(f"t_0 AS (SELECT 0 AS one, tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM {top})")
    root = climb("t", "one", tops)
    runs, joins = [], []
    for name, key, n_levels in (("r", "tree", levels), ("t", "one", tops)):
        for k in range(1, n_levels + 1):
            at = f"{name}_0.i // {8 ** (k - 1)} % 8"
            runs.append((f"{name}{k}", f"substr({name}{k}.s, 1, 64 * ({at}))", f"substr({name}{k}.s, 64 * ({at}) + 65)"))
            joins.append(f"LEFT JOIN {name}{k} ON {name}{k}.{key} = {name}_0.{key} AND {name}{k}.run = {name}_0.i // {8**k}")
    proof = " || ".join(f"coalesce({left} || {right}, '')" for _, left, right in runs)
    sides = ", ".join(f"{left} AS {run}l, {right} AS {run}r" for run, left, right in runs)
    parts.append(f"f AS (SELECT r_0.doc_id, r_0.h AS leaf, r_0.x, t_0.h AS subroot, {root}.h AS root, sha256({proof}) AS proof_sha256, {sides} FROM r_0 JOIN t_0 ON t_0.tree = r_0.tree JOIN {root} ON true {' '.join(joins)})")
    at = "f"
    for run, _, _ in runs:
        parts.append(f"f{run} AS (SELECT * REPLACE (CASE WHEN {run}l IS NULL THEN x ELSE sha256({run}l || x || {run}r) END AS x) FROM {at})")
        at = f"f{run}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM {at}"


OP13_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: cast(floor(cast(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, cast(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op11_decontamination": OP11_SQL, "op12_merkle_manifest": _merkle_sql(), "op13_hard_negatives": OP13_SQL}
