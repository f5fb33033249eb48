"""Derived views that stand for the knowledge base's tables; their SQL runs unchanged in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AS_OF = "2024-12-31"

VIEWS = {
    "fx_page": """
SELECT d.doc_id AS page_no, concat('01', lpad(cast(d.doc_id AS string), 24, '0')) AS id, concat('Topic ', cast(d.doc_id AS string)) AS title,
       concat('topic-', cast(d.doc_id AS string)) AS slug,
       CASE d.doc_id % 10 WHEN 0 THEN 'tech' WHEN 1 THEN 'finance' WHEN 2 THEN 'health' WHEN 3 THEN 'research' WHEN 4 THEN 'personal'
            WHEN 5 THEN 'creative' WHEN 6 THEN 'business' WHEN 7 THEN 'spiritual' WHEN 8 THEN 'reminder' ELSE 'misc' END AS domain,
       CASE WHEN d.doc_id % 6 = 0 THEN 0 ELSE d.doc_id % 4 END AS n_sources, date '2024-12-31' - cast(d.doc_id % 200 AS int) AS updated,
       d.doc_id % 23 = 0 AS archived,
       concat('# Topic ', cast(d.doc_id AS string), chr(10), chr(10), d.text, chr(10), chr(10),
              CASE WHEN d.doc_id % 3 = 0 THEN concat('## Notes', chr(10), chr(10)) ELSE '' END,
              CASE WHEN d.doc_id % 5 = 4 THEN '' ELSE concat('See [[Topic ', cast((d.doc_id * 7 + 3) % m.k AS string), ']] and [[topic ',
                cast((d.doc_id * 13 + 5) % m.k AS string), ']] and [[Topic ', cast(d.doc_id % 40 + m.n AS string), ']].') END) AS body
FROM documents d CROSS JOIN (SELECT count(*) AS n, cast(floor(count(*) * 1.25) AS bigint) AS k FROM documents) m""",
    "fx_entity": """
SELECT p_partkey AS entity_id, p_name AS canonical,
       CASE p_size % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'project' WHEN 2 THEN 'system' WHEN 3 THEN 'organization' ELSE 'concept' END AS type,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey END AS page_id FROM part
UNION ALL SELECT s_suppkey + 1000000000000, s_name, 'organization', CAST(NULL AS BIGINT) FROM supplier""",
    "fx_alias": "SELECT p_partkey AS entity_id, concat(p_brand, ' ', p_type) AS alias FROM part",
    "fx_mention": "SELECT l_partkey AS entity_id, l_orderkey AS page_id, l_returnflag AS source_id FROM lineitem",
    "fx_shared": "SELECT l_orderkey AS entity_id, l_suppkey AS page_id FROM lineitem",
    "fx_claim": """
SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_partkey AS page_id, l_suppkey AS source_id, cast(1.0 - l_discount AS double) AS confidence,
       cast(l_shipdate AS date) AS valid_from, CASE WHEN l_returnflag = 'R' THEN cast(l_shipdate AS date) + 30 END AS valid_to,
       CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber % 7 + 1 END AS superseded_by FROM lineitem""",
    "fx_chunk": """
SELECT vec_id AS chunk_id, vec_id % 40 AS source_no, vec_id % 7 AS section_no, label,
       CASE WHEN vec_id % 4 = 0 THEN NULL ELSE concat('Topic ', cast(vec_id % 40 AS string)) END AS page_title, embedding FROM embeddings""",
    "fx_trace": """
SELECT event_id AS id, user_id AS run_id, event_type AS task, concat('model-', cast(user_id % 4 AS string)) AS model, ts AS started_at,
       value AS latency_ms, value * 0.000001 AS cost_usd, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events""",
    "fx_curiosity": "SELECT event_id, ts, event_type AS domain, concat('tag', cast(user_id % 20 AS string)) AS tag FROM events",
    "fx_index": "SELECT doc_id AS pos, concat('Topic ', cast(doc_id AS string)) AS title, text AS summary FROM documents",
    "fx_run": """
SELECT event_id AS id, ts AS run_at, event_type AS eval_type, user_id % 10 / 10.0D AS score, CASE user_id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS grade,
       user_id % 2 = 0 AS enriched, cast(floor(value) AS bigint) % 5 + 1 AS chunk_count, value FROM events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a derived view over base tables."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in BASE if re.search(rf"\b{t}\b", VIEWS[name])]
    sql = VIEWS[name]
    for t in used:
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """Oracle SQL with the views that it names as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    made = ", ".join(f"{v} AS ({VIEWS[v].replace('10.0D', '10.0::double').strip()})" for v in used)
    if not used:
        return sql
    body = sql.strip()
    return f"WITH {made}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {made} {body}"
