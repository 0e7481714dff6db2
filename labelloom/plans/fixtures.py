"""Stand-in tables: views over the given tables with the columns of the engine's own tables.

The SQL of a view is the same for Spark and DuckDB but where ``DUCKDB`` has one of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "f_manifest": """
SELECT d.doc_id AS seq, substr(sha1(d.text),1,16) AS image_id, sha1(d.text) AS sha1, d.source AS source, d.lang AS category,
  CASE WHEN l.toxic=1 THEN 'defect' WHEN l.toxic=0 THEN 'normal' ELSE 'unlabeled' END AS label,
  CASE WHEN l.toxic=1 THEN CASE CAST(d.doc_id % 5 AS INT) WHEN 0 THEN 'scratch_head' WHEN 1 THEN 'broken_large' WHEN 2 THEN 'glue' WHEN 3 THEN 'mystery' ELSE 'unspecified' END ELSE 'none' END AS defect_type,
  CASE WHEN d.doc_id % 3 = 0 THEN concat('vid-',d.source) ELSE '' END AS grp,
  32 + d.n_chars % 900 AS width, 32 + (d.n_chars*7) % 700 AS height, 3 AS channels, d.n_chars AS filesize,
  CAST(d.n_chars % 250 AS DOUBLE) AS blur_score, CAST(d.n_chars % 256 AS DOUBLE) AS brightness,
  1704067200 + d.doc_id AS ingested_epoch, 'unassigned' AS split
FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id
""",
    "f_label_events": """
SELECT e.event_id AS seq, e.event_id % (SELECT count(*) FROM documents) AS image_seq,
  CASE e.event_type WHEN 'error' THEN 'defect' WHEN 'signup' THEN 'defect' WHEN 'click' THEN 'normal' WHEN 'purchase' THEN 'normal' ELSE 'unlabeled' END AS label,
  CASE e.event_type WHEN 'error' THEN 'scratch' WHEN 'signup' THEN 'poke' ELSE 'none' END AS defect_type,
  e.user_id % 2 = 0 AS verified, concat('user-',CAST(e.user_id AS VARCHAR(20))) AS labeled_by, e.ts AS labeled_at,
  CASE WHEN e.event_type IN ('error','signup') AND e.user_id % 3 = 0 THEN e.user_id % 50 END AS roi_x, CASE WHEN e.event_type IN ('error','signup') AND e.user_id % 3 = 0 THEN e.user_id % 40 END AS roi_y,
  CASE WHEN e.event_type IN ('error','signup') AND e.user_id % 3 = 0 THEN 8 + e.user_id % 9 END AS roi_w, CASE WHEN e.event_type IN ('error','signup') AND e.user_id % 3 = 0 THEN 8 + e.user_id % 7 END AS roi_h
FROM events e
""",
    "f_splits": """
SELECT doc_id AS seq, CASE doc_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 9 <> 0
""",
    "f_inference_log": """
SELECT e.event_id AS seq, e.ts AS logged_at, concat('v00',CAST(1 + e.event_id % 3 AS VARCHAR(20))) AS version, e.event_id % (SELECT count(*) FROM documents) AS image_seq,
  e.event_type AS category, concat('u',CAST(e.user_id AS VARCHAR(20))) AS grp, e.value AS score, CAST(50.0 AS DOUBLE) AS threshold,
  CASE WHEN e.value >= 50.0 THEN 'defect' ELSE 'normal' END AS decision, e.props AS props
FROM events e
""",
    "f_eval": """
SELECT d.doc_id AS id, d.lang AS category, l.toxic AS y, CAST(d.n_chars AS DOUBLE) AS score
FROM documents d JOIN labels l ON d.doc_id=l.doc_id
""",
    "f_eval_big": """
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS id, p.p_brand AS category,
  CASE WHEN l.l_returnflag='R' THEN 1 ELSE 0 END AS y, CAST(l.l_quantity AS DOUBLE) + CAST(floor(l.l_extendedprice) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS score
FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey
""",
    "f_frames": """
SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id AS image_seq,
  event_type IN ('error','signup') AS truth, value >= 50.0 AS predicted, value AS score
FROM events
""",
    "f_boxes": """
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS seq, l_orderkey AS image_id,
  l_partkey % 500 AS x, l_suppkey AS y, CAST(l_quantity AS INT) - 1 AS w, l_linenumber * 3 AS h,
  CASE WHEN l_returnflag='N' THEN 'unspecified' WHEN l_returnflag='R' THEN 'scratch' ELSE 'dent' END AS label
FROM lineitem
""",
    "f_images": """
SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 200 + o_custkey % 800 END AS width, 200 + o_custkey % 600 AS height,
  concat('raw/',CAST(o_orderkey AS VARCHAR(20)),'.jpg') AS path FROM orders
""",
    "f_cells": """
SELECT DISTINCT l_suppkey AS image_id, l_partkey % 24 AS cy, l_orderkey % 24 AS cx FROM lineitem WHERE l_returnflag='R' 
""",
    "f_score_map": """
SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,l_linenumber,l_partkey,l_extendedprice) AS pos,
  l_extendedprice AS score, l_quantity >= 45 AS truth FROM lineitem
""",
    "f_registry": """
SELECT o_custkey AS project, o_orderkey AS seq, concat('v',lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR(20)),3,'0')) AS version,
  CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'candidate' ELSE 'archived' END AS status,
  CASE WHEN o_orderstatus='O' THEN NULL ELSE o_orderdate END AS promoted_at, 0.8 + (o_orderkey % 20)/100.0 AS recall, 0.5 + (o_orderkey % 50)/100.0 AS prec
FROM orders
""",
    "f_runs": """
SELECT o_orderkey AS seq, concat('run-',CAST(o_orderkey AS VARCHAR(20))) AS run_id, o_orderpriority AS kind, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(70 + o_orderkey % 30 AS DOUBLE) / 100 END AS recall, CAST(50 + o_orderkey % 50 AS DOUBLE) / 100 AS prec, o_orderkey % 7 AS fn FROM orders
""",
    "f_reviews": """
SELECT turn AS seq, conv_id AS image_seq, CASE WHEN role='assistant' THEN 'ok' WHEN role='user' THEN 'error' ELSE 'refusal' END AS status,
  length(text) AS input_tokens, turn % 2 = 0 AS defect FROM conversations
""",
    "f_paths": """
SELECT doc_id AS seq, concat(lang,'/Data/',CASE WHEN doc_id % 7 = 0 THEN 'Masks' ELSE 'Images' END,'/',CASE WHEN doc_id % 4 = 0 THEN 'Anomaly' WHEN doc_id % 4 = 1 THEN 'Extra' ELSE 'Normal' END,'/',lpad(CAST(doc_id % 97 AS VARCHAR(20)),4,'0'),'.JPG') AS visa_path,
  concat(lang,'/',CASE WHEN doc_id % 5 = 0 THEN 'validation' WHEN doc_id % 5 < 3 THEN 'train' ELSE 'test' END,'/',CASE WHEN doc_id % 3 = 0 THEN 'broken_large' ELSE 'good' END,'/',lpad(CAST(doc_id AS VARCHAR(20)),4,'0'),'.png') AS mvtec_path
FROM documents
""",
    "f_features": """
SELECT vec_id AS id, CASE WHEN label < 5 THEN 'ref' ELSE 'cand' END AS side,
  concat('f',lpad(CAST(pos AS STRING),2,'0')) AS feature, CAST(v AS DOUBLE) AS value
FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, v
""",
    "f_clips": """
SELECT vec_id div 20 AS video, vec_id * 32 + j AS pos, transform(embedding, v -> (128 + 200 * CAST(v AS DOUBLE)) / 255 + CAST(j AS DOUBLE) * CAST(0.004 AS DOUBLE)) AS cells
FROM embeddings LATERAL VIEW explode(sequence(0, CAST(vec_id % 30 AS INT))) t AS j
""",
    "f_pixels": """
SELECT vec_id AS image_id, CAST(vec_id div 20 AS INT) AS video, CAST(pos div 8 AS INT) AS gy, CAST(pos % 8 AS INT) AS gx,
  CAST(128 + 200 * CAST(v AS DOUBLE) AS DOUBLE) AS value
FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, v
""",
}
DUCKDB = {
    "f_clips": """
SELECT vec_id // 20 AS video, vec_id * 32 + j AS pos, list_transform(embedding, lambda v: (128 + 200 * CAST(v AS DOUBLE)) / 255 + CAST(j AS DOUBLE) * CAST(0.004 AS DOUBLE)) AS cells
FROM embeddings, LATERAL (SELECT unnest(range(0, vec_id % 30 + 1)) AS j)
""",
    "f_features": """
SELECT vec_id AS id, CASE WHEN label < 5 THEN 'ref' ELSE 'cand' END AS side,
  concat('f',lpad(CAST(pos-1 AS VARCHAR),2,'0')) AS feature, CAST(embedding[pos] AS DOUBLE) AS value
FROM embeddings, unnest(range(1,65)) AS t(pos)
""",
    "f_pixels": """
SELECT vec_id AS image_id, CAST(vec_id // 20 AS INT) AS video, CAST((pos-1)//8 AS INT) AS gy, CAST((pos-1)%8 AS INT) AS gx,
  128 + 200 * CAST(embedding[pos] AS DOUBLE) AS value
FROM embeddings, unnest(range(1,65)) AS t(pos)
""",
}

_TABLE = re.compile(r"\b(FROM|JOIN) ([a-z]+)\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table as a DataFrame; only the columns that a query uses are scanned."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {m[1] for m in _TABLE.findall(sql)}}
    return spark.sql(_TABLE.sub(r"\1 {\2}", sql), **tables)


def ctes(*names: str) -> str:
    """The views as a WITH list for DuckDB, to be followed by a comma or a SELECT."""
    return "WITH " + ",\n".join(f"{n} AS ({DUCKDB.get(n, VIEWS[n])})" for n in names)


#: The frames that move, frame after frame: what is kept depends on the last kept one, so the recursion carries it.
MOVING = ctes("f_clips").replace("WITH f_clips AS", "WITH RECURSIVE f_clips AS MATERIALIZED") + """, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video ORDER BY pos) AS k FROM f_clips),
r AS (SELECT video, k, pos, cells, 0 AS drops, true AS keep FROM n WHERE k = 1
  UNION ALL SELECT video, k, pos, CASE WHEN keep THEN now ELSE cells END, CASE WHEN keep THEN 0 ELSE drops + 1 END, keep FROM (
    SELECT n.video, n.k, n.pos, n.cells AS now, r.cells, r.drops,
      r.drops >= 20 OR len(list_filter(list_zip(n.cells, r.cells), lambda z: abs(z[1] - z[2]) > 0.05)) >= 0.005 * len(n.cells) AS keep FROM r JOIN n ON n.video = r.video AND n.k = r.k + 1))
SELECT video, pos FROM r WHERE keep"""
