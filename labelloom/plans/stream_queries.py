"""Queries of sections A and N: sources, exports and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import tables
from labelloom.sources import tables as sources
from labelloom.sources.scratch import scratch
from labelloom.streaming import streams

from .fixtures import MOVING, ctes, view
from .register import query, rounded

_DEFECT = "event_type IN ('error','signup')"


@query("A3_import_outcomes", f"""{ctes('f_paths', 'f_manifest')}, l AS (SELECT p.seq, m.sha1, p.visa_path LIKE '%/Masks/%' AS mask FROM f_paths p JOIN f_manifest m USING (seq)), f AS (SELECT sha1, min(seq) AS first FROM l WHERE NOT mask GROUP BY 1)
SELECT CASE WHEN mask THEN 'mask' WHEN seq > first OR sha1 IN (SELECT sha1 FROM f_manifest WHERE seq % 4 = 0) THEN 'duplicate' ELSE 'added' END AS outcome, count(*) AS n FROM l LEFT JOIN f USING (sha1) GROUP BY 1""")
def a3(spark, sf):
    from labelloom.operators import paths

    stored = view(spark, sf, "f_manifest").select("seq", "sha1")
    listing = view(spark, sf, "f_paths").select("seq", paths.by_image_folders(F.col("visa_path"))["is_mask"].alias("is_mask")).join(stored.hint("merge"), "seq")
    return sources.import_outcomes(listing, stored.where("seq % 4 = 0")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("A8_said_true", "SELECT event_id, user_id % 2 = 0 AS verified FROM events")
def a8(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    return df.select("event_id", sources.said_true(F.when(F.col("user_id") % 2 == 0, " Yes").otherwise("no")).alias("verified"))


@query("A10_append_by_day", f"{ctes('f_inference_log')} SELECT CAST(CAST(logged_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM f_inference_log GROUP BY 1")
def a10(spark, sf):
    log, path = view(spark, sf, "f_inference_log"), scratch(spark, "log")
    sources.append_by_day(log.where("seq % 2 = 0"), "logged_at", path)
    sources.append_by_day(log.where("seq % 2 = 1"), "logged_at", path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("A11_conformed_log", f"{ctes('f_inference_log')} SELECT seq, round(CASE WHEN seq % 5 = 0 THEN NULL ELSE score END, 6) AS score, CAST(NULL AS VARCHAR) AS note FROM f_inference_log")
def a11(spark, sf):
    raw = view(spark, sf, "f_inference_log").select("seq", F.when(F.col("seq") % 5 == 0, "bad").otherwise(F.col("score").cast("string")).alias("score"))
    return rounded(sources.conformed(raw, spark.createDataFrame([], "seq long, score double, note string").schema))


@query("A12_evolved_log", f"{ctes('f_inference_log')} SELECT seq, CASE WHEN seq % 2 = 0 THEN NULL ELSE grp END AS grp, CAST(NULL AS VARCHAR) AS note FROM f_inference_log")
def a12(spark, sf):
    log, path = view(spark, sf, "f_inference_log").select("seq", "grp"), scratch(spark, "log")
    log.where("seq % 2 = 0").select("seq").write.parquet(path)  # files of the first generation know no group
    log.where("seq % 2 = 1").write.mode("append").parquet(path)
    return sources.grown(spark, path, spark.createDataFrame([], "seq long, grp string, note string").schema)


@query("A16_run_history", f"{ctes('f_runs')} SELECT seq, run_id FROM f_runs")
def a16(spark, sf):
    return view(spark, sf, "f_runs").orderBy(F.desc("created_at"), F.desc("seq")).select("seq", "run_id")


_COCO = f"""{ctes('f_boxes', 'f_images')}, u AS (SELECT *, row_number() OVER (ORDER BY image_id) AS id FROM f_images WHERE image_id IN (SELECT image_id FROM f_boxes)), k AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT DISTINCT label FROM f_boxes))"""


def _coco(spark, sf):
    return sources.coco(view(spark, sf, "f_boxes"), view(spark, sf, "f_images"))


@query("A17_coco_annotations", f"{_COCO} SELECT row_number() OVER (ORDER BY u.id, seq) AS id, u.id AS image_id, k.id AS category_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST(w*h AS BIGINT) AS area, 0 AS iscrowd FROM f_boxes b JOIN u USING (image_id) JOIN k ON k.label = b.label")
def a17(spark, sf):
    box = [F.col("bbox")[i].cast("long").alias(c) for i, c in enumerate("xywh")]
    return _coco(spark, sf)[1].select("id", "image_id", "category_id", *box, F.col("area").cast("long").alias("area"), "iscrowd")


@query("A17_coco_images", f"{_COCO} SELECT id, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, path AS file_name FROM u")
def a17_images(spark, sf):
    return _coco(spark, sf)[0].select("id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "file_name")


@query("A17_coco_categories", f"{_COCO} SELECT id, label AS name FROM k")
def a17_categories(spark, sf):
    return rounded(_coco(spark, sf)[2])


_LAID = "SELECT concat('n', s_nationkey, '/', s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' WHEN 3 THEN '.Mp4' ELSE '.avi' END) AS path, strlen(s_name) AS length FROM supplier"


def _laid(spark, sf):
    """A file for each supplier, by nation, of images, videos and others: the folder."""
    root = scratch(spark, "files")
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    suffix = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".txt", ".Mp4", ".avi"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"), suffix).alias("path"), F.col("s_name").cast("binary").alias("content"))
    sources.laid_out(rows, root).agg(F.sum("length")).first()  # written here
    return root


def _name():
    return F.regexp_extract("path", r"/(n[0-9]+/[^/]+)$", 1)


@query("A1_image_files", f"WITH l AS ({_LAID}) SELECT path, length FROM l WHERE lower(path) LIKE '%.jpg' OR path LIKE '%.png'")
def a1(spark, sf):
    return sources.files(spark, [_laid(spark, sf)]).orderBy("path").select(_name().alias("path"), "length")


@query("A2_image_count", f"WITH l AS ({_LAID}) SELECT split_part(path, '/', 1) AS folder, count(*) AS n FROM l WHERE lower(path) LIKE '%.jpg' OR path LIKE '%.png' GROUP BY 1")
def a2(spark, sf):
    return sources.files(spark, [_laid(spark, sf)]).groupBy(F.split(_name(), "/")[0].alias("folder")).agg(F.count("*").alias("n"))


@query("A22_video_files", f"WITH l AS ({_LAID}), v AS (SELECT * FROM l WHERE lower(path) LIKE '%.mp4' OR path LIKE '%.avi') SELECT path, length FROM v ORDER BY NOT starts_with(path, 'n3/'), path LIMIT 25")
def a22(spark, sf):
    root = _laid(spark, sf)
    inner = f"{root}/n3" if spark.read.parquet(f"{sf}/supplier.parquet").where("s_nationkey = 3").head(1) else root
    return sources.videos(spark, [inner, root], 25).select(_name().alias("path"), "length")


@query("A19_export_rows")
def a19(spark, sf):
    from .table_queries import split_images

    path = scratch(spark, "export")
    tables.export_outcomes(split_images(spark, sf), view(spark, sf, "f_boxes")).where("reason = 'exported'").write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).select("image_id", "split", "label")


@query("A20_json_rows")
def a20(spark, sf):
    return tables.json_rows(view(spark, sf, "f_inference_log").select("seq", "version", "score"))


def _images(spark, sf):
    """How many images events speak of: all documents."""
    return spark.read.parquet(f"{sf}/documents.parquet").count()


def _events(spark, sf):
    """The event stream; its times have no zone, and a watermark needs one."""
    return streams.read(spark, sf, "events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


@query("N1_latest_labels", f"{ctes('f_label_events')} SELECT image_seq, max(seq) AS seq, arg_max(label, seq) AS label, arg_max(verified, seq) AS verified FROM f_label_events GROUP BY 1")
def n1(spark, sf):
    label = F.when(F.expr(_DEFECT), "defect").when(F.col("event_type").isin("click", "purchase"), "normal").otherwise("unlabeled")
    return streams.latest_labels(_events(spark, sf).select(F.col("event_id").alias("seq"), (F.col("event_id") % _images(spark, sf)).alias("image_seq"), label.alias("label"), (F.col("user_id") % 2 == 0).alias("verified")))


@query("N2_new_contents", "SELECT DISTINCT sha1(text) AS sha1 FROM documents")
def n2(spark, sf):
    docs = streams.read(spark, sf, "documents.parquet").select(F.sha1("text").alias("sha1"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 86400).alias("ingested_at"))
    return streams.drained(streams.new_contents(docs, "ingested_at"), "contents").select("sha1")


@query("N3_daily_counts", f"""WITH f AS (SELECT date_trunc('day', ts) AS d, {_DEFECT} AS y, value >= 50 AS p FROM events), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events)
SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM f, m WHERE d + INTERVAL 1 DAY <= w GROUP BY 1""")
def n3(spark, sf):
    rows = _events(spark, sf).select("at", F.expr(_DEFECT).cast("int").alias("y_true"), (F.col("value") >= 50).cast("int").alias("y_pred"))
    return streams.drained(streams.daily_counts(rows, "at"), "daily").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("N4_alarm_sessions", """WITH a AS (SELECT user_id AS video, ts FROM events WHERE value >= 50), b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY video ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM a),
s AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b), g AS (SELECT video, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS frames FROM s GROUP BY video, k)
SELECT video, CAST(epoch_us(start) AS BIGINT) AS start, CAST(epoch_us("end") AS BIGINT) AS "end", frames FROM g WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM a)""")
def n4(spark, sf):
    alarms = _events(spark, sf).where("value >= 50").select(F.col("user_id").alias("video"), "at")
    got = streams.drained(streams.alarm_sessions(alarms, "video", "at", "1 hour"), "sessions")
    return got.select("video", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "frames")


@query("N5_moving_frames", MOVING)
def n5(spark, sf):
    vectors = streams.read(spark, sf, "embeddings.parquet")
    cells = F.transform("embedding", lambda v: (128 + 200 * v.cast("double")) / 255 + F.col("j").cast("double") * F.lit(0.004))
    rows = vectors.select("*", F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 30).cast("int"))).alias("j"))
    return streams.moving_frames(rows.select(F.floor(F.col("vec_id") / 20).cast("long").alias("video"), (F.col("vec_id") * 32 + F.col("j")).alias("pos"), cells.alias("cells")))


@query("N6_feedback", f"{ctes('f_inference_log', 'f_label_events')}, t AS (SELECT image_seq, arg_max(label, seq) AS label, arg_max(verified, seq) AS v FROM f_label_events GROUP BY 1) SELECT l.seq, CAST(label='defect' AS INT)::BIGINT AS y_true, CAST(decision='defect' AS INT)::BIGINT AS y_pred FROM f_inference_log l JOIN t USING (image_seq) WHERE v AND label <> 'unlabeled'")
def n6(spark, sf):
    from labelloom.operators import labels

    truth = labels.latest(view(spark, sf, "f_label_events"), "image_seq").where("verified and label <> 'unlabeled'")
    log = _events(spark, sf).select(F.col("event_id").alias("seq"), (F.col("event_id") % _images(spark, sf)).alias("image_seq"), F.when(F.col("value") >= 50, "defect").otherwise("normal").alias("decision"))
    return rounded(streams.drained(streams.feedback(log, truth), "feedback"))
