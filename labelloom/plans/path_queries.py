"""Queries of section B: readings of paths and names, scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import boxes, drift, metrics, paths

from .fixtures import ctes, view
from .register import query, rounded

_VISA = "CASE split_part(visa_path,'/',4) WHEN 'Anomaly' THEN {} WHEN 'Normal' THEN {} ELSE {} END"
_MVTEC = "CASE WHEN split_part(mvtec_path,'/',3)='good' THEN {} ELSE {} END"
_SPLIT = "replace(split_part(mvtec_path,'/',2),'validation','val')"


@query("B1_split_folders", f"{ctes('f_paths')} SELECT seq, split_part(mvtec_path,'/',1) AS category, {_SPLIT} AS split, {_MVTEC.format(repr('normal'), repr('defect'))} AS label, {_MVTEC.format(repr('none'), chr(39) + 'broken_large' + chr(39))} AS defect_type, false AS is_mask FROM f_paths")
def b1(spark, sf):
    return view(spark, sf, "f_paths").select("seq", paths.by_split_folders(F.col("mvtec_path")).alias("p")).select("seq", "p.*")


@query("B2_image_folders", f"{ctes('f_paths')} SELECT seq, split_part(visa_path,'/',1) AS category, 'unassigned' AS split, {_VISA.format(repr('defect'), repr('normal'), repr('unlabeled'))} AS label, {_VISA.format(repr('unspecified'), repr('none'), repr('none'))} AS defect_type, visa_path LIKE '%/Masks/%' AS is_mask FROM f_paths")
def b2(spark, sf):
    return view(spark, sf, "f_paths").select("seq", paths.by_image_folders(F.col("visa_path")).alias("p")).select("seq", "p.*")


@query("B3_class_folder", f"{ctes('f_paths')} SELECT seq, split_part(mvtec_path,'/',3) AS category, 'unassigned' AS split, {_MVTEC.format(repr('normal'), repr('defect'))} AS label, {_MVTEC.format(repr('none'), repr('broken_large'))} AS defect_type, false AS is_mask FROM f_paths")
def b3(spark, sf):
    return view(spark, sf, "f_paths").select("seq", paths.by_class_folder(F.col("mvtec_path")).alias("p")).select("seq", "p.*")


@query("B4_read_by_layout", f"""{ctes('f_paths')} SELECT seq, CASE seq % 3 WHEN 0 THEN split_part(mvtec_path,'/',1) WHEN 1 THEN split_part(mvtec_path,'/',3) ELSE 'unknown' END AS category,
CASE seq % 3 WHEN 0 THEN {_SPLIT} ELSE 'unassigned' END AS split, CASE WHEN seq % 3 = 2 THEN 'unlabeled' ELSE {_MVTEC.format(repr('normal'), repr('defect'))} END AS label FROM f_paths""")
def b4(spark, sf):
    df = view(spark, sf, "f_paths").withColumn("layout", F.element_at(F.array(F.lit("mvtec"), F.lit("flat"), F.lit("custom")), (F.col("seq") % 3 + 1).cast("int")))
    return df.select("seq", paths.read_path(F.col("mvtec_path"), F.col("layout")).alias("p")).select("seq", "p.category", "p.split", "p.label")


@query("B5_content_id", "SELECT doc_id, substr(sha1(text),1,16) AS image_id FROM documents")
def b5(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", paths.content_id(F.col("text")).alias("image_id"))


@query("B6_video_key", f"{ctes('f_manifest')} SELECT seq, concat(category, '-', source, '-clip-', substr(sha1,1,8)) AS video FROM f_manifest")
def b6(spark, sf):
    df = view(spark, sf, "f_manifest")
    return df.select("seq", paths.video_key(F.concat(F.lit("/in/ "), "category", F.lit(" ("), "source", F.lit(") clip!.mp4")), F.col("sha1")).alias("video"))


@query("B7_frame_number", f"{ctes('f_paths')} SELECT seq, CAST(seq % 97 AS BIGINT) AS frame FROM f_paths")
def b7(spark, sf):
    return view(spark, sf, "f_paths").select("seq", paths.frame_number(F.col("visa_path")).alias("frame"))


@query("B8_seconds", f"{ctes('f_frames')} SELECT image_seq, round(CASE WHEN video % 7 > 0 THEN pos / CAST(video % 7 AS DOUBLE) END, 6) AS seconds FROM f_frames")
def b8(spark, sf):
    return rounded(view(spark, sf, "f_frames").select("image_seq", paths.seconds(F.col("pos"), F.col("video") % 7).alias("seconds")))


@query("B9_split_name", f"{ctes('f_paths')} SELECT seq, CASE split_part(mvtec_path,'/',2) WHEN 'validation' THEN 'val' ELSE split_part(mvtec_path,'/',2) END AS split FROM f_paths")
def b9(spark, sf):
    return view(spark, sf, "f_paths").select("seq", paths.split_name(F.concat(F.lit(" "), F.upper(F.split("mvtec_path", "/")[1]))).alias("split"))


@query("B13_box_spec", f"{ctes('f_boxes')} SELECT image_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, label FROM f_boxes")
def b13(spark, sf):
    written = view(spark, sf, "f_boxes").groupBy(F.col("image_id").alias("id")).agg(F.concat_ws(";", F.collect_list(F.concat_ws(",", "x", "y", "w", "h", "label"))).alias("spec"))
    return boxes.parse_spec(written).select(F.col("id").alias("image_id"), *[F.col(c).cast("long").alias(c) for c in "xywh"], "label")


@query("B14_box_corners", f"{ctes('f_boxes')} SELECT seq, CAST(w*h AS BIGINT) AS area, CAST(x AS BIGINT) AS x0, CAST(y AS BIGINT) AS y0, CAST(x+w AS BIGINT) AS x1, CAST(y+h AS BIGINT) AS y1 FROM f_boxes")
def b14(spark, sf):
    return boxes.corners(view(spark, sf, "f_boxes")).select(*[F.col(c).cast("long").alias(c) for c in ("seq", "area", "x0", "y0", "x1", "y1")])


@query("B15_thresholds", f"{ctes('f_inference_log')} SELECT seq, round(CASE WHEN seq % 3 = 0 THEN 50.0 ELSE score END, 6) AS threshold, CAST(CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n FROM f_inference_log")
def b15(spark, sf):
    text = F.when(F.col("seq") % 3 == 0, F.lit('{"broken')).otherwise(F.concat(F.lit('{"'), "category", F.lit('": '), "score", F.lit(', "other": "none"}')))
    df = view(spark, sf, "f_inference_log").withColumn("map", paths.thresholds_of(text))
    return rounded(df.select("seq", paths.threshold_for(F.col("map"), F.col("category"), F.col("threshold")).alias("threshold"), F.size("map").alias("n")))


@query("B16_threshold_of_row", f"{ctes('f_eval')} SELECT id, CASE category WHEN 'en' THEN 900.0 WHEN 'de' THEN 1500.0 ELSE 2000.0 END AS threshold FROM f_eval")
def b16(spark, sf):
    per = F.create_map(F.lit("en"), F.lit(900.0), F.lit("de"), F.lit(1500.0))
    return view(spark, sf, "f_eval").select("id", paths.threshold_for(per, F.col("category"), F.lit(2000.0)).alias("threshold"))


@query("B17_decision", f"{ctes('f_inference_log')} SELECT seq, decision FROM f_inference_log")
def b17(spark, sf):
    return view(spark, sf, "f_inference_log").select("seq", paths.decision(F.col("score"), F.col("threshold")).alias("decision"))


_RATES = f"""{ctes('f_runs')}, r AS (SELECT seq, recall, prec / 2 AS alarm, CAST(fn + 1 AS DOUBLE) / 100 AS p FROM f_runs)
SELECT seq, round(CASE WHEN recall*p + alarm*(1-p) > 0 THEN recall*p / (recall*p + alarm*(1-p)) ELSE 0 END, 6) AS value FROM r WHERE recall IS NOT NULL"""


def _rated(spark, sf, f):
    df = view(spark, sf, "f_runs").where("recall is not null")
    return rounded(df.select("seq", f(F.col("recall").cast("double"), F.col("prec").cast("double") / 2, (F.col("fn") + 1).cast("double") / 100).alias("value")))


@query("B23_precision_at_prevalence", _RATES)
def b23(spark, sf):
    return _rated(spark, sf, metrics.precision_at)


@query("B24_review_load", f"{ctes('f_runs')} SELECT seq, round(recall*(CAST(fn+1 AS DOUBLE)/100) + prec/2*(1-CAST(fn+1 AS DOUBLE)/100), 6) AS value FROM f_runs WHERE recall IS NOT NULL")
def b24(spark, sf):
    return _rated(spark, sf, metrics.review_load)


@query("B25_drift_level", f"{ctes('f_features')} SELECT id, feature, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 'insufficient' WHEN value > 0.25 THEN 'changed' WHEN value > 0.1 THEN 'watch' ELSE 'stable' END AS level FROM f_features")
def b25(spark, sf):
    return view(spark, sf, "f_features").select("id", "feature", drift.level(F.col("value")).alias("level"))


@query("B29_relative_path", f"{ctes('f_paths')} SELECT seq, CASE WHEN seq % 2 = 0 THEN visa_path ELSE concat('/else/', visa_path) END AS kept, CASE WHEN seq % 2 = 0 THEN concat('/data/', visa_path) ELSE concat('/else/', visa_path) END AS whole FROM f_paths")
def b29(spark, sf):
    whole = F.concat(F.when(F.col("seq") % 2 == 0, "/data/").otherwise("/else/"), "visa_path")
    kept = paths.relative_to(whole, "/data")
    return view(spark, sf, "f_paths").select("seq", kept.alias("kept"), paths.absolute(kept, "/data").alias("whole"))
