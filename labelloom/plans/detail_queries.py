"""Queries of what other queries only go through: table reads and writes, parts of reports, one step of a measure."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelloom.operators import boxes, drift, labels, metrics, paths, registry, segments
from labelloom.sources import tables as files
from labelloom.sources.scratch import scratch

from .fixtures import ctes, view
from . import grid_queries, model_queries, stream_queries  # noqa: F401 - their SQL is built on below
from .queries import _ALLOC, _BASE, _COUNTS, _FEEDBACK, _Q60, _RATES, _RESOLVED, _RUNS, _sides, fed_back, resolved
from .register import ORACLES, query, rounded
from .table_queries import _OUT, _SPLIT, split_manifest

M = ctes("f_manifest")


# --- tables read and written ------------------------------------------------------

@query("A4_folder_preview", f"""{ctes('f_paths')} SELECT mvtec_path AS path, split_part(mvtec_path,'/',1) AS category, replace(split_part(mvtec_path,'/',2),'validation','val') AS split,
CASE WHEN split_part(mvtec_path,'/',3)='good' THEN 'normal' ELSE 'defect' END AS label FROM f_paths ORDER BY mvtec_path LIMIT 10""")
def a4(spark, sf):
    got = labels.preview(view(spark, sf, "f_paths"), "mvtec_path", paths.read_path(F.col("mvtec_path"), F.lit("mvtec")))
    return got.select("path", "category", "split", "label")


@query("A5_batch_upload", """WITH b AS (SELECT doc_id AS seq, sha1(text) AS sha1, lang, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 3 = 0)
SELECT seq, concat(lang,'/',substr(sha1,1,16),'.png') AS path FROM b WHERE k=1 AND sha1 NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 <> 0)""")
def a5(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq"), F.col("lang").alias("category"), "text")
    named = files.uploaded(docs, "text").drop("text")
    return labels.append_new(named.where("seq % 3 <> 0"), named.where("seq % 3 = 0")).select("seq", "path")


@query("A6_frame_import", f"""{ctes('f_manifest', 'f_frames')} SELECT image_seq AS seq, concat('vid-', CAST(video AS VARCHAR)) AS grp, 'line' AS category, 'unlabeled' AS label, 'none' AS defect_type, 'unassigned' AS split FROM f_frames WHERE pos % 5 = 0
UNION ALL SELECT seq, grp, category, label, defect_type, split FROM f_manifest""")
def a6(spark, sf):
    new = labels.frames_as_rows(view(spark, sf, "f_frames").where("pos % 5 = 0"), "line")
    return new.unionByName(view(spark, sf, "f_manifest").select(new.columns))


@query("A7_manifest_read", f"{M} SELECT seq, CAST(CASE WHEN seq % 9 = 0 THEN NULL ELSE width END AS DOUBLE) AS width, round(brightness, 6) AS brightness, CAST(NULL AS DOUBLE) AS blur_score, category FROM f_manifest")
def a7(spark, sf):
    text = F.when(F.col("seq") % 9 == 0, "wide").otherwise(F.col("width").cast("string"))
    stored = view(spark, sf, "f_manifest").select("seq", text.alias("width"), F.col("brightness").cast("string").alias("brightness"), "category")
    return files.conformed(stored, StructType.fromDDL("seq long, width double, brightness double, blur_score double, category string"))


@query("A9_appended_events", f"{ctes('f_label_events')} SELECT seq, label, CAST(CAST(labeled_at AS DATE) AS VARCHAR) AS day FROM f_label_events")
def a9(spark, sf):
    path, events = scratch(spark, "events"), view(spark, sf, "f_label_events")
    for part in (events.where("seq % 2 = 0"), events.where("seq % 2 = 1")):
        files.append_by_day(part, "labeled_at", path)
    return spark.read.parquet(path).select("seq", "label", F.col("day").cast("string").alias("day"))


def _foreign(spark, sf):
    """The manifest's splits as a file of another tool would hold them."""
    path = scratch(spark, "foreign")
    said = F.when(F.col("label") == "defect", "Anomaly").otherwise("Normal")
    split_manifest(spark, sf).select(F.col("seq").alias("Image"), F.col("category").alias("Object"), said.alias("Label"), F.col("split").alias("Set")).write.option("header", True).csv(path)
    return files.official_split(spark, path, {"seq": ("file", "image"), "category": ("category", "object"), "label": ("label",), "split": ("split", "set")})


_FOREIGN = f"{M}, s AS (SELECT seq, category, CASE WHEN label='defect' THEN 'Anomaly' ELSE 'Normal' END AS label, {_SPLIT} AS split FROM f_manifest)"


@query("A13_foreign_split", f"{_FOREIGN} SELECT CAST(seq AS VARCHAR) AS seq, category, CASE WHEN label='Anomaly' THEN '불량' ELSE '정상' END AS label, split FROM s")
def a13(spark, sf):
    # What a tool of cp949 would write: its bytes, one a sign.
    path, other = scratch(spark, "foreign"), lambda x: x.encode("cp949").decode("latin-1")
    said = F.when(F.col("label") == "defect", other("불량")).otherwise(other("정상"))
    split_manifest(spark, sf).select(F.col("seq").alias(other("이미지")), F.col("category").alias("Object"), said.alias(other("라벨")), F.col("split").alias("Set")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.official_split(spark, path, {"seq": ("image", "이미지"), "category": ("category", "object"), "label": ("label", "라벨"), "split": ("split", "set")})


@query("A14_chosen_categories", f"{_FOREIGN} SELECT CAST(seq AS VARCHAR) AS seq, split, CAST(CASE WHEN label='Anomaly' THEN 1 ELSE 0 END AS BIGINT) AS y FROM s WHERE category IN ('en','de')")
def a14(spark, sf):
    return files.chosen_split(_foreign(spark, sf), ("en", "de")).select("seq", "split", "y")


@query("A15_reviews_read", f"{ctes('f_reviews')} SELECT CAST(seq AS BIGINT) AS seq, CAST(image_seq AS BIGINT) AS image_seq, status, defect, CAST(NULL AS DOUBLE) AS input_tokens FROM f_reviews")
def a15(spark, sf):
    stored = view(spark, sf, "f_reviews").select("seq", "image_seq", "status", F.col("defect").cast("string").alias("defect"))
    return files.conformed(stored, StructType.fromDDL("seq long, image_seq long, status string, defect boolean, input_tokens double"))


@query("A21_csv_copy", f"{_RESOLVED} SELECT seq, image_id, label, defect_type, label_source, verified FROM r")
def a21(spark, sf):
    return files.csv_copy(resolved(spark, sf).select("seq", "image_id", "label", "defect_type", "label_source", "verified"), scratch(spark, "csv"))


@query("A23_splits_table", f"{M} SELECT seq, {_SPLIT} AS split FROM f_manifest")
def a23(spark, sf):
    path, now = scratch(spark, "splits"), split_manifest(spark, sf)
    files.replace_splits(now.where("seq % 2 = 0").withColumn("split", F.lit("test")), path)
    return files.replace_splits(now, path)


@query("A25_boxes_read", f"{ctes('f_boxes')} SELECT seq, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(0 AS BIGINT) AS h, '' AS label FROM f_boxes")
def a25(spark, sf):
    return files.filled(view(spark, sf, "f_boxes").select("seq", "x", "y", "w"), StructType.fromDDL("seq long, x long, y long, w long, h long, label string"))


@query("A26_registry_read", f"{ctes('f_registry')} SELECT project, version, CASE WHEN seq % 13 = 0 THEN NULL ELSE round(CAST(recall AS DOUBLE), 6) END AS recall, round(CAST(prec AS DOUBLE), 6) AS prec FROM f_registry")
def a26(spark, sf):
    said = F.when(F.col("seq") % 13 == 0, "n/a").otherwise(F.col("recall").cast("string"))
    return rounded(registry.read(view(spark, sf, "f_registry").withColumn("recall", said)).select("project", "version", "recall", "prec"))


@query("C18_made_boxes", f"""{ctes('f_boxes')}, m AS (SELECT * FROM f_boxes WHERE image_id % 10 = 0 AND label='dent'), k AS (SELECT *, 0 AS made FROM f_boxes WHERE image_id NOT IN (SELECT image_id FROM m) UNION ALL SELECT *, 1 AS made FROM m)
SELECT seq, concat(CAST(image_id AS VARCHAR),'#',CAST(row_number() OVER (PARTITION BY image_id ORDER BY made, seq) AS VARCHAR)) AS box_id FROM k""")
def c18(spark, sf):
    b = view(spark, sf, "f_boxes")
    return boxes.append(b, b.where("image_id % 10 = 0 and label = 'dent'"), replacing=True).select("seq", "box_id")


# --- one step of a split, a report, a measure ----------------------------------------

@query("D1_allotments", f"{M}, {_ALLOC} SELECT category, label, qa AS train, qb AS val, CAST(n-qa-qb AS BIGINT) AS test FROM q JOIN n USING (category, label)")
def d1(spark, sf):
    n = view(spark, sf, "f_manifest").groupBy("category", "label").agg(labels.allocate(F.count("*"), (0.6, 0.2, 0.2)).alias("q"))
    return n.select("category", "label", *[F.col("q")[k].alias(s) for k, s in enumerate(labels.SPLITS)])


_PLACED = f"""{_FEEDBACK.replace(ctes("f_manifest", "f_label_events", "f_inference_log"), ctes("f_manifest", "f_label_events", "f_inference_log", "f_frames"))},
v AS (SELECT f.video, f.pos, y=1 AS truth, p=1 AS predicted, count(*) OVER (PARTITION BY f.video) AS k FROM fb JOIN f_inference_log l ON l.seq=fb.seq JOIN f_frames f ON f.image_seq=l.image_seq)"""


@query("E7_video_feedback", f"{_PLACED} SELECT video, CAST(pos AS BIGINT) AS pos, truth, predicted FROM v WHERE k > 1")
def e7(spark, sf):
    return rounded(segments.from_feedback(fed_back(spark, sf), view(spark, sf, "f_frames")))


@query("G19_live_performance", f"""{_FEEDBACK}, c AS (SELECT {_COUNTS.format(p='p=1')} FROM fb),
s AS (SELECT l.score, count(*) FILTER (y=1) AS pos, count(*) FILTER (y<>1) AS neg FROM fb JOIN f_inference_log l ON l.seq=fb.seq GROUP BY 1),
u AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM s)
SELECT tp, fp, fn, tn, round(coalesce(tp/nullif(tp+fn,0),'NaN'::DOUBLE),6) AS recall, round(coalesce(tp/nullif(tp+fp,0),'NaN'::DOUBLE),6) AS "precision",
(SELECT round(CAST(sum(pos*(below+neg/2)) AS DOUBLE)/(CAST(sum(pos) AS DOUBLE)*CAST(sum(neg) AS DOUBLE)),6) FROM u) AS auroc FROM c""")
def g19(spark, sf):
    fed = fed_back(spark, sf)
    ranked = metrics.auroc(fed.withColumn("y", F.col("y_true")))
    return rounded(metrics.live_performance(fed, []).crossJoin(F.broadcast(ranked)))


@query("H2_described_segments", f"""{ctes('f_frames')}, t AS ({_RUNS.format(gap=0, flag='truth')})
SELECT video, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST("end"-start+1 AS BIGINT) AS length, round(start/30.0::DOUBLE,6) AS start_sec, round("end"/30.0::DOUBLE,6) AS end_sec, round(("end"/30.0::DOUBLE)-(start/30.0::DOUBLE),6) AS duration, start<=20 AND 10<="end" AS in_reach FROM t""")
def h2(spark, sf):
    got = segments.described(segments.runs(view(spark, sf, "f_frames"), F.col("truth")))
    return rounded(got.withColumn("in_reach", segments.overlap(F.col("start"), F.col("end"), F.lit(10), F.lit(20))))


@query("H4_segment_rates", f"SELECT video, segment_recall, false_alarms_per_min, flooding FROM ({ORACLES['H3_segment_report']}) x")
def h4(spark, sf):
    return rounded(segments.report(view(spark, sf, "f_frames")).select("video", "segment_recall", "false_alarms_per_min", "flooding"))


@query("H11_defect_events", f"{ctes('f_frames')} SELECT video, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM ({_RUNS.format(gap=0, flag='score >= 50')})")
def h11(spark, sf):
    return rounded(segments.runs(view(spark, sf, "f_frames"), F.col("score") >= 50))


@query("I5_baseline_psi", f"""{_BASE}, c AS (SELECT feature, count(*) AS nc FROM f_features WHERE side='cand' GROUP BY 1), k AS (SELECT e.feature, e.e, n, nc FROM e JOIN c USING (feature)),
b AS (SELECT f.feature, f.side, len(list_filter(list_slice(k.e, 2, len(k.e)-1), lambda x: x <= f.value)) AS bin, count(*) AS c FROM f_features f JOIN k USING (feature) GROUP BY 1,2,3),
s AS (SELECT k.feature, greatest(coalesce(r.c,0)/k.n, 1e-4) AS ex, greatest(coalesce(x.c,0)/k.nc, 1e-4) AS ac FROM k, LATERAL (SELECT unnest(range(0, len(k.e)-1)) AS i) i
  LEFT JOIN b r ON r.feature=k.feature AND r.side='ref' AND r.bin=i.i LEFT JOIN b x ON x.feature=k.feature AND x.side='cand' AND x.bin=i.i)
SELECT feature, round(sum((ac-ex)*ln(ac/ex)),6) AS psi FROM s GROUP BY 1""")
def i5(spark, sf):
    ref, cand = _sides(spark, sf)
    return rounded(drift.baseline_psi(drift.baseline(ref), cand))


@query("I6_merged_bins", f"""{_BASE}, k AS (SELECT feature, e, list_transform(range(0, 4), lambda i: e[CAST(round_even(i*10.0/3, 0) AS INT)+1]) AS m FROM e)
SELECT feature, CAST(len(m)-1 AS BIGINT) AS bins, round(m[2],6) AS second_edge, round(m[3],6) AS third_edge,
  (SELECT round(count(*) FILTER (f.value < k.m[2])/count(*),6) FROM f_features f WHERE f.feature=k.feature AND f.side='ref') AS first_share FROM k""")
def i6(spark, sf):
    cut = drift.baseline(_sides(spark, sf)[0]).withColumn("c", drift.coarsened(F.col("edges"), F.col("props"), F.lit(300)))
    edge = lambda k: F.get("c.edges", F.lit(k))
    return rounded(cut.select("feature", F.size("c.props").alias("bins"), edge(1).alias("second_edge"), edge(2).alias("third_edge"), F.get("c.props", F.lit(0)).alias("first_share")))


@query("K24_fingerprints", f"{M} SELECT seq, substr(sha256(concat_ws('|', category, source, CAST(width AS VARCHAR))),1,16) AS definition, concat(CAST(ingested_epoch AS VARCHAR), ':', CAST(filesize AS VARCHAR)) AS stamp FROM f_manifest")
def k24(spark, sf):
    return view(spark, sf, "f_manifest").select("seq", paths.fingerprint(F.col("category"), F.col("source"), F.col("width").cast("string")).alias("definition"), paths.stamp(F.col("ingested_epoch"), F.col("filesize")).alias("stamp"))


# --- SQL of queries that build on others -----------------------------------------------

def _nested(name: str, **whole: str) -> str:
    """The SQL of a registered query as a subselect; ``whole`` names columns to take unrounded, with their expression."""
    sql = ORACLES[name]
    for column, value in whole.items():
        rounded_ = f"round({value},6) AS {column}"
        assert rounded_ in sql, rounded_
        sql = sql.replace(rounded_, f"{value} AS {column}")
    return f"({sql})"


_DRIFT = _nested("I7_feature_drift")
ORACLES["D11_strongest_drift"] = ORACLES["I7_feature_drift"]
ORACLES["I8_drift_summary"] = f"""WITH d AS (SELECT * FROM {_nested("I7_feature_drift", psi="psi")}),
n AS (SELECT count(*) FILTER (level='changed') AS changed, count(*) FILTER (level='watch') AS watch, count(*) FILTER (level='stable') AS stable, count(*) FILTER (level='insufficient') AS insufficient, round(avg(psi) FILTER (NOT isnan(psi)),6) AS mean_psi FROM d)
SELECT *, CASE WHEN changed>0 THEN 'changed' WHEN watch>0 THEN 'watch' WHEN stable>0 THEN 'stable' ELSE 'insufficient' END AS level FROM n"""
ORACLES["I10_group_drift"] = f"SELECT feature, psi FROM {_DRIFT} WHERE psi > 0.1 AND NOT isnan(psi) ORDER BY psi DESC, feature LIMIT 3"
ORACLES["I11_likely_causes"] = f"SELECT CASE WHEN feature < 'f32' THEN 'lighting' ELSE 'focus' END AS cause, max(psi) AS psi FROM {_DRIFT} WHERE psi > 0.1 AND NOT isnan(psi) GROUP BY 1"

_REPORT = _nested("H3_segment_report", segment_recall="coalesce(c/nullif(tr,0),'NaN'::DOUBLE)", frame_recall="coalesce(tp/nullif(t,0),'NaN'::DOUBLE)")
ORACLES["H5_recall_contrast"] = f"""WITH o AS (SELECT video, segment_recall-frame_recall AS off FROM {_REPORT})
SELECT video, CASE WHEN isnan(off) THEN 'alike' WHEN off>0.15 THEN 'segments_higher' WHEN off<-0.15 THEN 'frames_higher' ELSE 'alike' END AS contrast FROM o"""
_COMPARED = f"""WITH r AS (SELECT * FROM {_REPORT}), d AS (SELECT a.video, b.video AS other, CASE WHEN a.truth_runs>=3 AND b.truth_runs>=3 THEN a.segment_recall-b.segment_recall ELSE 'NaN'::DOUBLE END AS recall_drop,
  b.flooding AND NOT a.flooding AS started_flooding FROM r a JOIN r b ON b.video=a.video+1), h AS (SELECT *, NOT isnan(recall_drop) AND recall_drop<=0.1 AND NOT started_flooding AS held FROM d)"""
ORACLES["H17_compared_videos"] = f"{_COMPARED} SELECT video, other, round(recall_drop,6) AS recall_drop, started_flooding, held FROM h"
ORACLES["H18_causes"] = f"""{_COMPARED}, l AS (SELECT level FROM ({ORACLES["I8_drift_summary"]}))
SELECT video, other, CASE WHEN isnan(recall_drop) THEN 'undecided' WHEN held THEN 'none' WHEN level='insufficient' THEN 'undecided' WHEN level='changed' THEN 'capture' ELSE 'model' END AS cause FROM h, l"""
ORACLES["H7_sampling_tick"] = f"""{ctes('f_frames')}, g AS (SELECT video, round(pos/30.0::DOUBLE - lag(pos/30.0::DOUBLE) OVER (PARTITION BY video ORDER BY pos), 9) AS g FROM f_frames),
k AS (SELECT video, list_sort(list(g) FILTER (g > 0)) AS g FROM g GROUP BY 1) SELECT video, round(coalesce(g[len(g)//2+1], 0), 6) AS tick FROM k"""

ORACLES["A19_export_rows"] = _OUT.replace("o AS (SELECT split,", "o AS (SELECT seq, split,") + " SELECT seq AS image_id, split, label FROM o WHERE reason='exported'"
ORACLES["A20_json_rows"] = f"""{ctes('f_inference_log')} SELECT concat('{{"seq":', seq, ',"version":"', version, '","score":', CASE WHEN score IS NULL THEN 'null' ELSE CAST(score AS VARCHAR) END, '}}') AS row FROM f_inference_log"""

_RANKED = """s AS (SELECT {by}, score, count(*) FILTER (y=1) AS pos, count(*) FILTER (y<>1) AS neg FROM {rows} GROUP BY 1,2),
u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below, sum(pos) OVER d AS tp, sum(pos+neg) OVER d AS m FROM s WINDOW d AS (PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT {by}, CAST(sum(pos*(below+neg/2)) AS DOUBLE)/nullif(CAST(sum(pos) AS DOUBLE)*CAST(sum(neg) AS DOUBLE),0) AS auroc, CAST(sum(pos*tp/m) AS DOUBLE)/CAST(sum(pos) AS DOUBLE) AS average_precision FROM u GROUP BY 1)"""
_SUMMED = f"""{ctes('f_eval_big')}, {_RANKED.format(by='category', rows='f_eval_big')}, c AS (SELECT category, {_COUNTS.format(p='score >= 25')} FROM f_eval_big GROUP BY category),
x AS (SELECT category, auroc, average_precision, coalesce(tp/nullif(tp+fn,0),0) AS recall, coalesce(fp/nullif(fp+tn,0),0) AS alarm FROM a JOIN c USING (category))"""
ORACLES["F16_mean_over_categories"] = f"{_SUMMED} SELECT round(avg(auroc),6) AS auroc, round(avg(average_precision),6) AS average_precision, round(avg(recall),6) AS recall, round(avg(alarm),6) AS false_alarm_rate FROM x"
ORACLES["G22_verdict"] = f"""{_SUMMED}, v AS (SELECT *, CASE WHEN auroc>=0.9 THEN 'good' WHEN auroc>=0.75 THEN 'usable' ELSE 'weak' END AS level, recall*0.01+alarm*0.99 AS load FROM x),
w AS (SELECT category, auroc, level, concat_ws(',', CASE WHEN recall<0.95 THEN 'raise_recall' END, CASE WHEN 1-load<=0 THEN 'no_saving' WHEN coalesce(recall*0.01/nullif(load,0),0)<0.5 THEN 'mostly_false_alarms' END, CASE WHEN level='weak' THEN 'improve_model' END) AS listed FROM v)
SELECT category, level, CASE WHEN auroc IS NULL THEN 'split_data' WHEN listed='' THEN 'register' ELSE listed END AS actions FROM w"""
ORACLES["G4_roc_points"] = f"""{ctes('f_eval_big')}, s AS (SELECT category, score, count(*) FILTER (y=1) AS pos, count(*) FILTER (y<>1) AS neg FROM f_eval_big GROUP BY 1,2),
u AS (SELECT *, sum(pos) OVER d AS tps, sum(neg) OVER d AS fps, sum(pos) OVER (PARTITION BY category) AS p, sum(neg) OVER (PARTITION BY category) AS n, row_number() OVER d AS k, lead(pos) OVER d AS np, lead(neg) OVER d AS nn FROM s WINDOW d AS (PARTITION BY category ORDER BY score DESC))
SELECT category, round(fps/n,6) AS fpr, round(tps/p,6) AS tpr, round(CAST(score AS DOUBLE),6) AS threshold FROM u WHERE p>0 AND n>0 AND (np IS NULL OR np<>pos OR nn<>neg OR k=1)
UNION ALL SELECT DISTINCT category, 0.0::DOUBLE, 0.0::DOUBLE, 'infinity'::DOUBLE FROM u WHERE p>0 AND n>0"""

# With fewer rows than steps the thresholds of a sweep are the scores themselves.
_CHOSEN = """{n} AS (SELECT {by} AS category, count(*) AS n, count(*) FILTER (y=1) AS defects FROM f_eval GROUP BY 1),
{n}t AS (SELECT {n}.category, score AS threshold FROM f_eval JOIN {n} ON {n}.category={by} WHERE n<60 UNION SELECT {n}.category, unnest(quantile_cont(score, {q})) FROM f_eval JOIN {n} ON {n}.category={by} WHERE n>=60 GROUP BY {n}.category),
{n}c AS (SELECT t.category, threshold, {counts} FROM {n}t t JOIN f_eval ON t.category={by} GROUP BY 1,2),
{n}r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY fp, threshold DESC) AS k FROM {n}c WHERE tp/nullif(tp+fn,0) >= 0.95),
{n}g AS (SELECT n.category, defects, threshold FROM {n} n LEFT JOIN {n}r ON {n}r.category=n.category AND k=1)"""
_OWN = _CHOSEN.format(n="own_", by="f_eval.category", q=_Q60, counts=_COUNTS.format(p="score >= threshold"))
_SHARED = _CHOSEN.format(n="all_", by="'all'", q=_Q60, counts=_COUNTS.format(p="score >= threshold"))
ORACLES["G7_thresholds_by_category"] = f"""{ctes('f_eval')}, {_OWN} SELECT category, defects, CASE WHEN defects>=5 THEN round(threshold,6) END AS threshold, CASE WHEN defects<5 THEN 'few_defects' WHEN threshold IS NULL THEN 'infeasible' END AS skipped FROM own_g"""
ORACLES["G10_mixed_thresholds"] = f"""{ctes('f_eval')}, {_OWN}, {_SHARED}, j AS (SELECT f_eval.category, y, score, CASE WHEN own_g.defects>=5 THEN own_g.threshold END AS own, all_g.threshold AS shared FROM f_eval LEFT JOIN own_g USING (category), all_g),
c AS (SELECT category, max(coalesce(own, shared)) AS threshold, max(own) IS NOT NULL AS own, {_COUNTS.format(p='score >= coalesce(own, shared)')} FROM j GROUP BY 1)
SELECT category, round(threshold,6) AS threshold, own, {_RATES} FROM c"""
