"""Queries of sections G to J: evaluation, segments, drift, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import drift, learners, metrics, ordered, registry, segments, tables

from .fixtures import ctes, view
from .queries import _COUNTS, _Q60, _RATES, QUERIES
from .register import ORACLES, query, rounded

B = ctes("f_eval_big")
_OWN = "CASE category WHEN 'Brand#11' THEN 10.0 WHEN 'Brand#12' THEN 20.0 ELSE 25.0 END"


def rows(spark, sf):
    return view(spark, sf, "f_eval_big")


def own_thresholds(df):
    """Two categories' own thresholds as the table that the fit of thresholds gives."""
    return df.where(F.col("category").isin("Brand#11", "Brand#12")).select("category").distinct().withColumn("threshold", F.when(F.col("category") == "Brand#11", 10.0).otherwise(20.0)), df.sparkSession.range(1).select(F.lit(25.0).alias("threshold"))


@query("G8_row_thresholds", f"{B} SELECT id, {_OWN} AS used, score >= {_OWN} AS predicted FROM f_eval_big")
def g8(spark, sf):
    df = rows(spark, sf)
    return metrics.with_thresholds(df, *own_thresholds(df)).select("id", "used", "predicted")


@query("G9_mixed_overall", f"{B}, c AS (SELECT min({_OWN}) AS least_threshold, max({_OWN}) AS largest_threshold, {_COUNTS.format(p='score >= ' + _OWN)} FROM f_eval_big) SELECT least_threshold, largest_threshold, {_RATES} FROM c")
def g9(spark, sf):
    df = rows(spark, sf)
    return rounded(metrics.mixed_overall(df, *own_thresholds(df)))


@query("G12_threshold_effect", f"{B}, a AS (SELECT {_COUNTS.format(p='score >= 25')} FROM f_eval_big), b AS (SELECT {_COUNTS.format(p='score >= ' + _OWN)} FROM f_eval_big) SELECT round(b.tp/(b.tp+b.fn) - a.tp/(a.tp+a.fn),6) AS recall_change, round(b.tp/(b.tp+b.fp) - a.tp/(a.tp+a.fp),6) AS precision_change, b.fp-a.fp AS fp_change, b.fn-a.fn AS fn_change FROM a, b")
def g12(spark, sf):
    df = rows(spark, sf)
    return rounded(metrics.threshold_effect(df, *own_thresholds(df)))


#: auroc by ranks, average precision by running sums from the highest score.
_RANKED = f"""s AS (SELECT category, score, count(*) FILTER (y=1) AS pos, count(*) FILTER (y<>1) AS neg FROM f_eval_big GROUP BY 1,2),
u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY category ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below, sum(pos) OVER w AS tp_at, sum(pos+neg) OVER w AS m FROM s WINDOW w AS (PARTITION BY category ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT category, CAST(sum(pos*(below+neg/2)) AS DOUBLE)/(CAST(sum(pos) AS DOUBLE)*CAST(sum(neg) AS DOUBLE)) AS auroc, CAST(sum(pos*tp_at/m) AS DOUBLE)/CAST(sum(pos) AS DOUBLE) AS average_precision FROM u GROUP BY 1)"""


@query("G11_metrics_summary", f"{B}, c AS (SELECT category, {_COUNTS.format(p='score >= 25')} FROM f_eval_big GROUP BY 1), {_RANKED} SELECT category, {_RATES}, round(auroc,6) AS auroc, round(average_precision,6) AS average_precision FROM c JOIN k USING (category)")
def g11(spark, sf):
    return rounded(metrics.summary(rows(spark, sf), F.lit(25.0), ["category"]))


@query("F16_mean_over_categories")
def f16(spark, sf):
    got = metrics.summary(rows(spark, sf), F.lit(25.0), ["category"])
    return rounded(got.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("auroc", "average_precision", "recall", "false_alarm_rate")]))


@query("G13_impact", f"""{B}, c AS (SELECT category, {_COUNTS.format(p='score >= 25')} FROM f_eval_big GROUP BY 1), r AS (SELECT category, tp/(tp+fn) AS r, fp/(fp+tn) AS a FROM c), l AS (SELECT *, r*0.01::DOUBLE+a*0.99::DOUBLE AS load FROM r)
SELECT category, 0.01::DOUBLE AS prevalence, round(load,6) AS reviewed_ratio, round(1-load,6) AS reduction_ratio, round(coalesce(r*0.01/nullif(load,0),0),6) AS prevalence_precision, 10.0::DOUBLE AS defects, round(10*r,6) AS caught, round(10*(1-r),6) AS missed, round(1000*load,6) AS reviewed, round(1000*(1-load),6) AS saved, round(990*a,6) AS false_alarms FROM l""")
def g13(spark, sf):
    got = metrics.impact(metrics.at_threshold(rows(spark, sf), F.lit(25.0), ["category"]), F.lit(0.01))
    return rounded(got.select("category", "prevalence", "reviewed_ratio", "reduction_ratio", "prevalence_precision", "defects", "caught", "missed", "reviewed", "saved", "false_alarms"))


def score_map(spark, sf):
    return view(spark, sf, "f_score_map").withColumn("y", F.col("truth").cast("int"))


@query("G15_localization", f"{ctes('f_score_map')}, t AS (SELECT image_id, quantile_cont(score,0.99) AS cut, arg_max(truth, score) AS peak FROM f_score_map GROUP BY 1) SELECT image_id, any_value(peak) AS hit, round(avg(CAST(truth AS INT)),6) AS area, round(count(*) FILTER (truth AND score >= cut) / count(*) FILTER (truth OR score >= cut),6) AS iou FROM f_score_map JOIN t USING (image_id) GROUP BY 1 HAVING bool_or(truth)")
def g15(spark, sf):
    return rounded(metrics.localization(score_map(spark, sf)).where("area > 0").select("image_id", "hit", "area", "iou"))


@query("G16_localization_summary", f"""{ctes('f_score_map')}, t AS (SELECT image_id, quantile_cont(score,0.99) AS cut, arg_max(truth, score) AS peak FROM f_score_map GROUP BY 1),
k AS (SELECT image_id, truth, score, rank() OVER (PARTITION BY image_id ORDER BY score) + (count(*) OVER (PARTITION BY image_id, score) - 1) / 2 AS r FROM f_score_map),
a AS (SELECT image_id, (sum(r) FILTER (truth) - count(*) FILTER (truth) * (count(*) FILTER (truth) + 1) / 2) / nullif(count(*) FILTER (truth) * count(*) FILTER (NOT truth), 0) AS auroc FROM k GROUP BY 1),
i AS (SELECT image_id, any_value(peak) AS hit, avg(CAST(truth AS INT)) AS area, count(*) FILTER (truth AND score >= cut) / count(*) FILTER (truth OR score >= cut) AS iou FROM f_score_map JOIN t USING (image_id) GROUP BY 1 HAVING bool_or(truth))
SELECT count(*) AS images, round(avg(CAST(hit AS INT)),6) AS hit_rate, round(avg(area),6) AS mean_area, round(avg(iou),6) AS mean_iou, round(avg(auroc),6) AS mean_pixel_auroc, round(avg(CAST(hit AS INT))/avg(area),6) AS over_chance FROM i JOIN a USING (image_id)""")
def g16(spark, sf):
    return rounded(metrics.localization_summary(metrics.localization(score_map(spark, sf))))


_FIRST = "h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) <= count(*) OVER (PARTITION BY y) // 2 AS first FROM f_eval_big)"


@query("G17_validation", f"""{B}, {_FIRST}, {_RANKED}, q AS (SELECT DISTINCT category, unnest(CASE WHEN count(*) < 60 THEN list(score) ELSE quantile_cont(score, {_Q60}) END) AS threshold FROM h WHERE first GROUP BY category),
v AS (SELECT q.category, threshold, {_COUNTS.format(p='score >= threshold')} FROM q JOIN h ON h.category = q.category AND h.first GROUP BY 1, 2),
b AS (SELECT category, threshold FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY fp, threshold DESC) AS n FROM v WHERE tp >= 0.95*(tp+fn) AND tp+fn >= 5) WHERE n = 1),
c AS (SELECT b.category, threshold, {_COUNTS.format(p='score >= threshold')} FROM b JOIN h ON h.category = b.category AND NOT h.first GROUP BY 1, 2)
SELECT category, round(threshold,6) AS threshold, {_RATES}, round(auroc,6) AS auroc, round(average_precision,6) AS average_precision FROM c JOIN k USING (category)""")
def g17(spark, sf):
    return rounded(metrics.validated(tables.half_split(rows(spark, sf), "y", "id")))


@query("G18_mean_rates", f"""{B}, c AS (SELECT category, {_COUNTS.format(p='score >= 25')} FROM f_eval_big GROUP BY 1), m AS (SELECT avg(tp/(tp+fn)) AS r, avg(fp/(fp+tn)) AS a FROM c), p AS (SELECT r, a, CAST(unnest([0.01,0.02,0.05,0.1]) AS DOUBLE) AS p FROM m)
SELECT round(r,6) AS recall, round(a,6) AS false_alarm_rate, p AS prevalence, round(r*p/(r*p+a*(1-p)),6) AS prevalence_precision, round(1-(r*p+a*(1-p)),6) AS reduction_ratio, round(1000*p*(1-r),6) AS missed, round(1000*(1-p)*a,6) AS false_alarms FROM p""")
def g18(spark, sf):
    mean = metrics.at_threshold(rows(spark, sf), F.lit(25.0), ["category"]).agg(F.avg("recall").alias("recall"), F.avg("false_alarm_rate").alias("false_alarm_rate"))
    return rounded(metrics.impact_grid(mean, (0.01, 0.02, 0.05, 0.1)).select("recall", "false_alarm_rate", "prevalence", "prevalence_precision", "reduction_ratio", "missed", "false_alarms"))


@query("G22_verdict")
def g22(spark, sf):
    got = metrics.impact(metrics.summary(rows(spark, sf), F.lit(25.0), ["category"]), F.lit(0.01))
    return metrics.verdict(got).select("category", "level", "actions")


_GATE = f"""{ctes('f_registry')}, a AS (SELECT project, seq, recall, least(recall*(1-prec)/prec, 1) AS alarm FROM f_registry)"""


@query("G24_rebuilt_false_alarms", f"{_GATE} SELECT project, seq, round(alarm,6) AS alarm FROM a")
def g24(spark, sf):
    alarm = registry.rebuilt_false_alarms(F.col("recall").cast("double"), F.col("prec").cast("double"))
    return rounded(view(spark, sf, "f_registry").select("project", "seq", alarm.alias("alarm")))


@query("G23_promotion_gate", f"{_GATE}, g AS (SELECT seq, recall < 0.95 AS r, 1-(recall*0.01+alarm*0.99) < 0.5 AS s FROM a) SELECT seq, CASE WHEN r AND s THEN 'recall,saving' WHEN r THEN 'recall' WHEN s THEN 'saving' ELSE '' END AS problems, NOT (r OR s) AS passed FROM g")
def g23(spark, sf):
    df = view(spark, sf, "f_registry").withColumns({"recall": F.col("recall").cast("double"), "prec": F.col("prec").cast("double")})
    return registry.gate(df).select("seq", "problems", "passed")


def frames(spark, sf):
    return view(spark, sf, "f_frames")


@query("H5_recall_contrast")
def h5(spark, sf):
    return segments.contrast(segments.report(frames(spark, sf))).select("video", "contrast")


@query("H6_bands", f"{ctes('f_frames')}, i AS (SELECT video, pos, pos - row_number() OVER (PARTITION BY video ORDER BY pos) AS k FROM f_frames WHERE predicted), j AS (SELECT video, pos, pos - row_number() OVER (PARTITION BY video ORDER BY pos) AS k FROM f_frames WHERE truth), t AS (SELECT video, min(pos) AS s, max(pos) AS e FROM j GROUP BY video, k), h AS (SELECT t.*, EXISTS (SELECT 1 FROM f_frames f WHERE f.video=t.video AND f.predicted AND f.pos BETWEEN t.s AND t.e) AS c FROM t)\nSELECT video, 'alarm' AS lane, min(pos) AS start, max(pos) AS \"end\" FROM i GROUP BY video, k UNION ALL SELECT video, 'truth', s, e FROM t UNION ALL SELECT video, CASE WHEN c THEN 'caught' ELSE 'missed' END, s, e FROM h")
def h6(spark, sf):
    return rounded(segments.bands(frames(spark, sf)))


@query("H8_videos", f"{ctes('f_inference_log')} SELECT DISTINCT grp FROM f_inference_log WHERE trim(grp) <> ''")
def h8(spark, sf):
    return view(spark, sf, "f_inference_log").where("trim(grp) <> ''").select("grp").distinct()


@query("H9_label_ranges", f"{ctes('f_frames')} SELECT video, pos, 'defect' AS label FROM f_frames WHERE pos BETWEEN 15 AND 45 AND video % 2 = 0")
def h9(spark, sf):
    drawn = frames(spark, sf).where("video % 2 = 0").select("video").distinct().select("video", F.lit(0.5).alias("from_sec"), F.lit(1.5).alias("to_sec"), F.lit("defect").alias("label"))
    return rounded(segments.label_ranges(frames(spark, sf), drawn).select("video", "pos", "label"))


@query("H10_frame_lists", f"{ctes('f_frames')} SELECT video, string_agg(image_seq, ',' ORDER BY pos) AS images FROM f_frames GROUP BY video")
def h10(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct("pos", "image_seq")))
    return frames(spark, sf).groupBy("video").agg(F.array_join(F.transform(listed, lambda x: x["image_seq"].cast("string")), ",").alias("images"))


@query("H12_judged_frames", f"{ctes('f_frames')} SELECT video, pos, round(pos/30.0,3) AS seconds, round(score-50,6) AS margin, CASE WHEN score>=50 THEN 'defect' ELSE 'normal' END AS decision FROM f_frames")
def h12(spark, sf):
    return rounded(segments.judged(frames(spark, sf), 50.0))


@query("H13_judgements", f"{ctes('f_frames')}, i AS (SELECT video, pos - row_number() OVER (PARTITION BY video ORDER BY pos) AS k FROM f_frames WHERE score>=50), e AS (SELECT video, count(DISTINCT k) AS events FROM i GROUP BY 1) SELECT video, count(*) AS frames, count(*) FILTER (score>=50) AS defects, round(count(*) FILTER (score>=50)/count(*),6) AS rate, coalesce(any_value(events),0) AS events FROM f_frames LEFT JOIN e USING (video) GROUP BY video")
def h13(spark, sf):
    return rounded(segments.judgement_summary(frames(spark, sf), 50.0))


def neighbours(spark, sf):
    """Each video with the next one by number."""
    videos = frames(spark, sf).select("video").distinct()
    return videos.select("video", (F.col("video") + 1).alias("other"))


@query("H16_side_by_side", "WITH x AS (" + ORACLES["H3_segment_report"] + """), l AS (UNPIVOT (SELECT video, CAST(frames AS DOUBLE) AS frames, CAST(truth_runs AS DOUBLE) AS truth_runs, segment_recall, frame_recall, false_alarms_per_min, alarm_time_ratio FROM x) ON frames, truth_runs, segment_recall, frame_recall, false_alarms_per_min, alarm_time_ratio INTO NAME measure VALUE v)
SELECT a.video AS "left", b.video AS "right", a.measure, a.v AS left_value, b.v AS right_value FROM l a JOIN l b ON b.video = a.video + 1 AND b.measure = a.measure""")
def h16(spark, sf):
    return rounded(segments.side_by_side(segments.report(frames(spark, sf)), neighbours(spark, sf)))


@query("H17_compared_videos")
def h17(spark, sf):
    return rounded(segments.compared(segments.report(frames(spark, sf)), neighbours(spark, sf)))


@query("I2_score_baseline", f"{ctes('f_inference_log')} SELECT round(avg(score),6) AS mean, round(stddev_pop(score),6) AS std, round(quantile_cont(score,0.05),6) AS p05, round(quantile_cont(score,0.25),6) AS p25, round(quantile_cont(score,0.5),6) AS p50, round(quantile_cont(score,0.75),6) AS p75, round(quantile_cont(score,0.95),6) AS p95 FROM f_inference_log")
def i2(spark, sf):
    log = view(spark, sf, "f_inference_log")
    q = ordered.quantiles(log, [], "score", [0.05, 0.25, 0.5, 0.75, 0.95])
    got = log.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")).crossJoin(F.broadcast(q))
    return rounded(got.select("mean", "std", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))]))


@query("I3_quality_baseline", f"{ctes('f_manifest')} SELECT round(avg(blur_score),6) AS blur_mean, round(stddev_samp(blur_score),6) AS blur_std, round(avg(brightness),6) AS bright_mean, round(stddev_samp(brightness),6) AS bright_std, round(count(*) FILTER (label='defect')/nullif(count(*) FILTER (label<>'unlabeled'),0),6) AS defect_ratio FROM f_manifest")
def i3(spark, sf):
    known = F.count_if(F.col("label") != "unlabeled")
    return rounded(view(spark, sf, "f_manifest").agg(F.avg("blur_score").alias("blur_mean"), F.stddev_samp("blur_score").alias("blur_std"), F.avg("brightness").alias("bright_mean"), F.stddev_samp("brightness").alias("bright_std"), (F.count_if(F.col("label") == "defect") / F.nullif(known, F.lit(0))).alias("defect_ratio")))


@query("I4_histogram", f"{ctes('f_features')} SELECT feature, CAST(CASE WHEN value < -0.1 THEN 0 WHEN value < 0 THEN 1 WHEN value < 0.1 THEN 2 ELSE 3 END AS BIGINT) AS bin, count(*) AS n FROM f_features GROUP BY 1, 2")
def i4(spark, sf):
    edges = F.array(*map(F.lit, (-0.2, -0.1, 0.0, 0.1, 0.2)))
    df = view(spark, sf, "f_features").where(drift.finite(F.col("value")))
    return rounded(df.groupBy("feature", drift.bin_of(F.col("value"), edges).alias("bin")).agg(F.count("*").alias("n")))


@query("I9_score_shift", f"{ctes('f_inference_log')}, b AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM f_inference_log WHERE version='v001') SELECT version, round((avg(score)-any_value(m))/any_value(s),6) AS shift FROM f_inference_log, b GROUP BY version")
def i9(spark, sf):
    log = view(spark, sf, "f_inference_log")
    base = log.where("version = 'v001'").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    got = log.groupBy("version").agg(F.avg("score").alias("now")).crossJoin(F.broadcast(base))
    return rounded(got.select("version", F.when(F.col("s") > 0, (F.col("now") - F.col("m")) / F.col("s")).otherwise(F.lit(float("nan"))).alias("shift")))


@query("D11_strongest_drift")
def d11(spark, sf):
    return QUERIES["I7_feature_drift"](spark, sf).orderBy(F.nullif(F.nanvl("psi", F.lit(-1.0)), F.lit(-1.0)).desc_nulls_last(), "feature")


@query("J1_run_rows", f"""{ctes('f_runs')} SELECT run_id, created_at, CAST(to_json(struct_pack(recall := CAST(recall AS DOUBLE), prec := CAST(prec AS DOUBLE), fn := fn)) AS VARCHAR) AS metrics, CAST(to_json(struct_pack(kind := kind)) AS VARCHAR) AS config_json FROM f_runs""")
def j1(spark, sf):
    runs = view(spark, sf, "f_runs").withColumns({c: F.col(c).cast("double") for c in ("recall", "prec")})
    return registry.run_rows(runs.select("seq", "run_id", "created_at", "recall", "prec", "fn", "kind"), ("kind",))


@query("J3_registered", f"""{ctes('f_registry')}, l AS (SELECT project, count(*) AS n FROM f_registry GROUP BY 1), r AS (SELECT project, seq, n + row_number() OVER (PARTITION BY project ORDER BY seq) AS k FROM f_registry JOIN l USING (project) WHERE status='candidate')
SELECT project, seq, version, status, NULL AS run_id, NULL AS thresholds FROM f_registry
UNION ALL SELECT project, seq, concat('v', lpad(CAST(k AS VARCHAR), 3, '0')), 'candidate', concat('run-', seq), CASE WHEN seq % 3 = 0 THEN NULL ELSE '{{"de":' || (seq % 7 + 0.5) || ',"en":' || (seq % 5 + 0.25) || '}}' END FROM r""")
def j3(spark, sf):
    reg = view(spark, sf, "f_registry")
    own = F.create_map(F.lit("de"), F.col("seq") % 7 + 0.5, F.lit("en"), F.col("seq") % 5 + 0.25).cast("map<string,double>")
    runs = reg.where("status = 'candidate'").select("project", "seq", "recall", "prec", F.concat(F.lit("run-"), F.col("seq").cast("string")).alias("run_id"), F.when(F.col("seq") % 3 != 0, own).alias("thresholds"))
    return registry.register(reg, runs).select("project", "seq", "version", "status", "run_id", "thresholds")


_PROMOTED = f"{ctes('f_registry')}, c AS (SELECT project, max(version) AS chosen FROM f_registry GROUP BY 1)"


def _chosen(reg):
    return reg.groupBy("project").agg(F.max("version").alias("version"))


@query("J4_promoted", f"{_PROMOTED} SELECT project, version, CASE WHEN version=chosen THEN 'production' ELSE status END AS status FROM f_registry JOIN c USING (project)")
def j4(spark, sf):
    reg = view(spark, sf, "f_registry")
    return registry.promote(reg, _chosen(reg), F.to_timestamp_ntz(F.lit("2026-01-01"))).select("project", "version", "status")


@query("J5_archived", f"{_PROMOTED} SELECT project, version, CASE WHEN version=chosen THEN 'archived' ELSE status END AS status FROM f_registry JOIN c USING (project)")
def j5(spark, sf):
    reg = view(spark, sf, "f_registry")
    return registry.archive(reg, _chosen(reg)).select("project", "version", "status")


@query("J8_in_production", f"{_PROMOTED} SELECT project, chosen AS version FROM c")
def j8(spark, sf):
    reg = view(spark, sf, "f_registry")
    return registry.in_production(registry.promote(reg, _chosen(reg), F.to_timestamp_ntz(F.lit("2026-01-01")))).select("project", "version")


@query("I10_group_drift")
def i10(spark, sf):
    return rounded(drift.group_drift(view(spark, sf, "f_features"), "side", "ref", "cand"))


@query("B26_feature_family", f"{ctes('f_features')} SELECT DISTINCT feature, CASE WHEN feature < 'f32' THEN 'brightness' ELSE 'sharpness' END AS family FROM f_features")
def b26(spark, sf):
    name = F.concat(F.when(F.col("feature") < "f32", "gray_").otherwise("lap_"), "feature")
    return view(spark, sf, "f_features").select("feature").distinct().select("feature", drift.family(name).alias("family"))


@query("I11_likely_causes")
def i11(spark, sf):
    moved = QUERIES["I7_feature_drift"](spark, sf)
    return rounded(drift.likely_causes(moved.withColumn("feature", F.concat(F.when(F.col("feature") < "f32", "gray_").otherwise("lap_"), "feature"))))


@query("J2_run_comparison", f"{ctes('f_runs')} SELECT run_id, kind, round(recall,6) AS recall, round(prec,6) AS prec, CAST(fn AS BIGINT) AS fn FROM f_runs")
def j2(spark, sf):
    df = view(spark, sf, "f_runs").select("run_id", "kind", F.col("recall").cast("double").alias("recall"), F.col("prec").cast("double").alias("prec"), F.col("fn").cast("long").alias("fn"))
    return rounded(df)


def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y"))


@query("K20_classifiers")
def k20(spark, sf):
    df, out = vectors(spark, sf), None
    for kind in learners.KINDS:
        got = metrics.auroc(learners.cross_fitted(df, kind).select("y", F.col("probability").alias("score"))).select(F.lit(kind).alias("kind"), "auroc")
        out = got if out is None else out.unionByName(got)
    return rounded(out)


@query("K21_defect_probability")
def k21(spark, sf):
    return rounded(learners.cross_fitted(vectors(spark, sf), "logistic").select("vec_id", "y", "probability"))


@query("D14_strongest_features")
def d14(spark, sf):
    return rounded(learners.importance(spark, learners.fit(vectors(spark, sf), "logistic"), 15))


@query("K22_feature_importance")
def k22(spark, sf):
    return rounded(learners.importance(spark, learners.fit(vectors(spark, sf), "forest")))


@query("K25_batch_scores")
def k25(spark, sf):
    from labelloom.operators import grids, paths

    from .grid_queries import scored

    got = grids.image_scores(scored(spark, sf)).select("image_id", F.col("max").alias("score"), F.lit(3.0).alias("threshold"))
    return rounded(got.withColumn("decision", paths.decision(F.col("score"), F.col("threshold"))))


@query("I12_retraining_signals")
def i12(spark, sf):
    production = view(spark, sf, "f_registry").where("seq = 1").select(F.col("recall").cast("double").alias("recall"))
    live = metrics.live_performance(view(spark, sf, "f_eval").select(F.col("y").alias("y_true"), (F.col("score") >= 2000).cast("int").alias("y_pred")), [])
    labels_ = view(spark, sf, "f_label_events").agg(F.count("*").alias("n"))
    return drift.retraining_signals(production, live, QUERIES["I8_drift_summary"](spark, sf), labels_)


@query("I13_train_baseline", f"""{ctes('f_features')}, l AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id % 10 < 6 AND toxic IN (0, 1) GROUP BY 1),
q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM f_features WHERE id IN (SELECT doc_id FROM l) GROUP BY 1)
SELECT feature, round(m,6) AS mean, round(s,6) AS std, n, CAST(len(e) AS BIGINT) AS n_edges, round(e[3],6) AS third_edge,
  (SELECT round(count(*) FILTER (f.value < q.e[2])/count(*),6) FROM f_features f WHERE f.feature=q.feature AND f.id IN (SELECT doc_id FROM l)) AS first_share, (SELECT round(avg(toxic),6) FROM l) AS defect_ratio FROM q""")
def i13(spark, sf):
    train = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id % 10 < 6 and toxic in (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    got = drift.train_baseline(view(spark, sf, "f_features"), train.select("id", (F.col("toxic") == 1).alias("defect")))
    return rounded(got.select("feature", "mean", "std", "n", F.size("edges").alias("n_edges"), F.get("edges", F.lit(2)).alias("third_edge"), F.get("props", F.lit(0)).alias("first_share"), "defect_ratio"))


@query("H18_causes")
def h18(spark, sf):
    moved = QUERIES["I8_drift_summary"](spark, sf).select((F.col("level") != "insufficient").alias("measurable"), (F.col("level") == "changed").alias("changed"))
    return segments.cause(segments.compared(segments.report(frames(spark, sf)), neighbours(spark, sf)).crossJoin(F.broadcast(moved))).select("video", "other", "cause")
