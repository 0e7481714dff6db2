"""Queries of sections C to F: queues, counts, joins, advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import labels, metrics, ordered, segments, tables

from .fixtures import MOVING, ctes, view
from .queries import _RESOLVED, resolved
from .register import query, rounded

M = ctes("f_manifest")
#: Splits by the row's number, as the given table assigns none.
_SPLIT = "CASE WHEN seq % 10 < 6 THEN 'train' WHEN seq % 10 = 6 THEN 'val' WHEN seq % 10 = 7 THEN 'unassigned' ELSE 'test' END"
_S = f"{ctes('f_manifest', 'f_boxes')}, s AS (SELECT seq, image_id, label, source, category, grp, blur_score, brightness, {_SPLIT} AS split, seq AS box_image, CASE WHEN seq % 50 = 0 THEN NULL ELSE width END AS width FROM f_manifest)"
_COUNT = "count(*) FILTER ({})"


def manifest(spark, sf):
    return view(spark, sf, "f_manifest")


def split_manifest(spark, sf):
    return manifest(spark, sf).withColumn("split", F.expr(_SPLIT)).withColumn("width", F.expr("CASE WHEN seq % 50 = 0 THEN NULL ELSE width END"))


def split_images(spark, sf):
    return split_manifest(spark, sf).withColumn("image_id", F.col("seq"))


@query("C5_without_source", f"{M} SELECT seq FROM f_manifest WHERE source IS NULL OR source <> (SELECT min(source) FROM f_manifest)")
def c5(spark, sf):
    df = manifest(spark, sf)
    return tables.without_source(df, df.agg(F.min("source")).first()[0]).select("seq")


@query("C8_unverified_folder", f"{_RESOLVED} SELECT seq, image_id FROM r WHERE label_source='folder' AND NOT verified")
def c8(spark, sf):
    return resolved(spark, sf).where("label_source = 'folder' and not verified").select("seq", "image_id")


@query("C10_preview", f"{M} SELECT seq FROM f_manifest WHERE category='en' AND label='normal' ORDER BY md5(concat('3:', CAST(seq AS VARCHAR))), seq LIMIT 12")
def c10(spark, sf):
    return labels.sample(manifest(spark, sf).where("category = 'en' and label = 'normal'"), 12, 3).select("seq")


@query("C11_flagged", f"{M} SELECT seq FROM f_manifest WHERE blur_score < 30 OR brightness > 220")
def c11(spark, sf):
    df = manifest(spark, sf)
    return df.where(labels.quality_flags(df).rlike("blurry|overexposed")).select("seq")


@query("C12_scope", f"""{_S}, a AS (SELECT 'all' AS scope, seq FROM s UNION ALL SELECT 'test', seq FROM s WHERE split='test' UNION ALL SELECT 'unlabeled', seq FROM s WHERE label='unlabeled'
  UNION ALL SELECT 'category', seq FROM s WHERE category='de' UNION ALL SELECT 'first category', seq FROM s WHERE category=(SELECT min(category) FROM s))
SELECT scope, seq FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq) AS k FROM a) WHERE k <= 40""")
def c12(spark, sf):
    df, out = split_manifest(spark, sf), None
    for scope, kind, value in (("all", "all", None), ("test", "test", None), ("unlabeled", "unlabeled", None), ("category", "category", "de"), ("first category", "category", "nowhere")):
        rows = tables.in_scope(df, kind, value, limit=40).select(F.lit(scope).alias("scope"), "seq")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("C14_labelled", f"{M} SELECT seq, label FROM f_manifest WHERE label <> 'unlabeled'")
def c14(spark, sf):
    return manifest(spark, sf).where(F.col("label").isin("normal", "defect")).select("seq", "label")


@query("C21_outcome_rows", f"{ctes('f_eval')} SELECT id FROM f_eval WHERE y=1 AND score < 2000")
def c21(spark, sf):
    return view(spark, sf, "f_eval").where(metrics.outcome(F.col("y"), F.col("score") >= 2000) == "FN").select("id")


@query("C19_unregistered_runs", f"{ctes('f_runs', 'f_registry')} SELECT run_id FROM f_runs WHERE seq NOT IN (SELECT seq FROM f_registry WHERE status='archived')")
def c19(spark, sf):
    known = view(spark, sf, "f_registry").where("status = 'archived'").select("seq")
    return view(spark, sf, "f_runs").join(known.hint("merge"), "seq", "left_anti").select("run_id")


@query("C22_traceable", f"{ctes('f_inference_log')} SELECT DISTINCT image_seq FROM f_inference_log")
def c22(spark, sf):
    return view(spark, sf, "f_inference_log").select("image_seq").distinct()


@query("D6_half_split", f"{ctes('f_eval')} SELECT id, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) <= count(*) OVER (PARTITION BY y) // 2 AS first FROM f_eval")
def d6(spark, sf):
    return tables.half_split(view(spark, sf, "f_eval"), "y", "id").select("id", "first")


@query("D7_stride", f"{ctes('f_frames')} SELECT image_seq FROM f_frames WHERE pos % 5 = 0")
def d7(spark, sf):
    return view(spark, sf, "f_frames").where("pos % 5 = 0").select("image_seq")


@query("D10_review_candidates", f"{ctes('f_eval', 'f_reviews')}, c AS (SELECT id, abs(score-2000) AS d FROM f_eval ORDER BY d, id LIMIT 60) SELECT id FROM c WHERE id NOT IN (SELECT image_seq FROM f_reviews WHERE status='ok') ORDER BY d, id LIMIT 20")
def d10(spark, sf):
    # The span that scales the distances is one number, so it does not change their order.
    near = view(spark, sf, "f_eval").withColumn("d", F.abs(F.col("score") - 2000)).orderBy("d", "id").limit(60)
    done = view(spark, sf, "f_reviews").where("status = 'ok'").select(F.col("image_seq").alias("id")).distinct()
    return near.join(done.hint("merge"), "id", "left_anti").orderBy("d", "id").limit(20).select("id")


@query("D16_log_tail", f"{ctes('f_inference_log')} SELECT seq, decision FROM f_inference_log ORDER BY seq DESC LIMIT 200")
def d16(spark, sf):
    return view(spark, sf, "f_inference_log").orderBy(F.desc("seq")).limit(200).select("seq", "decision")


@query("E2_standard_types", f"{_RESOLVED} SELECT seq, raw_defect_type, CASE raw_defect_type WHEN 'scratch_head' THEN 'scratch' WHEN 'broken_large' THEN 'crack' WHEN 'glue' THEN 'contamination' ELSE raw_defect_type END AS defect_type FROM r")
def e2(spark, sf):
    from .queries import TYPE_MAP

    return manifest(spark, sf).select("seq", F.col("defect_type").alias("raw_defect_type"), labels.normalized_type(F.col("defect_type"), TYPE_MAP).alias("defect_type"))


@query("E6_rows_with_reviews", f"{ctes('f_eval', 'f_reviews')}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_seq ORDER BY seq DESC) AS k FROM f_reviews) WHERE k=1) SELECT f_eval.id, f_eval.y, v.status AS review FROM f_eval LEFT JOIN v ON v.image_seq = f_eval.id")
def e6(spark, sf):
    last = labels.latest(view(spark, sf, "f_reviews"), "image_seq").select(F.col("image_seq").alias("id"), F.col("status").alias("review"))
    return view(spark, sf, "f_eval").join(last.hint("merge"), "id", "left").select("id", F.col("y").cast("int").alias("y"), "review")


@query("E12_split_gap", f"{_S} SELECT count(*) AS total, {_COUNT.format(chr(34) + 'split' + chr(34) + chr(60) + chr(62) + repr('unassigned'))} AS assigned, count(*) FILTER (split='unassigned' AND label<>'unlabeled') AS labelled_unassigned, count(*) FILTER (split='unassigned' AND seq IN (SELECT image_id FROM f_boxes)) AS boxed_unassigned FROM s")
def e12(spark, sf):
    return tables.split_gap(split_images(spark, sf), view(spark, sf, "f_boxes"))


#: What each table says of an image, by stage: the table and the columns told. Times are not among them, as engines write them apart.
_TOLD = {"manifest": ("f_manifest", ("source", "category", "label", "defect_type")), "effective": ("r", ("label", "defect_type", "label_source", "verified")), "event": ("f_label_events", ("label", "defect_type", "verified", "labeled_by")), "inference": ("f_inference_log", ("version", "decision", "score")), "review": ("f_reviews", ("status", "input_tokens", "defect"))}
_SAYS = {"score": "CAST(floor(score) AS BIGINT)"}


def _trace_sql() -> str:
    parts = []
    for stage, (name, columns) in _TOLD.items():
        key = "seq" if stage in ("manifest", "effective") else "image_seq"
        parts.append(f"SELECT {key} AS image_seq, '{stage}' AS stage, seq AS at, CAST(to_json(struct_pack(seq := seq, {', '.join(f'{c} := {_SAYS.get(c, c)}' for c in columns)})) AS VARCHAR) AS detail FROM {name}")
    return _RESOLVED.replace(ctes("f_manifest", "f_label_events"), ctes("f_manifest", "f_label_events", "f_inference_log", "f_reviews")) + " " + " UNION ALL ".join(parts)


@query("E16_trace", _trace_sql())
def e16(spark, sf):
    parts = {}
    for stage, (name, columns) in _TOLD.items():
        df = resolved(spark, sf) if stage == "effective" else view(spark, sf, name)
        key = "seq" if stage in ("manifest", "effective") else "image_seq"
        parts[stage] = df.select(F.col(key).alias("image_seq"), F.col("seq").cast("long").alias("seq"), *[F.expr(_SAYS.get(c, c)).alias(c) for c in columns])
    return tables.trace(parts, "image_seq")


@query("F1_manifest_summary", f"{M} SELECT count(*) AS total, count(DISTINCT source) AS sources, count(DISTINCT category) AS categories, count(*) FILTER (label='defect') AS defect FROM f_manifest")
def f1(spark, sf):
    return manifest(spark, sf).agg(F.count("*").alias("total"), F.count_distinct("source").alias("sources"), F.count_distinct("category").alias("categories"), tables.count_if(F.col("label") == "defect").alias("defect"))


@query("F3_value_counts", f"{M} SELECT defect_type, count(*) AS n FROM f_manifest GROUP BY 1")
def f3(spark, sf):
    return manifest(spark, sf).groupBy("defect_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "defect_type")


_SPLITS = ", ".join(f"count(*) FILTER (split='{s}') AS {s}" for s in ("train", "val", "test", "unassigned"))


@query("F5_crosstab_label_split", f"{_S} SELECT category, label, {_SPLITS} FROM s GROUP BY category, label")
def f5(spark, sf):
    return labels.crosstab(split_manifest(spark, sf), ["category", "label"], "split", ["train", "val", "test", "unassigned"])


@query("F6_crosstab_split_label", f"{_S} SELECT split, count(*) FILTER (label='normal') AS normal, count(*) FILTER (label='defect') AS defect FROM s GROUP BY split")
def f6(spark, sf):
    return labels.crosstab(split_manifest(spark, sf), ["split"], "label", ["normal", "defect"])


@query("F7_balance", f"{M}, c AS (SELECT count(*) FILTER (label='normal') AS normal, count(*) FILTER (label='defect') AS defect FROM f_manifest) SELECT *, round(CASE WHEN normal/defect >= 5 OR normal/defect <= 0.2 THEN normal/defect END, 6) AS ratio FROM c")
def f7(spark, sf):
    return rounded(tables.balance(manifest(spark, sf)))


@query("F8_mean_quality", f"{M} SELECT category, round(avg(blur_score),6) AS blur, round(avg(brightness),6) AS bright FROM f_manifest GROUP BY category")
def f8(spark, sf):
    return rounded(manifest(spark, sf).groupBy("category").agg(F.avg("blur_score").alias("blur"), F.avg("brightness").alias("bright")))


@query("F12_detection_readiness", f"""{_S}, c AS (SELECT label, count(*) AS n FROM f_boxes GROUP BY 1), i AS (SELECT count(DISTINCT image_id) AS n FROM f_boxes), a AS (SELECT count(*) AS n FROM s WHERE split IN ('train','val','test'))
SELECT (SELECT n FROM i) AS images_with_boxes, CAST(sum(n) AS BIGINT) AS boxes, count(*) AS classes, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS per_class,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (n<1500), '') AS thin, (SELECT n FROM a) AS splits_assigned, (SELECT n FROM i) >= 1500 AND (SELECT n FROM a) > 0 AS ready FROM c""")
def f12(spark, sf):
    return tables.detection_readiness(view(spark, sf, "f_boxes"), split_manifest(spark, sf), 1500)


_OUT = f"""{_S}, o AS (SELECT split, label, CASE WHEN width IS NULL OR width <= 0 THEN 'unreadable' WHEN split='unassigned' THEN 'no_split'
WHEN label='defect' AND seq NOT IN (SELECT image_id FROM f_boxes) THEN 'defect_without_box' WHEN label='unlabeled' THEN 'unlabeled' ELSE 'exported' END AS reason FROM s)"""


@query("F13_export_outcomes", f"{_OUT} SELECT split, reason, count(*) AS n FROM o GROUP BY 1, 2")
def f13(spark, sf):
    return tables.export_outcomes(split_images(spark, sf), view(spark, sf, "f_boxes")).groupBy("split", "reason").agg(F.count("*").alias("n"))


@query("F30_export_usable", f"{_OUT}, c AS (SELECT count(*) FILTER (reason='exported' AND label='defect') AS positives, count(*) FILTER (reason='exported' AND split='train') AS train_rows FROM o) SELECT *, CASE WHEN positives=0 THEN 'no_positives' WHEN train_rows=0 THEN 'no_train' ELSE '' END AS blocked_by, positives>0 AND train_rows>0 AS usable FROM c")
def f30(spark, sf):
    return tables.export_usable(tables.export_outcomes(split_images(spark, sf), view(spark, sf, "f_boxes")))


@query("F15_last_batch", f"""{ctes('f_inference_log')}, d AS (SELECT *, CAST(logged_at AS DATE) AS day, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS latency FROM f_inference_log), l AS (SELECT version, max(day) AS day FROM d GROUP BY 1)
SELECT version, CAST(day AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (decision='defect') AS defect, count(*) FILTER (decision='normal') AS normal, round(avg(latency),6) AS latency_mean, count(*) FILTER (score IS NULL) AS failed FROM d JOIN l USING (version, day) GROUP BY 1, 2""")
def f15(spark, sf):
    return rounded(tables.last_batch(view(spark, sf, "f_inference_log").withColumn("latency", F.from_json("props", "k double")["k"])))


@query("F19_model_advice", f"{_S}, c AS (SELECT count(*) FILTER (split='train' AND label='normal') AS normals, count(*) FILTER (split='train' AND label='defect') AS defects FROM s) SELECT normals, defects, defects=0 AS baseline_blocked, normals=0 AS anomaly_blocked, CASE WHEN (normals=0 AND defects>0) OR defects>=10 THEN 'baseline' ELSE 'anomaly' END AS recommended, normals>0 AND normals<15 AS few_normals FROM c")
def f19(spark, sf):
    return tables.advice(split_manifest(spark, sf))


@query("F20_readiness", f"{_S} SELECT CASE WHEN count(DISTINCT label) FILTER (split='train' AND label<>'unlabeled') < 2 THEN 'one_kind' ELSE '' END AS problems, count(DISTINCT label) FILTER (split='train' AND label<>'unlabeled') = 2 AS ready FROM s")
def f20(spark, sf):
    return tables.readiness(split_manifest(spark, sf))


@query("F21_all_synthetic", f"{M} SELECT bool_and(source='synthetic') AS all_synthetic FROM f_manifest")
def f21(spark, sf):
    return manifest(spark, sf).agg(F.coalesce(F.bool_and(F.col("source") == "synthetic"), F.lit(False)).alias("all_synthetic"))


@query("F22_review_totals", f"{ctes('f_reviews')} SELECT count(*) AS total, count(*) FILTER (status='ok') AS ok, count(*) FILTER (status='ok' AND defect) AS defects, CAST(sum(coalesce(input_tokens,0)) AS BIGINT) AS tokens FROM f_reviews")
def f22(spark, sf):
    ok = F.col("status") == "ok"
    return view(spark, sf, "f_reviews").agg(F.count("*").alias("total"), tables.count_if(ok).alias("ok"), tables.count_if(ok & F.col("defect")).alias("defects"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("tokens"))


@query("F24_labels_by_source", f"{_RESOLVED} SELECT label_source, count(*) AS n, count(*) FILTER (verified) AS verified FROM r GROUP BY 1")
def f24(spark, sf):
    return resolved(spark, sf).groupBy("label_source").agg(F.count("*").alias("n"), tables.count_if(F.col("verified")).alias("verified"))


@query("F25_mask_area", f"{ctes('f_score_map')}, s AS (SELECT image_id, 100.0*count(*) FILTER (truth)/count(*) AS share FROM f_score_map GROUP BY 1) SELECT image_id % 3 AS category, round(median(share),6) AS median, round(avg(share),6) AS mean, round(min(share),6) AS least FROM s GROUP BY 1")
def f25(spark, sf):
    share = view(spark, sf, "f_score_map").groupBy("image_id").agg((100.0 * F.count_if("truth") / F.count("*")).alias("share"))
    share = share.withColumn("category", F.col("image_id") % 3)
    got = share.groupBy("category").agg(F.avg("share").alias("mean"), F.min("share").alias("least")).join(ordered.quantiles(share, ["category"], "share", [0.5]).hint("merge"), "category")
    return rounded(got.select("category", F.col("q")[0].alias("median"), "mean", "least"))


@query("F27_new_labels", f"{ctes('f_label_events')} SELECT count(*) AS n FROM f_label_events WHERE labeled_at >= (SELECT date_trunc('second', median(labeled_at)) FROM f_label_events WHERE label='defect' AND seq <= 1)")
def f27(spark, sf):
    ev = view(spark, sf, "f_label_events")
    cutoff = ev.where("label = 'defect' and seq <= 1").agg(F.date_trunc("second", F.max("labeled_at")).alias("cutoff"))
    return ev.join(F.broadcast(cutoff), F.col("labeled_at") >= F.col("cutoff")).agg(F.count("*").alias("n"))


@query("F29_rows_by_project", f"{ctes('f_registry')} SELECT project, count(*) AS n FROM f_registry GROUP BY 1")
def f29(spark, sf):
    return view(spark, sf, "f_registry").groupBy("project").agg(F.count("*").alias("n"))


@query("F31_grouped_rows", f"{M} SELECT count(*) FILTER (trim(grp) <> '') AS grouped, count(DISTINCT grp) FILTER (trim(grp) <> '') AS videos FROM f_manifest")
def f31(spark, sf):
    own = labels.group_key(F.col("grp"), F.col("image_id")) != F.col("image_id")
    return manifest(spark, sf).agg(tables.count_if(own).alias("grouped"), F.count_distinct(F.when(own, F.col("grp"))).alias("videos"))


@query("F23_still_rate", MOVING.replace("SELECT video, pos FROM r WHERE keep", "SELECT video, count(*) AS scanned, count(*) FILTER (NOT keep) AS dropped, round(count(*) FILTER (NOT keep) / count(*), 6) AS rate, count(*) >= 5 AND count(*) FILTER (NOT keep) / count(*) >= 0.8 AS mostly_dropped FROM r GROUP BY 1"))
def f23(spark, sf):
    frames = view(spark, sf, "f_clips")
    return rounded(tables.still_rate(frames, segments.drop_still_frames(frames)))


@query("B12_flag_words", f"{M} SELECT seq, CASE WHEN blur_score < 30 THEN CASE WHEN brightness < 40 THEN 'out of focus, too dark' WHEN brightness > 220 THEN 'out of focus, too bright' ELSE 'out of focus' END WHEN brightness < 40 THEN 'too dark' WHEN brightness > 220 THEN 'too bright' ELSE 'good' END AS words FROM f_manifest WHERE least(width, height) >= 64")
def b12(spark, sf):
    df = manifest(spark, sf).where(F.least("width", "height") >= 64)
    return df.select("seq", tables.flag_words(labels.quality_flags(df)).alias("words"))


@query("C13_largest_video", f"""{M}, g AS (SELECT grp FROM f_manifest WHERE trim(grp) <> '' GROUP BY grp ORDER BY count(*) DESC, grp DESC LIMIT 1),
f AS (SELECT grp, seq, row_number() OVER (ORDER BY seq) - 1 AS p, count(*) OVER () AS n FROM f_manifest WHERE grp = (SELECT grp FROM g))
SELECT grp, seq FROM f WHERE n <= 20 OR p IN (SELECT CAST(floor(k * (n / 20)) AS BIGINT) FROM (SELECT unnest(range(0, 20)) AS k), (SELECT DISTINCT n FROM f))""")
def c13(spark, sf):
    return tables.video_subset(manifest(spark, sf), "grp", ["seq"], 20).select("grp", "seq")


@query("C15_numbered_frames", f"{M} SELECT seq FROM f_manifest WHERE trim(grp) NOT IN ('', 'nan', 'None')")
def c15(spark, sf):
    from labelloom.operators import paths

    own = labels.group_key(F.col("grp"), F.col("image_id")) != F.col("image_id")
    number = paths.frame_number(F.concat("category", F.lit("/"), F.col("seq").cast("string"), F.lit(".png")))
    return manifest(spark, sf).where(own & number.isNotNull()).select("seq")


@query("C16_boxes_of_image", f"{ctes('f_boxes')} SELECT seq, label FROM f_boxes WHERE image_id = (SELECT min(l_orderkey) FROM lineitem)")
def c16(spark, sf):
    df = view(spark, sf, "f_boxes")
    first = df.agg(F.min("image_id")).first()[0]
    return df.where(F.col("image_id") == F.lit(first)).select("seq", "label")


@query("E9_adopted_boxes", f"{ctes('f_boxes', 'f_images')} SELECT image_id, false AS adopted FROM f_boxes WHERE image_id % 2 = 0 UNION ALL SELECT image_id, true FROM f_images WHERE image_id NOT IN (SELECT image_id FROM f_boxes WHERE image_id % 2 = 0) AND width IS NOT NULL")
def e9(spark, sf):
    drawn = view(spark, sf, "f_boxes").where("image_id % 2 = 0").select("image_id")
    old = view(spark, sf, "f_images").where("width is not null").select("image_id")
    return tables.adopted(drawn, old)


@query("E13_verified_folders", f"{_RESOLVED} SELECT count(*) AS decided, count(*) FILTER (r.label <> e.label) AS changed FROM r JOIN e ON e.image_seq = r.seq WHERE e.verified")
def e13(spark, sf):
    decided = labels.latest(view(spark, sf, "f_label_events"), "image_seq").where("verified").select(F.col("image_seq").alias("seq"), F.col("label").alias("decided"))
    return tables.changed(resolved(spark, sf), decided)


@query("F9_unmapped_counts", f"{_RESOLVED} SELECT defect_type, count(*) AS n FROM r WHERE defect_type NOT IN ({', '.join(repr(t) for t in labels.STANDARD_TYPES)}) GROUP BY 1")
def f9(spark, sf):
    got = resolved(spark, sf)
    return got.where(~F.col("defect_type").isin(*labels.STANDARD_TYPES)).groupBy("defect_type").agg(F.count("*").alias("n"))


@query("F28_batch_failures", f"{ctes('f_inference_log')}, r AS (SELECT DISTINCT image_seq FROM f_inference_log WHERE image_seq % 7 <> 0) SELECT count(*) AS asked, count(*) FILTER (r.image_seq IS NULL) AS failed FROM (SELECT DISTINCT image_seq FROM f_inference_log) a LEFT JOIN r USING (image_seq)")
def f28(spark, sf):
    asked = view(spark, sf, "f_inference_log").select("image_seq").distinct()
    return tables.failures(asked, asked.where("image_seq % 7 <> 0"), "image_seq")


@query("C20_missed", f"{ctes('f_inference_log')} SELECT seq FROM f_inference_log WHERE category IN ('error','signup') AND decision='normal' ORDER BY seq LIMIT 8")
def c20(spark, sf):
    judged = F.col("category").isin("error", "signup").cast("int").alias("y_true"), (F.col("decision") == "defect").cast("int").alias("y_pred")
    return tables.missed(view(spark, sf, "f_inference_log").select("seq", *judged)).select("seq")


@query("E5_rows_with_columns", f"{ctes('f_eval', 'f_manifest')} SELECT id, round(blur_score,6) AS blur_score FROM f_eval LEFT JOIN f_manifest ON seq = id")
def e5(spark, sf):
    extra = manifest(spark, sf).select(F.col("seq").alias("id"), "blur_score")
    return rounded(view(spark, sf, "f_eval").select("id").join(extra.hint("merge"), "id", "left"))


@query("E10_mask_pairs", f"{ctes('f_paths')}, p AS (SELECT DISTINCT visa_path AS p FROM f_paths) SELECT i.p AS image, m.p AS mask FROM p i JOIN p m ON m.p = replace(i.p, '/Images/', '/Masks/') WHERE i.p LIKE '%/Images/%'")
def e10(spark, sf):
    return tables.mask_pairs(view(spark, sf, "f_paths").select(F.col("visa_path").alias("path")).distinct())


@query("E11_mask_readiness", f"{ctes('f_cells')}, s AS (SELECT s_suppkey AS k, s_suppkey IN (SELECT image_id FROM f_cells) AS m, s_suppkey % 3 = 0 AS b FROM supplier) SELECT count(*) FILTER (m AND NOT b) AS ready, count(*) FILTER (NOT m) AS without_mask, count(*) FILTER (b) AS boxed FROM s")
def e11(spark, sf):
    images = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("image_id"))
    return tables.mask_readiness(images, view(spark, sf, "f_cells"), images.where("image_id % 3 = 0"))


@query("A24_newest_types", f"{M}, t AS (SELECT defect_type AS raw_type, max(seq) AS seq FROM f_manifest GROUP BY 1) SELECT raw_type, CASE WHEN raw_type IN (SELECT defect_type FROM f_manifest WHERE seq % 2 = 0) THEN 'own' ELSE 'default' END AS standard_type FROM t")
def a24(spark, sf):
    types = manifest(spark, sf).select("seq", F.col("defect_type").alias("raw_type"))
    return tables.newest_types(types.withColumn("standard_type", F.lit("default")), types.where("seq % 2 = 0").withColumn("standard_type", F.lit("own")))
