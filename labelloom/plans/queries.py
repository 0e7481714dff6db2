"""The registered queries of the engine and the SQL that gives the same rows.

Names begin with the operator's id in the survey. Doubles are rounded to six places in both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import boxes, drift, labels, metrics, ordered, registry, segments

from .fixtures import MOVING, ctes, view
from .register import ORACLES, QUERIES, query, rounded

__all__ = ["ORACLES", "QUERIES"]

TYPE_MAP = {"scratch_head": "scratch", "broken_large": "crack", "glue": "contamination", "poke": "hole"}
_TYPES = ", ".join(f"'{t}'" for t in labels.STANDARD_TYPES)
_MAP_SQL = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_MAP.items()) + " ELSE {0} END"


# --- metrics -----------------------------------------------------------------

_RATES = """tp, fp, fn, tn, round(coalesce(tp/nullif(tp+fn,0),0),6) AS recall, round(coalesce(tp/nullif(tp+fp,0),0),6) AS "precision",
  round(coalesce(tn/nullif(tn+fp,0),0),6) AS specificity, round(coalesce((tp+tn)/nullif(tp+fp+fn+tn,0),0),6) AS accuracy,
  round(coalesce(fn/nullif(tp+fn,0),0),6) AS miss_rate, round(coalesce(fp/nullif(fp+tn,0),0),6) AS false_alarm_rate,
  round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) AS f1"""
_COUNTS = """CAST(count(*) FILTER (y=1 AND {p}) AS BIGINT) AS tp, CAST(count(*) FILTER (y<>1 AND {p}) AS BIGINT) AS fp,
  CAST(count(*) FILTER (y=1 AND NOT ({p})) AS BIGINT) AS fn, CAST(count(*) FILTER (y<>1 AND NOT ({p})) AS BIGINT) AS tn"""


@query("G1_metrics_at_threshold", f"""{ctes('f_eval_big')}, c AS (SELECT category, {_COUNTS.format(p='score >= 25')} FROM f_eval_big GROUP BY category)
SELECT category, {_RATES} FROM c""")
def g1(spark, sf):
    return rounded(metrics.at_threshold(view(spark, sf, "f_eval_big"), F.lit(25.0), ["category"]))


@query("G2_auroc", f"""{ctes('f_eval_big')}, s AS (SELECT category, score, count(*) FILTER (y=1) AS pos, count(*) FILTER (y<>1) AS neg FROM f_eval_big GROUP BY 1,2),
u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY category ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM s)
SELECT category, round(CAST(sum(pos*(below+neg/2)) AS DOUBLE)/(CAST(sum(pos) AS DOUBLE)*CAST(sum(neg) AS DOUBLE)),6) AS auroc FROM u GROUP BY category""")
def g2(spark, sf):
    return rounded(metrics.auroc(view(spark, sf, "f_eval_big"), ["category"]))


@query("G3_average_precision", f"""{ctes('f_eval_big')}, s AS (SELECT category, score, count(*) FILTER (y=1) AS pos, count(*) AS n FROM f_eval_big GROUP BY 1,2),
u AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS m FROM s WINDOW w AS (PARTITION BY category ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT category, round(CAST(sum(pos*tp/m) AS DOUBLE)/CAST(sum(pos) AS DOUBLE),6) AS average_precision FROM u GROUP BY category""")
def g3(spark, sf):
    return rounded(metrics.average_precision(view(spark, sf, "f_eval_big"), ["category"]))


@query("G4_roc_points")
def g4(spark, sf):
    return rounded(metrics.roc_points(view(spark, sf, "f_eval_big"), ["category"]))


_Q60 = "[" + ", ".join(f"{k}/59.0" for k in range(60)) + "]"
_SWEEP = f"""t AS (SELECT DISTINCT category, unnest(quantile_cont(CAST(score AS DOUBLE), {_Q60})) AS threshold FROM f_eval_big GROUP BY category),
c AS (SELECT t.category, threshold, {_COUNTS.format(p='score >= threshold')} FROM t JOIN f_eval_big e ON e.category = t.category GROUP BY 1,2)"""


@query("G5_threshold_sweep", f"{ctes('f_eval_big')}, {_SWEEP} SELECT category, round(threshold,6) AS threshold, {_RATES} FROM c")
def g5(spark, sf):
    return rounded(metrics.sweep(view(spark, sf, "f_eval_big"), ["category"]))


@query("G6_threshold_for_recall", f"""{ctes('f_eval_big')}, {_SWEEP}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY fp, threshold DESC) AS k FROM c WHERE tp >= 0.95*(tp+fn))
SELECT category, round(threshold,6) AS threshold FROM r WHERE k=1""")
def g6(spark, sf):
    return rounded(metrics.threshold_for_recall(view(spark, sf, "f_eval_big"), 0.95, ["category"]))


@query("G7_thresholds_by_category")
def g7(spark, sf):
    return rounded(metrics.thresholds_by_category(view(spark, sf, "f_eval")))


@query("G10_mixed_thresholds")
def g10(spark, sf):
    df = view(spark, sf, "f_eval")
    return rounded(metrics.mixed_by_category(df, metrics.thresholds_by_category(df), metrics.threshold_for_recall(df)))


@query("G14_outcomes", f"""{ctes('f_eval')} SELECT id, CASE WHEN y=1 THEN CASE WHEN score>=2000 THEN 'TP' ELSE 'FN' END WHEN score>=2000 THEN 'FP' ELSE 'TN' END AS outcome FROM f_eval""")
def g14(spark, sf):
    return view(spark, sf, "f_eval").select("id", metrics.outcome(F.col("y"), F.col("score") >= 2000).alias("outcome"))


@query("E17_impact_grid", f"""{ctes('f_eval_big')}, c AS (SELECT category, {_COUNTS.format(p='score >= 25')} FROM f_eval_big GROUP BY category),
r AS (SELECT category, tp/nullif(tp+fn,0) AS r, fp/nullif(fp+tn,0) AS a, unnest([0.005,0.01,0.02,0.05]) AS q FROM c),
p AS (SELECT category, r, a, CAST(q AS DOUBLE) AS p FROM r)
SELECT category, p AS prevalence, round(r*p+a*(1-p),6) AS reviewed_ratio, round(coalesce(r*p/nullif(r*p+a*(1-p),0),0),6) AS prevalence_precision, round(1000*p*(1-r),6) AS missed, round(1000*(1-p)*a,6) AS false_alarms FROM p""")
def e17(spark, sf):
    got = metrics.impact_grid(metrics.at_threshold(view(spark, sf, "f_eval_big"), F.lit(25.0), ["category"]))
    return rounded(got.select("category", "prevalence", "reviewed_ratio", "prevalence_precision", "missed", "false_alarms"))


@query("F26_separation", f"""{ctes('f_eval_big')}, s AS (SELECT category, avg(score) FILTER (y=0) AS a, avg(score) FILTER (y=1) AS b, var_pop(score) FILTER (y=0) AS v0, var_pop(score) FILTER (y=1) AS v1 FROM f_eval_big GROUP BY 1)
SELECT category, round(a,6) AS normal_mean, round(b,6) AS defect_mean, round(sqrt(v0),6) AS normal_std, round(sqrt(v1),6) AS defect_std, round((b-a)/sqrt((v0+v1)/2),6) AS cohen_d FROM s""")
def f26(spark, sf):
    return rounded(metrics.separation(view(spark, sf, "f_eval_big"), ["category"]))


@query("D9_uncertain", f"""{ctes('f_eval')}, s AS (SELECT max(score)-min(score) AS w FROM f_eval)
SELECT id, category, CAST(y AS BIGINT) AS y, score, round(1-abs(score-2000)/CASE WHEN w>0 THEN w ELSE 1 END,6) AS uncertainty FROM f_eval, s ORDER BY 1-abs(score-2000)/CASE WHEN w>0 THEN w ELSE 1 END DESC, id LIMIT 20""")
def d9(spark, sf):
    return rounded(metrics.uncertain(view(spark, sf, "f_eval"), 2000.0, 20))


# --- labels --------------------------------------------------------------------

_EV = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_seq ORDER BY seq DESC) AS k FROM f_label_events) WHERE k=1)"
_RESOLVED = f"""{ctes('f_manifest', 'f_label_events')}, {_EV},
r AS (SELECT m.seq, m.image_id, m.category, m.defect_type AS raw_defect_type, coalesce(e.label, m.label) AS label,
  {_MAP_SQL.format("CASE WHEN e.label IS NOT NULL THEN e.defect_type ELSE m.defect_type END")} AS defect_type,
  CASE WHEN e.label IS NOT NULL THEN 'human' WHEN m.label='unlabeled' THEN 'none' ELSE 'folder' END AS label_source, coalesce(e.verified, false) AS verified, m.split
  FROM f_manifest m LEFT JOIN e ON e.image_seq = m.seq)"""


def resolved(spark, sf):
    return labels.resolve(view(spark, sf, "f_manifest"), view(spark, sf, "f_label_events"), TYPE_MAP)



@query("C1_append_dedup", f"""{ctes('f_manifest')}, b AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY seq) AS k FROM f_manifest WHERE seq % 2 = 1)
SELECT seq, image_id FROM b WHERE k=1 AND sha1 NOT IN (SELECT sha1 FROM f_manifest WHERE seq % 2 = 0)""")
def c1(spark, sf):
    m = view(spark, sf, "f_manifest").select("seq", "image_id", "sha1")
    return labels.append_new(m.where("seq % 2 = 0"), m.where("seq % 2 = 1")).select("seq", "image_id")


@query("C2_latest_events", f"{ctes('f_label_events')}, {_EV} SELECT image_seq, seq, label, defect_type, verified, labeled_by FROM e")
def c2(spark, sf):
    return labels.latest(view(spark, sf, "f_label_events"), "image_seq").select("image_seq", "seq", "label", "defect_type", "verified", "labeled_by")


@query("C3_latest_reviews", f"""{ctes('f_reviews')} SELECT image_seq, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY image_seq ORDER BY seq DESC, status DESC) AS k FROM f_reviews) WHERE k=1""")
def c3(spark, sf):
    df = view(spark, sf, "f_reviews").withColumn("o", F.struct("seq", "status"))
    return labels.latest(df, "image_seq", "o").select("image_seq", "seq", "status")


@query("C4_reviewed_ids", f"{ctes('f_reviews')} SELECT DISTINCT image_seq FROM f_reviews WHERE status='ok'")
def c4(spark, sf):
    return view(spark, sf, "f_reviews").where("status = 'ok'").select("image_seq").distinct()


@query("C6_review_queue", f"{_RESOLVED} SELECT seq, image_id, category, defect_type FROM r WHERE label='defect' AND defect_type NOT IN ({_TYPES})")
def c6(spark, sf):
    return labels.review_queue(resolved(spark, sf), "unmapped").select("seq", "image_id", "category", "defect_type")


@query("C7_unmapped_types", f"{_RESOLVED} SELECT DISTINCT defect_type FROM r WHERE defect_type NOT IN ({_TYPES})")
def c7(spark, sf):
    return labels.unmapped_types(resolved(spark, sf))


@query("C9_verify_sample", f"{ctes('f_manifest')} SELECT seq, image_id FROM f_manifest ORDER BY md5(concat('7:', CAST(seq AS VARCHAR))), seq LIMIT 25")
def c9(spark, sf):
    return labels.sample(view(spark, sf, "f_manifest"), 25, 7).select("seq", "image_id")


@query("E1_resolve", f"""{_RESOLVED.replace(ctes("f_manifest", "f_label_events"), ctes("f_manifest", "f_label_events", "f_splits"))}
SELECT r.seq, r.image_id, r.label, raw_defect_type, r.defect_type, label_source, r.verified, {", ".join(f"CAST(e.{c} AS DOUBLE) AS {c}" for c in labels.ROI)}, coalesce(s.split, 'unassigned') AS split
FROM r LEFT JOIN e ON e.image_seq = r.seq LEFT JOIN f_splits s ON s.seq = r.seq""")
def e1(spark, sf):
    got = labels.resolve(view(spark, sf, "f_manifest"), view(spark, sf, "f_label_events"), TYPE_MAP, view(spark, sf, "f_splits"))
    return got.select("seq", "image_id", "label", "raw_defect_type", "defect_type", "label_source", "verified", *[F.col(c).cast("double").alias(c) for c in labels.ROI], "split")


@query("F2_progress", f"""{_RESOLVED} SELECT count(*) AS total, count(*) FILTER (label='normal') AS normal, count(*) FILTER (label='defect') AS defect, count(*) FILTER (label='unlabeled') AS unlabeled,
count(*) FILTER (label_source='human') AS human, count(*) FILTER (verified) AS verified, count(*) FILTER (label='defect' AND defect_type='unspecified') AS unspecified_type,
count(DISTINCT defect_type) FILTER (defect_type NOT IN ({_TYPES})) AS unmapped_types, count(*) FILTER (split IN ('train','val','test')) AS split_assigned FROM r""")
def f2(spark, sf):
    return labels.progress(resolved(spark, sf))


@query("F4_crosstab_source_label", f"{ctes('f_manifest')} SELECT source, count(*) FILTER (label='normal') AS normal, count(*) FILTER (label='defect') AS defect, count(*) FILTER (label='unlabeled') AS unlabeled FROM f_manifest GROUP BY source")
def f4(spark, sf):
    return labels.crosstab(view(spark, sf, "f_manifest"), ["source"], "label", ["normal", "defect", "unlabeled"])


@query("B10_group_key", f"{ctes('f_manifest')} SELECT seq, CASE WHEN trim(grp) IN ('','nan','None') THEN image_id ELSE trim(grp) END AS group_key FROM f_manifest")
def b10(spark, sf):
    return view(spark, sf, "f_manifest").select("seq", labels.group_key(F.col("grp"), F.col("image_id")).alias("group_key"))


@query("B11_quality_flags", f"""{ctes('f_manifest')} SELECT seq, concat_ws(',', CASE WHEN least(width,height)<64 THEN 'low_resolution' END, CASE WHEN blur_score<30 THEN 'blurry' END,
CASE WHEN brightness<40 THEN 'underexposed' END, CASE WHEN brightness>220 THEN 'overexposed' END) AS flags FROM f_manifest""")
def b11(spark, sf):
    df = view(spark, sf, "f_manifest")
    return df.select("seq", labels.quality_flags(df).alias("flags"))


_ALLOC = """n AS (SELECT category, label, count(*) AS n FROM f_manifest GROUP BY 1,2),
a AS (SELECT *, floor(n*0.6+1e-9) AS a, floor(n*0.2+1e-9) AS b, round(n*0.6-floor(n*0.6+1e-9),9) AS ra, round(n*0.2-floor(n*0.2+1e-9),9) AS rb FROM n),
q AS (SELECT category, label, CAST(a + CASE WHEN n-a-2*b >= CASE WHEN ra>=rb THEN 1 ELSE 3 END THEN 1 ELSE 0 END AS BIGINT) AS qa,
  CAST(b + CASE WHEN n-a-2*b >= CASE WHEN ra>=rb THEN 2 ELSE 1 END THEN 1 ELSE 0 END AS BIGINT) AS qb FROM a)"""


def _split_sql(order: str) -> str:
    return f"""{ctes('f_manifest')}, {_ALLOC}, r AS (SELECT m.seq, m.category, m.label, row_number() OVER (PARTITION BY m.category, m.label ORDER BY {order}) AS k FROM f_manifest m)
SELECT seq, CASE WHEN k<=qa THEN 'train' WHEN k<=qa+qb THEN 'val' ELSE 'test' END AS split FROM r JOIN q USING (category, label)"""


@query("D2_split_random", _split_sql("md5(concat('42:', CAST(m.seq AS VARCHAR))), m.seq"))
def d2(spark, sf):
    return labels.split_random(view(spark, sf, "f_manifest")).select("seq", "split")


@query("D3_split_by_time", _split_sql("m.ingested_epoch, m.image_id"))
def d3(spark, sf):
    return labels.split_in_order(view(spark, sf, "f_manifest"), ["ingested_epoch", "image_id"]).select("seq", "split")


#: One step a group: the largest left goes where its middle stands lowest against the target; the last groups fill empty splits.
_GROUPS = f"""{ctes('f_manifest').replace("WITH ", "WITH RECURSIVE ", 1)}, m AS (SELECT seq, category, label, CASE WHEN trim(grp) IN ('', 'nan', 'None') THEN image_id ELSE trim(grp) END AS g FROM f_manifest),
z AS (SELECT category, label, g, count(*) AS n FROM m GROUP BY 1,2,3),
o AS (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY n DESC, md5(concat('42:', g)), g) AS i, count(*) OVER (PARTITION BY category, label) AS k, sum(n) OVER (PARTITION BY category, label) AS t FROM z),
f AS (SELECT category, label, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c, '' AS split, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT category, label FROM z)
UNION ALL SELECT category, label, i, CASE WHEN s='train' THEN a+n ELSE a END, CASE WHEN s='val' THEN b+n ELSE b END, CASE WHEN s='test' THEN c+n ELSE c END, s, n FROM (
SELECT f.category, f.label, o.i, f.a, f.b, f.c, o.n, CASE WHEN (f.a=0)::INT + (f.b=0)::INT + (f.c=0)::INT >= o.k - o.i + 1 THEN CASE WHEN f.a=0 THEN 'train' WHEN f.b=0 THEN 'val' ELSE 'test' END
WHEN (f.a+o.n/2.0)/0.6 <= (f.b+o.n/2.0)/0.2 + 1e-9 AND (f.a+o.n/2.0)/0.6 <= (f.c+o.n/2.0)/0.2 + 1e-9 THEN 'train' WHEN (f.b+o.n/2.0)/0.2 <= (f.c+o.n/2.0)/0.2 + 1e-9 THEN 'val' ELSE 'test' END AS s
FROM f JOIN o ON o.category=f.category AND o.label=f.label AND o.i=f.i+1)),
q AS (SELECT category, label, n, count(*) FILTER (split='train') AS x, count(*) FILTER (split IN ('train','val')) AS y FROM f WHERE i>0 GROUP BY 1,2,3),
r AS (SELECT o.*, row_number() OVER (PARTITION BY category, label, n ORDER BY i) AS j FROM o)
SELECT m.seq, m.g, CASE WHEN r.j<=q.x THEN 'train' WHEN r.j<=q.y THEN 'val' ELSE 'test' END AS split FROM m JOIN r USING (category, label, g) JOIN q ON q.category=r.category AND q.label=r.label AND q.n=r.n"""


@query("D4_split_by_group", _GROUPS)
def d4(spark, sf):
    df = view(spark, sf, "f_manifest").withColumn("g", labels.group_key(F.col("grp"), F.col("image_id")))
    return labels.split_by_group(df, "g").select("seq", "g", "split")


@query("D5_even_sample", f"""{ctes('f_frames')}, n AS (SELECT video, count(*) AS n FROM f_frames GROUP BY 1),
k AS (SELECT DISTINCT video, CASE WHEN n<=20 THEN i ELSE CAST(floor(i*(n/20)) AS BIGINT) END AS p FROM n, LATERAL (SELECT unnest(range(0, least(n,20))) AS i))
SELECT f.video, f.pos FROM f_frames f JOIN k ON k.video=f.video AND k.p=f.pos""")
def d5(spark, sf):
    return rounded(labels.even_sample(view(spark, sf, "f_frames"), ["video"], ["pos"], 20).select("video", "pos"))


_FEEDBACK = _RESOLVED.replace(ctes("f_manifest", "f_label_events"), ctes("f_manifest", "f_label_events", "f_inference_log")) + """,
fb AS (SELECT l.seq, l.version, l.logged_at, CASE WHEN r.label='defect' THEN 1 ELSE 0 END AS y, CASE WHEN l.decision='defect' THEN 1 ELSE 0 END AS p FROM f_inference_log l JOIN r ON r.seq=l.image_seq
  WHERE r.label_source='human' AND r.verified AND r.label IN ('normal','defect'))"""


def fed_back(spark, sf):
    return labels.feedback(view(spark, sf, "f_inference_log"), resolved(spark, sf).select("seq", "label", "label_source", "verified"))


@query("E4_feedback", f"{_FEEDBACK} SELECT seq, CASE WHEN y=1 AND p=1 THEN 'TP' WHEN p=1 THEN 'FP' WHEN y=1 THEN 'FN' ELSE 'TN' END AS outcome FROM fb")
def e4(spark, sf):
    return fed_back(spark, sf).select("seq", "outcome")


def _live_sql(key: str, name: str) -> str:
    return f"""{_FEEDBACK}, c AS (SELECT {key} AS {name}, {_COUNTS.format(p='p=1')} FROM fb GROUP BY 1)
SELECT {name}, tp, fp, fn, tn, round(coalesce(tp/nullif(tp+fn,0),'NaN'::DOUBLE),6) AS recall, round(coalesce(tp/nullif(tp+fp,0),'NaN'::DOUBLE),6) AS "precision" FROM c"""


@query("G20_performance_by_version", _live_sql("version", "version"))
def g20(spark, sf):
    return rounded(metrics.live_performance(fed_back(spark, sf), ["version"]))


@query("G21_performance_by_day", _live_sql("CAST(CAST(logged_at AS DATE) AS VARCHAR)", "day"))
def g21(spark, sf):
    return rounded(metrics.live_performance(fed_back(spark, sf).where("logged_at is not null"), [F.col("logged_at").cast("date").cast("string").alias("day")]))


@query("F14_log_summary", f"""{ctes('f_inference_log')} SELECT count(*) AS total, count(DISTINCT version) AS versions, count(*) FILTER (decision='defect') AS defects, round(avg(CASE WHEN decision='defect' THEN 1.0 ELSE 0.0 END),6) AS defect_rate,
round(quantile_cont(CAST(json_extract_string(props,'$.k') AS DOUBLE),0.95),6) AS p95_latency FROM f_inference_log""")
def f14(spark, sf):
    log = view(spark, sf, "f_inference_log").withColumn("latency", F.from_json("props", "k double")["k"])
    is_defect = F.when(F.col("decision") == "defect", 1).otherwise(0)
    counted = log.agg(F.count("*").alias("total"), F.count_distinct("version").alias("versions"), F.sum(is_defect).alias("defects"), F.avg(is_defect).alias("defect_rate"))
    # Without any latency there is no quantile: a left join by a constant, one row on either side.
    q = ordered.quantiles(log, [], "latency", [0.95]).select(F.lit(1).alias("one"), F.col("q")[0].alias("p95_latency"))
    return rounded(counted.withColumn("one", F.lit(1)).join(F.broadcast(q), "one", "left").drop("one"))


@query("E3_suffix_match", f"""{ctes('f_paths')}, p AS (SELECT seq, string_split(visa_path,'/') AS s FROM f_paths),
t AS (SELECT seq, n, array_to_string(list_slice(s, len(s)-n+1, len(s)),'/') AS tail FROM p, LATERAL (SELECT unnest(range(1, len(s)+1)) AS n)),
l AS (SELECT * FROM t WHERE seq % 2 = 0), r AS (SELECT tail, count(DISTINCT seq) AS k, min(seq) AS key FROM t WHERE seq % 2 = 1 GROUP BY 1),
h AS (SELECT l.seq, l.n, k, key, row_number() OVER (PARTITION BY l.seq ORDER BY n DESC) AS b FROM l JOIN r USING (tail))
SELECT seq AS id, key FROM h WHERE b=1 AND k=1""")
def e3(spark, sf):
    p = view(spark, sf, "f_paths")
    return labels.suffix_match(p.where("seq % 2 = 0").select(F.col("seq").alias("id"), F.col("visa_path").alias("path")), p.where("seq % 2 = 1").select(F.col("seq").alias("key"), F.col("visa_path").alias("path")))


# --- segments --------------------------------------------------------------------

_RUNS = """SELECT video, min(pos) AS start, max(pos) AS "end" FROM (SELECT video, pos, sum(b) OVER (PARTITION BY video ORDER BY pos) AS island FROM
  (SELECT video, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY video ORDER BY pos) - 1 > {gap} THEN 1 ELSE 0 END AS b FROM f_frames WHERE {flag})) GROUP BY video, island"""


@query("H1_runs", f"{ctes('f_frames')} SELECT video, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM ({_RUNS.format(gap=1, flag='truth')})")
def h1(spark, sf):
    return rounded(segments.runs(view(spark, sf, "f_frames"), F.col("truth"), 1))


_SEG = f"""{ctes('f_frames')}, tr AS ({_RUNS.format(gap=0, flag='truth')}), wr AS ({_RUNS.format(gap=0, flag='predicted AND NOT truth')}),
hits AS (SELECT tr.video, tr.start, tr."end", count(*) FILTER (f.predicted) AS hits FROM tr JOIN f_frames f ON f.video=tr.video AND f.pos BETWEEN tr.start AND tr."end" GROUP BY 1,2,3),
fa AS (SELECT wr.* FROM wr WHERE NOT (wr."end"-wr.start+1 <= 2 AND EXISTS (SELECT 1 FROM tr WHERE tr.video=wr.video AND wr.start-tr."end"-1<=2 AND tr.start-wr."end"-1<=2)))"""


@query("E14_truth_hits", f"{_SEG} SELECT video, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\", CAST(hits AS BIGINT) AS hits, hits >= 1 AS caught FROM hits")
def e14(spark, sf):
    return rounded(segments.truth_hits(view(spark, sf, "f_frames")))


@query("E15_false_alarms", f"{_SEG} SELECT video, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM fa")
def e15(spark, sf):
    return rounded(segments.false_alarms(view(spark, sf, "f_frames")))


@query("H3_segment_report", f"""{_SEG}, pr AS ({_RUNS.format(gap=0, flag='predicted')}), rr AS ({_RUNS.format(gap=0, flag='predicted AND truth')}),
b AS (SELECT video, count(*) AS f, count(*) FILTER (truth) AS t, count(*) FILTER (predicted) AS p, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (predicted AND NOT truth) AS w, count(*) FILTER (NOT truth) AS n, (max(pos)-min(pos))/30.0 AS d FROM f_frames GROUP BY 1),
h AS (SELECT video, count(*) AS tr, count(*) FILTER (hits>=1) AS c FROM hits GROUP BY 1), a AS (SELECT video, count(*) AS fa FROM fa GROUP BY 1), p1 AS (SELECT video, count(*) AS pr FROM pr GROUP BY 1), r1 AS (SELECT video, count(*) AS rr FROM rr GROUP BY 1),
x AS (SELECT b.*, coalesce(tr,0) AS tr, coalesce(c,0) AS c, coalesce(fa,0) AS fa, coalesce(pr,0) AS pr, coalesce(rr,0) AS rr FROM b LEFT JOIN h USING (video) LEFT JOIN a USING (video) LEFT JOIN p1 USING (video) LEFT JOIN r1 USING (video))
SELECT video, f AS frames, tr AS truth_runs, pr AS predicted_runs, c AS caught, tr-c AS missed, fa AS false_alarms, rr AS on_target, round(coalesce(tp/nullif(t,0),'NaN'::DOUBLE),6) AS frame_recall, round(coalesce(tp/nullif(p,0),'NaN'::DOUBLE),6) AS frame_precision,
round(CAST(d AS DOUBLE),6) AS duration_sec, round(coalesce(w/nullif(n,0),0),6) AS alarm_time_ratio, round(coalesce(c/nullif(tr,0),'NaN'::DOUBLE),6) AS segment_recall, round(CASE WHEN d>0 THEN CAST(fa*60/d AS DOUBLE) ELSE 'NaN'::DOUBLE END,6) AS false_alarms_per_min, coalesce(w/nullif(n,0),0)>=0.5 AS flooding FROM x""")
def h3(spark, sf):
    return rounded(segments.report(view(spark, sf, "f_frames")))


@query("D12_highlights", f"""{ctes('f_frames')}, e AS (SELECT video, pos, score-80 AS margin, sum(b) OVER (PARTITION BY video ORDER BY pos) AS ev FROM (SELECT *, CASE WHEN pos-lag(pos) OVER (PARTITION BY video ORDER BY pos)>1 THEN 1 ELSE 0 END AS b FROM f_frames WHERE score>=80)),
p AS (SELECT video, pos, margin FROM (SELECT *, row_number() OVER (PARTITION BY video, ev ORDER BY margin DESC, pos) AS k FROM e) WHERE k=1),
a AS (SELECT * FROM p UNION ALL SELECT video, pos, score-80 FROM f_frames WHERE video NOT IN (SELECT video FROM e))
SELECT video, CAST(pos AS BIGINT) AS pos, round(margin,6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY margin DESC, pos) AS r FROM a) WHERE r<=3""")
def d12(spark, sf):
    return rounded(segments.highlights(view(spark, sf, "f_frames"), 80.0))


@query("H7_sampling_tick")
def h7(spark, sf):
    return rounded(segments.sampling_tick(view(spark, sf, "f_frames"), F.col("pos") / 30.0))


@query("H14_still_frames", MOVING)
def h14(spark, sf):
    return segments.drop_still_frames(view(spark, sf, "f_clips"))


@query("H15_changed_ratio", f"""{ctes('f_clips')} SELECT video, pos, round(len(list_filter(list_zip(cells, p), lambda z: abs(z[1] - z[2]) > 0.05)) / len(cells), 6) AS changed
FROM (SELECT *, lag(cells) OVER (PARTITION BY video ORDER BY pos) AS p FROM f_clips) WHERE p IS NOT NULL""")
def h15(spark, sf):
    return rounded(segments.changes(view(spark, sf, "f_clips")))


# --- drift -----------------------------------------------------------------------

def _sides(spark, sf):
    f = view(spark, sf, "f_features")
    return f.where("side = 'ref'").select("feature", "value"), f.where("side = 'cand'").select("feature", "value")


_BASE = f"""{ctes('f_features')}, q AS (SELECT feature, list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS u, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM f_features WHERE side='ref' GROUP BY 1),
e AS (SELECT feature, list_sort(u) AS e, m, s, n FROM q)"""


@query("I1_baseline", f"{_BASE} SELECT feature, round(m,6) AS mean, round(s,6) AS std, n, CAST(len(e) AS BIGINT) AS n_edges, round(e[2],6) AS second_edge FROM e")
def i1(spark, sf):
    b = drift.baseline(_sides(spark, sf)[0])
    return rounded(b.select("feature", "mean", "std", "n", F.size("edges").alias("n_edges"), F.get("edges", F.lit(1)).alias("second_edge")))


@query("I7_feature_drift", f"""{_BASE}, c AS (SELECT feature, count(*) AS nc, avg(value) AS mc FROM f_features WHERE side='cand' GROUP BY 1),
g AS (SELECT e.*, nc, mc, greatest(2, least(len(e)-1, CAST(floor(least(n, nc)/100) AS INT))) AS t FROM e JOIN c USING (feature)),
k AS (SELECT *, list_transform(range(0, t+1), lambda i: e[CAST(round_even(i*10.0/t, 0) AS INT)+1]) AS ce FROM g),
b AS (SELECT f.feature, f.side, len(list_filter(list_slice(k.ce, 2, len(k.ce)-1), lambda x: x <= f.value)) AS bin, any_value(len(k.ce)-1) AS bins, count(*) AS c FROM f_features f JOIN k USING (feature) GROUP BY 1,2,3),
s AS (SELECT k.feature, i.i AS bin, greatest(coalesce(r.c,0)/k.n, 1e-4) AS ex, greatest(coalesce(x.c,0)/k.nc, 1e-4) AS ac FROM k, LATERAL (SELECT unnest(range(0, len(k.ce)-1)) AS i) i
  LEFT JOIN b r ON r.feature=k.feature AND r.side='ref' AND r.bin=i.i LEFT JOIN b x ON x.feature=k.feature AND x.side='cand' AND x.bin=i.i),
p AS (SELECT feature, sum((ac-ex)*ln(ac/ex)) AS psi FROM s GROUP BY 1)
SELECT k.feature, round(psi,6) AS psi, CASE WHEN psi>0.25 THEN 'changed' WHEN psi>0.1 THEN 'watch' ELSE 'stable' END AS level, round(m,6) AS baseline_mean, round(mc,6) AS current_mean, round((mc-m)/s,6) AS shift_sigma, nc AS n_current FROM k JOIN p USING (feature)""")
def i7(spark, sf):
    ref, cand = _sides(spark, sf)
    return rounded(drift.feature_drift(drift.baseline(ref), cand))


@query("I8_drift_summary")
def i8(spark, sf):
    ref, cand = _sides(spark, sf)
    return rounded(drift.drift_summary(drift.feature_drift(drift.baseline(ref), cand)))


# --- registry --------------------------------------------------------------------

@query("B28_next_version", f"{ctes('f_registry')} SELECT project, concat('v', lpad(CAST(max(CAST(substr(version,2) AS INT))+1 AS VARCHAR),3,'0')) AS version FROM f_registry GROUP BY 1")
def b28(spark, sf):
    return registry.next_version(view(spark, sf, "f_registry"))


_TARGET = "t AS (SELECT project, version FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY promoted_at DESC, seq DESC) AS k FROM f_registry WHERE status='archived' AND promoted_at IS NOT NULL) WHERE k=1)"


@query("J6_rollback_target", f"{ctes('f_registry')}, {_TARGET} SELECT * FROM t")
def j6(spark, sf):
    return registry.rollback_targets(view(spark, sf, "f_registry"))


@query("J7_rollback", f"{ctes('f_registry')}, {_TARGET} SELECT r.project, r.version, CASE WHEN r.version=t.version THEN 'production' ELSE r.status END AS status FROM f_registry r LEFT JOIN t ON t.project=r.project")
def j7(spark, sf):
    r = view(spark, sf, "f_registry")
    return registry.promote(r, registry.rollback_targets(r), F.lit("2030-01-01").cast("timestamp_ntz")).select("project", "version", "status")


@query("D13_best_run", f"""{ctes('f_runs')} SELECT kind, run_id, round(recall,6) AS recall, round(prec,6) AS prec FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY recall DESC, prec DESC, seq) AS k FROM f_runs WHERE recall IS NOT NULL) WHERE k=1""")
def d13(spark, sf):
    runs = view(spark, sf, "f_runs").withColumns({"recall": F.col("recall").cast("double"), "prec": F.col("prec").cast("double")})
    return rounded(registry.best_run(runs, ["kind"]))


# --- boxes -----------------------------------------------------------------------

@query("E8_relative_size", f"""{ctes('f_boxes', 'f_images')} SELECT label, round(median(least(w/width, h/height)),6) AS fraction, count(*) AS boxes FROM f_boxes b JOIN f_images i USING (image_id) WHERE width>0 AND height>0 GROUP BY 1""")
def e8(spark, sf):
    return rounded(boxes.relative_size(view(spark, sf, "f_boxes"), view(spark, sf, "f_images"), ["label"]))


def _micro(a: str, b: str) -> str:
    m = f"((2000000*({a})+({b}))//(2*({b})))"
    return f"concat(CAST({m}//1000000 AS VARCHAR), '.', lpad(CAST({m}%1000000 AS VARCHAR),6,'0'))"


@query("A18_yolo", f"""{ctes('f_boxes', 'f_images')}, c AS (SELECT label, row_number() OVER (ORDER BY label)-1 AS id FROM (SELECT DISTINCT label FROM f_boxes))
SELECT image_id, string_agg(concat_ws(' ', CAST(id AS VARCHAR), {", ".join(map(_micro, ("2*x+w", "2*y+h", "w", "h"), ("2*width", "2*height", "width", "height")))}), chr(10) ORDER BY seq) AS body
FROM f_boxes JOIN c USING (label) JOIN f_images USING (image_id) WHERE width>0 AND height>0 GROUP BY 1""")
def a18(spark, sf):
    return boxes.yolo(view(spark, sf, "f_boxes"), view(spark, sf, "f_images"))


@query("F10_box_summary", f"{ctes('f_boxes')} SELECT count(*) AS boxes, count(DISTINCT image_id) AS images, count(DISTINCT label) AS labels, round(count(*)/greatest(count(DISTINCT image_id),1),6) AS per_image FROM f_boxes")
def f10(spark, sf):
    return rounded(boxes.summary(view(spark, sf, "f_boxes")))


@query("F11_class_ids", f"{ctes('f_boxes')} SELECT label, CAST(row_number() OVER (ORDER BY label)-1 AS BIGINT) AS class_id FROM (SELECT DISTINCT label FROM f_boxes)")
def f11(spark, sf):
    return boxes.class_ids(view(spark, sf, "f_boxes"))


@query("C17_replace_boxes", f"""{ctes('f_boxes')}, x AS (SELECT DISTINCT image_id FROM f_boxes WHERE image_id % 10 = 0),
k AS (SELECT * FROM f_boxes WHERE image_id NOT IN (SELECT image_id FROM x) UNION ALL SELECT * FROM f_boxes WHERE image_id % 10 = 0 AND w>=1 AND h>=1 AND label='dent')
SELECT seq, concat(CAST(image_id AS VARCHAR),'#',CAST(row_number() OVER (PARTITION BY image_id ORDER BY seq) AS VARCHAR)) AS box_id FROM k""")
def c17(spark, sf):
    b = view(spark, sf, "f_boxes")
    some = b.where("image_id % 10 = 0")
    return rounded(boxes.replace(b, some.select("image_id"), some.where("label = 'dent'")).select("seq", "box_id"))


from . import detail_queries, grid_queries, model_queries, path_queries, stream_queries, table_queries  # noqa: E402, F401 - they register theirs
