"""Queries of section K: pixel grids, anomaly models, masks and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import grids

from .fixtures import ctes, view
from .register import ORACLES, query, rounded

P = ctes("f_pixels")
_EDGES = f"""{P}, a AS (SELECT image_id, gy, gx, value, coalesce(lag(value) OVER c, lead(value) OVER c) AS u, coalesce(lead(value) OVER c, lag(value) OVER c) AS d,
  coalesce(lag(value) OVER r, lead(value) OVER r) AS l, coalesce(lead(value) OVER r, lag(value) OVER r) AS ri FROM f_pixels WINDOW r AS (PARTITION BY image_id, gy ORDER BY gx), c AS (PARTITION BY image_id, gx ORDER BY gy)),
b AS (SELECT *, u+d+l+ri-4*value AS lap, u+2*value+d AS tall, l+2*value+ri AS wide FROM a),
e AS (SELECT image_id, value, lap, sqrt(power(coalesce(lead(tall) OVER r, lag(tall) OVER r) - coalesce(lag(tall) OVER r, lead(tall) OVER r), 2) + power(coalesce(lead(wide) OVER c, lag(wide) OVER c) - coalesce(lag(wide) OVER c, lead(wide) OVER c), 2)) AS sobel
  FROM b WINDOW r AS (PARTITION BY image_id, gy ORDER BY gx), c AS (PARTITION BY image_id, gx ORDER BY gy))"""
_PATCH, _STRIDE, _SIDE, _SHRINK = 4, 2, 8, 0.05
_GRID = f"""{P}, w AS (SELECT unnest(range(0, 3)) AS k), g AS (SELECT image_id, wy.k AS py, wx.k AS px, avg(value) AS mean, stddev_pop(value) AS std FROM f_pixels
  JOIN w wy ON gy BETWEEN wy.k*2 AND wy.k*2+3 JOIN w wx ON gx BETWEEN wx.k*2 AND wx.k*2+3 GROUP BY 1,2,3),
m AS (SELECT py, px, count(*) AS n, avg(mean) AS m0, avg(std) AS m1, var_samp(mean) AS a, covar_samp(mean, std) AS b, var_samp(std) AS d FROM g GROUP BY 1,2),
i AS (SELECT *, a + {_SHRINK}*(a+d)/2 AS aa, d + {_SHRINK}*(a+d)/2 AS dd, (a + {_SHRINK}*(a+d)/2)*(d + {_SHRINK}*(a+d)/2) - b*b AS det FROM m),
s AS (SELECT image_id, py, px, sqrt(greatest((power(mean-m0,2)*dd - 2*(mean-m0)*(std-m1)*b + power(std-m1,2)*aa)/det, 0)) AS score FROM g JOIN i USING (py, px))"""


def pixels(spark, sf):
    return view(spark, sf, "f_pixels").drop("video")


def windows(spark, sf):
    return grids.sliding(pixels(spark, sf), _PATCH, _STRIDE, _SIDE, _SIDE)


def scored(spark, sf):
    g = windows(spark, sf)
    return grids.distances(g, grids.fit(g, ["mean", "std"], _SHRINK), ["mean", "std"])


@query("K1_sharpness", f"{_EDGES} SELECT image_id, round_even(var_pop(lap),2) AS blur_score, round_even(avg(value),2) AS brightness FROM e GROUP BY 1")
def k1(spark, sf):
    return grids.sharpness(pixels(spark, sf))


@query("K2_distribution", f"{P} SELECT image_id, round(avg(value),6) AS gray_mean, round(stddev_pop(value),6) AS gray_std, " + ", ".join(f"round(quantile_cont(value,{q}),6) AS gray_p{round(100*q):02d}" for q in grids.QUANTILES) + " FROM f_pixels GROUP BY 1")
def k2(spark, sf):
    return rounded(grids.distribution(pixels(spark, sf)))


@query("K3_edges", f"{_EDGES} SELECT image_id, round(avg(abs(lap)),6) AS lap_absmean, round(quantile_cont(abs(lap),0.99),6) AS lap_p99, round(avg(sobel),6) AS sobel_mean, round(stddev_pop(sobel),6) AS sobel_std, round(quantile_cont(sobel,0.95),6) AS sobel_p95 FROM e GROUP BY 1")
def k3(spark, sf):
    return rounded(grids.edges(pixels(spark, sf)))


@query("K4_deviation", f"{P}, d AS (SELECT image_id, abs(value - median(value) OVER (PARTITION BY image_id)) AS o FROM f_pixels) SELECT image_id, round(avg(CAST(o>25 AS DOUBLE)),6) AS dev_gt25, round(avg(CAST(o>50 AS DOUBLE)),6) AS dev_gt50 FROM d GROUP BY 1")
def k4(spark, sf):
    return rounded(grids.deviation(pixels(spark, sf)))


@query("K5_profiles", f"{P}, x AS (SELECT image_id, stddev_pop(m) AS c FROM (SELECT image_id, gx, avg(value) AS m FROM f_pixels GROUP BY 1,2) GROUP BY 1), y AS (SELECT image_id, stddev_pop(m) AS r FROM (SELECT image_id, gy, avg(value) AS m FROM f_pixels GROUP BY 1,2) GROUP BY 1) SELECT image_id, round(c,6) AS col_profile_std, round(r,6) AS row_profile_std FROM x JOIN y USING (image_id)")
def k5(spark, sf):
    return rounded(grids.profiles(pixels(spark, sf)))


@query("K6_histogram", f"{P} SELECT image_id, " + ", ".join(f"round(count(*) FILTER (floor(value/16)={i}) / count(*),6) AS hist_{i:02d}" for i in range(16)) + " FROM f_pixels WHERE value >= 0 AND value < 256 GROUP BY 1")
def k6(spark, sf):
    return rounded(grids.histogram(pixels(spark, sf)))


_RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


@query("K7_binary_patterns", f"{P}, n AS (SELECT c.image_id, c.gy, c.gx, count(*) AS k, sum(CASE WHEN o.value >= c.value THEN CASE " + " ".join(f"WHEN o.gy-c.gy={y} AND o.gx-c.gx={x} THEN {1 << k}" for k, (y, x) in enumerate(_RING)) + " END ELSE 0 END) AS code FROM f_pixels c JOIN f_pixels o ON o.image_id=c.image_id AND abs(o.gy-c.gy)<=1 AND abs(o.gx-c.gx)<=1 AND (o.gy<>c.gy OR o.gx<>c.gx) GROUP BY 1,2,3) SELECT image_id, " + ", ".join(f"round(count(*) FILTER (floor(code/16)={i}) / count(*),6) AS lbp_{i:02d}" for i in range(16)) + " FROM n WHERE k=8 GROUP BY 1")
def k7(spark, sf):
    return rounded(grids.binary_patterns(pixels(spark, sf)))


@query("K8_sliding_windows", f"{_GRID} SELECT image_id, py, px, round(mean,6) AS mean, round(std,6) AS std FROM g")
def k8(spark, sf):
    return rounded(windows(spark, sf))


@query("K10_anomaly_fit", f"{_GRID} SELECT py, px, n, round(m0,6) AS m0, round(m1,6) AS m1, round(dd/det,6) AS i00, round(-b/det,6) AS i01, round(aa/det,6) AS i11 FROM i")
def k10(spark, sf):
    m = grids.fit(windows(spark, sf), ["mean", "std"], _SHRINK)
    at = lambda c, i: F.col(c)[i]
    return rounded(m.select("py", "px", "n", at("centre", 0).alias("m0"), at("centre", 1).alias("m1"), at("inverse", 0).alias("i00"), at("inverse", 1).alias("i01"), at("inverse", 3).alias("i11")))


@query("K11_anomaly_scores", f"{_GRID} SELECT image_id, py, px, round(score,6) AS score FROM s")
def k11(spark, sf):
    return rounded(scored(spark, sf))


@query("K12_image_scores", f"{_GRID} SELECT image_id, round(max(score),6) AS max, round(avg(score),6) AS mean, round(quantile_cont(score,0.999),6) AS p999, round(quantile_cont(score,0.99),6) AS p99, round(quantile_cont(score,0.95),6) AS p95 FROM s GROUP BY 1")
def k12(spark, sf):
    return rounded(grids.image_scores(scored(spark, sf)))


def cells(spark, sf):
    return view(spark, sf, "f_cells").select("image_id", F.col("cy").alias("gy"), F.col("cx").alias("gx"))


@query("K13_bounding_box", f"{ctes('f_cells')} SELECT image_id, min(cx) AS x, min(cy) AS y, max(cx)-min(cx)+1 AS w, max(cy)-min(cy)+1 AS h, count(*) AS area FROM f_cells GROUP BY 1")
def k13(spark, sf):
    return rounded(grids.bounding_boxes(cells(spark, sf), ["image_id"]))


#: The components by reachability, in SQL's own way: labels spread over neighbours until none changes.
_BLOBS = f"""{ctes('f_cells').replace('WITH f_cells AS', 'WITH RECURSIVE f_cells AS MATERIALIZED')}, n AS (SELECT a.image_id, a.cy*1000+a.cx AS f, b.cy*1000+b.cx AS t FROM f_cells a JOIN f_cells b ON a.image_id=b.image_id AND abs(a.cy-b.cy)<=1 AND abs(a.cx-b.cx)<=1),
r AS (SELECT image_id, f, t FROM n UNION SELECT r.image_id, r.f, n.t FROM r JOIN n ON n.image_id=r.image_id AND n.f=r.t), b AS (SELECT image_id, f//1000 AS cy, f%1000 AS cx, min(t) AS blob FROM r GROUP BY image_id, f),
x AS (SELECT image_id, min(cx) AS x, min(cy) AS y, max(cx)-min(cx)+1 AS w, max(cy)-min(cy)+1 AS h, count(*) AS area FROM b GROUP BY image_id, blob HAVING count(*) >= {grids.LEAST_AREA})"""


@query("K14_blob_boxes", f"{_BLOBS} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY w*h DESC, y, x) AS BIGINT) AS k, x, y, w, h, area FROM x")
def k14(spark, sf):
    return rounded(grids.boxes_of(cells(spark, sf)))


@query("K15_mask_outcomes", f"""{_BLOBS}, d AS (SELECT DISTINCT l_orderkey % 10 AS image_id FROM lineitem WHERE l_returnflag NOT IN ('N','R') AND CAST(l_quantity AS INT) = 1)
SELECT s_suppkey AS image_id, CASE WHEN s_suppkey IN (SELECT image_id FROM d) THEN 'existing' WHEN s_suppkey NOT IN (SELECT image_id FROM f_cells) THEN 'no_mask' WHEN s_suppkey NOT IN (SELECT image_id FROM x) THEN 'all_specks' ELSE 'drawn' END AS reason FROM supplier""")
def k15(spark, sf):
    c = cells(spark, sf)
    images = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("image_id"))
    boxed = view(spark, sf, "f_boxes").where("label = 'dent' and w = 0").select((F.col("image_id") % 10).alias("image_id"))
    return grids.mask_outcomes(images, boxed, grids.boxes_of(c), c)


@query("K17_cut_level", f"{ctes('f_score_map')} SELECT image_id, round(CASE WHEN image_id % 2 = 0 AND max(score) < 100000 THEN quantile_cont(score,0.995) ELSE 100000 END,6) AS level FROM f_score_map GROUP BY 1")
def k17(spark, sf):
    m = view(spark, sf, "f_score_map")
    chosen = m.select("image_id").distinct().withColumn("decision", F.when(F.col("image_id") % 2 == 0, "defect").otherwise("normal"))
    return rounded(grids.cut_levels(m, 100000.0, chosen))


#: The same reachability over the cells of the score map that reach its level.
_HOT = f"""{ctes('f_score_map').replace('WITH f_score_map AS', 'WITH RECURSIVE f_score_map AS MATERIALIZED')}, lv AS (SELECT image_id, count(*) AS cells, CASE WHEN image_id % 2 = 0 AND max(score) < 70000 THEN quantile_cont(score, 0.995) ELSE 70000 END AS level FROM f_score_map GROUP BY 1),
c AS MATERIALIZED (SELECT image_id, (pos - 1) // 24 AS cy, (pos - 1) % 24 AS cx FROM f_score_map JOIN lv USING (image_id) WHERE score >= level),
n AS MATERIALIZED (SELECT a.image_id, a.cy*1000+a.cx AS f, b.cy*1000+b.cx AS t FROM c a JOIN c b ON a.image_id=b.image_id AND abs(a.cy-b.cy)<=1 AND abs(a.cx-b.cx)<=1),
r AS (SELECT image_id, f, t FROM n UNION SELECT r.image_id, r.f, n.t FROM r JOIN n ON n.image_id=r.image_id AND n.f=r.t), b AS (SELECT image_id, f//1000 AS cy, f%1000 AS cx, min(t) AS blob FROM r GROUP BY image_id, f),
x AS (SELECT image_id, min(cx) AS x, min(cy) AS y, max(cx)-min(cx)+1 AS w, max(cy)-min(cy)+1 AS h, count(*) AS area FROM b JOIN lv USING (image_id) GROUP BY image_id, blob, cells HAVING count(*) >= greatest({grids.LEAST_AREA}, 0.0002 * cells))"""


@query("K16_score_map_boxes", f"{_HOT}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY area DESC, y, x) AS BIGINT) AS k FROM x) SELECT image_id, k, x, y, w, h, area FROM o WHERE k <= 8")
def k16(spark, sf):
    m = view(spark, sf, "f_score_map").select("image_id", "score", F.floor((F.col("pos") - 1) / 24).alias("gy"), ((F.col("pos") - 1) % 24).alias("gx"))
    chosen = m.select("image_id").distinct().withColumn("decision", F.when(F.col("image_id") % 2 == 0, "defect").otherwise("normal"))
    return rounded(grids.score_map_boxes(m, 70000.0, chosen))


@query("K18_single_boxes", f"{ctes('f_boxes')} SELECT seq, image_id FROM f_boxes WHERE w >= 1 AND h >= 1")
def k18(spark, sf):
    return view(spark, sf, "f_boxes").where("x is not null and y is not null and w >= 1 and h >= 1").select("seq", "image_id")


@query("K19_retyped", f"{ctes('f_boxes')} SELECT seq, CASE WHEN label='unspecified' AND image_id % 2 = 0 THEN 'hole' ELSE label END AS label FROM f_boxes")
def k19(spark, sf):
    return grids.retyped(view(spark, sf, "f_boxes"), F.when(F.col("image_id") % 2 == 0, "hole")).select("seq", "label")


@query("K23_features_to_compute", f"{P} SELECT DISTINCT image_id FROM f_pixels WHERE image_id % 3 <> 0")
def k23(spark, sf):
    rows = view(spark, sf, "f_pixels").select("image_id").distinct().withColumn("stamp", F.concat_ws(":", F.lit("1"), "image_id"))
    mark = grids.stamp(["hist", "16"])
    stored = rows.withColumn("definition", F.when(F.col("image_id") % 3 == 0, mark).otherwise("older"))
    return grids.to_compute(rows, stored, mark).select("image_id")


ORACLES["K25_batch_scores"] = f"{_GRID} SELECT image_id, round(max(score),6) AS score, 3.0::DOUBLE AS threshold, CASE WHEN max(score) >= 3 THEN 'defect' ELSE 'normal' END AS decision FROM s GROUP BY 1"
