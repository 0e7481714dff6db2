"""Forms that do without one task for a group: against numpy and plain Python on small frames."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import components, drift, grids, labels, learners, metrics, ordered, segments, tables
from labelloom.plans.queries import QUERIES
from labelloom.sources import tables as sources

SF = "/root/testdata/sf0.001"


def test_quantiles_are_numpys(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(997)], "b": [float(rng.randint(0, 4)) for _ in range(200)], "c": [3.0], "d": [1.0, None, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for at in ([0.5], [0.05, 0.25, 0.5, 0.75, 0.95], [k / 10 for k in range(11)], [k / 59 for k in range(60)]):
        got = {r["g"]: r for r in ordered.quantiles(df, ["g"], "v", at).collect()}
        for g, vs in groups.items():
            vs = [v for v in vs if v is not None]
            assert got[g]["n"] == len(vs) and np.allclose(got[g]["q"], np.quantile(vs, at))
    assert ordered.quantiles(df.where("g = 'x'"), ["g"], "v", [0.5]).count() == 0
    assert np.allclose(ordered.quantiles(df, [], "v", [0.3]).first()["q"], np.quantile([v for vs in groups.values() for v in vs if v is not None], 0.3))


def test_prefix_sums_cross_ranges(spark):
    rows = [(g, float(v), v % 3, 1) for g in "ab" for v in range(300)]
    got = ordered.prefix_sums(spark.createDataFrame(rows, "g string, v double, p long, c long"), ["g"], "v", ["p", "c"]).orderBy("g", "v").collect()
    for r in got:
        v = int(r["v"])
        assert (r["under_c"], r["total_c"], r["under_p"]) == (v, 300, sum(x % 3 for x in range(v))) and r["prev_p"] == ((v - 1) % 3 if v else None)


def test_ranking_measures_of_many_scores(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 3)) for _ in range(3000)]
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = metrics.ranking(spark.createDataFrame(rows, "y int, score double")).first()
    pos, neg = s[y == 1], s[y == 0]
    auroc = ((pos[:, None] > neg[None]).sum() + (pos[:, None] == neg[None]).sum() / 2) / (len(pos) * len(neg))
    steps = [((s == t) & (y == 1)).sum() / len(pos) * ((s >= t) & (y == 1)).sum() / (s >= t).sum() for t in np.unique(s)]
    assert abs(got["auroc"] - auroc) < 1e-9 and abs(got["average_precision"] - sum(steps)) < 1e-9
    curve = {(round(r["fpr"], 9), round(r["tpr"], 9)) for r in metrics.roc_points(spark.createDataFrame(rows, "y int, score double")).collect()}
    assert (0.0, 0.0) in curve and (1.0, 1.0) in curve


def test_components_follow_long_chains(spark):
    rng = random.Random(3)
    order = list(range(400))
    rng.shuffle(order)
    edges = [(order[k], order[k + 1]) for k in range(300)] + [(order[k], order[k + 2]) for k in range(310, 398)]
    root = {k: k for k in range(400)}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    nodes = spark.range(400)
    got = {r["id"]: r["label"] for r in components.connected(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: top(k) for k in range(400)}
    assert components.connected(nodes, spark.createDataFrame([], "a long, b long")).where("id <> label").count() == 0


def test_blobs_are_those_of_a_flood_fill(spark):
    rng = random.Random(4)
    cells = {(i, y, x) for i in range(3) for y in range(70) for x in range(150) if rng.random() < (0.3, 0.42, 0.5)[i]}
    left, want = set(cells), []
    while left:
        edge, blob = [left.pop()], set()
        while edge:
            i, y, x = edge.pop()
            blob.add((i, y, x))
            for c in [(i, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if c in left:
                    left.discard(c)
                    edge.append(c)
        ys, xs = [c[1] for c in blob], [c[2] for c in blob]
        if len(blob) >= 9:
            want.append((next(iter(blob))[0], min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(blob)))
    got = grids.boxes_of(spark.createDataFrame(list(cells), "image_id long, gy long, gx long"))
    assert sorted((r["image_id"], r["x"], r["y"], r["w"], r["h"], r["area"]) for r in got.collect()) == sorted(want)
    sizes = spark.createDataFrame([(k, 70 * 150 * 100) for k in range(3)], "image_id long, cells long")
    large = grids.boxes_of(spark.createDataFrame(list(cells), "image_id long, gy long, gx long"), most=2, share=0.0002, sizes=sizes)
    assert sorted(r["area"] for r in large.collect()) == sorted(a for i in range(3) for a in sorted((w[5] for w in want if w[0] == i and w[5] >= 210), reverse=True)[:2])


def brute_report(t, p, min_hits, gap):
    def runs(f):
        out = []
        for k, x in enumerate(f):
            if x:
                if out and k - out[-1][1] - 1 <= gap:
                    out[-1][1] = k
                else:
                    out.append([k, k])
        return out

    truth = runs(t)
    caught = sum(sum(p[a : b + 1]) >= max(min_hits, 1) for a, b in truth)
    wrong = runs([b and not a for a, b in zip(t, p, strict=True)])
    near = lambda w: any(w[0] - x[1] - 1 <= 2 and x[0] - w[1] - 1 <= 2 for x in truth)
    alarms = sum(not (w[1] - w[0] + 1 <= 2 and near(w)) for w in wrong)
    return len(truth), len(runs(p)), caught, alarms, len(runs([a and b for a, b in zip(t, p, strict=True)]))


def test_one_pass_report_equals_separate_runs(spark):
    rng = random.Random(5)
    videos = {v: [(rng.random() < share, rng.random() < other) for _ in range(rng.randint(1, 60))] for v, (share, other) in enumerate([(0.5, 0.5), (0.1, 0.4), (0.9, 0.1), (0.0, 0.5), (0.3, 0.0)] * 8)}
    rows = [(v, k, t, p) for v, f in videos.items() for k, (t, p) in enumerate(f)]
    df = spark.createDataFrame(rows, "video long, pos long, truth boolean, predicted boolean")
    for gap, min_hits in ((0, 1), (1, 2), (3, 1)):
        got = {r["video"]: tuple(r[c] for c in ("truth_runs", "predicted_runs", "caught", "false_alarms", "on_target")) for r in segments.report(df, min_hits, gap).collect()}
        assert got == {v: brute_report([t for t, _ in f], [p for _, p in f], min_hits, gap) for v, f in videos.items()}
    plan = segments.report(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fold_goes_on_from_an_earlier_one(spark):
    rng = random.Random(6)
    rows = [(v, p, [round(rng.random() * (p % 7 == 0) + 0.01 * p, 3) for _ in range(6)]) for v in range(4) for p in range(60)]
    frames = spark.createDataFrame(rows, "video long, pos long, cells array<double>").withColumn("drops", F.lit(None).cast("int"))
    whole = {(r["video"], r["pos"]) for r in segments.fold_frames(frames).where("kept").collect()}
    first = segments.fold_frames(frames.where("pos < 31")).collect()
    rest = segments.fold_frames(frames.where("pos >= 31").unionByName(spark.createDataFrame([(r["video"], r["pos"], r["cells"], r["drops"]) for r in first if not r["kept"]], "video long, pos long, cells array<double>, drops int"))).where("kept")
    assert {(r["video"], r["pos"]) for r in first if r["kept"]} | {(r["video"], r["pos"]) for r in rest.collect()} == whole and len(whole) < len(rows)
    want, last, drops = set(), {}, {}
    for v, p, c in rows:
        if v not in last or sum(abs(a - b) > 0.05 for a, b in zip(c, last[v], strict=True)) >= 0.005 * len(c) or drops[v] >= 20:
            want.add((v, p))
            last[v], drops[v] = c, 0
        else:
            drops[v] += 1
    assert whole == want
    assert segments.drop_still_frames(frames.where("video > 9").drop("drops")).count() == 0


def test_baseline_shares_are_its_bins(spark):
    rng = random.Random(7)
    rows = [("f", rng.gauss(0, 1)) for _ in range(500)] + [("g", float(rng.randint(0, 2))) for _ in range(300)] + [("h", 1.0)] * 5
    got = {r["feature"]: r for r in drift.baseline(spark.createDataFrame(rows, "feature string, value double")).collect()}
    for f in ("f", "g"):
        v = np.array([x for n, x in rows if n == f])
        edges = np.unique(np.quantile(v, np.linspace(0, 1, 11)))
        counts = np.histogram(v, np.concatenate([[-np.inf], edges[1:-1], [np.inf]]))[0]
        assert np.allclose(got[f]["edges"], edges) and np.allclose(got[f]["props"], counts / len(v)) and got[f]["n"] == len(v)
    assert got["h"]["edges"] == [1.0] and got["h"]["props"] == [1.0]


def test_a_wrong_number_of_shares_is_an_error(spark):
    base = spark.createDataFrame([("f", [0.0, 1.0, 2.0], [1.0], 0.0, 1.0, 9)], "feature string, edges array<double>, props array<double>, mean double, std double, n long")
    with pytest.raises(Exception, match="wrong number of shares"):
        drift.baseline_psi(base, spark.createDataFrame([("f", 0.5)], "feature string, value double")).collect()


def test_halves_are_exact(spark):
    df = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(101)], "id long, y int")
    got = {r["y"]: (r["a"], r["n"]) for r in tables.half_split(df, "y", "id").groupBy("y").agg(F.count_if("first").alias("a"), F.count("*").alias("n")).collect()}
    assert got == {0: (33, 67), 1: (17, 34)}


def test_halves_move_no_row_and_lose_none(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else k % 2, f"x{k}") for k in range(100)] + [(200, 7, "alone")], "id long, y int, note string")
    got = tables.half_split(df, "y", "id")
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and got.columns == ["id", "y", "note", "first"]
    rows = got.collect()
    assert sorted(r["note"] for r in rows) == sorted(r["note"] for r in df.collect())
    for y, size in ((None, 20), (0, 40), (1, 40), (7, 1)):
        seeded = sorted((hashlib.md5(f"42:{r['id']}".encode()).hexdigest(), r["id"]) for r in rows if r["y"] == y)
        assert len(seeded) == size and {i for _, i in seeded[: size // 2]} == {r["id"] for r in rows if r["y"] == y and r["first"]}


def test_validation_reads_its_rows_once(spark):
    got = QUERIES["G17_validation"](spark, SF)
    assert got.inputFiles() and not [f for f in got.inputFiles() if "testdata" in f]


def test_splits_and_regions_reach_the_resolved_rows(spark):
    m = spark.createDataFrame([(1, "normal", "none", "train"), (2, "unlabeled", "none", "train"), (3, "defect", "glue", "val")], "seq long, label string, defect_type string, split string")
    events = spark.createDataFrame([(1, 2, "defect", "scratch", True, 5, 6, 7, 8), (2, 3, "normal", "none", False, None, None, None, None)], "seq long, image_seq long, label string, defect_type string, verified boolean, roi_x long, roi_y long, roi_w long, roi_h long")
    splits = spark.createDataFrame([(1, "test")], "seq long, split string")
    got = {r["seq"]: r for r in labels.resolve(m, events, {}, splits).collect()}
    assert [got[k]["split"] for k in (1, 2, 3)] == ["test", "unassigned", "unassigned"] and [got[2][c] for c in labels.ROI] == [5, 6, 7, 8] and got[3]["roi_x"] is None
    assert {r["split"] for r in labels.resolve(m, events, {}, splits.limit(0)).collect()} == {"train", "val"}


def test_files_of_either_encoding_are_read_and_others_refused(spark, tmp_path):
    names = {"seq": ("이미지",), "label": ("라벨",)}
    for encoding in ("utf-8-sig", "cp949"):
        (tmp_path / encoding).write_bytes("이미지,라벨\na.png,불량\nb.png,\n".encode(encoding))
        got = sources.official_split(spark, str(tmp_path / encoding), names)
        assert sorted(map(tuple, got.collect())) == [("a.png", "불량"), ("b.png", None)]
    (tmp_path / "odd").write_bytes(b"a,b\n1,\xff\xff\n")
    with pytest.raises(ValueError, match="none of the encodings"):
        sources.official_split(spark, str(tmp_path / "odd"), names)


def test_a_table_of_two_generations_is_read_and_a_strange_one_left_alone(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = spark.createDataFrame([], "id long, grp string").schema
    spark.range(3).write.parquet(path)
    spark.range(3, 5).withColumn("grp", F.lit("g")).write.mode("append").parquet(path)
    assert sorted(map(tuple, sources.grown(spark, path, schema).collect())) == [(0, None), (1, None), (2, None), (3, "g"), (4, "g")]
    spark.range(1).withColumn("theirs", F.lit(1)).write.mode("append").parquet(path)
    assert sources.grown(spark, path, schema) is None and spark.read.parquet(path).count() == 6


def test_videos_are_listed_root_by_root_once(spark, tmp_path):
    for name in ("b/x.mp4", "b/in/y.MOV", "a/z.avi", "a/no.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"1")
    roots = [str(tmp_path / "b"), str(tmp_path)]
    assert [r["path"].rsplit("/", 1)[1] for r in sources.videos(spark, roots).collect()] == ["y.MOV", "x.mp4", "z.avi"]
    assert sources.videos(spark, roots, 2).count() == 2


def test_probabilities_come_from_models_that_never_saw_the_row(spark):
    rng = random.Random(8)
    rows = [(k, [rng.gauss(k % 2, 0.7), rng.gauss(0, 1)], k % 2) for k in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, y int")
    got = learners.cross_fitted(df)
    assert got.count() == 240 and got.select("vec_id").distinct().count() == 240
    assert metrics.auroc(got.select("y", F.col("probability").alias("score"))).first()["auroc"] > 0.75
    noise = df.withColumn("y", F.pmod(F.xxhash64("vec_id"), F.lit(2)).cast("int"))
    assert metrics.auroc(learners.cross_fitted(noise, "forest").select("y", F.col("probability").alias("score"))).first()["auroc"] < 0.65


def test_classifiers_and_their_features_are_told(spark):
    got = {r["kind"]: r["auroc"] for r in QUERIES["K20_classifiers"](spark, SF).collect()}
    assert set(got) == set(learners.KINDS) and all(0.3 <= x <= 1 for x in got.values())
    weights = [r["importance"] for r in QUERIES["D14_strongest_features"](spark, SF).collect()]
    assert len(weights) == 15 and weights == sorted(weights, reverse=True)
    said = QUERIES["K21_defect_probability"](spark, SF).collect()
    assert len(said) == 500 and all(0 <= r["probability"] <= 1 for r in said)
    assert abs(sum(r["importance"] for r in QUERIES["K22_feature_importance"](spark, SF).collect())) <= 1.0001
