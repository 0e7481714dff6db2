"""Queues, counts and advice over the labelled tables (sections C to F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.sources.scratch import sized, written

from .labels import even_sample

LEAST_DEFECTS, LEAST_NORMALS, THIN_CLASS = 10, 15, 50
SPLITS = ("train", "val", "test")


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def without_source(manifest: DataFrame, source: str) -> DataFrame:
    """Rows of other sources; a null source is another one."""
    return manifest.where(~F.col("source").eqNullSafe(F.lit(source)))


def in_scope(manifest: DataFrame, scope: str, value: str | None = None, limit: int | None = None, key: str = "seq") -> DataFrame:
    """Rows to run a model on: all, test, unlabeled, or those of one category or group, the first ``limit`` of them by key if given.

    A category that is not there, or none, is the first by name.
    """
    if scope == "category":
        known = manifest.where(F.col("category").isNotNull()).agg(F.max(F.when(F.col("category") == value, value)), F.min("category")).first()
        value = known[0] or known[1]
    tests = {"all": F.lit(True), "test": F.col("split") == "test", "unlabeled": F.col("label") == "unlabeled", "category": F.col("category") == value, "group": F.trim("grp") == value}
    rows = manifest.where(tests[scope])
    return rows.orderBy(key).limit(limit) if limit is not None else rows


def largest_group(df: DataFrame, group: str) -> DataFrame:
    """One row: the group of most rows, of equal ones the last by name."""
    return df.where(F.trim(group) != "").groupBy(group).count().agg(F.max_by(group, F.struct("count", group)).alias(group))


def video_subset(df: DataFrame, group: str, order: list[str], limit: int, name: str | None = None) -> DataFrame:
    """An even sample of the frames of one video, the largest unless ``name`` is one of them."""
    known = df.where(F.trim(group) != "").groupBy(group).count()
    picked = known.agg(F.coalesce(F.max(F.when(F.col(group) == F.lit(name), F.col(group))), F.max_by(group, F.struct("count", group)))).first()[0]
    return even_sample(df.where(F.col(group) == picked), [group], order, limit)


def half_split(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Adds first: whether the row lies in the half of its label that thresholds are chosen on.

    The first floor(n / 2) of a label's n rows in seeded order. Rows are counted by the first digits of their hash; the
    last row of the half is found among those of one count, and every row compared with it: no row is shuffled for it,
    and no label sorted. Rows that share a key stand on one side.
    """
    rows = written(df, "halves")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    at, near = F.struct(order.alias("hash"), F.col(key).alias("key")), F.substring(order, 1, 4)
    counts = rows.groupBy(F.col(label).alias("label"), near.alias("near")).agg(F.count("*").alias("c"))
    group = Window.partitionBy("label")
    upto = counts.select("label", "near", "c", F.sum("c").over(group.orderBy("near")).alias("upto"), F.floor(F.sum("c").over(group) / 2).alias("half"))
    here = written(upto.where((F.col("upto") - F.col("c") < F.col("half")) & (F.col("half") <= F.col("upto"))).select("label", "near", (F.col("half") - F.col("upto") + F.col("c")).alias("r")), "near")
    some = rows.select(F.col(label).alias("own"), at.alias("at")).join(sized(here), F.col("own").eqNullSafe(F.col("label")) & (F.substring("at.hash", 1, 4) == F.col("near")))
    last = some.withColumn("place", F.row_number().over(group.orderBy("at"))).where("place = r").select("label", F.col("at").alias("last"))
    last = written(last.withColumnsRenamed({"label": "half_label", "last": "half_last"}), "last")
    both = rows.join(sized(last), F.col(label).eqNullSafe(F.col("half_label")), "left")
    return both.withColumn("first", F.coalesce(at <= F.col("half_last"), F.lit(False))).drop("half_label", "half_last")


def last_batch(log: DataFrame, at: str = "logged_at") -> DataFrame:
    """Per version, of its last day: n, how many of each decision, mean latency, rows that failed, having no score."""
    per_day = log.groupBy("version", F.to_date(at).alias("day")).agg(F.count("*").alias("n"), count_if(F.col("decision") == "defect").alias("defect"), count_if(F.col("decision") == "normal").alias("normal"), F.avg("latency").alias("latency_mean"), count_if(F.col("score").isNull()).alias("failed"))
    figures = F.struct(F.col("day").cast("string").alias("day"), "n", "defect", "normal", "latency_mean", "failed")
    return per_day.groupBy("version").agg(F.max_by(figures, "day").alias("x")).select("version", "x.*")


def balance(df: DataFrame) -> DataFrame:
    """normal, defect and their ratio, null unless it is 5 or more or a fifth or less."""
    got = df.agg(count_if(F.col("label") == "normal").alias("normal"), count_if(F.col("label") == "defect").alias("defect"))
    ratio = F.when((F.col("normal") > 0) & (F.col("defect") > 0), F.col("normal") / F.col("defect"))
    return got.withColumn("ratio", F.when((ratio >= 5) | (ratio <= 0.2), ratio))


def advice(df: DataFrame) -> DataFrame:
    """Which family of models the train split allows (F19): supervised needs defects, anomaly detection needs normals."""
    train = F.col("split") == "train"
    got = df.agg(count_if(train & (F.col("label") == "normal")).alias("normals"), count_if(train & (F.col("label") == "defect")).alias("defects"))
    blocked = {"baseline_blocked": F.col("defects") == 0, "anomaly_blocked": F.col("normals") == 0}
    supervised = (F.col("anomaly_blocked") & ~F.col("baseline_blocked")) | (F.col("defects") >= LEAST_DEFECTS)
    return got.withColumns(blocked).withColumns({"recommended": F.when(supervised, "baseline").otherwise("anomaly"), "few_normals": (F.col("normals") > 0) & (F.col("normals") < LEAST_NORMALS)})


def readiness(df: DataFrame) -> DataFrame:
    """ready and the problems that stand against training."""
    labelled = F.col("label").isin("normal", "defect")
    got = df.agg(*[count_if(labelled & (F.col("split") == s)).alias(s) for s in ("train", "test")], count_if(labelled).alias("n"), F.count_distinct(F.when(labelled & (F.col("split") == "train"), F.col("label"))).alias("kinds"))
    problems = F.array(F.when(F.col("n") == 0, "no_labels"), *[F.when((F.col("n") > 0) & (F.col(s) == 0), f"no_{s}") for s in ("train", "test")], F.when((F.col("train") > 0) & (F.col("kinds") < 2), "one_kind"))
    return got.select(F.array_join(F.array_compact(problems), ",").alias("problems")).withColumn("ready", F.col("problems") == "")


def export_outcomes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, split, reason of every image: the first test that it fails, or exported."""
    boxed = boxes.select("image_id").distinct().withColumn("boxed", F.lit(True))
    df = images.join(boxed.hint("merge"), "image_id", "left")
    reason = F.when(F.col("width").isNull() | (F.col("width") <= 0), "unreadable").when(~F.col("split").isin(*SPLITS), "no_split").when((F.col("label") == "defect") & F.col("boxed").isNull(), "defect_without_box").when(F.col("label") == "unlabeled", "unlabeled")
    return df.select("image_id", "split", "label", F.coalesce(reason, F.lit("exported")).alias("reason"))


def export_usable(outcomes: DataFrame) -> DataFrame:
    """usable and what blocks an export: it needs a defect and a train image."""
    out = F.col("reason") == "exported"
    got = outcomes.agg(count_if(out & (F.col("label") == "defect")).alias("positives"), count_if(out & (F.col("split") == "train")).alias("train_rows"))
    return got.withColumn("blocked_by", F.when(F.col("positives") == 0, "no_positives").when(F.col("train_rows") == 0, "no_train").otherwise("")).withColumn("usable", F.col("blocked_by") == "")


def split_gap(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """How many images no split holds, labelled and boxed ones among them."""
    df = images.join(boxes.select("image_id").distinct().withColumn("boxed", F.lit(True)).hint("merge"), "image_id", "left")
    free = ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    return df.agg(F.count("*").alias("total"), count_if(~free).alias("assigned"), count_if(free & F.col("label").isin("normal", "defect")).alias("labelled_unassigned"), count_if(free & F.col("boxed")).alias("boxed_unassigned"))


def detection_readiness(boxes: DataFrame, images: DataFrame, least: int = THIN_CLASS) -> DataFrame:
    """One row: images with boxes, boxes, classes, boxes by class as JSON, thin classes, images that a split holds, ready.

    Ready means boxes on ``least`` images or more and a split assigned.
    """
    per = boxes.groupBy("label").agg(F.count("*").alias("count"))
    thin = F.col("count") < least
    kinds = per.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("boxes"), F.count("*").alias("classes"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "count"))))).alias("per_class"), F.array_join(F.sort_array(F.collect_list(F.when(thin, F.col("label")))), ",").alias("thin"))
    drawn = boxes.agg(F.count_distinct("image_id").alias("images_with_boxes"))
    held = images.agg(count_if(F.col("split").isin(*SPLITS)).alias("splits_assigned"))
    got = kinds.crossJoin(F.broadcast(drawn)).crossJoin(F.broadcast(held))
    return got.withColumn("ready", (F.col("images_with_boxes") >= least) & (F.col("splits_assigned") > 0))


def still_rate(frames: DataFrame, kept: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """Per video: frames scanned and dropped, the rate, and whether most were dropped."""
    all_ = frames.select("video", "pos").distinct().groupBy("video").agg(F.count("*").alias("scanned"))
    held = kept.groupBy("video").agg(F.count("*").alias("kept"))
    got = all_.join(held.hint("merge"), "video", "left").withColumn("dropped", F.col("scanned") - F.coalesce("kept", F.lit(0)))
    return got.select("video", "scanned", "dropped", (F.col("dropped") / F.col("scanned")).alias("rate")).withColumn("mostly_dropped", (F.col("scanned") >= least) & (F.col("rate") >= share))


def trace(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """key, stage, at, detail: what each table says of a row, as JSON; for one image filter by key."""
    out = None
    for stage, df in sources.items():
        rows = df.select(key, F.lit(stage).alias("stage"), F.col("seq").cast("long").alias("at"), F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out


def json_rows(df: DataFrame) -> DataFrame:
    """One column, row: each row as JSON with null for numbers that JSON lacks."""
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("row"))


#: What the quality flags say in words.
WORDS = {"low_resolution": "too small", "blurry": "out of focus", "underexposed": "too dark", "overexposed": "too bright"}


def flag_words(flags: Column) -> Column:
    """A list of flags in words; no flag says good."""
    words = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    said = F.array_join(F.transform(F.split(flags, ","), lambda f: F.coalesce(F.try_element_at(words, f), f)), ", ")
    return F.when(F.coalesce(flags, F.lit("")) == "", "good").otherwise(said)


def adopted(drawn: DataFrame, old: DataFrame) -> DataFrame:
    """Drawn boxes, and old single ones of images without any: image_id, adopted."""
    new = old.join(drawn.select("image_id").distinct().hint("merge"), "image_id", "left_anti")
    return drawn.withColumn("adopted", F.lit(False)).unionByName(new.withColumn("adopted", F.lit(True)))


def changed(resolved: DataFrame, decisions: DataFrame) -> DataFrame:
    """How many decisions there are on known rows, and how many change the label."""
    both = resolved.select("seq", "label").join(decisions.hint("merge"), "seq")
    return both.agg(F.count("*").alias("decided"), count_if(F.col("label") != F.col("decided")).alias("changed"))


def failures(asked: DataFrame, readable: DataFrame, key: str) -> DataFrame:
    """How many rows were asked for and how many could not be read."""
    got = asked.join(readable.select(key).distinct().withColumn("ok", F.lit(True)).hint("merge"), key, "left")
    return got.agg(F.count("*").alias("asked"), count_if(F.col("ok").isNull()).alias("failed"))


def missed(rows: DataFrame, most: int = 8) -> DataFrame:
    """The first missed defects by seq (C20): rows with y_true and y_pred."""
    return rows.where((F.col("y_true") == 1) & (F.col("y_pred") == 0)).orderBy("seq").limit(most)


def mask_pairs(files: DataFrame) -> DataFrame:
    """image, mask of each image file whose mask is listed.

    A mask lies where the image's path says ``Masks`` for ``Images``, or ``ground_truth`` for ``test`` with ``_mask``
    behind the stem; of several the first by this order. Each path proposes its few names, which meet the listing on equality.
    """
    stem, masked = F.regexp_replace("path", r"\.[^./]*$", ""), lambda s: F.concat(s, F.lit("_mask.png"))
    names = F.array(F.regexp_replace("path", "/Images/", "/Masks/"), F.concat(F.regexp_replace(stem, "/Images/", "/Masks/"), F.lit(".png")), masked(F.regexp_replace(stem, "/test/", "/ground_truth/")))
    asked = files.select(F.col("path").alias("image"), F.posexplode(names).alias("priority", "path")).where(F.col("image") != F.col("path"))
    found = asked.join(files.select("path").distinct().hint("merge"), "path", "left_semi")
    return found.groupBy("image").agg(F.min_by("path", "priority").alias("mask"))


def mask_readiness(images: DataFrame, masked: DataFrame, boxed: DataFrame) -> DataFrame:
    """One row: images ready to draw boxes for, without a mask, already boxed."""
    flag = lambda df, n: df.select("image_id").distinct().withColumn(n, F.lit(True)).hint("merge")
    df = images.select("image_id").join(flag(masked, "mask"), "image_id", "left").join(flag(boxed, "box"), "image_id", "left")
    return df.agg(count_if(F.col("mask") & F.col("box").isNull()).alias("ready"), count_if(F.col("mask").isNull()).alias("without_mask"), count_if(F.col("box")).alias("boxed"))


def newest_types(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """raw_type, standard_type: a user's rows over the defaults, the last of each type by seq."""
    both = defaults.withColumn("o", F.struct(F.lit(0).alias("level"), "seq")).unionByName(own.withColumn("o", F.struct(F.lit(1).alias("level"), "seq")))
    return both.groupBy("raw_type").agg(F.max_by("standard_type", "o").alias("standard_type"))
