"""Manifest, label events, queues, splits and their summaries (sections B to F)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.sources.scratch import scratch

#: The standard defect types and the default names for raw ones.
STANDARD_TYPES = ("scratch", "crack", "contamination", "dent", "hole", "discoloration", "missing", "deformation", "print_error", "other", "none", "unspecified")
SPLITS = ("train", "val", "test")


def latest(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The row written last of each key (C2, C3): one partial aggregation, no sort."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(key, "x.*")


def append_new(stored: DataFrame, batch: DataFrame, key: str = "sha1", order: str = "seq") -> DataFrame:
    """Rows of ``batch`` whose key is not stored, the first of each key."""
    cols = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("x")).select(key, "x.*")
    return first.join(stored.select(key).distinct().hint("merge"), key, "left_anti").select(batch.columns)


def normalized_type(raw: Column, mapping: dict[str, str]) -> Column:
    """A raw type's standard name, or the raw name (E2); the mapping is a small literal."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, raw), raw)


#: Where in an image a person found the defect.
ROI = ("roi_x", "roi_y", "roi_w", "roi_h")


def resolve(manifest: DataFrame, events: DataFrame, mapping: dict[str, str], splits: DataFrame | None = None) -> DataFrame:
    """Manifest rows overridden by their latest event (E1): raw_defect_type, label_source, verified, the columns of ROI.

    With ``splits`` (seq, split) of which there is a row at all, rows take theirs, and those without one are unassigned;
    an empty table of splits leaves the manifest's own.
    """
    events = events.withColumns({c: F.lit(None).cast("long") for c in ROI if c not in events.columns})
    ev = latest(events, "image_seq").select(F.col("image_seq").alias("seq"), F.col("label").alias("ev_label"), F.col("defect_type").alias("ev_type"), F.col("verified").alias("ev_verified"), *ROI)
    df = manifest.drop(*ROI).join(ev.hint("merge"), "seq", "left")
    if splits is not None:
        there = splits.agg((F.count("*") > 0).alias("any_split"))
        chosen = splits.select("seq", F.col("split").alias("chosen_split")).hint("merge")
        df = df.join(chosen, "seq", "left").crossJoin(F.broadcast(there))
        df = df.withColumn("split", F.when(F.col("any_split"), F.coalesce("chosen_split", F.lit("unassigned"))).otherwise(F.col("split"))).drop("chosen_split", "any_split")
    has = F.col("ev_label").isNotNull()
    kind = F.when(has, F.col("ev_type")).otherwise(F.col("defect_type"))
    return df.withColumns(
        {
            "raw_defect_type": F.col("defect_type"),
            "label_source": F.when(has, "human").when(F.col("label") == "unlabeled", "none").otherwise("folder"),
            "verified": F.coalesce(F.when(has, F.col("ev_verified")), F.lit(False)),
            "label": F.coalesce("ev_label", "label"),
            "defect_type": normalized_type(kind, mapping),
        }
    ).drop("ev_label", "ev_type", "ev_verified")


def unmapped_types(resolved: DataFrame) -> DataFrame:
    """Types that are not standard, each once."""
    return resolved.where(~F.col("defect_type").isin(*STANDARD_TYPES)).select("defect_type").distinct()


def review_queue(resolved: DataFrame, mode: str, category: str | None = None) -> DataFrame:
    """Rows to review."""
    is_defect = F.col("label") == "defect"
    modes = {"unlabeled": F.col("label") == "unlabeled", "unspecified": is_defect & (F.col("defect_type") == "unspecified"), "unverified": ~F.col("verified"), "unmapped": is_defect & ~F.col("defect_type").isin(*STANDARD_TYPES), "all": F.lit(True)}
    rows = resolved.where(modes[mode])
    return (rows.where(F.col("category") == category) if category else rows).orderBy("category", "image_id", "seq")


def group_key(group: Column, row_id: Column) -> Column:
    """The group if it says something, else the row itself."""
    g = F.trim(group)
    return F.when(F.coalesce(g, F.lit("")).isin("", "nan", "None"), row_id).otherwise(g)


def quality_flags(df: DataFrame) -> Column:
    """low_resolution, blurry, underexposed, overexposed as a list in one text (B11); empty says good."""
    flags = F.array(F.when(F.least("width", "height") < 64, "low_resolution"), F.when(F.col("blur_score") < 30, "blurry"), F.when(F.col("brightness") < 40, "underexposed"), F.when(F.col("brightness") > 220, "overexposed"))
    return F.array_join(F.array_compact(flags), ",")


def sample(df: DataFrame, n: int, seed: int, key: str = "seq") -> DataFrame:
    """n rows, the same ones on any partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string"))), key).limit(n)


def allocate(total: Column, ratios: tuple[float, ...]) -> Column:
    """Integers that add up to ``total`` in the ratios, by largest remainder, ties to the earlier (D1): array<long>."""
    parts = F.array(*[F.struct((total * F.lit(r / sum(ratios)) - F.floor(total * F.lit(r / sum(ratios)) + 1e-9)).alias("rest"), F.lit(-k).alias("k"), F.floor(total * F.lit(r / sum(ratios)) + 1e-9).alias("n")) for k, r in enumerate(ratios)])
    left = total - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    # Rounded before the comparison: equal remainders differ in their last bits.
    ranked = F.reverse(F.array_sort(F.transform(parts, lambda x: F.struct(F.round(x["rest"], 9).alias("rest"), x["k"].alias("k"), x["n"].alias("n")))))
    given = F.transform(ranked, lambda x, i: F.struct(x["k"].alias("k"), (x["n"] + F.when(i < left, 1).otherwise(0)).alias("n")))
    return F.transform(F.reverse(F.array_sort(given)), lambda x: x["n"])


def ranked(df: DataFrame, by: list[str], order: list, key: list[str]) -> DataFrame:
    """``by``, ``key``, r and size: each row's number in its group's order, from 1, and the group's rows.

    Rows are cut into ranges by group and order and the ranges counted, so a large group is sorted in as many tasks as its
    rows need; a range's rows get the number of rows in the group's earlier ranges and their place in their own.
    """
    keys = df.select(*by, *key, *[o.alias(f"o{k}") if isinstance(o, Column) else F.col(o).alias(f"o{k}") for k, o in enumerate(order)])
    places = [f"o{k}" for k in range(len(order))]
    path = scratch(df.sparkSession, "ranked")
    keys.repartitionByRange(*by, *places).withColumn("range", F.spark_partition_id()).write.parquet(path)  # a range's number must stay
    rows = df.sparkSession.read.parquet(path)
    counts = rows.groupBy(*by, "range").agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    before = counts.withColumns({"before": F.sum("c").over(group.orderBy("range")) - F.col("c"), "size": F.sum("c").over(group)}).drop("c")
    placed = rows.join(before.hint("merge"), [*by, "range"])
    own = Window.partitionBy(*by, "range").orderBy(*places)
    return placed.withColumn("r", F.col("before") + F.row_number().over(own)).select(*by, *key, "r", "size")


def split_in_order(df: DataFrame, order: list, ratios=(0.6, 0.2, 0.2), strata=("category", "label"), key: str = "seq") -> DataFrame:
    """Each stratum's rows in order: the first allotment to train, the next to val, the rest to test."""
    quota = allocate(F.col("size"), ratios)
    placed = ranked(df, list(strata), order, [key]).withColumn("quota", quota)
    split = F.when(F.col("r") <= F.col("quota")[0], "train").when(F.col("r") <= F.col("quota")[0] + F.col("quota")[1], "val").otherwise("test")
    return df.drop("split").join(placed.select(key, split.alias("split")).hint("merge"), key)


def split_random(df: DataFrame, seed: int = 42, key: str = "seq", **options) -> DataFrame:
    return split_in_order(df, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)], key=key, **options)


def _quotient_counts(weights: np.ndarray, held: np.ndarray, unit: float, seats: int) -> np.ndarray:
    """How many of ``seats`` equal units each weight gets when each unit goes where (held + unit / 2) / weight is least, ties to the earlier."""
    start = held / unit + 0.5
    low, high = 0.0, float(((start + seats) / weights).max()) + 1
    for _ in range(100):  # the level up to which each fills
        mid = (low + high) / 2
        low, high = (low, mid) if np.maximum(0, np.floor(mid * weights - start) + 1).sum() > seats else (mid, high)
    got = np.maximum(0, np.floor((low - 1e-9) * weights - start) + 1).astype(np.int64)
    while got.sum() < seats:
        got[np.argmin(np.round((start + got) / weights, 7))] += 1
    return got


def _group_quotas(sizes: pd.DataFrame, ratios: tuple[float, ...]) -> pd.DataFrame:
    """Of a stratum's rows (n, c), c groups of n rows: how many of them go to each split."""
    sizes = sizes.sort_values("n", ascending=False)
    open_ = np.array([k for k, r in enumerate(ratios) if r > 0])
    weights, held = np.array([ratios[k] for k in open_]), np.zeros(len(open_))
    left, out = int(sizes["c"].sum()), []
    for n, c in zip(sizes["n"].tolist(), sizes["c"].tolist(), strict=True):
        given, c = np.zeros(len(open_), np.int64), int(c)
        # Until no more groups are left than splits are empty, units go by quotient: in one reckoning while all are filled, else one by one.
        while c:
            empty = np.flatnonzero(held == 0)
            if not len(empty):
                add = _quotient_counts(weights, held, n, c)
            else:
                add = np.zeros(len(open_), np.int64)
                add[empty[0] if left <= len(empty) else np.argmin(np.round((held + n / 2) / weights, 9))] = 1
            given, held, left, c = given + add, held + add * n, left - int(add.sum()), c - int(add.sum())
        whole = np.zeros(len(ratios), np.int64)
        whole[open_] = given
        out.append(whole.tolist())
    return sizes.assign(quota=out)


def split_by_group(df: DataFrame, group: str, ratios=(0.6, 0.2, 0.2), strata=("category", "label"), seed: int = 42, key: str = "seq") -> DataFrame:
    """Every group of a stratum goes to one split, large groups first, each to the split that its middle would leave lowest against
    its target; when no more groups than empty splits are left they fill those (D4).

    Groups of one size are alike, so only their number is reckoned with: a stratum's task holds a row for each size, never one for
    each group, and quotients deal equal groups out at once. Which of them go where is their seeded rank among their equals.
    """
    strata = list(strata)
    sizes = df.groupBy(*strata, group).agg(F.count("*").alias("n"))
    path = scratch(df.sparkSession, "groups")
    sizes.write.parquet(path)
    sizes = df.sparkSession.read.parquet(path)

    def quotas(part: pd.DataFrame) -> pd.DataFrame:
        return _group_quotas(part, ratios)

    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in strata) + ", n long, c long, quota array<long>"
    quota = sizes.groupBy(*strata, "n").agg(F.count("*").alias("c")).groupBy(*strata).applyInPandas(quotas, schema).drop("c")
    placed = ranked(sizes, [*strata, "n"], [F.md5(F.concat(F.lit(f"{seed}:"), F.col(group))), F.col(group)], [group])
    split = F.when(F.col("r") <= F.col("quota")[0], SPLITS[0]).when(F.col("r") <= F.col("quota")[0] + F.col("quota")[1], SPLITS[1]).otherwise(SPLITS[2])
    chosen = placed.join(quota.hint("merge"), [*strata, "n"]).select(*strata, group, split.alias("split"))
    return df.drop("split").join(chosen.hint("merge"), [*strata, group])


def even_sample(df: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """``limit`` rows of each group at the positions floor(k * (n / limit)), all of a smaller group."""
    path = scratch(df.sparkSession, "sample")
    df.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)  # a row's number must stay
    rows = df.sparkSession.read.parquet(path)
    placed = ranked(rows, by, order, ["row"]).select("row", (F.col("r") - 1).alias("p"), F.col("size").alias("n"))
    step = F.col("n") / F.lit(limit)
    k = F.floor(F.col("p") / step).cast("long")
    # The positions near p are those of k - 1, k and k + 1: no list of positions is joined.
    near = [(F.floor((k + d) * step) == F.col("p")) & (k + d >= 0) & (k + d < limit) for d in (-1, 0, 1)]
    taken = placed.where((F.col("n") <= limit) | near[0] | near[1] | near[2]).select("row")
    return rows.join(taken.hint("merge"), "row", "left_semi").drop("row")


def frames_as_rows(frames: DataFrame, category: str) -> DataFrame:
    """Manifest rows of kept frames: the video is their group, nothing is labelled yet."""
    fixed = {"category": category, "label": "unlabeled", "defect_type": "none", "split": "unassigned"}
    return frames.select(F.col("image_seq").alias("seq"), F.concat(F.lit("vid-"), F.col("video").cast("string")).alias("grp"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def preview(df: DataFrame, path: str, read: Column, rows: int = 10) -> DataFrame:
    """The first paths of a folder with what a layout reads in them (A4): a top-k, not a sort of the listing."""
    return df.orderBy(path).limit(rows).select(F.col(path).alias("path"), read.alias("p")).select("path", "p.*")


def progress(resolved: DataFrame) -> DataFrame:
    """The counters of labelling progress in one pass (F2)."""
    n = lambda ok: F.sum(F.when(ok, 1).otherwise(0))
    is_defect = F.col("label") == "defect"
    return resolved.agg(
        F.count("*").alias("total"), n(F.col("label") == "normal").alias("normal"), n(is_defect).alias("defect"), n(F.col("label") == "unlabeled").alias("unlabeled"), n(F.col("label_source") == "human").alias("human"), n(F.col("verified")).alias("verified"),
        n(is_defect & (F.col("defect_type") == "unspecified")).alias("unspecified_type"), F.count_distinct(F.when(~F.col("defect_type").isin(*STANDARD_TYPES), F.col("defect_type"))).alias("unmapped_types"), n(F.col("split").isin(*SPLITS)).alias("split_assigned"),
    )


def crosstab(df: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of rows x values with zeros (F4-F6): a pivot over known values, so no pass to find them."""
    return df.groupBy(*rows).pivot(column, values).count().fillna(0, values)


def feedback(log: DataFrame, resolved: DataFrame) -> DataFrame:
    """Log rows with the truth of verified human labels (E4): y_true, y_pred, outcome."""
    truth = resolved.where((F.col("label_source") == "human") & F.col("verified") & F.col("label").isin("normal", "defect")).select(F.col("seq").alias("image_seq"), (F.col("label") == "defect").cast("int").alias("y_true"))
    rows = log.join(truth.hint("merge"), "image_seq").withColumn("y_pred", (F.col("decision") == "defect").cast("int"))
    kind = F.when((F.col("y_true") == 1) & (F.col("y_pred") == 1), "TP").when(F.col("y_pred") == 1, "FP").when(F.col("y_true") == 1, "FN").otherwise("TN")
    return rows.withColumn("outcome", kind)


def suffix_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (id, path) to right (key, path) by the longest path suffix that both have, if only one key has it."""

    def suffixes(df: DataFrame, key: str) -> DataFrame:
        parts = F.split(F.regexp_replace("path", r"\\", "/"), "/")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/").alias("tail")))
        return df.select(key, F.explode(tails).alias("x")).select(key, "x.n", "x.tail")

    # A tail that several keys share is one row with their number and one key: no product of both sides.
    tails = suffixes(right, "key").groupBy("tail").agg(F.count_distinct("key").alias("keys"), F.min("key").alias("key"))
    hits = suffixes(left, "id").join(tails.hint("merge"), "tail")
    best = hits.groupBy("id").agg(F.max_by(F.struct("keys", "key"), "n").alias("x"))
    return best.where("x.keys = 1").select("id", "x.key")
