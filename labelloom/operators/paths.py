"""What paths and names say about images (section B). All functions are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of folders of faultless images, of faulty ones, and of splits.
GOOD = ("good", "ok", "normal", "non_defective")
BAD = ("anomaly", "anomalous", "bad", "ng")
SPLITS = {"train": ("train", "training"), "val": ("val", "valid", "validation"), "test": ("test", "testing")}
ANCHORS = ("train", "test", "val", "validation")
FIELDS = ("category", "split", "label", "defect_type", "is_mask")


def folders(path: Column) -> Column:
    """The folders of a path without empty and dot parts and without the file's name."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: ~p.isin("", "."))
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _labelled(category, split, label, kind, mask) -> Column:
    return F.struct(*[v.alias(n) for n, v in zip(FIELDS, (category, split, label, kind, mask))])


def unknown() -> Column:
    """What an unread path is taken for: unlabelled, of no split."""
    return _labelled(F.lit("unknown"), F.lit("unassigned"), F.lit("unlabeled"), F.lit("none"), F.lit(False))


def by_split_folders(path: Column) -> Column:
    """category/split/type/file (B1): the first folder named as a split is the anchor; the last folder behind it is the type."""
    dirs = folders(path)
    low = F.transform(dirs, F.lower)
    at = F.coalesce(F.array_min(F.transform(F.filter(F.array(*map(F.lit, ANCHORS)), lambda a: F.array_contains(low, a)), lambda a: F.array_position(low, a))), F.lit(0)).cast("int")
    name = F.get(low, at - 1)
    leaf = F.when((at > 0) & (at < F.size(dirs)), F.element_at(dirs, -1))
    good = F.lower(leaf).isin(*GOOD)
    category = F.when(at == 0, F.get(dirs, F.lit(0))).when(at > 1, F.get(dirs, at - 2)).otherwise("unknown")
    read = _labelled(
        category,
        F.when(at == 0, "unassigned").when(name == "validation", "val").otherwise(name),
        F.when(leaf.isNull(), "unlabeled").when(good, "normal").otherwise("defect"),
        F.when(leaf.isNull() | good, "none").otherwise(leaf),
        F.array_contains(low, "ground_truth") & ((at == 0) | leaf.isNotNull()),
    )
    return F.when(F.size(dirs) > 0, read).otherwise(unknown())


def by_image_folders(path: Column) -> Column:
    """category/.../Images|Masks/Normal|Anomaly/file (B2): faults have no type of their own yet."""
    dirs = folders(path)
    low = F.transform(dirs, F.lower)
    images, masks = F.array_position(low, "images"), F.array_position(low, "masks")
    at = F.when(images > 0, images).otherwise(masks).cast("int")
    kind = F.when(at > 0, F.get(low, at))
    good, bad = F.coalesce(kind.isin(*GOOD), F.lit(False)), F.coalesce(kind.isin(*BAD), F.lit(False))
    read = _labelled(F.get(dirs, F.lit(0)), F.lit("unassigned"), F.when(good, "normal").when(bad, "defect").otherwise("unlabeled"), F.when(bad, "unspecified").otherwise("none"), (images == 0) & (masks > 0))
    return F.when(F.size(dirs) > 0, read).otherwise(unknown())


def by_class_folder(path: Column) -> Column:
    """class/file (B3): the folder is the category, and the type unless its name says faultless."""
    dirs = folders(path)
    folder = F.element_at(dirs, -1)
    good = F.lower(folder).isin(*GOOD) | F.lower(folder).endswith("_free")
    read = _labelled(folder, F.lit("unassigned"), F.when(good, "normal").otherwise("defect"), F.when(good, "none").otherwise(folder), F.lit(False))
    return F.when(F.size(dirs) > 0, read).otherwise(unknown())


LAYOUTS = {"mvtec": by_split_folders, "visa": by_image_folders, "flat": by_class_folder}


def read_path(path: Column, layout: Column) -> Column:
    """The reading of each row's own layout, unlabelled for a layout that is not known."""
    out = unknown()
    for name, reader in LAYOUTS.items():
        out = F.when(layout == name, reader(path)).otherwise(out)
    return out


def split_name(value: Column) -> Column:
    """train, val, test or null."""
    low = F.lower(F.trim(value))
    out = F.lit(None).cast("string")
    for name, said in SPLITS.items():
        out = F.when(low.isin(*said), name).otherwise(out)
    return out


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def video_key(path: Column, digest: Column) -> Column:
    """A short name of a video: its cleaned stem and the head of its hash."""
    clean = F.regexp_replace(F.regexp_replace(stem(path), r"[^0-9A-Za-z가-힣_-]+", "-"), r"^-+|-+$", "")
    return F.concat_ws("-", F.when(clean != "", F.substring(clean, 1, 40)), F.substring(digest, 1, 8))


def frame_number(path: Column) -> Column:
    """The number that a file's stem is, null for any other stem."""
    return F.regexp_extract(stem(path), r"^([0-9]+)$", 1).try_cast("long")


def seconds(frame: Column, fps: Column) -> Column:
    """A frame's time, null without a rate above 0."""
    return F.when(fps > 0, frame / fps)


def fingerprint(*parts: Column) -> Column:
    """16 hex digits that tell one definition from another."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def stamp(changed: Column, size: Column) -> Column:
    """What shows that a file is not the one it was: time of change and size."""
    return F.concat(changed.cast("string"), F.lit(":"), size.cast("string"))


def content_id(content: Column) -> Column:
    """The first 16 digits of the content's SHA-1."""
    return F.substring(F.sha1(content), 1, 16)


def relative_to(path: Column, root: str) -> Column:
    """A path below ``root`` without it; any other stays as it is."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def absolute(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def thresholds_of(text: Column) -> Column:
    """A map of category to threshold from JSON: empty for text that is no object, without values that are no numbers."""
    read = F.transform_values(F.from_json(text, "map<string,string>"), lambda k, v: v.try_cast("double"))
    return F.coalesce(F.map_filter(read, lambda k, v: v.isNotNull()), F.create_map().cast("map<string,double>"))


def threshold_for(thresholds: Column, category: Column, overall: Column) -> Column:
    """The category's threshold, else the overall one."""
    return F.coalesce(F.try_element_at(thresholds, category), overall)


def decision(score: Column, threshold: Column) -> Column:
    return F.when(score >= threshold, "defect").otherwise("normal")
