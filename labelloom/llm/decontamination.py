"""Operator 3, benchmark decontamination: the windows of benchmark items are looked up in every document.

Native: DataFrame functions only. The normalised n-grams of the benchmark are a table of hashes and words. Every window
of a document's words is hashed and meets that table; a hit is verified by its exact words. Up to ``MAX_SET``
n-grams, by a count, the table is broadcast as a hash set and windows are probed where they are made; beyond, windows
and table are shuffled to each other. Both joins give the same hits. Hits go back to the rows by 128 bits of
doc_id and text, so rows alike share them and every row is decided by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, sized, table, written

#: What a word is made of, and the letters that are lower-cased.
WORD, UPPER, LOWER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: N-grams that are broadcast at most, some 30 MB on each executor, and rows with hits.
MAX_SET, MAX_ROWS = 200_000, 100_000


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ngrams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, gram (its words, space-joined): every window of each item; a shorter item is one window."""
    items = benchmark.select("item_id", F.explode(F.array(words(F.col("text")))).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    return items.select("item_id", size.alias("size"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("gram")).distinct()


class Grams:
    """The benchmark's n-grams as a written table (item_id, size, gram, h), their sizes, and whether they are few enough to broadcast."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET):
        self.table = written(ngrams(benchmark, window).withColumn("h", F.xxhash64(F.split("gram", " "))), "ngrams")
        self.sizes = sorted(r[0] for r in self.table.select("size").distinct().collect())  # at most ``window`` of them
        self.grams = written(self.table.select("h", "size", "gram").distinct(), "grams")
        self.small = self.grams.limit(max_set + 1).count() <= max_set


def row_key() -> list[Column]:
    """k1, k2: 128 bits that stand for a row's doc_id and text; both sides of a join compute them alike."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(3), "doc_id", "text").alias("k2")]


def hits(docs: DataFrame, grams: Grams, every: bool = False) -> DataFrame:
    """k1, k2, pos, size, gram: each occurrence of an n-gram in the rows of ``docs`` (doc_id, text), written.

    With ``every``: rid, doc_id, n_words, pos, size, gram, and a row of pos 0 for each row of ``docs``, in one pass over the texts.
    """
    keys = ["rid", "doc_id", "n_words"] if every else ["k1", "k2"]
    named = [F.monotonically_increasing_id().alias("rid"), F.col("doc_id")] if every else row_key()
    rows = docs.select(*named, "text")
    if every and not grams.small:
        rows = written(rows, "rows")  # read twice, so the rids must stay
    rows = rows.select(*[k for k in keys if k != "n_words"], F.explode(F.array(words(F.col("text")))).alias("w"))
    n, kinds, p = F.size("w"), max(1, len(grams.sizes)), F.col("p")
    rows = rows.select(*[n.alias(k) if k == "n_words" else k for k in keys], "w", F.explode(F.sequence(F.lit(-1), n * len(grams.sizes) - 1)).alias("p"))
    # Place p stands for a word and a size of n-gram; what is computed from it stays in the stage's generated code.
    size = F.get(F.array(*[F.lit(x) for x in grams.sizes or [1]]), F.pmod(p, F.lit(kinds)))
    there = rows.select(*keys, "w", F.when(p < 0, 0).otherwise(F.floor(p / kinds) + 1).cast("int").alias("pos"), size.alias("size"))
    here = there.where((F.col("pos") > 0) & (F.col("pos") + F.col("size") - 1 <= n))
    gram, h = F.array_join(F.slice("w", F.col("pos"), F.col("size")), " "), F.xxhash64(F.slice("w", F.col("pos"), F.col("size")))
    if grams.small and every:
        # Windows stay within their stage: the probe by hash lets few through, and those are compared word by word.
        probed = there.where((F.col("pos") == 0) | (F.col("pos") + F.col("size") - 1 <= n)).withColumn("h", F.when(F.col("pos") > 0, h))
        met = probed.join(F.broadcast(grams.grams), ["h", "size"], "left").where((F.col("pos") == 0) | (F.col("gram") == gram))
    elif grams.small:
        met = here.withColumn("h", h).join(F.broadcast(grams.grams), ["h", "size"]).where(F.col("gram") == gram)
    else:
        # Words travel with their windows; adaptive execution splits a hash that many documents share.
        met = here.select(*keys, "pos", "size", h.alias("h"), gram.alias("gram")).join(grams.grams.hint("merge"), ["h", "size", "gram"])
        if every:
            met = met.select(*keys, "pos", "size", "gram").unionByName(there.where("pos = 0").select(*keys, "pos", "size", F.lit(None).cast("string").alias("gram")))
    return written(met.select(*keys, "pos", "size", "gram"), "hits")


def _spans(found: DataFrame) -> DataFrame:
    """k1, k2, spans (sorted array of struct(pos, size)) of rows with hits."""
    return written(found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("pos", "size"))).alias("spans")), "spans")


def _covered(spans: Column) -> Column:
    """How many positions an array of struct(pos, size) covers."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, x):
        end = x["pos"] + x["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["pos"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts have no words and no hits; null or wordless items have no windows. An item
    without item_id marks words but is counted nowhere. Rows that repeat a doc_id are rows of their own; repeated items
    count once. Texts of any length are read whole. Empty tables give no rows or no hits. Columns other than doc_id and
    text, and item_id and text, are not read.
    """
    grams = Grams(benchmark, window, max_set)
    found = hits(docs.select("doc_id", "text"), grams, every=True)
    # A row an n-gram and item: what many items share stays rows, and their number is counted before they are broadcast.
    named = written(grams.table.where(F.col("item_id").isNotNull()).select("size", "gram", F.col("item_id").cast("string").alias("item")), "items")
    items = found.where("pos > 0").select("rid", "size", "gram").distinct().join(sized(named, max_set), ["size", "gram"])
    items = items.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = found.groupBy("rid", "doc_id", "n_words").agg(F.array_sort(F.collect_set(F.when(F.col("pos") > 0, F.struct("pos", "size")))).alias("spans"))
    both = rows.join(written(items, "items").hint("merge"), "rid", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = _covered(F.col("spans")).cast("long")
    return both.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its words that an array of struct(pos, size, ..) covers."""
    # Each word as written, before lower-casing, with the signs before it; and the signs behind the last word.
    lead = r"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(text, F.lit(lead), F.lit(0))
    inside = lambda i: F.exists(spans, lambda x: (x["pos"] <= i + 1) & (i + 1 < x["pos"] + x["size"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.filter(pieces, lambda p, i: ~inside(i)), ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "document", window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` without contaminated rows (``remove="document"``) or without the hit words (``"span"``); same columns.

    Null and empty texts stay. Each row is decided by itself, whatever its doc_id and whatever other rows share it. An empty
    benchmark changes nothing. Other columns pass through, whatever their names.
    """
    found = hits(docs, Grams(benchmark, window, max_set))
    rows = docs.select(*row_key(), F.struct(*quoted(docs.columns)).alias("doc"))
    if remove == "document":
        gone = written(found.select("k1", "k2").distinct(), "gone")
        return rows.join(sized(gone), ["k1", "k2"], "left_anti").select("doc.*").select(quoted(docs.columns))
    both = rows.join(sized(_spans(found), MAX_ROWS), ["k1", "k2"], "left")
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(without_spans(F.col("doc.text"), F.col("spans")))
    return both.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*").select(quoted(docs.columns))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = rf"""
WITH b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
      FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce({WORDS_SQL}, []::VARCHAR[]) AS w FROM documents),
k AS (SELECT DISTINCT k FROM g),
v AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
      FROM d, k, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
h AS (SELECT DISTINCT v.doc_id, v.i, v.k, g.item_id FROM v JOIN g USING (gram, k)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS t FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s.t, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)
"""
