"""Operator 7, line dedup by distinct-site spread.

Native: DataFrame functions only. Every line's hash gets a HyperLogLog sketch of the sites it stands on;
sketches merge in Spark's partial and final aggregation, so a line that stands everywhere costs each task one
sketch. Estimates well above the threshold are taken, those well below are left, and lines near it get an
exact distinct count. Lines spread over enough sites are boilerplate and go from every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, sized, table, written

SITES, LG_K = 8, 8
#: Relative error that an estimate of a sketch of 2**LG_K registers stays within: over four standard errors.
MARGIN = 0.3


def line_key(line: Column) -> Column:
    """128 bits that stand for a trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def counts(line: Column, least: int | None) -> Column:
    """Whether a line is looked at: trimmed, it has ``least`` characters; None takes every line that is more than white space."""
    return line.rlike(r"[^\x20\x09-\x0D]") if least is None else F.length(F.trim(line)) >= least


def row_key() -> list[Column]:
    """k1, k2: 128 bits that stand for a row's doc_id and text; both sides of a join compute them alike."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(2), "doc_id", "text").alias("k2")]


def lines(docs: DataFrame, site: str = "source", least: int | None = None) -> DataFrame:
    """site, a, b of each line that counts, once a document: key columns of the trimmed text."""
    own = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: counts(x, least))
    keys = F.array_distinct(F.transform(own, line_key))
    return docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(keys).alias("k")).select("site", "k.a", "k.b")


def boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES, least: int | None = None) -> DataFrame:
    """a, b, n_sites, exact of lines that stand on ``sites`` sites or more; n_sites is an estimate where exact is false."""
    there = lines(docs, site, least)
    spread = there.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n"))
    spread = written(spread.where(F.col("n") >= sites * (1 - MARGIN)), "spread")
    sure = spread.where(F.col("n") > sites * (1 + MARGIN)).select("a", "b", F.col("n").cast("long").alias("n_sites"), F.lit(False).alias("exact"))
    close = written(spread.where(F.col("n") <= sites * (1 + MARGIN)).select("a", "b"), "close")
    # Behind a broadcast, distinct (line, site) rows are made map-side: a frequent line then is a row a site, no task's load.
    pairs = there.join(sized(close), ["a", "b"], "left_semi").distinct()
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= sites).withColumn("exact", F.lit(True))
    return sure.unionByName(counted)


def removals(docs: DataFrame, found: DataFrame, least: int | None = None) -> DataFrame:
    """k1, k2, gone (keys of a text's boilerplate lines) of rows that have such lines; k1, k2 stand for doc_id and text, so rows alike share a row."""
    own = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(counts(x, least).alias("ok"), line_key(x).alias("k"))), lambda x: x["ok"])
    rows = docs.select(*row_key(), F.explode(F.array_distinct(F.transform(own, lambda x: x["k"]))).alias("k")).select("k1", "k2", "k.a", "k.b")
    # Boilerplate lines are few as a rule: behind a count they are broadcast, so that no line's rows are dealt out by the line.
    hit = rows.join(sized(found.select("a", "b")), ["a", "b"], "left_semi")
    return hit.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("gone"))


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES, least: int | None = None) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text`` and ``n_cut``, how many were.

    Null and empty texts stay as they are with n_cut 0; a null site is one site. Rows that repeat a doc_id are rows of
    their own. White space alone is no boilerplate, nor are lines under ``least`` characters if it is given. Other columns pass through; one named n_cut is replaced.
    """
    kept = [c for c in docs.columns if c != "n_cut"]
    rows = docs.select(*row_key(), F.struct(*quoted(kept)).alias("doc"), "text")
    # Written first: the join below then has two plain exchanges, and a hot line's rows can be split.
    cut = removals(docs, written(boilerplate(docs, site, sites, least), "boilerplate"), least)
    joined = rows.join(cut.hint("merge"), ["k1", "k2"], "left")
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda x: ~(F.array_contains("gone", line_key(x)) & counts(x, least)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_cut = F.when(F.col("gone").isNull(), 0).otherwise(F.size(parts) - F.size(left)).cast("long")
    return joined.select(F.col("doc").withField("text", text).alias("doc"), n_cut.alias("n_cut")).select("doc.*", "n_cut").select(*quoted(kept), "n_cut")


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "n_cut", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, i, string_split(text, chr(10))[i] AS line, trim(string_split(text, chr(10))[i]) AS t
           FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
b AS (SELECT t FROM l WHERE regexp_matches(t, '[^\x20\x09-\x0D]') GROUP BY t HAVING count(DISTINCT site) >= 8),
k AS (SELECT l.*, b.t IS NOT NULL AS gone FROM l LEFT JOIN b ON l.t = b.t),
x AS (SELECT doc_id, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM k GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(x.n, 0) AS BIGINT) AS n_cut, CAST(length(coalesce(x.t, '')) AS BIGINT) AS n_chars_left, sha256(coalesce(x.t, '')) AS text_sha256
FROM documents d LEFT JOIN x USING (doc_id)
"""
