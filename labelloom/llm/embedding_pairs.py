"""Operator 13, near duplicates of embeddings by a pivot-permutation index.

A bounded sample gives reference points, the pivots: rows that stand apart from each other, as many as the square root
of the rows asks for. Every vector is described by its nearest pivots in order. Inverted lists hold the vectors of a
pivot; two vectors that share ``SHARED`` of their ``NEAREST`` pivots are candidates, and their cosine in double precision
decides. Pivots are numbered from rare to frequent: a vector stands in the lists of its first pivots only, as two that
share enough meet in the first one that they share, and only there are they counted.

Lists are cut into chunks of bounded size; two chunks meet in a group of their own, which returns the links of each
vector as a number and its connections as a forest, never all pairs. Equal vectors are one node from the start. What
tight groups hold, however large, is known without comparing: a vector within half the angle of a dense point of the
sample is linked with all others there, by the triangle inequality, so such pairs are counted by the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, in_arrow, sized, table, written
from .components import components

COSINE = 0.9
#: Rows that pivots and dense points are chosen from at most: lowest by a hash.
SAMPLE_ROWS = 8_192
#: Pivots: a power of two near the square root of the rows, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 64, 4_096
#: A vector's nearest pivots, and how many of them two candidates share.
NEAREST, SHARED = 8, 3
#: Cosine that two pivots have at most, and share of the sample that makes a point dense.
APART, DENSE = 0.5, 0.005
#: Rows of a chunk, about.
CHUNK = 1_024
#: What rounding can add to an angle.
SLACK = 1e-6


@dataclass
class Index:
    """Unit vectors of the pivots and of the dense points; their number is bounded."""

    pivots: np.ndarray
    dense: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Numbers of each row's nearest pivots, the nearest first."""
        near = x @ self.pivots.T
        k = min(NEAREST, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)

    def ball(self, x: np.ndarray) -> np.ndarray:
        """The nearest dense point within half the angle of a link, or -1."""
        if not len(self.dense):
            return np.full(len(x), -1)
        near = x @ self.dense.T
        best = near.argmax(1)
        half = np.arccos(COSINE) / 2 - SLACK
        return np.where(near[np.arange(len(x)), best] >= np.cos(half), best, -1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows in double precision of an Arrow list column; rows shorter than ``width`` are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        x = values.reshape(-1, width)
    else:
        x = np.zeros((len(sizes), width))
        x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    x = x / np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]  # else squares of very large or small parts leave the doubles
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def comparable(v: Column) -> Column:
    """Whether a vector can link: neither null nor zero, and all of its components finite numbers."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda c: c != 0), F.lit(False))


def nodes(vectors: DataFrame) -> DataFrame:
    """node, k1, k2, lo (smallest vec_id), n (rows), v: a row for each different vector that can link, written."""
    own = vectors.where(comparable(F.col("v")) & F.col("vec_id").isNotNull()).select("vec_id", "v", *_key("v"))
    alike = own.groupBy("k1", "k2").agg(F.min("vec_id").alias("lo"), F.count("*").alias("n"), F.first("v").alias("v"))
    return written(alike.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")


def _key(v: str) -> list[Column]:
    return [F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(13), v).alias("k2")]


def fit(points: DataFrame, n: int, width: int, seed: int = 13) -> Index:
    """The index of ``n`` written points; SAMPLE_ROWS of them, those with the lowest hashes, come to the driver."""
    got = points.orderBy(F.xxhash64(F.lit(seed), "k1", "k2"), "node").limit(SAMPLE_ROWS).select("v").toArrow()
    x = matrix(got.column(0).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64())), width)
    most = int(np.clip(2 ** np.ceil(np.log2(max(2.0, n) ** 0.5)), LEAST_PIVOTS, MOST_PIVOTS))
    pivots = np.zeros((0, width))
    for row in x:
        if len(pivots) == most:
            break
        if not len(pivots) or (pivots @ row).max() < APART:
            pivots = np.vstack([pivots, row])
    if len(pivots) < most:  # the sample has no more rows that stand apart: directions at random
        more = np.random.default_rng(seed).normal(size=(most - len(pivots), width))
        pivots = np.vstack([pivots, more / np.linalg.norm(more, axis=1, keepdims=True)])
    dense, free = [], np.ones(len(x), bool)
    cut = np.cos(np.arccos(COSINE) / 2 - SLACK)
    around = np.concatenate([(x[k : k + 1024] @ x.T >= cut).sum(1) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
    for k in np.argsort(-around, kind="stable"):
        if around[k] < max(2, DENSE * len(x)):
            break
        if free[k] and ((inside := x @ x[k] >= cut) & free).sum() >= max(2, DENSE * len(x)):
            dense.append(x[k])
            free &= ~inside
    index = Index(pivots, np.array(dense).reshape(-1, width))
    if len(x):  # numbered from rare to frequent
        seen = np.bincount(index.nearest(x).ravel(), minlength=most)
        index.pivots = pivots[np.argsort(seen, kind="stable")]
    return index


def described(points: DataFrame, index: Index, width: int) -> DataFrame:
    """node, n, v, ball and near, the numbers of the nearest pivots in ascending order: a row for each point."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), width)
            near = np.sort(index.nearest(x), axis=1).astype(np.int32) if len(x) else np.zeros((0, 1), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(index.ball(x).astype(np.int32)), lists], names=["node", "n", "v", "ball", "near"])

    kind = points.schema["v"].dataType.simpleString()
    return in_arrow(points.select("node", "n", "v"), describe, f"node long, n long, v {kind}, ball int, near array<int>")


def _meet(left: pd.DataFrame, right: pd.DataFrame, pivot: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of the linked pairs that this pivot's list has to count."""
    a, b = (matrix(pa.array(x["v"].tolist(), pa.list_(pa.float64())), width) for x in (left, right))
    p, q = np.stack(left["near"].to_list()), np.stack(right["near"].to_list())
    # Shared pivots of all pairs by one product of 0-1 matrices, over the pivots that occur here.
    names, at = np.unique(np.concatenate([p.ravel(), q.ravel()]), return_inverse=True)
    has = np.zeros((len(p) + len(q), len(names)), np.float32)
    has[np.repeat(np.arange(len(has)), p.shape[1]), at.ravel()] = 1
    ahead = names < pivot  # a pair that shares one of these is counted in that one's list
    sharing = has[: len(p)] @ has[len(p) :].T >= min(SHARED, p.shape[1])
    sharing &= has[: len(p), ahead] @ has[len(p) :, ahead].T == 0
    balls = left["ball"].to_numpy()[:, None]
    sharing &= (balls < 0) | (balls != right["ball"].to_numpy()[None, :])
    if left is right:
        sharing = np.triu(sharing, 1)
    some, other = np.flatnonzero(sharing.any(1)), np.flatnonzero(sharing.any(0))
    linked = (a[some] @ b[other].T >= COSINE) & sharing[np.ix_(some, other)]
    i, j = np.nonzero(linked)
    return some[i], other[j]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the edges u-v connect, one for each node but the roots."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    held = root != np.arange(len(names))
    return names[held], names[root[held]]


def links(points: DataFrame, width: int, index: Index) -> tuple[DataFrame, DataFrame]:
    """(node, more: links beyond those of its own ball), (a, b: edges of the same components)."""
    rows = written(described(points, index, width), "described")
    first = F.slice("near", 1, max(1, NEAREST - SHARED + 1))
    posted = rows.select("node", "n", "v", "ball", "near", F.explode(first).alias("pivot"))
    # Chunks: a pivot's rows of one ball are dealt by hash into parts of some CHUNK rows.
    parts = written(rows.select("ball", F.explode(first).alias("pivot")).groupBy("pivot", "ball").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")), "parts")
    chunks = written(parts.select("pivot", "ball", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "chunks")
    a, b = (chunks.select("pivot", F.col("ball").alias(f"ball_{s}"), F.col("part").alias(f"part_{s}")) for s in "ab")
    after = (F.col("ball_a") < F.col("ball_b")) | ((F.col("ball_a") == -1) & (F.col("ball_b") == -1) & (F.col("part_a") <= F.col("part_b")))
    pairs = written(a.hint("merge").join(b, "pivot").where(after), "meetings")
    side = lambda s: pairs.select("pivot", F.col(f"ball_{s}").alias("ball"), F.col(f"part_{s}").alias("part"), "ball_a", "part_a", "ball_b", "part_b", F.lit(s == "b").alias("right"))
    same = (F.col("ball_a") == F.col("ball_b")) & (F.col("part_a") == F.col("part_b"))
    meetings = written(side("a").unionByName(side("b").where(~same)), "meetings")
    placed = posted.join(sized(parts), ["pivot", "ball"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = placed.join(meetings.hint("merge"), ["pivot", "ball", "part"])

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        left = g[~g["right"]].reset_index(drop=True)
        right = g[g["right"]].reset_index(drop=True)
        one = bool((g["ball_a"].iloc[0] == g["ball_b"].iloc[0]) and (g["part_a"].iloc[0] == g["part_b"].iloc[0]))
        right = left if one else right
        out = pd.DataFrame({"node": pd.Series(dtype="int64"), "root": pd.Series(dtype="float64").astype("Int64"), "more": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return out
        i, j = _meet(left, right, int(g["pivot"].iloc[0]), width)
        if not len(i):
            return out
        u, v = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        more = np.bincount(at, np.concatenate([right["n"].to_numpy()[j], left["n"].to_numpy()[i]])).astype(np.int64)
        node, root = forest(u, v)
        roots = pd.Series(root, index=node).reindex(names).astype("Int64")
        return pd.DataFrame({"node": names, "root": roots.to_numpy(), "more": more}).astype({"root": "Int64"})

    told = written(dealt.groupBy("pivot", "ball_a", "part_a", "ball_b", "part_b").applyInPandas(meet, "node long, root long, more long"), "links")
    inside = rows.where("ball >= 0").select("node", "n", "ball")
    whole = inside.groupBy("ball").agg(F.sum("n").alias("whole"), F.min("node").alias("root"))  # a row a dense point
    balls = inside.join(F.broadcast(written(whole, "balls")), "ball")
    more = told.select("node", "more").unionByName(balls.select("node", (F.col("whole") - F.col("n")).alias("more"))).groupBy("node").agg(F.sum("more").alias("more"))
    edges = told.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(balls.select(F.col("node").alias("a"), F.col("root").alias("b")))
    for done in (parts, chunks, pairs):
        forget(done)
    return more, edges


def near_duplicates(table_: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of the table.

    Rows link at a cosine of COSINE or more; equal rows always do, and a row that repeats a vec_id is a row of its own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without a
    vec_id: they are kept, a component each. Vectors that are shorter than others count as filled with zeros. Ties have
    no say. An empty table gives no rows; other columns, labels among them, are not read.
    """
    rows = table_.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    points = nodes(rows)
    n, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    more, edges = links(points, width, fit(points, n, width))
    linked = components(edges)
    labelled = written(points.select("node", "k1", "k2", "lo", "n").join(linked.hint("merge"), "node", "left").join(more.hint("merge"), "node", "left").select("k1", "k2", "lo", F.coalesce("label", "node").alias("label"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "labelled")
    lowest = written(labelled.groupBy("label").agg(F.min("lo").alias("component_id")), "lowest")
    judged = written(labelled.join(lowest.hint("merge"), "label").select("k1", "k2", "n_links", "component_id"), "judged")
    can = comparable(F.col("v")) & F.col("vec_id").isNotNull()
    keys = rows.select("vec_id", *[F.when(can, k).alias(name) for k, name in zip((F.xxhash64("v"), F.xxhash64(F.lit(13), "v")), ("k1", "k2"), strict=True)])
    out = keys.join(judged.hint("merge"), ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
