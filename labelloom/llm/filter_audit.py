"""Operator 11, filter interaction audit by forward-backward path counting.

One pass gives each document the set of filters that it fails; a table of parts by sets, at most 32 rows a part,
is all that is left of the documents. The subsets of the filters form a lattice: a state is the set of filters
applied so far, an order of filters is a path from the empty state to the full one, and an edge adds one filter.
Counted forward, each state has the number of paths that reach it; counted backward, the number that leave it.
An edge lies on (paths reaching its start) x (paths leaving its end) orders: a filter's removals along its edges,
so weighted, sum up to its Shapley value over all orders, and each order's steps are read from the same edges.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, sized, slices, table, written

#: The filters by name: filter k is bit k of a set. The last one needs other documents, the others only the text.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
STATES = 1 << len(FILTERS)
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def text_failures(raw: bytes, n_chars: int) -> int:
    """The set of filters A to D that a text of ``n_chars`` code points fails."""
    words = raw.split()  # splits where \\x20 and \\x09 to \\x0D stand
    few = len(words) < 50
    repetitive = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * n_chars
    marked = len(raw) != len(raw.translate(None, _SYMBOLS))
    return few | repetitive << 1 | loud << 2 | marked << 3


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask (filters A to D that fail), key (SHA-256 of the text); a null text is an empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw, n = b.column(2).cast(pa.binary()).to_pylist(), pc.utf8_length(b.column(2)).to_pylist()
            masks = pa.array(map(text_failures, raw, n), pa.int32())
            keys = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, keys], names=["doc_id", "part", "mask", "key"])

    return in_arrow(rows, judge, "doc_id long, part string, mask int, key binary")


def failing_sets(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of a part by the set of filters that they fail, some 32 rows a part.

    Copies of a text, however many, shrink to a row for each part and label before they meet, and a text's rows meet by
    its hash: the only row of it that no smaller doc_id has is the one with the smallest.
    """
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    told = written(labels.groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")), "labels")
    judged = failures(docs, part).join(sized(told), "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["key", "part", "mask", "good", "toxic"]
    by_id = judged.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    alike = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("lo"), F.min_by("n", "doc_id").alias("at_lo"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("lo").over(Window.partitionBy("key"))
    ahead = F.col("no_id") + F.when(F.col("lo") == first, F.col("at_lo")).otherwise(0)
    split = alike.select("part", "mask", "good", "toxic", "n", ahead.alias("ahead"))
    two = F.array(F.struct(F.col("mask"), F.col("ahead").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("ahead")).alias("n")))
    each = split.select("part", "good", "toxic", F.inline(two)).where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def path_counts(n_filters: int = len(FILTERS)) -> tuple[list[int], list[int]]:
    """For each state, the paths that reach it from the empty state and those that leave it for the full one."""
    states, full = range(1 << n_filters), (1 << n_filters) - 1
    forward, backward = [1] + [0] * full, [0] * full + [1]
    for s in states:
        if s:
            forward[s] = sum(forward[s ^ 1 << k] for k in range(n_filters) if s >> k & 1)
    for s in reversed(states):
        if s != full:
            backward[s] = sum(backward[s | 1 << k] for k in range(n_filters) if not s >> k & 1)
    return forward, backward


def edges() -> list[tuple[int, int, int]]:
    """(state, filter, orders that lie on the edge) of every edge of the lattice."""
    forward, backward = path_counts()
    return [(s, k, forward[s] * backward[s | 1 << k]) for s in range(STATES) for k in range(len(FILTERS)) if not s >> k & 1]


def lattice(sets: DataFrame) -> DataFrame:
    """part and alive, an array by state: the documents (n, good, toxic) that every filter of the state lets pass."""
    states = F.explode(F.sequence(F.lit(0), F.lit(STATES - 1))).alias("state")
    spread = sets.select("part", "mask", "n", "good", "toxic", states)
    passes = F.col("mask").bitwiseAND(F.col("state")) == 0
    counted = spread.groupBy("part", "state").agg(*[F.sum(F.when(passes, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")])
    # A row for each of the 32 states, whatever the part holds.
    return counted.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("state", "n", "good", "toxic"))).alias("alive"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, shapley_mean.

    A row for each part that has documents, order of the filters and step; an empty table has none. A null part counts
    under the empty string, a null text as an empty one. A row without doc_id is no copy of another, and none of it; rows
    that repeat a doc_id count each, and are no copies of one another. A document is good or toxic if any of its labels
    says so, and neither without labels. Other columns are not read. ``shapley`` sums over all orders, ``shapley_mean``
    is its mean.
    """
    alive = lambda c, state: F.get(F.col("alive"), state)[c]
    lost = lambda c, state, k: alive(c, state) - alive(c, state.bitwiseOR(F.shiftleft(F.lit(1), k)))

    def value(k: int) -> Column:
        own = [(s, w) for s, f, w in edges() if f == k]
        terms = F.array(*[(alive("n", F.lit(s)) - alive("n", F.lit(s | 1 << k))) * F.lit(w).cast("long") for s, w in own])
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)

    valued = lattice(failing_sets(docs, labels, part)).select("part", "alive", F.array(*[value(k) for k in range(len(FILTERS))]).alias("values"))
    steps = [{"filter_order": "".join(p), "step": i + 1, "state": sum(1 << FILTERS.index(x) for x in p[:i]), "k": FILTERS.index(p[i])} for p in permutations(FILTERS) for i in range(len(p))]
    path = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, state int, k int>>")
    rows = valued.select("part", "alive", "values", F.inline(path))
    state, k = F.col("state"), F.col("k")
    bit = F.expr("shiftleft(1, k)")
    after = state.bitwiseOR(bit)
    others = F.lit(STATES - 1).bitwiseXOR(bit)
    removed = alive("n", state) - alive("n", after)
    return rows.select(
        "part", "filter_order", "step", F.expr(f"substr('{FILTERS}', k + 1, 1)").alias("filter"),
        alive("n", after).alias("kept"), removed.alias("removed"),
        (alive("n", F.lit(0)) - alive("n", bit) - removed).alias("redundant"),
        (alive("n", others) - alive("n", F.lit(STATES - 1))).alias("unique_fails"),
        (alive("good", state) - alive("good", after)).alias("good_lost"), (alive("toxic", state) - alive("toxic", after)).alias("toxic_lost"),
        F.get(F.col("values"), k).alias("shapley"), (F.get(F.col("values"), k) / 120).alias("shapley_mean"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter", "shapley_mean")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT x, min(doc_id) AS lo FROM t GROUP BY 1),
d AS (SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, map {
  'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t.x, '[^A-Z]', '', 'g')) > 5 * length(t.x),
  'D': regexp_matches(t.x, '[#$%&*|]'), 'E': coalesce(t.doc_id > m.lo, false)} AS f
  FROM t JOIN m ON t.x = m.x LEFT JOIN l ON t.doc_id = l.doc_id),
g AS (SELECT part, f['A'] AS a, f['B'] AS b, f['C'] AS c, f['D'] AS d, f['E'] AS e, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a, k b, k c, k d, k e
  WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
r AS (SELECT g.part, s.filter_order, s.step, s.filter_order[s.step] AS k,
    f[s.filter_order[s.step]] AS fails, len(list_filter(range(1, s.step), lambda i: f[s.filter_order[i]])) > 0 AS gone,
    CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS n_fails, n, good, toxic FROM g, s),
q AS (SELECT part, filter_order, step, any_value(k) AS k,
  CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY 1, 2, 3)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM q
"""
