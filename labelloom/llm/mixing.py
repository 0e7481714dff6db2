"""Operator 4, mixing sources to target weights by Sainte-Laguë apportionment.

Sources are cut into blocks of about ``BLOCK`` words. The mix's blocks go to the sources by highest
quotients ``votes / (2k + 1)``, and each source's quota goes to its shards (seeded hash buckets of its
documents) in the same way, so every (source, shard) has an integer quota before any document is chosen.
In a shard the documents stand in seeded order and blocks are taken from a seeded start on, around its
end: whole documents, but for the two in which the taken range begins and ends. A quota above the
shard's number of blocks takes all of them again, three times at most.

Per-source totals are small rows and are summed map-side; the hot source is dealt over as many shards as
its words need, and positions are window sums within a shard, so that no source meets in one task. Quotas of
many shards are dealt in levels, ``FAN`` at a time. Up to ``DRIVER_SOURCES`` sources are apportioned on the driver,
more by aggregations over the table of sources, by the same rule.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_rows, quoted, sized, table, written

BLOCK = 16
#: Words of a shard, about, and shards whose quotas one task deals at once.
SHARD_WORDS, FAN = 1 << 15, 4096
#: Sources that are apportioned on the driver at most: some 10 MB.
DRIVER_SOURCES = 100_000
SEED = 20_240_607
#: Fixed values of the contract: weights by rank of the source, and how often a word may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(votes, seats: int, caps) -> list[int]:
    """Seats by highest quotients ``votes / (2k + 1)``, ties to the earlier, no more than ``caps`` to each.

    A divisor found by bisection gives all but the last few seats at once, those are dealt one by one.
    """
    votes, caps = np.asarray(votes, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = min(int(seats), int(caps[votes > 0].sum()))
    if not seats:
        return [0] * len(votes)
    by = lambda d: np.minimum(caps, np.floor(votes / d + 0.5).astype(np.int64))
    low, high = 1e-12, votes.max() * 2 + 1  # by(low) has enough, by(high) none
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if by(mid).sum() > seats else (low, mid)
    got = by(high)
    left = [(-v / (2 * int(n) + 1), i) for i, (v, n, c) in enumerate(zip(votes, got, caps, strict=True)) if v > 0 and n < c]
    heapq.heapify(left)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(left)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(left, (-votes[i] / (2 * int(got[i]) + 1), i))
    return got.tolist()


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; a target stops at ``most`` times its size and the excess is shared again."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = sorted(i for i in open_ if unit * weights[i] > most * sizes[i])
        for i in full or sorted(open_):
            out[i] = float(most * sizes[i]) if full else unit * weights[i]
        left -= sum(out[i] for i in full)
        open_ = open_ - set(full) if full else set()
    return out


def blocks(words):
    """Into how many blocks of about BLOCK words a number of words is cut."""
    return np.where(np.asarray(words) > 0, np.maximum(1, np.round(np.asarray(words) / BLOCK)), 0).astype(np.int64)


def measured(docs: DataFrame, keep: list[str], seed: int = SEED) -> DataFrame:
    """doc (struct of the columns to keep), source, size, at (the seeded place of a row)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.struct(*quoted(keep)).alias("doc"), F.col("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("at"))


PLAN = "sid long, source string, source_size long, target double, quota long"


def _driver_plan(totals: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """PLAN of few sources."""
    rows = sorted(totals.collect(), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in rows]
    target = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))])
    n_blocks = blocks(sizes)
    votes = [t * b / n if n else 0.0 for t, b, n in zip(target, n_blocks, sizes, strict=True)]
    quota = sainte_lague(votes, round(sum(votes)), MOST * n_blocks)
    return few_rows(totals.sparkSession, [(k, s, n, t, int(q)) for k, ((s, n), t, q) in enumerate(zip(rows, target, quota, strict=True))], PLAN)


def _wide_plan(totals: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """PLAN of any number of sources: ranks by range partitions, targets and divisor from sums over the table."""
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    # Within a sorted range the generated id counts up from the partition's own base.
    placed = written(ranged.select("source", F.col("size").alias("n"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")), "sources")
    parts = sorted(placed.groupBy("p").agg(F.count("*"), F.min("at")).collect())  # a row a partition
    before = [0]
    for _, k, _ in parts:
        before.append(before[-1] + k)
    base = few_rows(placed.sparkSession, [(p, low - b) for (p, _, low), b in zip(parts, before, strict=False)], "p int, less long")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    sid = (F.col("at") - F.col("less")).alias("sid")
    n_blocks = F.when(F.col("n") > 0, F.greatest(F.lit(1), F.bround(F.col("n") / BLOCK))).otherwise(0).cast("long")
    rows = placed.join(F.broadcast(base), "p").select(sid, "source", "n", n_blocks.alias("blocks")).withColumn("w", F.get(weight, (F.col("sid") % len(weights)).cast("int")))
    rows = written(rows, "ranked")
    total = rows.agg(F.sum("n")).first()[0]
    cap, unit, full = MOST * F.col("n"), 0.0, -1
    while True:
        over = unit * F.col("w") > cap
        k, taken, open_ = rows.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.sum(F.when(~over, F.col("w")))).first()
        if k == full or not open_:
            break
        full, unit = k, (total - taken) / open_
    target = F.least(cap.cast("double"), F.lit(unit) * F.col("w"))
    votes = F.when(F.col("n") > 0, target * F.col("blocks") / F.col("n")).otherwise(0.0)
    rows = written(rows.withColumns({"target": target, "votes": votes}), "voted")
    total_votes, most, caps = rows.agg(F.sum(F.col("votes").cast("decimal(38,9)")), F.max("votes"), F.sum(F.when(F.col("votes") > 0, MOST * F.col("blocks")))).first()
    seats = min(round(total_votes), int(caps or 0))
    by = lambda d: F.least(MOST * F.col("blocks"), F.floor(F.col("votes") / d + 0.5))
    low, high = 1e-12, most * 2 + 1
    for _ in range(40):  # each pass narrows the divisor to a sixteenth
        cuts = [low + (high - low) * k / 16 for k in range(17)]
        sums = rows.agg(*[F.sum(by(d)) for d in cuts[1:-1]]).first()
        k = sum(x > seats for x in sums)
        if not low < cuts[k] + (cuts[k + 1] - cuts[k]) / 2 < high or (low, high) == (cuts[k], cuts[k + 1]):
            break
        low, high = cuts[k], cuts[k + 1]
    rows = rows.withColumn("got", by(high).cast("long"))
    left = seats - int(rows.agg(F.sum("got")).first()[0])
    if left > 0:  # sources at the very divisor, the earlier first; few, as the divisor is exact to a double
        extra = rows.where((F.col("votes") > 0) & (F.col("got") < MOST * F.col("blocks"))).orderBy(F.desc(F.col("votes") / (2 * F.col("got") + 1)), "sid").limit(left).select("sid", F.lit(1).alias("one"))
        rows = rows.join(written(extra, "extra").hint("merge"), "sid", "left").withColumn("got", F.col("got") + F.coalesce("one", F.lit(0)))
    return rows.select("sid", "source", F.col("n").alias("source_size"), "target", F.col("got").alias("quota"))


def _share(part: pa.Table) -> pa.Table:
    """Of up to FAN shards: the quota of their parent, by Sainte-Laguë over their words."""
    part = part.sort_by("shard")
    quota = sainte_lague(part["words"].to_numpy(), part["quota"][0].as_py(), MOST * part["n_blocks"].to_numpy())
    return part.set_column(part.column_names.index("quota"), "quota", pa.array(quota, pa.int64()))


def shard_quotas(shards: DataFrame, quotas: DataFrame) -> DataFrame:
    """sid, shard, words, n_blocks, quota of shards (sid, shard, words, n_blocks) under the quotas (sid, quota), level by level."""
    most = shards.agg(F.max("shard")).first()[0] or 0
    if most < FAN:
        given = shards.join(sized(quotas), "sid")
        keys = ["sid"]
    else:
        parent = F.floor(F.col("shard") / FAN).cast("long")
        above = shards.groupBy("sid", parent.alias("shard")).agg(F.sum("words").alias("words"), F.sum("n_blocks").alias("n_blocks"))
        given = shard_quotas(written(above, "shards"), quotas).select("sid", F.col("shard").alias("parent"), "quota")
        given = shards.withColumn("parent", parent).join(given.hint("merge"), ["sid", "parent"])
        keys = ["sid", "parent"]
    schema = "sid long, shard long, words long, n_blocks long, quota long" + ", parent long" * (len(keys) - 1)
    got = given.select("sid", "shard", "words", "n_blocks", "quota", *keys[1:]).groupBy(*keys).applyInArrow(_share, schema)
    return written(got.select("sid", "shard", "words", "n_blocks", "quota"), "quotas")


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """For ``measured`` rows: doc, size, source_size, target, taken, spans.

    ``spans`` lists word ranges struct(start, end) of the document, from 0, end exclusive, once for each time they are
    taken. A null source is a source, the last one; null or empty texts have size 0 and nothing is taken of them; rows
    that repeat a doc_id are rows of their own; an empty table gives no rows. The same rows give the same mix, whatever
    their partitions: only rows alike in doc_id and text can change places with each other.
    """
    totals = written(rows.groupBy("source").agg(F.sum("size").alias("size")), "totals")
    few = totals.limit(DRIVER_SOURCES + 1).count() <= DRIVER_SOURCES
    plan = written((_driver_plan if few else _wide_plan)(totals, weights), "plan")
    sources = plan.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long"))
    # The rows' side of the join is the larger one by far; a hot source's rows are split by adaptive execution where they are not broadcast to.
    sources = F.broadcast(sources) if few else sources.hint("merge")
    known = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).drop("source")
    dealt = known.drop("quota").withColumn("shard", F.pmod(F.xxhash64("at"), F.col("n_shards")))
    n_blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.bround(F.col("words") / BLOCK))).otherwise(0).cast("long")
    by_shard = written(dealt.groupBy("sid", "shard").agg(F.sum("size").alias("words")).withColumn("n_blocks", n_blocks), "shards")
    placed = dealt.join(sized(shard_quotas(by_shard, plan.select("sid", "quota"))), ["sid", "shard"])
    order = Window.partitionBy("sid", "shard").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("s", F.coalesce(F.sum("size").over(order), F.lit(0)))
    whole = F.greatest(F.lit(1), F.col("n_blocks"))  # a shard without words has no blocks, and no quota
    full, extra = F.floor(F.col("quota") / whole), F.col("quota") % whole
    first = F.pmod(F.xxhash64(F.lit(seed), "sid", "shard"), whole)
    word = lambda block: F.floor(block * F.col("words") / whole)
    end = first + extra
    ranges = {"lo": word(first), "hi": word(F.least(end, "n_blocks")), "over": word(F.greatest(end - F.col("n_blocks"), F.lit(0)))}
    placed = placed.withColumns({"full": F.coalesce(full, F.lit(0)).cast("int")} | {k: F.coalesce(v, F.lit(0)) for k, v in ranges.items()})
    in_doc = lambda at: F.greatest(F.lit(0), F.least(F.col("size"), at - F.col("s")))
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    spans = F.concat(F.array_repeat(span(F.lit(0), F.col("size")), F.col("full")), F.array(span(in_doc(F.col("lo")), in_doc(F.col("hi"))), span(F.lit(0), in_doc(F.col("over")))))
    spans = F.filter(spans, lambda x: x["end"] > x["start"])
    placed = placed.withColumn("spans", spans)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return placed.select("doc", "size", "source_size", "target", taken.alias("taken"), "spans")


def span_text(text: Column, start: Column, end: Column, size: Column) -> Column:
    """The words start to end of a text with the white space behind each; a whole text unchanged."""
    parts = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    return F.when((start == 0) & (end == size), text).otherwise(F.array_join(F.slice(parts, start.cast("int") + 1, (end - start).cast("int")), ""))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each span that is taken."""
    got = mix(measured(docs, docs.columns)).select("doc", "size", F.explode("spans").alias("x"))
    text = span_text(F.col("doc.text"), F.col("x.start"), F.col("x.end"), F.col("size"))
    return got.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*").select(quoted(docs.columns))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(measured(table(spark, sf_dir, "documents"), ["doc_id"]), "sizes")
    return mix(rows).select("doc.doc_id", "size", "source_size", "target", "taken")
