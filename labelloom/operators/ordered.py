"""Order statistics of large groups: running sums over ranges of values, and quantiles read from them.

A group's values are cut into ranges by Spark's range partitioning, each range is summed up, and a value's running sum is
that of its group's earlier ranges and of the smaller values in its own: no group is sorted in one task, nor held in
one buffer as an exact percentile's would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.sources.scratch import written


def prefix_sums(df: DataFrame, by: list[str], value: str, weights: list[str]) -> DataFrame:
    """``by``, ``value``, ``weights`` and for each weight w of a row: under_w (its sum over smaller values), total_w (over the group), prev_w (at the next smaller value, null at the least).

    ``df`` has one row for each value of a group. A group in which no values are given has no rows.
    """
    by = list(by)
    ranged = df.select(*by, value, *weights).repartitionByRange(*by, value).withColumn("range", F.spark_partition_id())
    rows = written(ranged, "ranges")  # a range's number must stay
    last = F.max_by(F.struct(*weights), value)
    parts = rows.groupBy(*by, "range").agg(*[F.sum(w).alias(w) for w in weights], last.alias("last"))
    group = Window.partitionBy(*by)
    order = group.orderBy("range")
    before = parts.select(*by, "range", F.lag("last").over(order).alias("last"), *[(F.sum(w).over(order) - F.col(w)).alias(f"before_{w}") for w in weights], *[F.sum(w).over(group).alias(f"total_{w}") for w in weights])
    own = Window.partitionBy(*by, "range").orderBy(value)
    placed = rows.join(before.hint("merge"), [*by, "range"])
    under = [(F.col(f"before_{w}") + F.coalesce(F.sum(w).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(f"under_{w}") for w in weights]
    prev = [F.coalesce(F.lag(w).over(own), F.col("last")[w]).alias(f"prev_{w}") for w in weights]
    return placed.select(*by, value, *weights, *under, *[f"total_{w}" for w in weights], *prev)


def ranks_of(at: list[float], n: Column, first: Column, last: Column) -> Column:
    """struct(k, low, high, rest) of the quantiles whose lower or higher rank, from 0 to n - 1, lies between first and last.

    Quantile k lies ``rest`` of the way from the value at rank floor(at[k] * (n - 1)) to that at the next; low and high say
    which of the two stands here.
    """
    here = lambda r: (r >= first) & (r <= last)

    def told(q: Column, k: Column) -> Column:
        place = q * (n - 1)
        return F.struct(k.alias("k"), here(F.floor(place)).alias("low"), here(F.ceil(place)).alias("high"), (place - F.floor(place)).alias("rest"))

    steps = len(at) - 1
    if steps < 1 or at != [k / steps for k in range(steps + 1)]:
        return F.filter(F.transform(F.lit(at), told), lambda x: x["low"] | x["high"])
    # Evenly spaced ones, of which few can lie here: those from just below the first rank to just above the last.
    near = lambda r: F.least(F.greatest(F.floor(r * steps / F.greatest(n - 1, F.lit(1))), F.lit(0)), F.lit(steps)).cast("int")
    some = F.sequence(near(first - 2), near(last + 2) + 1)
    return F.filter(F.transform(some, lambda k: told(k / F.lit(float(steps)), k)), lambda x: (x["k"] <= steps) & (x["low"] | x["high"]))


def cuts(prefix: DataFrame, by: list[str], value: str, weights: list[str], at: list[float], least: int = 0) -> DataFrame:
    """``by``, k, t and, for each weight w, under_w and total_w: quantile k's value t by linear interpolation and what lies under it, from prefix sums whose weights count rows together.

    In a group of fewer than ``least`` rows every value is a cut, and k its rank.
    """
    by = list(by)
    n, first = sum(F.col(f"total_{w}") for w in weights), sum(F.col(f"under_{w}") for w in weights)
    last = first + sum(F.col(w) for w in weights) - 1
    own = F.array(F.struct(first.cast("int").alias("k"), F.lit(True).alias("low"), F.lit(True).alias("high"), F.lit(0.0).alias("rest")))
    x = F.when(n < least, own).otherwise(ranks_of([float(q) for q in at], n, first, last)) if least else ranks_of([float(q) for q in at], n, first, last)
    here = prefix.select(*by, value, *[f"under_{w}" for w in weights], *[f"total_{w}" for w in weights], F.explode(x).alias("x"))
    row = F.struct(F.col(value).cast("double").alias("v"), *[f"under_{w}" for w in weights])
    side = lambda s: F.max(F.when(F.col(f"x.{s}"), row)).alias(s)
    met = here.groupBy(*by, F.col("x.k").alias("k"), F.col("x.rest").alias("rest"), *[f"total_{w}" for w in weights]).agg(side("low"), side("high"))
    t = F.least(F.col("low.v") + F.col("rest") * (F.col("high.v") - F.col("low.v")), F.col("high.v"))
    # At the lower value itself its own rows are not under the cut; beyond it they are.
    under = [F.when(F.col("t") <= F.col("low.v"), F.col(f"low.under_{w}")).otherwise(F.col(f"high.under_{w}")).alias(f"under_{w}") for w in weights]
    return met.withColumn("t", t).select(*by, "k", "t", *under, *[f"total_{w}" for w in weights])


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, v, c: how often each value that is not null stands in its group."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """``by``, q (array of the quantiles by linear interpolation, as numpy's) and n of each group with values; nulls are left out."""
    by = list(by)
    got = cuts(prefix_sums(value_counts(df, by, value), by, "v", ["c"]), by, "v", ["c"], at)
    return got.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("q"), F.max("total_c").alias("n"))
