"""Exact quantiles without gathering or sorting the values: selection by histograms that narrow.

Each round counts the values between a group's bounds in bins; the bin that holds the wanted rank gives the next
bounds (its own least and largest value, so nothing depends on how a bin's edge is rounded). A group is done when its
bounds are equal, however often that value is repeated, or when few values lie between them: those are
ranked directly. A task holds at most a row for each bin and group, or those few values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..iterate import durable

#: Bins of a round, and how many values of a group one task may rank.
BINS, FEW = 2048, 20_000


def _met(values: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """The values between the bounds of their group; without groups the bounds are at most two rows."""
    joined = values.join(bounds, by) if by else values.crossJoin(F.broadcast(bounds))
    return joined.where(F.col("value").between(F.col("low"), F.col("high")))


def quantile(df: DataFrame, value: str, share: float, by: tuple[str, ...] = (), bins: int = BINS, few: int = FEW) -> DataFrame:
    """(by..., quantile): the value at share * (n - 1) of the sorted values of each group, between two by their distance.

    Nulls and NaN are left out; a group without values has no row (without groups there is then one null row). Ties
    and infinities are values like others. share is between 0 and 1."""
    by = list(by)
    values = df.select(*by, F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    facts = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).where("n > 0")
    place = g.real(share) * (F.col("n") - 1)
    ranks = F.array(*(F.struct(f(place).cast("long").alias("rank"), (place - F.floor(place)).alias("part"), F.lit(k).alias("end")) for k, f in enumerate((F.floor, F.ceil))))
    bounds = durable(facts.select(*by, "low", "high", F.col("n").alias("within"), F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("r")).select(*by, "low", "high", "within", "below", "r.*"), "bounds")
    settled = []
    keys = [*by, "end"]
    while True:
        settled.append(bounds.where((F.col("low") == F.col("high")) | (F.col("within") <= few)))
        wide = bounds.where((F.col("low") < F.col("high")) & (F.col("within") > few))
        if not wide.take(1):
            break
        # halves, so that the distance of two values is always a number; in ascending order like the values
        half = lambda c: F.greatest(F.least(F.col(c), g.real(1.7e308)), g.real(-1.7e308)) / 2
        at = F.least(F.floor((half("value") - half("low")) / (half("high") - half("low")) * bins).cast("int"), F.lit(bins - 1))
        # an infinity is a bin of its own beside those of the numbers
        at = F.when(half("low") == half("high"), F.when(F.col("value") == F.col("low"), 0).otherwise(1)).otherwise(at)
        at = F.when(F.col("value") == F.col("high"), F.lit(bins)).otherwise(at)
        counted = _met(values, wide, by).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("m"), F.min("value").alias("bin_low"), F.max("value").alias("bin_high"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("before", before).join(wide.select(*keys, "rank", "part", "below"), keys).withColumn("before", F.col("before") + F.col("below"))
        held = found.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
        bounds = durable(held.select(*by, F.col("bin_low").alias("low"), F.col("bin_high").alias("high"), F.col("m").alias("within"), F.col("before").alias("below"), "rank", "part", "end"), "bounds")
    done = settled[0]
    for s in settled[1:]:
        done = done.unionByName(s)
    single = done.where(F.col("low") == F.col("high")).select(*keys, "part", F.col("low").alias("value"))
    ranked = _met(values, done.where(F.col("low") < F.col("high")), by).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("value")) - 1)
    both = single.unionByName(ranked.where(F.col("k") + F.col("below") == F.col("rank")).select(*keys, "part", "value"))
    ends = both.groupBy(*by).agg(*(F.max(F.when(F.col("end") == k, F.col("value"))).alias(c) for k, c in enumerate(("a", "b"))), F.max("part").alias("part"))
    return ends.select(*by, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias("quantile"))
