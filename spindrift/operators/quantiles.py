"""Exact quantiles of groups of any size, by selection: histograms that narrow on the wanted ranks.

The first pass counts values by sign and magnitude, the next ones by equal steps between the smallest and the largest value of the
bucket that holds a rank; each halves the exponent's or the fraction's bits many times, so two or three passes leave few values. A
rank whose bucket holds one value, repeated or not, is found. When no bucket holds more than FEW values, those left are sorted, per rank.
No task has more than FEW values of a rank; histograms are added up before they are shuffled, so a hot group is no more than its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialised

#: Buckets of a pass, buckets of a factor of two in the first pass, and values that are sorted in the end.
STEPS, FINE, FEW = 4_096, 16, 1_000


def _magnitude(value: Column) -> Column:
    """A bucket that doesn't fall as the value grows: sixteenths of a factor of two, on either side of zero."""
    return F.floor(F.signum(value) * F.log2(1 + F.abs(value) * 2.0**40) * FINE).cast("long")


def _chosen(ranks: DataFrame, buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Of each rank the bucket that holds it: `low`, `high`, `n` of it, and the rank within it."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    below = buckets.withColumn("_upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ranks.join(below, [c for c in keys])
    inside = (F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("n"))
    return joined.where(inside).withColumn("rank", F.col("rank") - F.col("_upto") + F.col("n")).drop("_upto", "bucket")


def quantiles(values: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, share, quantile): each share between 0 and 1 of each group's values, between neighbours by their distance.

    Equal to `percentile`. Nulls and values that aren't numbers are left out, as are groups without any.
    """
    spark = values.sparkSession
    rows = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    rows = materialised(rows, "quantile-values")
    first = materialised(rows.groupBy("g", _magnitude(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "quantile-buckets")
    asked = spark.createDataFrame([(float(s),) for s in shares], "share double")
    sizes = first.groupBy("g").agg(F.sum("n").alias("total"))
    place = F.col("share") * (F.col("total") - 1)
    # the neighbours of a place: two ranks from 0, which may be the same
    both = sizes.join(F.broadcast(asked)).select("g", "share", (place - F.floor(place)).alias("part"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank")).distinct()
    ranks = both.select("g", "rank").distinct().withColumn("asked", F.col("rank"))
    null_safe = first.withColumn("g_", F.struct("g"))
    ranks = ranks.withColumn("g_", F.struct("g")).drop("g")
    ranks = _chosen(ranks, null_safe.drop("g"), ["g_"])
    rows = rows.select(F.struct("g").alias("g_"), "v")
    found = None
    while True:
        ranks = materialised(ranks.select("g_", "asked", "rank", "n", "low", "high"), "quantile-ranks")
        done = ranks.where("low = high").select("g_", "asked", F.col("low").alias("v"))
        found = done if found is None else found.union(done)
        ranks = ranks.where("low < high")
        most = ranks.agg(F.max("n")).first()[0]
        if most is None:
            break
        spans = ranks.select("g_", "low", "high").distinct()
        held = rows.join(spans, (rows.g_ == spans.g_) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).select(rows.g_.alias("g_"), "low", "high", "v")
        if most <= FEW:
            near = held.withColumn("rank", F.row_number().over(Window.partitionBy("g_", "low", "high").orderBy("v")) - 1)
            found = found.union(ranks.join(near, ["g_", "low", "high", "rank"]).select("g_", "asked", "v"))
            break
        step = F.least(F.lit(STEPS - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * STEPS))
        keys = ["g_", "_low", "_high"]
        counted = held.select("g_", F.col("low").alias("_low"), F.col("high").alias("_high"), step.alias("bucket"), "v").groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        ranks = _chosen(ranks.select("g_", F.col("low").alias("_low"), F.col("high").alias("_high"), "asked", "rank"), counted, keys)
    ends = found.withColumn("g", F.col("g_.g")).select(F.col("g").alias("_g"), F.col("asked").alias("rank"), "v").distinct()
    met = both.join(ends, (both.g.eqNullSafe(ends._g)) & (both["rank"] == ends["rank"])).select("g", "share", "part", "v")
    low, high = F.min("v"), F.max("v")
    out = met.groupBy("g", "share").agg((low * (1 - F.first("part")) + high * F.first("part")).alias("quantile"))
    return out.withColumnRenamed("g", group)
