"""Search telemetry, timings, evaluation and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .filters import search_flags
from .quantiles import quantiles


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def kpis(searches: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row of counts and rates; the interaction rate is per search with results and may exceed 1."""
    flags = search_flags(searches, interactions.select(F.col("search_event_id").alias("id")))
    s = flags.agg(F.count("*").alias("total_searches"), _count(F.col("zero")).alias("zero_result_count"), _count(F.col("weak")).alias("weak_result_count"), _count(F.col("result_count") > 0).alias("searches_with_results"), _count(F.col("no_interaction")).alias("no_interaction_count"))
    i = interactions.agg(F.count("*").alias("interaction_count"))
    both = s.join(F.broadcast(i))
    return both.select(
        "*",
        rate(F.col("interaction_count"), F.col("searches_with_results")).alias("interaction_rate"),
        rate(F.col("zero_result_count"), F.col("total_searches")).alias("zero_result_rate"),
        rate(F.col("weak_result_count"), F.col("total_searches")).alias("weak_result_rate"),
        rate(F.col("no_interaction_count"), F.col("searches_with_results")).alias("no_interaction_rate"),
    )


COUNTERS = ("searches", "zero", "weak", "with_results", "no_interaction", "interactions")


def daily(searches: DataFrame, interactions: DataFrame) -> DataFrame:
    """Counters by day: a search counts on its own day, an interaction on its own; what nobody touched on the search's."""
    flags = search_flags(searches, interactions.select(F.col("search_event_id").alias("id")))
    one = lambda c: c.cast("long")
    s = flags.select(F.to_date("created_at").alias("dt"), F.lit(1).cast("long").alias("searches"), one(F.col("zero")).alias("zero"), one(F.col("weak")).alias("weak"), one(F.col("result_count") > 0).alias("with_results"), one(F.col("no_interaction")).alias("no_interaction"), F.lit(0).cast("long").alias("interactions"))
    i = interactions.select(F.to_date("created_at").alias("dt"), *[F.lit(int(c == "interactions")).cast("long").alias(c) for c in COUNTERS])
    return s.unionByName(i).groupBy("dt").agg(*[F.greatest(F.lit(0), F.sum(c)).alias(c) for c in COUNTERS])


def range_sum(days: DataFrame, first: str, last: str, retention: int = V.RETENTION_DAYS) -> DataFrame:
    """Counters over a range of days, cut to the retention before the last day there is."""
    newest = days.agg(F.max("dt").alias("_newest"))
    d = days.join(F.broadcast(newest)).where((F.col("dt") >= F.lit(first).cast("date")) & (F.col("dt") <= F.lit(last).cast("date")) & (F.col("dt") >= F.date_sub("_newest", retention)))
    return d.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def quality_lists(searches: DataFrame, interactions: DataFrame, limit: int = 50) -> DataFrame:
    """(category, id, rank): the newest of each category, at most `limit`."""
    f = search_flags(searches, interactions.select(F.col("search_event_id").alias("id")))
    named = F.array_compact(F.array(F.lit("recent"), F.when(F.col("zero"), F.lit("zero_result")), F.when(F.col("weak"), F.lit("weak_result")), F.when(F.col("no_interaction"), F.lit("no_interaction"))))
    order = Window.partitionBy("category").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return f.select("id", "created_at", F.explode(named).alias("category")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("category", "id", "rank")


def funnel(searches: DataFrame, interactions: DataFrame) -> DataFrame:
    """Each search with its interactions in order of time; only those from the day before the search on."""
    s, i = searches.alias("s"), interactions.alias("i")
    on = (F.col("s.id") == F.col("i.search_event_id")) & (F.col("i.created_at") >= F.col("s.created_at") - F.expr("INTERVAL 1 DAY"))
    item = F.when(F.col("i.id").isNotNull(), F.struct(F.col("i.created_at").alias("at"), F.col("i.id").alias("id"), F.col("i.image_id").alias("image_id")))
    return s.join(i, on, "left").groupBy(F.col("s.id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def step_times(details: DataFrame) -> DataFrame:
    """(step, n, total, mean, p50, p95, share) of rows with steps map<string,double> and total_sec; quantiles are exact."""
    whole = details.agg(F.sum("total_sec").alias("_all"))
    steps = details.select(F.explode("steps").alias("step", "sec"))
    g = steps.groupBy("step").agg(F.count("*").alias("n"), F.sum("sec").alias("total"), F.avg("sec").alias("mean"))
    at = quantiles(steps, "step", "sec", [0.5, 0.95]).groupBy("step").agg(*(F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(c) for s, c in ((0.5, "p50"), (0.95, "p95"))))
    return g.join(at, "step", "left").join(F.broadcast(whole)).select("step", "n", *[F.round(c, 6).alias(c) for c in ("total", "mean", "p50", "p95")], F.when(F.col("_all") > 0, F.round(100 * F.col("total") / F.col("_all"), 4)).otherwise(0.0).alias("share"))


def query_times(steps: DataFrame) -> DataFrame:
    """(id, step, ms, share): steps of the same name add up; milliseconds to one place, share of the query's wall time."""
    g = steps.groupBy("id", "step").agg(F.sum("seconds").alias("s"))
    wall = F.sum("s").over(Window.partitionBy("id"))
    return g.select("id", "step", (F.floor(F.col("s") * 10000 + 0.500001) / 10).alias("ms"), F.when(wall > 0, F.round(100 * F.col("s") / wall, 4)).otherwise(0.0).alias("share"))


# --- evaluation -----------------------------------------------------------------------------------------------------


def case_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Hit@k, recall@k and reciprocal ranks per case.

    `ranked`: (case_id, id, rank); `relevant`: (case_id, id, pos). `mrr` takes the first listed relevant id that was retrieved,
    `mrr_best` the best placed one.
    """
    j = relevant.join(ranked, ["case_id", "id"], "left")
    listed = F.min_by("rank", F.when(F.col("rank").isNotNull(), F.col("pos")))
    out = [F.countDistinct("id").alias("n_relevant"), F.coalesce(1.0 / listed, F.lit(0.0)).alias("mrr"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr_best")]
    for k in ks:
        found = F.countDistinct(F.when(F.col("rank") <= k, F.col("id")))
        out += [(found > 0).alias(f"hit_{k}"), (found / F.countDistinct("id")).alias(f"recall_{k}")]
    return j.groupBy("case_id").agg(*out)


def macro(cases: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Means over all cases; zeros without any."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return cases.agg(F.count("*").alias("cases"), mean("mrr").alias("mrr"), *[x for k in ks for x in (mean(F.col(f"hit_{k}").cast("double")).alias(f"hit_{k}"), mean(f"recall_{k}").alias(f"recall_{k}"))])


# --- corpus ---------------------------------------------------------------------------------------------------------


def top(df: DataFrame, value: Column, n: int, kind: str) -> DataFrame:
    """(kind, value, n, rank): the most frequent values; ties go by value."""
    g = df.select(value.alias("value")).where("value is not null and value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    best = g.orderBy(F.col("n").desc(), "value").limit(n)
    return best.select(F.lit(kind).alias("kind"), "value", "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "value")).alias("rank"))


def samples(df: DataFrame, value: Column, order: str, n: int, limit: int, kind: str) -> DataFrame:
    """(kind, value, rank): the first distinct values, whatever their case, no longer than `limit`."""
    rows = df.select(T.strip(T.text_or_empty(value)).alias("value"), F.col(order).alias("pos")).where((F.col("value") != "") & (F.length("value") <= limit))
    first = rows.groupBy(F.lower("value").alias("key")).agg(F.min_by("value", F.struct("pos", "value")).alias("value"), F.min("pos").alias("pos"))
    best = first.orderBy("pos", "value").limit(n)
    return best.select(F.lit(kind).alias("kind"), "value", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos", "value")).alias("rank"))


def distribution(images: DataFrame) -> DataFrame:
    """(asset_type, n, percent) of the whole taxonomy, zero rows included, and `unclassified`."""
    spark = images.sparkSession
    kind = F.when(T.blank("asset_type"), "unclassified").when(F.lower(T.strip("asset_type")).isin(*V.ASSET_TYPES), F.lower(T.strip("asset_type"))).otherwise("other")
    counts = images.groupBy(kind.alias("asset_type")).agg(F.count("*").alias("n"))
    taxonomy = spark.createDataFrame([(t,) for t in (*V.ASSET_TYPES, "unclassified")], "asset_type string")
    whole = images.agg(F.count("*").alias("_all"))
    j = taxonomy.join(counts, "asset_type", "left").join(F.broadcast(whole)).na.fill(0, ["n"])
    return j.select("asset_type", "n", F.when(F.col("_all") > 0, F.round(100.0 * F.col("n") / F.col("_all"), 2)).otherwise(0.0).alias("percent"))


def confusion(images: DataFrame) -> DataFrame:
    """(signal, n, ids): rows whose tags or caption contradict their asset type, with the five smallest ids."""
    from .maintenance import counted_with_samples

    tags = F.lower(F.array_join("tags", " "))
    blob = F.lower(F.concat_ws(" ", "caption_short", "caption_detailed", F.array_join("tags", " ")))
    signals = []
    for signal, needles, kind, captions in V.CONFUSION_RULES:
        held = F.lit(False)
        for n in needles:
            held = held | F.contains(blob if captions else tags, F.lit(n))
        signals.append(F.when((F.lower(T.strip(T.text_or_empty("asset_type"))) == kind) & held, F.lit(signal)))
    # all rules in one pass over the rows
    found = images.select("image_id", F.explode(F.array_compact(F.array(*signals))).alias("signal"))
    rules = images.sparkSession.createDataFrame([(r[0],) for r in V.CONFUSION_RULES], "signal string")
    counted = counted_with_samples(found, "signal", "image_id", 5)
    none = F.array().cast("array<bigint>")
    return F.broadcast(rules).join(counted, "signal", "left").select("signal", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("ids", none).alias("ids"))
