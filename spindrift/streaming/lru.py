"""A store of sessions with a limit on age and on number, least recently used first, told for a whole log at once.

The rule: an event uses its session if the store has it, or else creates it; only then, before it is put there, the store drops sessions that were not used for
`ttl` seconds, and after those the least recently used beyond `limit`. State is one for all keys, so no key's events alone can tell.

So an event at t whose session was last used at L finds it dropped if the last creation c before t came more than `ttl` after L, or if `limit` other
sessions were used between L and c. That number is a reuse distance: the events a with L < a < c whose own session was last used at L or
before. Over events in order, with `prev` the place of a session's use before, it is

    #{a: place < c, prev <= L} - (L + 1).

Such pairs are counted over a grid of at most GRID ranges of places by GRID ranges of prev: whole cells from sums of the grid, which is small,
and the two strips at the edges inside their range, by sorting. Whether events before t were creations isn't known at first: those of
sessions not seen before are, and each round finds more from the creations known, until there are none; as an event depends on earlier
ones only, that is the one answer. A task holds n / GRID events, and queries are dealt with their strip's points in parts of that size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators.ordering import numbered
from ..sources.shared import materialised

GRID = 1_024
#: Events of a range at least.
LEAST = 1_000


def dominated(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For every query the number of points with x < qx and y <= qy: by bits of the points' ranks, all queries at once."""
    order = np.argsort(px, kind="stable")
    ys = np.sort(py)
    rank = np.empty(len(py), np.int64)
    rank[np.argsort(py, kind="stable")] = np.arange(len(py))
    a = rank[order]
    begin, end = np.zeros(len(qx), np.int64), np.searchsorted(px[order], qx, "left")
    below, out = np.searchsorted(ys, qy, "right"), np.zeros(len(qx), np.int64)
    # the points of a prefix whose rank is under `below`: at each bit, those that have a 0 where it has a 1
    for bit in range(max(1, int(len(a)).bit_length()) - 1, -1, -1):
        one = (a >> bit) & 1 == 1
        zeros = np.r_[0, np.cumsum(~one)]
        high = (below >> bit) & 1 == 1
        out += np.where(high, zeros[end] - zeros[begin], 0)
        many = zeros[-1]
        begin = np.where(high, many + begin - zeros[begin], zeros[begin])
        end = np.where(high, many + end - zeros[end], zeros[end])
        a = np.r_[a[~one], a[one]]
    return out


def _strip(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """n of queries (place, x, y): points (x, y) of the strip below them."""
    n = dominated(*(points[c].to_numpy(np.int64) for c in "xy"), *(queries[c].to_numpy(np.int64) for c in "xy")) if len(points) else np.zeros(len(queries), np.int64)
    return pd.DataFrame({"place": queries["place"].to_numpy(np.int64), "n": n})


def reuse_distances(events: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(place, distance): of queries (place, last, c) the sessions used between `last` and `c`, both left out.

    `events`: (place, prev) of all n events, prev -1 for a session's first.
    """
    size = max(LEAST, -(-(n + 1) // GRID))
    parts = -(-(n + 1) // size)
    points = events.select("place", (F.col("prev") + 1).alias("y")).withColumn("i", F.floor(F.col("place") / size)).withColumn("k", F.floor(F.col("y") / size))
    asked = queries.select("place", "c", (F.col("last") + 1).alias("y"), "last").withColumn("i", F.floor(F.col("c") / size)).withColumn("k", F.floor(F.col("y") / size))
    grid = np.zeros((parts + 1, parts + 1), np.int64)
    for r in points.groupBy("i", "k").count().collect():  # at most GRID * GRID numbers
        grid[r.i + 1, r.k + 1] = r["count"]
    sums = events.sparkSession.sparkContext.broadcast(grid.cumsum(0).cumsum(1))

    @F.pandas_udf("long")
    def whole(i: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(sums.value[i.to_numpy(np.int64), k.to_numpy(np.int64)])

    # queries of a range may be many: they are dealt in parts, each with the range's points
    spread = F.pmod(F.xxhash64("place"), F.lit(8))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    by_place = points.select("i", copies.alias("s"), F.col("place").alias("x"), "y").groupBy("i", "s").cogroup(asked.select("i", spread.alias("s"), "place", F.col("c").alias("x"), "y").groupBy("i", "s"))
    # those with prev in the range of y, in ranges of places before that of c
    by_prev = points.select("k", copies.alias("s"), F.col("i").alias("x"), "y").groupBy("k", "s").cogroup(asked.select("k", spread.alias("s"), "place", F.col("i").alias("x"), "y").groupBy("k", "s"))
    strips = by_place.applyInPandas(_strip, "place long, n long").union(by_prev.applyInPandas(_strip, "place long, n long"))
    cells = asked.select("place", whole("i", "k").alias("n"))
    return strips.union(cells).groupBy("place").agg(F.sum("n").alias("n")).join(asked.select("place", "last"), "place").select("place", (F.col("n") - F.col("last") - 1).alias("distance"))


def created(events: DataFrame, key: str, at: str, id_: str, limit: int = V.SESSION_LIMIT, ttl: int = V.SESSION_TTL) -> DataFrame:
    """(id, key, created): whether each event creates its session, being the first or finding it dropped; ties in time go by id.

    A `limit` or `ttl` of 0 is none. Events without a time or an id are left out; a null key is a session like others.
    """
    rows = events.select(F.col(id_).alias("id"), F.col(key).alias("key"), F.unix_micros(F.col(at)).alias("at")).where("id is not null and at is not null")
    order = numbered(rows, ["at", "id"], "place").withColumn("place", (F.col("place") - 1).cast("long"))
    own = Window.partitionBy("key").orderBy("place")
    log = order.withColumn("prev", F.coalesce(F.lag("place").over(own), F.lit(-1).cast("long"))).withColumn("last_at", F.lag("at").over(own))
    log = materialised(log, "lru-log")
    n = log.count()
    size = max(LEAST, -(-(n + 1) // GRID))
    made = log.where("prev < 0").select("place", "at")
    known = 0
    while True:
        made = materialised(made, "lru-made")
        many = made.count()
        if many == known:
            break
        known = many
        # the last creation before each event: of its range, or else of the ranges before
        made_at = F.when(F.col("new"), F.struct(F.col("place").alias("c"), F.col("at").alias("c_at")))
        marked = log.join(made.select("place", F.lit(True).alias("new")), "place", "left").withColumn("new", F.coalesce("new", F.lit(False))).withColumn("range", F.floor(F.col("place") / size))
        lasts = marked.groupBy("range").agg(F.max(made_at).alias("own"))  # GRID rows at most
        ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        lasts = lasts.select("range", F.max("own").over(ahead).alias("before"))
        inside = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        seen = marked.withColumn("m", F.max(made_at).over(inside)).join(F.broadcast(lasts), "range").withColumn("m", F.coalesce("m", "before"))
        open_ = materialised(seen.where(~F.col("new") & (F.col("m.c") > F.col("prev"))).select("place", "at", F.col("prev").alias("last"), "last_at", "m.c", "m.c_at"), "lru-open")
        old = (F.col("c_at") - F.col("last_at") > ttl * 1_000_000) if ttl > 0 else F.lit(False)
        more = open_.where(old).select("place", "at")
        if limit > 0:
            # fewer events than the limit can't hold so many sessions
            far = open_.where(~old & (F.col("c") - F.col("last") > limit))
            distant = reuse_distances(log.select("place", "prev"), far, n).where(F.col("distance") >= limit).select("place")
            more = more.union(far.join(distant, "place").select("place", "at"))
        made = made.union(more)
    return log.join(made.select("place", F.lit(True).alias("new")), "place", "left").select("id", "key", F.coalesce("new", F.lit(False)).alias("created"))
