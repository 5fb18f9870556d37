"""The same request limit for keys of any size: window starts by pointer doubling over slots of time, then counts.

A request opens a window if no earlier one reaches it, and the next window opens with the first request more than ``window``
seconds later. That depends on times alone. Time is cut into slots of ``window`` + 1 seconds, of which each holds one opening
at most; so the request that would open the next window is in the next slot, or is the first one of a later slot, and an
opening that covers a request is in its slot or in the one before. A key's requests are thus dealt by (key, slot), never
by key. Requests after a pause longer than the window open one for certain; from these the pointers are followed in
doubled steps, until no chain is left that goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.folders import shared_folder


def written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "limits")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def pointers(seconds: DataFrame, window: int) -> DataFrame:
    """k, s, slot, nxt (second of the request that opens the next window if ``s`` opens one), starts (after a pause)."""
    size = window + 1
    each = seconds.groupBy("k", "slot").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    order = Window.partitionBy("k").orderBy("slot")  # a row a slot
    ahead = [F.lead(c, n).over(order).alias(f"{c}{n}") for n in (1, 2) for c in ("slot", "first")]
    around = each.select("k", "slot", F.lag("last").over(order).alias("previous"), *ahead)
    later = F.when(F.col("slot1") == F.col("slot") + 1, F.col("first2")).otherwise(F.col("first1"))
    around = around.select("k", "slot", "previous", later.alias("later"))
    # within a slot: probes of the slot before it meet the first request at or after their end
    probes = seconds.select("k", (F.col("slot") + 1).alias("slot"), (F.col("s") + size).alias("t"), F.col("s").alias("own"), F.lit(None).cast("long").alias("found"))
    events = seconds.select("k", "slot", F.col("s").alias("t"), F.lit(None).cast("long").alias("own"), F.col("s").alias("found"))
    down = Window.partitionBy("k", "slot").orderBy(F.desc("t"), F.col("own").isNotNull())
    met = probes.unionByName(events).withColumn("next", F.last("found", True).over(down)).filter("own IS NOT NULL").select("k", F.col("own").alias("s"), "next")
    before = F.lag("s").over(Window.partitionBy("k", "slot").orderBy("s"))
    local = seconds.select("k", "slot", "s", before.alias("before"))
    rows = local.join(met, ["k", "s"], "left").join(around, ["k", "slot"])
    starts = F.coalesce(F.col("s") - F.coalesce("before", "previous") > window, F.lit(True))
    return rows.select("k", "s", "slot", F.coalesce("next", "later").alias("nxt"), starts.alias("starts"))


def openings(seconds: DataFrame, window: int) -> DataFrame:
    """k, slot, anchor: the second of every opening."""
    rows = written(pointers(seconds, window))
    starts = rows.filter("starts").select("k", "s")
    found = written(starts)
    sure = starts.select("k", F.col("s").alias("nxt"))
    jumps = written(rows.filter("nxt IS NOT NULL").select("k", "s", "nxt").join(sure, ["k", "nxt"], "left_anti").select("k", "s", "nxt"))
    while True:
        fresh = found.join(jumps, ["k", "s"]).select("k", F.col("nxt").alias("s"))
        if fresh.isEmpty():
            return found.select("k", F.floor(F.col("s") / (window + 1)).alias("slot"), F.col("s").alias("anchor"))
        found = written(found.unionByName(fresh).distinct())
        twice = jumps.alias("a").join(jumps.alias("b"), F.expr("a.k = b.k AND a.nxt = b.s")).select("a.k", "a.s", "b.nxt")
        jumps = written(twice)


def limited_by_windows(events: DataFrame, key: str, ts: str, tie: str, window: int = 60, limit: int = 30) -> DataFrame:
    """key, tie, rejected for every event, as :func:`corpusloom.streaming.limits.limited` has them; ``tie`` is distinct among a
    key's events of one time. Events with a null key are one key's, and ``tie`` is a whole number."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"), F.unix_timestamp(ts).alias("s"), F.col(tie).cast("long").alias("t"), F.col(ts).alias("x"))
    rows = rows.withColumn("slot", F.floor(F.col("s") / (window + 1)))
    opened = openings(rows.select("k", "s", "slot").distinct(), window)
    near = opened.unionByName(opened.withColumn("slot", F.col("slot") + 1)).groupBy("k", "slot").agg(F.max("anchor").alias("late"), F.min("anchor").alias("early"))
    placed = rows.join(near, ["k", "slot"]).withColumn("anchor", F.when(F.col("late") <= F.col("s"), F.col("late")).otherwise(F.col("early"))).drop("late", "early")
    order = Window.partitionBy("k", "anchor").orderBy("x", "t")
    passed = placed.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit)  # limited before the shuffle
    last = passed.groupBy("k", "anchor").agg(F.max(F.struct("x", "t")).alias("last"))
    out = placed.join(last, ["k", "anchor"])
    name = F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)).cast(kind)
    return out.select(name.alias(key), F.col("t").alias(tie), (F.struct("x", "t") > F.col("last")).alias("rejected"))
