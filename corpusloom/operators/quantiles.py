"""Exact quantiles of groups of any size: brackets around the wanted ranks, made narrower by counting.

A pass cuts the rows inside each group's bracket into STEPS stretches of about equal counts, takes the few around the wanted
rank, and counts exactly what lies below and inside. When no bracket holds more than ``small`` rows, or all its rows are
equal, the rest is ranked. No task and no state holds the values of a group; each pass leaves a hundredth, about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.folders import shared_folder

#: Stretches of a pass, how much finer the sketch that cuts them is, rows of a group that are ranked at once.
STEPS, FINER, SMALL = 200, 50, 1 << 16


def written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def exact_quantile(rows: DataFrame, group: str, value: str, q: float, small: int = SMALL, name: str = "quantile") -> DataFrame:
    """group, ``name``: the q-quantile of each group's values, between the two nearest ranks by linear interpolation. Null values
    take no part; a group without others has null. Groups may be null."""
    held = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    some = held.filter("v IS NOT NULL")
    pos = q * (F.col("n") - 1)
    state = held.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = written(state.select("g", "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.floor(pos).alias("k"), (pos - F.floor(pos)).alias("part")))
    within = F.expr("r.g <=> s.g AND r.v >= s.lo AND r.v <= s.hi")
    while True:
        wide = state.filter((F.col("inside") > small) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        cuts = [i / STEPS for i in range(STEPS + 1)]
        mine = some.alias("r").join(wide.select("g", "lo", "hi").alias("s"), within).select("r.g", "r.v")
        sketch = mine.groupBy("g").agg(F.percentile_approx("v", cuts, STEPS * FINER).alias("cuts"))
        step = lambda at: F.floor((F.col("k") - F.col("below") + at) * STEPS / F.col("inside")).cast("int")
        near = wide.alias("s").join(sketch.alias("c"), F.expr("s.g <=> c.g")).select(
            "s.g", F.element_at("cuts", F.greatest(step(0), F.lit(1))).alias("lo2"), F.element_at("cuts", F.least(step(1) + 3, F.lit(STEPS + 1))).alias("hi2")
        )
        near = written(near)
        parts = some.alias("r").join(wide.alias("s"), within).join(near.alias("c"), F.expr("r.g <=> c.g")).groupBy("r.g").agg(
            F.count_if(F.expr("v < lo2")).alias("less"), F.count_if(F.expr("v >= lo2 AND v <= hi2")).alias("held")
        )
        new = wide.alias("s").join(near.alias("c"), F.expr("s.g <=> c.g")).join(parts.alias("p"), F.expr("s.g <=> p.g"))
        # the bracket is only taken if it holds both ranks and is smaller, which the sketch's bound gives
        fine = F.expr("below + less <= k AND k + 1 < below + less + held OR below + less <= k AND k + 1 >= n AND k < below + less + held") & F.expr("held < inside")
        new = new.select("s.g", "n", F.when(fine, F.col("lo2")).otherwise(F.col("lo")).alias("lo"), F.when(fine, F.col("hi2")).otherwise(F.col("hi")).alias("hi"), F.when(fine, F.expr("below + less")).otherwise(F.col("below")).alias("below"), F.when(fine, F.col("held")).otherwise(F.col("inside")).alias("inside"), "k", "part", fine.alias("fine"))
        new = written(new)
        done = state.filter((F.col("inside") <= small) | (F.col("lo") >= F.col("hi")) | F.col("lo").isNull())
        state = written(done.unionByName(new.drop("fine")))
        if new.filter("fine").isEmpty():
            break
    rest = state.filter("lo < hi").select("g", "lo", "hi", "below", "k").alias("s")
    nth = F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1 + F.col("below")
    ranked = some.alias("r").join(rest, within).select("r.g", "r.v", "s.below", "s.k").withColumn("nth", nth)
    ends = ranked.filter("nth BETWEEN k AND k + 1").groupBy("g").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    out = state.alias("s").join(ends.alias("e"), F.expr("s.g <=> e.g"), "left")
    exact = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return out.select(F.col("s.g").alias(group), exact.alias(name))
