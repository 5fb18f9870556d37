import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming.limits import step
from corpusloom.streaming.windows import limited_by_windows


def brute(rows, window, limit):
    out, state = {}, {}
    for k, s, t in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        anchor, count, rejected = step(*state.get(k, (None, 0)), s, window, limit)
        state[k] = (anchor, count)
        out[k, t] = rejected
    return out


@pytest.mark.parametrize("window,limit,span", [(10, 3, 300), (60, 2, 2000), (1, 1, 60)])
def test_same_as_row_by_row(spark, window, limit, span):
    rng = random.Random(span)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.randint(0, span) + rng.choice([0, 0, 5 * span]), t) for t in range(600)]
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(k, base + timedelta(seconds=s), t) for k, s, t in rows], "user string, ts timestamp, id long")
    got = {(r.user, r.id): r.rejected for r in limited_by_windows(df, "user", "ts", "id", window, limit).collect()}
    assert got == brute(rows, window, limit)


def test_one_hot_key_over_several_tasks(spark):
    """A request every second, and a burst: each window is found, and the key's rows are in many tasks."""
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.range(20_000).select(F.lit(7).alias("user"), (F.lit(base) + F.make_dt_interval(secs=(F.col("id") % 10_000).cast("decimal(18,6)"))).alias("ts"), "id")
    out = limited_by_windows(rows, "user", "ts", "id", 60, 5)
    assert out.groupBy("rejected").count().orderBy("rejected").collect()[0][1] == 5 * -(-10_000 // 61)
    assert limited_by_windows(rows.limit(0), "user", "ts", "id").count() == 0
