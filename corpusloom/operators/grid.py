"""A grid of cells in which every row of one table meets every row of another, for searches that score all or most pairs.

Both tables are dealt into parts by a hash of their keys, and each part is sent to the cells of its row or column by one
exchange. The plan is the same for any number of rows: nothing is broadcast, and the driver only counts. A cell holds
ROWS rows of each side at most, about, so its memory does not grow with the tables; what leaves it are a few rows a query.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and searched rows of a cell, about.
QUERIES, ROWS = 4096, 1 << 14


def parts_of(df: DataFrame, count: int, each: int, least: int = 1) -> int:
    """Parts so that each has about ``each`` of ``count`` rows, and there are ``least`` of them where rows allow it."""
    return max(1, -(-count // each), min(least, -(-count // 256)))


def dealt(df: DataFrame, key: str, parts: int, others: int, own: str, other: str) -> DataFrame:
    """Each row once for every part of the other table, with its cell in columns ``own`` and ``other``."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def on_grid(
    queries: DataFrame, rows: DataFrame, query: str, key: str, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    each_query: int = QUERIES, each_row: int = ROWS, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """``search(queries of a cell, rows of a cell)`` of all cells. ``sizes`` are the numbers of distinct keys, if known."""
    n, m = sizes or (queries.count(), rows.count())
    cores = rows.sparkSession.sparkContext.defaultParallelism
    across, down = parts_of(rows, m, each_row, cores), parts_of(queries, n, each_query)
    left = dealt(queries, query, down, across, "_down", "_across").groupBy("_down", "_across")
    right = dealt(rows, key, across, down, "_across", "_down").groupBy("_down", "_across")
    return left.cogroup(right).applyInArrow(search, schema)
