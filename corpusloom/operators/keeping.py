"""Tables kept on the executors for a plan that reads them twice, one for each use: a new one lets the last one go."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_held: dict[str, DataFrame] = {}


def kept(df: DataFrame, use: str) -> DataFrame:
    """``df``, persisted until the next table is kept for the same ``use``. Plans that still read an older one compute it again."""
    let_go(use)
    _held[use] = df.persist(StorageLevel.MEMORY_AND_DISK)
    return _held[use]


def let_go(use: str) -> None:
    old = _held.pop(use, None)
    if old is not None and old.sparkSession._jsc.sc().isStopped() is False:
        old.unpersist()
