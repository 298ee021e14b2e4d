"""Joins on a key of which one value may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that can be hot, at most: a hot key has more than one in so many of all rows, and more than HOT_ROWS.
MOST_HOT, HOT_ROWS = 10_000, 50_000


def joined(rows: DataFrame, keys: DataFrame, key: str, size: str, total: int, largest: int, then: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """``rows`` with the columns of ``keys`` (one row per key), ``then`` applied to each part.

    ``keys`` names in ``size`` how many rows each key has at most; ``total`` is their sum, ``largest`` the most. Keys of
    more than ``total / MOST_HOT`` rows are fewer than MOST_HOT, whatever the data: they are broadcast, so that their rows
    stay where they are. All others meet by a shuffle on the key, where none can overload a task.
    """
    limit = max(HOT_ROWS, total // MOST_HOT)
    if largest <= limit:
        return then(rows.join(keys, key))
    hot = keys.where(F.col(size) > limit)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keys.where(F.col(size) <= limit), key)
    return then(rows.join(F.broadcast(hot), key)).unionByName(then(cold))
