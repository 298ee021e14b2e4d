"""Table changes as pure functions: first row wins, anti-join appends, reservations and status rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import written


def first_wins(rows: DataFrame, keys: list[str], arrival: list[Column | str]) -> DataFrame:
    """One row per key, the first by arrival: a later row of a known key is ignored."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*arrival))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def appended(target: DataFrame, new: DataFrame, keys: list[str], arrival: list[Column | str]) -> DataFrame:
    """The rows of ``new`` that an insert into ``target`` adds: unknown keys only, null keys never."""
    rows = new.dropna(subset=keys).join(target.select(*keys), keys, "left_anti")
    return first_wins(rows, keys, arrival)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``row_number`` by one or more columns without a single-task window, for keys that hardly repeat; nulls in the first are left out.

    The rows are cut into ranges of about equal numbers, whatever the type and the gaps of the key; the ranges are counted
    and then numbered side by side. They are written once, so that both see the same ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.where(F.col(order[0]).isNotNull()).repartitionByRange(parts, *order)
    kept = written(kept.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return kept.join(F.broadcast(sizes), "_range").withColumn("row_number", F.col("_before") + inside).drop("_range", "_before")


def reserved(free: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` free rows in an order mixed from the key by whole-number arithmetic: random-like, the same on every run."""
    mix = F.expr(f"pmod(pmod({key}, 1000003) * 7919 + {seed} * 104729, 1000003)")
    return free.orderBy(mix, key).limit(n)


def with_status(rows: DataFrame, done: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` true where the key is among ``done``."""
    marks = done.select(key).distinct().withColumn("_done", F.lit(True))
    return rows.join(marks, key, "left").withColumn(column, F.coalesce("_done", column)).drop("_done")


def assigned(rows: DataFrame, chosen: DataFrame, key: str, column: str, worker: int) -> DataFrame:
    """``rows`` with ``column`` set to the worker where the key was chosen: a reservation written back."""
    marks = chosen.select(key).distinct().withColumn("_mine", F.lit(worker))
    return rows.join(marks, key, "left").withColumn(column, F.coalesce("_mine", column)).drop("_mine")


def free(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which all these columns are null: nobody has them."""
    for c in columns:
        rows = rows.where(F.col(c).isNull())
    return rows


def reserved_by(rows: DataFrame, owner: str, worker: int, open_when: Column) -> DataFrame:
    """Rows the worker has reserved and not finished."""
    return rows.where((F.col(owner) == worker) & open_when)
