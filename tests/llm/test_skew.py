"""One key with most of all rows must not end up in one task: rows by partition, with automatic broadcasts off."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from tagloom.llm import cooccur, frequency, skew, topn


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle only, and partitions left as they are."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def spread(df):
    """Most rows of a partition, and the median."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts), median(counts)


def test_hot_group_stays_spread(shuffled, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 1000)
    n = 40_000
    rows = shuffled.range(0, n, 1, 8).select(F.when(F.col("id") % 5 < 4, 0).otherwise(F.col("id") % 997).alias("g"), "id")
    keys = rows.groupBy("g").agg(F.count("*").alias("rows"))
    most, middle = spread(skew.joined(rows, keys, "g", "rows", n, int(n * 0.8)).where("g = 0"))
    assert most <= 3 * middle
    assert skew.joined(rows, keys, "g", "rows", n, int(n * 0.8)).count() == n


def test_top_n_of_a_hot_group(shuffled, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    rows = shuffled.range(6000).select(F.when(F.col("id") % 5 < 4, 0).otherwise(F.col("id") % 97).alias("g"), (F.col("id") * 7919 % 500).cast("double").alias("s"), "id")
    got = {(r.g, r.id) for r in topn.top_n_per_group(rows, "g", "s", ["id"], 7).collect()}
    best: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.g, -r.s, r.id)):
        best.setdefault(r.g, []).append((r.g, r.id))
    assert got == {x for v in best.values() for x in v[:7]}


def test_hot_item_is_spread_by_container(shuffled):
    rows = shuffled.range(200_000).select(F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 3001).alias("item"), "id")
    held = frequency.bitmaps(rows, "item", "id", None)
    most, middle = spread(held.where("item = 1"))
    assert most <= 3 * middle
    assert held.agg(F.sum("records")).first()[0] == 200_000


def test_large_basket_is_spread_by_chunk_pair(shuffled):
    rows = shuffled.range(2000).select(F.lit(1).alias("record"), F.col("id").alias("item")).unionByName(shuffled.range(400).select((F.col("id") % 200 + 2).alias("record"), F.col("id").alias("item")))
    keyed = cooccur._keyed(rows, 128).repartition(8, "record", "a", "b")
    most, middle = spread(keyed.where("record = 1").select("a", "b").distinct())
    assert most <= 3 * middle
    counts = cooccur.pair_counts(rows, "item", "record", chunk=128)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert counts.agg(F.sum("n_ab")).first()[0] == 2000 * 1999 // 2 + 200
