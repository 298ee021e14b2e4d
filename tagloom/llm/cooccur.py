"""Problem 5: items that appear together, with the association of each pair.

Large-basket blocking: a basket of more than ``chunk`` items is cut into chunks by a hash of the item, and each pair of its
chunks is a task key of its own, spread over the tasks by an exchange of its own, so no basket is multiplied out in one
place. Ordinary baskets are one chunk. The counts are summed partially before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import written

#: Parts of a large basket's rows while they learn its size; the few large baskets are listed once for each.
SALTS = 64
#: Pairs a task makes, about.
TASK_PAIRS = 4_000_000


def _keyed(used: DataFrame, chunk: int) -> DataFrame:
    """``record, item, own, a, b``: each item once for every pair of chunks of its basket in which its own takes part."""
    sizes = used.groupBy("record").agg(F.count("*").alias("size"))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    large = sizes.where(F.col("size") > chunk).select("record", F.expr(f"cast(ceil(size / {chunk}) as int)").alias("parts"), F.explode(salts).alias("salt"))
    rows = used.withColumn("salt", F.expr(f"cast(pmod(xxhash64(item, 1), {SALTS}) as int)")).join(large, ["record", "salt"], "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.expr("cast(pmod(xxhash64(item), parts) as int)"))
    rows = rows.select("record", "item", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return rows.select("record", "item", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def pair_counts(rows: DataFrame, item: str, record: str, least: int = 1, chunk: int = 256) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, n``: records with both, with each, and all; ``item_a < item_b``, ``n_ab >= least``.

    Rows are counted once per (item, record); rows with a null item or record are left out. Items of fewer than ``least``
    records can't be in a counted pair and are dropped before pairs are made.
    """
    base = written(rows.select(F.col(item).alias("item"), F.col(record).alias("record")).dropna().distinct(), "rows")
    items = base.groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least)
    per_record = base.groupBy("record").agg(F.count("*").cast("double").alias("size"))
    total, pairs = per_record.agg(F.count("*"), F.sum(F.expr("size * least(size, 1e9)"))).first()
    used = base.join(items.select("item"), "item", "left_semi") if least > 1 else base
    parallel = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-(pairs or 0) // (2 * TASK_PAIRS))))
    # an exchange by chunk pair: a layout by record, from the join before, would keep a basket in one task
    keyed = _keyed(used, chunk).repartition(min(parallel, 200_000), "record", "a", "b")
    blocks = keyed.groupBy("record", "a", "b").agg(
        F.array_sort(F.collect_list(F.when(F.col("own") == F.col("a"), F.col("item")))).alias("left"),
        F.array_sort(F.collect_list(F.when((F.col("own") == F.col("b")) & (F.col("a") != F.col("b")), F.col("item")))).alias("right"),
    )
    products = F.when(
        F.col("a") == F.col("b"),
        F.expr("flatten(transform(left, (x, i) -> transform(slice(left, i + 2, size(left)), y -> struct(x as x, y as y))))"),
    ).otherwise(F.expr("flatten(transform(left, x -> transform(right, y -> struct(least(x, y) as x, greatest(x, y) as y))))"))
    counts = blocks.select(F.explode(products).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= least)
    a = items.select(F.col("item").alias("x"), F.col("n_item").alias("n_a"))
    b = items.select(F.col("item").alias("y"), F.col("n_item").alias("n_b"))
    joined = counts.join(a, "x").join(b, "y")
    return joined.select(F.col("x").alias("item_a"), F.col("y").alias("item_b"), "n_ab", "n_a", "n_b", F.lit(total).cast("long").alias("n"))


def associated_pairs(counts: DataFrame, least_lift: int = 3) -> DataFrame:
    """The pairs at least ``least_lift`` times as frequent as chance, with ``lift``, ``pmi`` and ``jaccard``."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = counts.where(wide("n_ab") * wide("n") >= least_lift * (wide("n_a") * wide("n_b")))
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return kept.withColumns({"lift": lift, "pmi": F.log2(lift), "jaccard": F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))})
