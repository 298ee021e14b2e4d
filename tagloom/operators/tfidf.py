"""TF-IDF of n-grams per tag, and the selections built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import written


def tfidf(occurrences: DataFrame) -> DataFrame:
    """``tag_id, type, ngram, tf, idf, tf_idf`` from rows of ``tag_id, type, ngram, uses`` (one per tag, n-gram and post).

    tf = uses in the tag / uses of all types in the tag; idf = log10(all tags / rows of the n-gram), rows and not tags, so
    it can be negative. Null uses add nothing. Scores are rounded to nine digits so that ties are ties.
    """
    # written once: three aggregations read it
    per_ngram = occurrences.groupBy("tag_id", "type", "ngram").agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), F.count("*").alias("rows"))
    per_ngram = written(per_ngram, "ngrams")
    per_tag = per_ngram.groupBy("tag_id").agg(F.sum("uses").alias("tag_uses"))
    spread = per_ngram.groupBy("type", "ngram").agg(F.sum("rows").alias("rows"))
    tags = per_tag.agg(F.count("*").alias("tags"))  # one row
    joined = per_ngram.drop("rows").join(per_tag, "tag_id").join(spread, ["type", "ngram"]).join(F.broadcast(tags), how="cross")
    tf = F.try_divide(F.col("uses").cast("double"), F.col("tag_uses"))
    idf = F.log10(F.col("tags").cast("double") / F.col("rows"))
    return joined.select("tag_id", "type", "ngram", F.round(tf, 9).alias("tf"), F.round(idf, 9).alias("idf"), F.round(tf * idf, 9).alias("tf_idf"))


def _ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("tag_id").orderBy(F.desc("tf_idf"), "type", "ngram")))


def top_per_tag(scores: DataFrame, k: int) -> DataFrame:
    """Distinct ``type, ngram`` that are among the first ``k`` of some tag."""
    return _ranked(scores).where(F.col("rank") <= k).select("type", "ngram").distinct()


def top_total(scores: DataFrame, total: int) -> DataFrame:
    """About ``total`` n-grams, from each tag in proportion to its rows; at most ``total``, ordered by type and text.

    No tag gives more than ``total``, so ranks beyond that are cut off before the tags' rows meet.
    """
    return share_of_total(scores, scores.groupBy("tag_id").agg(F.count("*").alias("tag_rows")), total)


def share_of_total(scores: DataFrame, per_tag: DataFrame, total: int) -> DataFrame:
    """`top_total` where the tags' rows are known (``tag_id, tag_rows``); scores may lack what no tag can give."""
    everything = per_tag.agg(F.sum("tag_rows").alias("all_rows"))  # one row
    sizes = per_tag.join(F.broadcast(everything), how="cross")
    first = _ranked(scores).where(F.col("rank") <= total).join(sizes, "tag_id")
    share = first.where(F.col("rank") <= F.try_divide(F.col("tag_rows") * F.lit(float(total)), F.col("all_rows")))
    return share.select("type", "ngram").distinct().orderBy("type", "ngram").limit(total)
