"""The data model as DataFrames: posts, tags, users, n-grams and the bridges between them, clean of repeated rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources.tables import table


@dataclass(frozen=True)
class Corpus:
    """Loads the model's tables from one folder; every property is a lazy plan.

    Bridges keep one row per key pair, as their primary keys demand; rows with a null key are left out. A repeated posting
    keeps its largest uses.
    """

    spark: SparkSession
    folder: str

    def _read(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def posts(self) -> DataFrame:
        return self._read("post")

    @property
    def users(self) -> DataFrame:
        return self._read("userlj")

    @property
    def tags(self) -> DataFrame:
        return self._read("tag").where("id is not null")

    @property
    def regions(self) -> DataFrame:
        return self._read("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))

    @property
    def tag_posts(self) -> DataFrame:
        return self._read("tagtopost").select("tag_id", "post_id").dropna().distinct()

    @property
    def postings(self) -> DataFrame:
        rows = self._read("unigramtopost").select("ngram_id", "post_id", "uses_cnt").dropna(subset=["ngram_id", "post_id"])
        return rows.groupBy("ngram_id", "post_id").agg(F.max("uses_cnt").alias("uses_cnt"))

    @property
    def unigrams(self) -> DataFrame:
        return self._read("unigram")

    @property
    def tag_users(self) -> DataFrame:
        """``tag_id, user_id, uses``: how many posts of the user carry the tag."""
        owners = self.posts.select(F.col("id").alias("post_id"), "user_id").dropna()
        return self.tag_posts.join(owners, "post_id").groupBy("tag_id", "user_id").agg(F.count("*").alias("uses"))

    @property
    def normalized(self) -> DataFrame:
        return self.posts.where("normalized")
