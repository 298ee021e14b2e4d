"""What inserts add to the tables, as pure functions: tables in, the rows to append out. Nothing is overwritten.

Keys already there are ignored and the first of several new rows stays; references are looked up by natural key. New ids
follow the table's largest, in order of the natural key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.queue import appended, numbered


def _with_ids(target: DataFrame, new: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    highest = target.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_highest"))  # one row
    rows = numbered(new, key).join(F.broadcast(highest), how="cross")
    return rows.withColumn(id_column, F.col("_highest") + F.col("row_number")).drop("_highest", "row_number")


def insert_names(target: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """``id`` and ``key`` of the names ``target`` (``id``, ``key``) does not have yet: workers, regions, schools, tags, n-grams."""
    new = names.select(key).dropna().distinct().join(target.select(key), key, "left_anti")
    return _with_ids(target, new, key).select("id", key)


def insert_raw_users(target: DataFrame, nicks: DataFrame) -> DataFrame:
    """``nick, crawler_id, user_id`` of the unknown nicks, free and not linked."""
    new = nicks.select("nick").dropna().distinct().join(target.select("nick"), "nick", "left_anti")
    return new.select("nick", F.lit(None).cast("long").alias("crawler_id"), F.lit(None).cast("long").alias("user_id"))


def insert_users(users: DataFrame, regions: DataFrame, schools: DataFrame, captured: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that captured users (``nick, region, schools``) add to users, schools and the links between them.

    A region not known yet leaves the user's empty. A user already there adds nothing, not even schools.
    """
    first = appended(users, captured, ["nick"], ["region"])
    known = regions.select(F.col("id").alias("region_id"), F.col("name").alias("region"))
    added = _with_ids(users, first, "nick").join(known, "region", "left").select("id", "nick", "region_id", "schools")
    named = added.select(F.col("id").alias("user_id"), F.explode("schools").alias("name")).dropna().distinct()
    new_schools = insert_names(schools, named)
    every = schools.select("id", "name").unionByName(new_schools).select(F.col("id").alias("school_id"), "name")
    return added.drop("schools"), new_schools, named.join(every, "name").select("user_id", "school_id")


def link_users(raw: DataFrame, users: DataFrame) -> DataFrame:
    """The queue with ``user_id`` set where a user of the nick exists; a link made before stays."""
    known = users.select("nick", F.col("id").alias("_user"))
    return raw.join(known, "nick", "left").withColumn("user_id", F.coalesce("user_id", "_user")).drop("_user")


def insert_tags(tags: DataFrame, tag_users: DataFrame, users: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that users' tags as seen (``nick, text, uses``) add to the tags and to their bridge; unknown nicks add no link."""
    new = insert_names(tags.select("id", "text"), seen, "text")
    every = tags.select("id", "text").unionByName(new).select(F.col("id").alias("tag_id"), "text")
    owners = users.select(F.col("id").alias("user_id"), "nick")
    links = seen.join(every, "text").join(owners, "nick").select("tag_id", "user_id", "uses")
    return new, appended(tag_users, links, ["tag_id", "user_id"], [F.desc_nulls_last("uses")])


def insert_posts(posts: DataFrame, tags: DataFrame, tag_posts: DataFrame, captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that captured posts (``user_id, url, title, text, tags``) add to the posts and to their tags.

    The key is (user_id, url); a tag that the table doesn't have loses its link only, the post stays.
    """
    first = appended(posts, captured, ["user_id", "url"], ["title", "text"])
    added = _with_ids(posts, first.withColumn("_key", F.struct("user_id", "url")), "_key").drop("_key").withColumn("normalized", F.lit(False))
    named = added.select(F.col("id").alias("post_id"), F.explode("tags").alias("text")).dropna().distinct()
    links = named.join(tags.select(F.col("id").alias("tag_id"), "text"), "text").select("tag_id", "post_id")
    return added.drop("tags"), links.join(tag_posts, ["tag_id", "post_id"], "left_anti")


def insert_ngrams(ngrams: DataFrame, postings: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that n-grams as found (``post_id, ngram, uses_str, uses_cnt``) add to the n-grams of a type and their postings."""
    new = insert_names(ngrams.select("id", "text"), found.select(F.col("ngram").alias("text")), "text")
    every = ngrams.select("id", "text").unionByName(new).select(F.col("id").alias("ngram_id"), F.col("text").alias("ngram"))
    rows = found.join(every, "ngram").select("ngram_id", "post_id", "uses_str", "uses_cnt")
    return new, appended(postings, rows, ["ngram_id", "post_id"], [F.desc_nulls_last("uses_cnt"), "uses_str"])
