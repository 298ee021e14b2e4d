"""Lookups by argument: by a nick, an id, a type, or a list of ids as the caller gives it.

A list is a small table of the caller's (``id_list``); it is joined, not turned into an IN. Where the result is distinct a
repeated id changes nothing; where it lists rows per id, a repeated id repeats them. Ids without rows have an empty list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.operators.corpus import Corpus


def id_list(spark: SparkSession, ids: list[int]) -> DataFrame:
    """``id``, one row for each element, repeats included."""
    return spark.createDataFrame([(int(i),) for i in ids], "id long")


def _asked(posts: DataFrame, as_name: str = "post_id") -> DataFrame:
    return posts.select(F.col("id").alias(as_name))


def ngrams(corpus: Corpus, kind: int | None = None, posts: DataFrame | None = None) -> DataFrame:
    """``type, ngram, post_id, positions, uses`` of all three types or of one, for all posts or those listed in ``posts``.

    Type 1 are the stored unigram postings, types 2 and 3 adjacent words of the posts' texts.
    """
    parts = []
    listed = None if posts is None else posts.select("id").distinct()
    if kind in (None, 1):
        held = corpus._read("unigramtopost").select("ngram_id", "post_id", "uses_str", "uses_cnt").dropna(subset=["ngram_id", "post_id"])
        if listed is not None:
            held = held.join(_asked(listed), "post_id", "left_semi")
        # a repeated posting keeps its largest uses, then the smallest positions
        best = held.groupBy("ngram_id", "post_id").agg(F.min_by(F.struct("uses_str", "uses_cnt"), F.struct(-F.coalesce("uses_cnt", F.lit(-1)), F.coalesce("uses_str", F.lit("")))).alias("row"))
        names = corpus.unigrams.where("id is not null").select(F.col("id").alias("ngram_id"), F.col("text").alias("ngram"))
        parts.append(best.join(names, "ngram_id").select(F.lit(1).alias("type"), "ngram", "post_id", F.col("row.uses_str").alias("positions"), F.col("row.uses_cnt").alias("uses")))
    texts = corpus.posts.select("id", "title", "text")
    if listed is not None:
        texts = texts.join(listed, "id", "left_semi")
    for n in (2, 3):
        if kind in (None, n):
            rows = text.postings(texts, "id", text.post_text(F.col("title"), F.col("text")), n)
            parts.append(rows.select(F.lit(n).alias("type"), "ngram", "post_id", F.col("uses_str").alias("positions"), F.col("uses_cnt").alias("uses")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def tags_of_nick(corpus: Corpus, nick: str) -> DataFrame:
    """``text, uses`` of the tags of one user."""
    user = corpus.users.where(F.col("nick") == nick).select(F.col("id").alias("user_id"))
    names = corpus.tags.select(F.col("id").alias("tag_id"), "text")
    return corpus.tag_users.join(user, "user_id", "left_semi").join(names, "tag_id").select("text", "uses")


def tags_of_post(corpus: Corpus, post: int) -> DataFrame:
    """``text`` of the tags of one post."""
    tagged = corpus.tag_posts.where(F.col("post_id") == post)
    return corpus.tags.join(tagged.select(F.col("tag_id").alias("id")), "id", "left_semi").select("text")


def tags_of_posts(corpus: Corpus, posts: DataFrame) -> DataFrame:
    """Distinct ``text`` of the tags of the listed posts."""
    tagged = corpus.tag_posts.join(_asked(posts), "post_id", "left_semi").select(F.col("tag_id").alias("id"))
    return corpus.tags.join(tagged, "id", "left_semi").select("text").distinct()


def tags_map(corpus: Corpus, posts: DataFrame) -> DataFrame:
    """``post_id, tags``: the tags of each listed post in order, an empty array where it has none; each post once."""
    names = corpus.tags.select(F.col("id").alias("tag_id"), "text")
    tagged = corpus.tag_posts.join(_asked(posts), "post_id", "left_semi").join(names, "tag_id")
    lists = _asked(posts).distinct().join(tagged, "post_id", "left").groupBy("post_id")
    return lists.agg(F.array_sort(F.collect_set("text")).alias("tags"))


def user_post_urls(corpus: Corpus, nick: str) -> DataFrame:
    """Distinct ``url`` of one user's posts."""
    user = corpus.users.where(F.col("nick") == nick).select(F.col("id").alias("user_id"))
    return corpus.posts.join(user, "user_id", "left_semi").select("url").distinct()


def normalized_ids_by_tags(corpus: Corpus, tags: list[str]) -> DataFrame:
    """``id`` of the normalized posts with any of the tags (as written) and at least one unigram."""
    chosen = corpus.tags.where(F.col("text").isin(tags)).select(F.col("id").alias("tag_id"))
    tagged = corpus.tag_posts.join(chosen, "tag_id", "left_semi").select(F.col("post_id").alias("id"))
    return corpus.normalized.select("id").join(tagged, "id", "left_semi").join(corpus.postings.select(F.col("post_id").alias("id")), "id", "left_semi")


def post_length(corpus: Corpus, post: int) -> int:
    """Uses of unigrams in one normalized post, 0 if it has none; any other id is an error."""
    return post_lengths(corpus, [post])[post]


def post_lengths(corpus: Corpus, posts: list[int]) -> dict[int, int]:
    """The lengths of the listed posts, a repeated id once; an error if one of them is no normalized post."""
    wanted = id_list(corpus.spark, sorted(set(posts)))
    rows = lengths_of(corpus, wanted).collect()  # the caller's list
    if len(rows) < len(set(posts)):
        raise LookupError(f"no normalized post: {sorted(set(posts) - {r.post_id for r in rows})}")
    return {r.post_id: r.length for r in rows}


def lengths_of(corpus: Corpus, posts: DataFrame) -> DataFrame:
    """``post_id, length`` of the listed posts that are normalized; a repeated id adds its uses once more."""
    known = _asked(posts).join(corpus.normalized.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return known.join(corpus.postings, "post_id", "left").groupBy("post_id").agg(F.coalesce(F.sum("uses_cnt"), F.lit(0)).alias("length"))


def ngram_count(corpus: Corpus, post: int, kind: int) -> DataFrame:
    """One row: the n-grams of a type in one post, 0 for an unknown post."""
    return ngrams(corpus, kind, id_list(corpus.spark, [post])).agg(F.count("*").alias("ngrams"))


def ngrams_map(corpus: Corpus, posts: DataFrame, kind: int | None = None) -> DataFrame:
    """``post_id, ngrams``: an array of ``text, uses`` for each listed post, in order; a repeated id has each n-gram once more."""
    held = ngrams(corpus, kind, posts).select("post_id", F.struct(F.col("ngram").alias("text"), "uses").alias("x"))
    return _asked(posts).join(held, "post_id", "left").groupBy("post_id").agg(F.array_sort(F.collect_list("x")).alias("ngrams"))


def ngram_names(corpus: Corpus, posts: DataFrame, kind: int | None = None) -> DataFrame:
    """Distinct ``text`` of the n-grams of the listed posts; of one type, a text for each different n-gram."""
    return ngrams(corpus, kind, posts).select("type", F.col("ngram").alias("text")).distinct().select("text").distinct()
