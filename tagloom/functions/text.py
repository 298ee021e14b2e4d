"""The text pipeline: tokens, stop words, adjacent n-grams and positioned postings. Built-in expressions only.

Lemmas and part-of-speech grammars are hooks: ``lemma`` may be any column function; the default changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stop words of the default list.
STOP_WORDS = [
    "в", "впоследствии", "втора", "второй", "гот", "до", "другой", "кв", "ком", "ли", "нет", "один", "пот", "с", "той", "том", "тут", "ува", "уж", "эта",
]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def same(word: Column) -> Column:
    return word


Lemma = Callable[[Column], Column]


def words_of(text: Column, lemma: Lemma = same) -> Column:
    """Runs of letters, in lower case; null gives none."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)), lemma)


def ngrams_of(words: Column, n: int) -> Column:
    """Adjacent n-grams, in order."""
    if n == 1:
        return words
    none = F.array().cast("array<string>")

    def pieces(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n, none).otherwise(whole)

    return bound(words, pieces)


def without(items: Column, stop: list[str]) -> Column:
    """Items that are not, as a whole, a stop word; repeats of the others stay."""
    return F.filter(items, lambda x: ~x.isin(stop))


def post_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit("")))


def ngram_counts(posts: DataFrame, id_column: str, text: Column, n: int = 1, stop: list[str] = STOP_WORDS, lemma: Lemma = same) -> DataFrame:
    """``post_id, ngram, uses``: how often each n-gram stands in each text, without positions."""
    items = posts.select(F.col(id_column).alias("post_id"), F.explode(without(ngrams_of(words_of(text, lemma), n), stop)).alias("ngram"))
    return items.groupBy("post_id", "ngram").agg(F.count("*").alias("uses"))


def postings(posts: DataFrame, id_column: str, text: Column, n: int = 1, stop: list[str] = STOP_WORDS, lemma: Lemma = same) -> DataFrame:
    """``post_id, ngram, uses_str, uses_cnt``: positions count from 0 in the list that is left after stop words."""
    return positioned(posts.select(F.col(id_column).alias("post_id"), without(ngrams_of(words_of(text, lemma), n), stop).alias("items")))


def positioned(lists: DataFrame) -> DataFrame:
    """``post_id, ngram, uses_str, uses_cnt`` from ``post_id, items``: each item's places in the list, from 0."""
    items = lists.select("post_id", F.posexplode("items").alias("pos", "ngram"))
    grouped = items.groupBy("post_id", "ngram").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return grouped.select("post_id", "ngram", F.array_join(F.col("positions").cast("array<string>"), ",").alias("uses_str"), F.size("positions").alias("uses_cnt"))


def stop_words(spark: SparkSession, path: str) -> list[str]:
    """The words of a text file, separated by white space; a list of stop words is short."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("w")).where("w != ''").distinct()
    return sorted(r.w for r in words.collect())
