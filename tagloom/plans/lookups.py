"""The queries by argument: a nick, an id, a list of ids with repeats, unknown and not normalized ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import lookups
from tagloom.operators.corpus import Corpus
from tagloom.plans.catalog import _ADJACENT, _STOP, _TP, _TU, _UP
from tagloom.plans.registry import query

#: Two of one post, an unknown one, and others, of which some are not normalized.
IDS = [3, 3, 5, 8, 11, 12, 20, 21, 999_999_999]
POST = 8
_NICK = "(SELECT min(nick) FROM userlj WHERE id IN (SELECT user_id FROM tu))"
_LIST = "ids AS (SELECT unnest([" + ", ".join(f"{i}::BIGINT" for i in IDS) + "]) AS id)"
_BEST = """best AS (SELECT ngram_id, post_id, first(uses_str ORDER BY coalesce(uses_cnt, -1) DESC, coalesce(uses_str, '')) AS positions, max(uses_cnt) AS uses
 FROM unigramtopost WHERE ngram_id IS NOT NULL AND post_id IN (SELECT id FROM ids) GROUP BY ngram_id, post_id)"""
_HELD = f"""{_LIST}, {_BEST}, {_ADJACENT},
 held AS (SELECT 1 AS type, text AS ngram, post_id, uses::BIGINT AS uses FROM best JOIN unigram ON unigram.id = best.ngram_id
          UNION ALL SELECT 2, ngram, post_id, count(*) FROM pairs WHERE ngram NOT IN ({_STOP}) AND post_id IN (SELECT id FROM ids) GROUP BY post_id, ngram
          UNION ALL SELECT 3, ngram, post_id, count(*) FROM triples WHERE ngram NOT IN ({_STOP}) AND post_id IN (SELECT id FROM ids) GROUP BY post_id, ngram)"""


def _nick(c: Corpus) -> str | None:
    """A user with tags: the first by nick."""
    owners = c.tag_users.select(F.col("user_id").alias("id"))
    return c.users.join(owners, "id", "left_semi").agg(F.min("nick")).first()[0]


def _at(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return c, lookups.id_list(spark, IDS)


@query(f"WITH {_TP}, {_TU} SELECT text, uses FROM tu JOIN tag ON tag.id = tu.tag_id JOIN userlj ON userlj.id = tu.user_id WHERE nick = {_NICK}")
def tags_of_one_user(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return lookups.tags_of_nick(c, _nick(c))


@query(f"SELECT text FROM tag WHERE id IN (SELECT tag_id FROM tagtopost WHERE post_id = {POST})")
def tags_of_one_post(spark, sf_dir):
    return lookups.tags_of_post(Corpus(spark, sf_dir), POST)


@query(f"WITH {_LIST} SELECT DISTINCT text FROM tag WHERE id IN (SELECT tag_id FROM tagtopost WHERE post_id IN (SELECT id FROM ids))")
def tags_of_listed_posts(spark, sf_dir):
    return lookups.tags_of_posts(*_at(spark, sf_dir))


@query(f"WITH {_LIST} SELECT id AS post_id, to_json(coalesce(list(DISTINCT text ORDER BY text) FILTER (text IS NOT NULL), []))::VARCHAR AS tags FROM ids LEFT JOIN (SELECT post_id, text FROM tagtopost JOIN tag ON tag.id = tag_id) ON post_id = ids.id GROUP BY ids.id")
def tags_of_listed_posts_map(spark, sf_dir):
    """Posts without tags, the unknown one too, have an empty list; the repeated one stands once."""
    return lookups.tags_map(*_at(spark, sf_dir)).select("post_id", F.to_json("tags").alias("tags"))


@query(f"WITH {_TP}, {_TU} SELECT DISTINCT url FROM post JOIN userlj ON userlj.id = user_id WHERE nick = {_NICK}")
def urls_of_one_user(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return lookups.user_post_urls(c, _nick(c))


@query("WITH t AS (SELECT id FROM tag WHERE text IN (SELECT text FROM mastertag)) SELECT id FROM post WHERE normalized AND id IN (SELECT post_id FROM tagtopost WHERE tag_id IN (SELECT id FROM t)) AND id IN (SELECT post_id FROM unigramtopost WHERE ngram_id IS NOT NULL)")
def normalized_ids_of_named_tags(spark, sf_dir):
    """By a list of tags as written: here the clean list's entries."""
    c = Corpus(spark, sf_dir)
    names = [r.text for r in c._read("mastertag").select("text").dropna().collect()]  # the fixed list of 270
    return lookups.normalized_ids_by_tags(c, names)


@query(f"WITH {_UP}, {_LIST} SELECT ids.id AS post_id, CAST(coalesce(sum(uses_cnt), 0) AS BIGINT) AS length FROM ids JOIN post ON post.id = ids.id LEFT JOIN up ON up.post_id = ids.id WHERE normalized GROUP BY ids.id")
def lengths_of_listed_posts(spark, sf_dir):
    """The repeated post counts double; unknown and not normalized ones have no row."""
    return lookups.lengths_of(*_at(spark, sf_dir))


@query(f"WITH {_HELD}, k AS (SELECT unnest([1, 2, 3]) AS type, unnest([{POST}, {POST}, 999999999]) AS post_id) SELECT k.type, count(held.post_id) AS ngrams FROM k LEFT JOIN held USING (type, post_id) GROUP BY k.type")
def ngram_count_of_one_post(spark, sf_dir):
    """Of two types in one post, and of the third in an unknown one, which has 0."""
    c = Corpus(spark, sf_dir)
    parts = [lookups.ngram_count(c, p, k).select(F.lit(k).alias("type"), "ngrams") for k, p in ((1, POST), (2, POST), (3, 999_999_999))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_HELD} SELECT type, ngram AS text, uses FROM held WHERE post_id = {POST}")
def ngrams_of_one_post(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return lookups.ngrams(c, None, lookups.id_list(spark, [POST])).select("type", F.col("ngram").alias("text"), F.col("uses").cast("long"))


@query(f"WITH {_HELD} SELECT text, positions, uses FROM best JOIN unigram ON unigram.id = best.ngram_id WHERE post_id = {POST}")
def unigrams_of_one_post(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return lookups.ngrams(c, 1, lookups.id_list(spark, [POST])).select(F.col("ngram").alias("text"), "positions", "uses")


_MAP = "SELECT ids.id AS post_id, count(ngram) AS n, CAST(coalesce(sum(uses), 0) AS BIGINT) AS uses, min(ngram) AS first, max(ngram) AS last FROM ids LEFT JOIN {} held ON held.post_id = ids.id GROUP BY ids.id"


def _summed(lists):
    """An array of n-grams by its length, uses and ends."""
    x = F.col("ngrams")
    names = F.transform(x, lambda g: g["text"])
    total = F.aggregate(x, F.lit(0).cast("long"), lambda acc, g: acc + F.coalesce(g["uses"], F.lit(0)))
    return lists.select("post_id", F.size(x).cast("long").alias("n"), total.alias("uses"), F.array_min(names).alias("first"), F.array_max(names).alias("last"))


@query(f"WITH {_HELD} " + _MAP.format(""))
def ngrams_of_listed_posts(spark, sf_dir):
    """The repeated post's n-grams stand twice in its list, the unknown one's list is empty."""
    return _summed(lookups.ngrams_map(*_at(spark, sf_dir)))


@query(f"WITH {_HELD} " + _MAP.format("(SELECT * FROM held WHERE type = 2)"))
def digrams_of_listed_posts(spark, sf_dir):
    return _summed(lookups.ngrams_map(*_at(spark, sf_dir), 2))


@query(f"WITH {_HELD} SELECT DISTINCT ngram AS text FROM held")
def ngram_names_of_listed_posts(spark, sf_dir):
    return lookups.ngram_names(*_at(spark, sf_dir))


@query(f"WITH {_HELD} SELECT DISTINCT ngram AS text FROM held WHERE type = 1")
def unigram_names_of_listed_posts(spark, sf_dir):
    return lookups.ngram_names(*_at(spark, sf_dir), 1)


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region")
def regions(spark, sf_dir):
    return Corpus(spark, sf_dir).regions


@query("SELECT text FROM tag WHERE id IS NOT NULL")
def tag_names(spark, sf_dir):
    return Corpus(spark, sf_dir).tags.select("text")
