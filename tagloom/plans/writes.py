"""Queries of the write side and of the work queues. Tables that the folder does not hold are made from those it does."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.operators import queue, writes
from tagloom.operators.corpus import Corpus
from tagloom.plans.catalog import _ADJACENT, _STOP, _TP, _TU
from tagloom.plans.registry import query

WORKER = 1
_RAW = "raw AS (SELECT nick, CASE WHEN id % 4 <> 0 THEN id % 4 END AS crawler_id, CASE WHEN id % 3 <> 0 THEN id END AS user_id FROM userlj WHERE nick IS NOT NULL)"
_MIX = "(id % 1000003 * 7919 + 104729) % 1000003"


def _raw(c: Corpus):
    """The queue of nicks: every fourth is free, two of three are linked to their user."""
    rest = F.pmod("id", F.lit(4))
    return c.users.where("nick is not null").select("nick", F.when(rest != 0, rest).alias("crawler_id"), F.when(F.pmod("id", F.lit(3)) != 0, F.col("id")).alias("user_id"))


@query(f"WITH {_RAW} SELECT nick FROM raw")
def raw_users(spark, sf_dir):
    return _raw(Corpus(spark, sf_dir)).select("nick")


@query(f"WITH {_RAW} SELECT nick, row_number() OVER (ORDER BY nick) AS row_number FROM raw WHERE crawler_id IS NULL AND user_id IS NULL")
def raw_users_ranked(spark, sf_dir):
    """The free nicks, numbered by nick."""
    return queue.numbered(queue.free(_raw(Corpus(spark, sf_dir)), ["crawler_id", "user_id"]).select("nick"), "nick").select("nick", F.col("row_number").cast("long"))


@query(f"WITH {_RAW} SELECT nick FROM raw WHERE crawler_id = {WORKER} AND user_id IS NULL")
def raw_users_reserved(spark, sf_dir):
    """The worker's nicks that have no user yet."""
    return queue.reserved_by(_raw(Corpus(spark, sf_dir)), "crawler_id", WORKER, F.col("user_id").isNull()).select("nick")


@query(f"WITH {_RAW} SELECT raw.nick FROM raw JOIN userlj ON userlj.id = raw.user_id WHERE crawler_id = {WORKER} AND (fetched IS NULL OR fetched < updated)")
def raw_users_unfinished(spark, sf_dir):
    """The worker's nicks whose user is there, but never fetched, or not since its update."""
    c = Corpus(spark, sf_dir)
    mine = queue.reserved_by(_raw(c), "crawler_id", WORKER, F.col("user_id").isNotNull())
    return mine.join(c.users.where("fetched is null or fetched < updated").select(F.col("id").alias("user_id")), "user_id", "left_semi").select("nick")


@query("SELECT id, title, text FROM post WHERE normalizer_id = (SELECT min(normalizer_id) FROM post WHERE NOT normalized) AND NOT normalized")
def posts_reserved(spark, sf_dir):
    """A worker's posts that are not normalized yet, with their texts."""
    c = Corpus(spark, sf_dir)
    worker = c.posts.where("not normalized").agg(F.min("normalizer_id")).first()[0]
    return queue.reserved_by(c.posts, "normalizer_id", -1 if worker is None else worker, ~F.col("normalized")).select("id", "title", "text")


@query(f"""WITH free AS (SELECT id FROM post WHERE NOT normalized AND normalizer_id IS NULL ORDER BY {_MIX}, id LIMIT 20)
 SELECT id, CASE WHEN id IN (SELECT id FROM free) THEN 77 ELSE normalizer_id END AS normalizer_id FROM post""")
def posts_reserve(spark, sf_dir):
    """The posts after worker 77 has reserved twenty free ones."""
    posts = Corpus(spark, sf_dir).posts.select("id", "normalized", "normalizer_id")
    chosen = queue.reserved(queue.free(posts.where("not normalized"), ["normalizer_id"]).select("id"), "id", 20)
    return queue.assigned(posts, chosen, "id", "normalizer_id", 77).select("id", "normalizer_id")


@query(f"""WITH {_RAW}, free AS (SELECT u.id, u.nick FROM raw JOIN userlj u ON u.nick = raw.nick WHERE crawler_id IS NULL AND user_id IS NULL ORDER BY {_MIX}, id LIMIT 10)
 SELECT nick, CASE WHEN nick IN (SELECT nick FROM free) THEN 77 ELSE crawler_id END AS crawler_id, user_id FROM raw""")
def raw_users_reserve(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    raw = _raw(c)
    free = queue.free(raw, ["crawler_id", "user_id"]).join(c.users.select("id", "nick"), "nick")
    return queue.assigned(raw, queue.reserved(free, "id", 10), "nick", "crawler_id", 77)


@query(f"WITH {_RAW} SELECT raw.nick, crawler_id, coalesce(user_id, u.id) AS user_id FROM raw LEFT JOIN userlj u ON u.nick = raw.nick")
def raw_users_linked(spark, sf_dir):
    """The queue once every nick's user is there."""
    c = Corpus(spark, sf_dir)
    return writes.link_users(_raw(c), c.users)


@query("WITH names AS (SELECT DISTINCT 'crawler-' || posts_num % 7 AS name FROM userlj WHERE posts_num IS NOT NULL) SELECT 2 + row_number() OVER (ORDER BY name) AS id, name FROM names WHERE name NOT IN ('crawler-1', 'crawler-2')")
def workers_registered(spark, sf_dir):
    """Names of workers that sign on; two are registered already."""
    known = spark.createDataFrame([(1, "crawler-1"), (2, "crawler-2")], "id long, name string")
    names = Corpus(spark, sf_dir).users.where("posts_num is not null").select(F.concat(F.lit("crawler-"), F.pmod("posts_num", F.lit(7)).cast("string")).alias("name"))
    return writes.insert_names(known, names)


@query("WITH names AS (SELECT DISTINCT upper(source) AS name FROM documents WHERE source IS NOT NULL) SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY name) AS id, name FROM names WHERE name NOT IN (SELECT r_name FROM region)")
def regions_append(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return writes.insert_names(c.regions, c._read("documents").select(F.upper("source").alias("name")))


@query("SELECT DISTINCT replace(nick, '_', '-') || '2' AS nick, CAST(NULL AS BIGINT) AS crawler_id, CAST(NULL AS BIGINT) AS user_id FROM userlj WHERE nick IS NOT NULL AND replace(nick, '_', '-') || '2' NOT IN (SELECT nick FROM userlj WHERE nick IS NOT NULL)")
def raw_users_append(spark, sf_dir):
    """Friends' nicks that the queue does not know yet."""
    c = Corpus(spark, sf_dir)
    return writes.insert_raw_users(_raw(c), c.users.select(F.concat(F.replace("nick", F.lit("_"), F.lit("-")), F.lit("2")).alias("nick")))


_CAPTURED = """captured AS (SELECT CASE WHEN id % 2 = 0 THEN nick ELSE nick || '-new' END AS nick, CASE WHEN id % 5 = 0 THEN 'NOWHERE' ELSE (SELECT r_name FROM region WHERE r_regionkey = id % 5) END AS region,
   ['School ' || id % 7, 'School ' || id % 3] AS schools FROM userlj WHERE nick IS NOT NULL),
 added AS (SELECT (SELECT max(id) FROM userlj) + row_number() OVER (ORDER BY nick) AS id, nick, r_regionkey::BIGINT AS region_id, schools FROM captured LEFT JOIN region ON r_name = region
   WHERE nick NOT IN (SELECT nick FROM userlj WHERE nick IS NOT NULL)),
 named AS (SELECT DISTINCT id AS user_id, unnest(schools) AS name FROM added),
 fresh AS (SELECT 1 + row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT name FROM named) WHERE name <> 'School 0'),
 schools AS (SELECT 1 AS id, 'School 0' AS name UNION ALL SELECT id, name FROM fresh)"""


def _insert_users(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    schools = spark.createDataFrame([(1, "School 0")], "id long, name string")
    here = c.regions.select(F.col("id").alias("k"), F.col("name").alias("region"))
    people = c.users.where("nick is not null").withColumn("k", F.when(F.col("id") % 5 != 0, F.col("id") % 5)).join(here, "k", "left")
    captured = people.select(
        F.when(F.col("id") % 2 == 0, F.col("nick")).otherwise(F.concat("nick", F.lit("-new"))).alias("nick"),
        F.coalesce("region", F.when(F.col("k").isNull(), F.lit("NOWHERE"))).alias("region"),
        F.array(*(F.concat(F.lit("School "), (F.col("id") % n).cast("string")) for n in (7, 3))).alias("schools"),
    )
    return writes.insert_users(c.users.select("id", "nick"), c.regions, schools, captured)


@query(f"WITH {_CAPTURED} SELECT id, nick, region_id FROM added")
def users_append(spark, sf_dir):
    """Captured users that are new; of an unknown region the reference stays empty."""
    return _insert_users(spark, sf_dir)[0]


@query(f"WITH {_CAPTURED} SELECT id, name FROM fresh")
def schools_append(spark, sf_dir):
    return _insert_users(spark, sf_dir)[1]


@query(f"WITH {_CAPTURED} SELECT user_id, schools.id AS school_id FROM named JOIN schools USING (name)")
def user_schools_append(spark, sf_dir):
    return _insert_users(spark, sf_dir)[2]


_SEEN = f"""{_TP}, {_TU}, seen AS (SELECT nick, lower(trim(unigram.text)) AS text, posts_num AS uses FROM userlj JOIN unigram ON unigram.id = userlj.id WHERE nick IS NOT NULL AND unigram.text IS NOT NULL),
 fresh AS (SELECT (SELECT max(id) FROM tag) + row_number() OVER (ORDER BY text) AS id, text FROM (SELECT DISTINCT text FROM seen) WHERE text NOT IN (SELECT text FROM tag WHERE text IS NOT NULL)),
 every AS (SELECT id AS tag_id, text FROM tag WHERE id IS NOT NULL UNION ALL SELECT id, text FROM fresh)"""


def _insert_tags(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    words = c.unigrams.where("text is not null").select("id", F.lower(F.trim("text")).alias("text"))
    seen = c.users.where("nick is not null").select("id", "nick", F.col("posts_num").alias("uses")).join(words, "id").select("nick", "text", "uses")
    return writes.insert_tags(c.tags, c.tag_users, c.users, seen)


@query(f"WITH {_SEEN} SELECT id, text FROM fresh")
def tags_insert(spark, sf_dir):
    return _insert_tags(spark, sf_dir)[0]


@query(f"WITH {_SEEN} SELECT tag_id, userlj.id AS user_id, uses FROM seen JOIN every USING (text) JOIN userlj USING (nick) WHERE (tag_id, userlj.id) NOT IN (SELECT tag_id, user_id FROM tu)")
def tag_users_append(spark, sf_dir):
    """Uses of tags as users' tag pages show them, for pairs not known yet."""
    return _insert_tags(spark, sf_dir)[1]


_POSTS = """captured AS (SELECT user_id, CASE WHEN id % 3 = 0 THEN url ELSE url + 1000000007 END AS url, title, text, id AS old FROM post WHERE user_id IS NOT NULL AND url IS NOT NULL),
 unknown AS (SELECT *, row_number() OVER (PARTITION BY user_id, url ORDER BY title NULLS FIRST, text NULLS FIRST, old) AS rn FROM captured WHERE (user_id, url) NOT IN (SELECT user_id, url FROM post WHERE user_id IS NOT NULL AND url IS NOT NULL)),
 added AS (SELECT (SELECT max(id) FROM post) + row_number() OVER (ORDER BY user_id, url) AS id, user_id, url, title, text FROM unknown WHERE rn = 1)"""


def _insert_posts(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    url = F.when(F.col("id") % 3 == 0, F.col("url")).otherwise(F.col("url") + 1_000_000_007)
    labels = F.array(F.concat(F.lit("no such tag "), F.col("url").cast("string")), F.col("tag"))
    some = c.tags.select(F.col("id").alias("k"), F.col("text").alias("tag"))
    captured = c.posts.where("user_id is not null and url is not null").select("user_id", url.alias("url"), "title", "text", (F.pmod("url", F.lit(100)) + 1).alias("k"))
    captured = captured.join(some, "k", "left").select("user_id", "url", "title", "text", labels.alias("tags"))
    return writes.insert_posts(c.posts.select("id", "user_id", "url"), c.tags, c.tag_posts, captured)


@query(f"WITH {_POSTS} SELECT id, user_id, url, title, text, false AS normalized FROM added")
def posts_append(spark, sf_dir):
    """Captured posts of unknown (user, address)."""
    return _insert_posts(spark, sf_dir)[0]


@query(f"WITH {_POSTS} SELECT count(*) AS posts, count(DISTINCT (user_id, url)) AS keys FROM added")
def posts_append_count(spark, sf_dir):
    return _insert_posts(spark, sf_dir)[0].agg(F.count("*").alias("posts"), F.count_distinct("user_id", "url").alias("keys"))


@query(f"WITH {_POSTS} SELECT tag.id AS tag_id, added.id AS post_id FROM added JOIN tag ON tag.id = (added.url - 1000000007) % 100 + 1 WHERE tag.text IS NOT NULL")
def post_tags_append(spark, sf_dir):
    """The new posts' links to known tags; an unknown tag costs its own link only."""
    return _insert_posts(spark, sf_dir)[1]


_FOUND = f"""{_ADJACENT}, found AS (SELECT post_id, unnest(list_filter(w, lambda x: x NOT IN ({_STOP}))) AS ngram FROM words),
 sums AS (SELECT post_id, ngram, CAST(count(*) AS INTEGER) AS uses_cnt FROM found GROUP BY post_id, ngram),
 names AS (SELECT DISTINCT ngram FROM sums), fresh AS (SELECT (SELECT max(id) FROM unigram) + row_number() OVER (ORDER BY ngram) AS id, ngram AS text FROM names WHERE ngram NOT IN (SELECT text FROM unigram WHERE text IS NOT NULL)),
 every AS (SELECT id AS ngram_id, text AS ngram FROM unigram WHERE id IS NOT NULL UNION ALL SELECT id, text FROM fresh)"""


def _insert_ngrams(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    found = text.postings(c.posts, "id", text.post_text(F.col("title"), F.col("text")), 1)
    return writes.insert_ngrams(c.unigrams.where("id is not null"), c._read("unigramtopost").select("ngram_id", "post_id"), found)


@query(f"WITH {_FOUND} SELECT id, text FROM fresh")
def ngrams_append(spark, sf_dir):
    """The unigrams of the posts' texts that the table lacks."""
    return _insert_ngrams(spark, sf_dir)[0]


@query(f"WITH {_FOUND} SELECT ngram_id, post_id, uses_cnt FROM sums JOIN every USING (ngram) WHERE (ngram_id, post_id) NOT IN (SELECT ngram_id, post_id FROM unigramtopost WHERE ngram_id IS NOT NULL AND post_id IS NOT NULL)")
def postings_append(spark, sf_dir):
    """The postings of the posts' texts that the table lacks."""
    return _insert_ngrams(spark, sf_dir)[1].select("ngram_id", "post_id", "uses_cnt")
