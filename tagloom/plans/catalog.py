"""The core's queries and the SQL that states the same result."""

from __future__ import annotations

from datetime import date

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tagloom.functions import parse, text
from tagloom.ml import dataset, evaluate, models
from tagloom.operators import packed, popularity, queue, tagged, tfidf
from tagloom.operators.corpus import Corpus
from tagloom.plans.registry import query
from tagloom.session import written
from tagloom.sources.tables import table

@query()
def p1_found(spark, sf_dir):
    """One row per value of users' interests and of the positions of each posting."""
    interests = packed.packed_values(table(spark, sf_dir, "userlj").select("id", "interests"), "interests", ["id"])
    uses = packed.packed_values(
        table(spark, sf_dir, "unigramtopost").select("ngram_id", "post_id", "uses_str"),
        "uses_str",
        ["ngram_id", "post_id"],
        separators=packed.NUMBER_SEPARATORS,
        opened=True,
    )
    a = interests.select(F.lit("interests").alias("field"), F.col("id").alias("id_a"), F.lit(0).cast("long").alias("id_b"), "pos", "val")
    b = uses.select(F.lit("uses_str").alias("field"), F.col("ngram_id").alias("id_a"), F.col("post_id").alias("id_b"), "pos", "val")
    return a.unionByName(b)


@query("SELECT DISTINCT ngram_id, post_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, unnest(v) AS val FROM (SELECT ngram_id, post_id, regexp_extract_all(uses_str, '[0-9]+') AS v FROM unigramtopost)")
def p1_positions(spark, sf_dir):
    """One row per position of each posting."""
    return packed.packed_values(
        table(spark, sf_dir, "unigramtopost").select("ngram_id", "post_id", "uses_str"), "uses_str", ["ngram_id", "post_id"], separators=packed.NUMBER_SEPARATORS, opened=True
    )


# ---- the model's queries ------------------------------------------------------------------------------------------

AS_OF = date(2015, 12, 31)

#: Common table expressions of the oracle: the bridges without repeated rows.
_TP = "tp AS (SELECT DISTINCT tag_id, post_id FROM tagtopost WHERE tag_id IS NOT NULL AND post_id IS NOT NULL)"
_UP = "up AS (SELECT ngram_id, post_id, max(uses_cnt) AS uses_cnt FROM unigramtopost WHERE ngram_id IS NOT NULL AND post_id IS NOT NULL GROUP BY ngram_id, post_id)"
_TU = "tu AS (SELECT tag_id, user_id, count(*) AS uses FROM tp JOIN post ON post.id = tp.post_id WHERE user_id IS NOT NULL GROUP BY tag_id, user_id)"
_SCORE = f"""WITH {_TP}, {_TU},
 u AS (SELECT tag_id, count(DISTINCT user_id) AS n FROM tu WHERE user_id IN (SELECT user_id FROM post WHERE normalized) GROUP BY tag_id),
 p AS (SELECT tag_id, count(*) AS n FROM tp WHERE post_id IN (SELECT id FROM post WHERE normalized) GROUP BY tag_id),
 score AS (SELECT tag.id AS tag_id, text, u.n * p.n AS score FROM tag JOIN u ON u.tag_id = tag.id JOIN p ON p.tag_id = tag.id)"""


@query(_SCORE + " SELECT tag_id, text, score FROM score ORDER BY score DESC, text, tag_id LIMIT 5 OFFSET 3")
def top_tags_offset(spark, sf_dir):
    return popularity.top_by_offset(popularity.tag_scores(Corpus(spark, sf_dir)), 3, 5)


@query(_SCORE + " SELECT tag_id, text, score FROM score WHERE score BETWEEN 100 AND 50000 ORDER BY score DESC, text, tag_id")
def top_tags_score_gap(spark, sf_dir):
    return popularity.top_by_gap(popularity.tag_scores(Corpus(spark, sf_dir)), 100, 50000)


_WEEKS = f"""WITH {_TP}, {_TU},
 u AS (SELECT tag_id, count(DISTINCT user_id) AS n FROM tu GROUP BY tag_id), p AS (SELECT tag_id, count(*) AS n FROM tp GROUP BY tag_id),
 top AS (SELECT tag.id AS tag_id, text FROM tag JOIN u ON u.tag_id = tag.id JOIN p ON p.tag_id = tag.id ORDER BY u.n * p.n DESC, text, tag.id LIMIT 100),
 week AS (SELECT unnest(generate_series(TIMESTAMP '2014-12-31', TIMESTAMP '2015-12-31', INTERVAL 7 DAY)) AS w)
 SELECT CAST(w AS DATE) AS week, top.text, count(*) AS count FROM week JOIN post ON date BETWEEN w AND w + INTERVAL 7 DAY
 JOIN tp ON tp.post_id = post.id JOIN top ON top.tag_id = tp.tag_id GROUP BY w, top.text ORDER BY top.text, w"""


@query(_WEEKS)
def tag_week_stats(spark, sf_dir):
    return popularity.week_statistics(Corpus(spark, sf_dir), AS_OF, 100)


@query()
def tag_week_pivot(spark, sf_dir):
    return popularity.week_matrix(popularity.week_statistics(Corpus(spark, sf_dir), AS_OF, 10), AS_OF)


def _adjacent(posts, n: int):
    """``type, ngram, post_id, uses`` of the adjacent n-word n-grams of the posts' texts; ``n`` is their type."""
    # spread by post, so that counting within a post moves texts and not their n-grams
    rows = text.ngram_counts(posts.select("id", "title", "text").repartition("id"), "id", text.post_text(F.col("title"), F.col("text")), n)
    return rows.select(F.lit(n).alias("type"), "ngram", "post_id", "uses")


def _ngrams(c: Corpus):
    """``type, ngram, post_id, uses`` of all three types: the unigram postings and the n-grams of two and three words."""
    one = c.postings.join(c.unigrams.select(F.col("id").alias("ngram_id"), F.col("text").alias("ngram")), "ngram_id")
    rows = one.select(F.lit(1).alias("type"), "ngram", "post_id", F.col("uses_cnt").alias("uses"))
    return rows.unionByName(_adjacent(c.posts, 2)).unionByName(_adjacent(c.posts, 3))


def _tagged(c: Corpus):
    """Posts, their named unigram postings and tags."""
    ones = c.postings.join(c.unigrams.select(F.col("id").alias("ngram_id"), F.col("text").alias("ngram")), "ngram_id")
    return c.posts.select("id", "title", "text"), ones.select("post_id", "ngram", F.col("uses_cnt").alias("uses")), c.tag_posts


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = "regexp_extract_all(lower(coalesce(title, '') || '. ' || coalesce(text, '')), '\\p{L}+')"
_ADJACENT = f"""words AS (SELECT id AS post_id, normalized, {_TOKENS} AS w FROM post),
 pairs AS (SELECT post_id, normalized, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM words WHERE len(w) > 1),
 triples AS (SELECT post_id, normalized, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS ngram FROM words WHERE len(w) > 2)"""
_ROWS = f"""rows AS (SELECT 1 AS type, text AS ngram, post_id, uses_cnt AS uses FROM up JOIN unigram ON unigram.id = up.ngram_id
          UNION ALL SELECT 2, ngram, post_id, count(*) FROM pairs WHERE ngram NOT IN ({_STOP}) GROUP BY post_id, ngram
          UNION ALL SELECT 3, ngram, post_id, count(*) FROM triples WHERE ngram NOT IN ({_STOP}) GROUP BY post_id, ngram)"""
_TFIDF = f"""WITH {_TP}, {_UP}, {_ADJACENT}, {_ROWS},
 occ AS (SELECT tag_id, type, ngram, uses FROM tp JOIN rows USING (post_id)),
 per AS (SELECT tag_id, type, ngram, coalesce(sum(uses), 0) AS uses, count(*) AS n FROM occ GROUP BY tag_id, type, ngram),
 tagsum AS (SELECT tag_id, sum(uses) AS total FROM per GROUP BY tag_id), spread AS (SELECT type, ngram, sum(n) AS n FROM per GROUP BY type, ngram),
 tags AS (SELECT count(*) AS n FROM tagsum),
 scores AS (SELECT per.tag_id, per.type, per.ngram, round(CASE WHEN total <> 0 THEN per.uses::DOUBLE / total::DOUBLE END, 9) AS tf, round(log10(tags.n::DOUBLE / spread.n::DOUBLE), 9) + 0.0 AS idf,
   round(CASE WHEN total <> 0 THEN per.uses::DOUBLE / total::DOUBLE END * log10(tags.n::DOUBLE / spread.n::DOUBLE), 9) + 0.0 AS tf_idf
   FROM per JOIN tagsum USING (tag_id) JOIN spread USING (type, ngram) CROSS JOIN tags),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY tf_idf DESC NULLS LAST, type, ngram) AS rn, count(*) OVER (PARTITION BY tag_id) AS tag_rows FROM scores)"""


@query(_TFIDF + " SELECT tag_id, type, ngram, tf, idf, tf_idf FROM scores")
def tfidf_simple(spark, sf_dir):
    return tagged.scores(*_tagged(Corpus(spark, sf_dir)))


@query(_TFIDF + " SELECT DISTINCT type, ngram FROM ranked WHERE rn <= 10")
def tfidf_top_per_tag(spark, sf_dir):
    return tfidf.top_per_tag(tagged.leading(*_tagged(Corpus(spark, sf_dir)), 10), 10)


@query(_TFIDF + " SELECT type, ngram FROM (SELECT DISTINCT type, ngram FROM ranked WHERE rn <= tag_rows * 500.0::DOUBLE / (SELECT count(*) FROM scores)) ORDER BY type, ngram LIMIT 500")
def tfidf_top_total(spark, sf_dir):
    rows = written(tagged.leading_in_total(*_tagged(Corpus(spark, sf_dir)), 500), "leading")
    per_tag = rows.where("tag_rows is not null").groupBy("tag_id").agg(F.sum("tag_rows").alias("tag_rows"))
    return tfidf.share_of_total(rows.where("tag_rows is null").drop("tag_rows"), per_tag, 500)


@query(f"WITH {_UP} SELECT post.id AS post_id, CAST(coalesce(sum(uses_cnt), 0) AS BIGINT) AS length FROM post LEFT JOIN up ON up.post_id = post.id WHERE normalized GROUP BY post.id")
def post_length(spark, sf_dir):
    """Uses of unigrams in each normalized post, 0 if it has none."""
    c = Corpus(spark, sf_dir)
    posts = c.normalized.select(F.col("id").alias("post_id"))
    return posts.join(c.postings, "post_id", "left").groupBy("post_id").agg(F.coalesce(F.sum("uses_cnt"), F.lit(0)).alias("length"))


@query(f"WITH {_UP} SELECT post.id AS post_id, count(uses_cnt) AS words FROM post LEFT JOIN up ON up.post_id = post.id WHERE normalized GROUP BY post.id")
def post_unique_words(spark, sf_dir):
    """Postings with known uses of each normalized post."""
    c = Corpus(spark, sf_dir)
    posts = c.normalized.select(F.col("id").alias("post_id"))
    return posts.join(c.postings, "post_id", "left").groupBy("post_id").agg(F.count("uses_cnt").alias("words"))


@query("SELECT count(*) AS posts, count(*) FILTER (normalized) AS normalized FROM post")
def post_counts(spark, sf_dir):
    return Corpus(spark, sf_dir).posts.agg(F.count("*").alias("posts"), F.count(F.when(F.col("normalized"), 1)).alias("normalized"))


@query(f"WITH {_UP} SELECT post.id AS post_id, count(ngram_id) AS ngrams FROM post LEFT JOIN up ON up.post_id = post.id GROUP BY post.id")
def ngram_counts(spark, sf_dir):
    """Postings of every post, 0 where it has none."""
    c = Corpus(spark, sf_dir)
    return c.posts.select(F.col("id").alias("post_id")).join(c.postings, "post_id", "left").groupBy("post_id").agg(F.count("ngram_id").alias("ngrams"))


@query(f"WITH {_ADJACENT} SELECT text FROM unigram UNION ALL (SELECT DISTINCT ngram FROM pairs) UNION ALL (SELECT DISTINCT ngram FROM triples)")
def all_ngram_texts(spark, sf_dir):
    """Texts of the n-grams of all types, not distinct across types."""
    c = Corpus(spark, sf_dir)
    words = text.words_of(text.post_text(F.col("title"), F.col("text")))
    two, three = (c.posts.select(F.explode(text.ngrams_of(words, n)).alias("text")).distinct() for n in (2, 3))
    return c.unigrams.select("text").unionByName(two).unionByName(three)


@query(f"WITH {_UP}, {_ADJACENT}, {_ROWS} SELECT post_id, ngram AS text, uses FROM rows")
def ngrams_of_posts(spark, sf_dir):
    """Texts and uses of each post's n-grams of all types."""
    return _ngrams(Corpus(spark, sf_dir)).select("post_id", F.col("ngram").alias("text"), "uses")


@query(f"WITH {_ADJACENT} SELECT text FROM unigram WHERE id IN (SELECT ngram_id FROM unigramtopost WHERE post_id IN (SELECT id FROM post WHERE normalized)) UNION SELECT ngram FROM pairs WHERE normalized UNION SELECT ngram FROM triples WHERE normalized")
def ngram_names_distinct(spark, sf_dir):
    """Different n-gram texts of the normalized posts, over all types."""
    c = Corpus(spark, sf_dir)
    used = c.postings.join(c.normalized.select(F.col("id").alias("post_id")), "post_id", "left_semi").select(F.col("ngram_id").alias("id"))
    words = text.words_of(text.post_text(F.col("title"), F.col("text")))
    two, three = (c.normalized.select(F.explode(text.ngrams_of(words, n)).alias("text")) for n in (2, 3))
    return c.unigrams.join(used, "id", "left_semi").select("text").unionByName(two).unionByName(three).distinct()


@query(f"WITH {_TP}, {_TU} SELECT nick, text, uses FROM tu JOIN tag ON tag.id = tu.tag_id JOIN userlj ON userlj.id = tu.user_id")
def tags_of_user(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    names = c.tags.select(F.col("id").alias("tag_id"), "text")
    nicks = c.users.select(F.col("id").alias("user_id"), "nick")
    return c.tag_users.join(names, "tag_id").join(nicks, "user_id").select("nick", "text", "uses")


@query("SELECT DISTINCT text FROM tag WHERE id IN (SELECT tag_id FROM tagtopost WHERE post_id IN (SELECT id FROM post))")
def tags_of_posts(spark, sf_dir):
    """Different tags of the posts."""
    c = Corpus(spark, sf_dir)
    used = c.tag_posts.join(c.posts.select(F.col("id").alias("post_id")), "post_id", "left_semi").select(F.col("tag_id").alias("id"))
    return c.tags.join(used, "id", "left_semi").select("text").distinct()


@query(f"WITH {_TP}, named AS (SELECT post_id, tag.text AS name FROM tp JOIN tag ON tag.id = tp.tag_id) SELECT post.id AS post_id, coalesce(string_agg(name, '|' ORDER BY name), '') AS tags, count(name) AS n FROM post LEFT JOIN named ON named.post_id = post.id GROUP BY post.id")
def tags_map(spark, sf_dir):
    """Each post's tags in order, an empty list where it has none."""
    c = Corpus(spark, sf_dir)
    named = c.tag_posts.join(c.tags.select(F.col("id").alias("tag_id"), "text"), "tag_id").select("post_id", "text")
    lists = c.posts.select(F.col("id").alias("post_id")).join(named, "post_id", "left").groupBy("post_id").agg(F.array_sort(F.collect_list("text")).alias("tags"))
    return lists.select("post_id", F.array_join("tags", "|").alias("tags"), F.size("tags").cast("long").alias("n"))


@query("SELECT nick, r_name AS region, birthday, city_cstm, posts_num, cmmnt_in AS received, cmmnt_out AS posted FROM userlj JOIN region ON r_regionkey = region_id")
def user_profile(spark, sf_dir):
    """Users with their region; those without one are not listed, nulls stay null."""
    c = Corpus(spark, sf_dir)
    rows = c.users.join(c.regions.select(F.col("id").alias("region_id"), F.col("name").alias("region")), "region_id")
    return rows.select("nick", "region", "birthday", "city_cstm", "posts_num", F.col("cmmnt_in").alias("received"), F.col("cmmnt_out").alias("posted"))


@query("SELECT DISTINCT nick, url FROM post JOIN userlj ON userlj.id = user_id")
def user_post_urls(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return c.posts.join(c.users.select(F.col("id").alias("user_id"), "nick"), "user_id").select("nick", "url").distinct()


@query("SELECT id FROM post WHERE normalized")
def normalized_ids(spark, sf_dir):
    return Corpus(spark, sf_dir).normalized.select("id")


@query("SELECT id FROM post WHERE normalized AND id IN (SELECT post_id FROM tagtopost WHERE tag_id IN (SELECT id FROM tag WHERE master_id IS NOT NULL)) AND id IN (SELECT post_id FROM unigramtopost WHERE ngram_id IS NOT NULL)")
def normalized_ids_by_tags(spark, sf_dir):
    """Normalized posts with any of the tags of the clean list and at least one unigram."""
    c = Corpus(spark, sf_dir)
    chosen = c.tags.where("master_id is not null").select(F.col("id").alias("tag_id"))
    tagged = c.tag_posts.join(chosen, "tag_id", "left_semi").select(F.col("post_id").alias("id"))
    return c.normalized.select("id").join(tagged, "id", "left_semi").join(c.postings.select(F.col("post_id").alias("id")), "id", "left_semi")


@query("SELECT id, nick FROM userlj WHERE fetched IS NULL")
def users_unfinished(spark, sf_dir):
    return Corpus(spark, sf_dir).users.where("fetched is null").select("id", "nick")


@query("SELECT id, row_number() OVER (ORDER BY id) AS row_number FROM post WHERE NOT normalized AND normalizer_id IS NULL")
def posts_to_normalize(spark, sf_dir):
    """Unreserved posts, numbered by id range by range."""
    return queue.numbered(Corpus(spark, sf_dir).posts.where("not normalized and normalizer_id is null").select("id"), "id").select("id", F.col("row_number").cast("long"))


@query("SELECT id FROM post WHERE NOT normalized ORDER BY (id % 1000003 * 7919 + 104729) % 1000003, id LIMIT 100")
def posts_reserved_sample(spark, sf_dir):
    return queue.reserved(Corpus(spark, sf_dir).posts.where("not normalized").select("id"), "id", 100)


@query("SELECT user_id, url, id FROM (SELECT user_id, url, id, row_number() OVER (PARTITION BY user_id, url ORDER BY id) AS rn FROM post WHERE user_id IS NOT NULL AND url IS NOT NULL) WHERE rn = 1")
def posts_first_wins(spark, sf_dir):
    """One post per user and address: the first stays."""
    return queue.first_wins(Corpus(spark, sf_dir).posts.select("user_id", "url", "id").dropna(subset=["user_id", "url"]), ["user_id", "url"], ["id"])


@query("SELECT id, coalesce(normalized, false) OR id IN (SELECT post_id FROM unigramtopost) AS normalized FROM post")
def posts_status(spark, sf_dir):
    """Posts with the status set where they have postings."""
    c = Corpus(spark, sf_dir)
    rows = c.posts.select("id", F.coalesce("normalized", F.lit(False)).alias("normalized"))
    return queue.with_status(rows, c._read("unigramtopost").select(F.col("post_id").alias("id")).dropna(), "id", "normalized")


_POSITIONS = f"""WITH words AS (SELECT id AS post_id, list_filter({_TOKENS}, lambda x: x NOT IN ({_STOP})) AS w FROM post),
 items AS (SELECT post_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS ngram FROM words)
 SELECT post_id, ngram, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS uses_str, CAST(count(*) AS INTEGER) AS uses_cnt FROM items GROUP BY post_id, ngram"""


@query(_POSITIONS)
def unigram_positions(spark, sf_dir):
    return text.postings(Corpus(spark, sf_dir).posts, "id", text.post_text(F.col("title"), F.col("text")), 1)


@query(f"SELECT text FROM unigram WHERE text NOT IN ({_STOP})")
def stopword_filter(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in text.STOP_WORDS], "text string")
    return Corpus(spark, sf_dir).unigrams.select("text").where("text is not null").join(F.broadcast(stop), "text", "left_anti")  # twenty rows


@query("SELECT " + ", ".join(f"CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS {c}" for c in ("region_id", "birthday", "interests", "city_cstm", "posts_num", "cmmnt_in", "cmmnt_out", "bio")) + " FROM userlj")
def null_profile(spark, sf_dir):
    columns = ("region_id", "birthday", "interests", "city_cstm", "posts_num", "cmmnt_in", "cmmnt_out", "bio")
    return Corpus(spark, sf_dir).users.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))


@query(f"WITH {_TP}, {_TU} SELECT user_id, count(*) AS tags, CAST(sum(uses) AS BIGINT) AS uses FROM tu GROUP BY user_id")
def user_tag_totals(spark, sf_dir):
    return Corpus(spark, sf_dir).tag_users.groupBy("user_id").agg(F.count("*").alias("tags"), F.sum("uses").alias("uses"))


# ---- captured payloads --------------------------------------------------------------------------------------------


def _markup(x):
    """A value as markup writes it, in a text or a quoted attribute."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def _element(name: str, value):
    """An element of a feed; none where the value is null. Signs that XML forbids are dropped, carriage returns kept."""
    clean = F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    return F.coalesce(F.concat(F.lit(f"<{name}>"), F.replace(_markup(clean), F.lit("\r"), F.lit("&#13;")), F.lit(f"</{name}>")), F.lit(""))


def _rss(c: Corpus):
    """``id, body``: a feed with each post's entry, all that the tables have of it."""
    named = c.tag_posts.join(c.tags.select(F.col("id").alias("tag_id"), "text"), "tag_id")
    tags = named.groupBy(F.col("post_id").alias("id")).agg(F.array_sort(F.collect_list("text")).alias("tags"))
    parts = [
        _element("title", F.col("title")),
        _element("description", F.col("text")),
        _element("pubDate", F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")),
        _element("guid", F.concat(F.lit("http://blog.test/"), F.col("url").cast("string"), F.lit(".html"))),
        F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: _element("category", t)), ""),
        _element("reply-count", F.col("comments").cast("string")),
    ]
    body = F.concat(F.lit("<rss><channel><item>"), *parts, F.lit("</item></channel></rss>"))
    return c.posts.join(tags, "id", "left").select("id", "url", body.alias("body"))


@query("SELECT id, url AS number FROM post WHERE url IS NOT NULL")
def guid_extract(spark, sf_dir):
    """The post number in the address of each post's feed entry."""
    rows = _rss(Corpus(spark, sf_dir)).where("url is not null").select("id", F.explode(parse.rss_items("body")).alias("item"))
    return rows.select("id", parse.guid_number(F.col("item.guid")).alias("number"))


@query()
def rss_parse(spark, sf_dir):
    """Each post as its feed entry gives it."""
    rows = _rss(Corpus(spark, sf_dir)).select("id", F.explode(parse.rss_items("body")).alias("item"))
    return rows.select("id", "item.title", "item.description", parse.rss_time(F.col("item.published")).alias("published"), "item.guid", "item.tags", "item.replies")


@query()
def html_text(spark, sf_dir):
    """The texts of documents without their markup."""
    return table(spark, sf_dir, "documents").select("doc_id", parse.html_text("text").alias("text"))


@query("SELECT nick, unnest(['/', '/tag/' || nick]) AS path FROM userlj WHERE nick IS NOT NULL")
def robots_disallow(spark, sf_dir):
    body = F.concat(F.lit("User-Agent: other\nDisallow: /x\n\nUser-Agent: *\nDisallow: /\nDisallow: /tag/"), F.col("nick"), F.lit("\n"))
    rows = table(spark, sf_dir, "userlj").where("nick is not null").select("nick", parse.disallowed(body).alias("paths"))
    return rows.select("nick", F.explode("paths").alias("path"))


@query("SELECT DISTINCT region_id, replace(nick, '_', '-') AS friend FROM userlj WHERE region_id IS NOT NULL AND nick IS NOT NULL")
def friends_parse(spark, sf_dir):
    """Friend lists, one per region, of its users."""
    lines = table(spark, sf_dir, "userlj").where("region_id is not null and nick is not null").select("region_id", F.concat(F.lit("# list\n> "), F.col("nick"), F.lit("\n")).alias("body"))
    return lines.select("region_id", F.explode(parse.friends(F.col("body"))).alias("friend")).distinct()


@query(r"SELECT id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS name, CAST(id % 100000 AS INTEGER) AS uses FROM tag WHERE id IS NOT NULL AND regexp_matches(text, '\S')")
def tag_anchors(spark, sf_dir):
    """Tags and their uses as a tag page shows them."""
    page = F.concat(F.lit('<p><a href="/tag/'), _markup(F.col("text")), F.lit('" title="'), (F.col("id") % 100000).cast("string"), F.lit(' uses">'), _markup(F.col("text")), F.lit("</a></p>"))
    rows = table(spark, sf_dir, "tag").where("id is not null").select("id", F.explode(parse.tag_anchors(page, F.lit("/tag/"), F.lit("/users/tag/"))).alias("tag"))
    return rows.select("id", "tag.name", "tag.uses")


# ---- data sets, learners, scores ----------------------------------------------------------------------------------


def _learning(c: Corpus, tags: int = 5):
    """The top tags, the normalized posts' named postings with at least two terms, and the tags of posts."""
    top = popularity.top_by_offset(popularity.tag_scores(c), 0, tags).select("tag_id", "text")
    tagged = c.tag_posts.join(F.broadcast(top), "tag_id").select("post_id", "text")  # five rows
    names = c.unigrams.select(F.col("id").alias("ngram_id"), F.col("text").alias("ngram"))
    ids = c.normalized.select(F.col("id").alias("post_id")).join(tagged, "post_id", "left_semi")
    return top, tagged, c.postings.join(ids, "post_id", "left_semi").join(names, "ngram_id").select("post_id", "ngram", "uses_cnt")


_LEARN = (
    _SCORE
    + f""", {_UP}, top AS (SELECT tag_id, text FROM score ORDER BY score DESC, score.text, tag_id LIMIT 5),
 tagged AS (SELECT post_id, top.text FROM tp JOIN top USING (tag_id)),
 named AS (SELECT post_id, unigram.text AS ngram, uses_cnt FROM up JOIN unigram ON unigram.id = up.ngram_id
           WHERE post_id IN (SELECT id FROM post WHERE normalized) AND post_id IN (SELECT post_id FROM tagged)),
 fit AS (SELECT post_id FROM named GROUP BY post_id HAVING count(*) >= 2)"""
)


@query(_LEARN + " SELECT ngram, CAST(row_number() OVER (ORDER BY ngram COLLATE \"C\") - 1 AS INTEGER) AS slot FROM (SELECT DISTINCT ngram FROM named)")
def vocab_index(spark, sf_dir):
    return dataset.vocabulary(_learning(Corpus(spark, sf_dir))[2])


@query(_LEARN + " SELECT post_id, tagged.text AS label, ngram, coalesce(uses_cnt, 0) AS value FROM named JOIN tagged USING (post_id) WHERE post_id IN (SELECT post_id FROM fit)")
def matrix_single_long(spark, sf_dir):
    _, tagged, named = _learning(Corpus(spark, sf_dir))
    return dataset.single_label(named, tagged)


@query(_LEARN + " SELECT p.post_id, 'Tag_' || top.text AS label, CAST((p.post_id, top.text) IN (SELECT post_id, text FROM tagged) AS INTEGER) AS value FROM (SELECT DISTINCT post_id FROM tagged WHERE post_id IN (SELECT post_id FROM fit)) p CROSS JOIN top")
def matrix_multi_hot(spark, sf_dir):
    top, tagged, named = _learning(Corpus(spark, sf_dir))
    return dataset.multi_label(named, tagged, top)


@query(_LEARN + " SELECT text AS label, CAST(row_number() OVER (ORDER BY text) - 1 AS INTEGER) AS slot FROM (SELECT DISTINCT text FROM tagged)")
def label_index(spark, sf_dir):
    return dataset.label_index(_learning(Corpus(spark, sf_dir))[1])


@query(_LEARN + """ SELECT p.post_id, 'Tag_' || top.text AS attribute, CAST((p.post_id, top.text) IN (SELECT post_id, text FROM tagged) AS INTEGER) AS value FROM (SELECT DISTINCT post_id FROM tagged WHERE post_id IN (SELECT post_id FROM fit)) p CROSS JOIN top
 UNION ALL SELECT post_id, ngram, coalesce(uses_cnt, 0) FROM named WHERE post_id IN (SELECT post_id FROM fit)""")
def matrix_multi_label(spark, sf_dir):
    """Labels first, then the counts of the n-grams."""
    top, tagged, named = _learning(Corpus(spark, sf_dir))
    return dataset.multi_label_matrix(named, tagged, top)


@query("WITH n AS (SELECT CAST(floor(count(DISTINCT id) * 0.2) AS BIGINT) AS k FROM post WHERE normalized), r AS (SELECT id, row_number() OVER (ORDER BY (id % 1000003 * 7919 + 104729) % 1000003, id) AS rn FROM post WHERE normalized) SELECT id AS post_id, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS part FROM r CROSS JOIN n")
def train_test_split(spark, sf_dir):
    return dataset.split(Corpus(spark, sf_dir).normalized.select(F.col("id").alias("post_id")), 0.2)


_JUDGED = "judged AS (SELECT CAST(type = 1 AS INTEGER) AS truth, CAST(tf_idf > 0.001 AS INTEGER) AS predicted FROM tfidfsimple WHERE tf_idf IS NOT NULL AND type IS NOT NULL)"
_COUNTS = f"WITH {_JUDGED}, c AS (SELECT count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 0) AS tn, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn FROM judged)"


def _judged(spark, sf_dir):
    rows = table(spark, sf_dir, "tfidfsimple").select("type", "tf_idf").dropna()
    return rows.select((F.col("type") == 1).cast("int").alias("truth"), (F.col("tf_idf") > 0.001).cast("int").alias("predicted"))


@query(_COUNTS + " SELECT tp, tn, fp, fn FROM c")
def confusion_counts(spark, sf_dir):
    return evaluate.confusion_counts(_judged(spark, sf_dir), "truth", "predicted")


@query(_COUNTS + " SELECT round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 9) AS accuracy, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(2 * tp / (2 * tp + fn + fp)::DOUBLE, 9) AS f_beta FROM c")
def label_metrics(spark, sf_dir):
    return evaluate.metrics(evaluate.confusion_counts(_judged(spark, sf_dir), "truth", "predicted"))


@query(f"WITH {_JUDGED} SELECT truth, predicted, count(*) AS n FROM judged GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_judged(spark, sf_dir), "truth", "predicted")


@query(f"""WITH {_JUDGED}, n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (truth = predicted) AS ok, (avg(truth) * avg(predicted) + (1 - avg(truth)) * (1 - avg(predicted))) AS pe FROM judged)
 SELECT CAST(n AS BIGINT) AS judged, ok AS "right", CAST(n AS BIGINT) - ok AS wrong, round(ok / n, 9) AS accuracy, round((ok / n - pe) / (1 - pe), 9) AS kappa FROM n""")
def evaluation_summary(spark, sf_dir):
    return evaluate.summary(_judged(spark, sf_dir), "truth", "predicted")


@query(f"""WITH {_JUDGED}, k AS (SELECT unnest([0, 1]) AS label), s AS (SELECT label, count(*) FILTER (truth = label) AS n, count(*) FILTER (predicted = label) AS said, count(*) FILTER (truth = label AND predicted = label) AS ok FROM k CROSS JOIN judged GROUP BY label)
 SELECT label, n AS rows, round(ok / said::DOUBLE, 9) AS precision, round(ok / n::DOUBLE, 9) AS recall, round(2 * ok / (n + said)::DOUBLE, 9) AS f1 FROM s""")
def evaluation_per_class(spark, sf_dir):
    return evaluate.class_details(_judged(spark, sf_dir), "truth", "predicted")


@query("""WITH dims AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
 bounds AS (SELECT d, min(x) AS lo, max(x) AS hi FROM dims GROUP BY d),
 s AS (SELECT vec_id, label, d, CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE x - lo END AS x FROM dims JOIN bounds USING (d)),
 dist AS (SELECT q.vec_id AS id, s.vec_id AS other, s.label, sqrt(sum((s.x - q.x) ** 2)) AS r FROM s JOIN s q ON q.d = s.d AND q.vec_id % 50 = 0 AND q.vec_id <> s.vec_id GROUP BY 1, 2, 3),
 near AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, other) AS rn FROM dist) WHERE rn <= 3),
 votes AS (SELECT id, label, count(*) AS n FROM near GROUP BY id, label)
 SELECT id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS rn FROM votes) WHERE rn = 1""")
def knn3(spark, sf_dir):
    """The label of every vector whose id is divisible by 50, by its three nearest among all vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    return models.nearest(rows, rows.where("id % 50 = 0"), 3)


def _labelled(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").dropna().select(F.col("vec_id").alias("post_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    parts = dataset.split(rows.select("post_id"), 0.2)
    both = rows.join(parts, "post_id")
    return both.where("part = 'train'").drop("part"), both.where("part = 'test'").drop("part")


@query()
def lsa_project(spark, sf_dir):
    """Posts of the top tags on the leading latent axes of all their terms."""
    named = written(_learning(Corpus(spark, sf_dir))[2], "named")
    rows = written(dataset.vectors(named, dataset.vocabulary(named)), "vectors")
    return models.LSA(0.9).fit(rows).transform(rows).select("post_id", vector_to_array("features").alias("features"))


@query()
def naive_bayes(spark, sf_dir):
    train, test = _labelled(spark, sf_dir)
    return evaluate.confusion_matrix(models.Built(models.naive_bayes).build(train).judged(test), "label", "prediction")


@query()
def decision_tree(spark, sf_dir):
    train, test = _labelled(spark, sf_dir)
    return evaluate.confusion_matrix(models.Built(models.decision_tree).build(train).judged(test), "label", "prediction")


@query()
def classifier_chain(spark, sf_dir):
    """Three labels of vectors, each predicted with its parent's help."""
    train, test = _labelled(spark, sf_dir)
    flags = lambda rows: rows.select("post_id", "features", *((F.pmod("label", F.lit(k)) == 0).cast("int").alias(f"m{k}") for k in (2, 3, 5)))
    chain = models.ClassifierChain(["m2", "m3", "m5"]).fit(flags(train))
    return chain.transform(flags(test)).select("post_id", "m2", "m3", "m5", "Pred_m2", "Pred_m3", "Pred_m5")


# ---- gates, checks and appends -------------------------------------------------------------------------------------


def _pairs_of(n: int):
    return (
        f"WITH words AS (SELECT id AS post_id, {_TOKENS} AS w FROM post), items AS (SELECT post_id, unnest(list_filter(list_transform(generate_series(1, len(w) - {n} + 1), lambda i: array_to_string(w[i:i + {n} - 1], ' ')), lambda x: x NOT IN ({_STOP}))) AS ngram FROM words WHERE len(w) >= {n})"
        " SELECT post_id, ngram, CAST(count(*) AS INTEGER) AS uses_cnt FROM items GROUP BY post_id, ngram"
    )


@query(_pairs_of(2))
def digram_postings(spark, sf_dir):
    return text.postings(Corpus(spark, sf_dir).posts, "id", text.post_text(F.col("title"), F.col("text")), 2).drop("uses_str")


@query(_pairs_of(3))
def trigram_postings(spark, sf_dir):
    return text.postings(Corpus(spark, sf_dir).posts, "id", text.post_text(F.col("title"), F.col("text")), 3).drop("uses_str")


@query("SELECT id, CASE WHEN r_name IS NULL THEN 'unknown' WHEN r_name = 'EUROPE' THEN 'collect' ELSE 'stop' END AS status FROM userlj LEFT JOIN region ON r_regionkey = region_id")
def region_gate(spark, sf_dir):
    """Users of a known region other than the wanted one go no further."""
    c = Corpus(spark, sf_dir)
    rows = c.users.select("id", "region_id").join(c.regions.select(F.col("id").alias("region_id"), "name"), "region_id", "left")
    status = F.when(F.col("name").isNull(), "unknown").when(F.col("name") == "EUROPE", "collect").otherwise("stop")
    return rows.select("id", status.alias("status"))


# fixed values: the paths whose exclusion is counted
_PATHS = ["/", "/data/foaf/", "/tag/", "/data/rss/", "/misc/fdata/", "/calendar", "/2015/", "/2012/"]


@query("WITH r AS (SELECT CASE id % 4 WHEN 0 THEN ['/'] WHEN 1 THEN ['/tag/', '/calendar'] WHEN 2 THEN ['/data/rss/'] ELSE [] END AS p FROM userlj WHERE id IS NOT NULL), w AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in _PATHS) + "]) AS path) SELECT path, count(*) FILTER (list_contains(p, path) OR list_contains(p, '/')) AS users FROM w CROSS JOIN r GROUP BY path")
def robots_statistics(spark, sf_dir):
    """How many users' robots files exclude each path; whoever excludes all is counted everywhere."""
    kind = F.pmod("id", F.lit(4))
    lines = F.when(kind == 0, "Disallow: /\n").when(kind == 1, "Disallow: /tag/\nDisallow: /calendar\n").when(kind == 2, "Disallow: /data/rss/\n").otherwise("")
    rows = table(spark, sf_dir, "userlj").where("id is not null").select(parse.disallowed(F.concat(F.lit("User-Agent: *\n"), lines)).alias("paths"))
    count = lambda p: F.count(F.when(F.array_contains("paths", p) | F.array_contains("paths", "/"), 1)).alias(p)
    wide = rows.agg(*(count(p) for p in _PATHS))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(f"`{p}`").alias("users")) for p in _PATHS))).alias("x")).select("x.path", "x.users")


@query("""SELECT 'post' AS name, count(*) - count(DISTINCT id) AS repeated, count(*) FILTER (user_id NOT IN (SELECT id FROM userlj)) AS dangling FROM post
UNION ALL SELECT 'tag', count(*) - count(DISTINCT id), count(*) FILTER (master_id NOT IN (SELECT id FROM mastertag)) FROM tag
UNION ALL SELECT 'tagtopost', count(*) - (SELECT count(*) FROM (SELECT DISTINCT tag_id, post_id FROM tagtopost)), count(*) FILTER (tag_id NOT IN (SELECT id FROM tag)) FROM tagtopost
UNION ALL SELECT 'unigramtopost', count(*) - (SELECT count(*) FROM (SELECT DISTINCT ngram_id, post_id FROM unigramtopost)), count(*) FILTER (ngram_id NOT IN (SELECT id FROM unigram)) FROM unigramtopost""")
def constraint_report(spark, sf_dir):
    """Rows beyond the first of their key, and references that point nowhere; Spark enforces neither."""
    out = None
    for name, keys, column, target in (("post", ["id"], "user_id", "userlj"), ("tag", ["id"], "master_id", "mastertag"), ("tagtopost", ["tag_id", "post_id"], "tag_id", "tag"), ("unigramtopost", ["ngram_id", "post_id"], "ngram_id", "unigram")):
        rows = table(spark, sf_dir, name)
        repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
        lost = rows.select(column).dropna().join(table(spark, sf_dir, target).select(F.col("id").alias(column)), column, "left_anti").agg(F.count("*").alias("dangling"))
        line = repeated.join(F.broadcast(lost), how="cross").select(F.lit(name).alias("name"), "repeated", "dangling")  # one row each
        out = line if out is None else out.unionByName(line)
    return out


@query("SELECT DISTINCT lower(trim(text)) AS text FROM unigram WHERE text IS NOT NULL AND lower(trim(text)) NOT IN (SELECT text FROM tag WHERE text IS NOT NULL)")
def tags_append(spark, sf_dir):
    """What an insert of the unigrams' texts adds to the tags: unknown texts, each once."""
    new = table(spark, sf_dir, "unigram").select(F.lower(F.trim("text")).alias("text"), "id")
    return queue.appended(table(spark, sf_dir, "tag").select("text"), new, ["text"], ["id"]).select("text")


@query("SELECT t.id, t.text, coalesce(m.text, t.text) AS master FROM tag t LEFT JOIN mastertag m ON m.id = t.master_id WHERE t.id IS NOT NULL")
def tag_masters(spark, sf_dir):
    """Each tag with the entry of the clean list it is known to mean, or itself."""
    masters = table(spark, sf_dir, "mastertag").select(F.col("id").alias("master_id"), F.col("text").alias("master"))
    return Corpus(spark, sf_dir).tags.join(masters, "master_id", "left").select("id", "text", F.coalesce("master", "text").alias("master"))
