"""Queries of sources, parsers and n-gram rules. Captured bodies are made from the tables' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import parse, rules, text
from tagloom.operators.corpus import Corpus
from tagloom.plans.catalog import _STOP, _TOKENS, _element, _markup, _rss
from tagloom.plans.registry import query
from tagloom.sources import payloads, tables


@query("SELECT unnest(['post', 'tag_name_to_post', 'no_such_table']) AS name, unnest([true, true, false]) AS there")
def catalog_probe(spark, sf_dir):
    tables.register_views(spark, sf_dir)
    rows = [(name, tables.has_table(spark, name)) for name in ("post", "tag_name_to_post", "no_such_table")]
    return spark.createDataFrame(rows, "name string, there boolean")


@query("SELECT DISTINCT post_id FROM tagtopost JOIN tag ON tag.id = tag_id WHERE tag.id = 1")
def posts_of_tag_view(spark, sf_dir):
    """By the view of tag names, with a bound parameter."""
    tables.register_views(spark, sf_dir)
    name = spark.sql("SELECT text FROM tag WHERE id = 1").first()
    return spark.sql("SELECT post_id FROM tag_name_to_post WHERE text = :name", args={"name": name.text if name else ""})


@query("SELECT id, 'http://blog.test/tag?name=' || replace(replace(replace(url_encode(text), '%20', '+'), '%2A', '*'), '~', '%7E') || '&n=' || id AS url FROM tag WHERE text IS NOT NULL AND id IS NOT NULL")
def request_urls(spark, sf_dir):
    """Addresses with encoded arguments."""
    rows = Corpus(spark, sf_dir).tags.where("text is not null")
    return rows.select("id", payloads.request_url("http://blog.test/tag", name=F.col("text"), n=F.col("id").cast("string")).alias("url"))


@query("SELECT nick, 'bio' AS kind, CASE WHEN id % 3 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN id % 3 = 0 THEN 'Not Found' ELSE bio END AS body FROM userlj")
def answers(spark, sf_dir):
    """Captured answers; one that failed has its reason as its body."""
    gone = F.col("id") % 3 == 0
    rows = Corpus(spark, sf_dir).users.select("nick", F.lit("bio").alias("kind"), F.when(gone, 404).otherwise(200).alias("status"), F.when(gone, "Not Found").otherwise("OK").alias("reason"), F.col("bio").alias("body"))
    return payloads.answered(rows)


@query("""SELECT id, nick, nullif(regexp_replace(city_cstm, '^\\s+|\\s+$', '', 'g'), '') AS city, CASE WHEN birthday IS NULL THEN NULL WHEN id % 2 = 0 THEN make_date(year(birthday), 1, 1) ELSE birthday END AS birthday,
 created, updated, posts_num AS posts, cmmnt_out AS posted, cmmnt_in AS received, r_name AS region, CASE WHEN id % 3 = 0 THEN 'a,b,' END AS interests, 'School ' || id % 7 AS school FROM userlj LEFT JOIN region ON r_regionkey = region_id WHERE nick IS NOT NULL AND coalesce(city_cstm, '') = regexp_replace(coalesce(city_cstm, ''), '\\s', ' ', 'g')
 AND coalesce(posts_num, 0) >= 0 AND coalesce(cmmnt_in, 0) >= 0 AND coalesce(cmmnt_out, 0) >= 0 AND (birthday IS NULL OR year(birthday) BETWEEN 1000 AND 9999)""")
def foaf_parse(spark, sf_dir):
    """Each user as a FOAF body gives them: dates of a year only, joined interests and what is missing included."""
    c = Corpus(spark, sf_dir)
    rows = c.users.join(c.regions.select(F.col("id").alias("region_id"), F.col("name").alias("region")), "region_id", "left")
    rows = rows.where("nick is not null and coalesce(city_cstm, '') = regexp_replace(coalesce(city_cstm, ''), '\\\\s', ' ') and coalesce(posts_num, 0) >= 0 and coalesce(cmmnt_in, 0) >= 0 and coalesce(cmmnt_out, 0) >= 0 and (birthday is null or year(birthday) between 1000 and 9999)")
    titled = lambda name, value: F.coalesce(F.concat(F.lit(f'<y:{name} d:title="'), _markup(value), F.lit('"/>')), F.lit(""))
    stamp = lambda name, c: F.coalesce(F.concat(F.lit(f' y:{name}="'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"')), F.lit(""))
    born = F.when(F.col("id") % 2 == 0, F.date_format("birthday", "yyyy")).otherwise(F.date_format("birthday", "yyyy-MM-dd"))
    counts = F.concat(_element("posted", F.col("cmmnt_out").cast("string")), _element("received", F.col("cmmnt_in").cast("string")))
    parts = [
        _element("nick", F.col("nick")), titled("country", F.col("region")), titled("city", F.col("city_cstm")), _element("dateOfBirth", born),
        F.concat(F.lit("<y:weblog"), stamp("dateCreated", F.col("created")), stamp("dateLastUpdated", F.col("updated")), F.lit("/>")),
        F.concat(F.lit("<posts>"), _element("posted", F.col("posts_num").cast("string")), F.lit("</posts><comments>"), counts, F.lit("</comments>")),
        F.when(F.col("id") % 3 == 0, F.concat(titled("interest", F.lit("a")), titled("interest", F.lit("b")))).otherwise(""),
        titled("school", F.concat(F.lit("School "), (F.col("id") % 7).cast("string"))),
    ]
    body = F.concat(F.lit('<r xmlns:f="urn:f" xmlns:y="urn:y" xmlns:d="urn:d"><f:Person>'), *parts, F.lit("</f:Person></r>"))
    p = rows.select("id", parse.foaf_person(body).alias("p")).select("id", "p.*")
    return p.select(
        "id", "nick", "city", parse.loose_date(F.col("birthday")).alias("birthday"), parse.loose_timestamp(F.col("created")).alias("created"), parse.loose_timestamp(F.col("updated")).alias("updated"),
        "posts", "posted", "received", "region", parse.joined_interests(F.col("interests")).alias("interests"), F.col("schools")[0]["name"].alias("school"),
    )


@query("SELECT url, replies FROM (SELECT url, comments AS replies, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM post WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM post WHERE url IS NOT NULL AND user_id % 2 = 0)) WHERE rn = 1")
def rss_new_posts(spark, sf_dir):
    """Feed entries of addresses not known yet, each once; known are those of every second user."""
    c = Corpus(spark, sf_dir)
    items = _rss(c).select("id", F.explode(parse.rss_items("body")).alias("item")).select("id", parse.guid_number(F.col("item.guid")).alias("url"), F.col("item.replies").alias("replies"))
    known = c.posts.where("user_id % 2 = 0").select("url")
    return parse.unknown_items(items, known, "url", "id").select("url", "replies")


@query("SELECT id, strptime(strftime(date, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS published, 'http://blog.test/' || url || '.html' AS guid, comments AS replies FROM post")
def rss_fields(spark, sf_dir):
    """Time, address and replies of each post's feed entry."""
    rows = _rss(Corpus(spark, sf_dir)).select("id", F.explode(parse.rss_items("body")).alias("item"))
    return rows.select("id", parse.rss_time(F.col("item.published")).cast("timestamp_ntz").alias("published"), "item.guid", "item.replies")


@query("SELECT id, lower(trim(text)) AS name, CAST(CASE WHEN id % 1000003 < 100000 THEN id % 1000003 END AS INTEGER) AS uses FROM tag WHERE id IS NOT NULL AND regexp_matches(text, '^[a-zа-яё ]*[a-zа-яё][a-zа-яё ]*$')")
def tag_anchors_beside(spark, sf_dir):
    """Tags on a page of the other host, their uses written beside the anchor."""
    rows = Corpus(spark, sf_dir).tags.where(F.col("text").rlike("^[a-zа-яё ]*[a-zа-яё][a-zа-яё ]*$"))
    page = F.concat(F.lit('<ul><li><a href="/other/1">no</a></li><li><a class="x9" href="/users/tag/7">'), _markup(F.col("text")), F.lit("</a> "), (F.col("id") % 1000003).cast("string"), F.lit("</li></ul>"))
    return rows.select("id", F.explode(parse.tag_anchors(page, F.lit("/tag/"), F.lit("/users/tag/"))).alias("t")).select("id", "t.name", "t.uses")


_WORDS = f"words AS (SELECT id AS post_id, {_TOKENS} AS w FROM post)"


@query(f"WITH {_WORDS} SELECT post_id, unnest(w[1:3]) AS ngram FROM words")
def fact_ngrams(spark, sf_dir):
    """N-grams out of an extractor's result page: here a text's first three words, after two other rows."""
    words = F.slice(text.words_of(text.post_text(F.col("title"), F.col("text"))), 1, 3)
    cells = F.array_join(F.transform(words, lambda w: F.concat(F.lit("<tr><td>"), w, F.lit("</td></tr>"))), "")
    page = F.concat(F.lit("<table><tr><td>Other</td></tr><tr><td>x</td></tr><tr><td>no</td></tr></table><table><tr><th>NGrams</th></tr><tr><td>Text</td></tr>"), cells, F.lit("</table>"))
    return Corpus(spark, sf_dir).posts.select(F.col("id").alias("post_id"), F.explode(parse.fact_rows(page)).alias("ngram"))


_TAG = "CASE " + " ".join(f"WHEN regexp_matches(x, '{e}') THEN '{p}'" for p, e in rules.ENDINGS.items()) + " ELSE 'N' END"
_TAGGED = f"{_WORDS}, tagged AS (SELECT post_id, w, list_transform(w, lambda x: {_TAG}) AS p FROM words)"


def _rule_sql(found: list[tuple[str, str]]) -> str:
    n = len(found[0][0])
    lists = " || ".join(f"list_transform(list_filter(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(p[i:i + {n - 1}], '') = '{kinds}'), lambda i: {out})" for kinds, out in found)
    return f"""WITH {_TAGGED}, facts AS (SELECT post_id, list_filter({lists}, lambda x: x NOT IN ({_STOP})) AS f FROM tagged WHERE len(w) >= {n}),
 items AS (SELECT post_id, generate_subscripts(f, 1) - 1 AS pos, unnest(f) AS ngram FROM facts)
 SELECT post_id, ngram, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS uses_str, CAST(count(*) AS INTEGER) AS uses_cnt FROM items GROUP BY post_id, ngram"""


_BACK, _ON = "w[i + 1] || ' ' || w[i]", "w[i] || ' ' || w[i + 1]"


@query(_rule_sql([("AN", _BACK), ("NA", _ON), ("NN", _ON), ("VD", _ON), ("DV", _BACK)]))
def digram_rules(spark, sf_dir):
    """Two-word n-grams by the grammars in their fixed order, with positions in the joined list."""
    return rules.rule_postings(Corpus(spark, sf_dir).posts, "id", text.post_text(F.col("title"), F.col("text")), 2)


@query(_rule_sql([("AAN", "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]")]))
def trigram_rules(spark, sf_dir):
    return rules.rule_postings(Corpus(spark, sf_dir).posts, "id", text.post_text(F.col("title"), F.col("text")), 3)


@query(f"WITH {_WORDS}, items AS (SELECT post_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS ngram FROM (SELECT post_id, list_filter(list_transform(w, lambda x: regexp_replace(x, '(а|ы|у|ой|е)$', '')), lambda x: x NOT IN ({_STOP})) AS w FROM words)) SELECT post_id, ngram, CAST(count(*) AS INTEGER) AS uses_cnt FROM items GROUP BY post_id, ngram")
def lemma_postings(spark, sf_dir):
    """Single words through a lemma hook, here one that cuts endings."""
    lemma = lambda w: F.regexp_replace(w, "(а|ы|у|ой|е)$", "")
    return rules.rule_postings(Corpus(spark, sf_dir).posts, "id", text.post_text(F.col("title"), F.col("text")), 1, lemma=lemma).drop("uses_str")
