"""The queries of the training-data operators over the test tables, and their SQL where SQL states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.llm import canonical, cooccur, frequency, mixing, neardup, packing, spans, topn
from tagloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark, sf_dir):
    """The entry each hand-typed tag and city means, 0 where the list has none."""
    tags = table(spark, sf_dir, "tag").where("id is not null and master_id is null").select(F.col("id").alias("src_id"), "text")
    cities = table(spark, sf_dir, "userlj").select(F.col("id").alias("src_id"), F.col("city_cstm").alias("text"))
    cities = cities.where(F.col("src_id").isNotNull() & F.col("text").rlike(r"[^\s\u00a0]"))
    tag_list = table(spark, sf_dir, "mastertag").select(F.col("id").alias("ref_id"), F.col("text").alias("name"))
    city_list = table(spark, sf_dir, "cityref").select(F.col("city_id").alias("ref_id"), "name")
    named = lambda field, rows: rows.select(F.lit(field).alias("field"), "*")
    rows = named("tag", tags).unionByName(named("city_cstm", cities))
    return canonical.mapped(rows, named("tag", tag_list).unionByName(named("city_cstm", city_list)))


@query
def p3_found(spark, sf_dir):
    """The ten items of highest tf_idf of every tag."""
    return topn.top_n_per_group(table(spark, sf_dir, "tfidfsimple"), "tag_id", "tf_idf", ["type", "ngram_id"], 10).drop("tf_idf")


ORACLE["p3_found"] = """
WITH best AS (
  SELECT tag_id, type, ngram_id, max(tf_idf) AS s FROM tfidfsimple
  WHERE tf_idf IS NOT NULL AND NOT isnan(tf_idf) AND tag_id IS NOT NULL AND type IS NOT NULL AND ngram_id IS NOT NULL
  GROUP BY tag_id, type, ngram_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY s DESC, type, ngram_id) AS rn FROM best)
SELECT tag_id, type, ngram_id FROM ranked WHERE rn <= 10"""


def _unigrams(spark, sf_dir):
    postings = table(spark, sf_dir, "unigramtopost")
    terms = frequency.term_frequency(table(spark, sf_dir, "unigram"), "id", "text", postings, "ngram_id", "post_id", "uses_cnt")
    return terms, frequency.record_count(postings, None, "post_id")


def _tags(spark, sf_dir):
    postings = table(spark, sf_dir, "tagtopost")
    terms = frequency.term_frequency(table(spark, sf_dir, "tag"), "id", "text", postings, "tag_id", "post_id")
    return terms, frequency.record_count(postings, "tag_id", "post_id")


@query
def p4_found(spark, sf_dir):
    """Terms too rare or too common to be useful."""
    parts = [frequency.marked_terms(*f(spark, sf_dir)).select(F.lit(kind).alias("kind"), "term", "mark") for kind, f in (("unigram", _unigrams), ("tag", _tags))]
    return parts[0].unionByName(parts[1])


@query
def p4_frequency(spark, sf_dir):
    """Total uses and number of posts of every term."""
    parts = [f(spark, sf_dir)[0].select(F.lit(kind).alias("kind"), "term", "uses", "records") for kind, f in (("unigram", _unigrams), ("tag", _tags))]
    return parts[0].unionByName(parts[1])


_FREQUENCY = r"""
WITH u AS (SELECT ngram_id, post_id, coalesce(max(uses_cnt), 0) AS n FROM unigramtopost
           WHERE ngram_id IS NOT NULL AND post_id IS NOT NULL GROUP BY ngram_id, post_id),
     uterm AS (SELECT DISTINCT id, lower(regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) AS term FROM unigram WHERE id IS NOT NULL AND text IS NOT NULL),
     tterm AS (SELECT DISTINCT id, lower(regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) AS term FROM tag WHERE id IS NOT NULL AND text IS NOT NULL),
     freq AS (
       SELECT 'unigram' AS kind, term, CAST(coalesce(sum(n), 0) AS BIGINT) AS uses, count(DISTINCT post_id) AS records
       FROM uterm LEFT JOIN u ON ngram_id = id GROUP BY term
       UNION ALL
       SELECT 'tag', term, count(DISTINCT post_id), count(DISTINCT post_id)
       FROM tterm LEFT JOIN tagtopost ON tag_id = id GROUP BY term)"""
ORACLE["p4_frequency"] = _FREQUENCY + " SELECT kind, term, uses, records FROM freq"
ORACLE["p4_found"] = (
    _FREQUENCY
    + """, total AS (
       SELECT 'unigram' AS kind, count(DISTINCT post_id) AS n FROM unigramtopost
       UNION ALL SELECT 'tag', count(DISTINCT post_id) FROM tagtopost WHERE tag_id IS NOT NULL)
SELECT kind, term, 'rare' AS mark FROM freq WHERE uses < 5
UNION ALL SELECT kind, term, 'common' FROM freq JOIN total USING (kind) WHERE records * 10 > n"""
)


@query
def p5_found(spark, sf_dir):
    """Pairs of tags set on the same posts at least three times as often as chance."""
    counts = cooccur.pair_counts(table(spark, sf_dir, "tagtopost"), "tag_id", "post_id", least=5)
    return cooccur.associated_pairs(counts).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


@query
def p5_association(spark, sf_dir):
    """Every pair of tags with its counts and how far it exceeds chance."""
    counts = cooccur.associated_pairs(cooccur.pair_counts(table(spark, sf_dir, "tagtopost"), "tag_id", "post_id"), least_lift=0)
    numbers = [F.round(c, 9).alias(c) for c in ("lift", "pmi", "jaccard")]
    return counts.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", *numbers)


_PAIRS = """
WITH base AS (SELECT DISTINCT tag_id, post_id FROM tagtopost WHERE tag_id IS NOT NULL AND post_id IS NOT NULL),
     one AS (SELECT tag_id, count(*) AS n FROM base GROUP BY tag_id),
     total AS (SELECT count(DISTINCT post_id) AS n FROM base),
     pair AS (SELECT a.tag_id AS tag_a, b.tag_id AS tag_b, count(*) AS n_ab FROM base a JOIN base b ON a.post_id = b.post_id AND a.tag_id < b.tag_id GROUP BY 1, 2),
     counts AS (SELECT tag_a, tag_b, n_ab, x.n AS n_a, y.n AS n_b, total.n AS n FROM pair JOIN one x ON x.tag_id = tag_a JOIN one y ON y.tag_id = tag_b CROSS JOIN total)"""
ORACLE["p5_found"] = _PAIRS + " SELECT tag_a, tag_b FROM counts WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b"
ORACLE["p5_association"] = (
    _PAIRS
    + """ SELECT tag_a, tag_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 9) AS lift,
   round(log2(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b)), 9) AS pmi, round(n_ab / (n_a + n_b - n_ab)::DOUBLE, 9) AS jaccard FROM counts"""
)


@query
def p6_found(spark, sf_dir):
    """Pairs of posts whose title and text are the same but for small edits."""
    return neardup.similar_pairs(table(spark, sf_dir, "post"))


@query
def p6_groups(spark, sf_dir):
    """The group of alike posts each post belongs to, copies by their representative."""
    return neardup.similar_groups(table(spark, sf_dir, "post"))


@query
def p7_containers(spark, sf_dir):
    """The texts of documents in containers of 2,048 tokens: what each holds and its fill."""
    return packing.packed_containers(table(spark, sf_dir, "documents"), capacity=2048)


@query
def p7_report(spark, sf_dir):
    """Containers, tokens and the share of space used."""
    return packing.packing_report(packing.packed_containers(table(spark, sf_dir, "documents"), capacity=2048), 2048)


#: Capacities of which each binds somewhere: tokens, documents, and the attention cost of three documents of 700 tokens.
LIMITS = {"capacity": 2048, "most_items": 12, "most_cost": 3 * 700.0**2}


@query
def p7_limited(spark, sf_dir):
    """Containers in which the number of texts and the attention cost bind beside the tokens."""
    return packing.packed_containers(table(spark, sf_dir, "documents"), **LIMITS)


@query
def p7_limits(spark, sf_dir):
    """Which capacity binds in how many of those containers."""
    return packing.binding_limits(p7_limited(spark, sf_dir), **LIMITS)


@query
def p8_mixture(spark, sf_dir):
    """The texts used for each source, and how often."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixtarget"))


@query
def p8_shares(spark, sf_dir):
    """The actual share of each source beside its target."""
    targets = table(spark, sf_dir, "mixtarget")
    return mixing.mixture_shares(mixing.mixture(table(spark, sf_dir, "documents"), targets), targets)


@query
def p9_found(spark, sf_dir):
    """Maximal runs of words of each document that stand word for word in another one."""
    return spans.shared_spans(table(spark, sf_dir, "documents"), length=40)


@query
def p9_shared_share(spark, sf_dir):
    """For each document how much of it stands elsewhere too."""
    return spans.document_shares(table(spark, sf_dir, "documents"), length=40)


ORACLE["p6_found"] = r"""
WITH words AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM post WHERE id IS NOT NULL),
     seqs AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM words WHERE len(w) >= 12),
     sizes AS (SELECT id, count(*) AS n FROM seqs GROUP BY id),
     common AS (SELECT a.id AS post_a, b.id AS post_b, count(*) AS n FROM seqs a JOIN seqs b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT post_a, post_b FROM common JOIN sizes x ON x.id = post_a JOIN sizes y ON y.id = post_b WHERE 3 * common.n >= x.n + y.n"""

_SPANS = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
     h1 AS (SELECT doc_id, n, i, hash(x) AS h FROM (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM words WHERE len(w) >= 40)),
     h2 AS (SELECT doc_id, n, i, hash(h, lead(h, 1) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h1),
     h4 AS (SELECT doc_id, n, i, hash(h, lead(h, 2) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h2),
     h8 AS (SELECT doc_id, n, i, hash(h, lead(h, 4) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h4),
     h16 AS (SELECT doc_id, n, i, h AS h8, hash(h, lead(h, 8) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h8),
     h32 AS (SELECT doc_id, n, i, h8, hash(h, lead(h, 16) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h16),
     h40 AS (SELECT doc_id, n, i, hash(h, lead(h8, 32) OVER (PARTITION BY doc_id ORDER BY i)) AS s FROM h32),
     windows AS (SELECT doc_id, i, s FROM h40 WHERE i <= n - 39),
     shared AS (SELECT s FROM windows GROUP BY s HAVING count(DISTINCT doc_id) > 1),
     hits AS (SELECT doc_id, i, CAST(coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 40, false) AS INTEGER) AS starts FROM windows JOIN shared USING (s)),
     numbered AS (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
     spans AS (SELECT doc_id, min(i) - 1 AS first_word, max(i) + 38 AS last_word FROM numbered GROUP BY doc_id, run)"""
ORACLE["p9_found"] = _SPANS + " SELECT doc_id, first_word, last_word FROM spans"
ORACLE["p9_shared_share"] = (
    _SPANS
    + """, sums AS (SELECT doc_id, sum(last_word - first_word + 1) AS shared_words, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, len(w) AS words, CAST(coalesce(shared_words, 0) AS BIGINT) AS shared_words, coalesce(sums.spans, 0) AS spans, CASE WHEN len(w) = 0 THEN 0.0 ELSE coalesce(shared_words, 0)::DOUBLE / len(w) END AS share
FROM words LEFT JOIN sums USING (doc_id)"""
)
