from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tagloom.functions import parse, text
from tagloom.ml import dataset, evaluate, models
from tagloom.operators import packed, popularity, queue, tfidf


def values(spark, *texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    out = {}
    for r in packed.packed_values(df, "s", ["id"], **how).orderBy("id", "pos").collect():
        out.setdefault(r.id, []).append(r.val)
        assert r.pos == len(out[r.id]) - 1
    return [out.get(k, []) for k in range(len(texts))]


def test_packed_lists(spark):
    assert values(
        spark,
        'a, "b, c" ,(d; e) f,  ,g',
        'the "x", "the ""x и y"" thing"; o\'clock club | \'север, юг\'\n24/7 radio / b',
        "«книги, которые жду»;“rain, again” • x [raw; jpeg]\r\ny",
        "children's maps,drum'n'tea,'children's, big'",
        "a, a,A",
    ) == [
        ["a", "b, c", "(d; e) f", "g"],
        ['the "x"', 'the "x и y" thing', "o'clock club", "север, юг", "24/7 radio", "b"],
        ["книги, которые жду", "rain, again", "x [raw; jpeg]", "y"],
        ["children's maps", "drum'n'tea", "children's, big"],
        ["a", "a", "A"],
    ]


def test_packed_edges(spark):
    mark = packed.MARK + "0" + packed.END
    assert values(spark, None, "", ' ,;, "" ', 'bad " quote, (open', f"x{mark},“q”", "w" * 50_000 + ",b") == [
        [], [], [], ['bad " quote', "(open"], [f"x{mark}", "q"], ["w" * 50_000, "b"],
    ]


def test_packed_numbers(spark):
    how = {"separators": packed.NUMBER_SEPARATORS, "opened": True}
    assert values(spark, '"0,1"', "'9','9'", "{0, 10}", "; 0,1,", "1 22|37;49/3", None, '"1,2"; {3, (4)} 5"6"', "'", **how) == [
        ["0", "1"], ["9", "9"], ["0", "10"], ["0", "1"], ["1", "22", "37", "49", "3"], [], ["1", "2", "3", "4", "5", "6"], [],
    ]


def test_packed_repeated_rows_once(spark):
    df = spark.createDataFrame([(1, "a,b"), (1, "a;b"), (None, "c")], "id long, s string")
    assert sorted(packed.packed_values(df, "s", ["id"]).collect(), key=str) == sorted([(1, 0, "a"), (1, 1, "b"), (None, 0, "c")], key=str)
    assert packed.packed_values(df.limit(0), "s", ["id"]).count() == 0


def test_tfidf_by_hand(spark):
    rows = [("a", 1, "x", 2), ("a", 1, "x", 1), ("a", 2, "x y", 1), ("b", 1, "x", 2), ("b", 2, "x y", 1)]
    got = {(r.tag_id, r.ngram): (r.tf, r.idf) for r in tfidf.tfidf(spark.createDataFrame(rows, "tag_id string, type int, ngram string, uses int")).collect()}
    assert got[("a", "x")] == (0.75, round(__import__("math").log10(2 / 3), 9))
    assert got[("b", "x y")] == (0.333333333, 0.0)
    assert got[("a", "x y")][0] == 0.25


def test_tfidf_selection(spark):
    rows = [(1, 1, g, 0.0, 0.0, s) for g, s in (("c", 1.0), ("b", 1.0), ("a", 1.0))] + [(2, 1, "z", 0.0, 0.0, 5.0)]
    scores = spark.createDataFrame(rows, "tag_id int, type int, ngram string, tf double, idf double, tf_idf double")
    assert sorted(r.ngram for r in tfidf.top_per_tag(scores, 2).collect()) == ["a", "b", "z"]
    assert tfidf.top_total(scores, 100).count() == 4
    assert tfidf.top_total(scores, 1).count() <= 1
    assert tfidf.top_total(scores.limit(0), 5).count() == 0


def test_weeks_count_borders_twice(spark, tmp_path):
    posts = [(1, 1, datetime(2015, 1, 7)), (2, 1, datetime(2015, 1, 7, 0, 0, 1)), (3, 1, datetime(2013, 1, 1)), (4, 1, None)]
    spark.createDataFrame(posts, "id long, user_id long, date timestamp_ntz").withColumn("normalized", F.lit(True)).write.parquet(f"{tmp_path}/post.parquet")
    spark.createDataFrame([(7, "t")], "id long, text string").write.parquet(f"{tmp_path}/tag.parquet")
    spark.createDataFrame([(7, k) for k in (1, 2, 3, 4)] + [(None, 1)], "tag_id long, post_id long").write.parquet(f"{tmp_path}/tagtopost.parquet")
    from tagloom.operators.corpus import Corpus

    got = {r.week: r["count"] for r in popularity.week_statistics(Corpus(spark, str(tmp_path)), date(2015, 12, 31), 5).collect()}
    assert got == {date(2014, 12, 31): 1, date(2015, 1, 7): 2}


def test_offset_bounds():
    with pytest.raises(ValueError):
        popularity.top_by_offset(None, -1, 2)


def test_text_positions(spark):
    df = spark.createDataFrame([(1, "A  stop b, A"), (2, None), (3, "")], "id long, s string")
    got = {(r.post_id, r.ngram): (r.uses_str, r.uses_cnt) for r in text.postings(df, "id", F.col("s"), 1, ["stop"]).collect()}
    assert got == {(1, "a"): ("0,2", 2), (1, "b"): ("1", 1)}
    assert [r.ngram for r in text.postings(df, "id", F.col("s"), 3).orderBy("uses_str").collect()] == ["a stop b", "stop b a"]


def test_queue(spark):
    old = spark.createDataFrame([("a",)], "k string")
    new = spark.createDataFrame([("a", 0), ("b", 2), ("b", 1), (None, 0)], "k string, n int")
    assert queue.appended(old, new, ["k"], ["n"]).collect() == [("b", 1)]
    ids = spark.range(1, 5001).withColumnRenamed("id", "x")
    numbered = queue.numbered(ids.where("x % 3 = 0"), "x").orderBy("x").collect()
    assert [r.row_number for r in numbered] == list(range(1, len(numbered) + 1))
    assert queue.numbered(ids.limit(0), "x").count() == 0
    assert queue.reserved(ids, "x", 10).collect() == queue.reserved(ids.repartition(3), "x", 10).collect()
    assert queue.reserved(ids, "x", 0).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_parsers(spark):
    lit = F.lit
    robots = "User-Agent: a\nDisallow: /q\n\nUser-Agent: *\nDisallow: /\nDisallow: /tag/\n"
    assert one(spark, parse.disallowed(lit(robots))) == ["/", "/tag/"]
    assert one(spark, parse.disallowed(lit(None).cast("string"))) == []
    assert one(spark, parse.friends(lit("# head\n> a_b\n< c\n> c\n"))) == ["a-b", "c"]
    assert one(spark, parse.guid_number(lit("http://x.test/123.html"))) == 123
    assert one(spark, parse.guid_number(lit("none"))) is None
    assert [one(spark, parse.uses_number(lit(x))) for x in ("12345 uses", "123456 uses", "no")] == [12345, None, None]
    assert str(one(spark, parse.loose_date(lit("1990")))) == "1990-01-01"
    assert one(spark, parse.loose_date(lit("x-1"))) is None
    assert one(spark, parse.rss_time(lit("Mon, 19 Oct 2015 08:11:41 GMT"))) is not None
    assert one(spark, parse.joined_interests(F.array(lit("a"), lit("b")))) == "a,b,"
    assert one(spark, parse.html_text(lit("<p>a<b>b</b>&amp;c</p>"))) == "a b &c"
    page = '<a href="/tag/x" title="12 uses">Tea</a><a href="/other">no</a><a href="/tag/y">TEA</a>'
    assert one(spark, parse.tag_anchors(lit(page), lit("/tag/"), lit("/u/tag/"))) == [("tea", 12)]
    rss = "<rss><channel><item><title>t</title><guid>http://a/5.html</guid><category>Tea</category></item></channel></rss>"
    item = one(spark, parse.rss_items(lit(rss)))[0]
    assert (item.title, item.tags, item.replies) == ("t", ["tea"], None)
    assert one(spark, parse.rss_items(lit("<broken"))) == []
    foaf = '<r xmlns:f="http://xmlns.com/foaf/0.1/"><f:Person><f:nick>n</f:nick><f:dateOfBirth>1990</f:dateOfBirth><f:interest title="tea"/></f:Person></r>'
    person = one(spark, parse.foaf_person(lit(foaf)))
    assert (person.nick, person.birthday, person.city, person.interests) == ("n", "1990", None, ["tea"])


def test_scores(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 0.6), (0, 0.4), (0, 0.9), (None, 1.0)], "t int, p double")
    counts = evaluate.confusion_counts(rows, "t", "p")
    assert counts.first() == (2, 1, 1, 0)
    assert evaluate.metrics(counts).first() == (0.75, 0.666666667, 1.0, 0.8)
    assert evaluate.metrics(evaluate.confusion_counts(rows.limit(0), "t", "p")).first() == (None, None, None, None)


def test_split_is_exact(spark):
    ids = spark.range(10).withColumnRenamed("id", "post_id")
    parts = {r.part: r.n for r in dataset.split(ids, 0.25).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"test": 2, "train": 8}


def test_nearest(spark):
    rows = spark.createDataFrame([(k, k % 2, [float(k % 2) * 10 + k / 100, 0.0]) for k in range(40)], "id long, label int, features array<double>")
    got = models.nearest(rows, rows.where("id < 6"), 3)
    assert {r.id: r.prediction for r in got.collect()} == {k: k % 2 for k in range(6)}


def test_learners(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([(k, float(k % 2), [float(k % 2), k / 50, 1.0]) for k in range(40)], "post_id long, label double, x array<double>")
    rows = rows.select("post_id", "label", array_to_vector("x").alias("features"))
    for fit in (models.naive_bayes, models.decision_tree):
        model = fit(rows)
        assert model.transform(rows).where("prediction = label").count() >= 38
    lsa = models.LSA(0.9)
    with pytest.raises(RuntimeError):
        lsa.transform(rows)
    assert lsa.fit(rows).transform(rows).first().features.size <= 3
    flags = rows.select("post_id", "features", F.col("label").cast("int").alias("a"), F.col("label").cast("int").alias("b"))
    chained = models.ClassifierChain(["a", "b"]).fit(flags).transform(flags)
    assert chained.where("Pred_a = a and Pred_b = b").count() >= 38


def test_intake(spark, tmp_path):
    from tagloom.streaming.intake import intake

    for k, rows in enumerate(([("a", 1), ("b", 2)], [("b", 3), ("c", 4)])):
        spark.createDataFrame(rows, "k string, n int").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
        source = f"{tmp_path}/in/part{k}"
        intake(spark, source, "k string, n int", f"{tmp_path}/table", ["k"], ["n"], f"{tmp_path}/check{k}").awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/table").collect()) == [("a", 1), ("b", 2), ("c", 4)]


def test_catalogue():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_tag_pages_show_every_tag(spark, tmp_path):
    from tagloom.plans import catalog

    texts = ["tea", " Green  Tea ", "C++ & <b>", 'say "x" > y', "it's 5", "&amp;", "Ёлка, 2015", " ", None]
    spark.createDataFrame([*enumerate(texts, 99_995), (None, "lost")], "id long, text string").write.parquet(f"{tmp_path}/tag.parquet")
    got = sorted(catalog.tag_anchors(spark, str(tmp_path)).collect())
    assert got == [(k, t.strip().lower(), k % 100_000) for k, t in enumerate(texts, 99_995) if t and t.strip()]


def test_ngrams_of_all_three_types(spark, tmp_path):
    from collections import Counter
    from math import log10

    from tagloom.plans import catalog

    posts = [(1, "A b", "c a, b C", True), (2, None, "a b", False), (3, "a", "b c", True)]
    spark.createDataFrame(posts, "id long, title string, text string, normalized boolean").write.parquet(f"{tmp_path}/post.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string").write.parquet(f"{tmp_path}/unigram.parquet")
    uses = [(1, 1, 2), (2, 1, 2), (3, 1, 2), (1, 2, 1), (3, 3, 1)]
    spark.createDataFrame(uses, "ngram_id long, post_id long, uses_cnt int").write.parquet(f"{tmp_path}/unigramtopost.parquet")
    tagged = [(7, 1), (7, 2), (8, 2), (8, 3), (9, 3)]
    spark.createDataFrame(tagged, "tag_id long, post_id long").write.parquet(f"{tmp_path}/tagtopost.parquet")
    rows = Counter({(p, 1, " abc"[g]): n for g, p, n in uses})
    for p, words in ((1, "abcabc"), (2, "ab"), (3, "abc")):
        rows.update((p, n, " ".join(words[k : k + n])) for n in (2, 3) for k in range(len(words) - n + 1))
    sums, totals, spread = Counter(), Counter(), Counter()
    for tag, post in tagged:
        for (p, n, g), count in rows.items():
            if p == post:
                sums[tag, n, g] += count
                totals[tag] += count
                spread[n, g] += 1
    folder = str(tmp_path)
    got = {(r.tag_id, r.type, r.ngram): (r.tf, r.idf) for r in catalog.tfidf_simple(spark, folder).collect()}
    assert got == {(t, n, g): (round(c / totals[t], 9), round(log10(3 / spread[n, g]), 9)) for (t, n, g), c in sums.items()}
    assert {r.type for r in catalog.tfidf_top_per_tag(spark, folder).collect()} == {1, 2, 3}
    assert {r.type for r in catalog.tfidf_top_total(spark, folder).collect()} == {1, 2, 3}
    assert sorted(catalog.ngrams_of_posts(spark, folder).collect()) == sorted((p, g, c) for (p, _, g), c in rows.items())
    assert sorted(r.text for r in catalog.all_ngram_texts(spark, folder).collect()) == sorted(["a", "b", "c", *{g for _, n, g in rows if n > 1}])
    assert sorted(r.text for r in catalog.ngram_names_distinct(spark, folder).collect()) == sorted({g for p, _, g in rows if p != 2})


def test_lsa_keeps_all_posts_terms_and_axes(spark, tmp_path):
    from tagloom.plans import catalog

    posts = 60
    spark.createDataFrame([(k, 1, True) for k in range(posts)], "id long, user_id long, normalized boolean").write.parquet(f"{tmp_path}/post.parquet")
    spark.createDataFrame([(1, "t")], "id long, text string").write.parquet(f"{tmp_path}/tag.parquet")
    spark.createDataFrame([(1, k) for k in range(posts)], "tag_id long, post_id long").write.parquet(f"{tmp_path}/tagtopost.parquet")
    spark.createDataFrame([(k, f"w{k}") for k in range(4 * posts)], "id long, text string").write.parquet(f"{tmp_path}/unigram.parquet")
    spark.createDataFrame([(k, k // 4, 1) for k in range(4 * posts)], "ngram_id long, post_id long, uses_cnt int").write.parquet(f"{tmp_path}/unigramtopost.parquet")
    rows = catalog.lsa_project(spark, str(tmp_path)).collect()
    assert sorted(r.post_id for r in rows) == list(range(posts))
    assert {len(r.features) for r in rows} == {54}  # equal singular values: 0.9 of 60


def test_lsa_equals_the_decomposition(spark):
    import numpy as np
    from pyspark.ml.linalg import SparseVector

    for shape in ((12, 30), (30, 12)):
        x = np.random.default_rng(5).integers(0, 4, shape) * 1.0
        x[3] = x[2]
        rows = spark.createDataFrame([(k, SparseVector(shape[1], list(np.flatnonzero(r)), list(r[r > 0]))) for k, r in enumerate(x)], ["post_id", "features"])
        values = np.linalg.svd(x, compute_uv=False)
        for share in (0.5, 0.9, 1.0):
            got = np.array([r.features.toArray() for r in models.LSA(share).fit(rows).transform(rows).orderBy("post_id").collect()])
            rank = min(int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-9) + 1), int((values > 1e-9).sum()))
            u, s, _ = np.linalg.svd(x, full_matrices=False)
            assert got.shape[1] == rank
            assert np.allclose(got @ got.T, (u[:, :rank] * s[:rank] ** 2) @ u[:, :rank].T)


def test_lsa_solves_nothing_on_the_driver(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    def refused(*_, **__):
        raise AssertionError("solved on the driver")

    rows = spark.createDataFrame([(k, [k % 3 + 1.0, k % 5 + 1.0, 1.0]) for k in range(20)], "post_id long, x array<double>").select("post_id", array_to_vector("x").alias("features"))
    for name in ("eigh", "svd"):
        monkeypatch.setattr(np.linalg, name, refused)
    got = models.LSA(0.9).fit(rows).transform(rows).collect()
    assert sorted(r.post_id for r in got) == list(range(20)) and {r.features.size for r in got} == {2}


def test_lsa_beyond_one_square(spark):
    import numpy as np
    from pyspark.ml.linalg import SparseVector

    for shape, share in (((11, 20), 0.6), ((11, 8), 1.0)):
        x = np.random.default_rng(7).integers(0, 3, shape) * 1.0
        x[3], x[4] = x[2], 0
        rows = spark.createDataFrame([(k, SparseVector(shape[1], list(np.flatnonzero(r)), list(r[r > 0]))) for k, r in enumerate(x)], ["post_id", "features"]).coalesce(1)
        u, values, _ = np.linalg.svd(x, full_matrices=False)
        rank = min(int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-9) + 1), int((values > 1e-6).sum()))
        # stacks of four rows and chunks of four axes
        got = models.LSA(share, wide=5, stack=4 * shape[1]).fit(rows).transform(rows).orderBy("post_id").collect()
        got = np.array([r.features.toArray() for r in got])
        assert got.shape == (shape[0], rank)
        assert np.allclose(got @ got.T, (u[:, :rank] * values[:rank] ** 2) @ u[:, :rank].T)


def test_lsa_keeps_dense_rows_out_of_tables(spark, monkeypatch):
    import os

    import numpy as np
    from pyspark.ml.linalg import SparseVector

    sizes, folders = [], []

    def noted(df, name, made=models.written):
        table = made(df, name)
        sizes.extend(len(v) for r in table.collect() for v in r if isinstance(v, (bytes, bytearray)))
        return table

    monkeypatch.setattr(models, "written", noted)
    monkeypatch.setattr(models, "scratch", lambda spark, name, made=getattr(models, "scratch", None): folders.append(made(spark, name)) or folders[-1], raising=False)
    x = np.random.default_rng(3).integers(0, 2, (9, 12)) * 1.0
    rows = spark.createDataFrame([(k, SparseVector(4096, list(np.flatnonzero(r)), list(r[r > 0]))) for k, r in enumerate(x)], ["post_id", "features"])
    for wide in (5, 100):  # by turns, by one square
        got = models.LSA(1.0, wide, 4 * 4096).fit(rows).transform(rows).orderBy("post_id").collect()
        got = np.array([r.features.toArray() for r in got])
        assert np.allclose(got @ got.T, x @ x.T)
    assert all(n < 8 * 4096 for n in sizes)  # a dense row or an axis has 32,768 bytes
    left = [f for f in folders if os.path.exists(f.removeprefix("file:"))]
    assert len(folders) == 5 and len(left) == 4  # the stacks are gone
    assert all(os.listdir(f.removeprefix("file:")) for f in left)


def test_feeds_hold_whole_posts(spark, tmp_path):
    from tagloom.plans import catalog

    at = datetime(2015, 10, 19, 8, 11, 41)
    posts = [(1, 51, at, "A & <b>", 'x > "y"\r\n]]> &amp; \x01z', 4), (2, 52, None, None, None, None), (3, None, at, "t", "<p>q</p>", 0)]
    spark.createDataFrame(posts, "id long, url long, date timestamp_ntz, title string, text string, comments int").write.parquet(f"{tmp_path}/post.parquet")
    spark.createDataFrame([(7, "Tea & <x>"), (8, "чай")], "id long, text string").write.parquet(f"{tmp_path}/tag.parquet")
    spark.createDataFrame([(8, 1), (7, 1), (7, 1), (8, 3)], "tag_id long, post_id long").write.parquet(f"{tmp_path}/tagtopost.parquet")
    got = {r.id: (r.title, r.description, str(r.published), r.guid, r.tags, r.replies) for r in catalog.rss_parse(spark, str(tmp_path)).selectExpr("* except (published)", "cast(published as string) as published").collect()}
    assert got == {
        1: ("A & <b>", 'x > "y"\r\n]]> &amp; z', str(at), "http://blog.test/51.html", ["tea & <x>", "чай"], 4),
        2: (None, None, "None", "http://blog.test/52.html", [], None),
        3: ("t", "<p>q</p>", str(at), None, ["чай"], 0),
    }
    assert sorted(catalog.guid_extract(spark, str(tmp_path)).collect()) == [(1, 51), (2, 52)]


# ---- lookups, writes, queues, sources, rules


@pytest.fixture
def folder(spark, tmp_path):
    """A small corpus: post 1 with two tags, post 2 not normalized, post 3 without anything, a repeated posting."""
    at = datetime(2015, 5, 1)
    posts = [(1, 11, 1, at, "Red tea", "red tea cup", True, 0, None), (2, 12, 1, at, "x", None, False, 1, 5), (3, 13, 2, at, None, "", True, None, None)]
    rows = {
        "post": (posts, "id long, url long, user_id long, date timestamp_ntz, title string, text string, normalized boolean, comments int, normalizer_id int"),
        "userlj": ([(1, "a_b", 1), (2, "c", None), (3, None, 1)], "id long, nick string, region_id long"),
        "region": ([(1, "EUROPE")], "r_regionkey int, r_name string"),
        "tag": ([(7, "Tea"), (8, "cup"), (None, "lost")], "id long, text string"),
        "tagtopost": ([(7, 1), (7, 1), (8, 1), (7, 2), (None, 1)], "tag_id long, post_id long"),
        "unigram": ([(1, "red"), (2, "tea")], "id long, text string"),
        "unigramtopost": ([(1, 1, "0,2", 2), (1, 1, "0", 1), (2, 1, "1,3", 2), (2, 2, None, None), (9, 1, "1", 1)], "ngram_id long, post_id long, uses_str string, uses_cnt int"),
    }
    for name, (values_, schema) in rows.items():
        spark.createDataFrame(values_, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_lookups_by_list(spark, folder):
    from tagloom.operators import lookups
    from tagloom.operators.corpus import Corpus

    c = Corpus(spark, folder)
    ids = lookups.id_list(spark, [1, 1, 2, 3, 99])
    assert {r.post_id: r.tags for r in lookups.tags_map(c, ids).collect()} == {1: ["Tea", "cup"], 2: ["Tea"], 3: [], 99: []}
    assert sorted(r.text for r in lookups.tags_of_posts(c, ids).collect()) == ["Tea", "cup"]
    assert {r.post_id: r.length for r in lookups.lengths_of(c, ids).collect()} == {1: 10, 3: 0}  # the repeated post twice
    assert lookups.post_lengths(c, [1, 3, 1]) == {1: 5, 3: 0}
    for bad in ([2], [99]):
        with pytest.raises(LookupError):
            lookups.post_lengths(c, bad)
    maps = {r.post_id: [(x.text, x.uses) for x in r.ngrams] for r in lookups.ngrams_map(c, ids, 1).collect()}
    assert maps == {1: [("red", 2), ("red", 2), ("tea", 2), ("tea", 2)], 2: [("tea", None)], 3: [], 99: []}
    assert lookups.ngram_count(c, 99, 3).collect() == [(0,)]
    assert lookups.ngram_count(c, 1, 2).collect() == [(3,)]  # red tea, tea red, tea cup
    assert {r.text for r in lookups.ngram_names(c, ids, 3).collect()} == {"red tea red", "tea red tea", "red tea cup"}
    assert [r.id for r in lookups.normalized_ids_by_tags(c, ["Tea", "nothing"]).collect()] == [1]
    assert sorted(r.url for r in lookups.user_post_urls(c, "a_b").collect()) == [11, 12]
    assert {(r.text, r.uses) for r in lookups.tags_of_nick(c, "a_b").collect()} == {("Tea", 2), ("cup", 1)}
    assert lookups.tags_map(c, ids.limit(0)).count() == 0


def test_inserts(spark, folder):
    from tagloom.operators import writes
    from tagloom.operators.corpus import Corpus

    c = Corpus(spark, folder)
    people = spark.createDataFrame([("a_b", "EUROPE", ["s"]), ("new", "EUROPE", ["s", "t"]), ("new", "MOON", ["u"]), ("odd", "MOON", None)], "nick string, region string, schools array<string>")
    users, schools, links = writes.insert_users(c.users.select("id", "nick"), c.regions, spark.createDataFrame([(4, "s")], "id long, name string"), people)
    assert sorted(users.select("nick", "id", "region_id").collect()) == [("new", 4, 1), ("odd", 5, None)]
    assert schools.collect() == [(5, "t")] and sorted(links.collect()) == [(4, 4), (4, 5)]
    posts = spark.createDataFrame([(1, 11, "t", "x", ["Tea"]), (2, 50, "b", "x", ["Tea", "unknown"]), (2, 50, "c", "y", ["cup"]), (None, 1, "q", "q", ["Tea"])], "user_id long, url long, title string, text string, tags array<string>")
    added, tagged = writes.insert_posts(c.posts.select("id", "user_id", "url"), c.tags, c.tag_posts, posts)
    assert [(r.id, r.user_id, r.url, r.title, r.normalized) for r in added.collect()] == [(4, 2, 50, "b", False)]
    assert tagged.collect() == [(7, 4)]
    seen = spark.createDataFrame([("a_b", "Tea", 9), ("c", "Tea", 3), ("c", "fresh", None), ("nobody", "fresh", 1)], "nick string, text string, uses int")
    tags, bridge = writes.insert_tags(c.tags, c.tag_users, c.users, seen)
    assert tags.collect() == [(9, "fresh")] and sorted(bridge.select("tag_id", "user_id", "uses").collect()) == [(7, 2, 3), (9, 2, None)]
    found = spark.createDataFrame([(3, "red", "0", 1), (3, "cup", "1", 1), (1, "red", "5", 1)], "post_id long, ngram string, uses_str string, uses_cnt int")
    ngrams, postings = writes.insert_ngrams(c.unigrams, c._read("unigramtopost"), found)
    assert ngrams.collect() == [(3, "cup")] and sorted(postings.select("ngram_id", "post_id").collect()) == [(1, 3), (3, 3)]
    assert writes.insert_names(c.regions, c.regions).count() == 0


def test_reservation_is_written_back(spark):
    rows = spark.createDataFrame([(k, None if k % 2 else 3) for k in range(10)], "id long, worker long")
    chosen = queue.reserved(queue.free(rows, ["worker"]), "id", 3)
    after = queue.assigned(rows, chosen, "id", "worker", 8)
    assert after.count() == 10 and after.where("worker = 8").count() == 3 and after.where("worker = 3").count() == 5
    assert queue.reserved_by(after, "worker", 8, F.lit(True)).count() == 3


def test_numbering_of_texts(spark):
    words = sorted({f"w{k * 7919 % 1000}" for k in range(500)})
    got = {r.w: r.row_number for r in queue.numbered(spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").repartition(3), "w").collect()}
    assert got == {w: k for k, w in enumerate(words, 1)}


def test_sources(spark, folder, tmp_path):
    from tagloom.sources import payloads, tables

    answers = [("n", "foaf", 200, "OK", "<x/>"), ("n", "tags", 404, "Not Found", "junk"), ("m", "foaf", 500, None, "junk")]
    spark.createDataFrame(answers, payloads.SCHEMA).write.parquet(f"{tmp_path}/answers")
    assert {(r.nick, r.body) for r in payloads.payloads(spark, f"{tmp_path}/answers", "foaf").collect()} == {("n", "<x/>"), ("m", None)}
    assert one(spark, payloads.request_url("http://a.test/x", q=F.lit("a b&ц"), r=F.lit(None).cast("string"))) == "http://a.test/x?q=a+b%26%D1%86"
    (tmp_path / "stop.txt").write_text("one two\n\nthree\n one ")
    assert text.stop_words(spark, f"{tmp_path}/stop.txt") == ["one", "three", "two"]
    spark.sql("CREATE DATABASE IF NOT EXISTS model LOCATION '%s'" % (tmp_path / "db"))
    names = tables.create_tables(spark, "model")
    assert all(tables.has_table(spark, n) for n in names) and not tables.has_table(spark, "model.nothing")
    assert tables.create_tables(spark, "model") == names and spark.table("model.post").count() == 0
    spark.sql("DROP DATABASE model CASCADE")
    for name in ("mastertag", "tfidfsimple"):
        spark.createDataFrame([], tables.SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    tables.register_views(spark, folder)
    assert sorted(spark.table("post_length").collect()) == [(1, 5), (3, 0)]
    assert sorted(spark.table("tag_name_to_post").collect()) == [("Tea", 1), ("Tea", 2), ("cup", 1)]
    for name in [*tables.SCHEMAS, *tables.VIEWS]:
        spark.catalog.dropTempView(name)


def test_week_matrix_as_text(spark, tmp_path):
    rows = spark.createDataFrame([(date(2014, 12, 31), "Tea", 2), (date(2015, 1, 7), "cup", 1)], "week date, text string, count long")
    popularity.write_matrix(popularity.week_matrix(rows, date(2015, 12, 31)), f"{tmp_path}/tsv")
    lines = next(p for p in (tmp_path / "tsv").iterdir() if p.suffix == ".csv").read_text().splitlines()
    assert lines[0] == "week\tTea\tcup" and lines[1].endswith("\t2\t0") and lines[2].endswith("\t0\t1") and len(lines) == 54


def test_rules_and_hooks(spark):
    from tagloom.functions import rules

    df = spark.createDataFrame([(1, "Красный чай пить быстро красный чай"), (2, "чай"), (3, None)], "id long, s string")
    got = {(r.post_id, r.ngram): r.uses_str for r in rules.rule_postings(df, "id", F.col("s"), 2, stop=[]).collect()}
    assert got == {(1, "чай красный"): "0,1", (1, "пить быстро"): "2"}
    lemma = lambda w: F.regexp_replace(w, "ный$", "")
    assert {r.ngram for r in text.postings(df, "id", F.col("s"), 1, [], lemma).collect()} == {"крас", "чай", "пить", "быстро"}
    verbs = rules.rule_postings(df, "id", F.col("s"), 9, stop=[], grammars={9: [rules.single("V"), rules.single("D")]})
    assert sorted((r.ngram, r.uses_str) for r in verbs.collect()) == [("быстро", "1"), ("пить", "0")]


def test_learner_wrapper(spark):
    with pytest.raises(models.LearnerError):
        models.Built(models.naive_bayes).judged(None)
    with pytest.raises(models.LearnerError):
        models.Built(models.naive_bayes).build(spark.range(2))


def test_evaluation(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (None, 1)], "t int, p int")
    s = evaluate.summary(rows, "t", "p").first()
    assert (s.judged, s.right, s.wrong, s.accuracy) == (5, 3, 2, 0.6)
    assert {r.label: (r.rows, r.precision, r.recall) for r in evaluate.class_details(rows, "t", "p").collect()} == {0: (2, 1.0, 0.5), 1: (2, 0.5, 1.0), 2: (1, None, 0.0)}
    assert evaluate.summary(rows.limit(0), "t", "p").first().judged == 0


def test_pages(spark):
    lit = F.lit
    page = '<ul><li><a href="/u/tag/1" class="c7">Tea</a> 12</li><li><a href="/u/tag/2" title="3 of 1234567">Cup</a></li><li><a href="/x">no</a><li><a href="/u/tag/3">many</a> 1234567</ul>'
    got = one(spark, parse.tag_anchors(lit(page), lit("/tag/"), lit("/u/tag/")))
    assert [tuple(x) for x in got] == [("tea", 12), ("cup", 3), ("many", None)]
    assert one(spark, parse.tag_anchors(lit(None).cast("string"), lit("/tag/"), lit(""))) == []
    table = "<table><tr><td>NGrams</td></tr><tr><td>head</td></tr><tr><td>a</td><td> b</td></tr></table><table><tr><td>x</td></tr><tr></tr><tr><td>y</td></tr></table>"
    assert one(spark, parse.fact_rows(lit(table))) == ["a b"]
    foaf = '<r xmlns:f="u:f" xmlns:y="u:y"><f:Person><f:nick>n</f:nick><y:country title="RU"/><y:comments><y:posted>4</y:posted><y:received>x</y:received></y:comments><y:school title="S" dateStart="1999"/></f:Person></r>'
    p = one(spark, parse.foaf_person(lit(foaf)))
    assert (p.nick, p.region, p.posted, p.received, [tuple(s) for s in p.schools]) == ("n", "RU", 4, None, [("S", "1999", None)])
    items = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None)], "id long, url long")
    assert {(r.url, r.id) for r in parse.unknown_items(items, spark.createDataFrame([(6,)], "url long"), "url", "id").collect()} == {(5, 1)}


def _kept_rows(spark, query, folder):
    """The query's rows, and how many rows it wrote down on its way."""
    from pathlib import Path

    from tagloom.session import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("tagloom-*"))
    rows = query(spark, folder).collect()
    return rows, sum(spark.read.parquet(str(p)).count() for p in set(shared.glob("tagloom-*")) - before)


def _same_as_sql(rows, name, folder):
    import duckdb
    import __spark_entry__ as entry

    with duckdb.connect() as sql:
        for t in ("post", "unigram", "unigramtopost", "tagtopost"):
            sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        wanted = sql.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, rows), key=repr) == sorted(wanted, key=repr)


def _tagged_tables(spark, folder, posts, unigrams, postings, tagged):
    for name, rows, shape in (
        ("post", posts, "id long, title string, text string, normalized boolean"),
        ("unigram", unigrams, "id long, text string"),
        ("unigramtopost", postings, "ngram_id long, post_id long, uses_cnt int"),
        ("tagtopost", tagged, "tag_id long, post_id long"),
    ):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def _odd_tables(spark, folder):
    """Repeated, null and missing keys, equal and null texts, uses that are null, negative or sum to 0."""
    posts = [(1, "A b", "c a, b C", True), (1, "b c", "a", True), (2, None, "a b", False), (3, "a", "b c", True), (4, None, None, True), (None, "x", "y z", True), (5, "Ёж É", "ёж é ёж É", True)]
    unigrams = [(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "a"), (6, "a b"), (3, "c2"), (None, "q")]
    postings = [(1, 1, 2), (2, 1, 2), (3, 1, 2), (1, 2, 1), (3, 3, 1), (4, 1, 7), (5, 1, 3), (6, 1, None), (6, 1, 4), (6, 2, None), (1, 9, 5), (1, 8, -5), (2, 8, 5), (None, 1, 2), (1, None, 2)]
    tagged = [(7, 1), (7, 1), (7, 2), (8, 2), (8, 3), (9, 3), (10, 4), (11, 9), (12, 8), (None, 1), (7, None), (13, 5), (14, 77)]
    _tagged_tables(spark, folder, posts, unigrams, postings, tagged)


def _wide_tables(spark, folder):
    """40 tags of 100 words each, 7,960 n-grams of tags."""
    word = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    posts = [(p, None, " ".join(word(100 * p + k) for k in range(100)), True) for p in range(40)]
    _tagged_tables(spark, folder, posts, [(1, "a")], [(1, p, 2) for p in range(40)], [(p % 40, p) for p in range(40)])


def test_tfidf_simple_keeps_no_row_for_each_ngram_of_a_tag(spark, tmp_path):
    from tagloom.plans import catalog

    for name, tables in (("odd", _odd_tables), ("wide", _wide_tables)):
        folder = str(tmp_path / name)
        tables(spark, folder)
        rows, kept = _kept_rows(spark, catalog.tfidf_simple, folder)
        _same_as_sql(rows, "tfidf_simple", folder)
        assert kept < len(rows) / 2


def test_tfidf_top_total_keeps_only_what_a_tag_can_give(spark, tmp_path, monkeypatch):
    from tagloom.operators import tagged
    from tagloom.plans import catalog

    monkeypatch.setattr(tagged, "LEAST_RANGES", 1)
    for name, tables in (("odd", _odd_tables), ("wide", _wide_tables)):
        folder = str(tmp_path / name)
        tables(spark, folder)
        rows, kept = _kept_rows(spark, catalog.tfidf_top_total, folder)
        _same_as_sql(rows, "tfidf_top_total", folder)
    assert kept < 7960 / 2


def test_tfidf_top_per_tag_keeps_only_the_first_of_each_tag(spark, tmp_path):
    from tagloom.plans import catalog

    for name, tables in (("odd", _odd_tables), ("wide", _wide_tables)):
        folder = str(tmp_path / name)
        tables(spark, folder)
        rows, kept = _kept_rows(spark, catalog.tfidf_top_per_tag, folder)
        _same_as_sql(rows, "tfidf_top_per_tag", folder)
    assert kept < 7960 / 2
