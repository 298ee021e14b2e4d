"""Operators against brute force on small and awkward rows."""

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tagloom.llm import canonical, components, cooccur, frequency, mixing, neardup, packing, spans, tokens, topn

CLASH = {"key": 1, "block": 2, "g": 3, "s": 4, "n": 5, "item": 6, "tokens": 7, "leader": 8}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns})


# ---- shared spans


def brute_spans(rows, length):
    texts = {k: re.findall(r"[^ \t\n\r]+", t or "") for k, t in rows}
    where = defaultdict(set)
    for k, w in texts.items():
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].add(k)
    out = []
    for k, w in texts.items():
        covered = {j for i in range(len(w) - length + 1) if len(where[tuple(w[i : i + length])]) > 1 for j in range(i, i + length)}
        for j in sorted(covered):
            if j - 1 not in covered:
                end = j
                while end + 1 in covered:
                    end += 1
                out.append((k, j, end))
    return sorted(out)


@pytest.mark.parametrize("length", [1, 3, 4])
def test_spans(spark, length):
    rng = random.Random(length)
    words = ["а", "b", "c", "d", "é", "f" * 300]
    rows = [(k, rng.choice([" ", "\n", "\t ", "  "]).join(rng.choices(words, k=rng.randrange(0, 14)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "x y z x y z x y z"), (103, "q r s t u")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(spans.shared_spans(df, length).collect()) == brute_spans(rows, length)


def test_spans_repeated_ids_and_empty(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "x y z"), (2, "x a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(spans.shared_spans(df, 3).collect()) == [(1, 0, 2), (2, 1, 3)]
    assert spans.shared_spans(df.limit(0), 3).count() == 0
    share = {r.doc_id: (r.words, r.shared_words, r.share) for r in spans.shared_shares(df, 3).collect()}
    assert share == {1: (3, 3, 1.0), 2: (4, 3, 0.75)}


def test_shares_of_every_document(spark, tmp_path):
    from tagloom.llm import queries

    whole = " ".join(f"w{i}" for i in range(40))
    docs = [(1, whole), (2, f"a {whole}\n\tb "), (3, " a\u00a0b  c\n"), (4, None), (5, " \t"), (6, " ".join("xyz" * 20)), (6, "x"), (None, whole)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.words, r.shared_words, r.spans, r.share) for r in queries.p9_shared_share(spark, str(tmp_path)).collect()}
    assert got == {1: (40, 40, 1, 1.0), 2: (42, 40, 1, 40 / 42), 3: (2, 0, 0, 0.0), 4: (0, 0, 0, 0.0), 5: (0, 0, 0, 0.0), 6: (60, 0, 0, 0.0)}


def test_spans_hot_copies(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat(F.lit("u"), "id")).alias("text"))
    got = spans.shared_spans(df, 40)
    assert got.count() == 1000 and got.select("first_word", "last_word").distinct().collect() == [(0, 49)]


# ---- near duplicates


def brute_pairs(rows):
    sets = {}
    for k, title, text in rows:
        words = re.findall(r"[^\W_]+", f"{title or ''} {text or ''}".lower())
        if len(words) >= 12:
            sets[k] = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if 3 * len(sets[a] & sets[b]) >= len(sets[a]) + len(sets[b]))


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        how = rng.randrange(3)
        if how == 0:
            words[at] = f"n{rng.randrange(99)}"
        elif how == 1:
            words.insert(at, f"n{rng.randrange(99)}")
        elif len(words) > 13:
            del words[at]
    return words


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([12, 14, 20, 40, 90, 300]))]
        for times in (0, 0, 1, 1, 2, 4, 8, 12):
            words = edited(rng, base, times)
            rows.append((k, rng.choice([None, "", "Title"]), "  ".join(words).upper() if k % 2 else ", ".join(words)))
            k += 1
    rows += [(1000, None, None), (1001, "", ""), (1002, "a b", "c")]
    df = clashing(spark.createDataFrame(rows, "id long, title string, text string").repartition(4))
    assert sorted(neardup.similar_pairs(df).collect()) == brute_pairs(rows)


def test_near_duplicates_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_CHUNK", 8)
    monkeypatch.setattr(neardup, "FAMILY_CHUNK", 4)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(40)]
    rows = [(k, "t", " ".join(edited(rng, base, k % 6))) for k in range(60)] + [(100 + k, "t", f"{k} " + " ".join(f"v{k}x{i}" for i in range(20))) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, title string, text string")
    assert sorted(neardup.similar_pairs(df).collect()) == brute_pairs(rows)
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_near_duplicate_groups(spark):
    rng = random.Random(8)
    rows, k = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(30)]
        for times in (0, 0, 0, 1, 3, 5, 9):
            rows.append((k, None, " ".join(edited(rng, base, times))))
            k += 1
    rows += [(1000, "a b", "c"), (1001, "a b", "c"), (1002, None, None), (None, "x", "y " * 20)]
    pairs = brute_pairs([r for r in rows if r[0] is not None])
    root = {r[0]: r[0] for r in rows if r[0] is not None}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.post: r for r in neardup.similar_groups(clashing(spark.createDataFrame(rows, "id long, title string, text string"))).collect()}
    assert {k: r.group_id for k, r in got.items()} == root
    texts = {k: t for k, _, t in rows}
    for k, r in got.items():
        assert r.links == len({texts[b if a == k else a] for a, b in pairs if k in (a, b)} - {texts[k]})
    assert neardup.similar_groups(spark.createDataFrame([], "id long, title string, text string")).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (7, 7), (None, 3), (100, 101)]
    got = dict(components.components(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect())
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_rare_sequences_are_never_copied_however_many_there_are():
    """A small sketch under 1,000 times more sequences than it has counters: a hot one is cut, a rare one isn't."""
    import numpy as np

    bits = 12
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 1000 << bits, dtype=np.int64).view(np.uint64)
    hot = np.full(200_000, h[0])
    total = np.zeros(1 << bits, np.int64)
    for part in (h, hot):
        for places in neardup._places(part, bits):
            total += np.bincount(places, minlength=1 << bits)
    cut = len(total) // neardup.SKETCH_PARTS
    levels = np.concatenate([neardup._counted(total[k * cut : (k + 1) * cut]) for k in range(neardup.SKETCH_PARTS)])
    chunks = neardup._chunks(neardup._levels_of(h, levels, bits))
    assert chunks[0] >= 200_000 / neardup.LIST_CHUNK / 1.2
    assert (chunks[1:] > 1).mean() < 1e-5


# ---- top N


def test_top_n(spark):
    rng = random.Random(1)
    scores = [None, float("nan"), -1.5, 0.0, -0.0, 1e-300, 1e300, 2.0, 2.0, 2.0000000000000004, -1e300]
    rows = [(g, rng.randrange(1, 4), rng.randrange(-40, 2**40 if g == 2 else 40), rng.choice(scores)) for g in (1, 2, 3, None) for _ in range(300)]
    rows += [(4, 1, 1, 1.0), (4, 1, 1, 3.0), (5, None, 1, 1.0)]
    df = clashing(spark.createDataFrame(rows, "tag long, type int, id long, score double"))
    best = {}
    for g, t, i, s in rows:
        if None not in (g, t, i, s) and s == s:
            best[g, t, i] = max(best.get((g, t, i), s), s)
    for n in (1, 10, 10_000):
        want = set()
        for g in {k[0] for k in best}:
            want |= set(sorted((k for k in best if k[0] == g), key=lambda k: (-best[k], k[1], k[2]))[:n])
        got = [(r.tag, r.type, r.id) for r in topn.top_n_per_group(df, "tag", "score", ["type", "id"], n).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert topn.top_n_per_group(df.limit(0), "tag", "score", ["type", "id"], 3).count() == 0


# ---- frequency


def test_frequency(spark):
    terms = spark.createDataFrame([(1, " Tea\n"), (2, "tea"), (3, "rare"), (4, None), (None, "x"), (5, "")], "id long, text string")
    rows = [(1, 64, 2), (1, 64, 5), (1, 65, None), (2, 64, 1), (2, -1, 3), (None, 9, 1), (3, None, 1), (99, 70, 1)]
    postings = spark.createDataFrame(rows, "ngram_id long, post_id long, uses int")
    got = {r.term: (r.uses, r.records) for r in frequency.term_frequency(terms, "id", "text", postings, "ngram_id", "post_id", "uses").collect()}
    assert got == {"tea": (9, 3), "rare": (0, 0), "": (0, 0)}
    total = frequency.record_count(postings, None, "post_id")
    assert total.first().all_records == 5
    freq = frequency.term_frequency(terms, "id", "text", postings, "ngram_id", "post_id")
    marks = sorted(frequency.marked_terms(freq, total, 5, 10).collect())
    assert marks == [("", "rare"), ("rare", "rare"), ("tea", "common"), ("tea", "rare")]
    assert frequency.term_frequency(terms, "id", "text", postings.limit(0), "ngram_id", "post_id").where("records > 0").count() == 0


# ---- items that appear together


@pytest.mark.parametrize("chunk", [2, 5, 256])
def test_pairs(spark, chunk):
    rng = random.Random(2)
    rows = [(rng.randrange(12), p) for p in range(30) for _ in range(rng.randrange(8))] + [(k, 99) for k in range(12)] * 2 + [(None, 1), (1, None)]
    df = clashing(spark.createDataFrame(rows, "tag long, post long"))
    base = {r for r in rows if None not in r}
    posts = defaultdict(set)
    for t, p in base:
        posts[t].add(p)
    want = {(a, b, len(posts[a] & posts[b]), len(posts[a]), len(posts[b])) for a, b in combinations(sorted(posts), 2) if len(posts[a] & posts[b]) >= 2}
    got = cooccur.pair_counts(df, "tag", "post", least=2, chunk=chunk)
    assert {tuple(r)[:5] for r in got.collect()} == want
    assert {r.n for r in got.collect()} == {len({p for _, p in base})}
    assert cooccur.pair_counts(df.limit(0), "tag", "post").count() == 0


# ---- canonical list


def meant(spark, texts, names):
    """The entry each text means; of ``names`` the place in the list is the identifier."""
    reference = spark.createDataFrame([("f", k, n) for k, n in names], "field string, ref_id long, name string")
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "field string, src_id long, text string")
    found = {r.src_id: r.ref_id for r in canonical.mapped(rows, reference).collect()}
    assert len(found) == len(texts)
    return [found[k] for k in range(len(texts))]


def test_canonical(spark):
    names = [(1, "котёнок и будка"), (2, "wooden lantern"), (3, "marathon"), (4, "East Vinestadt"), (5, None), (None, "x"), (6, "кэш"), (7, "variable"), (8, "polite variable")]
    texts = {
        "wooden lantern": 2, "WOODEN-LANTERN!": 2, "lantern wooden": 2, "woodenlantern": 2, "wodoen lantren": 2, "wооden lаntern": 2, "my wodoen lantren": 2,
        "kotenok i budka": 1, "rjn`yjr b ,elrf": 1, "будка и котёнок": 1, "marahton": 3, "mrathn": 3, "east vinestadt": 4,
        "something else": 0, "42": 0, "": 0, " ": 0, "x" * 5000: 0, "varialbe plite": 8, "variable": 7, "plite variable": 8,
        "my wooden lantern": 2, "my marathon": 3, "my variable": 7, "ym variable": 7, "my east vinestadt": 4, "my my marathon": 3, "my something": 0,
    }
    assert meant(spark, list(texts), names) == list(texts.values())
    assert meant(spark, ["a", "b"], []) == [0, 0]
    none = spark.createDataFrame([], "field string, src_id long, text string")
    assert canonical.mapped(none, none.select("field", F.col("src_id").alias("ref_id"), F.col("text").alias("name"))).count() == 0


def test_added_words_need_no_list(spark):
    names = ["Varnholm", "Усть-Тарвино", "Lakeminster", "Белозарск", "Port Quillan", "Нижний Гостев", "Drumvale", "Кривогорье", "Osterwick", "Малая Сельга", "Tannbrook", "Синеборье"]
    forms = ["greater {}", "{} suburbs", "{} region", "окрестности {}", "near {}", "под {}", "{}, the far side"]
    texts = [(f.format(n), k) for f in forms for k, n in enumerate(names, 1)] + [(f.format(n), 0) for f in forms for n in ("Zylkoma", "Пенадуро", "moon base")]
    texts += [("greatr Varnholm suburbs", 1), ("Osterwick regoin", 9), ("lovely Drumvale", 0)]  # one text's word is no filler
    got = meant(spark, [t for t, _ in texts], list(enumerate(names, 1)))
    right = [g == k for g, (_, k) in zip(got, texts, strict=True)]
    assert all(right), [t for t, ok in zip(texts, right, strict=True) if not ok]


def test_pigeonhole_finds_every_neighbour(spark):
    rng = random.Random(3)
    letters = "abcdef"
    entries = ["".join(rng.choices(letters, k=n)) for n in range(3, 20) for _ in range(2)]
    texts = sorted({"".join(edited_letters(rng, e, rng.randrange(6), letters)) for e in entries for _ in range(8)} - {""})
    keys = spark.createDataFrame([("f", k, e) for k, e in enumerate(entries)], "field string, ref_id long, key string")
    rows = spark.createDataFrame([("f", t, t) for t in texts], "field string, text string, key string")
    near = canonical._near(rows, canonical._segments(keys), True)
    every = rows.drop("field").crossJoin(keys.withColumnRenamed("key", "entry")).withColumn("k", canonical._edits(F.length("entry"))).where("levenshtein(key, entry) <= k")
    assert near.select("text", "ref_id").exceptAll(every.select("text", "ref_id")).count() == 0
    assert every.select("text", "ref_id").exceptAll(near.select("text", "ref_id")).count() == 0


def edited_letters(rng, word, times, letters):
    word = list(word)
    for _ in range(times):
        at = rng.randrange(len(word) + 1)
        if rng.random() < 0.4:
            word.insert(at, rng.choice(letters))
        elif word and at < len(word):
            if rng.random() < 0.5:
                del word[at]
            else:
                word[at] = rng.choice(letters)
    return word


# ---- tokens, containers, mixture

TEXTS = ["", " ", "Hello  world\n\n it's  'quoted' ", "Привет, мир\t\tещё", "a b c", "x\x1cy \x85 z", "1234 5678abc!!", "é" * 40, "w" * 3000, "a b " * 900, "\n", "  leading", "trailing   "]


def test_token_counts_are_exact():
    encoding, counter = tokens.encoding(tokens.VOCABULARY), tokens.TokenCounter()
    for text in TEXTS + [a + b for a in TEXTS for b in TEXTS[:8]]:
        assert counter.count(text) == len(encoding.encode_ordinary(text)), repr(text)
    assert counter.count(None) == 0


def test_containers_of_bounded_cost(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["tea"] * rng.choice([3, 10, 20, 60, 90]))) for k in range(120)]
    got = packing.packed_containers(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64, most_items=8, most_cost=500).collect()
    counter, sizes, boxes = tokens.TokenCounter(), defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.doc_id] += r.tokens
        boxes[r.container].append(r.tokens)
    assert sizes == {k: counter.count(t) for k, t in rows}
    assert all(len(b) == 1 or sum(x * x for x in b) <= 500 for b in boxes.values())
    assert any(len(b) == 1 and b[0] ** 2 > 500 for b in boxes.values()) and any(len(b) > 1 for b in boxes.values())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_containers(spark, rule):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["tea", "чай", "cup"], k=rng.choice([0, 1, 5, 30, 60, 400])))) for k in range(200)] + [(7, "tea " * 30), (None, "tea"), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("container", F.lit(1)).withColumn("shard", F.lit(1))
    got = packing.packed_containers(df, capacity=64, most_items=8, rule=rule).collect()
    counter = tokens.TokenCounter()
    sizes, boxes = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.doc_id] += r.tokens
        boxes[r.container].append(r)
    want = defaultdict(int)
    for k, t in rows:
        if k is not None and counter.count(t):
            want[k] += counter.count(t)
    assert sizes == want
    for members in boxes.values():
        total = sum(r.tokens for r in members)
        assert total <= 64 and len(members) <= 8 and sum(r.tokens**2 for r in members) <= 64**2
        assert all(r.items == len(members) and abs(r.fill - total / 64) < 1e-9 for r in members)
    short = {r.doc_id for r in got if r.piece > 0}
    assert all(max(counter.count(t) for i, t in rows if i == k) > 64 for k in short)
    report = packing.packing_report(packing.packed_containers(df.where("length(text) > 100"), capacity=64), 64).first()
    assert report.used_share > 0.8
    assert packing.packed_containers(df.limit(0)).count() == 0


def test_every_capacity_binds(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["tea"] * rng.choice([1, 2, 3, 20, 33, 40, 61]))) for k in range(300)]
    limits = {"capacity": 64, "most_items": 8, "most_cost": 2000}
    got = packing.packed_containers(spark.createDataFrame(rows, "doc_id long, text string"), **limits)
    boxes = defaultdict(list)
    for r in got.collect():
        boxes[r.container].append(r.tokens)
    assert all(sum(b) <= 64 and len(b) <= 8 and (len(b) == 1 or sum(x * x for x in b) <= 2000) for b in boxes.values())
    bound = {r.capacity: (r.containers, r.full) for r in packing.binding_limits(got, **limits).collect()}
    assert all(containers > 0 and full > 0 for containers, full in bound.values()) and len(bound) == 3


def test_network_is_optimal():
    sizes = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    total, flow = mixing.routed(sizes, {"a": 100, "b": 60}, {"a": 1, "b": 2})
    assert total == 160 and flow == {(("a",), "a"): 100, (("a", "b"), "b"): 50, (("b",), "b"): 10}  # nothing is repeated
    assert mixing.routed(sizes, {"b": 500}, {"a": 1, "b": 2})[0] == 120
    quotas, _ = mixing.planned({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, 1000)
    assert quotas == {"a": 30, "b": 30}


def test_mixture(spark):
    rows = [(k, "tea " * 9 + str(k), "a") for k in range(300)] + [(1000 + k, "cup " * 9 + str(k), "b") for k in range(40)]
    rows += [(2000 + k, "both " * 9 + str(k), s) for k in range(40) for s in "ab"] + [(3000, None, "a"), (3001, "x", None), (3002, "y", "unlisted"), (None, "z", "a")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
    mix = mixing.mixture(docs, targets)
    report = {r.source: r for r in mixing.mixture_shares(mix, targets.where("source is not null")).collect()}
    assert abs(report["a"].actual_share - 5 / 9) < 0.02 and abs(report["b"].actual_share - 4 / 9) < 0.02 and report["gone"].tokens == 0
    assert report["a"].most_uses == 1 and report["b"].most_uses <= 3
    assert sorted(mix.collect()) == sorted(mixing.mixture(docs.repartition(5), targets).collect())
    assert mixing.mixture(docs.limit(0), targets).count() == 0


def test_nearest_subset():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.choice([-1, 1]) * rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        want = rng.randrange(-60, 60)
        chosen = mixing.nearest_subset(items, want)
        best = min(abs(want - sum(s)) for n in range(len(items) + 1) for s in combinations(items, n))
        assert abs(want - sum(items[k] for k in chosen)) == best


def test_mixture_of_long_tailed_texts(spark):
    """Texts of up to a third of a source's tokens: every source comes within one in a thousand of its scaled share."""
    rng = random.Random(3)
    rows, k = [], 0
    for source in "abcd":
        for size in [2000, 1500, 700] + [int(min(400, rng.paretovariate(0.8))) for _ in range(150)]:
            rows.append((k, f"{source}{k} " + "tea " * size, source))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("d", 0.1, 3)], "source string, target_share double, max_repeat int")
    mix = mixing.mixture(docs, targets)
    for r in mixing.mixture_shares(mix, targets).collect():
        assert abs(r.actual_share - r.target_share) <= 0.001 * r.target_share and r.most_uses <= r.max_repeat


def test_mixture_of_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    rows = [(k, f"tea cup {k // 3}", "abc"[(k + k // 9) % 3]) for k in range(90)]
    targets = spark.createDataFrame([(s, 1 / 3, 2) for s in "abc"], "source string, target_share double, max_repeat int")
    mix = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), targets)
    assert {r.source for r in mix.collect()} == set("abc")


def test_mixture_tells_rare_patterns_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    rows = [(k, f"tea cup {k}", s) for k in range(40) for s in ("ab" if k < 20 else "b" if k < 35 else "ac")]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeat int")
    mix = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), targets)
    used = {r.source: r.tokens for r in mixing.mixture_shares(mix, targets).collect()}
    assert used["c"] > 0 and abs(used["c"] / sum(used.values()) - 0.1) < 0.03
