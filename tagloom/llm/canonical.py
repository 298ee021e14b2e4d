"""Problem 2: mapping free-entered values to a canonical list, by a partition-based pigeonhole join. Built-in SQL only.

A typed text and a reference entry are compared as keys: lower case, look-alike letters of the other alphabet set right, no
blanks or punctuation. A text also has a key as typed under the other keyboard layout; an entry also has one in reverse word
order and, if Cyrillic, its transliterations. Two keys within k edits share one of k + 1 segments of the entry's key, at a
position the edits can reach; such candidates are verified with levenshtein.

Words that people add to a value ("old town", "my", "region") are learned from the texts, by no list: a phrase at the end of
texts that mean no entry as a whole, whose rest is an entry's key, is a filler if it stands beside many different entries.
Texts then also have keys without fillers at their ends, whose phrases may have edits themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import written

# fixed values: letters that look alike, keys of the two layouts, transliteration
LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES = "aeopcxykmthbi", "аеорсхукмтнві"
LATIN_KEYS = "`qwertyuiop[]asdfghjkl;'zxcvbnm,."
CYRILLIC_KEYS = "ёйцукенгшщзхъфывапролджэячсмитьбю"
TRANSLITERATION = {
    "щ": "sch", "ш": "sh", "ч": "ch", "ж": "zh", "ц": "ts", "ю": "yu", "я": "ya", "ё": "e", "х": "h",
}
SINGLE_FROM, SINGLE_TO = "абвгдезийклмнопрстуфыэъь", "abvgdeziyklmnoprstufye"
#: Edits allowed by the length of an entry's key: one more for every three letters from the fourth on, at most four.
MOST_EDITS = 4
#: A filler stands beside so many different entries at least, and beside one in so many of the most frequent filler's.
LEAST_ENTRIES, OF_MOST = 3, 20
#: Words of a filler phrase; phrases that may be cut off at the two ends of a text together.
PHRASE_WORDS, CUTS = 3, 2
#: Entries up to which the reference's segments may be broadcast; a longer list is joined by shuffle.
BROADCAST_ENTRIES = 20_000


def _words(text: Column) -> Column:
    """Words of letters and digits, look-alikes set right by the majority of each word's letters."""
    bare = F.regexp_replace(F.lower(text), r"[\p{Cf}\p{Mn}]", "")
    parts = F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def right(w: Column) -> Column:
        cyrillic, latin = (F.length(F.regexp_replace(w, f"[^{a}]", "")) for a in ("а-яёі", "a-z"))
        return (
            F.when((cyrillic > 0) & (latin > 0) & (cyrillic >= latin), F.translate(w, LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES))
            .when((cyrillic > 0) & (latin > 0), F.translate(w, CYRILLIC_LOOKALIKES, LATIN_LOOKALIKES))
            .otherwise(w)
        )

    return F.transform(parts, right)


def _spread(rows: DataFrame) -> DataFrame:
    """Over all cores: the rows are few bytes, so that they would end up in one task, but much is made of each."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "field", "text")


def _key(words: Column) -> Column:
    return F.array_join(words, "")


def _latin(key: Column) -> Column:
    out = key
    for a, b in TRANSLITERATION.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, SINGLE_FROM, SINGLE_TO)


def typed_words(texts: DataFrame) -> DataFrame:
    """``field, text, words`` of every distinct text, as typed and as typed under the other keyboard layout."""
    rows = _spread(texts.select("field", "text").distinct())
    raw = F.regexp_replace(F.lower(F.col("text")), r"[\p{Cf}]", "")
    latin, cyrillic = raw.rlike("[a-z]"), raw.rlike("[а-яё]")
    swapped = F.when(latin & ~cyrillic, F.translate(raw, LATIN_KEYS, CYRILLIC_KEYS)).when(cyrillic & ~latin, F.translate(raw, CYRILLIC_KEYS, LATIN_KEYS))
    rows = rows.select("field", "text", F.explode(F.filter(F.array("text", swapped), lambda t: t.isNotNull())).alias("typed"))
    return rows.select("field", "text", _words(F.col("typed")).alias("words")).where(F.size("words") > 0)


def entry_keys(reference: DataFrame) -> DataFrame:
    """``field, ref_id, key`` of every entry: in both word orders, and transliterated where it is Cyrillic."""
    rows = reference.select("field", "ref_id", _words(F.col("name")).alias("words")).where(F.size("words") > 0)
    rows = rows.select("field", "ref_id", F.explode(F.array_distinct(F.array(_key(F.col("words")), _key(F.reverse("words"))))).alias("key"))
    latin = rows.select("field", "ref_id", _latin(F.col("key")).alias("key"))
    return rows.unionByName(latin).distinct()


def _edits(length: Column) -> Column:
    return F.least(F.lit(MOST_EDITS), F.greatest(F.lit(0), F.floor((length - 1) / 3).cast("int")))


def _filler_edits(length: Column) -> Column:
    return F.when(length < 3, 0).when(length < 5, 1).when(length < 9, 2).otherwise(3)


def _segments(keys: DataFrame, edits=_edits) -> DataFrame:
    """``field, ref_id, key, size, k, i, start, piece``: the k + 1 even segments of every entry's key (start from 1)."""
    sized = keys.withColumn("size", F.length("key")).withColumn("k", edits(F.col("size")))
    cut = sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    begin = lambda i: f"cast(div(({i}) * size, k + 1) as int)"
    return cut.select("field", "ref_id", "key", "size", "k", "i", F.expr(f"{begin('i')} + 1").alias("start"), F.expr(f"substring(key, {begin('i')} + 1, {begin('i + 1')} - {begin('i')})").alias("piece"))


def _near(texts: DataFrame, segments: DataFrame, small: bool) -> DataFrame:
    """``field, text, ref_id, edits, size``: the entries (of length ``size``) within their edits of a text's ``key``."""
    bound = F.broadcast if small else (lambda x: x)
    shapes = segments.select("field", "size", "k", "i", "start", F.length("piece").alias("width")).distinct()
    longest = segments.agg(F.max("size")).first()[0] or 0
    rows = texts.withColumn("long", F.length("key")).where(F.col("long") <= longest + MOST_EDITS)  # longer ones are near none
    rows = rows.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(1), F.col("long") - MOST_EDITS), F.col("long") + MOST_EDITS)))
    rows = rows.join(F.broadcast(shapes), ["field", "size"]).where("abs(long - size) <= k")  # at most a row per length and segment
    # where segment i can start: i edits may lie before it and k - i after it, on either text
    low = "greatest(1, start - i, start + (long - size) - (k - i))"
    high = "least(long - width + 1, start + i, start + (long - size) + (k - i))"
    rows = rows.where(f"{low} <= {high}").select("field", "text", "key", "size", "i", "width", F.explode(F.expr(f"sequence({low}, {high})")).alias("at"))
    rows = rows.select("field", "text", "key", "size", "i", F.expr("substring(key, at, width)").alias("piece"))
    pieces = segments.select("field", "ref_id", F.col("key").alias("entry"), "size", "k", "i", "piece")
    met = rows.join(bound(pieces), ["field", "size", "i", "piece"]).select("field", "text", "key", "ref_id", "entry", "size", "k").distinct()
    return met.withColumn("edits", F.levenshtein("key", "entry", MOST_EDITS)).where("edits between 0 and k").select("field", "text", "ref_id", "edits", "size")


def _cuts(rows: DataFrame) -> DataFrame:
    """``field, text, phrase, rest``: the word lists without one to three words at either end, and these words."""
    words, out = F.col("words"), []
    for k in range(1, PHRASE_WORDS + 1):
        rest = F.greatest(F.size(words) - k, F.lit(0))
        ends = (F.slice(words, F.lit(1), F.lit(k)), F.slice(words, F.lit(k + 1), rest)), (F.slice(words, rest + 1, F.lit(k)), F.slice(words, F.lit(1), rest))
        out += [F.when(F.size(words) > k, F.struct(F.array_join(end, " ").alias("phrase"), left.alias("rest"))) for end, left in ends]
    return rows.select("field", "text", F.explode(F.array(*out)).alias("cut")).where("cut is not null").select("field", "text", "cut.phrase", "cut.rest")


def learned_fillers(rows: DataFrame, entries: DataFrame, whole: DataFrame) -> DataFrame:
    """``field, phrase`` of the phrases beside many different entries, in either word order and transliterated too.

    ``rows`` are the word lists of texts that equal no entry; a text that as a whole is near another entry than its rest
    says nothing about its phrase.
    """
    beside = _cuts(rows).withColumn("key", _key(F.col("rest"))).join(entries, ["field", "key"])
    other = whole.select("field", "text", F.col("ref_id").alias("meant")).distinct()
    beside = beside.join(other, ["field", "text"], "left").where("meant is null or meant = ref_id")
    counts = beside.groupBy("field", "phrase").agg(F.count_distinct("ref_id").alias("n"))
    most = counts.groupBy("field").agg(F.max("n").alias("most"))
    kept = counts.join(most, "field").where(f"n >= {LEAST_ENTRIES} and n * {OF_MOST} >= most").select("field", "phrase")
    turned = F.array_join(F.reverse(F.split("phrase", " ")), " ")
    kept = kept.select("field", F.explode(F.array("phrase", turned)).alias("phrase"))
    return kept.select("field", F.explode(F.array("phrase", _latin(F.col("phrase")))).alias("phrase")).distinct()


def _known(phrases: DataFrame, fillers: DataFrame) -> DataFrame:
    """``field, phrase``: those within the edits of a filler, or with the letters of one of three or four in any order."""
    keys = fillers.select("field", F.lit(0).cast("long").alias("ref_id"), F.col("phrase").alias("key"))
    near = _near(phrases.select("field", F.col("phrase").alias("text"), F.col("phrase").alias("key")), _segments(keys, _filler_edits), False)
    letters = F.array_join(F.array_sort(F.split("phrase", "")), "").alias("letters")
    short = lambda x: x.where(F.length("phrase").between(3, 4)).select("field", "phrase", letters)
    mixed = short(phrases).join(short(fillers).select("field", "letters"), ["field", "letters"], "left_semi")
    return near.select("field", F.col("text").alias("phrase")).unionByName(mixed.select("field", "phrase")).distinct()


def _unglued(rows: DataFrame, fillers: DataFrame) -> DataFrame:
    """``field, text, key``: texts written as one word without a filler of three letters or more stuck to an end."""
    glued = fillers.select("field", F.replace("phrase", F.lit(" "), F.lit("")).alias("phrase")).where("length(phrase) > 2").distinct()
    longest = glued.agg(F.max(F.length("phrase"))).first()[0] or 0
    one = rows.where("size(words) = 1").select("field", "text", F.get("words", F.lit(0)).alias("w")).withColumn("long", F.length("w")).where(f"long > 3 and {longest} > 2")
    cut = one.withColumn("n", F.explode(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.col("long") - 1, F.lit(longest))))))
    ends = F.array(F.expr("struct(substring(w, 1, n) as phrase, substring(w, n + 1, long - n) as key)"), F.expr("struct(substring(w, long - n + 1, n) as phrase, substring(w, 1, long - n) as key)"))
    ends = cut.select("field", "text", F.explode(ends).alias("x")).select("field", "text", "x.phrase", "x.key")
    return ends.join(glued, ["field", "phrase"], "left_semi").select("field", "text", "key")


def canonical(texts: DataFrame, reference: DataFrame) -> DataFrame:
    """``field, text, ref_id, edits`` of every distinct text that means an entry of its field; others have no row.

    ``texts`` has ``field, text``, ``reference`` has ``field, ref_id, name``. The entry with a key of fewest edits from one
    of the text's keys is meant, of several the one with the longest key, then the smallest id. Null and blank texts mean
    nothing; entries with a null id or name are left out.
    """
    entries = written(entry_keys(reference.where("ref_id is not null and name is not null")), "entries")
    small = entries.limit(4 * BROADCAST_ENTRIES + 1).count() <= 4 * BROADCAST_ENTRIES
    segments = _segments(entries)
    rows = written(typed_words(texts.where("text is not null")), "words")
    whole = written(_near(rows.select("field", "text", _key(F.col("words")).alias("key")), segments, small), "whole")
    # a text equal to an entry has its answer; of the others, the keys without one phrase and without two
    open_rows = rows.join(whole.where("edits = 0").select("field", "text").distinct(), ["field", "text"], "left_anti")
    fillers = written(learned_fillers(open_rows, entries, whole), "fillers")
    keys = _unglued(open_rows, fillers)
    for _ in range(CUTS):
        cuts = written(_cuts(open_rows), "cuts")
        known = written(_known(cuts.select("field", "phrase").distinct(), fillers), "known")
        open_rows = cuts.join(known, ["field", "phrase"], "left_semi").select("field", "text", F.col("rest").alias("words")).distinct()
        keys = keys.unionByName(open_rows.select("field", "text", _key(F.col("words")).alias("key")))
    near = whole.unionByName(_near(_spread(keys.distinct()), segments, small))
    best = Window.partitionBy("field", "text").orderBy("edits", F.desc("size"), "ref_id")  # the entries near one text
    return near.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("field", "text", "ref_id", "edits")


def mapped(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """``field, src_id, ref_id`` for rows of ``field, src_id, text``: the entry meant, or 0 where the list has none (by anti-join)."""
    found = written(canonical(rows, reference).select("field", "text", "ref_id"), "meant")
    named = rows.join(found, ["field", "text"]).select("field", "src_id", "ref_id")
    unmatched = rows.join(found, ["field", "text"], "left_anti").select("field", "src_id", F.lit(0).cast("long").alias("ref_id"))
    return named.unionByName(unmatched).distinct()
