"""Problem 4: uses and record frequency of every term, from a vertical layout.

Each item's records are kept as compressed bitmaps, a container for every 4,096 record identifiers, with the item's uses in
a counter beside each. The containers of the items of one term are merged by union, and the number of records is the
cardinality of the union; where a term has one item, its own cardinality. Rows are aggregated partially before their shuffle
and spread by (item, container), so the postings of a hot term are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Record identifiers of one container, as a power of two.
BUCKET_BITS = 12


def normal_term(column: Column) -> Column:
    """Lower case, without blanks, tabs and line breaks at the ends."""
    return F.lower(F.regexp_replace(column, r"^[ \t\n\r]+|[ \t\n\r]+$", ""))


def bitmaps(postings: DataFrame, item: str, record: str, uses: str | None) -> DataFrame:
    """``item, bucket, bits, records, uses``: the vertical layout of (item, record) rows, a container a row.

    A container holds the records of one ``bucket`` of 4,096 identifiers: of each of its 16-bit words that isn't zero the
    place (a byte) and the bits (two bytes), so one record takes 3 bytes and 4,096 records 768. A repeated (item, record) is
    one bit and counts once with its largest uses; null uses add nothing. Rows with a null item or record are left out.
    Without ``uses`` each record is one use.
    """
    rows = postings.select(F.col(item).alias("item"), F.col(record).cast("long").alias("record"), *([F.col(uses).cast("long").alias("uses")] if uses else []))
    rows = rows.where("item is not null and record is not null")
    counted = F.coalesce(F.max("uses"), F.lit(0)) if uses else F.lit(1).cast("long")
    once = rows.groupBy("item", "record").agg(counted.alias("uses")) if uses else rows.distinct().withColumn("uses", counted)
    once = once.withColumns({"bucket": F.expr(f"shiftright(record, {BUCKET_BITS})"), "place": F.expr("shiftright(record, 4) & 255")})
    spread = once.repartition("item", "bucket")  # both steps below keep this layout
    words = spread.groupBy("item", "bucket", "place").agg(
        F.expr("bit_or(shiftleft(1, cast(record & 15 as int)))").alias("bits"), F.sum("uses").alias("uses")
    )
    part = F.struct(F.expr("cast(place - 128 as tinyint)").alias("place"), F.expr("cast(bits - 32768 as smallint)").alias("bits"))
    held = words.groupBy("item", "bucket").agg(F.collect_list(part).alias("parts"), F.sum(F.expr("bit_count(bits)")).alias("records"), F.sum("uses").alias("uses"))
    bits = F.struct(F.col("parts.place").alias("places"), F.col("parts.bits").alias("words"))
    return held.select("item", "bucket", bits.alias("bits"), "records", "uses")


def term_frequency(terms: DataFrame, item: str, text: str, postings: DataFrame, posting_item: str, record: str, uses: str | None = None) -> DataFrame:
    """``term, uses, records`` of every term of ``terms``; items of the same normal form count together.

    Without ``uses`` the uses are the distinct records. Items with a null id or text are left out; terms without any
    posting have 0 and 0; postings of unknown items count for no term.
    """
    named = terms.select(F.col(item).alias("item"), normal_term(F.col(text)).alias("term")).where("item is not null and term is not null").distinct()
    several = named.groupBy("term").agg(F.count("*").alias("items")).where("items > 1").select("term", F.lit(True).alias("several"))
    flagged = named.join(several, "term", "left")
    # inner, so that a hot item's containers may be split; terms without postings come in beside
    found = bitmaps(postings, posting_item, record, uses).join(flagged, "item")
    none = F.lit(None)
    line = lambda place, bits, records, uses: F.struct(place.cast("int").alias("place"), bits.cast("int").alias("bits"), records.cast("long").alias("records"), uses.cast("long").alias("uses"))
    zero = F.lit(0)
    alone = F.array(line(none, none, F.col("records"), F.col("uses")))
    # a term of several items: the union of their words, whose cardinality is the number of records
    words = F.transform(F.arrays_zip("bits.places", "bits.words"), lambda w: line(w["places"], w["words"].cast("int") + 32768, zero, zero))
    lines = F.when(F.col("several"), F.concat(words, F.array(line(none, none, zero, F.col("uses"))))).otherwise(alone)
    parts = found.select("term", F.when(F.col("several"), F.col("bucket")).alias("bucket"), F.explode(lines).alias("x"))
    merged = parts.groupBy("term", "bucket", "x.place").agg(F.bit_or("x.bits").alias("bits"), F.sum("x.records").alias("records"), F.sum("x.uses").alias("uses"))
    rows = merged.select("term", (F.col("records") + F.coalesce(F.bit_count("bits"), zero)).alias("records"), "uses")
    empty = named.select("term", zero.cast("long").alias("records"), zero.cast("long").alias("uses"))
    out = rows.unionByName(empty).groupBy("term").agg(F.sum("records").alias("records"), F.sum("uses").alias("uses"))
    return out.select("term", (F.col("uses") if uses else F.col("records")).alias("uses"), "records")


def record_count(postings: DataFrame, item: str | None, record: str) -> DataFrame:
    """``all_records``: the distinct records of the postings (of rows with an item, where one is named), by bitmap union."""
    rows = postings.where(F.col(record).isNotNull())
    if item:
        rows = rows.where(F.col(item).isNotNull())
    words = rows.groupBy(F.expr(f"shiftright({record}, 6)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({record} & 63 as int)))").alias("bits"))
    return words.agg(F.coalesce(F.sum(F.expr("bit_count(bits)")), F.lit(0)).alias("all_records"))


def marked_terms(frequency: DataFrame, total: DataFrame, rare_below: int = 5, common_share: int = 10) -> DataFrame:
    """``term, mark``: 'rare' below ``rare_below`` uses, 'common' in more than one in ``common_share`` of all records."""
    rows = frequency.join(F.broadcast(total), how="cross")  # one row
    marks = F.filter(
        F.array(
            F.when(F.col("uses") < rare_below, F.lit("rare")),
            F.when(F.col("records") * common_share > F.col("all_records"), F.lit("common")),
        ),
        lambda m: m.isNotNull(),
    )
    return rows.select("term", F.explode(marks).alias("mark"))
