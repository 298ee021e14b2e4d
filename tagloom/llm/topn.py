"""Problem 3: the top N items within every group, by simultaneous bisection of all groups' cutoffs.

Score and identifiers become one order-preserving code. In each round the rows of every open group's interval are counted
between 4,095 midpoints at once, partially before the shuffle; the part with the N-th row is the group's next interval, until
exactly N rows lie at or before its end. The first round drops what lies after the interval. Every part brings its own
least and greatest code along, so the next midpoints need no pass of their own and digits all of whose values are equal are
skipped. No group is sorted and none is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm import skew
from tagloom.session import written

#: Parts a round cuts each open interval into.
WAYS = 4096
#: Rows from which the rows kept are written anew once a round leaves less than a quarter of them.
REWRITE = 1 << 20


def _code(score: str, ids: list[str]) -> Column:
    """Ascending where the score descends, then by the ids; -0.0 is 0.0."""
    bits = f"cast(reflect('java.lang.Double', 'doubleToLongBits', {score} + 0.0D) as bigint)"
    down = F.expr(f"transform(array({bits}), b -> ~(b ^ (shiftright(b, 63) & 9223372036854775807L)))[0]")
    return F.struct(down.alias("d0"), *(F.col(c).cast("long").alias(f"d{k}") for k, c in enumerate(ids, 1)))


def _cut(digits: int) -> Column:
    """The part of ``lo`` to ``hi`` in which ``code`` lies, by the first digit in which both ends differ."""
    half = lambda x: f"shiftright({x}, 1)"  # noqa: E731 - halves, so that no difference overflows
    out = "0L"
    for k in reversed(range(digits)):
        x, lo, hi = f"code.d{k}", f"lo.d{k}", f"hi.d{k}"
        near = f"{half(lo)} = {half(hi)}"
        out = f"case when {lo} = {hi} then {out} when {near} then {x} - {lo} else div({half(x)} - {half(lo)}, div({half(hi)} - {half(lo)}, {WAYS}) + 1) end"
    return F.expr(out)


def _edges(members: DataFrame) -> DataFrame:
    """Of each group the part with its last wanted row: its ends, the rows ``need``-ed of its ``n``, and whether these are all.

    ``kept`` is how many rows of the group the members are taken from; in the first round, those up to the part's end.
    """
    known = ["kept"] if "kept" in members.columns else []
    parts = members.groupBy("g", "need", *known, "cut").agg(F.count("*").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    by = Window.partitionBy("g").orderBy("cut")  # at most WAYS + 1 rows a group
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumns({"before": before, "last": F.lead("cut").over(by).isNull()})
    chosen = placed.where("before < need and (before + n >= need or last)")
    kept = F.col("kept") if known else F.expr("before + n").alias("kept")
    return chosen.select("g", "lo", "hi", (F.col("need") - F.col("before")).alias("need"), "n", kept, F.expr("n <= need - before").alias("done"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def top_n_per_group(df: DataFrame, group: str, score: str, ids: list[str], n: int) -> DataFrame:
    """For each ``group`` the ``n`` items (``ids``, integers) of highest ``score``, ties by the ids ascending.

    An item of several rows counts once with its highest score. Null and NaN scores never count, nor do rows with a null
    group or id; groups of fewer items come out whole; -0.0 equals 0.0. Result: group, ids and score.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    columns = [f"id{k}" for k in range(len(ids))]
    base = df.select(F.col(group).alias("g"), *(F.col(c).alias(x) for c, x in zip(ids, columns, strict=True)), F.col(score).cast("double").alias("s"))
    base = base.dropna().where(~F.isnan("s"))
    code = _code("s", columns)
    ends = base.withColumn("code", code).groupBy("g").agg(F.count("*").alias("rows"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    groups = written(ends.withColumn("need", F.lit(n).cast("long")), "groups")
    total, largest = groups.agg(F.sum("rows"), F.max("rows")).first()
    cut = _cut(1 + len(ids))

    def once(rows: DataFrame) -> DataFrame:
        held = rows.groupBy("g", *columns).agg(F.max("s").alias("s"), *(F.first(c).alias(c) for c in ("lo", "hi", "need")))
        return held.withColumn("code", code).withColumn("cut", cut).select("g", *columns, "s", "code", "need", "cut")

    items = written(skew.joined(base, groups, "g", "rows", total or 0, largest or 0, once), "items")
    rows, state = items.drop("need", "cut"), written(_edges(items), "edges")
    closed: list[DataFrame] = []
    scanned = None
    while True:
        closed.append(state.where("done").select("g", "hi", "kept"))
        opened = state.where("not done")
        still, wide, kept, most = state.agg(F.count(F.when(~F.col("done"), 1)), F.coalesce(F.sum(F.when(~F.col("done"), F.col("n"))), F.lit(0)), F.sum("kept"), F.max("kept")).first()
        if scanned is None or scanned > REWRITE and 4 * wide < scanned:
            # what lies after a group's interval is dropped; the rows of closed groups stay for the result
            ends = _union([*closed, opened.select("g", "hi", "kept")])
            rows = written(skew.joined(rows, ends, "g", "kept", total or 0, largest or 0).where("code <= hi").drop("hi", "kept"), "kept")
            if scanned is None:
                total, largest = kept, most
            scanned = wide
        if not still:
            break
        members = skew.joined(rows, opened.drop("n", "done"), "g", "kept", total, largest).where("code between lo and hi")
        state = written(_edges(members.withColumn("cut", cut)), "edges")
    out = skew.joined(rows, _union(closed), "g", "kept", total or 0, largest or 0).where("code <= hi")
    return out.select(F.col("g").alias(group), *(F.col(x).alias(c) for c, x in zip(ids, columns, strict=True)), F.col("s").alias(score))
