"""Problem 8: mixing sources to target weights, by min-cost flow over membership patterns.

Equal texts are one text that may belong to several sources; texts of the same set of sources form a pattern. A small network
(patterns to sources, at most one node per set of listed sources) carries the patterns' tokens to the sources' quotas; the
k-th use of a pattern costs k - 1, so repetition is spread evenly and used only where it must be. Each pattern's texts are then
laid out on a line in seeded order, over and over, and each source takes its stretch of it. Few texts are added or dropped in
the end so that each source comes as near to its quota as these can bring it.
"""

from __future__ import annotations

import heapq
import warnings
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.llm.tokens import VOCABULARY, token_sizes
from tagloom.session import written

#: Sets of sources beyond which a warning says that the driver's flow over them takes long; all are told apart.
MOST_PATTERNS = 4096
#: Part of a quota by which the text at a stretch's end may exceed it, and how often the end is moved at most.
CLOSE, MOVES = 0.002, 40
#: Texts of each size class of a source that may be added to its stretch or dropped from it, so that it meets its quota.
OF_CLASS = 8
#: Texts of one bin of a pattern's line, as expected by hash.
BIN_TEXTS = 50_000


class Network:
    """Min-cost flow by successive shortest paths with potentials; whole capacities and costs of at least 0."""

    def __init__(self):
        self.edges: list[list[int]] = []  # to, capacity left, cost
        self.out: dict = {}

    def add(self, a, b, capacity: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.edges))
            self.out.setdefault(y, [])
            self.edges.append([y, c, w])
        return len(self.edges) - 2

    def send(self, a, b) -> int:
        """The largest flow, at the least cost: for each path cost in turn, blocking flows over the edges of reduced cost 0."""
        potential = dict.fromkeys(self.out, 0)
        total = 0
        while True:
            distance, heap, count = {a: 0}, [(0, 0, a)], 0
            while heap:
                d, _, x = heapq.heappop(heap)
                if d > distance[x]:
                    continue
                for e in self.out[x]:
                    y, capacity, cost = self.edges[e]
                    if capacity and (new := d + cost + potential[x] - potential[y]) < distance.get(y, new + 1):
                        distance[y], count = new, count + 1
                        heapq.heappush(heap, (new, count, y))
            if b not in distance:
                return total
            for x in potential:
                potential[x] += min(distance.get(x, distance[b]), distance[b])
            while amount := self._blocking(a, b, potential):
                total += amount

    def _blocking(self, a, b, potential: dict) -> int:
        """A flow after which no shortest path, in edges, of reduced cost 0 is left."""
        free = lambda x, e: self.edges[e][1] and self.edges[e][2] + potential[x] == potential[self.edges[e][0]]
        level, row = {a: 0}, [a]
        while row and b not in level:
            row = [level.setdefault(y, level[x] + 1) and y for x in row for e in self.out[x] if free(x, e) and (y := self.edges[e][0]) not in level]
        if b not in level:
            return 0
        at, path, x, total = dict.fromkeys(level, 0), [], a, 0
        while True:
            if x == b:
                amount = min(self.edges[e][1] for e in path)
                for e in path:
                    self.edges[e][1] -= amount
                    self.edges[e ^ 1][1] += amount
                total += amount
                cut = next(k for k, e in enumerate(path) if not self.edges[e][1])
                x, path = self.edges[path[cut] ^ 1][0], path[:cut]
            elif at[x] < len(self.out[x]):
                e = self.out[x][at[x]]
                if free(x, e) and level.get(self.edges[e][0]) == level[x] + 1:
                    path.append(e)
                    x = self.edges[e][0]
                else:
                    at[x] += 1
            elif path:
                x = self.edges[path.pop() ^ 1][0]
                at[x] += 1
            else:
                return total


def routed(sizes: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict]:
    """Tokens sent in all, and from each pattern to each of its sources."""
    net, edges = Network(), {}
    for pattern, size in sorted(sizes.items()):
        for k in range(max(repeats[s] for s in pattern)):
            net.add("in", ("pattern", pattern), size, k)
        for s in pattern:
            edges[pattern, s] = net.add(("pattern", pattern), ("source", s), size * repeats[s])
    for s, quota in sorted(quotas.items()):
        net.add(("source", s), "out", quota)
    total = net.send("in", "out")
    return total, {key: net.edges[e ^ 1][1] for key, e in edges.items() if net.edges[e ^ 1][1]}


def planned(sizes: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], most: int) -> tuple[dict[str, int], dict]:
    """The quotas of the largest total up to ``most`` that all present sources can fill at their shares, and the flow."""
    present = {s for pattern in sizes for s in pattern}
    weights = {s: Fraction(shares[s]).limit_denominator(10**9) for s in present if shares[s] > 0}
    whole = sum(weights.values())
    if not whole:
        return {}, {}
    quotas = lambda total: {s: int(total * w / whole) for s, w in weights.items()}
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        q = quotas(middle)
        low, high = (middle, high) if routed(sizes, q, repeats)[0] == sum(q.values()) else (low, middle - 1)
    q = quotas(low)
    return q, routed(sizes, q, repeats)[1]


def mixture(
    docs: DataFrame,
    targets: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    total_tokens: int | None = None,
    seed: int = 7,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``doc_id, source, uses, tokens``: how often each chosen text is used for a source; ``tokens`` of one use.

    Targets have ``source, target_share, max_repeat``; of several rows of a source the first by share and repeat counts,
    rows with a null or a repeat below 1 are left out. A source without texts can't get its share; the others' are scaled
    up to 1. The total is ``total_tokens`` (by default the tokens of all usable texts) or, if repetition can't reach that,
    the largest at which every present source gets its share. Texts of null or unlisted sources only, without tokens or
    without an id are left out. Equal texts are one text, named by the smallest id; it may serve any source it stands in,
    for each at most ``max_repeat`` times.
    """
    rows = targets.select("source", "target_share", "max_repeat").dropna().where("max_repeat >= 1 and target_share >= 0").collect()  # the list of sources
    listed = {}
    for r in sorted(rows):
        listed.setdefault(r.source, (float(r.target_share), int(r.max_repeat)))
    spark = docs.sparkSession
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).alias("source"), F.col(text_column).alias("text"))
    base = base.where(F.col("doc_id").isNotNull() & F.col("source").isin(list(listed))).withColumn("print", F.sha2("text", 256))
    texts = (
        token_sizes(base, ["doc_id", "source", "print"], "text", vocabulary)
        .where("tokens > 0")
        .groupBy("print")
        .agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern"))
    )
    texts = written(texts.withColumn("turn", F.xxhash64("print", F.lit(seed))).drop("print"), "texts")
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()  # the sets of sources
    if len(sums) > MOST_PATTERNS:
        warnings.warn(f"{len(sums)} sets of sources: their flow is worked out on the driver", stacklevel=2)
    sizes = {tuple(r.pattern): int(r.tokens) for r in sums}
    shares = {s: share for s, (share, _) in listed.items()}
    repeats = {s: repeat for s, (_, repeat) in listed.items()}
    quotas, flow = planned(sizes, shares, repeats, sum(sizes.values()) if total_tokens is None else int(total_tokens))
    stretches, at = [], {}
    for (pattern, source), tokens in sorted(flow.items()):
        start = at.get(pattern, 0)
        stretches.append({"pattern": list(pattern), "source": source, "begin": start, "until": start + tokens, "line": sizes[pattern]})
        at[pattern] = start + tokens
    bins = max(64, -(-sum(r.n for r in sums) // BIN_TEXTS))
    placed = texts.withColumn("bin", F.expr(f"cast(floor((turn / 1.8446744073709552e19 + 0.5) * {bins}) as int)"))
    starts = placed.groupBy("pattern", "bin").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("pattern", "bin", before.alias("base"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("pattern", "bin").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lined = placed.withColumn("inside", inside).join(starts, ["pattern", "bin"]).withColumn("at", F.col("base") + F.col("inside"))
    lined = written(lined.select("doc_id", "pattern", "tokens", "turn", "at"), "line")
    plan = _settled(lined, [{**x, "most": repeats[x["source"]], "skip": [], "quota": quotas[x["source"]]} for x in stretches])
    passed = lambda x: f"(case when {x} > at then div({x} - at + line - 1, line) else 0 end)"
    uses = f"least(most, cast({passed('until')} - {passed('begin')} as int)) - size(filter(skip, x -> x = doc_id))"
    laid = lined.join(F.broadcast(plan), "pattern").withColumn("uses", F.expr(f"greatest(0, {uses})"))
    laid = written(laid.select("doc_id", "source", "uses", "tokens", "turn", "most"), "laid")
    changes = spark.createDataFrame(_corrections(laid, quotas), "doc_id long, source string, change int")
    used = laid.join(F.broadcast(changes), ["doc_id", "source"], "left").withColumn("uses", F.col("uses") + F.coalesce("change", F.lit(0)))
    return used.where("uses > 0").select("doc_id", "source", "uses", "tokens")


def _settled(lined: DataFrame, stretches: list[dict]) -> DataFrame:
    """The stretches, their ends moved on where one falls into a text too long for it.

    The text at the end of a stretch is used whole; where that exceeds the source's quota by more than CLOSE of it, the text
    is skipped once and the stretch goes on for as much. Ends land in such texts only while these are long beside a quota.
    """
    spark = lined.sparkSession
    shape = "pattern array<string>, source string, begin long, until long, line long, most int, skip array<long>"
    table = lambda rows: spark.createDataFrame([tuple(x[c] for c in ("pattern", "source", "begin", "until", "line", "most", "skip")) for x in rows], shape)
    moving = list(stretches)
    for _ in range(MOVES):
        if not moving:
            break
        last = F.expr("pmod(until - 1, line)")
        ends = lined.join(F.broadcast(table(moving)), "pattern").where((F.col("at") <= last) & (F.col("at") + F.col("tokens") > last))
        found = {(tuple(r.pattern), r.source): r for r in ends.withColumn("over", F.expr("at + tokens - 1 - pmod(until - 1, line)")).collect()}  # a row for each stretch
        moved = []
        for x in moving:
            r = found.get((tuple(x["pattern"]), x["source"]))
            if not r or r.over <= CLOSE * x["quota"] or r.doc_id in x["skip"]:
                continue
            whole, past = x["begin"] + x["line"] * x["most"], x["until"] + r.tokens
            if past <= whole:
                moved.append(x)
            elif past - whole >= r.over:
                continue  # all other texts would miss the quota by more than this one exceeds it
            x["until"] = min(past, whole)
            x["skip"].append(r.doc_id)
        moving = moved
    return table(stretches)


def _corrections(laid: DataFrame, quotas: dict[str, int]) -> list[tuple[int, str, int]]:
    """``doc_id, source, change``: single uses to add or drop so that each source's tokens come nearest to its quota.

    A stretch ends within a text, which is used whole or not at all, so a source may miss its quota by a long text. Of each
    source's texts the first of every size class (powers of two) that may still be used, and that are, are candidates: a
    list of bounded length, whatever the input. The changes are the best subset of them.
    """
    got = {r.source: int(r.tokens) for r in laid.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens")).collect()}  # the sources
    ways = F.array(F.when(F.col("uses") < F.col("most"), F.lit(1)), F.when(F.col("uses") > 0, F.lit(-1)))
    rows = laid.select("doc_id", "source", "tokens", "turn", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("way"))
    by = Window.partitionBy("source", "way", F.floor(F.log2("tokens"))).orderBy("turn", "doc_id")  # limited before the shuffle
    rows = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= OF_CLASS).collect()
    out = []
    for source, quota in sorted(quotas.items()):
        want = quota - got.get(source, 0)
        items = sorted((r.turn, r.doc_id, r.tokens * r.way) for r in rows if r.source == source and r.tokens <= 2 * abs(want) + 64)
        seen: dict[int, tuple] = {}
        for turn, doc, tokens in items:  # a text is either added or dropped once
            seen.setdefault(doc, (doc, tokens))
        chosen = nearest_subset([t for _, t in seen.values()], want)
        out += [(doc, source, 1 if tokens > 0 else -1) for k, (doc, tokens) in enumerate(seen.values()) if k in chosen]
    return out


def nearest_subset(items: list[int], want: int) -> set[int]:
    """The places of items, positive and negative, whose sum comes nearest to ``want`` among all sums within three times its reach."""
    if not want or not items:
        return set()
    reach = 3 * abs(want) + 192
    zero, mask = reach, (1 << (2 * reach + 1)) - 1
    sums = [1 << zero]  # bit k: a sum of k - zero can be had from the items so far
    for x in items:
        sums.append(sums[-1] | ((sums[-1] << x) & mask if x > 0 else sums[-1] >> -x))
    best = min((d for d in range(-abs(want), abs(want) + 1) if 0 <= want + d + zero <= 2 * reach and sums[-1] >> (want + d + zero) & 1), key=lambda d: (abs(d), d))
    at, chosen = want + best + zero, set()
    for k in reversed(range(len(items))):
        if not sums[k] >> at & 1:
            at -= items[k]
            chosen.add(k)
    return chosen


def mixture_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source of the targets: its share of all tokens used, that aimed at, its texts, tokens and most uses of a text."""
    sums = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    total = sums.agg(F.sum("tokens").alias("whole"))
    rows = targets.select("source", "target_share", "max_repeat").join(sums, "source", "left").join(F.broadcast(total), how="cross")  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("source", "target_share", "max_repeat", zero("tokens").alias("tokens"), zero("texts").alias("texts"), zero("most_uses").alias("most_uses"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"))
