"""Problem 7: filling fixed-capacity containers with items, by vector best-fit.

A container has a capacity of tokens, of documents and of attention cost (the sum of the squares of its documents' lengths).
Shards of bounded size, drawn by a hash of the document, are packed side by side: within a shard the largest item goes to the
open container, among those where all three residual capacities suffice, that its demands match best: by the weighted dot
product of demands and residuals, or by the norm of what would be left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.tokens import VOCABULARY, token_sizes
from tagloom.session import written

#: Items of one shard, as expected by hash; bounds a task's work and memory.
SHARD_ITEMS = 25_000


def fill(sizes: np.ndarray, capacity: int, most_items: int, most_cost: float, weights=(1.0, 0.05, 0.3), rule: str = "norm") -> np.ndarray:
    """The container of each item (0 to capacity tokens), by vector best-fit decreasing.

    Containers of equal residuals are alike, so they are kept as one state with a stack of containers: the choice is among
    the different states, not among all open containers.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    top = np.array([capacity, most_items, most_cost], float)
    states: dict[tuple, list[int]] = {}
    table, keys = np.zeros((64, 3)), []
    slot: dict[tuple, int] = {}
    free: list[int] = []
    opened = 0
    w = np.asarray(weights)
    for i in order:
        size = int(sizes[i])
        demand = np.array([size, 1.0, float(size) * size])
        chosen = None
        if keys:
            left = table[: len(keys)]
            ok = (left >= demand).all(axis=1)
            if ok.any():
                at = np.flatnonzero(ok)
                if rule == "norm":
                    value = -((((left[at] - demand) / top) ** 2) @ w)
                else:
                    value = (left[at] / top) @ (w * demand / top)
                chosen = keys[at[int(np.argmax(value))]]
        if chosen is None:
            box, residual = opened, (capacity, most_items, most_cost)
            opened += 1
        else:
            residual = chosen
            box = states[chosen].pop()
            if not states[chosen]:
                del states[chosen]
                row = slot.pop(chosen)
                table[row] = -1.0
                free.append(row)
        out[i] = box
        new = (residual[0] - size, residual[1] - 1, residual[2] - float(size) * size)
        if new[0] <= 0 or new[1] <= 0 or new[2] <= 0:
            continue  # full
        if new in states:
            states[new].append(box)
            continue
        states[new] = [box]
        if free:
            row = free.pop()
            keys[row] = new
        else:
            row = len(keys)
            keys.append(new)
            if row == len(table):
                table = np.vstack([table, np.zeros_like(table)])
        table[row] = new
        slot[new] = row
    return out


def packed_containers(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 2048,
    most_items: int = 64,
    most_cost: float | None = None,
    rule: str = "norm",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``container, doc_id, piece, tokens, fill, items``: what each container holds and how full it is.

    Each row of text with at least one token lies in exactly one container, whole (``piece`` 0), unless it is longer than
    ``capacity``: then it is cut into full containers of its own and a rest that is packed like any other item. Rows
    without an id and texts without tokens are left out; rows that repeat an id are items of their own. The default
    attention capacity, ``capacity`` squared, is that of one document filling the container and never binds beside that of
    tokens; with a smaller one, an item that alone exceeds it gets a container of its own.
    """
    if capacity < 1 or most_items < 1:
        raise ValueError("capacities must be at least 1")
    most_cost = float(capacity) ** 2 if most_cost is None else float(most_cost)
    if not most_cost >= 1:
        raise ValueError("capacities must be at least 1")
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    items = written(token_sizes(ids, ["doc_id"], "text", vocabulary).where("tokens > 0"), "sizes")
    pieces = items.select(
        "doc_id", F.explode(F.expr(f"transform(sequence(0, cast(div(tokens - 1, {capacity}) as int)), k -> struct(k as piece, least({capacity}L, tokens - k * {capacity}L) as tokens))")).alias("p")
    ).select("doc_id", "p.piece", "p.tokens")
    whole = pieces.where(F.col("tokens") == capacity)
    rest = pieces.where(F.col("tokens") < capacity)
    shards = max(1, -(-rest.count() // SHARD_ITEMS))

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("tokens", "descending")])
        sizes = table.column("tokens").to_numpy()
        box = fill(sizes, capacity, most_items, most_cost, rule=rule)
        filled, held = np.bincount(box, weights=sizes), np.bincount(box)
        return pa.table(
            {
                "container": pa.array(box * shards + shard, pa.int64()),
                "doc_id": table.column("doc_id"),
                "piece": table.column("piece"),
                "tokens": table.column("tokens"),
                "fill": pa.array(filled[box] / capacity, pa.float64()),
                "items": pa.array(held[box], pa.int64()),
            }
        )

    sharded = rest.withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, piece), {shards})"))
    shared = sharded.groupBy("shard").applyInArrow(pack, "container long, doc_id long, piece int, tokens long, fill double, items long")
    # full pieces have containers of their own, numbered below zero; the table they come from is written, so the numbers stay
    single = whole.select(
        (F.lit(-1) - F.monotonically_increasing_id()).alias("container"), "doc_id", "piece", "tokens", F.lit(1.0).alias("fill"), F.lit(1).cast("long").alias("items")
    )
    return shared.unionByName(single)


def packing_report(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, items, tokens, the share of space used, and the least number of containers any packing needs."""
    return containers.agg(
        F.countDistinct("container").alias("containers"), F.count("*").alias("items"), F.sum("tokens").alias("tokens")
    ).withColumns(
        {
            "used_share": F.col("tokens") / (F.col("containers") * capacity),
            "least_containers": F.ceil(F.col("tokens") / capacity),
        }
    )


def binding_limits(containers: DataFrame, capacity: int, most_items: int, most_cost: float) -> DataFrame:
    """``capacity, containers, full``: of each of the three capacities, in how many containers it is the one used most, and used to 0.95 at least.

    A container whose one item alone exceeds the cost has used it whole.
    """
    used = containers.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("c"))
    shares = [F.least(F.lit(1.0), F.col(x) / F.lit(float(most))) for x, most in (("t", capacity), ("n", most_items), ("c", most_cost))]
    rows = used.select(F.greatest(*shares).alias("top"), F.explode(F.array(*(F.struct(F.lit(name).alias("capacity"), s.alias("share")) for name, s in zip(("tokens", "items", "cost"), shares, strict=True)))).alias("x"))
    return rows.groupBy("x.capacity").agg(F.count(F.when(F.col("x.share") == F.col("top"), 1)).alias("containers"), F.count(F.when(F.col("x.share") >= 0.95, 1)).alias("full"))
