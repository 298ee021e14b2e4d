"""Problem 6: near-duplicate records with small edits, by an exact set-similarity join that uses set relations.

1. Each record is the set of its word sequences. One pass counts the sequences in a sketch of two hashed rows (it only orders
   them, so its collisions cost time, never results) and gives each record a min-hash. What a counter holds by collisions,
   its row's median, is taken off, so that a rare sequence stays rare however many sequences there are.
2. Records that differ by a few sequences from the leader of their min-hash form its family. Only leaders are indexed.
3. A leader's rarest sequences go to the lists of the index, each with the overlap its position leaves. A list is sorted by
   that, so the part that a record's size and position rule out is skipped whole; what is left must pass a bound on the
   difference of the two sets' bitmaps. Lists of very frequent sequences are cut into pairs of chunks.
4. The overlap of two leaders is counted once; the overlaps of their families' members are derived from it by the few
   sequences in which member and leader differ. Families are expanded in bounded chunks.

Every bound is exact: no candidate is capped or sampled, and no pair is lost.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import hashing as H
from tagloom.llm import skew
from tagloom.llm.components import components
from tagloom.llm.spans import BLOCK_BYTES, bucket_count, one_row_per_id
from tagloom.session import scan_bytes, written

#: A member may lack this many of its leader's sequences and add this many, or a tenth of its size if that is less.
FEW = 3
#: Counters of both rows of the sketch, as a power of two, least and most: the broadcast has 2**23 bytes at any input size.
#: It travels in so many parts.
LEAST_BITS, MOST_BITS, SKETCH_PARTS = 18, 23, 16
#: Expected entries of one chunk of a list, members of one chunk of a family, pairs looked at together.
LIST_CHUNK, FAMILY_CHUNK, PAIRS = 8192, 128, 400_000
#: Bits of the bitmaps: a set of more than a third as many sequences as bits has the next longer one.
BITMAPS = (256, 512, 1024, 2048)


def normal_text(*columns: str) -> Column:
    """The columns joined by a blank, in lower case, every run of other than letters and digits one blank."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"[^\p{L}\p{N}]+", " ")


def _block_sets(part: pa.RecordBatch, length: int, least_words: int):
    """Of the records with enough words: their row, and number and hash of each of their sequences, once a record."""
    words, counts = H.word_hashes(part.column("text"))
    rows = np.flatnonzero(counts >= max(least_words, length))
    starts, n = (np.cumsum(counts) - counts)[rows], counts[rows] - length + 1
    total, base = int(n.sum()), np.cumsum(n) - n
    h = H.window_hashes(words, length)[np.arange(total) + np.repeat(starts - base, n)]
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(total, bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return rows, doc[keep], h[keep]


def sketch_bits(size: int) -> int:
    """A counter for every 16 kB of input, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, size) - 1).bit_length() - 14))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each sequence's counter in the first and in the second row."""
    shift, half = np.uint64(65 - bits), np.int64(1 << (bits - 1))
    return (h >> shift).astype(np.int64), half + (H.mixed(h, 91) >> shift).astype(np.int64)


def _levels_of(h: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
    first, second = _places(h, bits)
    return np.minimum(levels[first], levels[second])


def _counted(total: np.ndarray) -> np.ndarray:
    """Levels of a part of one row of counters, beyond its median: eight steps to a power of two."""
    own = np.maximum(total - int(np.median(total)), 0)
    return np.minimum(255, np.floor(np.log2(1 + own) * 8)).astype(np.uint8)


def _marks(length: int, least_words: int, bits: int):
    """Per record its size and min-hash; per task the sketch of its sequences, in rows of ``key`` and ``data``."""

    def run(batches):
        counters = np.zeros(1 << bits, np.int64)
        for part in H.blocks(batches, "text", BLOCK_BYTES):
            rows, doc, h = _block_sets(part, length, least_words)
            if not len(rows):
                continue
            for places in _places(h, bits):
                counters += np.bincount(places, minlength=1 << bits)
            sizes = np.bincount(doc, minlength=len(rows))
            ends = np.cumsum(sizes) - sizes
            least = [np.minimum.reduceat(H.mixed(h, seed), ends) for seed in (11, 23, 37, 51)]
            family = H.mixed(H.mixed(H.mixed(least[0]) ^ least[1]) ^ least[2]) ^ least[3]
            none = pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*none, part.column("doc_id").take(pa.array(rows)), pa.array(sizes, pa.int32()), pa.array(family.view(np.int64))],
                names=["key", "data", "post", "size", "family"],
            )
        cut = len(counters) // SKETCH_PARTS
        data = [H.packed(np.minimum(counters[k * cut : (k + 1) * cut], 2**32 - 1)) for k in range(SKETCH_PARTS)]
        nulls = [pa.nulls(SKETCH_PARTS, t) for t in (pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(data, pa.binary()), *nulls], names=["key", "data", "post", "size", "family"]
        )

    return run


def _levels(bits: int):
    def run(batches):
        """One part of the sketch from those of all tasks, as bytes."""
        total, key = np.zeros((1 << bits) // SKETCH_PARTS, np.int64), None
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
                total += H.unpacked(data, len(total))
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([_counted(total).tobytes()], pa.binary())], names=["key", "data"])

    return run


def _chunks(level: np.ndarray) -> np.ndarray:
    """Into how many chunks the list of a sequence of this level is cut."""
    return np.maximum(1, np.ceil(2.0 ** (level.astype(np.float64) / 8) / LIST_CHUNK)).astype(np.int64)


def _sets(length: int, least_words: int):
    """``post, tokens`` for each record, and the columns it came with."""

    def run(batches):
        for part in H.blocks(batches, "text", BLOCK_BYTES):
            rows, doc, h = _block_sets(part, length, least_words)
            ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(rows)))) if len(rows) else np.zeros(1)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), tokens], names=["post", "tokens"])

    return run


def _bitmap(doc: np.ndarray, h: np.ndarray, n: int, bits: int) -> np.ndarray:
    """``bits`` bits a set, each sequence flips one: two sets differ in at least as many sequences as their bitmaps in bits."""
    at = doc.astype(np.int64) * bits + (H.mixed(h, 5) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=n * bits).astype(np.uint8) & 1).view(np.uint64).reshape(n, bits // 64)


def _bitmap_kind(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted([bits // 3 for bits in BITMAPS[:-1]], sizes, "left")


def _index(length: int, least_words: int, groups: int, levels, bits: int):
    def run(batches):
        level_of = np.frombuffer(levels.value, np.uint8)
        for part in H.blocks(batches, "text", BLOCK_BYTES):
            rows, doc, h = _block_sets(part, length, least_words)
            if not len(rows):
                continue
            sizes = np.bincount(doc, minlength=len(rows))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            column = lambda c: pa.compute.fill_null(part.column(c), -(2**30)).to_numpy(zero_copy_only=False)[rows].astype(np.int64)  # noqa: B023, E731
            need, least = column("need"), column("least_overlap")
            need = np.where(need == -(2**30), sizes, need)
            least = np.where(least == -(2**30), (sizes + 1) // 2 - np.minimum(FEW, sizes // 5), least)
            kind = _bitmap_kind(sizes)
            bitmaps = [_bitmap(doc, h, len(rows), bits) if (kind == k).any() else None for k, bits in enumerate(BITMAPS)]
            level = _levels_of(h, level_of, bits)
            order = np.lexsort((h, level, doc))
            h, level, doc = h[order], level[order], doc[order]
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = np.flatnonzero(place < (sizes - least + 1)[doc])
            h, level, doc, tail = h[some], level[some], doc[some], (sizes[doc] - place)[some]
            chunks = _chunks(level)
            own = (H.mixed(ids.view(np.uint64), 3) >> np.uint64(20)).astype(np.int64)[doc] % chunks
            if chunks.max() > 1:  # a long list: every pair of its chunks is a list of its own
                times = np.repeat(np.arange(len(h)), chunks)
                other = np.arange(len(times)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                mine = own[times]
                pair = np.minimum(mine, other) * (1 << 20) + np.maximum(mine, other)
                h, doc, tail, side = H.mixed(h[times] ^ H.mixed(pair.view(np.uint64), 7)), doc[times], tail[times], np.sign(mine - other) + 1
            else:
                h, side = H.mixed(h ^ H.mixed(np.zeros(1, np.uint64), 7)), np.ones(len(h), np.int64)
            key = ((h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)
            by = np.argsort(key, kind="stable")
            key = key[by]
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else [0]
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                x = by[lo:hi]
                docs, ref = np.unique(doc[x], return_inverse=True)
                flat = [H.packed(v) for v in (np.diff(ref, prepend=0), tail[x] * 4 + side[x], sizes[docs], need[docs] + (1 << 20))]
                maps = [m[docs[kind[docs] == k]] for k, m in enumerate(bitmaps) if m is not None]
                out.append(
                    (
                        int(key[lo]),
                        struct.pack("<6q", hi - lo, len(docs), *map(len, flat))
                        + b"".join(flat)
                        + (h[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
                        + ids[docs].tobytes()
                        + b"".join(m.tobytes() for m in maps),
                    )
                )
            if out:
                keys, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["key", "data"])

    return run


def _read_index(payload: bytes):
    n, docs, *sizes = struct.unpack_from("<6q", payload)
    at, flat = 48, []
    for size, count in zip(sizes, (n, n, docs, docs), strict=True):
        flat.append(H.unpacked(payload[at : at + size], count))
        at += size
    token = np.frombuffer(payload, np.uint32, n, at)
    ids = np.frombuffer(payload, np.int64, docs, at + 4 * n)
    at += 4 * n + 8 * docs
    maps = []
    for k, bits in enumerate(BITMAPS):
        count = int((_bitmap_kind(flat[2]) == k).sum())
        maps.append(np.frombuffer(payload, np.uint64, count * bits // 64, at).reshape(count, bits // 64))
        at += count * bits // 8
    return token, np.cumsum(flat[0]), flat[1] >> 2, flat[1] & 3, ids, flat[2], flat[3] - (1 << 20), maps


def _pairs(batches):
    """The pairs of the lists of one group that position, size and bitmaps leave."""
    parts = [_read_index(x) for batch in batches for x in batch.column("data").to_pylist()]
    shift = np.cumsum([0] + [len(p[4]) for p in parts])
    token, tail, side, ids, size, need = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3, 4, 5, 6))
    doc = np.concatenate([p[1] + s for p, s in zip(parts, shift, strict=False)])
    maps = [np.concatenate([p[7][k] for p in parts]) for k in range(len(BITMAPS))]
    del parts
    kind = _bitmap_kind(size)
    rank, longer = [], None
    for k in reversed(range(len(BITMAPS))):  # a bitmap folded in half is the next shorter one
        rows = np.flatnonzero(kind >= k)
        whole = np.empty((len(rows), BITMAPS[k] // 64), np.uint64)
        whole[kind[rows] == k] = maps[k]
        if longer is not None:
            half = longer.shape[1] // 2
            whole[kind[rows] > k] = longer[:, :half] ^ longer[:, half:]
        maps[k] = longer = whole
        rank.insert(0, np.cumsum(kind >= k) - 1)
    spare = 3 * tail - need[doc]  # a partner may need at most this
    order = np.lexsort((-spare, token))
    token, doc, side, spare = token[order], doc[order], side[order], spare[order]
    number = np.cumsum(np.append(0, token[1:] != token[:-1])).astype(np.int64)
    wide = np.int64(1) << 32
    sorted_key = number * wide - spare
    last = np.searchsorted(sorted_key, number * wide - need[doc], "right")  # from here on the list is skipped
    counts = np.maximum(last - np.arange(len(token)) - 1, 0)
    ends = np.cumsum(counts)
    found, k = [], 0
    while k < len(counts):
        before = int(ends[k - 1]) if k else 0
        to = max(int(np.searchsorted(ends, before + PAIRS, "right")), k + 1)
        n = counts[k:to]
        a = np.repeat(np.arange(k, to), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(ends[k:to] - before - n, n)
        k = to
        x, y = doc[a], doc[b]
        keep = (spare[a] >= need[y]) & (x != y) & ((side[a] == 1) | (side[a] != side[b]))
        x, y = x[keep], y[keep]
        for level in range(len(BITMAPS)):
            both = np.flatnonzero((kind[x] >= level) & (kind[y] >= level))
            if not len(both):
                break
            p, q = x[both], y[both]
            apart = np.bitwise_count(maps[level][rank[level][p]] ^ maps[level][rank[level][q]]).sum(axis=1, dtype=np.int64)
            keep = np.ones(len(x), bool)
            keep[both] = 3 * (size[p] + size[q] - apart) >= 2 * (need[p] + need[q])
            x, y = x[keep], y[keep]
        if len(x):
            found.append(np.unique(np.minimum(x, y).astype(np.int64) << 32 | np.maximum(x, y)))
    found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    a, b = ids[found >> 32], ids[found & 0xFFFFFFFF]
    for lo in range(0, len(a), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[s], b[s])), pa.array(np.maximum(a[s], b[s]))], names=["leader_a", "leader_b"])


def _table(batches_of, fields: list[tuple]):
    schema = pa.schema(fields)
    return lambda table: pa.Table.from_batches(batches_of(table.to_batches()), schema)


def _families(docs: DataFrame, marks: DataFrame, sets) -> DataFrame:
    """``leader, post, size, plus, minus`` of families of more than one: what each has beyond its leader, and lacks.

    Leaders are members too. Only records that share their min-hash with another are looked at.
    """
    keys = marks.groupBy("family").agg(F.min("post").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    asked = written(marks.join(keys, "family").select("post", "leader", "size"), "asked")
    held = asked.join(sets(docs.join(asked.select(F.col("post").alias("doc_id")), "doc_id", "left_semi")), "post")
    leaders = held.where("post = leader").select("leader", F.col("tokens").alias("whole"), F.col("size").alias("full"))
    few = F.least(F.lit(FEW), F.floor(F.col("size") / 10))
    near = held.join(leaders, "leader").select(
        "leader", "post", "size", "full", F.array_except("tokens", "whole").alias("plus"), F.array_except("whole", "tokens").alias("minus")
    )
    near = near.where((F.size("plus") <= few) & (F.size("minus") <= FEW) & (F.abs(F.col("size") - F.col("full")) <= 2 * FEW))
    near = written(near.drop("full"), "near")
    wide = near.groupBy("leader").count().where("count > 1").select("leader")
    return near.join(wide, "leader", "left_semi")


def _common(x: str, y: str) -> str:
    return f"size(array_intersect({x}, {y}))"


def similar_pairs(
    records: DataFrame, id_column: str = "id", columns: tuple[str, ...] = ("title", "text"), length: int = 3, least_words: int = 12
) -> DataFrame:
    """All pairs of records at least half of whose ``length``-word sequences (of either) are in both.

    Words are runs of letters and digits of the columns in lower case; a null counts as empty. Records of fewer than
    ``least_words`` words have no partner, nor do rows without an id; rows that repeat an id count as one record, the one
    of longest text. Result: ``post_a, post_b`` with ``post_a < post_b``, each pair once.
    """
    if least_words < length + 9:
        raise ValueError("the bounds need records of at least ten sequences")
    raw = [F.col(c).cast("string").alias(f"part{k}") for k, c in enumerate(columns)]
    parts = [f"part{k}" for k in range(len(columns))]
    docs = records.select(F.col(id_column).cast("long").alias("doc_id"), *raw)
    docs = one_row_per_id(docs, F.concat_ws(" ", *(F.coalesce(F.col(p), F.lit("")) for p in parts)))
    text = lambda df, *more: df.select("doc_id", normal_text(*parts).alias("text"), *more)
    sets = lambda df: text(df).mapInArrow(_sets(length, least_words), "post long, tokens array<long>")

    bits = sketch_bits(scan_bytes(docs))
    first = written(text(docs).mapInArrow(_marks(length, least_words, bits), "key int, data binary, post long, size int, family long"), "marks")
    rows = first.where("key is not null").select("key", "data").groupBy("key").applyInArrow(_table(_levels(bits), [("key", pa.int32()), ("data", pa.binary())]), "key int, data binary")
    context = records.sparkSession.sparkContext
    levels = b"".join(bytes(r.data) for r in sorted(rows.collect(), key=lambda r: r.key)) or bytes(1 << bits)  # at most 2**23 bytes
    levels = context.broadcast(levels)
    families = written(_families(docs, first.where("post is not null").select("post", "size", "family"), sets), "families")
    bounds = families.groupBy("leader").agg(
        F.min(F.expr(f"cast(ceil(size / 2) as int) - size(plus) - cast(least({FEW}, floor(size / 5)) as int)")).alias("least_overlap"),
        F.min(F.expr("size - 3 * size(plus)")).alias("need"),
        F.count("*").alias("family_size"),
    )
    roles = families.where("post != leader").select("post", F.lit(True).alias("member"), F.lit(None).cast("int").alias("need"), F.lit(None).cast("int").alias("least_overlap"))
    roles = roles.unionByName(bounds.select(F.col("leader").alias("post"), F.lit(False).alias("member"), "need", "least_overlap"))
    leaders = docs.join(roles.withColumnRenamed("post", "doc_id"), "doc_id", "left").where("member is null or not member")
    groups = bucket_count(docs, 10 << 20, 6)
    found = text(leaders, "need", "least_overlap").mapInArrow(_index(length, least_words, groups, levels, bits), "key int, data binary")
    own = bounds.select(F.col("leader").alias("leader_a"), F.col("leader").alias("leader_b"))
    candidates = found.repartition(max(1, groups), "key").groupBy("key").applyInArrow(_table(_pairs, [("leader_a", pa.int64()), ("leader_b", pa.int64())]), "leader_a long, leader_b long").distinct()
    candidates = written(candidates.unionByName(own), "candidates")
    return _verified(candidates, docs, families, bounds, sets)


def similar_groups(
    records: DataFrame, id_column: str = "id", columns: tuple[str, ...] = ("title", "text"), length: int = 3, least_words: int = 12
) -> DataFrame:
    """``post, representative, links, group_id`` of every record with an id: its group by chains of alike records.

    ``representative`` is the smallest id with the same words in the same order, so copies are never paired with each
    other; ``links`` counts the different texts alike to it, and no link between different texts is left out. ``group_id``
    is the smallest id of the group. Records of fewer than ``least_words`` words stand alone; words, nulls and repeated ids
    are those of ``similar_pairs``.
    """
    parts = [f"part{k}" for k in range(len(columns))]
    docs = records.select(F.col(id_column).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(p) for c, p in zip(columns, parts, strict=True)))
    docs = one_row_per_id(docs, F.concat_ws(" ", *(F.coalesce(F.col(p), F.lit("")) for p in parts)))
    words = F.trim(normal_text(*parts))
    many = F.length(F.regexp_replace(words, "[^ ]", "")) >= least_words - 1
    prints = written(docs.select("doc_id", F.when(many, F.sha2(words, 256)).otherwise(F.concat(F.lit("#"), "doc_id")).alias("print")), "prints")
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies")), "classes")
    total, largest = classes.agg(F.sum("copies"), F.max("copies")).first()
    members = skew.joined(prints, classes, "print", "copies", total or 0, largest or 0).select("doc_id", "representative")
    first = docs.join(classes.select(F.col("representative").alias("doc_id")), "doc_id", "left_semi")
    pairs = written(similar_pairs(first, "doc_id", tuple(parts), length, least_words), "pairs")
    links = pairs.select(F.explode(F.array("post_a", "post_b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    roots = components(pairs, "post_a", "post_b").select(F.col("node").alias("representative"), F.col("root").alias("group_id"))
    known = links.join(roots, "representative")
    rows = members.join(known, "representative", "left")
    return rows.select(F.col("doc_id").alias("post"), "representative", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "representative").alias("group_id"))


def _verified(candidates: DataFrame, docs: DataFrame, families: DataFrame, bounds: DataFrame, sets) -> DataFrame:
    ids = candidates.select(F.explode(F.array("leader_a", "leader_b")).alias("doc_id")).distinct()
    held = sets(docs.join(ids, "doc_id", "left_semi")).withColumnRenamed("post", "leader").join(bounds, "leader", "left")
    held = written(held.select("leader", "tokens", F.size("tokens").alias("size"), F.coalesce("need", F.size("tokens")).alias("need"), F.coalesce("family_size", F.lit(1)).alias("family_size")), "held")
    side = lambda s: held.select(*(F.col(c).alias(f"{c}_{s}") for c in ("leader", "size", "tokens", "need", "family_size")))
    counted = (
        candidates.join(side("a"), "leader_a")
        .join(side("b"), "leader_b")
        .withColumn("common", F.expr(_common("tokens_a", "tokens_b")))
        .where("3 * common >= need_a + need_b")
        .select("leader_a", "leader_b", "size_a", "size_b", "common", F.expr("family_size_a > 1 or family_size_b > 1").alias("wide"))
    )
    counted = written(counted, "counted")
    alone = counted.where("not wide and 3 * common >= size_a + size_b").select(F.col("leader_a").alias("post_a"), F.col("leader_b").alias("post_b"))
    return alone.unionByName(_members(counted.where("wide"), families, held))


def _members(counted: DataFrame, families: DataFrame, held: DataFrame) -> DataFrame:
    """The alike pairs of two families' members, their overlaps derived from that of the leaders."""
    none = F.array().cast("array<long>")
    lone = held.where("family_size = 1").select("leader", F.col("leader").alias("post"), "size", none.alias("plus"), none.alias("minus"))
    sized = families.select("leader", "post", "size", "plus", "minus").unionByName(lone)
    sized = sized.join(held.select("leader", "family_size"), "leader")
    chunks = sized.groupBy("leader", F.expr(f"pmod(xxhash64(post), greatest(1, div(family_size, {FAMILY_CHUNK})))").alias("chunk")).agg(
        F.collect_list(F.struct("post", "size", "plus", "minus")).alias("group")
    )
    chunks = chunks.join(held.select("leader", "tokens"), "leader")
    side = lambda s: chunks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("leader", "chunk", "group", "tokens")))
    met = counted.select("leader_a", "leader_b", "common").join(side("a"), "leader_a").join(side("b"), "leader_b").where("leader_a != leader_b or chunk_a <= chunk_b")
    # |A and B'| for the members A of one leader and the other leader B', then what each B differs from B'
    ready = met.select(
        (F.expr("leader_a = leader_b and chunk_a = chunk_b")).alias("same"),
        F.expr(
            f"transform(group_a, m -> struct(m.post as post, m.size as size, m.plus as plus, m.minus as minus,"
            f" common - {_common('m.minus', 'tokens_b')} + {_common('m.plus', 'tokens_b')} as common))"
        ).alias("group_a"),
        F.expr(
            "transform(group_b, m -> struct(m.post as post, m.size as size, m.plus as plus, m.minus as minus,"
            " array_intersect(m.plus, tokens_a) as plus_there, array_intersect(m.minus, tokens_a) as minus_there))"
        ).alias("group_b"),
    )
    pairs = ready.select("same", "group_b", F.explode("group_a").alias("x")).select("same", "x", F.explode("group_b").alias("y"))
    gained = f"size(array_except(y.plus_there, x.minus)) + {_common('y.plus', 'x.plus')}"
    lost = f"size(array_except(y.minus_there, x.minus)) + {_common('y.minus', 'x.plus')}"
    return (
        pairs.where("(not same or x.post < y.post)")
        .where(f"3 * (x.common + {gained} - ({lost})) >= x.size + y.size")
        .select(F.least("x.post", "y.post").alias("post_a"), F.greatest("x.post", "y.post").alias("post_b"))
    )
