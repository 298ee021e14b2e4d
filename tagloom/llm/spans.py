"""Problem 9: long exact spans shared between records.

Every window of ``length`` words gets a Rabin-Karp hash of 96 bits. Equal windows within one block of texts are
merged before the shuffle, so a passage held by a third of all rows sends one entry per block. The entries are
spread over hash ranges, counted there, and the windows found more than once go back to their blocks, where
they are merged into maximal intervals. Texts are never shuffled and no fingerprint reaches the driver.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import hashing as H
from tagloom.session import scan_bytes, written

ROWS = "key int, block long, kind int, data binary"
ARROW = pa.schema([("key", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
ENTRIES, INDEX, REPLY = 0, 1, 2
#: Bytes of text handled at once; bounds a Python worker's memory.
BLOCK_BYTES = 4 << 20
#: Ranges up to which they are of the least size, and the text of one range at most (a task's Python memory is about ten times that).
COMFORT, RANGE_BYTES = 15_000, 64 << 20
#: Hash ranges of one task, and at most in all: what a 32-bit key can name, enough for 4,000 TB.
RANGES_PER_TASK, MOST_BUCKETS = 4, (1 << 31) - 1


def bucket_count(df: DataFrame, bytes_each: int = 2 << 20, least: int = 48) -> int:
    """Hash ranges: in proportion to the input, so that a range stays of a bounded size.

    A block sends an entry to every range; beyond COMFORT ranges these get so small that ranges grow instead, up to RANGE_BYTES.
    """
    size = scan_bytes(df)
    each = max(bytes_each, min(RANGE_BYTES, size // COMFORT))
    return int(min(max(least, size // each), MOST_BUCKETS))


def by_range(rows: DataFrame, column: str, buckets: int) -> DataFrame:
    """Spread over tasks of a few hash ranges each, however many partitions the session shuffles into."""
    return rows.repartition(max(1, -(-buckets // RANGES_PER_TASK)), column)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _windows_of(length: int, buckets: int):
    def run(batches):
        context = TaskContext.get()
        block = ((context.partitionId() if context else 0) << 32) - 1
        for part in H.blocks(batches, "text", BLOCK_BYTES):
            block += 1
            words, counts = H.word_hashes(part.column("text"))
            n = np.maximum(counts - (length - 1), 0)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            keep = n > 0
            if not keep.any():
                continue
            offsets = np.cumsum(counts) - counts
            total = int(n.sum())
            base = np.cumsum(n) - n
            at = np.arange(total) + np.repeat(offsets - base, n)
            h1 = H.window_hashes(words, length)[at]
            h2 = (H.window_hashes(words, length, 1)[at] >> np.uint64(32)).astype(np.uint32)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            order = np.lexsort((h2, h1)) if _clash(h1, h2) else np.argsort(h1, kind="stable")
            a, b = h1[order], h2[order]
            new = np.ones(total, bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            heads = np.flatnonzero(new)
            first = np.minimum.reduceat(order, heads)
            many = np.maximum.reduceat(doc[order], heads) != doc[first]
            # where a window repeats one before it in the block, it points there
            source = np.empty(total, np.int64)
            source[order] = np.repeat(first, np.diff(np.append(heads, total)))
            repeats = np.flatnonzero(source != np.arange(total))
            run_start, run_length = _runs(repeats, source[repeats])
            index = [
                struct.pack("<qqq", int(keep.sum()), len(run_start), total),
                ids[keep].astype("<i8").tobytes(),
                n[keep].astype("<i8").tobytes(),
                run_start.astype("<i8").tobytes(),
                source[run_start].astype("<i8").tobytes(),
                run_length.astype("<i8").tobytes(),
            ]
            rows = [(int(block % buckets), block, INDEX, pa.compress(b"".join(index), codec="zstd", asbytes=True), sum(map(len, index)))]
            firsts = np.sort(first)
            flag = np.zeros(total, bool)
            flag[first[many]] = True
            key = ((h1[firsts] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            by = np.argsort(key, kind="stable")
            firsts, key = firsts[by], key[by]
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            out = [(r[0], r[1], r[2], struct.pack("<q", r[4]) + r[3]) for r in rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                some = firsts[lo:hi]
                step = np.diff(some, prepend=0)
                refs = H.packed(step * 2 + flag[some])
                out.append((int(key[lo]), block, ENTRIES, struct.pack("<qq", hi - lo, len(refs)) + refs + h1[some].tobytes() + h2[some].tobytes()))
            yield _batch(out)

    return run


def _clash(h1: np.ndarray, h2: np.ndarray) -> bool:
    """Whether one first lane stands beside two second lanes, so that sorting by the first is not enough."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    return bool(((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any())


def _runs(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches over which position and target go up together."""
    if not len(at):
        return at, at
    new = np.append(True, (np.diff(at) != 1) | (np.diff(to) != 1))
    starts = np.flatnonzero(new)
    return at[starts], np.diff(np.append(starts, len(at)))


def _count(table: pa.Table) -> pa.Table:
    kinds, blocks, data = (table.column(c).to_pylist() for c in ("kind", "block", "data"))
    out, h1, h2, who, ordinals, flags = [], [], [], [], [], []
    for kind, block, payload in zip(kinds, blocks, data, strict=True):
        if kind == INDEX:
            out.append((0, block, INDEX, payload))
            continue
        n, size = struct.unpack_from("<qq", payload)
        refs = H.unpacked(payload[16 : 16 + size], n)
        ordinals.append(np.cumsum(refs >> 1))
        flags.append((refs & 1).astype(bool))
        h1.append(np.frombuffer(payload, np.uint64, n, 16 + size))
        h2.append(np.frombuffer(payload, np.uint32, n, 16 + size + 8 * n))
        who.append(np.full(n, block, np.int64))
    if h1:
        a, b, w, o, f = (np.concatenate(x) for x in (h1, h2, who, ordinals, flags))
        del h1, h2, who, ordinals, flags
        order = np.argsort(a, kind="stable")
        x, y = a[order], b[order]
        if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
            order = np.lexsort((b, a))
            x, y = a[order], b[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        hit = f[order]
        hit[1:] |= same
        hit[:-1] |= same
        found = order[hit]
        w, o = w[found], o[found]
        order = np.lexsort((o, w))
        w, o = w[order], o[order]
        cuts = np.append(np.flatnonzero(np.append(True, w[1:] != w[:-1])), len(w)) if len(w) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            out.append((0, int(w[lo]), REPLY, struct.pack("<q", hi - lo) + H.packed(np.diff(o[lo:hi], prepend=0))))
    return pa.Table.from_batches([_batch(out)])


def _merge(length: int):
    def run(table: pa.Table) -> pa.Table:
        hits, index = [], None
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind == INDEX:
                index = payload
            else:
                (n,) = struct.unpack_from("<q", payload)
                hits.append(np.cumsum(H.unpacked(payload[8:], n)))
        (size,) = struct.unpack_from("<q", index)
        raw = pa.decompress(index[8:], size, codec="zstd", asbytes=True)
        docs, runs, total = struct.unpack_from("<qqq", raw)
        ids, n, starts, sources, lengths = np.split(np.frombuffer(raw, "<i8", offset=24), np.cumsum([docs, docs, runs, runs]))
        shared = np.zeros(total, bool)
        if hits:
            shared[np.concatenate(hits)] = True
        for start, source, k in zip(starts, sources, lengths, strict=True):  # in order: a source lies before its copy
            shared[start : start + k] = shared[source : source + k]
        at = np.flatnonzero(shared)
        base = np.cumsum(n) - n
        doc = np.searchsorted(base, at, "right") - 1
        place = at - base[doc]
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (np.diff(place) > length)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1 if len(at) else heads
        every = np.arange(docs)
        return pa.table(
            {
                "doc_id": pa.array(np.append(ids[doc[heads]], ids), pa.int64()),
                "first_word": pa.array(np.append(place[heads], np.full(docs, -1)), pa.int64()),
                "last_word": pa.array(np.append(place[tails] + length - 1, n[every] + length - 2), pa.int64()),
            }
        )

    return run


def one_row_per_id(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """Rows with an id; of several rows of one id the longest, then greatest text. Costs a pass over the ids only."""
    docs = docs.where(F.col("doc_id").isNotNull())
    twice = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.limit(1).count():
        return docs
    text = F.col("text") if text is None else text
    rest = [c for c in docs.columns if c != "doc_id"]
    order = F.struct(F.length(text), text, *rest)
    chosen = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct(*rest), order).alias("row")).select("doc_id", "row.*")
    # as a table, so that a task run again after a loss meets the same rows in the same order
    return written(docs.join(twice, "doc_id", "left_anti").unionByName(chosen), "ids")


def _spans_and_ends(documents: DataFrame, length: int, id_column: str, text_column: str) -> DataFrame:
    docs = one_row_per_id(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    buckets = bucket_count(docs)
    entries = docs.mapInArrow(_windows_of(length, buckets), ROWS)
    replies = by_range(entries, "key", buckets).groupBy("key").applyInArrow(_count, ROWS)
    return by_range(replies, "block", buckets).groupBy("block").applyInArrow(_merge(length), "doc_id long, first_word long, last_word long")


def shared_spans(documents: DataFrame, length: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Maximal runs of words that lie in windows of ``length`` words standing in another document too.

    Words are the longest runs of characters other than blank, tab, line feed and carriage return, numbered from 0.
    Result: ``doc_id, first_word, last_word``. A null text has no words; rows without an id are left out; rows that
    repeat an id count as one document, the one of longest text. Windows repeated within one document only are not shared.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    return _spans_and_ends(documents, length, id_column, text_column).where("first_word >= 0")


def shared_shares(documents: DataFrame, length: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each document of at least ``length`` words: its words, those in shared spans and their share.

    Result: ``doc_id, words, shared_words, spans, share``.
    """
    rows = _spans_and_ends(documents, length, id_column, text_column)
    span = F.col("first_word") >= 0
    return (
        rows.groupBy("doc_id")
        .agg(
            F.max(F.when(~span, F.col("last_word") + 1)).alias("words"),
            F.coalesce(F.sum(F.when(span, F.col("last_word") - F.col("first_word") + 1)), F.lit(0)).alias("shared_words"),
            F.count(F.when(span, 1)).alias("spans"),
        )
        .withColumn("share", F.col("shared_words") / F.col("words"))
    )


def document_shares(documents: DataFrame, length: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``shared_shares`` of every document: those of fewer than ``length`` words, null texts too, have no spans and share 0."""
    docs = one_row_per_id(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != ""))
    shares = shared_shares(docs, length, "doc_id", "text").withColumnRenamed("words", "own")
    rows = docs.select("doc_id", words.cast("long").alias("words")).join(shares, "doc_id", "left")
    zero = {"shared_words": 0, "spans": 0, "share": 0.0}
    return rows.select("doc_id", F.coalesce("own", "words").alias("words"), *(F.coalesce(c, F.lit(z)).alias(c) for c, z in zero.items()))
