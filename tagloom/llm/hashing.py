"""Vectorised word and window hashes over Arrow text columns (numpy only, no per-word Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Odd multipliers of the word hash and of the two window lanes.
WORD_BASE = np.uint64(0x9E3779B97F4A7C13)
LANE_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642B))
#: Bytes hashed at once, so that memory does not follow the length of a text.
SPAN = 2 << 20

_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[9, 10, 13, 32]] = True


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(max(n, 1), base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of every text, in order, and the number of words of each text.

    Words are the longest runs of characters other than blank, tab, line feed and carriage return;
    a null text has none.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64, n + 1, texts.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    if high == low:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    data = np.frombuffer(data_buffer, np.uint8, high - low, low)
    offsets = offsets - low
    word = ~_BLANKS[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = word[at]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    edges = np.append(starts, len(data))
    out = np.empty(len(starts), np.uint64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            to = max(int(np.searchsorted(edges, edges[k] + SPAN, "right")) - 1, k + 1)
            lo, hi = int(edges[k]), int(edges[to])
            begin = edges[k:to]
            lengths = np.diff(edges[k : to + 1])
            place = np.arange(lo, hi) - np.repeat(begin, lengths)
            value = (data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(WORD_BASE, int(lengths.max()))[place]
            value[~word[lo:hi]] = 0
            out[k:to] = np.add.reduceat(value, begin - lo)
            k = to
    return mixed(out), counts


def window_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """The Rabin-Karp polynomial of every window of ``length`` hashes; windows across text borders included.

    The polynomial of 2m terms is put together from two of m terms, which costs log(length) passes.
    """
    if len(words) < length:
        return np.zeros(0, np.uint64)
    base = LANE_BASES[lane]
    w = mixed(words, 0x51ED270B * (lane + 1))
    with np.errstate(over="ignore"):
        part, size, power = w, 1, base
        done, covered, rest = None, 0, length
        while rest:
            if rest & 1:
                if done is None:
                    done, covered = part, size
                else:  # the part before, `covered` terms after
                    shifted = _power(base, covered)
                    m = len(words) - (covered + size) + 1
                    done = part[:m] * shifted + done[size : size + m]
                    covered += size
            rest >>= 1
            if rest:
                m = len(words) - 2 * size + 1
                part = part[:m] * power + part[size : size + m]
                size, power = size * 2, power * power
    return mixed(done[: len(words) - length + 1])


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**32 as compressed byte planes; ``unpacked`` gives them back."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, n * 4, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def blocks(batches, text_column: str, most_bytes: int):
    """Slices of the batches holding up to ``most_bytes`` of text each, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        k = 0
        while k < batch.num_rows:
            before = int(ends[k - 1]) if k else 0
            to = max(int(np.searchsorted(ends, before + most_bytes, "right")), k + 1)
            yield batch.slice(k, to - k)
            k = to
