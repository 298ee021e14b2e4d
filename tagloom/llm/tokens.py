"""Exact token counts under a public byte-level BPE, without encoding every text.

The tokenizer's pattern never lets a token reach from a word over the white space after it. So a text's count is the sum of
the counts of its pieces "white space and the word after it"; each different piece is encoded once per worker.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter everywhere, never part of the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode white space, which that pattern's \s means (Python's own has four control characters more).
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Pieces a worker remembers at most; beyond that it starts anew, which changes only the time taken.
REMEMBERED = 400_000


def encoding(vocabulary: str | bytes):
    """The tokenizer of a vocabulary file, given by its path or its content."""
    import tiktoken

    data = vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Counts the tokens of texts; null counts 0."""

    def __init__(self, vocabulary: str | bytes = VOCABULARY):
        self.encode = encoding(vocabulary).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        pieces = _PIECE.findall(text)
        if len(known) > REMEMBERED:
            known.clear()
        for piece, times in Counter(pieces).items():
            n = known.get(piece)
            if n is None:
                # a very long piece is counted, not remembered
                n = len(self.encode(piece))
                if len(piece) <= 64:
                    known[piece] = n
            total += n * times
        return total


def token_sizes(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of ``text`` (0 for null).

    The driver reads the vocabulary file, a few MB at most, and sends it along; the workers need no such file.
    """
    data = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", tokens long"

    def run(batches):
        counter = TokenCounter(data.value)
        for batch in batches:
            sizes = [counter.count(x) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)
