"""Token counts of a byte-level BPE vocabulary, with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, offline, by running the merges on each of them
(:func:`whole_tokens`): merging the bytes of such a string by rank ends in that very token.  A pre-token that
is such a string counts as one, by a table lookup; only the rest is merged.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMORY = 1 << 19  # merged pre-tokens that a worker remembers


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Byte-pair merging by rank: the adjacent pair of the least rank, leftmost first, until none is left."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            r = ranks.get(parts[k] + parts[k + 1])
            if r is not None and (best is None or r < best):
                best, at = r, k
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def whole_tokens(ranks: dict[bytes, int]) -> set[bytes]:
    """The vocabulary strings that the merges alone turn into one token."""
    return {token for token in ranks if len(token) == 1 or len(merge(token, ranks)) == 1}


class Counter(dict):
    """Tokens of a pre-token.  Starts with the proved whole tokens; others are merged when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.whole = {}
        for token in whole_tokens(ranks):
            try:
                self.whole[token.decode()] = 1
            except UnicodeDecodeError:  # a part of a character: no pre-token is that
                pass
        self.update(self.whole)

    def __missing__(self, piece: str) -> int:
        if len(self) > MEMORY + len(self.whole):
            self.clear()
            self.update(self.whole)
        n = self[piece] = len(self.encoding._encode_single_piece(piece.encode()))
        return n

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of a text, and the pre-tokens that were whole tokens."""
        pieces = self.split(text)
        counts = list(map(self.__getitem__, pieces))
        return sum(counts), counts.count(1)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(load_ranks(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_whole): tokens of each row's text, and how many of its pre-tokens are one token.

    ``vocabulary`` is a file of ranks that every worker can read.  A null text has null counts, an empty one 0.
    Strings of special tokens are ordinary text.  Each row has its row in the result, repeated ones and those with a
    null ``doc_id`` too.  Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            found = [(None, None) if t is None else own.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))], names=["doc_id", "n_tokens", "n_whole"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_whole bigint")
