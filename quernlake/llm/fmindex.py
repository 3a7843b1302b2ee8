"""Benchmark decontamination with an FM-index of each training shard.

A shard is a run of whole documents.  Its word sequence is indexed over the alphabet of the benchmark's words;
any other word can't be part of an occurrence, so a run of those is one separator.  The Burrows-Wheeler transform of
the sequence lies in a wavelet matrix, whose ranks drive the backward search of all test phrases at once;
occurrences are located by walking back to sampled suffix positions, and their spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.llm import textvec
from quernlake.llm.suffix import refine
from quernlake.llm.tables import fresh

U64 = np.uint64
PHRASE, SAMPLE, SHARD = 8, 16, 1 << 19  # words of a phrase, distance of sampled suffixes, symbols of an index
SEPARATOR = 1  # symbol 0 is the end of the sequence


class Ranks:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view(U64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(U64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((U64(1) << bit) - U64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1)


class Wavelet:
    """Wavelet matrix: a bit vector for each bit of the symbols, zeros moved before ones level by level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, Ranks, int]] = []
        for bit in reversed(range(max(1, int(top).bit_length()))):
            one = ((symbols >> bit) & 1).astype(bool)
            self.levels.append((bit, Ranks(one), int(len(one) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        begin = np.zeros(len(at), np.int64)
        for bit, ranks, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = ranks.ones(begin), ranks.ones(at)
            begin, at = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, at - b)
        return at - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol, begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for bit, ranks, zeros in self.levels:
            one = ranks.get(at).astype(bool)
            a, b = ranks.ones(begin), ranks.ones(at)
            begin, at = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, at - b)
            symbol |= one.astype(np.int64) << bit
        return symbol, at - begin


class FMIndex:
    """Index of a sequence of symbols from 1 up."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        symbols = np.r_[symbols, 0].astype(np.int64)
        n, self.top = len(symbols), int(symbols.max())
        width = max(1, self.top.bit_length())
        q = max(1, 62 // width)
        key = np.zeros(n, np.int64)
        for k in range(q):
            key <<= width
            key[: max(0, n - k)] |= symbols[k:]
        bucket = refine(np.unique(key, return_inverse=True)[1] if q == 1 else key, q)
        order = np.empty(n, np.int64)
        order[bucket] = np.arange(n)
        self.wavelet = Wavelet(symbols[order - 1], self.top)
        self.less = np.r_[0, np.cumsum(np.bincount(symbols, minlength=self.top + 1))]
        sampled = order % sample == 0
        self.sampled, self.positions = Ranks(sampled), order[sampled]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sorted suffixes that begin with each phrase (phrases: one a row, 0 fills up the left)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in phrases.T[::-1]:
            live = np.flatnonzero((column > 0) & (hi > lo))
            symbol = column[live]
            known = symbol <= self.top
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], symbol[known]
            if len(live):
                r = self.wavelet.rank(np.r_[symbol, symbol], np.r_[lo[live], hi[live]])
                lo[live], hi[live] = self.less[symbol] + r[: len(live)], self.less[symbol] + r[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the sorted suffixes."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            there = self.sampled.get(rows).astype(bool)
            out[live[there]] = self.positions[self.sampled.ones(rows[there])] + steps[live[there]]
            live, rows = live[~there], rows[~there]
            if len(live):
                symbol, rank = self.wavelet.access(rows)
                rows = self.less[symbol] + rank
                steps[live] += 1
        return out


class Phrases:
    """The benchmark's phrases: each run of ``n`` words of an item, or a shorter item as a whole."""

    def __init__(self, items: list[tuple[int, str]], n: int = PHRASE):
        words = [(i, textvec.hash_words(t or "")) for i, t in items]
        self.vocabulary = np.unique(np.concatenate([w for _, w in words] + [np.zeros(0, U64)]))
        rows: dict[tuple, set[int]] = {}
        for i, w in words:
            symbols = np.searchsorted(self.vocabulary, w) + SEPARATOR + 1
            for k in range(max(1, len(symbols) - n + 1) if len(symbols) else 0):
                part = symbols[k : k + n]
                rows.setdefault((0,) * (n - len(part)) + tuple(part.tolist()), set()).add(i)
        self.items = list(rows.values())
        self.table = np.array(list(rows), dtype=np.int64).reshape(-1, n)
        self.length = (self.table > 0).sum(axis=1)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; SEPARATOR for words that the benchmark doesn't have."""
        if not len(self.vocabulary):
            return np.full(len(hashes), SEPARATOR)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + SEPARATOR + 1, SEPARATOR)


def occurrences(index: FMIndex, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of all occurrences in a shard."""
    lo, hi = index.search(phrases.table)
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    rows = np.repeat(lo, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, index.locate(rows)


class _Shard:
    """Symbols of documents in turn, with what leads back to their words and bytes."""

    def __init__(self) -> None:
        self.n, self.parts, self.documents = 0, [], []

    def add(self, tag: tuple, symbols: np.ndarray) -> None:
        keep = np.r_[True, (symbols[1:] != SEPARATOR) | (symbols[:-1] != SEPARATOR)] if len(symbols) else np.zeros(0, bool)
        kept = np.flatnonzero(keep)
        self.documents.append((self.n, tag, kept.astype(np.int32)))
        self.parts += [symbols[kept], [SEPARATOR]]
        self.n += len(kept) + 1

    def spans(self, phrases: Phrases) -> Iterator[tuple]:
        """(tag, merged spans as (first word, end word, items)) of each document that has any."""
        if not self.documents or not len(phrases.table):
            return
        which, at = occurrences(FMIndex(np.concatenate(self.parts)), phrases)
        begin = np.array([d[0] for d in self.documents])
        owner = np.searchsorted(begin, at, side="right") - 1
        by = np.lexsort((at, owner))
        for d, group in _grouped(owner[by], by):
            first, tag, kept = self.documents[d]
            out: list[list] = []
            for k in group:
                a = int(kept[at[k] - first])
                b = a + int(phrases.length[which[k]])
                if out and a <= out[-1][1]:
                    out[-1][1] = max(b, out[-1][1])
                    out[-1][2] |= phrases.items[which[k]]
                else:
                    out.append([a, b, set(phrases.items[which[k]])])
            yield tag, [(a, b, sorted(i)) for a, b, i in out]


def _grouped(sorted_keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cut = np.flatnonzero(np.diff(sorted_keys)) + 1
    for part_keys, part in zip(np.split(sorted_keys, cut), np.split(values, cut)):
        if len(part):
            yield int(part_keys[0]), part


def _shards(batches: Iterator[pa.RecordBatch], phrases: Phrases, column: int, size: int = SHARD) -> Iterator[Iterator[tuple]]:
    """Yields, shard by shard, the spans of its documents; a tag is (batch, row)."""
    shard = _Shard()
    for batch in batches:
        for at, w in textvec.chunks(batch.column(column), "words", lower=True):
            symbols = phrases.symbols(w.hashes)
            live = np.add.reduceat(np.r_[symbols != SEPARATOR, False], np.minimum(w.first[:-1], len(symbols))) if len(w.first) > 1 else []
            for d in range(len(w.first) - 1):
                a, b = w.first[d], w.first[d + 1]
                if a == b or not live[d]:
                    continue
                shard.add((batch, at + d), symbols[a:b])
            if shard.n >= size:
                yield shard.spans(phrases)
                shard = _Shard()
    yield shard.spans(phrases)


def _items(benchmark: DataFrame) -> list[tuple[int, str]]:
    """The test items.  They come to the driver: a benchmark is a fixed set, which doesn't grow with the corpus."""
    return [(r[0], r[1]) for r in benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint"), "text").collect()]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, items): merged stretches of a document in which each run of n
    words (or a whole shorter item) stands in the benchmark too, with the ids of the items.

    Words are those of the other operators.  Null and empty texts have none, nor has any document if the
    benchmark is empty.  Rows with a null ``doc_id`` are searched too and reported with null; a repeated row
    is reported again.  Null items are no phrases; repeated ones count once.  Extra columns are ignored.
    """
    items = _items(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, n)
        for found in _shards(batches, phrases, 1):
            rows = [(tag[0].column(0)[tag[1]].as_py(), a, b, b - a, i) for tag, spans in found for a, b, i in spans]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "start_word", "end_word", "n_words", "items"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, start_word bigint, end_word bigint, n_words bigint, items array<bigint>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE) -> DataFrame:
    """``docs`` with the contaminated spans cut from ``text``, and ``n_chars``, if it is an integer, set to the new length.

    A document of which no word is left goes; one that had no word from the start stays.  All other columns and
    rows are as they were, nulls included."""
    items, schema, columns = _items(benchmark), docs.schema, docs.columns
    text = columns.index("text")
    counted = columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("tinyint", "smallint", "int", "bigint") else None

    def cut(value: str, spans: list[tuple]) -> str:
        data, out, at = value.encode(), [], 0
        words = textvec.tokenize(np.frombuffer(data, np.uint8), np.array([0, len(data)]), "words")
        for a, b, _ in spans:
            out.append(data[at : words.starts[a]])
            at = words.ends[b - 1]
        return b"".join([*out, data[at:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, held = Phrases(items, n), []
        done: dict[int, dict[int, list]] = {}

        def keep() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, len(whole), 512):
                    held.append(whole.slice(k, 512))
                    yield held[-1]

        for found in _shards(keep(), phrases, text):
            change: dict[int, dict[int, list]] = {}
            for (batch, row), spans in found:
                change.setdefault(id(batch), {})[row] = spans
            # a batch of which a part belongs to the next shard waits for it
            pending = [(b, change.get(id(b), {})) for b in held]
            for b, rows in pending:
                done.setdefault(id(b), {}).update(rows)
            for b in held[:-1]:
                yield edit(b, done.pop(id(b), {}))
            del held[:-1]
        for b in held:
            yield edit(b, done.pop(id(b), {}))

    def edit(batch: pa.RecordBatch, rows: dict[int, list]) -> pa.RecordBatch:
        if not rows:
            return batch
        at = sorted(rows)
        values = [cut(batch.column(text)[row].as_py(), rows[row]) for row in at]
        mask = np.zeros(len(batch), bool)
        mask[at] = True
        arrays = list(batch.columns)
        arrays[text] = pc.replace_with_mask(arrays[text], pa.array(mask), pa.array(values, arrays[text].type))
        if counted is not None:
            k = counted
            arrays[k] = pc.replace_with_mask(arrays[k], pa.array(mask), pa.array([len(v) for v in values], arrays[k].type))
        mask[at] = [not len(textvec.hash_words(v)) for v in values]
        out = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
        return out.filter(pa.array(~mask)) if mask.any() else out

    return docs.mapInArrow(run, schema)


def benchmark_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
