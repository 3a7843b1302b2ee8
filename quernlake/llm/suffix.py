"""Passages that repeat, by suffix sorting with bucket-pointer refinement.

``refine`` is the sorter: suffixes start in buckets of equal q-grams, and each bucket is refined by sorting its suffixes
on the bucket identifiers of the suffixes that start where their known common beginning ends.  Buckets near the
sequence's end (or that of its part) come first and are refined to the end, recursively, before the buckets that come
before them, which thus sort on identifiers that tell much more than a q-gram: mostly one sort of a bucket is enough.

Over a corpus, suffixes that can't be part of a repeat are never sorted.  Each window of ``MIN_WORDS`` words
is assigned to the q-gram with the least hash in it (winnowing): equal windows have equal q-grams, so only
q-grams that occur more than once matter.  Equal contexts of one q-gram that a task meets are repeats and are sent on
once; the others meet in one task for each q-gram, or, of q-grams in very many contexts, for each window, and are
sorted there.  Refinement reads eight bits of each word's hash; what still shares a bucket is a repeat if the 64-bit hashes
of the whole windows are equal too.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlake.llm import textvec
from quernlake.llm.tables import saved, texts

U64 = np.uint64
MIN_WORDS, Q = 50, 12
CHUNK = 1 << 15  # contexts that one refinement takes at a time
HOT = 1 << 14  # occurrences of a q-gram from which its windows meet one by one
SLABS = 64


def ranks(keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers: 0 for the suffixes with the least key, and so on."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def refine(bucket: np.ndarray, q: int, depth: int | None = None, left: np.ndarray | None = None, work: list[int] | None = None) -> np.ndarray:
    """Bucket identifiers of all suffixes of a sequence, given those of their first q items (in order).

    Identifiers are in the order of the suffixes.  Buckets are refined until each holds one suffix, so that they are
    the inverse of the suffix array; with ``depth``, until their suffixes share that many items at least.
    ``left`` says how many items a suffix has before what ends it (without it, the sequence's end does, which
    counts as an item below all).  ``work`` gets the number of suffixes of each sort.
    """
    n = len(bucket)
    bucket = bucket.astype(np.int64).copy()
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    bucket[order] = np.repeat(first, size)  # a bucket is named by its first place in the order
    known = np.full(n, q)  # items that the suffixes of a bucket share
    left = n - np.arange(n) if left is None else left
    # buckets in turn, those near the end first; of slabs of SLABS lengths the buckets are sorted together
    turn = np.maximum.reduceat(left[order], first) // max(q, -(-int(left.max()) // SLABS)) if n else first
    turn, open_ = np.repeat(turn, size)[np.repeat(size > 1, size)], order[np.repeat(size > 1, size)]
    by = np.argsort(turn, kind="stable")
    for part in np.split(open_[by], np.flatnonzero(np.diff(turn[by])) + 1):
        while True:
            if depth is not None:
                part = part[known[part] < depth]
            if not len(part):
                break
            if work is not None:
                work.append(len(part))
            later = part + known[part]
            inside = later < n
            later = np.minimum(later, n - 1)
            key = np.where(inside, bucket[later] + 1, 0)
            by = np.lexsort((key, bucket[part]))
            part, key = part[by], key[by]
            was = bucket[part]
            cut = np.r_[True, (was[1:] != was[:-1]) | (key[1:] != key[:-1])]
            start = np.flatnonzero(cut)
            group = np.flatnonzero(np.r_[True, was[1:] != was[:-1]])
            offset = start - np.repeat(group, np.diff(np.r_[np.searchsorted(start, group), len(start)]))
            size = np.diff(np.r_[start, len(part)])
            more = np.where(inside[by], known[later[by]], 0)
            bucket[part] = was + np.repeat(offset, size)
            known[part] += more
            part = part[np.repeat(size > 1, size)]
    return bucket


def suffix_array(items: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of integers (a shorter suffix sorts before its extensions)."""
    bucket = refine(ranks(items), 1)
    out = np.empty(len(items), np.int64)
    out[bucket] = np.arange(len(items))
    return out


def _selected(gram: np.ndarray, w: int) -> np.ndarray:
    """For each window of w q-grams the place of its least one, the last of equals."""
    m = len(gram) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    # least of power-of-two spans, then of two overlapping ones
    place, span = np.arange(len(gram)), 1
    best = place
    while span * 2 <= w:
        a, b = best[:-span], best[span:]
        best = np.where(gram[b] <= gram[a], b, a)
        span *= 2
    a, b = best[:m], best[w - span : w - span + m]
    return np.where(gram[b] <= gram[a], b, a)


def _runs(hashes: np.ndarray, least: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The q-grams that windows of one document are assigned to: hash, place, first and last window."""
    gram = textvec.grams(hashes, q, seed=7)
    chosen = _selected(gram, least - q + 1)
    if not len(chosen):
        none = np.zeros(0, np.int64)
        return none.astype(U64), none, none, none
    at = np.flatnonzero(np.r_[True, np.diff(chosen) != 0])
    return gram[chosen[at]], chosen[at], at, np.r_[at[1:], len(chosen)] - 1


def _anchors(least: int, q: int):
    """(anchor, doc_id, text_key): the q-grams of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for at, w in textvec.chunks(batch.column(1), "words", lower=True):
                for d in np.flatnonzero(np.diff(w.first) >= least):
                    h, _, _, _ = _runs(w.hashes[w.first[d] : w.first[d + 1]], least, q)
                    out[0].append(h)
                    out[1].append(np.full(len(h), ids[at + d]))
                    out[2].append(np.full(len(h), keys[at + d]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in out], names=["anchor", "doc_id", "text_key"])

    return run


def _contexts(least: int, q: int):
    """The contexts of the wanted anchors: words and windows of each that differs from those before it in this task.
    Of the others, and of the first of each that has such, only the span is passed on, without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        told: set[tuple[int, int]] = set()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            spans: list[tuple[int, int, int, int]] = []
            ids, keys, wanted, hot = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)
            for at, w in textvec.chunks(batch.column(1), "words", lower=True):
                for d in range(len(w.first) - 1):
                    hashes = w.hashes[w.first[d] : w.first[d + 1]]
                    gram, _, begin, end = _runs(hashes, least, q)
                    gram = gram.view(np.int64)
                    keep = np.flatnonzero(np.isin(gram, wanted[at + d].values.to_numpy()))
                    if not len(keep):
                        continue
                    window = textvec.grams(hashes, least, seed=3)
                    short = (hashes >> U64(56)).astype(np.uint8)
                    crowded = np.isin(gram[keep], hot[at + d].values.to_numpy()).tolist()
                    # a context is told by all its windows
                    total = np.r_[U64(0), np.cumsum(textvec.mix(window))]
                    ctx = textvec.mix(total[end[keep] + 1] - total[begin[keep]] + window[begin[keep]] * U64(3) + window[end[keep]] * U64(5)).tolist()
                    i, j = ids[at + d], keys[at + d]
                    for g, c, a, b, many in zip(gram[keep].tolist(), ctx, begin[keep].tolist(), end[keep].tolist(), crowded):
                        parts = [(g, c, a, b)] if not many else [(x, x, a + k, a + k) for k, x in enumerate(window[a : b + 1].view(np.int64).tolist())]
                        for anchor, mark, a, b in parts:
                            own, one = (anchor, mark), (i, j, a, b + least)
                            first = seen.setdefault(own, one)
                            if first is not one:
                                if first != one:  # else a repeated row
                                    spans.append(one)
                                    if own not in told:
                                        told.add(own)
                                        spans.append(first)
                                continue
                            for out, x in zip(rows, (anchor, i, j, a, short[a : b + least].tobytes(), window[a : b + 1].tobytes())):
                                out.append(x)
            for i, j, a, b in spans:
                for out, x in zip(rows, (j ^ a, i, j, a, None, struct.pack("<q", b))):
                    out.append(x)
            kinds = (*[pa.int64()] * 4, pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names=["anchor", "doc_id", "text_key", "begin", "words", "windows"])

    return run


def _repeats(anchor: np.ndarray, doc: np.ndarray, key: np.ndarray, begin: np.ndarray, words: list[bytes], windows: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that repeat, of contexts sorted by anchor: context, first start, last start; and
    the contexts in which some window comes first of its equals."""
    size = np.array([len(x) for x in words])
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    edge = np.r_[0, np.cumsum(size)]
    starts = size - least + 1
    which = np.repeat(np.arange(len(words)), starts)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = edge[which] + inside
    # initial buckets: eight words of a byte are one integer
    pad = np.r_[flat.astype(U64), np.zeros(8, U64)]
    gram = np.zeros(len(flat), U64)
    for k in range(8):
        gram = gram << U64(8) | pad[k : k + len(flat)]
    left = np.repeat(edge[1:], size) - np.arange(len(flat))
    bucket = refine(ranks(gram), 8, least, left)[at]
    # suffixes that begin alike are neighbours in the order: equal first words, one class
    order = np.argsort(bucket, kind="stable")
    alike = textvec.grams(flat.astype(U64), least, seed=9)[at[order]] if len(at) else np.zeros(0, U64)
    cls = np.empty(len(at), np.int64)
    cls[order] = np.cumsum(np.r_[0, alike[1:] != alike[:-1]])[: len(at)]
    whole, group = np.frombuffer(b"".join(windows), dtype=U64), np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])[: len(anchor)][which]
    by = np.lexsort((begin[which] + inside, key[which], doc[which], whole, cls, group))
    differs = lambda x: x[by][1:] != x[by][:-1]
    change = np.r_[True, differs(cls) | differs(whole) | differs(group)] if len(by) else np.zeros(0, bool)
    other = np.r_[True, differs(doc[which]) | differs(key[which]) | differs(begin[which] + inside)] | change if len(by) else change  # a repeated row is no repeat
    first = np.flatnonzero(change)
    many = np.add.reduceat(other.astype(np.int64), first) > 1 if len(by) else change
    again = np.zeros(len(at), bool)
    again[by] = np.repeat(many, np.diff(np.r_[first, len(by)]))
    run = np.flatnonzero(again & np.r_[True, ~again[:-1] | (which[1:] != which[:-1])]) if len(at) else np.zeros(0, np.int64)
    stop = np.flatnonzero(again & np.r_[~again[1:] | (which[1:] != which[:-1]), True]) if len(at) else np.zeros(0, np.int64)
    return which[run], inside[run], inside[stop], np.unique(which[by[change]])


def _sort(least: int):
    """Reads contexts in the order of their anchors, and refines some thousands at once.  Of an anchor with
    more than fit, the contexts in which windows were first seen are carried on, so that later ones meet them."""
    names = ["doc_id", "text_key", "start_word", "end_word"]

    def flush(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        anchor, doc, key, begin = (table.column(k).to_numpy() for k in range(4))
        which, a, b, first = _repeats(anchor, doc, key, begin, table.column(4).to_pylist(), table.column(5).to_pylist(), least)
        out = [doc[which], key[which], begin[which] + a, begin[which] + b + least]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names), first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        grown = CHUNK
        for batch in batches:
            known = batch.filter(batch.column(4).is_null())
            if len(known):
                ends = pa.array(np.frombuffer(b"".join(known.column(5).to_pylist()), np.int64))
                yield pa.RecordBatch.from_arrays([known.column(1), known.column(2), known.column(3), ends], names=names)
            piece = pa.Table.from_batches([batch.filter(batch.column(4).is_valid())])
            held = piece if held is None else pa.concat_tables([held, piece])
            if len(held) < grown:
                continue
            out, first = flush(held)
            yield out
            anchor = held.column(0).to_numpy()
            last = np.flatnonzero(anchor == anchor[-1])
            held = held.take(pa.array(np.intersect1d(last, first)))
            grown = max(CHUNK, 2 * len(held))
        if held is not None and len(held):
            yield flush(held)[0]

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, q: int = Q) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the stretches of a document that are covered by windows of
    ``min_words`` words which occur elsewhere in the corpus, or in the same document again.

    Words are lower-cased runs of letters, digits, ``_`` and non-ASCII characters, counted from 0; ``end_word``
    is the first word after the stretch.  Null, empty and shorter texts have none.  A repeated row (same id and
    text) counts once; rows with a null ``doc_id`` are left out.  Extra columns are ignored, an empty table
    gives no row.
    """
    rows = texts(docs.where("doc_id is not null and text is not null")).withColumn("text_key", F.xxhash64("text"))
    anchors = saved(rows.mapInArrow(_anchors(min_words, q), "anchor bigint, doc_id bigint, text_key bigint"), "anchors")
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    # one row an anchor on the right: an anchor of very many occurrences is split over tasks by adaptive execution
    wanted = anchors.join(often.select("anchor", (F.col("n") > HOT).alias("hot")), "anchor")
    wanted = wanted.groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    marked = wanted.join(rows, ["doc_id", "text_key"]).select("doc_id", "text", "text_key", "anchors", "hot")
    contexts = marked.mapInArrow(_contexts(min_words, q), "anchor bigint, doc_id bigint, text_key bigint, begin bigint, words binary, windows binary")
    found = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort(min_words), "doc_id bigint, text_key bigint, start_word bigint, end_word bigint")
    return merged(found, ["doc_id", "text_key"]).drop("text_key")


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping spans (start_word, end_word) of the same keys as one."""
    before = Window.partitionBy(*keys).orderBy("start_word", "end_word")
    reach = F.max("end_word").over(before.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(F.col("start_word") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    island = island.withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*keys, "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return out.select(*keys, "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
