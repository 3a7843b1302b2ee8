"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

It is trained in one task, on a bounded sample.  A document is the average of learned vectors of its features: hashed words, hashed character n-grams (of the
bytes, case kept, across word boundaries) and, as a bigram of equal words has one meaning whatever the word, one
feature for an immediately repeated word.  A softmax layer follows.  As that layer is linear, scoring needs only
one number for each hash bucket and class, so a corpus is scored by table lookups on whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm import textvec
from quernlake.llm.tables import texts

U64 = np.uint64
BUCKETS, DIM, NGRAMS = 1 << 16, 12, (3, 5)
SAMPLE, EPOCHS, RATE, REJECT = 6000, 6, 0.5, 0.5


def _features(w: textvec.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of each word, of each byte place, and whether a word repeats the one before."""
    word = (w.hashes % U64(BUCKETS)).astype(np.int64)
    again = np.zeros(len(word), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    grams = []
    data = w.buffer.astype(np.uint32)
    for n in NGRAMS:
        m = max(0, len(data) - n + 1)
        key = np.zeros(m, np.uint32)
        for k in range(n):
            key = key * np.uint32(0x01000193) + data[k : k + m]
        key = key * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x85EBCA77)
        grams.append((key >> np.uint32(16)).astype(np.int64))
    return word, np.stack([np.pad(g, (0, len(data) - len(g)), constant_values=-1) for g in grams]) if len(data) else np.zeros((len(NGRAMS), 0), np.int64), again


REPEATED = BUCKETS  # the bucket of a repeated word


@dataclass
class Model:
    """Score of each bucket (the embedding times the softmax layer, class 1 less class 0) and the bias."""

    weight: np.ndarray
    bias: float

    def scores(self, texts_: pa.Array) -> np.ndarray:
        """Probability of class 1 of each text; of a text without words, that of the bias alone."""
        return self.judged(texts_)[0]

    def judged(self, texts_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and whether a text has any word."""
        out, some = [], []
        table = np.append(self.weight, 0.0).astype(np.float32)  # place -1: no feature
        for _, w in textvec.chunks(texts_, "blanks", size=1 << 18):
            word, grams, again = _features(w)
            total = np.zeros(len(w.first))
            np.add(total[1:], np.cumsum(np.r_[0.0, table[word] + np.where(again, table[REPEATED], 0)])[w.first[1:]], out=total[1:])
            sums = np.diff(np.r_[0.0, total[1:]]) if len(w.first) > 1 else np.zeros(0)
            count = np.diff(w.first) + np.diff(np.r_[0, np.cumsum(again)][w.first])
            size = np.diff(w.offsets)
            for n, g in zip(NGRAMS, grams):
                value = np.r_[0.0, np.cumsum(table[g], dtype=np.float64)]
                stop = np.maximum(w.offsets[:-1], w.offsets[1:] - n + 1)  # no n-gram across documents
                sums = sums + value[stop] - value[w.offsets[:-1]]
                count = count + np.maximum(0, size - n + 1)
            some.append(np.diff(w.first) > 0)
            out.append(self.bias + np.where(some[-1], sums / np.maximum(1, count), 0))
        logit = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), np.concatenate(some) if some else np.zeros(0, bool)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and the share of each."""
    parts = []
    for _, w in textvec.chunks(pa.array([text], pa.large_string()), "blanks"):
        word, grams, again = _features(w)
        parts += [word, np.full(int(again.sum()), REPEATED), grams[grams >= 0].ravel()]
    ids, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0))
    return ids.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """Stochastic gradient descent on the embeddings and the softmax layer, classes weighted alike.  Labels are 0 or 1;
    pairs with another are left out, and blank texts."""
    rng = np.random.default_rng(seed)
    sample = sample[::-1]
    bags = []
    while sample:
        t, y = sample.pop()
        if t and t.strip() and y in (0, 1):
            bags.append((*bag(t), int(y)))
    size = np.bincount([y for *_, y in bags], minlength=2)
    if not size.all():  # one class only: always that one
        return Model(np.zeros(BUCKETS + 1, np.float32), 10.0 if size[1] >= size[0] else -10.0)
    balance = len(bags) / (2 * size)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share, y = bags[k]
            lr = rate * (1 - steps / total) * balance[y]
            hidden = share @ embed[ids]
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            # the share of a feature is small; its step is taken on the scale of the average vector
            embed[ids] -= (lr * np.minimum(1, 20 * share))[:, None] * (layer @ p)[None, :]
            layer -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            steps += 1
    return Model((embed @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fitted(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """The classifier of ``bound`` labelled documents at most, those with the least hash of their id: a documented
    bound on what one task trains on.  Nulls and labels other than 0 and 1 are left out, a repeated row counts once."""
    named = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    few = named.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = texts(docs.where("text is not null and doc_id is not null")).join(F.broadcast(few), "doc_id").select("doc_id", "text", "y").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))]
        found.sort(key=lambda r: (r[0], r[1]))
        if found:
            model = train([(t, y) for _, t, y in found])
            yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])

    trained = rows.repartition(1).mapInArrow(run, "weight binary, bias double").first()
    return Model(np.frombuffer(bytes(trained["weight"]), np.float32), trained["bias"]) if trained else train([])


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, score, keep): probability of good quality of each row, and whether it is kept (score of 0.5 or more).

    Trained on ``bound`` labelled documents at most.  Null, empty and blank texts have nothing to keep: score 0.
    Without labels, or with one class only, every text gets that class (good, if there is none).  Each row has its
    row in the result, repeated ones and those with a null ``doc_id`` too.  Extra columns are ignored.
    """
    model = fitted(docs, labels, bound)
    shared, bias = docs.sparkSession.sparkContext.broadcast(model.weight), model.bias  # 256 KB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, bias)
        for batch in batches:
            score, some = own.judged(batch.column(1))
            score = np.where(some, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= REJECT)], names=["doc_id", "score", "keep"])

    return texts(docs).mapInArrow(run, "doc_id bigint, score double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns as they were.

    Null, empty and blank texts go.  Rows with a null ``doc_id`` and repeated ones are judged each by its text.  An empty
    table stays empty; without labels, or with one class only, every text gets that class (good, if there is none).
    """
    model = fitted(docs, labels, bound)
    shared, bias, at = docs.sparkSession.sparkContext.broadcast(model.weight), model.bias, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, bias)
        for batch in batches:
            score, some = own.judged(batch.column(at))
            yield batch.filter(pa.array((score >= REJECT) & some))

    return docs.mapInArrow(run, docs.schema)
