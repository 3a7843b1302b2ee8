"""Near-duplicate groups by one-permutation MinHash with optimal densification.

One hash of each word shingle gives both its bin (of ``bins``) and its rank in the bin, so a signature
costs one pass.  An empty bin borrows from a bin drawn by a universal hash of (bin, attempt) until it
meets a filled one (optimal densification), which keeps the estimate of the Jaccard similarity unbiased.
Texts of equal words are one vertex.  Bands of bins are bucket keys; within a bucket only a star of edges is made, from
each member to the bucket's smallest document, and each edge is verified on the whole signatures.  Members that don't
resemble the centre are compared among themselves and with the members that do, in blocks: a task takes a pair of
blocks of ``BLOCK`` members (buckets of the same members count once).  Left out are only pairs that are joined already, and
those that the triangle inequality of the bins' disagreement rules out, so no pair is lost.  Verified edges are
closed to connected components.  No step gathers a bucket, a vertex's edges or a group in one task: minima are aggregated
and joined back, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm import textvec
from quernlake.llm.tables import discard, discarded, dropped_rows, saved, texts

U64 = np.uint64
SHINGLE, BINS, BANDS, ROWS, SIMILARITY = 3, 256, 40, 4, 0.5
BLOCK = 1024  # members of a bucket that a task holds of either side


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the word n-grams of one text; a text of 1 to n - 1 words is a single shingle."""
    if 0 < len(words) < n:
        return textvec.grams(words, len(words), seed=n)
    return textvec.grams(words, n)


def _fallbacks(bins: int, attempts: int) -> np.ndarray:
    """Bin to borrow from, by attempt and empty bin."""
    key = np.arange(attempts * bins, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(12345)
    return (textvec.mix(key) % U64(bins)).astype(np.int64).reshape(attempts, bins)


def sketch(grams: np.ndarray, owner: np.ndarray, n: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n x bins, uint16) of n documents, from shingle hashes and the document of each; and which
    documents have any shingle at all."""
    low = np.full(n * bins, np.iinfo(np.uint64).max, dtype=U64)
    spread = textvec.mix(grams ^ U64(0x5851F42D4C957F2D))
    cell = owner * bins + (spread % U64(bins)).astype(np.int64)
    rank = spread >> U64(9)
    np.minimum.at(low, cell, rank)
    low = low.reshape(n, bins)
    filled = low != np.iinfo(np.uint64).max
    some = filled.any(axis=1)
    rows, cols = np.nonzero(~filled & some[:, None])
    out, attempt = low.copy(), 0
    table = _fallbacks(bins, 64)
    while len(rows):
        if attempt < len(table):
            source = table[attempt][cols]
        else:  # scan on: ends for certain
            source = (table[-1][cols] + attempt) % bins
        hit = filled[rows, source]
        # the attempt is mixed in, so that two borrowers of one bin agree only where both documents borrowed alike
        out[rows[hit], cols[hit]] = low[rows[hit], source[hit]] + U64((attempt + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)
        rows, cols, attempt = rows[~hit], cols[~hit], attempt + 1
    return (textvec.mix(out) & U64(0xFFFF)).astype(np.uint16), some


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1)
        for at, w in textvec.chunks(batch.column(2), "words", lower=True):
            n = len(w.first) - 1
            count = np.diff(w.first)
            grams = textvec.grams(w.hashes, SHINGLE) if len(w.hashes) >= SHINGLE else np.zeros(0, U64)
            owner = w.owner()
            start = np.arange(len(grams))
            inside = owner[start] == owner[start + SHINGLE - 1] if len(grams) else np.zeros(0, bool)
            parts, owners = [grams[inside]], [owner[: len(grams)][inside]]
            for d in np.flatnonzero((count > 0) & (count < SHINGLE)):
                parts.append(shingles(w.hashes[w.first[d] : w.first[d + 1]]))
                owners.append(np.full(len(parts[-1]), d))
            sig, some = sketch(np.concatenate(parts), np.concatenate(owners), n)
            total = np.zeros((2, len(w.hashes) + 1), dtype=U64)  # of the word sequence: equal texts, equal keys
            place = np.arange(len(w.hashes), dtype=U64) - np.repeat(w.first[:-1], count).astype(U64)
            for k, c in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB)):
                np.cumsum(textvec.mix(w.hashes + (place + U64(1)) * U64(c)), out=total[k, 1:])
            key = textvec.mix(total[:, w.first[1:]] - total[:, w.first[:-1]] + count.astype(U64)).view(np.int64)
            keep = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays(
                [*(x.slice(at, n).take(pa.array(keep)) for x in (ids, keys)), pa.array(key[0][keep]), pa.array(key[1][keep]), pa.array([sig[d].tobytes() for d in keep], pa.binary())],
                schema=_SIGNED,
            )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BINS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = _signatures(batch.column(1))
        key = np.zeros((len(sig), BANDS), dtype=U64)
        for b in range(BANDS):
            value = np.full(len(sig), b, dtype=U64)
            for r in range(ROWS):
                value = textvec.mix(value * U64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
            key[:, b] = value
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(key.view(np.int64).ravel())], names=["unit", "bucket"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alike = (_signatures(batch.column(2)) == _signatures(batch.column(3))).mean(axis=1) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike)], names=["unit", "center", "similarity"])


def links(sig: np.ndarray, near: np.ndarray, side: np.ndarray, within: bool, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that resemble each other and join all such rows into the same components as all such pairs would:
    pairs of a row of side 0 and one of side 1, and, with ``within``, pairs of side 0.  ``near`` is the similarity of each
    row to a common centre, with which the rows of ``similarity`` are joined already."""
    order = np.lexsort((near, side))
    own = order[: int((side == 0).sum())]
    group = np.where(near >= similarity, -1, np.arange(len(sig)))  # what is joined already has one number
    a, b = [], []
    for k, m in enumerate(own.tolist()):
        others = order[k + 1 :] if within else order[len(own) :]
        # they must not differ from the centre too unequally, and not be joined yet
        others = others[(np.abs(near[others] - near[m]) <= 1 - similarity + 1e-9) & (group[others] != group[m])]
        while len(others):
            part, others = others[:4096], others[4096:]
            hit = part[(sig[part] == sig[m]).mean(axis=1) >= similarity]
            if not len(hit):
                continue
            _, one = np.unique(group[hit], return_index=True)
            a.append(hit[one])
            b.append(np.full(len(one), m))
            group[np.isin(group, group[hit])] = group[m]
            others = others[group[others] != group[m]]
    return np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of pairs of blocks; rows come sorted by pair, and one pair is held at a time."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = lambda k: whole.column(k).combine_chunks()
        a, b = links(_signatures(column(3)), column(4).to_numpy(), column(5).to_numpy(), whole.column(2)[0].as_py())
        return pa.RecordBatch.from_arrays([pa.array(column(6).to_numpy()[x]) for x in (a, b)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        bucket, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(pair) != 0)) + 1).tolist(), len(bucket)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and last != (bucket[a], pair[a]):
                yield flush(held)
                held = []
            last = (bucket[a], pair[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield flush(held)


def components(edges: DataFrame) -> DataFrame:
    """(vertex, group) for every vertex of the edges (a, b): the smallest vertex of its component.
    Large-star and small-star steps alternate until the edges stop changing; each halves the depth.  The result's
    table is :func:`discarded` by the caller."""

    def least(pairs: DataFrame, by: str, of: str) -> DataFrame:
        """``pairs`` with m, the least of ``of`` by ``by``: aggregated, then joined back, so that hot keys are split."""
        return pairs.join(pairs.groupBy(by).agg(F.min(of).alias("m")), by)

    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        large = least(both, "u", "v").where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        small = least(large, "a", "b")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        then = saved(small.where("a <> b").distinct(), "edges")
        mark = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if mark == seen:
            break
        seen = mark
    return discarded(now.select(F.col("a").alias("vertex"), F.col("b").alias("group")), now)


def _unlike(star: DataFrame, judged: DataFrame, sigs: DataFrame, block: int, tables: list[DataFrame]) -> DataFrame:
    """(bucket, pair, within, sig, near, side, unit): for each bucket the members that don't resemble its centre, in
    blocks, with each other block of them and each block of the members that do and might resemble one of them.
    Adds the tables it writes to ``tables``."""
    far = saved(star.join(judged.where(F.col("similarity") < SIMILARITY), ["unit", "center"]).select("bucket", "center", "unit", "similarity"), "far")
    # once for each set of such members, and of the centre
    sets = far.groupBy("bucket", "center").agg(F.count("*").alias("n"), F.max("similarity").alias("most"), F.sum(F.xxhash64("unit").cast("decimal(38,0)")).alias("h"))
    near = star.join(sets.select("bucket", "most"), "bucket").join(judged.where(F.col("similarity") >= SIMILARITY), ["unit", "center"])
    near = saved(near.where(F.col("similarity") <= F.col("most") + (1 - SIMILARITY) + 1e-9).select("bucket", "unit", "similarity"), "near")
    tables += [far, near]
    likes = near.groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.xxhash64("unit").cast("decimal(38,0)")).alias("g"))
    sets = sets.join(likes, "bucket", "left").fillna(0, ["m"]).withColumn("g", F.coalesce("g", F.lit(0).cast("decimal(38,0)"))).where("n + m > 1")
    one = sets.groupBy("center", "n", "h", "m", "g").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / block).alias("fars"), F.ceil(F.col("m") / block).alias("nears"))
    place = lambda n: F.pmod(F.xxhash64("unit", F.lit(7)), n)
    # a pair is i * (fars + nears) + j of blocks i <= j of far members, then those that resemble the centre
    width = F.col("fars") + F.col("nears")
    # the pairs within a block come with its first partner: itself, or the first block of the near ones
    first = F.when(F.col("nears") > 0, F.col("fars")).otherwise(F.col("i"))
    there = F.sequence(F.lit(0).cast("bigint"), width - 1)
    fars = far.join(one, "bucket").withColumn("i", place(F.col("fars"))).withColumn("j", F.explode(there)).where((F.col("j") != F.col("i")) | (F.col("nears") == 0))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    fars = fars.select("bucket", (low * width + high).alias("pair"), (F.col("j") == first).alias("within"), "unit", F.col("similarity").alias("near"), ((F.col("j") < F.col("fars")) & (F.col("i") > F.col("j"))).cast("int").alias("side"))
    nears = near.join(one, "bucket").withColumn("j", F.col("fars") + place(F.col("nears"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fars") - 1)))
    nears = nears.select("bucket", (F.col("i") * width + F.col("j")).alias("pair"), (F.col("j") == F.col("fars")).alias("within"), "unit", F.col("similarity").alias("near"), F.lit(1).alias("side"))
    return fars.union(nears).join(sigs, "unit").select("bucket", "pair", "within", "sig", "near", "side", "unit")


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, kept_id, kept_key) of each document that goes: those of :func:`near_duplicates`, with the
    hashes of their texts, as an id may stand on several."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    signed = saved(rows.mapInArrow(_sign, "doc_id bigint, text_key bigint, k1 bigint, k2 bigint, sig binary"), "signed")
    # one vertex for each group of equal words, named by its smallest id, or, where that stands on several texts, by a hash
    same = signed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("u"), F.first("sig").alias("sig"))
    one = saved(same.select("k1", "k2", "u.*", "sig"), "one")
    several = saved(one.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several")), "several")
    tables = [signed, one, several]
    one = one.join(several, "doc_id", "left").select("k1", "k2", F.struct("doc_id", "text_key").alias("u"), F.when(F.col("several"), F.xxhash64("doc_id", "text_key")).otherwise(F.col("doc_id")).alias("unit"), "sig")
    sigs = one.select("unit", "sig")
    buckets = saved(sigs.mapInArrow(_bands, "unit bigint, bucket bigint"), "buckets")
    centers = buckets.groupBy("bucket").agg(F.min("unit").alias("center"), F.max("unit").alias("last")).where("center <> last").drop("last")
    star = saved(buckets.join(centers, "bucket").where("unit <> center").select("bucket", "unit", "center"), "star")
    pairs = star.select("unit", "center").distinct().join(sigs, "unit").join(sigs.toDF("center", "sig_c"), "center")
    judged = saved(pairs.select("unit", "center", "sig", "sig_c").mapInArrow(_similar, "unit bigint, center bigint, similarity double"), "judged")
    tables += [buckets, star, judged]
    good = judged.where(F.col("similarity") >= SIMILARITY).select("unit", "center")
    blocks = _unlike(star, judged, sigs, BLOCK, tables)
    led = blocks.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(_link, "a bigint, b bigint")
    groups = components(good.union(led).toDF("a", "b"))
    tables.append(groups)
    # the smallest id of each component, and of each group of equal words
    grouped = groups.toDF("unit", "group")
    grouped = grouped.union(grouped.select("group", "group").distinct()).join(one.select("unit", "u"), "unit")
    kept = grouped.join(grouped.groupBy("group").agg(F.min("u").alias("kept")), "group").select("unit", "kept")
    kept = one.select("k1", "k2", "unit", "u").join(kept, "unit", "left").select("k1", "k2", F.coalesce("kept", "u").alias("kept"))
    out = signed.select(F.struct("doc_id", "text_key").alias("u"), "k1", "k2").join(kept, ["k1", "k2"]).where("u <> kept")
    out = saved(out.select("u.*", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_key").alias("kept_key")).distinct(), "copies")
    for x in tables:
        discard(x)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_id): each document that resembles another, with the smallest id of its group, which is
    the one kept; the kept documents themselves and those without a near copy have no row.

    Two documents are near copies if their signatures agree in half of their bins at least (estimated
    Jaccard similarity of word trigrams, 0.5); groups are the connected components of such pairs.
    Null, empty and wordless texts resemble nothing.  Rows with a null ``doc_id`` are left out.  A repeated row (same
    id and text) is the same document, not its copy; an id on several texts is as many documents, each
    judged by its own text, and of copies with the same id all but one go, so that an id may be its own ``kept_id``.
    Extra columns are ignored, an empty table gives no row.
    """
    return duplicates(docs).select("doc_id", "kept_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies; all columns as they were.  Of rows that repeat id and text
    one stays, any of them.  Rows with a null id or text, and those of texts without words, stay."""
    return dropped_rows(docs, duplicates(docs))
