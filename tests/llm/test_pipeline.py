"""The pipeline's stages in turn, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernlake.llm import fmindex, textvec
from tests.conftest import DATA
from tests.llm.test_operators import CLASH, ODD, _docs


def _run(spark, docs, sf_dir):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
        out[-1].count()
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    all_ = _run(spark, docs, DATA)
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in all_]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[4] == ids[5] and len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1])
    assert all(x.columns == docs.columns for x in all_[:5]) and all_[5].columns == [*docs.columns, "slot", "shard", "version"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    good, bad = set(labels.doc_id[labels.quality == 1]), set(labels.doc_id[labels.quality == 0])
    assert len(good & ids[1]) >= 0.98 * len(good & ids[0]) and len(bad & ids[1]) <= 0.1 * len(bad)
    texts = [r["text"] for r in all_[2].select("text").collect()]
    assert len(texts) == len({tuple(textvec.word_list(t)) for t in texts})
    phrases = fmindex.Phrases([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    known = {tuple(p) for p in phrases.table.tolist()}
    for r in all_[3].collect():
        s = phrases.symbols(textvec.hash_words(r["text"])).tolist()
        spans = sum(tuple(s[k : k + 8]) in known for k in range(len(s) - 7))
        assert not spans and r["n_chars"] == len(r["text"])


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.columns[-3:] == ["slot", "shard", "version"]


@pytest.mark.parametrize("extra", [[], CLASH])
def test_odd_rows(spark, extra):
    docs = _docs(spark, ODD).select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])
    for start in (docs, docs.where("false")):
        for x in _run(spark, start, DATA)[1:5]:
            assert x.columns == docs.columns


def test_stages_are_those_of_brute_force(spark):
    """Each stage on what the one before kept: scores text by text, all pairs of signatures, phrases word by word, MD5."""
    import hashlib
    import re

    import numpy as np

    from quernlake.llm import minhash, quality, sharding

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    stages = _run(spark, docs, DATA)
    found = [texts(x) for x in stages]

    model, near = quality.fitted(docs, labels), 0
    for i, t in found[0].items():
        ids, share = quality.bag(t)
        logit = model.bias + float(share @ model.weight[ids]) if len(ids) else -9
        assert abs(logit) < 1e-3 or (logit >= 0) == (i in found[1])
        near += abs(logit) < 1e-3
    assert near <= 1

    ids = sorted(found[1])
    grams = [minhash.shingles(textvec.hash_words(found[1][i])) for i in ids]
    sig, some = minhash.sketch(np.concatenate(grams), np.repeat(np.arange(len(ids)), [len(g) for g in grams]), len(ids))
    least = list(range(len(ids)))
    for a in range(len(ids)):
        for b in np.flatnonzero((sig[:a] == sig[a]).mean(axis=1) >= minhash.SIMILARITY):
            if some[a] and some[b]:
                x, y = sorted((least[a], least[b]))
                least = [x if z == y else z for z in least]
    expected = {ids[k] for k in range(len(ids)) if least[k] == k}
    assert len(expected) < len(ids) and expected <= set(found[2]) and len(set(found[2]) - expected) <= 0.02 * len(ids)

    pattern = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
    phrases = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = [x.lower() for x in pattern.findall(r["text"] or "")]
        phrases |= {tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7)) if w}
    cut = 0
    for i, t in found[2].items():
        words = list(pattern.finditer(t))
        lower = [m[0].lower() for m in words]
        spans: list[list[int]] = []
        for k in range(len(words)):
            for n in {len(p) for p in phrases}:
                if tuple(lower[k : k + n]) in phrases and k + n <= len(words):
                    if spans and k <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], k + n)
                    else:
                        spans.append([k, k + n])
        left, at = "", 0
        for a, b in spans:
            left, at = left + t[at : words[a].start()], words[b - 1].end()
        left += t[at:]
        cut += bool(spans)
        assert found[3].get(i, "") == left if pattern.search(left) or not words else i not in found[3]
    assert cut

    assert set(found[4]) <= set(found[3]) and all(found[4][i] == found[3][i] for i in found[4])
    rows = stages[5].collect()
    version, now = sharding.stored(docs, sharding.map_path(docs, "pipeline"))
    for r in rows:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"], r["version"]) == (slot, now[slot], version)
    assert {r["doc_id"] for r in rows} == set(found[4])
