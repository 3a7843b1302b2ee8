"""The operators on Spark: brute force on the smallest tables, and the odd cases of each."""

import collections

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernlake.llm import fmindex, html, media, minhash, mixing, quality, sharding, suffix, textvec, tokencount, toxicity
from quernlake.llm.tables import fresh
from tests.conftest import DATA

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["h", "anchor", "bucket", "sig", "pi", "unit", "cell", "slot", "shard", "version", "score", "any", "center", "tokens", "start_word", "DROPPED_ID", "chosen_id", "text_key"]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


LONG = " ".join(f"word{k}" for k in range(60))
VERY = " ".join(f"tok{k * 7919 % 40000}" for k in range(40000))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
ODD = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, None, "a"), (4, "", None), (5, " \n", "b"), (6, "single", "b"), (None, LONG, "b"), (7, VERY, "b"), (8, VERY + " more", "c"),
    (9, f"before {ITEM} after it", "c"), (10, ITEM, "c"), (11, "You are a stupid idiot.", "c"), (12, "two words", "a"), (13, "two words", None), (None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return _docs(spark, ODD).cache()


@pytest.fixture(scope="module")
def clashing(spark, odd):
    return odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, []).where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (11, 0, 1), (6, 0, 0), (None, 1, 1), (7, None, None), (1, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "x y z w v u t s r")], "item_id bigint, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_near_duplicates(spark, odd, clashing, empty):
    expected = [(10, 9), (13, 12), (2, 1), (8, 7)]
    assert rows(minhash.near_duplicates(odd)) == expected and rows(minhash.near_duplicates(clashing)) == expected
    assert rows(minhash.near_duplicates(empty)) == []


def test_an_id_on_several_texts_is_as_many_documents(spark, clashing):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = _docs(spark, [(1, a, "s"), (5, a, "s"), (5, b, "s"), (5, c, "s"), (9, b + " z", "s"), (9, b + " z", "s"), (7, None, "s"), (None, a, "s"), (7, None, "s")])
    assert rows(minhash.near_duplicates(docs)) == [(5, 1), (9, 5)]
    kept = collections.Counter((r["doc_id"], r["text"]) for r in minhash.deduplicated(docs).collect())
    assert kept == {(1, a): 1, (5, b): 1, (5, c): 1, (7, None): 2, (None, a): 1}
    assert rows(minhash.near_duplicates(_docs(spark, [(5, a, "s"), (5, a + " z", "s")]))) == [(5, 5)]
    out = minhash.deduplicated(clashing)
    assert out.columns == clashing.columns and sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 9, 11, 12]


def test_blocks_of_a_bucket_join_what_one_block_does(spark, monkeypatch):
    """Copies under one heading, and near ones of the centre, in blocks of few."""
    made = []
    for k in range(40):
        body = " ".join(f"w{k % 25}x{j}" for j in range(14))
        made.append((k, "one heading that all of these documents share " + body + (f" end{k}" if k >= 25 else ""), "s"))
    docs = _docs(spark, made)
    expected = rows(minhash.near_duplicates(docs))
    for size in (3, 7):
        monkeypatch.setattr(minhash, "BLOCK", size)
        assert rows(minhash.near_duplicates(docs)) == expected and len(expected) >= 14


def test_near_duplicates_of_a_bucket_with_many_leaders(spark):
    """Short documents under one heading: the centre of a bucket resembles few, the others are found all the same."""
    head = "one heading that all of these documents share "
    made = []
    for k in range(120):
        body = " ".join(f"w{k}x{j}" for j in range(12))
        made += [(2 * k, head + body, "s"), (2 * k + 1, head + body + " end", "s")]
    found = minhash.near_duplicates(_docs(spark, made)).collect()
    group = {r["doc_id"]: r["kept_id"] for r in found}
    assert sum(group.get(2 * k + 1, 2 * k + 1) == group.get(2 * k, 2 * k) for k in range(120)) >= 118


def test_near_duplicates_of_a_group_whose_original_has_a_middle_id(spark):
    """Heavily edited copies resemble the original, and hardly each other."""
    import random

    rnd = random.Random(4)
    original = [f"w{k}" for k in range(400)]
    made = []
    for k in range(300):
        words = list(original)
        for j in rnd.sample(range(400), 45):
            words[j] = f"e{k}x{j}"
        made.append((k, " ".join(original if k == 150 else words), "s"))
    grams = [set(minhash.shingles(textvec.hash_words(t)).tolist()) for _, t, _ in made]
    near = [k for k in range(300) if len(grams[k] & grams[150]) / len(grams[k] | grams[150]) >= 0.5]
    group = {r["doc_id"]: r["kept_id"] for r in minhash.near_duplicates(_docs(spark, made)).collect()}
    assert len(near) > 200 and sum(group.get(k, k) == group.get(150, 150) for k in near) >= 0.9 * len(near)


def test_near_duplicates_recall_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    group = {r["doc_id"]: r["kept_id"] for r in minhash.near_duplicates(docs).collect()}
    grams = {r["doc_id"]: set(minhash.shingles(textvec.hash_words(r["text"])).tolist()) for r in docs.collect()}
    ids = sorted(grams)
    pairs = [(a, b, len(grams[a] & grams[b]) / max(1, len(grams[a] | grams[b]))) for k, a in enumerate(ids) for b in ids[:k]]
    near = [(a, b) for a, b, j in pairs if j >= 0.55]
    assert near and sum(group.get(a, a) == group.get(b, b) for a, b in near) >= 0.9 * len(near)
    close = {(a, b) for a, b, j in pairs if j >= 0.3} | {(b, a) for a, b, j in pairs if j >= 0.3}
    linked = collections.defaultdict(set)
    for a, b in close:
        linked[a].add(b)
    for a in group:  # nothing joins a group without a similar member
        assert any(group.get(b, b) == group[a] for b in linked[a])


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 10), (7, 7), (1, 5), (20, 21)], "a bigint, b bigint")
    assert rows(minhash.components(edges)) == [(10, 8), (2, 1), (21, 20), (3, 1), (4, 1), (5, 1), (9, 8)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a bigint, b bigint")
    assert {r[1] for r in minhash.components(chain).collect()} == {0}


def test_repeated_passages(spark, odd, clashing, empty):
    expected = [(1, 0, 60, 60), (2, 0, 60, 60), (7, 0, 40000, 40000), (8, 0, 40000, 40000)]
    assert rows(suffix.repeated_passages(odd)) == expected and rows(suffix.repeated_passages(clashing)) == expected and rows(suffix.repeated_passages(empty)) == []


def test_repeated_passages_against_brute_force(spark):
    import random

    rnd = random.Random(8)
    passages = [[rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(n)] for n in (49, 50, 51, 70, 200)]
    texts = []
    for k in range(60):
        words = [f"u{k}v{j}" for j in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 10)
            at = rnd.randint(0, len(words))
            words[at:at] = p[a:] if rnd.random() < 0.3 else p
        texts.append(" ".join(words) + (" a a a a" * 30 if k % 20 == 0 else ""))
    seen = collections.Counter()
    grams = [textvec.grams(textvec.hash_words(t), 50, seed=3).tolist() for t in texts]
    for g in grams:
        seen.update(g)
    expected = []
    for k, g in enumerate(grams):
        for s in (s for s, h in enumerate(g) if seen[h] > 1):
            if expected and expected[-1][0] == k and s <= expected[-1][2]:
                expected[-1][2] = s + 50
            else:
                expected.append([k, s, s + 50])
    docs = _docs(spark, [(k, t, "s") for k, t in enumerate(texts)])
    assert [(a, b, c) for a, b, c, _ in rows(suffix.repeated_passages(docs).orderBy("doc_id"))] == sorted(map(tuple, expected), key=repr)


def test_hot_anchors_and_repeated_rows_give_the_same_passages(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    expected = rows(suffix.repeated_passages(docs))
    monkeypatch.setattr(suffix, "HOT", 2)
    assert expected and rows(suffix.repeated_passages(docs.union(docs))) == expected


def test_templates_that_differ_in_a_word_do_not_repeat(spark):
    """Words with equal leading 16 bits of their hashes (and so eight), in one place of the same 99 words."""
    seen, pairs = {}, []
    for k in range(3000):
        other = seen.setdefault(int(textvec.hash_words(f"name{k}")[0]) >> 48, k)
        pairs += [(other, k)] if other != k else []
    head, tail = " ".join(f"h{j}" for j in range(49)), " ".join(f"t{j}" for j in range(49))
    docs = _docs(spark, [(k, f"{head} name{k} {tail}", "s") for k in pairs[0]])
    assert pairs and rows(suffix.repeated_passages(docs)) == []
    more = docs.union(_docs(spark, [(9000, f"{head} name{pairs[0][0]} {tail}", "s")]))
    assert [r[:3] for r in rows(suffix.repeated_passages(more))] == [(pairs[0][0], 0, 99), (9000, 0, 99)]


def test_an_anchor_with_more_contexts_than_fit_is_refined_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    shared = rng.integers(0, 256, 60).astype(np.uint8)
    words = [np.r_[shared, np.array([k, 40 + k, 80 + k], np.uint8)].tobytes() for k in range(40)]
    windows = [textvec.grams(np.frombuffer(x, np.uint8).astype(np.uint64), 50).tobytes() for x in words]
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * 5), pa.array(range(k, k + 5)), pa.array([0] * 5), pa.array([0] * 5), pa.array(words[k : k + 5], pa.binary()), pa.array(windows[k : k + 5], pa.binary())], names=["anchor", "doc_id", "text_key", "begin", "words", "windows"]) for k in range(0, 40, 5)]
    monkeypatch.setattr(suffix, "CHUNK", 10)
    found = {(d, a, b) for x in suffix._sort(50)(iter(batches)) for d, a, b in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist())}
    assert {d for d, _, _ in found} == set(range(40)) and all((a, b) == (0, 60) for _, a, b in found)


def test_contaminated_spans(spark, odd, clashing, empty, benchmark):
    expected = [(10, 0, 11, 11, [1]), (9, 1, 12, 11, [1])]
    assert rows(fmindex.contaminated_spans(odd, benchmark)) == expected and rows(fmindex.contaminated_spans(clashing, benchmark)) == expected
    assert rows(fmindex.contaminated_spans(empty, benchmark)) == [] and rows(fmindex.contaminated_spans(odd, benchmark.where("false"))) == []


def test_decontaminated(spark, odd, clashing, empty, benchmark):
    for docs in (odd, clashing):
        out = fmindex.decontaminated(docs, benchmark)
        assert out.columns == docs.columns and out.count() == len(ODD) - 1
        kept = {r["doc_id"]: r for r in out.collect()}
        assert 10 not in kept and kept[9]["text"] == "before  after it" and kept[9]["n_chars"] == 16 and kept[7]["text"] == VERY
    assert fmindex.decontaminated(empty, benchmark).count() == 0
    named = fmindex.decontaminated(odd.withColumn("n_chars", F.lit("many")), benchmark).where("doc_id = 9").first()
    assert named["n_chars"] == "many" and named["text"] == "before  after it"
    changed = _docs(spark, [(1, f"İÉ {ITEM.upper()}! ẞ", "s"), (2, "x " * 9, "s")])
    assert fmindex.decontaminated(changed, benchmark).where("doc_id = 1").first()["text"] == "İÉ ! ẞ"


def test_shards_of_any_size_agree(spark, benchmark, monkeypatch):
    docs = _docs(spark, [(k, f"beta {k} {ITEM} kappa" if k % 3 else f"alpha beta {k} gamma", "s") for k in range(50)])
    expected = rows(fmindex.contaminated_spans(docs, benchmark))
    phrases = fmindex.Phrases([(1, ITEM)])
    batch = docs.select("doc_id", "text").toPandas()
    import pyarrow as pa

    arrow = pa.RecordBatch.from_pandas(batch, preserve_index=False)
    found = [(tag[0].column(0)[tag[1]].as_py(), a, b, b - a, i) for s in fmindex._shards(iter([arrow.slice(k, 7) for k in range(0, 50, 7)]), phrases, 1, size=20) for tag, spans in s for a, b, i in spans]
    assert sorted(found, key=repr) == expected and len(expected) == 33


def test_quality(spark, odd, clashing, empty, labels):
    out = quality.quality_scores(odd, labels)
    assert out.count() == len(ODD) and {r["keep"] for r in out.where("doc_id in (3, 4, 5)").collect()} == {False}
    assert rows(quality.quality_scores(clashing, labels)) == rows(out) and quality.quality_scores(empty, labels).count() == 0
    kept = quality.accepted(clashing, labels)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in out.where("keep").collect()}
    assert quality.quality_scores(odd, labels.where("false")).where("keep").count() == 12
    strange = labels.union(spark.createDataFrame([(9, 2, 5), (10, -1, -1)], labels.schema))
    assert rows(quality.quality_scores(odd, strange)) == rows(out) and rows(toxicity.toxic_documents(odd, strange)) == rows(toxicity.toxic_documents(odd, labels))


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality.quality_scores(docs, train).join(held, "doc_id").toPandas()
    assert (out["keep"].astype(int) == out["quality"]).mean() >= 0.97


def test_toxicity(spark, odd, clashing, empty, labels):
    found = rows(toxicity.toxic_documents(odd, labels))
    assert [r[0] for r in found] == [11] and found[0][2] == 1 and rows(toxicity.toxic_documents(clashing, labels)) == found
    assert rows(toxicity.toxic_documents(empty, labels)) == [] and [r[0] for r in rows(toxicity.toxic_documents(odd, labels.where("false")))] == [11]


def _plain_score(text, table):
    """The score of a text and its clauses that score, word by word, by the five transducers in turn."""
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.utf8_lower(pa.array([text or ""]))[0].as_py()
    words = list(re.finditer(r"[0-9a-z_\x80-\U0010ffff]+", text))
    parts = [toxicity.negation(), toxicity.reported(), toxicity.targets(), toxicity.insults(), toxicity.threats()]
    clauses_, begin = [], 0
    for k, m in enumerate(words):
        if k + 1 == len(words) or re.search(r"[\n!.:;?]", text[m.end() : words[k + 1].start()]):
            clauses_.append((begin, k + 1))
            begin = k + 1
    scored = []
    for a, b in clauses_:
        symbols, inside = [], False
        for m in words[a:b]:
            opened = text[words[a].start() : m.start()].count('"') % 2 == 1
            if opened and not inside:
                symbols.append((toxicity.QUOTE, 1.0))
            inside = opened
            symbols.append(table.get(m[0], (toxicity.OTHER, 1.0)))
        hot = [k for k, (s, _) in enumerate(symbols) if s in (toxicity.INSULT, toxicity.THREAT)]
        if not hot:
            continue
        cut = [0, *(y - toxicity.BEFORE for x, y in zip(hot, hot[1:]) if y - x > toxicity.REACH), len(symbols)]
        best = 0.0
        for x, y in zip(cut, cut[1:]):
            states, total = [0] * 5, 0.0
            for s, w in symbols[x:y]:
                for k, t in enumerate(parts):
                    states[k], s, pay = t.step(states[k], s)
                    total += pay * w
            best = max(best, total)
        at = next(k for k in range(a, b) if table.get(words[k][0], (0, 0))[0] in (toxicity.INSULT, toxicity.THREAT))
        if best > 0:
            scored.append((at, best))
    loud = [(at, s) for at, s in scored if s > toxicity.FAINT]
    passages = [sum(s for p, s in loud if at - toxicity.PASSAGE <= p <= at) for at, _ in loud]
    return max([0.0, *passages, *(s for _, s in scored)]), len(scored)


def test_toxicity_is_that_of_a_plain_reading(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.Lexicon.of(toxicity.learned(docs, labels))
    known = dict(zip(lexicon.hashes.tolist(), zip(lexicon.symbols.tolist(), lexicon.weights.tolist())))
    more = _docs(spark, [(-1, 'He said "you idiot" and left. You are no moron! I will kill you; they said so', "s"), (-2, "dumm " * 40 + "du trottel. " * 3, "s")])
    both = docs.select("doc_id", "text").union(more.select("doc_id", "text"))
    table, expected = {}, []
    for r in both.collect():
        for w in textvec.word_list(r["text"]):
            if w not in table:
                found = known.get(int(textvec.hash_words(w)[0]))
                table[w] = found or (toxicity.OTHER, 1.0)
        score, n = _plain_score(r["text"], table)
        if score >= toxicity.THRESHOLD:
            expected.append((r["doc_id"], pytest.approx(score), n))
    found = sorted(map(tuple, toxicity.toxic_documents(docs, labels).collect()))
    assert len(found) > 5 and [r for r in sorted(expected, key=lambda r: r[0]) if r[0] >= 0] == found
    alone = toxicity.scores(__import__("pyarrow").array([r["text"] for r in more.collect()]), lexicon, toxicity.Machine(toxicity.grammar()))
    assert [(pytest.approx(s), n) for s, n in zip(*alone)] == [_plain_score(r["text"], table) for r in more.collect()]


def test_toxicity_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"] for r in toxicity.toxic_documents(docs, labels).collect()}
    lab = labels.join(docs, "doc_id").where("lang = 'en'").toPandas()
    toxic, clean = set(lab.doc_id[lab.toxic == 1]), set(lab.doc_id[lab.toxic == 0])
    assert len(toxic & found) >= 0.9 * len(toxic) and len(clean & found) <= 0.01 * len(clean)


def test_mixing(spark, odd, clashing, empty):
    found = rows(mixing.balanced_sample(odd))
    assert {r[0] for r in found} <= set(range(1, 14)) and len({r[0] for r in found}) == len(found) and rows(mixing.balanced_sample(clashing)) == found
    assert rows(mixing.balanced_sample(empty)) == [] and rows(mixing.balanced_sample(odd, {})) == [] and {r[1] for r in rows(mixing.balanced_sample(odd, {"a": 1.0}))} == {"a"}
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and {r["doc_id"] for r in out.collect()} == {r[0] for r in found}


def test_mixture_has_the_target_weights(spark):
    made = [(k, "w " * (1 + k * 7919 % 50), f"s{k % 3 if k % 10 else 0}") for k in range(6000)]
    docs = _docs(spark, made)
    weights = {"s0": 1.0, "s1": 1.0, "s2": 2.0}
    a, b = mixing.balanced_sample(docs, weights, cell=256), mixing.balanced_sample(docs.repartition(7), weights, cell=256)
    assert rows(a) == rows(b)
    kept = a.toPandas().groupby("source")["tokens"].sum()
    assert kept["s2"] / kept["s1"] == pytest.approx(2, abs=0.02) and kept["s0"] / kept["s1"] == pytest.approx(1, abs=0.02)
    full = pd.DataFrame(made, columns=["doc_id", "text", "source"]).groupby("source").size()
    shares = a.toPandas().groupby("source").agg(n=("doc_id", "size"), p=("p", "first"))
    assert (abs(shares["n"] - full * shares["p"]) <= 3).all()


def test_a_small_source_does_not_shrink_the_mixture(spark):
    def kept(sizes, weights=None, **more):
        table = spark.createDataFrame(list(sizes.items()), "source string, tokens bigint")
        p = {r["source"]: r["p"] for r in mixing.probabilities(table, weights, **more).collect()}
        return p, sum(p[s] * t for s, t in sizes.items()) / sum(sizes.values())

    even = {f"s{k}": 350_000_000 for k in range(20)}
    p, share = kept(even | {None: 10})
    assert p[None] == 1 and share == pytest.approx(1)
    p, share = kept({"a": 900, "b": 90, "c": 30})  # the rest is in proportion to the square roots
    assert p["c"] == p["b"] == 1 and share == pytest.approx(0.5) and p["a"] == pytest.approx(390 / 900)
    p, share = kept({"a": 1000, "b": 1000, "c": 200}, {"a": 1.0, "b": 2.0, "c": 4.0}, share=0.6)
    assert p["c"] == 1 and 2 * p["a"] == pytest.approx(p["b"]) and share == pytest.approx(0.6)
    docs = _docs(spark, [(k, "w " * 20, f"s{k % 3}") for k in range(3000)] + [(3000, "one two", None)])
    found = mixing.balanced_sample(docs).toPandas()
    assert len(found) >= 2990 and 3000 in set(found.doc_id)


def test_sharding(spark, odd, clashing, empty, tmp_path):
    path = str(tmp_path / "map")
    out = rows(sharding.sharded(odd, path))
    assert len(out) == len(ODD) and {r[1] for r in out if r[0] is None} == {0} and len({r[1:] for r in out if r[0] == 2}) == 1 and {r[3] for r in out} == {2}
    assert rows(sharding.sharded(clashing, path)) == out and rows(sharding.sharded(empty, path)) == []
    placed = sharding.placed(clashing, path)
    assert placed.columns == [*clashing.columns, "_slot", "_shard", "_version"]
    by = {r[1]: r[2] for r in out}
    size = collections.Counter()
    for i, t, _ in ODD:
        size[next(r[1] for r in out if r[0] == i)] += len(t or "")
    assert sharding.stored(odd, path) == (2, sharding.rebalanced(sharding.first_map(), size)) and all(sharding.stored(odd, path)[1][s] == shard for s, shard in by.items())


def test_the_stored_map_is_edited(spark, tmp_path):
    """Runs agree; other bytes move few slots; shards may be fewer or more; a version that wasn't finished isn't read."""
    path = str(tmp_path / "map")
    docs = _docs(spark, [(k, "x" * (1 + k % 50), "s") for k in range(5000)])
    version, one = sharding.slot_map(docs, path)
    assert sharding.slot_map(docs, path) == (version, one)
    grown = docs.union(_docs(spark, [(k, "y" * 2000, "s") for k in range(100)]))
    after, two = sharding.slot_map(grown, path)
    assert after == version + 1 and 0 < sum(a != b for a, b in zip(one, two)) < 200
    for shards in (5, 24):
        _, three = sharding.slot_map(grown, path, shards)
        assert set(three) == set(range(shards))
    (tmp_path / "map/version-000099").mkdir()
    assert sharding.slot_map(grown, path, 24) == (after + 2, three)


def test_slots_are_even(spark):
    n = spark.range(50000).select(sharding.slot(F.col("id")).alias("s")).groupBy("s").count().toPandas()["count"]
    assert len(n) == sharding.SLOTS and n.max() < 40


def test_token_counts(spark, odd, clashing, empty):
    out = rows(tokencount.token_counts(odd))
    assert len(out) == len(ODD) and (3, None, None) in out and (4, 0, 0) in out and (12, 2, 2) in out
    assert rows(tokencount.token_counts(clashing)) == out and rows(tokencount.token_counts(empty)) == []


def test_token_counts_of_a_whole_table_are_the_encoders(spark):
    import tiktoken

    other = tiktoken.Encoding("t", pat_str=tokencount.PATTERN, mergeable_ranks=tokencount.load_ranks(), special_tokens={})
    long = _docs(spark, [(10**9, "x" * 7000 + " " + "é" * 6000 + "?!" * 4000, "s")])
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(long.select("doc_id", "text"))
    expected = sorted((r["doc_id"], len(other.encode_ordinary(r["text"]))) for r in docs.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(docs).collect()) == expected


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<p>some text here", 0), (1, "u", "<p>some text here", 0), (2, None, None, 0), (None, "v", "", 0)], "page_id bigint, url string, html string, text int")
    out = rows(html.extracted(pages))
    assert len(out) == 4 and out[0][3] == "some text here" and (2, None, "", "", 0, 0) in out and html.extracted(pages.where("false")).count() == 0
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    real = html.extracted(pages).join(pages.select("page_id", "html"), "page_id").toPandas()
    found = total = 0
    for text, page in zip(real.text, real.html):
        body = {x for x, _, _ in html.parse(page[page.index("<article>") : page.index("</article>")])[1] if x}
        links = {x for x, _, _ in html.parse(page[page.index("<nav>") : page.index("</nav>")])[1] if x}
        kept = set(text.split("\n"))
        found, total = found + sum(map(len, body & kept)), total + sum(map(len, body))
        assert kept and not kept & (links - body)
    assert found >= 0.98 * total


def _java_jpeg(spark, pixels, gray):
    """A JPEG by Java's encoder, and its own decoding as luma."""
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    height, width, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(width, height, 10 if gray else 1)
    flat = (pixels[:, :, 0].astype(int) << 16) | (pixels[:, :, 1].astype(int) << 8) | pixels[:, :, 2].astype(int)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, int(flat[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    rgb = np.array([[back.getRaster().getSample(x, y, 0) if gray else back.getRGB(x, y) for x in range(width)] for y in range(height)])
    return data, rgb if gray else 0.299 * (rgb >> 16 & 255) + 0.587 * (rgb >> 8 & 255) + 0.114 * (rgb & 255)


@pytest.mark.parametrize("gray", [False, True])
@pytest.mark.parametrize("height, width", [(16, 16), (9, 23), (33, 18)])
def test_jpegs_of_another_encoder(spark, gray, height, width):
    rng = np.random.default_rng(height)
    pixels = np.clip(np.cumsum(rng.normal(0, 6, (height, width, 3)), axis=1) + 120, 0, 255).astype(np.uint8)
    if gray:
        pixels[:, :, 1:] = pixels[:, :, :1]
    data, luma = _java_jpeg(spark, pixels, gray)
    found = media.decode_jpeg(data)
    assert found.shape == (height, width, 3) and np.abs(found[:, :, 0] - luma).mean() < 1.5 and (not gray or (found[:, :, 1:] == 128).all())


def test_media(spark):
    vectors = spark.createDataFrame([(0, [0.5, 1.0, -2.0], 1), (1, [], 1), (2, None, 1), (3, [float("nan"), None], 1), (0, [0.5, 1.0, -2.0], 1)], "vec_id bigint, embedding array<float>, clip int")
    out = media.clip_rows(media.films(vectors)).toPandas()
    assert list(out[out.media_id == 1].frames) == media.film([], 1)[1] and len(out[out.media_id == 0]) == 4
    files = spark.createDataFrame([(1, None), (2, b""), (None, bytearray(b"RIFFxxxxAVI ")), (4, bytearray(media.film([1.0], 4)[0]))], "media_id bigint, media binary")
    assert {r["media_id"] for r in media.clip_rows(files).collect()} == {4} and media.clip_rows(files.where("false")).count() == 0


def test_helpers(spark, clashing):
    assert fresh(clashing, "dropped_id") == "_dropped_id"
