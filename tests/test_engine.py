"""Shredding, evaluation, companions, failure modes, storage: exact row groups on small documents."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quernlake import EQ, GT, GTE, IN, LT, LTE, NE, NIN, Config, Contains, InSubnet, IsNotNull, IsNull, Regex, aliased, build_index, candidates
from quernlake.functions import sketches, transformers
from quernlake.operators import rgset
from quernlake.operators import shred as shredding
from quernlake.operators.evaluate import matching_doc_ids
from quernlake.operators.index import path_report
from quernlake.operators.report import experiment
from quernlake.operators.rows import filtered_rows, matching_documents, pruning
from quernlake.plans.predicates import parse_predicate
from quernlake.queries import over
from quernlake.sources import documents, store


def docs_of(spark, texts, per_rg=1):
    rows = [(k // per_rg, k, t if isinstance(t, str) else json.dumps(t, ensure_ascii=False)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "rg_id bigint, doc_seq bigint, json string")


def index_of(spark, texts, config=None, per_rg=1):
    return build_index(docs_of(spark, texts, per_rg), -(-len(texts) // per_rg), config)


def rgs(index, *predicates, mode="compat"):
    return rgset.to_list(candidates(index, list(predicates), mode))


def many(index, cases, mode="compat"):
    """The row groups of several predicates, in one job."""
    out = None
    for k, (predicate, _) in enumerate(cases):
        one = candidates(index, [predicate], mode).select("rg_id", F.lit(k).alias("k"))
        out = one if out is None else out.union(one)
    found = [[] for _ in cases]
    for r in out.orderBy("rg_id").collect():
        found[r["k"]].append(r["rg_id"])
    return found


@pytest.fixture(scope="module")
def golden(spark):
    people = [(30, "alice", "hello world", "active"), (25, "bob", "foo bar baz", "inactive"), (40, "alice", "test message qux", None), (35, "carol", "hello again", ...)]
    return index_of(spark, [{k: v for k, v in zip(("age", "name", "bio", "status"), p) if v is not ...} for p in people])


GOLDEN = [
    (EQ("$.name", "alice"), [0, 2]), (EQ("$.name", "nobody"), []), (NE("$.name", "alice"), [1, 3]), (NE("$.age", 35), [0, 1, 2]),
    (GT("$.age", 30), [2, 3]), (GT("$.age", 1000), []), (GTE("$.age", 30), [0, 2, 3]), (GTE("$.age", 1000), []),
    (LT("$.age", 30), [1]), (LT("$.age", 0), []), (LTE("$.age", 30), [0, 1]), (LTE("$.age", -1), []),
    (IN("$.name", "alice", "bob"), [0, 1, 2]), (IN("$.name", "xxx", "yyy"), []), (NIN("$.name", "nobody"), [0, 1, 2, 3]), (NIN("$.name", "alice", "bob", "carol"), []),
    (IsNull("$.status"), [2]), (IsNull("$.name"), []), (IsNotNull("$.name"), [0, 1, 2, 3]), (IsNotNull("$.status"), [0, 1, 2]),
    (Contains("$.bio", "hello"), [0, 3]), (Contains("$.bio", "zzzzzz"), []), (Regex("$.bio", "^hello"), [0, 3]), (Regex("$.bio", "zzzzzz"), []),
]


@pytest.mark.parametrize("mode", ["compat", "sound"])
def test_golden_matrix(golden, mode):
    for found, (predicate, expected) in zip(many(golden, GOLDEN, mode), GOLDEN):
        assert found == expected, str(predicate)


def test_conjunctions_and_unknown_paths(golden):
    assert rgs(golden) == [0, 1, 2, 3]
    assert rgs(golden, EQ("$.name", "alice"), GT("$.age", 30)) == [2]
    assert rgs(golden, EQ("$.nothing", 1), IsNull("$.nothing")) == [0, 1, 2, 3]
    assert rgs(golden, EQ("$.items[0]", 1)) == [0, 1, 2, 3]
    assert rgs(golden, EQ("$.name", None)) == [0, 1, 2, 3]
    assert rgs(golden, GT("$.name", 3)) == [0, 1, 2, 3] and rgs(golden, Contains("$.bio", "he")) == [0, 1, 2, 3]
    assert rgs(golden, EQ("$.age", 30.0)) == [0] and rgs(golden, EQ("$.age", 30.5)) == [] and rgs(golden, IN("$.age")) == []
    assert pruning(golden, [EQ("$.name", "alice")]).first().asDict() == {"total": 4, "matched": 2, "pruned": 2, "ratio": 0.5}
    assert [tuple(r) for r in matching_doc_ids(golden, candidates(golden, [EQ("$.name", "bob")])).collect()] == [(1, 1)]


def test_nested_arrays_and_booleans(spark):
    index = index_of(spark, [{"user": {"name": "a", "tags": ["x", "y"]}, "on": True}, {"user": {"name": "b", "tags": []}, "on": False}, {"user": {"tags": [["z"], {"k": 1}]}, "on": "true"}])
    assert rgs(index, EQ("$.user.name", "a")) == [0] and rgs(index, EQ("$.user.tags[*]", "y")) == [0]
    assert rgs(index, EQ("$['user']['tags'][*][*]", "z")) == [2] and rgs(index, EQ("$.user.tags[*].k", 1)) == [2]
    assert rgs(index, EQ("$.on", True)) == [0, 2] and rgs(index, IsNotNull("$.user.tags")) == [0, 1, 2] and rgs(index, IsNotNull("$.user.name")) == [0, 1]


def test_numbers(spark):
    index = index_of(spark, [f'{{"a":{n}}}' for n in (2**63 - 1, 1 - 2**63, 2**53 + 1, 0)])
    assert rgs(index, EQ("$.a", 9007199254740993)) == [2] and rgs(index, GT("$.a", 9007199254740992)) == [0, 2] and rgs(index, LT("$.a", 0.5)) == [1, 3]
    mixed = index_of(spark, ['{"s":10}', '{"s":20}', '{"s":30}', '{"s":15.5}'])
    assert rgs(mixed, GT("$.s", 15.2)) == [1, 2, 3] and rgs(mixed, EQ("$.s", 15.5)) == [3]
    ints = index_of(spark, ['{"s":1}', '{"s":2}', '{"s":3}'])
    assert rgs(ints, NE("$.s", 2)) == [0, 2] and rgs(ints, NE("$.s", 2.5)) == [0, 1, 2]


def test_sound_inequality_keeps_row_groups_with_another_value(spark):
    index = index_of(spark, [{"a": "x", "n": 1}, {"a": "y", "n": 9}, {"a": "x", "n": 1}, {"a": "x", "n": 1}], per_rg=2)
    assert rgs(index, NE("$.a", "x")) == [] and rgs(index, NE("$.a", "x"), mode="sound") == [0]
    assert rgs(index, NE("$.n", 1), mode="sound") == [0] and rgs(index, NIN("$.a", "x", "y"), mode="sound") == []


def test_adaptive_and_bloom_only_paths(spark):
    texts = [{"field": v} for v in ("hot", "hot", "tail_2", "tail_3", "tail_4", "tail_5")]
    adaptive = index_of(spark, texts, Config(cardinality_threshold=1, adaptive_min_coverage=2, adaptive_cap=4, adaptive_buckets=4))
    bloom = index_of(spark, texts, Config(cardinality_threshold=1, adaptive_cap=0))
    exact = index_of(spark, texts)
    for v in ("hot", "tail_3", "tail_5"):
        a, b, c = (set(rgs(i, EQ("$.field", v))) for i in (exact, adaptive, bloom))
        assert a <= b <= c == set(range(6))
    assert rgs(adaptive, EQ("$.field", "hot")) == [0, 1] and rgs(adaptive, NE("$.field", "hot")) == [2, 3, 4, 5]
    assert rgs(adaptive, NE("$.field", "tail_2")) == [0, 1, 2, 3, 4, 5] and rgs(bloom, NE("$.field", "hot")) == []
    assert rgs(bloom, NE("$.field", "hot"), mode="sound") == [0, 1, 2, 3, 4, 5]
    report = {r["path"]: r for r in path_report(adaptive).collect()}
    assert report["$.field"]["mode"] == "adaptive-hybrid" and report["$.field"]["promoted"] == 1 and report["$.field"]["buckets"] == 4


def test_sound_answers_about_terms_of_adaptive_paths_are_exact(spark, tmp_path):
    """Terms that share a bucket don't bring each other's row groups; neither before nor after writing."""
    texts = [{"field": v, "other": v.upper()} for v in ("hot", "hot", "tail_2", "tail_3", "tail_4", "tail_5")]
    config = Config(cardinality_threshold=1, adaptive_min_coverage=2, adaptive_cap=4, adaptive_buckets=1).with_representation("$.other", "lower", "to_lower")
    made = index_of(spark, texts, config)
    store.write_index(made, str(tmp_path / "index"))
    for index in (made, store.read_index(spark, str(tmp_path / "index"))):
        for k in range(2, 6):
            cases = [(EQ("$.field", f"tail_{k}"), [k]), (EQ("$.other", aliased("lower", f"tail_{k}")), [k]), (IN("$.field", f"tail_{k}", "hot"), [0, 1, k]), (NE("$.field", "hot"), [2, 3, 4, 5])]
            assert many(index, cases, "sound") == [expected for _, expected in cases]


def test_rows_without_a_key_are_a_row_group(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "a", 7), (None, "c", None)], "k bigint, v string, n int")
    index = over(df, "k", rg=1)
    cases = [(EQ("$.v", "a"), [None, 1]), (EQ("$.v", "b"), [2]), (IN("$.v", "b", "c"), [None, 2]), (GT("$.n", 6), [None]), (IsNull("$.n"), [None]), (Regex("$.v", "[ab]"), [None, 1, 2])]
    assert many(index, cases, "sound") == [expected for _, expected in cases]
    assert rgs(index, NE("$.v", "a")) == [2] and rgs(index, NE("$.v", "b")) == [None, 1]
    found = filtered_rows(df, F.col("k"), index, [EQ("$.v", "a")], "compat")
    assert {r["n"] for r in found.collect()} == {5, 7}


def test_hot_terms_of_an_index_whose_row_groups_nobody_counted(spark):
    df = spark.range(10).select("id", F.when(F.col("id") < 2, "hot").otherwise(F.concat(F.lit("tail_"), "id")).alias("field"))
    config = Config(cardinality_threshold=1, adaptive_cap=4, adaptive_buckets=1)
    for count in (True, False):
        index = over(df, "id", ["field"], config, count=count, rg=1)
        assert rgs(index, EQ("$.field", "hot")) == [0, 1] and rgs(index, EQ("$.field", "tail_3")) == list(range(2, 10))


def test_regex_row_groups(spark):
    index = index_of(spark, [{"brand": b} for b in ("Toyota Corolla is reliable", "Tesla Model 3 is electric", "Ford Mustang is powerful", "Both Toyota and Tesla are popular", "Honda Civic is economical")])
    for pattern, expected in (("Toyota", [0, 3]), ("Toyota|Tesla", [0, 1, 3]), ("Toyota|Tesla|Ford", [0, 1, 2, 3]), ("BMW|Mercedes", [])):
        assert rgs(index, Regex("$.brand", pattern)) == expected and rgs(index, Regex("$.brand", pattern), mode="sound") == expected
    assert rgs(index, Regex("$.brand", "Model.*electric")) == [1] and rgs(index, Regex("$.brand", "(")) == [0, 1, 2, 3, 4]


def test_companions(spark):
    config = Config().with_representation("$.email", "lower", "to_lower").with_representation("$.email", "domain", "email_domain").with_representation("$.ip", "ipv4_int", "ipv4_to_int")
    index = index_of(spark, [{"email": "Alice@Example.com", "ip": "192.168.1.5"}, {"email": "bob@other.org", "ip": "10.0.0.1"}, {"email": "CAROL@example.COM", "ip": "192.168.2.7"}], config)
    assert rgs(index, EQ("$.email", aliased("domain", "example.com"))) == [0, 2] and rgs(index, EQ("$.email", "alice@example.com")) == []
    assert rgs(index, IN("$.email", aliased("lower", "bob@other.org"), aliased("lower", "x"))) == [1] and rgs(index, NE("$.email", aliased("domain", "other.org"))) == [0, 2]
    assert rgs(index, IN("$.email", aliased("lower", "bob@other.org"), "x")) == [0, 1, 2] and rgs(index, EQ("$.email", aliased("none", "x"))) == [0, 1, 2]
    assert rgs(index, Contains("$.email", aliased("lower", "carol"))) == [2] and rgs(index, *InSubnet("$.ip", "192.168.0.0/16")) == [0, 2]


def test_failure_modes(spark):
    bad = ['{"a":1}', "not-json", '{"a":1} x', '{"a":9223372036854775808}', '{"a":1e400}', '{"a":NaN}', '{"b":"x","b":"y"}', "", '"s"']
    with pytest.raises(shredding.IngestError) as e:
        index_of(spark, bad)
    assert e.value.layer == "parser" and "ingest parser failure" in str(e.value)
    index = index_of(spark, bad, Config(parser_failure="soft", numeric_failure="soft"))
    assert sorted((r["doc_seq"], r["layer"]) for r in index.rejects.collect()) == [(1, "parser"), (2, "parser"), (3, "numeric"), (4, "numeric"), (5, "parser"), (7, "parser")]
    assert rgs(index, EQ("$.b", "y")) == [6] and rgs(index, EQ("$.b", "x")) == [] and rgs(index, EQ("$", "s")) == [8]
    hard = Config().with_representation("$.e", "low", "to_lower")
    with pytest.raises(shredding.IngestError):
        index_of(spark, [{"e": "A"}, {"e": 5}], hard)
    soft = Config().with_representation("$.e", "low", "to_lower", failure_mode="soft")
    index = index_of(spark, [{"e": "A"}, {"e": 5}], soft)
    assert rgs(index, EQ("$.e", aliased("low", "a"))) == [0] and rgs(index, EQ("$.e", 5)) == [1] and index.skipped.count() == 1


def test_numeric_promotion_is_in_document_order(spark):
    soft = Config(numeric_failure="soft")
    index = index_of(spark, ['{"s":9007199254740993,"k":"a"}', '{"s":1.5,"k":"b"}', '{"s":2,"k":"c"}'], soft)
    assert [r["doc_seq"] for r in index.rejects.collect()] == [1] and rgs(index, EQ("$.k", "b")) == []
    index = index_of(spark, ['{"s":1.5}', '{"s":9007199254740993}', '{"s":2}'], soft)
    assert [r["doc_seq"] for r in index.rejects.collect()] == [1]


def test_promotion_of_several_paths_is_that_of_reading_in_order(spark):
    """Random documents of integers beyond 2^53 and floats; rejected ones decide nothing, on any path."""
    import random

    for seed in range(5):
        rnd = random.Random(seed)
        texts = [{p: rnd.choice([1, 2**53 + 1, 2.5]) for p in "abc" if rnd.random() < 0.4} for _ in range(40)]
        takes, gone = {}, []
        for k, d in enumerate(texts):
            has = {p: type(v) for p, v in d.items() if v != 1}
            if any(takes.get(p, t) != t for p, t in has.items()):
                gone.append(k)
            else:
                takes.update(has)
        shredded = shredding.shred(docs_of(spark, texts), Config(numeric_failure="soft"))
        assert gone and sorted(r["doc_seq"] for r in shredded.rejects.collect()) == gone
        assert {r["doc_seq"] for r in shredded.observations.select("doc_seq").distinct().collect()} == set(range(40)) - set(gone)
    both = shredding.shred(docs_of(spark, ['{"a":[1.5,9007199254740993]}', '{"a":[2.5]}', '{"a":[9007199254740993]}']), Config(numeric_failure="soft"))
    assert sorted(r["doc_seq"] for r in both.rejects.collect()) == [0, 2]


@pytest.mark.parametrize("name, params, cases", [
    ("to_lower", {}, [("HeLLo", "hello")]),
    ("ipv4_to_int", {}, [("192.168.1.1", 3232235777.0), ("255.255.255.255", 4294967295.0), ("0.0.0.0", 0.0), ("999.1.1.1", None), ("::1", None), ("::ffff:1.2.3.4", 16909060.0), ("01.1.1.1", None)]),
    ("semver_to_int", {}, [("1.2.3", 1002003.0), ("v2.1.3", 2001003.0), ("1.2", 1002000.0), ("v3.5", 3005000.0), ("1.2.3-beta", 1002003.0), ("v2.0.0-rc1", 2000000.0), ("999.999.999", 999999999.0), ("1", None), ("1.2.3.4", None), ("1000.0.0", None), ("-1.0.0", None), ("a.b.c", None)]),
    ("regex_extract", {"pattern": r"ERROR\[(\w+)\]:", "group": 1}, [("ERROR[E1234]: x", "E1234"), ("INFO", None)]),
    ("regex_extract_int", {"pattern": r"n=(\S+)", "group": 1}, [("n=-12.5", -12.5), ("n=1e3", None), ("x", None)]),
    ("duration_to_ms", {}, [("1h30m", 5400000.0), ("1.5s", 1500.0), ("250us", 0.0), ("-2ms", -2.0), ("0", 0.0), ("5", None), ("s", None), ("1h 2m", None)]),
    ("email_domain", {}, [("A@B.com", "b.com"), ("@x", "x"), ("a@", None), ("a@b@c", None), ("ab", None)]),
    ("url_host", {}, [("https://u:p@Ex.com:8080/a?b", "ex.com:8080"), ("/just/path", None)]),
    ("bool_normalize", {}, [("YES", True), ("off", False), ("maybe", None)]),
    ("iso_date_to_epoch_ms", {}, [("2024-01-15T10:30:00Z", 1705314600000.0), ("2024-01-15T10:30:00.123456789+02:00", 1705307400123.0), ("2024-01-15", None), ("2024-01-15T10:30:00", None)]),
    ("date_to_epoch_ms", {}, [("2024-01-15", 1705276800000.0), ("2024-1-5", None), ("2024-02-30", None)]),
    ("custom_date_to_epoch_ms", {"layout": "02 Jan 2006 15:04"}, [("15 Jan 2024 10:30", 1705314600000.0), ("x", None)]),
])
def test_transformers(spark, name, params, cases):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)] + [(len(cases), None)], "k int, s string")
    got = [r[0] for r in df.orderBy("k").select(transformers.of_string(name, F.col("s"), **params)).collect()]
    assert got == [b for _, b in cases] + [None]


def test_numeric_transformers(spark):
    df = spark.createDataFrame([(7.5,), (-0.5,), (None,)], "d double")
    assert [r[0] for r in df.select(transformers.of_number("numeric_bucket", F.col("d"), size=5)).collect()] == [5.0, -5.0, None]


def test_storage_round_trip(spark, golden, tmp_path):
    path = str(tmp_path / "index")
    store.write_index(golden, path)
    index = store.read_index(spark, path)
    assert many(index, GOLDEN) == [expected for _, expected in GOLDEN]
    manifest = json.loads((tmp_path / "index/manifest.json").read_text())
    (tmp_path / "index/manifest.json").write_text(json.dumps(manifest | {"version": 99}))
    (tmp_path / "index/.manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(store.VersionMismatch):
        store.read_index(spark, path)
    (tmp_path / "index/manifest.json").write_text("{}")
    with pytest.raises(store.FormatError):
        store.read_index(spark, path)
    with pytest.raises(store.NoIndex):
        store.read_index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store.write_index(golden, path, level=20)
    with pytest.raises(store.LimitExceeded):
        store.write_index(golden, path, limits=store.Limits(grams=3))
    assert not (tmp_path / "index").exists()


def test_damaged_manifests(golden, monkeypatch):
    kept = {}
    monkeypatch.setattr(store, "write_bytes", lambda spark, path, data: kept.update({path: data}))
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        store.write_index(golden, f"{folder}/index")
    good = json.loads(next(iter(kept.values())))
    read = lambda m, limits=store.LIMITS: store._manifest(json.dumps(m).encode(), limits)
    assert read(good)[1] == golden.config and read(good)[2] == golden.bloom
    filled = lambda **x: good | {"bloom": good["bloom"] | x}
    for bad in (filled(on="AAAA"), filled(on=good["bloom"]["on"][:40]), filled(bits=1 << 40), filled(bits=-1), filled(hashes=0), good | {"num_row_groups": "4"}, good | {"counts": {}}, good | {"counts": good["counts"] | {"hll": -1}}, {}, []):
        with pytest.raises(store.FormatError):
            read(bad)
    for limits in (dict(paths=2), dict(row_groups=3), dict(documents=3), dict(terms=1), dict(grams=2), dict(bloom_bits=8), dict(bloom_hashes=1), dict(registers=16), dict(buckets=8)):
        with pytest.raises(store.LimitExceeded):
            read(good, store.Limits(**limits))


def test_a_data_set_of_many_files(spark, tmp_path):
    """Folder, glob and list; row groups are numbered through, more than 64 of them; one index over all."""
    from quernlake.cli import main

    rows = [f'{{"n":{k},"name":"v{k % 7}"}}' if k % 5 else None for k in range(330)]
    for f in range(3):
        pq.write_table(pa.table({"j": rows[f * 110 : (f + 1) * 110]}), str(tmp_path / f"part-{f}.parquet"), row_group_size=4)
    expected = sorted((28 * (k // 110) + k % 110 // 4, k, t) for k, t in enumerate(rows) if t)
    for source in (str(tmp_path), f"{tmp_path}/part-*.parquet", [f"{tmp_path}/part-{f}.parquet" for f in (2, 0, 1)]):
        docs, n = documents.parquet_documents(spark, source, "j")
        assert n == 84 and sorted(map(tuple, docs.collect())) == expected
    index = build_index(docs, n)
    assert rgs(index, GTE("$.n", 328)) == [83] and rgs(index, EQ("$.n", 111)) == [28]
    assert main(["build", str(tmp_path), "-c", "j", "-o", str(tmp_path / "all.idx")], spark) == 0
    assert rgs(store.read_index(spark, str(tmp_path / "all.idx")), EQ("$.n", 111)) == [28]
    with pytest.raises(FileNotFoundError):
        documents.parquet_documents(spark, str(tmp_path / "none-*"), "j")


def test_json_lines_are_numbered_in_file_order(spark, tmp_path):
    lines = []
    for f, n in enumerate((3, 2000, 1, 40)):  # Spark reads the largest first
        own = [json.dumps({"f": f, "k": k, "pad": "x" * 50}) for k in range(n)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(own) + "\n")
        lines += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = documents.jsonl_documents(spark, str(tmp_path), 10).orderBy("doc_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["json"] for r in found] == lines and [r["rg_id"] for r in found] == [k // 10 for k in range(len(lines))]


def test_parquet_row_groups_sidecar_and_embedding(spark, tmp_path):
    file = str(tmp_path / "d.parquet")
    rows = ['{"status":"a","count":1}', None, '{"status":"b","count":2}', '{"status":"a","count":30}', None, None, '{"status":"c","count":4}']
    with pq.ParquetWriter(file, pa.schema([("id", pa.int64()), ("attributes", pa.string())])) as out:
        for a in range(0, 7, 2):
            out.write_table(pa.table({"id": list(range(a, min(7, a + 2))), "attributes": pa.array(rows[a : a + 2], pa.string())}))
    docs, n = documents.parquet_documents(spark, file, "attributes")
    index = build_index(docs, n)
    assert n == 4 and rgs(index, EQ("$.status", "a")) == [0, 1] and rgs(index, EQ("$.status", "a"), GT("$.count", 5)) == [1] and rgs(index, EQ("$.status", "c")) == [3]
    with pytest.raises(KeyError):
        documents.parquet_documents(spark, file, "nothing")
    with pytest.raises(store.NoIndex):
        store.load_index(spark, file, str(tmp_path))
    store.write_sidecar(index, file)
    assert store.has_sidecar(spark, file) and rgs(store.load_index(spark, file), EQ("$.status", "c")) == [3]
    store.embed_index(index, file, str(tmp_path))
    assert store.has_embedded(spark, file) and pq.ParquetFile(file).num_row_groups == 4
    assert rgs(store.load_index(spark, file, str(tmp_path)), EQ("$.status", "b")) == [1]
    assert [r["doc_seq"] for r in matching_documents(docs, index, [EQ("$.status", "a"), GT("$.count", 5)]).collect()] == [3]


def test_experiment_report_and_cli(spark, tmp_path, capsys):
    from quernlake.cli import main

    lines = ['{"a":"x","n":1}\r', "oops", '{"a":"y","n":2}', "", '{"a":"x","n":99999999999999999999}', '{"a":"z","n":4}']
    file = tmp_path / "in.jsonl"
    file.write_text("\n".join(lines) + "\n")
    report = experiment(spark, str(file), 2, Config(), predicate=parse_predicate("$.a = 'z'"), on_error="continue")
    assert report.status == "partial" and report.summary["documents"] == 3 and report.summary["row_groups"] == 2
    assert [(f["layer"], f["count"]) for f in report.failures] == [("parser", 2), ("numeric", 1)] and report.failures[0]["samples"][0]["line"] == 2
    assert report.predicate["matched"] == 1 and json.loads(report.to_json())["status"] == "partial" and "status: partial" in report.to_text()
    assert main(["experiment", str(file)], spark) == 1
    assert main(["experiment", str(file), "--on-error", "continue", "--rg-size", "2", "--json"], spark) == 0
    pq.write_table(pa.table({"j": ['{"a":"x"}', '{"a":"y"}']}), str(tmp_path / "t.parquet"), row_group_size=1)
    assert main(["build", str(tmp_path / "t.parquet"), "-c", "j"], spark) == 0
    capsys.readouterr()
    assert main(["query", str(tmp_path / "t.parquet"), "$.a = 'y'"], spark) == 0
    assert "Matching row groups (1/2): [1]" in capsys.readouterr().out
    assert main(["info", str(tmp_path / "t.parquet")], spark) == 0 and "$.a" in capsys.readouterr().out
    assert main(["query", str(tmp_path / "t.parquet"), "nonsense"], spark) == 1


def test_stream_segments(spark, tmp_path):
    from quernlake.streaming.incremental import index_stream, merged_index

    (tmp_path / "in").mkdir()
    for k, words in enumerate((["a", "b"], ["c", "a"])):
        (tmp_path / f"in/{k}.txt").write_text("\n".join(json.dumps({"w": w}) for w in words) + "\n")
        stream = spark.readStream.text(str(tmp_path / "in"))
        index_stream(stream, "value", str(tmp_path / "out"), str(tmp_path / "cp"), rg_size=1).awaitTermination()
    index = merged_index(spark, str(tmp_path / "out"))
    assert index.num_row_groups == 4 and len(rgs(index, EQ("$.w", "a"))) == 2 and len(rgs(index, EQ("$.w", "c"))) == 1


def test_merged_segments_lose_no_match(spark, tmp_path):
    """A term that is promoted in one segment and in a tail bucket of another; integers that doubles would merge."""
    from quernlake.streaming.incremental import merged_index

    config = Config(cardinality_threshold=1, adaptive_min_coverage=2, adaptive_cap=4, adaptive_buckets=4)
    parts = [[{"a": "hot", "n": 2**53 + 1}, {"a": "hot"}, {"a": "x"}], [{"a": "y", "n": 1.5}, {"a": "hot"}, {"a": "z"}]]
    for k, texts in enumerate(parts):
        store.write_index(index_of(spark, texts, config), f"{tmp_path}/segment-{k:012d}")
    index = merged_index(spark, str(tmp_path))
    assert {0, 1, 4} <= set(rgs(index, EQ("$.a", "hot"), mode="sound")) and 2 not in rgs(index, EQ("$.a", "hot"), mode="sound")
    assert rgs(index, GT("$.n", 2**53), mode="sound") == [0] and rgs(index, EQ("$.n", 2**53), mode="sound") == [] and rgs(index, NE("$.n", 2**53), mode="sound") == [0, 3]


@pytest.mark.parametrize("seed", range(2))
def test_written_and_merged_indexes_are_sound_in_every_mode(spark, tmp_path, seed):
    """Random segments and modes: no row group with a match is lost, before or after writing, alone or merged."""
    import random

    from quernlake.streaming.incremental import merged_index

    rnd = random.Random(seed)
    modes = [Config(), Config(cardinality_threshold=3, adaptive_cap=0), Config(cardinality_threshold=3, adaptive_min_coverage=2, adaptive_cap=2, adaptive_buckets=2), Config(cardinality_threshold=3, adaptive_min_coverage=1, adaptive_cap=3, adaptive_buckets=8, trigram_min_length=5)]
    config = modes[1 + 2 * seed]
    segments = []
    for k in range(2):
        names = [f"name{j}" for j in range(rnd.choice([2, 9]))]
        segments.append([{"a": rnd.choice(names), "n": rnd.choice([rnd.randint(-3, 9), rnd.random() * 9] if k else [rnd.randint(-3, 9)]), "t": " ".join(rnd.choice(["error", "tim", "out", "fine"]) for _ in range(2))} for _ in range(12)])
        segments[-1] = [{p: v for p, v in d.items() if rnd.random() < 0.8} for d in segments[-1]]
        store.write_index(index_of(spark, segments[-1], config, per_rg=2), f"{tmp_path}/segment-{k:012d}")
    rows = [d for s in segments for d in s]
    index = merged_index(spark, str(tmp_path))
    assert index.num_row_groups == 12
    cases = [(EQ("$.a", f"name{j}"), lambda d, j=j: d.get("a") == f"name{j}") for j in range(9)]
    cases += [(NE("$.a", "name0"), lambda d: d.get("a") not in (None, "name0")), (IN("$.a", "name1", "name5", "none"), lambda d: d.get("a") in ("name1", "name5")), (NIN("$.a", "name0", "name1"), lambda d: d.get("a") not in (None, "name0", "name1")), (GT("$.n", 4.5), lambda d: d.get("n", 0) > 4.5), (LTE("$.n", -1), lambda d: d.get("n", 0) <= -1), (EQ("$.n", 3), lambda d: d.get("n") == 3), (NE("$.n", 3), lambda d: d.get("n", 3) != 3), (Contains("$.t", "error"), lambda d: "error" in d.get("t", "")), (Regex("$.t", "tim out|fine fine"), lambda d: d.get("t") in ("tim out", "fine fine"))]
    for (p, test), found in zip(cases, many(index, cases, "sound")):
        assert {k // 2 for k, d in enumerate(rows) if test(d)} <= set(found), str(p)


def test_bloom_membership_sifts_false_positives(spark, monkeypatch):
    """All names share one bit of the filter; those of other segments go all the same."""
    from quernlake import queries as engine

    monkeypatch.setattr(sketches, "bloom_positions", lambda column, bits, hashes: F.array(F.lit(0).cast("bigint")))
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_mktsegment = 'BUILDING'")
    found = engine.bloom_membership(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, customers.select("c_custkey", "c_name").collect()))


def test_bloom_positions_wrap_as_those_of_literals(spark):
    texts = [f"t{k}" for k in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", sketches.bloom_positions(F.col("s"), 8192, 7).alias("p"))
    assert all(r["p"] == sketches._positions(r["s"], 8192, 7) for r in rows.collect())


def test_sketches_and_sets(spark):
    terms = spark.createDataFrame([("p", t) for t in ("app", "apple", "apply", "bat", "batch", "é", "éa")], "path string, term string")
    coded = sketches.front_coded(terms, "path", block=3)
    assert sorted(r["term"] for r in sketches.front_decoded(coded, "path").collect()) == ["app", "apple", "apply", "bat", "batch", "é", "éa"]
    bloom = sketches.build_bloom(terms, "term", 4096, 5)
    assert all(bloom.may_contain(t) for t in ("app", "batch", "éa")) and sum(bloom.may_contain(f"no{k}") for k in range(500)) < 5
    u = rgset.universe(spark, 5)
    a, b = rgset.of(spark, [0, 1, 7], 5), rgset.of(spark, [1, 2], 5)
    assert rgset.to_list(rgset.union(a, b)) == [0, 1, 2] and rgset.to_list(rgset.intersect(a, b)) == [1] and rgset.to_list(rgset.invert(a, u)) == [2, 3, 4]
    assert rgset.to_list(rgset.invert(rgset.union(a, b), u)) == rgset.to_list(rgset.intersect(rgset.invert(a, u), rgset.invert(b, u)))
    assert rgset.has(a, 1) and rgset.to_list(rgset.removed(a, 1)) == [0] and rgset.to_list(rgset.added(a, 4, u)) == [0, 1, 4]
    n = spark.range(5000).select(F.col("id").cast("string").alias("s")).agg(sketches.distinct_sketch("s", 12).alias("k")).select(sketches.sketch_estimate("k")).first()[0]
    assert abs(n - 5000) < 250


def test_no_false_negatives_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for _ in range(120):
        d = {"name": rnd.choice(["alice", "bob", "charlie", None]), "age": rnd.choice([rnd.randint(18, 65), rnd.random() * 40, None]), "active": rnd.random() < 0.5, "text": " ".join(rnd.choice(["error", "timeout", "abbc", "fine"]) for _ in range(3))}
        rows.append({k: v for k, v in d.items() if rnd.random() < 0.9})
    docs = docs_of(spark, rows, per_rg=6)
    index = build_index(docs, 20)
    for p, test in [
        (EQ("$.name", "bob"), lambda r: r.get("name") == "bob"), (NE("$.name", "bob"), lambda r: r.get("name") not in (None, "bob")), (GT("$.age", 60), lambda r: (r.get("age") or 0) > 60),
        (NE("$.active", True), lambda r: r.get("active") is False), (IsNull("$.age"), lambda r: "age" in r and r["age"] is None), (Contains("$.text", "timeout"), lambda r: "timeout" in r.get("text", "")),
        (Regex("$.text", "ab+c.*error"), lambda r: __import__("re").search("ab+c.*error", r.get("text", ""))), (NIN("$.name", "bob", "alice"), lambda r: r.get("name") == "charlie"),
    ]:
        expected = {k for k, r in enumerate(rows) if test(r)}
        found = set(rgs(index, p, mode="sound"))
        assert {k // 6 for k in expected} <= found, str(p)
        assert {r["doc_seq"] for r in matching_documents(docs, index, [p]).collect()} == expected, str(p)


def test_boundaries_are_observed(golden, spark, caplog):
    import logging

    from quernlake.operators import observe

    signals = observe.Signals()
    observe.use(signals)
    try:
        with caplog.at_level(logging.INFO, logger="quernlake"):
            candidates(golden, [EQ("$.name", "alice")])
            with pytest.raises(store.NoIndex):
                store.read_index(spark, "/nowhere/at/all")
    finally:
        observe.use(None)
    assert len(signals.seconds["evaluate"]) == 1 and signals.failures["decode", "missing"] == 1
    assert "alice" not in caplog.text and "evaluate" in caplog.text
    with pytest.raises(ValueError), observe.boundary("x", None, value="secret"):
        pass


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["json_observations", "json_nested_paths"])
def test_texts_are_parsed_once(spark, name):
    """What the pass over the texts gave is stored; no result reads it by another pass, or joins where nothing is rejected."""
    from quernlake import queries as engine

    plan = _plan(engine.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" not in plan and "Join" not in plan


def test_row_groups_are_read_in_bounded_parts(spark, tmp_path, monkeypatch):
    """A row group of many rows is several tasks' work; documents are found by the values that the index was made of."""
    rows = [f'{{"n":{k}}}' if k % 7 else None for k in range(95)]
    pq.write_table(pa.table({"j": rows}), str(tmp_path / "a.parquet"), row_group_size=60)
    monkeypatch.setattr(documents, "ROWS", 25)
    docs, n = documents.parquet_documents(spark, str(tmp_path / "a.parquet"), "j")
    assert n == 2 and docs.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, docs.collect())) == [(k // 60, k, t) for k, t in enumerate(rows) if t]
    for mode in ("sound", "compat"):
        found = matching_documents(docs, build_index(docs, n), [GTE("$.n", 50), LT("$.n", 62)], mode)
        assert sorted(r["doc_seq"] for r in found.collect()) == [k for k in range(50, 62) if k % 7]
    assert _plan(matching_documents(docs, build_index(docs, n), [GTE("$.n", 50)])).split("== Physical Plan ==")[1].count("MapInArrow") == 1


def test_frequent_trigrams_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from quernlake.operators import index as ix

    monkeypatch.setattr(ix, "TASK_BYTES", 500)
    df = spark.createDataFrame([(k, f"abc{k % 3}") for k in range(1000)], "k bigint, t string").coalesce(1)
    rg = F.expr("k div 4")
    index = ix.index_table(df, rg, df.select(rg.alias("rg_id")).distinct(), 250, ["t"])
    store.write_index(index, str(tmp_path / "index"))
    read = spark.read.parquet(str(tmp_path / "index/trigrams")).where("gram = 'abc'")
    assert read.count() == 250 and read.select(F.input_file_name()).distinct().count() > 1
    assert rgs(store.read_index(spark, str(tmp_path / "index")), Contains("$.t", "ABC2"), mode="sound") == [k for k in range(250) if any(j % 3 == 2 for j in range(4 * k, 4 * k + 4))]


def test_kept_indexes_write_what_is_asked_for(spark, tmp_path):
    df = spark.createDataFrame([(k, "ab" + "cdefg"[k % 5]) for k in range(40)], "k bigint, t string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    built = []

    def build():
        from quernlake.operators.index import index_table

        built.append(1)
        rg = F.expr("k div 4")
        return index_table(df, rg, df.select(rg.alias("rg_id")).distinct(), 10, ["t"], Config(cardinality_threshold=2, adaptive_min_coverage=1, adaptive_cap=1, adaptive_buckets=4))

    ask = lambda: store.kept_index(spark, str(tmp_path / "t.parquet"), "t", build, str(tmp_path / "kept"))
    expected = [k for k in range(10) if any(j % 5 == 0 for j in range(4 * k, 4 * k + 4))]
    assert rgs(ask(), EQ("$.t", "abc"), mode="sound") == expected and ask().num_row_groups == 10
    folder = next((tmp_path / "kept").iterdir())
    assert {p.name for p in folder.iterdir() if p.is_dir()} == {"row_groups", "path_directory", "string_postings"}
    assert rgs(ask(), EQ("$.t", "abc"), mode="sound") == expected and built == [1]
    assert rgs(ask(), Contains("$.t", "abc"), mode="sound") == expected and built == [1, 1]
    assert set(expected) <= set(rgs(ask(), EQ("$.t", "abc"), mode="compat"))
