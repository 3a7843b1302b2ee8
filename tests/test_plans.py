"""Paths, predicates, regular expressions, configuration: no Spark."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quernlake.functions.text import python_ngrams
from quernlake.plans import jsonpath
from quernlake.plans import predicates as p
from quernlake.plans import regex_literals as rx
from quernlake.plans.config import Config


@pytest.mark.parametrize("path", ["$.rows[*].cell", "$['two words']", '$["q"].r', "$.x", "$", "$.x.y.z", "$.x['y-1']['z']", "$.under_score", "$.a.*", "$[*]"])
def test_valid_paths(path):
    jsonpath.validate(path)


@pytest.mark.parametrize("path", ["$.rows[7]", "rows", "", "$.rows[1:]", "$['open", "$[", "$..deep", "$.rows[?(@.n < 3)]", "$.rows[2].n", "$.a[0,1]", "__derived:$.a#b", "$."])
def test_refused_paths(path):
    assert not jsonpath.is_valid(path)


def test_canonical_path():
    assert jsonpath.canonical("$['a'][\"b\"][*].c") == "$.a.b[*].c"


@pytest.mark.parametrize("text, expected", [
    ("$.d Is Not Null", p.IsNotNull("$.d")),
    ('$.m REGEX "up|down"', p.Regex("$.m", "up|down")),
    ("$.n not in (4, 'x y', 2.5)", p.NIN("$.n", 4, "x y", 2.5)),
    ('$.m CoNtAiNs "k=v"', p.Contains("$.m", "k=v")),
    ('$.m regex "k=v"', p.Regex("$.m", "k=v")),
    ('$.n IN (7, "seven")', p.IN("$.n", 7, "seven")),
    ("$.d IS NULL", p.IsNull("$.d")),
    ("$.a >= 5", p.GTE("$.a", 5)),
    ("$.a!=true", p.NE("$.a", True)),
    ("$['a'] = 'x y'", p.EQ("$.a", "x y")),
    ("$.a = null", p.EQ("$.a", None)),
    ("$.a < -1.5e3", p.LT("$.a", -1500.0)),
    ("$.a = 9007199254740993", p.EQ("$.a", 9007199254740993)),
])
def test_predicate_grammar(text, expected):
    assert p.parse_predicate(text) == expected


def test_inexact_literals():
    assert p.parse_predicate("$.a IN (1, 2)", exact=False) == p.IN("$.a", 1.0, 2.0)


@pytest.mark.parametrize("text", ["$.a IS", "$.b NOT IN", "$.c REGEX", "", "$.d CONTAINS", '$.rows[3] = "x"', '$..deep = "y"', "a = 1"])
def test_malformed_predicates(text):
    with pytest.raises(ValueError):
        p.parse_predicate(text)


@pytest.mark.parametrize("cidr, low, high", [("192.168.1.0/24", 3232235776, 3232236031), ("192.168.0.0/16", 3232235520, 3232301055), ("10.0.0.0/8", 167772160, 184549375), ("192.168.1.100/32", 3232235876, 3232235876), ("0.0.0.0/0", 0, 4294967295)])
def test_cidr(cidr, low, high):
    assert p.cidr_range(cidr) == (low, high)


@pytest.mark.parametrize("cidr", ["not-a-cidr", "192.168.1.0", "2001:db8::/32"])
def test_bad_cidr(cidr):
    with pytest.raises(ValueError):
        p.cidr_range(cidr)


def test_numbers():
    assert p.exact_int(2.0) == 2 and p.exact_int(2.5) is None and p.exact_int(True) is None and p.exact_int(1e300) is None
    assert p.rounded_int(2.5, up=True) == 3 and p.rounded_int(-2.5, up=False) == -3 and p.rounded_int(math.inf, up=True) is None


@pytest.mark.parametrize("pattern, expected", [
    ("^begin.*stop$", ["begin", "stop"]), ("one|two|twin", ["one", "two", "twin"]), ("one|bad|bag", ["one", "ba"]), ("walk(ing)?", ["walk"]), ("xy+z", ["xyz"]),
    ("(red|blue)_car", ["red_car", "blue_car"]), ("CODE_[0-9]+", ["CODE_"]), ("[a-z]+_tail", ["_tail"]), ("plain", ["plain"]), ("left.*right", ["left", "right"]), ("Tiger|Trout|Cat", ["Tiger", "Trout", "Cat"]),
])
def test_compat_literals(pattern, expected):
    assert rx.compat_literals(pattern) == expected


@pytest.mark.parametrize("pattern, wild, least", [("one.*three", True, 3), ("k|lmno|pq", False, 1), ("plain", False, 5), ("z{3,4}", False, 3)])
def test_analyze(pattern, wild, least):
    info = rx.analyze(pattern)
    assert (info.has_wildcard, info.min_length) == (wild, least)


@pytest.mark.parametrize("pattern", ["(?=x)", r"(a)\1", "a**b(", "[a", "a++b"])
def test_refused_patterns(pattern):
    with pytest.raises(rx.RegexError):
        rx.parse(pattern)


@given(st.lists(st.sampled_from(["ab", "c", "(d|ef)", "x+", "y?", "[0-9]", ".*", "(gh|i)*", "z{2}", "|"]), min_size=1, max_size=7), st.randoms())
def test_required_literals_are_in_every_match(parts, rnd):
    import re

    pattern = "".join(parts)
    needs = rx.required(pattern)
    for _ in range(30):
        text = "".join(rnd.choice("abcdefghixyz019") for _ in range(rnd.randint(0, 9))) + "".join(rnd.choice(["ab", "c", "d", "ef", "x", "zz"]) for _ in range(rnd.randint(0, 6)))
        m = re.search(pattern, text)
        if m:
            assert any(all(x in text for x in need) for need in needs)


def test_ngrams_of_a_literal():
    assert python_ngrams("Ab c!!!") == ["ab ", "b c", " c!", "c!!"]
    assert python_ngrams("   ...") == ["  .", " .."] and python_ngrams("ab") == [] and python_ngrams("abc", 2) == ["ab", "bc"]


@pytest.mark.parametrize("bad", [{"bloom_bits": 0}, {"hll_precision": 3}, {"adaptive_ceiling": 1.0}, {"adaptive_buckets": 3}, {"adaptive_buckets": 8192}, {"parser_failure": "x"}, {"prefix_block_size": 70000}])
def test_bad_configuration(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_representations_are_checked():
    c = Config().with_representation("$['a']", "low", "to_lower")
    assert c.representations[0].target == "__derived:$.a#low"
    assert Config.from_json(c.to_json()) == c
    for args in (("$.a", "low", "to_lower"), ("$.a", "x#y", "to_lower"), ("$.a", "", "to_lower"), ("$.a", "z", "nothing"), ("$.a[0]", "z", "to_lower")):
        with pytest.raises(ValueError):
            c.with_representation(*args)
    for name, params in (("regex_extract", {"pattern": "a(b)", "group": 2}), ("numeric_bucket", {"size": 0}), ("custom_date_to_epoch_ms", {"layout": ""})):
        with pytest.raises(ValueError):
            c.with_representation("$.b", "q", name, **params)
    with pytest.raises(ValueError):
        c.with_representation("$.b", "own", lambda kind, s, d: s).to_json()
    with pytest.raises(ValueError):
        c.with_field_transformer("$.a", "to_lower")


def test_full_text_paths():
    c = Config(fts_paths=("$.title", "$.content.*"))
    assert c.full_text("$.title") and c.full_text("$.content") and c.full_text("$.content.body") and not c.full_text("$.contents") and not c.full_text("$.meta")
    assert not Config(enable_trigrams=False).full_text("$.title")
