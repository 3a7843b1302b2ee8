"""Transformers for companion representations, as Column expressions that give NULL where they fail.

Each takes the observed value as three columns: ``kind`` (string, int, float, bool, null, object, array), ``s`` (the string,
or "true"/"false") and ``d`` (the number as a double), and gives a string, double or boolean column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(kind: Column, s: Column) -> Column:
    return F.when(kind == "string", s)


def iso_date_to_epoch_ms(kind: Column, s: Column, d: Column) -> Column:
    t = _text(kind, s)
    ok = t.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d([.,]\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$")
    # fractions beyond microseconds don't reach a millisecond
    clean = F.regexp_replace(F.regexp_replace(t, ",", "."), r"(\.\d{6})\d+", "$1")
    return F.when(ok, F.unix_millis(F.try_to_timestamp(clean)).cast("double"))


def date_to_epoch_ms(kind: Column, s: Column, d: Column) -> Column:
    t = _text(kind, s)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_date(t.try_cast("date")).cast("double") * 86400000.0)


_LAYOUT = (("2006", "yyyy"), ("January", "MMMM"), ("Jan", "MMM"), ("Monday", "EEEE"), ("Mon", "EEE"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("-0700", "xx"), ("MST", "z"), (".000000", ".SSSSSS"), (".000", ".SSS"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("_2", "d"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"))


def date_pattern(layout: str) -> str:
    """A reference-time layout (``2006-01-02 15:04``) as a pattern of Spark's."""
    if not layout:
        raise ValueError("the layout is empty")
    out, at, literal = "", 0, ""

    def flush() -> str:
        return "'" + literal.replace("'", "''") + "'" if re.search("[A-Za-z']", literal) else literal

    while at < len(layout):
        hit = next((x for x in _LAYOUT if layout.startswith(x[0], at)), None)
        if hit:
            out, literal, at = out + flush() + hit[1], "", at + len(hit[0])
        else:
            literal += layout[at]
            at += 1
    return out + flush()


def custom_date_to_epoch_ms(kind: Column, s: Column, d: Column, layout: str = "") -> Column:
    at, pattern = F.try_to_timestamp(_text(kind, s), F.lit(date_pattern(layout))), date_pattern(layout)
    if not re.search(r"[xXz]", re.sub(r"'[^']*'", "", pattern)):  # without a zone: UTC, whatever the session's zone
        at = F.from_utc_timestamp(at, F.current_timezone())
    return F.unix_millis(at).cast("double")


def to_lower(kind: Column, s: Column, d: Column) -> Column:
    return F.lower(_text(kind, s))


def ipv4_to_int(kind: Column, s: Column, d: Column) -> Column:
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    t = F.regexp_replace(_text(kind, s), r"^(?i)::ffff:(?=\d+\.)", "")
    parts = F.split(t, r"\.")
    value = sum((parts[k].try_cast("double") * float(256 ** (3 - k)) for k in range(1, 4)), parts[0].try_cast("double") * float(256**3))
    return F.when(t.rlike(rf"^{octet}(\.{octet}){{3}}$"), value)


def semver_to_int(kind: Column, s: Column, d: Column) -> Column:
    t = F.regexp_replace(_text(kind, s), "^v", "")
    parts = F.split(t, r"\.", -1)
    patch = F.when(F.size(parts) == 3, F.split(F.get(parts, F.lit(2)), "-")[0]).otherwise("0")
    number = [F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), patch]
    ok = F.size(parts).isin(2, 3)
    for n in number:
        ok = ok & n.rlike(r"^[+]?\d+$") & n.try_cast("int").between(0, 999)
    return F.when(ok, number[0].try_cast("double") * 1e6 + number[1].try_cast("double") * 1e3 + number[2].try_cast("double"))


def regex_extract(kind: Column, s: Column, d: Column, pattern: str = "", group: int = 0) -> Column:
    t = _text(kind, s)
    if not 0 <= group <= re.compile(pattern).groups:
        return F.lit(None).cast("string")
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))


def regex_extract_int(kind: Column, s: Column, d: Column, pattern: str = "", group: int = 0) -> Column:
    found = regex_extract(kind, s, d, pattern, group)
    return F.when(found.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), found.try_cast("double"))


def duration_to_ms(kind: Column, s: Column, d: Column) -> Column:
    t = _text(kind, s)
    part = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"
    number = F.regexp_extract_all(t, F.lit(part), F.lit(1))
    unit = F.regexp_extract_all(t, F.lit(part), F.lit(2))
    scale = F.create_map(*[F.lit(x) for pair in (("ns", 1), ("us", 10**3), ("µs", 10**3), ("μs", 10**3), ("ms", 10**6), ("s", 10**9), ("m", 60 * 10**9), ("h", 3600 * 10**9)) for x in pair])
    total = F.aggregate(F.zip_with(number, unit, lambda n, u: n.try_cast("decimal(30,9)") * F.element_at(scale, u).cast("decimal(15,0)")), F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + x).cast("decimal(38,9)"))
    millis = F.floor(total / F.lit(10**6)).cast("double")
    return F.when(t.rlike(rf"^[+-]?({part})+$"), F.when(t.startswith("-"), -millis).otherwise(millis)).when(t.rlike(r"^[+-]?0$"), 0.0)


def email_domain(kind: Column, s: Column, d: Column) -> Column:
    parts = F.split(_text(kind, s), "@", -1)
    domain = F.get(parts, F.lit(1))
    return F.when((F.size(parts) == 2) & (domain != ""), F.lower(domain))


def url_host(kind: Column, s: Column, d: Column) -> Column:
    host = F.regexp_replace(F.try_parse_url(_text(kind, s), F.lit("AUTHORITY")), "^.*@", "")
    return F.when(host != "", F.lower(host))


def numeric_bucket(kind: Column, s: Column, d: Column, size: float = 1.0) -> Column:
    return F.when(kind.isin("int", "float"), F.floor(d / F.lit(float(size))).cast("double") * F.lit(float(size)))


def bool_normalize(kind: Column, s: Column, d: Column) -> Column:
    low = F.lower(s)
    return (
        F.when((kind == "string") & low.isin("true", "yes", "1", "on"), True)
        .when((kind == "string") & low.isin("false", "no", "0", "off"), False)
        .when(kind == "bool", low == "true")
        .when(kind.isin("int", "float"), d != 0)
    )


#: name -> (expression, names of its parameters, kind of its result)
REGISTRY: dict[str, tuple[Callable[..., Column], tuple[str, ...], str]] = {
    "iso_date_to_epoch_ms": (iso_date_to_epoch_ms, (), "number"),
    "date_to_epoch_ms": (date_to_epoch_ms, (), "number"),
    "custom_date_to_epoch_ms": (custom_date_to_epoch_ms, ("layout",), "number"),
    "to_lower": (to_lower, (), "string"),
    "ipv4_to_int": (ipv4_to_int, (), "number"),
    "semver_to_int": (semver_to_int, (), "number"),
    "regex_extract": (regex_extract, ("pattern", "group"), "string"),
    "regex_extract_int": (regex_extract_int, ("pattern", "group"), "number"),
    "duration_to_ms": (duration_to_ms, (), "number"),
    "email_domain": (email_domain, (), "string"),
    "url_host": (url_host, (), "string"),
    "numeric_bucket": (numeric_bucket, ("size",), "number"),
    "bool_normalize": (bool_normalize, (), "bool"),
}


def check(transformer, params: dict) -> None:
    """Refuses unknown names, unknown or missing parameters, and parameters that can't work."""
    if callable(transformer):
        return
    if transformer not in REGISTRY:
        raise ValueError(f"unknown transformer {transformer!r}")
    known = REGISTRY[transformer][1]
    if set(params) - set(known):
        raise ValueError(f"{transformer}: unknown parameters {sorted(set(params) - set(known))}")
    if "layout" in known:
        date_pattern(params.get("layout", ""))
    if "pattern" in known:
        if not params.get("pattern"):
            raise ValueError(f"{transformer}: a pattern is needed")
        groups = re.compile(params["pattern"]).groups
        if not 0 <= params.get("group", 0) <= groups:
            raise ValueError(f"{transformer}: the pattern has {groups} groups")
    if "size" in known and not params.get("size", 0) > 0:
        raise ValueError(f"{transformer}: size must be positive")


def apply(transformer, params: dict, kind: Column, s: Column, d: Column) -> tuple[Column, str]:
    """The result column and its kind; a custom transformer gives a string column, or a (column, kind) pair."""
    if callable(transformer):
        out = transformer(kind, s, d)
        return out if isinstance(out, tuple) else (out, "string")
    fn, _, kind_out = REGISTRY[transformer]
    return fn(kind, s, d, **params), kind_out


def of_string(name: str, column: Column, **params) -> Column:
    """A registered transformer on a plain string column."""
    return REGISTRY[name][0](F.when(column.isNotNull(), F.lit("string")).otherwise("null"), column, F.lit(None).cast("double"), **params)


def of_number(name: str, column: Column, **params) -> Column:
    return REGISTRY[name][0](F.when(column.isNotNull(), F.lit("float")).otherwise("null"), F.lit(None).cast("string"), column.cast("double"), **params)
