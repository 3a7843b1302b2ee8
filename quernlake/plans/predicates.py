"""Predicates, their text grammar, and literals."""

from __future__ import annotations

import ipaddress
import json
import math
import re
from dataclasses import dataclass
from typing import Any

from quernlake.plans import jsonpath

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "IN", "NOT IN", "IS NULL", "IS NOT NULL", "CONTAINS", "REGEX")
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Aliased:
    """A value to compare with the companion representation ``alias`` of the predicate's path."""

    alias: str
    value: Any


def aliased(alias: str, value: Any) -> Aliased:
    return Aliased(alias, value)


@dataclass(frozen=True)
class Predicate:
    path: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")
        if isinstance(self.value, list):
            object.__setattr__(self, "value", tuple(self.value))

    def __str__(self) -> str:
        if self.op in ("IS NULL", "IS NOT NULL"):
            return f"{self.path} {self.op}"
        return f"{self.path} {self.op} {self.value!r}"


def EQ(path: str, value: Any) -> Predicate:
    return Predicate(path, "=", value)


def NE(path: str, value: Any) -> Predicate:
    return Predicate(path, "!=", value)


def GT(path: str, value: Any) -> Predicate:
    return Predicate(path, ">", value)


def GTE(path: str, value: Any) -> Predicate:
    return Predicate(path, ">=", value)


def LT(path: str, value: Any) -> Predicate:
    return Predicate(path, "<", value)


def LTE(path: str, value: Any) -> Predicate:
    return Predicate(path, "<=", value)


def IN(path: str, *values: Any) -> Predicate:
    return Predicate(path, "IN", tuple(values))


def NIN(path: str, *values: Any) -> Predicate:
    return Predicate(path, "NOT IN", tuple(values))


def IsNull(path: str) -> Predicate:
    return Predicate(path, "IS NULL")


def IsNotNull(path: str) -> Predicate:
    return Predicate(path, "IS NOT NULL")


def Contains(path: str, value: Any) -> Predicate:
    return Predicate(path, "CONTAINS", value)


def Regex(path: str, value: Any) -> Predicate:
    return Predicate(path, "REGEX", value)


def cidr_range(cidr: str) -> tuple[float, float]:
    """First and last address of an IPv4 network, as numbers."""
    if "/" not in cidr:
        raise ValueError(f"{cidr!r} has no prefix length")
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version != 4:
        raise ValueError(f"{cidr!r} isn't an IPv4 network")
    return float(int(net.network_address)), float(int(net.broadcast_address))


def InSubnet(path: str, cidr: str, alias: str = "ipv4_int") -> list[Predicate]:
    """Addresses of a network, over a companion that holds them as numbers."""
    low, high = cidr_range(cidr)
    return [GTE(path, Aliased(alias, low)), LTE(path, Aliased(alias, high))]


# ---- text grammar ------------------------------------------------------------------------------------------

_WORDS = {("IS", "NULL"): "IS NULL", ("IS", "NOT", "NULL"): "IS NOT NULL", ("IN",): "IN", ("NOT", "IN"): "NOT IN", ("CONTAINS",): "CONTAINS", ("REGEX",): "REGEX"}
_SIGN = re.compile(r"[!<>]?=|[<>]")


def _split(text: str) -> tuple[str, str, str] | None:
    """(path, operator, operand) at the first operator after a path: signs, or words between blanks outside of brackets."""
    at, depth = 0, 0
    while at < len(text):
        c = text[at]
        depth += (c == "[") - (c == "]")
        sign = _SIGN.match(text, at) if depth == 0 else None
        if sign and at:
            return text[:at].strip(), sign[0], text[sign.end() :].strip()
        if depth == 0 and c.isspace():
            words = text[at:].replace("(", " (").split(None, 3)
            for n in (3, 2, 1):
                op = _WORDS.get(tuple(w.upper() for w in words[:n]))
                if op and len(words) >= n:
                    rest = text[at:].lstrip()
                    for w in words[:n]:
                        rest = rest[len(w) :].lstrip()
                    return text[:at].strip(), op, rest
        at += 1
    return None


def parse_value(text: str, exact: bool = True) -> Any:
    """A literal of the text grammar: quoted strings lose their quotes; true, false, null and numbers are what they
    say; anything else is a string.  ``exact=False`` makes whole numbers floats."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if text == "null":
        return None
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text) if exact else float(text)
    try:
        value = float(text)
    except ValueError:
        return text
    return value if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) and math.isfinite(value) else text


def parse_list(text: str, exact: bool = True) -> tuple:
    try:
        values = json.loads(f"[{text}]")
        return tuple(float(v) if not exact and isinstance(v, int) and not isinstance(v, bool) else v for v in values)
    except ValueError:
        return tuple(parse_value(part, exact) for part in text.split(",")) if text.strip() else ()


def parse_predicate(text: str, exact: bool = True) -> Predicate:
    """``$.path OP literal``.  Keywords are case-insensitive; the path must be of the supported subset."""
    found = _split(text.strip())
    if found and found[0].startswith("$"):
        path, op, operand = jsonpath.canonical(found[0]), found[1], found[2]
        if op in ("IS NULL", "IS NOT NULL"):
            if not operand:
                return Predicate(path, op)
        elif op in ("IN", "NOT IN"):
            if operand[:1] == "(" and operand[-1:] == ")":
                return Predicate(path, op, parse_list(operand[1:-1], exact))
        elif operand:
            return Predicate(path, op, parse_value(operand, exact))
    raise ValueError(f"can't read the predicate {text!r}")


# ---- numbers -----------------------------------------------------------------------------------------------


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def as_term(v: Any) -> str | None:
    """Strings and booleans are indexed as terms."""
    if isinstance(v, bool):
        return "true" if v else "false"
    return v if isinstance(v, str) else None


def exact_int(v: Any) -> int | None:
    """The 64-bit integer that a number equals, if there is one."""
    if not is_number(v) or isinstance(v, float) and (not math.isfinite(v) or v != math.floor(v)):
        return None
    return int(v) if INT_MIN <= int(v) <= INT_MAX else None


def rounded_int(v: Any, up: bool) -> int | None:
    """A bound on an integer column: the number rounded up or down, if that is a 64-bit integer."""
    if not is_number(v) or isinstance(v, float) and not math.isfinite(v):
        return None
    r = int(math.ceil(v) if up else math.floor(v))
    return r if INT_MIN <= r <= INT_MAX else None
