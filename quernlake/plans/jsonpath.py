"""The JSONPath subset of predicates and configuration: children, bracketed children and array wildcards."""

from __future__ import annotations

import re

DERIVED = "__derived:"


class JSONPathError(ValueError):
    def __init__(self, path: str, reason: str):
        super().__init__(f"JSONPath {path!r}: {reason}")
        self.path, self.reason = path, reason


_STEP = re.compile(
    r"""\.(?P<all>\*)|\.(?P<child>[^\s.\[\]'"*?()@,:]+)|\[(?P<star>\*)\]|\[\s*'(?P<single>(?:[^'\\]|\\.)*)'\s*\]|\[\s*"(?P<double>(?:[^"\\]|\\.)*)"\s*\]"""
)
_REFUSED = (
    (re.compile(r"\.\."), "recursive descent isn't supported"),
    (re.compile(r"\[\s*-?\d*\s*:"), "slices aren't supported"),
    (re.compile(r"\[\s*\?"), "filters aren't supported"),
    (re.compile(r"\[\s*\("), "scripts aren't supported"),
    (re.compile(r"\[\s*-?\d+\s*\]"), "array positions aren't supported"),
    (re.compile(r"\[[^\]]*,"), "unions aren't supported"),
)


def parse(path: str) -> list[str]:
    """Steps of a path: ``.name`` or ``[*]`` (``.*`` stays as it is)."""
    if not path:
        raise JSONPathError(path, "it is empty")
    if path.startswith(DERIVED):
        raise JSONPathError(path, "the prefix is reserved")
    if path[0] != "$":
        raise JSONPathError(path, "it must start with $")
    at, steps = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            why = next((w for r, w in _REFUSED if r.match(path, at)), f"bad step at {path[at:]!r}")
            raise JSONPathError(path, why)
        if m["star"]:
            steps.append("[*]")
        elif m["all"]:
            steps.append(".*")
        else:
            name = m["child"] or re.sub(r"\\(.)", r"\1", m["single"] if m["single"] is not None else m["double"])
            steps.append("." + name)
        at = m.end()
    return steps


def validate(path: str) -> None:
    parse(path)


def is_valid(path: str) -> bool:
    try:
        parse(path)
    except JSONPathError:
        return False
    return True


def canonical(path: str) -> str:
    """``$['a']["b"]`` as ``$.a.b``."""
    return "$" + "".join(parse(path))


def normalized(path: str) -> str:
    """The canonical form of a valid path; others as they are."""
    try:
        return canonical(path)
    except JSONPathError:
        return path


def derived(path: str, alias: str) -> str:
    """The path under which a companion representation is indexed."""
    return f"{DERIVED}{path}#{alias}"


def is_derived(path: str) -> bool:
    return path.startswith(DERIVED)
