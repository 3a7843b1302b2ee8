"""Logging and timing around the library's boundaries.  Silent unless logging is configured; no data values are logged."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

LOG = logging.getLogger("quernlake")
LOG.addHandler(logging.NullHandler())
KEYS = ("operation", "predicate_op", "path_mode", "status", "error_type")
ERROR_TYPES = {"IngestError": "ingest", "FormatError": "format", "VersionMismatch": "version", "LimitExceeded": "limit", "NoIndex": "missing", "JSONPathError": "path", "RegexError": "regex"}


class Signals:
    """Durations and failures by operation; ``None`` in its place switches it off."""

    def __init__(self) -> None:
        self.seconds: dict[str, list[float]] = {}
        self.failures: Counter = Counter()


def error_type(e: BaseException) -> str:
    return ERROR_TYPES.get(type(e).__name__, "other")


@contextmanager
def boundary(operation: str, signals: Signals | None = None, **attributes: str) -> Iterator[None]:
    unknown = set(attributes) - set(KEYS)
    if unknown:
        raise ValueError(f"attributes {sorted(unknown)} aren't allowed")
    began, failed = time.perf_counter(), None
    try:
        yield
    except Exception as e:
        failed = error_type(e)
        raise
    finally:
        took = time.perf_counter() - began
        if signals is not None:
            signals.seconds.setdefault(operation, []).append(took)
            if failed:
                signals.failures[operation, failed] += 1
        LOG.info("%s", {"operation": operation, **attributes, "status": "error" if failed else "ok", **({"error_type": failed} if failed else {})})


_active: Signals | None = None


def use(signals: Signals | None) -> None:
    """Collects the library's durations and failures in ``signals`` from now on; None switches that off."""
    global _active
    _active = signals


def observed(operation: str) -> Callable[[Callable], Callable]:
    """Wraps a function of the library in a boundary."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(*args, **kwargs):
            with boundary(operation, _active):
                return f(*args, **kwargs)

        return run

    return wrap
