"""Build configuration."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from quernlake.plans import jsonpath

HARD, SOFT = "hard", "soft"


@dataclass(frozen=True)
class Representation:
    """A companion of a path: ``transformer`` (a registered name, or a callable from and to Columns) under ``alias``."""

    path: str
    alias: str
    transformer: Any
    params: dict = field(default_factory=dict)
    failure_mode: str = HARD

    @property
    def target(self) -> str:
        return jsonpath.derived(self.path, self.alias)

    @property
    def serializable(self) -> bool:
        return isinstance(self.transformer, str)


@dataclass(frozen=True)
class Config:
    cardinality_threshold: int = 10000
    bloom_bits: int = 65536
    bloom_hashes: int = 5
    enable_trigrams: bool = True
    trigram_min_length: int = 3
    hll_precision: int = 12
    prefix_block_size: int = 16
    adaptive_min_coverage: int = 2
    adaptive_cap: int = 64
    adaptive_ceiling: float = 0.80
    adaptive_buckets: int = 128
    parser_failure: str = HARD
    numeric_failure: str = HARD
    fts_paths: tuple[str, ...] = ()
    representations: tuple[Representation, ...] = ()

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(f"configuration: {what}")

        need(self.cardinality_threshold >= 0, "cardinality_threshold must not be negative")
        need(self.bloom_bits > 0 and self.bloom_hashes > 0, "bloom_bits and bloom_hashes must be positive")
        need(self.trigram_min_length >= 1, "trigram_min_length must be positive")
        need(4 <= self.hll_precision <= 16, "hll_precision must be from 4 to 16")
        need(0 <= self.prefix_block_size <= 65535, "prefix_block_size must be from 0 to 65535")
        need(self.adaptive_min_coverage >= 0, "adaptive_min_coverage must not be negative")
        need(0 <= self.adaptive_cap <= 65535, "adaptive_cap must be from 0 to 65535")
        need(0 < self.adaptive_ceiling < 1, "adaptive_ceiling must lie between 0 and 1")
        n = self.adaptive_buckets
        need(0 < n <= 4096 and n & (n - 1) == 0, "adaptive_buckets must be a power of two up to 4096")
        for mode in (self.parser_failure, self.numeric_failure, *(r.failure_mode for r in self.representations)):
            need(mode in (HARD, SOFT), f"failure mode {mode!r}")
        object.__setattr__(self, "fts_paths", tuple(p if p.endswith(".*") and jsonpath.is_valid(p[:-2]) else jsonpath.canonical(p) for p in self.fts_paths))
        seen = set()
        for r in self.representations:
            need(bool(r.alias) and "#" not in r.alias, f"alias {r.alias!r}")
            need((r.path, r.alias) not in seen, f"alias {r.alias!r} is registered twice for {r.path}")
            seen.add((r.path, r.alias))

    @property
    def adaptive(self) -> bool:
        return self.adaptive_cap > 0

    def full_text(self, path: str) -> bool:
        """Whether a path has a trigram index."""
        if not self.enable_trigrams:
            return False
        return not self.fts_paths or any(path == p or p.endswith(".*") and (path == p[:-2] or path.startswith(p[:-1])) for p in self.fts_paths)

    def with_representation(self, path: str, alias: str, transformer: Any, failure_mode: str = HARD, **params: Any) -> Config:
        from quernlake.functions.transformers import check

        check(transformer, params)
        one = Representation(jsonpath.canonical(path), alias, transformer, params, failure_mode)
        return replace(self, representations=(*self.representations, one))

    def with_field_transformer(self, *_: Any) -> Config:
        raise ValueError("a transformer can't replace a field; use with_representation(path, alias, ...)")

    def to_json(self) -> str:
        """Everything that decides how an index is read; custom transformers can't be written."""
        if not all(r.serializable for r in self.representations):
            raise ValueError("an index with custom transformers can't be stored")
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Config:
        raw = json.loads(text)
        raw["representations"] = tuple(Representation(**r) for r in raw["representations"])
        raw["fts_paths"] = tuple(raw["fts_paths"])
        return Config(**raw)
