"""Which row groups may hold a document that satisfies all predicates.

A predicate becomes a plan that gives ``rg_id``; a conjunction is a chain of semi-joins from the universe of row groups,
complements are anti-joins.  ``compat`` mode answers as the established semantics do, also where those can drop a row
group with a match (inequalities over row groups of several documents, some regular expressions); ``sound`` mode,
the default, never does.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.functions.text import python_ngrams
from quernlake.operators import rgset
from quernlake.operators.index import ADAPTIVE, BLOOM_ONLY, EXACT_MODE, Entry, Index, bucket
from quernlake.operators.observe import observed
from quernlake.plans import jsonpath, regex_literals
from quernlake.plans.predicates import Aliased, Predicate, as_term, exact_int, is_number, rounded_int

ALL, NONE = "all", "none"
FLAGS = 64  # trigrams that one aggregation looks for
Rgs = "DataFrame | str"


@dataclass
class _Plan:
    """A set of row groups: everything, nothing, or a plan; ``exact`` if no row group is in it for want of knowledge (or a
    function that finds out)."""

    rgs: Any
    exact: Any = True

    def is_exact(self) -> bool:
        return self.exact() if callable(self.exact) else self.exact


def _resolve(index: Index, p: Predicate) -> tuple[str, Any] | None:
    """(indexed path, value) of a predicate; None if it can't be resolved, which makes it say nothing."""
    value = p.value
    if not jsonpath.is_valid(p.path):
        return None
    path = jsonpath.canonical(p.path)
    if p.op in ("IN", "NOT IN") and isinstance(value, tuple) and any(isinstance(v, Aliased) for v in value):
        aliases = {v.alias if isinstance(v, Aliased) else None for v in value}
        if len(aliases) > 1:
            return None
        value = Aliased(value[0].alias, tuple(v.value for v in value))
    if isinstance(value, Aliased):
        path = index.representations.get((path, value.alias))
        value = value.value
        if isinstance(value, list):
            value = tuple(value)
    return None if path is None else (path, value)


@observed("evaluate")
def candidates(index: Index, predicates: list[Predicate], mode: str = "sound") -> DataFrame:
    """Distinct ``rg_id`` of the row groups that may hold a match.  No predicate: all of them."""
    if mode not in ("sound", "compat"):
        raise ValueError(f"mode {mode!r}")
    resolved = [(p, _resolve(index, p)) for p in predicates]
    entries = index.entries([r[0] for _, r in resolved if r])
    out = index.table("row_groups").select("rg_id")
    for p, r in resolved:
        entry = entries[r[0]] if r else None
        if entry is None:
            continue  # an unknown path says nothing
        plan = _Evaluator(index, entry, mode).predicate(p.op, r[1])
        if isinstance(plan.rgs, str):
            if plan.rgs == NONE:
                return index.table("row_groups").select("rg_id").limit(0)
            continue
        out = rgset.intersect(out, plan.rgs)
    return out


def matching_doc_ids(index: Index, rgs: DataFrame) -> DataFrame:
    """(rg_id, doc_id) of row groups; the id is the row group's number where none is known."""
    ids = index.table("doc_id_map").select("rg_id", "doc_id")
    return rgs.select("rg_id").join(ids, "rg_id", "left").select("rg_id", F.coalesce("doc_id", "rg_id").alias("doc_id"))


class _Evaluator:
    def __init__(self, index: Index, entry: Entry, mode: str):
        self.index, self.e, self.sound = index, entry, mode == "sound"
        # a sound answer about a term is exact: postings of adaptive paths are made, and written, as those of exact ones are
        self.exact_terms = entry.mode == EXACT_MODE or (self.sound and entry.mode == ADAPTIVE)

    def table(self, name: str) -> DataFrame:
        return self.index.table(name, self.e.path)

    def present(self) -> DataFrame:
        return self.table("null_stats").select("rg_id")

    def predicate(self, op: str, value: Any) -> _Plan:
        if op == "=":
            return self.eq(value)
        if op == "!=":
            return self.none_of([value]) if self.sound else self.complement(self.eq(value), as_term(value) is not None)
        if op in (">", ">=", "<", "<="):
            return self.compare(op, value)
        if op == "IN":
            return self.isin(value)
        if op == "NOT IN":
            if self.sound:
                return self.none_of(list(value)) if isinstance(value, tuple) else _Plan(ALL)
            if not isinstance(value, tuple):
                return _Plan(ALL) if self.e.mode == ADAPTIVE else _Plan(NONE)
            return self.complement(self.isin(value), all(as_term(v) is not None for v in value))
        if op == "IS NULL":
            return _Plan(self.table("null_stats").where("has_null").select("rg_id"))
        if op == "IS NOT NULL":
            return _Plan(self.present())
        if op == "CONTAINS":
            return self.contains(value)
        return self.regex(value)

    # -- equality

    def eq(self, value: Any) -> _Plan:
        term = as_term(value)
        if term is not None:
            return self.term(term)
        if is_number(value) and self.e.numeric:
            return self.number(value)
        return _Plan(ALL, False)

    def term(self, term: str) -> _Plan:
        e, bloom = self.e, self.index.bloom
        if bloom is not None and not bloom.may_contain(f"{e.path}={term}"):
            return _Plan(NONE)
        if not e.has_strings:
            # without a term on the path, the value can't be there; the looser answer needs the filter's false positive
            return _Plan(NONE)
        if not e.len_min <= len(term.encode()) <= e.len_max:
            return _Plan(NONE)
        if e.mode == BLOOM_ONLY:
            return _Plan(ALL, False)
        if not self.exact_terms:
            # in each segment: where the term is promoted those row groups, else those of its bucket
            hot = self.table("promoted").where(F.col("term") == term)
            cold = self.table("buckets").where(F.col("bucket") == bucket(F.lit(term), self.index.config.adaptive_buckets))
            found = hot.select("rg_id").union(cold.join(hot.select("segment").distinct(), "segment", "left_anti").select("rg_id"))
            if self.index.written:  # segments in which the path isn't adaptive have exact postings
                found = found.union(self.table("string_postings").where(F.col("term") == term).select("rg_id"))
            return _Plan(found, lambda: not hot.isEmpty())
        return _Plan(self.table("string_postings").where(F.col("term") == term).select("rg_id"))

    def number(self, value: Any) -> _Plan:
        stats, i, d = self.table("numeric_stats"), exact_int(value), float(value)
        whole = (F.col("imin") <= i) & (F.col("imax") >= i) if i is not None else F.lit(False)
        if self.e.numeric == "int":
            return _Plan(NONE) if i is None else _Plan(stats.where(whole).select("rg_id"), False)
        # row groups of integers only are compared as such: doubles would merge neighbours
        return _Plan(stats.where(F.when(F.col("floats"), (F.col("dmin") <= d) & (F.col("dmax") >= d)).otherwise(whole)).select("rg_id"), False)

    def isin(self, values: Any) -> _Plan:
        if not isinstance(values, tuple):
            return _Plan(ALL, False)
        plans = [self.eq(v) for v in dict.fromkeys(values)]
        if any(isinstance(p.rgs, str) and p.rgs == ALL for p in plans):
            return _Plan(ALL, False)
        terms = [as_term(v) for v in values if as_term(v) is not None]
        every = list(plans)
        exact = lambda: all(p.is_exact() for p in every)
        parts = []
        if terms and self.exact_terms and self.e.has_strings:
            parts.append(self.table("string_postings").where(F.col("term").isin(terms)).select("rg_id"))
            plans = [p for v, p in zip(dict.fromkeys(values), plans) if as_term(v) is None]
        parts += [p.rgs for p in plans if not isinstance(p.rgs, str)]
        if not parts:
            return _Plan(NONE)
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
        return _Plan(out, exact)

    def complement(self, plan: _Plan, terms: bool) -> _Plan:
        """Present row groups that aren't in ``plan``.  On an adaptive path, a set that isn't exact rules out nothing."""
        if self.e.mode == ADAPTIVE and terms and not plan.is_exact():
            return _Plan(self.present())
        if isinstance(plan.rgs, str):
            return _Plan(NONE) if plan.rgs == ALL else _Plan(self.present())
        return _Plan(rgset.invert(plan.rgs, self.present()))

    def none_of(self, values: list[Any]) -> _Plan:
        """Row groups in which some value differs from all of ``values``: those with another term, with a number
        range wider than one of the values, or with anything that isn't indexed by value."""
        if any(as_term(v) is None and not is_number(v) for v in values):
            return _Plan(ALL, False)
        e = self.e
        terms = [t for t in map(as_term, values) if t is not None]
        parts = []
        if e.has_strings:
            if not self.exact_terms:
                return _Plan(self.present(), False)
            parts.append(self.table("string_postings").where(~F.col("term").isin(terms) if terms else F.lit(True)).select("rg_id"))
        if e.numeric:
            stats = self.table("numeric_stats")
            numbers = [float(v) for v in values if is_number(v)]
            same = F.lit(False)
            for v in numbers:
                same = same | ((F.col("dmin") == v) & (F.col("dmax") == v))
            exact_ints = [exact_int(v) for v in values if is_number(v)]
            whole = F.lit(False)  # of row groups of integers only, as doubles may merge neighbours
            for v in exact_ints:
                if v is not None:
                    whole = whole | ((F.col("imin") == v) & (F.col("imax") == v))
            parts.append(stats.where(~F.when(F.col("floats"), same).otherwise(whole)).select("rg_id"))
        if not parts:
            return _Plan(self.present(), False) if not e.types & 15 else _Plan(NONE)
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
        return _Plan(out, False)

    # -- ranges

    def compare(self, op: str, value: Any) -> _Plan:
        e = self.e
        if not is_number(value) or not e.numeric:
            return _Plan(ALL, False)
        tests = {">": lambda low, high, v: high > v, ">=": lambda low, high, v: high >= v, "<": lambda low, high, v: low < v, "<=": lambda low, high, v: low <= v}
        stats, test, i, d = self.table("numeric_stats"), tests[op], rounded_int(value, up=op in (">=", "<")), float(value)
        if e.numeric == "int":
            if i is None:
                return _Plan(ALL, False)
            if not test(e.imin, e.imax, i):
                return _Plan(NONE)
            return _Plan(stats.where(test(F.col("imin"), F.col("imax"), i)).select("rg_id"), False)
        # of a mixed path, row groups of integers only are compared as such
        whole = test(F.col("imin"), F.col("imax"), i) if i is not None else test(F.col("dmin"), F.col("dmax"), d)
        return _Plan(stats.where(F.when(F.col("floats"), test(F.col("dmin"), F.col("dmax"), d)).otherwise(whole)).select("rg_id"), False)

    # -- text

    def contains(self, value: Any) -> _Plan:
        if not isinstance(value, str) or not self.e.has_trigrams:
            return _Plan(ALL, False)
        return self.conjunction([value])

    def conjunction(self, literals: list[str]) -> _Plan:
        """Row groups that have all trigrams of all literals."""
        if any(len(x) < 3 for x in literals):
            literals = [x for x in literals if len(x) >= 3]
        grams = list(dict.fromkeys(g for x in literals for g in python_ngrams(x)))
        if not grams:
            return _Plan(ALL, False)
        if self.index.written:
            rows = self.table("trigrams").where(F.col("gram").isin(grams))
            full = rows.groupBy("rg_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("rg_id")
        else:
            full = self.holding(grams)
        if self.sound and self.index.config.trigram_min_length > 3:
            # shorter strings aren't in the trigram table
            short = self.table("strlen_stats").where(F.col("len_min") < self.index.config.trigram_min_length).select("rg_id")
            full = full.union(short)
        return _Plan(full, False)

    def holding(self, grams: list[str]) -> DataFrame:
        """Row groups whose texts hold all trigrams, without the table of all trigrams: one flag for each asked, some at a
        time, in one aggregation over the texts."""
        rows = self.table("observations").where("kind in ('string', 'bool')").where(F.octet_length("s") >= self.index.config.trigram_min_length)
        out = None
        for k in range(0, len(grams), FLAGS):
            some = grams[k : k + FLAGS]
            flags = rows.groupBy("rg_id").agg(*[F.bool_or(F.contains(F.lower("s"), F.lit(g))).alias(f"g{j}") for j, g in enumerate(some)])
            found = flags.where(" and ".join(f"g{j}" for j in range(len(some)))).select("rg_id")
            out = found if out is None else rgset.intersect(out, found)
        return out

    def regex(self, value: Any) -> _Plan:
        if not isinstance(value, str) or not self.e.has_trigrams:
            return _Plan(ALL, False)
        try:
            if self.sound:
                branches = [sorted(b) for b in regex_literals.required(value)]
                usable = [[x for x in b if len(x) >= 3] for b in branches]
            else:
                flat = regex_literals.compat_literals(value)
                if not flat or any(len(x.encode()) < 3 for x in flat):
                    return _Plan(ALL, False)
                usable = [[x] for x in flat]
        except regex_literals.RegexError:
            return _Plan(ALL, False)
        if not usable or any(not b for b in usable):
            return _Plan(ALL, False)
        plans = [self.conjunction(b) for b in usable]
        if any(isinstance(p.rgs, str) for p in plans):
            return _Plan(ALL, False)
        out = plans[0].rgs
        for p in plans[1:]:
            out = out.union(p.rgs)
        return _Plan(out, False)
