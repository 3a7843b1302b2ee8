"""Toxic clauses by a weighted finite-state pattern grammar.

Words are read as symbols (insult, threat, target, negation, reporting verb, opening quote, ...).  Five
transducers, each deterministic, read and rewrite the symbols of a clause and pay weights: negation and reported speech
mark what they govern, the target transducer marks what is aimed at someone, the insult and threat transducers pay.
Their composition is compiled to one table of states, which runs over the clauses that hold an insult or threat.

The insults and threats are a small multilingual seed and the words that labelled toxic documents have and clean ones
don't, with a weight from their log odds; that lexicon is fitted on a bounded sample of labels.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm import textvec
from quernlake.llm.tables import texts

U64 = np.uint64
SAMPLE, SUPPORT, ODDS, CERTAIN, THRESHOLD = 20000, 3, 3.0, 5.0, 1.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
SEED = {
    INSULT: "idiot idiots moron morons imbecile scum loser losers worthless disgusting pathetic stupid idiota imbécil estúpido estúpida basura asqueroso connard imbécile abruti ordure minable dumm dummkopf abschaum versager widerlich arschloch trottel",
    THREAT: "kill murder hurt destroy strangle töten umbringen matar matarte tuer frapper",
    TARGET: "you your youre u they them him her he she du dich dir ihr euch sie tú te usted ustedes eres tu vous toi es êtes",
    NEGATION: "not no never isn aren wasn don doesn ain nobody without nicht kein keine nie niemals jamais pas aucun aucune nunca ni sin",
    REPORT: "said says say wrote writes claimed claims called quoted reported alleged according sagte schrieb behauptete nannte dit écrit appelé affirmé dijo escribió llamó afirmó",
}
# what a symbol becomes on its way through the composition
NEGATED, QUOTED, AIMED = 8, 16, 32


@dataclass
class Transducer:
    """Deterministic: step(state, symbol) -> (state, symbol, weight).  States are counted from 0, the start."""

    states: int
    step: object


def _window(opens: set[int], length: int, mark: int, over: set[int]) -> Transducer:
    """Marks the symbols of ``over`` that come within ``length`` symbols after one of ``opens``."""

    def step(state: int, symbol: int) -> tuple[int, int, float]:
        base = symbol & 7
        if base in opens:
            return length, symbol, 0.0
        return max(0, state - 1), symbol | mark if state and base in over else symbol, 0.0

    return Transducer(length + 1, step)


def negation() -> Transducer:
    return _window({NEGATION}, 3, NEGATED, {INSULT, THREAT})


def reported() -> Transducer:
    return _window({REPORT, QUOTE}, 12, QUOTED, {INSULT, THREAT})


def targets() -> Transducer:
    return _window({TARGET}, 6, AIMED, {INSULT})


def insults() -> Transducer:
    """Pays 1.5 for an insult that is aimed at someone, 0.6 for another: too little, whatever the word's weight, to decide
    alone.  A further insult of the clause pays 1, or 1.5.  Negated and reported ones pay 0.2, once."""

    def step(state: int, symbol: int) -> tuple[int, int, float]:
        if symbol & 7 != INSULT:
            return state, symbol, 0.0
        if symbol & (NEGATED | QUOTED):
            return state | 2, symbol, 0.0 if state & 2 else 0.2
        return state | 1, symbol, 1.5 if symbol & AIMED else 1.0 if state & 1 else 0.6

    return Transducer(4, step)


def threats() -> Transducer:
    """Pays 1.5 for a threat with a target after it, within 3 symbols; nothing for a threat without."""

    def step(state: int, symbol: int) -> tuple[int, int, float]:
        if symbol & 7 == THREAT:
            return 0 if symbol & (NEGATED | QUOTED) else 3, symbol, 0.0
        if symbol & 7 == TARGET and state:
            return 0, symbol, 1.5
        return max(0, state - 1), symbol, 0.0

    return Transducer(4, step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``first`` writes, ``second`` reads; weights add up."""

    def step(state: int, symbol: int) -> tuple[int, int, float]:
        a, b = divmod(state, second.states)
        a, symbol, v = first.step(a, symbol)
        b, symbol, w = second.step(b, symbol)
        return a * second.states + b, symbol, v + w

    return Transducer(first.states * second.states, step)


def grammar() -> Transducer:
    out = negation()
    for t in (reported(), targets(), insults(), threats()):
        out = compose(out, t)
    return out


class Machine:
    """The states of a transducer that its input symbols reach, as a table."""

    def __init__(self, t: Transducer, symbols: int = 7):
        seen, todo = {0: 0}, [0]
        self.next: list[list[int]] = []
        self.pays: list[list[float]] = []
        while len(self.next) < len(todo):
            state = todo[len(self.next)]
            row = [t.step(state, s) for s in range(symbols)]
            for to, _, _ in row:
                if to not in seen:
                    seen[to] = len(todo)
                    todo.append(to)
            self.next.append([seen[to] for to, _, _ in row])
            self.pays.append([w for _, _, w in row])

    def score(self, symbols: list[int], weights: list[float]) -> float:
        """Of a clause: what its symbols pay, times the weights of the words that pay."""
        state, total = 0, 0.0
        for s, w in zip(symbols, weights):
            total += self.pays[state][s] * w
            state = self.next[state][s]
        return total


@dataclass
class Lexicon:
    """Sorted word hashes with their symbol and weight."""

    hashes: np.ndarray
    symbols: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(learned: dict[int, float]) -> Lexicon:
        table = {h: (INSULT, w) for h, w in learned.items()}
        for symbol, words in SEED.items():
            for part in textvec.hash_words(words).tolist():
                table[part] = (symbol, max(1.0, table.get(part, (0, 1.0))[1]))
        keys = sorted(table)
        return Lexicon(np.array(keys, U64), np.array([table[k][0] for k in keys]), np.array([table[k][1] for k in keys]))

    def read(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.symbols[at], OTHER), np.where(known, self.weights[at], 1.0)


_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 58, 59, 63]] = True  # line feed ! . : ; ?


REACH, BEFORE = 24, 13  # symbols over which insults of a clause add up; what may bear on one before it


def _near(symbols: list[int]) -> list[tuple[int, int]]:
    """The clause, cut where insults and threats are more than ``REACH`` apart: unpunctuated texts are no one clause."""
    hot = [k for k, s in enumerate(symbols) if s in (INSULT, THREAT)]
    cut = [0, *(b - BEFORE for a, b in zip(hot, hot[1:]) if b - a > REACH), len(symbols)]
    return list(zip(cut, cut[1:]))


def clauses(w: textvec.Words, lexicon: Lexicon, machine: Machine) -> Iterator[tuple[int, int, float]]:
    """(document, word, score) of each clause that scores; a clause ends at . ! ? ; : or a line break, outside of words."""
    symbol, weight = lexicon.read(w.hashes)
    hot = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(hot):
        return
    ends = np.r_[0, np.cumsum(_ENDS[w.buffer])]
    quotes = np.r_[0, np.cumsum(w.buffer == 34)]
    clause = np.cumsum(np.r_[0, (ends[w.starts[1:]] != ends[w.ends[:-1]])])
    clause = clause + w.owner()  # a document's end is a clause's end
    first = np.searchsorted(clause, clause[hot])
    last = np.searchsorted(clause, clause[hot], side="right")
    owner = w.owner()
    done = -1
    for h, a, b in zip(hot.tolist(), first.tolist(), last.tolist()):
        if clause[h] == done:
            continue
        done = clause[h]
        begin = w.starts[a]
        opened = (quotes[w.starts[a:b]] - quotes[begin]) % 2
        # a word right after an opening quote is preceded by the quote's own symbol
        symbols, weights, inside = [], [], 0
        for s, v, o in zip(symbol[a:b].tolist(), weight[a:b].tolist(), opened.tolist()):
            if o and not inside:
                symbols.append(QUOTE)
                weights.append(1.0)
            inside = o
            symbols.append(s)
            weights.append(v)
        score = max(machine.score(symbols[x:y], weights[x:y]) for x, y in _near(symbols))
        if score > 0:
            yield int(owner[h]), h, score


PASSAGE, FAINT = 200, 0.3  # words over which clauses add up; score from above which they do: negated and reported insults don't


def scores(texts_: pa.Array, lexicon: Lexicon, machine: Machine) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the score of its worst clause or passage, whichever is more, and the number of clauses that score."""
    total, many = np.zeros(len(texts_)), np.zeros(len(texts_), np.int64)
    for at, w in textvec.chunks(texts_, "words", lower=True):
        near: deque[tuple[int, float]] = deque()
        held, last = 0.0, -1
        for d, place, score in clauses(w, lexicon, machine):
            if d != last:
                near, held, last = deque(), 0.0, d
            if score > FAINT:
                near.append((place, score))
                held += score
                while place - near[0][0] > PASSAGE:
                    held -= near.popleft()[1]
            total[at + d] = max(total[at + d], score, held if score > FAINT else 0.0)
            many[at + d] += 1
    return total, many


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, sketch) for each distinct word of a labelled text; copies of one text share sketches."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for at, w in textvec.chunks(batch.column(0), "words", lower=True):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for d in np.flatnonzero(np.diff(w.first)):
                words = w.hashes[w.first[d] : w.first[d + 1]]
                distinct = np.unique(words)
                sketch = textvec.grams(words, min(2, len(words))).min() >> U64(1)
                out.append((distinct.view(np.int64), np.full(len(distinct), toxic[at + d], np.int32), np.full(len(distinct), sketch, U64).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["word", "toxic", "sketch"])


def learned(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict[int, float]:
    """Weights of the words that tell toxic documents: their log odds, ``CERTAIN`` being weight 1, from ``ODDS`` up, of
    words in ``SUPPORT`` toxic documents at least that aren't copies of each other.  Fitted on ``bound`` labelled documents at most (those with the
    least hash of their id), whose words are counted in the cluster; the words found come to the driver."""
    named = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    few = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = texts(docs.where("text is not null and doc_id is not null")).join(F.broadcast(few), "doc_id").select("text", "toxic")
    words = rows.mapInArrow(_words, "word bigint, toxic int, sketch bigint")
    counts = words.groupBy("word", "sketch").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("clean"))
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("clean")).alias("c"))
    total = few.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    nt, nc = (total[0] or 0) + 1, (total[1] or 0) + 1
    odds = F.log((F.col("t") + 0.5) / nt) - F.log((F.col("c") + 0.5) / nc)
    found = counts.where(F.col("t") >= SUPPORT).select("word", odds.alias("odds"), "t").where(F.col("odds") >= ODDS)
    return {int(np.int64(r["word"]).view(U64)): min(1.5, r["odds"] / CERTAIN) for r in found.collect()}


def toxic_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, score, n_clauses): the documents of which some clause, or the clauses of some ``PASSAGE`` words together, score 1
    or more, that score, and the number of clauses that score.  One insult or threat that is aimed at someone, and neither
    negated nor reported, is enough; others, and words that are less certain to be insults, need company nearby.

    Null, empty and wordless texts have none.  Rows with a null ``doc_id`` are judged too and reported with null;
    a repeated row is reported again.  Labels other than 0 and 1 are left out; without labels the seed lexicon alone is used.  Extra columns are ignored.
    """
    words = learned(docs, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon.of(words), Machine(grammar())
        for batch in batches:
            total, many = scores(batch.column(1), lexicon, machine)
            keep = np.flatnonzero(total >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(total[keep]), pa.array(many[keep])], names=["doc_id", "score", "n_clauses"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, n_clauses bigint")
