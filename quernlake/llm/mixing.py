"""Mixing sources to target weights by the cube method.

Each document's inclusion probability follows from its source's target weight.  The flight phase moves the
probabilities within the null space of the balancing constraints (documents and tokens of the source), in cells of
some thousand documents in parallel, until at most two of a cell are still fractional; those are put together
into new cells, again and again, until what is left of a source fits one cell.  The landing decides it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernlake.llm.tables import discard, fresh, saved

CELL, POWER, EPS = 4096, 0.5, 1e-9
SHARE, TAIL = 0.5, 0.01  # of the tokens: what the mixture holds at least, and what the sources that don't bound it have at most
TOKENS = r"regexp_count(text, '[^ \\t\\n\\x0B\\f\\r]+')"


def flight(pi: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """Moves probabilities to 0 or 1 while their sum and their sum times tokens, the expected documents and
    tokens, stay: three fractional units at a time have a null vector of the two constraints."""
    rng = np.random.default_rng(seed)
    pi = pi.tolist()
    size = tokens.astype(float).tolist()
    draw = iter(())
    live: list[int] = []
    for k in rng.permutation(len(pi)).tolist():
        if not EPS < pi[k] < 1 - EPS:
            pi[k] = round(pi[k])
            continue
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        # null vector of [[1, 1, 1], [t_a, t_b, t_c]]
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u[0] == u[1] == u[2] == 0:  # equal sizes: one constraint only
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, d in zip((pi[a], pi[b], pi[c]), u):
            if d > 0:
                up, down = min(up, (1 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, -x / d), min(down, (x - 1) / d)
        r = next(draw, None)
        if r is None:
            draw = iter(rng.random(4096).tolist())
            r = next(draw)
        step = up if r < down / (up + down) else -down
        live = []
        for i, d in zip((a, b, c), u):
            x = pi[i] + step * d
            pi[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
            if 0 < pi[i] < 1:
                live.append(i)
    return np.array(pi)


def landing(pi: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """Decides the two or fewer fractional units that a flight leaves: the token constraint is given up first, then
    the number of documents."""
    pi = pi.copy()
    rng = np.random.default_rng(seed + 1)
    left = np.flatnonzero((pi > 0) & (pi < 1))
    while len(left) > 1:
        a, b = left[:2]
        up, down = min(1 - pi[a], pi[b]), min(pi[a], 1 - pi[b])
        step = up if rng.random() < down / (up + down) else -down
        pi[a], pi[b] = pi[a] + step, pi[b] - step
        pi[[a, b]] = np.where(pi[[a, b]] < EPS, 0, np.where(pi[[a, b]] > 1 - EPS, 1, pi[[a, b]]))
        left = np.flatnonzero((pi > 0) & (pi < 1))
    if len(left):
        pi[left] = rng.random() < pi[left]
    return pi


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "tokens"]).reset_index(drop=True)
        seed = int(pdf["seed"].iloc[0]) & 0x7FFFFFFF
        pi = flight(pdf["pi"].to_numpy(), pdf["tokens"].to_numpy(), seed)
        if last:
            pi = landing(pi, pdf["tokens"].to_numpy(), seed)
        return pdf[["unit", "source", "tokens"]].assign(pi=pi)

    return run


def probabilities(sizes: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, share: float = SHARE) -> DataFrame:
    """(source, p): the inclusion probability of each source, from (source, tokens).

    The tokens kept of the sources are in proportion to ``weights``, or, without them, to their tokens to the
    ``power`` (a temperature).  The total is the greatest for which no source is used up more than once, but for the
    scarcest sources, which have ``TAIL`` of the tokens together at most: these are kept whole.  If that is less than
    ``share`` of the tokens of the sources that have a weight, the total is that share: sources too small for
    their part are kept whole, and the others make up for them in proportion to their weights.
    A source without a weight, or of weight 0, gives nothing.
    """
    spark = sizes.sparkSession
    if weights is None:
        want = sizes.select("source", "tokens", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("w"))
    else:
        table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "source string, w double")
        want = sizes.join(F.broadcast(table), sizes["source"].eqNullSafe(table["source"]), "left").select(sizes["source"], "tokens", F.coalesce("w", F.lit(0.0)).alias("w"))
    # one row a source; the scarcest come first, and are used up first as the total grows
    scarce = Window.orderBy("fit", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = want.where("w > 0 and tokens > 0").withColumn("fit", F.col("tokens") / F.col("w"))
    ranked = ranked.withColumn("t", F.sum("tokens").over(scarce)).withColumn("v", F.sum("w").over(scarce))
    ranked = ranked.crossJoin(F.broadcast(want.where("w > 0 and tokens > 0").agg(F.sum("tokens").alias("all_t"), F.sum("w").alias("all_w"))))
    filled = F.col("t") + F.col("fit") * F.greatest(F.lit(0.0), F.col("all_w") - F.col("v"))  # tokens kept when this source is just used up
    goal = F.lit(share) * F.col("all_t")
    level = (goal - (F.col("t") - F.col("tokens"))) / (F.col("all_w") - (F.col("v") - F.col("w")))
    fit = ranked.agg(
        F.min(F.when(F.col("t") > TAIL * F.col("all_t"), F.col("fit"))).alias("whole"),
        F.min_by(F.least(level, F.col("fit")), F.when(filled >= goal * (1 - EPS), F.col("fit"))).alias("filled"),
    ).select(F.greatest("whole", "filled").alias("fit"))
    return want.crossJoin(F.broadcast(fit)).select("source", F.when((F.col("tokens") > 0) & (F.col("w") > 0), F.least(F.lit(1.0), F.col("w") * F.col("fit") / F.col("tokens"))).otherwise(0.0).alias("p"))


def balanced_sample(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, cell: int = CELL, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, p): the documents of the mixture, with their inclusion probability.

    For every source, the documents and the tokens kept are the expected ones but for what the last one or two
    documents make.  A null source is a source of its own.  Tokens are runs of non-blank characters; null and blank
    texts have 0 and count as documents, except in a source that has no token at all, which gives nothing.  Rows with
    a null ``doc_id`` are left out; rows that repeat an id are one document, with the most tokens (its least source).
    The draw depends on ``seed`` and the rows alone, not on their order or partitions.  Extra columns are ignored.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("unit"), F.col("source").cast("string").alias("source"), F.coalesce(F.expr(TOKENS), F.lit(0)).cast("bigint").alias("tokens"))
    units = saved(rows.groupBy("unit").agg(F.max(F.struct("tokens", "source")).alias("m")).select("unit", "m.source", "m.tokens"), "units")
    sizes = units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    p = saved(probabilities(sizes.select("source", "tokens"), weights, power).withColumnRenamed("source", "from"), "probabilities")
    state = units.join(p, F.col("source").eqNullSafe(F.col("from"))).select("unit", "source", "tokens", F.col("p").alias("pi"))
    decided, level, tables = [], 0, [units, p]
    open_ = state
    while True:
        counts = open_.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "of")
        cells = F.greatest(F.lit(1), F.ceil(F.col("n") / cell))
        placed = open_.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn("cell", F.pmod(F.xxhash64("unit", F.lit(seed + level)), cells))
        final = counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] <= cell
        placed = placed.withColumn("seed", F.xxhash64("source", "cell", F.lit(seed + level))).drop("of", "n")
        flown = saved(placed.groupBy("source", "cell").applyInPandas(_fly(final), "unit bigint, source string, tokens bigint, pi double"), "flown")
        tables.append(flown)
        decided.append(flown.where("pi = 1"))
        if final:
            break
        open_ = flown.where("pi > 0 and pi < 1")
        level += 1
    chosen = decided[0]
    for x in decided[1:]:
        chosen = chosen.union(x)
    out = saved(chosen.drop("pi").join(p, F.col("source").eqNullSafe(F.col("from"))).select(F.col("unit").alias("doc_id"), "source", "tokens", "p"), "chosen")
    for x in tables:
        discard(x)
    return out


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """``docs`` without the rows that the sample doesn't hold; all columns as they were.

    Rows with a null id go; rows that repeat an id stay or go together, decided by the row with the most tokens.  Null and
    blank texts are documents of 0 tokens and as probable as the others of their source; a null source is one.  An
    empty table stays empty.
    """
    chosen = balanced_sample(docs, weights, power).select(F.col("doc_id").alias(fresh(docs, "chosen_id")))
    kept = docs.join(chosen, F.col("doc_id").cast("bigint") == F.col(chosen.columns[0]), "left_semi")
    return kept
