"""Mixing sources to target shares of tokens (problem 8): entropy balancing.

Every document of a source gets the rate ``min(cap, exp(l * tokens / mean))``, the rates nearest to one (in relative
entropy) that give the source its tokens within its cap.  The multipliers ``l``, one per source, solve a convex dual by
Newton steps, each an aggregation over the table of (source, tokens, number of documents).  Rates become whole copies by
carrying the rounding error on within a shard, in tokens and by falling size, so that a source misses its tokens by about
half a small document a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import VOCABULARY, column, sharded, with_tokens

STEPS = 60
TOLERANCE = 1e-7


def source_key(name: str = "source"):
    """Sources as compared: trimmed, lower-cased, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"[\s-]+", "_")


def solve_rates(histogram: DataFrame, weights: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[float, float, int]]:
    """{source: (multiplier, mean tokens, cap)} for ``histogram(source, tokens, n)``; sources that get nothing are left out.

    ``weights`` has (source, share, cap), shares in any scale.  ``total`` is the size of the mix in tokens; by default,
    and at most, the largest one that all sources with a share can fill, and never more than they hold.
    """
    have = {r.source: (float(r.t), float(r.t) / r.d) for r in histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("d")).collect()}
    wanted = [(s, w, c) for s, w, c in weights if w and w > 0 and c and c > 0 and have.get(s, (0,))[0] > 0]
    if not wanted:
        return {}
    scale = sum(w for _, w, _ in wanted)
    most = min(have[s][0] * c * scale / w for s, w, c in wanted)
    size = min(most, sum(have[s][0] for s, *_ in wanted), math.inf if total is None else total)
    goal = {s: size * w / scale for s, w, _ in wanted}
    cap = {s: c for s, _, c in wanted}
    low = {s: -800.0 for s in goal}
    high = {s: 800.0 for s in goal}
    at = {s: min(math.log(goal[s] / have[s][0]), math.log(cap[s]) if cap[s] > 1 else -1e-3) for s in goal}
    full = {s for s in goal if goal[s] >= cap[s] * have[s][0] * (1 - 1e-12)}
    for s in full:
        at[s] = 800.0
    for _ in range(STEPS):
        todo = [s for s in goal if s not in full]
        if not todo:
            break
        table = F.create_map(*[F.lit(x) for s in todo for x in (s, at[s] / have[s][1])])
        limit = F.create_map(*[F.lit(x) for s in todo for x in (s, math.log(cap[s]))])
        power = table[F.col("source")] * F.col("tokens")
        free = power < limit[F.col("source")]
        rate = F.exp(F.least(power, limit[F.col("source")]))
        mass = F.col("n") * F.col("tokens") * rate
        sums = histogram.where(F.col("source").isin(todo)).groupBy("source").agg(F.sum(mass).alias("got"), F.sum(F.when(free, mass * F.col("tokens")).otherwise(0.0)).alias("slope")).collect()
        done = True
        for r in sums:
            s, miss = r.source, r.got - goal[r.source]
            if abs(miss) <= TOLERANCE * goal[s]:
                continue
            done = False
            if miss > 0:
                high[s] = at[s]
            else:
                low[s] = at[s]
            slope = r.slope / have[s][1]
            step = at[s] - miss / slope if slope > 0 else math.inf
            at[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2  # Newton's step, kept within the bracket
        if done:
            break
    return {s: (at[s], have[s][1], cap[s]) for s in goal}


def _round(rates: dict[str, tuple[float, float, int]]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("source", "ascending"), ("tokens", "descending"), ("turn", "ascending"), ("doc_id", "ascending")])
        source, tokens = np.array(table.column("source").to_pylist(), object), column(table, "tokens")
        copies = np.zeros(len(tokens), np.int32)
        for s in dict.fromkeys(source.tolist()):
            l, mean, cap = rates[s]
            at = np.flatnonzero(source == s)
            t = tokens[at].astype(float)
            rate = np.exp(np.minimum(l / mean * t, math.log(cap)))
            owed, out = 0.0, np.zeros(len(at), np.int32)
            for i, (r, size) in enumerate(zip(rate.tolist(), t.tolist(), strict=True)):
                out[i] = min(max(math.floor(r + owed / size + 0.5), 0), cap)
                owed += (r - out[i]) * size
            copies[at] = out
        return pa.table({"doc_id": table.column("doc_id"), "source": table.column("source"), "tokens": tokens, "copies": copies})

    return run


def mix(documents: DataFrame, weights: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, copies) of ``documents(doc_id, source, text)`` for the small table ``weights``.

    ``weights(source, target_share, max_repeats)`` names the sources; names are compared as by :func:`source_key`.  All
    documents of the named sources have a row, with 0 copies where they aren't used.  Documents of other or null sources,
    null texts, texts of no tokens and null doc_ids have none; repeated rows of a doc_id count once.
    """
    listed = [(r.key, r.target_share or 0.0, r.max_repeats or 0) for r in weights.select(source_key().alias("key"), "target_share", "max_repeats").collect() if r.key]
    names = [s for s, *_ in listed]
    rows = documents.select("doc_id", source_key().alias("source"), "text").where(F.col("source").isin(names)) if names else documents.select("doc_id", "source", "text").where("false")
    sized = cut(with_tokens(rows, "text", vocabulary).where("doc_id IS NOT NULL AND tokens > 0").dropDuplicates(["doc_id"]), "sized")
    histogram = cut(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")), "histogram")
    rates = solve_rates(histogram, listed, total)
    used = sized.where(F.col("source").isin(list(rates)))
    size = int(used.agg(F.sum("tokens")).first()[0] or 0)
    schema = "doc_id long, source string, tokens long, copies int"
    rounded = sharded(used, "doc_id", size).groupBy("shard").applyInArrow(_round(rates), schema)
    rest = sized.where(~F.col("source").isin(list(rates))).select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
    return rounded.unionAll(rest)


def mix_report(copies: DataFrame, weights: DataFrame) -> DataFrame:
    """For every named source: the share asked for, the share reached, and what it took."""
    sums = copies.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens_available"), F.sum(F.expr("CASE WHEN copies > 0 THEN 1 ELSE 0 END")).alias("documents_used"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"))
    asked = weights.select(source_key().alias("source"), "target_share", "max_repeats")
    total = copies.agg(F.sum(F.col("tokens") * F.col("copies"))).scalar()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return asked.join(sums, "source", "left").select("source", "target_share", "max_repeats", *map(zero, ("documents", "tokens_available", "documents_used", "most_copies", "tokens_used")), F.round(F.coalesce(F.try_divide(F.col("tokens_used"), total), F.lit(0.0)), 6).alias("actual_share"))
