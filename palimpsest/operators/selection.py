"""Bounded selection: thresholds, activation budgets, and greedy choices with marginal gains.

Everything up to a bounded candidate pool is relational. Greedy rules depend on what was chosen before, so they run per
query on its pool (at most ``pool`` rows, cut by rank beforehand, which is part of each rule) in applyInPandas.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mad_threshold(df: DataFrame, group: str, value: str, floor: float = 0.015, factor: float = 0.35) -> DataFrame:
    """(group, threshold): median plus a multiple of the median absolute deviation, at least ``floor``."""
    mid = df.groupBy(group).agg(F.median(value).alias("_m"))
    dev = df.join(mid, group).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    return dev.groupBy(group).agg(F.greatest(F.lit(floor), F.first("_m") + factor * F.median("_d")).alias("threshold"))


def softmax_activation(df: DataFrame, group: str, id_col: str, score: str, keep: int = 64, total: float = 12.0, temperature: float = 1.0) -> DataFrame:
    """(group, id, activation): softmax of the best ``keep`` scores of a group, scaled to ``total``."""
    w = Window.partitionBy(group)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(F.col(score).desc(), id_col))).where(F.col("_r") <= keep)
    r = r.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / temperature))
    return r.select(group, id_col, (F.col("_e") / F.sum("_e").over(w) * total).alias("activation"))


def entropy_budget(df: DataFrame, group: str, score: str, rank: str, floor: int = 4, ceiling: int = 8, temperature: float = 0.08, mass: float = 0.70) -> DataFrame:
    """(group, budget): how many of the first ``ceiling`` rows hold the wanted share of softmax mass, at least ``floor``."""
    w = Window.partitionBy(group)
    r = df.where(F.col(rank) <= ceiling)
    r = r.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / temperature)).withColumn("_n", F.count(F.lit(1)).over(w))
    r = r.withColumn("_share", F.sum("_e").over(w.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_e").over(w))
    enough = F.when((F.col(rank) >= F.least(F.lit(floor), F.col("_n"))) & (F.round("_share", 9) >= mass), F.col(rank))
    return r.groupBy(group).agg(F.coalesce(F.min(enough), F.max("_n")).cast("long").alias("budget"))


def running_budget(df: DataFrame, group: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of a group in order while their sizes fit the budget; the first is always taken."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(size).over(w)).where((F.col("_used") <= budget) | (F.col("_used") == size)).drop("_used")


def _pool(df: DataFrame, group: str, score: str, id_col: str, pool: int | None) -> DataFrame:
    """The best rows of each group that the greedy rule looks at; None takes all of them."""
    if pool is None:
        return df
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), id_col)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= pool).drop("_r")


def _per_group(df: DataFrame, group: str, id_col: str, choose: Callable[[pd.DataFrame], list[tuple[int, float]]]) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable").reset_index(drop=True)
        picked = choose(pdf)
        at = [i for i, _ in picked]
        return pd.DataFrame({group: pdf[group].iloc[at].to_numpy(), id_col: pdf[id_col].iloc[at].to_numpy(), "place": np.arange(1, len(at) + 1), "gain": [g for _, g in picked]})

    return df.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {id_col} {kinds[id_col]}, place long, gain double")


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def mmr(df: DataFrame, group: str, id_col: str, score: str, tokens: str, k: int = 10, trade: float = 0.82, pool: int | None = 192, size: str | None = None, budget: int | None = None) -> DataFrame:
    """Maximal marginal relevance: trade x score - (1 - trade) x greatest token overlap with what is chosen.

    With size and budget, rows that no longer fit are passed over once something is chosen. Ties go to the lower id.
    """

    def choose(p: pd.DataFrame) -> list[tuple[int, float]]:
        s, sets = p[score].to_numpy(float), [frozenset(x) if x is not None else frozenset() for x in p[tokens]]
        sizes = p[size].to_numpy(float) if size else np.zeros(len(p))
        red, left, used, out = np.zeros(len(p)), set(range(len(p))), 0.0, []
        while left and len(out) < k:
            fit = [i for i in left if not (budget is not None and out and used + sizes[i] > budget)]
            if not fit:
                break
            best = max(fit, key=lambda i: (round(trade * s[i] - (1 - trade) * red[i], 9), -i))
            out.append((best, float(trade * s[best] - (1 - trade) * red[best])))
            used += sizes[best]
            left.discard(best)
            for i in left:
                red[i] = max(red[i], _jaccard(sets[i], sets[best]))
        return out

    return _per_group(_pool(df, group, score, id_col, pool), group, id_col, choose)


def coverage(df: DataFrame, group: str, id_col: str, base: str, tokens: str, session: str, k: int = 48, pool: int | None = 192) -> DataFrame:
    """Greedy marginal coverage: base + 0.07 new session + 0.08 share of new tokens - 0.13 redundancy with what is covered."""

    def choose(p: pd.DataFrame) -> list[tuple[int, float]]:
        b, sets, where = p[base].to_numpy(float), [frozenset(x) if x is not None else frozenset() for x in p[tokens]], p[session].tolist()
        covered: set = set()
        seen: set = set()
        left, out = list(range(len(p))), []
        while left and len(out) < k:

            def gain(i: int) -> float:
                over = len(sets[i] & covered)
                return b[i] + 0.07 * (where[i] not in seen) + 0.08 * (len(sets[i]) - over) / max(1, len(sets[i])) - 0.13 * over / max(1, len(sets[i]) + len(covered) - over)

            best = max(left, key=lambda i: (round(gain(i), 9), -i))
            out.append((best, gain(best)))
            left.remove(best)
            covered |= sets[best]
            seen.add(where[best])
        return out

    return _per_group(_pool(df, group, base, id_col, pool), group, id_col, choose)


def knapsack(df: DataFrame, group: str, id_col: str, score: str, size: str, budget: int, pool: int | None = 256, least: int = 32) -> DataFrame:
    """Greedy by score per size, skipping what does not fit and going on; a running sum would stop there instead."""

    def choose(p: pd.DataFrame) -> list[tuple[int, float]]:
        density = p[score].to_numpy(float) / np.maximum(least, p[size].to_numpy(float))
        used, out = 0.0, []
        for i in sorted(range(len(p)), key=lambda i: (-round(density[i], 12), i)):
            if used + p[size].iloc[i] <= budget:
                used += p[size].iloc[i]
                out.append((i, float(density[i])))
        return out

    return _per_group(_pool(df, group, score, id_col, pool), group, id_col, choose)


def beam_bridge(df: DataFrame, group: str, id_col: str, score: str, tokens: str, width: int = 24, branch: int | None = 36, members: int = 4) -> DataFrame:
    """The best set of up to ``members`` rows: mean score + 0.18 x weakest best overlap - 0.18 x mean overlap beyond it.

    A beam keeps the ``width`` best sets of each size over the ``branch`` best rows; place is the order within the set.
    """

    def choose(p: pd.DataFrame) -> list[tuple[int, float]]:
        s, sets = p[score].to_numpy(float), [frozenset(x) if x is not None else frozenset() for x in p[tokens]]

        def value(g: tuple[int, ...]) -> float:
            if len(g) == 1:
                return s[g[0]]
            links = [max(_jaccard(sets[i], sets[j]) for j in g if j != i) for i in g]
            over = [_jaccard(sets[i], sets[j]) for n, i in enumerate(g) for j in g[n + 1 :]]
            return float(np.mean([s[i] for i in g]) + 0.18 * min(links) - 0.18 * max(0.0, float(np.mean(over)) - min(links)))

        beam = [((i,), value((i,))) for i in range(len(p))]
        beam = sorted(beam, key=lambda x: (-round(x[1], 9), x[0]))[:width]
        best = beam[0]
        for _ in range(members - 1):
            grown = {tuple(sorted((*g, i))) for g, _ in beam for i in range(len(p)) if i not in g}
            beam = sorted(((g, value(g)) for g in grown), key=lambda x: (-round(x[1], 9), x[0]))[:width]
            if not beam:
                break
            best = max(best, beam[0], key=lambda x: (round(x[1], 9), -len(x[0])))
        return [(i, best[1]) for i in best[0]]

    return _per_group(_pool(df, group, score, id_col, branch), group, id_col, choose)


def capsules(df: DataFrame, group: str, id_col: str, relevance: str, goals: str, entities: str, times: str, sources: str, trust: str, k: int = 10, pool: int | None = 192, floor: float = 0.18, share: float = 0.72) -> DataFrame:
    """Greedy choice of capsules that reach ``floor`` and ``share`` of the best relevance: place and gain.

    The gain of a capsule is its relevance with 0.18 of new goals, 0.14 of new entities, 0.12 for a new time, 0.08 of new
    sources, less 0.16 of sources already taken and 0.12 of missing trust. Ties go to the lower id.
    """

    def choose(p: pd.DataFrame) -> list[tuple[int, float]]:
        rel, known = p[relevance].to_numpy(float), p[trust].to_numpy(float)
        own = {c: [frozenset(x) if x is not None else frozenset() for x in p[c]] for c in (goals, entities, times, sources)}
        seen = {c: set() for c in own}
        gate = max(floor, share * rel.max()) if len(rel) else 0.0
        left, out = [i for i in range(len(p)) if rel[i] >= gate], []
        fresh = lambda c, i: len(own[c][i] - seen[c])

        def gain(i: int) -> float:
            n = max(1, len(own[sources][i]))
            new = 0.18 * fresh(goals, i) / max(1, len(own[goals][i])) + 0.14 * fresh(entities, i) / max(1, len(own[entities][i])) + 0.12 * bool(fresh(times, i)) + 0.08 * fresh(sources, i) / 4
            return rel[i] + new - 0.16 * (n - fresh(sources, i)) / n - 0.12 * (1 - known[i])

        while left and len(out) < k:
            best = max(left, key=lambda i: (round(gain(i), 9), -i))
            out.append((best, float(gain(best))))
            left.remove(best)
            for c in own:
                seen[c] |= own[c][best]
        return out

    return _per_group(_pool(df, group, relevance, id_col, pool), group, id_col, choose)


def anchored(df: DataFrame, group: str, anchor: str, id_col: str, own: str, mean: str, sources: str, anchors: int = 10, episodic: str | None = None) -> DataFrame:
    """For each of the first anchors of a question the capsule of most 0.58 x own + 0.22 x mean + 0.20 density - 0.18 overlap.

    ``df`` has one row per (group, anchor place, capsule). Density is the share of a capsule's four places in use, overlap
    that of its sources already taken. Capsules of more than two sources count for episodic questions only.
    """

    def choose(p: pd.DataFrame) -> list[tuple[int, float]]:
        sets = [frozenset(x) for x in p[sources]]
        long = p[episodic].to_numpy(bool) if episodic else np.ones(len(p), bool)
        taken: set = set()
        out: list[tuple[int, float]] = []
        chosen: set = set()
        for a in sorted(set(p[anchor]))[:anchors]:
            rows = [i for i in range(len(p)) if p[anchor].iloc[i] == a and i not in chosen and (len(sets[i]) <= 2 or long[i]) and not any(sets[i] == sets[j] for j, _ in out)]
            if not rows:
                continue
            value = lambda i: 0.58 * p[own].iloc[i] + 0.22 * p[mean].iloc[i] + 0.20 * len(sets[i]) / 4 - 0.18 * len(sets[i] & taken) / max(1, len(sets[i]))
            best = max(rows, key=lambda i: (round(value(i), 9), -i))
            out.append((best, float(value(best))))
            chosen.add(best)
            taken |= sets[best]
        return out

    return _per_group(df, group, id_col, choose)
