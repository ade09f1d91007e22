"""E5: p-values of enrichment scores that plain permutations cannot resolve, by adaptive multilevel splitting.

A level holds random sets whose score is at least its threshold. The median becomes the next threshold: the upper half stays, the lower half is
replaced by copies of the upper, which then swap members at random wherever the score stays above. Each level halves the probability, so a p of one in
a million takes twenty levels and no million draws.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores_of(places: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Enrichment score of each row of sorted 0-based places in a list with absolute scores `a`."""
    n, k = len(a), places.shape[1]
    w = a[places]
    total = np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    miss = (places - np.arange(k)) / max(n - k, 1)
    up = np.cumsum(w, axis=1) / total - miss
    hi, lo = up.max(axis=1), (up - w / total).min(axis=1)
    return np.where(hi >= -lo, hi, lo)


def random_sets(rng, n: int, k: int, rows: int) -> np.ndarray:
    """Rows of k distinct sorted places below n."""
    if n <= 4 * k:
        return np.sort(np.argsort(rng.random((rows, n)), axis=1)[:, :k], axis=1)
    out = np.sort(rng.integers(0, n, (rows, k)), axis=1)
    while True:
        twice = np.zeros(out.shape, dtype=bool)
        twice[:, 1:] = out[:, 1:] == out[:, :-1]
        if not twice.any():
            return out
        out[twice] = rng.integers(0, n, int(twice.sum()))
        out.sort(axis=1)


def swapped(rng, sets, n: int):
    """Each set with one member changed for a random place; where that is a member already, the set stays."""
    rows = np.arange(len(sets))
    at, new = rng.integers(0, sets.shape[1], len(sets)), rng.integers(0, n, len(sets))
    new = np.where((sets == new[:, None]).any(axis=1), sets[rows, at], new)
    out = sets.copy()
    out[rows, at] = new
    out.sort(axis=1)
    return out


def multilevel(a: np.ndarray, k: int, targets: np.ndarray, rng, size: int = 101, eps: float = 1e-10, moves: float = 0.5) -> np.ndarray:
    """P(score >= target | score >= 0) of random sets of k places for each target >= 0, at least `eps`.

    Every level moves each set until swaps have replaced its members `moves` times on average, in at most forty times as many tries.
    """
    n = len(a)
    out = np.full(len(targets), np.nan)
    if not 0 < k < n:
        return np.ones(len(targets))
    sets = np.zeros((0, k), dtype=np.int64)
    tries = 0
    while len(sets) < size and tries < 2000:
        more = random_sets(rng, n, k, size)
        sets, tries = np.concatenate((sets, more[scores_of(more, a) >= 0])), tries + 1
    if len(sets) < size:
        return out
    sets = sets[:size]
    es, reached = scores_of(sets, a), 1.0
    while True:
        # A place in the middle, so that one half and one set more stand at or above the threshold.
        order = np.argsort(-es, kind="stable")
        level = es[order[size // 2]]
        todo = np.isnan(out)
        now = todo & (targets <= level)
        out[now] = [max(reached * (es >= t).mean(), eps) for t in targets[now]]
        if not np.isnan(out).any() or reached < eps or es[order[0]] <= level:
            break
        above = es > level
        reached *= above.mean() if above.mean() < 0.5 else (es >= level).mean()
        strict = above.mean() < 0.5
        keep = np.flatnonzero(above if strict else es >= level)
        pick = np.concatenate((keep, rng.choice(keep, size - len(keep))))
        sets, es = sets[pick], es[pick]
        accepted, steps = 0, 0
        while accepted < moves * k * size and steps < 40 * moves * k:
            other = swapped(rng, sets, n)
            score = scores_of(other, a)
            ok = (score > level if strict else score >= level) & (other != sets).any(axis=1)
            sets[ok], es[ok] = other[ok], score[ok]
            accepted, steps = accepted + int(ok.sum()), steps + 1
    rest = np.isnan(out)
    out[rest] = [max(reached * (es >= t).mean(), eps) for t in targets[rest]]
    return out


def rare_p_values(found: DataFrame, ranked: DataFrame, seed: int = 123, eps: float = 1e-10, size: int = 101, parts: int = 32) -> DataFrame:
    """(comparison, set_size, es, p_rare) of every distinct score in `found` (comparison, set_size, es).

    Sets of one size and sign of a comparison share one run, since their nulls are the same. A task gets some of a comparison's runs and its ranking
    (place, score), once for each of `parts` parts. Draws are seeded by comparison, size and sign, so partitioning does not matter.
    """
    part = F.pmod(F.xxhash64("set_size", F.col("es") >= 0), F.lit(parts)).cast("int")
    units = found.select("comparison", F.col("set_size").cast("long").alias("set_size"), "es").distinct().withColumn("part", part)
    # Places of equal scores are one run's; any order inside it gives the same scores.
    lists = ranked.select("comparison", "place", F.abs("score").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    lists = lists.join(units.select("comparison", "part").distinct(), ["comparison", "part"], "left_semi")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = right.sort_values("place")["a"].to_numpy(float)
        rows = []
        for (k, up), part in left.groupby(["set_size", left["es"] >= 0]):
            es = part["es"].to_numpy(float)
            rng = np.random.default_rng([seed, int(k), int(up), zlib.crc32(str(part["comparison"].iloc[0]).encode())])
            # From the other end a negative excursion is a positive one.
            p = multilevel(a if up else a[::-1], int(k), np.abs(es), rng, size, eps)
            rows.append(pd.DataFrame({"comparison": part["comparison"], "set_size": int(k), "es": es, "p_rare": p}))
        return pd.concat(rows) if rows else pd.DataFrame({"comparison": [], "set_size": [], "es": [], "p_rare": []})

    return units.groupBy("comparison", "part").cogroup(lists.groupBy("comparison", "part")).applyInPandas(
        run, "comparison string, set_size long, es double, p_rare double")
