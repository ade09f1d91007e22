"""Imputation: each method returns only the filled cells (feature_id, sample_id, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.functions.ordering import exact_quantiles
from assaygrid.functions.scalar import hashed_normal, hashed_uniform
from assaygrid.model import Layer
from assaygrid.operators.cells import absent_cells
from assaygrid.operators.diff.kernel import feature_rows
from assaygrid.operators.gram import TILE, _dense, sample_index
from assaygrid.session import cut


def row_min(layer: Layer) -> DataFrame:
    """Q13: the feature's minimum; 0 for a feature without values."""
    lows = layer.cells.groupBy("feature_id").agg(F.min("value").alias("low"))
    return absent_cells(layer).join(lows, "feature_id", "left").select(
        "feature_id", "sample_id", F.coalesce("low", F.lit(0.0)).alias("value"))


def constant(layer: Layer, value: float = 0.0) -> DataFrame:
    """Q14."""
    return absent_cells(layer).withColumn("value", F.lit(float(value)))


def sample_floor(layer: Layer, q: float = 0.01) -> DataFrame:
    """Low quantile of every sample."""
    return exact_quantiles(layer.cells, ["sample_id"], "value", [q], ["low"], layer.few_samples()).select("sample_id", "low")


def min_det(layer: Layer, q: float = 0.01) -> DataFrame:
    """Q15: the sample's q quantile."""
    return absent_cells(layer).join(layer.per_sample(sample_floor(layer, q)), "sample_id", "left").select(
        "feature_id", "sample_id", F.coalesce("low", F.lit(0.0)).alias("value"))


def typical_spread(layer: Layer) -> DataFrame:
    """Median standard deviation of features seen in more than half of the samples; NULL below two.

    The deviations are written first: their last bits depend on the order in which parts arrive, and the median reads them several times.
    """
    sds = cut(layer.cells.groupBy("feature_id").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("sd")).where(
        F.col("n") > 0.5 * layer.n_samples()).select("sd"), "spreads")
    k = sds.agg(F.count("*")).scalar()
    med = exact_quantiles(sds, [], "sd", [0.5], ["spread"])
    return med.select(F.when(k >= 2, F.col("spread")).alias("spread"))


def min_prob(layer: Layer, q: float = 0.01, tune: float = 1.0, seed: int = 1234) -> DataFrame:
    """Q16: normal draws around the sample's q quantile; MinDet where the spread cannot be estimated."""
    spread = typical_spread(layer).agg(F.max("spread")).scalar()
    return absent_cells(layer).join(layer.per_sample(sample_floor(layer, q)), "sample_id", "left").select(
        "feature_id", "sample_id",
        (F.coalesce("low", F.lit(0.0))
         + F.coalesce(tune * spread, F.lit(0.0)) * hashed_normal(seed, F.col("feature_id"), F.col("sample_id"))).alias("value"))


def shifted_normal(layer: Layer, shift: float = 1.8, scale: float = 0.3, seed: int = 1234) -> DataFrame:
    """Q17: normal draws shifted down from each sample's own distribution."""
    stats = layer.cells.groupBy("sample_id").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("*").alias("n"))
    draw = F.col("m") - shift * F.col("s") + scale * F.col("s") * hashed_normal(seed, F.col("feature_id"), F.col("sample_id"))
    return absent_cells(layer).join(layer.per_sample(stats), "sample_id", "left").select(
        "feature_id", "sample_id",
        F.when(F.col("n") >= 2, draw).when(F.col("n") == 1, F.col("m")).otherwise(0.0).alias("value"))


def censored_normal(layer: Layer, seed: int = 1234, tune: float = 1.0) -> DataFrame:
    """Q18: draws from each sample's normal, truncated above at its missing share.

    Mean and sd are the regression of the observed quantiles (0.1 % to 99.1 %) on normal quantiles
    that start at the missing share. Draws invert the truncated distribution at hashed numbers.
    """
    from assaygrid.functions.ordering import spread_quantiles
    from assaygrid.operators.cells import sample_missing
    from assaygrid.operators.integrate import upper_z

    few = layer.few_samples()
    miss = layer.per_sample(sample_missing(layer))
    grid = spread_quantiles(layer.cells, ["sample_id"], "value", 1001, few).where("i % 10 = 1 and i <= 991").join(miss, "sample_id")
    place = F.col("missing_rate") + 0.001 + ((F.col("i") - 1) / 10) * (0.99 - F.col("missing_rate")) / 99
    z = grid.withColumn("z", -upper_z(place))
    fit = z.groupBy("sample_id").agg(F.regr_intercept("value", "z").alias("m"), F.regr_slope("value", "z").alias("s"),
                                     F.first("missing_rate").alias("missing_rate"))
    gaps = absent_cells(layer).join(layer.per_sample(cut(fit, "censored")), "sample_id", "left")
    u = hashed_uniform(seed, "t", F.col("feature_id"), F.col("sample_id")) * (F.col("missing_rate") + 0.001)
    return gaps.withColumn("q", -upper_z(u)).select(
        "feature_id", "sample_id", F.coalesce(F.col("m") + F.col("s") * tune * F.col("q"), F.lit(0.0)).alias("value"))


# Rows of a leaf, least rows and most cells of a bucket in the search for neighbours; the result does not depend on them.
NEIGHBOUR_TILE = 128
NEIGHBOUR_ROWS = 2048
NEIGHBOUR_CELLS = 2_000_000


def _fill(rows: DataFrame, ids: list[str], n: int, fill) -> DataFrame:
    """Filled cells from a function of a dense block (ids, values) -> completed block."""
    names = np.array(ids)

    def kernel(batches):
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo:lo + 1024]
                block = _dense(part, "k", "v", n)
                full = fill(block)
                i, j = np.nonzero(np.isnan(block))
                yield pd.DataFrame({"feature_id": part["feature_id"].to_numpy()[i], "sample_id": names[j], "value": full[i, j]})

    return rows.mapInPandas(kernel, "feature_id string, sample_id string, value double")


def _all_rows(layer: Layer, index: DataFrame) -> DataFrame:
    """Feature rows, features without any cell included (as empty arrays)."""
    rows = feature_rows(layer.cells, index)
    return layer.features.select("feature_id").join(rows, "feature_id", "left").select(
        "feature_id", F.coalesce("k", F.array().cast("array<int>")).alias("k"), F.coalesce("v", F.array().cast("array<double>")).alias("v"))


def nearest(layer: Layer, k: int = 10) -> DataFrame:
    """Q19: mean of the k nearest features with a value in the sample.

    The distance is the mean squared difference over samples seen in both; equal distances go by
    feature id. Features with more than half of their values missing, features without any, and
    cells whose neighbours have no value take the sample's mean.

    The search is exact. Rows are dealt into buckets by ranges of their values; a target first meets
    its own bucket and then the buckets whose box can hold a row as near as the k nearest so far,
    with its limit. In a bucket, leaves are passed over by their boxes likewise. Equal rows are
    searched for once, and only the k + 1 first of them can be neighbours of any.
    """
    ids, index = sample_index(layer)
    n = len(ids)
    pairs = F.array_sort(F.arrays_zip("k", "v"))
    rows = cut(feature_rows(layer.cells, index).withColumn("e", pairs).select("feature_id", F.col("e.k").alias("k"), F.col("e.v").alias("v")), "neighbour-rows")
    targets = rows.where((F.size("k") * 2 >= n) & (F.size("k") < n))
    column_means = layer.cells.groupBy("sample_id").agg(F.avg("value").alias("mean"))
    asked = cut(targets.groupBy("k", "v").agg(F.min("feature_id").alias("name")), "neighbour-targets")
    first = W.partitionBy("k", "v").orderBy("feature_id")
    others = cut(rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth"), "neighbour-others")
    near = _neighbours(asked, others, n, k + 1)
    nth = lambda key: F.row_number().over(W.partitionBy(key).orderBy("d", "other"))
    top = near.withColumn("nth", nth("name")).where(F.col("nth") <= k + 1)
    own = targets.join(asked, ["k", "v"]).select("feature_id", "name").join(top, "name").where("other <> feature_id").withColumn("nth", nth("feature_id")).where(F.col("nth") <= k)
    means = own.select("feature_id", F.explode(F.arrays_zip("at", "x")).alias("e")).where(~F.isnan("e.x")).groupBy("feature_id", F.col("e.at").alias("idx")).agg(
        F.avg("e.x").alias("near")).join(index, "idx").select("feature_id", "sample_id", "near")
    return absent_cells(layer).join(means, ["feature_id", "sample_id"], "left").join(layer.per_sample(column_means), "sample_id", "left").select(
        "feature_id", "sample_id", F.coalesce("near", "mean", F.lit(0.0)).alias("value"))


def _neighbours(asked: DataFrame, others: DataFrame, n: int, k: int) -> DataFrame:
    """(name, d, other, at, x): at least the k nearest of `others` to each row asked, with their values where that row has none."""
    total = others.count()
    wide = others.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, min(total // NEIGHBOUR_ROWS, max(2 * wide, -(-total * n // NEIGHBOUR_CELLS))))
    # Where the ranges are cut decides only how well rows are spread.
    some = others.where(F.pmod(F.xxhash64("feature_id"), F.lit(max(1, total // 16384))) == 0).select("k", "v").toPandas()
    tree = _ranges(_dense(some, "k", "v", n), buckets)

    def place(batches):
        for b in batches:
            yield b.assign(t=_placed(tree, _dense(b, "k", "v", n)))

    bare = "feature_id string, k array<int>, v array<double>, t int"
    dealt = cut(others.mapInPandas(place, bare).select("t", F.lit(0).alias("kind"), "feature_id", "k", "v", F.lit(None).cast("double").alias("limit")), "neighbour-buckets")
    home = asked.select(F.col("name").alias("feature_id"), "k", "v").mapInPandas(place, bare).select(
        "t", F.lit(1).alias("kind"), "feature_id", "k", "v", F.lit(float("inf")).alias("limit"))
    found = "name string, d double, other string, at array<int>, x array<double>"

    def meet(asking):
        return dealt.unionByName(asking).repartitionById(buckets, "t").sortWithinPartitions("t", "kind").mapInPandas(_neighbour_kernel(n, k, NEIGHBOUR_TILE), found)

    near = cut(meet(home), "neighbours")
    if buckets == 1:
        return near
    sides = dealt.select("t", F.explode(F.arrays_zip("k", "v")).alias("e")).groupBy("t", F.col("e.k").alias("k")).agg(
        F.min("e.v").alias("lo"), F.max("e.v").alias("hi"), F.count("*").alias("c")).toPandas()
    sizes = dealt.groupBy("t").count().toPandas().set_index("t")["count"].reindex(range(buckets), fill_value=0).to_numpy()
    lo, hi, seen = np.zeros((buckets, n)), np.zeros((buckets, n)), np.zeros((buckets, n), dtype=np.int64)
    lo[sides.t, sides.k], hi[sides.t, sides.k], seen[sides.t, sides.k] = sides.lo, sides.hi, sides.c
    box = _box(lo, hi, seen == sizes[:, None], seen > 0)

    def send(batches):
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.iloc[i:i + 4096]
                limit = part["limit"].to_numpy(float)
                far = _floors(_dense(part, "k", "v", n), box) <= limit[:, None]
                far[np.arange(len(part)), part["t"].to_numpy()] = False
                who, t = np.nonzero(far)
                yield part.iloc[who].assign(t=t.astype(np.int32))

    limits = near.groupBy("name").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("limit"))
    again = home.drop("limit", "kind").join(limits, F.col("feature_id") == F.col("name"), "left").select(
        "feature_id", "k", "v", "t", F.coalesce("limit", F.lit(float("inf"))).alias("limit")).mapInPandas(send, bare + ", limit double")
    return near.unionByName(cut(meet(again.select("t", F.lit(1).alias("kind"), "feature_id", "k", "v", "limit")), "neighbours"))


def _side(x, least):
    """(column, value) that halves rows `x` (NaN = absent): rows below the value or absent there go left; None if the rows are equal.

    Where `least` rows or more lack a column and as many have it, it is that which parts them.
    """
    absent = np.isnan(x)
    gone = absent.sum(axis=0)
    fewer = np.minimum(gone, len(x) - gone)
    j = int(fewer.argmax())
    if fewer[j] >= least:
        return j, -np.inf
    low, high = np.where(absent, np.inf, x).min(axis=0), np.where(absent, -np.inf, x).max(axis=0)
    have = np.maximum(len(x) - gone, 1)
    middle = np.where(absent, 0.0, x).sum(axis=0) / have
    spread = np.where(high > low, (np.where(absent, 0.0, x - middle) ** 2).sum(axis=0) / have, -1.0)
    j = int(spread.argmax())
    if spread[j] < 0:
        j = int(fewer.argmax())
        return (j, -np.inf) if fewer[j] else None
    own = x[~absent[:, j], j]
    value = np.median(own)
    return j, float(value if value > low[j] else own[own > low[j]].min())


def _left(x, j, value):
    with np.errstate(invalid="ignore"):
        return ~(x[:, j] >= value) if np.isfinite(value) else np.isnan(x[:, j])


def _ranges(x, parts: int):
    """Nested (column, value, left, right) with the numbers 0 to parts - 1 as its ends."""
    def grow(x, first, parts):
        side = _side(x, max(1, len(x) // 4)) if parts > 1 and len(x) > 1 else None
        if side is None:
            return first
        left = _left(x, *side)
        half = parts // 2
        return (*side, grow(x[left], first, half), grow(x[~left], first + half, parts - half))

    return grow(x, 0, parts)


def _placed(tree, x):
    out = np.zeros(len(x), dtype=np.int32)

    def walk(node, at):
        if not isinstance(node, tuple):
            out[at] = node
        elif len(at):
            left = _left(x[at], node[0], node[1])
            walk(node[2], at[left])
            walk(node[3], at[~left])

    walk(tree, np.arange(len(x)))
    return out


def _box(lo, hi, all_have, some_have):
    """Bounds a column that all rows of a box have, and 1 where some have it."""
    return np.where(all_have, lo, -np.inf), np.where(all_have, hi, np.inf), some_have.astype(float)


def _floors(raw, box):
    """Least possible distance of every row to the rows of every box; infinite where nothing is shared.

    The mean over shared columns is at least the sum over those that all rows of the box have, over the most columns that can be shared.
    """
    lo, hi, some = box
    total = np.zeros((len(raw), len(lo)))
    for s in range(raw.shape[1]):
        if np.isfinite(lo[:, s]).any():
            own = raw[:, s, None]
            gap = np.fmax(np.fmax(lo[:, s] - own, own - hi[:, s]), 0.0)
            total += gap * gap
    both = (~np.isnan(raw)).astype(float) @ some.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(both > 0, total * (1 - 1e-12) / both, np.inf)


class _Leaves:
    """Rows in leaves of at most `leaf` rows (equal rows stay together), searched exactly."""

    def __init__(self, labels, raw, leaf):
        parts, stack = [], [np.arange(len(raw))] if len(raw) else []
        while stack:
            at = stack.pop()
            side = _side(raw[at], max(1, leaf // 8)) if len(at) > leaf else None
            if side is None:
                parts.append(at)
            else:
                left = _left(raw[at], *side)
                stack += [at[left], at[~left]]
        at = np.concatenate(parts) if parts else np.arange(0)
        self.ends = np.cumsum([0] + [len(p) for p in parts])
        self.labels, self.raw = labels[at], raw[at]
        self.have = ~np.isnan(self.raw)
        self.y = np.where(self.have, self.raw, 0.0)
        self.place = np.empty(len(at), dtype=np.int64)
        self.place[np.argsort(self.labels)] = np.arange(len(at))
        self.norm = (self.y * self.y).sum(axis=1)
        self.factors = np.concatenate([self.have.astype(float), self.y * self.y, self.y], axis=1).T.copy()
        if parts:
            cuts = self.ends[:-1]
            self.box = _box(np.minimum.reduceat(self.y, cuts), np.maximum.reduceat(self.y, cuts), np.logical_and.reduceat(self.have, cuts), np.logical_or.reduceat(self.have, cuts))
        self.compared = 0

    def nearest(self, raw, k, limit):
        """(target, distance, row) of the k nearest rows within `limit` to each row of `raw`, by target, distance and label."""
        m = len(raw)
        none = np.zeros(0, dtype=np.int64)
        if not len(self.labels):
            return none, np.zeros(0), none
        seen = ~np.isnan(raw)
        x = np.where(seen, raw, 0.0)
        own = (x * x).sum(axis=1)
        limit = limit.copy()
        best, rows = np.full((m, k), np.inf), np.full((m, k), -1)

        def offer(who, a, b):
            self.compared += len(who) * (b - a)
            r = limit[who]
            open_ = ~np.isfinite(r)
            r = np.where(open_, 0.0, r)[:, None]
            # Products only choose whom to compare term by term: sum of squares - limit * shared columns, with room for rounding.
            over = np.concatenate([x[who] ** 2 - r * seen[who], seen[who], -2 * x[who]], axis=1) @ self.factors[:, a:b]
            room = 1e-9 * (own[who, None] + r * raw.shape[1] + self.norm[None, a:b].max())
            i, j = np.nonzero((over <= room) | open_[:, None])
            i, j = who[i], j + a
            both = seen[i] & self.have[j]
            count = both.sum(axis=1)
            gap = np.where(both, x[i] - self.y[j], 0.0)
            d = (gap * gap).sum(axis=1) / np.maximum(count, 1)
            fits = (count > 0) & (d <= limit[i])
            i, j, d = i[fits], j[fits], d[fits]
            if not len(i):
                return
            again = np.unique(i)
            i, d, j = np.concatenate([i, np.repeat(again, k)]), np.concatenate([d, best[again].reshape(-1)]), np.concatenate([j, rows[again].reshape(-1)])
            i, d, j = i[j >= 0], d[j >= 0], j[j >= 0]
            order = np.lexsort((self.place[j], d, i))
            i, d, j = i[order], d[order], j[order]
            start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            nth = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
            keep = nth < k
            best[again], rows[again] = np.inf, -1
            best[i[keep], nth[keep]], rows[i[keep], nth[keep]] = d[keep], j[keep]
            limit[again] = np.minimum(limit[again], best[again, k - 1])

        def visit(leaf, who):
            a, b = self.ends[leaf], self.ends[leaf + 1]
            for lo in range(a, b, 4096):
                step = max(1, (1 << 19) // (min(b, lo + 4096) - lo))
                for w in range(0, len(who), step):
                    offer(who[w:w + step], lo, min(b, lo + 4096))

        floors = _floors(raw, self.box)
        home = floors.argmin(axis=1)
        order = np.argsort(home, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            some = some[floors[some, home[some]] <= limit[some]]
            if len(some):
                visit(home[some[0]], some)
        floors[np.arange(m), home] = np.inf
        for leaf in np.flatnonzero((floors <= np.where(np.isfinite(limit), limit, 1e308)[:, None]).any(axis=0)):
            some = np.flatnonzero((floors[:, leaf] <= limit) & np.isfinite(floors[:, leaf]))
            if len(some):
                visit(leaf, some)
        i, nth = np.nonzero(rows >= 0)
        return i, best[i, nth], rows[i, nth]


def _neighbour_kernel(n, k, leaf):
    def kernel(batches):
        bucket, parts, leaves = None, [], None
        for b in batches:
            for (t, kind), some in b.groupby(["t", "kind"], sort=False):
                if t != bucket:
                    bucket, parts, leaves = t, [], None
                if kind == 0:
                    parts.append((some["feature_id"].to_numpy(), _dense(some, "k", "v", n)))
                    continue
                if leaves is None:
                    leaves = _Leaves(np.concatenate([p[0] for p in parts] or [np.zeros(0, object)]), np.concatenate([p[1] for p in parts] or [np.zeros((0, n))]), leaf)
                    parts = []
                raw, names = _dense(some, "k", "v", n), some["feature_id"].to_numpy()
                i, d, j = leaves.nearest(raw, k, some["limit"].to_numpy(float))
                if not len(i):
                    continue
                gaps = [np.flatnonzero(np.isnan(r)).astype(np.int32) for r in raw]
                at = [gaps[x] for x in i]
                yield pd.DataFrame({"name": names[i], "d": d, "other": leaves.labels[j], "at": at, "x": [leaves.raw[y, g] for y, g in zip(j, at)]})

    return kernel


def _sum_rows(partials: DataFrame, cols: list[str]) -> dict:
    """Sum array columns per row index `i` over the tasks' partial results; n rows reach the driver."""
    schema = "i int, " + ", ".join(f"{c} array<double>" for c in cols)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], **{c: [np.sum(np.stack(pdf[c].to_numpy()), axis=0)] for c in cols}})

    rows = sorted(partials.groupBy("i").applyInPandas(add, schema).collect(), key=lambda r: r.i)
    return {c: np.array([r[c] for r in rows]) for c in cols}


def multivariate_normal(layer: Layer, rounds: int = 12) -> DataFrame:
    """Q20: conditional means under a multivariate normal over the samples, fitted by EM.

    Each round is one pass over the feature rows; only n x n sums come back.
    """
    ids, index = sample_index(layer)
    n = len(ids)
    if n > TILE:
        raise ValueError("the covariance of this many samples is not held on the driver")
    rows = cut(_all_rows(layer, index), "em-rows")
    start = layer.cells.groupBy("sample_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v")).toPandas().set_index("sample_id").reindex(ids)
    mu, sigma = start.m.fillna(0.0).to_numpy(), np.diag(np.maximum(start.v.fillna(1.0).to_numpy(), 1e-6))

    def expect(block, mu, sigma):
        """Completed block and the summed conditional covariances."""
        full, extra = block.copy(), np.zeros((n, n))
        for i in range(len(block)):
            o = ~np.isnan(block[i])
            h = ~o
            if not o.any():
                full[i] = mu
                extra += sigma
            elif h.any():
                k = np.linalg.solve(sigma[np.ix_(o, o)], sigma[np.ix_(o, h)])
                full[i, h] = mu[h] + (block[i, o] - mu[o]) @ k
                extra[np.ix_(h, h)] += sigma[np.ix_(h, h)] - sigma[np.ix_(h, o)] @ k
        return full, extra

    for _ in range(rounds):
        def step(batches, mu=mu, sigma=sigma):
            s1, s2, c = np.zeros(n), np.zeros((n, n)), 0
            for b in batches:
                full, extra = expect(_dense(b, "k", "v", n), mu, sigma)
                s1 += full.sum(axis=0)
                s2 += full.T @ full + extra
                c += len(full)
            if c:
                yield pd.DataFrame({"i": np.arange(n), "s": list(np.column_stack([s1, np.full(n, float(c))])), "q": list(s2)})

        got = _sum_rows(rows.mapInPandas(step, "i int, s array<double>, q array<double>"), ["s", "q"])
        total = got["s"][0, 1]
        new = got["s"][:, 0] / total
        cov = got["q"] / total - np.outer(new, new)
        sigma = (cov + cov.T) / 2 + 1e-6 * np.trace(cov) / n * np.eye(n)
        moved = np.max(np.abs(new - mu))
        mu = new
        if moved < 1e-5:
            break
    return _fill(rows, ids, n, lambda block: expect(block, mu, sigma)[0])


def low_rank(layer: Layer, components: int = 3, rounds: int = 15) -> DataFrame:
    """Q21: a Bayesian low-rank model: features regress on sample scores under a shrinking prior.

    Loadings live with the features; per round only one small matrix per sample comes back.
    """
    ids, index = sample_index(layer)
    n, k = len(ids), components
    rows = cut(_all_rows(layer, index), "low-rank")
    rng = np.random.default_rng(11)
    z = np.linalg.qr(rng.standard_normal((n, k)))[0] * np.sqrt(n)
    prior = np.ones(k) * 0.1

    def loadings(block, z, prior):
        """Row means and loadings under precision `prior`."""
        m = ~np.isnan(block)
        mf = m.astype(float)
        x = np.column_stack([np.ones(n), z])
        a = (mf @ (x[:, :, None] * x[:, None, :]).reshape(n, -1)).reshape(-1, k + 1, k + 1) + np.diag(np.concatenate([[1e-6], prior]))
        return np.linalg.solve(a, (np.where(m, block, 0.0) @ x)[:, :, None])[:, :, 0], m

    for _ in range(rounds):
        def step(batches, z=z, prior=prior):
            a, b, w2, c = np.zeros((n, k, k)), np.zeros((n, k)), np.zeros(k), 0
            for batch in batches:
                block = _dense(batch, "k", "v", n)
                w, m = loadings(block, z, prior)
                wk = w[:, 1:]
                r = np.where(m, block - w[:, :1], 0.0)
                a += np.einsum("bn,bi,bj->nij", m.astype(float), wk, wk)
                b += r.T @ wk
                w2 += (wk * wk).sum(axis=0)
                c += len(block)
            if c:
                tail = np.broadcast_to(np.concatenate([w2, [float(c)]]), (n, k + 1))
                yield pd.DataFrame({"i": np.arange(n), "s": list(np.column_stack([a.reshape(n, -1), b, tail]))})

        s = _sum_rows(rows.mapInPandas(step, "i int, s array<double>"), ["s"])["s"]
        a, b = s[:, :k * k].reshape(n, k, k), s[:, k * k:k * k + k]
        w2, c = s[0, k * k + k:-1], s[0, -1]
        prior = np.clip(c / np.maximum(w2, 1e-9), 1e-3, 1e6) * 0.1
        new = np.linalg.solve(a + 1e-6 * np.eye(k), b[:, :, None])[:, :, 0]
        new = (new - new.mean(axis=0)) / np.maximum(new.std(axis=0), 1e-9)
        moved = np.max(np.abs(np.abs(new) - np.abs(z)))
        z = new
        if moved < 1e-4:
            break

    def fill(block):
        w, m = loadings(block, z, prior)
        return np.where(m, block, w[:, :1] + w[:, 1:] @ z.T)

    return _fill(rows, ids, n, fill)


def mixed(layer: Layer, seed: int = 1234) -> DataFrame:
    """Q22: features with low means take MinProb, the others their nearest neighbours.

    The dividing mean is the quantile of the feature means at the layer's missing share, where a
    left-censored measurement would have been cut off. Features without values count as low.
    """
    means = cut(layer.cells.groupBy("feature_id").agg(F.avg("value").alias("m")), "means")
    share = 1 - layer.cells.count() / max(layer.features.count() * layer.sample_count(), 1)
    line = exact_quantiles(means, [], "m", [share], ["t"]).first()["t"]
    high = means.where(F.col("m") > line).select("feature_id")
    low_part = min_prob(layer, seed=seed).join(high, "feature_id", "left_anti")
    return low_part.unionByName(nearest(layer).join(high, "feature_id", "left_semi"))


METHODS = {"min": row_min, "zero": constant, "MinDet": min_det, "MinProb": min_prob, "man": shifted_normal,
           "QRILC": censored_normal, "knn": nearest, "MLE": multivariate_normal, "bpca": low_rank, "mixed": mixed}
_SEEDED = ("MinProb", "man", "QRILC", "mixed")


def impute(layer: Layer, method: str, seed: int = 1234) -> DataFrame:
    """Filled cells of one method by name."""
    if method not in METHODS:
        raise ValueError(f"unknown imputation {method!r}; one of {sorted(METHODS)}")
    return METHODS[method](layer, seed=seed) if method in _SEEDED else METHODS[method](layer)
