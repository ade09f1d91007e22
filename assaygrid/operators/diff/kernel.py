"""Least-squares fits of every feature, batched in numpy over Arrow batches.

A feature travels as one row with the indices and values of its samples. The design is small
(samples x columns) and goes with the task. Features with gaps get their own cross products
through one matrix product with the presence mask, so no loop over features is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.model import Layer
from assaygrid.operators.gram import _dense

ALIAS_TOL = 1e-12  # squared relative norm below which a design column counts as dependent
BATCH = 2048


def feature_rows(cells: DataFrame, index: DataFrame) -> DataFrame:
    """(feature_id, k, v): sample indices and values of each feature; at most one entry per sample."""
    e = F.struct(F.col("idx").alias("k"), F.col("value").alias("v"))
    return cells.join(index, "sample_id").groupBy("feature_id").agg(F.collect_list(e).alias("e")).select(
        "feature_id", F.col("e.k").alias("k"), F.col("e.v").alias("v"))


def sweep_fit(y: np.ndarray, x: np.ndarray):
    """Per row of `y` (NaN = absent): inverse cross product, coefficients, rss, tss, n, column use."""
    m = ~np.isnan(y)
    mf = m.astype(float)
    n = mf.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, np.where(m, y, 0.0).sum(axis=1) / n, 0.0)
    yc = np.where(m, y - mean[:, None], 0.0)
    k = x.shape[1]
    s = np.empty((len(y), k + 1, k + 1))
    s[:, :k, :k] = (mf @ (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k)).reshape(-1, k, k)
    s[:, :k, k] = s[:, k, :k] = yc @ x
    tss = (yc * yc).sum(axis=1)
    s[:, k, k] = tss
    inv, beta, rss, used = sweep(s, k)
    return {"inv": inv, "beta": beta, "rss": rss, "tss": tss, "n": n, "used": used, "mean": mean, "xsum": mf @ x}


def sweep(s: np.ndarray, k: int):
    """Sweep the k design columns out of stacked cross products [X y]'[X y]; dependent columns stay out."""
    scale = s[:, np.arange(k), np.arange(k)].copy()
    used = np.zeros((len(s), k), dtype=bool)
    for j in range(k):
        d = s[:, j, j].copy()
        ok = d > ALIAS_TOL * np.maximum(scale[:, j], 1e-300)
        used[:, j] = ok
        dd = np.where(ok, d, 1.0)
        col = np.where(ok[:, None], s[:, :, j], 0.0)
        s -= col[:, :, None] * (col / dd[:, None])[:, None, :]
        s[:, :, j] = col / dd[:, None]
        s[:, j, :] = s[:, :, j]
        s[:, j, j] = np.where(ok, -1.0 / dd, 0.0)
    return -s[:, :k, :k], s[:, :k, k], np.maximum(s[:, k, k], 0.0), used


def block_correlation(y: np.ndarray, x: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Per row the correlation of residuals within blocks, from two unbiased quadratic forms.

    `same` is 1 for two different samples of one block. With residual maker P the forms r'r and
    r'Kr have expectations linear in the two variance components.
    """
    out = np.full(len(y), np.nan)
    step = max(1, int(2e7 // (len(x) ** 2)))
    for lo in range(0, len(y), step):
        part = y[lo:lo + step]
        m = (~np.isnan(part)).astype(float)
        xm = x[None, :, :] * m[:, :, None]
        inv = np.linalg.pinv(np.einsum("bni,bnj->bij", xm, xm), hermitian=True)
        p = m[:, :, None] * np.eye(len(x)) - xm @ inv @ xm.transpose(0, 2, 1)
        r = np.einsum("bij,bj->bi", p, np.where(m > 0, part, 0.0))
        pk = p @ same
        q0, q1 = (r * r).sum(axis=1), np.einsum("bi,ij,bj->b", r, same, r)
        t0, t1, t2 = np.trace(p, axis1=1, axis2=2), np.trace(pk, axis1=1, axis2=2), np.einsum("bij,bji->b", pk, pk)
        det = t0 * t2 - t1 * t1
        with np.errstate(divide="ignore", invalid="ignore"):
            var, cov = (q0 * t2 - q1 * t1) / det, (q1 * t0 - q0 * t1) / det
            out[lo:lo + step] = np.where((det > 1e-9) & (var > 0), cov / var, np.nan)
    return out


def reml_correlation(y: np.ndarray, x: np.ndarray, blocks: np.ndarray):
    """Per row the correlation within blocks of greatest restricted likelihood, and whether it stands at a bound of its range.

    With V = (1 - r) I + r (one block of ones a block), V inverse and its determinant need block sums only, so one likelihood of all rows
    is a sum over blocks. A grid brackets the maximum, golden sections narrow it, all rows at once. Rows without two
    samples of a block, or without residual degrees of freedom, get NaN.
    """
    names, code = np.unique(blocks, return_inverse=True)
    z = np.eye(len(names))[code]
    k = x.shape[1]
    rho, bound = np.full(len(y), np.nan), np.zeros(len(y), dtype=bool)
    zx = (z[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    xx = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    step = max(1, int(4e6 // (len(names) * (k + 1) ** 2)))
    for first in range(0, len(y), step):
        part = y[first:first + step]
        here = ~np.isnan(part)
        m = here.astype(float)
        n = m.sum(axis=1)
        v = np.where(here, part - (np.where(here, part, 0).sum(axis=1) / np.maximum(n, 1))[:, None], 0.0)
        size = m @ z
        a = np.empty((len(part), k + 1, k + 1))
        a[:, :k, :k], a[:, :k, k] = (m @ xx).reshape(-1, k, k), v @ x
        a[:, k, :k], a[:, k, k] = a[:, :k, k], (v * v).sum(axis=1)
        sums = np.concatenate(((m @ zx).reshape(len(part), -1, k), (v @ z)[:, :, None]), axis=2)
        used = sweep(a.copy(), k)[3]
        free = n - used.sum(axis=1)
        off = ~used[:, :, None] | ~used[:, None, :]
        top = size.max(axis=1)
        ok = (top > 1) & (free > 0) & (a[:, k, k] > 0)
        if not ok.any():
            continue
        low = np.where(ok, -1 / np.maximum(top - 1, 1) + 1e-4, 0.0)
        high = np.full(len(part), 1 - 1e-4)

        def likelihood(r):
            r = r[:, None]
            c = r / (1 + (size - 1) * r)
            w = (a - np.einsum("fb,fbi,fbj->fij", c, sums, sums, optimize=True)) / (1 - r[:, :, None])
            inner = np.where(off, np.eye(k), w[:, :k, :k])
            side = np.where(used, w[:, :k, k], 0.0)
            rss = w[:, k, k] - (side * np.linalg.solve(inner, side[:, :, None])[:, :, 0]).sum(axis=1)
            det = np.where(size > 0, (size - 1) * np.log(1 - r) + np.log(1 + (size - 1) * r), 0.0).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                return -0.5 * (det + np.linalg.slogdet(inner)[1] + free * np.log(np.maximum(rss, 1e-300)))

        grid = np.linspace(0, 1, 25)
        at = [low + (high - low) * g for g in grid]
        best = np.argmax([np.where(ok, likelihood(r), 0) for r in at], axis=0)
        lo, hi = np.choose(np.maximum(best - 1, 0), at), np.choose(np.minimum(best + 1, len(at) - 1), at)
        gold = (5**0.5 - 1) / 2
        p, q = hi - gold * (hi - lo), lo + gold * (hi - lo)
        fp, fq = likelihood(p), likelihood(q)
        for _ in range(40):
            right = fp < fq
            lo, hi = np.where(right, p, lo), np.where(right, hi, q)
            p_new, q_new = np.where(right, q, hi - gold * (hi - lo)), np.where(right, lo + gold * (hi - lo), p)
            new = likelihood(np.where(right, q_new, p_new))
            fp, fq = np.where(right, fq, new), np.where(right, new, fp)
            p, q = p_new, q_new
        rho[first:first + step] = np.where(ok, (lo + hi) / 2, np.nan)
        bound[first:first + step] = ok & (((lo + hi) / 2 - low < 1e-3) | (high - (lo + hi) / 2 < 1e-3))
    return rho, bound


def gls_fit(y: np.ndarray, x: np.ndarray, same: np.ndarray, rho: float):
    """Generalised least squares with correlation `rho` within blocks; absent samples drop out."""
    k = x.shape[1]
    v = np.eye(len(x)) + rho * same
    parts = []
    step = max(1, int(2e7 // (len(x) ** 2)))
    for lo in range(0, len(y), step):
        part = y[lo:lo + step]
        m = (~np.isnan(part)).astype(float)
        vm = v * m[:, :, None] * m[:, None, :] + (1 - m)[:, :, None] * np.eye(len(x))
        a = np.concatenate([x[None, :, :] * m[:, :, None], np.where(m > 0, part, 0.0)[:, :, None]], axis=2)
        parts.append(a.transpose(0, 2, 1) @ np.linalg.solve(vm, a))
    inv, beta, rss, used = sweep(np.concatenate(parts), k)
    m = ~np.isnan(y)
    n = m.sum(axis=1).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, np.where(m, y, 0.0).sum(axis=1) / n, 0.0)
    return {"inv": inv, "beta": beta, "rss": rss, "tss": np.where(m, (y - mean[:, None]) ** 2, 0.0).sum(axis=1), "n": n,
            "used": used, "mean": mean, "xsum": m.astype(float) @ x}


def factor_ok(fit, factors, n_col: int = 0) -> np.ndarray:
    """False where a factor has fewer than two levels among the observed samples.

    `factors` lists, per factor, (columns of its non-reference levels, has_reference).
    """
    ok = np.ones(len(fit["n"]), dtype=bool)
    for cols, has_reference in factors:
        seen = (fit["xsum"][:, cols] > 0.5).sum(axis=1)
        if has_reference:
            seen = seen + (fit["n"] - fit["xsum"][:, cols].sum(axis=1) > 0.5)
        ok &= seen >= 2
    return ok


def average_rank_rows(a: np.ndarray) -> np.ndarray:
    """Ascending ranks within each row, ties averaged, NaN stays NaN."""
    b, n = a.shape
    order = np.argsort(a, axis=1, kind="stable")
    v = np.take_along_axis(a, order, axis=1)
    new = np.ones((b, n), dtype=bool)
    new[:, 1:] = v[:, 1:] != v[:, :-1]
    pos = np.broadcast_to(np.arange(n), (b, n))
    start = np.maximum.accumulate(np.where(new, pos, 0), axis=1)
    last = np.ones((b, n), dtype=bool)
    last[:, :-1] = new[:, 1:]
    end = np.minimum.accumulate(np.where(last, pos, n)[:, ::-1], axis=1)[:, ::-1]
    ranks = np.empty((b, n))
    np.put_along_axis(ranks, order, (start + end) / 2 + 1, axis=1)
    return np.where(np.isnan(a), np.nan, ranks)


def row_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of matching rows over entries present in both."""
    both = ~np.isnan(a) & ~np.isnan(b)
    n = both.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        ma = np.where(both, a, 0).sum(axis=1) / n
        mb = np.where(both, b, 0).sum(axis=1) / n
        ca = np.where(both, a - ma[:, None], 0.0)
        cb = np.where(both, b - mb[:, None], 0.0)
        r = (ca * cb).sum(axis=1) / np.sqrt((ca * ca).sum(axis=1) * (cb * cb).sum(axis=1))
    return np.where((n >= 2) & np.isfinite(r), r, np.nan)


FIT_SCHEMA = (
    "feature_id string, comparison string, n double, rank double, rss double, tss double, mean double, "
    "est double, unscaled double, quad double, rho double"
)


class Model:
    """One fit per feature: a design over a subset of samples and what to report from it.

    rows: sample indices of the design rows; x: design; contrasts: [(label, weights)];
    joint: matrix whose rows are tested together (F numerator), or None;
    factors: see factor_ok; rank_with: values to correlate by Spearman, or None;
    adjust: design whose residuals are correlated instead (complete features only), or None;
    same, rho: samples of one block (off-diagonal ones) and their correlation, or None.
    """

    def __init__(self, rows, x, contrasts, joint=None, factors=(), rank_with=None, adjust=None, same=None, rho=0.0):
        self.same, self.rho = same, rho
        self.rows, self.x, self.contrasts = np.asarray(rows), np.asarray(x, float), contrasts
        self.joint = None if joint is None else np.asarray(joint, float)
        self.factors, self.rank_with, self.adjust = list(factors), rank_with, adjust

    def report(self, ids: np.ndarray, block: np.ndarray):
        y = block[:, self.rows]
        fit = sweep_fit(y, self.x) if self.same is None else gls_fit(y, self.x, self.same, self.rho)
        rank = fit["used"].sum(axis=1).astype(float)
        ok = factor_ok(fit, self.factors) & (fit["n"] > 0)
        rho = np.full(len(y), np.nan)
        if self.rank_with is not None:
            target = np.asarray(self.rank_with, float)
            if self.adjust is not None:
                full = ~np.isnan(y).any(axis=1)
                q, _ = np.linalg.qr(self.adjust)
                yy = np.where(full[:, None], y, 0.0)
                y_res = np.where(full[:, None], yy - (yy @ q) @ q.T, np.nan)
                target = target - q @ (q.T @ target)
                # Residuals equal up to rounding count as ties.
                y_res, target = np.round(y_res, 9), np.round(target, 9)
            else:
                y_res = y
            t = np.where(np.isnan(y_res), np.nan, target[None, :])
            rho = row_correlation(average_rank_rows(y_res), average_rank_rows(t))
        quad = np.full(len(y), np.nan)
        if self.joint is not None:
            lb = fit["beta"] @ self.joint.T
            lv = self.joint @ fit["inv"] @ self.joint.T
            needed = np.abs(self.joint).sum(axis=0) > 0
            good = fit["used"][:, needed].all(axis=1)
            if good.any():
                quad[good] = np.einsum("bi,bi->b", lb[good], np.linalg.solve(lv[good], lb[good][:, :, None])[:, :, 0])
        for label, w in self.contrasts:
            w = np.asarray(w, float)
            est = fit["beta"] @ w
            var = np.einsum("i,bij,j->b", w, fit["inv"], w)
            good = ok & fit["used"][:, w != 0].all(axis=1)
            nan = lambda a, c=good: np.where(c, a, np.nan)
            yield pd.DataFrame({
                "feature_id": ids, "comparison": label, "n": fit["n"], "rank": nan(rank, ok), "rss": nan(fit["rss"], ok),
                "tss": nan(fit["tss"], ok), "mean": np.where(fit["n"] > 0, fit["mean"], np.nan), "est": nan(est),
                "unscaled": nan(np.sqrt(np.maximum(var, 0))), "quad": nan(quad, ok), "rho": rho,
            })


def fit_features(layer: Layer, index: DataFrame, n_samples: int, models: list[Model]) -> DataFrame:
    """All models of all features; NaN leaves as NULL."""
    def kernel(batches):
        for batch in batches:
            for lo in range(0, len(batch), BATCH):
                part = batch.iloc[lo:lo + BATCH]
                block = _dense(part, "k", "v", n_samples)
                ids = part["feature_id"].to_numpy()
                for model in models:
                    yield from model.report(ids, block)

    out = feature_rows(layer.cells, index).mapInPandas(kernel, FIT_SCHEMA)
    num = [c for c in out.columns if c not in ("feature_id", "comparison")]
    return out.select("feature_id", "comparison", *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in num])
