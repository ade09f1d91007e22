"""Negative-binomial models of count layers, batched over features.

Published methods: gene-wise dispersions by Cox-Reid adjusted profile likelihood, a parametric
trend, shrinkage towards it and Wald or likelihood-ratio tests (Love 2014); quasi-likelihood F
tests (Lun, Chen and Smyth 2016). A feature without a cell in a sample counts as zero there.
Results follow the papers; they agree with other implementations in direction and order, not to
the last digit.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.ordering import adjust_p, cumulative, exact_quantiles, spread_quantiles
from assaygrid.functions.tails import chisq_upper, f_upper, log_gamma, normal_two_sided, trigamma
from assaygrid.model import Layer
from assaygrid.operators.cells import expressed_features, keep_features
from assaygrid.operators.diff.design import supported_features
from assaygrid.operators.diff.kernel import feature_rows
from assaygrid.operators.diff.linear import _group_design, continuous_model, moderate, sample_frame
from assaygrid.operators.diff.results import pad_untested, standard
from assaygrid.operators.gram import _dense
from assaygrid.operators.normalize import size_factors, tmm_factors
from assaygrid.session import cut

LN2 = float(np.log(2.0))
MIN_DISP, BATCH = 1e-8, 512


def irls(y, x, log_s, alpha, rounds=30):
    """Log-link coefficients of every row of counts `y` with dispersion `alpha` per row."""
    b, k = len(y), x.shape[1]
    xx = (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k)
    eta = np.log(np.maximum(y / np.exp(log_s), 0) + 0.1)
    beta = np.linalg.lstsq(x, eta.T, rcond=None)[0].T
    ridge = 1e-6 * np.eye(k)
    for _ in range(rounds):
        mu = np.maximum(np.exp(np.clip(beta @ x.T, -30, 30) + log_s), 1e-6)
        w = mu / (1 + alpha[:, None] * mu)
        z = np.log(mu) - log_s + (y - mu) / mu
        info = (w @ xx).reshape(b, k, k) + ridge
        new = np.linalg.solve(info, ((w * z) @ x)[:, :, None])[:, :, 0]
        moved = np.max(np.abs(new - beta)) if b else 0
        beta = np.clip(new, -30, 30)
        if moved < 1e-8:
            break
    mu = np.maximum(np.exp(np.clip(beta @ x.T, -30, 30) + log_s), 1e-6)
    w = mu / (1 + alpha[:, None] * mu)
    return beta, mu, np.linalg.inv((w @ xx).reshape(b, k, k) + ridge)


def likelihood(y, mu):
    """The log-likelihood of every row as a function of its dispersion. Gamma functions are taken of counts above zero only; at zero they cancel."""
    i, j = np.nonzero(y)
    some, at = y[i, j], mu[i, j]
    fixed = np.bincount(i, log_gamma(some + 1.0), len(y))

    def of(alpha):
        a = 1 / alpha
        spread = np.log1p(alpha[:, None] * mu)
        terms = log_gamma(some + a[i]) - log_gamma(a)[i] + some * (np.log(alpha[i] * at) - spread[i, j])
        return np.bincount(i, terms, len(y)) - fixed - a * spread.sum(axis=1)

    return of


def log_lik(y, mu, alpha):
    return likelihood(y, mu)(alpha)


def deviance(y, mu, alpha):
    al = alpha[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        first = np.where(y > 0, y * np.log(y / mu), 0.0)
    return 2 * (first - (y + 1 / al) * np.log((1 + al * y) / (1 + al * mu))).sum(axis=1)


def best_dispersion(y, x, mu, prior_mean=None, prior_var=None):
    """Maximiser of the Cox-Reid adjusted likelihood (plus a log-normal prior) on a refined log grid."""
    k = x.shape[1]
    xx = (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k)
    lik = likelihood(y, mu)

    def score(la):
        alpha = np.exp(la)
        w = mu / (1 + alpha[:, None] * mu)
        cr = np.linalg.slogdet((w @ xx).reshape(-1, k, k) + 1e-9 * np.eye(k))[1]
        out = lik(alpha) - 0.5 * cr
        return out if prior_mean is None else out - (la - prior_mean) ** 2 / (2 * prior_var)

    lo, hi = np.full(len(y), np.log(MIN_DISP)), np.full(len(y), np.log(max(10.0, y.shape[1])))
    for _ in range(4):
        grid = [lo + (hi - lo) * g / 12 for g in range(13)]
        vals = np.stack([score(g) for g in grid])
        at = vals.argmax(axis=0)
        step = (hi - lo) / 12
        mid = lo + step * at
        lo, hi = mid - step, mid + step
    return np.exp(np.clip((lo + hi) / 2, np.log(MIN_DISP), None))


def _blocks(batches, n, use, log_s):
    """(rows, counts and log offsets of the samples used) by the block; a cell's offset is its sample's plus its own, if rows have some."""
    for batch in batches:
        for i in range(0, len(batch), BATCH):
            part = batch.iloc[i:i + BATCH]
            off = np.broadcast_to(log_s, (len(part), len(use)))
            if "ok" in part:
                off = off + np.nan_to_num(_dense(part, "ok", "ov", n), nan=0.0)[:, use]
            yield part, np.nan_to_num(_dense(part, "k", "v", n), nan=0.0)[:, use], off


def relative_lengths(lengths: DataFrame) -> DataFrame:
    """(feature_id, sample_id, rel): the natural logarithm of each cell's length less its feature's mean of them; lengths are positive."""
    logs = lengths.where("length > 0").select("feature_id", "sample_id", F.log("length").alias("l"))
    mean = logs.groupBy("feature_id").agg(F.avg("l").alias("m"))
    return logs.join(mean, "feature_id").select("feature_id", "sample_id", (F.col("l") - F.col("m")).alias("rel"))


def per_length(layer: Layer, relative: DataFrame | None) -> Layer:
    """The layer with counts over relative lengths, from which size factors are taken. A cell without a length stays."""
    if relative is None:
        return layer
    cells = layer.cells.join(relative, ["feature_id", "sample_id"], "left").select(
        "feature_id", "sample_id", (F.col("value") / F.exp(F.coalesce("rel", F.lit(0.0)))).alias("value"))
    return layer.with_cells(cells)


def f_quantile(q: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution, by halving the incomplete beta integral over a smooth substitution."""
    if d2 <= 0:
        return np.inf
    node, weight = np.polynomial.legendre.leggauss(400)
    u, w = (node + 1) / 2, weight / 2
    part = lambda top: 2 * top * (w * (u * top) ** (d1 - 1) * np.maximum(1 - (u * top) ** 2, 0) ** (d2 / 2 - 1)).sum()
    # t = v^2 up to one half, and the complement by symmetry beyond, so both ends stay smooth.
    half = 0.5**0.5
    other = lambda top: 2 * top * (w * (u * top) ** (d2 - 1) * np.maximum(1 - (u * top) ** 2, 0) ** (d1 / 2 - 1)).sum()
    total = part(half) + other(half)
    below = lambda t: (part(t**0.5) if t <= 0.5 else total - other((1 - t) ** 0.5)) / total
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < q else (lo, mid)
    return float(d2 * lo / (d1 * max(1 - lo, 1e-300)))


def trimmed_mean(v, share):
    """Mean of each row without `share` of its values at either end."""
    n = v.shape[1]
    cut_off = int(np.floor(n * share))
    return np.sort(v, axis=1)[:, cut_off:n - cut_off].mean(axis=1)


# Shares trimmed off squared deviations by replicates, and what makes their mean a variance again.
TRIMS = ((3, 1 / 3, 2.04), (23, 1 / 4, 1.86), (1 << 30, 1 / 8, 1.51))
REPLACE_FROM, TELL_FROM = 7, 3


def cells_of(x):
    """Cell number of every sample: samples of one design row are replicates; and how many replicates each sample has."""
    _, code, size = np.unique(np.round(x, 12), axis=0, return_inverse=True, return_counts=True)
    code = code.reshape(-1)
    return code, size[code]


def robust_dispersion(norm, code, size):
    """Moment dispersion from trimmed variances within replicates (over all samples where no cell has three), at least 0.04."""
    groups = [np.flatnonzero(code == c) for c in np.unique(code[size >= TELL_FROM])] or [np.arange(norm.shape[1])]
    spread = []
    for g in groups:
        share, scale = next((t, c) for most, t, c in TRIMS if len(g) <= most)
        middle = trimmed_mean(norm[:, g], share)
        spread.append(scale * trimmed_mean((norm[:, g] - middle[:, None]) ** 2, 1 / 8 if len(groups) == 1 and len(g) == norm.shape[1] else share))
    mean = np.maximum(norm.mean(axis=1), 1e-12)
    return np.maximum((np.max(spread, axis=0) - mean) / mean**2, 0.04)


def cooks_distances(y, x, mu, cov, off, alpha, code, size):
    """Cook's distance of every count: its squared Pearson residual under the robust dispersion, weighed by its leverage."""
    w = mu / (1 + alpha[:, None] * mu)
    lever = np.clip(w * np.einsum("ni,bij,nj->bn", x, cov, x, optimize=True), 0, 1 - 1e-9)
    robust = robust_dispersion(y / np.exp(off), code, size)
    pearson = (y - mu) ** 2 / (mu + robust[:, None] * mu**2)
    return pearson / x.shape[1] * lever / (1 - lever) ** 2


def gene_dispersions(rows: DataFrame, n: int, use, x, log_s) -> DataFrame:
    """(feature_id, base_mean, disp) of features with any count in the samples used."""
    use, x, log_s = np.asarray(use), np.asarray(x, float), np.asarray(log_s, float)

    def kernel(batches):
        for part, y, off in _blocks(batches, n, use, log_s):
            live = y.sum(axis=1) > 0
            if not live.any():
                continue
            y, off = y[live], off[live]
            norm = y / np.exp(off)
            mean, var = norm.mean(axis=1), norm.var(axis=1, ddof=1)
            start = np.clip((var - mean * np.exp(-off).mean(axis=1)) / mean ** 2, MIN_DISP * 10, 10.0)
            _, mu, _ = irls(y, x, off, start)
            yield pd.DataFrame({"feature_id": part["feature_id"].to_numpy()[live], "base_mean": mean, "disp": best_dispersion(y, x, mu)})

    return rows.mapInPandas(kernel, "feature_id string, base_mean double, disp double")


def dispersion_trend(disp: DataFrame) -> tuple[float, float] | None:
    """a0 + a1 / mean by gamma regression: each round is one aggregate over the dispersions.

    None (the caller falls back to gene-wise dispersions) when it leaves the positive range.
    """
    d = disp.where(F.col("disp") > 100 * MIN_DISP)
    a0, a1 = 0.1, 1.0
    for _ in range(12):
        fit = F.lit(a0) + F.lit(a1) / F.col("base_mean")
        u, w = 1 / F.col("base_mean"), 1 / (fit * fit)
        ok = (F.col("disp") / fit > 1e-4) & (F.col("disp") / fit < 15)
        s = d.where(ok).agg(F.sum(w).alias("w"), F.sum(w * u).alias("u"), F.sum(w * u * u).alias("uu"),
                            F.sum(w * F.col("disp")).alias("y"), F.sum(w * u * F.col("disp")).alias("uy")).first()
        if not s.w:
            return None
        det = s.w * s.uu - s.u * s.u
        if det <= 1e-12 * s.w * s.uu:
            return None
        b1 = (s.w * s.uy - s.u * s.y) / det
        b0 = (s.uu * s.y - s.u * s.uy) / det
        if b0 <= 0 and b1 <= 0:
            return None
        b0, b1 = max(b0, 1e-8), max(b1, 0.0)
        done = (np.log(b0 / a0) ** 2 + np.log((b1 + 1e-8) / (a1 + 1e-8)) ** 2) < 1e-6
        a0, a1 = b0, b1
        if done:
            break
    return a0, a1


def shrunken_dispersions(disp: DataFrame, df: int):
    """Trend, prior variance and outlier bound for the shrinkage; None for the fallback."""
    trend = dispersion_trend(disp)
    if trend is None:
        return None
    fit = F.lit(trend[0]) + F.lit(trend[1]) / F.col("base_mean")
    resid = disp.where(F.col("disp") > 100 * MIN_DISP).select(F.log(F.col("disp") / fit).alias("r"))
    med = exact_quantiles(resid, [], "r", [0.5], ["m"]).first()["m"]
    mad = exact_quantiles(resid.select(F.abs(F.col("r") - med).alias("r")), [], "r", [0.5], ["m"]).first()["m"]
    spread = (1.4826 * mad) ** 2
    return {"trend": trend, "prior_var": max(spread - float(trigamma(np.array([df / 2]))[0]), 0.25), "bound": 2 * np.sqrt(spread)}


def _design(layer, meta, group_col, contrasts, covariates, block):
    levels = []
    for _, w in contrasts:
        levels += [lv for lv in w if lv not in levels]
    return _group_design(meta, group_col, levels, covariates, block, [(lab, [w.get(lv, 0.0) for lv in levels]) for lab, w in contrasts])


def _wald(rows: DataFrame, disp: DataFrame, n: int, model, log_s, shrink, reduced=None, outliers: bool = True) -> DataFrame:
    """Final dispersions, coefficients and Wald (or likelihood-ratio) statistics per contrast.

    With `outliers`, counts whose Cook's distance passes the 0.99 quantile of F are replaced by their row's trimmed mean where seven or more
    replicates stand behind it, and the row is fitted again; a row whose outlier has three to six replicates, and fewer than three larger
    counts, gets no statistic. `n_replaced` and `outlier` tell which rows these are.
    """
    use, x, contrasts = model.rows, model.x, model.contrasts
    log_s = np.asarray(log_s, float)
    joined = rows.join(disp, "feature_id")
    code, size = cells_of(x)
    bound = f_quantile(0.99, x.shape[1], len(x) - x.shape[1])

    def dispersions(y, off, gene, mean):
        if shrink is None:
            return np.maximum(gene, MIN_DISP)
        fit = shrink["trend"][0] + shrink["trend"][1] / mean
        _, mu, _ = irls(y, x, off, np.maximum(gene, MIN_DISP))
        mapped = best_dispersion(y, x, mu, np.log(fit), shrink["prior_var"])
        return np.maximum(np.where(np.log(gene) > np.log(fit) + shrink["bound"], gene, mapped), MIN_DISP)

    def kernel(batches):
        for part, y, off in _blocks(batches, n, use, log_s):
            gene, mean = part["disp"].to_numpy(float), part["base_mean"].to_numpy(float)
            alpha = dispersions(y, off, gene, mean)
            beta, mu, cov = irls(y, x, off, alpha)
            told, replaced = np.zeros(len(y), dtype=bool), np.zeros(len(y), dtype=np.int64)
            if outliers and len(x) > x.shape[1] and (size >= TELL_FROM).any():
                far = (cooks_distances(y, x, mu, cov, off, alpha, code, size) > bound) & (size >= TELL_FROM)
                swap = far & (size >= REPLACE_FROM)
                larger = (y[:, None, :] > np.where(far & ~swap, y, np.inf).min(axis=1)[:, None, None]).sum(axis=2)[:, 0]
                told = (far & ~swap).any(axis=1) & (larger < 3)
                again = np.flatnonzero(swap.any(axis=1))
                if len(again):
                    norm = y[again] / np.exp(off[again])
                    calm = np.where(swap[again], np.floor(trimmed_mean(norm, 0.2)[:, None] * np.exp(off[again])), y[again])
                    y = y.copy()
                    y[again] = calm
                    replaced[again] = swap[again].sum(axis=1)
                    live = calm.sum(axis=1) > 0
                    told[again[~live]] = True
                    some = again[live]
                    if len(some):
                        y2, off2 = y[some], off[some]
                        mean2 = (y2 / np.exp(off2)).mean(axis=1)
                        _, mu2, _ = irls(y2, x, off2, np.maximum(gene[some], MIN_DISP))
                        alpha[some] = dispersions(y2, off2, best_dispersion(y2, x, mu2), mean2)
                        beta[some], mu[some], cov[some] = irls(y2, x, off2, alpha[some])
            lrt = np.full(len(y), np.nan)
            if reduced is not None:
                _, mu0, _ = irls(y, reduced, off, alpha)
                lrt = np.maximum(2 * (log_lik(y, mu, alpha) - log_lik(y, mu0, alpha)), 0.0)
            for label, w in contrasts:
                est = beta @ w
                se = np.sqrt(np.einsum("i,bij,j->b", w, cov, w))
                yield pd.DataFrame({"feature_id": part["feature_id"], "comparison": label, "effect": est / LN2, "statistic": np.where(told, np.nan, est / se),
                                    "lrt": np.where(told, np.nan, lrt), "base_mean": mean, "dispersion": alpha, "n_replaced": replaced, "outlier": told})

    out = joined.mapInPandas(kernel, "feature_id string, comparison string, effect double, statistic double, lrt double, base_mean double, "
                                     "dispersion double, n_replaced long, outlier boolean")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("statistic", "lrt")})


def _rejections(j: DataFrame, alpha: float, method: str) -> DataFrame:
    """(comparison, theta, n): rejections at `alpha` among the rows above each cutoff.

    With BH only rows with p below `alpha` can be rejected, so only those are ranked once per cutoff they
    stand above; the sizes of the families are one count.
    """
    above = F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("theta")
    tried = j.where("last > 0 and p_value is not null")
    if method != "BH":
        adjusted = adjust_p(tried.select("comparison", "feature_id", "p_value", above), ["comparison", "theta"], method=method, few=True)
        return adjusted.groupBy("comparison", "theta").agg(F.count_if(F.col("adj_p_value") < alpha).alias("n"))
    size = tried.groupBy("comparison", "last").agg(F.count("*").alias("m")).select("comparison", "m", above).groupBy(
        "comparison", "theta").agg(F.sum("m").alias("m"))
    small = tried.where(F.col("p_value") < alpha).select("comparison", "p_value", above)
    rank = F.col("below") + F.col("ties")
    best = cumulative(small, ["comparison", "theta"], "p_value", few=True).join(F.broadcast(size), ["comparison", "theta"]).where(
        F.col("p_value") * F.col("m") < alpha * rank).groupBy("comparison", "theta").agg(F.max(rank).alias("n"))
    return size.join(best, ["comparison", "theta"], "left").select("comparison", "theta", F.coalesce("n", F.lit(0)).alias("n"))


def independent_filter(stats: DataFrame, alpha: float = 0.1, points: int = 50, method: str = "BH") -> DataFrame:
    """NULL adjusted p below the mean-count cutoff that gives most rejections; one family per cutoff."""
    grid = spread_quantiles(stats, ["comparison"], "base_mean", points + 1, few=True).where(F.col("i") < points)
    cuts = grid.groupBy("comparison").agg(F.array_sort(F.collect_list("value")).alias("cuts"))
    j = stats.join(F.broadcast(cuts), "comparison")
    j = cut(j.withColumn("last", F.size(F.filter("cuts", lambda c: c <= F.col("base_mean")))), "filtering")
    won = _rejections(j, alpha, method)
    # At most `points` rows per comparison reach the driver.
    pick = []
    for c, g in won.toPandas().groupby("comparison"):
        g = g.sort_values("theta")
        smooth = g.n.rolling(5, center=True, min_periods=1).mean()
        resid = np.sqrt(((g.n - smooth) ** 2).mean())
        good = g[g.n > smooth.max() - resid] if g.n.max() > 10 else g.head(1)
        pick.append((c, int(good.theta.iloc[0]) if len(good) else 0))
    chosen = stats.sparkSession.createDataFrame(pick, "comparison string, theta int")
    kept = j.join(F.broadcast(chosen), "comparison").withColumn("p_kept", F.when(F.col("last") > F.col("theta"), F.col("p_value")))
    return adjust_p(kept, ["comparison"], "p_kept", method=method, few=True).drop("p_kept", "cuts", "last", "theta")


def _prepare(layer: Layer, model, meta, index, factors: pd.Series, relative: DataFrame | None = None):
    """Rows of counts, with an array of offsets each where `relative` lengths are given, their dispersions and the samples' log factors."""
    log_s = np.log(factors.loc[meta.index].to_numpy(float))[model.rows]
    rows = feature_rows(layer.cells, index)
    if relative is not None:
        own = feature_rows(relative.withColumnRenamed("rel", "value"), index).withColumnsRenamed({"k": "ok", "v": "ov"})
        none = F.array().cast("array<int>"), F.array().cast("array<double>")
        rows = rows.join(own, "feature_id", "left").select("feature_id", "k", "v", F.coalesce(F.col("ok").cast("array<int>"), none[0]).alias("ok"), F.coalesce("ov", none[1]).alias("ov"))
    rows = cut(rows, "count-rows")
    disp = cut(gene_dispersions(rows, len(meta), model.rows, model.x, log_s), "dispersions")
    return rows, disp, log_s


def _size_series(layer: Layer, factors: str) -> tuple[pd.Series, str]:
    """Size factors and the name of the method that made them, for the result's `method`.

    "ratio" is median of ratios, refused when no feature is seen in every sample; "library" is library
    sizes over their geometric mean; "ratio_or_library" takes the second only where the first is refused.
    """
    if factors not in ("ratio", "library", "ratio_or_library"):
        raise ValueError(f"unknown size factors {factors!r}")
    if factors != "library":
        sf = size_factors(layer).toPandas()
        if len(sf) >= layer.sample_count():
            return sf.set_index("sample_id").size_factor, "deseq2"
        if factors == "ratio":
            raise ValueError("no feature is seen in every sample, so median of ratios is undefined; name factors='library' to use library sizes")
    lib = layer.cells.groupBy("sample_id").agg(F.sum("value").alias("lib")).toPandas().set_index("sample_id").lib
    return lib / np.exp(np.log(lib).mean()), "deseq2_library"


def run_nb_wald(layer: Layer, contrasts, group_col=None, covariates=None, block=None, adjust="BH", filtering: bool = True, factors: str = "ratio",
                lengths: DataFrame | None = None, outliers: bool = True, prefilter: bool = False) -> DataFrame:
    """Group contrasts with shrunken dispersions. `lengths` (feature_id, sample_id, length) become offsets of the cells.

    With `prefilter` features without enough reads in as many samples as the design needs stay untested, unless fewer than two would be left.
    """
    group_col = group_col or layer.group_col
    meta, index = sample_frame(layer)
    model = _design(layer, meta, group_col, contrasts, covariates, block)
    if prefilter:
        kept = cut(supported_features(layer, model.x).select("feature_id"), "supported")
        layer = _as_full(layer, keep_features(layer, kept)) if kept.limit(2).count() == 2 else layer
    return _finish_wald(layer, meta, index, model, [c for c, _ in contrasts], "group", "log2FC", "group", filtering, adjust, factors, lengths, outliers)


def run_nb_continuous(layer: Layer, column: str, covariates=None, adjust="BH", filtering: bool = True, factors: str = "ratio",
                      lengths: DataFrame | None = None, outliers: bool = True) -> DataFrame:
    """log2 fold change per unit of a numeric column."""
    meta, index = sample_frame(layer)
    return _finish_wald(layer, meta, index, continuous_model(meta, column, covariates), [column], "continuous_linear", "log2FC per unit", "continuous", filtering, adjust, factors, lengths, outliers)


def _relative(lengths: DataFrame | None) -> DataFrame | None:
    return None if lengths is None else cut(relative_lengths(lengths), "relative-lengths")


def _shrinkage(disp: DataFrame, model):
    """Trend and prior of the shrinkage; where no trend can be fitted, a warning and the gene-wise dispersions as they are."""
    shrink = shrunken_dispersions(disp, len(model.rows) - model.x.shape[1])
    if shrink is None:
        warnings.warn("no dispersion trend can be fitted; every feature keeps its own dispersion", stacklevel=3)
    return shrink


def _finish_wald(layer, meta, index, model, labels, analysis, effect_type, direction, filtering, adjust, factors, lengths, outliers):
    relative = _relative(lengths)
    sizes, method = _size_series(per_length(layer, relative), factors)
    rows, disp, log_s = _prepare(layer, model, meta, index, sizes, relative)
    shrink = _shrinkage(disp, model)
    stats = _wald(rows, disp, len(meta), model, log_s, shrink, None, outliers).withColumn("p_value", normal_two_sided(F.col("statistic")))
    stats = cut(stats.drop("lrt").withColumn("signed_stat", F.col("statistic")), "wald")
    stats = independent_filter(stats, method=adjust) if filtering else adjust_p(stats, ["comparison"], method=adjust, few=True, written=True)
    return standard(pad_untested(layer, stats, labels), layer, method, analysis, effect_type, "wald", direction)


def run_nb_anova(layer: Layer, groups: list[str], group_col=None, covariates=None, adjust="BH", factors: str = "ratio",
                 lengths: DataFrame | None = None, outliers: bool = True) -> DataFrame:
    """Full model against the model without groups, chi-square on groups - 1."""
    group_col = group_col or layer.group_col
    meta, index = sample_frame(layer)
    q = len(groups) - 1
    model = _design(layer, meta, group_col, [("anova", {g: (1.0 if i == 1 else -1.0 if i == 0 else 0.0) for i, g in enumerate(groups)})], covariates, None)
    relative = _relative(lengths)
    sizes, method = _size_series(per_length(layer, relative), factors)
    rows, disp, log_s = _prepare(layer, model, meta, index, sizes, relative)
    shrink = _shrinkage(disp, model)
    reduced = np.column_stack([np.ones(len(model.rows)), model.x[:, q + 1:]])
    stats = _wald(rows, disp, len(meta), model, log_s, shrink, reduced, outliers)
    stats = stats.withColumn("statistic", F.col("lrt")).withColumns({"effect": F.col("lrt"), "p_value": chisq_upper(F.col("lrt"), F.lit(float(q)))}).drop("lrt")
    out = adjust_p(pad_untested(layer, stats, ["anova"]), ["comparison"], method=adjust, few=True)
    return standard(out, layer, method, "anova", "LRT", "LRT", "none")


def _ql(layer, meta, index, model, q, labels, factors, analysis, effect_type, direction, adjust, reduced_of, relative=None):
    rows, disp, log_s = _prepare(layer, model, meta, index, factors, relative)
    trend = dispersion_trend(disp)
    use, x = model.rows, model.x
    n = len(meta)

    def kernel(batches):
        for part, y, off in _blocks(batches, n, use, log_s):
            mean = part["base_mean"].to_numpy(float)
            alpha = part["disp"].to_numpy(float) if trend is None else trend[0] + trend[1] / mean
            alpha = np.maximum(alpha, MIN_DISP)
            beta, mu, _ = irls(y, x, off, alpha)
            dev = deviance(y, mu, alpha)
            for label, w in model.contrasts:
                _, mu0, _ = irls(y, reduced_of(w), off, alpha)
                yield pd.DataFrame({
                    "feature_id": part["feature_id"], "comparison": label, "n": float(len(use)), "rank": float(x.shape[1]), "rss": np.maximum(dev, 1e-12),
                    "tss": np.nan, "mean": mean, "est": beta @ w / LN2, "quad": np.maximum(deviance(y, mu0, alpha) - dev, 0.0)})

    fits = cut(rows.join(disp, "feature_id").mapInPandas(
        kernel, "feature_id string, comparison string, n double, rank double, rss double, tss double, mean double, est double, quad double"), "ql")
    m = moderate(fits, labels[0]).drop("model_fit")
    m = m.withColumn("statistic", F.col("quad") / q / F.col("s2_post"))
    m = m.withColumn("p_value", f_upper(F.col("statistic"), F.lit(float(q)), F.col("df_total"))).withColumnRenamed("mean", "base_mean")
    if direction == "none":
        m = m.withColumn("effect", F.col("statistic"))
    else:
        m = m.withColumnRenamed("est", "effect").withColumn("signed_stat", F.signum("effect") * F.sqrt("statistic"))
    out = adjust_p(pad_untested(layer, m, labels), ["comparison"], method=adjust, few=True)
    return standard(out, layer, "edger", analysis, effect_type, "F", direction)


def _tmm_series(layer: Layer) -> pd.Series:
    t = tmm_factors(layer).toPandas().set_index("sample_id")
    eff = t.lib * t.norm_factor
    return eff / np.exp(np.log(eff).mean())


def _null_space(w):
    """Columns spanning the designs in which the contrast is zero."""
    w = np.asarray(w, float)[None, :]
    return np.linalg.svd(w)[2][1:].T


def run_ql(layer: Layer, contrasts, group_col=None, covariates=None, block=None, adjust="BH", lengths: DataFrame | None = None) -> DataFrame:
    """Filter, TMM, trended dispersion, quasi-likelihood F per contrast. Filtered features stay untested."""
    group_col = group_col or layer.group_col
    meta, index = sample_frame(layer)
    model = _design(layer, meta, group_col, contrasts, covariates, block)
    small, relative = _filtered(layer, group_col), _relative(lengths)
    return _ql(_as_full(layer, small), meta, index, model, 1, [c for c, _ in contrasts], _tmm_series(per_length(small, relative)), "group", "log2FC", "group", adjust,
               lambda w, x=model.x: x @ _null_space(w), relative)


def run_ql_anova(layer: Layer, groups: list[str], group_col=None, covariates=None, adjust="BH", lengths: DataFrame | None = None) -> DataFrame:
    """All group coefficients at once."""
    group_col = group_col or layer.group_col
    meta, index = sample_frame(layer)
    q = len(groups) - 1
    model = _design(layer, meta, group_col, [("anova", {g: (1.0 if i == 1 else -1.0 if i == 0 else 0.0) for i, g in enumerate(groups)})], covariates, None)
    small, relative = _filtered(layer, group_col), _relative(lengths)
    reduced = np.column_stack([np.ones(len(model.rows)), model.x[:, q + 1:]])
    return _ql(_as_full(layer, small), meta, index, model, q, ["anova"], _tmm_series(per_length(small, relative)), "anova", "F", "none", adjust, lambda w: reduced, relative)


def _filtered(layer: Layer, group_col: str) -> Layer:
    """The layer after P11, unless fewer than two features would stay."""
    kept = cut(expressed_features(layer, group_col).select("feature_id"), "expressed")
    return keep_features(layer, kept) if kept.limit(2).count() == 2 else layer


def _as_full(layer: Layer, small: Layer) -> Layer:
    """Cells of the filtered layer with the full feature table, so untested features keep a row."""
    from dataclasses import replace

    return replace(small, features=layer.features)
