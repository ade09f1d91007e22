"""Linear models and moderated statistics."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.ordering import adjust_p, exact_quantiles
from assaygrid.functions.scalar import contrast_label
from assaygrid.functions.tails import digamma, f_upper, t_two_sided, trigamma, trigamma_inverse
from assaygrid.model import Layer
from assaygrid.operators.diff.design import estimable
from assaygrid.operators.diff.kernel import Model, feature_rows, fit_features, reml_correlation
from assaygrid.operators.diff.results import pad_untested, standard
from assaygrid.operators.gram import _dense, sample_index
from assaygrid.session import cut


def sample_frame(layer: Layer) -> tuple[pd.DataFrame, DataFrame]:
    """The (bounded) sample table on the driver in index order, and the index table."""
    ids, index = sample_index(layer)
    meta = layer.samples.toPandas().drop_duplicates("sample_id").set_index("sample_id").loc[ids]
    return meta, index


def treatment(values: pd.Series, levels=None) -> tuple[np.ndarray, list]:
    """Treatment-coded columns of a factor, or one centred column of a number."""
    if levels is None and pd.api.types.is_numeric_dtype(values) and not pd.api.types.is_bool_dtype(values):
        v = values.to_numpy(float)
        return (v - v.mean())[:, None], []
    text = values.astype(str)
    levels = levels or sorted(text.unique())
    cols = [(text == lv).to_numpy(float) for lv in levels[1:]]
    return (np.stack(cols, axis=1) if cols else np.zeros((len(text), 0))), list(levels)


def with_covariates(base: np.ndarray, meta: pd.DataFrame, covariates) -> tuple[np.ndarray, list]:
    """Design columns followed by the covariates, and the factor list for the level check."""
    x, factors = base, []
    for c in covariates or []:
        cols, levels = treatment(meta[c])
        if levels:
            factors.append((list(range(x.shape[1], x.shape[1] + cols.shape[1])), True))
        x = np.hstack([x, cols])
    return x, factors


def rows_with(meta: pd.DataFrame, cols) -> np.ndarray:
    """Positions of samples without missing values in the given columns."""
    return np.flatnonzero(meta[list(cols)].notna().all(axis=1).to_numpy())


def _adjusted_r2():
    r2 = 1 - F.col("rss") / F.nullif(F.col("tss"), F.lit(0.0))
    return F.when(F.col("rank") == 1, 0.0).otherwise(1 - (1 - r2) * (F.col("n") - 1) / F.nullif(F.col("df"), F.lit(0.0)))


def _with_t(fits: DataFrame) -> DataFrame:
    """Ordinary t of the reported coefficient."""
    fits = fits.withColumn("df", F.col("n") - F.col("rank"))
    s2 = F.col("rss") / F.nullif(F.col("df"), F.lit(0.0))
    exact = F.col("rss") <= 1e-20 * F.col("tss")
    t = F.when((F.col("df") > 0) & ~exact, F.col("est") / F.nullif(F.col("unscaled") * F.sqrt(s2), F.lit(0.0)))
    return fits.withColumns({"statistic": t, "model_fit": F.when(F.col("df") > 0, _adjusted_r2())})


def refuse(x: np.ndarray, contrasts) -> None:
    """A contrast that the design cannot tell is an error, not a number."""
    for label, w in contrasts:
        if not estimable(x, w):
            raise ValueError(f"{label} cannot be told from the covariates; see design_problems")


def lm_group_models(layer: Layer, meta: pd.DataFrame, group_col: str, comparisons, covariates=None, block=None):
    models = []
    extra = list(covariates or []) + ([block] if block else [])
    for case, control in comparisons:
        rows = np.array([i for i in rows_with(meta, [group_col, *extra]) if meta[group_col].iloc[i] in (case, control)])
        sub = meta.iloc[rows]
        group = (sub[group_col] == case).to_numpy(float)
        x = np.column_stack([np.ones(len(rows)), group])
        x, factors = with_covariates(x, sub.assign(**({block: sub[block].astype(str)} if block else {})), extra)
        w = np.zeros(x.shape[1])
        w[1] = 1
        refuse(x, [(contrast_label(case, control), w)])
        models.append(Model(rows, x, [(contrast_label(case, control), w)], factors=[([1], True), *factors]))
    return models


def run_lm(layer: Layer, comparisons, group_col=None, covariates=None, pair_col=None, adjust="BH") -> DataFrame:
    """Y ~ group + covariates for every (case, control) pair."""
    group_col = group_col or layer.group_col
    meta, index = sample_frame(layer)
    models = lm_group_models(layer, meta, group_col, comparisons, covariates, pair_col)
    fits = _with_t(fit_features(layer, index, len(meta), models))
    fits = fits.withColumn("p_value", t_two_sided(F.col("statistic"), F.col("df")))
    out = pad_untested(layer, fits.withColumnsRenamed({"est": "effect", "mean": "base_mean"}).withColumn(
        "signed_stat", F.col("statistic")), [contrast_label(a, b) for a, b in comparisons])
    out = adjust_p(out, ["comparison"], method=adjust, few=True)
    return standard(out, layer, "lm", "group", "beta", "t", "group")


def continuous_model(meta: pd.DataFrame, column: str, covariates=None, block=None) -> Model:
    """y ~ column + covariates; Spearman beside it, partial when adjusted."""
    extra = list(covariates or []) + ([block] if block else [])
    rows = rows_with(meta, [column, *extra])
    sub = meta.iloc[rows]
    if block:
        sub = sub.assign(**{block: sub[block].astype(str)})
    v = sub[column].to_numpy(float)
    x, factors = with_covariates(np.column_stack([np.ones(len(rows)), v - v.mean()]), sub, extra)
    adjust = with_covariates(np.ones((len(rows), 1)), sub, extra)[0] if extra else None
    w = np.zeros(x.shape[1])
    w[1] = 1
    return Model(rows, x, [(column, w)], factors=factors, rank_with=v, adjust=adjust)


def run_lm_continuous(layer: Layer, column: str, covariates=None, adjust="BH") -> DataFrame:
    """Slope t with Spearman's rho as the effect."""
    meta, index = sample_frame(layer)
    fits = _with_t(fit_features(layer, index, len(meta), [continuous_model(meta, column, covariates)]))
    fits = fits.withColumn("p_value", t_two_sided(F.col("statistic"), F.col("df")))
    out = pad_untested(layer, fits.withColumnsRenamed({"rho": "effect", "mean": "base_mean"}).withColumn(
        "signed_stat", F.col("statistic")), [column])
    out = adjust_p(out, ["comparison"], method=adjust, few=True)
    return standard(out, layer, "lm", "continuous_linear", "correlation", "t", "continuous")


def squeeze_prior(fits: DataFrame) -> dict:
    """Prior degrees of freedom and variance from the residual variances of all features.

    Moments of log variances (Smyth 2004); one aggregate over distinct degrees of freedom, whose
    number the sample axis bounds.
    """
    ok = fits.where("df > 0 and rss > 0").withColumn("z", F.log(F.col("rss") / F.col("df")))
    rows = ok.groupBy("df").agg(F.count("*").alias("c"), F.avg("z").alias("m"), F.var_pop("z").alias("v")).collect()
    if not rows:
        return {"d0": 0.0, "s02": 1.0, "pool": 0.0}
    df = np.array([r.df for r in rows])
    c = np.array([r.c for r in rows], float)
    e = np.array([r.m for r in rows]) - digamma(df / 2) + np.log(df / 2)
    v = np.array([r.v for r in rows])
    total = c.sum()
    mean = (c * e).sum() / total
    pool = float((c * df).sum())
    if total < 2:
        return {"d0": 0.0, "s02": 1.0, "pool": pool}
    spread = (c * (v + (e - mean) ** 2)).sum() / (total - 1) - (c * trigamma(df / 2)).sum() / total
    if spread > 0:
        d0 = 2 * trigamma_inverse(spread)
        s02 = float(np.exp(mean + digamma(np.array([d0 / 2]))[0] - np.log(d0 / 2)))
        return {"d0": float(d0), "s02": s02, "pool": pool}
    return {"d0": float("inf"), "s02": float(np.exp(mean)), "pool": pool}


def moderate(fits: DataFrame, prior_key: str | None = None) -> DataFrame:
    """D7 core: posterior variance and total degrees of freedom.

    The fits are written once; the prior comes from one row per feature (`prior_key` names the
    contrast to take it from, as all contrasts of a feature share one residual variance).
    """
    fits = fits.withColumn("df", F.col("n") - F.col("rank"))
    one = fits if prior_key is None else fits.where(F.col("comparison") == prior_key)
    prior = squeeze_prior(one)
    d0, s02 = prior["d0"], prior["s02"]
    s2 = F.col("rss") / F.nullif(F.col("df"), F.lit(0.0))
    if np.isinf(d0):
        post = F.lit(s02)
    else:
        post = (d0 * s02 + F.coalesce(F.col("df") * s2, F.lit(0.0))) / (d0 + F.col("df"))
    total = F.least(F.col("df") + F.lit(d0), F.lit(prior["pool"]))
    return fits.withColumns({
        "s2_post": F.when(F.col("df") > 0, post), "df_total": F.when(F.col("df") > 0, total),
        "model_fit": F.when(F.col("df") > 0, _adjusted_r2()),
    })


def _group_design(meta: pd.DataFrame, group_col: str, levels, covariates, block, contrasts, joint=None) -> Model:
    extra = list(covariates or []) + ([block] if block else [])
    rows = np.array([i for i in rows_with(meta, [group_col, *extra]) if meta[group_col].iloc[i] in levels])
    sub = meta.iloc[rows]
    if block:
        sub = sub.assign(**{block: sub[block].astype(str)})
    x = np.column_stack([(sub[group_col] == lv).to_numpy(float) for lv in levels])
    x, _ = with_covariates(x, sub, extra)
    pad = lambda w: np.concatenate([w, np.zeros(x.shape[1] - len(w))])
    full = [(label, pad(np.asarray(w, float))) for label, w in contrasts]
    return Model(rows, x, full, joint=None if joint is None else np.stack([pad(j) for j in joint]))


def run_moderated(layer: Layer, contrasts: list[tuple[str, dict]], group_col=None, covariates=None, block=None,
                  adjust="BH") -> DataFrame:
    """All named groups in one model; contrasts are (label, {level: weight}) with weights summing to 0.

    A `block` enters as fixed columns (D11), which asks for at least two samples per block; where it
    would absorb a contrast, the blocks become a random effect and a warning says so.
    """
    group_col = group_col or layer.group_col
    levels = []
    for _, w in contrasts:
        if abs(sum(w.values())) > 1e-8 or not any(w.values()):
            raise ValueError("contrast weights must sum to 0 and not all be 0")
        levels += [lv for lv in w if lv not in levels]
    meta, index = sample_frame(layer)
    if block and meta[meta[group_col].isin(levels)].groupby(block).size().min() < 2:
        raise ValueError("every block needs at least two samples")
    vectors = [(label, [w.get(lv, 0.0) for lv in levels]) for label, w in contrasts]
    model = _group_design(meta, group_col, levels, covariates, block, vectors)
    if block and not all(estimable(model.x, w) for _, w in model.contrasts):
        warnings.warn(f"{block} as fixed blocks would absorb a contrast; fitted as a random effect", stacklevel=2)
        return run_moderated_random_block(layer, contrasts, block, group_col, covariates, adjust)
    refuse(model.x, model.contrasts)
    fits = cut(fit_features(layer, index, len(meta), [model]), "fits")
    m = moderate(fits, contrasts[0][0])
    t = F.col("est") / F.nullif(F.col("unscaled") * F.sqrt("s2_post"), F.lit(0.0))
    m = m.withColumns({"statistic": t, "signed_stat": t})
    m = m.withColumn("p_value", t_two_sided(F.col("statistic"), F.col("df_total")))
    out = pad_untested(layer, m.withColumnsRenamed({"est": "effect", "mean": "base_mean"}).drop("model_fit"), [c for c, _ in contrasts])
    return standard(adjust_p(out, ["comparison"], method=adjust, few=True), layer, "limma", "group", "log2FC", "t", "group")


def block_correlations(layer: Layer, index: DataFrame, n_samples: int, model: Model, blocks: np.ndarray) -> DataFrame:
    """(feature_id, rho, at_bound): each feature's block correlation of greatest restricted likelihood; features that tell nothing are left out."""
    use, x = model.rows, model.x

    def kernel(batches):
        for b in batches:
            rho, bound = reml_correlation(_dense(b, "k", "v", n_samples)[:, use], x, blocks)
            keep = ~np.isnan(rho)
            yield pd.DataFrame({"feature_id": b["feature_id"][keep], "rho": rho[keep], "at_bound": bound[keep]})

    return feature_rows(layer.cells, index).mapInPandas(kernel, "feature_id string, rho double, at_bound boolean")


def consensus_correlation(layer: Layer, index: DataFrame, n_samples: int, model: Model, blocks: np.ndarray) -> float:
    """Back-transformed mean of the features' atanh block correlations, 15 % trimmed on either side."""
    found = block_correlations(layer, index, n_samples, model, blocks)
    z = cut(found.select(F.atanh(F.greatest(F.least("rho", F.lit(0.99)), F.lit(-0.99))).alias("z")), "block-correlations")
    ends = exact_quantiles(z, [], "z", [0.15, 0.85], ["lo", "hi"]).first()
    if ends is None:
        return 0.0
    mid = z.where(F.col("z").between(ends["lo"], ends["hi"])).agg(F.avg("z")).first()[0]
    return float(np.tanh(mid)) if mid is not None else 0.0


def block_model(layer: Layer, contrasts, block: str, group_col=None, covariates=None):
    """(samples as a frame, their index, the model without the block, the blocks of its samples)."""
    group_col = group_col or layer.group_col
    levels = list(dict.fromkeys(lv for _, w in contrasts for lv in w))
    meta, index = sample_frame(layer)
    model = _group_design(meta, group_col, levels, covariates, None, [(lab, [w.get(lv, 0.0) for lv in levels]) for lab, w in contrasts])
    refuse(model.x, model.contrasts)
    return meta, index, model, meta[block].astype(str).to_numpy()[model.rows]


def feature_block_correlations(layer: Layer, contrasts, block: str, group_col=None, covariates=None) -> DataFrame:
    """The table behind the consensus: feature_id, rho, at_bound."""
    meta, index, model, b = block_model(layer, contrasts, block, group_col, covariates)
    return block_correlations(layer, index, len(meta), model, b)


def run_moderated_random_block(layer: Layer, contrasts: list[tuple[str, dict]], block: str, group_col=None, covariates=None,
                               adjust="BH") -> DataFrame:
    """Blocks as a random effect with one consensus correlation, for designs a fixed block would absorb."""
    meta, index, model, b = block_model(layer, contrasts, block, group_col, covariates)
    same = ((b[:, None] == b[None, :]) & ~np.eye(len(b), dtype=bool)).astype(float)
    rho = consensus_correlation(layer, index, len(meta), model, b)
    size = max(same.sum(axis=1).max(), 1.0)
    model.same, model.rho = same, float(np.clip(rho, -1 / size + 1e-3, 0.999))
    m = moderate(cut(fit_features(layer, index, len(meta), [model]), "fits"), contrasts[0][0])
    t = F.col("est") / F.nullif(F.col("unscaled") * F.sqrt("s2_post"), F.lit(0.0))
    m = m.withColumns({"statistic": t, "signed_stat": t})
    m = m.withColumn("p_value", t_two_sided(F.col("statistic"), F.col("df_total")))
    out = pad_untested(layer, m.withColumnsRenamed({"est": "effect", "mean": "base_mean"}).drop("model_fit"), [c for c, _ in contrasts])
    return standard(adjust_p(out, ["comparison"], method=adjust, few=True), layer, "limma", "group", "log2FC", "t", "group")


def run_moderated_continuous(layer: Layer, column: str, covariates=None, adjust="BH") -> DataFrame:
    """D8."""
    meta, index = sample_frame(layer)
    fits = cut(fit_features(layer, index, len(meta), [continuous_model(meta, column, covariates)]), "fits")
    m = moderate(fits)
    t = F.col("est") / F.nullif(F.col("unscaled") * F.sqrt("s2_post"), F.lit(0.0))
    m = m.withColumns({"statistic": t, "signed_stat": t}).withColumn(
        "p_value", t_two_sided(F.col("statistic"), F.col("df_total")))
    out = pad_untested(layer, m.withColumnsRenamed({"rho": "effect", "mean": "base_mean"}), [column])
    return standard(adjust_p(out, ["comparison"], method=adjust, few=True), layer, "limma", "continuous_linear",
                    "correlation", "t", "continuous")


def natural_basis(v: np.ndarray, df: int = 3) -> np.ndarray:
    """A natural cubic spline basis with `df` columns: knots at even quantiles, linear outside the range."""
    knots = np.quantile(v, np.linspace(0, 1, df + 1))
    lo, hi = knots[0], knots[-1]
    z = (v - lo) / (hi - lo)
    k = (knots - lo) / (hi - lo)
    cube = lambda a: np.maximum(z - a, 0) ** 3
    d = lambda a: (cube(a) - cube(k[-1])) / (k[-1] - a)
    cols = [z - z.mean()]
    for a in k[:-2]:
        c = d(a) - d(k[-2])
        cols.append(c - c.mean())
    return np.column_stack(cols)


def run_moderated_spline(layer: Layer, column: str, df: int = 3, covariates=None, adjust="BH") -> DataFrame:
    """Moderated F over a natural cubic basis; undirected."""
    meta, index = sample_frame(layer)
    rows = rows_with(meta, [column, *(covariates or [])])
    sub = meta.iloc[rows]
    v = sub[column].to_numpy(float)
    basis = natural_basis(v, df)
    x, factors = with_covariates(np.column_stack([np.ones(len(rows)), basis]), sub, covariates)
    joint = np.zeros((df, x.shape[1]))
    joint[np.arange(df), np.arange(1, df + 1)] = 1
    w = np.zeros(x.shape[1])
    w[1] = 1
    model = Model(rows, x, [(column, w)], joint=joint, factors=factors, rank_with=v)
    m = moderate(cut(fit_features(layer, index, len(meta), [model]), "fits"))
    return _f_result(layer, m, column, df, "continuous_spline", "rho", "correlation", adjust, "continuous")


def _f_result(layer, m, label, q, analysis, effect, effect_type, adjust, direction):
    m = m.withColumn("statistic", F.col("quad") / q / F.nullif(F.col("s2_post"), F.lit(0.0)))
    m = m.withColumn("p_value", f_upper(F.col("statistic"), F.lit(float(q)), F.col("df_total")))
    m = m.withColumn("effect", F.col(effect)).withColumnRenamed("mean", "base_mean")
    if direction == "none":
        m = m.drop("model_fit")
    out = adjust_p(pad_untested(layer, m, [label]), ["comparison"], method=adjust, few=True)
    return standard(out, layer, "limma", analysis, effect_type, "F", direction)


def run_moderated_anova(layer: Layer, groups: list[str], group_col=None, covariates=None, adjust="BH") -> DataFrame:
    """Are the group means equal? Effect is the F statistic, direction 'ns'."""
    group_col = group_col or layer.group_col
    meta, index = sample_frame(layer)
    q = len(groups) - 1
    joint = [[-1.0] + [1.0 if j == i else 0.0 for j in range(q)] for i in range(q)]
    model = _group_design(meta, group_col, groups, covariates, None, [("anova", joint[0])], joint)
    m = moderate(cut(fit_features(layer, index, len(meta), [model]), "fits"))
    return _f_result(layer, m, "anova", q, "anova", "statistic", "F", adjust, "none")
