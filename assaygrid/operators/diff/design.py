"""Is a design fit for its question? One row per problem, before anything is fitted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from assaygrid.model import Layer


def estimable(x: np.ndarray, weights: np.ndarray) -> bool:
    """Can the design tell the weighted sum of its coefficients? True when the weights lie in its row space."""
    rank = np.linalg.matrix_rank(x)
    return bool(rank) and np.linalg.matrix_rank(np.vstack([x, np.atleast_2d(weights)])) == rank


def list_problems(meta: pd.DataFrame, group_col: str | None = None, comparisons=(), covariates=(), block: str | None = None,
                  column: str | None = None) -> list[tuple[str, str]]:
    """(problem, item) for a bounded sample table; see `design_problems`."""
    from assaygrid.operators.diff.linear import with_covariates

    found = [("no such column", c) for c in [group_col, column, block, *covariates] if c is not None and c not in meta.columns]
    if found:
        return found
    extra = list(covariates)
    if group_col:
        levels = set(meta[group_col].dropna())
        found += [("absent level", str(v)) for v in sorted({v for pair in comparisons for v in pair} - levels)]
        found += [("same case and control", str(a)) for a, b in comparisons if a == b]
    sides = [(f"{a} vs {b}", meta[meta[group_col].isin((a, b))], a) for a, b in comparisons if a != b and {a, b} <= levels] if group_col else []
    if column:
        sides.append((column, meta[meta[column].notna()], None))
    for label, sub, case in sides:
        gaps = [c for c in extra if sub[c].isna().any()]
        found += [("covariate has gaps", f"{c}: {label}") for c in gaps]
        sub = sub.dropna(subset=[*extra, *([block] if block else [])])
        constant = [c for c in extra if sub[c].nunique() < 2]
        found += [("constant covariate", f"{c}: {label}") for c in constant]
        asked = (sub[group_col] == case).to_numpy(float) if case is not None else sub[column].to_numpy(float)
        if len(np.unique(asked)) < 2:
            found.append(("nothing to compare", label))
            continue
        base = np.column_stack([np.ones(len(sub)), asked])
        weight = lambda x: np.eye(x.shape[1])[1]
        for c in extra:
            x = with_covariates(base, sub, [c])[0]
            if c not in constant and not estimable(x, weight(x)):
                found.append(("confounded covariate", f"{c}: {label}"))
        if extra and not any(p == "confounded covariate" and i.endswith(f": {label}") for p, i in found):
            x = with_covariates(base, sub, extra)[0]
            if not estimable(x, weight(x)):
                found.append(("confounded covariates", f"{', '.join(extra)}: {label}"))
        if block:
            sizes = sub.groupby(block).size()
            if (sizes < 2).all():
                found.append(("blocks of one sample", f"{block}: {label}"))
            x = with_covariates(base, sub.assign(**{block: sub[block].astype(str)}), [block])[0]
            if not estimable(x, weight(x)):
                found.append(("block absorbs the comparison", f"{block}: {label}"))
    return found


def design_problems(layer: Layer, comparisons=(), group_col=None, covariates=(), block: str | None = None, column: str | None = None) -> DataFrame:
    """(problem, item) rows, none for a sound design.

    Problems: no such column; absent level; same case and control; covariate has gaps; constant
    covariate; confounded covariate, or covariates that are only together; nothing to compare; blocks
    of one sample; block absorbs the comparison (a random block remains). `comparisons` are (case,
    control) pairs of `group_col`, `column` a continuous variable.
    """
    from assaygrid.operators.diff.linear import sample_frame

    group_col = group_col or (layer.group_col if comparisons else None)
    meta, _ = sample_frame(layer)
    rows = list_problems(meta, group_col, list(comparisons), list(covariates), block, column)
    return layer.samples.sparkSession.createDataFrame(rows, "problem string, item string")


def needed_samples(x: np.ndarray) -> int:
    """In how many samples a feature needs reads: one over the largest leverage of the design, rounded up.

    That is the size of the smallest group in a design of groups, and what stands in for it with covariates or a numeric variable.
    """
    x = np.asarray(x, float)
    if not x.size:
        return 1
    q, r = np.linalg.qr(x)
    full = np.abs(np.diag(r)) > 1e-9 * max(1.0, np.abs(r).max())
    if not full.all():
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        q = u[:, s > 1e-9 * s.max()]
    top = float((q * q).sum(axis=1).max())
    return int(np.ceil(1 / top - 1e-9)) if top > 0 else 1


def supported_features(layer, x: np.ndarray, min_reads: float = 10.0):
    """Features with `min_reads` reads in as many samples as the design needs."""
    from assaygrid.operators.cells import read_support

    return read_support(layer, needed_samples(x), min_reads)


def pairing_problems(layer: Layer, pair_col: str, groups: list[str] | None = None, group_col: str | None = None, control: str | None = None) -> DataFrame:
    """Blocks that do not fit a paired run, as rows (the pair column, n, n_groups, problem); none if all fit.

    Without `groups` (a numeric variable) a block needs two samples. With them it needs samples of two of the groups and none twice; with a `control` one
    of them must be the control's, so that with one case group a block is exactly a pair. Samples without a block or outside the groups do not count.
    """
    from pyspark.sql import functions as F

    group_col = group_col or layer.group_col
    rows = layer.samples.where(F.col(pair_col).isNotNull())
    if groups is None:
        few = rows.groupBy(pair_col).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("n_groups")).where("n < 2")
        return few.withColumn("problem", F.lit("fewer than two samples"))
    if control is not None and control not in groups:
        raise ValueError("the control must be one of the groups")
    g = F.col(group_col)
    held = F.lit(True) if control is None else F.max((g == control).cast("int")) == 1
    counted = rows.where(g.isin(groups)).groupBy(pair_col).agg(F.count("*").alias("n"), F.count_distinct(group_col).alias("n_groups"), held.alias("held"))
    problem = F.when(F.col("n") > F.col("n_groups"), "a group stands twice").when(F.col("n_groups") < 2, "only one group").when(~F.col("held"), "no control")
    return counted.withColumn("problem", problem).where("problem is not null").select(pair_col, "n", "n_groups", "problem")
