"""Block correlations by restricted likelihood against a brute-force grid with whole covariance matrices."""

import numpy as np
import pytest

from assaygrid.operators.diff.kernel import reml_correlation


def restricted(y, x, blocks, r):
    here = ~np.isnan(y)
    y, x, b = y[here], x[here], blocks[here]
    x = x[:, [j for j in range(x.shape[1]) if not j or np.linalg.matrix_rank(x[:, :j + 1]) > np.linalg.matrix_rank(x[:, :j])]]
    v = np.where(b[:, None] == b[None, :], r, 0.0) + (1 - r) * np.eye(len(y))
    w = np.linalg.inv(v)
    m = x.T @ w @ x
    e = y - x @ np.linalg.solve(m, x.T @ w @ y)
    return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(m)[1] + (len(y) - x.shape[1]) * np.log(e @ w @ e))


def planted(rng, rho, features, blocks, gaps):
    group = np.tile([0, 1], len(blocks))[:len(blocks)]
    x = np.column_stack((np.ones(len(blocks)), group, rng.normal(size=len(blocks)), group))  # the last column is aliased
    b = rng.normal(size=(features, blocks.max() + 1))
    y = 3 + group + np.sqrt(max(rho, 0)) * b[:, blocks] + np.sqrt(1 - rho) * rng.normal(size=(features, len(blocks)))
    y[rng.random(y.shape) < gaps] = np.nan
    return y, x


@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_against_a_grid(gaps):
    rng = np.random.default_rng(3)
    blocks = np.array([0, 0, 1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 6, 6])
    y, x = planted(rng, 0.5, 60, blocks, gaps)
    rho, bound = reml_correlation(y, x, blocks)
    for row, r, at in zip(y, rho, bound):
        sizes = np.bincount(blocks[~np.isnan(row)])
        low = -1 / (sizes.max() - 1) + 1e-4
        grid = np.linspace(low, 1 - 1e-4, 800)
        values = [restricted(row, x, blocks, g) for g in grid]
        assert restricted(row, x, blocks, r) >= max(values) - 1e-6
        assert at == (r - low < 1e-3 or 1 - 1e-4 - r < 1e-3)


def test_planted_correlations_bounds_and_poor_rows():
    rng = np.random.default_rng(4)
    blocks = np.repeat(np.arange(12), 4)
    for want in (0.0, 0.3, 0.8):
        y, x = planted(rng, want, 400, blocks, 0.1)
        rho, _ = reml_correlation(y, x, blocks)
        assert np.tanh(np.arctanh(rho).mean()) == pytest.approx(want, abs=0.04)
    alike = np.repeat(rng.normal(size=(1, 12)), 4, axis=1) + 1e-9 * rng.normal(size=(1, 48))
    rho, bound = reml_correlation(alike, np.ones((48, 1)), blocks)
    assert rho[0] > 0.99 and bound[0]
    few = np.full((3, 48), np.nan)
    few[1, :1], few[2, ::4] = 1.0, rng.normal(size=12)
    assert np.isnan(reml_correlation(few, np.ones((48, 1)), blocks)[0]).all()
