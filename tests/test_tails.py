"""Tails against closed forms and identities."""

import math

import numpy as np
import pytest

from assaygrid.functions import tails as T


def t_series(t, df):
    th = math.atan(abs(t) / math.sqrt(df))
    if df % 2:
        s, c, total = math.sin(th), math.cos(th), 0.0
        term = c
        for j in range((df - 1) // 2):
            total += term
            term *= c * c * (2 * j + 2) / (2 * j + 3)
        return 1 - 2 / math.pi * (th + s * total)
    s, c, total, term = math.sin(th), math.cos(th), 0.0, 1.0
    for j in range(df // 2):
        total += term
        term *= c * c * (2 * j + 1) / (2 * j + 2)
    return 1 - s * total


@pytest.mark.parametrize("df", [1, 2, 3, 5, 8, 13, 60])
@pytest.mark.parametrize("t", [0.0, 0.3, 1.0, 2.5, 6.0])
def test_t_whole_degrees(df, t):
    assert T.t_two_sided_np([t], [df])[0] == pytest.approx(t_series(t, df), abs=1e-12)


def test_t_deep_tail_keeps_relative_precision():
    p = T.t_two_sided_np([1e6], [3.0])[0]
    # Leading term of the df = 3 tail: 2 * 6 sqrt(3) / pi / (3 t^3) ...
    assert p == pytest.approx(2 * 2 * 3 ** 1.5 / (3 * math.pi) / 1e18, rel=1e-5)
    assert 0 < T.t_two_sided_np([60.0], [200.0])[0] < 1e-100


def test_f_is_squared_t_and_chisq_four():
    assert T.f_upper_np([2.5 ** 2], [1.0], [7.3])[0] == pytest.approx(T.t_two_sided_np([2.5], [7.3])[0], rel=1e-12)
    for x in (0.1, 3.0, 40.0, 700.0):
        assert T.gamma_upper([2.0], [x / 2])[0] == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)


def test_infinite_degrees_are_normal():
    assert T.t_two_sided_np([1.3], [np.inf])[0] == pytest.approx(math.erfc(1.3 / math.sqrt(2)), rel=1e-12)
    assert T.f_upper_np([1.7], [4.0], [np.inf])[0] == pytest.approx(math.exp(-3.4) * (1 + 3.4), rel=1e-12)


def test_hypergeometric_by_counting():
    total, marked, drawn = 20, 8, 6
    for k in range(0, 7):
        want = sum(math.comb(marked, i) * math.comb(total - marked, drawn - i) for i in range(k, 7)) / math.comb(total, drawn)
        assert T.hyper_upper_np(*[np.array([v]) for v in (k, drawn, marked, total)])[0] == pytest.approx(want, rel=1e-11)


def test_gamma_family():
    assert T.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert T.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi ** 2 / 6, abs=1e-12)
    for v in (0.01, 0.7, 3.0, 50.0):
        assert float(T.trigamma(np.array([T.trigamma_inverse(v)]))[0]) == pytest.approx(v, rel=1e-7)
