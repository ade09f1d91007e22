"""Registry of named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = 6):
    """Register a builder (spark, sf) -> DataFrame; doubles are rounded to `digits` for comparison."""
    def wrap(fn):
        def run(spark, sf):
            out = fn(spark, sf)
            return rounded(out, digits) if digits is not None else out

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of the rounding."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


# SQL expressions for distribution tails: Gauss-Legendre quadrature after a substitution that keeps
# the integrand smooth at the far end, and the finite series where degrees of freedom are whole.

def _nodes(n: int = 48) -> str:
    """Gauss-Legendre nodes and weights on (0, 1) as a SQL list of structs."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(n)
    return "[" + ", ".join(f"{{'u': {(a + 1) / 2!r}::DOUBLE, 'w': {b / 2!r}::DOUBLE}}" for a, b in zip(x.tolist(), w.tolist())) + "]"


def t_tail(t: str, df: str) -> str:
    """Two-sided t tail: 2c * integral of sin^(df-1) from 0 to S = pi/2 - atan(|t|/sqrt(df)), with s = S u^4."""
    s = f"(pi() / 2 - atan(abs({t}) / sqrt({df})))"
    return f"""(CASE WHEN {t} IS NULL OR {df} IS NULL THEN NULL ELSE
      8 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {s}
      * list_sum(list_transform({_nodes()}, lambda k: k.w * pow(k.u, 3) * pow(sin({s} * pow(k.u, 4)), {df} - 1))) END)"""


def t_tail_any(t: str, df: str) -> str:
    """Two-sided t tail also for many degrees of freedom, where the integrand stands within a few
    sqrt(df) of its end: there s = S - w / sqrt(df), and 12 widths hold all but 1e-30 of it."""
    s = f"(pi() / 2 - atan(abs({t}) / sqrt({df})))"
    wide = f"least({s} * sqrt({df}), 12)"
    return f"""(CASE WHEN {df} <= 200 THEN {t_tail(t, df)} WHEN {t} IS NOT NULL THEN
      2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi() * {df}) * {wide}
      * list_sum(list_transform({_nodes()}, lambda k: k.w * pow(sin({s} - k.u * {wide} / sqrt({df})), {df} - 1))) END)"""


def t_tail_whole(t: str, df: str) -> str:
    """Two-sided t tail for whole degrees of freedom by its finite trigonometric series."""
    th = f"atan(abs({t}) / sqrt({df}))"
    odd = f"""1 - 2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, (({df} - 1) // 2)::BIGINT), lambda j:
        exp(j * ln(2.0::DOUBLE) + lgamma(j + 1.0::DOUBLE) - (lgamma(2 * j + 2.0::DOUBLE) - j * ln(2.0::DOUBLE) - lgamma(j + 1.0::DOUBLE))) * pow(cos({th}), 2 * j + 1))), 0))"""
    even = f"""1 - sin({th}) * coalesce(list_sum(list_transform(range(0, ({df} // 2)::BIGINT), lambda j:
        exp(lgamma(2 * j + 1.0::DOUBLE) - 2 * j * ln(2.0::DOUBLE) - 2 * lgamma(j + 1.0::DOUBLE)) * pow(cos({th}), 2 * j))), 0)"""
    return f"(CASE WHEN {t} IS NULL OR {df} IS NULL OR {df} < 1 THEN NULL WHEN {df}::BIGINT % 2 = 1 THEN {odd} ELSE {even} END)"


def bh(p: str, family: str, src: str, cols: str = "*") -> str:
    """SQL for Benjamini-Hochberg: rank over non-NULL p, running minimum from the largest."""
    part = f"PARTITION BY {family}" if family else ""
    part2 = f"PARTITION BY {family}, ({p} IS NULL)" if family else f"PARTITION BY ({p} IS NULL)"
    return f"""
  SELECT {cols}, CASE WHEN {p} IS NULL THEN NULL ELSE least(1.0::DOUBLE, min(_v) OVER ({part2} ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) END AS adj_p_value
  FROM (SELECT *, {p} * (count({p}) OVER ({part})) / (row_number() OVER ({part2} ORDER BY {p})) AS _v FROM {src})"""


def digamma(x: str) -> str:
    """SQL digamma for x > 0: eight steps up, then the asymptotic series."""
    y = f"({x} + 8)"
    return f"""(ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8))
      - {" - ".join(f"1 / ({x} + {k})" for k in range(8))})"""


def trigamma(x: str) -> str:
    """SQL trigamma for x > 0."""
    y = f"({x} + 8)"
    return f"""(1 / {y} + 1 / (2 * pow({y}, 2)) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)) - 1 / (30 * pow({y}, 9))
      + {" + ".join(f"1 / pow({x} + {k}, 2)" for k in range(8))})"""


def moderated(fits: str, out: str) -> str:
    """CTEs (the first of them recursive) from `fits` (feature_id, df, rss, ...), one row per feature, to `out` with s2_post and df_total.

    The prior is the moment estimate from log variances; the inverse trigamma comes by bisection of its logarithm.
    """
    return f"""
mz AS (SELECT df::DOUBLE AS df, count(*)::DOUBLE AS c, avg(ln(rss / df)) AS m, var_pop(ln(rss / df)) AS v FROM {fits} WHERE df > 0 AND rss > 0 GROUP BY 1),
me AS (SELECT *, m - {digamma('(df / 2)')} + ln(df / 2) AS e, {trigamma('(df / 2)')} AS tri FROM mz),
mt AS (SELECT sum(c) AS total, sum(c * e) / sum(c) AS mean, sum(c * df) AS pool FROM me),
ms AS (SELECT any_value(total) AS total, any_value(mean) AS mean, any_value(pool) AS pool,
  sum(c * (v + pow(e - mean, 2))) / (any_value(total) - 1) - sum(c * tri) / any_value(total) AS spread FROM me, mt),
mb(i, lo, hi) AS (SELECT 0, -20.0::DOUBLE, 20.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN {trigamma('exp((lo + hi) / 2)')} > spread THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN {trigamma('exp((lo + hi) / 2)')} > spread THEN hi ELSE (lo + hi) / 2 END FROM mb, ms WHERE i < 70),
mp AS (SELECT *, 2 * exp((lo + hi) / 2) AS d0, exp(mean + {digamma('exp((lo + hi) / 2)')} - (lo + hi) / 2) AS s02 FROM ms, mb WHERE i = 70),
{out} AS (SELECT f.*, CASE WHEN df > 0 THEN CASE WHEN spread > 0 THEN (d0 * s02 + rss) / (d0 + df) ELSE exp(mean) END END AS s2_post,
  CASE WHEN df > 0 THEN CASE WHEN spread > 0 THEN least(df + d0, pool) ELSE pool END END AS df_total FROM {fits} f, mp)"""
