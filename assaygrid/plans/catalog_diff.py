"""Queries: differential tests, contrasts, rankings, figure tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from assaygrid.model import make_layer
from assaygrid.functions import ordering as O
from assaygrid.functions import scalar as S
from assaygrid.operators import cells as C
from assaygrid.operators import gram as G
from assaygrid.operators import normalize as N
from assaygrid.operators import views as VW
from assaygrid.operators.diff import counts, linear, results, ttest
from assaygrid.operators.diff import design as DS
from assaygrid.plans import fixtures as FX
from assaygrid.plans import testtables as TT
from assaygrid.plans import registry
from assaygrid.plans.registry import bh, moderated, t_tail_any, t_tail_whole


def query(name, sql=None, digits=8):
    return registry.query(name, sql, digits)


def r(expr, digits=8):
    return registry.r(expr, digits)


D = FX.DIFF_SQL
CMP = FX.COMPARISONS
_SIG = "coalesce(p_value < 0.05 AND abs(effect) >= 1, false)"


def mask():
    return results.significance(0.05, "raw", 1.0)


TEST_COLS = ["feature_id", "feature_symbol", "comparison", "effect", "statistic", "p_value", "adj_p_value", "base_mean", "direction"]
TEST_SQL = ", ".join(f"{r(c)} AS {c}" if c in ("effect", "statistic", "p_value", "adj_p_value", "base_mean") else c for c in TEST_COLS)


def _planted(s, d):
    return FX.planted(TT.prices(s, d))


query("d2_ttest_welch", f"WITH {D} SELECT {TEST_SQL} FROM diff")(
    lambda s, d: ttest.run_ttest(_planted(s, d), CMP).select(*TEST_COLS))
query("d4_many_comparisons", f"WITH {D} SELECT comparison, count(p_value) AS n_tested, {r('avg(effect)')} AS mean_effect, {r('min(p_value)')} AS best_p FROM diff GROUP BY 1")(
    lambda s, d: FX.diff(s, d).groupBy("comparison").agg(F.count("p_value").alias("n_tested"), F.avg("effect").alias("mean_effect"), F.min("p_value").alias("best_p")))
_POOL = f"""{FX.PLANTED_SQL}, {FX._CMP}, mom AS (SELECT feature_id, grp, count(*) n, avg(value) m, CASE WHEN count(*) > 1 THEN var_samp(value) ELSE 0 END v FROM lcells JOIN samples USING (sample_id) GROUP BY 1, 2),
st AS (SELECT f.feature_id, f.feature_symbol, cs||'_vs_'||ct AS comparison, coalesce(a.n, 0) nx, coalesce(b.n, 0) ny, a.m mx, b.m my, a.v vx, b.v vy FROM features f CROSS JOIN cmp LEFT JOIN mom a ON a.feature_id = f.feature_id AND a.grp = cs LEFT JOIN mom b ON b.feature_id = f.feature_id AND b.grp = ct),
tt AS (SELECT *, CASE WHEN nx >= 1 AND ny >= 1 THEN mx - my END AS effect, (mx + my) / 2 AS base_mean, (nx + ny - 2)::DOUBLE AS df, CASE WHEN nx >= 1 AND ny >= 1 AND nx + ny >= 3 THEN sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2) * (1.0::DOUBLE / nx + 1.0::DOUBLE / ny)) END AS se FROM st),
t2 AS (SELECT *, CASE WHEN se > 0 THEN effect / se END AS statistic FROM tt), pp AS (SELECT *, {t_tail_whole('statistic', 'df')} AS p_value FROM t2),
res AS ({bh('p_value', 'comparison', 'pp')})"""
query("d2_ttest_pooled", f"WITH {_POOL} SELECT feature_id, feature_symbol, comparison, {r('effect', 6)} AS effect, {r('statistic', 6)} AS statistic, {r('p_value', 6)} AS p_value, {r('adj_p_value', 6)} AS adj_p_value, {r('base_mean', 6)} AS base_mean, CASE WHEN effect > 0 THEN 'up' WHEN effect < 0 THEN 'down' ELSE 'ns' END AS direction FROM res", 6)(
    lambda s, d: ttest.run_ttest(_planted(s, d), CMP, var_equal=True).select(*TEST_COLS))
_PAIR = f"""{TT.FLAGGED_SQL}{TT.LOG_SQL}, gp AS (SELECT donor FROM samples WHERE grp IN ('A', 'R') GROUP BY 1 HAVING count(*) FILTER (grp = 'A') = 1 AND count(*) FILTER (grp = 'R') = 1),
dd AS (SELECT feature_id, donor, max(value) FILTER (grp = 'R') x, max(value) FILTER (grp = 'A') y FROM lcells JOIN samples USING (sample_id) SEMI JOIN gp USING (donor) GROUP BY 1, 2),
mm AS (SELECT feature_id, count(*) n, avg(x - y) effect, var_samp(x - y) v, (avg(x) + avg(y)) / 2 base_mean FROM dd WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
tt AS (SELECT f.feature_id, f.feature_symbol, 'R_vs_A' AS comparison, effect, base_mean, (n - 1)::DOUBLE AS df, CASE WHEN n >= 2 AND v > 0 THEN effect / sqrt(v / n) END AS statistic FROM features f LEFT JOIN mm USING (feature_id)),
pp AS (SELECT *, {t_tail_whole('statistic', 'df')} AS p_value FROM tt), res AS ({bh('p_value', 'comparison', 'pp')})"""
query("d3_ttest_paired", f"WITH {_PAIR} SELECT feature_id, feature_symbol, comparison, {r('effect', 6)} AS effect, {r('statistic', 6)} AS statistic, {r('p_value', 6)} AS p_value, {r('adj_p_value', 6)} AS adj_p_value, {r('base_mean', 6)} AS base_mean, CASE WHEN effect > 0 THEN 'up' WHEN effect < 0 THEN 'down' ELSE 'ns' END AS direction FROM res", 6)(
    lambda s, d: ttest.run_ttest(N.analysis_scale(TT.flagged(s, d)), [("R", "A")], pair_col="donor").select(*TEST_COLS))
query("p15_pairing_problems", f"WITH {TT.FLAGGED_SQL} SELECT donor, count(*) AS n, count(DISTINCT grp) AS n_groups FROM samples WHERE grp IN ('A', 'R') GROUP BY 1 HAVING count(*) FILTER (grp = 'A') <> 1 OR count(*) FILTER (grp = 'R') <> 1")(
    lambda s, d: DS.pairing_problems(TT.flagged(s, d), "donor", ["A", "R"], control="A").drop("problem"))
query("p14_design_problems", f"""WITH {TT.PRICES_SQL}, two AS (SELECT * FROM samples WHERE grp IN ('ASIA', 'AFRICA'))
SELECT 'absent level' AS problem, 'ATLANTIS' AS item WHERE NOT EXISTS (SELECT 1 FROM samples WHERE grp = 'ATLANTIS')
UNION ALL SELECT 'same case and control', 'EUROPE'
UNION ALL SELECT 'confounded covariate', 'nation: ASIA vs AFRICA' WHERE (SELECT max(g) FROM (SELECT count(DISTINCT grp) AS g FROM two GROUP BY nation)) = 1
UNION ALL SELECT 'confounded covariate', 'balance: ASIA vs AFRICA' WHERE (SELECT count(DISTINCT balance) FROM two) < 2
UNION ALL SELECT 'constant covariate', 'flat: ASIA vs AFRICA'
UNION ALL SELECT 'covariate has gaps', 'holes: ASIA vs AFRICA' WHERE EXISTS (SELECT 1 FROM two WHERE year = 1995)
UNION ALL SELECT 'block absorbs the comparison', 'nation: ASIA vs AFRICA' WHERE (SELECT max(g) FROM (SELECT count(DISTINCT grp) AS g FROM two GROUP BY nation)) = 1""")(
    lambda s, d: (lambda y: DS.design_problems(
        dataclasses.replace(y, samples=y.samples.withColumn("flat", F.lit(1.0)).withColumn("holes", F.when(F.col("year") != 1995, F.col("year")))),
        [("ASIA", "AFRICA"), ("EUROPE", "EUROPE"), ("ASIA", "ATLANTIS")], covariates=["nation", "balance", "flat", "holes"], block="nation"))(TT.prices(s, d)))
query("p14_confounding", f"WITH {TT.PRICES_SQL} SELECT grp, batch, count(*) AS n FROM samples GROUP BY 1, 2")(
    lambda s, d: TT.prices(s, d).samples.groupBy("grp", "batch").agg(F.count("*").alias("n")))

# Linear models. One covariate has closed forms, so the SQL twin residualises by Frisch-Waugh sums.
_LM = f"""{FX.PLANTED_SQL}, rowsx AS (SELECT feature_id, value y, (grp = 'ASIA')::INT::DOUBLE g, year - 1998 z FROM lcells JOIN samples USING (sample_id) WHERE grp IN ('ASIA', 'AFRICA')),
sm AS (SELECT feature_id, count(*)::DOUBLE n, avg(y) my, covar_pop(g, z) * count(*) sgz, var_pop(g) * count(*) sgg, var_pop(z) * count(*) szz, covar_pop(g, y) * count(*) sgy, covar_pop(z, y) * count(*) szy, var_pop(y) * count(*) syy FROM rowsx GROUP BY 1),
ft AS (SELECT *, sgg * szz - sgz * sgz AS det, szz > 1e-9 AS hasz FROM sm WHERE sgg > 1e-9),
cf AS (SELECT feature_id, n, my, CASE WHEN hasz THEN (CASE WHEN det > 1e-9 * sgg * szz THEN (szz * sgy - sgz * szy) / det END) ELSE sgy / sgg END b, CASE WHEN hasz AND det > 1e-9 * sgg * szz THEN (sgg * szy - sgz * sgy) / det ELSE 0 END c,
       CASE WHEN hasz AND det > 1e-9 * sgg * szz THEN szz / det ELSE 1 / sgg END vb, n - CASE WHEN hasz AND det > 1e-9 * sgg * szz THEN 3 ELSE 2 END df, sgy, szy, syy, hasz, det, sgg, szz FROM ft),
rs AS (SELECT *, coalesce(b, sgy / sgg) AS bb, syy - coalesce(b, sgy / sgg) * sgy - c * szy AS rss FROM cf)"""
query("d5_lm_covariate", f"""WITH {_LM} SELECT f.feature_id, {r('bb', 6)} AS effect, {r('CASE WHEN df > 0 AND rss > 1e-12 * syy THEN bb / sqrt(vb * rss / df) END', 5)} AS statistic,
{r('CASE WHEN df > 0 THEN 1 - (rss / syy) * (n - 1) / df END', 6)} AS model_fit FROM features f LEFT JOIN rs USING (feature_id)""", 6)(
    lambda s, d: linear.run_lm(_planted(s, d), [("ASIA", "AFRICA")], covariates=["year"]).select(
        "feature_id", "effect", F.round("statistic", 5).alias("statistic"), "model_fit"))
query("d5_lm_plain", f"WITH {_POOL} SELECT feature_id, comparison, {r('effect', 6)} AS effect, {r('CASE WHEN nx + ny > 2 THEN statistic END', 6)} AS statistic, {r('p_value', 6)} AS p_value FROM res", 6)(
    lambda s, d: linear.run_lm(_planted(s, d), CMP).select("feature_id", "comparison", "effect", "statistic", "p_value"))
_SP = """rk AS (SELECT feature_id, rank() OVER (PARTITION BY feature_id ORDER BY y) + (count(*) OVER (PARTITION BY feature_id, y) - 1) / 2.0::DOUBLE ry,
  rank() OVER (PARTITION BY feature_id ORDER BY x) + (count(*) OVER (PARTITION BY feature_id, x) - 1) / 2.0::DOUBLE rx, x, y FROM xy),
sp AS (SELECT feature_id, count(*) n, CASE WHEN count(*) >= 2 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END rho, regr_slope(y, x) b, var_pop(x) * count(*) sxx,
  var_pop(y) * count(*) - CASE WHEN var_pop(x) > 0 THEN pow(covar_pop(x, y), 2) / var_pop(x) * count(*) ELSE 0 END AS rss, avg(y) my FROM rk GROUP BY 1)"""
query("d6_lm_continuous", f"""WITH {TT.VECTORS_SQL}, xy AS (SELECT feature_id, value y, age x FROM cells JOIN samples USING (sample_id)), {_SP},
pp AS (SELECT *, b / sqrt(rss / (n - 2) / sxx) AS statistic, (n - 2)::DOUBLE AS df FROM sp), p2 AS (SELECT *, {t_tail_whole('statistic', 'df')} AS p_value FROM pp), res AS ({bh('p_value', '', 'p2')})
SELECT feature_id, {r('rho', 6)} AS effect, {r('statistic', 6)} AS statistic, {r('p_value', 6)} AS p_value, {r('adj_p_value', 6)} AS adj_p_value, {r('my', 6)} AS base_mean FROM res""", 6)(
    lambda s, d: linear.run_lm_continuous(TT.vectors(s, d), "age").select("feature_id", "effect", "statistic", "p_value", "adj_p_value", "base_mean"))
query("d6_lm_continuous_gaps", f"""WITH {FX.PLANTED_SQL}, xy AS (SELECT feature_id, value y, year x FROM lcells JOIN samples USING (sample_id)), {_SP} SELECT feature_id, {r('rho', 6)} AS effect, {r('my', 6)} AS base_mean FROM features LEFT JOIN sp USING (feature_id)""", 6)(
    lambda s, d: linear.run_lm_continuous(_planted(s, d), "year").select("feature_id", "effect", "base_mean"))
query("d6_lm_continuous_adjusted")(lambda s, d: linear.run_lm_continuous(TT.vectors(s, d), "age", ["batch"]).select("feature_id", "effect", "statistic", "p_value", "adj_p_value", "model_fit"))
_STD = ["feature_id", "comparison", "effect", "statistic", "p_value", "adj_p_value", "base_mean"]
_STD_SQL = ", ".join(f"{r(c, 6)} AS {c}" for c in _STD[2:])


def _groups_sql(*groups):
    """Group means and the pooled residuals of a one-way design, one row per feature."""
    names = ", ".join(f"'{g}'" for g in groups)
    return f"""{FX.PLANTED_SQL}, gy AS (SELECT feature_id, grp, value FROM lcells JOIN samples USING (sample_id) WHERE grp IN ({names})),
gm AS (SELECT feature_id, grp, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss, sum(value) AS s FROM gy GROUP BY 1, 2),
fit AS (SELECT feature_id, sum(n) AS n, sum(n) - count(*) AS df, sum(ss) AS rss, sum(s) / sum(n) AS base_mean FROM gm GROUP BY 1)"""


query("d7_moderated_group", f"""WITH RECURSIVE {_groups_sql('ASIA', 'AFRICA', 'EUROPE')}, {moderated('fit', 'mod')},
tt AS (SELECT f.feature_id, cs || '_vs_AFRICA' AS comparison, a.m - b.m AS effect, (a.m - b.m) / sqrt(s2_post * (1.0 / a.n + 1.0 / b.n)) AS statistic, df_total,
  base_mean
  FROM features f CROSS JOIN (SELECT unnest(['ASIA', 'EUROPE']) AS cs) LEFT JOIN mod USING (feature_id)
  LEFT JOIN gm a ON a.feature_id = f.feature_id AND a.grp = cs LEFT JOIN gm b ON b.feature_id = f.feature_id AND b.grp = 'AFRICA'),
pp AS (SELECT *, {t_tail_any('statistic', 'df_total')} AS p_value FROM tt), res AS ({bh('p_value', 'comparison', 'pp')}) SELECT feature_id, comparison, {_STD_SQL} FROM res""", 6)(
    lambda s, d: linear.run_moderated(_planted(s, d), [("ASIA_vs_AFRICA", {"ASIA": 1, "AFRICA": -1}), ("EUROPE_vs_AFRICA", {"EUROPE": 1, "AFRICA": -1})]).select(*_STD))
query("d7_moderated_covariate")(lambda s, d: linear.run_moderated(_planted(s, d), [("ASIA_vs_AFRICA", {"ASIA": 1, "AFRICA": -1})], covariates=["year", "batch"]).select(*_STD))
_CM = "cmn AS (SELECT feature_id, grp, avg(value) m FROM lcells JOIN samples USING (sample_id) GROUP BY 1, 2)"
query("d20_contrast_effects", f"""WITH {FX.PLANTED_SQL}, {_CM} SELECT f.feature_id, 'mix' AS comparison, {r("0.5::DOUBLE * max(m) FILTER (grp = 'ASIA') + 0.5::DOUBLE * max(m) FILTER (grp = 'EUROPE') - max(m) FILTER (grp = 'AFRICA')")} AS effect FROM features f LEFT JOIN cmn USING (feature_id) GROUP BY 1""")(
    lambda s, d: linear.run_moderated(_planted(s, d), [("mix", {"ASIA": 0.5, "EUROPE": 0.5, "AFRICA": -1})]).select("feature_id", "comparison", "effect"))
query("j19_contrast_of_means", f"""WITH {FX.PLANTED_SQL}, {_CM}, w AS (SELECT * FROM (VALUES ('mix', 'ASIA', 0.5::DOUBLE), ('mix', 'EUROPE', 0.5::DOUBLE), ('mix', 'AFRICA', -1.0::DOUBLE), ('ASIA_vs_EUROPE', 'ASIA', 1.0::DOUBLE), ('ASIA_vs_EUROPE', 'EUROPE', -1.0::DOUBLE)) t(comparison, grp, wt))
SELECT feature_id, comparison, {r('sum(m * wt)')} AS effect FROM cmn JOIN w USING (grp) GROUP BY 1, 2 HAVING count(*) = (CASE comparison WHEN 'mix' THEN 3 ELSE 2 END)""")(
    lambda s, d: results.contrast_of_means(_planted(s, d), [("mix", {"ASIA": 0.5, "EUROPE": 0.5, "AFRICA": -1.0}), ("ASIA_vs_EUROPE", {"ASIA": 1.0, "EUROPE": -1.0})]))
query("d8_moderated_continuous", f"""WITH RECURSIVE {TT.VECTORS_SQL}, xy AS (SELECT feature_id, value y, age x FROM cells JOIN samples USING (sample_id)), {_SP},
fit AS (SELECT *, n - 2 AS df FROM sp), {moderated('fit', 'mod')}, pp AS (SELECT *, b / sqrt(s2_post / sxx) AS statistic, rho AS effect, my AS base_mean, 'age' AS comparison FROM mod),
p2 AS (SELECT *, {t_tail_any('statistic', 'df_total')} AS p_value FROM pp), res AS ({bh('p_value', '', 'p2')}) SELECT feature_id, comparison, {_STD_SQL} FROM res""", 6)(
    lambda s, d: linear.run_moderated_continuous(TT.vectors(s, d), "age").select(*_STD))
query("d9_moderated_spline")(lambda s, d: linear.run_moderated_spline(TT.vectors(s, d), "age").select(*_STD))
# With four numerator degrees of freedom the F tail is x^a (1 + a (1 - x)), x = d / (d + 4 F), a = d / 2.
query("d10_moderated_anova", f"""WITH RECURSIVE {_groups_sql('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')}, {moderated('fit', 'mod')},
bt AS (SELECT feature_id, sum(g.n * pow(m - base_mean, 2)) AS between_, count(*) AS k FROM gm g JOIN fit USING (feature_id) GROUP BY 1),
tt AS (SELECT f.feature_id, 'anova' AS comparison, CASE WHEN k = 5 THEN between_ / 4 / s2_post END AS statistic, df_total AS d, base_mean
  FROM features f LEFT JOIN mod USING (feature_id) LEFT JOIN bt USING (feature_id)),
pp AS (SELECT *, statistic AS effect, pow(d / (d + 4 * statistic), d / 2) * (1 + d / 2 * (1 - d / (d + 4 * statistic))) AS p_value FROM tt),
res AS ({bh('p_value', '', 'pp')}) SELECT feature_id, comparison, {_STD_SQL} FROM res""", 6)(
    lambda s, d: linear.run_moderated_anova(_planted(s, d), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).select(*_STD))
query("d11_blocked_fit")(lambda s, d: linear.run_moderated(N.analysis_scale(TT.flagged(s, d)), [("R_vs_A", {"R": 1, "A": -1})], block="donor").select(*_STD))
query("d11_block_correlations")(lambda s, d: linear.feature_block_correlations(N.analysis_scale(TT.flagged(s, d)), [("R_vs_A", {"R": 1, "A": -1})], "donor"))
query("d19_standard_columns", f"""WITH {D} SELECT feature_id, feature_symbol, feature_type, 'proteomics' AS omics_type, 'ttest' AS method, 'group' AS analysis_type, comparison, {r('effect')} AS effect, 'mean_diff' AS effect_type,
{r('statistic')} AS statistic, 't' AS statistic_type, {r('signed_stat')} AS signed_stat, {r('p_value')} AS p_value, {r('adj_p_value')} AS adj_p_value, direction, {r('base_mean')} AS base_mean, NULL::DOUBLE AS model_fit, NULL::BOOLEAN AS is_significant FROM diff""")(
    lambda s, d: FX.diff(s, d))
query("j14_untested_kept", f"WITH {D} SELECT feature_id, comparison FROM diff WHERE p_value IS NULL")(lambda s, d: FX.diff(s, d).where("p_value is null").select("feature_id", "comparison"))

# ---- p adjustment --------------------------------------------------------------------------

query("w1_bh", f"WITH {D}, x AS (SELECT feature_id, comparison, p_value FROM diff), y AS ({bh('p_value', 'comparison', 'x')}) SELECT feature_id, comparison, {r('adj_p_value', 6)} AS adj_p_value FROM y", 6)(
    lambda s, d: O.adjust_p(FX.diff(s, d), ["comparison"], few=True, written=True).select("feature_id", "comparison", "adj_p_value"))
query("w1_bh_global", f"WITH {D}, x AS (SELECT feature_id, comparison, p_value FROM diff), y AS ({bh('p_value', '', 'x')}) SELECT feature_id, comparison, {r('adj_p_value', 6)} AS adj_p_value FROM y", 6)(
    lambda s, d: O.adjust_p(FX.diff(s, d), [], written=True).select("feature_id", "comparison", "adj_p_value"))
_RK = "x AS (SELECT feature_id, comparison, p_value AS p, row_number() OVER (PARTITION BY comparison ORDER BY p_value) AS i, count(*) OVER (PARTITION BY comparison) AS n FROM diff WHERE p_value IS NOT NULL)"


def _adj(name, sql):
    query(f"w2_{name.lower()}", f"WITH {D}, {_RK}, y AS ({sql}) SELECT d.feature_id, d.comparison, {r('a', 6)} AS adj_p_value FROM diff d LEFT JOIN y ON y.feature_id = d.feature_id AND y.comparison = d.comparison", 6)(
        lambda s, d: O.adjust_p(FX.diff(s, d), ["comparison"], method=name, few=True, written=True).select("feature_id", "comparison", "adj_p_value"))


_adj("bonferroni", "SELECT *, least(1.0::DOUBLE, p * n) a FROM x")
_adj("holm", "SELECT *, least(1.0::DOUBLE, max(p * (n - i + 1)) OVER (PARTITION BY comparison ORDER BY i)) a FROM x")
_adj("hochberg", "SELECT *, least(1.0::DOUBLE, min(p * (n - i + 1)) OVER (PARTITION BY comparison ORDER BY i DESC)) a FROM x")
_adj("BY", "SELECT *, least(1.0::DOUBLE, min(p * n / i * list_sum(list_transform(range(1, n + 1), lambda k: 1.0::DOUBLE / k))) OVER (PARTITION BY comparison ORDER BY i DESC)) a FROM (SELECT * FROM x)")

query("w2_hommel", f"""WITH {D}, {_RK}, s AS (SELECT a.comparison, a.n - a.i + 1 AS k, any_value(a.n) AS n, min((a.n - a.i + 1) * b.p / (b.i - a.i + 1)) AS simes FROM x a JOIN x b ON a.comparison = b.comparison AND b.i >= a.i GROUP BY 1, 2),
c AS (SELECT comparison, k, n, simes, coalesce(lead(simes) OVER (PARTITION BY comparison ORDER BY k), 0) AS next FROM s UNION ALL SELECT comparison, 0, any_value(n), any_value(n), max(simes) FILTER (k = 1) FROM s GROUP BY 1),
y AS (SELECT x.comparison, x.feature_id, least(1.0::DOUBLE, min(greatest(next, k * p))) AS a FROM x JOIN c ON c.comparison = x.comparison GROUP BY 1, 2)
SELECT d.feature_id, d.comparison, {r('a', 6)} AS adj_p_value FROM diff d LEFT JOIN y ON y.feature_id = d.feature_id AND y.comparison = d.comparison""", 6)(
    lambda s, d: O.adjust_p(FX.diff(s, d), ["comparison"], method="hommel", few=True, written=True).select("feature_id", "comparison", "adj_p_value"))

# ---- filters, rankings, contrast tables ----------------------------------------------------

_FC = "feature_id, comparison, " + ", ".join(f"{r(c)} AS {c}" for c in ("effect", "p_value", "adj_p_value"))
_FS = ["feature_id", "comparison", "effect", "p_value", "adj_p_value"]
query("p5_filter_adjusted", f"WITH {D} SELECT {_FC}, true AS is_significant FROM diff WHERE adj_p_value < 0.2")(
    lambda s, d: results.filter_results(FX.diff(s, d), 0.2).select(*_FS, "is_significant"))
query("p5_filter_raw_effect", f"WITH {D} SELECT {_FC}, true AS is_significant FROM diff WHERE {_SIG}")(
    lambda s, d: results.filter_results(FX.diff(s, d), 0.05, "raw", 1.0).select(*_FS, "is_significant"))
query("p7_mask", f"WITH {D} SELECT {_FC}, {_SIG} AS is_significant FROM diff")(
    lambda s, d: FX.diff(s, d).withColumn("is_significant", mask()).select(*_FS, "is_significant"))
query("p13_one_comparison", f"WITH {D} SELECT {_FC} FROM diff WHERE comparison = 'EUROPE_vs_AFRICA'")(
    lambda s, d: FX.one_comparison(FX.diff(s, d), "EUROPE_vs_AFRICA").select(*_FS))
query("p13_comparisons", f"WITH {D} SELECT DISTINCT comparison FROM diff")(lambda s, d: FX.diff(s, d).select("comparison").distinct())
query("p24_universe", f"WITH {D} SELECT DISTINCT comparison, feature_symbol AS gene FROM diff WHERE p_value IS NOT NULL")(
    lambda s, d: __import__("assaygrid.operators.enrich", fromlist=["x"]).tested_universe(FX.diff(s, d)))
query("p25_split_by_sign", f"WITH {D} SELECT DISTINCT comparison, CASE WHEN effect > 0 THEN 'up' ELSE 'down' END AS list, feature_symbol AS gene FROM diff WHERE {_SIG} AND effect <> 0")(
    lambda s, d: __import__("assaygrid.operators.enrich", fromlist=["x"]).directed_hits(FX.diff(s, d), mask()))
query("a10_contrast_summary", f"""WITH {D}, h AS (SELECT *, {_SIG} AS hit FROM diff), ni AS (SELECT feature_id, count(DISTINCT comparison) k FROM h WHERE hit GROUP BY 1)
SELECT comparison, sum((hit AND effect > 0)::INT)::BIGINT AS n_up, sum((hit AND effect < 0)::INT)::BIGINT AS n_down, sum(hit::INT)::BIGINT AS n_hits, count(p_value) AS n_tested, sum((hit AND coalesce(k, 0) > 1)::INT)::BIGINT AS n_shared FROM h LEFT JOIN ni USING (feature_id) GROUP BY 1""")(
    lambda s, d: results.contrast_summary(FX.diff(s, d), mask()))
query("j15_shared_hits", f"WITH {D} SELECT feature_id, comparison FROM diff a WHERE {_SIG} AND EXISTS (SELECT 1 FROM diff b WHERE b.feature_id = a.feature_id AND b.comparison <> a.comparison AND coalesce(b.p_value < 0.05 AND abs(b.effect) >= 1, false))")(
    lambda s, d: results.shared_hits(FX.diff(s, d), mask()))
query("a11_hit_combinations", f"""WITH {D}, c AS (SELECT feature_id, string_agg(comparison, ' & ' ORDER BY comparison) AS combination, count(*)::INT AS n_comparisons FROM diff WHERE {_SIG} GROUP BY 1), z AS (SELECT combination, n_comparisons, count(*) AS n_features FROM c GROUP BY 1, 2)
SELECT *, (SELECT count(*) FROM z) AS n_combinations FROM z ORDER BY n_features DESC, combination LIMIT 20""")(
    lambda s, d: results.hit_combinations(FX.diff(s, d), mask()))
query("a12_hit_sets_up", f"WITH {D} SELECT DISTINCT comparison, feature_id FROM diff WHERE {_SIG} AND effect > 0")(lambda s, d: results.hit_sets(FX.diff(s, d), mask(), "up"))
query("d21_hits_by_direction", f"WITH {D} SELECT comparison, direction, count(*) AS n FROM diff WHERE {_SIG} GROUP BY 1, 2")(
    lambda s, d: FX.diff(s, d).where(mask()).groupBy("comparison", "direction").agg(F.count("*").alias("n")))
query("w6_ranked_features", f"WITH {D} SELECT comparison, feature_id, {r('max(effect)')} AS effect FROM diff WHERE effect IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: results.ranked_features(FX.diff(s, d)))
query("f11_direction_sign", f"WITH {D} SELECT feature_id, comparison, CASE WHEN direction IN ('up', 'down') THEN direction END AS sign FROM diff")(
    lambda s, d: FX.diff(s, d).select("feature_id", "comparison", S.direction_sign(F.col("direction"), F.col("effect")).alias("sign")))
query("f13_neg_log10", f"WITH {D} SELECT feature_id, comparison, {r('-log10(greatest(p_value, 2.2250738585072014e-308::DOUBLE))')} AS y FROM diff WHERE p_value IS NOT NULL")(
    lambda s, d: FX.diff(s, d).where("p_value is not null").select("feature_id", "comparison", S.neg_log10(F.col("p_value")).alias("y")))
query("f18_direction_labels", f"WITH {D} SELECT feature_id, comparison, CASE WHEN effect > 0 THEN 'positive' WHEN effect < 0 THEN 'negative' ELSE 'ns' END AS label, 'ns' AS undirected FROM diff")(
    lambda s, d: FX.diff(s, d).select("feature_id", "comparison", S.direction_label(F.col("effect"), "continuous").alias("label"), S.direction_label(F.col("effect"), "none").alias("undirected")))
query("f19_contrast_labels", "SELECT DISTINCT r_name AS case_group, r_name||'_vs_AFRICA' AS label FROM region WHERE r_name <> 'AFRICA'")(
    lambda s, d: TT.table(s, d, "region").where("r_name <> 'AFRICA'").select(F.col("r_name").alias("case_group"), F.concat("r_name", F.lit(S.contrast_label("", "AFRICA"))).alias("label")).distinct())

# ---- top lists and figure tables -----------------------------------------------------------

query("k1_top_variance", f"WITH {FX.PLANTED_SQL}, v AS (SELECT feature_id, var_pop(value) * count(*) / ((SELECT count(*) FROM samples) - 1) AS row_var, avg(value) AS row_mean FROM lcells GROUP BY 1) SELECT feature_id, {r('row_mean', 6)} AS row_mean, {r('row_var', 6)} AS row_var FROM features LEFT JOIN v USING (feature_id) ORDER BY row_var DESC NULLS LAST, feature_id LIMIT 25", 6)(
    lambda s, d: C.top_by_variance(_planted(s, d), 25))
query("k2_top_by_p", f"WITH {D} SELECT {_FC} FROM diff WHERE p_value IS NOT NULL AND comparison = 'ASIA_vs_AFRICA' ORDER BY diff.adj_p_value, diff.p_value, feature_id LIMIT 20")(
    lambda s, d: VW.top_by_p(FX.one_comparison(FX.diff(s, d)), 20).select(*_FS))
_LBL = """one AS (SELECT * FROM diff WHERE comparison = 'ASIA_vs_AFRICA'), best AS (SELECT * FROM (SELECT * FROM one WHERE p_value IS NOT NULL ORDER BY p_value, feature_id LIMIT 10) UNION SELECT * FROM one WHERE feature_symbol IN ('G10', 'G20')),
rep AS (SELECT feature_symbol, count(DISTINCT feature_id) > 1 rp FROM one GROUP BY 1)"""
query("k3_labels", f"WITH {D}, {_LBL} SELECT feature_id, CASE WHEN rp THEN feature_id ELSE feature_symbol END AS label FROM best JOIN rep USING (feature_symbol)")(
    lambda s, d: VW.labels(FX.one_comparison(FX.diff(s, d)), "p_value", 10, ("G10", "G20")).select("feature_id", "label"))
query("k7_hit_table", f"WITH {D} SELECT {_FC} FROM diff WHERE {_SIG}")(lambda s, d: VW.hit_table(FX.diff(s, d), mask()).select(*_FS))
query("k8_hits_for_heatmap", f"WITH {D} SELECT {_FC} FROM diff WHERE {_SIG} AND comparison = 'ASIA_vs_AFRICA' ORDER BY diff.adj_p_value, diff.p_value, feature_id LIMIT 50")(
    lambda s, d: VW.hits_for_heatmap(FX.one_comparison(FX.diff(s, d)), mask(), TT.prices(s, d)).select(*_FS))
_PTS = f"pts AS (SELECT feature_id, feature_symbol, effect AS x, -log10(greatest(p_value, 2.2250738585072014e-308::DOUBLE)) AS y, CASE WHEN {_SIG} THEN direction ELSE 'ns' END AS class FROM diff WHERE comparison = 'ASIA_vs_AFRICA' AND effect IS NOT NULL AND p_value IS NOT NULL)"
query("v1_volcano", f"WITH {D}, {_PTS} SELECT feature_id, feature_symbol, {r('x')} AS x, {r('y')} AS y, class FROM pts")(
    lambda s, d: VW.volcano(FX.one_comparison(FX.diff(s, d)), mask()))
query("v1_class_counts", f"WITH {D}, {_PTS} SELECT class, count(*) AS n FROM pts GROUP BY 1")(
    lambda s, d: VW.class_counts(VW.volcano(FX.one_comparison(FX.diff(s, d)), mask())))
_BOX = "box AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, count(*) n FROM pts)"
query("p26_thinned_points", f"""WITH {D}, {_PTS}, {_BOX}, c AS (SELECT pts.*, class <> 'ns' OR x = x0 OR x = x1 OR y = y1 AS kp, coalesce(least(floor((x - x0) / nullif(x1 - x0, 0) * 40), 39), 0)::BIGINT AS cx, coalesce(least(floor((y - y0) / nullif(y1 - y0, 0) * 30), 29), 0)::BIGINT AS cy FROM pts, box)
SELECT feature_id, feature_symbol, {r('x')} AS x, {r('y')} AS y, class FROM (SELECT *, row_number() OVER (PARTITION BY kp, cx, cy ORDER BY feature_id) AS k FROM c) WHERE kp OR k = 1""")(
    lambda s, d: results.thin_points(VW.volcano(FX.one_comparison(FX.diff(s, d)), mask()), F.col("class") != "ns", grid=(40, 30), over=0))
query("v2_ma", f"WITH {D} SELECT feature_id, {r('base_mean')} AS x, {r('effect')} AS y, CASE WHEN {_SIG} THEN direction ELSE 'ns' END AS class FROM diff WHERE comparison = 'ASIA_vs_AFRICA' AND base_mean IS NOT NULL AND effect IS NOT NULL")(
    lambda s, d: VW.ma(FX.one_comparison(FX.diff(s, d)), mask()))
query("v3_pca_scores")(lambda s, d: (lambda y: G.pca(y, 2)[0].join(y.samples, "sample_id"))(TT.vectors(s, d)))
_DISP = "lb AS (SELECT sample_id, sum(value) lib FROM cells GROUP BY 1), dc AS (SELECT feature_id, sample_id, log2(value / lib * 1e6::DOUBLE + 1) AS value FROM cells JOIN lb USING (sample_id))"
query("v4_feature_expression", f"WITH {TT.COUNTS_SQL}, {_DISP} SELECT feature_id, sample_id, grp, {r('value')} AS value FROM dc JOIN samples USING (sample_id) JOIN features USING (feature_id) WHERE p_brand = 'Brand#7'")(
    lambda s, d: (lambda y: VW.feature_expression(y, y.features.where("p_brand = 'Brand#7'"), "grp"))(TT.counts(s, d)))
query("v5_heatmap", f"""WITH {TT.COUNTS_SQL}, {_DISP}, hc AS (SELECT dc.* FROM dc JOIN features USING (feature_id) WHERE p_brand = 'Brand#7'), sm AS (SELECT sample_id, grp, round(avg(value), 9) m FROM hc JOIN samples USING (sample_id) GROUP BY 1, 2),
pl AS (SELECT sample_id, grp, row_number() OVER (PARTITION BY grp ORDER BY m, sample_id)::INT AS place_in_group FROM sm)
SELECT feature_id, sample_id, grp, place_in_group, {r('CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END')} AS z FROM hc JOIN pl USING (sample_id) WINDOW w AS (PARTITION BY feature_id)""")(
    lambda s, d: (lambda y: VW.heatmap(y, y.features.where("p_brand = 'Brand#7'"), "grp"))(TT.counts(s, d)))
query("v7_contrast_bars", f"WITH {D} SELECT comparison, direction, count(*) AS n FROM diff WHERE {_SIG} AND direction <> 'ns' GROUP BY 1, 2")(
    lambda s, d: FX.diff(s, d).where(mask() & (F.col("direction") != "ns")).groupBy("comparison", "direction").agg(F.count("*").alias("n")))
query("u1_stacked_results", f"WITH {D}, {FX.DIFF_B_SQL} SELECT 'protein' AS tag, feature_id, comparison, {r('effect')} AS effect FROM diff UNION ALL SELECT 'rna', feature_id, comparison, {r('effect')} FROM diff_b")(
    lambda s, d: FX.diff(s, d).select(F.lit("protein").alias("tag"), "feature_id", "comparison", "effect").unionByName(FX.diff_b(s, d).select(F.lit("rna").alias("tag"), "feature_id", "comparison", "effect"), allowMissingColumns=True))

# ---- count models --------------------------------------------------------------------------

_CT = [("ASIA_vs_AFRICA", {"ASIA": 1, "AFRICA": -1}), ("mix", {"ASIA": 0.5, "EUROPE": 0.5, "AFRICA": -1})]
_GROUPS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _by_brand(s, d):
    """Counts per brand, some of which are seen in every sample at every size."""
    y = TT.brands(s, d, "l_quantity")
    brand = F.substring_index("feature_id", "/", 1).alias("feature_id")
    return make_layer(y.cells.groupBy(brand, "sample_id").agg(F.sum("value").alias("value")), y.samples, y.features.select(brand).distinct(),
                         "rnaseq", "raw_count", "grp", "AFRICA")


query("d12_nb_wald")(lambda s, d: counts.run_nb_wald(TT.counts(s, d), _CT, factors="library").select(*_STD))
query("d12_nb_wald_ratio")(lambda s, d: counts.run_nb_wald(_by_brand(s, d), _CT).select(*_STD, "method"))
query("d12_nb_wald_covariate")(lambda s, d: counts.run_nb_wald(TT.brands(s, d, "l_quantity"), _CT[:1], covariates=["year"], factors="ratio_or_library").select(*_STD))
query("d13_nb_continuous")(lambda s, d: counts.run_nb_continuous(TT.brands(s, d, "l_quantity"), "year", factors="ratio_or_library").select(*_STD))
query("d14_nb_anova")(lambda s, d: counts.run_nb_anova(TT.brands(s, d, "l_quantity"), _GROUPS, factors="ratio_or_library").select(*_STD))
query("d16_ql_group")(lambda s, d: counts.run_ql(TT.counts(s, d), _CT).select(*_STD))
query("d17_ql_anova")(lambda s, d: counts.run_ql_anova(TT.brands(s, d, "l_quantity"), _GROUPS).select(*_STD))
query("d11_nested_block")(lambda s, d: linear.run_moderated(TT.prices(s, d), [("ASIA_vs_AFRICA", {"ASIA": 1.0, "AFRICA": -1.0})], block="nation").select(*TEST_COLS))
query("d11_random_block")(lambda s, d: linear.run_moderated_random_block(N.analysis_scale(TT.flagged(s, d)), [("R_vs_A", {"R": 1, "A": -1})], "donor").select(*_STD))
