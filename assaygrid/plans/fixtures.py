"""Tables derived from the test layers that several queries share, with their SQL twins.

A derived table is written once per application and folder to the shared scratch folder.
The planted layer shifts the parts of one brand and one size in two regions, so that tests have
something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.families import CUTOFFS, smoothing_weights
from assaygrid.operators.diff import ttest
from assaygrid.operators.normalize import analysis_scale
from assaygrid.plans import testtables as TT
from assaygrid.plans.registry import bh, t_tail
from assaygrid.plans.testtables import shared

COMPARISONS = [(g, "AFRICA") for g in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]
SHIFT = """CASE WHEN grp = 'ASIA' AND p_brand = 'Brand#7' THEN 3.0 WHEN grp = 'ASIA' AND p_size = 5 THEN -3.0
      WHEN grp = 'EUROPE' AND p_brand = 'Brand#7' THEN 2.0 ELSE 0.0 END"""


def planted(layer):
    """The log layer with fixed shifts. The features are the small side, so cells are not sorted to meet them."""
    base = analysis_scale(layer)
    labels = base.per_sample(base.samples.select("sample_id", "grp"))
    marks = base.features.select("feature_id", "p_brand", "p_size").hint("shuffle_hash")
    cells = base.cells.join(labels, "sample_id").join(marks, "feature_id").select(
        "feature_id", "sample_id", (F.col("value") + F.expr(SHIFT)).alias("value"))
    return base.with_cells(cells)


PLANTED_SQL = TT.PRICES_SQL + f""",
lcells AS (SELECT feature_id, sample_id, log2(value + 1) + ({SHIFT})::DOUBLE AS value
           FROM cells JOIN samples USING (sample_id) JOIN features USING (feature_id))"""

PLANTED_COUNTS_SQL = f"""
ccells0 AS (SELECT 'P'||l_partkey AS feature_id, 'N'||s_nationkey||'Y'||year AS sample_id, round(sum(l_quantity), 2) AS value
           FROM lines GROUP BY l_partkey, s_nationkey, year),
libs AS (SELECT sample_id, sum(value) AS lib FROM ccells0 GROUP BY 1),
ccells AS (SELECT feature_id, sample_id, log2((value + 0.5::DOUBLE) / ((lib + 1) / 1e6::DOUBLE)) + ({SHIFT})::DOUBLE AS value
           FROM ccells0 JOIN libs USING (sample_id) JOIN samples USING (sample_id) JOIN features USING (feature_id))"""

_CMP = "cmp AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in COMPARISONS) + ") AS v(cs, ct))"


def welch_sql(cells: str, out: str, prefix: str) -> str:
    """Welch t per feature and comparison with p and BH, as CTEs ending in `out`."""
    return f"""
{prefix}mom AS (SELECT feature_id, grp, count(*) AS n, avg(value) AS m, CASE WHEN count(*) > 1 THEN var_samp(value) END AS v
        FROM {cells} JOIN samples USING (sample_id) GROUP BY 1, 2),
{prefix}st AS (SELECT f.feature_id, f.feature_symbol, f.feature_type, cs||'_vs_'||ct AS comparison, a.n AS nx, b.n AS ny, a.m AS mx, b.m AS my,
              a.v / a.n AS sx, b.v / b.n AS sy
       FROM features f CROSS JOIN cmp LEFT JOIN {prefix}mom a ON a.feature_id = f.feature_id AND a.grp = cs
       LEFT JOIN {prefix}mom b ON b.feature_id = f.feature_id AND b.grp = ct),
{prefix}tt AS (SELECT *, mx - my AS effect, (mx + my) / 2 AS base_mean,
              CASE WHEN nx >= 2 AND ny >= 2 AND sx + sy > 0 AND sqrt(sx + sy) >= 2.220446049250313e-15::DOUBLE * greatest(abs(mx), abs(my)) THEN (mx - my) / sqrt(sx + sy) END AS statistic,
              CASE WHEN nx >= 2 AND ny >= 2 AND sx + sy > 0 THEN (sx + sy) * (sx + sy) / (sx * sx / (nx - 1) + sy * sy / (ny - 1)) END AS df FROM {prefix}st),
{prefix}pp AS (SELECT *, {t_tail('statistic', 'df')} AS p_value FROM {prefix}tt),
{prefix}adj AS ({bh('p_value', 'comparison', prefix + 'pp')}),
{out} AS (SELECT feature_id, feature_symbol, feature_type, comparison, round(effect, 8) AS effect, round(statistic, 8) AS statistic,
     round(statistic, 8) AS signed_stat, round(p_value, 8) AS p_value, round(adj_p_value, 8) AS adj_p_value, round(base_mean, 8) AS base_mean,
     CASE WHEN effect > 0 THEN 'up' WHEN effect < 0 THEN 'down' ELSE 'ns' END AS direction FROM {prefix}adj)"""


DIFF_SQL = PLANTED_SQL + "," + _CMP + "," + welch_sql("lcells", "diff", "a_")
DIFF_B_SQL = PLANTED_COUNTS_SQL + "," + welch_sql("ccells", "diff_b", "b_").replace(
    "SELECT feature_id, feature_symbol, feature_type, comparison, round", "SELECT replace(feature_id, 'P', 'R') AS feature_id, feature_symbol, feature_type, comparison, round")


def _steady(df: DataFrame) -> DataFrame:
    cols = ("effect", "statistic", "signed_stat", "p_value", "adj_p_value", "base_mean")
    return df.withColumns({c: F.round(c, 8) for c in cols})


def diff(spark, sf) -> DataFrame:
    """Welch tests of the planted price layer, four regions against AFRICA."""
    return shared(spark, sf, "diff", lambda: _steady(ttest.run_ttest(planted(TT.prices(spark, sf)), COMPARISONS)))


def counts_as_r(spark, sf):
    """The count layer under its own feature ids (R...).

    Cells without a part meet no feature but count in their library. Their id is blank, not NULL: else the joins drop them early and
    the lines are not those of the library sizes, which could not share their shuffle.
    """
    from dataclasses import replace

    layer = TT.counts(spark, sf, F.coalesce(F.concat(F.lit("R"), "l_partkey"), F.lit("")))
    return replace(layer, features=layer.features.withColumn("feature_id", F.regexp_replace("feature_id", "^P", "R")))


def diff_b(spark, sf) -> DataFrame:
    """The same tests on the count layer."""
    return shared(spark, sf, "diff_b", lambda: _steady(ttest.run_ttest(planted(counts_as_r(spark, sf)), COMPARISONS)))


def one_comparison(df: DataFrame, name: str = "ASIA_vs_AFRICA") -> DataFrame:
    return df.where(F.col("comparison") == name)


def enriched(spark, sf) -> DataFrame:
    """All over-representation rows of the planted tests, unfiltered."""
    from assaygrid.operators.enrich import run_ora

    def build():
        out = run_ora(diff(spark, sf), TT.gene_sets(spark, sf), preference="raw", output_cutoff=None, max_size=100_000)
        return out.withColumns({c: F.round(c, 6) for c in ("p_value", "adj_p_value")})

    return shared(spark, sf, "enriched", build)


ORA_SQL = TT.GENE_SETS_SQL + """,
t2g AS (SELECT DISTINCT database, gs_name AS term, gene_symbol AS gene FROM gene_sets),
uni AS (SELECT DISTINCT comparison, feature_symbol AS gene FROM diff WHERE p_value IS NOT NULL),
dbg AS (SELECT DISTINCT database, gene FROM t2g),
unid AS (SELECT database, comparison, gene FROM uni JOIN dbg USING (gene)),
hits AS (SELECT DISTINCT comparison, CASE WHEN effect > 0 THEN 'up' ELSE 'down' END AS list, feature_symbol AS gene FROM diff WHERE p_value < 0.05 AND effect <> 0),
hitd AS (SELECT database, comparison, list, gene FROM hits JOIN dbg USING (gene)),
nn AS (SELECT database, comparison, count(*) AS big_n FROM unid GROUP BY 1, 2),
nh AS (SELECT database, comparison, list, count(*) AS n FROM hitd GROUP BY 1, 2, 3),
sz AS (SELECT u.database, comparison, term, count(*) AS m FROM unid u JOIN t2g t ON t.database = u.database AND t.gene = u.gene GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 10 AND 100000),
ov AS (SELECT h.database, h.comparison, h.list, t.term, count(*) AS k, string_agg(h.gene, '/' ORDER BY h.gene) AS genes
       FROM hitd h JOIN t2g t ON t.database = h.database AND t.gene = h.gene GROUP BY 1, 2, 3, 4),
op AS (SELECT ov.*, m, n, big_n, list_sum(list_transform(range(k, least(m, n) + 1), lambda i:
          CASE WHEN big_n - m - n + i < 0 THEN 0.0::DOUBLE ELSE
          exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) + lgamma(big_n - m + 1.0) - lgamma(n - i + 1.0) - lgamma(big_n - m - n + i + 1.0)
              - lgamma(big_n + 1.0) + lgamma(n + 1.0) + lgamma(big_n - n + 1.0)) END)) AS p_value
       FROM ov JOIN sz USING (database, comparison, term) JOIN nh USING (database, comparison, list) JOIN nn USING (database, comparison)),
oadj0 AS (""" + bh("p_value", "database, comparison, list", "op") + """),
opi AS (SELECT database, comparison, list, least(1.0::DOUBLE, greatest(1.0::DOUBLE / count(*), """ + " + ".join(
    f"({w!r}::DOUBLE) * count(*) FILTER (p_value >= {c}::DOUBLE) / (count(*) * {1 - c!r}::DOUBLE)" for c, w in zip(CUTOFFS, smoothing_weights())) + """)) AS pi0 FROM op GROUP BY ALL),
oadj AS (SELECT oadj0.*, pi0 * adj_p_value AS q_value FROM oadj0 JOIN opi USING (database, comparison, list)),
ora AS (SELECT database, comparison, term AS pathway_id, list AS direction, round(p_value, 6) AS p_value, round(adj_p_value, 6) AS adj_p_value, q_value,
        m::DOUBLE AS gene_set_size, k::DOUBLE AS overlap_size, genes AS overlap_features FROM oadj)"""
