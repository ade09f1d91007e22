"""Two-sample and paired t-tests for every feature and comparison in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.ordering import adjust_p
from assaygrid.functions.scalar import contrast_label
from assaygrid.functions.tails import t_two_sided
from assaygrid.model import Layer
from assaygrid.operators.diff.results import pad_untested, standard

EPS10 = 10 * 2.220446049250313e-16


def sides(spark, comparisons: list[tuple[str, str]]) -> DataFrame:
    """(grp, comparison, is_case) rows of the (case, control) list."""
    rows = []
    for case, control in comparisons:
        rows += [(case, contrast_label(case, control), True), (control, contrast_label(case, control), False)]
    return F.broadcast(spark.createDataFrame(rows, "grp string, comparison string, is_case boolean"))


def group_moments(layer: Layer, group_col: str, comparisons) -> DataFrame:
    """Per (feature, comparison): n, mean and variance of either side.

    Cells move once, to their feature, and both groupings stay there; the sample axis bounds a feature's cells.
    """
    labels = layer.per_sample(layer.samples.select("sample_id", F.col(group_col).alias("grp")))
    cells = layer.cells.join(labels, "sample_id").select("feature_id", "grp", "value").repartition("feature_id")
    m = cells.groupBy("feature_id", "grp").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    s = m.join(sides(layer.cells.sparkSession, comparisons), "grp")
    pick = lambda c, case: F.max(F.when(F.col("is_case") == case, F.col(c)))
    return s.groupBy("feature_id", "comparison").agg(
        F.coalesce(pick("n", True), F.lit(0)).alias("n_case"), pick("mean", True).alias("mean_case"), pick("var", True).alias("var_case"),
        F.coalesce(pick("n", False), F.lit(0)).alias("n_ctrl"), pick("mean", False).alias("mean_ctrl"), pick("var", False).alias("var_ctrl"),
    )


def unpaired(layer: Layer, group_col: str, comparisons, var_equal: bool = False) -> DataFrame:
    """Statistic and degrees of freedom per (feature, comparison)."""
    m = group_moments(layer, group_col, comparisons)
    nx, ny = F.col("n_case"), F.col("n_ctrl")
    vx, vy = F.col("var_case"), F.col("var_ctrl")
    if var_equal:
        df = nx + ny - 2
        pooled = (F.when(nx > 1, (nx - 1) * vx).otherwise(0.0) + F.when(ny > 1, (ny - 1) * vy).otherwise(0.0)) / F.nullif(df, F.lit(0))
        se = F.sqrt(pooled * (1 / F.nullif(nx, F.lit(0)) + 1 / F.nullif(ny, F.lit(0))))
        bad = (nx < 1) | (ny < 1) | (nx + ny < 3)
    else:
        sx, sy = vx / F.nullif(nx, F.lit(0)), vy / F.nullif(ny, F.lit(0))
        se = F.sqrt(sx + sy)
        df = (sx + sy) * (sx + sy) / F.nullif(sx * sx / F.nullif(nx - 1, F.lit(0)) + sy * sy / F.nullif(ny - 1, F.lit(0)), F.lit(0.0))
        bad = (nx < 2) | (ny < 2)
    m = m.withColumns({"se": se, "df": df.cast("double")})
    flat = F.coalesce(F.col("se") < EPS10 * F.greatest(F.abs("mean_case"), F.abs("mean_ctrl")), F.lit(False))
    diff = F.col("mean_case") - F.col("mean_ctrl")
    return m.select(
        "feature_id", "comparison", diff.alias("effect"), ((F.col("mean_case") + F.col("mean_ctrl")) / 2).alias("base_mean"),
        F.when(~(bad | flat) & (F.col("se") > 0), diff / F.col("se")).alias("statistic"), "df",
    )


def complete_pairs(layer: Layer, group_col: str, pair_col: str, comparisons) -> DataFrame:
    """D3: (comparison, sample_id, pair, is_case) of the pairs with exactly one sample on each side."""
    s = layer.samples.select("sample_id", F.col(group_col).alias("grp"), F.col(pair_col).alias("pair")).where("pair is not null")
    s = s.join(sides(s.sparkSession, comparisons), "grp")
    good = s.groupBy("comparison", "pair").agg(
        F.sum(F.col("is_case").cast("int")).alias("a"), F.sum((~F.col("is_case")).cast("int")).alias("b")
    ).where("a = 1 and b = 1")
    return s.join(good.select("comparison", "pair"), ["comparison", "pair"]).select("comparison", "sample_id", "pair", "is_case")


def paired(layer: Layer, group_col: str, pair_col: str, comparisons) -> DataFrame:
    """D3: t-test on the differences of the pairs seen on both sides."""
    pairs = complete_pairs(layer, group_col, pair_col, comparisons)
    side = lambda case: F.max(F.when(F.col("is_case") == case, F.col("value")))
    d = layer.cells.join(layer.per_sample(pairs), "sample_id").groupBy("feature_id", "comparison", "pair").agg(
        side(True).alias("x"), side(False).alias("y")).where("x is not null and y is not null")
    m = d.groupBy("feature_id", "comparison").agg(
        F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("effect"), F.var_samp(F.col("x") - F.col("y")).alias("v"),
        ((F.avg("x") + F.avg("y")) / 2).alias("base_mean"))
    se = F.sqrt(F.col("v") / F.col("n"))
    ok = (F.col("n") >= 2) & (se >= EPS10 * F.abs("effect")) & (se > 0)
    return m.select("feature_id", "comparison", "effect", "base_mean", F.when(ok, F.col("effect") / se).alias("statistic"),
                    (F.col("n") - 1).cast("double").alias("df"))


def run_ttest(layer: Layer, comparisons, group_col: str | None = None, pair_col: str | None = None,
              var_equal: bool = False, adjust: str = "BH") -> DataFrame:
    """D2-D4 with p-values, adjustment per comparison and the standard columns."""
    group_col = group_col or layer.group_col
    stats = paired(layer, group_col, pair_col, comparisons) if pair_col else unpaired(layer, group_col, comparisons, var_equal)
    full = pad_untested(layer, stats, [contrast_label(a, b) for a, b in comparisons])
    full = full.withColumn("p_value", t_two_sided(F.col("statistic"), F.col("df")))
    full = adjust_p(full.withColumn("signed_stat", F.col("statistic")), ["comparison"], method=adjust, few=True)
    return standard(full, layer, "ttest", "group", "mean_diff", "t", "group")
