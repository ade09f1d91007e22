"""Tables behind the figures: points, labels, bars, matrices. Nothing is drawn here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.functions.scalar import neg_log10
from assaygrid.model import Layer
from assaygrid.operators.cells import keep_features, z_by
from assaygrid.operators.diff.results import thin_points
from assaygrid.operators.enrich import top_per_database
from assaygrid.operators.normalize import display_scale


def top_by_p(diff: DataFrame, n: int) -> DataFrame:
    """K2: the n smallest adjusted p, then p."""
    return diff.where("p_value is not null").orderBy("adj_p_value", "p_value", "feature_id").limit(n)


def labels(df: DataFrame, p: str, n: int, forced_symbols=(), id_col: str = "feature_id") -> DataFrame:
    """The n smallest p plus forced symbols; a symbol of several features shows the id."""
    best = df.where(F.col(p).isNotNull()).orderBy(p, id_col).limit(n)
    if forced_symbols:
        best = best.unionByName(df.where(F.col("feature_symbol").isin(*forced_symbols) | F.col(id_col).isin(*forced_symbols)))
    best = best.dropDuplicates([id_col])
    repeated = df.groupBy("feature_symbol").agg((F.count_distinct(id_col) > 1).alias("repeated"))
    return best.join(repeated, "feature_symbol", "left").withColumn(
        "label", F.when(F.col("repeated"), F.col(id_col)).otherwise(F.col("feature_symbol"))).drop("repeated")


def direction_class(mask: Column) -> Column:
    """Point classes: the direction word where significant, else 'ns'."""
    return F.when(mask, F.col("direction")).otherwise("ns")


def volcano(diff: DataFrame, mask: Column, p: str = "p_value", thin: bool = False) -> DataFrame:
    """V1: x, y and class of every tested feature, or the thinned set."""
    pts = diff.where(F.col("effect").isNotNull() & F.col(p).isNotNull()).select(
        "feature_id", "feature_symbol", F.col("effect").alias("x"), neg_log10(F.col(p)).alias("y"), direction_class(mask).alias("class"))
    return thin_points(pts, F.col("class") != "ns") if thin else pts


def class_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("class").agg(F.count("*").alias("n"))


def ma(diff: DataFrame, mask: Column) -> DataFrame:
    """V2: base mean against effect; empty when no base mean is known."""
    return diff.where("base_mean is not null and effect is not null").select(
        "feature_id", F.col("base_mean").alias("x"), F.col("effect").alias("y"), direction_class(mask).alias("class"))


def feature_expression(layer: Layer, ids: DataFrame, group_col: str) -> DataFrame:
    """V4: display-scale values of chosen features with their group."""
    y = keep_features(display_scale(layer), ids)
    g = y.per_sample(y.samples.select("sample_id", F.col(group_col).alias("grp")))
    return y.cells.join(g, "sample_id").select("feature_id", "sample_id", "grp", "value")


def heatmap(layer: Layer, ids: DataFrame, group_col: str) -> DataFrame:
    """V5: chosen features on the display scale as row z-scores, samples ordered by group, then mean."""
    y = keep_features(display_scale(layer), ids)
    cells = y.cells.withColumn("z", z_by("value", ["feature_id"]))
    means = cells.groupBy("sample_id").agg(F.avg("value").alias("m"))
    order = y.samples.select("sample_id", F.col(group_col).alias("grp")).join(means, "sample_id").select(
        "sample_id", "grp", F.round("m", 9).alias("m"))
    w = W.partitionBy("grp").orderBy("m", "sample_id")
    # The sample axis bounds these windows.
    placed = order.withColumn("place_in_group", F.row_number().over(w)).drop("m")
    return cells.join(y.per_sample(placed), "sample_id").select("feature_id", "sample_id", "grp", "place_in_group", "z")


def enrichment_dots(df: DataFrame, n: int, p: str = "adj_p_value") -> DataFrame:
    """V6: top rows per database with the plotted score."""
    return top_per_database(df, n, p).select("database", "comparison", "pathway_id", "direction", "place",
                                              neg_log10(F.col(p)).alias("score"), "overlap_size", "gene_set_size")


def hit_table(diff: DataFrame, mask: Column) -> DataFrame:
    """K7: significant rows by descending size of the effect."""
    return diff.where(mask).orderBy(F.abs("effect").desc(), "feature_id", "comparison")


def hits_for_heatmap(diff: DataFrame, mask: Column, layer: Layer, n: int = 50) -> DataFrame:
    """K8: significant features of the layer by adjusted p then p."""
    return diff.where(mask).join(layer.features.select("feature_id"), "feature_id", "left_semi").orderBy(
        "adj_p_value", "p_value", "feature_id").limit(n)


def joint_hits(conc: DataFrame, n: int) -> DataFrame:
    """K4: features significant on both sides by combined adjusted p, then p."""
    return conc.where("significant_a and significant_b").orderBy("adj_p_value", "p_value", "feature_id").limit(n)


def integration_table(conc: DataFrame) -> DataFrame:
    """Joint hits first, then combined p."""
    both = F.col("significant_a") & F.col("significant_b")
    return conc.withColumn("joint", both).orderBy(both.desc(), F.col("p_value").asc_nulls_last(), "feature_id")


def dual_volcano(conc: DataFrame) -> DataFrame:
    """V8: both layers' points of every pair, stacked under the side."""
    side = lambda s: conc.select("feature_id", F.lit(s).alias("side"), F.col(f"effect_{s}").alias("x"),
                                 neg_log10(F.col(f"p_value_{s}")).alias("y"), F.col(f"significant_{s}").alias("significant"))
    return side("a").unionByName(side("b"))


def effect_pairs(conc: DataFrame) -> DataFrame:
    """V8: one layer's effect against the other's with the joint class."""
    both = F.col("significant_a") & F.col("significant_b")
    cls = F.when(both, F.col("direction")).when(F.col("significant_a"), "a only").when(F.col("significant_b"), "b only").otherwise("ns")
    return conc.select("feature_id", F.col("effect_a").alias("x"), F.col("effect_b").alias("y"), "quadrant", cls.alias("class"))


def score_heatmap(scores: DataFrame, n: int) -> DataFrame:
    """The n most variable pathways as z-scores over samples."""
    var = scores.groupBy("database", "term").agg(F.var_samp("score").alias("v")).orderBy(F.col("v").desc_nulls_last(), "database", "term").limit(n)
    return scores.join(var.drop("v"), ["database", "term"]).withColumn("z", z_by("score", ["database", "term"])).drop("score")
