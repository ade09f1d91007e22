"""Selections, counts and shape changes over the cell table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.model import Layer
from assaygrid.session import cut

# Samples whose ids travel together when absent cells are listed.
SAMPLES_PER_BLOCK = 50_000


def keep_samples(layer: Layer, ids: DataFrame) -> Layer:
    """The layer restricted to the sample ids of `ids`."""
    ids = ids.select("sample_id").distinct()
    samples = layer.samples.join(ids, "sample_id", "left_semi")
    cells = layer.cells.join(layer.per_sample(samples.select("sample_id")), "sample_id", "left_semi")
    return replace(layer, samples=samples, cells=cells, _counted={})


def keep_features(layer: Layer, ids: DataFrame) -> Layer:
    """The layer restricted to the feature ids of `ids`."""
    ids = ids.select("feature_id").distinct()
    return replace(
        layer,
        features=layer.features.join(ids, "feature_id", "left_semi"),
        cells=layer.cells.join(ids, "feature_id", "left_semi"),
    )


def drop_unlabelled(layer: Layer, cols: list[str]) -> Layer:
    """Without samples missing any of the given metadata."""
    return keep_samples(layer, layer.samples.dropna(subset=cols))


def feature_counts(layer: Layer) -> DataFrame:
    """Observed cells per feature, all-missing features included."""
    seen = layer.cells.groupBy("feature_id").agg(F.count("*").alias("n_seen"))
    return layer.features.select("feature_id").join(seen, "feature_id", "left").fillna(0, ["n_seen"])


def feature_missing(layer: Layer) -> DataFrame:
    """A1 by feature."""
    return feature_counts(layer).select(
        "feature_id", (1 - F.col("n_seen") / layer.n_samples()).alias("missing_rate")
    )


def sample_missing(layer: Layer) -> DataFrame:
    """A1 by sample."""
    seen = layer.cells.groupBy("sample_id").agg(F.count("*").alias("n_seen"))
    return layer.samples.select("sample_id").join(seen, "sample_id", "left").select(
        "sample_id", (1 - F.coalesce("n_seen", F.lit(0)) / layer.n_features()).alias("missing_rate")
    )


def group_missing(layer: Layer, group_col: str) -> DataFrame:
    """A2: missing rate per feature and group. Every feature appears once per group."""
    sizes = layer.samples.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count("*").alias("n_group"))
    labels = layer.per_sample(layer.samples.select("sample_id", F.col(group_col).alias("grp")))
    seen = (
        layer.cells.join(labels, "sample_id").where("grp is not null")
        .groupBy("feature_id", "grp").agg(F.count("*").alias("n_seen"))
        .groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("grp", "n_seen"))).alias("by_group"))
    )
    levels = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(group_col).alias("grp"), "n_group")))).scalar()
    return (
        layer.features.select("feature_id").join(seen, "feature_id", "left")
        .select("feature_id", "by_group", F.explode(levels).alias("g"))
        .select("feature_id", F.col("g.grp").alias("grp"),
                (1 - F.coalesce(F.element_at("by_group", F.col("g.grp")), F.lit(0)) / F.col("g.n_group")).alias("missing_rate"))
    )


def keep_by_missing(layer: Layer, cutoff: float) -> DataFrame:
    """Feature ids with a missing rate up to the cutoff."""
    return feature_missing(layer).where(F.col("missing_rate") <= cutoff)


def keep_by_group_missing(layer: Layer, group_col: str, cutoff: float, rule: str) -> DataFrame:
    """P27: 'any_group' keeps a feature seen well enough in one group, 'all_groups' in each."""
    pick = {"any_group": F.min, "all_groups": F.max}[rule]
    return group_missing(layer, group_col).groupBy("feature_id").agg(
        pick("missing_rate").alias("filter_missing_rate")
    ).where(F.col("filter_missing_rate") <= cutoff)


def absent_cells(layer: Layer) -> DataFrame:
    """The (feature_id, sample_id) pairs without a value.

    Sample ids travel as arrays, one per block of samples, and each feature subtracts the ids it
    has; only absent pairs are ever produced.
    """
    blocks = max(1, -(-layer.sample_count() // SAMPLES_PER_BLOCK))
    block = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int")
    ids = layer.samples.groupBy(block.alias("block")).agg(F.collect_set("sample_id").alias("ids"))
    seen = layer.cells.groupBy("feature_id", block.alias("block")).agg(F.collect_list("sample_id").alias("seen"))
    base = layer.features.select("feature_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return (
        base.join(seen, ["feature_id", "block"], "left")
        .join(layer.per_sample(ids), "block")
        .select("feature_id", F.explode(
            F.when(F.col("seen").isNull(), F.col("ids")).otherwise(F.array_except("ids", "seen"))
        ).alias("sample_id"))
    )


def row_moments(layer: Layer) -> DataFrame:
    """A5: mean and variance per feature; the divisor is the number of samples minus one."""
    sums = layer.cells.groupBy("feature_id").agg(
        F.avg("value").alias("row_mean"), F.count("*").alias("n_seen"), F.var_pop("value").alias("vp"),
    )
    return sums.select(
        "feature_id", "row_mean", (F.col("vp") * F.col("n_seen") / (layer.n_samples() - 1)).alias("row_var")
    )


def drop_constant(layer: Layer) -> DataFrame:
    """Feature ids whose values vary."""
    return row_moments(layer).where("row_var > 0")


def complete_features(layer: Layer) -> DataFrame:
    """Feature ids seen in every sample."""
    return feature_counts(layer).where(F.col("n_seen") == layer.n_samples()).select("feature_id")


def expressed_features(layer: Layer, group_col: str, min_count: float = 10.0, min_total: float = 15.0) -> DataFrame:
    """Features with enough counts per million in as many samples as the smallest group has."""
    libs = layer.cells.groupBy("sample_id").agg(F.sum("value").alias("lib"))
    scale = libs.agg((F.lit(min_count) / F.percentile("lib", 0.5) * 1e6).alias("cut")).select(F.col("cut")).scalar()
    smallest = layer.samples.where(F.col(group_col).isNotNull()).groupBy(group_col).count().agg(F.min("count")).scalar()
    need = F.when(smallest > 10, 10 + (smallest - 10) * 0.7).otherwise(smallest)
    cpm = F.col("value") / F.col("lib") * 1e6
    return (
        layer.cells.join(layer.per_sample(libs), "sample_id")
        .groupBy("feature_id").agg(
            F.sum((cpm >= scale).cast("int")).alias("n_above"), F.sum("value").alias("total")
        )
        .where((F.col("n_above") >= need - 1e-14) & (F.col("total") >= min_total - 1e-14))
    )


def read_support(layer: Layer, n_needed: int, min_reads: float = 10.0) -> DataFrame:
    """Features with at least `min_reads` in at least `n_needed` samples."""
    return layer.cells.groupBy("feature_id").agg(
        F.sum((F.col("value") >= min_reads).cast("int")).alias("n_above")
    ).where(F.col("n_above") >= n_needed)


def par_y_empty(layer: Layer) -> DataFrame:
    """Ids of pseudo-autosomal Y copies without any non-zero value."""
    live = layer.cells.where("value <> 0").select("feature_id").distinct()
    return layer.features.where(F.col("feature_id").endswith("_PAR_Y")).select("feature_id").join(
        live, "feature_id", "left_anti"
    )


def count_preflight(layer: Layer, raw: DataFrame) -> DataFrame:
    """Per kind of trouble in raw count cells, how many cells (or samples) have it."""
    v = F.col("value")
    bad = raw.agg(
        F.sum(v.isNull().cast("long")).alias("missing"),
        F.sum((F.isnan(v) | (F.abs(v) == float("inf"))).cast("long")).alias("not_finite"),
        F.sum((v < 0).cast("long")).alias("negative"),
        F.sum((~F.isnan(v) & (v != float("inf")) & (v > 2147483647.0)).cast("long")).alias("too_large"),
    )
    empty = layer.samples.join(
        layer.cells.where("value > 0").select("sample_id").distinct(), "sample_id", "left_anti"
    ).agg(F.count("*"))
    return bad.withColumn("empty_samples", empty.scalar())


def melt(wide: DataFrame, id_col: str, value_cols: list[str], samples_in_rows: bool = False) -> DataFrame:
    """A wide table to cells; NULL cells are dropped."""
    long = wide.unpivot(id_col, value_cols, "column_id", "value").where("value is not null")
    names = ("sample_id", "feature_id") if samples_in_rows else ("feature_id", "sample_id")
    return long.select(F.col(id_col).alias(names[0]), F.col("column_id").alias(names[1]), "value")


def unique_labels(df: DataFrame, col: str, order: list[str], out: str = "label") -> DataFrame:
    """Repeats of an id become id_1, id_2, ...; a blank id becomes '._missing'.

    Rows are cut into ranges of (id, order), written once, and numbered inside their range, behind what earlier ranges hold of the same id. So an id that
    most rows bear, the blank one for instance, is numbered by many tasks. `order` tells the rows of an id apart.
    """
    filled = F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit("._missing"))
    ranges = cut(df.withColumn("_base", filled).repartitionByRange(F.col("_base"), *order).withColumn("_range", F.spark_partition_id()), "labels")
    earlier = W.partitionBy("_base").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    held = ranges.groupBy("_base", "_range").agg(F.count("*").alias("_n")).select(
        "_base", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    n = F.row_number().over(W.partitionBy("_base", "_range").orderBy(*order)) + F.col("_before")
    numbered = ranges.join(held, ["_base", "_range"]).withColumn("_nth", n)
    return numbered.withColumn(out, F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", (F.col("_nth") - 1).cast("string")))).select(
        *[c for c in df.columns if c != out], out)


def z_by(col: str, keys: list[str]) -> Column:
    """W12 within groups bounded by the sample axis: flat groups give 0, NULL stays NULL."""
    w = W.partitionBy(*keys)
    sd = F.stddev_samp(col).over(w)
    return F.when(F.col(col).isNull(), None).when(sd > 0, (F.col(col) - F.avg(col).over(w)) / sd).otherwise(0.0)


def z_by_sample(layer: Layer) -> DataFrame:
    """W12 by sample: statistics by aggregate and join, as a sample holds every feature."""
    stats = layer.cells.groupBy("sample_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return layer.cells.join(layer.per_sample(stats), "sample_id").select(
        "feature_id", "sample_id",
        F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z"),
    )


def safe_z(df: DataFrame, col: str, out: str = "z_score") -> DataFrame:
    """W11 over a whole table: sd 0 or undefined gives 0."""
    one = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).alias("ms"))
    ms = one.scalar()
    return df.withColumn("_ms", ms).withColumn(
        out, F.when(F.col("_ms.s") > 0, (F.col(col) - F.col("_ms.m")) / F.col("_ms.s")).otherwise(0.0)
    ).drop("_ms")


def top_by_variance(layer: Layer, n: int) -> DataFrame:
    """The n most variable features; undefined variance last, ties by id."""
    return layer.features.select("feature_id").join(row_moments(layer), "feature_id", "left").orderBy(
        F.col("row_var").desc_nulls_last(), "feature_id"
    ).limit(n)


def strongest_per_symbol(layer: Layer) -> DataFrame:
    """Per symbol the feature with the highest mean."""
    means = layer.cells.groupBy("feature_id").agg(F.avg("value").alias("row_mean"))
    best = layer.features.join(means, "feature_id").groupBy("feature_symbol").agg(
        F.min(F.struct((-F.col("row_mean")).alias("neg"), "feature_id")).alias("b")
    )
    return best.select("feature_symbol", F.col("b.feature_id").alias("feature_id"), (-F.col("b.neg")).alias("row_mean"))


def pair_numeric(df: DataFrame, col: str) -> DataFrame:
    """rows whose text is neither blank nor a number."""
    t = F.trim(F.col(col))
    return df.where((t != "") & t.try_cast("double").isNull())


def candidate_groups(samples: DataFrame, cols: list[str], hints=(), nuisance=()) -> DataFrame:
    """Metadata columns usable as groups, best first.

    At least two levels of two samples each; a numeric column only with up to six levels.
    """
    long = samples.select("sample_id", *[F.trim(F.col(c).cast("string")).alias(c) for c in cols]).unpivot(
        "sample_id", cols, "column_name", "level").where("level is not null and level <> ''")
    levels = long.groupBy("column_name", "level").agg(F.count("*").alias("n"))
    per = levels.groupBy("column_name").agg(
        F.count("*").alias("n_levels"), F.min("n").alias("smallest"),
        F.min(F.col("level").try_cast("double").isNotNull()).alias("numeric"),
    )
    rank = F.when(F.lower("column_name").isin(*hints) if hints else F.lit(False), 0).when(
        F.lower("column_name").isin(*nuisance) if nuisance else F.lit(False), 2).otherwise(1)
    return per.where((F.col("n_levels") >= 2) & (F.col("smallest") >= 2) & (~F.col("numeric") | (F.col("n_levels") <= 6))
                     ).select("column_name", "n_levels", "smallest", rank.alias("preference")).orderBy(
        "preference", "n_levels", "column_name")


def candidate_pairs(samples: DataFrame, cols: list[str], group_col: str) -> DataFrame:
    """Columns usable as pairing blocks: repeated, fewer than samples, half spanning two groups."""
    long = samples.select("sample_id", F.col(group_col).alias("grp"), *[F.col(c).cast("string").alias(c) for c in cols]
                          ).unpivot(["sample_id", "grp"], cols, "column_name", "block").where("block is not null")
    blocks = long.groupBy("column_name", "block").agg(
        F.count("*").alias("n"), F.count_distinct("grp").alias("n_groups"))
    return blocks.groupBy("column_name").agg(
        F.count("*").alias("n_blocks"), F.sum("n").alias("n_rows"), F.min("n").alias("smallest"),
        F.avg((F.col("n_groups") >= 2).cast("double")).alias("spanning"),
    ).where((F.col("smallest") >= 2) & (F.col("n_blocks") < F.col("n_rows")) & (F.col("spanning") >= 0.5))
