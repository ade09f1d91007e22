"""Quality-control reports, outlier tests and the cleaning pipeline."""

from __future__ import annotations

import math

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.functions.ordering import spread_quantiles
from assaygrid.model import Layer
from assaygrid.operators import cells as C
from assaygrid.operators import gram as G
from assaygrid.operators import impute as I
from assaygrid.operators.normalize import analysis_scale
from assaygrid.session import cut

# Fixed values of the leave-one-out test.
LOO_MIN_SPREAD = 0.17
LOO_MIN_SAMPLES = 4


def missingness(layer: Layer, feature_cutoff: float = 0.5, sample_cutoff: float | None = None,
                rule: str = "global", group_col: str | None = None) -> dict[str, DataFrame]:
    """Q1: sample and feature missing rates with flags strictly above the cutoffs."""
    samples = C.sample_missing(layer)
    flag_s = (F.col("missing_rate") > sample_cutoff) if sample_cutoff is not None else F.lit(False)
    features = C.feature_missing(layer)
    if rule == "global":
        features = features.withColumn("filter_missing_rate", F.col("missing_rate"))
    else:
        pick = {"any_group": F.min, "all_groups": F.max}[rule]
        by = C.group_missing(layer, group_col or layer.group_col).groupBy("feature_id").agg(
            pick("missing_rate").alias("filter_missing_rate"))
        features = features.join(by, "feature_id")
    return {
        "samples": samples.withColumn("flagged", flag_s),
        "features": features.withColumn("flagged", F.col("filter_missing_rate") > feature_cutoff),
    }


def depth(layer: Layer) -> DataFrame:
    """Q2/A3: library size, features detected, ratio to the median library."""
    v = F.col("value")
    per = layer.cells.groupBy("sample_id").agg(
        F.sum(F.pow(F.lit(2.0), v) if layer.is_log else v).alias("lib"),
        F.sum((F.lit(True) if layer.is_log else v > 0).cast("long")).alias("n_detected"),
    )
    per = layer.samples.select("sample_id").join(per, "sample_id", "left").select(
        "sample_id", F.coalesce("lib", F.lit(0.0)).alias("library_size"),
        F.coalesce("n_detected", F.lit(0)).alias("n_detected"))
    med = per.agg(F.percentile("library_size", 0.5)).scalar()
    return per.withColumn("_med", med).select(
        "sample_id", "library_size", "n_detected", (F.col("n_detected") / layer.n_features()).alias("detection_rate"),
        F.when(F.col("_med") > 0, F.col("library_size") / F.col("_med")).alias("library_size_ratio"),
    )


def depth_outliers(report: DataFrame, ratio: float = 0.3) -> DataFrame:
    """P8."""
    return report.where(F.col("library_size_ratio") < ratio)


def iqr_outliers(layer: Layer, k: float = 1.5) -> DataFrame:
    """Q5: sample means outside the quartile fences."""
    means = layer.samples.select("sample_id").join(
        layer.cells.groupBy("sample_id").agg(F.avg("value").alias("mean_signal")), "sample_id", "left")
    q = means.agg(F.percentile("mean_signal", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).scalar()
    spread = F.col("_q")[1] - F.col("_q")[0]
    return means.withColumn("_q", q).select(
        "sample_id", "mean_signal", (F.col("_q")[0] - k * spread).alias("lower_fence"),
        (F.col("_q")[1] + k * spread).alias("upper_fence"),
    ).withColumn("is_outlier", F.coalesce(
        (F.col("mean_signal") < F.col("lower_fence")) | (F.col("mean_signal") > F.col("upper_fence")), F.lit(False)))


def nearest_two(layer: Layer) -> DataFrame:
    """Per sample its two nearest neighbours on the log correlation distance."""
    d = 0.5 * F.log(F.greatest(1 - F.col("r"), F.lit(1e-12)))
    pairs = G.sample_correlation(layer).where("sample_a <> sample_b").select(
        "sample_a", "sample_b", F.round(F.coalesce(d, F.lit(float("inf"))), 10).alias("d"))
    w = W.partitionBy("sample_a").orderBy("d", "sample_b")
    return pairs.withColumn("place", F.row_number().over(w)).where("place <= 2").groupBy("sample_a").agg(
        F.max(F.when(F.col("place") == 1, F.col("sample_b"))).alias("nearest_sample"),
        F.max(F.when(F.col("place") == 1, F.col("d"))).alias("nn1"),
        F.max(F.when(F.col("place") == 2, F.col("d"))).alias("nn2"),
    ).withColumnRenamed("sample_a", "sample_id")


def loo_outliers(layer: Layer, sd: float = 3.0) -> DataFrame:
    """Q8: nearest-neighbour distance against the others' nearest distances without this sample.

    Leaving a sample out replaces the nearest distance of exactly those samples whose nearest
    neighbour it was. The distances form one array with a row per sample, so the sample axis
    bounds the work; the array is read by every sample as a scalar.
    """
    near = nearest_two(layer)
    all_near = near.agg(F.collect_list(F.struct("sample_id", "nearest_sample", "nn1", "nn2"))).scalar()
    inf = F.lit(float("inf"))
    me = near.withColumn("_all", all_near)
    others = F.filter(
        F.transform(F.filter("_all", lambda o: o["sample_id"] != F.col("sample_id")),
                    lambda o: F.when(o["nearest_sample"] == F.col("sample_id"), o["nn2"]).otherwise(o["nn1"])),
        lambda x: x < inf)
    me = me.withColumn("others", F.array_sort(others)).drop("_all")
    median = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int"))
                        + F.element_at(a, F.ceil((F.size(a) + 1) / 2).cast("int"))) / 2
    ok = (F.size("others") >= LOO_MIN_SAMPLES - 1) & (F.col("nn1") < inf)
    me = me.withColumn("ref", F.when(ok, median(F.col("others"))))
    me = me.withColumn("dev", F.array_sort(F.transform("others", lambda x: F.abs(x - F.col("ref")))))
    me = me.withColumn("spread", F.when(ok, F.greatest(1.4826 * median(F.col("dev")), F.lit(LOO_MIN_SPREAD))))
    z = (F.col("nn1") - F.col("ref")) / F.col("spread")
    cor = lambda c: 1 - F.exp(2 * F.col(c))
    return me.select(
        "sample_id", F.when(F.col("nn1") < inf, F.col("nearest_sample")).alias("nearest_sample"),
        F.when(F.col("nn1") < inf, cor("nn1")).alias("nearest_correlation"),
        cor("ref").alias("reference_correlation"), z.alias("z_score"),
        F.coalesce(z > sd, F.lit(False)).alias("is_outlier"),
    )


OUTLIER_TESTS = {
    "pca": G.pca_outliers, "connectivity": G.connectivity, "iqr": iqr_outliers, "loo": loo_outliers,
}


def outliers(layer: Layer, methods=("connectivity", "iqr"), thresholds: dict | None = None) -> DataFrame:
    """Q9/U4: (method, sample_id, score, is_outlier) stacked over the methods."""
    thresholds = thresholds or {}
    score = {"pca": F.greatest(F.abs("z_pc1"), F.abs("z_pc2")), "connectivity": F.col("z_score"),
             "iqr": F.col("mean_signal"), "loo": F.col("z_score")}
    out = None
    for m in methods:
        t = OUTLIER_TESTS[m](layer, *([thresholds[m]] if m in thresholds else []))
        t = t.select(F.lit(m).alias("method"), "sample_id", score[m].alias("score"), "is_outlier")
        out = t if out is None else out.unionByName(t)
    return out


def z_ceiling(layer: Layer) -> DataFrame:
    """The largest z any sample can reach, (n - 1) / sqrt(n)."""
    return layer.samples.agg(((F.count("*") - 1) / F.sqrt(F.count("*").cast("double"))).alias("z_ceiling"))


@dataclass(frozen=True)
class QcRecord:
    """Q11: what cleaning did: ids kept, imputed cells and a fingerprint of the input."""

    kept_samples: DataFrame
    kept_features: DataFrame
    imputed: DataFrame
    fingerprint: DataFrame


def fingerprint(layer: Layer) -> DataFrame:
    """Order-free content hash of the cells: count and a wrapping sum of row hashes."""
    return layer.cells.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("feature_id", "sample_id", "value").cast("decimal(38,0)")).cast("string").alias("hash"),
    )


def default_impute(layer: Layer) -> str:
    return "MinProb" if layer.omics_type == "proteomics" else "none"


def run_qc(layer: Layer, feature_cutoff: float = 0.5, sample_cutoff: float | None = None, rule: str = "global",
           group_col: str | None = None, outlier_methods=("connectivity", "iqr"), drop_outliers: bool = False,
           min_depth_ratio: float | None = None, impute: str | None = None, seed: int = 1234):
    """Q10: missingness, depth, outliers, dropping and imputation. Returns (clean layer, reports, record).

    Linear layers are imputed on log2 with values up to 0 treated as missing; only absent cells
    are filled, and the filled values return to the linear scale.
    """
    reports = missingness(layer, feature_cutoff, sample_cutoff, rule, group_col)
    reports["depth"] = depth(layer)
    reports["outliers"] = outliers(analysis_scale(layer), outlier_methods)
    drop = reports["samples"].where("flagged").select("sample_id")
    if min_depth_ratio is not None:
        drop = drop.union(depth_outliers(reports["depth"], min_depth_ratio).select("sample_id"))
    if drop_outliers:
        drop = drop.union(reports["outliers"].where("is_outlier").select("sample_id"))
    keep_s = layer.samples.select("sample_id").join(drop.distinct(), "sample_id", "left_anti")
    keep_f = reports["features"].where("not flagged").select("feature_id")
    small = C.keep_features(C.keep_samples(layer, keep_s), keep_f)
    method = impute or default_impute(layer)
    if method == "none":
        filled = small.cells.limit(0)
    elif small.is_log:
        filled = I.impute(small, method, seed)
    else:
        logged = small.with_cells(
            small.cells.where("value > 0").withColumn("value", F.log2("value")), "normalized_intensity")
        filled = I.impute(logged, method, seed).withColumn("value", F.pow(F.lit(2.0), F.col("value")))
        filled = filled.join(small.cells, ["feature_id", "sample_id"], "left_anti")
    record = QcRecord(keep_s, keep_f, filled, fingerprint(layer))
    return replay(layer, record), reports, record


def replay(layer: Layer, record: QcRecord, check: bool = False) -> Layer:
    """Q11: the cleaned layer from its record; `check` compares the input's fingerprint first."""
    if check and fingerprint(layer).first() != record.fingerprint.first():
        raise ValueError("the record belongs to another input")
    small = C.keep_features(C.keep_samples(layer, record.kept_samples), record.kept_features)
    label = small.assay_type
    return small.with_cells(small.cells.unionByName(record.imputed), label)


def observed_imputed_curves(observed: DataFrame, filled: DataFrame) -> DataFrame:
    """Q24: quantile sketches (1,001 points) of observed and imputed values, which are read several times and so written once first."""
    tag = lambda df, s: df.select(F.lit(s).alias("source"), "value")
    both = cut(tag(observed, "observed").unionByName(tag(filled, "imputed")), "curves")
    return spread_quantiles(both, ["source"], "value", 1001, few=True)


def density_curves(df: DataFrame, keys: list[str], points: int = 512) -> DataFrame:
    """Kernel densities (keys, i, x, density, n, bandwidth) of the values of each group on one grid over the range of all groups.

    Every value shares its weight of one between the two grid points around it, in one aggregate of at most `points` rows a group; the Gaussian kernel
    then runs over these bins. Groups with one value, or none that differ, have no bandwidth and density NULL. `keys` name few groups.
    The values are read several times, so they are written once first.
    """
    df = cut(df.select(*keys, "value"), "density")
    ends = df.agg(F.min("value").alias("low"), F.max("value").alias("high")).select(F.struct("low", "high")).scalar()
    step = (F.col("_e.high") - F.col("_e.low")) / F.lit(float(points - 1))
    spot = F.when(step > 0, (F.col("value") - F.col("_e.low")) / step).otherwise(F.lit(0.0))
    base = F.least(F.floor(spot), F.lit(points - 2)).cast("int")
    placed = df.select(*keys, "value", ends.alias("_e")).select(*keys, base.alias("b"), (spot - base).alias("part"))
    bins = placed.groupBy(*keys, "b").agg(F.count("*").cast("double").alias("c"), F.sum("part").alias("p")).select(
        *keys, F.explode(F.array(F.struct(F.col("b").alias("i"), (F.col("c") - F.col("p")).alias("w")),
                                 F.struct((F.col("b") + 1).alias("i"), F.col("p").alias("w")))).alias("h"))
    bins = bins.groupBy(*keys, "h.i").agg(F.sum("h.w").alias("w")).groupBy(*keys).agg(F.collect_list(F.struct("i", "w")).alias("bins"))
    width = bandwidths(df, keys).select(*keys, "n", F.when(F.col("bandwidth") > 0, F.col("bandwidth")).alias("bandwidth"))
    grid = bins.join(width, keys).withColumn("_e", ends).select(
        *keys, "bins", "n", "bandwidth", "_e", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    scale = F.col("step") / F.col("bandwidth")
    kernel = lambda z: F.exp(-z * z / 2)
    total = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["w"] * kernel((F.col("i") - b["i"]) * scale))
    return grid.select(*keys, "i", (F.col("_e.low") + F.col("i") * F.col("step")).alias("x"),
                       (total / (F.col("n") * F.col("bandwidth") * F.lit((2 * math.pi) ** 0.5))).alias("density"), "n", "bandwidth")


def observed_imputed_density(observed: DataFrame, filled: DataFrame, points: int = 512) -> DataFrame:
    """Q24: density curves of observed and imputed values on one grid."""
    tag = lambda df, s: df.select(F.lit(s).alias("source"), "value")
    return density_curves(tag(observed, "observed").unionByName(tag(filled, "imputed")), ["source"], points)


def bandwidths(df: DataFrame, keys: list[str]) -> DataFrame:
    """Silverman's bandwidth of each group's values from exact quartiles. `keys` name few groups, so a group's rows are dealt to no single task."""
    from assaygrid.functions.ordering import exact_quantiles

    q = exact_quantiles(df, keys, "value", [0.25, 0.75], ["q1", "q3"], few=True)
    sd = df.groupBy(*keys).agg(F.stddev_samp("value").alias("sd"))
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    low = F.least(F.col("sd"), F.when(iqr > 0, iqr).otherwise(F.col("sd")))
    return q.join(sd, keys).select(*keys, "n", (0.9 * low * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"))
