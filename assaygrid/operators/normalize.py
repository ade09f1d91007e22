"""Scale changes: log2, median centring, counts per million, trimmed-mean factors, size factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.ordering import exact_quantiles, order_stats
from assaygrid.model import Layer
from assaygrid.session import cut


def library_sizes(layer: Layer) -> DataFrame:
    """A4: column sums over the whole layer."""
    return layer.cells.groupBy("sample_id").agg(F.sum("value").alias("lib"))


def log2_layer(layer: Layer, offset: float = 1.0) -> Layer:
    """Q25: zeros and negatives become missing, the rest log2(x + offset)."""
    if layer.is_log or layer.omics_type == "rnaseq":
        raise ValueError("log2 normalisation applies to linear intensity layers only")
    cells = layer.cells.where("value > 0").withColumn("value", F.log2(F.col("value") + offset))
    return layer.with_cells(cells, "normalized_intensity")


def median_shift(layer: Layer) -> DataFrame:
    """Per sample its median minus the median of the medians."""
    med = exact_quantiles(layer.cells, ["sample_id"], "value", [0.5], ["med"], layer.few_samples())
    return med.select("sample_id", "med", (F.col("med") - med.agg(F.percentile("med", 0.5)).scalar()).alias("shift"))


def median_center(layer: Layer) -> Layer:
    """Q26: the layer with every sample moved to the common median."""
    moved = layer.cells.join(layer.per_sample(median_shift(layer)), "sample_id").select(
        "feature_id", "sample_id", (F.col("value") - F.col("shift")).alias("value"))
    return layer.with_cells(moved)


def tmm_factors(layer: Layer, trim_ratio: float = 0.3, trim_sum: float = 0.05, cutoff: float = -1e10) -> DataFrame:
    """Q28: trimmed mean of M-values per sample against the reference sample.

    Published defaults: the reference is the sample whose upper-quartile-to-library ratio is
    closest to the mean, ratios are trimmed by 30 % and abundances by 5 % on either side.
    Upper quartiles count zero cells, so they come from the rank of the full feature axis.
    """
    alive = cut(layer.cells.where("value > 0"), "tmm-cells")
    few = layer.few_samples()
    sums = alive.groupBy("sample_id").agg(
        F.sum("value").alias("lib"), F.sum(F.sqrt("value")).alias("root"), F.count("*").alias("n_pos"))
    libs = cut(layer.samples.select("sample_id").join(sums, "sample_id", "left").fillna(0), "tmm-libs")
    n_live = alive.select("feature_id").distinct().count()
    # Type-7 0.75 quantile over features with zeros in front: the ranks shift by the zero count.
    h = F.lit((n_live - 1) * 0.75)
    zeros = F.lit(n_live) - F.col("n")
    spot = lambda r: F.greatest(r.cast("long") - zeros.cast("long"), F.lit(0))
    q = order_stats(alive, ["sample_id"], "value", [(0.5, spot(F.floor(h))), (0.5, spot(F.ceil(h)))], few)
    val = lambda i, r: F.when(r.cast("long") < zeros, 0.0).otherwise(F.col("os")[i]["value"])
    lo, hi = val(0, F.floor(h)), val(1, F.ceil(h))
    quart = q.select("sample_id", (lo + (h - F.floor(h)) * (hi - lo)).alias("q75"))
    f75 = libs.join(quart, "sample_id").where("lib > 0").withColumn("f75", F.col("q75") / F.col("lib"))
    f75 = cut(f75, "tmm-quartiles")
    center = f75.agg(F.avg("f75").alias("mean"), F.percentile("f75", 0.5).alias("med")).first()
    # With an (almost) empty upper quartile the deepest sample by square roots is the reference.
    gap = -F.col("root") if center.med < 1e-20 else F.abs(F.col("f75") - center.mean)
    ref = f75.orderBy(F.round(gap, 10), "sample_id").select("sample_id", "lib").first()
    ref_cells = alive.where(F.col("sample_id") == ref.sample_id).select("feature_id", F.col("value").alias("ref_value"))
    lib_r = float(ref.lib)
    rows = (
        alive.join(ref_cells, "feature_id").join(layer.per_sample(libs), "sample_id")
        .select(
            "feature_id", "sample_id",
            F.round(F.log2((F.col("value") / F.col("lib")) / (F.col("ref_value") / lib_r)), 10).alias("m"),
            F.round((F.log2(F.col("value") / F.col("lib")) + F.log2(F.col("ref_value") / lib_r)) / 2, 10).alias("a"),
            ((F.col("lib") - F.col("value")) / F.col("lib") / F.col("value")
             + (lib_r - F.col("ref_value")) / lib_r / F.col("ref_value")).alias("v"),
        )
        .where(F.col("a") > cutoff)
    )
    rows = cut(rows, "tmm-rows")
    kept = rows
    for col, trim in (("m", trim_ratio), ("a", trim_sum)):
        low_r = F.floor(F.col("n") * F.lit(trim))
        ends = order_stats(rows, ["sample_id"], col, [(trim, low_r), (1 - trim, F.col("n") - 1 - low_r)],
                           layer.few_samples())
        ends = ends.select(
            "sample_id", (F.floor(F.col("n") * F.lit(trim)) + 1).alias(f"{col}_lo"),
            (F.col("n") - F.floor(F.col("n") * F.lit(trim))).alias(f"{col}_hi"),
            F.col("os")[0].alias(f"{col}_0"), F.col("os")[1].alias(f"{col}_1"),
        )
        mid = lambda s: F.col(f"{s}.below") + (F.col(f"{s}.ties") + 1) / 2
        x = F.col(col)
        kept = kept.join(layer.per_sample(ends), "sample_id").where(
            ((x > F.col(f"{col}_0.value")) | ((x == F.col(f"{col}_0.value")) & (mid(f"{col}_0") >= F.col(f"{col}_lo"))))
            & ((x < F.col(f"{col}_1.value")) | ((x == F.col(f"{col}_1.value")) & (mid(f"{col}_1") <= F.col(f"{col}_hi"))))
        )
    ratio = kept.groupBy("sample_id").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("lr"))
    spread = rows.groupBy("sample_id").agg(F.max(F.abs("m")).alias("max_m"))
    raw = libs.join(ratio, "sample_id", "left").join(spread, "sample_id", "left").select(
        "sample_id", "lib",
        F.when((F.col("max_m") < 1e-6) | F.col("lr").isNull(), 0.0).otherwise(F.col("lr")).alias("lr"),
    )
    center = raw.agg(F.avg("lr")).scalar()
    return raw.select("sample_id", "lib", F.pow(F.lit(2.0), F.col("lr") - center).alias("norm_factor"))


def size_factors(layer: Layer) -> DataFrame:
    """Median of the ratios to the geometric mean over features without a zero.

    The means are written first, for the last bits of an average may differ when it is read again.
    """
    logs = layer.cells.where("value > 0").select("feature_id", "sample_id", F.log("value").alias("lv"))
    full = cut(logs.groupBy("feature_id").agg(F.avg("lv").alias("lg"), F.count("*").alias("n")).where(
        F.col("n") == layer.n_samples()), "log-means")
    ratios = logs.join(full, "feature_id").select("sample_id", (F.col("lv") - F.col("lg")).alias("d"))
    return exact_quantiles(ratios, ["sample_id"], "d", [0.5], ["med"], layer.few_samples()).select(
        "sample_id", F.exp("med").alias("size_factor"))


def analysis_scale(layer: Layer, factors: DataFrame | None = None) -> Layer:
    """Q29: the log scale of the continuous engines. `factors(sample_id, lib, norm_factor)` for counts."""
    v = F.col("value")
    if layer.assay_type == "raw_count":
        per = factors if factors is not None else library_sizes(layer).withColumn("norm_factor", F.lit(1.0))
        cells = layer.cells.join(layer.per_sample(per), "sample_id").select(
            "feature_id", "sample_id",
            F.log2((v + 0.5) / ((F.col("lib") * F.col("norm_factor") + 1) / 1e6)).alias("value"))
        return layer.with_cells(cells, "logcpm")
    if layer.assay_type in ("raw_intensity", "tpm", "fpkm"):
        label = "normalized_intensity" if layer.assay_type == "raw_intensity" else "logcpm"
        return layer.with_cells(layer.cells.withColumn("value", F.log2(F.greatest(v, F.lit(0.0)) + 1)), label)
    return layer


def display_scale(layer: Layer) -> Layer:
    """Q30: the log scale of integration and heat maps: counts as log2(CPM + 1) over whole libraries."""
    if layer.assay_type == "raw_count":
        cells = layer.cells.join(layer.per_sample(library_sizes(layer)), "sample_id").select(
            "feature_id", "sample_id", F.log2(F.col("value") / F.col("lib") * 1e6 + 1).alias("value"))
        return layer.with_cells(cells, "logcpm")
    return analysis_scale(layer)


def winsorize(layer: Layer, k: float = 20.0, min_expressed: int = 3, legacy: bool = False):
    """Q12: counts above Q3 + k IQR are set to the bound. Returns (layer, per-feature statistics).

    Quartiles are over the non-zero values of a feature, at most one per sample; the legacy rule
    uses all cells and an unrounded bound.
    """
    v = F.col("value")
    base = layer.cells if legacy else layer.cells.where("value > 0")
    q = base.groupBy("feature_id").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
                                       F.sum((v > 0).cast("int")).alias("n_nonzero"))
    q = q.select("feature_id", "n_nonzero", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"),
                 (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    ok = F.lit(True) if legacy else (F.col("n_nonzero") >= min_expressed) & (F.col("iqr") > 0)
    bound = F.when(ok, F.col("q3") + k * F.col("iqr"))
    q = q.withColumns({"winsorized": ok, "threshold": bound, "cap": bound if legacy else F.floor(bound).cast("double")})
    joined = layer.cells.join(q, "feature_id", "left")
    high = F.coalesce(v > F.col("threshold"), F.lit(False))
    cells = joined.select("feature_id", "sample_id", F.when(high, F.col("cap")).otherwise(v).alias("value"))
    stats = joined.groupBy("feature_id").agg(
        F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.first("iqr").alias("iqr"),
        F.first("threshold").alias("threshold"), F.max("value").alias("max_original"),
        F.sum(high.cast("long")).alias("n_clipped"), F.coalesce(F.first("n_nonzero"), F.lit(0)).alias("n_nonzero"),
        F.coalesce(F.first("winsorized"), F.lit(False)).alias("winsorized"),
    )
    rounded = [F.round(c, 2).alias(c) for c in ("q1", "q3", "iqr", "threshold")]
    return layer.with_cells(cells), stats.select(
        "feature_id", *rounded, "max_original", "n_clipped", "n_nonzero", "winsorized")
