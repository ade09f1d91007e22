"""Data model: a layer is three DataFrames, a project is layers plus links."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scale vocabulary (fixed values).
ASSAY_TYPES = {
    "proteomics": ("raw_intensity", "normalized_intensity", "imputed_intensity", "filtered_intensity"),
    "rnaseq": ("raw_count", "tpm", "fpkm", "vst", "logcpm"),
}
LOG_SCALE = ("normalized_intensity", "imputed_intensity", "filtered_intensity", "vst", "logcpm")
OLD_SPELLINGS = {"intensity": "raw_intensity", "raw_counts": "raw_count"}

# A per-sample table is broadcast only when it has at most this many rows.
MAX_BROADCAST_SAMPLES = 200_000

_D, _S, _B = T.DoubleType(), T.StringType(), T.BooleanType()

DIFF_COLUMNS = (
    ("feature_id", _S), ("feature_symbol", _S), ("feature_type", _S), ("omics_type", _S),
    ("method", _S), ("analysis_type", _S), ("comparison", _S), ("effect", _D),
    ("effect_type", _S), ("statistic", _D), ("statistic_type", _S), ("signed_stat", _D),
    ("p_value", _D), ("adj_p_value", _D), ("direction", _S), ("base_mean", _D),
    ("model_fit", _D), ("is_significant", _B),
)
ENRICH_COLUMNS = (
    ("database", _S), ("result_type", _S), ("comparison", _S), ("pathway_id", _S),
    ("pathway_name", _S), ("effect", _D), ("effect_type", _S), ("direction", _S),
    ("p_value", _D), ("adj_p_value", _D), ("q_value", _D), ("gene_set_size", _D),
    ("overlap_size", _D), ("overlap_features", _S), ("leading_features", _S), ("source_label", _S),
)
INTEGRATION_COLUMNS = (
    ("feature_id", _S), ("feature_symbol", _S), ("result_type", _S), ("experiments", _S),
    ("comparison", _S), ("effect", _D), ("effect_type", _S), ("statistic", _D),
    ("statistic_type", _S), ("p_value", _D), ("adj_p_value", _D), ("direction", _S),
    ("quadrant", _S), ("is_significant", _B), ("source_label", _S),
)


def conform(df: DataFrame, columns) -> DataFrame:
    """Fixed result schema: missing columns become typed NULLs, extra columns follow."""
    named = [c for c, _ in columns]
    have = set(df.columns)
    fixed = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns]
    return df.select(*fixed, *[F.col(c) for c in df.columns if c not in named])


def missing_columns(df: DataFrame, columns) -> list[str]:
    """Names a result schema requires and `df` lacks."""
    return [c for c, _ in columns if c not in df.columns]


def canonical_assay(label: str) -> str:
    return OLD_SPELLINGS.get(label, label)


@dataclass(frozen=True)
class Layer:
    """cells(feature_id, sample_id, value), samples(sample_id, ...), features(feature_id, ...)."""

    cells: DataFrame
    samples: DataFrame
    features: DataFrame
    omics_type: str
    assay_type: str
    group_col: str | None = None
    reference: str | None = None
    _counted: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def is_log(self) -> bool:
        return self.assay_type in LOG_SCALE

    def with_cells(self, cells: DataFrame, assay_type: str | None = None) -> "Layer":
        return replace(self, cells=cells, assay_type=assay_type or self.assay_type)

    def sample_count(self) -> int:
        if "samples" not in self._counted:
            self._counted["samples"] = self.samples.count()
        return self._counted["samples"]

    def few_samples(self) -> bool:
        return self.sample_count() <= MAX_BROADCAST_SAMPLES

    def per_sample(self, df: DataFrame) -> DataFrame:
        """Mark a table with one row per sample for broadcast when its size is known to be small."""
        return F.broadcast(df) if self.few_samples() else df

    def n_samples(self) -> Column:
        """Number of samples as a scalar subquery."""
        return self.samples.agg(F.count("*").cast("double")).scalar()

    def n_features(self) -> Column:
        return self.features.agg(F.count("*").cast("double")).scalar()


@dataclass(frozen=True)
class Project:
    layers: dict
    sample_link: DataFrame | None = None
    feature_link: DataFrame | None = None


@dataclass(frozen=True)
class Result:
    name: str
    tables: dict
    params: dict
    warnings: tuple = ()


def make_layer(cells, samples, features, omics_type, assay_type, group_col=None, reference=None) -> Layer:
    """M1: canonical scale label, NaN and infinite cells absent, symbol and type defaults filled."""
    from assaygrid.functions.scalar import blank_to_null, finite_or_null

    assay = canonical_assay(assay_type)
    cells = cells.select("feature_id", "sample_id", finite_or_null(F.col("value").cast("double")).alias("value"))
    symbol = blank_to_null(F.col("feature_symbol")) if "feature_symbol" in features.columns else F.lit(None)
    ftype = F.col("feature_type") if "feature_type" in features.columns else F.lit(None)
    features = features.withColumns(
        {
            "feature_symbol": F.coalesce(symbol, F.col("feature_id")),
            "feature_type": F.coalesce(ftype, F.lit("feature")),
        }
    )
    return Layer(cells.where("value is not null"), samples, features, omics_type, assay, group_col, reference)


def violations(layer: Layer) -> DataFrame:
    """M2: rows of (rule, id) that break the layer contract; empty when valid."""
    def rule(df, name, col):
        return df.select(F.lit(name).alias("rule"), F.col(col).cast("string").alias("id"))

    dup = lambda df, c: df.groupBy(c).count().where("count > 1")
    cells = layer.cells
    used_samples = cells.select("sample_id").distinct()
    used_features = cells.select("feature_id").distinct()
    parts = [
        rule(dup(layer.samples, "sample_id"), "duplicate_sample", "sample_id"),
        rule(dup(layer.features, "feature_id"), "duplicate_feature", "feature_id"),
        rule(used_samples.join(layer.samples, "sample_id", "left_anti"), "cell_without_sample", "sample_id"),
        rule(used_features.join(layer.features, "feature_id", "left_anti"), "cell_without_feature", "feature_id"),
        rule(layer.samples.join(used_samples, "sample_id", "left_anti"), "sample_without_cell", "sample_id"),
        rule(layer.features.join(used_features, "feature_id", "left_anti"), "feature_without_cell", "feature_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def infer_assay(layer: Layer) -> DataFrame:
    """M3: one row with the guessed scale label of the layer's values."""
    per_sample = layer.cells.groupBy("sample_id").agg(
        F.sum("value").alias("lib"), F.max("value").alias("hi"), F.min("value").alias("lo"),
        F.max((F.col("value") != F.floor("value")).cast("int")).alias("frac"),
    )
    one = per_sample.agg(
        F.max("hi").alias("max_value"), F.min("lo").alias("min_value"), F.max("frac").alias("any_fraction"),
        F.min("lib").alias("lib_min"), F.max("lib").alias("lib_max"), F.percentile("lib", 0.5).alias("lib_median"),
    )
    c = F.col
    rna = (
        F.when(c("min_value") < 0, "logcpm")
        .when(c("any_fraction") == 0, "raw_count")
        .when(c("max_value") < 30, "logcpm")
        .when((c("lib_min") >= 8e5) & (c("lib_max") <= 1.01e6) & (c("lib_max") / c("lib_min") <= 1.2), "tpm")
        .when(c("lib_median") >= 2e6, "raw_count")
        .otherwise("fpkm")
    )
    prot = F.when(c("max_value") > 100, "raw_intensity").otherwise("normalized_intensity")
    return one.select("max_value", "min_value", prot.alias("proteomics_guess"), rna.alias("rnaseq_guess"))


def scale_check(layer: Layer) -> DataFrame:
    """M4: does the largest value contradict the scale label?"""
    intensity = layer.assay_type.endswith("intensity")
    bad = (F.col("max_value") > 100) if layer.is_log else (F.col("max_value") <= 100)
    return layer.cells.agg(F.max("value").alias("max_value")).select(
        F.lit(layer.assay_type).alias("assay_type"), "max_value",
        (bad & F.lit(intensity)).alias("scale_mismatch"),
    )


def summarize(layers: dict) -> DataFrame:
    """M5: one summary row per layer."""
    out = None
    for tag, layer in layers.items():
        seen = layer.cells.agg(F.count("*").cast("double").alias("n_seen"))
        total = F.col("n_features") * F.col("n_samples")
        row = seen.select(
            F.lit(tag).alias("tag"), F.lit(layer.omics_type).alias("omics_type"),
            F.lit(layer.assay_type).alias("assay_type"),
            layer.n_samples().alias("n_samples"), layer.n_features().alias("n_features"), "n_seen",
        ).select(
            "tag", "omics_type", "assay_type", "n_samples", "n_features",
            (total - F.col("n_seen")).alias("n_missing"),
            F.round(100 * (total - F.col("n_seen")) / total, 3).alias("missing_pct"),
            F.lit(len(layer.samples.columns) - 1).alias("n_meta_cols"),
            F.lit(", ".join(layer.features.columns)).alias("feature_columns"),
        )
        out = row if out is None else out.unionByName(row)
    return out
