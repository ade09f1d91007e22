"""The standard result table: mapping, padding, filters, ranking, contrast summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.functions.scalar import direction_label
from assaygrid.model import DIFF_COLUMNS, Layer, conform


def pad_untested(layer: Layer, stats: DataFrame, comparisons: list[str]) -> DataFrame:
    """One row per feature and comparison, NULL statistics where nothing could be tested.

    A feature's rows are packed for the join, so that statistics already placed by feature are not shuffled again;
    the list of comparisons bounds them.
    """
    values = [f for f in stats.schema.fields if f.name not in ("feature_id", "comparison")]
    packed = stats.where(F.col("comparison").isin(comparisons)).groupBy("feature_id").agg(
        F.collect_list(F.struct("comparison", *[F.col(f.name) for f in values])).alias("_rows"))
    wanted = F.array(*[F.lit(c) for c in comparisons])
    untested = F.transform(
        F.array_except(wanted, F.coalesce(F.col("_rows.comparison"), F.slice(wanted, 1, 0))),
        lambda c: F.struct(c.alias("comparison"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in values]))
    rows = layer.features.select("feature_id", "feature_symbol", "feature_type").join(packed, "feature_id", "left")
    return rows.select("feature_id", "feature_symbol", "feature_type", F.inline(F.coalesce(F.concat("_rows", untested), untested))).select(
        "feature_id", "comparison", "feature_symbol", "feature_type", *[f.name for f in values])


def standard(df: DataFrame, layer: Layer, method: str, analysis: str, effect_type: str, statistic_type: str,
             direction: str) -> DataFrame:
    """The fixed columns; `df` brings effect, statistic, p_value, adj_p_value and optional extras."""
    return conform(df.withColumns({
        "omics_type": F.lit(layer.omics_type), "method": F.lit(method), "analysis_type": F.lit(analysis),
        "effect_type": F.lit(effect_type), "statistic_type": F.lit(statistic_type),
        "direction": direction_label(F.col("effect"), direction),
        "is_significant": F.lit(None).cast("boolean"),
    }), DIFF_COLUMNS).select(*[c for c, _ in DIFF_COLUMNS])


def p_column(preference: str) -> str:
    return {"adjusted": "adj_p_value", "raw": "p_value"}[preference]


def significance(p_cutoff: float = 0.05, preference: str = "adjusted", effect_cutoff: float | None = None,
                 fit_cutoff: float | None = None) -> Column:
    """The mask; a NULL anywhere is false."""
    ok = F.col(p_column(preference)) < p_cutoff
    if effect_cutoff is not None:
        ok = ok & (F.abs("effect") >= effect_cutoff)
    if fit_cutoff is not None:
        ok = ok & (F.col("model_fit") >= fit_cutoff)
    return F.coalesce(ok, F.lit(False))


def filter_results(df: DataFrame, *args, **kwargs) -> DataFrame:
    """P5: the rows that pass, marked significant."""
    return df.where(significance(*args, **kwargs)).withColumn("is_significant", F.lit(True))


def ranked_features(df: DataFrame, col: str = "effect", keys=("comparison",)) -> DataFrame:
    """Per feature its largest non-NULL value, sorted downwards."""
    best = df.where(F.col(col).isNotNull()).groupBy(*keys, "feature_id").agg(F.max(col).alias(col))
    return best.orderBy(*keys, F.col(col).desc(), "feature_id")


def contrast_summary(df: DataFrame, mask: Column) -> DataFrame:
    """Hits per comparison and how many are hits elsewhere too.

    A feature is shared when it is a hit in more than one comparison, which one count per feature
    tells without joining the table to itself.
    """
    hit = df.withColumn("hit", mask)
    per_feature = hit.where("hit").groupBy("feature_id").agg(F.count_distinct("comparison").alias("n_in"))
    hit = hit.join(per_feature, "feature_id", "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return hit.groupBy("comparison").agg(
        n(F.col("hit") & (F.col("effect") > 0)).alias("n_up"),
        n(F.col("hit") & (F.col("effect") < 0)).alias("n_down"),
        n(F.col("hit")).alias("n_hits"),
        F.count("p_value").alias("n_tested"),
        n(F.col("hit") & (F.col("n_in") > 1)).alias("n_shared"),
    )


def hit_combinations(df: DataFrame, mask: Column, top: int = 20) -> DataFrame:
    """Features per exact set of comparisons, the largest first, with the number of sets."""
    combos = df.where(mask).groupBy("feature_id").agg(F.array_sort(F.collect_set("comparison")).alias("combination"))
    sizes = combos.groupBy(F.array_join("combination", " & ").alias("combination"), F.size("combination").alias("n_comparisons")).agg(
        F.count("*").alias("n_features"))
    total = sizes.agg(F.count("*")).scalar()
    return sizes.withColumn("n_combinations", total).orderBy(F.col("n_features").desc(), "combination").limit(top)


def hit_sets(df: DataFrame, mask: Column, direction: str = "any") -> DataFrame:
    """A12 as rows (comparison, feature_id): a set may be as long as the feature axis."""
    side = {"any": F.lit(True), "up": F.col("effect") > 0, "down": F.col("effect") < 0}[direction]
    return df.where(mask & side).select("comparison", "feature_id").distinct()


def thin_points(df: DataFrame, keep: Column, grid=(250, 150), per_cell: int = 1, over: int = 5000) -> DataFrame:
    """Kept points plus the first points of each grid cell over (effect, -log10 p).

    Cells are spread over the whole picture, and only `per_cell` rows per task survive before the
    shuffle. Tables up to `over` rows stay whole.
    """
    x, y = F.col("x"), F.col("y")
    box = df.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                          F.count("*").alias("n"))).scalar()
    d = df.withColumn("_b", box)
    cell = lambda v, lo, hi, k: F.coalesce(F.least(F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * k), F.lit(k - 1)), F.lit(0))
    d = d.withColumns({
        "_keep": keep | (x == F.col("_b.x0")) | (x == F.col("_b.x1")) | (y == F.col("_b.y1")) | (F.col("_b.n") <= over),
        "_cx": cell(x, F.col("_b.x0"), F.col("_b.x1"), grid[0]), "_cy": cell(y, F.col("_b.y0"), F.col("_b.y1"), grid[1]),
    })
    w = W.partitionBy("_cx", "_cy").orderBy("feature_id")
    rest = d.where("not _keep").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_cell).drop("_r")
    return d.where("_keep").unionByName(rest).drop("_b", "_keep", "_cx", "_cy")


def shared_hits(df: DataFrame, hit: Column) -> DataFrame:
    """(feature_id, comparison) of the hits that are hits of another comparison too."""
    h = df.where(hit).select("feature_id", "comparison").distinct()
    more = h.groupBy("feature_id").agg(F.count("*").alias("k")).where("k > 1")
    return h.join(more, "feature_id", "left_semi")


def contrast_of_means(layer: Layer, contrasts: list[tuple[str, dict]], group_col: str | None = None) -> DataFrame:
    """(feature_id, comparison, effect), weighted sums of group means; a feature without a mean in one of a contrast's groups has no row."""
    group_col = group_col or layer.group_col
    rows = [(label, level, float(w), sum(x != 0 for x in weights.values())) for label, weights in contrasts for level, w in weights.items() if w]
    weights = layer.cells.sparkSession.createDataFrame(rows, "comparison string, _level string, _weight double, _need int")
    means = layer.cells.join(layer.per_sample(layer.samples.select("sample_id", F.col(group_col).alias("_level"))), "sample_id").groupBy(
        "feature_id", "_level").agg(F.avg("value").alias("_mean"))
    return means.join(F.broadcast(weights), "_level").groupBy("feature_id", "comparison").agg(
        F.sum(F.col("_mean") * F.col("_weight")).alias("effect"), F.count("*").alias("_n"), F.first("_need").alias("_need")).where(
        "_n = _need").drop("_n", "_need")
