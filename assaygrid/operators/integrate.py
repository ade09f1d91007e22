"""Integration of two layers: correlation, concordance and combined evidence per gene set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
import pandas as pd

from assaygrid.functions.ordering import adjust_p, cumulative, small_group_ranks
from assaygrid.functions.scalar import SMALLEST_DOUBLE, direction_sign, join_key, neg_log10, quadrant
from assaygrid.functions.tails import chisq_upper, gamma_upper, hyper_upper, t_two_sided
from assaygrid.model import INTEGRATION_COLUMNS, Layer, conform
from assaygrid.operators.diff.results import p_column
from assaygrid.operators.links import pair_ids, paired_cells
from assaygrid.operators.normalize import display_scale
from assaygrid.session import cut

MIN_SAMPLES = 4


def pair_correlations(cells: DataFrame, method: str = "spearman") -> DataFrame:
    """I1 core: r, n and t statistic per feature pair from J12 cells."""
    keys = ["feature_a", "feature_b"]
    if method == "spearman":
        cells = cells.withColumns({"x": small_group_ranks(keys, "x"), "y": small_group_ranks(keys, "y")})
    m = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                                 F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    r = F.when((F.col("n") >= MIN_SAMPLES) & (F.col("vx") > 1e-14 * F.col("mx") * F.col("mx")) & (F.col("vy") > 1e-14 * F.col("my") * F.col("my")),
               F.greatest(F.least(F.col("cxy") / F.sqrt(F.col("vx") * F.col("vy")), F.lit(1.0)), F.lit(-1.0)))
    # Correlations within rounding of zero are zero, so that the sign is not noise.
    m = m.select(*keys, "n", (F.round(r, 12) + 0.0).alias("r"))
    gap = 1 - F.col("r") * F.col("r")
    t = F.when(gap <= 1e-14, F.signum("r") * float("inf")).otherwise(F.col("r") * F.sqrt((F.col("n") - 2) / gap))
    return m.withColumn("t", t)


def run_correlation(a: Layer, b: Layer, feature_pairs: DataFrame, sample_pairs: DataFrame, method: str = "spearman",
                    p_cutoff: float = 0.05, adjust: str = "BH", tags=("a", "b")) -> DataFrame:
    """I1."""
    pairs = pair_ids(feature_pairs)
    stats = pair_correlations(paired_cells(display_scale(a), display_scale(b), feature_pairs, sample_pairs), method)
    n = F.col("n").cast("double")
    stats = stats.withColumn("p", t_two_sided(F.col("t"), n - 2))
    if method == "spearman":
        # Exact floor: no two-sided p below 2 / n!; past 18 samples it is under any double in play.
        stats = stats.withColumns({
            "p": F.greatest("p", F.when(n <= 18, 2 / F.factorial(F.least(F.col("n"), F.lit(18)).cast("int"))).otherwise(0.0)),
            "stat": (n * n * n - n) / 6 * (1 - F.col("r")),
        })
    else:
        stats = stats.withColumn("stat", F.col("t"))
    out = pairs.join(stats, ["feature_a", "feature_b"], "left").select(
        "feature_id", F.col("label").alias("feature_symbol"), F.col("feature_a").alias("feature_id_a"), F.col("feature_b").alias("feature_id_b"),
        F.lit("correlation").alias("result_type"), F.lit(f"{tags[0]} vs {tags[1]}").alias("experiments"),
        F.col("r").alias("effect"), F.lit(f"{method}_r").alias("effect_type"), F.col("stat").alias("statistic"),
        F.lit(method).alias("statistic_type"), F.when(F.col("r").isNotNull(), F.col("p")).alias("p_value"),
        F.when(F.col("r") >= 0, "positive").when(F.col("r") < 0, "negative").alias("direction"),
        F.lit(f"integration_correlation_{tags[0]}_{tags[1]}").alias("source_label"))
    out = adjust_p(out, [], method=adjust)
    return conform(out.withColumn("is_significant", F.coalesce(F.col("adj_p_value") < p_cutoff, F.lit(False))), INTEGRATION_COLUMNS)


def run_concordance(res_a: DataFrame, res_b: DataFrame, feature_pairs: DataFrame, p_cutoff: float = 0.05, preference: str = "adjusted",
                    effect_cutoff: float = 0.0, adjust: str = "BH", tags=("a", "b"), label: str = "comparison | comparison") -> DataFrame:
    """Signs, quadrants and Fisher's combined p of paired features (one comparison per side)."""
    side = lambda df, s: df.select(
        F.col("feature_id").alias(f"feature_{s}"), F.col("effect").alias(f"effect_{s}"), F.col("p_value").alias(f"p_value_{s}"),
        F.col("adj_p_value").alias(f"adj_p_value_{s}"), direction_sign(F.col("direction"), F.col("effect")).alias(f"dir_{s}"))
    j = pair_ids(feature_pairs).join(side(res_a, "a"), "feature_a").join(side(res_b, "b"), "feature_b")
    clamp = lambda c: F.when(F.col(c).isNotNull(), F.log(F.greatest(F.col(c), F.lit(SMALLEST_DOUBLE))))
    x = -2 * (clamp("p_value_a") + clamp("p_value_b"))
    q = quadrant(F.col("dir_a"), F.col("dir_b"))
    d = F.when(q.isin("up_up", "down_down"), "concordant").when(q.isNotNull(), "discordant")
    p = p_column(preference)
    sig = lambda s: F.coalesce((F.col(f"{p}_{s}") < p_cutoff) & (F.abs(f"effect_{s}") >= effect_cutoff), F.lit(False))
    j = j.withColumns({"statistic": x, "quadrant": q, "direction": d, "significant_a": sig("a"), "significant_b": sig("b")})
    # Chi-square tail with four degrees of freedom in closed form.
    j = j.withColumn("p_value", F.exp(-F.col("statistic") / 2) * (1 + F.col("statistic") / 2))
    out = j.select(
        "feature_id", F.col("label").alias("feature_symbol"), F.lit("concordance").alias("result_type"),
        F.lit(f"{tags[0]} vs {tags[1]}").alias("experiments"), F.lit(label).alias("comparison"),
        (F.col("effect_a") - F.col("effect_b")).alias("effect"), F.lit("effect_diff").alias("effect_type"), "statistic",
        F.lit("fisher_chisq").alias("statistic_type"), "p_value", "direction", "quadrant",
        (F.col("significant_a") & F.col("significant_b") & F.coalesce(F.col("direction") == "concordant", F.lit(False))).alias("is_significant"),
        F.lit(f"integration_concordance_{tags[0]}_{tags[1]}").alias("source_label"),
        F.col("feature_a").alias("feature_id_a"), F.col("feature_b").alias("feature_id_b"), "effect_a", "effect_b", "p_value_a", "p_value_b",
        "adj_p_value_a", "adj_p_value_b", "significant_a", "significant_b")
    return conform(adjust_p(out, [], method=adjust), INTEGRATION_COLUMNS)


def quadrant_counts(conc: DataFrame) -> DataFrame:
    """Rows per quadrant, all and among features significant on both sides."""
    both = F.col("significant_a") & F.col("significant_b")
    return conc.groupBy("quadrant").agg(F.count("*").alias("n"), F.sum(both.cast("int")).alias("n_both_significant"))


def concordance_counts(conc: DataFrame) -> DataFrame:
    """A13 summary row."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    a, b = F.col("significant_a"), F.col("significant_b")
    return conc.agg(n(a).alias("n_significant_a"), n(b).alias("n_significant_b"), n(a & b).alias("n_significant_both"),
                    n(a & b & (F.col("direction") == "concordant")).alias("n_concordant"),
                    n(a & b & (F.col("direction") == "discordant")).alias("n_discordant"))


def gene_scores(res: DataFrame, p: str = "p_value") -> DataFrame:
    """Per gene its smallest p corrected for the number of its tested features, and that feature's effect."""
    g = res.select(join_key(F.col("feature_symbol")).alias("gene"), "feature_id", F.col(p).alias("p"), "effect").where("gene is not null")
    best = g.groupBy("gene").agg(
        F.min(F.struct(F.col("p").isNull().alias("miss"), "p", "feature_id", "effect")).alias("b"), F.count("p").alias("k"))
    k = F.greatest(F.col("k"), F.lit(1))
    return best.select("gene", F.when(k > 1, -F.expm1(k * F.log1p(-F.col("b.p")))).otherwise(F.col("b.p")).alias("p"),
                       F.col("b.effect").alias("effect"), k.alias("n_features"))


def score_matrix(res_a: DataFrame, res_b: DataFrame, p: str = "p_value") -> DataFrame:
    """Genes of either layer with both p-values (missing = 1) and effects (0 where p is 1)."""
    side = lambda r, s: gene_scores(r, p).select("gene", F.col("p").alias(f"p_{s}"), F.col("effect").alias(f"e_{s}"))
    j = side(res_a, "a").join(side(res_b, "b"), "gene", "full")
    fill = lambda s: F.greatest(F.coalesce(f"p_{s}", F.lit(1.0)), F.lit(SMALLEST_DOUBLE))
    j = j.withColumns({"p_a": fill("a"), "p_b": fill("b")})
    eff = lambda s: F.when(F.col(f"p_{s}") == 1, 0.0).otherwise(F.coalesce(f"e_{s}", F.lit(0.0)))
    return j.select("gene", "p_a", "p_b", eff("a").alias("effect_a"), eff("b").alias("effect_b"))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Upper normal quantile of p by bisection on the tail."""
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    tail = lambda z: np.where(z >= 0, 0.5, 0.5) * gamma_upper(np.full(z.shape, 0.5), z * z / 2)
    for _ in range(80):
        mid = (lo + hi) / 2
        up = np.where(mid >= 0, tail(mid), 1 - tail(mid))
        hi = np.where(up < p, mid, hi)
        lo = np.where(up < p, lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def upper_z(p: pd.Series) -> pd.Series:
    return pd.Series(_normal_quantile(p.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    a = z.to_numpy(float)
    half = 0.5 * gamma_upper(np.full(a.shape, 0.5), a * a / 2)
    return pd.Series(np.where(a >= 0, half, 1 - half))


MERGES = ("Fisher", "Brown", "DPM", "Stouffer", "Strube")


def merge_scores(scores: DataFrame, method: str = "DPM", constraints=(1, 1)) -> DataFrame:
    """One merged p per gene. Brown and DPM scale chi-square by the covariance of the layers' scores."""
    if method not in MERGES:
        raise ValueError(f"unknown merge {method!r}; one of {MERGES}")
    la, lb = F.log("p_a"), F.log("p_b")
    if method in ("Stouffer", "Strube"):
        z = cut(scores.withColumns({"z_a": upper_z("p_a"), "z_b": upper_z("p_b")}), "merge")
        r = (z.agg(F.corr("z_a", "z_b")).first()[0] or 0.0) if method == "Strube" else 0.0
        return z.withColumn("merged_p", upper_tail((F.col("z_a") + F.col("z_b")) / float(np.sqrt(2 + 2 * r)))).drop("z_a", "z_b")
    if method == "DPM" and all(c != 0 for c in constraints):
        sa, sb = F.signum("effect_a") * constraints[0], F.signum("effect_b") * constraints[1]
        # Genes without a sign on a side enter undirected there.
        directed = F.abs(la * sa + lb * sb) - F.when(sa == 0, la).otherwise(0.0) - F.when(sb == 0, lb).otherwise(0.0)
        x = 2 * directed
    else:
        x = -2 * (la + lb)
    if method == "Fisher":
        return scores.withColumn("merged_p", chisq_upper(x, F.lit(4.0)))
    scores = cut(scores, "merge")
    cov = _score_covariance(scores)
    var = 8.0 + 2 * cov
    df = min(32.0 / var, 4.0)
    c = max(var / 8.0, 1.0)
    return scores.withColumn("merged_p", chisq_upper(x / c, F.lit(df)))


def _score_covariance(scores: DataFrame) -> float:
    """Covariance of -2 ln ECDF(p) between the layers; ECDFs by distributed cumulative counts."""
    w = scores
    for s in ("a", "b"):
        per = cumulative(scores, [], f"p_{s}").select(
            f"p_{s}", (-2 * F.log((F.col("below") + F.col("ties")) / F.col("total"))).alias(f"w_{s}"))
        w = w.join(per, f"p_{s}")
    return w.agg(F.covar_samp("w_a", "w_b")).first()[0] or 0.0


def ordered_enrichment(genes: DataFrame, p: str, sets: DataFrame, n_background, cutoff: float = 0.1) -> DataFrame:
    """Per set the smallest hypergeometric p over prefixes of the gene list ordered by p.

    Only prefixes ending at a member matter; genes with equal p enter together. Windows run
    over the members of a set, which its size limit bounds.
    """
    pos = cumulative(genes, [], p).where(F.col(p) <= cutoff).select(F.col(p), (F.col("below") + F.col("ties")).alias("prefix"))
    listed = genes.select("gene", p).join(pos, p)
    members = sets.select("term", "gene", "set_size").join(listed, "gene")
    w = W.partitionBy("term").orderBy("prefix")
    hits = members.withColumn("k", F.count("*").over(w.rangeBetween(W.unboundedPreceding, 0)))
    hits = hits.withColumn("prefix_p", hyper_upper(F.col("k").cast("double"), F.col("prefix").cast("double"),
                                                   F.col("set_size").cast("double"), n_background))
    best = hits.groupBy("term").agg(F.min(F.struct("prefix_p", "prefix", "k")).alias("b"), F.first("set_size").alias("set_size"))
    return best.select("term", "set_size", F.col("b.prefix_p").alias("p_value"), F.col("b.prefix").alias("prefix"), F.col("b.k").alias("overlap_size"))


def active_pathways(res_a: DataFrame, res_b: DataFrame, term2gene: DataFrame, method: str = "DPM", constraints=(1, 1),
                    significant: float = 0.05, size=(5, 1000), p: str = "p_value", tags=("a", "b")) -> DataFrame:
    """Gene sets supported by the merged evidence, what supports them and in which direction."""
    sets = term2gene.select("term", join_key(F.col("gene")).alias("gene")).dropna().distinct()
    sizes = sets.groupBy("term").agg(F.count("*").alias("full_size")).where(F.col("full_size").between(*size)).select("term")
    sets = sets.join(sizes, "term")
    scores = score_matrix(res_a, res_b, p).join(sets.select("gene").distinct(), "gene", "left_semi")
    merged = cut(merge_scores(scores, method, constraints), "merged")
    n_bg = F.lit(float(merged.count()))
    inside = sets.join(merged.select("gene"), "gene", "left_semi")
    inside = inside.join(inside.groupBy("term").agg(F.count("*").alias("set_size")), "term")
    runs = {"combined": "merged_p", tags[0]: "p_a", tags[1]: "p_b"}
    done = {}
    for name, col in runs.items():
        r = ordered_enrichment(merged, col, inside, n_bg)
        done[name] = adjust_p(inside.select("term", "set_size").distinct().join(r.drop("set_size"), "term", "left").fillna(1.0, ["p_value"]), [], method="holm")
    top = done["combined"].where(F.col("adj_p_value") < significant)
    ev = lambda t: done[t].select("term", (F.col("adj_p_value") < significant).alias(f"ev_{t}"))
    top = top.join(ev(tags[0]), "term").join(ev(tags[1]), "term")
    a, b = F.col(f"ev_{tags[0]}"), F.col(f"ev_{tags[1]}")
    members = inside.select("term", "gene").join(merged, "gene").join(top.select("term", "prefix"), "term")
    rank = cumulative(merged, [], "merged_p").select("merged_p", (F.col("below") + F.col("ties")).alias("place"))
    drive = members.join(rank, "merged_p").where(F.col("place") <= F.col("prefix"))
    dirs = pathway_directions(drive)
    out = top.join(dirs, "term", "left").select(
        F.col("term").alias("feature_id"), F.col("term").alias("feature_symbol"), F.lit("active_pathways").alias("result_type"),
        F.lit(f"{tags[0]} vs {tags[1]}").alias("experiments"), neg_log10(F.col("adj_p_value")).alias("effect"),
        F.lit("neg_log10_padj").alias("effect_type"), F.col("adj_p_value").alias("statistic"), F.lit("adjusted_p_val").alias("statistic_type"),
        F.col("adj_p_value").alias("p_value"), "adj_p_value", "direction", F.lit(True).alias("is_significant"),
        F.concat_ws(",", F.when(a, tags[0]), F.when(b, tags[1]), F.when(~a & ~b, "combined")).alias("quadrant"),
        F.lit(f"integration_active_pathways_{tags[0]}_{tags[1]}").alias("source_label"),
        "direction_a", "direction_b", "layers_agree", "n_genes_agree", "n_genes_disagree",
        F.when(a & b, "shared").when(a | b, "unique").otherwise("combined").alias("evidence"))
    return conform(out, INTEGRATION_COLUMNS)


def pathway_directions(members: DataFrame) -> DataFrame:
    """Majority direction of a set's driving genes (term, effect_a, effect_b) per layer and overall."""
    share = lambda s: F.avg(F.when(F.col(f"effect_{s}") != 0, (F.col(f"effect_{s}") > 0).cast("double")))
    both = (F.col("effect_a") != 0) & (F.col("effect_b") != 0)
    same = F.signum("effect_a") == F.signum("effect_b")
    g = members.groupBy("term").agg(
        share("a").alias("ua"), share("b").alias("ub"),
        F.sum((both & same).cast("int")).alias("n_genes_agree"), F.sum((both & ~same).cast("int")).alias("n_genes_disagree"))
    word = lambda c: F.when(F.col(c) > 0.5, "up").when(F.col(c) < 0.5, "down").when(F.col(c) == 0.5, "mixed")
    g = g.withColumns({"direction_a": word("ua"), "direction_b": word("ub")})
    da, db = F.col("direction_a"), F.col("direction_b")
    return g.select(
        "term", F.when(da.isNull(), db).when(db.isNull(), da).when(da == db, da).otherwise("mixed").alias("direction"),
        "direction_a", "direction_b", F.when(da.isNotNull() & db.isNotNull(), (da == db) & (da != "mixed")).alias("layers_agree"),
        "n_genes_agree", "n_genes_disagree")
