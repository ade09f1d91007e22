"""Joins between layers: features by symbol or link table, samples by donor or stem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.functions.scalar import blank_to_null, canonical_accession, ensembl_base, join_key
from assaygrid.model import Layer


def annotate(df: DataFrame, features: DataFrame) -> DataFrame:
    """Symbol and type onto a result; a blank symbol becomes the id."""
    f = features.select("feature_id", "feature_symbol")
    return df.join(f, "feature_id", "left").withColumn(
        "feature_symbol", F.coalesce(blank_to_null(F.col("feature_symbol")), F.col("feature_id")))


def loose_key(c):
    """Lower case, letters and digits only."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))


def attach_metadata(ids: DataFrame, id_col: str, sheet: DataFrame, key_col: str) -> DataFrame:
    """Sheet columns onto ids, exact key first, else the loose key where it is unique on both sides.

    Repeated keys keep their smallest row; ids without a match get NULLs.
    """
    cols = [c for c in sheet.columns if c != key_col]
    row = F.struct(*[F.col(c) for c in cols])
    exact = sheet.groupBy(F.col(key_col).alias("_key")).agg(F.min(row).alias("_exact"))
    loose = sheet.groupBy(loose_key(F.col(key_col)).alias("_loose")).agg(
        F.min(row).alias("_near"), F.count_distinct(key_col).alias("_n")).where("_n = 1 and _loose is not null").drop("_n")
    mine = ids.select(id_col).distinct().withColumn("_loose", loose_key(F.col(id_col)))
    clash = mine.groupBy("_loose").agg(F.count("*").alias("_c"))
    out = (
        mine.join(exact, F.col(id_col) == F.col("_key"), "left").join(loose, "_loose", "left").join(clash, "_loose", "left")
        .withColumn("_row", F.coalesce("_exact", F.when(F.col("_c") == 1, F.col("_near"))))
    )
    return out.select(id_col, *[F.col(f"_row.{c}").alias(c) for c in cols])


def best_key_column(ids: DataFrame, id_col: str, sheet: DataFrame, candidates: list[str]) -> DataFrame:
    """Candidate columns by how many ids they hold (exact or loose), best first."""
    long = sheet.select(*[F.col(c).cast("string").alias(c) for c in candidates]).unpivot([], candidates, "column_name", "key")
    long = long.select("column_name", loose_key(F.col("key")).alias("k")).where("k is not null").distinct()
    keys = ids.select(loose_key(F.col(id_col)).alias("k")).distinct()
    hits = long.join(keys, "k").groupBy("column_name").agg(F.count("*").alias("n_matched"))
    return hits.orderBy(F.col("n_matched").desc(), "column_name")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """J16."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def symbols_by_gene_id(features: DataFrame, gene_map: DataFrame) -> DataFrame:
    """Symbols through the version-free id; the best supported pairing wins; PAR_Y copies get none.

    gene_map(gene_id, symbol[, support]).
    """
    support = F.col("support") if "support" in gene_map.columns else F.lit(1)
    best = gene_map.where("symbol is not null").groupBy(F.col("gene_id").alias("_base")).agg(
        F.min(F.struct((-support).alias("s"), "symbol")).alias("b")).select("_base", F.col("b.symbol").alias("mapped_symbol"))
    keyed = features.withColumn("_base", F.when(~F.col("feature_id").endswith("_PAR_Y"), ensembl_base(F.col("feature_id"))))
    return keyed.join(best, "_base", "left").drop("_base")


def pair_by_symbol(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features of two layers with the same upper-cased symbol, many to many."""
    side = lambda f, s: f.select(F.col("feature_id").alias(f"feature_{s}"), F.col("feature_symbol").alias(f"symbol_{s}"),
                                 join_key(F.col("feature_symbol")).alias("key")).where("key is not null")
    return side(a, "a").join(side(b, "b"), "key").withColumn("label", F.col("symbol_a"))


def link_keys(features: DataFrame) -> DataFrame:
    """Every key a feature answers to: 1 its id or a member of it, 2 a canonical accession, 3 its symbol."""
    piece = F.explode(F.split("feature_id", ";"))
    parts = features.select("feature_id", piece.alias("p"))
    acc = parts.select("feature_id", F.regexp_replace(F.trim("p"), r"^(sp|tr)\|([^|]+)\|.*$", "$2").alias("p"))
    key = lambda df, c, tier: df.select("feature_id", join_key(c).alias("key"), F.lit(tier).alias("tier"))
    every = (
        key(features, F.col("feature_id"), 1).unionByName(key(acc, F.col("p"), 1))
        .unionByName(key(acc, canonical_accession(F.col("p")), 2)).unionByName(key(features, F.col("feature_symbol"), 3))
    )
    return every.where("key is not null").groupBy("feature_id", "key").agg(F.min("tier").alias("tier"))


def match_side(features: DataFrame, link: DataFrame, col: str) -> DataFrame:
    """Link rows each feature is named by, at its most specific tier."""
    rows = link.select("row_id", F.explode(F.split(col, ";")).alias("v")).select(
        "row_id", join_key(F.col("v")).alias("key")).where("key is not null").distinct()
    m = link_keys(features).join(rows, "key")
    best = m.groupBy("feature_id").agg(F.min("tier").alias("tier"))
    return m.join(best, ["feature_id", "tier"]).select("feature_id", "row_id", "tier").distinct()


def pair_by_link(a: DataFrame, b: DataFrame, link: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """Features paired through a link table (two columns); rows are told apart by their content."""
    link = clean_link(link, col_a, col_b).withColumn("row_id", F.xxhash64(col_a, col_b))
    ma = match_side(a, link, col_a).withColumnsRenamed({"feature_id": "feature_a", "tier": "tier_a"})
    mb = match_side(b, link, col_b).withColumnsRenamed({"feature_id": "feature_b", "tier": "tier_b"})
    pairs = ma.join(mb, "row_id").groupBy("feature_a", "feature_b").agg(F.min("tier_a").alias("tier_a"), F.min("tier_b").alias("tier_b"))
    sym = lambda f, s: f.select(F.col("feature_id").alias(f"feature_{s}"), F.col("feature_symbol").alias(f"symbol_{s}"))
    pairs = pairs.join(sym(a, "a"), "feature_a").join(sym(b, "b"), "feature_b")
    by_b = (F.col("tier_b") == 3) & (F.col("tier_a") != 3)
    return pairs.withColumn("label", F.coalesce(
        blank_to_null(F.when(by_b, F.col("symbol_b")).otherwise(F.col("symbol_a"))),
        blank_to_null(F.col("symbol_b")), F.col("feature_a")))


def clean_link(link: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """Trimmed, complete, distinct link rows."""
    return link.select(blank_to_null(F.col(col_a)).alias(col_a), blank_to_null(F.col(col_b)).alias(col_b)).dropna().distinct()


def pair_ids(pairs: DataFrame) -> DataFrame:
    """Unique pair names: 'gene', or 'gene (feature)' where a gene has several pairs.

    Whether a gene repeats, and on which side, comes from an aggregate, not a window.
    """
    stats = pairs.groupBy(F.coalesce(join_key(F.col("label")), F.lit("")).alias("_k")).agg(
        F.count("*").alias("_n"), F.count_distinct("feature_a").alias("_a"), F.count_distinct("feature_b").alias("_b"))
    p = pairs.withColumn("_k", F.coalesce(join_key(F.col("label")), F.lit(""))).join(stats, "_k")
    part = F.when((F.col("_a") > 1) & (F.col("_b") > 1), F.concat_ws(" / ", "feature_a", "feature_b")).when(
        F.col("_a") > 1, F.col("feature_a")).otherwise(F.col("feature_b"))
    return p.withColumn("feature_id", F.when(F.col("_n") > 1, F.concat("label", F.lit(" ("), part, F.lit(")"))).otherwise(F.col("label"))
                        ).drop("_k", "_n", "_a", "_b")


def pairing_counts(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """How many features pair, and how many share a partner, on either side."""
    per_a = pairs.groupBy("feature_a").agg(F.count("*").alias("n"))
    per_b = pairs.groupBy("feature_b").agg(F.count("*").alias("n"))
    n = lambda df: df.agg(F.count("*")).scalar()
    sharing = lambda other, k, mine: pairs.join(other.where("n > 1").select(k), k, "left_semi").select(mine).distinct()
    return pairs.agg(F.count("*").alias("n_pairs")).select(
        n(a).alias("n_features_a"), n(b).alias("n_features_b"), "n_pairs",
        n(per_a).alias("n_paired_a"), n(per_b).alias("n_paired_b"),
        n(sharing(per_b, "feature_b", "feature_a")).alias("n_a_sharing"), n(per_b.where("n > 1")).alias("n_b_shared"),
        n(sharing(per_a, "feature_a", "feature_b")).alias("n_b_sharing"), n(per_a.where("n > 1")).alias("n_a_shared"),
    )


def guess_link_columns(a: DataFrame, b: DataFrame, link: DataFrame, candidates: list[str]) -> DataFrame:
    """Ordered column pairs (among the first six) by how many features they pair."""
    out = None
    for ca in candidates[:6]:
        for cb in candidates[:6]:
            if ca != cb:
                one = pair_by_link(a, b, link, ca, cb).agg(F.count("*").alias("n_pairs")).select(
                    F.lit(ca).alias("column_a"), F.lit(cb).alias("column_b"), "n_pairs")
                out = one if out is None else out.unionByName(one)
    return out.orderBy(F.col("n_pairs").desc(), "column_a", "column_b")


def pair_by_donor(link: DataFrame, tag_a: str, tag_b: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Sample pairs through sample_link(tag, sample_id, donor_id); both sides must exist."""
    side = lambda tag, s, samples: link.where(F.col("tag") == tag).join(samples.select("sample_id").distinct(), "sample_id", "left_semi").select(
        F.col("donor_id").alias("donor"), F.col("sample_id").alias(f"sample_{s}"))
    return side(tag_a, "a", a).join(side(tag_b, "b", b), "donor")


def pair_by_column(a: DataFrame, b: DataFrame, donor_col: str) -> DataFrame:
    """Sample pairs through a donor column both sample tables have."""
    side = lambda df, s: df.where(F.col(donor_col).isNotNull()).select(F.col(donor_col).alias("donor"), F.col("sample_id").alias(f"sample_{s}"))
    return side(a, "a").join(side(b, "b"), "donor")


def pair_by_id(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples with equal ids."""
    return a.select("sample_id").join(b.select("sample_id"), "sample_id").select(
        F.col("sample_id").alias("donor"), F.col("sample_id").alias("sample_a"), F.col("sample_id").alias("sample_b"))


def sample_stem(c):
    return F.regexp_replace(c, r"[-_. ].*$", "")


def suggest_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equal id stems that are unique on either side."""
    side = lambda df, s: df.groupBy(F.lower(sample_stem(F.col("sample_id"))).alias("donor")).agg(
        F.count("*").alias("n"), F.min("sample_id").alias(f"sample_{s}")).where("n = 1").drop("n")
    return side(a, "a").join(side(b, "b"), "donor")


def one_pair_each(pairs: DataFrame) -> DataFrame:
    """The first pair of each donor, then of each sample on either side (in id order).

    The sample axis bounds the groups; `is_dropped` marks the pairs left out.
    """
    order = ["sample_a", "sample_b"]
    first = lambda key: F.row_number().over(W.partitionBy(key).orderBy(*[c for c in ["donor", *order] if c != key])) == 1
    p = pairs.withColumn("keep", first("donor"))
    kept = p.where("keep").withColumn("keep", first("sample_a"))
    kept2 = kept.where("keep").withColumn("keep", first("sample_b"))
    good = kept2.where("keep").select("donor", "sample_a", "sample_b")
    return pairs.join(good.withColumn("ok", F.lit(True)), ["donor", "sample_a", "sample_b"], "left").withColumn(
        "is_dropped", F.col("ok").isNull()).drop("ok")


def resolve_pairs(a: Layer, b: Layer, link: DataFrame | None, tag_a: str, tag_b: str, donor_col: str | None) -> tuple[str, DataFrame]:
    """The first non-empty of saved link, donor column, equal ids; a stem is only suggested."""
    ladder = []
    if link is not None:
        ladder.append(("link", pair_by_donor(link, tag_a, tag_b, a.samples, b.samples)))
    if donor_col and donor_col in a.samples.columns and donor_col in b.samples.columns:
        ladder.append(("donor", pair_by_column(a.samples, b.samples, donor_col)))
    ladder.append(("sample_id", pair_by_id(a.samples, b.samples)))
    for how, pairs in ladder:
        if pairs.limit(1).count():
            return how, one_pair_each(pairs).where("not is_dropped").drop("is_dropped")
    raise ValueError("no sample pairing; suggest_pairs() lists pairs by id stem to confirm")


def paired_cells(a: Layer, b: Layer, feature_pairs: DataFrame, sample_pairs: DataFrame) -> DataFrame:
    """(feature_a, feature_b, donor, x, y) of every feature pair in every sample pair."""
    fp = feature_pairs.select("feature_a", "feature_b").distinct()
    sp = a.per_sample(sample_pairs.select("donor", "sample_a", "sample_b"))
    xa = a.cells.join(sp, F.col("sample_id") == F.col("sample_a")).select(
        F.col("feature_id").alias("feature_a"), "donor", "sample_b", F.col("value").alias("x"))
    yb = b.cells.select(F.col("feature_id").alias("feature_b"), F.col("sample_id").alias("sample_b"), F.col("value").alias("y"))
    return xa.join(fp, "feature_a").join(yb, ["feature_b", "sample_b"]).select("feature_a", "feature_b", "donor", "x", "y")


def to_genes(tx: DataFrame, tx2gene: DataFrame) -> DataFrame:
    """Transcript cells (tx_id, sample_id, count, length, tpm) to genes.

    Ids are matched with or without version, whichever matches more; counts are summed; the
    length is weighted by abundance, else the geometric mean of the gene's finite samples, else
    the mean transcript length.
    """
    from assaygrid.functions.scalar import strip_version

    tids = tx.select("tx_id").distinct()
    exact = tids.join(tx2gene.select("tx_id").distinct(), "tx_id", "left_semi").count()
    bare = tids.select(strip_version(F.col("tx_id")).alias("k")).distinct().join(
        tx2gene.select(strip_version(F.col("tx_id")).alias("k")).distinct(), "k", "left_semi").count()
    key = strip_version if bare > exact else (lambda c: c)
    m = tx2gene.select(key(F.col("tx_id")).alias("k"), "gene_id").distinct()
    rows = tx.withColumn("k", key(F.col("tx_id"))).join(m, "k")
    g = rows.groupBy("gene_id", "sample_id").agg(
        F.sum("count").alias("count"), F.sum("tpm").alias("tpm"),
        (F.sum(F.col("tpm") * F.col("length")) / F.nullif(F.sum("tpm"), F.lit(0.0))).alias("w"),
        F.avg("length").alias("plain"))
    back = g.groupBy("gene_id").agg(F.exp(F.avg(F.log("w"))).alias("geo"), F.avg("plain").alias("mean_length"))
    return g.join(back, "gene_id").select(
        F.col("gene_id").alias("feature_id"), "sample_id", F.col("count").alias("value"), "tpm",
        F.coalesce("w", "geo", "mean_length").alias("eff_length"))
