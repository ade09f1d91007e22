"""Layers and results in and out: measurement tables, quantifier files, assay folders, gene sets, projects."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.model import Layer, Project, make_layer
from assaygrid.operators.cells import melt
from assaygrid.session import cut
from assaygrid.sources import profile as P
from assaygrid.sources.delimited import read_table, sniff

# Column signatures of the quantifiers (fixed values): id, count, length and abundance columns.
QUANTIFIERS = {
    "salmon": (("Name", "Length", "EffectiveLength", "TPM", "NumReads"), ("Name",), "NumReads", "EffectiveLength", "TPM"),
    "rsem": (("length", "effective_length", "expected_count", "TPM"), ("gene_id", "transcript_id"), "expected_count", "effective_length", "TPM"),
    "kallisto": (("target_id", "length", "eff_length", "est_counts", "tpm"), ("target_id",), "est_counts", "eff_length", "tpm"),
}
QUANT_SUFFIX = r"(?i)([._-]?(quant|abundance|genes|isoforms))*(\.(sf|tsv|results|txt))?(\.gz)?$"


def read_layer(spark: SparkSession, path: str, omics_type: str, assay_type: str | None = None, samples: DataFrame | None = None,
               transpose: bool | None = None) -> Layer:
    """A delimited measurement table as a layer: sniffed, cleaned, profiled once, then melted lazily."""
    return read_reported(spark, path, omics_type, assay_type, samples, transpose)[0]


def read_reported(spark: SparkSession, path: str, omics_type: str, assay_type: str | None = None, samples: DataFrame | None = None,
                  transpose: bool | None = None) -> tuple[Layer, DataFrame]:
    """The layer and a report (action, name, detail) of what the import skipped, renamed, read otherwise or left out."""
    layout = sniff(spark, path)
    # Lines are parsed and numbers cleaned once; styles, summaries, units and cells read the written tables.
    text = cut(P.sample_columns(read_table(spark, path, layout)), "import-text")
    styles = {r.column_name: r.style for r in P.column_styles(text, layout.decimal_comma).collect()}
    numbers = cut(P.numeric_columns(text, layout.decimal_comma, styles), "import-numbers")
    whole = P.drop_summaries(numbers)
    wide = P.one_unit(whole)
    flip = transpose if transpose is not None else P.orientation(wide)[0] == "samples_in_rows"
    notes = [("comment lines", str(len(layout.comments)), None)] * bool(layout.comments)
    notes += [("heading renamed", old, new) for new, old in layout.renamed.items()]
    notes += [("decimal comma" if v == "comma" else "column left out", c, None if v == "comma" else v) for c, v in styles.items() if v != "dot"]
    notes += [("summary column", c, None) for c in numbers.columns if c not in whole.columns]
    notes += [("orientation", "samples_in_rows" if flip else "features_in_rows", None)]
    report = spark.createDataFrame(notes, "action string, name string, detail string")
    cells = melt(wide, wide.columns[0], wide.columns[1:], flip)
    key = "feature_id" if not flip else "sample_id"
    other = spark.createDataFrame([(c,) for c in wide.columns[1:]], f"{'sample_id' if not flip else 'feature_id'} string")
    mine = wide.select(F.col(f"`{wide.columns[0]}`").alias(key)).distinct()
    feats, samp = (mine, other) if not flip else (other, mine)
    if samples is not None:
        samp = samp.join(samples, "sample_id", "left")
    return make_layer(cells, samp, feats, omics_type, assay_type or ("raw_count" if omics_type == "rnaseq" else "raw_intensity")), report


def quant_sample(path: Column) -> Column:
    """Sample name of a quantifier file: its name without quantifier suffix, else its folder's name."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), QUANT_SUFFIX, "")
    return F.when(stem != "", stem).otherwise(F.when(F.size(parts) > 1, F.element_at(parts, -2)))


def detect_quantifier(columns: list[str]) -> str | None:
    for name, (need, ids, *_) in QUANTIFIERS.items():
        if columns and set(need) <= set(columns) and columns[0] in ids:
            return name
    return None


def read_quant(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """Many quantifier files in one scan. Returns (cells with eff_length and tpm, problems).

    A file per sample; ids are cut at the first vertical bar; lengths up to 0 become 1. Problems
    list repeated ids and files whose id set differs (U6), found by counting, not by comparing
    every pair of files.
    """
    first = (paths if isinstance(paths, str) else paths[0])
    header = spark.read.csv(first, sep="\t", header=True).columns
    fmt = detect_quantifier(header)
    if fmt is None:
        raise ValueError(f"not a quantifier table; columns are {header[:8]}")
    _, _, count, length, tpm = QUANTIFIERS[fmt]
    raw = spark.read.csv(paths, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in header), enforceSchema=False)
    rows = raw.select(
        F.regexp_replace(F.trim(F.col(header[0])), r"\|.*$", "").alias("feature_id"), quant_sample(F.col("_metadata.file_path")).alias("sample_id"),
        F.col(count).try_cast("double").alias("value"),
        F.when(F.col(length).try_cast("double") > 0, F.col(length).try_cast("double")).otherwise(1.0).alias("eff_length"),
        F.col(tpm).try_cast("double").alias("tpm"))
    per = rows.groupBy("sample_id", "feature_id").agg(F.count("*").alias("n"))
    dup = per.where("n > 1").select("sample_id", "feature_id", F.lit("repeated id").alias("problem"))
    n_files = rows.select("sample_id").distinct().agg(F.count("*")).scalar()
    gap = per.groupBy("feature_id").agg(F.count("*").alias("k")).where(F.col("k") < n_files).select(
        F.lit(None).cast("string").alias("sample_id"), "feature_id", F.lit("missing in a file").alias("problem"))
    return rows, dup.unionByName(gap)


def write_assays(folder: str, assays: dict[str, DataFrame], samples: DataFrame, features: DataFrame) -> None:
    """Several assays of one study as a folder of parquet tables."""
    for name, cells in assays.items():
        cells.write.mode("overwrite").parquet(os.path.join(folder, "assays", name))
    samples.write.mode("overwrite").parquet(os.path.join(folder, "samples"))
    features.write.mode("overwrite").parquet(os.path.join(folder, "features"))


def read_assays(spark: SparkSession, folder: str, names: list[str], omics_type: str, assay_type: str, assay: str | None = None) -> Layer:
    """One assay of the folder: the named one, else `counts`, else the first."""
    pick = assay or ("counts" if "counts" in names else names[0])
    t = lambda *p: spark.read.parquet(os.path.join(folder, *p))
    return make_layer(t("assays", pick), t("samples"), t("features"), omics_type, assay_type)


# Gene-set databases and aliases (fixed values).
DATABASES = ("hallmark", "kegg", "reactome", "wikipathways", "go_bp", "go_mf", "go_cc")


def write_gene_sets(sets: DataFrame, path: str) -> None:
    """Snapshot partitioned by database and organism; only the partitions written are replaced."""
    sets.repartition("database", "organism").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "database", "organism").parquet(path)


def read_gene_sets(spark: SparkSession, path: str, databases: list[str] | None = None, organism: str | None = None) -> DataFrame:
    """Gene-set rows; database and organism prune partitions."""
    df = spark.read.parquet(path)
    if databases:
        df = df.where(F.col("database").isin(*databases))
    return df.where(F.col("organism") == organism) if organism else df


def gene_set_status(sets: DataFrame) -> DataFrame:
    """Sets, genes and rows per database and organism."""
    return sets.groupBy("database", "organism").agg(
        F.count_distinct("gs_name").alias("n_sets"), F.count_distinct("gene_symbol").alias("n_genes"), F.count("*").alias("n_rows"))


def snapshot_from_links(gene_pathway: DataFrame, pathway_names: DataFrame, gene_symbols: DataFrame, database: str, organism: str) -> DataFrame:
    """(gene, pathway), (pathway, name) and (gene, annotation) tables joined into gene-set rows."""
    from assaygrid.functions.scalar import kegg_symbol

    sym = gene_symbols.select("gene", kegg_symbol(F.col("annotation")).alias("gene_symbol")).where("gene_symbol is not null")
    return gene_pathway.join(sym, "gene").join(pathway_names, "pathway").select(
        F.lit(database).alias("database"), F.lit(organism).alias("organism"), F.col("name").alias("gs_name"), "gene_symbol",
        F.col("name").alias("gs_description"), F.col("pathway").alias("gs_id"), F.lit("local tables").alias("gs_source")).distinct()


def flatten(df: DataFrame) -> DataFrame:
    """Arrays joined by ';', tabs and line breaks in text to blanks."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "array":
            c = F.array_join(c.cast("array<string>"), ";")
            kind = "string"
        if kind == "string":
            c = F.regexp_replace(c, "[\\t\\r\\n]+", " ")
        out.append(c.alias(f.name))
    return df.select(*out)


def export_result(tables: dict[str, DataFrame], params: dict, folder: str) -> DataFrame:
    """Every table as tab-separated text (by comparison where it has one), parameters as JSON. Returns what was written."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        path = os.path.join(folder, name)
        w = flatten(df)
        if "comparison" in df.columns:
            w = w.withColumn("by_comparison", F.regexp_replace("comparison", "[^A-Za-z0-9._]", "_"))
            w.write.mode("overwrite").partitionBy("by_comparison").csv(path, sep="\t", header=True)
        else:
            w.write.mode("overwrite").csv(path, sep="\t", header=True)
        rows.append(("table", name, path))
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "params"))
    rows.append(("params", "params", os.path.join(folder, "params")))
    return spark.createDataFrame(rows, "artifact_type string, label string, path string")


FORMAT_VERSION = 1
# version -> function(manifest) giving the next version's manifest
MIGRATIONS: dict = {}


def save_project(spark: SparkSession, project: Project, folder: str) -> None:
    """Tables first, the manifest last, so a folder without a manifest is not a project."""
    layers = {}
    for tag, y in project.layers.items():
        for part in ("cells", "samples", "features"):
            getattr(y, part).write.mode("errorifexists").parquet(os.path.join(folder, "layers", tag, part))
        layers[tag] = {"omics_type": y.omics_type, "assay_type": y.assay_type, "group_col": y.group_col, "reference": y.reference}
    links = {}
    for name in ("sample_link", "feature_link"):
        df = getattr(project, name)
        if df is not None:
            df.write.mode("errorifexists").parquet(os.path.join(folder, name))
            links[name] = True
    doc = json.dumps({"version": FORMAT_VERSION, "layers": layers, "links": links})
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("errorifexists").text(os.path.join(folder, "manifest"))


def load_project(spark: SparkSession, folder: str) -> Project:
    """Forward migrations of older manifests; newer ones are refused."""
    doc = json.loads(spark.read.text(os.path.join(folder, "manifest")).first()[0])
    if doc["version"] > FORMAT_VERSION:
        raise ValueError(f"project format {doc['version']} is newer than {FORMAT_VERSION}")
    while doc["version"] < FORMAT_VERSION:
        doc = MIGRATIONS[doc["version"]](doc)
    t = lambda *p: spark.read.parquet(os.path.join(folder, *p))
    layers = {tag: Layer(t("layers", tag, "cells"), t("layers", tag, "samples"), t("layers", tag, "features"), **info) for tag, info in doc["layers"].items()}
    return Project(layers, *(t(n) if doc["links"].get(n) else None for n in ("sample_link", "feature_link")))
