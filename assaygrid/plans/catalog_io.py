"""Queries: text, quantifier, gene-set and project input and output over tables derived from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.model import Project
from assaygrid.operators.cells import melt
from assaygrid.plans import fixtures as FX
from assaygrid.plans import testtables as TT
from assaygrid.plans.registry import query, r
from assaygrid.session import scratch_path
from assaygrid.sources import delimited as DL
from assaygrid.sources import layers as SL
from assaygrid.sources import profile as PR

NATIONS = [f"N{i}" for i in range(25)]
# Parts whose rows share one text file.
ROWS_PER_FILE = 50_000


def _wide(s, d):
    """Quantity per part (rows) and supplier nation (columns)."""
    li = TT.table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    su = TT.table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("nation"))
    return li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.concat(F.lit("ENSG"), F.lpad(F.col("l_partkey").cast("string"), 11, "0")).alias("gene")).pivot(
        "nation", NATIONS).agg(F.sum("l_quantity"))


_CELLS = """wc AS (SELECT 'ENSG'||lpad(l_partkey::VARCHAR, 11, '0') AS feature_id, 'N'||s_nationkey AS sample_id, sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def _text_file(s, d, sep="\t", decorate=None):
    """The wide table as text with missing marks, a total column and vendor names, written once per use."""
    w = _wide(s, d)
    num = lambda c: F.when(F.col(c).isNull(), "n.d.").otherwise(F.col(c).cast("string"))
    name = decorate or (lambda c: c)
    out = w.select(F.col("gene").alias("Protein IDs"), *[num(c).alias(name(c)) for c in NATIONS],
                   sum((F.coalesce(F.col(c), F.lit(0.0)) for c in NATIONS[1:]), F.coalesce(F.col(NATIONS[0]), F.lit(0.0))).cast("string").alias("Total"))
    path = scratch_path(s, "text")
    out.write.csv(path, sep=sep, header=True)
    return path


query("s1_read_layer", f"WITH {_CELLS} SELECT feature_id, sample_id, {r('value', 2)} AS value FROM wc", 2)(
    lambda s, d: SL.read_layer(s, _text_file(s, d), "rnaseq").cells)
query("s2_delimited", f"WITH {_CELLS} SELECT feature_id, count(*) AS n_seen FROM wc GROUP BY 1")(
    lambda s, d: (lambda t: t.select(F.col("Protein IDs").alias("feature_id"), sum((DL.clean_number(F.col(c)).isNotNull().cast("long") for c in NATIONS[1:]), DL.clean_number(F.col(NATIONS[0])).isNotNull().cast("long")).alias("n_seen")))(
        DL.read_table(s, _text_file(s, d, ";"))))


def _comma_file(s, d):
    """The wide table with decimal commas and semicolons, 30 leading comments and a row named #part."""
    w = _wide(s, d)
    num = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.translate(F.format_string("%.2f", F.col(c) / 8), ".", ","))
    line = F.concat_ws(";", "gene", *[num(c) for c in NATIONS])
    first = [f"# note {i}" for i in range(30)] + [";".join(["gene", *NATIONS])]
    last = ";".join(["#part", *["1,5"] * len(NATIONS)])
    # Every file of the folder starts with the comments and the header, as an export in parts does, so rows are written by many tasks.
    parts = max(1, -(-TT.table(s, d, "part").count() // ROWS_PER_FILE))
    head = s.createDataFrame(list(enumerate(first)), "i long, value string").select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "i", "value")
    odd = s.createDataFrame([(0, len(first), last)], "p int, i long, value string")
    rows = w.select(F.pmod(F.xxhash64("gene"), F.lit(parts)).cast("int").alias("p"), F.lit(1_000_000).cast("long").alias("i"), line.alias("value"))
    path = scratch_path(s, "comma")
    head.unionByName(odd).unionByName(rows).repartition(parts, "p").sortWithinPartitions("p", "i").select("value").write.text(path)
    return path


_COMMA = f"""WITH {_CELLS} SELECT feature_id, sample_id, {r('round(value / 8, 2)', 2)} AS value FROM wc
UNION ALL SELECT '#part', 'N' || unnest(range(25)), 1.5::DOUBLE"""
query("s1_decimal_comma", _COMMA, 2)(lambda s, d: SL.read_layer(s, _comma_file(s, d), "proteomics", transpose=False).cells)
query("s1_import_report", """SELECT 'comment lines' AS action, '30' AS name, NULL::VARCHAR AS detail UNION ALL SELECT 'decimal comma', 'N' || unnest(range(25)), NULL
UNION ALL SELECT 'orientation', 'features_in_rows', NULL""")(lambda s, d: SL.read_reported(s, _comma_file(s, d), "proteomics")[1])
query("p18_vendor_columns", f"WITH {_CELLS} SELECT feature_id, sample_id, {r('value', 2)} AS value FROM wc", 2)(
    lambda s, d: (lambda w: melt(w, w.columns[0], w.columns[1:]))(PR.numeric_columns(PR.sample_columns(DL.read_table(s, _text_file(s, d, "\t", lambda c: f"LFQ intensity {c}.raw"))))))
query("p19_one_unit", f"WITH {_CELLS} SELECT feature_id, sample_id, {r('value', 2)} AS value FROM wc", 2)(
    lambda s, d: (lambda w: melt(w, "gene", w.columns[1:]))(PR.one_unit(_wide(s, d).select("gene", *[F.col(c).alias(f"{c}_counts") for c in NATIONS], *[(F.col(c) * 3).alias(f"{c}_FPKM") for c in NATIONS]))))
query("p17_summary_columns", f"WITH {_CELLS} SELECT feature_id, sample_id, {r('value', 2)} AS value FROM wc", 2)(
    lambda s, d: (lambda w: melt(w, "gene", w.columns[1:]))(PR.drop_summaries(_wide(s, d).withColumn(
        "extra", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in NATIONS[1:]), F.coalesce(F.col(NATIONS[0]), F.lit(0.0)))).withColumn("Mean intensity", F.col("extra") / 25))))
query("p20_numeric_columns", f"WITH {_CELLS} SELECT feature_id, count(*) AS n FROM wc GROUP BY 1")(
    lambda s, d: (lambda w: melt(w, w.columns[0], w.columns[1:]).groupBy("feature_id").agg(F.count("*").alias("n")))(
        PR.numeric_columns(_wide(s, d).select("gene", *[F.col(c).cast("string").alias(c) for c in NATIONS], F.concat(F.lit("about part "), "gene").alias("description"), F.lit(None).cast("string").alias("empty")))))
_MARK = "CASE WHEN l_quantity < 5 THEN 'n/a' WHEN l_quantity < 10 THEN '<LOD' WHEN l_quantity < 12 THEN 'many' ELSE l_quantity::VARCHAR END"
query("p16_cell_marks", "SELECT 'cell' AS column_name, count(*) FILTER (l_quantity < 5) AS n_missing, count(*) FILTER (l_quantity >= 5 AND l_quantity < 10) AS n_marks, count(*) FILTER (l_quantity >= 10 AND l_quantity < 12) AS n_text FROM lineitem")(
    lambda s, d: DL.cell_errors(TT.table(s, d, "lineitem").select(F.when(F.col("l_quantity") < 5, "n/a").when(F.col("l_quantity") < 10, "<LOD").when(F.col("l_quantity") < 12, "many").otherwise(F.col("l_quantity").cast("string")).alias("cell")), ["cell"]))
query("a20_table_profile", "SELECT column_name, avg((try_cast(cell AS DOUBLE) IS NOT NULL)::INT::DOUBLE) AS numeric_fraction FROM (UNPIVOT (SELECT p_name, p_size::VARCHAR AS p_size, p_brand FROM part) ON p_name, p_size, p_brand INTO NAME column_name VALUE cell) GROUP BY 1")(
    lambda s, d: PR.profile(TT.table(s, d, "part").select("p_name", F.col("p_size").cast("string").alias("p_size"), "p_brand")).select("column_name", "numeric_fraction"))
query("a21_orientation_labels", "SELECT count(*) AS n, avg(regexp_matches(l, '^ENS[A-Z]*G[0-9]{6,}')::INT::DOUBLE) AS feature_like, avg(regexp_matches(l, '^ENS[A-Z]*G[0-9]{6,}')::INT::DOUBLE) AS strongly_feature_like FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'x ' || p_partkey ELSE 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0') END AS l FROM part)")(
    lambda s, d: PR.label_rates(TT.table(s, d, "part").select(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("x "), "p_partkey")).otherwise(F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"))).alias("l")), "l").select("n", "feature_like", "strongly_feature_like"))
_VN = "'[' || p_size || '] D:/runs/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.sorted.bam'"
query("f6_vendor_names", "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_partkey AS sample FROM part")(
    lambda s, d: TT.table(s, d, "part").select("p_partkey", PR.plain_sample_column(F.concat(F.lit("["), "p_size", F.lit("] D:/runs/"), F.translate("p_name", " ", "_"), F.lit("_"), "p_partkey", F.lit(".sorted.bam"))).alias("sample")))
query("p29_choose_tables", "SELECT 'matrix' AS role, 'lines' AS table_name, (SELECT count(*) FROM lineitem) AS n_rows UNION ALL SELECT 'sample_metadata', 'customers', (SELECT count(*) FROM customer)")(
    lambda s, d: (lambda n: s.createDataFrame([(k, t, n[t]) for k, t in PR.choose_tables({"lines": ("matrix", 0.8), "few": ("matrix", 0.8), "customers": ("unknown", 0.2)}, n, {"customers": "sample_metadata"}).items()],
                                              "role string, table_name string, n_rows long"))({"lines": TT.table(s, d, "lineitem").count(), "few": TT.table(s, d, "orders").count(), "customers": TT.table(s, d, "customer").count()}))


def _quant_files(s, d):
    """Salmon-like files, one folder per return flag."""
    li = TT.table(s, d, "lineitem").groupBy("l_returnflag", F.concat(F.lit("T"), "l_partkey", F.lit("|x")).alias("Name")).agg(F.sum("l_quantity").alias("NumReads"))
    path = scratch_path(s, "quant")
    paths = []
    for flag in ("A", "N", "R"):
        p = f"{path}/sample_{flag}"
        li.where(F.col("l_returnflag") == flag).select("Name", F.lit(1000).alias("Length"), (F.length("Name") * 100 - 400).alias("EffectiveLength"), (F.col("NumReads") / 10).alias("TPM"), "NumReads").coalesce(1).write.csv(p, sep="\t", header=True)
        paths.append(p)
    return paths




query("s4_quant_files", f"SELECT 'T'||l_partkey AS feature_id, count(DISTINCT l_returnflag) AS n, {r('sum(l_quantity)', 2)} AS value FROM lineitem GROUP BY 1", 2)(
    lambda s, d: SL.read_quant(s, _quant_files(s, d))[0].groupBy("feature_id").agg(F.count_distinct("sample_id").alias("n"), F.sum("value").alias("value")))
query("u6_id_sets_differ", "SELECT 'T'||l_partkey AS feature_id, 'missing in a file' AS problem FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) < 3")(
    lambda s, d: SL.read_quant(s, _quant_files(s, d))[1].select("feature_id", "problem"))
query("s5_sample_names", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'run'||p_partkey WHEN 1 THEN 'ctrl_'||p_partkey ELSE 's'||p_partkey END AS sample FROM part")(
    lambda s, d: TT.table(s, d, "part").select("p_partkey", SL.quant_sample(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/data/run"), "p_partkey", F.lit(".genes.results"))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("/data/ctrl_"), "p_partkey", F.lit("/quant.sf"))).otherwise(F.concat(F.lit("s"), "p_partkey", F.lit("_abundance.tsv.gz")))).alias("sample")))


def _assays(s, d):
    y, k = TT.prices(s, d), TT.counts(s, d)
    path = scratch_path(s, "assays")
    SL.write_assays(path, {"price": y.cells, "counts": k.cells}, y.samples, y.features)
    return SL.read_assays(s, path, ["price", "counts"], "rnaseq", "raw_count")


query("s8_assay_folder", f"WITH {TT.COUNTS_SQL} SELECT feature_id, sample_id, {r('value', 2)} AS value FROM cells", 2)(lambda s, d: _assays(s, d).cells)


def _stored_sets(s, d):
    path = scratch_path(s, "sets")
    SL.write_gene_sets(TT.gene_sets(s, d), path)
    return path


query("s9_read_gene_sets", f"WITH {TT.FEATURES_SQL}, {TT.GENE_SETS_SQL} SELECT database, gs_name, gene_symbol, count(*) AS n FROM gene_sets WHERE database IN ('size', 'name') GROUP BY 1, 2, 3")(
    lambda s, d: SL.read_gene_sets(s, _stored_sets(s, d), ["size", "name"], "Hs").groupBy("database", "gs_name", "gene_symbol").agg(F.count("*").alias("n")))
query("s13_snapshot_status", f"WITH {TT.FEATURES_SQL}, {TT.GENE_SETS_SQL} SELECT database, organism, count(DISTINCT gs_name) AS n_sets, count(DISTINCT gene_symbol) AS n_genes, count(*) AS n_rows FROM gene_sets GROUP BY 1, 2")(
    lambda s, d: SL.gene_set_status(SL.read_gene_sets(s, _stored_sets(s, d))))
query("s13_snapshot_from_links", "SELECT DISTINCT 'kegg' AS database, 'Hs' AS organism, p_brand AS gs_name, 'SYM'||p_partkey AS gene_symbol, 'path:'||p_brand AS gs_id FROM part WHERE p_size % 2 = 0")(
    lambda s, d: (lambda p: SL.snapshot_from_links(
        p.select(F.concat(F.lit("hsa:"), "p_partkey").alias("gene"), F.concat(F.lit("path:"), "p_brand").alias("pathway")), p.select(F.concat(F.lit("path:"), "p_brand").alias("pathway"), F.col("p_brand").alias("name")).distinct(),
        p.select(F.concat(F.lit("hsa:"), "p_partkey").alias("gene"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("SYM"), "p_partkey", F.lit(", OTHER; a gene"))).otherwise("no symbol").alias("annotation")), "kegg", "Hs"))(
        TT.table(s, d, "part")).select("database", "organism", "gs_name", "gene_symbol", "gs_id"))
query("s14_export", f"WITH {FX.DIFF_SQL} SELECT comparison, feature_id, {r('effect', 8)} AS effect, direction FROM diff", 8)(
    lambda s, d: (lambda path: (SL.export_result({"diff": FX.diff(s, d)}, {"method": "ttest"}, path), s.read.csv(f"{path}/diff", sep="\t", header=True))[1].select(
        "comparison", "feature_id", F.col("effect").cast("double").alias("effect"), "direction"))(scratch_path(s, "export")))
query("s15_flatten", "SELECT p_brand, string_agg(t, ';' ORDER BY t) AS types FROM (SELECT DISTINCT p_brand, p_type AS t FROM part) GROUP BY 1")(
    lambda s, d: SL.flatten(TT.table(s, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))))


def _project(s, d):
    path = scratch_path(s, "project")
    SL.save_project(s, Project({"protein": TT.prices(s, d), "rna": TT.counts(s, d)}), path)
    p = SL.load_project(s, path)
    side = lambda t: p.layers[t].cells.groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).withColumn("tag", F.lit(t))
    return side("protein").unionByName(side("rna"))


query("s17_project_round_trip", f"WITH {TT.PRICES_SQL}, q AS (SELECT 'P'||l_partkey AS feature_id, 'N'||s_nationkey||'Y'||year AS sample_id, round(sum(l_quantity), 2) AS value FROM lines GROUP BY l_partkey, s_nationkey, year) SELECT 'protein' AS tag, sample_id, count(*) AS n, {r('sum(value)', 2)} AS total FROM cells GROUP BY 2 UNION ALL SELECT 'rna', sample_id, count(*), {r('sum(value)', 2)} FROM q GROUP BY 2", 2)(_project)
