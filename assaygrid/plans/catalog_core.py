"""Queries: model, selections, aggregates, quality control, imputation, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid import model as M
from assaygrid.functions import ordering as O
from assaygrid.functions import scalar as S
from assaygrid.operators import cells as C
from assaygrid.operators import gram as G
from assaygrid.operators import impute as I
from assaygrid.operators import links as L
from assaygrid.operators import normalize as N
from assaygrid.operators import qc as Q
from assaygrid.operators import vsn as VS
from assaygrid.plans import testtables as TT
from assaygrid.plans.registry import query, r

P, K, V, E = TT.PRICES_SQL, TT.COUNTS_SQL, TT.VECTORS_SQL, TT.EVENTS_SQL
LOGP = P + TT.LOG_SQL
B = TT.brands_sql()

# ---- model ---------------------------------------------------------------------------------

query("m1_layer", f"WITH {P} SELECT feature_id, sample_id, {r('value', 2)} AS value, feature_symbol, grp FROM cells JOIN features USING (feature_id) JOIN samples USING (sample_id)", 2)(
    lambda s, d: (lambda y: y.cells.join(y.features.select("feature_id", "feature_symbol"), "feature_id").join(
        y.per_sample(y.samples.select("sample_id", "grp")), "sample_id").select("feature_id", "sample_id", "value", "feature_symbol", "grp"))(TT.prices(s, d)))


def _broken(s, d):
    """The price layer with one region's sample rows missing and one brand's features listed twice."""
    y = TT.prices(s, d)
    twice = y.features.unionByName(y.features.where("p_brand = 'Brand#7'"))
    return M.Layer(y.cells, y.samples.where("grp <> 'ASIA'"), twice, y.omics_type, y.assay_type)


query("m2_violations", f"""WITH {P}, s2 AS (SELECT * FROM samples WHERE grp <> 'ASIA'),
f2 AS (SELECT * FROM features UNION ALL SELECT * FROM features WHERE p_brand = 'Brand#7')
SELECT 'duplicate_feature' AS rule, feature_id AS id FROM f2 GROUP BY feature_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'cell_without_sample', sample_id FROM cells WHERE sample_id NOT IN (SELECT sample_id FROM s2)
UNION ALL SELECT DISTINCT 'cell_without_feature', feature_id FROM cells WHERE feature_id NOT IN (SELECT feature_id FROM f2)
UNION ALL SELECT 'sample_without_cell', sample_id FROM s2 WHERE sample_id NOT IN (SELECT sample_id FROM cells)
UNION ALL SELECT 'feature_without_cell', feature_id FROM f2 WHERE feature_id NOT IN (SELECT feature_id FROM cells)""")(
    lambda s, d: M.violations(_broken(s, d)))

query("m3_infer_assay", f"""WITH {K}, p AS (SELECT sample_id, sum(value) lib, max(value) hi, min(value) lo, max((value <> floor(value))::INT) fr FROM cells GROUP BY 1)
SELECT {r('max(hi)')} AS max_value, {r('min(lo)')} AS min_value, CASE WHEN max(hi) > 100 THEN 'raw_intensity' ELSE 'normalized_intensity' END AS proteomics_guess,
CASE WHEN min(lo) < 0 THEN 'logcpm' WHEN max(fr) = 0 THEN 'raw_count' WHEN max(hi) < 30 THEN 'logcpm'
 WHEN min(lib) >= 8e5 AND max(lib) <= 1.01e6 AND max(lib) / min(lib) <= 1.2 THEN 'tpm' WHEN median(lib) >= 2e6 THEN 'raw_count' ELSE 'fpkm' END AS rnaseq_guess FROM p""")(
    lambda s, d: M.infer_assay(TT.counts(s, d)))

query("m4_scale_check", f"WITH {P} SELECT 'raw_intensity' AS assay_type, {r('max(value)')} AS max_value, max(value) <= 100 AS scale_mismatch FROM cells")(
    lambda s, d: M.scale_check(TT.prices(s, d)))

query("m5_summary", f"""WITH {P}, n AS (SELECT (SELECT count(*) FROM samples)::DOUBLE AS ns, (SELECT count(*) FROM features)::DOUBLE AS nf, (SELECT count(*) FROM cells)::DOUBLE AS nc)
SELECT 'protein' AS tag, 'proteomics' AS omics_type, 'raw_intensity' AS assay_type, ns AS n_samples, nf AS n_features, nf * ns - nc AS n_missing,
round(100 * (nf * ns - nc) / (nf * ns), 3) AS missing_pct, 5 AS n_meta_cols, 'feature_id, feature_symbol, feature_type, p_brand, p_type, p_size, p_name' AS feature_columns FROM n""")(
    lambda s, d: M.summarize({"protein": TT.prices(s, d)}))

# ---- selections ----------------------------------------------------------------------------


def _sub(y, digits=2):
    return y.cells.select("feature_id", "sample_id", "value")


query("p1_keep_samples", f"WITH {P} SELECT feature_id, sample_id, {r('value', 2)} AS value FROM cells WHERE sample_id IN (SELECT sample_id FROM samples WHERE batch = 'b1')", 2)(
    lambda s, d: (lambda y: _sub(C.keep_samples(y, y.samples.where("batch = 'b1'"))))(TT.prices(s, d)))
query("p2_keep_features", f"WITH {P} SELECT feature_id, sample_id, {r('value', 2)} AS value FROM cells WHERE feature_id IN (SELECT feature_id FROM features WHERE p_brand IN ('Brand#7', 'Brand#8'))", 2)(
    lambda s, d: (lambda y: _sub(C.keep_features(y, y.features.where("p_brand in ('Brand#7', 'Brand#8')"))))(TT.prices(s, d)))


def _gappy(s, d):
    from dataclasses import replace

    y = TT.prices(s, d)
    return replace(y, samples=y.samples.withColumn("balance", F.when(F.col("balance") > 4000, F.col("balance"))))


query("p3_drop_unlabelled", f"WITH {P} SELECT feature_id, sample_id, {r('value', 2)} AS value FROM cells JOIN samples USING (sample_id) WHERE balance > 4000", 2)(
    lambda s, d: _sub(C.drop_unlabelled(_gappy(s, d), ["balance"])))
_MISS = "(1 - count(value)::DOUBLE / (SELECT count(*) FROM samples))"
_FM = "fm AS (SELECT f.feature_id, 1 - count(c.value)::DOUBLE / (SELECT count(*) FROM samples) AS missing_rate FROM features f LEFT JOIN cells c USING (feature_id) GROUP BY 1)"
_SM = "sm AS (SELECT s.sample_id, 1 - count(c.value)::DOUBLE / (SELECT count(*) FROM features) AS missing_rate FROM samples s LEFT JOIN cells c USING (sample_id) GROUP BY 1)"
_GM = """gs AS (SELECT grp, count(*) AS n FROM samples GROUP BY 1), gc AS (SELECT feature_id, grp, count(*) AS k FROM cells JOIN samples USING (sample_id) GROUP BY 1, 2),
gm AS (SELECT f.feature_id, gs.grp, 1 - coalesce(k, 0)::DOUBLE / n AS missing_rate FROM features f CROSS JOIN gs LEFT JOIN gc ON gc.feature_id = f.feature_id AND gc.grp = gs.grp)"""
query("p4_missing_filter", f"WITH {P}, {_FM} SELECT feature_id, {r('missing_rate')} AS missing_rate FROM fm WHERE missing_rate <= 0.85")(
    lambda s, d: C.keep_by_missing(TT.prices(s, d), 0.85))
query("p27_group_missing_any", f"WITH {P}, {_GM} SELECT feature_id, {r('min(missing_rate)')} AS filter_missing_rate FROM gm GROUP BY 1 HAVING min(missing_rate) <= 0.8")(
    lambda s, d: C.keep_by_group_missing(TT.prices(s, d), "grp", 0.8, "any_group"))
query("p27_group_missing_all", f"WITH {P}, {_GM} SELECT feature_id, {r('max(missing_rate)')} AS filter_missing_rate FROM gm GROUP BY 1 HAVING max(missing_rate) <= 0.9")(
    lambda s, d: C.keep_by_group_missing(TT.prices(s, d), "grp", 0.9, "all_groups"))


def _raw_counts(s, d):
    """Cells with planted trouble: NULLs, infinities, negatives and counts past the integer range."""
    return TT.counts(s, d).cells.withColumn("value", F.expr(
        "case when value = 7 then null when value = 11 then cast('Infinity' as double) when value = 13 then -value when value > 90 then value * 1e9 else value end"))


_RAW = "raw AS (SELECT feature_id, sample_id, CASE WHEN value = 7 THEN NULL WHEN value = 11 THEN 'Infinity'::DOUBLE WHEN value = 13 THEN -value WHEN value > 90 THEN value * 1e9::DOUBLE ELSE value END AS value FROM cells)"
query("p9_count_preflight", f"""WITH {K}, {_RAW} SELECT count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (isinf(value)) AS not_finite,
count(*) FILTER (value < 0) AS negative, count(*) FILTER (value > 2147483647 AND NOT isinf(value)) AS too_large,
(SELECT count(*) FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM cells WHERE value > 0)) AS empty_samples FROM raw""")(
    lambda s, d: C.count_preflight(TT.counts(s, d), _raw_counts(s, d)))
query("p10_finite", f"WITH {K}, {_RAW} SELECT feature_id, sample_id, CASE WHEN NOT isinf(value) THEN value END AS value FROM raw")(
    lambda s, d: _raw_counts(s, d).withColumn("value", S.finite_or_null(F.col("value"))))
query("p11_expression_filter", f"""WITH {K}, l AS (SELECT sample_id, sum(value) lib FROM cells GROUP BY 1), g AS (SELECT min(n) mn FROM (SELECT count(*) n FROM samples GROUP BY grp))
SELECT feature_id, sum((value / lib * 1e6 >= 10 / (SELECT median(lib) FROM l) * 1e6)::INT) AS n_above, {r('sum(value)')} AS total FROM cells JOIN l USING (sample_id) GROUP BY 1
HAVING sum((value / lib * 1e6 >= 10 / (SELECT median(lib) FROM l) * 1e6)::INT) >= (SELECT CASE WHEN mn > 10 THEN 10 + (mn - 10) * 0.7 ELSE mn END FROM g) - 1e-14 AND sum(value) >= 15""")(
    lambda s, d: C.expressed_features(TT.counts(s, d), "grp"))
query("p12_read_support", f"WITH {K} SELECT feature_id, sum((value >= 10)::INT) AS n_above FROM cells GROUP BY 1 HAVING sum((value >= 10)::INT) >= 25")(
    lambda s, d: C.read_support(TT.counts(s, d), 25))


def _par_y(s, d):
    from dataclasses import replace

    y = TT.counts(s, d)
    f = F.when(F.col("p_size") <= 10, F.concat("feature_id", F.lit("_PAR_Y"))).otherwise(F.col("feature_id"))
    marks = y.features.select("feature_id", "p_size")
    cells = y.cells.join(marks, "feature_id").select(f.alias("feature_id"), "sample_id", F.when(F.col("p_size") <= 5, 0.0).otherwise(F.col("value")).alias("value"))
    return replace(y, cells=cells, features=y.features.withColumn("feature_id", f))


query("p21_par_y", f"WITH {K} SELECT feature_id||'_PAR_Y' AS feature_id FROM features WHERE p_size <= 10 AND (p_size <= 5 OR feature_id NOT IN (SELECT feature_id FROM cells WHERE value <> 0))")(
    lambda s, d: C.par_y_empty(_par_y(s, d)))
_RV = "rv AS (SELECT feature_id, avg(value) AS row_mean, var_pop(value) * count(*) / ((SELECT count(*) FROM samples) - 1) AS row_var FROM lcells GROUP BY 1)"
query("p22_drop_constant", f"WITH {LOGP}, {_RV} SELECT feature_id, {r('row_mean')} AS row_mean, {r('row_var')} AS row_var FROM rv WHERE row_var > 0")(
    lambda s, d: C.drop_constant(N.analysis_scale(TT.prices(s, d))))
query("p23_complete_features", f"WITH {B} SELECT feature_id FROM cells GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM samples)")(
    lambda s, d: C.complete_features(TT.brands(s, d)))

_WIDE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _wide(s, d):
    li = TT.table(s, d, "lineitem")
    return li.groupBy(F.concat(F.lit("P"), "l_partkey").alias("part")).agg(*[F.round(F.sum(c), 2).alias(c) for c in _WIDE])


_WIDE_SQL = "wide AS (SELECT 'P'||l_partkey AS part, " + ", ".join(f"round(sum({c}), 2) AS {c}" for c in _WIDE) + " FROM lineitem GROUP BY 1)"
query("p28_melt", f"WITH {_WIDE_SQL} " + " UNION ALL ".join(f"SELECT part AS feature_id, '{c}' AS sample_id, {c} AS value FROM wide" for c in _WIDE), 2)(
    lambda s, d: C.melt(_wide(s, d), "part", list(_WIDE)))
query("p28_melt_transposed", f"WITH {_WIDE_SQL} " + " UNION ALL ".join(f"SELECT part AS sample_id, '{c}' AS feature_id, {c} AS value FROM wide" for c in _WIDE), 2)(
    lambda s, d: C.melt(_wide(s, d), "part", list(_WIDE), samples_in_rows=True))

# ---- aggregates ----------------------------------------------------------------------------

query("a1_missing_by_feature", f"WITH {P}, {_FM} SELECT feature_id, {r('missing_rate')} AS missing_rate FROM fm")(lambda s, d: C.feature_missing(TT.prices(s, d)))
query("a1_missing_by_sample", f"WITH {P}, {_SM} SELECT sample_id, {r('missing_rate')} AS missing_rate FROM sm")(lambda s, d: C.sample_missing(TT.prices(s, d)))
query("a2_missing_by_group", f"WITH {P}, {_GM} SELECT feature_id, grp, {r('missing_rate')} AS missing_rate FROM gm")(lambda s, d: C.group_missing(TT.prices(s, d), "grp"))
_DEPTH = """dp AS (SELECT s.sample_id, coalesce(sum(value), 0)::DOUBLE AS library_size, count(value) FILTER (value > 0) AS n_detected FROM samples s LEFT JOIN cells USING (sample_id) GROUP BY 1)"""
_DEPTHQ = f"SELECT sample_id, {r('library_size', 2)} AS library_size, n_detected, {r('n_detected::DOUBLE / (SELECT count(*) FROM features)')} AS detection_rate, {r('library_size / (SELECT median(library_size) FROM dp)')} AS library_size_ratio FROM dp"


def _depth(df):
    return df.select("sample_id", F.round("library_size", 2).alias("library_size"), "n_detected", "detection_rate", "library_size_ratio")


query("a3_depth", f"WITH {K}, {_DEPTH} {_DEPTHQ}")(lambda s, d: _depth(Q.depth(TT.counts(s, d))))
query("q2_depth_events", f"WITH {E}, {_DEPTH} {_DEPTHQ}")(lambda s, d: _depth(Q.depth(TT.event_counts(s, d))))
query("p8_depth_outliers", f"WITH {E}, {_DEPTH} SELECT * FROM ({_DEPTHQ}) WHERE library_size_ratio < 0.95")(
    lambda s, d: _depth(Q.depth_outliers(Q.depth(TT.event_counts(s, d)), 0.95)))
query("a4_library_sizes", f"WITH {K} SELECT sample_id, {r('sum(value)', 2)} AS lib FROM cells GROUP BY 1", 2)(lambda s, d: N.library_sizes(TT.counts(s, d)))
query("a5_row_moments", f"WITH {LOGP}, {_RV} SELECT feature_id, {r('row_mean')} AS row_mean, {r('row_var')} AS row_var FROM rv")(
    lambda s, d: C.row_moments(N.analysis_scale(TT.prices(s, d))))
query("a6_sample_quantiles", f"""WITH {P} SELECT sample_id, count(*) AS n, {r('quantile_cont(value, 0.25::DOUBLE)', 4)} AS q25, {r('quantile_cont(value, 0.5::DOUBLE)', 4)} AS q50, {r('quantile_cont(value, 0.99::DOUBLE)', 4)} AS q99 FROM cells GROUP BY 1""", 4)(
    lambda s, d: O.exact_quantiles(TT.prices(s, d).cells, ["sample_id"], "value", [0.25, 0.5, 0.99], ["q25", "q50", "q99"], few=True))
query("a7_quantile_sketch", f"WITH {LOGP} SELECT i::INT AS i, {r('quantile_cont(value, i / 1000.0::DOUBLE)')} AS value FROM lcells, range(0, 1001) t(i) GROUP BY i".replace(
    "quantile_cont(value, i / 1000.0::DOUBLE)", "q[i + 1]").replace("FROM lcells, range(0, 1001) t(i) GROUP BY i",
    "FROM (SELECT quantile_cont(value, [" + ", ".join(f"{i / 1000}::DOUBLE" for i in range(1001)) + "]) AS q FROM lcells), range(0, 1001) t(i)"))(
    lambda s, d: O.spread_quantiles(N.analysis_scale(TT.prices(s, d)).cells, [], "value", 1001).select("i", "value"))
query("a7_bandwidth", f"""WITH {LOGP}, b AS (SELECT grp, value FROM lcells JOIN samples USING (sample_id)),
q AS (SELECT grp, count(*) n, quantile_cont(value, 0.25::DOUBLE) q1, quantile_cont(value, 0.75::DOUBLE) q3, stddev_samp(value) sd FROM b GROUP BY 1)
SELECT grp, n, {r('0.9::DOUBLE * least(sd, (q3 - q1) / 1.34::DOUBLE) * pow(n::DOUBLE, -0.2::DOUBLE)')} AS bandwidth FROM q""")(
    lambda s, d: (lambda y: Q.bandwidths(y.cells.join(y.per_sample(y.samples.select("sample_id", "grp")), "sample_id").select("grp", "value"), ["grp"]))(N.analysis_scale(TT.prices(s, d))))
query("a16_top_variance", f"WITH {LOGP}, {_RV} SELECT feature_id, {r('row_mean')} AS row_mean, {r('row_var')} AS row_var FROM features f LEFT JOIN rv USING (feature_id) ORDER BY row_var DESC NULLS LAST, feature_id LIMIT 50")(
    lambda s, d: C.top_by_variance(N.analysis_scale(TT.prices(s, d)), 50))
query("a17_missing_histogram", f"WITH {P}, {_FM}, n AS (SELECT count(*)::DOUBLE AS k FROM samples) SELECT floor(round(missing_rate * k) / k * 25)::BIGINT AS bin, missing_rate > 0.85 AS removed, count(*) AS n FROM fm, n GROUP BY 1, 2")(
    lambda s, d: (lambda y: C.feature_missing(y).withColumn("k", y.n_samples()).groupBy(
        F.floor(F.round(F.col("missing_rate") * F.col("k")) / F.col("k") * 25).alias("bin"), (F.col("missing_rate") > 0.85).alias("removed")).agg(F.count("*").alias("n")))(TT.prices(s, d)))
query("a23_one_feature_per_symbol", f"""WITH {LOGP}, m AS (SELECT feature_id, feature_symbol, avg(value) v FROM lcells JOIN features USING (feature_id) GROUP BY 1, 2)
SELECT feature_symbol, feature_id, {r('v')} AS row_mean FROM (SELECT *, row_number() OVER (PARTITION BY feature_symbol ORDER BY v DESC, feature_id) k FROM m) WHERE k = 1""")(
    lambda s, d: C.strongest_per_symbol(N.analysis_scale(TT.prices(s, d))))
query("a25_grouping_candidates", f"""WITH {P}, long AS (SELECT 'grp' c, grp v FROM samples UNION ALL SELECT 'nation', nation FROM samples UNION ALL SELECT 'year', year::VARCHAR FROM samples UNION ALL SELECT 'batch', batch FROM samples),
lv AS (SELECT c, v, count(*) n FROM long GROUP BY 1, 2), pc AS (SELECT c, count(*) n_levels, min(n) smallest, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) num FROM lv GROUP BY 1)
SELECT c AS column_name, n_levels, smallest, CASE c WHEN 'grp' THEN 0 WHEN 'batch' THEN 2 ELSE 1 END AS preference FROM pc WHERE n_levels >= 2 AND smallest >= 2 AND (NOT num OR n_levels <= 6)""")(
    lambda s, d: C.candidate_groups(TT.prices(s, d).samples, ["grp", "nation", "year", "batch"], ("grp", "group"), ("batch",)))
query("a26_pairing_candidates", f"""WITH {TT.FLAGGED_SQL}, b AS (SELECT donor, count(*) n, count(DISTINCT grp) g FROM samples GROUP BY 1)
SELECT 'donor' AS column_name, count(*) AS n_blocks, sum(n)::BIGINT AS n_rows, min(n) AS smallest, {r('avg((g >= 2)::INT)')} AS spanning FROM b HAVING min(n) >= 2 AND count(*) < sum(n) AND avg((g >= 2)::INT) >= 0.5""")(
    lambda s, d: C.candidate_pairs(TT.flagged(s, d).samples, ["donor"], "grp"))

# ---- scalar functions ----------------------------------------------------------------------

query("f1_join_key", "SELECT p_partkey, nullif(upper(trim(p_name)), '') AS k FROM part")(
    lambda s, d: TT.table(s, d, "part").select("p_partkey", S.join_key(F.col("p_name")).alias("k")))
_ENS = "CASE WHEN p_size % 3 = 0 THEN 'ENSG'||lpad(p_partkey::VARCHAR, 11, '0')||'.'||p_size WHEN p_size % 3 = 1 THEN 'ENSG'||lpad(p_partkey::VARCHAR, 11, '0')||'.'||p_size||'_PAR_Y' ELSE 'ENSMUSG'||lpad(p_partkey::VARCHAR, 11, '0') END"


def _ens(s, d):
    num = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    e = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("ENSG"), num, F.lit("."), "p_size")).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("ENSG"), num, F.lit("."), "p_size", F.lit("_PAR_Y"))).otherwise(F.concat(F.lit("ENSMUSG"), num))
    return TT.table(s, d, "part").withColumn("gene_id", e)


query("f2_strip_version", f"WITH g AS (SELECT {_ENS} AS gene_id FROM part) SELECT gene_id, regexp_replace(gene_id, '\\.[0-9]+(_PAR_Y)?$', '\\1') AS bare, regexp_replace(regexp_replace(gene_id, '\\.[0-9]+(_PAR_Y)?$', '\\1'), '_PAR_Y$', '') AS base FROM g")(
    lambda s, d: _ens(s, d).select("gene_id", S.strip_version(F.col("gene_id")).alias("bare"), S.ensembl_base(F.col("gene_id")).alias("base")))
HUMAN, MOUSE = r"^ENSG\d{6,}(\.\d+)?(_PAR_Y)?$", r"^ENSMUSG\d{6,}(\.\d+)?(_PAR_Y)?$"
query("f3_species", f"WITH g AS (SELECT {_ENS} AS gene_id FROM part) SELECT CASE WHEN avg(regexp_matches(gene_id, '{HUMAN}')::INT) >= 0.5 THEN 'human' WHEN avg(regexp_matches(gene_id, '{MOUSE}')::INT) >= 0.5 THEN 'mouse' END AS species FROM g")(
    lambda s, d: _ens(s, d).agg(F.when(F.avg(F.col("gene_id").rlike(HUMAN).cast("int")) >= 0.5, "human").when(F.avg(F.col("gene_id").rlike(MOUSE).cast("int")) >= 0.5, "mouse").alias("species")))
_ACC = "CASE WHEN p_size % 2 = 0 THEN 'p'||lpad((p_partkey % 100000)::VARCHAR, 5, '0')||'-'||(p_size % 4 + 1) ELSE p_name END"
query("f4_canonical", f"WITH g AS (SELECT p_partkey, {_ACC} AS acc FROM part) SELECT p_partkey, CASE WHEN regexp_matches(upper(trim(acc)), '{S.ISOFORM}') THEN regexp_replace(upper(trim(acc)), '-[0-9]+$', '') END AS canonical FROM g")(
    lambda s, d: TT.table(s, d, "part").select("p_partkey", S.canonical_accession(F.when(F.col("p_size") % 2 == 0, F.concat(
        F.lit("p"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit("-"), F.col("p_size") % 4 + 1)).otherwise(F.col("p_name"))).alias("canonical")))
query("f5_first_symbol", "SELECT p_partkey, nullif(trim(regexp_replace(trim(replace(p_name, ' ', ';')), '[;,].*$', '')), '') AS symbol FROM part")(
    lambda s, d: TT.table(s, d, "part").select("p_partkey", S.first_symbol(F.translate("p_name", " ", ";")).alias("symbol")))
_COLNAME = "CASE p_size % 5 WHEN 0 THEN p_brand||'_FPKM' WHEN 1 THEN p_brand||'_counts' WHEN 2 THEN p_brand||'_a_tpm' WHEN 3 THEN p_brand||'_readcount' ELSE p_brand END"


def _colname(s, d):
    b = F.col("p_brand")
    k = F.col("p_size") % 5
    return TT.table(s, d, "part").withColumn("name", F.when(k == 0, F.concat(b, F.lit("_FPKM"))).when(k == 1, F.concat(b, F.lit("_counts"))).when(
        k == 2, F.concat(b, F.lit("_a_tpm"))).when(k == 3, F.concat(b, F.lit("_readcount"))).otherwise(b))


query("f7_measure_suffix", f"WITH g AS (SELECT p_partkey, lower(regexp_extract({_COLNAME}, '_([A-Za-z]+)$', 1)) AS w FROM part) SELECT p_partkey, CASE WHEN w IN ('count', 'counts', 'readcount') THEN 'count' WHEN w IN ('fpkm', 'tpm', 'cpm', 'rpkm') THEN w END AS unit FROM g")(
    lambda s, d: _colname(s, d).select("p_partkey", S.measure_suffix(F.col("name")).alias("unit")))
query("f8_numeric_text", "WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN '1,'||lpad(l_quantity::INT::VARCHAR, 3, '0') WHEN l_quantity < 5 THEN 'n/a' ELSE l_quantity::VARCHAR END AS t FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN regexp_matches(t, '^[-+]?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$') THEN try_cast(replace(t, ',', '') AS DOUBLE) ELSE try_cast(t AS DOUBLE) END, 6) + 0.0::DOUBLE AS v FROM g")(
    lambda s, d: TT.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.numeric_text(F.when(F.col("l_quantity") > 25, F.concat(
        F.lit("1,"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"))).when(F.col("l_quantity") < 5, "n/a").otherwise(F.col("l_quantity").cast("string"))).alias("v")))
query("f9_not_numeric", "SELECT o_orderkey, o_orderpriority FROM orders WHERE try_cast(trim(o_orderpriority) AS DOUBLE) IS NULL AND trim(o_orderpriority) <> ''")(
    lambda s, d: C.pair_numeric(TT.table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"))
query("f10_id_text", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey * 1000000000)::VARCHAR END AS id FROM customer")(
    lambda s, d: TT.table(s, d, "customer").select("c_custkey", S.id_text(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("double") * 1e9)).alias("id")))
query("f14_set_names", f"WITH {TT.FEATURES_SQL}, {TT.GENE_SETS_SQL} SELECT DISTINCT gs_name, trim(replace(regexp_replace(gs_name, '^(KEGG_|REACTOME_|GOBP_)', ''), '_', ' ')) AS name FROM gene_sets")(
    lambda s, d: TT.gene_sets(s, d).select("gs_name").distinct().withColumn("name", S.pretty_set_name(F.col("gs_name"))))
query("f17_overlap_size", "SELECT p_partkey, p_size::DOUBLE AS k FROM part")(
    lambda s, d: TT.table(s, d, "part").select("p_partkey", S.overlap_count(F.concat_ws("/", F.col("p_size").cast("string"), F.lit("50"))).alias("k")))
query("f21_file_safe", "SELECT p_partkey, regexp_replace(p_name||' '||p_brand, '[^A-Za-z0-9._]', '_', 'g') AS f FROM part")(
    lambda s, d: TT.table(s, d, "part").select("p_partkey", S.file_safe(F.concat_ws(" ", "p_name", "p_brand")).alias("f")))
query("f22_log_scales", f"WITH {P} SELECT feature_id, sample_id, {r('log2(value)')} AS l2, {r('log2(value + 1)')} AS l2p, {r('pow(2.0::DOUBLE, log2(value))', 2)} AS back FROM cells")(
    lambda s, d: TT.prices(s, d).cells.select("feature_id", "sample_id", F.log2("value").alias("l2"), F.log2(F.col("value") + 1).alias("l2p"), F.round(F.pow(F.lit(2.0), F.log2("value")), 2).alias("back")))
query("f23_kegg_symbol", "WITH g AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_name)||', ALT; text' ELSE p_name END AS t FROM part) SELECT p_partkey, CASE WHEN contains(t, ';') THEN nullif(trim(regexp_extract(t, '^([^,;]*)', 1)), '') END AS symbol FROM g")(
    lambda s, d: TT.table(s, d, "part").select("p_partkey", S.kegg_symbol(F.when(F.col("p_size") % 2 == 0, F.concat(F.upper("p_name"), F.lit(", ALT; text"))).otherwise(F.col("p_name"))).alias("symbol")))

# ---- windows, joins and sets over layers ---------------------------------------------------

query("w4_average_ranks", f"WITH {P} SELECT feature_id, sample_id, {r('rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0::DOUBLE')} AS rank FROM cells")(
    lambda s, d: TT.prices(s, d).cells.select("feature_id", "sample_id", O.small_group_ranks(["feature_id"], "value").alias("rank")))
query("w4_ranks_within_sample", f"WITH {K} SELECT feature_id, sample_id, {r('rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0::DOUBLE')} AS rank FROM cells")(
    lambda s, d: O.average_ranks(TT.counts(s, d).cells, ["sample_id"], "value", few=True).select("feature_id", "sample_id", "rank"))
_ZW = "CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END"
query("w12_row_z", f"WITH {LOGP} SELECT feature_id, sample_id, {r(_ZW)} AS z FROM lcells WINDOW w AS (PARTITION BY feature_id)")(
    lambda s, d: N.analysis_scale(TT.prices(s, d)).cells.select("feature_id", "sample_id", C.z_by("value", ["feature_id"]).alias("z")))
query("w12_column_z", f"WITH {LOGP} SELECT feature_id, sample_id, {r(_ZW)} AS z FROM lcells WINDOW w AS (PARTITION BY sample_id)")(
    lambda s, d: C.z_by_sample(N.analysis_scale(TT.prices(s, d))))
query("w13_median_shift", f"WITH {LOGP}, m AS (SELECT sample_id, median(value) med FROM lcells GROUP BY 1) SELECT sample_id, {r('med')} AS med, {r('med - (SELECT median(med) FROM m)')} AS shift FROM m")(
    lambda s, d: N.median_shift(N.analysis_scale(TT.prices(s, d))))
query("w15_unique_labels", "WITH g AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN ' ' ELSE p_brand||p_type||p_size END AS id FROM part), h AS (SELECT p_partkey, coalesce(nullif(trim(id), ''), '._missing') AS id FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS k FROM h) SELECT p_partkey, CASE WHEN k = 1 THEN id ELSE id||'_'||(k - 1) END AS label FROM n")(
    lambda s, d: C.unique_labels(TT.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") == 50, " ").otherwise(F.concat("p_brand", "p_type", "p_size")).alias("id")), "id", ["p_partkey"]).select("p_partkey", "label"))
query("j1_annotate", f"WITH {P} SELECT feature_id, count(*) AS n, coalesce(nullif(trim(any_value(feature_symbol)), ''), feature_id) AS feature_symbol FROM cells LEFT JOIN features USING (feature_id) GROUP BY feature_id")(
    lambda s, d: (lambda y: L.annotate(y.cells.groupBy("feature_id").agg(F.count("*").alias("n")), y.features))(TT.prices(s, d)))
query("j17_absent_cells", f"WITH {P} SELECT f.feature_id, s.sample_id FROM features f CROSS JOIN samples s WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.feature_id = f.feature_id AND c.sample_id = s.sample_id)")(
    lambda s, d: C.absent_cells(TT.prices(s, d)))
query("u2_intersect_ids", f"WITH {P}, {_FM} SELECT feature_id FROM fm WHERE missing_rate <= 0.85 INTERSECT SELECT feature_id FROM features WHERE p_size <= 25")(
    lambda s, d: (lambda y: C.keep_by_missing(y, 0.85).select("feature_id").intersect(y.features.where("p_size <= 25").select("feature_id")))(TT.prices(s, d)))
query("u3_kept_ids", f"WITH {P}, {_FM} SELECT feature_id FROM features EXCEPT SELECT feature_id FROM fm WHERE missing_rate > 0.85")(
    lambda s, d: (lambda y: y.features.select("feature_id").join(C.feature_missing(y).where("missing_rate > 0.85"), "feature_id", "left_anti"))(TT.prices(s, d)))
query("u7_distinct_links", "SELECT DISTINCT p_name, p_brand FROM part")(
    lambda s, d: L.clean_link(TT.table(s, d, "part"), "p_name", "p_brand"))

# ---- quality control -----------------------------------------------------------------------

query("q1_missingness_features", f"WITH {P}, {_FM} SELECT feature_id, {r('missing_rate')} AS missing_rate, {r('missing_rate')} AS filter_missing_rate, missing_rate > 0.85 AS flagged FROM fm")(
    lambda s, d: Q.missingness(TT.prices(s, d), 0.85)["features"])
query("q1_missingness_samples", f"WITH {P}, {_SM} SELECT sample_id, {r('missing_rate')} AS missing_rate, missing_rate > 0.85 AS flagged FROM sm")(
    lambda s, d: Q.missingness(TT.prices(s, d), 0.5, 0.85)["samples"])
query("q1_missingness_by_group", f"WITH {P}, {_FM}, {_GM} SELECT feature_id, {r('any_value(fm.missing_rate)')} AS missing_rate, {r('max(gm.missing_rate)')} AS filter_missing_rate, max(gm.missing_rate) > 0.9 AS flagged FROM fm JOIN gm USING (feature_id) GROUP BY 1")(
    lambda s, d: Q.missingness(TT.prices(s, d), 0.9, rule="all_groups", group_col="grp")["features"])
_COR = """mm AS (SELECT sample_id, avg(value) m FROM lcells GROUP BY 1), cc AS (SELECT feature_id, sample_id, value - m AS v FROM lcells JOIN mm USING (sample_id)),
pr AS (SELECT a.sample_id sa, b.sample_id sb, count(*) n, corr(a.v, b.v) r FROM cc a JOIN cc b USING (feature_id) GROUP BY 1, 2)"""
LOGB = B + TT.LOG_SQL
query("q7_sample_correlation", f"WITH {LOGB}, {_COR} SELECT sa AS sample_a, sb AS sample_b, n AS n_shared, {r('r')} AS r FROM pr")(
    lambda s, d: G.sample_correlation(N.analysis_scale(TT.brands(s, d))))
query("q4_connectivity", f"WITH {LOGB}, {_COR}, mc AS (SELECT sa AS sample_id, avg(r) mc FROM pr WHERE sa <> sb GROUP BY 1), z AS (SELECT sample_id, mc, (mc - avg(mc) OVER ()) / stddev_samp(mc) OVER () z FROM mc) SELECT sample_id, {r('mc')} AS mean_correlation, {r('z')} AS z_score, z < -2 AS is_outlier FROM z")(
    lambda s, d: G.connectivity(N.analysis_scale(TT.brands(s, d)), 2.0))
_NEAR = """dd AS (SELECT sa, sb, round(coalesce(0.5::DOUBLE * ln(greatest(1 - r, 1e-12::DOUBLE)), 'Infinity'::DOUBLE), 10) d FROM pr WHERE sa <> sb),
rk AS (SELECT *, row_number() OVER (PARTITION BY sa ORDER BY d, sb) k FROM dd),
nn AS (SELECT sa AS sample_id, max(sb) FILTER (k = 1) AS nearest_sample, max(d) FILTER (k = 1) AS nn1, max(d) FILTER (k = 2) AS nn2 FROM rk WHERE k <= 2 GROUP BY 1)"""
query("w10_nearest_two", f"WITH {V}, lcells AS (SELECT * FROM cells), {_COR}, {_NEAR} SELECT sample_id, nearest_sample, {r('nn1')} AS nn1, {r('nn2')} AS nn2 FROM nn")(
    lambda s, d: Q.nearest_two(TT.vectors(s, d)))
query("q8_loo_outliers", f"""WITH {V}, lcells AS (SELECT * FROM cells), {_COR}, {_NEAR},
oth AS (SELECT a.sample_id, any_value(a.nearest_sample) ns, any_value(a.nn1) nn1, list(CASE WHEN b.nearest_sample = a.sample_id THEN b.nn2 ELSE b.nn1 END) o FROM nn a JOIN nn b ON a.sample_id <> b.sample_id GROUP BY 1),
ref AS (SELECT *, list_median(o) rf FROM oth), sp AS (SELECT *, greatest(1.4826::DOUBLE * list_median(list_transform(o, lambda x: abs(x - rf))), 0.17::DOUBLE) spread FROM ref)
SELECT sample_id, ns AS nearest_sample, {r('1 - exp(2 * nn1)')} AS nearest_correlation, {r('1 - exp(2 * rf)')} AS reference_correlation, {r('(nn1 - rf) / spread')} AS z_score, (nn1 - rf) / spread > 1 AS is_outlier FROM sp""")(
    lambda s, d: Q.loo_outliers(TT.vectors(s, d), 1.0))
_IQR = "sm AS (SELECT s.sample_id, avg(value) v FROM samples s LEFT JOIN lcells USING (sample_id) GROUP BY 1), qq AS (SELECT quantile_cont(v, 0.25::DOUBLE) q1, quantile_cont(v, 0.75::DOUBLE) q3 FROM sm)"
query("q5_iqr_outliers", f"WITH {LOGP}, {_IQR} SELECT sample_id, {r('v')} AS mean_signal, {r('q1 - 1.5::DOUBLE * (q3 - q1)')} AS lower_fence, {r('q3 + 1.5::DOUBLE * (q3 - q1)')} AS upper_fence, coalesce(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), false) AS is_outlier FROM sm, qq")(
    lambda s, d: Q.iqr_outliers(N.analysis_scale(TT.prices(s, d))))
query("q6_pca_scores")(lambda s, d: G.pca(TT.vectors(s, d), 2)[0])
query("q6_pca_variance")(lambda s, d: G.pca(N.analysis_scale(TT.prices(s, d)), 3)[1])
query("q3_pca_outliers")(lambda s, d: G.pca_outliers(N.analysis_scale(TT.brands(s, d)), 3.0))
query("q6_total_variance", f"WITH {V} SELECT {r('sum(s)', 3)} AS total FROM (SELECT (count(*) - 1)::DOUBLE AS s FROM cells GROUP BY feature_id HAVING var_samp(value) > 0)", 3)(
    lambda s, d: G.standardized(TT.vectors(s, d)).agg(F.sum(F.col("value") * F.col("value")).alias("total")))
query("q9_outliers", f"""WITH {LOGB}, {_COR}, {_IQR}, mc AS (SELECT sa AS sample_id, avg(r) mc FROM pr WHERE sa <> sb GROUP BY 1), z AS (SELECT sample_id, (mc - avg(mc) OVER ()) / stddev_samp(mc) OVER () z FROM mc)
SELECT 'connectivity' AS method, sample_id, {r('z')} AS score, z < -2 AS is_outlier FROM z UNION ALL SELECT 'iqr', sample_id, {r('v')}, coalesce(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), false) FROM sm, qq""")(
    lambda s, d: Q.outliers(N.analysis_scale(TT.brands(s, d)), ("connectivity", "iqr"), {"connectivity": 2.0}))
query("q9_z_ceiling", f"WITH {P} SELECT {r('(count(*) - 1) / sqrt(count(*))')} AS z_ceiling FROM samples")(lambda s, d: Q.z_ceiling(TT.prices(s, d)))
query("u4_flagged_samples", f"""WITH {LOGB}, {_COR}, {_IQR}, mc AS (SELECT sa AS sample_id, avg(r) mc FROM pr WHERE sa <> sb GROUP BY 1), z AS (SELECT sample_id, (mc - avg(mc) OVER ()) / stddev_samp(mc) OVER () z FROM mc)
SELECT sample_id FROM z WHERE z < -1 UNION SELECT sample_id FROM sm, qq WHERE v < q1 - 1.0 * (q3 - q1) OR v > q3 + 1.0 * (q3 - q1)""")(
    lambda s, d: Q.outliers(N.analysis_scale(TT.brands(s, d)), ("connectivity", "iqr"), {"connectivity": 1.0, "iqr": 1.0}).where("is_outlier").select("sample_id").distinct())

# ---- imputation and normalisation ----------------------------------------------------------

_ABS = "ab AS (SELECT f.feature_id, s.sample_id FROM features f CROSS JOIN samples s WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.feature_id = f.feature_id AND c.sample_id = s.sample_id))"
query("q13_impute_min", f"WITH {LOGP}, {_ABS}, m AS (SELECT feature_id, min(value) v FROM lcells GROUP BY 1) SELECT feature_id, sample_id, {r('coalesce(v, 0)')} AS value FROM ab LEFT JOIN m USING (feature_id)")(
    lambda s, d: I.impute(N.analysis_scale(TT.prices(s, d)), "min"))
query("q14_impute_zero", f"WITH {P}, {_ABS} SELECT feature_id, sample_id, 0.0::DOUBLE AS value FROM ab")(lambda s, d: I.impute(TT.prices(s, d), "zero"))
query("q15_impute_mindet", f"WITH {LOGP}, {_ABS}, m AS (SELECT sample_id, quantile_cont(value, 0.01::DOUBLE) v FROM lcells GROUP BY 1) SELECT feature_id, sample_id, {r('coalesce(v, 0)')} AS value FROM ab LEFT JOIN m USING (sample_id)")(
    lambda s, d: I.impute(N.analysis_scale(TT.prices(s, d)), "MinDet"))


def _norm_sql(seed):
    u = lambda st: f"(('0x'||substr(md5('{seed}:{st}|'||feature_id||'|'||sample_id), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"
    return f"sqrt(-2 * ln({u('u')})) * cos(2 * pi() * {u('v')})"


query("q16_impute_minprob", f"""WITH {LOGB}, {_ABS}, m AS (SELECT sample_id, quantile_cont(value, 0.01::DOUBLE) v FROM lcells GROUP BY 1),
sd AS (SELECT stddev_samp(value) s FROM lcells GROUP BY feature_id HAVING count(*) > 0.5 * (SELECT count(*) FROM samples)), sp AS (SELECT CASE WHEN count(*) >= 2 THEN median(s) END AS sp FROM sd)
SELECT feature_id, sample_id, {r(f"coalesce(v, 0) + coalesce(sp, 0) * {_norm_sql(1234)}")} AS value FROM ab LEFT JOIN m USING (sample_id), sp""")(
    lambda s, d: I.impute(N.analysis_scale(TT.brands(s, d)), "MinProb"))
query("q17_impute_man", f"""WITH {LOGP}, {_ABS}, m AS (SELECT sample_id, avg(value) m, stddev_samp(value) s, count(*) n FROM lcells GROUP BY 1)
SELECT feature_id, sample_id, {r(f"CASE WHEN n >= 2 THEN m - 1.8::DOUBLE * s + 0.3::DOUBLE * s * {_norm_sql(1234)} WHEN n = 1 THEN m ELSE 0 END")} AS value FROM ab LEFT JOIN m USING (sample_id)""")(
    lambda s, d: I.impute(N.analysis_scale(TT.prices(s, d)), "man"))
def _calibrated(layer):
    """Per sample: cells, whether calibration kept their order, whether its scale is positive, and whether the fit converged."""
    found = VS.calibrate(layer)
    both = layer.cells.withColumnRenamed("value", "raw").join(found.layer.cells, ["feature_id", "sample_id"])
    # Sorted by the raw value, no calibrated value lies below the one before it.
    pairs = F.array_sort(F.collect_list(F.struct("raw", "value")))
    up = F.aggregate(pairs, F.struct(F.lit(True).alias("ok"), F.lit(float("-inf")).alias("last")),
                     lambda a, x: F.struct((a["ok"] & (x["value"] >= a["last"])).alias("ok"), x["value"].alias("last")), lambda a: a["ok"])
    return both.groupBy("sample_id").agg(F.count("*").alias("n_cells"), up.alias("in_order")).join(found.params, "sample_id").select(
        "sample_id", "n_cells", "in_order", (F.col("scale") > 0).alias("positive"), F.lit(found.converged).alias("converged"))


query("q25_log2", f"WITH {P} SELECT feature_id, sample_id, {r('log2(value + 1)')} AS value FROM cells WHERE value > 0")(lambda s, d: N.log2_layer(TT.prices(s, d)).cells)
# Fits are beyond SQL; what holds of any fit is not: order and number of each sample's cells stay, scales are positive, the fit ends.
query("q27_calibrated_samples", f"WITH {P} SELECT sample_id, count(*) AS n_cells, true AS in_order, true AS positive, true AS converged FROM cells GROUP BY 1")(
    lambda s, d: _calibrated(TT.prices(s, d)))
query("q26_median_center", f"WITH {LOGP}, m AS (SELECT sample_id, median(value) med FROM lcells GROUP BY 1) SELECT feature_id, sample_id, {r('value - (med - (SELECT median(med) FROM m))')} AS value FROM lcells JOIN m USING (sample_id)")(
    lambda s, d: N.median_center(N.log2_layer(TT.prices(s, d))).cells)
query("q29_analysis_scale", f"WITH {K}, l AS (SELECT sample_id, sum(value) lib FROM cells GROUP BY 1) SELECT feature_id, sample_id, {r('log2((value + 0.5::DOUBLE) / ((lib + 1) / 1e6::DOUBLE))')} AS value FROM cells JOIN l USING (sample_id)")(
    lambda s, d: N.analysis_scale(TT.counts(s, d)).cells)
query("q30_display_scale", f"WITH {K}, l AS (SELECT sample_id, sum(value) lib FROM cells GROUP BY 1) SELECT feature_id, sample_id, {r('log2(value / lib * 1e6::DOUBLE + 1)')} AS value FROM cells JOIN l USING (sample_id)")(
    lambda s, d: N.display_scale(TT.counts(s, d)).cells)
_WIN = """nz AS (SELECT feature_id, count(*) n, quantile_cont(value, 0.25::DOUBLE) q1, quantile_cont(value, 0.75::DOUBLE) q3 FROM cells WHERE value > 0 GROUP BY 1),
th AS (SELECT *, q3 - q1 AS iqr, (n >= 3 AND q3 - q1 > 0) AS ok, CASE WHEN n >= 3 AND q3 - q1 > 0 THEN q3 + 1.0::DOUBLE * (q3 - q1) END AS t FROM nz)"""
query("q12_winsorize", f"WITH {K}, {_WIN} SELECT feature_id, sample_id, {r('CASE WHEN value > t THEN floor(t) ELSE value END')} AS value FROM cells LEFT JOIN th USING (feature_id)")(
    lambda s, d: N.winsorize(TT.counts(s, d), 1.0)[0].cells)
query("q12_winsorize_stats", f"""WITH {K}, {_WIN} SELECT feature_id, round(any_value(q1), 2) AS q1, round(any_value(q3), 2) AS q3, round(any_value(iqr), 2) AS iqr, round(any_value(t), 2) AS threshold, max(value) AS max_original,
count(*) FILTER (value > t) AS n_clipped, any_value(n) AS n_nonzero, any_value(ok) AS winsorized FROM cells LEFT JOIN th USING (feature_id) GROUP BY 1""")(
    lambda s, d: N.winsorize(TT.counts(s, d), 1.0)[1])


def _by_nation(s, d):
    """The dense count layer summed to one sample per nation."""
    from dataclasses import replace

    y = TT.brands(s, d, "l_quantity")
    nation = F.regexp_replace("sample_id", "Y.*$", "")
    cells = y.cells.groupBy("feature_id", nation.alias("sample_id")).agg(F.sum("value").alias("value"))
    return replace(y, cells=cells, samples=y.samples.select(nation.alias("sample_id"), "grp").distinct(), _counted={})


query("d18_size_factors", f"""WITH {TT.brands_sql('l_quantity')}, nc AS (SELECT feature_id, regexp_replace(sample_id, 'Y.*$', '') AS sample_id, sum(value) AS value FROM cells GROUP BY 1, 2),
lg AS (SELECT feature_id, sample_id, ln(value) lv FROM nc WHERE value > 0), fu AS (SELECT feature_id, avg(lv) g FROM lg GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM nc))
SELECT sample_id, {r('exp(median(lv - g))')} AS size_factor FROM lg JOIN fu USING (feature_id) GROUP BY 1""")(
    lambda s, d: N.size_factors(_by_nation(s, d)))
query("q28_tmm", f"""WITH {TT.brands_sql('l_quantity')}, live AS (SELECT * FROM cells WHERE value > 0), libs AS (SELECT sample_id, sum(value) lib, sum(sqrt(value)) root FROM live GROUP BY 1),
grid AS (SELECT s.sample_id, f.feature_id, coalesce(value, 0) v FROM samples s CROSS JOIN (SELECT DISTINCT feature_id FROM live) f LEFT JOIN live c ON c.sample_id = s.sample_id AND c.feature_id = f.feature_id),
f75 AS (SELECT sample_id, lib, root, quantile_cont(v, 0.75::DOUBLE) / lib AS f FROM grid JOIN libs USING (sample_id) GROUP BY 1, 2, 3), ce AS (SELECT avg(f) av, median(f) md FROM f75),
rf AS (SELECT sample_id rid, lib rlib FROM f75, ce ORDER BY round(CASE WHEN md < 1e-20 THEN -root ELSE abs(f - av) END, 10), sample_id LIMIT 1),
rc AS (SELECT feature_id, value rv FROM live, rf WHERE sample_id = rid),
w AS (SELECT feature_id, sample_id, round(log2((value / lib) / (rv / rlib)), 10) m, round((log2(value / lib) + log2(rv / rlib)) / 2, 10) a, (lib - value) / lib / value + (rlib - rv) / rlib / rv v
      FROM live JOIN rc USING (feature_id) JOIN libs USING (sample_id), rf),
k AS (SELECT *, count(*) OVER (PARTITION BY sample_id) n, rank() OVER (PARTITION BY sample_id ORDER BY m) + (count(*) OVER (PARTITION BY sample_id, m) - 1) / 2.0::DOUBLE rm,
      rank() OVER (PARTITION BY sample_id ORDER BY a) + (count(*) OVER (PARTITION BY sample_id, a) - 1) / 2.0::DOUBLE ra FROM w),
ff AS (SELECT sample_id, CASE WHEN max(abs(m)) < 1e-6 THEN 0 ELSE coalesce(sum(m / v) FILTER (rm >= floor(n * 0.3::DOUBLE) + 1 AND rm <= n - floor(n * 0.3::DOUBLE) AND ra >= floor(n * 0.05::DOUBLE) + 1 AND ra <= n - floor(n * 0.05::DOUBLE))
      / sum(1 / v) FILTER (rm >= floor(n * 0.3::DOUBLE) + 1 AND rm <= n - floor(n * 0.3::DOUBLE) AND ra >= floor(n * 0.05::DOUBLE) + 1 AND ra <= n - floor(n * 0.05::DOUBLE)), 0) END lr FROM k GROUP BY 1)
SELECT sample_id, {r('lib')} AS lib, {r('pow(2.0::DOUBLE, lr - (SELECT avg(lr) FROM ff))')} AS norm_factor FROM ff JOIN libs USING (sample_id)""")(
    lambda s, d: N.tmm_factors(TT.brands(s, d, "l_quantity")))


def _qc_table(s, d):
    clean, _, _ = Q.run_qc(TT.brands(s, d), 0.5, sample_cutoff=0.3, impute="MinDet")
    return clean.cells.select("feature_id", "sample_id", F.log2("value").alias("value"))


query("q10_qc_pipeline", f"""WITH {B}, {_FM}, {_SM}, kf AS (SELECT feature_id FROM fm WHERE missing_rate <= 0.5), ks AS (SELECT sample_id FROM sm WHERE missing_rate <= 0.3),
c2 AS (SELECT feature_id, sample_id, log2(value) value FROM cells SEMI JOIN kf USING (feature_id) SEMI JOIN ks USING (sample_id) WHERE value > 0), lo AS (SELECT sample_id, quantile_cont(value, 0.01::DOUBLE) v FROM c2 GROUP BY 1)
SELECT kf.feature_id, ks.sample_id, {r('coalesce(c2.value, lo.v, 0)')} AS value FROM kf CROSS JOIN ks LEFT JOIN c2 ON c2.feature_id = kf.feature_id AND c2.sample_id = ks.sample_id LEFT JOIN lo ON lo.sample_id = ks.sample_id""")(_qc_table)


def _qc_replay(s, d):
    y = TT.brands(s, d)
    _, _, rec = Q.run_qc(y, 0.5, sample_cutoff=0.3, impute="zero")
    back = Q.replay(y, rec, check=True)
    return back.cells.groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("value") > 1, F.col("value"))), 2).alias("total"))


query("q11_replay", f"""WITH {B}, {_FM}, {_SM}, kf AS (SELECT feature_id FROM fm WHERE missing_rate <= 0.5), ks AS (SELECT sample_id FROM sm WHERE missing_rate <= 0.3)
SELECT ks.sample_id, (SELECT count(*) FROM kf) AS n, round(sum(value), 2) AS total FROM ks LEFT JOIN (SELECT * FROM cells SEMI JOIN kf USING (feature_id)) c ON c.sample_id = ks.sample_id GROUP BY 1""", 2)(_qc_replay)
query("q24_imputation_curves")(lambda s, d: (lambda y: Q.observed_imputed_curves(y.cells, I.impute(y, "MinProb")))(N.analysis_scale(TT.brands(s, d))))
query("q24_density_curves", f"""WITH {LOGP}, {_ABS}, m AS (SELECT sample_id, quantile_cont(value, 0.01::DOUBLE) v FROM lcells GROUP BY 1),
v AS (SELECT 'observed' AS source, value FROM lcells UNION ALL SELECT 'imputed', coalesce(v, 0) FROM ab LEFT JOIN m USING (sample_id)),
e AS (SELECT min(value) AS low, (max(value) - min(value)) / 511 AS step FROM v),
q AS (SELECT source, count(*) AS n, quantile_cont(value, 0.75::DOUBLE) - quantile_cont(value, 0.25::DOUBLE) AS iqr, stddev_samp(value) AS sd FROM v GROUP BY 1),
h AS (SELECT source, n, 0.9::DOUBLE * least(sd, CASE WHEN iqr > 0 THEN iqr / 1.34::DOUBLE ELSE sd END) * pow(n, -0.2::DOUBLE) AS bandwidth FROM q),
s AS (SELECT source, (value - low) / step AS z, least(floor((value - low) / step), 510)::INT AS b FROM v, e),
b AS (SELECT source, i, sum(w) AS w FROM (SELECT source, b AS i, 1 - (z - b) AS w FROM s UNION ALL SELECT source, b + 1, z - b FROM s) GROUP BY 1, 2),
g AS (SELECT source, n, bandwidth, i, low + i * step AS x, step FROM h, e, (SELECT unnest(range(512))::INT AS i))
SELECT g.source, g.i, {r('any_value(x)')} AS x, {r('sum(w * exp(-pow((g.i - b.i) * step / bandwidth, 2) / 2)) / (any_value(n) * any_value(bandwidth) * sqrt(2 * pi()))')} AS density
FROM g JOIN b ON g.source = b.source GROUP BY 1, 2""")(
    lambda s, d: (lambda y: Q.observed_imputed_density(y.cells, I.impute(y, "MinDet")).select("source", "i", "x", "density"))(N.analysis_scale(TT.prices(s, d))))
for _name, _method in (("q18_impute_qrilc", "QRILC"), ("q20_impute_mle", "MLE"), ("q21_impute_bpca", "bpca")):
    query(_name)(lambda s, d, m=_method: I.impute(N.analysis_scale(TT.brands(s, d)), m))


def _neighbours_sql(values: str, features: str, samples: str) -> str:
    """Brute-force k-nearest fill over a table of values: every pair of features is compared."""
    return f"""
n AS (SELECT count(*) AS n FROM {samples}),
seen AS (SELECT f.feature_id, count(value) AS c FROM {features} f LEFT JOIN {values} USING (feature_id) GROUP BY 1),
target AS (SELECT feature_id FROM seen, n WHERE c < n AND 2 * c >= n),
dist AS (SELECT a.feature_id AS t, b.feature_id AS o, sum((a.value - b.value) * (a.value - b.value)) / count(*) AS d
  FROM {values} a SEMI JOIN target USING (feature_id) JOIN {values} b ON a.sample_id = b.sample_id AND a.feature_id <> b.feature_id GROUP BY 1, 2),
top AS (SELECT t, o FROM dist QUALIFY row_number() OVER (PARTITION BY t ORDER BY d, o) <= 10),
means AS (SELECT sample_id, avg(value) AS m FROM {values} GROUP BY 1),
gap AS (SELECT feature_id, sample_id FROM {features}, {samples} EXCEPT SELECT feature_id, sample_id FROM {values}),
near AS (SELECT t AS feature_id, sample_id, avg(value) AS v FROM top JOIN {values} c ON c.feature_id = o GROUP BY 1, 2),
knn AS (SELECT g.feature_id, g.sample_id, coalesce(v, m, 0) AS value FROM gap g LEFT JOIN near USING (feature_id, sample_id) LEFT JOIN means USING (sample_id))"""


query("q19_impute_knn", f"WITH {LOGB}, {_neighbours_sql('lcells', 'features', 'samples')} SELECT feature_id, sample_id, {r('value')} AS value FROM knn")(
    lambda s, d: I.impute(N.analysis_scale(TT.brands(s, d)), "knn"))
query("q19_impute_knn_parts", f"WITH {TT.YEARS_SQL}, {_neighbours_sql('cells', 'features', 'samples')} SELECT feature_id, sample_id, {r('value')} AS value FROM knn")(
    lambda s, d: I.impute(TT.yearly(s, d), "knn"))
query("q22_impute_mixed", f"""WITH {LOGB}, {_neighbours_sql('lcells', 'features', 'samples')}, m AS (SELECT sample_id, quantile_cont(value, 0.01::DOUBLE) v FROM lcells GROUP BY 1),
sd AS (SELECT stddev_samp(value) s FROM lcells GROUP BY feature_id HAVING count(*) > 0.5 * (SELECT count(*) FROM samples)), sp AS (SELECT CASE WHEN count(*) >= 2 THEN median(s) END AS sp FROM sd),
fm AS (SELECT feature_id, avg(value) AS mm FROM lcells GROUP BY 1), sh AS (SELECT 1 - (SELECT count(*) FROM lcells)::DOUBLE / ((SELECT count(*) FROM features) * (SELECT count(*) FROM samples)) AS share),
ls AS (SELECT list_sort(list(mm)) AS l, any_value(share) * (count(*) - 1) AS h FROM fm, sh), li AS (SELECT l[floor(h)::INT + 1] + (h - floor(h)) * (coalesce(l[floor(h)::INT + 2], l[floor(h)::INT + 1]) - l[floor(h)::INT + 1]) AS line FROM ls)
SELECT feature_id, sample_id, {r(f"CASE WHEN mm > line THEN value ELSE coalesce(v, 0) + coalesce(sp, 0) * {_norm_sql(1234)} END", 5)} AS value
FROM knn LEFT JOIN fm USING (feature_id) LEFT JOIN m USING (sample_id), sp, li""", 5)(lambda s, d: I.impute(N.analysis_scale(TT.brands(s, d)), "mixed"))
