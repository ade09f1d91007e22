"""Queries: gene sets, enrichment, layer links and integration."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.functions import scalar as S
from assaygrid.operators import enrich as EN
from assaygrid.operators import integrate as IN
from assaygrid.operators import links as L
from assaygrid.operators import normalize as N
from assaygrid.operators import views as VW
from assaygrid.operators.diff import results
from assaygrid.plans import fixtures as FX
from assaygrid.plans import testtables as TT
from assaygrid.plans import registry
from assaygrid.plans.registry import bh, t_tail_whole


def query(name, sql=None, digits=8):
    return registry.query(name, sql, digits)


def r(expr, digits=8):
    return registry.r(expr, digits)


D, DB, GS = FX.DIFF_SQL, FX.DIFF_B_SQL, TT.FEATURES_SQL + "," + TT.GENE_SETS_SQL
ORA = D + "," + FX.ORA_SQL

# ---- gene-set tables -----------------------------------------------------------------------

query("s10_list_sets", f"WITH {GS} SELECT DISTINCT gs_name AS pathway_id, gene_symbol FROM gene_sets")(lambda s, d: EN.list_sets(TT.gene_sets(s, d)))
query("s11_term2gene", f"WITH {GS} SELECT DISTINCT database, gs_name AS term, gene_symbol AS gene FROM gene_sets")(lambda s, d: EN.term_tables(TT.gene_sets(s, d))[0])
query("s11_term2name", f"WITH {GS} SELECT DISTINCT database, gs_name AS term, trim(replace(regexp_replace(gs_name, '^(KEGG_|REACTOME_|GOBP_)', ''), '_', ' ')) AS name FROM gene_sets")(
    lambda s, d: EN.term_tables(TT.gene_sets(s, d))[1])
query("s12_sized_sets", f"WITH {GS}, t AS (SELECT DISTINCT database, gs_name AS term, gene_symbol AS gene FROM gene_sets), z AS (SELECT database, term, count(*) n_genes FROM t GROUP BY 1, 2 HAVING count(*) BETWEEN 10 AND 500) SELECT database, term, gene, n_genes FROM t JOIN z USING (database, term)")(
    lambda s, d: EN.sized_terms(EN.term_tables(TT.gene_sets(s, d))[0]))

# ---- over-representation -------------------------------------------------------------------

_EC = ["database", "comparison", "pathway_id", "direction", "p_value", "adj_p_value", "gene_set_size", "overlap_size"]
_EQ = f"database, comparison, pathway_id, direction, {r('p_value')} AS p_value, {r('adj_p_value')} AS adj_p_value, gene_set_size, overlap_size"


def _ora(s, d, **kw):
    kw.setdefault("max_size", 100_000)
    return EN.run_ora(FX.diff(s, d), TT.gene_sets(s, d), preference="raw", **kw)


query("e2_over_representation", f"WITH {ORA} SELECT {_EQ}, overlap_features FROM ora", 6)(lambda s, d: _ora(s, d, output_cutoff=None).select(*_EC, "overlap_features"))
query("e2_q_values", f"WITH {ORA} SELECT database, comparison, pathway_id, direction, {r('ora.q_value', 7)} AS q_value FROM ora", 7)(
    lambda s, d: _ora(s, d, output_cutoff=None).select("database", "comparison", "pathway_id", "direction", "q_value"))
query("e2_bounded_output", f"WITH {ORA} SELECT {_EQ} FROM ora WHERE ora.p_value <= 0.05 AND ora.adj_p_value <= 0.05", 6)(lambda s, d: _ora(s, d, output_cutoff=0.05).select(*_EC))
query("e3_up_list", f"WITH {ORA} SELECT {_EQ} FROM ora WHERE direction = 'up'", 6)(lambda s, d: _ora(s, d, output_cutoff=None, direction="up").select(*_EC))
query("e3_pooled_list", f"""WITH {D}, {FX.ORA_SQL.replace("CASE WHEN effect > 0 THEN 'up' ELSE 'down' END AS list", "'both' AS list").replace("p_value < 0.05 AND effect <> 0", "p_value < 0.05")} SELECT database, comparison, pathway_id, NULL::VARCHAR AS direction, {r('p_value')} AS p_value, {r('adj_p_value')} AS adj_p_value, gene_set_size, overlap_size FROM ora""", 6)(
    lambda s, d: _ora(s, d, output_cutoff=None, direction="both").select(*_EC))
query("e1_run_ora_one_comparison", f"WITH {ORA} SELECT {_EQ} FROM ora WHERE comparison = 'ASIA_vs_AFRICA'", 6)(
    lambda s, d: EN.run_ora(FX.one_comparison(FX.diff(s, d)), TT.gene_sets(s, d), preference="raw", output_cutoff=None, max_size=100_000).select(*_EC))
query("e6_standard_columns", f"""WITH {ORA} SELECT database, 'ora' AS result_type, comparison, pathway_id, trim(replace(regexp_replace(pathway_id, '^(KEGG_|REACTOME_|GOBP_)', ''), '_', ' ')) AS pathway_name, NULL::DOUBLE AS effect, NULL::VARCHAR AS effect_type, direction,
{r('p_value')} AS p_value, {r('adj_p_value')} AS adj_p_value, {r('q_value')} AS q_value, gene_set_size, overlap_size, overlap_features, overlap_features AS leading_features, 'ora_'||direction||'_'||database AS source_label FROM ora""")(
    lambda s, d: FX.enriched(s, d))
query("e7_compare_enrichment", f"WITH {ORA} SELECT comparison, database, count(*) AS n_sets, sum((adj_p_value < 0.05)::INT)::BIGINT AS n_significant FROM ora GROUP BY 1, 2")(
    lambda s, d: FX.enriched(s, d).groupBy("comparison", "database").agg(F.count("*").alias("n_sets"), F.sum((F.col("adj_p_value") < 0.05).cast("int")).alias("n_significant")))
query("a15_set_sizes", f"WITH {ORA} SELECT database, comparison, pathway_id, direction, gene_set_size, overlap_size, overlap_features FROM ora")(
    lambda s, d: FX.enriched(s, d).select("database", "comparison", "pathway_id", "direction", "gene_set_size", "overlap_size", "overlap_features"))
query("j13_hits_in_sets", f"WITH {ORA} SELECT h.database, comparison, list, term, h.gene FROM hitd h JOIN t2g t ON t.database = h.database AND t.gene = h.gene")(
    lambda s, d: EN.directed_hits(FX.diff(s, d), results.significance(0.05, "raw")).join(EN.term_tables(TT.gene_sets(s, d))[0], "gene").select("database", "comparison", "list", "term", "gene"))
query("p6_filter_enrichment", f"WITH {ORA} SELECT {_EQ} FROM ora WHERE ora.p_value < 0.05 AND overlap_size >= 5 AND direction = 'up'")(
    lambda s, d: EN.filter_enrichment(FX.enriched(s, d), 0.05, "raw", 5, "up").select(*_EC))
query("k9_pathway_table", f"WITH {ORA} SELECT {_EQ} FROM ora WHERE ora.adj_p_value < 0.2")(
    lambda s, d: EN.filter_enrichment(FX.enriched(s, d), 0.2).orderBy("adj_p_value", "pathway_id").select(*_EC))
query("w3_across_databases", f"WITH {ORA}, x AS (SELECT database, comparison, pathway_id, direction, p_value FROM ora), y AS ({bh('p_value', 'comparison, direction', 'x')}) SELECT database, comparison, pathway_id, direction, {r('p_value')} AS p_value, {r('adj_p_value')} AS adj_p_value, NULL::DOUBLE AS q_value FROM y")(
    lambda s, d: EN.adjust_across(FX.enriched(s, d), "ora", cutoff=None).select("database", "comparison", "pathway_id", "direction", "p_value", "adj_p_value", "q_value"))
_TOP = """b AS (SELECT database, list(DISTINCT direction ORDER BY direction) = ['down', 'up'] AS alt FROM ora GROUP BY 1),
tn AS (SELECT ora.*, row_number() OVER (PARTITION BY database, direction ORDER BY adj_p_value, pathway_id, comparison) AS turn FROM ora),
pk AS (SELECT tn.*, row_number() OVER (PARTITION BY database ORDER BY CASE WHEN alt THEN turn ELSE 0 END, adj_p_value, pathway_id, comparison, direction)::INT AS place FROM tn JOIN b USING (database))"""
query("w9_top_per_database", f"WITH {ORA}, {_TOP} SELECT {_EQ}, place FROM pk WHERE place <= 8")(lambda s, d: EN.top_per_database(FX.enriched(s, d), 8).select(*_EC, "place"))
query("v6_enrichment_dots", f"WITH {ORA}, {_TOP} SELECT database, comparison, pathway_id, direction, place, {r('-log10(greatest(adj_p_value, 2.2250738585072014e-308::DOUBLE))', 5)} AS score, overlap_size, gene_set_size FROM pk WHERE place <= 8", 5)(
    lambda s, d: VW.enrichment_dots(FX.enriched(s, d), 8))
query("k5_top_pathways", f"WITH {ORA} SELECT {_EQ} FROM ora WHERE comparison = 'ASIA_vs_AFRICA' ORDER BY ora.adj_p_value, pathway_id, direction LIMIT 15")(
    lambda s, d: FX.one_comparison(FX.enriched(s, d)).orderBy("adj_p_value", "pathway_id", "direction").limit(15).select(*_EC))
_MAT = """pk AS (SELECT DISTINCT pathway_id FROM (SELECT pathway_id, row_number() OVER (PARTITION BY comparison ORDER BY adj_p_value, pathway_id, direction) k FROM ora) WHERE k <= 8),
dd AS (SELECT ora.* FROM ora JOIN pk USING (pathway_id)),
ce AS (SELECT comparison, pathway_id, min(adj_p_value) p, max(adj_p_value < 0.05) s, bool_or(direction = 'up' AND adj_p_value < 0.05) us, bool_or(direction = 'down' AND adj_p_value < 0.05) ds, bool_or(direction = 'up') ua, bool_or(direction = 'down') da FROM dd GROUP BY 1, 2),
cl AS (SELECT comparison, pathway_id, p, p < 0.05 AS is_significant, CASE WHEN (CASE WHEN s THEN us AND ds ELSE ua AND da END) THEN 'Up and down' WHEN (CASE WHEN s THEN us ELSE ua END) THEN 'Up-regulated genes' WHEN (CASE WHEN s THEN ds ELSE da END) THEN 'Down-regulated genes' ELSE 'Pooled' END AS gene_list FROM ce)"""
query("e8_comparison_matrix", f"WITH {ORA}, {_MAT} SELECT comparison, pathway_id, {r('p')} AS adj_p_value, gene_list, is_significant, sum(is_significant::INT) OVER (PARTITION BY pathway_id)::BIGINT AS n_significant, {r('min(p) OVER (PARTITION BY pathway_id)')} AS best_p FROM cl")(
    lambda s, d: EN.comparison_matrix(FX.enriched(s, d)).select("comparison", "pathway_id", "adj_p_value", "gene_list", "is_significant", "n_significant", "best_p"))
query("w17_pathway_order", f"WITH {ORA}, {_MAT} SELECT pathway_id, sum(is_significant::INT)::BIGINT AS n_significant, {r('min(p)')} AS best_p FROM cl GROUP BY 1")(
    lambda s, d: EN.comparison_matrix(FX.enriched(s, d)).select("pathway_id", "n_significant", "best_p").distinct())
query("j21_pathway_genes", f"""WITH {ORA}, top AS (SELECT * FROM ora WHERE ora.p_value < 0.01), ge AS (SELECT database, comparison, pathway_id, direction, unnest(string_split(overlap_features, '/')) AS gene FROM top),
bs AS (SELECT *, row_number() OVER (PARTITION BY comparison, feature_symbol ORDER BY coalesce(p_value, 2), feature_id) k FROM diff)
SELECT database, ge.comparison, pathway_id, ge.direction, gene, feature_id, {r('effect')} AS effect, {r('bs.p_value')} AS p_value FROM ge LEFT JOIN bs ON bs.comparison = ge.comparison AND bs.feature_symbol = ge.gene AND k = 1""")(
    lambda s, d: EN.pathway_genes(FX.enriched(s, d).where("p_value < 0.01"), FX.diff(s, d)))
query("a22_guess_organism", f"WITH {TT.FEATURES_SQL} SELECT count(*) AS n, 'Hs' AS organism FROM features")(lambda s, d: EN.guess_organism(TT.part_features(s, d)))


def _lower_symbols(s, d):
    return FX.diff(s, d).withColumn("feature_symbol", F.lower("feature_symbol"))


query("j20_case_plan", f"WITH {TT.FEATURES_SQL} SELECT count(DISTINCT feature_symbol) AS n_symbols, 0::BIGINT AS n_exact, count(DISTINCT feature_symbol) AS n_ci, true AS apply FROM features")(
    lambda s, d: EN.case_plan(_lower_symbols(s, d).select(F.col("feature_symbol").alias("gene")), TT.gene_sets(s, d).select(F.col("gene_symbol").alias("gene")))[0])


def _rescued(s, d):
    low = _lower_symbols(s, d)
    sets = TT.gene_sets(s, d)
    _, m = EN.case_plan(low.select(F.col("feature_symbol").alias("gene")), sets.select(F.col("gene_symbol").alias("gene")))
    out = EN.run_ora(EN.respell(low, m), sets, preference="raw", output_cutoff=None, max_size=100_000)
    return EN.restore(out, m).select(*_EC, "overlap_features")


query("j20_case_rescue", f"WITH {ORA} SELECT {_EQ}, lower(overlap_features) AS overlap_features FROM ora", 6)(_rescued)

# ---- rank-based enrichment and scores ------------------------------------------------------

_RANKING = """rkg AS (SELECT comparison, feature_symbol AS gene, signed_stat AS score FROM (SELECT *, row_number() OVER (PARTITION BY comparison, feature_symbol ORDER BY abs(signed_stat) DESC, feature_id DESC) k FROM diff WHERE p_value IS NOT NULL AND signed_stat IS NOT NULL) WHERE k = 1)"""
_MEMB = _RANKING + """, pos AS (SELECT *, rank() OVER (PARTITION BY comparison ORDER BY score DESC) + (count(*) OVER (PARTITION BY comparison, score) - 1) / 2.0::DOUBLE AS place, count(*) OVER (PARTITION BY comparison) AS n_list FROM rkg),
t2g AS (SELECT DISTINCT database, gs_name AS term, gene_symbol AS gene FROM gene_sets),
mem AS (SELECT * FROM (SELECT database, term, comparison, gene, score, place, n_list, count(*) OVER w AS set_size, sum(abs(score)) OVER w AS tot FROM pos JOIN t2g USING (gene) WINDOW w AS (PARTITION BY database, term, comparison)) WHERE set_size BETWEEN 10 AND 500 AND tot > 0),
wk AS (SELECT *, row_number() OVER w AS k, sum(abs(score)) OVER (PARTITION BY database, term, comparison ORDER BY place, gene ROWS UNBOUNDED PRECEDING) AS up FROM mem WINDOW w AS (PARTITION BY database, term, comparison ORDER BY place, gene)),
w2 AS (SELECT *, up / tot - (place - k) / (n_list - set_size) AS aft, (up - abs(score)) / tot - (place - k) / (n_list - set_size) AS bef FROM wk)"""
GSEA = D + "," + TT.GENE_SETS_SQL + "," + _MEMB


def _members(s, d):
    return EN.set_members(EN.positions(EN.gene_ranking(FX.diff(s, d))), EN.term_tables(TT.gene_sets(s, d))[0], 10, 500)


query("e4_ranking_metric", f"WITH {D}, {_RANKING} SELECT comparison, gene, {r('score')} AS score FROM rkg")(lambda s, d: EN.gene_ranking(FX.diff(s, d)))
query("w5_top_feature_per_symbol", f"WITH {D}, {_RANKING} SELECT comparison, count(*) AS n, {r('max(score)')} AS top FROM rkg GROUP BY 1")(
    lambda s, d: EN.gene_ranking(FX.diff(s, d)).groupBy("comparison").agg(F.count("*").alias("n"), F.max("score").alias("top")))
query("w7_running_score", f"WITH {GSEA} SELECT database, term, comparison, gene, k::INT AS k, {r('aft')} AS after, {r('bef')} AS before FROM w2")(
    lambda s, d: EN.running_sums(_members(s, d)).select("database", "term", "comparison", "gene", "k", "after", "before"))
query("e11_one_pathway_curve", f"WITH {GSEA} SELECT gene, k::INT AS k, {r('place')} AS place, {r('aft')} AS after FROM w2 WHERE comparison = 'ASIA_vs_AFRICA' AND term = 'REACTOME_5'")(
    lambda s, d: EN.running_sums(_members(s, d).where("comparison = 'ASIA_vs_AFRICA' and term = 'REACTOME_5'")).select("gene", "k", "place", "after"))
query("w8_enrichment_score", f"WITH {GSEA} SELECT database, term, comparison, set_size, {r('CASE WHEN max(aft) >= -min(bef) THEN max(aft) ELSE min(bef) END')} AS es FROM w2 GROUP BY 1, 2, 3, 4")(
    lambda s, d: EN.enrichment_scores(_members(s, d)).select("database", "term", "comparison", "set_size", "es"))
query("e5_gsea")(lambda s, d: EN.run_gsea(FX.diff(s, d), TT.gene_sets(s, d), output_cutoff=None).select("database", "comparison", "pathway_id", "effect", "direction", "p_value", "adj_p_value", "gene_set_size", "leading_features"))


def _vector_sets(s, d):
    """Sets over the vectors: one per label."""
    e = TT.table(s, d, "embeddings")
    return e.select(F.lit("label").alias("database"), F.concat(F.lit("L"), "label").alias("gs_name"), F.concat(F.lit("S"), "vec_id").alias("gene_symbol"))


query("e9_gsva")(lambda s, d: EN.gsva(TT.vectors(s, d), _vector_sets(s, d)))
_SSG = f"""{TT.VECTORS_SQL}, rk AS (SELECT feature_symbol AS gene, sample_id, rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY sample_id)::DOUBLE AS n FROM cells JOIN features USING (feature_id)),
st AS (SELECT 'label' AS database, 'L'||label AS term, 'S'||vec_id AS gene FROM embeddings), sz AS (SELECT term, count(*)::DOUBLE k FROM st GROUP BY 1 HAVING count(*) BETWEEN 10 AND 500),
sc AS (SELECT database, term, sample_id, sum(pow(rk, 0.25::DOUBLE) * rk) / sum(pow(rk, 0.25::DOUBLE)) - (any_value(n) * (any_value(n) + 1) / 2 - sum(rk)) / (any_value(n) - any_value(k)) AS score FROM rk JOIN st USING (gene) JOIN sz USING (term) GROUP BY 1, 2, 3)"""
query("e10_ssgsea", f"WITH {_SSG} SELECT database, term, sample_id, {r('score / (SELECT max(score) - min(score) FROM sc)', 6)} AS score FROM sc", 6)(lambda s, d: EN.ssgsea(TT.vectors(s, d), _vector_sets(s, d)))
query("v10_score_heatmap", f"""WITH {_SSG}, nz AS (SELECT database, term, sample_id, score / (SELECT max(score) - min(score) FROM sc) AS score FROM sc), tp AS (SELECT database, term FROM nz GROUP BY 1, 2 ORDER BY var_samp(score) DESC, database, term LIMIT 5)
SELECT database, term, sample_id, {r('(score - avg(score) OVER w) / stddev_samp(score) OVER w', 6)} AS z FROM nz JOIN tp USING (database, term) WINDOW w AS (PARTITION BY database, term)""", 6)(
    lambda s, d: VW.score_heatmap(EN.ssgsea(TT.vectors(s, d), _vector_sets(s, d)), 5))

# ---- feature and sample links --------------------------------------------------------------

FT, FB = TT.FEATURES_SQL, """fb AS (SELECT 'R'||p_partkey AS feature_id, lower('G'||(p_partkey - p_partkey % 2)) AS feature_symbol FROM part)"""


def _fa(s, d):
    return TT.part_features(s, d).select("feature_id", "feature_symbol")


def _fb(s, d):
    return TT.part_features(s, d).select(F.regexp_replace("feature_id", "^P", "R").alias("feature_id"), F.lower("feature_symbol").alias("feature_symbol"))


_PAIRS = f"{FT}, {FB}, pa AS (SELECT a.feature_id AS feature_a, b.feature_id AS feature_b, a.feature_symbol AS label FROM features a JOIN fb b ON upper(trim(a.feature_symbol)) = upper(trim(b.feature_symbol)))"
query("j6_pair_by_symbol", f"WITH {_PAIRS} SELECT feature_a, feature_b, label FROM pa")(lambda s, d: L.pair_by_symbol(_fa(s, d), _fb(s, d)).select("feature_a", "feature_b", "label"))
query("w15_pair_ids", f"WITH {_PAIRS}, n AS (SELECT label, count(*) n, count(DISTINCT feature_a) na, count(DISTINCT feature_b) nb FROM pa GROUP BY 1) SELECT CASE WHEN n > 1 THEN label||' ('||CASE WHEN na > 1 AND nb > 1 THEN feature_a||' / '||feature_b WHEN na > 1 THEN feature_a ELSE feature_b END||')' ELSE label END AS feature_id, feature_a, feature_b FROM pa JOIN n USING (label)")(
    lambda s, d: L.pair_ids(L.pair_by_symbol(_fa(s, d), _fb(s, d))).select("feature_id", "feature_a", "feature_b"))
query("a14_pairing_counts", f"""WITH {_PAIRS}, ca AS (SELECT feature_a, count(*) n FROM pa GROUP BY 1), cb AS (SELECT feature_b, count(*) n FROM pa GROUP BY 1)
SELECT (SELECT count(*) FROM features) AS n_features_a, (SELECT count(*) FROM fb) AS n_features_b, (SELECT count(*) FROM pa) AS n_pairs, (SELECT count(*) FROM ca) AS n_paired_a, (SELECT count(*) FROM cb) AS n_paired_b,
(SELECT count(DISTINCT feature_a) FROM pa JOIN cb USING (feature_b) WHERE n > 1) AS n_a_sharing, (SELECT count(*) FROM cb WHERE n > 1) AS n_b_shared, (SELECT count(DISTINCT feature_b) FROM pa JOIN ca USING (feature_a) WHERE n > 1) AS n_b_sharing, (SELECT count(*) FROM ca WHERE n > 1) AS n_a_shared""")(
    lambda s, d: L.pairing_counts(L.pair_by_symbol(_fa(s, d), _fb(s, d)), _fa(s, d), _fb(s, d)))
query("i4_feature_preview", f"WITH {_PAIRS} SELECT label, count(*) AS n FROM pa GROUP BY 1")(lambda s, d: L.pair_by_symbol(_fa(s, d), _fb(s, d)).groupBy("label").agg(F.count("*").alias("n")))


def _link(s, d):
    """A one-to-many link: the part's id on one side, brand/type on the other; some rows name two parts or a symbol."""
    p = TT.table(s, d, "part")
    left = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("P"), "p_partkey", F.lit("; P"), F.col("p_partkey") + 1)).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit(" g"), F.col("p_partkey") - F.col("p_partkey") % 2)).otherwise(F.concat(F.lit("P"), "p_partkey"))
    return p.select(left.alias("protein"), F.when(F.col("p_size") < 49, F.concat_ws("/", "p_brand", "p_type")).alias("gene"))


_LINK = """lk AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'P'||p_partkey||'; P'||(p_partkey + 1) WHEN 1 THEN 'g'||(p_partkey - p_partkey % 2) ELSE 'P'||p_partkey END AS protein, CASE WHEN p_size < 49 THEN p_brand||'/'||p_type END AS gene FROM part),
lr AS (SELECT *, row_number() OVER () AS row_id FROM lk WHERE gene IS NOT NULL)"""


def _brand_features(s, d):
    return TT.table(s, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("feature_id")).distinct().withColumn("feature_symbol", F.col("feature_id"))


_LPAIR = f"""{FT}, {_LINK}, lv AS (SELECT DISTINCT row_id, upper(trim(v)) AS key FROM (SELECT row_id, unnest(string_split(protein, ';')) v FROM lr)),
ka AS (SELECT feature_id, upper(feature_id) AS key, 1 AS tier FROM features UNION SELECT feature_id, upper(feature_symbol), 3 FROM features), ma AS (SELECT feature_id, row_id, tier FROM ka JOIN lv USING (key)),
mb AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY feature_id) bt FROM ma) WHERE tier = bt),
pa AS (SELECT mb.feature_id AS feature_a, lr.gene AS feature_b, min(tier) AS tier_a FROM mb JOIN lr USING (row_id) GROUP BY 1, 2)"""
query("s7_feature_link", f"WITH {_LINK} SELECT protein, gene FROM lr")(lambda s, d: L.clean_link(_link(s, d), "protein", "gene"))
query("j7_pair_by_link", f"WITH {_LPAIR} SELECT feature_a, feature_b, tier_a FROM pa")(
    lambda s, d: L.pair_by_link(_fa(s, d), _brand_features(s, d), _link(s, d), "protein", "gene").select("feature_a", "feature_b", "tier_a"))
query("w14_best_tier", f"WITH {_LPAIR} SELECT feature_id, any_value(bt) AS tier FROM mb GROUP BY 1")(
    lambda s, d: (lambda k: L.match_side(_fa(s, d), L.clean_link(k, "protein", "gene").withColumn("row_id", F.xxhash64("protein", "gene")), "protein"))(_link(s, d)).select("feature_id", "tier").distinct())
query("j23_guess_link_columns", f"WITH {_LPAIR} SELECT 'protein' AS column_a, 'gene' AS column_b, count(*) AS n_pairs FROM pa UNION ALL SELECT 'gene', 'protein', 0")(
    lambda s, d: L.guess_link_columns(_fa(s, d), _brand_features(s, d), _link(s, d), ["protein", "gene"]))
query("i5_link_validation", f"WITH {_LINK} SELECT count(*) AS n_rows, count(DISTINCT protein) AS n_protein, count(DISTINCT gene) AS n_gene FROM lr")(
    lambda s, d: L.clean_link(_link(s, d), "protein", "gene").agg(F.count("*").alias("n_rows"), F.count_distinct("protein").alias("n_protein"), F.count_distinct("gene").alias("n_gene")))
query("j16_unpaired_features", f"WITH {_LPAIR} SELECT feature_id FROM features WHERE feature_id NOT IN (SELECT feature_a FROM pa)")(
    lambda s, d: L.unmatched(_fa(s, d), L.pair_by_link(_fa(s, d), _brand_features(s, d), _link(s, d), "protein", "gene").select(F.col("feature_a").alias("feature_id")), "feature_id"))


def _sample_link(s, d):
    y = TT.sample_table(s, d)
    return y.where("batch = 'b0'").select(F.lit("protein").alias("tag"), "sample_id", F.concat("nation", F.lit("/"), F.col("year").cast("int")).alias("donor_id")).unionByName(
        y.select(F.lit("rna").alias("tag"), F.concat("sample_id", F.lit("-r")).alias("sample_id"), F.concat("nation", F.lit("/"), F.col("year").cast("int")).alias("donor_id")))


def _rna_samples(s, d):
    y = TT.sample_table(s, d)
    return y.withColumn("sample_id", F.concat("sample_id", F.lit("-r")))


query("j8_pair_by_donor", f"WITH {TT.SAMPLES_SQL} SELECT nation||'/'||year::INT AS donor, sample_id AS sample_a, sample_id||'-r' AS sample_b FROM samples WHERE batch = 'b0'")(
    lambda s, d: L.pair_by_donor(_sample_link(s, d), "protein", "rna", TT.sample_table(s, d), _rna_samples(s, d)))
query("j9_pair_by_id", f"WITH {TT.SAMPLES_SQL} SELECT sample_id AS donor, sample_id AS sample_a, sample_id AS sample_b FROM samples WHERE grp = 'ASIA'")(
    lambda s, d: L.pair_by_id(TT.sample_table(s, d), TT.sample_table(s, d).where("grp = 'ASIA'")))
query("j10_suggested_pairs", f"WITH {TT.SAMPLES_SQL} SELECT lower(sample_id) AS donor, sample_id AS sample_a, sample_id||'-r' AS sample_b FROM samples")(
    lambda s, d: L.suggest_pairs(TT.sample_table(s, d), _rna_samples(s, d)))
query("j11_ambiguous_donors", f"""WITH {TT.SAMPLES_SQL}, p AS (SELECT a.nation AS donor, a.sample_id AS sample_a, b.sample_id AS sample_b FROM samples a JOIN samples b ON a.nation = b.nation),
f AS (SELECT *, row_number() OVER (PARTITION BY donor ORDER BY sample_a, sample_b) k FROM p) SELECT donor, sample_a, sample_b, k > 1 AS is_dropped FROM f""")(
    lambda s, d: L.one_pair_each(L.pair_by_column(TT.sample_table(s, d), TT.sample_table(s, d), "nation")))
query("s6_attach_sheet", f"WITH {TT.SAMPLES_SQL} SELECT sample_id, CASE WHEN batch = 'b0' THEN grp END AS grp, CASE WHEN batch = 'b0' THEN balance END AS balance FROM samples")(
    lambda s, d: L.attach_metadata(TT.sample_table(s, d).select("sample_id"), "sample_id", TT.sample_table(s, d).where("batch = 'b0'").select(
        F.regexp_replace(F.lower("sample_id"), "y", "_Y.").alias("name"), "grp", "balance"), "name"))
query("j2_best_key_column", f"WITH {TT.SAMPLES_SQL} SELECT 'name' AS column_name, count(*) AS n_matched FROM samples")(
    lambda s, d: L.best_key_column(TT.sample_table(s, d).select("sample_id"), "sample_id", TT.sample_table(s, d).select(F.lower("sample_id").alias("name"), "grp", "nation"), ["name", "grp", "nation"]))
query("j3_feature_annotation", "SELECT 'P'||p_partkey AS feature_id, p_brand AS p_brand, p_size AS p_size FROM part")(
    lambda s, d: L.attach_metadata(TT.part_features(s, d).select("feature_id"), "feature_id", TT.table(s, d, "part").select(F.concat(F.lit("p-"), "p_partkey").alias("accession"), "p_brand", "p_size"), "accession"))
_ENSF = "CASE WHEN p_size % 5 = 0 THEN 'ENSG'||lpad(p_partkey::VARCHAR, 11, '0')||'.3_PAR_Y' ELSE 'ENSG'||lpad(p_partkey::VARCHAR, 11, '0')||'.'||p_size END"


def _ens_features(s, d):
    num = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    return TT.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("ENSG"), num, F.lit(".3_PAR_Y"))).otherwise(
        F.concat(F.lit("ENSG"), num, F.lit("."), "p_size")).alias("feature_id"))


query("j4_symbol_by_gene_id", f"WITH f AS (SELECT p_partkey, p_size, {_ENSF} AS feature_id FROM part) SELECT feature_id, CASE WHEN p_size % 5 <> 0 AND p_partkey % 3 <> 0 THEN 'SYM'||p_partkey END AS mapped_symbol FROM f")(
    lambda s, d: L.symbols_by_gene_id(_ens_features(s, d), TT.table(s, d, "part").where("p_partkey % 3 <> 0").select(
        F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias("gene_id"), F.concat(F.lit("SYM"), "p_partkey").alias("symbol"))).select("feature_id", "mapped_symbol"))


def _transcripts(s, d):
    y = TT.counts(s, d).cells
    return y.select(F.concat("feature_id", F.lit(".2")).alias("tx_id"), "sample_id", F.col("value").alias("count"), (100 + F.length("feature_id") * 10 + F.col("value")).alias("length"),
                    F.when(F.col("value") > 10, F.col("value") / 7).otherwise(0.0).alias("tpm"))


_TX = f"""{TT.COUNTS_SQL}, tx AS (SELECT feature_symbol AS gene, sample_id, value, 100 + length(feature_id) * 10 + value AS len, CASE WHEN value > 10 THEN value / 7 ELSE 0 END AS tpm FROM cells JOIN features USING (feature_id)),
g AS (SELECT gene, sample_id, sum(value) c, sum(tpm) tpm, sum(tpm * len) / nullif(sum(tpm), 0) w, avg(len) pl FROM tx GROUP BY 1, 2), b AS (SELECT gene, exp(avg(ln(w))) geo, avg(pl) ml FROM g GROUP BY 1)"""


def _genes(s, d):
    return L.to_genes(_transcripts(s, d), TT.part_features(s, d).select(F.concat("feature_id", F.lit(".1")).alias("tx_id"), F.col("feature_symbol").alias("gene_id")))


query("j5_transcripts_to_genes", f"WITH {_TX} SELECT gene AS feature_id, sample_id, {r('c', 6)} AS value, {r('tpm', 6)} AS tpm, {r('coalesce(w, geo, ml)', 6)} AS eff_length FROM g JOIN b USING (gene)", 6)(_genes)
query("a8_sum_by_gene", f"WITH {_TX} SELECT gene AS feature_id, {r('sum(c)', 6)} AS value FROM g GROUP BY 1", 6)(lambda s, d: _genes(s, d).groupBy("feature_id").agg(F.sum("value").alias("value")))
query("a9_weighted_length", f"WITH {_TX} SELECT gene AS feature_id, {r('avg(coalesce(w, geo, ml))', 6)} AS eff_length FROM g JOIN b USING (gene) GROUP BY 1", 6)(lambda s, d: _genes(s, d).groupBy("feature_id").agg(F.avg("eff_length").alias("eff_length")))

# ---- integration ---------------------------------------------------------------------------

_TWO = f"""{TT.PRICES_SQL}{TT.LOG_SQL}, qc AS (SELECT 'P'||l_partkey AS feature_id, 'N'||s_nationkey||'Y'||year AS sample_id, round(sum(l_quantity), 2) AS value FROM lines GROUP BY l_partkey, s_nationkey, year),
ql AS (SELECT sample_id, sum(value) lib FROM qc GROUP BY 1), qd AS (SELECT replace(feature_id, 'P', 'R') AS feature_id, sample_id, log2(value / lib * 1e6::DOUBLE + 1) AS value FROM qc JOIN ql USING (sample_id)),
fp AS (SELECT f.feature_id AS feature_a, replace(g.feature_id, 'P', 'R') AS feature_b, f.feature_symbol AS label FROM features f JOIN features g USING (feature_symbol)),
pc AS (SELECT feature_a, feature_b, a.sample_id AS donor, a.value AS x, b.value AS y FROM lcells a JOIN fp ON fp.feature_a = a.feature_id JOIN qd b ON b.feature_id = feature_b AND b.sample_id = a.sample_id)"""


def _pairs(s, d):
    return L.pair_by_symbol(_fa(s, d), _fb(s, d))


def _layers(s, d):
    a, b = TT.prices(s, d), FX.counts_as_r(s, d)
    return a, b, L.pair_by_id(a.samples, b.samples)


query("j12_paired_cells", f"WITH {_TWO} SELECT feature_a, feature_b, donor, {r('x', 6)} AS x, {r('y', 6)} AS y FROM pc", 6)(
    lambda s, d: (lambda t: L.paired_cells(N.display_scale(t[0]), N.display_scale(t[1]), _pairs(s, d), t[2]))(_layers(s, d)))
_CORR = """, pr AS (SELECT feature_a, feature_b, rank() OVER (PARTITION BY feature_a, feature_b ORDER BY x) + (count(*) OVER (PARTITION BY feature_a, feature_b, x) - 1) / 2.0::DOUBLE rx,
 rank() OVER (PARTITION BY feature_a, feature_b ORDER BY y) + (count(*) OVER (PARTITION BY feature_a, feature_b, y) - 1) / 2.0::DOUBLE ry, x, y FROM pc),
cs AS (SELECT feature_a, feature_b, count(*) n, CASE WHEN count(*) >= 4 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN round(corr({x}, {y}), 12) + 0.0::DOUBLE END rr FROM pr GROUP BY 1, 2),
ct AS (SELECT *, CASE WHEN 1 - rr * rr > 1e-14 THEN rr * sqrt((n - 2) / (1 - rr * rr)) END AS t, (n - 2)::DOUBLE AS df FROM cs),
cp AS (SELECT fp.*, rr, n, t, CASE WHEN rr IS NULL THEN NULL ELSE {p} END AS p_value FROM fp LEFT JOIN ct USING (feature_a, feature_b)), ca AS ("""


def _corr_sql(x, y, p):
    return _TWO + _CORR.format(x=x, y=y, p=p) + bh("p_value", "", "cp") + ")"


_TW = f"coalesce({t_tail_whole('t', 'df')}, 0)"
query("i1_spearman", f"""WITH {_corr_sql('rx', 'ry', f"greatest({_TW}, CASE WHEN n <= 18 THEN 2 / exp(lgamma(n + 1.0::DOUBLE)) ELSE 0 END)")} SELECT feature_a AS feature_id_a, feature_b AS feature_id_b, {r('rr', 6)} AS effect, {r('(n::DOUBLE * n * n - n) / 6 * (1 - rr)', 4)} AS statistic, {r('p_value', 6)} AS p_value, {r('adj_p_value', 6)} AS adj_p_value,
CASE WHEN rr >= 0 THEN 'positive' WHEN rr < 0 THEN 'negative' END AS direction, coalesce(adj_p_value < 0.05, false) AS is_significant FROM ca""", 6)(
    lambda s, d: (lambda t: IN.run_correlation(t[0], t[1], _pairs(s, d), t[2]))(_layers(s, d)).select("feature_id_a", "feature_id_b", "effect", F.round("statistic", 4).alias("statistic"), "p_value", "adj_p_value", "direction", "is_significant"))
query("i1_pearson", f"WITH {_corr_sql('x', 'y', _TW)} SELECT feature_a AS feature_id_a, feature_b AS feature_id_b, {r('rr', 6)} AS effect, {r('p_value', 6)} AS p_value, {r('adj_p_value', 6)} AS adj_p_value FROM ca", 6)(
    lambda s, d: (lambda t: IN.run_correlation(t[0], t[1], _pairs(s, d), t[2], "pearson"))(_layers(s, d)).select("feature_id_a", "feature_id_b", "effect", "p_value", "adj_p_value"))
_CONC = f"""{D}, {DB}, fp AS (SELECT f.feature_id AS feature_a, replace(g.feature_id, 'P', 'R') AS feature_b, f.feature_symbol AS label FROM features f JOIN features g USING (feature_symbol)),
jn AS (SELECT fp.*, a.effect ea, b.effect eb, a.p_value pa, b.p_value pb, CASE WHEN a.direction <> 'ns' THEN a.direction END da, CASE WHEN b.direction <> 'ns' THEN b.direction END db FROM fp
   JOIN diff a ON a.feature_id = feature_a AND a.comparison = 'ASIA_vs_AFRICA' JOIN diff_b b ON b.feature_id = feature_b AND b.comparison = 'ASIA_vs_AFRICA'),
q AS (SELECT *, da||'_'||db AS quadrant, CASE WHEN da = db THEN 'concordant' WHEN da IS NOT NULL AND db IS NOT NULL THEN 'discordant' END AS direction, coalesce(pa < 0.05, false) sa, coalesce(pb < 0.05, false) sb,
   CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN -2 * (ln(greatest(pa, 2.2250738585072014e-308::DOUBLE)) + ln(greatest(pb, 2.2250738585072014e-308::DOUBLE))) END AS statistic FROM jn),
qp AS (SELECT *, exp(-statistic / 2) * (1 + statistic / 2) AS p_value FROM q), conc AS ({bh('p_value', '', 'qp')})"""


def _conc(s, d):
    return FX.shared(s, d, "conc", lambda: IN.run_concordance(FX.one_comparison(FX.diff(s, d)), FX.one_comparison(FX.diff_b(s, d)), _pairs(s, d), preference="raw"))


_CC = ["feature_id_a", "feature_id_b", "effect", "statistic", "p_value", "adj_p_value", "direction", "quadrant", "is_significant", "significant_a", "significant_b"]
_CQ = f"feature_a AS feature_id_a, feature_b AS feature_id_b, {r('ea - eb')} AS effect, {r('statistic', 5)} AS statistic, {r('p_value')} AS p_value, {r('adj_p_value')} AS adj_p_value, direction, quadrant, sa AND sb AND coalesce(direction = 'concordant', false) AS is_significant, sa AS significant_a, sb AS significant_b"
_r5 = lambda df: df.withColumn("statistic", F.round("statistic", 5))
query("i2_concordance", f"WITH {_CONC} SELECT {_CQ} FROM conc")(lambda s, d: _r5(_conc(s, d).select(*_CC)))
query("f12_quadrants", f"WITH {_CONC} SELECT feature_a AS feature_id_a, feature_b AS feature_id_b, quadrant FROM conc")(lambda s, d: _conc(s, d).select("feature_id_a", "feature_id_b", "quadrant"))
query("a13_quadrant_counts", f"WITH {_CONC} SELECT quadrant, count(*) AS n, sum((sa AND sb)::INT)::BIGINT AS n_both_significant FROM conc GROUP BY 1")(lambda s, d: IN.quadrant_counts(_conc(s, d)))
query("a13_concordance_counts", f"WITH {_CONC} SELECT sum(sa::INT)::BIGINT AS n_significant_a, sum(sb::INT)::BIGINT AS n_significant_b, sum((sa AND sb)::INT)::BIGINT AS n_significant_both, sum((sa AND sb AND coalesce(direction = 'concordant', false))::INT)::BIGINT AS n_concordant, sum((sa AND sb AND coalesce(direction = 'discordant', false))::INT)::BIGINT AS n_discordant FROM conc")(
    lambda s, d: IN.concordance_counts(_conc(s, d)))
query("k4_joint_hits", f"WITH {_CONC} SELECT {_CQ} FROM (SELECT * FROM conc WHERE sa AND sb ORDER BY adj_p_value, p_value, feature_a, feature_b LIMIT 25)")(lambda s, d: _r5(VW.joint_hits(_conc(s, d), 25).select(*_CC)))
query("k10_integration_table", f"WITH {_CONC} SELECT {_CQ}, sa AND sb AS joint FROM conc")(lambda s, d: _r5(VW.integration_table(_conc(s, d)).select(*_CC, "joint")))
query("v8_dual_volcano", f"WITH {_CONC} SELECT 'a' AS side, feature_a, feature_b, {r('ea')} AS x, sa AS significant FROM conc UNION ALL SELECT 'b', feature_a, feature_b, {r('eb')}, sb FROM conc")(
    lambda s, d: (lambda c: VW.dual_volcano(c).join(c.select("feature_id", F.col("feature_id_a").alias("feature_a"), F.col("feature_id_b").alias("feature_b")), "feature_id").select("side", "feature_a", "feature_b", "x", "significant"))(_conc(s, d)))
query("v8_effect_pairs", f"WITH {_CONC} SELECT {r('ea')} AS x, {r('eb')} AS y, quadrant, CASE WHEN sa AND sb THEN direction WHEN sa THEN 'a only' WHEN sb THEN 'b only' ELSE 'ns' END AS class FROM conc")(
    lambda s, d: VW.effect_pairs(_conc(s, d)).drop("feature_id"))
query("k11_point_labels", f"""WITH {_CONC}, rp AS (SELECT label, count(DISTINCT feature_a||feature_b) > 1 rep FROM conc GROUP BY 1) SELECT CASE WHEN rep THEN label||' ('||feature_a||' / '||feature_b||')' ELSE label END AS label FROM conc JOIN rp USING (label) 
WHERE label IN ('G10', 'G20') OR (feature_a, feature_b) IN (SELECT (feature_a, feature_b) FROM conc WHERE p_value IS NOT NULL ORDER BY p_value, feature_a, feature_b LIMIT 15)""")(
    lambda s, d: VW.labels(_conc(s, d), "p_value", 15, ("G10", "G20")).select("label"))
_GSC = """gk AS (SELECT upper(trim(feature_symbol)) AS gene, arg_min(effect, (p_value IS NULL, p_value, feature_id)) AS effect, min(p_value) AS p, greatest(count(p_value), 1) AS k FROM diff WHERE comparison = 'ASIA_vs_AFRICA' GROUP BY 1)"""
query("a19_gene_scores", f"WITH {D}, gk AS (SELECT upper(trim(feature_symbol)) AS gene, min(p_value) AS p, greatest(count(p_value), 1) AS k FROM diff WHERE comparison = 'ASIA_vs_AFRICA' GROUP BY 1) SELECT gene, {r('CASE WHEN k > 1 THEN 1 - pow(1 - p, k) ELSE p END')} AS p, k AS n_features FROM gk")(
    lambda s, d: IN.gene_scores(FX.one_comparison(FX.diff(s, d))).select("gene", "p", "n_features"))


def _side(t):
    return f"(SELECT upper(trim(feature_symbol)) AS gene, CASE WHEN count(p_value) > 1 THEN 1 - pow(1 - min(p_value), count(p_value)) ELSE min(p_value) END AS p FROM {t} WHERE comparison = 'ASIA_vs_AFRICA' GROUP BY 1)"


_SCM = f"{D}, {DB}, sm AS (SELECT gene, greatest(coalesce(a.p, 1), 2.2250738585072014e-308::DOUBLE) AS p_a, greatest(coalesce(b.p, 1), 2.2250738585072014e-308::DOUBLE) AS p_b FROM {_side('diff')} a FULL JOIN {_side('diff_b')} b USING (gene))"


def _scores(s, d):
    return IN.score_matrix(FX.one_comparison(FX.diff(s, d)), FX.one_comparison(FX.diff_b(s, d)))


query("u5_score_union", f"WITH {_SCM} SELECT gene, {r('p_a')} AS p_a, {r('p_b')} AS p_b FROM sm")(lambda s, d: _scores(s, d).select("gene", "p_a", "p_b"))
query("i3_merge_fisher", f"WITH {_SCM}, x AS (SELECT gene, -2 * (ln(p_a) + ln(p_b)) AS x FROM sm) SELECT gene, {r('exp(-x / 2) * (1 + x / 2)')} AS merged_p FROM x")(
    lambda s, d: IN.merge_scores(_scores(s, d), "Fisher").select("gene", "merged_p"))
query("i3_merge_stouffer")(lambda s, d: IN.merge_scores(_scores(s, d), "Stouffer").select("gene", "merged_p"))
query("i3_merge_strube")(lambda s, d: IN.merge_scores(_scores(s, d), "Strube").select("gene", "merged_p"))
query("i3_merge_brown")(lambda s, d: IN.merge_scores(_scores(s, d), "Brown").select("gene", "merged_p"))
query("i3_active_pathways")(lambda s, d: IN.active_pathways(FX.one_comparison(FX.diff(s, d)), FX.one_comparison(FX.diff_b(s, d)), EN.term_tables(TT.gene_sets(s, d))[0].select("term", "gene")))
_PD = f"""{D}, {TT.GENE_SETS_SQL}, mm AS (SELECT gs_name AS term, a.effect AS ea, b.effect AS eb FROM (SELECT DISTINCT gs_name, gene_symbol FROM gene_sets) JOIN (SELECT feature_symbol, max(effect) effect FROM diff WHERE comparison = 'ASIA_vs_AFRICA' GROUP BY 1) a ON a.feature_symbol = gene_symbol
 JOIN (SELECT feature_symbol, max(effect) effect FROM diff WHERE comparison = 'EUROPE_vs_AFRICA' GROUP BY 1) b ON b.feature_symbol = gene_symbol),
pd AS (SELECT term, avg((ea > 0)::INT) FILTER (ea <> 0) ua, avg((eb > 0)::INT) FILTER (eb <> 0) ub, sum((ea <> 0 AND eb <> 0 AND sign(ea) = sign(eb))::INT)::BIGINT n_genes_agree, sum((ea <> 0 AND eb <> 0 AND sign(ea) <> sign(eb))::INT)::BIGINT n_genes_disagree FROM mm GROUP BY 1),
pw AS (SELECT *, CASE WHEN ua > 0.5 THEN 'up' WHEN ua < 0.5 THEN 'down' WHEN ua = 0.5 THEN 'mixed' END da, CASE WHEN ub > 0.5 THEN 'up' WHEN ub < 0.5 THEN 'down' WHEN ub = 0.5 THEN 'mixed' END db FROM pd)"""


def _two_effects(s, d):
    side = lambda c, n: FX.one_comparison(FX.diff(s, d), c).groupBy(F.col("feature_symbol").alias("gene")).agg(F.max("effect").alias(n))
    t = EN.list_sets(TT.gene_sets(s, d)).select(F.col("pathway_id").alias("term"), F.col("gene_symbol").alias("gene"))
    return t.join(side("ASIA_vs_AFRICA", "effect_a"), "gene").join(side("EUROPE_vs_AFRICA", "effect_b"), "gene")


query("a18_majority_direction", f"WITH {_PD} SELECT term, CASE WHEN da IS NULL THEN db WHEN db IS NULL THEN da WHEN da = db THEN da ELSE 'mixed' END AS direction, da AS direction_a, db AS direction_b, CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN da = db AND da <> 'mixed' END AS layers_agree, n_genes_agree, n_genes_disagree FROM pw")(
    lambda s, d: IN.pathway_directions(_two_effects(s, d)))
