"""The test tables as layers, gene sets and links.

Features are parts, so the feature axis grows with the data. Samples are supplier nation x ship
year, so the sample axis keeps its size. Each Spark builder has a SQL twin used by the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.model import Layer, make_layer
from assaygrid.session import scratch_path

_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared(spark, sf: str, name: str, build) -> DataFrame:
    """The table `name` for this application and folder, written to the scratch folder on first use."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark, sf, *cols):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("year"), *cols)
    su = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return li.join(su, F.col("l_suppkey") == F.col("s_suppkey"))


def sample_table(spark, sf) -> DataFrame:
    """One row per (nation, year) with lines, as a written table like any study's sample sheet."""
    return shared(spark, sf, "samples", lambda: _samples(spark, sf))


def _samples(spark, sf) -> DataFrame:
    """grp, nation, year, batch and balance of each (nation, year)."""
    seen = (
        table(spark, sf, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year")).distinct()
        .join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("s_nationkey", "year").distinct()
    )
    money = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 2).alias("balance"))
    geo = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        seen.join(money, "s_nationkey").join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("N"), F.col("s_nationkey"), F.lit("Y"), F.col("year")).alias("sample_id"),
            F.col("r_name").alias("grp"), F.col("n_name").alias("nation"), F.col("year").cast("double").alias("year"),
            F.concat(F.lit("b"), F.col("s_nationkey") % 2).alias("batch"), "balance",
        )
    )


SAMPLES_SQL = """
lines AS (SELECT l_partkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_suppkey, s_nationkey, year(l_shipdate) AS year
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
samples AS (
  SELECT 'N'||s.s_nationkey||'Y'||s.year AS sample_id, r_name AS grp, n_name AS nation, s.year::DOUBLE AS year,
         'b'||(s.s_nationkey % 2) AS batch, balance
  FROM (SELECT DISTINCT s_nationkey, year FROM lines) s
  JOIN (SELECT s_nationkey, round(avg(s_acctbal), 2) AS balance FROM supplier GROUP BY 1) m USING (s_nationkey)
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def part_features(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("P"), "p_partkey").alias("feature_id"),
        F.concat(F.lit("G"), (F.col("p_partkey") - F.col("p_partkey") % 2)).alias("feature_symbol"),
        F.lit("part").alias("feature_type"), "p_brand", "p_type", "p_size", "p_name",
    )


FEATURES_SQL = """
features AS (SELECT 'P'||p_partkey AS feature_id, 'G'||(p_partkey - p_partkey % 2) AS feature_symbol,
                    'part' AS feature_type, p_brand, p_type, p_size, p_name FROM part)"""


def _part_cells(spark, sf, col, feature_id=None):
    """Sums per part and (nation, year). Lines move once, to their feature: hardly two of them share a cell, so summing before that saves nothing.

    The number of partitions is named, so that they are not merged: a cell takes far more room in a hash table than in a shuffle.
    """
    own = F.concat(F.lit("P"), "l_partkey") if feature_id is None else feature_id
    lines = _lines(spark, sf, col).select(own.alias("feature_id"), "s_nationkey", "year", col).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "feature_id")
    return (
        lines.groupBy("feature_id", "s_nationkey", "year").agg(F.round(F.sum(col), 2).alias("value"))
        .select("feature_id", F.concat(F.lit("N"), F.col("s_nationkey"), F.lit("Y"), F.col("year")).alias("sample_id"), "value")
    )


def prices(spark, sf) -> Layer:
    """Linear intensities: revenue per part and (nation, year)."""
    return make_layer(_part_cells(spark, sf, "l_extendedprice"), sample_table(spark, sf), part_features(spark, sf),
                      "proteomics", "raw_intensity", "grp", "AFRICA")


def counts(spark, sf, feature_id=None) -> Layer:
    """Whole-number counts: quantity per part and (nation, year)."""
    return make_layer(_part_cells(spark, sf, "l_quantity", feature_id), sample_table(spark, sf), part_features(spark, sf),
                      "rnaseq", "raw_count", "grp", "AFRICA")


def cells_sql(col: str) -> str:
    return f"""
cells AS (SELECT 'P'||l_partkey AS feature_id, 'N'||s_nationkey||'Y'||year AS sample_id, round(sum({col}), 2) AS value
          FROM lines GROUP BY l_partkey, s_nationkey, year)"""


PRICES_SQL = SAMPLES_SQL + "," + FEATURES_SQL + "," + cells_sql("l_extendedprice")
COUNTS_SQL = SAMPLES_SQL + "," + FEATURES_SQL + "," + cells_sql("l_quantity")
LOG_SQL = """, lcells AS (SELECT feature_id, sample_id, log2(value + 1) AS value FROM cells)"""


def brands(spark, sf, col="l_extendedprice") -> Layer:
    """A dense layer: brand x type against (nation, year)."""
    counts_like = col == "l_quantity"
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("feature_id"))
    pre = _lines(spark, sf, col).groupBy("l_partkey", "s_nationkey", "year").agg(F.sum(col).alias("v"))
    cells = pre.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("feature_id", "s_nationkey", "year").agg(
        F.round(F.sum("v"), 2).alias("value"))
    cells = cells.select(
        "feature_id", F.concat(F.lit("N"), F.col("s_nationkey"), F.lit("Y"), F.col("year")).alias("sample_id"), "value")
    features = p.select("feature_id").distinct()
    return make_layer(cells, sample_table(spark, sf), features, *(
        ("rnaseq", "raw_count") if counts_like else ("proteomics", "raw_intensity")), "grp", "AFRICA")


def brands_sql(col="l_extendedprice") -> str:
    return SAMPLES_SQL + f""",
features AS (SELECT DISTINCT p_brand||'/'||p_type AS feature_id, p_brand||'/'||p_type AS feature_symbol, 'feature' AS feature_type FROM part),
cells AS (SELECT p_brand||'/'||p_type AS feature_id, 'N'||s_nationkey||'Y'||year AS sample_id, round(sum({col}), 2) AS value
          FROM lines JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def yearly(spark, sf) -> Layer:
    """Parts against ship years: a long feature axis whose rows are nearly complete."""
    cells = table(spark, sf, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("value")).select(
        F.concat(F.lit("P"), "l_partkey").alias("feature_id"), F.concat(F.lit("Y"), "year").alias("sample_id"), "value")
    samples = table(spark, sf, "lineitem").select(F.concat(F.lit("Y"), F.year("l_shipdate")).alias("sample_id")).distinct()
    return make_layer(cells, samples, part_features(spark, sf), "proteomics", "raw_intensity")


YEARS_SQL = FEATURES_SQL + """,
cells AS (SELECT 'P'||l_partkey AS feature_id, 'Y'||year(l_shipdate) AS sample_id, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2),
samples AS (SELECT DISTINCT 'Y'||year(l_shipdate) AS sample_id FROM lineitem)"""


def flagged(spark, sf) -> Layer:
    """A paired layer: samples are nation x return flag, paired by nation."""
    su = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    rows = li.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
    cells = rows.groupBy("l_partkey", "s_nationkey", "l_returnflag").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("value")).select(
        F.concat(F.lit("P"), "l_partkey").alias("feature_id"),
        F.concat(F.lit("N"), F.col("s_nationkey"), F.col("l_returnflag")).alias("sample_id"), "value")
    pairs = (
        li.select("l_suppkey", "l_returnflag").distinct().join(su, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("s_nationkey", "l_returnflag").distinct()
    )
    samples = pairs.select(
        F.concat(F.lit("N"), F.col("s_nationkey"), F.col("l_returnflag")).alias("sample_id"),
        F.col("l_returnflag").alias("grp"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("donor"))
    return make_layer(cells, samples, part_features(spark, sf), "proteomics", "raw_intensity", "grp", "A")


FLAGGED_SQL = """
frows AS (SELECT l_partkey, s_nationkey, l_returnflag, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
samples AS (SELECT DISTINCT 'N'||s_nationkey||l_returnflag AS sample_id, l_returnflag AS grp, 'N'||s_nationkey AS donor FROM frows),
cells AS (SELECT 'P'||l_partkey AS feature_id, 'N'||s_nationkey||l_returnflag AS sample_id, round(sum(l_extendedprice), 2) AS value
          FROM frows GROUP BY l_partkey, s_nationkey, l_returnflag),""" + FEATURES_SQL


def vectors(spark, sf) -> Layer:
    """A complete signed log-scale layer: a feature per vector, a sample per dimension."""
    e = table(spark, sf, "embeddings")
    cells = e.select(F.concat(F.lit("v"), "vec_id").alias("feature_id"), F.posexplode("embedding").alias("pos", "x")).select(
        "feature_id", F.concat(F.lit("d"), "pos").alias("sample_id"), F.col("x").cast("double").alias("value"))
    samples = e.select(F.sequence(F.lit(0), F.size("embedding") - 1).alias("p")).distinct().select(
        F.explode("p").alias("pos")).distinct().select(
        F.concat(F.lit("d"), "pos").alias("sample_id"), F.concat(F.lit("g"), F.col("pos") % 4).alias("grp"),
        F.col("pos").cast("double").alias("age"), F.concat(F.lit("b"), F.floor(F.col("pos") / 4) % 2).alias("batch"))
    features = e.select(F.concat(F.lit("v"), "vec_id").alias("feature_id"), F.concat(F.lit("S"), "vec_id").alias("feature_symbol"))
    return make_layer(cells, samples, features, "proteomics", "normalized_intensity", "grp", "g0")


VECTORS_SQL = """
cells AS (SELECT 'v'||vec_id AS feature_id, 'd'||(pos - 1) AS sample_id, embedding[pos]::DOUBLE AS value
          FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)),
samples AS (SELECT 'd'||p AS sample_id, 'g'||(p % 4) AS grp, p::DOUBLE AS age, 'b'||((p // 4) % 2) AS batch
            FROM (SELECT DISTINCT unnest(range(0, len(embedding))) AS p FROM embeddings)),
features AS (SELECT 'v'||vec_id AS feature_id, 'S'||vec_id AS feature_symbol, 'feature' AS feature_type FROM embeddings)"""


def event_counts(spark, sf) -> Layer:
    """Event counts: a feature per user, a sample per event type and hour of day."""
    ev = table(spark, sf, "events")
    sid = F.concat_ws("_", "event_type", F.hour("ts").cast("string"))
    cells = ev.groupBy(F.concat(F.lit("u"), "user_id").alias("feature_id"), sid.alias("sample_id")).agg(
        F.count("*").cast("double").alias("value"))
    samples = ev.select(sid.alias("sample_id"), F.col("event_type").alias("grp"), F.hour("ts").cast("double").alias("hour")).distinct()
    features = ev.select(F.concat(F.lit("u"), "user_id").alias("feature_id")).distinct()
    return make_layer(cells, samples, features, "rnaseq", "raw_count", "grp", "view")


EVENTS_SQL = """
cells AS (SELECT 'u'||user_id AS feature_id, event_type||'_'||hour(ts) AS sample_id, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
samples AS (SELECT DISTINCT event_type||'_'||hour(ts) AS sample_id, event_type AS grp, hour(ts)::DOUBLE AS hour FROM events),
features AS (SELECT DISTINCT 'u'||user_id AS feature_id, 'u'||user_id AS feature_symbol, 'feature' AS feature_type FROM events)"""


def gene_sets(spark, sf) -> DataFrame:
    """Gene-set rows from part attributes: databases brand, size and name, over the part symbols."""
    p = part_features(spark, sf)
    rows = []
    for db, col, prefix in (("brand", "p_brand", "KEGG_"), ("size", "p_size", "REACTOME_"), ("name", "p_name", "GOBP_")):
        sid = F.concat(F.lit(prefix), F.regexp_replace(F.upper(F.col(col).cast("string")), "[^A-Z0-9]", "_"))
        rows.append(p.select(
            F.lit(db).alias("database"), F.lit("Hs").alias("organism"), sid.alias("gs_name"),
            F.col("feature_symbol").alias("gene_symbol"), F.col(col).cast("string").alias("gs_description"),
            F.concat(F.lit(db), F.lit(":"), F.col(col).cast("string")).alias("gs_id"), F.lit("part").alias("gs_source")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


GENE_SETS_SQL = """
gene_sets AS (
  SELECT 'brand' AS database, 'Hs' AS organism, 'KEGG_'||regexp_replace(upper(p_brand), '[^A-Z0-9]', '_', 'g') AS gs_name, feature_symbol AS gene_symbol,
         p_brand AS gs_description, 'brand:'||p_brand AS gs_id, 'part' AS gs_source FROM features
  UNION ALL SELECT 'size', 'Hs', 'REACTOME_'||p_size, feature_symbol, p_size::VARCHAR, 'size:'||p_size, 'part' FROM features
  UNION ALL SELECT 'name', 'Hs', 'GOBP_'||regexp_replace(upper(p_name), '[^A-Z0-9]', '_', 'g'), feature_symbol, p_name, 'name:'||p_name, 'part' FROM features)"""
