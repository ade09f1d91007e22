"""Sample x sample products over the feature axis, and what rests on them: correlation and PCA.

Each task turns its features into a small dense block and adds up matrix products; only the
n x n partial sums travel. Sample axes longer than TILE are cut into tiles, and a task then holds
one pair of tiles at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.model import MAX_BROADCAST_SAMPLES, Layer
from assaygrid.operators.cells import safe_z
from assaygrid.session import cut

TILE = 2048


def sample_index(layer: Layer) -> tuple[list[str], DataFrame]:
    """Sample ids in id order and the (sample_id, idx) table; refuses an unbounded sample axis."""
    if layer.sample_count() > MAX_BROADCAST_SAMPLES:
        raise ValueError("a sample x sample table over this many samples is not materialised")
    spark = layer.samples.sparkSession
    ids = sorted(r[0] for r in layer.samples.select("sample_id").distinct().collect())
    table = spark.createDataFrame(pd.DataFrame({"sample_id": ids, "idx": range(len(ids))}), "sample_id string, idx int")
    return ids, F.broadcast(table)


def _dense(rows: pd.DataFrame, idx: str, val: str, width: int) -> np.ndarray:
    """One batch of sparse rows as a dense block with NaN for absent cells."""
    block = np.full((len(rows), width), np.nan)
    sizes = rows[idx].map(len).to_numpy()
    if sizes.sum():
        at = np.repeat(np.arange(len(rows)), sizes)
        block[at, np.concatenate(rows[idx].to_numpy())] = np.concatenate(rows[val].to_numpy())
    return block


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pair counts, sums, squares and cross products of the columns of two blocks."""
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    xa, xb = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    ma, mb = ma.astype(float), mb.astype(float)
    return np.stack([ma.T @ mb, xa.T @ mb, (xa * xa).T @ mb, ma.T @ xb, ma.T @ (xb * xb), xa.T @ xb])


PRODUCT_NAMES = ("n", "sx", "sxx", "sy", "syy", "sxy")


def pair_products(cells: DataFrame, n: int) -> DataFrame:
    """(i, array columns over j) sums of products from cells(feature_id, idx, value)."""
    tiles = -(-n // TILE)
    entry = F.struct(F.pmod(F.col("idx"), F.lit(TILE)).alias("k"), F.col("value").alias("v"))
    parts = cells.groupBy("feature_id", F.floor(F.col("idx") / TILE).cast("int").alias("t")).agg(
        F.collect_list(entry).alias("e"))
    parts = parts.select("feature_id", "t", F.col("e.k").alias("k"), F.col("e.v").alias("v"))
    if tiles == 1:
        rows = parts.select(F.lit(0).alias("ti"), F.lit(0).alias("tj"), F.col("k").alias("ki"), F.col("v").alias("vi"),
                            F.col("k").alias("kj"), F.col("v").alias("vj"))
    else:
        # Each feature meets its own tiles only; pairs of tiles are spread over tasks by feature hash.
        packed = parts.groupBy("feature_id").agg(F.collect_list(F.struct("t", "k", "v")).alias("tiles"))
        rows = packed.select(
            "feature_id", F.explode("tiles").alias("p"), "tiles").select(
            "feature_id", "p", F.explode("tiles").alias("q")).select(
            F.pmod(F.xxhash64("feature_id"), F.lit(64)).alias("salt"), F.col("p.t").alias("ti"), F.col("q.t").alias("tj"),
            F.col("p.k").alias("ki"), F.col("p.v").alias("vi"), F.col("q.k").alias("kj"), F.col("q.v").alias("vj"),
        ).repartition("ti", "tj", "salt").sortWithinPartitions("ti", "tj").drop("salt")

    def kernel(batches):
        current, total = None, None

        def flush():
            ti, tj = current
            hi = min(TILE, n - ti * TILE)
            out = {"i": ti * TILE + np.arange(hi), "tj": np.full(hi, tj)}
            for name, m in zip(PRODUCT_NAMES, total):
                out[name] = list(m[:hi])
            return pd.DataFrame(out)

        for batch in batches:
            for key, part in batch.groupby(["ti", "tj"], sort=False):
                if current is not None and key != current:
                    yield flush()
                    total = None
                current = key
                wi, wj = (min(TILE, n - t * TILE) for t in key)
                for lo in range(0, len(part), 4096):
                    piece = part.iloc[lo:lo + 4096]
                    a = _dense(piece, "ki", "vi", wi)
                    b = a if tiles == 1 else _dense(piece, "kj", "vj", wj)
                    p = _products(a, b)
                    total = p if total is None else total + p
        if current is not None:
            yield flush()

    schema = "i int, tj int, " + ", ".join(f"{c} array<double>" for c in PRODUCT_NAMES)
    partial = rows.mapInPandas(kernel, schema)

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        out = {"i": [first.i], "tj": [first.tj]}
        for name in PRODUCT_NAMES:
            out[name] = [np.sum(np.stack(pdf[name].to_numpy()), axis=0)]
        return pd.DataFrame(out)

    return partial.groupBy("i", "tj").applyInPandas(add_up, schema)


def sample_correlation(layer: Layer) -> DataFrame:
    """Pearson correlation of every pair of samples over the features both have."""
    ids, index = sample_index(layer)
    means = layer.cells.groupBy("sample_id").agg(F.avg("value").alias("m"))
    cells = layer.cells.join(layer.per_sample(means), "sample_id").join(index, "sample_id").select(
        "feature_id", "idx", (F.col("value") - F.col("m")).alias("value"))
    wide = pair_products(cells, len(ids))
    zipped = F.arrays_zip(*PRODUCT_NAMES)
    long = wide.select("i", "tj", F.posexplode(zipped).alias("k", "s")).select(
        "i", (F.col("tj") * TILE + F.col("k")).alias("j"), "s.*")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = F.when((F.col("n") >= 2) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    names_i = index.select(F.col("sample_id").alias("sample_a"), F.col("idx").alias("i"))
    names_j = index.select(F.col("sample_id").alias("sample_b"), F.col("idx").alias("j"))
    return long.join(F.broadcast(names_i), "i").join(F.broadcast(names_j), "j").select(
        "sample_a", "sample_b", F.col("n").cast("long").alias("n_shared"), r.alias("r"))


def connectivity(layer: Layer, sd: float = 2.0) -> DataFrame:
    """Q4: mean correlation with the other samples; low outliers flagged."""
    mean = sample_correlation(layer).where("sample_a <> sample_b").groupBy(F.col("sample_a").alias("sample_id")).agg(
        F.avg("r").alias("mean_correlation"))
    return safe_z(mean, "mean_correlation").withColumn("is_outlier", F.col("z_score") < -sd)


def standardized(layer: Layer) -> DataFrame:
    """Cells scaled per feature to unit variance after mean imputation; constant features left out."""
    stats = layer.cells.groupBy("feature_id").agg(
        F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ss"))
    sd = F.sqrt(F.col("ss") / (layer.n_samples() - 1))
    return layer.cells.join(stats.where("ss > 0"), "feature_id").select(
        "feature_id", "sample_id", ((F.col("value") - F.col("m")) / sd).alias("value"))


def _leading_vectors(gram: DataFrame, n: int, k: int):
    """Leading eigenpairs of the n x n product table, on the driver when it fits, else by iteration."""
    if n <= TILE:
        g = np.zeros((n, n))
        for row in gram.select("i", "sxy").collect():
            g[row.i] = row.sxy
        vals, vecs = np.linalg.eigh((g + g.T) / 2)
        return vals[::-1][:k], vecs[:, ::-1][:, :k], float(np.trace(g))
    table = cut(gram.select("i", "tj", "sxy"), "gram")
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rng.standard_normal((n, k + 4)))[0]
    for _ in range(40):
        held = basis

        def step(batches):
            for b in batches:
                for i, tj, row in zip(b.i, b.tj, b.sxy):
                    lo = tj * TILE
                    yield pd.DataFrame({"i": [i], "y": [np.asarray(row) @ held[lo:lo + len(row)]]})

        nxt = np.zeros_like(basis)
        for r in table.mapInPandas(step, "i int, y array<double>").collect():
            nxt[r.i] += r.y
        small = basis.T @ nxt
        vals, rot = np.linalg.eigh((small + small.T) / 2)
        basis = np.linalg.qr(nxt @ rot[:, ::-1])[0]
    diag = table.where(F.col("tj") == F.floor(F.col("i") / TILE)).agg(
        F.sum(F.element_at("sxy", (F.col("i") % TILE + 1).cast("int")))).first()[0]
    return vals[::-1][:k], basis[:, :k], float(diag)


def pca(layer: Layer, components: int = 2) -> tuple[DataFrame, DataFrame]:
    """Q6: (scores per sample, summary). The sign makes the largest score of a component positive."""
    ids, index = sample_index(layer)
    z = standardized(layer)
    gram = pair_products(z.join(index, "sample_id").select("feature_id", "idx", "value"), len(ids))
    vals, vecs, total = _leading_vectors(gram, len(ids), components)
    scores = vecs * np.sqrt(np.maximum(vals, 0.0))
    for c in range(scores.shape[1]):
        if scores[np.argmax(np.abs(scores[:, c])), c] < 0:
            scores[:, c] = -scores[:, c]
    spark = layer.samples.sparkSession
    table = pd.DataFrame({"sample_id": ids})
    for c in range(scores.shape[1]):
        table[f"PC{c + 1}"] = scores[:, c]
    summary = pd.DataFrame({
        "component": [f"PC{c + 1}" for c in range(scores.shape[1])],
        "variance_pct": [100.0 * v / total if total > 0 else 0.0 for v in vals],
    })
    return spark.createDataFrame(table), spark.createDataFrame(summary)


def pca_outliers(layer: Layer, sd: float = 3.0) -> DataFrame:
    """Q3: samples far out on the first or second component."""
    scores, _ = pca(layer, 2)
    z = safe_z(safe_z(scores, "PC1", "z_pc1"), "PC2", "z_pc2")
    return z.withColumn("is_outlier", (F.abs("z_pc1") > sd) | (F.abs("z_pc2") > sd))
