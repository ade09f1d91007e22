"""Q27: variance-stabilising calibration: an offset and a scale for every sample, then the area hyperbolic sine.

The model says arsinh(scale_i * y_ki + offset_i) = mu_k + noise. Means and noise are profiled out, so a fit has two parameters a
sample. Each evaluation sums value, gradient and curvature over the features in one distributed pass; the driver holds numbers by
sample only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.ordering import exact_quantiles
from assaygrid.model import Layer
from assaygrid.operators.diff.kernel import feature_rows
from assaygrid.session import cut

STRATA = 5
SUMS = ("n", "rss", "jac", "ga", "gb", "aa", "ab", "bb", "ja", "jb")


@dataclass(frozen=True)
class Calibration:
    """The calibrated layer, params(sample_id, offset, scale), features(feature_id, n, mean, variance, used), and how the fit ended."""

    layer: Layer
    params: DataFrame
    features: DataFrame
    converged: bool
    trims: int
    passes: int


def _flat(batch, a, b):
    """Feature number, sample number, e^b y and arsinh(e^b y + a) of every cell of a batch of rows (k, v)."""
    import numpy as np

    n = np.diff(batch.column("k").offsets.to_numpy()).astype(np.int64)
    s, y = batch.column("k").flatten().to_numpy(), batch.column("v").flatten().to_numpy()
    z = np.exp(b)[s] * y
    return n, np.repeat(np.arange(len(n)), n), s, z, z + a[s]


def likelihood_sums(rows: DataFrame, a, b):
    """Per sample the ten sums that value, gradient and curvature blocks are made of, as an array [samples, 10]."""
    size = len(a)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(SUMS), size))
        for batch in batches:
            n, f, s, z, u = _flat(batch, a, b)
            h = np.arcsinh(u)
            r = h - (np.bincount(f, h, len(n)) / np.maximum(n, 1))[f]
            q = 1 / (1 + u * u)
            d, own = np.sqrt(q), q * (1 - 1 / n[f])
            for i, w in enumerate((np.ones(len(s)), r * r, -0.5 * np.log(q), r * d, r * d * z, own, own * z, own * z * z, u * q, u * q * z)):
                total[i] += np.bincount(s, w, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *map(pa.array, total)], ["i", *SUMS])

    got = rows.select("k", "v").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("i").agg(
        *[F.sum(c).alias(c) for c in SUMS]).toArrow()
    out = np.zeros((size, len(SUMS)))
    out[got.column("i").to_numpy()] = np.stack([got.column(c).to_numpy() for c in SUMS], axis=1)
    return out


def objective(sums, b):
    """(value, gradient, curvature blocks) of the negative profile log likelihood; samples without cells stay where they are."""
    n, rss, jac, ga, gb, aa, ab, bb, ja, jb = sums.T
    w = n.sum() / max(rss.sum(), 1e-300)
    value = n.sum() / 2 * np.log(max(rss.sum(), 1e-300)) + jac.sum() - (n * b).sum()
    gradient = np.concatenate((w * ga + ja, w * gb + jb - n))
    ridge = 1e-6 * (w * (aa + bb) + n) + (n == 0)
    blocks = np.array([[w * aa + ridge, w * ab], [w * ab, w * bb + ridge]]).transpose(2, 0, 1)
    return value, gradient, blocks


def fit(rows: DataFrame, x, tol: float, most: int):
    """Quasi-Newton steps from x = (offsets, log scales), curvature begun at each sample's Gauss-Newton block: (x, converged, passes)."""
    size, passes = len(x) // 2, 0

    def evaluate(x):
        nonlocal passes
        passes += 1
        sums = likelihood_sums(rows, x[:size], x[size:])
        return *objective(sums, x[size:]), np.maximum(np.tile(sums[:, 0], 2), 1)

    value, g, blocks, weight = evaluate(x)
    steps: list = []
    while passes < most:
        if np.abs(g / weight).max() < tol:
            return x, True, passes
        # Two-loop recursion; the blocks stand for the first curvature.
        p, kept = g.copy(), []
        for s, y in reversed(steps):
            c = (s @ p) / (s @ y)
            kept.append(c)
            p -= c * y
        p = np.linalg.solve(blocks, p.reshape(2, size).T[:, :, None])[:, :, 0].T.reshape(-1)
        for (s, y), c in zip(steps, reversed(kept)):
            p += s * (c - (y @ p) / (s @ y))
        slope = -(g @ p)
        if slope >= 0:
            steps, p = [], np.linalg.solve(blocks, g.reshape(2, size).T[:, :, None])[:, :, 0].T.reshape(-1)
            slope = -(g @ p)
        length = min(1.0, 2.0 / max(np.abs(p).max(), 1e-12))
        while True:
            now = evaluate(x - length * p)
            if now[0] <= value + 1e-4 * length * slope or length < 1e-6 or passes >= most:
                break
            length /= 3
        if now[0] > value:
            return x, bool(np.abs(g / weight).max() < 100 * tol), passes
        s, y = -length * p, now[1] - g
        if s @ y > 1e-10 * np.sqrt((s @ s) * (y @ y)):
            steps = (steps + [(s, y)])[-12:]
        x = x + s
        value, g, blocks, weight = now
    return x, bool(np.abs(g / weight).max() < tol), passes


def feature_table(rows: DataFrame, x) -> DataFrame:
    """(feature_id, n, mean, variance) of the transformed cells of each feature."""
    a, b = x[:len(x) // 2], x[len(x) // 2:]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, f, _, _, u = _flat(batch, a, b)
            h, many = np.arcsinh(u), np.maximum(n, 1)
            mean = np.bincount(f, h, len(n)) / many
            var = np.bincount(f, (h - mean[f]) ** 2, len(n)) / np.maximum(n - 1, 1)
            yield pa.RecordBatch.from_arrays([batch.column("feature_id"), pa.array(n), pa.array(mean), pa.array(var)], ["feature_id", "n", "mean", "variance"])

    return rows.select("feature_id", "k", "v").mapInArrow(run, "feature_id string, n long, mean double, variance double")


def steady_features(table: DataFrame, share: float) -> DataFrame:
    """The table with `used`: in each fifth of the features by mean, those up to the `share` quantile of the variance."""
    table = cut(table.withColumns({c: F.round(c, 9) for c in ("mean", "variance")}), "vsn-features")
    inner = [i / STRATA for i in range(1, STRATA)]
    ends = exact_quantiles(table, [], "mean", inner, [f"q{i}" for i in range(len(inner))])
    ends = ends.select(F.array(*[f"q{i}" for i in range(len(inner))]).alias("ends"))
    placed = table.withColumn("_e", ends.scalar()).withColumn("stratum", F.size(F.filter("_e", lambda e: e < F.col("mean")))).drop("_e")
    bound = exact_quantiles(placed, ["stratum"], "variance", [share], ["bound"], few=True).select("stratum", "bound")
    return placed.join(F.broadcast(bound), "stratum").withColumn("used", F.col("variance") <= F.col("bound")).drop("stratum", "bound")


def calibrate(layer: Layer, share: float = 0.9, tol: float = 1e-4, trims: int = 7, passes: int = 150) -> Calibration:
    """Calibrate a linear intensity layer; values come out on a scale like log2 for large intensities.

    Parameters maximise the profile likelihood over the features with at least two cells, of which fits after the first take the `share` of
    smallest residual variance in each fifth by mean (least trimmed squares). Trimming ends when at most one feature in a thousand changes sides;
    `converged` tells whether it did and whether the last fit's gradient fell below `tol` a cell. Zeros and negative values are
    calibrated like others, absent cells stay absent. The result depends neither on partitioning nor on the order of rows.
    """
    if layer.is_log or layer.omics_type == "rnaseq":
        raise ValueError("variance-stabilising calibration applies to linear intensity layers only")
    names = [r[0] for r in layer.cells.select("sample_id").distinct().orderBy("sample_id").collect()]
    spark = layer.cells.sparkSession
    index = layer.per_sample(spark.createDataFrame(list(zip(names, range(len(names)))), "sample_id string, idx int"))
    rows = cut(feature_rows(layer.cells, index), "vsn-rows")
    typical = {r[0]: r[1] for r in layer.cells.groupBy("sample_id").agg(F.avg(F.abs("value"))).collect()}
    x = np.concatenate((np.zeros(len(names)), [-np.log(typical[s]) if typical[s] > 0 else 0.0 for s in names]))
    enough, total, done, settled, table, before = rows.where(F.size("k") > 1), 0, 0, False, None, None
    good = True
    chosen = enough
    while len(names) and done < trims:
        # Early fits only choose features, so they may stop sooner.
        x, good, used = fit(chosen, x, max(tol, 0.01 / 10**done), passes)
        total, done = total + used, done + 1
        table = cut(steady_features(feature_table(enough, x), share), "vsn-used")
        if before is not None:
            moved = table.join(before.select("feature_id", F.col("used").alias("was")), "feature_id").agg(
                F.coalesce(F.sum((F.col("used") != F.col("was")).cast("long")), F.lit(0)), F.count("*")).first()
            settled = moved[0] * 1000 <= moved[1]
            if settled and 0.01 / 10**(done - 1) <= tol:
                break
        before = table
        chosen = cut(enough.join(table.where("used").select("feature_id"), "feature_id"), "vsn-chosen")
    a, b = x[:len(names)], x[len(names):]
    params = spark.createDataFrame([(s, float(p), float(q)) for s, p, q in zip(names, a, np.exp(b))], "sample_id string, offset double, scale double")
    level = float(np.log2(2) + np.mean(b) / np.log(2)) if len(names) else 0.0
    # Spark's asinh loses the low digits of large negative arguments; the odd part keeps them.
    u = F.col("scale") * F.col("value") + F.col("offset")
    value = F.signum(u) * F.asinh(F.abs(u)) / F.log(F.lit(2.0)) - F.lit(level)
    cells = layer.cells.join(layer.per_sample(params), "sample_id").select("feature_id", "sample_id", value.alias("value"))
    if table is None:
        table = spark.createDataFrame([], "feature_id string, n long, mean double, variance double, used boolean")
    return Calibration(layer.with_cells(cells, "normalized_intensity"), params, table.select("feature_id", "n", "mean", "variance", "used"),
                       bool(good and settled), done, total)
