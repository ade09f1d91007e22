"""Families of p-values as a whole: the closed test over Simes (Hommel) and the share of true nulls behind q-values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.ordering import cumulative, with_key_table
from assaygrid.session import cut

CUTOFFS = [i / 20 for i in range(1, 20)]


def lower_hull(x, y):
    """Places of the vertices of the lower convex hull of points with rising x."""
    keep: list[int] = []
    for i in range(len(x)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (y[b] - y[a]) * (x[i] - x[a]) < (y[i] - y[a]) * (x[b] - x[a]):
                break
            keep.pop()
        keep.append(i)
    return keep


def closed_simes(p, hull_x, hull_y, n: int):
    """Hommel's adjusted values of the p-values `p` of a family of n, from the hull of the points (rank, p).

    With s_i the Simes p-value of the i largest, the adjusted value of p is the smallest max(s_(i+1), i p) over i. s_i is i times the
    least slope seen from (n - i, 0) to a point of higher rank. That point lies on the lower hull of all points, since points of lower rank lie
    above the line as well; and s falls with i, so the crossing is found by halving.
    """
    def simes(i):
        x0 = n - i
        lo = np.searchsorted(hull_x, x0, side="right")
        hi = np.full_like(lo, len(hull_x) - 1)
        lo = np.minimum(lo, hi)
        # Slopes fall up to the tangent point and rise behind it.
        while (lo < hi).any():
            mid = (lo + hi) // 2
            nxt = np.minimum(mid + 1, len(hull_x) - 1)
            down = hull_y[nxt] * (hull_x[mid] - x0) < hull_y[mid] * (hull_x[nxt] - x0)
            lo, hi = np.where((lo < hi) & down, mid + 1, lo), np.where((lo < hi) & ~down, mid, hi)
        return i * hull_y[lo] / (hull_x[lo] - x0)

    low, high = np.ones(len(p), dtype=np.int64), np.full(len(p), n, dtype=np.int64)
    while (low < high).any():
        mid = (low + high) // 2
        enough = mid * p >= simes(mid + 1)
        low, high = np.where((low < high) & ~enough, mid + 1, low), np.where((low < high) & enough, mid, high)
    return np.minimum(np.minimum(low * p, simes(low)), 1.0)


def hommel(df: DataFrame, keys: list[str], p: str, out: str, few: bool = False) -> DataFrame:
    """(keys, p, out) for every distinct p-value of each family, Hommel's adjustment.

    A family is cut into buckets by value; each bucket gives the hull of its points, the buckets' hulls are merged to one, and every bucket is
    adjusted beside its family's hull. A task holds a bucket and one hull, never a family.
    """
    v = cut(cumulative(df, keys, p, few).select(*keys, F.col(p).alias("_p"), F.col("total").cast("long").alias("_n"), "bucket",
                                                (F.col("below") + F.col("ties")).cast("long").alias("_r")), "hommel")
    schema = v.schema
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in keys]

    def hull(pdf):
        pdf = pdf.sort_values("_r")
        return pdf.iloc[lower_hull(pdf["_r"].to_numpy(), pdf["_p"].to_numpy())]

    # An even rank range per bucket would do as well; buckets exist already and bound a task.
    part = v.groupBy(*keys, "bucket").applyInPandas(lambda g: hull(g)[[*keys, "_r", "_p"]], ", ".join([*kinds, "_r long", "_p double"]))
    one = F.lit(0).alias("_one")
    whole = cut(part.select(*keys, "_r", "_p", one).groupBy(*keys, "_one").applyInPandas(
        lambda g: hull(g)[[*keys, "_r", "_p"]], ", ".join([*kinds, "_r long", "_p double"])), "hommel-hull")
    buckets = cut(v.select(*keys, "bucket").distinct(), "hommel-buckets")
    spread = whole.join(buckets, keys) if keys else whole.join(F.broadcast(buckets.withColumn("_one", F.lit(0))), F.col("_one") == 0).drop("_one")

    def adjust(left, right):
        right = right.sort_values("_r")
        n = int(left["_n"].iloc[0]) if len(left) else 0
        if n:
            left[out] = closed_simes(left["_p"].to_numpy(), right["_r"].to_numpy(), right["_p"].to_numpy(), n)
        else:
            left[out] = left["_p"]
        return left[[*keys, "_p", out]]

    return v.groupBy(*keys, "bucket").cogroup(spread.groupBy(*keys, "bucket")).applyInPandas(
        adjust, ", ".join([*kinds, "_p double", f"`{out}` double"])).withColumnRenamed("_p", p)


def smoothing_weights() -> list[float]:
    """Weights of the raw null shares at CUTOFFS in the value at the last cutoff of a cubic through them by least squares."""
    x = np.vander(np.array(CUTOFFS), 4)
    return (np.linalg.pinv(x).T @ x[-1]).tolist()


def null_share(df: DataFrame, keys: list[str], p: str = "p_value") -> DataFrame:
    """(keys, n_family, null_share): the estimated share of true nulls, at least 1 / n and at most 1.

    For a cutoff c the raw share is the number of p >= c over n (1 - c); a cubic smooths the shares over a grid of cutoffs and
    is read at the last one. One aggregate gives the histogram of all families; NULL p are not counted.
    """
    n = F.count(p).cast("double")
    raw = [F.sum((F.col(p) >= c).cast("double")) / (n * (1 - c)) * w for c, w in zip(CUTOFFS, smoothing_weights())]
    total: Column = raw[0]
    for x in raw[1:]:
        total = total + x
    return df.where(F.col(p).isNotNull()).groupBy(*keys).agg(n.alias("n_family"), F.least(F.lit(1.0), F.greatest(total, 1 / n)).alias("null_share"))


def q_values(df: DataFrame, keys: list[str], p: str = "p_value", out: str = "q_value", bh: str | None = None, few: bool = False) -> DataFrame:
    """q-values: the null share times the Benjamini-Hochberg value, taken from the column `bh` if it is there already."""
    from assaygrid.functions.ordering import adjust_p

    if bh is None:
        df, bh = adjust_p(df, keys, p, "_bh", "BH", few), "_bh"
    shares = cut(null_share(df, keys, p).select(*keys, F.col("null_share").alias("_share")), "null-shares")
    names = [c for c in df.columns if c not in (out, "_bh")]
    joined = with_key_table(df, shares, keys, few) if not keys else df.join(F.broadcast(shares) if few else shares, keys, "left")
    return joined.select(*names, (F.col("_share") * F.col(bh)).alias(out))
