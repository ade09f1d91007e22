"""Order statistics, ranks and p-value adjustment that never put a whole family in one task.

Rows with equal values are counted together first (map-side combined), each family's distinct
values are cut into buckets at sketched quantiles, and running counts are built inside a bucket
and shifted by the totals of the buckets before it. The bucket table holds at most BUCKETS rows
per family, so the only windows over a family are over that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.session import cut

BUCKETS = 128
# Cuts passed at a time when a value's bucket is looked up.
STRIDE = 12
# Families with fewer distinct values than this stay in one bucket.
SPLIT_FROM = 200_000


def with_key_table(df: DataFrame, table: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Attach a table with one row per key: a scalar without keys, a broadcast when the caller
    knows the number of keys to be small, else a join left to the optimiser."""
    if not keys:
        return df.withColumn("_k", table.select(F.struct("*")).scalar()).select("*", "_k.*").drop("_k")
    return df.join(F.broadcast(table) if few else table, keys)


def cumulative(df: DataFrame, keys: list[str], col: str, few: bool = False) -> DataFrame:
    """Distinct (keys, col) with `ties`, `below` (rows with a smaller value), `total` and `bucket`.

    The cuts are written before use: a sketch depends on the order in which its parts arrive, and every
    branch of a plan that reads the buckets must place a value in the same one.

    `few` says the keys are samples or named comparisons, whose number was checked or is set by
    the caller.
    """
    ties = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("ties"))
    cuts = ties.groupBy(*keys).agg(
        F.sum("ties").alias("total"), F.count("*").alias("n_distinct"),
        F.percentile_approx(col, [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("cuts"),
    )
    cuts = cut(cuts.select(
        *keys, "total",
        F.when(F.col("n_distinct") >= SPLIT_FROM, F.col("cuts"))
        .otherwise(F.slice("cuts", 1, 0)).alias("cuts"),
    ), "cuts")
    placed = with_key_table(ties, cuts, keys, few).withColumn("bucket", _cuts_below(F.col("cuts"), F.col(col))).drop("cuts")
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "bucket").agg(F.sum("ties").alias("in_bucket")).select(
        *keys, "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy(*keys, "bucket").orderBy(col).rowsBetween(W.unboundedPreceding, -1)
    return placed.join(sums, [*keys, "bucket"]).select(
        *keys, col, "ties", "total", "bucket",
        (F.col("offset") + F.coalesce(F.sum("ties").over(inside), F.lit(0))).alias("below"),
    )


def _cuts_below(cuts: Column, x: Column) -> Column:
    """Number of the sorted cuts below x: whole strides of STRIDE cuts first, then inside one stride."""
    below = lambda c: c < x
    strides = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(BUCKETS // STRIDE)), lambda i: F.get(cuts, i * STRIDE - 1)), below))
    count = strides * STRIDE + F.size(F.filter(F.slice(cuts, strides * STRIDE + 1, F.lit(STRIDE)), below))
    # Never NULL, and said so: else joins on the bucket look it up once more for every row below the aggregate.
    return F.coalesce(count, F.lit(0))


def _attach(df: DataFrame, per_value: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Join per-value results back onto rows; rows with a NULL value keep NULL."""
    return df.join(per_value, [*keys, col], "left")


def average_ranks(df: DataFrame, keys: list[str], col: str, out: str = "rank", few: bool = False) -> DataFrame:
    """W4 over unbounded families: ascending ranks, ties averaged."""
    per = cumulative(df, keys, col, few).select(
        *keys, col, (F.col("below") + (F.col("ties") + 1) / 2).alias(out)
    )
    return _attach(df, per, keys, col)


def small_group_ranks(keys: list[str], col: str) -> Column:
    """W4 inside groups bounded by the number of samples: a plain window."""
    w = W.partitionBy(*keys).orderBy(col)
    return F.rank().over(w) + (F.count("*").over(W.partitionBy(*keys, col)) - 1) / 2.0


def _running(values: DataFrame, keys, col, score: str, out: str, downward: bool) -> DataFrame:
    """Running minimum from the largest value down, or maximum from the smallest up."""
    pick = F.min if downward else F.max
    direction = (lambda c: F.col(c).desc()) if downward else (lambda c: F.col(c).asc())
    inside = W.partitionBy(*keys, "bucket").orderBy(direction(col)).rowsBetween(W.unboundedPreceding, 0)
    outside = W.partitionBy(*keys).orderBy(direction("bucket")).rowsBetween(W.unboundedPreceding, -1)
    rest = values.groupBy(*keys, "bucket").agg(pick(score).alias("edge")).select(
        *keys, "bucket", pick("edge").over(outside).alias("edge")
    )
    merge = F.least if downward else F.greatest
    return values.withColumn("inner_run", pick(score).over(inside)).join(rest, [*keys, "bucket"]).select(
        *keys, col, F.least(merge("inner_run", "edge"), F.lit(1.0)).alias(out)
    )


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, exact below 1,000 terms and by its asymptotic series above."""
    exact = F.aggregate(
        F.sequence(F.lit(1), F.least(n, F.lit(1000)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i
    )
    series = F.log(n) + F.lit(0.5772156649015329) + 0.5 / n - 1 / (12.0 * n * n)
    return F.when(n <= 1000, exact).otherwise(series)


ADJUSTMENTS = ("none", "bonferroni", "BH", "fdr", "BY", "holm", "hochberg", "hommel")


def adjust_p(df: DataFrame, keys: list[str], p: str = "p_value", out: str = "adj_p_value",
             method: str = "BH", few: bool = False, written: bool = False) -> DataFrame:
    """Adjusted p-values per family; NULL p stays NULL and is not counted.

    The adjustment reads its input several times, so the table of p-values is written once first
    unless `written` says that it already is one.
    """
    if method not in ADJUSTMENTS:
        raise ValueError(f"unknown adjustment {method!r}; one of {ADJUSTMENTS}")
    df = df.drop(out)
    if method == "none":
        return df.withColumn(out, F.col(p))
    if method == "bonferroni":
        n = df.groupBy(*keys).agg(F.count(p).alias("n_family"))
        return with_key_table(df, n, keys, few).withColumn(
            out, F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.col("n_family"), F.lit(1.0)))).drop("n_family")
    if not written:
        df = cut(df, "p-values")
    if method == "hommel":
        from assaygrid.functions.families import hommel

        return _attach(df, hommel(df, keys, p, out, few), keys, p)
    v = cumulative(df, keys, p, few)
    upto = F.col("below") + F.col("ties")
    n = F.col("total")
    score = {
        "BH": F.col(p) * n / upto,
        "fdr": F.col(p) * n / upto,
        "BY": harmonic(n) * F.col(p) * n / upto,
        "holm": F.col(p) * (n - F.col("below")),
        "hochberg": F.col(p) * (n - upto + 1),
    }[method]
    per = _running(v.withColumn("score", score), keys, p, "score", out, downward=method != "holm")
    return _attach(df, per, keys, p)


def order_stats(df: DataFrame, keys: list[str], col: str, wanted: list[tuple[float, Column]],
                few: bool = False) -> DataFrame:
    """Exact order statistics of unbounded groups.

    `wanted` holds (fraction, rank) pairs: `rank` is a 0-based rank as a column expression over
    the group size `n`, `fraction` the approximate place of that rank in [0, 1]. A sketch brackets
    each rank, one scan counts the rows below and inside the bracket, and only rows of the segment
    holding the rank are ordered. `df` is read three times and must give the same values each time, so a
    caller writes averages and the like first. Output: keys, n and array `os` of (value, below, ties).
    """
    eps = 0.002
    probs = sorted({min(max(f + s, 0.0), 1.0) for f, _ in wanted for s in (-eps, eps)})
    place = {p: i for i, p in enumerate(probs)}
    src = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("x"))
    sketch = src.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile_approx("x", probs, 2000).alias("cuts")
    )
    rows = with_key_table(src, sketch, keys, few)
    counts = rows.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("cuts").alias("cuts"),
        *[F.sum((F.col("x") < F.col("cuts")[i]).cast("long")).alias(f"lt{i}") for i in range(len(probs))],
        *[F.sum((F.col("x") <= F.col("cuts")[i]).cast("long")).alias(f"le{i}") for i in range(len(probs))],
    )
    entries = []
    for j, (f, rank) in enumerate(wanted):
        lo, hi = place[min(max(f - eps, 0.0), 1.0)], place[min(max(f + eps, 0.0), 1.0)]
        r = rank.cast("long")
        low, high = F.col("cuts")[lo], F.col("cuts")[hi]
        entries.append(
            F.when(r < F.col(f"lt{lo}"), F.struct(F.lit(j).alias("j"), r.alias("r"), F.lit(0).alias("seg"),
                                                  low.alias("lo"), high.alias("hi"), F.lit(0).cast("long").alias("skip")))
            .when(r >= F.col(f"le{hi}"), F.struct(F.lit(j).alias("j"), r.alias("r"), F.lit(2).alias("seg"),
                                                   low.alias("lo"), high.alias("hi"), F.col(f"le{hi}").alias("skip")))
            .otherwise(F.struct(F.lit(j).alias("j"), r.alias("r"), F.lit(1).alias("seg"),
                                low.alias("lo"), high.alias("hi"), F.col(f"lt{lo}").alias("skip")))
        )
    targets = counts.select(*keys, "n", F.array(*entries).alias("targets"))

    def inside(t):
        return (
            ((t["seg"] == 0) & (F.col("x") < t["lo"]))
            | ((t["seg"] == 1) & (F.col("x") >= t["lo"]) & (F.col("x") <= t["hi"]))
            | ((t["seg"] == 2) & (F.col("x") > t["hi"]))
        )

    near = with_key_table(src, targets, keys, few).select(
        *keys, "n", "x", F.explode(F.filter("targets", inside)).alias("t")
    ).groupBy(*keys, "n", "t", "x").agg(F.count("*").alias("ties"))
    run = W.partitionBy(*keys, "t").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    found = near.withColumn("below", F.col("t.skip") + F.coalesce(F.sum("ties").over(run), F.lit(0))).where(
        (F.col("below") <= F.col("t.r")) & (F.col("t.r") < F.col("below") + F.col("ties"))
    )
    return found.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col("t.j").alias("j"), F.col("x").alias("value"), "below", "ties"))).alias("os"),
    )


def exact_quantiles(df: DataFrame, keys: list[str], col: str, probs: list[float], names: list[str],
                    few: bool = False) -> DataFrame:
    """Linear (type 7) quantiles of unbounded groups, one column per name."""
    wanted = []
    for p in probs:
        h = (F.col("n") - 1) * F.lit(float(p))
        wanted += [(p, F.floor(h)), (p, F.ceil(h))]
    stats = order_stats(df, keys, col, wanted, few)
    cols = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col("os")[2 * i]["value"], F.col("os")[2 * i + 1]["value"]
        cols.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return stats.select(*keys, "n", *cols)


def spread_quantiles(df: DataFrame, keys: list[str], col: str, points: int, few: bool = False) -> DataFrame:
    """Evenly spaced quantiles (points of them, 0 to 1) as rows (keys, i, value)."""
    v = cumulative(df, keys, col, few)
    last = F.col("total") - 1
    step = F.lit(float(points - 1))
    # Grid points whose floor or ceiling rank falls on this value.
    lo_i = F.greatest(F.lit(0), F.ceil((F.col("below") - 1) * step / F.greatest(last, F.lit(1))))
    hi_i = F.least(step, F.floor((F.col("below") + F.col("ties")) * step / F.greatest(last, F.lit(1))))
    near = v.where(lo_i <= hi_i).select(
        *keys, F.col(col).alias("x"), "below", "ties", "total",
        F.explode(F.sequence(lo_i.cast("int"), hi_i.cast("int"))).alias("i"),
    )
    h = F.col("i") * (F.col("total") - 1) / step
    r0, r1 = F.floor(h + 1e-9), F.ceil(h - 1e-9)
    holds = lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("ties"))
    got = near.groupBy(*keys, "i", "total").agg(
        F.max(F.when(holds(r0), F.col("x"))).alias("a"), F.max(F.when(holds(r1), F.col("x"))).alias("b"),
    )
    return got.select(*keys, "i", (F.col("a") + (h - F.floor(h + 1e-9)) * (F.col("b") - F.col("a"))).alias("value"))
