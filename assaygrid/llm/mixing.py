"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.llm.common import WORD, column
from assaygrid.session import cut


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ordered(sources: DataFrame) -> DataFrame:
    """Each source with its place (from 0) by code point, null last.

    Ranges of sources are ordered inside their own tasks; only the counts of the ranges, one row per
    task, meet in a window.
    """
    order = F.col("source").asc_nulls_last()
    ranged = cut(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("place", inside).join(F.broadcast(offsets), "part").select(
        "source", "source_size", (F.col("place") + F.col("offset")).alias("place"))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    `share` of all sizes is dealt by weight; a target stops at `most` times its source's size and
    the excess is dealt again by weight among the others, until none is above. Each round is one
    aggregate over the sources; the driver sees its three totals.
    """
    placed = _ordered(sizes)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = cut(placed.select("source", "source_size", weight.cast("long").alias("weight")), "mix-weights")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.lit(full >= 0) & (F.lit(level) * F.col("weight") >= F.col("source_size") * most)
        sums = placed.agg(
            F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if sums["n"] == full or not sums["open"]:
            break
        full, level = sums["n"], (share * total - most * sums["held"]) / sums["open"]
    target = F.when(F.lit(level) * F.col("weight") >= F.col("source_size") * most, F.col("source_size") * F.lit(float(most)))
    return placed.select("source", "source_size", target.otherwise(F.lit(level) * F.col("weight")).cast("double").alias("target"))


def draw(doc_id, seed: int) -> F.Column:
    """A number in [0, 1) from a seeded hash of the id; null ids draw as the text 'null'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    A document's size is its number of words, null text 0. Its source's rate is target over size;
    it is taken floor(rate) times and once more when its seeded draw falls below the fraction, so
    reruns agree and no document is taken more than `most` times. Null is a source of its own, last
    in order. A source of size 0 has target 0 and no copies. Repeated ids draw alike. Tables may
    be empty; other columns are ignored. One text scan writes the sizes; all else reads those.
    """
    sized = cut(docs.select(
        column(docs, id_col).alias("doc_id"), column(docs, source_col).alias("source"), word_count(column(docs, text_col)).alias("size")
    ), "mix-sizes")
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    t = targets.withColumnRenamed("source", "of")
    return sized.join(t, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every document's row as often as it is taken, columns unchanged.

    The targets join by source and the number of copies follows in the same row, so no text moves
    unless there are too many sources to broadcast.
    """
    options = {"weights": (3, 1, 2), "share": 1.5, "most": 2, "seed": 17} | options
    seed = options.pop("seed")
    sizes = docs.groupBy(column(docs, source_col).alias("source")).agg(
        F.sum(word_count(column(docs, text_col))).alias("source_size"))
    targets = cut(source_targets(sizes, **options), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.select(F.col("source").alias("__of"), rate.alias("__rate"))
    joined = docs.join(t, column(docs, source_col).eqNullSafe(F.col("__of")))
    fraction = F.col("__rate") - F.floor("__rate")
    copies = F.floor("__rate") + F.when(draw(column(joined, id_col), seed) < fraction, 1).otherwise(0)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop("__of", "__rate", "__copy")
