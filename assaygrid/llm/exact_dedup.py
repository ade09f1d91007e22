"""Exact duplicates by a 128-bit content hash, with the bytes of every group compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.common import ascii_lower, column
from assaygrid.session import cut


def md5_128(text: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(text))


def _rows(docs, id_col, text_col, normalise, content_hash):
    text = normalise(column(docs, text_col))
    return docs.select(column(docs, id_col).alias("doc_id"), text.alias("norm")).withColumn("h", content_hash(F.col("norm")))


def _variants(rows: DataFrame, keep: str) -> DataFrame:
    """One row per (hash, text): the grouping compares whole texts, and partial aggregation sends
    each text of a map task once, however many copies it holds."""
    pick = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    return rows.groupBy("h", "norm").agg(pick.alias("keep_id"), F.count("*").alias("group_size"))


def _classes(rows: DataFrame, keep: str) -> DataFrame:
    """(h, keep_id, group_size, text_sha256, variants): exact wherever variants is 1."""
    return cut(_variants(rows, keep).groupBy("h").agg(
        F.count("*").alias("variants"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"),
        F.min(F.sha2("norm", 256)).alias("text_sha256"),
    ), "exact-classes")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower, content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents are equal when their normalised texts are identical. `keep` names the id that stays,
    "smallest" or "largest". Texts under one hash that differ are told apart by their bytes, so a
    collision changes nothing. Null text counts as empty. Null ids never stay in preference to an
    id; a group with null ids only has keep_id null, and its rows are kept. Rows that repeat the
    kept id are one document and all marked kept. No row, no result. Other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col, normalise, content_hash)
    classes = _classes(rows, keep)
    known = classes.where("variants = 1").drop("variants")
    out = rows.select("doc_id", "h").join(known, "h").drop("h")
    clash = classes.where("variants > 1").select("h")
    if not clash.isEmpty():
        again = rows.join(clash, "h", "left_semi")
        texts = cut(_variants(again, keep).withColumn("text_sha256", F.sha2("norm", 256)), "exact-clash")
        out = out.unionByName(again.join(texts, ["h", "norm"]).drop("h", "norm"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with all their columns. Rows that repeat the kept id all stay.

    The kept rows are found by a semi-join on (id, hash), in which no key is frequent.
    """
    classes = _classes(_rows(docs, id_col, text_col, ascii_lower, md5_128), keep)
    clash = classes.where("variants > 1").select(F.col("h").alias("__h"))
    marked = docs.withColumn("__h", md5_128(ascii_lower(column(docs, text_col))))
    stays = classes.where("variants = 1").select(F.col("keep_id").alias("__keep"), F.col("h").alias("__h2"))
    same = column(marked, id_col).eqNullSafe(F.col("__keep")) & (F.col("__h") == F.col("__h2"))
    out = marked.join(stays.hint("shuffle_hash"), same, "left_semi")
    if not clash.isEmpty():
        few = marked.join(clash, "__h", "left_semi")
        texts = cut(_variants(_rows(few, id_col, text_col, ascii_lower, md5_128), keep).select(
            F.col("keep_id").alias("__keep"), F.col("norm").alias("__norm")), "exact-clash")
        hit = column(few, id_col).eqNullSafe(F.col("__keep")) & (ascii_lower(column(few, text_col)) == F.col("__norm"))
        out = out.unionByName(few.join(texts, hit, "left_semi").select(*[f"`{c}`" for c in out.columns]))
    return out.drop("__h")
