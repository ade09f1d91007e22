"""Chat formatting over typed content parts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.llm.common import column

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,tokens:long>"
# Tokens that one attachment stands for when its part names none.
EXPANDED = {"image": 256, "audio": 128, "document": 512}


def escape(text: Column) -> Column:
    r"""`\` becomes `\\` and `<|` becomes `<\|`, so no control string is left and the text can be read back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """A role also gives up its line feeds, which end it."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def visit(parts: Column) -> Column:
    """Parts flattened in order: struct(content, attachments, tokens).

    A text part yields its escaped text; an image, audio or document part yields the placeholder
    `<|type|>` and one attachment (type, ref, expanded token count). Parts of other types, and null
    parts, yield nothing. A placeholder cannot be mistaken for text, in which `<|` is escaped.
    """
    sizes = F.create_map(*[F.lit(x) for pair in EXPANDED.items() for x in pair])
    attached = F.filter(parts, lambda p: p["type"].isin(*EXPANDED))
    rows = F.transform(attached, lambda p: F.struct(
        p["type"].alias("type"), p["ref"].alias("ref"),
        F.coalesce(p["tokens"], sizes[p["type"]].cast("long")).alias("tokens")))
    content = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit(""))))
                                       .when(p["type"].isin(*EXPANDED), F.concat(F.lit("<|"), p["type"], F.lit("|>")))
                                       .otherwise(F.lit(""))), "")
    none = F.array().cast("array<struct<type:string,ref:string,tokens:long>>")
    return F.struct(
        F.coalesce(content, F.lit("")).alias("content"), F.coalesce(rows, none).alias("attachments"),
        F.coalesce(F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r["tokens"]), F.lit(0)).alias("tokens"))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts", learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    `parts_col` is an array of (type, text, ref, tokens). Turns stand in the order of `turn_col`
    (null first), equal turns by role and content, repeated rows repeatedly. Each is written
    `<|im_start|>role\\n content <|im_end|>\\n` without the blanks. `loss_spans` holds (start, length) in
    code points of the content of every `learn_from` turn, nothing between. Null roles and texts
    count as empty; null conversation ids form one conversation. No rows, no result.
    """
    seen = messages.select(
        column(messages, conv_col).alias("conv_id"), column(messages, turn_col).alias("turn"),
        F.coalesce(column(messages, role_col), F.lit("")).alias("role"), visit(column(messages, parts_col)).alias("v"))
    flat = seen.select("conv_id", "turn", "role", F.col("v.content").alias("content"),
                       F.col("v.attachments").alias("attachments"), F.col("v.tokens").alias("tokens"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    flat = flat.withColumn("head", F.length(head)).withColumn("whole", F.concat(head, F.col("content"), F.lit(CLOSE + "\n")))
    before = W.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments").rowsBetween(W.unboundedPreceding, -1)
    placed = flat.withColumn("at", F.coalesce(F.sum(F.length("whole").cast("long")).over(before), F.lit(0)))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "at", "head", "role", "whole", F.length("content").cast("long").alias("n"), "attachments", "tokens"))).alias("turns"))
    learnt = F.filter("turns", lambda t: t["role"] == learn_from)
    return turns.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"),
        F.transform(learnt, lambda t: F.struct((t["at"] + t["head"]).alias("start"), t["n"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: parsed from the formatted text and its spans alone."""
    pieces = F.split("formatted", r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))
    role = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform(pieces, lambda p: F.struct(
        unescape_role(role(p)).alias("role"),
        unescape(p.substr(F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - len(CLOSE) - 2)).alias("text")))
    spans = F.transform("loss_spans", lambda s: unescape(
        F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(spans, "").alias("loss_text"),
                            F.length("formatted").cast("long").alias("formatted_chars"))
