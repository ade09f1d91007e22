"""Text tables: delimiter and header sniffing on the first lines, then one lazy all-text scan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = ("\t", ",", ";")

# Cells that mean "missing", and cells a spreadsheet or instrument writes instead of a number (fixed values).
MISSING_TOKENS = ("", "na", "n/a", "#n/a", "#na", "nan", "null", "none", "filtered", "n.d.", "nd", "-", "--", "?")
CELL_ERROR = (r"^(#.*|<.*|>.*|n\.?q\.?|n\.?d\.?|nan|inf|-inf|null|none|na|n/a|"
              r"below.*|above.*|lod|loq|bdl|nf|not found|error)$")
GROUPED = r"^[-+]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
GROUPED_BY_DOTS = r"^[-+]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$|^[-+]?[0-9]{1,3}(\.[0-9]{3}){2,}$"


@dataclass(frozen=True)
class TextLayout:
    delimiter: str
    header: list
    comments: list
    header_line: str
    decimal_comma: bool
    renamed: dict


def split_line(line: str, delimiter: str) -> list[str]:
    """Fields of one line; tab tables are unquoted."""
    if delimiter == "\t":
        return line.split("\t")
    return [f[1:-1].replace('""', '"') if len(f) > 1 and f[0] == f[-1] == '"' else f
            for f in re.split(delimiter + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', line)]


def unique_names(names: list[str]) -> tuple[list[str], dict]:
    """Repeated headings get _1, _2, ...; the second value maps new names to old ones."""
    seen: dict[str, int] = {}
    out, renamed = [], {}
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        new = n if k == 0 else f"{n}_{k}"
        if k:
            renamed[new] = n
        out.append(new)
    return out, renamed


def _plain(line: Column) -> Column:
    """A line without byte order mark and carriage return."""
    return F.regexp_replace(F.regexp_replace(line, "^\ufeff", ""), "\r$", "")


def sniff(spark: SparkSession, path: str) -> TextLayout:
    """The layout from the lines up to the first row: leading comments, delimiter, header.

    However many comment lines stand first, the header is found behind them.
    """
    lines, asked, comments, body = spark.read.text(path).select(_plain(F.col("value")).alias("value")), 64, [], []
    while True:
        head = [r.value for r in lines.limit(asked).collect()]
        first = next((i for i, x in enumerate(head) if not x.startswith("#")), len(head))
        comments, body = head[:first], head[first:]
        if len(body) > 1 or len(head) < asked:
            break
        asked *= 8
    if not body:
        raise ValueError(f"{path} has no header line")
    delimiter = max(DELIMITERS, key=lambda d: body[0].count(d))
    fields = split_line(body[0], delimiter)
    # A header without a heading for the row names has one field less than the rows.
    if len(body) > 1 and len(split_line(body[1], delimiter)) == len(fields) + 1:
        fields = ["id"] + fields
    header, renamed = unique_names([f.strip() or f"column_{i + 1}" for i, f in enumerate(fields)])
    return TextLayout(delimiter, header, comments, body[0], delimiter == ";", renamed)


def read_table(spark: SparkSession, path: str, layout: TextLayout | None = None) -> DataFrame:
    """Every column as text, one lazy scan.

    The leading comments and the header, which each file of a folder may repeat, are known by their
    whole text; a later row that starts with # is a row.
    """
    layout = layout or sniff(spark, path)
    names = [f"c{i}" for i in range(len(layout.header))]
    options = {"sep": layout.delimiter, "quote": "" if layout.delimiter == "\t" else '"', "escape": '"', "mode": "PERMISSIVE"}
    lines = spark.read.text(path).select(_plain(F.col("value")).alias("line"))
    rows = lines.where(~F.col("line").isin(layout.header_line, *layout.comments) & (F.trim("line") != ""))
    cells = rows.select(F.from_csv("line", ", ".join(f"{n} string" for n in names), options).alias("r"))
    return cells.select(*[F.col(f"r.{n}").alias(h) for n, h in zip(names, layout.header)])


def clean_number(c: Column, decimal_comma: bool = False) -> Column:
    """Text cell to double; missing tokens and instrument marks become NULL."""
    t = F.trim(c)
    low = F.lower(t)
    if decimal_comma:
        t = F.translate(F.when(t.rlike(GROUPED_BY_DOTS), F.translate(t, ".", "")).otherwise(t), ",", ".")
    else:
        t = F.when(t.rlike(GROUPED), F.translate(t, ",", "")).otherwise(t)
    v = F.when(low.isin(*MISSING_TOKENS) | low.rlike(CELL_ERROR), None).otherwise(t).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def cell_errors(df: DataFrame, cols: list[str]) -> DataFrame:
    """Marks counted per column: missing tokens, instrument marks and other text."""
    def count(c, cond):
        return F.sum(cond.cast("long"))

    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "cell")
    low = F.lower(F.trim("cell"))
    miss = F.col("cell").isNull() | low.isin(*MISSING_TOKENS)
    mark = ~miss & low.rlike(CELL_ERROR)
    text = ~miss & ~mark & clean_number(F.col("cell")).isNull()
    return long.groupBy("column_name").agg(
        count("c", miss).alias("n_missing"), count("c", mark).alias("n_marks"), count("c", text).alias("n_text"))


def read_feature_link(spark: SparkSession, path: str, col_a: str, col_b: str) -> DataFrame:
    """Two named columns of a text table, blanks, incomplete and repeated rows dropped."""
    from assaygrid.operators.links import clean_link

    return clean_link(read_table(spark, path), col_a, col_b)
