"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest normal double; p-values are clamped here before taking logs.
SMALLEST_DOUBLE = 2.2250738585072014e-308

# Prefixes removed from gene-set names for display (fixed values).
GENE_SET_PREFIXES = (
    "HALLMARK_", "GOBP_", "GOMF_", "GOCC_", "KEGG_MEDICUS_", "KEGG_LEGACY_",
    "KEGG_", "REACTOME_", "WP_", "BIOCARTA_", "PID_",
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def join_key(c: Column) -> Column:
    """upper-cased trimmed key, blank is NULL."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def strip_version(c: Column) -> Column:
    """a versioned gene id without its version; a PAR_Y suffix is kept."""
    return F.regexp_replace(c, r"\.[0-9]+(_PAR_Y)?$", "$1")


def ensembl_base(c: Column) -> Column:
    """the id without version and PAR_Y suffix."""
    return F.regexp_replace(strip_version(c), "_PAR_Y$", "")


# Accession pattern with an isoform suffix (published UniProt accession rule plus "-n").
ISOFORM = (
    r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})-[0-9]+$"
)


def canonical_accession(c: Column) -> Column:
    """the canonical accession of an isoform accession, else NULL."""
    up = F.upper(F.trim(c))
    return F.when(up.rlike(ISOFORM), F.regexp_replace(up, "-[0-9]+$", ""))


def first_symbol(c: Column) -> Column:
    """first symbol of a packed cell."""
    return blank_to_null(F.regexp_replace(F.trim(c), "[;,].*$", ""))


# Last underscore-delimited word of a column name -> measurement unit (fixed values).
MEASURE_UNITS = {
    "count": "count", "counts": "count", "readcount": "count",
    "fpkm": "fpkm", "tpm": "tpm", "cpm": "cpm", "rpkm": "rpkm",
}


def measure_suffix(c: Column) -> Column:
    """measurement unit named by the last underscore-delimited word, else NULL."""
    word = F.lower(F.regexp_extract(c, r"_([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for unit in sorted(set(MEASURE_UNITS.values())):
        out = F.when(word.isin(*[w for w, u in MEASURE_UNITS.items() if u == unit]), unit).otherwise(out)
    return out


def numeric_text(c: Column) -> Column:
    """F8: text to double, accepting grouped thousands."""
    t = F.trim(c)
    grouped = t.rlike(r"^[-+]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")
    return F.when(grouped, F.regexp_replace(t, ",", "")).otherwise(t).try_cast("double")


def id_text(c: Column) -> Column:
    """a numeric id written in full, never in exponent form."""
    return F.when(c == F.floor(c), F.floor(c).cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def direction_sign(direction: Column, effect: Column) -> Column:
    """the stated direction word, else the sign of the effect unless it says 'ns'."""
    word = F.lower(direction)
    return (
        F.when(word.isin("up", "positive"), "up")
        .when(word.isin("down", "negative"), "down")
        .when(F.coalesce(word, F.lit("")) == "ns", None)
        .when(effect > 0, "up")
        .when(effect < 0, "down")
    )


def quadrant(a: Column, b: Column) -> Column:
    """'up_up', 'up_down', ...; NULL when either side is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("_", a, b))


def neg_log10(p: Column) -> Column:
    """F13."""
    return F.when(p.isNotNull(), -F.log10(F.greatest(p, F.lit(SMALLEST_DOUBLE))))


def pretty_set_name(c: Column) -> Column:
    """known prefix off, underscores to blanks."""
    return F.trim(F.translate(F.regexp_replace(c, "^(" + "|".join(GENE_SET_PREFIXES) + ")", ""), "_", " "))


def hashed_uniform(seed: int, stream: str, *ids: Column) -> Column:
    """A uniform number in (0, 1) fixed by the seed and the ids, whatever the partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}:{stream}"), *ids))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def hashed_normal(seed: int, *ids: Column) -> Column:
    """A standard normal number fixed by the seed and the ids."""
    import math

    u, v = hashed_uniform(seed, "u", *ids), hashed_uniform(seed, "v", *ids)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def overlap_count(c: Column) -> Column:
    """k out of 'k/n'."""
    return F.split(c, "/")[0].try_cast("double")


def direction_label(effect: Column, kind: str) -> Column:
    """kind is 'group', 'continuous' or 'none'."""
    words = {"group": ("up", "down"), "continuous": ("positive", "negative")}
    if kind == "none":
        return F.lit("ns")
    hi, lo = words[kind]
    return F.when(effect > 0, hi).when(effect < 0, lo).otherwise("ns")


def contrast_label(case: str, control: str) -> str:
    """F19."""
    return f"{case}_vs_{control}"


def expression_label(text: str) -> str:
    """a contrast expression without backticks and with single blanks."""
    return " ".join(text.replace("`", "").split())


def file_safe(c: Column) -> Column:
    """F21."""
    return F.regexp_replace(c, "[^A-Za-z0-9._]", "_")


def kegg_symbol(c: Column) -> Column:
    """first symbol of 'SYM1, SYM2; text'; NULL without a ';'."""
    return F.when(c.contains(";"), blank_to_null(F.regexp_extract(c, r"^([^,;]*)", 1)))


def finite_or_null(c: Column) -> Column:
    """P10: NaN and infinities become NULL."""
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
