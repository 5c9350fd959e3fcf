"""Pure Column functions over strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import filled

#: Fixed values.
REFSEQ_PREFIXES = ("NC_", "NM_", "NR_", "NP_", "XM_", "XR_", "XP_", "NG_", "NT_", "NW_", "NZ_")
PROTEIN_AMBIGUOUS, NUCLEOTIDE_AMBIGUOUS = "XBZJ", "NRYWSKMBDHV"
KEYWORDS = ("MAG:", "metagenome-assembled", "synthetic", "artificial", "fragment", "partial", "environmental sample", "uncultured", "unclassified", "unidentified", "hypothetical")
YEAR = r"\b(19\d{2}|20\d{2})\b"
STRAIN = r"([AB])/([^/]+)/([^/]+)/([^/]+)/(\d{4})(?:\(([^)]+)\))?"
SUBTYPE = r"(?i)^H\d{1,2}(?:N\d{1,2})?$"
RANK_SUFFIXES = (("viricotina", "subphylum"), ("viricetes", "class"), ("viricota", "phylum"), ("virinae", "subfamily"), ("viridae", "family"), ("virales", "order"), ("virae", "kingdom"), ("viria", "realm"), ("vira", "subrealm"))
#: Values that stand for "no subtype".
NO_SUBTYPE = ("", "unknown", "n/a", "na", "none", "null", "not collected")


def norm_id(c: Column) -> Column:
    """Trimmed, lower-cased, white-space runs and pipes as `_`; null when nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), r"\s+", "_")
    return F.nullif(F.replace(s, F.lit("|"), F.lit("_")), F.lit(""))


def match_key(c: Column) -> Column:
    """``norm_id`` without edge underscores and accession version."""
    return F.nullif(F.regexp_replace(F.regexp_replace(norm_id(c), "^_+|_+$", ""), r"\.[0-9]+$", ""), F.lit(""))


def label_key(c: Column) -> Column:
    """A column name as a tag: other runs than letters and digits become `_`, leading digits go."""
    s = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.regexp_replace(s, "^[0-9_]+", "")


def path_safe(c: Column, fallback: str = "unnamed") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def one_line(c: Column) -> Column:
    """Tabs and line breaks as one space: safe in a TSV cell or a FASTA header."""
    return F.regexp_replace(c, r"[\t\r\n]+", " ")


def is_refseq(accession: Column) -> Column:
    return F.coalesce(accession.rlike("^(?:" + "|".join(REFSEQ_PREFIXES) + ")"), F.lit(False))


def seq_type(s: Column) -> Column:
    """Molecule from the whole body: a letter only proteins have decides; else nine in ten strict bases, N aside."""
    up = F.upper(s)
    called = F.length(F.regexp_replace(up, "N", ""))
    strict = F.length(F.regexp_replace(up, "[^ACGTU]", ""))
    return (
        F.when(s.isNull() | (s == ""), "unknown").when(up.rlike("[EFILPQZ]"), "protein")
        .when(called == 0, "nucleotide").when(strict / called >= 0.9, "nucleotide").otherwise("protein")
    )


def ambiguity(s: Column, kind: Column | str) -> Column:
    """The share of ambiguity letters of the molecule's alphabet; 0 for an empty body."""
    up = F.upper(s)
    share = lambda letters: F.length(F.regexp_replace(up, f"[^{letters}]", "")) / F.length(s)
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(F.length(s) == 0, 0.0).when(kind == "protein", share(PROTEIN_AMBIGUOUS)).otherwise(share(NUCLEOTIDE_AMBIGUOUS))


def keyword_pattern(keywords: tuple[str, ...] = KEYWORDS) -> str:
    """An alternation without case; a word boundary only where the keyword's edge is a word character."""
    one = lambda k: (r"\b" if re.match(r"\w", k) else "") + re.sub(r"([^\w\s])", r"\\\1", k) + (r"\b" if re.search(r"\w$", k) else "")
    return "(?i)(" + "|".join(map(one, keywords)) + ")"


def keyword_hit(description: Column, header: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """The first keyword found in the description, or where that is blank in the header; null if none."""
    return F.nullif(F.regexp_extract(F.coalesce(filled(description), header, F.lit("")), keyword_pattern(keywords), 1), F.lit(""))


def year(*texts: Column) -> Column:
    """The first year from 1900 to 2099 in the first text that has one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), YEAR, 1), F.lit("")).cast("int") for t in texts))


def any_year(text: Column) -> Column:
    """The first number of four digits."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(\d{4})\b", 1), F.lit("")).cast("int")


def window_label(y: Column, window: str | int) -> Column:
    """A year as a group: `year`, `decade`, or bins of so many years."""
    if window == "year":
        out = y.cast("string")
    elif window == "decade":
        out = F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s"))
    else:
        n = int(window)
        low = F.floor(y / n) * n
        out = F.concat_ws("-", low.cast("string"), (low + n - 1).cast("string"))
    return F.when(y.isNull(), "Unknown").otherwise(out)


def country(c: Column) -> Column:
    """The part before the first colon, or Unknown."""
    return F.coalesce(filled(F.trim(F.substring_index(c, ":", 1))), F.lit("Unknown"))


def strain_parts(target: Column) -> dict[str, Column]:
    """Host, country, year and strict subtype of a strain label; null where it isn't one."""
    part = lambda i: F.nullif(F.regexp_extract(target, STRAIN, i), F.lit(""))
    host = part(2)
    sub = F.trim(part(6))
    return {
        "host": F.when(F.lower(host) == "human", "Homo sapiens").otherwise(host), "country": F.replace(part(3), F.lit("_"), F.lit(" ")),
        "collection_date": F.coalesce(part(5), F.nullif(F.regexp_extract(target, YEAR, 1), F.lit(""))), "subtype": F.when(sub.rlike(SUBTYPE), F.upper(sub)),
    }


def valid_subtype(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*NO_SUBTYPE), F.trim(c))


def rank_from_name(name: Column) -> Column:
    """The rank that a name's ending tells; one word in -virus is a genus."""
    low = F.lower(name)
    out = F.when(F.coalesce(name, F.lit("")) == "", "no rank")
    for suffix, r in RANK_SUFFIXES:
        out = out.when(low.endswith(suffix), r)
    return out.when(low.endswith("virus") & ~name.contains(" "), "genus").otherwise("no rank")


def looks_like_protein_accession(c: Column) -> Column:
    """Three letters and a digit, or a RefSeq prefix with P in second place."""
    return F.coalesce(c.rlike(r"^[A-Z]P_[0-9]|^[A-Z]{3}[0-9]"), F.lit(False))


def natural_key(c: Column) -> Column:
    """Sort key with digit runs as numbers: an array of zero-padded runs."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(F.lower(x)))


def support_percent(c: Column) -> Column:
    """Branch support as an integer from 0 to 100; values up to 1 are shares."""
    return F.when(c <= 1.0, F.bround(c * 100)).otherwise(F.bround(c)).cast("int")


def hue_colour(n: Column) -> Column:
    """A colour for the n-th value: hues a golden angle apart, as #rrggbb."""
    h = F.pmod(n * F.lit(137.508), F.lit(360.0)) / 60
    s, v = 0.65, 0.85

    def channel(k: int) -> Column:
        x = F.pmod(F.lit(float(k)) + h, F.lit(6.0))
        level = v - v * s * F.greatest(F.lit(0.0), F.least(x, 4 - x, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.bround(level * 255).cast("int"))), 2, "0")

    return F.concat(F.lit("#"), channel(5), channel(3), channel(1))


def percent_cell(n: Column, total: Column) -> Column:
    """`<n> <share>%`, or dashes where there is nothing to share."""
    return F.when(total <= 0, F.concat(n.cast("string"), F.lit(" ---"))).otherwise(F.concat(n.cast("string"), F.lit(" "), F.bround(100.0 * n / total).cast("int").cast("string"), F.lit("%")))


def short_reason(c: Column) -> Column:
    """A removal reason as a category: what stands before the first colon, without its figures."""
    return F.regexp_replace(F.substring_index(c, ":", 1), r"[0-9.]+", "")
