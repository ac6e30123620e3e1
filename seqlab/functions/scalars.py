"""Column builders for cleaning, predicates, labels and scores. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The 20 standard residues and the accepted length range.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
MIN_LENGTH, MAX_LENGTH = 10, 50

# Keyword lists that mark a positive annotation.
ACTIVITY_KEYWORDS = ("GRAM+", "GRAM-", "FUNG", "VIRUS", "PARASIT", "BACTER", "BIOFILM")
CLASS_KEYWORDS = (
    "ANTIMICROBIAL", "ANTIBACTERIAL", "ANTI-GRAM", "ANTIFUNGAL",
    "ANTIVIRAL", "ANTIPARASITIC", "ANTIBIOFILM", "ANTIMYCOBACTERIAL",
)

# Unicode white space, written in the notation that both Java and RE2 accept.
WHITESPACE = (
    r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def r6(value: Column) -> Column:
    """Round to six places through an integer, so every engine agrees on ties."""
    return F.round(value * 1e6) / F.lit(1e6) + F.lit(0.0)


def r9(value: Column) -> Column:
    return F.round(value * 1e9) / F.lit(1e9) + F.lit(0.0)


def unit_hash(seed: int, stage: str, *keys: Column) -> Column:
    """Deterministic uniform in [0, 1): the first 52 bits of md5(seed|stage|keys)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stage), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def safe_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


# --- cleaning -------------------------------------------------------------------------------

def normalise(raw: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), WHITESPACE, ""))


def strict_rejection(clean: Column) -> Column:
    """Null when the normalised sequence is usable, else the reason for rejecting the whole row."""
    leftovers = F.translate(clean, RESIDUES, "")
    bad = F.array_join(F.array_sort(F.array_distinct(F.split(leftovers, ""))), "")
    return (
        F.when(clean == "", F.lit("empty_after_whitespace_cleanup"))
        .when(leftovers != "", F.concat(F.lit("contains_non_standard_residue:"), bad))
    )


def lenient_clean(raw: Column) -> Column:
    """Drop every non-residue character. Filtering comes before upper-casing on purpose."""
    keep = RESIDUES + RESIDUES.lower()
    return F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), f"[^{keep}]", ""))


def is_standard(seq: Column) -> Column:
    return (seq != "") & (F.translate(seq, RESIDUES, "") == "")


def length_ok(seq: Column, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> Column:
    return F.length(seq).between(low, high)


def strip_tokens(raw: Column) -> Column:
    """Generated-token clean-up: normalise, then drop the special tokens and gaps."""
    return F.regexp_replace(normalise(raw), "<CLS>|<EOS>|<PAD>|-", "")


def count_chars(seq: Column, chars: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, chars, ""))


def char_frequency(seq: Column, char: str) -> Column:
    return count_chars(seq, char) / F.greatest(F.length(seq), F.lit(1))


# --- predicates and labels ------------------------------------------------------------------

def has_keyword(text: Column, keywords: Sequence[str]) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(upper, F.lit(word))
    return hit


def label_id(label: Column) -> Column:
    return (
        F.when(label.isin("positive", "toxic"), F.lit(1))
        .when(label.isin("negative", "non_toxic"), F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("int"))
    )


def label_name(identifier: Column, positive: str = "positive", negative: str = "negative") -> Column:
    return (
        F.when(identifier == 1, F.lit(positive))
        .when(identifier == 0, F.lit(negative))
        .otherwise(F.raise_error(F.concat(F.lit("unknown label id: "), identifier.cast("string"))))
    )


def header_parts(header: Column, sep: str = r"\|") -> tuple[Column, Column]:
    """(accession, name) of ``db|accession|name``; the whole header twice when it has fewer parts."""
    parts = F.split(header, sep)
    full = F.size(parts) >= 3
    return (
        F.when(full, F.trim(F.get(parts, F.lit(1)))).otherwise(F.trim(header)),
        F.when(full, F.trim(F.get(parts, F.lit(2)))).otherwise(F.trim(header)),
    )


def header_class(header: Column) -> Column:
    found = F.regexp_extract(F.trim(header), r"\|([01])$", 1)
    return F.when(found != "", found)


def provided_split(file_name: Column) -> Column:
    stem = F.lower(F.regexp_replace(file_name, r"\.[^.]*$", ""))
    return (
        F.when(stem == "train_data", F.lit("provided_train"))
        .otherwise(F.concat(F.lit("provided_"), stem))
    )


def source_signature(sources: Column) -> Column:
    joined = F.array_join(F.array_sort(F.filter(sources, lambda s: s != "")), "+")
    return F.when(joined == "", F.lit("unknown")).otherwise(joined)


def source_group(sources: Column, first: str, second: str) -> Column:
    a, b = F.array_contains(sources, first), F.array_contains(sources, second)
    return (
        F.when(a & b, F.lit(f"{first}_plus_{second}"))
        .when(a, F.lit(f"{first}_only"))
        .when(b, F.lit(f"{second}_only"))
        .otherwise(F.lit("other_negative"))
    )


def source_weight(sources: Column, first: str, second: str) -> Column:
    """Sampling weight by source set. 3.0, 2.5, 1.0, 1.5."""
    a, b = F.array_contains(sources, first), F.array_contains(sources, second)
    return (
        F.when(a & ~b, F.lit(3.0))
        .when(a & b, F.lit(2.5))
        .when(b & (F.size(sources) == 1), F.lit(1.0))
        .otherwise(F.lit(1.5))
    )


# --- scores ---------------------------------------------------------------------------------

# Fixed value: slope of the logistic desirability.
DESIRABILITY_SCALE = 0.08

# The screening tiers (name, minimum of score a, maximum of score b).
TIERS = (
    ("broad_0p70_0p30", 0.70, 0.30),
    ("stringent_0p90_0p10", 0.90, 0.10),
    ("ultra_0p99_0p05", 0.99, 0.05),
)


def desirability(score: Column, threshold: float, higher_is_better: bool = True) -> Column:
    gap = (score - threshold) if higher_is_better else (F.lit(threshold) - score)
    return 1.0 / (1.0 + F.exp(-(gap / DESIRABILITY_SCALE)))


def quality_desirability(qc_pass: Column, low_complexity: Column, homopolymer: Column, gf_rich: Column) -> Column:
    flag = lambda c: c.cast("double")
    return clip01(
        flag(qc_pass)
        * (1.0 - flag(low_complexity) * 0.8)
        * (1.0 - flag(homopolymer) * 0.7)
        * (1.0 - flag(gf_rich) * 0.6)
    )


def decision_score(good: Column | None, safe: Column | None, quality: Column) -> Column:
    if good is None or safe is None:
        return quality
    eps = 1e-9
    return F.pow((good + eps) * (safe + eps) * (quality + eps), F.lit(1.0 / 3.0))


def joint_score(score_a: Column, score_b: Column) -> Column:
    return F.sqrt(clip01(score_a) * clip01(1.0 - score_b))


def priority_score(score_a: Column, score_b: Column) -> Column:
    return F.sqrt(clip01(score_a) * (1.0 - clip01(score_b)))


def tier_flag(qc_pass: Column, score_a: Column, score_b: Column, low: float, high: float) -> Column:
    return qc_pass & (score_a >= low) & (score_b <= high)


# --- display --------------------------------------------------------------------------------

def fixed4(value: Column, signed: bool = False) -> Column:
    """Four-decimal text of a number, built from an integer so that engines agree."""
    scaled = F.round(value * 1e4).cast("long")
    size = F.abs(scaled)
    digits = F.concat(
        F.floor(size / 10000).cast("long").cast("string"), F.lit("."),
        F.lpad((size % 10000).cast("string"), 4, "0"),
    )
    sign = F.when(scaled < 0, F.lit("-")).otherwise(F.lit("+" if signed else ""))
    return F.concat(sign, digits)


def mean_sd_text(mean: Column, sd: Column) -> Column:
    return F.concat(fixed4(mean), F.lit(" +/- "), fixed4(sd))


def p_value_text(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(fixed4(p))


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= (F.lit(1e-8) + F.lit(1e-5) * F.abs(b))
