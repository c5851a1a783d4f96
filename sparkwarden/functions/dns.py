"""Features of domain names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and limits of the domain heuristics.
HEX_LABEL = r"^[a-f0-9]{16,}$"
BASE64_LABEL = r"^[A-Za-z0-9+/]{20,}={0,2}$"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
SUSPICIOUS_ENTROPY = 4.0
SUSPICIOUS_LENGTH = 20

# Fixed feature names, in vector order.
FEATURES = (
    "entropy",
    "subdomain_length",
    "digit_ratio",
    "consonant_ratio",
    "has_hex",
    "dot_count",
    "max_label_length",
    "total_length",
)


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for empty text.

    With f(c) occurrences of c among n characters this is
    log2(n) - sum(f log2 f) / n.
    """
    n = F.length(text)
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")

    def add(total: Column, c: Column) -> Column:
        f = (n - F.length(F.replace(text, c, F.lit("")))).cast("double")
        return total + f * F.log2(f)

    weighted = F.aggregate(letters, F.lit(0.0), add)
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.log2(n.cast("double")) - weighted / n)
    )


def first_label(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def _ratio(text: Column, pattern: str) -> Column:
    hits = F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return hits / F.greatest(F.length(text), F.lit(1)).cast("double")


def domain_features(domain: Column) -> dict[str, Column]:
    """The eight numbers of :data:`FEATURES`."""
    label = first_label(domain)
    parts = F.split(domain, r"\.")
    before_tld = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    longest = F.array_max(F.transform(before_tld, F.length))
    return {
        "entropy": shannon_entropy(label),
        "subdomain_length": F.length(label).cast("double"),
        "digit_ratio": _ratio(label, r"(?U)\d"),
        "consonant_ratio": _ratio(label, f"(?i)[{CONSONANTS}]"),
        "has_hex": label.rlike(HEX_LABEL).cast("double"),
        "dot_count": F.greatest(F.size(parts) - 2, F.lit(0)).cast("double"),
        "max_label_length": F.coalesce(longest, F.lit(0)).cast("double"),
        "total_length": F.length(domain).cast("double"),
    }
