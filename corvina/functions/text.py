"""Column functions for texts, statuses and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key patterns and the mask that hides them.
MASK = "***REDACTED***"
KEYS = ["AIza[0-9A-Za-z_\\-]{30,}", "sk-ant-[0-9A-Za-z_\\-]{20,}", "sk-[0-9A-Za-z_\\-]{20,}"]
PAIRS = "(?i)(api[_-]?key|authorization|token|secret)([\"']?\\s*[:=]\\s*[\"']?)([^\\s\"',;]{8,})"


def redact(text: Column, known: list[str] | None = None) -> Column:
    """Known values, key patterns and the values of key names replaced by a mask."""
    for value in sorted(known or [], key=len, reverse=True):
        text = F.replace(text, F.lit(value), F.lit(MASK))
    for pattern in KEYS:
        text = F.regexp_replace(text, pattern, F.lit(MASK.replace("$", "\\$")))
    return F.regexp_replace(text, PAIRS, f"$1$2{MASK}")


def first_line(text: Column) -> Column:
    """The first line of a text without white space at its ends."""
    return F.trim(F.element_at(F.split(F.trim(text), "\n", 2), 1))


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d to four places; 1.0 if d is 0."""
    return F.when(d == 0, F.lit(1.0)).otherwise(F.round(n.cast("double") / F.nullif(d, F.lit(0)), 4))
