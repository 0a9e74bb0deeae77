"""Finding and masking columns that hold personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A column is personal when its lower-cased name contains one of these.
PERSONAL_SIGNALS = (
    "email", "ssn", "credit", "card", "cvv", "phone", "tel", "password", "passwd", "token",
    "secret", "api_key", "apikey", "auth",
)
MASK = "<redacted>"


def is_personal(name: str) -> bool:
    low = name.lower()
    return any(signal in low for signal in PERSONAL_SIGNALS)


def is_personal_col(name: Column) -> Column:
    """The same test for column names held as data."""
    return F.lower(name).rlike("|".join(PERSONAL_SIGNALS))


def mask_personal(df: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """Replace personal columns by the mask; the flag tells whether any were found.

    Masked columns become constants, so the scan below does not even read them.
    """
    hit = [c for c in df.columns if is_personal(c) or c in extra]
    out = df.select(*[F.lit(MASK).alias(c) if c in hit else F.col(f"`{c}`") for c in df.columns])
    return out, bool(hit)
