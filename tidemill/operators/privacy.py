"""Finding and masking personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions import wording
from tidemill.functions.types import ref, require_operand, text_columns

# The content patterns, tried in this order.
CONTENT_PATTERNS = {
    "email": r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}

# The column-name keywords, the first contained one wins.
NAME_KEYWORDS = [
    "email", "phone", "tel", "mobile", "ssn", "social_security",
    "credit_card", "card_number", "passport", "license", "address",
    "zip", "postal", "dob", "date_of_birth", "birth",
    "first_name", "last_name", "full_name", "name", "surname",
    "ip_address", "ip", "password", "pwd", "secret",
]

CONTENT_SHARE = 0.3
REDACTED = "***REDACTED***"

# (found in the content, found in the name) -> reason
_REASONS = {
    (True, True): wording.PERSONAL_BOTH,
    (True, False): wording.PERSONAL_CONTENT,
    (False, True): wording.PERSONAL_NAME,
}

FINDING_SCHEMA = "column string, sensitivity_type string, confidence string, reason string, sample_match string"


def _name_keyword(column: str) -> str | None:
    lowered = column.lower().replace(" ", "_")
    return next((k for k in NAME_KEYWORDS if k in lowered), None)


# A cheaper test every match must pass, where there is one.
_PREFILTERS = {
    "email": lambda text: text.contains("@"),
    "phone": lambda text: text.rlike(r"\d{3}[-.\s]?\d{4}"),
}


def _matches(text, kind: str):
    full = text.rlike(CONTENT_PATTERNS[kind])
    return _PREFILTERS[kind](text) & full if kind in _PREFILTERS else full


def content_match_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column and pattern: the share of non-null values it occurs in, and one such value.

    All columns and patterns share a single scan of the whole column.
    """
    columns = text_columns(df) if columns is None else columns
    schema = "column string, kind string, match_rate double, sample_match string"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    # every pattern is matched once, here; rates and samples read the flags
    flags = df.select(
        *[ref(c).alias(f"t{i}") for i, c in enumerate(columns)],
        *[_matches(ref(c), kind).alias(f"{kind}{i}") for i, c in enumerate(columns) for kind in CONTENT_PATTERNS],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kind).alias("kind"),
            F.avg(F.col(f"{kind}{i}").cast("double")).alias("match_rate"),
            F.min(F.when(F.col(f"{kind}{i}"), F.col(f"t{i}"))).alias("sample_match"),
        )
        for i, c in enumerate(columns)
        for kind in CONTENT_PATTERNS
    ]
    return flags.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def detect_sensitive_columns(df: DataFrame) -> DataFrame:
    """Columns that look personal by content (high confidence) or by name (medium)."""
    by_column: dict[str, tuple[str, str]] = {}
    order = list(CONTENT_PATTERNS)
    rates = [r for r in content_match_rates(df).collect() if (r["match_rate"] or 0.0) > CONTENT_SHARE]
    for r in sorted(rates, key=lambda r: order.index(r["kind"])):
        by_column.setdefault(r["column"], (r["kind"], r["sample_match"]))
    rows = []
    for c in df.columns:
        keyword = _name_keyword(c)
        kind, sample = by_column.get(c, (None, None))
        if kind or keyword:
            reason = _REASONS[bool(kind), bool(keyword)].format(kind=kind, keyword=keyword)
            rows.append((c, kind or keyword, "high" if kind else "medium", reason, sample))
    return df.sparkSession.createDataFrame(rows, FINDING_SCHEMA)


def mask_column(df: DataFrame, column: str, mask_type: str = "partial") -> DataFrame:
    """full: constant; hash: 12 hex digits of SHA-256; partial: keep two characters at each end."""
    require_operand(df, column)
    text = ref(column).cast("string")
    if mask_type == "full":
        masked = F.lit(REDACTED)
    elif mask_type == "hash":
        masked = F.substring(F.sha2(text, 256), 1, 12)
    else:
        size = F.length(text)
        stars = F.repeat(F.lit("*"), size - 4)
        masked = F.when(size <= 4, "****").otherwise(
            F.concat(F.substring(text, 1, 2), stars, F.substring(text, -2, 2))
        )
    value = F.when(text.isNotNull(), masked)
    return df.select(*[value.alias(c) if c == column else ref(c) for c in df.columns])
