"""Redaction, and the scan for what redaction must have left nothing of."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import values as V
from ..functions.columns import contains_any


def redact_text(text: Column) -> Column:
    """Credential shapes replaced, in order. Compatibility characters are the caller's to fold first: see fold()."""
    for pattern, instead in V.REDACTIONS:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", instead))
    return text


@F.pandas_udf(StringType())
def fold(s):
    """NFKC: full-width digits and letters become plain ones. No built-in function does this."""
    return s.str.normalize("NFKC")


def leaks(text: Column) -> Column:
    """Names of the leak patterns that a text holds."""
    out = []
    for name, pattern, token in V.LEAKS:
        if token:
            pattern = f"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"
        out.append(F.when(F.rlike(text, F.lit(pattern)), F.lit(name)))
    return F.array_compact(F.array(*out))


def leak_scan(df: DataFrame, column: str) -> DataFrame:
    """(…, leak): a row for each leak pattern that the column's text holds; the last stage before any sink."""
    return df.withColumn("leak", F.explode(leaks(F.col(column))))


SECRET_RULES = ("B105", "B106", "B107")


def is_secret(df_type: str = "type") -> Column:
    low = F.lower(F.concat_ws(" ", "title", "pattern_type", "rule_id"))
    return (F.col(df_type) == "privacy") | F.coalesce(F.col("rule_id").isin(*SECRET_RULES), F.lit(False)) | contains_any(low, ("hardcoded password", "hardcoded_secret", "secret:", "hardcoded secret"))


def sanitize(found: DataFrame) -> DataFrame:
    """Findings as reports may show them: secrets and personal data keep no snippet and a generic description; all other text is folded and redacted."""
    secret = is_secret()
    plain = lambda name: redact_text(fold(F.col(name)))
    generic = F.when(F.col("type") == "privacy", F.lit("Personal data detected (value redacted)")).otherwise(F.lit("Credential (value redacted)"))
    return found.withColumns(
        {
            "description": F.when(secret, generic).otherwise(plain("description")),
            "code_snippet": F.when(secret, F.lit(None).cast("string")).otherwise(plain("code_snippet")),
            "title": plain("title"),
            "metadata": F.map_filter("metadata", lambda k, v: ~F.when(secret, k.isin("matched_text", "context_line", "code_snippet", "code")).otherwise(False)),
        }
    )
