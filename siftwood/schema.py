"""The one contract between detectors, filters, ranking and reports: the findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name and type of every column; detectors leave what they don't set null.
FINDING = (
    ("id", "string"), ("type", "string"), ("severity", "string"), ("file_path", "string"), ("line_number", "int"), ("column", "int"),
    ("title", "string"), ("description", "string"), ("code_snippet", "string"), ("confidence", "double"), ("impact_score", "double"),
    ("detected_by", "string"), ("remediation", "string"), ("references", "array<string>"), ("privacy_category", "string"),
    ("compliance_regions", "array<string>"), ("metadata", "map<string,string>"), ("detected_at", "timestamp"), ("pattern_type", "string"),
    ("rule_id", "string"), ("pii_types", "array<string>"), ("consolidated_from", "int"), ("cluster_size", "int"),
)


def as_findings(df: DataFrame) -> DataFrame:
    """df with exactly the columns of FINDING, in their order; missing ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in FINDING))


def finding_id(*parts: Column | str) -> Column:
    """The same id in every run: 12 hex digits of the parts' hash."""
    return F.substring(F.sha2(F.concat_ws("|", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts)), 256), 1, 12)


def validated(df: DataFrame) -> DataFrame:
    """df with a column ``valid``: whether id, confidence and impact keep the contract."""
    ok = (F.length("id") > 0) & F.col("confidence").between(0, 1) & F.coalesce(F.col("impact_score").between(0, 1), F.lit(True))
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def is_critical() -> Column:
    return F.col("severity").isin("critical", "high")


def is_privacy_related() -> Column:
    return (F.col("type") == "privacy") | F.col("privacy_category").isNotNull()


def location() -> Column:
    return F.concat_ws(":", "file_path", F.col("line_number").cast("string"), F.when(F.col("line_number").isNotNull(), F.col("column").cast("string")))


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text per finding."""
    return df.select(F.to_json(F.struct(*(n for n, _ in FINDING))).alias("json"))


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Findings out of to_json()'s texts."""
    ddl = ", ".join(f"`{n}` {t}" for n, t in FINDING)
    return df.select(F.from_json(column, ddl).alias("f")).select("f.*")
