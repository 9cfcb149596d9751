"""Sinks: report tables, review results, and the leak scan before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.redact import leaks, sanitize


class LeakError(ValueError):
    """A report still holds what it must not."""


def normalize_path(path: Column, root: str) -> Column:
    """Paths relative to the project's root; separators become slashes."""
    fixed = F.replace(path, F.lit("\\"), F.lit("/"))
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(fixed, F.lit(root)), F.substring(fixed, len(root) + 1, 1 << 30)).otherwise(F.regexp_replace(fixed, r"^\./", ""))


def write_report(df: DataFrame, path: str, fmt: str = "json", strict: bool = True) -> None:
    """Write a table if no text in it looks like a credential; the committer makes the write atomic. YAML is only another rendering: see to_yaml()."""
    texts = [n for n, t in df.dtypes if t == "string"]
    if texts:
        bad = df.select(F.size(leaks(F.concat_ws("\n", *texts))).alias("n")).where("n > 0").count()
        if bad and strict:
            raise LeakError(f"{bad} rows hold credential-shaped text")
    df.write.mode("overwrite").format(fmt).save(path)


def write_findings(found: DataFrame, path: str, fmt: str = "json", strict: bool = True) -> None:
    write_report(sanitize(found), path, fmt, strict)


def to_yaml(df: DataFrame, most: int = 1000) -> str:
    """A bounded report table as YAML (JSON scalars are YAML); for top lists and rollups, not for all findings."""
    import json

    rows = df.limit(most).toJSON().collect()
    return "\n".join("- " + "\n  ".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in json.loads(r).items()) for r in rows) + "\n"


def review_result(kept: DataFrame, original: int) -> DataFrame:
    """One JSON text with counts and the kept rows' own fields, for small reviews."""
    rows = F.collect_list(F.struct(*kept.columns))
    return kept.agg(rows.alias("findings")).select(F.to_json(F.struct(F.struct(F.lit(original).alias("original_count"), F.size("findings").alias("filtered_count")).alias("metadata"), "findings")).alias("json"))
