"""Files by their paths, and frameworks by what they hold."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.columns import first_case, lookup


def normalized(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def _cases(path: Column):
    for kind, weight, patterns in V.PATH_RULES:
        yield F.rlike(path, F.lit("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")), kind, weight


def file_type(path: Column) -> Column:
    """The first type of which some rule matches the path."""
    return first_case([(t, k) for t, k, _ in _cases(normalized(path))], V.UNKNOWN_TYPE)


def file_weight(kind: Column) -> Column:
    return lookup(kind, {k: w for k, w, _ in V.PATH_RULES}, V.UNKNOWN_WEIGHT)


def excluded_from_analysis(path: Column) -> Column:
    """Whether a path is a build's output or in a folder that isn't looked at. Build output is the first type, so no other is tried; one pattern holds all parts, so that a path which is a long expression is written out twice only."""
    first, _, patterns = V.PATH_RULES[0]
    built = F.rlike(normalized(path), F.lit("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"))
    assert first == "build_output"
    return built | F.rlike(F.lower(path), F.lit("|".join(map(re.escape, V.EXCLUDED_PARTS))))


def is_production(kind: Column) -> Column:
    return kind == "source_code"


def priority(kind: Column) -> Column:
    return first_case([(kind == "source_code", "HIGH"), (kind.isin("test_file", "test_fixture", "build_output", "documentation"), "LOW")], "MEDIUM")


def classified(df: DataFrame, path: str = "file_path") -> DataFrame:
    """df with file_type, file_weight, is_production and file_priority. Each distinct path could be classified once and joined; the chain of conditions is cheaper than that shuffle."""
    kind = F.col("file_type")
    return df.withColumn("file_type", file_type(F.col(path))).withColumns({"file_weight": file_weight(kind), "is_production": is_production(kind), "file_priority": priority(kind)})
