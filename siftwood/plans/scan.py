"""The whole dataflow: detect, suppress, reduce noise, rank, report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as reduce_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators import detect, filters, frameworks, graph, pyast, rank, rollup, tools
from ..operators.classify import excluded_from_analysis
from ..schema import as_findings
from ..sources.corpus import lines

DEEP_MODES = ("full", "code")


def deep_findings(files: DataFrame) -> DataFrame:
    """What line detectors don't see: JavaScript patterns, rules of code, syntax trees, and flows through calls."""
    rows = lines(files)
    parts = (tools.js_findings(rows), tools.rule_findings(rows), pyast.syntax_findings(files), graph.taint_flows(pyast.facts(files)))
    return reduce_(DataFrame.unionByName, parts)


def scan(files: DataFrame, mode: str = "full", globs: Sequence[str] = (), types: Sequence[str] = (), reduce: bool = True, project: str = "project", cap: int = 15, extra: dict | None = None, deep: bool = True) -> DataFrame:
    """Findings of files (path, content): one narrow pass over lines, a shuffle by line for personal data, one by file for the caps.

    In the modes full and code, ``deep`` adds what deep_findings() sees, and
    moves the severity of security findings by their file's framework.
    """
    kept = files.where(~excluded_from_analysis(F.col("path")))
    found = detect.detect(kept, mode, extra)
    if deep and mode in DEEP_MODES:
        found = found.unionByName(deep_findings(kept))
        # written once: with detection and adjustment in one stage its code would be too long to compile
        told = frameworks.adjust(settled(found), kept)
        found = as_findings(told.withColumn("severity", F.when(F.col("type") == "security", F.col("adjusted_severity")).otherwise(F.col("severity"))))
    found = filters.ignore_filter(found, globs, types)
    return filters.reduce_noise(found, project, cap) if reduce else found


def ranked(files: DataFrame, as_of: str = "2024-02-01 00:00:00", **options) -> DataFrame:
    return rank.scored(scan(files, **options), as_of)


def reports(found: DataFrame) -> dict[str, DataFrame]:
    """The reports' tables by name; the privacy ones only matter if there are privacy findings. found is computed once, for all of them."""
    found = settled(found)
    return {
        "overview": rollup.overview(found), "distribution": rollup.distribution(found), "file_metrics": rollup.file_metrics(found), "file_intelligence": rollup.file_intelligence(found),
        "detail_by_type": rollup.detail_by_type(found), "security_overview": rollup.security_overview(found), "vulnerability_categories": rollup.vulnerability_categories(found),
        "privacy_overview": rollup.privacy_overview(found), "privacy_categories": rollup.privacy_categories(found), "compliance": rollup.compliance(found),
        "executive_categories": rollup.executive_categories(found), "recommendation": rollup.recommendation(found), "typed_blocks": rollup.typed_blocks(found),
        "production_focus": rollup.production_focus(found), "quick_actions": rollup.quick_actions(found), "remediation": rollup.remediation_dict(found),
    }
