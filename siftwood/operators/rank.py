"""Scores, places, and what they say about risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.columns import contains_any, first_case, lookup
from ..functions.lineage import settled
from .classify import classified
from .filters import severity_rank


def file_importance(path: Column, kind: Column, weight: Column) -> Column:
    low = F.lower(path)
    source = first_case([(contains_any(low, words), F.least(weight + boost, F.lit(1.0))) for words, boost in V.SOURCE_BOOSTS], weight)
    return first_case([(kind == "source_code", source), (kind == "configuration", F.least(weight + 0.1, F.lit(0.8)))], weight)


def legacy_importance(path: Column) -> Column:
    low = F.lower(path)
    return first_case([(contains_any(low, words), score) for words, score in V.LEGACY_IMPORTANCE], 0.5)


def temporal_score(at: Column, as_of: Column) -> Column:
    """By age at ``as_of``: under a day, a week, thirty days, older; 0.5 if unknown."""
    age = F.unix_micros(as_of) - F.unix_micros(at)
    day = 86_400_000_000
    return first_case([(at.isNull(), 0.5), (age < day, 0.9), (age < 7 * day, 0.7), (age < 30 * day, 0.5)], 0.3)


def _valid(score: Column) -> Column:
    return F.when(score.between(0, 1), score).otherwise(0.5)


def scored(found: DataFrame, as_of: str = "2024-02-01 00:00:00", weights: dict[str, float] | None = None) -> DataFrame:
    """found with its factors and ranking_score. The count per file is the one shuffle."""
    w = V.WEIGHTS | (weights or {})
    told = classified(found)
    others = F.count("*").over(Window.partitionBy("file_path")) - 1
    told = told.withColumns(
        {
            "severity_score": lookup(F.col("severity"), V.SEVERITY_SCORE, 0.5), "type_score": lookup(F.col("type"), V.TYPE_SCORE, 0.5),
            "file_score": file_importance(F.col("file_path"), F.col("file_type"), F.col("file_weight")), "temporal": temporal_score(F.col("detected_at"), F.lit(as_of).cast("timestamp")),
            "cluster_boost": first_case([(others >= 5, 0.1), (others >= 3, 0.05), (others >= 1, 0.02)], 0.0),
            "privacy_boost": F.when(F.col("type") == "privacy", first_case([(F.coalesce(F.col("privacy_category").isin(*V.CRITICAL_PRIVACY), F.lit(False)), 0.1), (F.col("privacy_category").isNotNull() & (F.size(F.coalesce("compliance_regions", F.array().cast("array<string>"))) > 1), 0.05)], 0.0)).otherwise(0.0),
        }
    )
    total = (
        F.col("severity_score") * w["severity"] + _valid(F.col("confidence")) * w["confidence"] + _valid(F.col("impact_score")) * w["impact"]
        + F.col("type_score") * w["type"] + F.col("file_score") * w["file"] + F.col("temporal") * w["temporal"] + F.col("cluster_boost") + F.col("privacy_boost")
    )
    return told.withColumn("ranking_score", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 6))


def rank_order() -> list[Column]:
    return [F.desc("ranking_score"), F.asc("file_path"), F.asc_nulls_last("line_number"), F.asc("detected_by"), F.asc("pattern_type"), F.asc("id")]


def _key() -> Column:
    """The order of ranks as one text: fixed-width numbers, and a sign below all letters between the parts."""
    score = F.lpad((F.lit(1_000_000) - F.round(F.col("ranking_score") * 1_000_000)).cast("int").cast("string"), 7, "0")
    line = F.lpad(F.coalesce("line_number", F.lit(2**31 - 1)).cast("string"), 10, "0")
    return F.concat_ws("\x01", score, *(F.coalesce(c, F.lit("")) for c in ("file_path", line, "detected_by", "pattern_type", "id")))


def positions(ranked: DataFrame, ranges: int | None = None, sample: int = 20) -> DataFrame:
    """ranked with position (from 1) and percentile over all rows, without a global window.

    Bounds between ranges of the order come from a bounded sample (the keys of
    least hash, ``sample`` a range); there are as many ranges as the session
    has shuffle partitions, and at least 64. A row's range follows from its own values,
    so any recomputation gives the same; rows are numbered inside their range,
    and a range's offset is the number of rows before it, from one row per range.
    """
    ranges = ranges or max(64, int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = settled(ranked.withColumn("_key", _key()))
    keys = sorted((r[0] for r in told.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(ranges * sample).collect()), key=str.encode)
    bounds = keys[sample::sample]
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_key"))) if bounds else F.lit(0)
    placed = told.withColumn("_range", place)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    numbered = placed.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy("_key")))
    out = numbered.join(F.broadcast(sizes), "_range")  # one row per range
    out = out.withColumn("position", F.col("_before") + F.col("_own"))
    return out.withColumn("percentile", F.round((F.col("_all") - F.col("position") + 1) / F.col("_all") * 100, 6)).drop("_key", "_range", "_own", "_before", "_all")


def top(ranked: DataFrame, n: int = 20) -> DataFrame:
    return ranked.orderBy(*rank_order()).limit(n)


def contextual_risk(found: DataFrame) -> DataFrame:
    """One row: risk of what is found in source and unknown files; tests don't count, other files neither."""
    told = classified(found)
    kind = F.col("file_type")
    risky = kind.isin("source_code", "unknown")
    n = lambda c: F.count_if(c)
    out = told.agg(
        n(kind == "source_code").alias("source_findings"), n(kind.isin("test_file", "test_fixture")).alias("test_findings"), n(kind == "unknown").alias("other_findings"),
        n(risky & F.col("severity").isin("critical", "high")).alias("critical_issues"), n(risky & (F.col("severity") == "medium")).alias("medium_issues"), F.count("*").alias("total"),
    )
    score = F.col("critical_issues") * 0.4 + F.col("medium_issues") * 0.2
    out = out.withColumn("risk_score", F.round(F.least(score, F.lit(2.0)), 6))
    out = out.withColumn("risk_level", first_case([(score >= 1.0, "HIGH"), (score >= 0.5, "MEDIUM")], "LOW"))
    rest = F.col("source_findings") + F.col("other_findings")
    return out.withColumn("assessment", first_case([(F.col("total") == 0, "clean"), (F.col("test_findings") > 5 * rest, "comprehensive_tests"), (rest == 0, "tests_only")], "attention"))


def ranking_report(ranked: DataFrame) -> DataFrame:
    """Count, mean and best score by type, by severity and overall, in one pass of grouping sets; and the mean of the ten best."""
    ranked = settled(ranked.select("type", "severity", "ranking_score", "file_path", "line_number", "detected_by", "pattern_type", "id"))
    sets = ranked.groupingSets([["type"], ["severity"], []], "type", "severity").agg(F.count("*").alias("n"), F.round(F.avg("ranking_score"), 6).alias("avg_score"), F.max("ranking_score").alias("top_score"), F.grouping_id().alias("level"))
    named = sets.select(F.when(F.col("level") == 1, "type").when(F.col("level") == 2, "severity").otherwise("all").alias("dimension"), F.coalesce("type", "severity", F.lit("all")).alias("value"), "n", "avg_score", "top_score")
    best = top(ranked, 10).agg(F.count("*").alias("n"), F.round(F.avg("ranking_score"), 6).alias("avg_score"), F.max("ranking_score").alias("top_score")).select(F.lit("top_10").alias("dimension"), F.lit("all").alias("value"), "n", "avg_score", "top_score")
    return named.unionByName(best)


__all__ = ["contextual_risk", "positions", "ranking_report", "scored", "severity_rank", "temporal_score", "top"]
