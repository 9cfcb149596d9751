"""The six reports' tables. Each is an aggregate or a bounded top list over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.columns import any_of, contains_any, first_case, lookup
from ..functions.lineage import settled
from ..schema import is_critical
from .classify import classified
from .filters import severity_rank


def _max_severity() -> Column:
    return F.coalesce(F.max_by("severity", severity_rank()), F.lit("info"))


def overview(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total_findings"), F.count_distinct("file_path").alias("files_analyzed"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("average_confidence"), F.round(F.coalesce(F.avg("impact_score"), F.lit(0.0)), 3).alias("average_impact"))


def distribution(found: DataFrame) -> DataFrame:
    """Counts by type, by severity and by detector, in one pass."""
    told = found.withColumn("detector", F.coalesce("detected_by", F.lit("unknown")))
    sets = told.groupingSets([["type"], ["severity"], ["detector"]], "type", "severity", "detector").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return sets.select(F.when(F.col("level") == 3, "by_type").when(F.col("level") == 5, "by_severity").otherwise("by_detector").alias("dimension"), F.coalesce("type", "severity", "detector").alias("value"), "n")


def file_scores(found: DataFrame) -> DataFrame:
    """Three points for a critical or high finding, one for each."""
    return found.groupBy("file_path").agg(F.count("*").alias("issues"), F.count_if(is_critical()).alias("critical_issues")).withColumn("score", F.col("critical_issues") * 3 + F.col("issues"))


def file_metrics(found: DataFrame, n: int = 5) -> DataFrame:
    """The n files of highest score, and the n of lowest score among those with one issue at most."""
    scores = settled(file_scores(found))
    worst = scores.orderBy(F.desc("score"), "file_path").limit(n).select(F.lit("most_problematic").alias("kind"), "file_path", "issues", "score")
    best = scores.where("issues <= 1").orderBy("score", F.desc("file_path")).limit(n).select(F.lit("cleanest").alias("kind"), "file_path", "issues", "score")
    return worst.unionByName(best)


def file_priorities(found: DataFrame, n: int = 10) -> DataFrame:
    return file_scores(found).orderBy(F.desc("score"), "file_path").limit(n).select("file_path", F.col("issues").alias("total_issues"), "critical_issues", F.col("score").alias("priority_score"))


def file_intelligence(found: DataFrame, n: int = 20) -> DataFrame:
    """The n files of highest score with their type and their issues by line, as ``line:count`` in order."""
    by_line = found.groupBy("file_path", F.coalesce("line_number", F.lit(0)).alias("line")).agg(F.count("*").alias("c"), F.count_if(is_critical()).alias("k"))
    files = by_line.groupBy("file_path").agg(F.sum("c").alias("total_issues"), F.sum("k").alias("critical_high_issues"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "c"))), lambda x: F.concat_ws(":", x["line"].cast("string"), x["c"].cast("string"))), ",").alias("issues_by_line"))
    files = files.withColumn("priority_score", F.col("critical_high_issues") * 3 + F.col("total_issues"))
    return classified(files.orderBy(F.desc("priority_score"), "file_path").limit(n)).select("file_path", "total_issues", "critical_high_issues", "priority_score", "issues_by_line", "file_type")


def confidence_bands(found: DataFrame) -> DataFrame:
    """Complexity findings by severity, security findings by confidence."""
    complex_ = F.contains(F.lower("title"), F.lit("complexity"))
    secure = F.col("type") == "security"
    band = first_case([(F.col("severity") == "high", "high"), (F.col("severity") == "medium", "medium")], "low")
    sure = first_case([(F.col("confidence") >= 0.8, "high_confidence"), (F.col("confidence") >= 0.5, "medium_confidence")], "low_confidence")
    told = found.where(complex_ | secure).select(F.explode(F.array_compact(F.array(F.when(complex_, F.struct(F.lit("complexity").alias("kind"), band.alias("band"))), F.when(secure, F.struct(F.lit("security").alias("kind"), sure.alias("band")))))).alias("x"))
    return told.groupBy("x.kind", "x.band").agg(F.count("*").alias("n"))


def detector_health(status: DataFrame) -> DataFrame:
    """Detectors with how they ended, failed ones first. status: (name, status, reason, findings)."""
    place = lookup(F.col("status"), {"errored": 0, "skipped": 1, "ok": 2}, 9)
    return status.select("name", "status", F.coalesce("reason", F.lit("")).alias("reason"), "findings", F.row_number().over(Window.orderBy(place, "name")).alias("place"))


def detail_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITY_RANK))


def security_overview(found: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    out = found.where("type = 'security'").agg(F.count("*").alias("total"), n("critical"), n("high"), n("medium"), n("low"))
    return out.withColumn("risk", first_case([(F.col("total") == 0, "NONE"), (F.col("critical") > 0, "CRITICAL"), (F.col("high") >= 3, "HIGH"), (F.col("high") > 0, "MEDIUM")], "LOW"))


def vulnerability_category() -> Column:
    text = F.lower(F.concat_ws("\n", "title", "description"))
    return first_case([(contains_any(text, words), name) for name, words in V.VULNERABILITY_WORDS], V.OTHER_VULNERABILITY)


def vulnerability_categories(found: DataFrame) -> DataFrame:
    return found.where("type = 'security'").groupBy(vulnerability_category().alias("category")).agg(F.count("*").alias("n"), _max_severity().alias("severity"))


def privacy_category() -> Column:
    low = F.lower("title")
    words = [(any_of(F.lit(True) & _all(low, alternative) for alternative in alternatives), name) for name, alternatives in V.PRIVACY_WORDS]
    return F.coalesce("privacy_category", lookup(F.col("title"), V.PRIVACY_TITLES), first_case(words, "unknown"))


def _all(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(text, F.lit(w))
    return out


def privacy_categories(found: DataFrame) -> DataFrame:
    return found.where("type = 'privacy'").groupBy(privacy_category().alias("category")).agg(F.count("*").alias("n"), _max_severity().alias("severity"))


def privacy_overview(found: DataFrame) -> DataFrame:
    out = found.where("type = 'privacy'").agg(F.count("*").alias("total"), F.count_distinct("privacy_category").alias("categories"), F.count_if(F.col("impact_score") > 0.7).alias("high_impact"))
    return out.withColumn("compliance_risk", first_case([(F.col("high_impact") >= 3, "HIGH"), (F.col("high_impact") > 0, "MEDIUM")], "LOW"))


def compliance(found: DataFrame) -> DataFrame:
    """Violations and risk by law, for laws with any."""
    out = None
    for law, most in (("GDPR", 5), ("CCPA", 3)):
        one = found.where((F.col("type") == "privacy") & F.array_contains("compliance_regions", law)).agg(F.count("*").alias("violations")).where("violations > 0")
        one = one.select(F.lit(law).alias("regulation"), "violations", F.when(F.col("violations") >= most, "HIGH").otherwise("MEDIUM").alias("risk_level"))
        out = one if out is None else out.unionByName(one)
    return out


def category() -> Column:
    """The first group of words that title, description or detector holds; else the type."""
    text = F.lower(F.concat_ws(" ", *(F.when(F.length(c) > 0, F.col(c)) for c in ("title", "description", "detected_by"))))
    return first_case([(contains_any(text, words), name) for name, words in V.CATEGORY_WORDS], F.col("type"))


def executive_categories(found: DataFrame) -> DataFrame:
    counted = found.groupBy(category().alias("category")).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "category")))


def fallback_risk(found: DataFrame) -> DataFrame:
    out = found.agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return out.withColumn("risk", first_case([((F.col("critical") > 0) | (F.col("high") >= 5), "HIGH"), ((F.col("high") > 0) | (F.col("total") >= 10), "MEDIUM")], "LOW"))


def recommendation(found: DataFrame, n: int = 3) -> DataFrame:
    """The n findings to act on: critical and high ones in production code; other files and titles come before repeats."""
    picked = classified(found).where(is_critical() & F.col("is_production"))
    order = [F.when(F.col("severity") == "critical", 0).otherwise(1), F.desc(F.coalesce("impact_score", F.lit(0.0))), F.asc("file_path"), F.asc_nulls_last("line_number"), F.asc("detected_by"), F.asc("pattern_type"), F.asc("id")]
    first = F.row_number().over(Window.partitionBy("file_path", F.trim("title")).orderBy(*order)) > 1
    again = picked.withColumn("repeat", first)
    return again.orderBy("repeat", *order).limit(n).select("id", "severity", "file_path", "line_number", "title", F.col("repeat").cast("int").alias("repeated"))


def block() -> Column:
    return lookup(F.col("type"), V.TYPE_BLOCK, "other")


def _block_order() -> list[Column]:
    """Critical first, syntax errors first among equals; then a total order."""
    return [F.when(F.col("severity") == "critical", 0).otherwise(1), F.when(F.startswith("title", F.lit("Syntax Error")), 0).otherwise(1), F.asc("file_path"), F.asc_nulls_last("line_number"), F.asc("detected_by"), F.asc("pattern_type"), F.asc("id")]


def typed_blocks(found: DataFrame, cap: int = V.BLOCK_CAP) -> DataFrame:
    """Critical and high findings by block, up to the cap, in order, and how many the cap drops."""
    placed = settled(found.where(is_critical()).withColumn("block", block()))
    sizes = placed.groupBy("block").agg(F.count("*").alias("all"))  # a row per block
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(*_block_order()))).where(F.col("place") <= cap)
    return placed.join(F.broadcast(sizes), "block").select("block", "place", "id", "file_path", "line_number", "severity", "title", F.greatest(F.col("all") - cap, F.lit(0)).alias("dropped"))


def production_focus(found: DataFrame, cap: int = V.BLOCK_CAP, most: int = V.FOCUS_CAP) -> DataFrame:
    """The first production findings of the typed blocks, in the blocks' order."""
    placed = classified(typed_blocks(found, cap)).where("is_production and block <> 'other'")
    order = lookup(F.col("block"), {b: k for k, b in enumerate(V.BLOCKS)})
    return placed.orderBy(order, "place").limit(most).select("block", "place", "id", "file_path", "line_number")


def remediation_dict(found: DataFrame) -> DataFrame:
    """Distinct remediation texts in order as rem_001 and so on."""
    text = F.trim("remediation")
    return found.where(F.length(text) > 0).select(text.alias("text")).distinct().select(F.concat(F.lit("rem_"), F.lpad(F.row_number().over(Window.orderBy(F.encode("text", "UTF-8"))).cast("string"), 3, "0")).alias("ref"), "text")


def false_positive_likelihood(found: DataFrame) -> DataFrame:
    who = F.lower(F.coalesce("detected_by", F.lit("")))
    sure = F.coalesce("confidence", F.lit(0.0))
    told = classified(found)
    likely = first_case([(F.col("is_production") & (sure >= 0.85) & who.isin(*V.PRECISE_DETECTORS), "LOW"), (~F.col("is_production") & (sure <= 0.75) & who.isin(*V.KEYWORD_DETECTORS), "HIGH")], "MEDIUM")
    return told.select("id", "file_path", "line_number", "detected_by", likely.alias("likelihood"))


def first_seen(found: DataFrame, history: DataFrame, now: str) -> DataFrame:
    """When each finding was first seen: by the history (id, first_seen), or now."""
    return found.select("id").distinct().join(history, "id", "left").select("id", F.coalesce("first_seen", F.lit(now).cast("timestamp")).alias("first_seen"))


def update_history(history: DataFrame, seen: DataFrame) -> DataFrame:
    return history.unionByName(seen).groupBy("id").agg(F.min("first_seen").alias("first_seen"))


def display_cluster(size: Column) -> Column:
    return F.least(size, F.lit(V.CLUSTER_CAP))


def quick_actions(found: DataFrame) -> DataFrame:
    """Three critical findings, five work markers, and how many markers are left out."""
    found = settled(found.where("severity = 'critical' or type = 'todo'"))
    now = found.where("severity = 'critical'").orderBy(*_block_order()).limit(3).select(F.lit("immediate").alias("kind"), "id", "file_path", "line_number")
    todo = found.where("type = 'todo'")
    some = todo.orderBy(F.asc("file_path"), F.asc_nulls_last("line_number"), F.asc("pattern_type"), F.asc("id")).limit(5).select(F.lit("todo").alias("kind"), "id", "file_path", "line_number")
    left = todo.agg(F.greatest(F.count("*") - 5, F.lit(0)).cast("int").alias("n")).select(F.lit("todo_left_out").alias("kind"), F.lit("").alias("id"), F.lit("").alias("file_path"), F.col("n").alias("line_number"))
    return now.unionByName(some).unionByName(left)


def snippet_context(lines_of: DataFrame, found: DataFrame) -> DataFrame:
    """Each finding's line and its neighbours, joined by newlines; personal data and secrets get none.

    Only the flagged lines and those next to them are shuffled: lines are joined
    with the wanted numbers, not windowed over whole files.
    """
    shown = found.where("type not in ('privacy', 'security') and line_number is not null").select("id", F.col("file_path").alias("path"), "line_number")
    want = shown.withColumn("line_no", F.explode(F.array(F.col("line_number") - 1, F.col("line_number"), F.col("line_number") + 1)))
    got = want.join(lines_of, ["path", "line_no"])
    return got.groupBy("id", "path", "line_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("context"))


def performance_metrics(found: DataFrame, seconds: float | None = None, peak_mb: float | None = None) -> DataFrame:
    """Findings per file; files per second and memory only if they were measured."""
    out = found.agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))
    per_second = F.round(F.col("files") / F.lit(seconds), 2) if seconds else F.lit(None).cast("double")
    return out.select(F.lit(seconds).cast("double").alias("seconds"), per_second.alias("files_per_second"), F.round(F.col("n") / F.greatest("files", F.lit(1)), 2).alias("findings_per_file"), F.lit(peak_mb).cast("double").alias("peak_memory_mb"))
