"""Finding-set algebra: suppression, noise reduction, review filter, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.columns import any_of, contains_any, file_name, first_case, glob_regex, lookup
from ..schema import as_findings
from .classify import file_type


def severity_rank(severity: Column | str = "severity") -> Column:
    return lookup(F.col(severity) if isinstance(severity, str) else severity, V.SEVERITY_RANK, 0)


def cap_order() -> list[Column]:
    """Highest severity, type, confidence and impact first; then a total order, so that every run keeps the same rows."""
    return [F.desc(severity_rank()), F.desc(lookup(F.col("type"), V.TYPE_CAP_RANK, 0)), F.desc("confidence"), F.desc(F.coalesce("impact_score", F.lit(0.0))), F.asc_nulls_last("line_number"), F.asc("detected_by"), F.asc("pattern_type"), F.asc("id")]


def glob_test(path: Column, rule: str) -> Column:
    """Ignore globs: a leading slash anchors, a trailing one takes a directory and what is below, else the path or any component matches."""
    anchored, folder = rule.startswith("/"), rule.endswith("/")
    rule = rule.strip("/") if folder else rule.removeprefix("/")
    if folder:
        inside = (path == rule) | F.startswith(path, F.lit(rule + "/"))
        return inside if anchored else inside | F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit(f"/{rule}/"))
    whole = F.rlike(path, F.lit(glob_regex(rule)))
    return whole if anchored else whole | F.exists(F.split(path, "/"), lambda c: F.rlike(c, F.lit(glob_regex(rule))))


def ignored(found: DataFrame, globs: Sequence[str], types: Sequence[str] = ()) -> Column:
    """Whether a finding's path matches a glob, or its rule (with or without its detector's name) is listed."""
    path = F.regexp_replace("file_path", r"^\./", "")
    rule = F.coalesce("rule_id", "pattern_type")
    named = F.coalesce(rule.isin(*types) | F.concat_ws(".", "detected_by", rule).isin(*types), F.lit(False)) if types else F.lit(False)
    return any_of(glob_test(path, g) for g in globs) | named


def ignore_filter(found: DataFrame, globs: Sequence[str], types: Sequence[str] = ()) -> DataFrame:
    return found.where(~ignored(found, globs, types))


def confident() -> Column:
    """Critical findings always; others from their type's confidence on."""
    return (F.col("severity") == "critical") | (F.col("confidence") >= lookup(F.col("type"), V.TYPE_CONFIDENCE, V.OTHER_CONFIDENCE))


def package_name() -> Column:
    """The package of an unknown-import finding: from its metadata, its title, or its id."""
    by_title = F.when(F.contains("title", F.lit("Package Hallucination:")), F.trim(F.element_at(F.split("title", "Package Hallucination:"), 2)))
    parts = F.split("id", "_")
    by_id = F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), "_")).when(F.size(parts) == 3, F.element_at(parts, 3))
    return F.coalesce(F.element_at("metadata", "package_name"), by_title, F.when(F.contains("id", F.lit("package_hallucination_")), by_id))


def internal_package(project: str) -> Column:
    escaped = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in project.lower())
    named = F.rlike(package_name(), F.lit(rf"^(?:{escaped}\..*|\..*|src\..*|tests?\..*)"))
    return F.contains("id", F.lit("package_hallucination")) & F.coalesce(named, F.lit(False))


def style_only() -> Column:
    text = F.concat_ws(" ", "title", "description")
    return (F.col("detected_by") == "pylint") & contains_any(text, V.STYLE_CODES)


def is_priority() -> Column:
    return F.col("type").isin("security", "privacy", "analysis_error") | ((F.col("type") == "code_quality") & (F.col("severity") == "critical"))


def per_file_cap(found: DataFrame, cap: int = V.PER_FILE_CAP) -> DataFrame:
    """The top findings of each file: ten caps of those that matter most, one of the others; without a cap, none of the others.

    The filter on row_number() becomes a group limit below the shuffle, so a
    file with very many findings is cut before it moves.
    """
    priority = is_priority()
    if cap <= 0:
        return found.where(priority)
    ranked = found.withColumn("bucket", priority).withColumn("place", F.row_number().over(Window.partitionBy("file_path", "bucket").orderBy(*cap_order())))
    limit = F.when(F.col("bucket"), cap * V.PRIORITY_MULTIPLIER).otherwise(cap)
    return ranked.where((F.col("place") <= cap * V.PRIORITY_MULTIPLIER) & (F.col("place") <= limit)).drop("bucket", "place")


def reduce_noise(found: DataFrame, project: str = "project", cap: int = V.PER_FILE_CAP) -> DataFrame:
    """Confidence, internal packages, style codes, then the cap per file."""
    return per_file_cap(found.where(confident() & ~internal_package(project) & ~style_only()), cap)


def noise_stats(found: DataFrame, project: str = "project", cap: int = V.PER_FILE_CAP) -> DataFrame:
    """original, dropped by each filter, kept, and the reduction in per cent: one aggregate over one ranking."""
    step = first_case([(~confident(), "confidence"), (internal_package(project), "internal_package"), (style_only(), "style")], "passed")
    told = found.withColumn("step", step)
    place = F.row_number().over(Window.partitionBy("step", "file_path", is_priority()).orderBy(*cap_order()))
    limit = F.when(is_priority(), cap * V.PRIORITY_MULTIPLIER).otherwise(cap)
    told = told.withColumn("over", (F.col("step") == "passed") & (place > limit))
    n = lambda c: F.count_if(c).alias
    out = told.agg(
        F.count("*").alias("original"), n(F.col("step") == "confidence")("dropped_confidence"), n(F.col("step") == "internal_package")("dropped_internal"),
        n(F.col("step") == "style")("dropped_style"), n(F.col("over"))("dropped_cap"), n((F.col("step") == "passed") & ~F.col("over"))("kept"),
    )
    return out.withColumn("reduction", F.round(F.when(F.col("original") > 0, (F.col("original") - F.col("kept")) / F.col("original") * 100).otherwise(0.0), 2))


def tool_noise() -> Column:
    """Style titles anywhere, and what tests may do in test files."""
    low = F.lower("file_path")
    name = F.lower(file_name(F.col("file_path")))
    test = F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py")) | (name == "conftest.py") | F.contains(low, F.lit("/fixtures/")) | F.contains(low, F.lit("/__tests__/"))
    return contains_any(F.lower("title"), V.STYLE_TITLES) | (test & contains_any(F.lower(F.concat_ws("\n", "title", "description")), V.TEST_NOISE))


def tool_severity() -> Column:
    """Severity relaxed in tests, for hashes that make ids, and for style."""
    tested = file_type(F.col("file_path")).isin("test_file", "test_fixture")
    first = first_case([(tested & (F.col("severity") == "critical"), "high"), (tested & (F.col("severity") == "high"), "medium")], F.col("severity"))
    md5 = (F.col("detected_by") == "bandit") & F.contains(F.lower("description"), F.lit("md5")) & F.contains(F.lower("file_path"), F.lit("id"))
    second = F.when(md5, "low").otherwise(first)
    return F.when((F.col("type") == "code_quality") & contains_any(F.lower("title"), V.STYLE_WORDS) & (second == "medium"), "low").otherwise(second)


def review_findings(rows: DataFrame) -> DataFrame:
    """Findings out of review rows (see sources.readers): aliases resolved, confidence clamped; rows without file or title are left out."""
    path, title = F.coalesce("file", "file_path"), F.coalesce("title", "summary", "message")
    severity = lookup(F.lower(F.trim(F.coalesce("severity", F.lit("medium")))), V.SEVERITY_ALIASES, "medium")
    kind = lookup(F.lower(F.trim(F.coalesce("category", "type", F.lit("code_quality")))), V.CATEGORY_ALIASES, "code_quality")
    line = F.coalesce("line", "line_number").try_cast("int")
    text = F.coalesce("description", F.lit(""))
    mark = F.substring(F.sha1(F.concat_ws("|", path, F.coalesce(line.cast("string"), F.lit("None")), title, text)), 1, 12)
    out = rows.where(path.isNotNull() & title.isNotNull()).select(
        F.concat(F.lit("ai_review_"), mark).alias("id"), kind.alias("type"), severity.alias("severity"), path.alias("file_path"), line.alias("line_number"), title.alias("title"), text.alias("description"),
        F.least(F.greatest(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.7)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), lookup(severity, V.REVIEW_IMPACT, 0.5).alias("impact_score"),
        F.coalesce("detected_by", F.lit("ai-reviewer")).alias("detected_by"), F.lit(None).cast("string").alias("pattern_type"),
    )
    return as_findings(out)


def overlap_peers(found: DataFrame) -> DataFrame:
    """For findings whose line other detectors flag as well: id, and the others' names in order. A null line overlaps with nothing."""
    at = found.where("line_number is not null").select("id", "file_path", "line_number", "detected_by")
    # a window, not a join back: the findings are computed once, and a line has few of them
    told = at.withColumn("all", F.array_sort(F.collect_set("detected_by").over(Window.partitionBy("file_path", "line_number")))).where(F.size("all") > 1)
    return told.select("id", "file_path", "line_number", "detected_by", F.array_remove("all", F.col("detected_by")).alias("peers"))


def cluster_sizes(found: DataFrame) -> DataFrame:
    """One finding per wire text and type (the smallest id), with how many share it: a local stand-in for remote deduplication."""
    return found.withColumn("wire", wire_text()).groupBy("type", "wire").agg(F.min_by(F.struct("id", "file_path", "line_number", "severity"), "id").alias("f"), F.count("*").alias("cluster_size")).select("f.*", "type", "cluster_size")


def clamp_utf16(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-16 units that ends with a whole character."""
    raw = F.encode(text, "UTF-16BE")
    # a first half of a pair at the end is left out
    split = F.hex(F.substring(raw, 2 * most - 1, 1)).between("D8", "DB")
    return F.when(F.length(raw) <= 2 * most, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.when(split, 2 * most - 2).otherwise(2 * most)), "UTF-16BE"))


def wire_text() -> Column:
    """What may leave the machine: the title up to its colon; for other types than security and privacy, the description too; 4000 units at most."""
    title = F.trim(F.element_at(F.split("title", ":"), 1))
    private = F.col("type").isin("security", "privacy")
    text = F.concat_ws(" | ", F.col("type"), F.col("severity"), title, F.when(~private, F.col("description")))
    return clamp_utf16(text, 4000)


def developer_only(found: DataFrame) -> DataFrame:
    return found.where(file_type(F.col("file_path")) == "source_code")
