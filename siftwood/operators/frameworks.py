"""Entry points and sinks by framework rules, and what they do to a finding's severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from .. import values_frameworks as R
from ..functions.columns import extension, lookup
from .filters import severity_rank

LADDER = ("info", "low", "medium", "high", "critical")


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_" else "\\" + c for c in text)


def imported(text: Column, module: str) -> Column:
    """Whether a text imports a module, in Python's or JavaScript's words; no module is always there."""
    if not module:
        return F.lit(True)
    m = _escaped(module)
    return F.rlike(text, F.lit(rf"(?m)^\s*import\s+{m}\b|(?m)^\s*from\s+{m}(?:\.|\s+import\b)|require\(['\"]{m}(?:/[^'\"]*)?['\"]\)|from\s+['\"]{m}(?:/[^'\"]*)?['\"]"))


def holds(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern[6:])) if pattern.startswith("regex:") else F.contains(text, F.lit(pattern))


def _of_language(path: Column, language: str) -> Column:
    return extension(path).isin(*(e for e, langs in R.LANGUAGES.items() if language in langs))


def _order(path: Column, rules: dict) -> list[tuple[str, tuple]]:
    """Rules in the order tried: a TypeScript file's own before JavaScript's."""
    return [(language, rule) for language in ("python", "typescript", "javascript") for rule in rules.get(language, ())]


def entry_point(path: Column, content: Column) -> Column:
    """The entry point whose multiplier is farthest from 1; escalation first, then the rules' order."""
    head = F.substring(content, 1, R.HEAD)
    found = []
    for k, (language, (kind, framework, module, pattern, mult)) in enumerate(_order(path, R.ENTRY_POINTS)):
        key = F.struct(F.lit(-round(abs(mult - 1.0), 6)).alias("s"), F.lit(0 if mult > 1 else 1).alias("e"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(framework).alias("framework"), F.lit(mult).alias("multiplier"))
        found.append(F.when(_of_language(path, language) & holds(head, pattern) & imported(head, module), key))
    return F.array_min(F.array_compact(F.array(*found)))


def sink(path: Column, content: Column, line: Column) -> Column:
    """The sink of highest bump in a line; the first rule among equals."""
    head = F.substring(content, 1, R.HEAD)
    found = []
    for k, (language, (kind, framework, module, pattern, bump, needs)) in enumerate(_order(path, R.SINKS)):
        test = _of_language(path, language) & holds(line, pattern) & F.contains(line, F.lit(needs.removeprefix("!"))) & imported(head, module)
        found.append(F.when(test, F.struct(F.lit(-bump).alias("b"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(framework).alias("framework"), F.lit(bump).alias("bump"))))
    return F.array_min(F.array_compact(F.array(*found)))


def bumped(severity: Column, bump: Column) -> Column:
    """severity moved along the ladder, and held at its ends."""
    rank = F.least(F.greatest(lookup(severity, V.SEVERITY_RANK) + bump, F.lit(0)), F.lit(4))
    return F.when(severity.isin(*LADDER), F.element_at(F.array(*map(F.lit, LADDER)), (rank + 1).cast("int"))).otherwise(severity)


def entry_points(files: DataFrame) -> DataFrame:
    found = files.select("path", entry_point(F.col("path"), F.col("content")).alias("e")).where("e is not null")
    return found.select("path", "e.kind", "e.framework", "e.multiplier")


def sinks(files: DataFrame) -> DataFrame:
    """(path, line_no, kind, framework, bump) of lines that hold a sink; only files in these languages are split."""
    path = F.col("path")
    code = files.where(extension(path).isin(*R.LANGUAGES))
    rows = code.select("path", "content", F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))
    found = rows.select("path", (F.col("at") + 1).cast("int").alias("line_no"), sink(path, F.col("content"), F.col("line")).alias("s")).where("s is not null")
    return found.select("path", "line_no", "s.kind", "s.framework", "s.bump")


def adjust(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with adjusted_severity: the sink's bump on their line, then a rung up or down by the file's entry point."""
    by_line = sinks(files).select(F.col("path").alias("file_path"), F.col("line_no").alias("line_number"), "bump")
    by_file = entry_points(files).select(F.col("path").alias("file_path"), "multiplier")
    told = found.join(by_line, ["file_path", "line_number"], "left").join(by_file, "file_path", "left")
    first = bumped(F.col("severity"), F.coalesce("bump", F.lit(0)))
    step = F.when(F.col("multiplier") >= 1.5, 1).when(F.col("multiplier") <= 0.6, -1).otherwise(0)
    return told.withColumn("adjusted_severity", bumped(first, step)).drop("bump", "multiplier")


__all__ = ["adjust", "entry_points", "severity_rank", "sinks"]
