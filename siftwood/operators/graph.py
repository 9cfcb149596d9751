"""Cross-file analyses: joins and anti-joins over facts (see pyast.facts), and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import any_of, contains_any
from ..functions.lineage import settled
from ..schema import as_findings, finding_id

# fixed values: dead-symbol limits, and names that may go unused
TOLERATED, REPORTED = 15, 10
ENTRY_NAMES = ("main", "__main__", "cli", "run", "app", "config", "configure", "setup", "initialize", "init")
NAME_PREFIXES = ("test_", "fixture_", "setUp", "tearDown", "pytest_")
PATH_PARTS = ("views", "models", "admin", "urls", "settings", "__init__", "cli", "main", "setup")
EXCEPTIONS = ("Exception", "ValueError", "TypeError", "AttributeError", "KeyError", "DatabaseError", "ConnectionError", "TimeoutError", "IOError")
VIOLATIONS = 20


def is_special(name: Column, path: Column) -> Column:
    low = F.lower(name)
    return low.isin(*ENTRY_NAMES) | any_of(F.startswith(name, F.lit(p)) for p in NAME_PREFIXES) | contains_any(F.lower(path), PATH_PARTS) | F.contains(low, F.lit("command")) | F.endswith(name, F.lit("_cmd"))


def dead_symbols(defs: DataFrame, uses: DataFrame, tolerated: int = TOLERATED, reported: int = REPORTED) -> DataFrame:
    """Definitions (name, path, line) whose name nothing uses: none if there are few, else the first by path, line and name.

    Whether there are more than ``tolerated`` shows in the first rows, so the
    dead are found once and never counted; of each name, its first rows decide,
    however often it is defined.
    """
    most = max(reported, tolerated + 1)
    defs = _first_each(defs.select("path", "line", "name").where(~is_special(F.col("name"), F.col("path"))), ["path", "line"], most)
    dead = defs.join(uses.select("name").distinct(), "name", "left_anti")
    first = dead.select("path", "line", "name").orderBy("path", "line", "name").limit(most)
    # at most ``most`` rows
    return first.agg(F.sort_array(F.collect_list(F.struct("path", "line", "name"))).alias("first")).where(F.size("first") > tolerated).select(F.inline(F.slice("first", 1, reported)))


def _first_each(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows of each name; the filter becomes a group limit below the shuffle."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("_place") <= most).drop("_place")


def first_mismatches(signatures: DataFrame, most: int = VIOLATIONS) -> DataFrame:
    """(name, path_a, path_b): of each name, at least the first ``most`` pairs of different signatures by their first places.

    A pair's earlier place is its first, so those pairs lie among the name's
    first ``most`` + 1 signatures by place, however many it has.
    """
    g = signatures.groupBy("name", "detail").agg(F.min(F.struct("path", "line")).alias("at")).select("name", F.struct("at.path", "at.line", "detail").alias("at"))
    g = _first_each(g, ["at"], most + 1)
    a, b = g.select("name", F.col("at").alias("a")), g.select("name", F.col("at").alias("b"))
    return a.join(b, "name").where("a < b").select("name", F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"))


def pairwise_mismatch(signatures: DataFrame) -> DataFrame:
    """(name, first_a, detail_a, first_b, detail_b): each pair of different signatures of one name, with the first place of each.

    Rows of one signature are one group before they are paired, so a pair count
    depends on how many signatures a name has, not on how often it is defined.
    """
    g = signatures.groupBy("name", "detail").agg(F.min(F.struct("path", "line")).alias("first"))
    a, b = g.select("name", F.col("detail").alias("detail_a"), F.col("first").alias("fa")), g.select("name", F.col("detail").alias("detail_b"), F.col("first").alias("fb"))
    out = a.join(b, "name").where("detail_a < detail_b")
    return out.select("name", F.col("fa.path").alias("path_a"), F.col("fa.line").alias("line_a"), "detail_a", F.col("fb.path").alias("path_b"), F.col("fb.line").alias("line_b"), "detail_b")


def mixed_access(accesses: DataFrame, least: int = 3, most: int | None = None) -> DataFrame:
    """Pairs of files that use a variable of one name by keys only and by attributes; with ``most``, at least the first so many of each name.

    The first pairs by both paths lie among the first files of either side.
    """
    kind = F.substring("detail", 1, 4)
    g = accesses.groupBy("name", "path").agg(F.count_distinct("detail").alias("n"), F.max((kind == "dict").cast("int")).alias("d"), F.max((kind == "attr").cast("int")).alias("a")).where(F.col("n") >= least)
    left, right = g.where("d = 1 and a = 0").select("name", F.col("path").alias("dict_path")), g.where("a = 1").select("name", F.col("path").alias("attr_path"))
    if most is not None:
        left, right = _first_each(left, ["dict_path"], most), _first_each(right, ["attr_path"], most)
    return left.join(right, "name").where("dict_path <> attr_path")


def divergent_handlers(handlers: DataFrame) -> DataFrame:
    """Pairs of ways to handle one exception that don't go together: log and pass, raise again and keep silent."""
    g = handlers.where(F.col("name").isin(*EXCEPTIONS)).groupBy("name", "detail").agg(F.min(F.struct("path", "line")).alias("first"))
    has = lambda side, word: F.array_contains(F.split(f"detail_{side}", ","), word)
    a, b = g.select("name", F.col("detail").alias("detail_a"), F.col("first").alias("fa")), g.select("name", F.col("detail").alias("detail_b"), F.col("first").alias("fb"))

    def against(x: str, y: str) -> Column:
        return (has(x, "log") & ~has(y, "log") & has(y, "pass")) | (has(x, "reraise") & ~has(y, "reraise") & ~has(y, "log"))

    out = a.join(b, "name").where("detail_a < detail_b").where(against("a", "b") | against("b", "a"))
    return out.select("name", F.col("fa.path").alias("path_a"), "detail_a", F.col("fb.path").alias("path_b"), "detail_b")


def violations(signatures: DataFrame, accesses: DataFrame, handlers: DataFrame, most: int = VIOLATIONS) -> DataFrame:
    """The first ``most`` coherence violations by impact: kind, name, two paths, severity, confidence, impact."""
    kinds = (
        (first_mismatches(signatures, most), "function_signature_mismatch", "high", 0.9, 0.8),
        (mixed_access(accesses, most=most).select("name", F.col("dict_path").alias("path_a"), F.col("attr_path").alias("path_b")), "data_structure_inconsistency", "medium", 0.85, 0.7),
        (divergent_handlers(handlers).select("name", "path_a", "path_b"), "error_handling_inconsistency", "medium", 0.75, 0.6),
    )
    out = None
    for df, kind, severity, confidence, impact in kinds:
        one = df.select(F.lit(kind).alias("kind"), "name", "path_a", "path_b", F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(impact).alias("impact_score"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("impact_score"), "name", "path_a", "path_b").limit(most)


def reach(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): what the sources (node) reach over edges (src, dst), and in how few steps.

    Breadth first: a round joins the new nodes only, and anti-joins those that
    are known; the loop ends when a round finds none, or after ``most`` steps
    where that many are asked for. Each round is computed once.
    """
    known = sources.select("node").distinct().withColumn("depth", F.lit(0))
    front, depth = known.select("node"), 0
    while most is None or depth < most:
        depth += 1
        new = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
        new = settled(new)
        if new.isEmpty():
            break
        known, front = known.unionByName(new.withColumn("depth", F.lit(depth))), new
    return known


# fixed values: kinds of flows that are critical; the others are high
CRITICAL_FLOWS = ("sql_injection", "command_injection", "code_execution")


def taint_flows(facts: DataFrame) -> DataFrame:
    """Findings of flows through calls: input is handed to a function, from there on to others, and the last hands it to a dangerous call.

    Functions are known by their last names. The rows are the dangerous calls
    (see pyast.facts: taint_source, taint_edge, taint_sink), each once.
    """
    facts = settled(facts.where(F.col("kind").isin("taint_source", "taint_edge", "taint_sink")))
    of = lambda kind: facts.where(F.col("kind") == kind)
    edges = of("taint_edge").select(F.col("name").alias("src"), F.col("detail").alias("dst")).distinct()
    reached = reach(edges, of("taint_source").select(F.col("name").alias("node"))).select(F.col("node").alias("name")).distinct()
    at = of("taint_sink").join(reached, "name", "left_semi").select("path", "line", "name", F.col("detail").alias("flow")).distinct()
    rule = F.concat(F.lit("reach_"), F.col("flow"))
    return as_findings(
        at.select(
            finding_id(F.lit("taint_reach"), "flow", "path", "line", "name").alias("id"), F.lit("security").alias("type"), F.when(F.col("flow").isin(*CRITICAL_FLOWS), "critical").otherwise("high").alias("severity"),
            F.col("path").alias("file_path"), F.col("line").alias("line_number"), F.concat(F.lit("Input reaches "), F.replace("flow", F.lit("_"), F.lit(" ")), F.lit(" through calls")).alias("title"),
            F.concat(F.lit("A parameter of "), F.col("name"), F.lit(" holds input")).alias("description"), F.lit(0.9).alias("confidence"), F.lit(0.85).alias("impact_score"), F.lit("taint_reach").alias("detected_by"), rule.alias("rule_id"), rule.alias("pattern_type"),
        )
    )


def token_defs(lines_of: DataFrame) -> DataFrame:
    """Definitions in any text: words before a colon or an equals sign at a line's beginning; for corpora without syntax trees."""
    name = F.regexp_extract("line", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*[:=]", 1)
    return lines_of.select("path", F.col("line_no").alias("line"), name.alias("name")).where("name <> ''")


def largest(files: DataFrame, n: int = 100) -> DataFrame:
    """The n largest files, by size and then path."""
    return files.select("path", F.octet_length("content").cast("long").alias("size")).orderBy(F.desc("size"), "path").limit(n)


__all__ = ["dead_symbols", "divergent_handlers", "largest", "mixed_access", "pairwise_mismatch", "reach", "taint_flows", "token_defs", "violations"]
