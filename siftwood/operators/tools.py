"""Adapters: rows of external tools, JavaScript by patterns, tokens of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.columns import any_of, extension, file_name, in_dirs, lookup
from ..schema import as_findings, finding_id

BANDIT = "struct<results:array<struct<test_id:string,filename:string,line_number:int,col_offset:int,issue_severity:string,issue_confidence:string,issue_text:string>>>"
PYLINT = "array<struct<type:string,`message-id`:string,symbol:string,path:string,line:int,column:int,message:string>>"


def _mark(tool: str, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(tool), *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), 1, 12)


def bandit_rows(json: DataFrame, column: str = "value") -> DataFrame:
    """Findings of a tool's report with results; equal rule, file, line and column come once."""
    r = json.select(F.explode(F.from_json(column, BANDIT)["results"]).alias("r")).select("r.*")
    rule, path = F.coalesce("test_id", F.lit("unknown")), F.coalesce("filename", F.lit("<unknown>"))
    out = r.select(
        F.concat(F.lit("bandit-"), rule, F.lit("-"), _mark("bandit", rule, path, F.col("line_number"), F.col("col_offset"))).alias("id"), F.lit("security").alias("type"),
        lookup(F.upper("issue_severity"), V.BANDIT_SEVERITY, "medium").alias("severity"), path.alias("file_path"), F.col("line_number"), F.col("col_offset").alias("column"),
        F.coalesce("issue_text", F.lit("Security Issue")).alias("title"), F.coalesce("issue_text", F.lit("Security vulnerability detected")).alias("description"),
        lookup(F.upper("issue_confidence"), V.BANDIT_CONFIDENCE, 0.7).alias("confidence"), F.lit(0.0).alias("impact_score"), F.lit("bandit").alias("detected_by"), rule.alias("rule_id"), rule.alias("pattern_type"),
    )
    return as_findings(out.dropDuplicates(["id"]))


def pylint_rows(json: DataFrame, column: str = "value") -> DataFrame:
    """Findings of a linter's list; information is left out."""
    r = json.select(F.explode(F.from_json(column, PYLINT)).alias("r")).select("r.*").where(F.col("type").isin(*V.PYLINT_LEVELS))
    rule, path = F.coalesce("message-id", F.lit("unknown")), F.coalesce("path", F.lit("<unknown>"))
    out = r.select(
        F.concat(F.lit("pylint-"), rule, F.lit("-"), _mark("pylint", rule, path, F.col("line"), F.col("column"))).alias("id"), F.lit("code_quality").alias("type"),
        lookup(F.col("type"), {k: s for k, (s, _) in V.PYLINT_LEVELS.items()}).alias("severity"), path.alias("file_path"), F.col("line").alias("line_number"), F.col("column"),
        F.coalesce("symbol", rule).alias("title"), F.coalesce("message", F.lit("")).alias("description"), lookup(F.col("type"), {k: c for k, (_, c) in V.PYLINT_LEVELS.items()}).alias("confidence"),
        F.lit(0.0).alias("impact_score"), F.lit("pylint").alias("detected_by"), rule.alias("rule_id"), rule.alias("pattern_type"),
    )
    return as_findings(out.dropDuplicates(["id"]))


# fixed values: JavaScript patterns: name, severity, pattern
JS_PATTERNS = (
    ("eval_usage", "high", r"\beval\s*\("), ("inner_html", "medium", r"\.innerHTML\s*\("), ("document_write", "high", r"\bdocument\.write\s*\("), ("aws_key", "high", r"AKIA[0-9A-Z]{16}"),
    ("hardcoded_credential", "high", r"""(?i)(?:^|[^A-Za-z0-9])(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|priv(?:ate)?[_-]?key|auth[_-]?token|access[_-]?token|bearer[_-]?token|client[_-]?secret|jwt[_-]?secret|session[_-]?secret)["']?\s*[:=]\s*["'][^"'\s]{8,}["']"""),
    ("work_marker", "low", r"(?i)(?://|/\*)\s*(?:todo|fixme|hack)\b"),
)
# fixed values: a key's name before a string of 32 to 64 plain characters; parameters that are too many; kinds and impact of JavaScript findings
GENERIC_KEY = ("generic_key", "medium", r"""(?i)["']?[A-Za-z0-9_]*(?:api|key|token|secret)[A-Za-z0-9_]*["']?\s*:\s*["'][A-Za-z0-9_-]{32,64}["']""")
MANY_PARAMETERS = ("many_parameters", "medium", r"\bfunction\b[^(]*\((?:[^(),]*,){7}[^(),]*[^(),\s][^()]*\)")
JS_TYPES = {"many_parameters": "code_quality", "work_marker": "todo"}
JS_IMPACT = {"critical": 0.95, "high": 0.8, "medium": 0.6, "low": 0.4}
JS_CONFIDENCE = 0.95
JS_SECRETS = ("aws_key", "hardcoded_credential", "generic_key")
ONE_LOWER = {"critical": "high", "high": "medium", "medium": "low", "low": "info"}
JS_ENDINGS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")


def js_patterns(lines_of: DataFrame) -> DataFrame:
    """(path, line_no, name, severity): JavaScript patterns by regular expressions, since Spark has no parser for it; one per line and pattern."""
    hits = [F.when(F.rlike("line", F.lit(p)), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for n, s, p in JS_PATTERNS]
    rows = lines_of.where(extension(F.col("path")).isin(*JS_ENDINGS))
    return rows.select("path", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "line_no", "h.*")


def js_findings(lines_of: DataFrame) -> DataFrame:
    """Findings of the JavaScript patterns, of keys by name and of long parameter lists; security in tests is one severity lower.

    Statements can't be counted by line patterns, so functions of many statements give none.
    """
    told = (*JS_PATTERNS, GENERIC_KEY, MANY_PARAMETERS)
    hits = [F.when(F.rlike("line", F.lit(p)), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for n, s, p in told]
    rows = lines_of.where(extension(F.col("path")).isin(*JS_ENDINGS)).select("path", "line_no", "line", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("path", "line_no", "line", "h.*")
    name, kind = F.lower(file_name(F.col("path"))), lookup(F.col("name"), JS_TYPES, "security")
    tested = in_dirs(F.col("path"), V.TEST_DIRS) | F.startswith(name, F.lit("test_")) | any_of(F.endswith(name, F.lit(x)) for x in V.TEST_NAME_SUFFIXES)
    severity = F.when(tested & (kind == "security"), lookup(F.col("severity"), ONE_LOWER)).otherwise(F.col("severity"))
    line = F.trim("line")
    snippet = F.when(F.col("name").isin(*JS_SECRETS), F.regexp_replace(line, r"""(["'])([^"']+)(["'])""", "$1<REDACTED>$3")).otherwise(line)
    out = rows.select(
        finding_id(F.lit("javascript"), F.col("name"), F.col("path"), F.col("line_no"), F.lit(1)).alias("id"), kind.alias("type"), severity.alias("severity"), F.col("path").alias("file_path"), F.col("line_no").alias("line_number"),
        F.concat(F.lit("JavaScript: "), F.col("name")).alias("title"), F.concat(F.lit("Matched "), F.col("name")).alias("description"), F.when(F.length(snippet) <= V.SNIPPET, snippet).otherwise(F.concat(F.substring(snippet, 1, V.SNIPPET), F.lit("…"))).alias("code_snippet"),
        F.lit(JS_CONFIDENCE).alias("confidence"), lookup(severity, JS_IMPACT, 0.2).alias("impact_score"), F.lit("javascript_patterns").alias("detected_by"), F.col("name").alias("pattern_type"),
    )
    return as_findings(out)


def js_metrics(files: DataFrame) -> DataFrame:
    """Lines, functions, classes, imports and branches of a file, counted by patterns."""
    n = lambda p: F.regexp_count("content", F.lit(p)).cast("long")
    return files.select(
        "path", (F.size(F.split("content", "\n", -1))).cast("long").alias("loc"), n(r"\bfunction\b|=>").alias("functions"), n(r"\bclass\s+[A-Za-z_]").alias("classes"),
        n(r"(?m)^\s*import\b|\brequire\s*\(").alias("imports"), n(r"\b(?:if|for|while|case|catch)\b|\?\s|&&|\|\|").alias("branches"),
    )


WEAK_HASH = r"""hashlib\.(?:md5|sha1)\s*\(|hashlib\.new\s*\(\s*["'](?:md5|sha1)["']"""


def weak_crypto(lines_of: DataFrame) -> DataFrame:
    """Calls of broken hashes in Python, but for those that say they aren't for security."""
    return lines_of.where(F.endswith("path", F.lit(".py")) & F.rlike("line", F.lit(WEAK_HASH)) & ~F.rlike("line", F.lit(r"usedforsecurity\s*=\s*False"))).select("path", "line_no")


_TEXT = r"""[rR]?[fF][rR]?["']"""
_SQL_TEMPLATE = r"""\.(?:query|execute)\(\s*`[^`]*\$\{[^`]*`\s*[,)]|\.(?:exec|run|raw|\$queryRawUnsafe|\$executeRawUnsafe)\(\s*`[^`]*\$\{[^`]*`\s*\)"""
_HTML_TEMPLATE = r"""\.(?:innerHTML|outerHTML)\s*=\s*`[^`]*\$\{|\bdocument\.write\(\s*`[^`]*\$\{"""
_SCRIPT, _TYPED = (".js", ".jsx", ".mjs", ".cjs"), (".ts", ".tsx")
# fixed values: rules of code: name, endings, pattern, and what in the line excuses it; severity, confidence and impact of all
CODE_RULES = (
    ("python.sql_text", (".py",), rf"""(?:\.execute|\btext)\(\s*{_TEXT}|\.objects\.raw\(\s*{_TEXT}|\.extra\(\s*where\s*=\s*\[\s*{_TEXT}|\.(?:execute|objects\.raw)\(\s*(?:["'][^"']*["']|[A-Za-z_][A-Za-z0-9_.]*)\s*\+""", None),
    ("python.sql_variable", (".py",), r"\.execute\(\s*(?:query|sql|stmt|statement|update_query|delete_query|insert_query|select_query|raw_query|raw_sql)\s*\)", None),
    ("python.shell_text", (".py",), rf"\bos\.(?:system|popen)\(\s*{_TEXT}|\bsubprocess\.(?:run|call|Popen|check_output)\(\s*{_TEXT}.*shell\s*=\s*True", None), ("python.weak_hash", (".py",), WEAK_HASH, r"usedforsecurity\s*=\s*False"),
    ("javascript.sql_template", _SCRIPT, _SQL_TEMPLATE, None), ("typescript.sql_template", _TYPED, _SQL_TEMPLATE, None),
    ("javascript.html_template", _SCRIPT, _HTML_TEMPLATE, None), ("typescript.html_template", _TYPED, _HTML_TEMPLATE, None),
)
RULE_SEVERITY, RULE_CONFIDENCE, RULE_IMPACT = "medium", 0.65, 0.7


def rule_findings(lines_of: DataFrame, rules=CODE_RULES) -> DataFrame:
    """Findings of rules of code, one per line and rule. ``rules`` are rows of CODE_RULES' form, so that users can add their own.

    A call that spans several lines is matched by the line that its name and first argument are in.
    """
    path, line = F.col("path"), F.col("line")
    ending = extension(path)
    hit = lambda ends, p, unless: ending.isin(*ends) & F.rlike(line, F.lit(p)) & (F.lit(True) if unless is None else ~F.rlike(line, F.lit(unless)))
    hits = F.array_compact(F.array(*(F.when(hit(ends, p, unless), F.lit(name)) for name, ends, p, unless in rules)))
    rows = lines_of.where(ending.isin(*sorted({e for _, ends, *_ in rules for e in ends}))).select("path", "line_no", F.explode(hits).alias("name"))
    what = F.replace(F.element_at(F.split("name", r"\."), -1), F.lit("_"), F.lit(" "))
    out = rows.select(
        finding_id(F.lit("rules"), F.col("name"), path, F.col("line_no"), F.lit(1)).alias("id"), F.lit("security").alias("type"), F.lit(RULE_SEVERITY).alias("severity"), path.alias("file_path"), F.col("line_no").alias("line_number"),
        F.concat(F.lit("Code rule: "), what).alias("title"), F.concat(F.lit("Matched "), F.col("name")).alias("description"), F.lit(RULE_CONFIDENCE).alias("confidence"), F.lit(RULE_IMPACT).alias("impact_score"),
        F.lit("code_rules").alias("detected_by"), F.col("name").alias("rule_id"), F.col("name").alias("pattern_type"),
    )
    return as_findings(out)


def imports(lines_of: DataFrame) -> DataFrame:
    """(path, line_no, module): modules that Python lines import, up to the first dot."""
    line = F.col("line")
    module = F.coalesce(F.nullif(F.regexp_extract(line, r"^\s*import\s+([A-Za-z_][A-Za-z0-9_]*)", 1), F.lit("")), F.nullif(F.regexp_extract(line, r"^\s*from\s+([A-Za-z_][A-Za-z0-9_]*)[A-Za-z0-9_.]*\s+import\b", 1), F.lit("")))
    return lines_of.where(F.endswith("path", F.lit(".py"))).select("path", "line_no", module.alias("module")).where("module is not null")


def unknown_imports(lines_of: DataFrame, catalog: DataFrame) -> DataFrame:
    """Imports that no row of the catalog (module) explains."""
    return imports(lines_of).join(catalog.select("module").distinct(), "module", "left_anti").select("path", "line_no", "module")


def category_topk(found: DataFrame, category: str, order: list[Column], k: int = 20, least: float = 0.80) -> DataFrame:
    """The top k of each category, and of those the ones that are confident."""
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(*order)))
    return placed.where((F.col("place") <= k) & (F.col("confidence") >= least))


def detector_cap(found: DataFrame, order: list[Column], cap: int = 1000) -> DataFrame:
    """Per detector at most ``cap`` findings, but all critical ones: they come first and only take room.

    Critical findings are counted, not placed, so that the limit of the others holds before the shuffle.
    """
    critical = F.coalesce(F.col("severity") == "critical", F.lit(False))
    taken = found.where(critical).groupBy(F.col("detected_by").alias("_by")).agg(F.count("*").alias("_taken"))
    placed = found.where(~critical).withColumn("_place", F.row_number().over(Window.partitionBy("detected_by").orderBy(*order))).where(F.col("_place") <= cap)
    room = placed.join(taken, F.col("detected_by").eqNullSafe(F.col("_by")), "left").where(F.col("_place") + F.coalesce("_taken", F.lit(0)) <= cap)
    return found.where(critical).unionByName(room.drop("_place", "_by", "_taken"))


def pack_by_tokens(texts: DataFrame, max_tokens: int = 1_500_000, max_count: int = 3000, fixed: int = 3750) -> DataFrame:
    """(grp, id, cost, chunk): greedy chunks in the order of ``id`` under a token and a count budget, by group.

    A running sum can't say where a greedy chunk ends, so one Python pass runs
    over each group's rows as they stream by in order; it holds two numbers.
    A row that is over the budget by itself is a chunk alone. A group of any
    size is one task's, so large inputs give a ``grp`` for each range of ids:
    chunks then also end where a range does.
    """
    import pyarrow as pa

    cost = (F.ceil((F.length(F.encode("text", "UTF-16")) - 2) / 2 / 2) + fixed).cast("long")
    rows = texts.withColumn("cost", F.when(F.length("text") == 0, F.lit(fixed)).otherwise(cost)).repartition("grp").sortWithinPartitions("grp", "id")

    def run(it):
        now, chunk, tokens, count = None, 0, 0, 0
        for batch in it:
            out = []
            for g, c in zip(batch.column("grp").to_pylist(), batch.column("cost").to_pylist(), strict=True):
                if g != now:
                    now, chunk, tokens, count = g, 0, 0, 0
                elif count and (tokens + c > max_tokens or count >= max_count):
                    chunk, tokens, count = chunk + 1, 0, 0
                tokens, count = tokens + c, count + 1
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("id"), batch.column("cost"), pa.array(out, pa.int64())], ["grp", "id", "cost", "chunk"])

    return rows.select(F.col("grp").cast("string").alias("grp"), F.col("id").cast("string").alias("id"), "cost").mapInArrow(run, "grp string, id string, cost long, chunk long")


# fixed values: what a project's signature is made of: kind, names in order of preference, characters taken
SIGNATURE = (
    ("readme", ("README.md", "README.rst", "README.txt", "README"), 5000), ("manifest", ("package.json", "pyproject.toml", "setup.py", "Cargo.toml", "go.mod", "requirements.txt"), 2000),
    ("entrypoint", ("main.py", "app.py", "index.js", "index.ts", "src/main.py", "src/index.ts"), 3000),
)


def project_signature(files: DataFrame) -> DataFrame:
    """(kind, path, text): the first file there is of each kind, cut to its length."""
    cases = [F.when(F.col("path") == n, F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.lit(most).alias("most"))) for kind, names, most in SIGNATURE for k, n in enumerate(names)]
    named = files.withColumn("c", F.coalesce(*cases)).where("c is not null")
    return named.groupBy("c.kind").agg(F.min_by(F.struct("path", F.expr("substring(content, 1, c.most)").alias("text")), "c.k").alias("f")).select("kind", "f.*")


__all__ = ["any_of", "bandit_rows", "category_topk", "detector_cap", "js_findings", "js_metrics", "js_patterns", "pack_by_tokens", "project_signature", "pylint_rows", "rule_findings", "unknown_imports", "weak_crypto"]
