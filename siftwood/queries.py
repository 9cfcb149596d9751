"""One thin query per operator, over the driver's tables and the literal cases; none returns what a detector matched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import values as V
from .functions.columns import extension, lookup, path_parts
from .functions.lineage import settled
from .operators import classify, detect, filters, frameworks, graph, incremental, pyast, rank, redact, rollup, tools
from .plans import scan as plans
from .schema import as_findings, finding_id
from .sources import corpus, readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AS_OF = "2024-01-31 00:00:00"
#: Rules of the ignore queries.
GLOBS, TYPES = ("build/", "*.sh", "/docs/", "src/keys/*", "node_modules"), ("weak_jwt", "legacy_patterns.BUG")
EXCLUDES = ("node_modules/", "build/", "*.sh", "nothing.py", "docs/page_1", "config/settings_1*.yaml")
CATALOG = ("flask", "os", "sys", "json", "re")
#: Tool rows: two types that line detectors don't give, and cases of the filters.
TOOL_FINDINGS = tuple(
    (f"tool_{k}", kind, severity, path, line, title, text, sure, impact, who, rule)
    for k, (kind, severity, path, line, title, text, sure, impact, who, rule) in enumerate((
        ("performance", "high", "src/web/app.py", 5, "High Cyclomatic Complexity: 17", "too many branches", 0.95, 0.0, "ComplexityDetector", "cyclomatic_complexity"),
        ("performance", "medium", "src/api/db.py", 1, "High Cyclomatic Complexity: 11", "many branches", 0.95, 0.0, "ComplexityDetector", "cyclomatic_complexity"),
        ("performance", "medium", "src/api/db.py", 2, "Potentially Unbounded While Loop", "no way out", 0.55, 0.0, "LoopsDetector", "unbounded_while_loop"),
        ("architecture", "medium", "src/api/db.py", None, "Function Signature Coherence Violation", "two signatures of f", 0.9, 0.8, "coherence", "function_signature_mismatch"),
        ("code_quality", "critical", "src/broken.py", 3, "Syntax Error in Code", "cannot be parsed", 0.95, 0.9, "SyntaxDetector", "syntax_error"),
        ("code_quality", "low", "src/api/db.py", 4, "C0301: line-too-long", "Line too long C0301", 0.8, 0.0, "pylint", "C0301"),
        ("code_quality", "medium", "src/api/db.py", 4, "unused-variable", "Unused variable", 0.7, 0.0, "pylint", "W0612"),
        ("security", "medium", "tests/test_people.py", 1, "Use of assert detected", "assert_used", 0.9, 0.0, "bandit", "B101"),
        ("security", "critical", "src/auth/login.py", 1, "Possible hardcoded password", "Possible hardcoded password: 'x'", 0.7, 0.0, "bandit", "B105"),
        ("security", "medium", "src/web/ids.py", 9, "Use of insecure MD5 hash", "md5 for an id", 0.9, 0.0, "bandit", "B303"),
        ("security", "high", "src/web/app.py", 5, "Tainted data reaches command injection", "from request to run", 0.9, 0.85, "PysaTaintScanner", "taint_command_injection"),
        ("analysis_error", "low", "src/broken.py", None, "Analysis Limitation", "partly analysed", 0.8, 0.1, "SyntaxDetector", "analysis_error"),
        ("security", "high", "src/web/app.py", 1, "Package Hallucination: src.helpers", "unknown package", 0.9, 0.5, "imports", "package_hallucination"),
        ("security", "high", "src/web/app.py", 2, "Package Hallucination: flaskk", "unknown package", 0.9, 0.5, "imports", "package_hallucination"),
        ("todo", "low", "src/web/app.py", 7, "TODO Comment", "todo: later", 0.3, 0.0, "legacy_patterns", "TODO"),
        ("privacy", "high", "src/people/ids.py", 1, "Passport Number", "passport", 0.9, 0.8, "reviewer", "passport"),
    ))
)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(_files(spark, sf_dir))


def _literals(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """Rows of constants without a Python job."""
    fields = [x.rsplit(" ", 1) for x in ddl.split(", ")]
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields, strict=True))) for r in rows))))


def _tool_findings(spark: SparkSession) -> DataFrame:
    rows = _literals(spark, TOOL_FINDINGS, "id string, type string, severity string, file_path string, line_number int, title string, description string, confidence double, impact_score double, detected_by string, pattern_type string")
    is_package = F.col("pattern_type") == "package_hallucination"
    return as_findings(rows.withColumn("id", F.when(is_package, F.concat(F.lit("package_hallucination_x_"), "id")).otherwise(F.col("id"))))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors' findings and the tool rows, with a detection time by file."""
    found = detect.detect(_files(spark, sf_dir)).unionByName(_tool_findings(spark))
    return found.withColumn("detected_at", F.lit(AS_OF).cast("timestamp") - F.make_interval(days=F.length("file_path") % 40))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.scored(_findings(spark, sf_dir), AS_OF)


# sources


@query
def path_exclude(spark, sf_dir):
    path = F.col("path")
    return _files(spark, sf_dir).select("path", readers.excluded(path, EXCLUDES).alias("excluded"), classify.excluded_from_analysis(path).alias("artifact"))


@query
def file_index_by_ext(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


@query
def doc_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("line").cast("long")).alias("chars"), F.max(F.length("line")).alias("longest"))


@query
def size_cutoff(spark, sf_dir):
    size = F.octet_length("content").cast("long")
    return _files(spark, sf_dir).where(size <= 4096).select("path", size.alias("size"))


@query
def ext_allowlist(spark, sf_dir):
    ext = extension(F.col("path"))
    return _files(spark, sf_dir).where(ext.isin(".py", ".js", ".ts", ".yaml")).groupBy(ext.alias("ext"), F.element_at(path_parts(F.col("path")), 1).alias("top")).agg(F.count("*").alias("n"))


@query
def ignore_rules(spark, sf_dir):
    rows = _literals(spark, [(x,) for x in ("# comment", "", "  ", "build/", ":weak_jwt", ": spaced ", ":", "*.tmp", "/anchored", "  indented.py  ")], "line string")
    return readers.parse_ignore(rows)


@query
def normalize_path(spark, sf_dir):
    rows = _files(spark, sf_dir).select(F.concat(F.lit("/work/project/"), "path").alias("raw")).unionByName(_literals(spark, [("./a/b.py",), ("c\\d.py",), ("/else/e.py",), (".env",)], "raw string"))
    return rows.select("raw", sinks.normalize_path(F.col("raw"), "/work/project").alias("path"))


# personal data


def _pii(spark, sf_dir, *names):
    return detect.pii_matches(detect.pii_lines(_files(spark, sf_dir)), names or None)


def _pii_counts(spark, sf_dir, *names):
    raw = _pii(spark, sf_dir, *names).groupBy("path", "line_no", F.col("name")).agg(F.count("*").alias("raw_matches"))
    kept = detect.pii_valid(_pii(spark, sf_dir, *names)).groupBy("path", "line_no", "name").agg(F.count("*").alias("kept"), F.min("pattern_type").alias("pattern_type"), F.max("confidence").alias("confidence"))
    return raw.join(kept, ["path", "line_no", "name"], "left").select("path", "line_no", "name", "raw_matches", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), "pattern_type", "confidence")


@query
def pii_credit_card(spark, sf_dir):
    return _pii_counts(spark, sf_dir, "credit_card")


@query
def pii_ssn(spark, sf_dir):
    return _pii_counts(spark, sf_dir, "us_ssn")


@query
def pii_email(spark, sf_dir):
    return _pii_counts(spark, sf_dir, "email_address")


@query
def pii_phone(spark, sf_dir):
    return _pii_counts(spark, sf_dir, "phone_number")


@query
def pii_ip(spark, sf_dir):
    return _pii_counts(spark, sf_dir, "ip_address")


@query
def pii_intl(spark, sf_dir):
    return _pii_counts(spark, sf_dir, *(n for n, _, _ in V.PII[5:]))


@query
def test_context(spark, sf_dir):
    return _files(spark, sf_dir).select("path", detect.test_context(F.col("path"), F.col("content")).alias("is_test"))


@query
def pii_suppression(spark, sf_dir):
    found = detect.pii(_files(spark, sf_dir))
    return found.groupBy("file_path", "severity", "confidence").agg(F.count("*").alias("n"))


@query
def pii_mask(spark, sf_dir):
    return detect.pii(_files(spark, sf_dir)).groupBy("pattern_type", F.col("description").alias("mask")).agg(F.count("*").alias("n"))


@query
def pii_consolidated(spark, sf_dir):
    found = detect.consolidate(detect.pii(_files(spark, sf_dir)))
    return found.select("id", "severity", "file_path", "line_number", "title", "confidence", "pattern_type", F.array_join("pii_types", ",").alias("pii_types"), "consolidated_from")


@query
def pii_titles(spark, sf_dir):
    return detect.pii(_files(spark, sf_dir)).groupBy("pattern_type", "title", "remediation").agg(F.count("*").alias("n"))


# credentials, validation, language, markers


def _short(found: DataFrame) -> DataFrame:
    return found.select("id", "type", "severity", "file_path", "line_number", "title", "confidence", "impact_score", "detected_by", "pattern_type")


@query
def auth_hardcoded_secrets(spark, sf_dir):
    return detect.auth_matches(_lines(spark, sf_dir)).where("kind = 'hardcoded_secrets'").select("path", "line_no", "kind")


@query
def auth_patterns(spark, sf_dir):
    return _short(detect.auth(_lines(spark, sf_dir)))


@query
def input_validation(spark, sf_dir):
    return _short(detect.validation(_lines(spark, sf_dir)))


@query
def redact_snippet(spark, sf_dir):
    found = detect.auth(_lines(spark, sf_dir))
    return found.select("file_path", "line_number", "pattern_type", F.sha2("code_snippet", 256).alias("snippet_sha"), F.length("code_snippet").alias("snippet_length"))


@query
def secret_shapes(spark, sf_dir):
    return detect.shape_matches(_lines(spark, sf_dir), V.SECRETS).groupBy("path", "line_no", "name").agg(F.count("*").alias("n"), F.sum(F.length("m").cast("long")).alias("chars"))


@query
def obfuscation(spark, sf_dir):
    return detect.shape_matches(_lines(spark, sf_dir), V.OBFUSCATION).groupBy("path", "line_no", "name").agg(F.count("*").alias("n"), F.sum(F.length("m").cast("long")).alias("chars"))


@query
def moderation_hits(spark, sf_dir):
    return detect.moderation_matches(_lines(spark, sf_dir)).groupBy("path", "line_no", "name").agg(F.count("*").alias("n"))


@query
def moderation_context(spark, sf_dir):
    return detect.moderation(_lines(spark, sf_dir)).select("id", "severity", "file_path", "line_number", "pattern_type", F.round("confidence", 6).alias("confidence"), "impact_score")


@query
def todo_markers(spark, sf_dir):
    return detect.marker_matches(_lines(spark, sf_dir)).select("path", "line_no", "name", "severity")


@query
def unknown_imports(spark, sf_dir):
    return tools.unknown_imports(_lines(spark, sf_dir), _literals(spark, [(m,) for m in CATALOG], "module string"))


@query
def js_patterns(spark, sf_dir):
    return tools.js_patterns(_lines(spark, sf_dir))


#: Lines that the files don't hold: a key by its name, parameter lists of seven and of eight, and a test's credential.
JS_LINES = (
    ("web/keys.ts", 1, "const c = { apiToken: '0123456789abcdef0123456789abcdef' }"), ("web/keys.ts", 2, "f({ other: '0123456789abcdef0123456789abcdef' })"), ("web/many.js", 1, "function f(a, b, c, d, e, f, g) {"),
    ("web/many.js", 2, "function g(a, b, c, d, e, f, g, h) {"), ("web/e2e/login.test.ts", 3, "const password = 'hunter2hunter2'"), ("web/e2e/login.test.ts", 4, "// TODO later"), ("web/other.py", 1, "eval(x)"),
)


@query
def js_findings(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("path", "line_no", "line").unionByName(_literals(spark, JS_LINES, "path string, line_no int, line string"))
    return tools.js_findings(rows).select(*"id type severity file_path line_number title confidence impact_score detected_by pattern_type".split())


#: Lines that the files don't hold, for each rule of code, and what it lets pass.
RULE_LINES = (
    ("src/rules.py", 1, 'cur.execute(f"select {x}")'), ("src/rules.py", 2, "cur.execute('select ' + x)"), ("src/rules.py", 3, "cur.execute('select ?', (x,))"), ("src/rules.py", 4, "db.execute(raw_sql)"), ("src/rules.py", 5, 'os.system(f"rm {x}")'),
    ("src/rules.py", 6, 'subprocess.run(f"ls {x}", shell=True)'), ("src/rules.py", 7, 'subprocess.run(f"ls {x}")'), ("src/rules.py", 8, "hashlib.md5(x, usedforsecurity=False)"), ("src/rules.py", 9, "hashlib.sha1(x)"),
    ("web/rules.js", 1, "db.query(`select ${x}`)"), ("web/rules.ts", 2, "db.exec(`drop ${x}`)"), ("web/rules.ts", 3, "db.exec(`drop ${x}`, y)"), ("web/rules.jsx", 4, "el.innerHTML = `<b>${x}</b>`"), ("web/rules.tsx", 5, "document.write(`${x}`)"), ("web/rules.tsx", 6, "el.textContent = `${x}`"),
)


@query
def rule_findings(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("path", "line_no", "line").unionByName(_literals(spark, RULE_LINES, "path string, line_no int, line string"))
    return _short(tools.rule_findings(rows))


@query
def js_metrics(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages").select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    return tools.js_metrics(pages)


@query
def weak_crypto(spark, sf_dir):
    return tools.weak_crypto(_lines(spark, sf_dir))


BANDIT_JSON = '{"results": [{"test_id": "B105", "filename": "src/a.py", "line_number": 3, "col_offset": 4, "issue_severity": "LOW", "issue_confidence": "MEDIUM", "issue_text": "Possible hardcoded password"}, {"test_id": "B105", "filename": "src/a.py", "line_number": 3, "col_offset": 4, "issue_severity": "LOW", "issue_confidence": "MEDIUM", "issue_text": "Possible hardcoded password"}, {"test_id": "B602", "filename": "src/b.py", "line_number": 9, "issue_severity": "HIGH", "issue_confidence": "HIGH", "issue_text": "shell=True"}, {"test_id": "B303", "filename": "src/id.py", "line_number": 1, "col_offset": 0, "issue_severity": "MEDIUM", "issue_confidence": "LOW", "issue_text": "Use of insecure MD5"}]}'
PYLINT_JSON = '[{"type": "error", "message-id": "E0602", "symbol": "undefined-variable", "path": "src/a.py", "line": 3, "column": 1, "message": "Undefined variable"}, {"type": "convention", "message-id": "C0301", "symbol": "line-too-long", "path": "src/a.py", "line": 4, "column": 0, "message": "Line too long"}, {"type": "info", "message-id": "I0011", "symbol": "locally-disabled", "path": "src/a.py", "line": 5, "column": 0, "message": "off"}, {"type": "warning", "message-id": "W0612", "symbol": "unused-variable", "path": "tests/test_a.py", "line": 6, "column": 2, "message": "assert_used"}]'


def _tool_rows(spark):
    return tools.bandit_rows(_literals(spark, [(BANDIT_JSON,)], "value string")).unionByName(tools.pylint_rows(_literals(spark, [(PYLINT_JSON,)], "value string")))


@query
def normalize_tool_rows(spark, sf_dir):
    return _short(_tool_rows(spark))


@query
def tool_filters(spark, sf_dir):
    return _tool_rows(spark).unionByName(_tool_findings(spark)).select("id", filters.tool_noise().alias("noise"), filters.tool_severity().alias("adjusted_severity"))


@query
def category_topk(spark, sf_dir):
    order = [F.desc(filters.severity_rank()), F.desc("confidence"), F.asc("file_path"), F.asc_nulls_last("line_number"), F.asc("id")]
    return _short(tools.category_topk(_findings(spark, sf_dir), "pattern_type", order))


@query
def detector_cap(spark, sf_dir):
    order = [F.desc(filters.severity_rank()), F.desc("confidence"), F.asc("file_path"), F.asc_nulls_last("line_number"), F.asc("pattern_type"), F.asc("id")]
    return _short(tools.detector_cap(_findings(spark, sf_dir), order))


# cross-file


@query
def dead_symbols(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").where("text is not null")
    # exploded, so that filters on a name do not search the text once more each
    first = F.explode(F.array(F.regexp_extract("text", "[A-Za-z_]+", 0))).alias("name")
    defs = docs.select(F.expr(corpus.PATH_SQL).alias("path"), F.col("doc_id").cast("int").alias("line"), first).where("name <> ''")
    later = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), F.lit(0)), 2, 1 << 30)
    return graph.dead_symbols(defs, docs.select(F.explode(F.array_distinct(later)).alias("name")))


@query
def topk_largest_docs(spark, sf_dir):
    return graph.largest(_files(spark, sf_dir))


@query
def pairwise_mismatch(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "nation")
    c = corpus.table(spark, sf_dir, "supplier")
    rows = c.join(o, c.s_nationkey == o.n_nationkey).select(F.col("n_name").alias("name"), (F.col("s_suppkey") % 4).cast("string").alias("detail"), F.col("s_name").alias("path"), F.col("s_suppkey").cast("int").alias("line"))
    return graph.pairwise_mismatch(rows)


@query
def taint_reach(spark, sf_dir):
    edges = corpus.table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 13).cast("int").alias("src"), (F.col("n_nationkey") * 7 % 17).cast("int").alias("dst")).distinct()
    return graph.reach(edges, _literals(spark, [(1,)], "node int"))


# classes and frameworks


@query
def file_classify(spark, sf_dir):
    rows = _files(spark, sf_dir).select(F.col("path").alias("file_path")).unionByName(_literals(spark, [(p,) for p in ("setup.py", "src/a/b/c.tsx", "README", "tests/fixtures/x.txt", "a/__tests__/b.js", "vite.config.ts", "Upper/x.py", "main.go", "dist/app.js", ".git/config", "x.d.ts", "web/app.spec.ts", "my/.next/a.js", "data.bin", "cypress/a.ts")], "file_path string"))
    return classify.classified(rows).select("file_path", "file_type", "file_weight", "is_production", "file_priority")


@query
def file_type_summary(spark, sf_dir):
    return classify.classified(_files(spark, sf_dir), "path").groupBy("file_type").agg(F.count("*").alias("n"))


@query
def framework_entry_points(spark, sf_dir):
    return frameworks.entry_points(_files(spark, sf_dir))


@query
def framework_sinks(spark, sf_dir):
    return frameworks.sinks(_files(spark, sf_dir))


@query
def severity_adjust(spark, sf_dir):
    found = detect.validation(_lines(spark, sf_dir)).unionByName(detect.auth(_lines(spark, sf_dir)))
    return frameworks.adjust(found, _files(spark, sf_dir)).select("id", "file_path", "line_number", "severity", "adjusted_severity")


# finding sets


@query
def findings_union(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("detected_by", "type", "severity").agg(F.count("*").alias("n"))


@query
def findings_all(spark, sf_dir):
    return _short(_findings(spark, sf_dir))


@query
def ignore_filter(spark, sf_dir):
    return filters.ignore_filter(_findings(spark, sf_dir), GLOBS, TYPES).select("id", "file_path", "detected_by", "pattern_type")


@query
def noise_confidence(spark, sf_dir):
    return _findings(spark, sf_dir).where(filters.confident()).groupBy("type", "severity").agg(F.count("*").alias("n"))


@query
def noise_internal_and_style(spark, sf_dir):
    return _tool_findings(spark).select("id", F.coalesce(filters.package_name(), F.lit("")).alias("package"), filters.internal_package("project").alias("internal"), filters.style_only().alias("style"))


@query
def noise_per_file_cap(spark, sf_dir):
    return filters.per_file_cap(_findings(spark, sf_dir)).select("id", "file_path", "type", "severity")


@query
def noise_stats(spark, sf_dir):
    return filters.noise_stats(_findings(spark, sf_dir))


@query
def reduced_findings(spark, sf_dir):
    return _short(filters.reduce_noise(_findings(spark, sf_dir)))


@query
def developer_mode(spark, sf_dir):
    return filters.developer_only(_findings(spark, sf_dir)).select("id", "file_path")


@query
def review_filter(spark, sf_dir):
    talk = corpus.table(spark, sf_dir, "conversations")
    severity = F.element_at(F.array(*map(F.lit, ("crit", "hi", "Moderate", "minor", "note", "unheard"))), (F.col("conv_id") % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("sec", "pii", "style", "perf", "design", "fixme", "else"))), (F.col("conv_id") % 7 + 1).cast("int"))
    rows = talk.select(
        F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")).alias("file"), F.lit(None).cast("string").alias("file_path"), F.col("turn").cast("string").alias("line"), F.lit(None).cast("string").alias("line_number"),
        F.when(F.col("turn") % 5 != 4, F.col("role")).alias("title"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("message"), F.length("text").cast("string").alias("description"),
        severity.alias("severity"), kind.alias("category"), F.lit(None).cast("string").alias("type"), F.when(F.col("turn") % 3 != 0, (F.col("conv_id") % 15 / 10).cast("string")).alias("confidence"), F.lit(None).cast("string").alias("detected_by"),
    )
    found = filters.review_findings(rows)
    return found.where(filters.confident()).select("id", "type", "severity", "file_path", "line_number", "title", F.round("confidence", 6).alias("confidence"), "impact_score", "detected_by")


@query
def overlap_peers(spark, sf_dir):
    return filters.overlap_peers(_findings(spark, sf_dir)).select("id", "file_path", "line_number", "detected_by", F.array_join("peers", ",").alias("peers"))


@query
def wire_text(spark, sf_dir):
    return _findings(spark, sf_dir).select("id", F.md5(filters.wire_text()).alias("wire"))


@query
def cluster_sizes(spark, sf_dir):
    return filters.cluster_sizes(_findings(spark, sf_dir)).select("id", "type", "cluster_size", rollup.display_cluster(F.col("cluster_size")).alias("shown"))


@query
def token_chunks(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("grp"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return tools.pack_by_tokens(docs, 20_000, 4)


@query
def project_signature(spark, sf_dir):
    rows = _literals(spark, [("README", "plain"), ("README.md", "x" * 6000), ("setup.py", "setup()"), ("app.py", "run()"), ("src/main.py", "main()"), ("other.txt", "no")], "path string, content string")
    return tools.project_signature(rows).select("kind", "path", F.length("text").alias("length"))


# ranking


@query
def rank_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "file_path", "severity_score", "type_score", F.round("file_score", 6).alias("file_score"), "temporal", "cluster_boost", "ranking_score")


@query
def temporal_score(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    return e.groupBy("event_type", rank.temporal_score(F.col("ts").cast("timestamp"), F.lit(AS_OF).cast("timestamp")).alias("score")).agg(F.count("*").alias("n"))


@query
def rank_positions(spark, sf_dir):
    return rank.positions(_scored(spark, sf_dir)).select("id", F.col("position").cast("long").alias("position"), "percentile", "ranking_score")


@query
def top_findings(spark, sf_dir):
    return rank.top(_scored(spark, sf_dir)).select("id", "severity", "file_path", "line_number", "title", "ranking_score")


@query
def contextual_risk(spark, sf_dir):
    return rank.contextual_risk(_findings(spark, sf_dir))


@query
def ranking_report(spark, sf_dir):
    return rank.ranking_report(_scored(spark, sf_dir))


# rollups


@query
def stats_overview(spark, sf_dir):
    return rollup.overview(_findings(spark, sf_dir))


@query
def stats_distribution(spark, sf_dir):
    return rollup.distribution(_findings(spark, sf_dir))


@query
def file_metrics(spark, sf_dir):
    return rollup.file_metrics(_findings(spark, sf_dir))


@query
def file_priorities(spark, sf_dir):
    return rollup.file_priorities(_findings(spark, sf_dir))


@query
def file_intelligence(spark, sf_dir):
    return rollup.file_intelligence(_findings(spark, sf_dir))


@query
def confidence_bands(spark, sf_dir):
    return rollup.confidence_bands(_findings(spark, sf_dir))


@query
def detector_health(spark, sf_dir):
    ran = _findings(spark, sf_dir).groupBy(F.col("detected_by").alias("name")).agg(F.count("*").cast("int").alias("findings")).select("name", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"), "findings")
    more = _literals(spark, [("taint", "skipped", "no tool", 0), ("js", "errored", "no node", 0), ("ast", "skipped", "no tool", 0)], "name string, status string, reason string, findings int")
    return rollup.detector_health(ran.unionByName(more))


@query
def detail_by_type(spark, sf_dir):
    return rollup.detail_by_type(_findings(spark, sf_dir))


@query
def security_overview(spark, sf_dir):
    return rollup.security_overview(_findings(spark, sf_dir))


@query
def vuln_categories(spark, sf_dir):
    return rollup.vulnerability_categories(_findings(spark, sf_dir))


@query
def privacy_categories(spark, sf_dir):
    return rollup.privacy_categories(_findings(spark, sf_dir))


@query
def privacy_overview(spark, sf_dir):
    return rollup.privacy_overview(_findings(spark, sf_dir))


@query
def compliance(spark, sf_dir):
    return rollup.compliance(detect.enrich_privacy(_findings(spark, sf_dir)))


@query
def exec_categories(spark, sf_dir):
    return rollup.executive_categories(_findings(spark, sf_dir))


@query
def fallback_risk(spark, sf_dir):
    return rollup.fallback_risk(_findings(spark, sf_dir))


@query
def recommendation_top3(spark, sf_dir):
    return rollup.recommendation(_findings(spark, sf_dir))


@query
def typed_blocks(spark, sf_dir):
    return rollup.typed_blocks(_findings(spark, sf_dir))


@query
def production_focus(spark, sf_dir):
    return rollup.production_focus(_findings(spark, sf_dir))


@query
def remediation_dict(spark, sf_dir):
    return rollup.remediation_dict(_findings(spark, sf_dir))


@query
def fp_likelihood(spark, sf_dir):
    return rollup.false_positive_likelihood(_findings(spark, sf_dir))


@query
def first_seen(spark, sf_dir):
    found = _findings(spark, sf_dir)
    history = found.where(F.length("file_path") % 2 == 0).select("id", (F.lit("2023-12-01 00:00:00").cast("timestamp")).alias("first_seen")).distinct()
    return rollup.first_seen(found, history, AS_OF)


@query
def quick_actions(spark, sf_dir):
    return rollup.quick_actions(_findings(spark, sf_dir))


@query
def snippet_context(spark, sf_dir):
    out = rollup.snippet_context(_lines(spark, sf_dir), detect.moderation(_lines(spark, sf_dir)))
    return out.select("id", "path", "line_number", F.md5("context").alias("context"))


# redaction


@query
def redact_text(spark, sf_dir):
    return _lines(spark, sf_dir).select("path", "line_no", "line", redact.redact_text(F.col("line")).alias("after")).where("after <> line").select("path", "line_no", F.md5("after").alias("after"))


@query
def leak_scan(spark, sf_dir):
    return redact.leak_scan(_lines(spark, sf_dir), "line").select("path", "line_no", "leak")


@query
def sanitized(spark, sf_dir):
    return redact.sanitize(_findings(spark, sf_dir)).select("id", "type", F.md5("description").alias("description"), F.col("code_snippet").isNull().alias("no_snippet"))


# increments


def _versions(spark, sf_dir):
    old = _files(spark, sf_dir).where(~F.endswith("path", F.lit("7.txt")))
    edited = F.when(F.endswith("path", F.lit("1.py")), F.concat("content", F.lit("\nedited # TODO"))).otherwise(F.col("content"))
    new = _files(spark, sf_dir).where(~F.endswith("path", F.lit("2.md"))).withColumn("content", edited)
    return old, new


@query
def changed_docs(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return incremental.changed(incremental.snapshot(old), incremental.snapshot(new))


@query
def incremental_merge(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    what = incremental.changed(incremental.snapshot(old), incremental.snapshot(new))
    again = new.join(what.where("change <> 'deleted'").select("path"), "path", "left_semi")
    cached = detect.moderation(corpus.lines(old)).unionByName(detect.markers(corpus.lines(old)))
    fresh = detect.moderation(corpus.lines(again)).unionByName(detect.markers(corpus.lines(again)))
    return incremental.merge(fresh, cached, what).select("id", "file_path", "line_number", "pattern_type")


@query
def mtime_changes(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").select(F.col("event_id"), F.col("ts").cast("timestamp").alias("modification_time"))
    return incremental.modified_since(e, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


@query
def session_debounce(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("item"))
    out = incremental.sessions(e, "20 minutes")
    return out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.array_join("items", ",").alias("items"))


# syntax trees


CODE_FILES = (
    ("src/slow.py", "def grow(xs):\n    s = ''\n    for x in xs:\n        s += x\n        xs.insert(0, x)\n    while True:\n        pass\n\ndef deep(a):\n    for i in a:\n        for j in a:\n            for k in a:\n                print(i, j, k)\n"),
    ("src/stub.py", "def later():\n    '''Soon.'''\n    pass\n\ndef done(x):\n    return x\n\nclass Box:\n    def area(self, a, b=1):\n        raise NotImplementedError\n"),
    ("src/other.py", "def area(a):\n    try:\n        return a['x'], a['y'], a['z']\n    except ValueError:\n        pass\n\ndef use(a):\n    return area(a)\n"),
    ("src/third.py", "import logging\n\ndef area(a, *more):\n    try:\n        return a.x, a.y, a.z\n    except ValueError:\n        logging.error('no')\n"),
    ("src/flow.py", "import subprocess\nfrom flask import request\n\ndef view(db):\n    name = request.args['n']\n    sql = 'select ' + name\n    db.execute(sql)\n    db.execute('select ?', (name,))\n    subprocess.run(int(name))\n    eval(name)\n"),
    ("src/branchy.py", "def f(a, b, c):\n" + "".join(f"    if a == {k} and b:\n        c += {k}\n" for k in range(8)) + "    return c\n"),
    ("src/calls.py", "from flask import request\n\ndef entry(db):\n    passed(db, request.args['q'])\n\ndef passed(db, text, *, safe=None):\n    last(db, text + '!')\n    other(int(text))\n\ndef last(db, sql):\n    db.execute(sql)\n\ndef other(n):\n    eval(n)\n"),
    ("src/broken.py", "def f(:\n"),
)


def _code(spark, sf_dir):
    return _literals(spark, CODE_FILES, "path string, content string").unionByName(_files(spark, sf_dir))


@query
def ast_findings(spark, sf_dir):
    return _short(pyast.syntax_findings(_code(spark, sf_dir)))


@query
def ast_coherence(spark, sf_dir):
    facts = settled(pyast.facts(_code(spark, sf_dir)))
    of = lambda k: facts.where(F.col("kind") == k)
    return graph.violations(of("signature"), of("access"), of("handler"))


@query
def ast_dead_symbols(spark, sf_dir):
    facts = settled(pyast.facts(_code(spark, sf_dir)))
    return graph.dead_symbols(facts.where("kind = 'def'"), facts.where("kind = 'use'"), tolerated=1)


@query
def ast_call_reach(spark, sf_dir):
    calls = pyast.facts(_code(spark, sf_dir)).where("kind = 'call'").select(F.col("name").alias("src"), F.col("detail").alias("dst")).distinct()
    return graph.reach(calls, _literals(spark, [("use",), ("view",)], "node string"))


@query
def taint_flows(spark, sf_dir):
    return _short(graph.taint_flows(pyast.facts(_code(spark, sf_dir))))


# the whole


@query
def full_scan(spark, sf_dir):
    """Every detector over documents and code, adjusted by frameworks, suppressed and reduced."""
    return _short(plans.scan(_code(spark, sf_dir), globs=GLOBS, types=TYPES))


@query
def flagship(spark, sf_dir):
    """Documents to the 20 findings of line detectors that matter most."""
    found = plans.scan(_files(spark, sf_dir), globs=GLOBS, types=TYPES, deep=False)
    found = found.withColumn("detected_at", F.lit(AS_OF).cast("timestamp"))
    ranked = rank.top(rank.scored(found, AS_OF), 20)
    return ranked.select("id", "type", "severity", "file_path", "line_number", "title", "confidence", "detected_by", "ranking_score")


@query
def scan_modes(spark, sf_dir):
    out = None
    for mode in detect.MODES:
        one = detect.detect(_files(spark, sf_dir), mode).groupBy("type").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "type", "n")
        out = one if out is None else out.unionByName(one)
    return out


__all__ = ["QUERIES", "Window", "finding_id", "lookup"]
