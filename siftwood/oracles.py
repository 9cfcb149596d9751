"""The same queries in SQL for another engine, written from the rules and not from the operators."""

from __future__ import annotations

from . import queries as Q
from . import values as V
from . import values_frameworks as R
from .operators import detect, graph, tools
from .sources.corpus import LITERAL_FILES, PATH_SQL


def lit(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def rows(data) -> str:
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in data)


def listed(words) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def rx(text: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({text}, {lit(flags + pattern)})"


def case(key: str, values: dict, default=None) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {default if isinstance(default, str) else lit(default)} END"


def matches(pattern: str) -> str:
    return f"regexp_extract_all(line, {lit('(?i)' + pattern)})"


def numbered(source: str, expr: str, more: str) -> str:
    """One row per match of expr in the lines of source."""
    return f"SELECT * EXCLUDE (ms), unnest(ms) AS m, generate_subscripts(ms, 1)::INT AS k, {more} FROM (SELECT *, {expr} AS ms FROM {source})"


NAME = "regexp_extract(path, '[^/]*$')"
EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.](\\.[^.]*)$', 1))"
FILES = f"""files AS (SELECT {PATH_SQL} AS path, coalesce(text, '') AS content FROM documents UNION ALL SELECT * FROM (VALUES {rows(LITERAL_FILES)}) v(path, content))"""
LINES = FILES + """,
lines AS (SELECT path, unnest(l) AS line, generate_subscripts(l, 1)::INT AS line_no FROM (SELECT path, string_split(content, chr(10)) AS l FROM files))"""
IS_TEST = f"""(list_has_any(string_split(lower(path), '/'), {listed(V.TEST_DIRS)}) OR starts_with(lower({NAME}), 'test_')
  OR {' OR '.join(f"suffix(lower({NAME}), {lit(s)})" for s in V.TEST_NAME_SUFFIXES)} OR {has('lower(content)', V.TEST_VALUES)})"""
HAS_CARD = f"""len(list_intersect(list_transform(regexp_extract_all(content, {lit(V.FOUR_GROUPS)}), lambda x: regexp_replace(x, '[\\s-]', '', 'g')), {listed(V.PAYMENT_TEST_CARDS)})) > 0"""
_SPECIAL = {
    "phone_number": r"list_concat(list_concat(regexp_extract_all(line, '\b\d{3}-\d{3}-\d{4}\b'), regexp_extract_all(line, '(?:^|\W)(\(\d{3}\)\s?\d{3}-\d{4})(?:\W|$)', 1)), regexp_extract_all(line, '\b\d{10}\b'))",
    "uk_phone": r"regexp_extract_all(line, '(?:^|\W)((?:\+44|0)\d{10})(?:\W|$)', 1)",
}
LUHN = "list_sum(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * substr(m, len(m) - i + 1, 1)::INT) % 10 + (2 * substr(m, len(m) - i + 1, 1)::INT) // 10 ELSE substr(m, len(m) - i + 1, 1)::INT END)) % 10 = 0"
DIGITS = r"regexp_replace(m, '[\s-]', '', 'g')"


def pii_cte(names=None) -> str:
    parts = [numbered("pl", _SPECIAL.get(n, matches(p)), f"{d} AS det, {lit(n)} AS name") for d, (n, p, _) in enumerate(V.PII) if names is None or n in names]
    ok = f"""CASE name WHEN 'credit_card' THEN len(m) IN (13, 14, 15, 16, 19) AND ({LUHN} OR m IN {rows([V.TEST_CARDS])})
      WHEN 'us_ssn' THEN NOT has_key AND {DIGITS} NOT IN {rows([V.TEST_SSNS])} AND substr({DIGITS}, 1, 3) NOT IN ('000', '666') AND substr({DIGITS}, 1, 1) <> '9' AND substr({DIGITS}, 4, 2) <> '00' AND substr({DIGITS}, 6, 4) <> '0000'
      WHEN 'email_address' THEN NOT has_key AND NOT ({' OR '.join(f"suffix(lower(m), {lit(s)})" for s in V.BENIGN_EMAIL_SUFFIXES)} OR {' OR '.join(f"starts_with(lower(m), {lit(s)})" for s in V.BENIGN_EMAIL_PREFIXES)})
      WHEN 'ip_address' THEN NOT ({' OR '.join(f"starts_with(m, {lit(s)})" for s in V.BENIGN_IP_PREFIXES)})
      WHEN 'india_aadhaar' THEN {DIGITS} NOT IN {rows([V.AADHAAR_PLACEHOLDERS])} AND NOT has_card ELSE true END"""
    return (
        LINES
        + f""",
pl AS (SELECT l.*, f.is_test, f.has_key, f.has_card FROM lines l JOIN (SELECT path, {IS_TEST} AS is_test, {rx('content', V.ERROR_TRACKER_KEY)} AS has_key, {HAS_CARD} AS has_card FROM files) f USING (path)),
pii_raw AS ({' UNION ALL '.join(parts)}),
pii_ok AS (SELECT *, CASE WHEN name = 'credit_card' THEN {case('substr(m, 1, 1)', V.CARD_BRANDS)} ELSE name END AS pattern_type,
  CASE WHEN name = 'credit_card' AND m IN {rows([V.TEST_CARDS])} THEN 0.98::DOUBLE ELSE 0.95::DOUBLE END AS sure FROM pii_raw WHERE {ok})"""
    )


ARTIFACT = has("lower(path)", (V.OUTPUT_DIR, *V.ARTIFACT_PARTS))
DEFINED = f"""((list_has_any(string_split(lower(path), '/'), {listed(V.SCANNER_DIRS)}) OR {has(f'lower({NAME})', V.SCANNER_NAME_PARTS)} OR {ARTIFACT} OR {has('lower(path)', V.CONFIG_PARTS)}) AND {has('lower(line)', V.DEFINITION_WORDS)})"""
BASE_SEVERITY = case("name", {n: s for n, _, s in V.PII})


def fid(*parts: str) -> str:
    return f"substr(sha256({" || '|' || ".join(parts)}), 1, 12)"


PII = (
    pii_cte()
    + f""",
pii AS (SELECT {fid("'privacy'", 'pattern_type', 'path', 'line_no', 'k')} AS id,
  CASE WHEN {DEFINED} OR {ARTIFACT} THEN 'low' WHEN is_test AND {BASE_SEVERITY} = 'high' THEN 'medium' WHEN is_test AND {BASE_SEVERITY} = 'medium' THEN 'low' ELSE {BASE_SEVERITY} END AS severity,
  path AS file_path, line_no AS line_number, {case('pattern_type', V.PII_TITLES)} AS title, '[REDACTED — ' || len(m) || '-char value]' AS description,
  CASE WHEN {DEFINED} THEN 0.1::DOUBLE WHEN {ARTIFACT} THEN 0.05::DOUBLE ELSE sure END AS confidence,
  CASE WHEN is_test THEN {lit(V.PII_TEST_REMEDIATION)} ELSE {case('pattern_type', V.PII_REMEDIATION, V.PII_OTHER_REMEDIATION.join("''"))} END AS remediation, pattern_type, det, k FROM pii_ok)"""
)
RANK = lambda c: case(c, V.SEVERITY_RANK, 0)
CONSOLIDATED = (
    PII
    + f""",
pii_group AS (SELECT file_path, line_number, count(*) AS n, max(confidence) AS confidence, list(pattern_type ORDER BY det, k, pattern_type) AS all_types,
  arg_min({{'id': id, 'severity': severity, 'title': title, 'description': description, 'remediation': remediation, 'pattern_type': pattern_type}}, ({RANK('severity')} * -1000000 + det * 10000 + k)) AS f FROM pii GROUP BY ALL),
pii_types AS (SELECT *, list_filter(all_types, lambda x, i: list_position(all_types, x) = i) AS types FROM pii_group),
pii_one AS (SELECT f.id AS id, f.severity AS severity, file_path, line_number,
  CASE WHEN n > 1 THEN 'Multiple PII patterns at this location (' || len(types) || '): ' || array_to_string(list_transform(types, lambda t: {case('t', V.PII_TITLES)}), ', ') ELSE f.title END AS title,
  CASE WHEN n > 1 THEN len(types) || ' detectors fired on one line: ' || array_to_string(types, ', ') ELSE f.description END AS description,
  confidence, f.remediation AS remediation, f.pattern_type AS pattern_type, CASE WHEN n > 1 THEN array_to_string(types, ',') END AS pii_types, CASE WHEN n > 1 THEN n::INT END AS consolidated_from FROM pii_types)"""
)
COMMENT = r"regexp_matches(line, '^\s*(?:#|//|/\*)')"
TITLES = lambda kinds: {k: k.replace("_", " ").title() for k in kinds}


def any_pattern(patterns) -> str:
    return "(" + " OR ".join(rx("line", p) for p in patterns) + ")"


AUTH_RAW = " UNION ALL ".join(f"SELECT path, line_no, line, {lit(k)} AS kind, {lit(s)} AS severity, {c}::DOUBLE AS confidence FROM lines WHERE len(line) <= {V.LONGEST_LINE} AND NOT {COMMENT} AND {any_pattern(p)}" for k, s, c, p in V.AUTH)
VALID_RAW = " UNION ALL ".join(
    f"SELECT path, line_no, line, {lit(k)} AS kind, {lit(s)} AS severity, {c}::DOUBLE AS confidence FROM lines WHERE len(line) <= {V.LONGEST_LINE} AND {any_pattern(p)}" + (f" AND NOT {rx('line', V.SAFE_WRAPPER, '')}" if k == "xss_risk" else "") for k, s, c, p in V.VALIDATION
)


def security(source: str, detector: str, title: str, kinds) -> str:
    return f"""SELECT {fid(lit(detector), 'kind', 'path', 'line_no', "1")} AS id, 'security' AS type, severity, path AS file_path, line_no AS line_number, {lit(title)} || {case('kind', TITLES(kinds))} AS title, 'Matched ' || kind AS description,
  confidence, {case('severity', V.PATTERN_IMPACT)}::DOUBLE AS impact_score, {lit(detector)} AS detected_by, 'Fix ' || kind AS remediation, kind AS pattern_type FROM {source}"""


def shapes(shape_list) -> str:
    return " UNION ALL ".join(numbered("lines", matches(p), f"{lit(n)} AS name, {lit(s)} AS severity") for n, p, s in shape_list)


FILE_TYPE = lambda c: "CASE " + " ".join(f"WHEN regexp_matches({c}, {lit('^(?:' + '|'.join(f'(?:{p})' for p in ps) + ')')}) THEN {lit(k)}" for k, _, ps in V.PATH_RULES) + " ELSE 'unknown' END"
WEIGHT = lambda c: case(c, {k: w for k, w, _ in V.PATH_RULES}, 0.5)
MOD_TESTED = f"(ft IN ('test_file', 'test_fixture') OR list_has_any(string_split(lower(path), '/'), {listed(V.MODERATION_TEST_DIRS)}))"
MOD_OWN = f"({has('lower(path)', V.MODERATION_SCANNER_PARTS)} AND {has('lower(m)', V.MODERATION_DEFINITION_WORDS)})"
MODERATION = f"""
mod_raw AS ({shapes(V.MODERATION)}),
mod AS (SELECT substr(md5(path || ':' || name || ':' || line_no || ':' || k), 1, 8) AS id, 'code_quality' AS type,
  CASE WHEN {MOD_OWN} THEN 'low' WHEN {MOD_TESTED} AND severity = 'high' AND name <> 'hate_speech_indicators' THEN 'medium' ELSE severity END AS severity,
  path AS file_path, line_no AS line_number, 'Content moderation: ' || {case('name', TITLES(n for n, _, _ in V.MODERATION))} AS title, 'Language of kind ' || name AS description,
  CASE WHEN {MOD_OWN} THEN 0.1::DOUBLE WHEN {MOD_TESTED} THEN 0.95::DOUBLE * 0.8::DOUBLE WHEN list_has_any(string_split(lower(path), '/'), {listed(V.EXAMPLE_DIRS)}) THEN 0.95::DOUBLE * 0.6::DOUBLE WHEN ft = 'documentation' THEN 0.95::DOUBLE * 0.7::DOUBLE ELSE 0.95::DOUBLE END AS confidence,
  {case('severity', V.MODERATION_IMPACT)}::DOUBLE AS impact_score, 'ContentModerationScanner' AS detected_by, 'Replace with professional language' AS remediation, name AS pattern_type
  FROM (SELECT *, {FILE_TYPE('path')} AS ft FROM mod_raw))"""
MARK_RAW = " UNION ALL ".join(f"SELECT path, line_no, line, {lit(n)} AS name, {lit(s)} AS severity FROM lines WHERE (contains(line, '#') OR contains(line, '//')) AND regexp_matches(upper(line), {lit(chr(92) + 'b' + n + chr(92) + 'b')})" for n, s in V.MARKERS)


def redacted(text: str) -> str:
    for p, r in V.REDACTIONS:
        text = f"regexp_replace({text}, {lit(p)}, {lit(r)}, 'g')"
    return text


MARK = f"""
mark_raw AS ({MARK_RAW}),
mark_text AS (SELECT *, {redacted('trim(line)')} AS snip FROM mark_raw),
mark AS (SELECT {fid("'marker'", 'name', 'path', 'line_no', '1')} AS id, 'todo' AS type, severity, path AS file_path, line_no AS line_number, name || ' Comment' AS title,
  name || ' comment found: ' || CASE WHEN len(snip) <= 80 THEN snip ELSE substr(snip, 1, 80) || '…' END AS description, 0.9::DOUBLE AS confidence, 0.0::DOUBLE AS impact_score, 'legacy_patterns' AS detected_by, NULL::VARCHAR AS remediation, name AS pattern_type FROM mark_text)"""
_COLUMNS = "id, type, severity, file_path, line_number, title, description, confidence, impact_score, detected_by, remediation, pattern_type"
TOOLS = f"""tools AS (SELECT CASE WHEN pattern_type = 'package_hallucination' THEN 'package_hallucination_x_' || id ELSE id END AS id, type, severity, file_path, line_number::INT AS line_number, title, description, confidence::DOUBLE AS confidence, impact_score::DOUBLE AS impact_score, detected_by, NULL::VARCHAR AS remediation, pattern_type
  FROM (VALUES {rows(Q.TOOL_FINDINGS)}) t(id, type, severity, file_path, line_number, title, description, confidence, impact_score, detected_by, pattern_type))"""
FINDINGS = (
    CONSOLIDATED
    + f""",
auth_raw AS ({AUTH_RAW}), auth AS ({security("(SELECT * FROM auth_raw WHERE suffix(path, '.py'))", 'auth_pattern_analyzer', 'AI Authentication Anti-pattern: ', [k for k, *_ in V.AUTH])}),
valid_raw AS ({VALID_RAW}), valid AS ({security("(SELECT * FROM valid_raw WHERE regexp_matches(path, '" + chr(92) + ".(?:py|js|ts)$'))", 'input_validation_analyzer', 'Input Validation Vulnerability: ', [k for k, *_ in V.VALIDATION])}),
{MODERATION}, {MARK},
secret_raw AS ({shapes(V.SECRETS)}), secret AS ({security('(SELECT path, line_no, severity, name AS kind, 0.7::DOUBLE AS confidence FROM secret_raw WHERE k = 1)', 'SecretsScanner', 'Secret: ', [k for k, *_ in V.SECRETS])}),
{TOOLS},
findings AS (SELECT *, TIMESTAMP '{Q.AS_OF}' - to_days((len(file_path) % 40)::INT) AS detected_at FROM (
  SELECT id, 'privacy' AS type, severity, file_path, line_number, title, description, confidence, 0.0::DOUBLE AS impact_score, 'privacy_detector' AS detected_by, remediation, pattern_type FROM pii_one
  UNION ALL SELECT {_COLUMNS} FROM auth UNION ALL SELECT {_COLUMNS} FROM valid UNION ALL SELECT {_COLUMNS} FROM mod UNION ALL SELECT {_COLUMNS} FROM mark UNION ALL SELECT {_COLUMNS} FROM secret UNION ALL SELECT {_COLUMNS} FROM tools))"""
)
SHORT = "id, type, severity, file_path, line_number, title, confidence, impact_score, detected_by, pattern_type"
TIES = "file_path, line_number NULLS LAST, detected_by, pattern_type, id"
CAP_ORDER = f"{RANK('severity')} DESC, {case('type', V.TYPE_CAP_RANK, 0)} DESC, confidence DESC, coalesce(impact_score, 0) DESC, line_number NULLS LAST, detected_by, pattern_type, id"
CONFIDENT = f"(severity = 'critical' OR confidence >= {case('type', V.TYPE_CONFIDENCE, V.OTHER_CONFIDENCE)})"
PRIORITY = "(type IN ('security', 'privacy', 'analysis_error') OR (type = 'code_quality' AND severity = 'critical'))"
PACKAGE = """CASE WHEN contains(title, 'Package Hallucination:') THEN trim(split_part(title, 'Package Hallucination:', 2)) WHEN contains(id, 'package_hallucination_') THEN CASE WHEN len(string_split(id, '_')) >= 4 THEN array_to_string(string_split(id, '_')[3:-2], '_') ELSE split_part(id, '_', 3) END END"""
INTERNAL = f"(contains(id, 'package_hallucination') AND coalesce(regexp_matches({PACKAGE}, '^(?:project\\..*|\\..*|src\\..*|tests?\\..*)'), false))"
STYLE = f"(detected_by = 'pylint' AND {has("(title || ' ' || description)", V.STYLE_CODES)})"
CRITICAL = "severity IN ('critical', 'high')"
_ANY = lambda low, groups: " ".join(f"WHEN {has(low, w)} THEN {s}" for w, s in groups)
SCORED = (
    FINDINGS
    + f""",
typed AS (SELECT *, {FILE_TYPE('file_path')} AS file_type, count(*) OVER (PARTITION BY file_path) - 1 AS others FROM findings),
weighed AS (SELECT *, {WEIGHT('file_type')}::DOUBLE AS w FROM typed),
factors AS (SELECT *, {case('severity', V.SEVERITY_SCORE, 0.5)}::DOUBLE AS severity_score, {case('type', V.TYPE_SCORE, 0.5)}::DOUBLE AS type_score,
  CASE WHEN file_type = 'source_code' THEN CASE {' '.join(f"WHEN {has('lower(file_path)', ws)} THEN least(w + {b}, 1.0)" for ws, b in V.SOURCE_BOOSTS)} ELSE w END WHEN file_type = 'configuration' THEN least(w + 0.1, 0.8) ELSE w END AS file_score,
  CASE WHEN date_diff('microsecond', detected_at, TIMESTAMP '{Q.AS_OF}') < 86400000000 THEN 0.9 WHEN date_diff('microsecond', detected_at, TIMESTAMP '{Q.AS_OF}') < 7 * 86400000000 THEN 0.7 WHEN date_diff('microsecond', detected_at, TIMESTAMP '{Q.AS_OF}') < 30 * 86400000000 THEN 0.5 ELSE 0.3 END::DOUBLE AS temporal,
  CASE WHEN others >= 5 THEN 0.1 WHEN others >= 3 THEN 0.05 WHEN others >= 1 THEN 0.02 ELSE 0.0 END::DOUBLE AS cluster_boost FROM weighed),
scored AS (SELECT *, round(least(greatest(severity_score * 0.30::DOUBLE + confidence * 0.20::DOUBLE + impact_score * 0.15::DOUBLE + type_score * 0.10::DOUBLE + file_score * 0.20::DOUBLE + temporal * 0.05::DOUBLE + cluster_boost, 0), 1), 6) AS ranking_score FROM factors)"""
)
RANK_ORDER = f"ranking_score DESC, {TIES}"
FILE_SCORES = FINDINGS + f""",
scores AS (SELECT file_path, count(*) AS issues, count(*) FILTER ({CRITICAL}) AS critical_issues, 3 * count(*) FILTER ({CRITICAL}) + count(*) AS score FROM findings GROUP BY file_path)"""
BLOCK = case("type", V.TYPE_BLOCK, "'other'")
BLOCKS = FINDINGS + f""",
placed AS (SELECT *, {BLOCK} AS block, row_number() OVER (PARTITION BY {BLOCK} ORDER BY (severity <> 'critical')::INT, (NOT starts_with(title, 'Syntax Error'))::INT, {TIES}) AS place, count(*) OVER (PARTITION BY {BLOCK}) AS n FROM findings WHERE {CRITICAL})"""
VULN = "CASE " + " ".join(f"WHEN {has("lower(title || chr(10) || description)", w)} THEN {lit(n)}" for n, w in V.VULNERABILITY_WORDS) + f" ELSE {lit(V.OTHER_VULNERABILITY)} END"
CATEGORY = "CASE " + " ".join(f"WHEN {has("lower(concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(detected_by, '')))", w)} THEN {lit(n)}" for n, w in V.CATEGORY_WORDS) + " ELSE type END"
PRIVACY = f"coalesce({case('title', V.PRIVACY_TITLES)}, CASE " + " ".join("WHEN " + " OR ".join("(" + " AND ".join(f"contains(lower(title), {lit(w)})" for w in alt) + ")" for alt in alts) + f" THEN {lit(n)}" for n, alts in V.PRIVACY_WORDS) + " ELSE 'unknown' END)"
MAX_SEVERITY = f"arg_max(severity, {RANK('severity')})"
WIRE = "substr(concat_ws(' | ', type, severity, trim(split_part(title, ':', 1)), CASE WHEN type NOT IN ('security', 'privacy') THEN description END), 1, 4000)"


def _glob(rule: str) -> str:
    """A glob as this engine's own GLOB operator says it; * there stops at slashes, so ** is tried too."""
    return "^" + rule.replace(".", "\\.").replace("*", ".*").replace("?", ".") + "$"


def ignored() -> str:
    tests = []
    for g in Q.GLOBS:
        if g.endswith("/"):
            name = g.strip("/")
            inside = f"(file_path = {lit(name)} OR starts_with(file_path, {lit(name + '/')}))"
            tests.append(inside if g.startswith("/") else f"({inside} OR contains('/' || file_path || '/', {lit('/' + name + '/')}))")
        else:
            tests.append(f"(regexp_matches(file_path, {lit(_glob(g))}) OR len(list_filter(string_split(file_path, '/'), lambda c: regexp_matches(c, {lit(_glob(g))}))) > 0)")
    return "(" + " OR ".join(tests) + f" OR coalesce(pattern_type IN {rows([Q.TYPES])} OR detected_by || '.' || pattern_type IN {rows([Q.TYPES])}, false))"


def _excluded() -> str:
    tests = []
    for r in Q.EXCLUDES:
        if r.endswith("/"):
            tests.append(f"contains('/' || path || '/', {lit('/' + r)})")
        elif "*" in r:
            tests.append(f"regexp_matches(path, {lit(_glob(r)[:-1])} || '$')")
        elif "/" not in r:
            tests.append(f"{NAME} = {lit(r)}")
        else:
            tests.append(f"contains(path, {lit(r)})")
    return "(" + " OR ".join(tests) + ")"


def with_(cte: str, select: str) -> str:
    return f"WITH {cte}\n{select}"


def _pii_counts(*names: str) -> str:
    return with_(pii_cte(names), """SELECT path, line_no, name, count(*) AS raw_matches, coalesce(any_value(o.kept), 0)::BIGINT AS kept, any_value(o.pattern_type) AS pattern_type, any_value(o.confidence) AS confidence
FROM pii_raw r LEFT JOIN (SELECT path, line_no, name, count(*) AS kept, min(pattern_type) AS pattern_type, max(sure) AS confidence FROM pii_ok GROUP BY ALL) o USING (path, line_no, name) GROUP BY path, line_no, name""")


def _framework_rules(rules: dict) -> str:
    out = [(k, language, *rule) for k, (language, rule) in enumerate((lang, r) for lang in ("python", "typescript", "javascript") for r in rules.get(lang, ()))]
    return rows(out)


LANG = "(CASE WHEN {e} IN ('.py', '.pyi') THEN ['python'] WHEN {e} IN ('.js', '.mjs', '.cjs', '.jsx') THEN ['javascript'] WHEN {e} IN ('.ts', '.tsx') THEN ['typescript', 'javascript'] ELSE [] END)".format(e=EXT)
_ESC = r"regexp_replace(module, '([^A-Za-z0-9_])', '\\\1', 'g')"
IMPORTED = rf"""(module = '' OR regexp_matches(substr(content, 1, 65536), '(?m)^\s*import\s+' || {_ESC} || '\b|(?m)^\s*from\s+' || {_ESC} || '(?:\.|\s+import\b)|require\([''"]' || {_ESC} || '(?:/[^''"]*)?[''"]\)|from\s+[''"]' || {_ESC} || '(?:/[^''"]*)?[''"]'))"""
HOLDS = "(CASE WHEN starts_with(pattern, 'regex:') THEN regexp_matches({t}, substr(pattern, 7)) ELSE contains({t}, pattern) END)"
ENTRY = f"""
rules AS (SELECT * FROM (VALUES {_framework_rules(R.ENTRY_POINTS)}) v(k, language, kind, framework, module, pattern, mult)),
entry AS (SELECT path, arg_min(kind, o) AS kind, arg_min(framework, o) AS framework, arg_min(mult, o)::DOUBLE AS multiplier FROM (
  SELECT f.path, r.*, -round(abs(mult - 1), 6) * 1000000 + (mult <= 1)::INT * 1000 + k AS o FROM files f JOIN rules r ON list_contains({LANG}, language) AND {HOLDS.format(t='substr(content, 1, 65536)')} AND {IMPORTED}) GROUP BY path)"""
SINK = f"""
sink_rules AS (SELECT * FROM (VALUES {_framework_rules(R.SINKS)}) v(k, language, kind, framework, module, pattern, bump, needs)),
code AS (SELECT l.path, l.line_no, l.line, f.content FROM lines l JOIN files f USING (path) WHERE len({LANG.replace('path', 'l.path')}) > 0),
sinks AS (SELECT path, line_no, arg_min(kind, o) AS kind, arg_min(framework, o) AS framework, arg_min(bump, o)::INT AS bump FROM (
  SELECT c.path, c.line_no, r.*, -bump * 1000 + k AS o FROM code c JOIN sink_rules r ON list_contains({LANG}, language) AND contains(line, pattern) AND contains(line, ltrim(needs, '!')) AND {IMPORTED}) GROUP BY path, line_no)"""
VERSIONS = f"""old AS (SELECT * FROM files WHERE NOT suffix(path, '7.txt')), new AS (SELECT path, CASE WHEN suffix(path, '1.py') THEN content || chr(10) || 'edited # TODO' ELSE content END AS content FROM files WHERE NOT suffix(path, '2.md')),
diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.content <> n.content)"""
LADDER = "['info', 'low', 'medium', 'high', 'critical']"
_TOOL_ROWS = (
    ("B105", "src/a.py", 3, 4, "security", "medium", "Possible hardcoded password", "Possible hardcoded password", 0.7, "bandit"), ("B602", "src/b.py", 9, None, "security", "critical", "shell=True", "shell=True", 0.9, "bandit"),
    ("B303", "src/id.py", 1, 0, "security", "high", "Use of insecure MD5", "Use of insecure MD5", 0.65, "bandit"), ("E0602", "src/a.py", 3, 1, "code_quality", "high", "undefined-variable", "Undefined variable", 0.75, "pylint"),
    ("C0301", "src/a.py", 4, 0, "code_quality", "low", "line-too-long", "Line too long", 0.6, "pylint"), ("W0612", "tests/test_a.py", 6, 2, "code_quality", "medium", "unused-variable", "assert_used", 0.7, "pylint"),
)
TOOL_ROWS = f"""tool_rows AS (SELECT detected_by || '-' || rule || '-' || substr(sha256(detected_by || '|' || rule || '|' || file_path || '|' || line_number || '|' || coalesce(col::VARCHAR, 'None')), 1, 12) AS id, type, severity, file_path, line_number::INT AS line_number, title, description,
  confidence::DOUBLE AS confidence, 0.0::DOUBLE AS impact_score, detected_by, rule AS pattern_type FROM (VALUES {rows(_TOOL_ROWS)}) v(rule, file_path, line_number, col, type, severity, title, description, confidence, detected_by))"""
FNAME = "lower(regexp_extract(file_path, '[^/]*$'))"
TEST_FILE = f"(starts_with({FNAME}, 'test_') OR suffix({FNAME}, '_test.py') OR {FNAME} = 'conftest.py' OR contains(lower(file_path), '/fixtures/') OR contains(lower(file_path), '/__tests__/'))"
TESTED = f"({FILE_TYPE('file_path')} IN ('test_file', 'test_fixture'))"
STEP_ONE = f"CASE WHEN detected_by = 'bandit' AND contains(lower(description), 'md5') AND contains(lower(file_path), 'id') THEN 'low' WHEN {TESTED} AND severity = 'critical' THEN 'high' WHEN {TESTED} AND severity = 'high' THEN 'medium' ELSE severity END"
REVIEW = f"""rows AS (SELECT 'chat/' || conv_id || '/' || turn || '.txt' AS file, turn::INT AS line, CASE WHEN turn % 5 <> 4 THEN role END AS title, len(text)::VARCHAR AS description,
  {listed(('critical', 'high', 'medium', 'low', 'info', 'medium'))}[conv_id % 6 + 1] AS severity, {listed(('security', 'privacy', 'code_quality', 'performance', 'architecture', 'todo', 'code_quality'))}[conv_id % 7 + 1] AS type,
  CASE WHEN turn % 3 <> 0 THEN greatest(least((conv_id % 15)::DOUBLE / 10, 1), 0) ELSE 0.7 END AS confidence FROM conversations)"""

KEPT = f"""SELECT * EXCLUDE (detected_at), TIMESTAMP '{Q.AS_OF}' AS detected_at FROM (SELECT *, {PRIORITY} AS pr, row_number() OVER (PARTITION BY file_path, {PRIORITY} ORDER BY {CAP_ORDER}) AS p FROM findings
  WHERE id NOT IN (SELECT id FROM tools) AND NOT ({FILE_TYPE('file_path')} = 'build_output' OR {has('lower(file_path)', V.EXCLUDED_PARTS)}) AND NOT {ignored()} AND {CONFIDENT} AND NOT {INTERNAL} AND NOT {STYLE}) WHERE p <= CASE WHEN pr THEN 150 ELSE 15 END"""
FAMILY_TABLES = {"pii": "(SELECT 'privacy' AS type FROM pii_one)", "auth": "auth", "validation": "valid", "moderation": "mod", "markers": "mark", "secrets": "secret"}
SECRET = f"(type = 'privacy' OR {has("lower(concat_ws(' ', title, pattern_type))", ('hardcoded password', 'hardcoded_secret', 'secret:', 'hardcoded secret'))})"
# the one character of compatibility that descriptions hold is the mark of what was cut
PLAIN = "replace(description, '…', '...')"

ORACLES: dict[str, str] = {
    "path_exclude": with_(FILES, f"SELECT path, {_excluded()} AS excluded, ({FILE_TYPE('path')} = 'build_output' OR {has('lower(path)', V.EXCLUDED_PARTS)}) AS artifact FROM files"),
    "file_index_by_ext": with_(FILES, f"SELECT {EXT} AS ext, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM files GROUP BY 1"),
    "doc_lines": with_(LINES, "SELECT path, count(*) AS n_lines, sum(len(line))::BIGINT AS chars, max(len(line))::INT AS longest FROM lines GROUP BY path"),
    "size_cutoff": with_(FILES, "SELECT path, strlen(content)::BIGINT AS size FROM files WHERE strlen(content) <= 4096"),
    "ext_allowlist": with_(FILES, f"SELECT {EXT} AS ext, lower(split_part(path, '/', 1)) AS top, count(*) AS n FROM files WHERE {EXT} IN ('.py', '.js', '.ts', '.yaml') GROUP BY ALL"),
    "ignore_rules": "SELECT * FROM (VALUES ('glob', 'build/'), ('type', 'weak_jwt'), ('type', 'spaced'), ('glob', '*.tmp'), ('glob', '/anchored'), ('glob', 'indented.py')) v(kind, rule)",
    "normalize_path": with_(FILES, "SELECT '/work/project/' || path AS raw, path FROM files UNION ALL SELECT * FROM (VALUES ('./a/b.py', 'a/b.py'), ('c\\d.py', 'c/d.py'), ('/else/e.py', '/else/e.py'), ('.env', '.env')) v(raw, path)"),
    "pii_credit_card": _pii_counts("credit_card"), "pii_ssn": _pii_counts("us_ssn"), "pii_email": _pii_counts("email_address"), "pii_phone": _pii_counts("phone_number"), "pii_ip": _pii_counts("ip_address"),
    "pii_intl": _pii_counts(*(n for n, _, _ in V.PII[5:])),
    "test_context": with_(FILES, f"SELECT path, {IS_TEST} AS is_test FROM files"),
    "pii_suppression": with_(PII, "SELECT file_path, severity, confidence, count(*) AS n FROM pii GROUP BY ALL"),
    "pii_mask": with_(PII, "SELECT pattern_type, description AS mask, count(*) AS n FROM pii GROUP BY ALL"),
    "pii_consolidated": with_(CONSOLIDATED, "SELECT id, severity, file_path, line_number, title, confidence, pattern_type, pii_types, consolidated_from FROM pii_one"),
    "pii_titles": with_(PII, "SELECT pattern_type, title, remediation, count(*) AS n FROM pii GROUP BY ALL"),
    "auth_hardcoded_secrets": with_(LINES, f"SELECT path, line_no, kind FROM ({AUTH_RAW}) WHERE kind = 'hardcoded_secrets'"),
    "auth_patterns": with_(FINDINGS, f"SELECT {SHORT} FROM auth"),
    "input_validation": with_(FINDINGS, f"SELECT {SHORT} FROM valid"),
    "redact_snippet": with_(FINDINGS, r"""SELECT file_path, line_number, pattern_type, sha256(s) AS snippet_sha, len(s)::INT AS snippet_length FROM (SELECT path AS file_path, line_no AS line_number, kind AS pattern_type, CASE WHEN len(t) <= 200 THEN t ELSE substr(t, 1, 200) || '…' END AS s FROM (
  SELECT *, CASE WHEN kind = 'hardcoded_secrets' THEN regexp_replace(trim(line), '(["''])([^"'']+)(["''])', '\1<REDACTED>\3', 'g') ELSE trim(line) END AS t FROM auth_raw WHERE suffix(path, '.py')))"""),
    "secret_shapes": with_(LINES, f"SELECT path, line_no, name, count(*) AS n, sum(len(m))::BIGINT AS chars FROM ({shapes(V.SECRETS)}) GROUP BY ALL"),
    "obfuscation": with_(LINES, f"SELECT path, line_no, name, count(*) AS n, sum(len(m))::BIGINT AS chars FROM ({shapes(V.OBFUSCATION)}) GROUP BY ALL"),
    "moderation_hits": with_(LINES, f"SELECT path, line_no, name, count(*) AS n FROM ({shapes(V.MODERATION)}) GROUP BY ALL"),
    "moderation_context": with_(LINES + "," + MODERATION, "SELECT id, severity, file_path, line_number, pattern_type, round(confidence, 6) AS confidence, impact_score FROM mod"),
    "todo_markers": with_(LINES, f"SELECT path, line_no, name, severity FROM ({MARK_RAW})"),
    "unknown_imports": with_(LINES, rf"""SELECT path, line_no, module FROM (SELECT path, line_no, coalesce(nullif(regexp_extract(line, '^\s*import\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''), nullif(regexp_extract(line, '^\s*from\s+([A-Za-z_][A-Za-z0-9_]*)[A-Za-z0-9_.]*\s+import\b', 1), '')) AS module FROM lines WHERE suffix(path, '.py')) WHERE module NOT IN {rows([Q.CATALOG])}"""),
    "js_patterns": with_(LINES, " UNION ALL ".join(f"SELECT path, line_no, {lit(n)} AS name, {lit(s)} AS severity FROM lines WHERE {EXT} IN {rows([tools.JS_ENDINGS])} AND {rx('line', p, '')}" for n, s, p in tools.JS_PATTERNS)),
    "js_findings": with_(LINES, f"""SELECT {fid(lit('javascript'), 'name', 'path', 'line_no', "1")} AS id, type, severity, path AS file_path, line_no AS line_number, 'JavaScript: ' || name AS title, {tools.JS_CONFIDENCE}::DOUBLE AS confidence, {case('severity', tools.JS_IMPACT, 0.2)}::DOUBLE AS impact_score, 'javascript_patterns' AS detected_by, name AS pattern_type FROM (
  SELECT path, line_no, name, type, CASE WHEN type = 'security' AND tested THEN {case('severity', tools.ONE_LOWER)} ELSE severity END AS severity FROM (SELECT *, {case('name', tools.JS_TYPES, lit('security'))} AS type,
    list_has_any(string_split(lower(path), '/'), {listed(V.TEST_DIRS)}) OR starts_with(lower(regexp_extract(path, '[^/]*$')), 'test_') OR {' OR '.join(f"suffix(lower(path), {lit(x)})" for x in V.TEST_NAME_SUFFIXES)} AS tested FROM (
    {' UNION ALL '.join(f"SELECT path, line_no, {lit(n)} AS name, {lit(s)} AS severity FROM js_lines WHERE {EXT} IN {rows([tools.JS_ENDINGS])} AND {rx('line', p, '')}" for n, s, p in (*tools.JS_PATTERNS, tools.GENERIC_KEY, tools.MANY_PARAMETERS))})))""".replace("FROM js_lines", f"FROM (SELECT path, line_no, line FROM lines UNION ALL SELECT * FROM (VALUES {rows(Q.JS_LINES)}) v(path, line_no, line)) j")),
    "rule_findings": with_(LINES, f"""SELECT {fid(lit('rules'), 'name', 'path', 'line_no', "1")} AS id, 'security' AS type, 'medium' AS severity, path AS file_path, line_no AS line_number, 'Code rule: ' || replace(split_part(name, '.', 2), '_', ' ') AS title, 0.65::DOUBLE AS confidence, 0.7::DOUBLE AS impact_score, 'code_rules' AS detected_by, name AS pattern_type FROM (
    {' UNION ALL '.join(f"SELECT path, line_no, {lit(n)} AS name FROM code_lines WHERE {EXT} IN {rows([ends])} AND {rx('line', p, '')}" + (f" AND NOT {rx('line', unless, '')}" if unless else '') for n, ends, p, unless in tools.CODE_RULES)})""".replace("FROM code_lines", f"FROM (SELECT path, line_no, line FROM lines UNION ALL SELECT * FROM (VALUES {rows(Q.RULE_LINES)}) v(path, line_no, line)) c")),
    "flagship": with_(FINDINGS + f", kept AS ({KEPT})" + SCORED[len(FINDINGS) :].replace("FROM findings)", "FROM kept)"), f"SELECT id, type, severity, file_path, line_number, title, confidence, detected_by, ranking_score FROM scored ORDER BY {RANK_ORDER} LIMIT 20"),
    "scan_modes": with_(FINDINGS, " UNION ALL ".join(f"SELECT {lit(mode)} AS mode, type, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT type FROM {FAMILY_TABLES[f]}' for f in families)}) GROUP BY type" for mode, families in detect.MODES.items())),
    "sanitized": with_(FINDINGS, f"""SELECT id, type, md5(CASE WHEN type = 'privacy' THEN 'Personal data detected (value redacted)' WHEN {SECRET} THEN 'Credential (value redacted)' ELSE {redacted(PLAIN)} END) AS description,
  NOT (detected_by IN ('auth_pattern_analyzer', 'input_validation_analyzer', 'SecretsScanner') AND NOT {SECRET}) AS no_snippet FROM findings"""),
    "js_metrics": r"""SELECT 'web/' || page_id || '.html' AS path, len(string_split(h, chr(10)))::BIGINT AS loc, len(regexp_extract_all(h, '\bfunction\b|=>'))::BIGINT AS functions, len(regexp_extract_all(h, '\bclass\s+[A-Za-z_]'))::BIGINT AS classes,
  len(regexp_extract_all(h, '(?m)^\s*import\b|\brequire\s*\('))::BIGINT AS imports, len(regexp_extract_all(h, '\b(?:if|for|while|case|catch)\b|\?\s|&&|\|\|'))::BIGINT AS branches FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)""",
    "weak_crypto": with_(LINES, rf"SELECT path, line_no FROM lines WHERE suffix(path, '.py') AND {rx('line', tools.WEAK_HASH, '')} AND NOT regexp_matches(line, 'usedforsecurity\s*=\s*False')"),
    "normalize_tool_rows": with_(TOOL_ROWS, f"SELECT {SHORT} FROM tool_rows"),
    "tool_filters": with_(TOOL_ROWS + ", " + TOOLS, f"""SELECT id, ({has('lower(title)', V.STYLE_TITLES)} OR ({TEST_FILE} AND {has("lower(title || chr(10) || description)", V.TEST_NOISE)})) AS noise,
  CASE WHEN type = 'code_quality' AND {has('lower(title)', V.STYLE_WORDS)} AND {STEP_ONE} = 'medium' THEN 'low' ELSE {STEP_ONE} END AS adjusted_severity FROM (SELECT {SHORT}, description FROM tool_rows UNION ALL SELECT {SHORT}, description FROM tools)"""),
    "category_topk": with_(FINDINGS, f"SELECT {SHORT} FROM (SELECT *, row_number() OVER (PARTITION BY pattern_type ORDER BY {RANK('severity')} DESC, confidence DESC, file_path, line_number NULLS LAST, id) AS p FROM findings) WHERE p <= 20 AND confidence >= 0.80"),
    "detector_cap": with_(FINDINGS, f"SELECT {SHORT} FROM (SELECT *, row_number() OVER (PARTITION BY detected_by ORDER BY (severity <> 'critical')::INT, {RANK('severity')} DESC, confidence DESC, file_path, line_number NULLS LAST, pattern_type, id) AS p FROM findings) WHERE p <= 1000 OR severity = 'critical'"),
    "dead_symbols": f"""WITH words AS (SELECT {PATH_SQL} AS path, doc_id::INT AS line, regexp_extract_all(text, '[A-Za-z_]+') AS w FROM documents WHERE text IS NOT NULL),
defs AS (SELECT path, line, w[1] AS name FROM words WHERE len(w) > 0), uses AS (SELECT DISTINCT unnest(w[2:]) AS name FROM words),
dead AS (SELECT * FROM defs WHERE name NOT IN (SELECT name FROM uses) AND NOT (lower(name) IN {rows([graph.ENTRY_NAMES])} OR {' OR '.join(f'starts_with(name, {lit(p)})' for p in graph.NAME_PREFIXES)} OR {has('lower(path)', graph.PATH_PARTS)} OR contains(lower(name), 'command') OR suffix(name, '_cmd')))
SELECT path, line, name FROM dead WHERE (SELECT count(*) FROM dead) > 15 ORDER BY path, line, name LIMIT 10""",
    "topk_largest_docs": with_(FILES, "SELECT path, strlen(content)::BIGINT AS size FROM files ORDER BY size DESC, path LIMIT 100"),
    "pairwise_mismatch": """WITH g AS (SELECT n_name AS name, (s_suppkey % 4)::VARCHAR AS detail, min((s_name, s_suppkey::INT)) AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT a.name, a.f[1] AS path_a, a.f[2] AS line_a, a.detail AS detail_a, b.f[1] AS path_b, b.f[2] AS line_b, b.detail AS detail_b FROM g a JOIN g b ON a.name = b.name AND a.detail < b.detail""",
    "taint_reach": """WITH RECURSIVE e AS (SELECT DISTINCT (n_nationkey % 13)::INT AS src, (n_nationkey * 7 % 17)::INT AS dst FROM nation),
r AS (SELECT 1 AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 20) SELECT node, min(depth) AS depth FROM r GROUP BY node""",
    "file_classify": with_(FILES, f"""SELECT file_path, ft AS file_type, {WEIGHT('ft')}::DOUBLE AS file_weight, ft = 'source_code' AS is_production, CASE WHEN ft = 'source_code' THEN 'HIGH' WHEN ft IN ('test_file', 'test_fixture', 'build_output', 'documentation') THEN 'LOW' ELSE 'MEDIUM' END AS file_priority
FROM (SELECT file_path, {FILE_TYPE('file_path')} AS ft FROM (SELECT path AS file_path FROM files UNION ALL SELECT unnest(['setup.py', 'src/a/b/c.tsx', 'README', 'tests/fixtures/x.txt', 'a/__tests__/b.js', 'vite.config.ts', 'Upper/x.py', 'main.go', 'dist/app.js', '.git/config', 'x.d.ts', 'web/app.spec.ts', 'my/.next/a.js', 'data.bin', 'cypress/a.ts'])))"""),
    "file_type_summary": with_(FILES, f"SELECT {FILE_TYPE('path')} AS file_type, count(*) AS n FROM files GROUP BY 1"),
    "framework_entry_points": with_(FILES + "," + ENTRY, "SELECT path, kind, framework, multiplier FROM entry"),
    "framework_sinks": with_(LINES + "," + SINK, "SELECT path, line_no, kind, framework, bump FROM sinks"),
    "severity_adjust": with_(FINDINGS + "," + ENTRY + "," + SINK, f"""SELECT id, file_path, line_number, severity, {LADDER}[least(greatest(r + CASE WHEN multiplier >= 1.5 THEN 1 WHEN multiplier <= 0.6 THEN -1 ELSE 0 END, 0), 4) + 1] AS adjusted_severity FROM (
  SELECT a.*, e.multiplier, least({RANK('severity')} + coalesce(s.bump, 0), 4) AS r FROM (SELECT {SHORT} FROM valid UNION ALL SELECT {SHORT} FROM auth) a LEFT JOIN sinks s ON s.path = a.file_path AND s.line_no = a.line_number LEFT JOIN entry e ON e.path = a.file_path)"""),
    "findings_union": with_(FINDINGS, "SELECT detected_by, type, severity, count(*) AS n FROM findings GROUP BY ALL"),
    "findings_all": with_(FINDINGS, f"SELECT {SHORT} FROM findings"),
    "ignore_filter": with_(FINDINGS, f"SELECT id, file_path, detected_by, pattern_type FROM findings WHERE NOT {ignored()}"),
    "noise_confidence": with_(FINDINGS, f"SELECT type, severity, count(*) AS n FROM findings WHERE {CONFIDENT} GROUP BY ALL"),
    "noise_internal_and_style": with_(TOOLS, f"SELECT id, coalesce({PACKAGE}, '') AS package, {INTERNAL} AS internal, {STYLE} AS style FROM tools"),
    "noise_per_file_cap": with_(FINDINGS, f"SELECT id, file_path, type, severity FROM (SELECT *, {PRIORITY} AS pr, row_number() OVER (PARTITION BY file_path, {PRIORITY} ORDER BY {CAP_ORDER}) AS p FROM findings) WHERE p <= CASE WHEN pr THEN 150 ELSE 15 END"),
    "noise_stats": with_(FINDINGS, f"""SELECT count(*) AS original, count(*) FILTER (s = 'confidence') AS dropped_confidence, count(*) FILTER (s = 'internal') AS dropped_internal, count(*) FILTER (s = 'style') AS dropped_style, count(*) FILTER (s = 'passed' AND p > lim) AS dropped_cap, count(*) FILTER (s = 'passed' AND p <= lim) AS kept,
  round((count(*) - count(*) FILTER (s = 'passed' AND p <= lim))::DOUBLE / count(*) * 100, 2) AS reduction FROM (SELECT *, CASE WHEN {PRIORITY} THEN 150 ELSE 15 END AS lim, row_number() OVER (PARTITION BY s, file_path, {PRIORITY} ORDER BY {CAP_ORDER}) AS p FROM (SELECT *, CASE WHEN NOT {CONFIDENT} THEN 'confidence' WHEN {INTERNAL} THEN 'internal' WHEN {STYLE} THEN 'style' ELSE 'passed' END AS s FROM findings))"""),
    "reduced_findings": with_(FINDINGS, f"SELECT {SHORT} FROM (SELECT *, {PRIORITY} AS pr, row_number() OVER (PARTITION BY file_path, {PRIORITY} ORDER BY {CAP_ORDER}) AS p FROM findings WHERE {CONFIDENT} AND NOT {INTERNAL} AND NOT {STYLE}) WHERE p <= CASE WHEN pr THEN 150 ELSE 15 END"),
    "developer_mode": with_(FINDINGS, f"SELECT id, file_path FROM findings WHERE {FILE_TYPE('file_path')} = 'source_code'"),
    "review_filter": with_(REVIEW, f"""SELECT 'ai_review_' || substr(sha1(file || '|' || line || '|' || title || '|' || description), 1, 12) AS id, type, severity, file AS file_path, line AS line_number, title, round(confidence, 6) AS confidence, {case('severity', V.REVIEW_IMPACT)}::DOUBLE AS impact_score, 'ai-reviewer' AS detected_by FROM rows WHERE title IS NOT NULL AND {CONFIDENT}"""),
    "overlap_peers": with_(FINDINGS, """SELECT id, file_path, line_number, detected_by, array_to_string(list_filter(l, lambda x: x <> detected_by), ',') AS peers FROM (SELECT f.*, g.l FROM findings f JOIN (SELECT file_path, line_number, list_sort(list(DISTINCT detected_by)) AS l FROM findings WHERE line_number IS NOT NULL GROUP BY ALL) g ON f.file_path = g.file_path AND f.line_number = g.line_number WHERE len(g.l) > 1)"""),
    "wire_text": with_(FINDINGS, f"SELECT id, md5({WIRE}) AS wire FROM findings"),
    "cluster_sizes": with_(FINDINGS, f"SELECT min(id) AS id, type, count(*) AS cluster_size, least(count(*), 30) AS shown FROM findings GROUP BY type, {WIRE}"),
    "project_signature": "SELECT * FROM (VALUES ('readme', 'README.md', 5000), ('manifest', 'setup.py', 7), ('entrypoint', 'app.py', 5)) v(kind, path, length)",
    "rank_scores": with_(SCORED, "SELECT id, file_path, severity_score, type_score, round(file_score, 6) AS file_score, temporal, cluster_boost, ranking_score FROM scored"),
    "temporal_score": f"SELECT event_type, CASE WHEN ts IS NULL THEN 0.5 WHEN d < 86400000000 THEN 0.9 WHEN d < 7 * 86400000000 THEN 0.7 WHEN d < 30 * 86400000000 THEN 0.5 ELSE 0.3 END::DOUBLE AS score, count(*) AS n FROM (SELECT *, date_diff('microsecond', ts, TIMESTAMP '{Q.AS_OF}') AS d FROM events) GROUP BY ALL",
    "rank_positions": with_(SCORED, f"SELECT id, p AS position, round((n - p + 1)::DOUBLE / n * 100, 6) AS percentile, ranking_score FROM (SELECT *, row_number() OVER (ORDER BY {RANK_ORDER}) AS p, count(*) OVER () AS n FROM scored)"),
    "top_findings": with_(SCORED, f"SELECT id, severity, file_path, line_number, title, ranking_score FROM scored ORDER BY {RANK_ORDER} LIMIT 20"),
    "contextual_risk": with_(SCORED, f"""SELECT *, round(least(critical_issues * 0.4 + medium_issues * 0.2, 2.0), 6)::DOUBLE AS risk_score, CASE WHEN critical_issues * 0.4 + medium_issues * 0.2 >= 1.0 THEN 'HIGH' WHEN critical_issues * 0.4 + medium_issues * 0.2 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN total = 0 THEN 'clean' WHEN test_findings > 5 * (source_findings + other_findings) THEN 'comprehensive_tests' WHEN source_findings + other_findings = 0 THEN 'tests_only' ELSE 'attention' END AS assessment FROM (
  SELECT count(*) FILTER (file_type = 'source_code') AS source_findings, count(*) FILTER (file_type IN ('test_file', 'test_fixture')) AS test_findings, count(*) FILTER (file_type = 'unknown') AS other_findings, count(*) FILTER (file_type IN ('source_code', 'unknown') AND {CRITICAL}) AS critical_issues, count(*) FILTER (file_type IN ('source_code', 'unknown') AND severity = 'medium') AS medium_issues, count(*) AS total FROM scored)"""),
    "ranking_report": with_(SCORED, f"""SELECT 'type' AS dimension, type AS value, count(*) AS n, round(avg(ranking_score), 6) AS avg_score, max(ranking_score) AS top_score FROM scored GROUP BY type UNION ALL SELECT 'severity', severity, count(*), round(avg(ranking_score), 6), max(ranking_score) FROM scored GROUP BY severity
UNION ALL SELECT 'all', 'all', count(*), round(avg(ranking_score), 6), max(ranking_score) FROM scored UNION ALL SELECT 'top_10', 'all', count(*), round(avg(ranking_score), 6), max(ranking_score) FROM (SELECT * FROM scored ORDER BY {RANK_ORDER} LIMIT 10)"""),
    "stats_overview": with_(FINDINGS, "SELECT count(*) AS total_findings, count(DISTINCT file_path) AS files_analyzed, round(avg(confidence), 3) AS average_confidence, round(avg(impact_score), 3) AS average_impact FROM findings"),
    "stats_distribution": with_(FINDINGS, "SELECT 'by_type' AS dimension, type AS value, count(*) AS n FROM findings GROUP BY type UNION ALL SELECT 'by_severity', severity, count(*) FROM findings GROUP BY severity UNION ALL SELECT 'by_detector', detected_by, count(*) FROM findings GROUP BY detected_by"),
    "file_metrics": with_(FILE_SCORES, "SELECT * FROM (SELECT 'most_problematic' AS kind, file_path, issues, score FROM scores ORDER BY score DESC, file_path LIMIT 5) UNION ALL SELECT * FROM (SELECT 'cleanest', file_path, issues, score FROM scores WHERE issues <= 1 ORDER BY score, file_path DESC LIMIT 5)"),
    "file_priorities": with_(FILE_SCORES, "SELECT file_path, issues AS total_issues, critical_issues, score AS priority_score FROM scores ORDER BY score DESC, file_path LIMIT 10"),
    "file_intelligence": with_(FILE_SCORES, f"""SELECT s.file_path, s.issues AS total_issues, s.critical_issues AS critical_high_issues, s.score AS priority_score, l.issues_by_line, {FILE_TYPE('s.file_path')} AS file_type FROM (SELECT * FROM scores ORDER BY score DESC, file_path LIMIT 20) s
JOIN (SELECT file_path, string_agg(line || ':' || c, ',' ORDER BY line) AS issues_by_line FROM (SELECT file_path, coalesce(line_number, 0) AS line, count(*) AS c FROM findings GROUP BY ALL) GROUP BY file_path) l USING (file_path)"""),
    "confidence_bands": with_(FINDINGS, "SELECT 'complexity' AS kind, CASE severity WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM findings WHERE contains(lower(title), 'complexity') GROUP BY ALL UNION ALL SELECT 'security', CASE WHEN confidence >= 0.8 THEN 'high_confidence' WHEN confidence >= 0.5 THEN 'medium_confidence' ELSE 'low_confidence' END, count(*) FROM findings WHERE type = 'security' GROUP BY ALL"),
    "detector_health": with_(FINDINGS, "SELECT name, status, reason, findings, row_number() OVER (ORDER BY CASE status WHEN 'errored' THEN 0 WHEN 'skipped' THEN 1 ELSE 2 END, name)::INT AS place FROM (SELECT detected_by AS name, 'ok' AS status, '' AS reason, count(*)::INT AS findings FROM findings GROUP BY detected_by UNION ALL SELECT * FROM (VALUES ('taint', 'skipped', 'no tool', 0), ('js', 'errored', 'no node', 0), ('ast', 'skipped', 'no tool', 0)) v)"),
    "detail_by_type": with_(FINDINGS, "SELECT type, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = {lit(s)}) AS {s}" for s in V.SEVERITY_RANK) + " FROM findings GROUP BY type"),
    "security_overview": with_(FINDINGS, "SELECT *, CASE WHEN total = 0 THEN 'NONE' WHEN critical > 0 THEN 'CRITICAL' WHEN high >= 3 THEN 'HIGH' WHEN high > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = {lit(s)}) AS {s}" for s in ("critical", "high", "medium", "low")) + " FROM findings WHERE type = 'security')"),
    "vuln_categories": with_(FINDINGS, f"SELECT {VULN} AS category, count(*) AS n, {MAX_SEVERITY} AS severity FROM findings WHERE type = 'security' GROUP BY 1"),
    "privacy_categories": with_(FINDINGS, f"SELECT {PRIVACY} AS category, count(*) AS n, {MAX_SEVERITY} AS severity FROM findings WHERE type = 'privacy' GROUP BY 1"),
    "privacy_overview": with_(FINDINGS, "SELECT *, CASE WHEN high_impact >= 3 THEN 'HIGH' WHEN high_impact > 0 THEN 'MEDIUM' ELSE 'LOW' END AS compliance_risk FROM (SELECT count(*) AS total, 0::BIGINT AS categories, count(*) FILTER (impact_score > 0.7) AS high_impact FROM findings WHERE type = 'privacy')"),
    "compliance": with_(FINDINGS, f"SELECT law AS regulation, count(*) AS violations, CASE WHEN count(*) >= CASE law WHEN 'GDPR' THEN 5 ELSE 3 END THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level FROM (SELECT {case('pattern_type', {k: v[1] for k, v in V.PII_REGION.items()})} AS law FROM findings WHERE type = 'privacy') WHERE law IN ('GDPR', 'CCPA') GROUP BY law"),
    "exec_categories": with_(FINDINGS, f"SELECT category, n, row_number() OVER (ORDER BY n DESC, category)::INT AS place FROM (SELECT {CATEGORY} AS category, count(*) AS n FROM findings GROUP BY 1)"),
    "fallback_risk": with_(FINDINGS, "SELECT *, CASE WHEN critical > 0 OR high >= 5 THEN 'HIGH' WHEN high > 0 OR total >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM findings)"),
    "recommendation_top3": with_(FINDINGS, f"""SELECT id, severity, file_path, line_number, title, (p > 1)::INT AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY file_path, trim(title) ORDER BY (severity <> 'critical')::INT, impact_score DESC, {TIES}) AS p FROM findings WHERE {CRITICAL} AND {FILE_TYPE('file_path')} = 'source_code') ORDER BY p > 1, (severity <> 'critical')::INT, impact_score DESC, {TIES} LIMIT 3"""),
    "typed_blocks": with_(BLOCKS, "SELECT block, place::INT AS place, id, file_path, line_number, severity, title, greatest(n - 50, 0) AS dropped FROM placed WHERE place <= 50"),
    "production_focus": with_(BLOCKS, f"SELECT block, place::INT AS place, id, file_path, line_number FROM placed WHERE place <= 50 AND block <> 'other' AND {FILE_TYPE('file_path')} = 'source_code' ORDER BY {case('block', {b: k for k, b in enumerate(V.BLOCKS)})}, place LIMIT 25"),
    "remediation_dict": with_(FINDINGS, "SELECT 'rem_' || lpad((row_number() OVER (ORDER BY encode(t)))::VARCHAR, 3, '0') AS ref, t AS text FROM (SELECT DISTINCT trim(remediation) AS t FROM findings WHERE len(trim(remediation)) > 0)"),
    "fp_likelihood": with_(FINDINGS, f"SELECT id, file_path, line_number, detected_by, CASE WHEN ft = 'source_code' AND confidence >= 0.85 AND lower(detected_by) IN {rows([V.PRECISE_DETECTORS])} THEN 'LOW' WHEN ft <> 'source_code' AND confidence <= 0.75 AND lower(detected_by) IN {rows([V.KEYWORD_DETECTORS])} THEN 'HIGH' ELSE 'MEDIUM' END AS likelihood FROM (SELECT *, {FILE_TYPE('file_path')} AS ft FROM findings)"),
    "first_seen": with_(FINDINGS, f"SELECT DISTINCT id, CASE WHEN max((len(file_path) % 2 = 0)::INT) OVER (PARTITION BY id) = 1 THEN TIMESTAMP '2023-12-01 00:00:00' ELSE TIMESTAMP '{Q.AS_OF}' END AS first_seen FROM findings"),
    "quick_actions": with_(FINDINGS, f"""SELECT * FROM (SELECT 'immediate' AS kind, id, file_path, line_number FROM findings WHERE severity = 'critical' ORDER BY (NOT starts_with(title, 'Syntax Error'))::INT, {TIES} LIMIT 3) UNION ALL SELECT * FROM (SELECT 'todo', id, file_path, line_number FROM findings WHERE type = 'todo' ORDER BY file_path, line_number NULLS LAST, pattern_type, id LIMIT 5)
UNION ALL SELECT 'todo_left_out', '', '', greatest(count(*) - 5, 0)::INT FROM findings WHERE type = 'todo'"""),
    "snippet_context": with_(LINES + "," + MODERATION, "SELECT m.id, m.file_path AS path, m.line_number, md5(string_agg(l.line, chr(10) ORDER BY l.line_no)) AS context FROM mod m JOIN lines l ON l.path = m.file_path AND l.line_no BETWEEN m.line_number - 1 AND m.line_number + 1 GROUP BY ALL"),
    "redact_text": with_(LINES, f"SELECT path, line_no, md5(after) AS after FROM (SELECT path, line_no, line, {redacted('line')} AS after FROM lines) WHERE after <> line"),
    "leak_scan": with_(LINES, " UNION ALL ".join(f"SELECT path, line_no, {lit(n)} AS leak FROM lines WHERE {rx('line', ('(?:^|[^A-Za-z0-9_])' + p + '(?:[^A-Za-z0-9_]|$)') if token else p, '')}" for n, p, token in V.LEAKS)),
    "changed_docs": with_(FILES + ", " + VERSIONS, "SELECT path, change FROM diff"),
    "incremental_merge": with_(
        FILES + ", " + VERSIONS + ", lines AS (SELECT path, unnest(l) AS line, generate_subscripts(l, 1)::INT AS line_no FROM (SELECT path, string_split(content, chr(10)) AS l FROM (SELECT * FROM old WHERE path NOT IN (SELECT path FROM diff) UNION ALL SELECT * FROM new WHERE path IN (SELECT path FROM diff))))," + MODERATION + "," + MARK,
        "SELECT id, file_path, line_number, pattern_type FROM mod UNION ALL SELECT id, file_path, line_number, pattern_type FROM mark",
    ),
    "mtime_changes": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'",
    "session_debounce": """WITH e AS (SELECT ts, 'f' || (user_id % 5) AS item FROM events WHERE ts IS NOT NULL), g AS (SELECT *, coalesce(ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 20 MINUTES, true) AS fresh FROM e), s AS (SELECT *, sum(fresh::INT) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 20 MINUTES) AS end_us, count(*) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM s GROUP BY sid""",
}
