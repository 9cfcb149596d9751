"""Line detectors: personal data, credentials, input validation, language, work markers, shapes.

Each takes lines (path, line_no, line) and returns findings; none shuffles but
consolidate(), which meets a line's personal-data findings by path and line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.columns import all_matches, any_of, contains_any, digits_of, file_name, first_case, in_dirs, lookup, luhn, matches, title_case
from ..schema import as_findings, finding_id
from ..sources.corpus import lines
from .classify import file_type


def test_context(path: Column, content: Column) -> Column:
    """Whether a file's path or what it holds says that its data are for tests."""
    name = F.lower(file_name(path))
    by_name = F.startswith(name, F.lit("test_")) | any_of(F.endswith(name, F.lit(s)) for s in V.TEST_NAME_SUFFIXES)
    return in_dirs(path, V.TEST_DIRS) | by_name | contains_any(F.lower(content), V.TEST_VALUES)


def _numbered(pattern: str, *told: Column) -> Column:
    """The matches of a pattern in a line as structs of ``told``, k (from 1) and m."""
    return F.transform(all_matches(F.col("line"), pattern), lambda m, i: F.struct(*told, (i + 1).cast("int").alias("k"), m.alias("m")))


def told_lines(files: DataFrame) -> DataFrame:
    """Lines with what their file tells: test context, an error tracker's key, a payment test card."""
    four = F.regexp_extract_all("content", F.lit(V.FOUR_GROUPS), F.lit(0))
    with_card = F.exists(four, lambda m: digits_of(m).isin(*V.PAYMENT_TEST_CARDS))
    told = files.select(
        "path", "content", test_context(F.col("path"), F.col("content")).alias("is_test"), matches(F.col("content"), V.ERROR_TRACKER_KEY).alias("has_key"),
        F.when(F.rlike("content", F.lit(V.FOUR_GROUPS)), with_card).otherwise(F.lit(False)).alias("has_card"),
    )
    return lines(told, "is_test", "has_key", "has_card")


def pii_lines(files: DataFrame) -> DataFrame:
    """told_lines() that may hold personal data at all."""
    return told_lines(files).where(F.rlike("line", F.lit("[0-9@]")))


HIT = "struct<family:string,name:string,severity:string,confidence:double,det:int,k:int,m:string>"


def _found(family: str, name: str, pattern: str, severity: str, confidence: float, det: int) -> Column:
    """Hits of every match of a pattern in a line, numbered from 1."""
    told = (F.lit(family).alias("family"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(confidence).cast("double").alias("confidence"), F.lit(det).alias("det"))
    return _numbered(pattern, *told)


def _once(family: str, name: str, severity: str, confidence: float, test: Column) -> Column:
    """One hit if the test holds, else null."""
    parts = (F.lit(family), F.lit(name), F.lit(severity), F.lit(confidence).cast("double"), F.lit(0), F.lit(1), F.lit(None).cast("string"))
    return F.when(test, F.struct(*(p.alias(n) for p, n in zip(parts, ("family", "name", "severity", "confidence", "det", "k", "m"), strict=True))))


def _first(family: str, name: str, pattern: str, severity: str, confidence: float) -> Column:
    """The hit of a pattern's first match in a line."""
    m = F.regexp_extract("line", "(?i)" + pattern, 0)
    told = (F.lit(family).alias("family"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(confidence).cast("double").alias("confidence"), F.lit(0).alias("det"), F.lit(1).alias("k"), m.alias("m"))
    return F.filter(F.array(F.struct(*told)), lambda h: h["m"] != "")


def _guarded(test: Column, hits: Column) -> Column:
    return F.when(test, hits).otherwise(F.array().cast(f"array<{HIT}>"))


#: Digits that a match of each detector has at least; a line with fewer is not searched.
DIGITS = {
    "credit_card": 13, "us_ssn": 9, "phone_number": 10, "ip_address": 4, "uk_nhs": 10, "uk_nino": 6, "uk_phone": 11, "india_aadhaar": 12,
    "india_pan": 4, "singapore_nric": 7, "australia_tfn": 9, "australia_medicare": 10, "iban": 9, "eu_vat": 8,
}
#: What a match of each shape holds in lower case, one of; a line without it is not searched.
HELD = {
    "api_key_assignment": ("key", "token", "secret"), "aws_access_key": ("akia",), "github_token": ("ghp_",), "github_app_token": ("ghs_",), "slack_token": ("xox",),
    "discord_token": (".",), "password_assignment": ("password",), "private_key": ("-----begin",), "url_encoded": ("%",),
    "hate_speech_indicators": ("nazi", "kike", "spic", "chink", "nigger", "faggot"), "explicit_profanity": ("fuck", "shit", "bitch", "ass", "bastard", "damn", "hell"),
    "casual_abbreviations": ("wtf", "omg", "lol", "rofl", "lmao"), "unprofessional_descriptors": ("stupid", "dumb", "idiotic", "moronic", "retarded"),
}
#: Where no literal tells, a pattern that matches wherever the shape does, and tries the beginnings of runs only.
RUNS = {"aws_secret_key": r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}", "base64_encoded": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16}", "hex_encoded": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32}"}
#: Columns that a line's guards read, made once for each line.
_GUARDS = {"_low": F.lower, "_digits": lambda line: F.length(line) - F.length(F.translate(line, "0123456789", ""))}


def pii_hits(names: Sequence[str] | None = None) -> Column:
    found = []
    for det, (name, pattern, severity) in enumerate(V.PII):
        if names is None or name in names:
            needs = F.contains("line", F.lit("@")) if name == "email_address" else F.col("_digits") >= DIGITS[name]
            found.append(_guarded(needs, _found("pii", name, pattern, severity, 0.95, det)))
    return F.flatten(F.array(*found))


def kind_hits(family: str, kinds: Sequence[tuple], allowed: Column, denied: dict[str, Column] | None = None) -> Column:
    """A hit for each kind of which some pattern matches the line."""
    hits = []
    for kind, severity, confidence, patterns in kinds:
        one = any_of(matches(F.col("line"), p) for p in patterns)
        hits.append(_once(family, kind, severity, confidence, one & ~denied[kind] if denied and kind in denied else one))
    return _guarded(allowed, F.array_compact(F.array(*hits)))


def shape_hits(family: str, shapes: Sequence[tuple[str, str, str]], confidence: float, first_only: bool = False) -> Column:
    """Hits of every match of every shape, or of each shape's first.

    Shapes that a literal tells are only searched where it is, others where a run of their characters begins.
    """
    found = []
    for name, pattern, severity in shapes:
        hits = _first(family, name, pattern, severity, confidence) if first_only else _found(family, name, pattern, severity, confidence, 0)
        test = any_of(F.contains("_low", F.lit(x)) for x in HELD[name]) if name in HELD else F.rlike("line", F.lit(RUNS[name])) if name in RUNS else F.lit(True)
        found.append(_guarded(test, hits))
    return F.flatten(F.array(*found))


def auth_hits() -> Column:
    return kind_hits("auth", V.AUTH, (F.length("line") <= V.LONGEST_LINE) & ~is_comment(F.col("line")))


def validation_hits() -> Column:
    return kind_hits("validation", V.VALIDATION, F.length("line") <= V.LONGEST_LINE, {"xss_risk": F.rlike("line", F.lit(V.SAFE_WRAPPER))})


def marker_hits() -> Column:
    upper = F.upper("line")
    hits = [_once("markers", n, s, 0.9, F.rlike(upper, F.lit(rf"\b{n}\b"))) for n, s in V.MARKERS]
    return _guarded(F.contains("line", F.lit("#")) | F.contains("line", F.lit("//")), F.array_compact(F.array(*hits)))


def _exploded(rows: DataFrame, hits: Column) -> DataFrame:
    guarded = rows.withColumns({name: made(F.col("line")) for name, made in _GUARDS.items()})
    return guarded.withColumn("hit", F.explode(hits)).select("*", "hit.*").drop("hit", *_GUARDS)


def pii_matches(rows: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """rows with det (the detector's place), name, k (from 1) and m (the match) for every raw match."""
    return _exploded(rows, pii_hits(names)).drop("family", "severity", "confidence")


def _pii_ok() -> Column:
    """Whether a raw match passes its detector's validation and deny list."""
    m, name = F.col("m"), F.col("name")
    card = luhn(m) | m.isin(*V.TEST_CARDS)
    ssn = digits_of(m)
    ssn_ok = ~ssn.isin(*V.TEST_SSNS) & ~F.substring(ssn, 1, 3).isin("000", "666") & (F.substring(ssn, 1, 1) != "9") & (F.substring(ssn, 4, 2) != "00") & (F.substring(ssn, 6, 4) != "0000")
    mail = F.lower(m)
    mail_ok = ~any_of(F.endswith(mail, F.lit(s)) for s in V.BENIGN_EMAIL_SUFFIXES) & ~any_of(F.startswith(mail, F.lit(s)) for s in V.BENIGN_EMAIL_PREFIXES)
    ip_ok = ~any_of(F.startswith(m, F.lit(s)) for s in V.BENIGN_IP_PREFIXES)
    aadhaar_ok = ~digits_of(m).isin(*V.AADHAAR_PLACEHOLDERS) & ~F.col("has_card")
    return first_case(
        [
            (name == "credit_card", F.length(m).isin(*V.CARD_LENGTHS) & card), (name == "us_ssn", ~F.col("has_key") & ssn_ok), (name == "email_address", ~F.col("has_key") & mail_ok),
            (name == "ip_address", ip_ok), (name == "india_aadhaar", aadhaar_ok),
        ],
        True,
    )


def _pii_type() -> Column:
    return F.when(F.col("name") == "credit_card", lookup(F.substring("m", 1, 1), V.CARD_BRANDS)).otherwise(F.col("name"))


def _pii_confidence() -> Column:
    return F.when((F.col("name") == "credit_card") & F.col("m").isin(*V.TEST_CARDS), 0.98).otherwise(0.95)


def pii_valid(raw: DataFrame) -> DataFrame:
    """Raw matches that are valid, with pattern_type and confidence."""
    return raw.where(_pii_ok()).withColumn("pattern_type", _pii_type()).withColumn("confidence", _pii_confidence())


def definition_context(path: Column, line: Column) -> tuple[Column, Column]:
    """Whether a match looks like a pattern's definition in a scanner, report or configuration file; and whether the file is a report."""
    low, name = F.lower(path), F.lower(file_name(path))
    scanner = in_dirs(path, V.SCANNER_DIRS) | contains_any(name, V.SCANNER_NAME_PARTS)
    artifact = contains_any(low, (V.OUTPUT_DIR, *V.ARTIFACT_PARTS))
    config = contains_any(low, V.CONFIG_PARTS)
    return (scanner | artifact | config) & contains_any(F.lower(line), V.DEFINITION_WORDS), artifact


def mask(m: Column) -> Column:
    """The match's length, and nothing else of it."""
    return F.concat(F.lit("[REDACTED — "), F.length(m).cast("string"), F.lit("-char value]"))


def _pii_columns() -> dict[str, Column]:
    defined, artifact = F.col("defined"), F.col("artifact")
    base = lookup(F.col("name"), {n: s for n, _, s in V.PII})
    fix = F.when(F.col("is_test"), F.lit(V.PII_TEST_REMEDIATION)).otherwise(lookup(F.col("pattern_type"), V.PII_REMEDIATION, V.PII_OTHER_REMEDIATION))
    return {
        "id": finding_id(F.lit("privacy"), F.col("pattern_type"), F.col("path"), F.col("line_no"), F.col("k")), "type": F.lit("privacy"),
        "severity": first_case([(defined | artifact, "low"), (F.col("is_test") & (base == "high"), "medium"), (F.col("is_test") & (base == "medium"), "low")], base),
        "title": lookup(F.col("pattern_type"), V.PII_TITLES, title_case(F.col("pattern_type"))), "description": mask(F.col("m")), "code_snippet": F.lit(None).cast("string"),
        "confidence": first_case([(defined, 0.1), (artifact, 0.05)], F.col("confidence")), "impact_score": F.lit(0.0), "detected_by": F.lit("privacy_detector"), "remediation": fix, "pattern_type": F.col("pattern_type"),
    }


def _select(rows: DataFrame, columns: dict[str, Column], *more: str) -> DataFrame:
    return rows.select(F.col("path").alias("file_path"), F.col("line_no").alias("line_number"), *(c.alias(n) for n, c in columns.items()), *more)


def _with_context(rows: DataFrame, family: Column | None = None) -> DataFrame:
    """rows with what several columns of a finding rest on, computed once; only for rows of a family that needs it, if that is told."""
    defined, artifact = definition_context(F.col("path"), F.col("line"))
    kind = file_type(F.col("path"))
    own = {"defined": (defined, "pii"), "artifact": (artifact, "pii"), "file_kind": (kind, "moderation")}
    return rows.withColumns({n: c if family is None else F.when(family == f, c) for n, (c, f) in own.items()})


def pii(files: DataFrame) -> DataFrame:
    """Personal-data findings, one per match; the match itself is only there as its mask."""
    return _select(_with_context(pii_valid(pii_matches(pii_lines(files)))), _pii_columns(), "det", "k")


def consolidate(found: DataFrame, *group: str) -> DataFrame:
    """One personal-data finding per line: of those of highest severity the first; its confidence is the highest, and pii_types lists all types in order.

    With ``group``, a column that is one value for personal data and each other finding's own, those others pass through.
    """
    rank = lookup(F.col("severity"), V.SEVERITY_RANK)
    order = F.struct((-rank).alias("r"), "det", "k", "pattern_type")
    keep = ("id", "type", "severity", "title", "description", "code_snippet", "impact_score", "detected_by", "remediation", "pattern_type")
    types = F.array_sort(F.collect_list(F.struct("det", "k", "pattern_type")))
    one = found.groupBy("file_path", "line_number", *group).agg(F.min_by(F.struct(*keep), order).alias("f"), F.max("confidence").alias("confidence"), F.count("*").cast("int").alias("n"), types.alias("types"))
    # a type's detector comes first where the type first does
    names = F.array_distinct(F.transform("types", lambda t: t["pattern_type"]))
    titles = F.concat_ws(", ", F.transform("names", lambda t: lookup(t, V.PII_TITLES, title_case(t))))
    one = one.withColumn("names", names)
    several = (F.col("n") > 1) & (F.col("f.type") == "privacy")
    count = F.size("names").cast("string")
    return one.select(
        "f.id", "f.type", "f.severity", "file_path", "line_number",
        F.when(several, F.concat(F.lit("Multiple PII patterns at this location ("), count, F.lit("): "), titles)).otherwise(F.col("f.title")).alias("title"),
        F.when(several, F.concat(count, F.lit(" detectors fired on one line: "), F.concat_ws(", ", "names"))).otherwise(F.col("f.description")).alias("description"),
        "f.code_snippet", "confidence", "f.impact_score", "f.detected_by", "f.remediation", "f.pattern_type",
        F.when(several, F.col("names")).alias("pii_types"), F.when(several, F.col("n")).alias("consolidated_from"),
    )


def enrich_privacy(found: DataFrame) -> DataFrame:
    """privacy_category and compliance_regions (region, then law) by pattern type, where they aren't set."""
    region = lookup(F.col("pattern_type"), {k: v[0] for k, v in V.PII_REGION.items()})
    law = lookup(F.col("pattern_type"), {k: v[1] for k, v in V.PII_REGION.items()})
    listed = F.when(region.isNotNull(), F.array(region, law))
    return found.withColumn("privacy_category", F.coalesce("privacy_category", F.col("pattern_type"))).withColumn("compliance_regions", F.coalesce("compliance_regions", listed))


def is_comment(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^\s*(?:#|//|/\*)"))


def redact_quoted(line: Column) -> Column:
    return F.regexp_replace(line, r"""(["'])([^"']+)(["'])""", "$1<REDACTED>$3")


def truncate(text: Column, most: int = V.SNIPPET) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def auth_matches(rows: DataFrame) -> DataFrame:
    return _exploded(rows, auth_hits()).withColumnRenamed("name", "kind")


def _security_columns(detector: str, title: str, snippet: Column) -> dict[str, Column]:
    name = F.col("name")
    return {
        "id": finding_id(F.lit(detector), name, F.col("path"), F.col("line_no"), F.lit(1)), "type": F.lit("security"), "severity": F.col("severity"), "title": F.concat(F.lit(title), title_case(name)),
        "description": F.concat(F.lit("Matched "), name), "code_snippet": snippet, "confidence": F.col("confidence"), "impact_score": lookup(F.col("severity"), V.PATTERN_IMPACT), "detected_by": F.lit(detector),
        "remediation": F.concat(F.lit("Fix "), name), "pattern_type": name,
    }


def _auth_columns() -> dict[str, Column]:
    line = F.trim(F.col("line"))
    return _security_columns("auth_pattern_analyzer", "AI Authentication Anti-pattern: ", truncate(F.when(F.col("name") == "hardcoded_secrets", redact_quoted(line)).otherwise(line)))


def _validation_columns() -> dict[str, Column]:
    return _security_columns("input_validation_analyzer", "Input Validation Vulnerability: ", truncate(F.trim(F.col("line"))))


def _secret_columns() -> dict[str, Column]:
    return _security_columns("SecretsScanner", "Secret: ", mask(F.col("m")))


def _moderation_columns() -> dict[str, Column]:
    path, name, severity = F.col("path"), F.col("name"), F.col("severity")
    own = contains_any(F.lower(path), V.MODERATION_SCANNER_PARTS) & contains_any(F.lower(F.col("m")), V.MODERATION_DEFINITION_WORDS)
    kind = F.col("file_kind")
    tested = kind.isin("test_file", "test_fixture") | in_dirs(path, V.MODERATION_TEST_DIRS)
    factor = first_case([(tested, V.RELAX_TEST), (in_dirs(path, V.EXAMPLE_DIRS), V.RELAX_EXAMPLE), (kind == "documentation", V.RELAX_DOCS)], 1.0)
    return {
        "id": F.substring(F.md5(F.concat_ws(":", path, name, F.col("line_no").cast("string"), F.col("k").cast("string"))), 1, 8), "type": F.lit("code_quality"),
        "severity": first_case([(own, "low"), (tested & (severity == "high") & (name != "hate_speech_indicators"), "medium")], severity),
        "title": F.concat(F.lit("Content moderation: "), title_case(name)), "description": F.concat(F.lit("Language of kind "), name), "code_snippet": F.lit(None).cast("string"),
        "confidence": F.when(own, 0.1).otherwise(V.MODERATION_CONFIDENCE * factor), "impact_score": lookup(severity, V.MODERATION_IMPACT), "detected_by": F.lit("ContentModerationScanner"),
        "remediation": F.lit("Replace with professional language"), "pattern_type": name,
    }


def _marker_columns() -> dict[str, Column]:
    from .redact import redact_text

    name = F.col("name")
    return {
        "id": finding_id(F.lit("marker"), name, F.col("path"), F.col("line_no"), F.lit(1)), "type": F.lit("todo"), "severity": F.col("severity"), "title": F.concat(name, F.lit(" Comment")),
        "description": F.concat(name, F.lit(" comment found: "), truncate(redact_text(F.trim(F.col("line"))), 80)), "code_snippet": F.lit(None).cast("string"), "confidence": F.col("confidence"), "impact_score": F.lit(0.0),
        "detected_by": F.lit("legacy_patterns"), "remediation": F.lit(None).cast("string"), "pattern_type": name,
    }


def auth(rows: DataFrame) -> DataFrame:
    """Credentials in code, weak tokens, unlimited endpoints: one finding per line and kind, in .py files."""
    return _select(_exploded(rows.where(_in_scope("auth")), auth_hits()), _auth_columns())


def validation_matches(rows: DataFrame) -> DataFrame:
    return _exploded(rows, validation_hits()).withColumnRenamed("name", "kind")


def validation(rows: DataFrame) -> DataFrame:
    """Injection and cross-site scripting: one finding per line and kind, in .py, .js and .ts files."""
    return _select(_exploded(rows.where(_in_scope("validation")), validation_hits()), _validation_columns())


def shape_matches(rows: DataFrame, shapes: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rows with name, severity, k and m for every match of every shape."""
    return _exploded(rows, shape_hits("shapes", shapes, 0.7)).drop("family", "confidence", "det")


def moderation_matches(rows: DataFrame) -> DataFrame:
    return shape_matches(rows, V.MODERATION)


def moderation(rows: DataFrame) -> DataFrame:
    """Language findings, relaxed in tests, examples and documentation, and where a scanner defines its patterns."""
    return _select(_with_context(moderation_matches(rows)), _moderation_columns())


def marker_matches(rows: DataFrame) -> DataFrame:
    """rows with name and severity for each work marker in a line that has a comment sign."""
    return _exploded(rows, marker_hits()).drop("family", "confidence", "det", "k", "m")


def markers(rows: DataFrame) -> DataFrame:
    """Work-marker findings; the text that they quote is redacted, and cut to 80 characters."""
    return _select(_exploded(rows, marker_hits()), _marker_columns())


def secrets(rows: DataFrame) -> DataFrame:
    """Findings by the shapes of secrets, one per line and shape."""
    return _select(_exploded(rows, shape_hits("secrets", V.SECRETS, 0.7, first_only=True)), _secret_columns())


def _in_scope(family: str) -> Column:
    """Whether a detector family looks at a file at all."""
    path = F.col("path")
    return {"auth": F.endswith(path, F.lit(".py")), "validation": F.rlike(path, F.lit(r"\.(?:py|js|ts)$"))}.get(family, F.lit(True))


#: Family: its hits in a line, and a hit's finding.
FAMILIES = {
    "pii": (pii_hits, _pii_columns), "auth": (auth_hits, _auth_columns), "validation": (validation_hits, _validation_columns), "moderation": (lambda: shape_hits("moderation", V.MODERATION, V.MODERATION_CONFIDENCE), _moderation_columns),
    "markers": (marker_hits, _marker_columns), "secrets": (lambda: shape_hits("secrets", V.SECRETS, 0.7, first_only=True), _secret_columns),
}
#: What each scan mode runs.
MODES = {
    "full": ("pii", "auth", "validation", "moderation", "markers", "secrets"), "fast": ("pii", "auth", "secrets"),
    "code": ("auth", "validation", "markers", "secrets"), "privacy": ("pii",), "content": ("moderation",),
}


def detect(files: DataFrame, mode: str = "full", extra: dict | None = None) -> DataFrame:
    """All findings of a mode's detectors, and of those that users have registered, in one table.

    One pass: each line's hits of all families are one array, its finding's
    columns are chosen by family, and one shuffle of the (few) findings merges
    a line's personal data. Only detectors in ``extra`` (name to a function
    from lines to findings) read the files again.
    """
    families = MODES[mode]
    rows = told_lines(files) if "pii" in families else lines(files)
    hits = F.flatten(F.array(*(_guarded(_in_scope(f), FAMILIES[f][0]()) for f in families)))
    rows = _exploded(rows, hits)
    if "pii" in families:
        mine = F.col("family") == "pii"
        rows = rows.where(~mine | _pii_ok()).withColumns({"pattern_type": F.when(mine, _pii_type()), "confidence": F.when(mine, _pii_confidence()).otherwise(F.col("confidence"))})
    rows = _with_context(rows, F.col("family"))
    by_family = {f: FAMILIES[f][1]() for f in families}
    columns = {c: first_case([(F.col("family") == f, cols[c]) for f, cols in by_family.items()]) for c in next(iter(by_family.values()))}
    found = _select(rows, columns, "det", "k")
    if "pii" in families:
        found = consolidate(found.withColumn("own", F.when(F.col("type") != "privacy", F.col("id"))), "own")
    found = as_findings(found)
    for fn in (extra or {}).values():
        found = found.unionByName(as_findings(fn(lines(files))))
    return found
