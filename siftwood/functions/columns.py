"""Column expressions that the operators share; all run in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(F.contains(text, F.lit(w)) for w in words)


def lookup(key: Column, values: Mapping[str, object], default: object = None) -> Column:
    """values[key] as a chain of conditions, so that no join is needed."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def first_case(cases: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for test, v in cases:
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.rlike(text, F.lit(("(?i)" if ignore_case else "") + pattern))


def all_matches(text: Column, pattern: str) -> Column:
    """What a pattern matches, whatever the letters' case, in order."""
    return F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))


def path_parts(path: Column) -> Column:
    return F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path: Column) -> Column:
    """The name's ending with its dot, in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?:[^.])(\.[^.]*)$", 1))


def in_dirs(path: Column, names: Iterable[str]) -> Column:
    return F.arrays_overlap(path_parts(path), F.array(*map(F.lit, names)))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s-]", "")


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def glob_regex(rule: str) -> str:
    """The regular expression of a shell glob in which * also crosses slashes."""
    out, i = "", 0
    while i < len(rule):
        c = rule[i]
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif c == "[" and "]" in rule[i + 2 :]:
            j = rule.index("]", i + 2)
            body = rule[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += "\\" + c if not (c.isalnum() or c in "_/ ") else c
        i += 1
    return f"^{out}$"
