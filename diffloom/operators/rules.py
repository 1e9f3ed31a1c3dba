"""Line rules, file suggestions and best-practice checks.

A rule is a condition on one line. All rules are compiled into one projection,
so a corpus is scanned once however many rules there are, and no row moves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom import fixed_values as fv
from diffloom.functions import text as tx


@dataclass(frozen=True)
class LineRule:
    """Reports an issue for every line on which ``condition`` holds."""

    rule_id: str
    issue_type: str
    severity: str
    condition: Callable[[Column], Column]
    message: Callable[[Column], Column]
    suggestion: str
    languages: tuple[str, ...] = ()  # empty: any language


def _says(message: str) -> Callable[[Column], Column]:
    return lambda line: F.lit(message)


def _matches_any(patterns: Sequence[str], needs: str = "") -> Callable[[Column], Column]:
    """Any pattern matches. ``needs`` is a text every match contains: a byte search for it comes first."""

    def condition(line: Column) -> Column:
        matched = reduce(lambda a, b: a | b, [line.rlike(p) for p in patterns])
        return F.contains(line, F.lit(needs)) & matched if needs else matched

    return condition


def _is_markup_write(line: Column) -> Column:
    assignment, write, evaluate = fv.XSS_PATTERNS
    return reduce(
        lambda a, b: a | b,
        [
            _matches_any([assignment], needs="innerHTML")(line),
            _matches_any([write], needs="write(")(line),
            _matches_any([evaluate], needs="eval(")(line),
        ],
    )


SECURITY_RULES = [
    LineRule("security.sql_injection", "sql_injection", "high", _matches_any(fv.SQL_INJECTION_PATTERNS, needs="+"),
             _says("Possible SQL injection"), "Use parameterised statements"),
    LineRule("security.xss", "xss", "medium", _is_markup_write,
             _says("Possible cross-site scripting"), "Avoid writing unescaped markup or evaluating text"),
    LineRule("security.sensitive_data", "sensitive_data", "critical", _matches_any(fv.SENSITIVE_DATA_PATTERNS, needs="="),
             _says("Possible hard-coded secret"), "Load secrets from a protected store"),
]
SECURITY_FAMILIES = [rule.issue_type for rule in SECURITY_RULES]

def _lint(rule_id: str, condition: Callable[[Column], Column], *languages: str) -> LineRule:
    kind, severity, message, suggestion = fv.LINT_TEXTS[rule_id]
    return LineRule(rule_id, kind, severity, condition, lambda line: tx.filled(message, length=F.length(line)),
                    suggestion, languages)


PYTHON_RULES = [
    _lint("python.line_length", lambda line: F.length(line) > fv.LINE_LIMITS["python"], "python"),
    _lint(
        "python.return_type",
        lambda line: _matches_any([fv.UNTYPED_DEF_PATTERN], needs="def")(line) & ~F.contains(line, F.lit("->")),
        "python",
    ),
]
SCRIPT_RULES = [
    _lint("script.var", _matches_any([fv.VAR_PATTERN], needs="var"), "javascript", "typescript"),
    _lint("script.console_log", lambda line: F.contains(line, F.lit("console.log")), "javascript", "typescript"),
]
LINT_RULES = PYTHON_RULES + SCRIPT_RULES


def custom_rules(patterns: Sequence[str], issue_type: str = "style", severity: str = "low") -> list[LineRule]:
    """Rules from user-given regular expressions; they run in the same pass as the others."""
    return [
        LineRule(f"custom.{number}", issue_type, severity, _matches_any([pattern]),
                 _says(f"Matches custom rule {number}"), "")
        for number, pattern in enumerate(patterns, 1)
    ]


def line_table(files: DataFrame, key: str = "file_id", *keep: str) -> DataFrame:
    """One row per line: key, kept columns, 1-based ``line_no``, ``line``."""
    # The outer form: the plain one makes Catalyst test the array's size in a
    # filter of its own, which evaluates the whole array expression twice.
    exploded = files.select(key, *keep, F.posexplode_outer(tx.lines(F.col("content"))).alias("pos", "line"))
    return exploded.filter(F.col("line").isNotNull()).select(
        key, *keep, (F.col("pos") + 1).alias("line_no"), "line"
    )


def line_issues(line_array: Column, language: Column, rules: Sequence[LineRule]) -> Column:
    """array<struct<line, rule_id, type, severity, message, suggestion>> of one file."""

    def finding(rule: LineRule, line: Column, pos: Column) -> Column:
        condition = rule.condition(line)
        if rule.languages:
            # The cheap language test comes first and guards the pattern.
            condition = language.isin(*rule.languages) & condition
        return F.when(
            condition,
            F.struct(
                (pos + 1).alias("line"),
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(rule.issue_type).alias("type"),
                F.lit(rule.severity).alias("severity"),
                rule.message(line).alias("message"),
                F.lit(rule.suggestion).alias("suggestion"),
            ),
        )

    return F.flatten(
        F.transform(
            line_array,
            lambda line, pos: F.array_compact(F.array(*[finding(rule, line, pos) for rule in rules])),
        )
    )


def scan_lines(files: DataFrame, rules: Sequence[LineRule]) -> DataFrame:
    """Issues of all rules over ``files(file_id, language, content)``; one scan, no shuffle."""
    found = line_issues(tx.lines(F.col("content")), F.col("language"), rules)
    return files.select("file_id", F.explode_outer(found).alias("i")).filter(F.col("i").isNotNull()).select(
        "file_id", "i.*"
    )


def language_lint(files: DataFrame) -> DataFrame:
    """Lint by language: each rule set applies to its languages, others report nothing."""
    return scan_lines(files, LINT_RULES)


def _suggestion(texts: tuple[str, str, str, str], **values: Column) -> Column:
    kind, priority, message, suggestion = texts
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(priority).alias("priority"),
        tx.filled(message, **values).alias("message"),
        F.lit(suggestion).alias("suggestion"),
    )


def python_suggestions(content: Column) -> Column:
    def has(text: str) -> Column:
        return F.contains(content, F.lit(text))

    return F.array_compact(
        F.array(
            F.when(has("import *"), _suggestion(fv.WILDCARD_IMPORT)),
            F.when(has("except:") & ~has("except Exception:"), _suggestion(fv.BARE_EXCEPT)),
        )
    )


def script_suggestions(content: Column) -> Column:
    loose, strict = F.contains(content, F.lit("==")), F.contains(content, F.lit("==="))
    return F.array_compact(F.array(F.when(loose & ~strict, _suggestion(fv.LOOSE_EQUALITY))))


def with_functions(files: DataFrame) -> DataFrame:
    """Adds ``functions``: array<struct<name, pos, length>> of each file. No shuffle.

    The three steps are separate projections because each array is read several
    times by the next one.
    """
    return (
        files.withColumn("_lines", tx.lines(F.col("content")))
        .withColumn("_defs", tx.function_definitions(F.col("_lines")))
        .withColumn("_indents", tx.line_indents(F.col("_lines")))
        .withColumn("functions", tx.function_lengths(F.col("_defs"), F.col("_indents")))
        .drop("_lines", "_defs", "_indents")
    )


def function_table(files: DataFrame) -> DataFrame:
    """One row per function name: file_id, function_name, length."""
    return (
        with_functions(files.select("file_id", "content"))
        .select("file_id", F.explode_outer("functions").alias("f"))
        .filter(F.col("f").isNotNull())
        .select("file_id", F.col("f.name").alias("function_name"), "f.length")
    )


def long_function_suggestions(functions: DataFrame) -> DataFrame:
    """A refactoring suggestion per function over the limit."""
    said = _suggestion(fv.LONG_FUNCTION, name=F.col("function_name"), length=F.col("length"))
    return functions.filter(F.col("length") > fv.MAX_FUNCTION_LINES).select(
        "file_id", "function_name", said.alias("s")
    ).select("file_id", "function_name", "s.*")


def best_practice_issues(files: DataFrame) -> DataFrame:
    """Language conventions: wanted imports and words, unwanted words, names, line limits.

    File-level findings carry line 0. Each wanted import or word that a file lacks is one finding.
    """
    language, content = F.col("language"), F.col("content")

    def file_check(lang: str, rule: str, broken: Column, message: str) -> Column:
        return F.when(
            (language == lang) & broken,
            F.struct(F.lit(f"{lang}.{rule}").alias("rule_id"), F.lit(message).alias("message")),
        )

    checks = []
    for lang, names in fv.WANTED_IMPORTS.items():
        for name in names:
            pattern = rf"(^|\n){fv.SPACE}*(import|from){fv.SPACE}+{name}($|[^\p{{L}}\p{{N}}_])"
            found = F.contains(content, F.lit(name)) & content.rlike(pattern)
            checks.append(file_check(lang, f"import.{name}", ~found, f"Missing import: {name}"))
    for lang, words in fv.WANTED_WORDS.items():
        for word in words:
            checks.append(file_check(lang, f"wanted.{word}", ~F.contains(content, F.lit(word)),
                                     f"Expected to use: {word}"))
    whole_file = (
        files.select("file_id", F.explode_outer(F.array_compact(F.array(*checks))).alias("c"))
        .filter(F.col("c").isNotNull())
        .select("file_id", F.lit(0).alias("line"), "c.rule_id", "c.message")
    )

    def name(line: Column) -> Column:
        return tx.def_name(line)

    line_rules = [
        LineRule(f"{lang}.unwanted.{word}", "", "", _matches_any([rf"(^|[^\p{{L}}\p{{N}}_]){word}{fv.SPACE}+"], needs=word),
                 _says(f"Avoid: {word}"), "", (lang,))
        for lang, words in fv.UNWANTED_WORDS.items() for word in words
    ]
    line_rules += [
        LineRule(f"{lang}.line_limit", "", "", (lambda n: lambda l: F.length(l) > n)(limit),
                 _says(f"Line longer than {limit}"), "", (lang,))
        for lang, limit in fv.LINE_LIMITS.items()
    ]
    line_rules.append(
        LineRule("python.naming", "", "",
                 lambda l: (name(l) != "") & ~name(l).rlike(fv.SNAKE_CASE_PATTERN),
                 lambda l: F.concat(F.lit("Name is not snake_case: "), name(l)), "", ("python",))
    )
    by_line = scan_lines(files, line_rules).select("file_id", "line", "rule_id", "message")
    return whole_file.unionByName(by_line)
