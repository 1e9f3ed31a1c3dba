"""Diff expressions: one patch is one row, so nothing here needs a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffloom import fixed_values as fv


def line_kind(line: Column) -> Column:
    """added, removed or context; the +++ and --- header lines are context."""
    return (
        F.when(F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++")), F.lit("added"))
        .when(F.startswith(line, F.lit("-")) & ~F.startswith(line, F.lit("---")), F.lit("removed"))
        .otherwise(F.lit("context"))
    )


def symbol_name(line: Column) -> Column:
    found = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in fv.SYMBOL_PATTERNS]
    return F.coalesce(*found, F.lit("unknown"))


def names_symbol(line: Column) -> Column:
    return (
        F.contains(line, F.lit("def ")) | F.contains(line, F.lit("function ")) | F.contains(line, F.lit("class "))
    )


def affected_functions(changed_lines: Column) -> Column:
    """Sorted distinct symbol names on added and removed lines."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(changed_lines, names_symbol), symbol_name)))


def _ends_with_any(text: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(text, F.lit(s)) for s in suffixes])


def _contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def impact_score(added: Column, removed: Column, functions: Column, path: Column) -> Column:
    base = ((added + removed) * 2 + functions * 10).cast("double")
    weight = (
        F.when(_ends_with_any(path, fv.SOURCE_SUFFIXES), F.lit(1.2))
        .when(_ends_with_any(path, fv.DOCUMENT_SUFFIXES), F.lit(0.5))
        .otherwise(F.lit(1.0))
    )
    return F.least((base * weight).cast("bigint"), F.lit(100))


def risk_level(score: Column, path: Column, status: Column) -> Column:
    """Status rules come before path rules; the first that applies decides."""
    base = F.when(score >= 70, "high").when(score >= 35, "medium").otherwise("low")
    lowered = F.lower(path)
    state = F.coalesce(status, F.lit("modified"))
    return (
        F.when((state == "added") & (score < 50), "low")
        .when((state == "removed") & (base == "low"), "medium")
        .when(state == "removed", "high")
        .when(_contains_any(lowered, fv.TEST_WORDS), F.when(base == "high", "medium").otherwise("low"))
        .when(_contains_any(lowered, fv.CONFIG_WORDS), F.when(base == "low", "medium").otherwise("high"))
        .otherwise(base)
    )


def change_type(status: Column, additions: Column, deletions: Column) -> Column:
    state = F.coalesce(status, F.lit("modified"))
    plus, minus = F.coalesce(additions, F.lit(0)), F.coalesce(deletions, F.lit(0))
    return (
        F.when(state == "added", "new_file")
        .when(state == "removed", "deleted_file")
        .when(state == "renamed", "renamed_file")
        .when(minus == 0, "additions_only")
        .when(plus == 0, "deletions_only")
        .when(plus > minus * 3, "mostly_additions")
        .when(minus > plus * 3, "mostly_deletions")
        .otherwise("mixed_changes")
    )
