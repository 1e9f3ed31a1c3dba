"""Model answers to tables.

An answer is JSON, free text, or missing. JSON becomes a variant once and its
fields are read with the ``try_`` forms: a malformed answer gives defaults, it
never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom import fixed_values as fv

ISSUE_FIELDS = {
    "type": "string", "severity": "string", "title": "string", "message": "string",
    "description": "string", "line": "int", "column": "int", "rule_id": "string",
    "suggestion": "string", "recommendation": "string", "confidence": "string",
    "tags": "array<string>", "references": "array<string>",
}
SUGGESTION_FIELDS = {
    "type": "string", "priority": "string", "title": "string", "description": "string",
    "message": "string", "line": "int", "example": "string",
}


def _is_list(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _read(item: Column, fields: dict[str, str], scalar_field: str) -> Column:
    """A struct of the wanted fields; a plain value lands in ``scalar_field``."""

    def field(name: str, kind: str) -> Column:
        value = F.try_variant_get(item, f"$.{name}", kind)
        if name == scalar_field:
            value = F.when(_is_object(item), value).otherwise(F.try_variant_get(item, "$", "string"))
        return value.alias(name)

    return F.struct(*[field(name, kind) for name, kind in fields.items()])


def _items(value: Column) -> Column:
    """array<variant>: a list as it is, anything else as its single element."""
    return F.when(_is_list(value), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def _literal(values: dict, fields: dict[str, str]) -> Column:
    return F.struct(
        *[
            (values[name] if isinstance(values.get(name), Column) else F.lit(values.get(name))).cast(kind).alias(name)
            for name, kind in fields.items()
        ]
    )


def _with_parsed(responses: DataFrame) -> DataFrame:
    answer = F.col("answer")
    state = (
        F.when(answer.isNull() | (answer == ""), "unavailable")
        .when(F.col("_json").isNull(), "free_text")
        .otherwise("model")
    )
    return responses.withColumn("_json", F.try_parse_json(answer)).withColumn("source", state)


def parse_quality(responses: DataFrame) -> DataFrame:
    """Quality answers: score, issues, suggestions, metrics and where they came from.

    A top-level list counts as the list of issues. Free text becomes the only
    suggestion of a default answer; a missing answer gives the "unavailable" one.
    """
    value, source = F.col("_json"), F.col("source")
    no_issues = F.array().cast(f"array<struct<{', '.join(f'`{n}`: {t}' for n, t in ISSUE_FIELDS.items())}>>")
    no_suggestions = F.array().cast(
        f"array<struct<{', '.join(f'`{n}`: {t}' for n, t in SUGGESTION_FIELDS.items())}>>"
    )

    def read_issue(item: Column) -> Column:
        return _read(item, ISSUE_FIELDS, "message")

    def read_suggestion(item: Column) -> Column:
        return _read(item, SUGGESTION_FIELDS, "description")

    listed = F.when(_is_list(value), F.try_variant_get(value, "$", "array<variant>")).otherwise(
        F.try_variant_get(value, "$.issues", "array<variant>")
    )
    free_suggestion = F.array(_literal({"description": F.col("answer")}, SUGGESTION_FIELDS))
    missing_suggestion = F.array(_literal(fv.UNAVAILABLE_SUGGESTION, SUGGESTION_FIELDS))

    def metric(name: str) -> Column:
        read = F.try_variant_get(value, f"$.metrics.{name}", "double")
        return (
            F.when(source == "model", read)
            .when(source == "free_text", F.lit(float(fv.FREE_TEXT_METRICS[name])))
            .otherwise(F.lit(0.0))
        ).alias(name)

    return _with_parsed(responses).withColumns(
        {
            "score": F.when(source == "model", F.try_variant_get(value, "$.score", "double"))
            .when(source == "free_text", F.lit(fv.FREE_TEXT_SCORE)).otherwise(F.lit(0.0)),
            "issues": F.coalesce(F.when(source == "model", F.transform(listed, read_issue)), no_issues),
            "suggestions": F.when(source == "free_text", free_suggestion)
            .when(source == "unavailable", missing_suggestion)
            .otherwise(
                F.coalesce(
                    F.transform(F.try_variant_get(value, "$.suggestions", "array<variant>"), read_suggestion),
                    no_suggestions,
                )
            ),
            "metrics": F.struct(metric("maintainability"), metric("readability"), metric("complexity")),
        }
    ).drop("_json")


def _parse_list(responses: DataFrame, fields: dict[str, str], scalar_field: str, wrapped: dict) -> DataFrame:
    value, source = F.col("_json"), F.col("source")
    items = F.when(
        source == "model", F.transform(_items(value), lambda item: _read(item, fields, scalar_field))
    ).when(source == "free_text", F.array(_literal(wrapped, fields)))
    parsed = _with_parsed(responses).withColumn("item", F.explode_outer(items)).filter(
        F.col("item").isNotNull()
    )
    return parsed.select(*[c for c in responses.columns if c != "answer"], "source", "item.*")


def parse_security(responses: DataFrame) -> DataFrame:
    """One raw issue row per finding; none for a missing answer."""
    wrapped = {"type": "info", "severity": "medium", "title": "Security Analysis",
               "description": F.col("answer"), "line": 1}
    return _parse_list(responses, ISSUE_FIELDS, "message", wrapped)


def parse_suggestions(responses: DataFrame) -> DataFrame:
    """One row per suggestion; none for a missing answer."""
    wrapped = {"type": "improvement", "priority": "medium", "title": "Code Improvement",
               "description": F.col("answer"), "line": 1}
    return _parse_list(responses, SUGGESTION_FIELDS, "description", wrapped)


def default_quality(files: DataFrame, responses: DataFrame, key: str = "file_id") -> DataFrame:
    """Parsed quality answers for all files; files without an answer get the unavailable one."""
    answers = responses.select(key, "answer")
    return parse_quality(files.select(key).join(answers, key, "left"))


def merge_block_metrics(quality: DataFrame, metrics: DataFrame, key: str = "file_id") -> DataFrame:
    """Quality answers updated with the measured block similarity, which wins."""
    measured = metrics.select(
        key,
        F.col("duplicates_found").alias("semantic_duplicates"),
        "duplication_score",
        F.col("total_blocks").alias("code_blocks_analyzed"),
    )
    plain = quality.drop("semantic_duplicates", "duplication_score", "code_blocks_analyzed")
    return plain.join(measured, key, "left").na.fill(
        {"semantic_duplicates": 0, "duplication_score": 0.0, "code_blocks_analyzed": 0}
    )
