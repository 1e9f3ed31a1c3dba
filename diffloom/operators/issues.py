"""Issue streams: concatenation, normalisation, filtering, per-file limits and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions import normalize as nz
from diffloom.operators.rules import SECURITY_FAMILIES

RAW_FIELDS = {
    "type": "string", "severity": "string", "title": "string", "message": "string",
    "description": "string", "line": "int", "column": "int", "rule_id": "string",
    "suggestion": "string", "recommendation": "string", "confidence": "string",
    "tags": "array<string>", "references": "array<string>",
}


def with_raw_fields(issues: DataFrame) -> DataFrame:
    """Gives a raw issue table all optional fields, null where it lacks them."""
    missing = {n: F.lit(None).cast(t) for n, t in RAW_FIELDS.items() if n not in issues.columns}
    return issues.withColumns(missing) if missing else issues


def concat_issues(**by_source: DataFrame) -> DataFrame:
    """Union of issue tables, duplicates kept, each row tagged with its source."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in by_source.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def normalise_issues(issues: DataFrame) -> DataFrame:
    """Raw issue rows to stored issue rows; raw type and severity are kept beside the new ones."""
    raw = with_raw_fields(issues)
    kept = [c for c in raw.columns if c not in RAW_FIELDS]
    empty_list = F.array().cast("array<string>")
    return raw.select(
        *kept,
        F.col("type").alias("raw_type"),
        F.col("severity").alias("raw_severity"),
        nz.issue_type(F.col("type")).alias("issue_type"),
        nz.severity(F.col("severity")).alias("severity"),
        F.coalesce("title", "message", F.lit("Unknown issue")).alias("title"),
        F.coalesce("message", "description", F.lit("")).alias("description"),
        F.coalesce("line", F.lit(0)).alias("line_number"),
        F.coalesce("column", F.lit(0)).alias("column_number"),
        F.coalesce("rule_id", F.lit("")).alias("rule_id"),
        F.coalesce("suggestion", "recommendation", F.lit("")).alias("suggestion"),
        nz.confidence(F.col("confidence")).alias("confidence"),
        F.coalesce("tags", empty_list).alias("tags"),
        F.coalesce("references", empty_list).alias("references"),
    ).withColumn("sev_rank", nz.severity_rank(F.col("severity")))


def filter_by_config(issues: DataFrame, configs: DataFrame, key: str = "task_id") -> DataFrame:
    """Keep what a task's configuration asks for.

    ``configs`` has one row per task: include_style_issues, include_security_issues,
    include_performance_issues, include_best_practices, severity_threshold. Tasks
    without a row get the defaults. The join side is left to the optimizer.
    """
    joined = issues.join(configs, key, "left")
    kind = F.col("issue_type")

    def allowed(flag: str, name: str) -> Column:
        return (kind != name) | F.coalesce(F.col(flag), F.lit(True))

    threshold = nz.severity_rank(F.coalesce("severity_threshold", F.lit("low")))
    return joined.filter(
        allowed("include_style_issues", "style")
        & allowed("include_security_issues", "security")
        & allowed("include_performance_issues", "performance")
        & allowed("include_best_practices", "best_practice")
        & (F.col("sev_rank") >= threshold)
    ).select(*issues.columns)


def limit_per_file(issues: DataFrame, max_issues: int, key: str = "file_id",
                   tie_break: tuple[str, ...] = ("issue_id",)) -> DataFrame:
    """The first ``max_issues`` issues per file, worst first.

    Spark trims every group inside each map task before the shuffle, so a hot
    file never arrives whole in one task.
    """
    if max_issues < 1:
        raise ValueError("max_issues must be at least 1")
    worst_first = Window.partitionBy(key).orderBy(F.desc("sev_rank"), "line_number", "rule_id", *tie_break)
    return issues.withColumn("issue_rank", F.row_number().over(worst_first)).filter(
        F.col("issue_rank") <= max_issues
    )


def is_security(issue_type: Column, raw_type: Column) -> Column:
    return (issue_type == "security") | F.startswith(raw_type, F.lit("security")) | raw_type.isin(*SECURITY_FAMILIES)


def _count_conditions(issue) -> dict[str, Column]:
    """The counts a file row needs, as conditions on one raw issue (``issue["severity"]`` and so on)."""
    level, kind, from_security = issue["severity"], issue["type"], issue["source"] == "security"
    grave = level.isin("critical", "high")
    return {
        "issues_count": F.lit(True),
        "critical_issues_count": grave,
        "high_count": level == "high",
        "medium_count": level == "medium",
        "only_critical_count": level == "critical",
        "security_found": from_security,
        "security_grave": from_security & grave,
        "security_high": from_security & (level == "high"),
        "security_medium": from_security & (level == "medium"),
        "security_issues_count": F.coalesce(is_security(nz.issue_type(kind), kind), F.lit(False)),
    }


def count_by_file(issues: DataFrame, key: str = "file_id") -> DataFrame:
    """All issue counts a file row needs, from raw severities, in one aggregate.

    ``source`` tells security findings from others. Map-side combine keeps a hot
    file at one partial row per task.
    """
    columns = {name: F.col(name) for name in ("severity", "type", "source")}
    return issues.groupBy(key).agg(
        *[F.count_if(condition).alias(name) for name, condition in _count_conditions(columns).items()]
    )


def counts_in_row(found: Column) -> dict[str, Column]:
    """The same counts over an array of raw issues in the file's own row: no shuffle at all.

    Issues are security findings if their rule id says so.
    """

    def total(name: str) -> Column:
        def holds(item: Column) -> Column:
            origin = F.when(F.startswith(item["rule_id"], F.lit("security.")), "security").otherwise("quality")
            issue = {"severity": item["severity"], "type": item["type"], "source": origin}
            return _count_conditions(issue)[name]

        return F.size(F.filter(found, holds)).cast("bigint")

    names = _count_conditions({"severity": F.lit(""), "type": F.lit(""), "source": F.lit("")})
    return {name: F.size(found).cast("bigint") if name == "issues_count" else total(name) for name in names}
