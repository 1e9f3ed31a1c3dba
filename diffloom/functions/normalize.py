"""Field normalisation, validation and lifecycle predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffloom import fixed_values as fv
from diffloom.functions.text import strip


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


# --- repository addresses ---------------------------------------------------------


def is_repo_url(url: Column) -> Column:
    """Strict form: https with owner and repository, or the ssh form ending in .git."""
    clean = strip(url)
    return F.coalesce(clean.rlike(fv.HTTPS_REPO_PATTERN) | clean.rlike(fv.SSH_REPO_PATTERN), F.lit(False))


def split_repo_url(url: Column) -> Column:
    """struct<owner, repo> by the strict form, null otherwise. https keeps a .git suffix."""
    clean = strip(url)

    def parts(pattern: str) -> Column:
        return F.struct(
            F.regexp_extract(clean, pattern, 1).alias("owner"),
            F.regexp_extract(clean, pattern, 2).alias("repo"),
        )

    return F.when(clean.rlike(fv.HTTPS_REPO_PATTERN), parts(fv.HTTPS_REPO_PATTERN)).when(
        clean.rlike(fv.SSH_REPO_PATTERN), parts(fv.SSH_REPO_PATTERN)
    )


def split_repo_url_lenient(url: Column) -> Column:
    """struct<owner, repo> from any address on the host; ssh addresses are accepted too.

    The first two path parts count and a .git suffix is dropped, so that both
    splitters name the same repository for ssh addresses.
    """
    clean = strip(url)
    host = F.lower(F.try_parse_url(clean, F.lit("HOST")))
    path = F.split(F.regexp_replace(F.try_parse_url(clean, F.lit("PATH")), "^/+|/+$", ""), "/", -1)
    by_path = F.struct(
        F.get(path, F.lit(0)).alias("owner"),
        F.regexp_replace(F.get(path, F.lit(1)), r"\.git$", "").alias("repo"),
    )
    by_ssh = F.struct(
        F.regexp_extract(clean, fv.SSH_REPO_PATTERN, 1).alias("owner"),
        F.regexp_extract(clean, fv.SSH_REPO_PATTERN, 2).alias("repo"),
    )
    return F.when(clean.rlike(fv.SSH_REPO_PATTERN), by_ssh).when(
        (host == fv.REPO_HOST) & (F.size(path) >= 2), by_path
    )


# --- files ------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """What follows the last dot of the whole path; null without a dot."""
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1))


def language(path: Column) -> Column:
    known = literal_map(fv.LANGUAGE_BY_EXTENSION)
    return F.coalesce(F.try_element_at(known, F.lower(file_extension(path))), F.lit("unknown"))


# --- issues -----------------------------------------------------------------------


def issue_type(raw: Column) -> Column:
    mapping = {kind: kind for kind in fv.ISSUE_TYPES} | fv.ISSUE_TYPE_ALIASES
    return F.coalesce(F.try_element_at(literal_map(mapping), raw), F.lit("bug"))


def severity(raw: Column) -> Column:
    mapping = {level: level for level in fv.SEVERITIES} | fv.SEVERITY_ALIASES
    return F.coalesce(F.try_element_at(literal_map(mapping), raw), F.lit("low"))


def severity_rank(level: Column) -> Column:
    ranks = {name: rank for rank, name in enumerate(fv.SEVERITIES)}
    return F.try_element_at(literal_map(ranks), level)


def confidence(raw: Column) -> Column:
    """A number, or a string holding one; anything else is 0.5."""
    return F.coalesce(raw.try_cast("double"), F.lit(0.5))


def location(path: Column, line: Column, column: Column) -> Column:
    has_line = line.isNotNull() & (line != 0)
    text = F.concat_ws(
        ":",
        F.nullif(path, F.lit("")),
        F.when(has_line, F.concat(F.lit("line "), line.cast("string"))),
        F.when(
            has_line & column.isNotNull() & (column != 0),
            F.concat(F.lit("column "), column.cast("string")),
        ),
    )
    return F.when(text == "", F.lit("unknown location")).otherwise(text)


# --- lifecycle --------------------------------------------------------------------


def task_is_completed(status: Column) -> Column:
    return status.isin("completed", "failed", "cancelled")


def task_is_running(status: Column) -> Column:
    return status == "processing"


def task_can_retry(status: Column, retries: Column, limit: Column) -> Column:
    return (status == "failed") & (retries < limit)


def analysis_is_completed(status: Column) -> Column:
    return status.isin("completed", "failed")


def has_critical(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) > 0


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def stage_progress(position: Column, total: Column) -> Column:
    """Progress while the file at a 0-based position is analysed."""
    return F.lit(30) + (position / total * 50).cast("int")


def clamp_progress(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


# --- validation -------------------------------------------------------------------


def _unless(ok: Column, reason: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason))


def request_reasons(url: Column, pr_number: Column, priority: Column) -> Column:
    """Why a review request is refused; empty when it is fine. A missing priority is allowed."""
    return F.array_compact(
        F.array(
            _unless(is_repo_url(url), "repo_url"),
            _unless(pr_number > 0, "pr_number"),
            _unless(F.coalesce(priority, F.lit("normal")).isin(*fv.TASK_PRIORITIES), "priority"),
        )
    )


def _if_present(value: Column, ok: Column, reason: str) -> Column:
    return F.when(value.isNotNull() & ~ok, F.lit(reason))


def record_reasons(
    progress: Column, confidence_value: Column, complexity: Column, score: Column, max_issues: Column
) -> Column:
    """Range checks on result records; a missing value is not a violation."""
    return F.array_compact(
        F.array(
            _if_present(progress, progress.between(0, 100), "progress"),
            _if_present(confidence_value, confidence_value.between(0, 1), "confidence"),
            _if_present(complexity, complexity >= 0, "complexity_score"),
            _if_present(score, score.between(0, 100), "overall_score"),
            _if_present(max_issues, max_issues.between(1, 200), "max_issues_per_file"),
        )
    )
