"""Declared schemas (as DDL); every boundary reads with one of these, none is inferred."""

# What a pull-request landing file holds.
PULL_REQUEST_JSON = (
    "id BIGINT, number INT, title STRING, body STRING, state STRING, html_url STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, user STRUCT<login: STRING, id: BIGINT>, "
    "head STRUCT<sha: STRING, ref: STRING>, base STRUCT<sha: STRING, ref: STRING>, "
    "changed_files INT, additions INT, deletions INT, commits INT, "
    "_metadata STRUCT<owner: STRING, repo: STRING, fetched_at: DOUBLE>"
)

# One landing line per page of changed files.
PR_FILES_PAGE_JSON = (
    "pr_id STRING, page INT, files ARRAY<STRUCT<filename: STRING, status: STRING, additions: INT, "
    "deletions: INT, changes: INT, patch: STRING, content: STRING>>"
)

FILE_CONTENT_JSON = ("pr_id STRING, filename STRING, encoding STRING, content STRING")

REPOSITORY_JSON = (
    "owner STRING, repo STRING, language STRING, stargazers_count INT, default_branch STRING, private BOOLEAN"
)

WEBHOOK_JSON = (
    "action STRING, pull_request STRUCT<id: BIGINT, number: INT, title: STRING, state: STRING, "
    "user: STRUCT<login: STRING>, head: STRUCT<sha: STRING, ref: STRING>, base: STRUCT<sha: STRING, ref: STRING>>, "
    "repository STRUCT<html_url: STRING, name: STRING>, sender STRUCT<login: STRING>"
)

TASKS = (
    "id STRING, repo_url STRING, repo_owner STRING, repo_name STRING, pr_number INT, status STRING, "
    "priority STRING, progress INT, started_at TIMESTAMP, completed_at TIMESTAMP, error_message STRING, "
    "error_details MAP<STRING, STRING>, retry_count INT, max_retries INT, config MAP<STRING, STRING>, "
    "worker_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)

PR_ANALYSES = (
    "id STRING, task_id STRING, status STRING, pr_title STRING, pr_author STRING, pr_url STRING, "
    "base_branch STRING, head_branch STRING, analysis_started_at TIMESTAMP, analysis_completed_at TIMESTAMP, "
    "total_files_analyzed BIGINT, total_lines_analyzed BIGINT, total_issues_found BIGINT, "
    "critical_issues BIGINT, high_issues BIGINT, medium_issues BIGINT, low_issues BIGINT, info_issues BIGINT, "
    "quality_score DOUBLE, recommendations ARRAY<STRING>"
)

FILE_ANALYSES = (
    "id STRING, pr_analysis_id STRING, file_path STRING, file_name STRING, file_extension STRING, "
    "file_type STRING, analysis_status STRING, lines_total BIGINT, lines_analyzed BIGINT, lines_added BIGINT, "
    "lines_removed BIGINT, complexity_score DOUBLE, maintainability_index DOUBLE, issues_count BIGINT, "
    "critical_issues_count BIGINT, analysis_tools_used ARRAY<STRING>, diff_content STRING, "
    "ai_recommendations ARRAY<STRUCT<type: STRING, priority: STRING, title: STRING, description: STRING, "
    "line: BIGINT, example: STRING>>"
)

ISSUES = (
    "id STRING, pr_analysis_id STRING, file_analysis_id STRING, issue_type STRING, severity STRING, "
    "title STRING, description STRING, file_path STRING, line_number INT, column_number INT, rule_id STRING, "
    "suggestion STRING, confidence DOUBLE, tags ARRAY<STRING>, references ARRAY<STRING>"
)

TASK_EVENTS = (
    "task_id STRING, seq BIGINT, ts TIMESTAMP, state STRING, progress INT, stage STRING, message STRING"
)
