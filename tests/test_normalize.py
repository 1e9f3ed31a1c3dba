import pytest
from pyspark.sql import functions as F

from diffloom.functions import diffs as dx
from diffloom.functions import normalize as nz
from diffloom.operators import diffs, issues, quality, scores


@pytest.mark.parametrize(
    "url, owner, repo",
    [
        ("https://github.com/owner/repo", "owner", "repo"),
        ("https://github.com/owner/repo/", "owner", "repo"),
        ("https://github.com/own.er/re_po-1.git", "own.er", "re_po-1"),
        ("git@github.com:owner/repo.git", "owner", "repo"),
        ("https://gitlab.com/owner/repo", None, None),
        ("https://github.com/owner", None, None),
        ("not a url", None, None),
        ("", None, None),
    ],
)
def test_repo_urls(evaluate, url, owner, repo):
    found = evaluate(nz.split_repo_url_lenient(F.col("x")), x=url)
    assert (found["owner"], found["repo"]) == (owner, repo) if owner else found is None
    assert evaluate(nz.is_repo_url(F.col("x")), x=url) is (owner is not None)


def test_strict_split_keeps_suffix(evaluate):
    assert evaluate(nz.split_repo_url(F.col("x")), x="https://github.com/a/b.git")["repo"] == "b.git"
    assert evaluate(nz.split_repo_url(F.col("x")), x="https://github.com/a/b/pull/1") is None


@pytest.mark.parametrize(
    "raw, expected",
    [("xss", "bug"), ("typing", "bug"), ("warning", "best_practice"), ("info", "style"), ("quality", "maintainability"),
     ("security", "security"), (None, "bug"), ("error", "bug")],
)
def test_issue_type(evaluate, raw, expected):
    assert evaluate(nz.issue_type(F.col("x")), x=raw) == expected


@pytest.mark.parametrize(
    "raw, expected, rank",
    [("error", "high", 3), ("warning", "medium", 2), ("info", "info", 0), ("critical", "critical", 4), ("odd", "low", 1), (None, "low", 1)],
)
def test_severity(evaluate, raw, expected, rank):
    level = nz.severity(F.col("x"))
    assert evaluate(level, x=raw) == expected
    assert evaluate(nz.severity_rank(level), x=raw) == rank


def test_issue_projection(spark):
    raw = spark.createDataFrame(
        [(1, "xss", None, None, None, "text", "abc", "fix it")],
        "file_id int, type string, severity string, title string, message string, description string, confidence string, recommendation string",
    )
    row = issues.normalise_issues(raw).first()
    assert (row["title"], row["description"], row["confidence"], row["suggestion"]) == ("Unknown issue", "text", 0.5, "fix it")
    assert (row["issue_type"], row["raw_type"], row["severity"], row["line_number"]) == ("bug", "xss", "low", 0)
    assert row["tags"] == [] and row["references"] == []


def test_location(evaluate):
    loc = nz.location(F.col("p"), F.col("l"), F.col("c"))
    schema = "p string, l int, c int"
    assert evaluate(loc, schema, p="a.py", l=3, c=7) == "a.py:line 3:column 7"
    assert evaluate(loc, schema, p="a.py", l=0, c=7) == "a.py"
    assert evaluate(loc, schema, p=None, l=None, c=1) == "unknown location"


def test_request_reasons(spark):
    rows = spark.createDataFrame(
        [(1, "https://github.com/a/b", 5, None), (2, "http://x.y", 0, "asap"), (3, None, None, "low")],
        "id int, repo_url string, pr_number int, priority string",
    )
    accepted, refused = quality.validate_requests(rows)
    assert [(r["id"], r["priority"], r["repo_owner"]) for r in accepted.collect()] == [(1, "normal", "a")]
    assert {r["id"]: r["reasons"] for r in refused.collect()} == {
        2: ["repo_url", "pr_number", "priority"], 3: ["repo_url", "pr_number"],
    }


PATCH = "\n".join(
    ["@@ -1,5 +1,8 @@", " class User:", "-    def validate_token(self):", "+    def validate_token(self, token):",
     "+    def is_admin(self):", "+        return False", "--- a/x", "+++ b/x"]
)


def test_diff_impact(spark):
    files = spark.createDataFrame(
        [(1, "auth/models.py", "modified", 25, 5, PATCH), (2, "a.py", "added", 1, 0, ""), (3, "b.py", None, None, None, None)],
        "file_id int, path string, status string, additions int, deletions int, patch string",
    )
    rows = {r["file_id"]: r for r in diffs.diff_impact(files).collect()}
    first = rows[1]
    assert (first["lines_added"], first["lines_removed"], first["net_lines"]) == (3, 1, 2)
    assert first["affected_functions"] == ["is_admin", "validate_token"]
    assert (first["impact_score"], first["risk_level"], first["change_type"]) == (33, "low", "mostly_additions")
    for other in (rows[2], rows[3]):
        assert (other["impact_score"], other["risk_level"], other["change_type"]) == (0, "low", "no_changes")


@pytest.mark.parametrize(
    "line, name",
    [("def hello_world():", "hello_world"), ("async def go(self):", "go"), ("function doIt() {", "doIt"),
     ("class Thing:", "Thing"), ("x = 1", "unknown")],
)
def test_symbol_name(evaluate, line, name):
    assert evaluate(dx.symbol_name(F.col("x")), x=line) == name


@pytest.mark.parametrize("path, counts, expected", [("README.md", (2, 1, 0), 3), ("engine.py", (50, 30, 5), 100), ("a.go", (1, 2, 1), 16)])
def test_impact_score(evaluate, path, counts, expected):
    score = dx.impact_score(F.col("a"), F.col("r"), F.col("f"), F.col("p"))
    assert evaluate(score, "a int, r int, f int, p string", a=counts[0], r=counts[1], f=counts[2], p=path) == expected


@pytest.mark.parametrize(
    "score, path, status, expected",
    [(15, "src/a.py", "modified", "low"), (45, "src/a.py", "modified", "medium"), (85, "src/a.py", "modified", "high"),
     (45, "src/a.py", "added", "low"), (60, "src/a.py", "added", "medium"), (10, "a.py", "removed", "medium"),
     (40, "a.py", "removed", "high"), (90, "tests/a.py", "modified", "medium"), (40, "Spec.js", None, "low"),
     (10, "settings.py", "modified", "medium"), (40, ".env", "modified", "high"), (99, "test_config.py", "added", "medium")],
)
def test_risk_level(evaluate, score, path, status, expected):
    level = dx.risk_level(F.col("s"), F.col("p"), F.col("t"))
    assert evaluate(level, "s int, p string, t string", s=score, p=path, t=status) == expected


@pytest.mark.parametrize(
    "status, plus, minus, expected",
    [("added", 1, 1, "new_file"), ("removed", 0, 1, "deleted_file"), ("renamed", 0, 0, "renamed_file"),
     ("modified", 3, 0, "additions_only"), ("modified", 0, 0, "additions_only"), ("modified", 0, 3, "deletions_only"),
     ("modified", 10, 3, "mostly_additions"), ("modified", 3, 10, "mostly_deletions"), ("modified", 9, 3, "mixed_changes")],
)
def test_change_type(evaluate, status, plus, minus, expected):
    kind = dx.change_type(F.col("s"), F.col("a"), F.col("d"))
    assert evaluate(kind, "s string, a int, d int", s=status, a=plus, d=minus) == expected


@pytest.mark.parametrize(
    "levels, maintainability, complexity, duplication, expected",
    [(["low", "medium"], 85, 5, 0.1, 77), (["critical", "high", "medium"], 30, 20, 0.6, 0), ([], 100, 5, 0.0, 100), (["high"], 100, 16, 0.0, 68)],
)
def test_scores(spark, levels, maintainability, complexity, duplication, expected):
    found = spark.createDataFrame(
        [(1, "x", level, "quality") for level in levels], "file_id int, type string, severity string, source string"
    )
    files = spark.createDataFrame(
        [(1, maintainability, complexity, duplication)],
        "file_id int, maintainability_score int, complexity_score int, duplication_score double",
    )
    row = scores.score_files(files, issues.count_by_file(found)).first()
    assert row["quality_score"] == expected
    assert row["security_score"] == 100


def test_security_score(evaluate):
    score = scores.security_score(F.col("g"), F.col("h"), F.col("m"))
    assert evaluate(score, "g int, h int, m int", g=2, h=1, m=1) == 0
    assert evaluate(score, "g int, h int, m int", g=0, h=0, m=2) == 80


def test_pr_summary(spark):
    rows = [(1, 85, 2, 1, 1), (1, 70, 0, 0, 0), (1, 90, 1, 0, 0), (2, 60, 0, 0, 0), (3, 80, 0, 0, 0)]
    rows += [(4, 90, 0, 0, 0)] * 21
    scored = spark.createDataFrame(
        rows, "pr_id int, quality_score bigint, issues_count bigint, only_critical_count bigint, security_issues_count bigint"
    )
    found = {r["pr_id"]: r for r in scores.summarise_prs(scored).collect()}
    assert (found[1]["overall_score"], found[1]["overall_quality"]) == (81, "needs_work")
    assert found[1]["recommendations"] == ["Address 1 critical security issues immediately"]
    assert found[2]["recommendations"] == ["Consider refactoring to improve code quality"] and found[2]["overall_quality"] == "fair"
    assert found[3]["overall_quality"] == "good" and found[3]["recommendations"][0].startswith("Code looks good!")
    assert found[4]["recommendations"] == ["Large PR - consider breaking into smaller changes"]


def test_counts_in_row_equal_counts_by_table(spark):
    from diffloom.plans import review

    files = spark.createDataFrame(
        [(1, 1, "a.py", 'def f():\n  token = "x"\n  eval(q)'), (2, 1, "b.js", "var a\n" * 3), (3, 1, "c.md", "")],
        "file_id int, pr_id int, path string, content string",
    ).withColumns({"additions": F.lit(1), "deletions": F.lit(1)})
    reviewed = review.review_files(files)
    by_table = {r["file_id"]: r.asDict() for r in issues.count_by_file(review.issue_rows(reviewed)).collect()}
    for row in reviewed.collect():
        expected = by_table.get(row["file_id"], {})
        assert all(row[name] == expected.get(name, 0) for name in scores.COUNTS)
