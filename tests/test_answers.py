"""Landing files, prompts and model answers."""

import base64
import json

from pyspark.sql import functions as F

from diffloom import fixed_values as fv
from diffloom.operators import issues, prompts, quality
from diffloom.operators import responses as rp
from diffloom.plans import review
from diffloom.sources import landing
from diffloom.streaming import lifecycle as stream


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id int, answer string")


def test_quality_answers(spark):
    rows = rp.parse_quality(
        answers(
            spark,
            json.dumps({"score": 6, "issues": [{"type": "bug", "line": "12"}, "plain", 5], "suggestions": ["s", {"title": "t"}],
                        "metrics": {"maintainability": 3}}),
            '[{"message": "listed"}]', "free words", "", None, '{"score": "odd"}', "null", "{broken",
        )
    ).orderBy("file_id").collect()
    assert [r["source"] for r in rows] == ["model", "model", "free_text", "unavailable", "unavailable", "model", "model", "free_text"]
    first = rows[0]
    assert first["score"] == 6.0 and first["metrics"]["maintainability"] == 3.0 and first["metrics"]["complexity"] is None
    assert [(i["type"], i["line"], i["message"]) for i in first["issues"]] == [("bug", 12, None), (None, None, "plain"), (None, None, "5")]
    assert [(s["description"], s["title"]) for s in first["suggestions"]] == [("s", None), (None, "t")]
    assert [i["message"] for i in rows[1]["issues"]] == ["listed"]
    free, missing = rows[2], rows[3]
    assert (free["score"], free["suggestions"][0]["description"], free["metrics"]["readability"]) == (7.5, "free words", 7.0)
    assert (missing["score"], missing["issues"], missing["suggestions"][0]["type"]) == (0.0, [], "configuration")
    assert rows[5]["score"] is None


def test_security_and_suggestion_answers(spark):
    texts = ('[{"type": "xss"}, {"type": "sql_injection", "severity": "high", "tags": ["a"]}]', '{"type": "one"}', "words", None)
    found = rp.parse_security(answers(spark, *texts)).collect()
    assert sorted((r["file_id"], r["type"]) for r in found) == [(0, "sql_injection"), (0, "xss"), (1, "one"), (2, "info")]
    stored = issues.normalise_issues(rp.parse_security(answers(spark, *texts))).filter("file_id = 2").first()
    assert (stored["issue_type"], stored["severity"], stored["description"], stored["line_number"]) == ("style", "medium", "words", 1)
    suggestions = rp.parse_suggestions(answers(spark, *texts)).collect()
    assert [r["title"] for r in suggestions if r["source"] == "free_text"] == ["Code Improvement"]


def test_prompt_layout(spark):
    files = spark.createDataFrame([(1, "a.py", "python", "x = 1")], "file_id int, path string, language string, content string")
    requests = prompts.request_table(files).collect()
    assert [r["operation"] for r in requests] == ["analyze_code_quality", "analyze_security", "generate_suggestions"]
    text = requests[0]["prompt"]
    assert text.startswith("\nAnalyze the following python code for quality metrics and issues:\n\nFile: a.py\n\n```python\nx = 1\n```\n\nProvide")
    assert text.endswith("- Documentation quality\n")
    assert requests[1]["temperature"] == fv.TEMPERATURE and requests[1]["max_tokens"] == fv.MAX_TOKENS


def test_requests_as_lines_and_reviewer(spark, tmp_path):
    files = spark.createDataFrame([(n, "a.py", "python", f"x{n}") for n in range(5)], "file_id int, path string, language string, content string")
    requests = prompts.request_table(files)
    prompts.write_requests(requests, str(tmp_path / "requests"))
    assert spark.read.schema(requests.schema).json(str(tmp_path / "requests")).exceptAll(requests).count() == 0

    def reviewer(systems, texts):
        if any("x3" in t for t in texts):
            raise RuntimeError("refused")
        return [json.dumps({"score": 5})] * len(texts)

    got = prompts.run_reviewer(requests, reviewer).groupBy("file_id").agg(F.count("answer").alias("n")).collect()
    assert {r["file_id"]: r["n"] for r in got} == {0: 3, 1: 3, 2: 3, 3: 0, 4: 3}
    assert prompts.run_reviewer(requests).filter("answer is not null").count() == 0


def test_parsed_answers_join_the_review(spark):
    files = spark.createDataFrame(
        [(1, 7, "a.py", "x"), (2, 7, "b.py", "y")], "file_id int, pr_id int, path string, content string"
    ).withColumns({"additions": F.lit(1), "deletions": F.lit(0)})
    found = rp.parse_security(answers(spark, None, '[{"type": "security", "severity": "critical"}]')).withColumn("source", F.lit("security"))
    rows = {r["file_id"]: r for r in review.review_files(files, extra_issues=found).collect()}
    assert (rows[1]["security_score"], rows[1]["quality_score"], rows[1]["issues_count"]) == (60, 80, 1)
    assert (rows[2]["security_score"], rows[2]["quality_score"]) == (100, 100)
    tasks = spark.createDataFrame([("t", 7)], "id string, pr_id int").withColumns(
        {"started_at": F.timestamp_seconds(F.lit(0)), "completed_at": F.timestamp_seconds(F.lit(9))}
    )
    tables = review.result_tables(files, tasks)
    assert {n: df.count() for n, df in tables.items()} == {"pr_analyses": 1, "file_analyses": 2, "issues": 0}


def test_landing_files(spark, tmp_path):
    def land(name, *records):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "part.json").write_text("\n".join(json.dumps(r) for r in records))
        return str(folder)

    prs = landing.read_pull_requests(
        spark, land("prs", {"id": 9, "number": 42, "title": "Fix", "user": {"login": "ann"}, "head": {"sha": "h", "ref": "topic"},
                            "base": {"ref": "main"}, "created_at": "2024-01-01T00:00:00Z", "_metadata": {"owner": "o", "repo": "r"}})
    ).first()
    assert (prs["pr_id"], prs["author"], prs["head_ref"], prs["changed_files"], prs["repo_owner"]) == (9, "ann", "topic", 0, "o")

    pages = land("files", {"pr_id": "9", "page": 1, "files": [{"filename": "a.py"}, {"filename": "b.py", "patch": "+x"}]},
                 {"pr_id": "9", "page": 51, "files": [{"filename": "late.py"}]})
    files = landing.read_pr_files(spark, pages)
    assert [(r["file_index"], r["filename"]) for r in files.orderBy("file_index").collect()] == [
        (0, "a.py"), (1, "b.py"), (5000, "late.py")]

    packed = base64.encodebytes("é\nx".encode()).decode()
    fetched = landing.read_file_contents(
        spark, land("contents", {"pr_id": "9", "filename": "a.py", "encoding": "base64", "content": packed})
    )
    contents = landing.attach_contents(files, fetched)
    assert {r["filename"]: r["content"] for r in contents.collect()} == {
        "a.py": "é\nx", "b.py": "", "late.py": ""}

    repos = landing.read_repositories(spark, land("repos", {"owner": "o", "repo": "r", "language": "Go"}))
    known = spark.createDataFrame([("o", "r"), ("o", "none")], "repo_owner string, repo_name string")
    assert {(r["repo_name"], r["language"], r["stars"]) for r in landing.with_repository(known, repos).collect()} == {("r", "Go", 0), ("none", None, 0)}

    hooks = land("hooks", {"action": "opened", "pull_request": {"number": 3}, "repository": {"html_url": "https://github.com/a/b"}},
                 {"action": "opened", "pull_request": {"number": 0}, "repository": {"html_url": "nowhere"}})
    out = str(tmp_path / "out")
    stream.start_webhook_intake(stream.read_webhooks(spark, hooks), out, str(tmp_path / "state")).awaitTermination()
    assert [r["repo_name"] for r in spark.read.parquet(out + "/accepted").collect()] == ["b"]
    assert [r["reasons"] for r in spark.read.parquet(out + "/refused").collect()] == [["repo_url", "pr_number"]]


def test_quarantine(spark):
    rows = spark.createDataFrame(
        [(1, "base64", "YWJj"), (2, "base64", "%%"), (3, "base64", "/w=="), (4, "utf-8", "x"), (5, "utf-8", None)],
        "id int, encoding string, content string",
    )
    good, bad = quality.split_by_error(rows, quality.file_error(F.col("encoding"), F.col("content")))
    assert sorted(r["id"] for r in good.collect()) == [1, 4]
    assert {r["id"]: r["error"] for r in bad.collect()} == {2: "invalid base64", 3: "invalid text", 5: "missing content"}
