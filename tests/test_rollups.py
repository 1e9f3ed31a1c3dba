"""Ordering, limits, results and the store, with one group holding most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from diffloom.operators import issues, ordering, results, scores
from diffloom.sources import store


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"g{rng.randrange(40)}", i, rng.randrange(3)) for i in range(n)]


@pytest.fixture
def no_coalescing(spark):
    """Keep the small partitions of a test apart, as large ones would be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_total_over_a_hot_group(spark, no_coalescing):
    rows = skewed()
    table = spark.createDataFrame(rows, "g string, o int, v int").repartition(11)
    found = ordering.running_total(table, ["g"], [F.col("o")], F.col("v"), "running", "whole").collect()
    sums, whole = {}, {}
    for g, _, v in rows:
        whole[g] = whole.get(g, 0) + v
    expected = {}
    for g, o, v in rows:
        sums[g] = sums.get(g, 0) + v
        expected[(g, o)] = (sums[g], whole[g])
    assert {(r["g"], r["o"]): (r["running"], r["whole"]) for r in found} == expected


def test_running_total_spreads_a_hot_group(spark, no_coalescing):
    table = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    found = ordering.running_total(table, ["g"], [F.col("o")], F.lit(1), "place")
    assert found.filter(F.col("place") != F.col("o") + 1).count() == 0
    sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 1


@pytest.mark.parametrize("n, per_page", [(0, 10), (1, 10), (10, 10), (101, 25)])
def test_pages(spark, n, per_page):
    pages = ordering.paginate(spark.range(n), [F.desc("id")], per_page).collect()
    assert len(pages) == n
    for row in pages:
        place = n - 1 - row["id"]
        assert row["page"] == place // per_page + 1
        assert row["total_pages"] == -(-n // per_page) and row["total_items"] == n
        assert row["has_prev"] == (row["page"] > 1) and row["has_next"] == (row["page"] < row["total_pages"])
    with pytest.raises(ValueError):
        ordering.paginate(spark.range(1), [F.col("id")], 101)


def issue_table(spark, rows):
    names = "id string, pr_analysis_id string, file_analysis_id string, severity string, line_number int"
    return spark.createDataFrame(rows, names).withColumns(
        {
            "issue_type": F.lit("bug"), "column_number": F.lit(0), "description": F.lit(""), "suggestion": F.lit(""),
            "rule_id": F.lit("r"), "confidence": F.lit(0.5),
        }
    )


def test_limit_per_file(spark):
    rows = [(f"i{n}", "a", "f1", ["low", "high", "critical"][n % 3], n) for n in range(300)]
    rows += [("x", "a", "f2", "info", 1)]
    from diffloom.functions.normalize import severity_rank

    table = issue_table(spark, rows).withColumn("sev_rank", severity_rank(F.col("severity")))
    kept = issues.limit_per_file(table, 5, key="file_analysis_id", tie_break=("id",))
    assert [r["id"] for r in kept.filter("file_analysis_id = 'f1'").orderBy("issue_rank").collect()] == ["i2", "i5", "i8", "i11", "i14"]
    assert kept.filter("file_analysis_id = 'f2'").count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # groups are trimmed before the shuffle


def review_tables(spark, issue_rows, files):
    tasks = spark.createDataFrame(
        [("t1", "u", 1, "completed"), ("t2", "u", 2, "completed"), ("t3", "u", 3, "failed"), ("t4", "u", 4, "completed")],
        "id string, repo_url string, pr_number int, status string",
    ).withColumns({c: F.timestamp_seconds(F.lit(0)) for c in ("started_at", "created_at", "completed_at")})
    analyses = spark.createDataFrame(
        [("a1", "t1", 0, None), ("a2", "t2", None, 9), ("a3", "t3", None, None)],
        "id string, task_id string, total_files_analyzed bigint, total_issues_found bigint",
    ).withColumns(
        {"status": F.lit("completed"), "quality_score": F.lit(80.0), "recommendations": F.array(F.lit("ok")),
         "pr_url": F.lit(""), "base_branch": F.lit("main"), "head_branch": F.lit("x")}
    )
    file_table = spark.createDataFrame(files, "id string, pr_analysis_id string, file_type string").withColumns(
        {"file_path": F.col("id"), "lines_added": F.lit(None).cast("bigint"), "lines_removed": F.lit(2).cast("bigint"),
         "complexity_score": F.lit(1.0)}
    )
    return tasks, analyses, file_table, issue_table(spark, issue_rows)


@pytest.mark.parametrize("broadcast_bytes", ["10m", "-1"])
def test_large_reviews_come_on_pages_and_stay_whole(spark, request, broadcast_bytes):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_bytes)
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual))
    files = [(f"f{n}", "a1", "python") for n in range(30)] + [("only", "a1", None)]
    rows = [(f"hot{n}", "a1", "f0", "high", n) for n in range(500)]
    rows += [(f"i{n}", "a1", f"f{n % 30}", "low", n) for n in range(90)]
    rows += [("loose", "a1", None, "critical", 1), ("other", "a3", None, "low", 1)]
    tasks, analyses, file_table, stored = review_tables(spark, rows, files)
    served, refused = results.gate_completed(tasks, analyses)
    assert {(r["id"], r["reason"]) for r in refused.collect()} == {("t3", "task_not_completed"), ("t4", "no_analysis")}
    summary = scores.served_summary(analyses, file_table, stored)
    pages = results.result_documents(served, analyses, file_table, stored, summary, per_part=50, per_page=10).collect()
    first = [p for p in pages if p["task_id"] == "t1"]
    assert len(first) > 1 and {p["pages"] for p in first} == {5}
    nested = [(f["id"], i["id"]) for p in first for f in p["files"] for i in f["issues"]]
    assert sorted(nested) == sorted((r[2], r[0]) for r in rows if r[1] == "a1" and r[2])
    assert {f["id"] for p in first for f in p["files"]} == {f[0] for f in files}
    assert max(len(f["issues"]) for p in first for f in p["files"]) < 150
    facts = first[0]["summary"]
    assert (facts["total_issues"], facts["critical_issues"], facts["total_files"]) == (591, 1, 31)
    assert facts["languages_detected"] == ["python"] and facts["total_lines_removed"] == 62
    second = [p for p in pages if p["task_id"] == "t2"]
    assert len(second) == 1 and second[0]["files"] == [] and second[0]["summary"]["total_issues"] == 9


def test_small_review_is_one_document(spark):
    tasks, analyses, files, stored = review_tables(
        spark, [("i1", "a1", "f1", "low", 4)], [("f1", "a1", "python"), ("f2", "a1", "go")]
    )
    served, _ = results.gate_completed(tasks, analyses)
    summary = scores.served_summary(analyses, files, stored)
    pages = results.result_documents(served, analyses, files, stored, summary).collect()
    document = next(p for p in pages if p["task_id"] == "t1")
    assert [(f["id"], [i["id"] for i in f["issues"]]) for f in document["files"]] == [("f1", ["i1"]), ("f2", [])]


def test_store_reruns_replace_and_newest_wins(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "id string, v int")

    base = str(tmp_path / "store")
    store.write_run({"issues": rows(("a", 1), ("b", 1))}, base, "run-1")
    store.write_run({"issues": rows(("b", 2), ("c", 2))}, base, "run-2")
    store.write_run({"issues": rows(("b", 3), ("c", 3))}, base, "run-2")
    assert {(r["id"], r["v"]) for r in store.read_current(spark, base, "issues").collect()} == {("a", 1), ("b", 3), ("c", 3)}


def test_cascade_delete(spark):
    tables = {
        "tasks": spark.createDataFrame([("t1",), ("t2",)], "id string"),
        "pr_analyses": spark.createDataFrame([("a1", "t1"), ("a2", "t2")], "id string, task_id string"),
        "file_analyses": spark.createDataFrame([("f1", "a1"), ("f2", "a2")], "id string, pr_analysis_id string"),
        "issues": spark.createDataFrame(
            [("i1", "a1", "f1"), ("i2", "a1", None), ("i3", "a2", None), ("i4", "a2", "f2"), ("i5", "a2", "f1")],
            "id string, pr_analysis_id string, file_analysis_id string",
        ),
    }
    left = store.cascade_delete(tables, spark.createDataFrame([("t1",)], "id string"))
    assert {n: sorted(r["id"] for r in df.collect()) for n, df in left.items()} == {
        "tasks": ["t2"], "pr_analyses": ["a2"], "file_analyses": ["f2"], "issues": ["i3", "i4"],
    }


def stored(spark, n_issues):
    ids = [(f"i{k}", "a1", "f1") for k in range(n_issues)] + [("j", "a2", "f2"), ("k", "a2", "f1")]
    return {
        "tasks": spark.createDataFrame([("t1",), ("t2",)], "id string"),
        "pr_analyses": spark.createDataFrame([("a1", "t1"), ("a2", "t2")], "id string, task_id string"),
        "file_analyses": spark.createDataFrame([("f1", "a1"), ("f2", "a2")], "id string, pr_analysis_id string"),
        "issues": spark.createDataFrame(ids, "id string, pr_analysis_id string, file_analysis_id string"),
    }


def current(spark, base):
    return {name: sorted(r["id"] for r in store.read_current(spark, base, name).collect()) for name in store.TABLES}


def test_store_newest_run_of_a_review_wins_whole(spark, tmp_path):
    base = str(tmp_path / "store")
    store.write_run(stored(spark, 3), base, "run-1")
    second = {name: rows.where("id <> 'a2' and id <> 't2'") for name, rows in stored(spark, 1).items()}
    second["issues"] = second["issues"].where("pr_analysis_id = 'a1'")
    second["file_analyses"] = second["file_analyses"].where("pr_analysis_id = 'a1'")
    store.write_run(second, base, "run-2")
    assert current(spark, base)["issues"] == ["i0", "j", "k"]
    second["issues"] = second["issues"].limit(0)
    store.write_run(second, base, "run-2")  # the same run again, now without findings
    assert current(spark, base) == {
        "tasks": ["t1", "t2"], "pr_analyses": ["a1", "a2"], "file_analyses": ["f1", "f2"], "issues": ["j", "k"]}


def test_store_forgets_deleted_tasks(spark, tmp_path):
    base, target = str(tmp_path / "store"), str(tmp_path / "compact")
    store.write_run(stored(spark, 2), base, "run-1")
    store.delete_tasks(spark, base, spark.createDataFrame([("t1",)], "id string"), "run-1")
    left = {"tasks": ["t2"], "pr_analyses": ["a2"], "file_analyses": ["f2"], "issues": ["j"]}
    assert current(spark, base) == left
    store.compact(spark, base, target, "run-1")
    assert current(spark, target) == left
    store.write_run(stored(spark, 1), base, "run-2")
    assert current(spark, base)["issues"] == ["i0", "j", "k"]


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_documents_shuffle_issues_once_unless_reviews_are_large(spark):
    """Without large reviews issues go straight to the nesting; with some, files and pages are still whole."""
    rows = [(f"i{k}", "a1", f"f{k % 7}", "low", 1) for k in range(60)] + [("j", "a2", "f9", "low", 1)]
    files = [(f"f{k}", "a1", "python") for k in range(7)] + [("f9", "a2", "python")]
    tasks, analyses, file_table, stored = review_tables(spark, rows, files)
    served, _ = results.gate_completed(tasks, analyses)
    summary = scores.served_summary(analyses, file_table, stored)
    small = results.result_documents(served, analyses, file_table, stored, summary)
    issues_alone = shuffles(small) - shuffles(results._task_heads(served, analyses, summary))
    assert issues_alone == 1
    cut = results.result_documents(served, analyses, file_table, stored, summary, per_part=5, per_page=4).collect()
    first = [p for p in cut if p["task_id"] == "t1"]
    # 7 files of 8 or 9 issues are 14 parts.
    assert {p["pages"] for p in first} == {4} and sum(len(p["files"]) for p in first) == 14
    assert sorted(i["id"] for p in first for f in p["files"] for i in f["issues"]) == sorted(r[0] for r in rows if r[1] == "a1")
