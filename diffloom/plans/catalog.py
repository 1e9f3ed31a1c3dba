"""Named queries over the test tables, one per operator.

Each takes (spark, folder of tables) and returns a DataFrame. ``oracle.py`` holds
the same questions as plain SQL, under the same names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom import fixed_values as fv
from diffloom import schemas
from diffloom.functions import diffs as dx
from diffloom.functions import normalize as nz
from diffloom.functions import text as tx
from diffloom.operators import diffs, duplicates, embedding, issues, lifecycle, ordering, prompts, quality
from diffloom.operators import files as fo
from diffloom.operators import responses as rp
from diffloom.operators import results, rule_table, rules, scores, similar_sets, similarity, vector_index
from diffloom.plans import bindings as b
from diffloom.plans import review
from diffloom.session import scratch_path
from diffloom.sources import kept, landing, page_store, paging, store
from diffloom.streaming import lifecycle as stream
from diffloom.streaming import retries, status

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(values: str | Column) -> Column:
    return F.array_join(values, ",")


# --- sources and sinks ------------------------------------------------------------


@query
def s01_pull_requests(spark, sf):
    doc = F.col("doc_id")
    raw = b.table(spark, sf, "documents").select(
        F.to_json(
            F.struct(
                doc.alias("id"), (doc + 1).alias("number"),
                F.concat(F.lit("Change "), doc.cast("string")).alias("title"), F.lit("open").alias("state"),
                F.struct(F.col("source").alias("login"), doc.alias("id")).alias("user"),
                F.struct(F.concat(F.lit("topic/"), "lang").alias("ref")).alias("head"),
                F.struct(F.lit("main").alias("ref")).alias("base"),
                F.when(doc % 5 != 0, doc % 30).alias("changed_files"),
                (F.col("n_chars") % 40).alias("additions"), (F.col("n_chars") % 13).alias("deletions"),
                F.struct(F.lit("team").alias("owner"), F.col("source").alias("repo")).alias("_metadata"),
            )
        ).alias("record")
    )
    nested = raw.select(F.from_json("record", schemas.PULL_REQUEST_JSON).alias("r")).select("r.*")
    return landing.pull_requests(nested).select(
        "pr_id", "repo_owner", "repo_name", "number", "title", "author", "head_ref", "base_ref",
        "changed_files", "additions", "deletions",
    )


def _file_pages(spark, sf) -> DataFrame:
    place = F.col("file_id") % 41
    place = F.when(place < 20, place).otherwise(place - 20)
    listed = b.files(spark, sf).select(
        F.col("pr_id").cast("string").alias("pr_id"), (F.floor(place / 8) + 1).cast("int").alias("page"), "file_id",
        F.struct(
            F.col("path").alias("filename"), "status", F.col("additions").cast("int").alias("additions"),
            F.col("deletions").cast("int").alias("deletions"),
        ).alias("file"),
    )
    # A landing page holds at most eight files here, so the collected list is bounded.
    return listed.groupBy("pr_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("file_id", "file"))), lambda x: x["file"]).alias("files")
    )


@query
def s02_pr_files(spark, sf):
    return landing.pr_files(_file_pages(spark, sf), page_size=8).select("pr_id", "file_index", "filename", "status", "additions")


@query
def s02b_whole_listings(spark, sf):
    """Every seventh listing lacks a page or names another number of files, some come twice: files of the rest, reasons for others."""
    path, place = scratch_path(spark, "landed"), F.col("pr_id").cast("bigint") % 7
    _file_pages(spark, sf).write.parquet(path)
    pages = spark.read.parquet(path)
    pulls = pages.groupBy("pr_id").agg((F.sum(F.size("files")) + F.when(place == 3, 1).otherwise(0)).alias("changed_files"))
    landed = pages.where(~((place == 1) & (F.col("page") == 1)) & ~((place == 2) & (F.col("page") == 3)))
    landed = landed.unionByName(pages.where(place == 4))
    files, refused = paging.whole_files(landed, pulls, page_size=8)
    return files.select("pr_id", F.col("file_index").cast("bigint").alias("place"), F.col("filename").alias("found")).unionByName(
        refused.select("pr_id", F.lit(-1).cast("bigint").alias("place"), _joined("problems").alias("found")))


@query
def s03_file_content(spark, sf):
    doc = F.col("doc_id")
    # The French files were not found.
    fetched = b.documents(spark, sf).filter(F.col("lang") != "fr").select(
        F.lit("p").alias("pr_id"), doc.cast("string").alias("filename"),
        F.when(doc % 3 == 0, "base64").otherwise("utf-8").alias("encoding"),
        F.when(doc % 3 == 0, F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\n"))
        .otherwise(F.col("text")).alias("content"),
    )
    wanted = b.table(spark, sf, "documents").select(
        F.lit("p").alias("pr_id"), doc.cast("string").alias("filename"), F.lit("").alias("content")
    )
    return landing.attach_contents(wanted, fetched).select(
        "filename", tx.content_hash(F.col("content")).alias("content_hash"), F.length("content").alias("n_chars")
    )


@query
def s04_repository_dimension(spark, sf):
    documents = b.table(spark, sf, "documents")
    raw = documents.groupBy("source").agg(F.max("lang").alias("language"), F.max("n_chars").alias("n")).select(
        F.lit("team").alias("owner"), F.col("source").alias("repo"), "language",
        F.when(F.col("n") % 2 == 0, F.col("n")).cast("int").alias("stargazers_count"),
        F.lit("main").alias("default_branch"), F.lit(False).alias("private"),
    )
    prs = documents.select("doc_id", F.lit("team").alias("repo_owner"), F.col("source").alias("repo_name"))
    return landing.with_repository(prs, landing.repositories(raw)).select("doc_id", "repo_name", "language", "stars")


@query
def s05_content_selection(spark, sf):
    form = F.col("file_id") % 3
    given = b.patched_files(spark, sf).withColumn(
        "content", F.when(form == 1, F.lit("")).when(form == 2, F.col("content"))
    )
    return fo.select_content(given).select(
        "file_id", tx.content_hash(F.col("content")).alias("content_hash"), "additions", "deletions"
    )


@query
def s06_result_sink(spark, sf):
    base = scratch_path(spark, "results")
    tasks = b.tasks(spark, sf).withColumn("progress", F.lit(30))
    store.write_run({"tasks": tasks}, base, "run-1")
    finished = store.read_current(spark, base, "tasks").filter(F.col("status") == "processing").select(
        "id", F.lit("completed").alias("status"),
        F.timestamp_add("MINUTE", F.lit(5), F.col("created_at")).alias("completed_at"),
    )
    changed = store.close_tasks(tasks.join(finished.select("id"), "id", "left_semi"), finished)
    store.write_run({"tasks": changed}, base, "run-2")
    return store.read_current(spark, base, "tasks").select(
        "id", "status", "progress", F.unix_micros("completed_at").alias("completed_us")
    )


@query
def s06b_review_run(spark, sf):
    """A whole review, stored twice under one run id and read back: rows and issues per analysis."""
    base = scratch_path(spark, "review")
    files = b.code_files(spark, sf)
    tasks = files.select("pr_id").distinct().select(
        F.col("pr_id").cast("string").alias("id"), "pr_id",
        F.timestamp_seconds(F.lit(0)).alias("started_at"), F.timestamp_seconds(F.lit(60)).alias("completed_at"),
    )
    tables = review.result_tables(files, tasks)
    for _ in range(2):
        store.write_run(tables, base, "run-1")
    return store.read_current(spark, base, "pr_analyses").select(
        F.col("task_id").cast("bigint").alias("pr_id"), "total_files_analyzed", "total_issues_found", "critical_issues",
        "total_lines_analyzed", "high_issues", "medium_issues", "low_issues", "quality_score",
    )


@query
def s06c_snapshots(spark, sf):
    """A second run that dies before its commit changes nothing; once it commits, older snapshots stay as they were."""
    base = scratch_path(spark, "snapshots")
    files = b.file_rows(spark, sf)
    tables = {"pr_analyses": b.all_analyses(spark, sf), "file_analyses": files, "issues": b.stored_issues(spark, sf)}
    first = store.write_run(tables, base, "run-1")
    some = {name: rows.where(F.col("id" if name == "pr_analyses" else "pr_analysis_id") % 3 == 0) for name, rows in tables.items()}
    some["issues"] = some["issues"].where("severity <> 'low'")
    store.stage(some, base, "run-2")  # written, and never committed

    def counted(moment: str, seen: store.Snapshot) -> DataFrame:
        rows = [seen.current(name).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(moment).alias("moment"), F.lit(name).alias("table_name"), "n") for name in tables]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])

    interrupted = store.Snapshot(spark, base)
    store.write_run(some, base, "run-2")
    return counted("interrupted", interrupted).unionByName(counted("committed", store.Snapshot(spark, base))).unionByName(
        counted("as of the first", store.Snapshot(spark, base, first)))


@query
def s07_cascade_delete(spark, sf):
    """Stored, deleted and read back: rows that are left for each parent."""
    base = scratch_path(spark, "cascade")
    tasks = b.tasks(spark, sf)
    store.write_run(
        {
            "tasks": tasks,
            "pr_analyses": b.all_analyses(spark, sf),
            "file_analyses": b.file_rows(spark, sf),
            "issues": b.stored_issues(spark, sf),
        },
        base, "run-1",
    )
    store.delete_tasks(spark, base, tasks.filter(F.col("priority") == "low"), "run-1")
    seen = store.Snapshot(spark, base)
    remaining = {name: seen.current(name) for name in store.TABLES}

    def counted(name: str, parent: str) -> DataFrame:
        return remaining[name].groupBy(F.col(parent).alias("parent")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), "parent", "n"
        )

    return (
        counted("tasks", "id").unionByName(counted("pr_analyses", "task_id"))
        .unionByName(counted("file_analyses", "pr_analysis_id")).unionByName(counted("issues", "pr_analysis_id"))
    )


@query
def s08_webhook_stream(spark, sf):
    base = scratch_path(spark, "webhooks")
    landed = b.repo_urls(spark, sf).select(
        F.when(F.col("url_id") % 3 == 0, "opened").otherwise("synchronize").alias("action"),
        F.struct(
            F.col("url_id").alias("id"), (F.col("url_id") % 9).cast("int").alias("number"),
            F.concat(F.lit("t"), F.col("url_id").cast("string")).alias("title"),
        ).alias("pull_request"),
        F.struct(F.col("url").alias("html_url")).alias("repository"),
        F.struct(F.lit("bot").alias("login")).alias("sender"),
    )
    landed.write.json(f"{base}/in")
    stream.start_webhook_intake(
        stream.read_webhooks(spark, f"{base}/in"), f"{base}/out", f"{base}/state"
    ).awaitTermination()
    accepted, refused = (spark.read.parquet(f"{base}/out/{side}") for side in ("accepted", "refused"))
    return accepted.select(
        "action", "pr_number", "title", "repo_owner", "repo_name", "priority", F.lit("").alias("reasons")
    ).unionByName(refused.select("action", "pr_number", "title", _joined("reasons").alias("reasons")), allowMissingColumns=True)


# --- normalisation and checks -----------------------------------------------------


@query
def f01_repo_url(spark, sf):
    parts = nz.split_repo_url(F.col("url"))
    return b.repo_urls(spark, sf).select(
        "url_id", nz.is_repo_url(F.col("url")).alias("valid"), parts["owner"].alias("owner"), parts["repo"].alias("repo")
    )


@query
def f01b_repo_url_lenient(spark, sf):
    parts = nz.split_repo_url_lenient(F.col("url"))
    return b.repo_urls(spark, sf).select("url_id", parts["owner"].alias("owner"), parts["repo"].alias("repo"))


@query
def f02_request_validation(spark, sf):
    number = F.col("url_id")
    priorities = F.array(*[F.lit(x) for x in (*fv.TASK_PRIORITIES, "asap")])
    requests = b.repo_urls(spark, sf).select(
        "url_id", F.col("url").alias("repo_url"), (number % 6 - 1).alias("pr_number"),
        F.when(number % 7 != 0, F.element_at(priorities, (number % 5 + 1).cast("int"))).alias("priority"),
    )
    accepted, refused = quality.validate_requests(requests)
    return accepted.select("url_id", F.lit("").alias("reasons"), "priority", "repo_owner", "repo_name").unionByName(
        refused.select("url_id", _joined("reasons").alias("reasons"), "priority"), allowMissingColumns=True
    )


@query
def f02b_record_validation(spark, sf):
    value = F.col("value")
    reasons = nz.record_reasons(
        value.cast("int"), value / 100, value - 5, F.when(F.col("event_id") % 4 != 0, value * 2), value.cast("int") + 1
    )
    return b.table(spark, sf, "events").select("event_id", _joined(reasons).alias("reasons"))


@query
def f03_file_name_parts(spark, sf):
    url = F.col("url")
    return b.table(spark, sf, "pages").select(
        "page_id", nz.file_name(url).alias("file_name"), nz.file_extension(url).alias("file_extension")
    )


@query
def f04_language(spark, sf):
    return b.files(spark, sf).select("file_id", nz.language(F.col("path")).alias("language"))


@query
def f05_issue_type(spark, sf):
    return b.raw_issues(spark, sf).select("issue_id", "type", nz.issue_type(F.col("type")).alias("issue_type"))


@query
def f06_severity(spark, sf):
    level = nz.severity(F.col("severity"))
    return b.raw_issues(spark, sf).select(
        "issue_id", level.alias("level"), nz.severity_rank(level).alias("sev_rank")
    )


@query
def f07_issue_projection(spark, sf):
    return b.stored_issues(spark, sf).select(
        "id", "title", "description", "line_number", "column_number", "rule_id", "suggestion", "confidence",
        F.size("tags").alias("n_tags"),
    )


@query
def f08_lifecycle_predicates(spark, sf):
    state = F.col("status")
    return b.tasks(spark, sf).select(
        "id", nz.task_is_completed(state).alias("is_completed"), nz.task_is_running(state).alias("is_running"),
        nz.task_can_retry(state, F.col("retry_count"), F.col("max_retries")).alias("can_retry"),
    )


@query
def f08b_analysis_predicates(spark, sf):
    counts = scores.count_severities(b.stored_issues(spark, sf), "pr_analysis_id")
    return b.all_analyses(spark, sf).join(
        counts.withColumnRenamed("pr_analysis_id", "id"), "id", "left"
    ).select(
        "id", nz.analysis_is_completed(F.col("status")).alias("is_completed"),
        nz.has_critical(F.col("critical_issues")).alias("has_critical_issues"),
    )


@query
def f09_duration(spark, sf):
    return b.tasks(spark, sf).select(
        "id", nz.seconds_between(F.col("started_at"), F.col("completed_at")).alias("seconds")
    )


@query
def f10_location(spark, sf):
    return b.raw_issues(spark, sf).select(
        "issue_id",
        nz.location(
            F.when(F.col("line") % 3 != 0, F.col("file_id")), F.when(F.col("line") > 2, F.col("line")), F.col("column")
        ).alias("location"),
    )


def _configured_issues(spark, sf):
    stored = b.stored_issues(spark, sf).withColumn("task_id", F.col("pr_analysis_id"))
    order = F.col("o_orderkey")
    thresholds = F.array(*[F.lit(x) for x in ("info", "low", "high")])
    configs = b.table(spark, sf, "orders").select(
        order.alias("task_id"),
        (order % 2 == 0).alias("include_style_issues"), (order % 3 != 0).alias("include_security_issues"),
        (order % 5 != 0).alias("include_performance_issues"), (order % 7 != 0).alias("include_best_practices"),
        F.when(order % 4 != 0, F.element_at(thresholds, (order % 3 + 1).cast("int"))).alias("severity_threshold"),
    )
    return issues.filter_by_config(stored, configs)


@query
def f11_config_filter(spark, sf):
    return _configured_issues(spark, sf).select("id", "issue_type", "severity")


@query
def f12_completed_gate(spark, sf):
    served, refused = results.gate_completed(b.tasks(spark, sf), b.analyses(spark, sf))
    return served.select("id", F.lit("served").alias("outcome")).unionByName(
        refused.select("id", F.col("reason").alias("outcome"))
    )


@query
def f13_default_metrics(spark, sf):
    measured = fo.measure(b.files(spark, sf).select("file_id", "content")).drop("content")
    known = b.table(spark, sf, "labels").select(F.col("doc_id").alias("file_id"))
    partly = measured.join(known, "file_id", "left_semi")
    everyone = b.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"))
    joined = everyone.join(partly, "file_id", "left").withColumn("language", F.lit(None).cast("string"))
    return fo.default_metrics(joined).select(
        "file_id", "complexity_score", "maintainability_score", "language", "total_lines", "code_lines",
        F.round("duplication_score", 6).alias("duplication_score"),
    )


# --- text -------------------------------------------------------------------------


@query
def t01_line_table(spark, sf):
    return rules.line_table(b.files(spark, sf))


@query
def t02_nonblank_lines(spark, sf):
    kept = tx.nonblank_lines(tx.lines(F.col("content")))
    return b.code_files(spark, sf).select(
        "file_id", F.size(kept).alias("n"), F.sha2(F.array_join(kept, "\n"), 256).alias("lines_hash")
    )


@query
def t03_code_text(spark, sf):
    """The whole text, its length and its hash."""
    content = tx.lines(F.col("content"))
    whole = tx.code_text(content)
    return b.code_files(spark, sf).select(
        "file_id", F.length(whole).alias("n_chars"), F.sha2(whole, 256).alias("text_hash"),
        whole.alias("code_text"),
    )


@query
def t04_keyword_complexity(spark, sf):
    return b.code_files(spark, sf).select("file_id", tx.keyword_complexity(F.col("content")).alias("complexity"))


@query
def t05_duplicate_line_ratio(spark, sf):
    return fo.measure(b.files(spark, sf).select("file_id", "content")).select(
        "file_id", F.round("duplication_score", 9).alias("duplication")
    )


@query
def t06_maintainability(spark, sf):
    return fo.measure(b.code_files(spark, sf).select("file_id", "content")).select("file_id", "maintainability_score")


def _coded(spark, sf):
    return b.code_files(spark, sf).withColumn("language", nz.language(F.col("path")))


@query
def t07_security_scan(spark, sf):
    return rules.scan_lines(_coded(spark, sf), rules.SECURITY_RULES).select("file_id", "line", "type", "severity")


@query
def t08_python_lint(spark, sf):
    return rules.scan_lines(_coded(spark, sf), rules.PYTHON_RULES).select(
        "file_id", "line", "type", "severity", "message"
    )


@query
def t09_script_lint(spark, sf):
    return rules.scan_lines(_coded(spark, sf), rules.SCRIPT_RULES).select(
        "file_id", "line", "type", "severity", "message"
    )


@query
def t10_language_lint(spark, sf):
    return rules.language_lint(_coded(spark, sf)).select("file_id", "line", "rule_id", "suggestion")


def _file_suggestions(spark, sf, language: tuple[str, ...], make) -> DataFrame:
    return (
        _coded(spark, sf).filter(F.col("language").isin(*language))
        .select("file_id", F.explode_outer(make(F.col("content"))).alias("s"))
        .filter(F.col("s").isNotNull()).select("file_id", "s.type", "s.priority", "s.message")
    )


@query
def t11_python_suggestions(spark, sf):
    return _file_suggestions(spark, sf, ("python",), rules.python_suggestions)


@query
def t12_script_suggestions(spark, sf):
    return _file_suggestions(spark, sf, ("javascript", "typescript"), rules.script_suggestions)


@query
def t13_function_lengths(spark, sf):
    return rules.function_table(b.code_files(spark, sf))


@query
def t14_long_functions(spark, sf):
    return rules.long_function_suggestions(rules.function_table(b.code_files(spark, sf))).select(
        "file_id", "function_name", "message"
    )


@query
def t15_threshold_flags(spark, sf):
    return fo.flag_thresholds(b.code_files(spark, sf))


@query
def t16_best_practices(spark, sf):
    return rules.best_practice_issues(_coded(spark, sf))


@query
def t17_content_hash(spark, sf):
    return fo.content_copies(b.files(spark, sf))


@query
def t17b_content_changes(spark, sf):
    """Snapshots: documents with a label against all; in the later one every seventh text grew."""
    labelled = b.table(spark, sf, "labels").select(F.col("doc_id").alias("file_id"))
    files = b.files(spark, sf)
    grown = files.withColumn(
        "content", F.when(F.col("file_id") % 7 == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))
    )
    return fo.content_changes(files.join(labelled, "file_id", "left_semi"), grown)


@query
def t18_summary_line(spark, sf):
    return review.review_files(b.code_files(spark, sf)).select(
        "file_id",
        tx.summary_line(
            F.col("file_name"), F.col("language"), F.col("maintainability_score") - F.lit(0.5),
            F.col("critical_issues_count"), F.col("issues_count"), F.col("additions"), F.col("deletions"),
        ).alias("summary"),
    )


@query
def t19_word_jaccard(spark, sf):
    """Each turn of a conversation against the next one."""
    turns = b.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_distinct(tx.words(F.col("text"))).alias("words")
    )
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next_words"))
    return turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(tx.word_jaccard(F.col("words"), F.col("next_words")), 9).alias("similarity")
    )


@query
def t19b_similar_documents(spark, sf):
    """Every document against every other by their word sets, as classes with numbers of links."""
    words = b.table(spark, sf, "documents").select("doc_id", tx.words(F.col("text")).alias("words"))
    members, _ = similar_sets.similar_sets(words, "doc_id", "words", 80)
    return members.select(F.col("id").alias("doc_id"), "first_id", "class_id", "n_links")


@query
def t19c_similar_pairs(spark, sf):
    """Pairs of different word sets that share 80 % of their words."""
    words = b.table(spark, sf, "documents").select("doc_id", tx.words(F.col("text")).alias("words"))
    _, pairs = similar_sets.similar_sets(words, "doc_id", "words", 80)
    return pairs.select("id_a", "id_b", F.round("similarity", 9).alias("similarity"))


# --- diffs ------------------------------------------------------------------------


@query
def d01_patch_lines(spark, sf):
    return diffs.patch_lines(b.patched_files(spark, sf)).select("file_id", "line_no", "kind")


@query
def d02_symbol_names(spark, sf):
    return diffs.patch_lines(b.patched_files(spark, sf)).select(
        "file_id", "line_no", dx.symbol_name(F.col("line")).alias("symbol")
    )


@query
def d03_affected_functions(spark, sf):
    return diffs.diff_counts(b.patched_files(spark, sf)).select(
        "file_id", _joined("affected_functions").alias("affected_functions")
    )


@query
def d04_impact_score(spark, sf):
    return diffs.diff_impact(b.patched_files(spark, sf)).select("file_id", "impact_score")


@query
def d05_risk_level(spark, sf):
    return diffs.diff_impact(b.patched_files(spark, sf)).select("file_id", "risk_level")


@query
def d06_change_type(spark, sf):
    return b.patched_files(spark, sf).select(
        "file_id", dx.change_type(F.col("status"), F.col("additions"), F.col("deletions")).alias("change_type")
    )


@query
def d07_diff_impact(spark, sf):
    return diffs.diff_impact(b.patched_files(spark, sf)).withColumn(
        "affected_functions", _joined("affected_functions")
    )


# --- similarity -------------------------------------------------------------------


def _weights(embedded: DataFrame, key: str) -> DataFrame:
    return (
        embedded.select(key, F.posexplode_outer("embedding").alias("bucket", "w"))
        .filter(F.col("w") > 0).select(key, "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))
    )


@query
def e01_text_embedding(spark, sf):
    return _weights(embedding.embed(b.files(spark, sf)), "file_id")


def _load_example_model():
    """Word hashing in the place of a model; a worker hashes a word once."""
    import functools
    import hashlib

    @functools.lru_cache(maxsize=200_000)
    def bucket(word: str) -> int:
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % fv.EMBEDDING_DIM

    def encode(texts: list[str]):
        return embedding.bucket_counts([[bucket(word) for word in text.lower().split()] for text in texts], fv.EMBEDDING_DIM)

    return encode


@query
def e02_batch_embedding(spark, sf):
    items = b.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("content"))
    return _weights(embedding.embed(items, embedder=embedding.model_embedder(_load_example_model)), "item_id")


@query
def e03_cosine(spark, sf):
    """Each vector against its successor."""
    vectors = b.table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(after, "vec_id").select(
        "vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("next")), 5).alias("similarity")
    )


@query
def e04_similar_code(spark, sf):
    corpus = embedding.embed(b.documents(spark, sf), text="text").select("doc_id", "embedding")
    targets = embedding.embed(b.table(spark, sf, "benchmark"), text="text").select("item_id", "embedding")
    return similarity.find_similar(targets, corpus, "item_id", "doc_id", threshold=0.4)


@query
def e04b_index_search(spark, sf):
    """A stored index that takes a second lot of vectors and answers for every fiftieth vector, all cells probed."""
    path = scratch_path(spark, "index")
    vectors = b.table(spark, sf, "embeddings")
    early = F.col("vec_id") % 2 == 0
    vector_index.build(vectors.where(early), path, "vec_id")
    index = vector_index.VectorIndex(spark, path)
    index.add(vectors.where(~early), "vec_id")
    targets = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("target_id"), "embedding")
    return index.search(targets, "target_id", "vec_id", threshold=0.2)


@query
def e05_duplicate_pairs(spark, sf):
    return similarity.find_duplicates(b.table(spark, sf, "embeddings"), "vec_id", threshold=0.3)


@query
def e05b_duplicates_in_key(spark, sf):
    """Close vectors that carry the same label."""
    return similarity.find_duplicates_within(b.table(spark, sf, "embeddings"), "label", "vec_id", threshold=0.3)


@query
def e05c_duplicate_classes(spark, sf):
    """Classes of close vectors with numbers of links, through bands of one hyperplane each."""
    members, _ = duplicates.duplicate_classes(
        b.table(spark, sf, "embeddings"), "vec_id", threshold=0.3, recall=1 - 1e-6, bits=1)
    return members.withColumnRenamed("id", "vec_id")


@query
def e06_code_blocks(spark, sf):
    return similarity.block_table(b.code_files(spark, sf))


@query
def e07_block_similarity(spark, sf):
    return similarity.block_similarity(b.code_files(spark, sf)).select(
        "file_id", "total_blocks", "duplicates_found", "max_similarity",
        F.round("avg_similarity", 9).alias("avg_similarity"), F.round("duplication_score", 6).alias("duplication_score"),
    )


# --- joins and roll-ups -----------------------------------------------------------


@query
def j01_result_documents(spark, sf):
    analyses, files, stored = b.analyses(spark, sf), b.file_rows(spark, sf), b.stored_issues(spark, sf)
    served, _ = results.gate_completed(b.tasks(spark, sf), analyses)
    documents = results.result_documents(
        served, analyses, files, stored, scores.served_summary(analyses, files, stored)
    )
    listed = F.transform(
        "files",
        lambda f: F.concat(
            f["id"], F.lit("["), F.array_join(F.transform(f["issues"], lambda i: i["id"]), ","), F.lit("]")
        ),
    )
    return documents.select(
        "task_id", "github_repo", "page", "pages", F.array_join(listed, ";").alias("files"),
        F.col("summary.total_issues").alias("total_issues"),
    )


@query
def j02_task_lookup(spark, sf):
    """Tasks asked for by event users, some of which do not exist."""
    wanted = b.table(spark, sf, "events").select((F.col("user_id") * 211).alias("id")).distinct()
    found, missing = results.lookup(wanted, b.tasks(spark, sf))
    return found.select("id", "status").unionByName(missing.select("id", F.lit("not found").alias("status")))


@query
def a01_analysis_statistics(spark, sf):
    return scores.analysis_statistics(b.file_rows(spark, sf), b.stored_issues(spark, sf))


def _kept_store(spark, sf) -> store.Snapshot:
    """All reviews stored; low-priority ones deleted; a third stored anew without minor issues, twice. Statistics follow each change."""
    base = scratch_path(spark, "kept")
    tables = {"pr_analyses": b.all_analyses(spark, sf), "file_analyses": b.file_rows(spark, sf), "issues": b.stored_issues(spark, sf)}
    store.write_run(tables, base, "run-1")
    kept.update(spark, base)
    store.delete_tasks(spark, base, b.tasks(spark, sf).filter(F.col("priority") == "low"), "run-1")
    kept.update(spark, base)
    some = {name: rows.where(F.col("id" if name == "pr_analyses" else "pr_analysis_id") % 3 == 0) for name, rows in tables.items()}
    some["issues"] = some["issues"].where("severity <> 'low'")
    for _ in range(2):
        store.write_run(some, base, "run-2")
        kept.update(spark, base)
    return store.Snapshot(spark, base)


@query
def a01b_kept_statistics(spark, sf):
    found = kept.statistics(_kept_store(spark, sf))
    return found.withColumn("pr_analysis_id", F.col("pr_analysis_id").cast("bigint"))


@query
def a02_issue_counts(spark, sf):
    raw = b.raw_issues(spark, sf).filter(F.col("file_id").isNotNull()).withColumn("source", F.lit("quality"))
    return issues.count_by_file(raw).select("file_id", "issues_count", "critical_issues_count")


@query
def a03_quality_score(spark, sf):
    return review.review_files(b.code_files(spark, sf)).select("file_id", "quality_score")


@query
def a04_security_score(spark, sf):
    return review.review_files(b.code_files(spark, sf)).select("file_id", "security_score")


def _summaries(spark, sf):
    files = b.code_files(spark, sf)
    facts = files.groupBy("pr_id").agg(F.count(F.lit(1)).cast("int").alias("changed_files")).select(
        "pr_id", F.concat(F.lit("PR "), F.col("pr_id").cast("string")).alias("title"),
        F.when(F.col("pr_id") % 3 != 0, F.lit("dev")).alias("author"), "changed_files",
    )
    return review.summarise(files, facts)


@query
def a05_pr_summary(spark, sf):
    return _summaries(spark, sf).withColumn("recommendations", F.array_join("recommendations", "|"))


@query
def a06_served_summary(spark, sf):
    return scores.served_summary(
        b.all_analyses(spark, sf), b.file_rows(spark, sf), b.stored_issues(spark, sf)
    ).withColumn("languages_detected", _joined("languages_detected"))


@query
def a06b_kept_summary(spark, sf):
    found = kept.served_summary(_kept_store(spark, sf))
    return found.withColumns({"pr_analysis_id": F.col("pr_analysis_id").cast("bigint"),
                              "languages_detected": _joined("languages_detected")})


@query
def a07_job_results(spark, sf):
    fetched = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pr_id"))
    return scores.job_results(
        fetched, b.file_rows(spark, sf).withColumnRenamed("pr_analysis_id", "pr_id"), b.raw_issues(spark, sf)
    )


@query
def a08_file_headers(spark, sf):
    return scores.file_headers(review.review_files(b.code_files(spark, sf))).withColumn(
        "analysis_tools_used", _joined("analysis_tools_used")
    )


@query
def a09_model_usage(spark, sf):
    calls = b.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("pr_id"), F.col("role").alias("model"), F.length("text").alias("prompt_tokens"),
        F.when(F.col("turn") % 2 == 0, F.size(tx.words(F.col("text")))).alias("completion_tokens"),
        (F.col("turn") * 0.5).alias("duration_seconds"),
    )
    return scores.model_usage(calls)


# --- ordering, limits, sets -------------------------------------------------------


@query
def k02_top_block_pairs(spark, sf):
    return similarity.top_block_pairs(similarity.block_similarity(b.code_files(spark, sf)))


@query
def k03_issue_limit(spark, sf):
    """At most three issues per review, worst first."""
    return issues.limit_per_file(
        b.stored_issues(spark, sf), 3, key="pr_analysis_id", tie_break=("id",)
    ).select("pr_analysis_id", "id", "issue_rank")


@query
def k04_task_pages(spark, sf):
    urgency = F.array_position(F.array(*[F.lit(p) for p in reversed(fv.TASK_PRIORITIES)]), F.col("priority"))
    return ordering.paginate(
        b.tasks(spark, sf).select("id", urgency.alias("urgency")), [F.col("urgency"), F.col("id")], per_page=25
    ).drop("urgency")


@query
def k04b_stored_pages(spark, sf):
    """The list of tasks stored once; its first, middle and last pages, and what follows the first page's last row."""
    path = scratch_path(spark, "list")
    urgency = F.array_position(F.array(*[F.lit(p) for p in reversed(fv.TASK_PRIORITIES)]), F.col("priority"))
    page_store.write_list(b.tasks(spark, sf).select("id", urgency.alias("urgency")), ["urgency", "id"], path, rows_per_file=10_000)
    first = page_store.read_page(spark, path, 1, per_page=25)
    total = first.first()["total_pages"]
    pages = [first, *[page_store.read_page(spark, path, n, per_page=25) for n in ((total + 1) // 2, total)]]
    end = first.collect()[-1]
    behind = page_store.read_after(spark, path, {"urgency": end["urgency"], "id": end["id"]}, per_page=25)
    facts = ["page", "total_items", "has_next"]
    found = [p.select(F.lit("page").alias("by"), "id", *facts) for p in pages]
    found.append(behind.select(F.lit("key").alias("by"), "id", *[F.lit(None).cast(pages[0].schema[c].dataType).alias(c) for c in facts]))
    return reduce(DataFrame.unionByName, found)


@query
def u01_issue_concat(spark, sf):
    found = b.raw_issues(spark, sf)
    secure = found.filter(F.col("type") == "security").select("issue_id", "type", "severity")
    both = issues.concat_issues(quality=found.select("issue_id", "type", "severity", "line"), security=secure)
    return both.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.count("line").alias("n_lines"))


# --- requests and answers ---------------------------------------------------------


def _prompt_facts(spark, sf, make) -> DataFrame:
    text = make(F.col("content"), F.col("path"), F.col("language"))
    return _coded(spark, sf).select("file_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("prompt_hash"))


@query
def p01_quality_prompt(spark, sf):
    return _prompt_facts(spark, sf, prompts.quality_prompt)


@query
def p02_security_prompt(spark, sf):
    return _prompt_facts(spark, sf, prompts.security_prompt)


@query
def p03_suggestions_prompt(spark, sf):
    return _prompt_facts(spark, sf, prompts.suggestions_prompt)


@query
def p04_request_table(spark, sf):
    return prompts.request_table(_coded(spark, sf)).select(
        "file_id", "operation", "system", F.sha2("prompt", 256).alias("prompt_hash"), "temperature", "max_tokens"
    )


@query
def p05_quality_answers(spark, sf):
    return rp.parse_quality(b.responses(spark, sf)).select(
        "file_id", "source", "score", F.size("issues").alias("n_issues"), F.size("suggestions").alias("n_suggestions"),
        F.get("issues", F.lit(0))["line"].alias("first_line"),
        F.get("issues", F.lit(0))["message"].alias("first_message"),
        F.get("suggestions", F.lit(0))["description"].alias("first_suggestion"),
        F.col("metrics.maintainability").alias("maintainability"), F.col("metrics.readability").alias("readability"),
    )


@query
def p06_issue_answers(spark, sf):
    raw = rp.parse_security(b.responses(spark, sf))
    return issues.normalise_issues(raw).select(
        "file_id", "source", "raw_type", "issue_type", "severity", "title", "description", "line_number", "confidence"
    )


@query
def p06b_suggestion_answers(spark, sf):
    return rp.parse_suggestions(b.responses(spark, sf)).select(
        "file_id", "source", "type", "priority", "title", "description", "line"
    )


@query
def p07_unavailable_defaults(spark, sf):
    answered = b.responses(spark, sf).filter(F.col("answer").isNotNull())
    return rp.default_quality(b.responses(spark, sf), answered).filter(F.col("source") == "unavailable").select(
        "file_id", "score", F.size("issues").alias("n_issues"),
        F.get("suggestions", F.lit(0))["title"].alias("suggestion"), F.col("metrics.complexity").alias("complexity"),
    )


@query
def p08_metric_merge(spark, sf):
    """All answers of a conversation concern the file of its number."""
    answers = b.responses(spark, sf).withColumn("file_id", F.expr("file_id div 1000"))
    measured = similarity.block_similarity(b.code_files(spark, sf))
    return rp.merge_block_metrics(rp.parse_quality(answers), measured).select(
        "file_id", "score", "semantic_duplicates", F.round("duplication_score", 6).alias("duplication_score"),
        "code_blocks_analyzed",
    )


# --- lifecycle --------------------------------------------------------------------


def _times(folded: DataFrame) -> DataFrame:
    return folded.withColumns(
        {name: F.unix_micros(name) for name in ("started_at", "completed_at") if name in folded.columns}
    )


@query
def r01_latest_status(spark, sf):
    return lifecycle.latest_status(b.event_batch(spark, sf))


@query
def r01b_latest_status_stream(spark, sf):
    base = scratch_path(spark, "status")
    stream.start_status(b.event_stream(spark, sf), f"{base}/out", f"{base}/state").awaitTermination()
    return stream.read_latest(spark, f"{base}/out")


def _task_changes(spark, sf) -> DataFrame:
    """Each task as it was made, and as it is now; every second task is named as a task of the events."""
    tasks = b.tasks(spark, sf)
    name = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1_000_000_000).alias("id")
    made = tasks.select(name, F.col("created_at").alias("updated_at"), F.lit("pending").alias("status"),
                        F.lit(None).cast("string").alias("error_message"))
    error = F.when(F.col("status") == "failed", F.concat(F.lit("failed at "), F.col("pr_number").cast("string")))
    return made.unionByName(tasks.select(
        name, F.coalesce("completed_at", "created_at").alias("updated_at"), "status", error.alias("error_message")))


@query
def r01c_live_status(spark, sf):
    return _micros(lifecycle.live_status(_task_changes(spark, sf), b.event_batch(spark, sf)))


def _micros(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.unix_micros(c) for c in ("updated_at", "reported_at")})


@query
def r01d_live_status_stream(spark, sf):
    """Both sides as streams; a last row far ahead in each lets all windows come out."""
    base = scratch_path(spark, "live")
    sides = {"tasks": (_task_changes(spark, sf), "updated_at"), "events": (b.event_batch(spark, sf), "ts")}
    streams = {}
    for name, (rows, time) in sides.items():
        rows.write.parquet(f"{base}/{name}")
        stored = spark.read.schema(rows.schema).parquet(f"{base}/{name}")
        last = F.lit("2100-01-01").cast("timestamp")
        end = stored.limit(1).select(*[(last if c == time else F.lit(None)).cast(stored.schema[c].dataType).alias(c) for c in rows.columns])
        end.write.mode("append").parquet(f"{base}/{name}")
        streams[name] = spark.readStream.schema(rows.schema).parquet(f"{base}/{name}")
    status.start_live_status(streams["tasks"], streams["events"], f"{base}/out", f"{base}/state").awaitTermination()
    return _micros(status.read_live_status(spark, f"{base}/out"))


@query
def r02_progress_fold(spark, sf):
    return lifecycle.progress_fold(b.event_batch(spark, sf))


@query
def r02b_progress_log(spark, sf):
    return lifecycle.progress_log(b.event_batch(spark, sf)).withColumn("ts", F.unix_micros("ts"))


@query
def r03_task_fold(spark, sf):
    return _times(lifecycle.fold_tasks(b.event_batch(spark, sf)))


@query
def r03b_task_fold_stream(spark, sf):
    base = scratch_path(spark, "fold")
    stream.start_task_fold(_redelivered(b.event_stream(spark, sf)), f"{base}/out", f"{base}/state").awaitTermination()
    return _times(stream.read_latest(spark, f"{base}/out"))


@query
def r04_stage_progress(spark, sf):
    return lifecycle.review_progress(b.files(spark, sf).select("file_id", "pr_id", "path"), [F.col("file_id")])


def _redelivered(events: DataFrame) -> DataFrame:
    return events.unionByName(events.filter(F.col("state") == "retry"))


@query
def r05_attempts(spark, sf):
    return lifecycle.attempts(_redelivered(b.event_batch(spark, sf))).select(
        "task_id", "seq", "attempt", "retry_allowed", F.unix_micros("retry_at").alias("retry_at")
    )


@query
def r05b_deduplication_stream(spark, sf):
    base = scratch_path(spark, "dedup")
    events = _redelivered(b.event_stream(spark, sf))
    stream.start_deduplication(events, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").select("task_id", "seq", "state")


@query
def r05c_retries_stream(spark, sf):
    """Retries of a stream that delivers each twice, as they come due; a last event far ahead lets all of them pass."""
    base = scratch_path(spark, "retries")
    b.event_batch(spark, sf).write.parquet(f"{base}/in")
    last = F.max("ts") + F.expr("interval 2 hours")
    spark.read.parquet(f"{base}/in").groupBy().agg(F.lit(0).cast("bigint").alias("task_id"), last.alias("ts")).select(
        "task_id", F.lit(-1).cast("bigint").alias("seq"), "ts", F.lit("view").alias("stage")).write.mode("append").parquet(f"{base}/in")
    events = spark.readStream.schema(b.event_batch(spark, sf).schema).parquet(f"{base}/in")
    retries.start_retries(_redelivered(events), f"{base}/out", f"{base}/state", lifetime="3650 days").awaitTermination()
    due = spark.read.parquet(f"{base}/out/due")
    return due.select("task_id", "seq", "attempt", "retry_allowed", F.unix_micros("retry_at").alias("retry_at"))


@query
def r06_failure_isolation(spark, sf):
    form = F.col("doc_id") % 5
    fetched = b.documents(spark, sf).select(
        "doc_id", F.when(form < 3, "base64").otherwise("utf-8").alias("encoding"),
        F.when(form == 0, F.base64(F.col("text").cast("binary"))).when(form == 1, F.lit("%%%"))
        .when(form == 2, F.lit("/w==")).when(form == 3, F.col("text")).alias("content"),
    )
    good, bad = quality.split_by_error(fetched, quality.file_error(F.col("encoding"), F.col("content")))
    return good.select("doc_id", F.lit("analysed").alias("outcome")).unionByName(
        bad.select("doc_id", F.col("error").alias("outcome"))
    )


# --- user hooks -------------------------------------------------------------------


def _paragraphs(content: str) -> list[str]:
    return [line for line in content.split("\n") if line]


@query
def x01_block_extractor(spark, sf):
    return similarity.extracted_block_table(b.files(spark, sf), _paragraphs)


@query
def x01b_extractor_similarity(spark, sf):
    metrics = similarity.block_similarity(
        b.files(spark, sf), blocks=similarity.block_extractor(_paragraphs)
    )
    return metrics.select("file_id", "total_blocks", "duplicates_found", "max_similarity")


@query
def x02_embedding_model(spark, sf):
    embedder = embedding.model_embedder(_load_example_model)
    return _weights(embedding.embed(b.files(spark, sf), embedder=embedder), "file_id")


@query
def x03_reviewer(spark, sf):
    """A user reviewer that answers security requests with one finding and nothing else."""

    def answer(systems: list[str], texts: list[str]) -> list[str | None]:
        return [
            '[{"type": "xss", "severity": "high", "message": "m", "line": %d}]' % len(text) if "security" in system else None
            for system, text in zip(systems, texts)
        ]

    requests = prompts.request_table(_coded(spark, sf))
    reviewed = prompts.run_reviewer(requests, answer).select("file_id", "answer")
    return rp.parse_security(reviewed).select("file_id", "type", "severity", "message", "line")


@query
def x04_custom_rules(spark, sf):
    own = rules.custom_rules([r"eval\(", r"^def f1[0-9]"], issue_type="security", severity="high")
    return rules.scan_lines(_coded(spark, sf), [*rules.SECURITY_RULES, *own]).select(
        "file_id", "line", "rule_id", "severity"
    )


def _rule_rows(spark, sf) -> DataFrame:
    """Two rules for each part, one of them for one language, and a few whose matches have no text in common."""
    part = F.col("p_partkey").cast("string")
    none = F.array().cast("array<string>")
    parts = b.table(spark, sf, "part")

    def made(name: str, pattern: Column, severity: str, languages: Column = none, of: str = "true") -> DataFrame:
        return parts.where(of).select(
            F.concat(F.lit(f"{name}."), part).alias("rule_id"), pattern.alias("pattern"), F.lit("style").alias("type"),
            F.lit(severity).alias("severity"), F.concat(F.lit("uses "), part).alias("message"), F.lit("").alias("suggestion"),
            languages.alias("languages"))

    return (
        made("function", F.concat(F.lit("^def f"), part, F.lit(r"\(\)")), "low", F.array(F.lit("python")))
        .unionByName(made("variable", F.concat(F.lit("x"), part, F.lit(" = ")), "info"))
        .unionByName(made("start", F.concat(F.lit("^(def|var) [a-z]{"), part, F.lit("}")), "medium", of="p_partkey < 3"))
    )


@query
def x04b_rule_rows(spark, sf):
    index = rule_table.indexed(_rule_rows(spark, sf))
    return rule_table.scan_rule_rows(_coded(spark, sf), index).select("file_id", "line", "rule_id", "severity", "message")
