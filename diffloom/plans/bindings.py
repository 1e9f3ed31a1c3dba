"""Review-shaped views over the given test tables.

Every view covers its whole table. The shapes (declarations, risky statements,
patch signs, states) are derived row by row so that each rule branch occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pr_of_document() -> Column:
    """Review of a document: groups of 20 and 21 neighbours, so reviews grow with the table."""
    place = F.col("doc_id") % 41
    return F.floor(F.col("doc_id") / 41) * 2 + F.when(place >= 20, 1).otherwise(0)


def _path_of_document() -> Column:
    folder = F.element_at(
        F.array(*[F.lit(x) for x in ("src", "tests", "config", "docs", "lib")]), (F.col("doc_id") % 5 + 1).cast("int")
    )
    suffix = F.element_at(
        F.create_map(*[F.lit(x) for x in ("en", ".py", "de", ".js", "es", ".ts", "fr", ".md")]), F.col("lang")
    )
    return F.concat(folder, F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix)


def _status_of_document() -> Column:
    kind = F.col("doc_id") % 6
    return F.when(kind == 0, "added").when(kind == 1, "removed").when(kind == 2, "renamed").otherwise("modified")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as changed files with their plain text as content."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("file_id"),
        _pr_of_document().cast("bigint").alias("pr_id"),
        _path_of_document().alias("path"),
        _status_of_document().alias("status"),
        (F.col("n_chars") % 40).alias("additions"),
        (F.col("n_chars") % 13).alias("deletions"),
        F.col("text").alias("content"),
    )


def _code_line(line: Column, i: Column) -> Column:
    number, place = i.cast("string"), i % 35

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    odd = F.col("file_id") % 2 == 1
    return (
        F.when(line == "", line)
        .when(odd & (i % 7 == 0), text("def f", (i % 21).cast("string"), "():"))
        .when(odd & (i % 7 == 3), text("var x", number, " = ", line))
        .when(odd & (place == 5), text("    eval(", line, ")"))
        .when(odd & (place == 12), text('    q = "SELECT a FROM t WHERE b = " + ', line))
        .when(odd & (place == 19), text("    el.innerHTML = ", line))
        .when(odd & (place == 26), text('    token = "', line, '"'))
        .when(odd & (place == 33), text("    from m import *  # except: ", line))
        .when(odd & (place == 6), text("    if a == b: console.log(a) else: for x in y: ", line))
        .when(i == 0, text("def f0():"))
        .otherwise(text("    ", line))
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with content shaped like code."""
    shaped = F.array_join(F.transform(F.split("content", "\n", -1), _code_line), "\n")
    return files(spark, sf_dir).withColumn("content", shaped)


def patched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files with a patch: header lines, then added, removed and context lines in turn.

    Every eleventh file has an empty patch.
    """
    signed = F.transform(
        F.split("content", "\n", -1),
        lambda line, i: F.concat(F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" "), line),
    )
    header = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ @@\n"))
    patch = F.when(F.col("file_id") % 11 == 0, F.lit("")).otherwise(F.concat(header, F.array_join(signed, "\n")))
    return code_files(spark, sf_dir).withColumn("patch", patch)


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey")


def _line_item_id() -> Column:
    return F.md5(
        F.concat_ws(
            "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.round(F.col("l_quantity")).cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            F.unix_micros(F.col("l_shipdate").cast("timestamp")),
        ).cast("binary")
    )


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw issues of the file (order, supplier) in the review of the order."""
    kinds = ["style", "bug", "performance", "security", "best_practice", "complexity", "maintainability",
             "documentation", "quality"]
    levels = ["info", "low", "medium", "high", "critical", "error", "warning"]

    def pick(values: list[str], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    part, line = F.col("l_partkey"), F.col("l_linenumber")
    file_key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    return line_items(spark, sf_dir).select(
        _line_item_id().alias("issue_id"),
        F.col("l_orderkey").alias("pr_id"),
        F.when(part % 20 != 0, file_key).alias("file_id"),
        pick(kinds, part % 9).alias("type"),
        pick(levels, (part + line) % 7).alias("severity"),
        F.when(part % 3 == 0, F.concat(F.lit("title "), part.cast("string"))).alias("title"),
        F.when(part % 4 != 0, F.concat(F.lit("message "), part.cast("string"))).alias("message"),
        F.when(part % 2 == 0, F.concat(F.lit("description "), part.cast("string"))).alias("description"),
        line.alias("line"),
        F.when(part % 5 == 0, (part % 80).cast("int")).alias("column"),
        F.concat(F.lit("r"), (part % 7).cast("string")).alias("rule_id"),
        F.when(part % 6 == 0, F.lit("do this")).alias("suggestion"),
        F.when(part % 6 == 1, F.lit("rather that")).alias("recommendation"),
        F.when(part % 8 == 0, F.lit("high")).when(part % 8 == 1, F.lit(None))
        .otherwise(F.col("l_discount").cast("string")).alias("confidence"),
    )


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored file rows: one per (order, supplier)."""
    items = line_items(spark, sf_dir)
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
    grouped = items.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum(F.when(flag == "A", quantity)).cast("bigint").alias("lines_added"),
        F.sum(F.when(flag == "R", quantity)).cast("bigint").alias("lines_removed"),
        F.count(F.lit(1)).alias("lines_analyzed"),
    )
    kinds = F.array(*[F.lit(x) for x in ("python", "javascript", "markdown", "")])
    return grouped.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("id"),
        F.col("l_orderkey").alias("pr_analysis_id"),
        F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file_path"),
        F.element_at(kinds, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("file_type"),
        "lines_added", "lines_removed", "lines_analyzed",
        (F.col("l_suppkey") % 50).cast("double").alias("complexity_score"),
    )


def stored_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised issues in the stored shape."""
    from diffloom.operators.issues import normalise_issues

    return normalise_issues(raw_issues(spark, sf_dir)).withColumnsRenamed(
        {"issue_id": "id", "pr_id": "pr_analysis_id", "file_id": "file_analysis_id"}
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as review tasks."""
    state = F.col("o_orderstatus")
    urgency = F.col("o_orderpriority")
    started = F.col("o_orderdate").cast("timestamp")
    minutes = (F.col("o_custkey") % 90).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("https://github.com/team"), (F.col("o_custkey") % 10).cast("string"), F.lit("/repo"),
                 (F.col("o_custkey") % 7).cast("string")).alias("repo_url"),
        F.col("o_orderkey").cast("int").alias("pr_number"),
        F.when(state == "F", "failed").when(state == "O", "completed").otherwise("processing").alias("status"),
        F.when(urgency == "1-URGENT", "urgent").when(urgency == "2-HIGH", "high")
        .when(urgency == "5-LOW", "low").otherwise("normal").alias("priority"),
        (F.col("o_custkey") % 5).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
        started.alias("created_at"),
        F.when(F.col("o_custkey") % 9 != 0, started).alias("started_at"),
        F.when(state != "P", F.timestamp_add("MINUTE", minutes, started)).alias("completed_at"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored analyses, with partly missing totals; the cheapest orders were never analysed."""
    costly = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 60000).select(F.col("o_orderkey").alias("id"))
    return all_analyses(spark, sf_dir).join(costly, "id", "left_semi")


def all_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored analysis for every order, with partly missing totals."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("task_id"),
        F.lit("completed").alias("status"),
        F.when(F.col("o_custkey") % 3 == 0, (F.col("o_custkey") % 2) * 7).cast("bigint").alias("total_files_analyzed"),
        F.when(F.col("o_custkey") % 3 == 1, (F.col("o_custkey") % 2) * 11).cast("bigint").alias("total_issues_found"),
        (F.col("o_custkey") % 101).cast("double").alias("quality_score"),
        F.array(F.lit("fine")).alias("recommendations"),
        F.concat(F.lit("pull/"), F.col("o_orderkey").cast("string")).alias("pr_url"),
        F.lit("main").alias("base_branch"),
        F.lit("topic").alias("head_branch"),
    )


def task_events(events: DataFrame) -> DataFrame:
    """Events as task events; works on the table and on a stream of it."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("task_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "signup", "processing").when(kind == "click", "retry")
        .when(kind == "purchase", "completed").when(kind == "error", "failed").alias("state"),
        F.when(kind == "view", F.col("value").cast("int")).alias("progress"),
        kind.alias("stage"),
        F.when(F.col("event_id") % 5 != 0, F.concat(kind, F.lit(" "), F.col("event_id").cast("string")))
        .alias("message"),
    )


def event_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_events(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return task_events(stream)


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of all pages and, per page, one address on the code host in one of eight spellings."""
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("team-"), (F.col("page_id") % 97).cast("string"))
    repo = F.concat(F.lit("repo."), F.col("page_id").cast("string"))
    https = F.concat(F.lit("https://github.com/"), name, F.lit("/"), repo)
    form = F.col("page_id") % 8
    hub = (
        F.when(form == 0, https)
        .when(form == 1, F.concat(https, F.lit("/")))
        .when(form == 2, F.concat(https, F.lit(".git")))
        .when(form == 3, F.concat(F.lit("git@github.com:"), name, F.lit("/"), repo, F.lit(".git")))
        .when(form == 4, F.concat(F.lit("  "), https, F.lit("\n")))
        .when(form == 5, F.concat(https, F.lit("/pull/7")))
        .when(form == 6, F.concat(F.lit("https://github.com/"), name))
        .otherwise(F.concat(F.lit("https://example.com/"), name, F.lit("/"), repo))
    )
    return pages.select((F.col("page_id") * 2).alias("url_id"), "url").unionByName(
        pages.select((F.col("page_id") * 2 + 1).alias("url_id"), hub.alias("url"))
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as model answers: an object, a list, free text or nothing."""
    text = F.col("text")
    issue = F.struct(
        F.lit("xss").alias("type"), F.lit("high").alias("severity"), text.alias("message"),
        (F.col("turn") + 1).alias("line"), F.lit("0.9").alias("confidence"),
    )
    answer = F.to_json(
        F.struct(
            (F.col("turn") + 0.5).alias("score"),
            F.array(issue, issue).alias("issues"),
            F.array(text).alias("suggestions"),
            F.struct(F.lit(4).alias("maintainability"), F.lit(5).alias("readability"), F.lit(6).alias("complexity"))
            .alias("metrics"),
        )
    )
    form = F.col("conv_id") % 4
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"),
        F.when(form == 0, answer).when(form == 1, F.to_json(F.array(issue))).when(form == 2, text).alias("answer"),
    )
