"""Landed pages of files: whole listings pass in order, all others are reported with reasons."""

from diffloom.sources import paging

PAGES = "pr_id string, page int, files array<struct<filename: string, status: string>>"


def page_rows(spark, rows):
    """(pull request, page, names)"""
    return spark.createDataFrame([(p, n, None if names is None else [(f, "added") for f in names]) for p, n, names in rows], PAGES)


def pull_rows(spark, rows):
    return spark.createDataFrame(rows, "pr_id bigint, changed_files int")


def reasons(report):
    return {r["pr_id"]: r["problems"] for r in report.collect()}


def test_every_kind_of_listing(spark):
    pages = page_rows(spark, [
        ("1", 1, "ab"), ("1", 2, "c"),                    # whole
        ("2", 1, "ab"), ("2", 2, "cd"), ("2", 3, ""),     # full pages, then an empty one
        ("3", 2, "c"),                                    # the first is missing
        ("4", 1, "a"), ("4", 2, "bc"), ("4", 3, "d"),     # one in between is short
        ("5", 1, "ab"),                                   # ends with a full page
        ("6", 1, "ab"), ("6", 2, "c"), ("6", 1, "ab"),    # one comes twice
        ("7", 1, "ab"), ("7", 2, "c"), ("7", 1, "ax"),    # ... and is another
        ("8", 1, "abc"), ("9", 0, "a"), ("10", None, "a"), ("11", 1, ""), ("12", 1, None), (None, 1, "a"),
    ])
    files, refused = paging.whole_files(pages, page_size=2)
    assert reasons(refused) == {
        "3": ["missing pages"], "4": ["short pages"], "5": ["no last page"], "7": ["different deliveries"], "8": ["long pages", "no last page"],
        "9": ["bad page number"], None: ["no pull request"]}
    found = {}
    for r in files.orderBy("pr_id", "file_index").collect():
        found.setdefault(r["pr_id"], []).append((r["file_index"], r["filename"]))
    assert found == {"1": [(0, "a"), (1, "b"), (2, "c")], "2": [(0, "a"), (1, "b"), (2, "c"), (3, "d")],
                     "6": [(0, "a"), (1, "b"), (2, "c")], "10": [(0, "a")]}


def test_against_pull_requests(spark):
    pages = page_rows(spark, [("1", 1, "ab"), ("2", 1, "ab"), ("3", 1, "a"), ("4", 1, "a")])
    pulls = pull_rows(spark, [(1, 2), (2, 3), (3, None), (5, 4), (6, 0), (None, 1)])
    files, refused = paging.whole_files(pages, pulls, page_size=2)
    assert reasons(refused) == {"2": ["no last page", "other number of files"], "4": ["no pull request"], "5": ["no pages"]}
    assert sorted((r["pr_id"], r["filename"]) for r in files.collect()) == [("1", "a"), ("1", "b"), ("3", "a")]


def test_empty_tables(spark):
    pages, pulls = page_rows(spark, [("1", 1, "a")]).limit(0), pull_rows(spark, [(1, 2)])
    files, refused = paging.whole_files(pages)
    assert files.count() == 0 and refused.count() == 0
    assert reasons(paging.page_report(pages, pulls)) == {"1": ["no pages"]}
