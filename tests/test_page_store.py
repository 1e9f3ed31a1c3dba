"""Stored lists: pages by number and behind a key, each from its own files."""

import glob

import pytest
from pyspark.sql import functions as F

from diffloom.operators import ordering
from diffloom.sources import page_store

ORDER = ["rank", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, (F.col("id") * 7) % 4).alias("rank"), F.lit("x").alias("page_name"))


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lists") / "list")
    page_store.write_list(rows, ORDER, path, rows_per_file=30)
    return path


def ids(frame):
    return [r["id"] for r in frame.collect()]


def test_pages_equal_ranked_pages(spark, rows, stored):
    paged = ordering.paginate(rows, [F.col(c) for c in ORDER], 70)
    for page in (1, 2, 8, 15):
        got = page_store.read_page(spark, stored, page, 70)
        want = paged.where(F.col("page") == page).orderBy(*ORDER)
        assert [r.asDict() for r in got.collect()] == [r.asDict() for r in want.select(got.columns).collect()]
    assert ids(page_store.read_page(spark, stored, 16, 70)) == []


def test_walk_by_key(spark, rows, stored):
    wanted, seen, after = ids(rows.orderBy(*ORDER)), [], None
    for _ in range(4):
        got = page_store.read_after(spark, stored, after, 100).collect()
        seen += [r["id"] for r in got]
        after = {c: got[-1][c] for c in ORDER}
    assert seen == wanted[:400]
    assert ids(page_store.read_after(spark, stored, {"rank": None, "id": 445}, 3)) == [450, 460, 470]  # no such row
    assert ids(page_store.read_after(spark, stored, {"rank": 9, "id": 0}, 3)) == []


def test_page_opens_only_its_files(spark, rows, tmp_path):
    path = str(tmp_path / "list")
    page_store.write_list(rows, ORDER, path, rows_per_file=30)
    index = spark.read.parquet(f"{path}/index").collect()
    assert len(index) > 30 and max(f["last"] - f["first"] for f in index) < 30
    needed = {f["file"] for f in index if f["last"] >= 201 and f["first"] <= 300}
    others = [f for f in glob.glob(f"{path}/rows/*.parquet") if f.rsplit("/", 1)[1] not in needed]
    for other in others:
        with open(other, "wb") as out:
            out.write(b"not parquet")
    wanted = ids(rows.orderBy(*ORDER))
    assert others and ids(page_store.read_page(spark, path, 5, 50)) == wanted[200:250]
    before = rows.where(F.col("id") == wanted[249]).first()
    assert ids(page_store.read_after(spark, path, {c: before[c] for c in ORDER}, 20)) == wanted[250:270]


def test_empty_list_and_bad_pages(spark, rows, stored, tmp_path):
    path = str(tmp_path / "none")
    page_store.write_list(rows.limit(0), ORDER, path)
    assert ids(page_store.read_page(spark, path, 1)) == [] and ids(page_store.read_after(spark, path, None)) == []
    for page, per_page in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            page_store.read_page(spark, stored, page, per_page)
