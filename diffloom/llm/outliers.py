"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.session import scratch_path

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8  #: words of a window that counts as repeated
LEAST_WORDS = 20
MOST_REPEATED = 30  #: percent of a text's words in repeated windows
CORE = 0.75  #: share of a group's rows that its estimate rests on
WEIGHTED = 0.975  #: the final estimate takes rows within this quantile of the raw one
TAIL = 1e-5  #: a row is an outlier beyond the quantile 1 - TAIL
LEAST_ROWS = 50  #: smaller groups are pooled
UNIT = 1024  #: coordinates are whole multiples of 1 / UNIT, so that sums do not depend on their order
#: Words at which half of the distance of a text's mean word length from its group's counts, and lines at which half of its repeats do.
TRUSTED_WORDS, TRUSTED_LINES = 100, 4
#: Coordinates, and the spread that is added to each: differences well below it never make an outlier.
COORDINATES = {"length": 0.1, "word": 0.01, "symbols": 0.3, "lines": 0.08, "repeats": 0.1}
BINS = 64  #: distance bins of an octave
FALL = 1e-3  #: a concentration step is taken while it lowers the logarithm of the determinant by more than this
BROADCAST_GROUPS = 50_000
SALTS = 16
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bound_to(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, whatever the optimizer does with columns."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of WINDOW words that stand twice or more in the text; windows go by 64-bit hashes."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(pairs: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(pairs, j)["h"] == e["h"], F.lit(False))
            return F.filter(pairs, lambda e, j: same(e, j - 1) | same(e, j + 1))

        starts = F.sort_array(F.transform(_bound_to(pairs, twice), lambda e: e["i"]))
        step = lambda starts: F.aggregate(
            F.transform(starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"), lambda total, n: total + n)
        return _bound_to(starts, step)

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(covered(windows))

    def doubled(codes: Column, reach: int) -> Column:
        """The code of twice as many words from each place; places too near the end are cut off at last."""
        return F.transform(codes, lambda h, i: F.xxhash64(h, F.get(codes, i + reach)))

    def whole(codes: Column) -> Column:
        return F.slice(codes, F.lit(1), F.size(codes) - (WINDOW - 1))

    codes = F.transform(words, lambda w: F.xxhash64(w))
    found = _bound_to(codes, lambda one: _bound_to(doubled(one, 1), lambda two: _bound_to(
        doubled(two, 2), lambda four: _bound_to(whole(doubled(four, 4)), counted))))
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the five counts, ``n_lines`` (lines with a word) and ``base_failed``, in one pass over whole texts."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.array_remove(F.split(text, BLANKS), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
    )
    counted = split.select(
        "doc_id", "lang", "source", F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"), "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"), F.size("_lines").cast("bigint").alias("n_lines"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def chi_square(k: int, x: float) -> float:
    """P(chi-square with k degrees of freedom <= x), by its power series."""
    term = total = 1 / (k / 2)
    n = k / 2
    while term > total * 1e-16:
        n += 1
        term *= x / 2 / n
        total += term
    return total * math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2)) if x > 0 else 0.0


def chi_square_quantile(k: int, p: float) -> float:
    low, high = 0.0, 1.0
    while chi_square(k, high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(k, middle) < p else (low, middle)
    return high


def consistency(k: int, share: float) -> float:
    """What the covariance of the inner ``share`` of normal rows is multiplied by to be that of all."""
    return share / chi_square(k + 2, chi_square_quantile(k, share))


def _whole(value: Column) -> Column:
    return F.round(value * UNIT).cast("bigint")


def _mean_word() -> Column:
    return F.log(F.col("word_chars") / F.greatest("n_words", F.lit(1)))


def _coordinates(middle: Column) -> list[Column]:
    """The transformed vector; a short text's mean word length is drawn to its group's middle."""
    n = F.col("n_words")
    return [
        _whole(F.log(n)),
        _whole((_mean_word() - middle) * F.sqrt(n / (n + TRUSTED_WORDS))),
        _whole(F.log1p(100 * F.col("n_symbols") / F.col("word_chars"))),
        _whole(F.col("n_dup_lines") / (F.col("n_lines") + TRUSTED_LINES)),
        _whole(F.col("n_repeat_words") / n),
    ]


SIZE = len(COORDINATES)
MEANS = [f"m{i}" for i in range(SIZE)]
FACTORS = [f"w{i}{j}" for i in range(SIZE) for j in range(i + 1)]
SUMS = [f"s{i}" for i in range(SIZE)]
PRODUCTS = [f"p{i}{j}" for i in range(SIZE) for j in range(i + 1)]


def _square_distance(x: list[Column]) -> Column:
    """Mahalanobis distance, squared: the factors are the inverse of the covariance's Cholesky triangle."""
    total = F.lit(0.0)
    for i in range(SIZE):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}{j}") * (x[j] - F.col(f"m{j}"))
        total = total + z * z
    return total


def _factored(cells: DataFrame) -> DataFrame:
    """Adds the factors and ``log_det`` to cells with covariances ``c{i}{j}``; the added spreads keep every pivot positive."""
    for i in range(SIZE):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            cells = cells.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(SIZE):
        entries = {f"w{i}{i}": 1 / F.col(f"l{i}{i}")}
        for j in range(i):
            total = F.lit(0.0)
            for k in range(j, i):
                total = total + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            entries[f"w{i}{j}"] = -total / F.col(f"l{i}{i}")
        cells = cells.withColumns(entries)
    log_det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, SIZE)), 2 * F.log(F.col("l00")))
    return cells.select("cell", "middle", *MEANS, *FACTORS, log_det.alias("log_det"))


def _estimated(moments: DataFrame, scale: float) -> DataFrame:
    """Cells with mean, factors and ``log_det`` from exact sums: ``scale`` times the covariance, and the added spreads."""
    n = F.col("n").cast("double")
    spreads = list(COORDINATES.values())
    mean = {f"m{i}": F.col(f"s{i}").cast("double") / n for i in range(SIZE)}
    found = moments.withColumns(mean)
    found = found.withColumns({
        f"c{i}{j}": scale * (F.col(f"p{i}{j}").cast("double") / n - F.col(f"m{i}") * F.col(f"m{j}"))
        + (F.lit((spreads[i] * UNIT) ** 2) if i == j else F.lit(0.0))
        for i in range(SIZE) for j in range(i + 1)})
    return _factored(found)


def _kept(table: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that later steps neither repeat nor depend on what made it."""
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


class _Groups:
    """Rows that pass the base rules, and the cell that each (lang, source) belongs to.

    A pair with LEAST_ROWS rows is its own cell. Smaller pairs of a language are one cell, and what is still
    smaller is one cell in all; a last cell below LEAST_ROWS has no estimate.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows
        sized = rows.where("not base_failed").groupBy("pair").agg(
            F.first("lang").alias("lang"), F.count(F.lit(1)).alias("n"))
        own = F.col("n") >= LEAST_ROWS
        small = sized.where(~own).groupBy("lang").agg(F.sum("n").alias("_n"))
        of_lang = F.col("_n") >= LEAST_ROWS
        named = sized.withColumnRenamed("lang", "_lang").join(small, F.col("_lang").eqNullSafe(F.col("lang")), "left")
        cell = F.when(own, F.concat(F.lit("pair "), "pair")).when(of_lang, F.concat(F.lit("lang "), F.to_json(F.struct("lang"))))
        self.cells = _kept(named.select("pair", "n", F.coalesce(cell, F.lit("rest")).alias("cell")), "cells")
        self.few = self.cells.count() <= BROADCAST_GROUPS

    def beside(self, cells: DataFrame) -> DataFrame:
        """Every row beside what ``cells`` says of its cell, if it says something. A large pair is never one task."""
        by_pair = self.cells.select("pair", "cell").join(cells, "cell")
        if self.few:
            return self.rows.join(F.broadcast(by_pair), "pair", "left")
        salted = by_pair.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)).cast("int")
        return self.rows.withColumn("_salt", salt).join(salted, ["pair", "_salt"], "left").drop("_salt")

    def quantiles(self, value: Column, name: str, cells: DataFrame) -> DataFrame:
        """The 25, 50 and 75 % quantiles of a whole-numbered value per cell: counted by value, so no group is gathered."""
        counted = self.beside(cells).where("not base_failed and cell is not null").groupBy("cell", value.alias("v")).agg(
            F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counted.withColumn("_till", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy("cell")))
        at = lambda share: F.min(F.when(F.col("_till") >= share * F.col("_all"), F.col("v")))
        return summed.groupBy("cell").agg(F.struct(*[at(q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)]).alias(name))


def _moments(measured: DataFrame, limit: float | None) -> DataFrame:
    """Sums of the rows of a cell that lie nearest: its CORE share, or those within a squared distance.

    Rows are added up by distance bin, in each task first; a cell's bins, of bounded number, are then added from the nearest on.
    """
    binned = measured.withColumn("bin", F.floor(BINS * F.log2(1 + F.col("d"))).cast("int"))
    if limit is not None:
        binned = binned.where(F.col("d") <= limit).withColumn("bin", F.lit(0))
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    x = [F.col(f"x{i}") for i in range(SIZE)]
    by_bin = binned.groupBy("cell", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("middle").alias("middle"), *[exact(x[i]).alias(f"s{i}") for i in range(SIZE)],
        *[exact(x[i] * x[j]).alias(f"p{i}{j}") for i in range(SIZE) for j in range(i + 1)])
    nearer = Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    share = F.lit(1.0 if limit is not None else CORE)
    before = F.coalesce(F.sum("n").over(nearer), F.lit(0))
    core = by_bin.withColumn("_before", before).withColumn("_all", F.sum("n").over(Window.partitionBy("cell"))).where(
        F.col("_before") < share * F.col("_all"))
    return core.groupBy("cell").agg(F.sum("n").alias("n"), F.first("middle").alias("middle"), *[F.sum(c).alias(c) for c in (*SUMS, *PRODUCTS)])


def covariance_estimates(groups: _Groups) -> DataFrame:
    """Mean and factored covariance of each cell: minimum covariance determinant, then reweighted.

    The start is the median and quartile distance of each coordinate. Each concentration step takes the CORE
    share of a cell's rows nearest to the present estimate (with the rest of the last distance bin) and estimates anew;
    a cell is at its end when its determinant falls no further. The reweighted estimate takes all rows within the WEIGHTED quantile.
    """
    # A cell of LEAST_ROWS rows has an estimate; the last cell may be smaller.
    large = groups.cells.groupBy("cell").agg(F.sum("n").alias("_n")).where(F.col("_n") >= LEAST_ROWS).select("cell")
    middles = groups.quantiles(_whole(_mean_word()), "word", large)
    cells = _kept(middles.select("cell", (F.col("word.q50") / UNIT).alias("middle")), "middles")
    start = cells
    for name, value in zip(COORDINATES, _coordinates(F.col("middle"))):
        start = start.join(groups.quantiles(value, name, cells), "cell")
    for i, (name, spread) in enumerate(COORDINATES.items()):
        # 1.349 standard deviations lie between the quartiles of normal values.
        wide = (F.col(f"{name}.q75") - F.col(f"{name}.q25")) / 1.349
        start = start.withColumns({f"m{i}": F.col(f"{name}.q50").cast("double"), f"c{i}{i}": wide * wide + (spread * UNIT) ** 2,
                                   **{f"c{i}{j}": F.lit(0.0) for j in range(i)}})
    cells = _kept(_factored(start), "start")

    def rows_near(cells: DataFrame) -> DataFrame:
        return measured(groups, cells).where("not base_failed and d is not null")

    raw = consistency(SIZE, CORE)
    state = ["middle", *MEANS, *FACTORS, "log_det"]
    cells = cells.withColumn("log_det", F.lit(float("inf"))).withColumn("falls", F.lit(True))
    while not cells.where("falls").isEmpty():
        # Cells at their end keep their estimate, and their rows are left alone.
        moving = cells.where("falls")
        newer = _estimated(_moments(rows_near(moving), None), raw).select("cell", F.struct(*state).alias("_new"))
        moved = moving.select("cell", F.struct(*state).alias("_old")).join(newer, "cell").withColumn(
            "falls", F.col("_new.log_det") < F.col("_old.log_det") - FALL)
        moved = moved.select("cell", F.when(F.col("falls"), F.col("_new")).otherwise(F.col("_old")).alias("_s"), "falls").select(
            "cell", "_s.*", "falls")
        cells = _kept(moved.unionByName(cells.where("not falls")), "estimate")
    within = chi_square_quantile(SIZE, WEIGHTED)
    return _kept(_estimated(_moments(rows_near(cells.drop("falls")), within), consistency(SIZE, WEIGHTED)), "estimate")


def measured(groups: _Groups, cells: DataFrame) -> DataFrame:
    """Every row with its coordinates ``x0``, ... and squared distance ``d``; null where the base rules or a lacking estimate leave none."""
    near = groups.beside(cells)
    usable = ~F.col("base_failed") & F.col("cell").isNotNull()
    placed = near.withColumns({f"x{i}": F.when(usable, x) for i, x in enumerate(_coordinates(F.col("middle")))})
    return placed.withColumn("d", F.when(usable, _square_distance([F.col(f"x{i}") for i in range(SIZE)])))


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept`` and ``distance`` for each row of ``docs`` (doc_id, text, lang, source).

    Counts are of the whole text: words between ASCII blanks, code points in words, characters of ``#*$%&|<>``, lines
    with a word that equal an earlier one, words in 8-word windows found twice or more. Rows with under 20 words or
    over 30 % repeated words fail the base rules. The others are vectors (log words, log mean word length, log
    symbols, repeated lines, repeated words), and a row is dropped if its Mahalanobis distance from the robust estimate of
    its language and source lies beyond the chi-square quantile 1 - TAIL. Pairs of under 50 rows are pooled
    by language, then together; if fewer are left, they are kept.

    Everything is DataFrame code. Texts are read once; the counts are written to the shared folder and every step
    of the estimate passes over them, adding up sums in each task before the shuffle, so a source with most of the rows is no
    larger after it than another. Sums are of whole numbers: reruns agree.

    A null text has no words. A null language or source is a value like others. Null doc_ids and repeated rows
    give a row each and count in the estimate; an empty table gives no rows; other columns fall away.
    """
    pair = F.to_json(F.struct("lang", "source"))  # leaves nulls out, so a null differs from every text
    rows = _kept(statistics(docs).withColumn("pair", pair), "statistics")
    groups = _Groups(rows)
    found = measured(groups, covariance_estimates(groups))
    limit = chi_square_quantile(SIZE, 1 - TAIL)
    return found.select(
        "doc_id", *STATISTICS, "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("d") > limit, F.lit(False))).alias("kept"), F.sqrt("d").alias("distance"))
