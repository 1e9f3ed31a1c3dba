"""Similar sets in a whole corpus: an exact self-join on Jaccard similarity under prefix, length and position filters.

Words are put in one order, rare ones first, and meet as 64-bit numbers that hold their place in it and a hash; equal words have equal
numbers, so a number of two words only makes more candidates. Two sets that reach the threshold share a word among the first few of each (the
prefix), differ in size by no more than the threshold allows, and from their first common word on have enough words left.
A signature of some hundred bits for each set bounds what two sets can share; it is tested where prefixes meet. Only pairs that
pass all four are compared, so whole sets are moved for hardly more pairs than are similar. Prefixes meet by word and size class, so a word of many sets is
spread over the sizes it occurs with. Everything is a built-in expression or join; no set goes through Python.

What a step has shuffled goes when the step ends. Meetings and comparisons are made in lots, as many as keep the shuffle of one
lot in proportion to the words of all sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.operators.duplicates import link_classes
from diffloom.session import checkpointed, dropped, shuffles_removed, stored

ORDERED_WORDS = 1_000_000  #: at most this many of the most frequent words are ordered by frequency; all others come before them, by hash
SENT_IDS = 500_000  #: up to about this many digests or ids go to every task
HASH_BITS = 44  #: of a word's number; those above are the number of its sets, as far as they hold it
MOST_SEEN = (1 << (63 - HASH_BITS)) - 1
ALONE = -1  #: stands for a word of one set, which meets none
LOT_BYTES = 256 << 20  #: a lot shuffles at most about so much, or 16 bytes for each word of each set if that is more
SETS_HELD = 20_000  #: sets that a task may hold while it puts their words in order; beyond it sorts words
SIGNATURE_LONGS = (4, 32)  #: least and most 64-bit parts of a signature
FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
SLACK = 1.0001  #: keeps rounding of logarithms from parting sizes that may be similar


def _least_share(size: Column, percent: int) -> Column:
    return F.ceil(size * percent / F.lit(100))


def _digest(items: Column) -> Column:
    """Tells sets apart; the lengths say where a word ends. The set is computed once, though it is named twice."""
    def digest(words: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.array_join(words, ""), F.array_join(F.transform(words, F.octet_length), ",")), 256)

    return F.coalesce(F.transform(F.array(items), digest)[0], F.lit(""))


def distinct_sets(rows: DataFrame, id_col: str, set_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (``first_id``, ``items``, ``n``, ``copies``), and the ``first_id`` of every entry."""
    spark = rows.sparkSession
    items = F.sort_array(F.array_distinct(F.array_compact(F.coalesce(set_col, F.array().cast("array<string>")))))
    path = stored(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), items.alias("items")).withColumn(
        "digest", _digest(F.col("items"))), "entries")
    entries = spark.read.parquet(path)
    named = spark.read.parquet(stored(entries.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "digests"))
    # Only sets with copies are shuffled to fold them.
    several = named.where("copies > 1").select("digest")
    several = F.broadcast(several) if several.count() <= SENT_IDS else several
    alone = entries.join(several, "digest", "left_anti").select("items", F.col("id").alias("first_id"), F.lit(1).cast("bigint").alias("copies"))
    folded = entries.join(several, "digest", "left_semi").groupBy("items").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    sets = spark.read.parquet(stored(alone.unionByName(folded).withColumn("n", F.size("items")), "sets"))
    members = spark.read.parquet(stored(entries.select("id", "digest"), "members"))
    dropped(spark, path)
    # Entries meet their set by its digest; no words are shuffled for it.
    return sets, members.join(named.select("digest", "first_id"), "digest").select("id", "first_id")


def _frequent(words: DataFrame) -> tuple[DataFrame, bool]:
    """The words of most sets and their number of sets ``seen``, at most ``ORDERED_WORDS``; whether these are all words of several sets."""
    with shuffles_removed(words.sparkSession):
        counts = checkpointed(words.groupBy("word").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1"))
    steps = counts.groupBy("seen").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("seen")).limit(ORDERED_WORDS + 1).toLocalIterator()
    held, least = 0, None
    for step in steps:
        held += step["n"]
        if held > ORDERED_WORDS:
            break
        least = step["seen"]
    return counts.limit(0) if least is None else counts.where(F.col("seen") >= least), held <= ORDERED_WORDS


def _lots(size: float, words: int) -> int:
    """Lots for what shuffles ``size`` bytes, of sets with so many words."""
    return max(1, math.ceil(size / max(LOT_BYTES, 16 * words)))


def rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """``first_id``, ``n``, ``prefix`` and ``signature`` of each set.

    Words stand in one order for all: rare words by hash, then frequent words by their number of sets. Similar sets share a
    word in their prefixes. Each word sets the bit of its hash in the signature.
    """
    spark = sets.sparkSession
    words = sets.select("first_id", "n", F.explode("items").alias("word")).select("first_id", "n", F.xxhash64("word").alias("word"))
    mean = sets.agg(F.avg("n")).first()[0] or 0
    longs = int(min(max(mean * 2 / 64 + 1, SIGNATURE_LONGS[0]), SIGNATURE_LONGS[1]))
    frequent, all_known = _frequent(words)
    low = F.col("word").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    place = F.when(F.col("seen").isNull(), F.lit(ALONE).cast("bigint") if all_known else low).otherwise(
        F.shiftleft(F.least("seen", F.lit(MOST_SEEN)), HASH_BITS).bitwiseOR(low))
    ranked = words.join(F.broadcast(frequent), "word", "left").withColumn("place", place).withColumn(
        "bit", F.pmod("word", F.lit(64 * longs)).cast("int")).selectExpr(
        "first_id", "n", "place", "shiftright(bit, 6) AS part", "shiftleft(1L, bit & 63) AS mask")
    parts = [F.bit_or(F.when(F.col("part") == k, F.col("mask")).otherwise(F.lit(0).cast("bigint"))) for k in range(longs)]
    ordered = ranked.groupBy("first_id", "n").agg(F.sort_array(F.collect_list("place")).alias("places"), F.array(*parts).alias("signature"))
    length = (F.col("n") - _least_share(F.col("n"), percent) + 1).cast("int")
    before = spark.conf.get(FALLBACK, None)
    spark.conf.set(FALLBACK, str(SETS_HELD))
    try:
        path = stored(ordered.select("first_id", "n", F.slice("places", F.lit(1), length).alias("prefix"), "signature"), "prefixes")
    finally:
        spark.conf.unset(FALLBACK) if before is None else spark.conf.set(FALLBACK, before)
    return spark.read.parquet(path)


def candidates(ordered: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of sets (:func:`rare_first`) that pass the filters; every similar pair is among them."""
    spark = ordered.sparkSession
    width = F.lit(100 / percent * SLACK)
    first = ordered.select(F.size("signature")).first()
    longs = first[0] if first else 0
    size_class = F.floor(F.log("n") / F.log(width)).cast("int") if percent < 100 else F.col("n")
    parts = [F.col("signature")[k].alias(f"bits_{k}") for k in range(longs)]
    prefix = ordered.select("first_id", "n", size_class.alias("size_class"), *parts, F.posexplode("prefix").alias("at", "word")).where(F.col("word") != ALONE)
    # Size and place travel as one number, word and size class as another: what meets by chance is parted by the conditions below.
    packed = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("at").cast("bigint")).alias("packed")

    def side(some: DataFrame, name: str, of: Column) -> DataFrame:
        rows = some.select("*", of.alias("_class")).select("first_id", packed, *[f"bits_{k}" for k in range(longs)], F.xxhash64("word", "_class").alias("key"))
        return rows.toDF(name, f"packed_{name}", *[f"bits_{name}{k}" for k in range(longs)], "key")

    n_a, n_b = (F.shiftright(f"packed_{c}", 32) for c in "ab")
    at_a, at_b = (F.col(f"packed_{c}").bitwiseAND(F.lit(0xFFFFFFFF)) for c in "ab")
    both = n_a + n_b
    left = F.least(n_a - at_a, n_b - at_b)
    # A larger set meets smaller ones of its own size class and the one below.
    classes = F.array("size_class", F.col("size_class") - 1) if percent < 100 else F.array("size_class")
    # Sets whose signatures differ in so many bits have at least as many words that are not common.
    differing = sum((F.bit_count(F.col(f"bits_a{k}").bitwiseXOR(F.col(f"bits_b{k}"))) for k in range(longs)), F.lit(0))
    met = F.size(F.filter("prefix", lambda word: word != ALONE))
    meetings, words = ordered.agg(F.coalesce(F.sum(met), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A word is sent once for the smaller set and for both classes of the larger.
    lots, paths = _lots(meetings * 3 * (32 + 8 * longs), words), []
    for lot in range(lots):
        some = prefix.where(F.pmod("word", F.lit(lots)) == lot)
        small, large = side(some, "a", F.col("size_class")), side(some, "b", F.explode(classes))
        paths.append(stored(small.join(large, "key").where(
            ((n_a < n_b) | ((n_a == n_b) & (F.col("a") < F.col("b"))))
            & (100 * n_a >= percent * n_b)
            & ((100 + percent) * left >= percent * both)
            & ((100 + percent) * (both - differing) >= 2 * percent * both)).select("a", "b").distinct(), "candidates"))
    found = spark.read.parquet(*paths)
    return found if lots == 1 else found.distinct()


def similar_pairs(sets: DataFrame, percent: int = 80) -> DataFrame:
    """``id_a < id_b`` and ``similarity`` of all pairs of distinct sets (``first_id``, ``items``, ``n``) whose
    intersection has at least ``percent`` hundredths of their union."""
    if not 0 < percent <= 100:
        raise ValueError("percent must lie above 0 and at most at 100")
    spark = sets.sparkSession
    filled = sets.where("n > 0")
    pairs = spark.read.parquet(stored(candidates(rare_first(filled, percent), percent), "pairs"))
    n, words, compared = *filled.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first(), pairs.count()
    # A lot moves the words of its sets, and for each pair those of its set a again.
    lots, paths = _lots(16 * words * (1 + 2 * compared / max(1, n)), words), []
    for lot in range(lots):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(lots)) == lot)
        # Sets without a pair in the lot are not moved; both joins read the same shuffle of the others.
        named = some.select(F.explode(F.array("a", "b")).alias("first_id")).distinct()
        bodies = filled.select("first_id", "items").join(F.broadcast(named) if 2 * compared <= lots * SENT_IDS else named, "first_id", "left_semi")
        met = some.join(bodies.toDF("a", "items_a"), "a").join(bodies.toDF("b", "items_b"), "b")
        paths.append(stored(met.select(
            "a", "b", F.size("items_a").alias("n_a"), F.size("items_b").alias("n_b"), F.size(F.array_intersect("items_a", "items_b")).alias("common")), "compared"))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    similar = spark.read.parquet(*paths).where(100 * F.col("common") >= percent * union).select(
        F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), (F.col("common") / union).alias("similarity"))
    # As few files as there are cores: lots leave many small ones.
    return spark.read.parquet(stored(similar.coalesce(spark.sparkContext.defaultParallelism), "similar"))


def similar_sets(rows: DataFrame, id_col: str, set_col: str, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Classes of entries with similar sets, and the links between distinct sets.

    The first result has a row for each entry: ``id``, ``first_id`` (least id with an equal set), ``class_id`` (least
    first_id that links reach, its own without links) and ``n_links``, the number of other entries whose set is
    similar. The second has ``id_a``, ``id_b`` and ``similarity`` for each pair of distinct similar sets.

    Equal sets are one set with copies and never make pairs. Two empty sets are equal and similar, an empty one is like no other; a
    null array is empty, null items count nowhere, entries without an id have no part. Ids are
    distinct. An empty table gives no rows.
    """
    sets, members = distinct_sets(rows, id_col, set_col)
    pairs = similar_pairs(sets, percent)
    copies = sets.select("first_id", "copies")
    sides = pairs.select(F.col("id_a").alias("first_id"), F.col("id_b").alias("_met")).union(pairs.select("id_b", "id_a"))
    met = sides.join(copies.toDF("_met", "_copies"), "_met").groupBy("first_id").agg(F.sum("_copies").alias("_others"))
    classes = link_classes(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).withColumnRenamed("id", "first_id")
    named = copies.join(met, "first_id", "left").join(classes, "first_id", "left").select(
        "first_id", F.coalesce("class_id", "first_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"))
    return members.join(named, "first_id").select("id", "first_id", "class_id", "n_links"), pairs
