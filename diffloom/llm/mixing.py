"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.operators.ordering import running_total
from diffloom.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]*"
WEIGHTS = (5, 2, 1)
MOST = 3  #: a source gives at most this many times its size
BLOCK_WORDS = 16
SHARDS = 8
BROADCAST_SOURCES = 100_000
REPEATS = 100_000  #: rows of one doc_id and text that may meet their text in one task


def _key(source: Column) -> list[Column]:
    """A key without nulls, in code-point order with the null source last."""
    return [source.isNull().cast("int").alias("_last"), F.coalesce(source, F.lit("")).alias("_name")]


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``source_rank`` and ``target`` of each source.

    Sources in code-point order, null last, weigh ``weights`` over and over and share the
    whole size; a target stops at ``most`` times its source's size and the excess is shared
    by weight again until none is above. That ends at ``min(most * size, level * weight)``
    for one level: with sources ordered by cap over weight, the first sources are capped
    and the level is what remains over the weights that remain. Ranks and sums run over
    range partitions, so the number of sources has no bound.
    """
    keyed = sources.select(
        "source", F.col("source_size").cast("bigint").alias("source_size"), *_key(F.col("source")))
    ranked = running_total(keyed, [], [F.col("_last"), F.col("_name")], F.lit(1), "source_rank")
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("source_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    weighed = ranked.withColumn("_weight", choice.cast("bigint")).withColumn("_cap", F.col("source_size") * most)
    order = [F.col("_cap") / F.col("_weight"), F.col("source_rank")]
    caps = running_total(weighed, [], order, F.col("_cap"), "_caps", "_all_caps")
    both = checkpointed(running_total(caps, [], order, F.col("_weight"), "_weights", "_all_weights"))
    level = (F.col("_all_caps") / most - F.col("_caps") + F.col("_cap")) / (F.col("_all_weights") - F.col("_weights") + F.col("_weight"))
    # The level of the first source whose own cap is not below it.
    first = both.withColumn("_level", level).where(F.col("_level") * F.col("_weight") <= F.col("_cap")).agg(
        F.min(F.struct("_caps", "_weights", "_level")).getField("_level").alias("_level"))
    return both.crossJoin(F.broadcast(first)).select(
        "source", "source_size", "source_rank",
        F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")).alias("target"))


def _seats_at(share: Column, divisor: Column) -> Column:
    """Seats of a share at a divisor by rounding half down, as odd divisors give them."""
    return F.when(divisor > 0, F.greatest(F.lit(0), F.ceil(share / divisor - 0.5))).otherwise(F.lit(0)).cast("bigint")


def seats(targets: DataFrame, houses: list[int]) -> DataFrame:
    """``source``, ``house`` and ``seats``: the Sainte-Lague seats of each source in each house.

    The k-th seat of a source has the quotient ``target / (2k - 1)``; a house of h seats takes
    the h highest, ties by source rank. A divisor that cannot give too many seats deals out all but
    about as many seats as there are sources; only quotients between it and a divisor that
    cannot give too few are ranked. Houses are monotone: a larger one only adds seats.
    """
    total = targets.agg(F.sum("target").alias("_total"), F.count(F.lit(1)).alias("_n"))
    base = (
        targets.crossJoin(F.broadcast(total))
        .withColumn("house", F.explode(F.array(*[F.lit(h).cast("bigint") for h in houses])))
        .withColumn("_low", _seats_at(F.col("target"), F.when(
            F.col("house") > F.col("_n") / 2 + 1, F.col("_total") / (F.col("house") - F.col("_n") / 2 - 1)).otherwise(F.lit(0))))
        .withColumn("_high", _seats_at(F.col("target"), F.col("_total") / (F.col("house") + F.col("_n") / 2 + 1)) + 1)
        .withColumn("_high", F.when(F.col("target") > 0, F.greatest("_high", "_low")).otherwise(F.col("_low")))
    )
    base = checkpointed(base.select("source", "source_rank", "house", "target", "_low", "_high"))
    dealt = base.groupBy("house").agg(F.sum("_low").alias("_dealt"))
    open_seats = (
        base.where("_high > _low")
        .select("source_rank", "house", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"), "target")
        .withColumn("_quotient", F.col("target") / (2 * F.col("_k") - 1))
    )
    ranked = running_total(open_seats, ["house"], [F.desc("_quotient"), F.col("source_rank"), F.col("_k")], F.lit(1), "_place")
    taken = (
        ranked.join(dealt, "house").where(F.col("_place") + F.col("_dealt") <= F.col("house"))
        .groupBy("source_rank", "house").agg(F.count(F.lit(1)).alias("_more"))
    )
    return base.join(taken, ["source_rank", "house"], "left").select(
        "source", "source_rank", "house", (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("seats"))


def shard_quotas(targets: DataFrame, total_words: int, block_words: int, shards: int) -> DataFrame:
    """``source``, ``shard``, ``quota``: blocks of each source in each shard of the mix.

    Shard s takes the seats between the houses at its two ends, so each shard is mixed like the whole.
    """
    blocks = -(-total_words // block_words)
    houses = [blocks * (s + 1) // shards for s in range(shards)]
    cumulated = seats(targets, sorted(set(houses)))
    at = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(houses[s]).cast("bigint").alias("house")) for s in range(shards)])
    ends = cumulated.select("source", "source_rank", "house", "seats")
    named = ends.withColumn("_at", F.explode(F.filter(at, lambda x: x["house"] == F.col("house"))))
    quotas = named.select("source", "source_rank", F.col("_at.shard").alias("shard"), "seats")
    # The lists are as long as the number of shards.
    listed = quotas.groupBy("source_rank").agg(
        F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("shard", "seats"))).alias("_ends"))
    return listed.select("source", "source_rank", F.posexplode("_ends").alias("_i", "_end"), "_ends").select(
        "source", "source_rank", F.col("_end.shard").alias("shard"),
        (F.col("_end.seats") - F.when(F.col("_i") > 0, F.element_at("_ends", F.col("_i")).getField("seats")).otherwise(F.lit(0))).alias("quota"))


def _scattered(block: Column, blocks: Column, seed: int) -> Column:
    """A seeded one-to-one shuffle of block numbers: steps of a size prime to the number of blocks."""
    step = F.col("_step")
    wide = lambda c: c.cast("decimal(19,0)")
    # A step is below 2**31, so products of larger numbers only leave 64 bits.
    near = F.pmod(block * step + F.lit(seed), blocks)
    far = F.pmod(wide(block) * wide(step) + wide(F.lit(seed)), wide(blocks)).cast("bigint")
    return F.when(block < 2**31, near).otherwise(far)


def _planned(docs: DataFrame, carry: list[Column], weights: tuple[int, ...], most: int, block_words: int,
             shards: int, seed: int) -> DataFrame:
    """Rows with their place in their source's stream and their source's plan: passes, and blocks of the rest."""
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        *_key(F.col("source").cast("string")), *carry,
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("_order"))
    placed = checkpointed(running_total(
        sized.withColumn("_tie", F.monotonically_increasing_id()), ["_last", "_name"],
        [F.col("_order"), F.col("doc_id"), F.col("size"), F.col("_tie")], F.col("size"), "_end", "source_size").drop("_order", "_tie"))
    sources = placed.groupBy("_last", "_name").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(sources, weights, most))
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    if total:
        quotas = shard_quotas(targets, total, block_words, shards).groupBy("source_rank").agg(F.sum("quota").alias("quota"))
        targets = targets.join(quotas, "source_rank", "left")
    else:
        targets = targets.withColumn("quota", F.lit(0).cast("bigint"))
    words = F.coalesce("quota", F.lit(0)) * block_words
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(words / F.col("source_size")))).otherwise(F.lit(0)).cast("bigint")
    rest = F.when(F.col("_passes") < most, F.least(F.col("_blocks"), F.round(
        (words - F.col("_passes") * F.col("source_size")) / block_words))).otherwise(F.lit(0))
    # A prime near the golden section of 2**31 shares no factor with any number of blocks but its own multiples.
    step = F.when(F.pmod(F.col("_blocks"), F.lit(1327217909)) == 0, F.lit(1)).otherwise(
        F.pmod(F.lit(1327217909), F.greatest(F.col("_blocks"), F.lit(1))))
    plan = (
        targets.withColumn("_blocks", n_blocks).withColumn("_passes", passes).withColumn("_rest", rest.cast("bigint"))
        .withColumn("_step", step.cast("bigint"))
        .select(*_key(F.col("source")), "target", "quota", "_blocks", "_passes", "_rest", "_step")
    )
    # A few rows of plan go to every task; a plan of more sources is joined by shuffle.
    if targets.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return placed.join(plan, ["_last", "_name"]).withColumn("_start", F.col("_end") - F.col("size"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
                block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``quota``, ``taken`` for every row.

    A source's rows, in seeded hash order, are one stream of words cut into blocks of
    ``block_words`` (the last may be shorter). Its quota, the sum of its quotas over the
    shards, counts whole passes over the stream and a rest; a seeded
    shuffle of the block numbers says which blocks the rest takes. ``taken`` counts the row's words in all
    passes and chosen blocks, so it is at most ``most`` times its size, and a source's sum differs
    from its target by less than two blocks. Streams are positioned by running sums over
    range partitions: a source may hold any share of all rows.

    A null source is a source of its own, the last; null and blank texts have size 0 and
    nothing taken; repeated rows are rows of their own; an empty table gives no rows. Reruns agree.
    """
    joined = _planned(docs, [], weights, most, block_words, shards, seed)
    first = F.floor(F.col("_start") / block_words).cast("bigint")
    last = F.floor((F.col("_end") - 1) / block_words).cast("bigint")
    inside = F.aggregate(
        F.sequence(first, last), F.lit(0).cast("bigint"),
        lambda total, b: total + F.when(
            _scattered(b, F.col("_blocks"), seed) < F.col("_rest"),
            F.least(F.col("_end"), (b + 1) * block_words) - F.greatest(F.col("_start"), b * block_words)).otherwise(F.lit(0)))
    taken = F.col("_passes") * F.col("size") + F.when((F.col("size") > 0) & (F.col("_rest") > 0), inside).otherwise(F.lit(0))
    return joined.select("doc_id", "source", "size", "source_size", "target", "quota", taken.cast("bigint").alias("taken"))


def _with_texts(plan: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of the plan with their ``text``, found by ``_id`` and ``_digest``; a text is sent once for all rows of its key."""
    key = ["_id", "_digest"]
    once = lambda rows: rows.groupBy(*key).agg(F.first("text").alias("text"))
    # Rows repeated very often would meet in one task: their few texts are told first, so that a join of two plain tables is left, which Spark can split.
    often = plan.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > REPEATS)
    often = F.broadcast(checkpointed(often.select(*key)))
    if often.isEmpty():
        return plan.join(once(texts), key)
    few = checkpointed(once(texts.join(often, key, "left_semi")))
    return plan.join(often, key, "left_anti").join(once(texts), key).unionByName(plan.join(often, key, "left_semi").join(few, key))


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = 256,
                shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole pass over a text, and one for the words in chosen blocks.

    ``n_chars`` is counted anew for texts that are cut. Rows of which the mix takes nothing go. Other cases as in ``mix_sources``.
    Rows are placed without their texts, which are shuffled once, to meet their rows' places by digest.
    """
    others = [c for c in docs.columns if c != "text"]
    # Equal texts of one doc_id are one text; the doc_id deals the copies of a text over tasks.
    key = [F.xxhash64("doc_id").alias("_id"), F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("_digest")]
    plan = _planned(docs, [F.struct(*others).alias("_row"), *key], weights, most, block_words, shards, seed)
    plan = plan.where("size > 0 and (_passes > 0 or _rest > 0)")
    mixed = _with_texts(plan, docs.where(F.col("text").rlike(WORD)).select(*key, "text"))
    chosen = F.filter(
        # Each word with the blanks before it, so that lines stay lines.
        F.regexp_extract_all("text", F.lit(BLANKS + WORD), F.lit(0)),
        lambda _, i: _scattered(F.floor((F.col("_start") + i) / block_words).cast("bigint"), F.col("_blocks"), seed) < F.col("_rest"))
    rest = F.when(F.col("_rest") == F.col("_blocks"), F.col("text")).when(
        F.col("_rest") > 0, F.regexp_replace(F.array_join(chosen, ""), "^" + BLANKS, ""))
    # The whole passes, then the cut text: one pass over the rows makes both.
    taken = mixed.select("_row", "_passes", F.posexplode(F.concat(
        F.array_repeat("text", F.col("_passes").cast("int")), F.array(rest))).alias("_copy", "_text")).where("_text <> ''")
    made = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("_copy") < F.col("_passes"), F.col("_row.n_chars")).otherwise(
            F.length("_text").cast(dict(docs.dtypes)["n_chars"]))
    return taken.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
