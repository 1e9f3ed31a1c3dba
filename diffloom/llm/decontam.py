"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.words import normal_words, seed_hash, sent_to_tasks, word_rows
from diffloom.session import checkpointed

#: Word positions that a seed reads; it ignores those between. Together they hit every window of
#: 20 words with at most 4 substitutions, and shorter ones of 10 words or more with at most a fifth.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 5, 6), (0, 2, 3, 4, 5), (0, 1, 2, 7, 8))
REACH = 9
WINDOW = 20
SHARE = 0.8
#: A filter has about 32 bits for each seed, in rows of 64, up to this many rows: 64 MB in a task's memory.
FILTER_ROWS = 1 << 21
#: Up to this many seeds go to every task; more are joined by shuffle, with the hits that the filter lets through.
SENT_SEEDS = 200_000
#: Bits of a key that name its places in a row of the filter; those above name the row.
PLACES = (0, 6, 12, 18)
ROW_AT = 24


def _seeds(items: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    rows = word_rows(items.select("item", "words"), REACH)
    keys = F.array_compact(F.array(*[seed_hash(m) for m in masks]))
    return rows.select("item", F.col("at").alias("item_at"), F.explode(keys).alias("key"))


def _row(key: str, rows: int) -> Column:
    return F.expr(f"shiftrightunsigned({key}, {ROW_AT}) & {rows - 1}L")


def _places(key: str) -> Column:
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({key}, {at}) & 63 AS int))" for at in PLACES))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``doc_id``, ``item_id``, ``matched``, ``compared``, ``doc_at`` for each document and item that overlap.

    Words are runs of letters and digits in lower case. Fixed masks read some words of a
    stretch and skip others; equal hashes under the same mask place an item against a
    document, and the aligned words are compared one by one: they overlap if some
    ``window`` words of the alignment (all of the item if it is shorter) agree in at least ``share`` of
    their positions. Substitutions inside are tolerated, insertions start another alignment.

    Every word of every text is a possible start: the hash of each mask is looked up in a filter of the benchmark's
    hashes, whose size is bounded and which goes to every task. What it lets through, hashes and no words, meets the seeds: in tasks if
    their counted number allows, by shuffle otherwise. Hits on one alignment fold into one, map-side first; only then the texts
    that have any are read again.

    Items of fewer words than the longest mask reaches match only whole and exact, items
    without words never. Null texts have no words; null doc_ids stay null; repeated rows
    of a document give their pair once for each different text; equal items are all named. Empty
    tables give no rows.
    """
    items = checkpointed(benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), normal_words(F.col("text")).alias("words")
    ).where(F.size("words") > 0).withColumn("item", F.xxhash64(F.array_join("words", " "))))
    texts = items.groupBy("item").agg(F.first("words").alias("words"))
    lengths = sorted(r[0] for r in texts.where(F.size("words") < REACH).select(F.size("words")).distinct().collect())
    whole = tuple(tuple(range(n)) for n in lengths)
    long_seeds = _seeds(texts.where(F.size("words") >= REACH), MASKS)
    seeds = long_seeds
    for offsets in whole:
        seeds = seeds.union(_seeds(texts.where(F.size("words") == len(offsets)), (offsets,)))
    seeds = checkpointed(seeds)
    count = seeds.count()
    blocks = min(FILTER_ROWS, 1 << max(6, (count // 2).bit_length()))
    placed = seeds.groupBy(_row("key", blocks).alias("row")).agg(F.bit_or(_places("key")).alias("bits"))

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = word_rows(named.select("doc_id", "text_key", normal_words(F.col("text")).alias("words")), REACH)
    masks = MASKS + tuple(w for w in whole if w not in MASKS)
    for k, mask in enumerate(masks):
        key, wanted = f"k{k}", _places(f"k{k}")
        rows = rows.withColumn(key, seed_hash(mask)).join(F.broadcast(placed), _row(key, blocks) == F.col("row"), "left")
        # The key stays where the filter may hold it.
        rows = rows.withColumn(key, F.when(F.col("bits").bitwiseAND(wanted) == wanted, F.col(key))).drop("row", "bits")
    keys = [F.col(f"k{k}") for k in range(len(masks))]
    hits = rows.where(F.coalesce(*keys).isNotNull()).select("doc_id", "text_key", "at", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    met = hits.join(F.broadcast(seeds) if count <= SENT_SEEDS else seeds, "key")
    alignments = checkpointed(met.select(
        "doc_id", "text_key", "item", (F.col("at") - F.col("item_at")).alias("doc_at")).distinct())

    sizes = texts.select("item", F.size("words").alias("n_item"))
    n_items, n_words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_item"), F.lit(0))).first()
    hit_texts = alignments.select("text_key").distinct()
    read = named.join(sent_to_tasks(hit_texts, hit_texts.count()), "text_key", "left_semi").groupBy("doc_id", "text_key").agg(
        F.first("text").alias("text")).select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), normal_words(F.col("text")).alias("doc_words"))
    # The document's words that face the item, from the document's start if the item begins before it.
    faced = alignments.join(sent_to_tasks(sizes, n_items), "item").join(
        read, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select(
        "doc_id", "item", "doc_at",
        F.slice("doc_words", F.greatest("doc_at", F.lit(0)) + 1, F.col("n_item") + F.least("doc_at", F.lit(0))).alias("facing"))
    compared = faced.join(sent_to_tasks(texts, n_words), "item")
    offset = F.greatest(-F.col("doc_at"), F.lit(0))
    same = F.zip_with(
        F.slice("words", offset + 1, F.size("facing")), F.col("facing"), lambda a, b: F.when(a == b, 1).otherwise(0))
    width = F.least(F.size("words"), F.lit(window))
    sums = F.when(F.size("same") >= F.col("width"), F.array_max(F.transform(
        F.sequence(F.lit(1), F.size("same") - F.col("width") + 1),
        lambda i: F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), lambda s, x: s + x))))
    scored = compared.withColumn("same", same).withColumn("width", width).withColumn("matched", sums)
    # Items under the reach of the masks met them whole.
    need = F.when(F.size("words") < REACH, F.col("width")).otherwise(F.ceil(F.col("width") * share - 1e-9))
    found = scored.where(F.col("matched") >= need).groupBy("doc_id", "item").agg(
        F.max(F.struct(F.col("matched"), F.col("width").alias("compared"), (-F.col("doc_at")).alias("_at"))).alias("best"))
    return found.join(items.select("item", "item_id"), "item").select(
        "doc_id", "item_id", F.col("best.matched").cast("bigint").alias("matched"),
        F.col("best.compared").cast("bigint").alias("compared"), (-F.col("best._at")).cast("bigint").alias("doc_at"))
