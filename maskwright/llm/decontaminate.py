"""Documents that hold passages of a benchmark, found by spaced seeds. DataFrame functions only.

A seed is a mask over a few neighbouring words: the positions it ignores may differ. Hashes of the masked words
of all test items are joined with those of all documents; around every hit the words of both are compared place
by place, and a passage counts when enough of a window agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.session import materialize

#: Fixed masks: a word under 1 is read, one under 0 may differ. The first four leave a seed in every window of 16 words of
#: which three differ, and in all shorter items but those of 5, 6 and 10 words; for these, and for items of fewer
#: than five words, which must agree in all of them, there are more.
MASKS = ("11111", "1101011", "111011101", "1010111")
SHORT_MASKS = {"1": (1,), "11": (2,), "111": (3,), "1111": (4, 5, 6, 10), "11011": (5, 6, 10), "11101": (5, 6, 10), "10111": (5, 6, 10)}
WINDOW = 16
PERCENT = 80
BROADCAST_ROWS = 1_000_000
BLANKS = " \t\n\x0b\x0c\r"


def word_list(text: Column) -> Column:
    """Lower-cased words of a text; a null or blank text has one empty word, which no mask reads."""
    return F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), "[ \\t-\\r]+")


def masks_for(lengths: set[int]) -> list[str]:
    """The masks that items of these lengths need."""
    return [*MASKS, *(m for m, own in SHORT_MASKS.items() if lengths & {*own})]


def seeds(words: DataFrame, masks: list[str], of_items: bool = False) -> DataFrame:
    """Every position of `words` with every mask that fits there: adds `at`, `seed`. An item has no masks made for other lengths."""
    size = F.size("words")

    def fits(mask: str) -> Column:
        inside = F.col("at") + len(mask) <= size
        return inside & size.isin(*SHORT_MASKS[mask]) if of_items and mask in SHORT_MASKS else inside

    hashes = [F.when(fits(m), F.xxhash64(F.lit(m), *[F.get("words", F.col("at") + k) for k, bit in enumerate(m) if bit == "1"])) for m in masks]
    shortest = min(len(mask) for mask in masks)
    places = words.where(size >= shortest).withColumn("at", F.explode(F.sequence(F.lit(0), size - shortest)))
    return places.withColumn("seed", F.explode(F.array(*hashes))).where("seed IS NOT NULL")


def _agrees(near: Column, first: Column, words: Column, shift: Column, at: Column, n_doc: Column) -> Column:
    """Some window over the hit, inside both texts, in which enough words agree.

    `near` holds the document's words from place `first`; word p of the document stands at p - shift of the item.
    """
    width = F.least(F.lit(WINDOW), F.size(words))
    begins = F.greatest(at - width + 1, shift, F.lit(0))
    last = F.least(at, shift + F.size(words) - width, n_doc - width)
    equal = lambda p: F.when(F.get(near, p - first) == F.get(words, p - shift), 1).otherwise(0)
    enough = lambda j: F.aggregate(F.sequence(j, j + width - 1), F.lit(0), lambda n, p: n + equal(p)) * 100 >= width * PERCENT
    return F.coalesce(F.when(begins <= last, F.exists(F.sequence(begins, last), enough)), F.lit(False))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_items, item_ids, contaminated) of every document.

    A document holds a passage of an item when, at an aligned seed hit, some window of 16 words (or the whole
    item when it is shorter) agrees in at least 80 % of its words, place by place. `item_ids` lists the items in
    order, joined with commas. Words are runs of anything but white space, lower-cased.

    Null and blank texts have no words and hold nothing. Items of fewer than five words must stand there whole.
    Repeated documents each give a row, counted together by id; repeated items with one id count once. Null ids are kept
    (null item ids are left out). Extra columns are ignored; an empty table of documents gives no rows.

    Documents are never shuffled for the search when the distinct seeds of the benchmark are few enough to be
    sent to every task (counted first); otherwise the planner joins them by their hash.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), word_list(F.col(item_text_col)).alias("words"))
    items = items.where(F.element_at("words", 1) != "")
    # at most fifteen lengths say which masks for short items the documents need
    lengths = {r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < WINDOW).distinct().collect()}
    masks = masks_for(lengths)
    wanted, n_seeds = materialize(
        seeds(items, masks, True).select("seed", "item_id", F.col("at").alias("offset"), F.col("words").alias("item_words"), F.lit(True).alias("one")), "one"
    )
    known = wanted.select("seed").distinct()
    known = F.broadcast(known) if n_seeds <= BROADCAST_ROWS else known

    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_list(F.col(text_col)).alias("words"))
    n_words = F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words")).cast("long")
    first = F.greatest(F.col("at") - WINDOW, F.lit(0))
    hits = seeds(words, masks).join(known, "seed", "left_semi").select(
        "doc_id", "seed", "at", F.size("words").alias("n_doc"), first.alias("first"), F.slice("words", first + 1, 2 * WINDOW + 1).alias("near")
    )
    matched = (
        hits.join(wanted, "seed").withColumn("shift", F.col("at") - F.col("offset"))
        .where(_agrees(F.col("near"), F.col("first"), F.col("item_words"), F.col("shift"), F.col("at"), F.col("n_doc")))
        .groupBy("doc_id", "item_id").agg(F.lit(1).alias("found"))
        .groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("item_ids"), F.count(F.lit(1)).alias("n_items"))
    )
    found = matched.withColumnRenamed("doc_id", "found_id")
    counted = words.select("doc_id", n_words.alias("n_words"))
    return counted.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", "n_words", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        F.col("n_items").isNotNull().alias("contaminated"),
    )
