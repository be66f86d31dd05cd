"""Benchmark passages in documents, by a prefix-filtered join of shingles.

An item is held to be leaked in windows of its words. A window can only occur where all of its
shingles do, so it is enough to join on one of them, its rarest over all documents: the necessary
prefix for full containment. The place of the shingle in the window gives where the window would
begin, which must lie in the document; there, all other shingles are verified, word by word.
Everything is built-in functions; no text is shuffled.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import document_key, written
from stallkeeper.llm.words import count_words, lower_words, sequence_hashes

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
# Up to so many different shingles (some 100 bytes each) a benchmark is sent to all executors.
MOST_BROADCAST = 200_000
_KEY = ["_id", "_text"]


def _placed(words: Column, length: int) -> Column:
    """Structs of hash, words and place of each shingle."""
    return F.transform(
        sequence_hashes(words, length),
        lambda h, i: F.struct(h.alias("h"), F.slice(words, i + 1, length).alias("sw"), i.alias("off")),
    )


def windows(items: DataFrame, window_words: int) -> DataFrame:
    """`item_id` and `ww`, the words of each of its windows; none of an item without words."""
    words = items.select("item_id", lower_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window_words, F.lit(0))
    starts = F.explode(F.sequence(F.lit(0), last)).alias("s")
    placed = words.select("item_id", "w", starts)
    return placed.select("item_id", F.slice("w", F.col("s") + 1, window_words).alias("ww")).distinct()


def _shingled(words: Column, length: int) -> Column:
    """For each place the hash and the words `s0`, `s1`, ... of its shingle.

    Shifted copies of the words are put side by side once, so a shingle takes with it just its own
    words, however long the text.
    """
    last = F.greatest(F.size(words) - (length - 1), F.lit(0))
    return F.arrays_zip(
        sequence_hashes(words, length).alias("sh"),
        *[F.slice(words, i + 1, last).alias(f"s{i}") for i in range(length)],
    )


def _matches(docs: DataFrame, shingles: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """Where documents have a shingle of the benchmark: key, number of words, place, hash."""
    found = None
    # The number of words comes first: whatever is taken from the words beside the shingles would
    # carry all of them to each.
    texts = docs.select(*document_key(), lower_words(F.col("text")).alias("_w"))
    texts = texts.select(*_KEY, "_w", F.size("_w").alias("_n"))
    for length in lengths:
        sought = shingles.where(F.col("length") == length).select("h", "sw").distinct()
        words = [F.col(f"_s.{name}") for name in ["sh", *(f"s{i}" for i in range(length))]]
        rows = texts.select(
            *_KEY, "_n", F.posexplode(_shingled(F.col("_w"), length)).alias("pos", "_s")
        ).select(*_KEY, "_n", "pos", *words)
        # Words are only looked at where hashes agree, which an equality would not say.
        here = F.array(*[F.col(f"s{i}") for i in range(length)])
        met = rows.join(
            F.broadcast(sought) if small else sought,
            (F.col("sh") == F.col("h")) & F.array_contains(F.array("sw"), here),
        ).select(*_KEY, "_n", "pos", "h")
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def occurrences(
    docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS
) -> tuple[DataFrame, DataFrame]:
    """Every place of a window in a document: key (`document_key`), `wid`, `start`, `length`, once
    for rows with the same id and text. And the items of each window: `wid`, `item_id`."""
    named = written(windows(items, window_words), "windows")
    numbered = written(
        named.select("ww").distinct().withColumn("wid", F.monotonically_increasing_id()),
        "window-numbers",
    )
    owners = named.join(numbered, "ww").select("wid", "item_id")
    size = F.least(F.size("ww"), F.lit(SHINGLE_WORDS))
    lengths = sorted(r[0] for r in numbered.select(size).distinct().collect())
    shingles = None
    for length in lengths:
        own = numbered.where(size == length).select(
            "wid", "ww", F.inline(_placed(F.col("ww"), length))
        )
        own = own.withColumn("length", F.lit(length))
        shingles = own if shingles is None else shingles.unionByName(own)
    if shingles is None:
        empty = docs.select(*document_key()).where(F.lit(False))
        nothing = F.lit(0)
        return (
            empty.select(
                "*", nothing.alias("wid"), nothing.alias("start"), nothing.alias("length")
            ),
            owners,
        )
    shingles = written(shingles, "shingles")
    small = shingles.count() <= MOST_BROADCAST
    hint = F.broadcast if small else lambda df: df
    matches = written(_matches(docs, shingles, lengths, small), "matches")

    frequency = matches.groupBy("h").agg(F.count("*").alias("n"))
    # A window with a shingle that no document has falls out of the inner join with its matches.
    rarest = (
        shingles.join(frequency, "h", "left")
        .groupBy("wid", F.size("ww").alias("_length"))
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "h")).alias("p"),
            F.count("*").alias("_needed"),
        )
        .where("p.n > 0")
        .select("wid", "_length", "_needed", F.col("p.off").alias("_off"), F.col("p.h").alias("h"))
    )
    start = F.col("pos") - F.col("_off")
    candidates = (
        matches.join(hint(rarest), "h")
        .withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") + F.col("_length") <= F.col("_n")))
        .select(*_KEY, "wid", "start", "_length", "_needed")
    )
    needed = candidates.join(hint(shingles.select("wid", "off", "h")), "wid").select(
        *_KEY, "wid", "start", "_length", "_needed", (F.col("start") + F.col("off")).alias("pos"), "h"
    )
    verified = (
        needed.join(matches.select(*_KEY, "pos", "h"), [*_KEY, "pos", "h"])
        .groupBy(*_KEY, "wid", "start", "_length", "_needed")
        .count()
        .where("count = _needed")
        .select(*_KEY, "wid", "start", F.col("_length").alias("length"))
    )
    return verified, owners


def contamination(
    docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS
) -> DataFrame:
    """For each document (key) with an occurrence: `n_hit`, the words inside any, and `item_ids`,
    distinct and sorted as strings.

    An item without an id leaks like any other but has no place in `item_ids`. Null and empty texts
    of documents and items have no words. Items with equal windows are all named.
    """
    found, owners = occurrences(docs, items, window_words)
    found = written(found, "occurrences")
    in_order = Window.partitionBy(*_KEY).orderBy("start", "length")
    end = F.col("start") + F.col("length")
    reached = F.coalesce(
        F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    words = (
        found.select(*_KEY, "start", "length")
        .distinct()
        .withColumn("_new", F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0)))
        .groupBy(*_KEY)
        .agg(F.sum("_new").cast("bigint").alias("n_hit"))
    )
    ids = (
        found.select(*_KEY, "wid")
        .distinct()
        .join(owners, "wid")
        .groupBy(*_KEY)
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    return words.join(ids, _KEY)


def report(docs: DataFrame, items: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row, `n_words`, `n_hit`, `item_ids` and `contaminated`."""
    hit = contamination(docs, items)
    counted = docs.select(
        F.struct(*keep).alias("_keep"), *document_key(), count_words(F.col("text")).alias("n_words")
    )
    return counted.join(hit, _KEY, "left").select(
        "_keep.*",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` in which nothing of the items occurs."""
    hit = contamination(docs, items).select(*_KEY)
    keyed = docs.select(F.struct("*").alias("_row"), *document_key())
    return keyed.join(hit, _KEY, "left_anti").select("_row.*")
