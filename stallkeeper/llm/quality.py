"""Quality rules with thresholds that adapt to language and source.

Besides the fixed base rules, a document is dropped if a measure of it lies far out among the
documents of its language and source. How far is told by quartiles from quantile sketches, one for
each measure and group, merged into those of each language and of all. The quartiles of a group are
drawn towards those of its language, and these towards those of all, the more the fewer documents
they rest on; one formula holds at every size. Everything is built-in functions; a text is read once
and never moved.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import let, written
from stallkeeper.llm.words import BLANKS, parts, sequence_hashes

# Base rules, fixed.
LEAST_WORDS = 20
MOST_REPEATED = (30, 100)
WINDOW_WORDS = 8
# Adaptive rules: beyond the quartile by so many interquartile ranges. A range counts at least the
# measure's resolution, so that a group of nearly equal documents keeps ordinary ones.
# That of repeats leaves room below the base rule, which takes what is over 0.30.
RANGES = 3.0
RESOLUTION = {"word_length": 0.5, "symbols": 0.05, "dup_lines": 0.1, "repeats": 0.03}
# Both sides for the length of words, only the upper one for the others.
TWO_SIDED = ("word_length",)
# A group of so many documents counts as much as what it is drawn towards.
PRIOR_DOCUMENTS = 20
SKETCH_K = 200


def _covered(starts: Column) -> Column:
    """Words in windows that begin at these places, ascending."""
    gaps = let(
        starts,
        lambda s: F.zip_with(
            F.slice(s, 1, F.size(s) - 1),
            F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))),
            lambda a, b: F.least(b - a, F.lit(WINDOW_WORDS)),
        ),
    )
    return F.aggregate(gaps, F.lit(WINDOW_WORDS), lambda total, gap: total + gap)


def _repeated_starts(windows: Column) -> Column:
    """Where windows begin that occur twice or more, ascending: after sorting, equal ones stand
    side by side."""
    placed = F.array_sort(
        F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    )
    doubles = let(
        placed,
        lambda p: F.zip_with(
            F.slice(p, 1, F.size(p) - 1),
            F.slice(p, 2, F.size(p) - 1),
            lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])),
        ),
    )
    found = F.filter(doubles, lambda d: d.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(found)))


def _repeat_words(words: Column) -> Column:
    return let(
        sequence_hashes(words, WINDOW_WORDS),
        lambda w: F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0)).otherwise(
            _covered(_repeated_starts(w))
        ),
    )


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v)))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, `lang`, `source`, and the counts of the base rules for each row."""
    text = F.coalesce("text", F.lit(""))
    by_words = let(
        parts(text, BLANKS),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias(
                "word_chars"
            ),
            _repeat_words(w).cast("bigint").alias("n_repeat_words"),
        ),
    )
    counted = docs.select(
        *keep,
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        by_words.alias("_words"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        _dup_lines(text).cast("bigint").alias("n_dup_lines"),
    )
    return counted.select(
        *keep, "_lang", "_source", "_words.*", "n_symbols", "n_dup_lines"
    ).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS)
        | (MOST_REPEATED[1] * F.col("n_repeat_words") > MOST_REPEATED[0] * F.col("n_words")),
    )


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / words * LEAST_WORDS,
        "repeats": F.col("n_repeat_words") / words,
    }


def _quartiles(sketch: Column) -> Column:
    low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(rank)) for rank in (0.25, 0.75))
    return F.struct(low.alias("low"), high.alias("high"))


def _drawn(own: Column, count: Column, towards: Column) -> Column:
    """The quartiles `own`, which rest on `count` documents, drawn towards others."""
    share = count / (count + PRIOR_DOCUMENTS)
    between = {q: share * own[q] + (1 - share) * towards[q] for q in ("low", "high")}
    return F.struct(*[value.alias(q) for q, value in between.items()])


def _fences(quartiles: Column, name: str) -> list[Column]:
    low, high = quartiles["low"], quartiles["high"]
    reach = F.greatest(high - low, F.lit(RESOLUTION[name])) * RANGES
    fences = [(high + reach).alias(f"{name}_high")]
    return [*fences, (low - reach).alias(f"{name}_low")] if name in TWO_SIDED else fences


def thresholds(measured: DataFrame) -> DataFrame:
    """`_lang`, `_source` and the fences of each measure, a row for each group there is.

    Documents that fail the base rules take no part. Sketches are built from all others, merged
    from partial ones before the shuffle.
    """
    names = list(RESOLUTION)
    passed = measured.where("NOT base_failed")
    of_group = passed.groupBy("_lang", "_source").agg(
        F.count("*").alias("_n"),
        *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(n) for n, r in _ratios().items()],
    )
    of_group = written(of_group, "sketches")
    merged = [F.kll_merge_agg_double(n, F.lit(SKETCH_K)).alias(n) for n in names]
    # One row of two numbers for each measure; none of an empty table.
    of_all = (
        of_group.agg(F.sum("_n").alias("_m"), *merged)
        .where("_m > 0")
        .select(*[_quartiles(F.col(n)).alias(n) for n in names])
        .first()
    )
    if of_all is None:
        schema = "_lang string, _source string"
        fences = [f"{n}_{side} double" for n in names for side in ("high", "low")]
        return measured.sparkSession.createDataFrame([], ", ".join([schema, *fences]))
    of_lang = of_group.groupBy(F.col("_lang").alias("_l")).agg(F.sum("_n").alias("_m"), *merged)
    of_lang = of_lang.select(
        "_l",
        *[
            _drawn(
                _quartiles(F.col(n)),
                F.col("_m"),
                F.struct(*[F.lit(of_all[n][q]).alias(q) for q in ("low", "high")]),
            ).alias(f"wide_{n}")
            for n in names
        ],
    )
    drawn = [
        _drawn(_quartiles(F.col(n)), F.col("_n"), F.col(f"wide_{n}")).alias(n) for n in names
    ]
    same_language = F.col("_lang").eqNullSafe(F.col("_l"))
    picked = of_group.join(of_lang, same_language).select("_lang", "_source", *drawn)
    return picked.select("_lang", "_source", *[f for n in names for f in _fences(F.col(n), n)])


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row, its counts, `base_failed`, `kept` and `reason` (null for
    kept ones): the first of the base rules and the measures that tells against the document.

    Null and empty texts have no words and fail. Null languages and sources are groups of their
    own. Repeated rows are judged like any other; other columns may have any name.
    """
    measured = written(measures(docs, keep), "measures")
    fences = thresholds(measured).withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    joined = measured.join(
        fences,
        F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")),
        "left",
    )
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for name, ratio in _ratios().items():
        far = ratio > F.col(f"{name}_high")
        if name in TWO_SIDED:
            far = far | (ratio < F.col(f"{name}_low"))
        reason = reason.when(far, F.lit(name))
    return joined.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        reason.isNull().alias("kept"),
        reason.alias("reason"),
    )
