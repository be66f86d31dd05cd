"""Severity of toxic language by cumulative-link ordinal regression over sparse text features.

Grades 0 < 1 < ... < K share one weight for each feature; only the thresholds between grades
differ: P(grade > k) = sigmoid(x . w - t_k). The prediction is the expected grade. Features are
words and beginnings of words, each by the logarithm of 1 plus its count.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import LARGE_ROWS, bound_batches, written

# The model is fitted on a bounded sample of labelled rows, those with the smallest hashes.
MOST_ROWS = 10_000
MOST_FEATURES = 4_096
# A feature is used if its share of toxic rows differs from that of the others by so many standard
# errors, and it occurs in so many rows.
LEAST_Z = 4.0
LEAST_ROWS = 3
GRADES = 3
PENALTY = 0.02
STEPS = 400

PREFIXES = (4, 6)
MOST_CACHED = 50_000
# Features that a worker holds before it hands them on; those of one text stay together.
BATCH_FEATURES = 50_000

_words = regex.compile(r"\p{L}+").findall


def word_counts(text: str | None) -> Counter[str]:
    return Counter(_words((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word, and its first letters followed by a hyphen if it is longer."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def feature_counts(text: str | None) -> Counter[str]:
    counts: Counter[str] = Counter()
    for word, n in word_counts(text).items():
        for feature in features_of(word):
            counts[feature] += n
    return counts


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_toxic` and the `found` features of each `text`, in batches bounded by their features:
    a text may have thousands of them, and a batch of texts thousands of texts."""

    def batch(toxic: list[bool], names: list[str], counts: list[int], ends: list[int]):
        pairs = pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["feature", "n"]
        )
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([pa.array(toxic, pa.bool_()), found], ["_toxic", "found"])

    for given in batches:
        toxic, names, counts, ends = [], [], [], [0]
        for text, mark in zip(given["text"], given["_toxic"], strict=True):
            found = feature_counts(text.as_py())
            toxic.append(mark.as_py())
            names.extend(found)
            counts.extend(found.values())
            ends.append(len(names))
            if len(names) >= BATCH_FEATURES:
                yield batch(toxic, names, counts, ends)
                toxic, names, counts, ends = [], [], [], [0]
        if toxic:
            yield batch(toxic, names, counts, ends)


@dataclass
class Model:
    """Weights by feature, and ascending thresholds, one for each grade above 0."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def __post_init__(self):
        self._known: dict[str, list[str]] = {}

    def _features(self, word: str) -> list[str]:
        if len(self._known) >= MOST_CACHED:
            self._known.clear()
        found = self._known[word] = [f for f in features_of(word) if f in self.weights]
        return found

    def severity(self, text: str | None) -> tuple[float, float]:
        """Expected grade, and probability of any grade above 0."""
        counts: Counter[str] = Counter()
        for word, n in word_counts(text).items():
            found = self._known.get(word)
            for feature in self._features(word) if found is None else found:
                counts[feature] += n
        score = sum(self.weights[f] * np.log1p(n) for f, n in sorted(counts.items()))
        above = 1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 40)))
        return float(above.sum()), float(above[0]) if len(above) else 0.0


def fit_cumulative(
    rows: list[np.ndarray],
    values_of: list[np.ndarray],
    grades: np.ndarray,
    features: int,
    balanced: bool = True,
    penalty: float = PENALTY,
):
    """Weights and thresholds of the penalised maximum likelihood, by Adam. If balanced, grades
    count by the inverse root of their frequency, so that rare ones are not given up.

    `rows` has the numbers of each row's features, `values_of` their values. Thresholds are the
    first plus positive gaps.
    """
    top = int(grades.max(initial=0))
    lengths = np.array([len(r) for r in rows], np.int64)
    at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    x = np.concatenate([*values_of, np.empty(0)])
    owner = np.repeat(np.arange(len(rows)), lengths)
    share = [np.clip(np.mean(grades > k), 1e-4, 1 - 1e-4) for k in range(top)]
    wanted = np.maximum.accumulate(np.log(1 / np.array(share) - 1))
    gaps = np.log(np.expm1(np.maximum(np.diff(wanted), 1e-2)))
    values = np.concatenate([np.zeros(features), wanted[:1], gaps])
    frequency = np.bincount(grades, minlength=top + 1)[grades]
    weight = 1 / np.sqrt(frequency) if balanced else np.ones(len(rows))
    weight /= weight.sum()
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, STEPS + 1):
        w, base, raw = values[:features], values[features], values[features + 1 :]
        thresholds = base + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, raw))])
        score = np.bincount(owner, w[at] * x, len(rows))
        above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -40, 40)))
        edges = np.hstack([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))])
        slopes = np.hstack(
            [np.zeros((len(rows), 1)), above * (1 - above), np.zeros((len(rows), 1))]
        )
        pick = np.arange(len(rows))
        likely = np.maximum(edges[pick, grades] - edges[pick, grades + 1], 1e-9)
        by_low = weight * slopes[pick, grades] / likely
        by_high = weight * slopes[pick, grades + 1] / likely
        by_score = by_low - by_high  # of the log likelihood
        by_edge = np.zeros((len(rows), top + 2))
        by_edge[pick, grades] -= by_low
        by_edge[pick, grades + 1] += by_high
        by_threshold = by_edge.sum(axis=0)[1 : top + 1]
        later = np.cumsum(by_threshold[::-1])[::-1]
        gradient = -np.concatenate(
            [
                np.bincount(at, by_score[owner] * x, features),
                [later[0]],
                later[1:] / (1 + np.exp(-raw)),
            ]
        )
        gradient[:features] += penalty * w / max(features, 1)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        mean, spread = first / (1 - 0.9**step), second / (1 - 0.999**step)
        values = values - 0.1 * mean / (np.sqrt(spread) + 1e-10)
    raw = values[features + 1 :]
    thresholds = values[features] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, raw))])
    return values[:features], thresholds


def _grades(told: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """0 for rows that are not toxic; the others in `grades` steps by how much in them tells of
    toxicity, in parts of equal size as far as ties allow."""
    cuts = np.quantile(told[toxic], np.arange(1, grades) / grades) if toxic.any() else []
    steps = 1 + np.searchsorted(np.unique(cuts), told, "left")
    return np.unique(np.where(toxic, steps, 0), return_inverse=True)[1]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the documents that `labels` (doc_id, toxic 0 or 1) covers.

    Labels without an id or grade are left out; where an id has several, it is toxic if one says
    so. Rows that agree in id and text count once, and of more than `MOST_ROWS` others those with
    the lowest hashes are taken. Without labelled rows, or with one kind only, the model finds
    nothing toxic.

    Counts of features are made by Spark; the driver gets at most `MOST_ROWS` rows of at most
    `MOST_FEATURES` numbers and values.
    """
    bound_batches(docs.sparkSession)
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
    marks = marks.agg((F.max("toxic") > 0).alias("_toxic"))
    chosen = written(
        marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS), "labelled"
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    # Rows, not only ids, are bounded: an id may have any number of them.
    different = texts.select("doc_id", "_text").join(F.broadcast(chosen), "doc_id").distinct()
    sampled = written(
        different.orderBy(F.xxhash64("doc_id", "_text"), "doc_id", "_text").limit(MOST_ROWS),
        "labelled-rows",
    )
    keyed = texts.join(F.broadcast(sampled), ["doc_id", "_text"])
    keyed = keyed.dropDuplicates(["doc_id", "_text"])

    rows = written(
        keyed.select("text", "_toxic").mapInArrow(
            feature_batches, "_toxic boolean, found array<struct<feature: string, n: bigint>>"
        ),
        "labelled-features",
        LARGE_ROWS,
    )
    sizes = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    if len(sizes) < 2:
        return Model({}, np.empty(0))
    positive, negative = sizes[True], sizes[False]
    counted = (
        rows.select("_toxic", F.inline("found"))
        .groupBy("feature")
        .agg(F.count_if("_toxic").alias("p"), F.count_if(~F.col("_toxic")).alias("n"))
        .where(F.col("p") + F.col("n") >= LEAST_ROWS)
    )
    rate = (F.col("p") + F.col("n") + 1) / F.lit(positive + negative + 2)
    error = F.sqrt(rate * (1 - rate) * (1 / positive + 1 / negative))
    z = (F.col("p") / positive - F.col("n") / negative) / error
    vocabulary = (
        counted.withColumn("z", z)
        .where(F.abs("z") >= LEAST_Z)
        .orderBy(F.desc(F.abs("z")), "feature")
        .limit(MOST_FEATURES)
        .toPandas()
    )
    number = {word: i for i, word in enumerate(vocabulary["feature"])}
    tells = vocabulary["z"].to_numpy(float) > 0
    spark = docs.sparkSession
    # Of Arrow columns, as Spark converts a list of rows in Python workers of their own.
    known = pa.table(
        {"feature": list(number) or [""], "at": pa.array(range(len(number) or 1), pa.int32())}
    )
    known = spark.createDataFrame(known, "feature string, at int")

    sample = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .select("_row", "_toxic", F.inline_outer("found"))
        .join(F.broadcast(known), "feature", "left")  # at most MOST_FEATURES
        .groupBy("_row", "_toxic")
        .agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n")))))
        .toDF("_row", "_toxic", "found")
        .orderBy("_toxic", "found")  # the same sum of floats whenever it runs
        .select("_toxic", "found.at", "found.n")
        .toPandas()
    )
    at = [np.asarray(a, np.int64) for a in sample["at"]]
    values = [np.log1p(np.asarray(n, float)) for n in sample["n"]]
    told = np.array([v[tells[a]].sum() for a, v in zip(at, values, strict=True)])
    grades = _grades(told, sample["_toxic"].to_numpy(bool), GRADES)
    weights, thresholds = fit_cumulative(at, values, grades, len(number))
    return Model(dict(zip(number, weights.tolist(), strict=True)), thresholds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `severity` (expected grade, from 0) and `toxic` (any grade above 0 is more
    likely than none); columns of these names are replaced. Null and empty texts, and all texts
    under a model without grades, have no features: their severity is the model's for no words.
    Repeated rows are judged alike, each in its place.
    """

    bound_batches(docs.sparkSession)

    @F.pandas_udf("severity double, toxic boolean")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [model.severity(text) for text in batch]
            yield pd.DataFrame(
                {"severity": [s for s, _ in found], "toxic": [p >= 0.5 for _, p in found]}
            )

    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("severity", "toxic")]
    judged = docs.select(F.struct(*columns).alias("given"), judge("text").alias("judged"))
    return judged.select("given.*", "judged.*")
