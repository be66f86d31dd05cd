"""Language identification by compression.

Each language has a dictionary of raw text, made of labelled documents. A text is compressed with
each; the language whose dictionary makes it smallest is the answer. Where the second is hardly
larger, the answer is marked as rejected.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import written

UNKNOWN = "und"
# The dictionaries are made of a bounded sample of labelled texts: those of each language with the
# smallest hashes, at most so many different ones, and of each a part from its middle of at most so
# many characters. Each has the same room in its language's dictionary.
SAMPLE_DOCUMENTS = 256
SAMPLE_CHARACTERS = 300
DICTIONARY_BYTES = 1 << 16
ALL_DICTIONARIES_BYTES = 1 << 24
LEVEL = 6
# Long texts are compressed in parts, as what comes early in a long text is a dictionary, too.
PART_BYTES = 1 << 10
NARROW = 0.01

_not_letters = regex.compile(r"\P{L}+")


def letters_of(text: str | None) -> bytes:
    """Letters in lower case, words with one space around."""
    return f" {_not_letters.sub(' ', (text or '').lower()).strip()} ".encode()


@dataclass
class Model:
    """Dictionary by language, those with more labelled documents first."""

    dictionaries: dict[str, bytes]

    def classifier(self) -> "Classifier":
        return Classifier(self)


class Classifier:
    def __init__(self, model: Model):
        self.languages = list(model.dictionaries)
        self._compress = []
        for language in self.languages:
            content = zstandard.ZstdCompressionDict(
                model.dictionaries[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            content.precompute_compress(level=LEVEL)
            compressor = zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=content,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            self._compress.append(compressor.compress)

    def sizes(self, letters: bytes) -> np.ndarray:
        parts = [letters[i : i + PART_BYTES] for i in range(0, len(letters), PART_BYTES)]
        return np.array([sum(len(c(part)) for part in parts) for c in self._compress])

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin was too narrow."""
        letters = letters_of(text)
        if not letters.strip() or not self.languages:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(letters)
        best = int(sizes.argmin())  # of equal ones, the more frequent
        score = 1 / np.exp2(-np.minimum(sizes - sizes[best], 60.0)).sum()
        others = np.delete(sizes, best)
        margin = (others.min() - sizes[best]) / sizes[best] if len(others) else 1.0
        return self.languages[best], float(score), bool(margin < NARROW)


def _sample(usable: DataFrame, texts: dict[str, int]) -> DataFrame:
    """`lang`, `_at` and a part of the text, for the `SAMPLE_DOCUMENTS` smallest hashes of each
    language. `texts` are its different texts, about; hashes up to four times the sample's share
    are looked at, all of them where there are few."""
    share = {lang: min(1.0, 4 * SAMPLE_DOCUMENTS / n) for lang, n in texts.items()}
    wanted = usable.sparkSession.createDataFrame(
        [(lang, min(int((2 * s - 1) * (1 << 63)), (1 << 63) - 1)) for lang, s in share.items()],
        "lang string, _last bigint",
    )
    middle = F.greatest(F.lit(1), ((F.length("text") - SAMPLE_CHARACTERS) / 2).cast("int"))
    part = F.substring("text", middle, F.lit(SAMPLE_CHARACTERS))
    # One row for each language.
    few = usable.join(F.broadcast(wanted), "lang").where("_at <= _last")
    different = few.groupBy("lang", "_at").agg(F.min(part).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_at"))
    return different.withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_DOCUMENTS)


def fit(labelled: DataFrame) -> Model:
    """Learns from `text` and `lang`; rows without either, or without a letter, are left out. Copies
    of a text count once in the sample. Every other language has a dictionary, however few its
    texts."""
    usable = labelled.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select(
        "lang", F.xxhash64("text").alias("_at"), "text"
    )
    counted = usable.groupBy("lang").agg(
        F.count("*").alias("n"), F.approx_count_distinct("_at").alias("texts")
    )
    counts = {r["lang"]: r for r in counted.collect()}
    if not counts:
        return Model({})
    sample = written(
        _sample(usable, {lang: r["texts"] for lang, r in counts.items()}), "language-sample"
    )
    size = min(DICTIONARY_BYTES, ALL_DICTIONARIES_BYTES // len(counts))
    dictionaries = {}
    for lang, rows in sample.toPandas().sort_values(["lang", "_at"]).groupby("lang"):
        room = max(size // len(rows), 1)
        joined = b"".join(letters_of(text)[:room] for text in rows["text"])
        # Dictionaries of fewer than 8 bytes are not looked at.
        dictionaries[lang] = joined if len(joined) >= 8 else joined * 8
    ordered = sorted(dictionaries, key=lambda lang: (-counts[lang]["n"], lang))
    return Model({lang: dictionaries[lang] for lang in ordered})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `lang_pred`, `score` (0 to 1) and `rejected`; columns of these names are
    replaced. Nothing but the text is looked at, and all of it. A text that is null, empty or
    without letters is `und` with score 0, and so is every text under an empty model. A rejected
    answer is still given: whoever wants to go without it filters on `rejected`. Among equal sizes
    the language with more rows wins. Repeated rows are judged alike, each in its place.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = model.classifier()
        for batch in texts:
            found = [classify(text) for text in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    names = ("lang_pred", "score", "rejected")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    found = docs.select(F.struct(*columns).alias("given"), predict("text").alias("found"))
    return found.select("given.*", "found.*")
