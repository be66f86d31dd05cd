"""Licence notices found by a positional index of rare words.

Templates are word sequences with the key phrases that must stand in them. Short ones are found by
their key phrase: it is indexed by its rarest word, as counted over all documents, and its other
words are looked for at their relative places. Whole notices are found by the rarest of their words
that a document has: each occurrence says where the notice would begin, and where several agree, the
notice is accepted by the weight of its words that stand where it has them, and by its phrases.
Everything is built-in functions.
"""

from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.scratch import let
from stallkeeper.llm.words import count_words, lower_words

# Base phrases and their labels.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}


@dataclass(frozen=True)
class Template:
    """A notice, and the phrase in it without which it is not that licence."""

    label: str
    notice: str
    phrase: str

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key(self) -> list[str]:
        return self.phrase.split()

    @property
    def key_at(self) -> int:
        starts = range(len(self.words) - len(self.key) + 1)
        return next(i for i in starts if self.words[i : i + len(self.key)] == self.key)


# Well-known notices, in words. Those of the base labels have the base phrases as keys.
TEMPLATES = (
    Template("mit", "released under the mit license", BASE["mit"]),
    Template("apache-2", "licensed under the apache license version 2 0", BASE["apache-2"]),
    Template("cc-by-nc", "licensed under cc by nc 4 0", BASE["cc-by-nc"]),
    Template(
        "gpl-3",
        "this work is licensed under the gnu general public license version 3",
        "gnu general public license version 3",
    ),
    Template(
        "gpl-2",
        "this work is licensed under the gnu general public license version 2",
        "gnu general public license version 2",
    ),
    Template(
        "lgpl",
        "under the terms of the gnu lesser general public license",
        "gnu lesser general public license",
    ),
    Template(
        "agpl",
        "under the terms of the gnu affero general public license",
        "gnu affero general public license",
    ),
    Template(
        "mpl-2",
        "subject to the terms of the mozilla public license v 2 0",
        "mozilla public license v 2",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification",
        "redistribution and use in source and binary forms",
    ),
    Template("cc0", "released under the creative commons cc0 license", "creative commons cc0"),
)

# Notices in their own words: of a document's rarest words of a notice so many are looked up, so
# many must agree on where it begins, and its words that stand there, give or take a few places for
# words put in or left out, must have so much of its weight.
ANCHORS = 6
AGREEING = 2
SLIP = 4
LEAST_WEIGHT = 0.6


@dataclass(frozen=True)
class Notice:
    """The text that works carry, and short phrases that tell it from notices like it."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def phrase_at(self, phrase: list[str]) -> int:
        starts = range(len(self.words) - len(phrase) + 1)
        return next(i for i in starts if self.words[i : i + len(phrase)] == phrase)


_GPL = """this program is free software you can redistribute it and or modify it under the terms of
the gnu general public license as published by the free software foundation either version {} of the
license or at your option any later version"""
_CC_BY_NC = "this work is licensed under a creative commons attribution noncommercial {} license"

NOTICES = (
    Notice(
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this
        software and associated documentation files the software to deal in the software without
        restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice shall be included in all copies or substantial portions
        of the software""",
        ("permission is hereby granted free of charge", "subject to the following conditions"),
    ),
    Notice(
        "apache-2",
        """licensed under the apache license version 2 0 the license you may not use this file
        except in compliance with the license you may obtain a copy of the license at http www
        apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties
        or conditions of any kind either express or implied""",
        ("apache license", "2 0 the license"),
    ),
    Notice(
        "cc-by-nc",
        _CC_BY_NC.format("4 0 international"),
        ("attribution noncommercial 4 0 international",),
    ),
    Notice(
        "cc-by-nc",
        _CC_BY_NC.format("3 0 unported"),
        ("attribution noncommercial 3 0 unported",),
    ),
    *[
        Notice(
            f"gpl-{version}",
            _GPL.format(version),
            (
                "gnu general public license as published by the free software foundation",
                f"version {version}",
            ),
        )
        for version in (2, 3)
    ],
    Notice(
        "mpl-2",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a
        copy of the mpl was not distributed with this file you can obtain one at""",
        ("mozilla public license", "2 0 if a copy of the mpl"),
    ),
    Notice(
        "bsd",
        """redistribution and use in source and binary forms with or without modification are
        permitted provided that the following conditions are met redistributions of source code
        must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution""",
        ("in source and binary forms", "redistributions of source code must retain"),
    ),
    Notice(
        "cc0",
        "has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
)


_FOUND = "array<struct<label: string, start: int, base: boolean, score: double>>"


def document_counts(
    docs: DataFrame, templates: tuple[Template | Notice, ...]
) -> tuple[int, dict]:
    """How many documents there are, and how many have each word of the templates: as many
    numbers as words, counted over all documents."""
    vocabulary = sorted({word for t in templates for word in t.words})
    present = F.array_intersect(
        lower_words(F.col("text")), F.array(*[F.lit(w) for w in vocabulary])
    )
    # Every document has the empty word once, so its count is that of the documents.
    counted = docs.select(F.explode(F.array_append(present, F.lit(""))).alias("word"))
    counts = {row["word"]: row["count"] for row in counted.groupBy("word").count().collect()}
    return counts.get("", 0), {word: counts.get(word, 0) for word in vocabulary}


def _rarest(words: list[str], counts: dict[str, int]) -> int:
    return min(range(len(words)), key=lambda i: (counts[words[i]], i))


def _stands_at(words: Column, start: Column, sought: list[str]) -> Column:
    """Whether the words stand one after another from `start` (from 0)."""
    at = [F.get(words, start + i) == F.lit(word) for i, word in enumerate(sought)]
    return F.coalesce(reduce(Column.__and__, at), F.lit(False))


def _weights(template: Template | Notice, total: int, counts: dict[str, int]) -> list[float]:
    raw = [1 + log((1 + total) / (1 + counts[word])) for word in template.words]
    return [value / sum(raw) for value in raw]


def _found(words: Column, template: Template, total: int, counts: dict[str, int]) -> Column:
    """Structs of label, start of the phrase, its end, and score, for each place of the phrase."""
    anchor = _rarest(template.key, counts)
    weights = _weights(template, total, counts)
    postings = F.filter(
        F.transform(words, lambda w, i: F.when(w == F.lit(template.key[anchor]), i - anchor)),
        lambda start: start.isNotNull(),
    )
    placed = F.filter(
        postings, lambda start: (start >= 0) & _stands_at(words, start, template.key)
    )

    def score(start: Column) -> Column:
        aligned = [
            F.when(
                (start + (i - template.key_at) >= 0)
                & (F.get(words, start + (i - template.key_at)) == F.lit(word)),
                F.lit(weight),
            ).otherwise(F.lit(0.0))
            for i, (word, weight) in enumerate(zip(template.words, weights, strict=True))
        ]
        return F.least(reduce(Column.__add__, aligned), F.lit(1.0))

    is_base = template.phrase == BASE.get(template.label)
    return F.transform(
        placed,
        lambda start: F.struct(
            F.lit(template.label).alias("label"),
            start.alias("start"),
            F.lit(is_base).alias("base"),
            score(start).alias("score"),
        ),
    )


def _noticed(words: Column, notice: Notice, total: int, counts: dict[str, int]) -> Column:
    """Structs as of `_found`, for each place where the whole notice stands; `start` is that of its
    first phrase."""
    sought = notice.words
    by_rarity = sorted(set(sought), key=lambda word: (counts[word], sought.index(word)))
    index = F.array(
        *[
            F.struct(
                F.lit(word).alias("word"),
                F.array(*[F.lit(i) for i, w in enumerate(sought) if w == word]).alias("at"),
            )
            for word in by_rarity
        ]
    )
    weighted = F.array(
        *[
            F.struct(F.lit(i).alias("at"), F.lit(w).alias("word"), F.lit(v).alias("weight"))
            for i, (w, v) in enumerate(zip(sought, _weights(notice, total, counts), strict=True))
        ]
    )

    def postings(anchor: Column) -> Column:
        """Where the notice would begin by the occurrences of one word."""
        places = F.filter(
            F.transform(words, lambda w, i: F.when(w == anchor["word"], i)),
            lambda i: i.isNotNull(),
        )
        starts = F.transform(places, lambda i: F.transform(anchor["at"], lambda at: i - at))
        return F.array_distinct(F.flatten(starts))

    present = F.filter(index, lambda anchor: F.array_contains(words, anchor["word"]))
    agreed = let(
        F.array_sort(F.flatten(F.transform(F.slice(present, 1, ANCHORS), postings))),
        lambda p: F.array_distinct(
            F.filter(p, lambda start, i: F.get(p, i + (AGREEING - 1)) == start)
        ),
    )

    def place(start: Column, phrase: list[str]) -> Column:
        at = notice.phrase_at(phrase)
        slips = sorted(range(-SLIP, SLIP + 1), key=abs)
        places = [start + (at + slip) for slip in slips]
        return F.coalesce(*[F.when(_stands_at(words, p, phrase), p) for p in places])

    def weight(start: Column) -> Column:
        def stands(t: Column) -> Column:
            first = start + t["at"] - SLIP
            around = F.slice(words, F.greatest(first + 1, F.lit(1)), 2 * SLIP + 1)
            return (first + 2 * SLIP >= 0) & F.array_contains(around, t["word"])

        return F.aggregate(
            weighted,
            F.lit(0.0),
            lambda sum_, t: sum_ + F.when(stands(t), t["weight"]).otherwise(F.lit(0.0)),
            lambda sum_: F.least(sum_, F.lit(1.0)),
        )

    def judged(start: Column) -> Column:
        places = [place(start, phrase.split()) for phrase in notice.phrases]
        whole = reduce(Column.__and__, [p.isNotNull() for p in places])
        return F.when(whole, F.struct(places[0].alias("start"), weight(start).alias("score")))

    accepted = F.filter(
        F.transform(agreed, judged), lambda f: f.isNotNull() & (f["score"] >= LEAST_WEIGHT)
    )
    # Words put in or left out give one notice several beginnings; the best one counts.
    best = let(
        F.array_sort(accepted),
        lambda found: F.filter(
            found, lambda f, i: F.coalesce(F.get(found, i + 1)["start"] != f["start"], F.lit(True))
        ),
    )
    return F.transform(
        best,
        lambda f: F.struct(
            F.lit(notice.label).alias("label"),
            f["start"].alias("start"),
            F.lit(False).alias("base"),
            f["score"].alias("score"),
        ),
    )


def scan(
    docs: DataFrame,
    keep: list[str],
    templates: tuple[Template, ...] = TEMPLATES,
    notices: tuple[Notice, ...] = NOTICES,
) -> DataFrame:
    """The columns `keep` of every row, `n_words`, and `found`: an array of structs of `label`,
    `start` (word, from 0), `base` and `score` (0 to 1), a struct for each place of a key phrase
    and for each whole notice.

    Null and empty texts have no words and nothing found. Rows are judged one by one, so repeated
    ones and null ids change nothing; other columns may have any name.
    """
    total, counts = document_counts(docs, (*templates, *notices))
    anchors = sorted({t.key[_rarest(t.key, counts)] for t in templates})
    # A notice has all of its phrases, so the rarest words of each.
    needed = [sorted({p[_rarest(p, counts)] for p in map(str.split, n.phrases)}) for n in notices]
    # Lower case of all letters keeps what lower case of A-Z makes of them, and is quick.
    quick = F.lower(F.coalesce("text", F.lit("")))
    none = F.from_json(F.lit("[]"), _FOUND)

    def candidate(q: Column) -> Column:
        whole = [reduce(Column.__and__, [F.contains(q, F.lit(w)) for w in n]) for n in needed]
        return reduce(Column.__or__, [*[F.contains(q, F.lit(a)) for a in anchors], *whole])

    def noticed(w: Column, notice: Notice, words: list[str]) -> Column:
        has_all = reduce(Column.__and__, [F.array_contains(w, F.lit(x)) for x in words])
        return F.when(has_all, _noticed(w, notice, total, counts)).otherwise(none)

    found = let(
        lower_words(F.col("text")),
        lambda w: F.flatten(
            F.array(
                *[_found(w, t, total, counts) for t in templates],
                *[noticed(w, n, x) for n, x in zip(notices, needed, strict=True)],
            )
        ),
    )
    return docs.select(
        *keep,
        count_words(F.col("text")).alias("n_words"),
        F.when(let(quick, candidate), found).otherwise(none).alias("found"),
    )


def labelled(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, `n_words`, `n_base` (places of base phrases), the smallest and largest
    start of these, `base_labels` and `labels` (distinct, sorted, with commas), and `score`: of
    the template that fits best, 0 without any."""
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["start"].cast("bigint"))

    def names(of: Column) -> Column:
        return F.array_join(
            F.array_sort(F.array_distinct(F.transform(of, lambda f: f["label"]))), ","
        )

    return scanned.select(
        *keep,
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.coalesce(
            F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)
        ).alias("score"),
    )
