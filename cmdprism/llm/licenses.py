"""Licence scan by a positional index of rare words.

Licence templates are indexed as word -> (template, place). The document frequencies of all licence words are counted over the
whole corpus. A file looks up, for every template whose key words it has, the highest-IDF ones of the words that both share;
each pair of a place in the file and a posting votes for the template's start at their difference, so intersecting the postings by
relative position leaves the starts that the rare words agree on. A candidate counts if a mandatory key phrase of its template
stands there word by word.

Short templates (a licence's name, a notice) are met word by word: all their words must vote for one start, so every place
of theirs is found, whatever words are rare. Long ones (grants and disclaimers) may differ: votes within ``DRIFT`` words
are one start, ``LEAST_VOTES`` of the looked-up words must agree on it, and a key phrase must stand within the template's reach.

Results per file: places of the three base phrases, labels of all templates found, and a score: 1 with a whole short template, else
the largest share of a template's words that the file has around the start. Defined results: a null or empty text has no
words, labels or score; places that repeat count each; repeated rows are rows of their own; words of equal IDF go by their
text; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Looked-up words of a file for one long template.
RARE_WORDS = 8
#: Looked-up words that must agree on a long template's start.
LEAST_VOTES = 3
#: Words by which places of a long template may be moved.
DRIFT = 3
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Names and notices of further licences, met word by word.
NOTICES = {
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "boost software license": "boost",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache",
    "spdx license identifier gpl": "gpl",
}
# Grants and disclaimers with the label and the key phrases of which one must stand.
GRANTS = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy "
        "modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache "
        "org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ["except in compliance with the license", "unless required by applicable law or agreed to in writing"],
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        ["redistribute it and or modify it under the terms of the gnu", "as published by the free software foundation"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and "
        "the following disclaimer",
        ["redistribution and use in source and binary forms", "must retain the above copyright notice"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee is hereby granted"],
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["this source code form is subject to the terms of the mozilla public license"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile "
        "sell or distribute this software",
        ["free and unencumbered software released into the public domain"],
    ),
]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(UPPER)) if text else []


@dataclass(frozen=True)
class Template:
    """A licence's words in order; ``keys`` (places and words) are empty for short ones, which are met whole."""

    label: str
    words: tuple[str, ...]
    base: bool = False
    keys: tuple[tuple[int, tuple[str, ...]], ...] = ()


def place_of(phrase: tuple[str, ...], words: tuple[str, ...]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def templates() -> list[Template]:
    found = [Template(label, tuple(words_of(text)), True) for text, label in BASE.items()]
    found += [Template(label, tuple(words_of(text))) for text, label in NOTICES.items()]
    for label, text, phrases in GRANTS:
        words = tuple(words_of(text))
        keys = [tuple(words_of(p)) for p in phrases]
        found.append(Template(label, words, False, tuple((place_of(k, words), k) for k in keys)))
    return found


@dataclass
class Scan:
    """What one file holds."""

    n_words: int
    places: list[tuple[int, int]]  # (start, template) of every template found
    share: float


class Index:
    """Template postings by word, and the corpus IDF of every licence word."""

    def __init__(self, known: list[Template], idf: dict[str, float]) -> None:
        self.known, self.idf = known, idf
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(known):
            for place, word in enumerate(template.words):
                self.postings[word].append((t, place))
        self.by_template = [sorted(set(t.words), key=lambda w: (-idf.get(w, math.inf), w)) for t in known]
        self.rarest = defaultdict(list)
        for t, ordered in enumerate(self.by_template):
            if not known[t].keys:
                self.rarest[ordered[0]].append(t)

    def scan(self, text: str | None) -> Scan:
        words = words_of(text)
        where: dict[str, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            if word in self.postings:
                where[word].append(i)
        places, share = [], 0.0
        for t, template in enumerate(self.known):
            if template.keys:
                starts, part = self.long_starts(t, where, words)
                share = max(share, part)
            else:
                starts = self.short_starts(t, where)
            places += [(start, t) for start in starts]
        if any(not self.known[t].keys for _, t in places):
            share = 1.0
        return Scan(len(words), sorted(places), share)

    def short_starts(self, t: int, where: dict[str, list[int]]) -> list[int]:
        """Starts that all words of a short template vote for, rarest word first."""
        starts: set[int] | None = None
        for word in self.by_template[t]:
            if word not in where:
                return []
            for of, place in self.postings[word]:
                if of == t:
                    voted = {i - place for i in where[word]}
                    starts = voted if starts is None else starts & voted
                    if not starts:
                        return []
        return sorted(starts or [])

    def long_starts(self, t: int, where: dict[str, list[int]], words: list[str]) -> tuple[list[int], float]:
        """Starts of a long template that enough rare words vote for and a key phrase confirms, with the share of its words there."""
        template = self.known[t]
        keyed = [(place, key) for place, key in template.keys if all(w in where for w in key)]
        if not keyed:
            return [], 0.0
        rare = [w for w in self.by_template[t] if w in where][:RARE_WORDS]
        votes = sorted((i - place, word) for word in rare for of, place in self.postings[word] if of == t for i in where[word])
        offsets = [v[0] for v in votes]
        found: list[int] = []
        share = 0.0
        for at, (start, _) in enumerate(votes):
            if found and start - found[-1] <= DRIFT or at and offsets[at - 1] == start:
                continue
            agreed = {word for _, word in votes[at : bisect_right(offsets, start + DRIFT)]}
            if len(agreed) < LEAST_VOTES:
                continue
            if any(self.phrase_near(key, start + place, words, where) for place, key in keyed):
                found.append(start)
                share = max(share, self.share_at(template, start, where))
        return found, share

    def phrase_near(self, key: tuple[str, ...], at: int, words: list[str], where: dict[str, list[int]]) -> bool:
        """Whether the key phrase stands word by word at ``at`` or at most 2 * DRIFT words from it."""
        first = where[key[0]]
        for i in first[bisect_left(first, at - 2 * DRIFT) : bisect_right(first, at + 2 * DRIFT)]:
            if tuple(words[i : i + len(key)]) == key:
                return True
        return False

    def share_at(self, template: Template, start: int, where: dict[str, list[int]]) -> float:
        """Share of the template's words that the file has within DRIFT words of their place."""
        hit = 0
        for place, word in enumerate(template.words):
            found = where.get(word, [])
            near = bisect_left(found, start + place - 2 * DRIFT)
            hit += near < len(found) and found[near] <= start + place + 2 * DRIFT
        return hit / len(template.words)


def document_frequencies(docs: DataFrame, text_col: str, known: list[Template]) -> tuple[int, dict[str, int]]:
    """Rows of the corpus, and how many of them have each licence word; one small count per task comes in."""
    wanted = frozenset(w for t in known for w in t.words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, found = 0, Counter()
        for batch in batches:
            rows += len(batch)
            for text in batch["text"]:
                found.update(wanted.intersection(words_of(text)))
        found[""] = rows
        yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long")
    sums = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sums.pop("", 0), sums


def fit(docs: DataFrame, text_col: str = "text") -> Index:
    """The index of all templates with the words' IDF over ``docs``."""
    known = templates()
    rows, counts = document_frequencies(docs, text_col, known)
    return Index(known, {w: math.log((1 + rows) / (1 + counts.get(w, 0))) for t in known for w in t.words})


FOUND = """struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double,
  places: array<struct<start: long, label: string, words: int, base: boolean>>>"""


def find_licenses(docs: DataFrame, index: Index, text_col: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with a struct of all licence places, their labels and a score in ``out``."""

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = index.scan(text)
            base = [start for start, t in found.places if index.known[t].base]
            named = [(start, index.known[t]) for start, t in found.places]
            rows.append(
                (
                    found.n_words, len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted({t.label for _, t in named if t.base})), ",".join(sorted({t.label for _, t in named})), found.share,
                    [{"start": start, "label": t.label, "words": len(t.words), "base": t.base} for start, t in named],
                )
            )
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
        table = pd.DataFrame(rows, columns=names)
        return table.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(out, scan(F.col(text_col)))


def op13(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text")
    found = find_licenses(texts, fit(texts))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return found.select("doc_id", *[F.col(f"licenses.{name}").alias(name) for name in names])
