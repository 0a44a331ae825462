"""License notices by a positional index of their rare words.

Templates are words at positions, with key phrases that a notice cannot lack. How many documents hold a
licence word is counted over the whole corpus, and gives its inverse document frequency. Of each template the
words of highest frequency weight among its key phrases are indexed: word, template, position. In each file
these words are looked up (its rarest licence words: any file with all key phrases holds them, so none is
lost); a template is a candidate where the postings of its two rarest words agree on where it would begin,
up to a tolerance that grows with their distance. Candidates are verified: every key phrase has to stand,
word after word, where the template has it, within the same tolerance.

Texts stay where they are: a task turns them into word hashes, and only the counts of licence words, a
number for each word of the templates, are added up and sent around.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import free_name
from tidepanel.llm.words import LOWER, U64, slices, word_hashes, words

#: Bytes that end a word: ASCII other than digits and letters.
BREAKS = np.ones(256, bool)
BREAKS[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    BREAKS[_lo:_hi] = False

#: Words by which a notice may be longer or shorter between two places: some, and one more for so many.
SLACK, STRETCH = 2, 8
#: Evidence (sum of weights) of which a match is as likely a notice as not.
HALF = 4.0
#: Matches whose words are compared at once.
BLOCK = 2048


@dataclass(frozen=True)
class Template:
    """``keys`` are phrases of ``text`` that have to be there; with ``base`` the words stand exactly so."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @cached_property
    def hashes(self) -> np.ndarray:
        return hashes_of(self.text)

    @cached_property
    def phrases(self) -> list[tuple[int, int]]:
        """(place, length) of each key phrase."""
        listed, found = self.text.split(), []
        for key in self.keys:
            parts = key.split()
            places = [i for i in range(len(listed)) if listed[i : i + len(parts)] == parts]
            found.append((places[0], len(parts)))
        return found


# Notices as they are published, in small letters, without marks between words.
TEMPLATES: tuple[Template, ...] = (
    Template("mit", "mit license", ("mit license",), base=True),
    Template("apache", "apache license", ("apache license",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("mit-notice", "released under the mit license", ("released under the", "mit license")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template(
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        ("apache license version 2 0", "you may not use this file except in compliance with the license"),
    ),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license", "version 3")),
    Template(
        "gpl-2.0-or-later",
        "under the terms of the gnu general public license as published by the free software foundation either "
        "version 2 of the license or at your option any later version",
        ("gnu general public license", "free software foundation", "version 2", "any later version"),
    ),
    Template(
        "gpl-3.0-or-later",
        "under the terms of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version",
        ("gnu general public license", "free software foundation", "version 3", "any later version"),
    ),
    Template("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Template(
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain"),
    ),
    Template(
        "bsd-3-clause",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution neither the name of",
        ("redistributions in binary form must reproduce", "neither the name of"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license", "v 2 0"),
    ),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def hashes_of(text: str) -> np.ndarray:
    return word_hashes(np.frombuffer(text.encode(), np.uint8), LOWER, BREAKS)


def vocabulary(templates: Sequence[Template]) -> np.ndarray:
    """Hashes of all words of the templates, sorted."""
    return np.unique(np.concatenate([t.hashes for t in templates]))


def document_counts(docs: DataFrame, vocab: np.ndarray, text_col: str = "text") -> tuple[int, np.ndarray]:
    """How many rows there are, and how many hold each word of ``vocab``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = 0, np.zeros(len(vocab), np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                hashes, counts = words(part, LOWER, BREAKS)
                place, known = _places(hashes, vocab)
                owner = np.repeat(np.arange(len(counts)), counts)[known]
                held += np.bincount(np.unique(owner * len(vocab) + place[known]) % len(vocab), minlength=len(vocab))
                rows += len(counts)
        numbers = pa.array(np.append(held, rows))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocab) + 1), pa.int32()), numbers], ["word", "n"])

    counted = docs.select(text_col).mapInArrow(work, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # one row for each word of the templates
    return found.get(len(vocab), 0), np.array([found.get(i, 0) for i in range(len(vocab))], np.int64)


def _places(hashes: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
    return place, vocab[place] == hashes


def weights(rows: int, held: np.ndarray) -> np.ndarray:
    """Inverse document frequencies, never 0."""
    return np.log((rows + 1) / (held + 0.5)).clip(1e-3)


@dataclass(frozen=True)
class Index:
    """What a task needs: vocabulary, weights, and per template its two postings of highest weight."""

    templates: tuple[Template, ...]
    vocab: np.ndarray
    idf: np.ndarray

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        return self.idf[np.searchsorted(self.vocab, hashes)]

    @cached_property
    def postings(self) -> list[tuple[int, int]]:
        """Places, in each template, of the two key words of highest weight; the first ones of equal words."""
        out = []
        for t in self.templates:
            inside = np.concatenate([np.arange(p, p + n) for p, n in t.phrases])
            order = inside[np.lexsort((inside, -self.weight(t.hashes[inside])))]
            others = order[t.hashes[order] != t.hashes[order[0]]]
            out.append((int(order[0]), int(others[0]) if len(others) else int(order[0])))
        return out

    @cached_property
    def looked_up(self) -> np.ndarray:
        """Hashes of the words in the postings, sorted."""
        return np.unique([t.hashes[p] for t, two in zip(self.templates, self.postings) for p in two])


def slack(distance):
    return SLACK + np.abs(distance) // STRETCH


def matches(hashes: np.ndarray, counts: np.ndarray, index: Index):
    """For each template that stands somewhere: (template, text, start, score), rows of arrays, of the words of
    many texts in a row. ``start`` is the word of its text with which the template begins (its first key
    phrase, if that begins later)."""
    ends = np.cumsum(counts)
    rare, known = _places(hashes, index.looked_up)
    at = np.flatnonzero(known)
    by_word = {int(h): at[rare[at] == i] for i, h in enumerate(index.looked_up)}
    for t, (p, q) in zip(index.templates, index.postings):
        first, second = by_word[int(t.hashes[p])], by_word[int(t.hashes[q])]
        if not len(first) or not len(second):
            continue
        tolerance = 0 if t.base else int(slack(q - p)) if _apart(t, p, q) else 0
        begin = first - p
        near = second - q
        some = np.searchsorted(near, begin + tolerance, "right") > np.searchsorted(near, begin - tolerance, "left")
        begin = begin[some]
        text = np.searchsorted(ends, begin + p, "right")
        start = ends[text] - counts[text]
        place = begin - start
        for k, (place_k, size) in enumerate(t.phrases):
            room = 0 if t.base or place_k <= p < place_k + size else int(slack(place_k - p))
            found = np.full(len(begin), -1, np.int64)
            for shift in sorted(range(-room, room + 1), key=abs):
                here = begin + place_k + shift
                good = (found < 0) & (here >= start) & (here + size <= ends[text])
                good[good] = _phrase_at(hashes, here[good], t.hashes[place_k : place_k + size])
                found[good] = here[good]
            if not k:
                place = np.maximum(found - start, 0)
            keep = found >= 0
            begin, text, start, place = begin[keep], text[keep], start[keep], place[keep]
        if len(begin):
            scores = [_score(hashes, begin[i : i + BLOCK], start[i : i + BLOCK], ends[text[i : i + BLOCK]], t, p, index)
                      for i in range(0, len(begin), BLOCK)]
            yield t, text, place, np.concatenate(scores)


def _apart(t: Template, p: int, q: int) -> bool:
    """Whether two places lie in different key phrases."""
    return not any(a <= p < a + n and a <= q < a + n for a, n in t.phrases)


def _phrase_at(hashes: np.ndarray, places: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    good = np.ones(len(places), bool)
    for k, h in enumerate(phrase):
        good &= hashes[places + k] == h
    return good


def _score(hashes, begin, start, end, t: Template, p: int, index: Index) -> np.ndarray:
    """Share of the template's weight that is there, within the tolerance, and less where little is."""
    there = np.zeros(len(begin))
    weight = index.weight(t.hashes)
    for i, h in enumerate(t.hashes):
        room = 0 if t.base else int(slack(i - p))
        seen = np.zeros(len(begin), bool)
        for shift in range(-room, room + 1):
            here = begin + i + shift
            inside = (here >= start) & (here < end)
            seen[inside] |= hashes[here[inside]] == h
        there += seen * weight[i]
    return there / weight.sum() * there / (there + HALF)


_FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "score double, notices array<struct<label: string, start: long, score: double>>"
)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score
    and notices (label, start, score of each template found, by start).

    A null text is empty; it has no words, no labels and score 0. Rows that repeat give equal rows. All
    places of base phrases count, also those that overlap; labels are sorted and distinct. Weights are
    those of the whole table, each row counting once. An empty table gives an empty result; columns of other
    names are not looked at.
    """
    vocab = vocabulary(templates)
    index = Index(templates, vocab, weights(*document_counts(docs, vocab, text_col)))
    key = free_name(docs.select(text_col), "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                yield pa.RecordBatch.from_pylist(
                    [{key: i, **r} for i, r in zip(batch.column(0).slice(at, len(part)).to_pylist(), _rows(part, index))],
                    schema,
                )
                at += len(part)

    rows = docs.select(F.col(id_col).alias(key), F.col(text_col))
    kind = rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {_FOUND}"
    schema = _arrow_schema(rows.sparkSession, out)
    return rows.mapInArrow(work, out).withColumnRenamed(key, id_col)


def _arrow_schema(spark, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], kind).schema)


def _rows(part: pa.Array, index: Index) -> list[dict]:
    hashes, counts = words(part, LOWER, BREAKS)
    rows = [
        {"n_words": n, "n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [], "score": 0.0, "notices": []}
        for n in counts.tolist()
    ]
    for t, text, place, score in matches(hashes, counts, index):
        for i, at, s in zip(text.tolist(), place.tolist(), score.tolist()):
            row = rows[i]
            row["score"] = max(row["score"], s)
            row["labels"].append(t.label)
            row["notices"].append((at, t.label, s))
            if t.base:
                row["n_base"] += 1
                row["base_labels"].append(t.label)
                row["first_word"] = at if row["first_word"] is None else min(at, row["first_word"])
                row["last_word"] = at if row["last_word"] is None else max(at, row["last_word"])
    for row in rows:
        if row["labels"]:
            row["labels"], row["base_labels"] = sorted(set(row["labels"])), sorted(set(row["base_labels"]))
            row["notices"] = [{"label": n, "start": at, "score": s} for at, n, s in sorted(row["notices"])]
    return rows
