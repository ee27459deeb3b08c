"""Licence scans: matching statistics against a generalised suffix automaton of licence texts.

The automaton holds every run of words of the templates. A text streams through it: at each
word the state is the longest run ending there that some template has. Runs that cannot be
extended and have ``min_match`` words or more are chained, template by template, in the order
of both texts with at most ``max_gap`` text words between them; a chain's cover is the share of
the template's words in it. A template whose best chain covers ``min_cover`` gives its label.
Beside that stand the base phrases, whose places are counted word for word.

Defined results: a null or empty text has no words, no labels and score 0. Repeated rows each
get a row, null ids stay, empty tables give empty results. Other columns are not read. The
score is the largest cover of any template, and at least 0.5 where a base phrase stands.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.llm.text import alnum_words, table

MIN_MATCH, MAX_GAP, MIN_COVER = 4, 60, 0.7

# Labels with the public wording of licence notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)
BASE_PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


class Run(NamedTuple):
    """Text words [start, start + length) that end at word ``end`` of the templates in ``at``."""

    start: int
    length: int
    at: tuple[tuple[int, int], ...]


class Automaton:
    """A generalised suffix automaton over word numbers; state 0 is the empty run."""

    def __init__(self, texts: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(texts):
            last = 0
            for k, word in enumerate(words):
                last = self._extend(last, word, ends)
                ends[last].add((t, k + 1))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _state(self, length: int, link: int, nexts: dict[int, int], ends: list[set[tuple[int, int]]]) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, at: int, word: int, ends: list[set[tuple[int, int]]]) -> int:
        """The state that ``word`` leads to from ``at``, made to hold no longer runs than at's and the word."""
        to = self.next[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]), ends)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int, ends: list[set[tuple[int, int]]]) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        new, at = self._state(self.length[last] + 1, 0, {}, ends), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, ends)
        return new

    def runs(self, words: list[int], first: int, least: int) -> Iterator[Run]:
        """Longest runs that end where they cannot go on; ``first`` is the place of words[0]."""
        state = length = 0
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                if length >= least:
                    yield Run(first + k - length, length, self.ends[state])
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
        if length >= least:
            yield Run(first + len(words) - length, length, self.ends[state])


class Scanner:
    """The automaton, the word numbers and the base phrases of a set of templates."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES) -> None:
        self.labels = [label for label, _ in templates]
        texts = [alnum_words(t) for _, t in templates]
        self.phrases = [(label, alnum_words(p)) for label, p in phrases]
        self.number = {w: n for n, w in enumerate(sorted({w for t in [*texts, *(p for _, p in self.phrases)] for w in t}))}
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton([[self.number[w] for w in t] for t in texts])

    def base_places(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for label, phrase in self.phrases:
            n = len(ids) - len(phrase) + 1
            hit = np.ones(max(n, 0), bool)
            for k, word in enumerate(phrase):
                hit &= ids[k : k + max(n, 0)] == self.number[word]
            out[label] = np.flatnonzero(hit)
        return out

    def covers(self, ids: np.ndarray, min_match: int, max_gap: int) -> dict[int, tuple[float, int, int]]:
        """For each template met: the cover of its best chain, and the chain's first and last text word."""
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in known.reshape(-1, 2).tolist():
            if b - a >= min_match:
                for run in self.automaton.runs(ids[a:b].tolist(), a, min_match):
                    for t, end in run.at:
                        found.setdefault(t, []).append((run.start, run.length, end))
        return {t: self._chain(pieces, self.sizes[t], max_gap) for t, pieces in found.items()}

    @staticmethod
    def _chain(pieces: list[tuple[int, int, int]], size: int, max_gap: int) -> tuple[float, int, int]:
        pieces.sort(key=lambda p: (p[0] + p[1], p[2]))
        best: list[tuple[int, int]] = []
        ends = [start + length for start, length, _ in pieces]
        for k, (start, length, end) in enumerate(pieces):
            own = (length, start)
            for j in range(bisect_left(ends, start - max_gap), k):
                s, n, e = pieces[j]
                over = max(0, s + n - start, e - (end - length))
                if e < end and s < start and over < length and best[j][0] + length - over > own[0]:
                    own = (best[j][0] + length - over, best[j][1])
            best.append(own)
        k = max(range(len(best)), key=lambda i: best[i][0])
        return best[k][0] / size, best[k][1], pieces[k][0] + pieces[k][1] - 1


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(text: str | None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, spans (label, first, last, cover), score)."""
    s, words = scanner(), alnum_words(text)
    get = s.number.get
    ids = np.array([get(w, -1) for w in words], np.int64)
    places = s.base_places(ids)
    every = np.concatenate(list(places.values()))
    covers = s.covers(ids, min_match, max_gap)
    spans = sorted((s.labels[t], first, last, cover) for t, (cover, first, last) in covers.items() if cover >= min_cover)
    score = max([0.0, *(c[0] for c in covers.values())])
    base = sorted(k for k, v in places.items() if len(v))
    first, last = (int(every.min()), int(every.max())) if len(every) else (None, None)
    return len(words), len(every), first, last, base, spans, min(1.0, max(score, 0.5 if base else 0.0))


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, spans, score) of each row."""
    rows = docs.select(F.col(id_col), F.col(text).alias("_text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "score"]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [scan(t, min_match, max_gap, min_cover) for t in frame["_text"]]
            out = pd.DataFrame({n: pd.Series([d[k] for d in done], dtype=object) for k, n in enumerate(names)})
            out["spans"] = [[{"label": x, "first": a, "last": b, "cover": c} for x, a, b, c in d[5]] for d in done]
            out.insert(0, id_col, frame[id_col].to_numpy())
            yield out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInPandas(of, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans array<struct<label:string,first:long,last:long,cover:double>>, score double")


def op5_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"))
    labels = F.array_join(F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"]))), ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), labels.alias("labels"), "score")
