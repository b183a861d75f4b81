"""Licence scan: matching statistics against a generalised suffix automaton of licence words.

All licence phrases and notices share one automaton over words. A file's words are streamed through it: at each word the
state gives the longest run of words, ending there, that stands in some template. Runs are chained per template into
spans (in template order, small gaps allowed); a span counts when it covers enough of its template.

Words that cannot be part of a match are skipped in bulk: only stretches whose neighbouring words are neighbours in some
template are streamed.

Defined cases: a null or blank text has no words and no spans. Repeated rows are scanned alike; null ids pass through.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from judgeline.llm.common import map_texts, texts

# Phrases whose every occurrence counts, and notices as licensors print them.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
               "with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version 3 of the license or at your "
            "option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words between two matches of one span, at most.
GAP = 8
#: Share of a template that a span must cover.
COVERED = 0.7

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z to a-z; whatever is no digit, letter or non-ASCII byte becomes a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class LicenceAutomaton:
    """Suffix automaton of several word sequences, with all places of each state."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.templates = [(label, words_of(t.encode()), True) for label, t in phrases]
        self.templates += [(label, words_of(t.encode()), False) for label, t in notices]
        vocabulary = sorted({w for _, words, _ in self.templates for w in words})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        v = len(vocabulary)
        self.beside = np.zeros((v + 1, v + 1), bool)
        self.step, self.link, self.size, self.places = [{}], [-1], [0], [[]]
        for t, (_, words, _) in enumerate(self.templates):
            last = 0
            for at, w in enumerate(self.ids[x] for x in words):
                last = self._extend(last, w)
                self.places[last].append((t, at + 1))
            for a, b in zip(words, words[1:]):
                self.beside[self.ids[a], self.ids[b]] = True
        for s in sorted(range(1, len(self.step)), key=lambda i: -self.size[i]):
            self.places[self.link[s]] = list({*self.places[self.link[s]], *self.places[s]})
        # Phrases that end wherever a state is reached: its own and those of its suffixes.
        self.ending: list[list[tuple[str, int]]] = [[] for _ in self.step]
        for label, words, phrase in self.templates:
            if phrase and words:
                s = 0
                for w in words:
                    s = self.step[s][self.ids[w]]
                self.ending[s].append((label, len(words)))
        for s in sorted(range(1, len(self.step)), key=lambda i: self.size[i]):
            self.ending[s] += self.ending[self.link[s]]

    def _extend(self, last: int, w: int) -> int:
        if w in self.step[last]:
            q = self.step[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._twin(last, q, w)
        now = self._state({}, self.size[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = now
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[now] = q if self.size[q] == self.size[p] + 1 else self._twin(p, q, w)
        return now

    def _twin(self, p: int, q: int, w: int) -> int:
        twin = self._state(dict(self.step[q]), self.size[p] + 1, self.link[q])
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _state(self, step: dict, size: int, link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.places.append([])
        return len(self.step) - 1

    def matches(self, ids: list[int]):
        """Matching statistics: (index, state, length) after each word."""
        state, length = 0, 0
        for i, w in enumerate(ids):
            while state and w not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.step[state]:
                state, length = self.step[state][w], length + 1
            yield i, state, length

    def stretches(self, words: list[bytes]):
        """(start, ids) of the maximal stretches in which each two neighbours are neighbours in a template."""
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        joined = np.concatenate(([False], self.beside[ids[:-1], ids[1:]], [False])) if len(ids) else np.zeros(1, bool)
        edges = np.flatnonzero(joined[1:] != joined[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield a, ids[a:b + 1].tolist()

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float, bool]]:
        """Spans (label, start, end, share covered, whether a phrase), by start."""
        found, runs = [], {}
        for start, ids in self.stretches(words):
            seen = list(self.matches(ids))
            for i, state, length in seen:
                if length < 2:
                    continue
                grows = i + 1 < len(seen) and seen[i + 1][2] == length + 1
                for label, k in self.ending[state]:
                    if k <= length:
                        found.append((label, start + i + 1 - k, start + i + 1, 1.0, True))
                for t, end in self.places[state]:
                    if not self.templates[t][2] and (not grows or (t, end + 1) not in self.places[seen[i + 1][1]]):
                        k = min(length, end)
                        runs.setdefault(t, []).append((start + i + 1 - k, start + i + 1, end - k, end))
        for t, parts in runs.items():
            label, template, _ = self.templates[t]
            chain: list[tuple[int, int, int, int]] = []
            for run in sorted(parts) + [(1 << 60, 0, 0, 0)]:
                if chain and run[0] - chain[-1][1] <= GAP and run[2] >= chain[-1][3]:
                    chain.append(run)
                    continue
                if chain:
                    if run[0] < chain[-1][1]:
                        if run[1] - run[0] > sum(r[1] - r[0] for r in chain):
                            chain = [run]
                        continue
                    share = sum(r[1] - r[0] for r in chain) / len(template)
                    if share >= COVERED and (len(template) > 5 or share == 1):
                        found.append((label, chain[0][0], chain[-1][1], min(1.0, share), False))
                chain = [run]
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))


@lru_cache(maxsize=2)
def automaton(phrases=PHRASES, notices=NOTICES) -> LicenceAutomaton:
    return LicenceAutomaton(phrases, notices)


def scan_licences(
    docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words`` and the spans as parallel arrays ``labels, starts, ends, shares, exact`` (word positions)."""
    def make():
        tool = automaton(tuple(phrases), tuple(notices))

        def work(batch: pa.RecordBatch) -> dict:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            spans = [tool.scan(w) for w in words]
            parts = [[[s[k] for s in row] for row in spans] for k in range(5)]
            return dict(zip(
                ("doc_id", "n_words", "labels", "starts", "ends", "shares", "exact"),
                (batch.column("doc_id"), [len(w) for w in words], *parts)))

        return work

    return map_texts(
        texts(docs, id_col, text_col), make,
        "doc_id long, n_words long, labels array<string>, starts array<long>, ends array<long>, shares array<double>, "
        "exact array<boolean>")
