"""Licence scan: a generalised suffix automaton over the tokens of licence texts.

Files are streamed through the automaton, which gives matching statistics: the
longest run of tokens ending at each place that occurs in some licence text.
Long maximal runs are chained, in order both in the file and in the template,
into covered template spans; the covered share of a template decides its label.

Only tokens of the templates can advance the automaton, so the vectorised
token hashes pick out the stretches that are streamed.

Defined cases: a null or empty text has no words and no label; a null doc_id is
kept; repeated rows are scanned each alone.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import text as tx

IS_TOKEN = np.zeros(256, dtype=bool)
IS_TOKEN[0x30:0x3A] = IS_TOKEN[0x61:0x7B] = True
IS_TOKEN[0x80:] = True

# The phrases and labels of the base rule.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Openings, notices and later clauses of published licence texts, each with its label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)


@dataclass(frozen=True)
class LicenceSettings:
    min_match: int = 3
    max_gap: int = 20
    min_cover: float = 0.75


def hash_tokens(tokens: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(tokens).encode(), dtype=np.uint8)
    start, end, _ = tx.word_spans(data, np.array([0, len(data)]), IS_TOKEN)
    return tx.span_hashes(data, start, end)


@dataclass
class SuffixAutomaton:
    """Generalised over several token sequences; each state knows one end per sequence."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, set[int]]] = field(default_factory=lambda: [{}])

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _divide(self, p: int, token: int) -> int:
        """The state reached from p by token, cut down to length[p] + 1 if it is longer."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], number: int) -> None:
        last = 0
        for place, token in enumerate(sequence):
            if token in self.next[last]:
                last = self._divide(last, token)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = new
                    p = self.link[p]
                self.link[new] = 0 if p < 0 else self._divide(p, token)
                last = new
            self.ends[last].setdefault(number, set()).add(place + 1)

    def close(self) -> None:
        """Hand the ends of every state to its suffixes."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for number, places in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, set()).update(places)

    def longest_matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of matches that the next token does not extend."""
        found, state, length = [], 0, 0
        for place, token in enumerate(tokens):
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
                continue
            if length >= least:
                found.append((place, length, state))
            while state > 0 and token not in self.next[state]:
                state = self.link[state]
            length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
        if length >= least:
            found.append((len(tokens), length, state))
        return found


def chained_cover(matches: list[tuple[int, int, int]], max_gap: int) -> tuple[int, int, int]:
    """Most template tokens covered by matches (file start, template start, length) in order in both, and their span in the file."""
    ordered = sorted(matches)
    best: list[tuple[int, int, int]] = []
    starts = [m[0] for m in ordered]
    longest = max((m[2] for m in ordered), default=0)
    for i, (at, place, length) in enumerate(ordered):
        cover, first = length, at
        # Matches so far back that even the longest would leave too wide a gap cannot be continued.
        for j in range(bisect.bisect_left(starts, at - max_gap - longest), i):
            before, before_place, before_length = ordered[j]
            overlap = max(0, before_place + before_length - place, before + before_length - at)
            if before_place < place and overlap < length and at - (before + before_length) <= max_gap:
                if best[j][0] + length - overlap > cover:
                    cover, first = best[j][0] + length - overlap, best[j][1]
        best.append((cover, first, at + length))
    return max(best, key=lambda b: (b[0], -b[1]), default=(0, 0, 0))


class Scanner:
    """Templates and phrases prepared once for each task."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, settings: LicenceSettings = LicenceSettings()):
        self.settings, self.templates = settings, templates
        words = sorted({w for _, t in templates for w in t.split()})
        self.hashes = hash_tokens(words)
        number = {w: i for i, w in enumerate(words)}
        order = np.argsort(self.hashes)
        self.sorted_hashes, self.sorted_ids = self.hashes[order], order
        self.sizes = [len(t.split()) for _, t in templates]
        self.automaton = SuffixAutomaton()
        for i, (_, t) in enumerate(templates):
            self.automaton.add([number[w] for w in t.split()], i)
        self.automaton.close()
        self.phrases = [(label, hash_tokens(p.split())) for p, label in phrases]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.sorted_hashes, hashes), len(self.sorted_hashes) - 1)
        return np.where(self.sorted_hashes[place] == hashes, self.sorted_ids[place], -1)

    def covers(self, stretches: list[tuple[int, list[int]]]) -> dict[int, tuple[int, int, int]]:
        """Covered tokens and their span by template, from a document's stretches (first word, ids)."""
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for first, tokens in stretches:
            for end, length, state in self.automaton.longest_matches(tokens, self.settings.min_match):
                for template, places in self.automaton.ends[state].items():
                    for place in places:
                        matches.setdefault(template, []).append((first + end - length, place - length, length))
        return {t: chained_cover(m, self.settings.max_gap) for t, m in matches.items()}

    def judged(self, covers: dict[int, tuple[int, int, int]]) -> tuple[float, set[str]]:
        """The best covered share, and the labels.

        Licences of one family share most of their words. Where templates of
        different labels lie on the same words, the one that covers more of them counts.
        """
        share = {t: cover / self.sizes[t] for t, (cover, _, _) in covers.items()}
        enough = [t for t in covers if share[t] >= self.settings.min_cover]

        def beaten(t: int) -> bool:
            cover, first, past = covers[t]
            for u in enough:
                more, begin, end = covers[u]
                common = min(past, end) - max(first, begin)
                if self.templates[u][0] != self.templates[t][0] and 2 * common >= past - first and (more, share[u]) > (cover, share[t]):
                    return True
            return False

        return max(share.values(), default=0.0), {self.templates[t][0] for t in enough if not beaten(t)}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, settings: LicenceSettings = LicenceSettings()) -> DataFrame:
    """Phrase places, labels and the best covered share of every document."""
    prepared: list[Scanner] = []

    def run(rows, data, bounds):
        if not prepared:
            prepared.append(Scanner(templates, phrases, settings))
        scanner, n = prepared[0], len(bounds) - 1
        data = tx.LOWER[data]
        start, end, row = tx.word_spans(data, bounds, IS_TOKEN)
        hashes = tx.span_hashes(data, start, end)
        first_of_row = tx.group_bounds(row, n)
        n_words = np.diff(first_of_row)

        n_base = np.zeros(n, dtype=np.int64)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[set[str]] = [set() for _ in range(n)]
        for label, phrase in scanner.phrases:
            size = len(phrase)
            if len(hashes) < size:
                continue
            hit = row[size - 1 :] == row[: len(row) - size + 1]
            for k, h in enumerate(phrase):
                hit = hit & (hashes[k : len(hashes) - size + 1 + k] == h)
            at = np.flatnonzero(hit)
            n_base += np.bincount(row[at], minlength=n)
            place = at - first_of_row[row[at]]
            np.minimum.at(first, row[at], place)
            np.maximum.at(last, row[at], place)
            for r in np.unique(row[at]):
                labels[r].add(label)

        score, found = np.zeros(n), [set(x) for x in labels]
        ids = scanner.ids(hashes) if len(hashes) else np.zeros(0, np.int64)
        s, e, r = tx.runs(ids >= 0, first_of_row)
        long = np.flatnonzero(e - s >= settings.min_match)
        stretches: dict[int, list] = {}
        for i in long:
            stretches.setdefault(int(r[i]), []).append((int(s[i] - first_of_row[r[i]]), ids[s[i] : e[i]].tolist()))
        for number, own in stretches.items():
            score[number], told = scanner.judged(scanner.covers(own))
            found[number] |= told
        none = n_base == 0
        return {
            "doc_id": rows.column("doc_id"),
            "n_words": n_words,
            "n_base": n_base,
            "first_word": pa.array(np.where(none, 0, first), mask=none),
            "last_word": pa.array(np.where(none, 0, last), mask=none),
            "base_labels": [",".join(sorted(x)) for x in labels],
            "labels": [",".join(sorted(x)) for x in found],
            "score": np.minimum(score, 1.0),
        }

    return tx.map_texts(
        docs.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
