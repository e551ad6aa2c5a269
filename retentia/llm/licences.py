"""Licence scan with a generalised suffix automaton (operator 7).

The word sequences of all templates go into one suffix automaton.  A text's words are streamed through it; after
each word the automaton knows the longest run of words ending there that occurs in some template (the matching
statistics).  A run that cannot be made longer is a match; matches of the same template whose places grow together
are chained, and the chain's covered share of the template is the template's score in this text.

A state also knows which short phrases end its strings, so that the places of the fixed phrases come from the
same pass.  Labels: those of the phrases found, and those of the templates covered by ``min_cover`` or more.

Words: A-Z in lower case, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, that is digits, letters and everything
beyond ASCII.  Defined cases: a null or empty text has no words, no places, no labels and score 0; every row is kept,
repeated rows are scanned each by itself; other columns pass unchanged; without templates only phrases are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from retentia.llm.common import fresh, text_steps

#: The phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence texts and notices (their own wording), by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
     associated documentation files (the "Software"), to deal in the Software without restriction, including without
     limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
     Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
     The above copyright notice and this permission notice shall be included in all copies or substantial portions
     of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
     BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
     compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
     Unless required by applicable law or agreed to in writing, software distributed under the License is
     distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
     the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
     your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
     WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
     GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
     Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
     or (at your option) any later version."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met: Redistributions of source code must retain the above copyright notice,
     this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
     copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
     materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
     hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
     was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
     modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
     binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

#: Words that a match needs, words that may lie between two chained matches, and the share of a template that counts.
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 12, 0.75

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORDS.findall(text.encode().lower())  # bytes.lower() touches A-Z only


class Automaton:
    """Suffix automaton over several word sequences; a border that no text has stands between them."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], phrases: list[tuple[str, list[bytes]]]) -> None:
        self.labels = [label for label, _ in templates]
        self.sizes = [len(w) for _, w in templates]
        sequences = [w for _, w in templates] + [w for _, w in phrases]
        self.vocab: dict[bytes, int] = {}
        for w in (w for seq in sequences for w in seq):
            self.vocab.setdefault(w, len(self.vocab))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: places (template, end) of a state's strings; complete only after the links are walked
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for end, w in enumerate(seq):
                last = self._extend(last, self.vocab[w])
                if k < len(templates):
                    self.ends[last].append((k, end))
        by_length = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in by_length:
            self.ends[self.link[s]] += self.ends[s]
        #: of each state: (words, phrase number) of the phrases that end its strings
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for number, (_, seq) in enumerate(phrases):
            s = 0
            for w in seq:
                s = self.next[s][self.vocab[w]]
            self.phrases[s].append((len(seq), number))
        for s in reversed(by_length):
            self.phrases[s] += self.phrases[self.link[s]]
        self.phrase_labels = [label for label, _ in phrases]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(nxt)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of the sequence read so far, ``last``, followed by word ``w``."""
        if w in self.next[last]:  # another sequence had this already
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, matched words) of every word that some template has; the others match nothing."""
        vocab, nxt, link, length = self.vocab, self.next, self.link, self.length
        state = size = 0
        before = -2
        for i, w in [(i, vocab[w]) for i, w in enumerate(words) if w in vocab]:
            if i != before + 1:
                state = size = 0
            before = i
            step = nxt[state].get(w)
            while step is None and state:
                state = link[state]
                size = length[state]
                step = nxt[state].get(w)
            if step is not None:
                state, size = step, size + 1
            yield i, state, size


def scan(words: list[bytes], automaton: Automaton, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP,
         min_cover: float = MIN_COVER) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
    """Places (start, phrase) of the phrases, and covered spans (template, first word, end, share)."""
    places: list[tuple[int, int]] = []
    matches: list[tuple[int, int, int]] = []  # start, end, state: those that cannot be made longer
    held: tuple[int, int, int] | None = None
    phrases = automaton.phrases
    for i, state, size in automaton.statistics(words):
        for n, number in phrases[state]:
            if n <= size:
                places.append((i - n + 1, number))
        start = i - size + 1
        if held and (held[1] != i or held[0] != start):
            matches.append(held)
            held = None
        if size >= min_match:
            held = (start, i + 1, state)
    if held:
        matches.append(held)
    return places, _chains(matches, automaton, max_gap, min_cover)


def _chains(matches: list[tuple[int, int, int]], automaton: Automaton, max_gap: int, min_cover: float) -> list[tuple[int, int, int, float]]:
    """Chains the matches of each template in order of the text; a chain goes on where the template goes on.

    Of the open chains of a template only those within ``max_gap`` words are kept, so that a long text holds few.
    """
    found: list[tuple[int, int, int, float]] = []
    open_: dict[int, list[list[int]]] = {}  # by template: [first word, end in text, end in template, covered words]

    def close(template: int, chain: list[int]) -> None:
        share = chain[3] / automaton.sizes[template]
        if share >= min_cover:
            found.append((template, chain[0], chain[1], min(1.0, share)))

    for start, end, state in matches:
        for template, last in automaton.ends[state]:
            at = last + 1 - (end - start)
            if at < 0:
                continue
            chains, kept, best = open_.get(template, []), [], None
            for c in chains:
                if c[1] + max_gap < start:
                    close(template, c)
                    continue
                kept.append(c)
                if c[2] < last + 1 and c[1] < end and at - c[2] <= max_gap and (best is None or c[3] > best[3]):
                    best = c
            if best:
                new = min(last + 1 - best[2], end - best[1], end - start)
                best[1], best[2], best[3] = end, last + 1, best[3] + new
            else:
                kept.append([start, end, last + 1, end - start])
            open_[template] = kept
    for template, chains in open_.items():
        for c in chains:
            close(template, c)
    return found


_BUILT: dict[str, Automaton] = {}


def automaton_of(templates: list[tuple[str, str]], phrases: dict[str, str]) -> Automaton:
    """The automaton, built once in a Python process."""
    key = repr((templates, phrases))
    if key not in _BUILT:
        _BUILT[key] = Automaton([(label, words_of(t)) for label, t in templates], [(label, words_of(p)) for p, label in phrases.items()])
    return _BUILT[key]


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("covered", T.DoubleType())]))),
])


def scan_text(text: str, automaton: Automaton) -> tuple:
    """A row of ``RESULT`` for one text; the score is the largest covered share, 1 where a phrase stands whole."""
    words = words_of(text)
    places, spans = scan(words, automaton)
    base = sorted({automaton.phrase_labels[p] for _, p in places})
    labels = sorted({automaton.labels[t] for t, *_ in spans}.union(base))
    score = 1.0 if places else max((s[3] for s in spans), default=0.0)
    starts = [s for s, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score,
            [{"label": automaton.labels[t], "start": a, "end": b, "covered": c} for t, a, b, c in sorted(spans, key=lambda s: s[1:3] + s[:1])])


def find_licences(df: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
                  phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``df`` with the columns of ``RESULT`` (underscores in front where a name is taken)."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = [fresh(f.name, df.columns) for f in RESULT]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(names, RESULT)]])
    kinds = [to_arrow_type(f.dataType) for f in RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(templates, phrases)
        for batch in batches:
            for part in text_steps(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                cols = zip(*[scan_text(t or "", automaton) for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                                 names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)
