"""Licence scans with a generalised suffix automaton.

The automaton accepts every run of words of every licence template. A text is
streamed through it once: at each word the state and its match length are the
matching statistics (the longest run ending there that occurs in a template).
Phrases are read off the states (a phrase ends where its state lies on the
suffix-link path); long matches are chained, per template, into the spans of
the template that the text covers.

Matches of two words or more only exist where a pair of words occurs in a
template. So the words of a text are looked up as arrays, and the automaton
steps only through the runs of such pairs; elsewhere the statistics are 0 or 1.

A text is read in steps of STEP bytes that end where a word ends; state and
match length go on from step to step. So a very long text costs its bytes (as
read and folded), the words of one step and its matches, not a list of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlens.llm.common import WORD_TABLE, ascii_words

# Phrases whose places are counted, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Public notices and main clauses of common licences, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License "
               "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
               "worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare "
               "Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such "
               "Derivative Works in Source or Object form."),
    ("apache", "You must cause any modified files to carry prominent notices stating that You changed the files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
            "GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided "
            "that you conspicuously and appropriately publish on each copy an appropriate copyright notice"),
    ("gpl", "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, "
            "provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice "
            "and disclaimer of warranty"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the "
             "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 "
             "of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("agpl", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
             "specifically designed to ensure cooperation with the community in the case of network server software."),
    ("agpl", "if you modify the Program, your modified version must prominently offer all users interacting with it "
             "remotely through a computer network an opportunity to receive the Corresponding Source of your version"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "All distribution of Covered Software in Source Code Form, including any Modifications that You create or "
            "to which You contribute, must be under the terms of this License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
              "software and accompanying documentation covered by this license to use, reproduce, display, distribute, "
              "execute, and transmit the Software"),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
             "original software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("epl", "The accompanying program is provided under the terms of this Eclipse Public License. Any use, reproduction "
            "or distribution of the program constitutes recipient's acceptance of this agreement."),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all "
            "of his or her rights to the work worldwide under copyright law"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
]

MIN_MATCH = 3     # words of a match that counts as long
MIN_COVER = 0.6   # covered share of a template that gives its label
STEP = 1 << 20    # bytes of a text that are split into words at once


def word_steps(text: str | None, step: int = STEP):
    """Words of a text as :func:`ascii_words` gives them, in lists of about
    ``step`` bytes; a longer word stays whole."""
    data = text.encode("utf-8", "surrogatepass").translate(WORD_TABLE) if text else b""
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + step)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


class Automaton:
    """Generalised suffix automaton over the words of templates and phrases."""

    def __init__(self, templates, phrases):
        self.labels = [label for label, _ in templates]
        self.words = [ascii_words(text) for _, text in templates]
        self.phrases = [(tuple(ascii_words(p)), label) for p, label in phrases.items()]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocab: dict[bytes, int] = {}
        runs = [*self.words, *(list(p) for p, _ in self.phrases)]
        ends: dict[int, set[tuple[int, int]]] = {}  # state of a prefix: (template, last word)
        pairs = set()
        for t, run in enumerate(runs):
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in run]
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for i, c in enumerate(ids):
                last = self._extend(last, c)
                if t < len(templates):
                    ends.setdefault(last, set()).add((t, i))
        # pairs of words that occur, as numbers; the index after the last one is a word of no template
        self.pairs = np.array(sorted(a * (len(self.vocab) + 1) + b for a, b in pairs), np.int64)
        # occurrences of a state's runs: of the prefixes below it in the link tree. Runs of one word match nothing.
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] > 1:
                ends.setdefault(self.link[s], set()).update(ends.get(s, ()))
        self.ends = {s: sorted(e) for s, e in ends.items()}
        at = {self._walk(p): k for k, (p, _) in enumerate(self.phrases)}
        self.spoken: list[list[int]] = []  # phrases on the path of suffix links
        for s in range(len(self.link)):
            found, x = [], s
            while x > 0:
                if x in at:
                    found.append(at[x])
                x = self.link[x]
            self.spoken.append(found)

    def _walk(self, run) -> int:
        s = 0
        for w in run:
            s = self.next[s][self.vocab[w]]
        return s

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(p, q):
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            new = len(nxt) - 1
            link[q] = new
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = new
                p = link[p]
            return new

        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else clone(last, q)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        cur, p = len(nxt) - 1, last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else clone(p, q)
        return cur

    def _pairs_at(self, ids: np.ndarray) -> np.ndarray:
        """Positions of the words that form a pair with the next one."""
        none = len(self.vocab)
        at = np.flatnonzero((ids[:-1] < none) & (ids[1:] < none))
        code = ids[at] * (none + 1) + ids[at + 1]
        place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return at[self.pairs[place] == code] if len(self.pairs) else at[:0]

    def statistics(self, steps):
        """(position, state, match length) of the words where a match of two
        words or more ends, in order; ``steps`` are lists of words."""
        none, get = len(self.vocab), self.vocab.get
        nxt, link, length = self.next, self.link, self.length
        state, n, prev = 0, 0, -2
        base, before = 0, []  # position of the first of ids; the last word of the step before
        for words in steps:
            ids = np.fromiter((*before, *(get(w, none) for w in words)), np.int64)
            for j in self._pairs_at(ids).tolist():
                i = base + j
                if i != prev + 1:  # a new run: its first word alone
                    state, n = nxt[0][int(ids[j])], 1
                prev, c = i, int(ids[j + 1])
                while state and c not in nxt[state]:
                    state = link[state]
                    n = length[state]
                state = nxt[state][c]
                n += 1
                yield i + 1, state, n
            if len(ids):
                base += len(ids) - 1
                before = [int(ids[-1])]

    def scan(self, steps, min_match: int = MIN_MATCH):
        """Phrase places [(first word, phrase)] and covered spans by template
        {template: [(first, last template word, first word of the text)]}."""
        places, spans = [], {}

        def ended(i, s, n):
            for t, last in self.ends.get(s, ()) if n >= min_match else ():
                if last + 1 >= n:
                    spans.setdefault(t, []).append((last - n + 1, last, i - n + 1))

        open_match = None
        for i, s, n in self.statistics(steps):
            for k in self.spoken[s]:
                size = len(self.phrases[k][0])
                if size <= n:
                    places.append((i - size + 1, k))
            if open_match and not (open_match[0] == i - 1 and open_match[2] + 1 == n):
                ended(*open_match)
            open_match = (i, s, n)  # the longest of a match that goes on
        if open_match:
            ended(*open_match)
        return places, {t: self._cover(x, len(self.words[t])) for t, x in spans.items()}

    def _cover(self, spans, gap: int):
        """The best chain of a template's matches. Matches further apart in the
        text than the template is long belong to different copies of it, so
        that words strewn over a long text cover nothing together."""
        spans.sort(key=lambda x: (x[2], x[0]))
        groups, reach = [], None
        for lo, hi, at in spans:
            if reach is None or at - reach > gap:
                groups.append([])
            groups[-1].append((lo, hi, at))
            reach = max(reach or 0, at + hi - lo)
        chains = [self._chain(g) for g in groups]
        return max(chains, key=lambda c: sum(hi - lo + 1 for lo, hi, _ in c))

    @staticmethod
    def _chain(spans):
        """The chain of matches, ascending in text and template, that covers
        most of the template; overlaps are trimmed. Matches are given in text
        order, and the best chain is kept for each last template word, so the
        work is matches times template words."""
        best: dict[int, tuple[int, tuple | None]] = {}
        for lo, hi, at in spans:
            size, chain = hi - lo + 1, ((lo, hi, at), None)
            for end, (n, before) in best.items():
                if end < hi and before[0][2] < at:
                    start = max(lo, end + 1)
                    if n + hi - start + 1 > size:
                        size, chain = n + hi - start + 1, ((start, hi, at), before)
            if size > best.get(hi, (0, None))[0]:
                best[hi] = (size, chain)
        _, node = max(best.values(), key=lambda x: x[0])
        out = []
        while node:
            out.append(node[0])
            node = node[1]
        return out[::-1]


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                                  ("n_words", pa.int64()), ("covered", pa.float64())])))])


def _scan(templates, phrases, min_match, min_cover):
    def run(batches):
        sam = Automaton(templates, phrases)
        for batch in batches:
            out = {f.name: [] for f in _SCHEMA}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_words = 0

                def counted(steps):
                    nonlocal n_words
                    for words in steps:
                        n_words += len(words)
                        yield words

                places, spans = sam.scan(counted(word_steps(text.as_py())), min_match)
                found = []
                for t, chain in sorted(spans.items()):
                    size = sum(hi - lo + 1 for lo, hi, _ in chain)
                    found.append({"label": sam.labels[t], "first_word": chain[0][2], "n_words": size,
                                  "covered": size / len(sam.words[t])})
                base = {sam.phrases[k][1] for _, k in places}
                more = {x["label"] for x in found if x["covered"] >= min_cover}
                starts = [i for i, _ in places]
                row = (doc_id, n_words, len(places), min(starts, default=None), max(starts, default=None),
                       ",".join(sorted(base)), ",".join(sorted(base | more)),
                       1.0 if base else max((x["covered"] for x in found), default=0.0), found)
                for f, v in zip(_SCHEMA, row):
                    out[f.name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)

    return run


def license_scan(docs: DataFrame, templates=None, phrases=None, min_match: int = MIN_MATCH,
                 min_cover: float = MIN_COVER) -> DataFrame:
    """Licence phrases and covered template spans of every whole text.

    ``docs`` needs doc_id and text; further columns are ignored. Returns a row
    for every input row: doc_id, n_words, n_base (places where a phrase's words
    stand consecutively), first_word and last_word (smallest and largest start
    of these, from 0; null if none), base_labels and labels (distinct, sorted,
    comma-joined; '' if none; labels adds the templates covered by at least
    ``min_cover``), score (1 with a base phrase, else the largest covered share
    of a template) and spans (label, first word in the text, covered words and
    share of each template matched in part: of its best chain, whose matches are
    no further apart than the template is long).

    Null text counts as empty: 0 words. Overlapping and repeated phrases all
    count. Null ids and repeated rows pass through; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _scan(templates or TEMPLATES, phrases or PHRASES, min_match, min_cover),
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<label: string, first_word: bigint, n_words: bigint, "
        "covered: double>>")
