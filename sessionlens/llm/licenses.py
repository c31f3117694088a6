"""License scans as an exact set-similarity join of templates with text blocks.

Templates and blocks are token sets.  A block matches a template when it holds
at least ``threshold`` of the template's tokens (containment).  Tokens are put
in one global order, rarest in the whole corpus first; then

* prefix filter: a matching block holds one of the first
  ``|T| - need + 1`` tokens of the template, ``need = ceil(threshold * |T|)``;
* length filter: the block holds at least ``need`` tokens of the vocabulary;
* positional filter: with the first common prefix token at place ``i`` of the
  template and ``j`` of the block, ``min(|T| - i, |B| - j)`` must reach ``need``.

What is left is verified by intersection, so the join is exact.  Blocks are the
lines of a text; a line of more than ``block_words`` words is cut into windows
of that many words, each half overlapping the next.  The same windows over the
words of the whole text, regardless of line feeds, are blocks where they reach
over one: they hold notices that are wrapped or stand in comments.  Templates are a parameter
held by the driver, so their index is small and every task gets a copy; the
documents are scanned twice (token counts, join) and never shuffled.

Null texts count as empty and match nothing; every row is scanned by itself; an
empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from sessionlens.llm.common import each, id_and_text, map_texts, slices

#: Label -> phrase whose words must stand consecutively.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Fixed values, (label, notice): well-known notices of public licenses; of long
#: licenses the sentences that tell them apart, each of at most 64 words.  Of fewer
#: than ten different words every one must be there (threshold 0.9): short notices
#: stand for licenses that differ from another in one word.
TEMPLATES = (
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("artistic-2.0", "You are permitted to use this Package under the terms of the Artistic License 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "available under the Creative Commons Attribution-ShareAlike License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ms-pl", "Microsoft Public License (Ms-PL)"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("upl-1.0", "Licensed under the Universal Permissive License v 1.0"),
    ("wtfpl", "This program is free software. It comes without any warranty, to the extent permitted by applicable law"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)

#: Bytes outside words become spaces, A-Z becomes a-z; line feeds stay.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 or c == 0x0A else 0x20
    for c in range(256)
)


def lines_of_words(text: str | None) -> list[list[bytes]]:
    """Words (ASCII letters in lower case) of each line."""
    return [line.split() for line in (text or "").encode().translate(_WORD_BYTES).split(b"\n")]


def token_set(text: str) -> set[bytes]:
    return {w for line in lines_of_words(text) for w in line}


def token_counts(docs: DataFrame, vocabulary: set[bytes], id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """How often each vocabulary token occurs in all texts (at most one number per token reaches the driver)."""

    def run(batches):
        counts: Counter = Counter()
        for part in slices(batches):
            for text in part.column(1).to_pylist():
                for line in lines_of_words(text):
                    counts.update(w for w in line if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    partial = id_and_text(docs, id_col, text_col).mapInArrow(run, "token binary, n long")
    return {bytes(r.token): r.n for r in partial.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class TemplateIndex:
    """The templates in the global token order, with their prefixes."""

    def __init__(self, templates, phrases: dict[str, str], counts: dict[bytes, int], threshold: float) -> None:
        sets = [(label, token_set(text)) for label, text in templates]
        phrase_words = {label: [w for line in lines_of_words(p) for w in line] for label, p in phrases.items()}
        words = {w for _, s in sets for w in s} | {w for p in phrase_words.values() for w in p}
        order = sorted(words, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.templates = [(label, sorted(self.rank[w] for w in s)) for label, s in sets if s]
        self.need = [ceil(threshold * len(ranks) - 1e-9) for _, ranks in self.templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (_, ranks) in enumerate(self.templates):
            for i, r in enumerate(ranks[: len(ranks) - self.need[t] + 1]):
                self.prefix.setdefault(r, []).append((t, i))
        self.in_prefix = np.zeros(len(order) + 1, bool)  # the last place stands for words outside
        self.in_prefix[list(self.prefix)] = True
        self.phrases = [(label, [self.rank[w] for w in p]) for label, p in phrase_words.items() if p]

    def matches(self, block: np.ndarray) -> list[tuple[int, float]]:
        """(template, containment) of the templates that the block (ranks of its words) meets."""
        tokens = np.unique(block[block < len(self.rank)]).tolist()
        seen: set[int] = set()
        out = []
        for j, token in enumerate(tokens):
            for t, i in self.prefix.get(token, ()):
                ranks, need = self.templates[t][1], self.need[t]
                if t in seen or len(tokens) < need:
                    continue
                seen.add(t)  # earlier tokens of the block are not in the prefix, so this is the first common one
                if min(len(ranks) - i, len(tokens) - j) >= need and (common := len(set(ranks).intersection(tokens))) >= need:
                    out.append((t, common / len(ranks)))
        return out


def block_bounds(line_ends: list[int], block_words: int) -> list[tuple[int, int]]:
    """(start, end) of every block, in words: lines, or half-overlapping windows of long lines."""
    out, start, step = [], 0, block_words // 2
    for end in line_ends:
        if end - start <= block_words:
            out.append((start, end))
        else:
            out += [(a, min(a + block_words, end)) for a in range(start, end - step, step)]
        start = end
    return out


def blocks_around(places: list[int], bounds: list[tuple[int, int]]) -> list[int]:
    """The numbers of the blocks that hold one of the words."""
    starts = [a for a, _ in bounds]
    picked: set[int] = set()
    for p in places:
        k = bisect_right(starts, p) - 1
        while k >= 0 and (bounds[k][1] > p or bounds[k][0] == bounds[k][1]):  # a word lies in two windows at most
            picked.add(k)
            k -= 1
    return sorted(picked)


def scan(text: str | None, index: TemplateIndex, block_words: int) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks) of one text."""
    words: list[bytes] = []
    ends: list[int] = []
    for line in lines_of_words(text):
        words += line
        ends.append(len(words))
    outside = len(index.rank)
    get = index.rank.get
    ranks = np.fromiter((get(w, outside) for w in words), np.int64, len(words))
    if len(words) == 0 or not (ranks < outside).any():
        return len(words), 0, None, None, "", "", 0.0, 0
    places, base = [], set()
    for label, phrase in index.phrases:
        n = len(words) - len(phrase) + 1
        if n > 0:
            hit = np.ones(n, bool)
            for k, r in enumerate(phrase):
                hit &= ranks[k : n + k] == r
            if (found := np.flatnonzero(hit)).size:
                base.add(label)
                places.append(found)
    labels, score, n_blocks = set(base), 0.0, 0
    anchors = np.flatnonzero(index.in_prefix[ranks])
    if anchors.size:
        places_of = anchors.tolist()
        met: set[int] = set()
        bounds = block_bounds(ends, block_words)
        for k in blocks_around(places_of, bounds):
            if found := index.matches(ranks[slice(*bounds[k])]):
                n_blocks += 1
                met |= {t for t, _ in found}
                score = max(score, max(c for _, c in found))
        windows = block_bounds([len(words)], block_words)
        in_lines = frozenset(met)
        for k in blocks_around(places_of, windows):
            start, end = windows[k]
            if ends[bisect_right(ends, start)] < end and (found := index.matches(ranks[start:end])):
                n_blocks += any(t not in in_lines for t, _ in found)  # else the notice stands in a line, too
                met |= {t for t, _ in found}
                score = max(score, max(c for _, c in found))
        labels |= {index.templates[t][0] for t in met}
    first = min((int(p[0]) for p in places), default=None)
    last = max((int(p[-1]) for p in places), default=None)
    return len(words), sum(p.size for p in places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, n_blocks


def license_report(
    docs: DataFrame,
    templates=TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = 0.9,
    block_words: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: base phrase places, labels of phrases and templates, best containment.

    ``block_words`` must be at least twice the words of the longest template, so
    that a contiguous copy of a template always lies in one block, also when it is
    wrapped over several lines or has comment signs in front of them.
    """
    longest = max((sum(map(len, lines_of_words(text))) for _, text in templates), default=0)
    if block_words < 2 * longest:
        raise ValueError(f"block_words must be at least {2 * longest}")
    vocabulary = {w for _, text in templates for w in token_set(text)}
    index = TemplateIndex(templates, phrases, token_counts(docs, vocabulary, id_col, text_col), threshold)
    fields = [(n, LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    fields += [("base_labels", StringType()), ("labels", StringType()), ("score", DoubleType()), ("n_blocks", LongType())]
    return map_texts(docs, lambda: each(lambda text: scan(text, index, block_words)), fields, id_col, text_col)
