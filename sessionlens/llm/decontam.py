"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are taken as lower-case words.  An item of m words has an
error budget of k = floor(``error_rate`` * m) word edits (a word inserted,
deleted or replaced) and is split into k + 1 pieces: whatever k edits hit, one
piece stays whole.  An Aho-Corasick automaton over all pieces finds their exact
hits in a text; around each hit, the stretch where the item can lie is verified
with Myers' bit-parallel edit distance (the words are the symbols, the item any
place in the stretch).  Overlapping stretches of one item are verified once.

Items are read in blocks of about ``block_chars`` characters; the documents are
scanned once for each block (normally one), so a task holds one block's
automaton and one slice of texts, and the driver one block at a time: beyond one
block, what a block finds is written to the shared folder before the next is
read.  There is no shuffle of documents.

Words are runs of word characters; in scripts that write no blanks between words
(Chinese, Japanese, Thai, Lao, Burmese, Khmer) each character is a word.  In items
of fewer than ``min_words`` words an edit leaves too little to tell a copy from
ordinary speech: with ``short_items`` they are found where all their words stand
consecutively, those of fewer than ``ALONE_BELOW`` words only where they stand by
themselves, between ends of sentences, lines, quotations or brackets; without it
they match nothing.  Null items and items without a word match nothing; null and
empty texts match nothing.  Repeated items count as one each under their item_id;
repeated rows are matched row by row.  Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sessionlens.llm.common import id_and_text, kept_by_worker, slices
from sessionlens.session import written

#: Characters of scripts without blanks between words: Han, kana, Thai, Lao, Burmese, Khmer.
UNSPACED = (
    "\u3005\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\u3041-\u3096\u3099\u309a\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff"
    "\u31f0-\u31ff\uff66-\uff9f\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ecd\u0edc-\u0edf\u1000-\u103f\u1050-\u109f\u1780-\u17d3"
)
WORD = re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")

#: Short items of fewer words must stand by themselves.
ALONE_BELOW = 5
#: Between two words: the end of a sentence, line, quotation or bracket.
BREAK = re.compile(r"""[\n\r\t|()\[\]{}<>"\u201c\u201d\u201e\xab\xbb\u2026\u3002\uff01\uff1f\uff1a\uff1b\u300c\u300d]|[.!?:;]+[\s'\u2019*_]""")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pieces(words: list, budget: int) -> list[tuple[int, list]]:
    """(place, words) of budget + 1 runs of about equal length."""
    cuts = [len(words) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list, text: list) -> list[int]:
    """Per place of the text, the least edit distance of the pattern to a stretch that ends there (Myers 1999)."""
    m = len(pattern)
    places: dict = {}
    for k, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for w in text:
        eq = places.get(w, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        out.append(score)
    return out


def best_match(pattern: list, text: list) -> tuple[int, int, int]:
    """(distance, start, end) of the closest stretch; among equals the first end, then the longest stretch."""
    scores = myers(pattern, text)
    d = min(scores)
    end = scores.index(d) + 1
    back = myers(pattern[::-1], text[:end][::-1])
    lengths = [k + 1 for k, s in enumerate(back) if s == d]
    return d, end - max(x for x in lengths if x <= len(pattern) + d), end


class Breaks:
    """Where a run of words of a text stands by itself."""

    def __init__(self, text: str) -> None:
        self.text = text.lower()
        self.spans = [m.span() for m in WORD.finditer(self.text)]

    def between(self, k: int) -> bool:
        """Whether a sentence, line, quotation or bracket ends before word ``k``."""
        return k in (0, len(self.spans)) or bool(BREAK.search(self.text[self.spans[k - 1][1] : self.spans[k][0]]))

    def alone(self, first: int, end: int) -> bool:
        return self.between(first) and self.between(end)


class ItemIndex:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], error_rate: float, min_words: int = 0) -> None:
        """``items``: (number, words); those of fewer than ``min_words`` words are found as whole copies only."""
        self.items = dict(items)
        self.short = {n for n, words in items if len(words) < min_words}
        self.budget = {n: 0 if n in self.short else int(error_rate * len(words) + 1e-9) for n, words in items}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, words in items:
            for place, run in pieces(words, self.budget[n]):
                found.setdefault(" " + " ".join(run) + " ", []).append((n, place))
        self.automaton = ahocorasick.Automaton()
        for text, owners in found.items():
            self.automaton.add_word(text, (len(text), owners))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item number, distance, first word, end word) of the items found, the closest place of each."""
        if self.empty or not text:
            return []
        line = " " + " ".join(words_of(text)) + " "
        hits = [(last + 1 - size, owners) for last, (size, owners) in self.automaton.iter(line)]
        if not hits:
            return []
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)  # the blank before each word
        words = line.split()
        at = np.searchsorted(blanks, [start for start, _ in hits])
        stretches: dict[int, list[list[int]]] = {}
        copies: dict[int, tuple[int, int]] = {}
        breaks = None
        for word, (_, owners) in zip(at.tolist(), hits, strict=True):
            for n, place in owners:
                if n in self.short:
                    if n not in copies:
                        end = word + len(self.items[n])
                        if len(self.items[n]) < ALONE_BELOW:
                            breaks = breaks or Breaks(text)
                        if len(self.items[n]) >= ALONE_BELOW or breaks.alone(word, end):
                            copies[n] = word, end
                    continue
                k = self.budget[n]
                low, high = max(0, word - place - k), min(len(words), word - place + len(self.items[n]) + k)
                own = stretches.setdefault(n, [])
                own.append([low, high])
        out = [(n, 0, a, b) for n, (a, b) in copies.items()]
        for n, own in stretches.items():
            own.sort()
            merged: list[list[int]] = []
            for low, high in own:
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            found = [(d, low + a, low + b) for low, high in merged for d, a, b in [best_match(self.items[n], words[low:high])]]
            d, a, b = min(found)
            if d <= self.budget[n]:
                out.append((n, d, a, b))
        return out


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> tuple[int, Iterator[list[tuple]]]:
    """The items in blocks of about ``block_chars`` characters: how many, and one block of (item_id, text) after the other."""
    src = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    total = src.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))  # copies of a text under many ids spread, too

    def blocks():
        for k in range(n):
            rows = (src.filter(block == k) if n > 1 else src).distinct().toLocalIterator()
            yield sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0], r[1]))

    return n, blocks()


def searched(block: list[tuple], min_words: int, short_items: bool) -> list[tuple[int, list[str]]]:
    """(number, words) of the items of a block that are searched."""
    return [(n, w) for n, (_, text) in enumerate(block) if len(w := words_of(text)) >= (1 if short_items else min_words)]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    error_rate: float = 0.2,
    min_words: int = 8,
    block_chars: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    short_items: bool = False,
) -> DataFrame:
    """One row per document row and item found in it: distance, item words, first and end word, score."""
    src = id_and_text(docs, id_col, text_col)
    ids = items.select(F.col(item_id).alias("item_id")).schema["item_id"]
    numbers = [StructField(n, IntegerType()) for n in ("distance", "item_words", "first_word", "end_word")]
    schema = StructType([src.schema["doc_id"], ids, *numbers, StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema).types
    found = []
    n_blocks, blocks = item_blocks(items, item_id, item_text, block_chars)
    for block in blocks:
        words = searched(block, min_words, short_items)
        sent = docs.sparkSession.sparkContext.broadcast((words, [i for i, _ in block], error_rate, min_words))
        key = "items " + hashlib.sha256(repr((words, error_rate, min_words)).encode()).hexdigest()

        def run(batches, sent=sent, key=key):
            words, names, rate, least = sent.value
            index = kept_by_worker(key, lambda: ItemIndex(words, rate, least))
            for part in slices(batches):
                rows = [
                    (doc, names[n], d, len(index.items[n]), a, b, 1 - d / len(index.items[n]))
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    for n, d, a, b in index.matches(text)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=schema.names)

        rows = src.mapInArrow(run, schema)
        if n_blocks > 1:  # one block at a time in the memory of driver and workers
            rows = written(rows, "found-items")
            sent.destroy()
        found.append(rows)
    return reduce(DataFrame.union, found)


def without_contaminated(
    docs: DataFrame, items: DataFrame, error_rate: float = 0.2, min_words: int = 8, block_chars: int = 2_000_000, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", short_items: bool = False,
) -> DataFrame:
    """The rows of ``docs`` (all columns) in whose text no item is found.

    Beyond one block of items the rows are numbered and written, each block writes
    the numbers of the rows it is found in, and an anti join takes these out.
    """
    n_blocks, blocks = item_blocks(items, item_id, item_text, block_chars)
    if n_blocks > 1:
        number = "row_number"
        while number in docs.columns:
            number += "_"
        numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-documents")
        found = contaminated(numbered, items, error_rate, min_words, block_chars, number, text_col, item_id, item_text, short_items)
        found = found.select(F.col("doc_id").alias(number)).distinct()
        return numbered.join(found, number, "left_anti").select(*docs.columns)
    at = docs.columns.index(text_col)
    words = searched(next(blocks), min_words, short_items)
    sent = docs.sparkSession.sparkContext.broadcast((words, error_rate, min_words))
    key = "items " + hashlib.sha256(repr((words, error_rate, min_words)).encode()).hexdigest()

    def run(batches):
        index = kept_by_worker(key, lambda: ItemIndex(*sent.value))
        for part in slices(batches):
            yield part.filter(pa.array([not index.matches(t) for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
