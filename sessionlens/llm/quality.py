"""Quality rules by compression bands.

Text that repeats itself compresses far better than prose, random or encoded
text far worse.  Each document is compressed as a whole and in fixed chunks with
zstandard; it fails when the ratio (raw bytes / compressed bytes) of the whole
leaves the band for its length, or when more than a set share of its chunks
leaves the chunk band.  Short texts compress worse than long ones of the same
kind, so the bands depend on the length.  Word counts, symbol counts, repeated
lines and repeated 8-word windows are measured beside it.

The default bands hold for text in general.  ``fitted_rules`` narrows them to what
reference texts show: for texts of each half octave of bytes the ratios are fenced
at ``fence`` quartile distances beyond the quartiles (3: the usual outer fence).
Texts of equal length and ratio count once, and the quartile distance is at least
the middle one of all classes, so that a group of copies does not narrow its class.
The reference should hold every language of the corpus; lengths with too few
reference texts keep the general bands.

Judging is one pass, no shuffle; a task holds one slice of texts.  Fitting measures
every text once more; ids and measures meet in a join (shuffled where the ids are too
many to broadcast, four numbers a row) and three quartiles per class (about 60
classes) go to the driver.  Null and empty texts
have no words and are rejected (fewer than ``min_words``).  Repeated rows and
ids are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import floor, inf, log2
from statistics import median

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType

from sessionlens.llm.common import each, map_texts, slices

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class CompressionBands:
    """Limits of the compression ratio.

    ``by_length``: (bytes below, least ratio, largest ratio) in ascending order.
    ``chunk``: least and largest ratio of a chunk of ``chunk_bytes`` bytes; a last
    piece under half a chunk is not judged.  ``chunk_share``: share of a
    document's chunks that may lie outside.  Random printable ASCII compresses by
    about 1.2 and base 64 by 1.33, prose of a kilobyte by 1.6 and more.
    """

    level: int = 3
    by_length: tuple[tuple[float, float, float], ...] = (
        (256, 0.0, 2.5),
        (1024, 1.05, 3.0),
        (4096, 1.35, 3.5),
        (65536, 1.40, 4.0),
        (inf, 1.40, 5.0),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.35, 3.5)
    chunk_share: float = 0.25


@dataclass(frozen=True)
class QualityRules:
    bands: CompressionBands = CompressionBands()
    min_words: int = 20
    window_words: int = 8
    max_repeat_percent: int = 30


def repeated_words(words: list[bytes], width: int) -> int:
    """Words that lie in a window of ``width`` words found at least twice in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    if np.unique(mixed).size == n:
        return 0  # equal windows have equal hashes, so none repeats
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    size = 1
    while size < width:  # ids of windows of `size` words from those of their two halves
        step = min(size, width - size)
        ids = np.unique(ids[:-step] * len(words) + ids[step:], return_inverse=True)[1]
        size += step
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def ratio(compressor: zstandard.ZstdCompressor, data: bytes) -> float:
    """Raw over compressed bytes, without the four magic bytes of the frame."""
    return len(data) / (len(compressor.compress(data)) - 4) if data else 0.0


def base_failed(n_words: int, n_repeat_words: int, rules: QualityRules) -> bool:
    return n_words < rules.min_words or 100 * n_repeat_words > rules.max_repeat_percent * n_words


def judge(text: str | None, rules: QualityRules, compressor: zstandard.ZstdCompressor) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, share of chunks
    outside, base_failed, kept) of one text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    n_repeat = repeated_words(words, rules.window_words)
    bands = rules.bands
    whole = ratio(compressor, data)
    least, most = next((a, b) for below, a, b in bands.by_length if len(data) < below)
    size = bands.chunk_bytes
    pieces = [data[k : k + size] for k in range(0, len(data), size)]
    judged = [ratio(compressor, p) for p in pieces if 2 * len(p) >= size]
    outside = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in judged)
    share = outside / len(judged) if judged else 0.0
    failed = base_failed(n_words, n_repeat, rules)
    kept = not failed and least <= whole <= most and share <= bands.chunk_share
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, whole, share, failed, kept


def length_class(n_bytes: int) -> int:
    """The half octave of a length: 2 ** (k / 2) bytes and more, less than 2 ** ((k + 1) / 2)."""
    return floor(2 * log2(n_bytes))


def narrowed(bands: CompressionBands, quartiles: dict[int, tuple[float, float, float]], fence: float) -> CompressionBands:
    """``bands`` with the limits of each class of ``quartiles`` moved in to its fences."""
    if not quartiles:
        return bands
    usual = median((c - a) / b for a, b, c in quartiles.values())
    edges = {2.0 ** (k / 2) for c in quartiles for k in (c, c + 1)}
    below = sorted(edges | {b for b, _, _ in bands.by_length})
    out, start = [], 0.0
    for end in below:
        least, most = next((a, b) for limit, a, b in bands.by_length if start < limit)
        own = next((q for c, q in quartiles.items() if 2.0 ** (c / 2) <= start < 2.0 ** ((c + 1) / 2)), None)
        if own:
            reach = fence * max(own[2] - own[0], usual * own[1])
            least, most = max(least, own[0] - reach), min(most, own[2] + reach)
        out.append((end, least, most))
        start = end
    return replace(bands, by_length=tuple(out))


def fitted_rules(
    docs: DataFrame,
    reference: DataFrame,
    rules: QualityRules = QualityRules(),
    fence: float = 3.0,
    min_texts: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityRules:
    """``rules`` with bands narrowed to the reference texts.

    ``reference``: ids of good texts in a column ``doc_id``; every one of them counts.
    Texts that the base rules reject are left out; a class of fewer than
    ``min_texts`` texts keeps its limits.
    """
    ids = reference.select("doc_id").filter("doc_id is not null").distinct()

    def make():
        compressor = zstandard.ZstdCompressor(level=rules.bands.level, write_content_size=False)

        def row(text):
            data = (text or "").encode()
            words = data.split()
            good = not base_failed(len(words), repeated_words(words, rules.window_words), rules)
            return (length_class(len(data)), len(data), round(ratio(compressor, data), 4)) if good and data else (None, None, None)

        return each(row)

    # the measures meet the ids, so that no text is shuffled where the ids are too many to broadcast
    found = map_texts(docs, make, [("class", LongType()), ("n_bytes", LongType()), ("ratio", DoubleType())], id_col, text_col)
    found = found.filter("class is not null").join(ids, "doc_id", "left_semi").select("class", "n_bytes", "ratio").distinct()
    per_class = found.groupBy("class").agg(F.count("*").alias("n"), F.percentile("ratio", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    quartiles = {r["class"]: tuple(r.q) for r in per_class.filter(F.col("n") >= min_texts).collect()}
    return replace(rules, bands=narrowed(rules.bands, quartiles, fence))


def _judge_all(rules: QualityRules):
    def make():
        compressor = zstandard.ZstdCompressor(level=rules.bands.level, write_content_size=False)
        return lambda text: judge(text, rules, compressor)

    return make


def quality_report(
    docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document with its measures, ``base_failed`` and ``kept``."""
    fields = [(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [("ratio", DoubleType()), ("chunks_outside", DoubleType())]
    fields += [("base_failed", BooleanType()), ("kept", BooleanType())]
    make = _judge_all(rules)
    return map_texts(docs, lambda: each(make()), fields, id_col, text_col)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that pass the rules."""
    at = docs.columns.index(text_col)
    make = _judge_all(rules)

    def run(batches):
        row = make()
        for part in slices(batches):
            yield part.filter(pa.array([row(t)[-1] for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
