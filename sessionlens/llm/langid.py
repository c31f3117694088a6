"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, cut into words of letters, and each word (with a space
on either side) gives its byte 2-, 3- and 4-grams, hashed into ``buckets``
embedding rows.  The mean of the rows goes through a linear softmax.  Embeddings
and softmax are trained together by stochastic gradient descent in numpy on a
bounded sample; a part of the sample that training does not see sets the
temperature of the softmax and the probability below which a prediction is not
``accepted``.  Prediction uses the product of embeddings and softmax weights
(one row of class scores per bucket), which is the same linear map.

Limits: ``max_rows`` labelled rows, as many of each language, those with the
smallest hashes of id and text (of texts of more than ``max_chars`` characters a
stretch of that length); prediction covers all
rows and whole texts in one pass without a shuffle.  Null texts and texts
without a letter give ``und`` with score 0.  Without labelled rows every text
gives ``und``.  Equal scores fall to the first language in sorted order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from sessionlens.llm.common import each, map_texts

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

#: ASCII bytes that are not letters become spaces.
_LETTER_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


@dataclass(frozen=True)
class LanguageSettings:
    buckets: int = 1 << 16
    dim: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    max_rows: int = 2500
    max_chars: int = 50_000
    max_languages: int = 1000
    segment_bytes: int = 300
    epochs: int = 3
    rate: float = 1.0
    batch: int = 32
    calibration_share: float = 0.2
    target_precision: float = 0.99
    seed: int = 7


def subword_ids(text: str, settings: LanguageSettings) -> np.ndarray:
    """Bucket of every subword of the text."""
    words = text.lower().encode().translate(_LETTER_BYTES).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    blank = data == 32
    shift = np.uint32(33 - settings.buckets.bit_length())
    out = []
    for n in settings.grams:
        size = len(data) - n + 1
        if size <= 0:
            continue
        mixed = np.full(size, n, np.uint32)
        inner = np.zeros(size, bool)
        for k in range(n):
            mixed = (mixed ^ data[k : size + k]) * np.uint32(0x01000193)
            if 0 < k < n - 1:
                inner |= blank[k : size + k]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x9E3779B1)
        out.append((mixed >> shift)[~inner])
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def segments(text: str, size: int) -> list[str]:
    """The text in pieces of about ``size`` characters, cut at blanks."""
    words, out, length = [], [], 0
    for w in text.split():
        words.append(w)
        length += len(w) + 1
        if length >= size:
            out.append(" ".join(words))
            words, length = [], 0
    return out + ([" ".join(words)] if words else [])


@dataclass
class LanguageModel:
    settings: LanguageSettings
    languages: list[str]
    scores: np.ndarray = field(repr=False)  # (buckets, languages): embeddings times softmax weights
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        ids = subword_ids(text, self.settings)
        return self.bias + (self.scores.take(ids, axis=0).mean(axis=0, dtype=np.float64) if ids.size else 0.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, accepted)."""
        if text is None or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, False
        p = softmax(self.logits(text)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Fit on (text, language) rows; every fifth row (by ``calibration_share``) calibrates."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(settings.seed)
    model = LanguageModel(settings, languages, np.zeros((settings.buckets, len(languages)), np.float32), np.zeros(len(languages)))
    if not languages:
        return model
    every = max(2, round(1 / settings.calibration_share))
    fit, held = [], []
    for k, (text, lang) in enumerate(rows):
        y = languages.index(lang)
        part = held if k % every == every - 1 else fit
        part += [(ids, y) for s in segments(text, settings.segment_bytes) if (ids := subword_ids(s, settings)).size]
    embed = rng.uniform(-1 / settings.dim, 1 / settings.dim, (settings.buckets, settings.dim)).astype(np.float32)
    weight = np.zeros((settings.dim, len(languages)), np.float32)
    steps = max(1, settings.epochs * (-(-len(fit) // settings.batch)))
    step = 0
    for _ in range(settings.epochs if fit else 0):
        order = rng.permutation(len(fit))
        for s in range(0, len(fit), settings.batch):
            chosen = [fit[i] for i in order[s : s + settings.batch]]
            rate = np.float32(settings.rate * (1 - step / steps))
            step += 1
            sizes = np.array([len(ids) for ids, _ in chosen])
            ids = np.concatenate([ids for ids, _ in chosen])
            y = np.array([y for _, y in chosen])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            mean = np.add.reduceat(embed[ids], starts) / sizes[:, None]
            delta = softmax(mean @ weight)
            delta[np.arange(len(y)), y] -= 1
            back = (delta @ weight.T) / sizes[:, None]
            weight -= rate * (mean.T @ delta).astype(np.float32)
            place, first = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(place), settings.dim))
            spread = np.repeat(back, sizes, axis=0)
            for d in range(settings.dim):
                grad[:, d] = np.bincount(first, spread[:, d], len(place))
            embed[place] -= (rate * grad * 8).astype(np.float32)
    model.scores = (embed @ weight).astype(np.float32)
    return calibrate(model, held)


def calibrate(model: LanguageModel, held: list[tuple[np.ndarray, int]]) -> LanguageModel:
    """Temperature of least log loss, and the least probability at which precision holds from there on."""
    if not held:
        return model
    z = np.array([model.scores.take(ids, axis=0).mean(axis=0, dtype=np.float64) + model.bias for ids, _ in held])
    y = np.array([y for _, y in held])
    rows = np.arange(len(y))
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[rows, y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    p = softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precision >= model.settings.target_precision)
    model.threshold = float(top[order][good[-1]]) if good.size else 1.0
    return model


def labelled_sample(
    docs: DataFrame, usable: Column, settings: LanguageSettings, id_col: str, text_col: str, lang_col: str
) -> list[tuple[str, str]]:
    """At most ``max_rows`` (text, language) rows, as many of each language: the usable ones with the smallest hashes.

    Usable rows with the same id and text count once.  Rows are told apart by the hash
    of their id, then of their text, so repeated or null ids and any order or
    partitioning of the table give the same sample.  Of a text of more than
    ``max_chars`` characters a stretch of that length, at a place that its hash
    gives, is taken.
    """
    text = F.col(text_col).cast("string")
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & text.isNotNull()).select(
        F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(id_col)).alias("h"), F.xxhash64(text).alias("th"), text.alias("t")
    )
    languages = rows.select("l").distinct().limit(settings.max_languages + 1).collect()
    if len(languages) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages among the labelled rows")
    if not languages:
        return []
    most = max(1, settings.max_rows // len(languages))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h", "th"))
    first = rows.select("l", "h", "th").distinct().withColumn("place", place).filter(F.col("place") <= most)
    last = first.groupBy("l").agg(F.max(F.struct("h", "th")).alias("last"))  # one row per language
    stretch = F.substring("t", F.pmod("th", F.greatest(F.length("t") - settings.max_chars, F.lit(0)) + 1).cast("int") + 1, F.lit(settings.max_chars))
    chosen = rows.join(F.broadcast(last), "l").filter(F.struct("h", "th") <= F.col("last"))
    got = chosen.dropDuplicates(["l", "h", "th"]).select("l", "h", "th", F.when(F.length("t") > settings.max_chars, stretch).otherwise(F.col("t")).alias("t")).collect()
    return [(r.t, r.l) for r in sorted(got, key=lambda r: (r.h, r.th, r.l))]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``lang_pred``, ``score`` and ``accepted``."""
    fields = [("lang_pred", StringType()), ("score", DoubleType()), ("accepted", BooleanType())]
    return map_texts(docs, lambda: each(model.predict), fields, id_col, text_col)


def learn(
    docs: DataFrame,
    usable: Column | None = None,
    settings: LanguageSettings = LanguageSettings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """A model trained on the rows of ``docs`` for which ``usable`` holds."""
    usable = F.lit(True) if usable is None else usable
    return train(labelled_sample(docs, usable, settings, id_col, text_col, lang_col), settings)
