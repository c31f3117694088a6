"""Ranked lexical search: the best documents of the whole corpus for each item, by a document FP-tree.

1. Texts are read once.  A document keeps its number of terms and its vector
   restricted to the terms of the items: term numbers and how often each occurs.
2. The corpus figures come from those vectors: documents and terms in all, and the
   documents of each item term.
3. Terms are numbered anew by falling document frequency and each task builds
   FP-trees of its documents: a vector is a path from the root, most frequent term
   first, documents with the same beginning share it.  As sorted vectors put every
   subtree into one stretch of rows, a node is a stretch; single-child chains are
   one node, and neighbouring small subtrees share a leaf.  A node knows, for each
   of its children, the largest number of occurrences of every term below it, the
   least length part ``m`` and the smallest id.
4. An item is searched depth first: the score that the maxima and the least ``m``
   would give bounds every document below a child, since a score rises with the
   occurrences and falls with ``m``.  Children are entered from the highest bound
   down until none can beat the worst of the best found; in a leaf the children
   are the documents themselves and the bound is their score.  The best found are
   carried from tree to tree of a task.
5. The best of all tasks are ranked per item in two steps.

Scores are 64-bit integers: a term weighs ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``,
a document has ``m = 100 - b + b n N div L`` (b = 25), an occurrence of an item term
adds ``w ((10^9 tf) div (1000 tf + 12 m))``.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import sys
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from sessionlens.llm.common import id_and_text, map_texts, slices_of_bytes
from sessionlens.session import remove_written, written
from sessionlens.llm.decontam import item_blocks

#: Bytes of text that are Python objects at a time.
SLICE_BYTES = 4 << 20
#: Entries (document, term) of one tree: about 100 MB with the tree itself.
TREE_ENTRIES = 2_000_000
#: Subtrees of at most so many documents are leaves, whose documents are scored together.
LEAF_DOCS = 64
#: Parts of an item's candidates that are ranked separately before the last step.
RANK_PARTS = 16

#: A-Z become lower case, ASCII characters that are neither letter nor digit become blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


# --- vectors and corpus figures ---------------------------------------------


def restricted_vectors(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``n`` (terms of the text), ``terms`` and ``tfs`` (32-bit: places in ``terms``, occurrences)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        place = {t: k for k, t in enumerate(sent.value)}

        def vector(text):
            words = terms_of(text)
            found = [(place[t], tf) for t, tf in Counter(words).items() if t in place]
            both = np.array(found, np.int32).reshape(-1, 2)
            return len(words), both[:, 0].tobytes(), both[:, 1].tobytes()

        return lambda texts: list(map(vector, texts))

    fields = [("n", LongType()), ("terms", BinaryType()), ("tfs", BinaryType())]
    return map_texts(docs, make, fields, id_col, text_col, partial(slices_of_bytes, most=SLICE_BYTES))


def document_frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents of each term, summed up per task before the shuffle."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                df[np.frombuffer(data, np.int32)] += 1  # a vector holds a term once
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held], pa.int64())], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for row in vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row.term] = row.df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """The weight of each term, by its document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)


# --- tree -------------------------------------------------------------------


def most_per_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the largest value of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.maximum.reduceat(values, starts)


class Node:
    """A subtree: for each child (in a leaf: document) its terms with their most occurrences, its least m, its first id."""

    __slots__ = ("keys", "tfs", "m", "ids", "children")

    def __init__(self, term_lists: list, tf_lists: list, m: np.ndarray, ids: np.ndarray, children: list | None) -> None:
        n = len(m)
        owner = np.repeat(np.arange(n), [len(t) for t in term_lists])
        keys = np.concatenate([*term_lists, np.empty(0, np.int64)]).astype(np.int64) * n + owner
        order = np.argsort(keys, kind="stable")
        self.keys, self.tfs = keys[order], np.concatenate([*tf_lists, np.empty(0, np.int64)]).astype(np.int64)[order]
        self.m, self.ids, self.children = m, ids, children

    def summary(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Terms and their most occurrences below, the least m, the first id."""
        terms, tfs = most_per_key(self.keys // len(self.m), self.tfs)
        return terms, tfs, int(self.m.min()), int(self.ids.min())

    def scores(self, terms: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """The score of each child for an item of these terms (ascending) and factors (weight times repeats)."""
        n = len(self.m)
        low, high = np.searchsorted(self.keys, terms * n), np.searchsorted(self.keys, terms * n + n)
        sizes = high - low
        total = int(sizes.sum())
        out = np.zeros(n, np.int64)
        if total:
            at = np.arange(total) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
            child, tf = self.keys[at] % n, self.tfs[at]
            np.add.at(out, child, np.repeat(factors, sizes) * (1_000_000_000 * tf // (1000 * tf + 12 * self.m[child])))
        return out


class Tree:
    """FP-tree of documents: ``starts`` cuts ``terms`` (numbered by falling frequency, ascending per document) and ``tfs``."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, ids: np.ndarray, leaf_docs: int = LEAF_DOCS) -> None:
        wide = terms.astype(">i4").tobytes()
        edges = (starts * 4).tolist()
        paths = [wide[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.rows = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        self.starts, self.ends = starts[:-1][self.rows], starts[1:][self.rows]
        self.terms, self.tfs, self.m, self.ids, self.leaf_docs = terms, tfs, m[self.rows], ids[self.rows], leaf_docs
        self.root = self.grow(0, len(paths), 0)

    def leaf(self, low: int, high: int) -> Node:
        spans = list(zip(self.starts[low:high].tolist(), self.ends[low:high].tolist(), strict=True))
        return Node([self.terms[a:b] for a, b in spans], [self.tfs[a:b] for a, b in spans], self.m[low:high], self.ids[low:high], None)

    def fork(self, low: int, high: int, depth: int) -> tuple[int, np.ndarray]:
        """The first depth from ``depth`` at which the paths of the rows part, and the rows at which the next term changes.

        The rows are sorted: they agree as far as their first and last do.
        """
        first, last = self.terms[self.starts[low] + depth : self.ends[low]], self.terms[self.starts[high - 1] + depth : self.ends[high - 1]]
        both = min(len(first), len(last))
        parted = np.flatnonzero(first[:both] != last[:both])
        depth += int(parted[0]) if len(parted) else both
        at = self.starts[low:high] + depth
        inside = at < self.ends[low:high]
        following = np.where(inside, self.terms[np.where(inside, at, 0)] if len(self.terms) else -1, -1)
        return depth, low + np.flatnonzero(np.r_[True, following[1:] != following[:-1]])

    def grow(self, low: int, high: int, depth: int) -> Node:
        if high - low <= self.leaf_docs:
            return self.leaf(low, high)
        depth, cuts = self.fork(low, high, depth)
        if len(cuts) == 1:  # the same path for all
            return self.leaf(low, high)
        edges = [*cuts.tolist(), high]
        bundles, start = [], low
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # neighbours share a leaf while they fit into it
            if start < a and b - start > self.leaf_docs:
                bundles.append((start, a))
                start = a
        bundles.append((start, high))
        children = [self.grow(a, b, depth) for a, b in bundles]
        below = [c.summary() for c in children]
        m, ids = (np.array([s[k] for s in below], np.int64) for k in (2, 3))
        return Node([s[0] for s in below], [s[1] for s in below], m, ids, children)


class Best:
    """The ``most`` best documents of an item: highest score first, then smallest id, ids that are null last."""

    __slots__ = ("most", "heap")

    def __init__(self, most: int) -> None:
        self.most, self.heap = most, []

    def takes(self, score: int, first: int) -> bool:
        """Whether a document of this score and id would be among the best."""
        return score > 0 and (len(self.heap) < self.most or (score, -first) > self.heap[0])

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.heap[0][0] if len(self.heap) == self.most else 1
        held = np.flatnonzero(scores >= max(1, least))
        for k in held[np.lexsort((ids[held], -scores[held]))][: self.most].tolist():
            own = int(scores[k]), -int(ids[k])
            if len(self.heap) < self.most:
                heapq.heappush(self.heap, own)
            elif own > self.heap[0]:
                heapq.heapreplace(self.heap, own)


def search(node: Node, terms: np.ndarray, factors: np.ndarray, best: Best) -> int:
    """Put the best documents below the node into ``best``; returns the number of nodes entered."""
    entered, open_nodes = 0, [(sys.maxsize, 0, node)]
    while open_nodes:
        bound, first, node = open_nodes.pop()
        if not best.takes(bound, first):
            continue
        entered += 1
        scores = node.scores(terms, factors)
        if node.children is None:
            best.offer(scores, node.ids)
        else:  # the highest bound on top
            for k in np.lexsort((-node.ids, scores)).tolist():
                if scores[k] > 0:
                    open_nodes.append((int(scores[k]), int(node.ids[k]), node.children[k]))
    return entered


# --- search -----------------------------------------------------------------


def item_vectors(texts: list[str], place: dict[bytes, int], factor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per item its terms that a document holds (ascending numbers) and weight times repeats of each."""
    out = []
    for text in texts:
        found = sorted((place[t], k) for t, k in Counter(terms_of(text)).items() if t in place)
        both = np.array(found, np.int64).reshape(-1, 2)
        out.append((both[:, 0], both[:, 1] * factor[both[:, 0]]))
    return out


def best_of_tasks(vectors: DataFrame, items: list, number: np.ndarray, per_doc: tuple[int, int, int], most: int, tree_entries: int, leaf_docs: int) -> DataFrame:
    """The best documents per item of each task: item (place in ``items``), doc_id, score."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, number))
    n_docs, n_all, b = per_doc
    schema = StructType([StructField("item", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])

    def run(batches):
        asked, renumber = sent.value
        best = [Best(most) for _ in asked]
        for ids, n, starts, terms, tfs in gathered(batches, tree_entries):
            sizes = np.diff(starts)
            terms = renumber[terms]
            order = np.lexsort((terms, np.repeat(np.arange(len(sizes)), sizes)))
            m = 100 - b + (b * n * n_docs) // n_all
            root = Tree(starts, terms[order], tfs[order], m, ids, leaf_docs).root
            for (own, factors), found in zip(asked, best, strict=True):
                search(root, own, factors, found)
        rows = [(k, None if -i == NO_ID else -i, s) for k, found in enumerate(best) for s, i in found.heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents with a term in runs of about ``most`` entries: ids, n, starts, terms, tfs."""
    held, entries = [], 0

    def run():
        ids, n, terms, tfs = (list(c) for c in zip(*held, strict=True))
        sizes = np.array([len(t) for t in terms], np.int64) // 4
        values = (np.frombuffer(b"".join(c), np.int32).astype(np.int64) for c in (terms, tfs))
        return np.array(ids, np.int64), np.array(n, np.int64), np.r_[0, np.cumsum(sizes)], *values

    for batch in batches:
        ids, n, terms, tfs = (batch.column(k).to_pylist() for k in range(4))
        for row in zip(ids, n, terms, tfs, strict=True):
            if row[2]:
                held.append((NO_ID if row[0] is None else row[0], *row[1:]))
                entries += len(row[2]) // 4
                if entries >= most:
                    yield run()
                    held, entries = [], 0
    if held:
        yield run()


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    most: int = 20,
    b: int = 25,
    block_chars: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    tree_entries: int = TREE_ENTRIES,
    leaf_docs: int = LEAF_DOCS,
) -> DataFrame:
    """The ``most`` best documents of each item: item_id, rank (from 1), doc_id, score (above 0).

    ``doc_id`` is an integer; equal scores rank by ascending doc_id, null ids last;
    rows of one id and text rank each for itself.  ``b`` is the length part in
    hundredths.  Repeated rows of one item (id and text) are one item; one id with
    several texts is an item for each, ranked separately.  Items that are null,
    empty or without a term of any document, and documents without a term, have
    no rows; an empty table on either side gives an empty result.  Other columns
    are not read, whatever their names.

    Items go to the tasks in blocks of about ``block_chars`` characters (two
    million: about 15 MB with the terms), one block at a time; texts are read once
    per block.  A task holds one tree of about ``tree_entries`` entries and, per
    item, the best documents found.
    """
    src = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = items.select(F.col(item_id).alias("item_id")).schema["item_id"]
    spark, found = docs.sparkSession, []
    n_blocks, blocks = item_blocks(items, item_id, item_text, block_chars)
    for block in blocks:
        terms = sorted({t for _, text in block for t in terms_of(text)})
        vectors = written(restricted_vectors(src, terms).filter("n > 0"), "restricted-vectors")
        n_docs, n_all = vectors.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(vectors, len(terms))
        order = np.argsort(-df, kind="stable")  # by falling frequency, then by term
        number = np.empty(len(terms), np.int64)
        number[order] = np.arange(len(terms))
        place = {t: int(number[k]) for k, t in enumerate(terms) if df[k]}
        asked = item_vectors([text for _, text in block], place, weights(df[order], n_docs))
        best = best_of_tasks(vectors.select("doc_id", "n", "terms", "tfs"), asked, number, (n_docs, n_all, b), most, tree_entries, leaf_docs)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], StructType([StructField("item", IntegerType()), ids]))
        ranked = ranks(best, most)
        if n_blocks > 1:
            ranked = written(ranked, "ranked")
            remove_written(vectors)
        found.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, found)


def ranks(best: DataFrame, most: int) -> DataFrame:
    """The ``most`` first documents of each item: those of each of some parts, then those of all."""
    first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    place = F.row_number().over(Window.partitionBy("item", "part").orderBy(*first))
    parts = best.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(RANK_PARTS))).withColumn("place", place).filter(F.col("place") <= most)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*first))).filter(F.col("rank") <= most)
