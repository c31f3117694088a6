"""Whitening, ranked search and token counts against numpy, brute force and the libraries."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionlens.llm import lexical, queries, token_counts, whitening

from .conftest import EDGE_ROWS, SF

# --- embedding whitening ----------------------------------------------------


def whitened_by_numpy(rows, components=4):
    """(id, x) of the usable rows, n, deviations, whitened rows and explained parts."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in good)
    d = max(sizes, key=lambda s: (sizes[s], s))
    good = [(i, v) for i, v in good if len(v) == d]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in good], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = [k for k in np.argsort(-values)[:components] if values[k] > 1e-12 * values.max()]
    return [i for i, _ in good], n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def assert_whitened(got, rows):
    ids, n, deviations, want, explained = whitened_by_numpy(rows)
    by_id = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by_id) == want.size
    for k in range(want.shape[1]):
        own = np.array([by_id[i, k + 1].whitened for i in ids])
        top = np.abs(want[:, k]).argmax()
        assert np.allclose(own * np.sign(own[top] * want[top, k]), want[:, k], atol=1e-9)
    for place, i in enumerate(ids):
        for k, part in enumerate(explained):
            r = by_id[i, k + 1]
            assert (r.n, r.deviation) == (n, deviations[place]) and abs(r.explained - part) < 1e-9 and r.identity_error < 1e-9


def test_whitening_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert_whitened(whitening.whiten(table).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


@pytest.mark.parametrize("doubles", [1 << 20, 30])
def test_whitening_of_broken_repeated_and_uneven_vectors(spark, monkeypatch, doubles):
    monkeypatch.setattr(whitening, "BLOCK_DOUBLES", doubles)  # 30: blocks of five rows
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    rows = [(k, base[k % 40].tolist()) for k in range(70)] + [(100 + k, base[0].tolist()) for k in range(90)]
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, [1.0, 2.0]), (205, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("other")).withColumn("row", F.lit(1)).repartition(7)
    assert_whitened(whitening.whiten(frame).collect(), rows)


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(None, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, abs(round(r.whitened, 9)), round(r.explained, 9)) for r in line) == [(0, 1, 2, 1.0, 1.0), (7, 1, 2, 1.0, 1.0), (7, 1, 2, 1.0, 1.0)]


# --- ranked search ----------------------------------------------------------


def ranked_by_brute_force(docs, items, most=20):
    held = [(i, Counter(w), len(w)) for i, w in ((i, lexical.terms_of(t)) for i, t in docs) if w]
    df = Counter(t for _, c, _ in held for t in c)
    n_docs, n_all = len(held), sum(n for _, _, n in held)
    out = []
    for item, text in {(i, t) for i, t in items if t}:
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in lexical.terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"tree_entries": 60, "leaf_docs": 3}, {"tree_entries": 300, "leaf_docs": 1, "block_chars": 200}])
def test_search_equals_brute_force(spark, sizes):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)] + ["Été", "日本", "x9"]
    odds = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, odds, k=rng.randint(0, 25))).title()) for k in range(160)]
    docs += [(500 + k, docs[7][1]) for k in range(40)] + [(None, docs[7][1]), (None, docs[9][1]), (3, docs[9][1]), (3, docs[9][1]), (901, None), (902, " .,;\n")]
    docs.append((903, "w0 " * 5000 + "w29"))
    items = [(k, ", ".join(rng.choices(words, odds, k=rng.randint(1, 12)))) for k in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere at all"), items[0], (items[1][0], "w0 w0 w29")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("other")).withColumn("item_id", F.lit("other")).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("other"))
    got = lexical.ranked_search(frame, asked, **sizes).collect()
    assert sorted(map(tuple, got), key=str) == ranked_by_brute_force(docs, items)


def test_search_of_table_equals_brute_force(spark, texts):
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = queries.op12_ranked_search(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == ranked_by_brute_force(list(texts.items()), [tuple(r) for r in asked])


def test_search_passes_by_subtrees_that_cannot_win():
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 400, 30)) for _ in range(2000)]
    starts = np.r_[0, np.cumsum([len(d) for d in docs])]
    terms = np.concatenate(docs)
    tree = lexical.Tree(starts, terms, np.ones_like(terms), np.full(2000, 100), np.arange(2000), 16)

    def size(node):
        return 1 + sum(map(size, node.children or ()))

    asked = np.array([3, 50, 399])
    best = lexical.Best(5)
    entered = lexical.search(tree.root, asked, np.array([5, 900, 70_000]), best)
    factors = dict(zip(asked.tolist(), [5, 900, 70_000], strict=True))
    want = sorted(((-sum(factors[t] * (10**9 // 2200) for t in d.tolist() if t in factors), k) for k, d in enumerate(docs)))[:5]
    assert sorted((-s, -i) for s, i in best.heap) == want
    assert entered < size(tree.root) / 2


def test_search_in_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.filter("false"), items), (docs, items.filter("false")), (docs.withColumn("text", F.lit(None)), items)):
        got = lexical.ranked_search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


# --- token counts -----------------------------------------------------------

SIGNS = [*"abcXYZ019 \n\t.,'!<|>éİßçÅÑσΣﬁ", "́", "̈", "　", "가", "가", "。", "あ", "中", "😀", "\x1c", "\x85", "<|startoftext|>", "<|endoftext|>", "'s", "'LL", " ", " ", " "]


def library_count(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_cut_texts_equal_library(name):
    data = token_counts.read_tokenizer_file(public_tokenizers.path(name))
    make = token_counts.TokenCounter.of_model if name.endswith(".model") else token_counts.TokenCounter.of_tokenizer
    counter, want, rng = make(data, batch_bytes=64, piece=5), library_count(name), random.Random(4)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 60))) for _ in range(4000)]
    assert counter.counts(texts) == [want(t) for t in texts]
    assert (counter.boundary is None) == name.endswith(".model")


def test_a_word_met_again_is_not_counted_again():
    asked, counted = [], lambda batch: [asked.append(p) or len(p) for p in batch]
    counter = token_counts.TokenCounter(counted, token_counts.SEPARATED)
    assert counter.counts(["ab ab\tc", None, "", " \n", "c ab" * 3]) == [5, 0, 0, 0, 9]
    assert counter.counts(["ab c cab " * 1000 + "d"]) == [6001]
    assert sorted(asked) == ["ab", "abc", "c", "cab", "d"]
    asked.clear()
    assert counter.counts(["x" * 41 + " ab"] * 2) == [43] * 2 and counter.counts(["x" * 41]) == [41]
    assert asked == ["x" * 41] * 3


def test_few_remembered_words_change_no_count():
    data, want, rng = token_counts.read_tokenizer_file(public_tokenizers.path("word_bpe_49k.json")), library_count("word_bpe_49k.json"), random.Random(5)
    counter = token_counts.TokenCounter.of_tokenizer(data, most_words=20)
    for _ in range(20):
        texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 60))) for _ in range(40)]
        assert counter.counts(texts) == [want(t) for t in texts]
        assert len(counter.known) < 100


def test_pieces_are_cut_at_safe_places_only():
    cut = lambda text, most: list(token_counts.pieces(text, token_counts.SEPARATED, most))
    assert cut("ab cd ef", 3) == ["ab ", "cd ", "ef"]
    assert cut("abcdef", 2) == ["abcdef"] and cut("", 2) == [""] and cut("a1b2", 2) == ["a1", "b2"]
    assert cut("1'll 2́", 1) == ["1'll ", "2́"]
    long = "word " * 100_000
    assert "".join(cut(long, 1 << 16)) == long and max(map(len, cut(long, 1 << 16))) < (1 << 16) + 8


def test_a_tokenizer_that_looks_across_blanks_is_never_cut():
    added = [{"content": "<a b>"}]
    assert token_counts.boundary_of({"added_tokens": added}) is None and token_counts.boundary_of({}) is None
    assert token_counts.boundary_of({"normalizer": {"type": "Strip"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}) is None


def test_token_counts_of_table_and_edges(spark, texts, edge_docs):
    want = library_count("word_bpe_49k.json")
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = want(text or "")
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 2048)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_counts.token_counts(edge_docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, want(t or "")) for i, t, _ in EDGE_ROWS)
    assert token_counts.token_counts(edge_docs.filter("false"), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(edge_docs, "a.txt")
