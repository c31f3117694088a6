"""Operators over the whole corpus, and the pipeline, against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sessionlens import session
from sessionlens.llm import bitplanes, decontam, quality, queries, resample, secrets, simhash

from .conftest import SF


# --- decontamination --------------------------------------------------------


def distances(pattern, text):
    last = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != t)))
        last = row
    return last[1:]


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(800):
        pattern, text = rng.choices("abc", k=rng.randint(1, 9)), rng.choices("abcd", k=rng.randint(1, 20))
        assert decontam.myers(pattern, text) == distances(pattern, text)


def test_contaminated_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(3, 20)))) for k in range(8)] + [(8, None), (9, "")]
    docs = []
    for k in range(150):
        text = rng.choices(words, k=rng.randint(0, 40))
        if k % 2:
            own = items[rng.randrange(8)][1].split()
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = "zz"
            text[len(text) // 2 : len(text) // 2] = own
        docs.append((k, " ".join(text).upper() + "."))
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in docs:
        for i, item in items:
            own = decontam.words_of(item)
            if len(own) >= 8 and (least := min(distances(own, decontam.words_of(text)), default=99)) <= int(0.2 * len(own) + 1e-9):
                want.add((d, i, least))
    for block_chars in (2_000_000, 150):
        got = decontam.contaminated(frame, asked, block_chars=block_chars).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) > 20
        left = decontam.without_contaminated(frame.withColumn("row_number", F.lit("other")), asked, block_chars=block_chars)
        assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _, _ in want}
        assert left.columns == [*frame.columns, "row_number"]


def test_short_and_unspaced_items_are_found(spark):
    items = [(1, "What is the capital of France?"), (2, "Who wrote Hamlet?"), (3, "Yes"), (4, "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u4e00\u5ea7\u57ce\u5e02\uff1f"), (5, "?!"), (6, None)]
    docs = [
        (1, "they ask what is the CAPITAL of France, and so on"), (2, "what is the old capital of France"), (3, "Q: who wrote Hamlet? A: Shakespeare"),
        (4, "a book on who wrote Hamlet and when"), (5, "He said: yes."), (6, "oh yes it is"), (7, "\u8bf7\u95ee\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u4e00\u5ea7\u57ce\u5e02\u5462"), (8, "\u4e2d\u56fd\u7684\u57ce\u5e02"),
        (9, "oh yes it is\nYes\n"), (10, "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u90a3\u4e00\u5ea7\u57ce\u5e02"), (11, "version 3.yes.4"),
    ]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1, 0), (3, 2, 0), (5, 3, 0), (7, 4, 0), (9, 3, 0), (10, 4, 1)}
    for block_chars in (2_000_000, 20):
        got = decontam.contaminated(frame, asked, block_chars=block_chars, short_items=True).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
        left = decontam.without_contaminated(frame, asked, block_chars=block_chars, short_items=True)
        assert {r.doc_id for r in left.collect()} == {2, 4, 6, 8, 11}


# --- token files ------------------------------------------------------------

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    for dtype, top in (("<u2", 40_000), ("<u4", 3_000_000), ("<u4", 1)):
        for n in (1, 7, 1000):
            ids = rng.integers(0, top, n).astype(dtype)
            for kind in ("bits", "bytes"):
                assert (bitplanes.unpack(bitplanes.pack(ids, kind)) == ids).all()


def test_crc_of_parts():
    data = bytes(range(256)) * 40
    for cut in (0, 1, 77, 10_000):
        parts = [(cut, zlib.crc32(data[:cut])), (100, zlib.crc32(data[cut : cut + 100])), (len(data) - cut - 100, zlib.crc32(data[cut + 100 :]))]
        assert bitplanes.combine([p for p in parts if p[0] >= 0]) == zlib.crc32(data)


def test_word_encoder_equals_library(texts):
    encoder = bitplanes.WordEncoder(bitplanes.read_tokenizer(WORD_BPE))
    library = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(4)
    parts = ["a", "B", " ", "\n", "'s", "'S", "é", "É", "é", "J̌", "日本", "1", "!?", "\x1c", "\x85", "the", "Σ", "İ", "A.", "b,", "<|endoftext|>", "<|ENDOFTEXT|>", "—"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)]
    for batch in (made, [t or "" for t in texts.values()]):
        for text, ids in zip(batch, encoder.encode(batch), strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("size", [3, 9])
def test_words_that_lose_a_mark_before_a_stop(size):
    encoder, library, rng = bitplanes.WordEncoder(bitplanes.read_tokenizer(WORD_BPE)), Tokenizer.from_file(WORD_BPE), random.Random(size)
    parts = ["İ", "İLİ", "NEVŞEHİR", "İ", "é", "क़", "ﬁ", "ß", "한", "ᄒ", "ᅡ", "ّ", "a", "B", ".", ",", ".", ",", " ", "\n", "1", "<|endoftext|>"]
    made = ["İ.", "İ,", "İLİ.", "NEVŞEHİR İLİ. SONRA İ.", *["".join(rng.choices(parts, k=rng.randint(1, size))) for _ in range(10_000)]]
    want = [e.ids for e in library.encode_batch(made, add_special_tokens=False)]
    for start in range(0, len(made), 500):  # words are learned in groups
        got = encoder.encode(made[start : start + 500])
        assert [np.frombuffer(ids, encoder.dtype).tolist() for ids in got] == want[start : start + 500]


class Asked:
    """A tokenizer that notes how many pieces it is asked for at a time."""

    def __init__(self, tokenizer):
        self.tokenizer, self.most = tokenizer, 0

    def encode_batch_fast(self, pieces, **options):
        self.most = max(self.most, len(pieces))
        return self.tokenizer.encode_batch_fast(pieces, **options)


def test_encoder_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bitplanes, "CACHED_BYTES", 1 << 20)
    encoder, library = bitplanes.WordEncoder(bitplanes.read_tokenizer(WORD_BPE)), Tokenizer.from_file(WORD_BPE)
    encoder.tokenizer = asked = Asked(encoder.tokenizer)
    texts = [" ".join(f"x{k}-{j}" for j in range(500)) for k in range(20)]  # no words of letters: each is a piece of its own
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, encoder.dtype).tolist() for ids in encoder.encode(texts)] == want
    assert asked.most <= bitplanes.ASKED_PIECES < 10_000
    for k in range(30):  # few pieces, many bytes
        encoder.encode([f"{k}" + "ab" * (1 << 15)])
        assert encoder.words.nbytes + encoder.ids.nbytes <= bitplanes.CACHED_BYTES
    assert [np.frombuffer(ids, encoder.dtype).tolist() for ids in encoder.encode(texts)] == want


def test_rows_of_one_id_spread_over_shards(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(400)] + [(None, f"none {k}") for k in range(200)], "doc_id long, text string")
    path = str(tmp_path / "files")
    bitplanes.write_tokens(bitplanes.encode_words(docs, bitplanes.read_tokenizer(WORD_BPE), 1), path, block_ids=64, shard_ids=400)
    assert max(r["count"] for r in spark.read.parquet(path).select("shard", F.explode("starts")).groupBy("shard").count().collect()) < 300
    got = spark.read.parquet(path).count(), bitplanes.read_documents(spark, path).orderBy("start").collect()
    starts = [r.start for r in got[1]]
    assert [r.doc_id for r in got[1]] == [None] * 200 + [7] * 400 and starts == [sum(r.n_tokens for r in got[1][:k]) for k in range(600)]


def expected_files(rows):
    library, start, out = Tokenizer.from_file(WORD_BPE), 0, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_token_files_of_documents(spark, texts):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op4_token_planes(spark, SF).collect()}
    assert got == expected_files(texts.items())


def test_documents_over_many_blocks_and_shards(spark, tmp_path):
    rows = [(k, "word and more " * (k % 7) ** 3) for k in range(60)] + [(60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encoded = bitplanes.encode_words(docs, bitplanes.read_tokenizer(WORD_BPE), 1)
    for kind in ("bits", "bytes"):
        path = str(tmp_path / kind)
        bitplanes.write_tokens(encoded, path, block_ids=50, shard_ids=2000, kind=kind)
        assert spark.read.parquet(path).select("shard").distinct().count() > 3
        got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitplanes.read_documents(spark, path).collect()}
        assert got == expected_files(rows)


def test_token_files_edges(edge_docs, no_docs):
    data = bitplanes.read_tokenizer(WORD_BPE)
    assert bitplanes.token_files(edge_docs, data, 1).count() == edge_docs.count()
    assert bitplanes.token_files(no_docs, data, 1).count() == 0


# --- near duplicates --------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, distance=3):
    docs = list(prints)
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(docs):
        for b in docs[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def test_simhash_of_documents(spark, texts):
    got = {r.doc_id: r for r in queries.op5_simhash(spark, SF).collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in got.items()} == plain_classes(prints)


@pytest.mark.parametrize("segments", [2, 3])
def test_anchors_bring_close_fingerprints_together(segments):
    rng = np.random.default_rng(5)
    for width in {64 * (k + 1) // segments - 64 * k // segments for k in range(segments)}:
        u = rng.integers(0, 1 << width, 500)
        v = u ^ (1 << rng.integers(0, width, 500))
        home = next(a for i, a, h in simhash.anchors_of(u, width, 1) if h)
        met = np.zeros(500, bool)
        for i, a, _ in simhash.anchors_of(v, width, 1):
            met[i[a == home[i]]] = True
        assert met.all()


def test_links_in_clusters_and_split_groups(spark):
    """Chains of near fingerprints around a few centres; small groups force the split into blocks."""
    rng = random.Random(6)
    prints = []
    for _ in range(6):
        now = rng.getrandbits(64)
        for _ in range(40):
            prints.append(now)
            now ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
    want = plain_classes(dict(enumerate(prints)))
    distinct = spark.createDataFrame([(simhash.signed(p),) for p in set(prints)], "fp long")
    for segments, max_group in ((2, 100_000), (2, 5), (1, 100_000), (3, 7)):
        pairs = simhash.links(simhash.cover(distinct, 3, segments), 3, max_group)
        roots = {r.node: r.root for r in simhash.components(pairs).collect()}
        classes = {}
        for k, p in enumerate(prints):
            s = simhash.signed(p)
            classes.setdefault(roots.get(s, s), []).append(k)
        assert {k: min(own) for own in classes.values() for k in own} == want


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.best_segments(n, 3) for n in (0, 1000, 10**9, 10**11)] == [2, 2, 2, 1]
    assert simhash.copies_and_anchors(64, 3)[1] == 2**34 and simhash.copies_and_anchors(32, 1)[1] == 2**18


def test_tables_of_the_component_rounds_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(k, f"some words of text {k // 3}") for k in range(30)], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 30
    left = sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir())
    assert left == ["fingerprint-parts", "fingerprints", "rooted"]
    with session.written_removed():
        corpus_pipeline.near_dedup(spark, docs.withColumn("lang", F.lit("en")), SF).write.parquet(str(tmp_path / "kept"))
    assert len(list(tmp_path.iterdir())) == 4 and spark.read.parquet(str(tmp_path / "kept")).count() == 10


def test_simhash_edges(edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0


# --- resampling -------------------------------------------------------------


def test_resample_keeps_the_share_and_prefers_the_target(spark):
    got = queries.op10_resample(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = sorted((r.key for r in got if r.key is not None), reverse=True)[: int(0.85 * len(got))]
    assert sorted((r.key for r in got if r.kept), reverse=True) == kept
    share = lambda q: np.mean([r.kept for r in got if labels.get(r.doc_id) == q])
    assert share(1) > 0.9 and share(0) < 0.3


def test_gram_counts_and_ratios(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, None)], "doc_id long, text string")
    settings = resample.ResampleSettings(buckets=1 << 12)
    good, raw = resample.gram_counts(docs, spark.createDataFrame([(1,)], "doc_id long"), settings, "doc_id", "text")
    grams = resample.Grams(1 << 12)
    assert (good == np.bincount(grams("a b a"), minlength=1 << 12)).all()
    assert (raw - good == np.bincount(grams("c d"), minlength=1 << 12)).all()
    assert raw.sum() == 5 + 3


@pytest.mark.parametrize("per_word", [True, False])
def test_weights_are_log_ratios(spark, per_word):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices("abcdefgh" if k % 3 else "efghijkl", k=rng.randint(0, 30)))) for k in range(80)] + [(None, "a b"), (None, "a b")]
    docs, good = spark.createDataFrame(rows, "doc_id long, text string"), [k for k in range(80) if k % 3][:20]
    settings = resample.ResampleSettings(per_word=per_word)
    got = resample.importance_sample(docs, spark.createDataFrame([(k,) for k in good], "doc_id long"), settings).collect()
    counts = {True: Counter(), False: Counter()}
    grams = resample.Grams(1 << 16)
    for k, text in rows:
        counts[False].update(grams(text).tolist())
        if k in good:
            counts[True].update(grams(text).tolist())
    total = {which: sum(c.values()) + (1 << 16) for which, c in counts.items()}
    ratio = lambda b: np.log((counts[True][b] + 1) / total[True]) - np.log((counts[False][b] + 1) / total[False])
    assert len(got) == len(rows)
    texts, keys = {}, []
    for k, text in rows:
        texts.setdefault(k, []).append(text)
    for r in got:
        want = sum(ratio(b) for b in grams(texts[r.doc_id][0]).tolist())
        assert r.log_weight == pytest.approx(want, abs=1e-9) and r.score == pytest.approx(want / max(1, r.n_grams), abs=1e-9)
        if r.n_grams:
            u = ((xxhash64_of(r.doc_id) >> 11) + 0.5) / (1 << 53)
            assert r.key == pytest.approx((want / r.n_grams * 50 if per_word else want) - np.log(-np.log(u)))
            keys.append(r.key)
    limit = sorted(keys, reverse=True)[int(0.85 * len(rows)) - 1]
    assert all(r.kept == (r.key is not None and r.key >= limit) for r in got)


def xxhash64_of(doc_id, seed=42):
    """Spark's xxhash64 of (doc_id, seed): each column's hash seeds the next; nulls change nothing."""
    h = 42
    if doc_id is not None:
        h = xxhash.xxh64(int(doc_id).to_bytes(8, "little", signed=True), seed=h).intdigest()
    return xxhash.xxh64(int(seed).to_bytes(4, "little"), seed=h).intdigest()


def test_kth_largest(spark):
    rng = random.Random(7)
    values = [rng.choice([rng.random(), 0.5, -1e9 * rng.random()]) for _ in range(500)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 100, 250, 500):
        assert resample.largest(keys, k, bins=8) == sorted(values, reverse=True)[k - 1]
    assert resample.largest(keys, 501) is None and resample.largest(keys, 0) is None


def test_resample_edges(spark, edge_docs, no_docs):
    good = spark.createDataFrame([(4,), (None,)], "doc_id long")
    got = resample.importance_sample(edge_docs, good).collect()
    assert len(got) == edge_docs.count() and not any(r.kept for r in got if r.doc_id in (1, 2, 3))
    assert resample.importance_sample(edge_docs, good.filter("false")).count() == edge_docs.count()
    assert resample.importance_sample(no_docs, good).count() == 0


# --- pipeline ---------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, texts):
    import zstandard

    compressor = zstandard.ZstdCompressor(level=3, write_content_size=False)
    left = {d: t for d, t in texts.items() if quality.judge(t, quality.QualityRules(), compressor)[-1]}
    classes = plain_classes({d: plain_fingerprint(t) for d, t in left.items()})
    left = {d: t for d, t in left.items() if classes[d] == d}
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, t in left.items() for i in items if min(distances(i, decontam.words_of(t)), default=99) <= int(0.2 * len(i) + 1e-9)}
    left = {d: t for d, t in left.items() if d not in hit}
    rows = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    left = {r.doc_id: r.text for r in secrets.redact_secrets(rows).collect()}
    coder = queries.byte_bpe().open()
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: coder.encode(t) for d, t in left.items()} and 0 < len(got) < len(texts) and hit


def test_stages_keep_columns_and_stand_edges(spark, edge_docs, no_docs):
    docs = edge_docs.withColumn("n_chars", F.lit(1).cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    for source in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, SF)
            assert out.count() <= source.count()
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]


def test_near_dedup_decides_per_row(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(rng.choices([f"w{k}" for k in range(500)], k=80)) for _ in range(5))
    near = lambda rows: sorted(
        [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, row_number string"), SF).collect()],
        key=lambda r: (r[0] is None, r),
    )
    n = "other"
    # an id on rows of two classes: each class keeps its row of the smallest id
    assert near([(1, b, n), (3, b, n), (3, a, n), (5, a, n)]) == sorted([(1, b), (3, a)])
    # different clean texts under one id stay, also beside a copy
    assert near([(1, a, n), (2, a, n), (2, b, n), (4, c, n), (4, d, n)]) == sorted([(1, a), (2, b), (4, c), (4, d)])
    # rows without an id are compared like others, and go for a row with an id
    assert near([(None, a, n)] * 20 + [(None, b, n), (7, b, n), (None, c, n)]) == sorted([(7, b)]) + sorted([(None, a), (None, c)])
    assert near([(6, e, n)] * 3) == [(6, e)]
