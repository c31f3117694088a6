"""Token ids in a binary format of shuffled planes.

Ids are cut into blocks of ``block_ids``.  A block is transposed into bit planes
(one bit of every id) or byte planes (one byte of every id), each plane is
compressed with zstandard, planes of zeros only are left out, and the block gets
a header::

    magic 4 bytes | ids u32 | plane kind u8 ('b' bits, 'B' bytes) | planes u8 | bytes of each plane u32 ...

Blocks are records of a Parquet table, so that Spark's output committer writes
them to any store it knows and a lost task leaves nothing half written.  Each
record also holds its place: ``shard`` (range of ids of documents), ``block``
(number in the shard), ``first`` (ids before it in the shard), ``n_ids``, and the
documents of which it holds ids (``doc_ids``, ``starts`` in the shard, ``sizes``):
this is the chunk index, readable without the payload.

Steps of ``write_tokens``: encode (written once as 16- or 32-bit ids), deal by
ranges of doc_id with sorting inside, pack.  A task holds a block and the
document at hand.  Reading decodes blocks independently and in any order.

Null doc_ids come first; rows with equal doc_id are ordered by their ids and
stay separate documents.  Null and empty texts are documents with the end id
only.  An empty table gives an empty file set.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from sessionlens.llm.common import kept_by_worker, map_texts, slices, slices_of_bytes
from sessionlens.session import remove_written, shared_path, written

MAGIC = b"BPL1"
MAX_TOKENIZER_BYTES = 64 << 20
#: Distinct words whose ids a Python worker remembers, and bytes of both; beyond either those of the last slice stay.
CACHED_WORDS, CACHED_BYTES = 1_000_000, 32 << 20
#: Bytes of text that are cut into words at a time (one text at least).
SLICE_BYTES = 8 << 20
#: New words of letters that the library is asked for in one text, and pieces in one call: what it
#: returns for a piece takes far more memory than the ids.
ASKED_WORDS, ASKED_PIECES = 256, 2048


# --- planes -----------------------------------------------------------------


def pack(ids: np.ndarray, kind: str = "bytes", level: int = 3) -> bytes:
    """A block of unsigned 16- or 32-bit ids as bytes."""
    n, width = len(ids), ids.dtype.itemsize
    if kind == "bytes":
        planes = [p.tobytes() for p in ids.view(np.uint8).reshape(n, width).T]
    else:
        planes = [np.packbits((ids >> b & 1).astype(np.uint8)).tobytes() for b in range(8 * width)]
    while planes and not any(planes[-1]):
        planes.pop()
    small = zstandard.ZstdCompressor(level=level)
    data = [small.compress(p) for p in planes]
    head = MAGIC + struct.pack("<IBB", n, ord("B" if kind == "bytes" else "b"), len(data))
    return head + struct.pack(f"<{len(data)}I", *map(len, data)) + b"".join(data)


def unpack(block: bytes) -> np.ndarray:
    """The ids of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n, kind, n_planes = struct.unpack_from("<IBB", block, 4)
    sizes = struct.unpack_from(f"<{n_planes}I", block, 10)
    at = 10 + 4 * n_planes
    ids = np.zeros(n, np.uint32)
    reader = zstandard.ZstdDecompressor()
    for k, size in enumerate(sizes):
        plane = np.frombuffer(reader.decompress(block[at : at + size]), np.uint8)
        at += size
        if kind == ord("B"):
            ids |= plane.astype(np.uint32) << np.uint32(8 * k)
        else:
            ids |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(k)
    return ids


# --- encoding ---------------------------------------------------------------

#: A text without these characters may be lower-cased before its words are looked up: below U+0250 (but for
#: the dotted capital I) and among general punctuation, lower case maps one to one and nothing composes.
UNUSUAL = re.compile("[^\\x00-\u012f\u0131-\u024f\u2010-\u2027]")


def lines(column: pa.LargeStringArray) -> list[str]:
    """The values of a column without nulls and line feeds as a list (one split instead of a scalar for each)."""
    one = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
    return pc.binary_join(one, pa.scalar("\n", column.type))[0].as_py().split("\n") if len(column) else []


class WordEncoder:
    """Encodes texts by a tokenizer of the tokenizers library that lower-cases and never joins across a blank.

    A text is lower-cased where that cannot change the result, cut at blanks and
    line feeds, and the ids of each distinct piece come from the library once and
    are kept: a column of words and one of their ids, searched with Arrow.  New words of letters are asked for in one text and told apart by
    the tokens that end a word; of a word with one full stop or comma behind it
    only the word is asked for, as the tokenizer splits the two itself.  Lower-cased
    words skip the tokenizer's normalizer and splitting pattern (``lean``), which
    leave them as they are.
    """

    def __init__(self, data: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = self.lean = Tokenizer.from_buffer(data)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values(), default=0) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        config = json.loads(data)
        suffix = config["model"].get("end_of_word_suffix")
        self.ends_word = np.zeros(size, bool)
        self.ends_word[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        kinds = lambda part, key: [x["type"] for x in (config.get(part) or {}).get(key, [])]
        self.folds = "Lowercase" in kinds("normalizer", "normalizers")
        marked = [re.escape(t["content"]) for t in config.get("added_tokens", []) if t["content"]]
        self.marks = re.compile("|".join(marked)) if marked else None
        if {"NFC", "Replace", "Lowercase"} >= set(kinds("normalizer", "normalizers")) and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]:
            steps = [{"type": "WhitespaceSplit"}, config["pre_tokenizer"]["pretokenizers"][1]]
            config |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}
            self.lean = Tokenizer.from_str(json.dumps(config))
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        self.stops = dict(zip(".,", self.ask([".", ","]), strict=True))

    def ask(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, from the library."""
        out = []
        for k in range(0, len(pieces), ASKED_PIECES):
            found = self.tokenizer.encode_batch_fast(pieces[k : k + ASKED_PIECES], add_special_tokens=False)
            out += [np.array(e.ids, self.dtype).tobytes() for e in found]
        return out

    def ask_words(self, words: list[str], folded: bool) -> list[bytes]:
        """Ids of each word of letters."""
        tokenizer = self.lean if folded else self.tokenizer
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.dtype.itemsize
        if len(ends) != len(words):
            return self.ask(words)
        data, ends = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, pieces: list[str], folded: bool) -> list[bytes]:
        """Ids of each of the pieces, which differ from each other.

        Only words that stay letters under the tokenizer's normalizer take the short way: a
        letter such as U+0130 becomes one with a mark behind it, and a mark belongs
        to one token with the stop that follows.
        """
        stops, found = self.stops, {}
        letters = lambda p: p.isalpha() and (p.isascii() or not UNUSUAL.search(p))
        stopped = [p for p in pieces if p[-1:] in stops and letters(p[:-1])]
        words = list({p for p in pieces if letters(p)}.union(p[:-1] for p in stopped))
        for k in range(0, len(words), ASKED_WORDS):
            some = words[k : k + ASKED_WORDS]
            found.update(zip(some, self.ask_words(some, folded), strict=True))
        found.update([(p, found[p[:-1]] + stops[p[-1]]) for p in stopped])
        others = [p for p in pieces if p not in found]
        found.update(zip(others, self.ask(others), strict=True))
        return list(map(found.__getitem__, pieces))

    def encode_cut(self, texts: list[str], folded: bool) -> list[bytes]:
        """Ids of texts without line feeds: cut at blanks, each distinct piece looked up once, ids gathered by place."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        pieces = cut.flatten().dictionary_encode()
        distinct = pieces.dictionary
        place = pc.index_in(distinct, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        unknown = place < 0
        if unknown.any():
            new = distinct.filter(pa.array(unknown))
            place[unknown] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ids = pa.concat_arrays([self.ids, pa.array(self.learn(lines(new), folded), pa.large_binary())])
        own = self.ids.take(pa.array(place))
        if len(self.words) > CACHED_WORDS or self.words.nbytes + self.ids.nbytes > CACHED_BYTES:
            self.words, self.ids = distinct, own
        _, starts, data = own.take(pieces.indices).buffers()
        edges = np.frombuffer(starts, np.int64)[cut.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``dtype``."""
        whole: tuple[list[str], list[str]] = ([], [])
        places: tuple[list[int], list[int]] = ([], [])
        for place, text in enumerate(texts):
            text = text or ""
            lower = text.lower()
            folded = self.folds and (text.isascii() or not UNUSUAL.search(text)) and not (self.marks and self.marks.search(lower))
            whole[folded].append((lower if folded else text).replace("\n", " "))
            places[folded].append(place)
        out = [b""] * len(texts)
        for folded in (False, True):
            if whole[folded]:
                for place, ids in zip(places[folded], self.encode_cut(whole[folded], folded), strict=True):
                    out[place] = ids
        return out


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} has more than {MAX_TOKENIZER_BYTES} bytes")
    return data


def encode_words(docs: DataFrame, tokenizer: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``n_tokens`` and ``ids``, with ``end_id`` behind each document.

    Ids take two bytes each where the vocabulary allows it, else four.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    key = "words " + hashlib.sha256(tokenizer).hexdigest()

    def make():
        encoder = kept_by_worker(key, lambda: WordEncoder(sent.value))
        width = encoder.dtype.itemsize
        end = end_id.to_bytes(width, "little")

        def work(texts):
            rows = [(len(ids) // width + 1, ids + end) for ids in encoder.encode(texts)]
            pa.default_memory_pool().release_unused()  # a worker stays for later stages; Arrow would keep what a slice took
            return rows

        return work

    cut = partial(slices_of_bytes, most=SLICE_BYTES)
    return map_texts(docs, make, [("n_tokens", LongType()), ("ids", BinaryType())], id_col, text_col, cut)


# --- files ------------------------------------------------------------------


def write_tokens(encoded: DataFrame, path: str, block_ids: int = 1 << 16, shard_ids: int = 1 << 22, kind: str = "bytes", level: int = 3) -> None:
    """Write documents (doc_id, n_tokens, ids; read more than once, so give a written table) in ascending doc_id order."""
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    id_type = encoded.schema["doc_id"].dataType
    schema = StructType(
        [
            StructField("shard", IntegerType()),
            StructField("block", IntegerType()),
            StructField("first", LongType()),
            StructField("n_ids", IntegerType()),
            StructField("doc_ids", ArrayType(id_type)),
            StructField("starts", ArrayType(LongType())),
            StructField("sizes", ArrayType(LongType())),
            StructField("payload", BinaryType()),
        ]
    )

    def run(batches):
        shard, block, first, held = TaskContext.get().partitionId(), 0, 0, 0
        pieces: list[np.ndarray] = []
        docs: list[tuple] = []  # (doc_id, start in the shard, size) with ids in this block
        arrow_id = None

        def record():
            nonlocal block, first, held, pieces
            ids, starts, sizes = zip(*docs, strict=True)
            row = [[shard], [block], [first], [held], [list(ids)], [list(starts)], [list(sizes)], [pack(np.concatenate(pieces), kind, level)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(arrow_id), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=schema.names)
            block, first, held, pieces = block + 1, first + held, 0, []
            return out

        for part in slices(batches):
            arrow_id = part.column(0).type
            for doc_id, n, data in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")
                own = (doc_id, first + held, n)
                docs.append(own)
                while held + len(ids) >= block_ids:
                    room = block_ids - held
                    pieces.append(ids[:room])
                    ids, held = ids[room:], block_ids
                    yield record()
                    docs = [own] if len(ids) else []
                if len(ids):
                    pieces.append(ids)
                    held += len(ids)
        if held:
            yield record()

    shards = max(1, -(-total // shard_ids))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]  # rows of one doc_id spread over shards, too
    dealt = encoded.select("doc_id", "n_tokens", "ids").repartitionByRange(shards, *order)
    dealt.sortWithinPartitions(*order, "ids").mapInArrow(run, schema).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are decoded independently; the checksums of a document's parts in
    several blocks are combined in order.
    """
    blocks = spark.read.parquet(path)
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = StructType(
        [
            StructField("doc_id", id_type),
            *[StructField(n, LongType()) for n in ("shard", "local", "n_tokens", "block", "n_part", "crc")],
        ]
    )

    def run(batches):
        for part in slices(batches, 8):
            doc_ids, starts, sizes, shards, numbers, firsts, payloads = (part.column(k) for k in range(7))
            rows = np.diff(starts.offsets.to_numpy())
            first = np.repeat(firsts.to_numpy(), rows)
            start, size = starts.flatten().to_numpy(), sizes.flatten().to_numpy()
            low = np.maximum(start - first, 0)
            high = np.minimum(start + size - first, np.repeat(part.column("n_ids").to_numpy(), rows))
            crcs, at = [], 0
            for n, payload in zip(rows.tolist(), payloads, strict=True):
                data = memoryview(unpack(payload.as_py()).astype("<u4")).cast("B")
                crcs += [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(low[at : at + n].tolist(), high[at : at + n].tolist(), strict=True)]
                at += n
            shard, block = (np.repeat(c.to_numpy(), rows) for c in (shards, numbers))
            columns = [doc_ids.flatten(), shard, start, size, block, high - low, crcs]
            types = [doc_ids.type.value_type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if k else c for k, (c, t) in enumerate(zip(columns, types, strict=True))], names=schema.names)

    parts = blocks.select("doc_ids", "starts", "sizes", "shard", "block", "first", "payload", "n_ids").mapInArrow(run, schema)
    whole = parts.groupBy("shard", "local").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("block", "n_part", "crc"))).alias("parts"),
    )
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").cast("long").alias("n"))
    before = shards.select(
        F.col("shard").cast("long").alias("shard"),
        (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"),  # one row per shard
    )

    def combined(batches):
        for part in batches:
            parts = part.column(3)
            edges, own = parts.offsets.to_numpy(), parts.flatten()
            edges = edges - edges[0]
            sizes, crcs = own.field("n_part").to_numpy() * 4, own.field("crc").to_numpy()
            whole = crcs[edges[:-1]]  # right where a document lies in one block
            for k in np.flatnonzero(np.diff(edges) > 1).tolist():
                at = slice(edges[k], edges[k + 1])
                whole[k] = combine(list(zip(sizes[at].tolist(), crcs[at].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(3)], pa.array(whole)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = whole.join(before, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "parts")
    fields = [placed.schema["doc_id"], *[StructField(n, LongType()) for n in ("start", "n_tokens", "ids_crc32")]]
    return placed.mapInArrow(combined, StructType(fields))


def combine(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a whole from (bytes, CRC-32) of its parts in order."""
    crc = parts[0][1]
    for size, own in parts[1:]:
        crc = _after_zeros(crc, size) ^ own
    return crc


def _after_zeros(crc: int, size: int) -> int:
    """The CRC register advanced by ``size`` zero bytes: repeated squaring of its linear step over GF(2)."""
    step = [1 << (k - 1) if k else 0xEDB88320 for k in range(32)]  # one zero bit
    apply = lambda m, v: _xor(m[k] for k in range(32) if v >> k & 1)
    bits = 8 * size
    while bits:
        if bits & 1:
            crc = apply(step, crc)
        step = [apply(step, row) for row in step]
        bits >>= 1
    return crc


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def token_files(docs: DataFrame, tokenizer: bytes, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write the files (to ``path``, or a new folder of the shared one), and read the documents back."""
    spark = docs.sparkSession
    encoded = written(encode_words(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    path = path or shared_path(spark, "token-files")
    write_tokens(encoded, path)
    remove_written(encoded)
    return read_documents(spark, path)
