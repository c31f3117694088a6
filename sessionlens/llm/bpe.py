"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens by a pattern.  First tier: a minimal perfect hash
over the vocabulary resolves every pre-token that is itself a token.  Second
tier: the rest is merged pair by pair, the lowest rank first, with a heap over
linked byte positions, O(n log n) also for very long pre-tokens.  A bounded
cache keeps the ids of pre-tokens that a task has met.

One pass, no shuffle; the vocabulary file (a parameter) is read once by the
driver and sent to the tasks; its size is checked against ``MAX_VOCABULARY_BYTES``.
Null and empty texts give no ids.  Every row is encoded by itself, so ties and
repeated rows need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from array import array

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType

from sessionlens.llm.common import Remembered, each, kept_by_worker, map_texts

MAX_VOCABULARY_BYTES = 64 << 20
#: Longest pre-token (characters) that is remembered, and how many a Python worker remembers per generation (there are two).
CACHED_CHARS, CACHED_TOKENS = 40, 400_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ranks (which must be 0, 1, 2, ...)."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2, ...")
    return [t for _, t in pairs]


class MinimalPerfectHash:
    """Hash and displace: n keys onto n places without a gap.

    A key's hash picks a bucket; the bucket's displacement, found when building,
    sends each of its keys to a place of its own.  Buckets are placed from the
    largest to the smallest; those with one key take the places that are left.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 3) -> None:
        if len(set(keys)) != len(keys):
            raise ValueError("keys repeat")
        self.keys = keys
        self.n = len(keys)
        self.n_buckets = max(1, self.n // per_bucket)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, self.n)
        bucket = (hashes >> np.uint64(32)) % np.uint64(self.n_buckets)
        self.shift = np.zeros(self.n_buckets, np.int64)
        self.at = np.full(self.n, -1, np.int64)  # place -> number of the key
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if self.n else []
        singles = []
        for members in sorted(groups, key=len, reverse=True):
            b = int(bucket[members[0]])
            if len(members) == 1:
                singles.append((b, int(members[0])))
                continue
            own = [int(h) for h in hashes[members]]
            d = 0
            while True:
                places = {self._place(h, d) for h in own}
                if len(places) == len(own) and all(self.at[p] < 0 for p in places):
                    break
                d += 1
            self.shift[b] = d
            for m, h in zip(members.tolist(), own, strict=True):
                self.at[self._place(h, d)] = m
        for (b, m), place in zip(singles, np.flatnonzero(self.at < 0).tolist(), strict=True):
            self.shift[b] = -1 - place
            self.at[place] = m
        self.shift, self.at = self.shift.tolist(), self.at.tolist()

    def _place(self, h: int, d: int) -> int:
        return ((h ^ (h >> 29)) * (2 * d + 1) + d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) % self.n

    def find(self, key: bytes) -> int:
        """Number of the key, or -1 if it is none of the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.n_buckets]
        found = self.at[-1 - d if d < 0 else self._place(h, d)]
        return found if self.keys[found] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merge the adjacent pair of lowest rank, leftmost first."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    base = n + 1  # a heap entry is (rank, start, end) in one number of that base
    end = list(range(1, n + 1))  # end of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before
    heap = [(r * base + i) * base + i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        rest, stop = divmod(pop(heap), base)
        i = rest % base
        if gone[i] or (j := end[i]) >= n or end[j] != stop:
            continue  # the pair has changed since
        end[i], gone[j] = stop, 1
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                push(heap, (r * base + i) * base + end[stop])
        if (k := before[i]) >= 0 and (r := get(piece[k:stop])) is not None:
            push(heap, (r * base + k) * base + stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteLevelBPE:
    """Encoder and decoder; the tokens are given in the order of their ranks.

    In the pattern, white space means the Unicode property, as in the common
    rank-file encoders, also for the control characters 28 to 31.
    """

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        spaces = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = spaces
        self.lookup = MinimalPerfectHash(tokens)

    @classmethod
    def prepared(cls, tokens: list[bytes], pattern: str, lookup: MinimalPerfectHash) -> ByteLevelBPE:
        own = cls.__new__(cls)
        own.tokens, own.pattern, own.lookup = tokens, pattern, lookup
        return own.open()

    def open(self) -> ByteLevelBPE:
        """Prepare for use in a task."""
        self.find_all = regex.compile(self.pattern).findall
        self.ranks = {t: r for r, t in enumerate(self.tokens)}
        self.ids = Remembered(self.ids_of, CACHED_TOKENS)
        return self

    def ids_of(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.lookup.find(data)
        return struct.pack("<I", whole) if whole >= 0 else array("I", merge(data, self.ranks)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.find_all(text or "")
        if max(map(len, pieces), default=0) <= CACHED_CHARS:
            return b"".join(map(self.ids.__getitem__, pieces))
        return b"".join([self.ids[p] if len(p) <= CACHED_CHARS else self.ids_of(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _sent(docs: DataFrame, bpe: ByteLevelBPE):
    """A function that gives a task the encoder of its Python worker."""
    sent = docs.sparkSession.sparkContext.broadcast((bpe.tokens, bpe.pattern, bpe.lookup))
    key = "bpe " + hashlib.sha256(repr((bpe.tokens, bpe.pattern)).encode()).hexdigest()
    return lambda: kept_by_worker(key, lambda: ByteLevelBPE.prepared(*sent.value))


def encode_texts(docs: DataFrame, bpe: ByteLevelBPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers)."""
    of_worker = _sent(docs, bpe)

    def make():
        own = of_worker()
        return each(lambda text: (len(ids := own.encode(text)) // 4, ids))

    return map_texts(docs, make, [("n_tokens", LongType()), ("ids", BinaryType())], id_col, text_col)


def round_trip_digests(docs: DataFrame, bpe: ByteLevelBPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and return per document ``n_tokens`` and the SHA-256 of ids and decoded bytes."""
    of_worker = _sent(docs, bpe)

    def make():
        own = of_worker()

        def row(text):
            ids = own.encode(text)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

        return each(row)

    fields = [("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType())]
    return map_texts(docs, make, fields, id_col, text_col)
