"""Token counts: the number of tokens of every text, by a tokenizer of a public library.

Texts are encoded in batches inside Arrow functions and only the lengths leave
them.  A batch holds pieces of about ``BATCH_BYTES`` bytes in all, whatever the
number of texts: many short texts share one, a long text is cut into several
pieces where the tokenizer can never join or look across, so the counts of the
pieces add up to the count of the text.

Where a cut is safe follows from the tokenizer's own steps (``boundary_of``):

* texts whose white space is only a separator (normalisation by NFC, blanks and
  lower case; words, digits and signs split apart, blanks dropped): behind an
  ASCII blank, and behind an ASCII digit before an ASCII letter or digit, since
  each digit is a word of its own;
* byte-level texts split by the common pattern (a blank goes with the word
  behind it): between an ASCII letter or digit and a blank that an ASCII letter
  or digit follows;
* any other tokenizer, SentencePiece models among them: never, a text is whole.

A text without a safe place (a single word of a million letters) stays one piece.

Where blanks only separate, a text is cut at every blank and the library counts each
distinct word once: a Python worker remembers the counts of the words of up to
``REMEMBERED_CHARS`` characters that it met (about ``REMEMBERED_WORDS``; then it
starts again); longer words are counted as pieces wherever they occur.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sessionlens.llm.common import kept_by_worker, map_texts, slices_of_bytes

#: A tokenizer file larger than this is refused: it is sent to every executor.
MAX_TOKENIZER_BYTES = 64 << 20
#: Bytes of text that are Python objects at a time, of a batch for the library, and of a piece of a long text.
SLICE_BYTES, BATCH_BYTES, PIECE_BYTES = 4 << 20, 1 << 18, 1 << 16

#: Longest word (characters) whose count is remembered, after how many of them the others than a text's own are forgotten,
#: and about how many characters of a text are cut into words at a time.
REMEMBERED_CHARS, REMEMBERED_WORDS, WORDS_CHARS = 40, 400_000, 1 << 20

SEPARATED = re.compile("[ \t\r\n]|[0-9](?=[0-9A-Za-z])")
WORD = re.compile("[^ \t\r\n]+")
BYTE_LEVEL = re.compile("[0-9A-Za-z](?= [0-9A-Za-z])")


def boundary_of(config: dict) -> re.Pattern | None:
    """What a text may be cut behind, for a tokenizer of this configuration (None: nowhere)."""
    if any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s|\d", t["content"]) for t in config.get("added_tokens") or []):
        return None
    normalizer = config.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    before = config.get("pre_tokenizer") or {}
    splits = before.get("pretokenizers", [before] if before else [])
    kinds = [s["type"] for s in splits]
    blanks = [s for s in steps if s["type"] == "Replace"]
    usual = {s["type"] for s in steps} <= {"NFC", "Replace", "Lowercase"} and all(s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in blanks)
    if usual and kinds == ["Split", "ByteLevel"] and not splits[1].get("use_regex", True) and not splits[1].get("add_prefix_space", True):
        dropped = splits[0].get("invert") and splits[0].get("behavior") == "Removed"
        words = (splits[0].get("pattern") or {}).get("Regex", "").split("|")
        if dropped and {"[\\p{L}]+", "[\\p{N}]"} <= set(words) and all("\\s" not in w or w.startswith("[^\\s") for w in words):
            return SEPARATED
    if not steps and kinds == ["ByteLevel"] and splits[0].get("use_regex", True) and not splits[0].get("add_prefix_space", True):
        return BYTE_LEVEL
    return None


def pieces(text: str, boundary: re.Pattern | None, most: int = PIECE_BYTES) -> Iterator[str]:
    """The text cut behind safe places: each piece but the last has at least ``most`` characters."""
    start = 0
    while boundary is not None and len(text) - start > most:
        found = boundary.search(text, start + most - 1)
        if not found or found.end() == len(text):
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


class TokenCounter:
    """Counts the tokens of texts; ``count`` is the library's count of each text of a batch."""

    def __init__(self, count: Callable[[list[str]], list[int]], boundary: re.Pattern | None, batch_bytes: int = BATCH_BYTES, piece: int = PIECE_BYTES, most_words: int = REMEMBERED_WORDS) -> None:
        self.count, self.boundary, self.batch_bytes, self.piece = count, boundary, batch_bytes, piece
        self.known: dict[str, int] = {}
        self.most_words = most_words

    @classmethod
    def of_tokenizer(cls, data: bytes, **sizes: int) -> TokenCounter:
        """From the JSON of the tokenizers library."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark runs the tasks side by side
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(data)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return cls(lambda batch: [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)], boundary_of(json.loads(data)), **sizes)

    @classmethod
    def of_model(cls, data: bytes, **sizes: int) -> TokenCounter:
        """From a SentencePiece model."""
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        return cls(lambda batch: [len(ids) for ids in processor.encode(batch, num_threads=1)], None, **sizes)

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text (null: none)."""
        if self.boundary is not SEPARATED:
            return self.counts_of_pieces(texts)
        return [sum(map(self.count_of_words, map(WORD.findall, pieces(text or "", SEPARATED, WORDS_CHARS)))) for text in texts]

    def count_of_words(self, words: list[str]) -> int:
        """The number of tokens of all the words; the library counts those that are not remembered."""
        missing = list(set(words).difference(self.known))
        if missing:
            if len(self.known) >= self.most_words:
                self.known = {w: self.known[w] for w in set(words) if w in self.known}
            self.known.update(zip(missing, self.counts_of_pieces(missing), strict=True))
        n = sum(map(self.known.__getitem__, words))
        for word in missing:
            if len(word) > REMEMBERED_CHARS:
                del self.known[word]
        return n

    def counts_of_pieces(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text, counted piece by piece."""
        out, batch, owners, held = [0] * len(texts), [], [], 0
        for place, text in enumerate(texts):
            for piece in pieces(text or "", self.boundary, self.piece):
                batch.append(piece)
                owners.append(place)
                held += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
                if held >= self.batch_bytes:
                    self.add(out, batch, owners)
                    batch, owners, held = [], [], 0
        self.add(out, batch, owners)
        return out

    def add(self, out: list[int], batch: list[str], owners: list[int]) -> None:
        for place, n in zip(owners, self.count(batch) if batch else (), strict=True):
            out[place] += n


def read_tokenizer_file(path: str) -> bytes:
    """The file on the driver; a larger one than ``MAX_TOKENIZER_BYTES`` is refused."""
    with open(path, "rb") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} has more than {MAX_TOKENIZER_BYTES} bytes")
    return data


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more tokens than ``limit``).

    ``path`` names a file of the driver: ``.json`` is read by the tokenizers
    library, ``.model`` by SentencePiece.  Counts are the library's without begin,
    end or added special tokens, truncation or padding; special strings inside a
    text are handled as the library does by default.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows, null and
    repeated ids are rows of their own; an empty table gives an empty one; other
    columns are not read, whatever their names.  No shuffle.
    """
    kind = path.rpartition(".")[2]
    if kind not in ("json", "model"):
        raise ValueError(f"{path}: a tokenizer file ends in .json or .model")
    data = read_tokenizer_file(path)
    sent = docs.sparkSession.sparkContext.broadcast(data)
    key = "counter " + hashlib.sha256(data).hexdigest()

    def make():
        counter = kept_by_worker(key, lambda: (TokenCounter.of_tokenizer if kind == "json" else TokenCounter.of_model)(sent.value))

        def work(texts):
            sizes = (0 if t is None else len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts)
            return list(zip(sizes, counter.counts(texts), strict=True))

        return work

    cut = partial(slices_of_bytes, most=SLICE_BYTES)
    out = map_texts(docs, make, [("n_bytes", LongType()), ("n_tokens", LongType())], id_col, text_col, cut)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
