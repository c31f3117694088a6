"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are cut into ``segments`` runs of bits.  Two fingerprints
that differ in at most ``distance`` bits differ in at most
``distance // segments`` bits of one segment (pigeonhole).  Each segment has a
covering code as its anchors: the direct sum of perfect codes of 23 bits (Golay,
radius 3), 7 and 3 bits (Hamming, radius 1) and single bits (radius 0).  Every
fingerprint goes to its nearest anchor (home) and to every anchor within the
covering radius plus the segment's threshold, block by block: code words of the
blocks whose distances exceed the radii by no more than the threshold in total.
If u and v differ in e bits of the segment, the home anchor of u is among those
of v, so each close pair meets at an anchor and is compared there on all 64 bits.

``segments`` is chosen from the number of distinct fingerprints: one segment has
far more anchors (2 ** 34 instead of 2 ** 18) and sends far more copies, so it pays
beyond some 10 ** 10 of them.  The classes do not depend on it.

Distinct fingerprints are covered once, however many documents share them.  At
an anchor, fingerprints of one component are linked as a star, not pair by pair.
An anchor with more than ``max_group`` fingerprints is cut into blocks; every
pair of blocks becomes a group of its own, so no link is lost and no task holds
more than two blocks.  Links are joined into components by alternating large and
small stars over Parquet tables in the shared folder; the documents of one
fingerprint and the fingerprints of one class are joined in up to ``spread`` parts.

Null and empty texts, and texts without a word, have fingerprint zero and are
linked like any other.  Equal rows are members of one class each; rows with a
null doc_id do not count for the smallest id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sessionlens.llm.common import each, map_texts
from sessionlens.session import remove_written, written

BITS = 64
GOLAY = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, generator of the [23, 12] code


# --- fingerprints -----------------------------------------------------------


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle_words))))  # noqa: B905
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for s in range(0, len(hashes), 1 << 14):
        part = hashes[s : s + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``fp``, the fingerprint as a signed 64-bit integer."""
    return map_texts(docs, lambda: each(lambda t: (signed(fingerprint(t, shingle_words, seed)),)), [("fp", LongType())], id_col, text_col)


# --- anchors ----------------------------------------------------------------


def golay_syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator: zero for code words."""
    rest = words.astype(np.int64)
    for k in range(22, 10, -1):
        rest = np.where(rest >> k & 1, rest ^ GOLAY << (k - 11), rest)
    return rest


def hamming_syndrome(words: np.ndarray, width: int) -> np.ndarray:
    """Exclusive or of the places (from 1) of the set bits: zero for code words."""
    out = np.zeros(words.shape, np.int64)
    for k in range(width):
        out ^= np.where(words >> k & 1, k + 1, 0)
    return out


RADIUS = {23: 3, 7: 1, 3: 1, 1: 0}


def syndromes(words: np.ndarray, width: int) -> np.ndarray:
    return golay_syndrome(words) if width == 23 else hamming_syndrome(words, width) if width > 1 else np.zeros(words.shape, np.int64)


def block_widths(bits: int) -> list[int]:
    """Lengths of perfect codes that fill the bits, the longest first."""
    out = []
    for width in RADIUS:
        out += [width] * (bits // width)
        bits %= width
    return out


@lru_cache(8)
def patterns(width: int, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each excess e up to the threshold: (first, masks), where masks[first[s]:first[s + 1]] are the
    differences from a word of syndrome s to its anchors at distance radius + e, for e = 0 at most radius."""
    codes = 1 << {23: 11, 7: 3, 3: 2, 1: 0}[width]
    out = []
    for e in range(threshold + 1):
        weights = range(RADIUS[width] + 1) if e == 0 else [RADIUS[width] + e]
        masks = [sum(1 << b for b in c) for w in weights for c in combinations(range(width), w)]
        masks = np.array(masks, np.int64)
        s = syndromes(masks, width) if len(masks) else masks
        order = np.argsort(s, kind="stable")
        out.append((np.searchsorted(s[order], np.arange(codes + 1)), masks[order]))
    return out


def anchors_of(values: np.ndarray, bits: int, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(index of the value, anchor, is home) for every anchor that the values reach; homes come once each."""
    widths = block_widths(bits)
    words, syn, at = [], [], 0
    for width in widths:
        words.append(values >> at & (1 << width) - 1)
        syn.append(syndromes(words[-1], width))
        at += width
    for excess in product(*(range(threshold + 1) for _ in widths)):
        if sum(excess) > threshold:
            continue
        index, anchor, at = np.arange(len(values)), np.zeros(len(values), np.int64), 0
        for width, e, word, s in zip(widths, excess, words, syn, strict=True):
            first, masks = patterns(width, threshold)[e]
            low, n = first[s[index]], first[s[index] + 1] - first[s[index]]
            place = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            index, anchor = np.repeat(index, n), np.repeat(anchor, n)
            anchor |= (word[index] ^ masks[place]) << at
            at += width
        yield index, anchor, not any(excess)


#: Work to send one copy to an anchor (serialise, shuffle, sort), in comparisons of two fingerprints.
COPY_COST = 1500


@lru_cache(8)
def copies_and_anchors(bits: int, threshold: int) -> tuple[float, float]:
    """(mean number of anchors that a fingerprint is sent to, number of all anchors) of a segment."""
    values = np.random.default_rng(0).integers(0, 1 << min(bits, 62), 64)
    copies = sum(len(index) for index, _, _ in anchors_of(values, bits, threshold)) / len(values)
    checks = {23: 11, 7: 3, 3: 2, 1: 0}
    return copies, 2.0 ** sum(width - checks[width] for width in block_widths(bits))


def cost_of(segments: int, n: int, distance: int) -> float:
    """Estimated work per fingerprint, in comparisons: its copies are sent, and its home groups are searched."""
    work = 0.0
    for k in range(segments):
        copies, anchors = copies_and_anchors(BITS * (k + 1) // segments - BITS * k // segments, distance // segments)
        work += copies * COPY_COST + copies * n / anchors
    return work


def best_segments(n: int, distance: int) -> int:
    """The number of segments with the least work for ``n`` distinct fingerprints."""
    return min((1, 2, 3), key=lambda segments: cost_of(segments, n, distance))


def cover(distinct: DataFrame, distance: int, segments: int) -> DataFrame:
    """(segment, anchor, fp, home) for every anchor that a fingerprint is sent to."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    threshold = distance // segments

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for start in range(0, len(fps), 2048):
                part = fps[start : start + 2048]
                for seg, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    values = (part.view(np.uint64) >> np.uint64(a)).view(np.int64) & np.int64((1 << b - a) - 1 if b - a < BITS else -1)
                    for index, anchor, home in anchors_of(values, b - a, threshold):
                        cols = [np.full(len(index), seg, np.int32), anchor, part[index], np.full(len(index), home)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["segment", "anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "segment int, anchor long, fp long, home boolean")


# --- links ------------------------------------------------------------------


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def star_links(fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what the close pairs with a home among them connect: (member, start of its search)."""
    out = []
    open_ = np.ones(len(fps), bool)
    for s in np.flatnonzero(home):
        if not open_[s]:
            continue
        open_[s] = False
        reach = [s]
        while reach:  # every fingerprint leaves the open ones once, and looks at those still open
            left = np.flatnonzero(open_)
            if not len(left):
                break
            near = left[ones((fps[left] ^ fps[reach.pop()]).view(np.uint64)) <= distance]
            open_[near] = False
            out += [(int(fps[k]), int(fps[s])) for k in near]
            reach += near.tolist()
    return out


def links(covered: DataFrame, distance: int, max_group: int) -> DataFrame:
    """(a, b): links of fingerprints, connecting exactly those that a chain of close pairs connects."""
    key = ["segment", "anchor"]
    large = covered.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > max_group)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / max_group).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    grouped = (
        covered.join(large, key, "left")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("segment", "anchor", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "home")
    )

    def run(batches):
        key, fps, homes = None, [], []

        def found(fp_parts, home_parts):
            fps = np.concatenate(fp_parts)
            return star_links(fps, np.concatenate(home_parts), distance) if len(fps) > 1 else []

        def out(pairs):
            a, b = zip(*pairs, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            pairs: list = []
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)])
            fp, home = batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(fp)]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                now = tuple(keys[:, s].tolist())
                if now != key and fps:
                    pairs += found(fps, homes)
                    fps, homes = [], []
                key = now
                if e == len(fp) or fps:  # may go on in the next batch, or began in the last
                    fps.append(fp[s:e])
                    homes.append(home[s:e])
                elif e - s > 1:
                    pairs += found([fp[s:e]], [home[s:e]])
            if pairs:
                yield out(pairs)
        if fps and (pairs := found(fps, homes)):
            yield out(pairs)

    dealt = grouped.repartition("segment", "anchor", "p", "q").sortWithinPartitions("segment", "anchor", "p", "q")
    return dealt.mapInArrow(run, "a long, b long").distinct()


# --- components -------------------------------------------------------------


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's smallest node.

    Rounds of large star (each node sends its larger neighbours to its smallest)
    and small star (each node sends its smaller neighbours to its smallest), until
    the links stay the same.  Each round is written to the shared folder, and the
    tables that it was made of are removed.
    """
    now = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = print_of(now)
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join deals both sides itself and can split a node with very many links
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = written(large.distinct(), "links")
        remove_written(now, least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        remove_written(large, least)
        if (own := print_of(now)) == last:
            break
        last = own
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def with_part(rows: DataFrame, by: str, spread: int) -> DataFrame:
    """``rows`` with the column ``part``: one of ``spread`` numbers, by a hash of the column ``by``."""
    return rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(spread)).cast("int"))


def near_duplicates(
    docs: DataFrame,
    distance: int = 3,
    shingle_words: int = 3,
    segments: int | None = None,
    max_group: int = 100_000,
    spread: int = 256,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``fp`` and ``component_id``, the smallest doc_id of its near-duplicate class.

    ``segments``: None chooses it by the number of distinct fingerprints.
    """
    prints = written(with_part(fingerprints(docs, shingle_words, seed, id_col, text_col), "doc_id", spread), "fingerprints")
    shares = written(prints.groupBy("fp", "part").agg(F.min("doc_id").alias("least")), "fingerprint-parts")
    classes = written(shares.groupBy("fp").agg(F.min("least").alias("least")), "distinct-fingerprints")
    segments = segments or best_segments(classes.count(), distance)
    roots = components(links(cover(classes, distance, segments), distance, max_group))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(with_part(rooted, "fp", spread), "rooted")
    remove_written(classes, roots)
    root_shares = rooted.groupBy("root", "part").agg(F.min("least").alias("least"))
    least = root_shares.groupBy("root").agg(F.min("least").alias("component_id"))
    # members meet their class by (root, part), documents their fingerprint by (fp, part): a class or a
    # fingerprint that holds a large share of all rows goes to up to `spread` tasks
    merged = rooted.join(root_shares.select("root", "part").join(least, "root"), ["root", "part"]).select("fp", "component_id")
    merged = shares.select("fp", "part").join(merged, "fp")
    return prints.join(merged, ["fp", "part"]).select("doc_id", "fp", "component_id")
