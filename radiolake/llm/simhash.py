"""Near-duplicate documents by SimHash, with a Gray-order hierarchical index.

Fingerprints within ``distance`` bits are linked. They are dealt so that linked ones meet: the 64 bits are cut into
segments, and two fingerprints that differ in ``distance`` bits agree on enough whole segments that at least one choice
of segments is equal in both (the pigeonhole principle). All fingerprints with one choice's value form a group. Groups
are sorted by Gray rank and cut into blocks of bounded size; a block's index factors the bits that all its fingerprints
share into its top node, those shared by runs of its fingerprints into lower nodes, and a search adds up differences on
the way down and drops a whole node when the sum passes the limit. Blocks of one group are compared with each other in
the same way, by their top nodes first. Each comparison gives links that span its components rather than all pairs, and
components of the links are found by large-star and small-star rounds over tables in the shared folder.

One word of 64 bits scatters too much to tell texts of a similarity of 0.8 from others, at any limit. For near copies by
that similarity, :func:`keep_first` gives each set of shingles a longer fingerprint of several words, deals the sets by
bands of their shingles' minima, searches each group with the same index and verifies what it finds exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import documents, staged

#: Fingerprints in a block: 32 KB, and at most 2**24 comparisons between two blocks.
BLOCK = 4096
#: Children of a node of the index, and (query, fingerprint) pairs that may be reached together.
FANOUT, PAIRS_AT_ONCE = 8, 1 << 20
#: Share of a level's nodes beyond which pruning doesn't pay.
DENSE = 0.1
SEED = 42


# --- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> np.uint64:
    """SimHash of a text's word shingles; zero if it has no words.

    Only A-Z are lower-cased and only ASCII white space separates words, as ``bytes`` methods do. A bit is set if it
    is set in over half the shingles' XXH64 hashes.
    """
    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return np.uint64(0)
    flat = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(tokens))
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), len(tokens) - width + 1
    for at in range(0, count, 1 << 16):  # bounded memory, however long the text
        many = slice(at, min(at + (1 << 16), count))
        hashes = np.array([digest(flat[s:e], seed) for s, e in zip(starts[many].tolist(), ends[width - 1 :][many].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > count, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``key`` and ``fp`` (a signed long) for each row; texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


# --- the index ------------------------------------------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in Gray order: neighbours in that order differ in few, low bits."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under nodes of up to FANOUT children each.

    ``fps`` are uint64, one row for each word of the fingerprints. ``levels`` goes from the leaves to the single root;
    each level has its nodes' patterns, and the masks of the bits that all below the node share and that the parent
    doesn't already account for.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        shared, levels = np.full_like(fps, ~np.uint64(0)), []
        pattern = fps
        while True:
            levels.append((pattern, shared))
            if pattern.shape[1] == 1:
                break
            firsts = np.arange(0, pattern.shape[1], FANOUT)
            all_and = np.bitwise_and.reduceat(pattern, firsts, axis=1)
            all_or = np.bitwise_or.reduceat(pattern, firsts, axis=1)
            shared = ~(all_and ^ all_or) & np.bitwise_and.reduceat(shared, firsts, axis=1)
            pattern = all_and & shared
        self.levels = []
        for k, (pattern, shared) in enumerate(levels):
            above = levels[k + 1][1][:, np.arange(pattern.shape[1]) // FANOUT] if k + 1 < len(levels) else np.uint64(0)
            self.levels.append((pattern, shared & ~above))

    @property
    def root(self) -> tuple[np.ndarray, np.ndarray]:
        """Pattern and mask of the bits that all fingerprints share, for each word."""
        pattern, mask = self.levels[-1]
        return pattern[:, 0], mask[:, 0]

    def search(self, queries: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, fingerprint number) of all within ``distance``, for some queries at a time, in their order."""
        together = max(1, PAIRS_AT_ONCE // self.fps.size)
        for at in range(0, queries.shape[1], together):
            own = queries[:, at : at + together]
            n = own.shape[1]
            q, node, gone = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                pattern, mask = self.levels[k]
                gone = gone + _bits((own[:, q] ^ pattern[:, node]) & mask[:, node])
                near = gone <= distance
                q, node, gone = q[near], node[near], gone[near]
                if k and len(q) > n * pattern.shape[1] * DENSE and pattern.shape[1] >= FANOUT:
                    # few groups can be pruned: all below are compared in rows, which costs less than following them
                    q, node = np.nonzero(_bits(own[:, :, None] ^ self.fps[:, None, :]) <= distance)
                    break
                if k:
                    below = self.levels[k - 1][0].shape[1]
                    q, gone = np.repeat(q, FANOUT), np.repeat(gone, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    there = node < below
                    q, node, gone = q[there], node[there], gone[there]
            yield q + at, node


def _bits(words: np.ndarray) -> np.ndarray:
    """Bits that are set in all words together; the words are the rows."""
    return np.bitwise_count(words[0]) if len(words) == 1 else np.bitwise_count(words).sum(axis=0, dtype=np.int32)


def spanning(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest number in the component of each of ``n`` nodes, from chunks of links; memory stays at one chunk."""
    label = np.arange(n)
    for a, b in found:
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if np.array_equal(before, label):
                break
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


# --- dealing and linking --------------------------------------------------------------------------------------------


def segment_masks(segments: int, distance: int) -> list[int]:
    """Masks of the choices of ``segments - distance`` whole segments of 64 bits."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, segments - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _gray(word: Column) -> Column:
    rank = word
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))  # so that signed order is unsigned order


def blocks(distinct: DataFrame, distance: int, segments: int) -> DataFrame:
    """Blocks of the groups: choice of segments, value, top node (pattern, mask), size and the fingerprints.

    Rows are dealt by range of (choice, value, Gray rank), so a group of any size is spread over many tasks.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in segment_masks(segments, distance)])
    keyed = distinct.select("fp", _gray(F.col("fp")).alias("gray"), F.posexplode(masks).alias("choice", "mask"))
    keyed = keyed.select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "gray", "fp")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key, size = None, 0

        def block() -> pa.RecordBatch:
            fps = np.concatenate(held)
            pattern, mask = GrayIndex(fps.view(np.uint64)[None]).root
            row = [[key[0]], [key[1]], [int(pattern[0].astype(np.int64))], [int(mask[0].astype(np.int64))], [len(fps)], [fps.astype("<i8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["choice", "value", "pattern", "mask", "n", "fps"])

        for batch in batches:
            choice, value, fps = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((choice[1:] != choice[:-1]) | (value[1:] != value[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(fps)], strict=True):
                if a == b:
                    continue
                if key != (k := (int(choice[a]), int(value[a]))) and size:
                    yield block()
                    held, size = [], 0
                key = k
                while a < b:
                    take = min(b - a, BLOCK - size)
                    held.append(fps[a : a + take])
                    a, size = a + take, size + take
                    if size == BLOCK:
                        yield block()
                        held, size = [], 0
        if size:
            yield block()

    dealt = keyed.repartitionByRange("choice", "value", "gray").sortWithinPartitions("choice", "value", "gray").select("choice", "value", "fp")
    return dealt.mapInArrow(cut, "choice int, value long, pattern long, mask long, n int, fps binary")


def _links(left: np.ndarray, right: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one block, or of two blocks' fingerprints with each other."""
    if right is None:
        nodes, label = left, spanning(len(left), GrayIndex(left[None]).search(left[None], distance))
    else:
        nodes = np.concatenate([left, right])
        label = spanning(len(nodes), ((q, node + len(left)) for q, node in GrayIndex(right[None]).search(left[None], distance)))
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def links(distinct: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``, which span all components of those within ``distance`` bits.

    ``segments`` is by default the fewest for which an even share of the fingerprints fits a block, counted from the
    table; every number of segments gives the same components.
    """
    if segments is None:
        n, segments = distinct.count(), distance + 1
        while segments < distance + 4 and n >> ((segments - distance) * (64 // segments)) > BLOCK:
            segments += 1
    cut = staged(blocks(distinct, distance, segments).withColumn("block", F.monotonically_increasing_id()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [np.frombuffer(batch.column(c)[i].as_py(), "<u8") if batch.column(c)[i].is_valid else None for c in range(2)]
                a, b = _links(*sides, distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def found(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(search, "a long, b long").distinct()

    group = ["choice", "value"]
    within = staged(found(cut.where("n > 1").select("fps", F.lit(None).cast("binary").alias("fps2")).repartition(F.xxhash64("fps"))))
    several = staged(cut.groupBy(*group).agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("m > 1"))
    # A group that fits a block is in several only where a partition ends, so all its blocks meet: by their top nodes
    # first, and only pairs near enough on the bits that both share.
    tops = cut.select(*group, "block", "pattern", "mask").join(several.where(F.col("all") <= BLOCK).select(*group), group, "left_semi")
    other = tops.select(*group, *[F.col(c).alias(f"{c}2") for c in ("block", "pattern", "mask")])
    pairs = tops.join(other, group).where((F.col("block") < F.col("block2")) & (_apart() <= distance)).select("block", "block2")
    across = pairs.join(cut.select("block", "fps"), "block").join(cut.select(F.col("block").alias("block2"), F.col("fps").alias("fps2")), "block2").select("fps", "fps2")
    out = within.unionByName(found(across))
    large = several.where(F.col("all") > BLOCK).select(*group)
    return out if large.isEmpty() else out.unionByName(found(_stray_pairs(cut, large, within, distance)))


def _apart() -> Column:
    """Bits in which two top nodes differ among those that both share."""
    return F.bit_count(F.col("pattern").bitwiseXOR(F.col("pattern2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))


def _stray_pairs(cut: DataFrame, large: DataFrame, within: DataFrame, distance: int) -> DataFrame:
    """Pairs of blocks (``fps``, ``fps2``) of the large groups: what lies outside a group's largest piece, and each of its blocks.

    Pieces are the components that the links within blocks make, so a large group of near copies, which is one piece but
    for a few strays, costs as much as its size and not as its square.
    """
    group = ["choice", "value"]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                fps = np.frombuffer(batch.column(2)[i].as_py(), "<i8")
                key = [pa.array(np.full(len(fps), batch.column(c)[i].as_py()), t) for c, t in ((0, pa.int32()), (1, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*key, pa.array(fps)], names=["choice", "value", "fp"])

    blocks_of = staged(cut.join(large, group, "left_semi"))
    members = blocks_of.select(*group, "fps").mapInArrow(opened, "choice int, value long, fp long")
    pieces = components(within).select(F.col("node").alias("fp"), "root")
    mine = staged(members.join(pieces, "fp", "left").select(*group, "fp", F.coalesce("root", "fp").alias("piece")))
    counts = mine.groupBy(*group, "piece").agg(F.count("*").alias("n"))
    main = counts.groupBy(*group).agg(F.max_by("piece", F.struct("n", "piece")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    lots = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    strays = mine.join(main, group).where(F.col("piece") != F.col("main")).withColumn("lot", F.pmod(F.xxhash64("fp"), lots))
    all_and, all_or = F.bit_and("fp"), F.bit_or("fp")
    packed = staged(strays.groupBy(*group, "lot").agg(F.collect_list("fp").alias("fps"), all_and.alias("pattern2"), F.bitwise_not(all_and.bitwiseXOR(all_or)).alias("mask2")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed_fps = [x.values.to_numpy().tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(packed_fps, pa.binary()), batch.column(1)], names=["fps", "fps2"])

    met = packed.join(blocks_of.select(*group, "pattern", "mask", F.col("fps").alias("fps2")), group).where(_apart() <= distance)
    return met.select("fps", "fps2").mapInArrow(joined, "fps binary, fps2 binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b): the smallest node of its component.

    Large-star and small-star rounds until nothing changes. Each round aggregates smallest neighbours and joins them
    back, so a node of any degree is one row after the partial aggregation and its links may be split over tasks.
    """

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
        now = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if (then := state(now)) == seen:
            break
        seen = then
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (smallest key reachable over links) for each row of ``docs``.

    Texts without words, null ones included, have fingerprint 0, which links like any other. Repeated rows and exact
    copies share a fingerprint, so they count once in the search and each keeps its row in the result. Null keys are
    never the smallest unless a component has no other. Extra columns are ignored; an empty table gives no rows.
    """
    marked = staged(fingerprints(docs, key, text, shingle).select(F.col(key).alias("id"), "fp"))
    distinct = staged(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = staged(components(links(distinct.drop("least"), distance)))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(staged(named), "root").select("fp", "component_id"))
    return marked.join(named, "fp").select(F.col("id").alias(key), "fp", "component_id")


# --- near copies by exact Jaccard similarity ------------------------------------------------------------------------

#: Near copies are texts whose sets of five-word shingles have a Jaccard similarity of COPY_JACCARD (numerator, denominator).
COPY_SHINGLE, COPY_JACCARD = 5, (4, 5)
#: Bands of shingle minima, and the minima of each. Sets meet if a band is equal: a pair at exactly 0.8 is missed with a
#: probability of (1 - 0.8**5)**24, or 7 in 100,000; a pair at 0.3 meets with 6 %.
BANDS, MINIMA = 24, 5
#: Bands that are searched first. What they join needn't be searched again in the others.
FIRST_BANDS = 4
#: Words of a set's SimHash fingerprint, and bits of them in which near copies may differ. At exactly 0.8 that is 57 of
#: 384 with a deviation of 7 (72 for sets of four and five shingles), so the limit is over four deviations away.
COPY_WORDS, COPY_BITS = 6, 104
#: Fingerprints of a block, on average; sets and shingles of a block of sets.
WORD_BLOCK, COPY_BLOCK, COPY_SHINGLES = 4096, 256, 1 << 19
#: Rows up to which a side of keys is broadcast, counted before; beyond, the join is shuffled.
BROADCAST_KEYS = 500_000
#: A large group with more lots of strays than this is dealt anew, by so many choices of so many of the minima. A pair at
#: exactly 0.8 shares none of these choices with a probability of (1 - 0.8**8)**80, or 4 in 10 million.
MANY_LOTS, CHOICES, CHOSEN = 16, 80, 8


@dataclass(frozen=True)
class Rule:
    """What near copies are: how texts become sets, the similarity asked for, and the fingerprint that is compared first.

    ``sets`` gives each text's sorted distinct hashes; ``words`` a set's fingerprint (uint64) from it and its minima;
    ``near`` yields pairs of places in two arrays of fingerprints, one row for each word, that may be near copies: all
    pairs that are, but for a stated share, and each at most once.
    """

    jaccard: tuple[int, int]
    sets: Callable[[pa.Array], list[np.ndarray]]
    words: Callable[[np.ndarray, np.ndarray], np.ndarray]
    near: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def shingle_set(text: str | None, width: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles, its words being those of ``fingerprint``."""
    tokens = (text or "").encode("utf-8").lower().split()
    width = min(width, len(tokens))
    digest = xxhash.xxh64_intdigest
    flat, ends = b" ".join(tokens), np.cumsum([len(w) + 1 for w in tokens], dtype=np.int64) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(tokens) - width + 1].tolist(), ends[max(0, width - 1) :].tolist(), strict=True) if tokens else ()
    return np.unique(np.fromiter((digest(flat[s:e], SEED) for s, e in pairs), np.uint64))


def set_words(hashes: np.ndarray) -> np.ndarray:
    """SimHash words of a set of shingles: XXH64 gives the first, mixes of it (SplitMix64) the others."""
    total = np.zeros((COPY_WORDS, 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory, however long the text
        for k in range(COPY_WORDS):
            bits = np.unpackbits(mixed(hashes[at : at + (1 << 14)], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of independent hashes made from one; the 0-th is itself."""
    if k == 0:
        return hashes
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``BANDS * MINIMA`` hash functions over a set."""
    rng = np.random.default_rng(SEED)
    factor, shift = rng.integers(0, 2**64, (2, BANDS * MINIMA), np.uint64)
    factor |= np.uint64(1)
    least = np.full(BANDS * MINIMA, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):  # bounded memory, however long the text
        least = np.minimum(least, (factor[:, None] * hashes[None, at : at + (1 << 12)] + shift[:, None]).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One number for each band of a set's minima."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, MINIMA))], np.uint64)


def node_of(hashes: np.ndarray) -> int:
    """A hash of a whole set, which stands for it: texts of equal sets are one node."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def similar(docs: DataFrame, kind: str, rule: Rule) -> DataFrame:
    """``id``, ``node``, ``size`` (shingles), ``words`` (the fingerprint's bytes), ``bands`` and ``low`` (the minima's lowest bytes) of the rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = rule.sets(batch.column(1))
                node = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
                least = [minima(s) for s in sets]
                keys = np.concatenate([bands(x) for x in least]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys))
                words = pa.array([rule.words(s, x).tobytes() for s, x in zip(sets, least, strict=True)], pa.binary())
                low = pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), words, lists, low], names=["id", "node", "size", "words", "bands", "low"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, node long, size long, words binary, bands array<long>, low binary")


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """``node`` and ``hashes`` (the set's bytes) of the rows' ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                sets = rule.sets(whole.column(0).slice(at, 256))
                node = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    return docs.select("text").mapInArrow(run, "node long, hashes binary")


def near_copies(a: np.ndarray, b: np.ndarray, jaccard: tuple[int, int] = COPY_JACCARD) -> bool:
    """Whether two sorted sets have the Jaccard similarity of near copies."""
    over, under = jaccard
    most, both = min(len(a), len(b)), len(a) + len(b)
    if (over + under) * most < over * both:
        return False
    together = np.concatenate([a, b])
    together.sort(kind="stable")
    return (over + under) * int((together[1:] == together[:-1]).sum()) >= over * both


def _in_gray_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's rows in Gray order of their fingerprints, and the fingerprints, one row for each word."""
    words = np.stack([np.frombuffer(w.as_py(), "<u8") for w in rows["words"]], axis=1)
    order = np.argsort(gray_rank(words[0]), kind="stable")
    return rows.take(pa.array(order)), np.ascontiguousarray(words[:, order])


def _met(rows: pa.Table, rule: Rule) -> list[pa.RecordBatch]:
    """The rows of a block (value, choice, node, size, words) that are near another one's fingerprint."""
    rows, words = _in_gray_order(rows)
    near = np.zeros(rows.num_rows, bool)
    for q, found in rule.near(words, words):
        apart = q != found
        near[q[apart]] = near[found[apart]] = True
    return rows.filter(pa.array(near)).select(["value", "choice", "node", "size"]).to_batches()


def _joined(rows: pa.Table, rule: Rule) -> list[pa.RecordBatch]:
    """Links (a, b) among a block's rows, or from its strays to its others, that join pieces.

    Columns: node, piece, stray, words, hashes. The rule finds sets whose fingerprints are near; those of different
    pieces are compared exactly, until a set's piece has all that it is near to.
    """
    rows, words = _in_gray_order(rows)
    node, stray = rows["node"].to_numpy(), rows["stray"].to_numpy()
    _, label = np.unique(rows["piece"].to_numpy(), return_inverse=True)
    strays = bool(stray.any())
    left = np.flatnonzero(stray) if strays else np.arange(len(node))
    right = np.flatnonzero(~stray) if strays else left
    sets = rows["hashes"].combine_chunks()
    opened = lambda i: np.frombuffer(sets[i].as_buffer(), "<u8")
    a, b = [], []
    if not len(right) or (label == label[0]).all():
        return []
    for q, found in rule.near(words[:, left], words[:, right]):
        q, found = left[q], right[found]
        if not strays:
            q, found = q[found > q], found[found > q]
        near = np.argsort(q, kind="stable")
        q, found = q[near], found[near]
        for mine in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
            if not len(mine):
                continue
            i, others = int(q[mine[0]]), found[mine]
            while len(others := others[label[others] != label[i]]):
                j, others = int(others[0]), others[1:]
                if near_copies(opened(i), opened(j), rule.jaccard):
                    label[label == label[j]] = label[i]
                    a.append(node[i])
                    b.append(node[j])
    return [pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])]


def in_blocks(rows: DataFrame, block: list[str], use: Callable[[pa.Table], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """``use`` of each block's rows; blocks are dealt by their columns, which come first, and may be large or many.

    One sorted pass over each partition, so that small blocks cost no group of their own.
    """
    n = len(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def used() -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            return use(table) if table.num_rows > 1 else []

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in range(n)]
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if start == end:
                    continue
                if key != (k := tuple(int(x[start]) for x in keys)) and held:
                    yield from used()
                    held = []
                key = k
                held.append(batch.slice(start, end - start))
        if held:
            yield from used()

    others = [c for c in rows.columns if c not in block]
    return rows.select(*block, *others).repartition(*block).sortWithinPartitions(*block).mapInArrow(run, schema)


def bounded(keys: DataFrame) -> DataFrame:
    """A staged table of keys, marked for broadcast if it is counted to be small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _parts(rows: str = "rows", size: str = "shingles") -> Column:
    """Blocks of sets into which a group of so many sets, with so many shingles, is dealt."""
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / COPY_BLOCK), F.ceil(F.col(size) / COPY_SHINGLES)).cast("int")


def _block_links(dealt: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links of the blocks (value, i, j) of rows (node, piece, stray); the sets join them here."""
    rows = dealt.join(sets, "node").select("value", "i", "j", "node", "piece", "stray", "words", "hashes")
    return in_blocks(rows, ["value", "i", "j"], lambda table: _joined(table, rule), "a long, b long")


def _near_within(rows: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The rows (value, choice, node, size) that have another one's fingerprint near in their group; all of groups beyond a block."""
    groups = staged(rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"))
    shared = rows.join(bounded(groups), "value")
    small = shared.where(F.col("n") <= WORD_BLOCK).drop("n").join(nodes.select("node", "words"), "node")
    met = in_blocks(small.select("value", "choice", "node", "size", "words"), ["value"], lambda table: _met(table, rule), "value long, choice int, node long, size long")
    return met.unionByName(shared.where(F.col("n") > WORD_BLOCK).drop("n").select(*met.columns))


def near_rows(nodes: DataFrame, rule: Rule) -> DataFrame:
    """``value``, ``choice``, ``node`` and ``size`` of the nodes in each band's group in which another fingerprint is near.

    A band's value is a hash that holds the band's number, so it names the group. Of groups beyond a block of
    fingerprints, which are dealt into several, all nodes stay.
    """
    return _near_within(nodes.select("node", "size", F.posexplode("bands").alias("choice", "value")), nodes, rule)


def _dealt_anew(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (value, node, size) of large mixed groups, once for each of ``CHOICES`` choices of minima within their group."""
    columns = np.stack([np.random.default_rng((SEED, k)).choice(BANDS * MINIMA, CHOSEN, replace=False) for k in range(CHOICES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, BANDS * MINIMA)
                key = batch.column(0).to_numpy().view(np.uint64)[:, None] + np.arange(CHOICES, dtype=np.uint64)
                key = mixed(mixed(key, 1) ^ np.ascontiguousarray(low[:, columns]).view("<u8")[:, :, 0], 2)
                each = pa.array(np.repeat(np.arange(batch.num_rows), CHOICES))
                choice = pa.array(np.tile(np.arange(CHOICES, dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), choice, batch.column(1).take(each), batch.column(2).take(each)], names=["value", "choice", "node", "size"])

    return rows.select("value", "node", "size").join(nodes.select("node", "low"), "node").select("value", "node", "size", "low").mapInArrow(run, "value long, choice int, node long, size long")


def copy_links(keyed: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that span the components of near copies among the nodes.

    Sets with an equal band form a group, and those with a near fingerprint in their group are verified. Groups are
    dealt into blocks of bounded size, and each block is searched by its fingerprints. The first bands join most copies to
    pieces, so of the other bands only groups of several pieces are dealt. Where a group is more than one block and
    more than one piece, all its sets outside its largest piece (its strays) meet all of its blocks, each two blocks in
    a task. So a large group of near copies costs as much as its size, and only what differs from it is compared with
    all of it. A large group of unlike sets, which only share a passage, has too many strays for that: it is dealt anew
    by choices of its sets' minima, which unlike sets don't share, so its cost is in proportion to its size too.
    """
    rows = staged(near_rows(nodes, rule))
    wanted = staged(nodes.join(bounded(staged(rows.select("node").distinct())), "node", "left_semi").select("id", "node", "words"))
    texts = keyed.join(bounded(wanted.select("id")), "id", "left_semi")
    sets = staged(_sets(texts, rule).join(wanted.select("node", "words"), "node").dropDuplicates(["node"]))

    links = pieces = None
    for lot in (F.col("choice") < FIRST_BANDS, F.col("choice") >= FIRST_BANDS):
        found = staged(_block_links(_dealt(_in_pieces(rows.where(lot), pieces)), sets, rule))
        links = found if links is None else links.unionByName(found)
        pieces = staged(components(links))

    mine = _large(_in_pieces(rows, pieces))
    if mine is None:
        return links
    links = links.unionByName(staged(_block_links(_stray_blocks(mine.where(F.col("lots") <= MANY_LOTS)), sets, rule)))
    mixed_groups = mine.where(F.col("lots") > MANY_LOTS)
    if mixed_groups.isEmpty():
        return links
    anew = staged(_near_within(_dealt_anew(mixed_groups, nodes), nodes, rule))
    links = links.unionByName(staged(_block_links(_dealt(_in_pieces(anew, staged(components(links)))), sets, rule)))
    mine = _large(_in_pieces(anew, staged(components(links))))
    return links if mine is None else links.unionByName(staged(_block_links(_stray_blocks(mine), sets, rule)))


def _counted(mine: DataFrame) -> DataFrame:
    """Groups of several pieces, with the number of blocks that they are dealt into."""
    many = [F.count("*").alias("rows"), F.sum("size").alias("shingles"), F.min("piece").alias("least"), F.max("piece").alias("most")]
    return mine.groupBy("value").agg(*many).where("least < most").select("value", _parts().alias("parts"))


def _dealt(mine: DataFrame) -> DataFrame:
    """The rows of groups of several pieces, each in one of its group's blocks."""
    part = F.pmod(F.xxhash64("node", "choice"), "parts").cast("int")
    return mine.join(_counted(mine), "value").select("value", part.alias("i"), F.lit(0).alias("j"), "node", "piece", F.lit(False).alias("stray"))


def _large(mine: DataFrame) -> DataFrame | None:
    """The rows of groups of several pieces and several blocks, marked as strays or not, with the number of lots of strays; None if there are none."""
    large = staged(_counted(mine).where("parts > 1"))
    if large.isEmpty():
        return None
    mine = staged(mine.join(large, "value"))
    counts = mine.groupBy("value", "piece").agg(F.count("*").alias("n"))
    main = counts.groupBy("value").agg(F.max_by("piece", F.struct("n", "piece")).alias("main"))
    mine = mine.join(main, "value").withColumn("stray", F.col("piece") != F.col("main"))
    strays = mine.where("stray").groupBy("value").agg(F.count("*").alias("rows"), F.sum("size").alias("shingles")).select("value", _parts().alias("lots"))
    return staged(mine.join(strays, "value"))


def _stray_blocks(mine: DataFrame) -> DataFrame:
    """Each lot of a group's strays with each of the group's blocks."""
    part, lot = F.pmod(F.xxhash64("node"), "parts").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "lots").cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = mine.select("value", part.alias("i"), upto("lots").alias("j"), "node", "piece", F.lit(False).alias("stray"))
    return others.unionByName(mine.where("stray").select("value", upto("parts").alias("i"), lot.alias("j"), "node", "piece", "stray"))


def _in_pieces(rows: DataFrame, pieces: DataFrame | None) -> DataFrame:
    """Adds ``piece``, the smallest node that the row's is known to be connected with."""
    if pieces is None:
        return rows.withColumn("piece", F.col("node"))
    return rows.join(pieces, "node", "left").withColumn("piece", F.coalesce("root", "node")).drop("root")


def _gray_near(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return GrayIndex(right).search(left, COPY_BITS)


#: Near copies by their sets of five-word shingles, compared by their SimHash words in the Gray-order index.
COPIES = Rule(COPY_JACCARD, lambda texts: [shingle_set(t.as_py()) for t in texts], lambda hashes, least: set_words(hashes), _gray_near)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, with all its columns.

    Near duplicates have a Jaccard similarity of ``COPY_JACCARD`` or more over their sets of five-word shingles, and a
    group is a component of such links, each of them checked exactly. Texts without words have equal, empty sets. Rows
    are told apart by doc_id and text: those that repeat both are one, those that share a doc_id alone are not. Rows
    without a doc_id come after all others and go by their text's hash, so a group of such rows keeps one as well.
    What is dropped is counted; if it is few rows, no text is shuffled, else all are once.
    """
    ident = [F.col("doc_id").isNull().alias("anonymous"), F.coalesce("doc_id", F.xxhash64("text")).alias("ident"), F.xxhash64("text").alias("tie")]
    keyed = docs.select(F.struct(*ident).alias("id"), "text")
    kind = keyed.schema["id"].dataType.simpleString()
    marked = staged(similar(keyed, kind, COPIES))
    nodes = staged(marked.groupBy("node").agg(*[F.min(c).alias(c) for c in ("id", "size", "words", "bands", "low")]))
    roots = staged(components(copy_links(keyed, nodes, COPIES)))
    rooted = staged(nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")))
    kept = staged(rooted.groupBy("root").agg(F.min("id").alias("id")))
    ids = marked.groupBy("id").agg(F.count("*").alias("n"))
    dropped = staged(ids.join(kept, "id", "left_anti").select("id"))
    repeated = staged(ids.where("n > 1").join(kept, "id", "left_semi").select("id"))
    rows = docs.select(F.struct(*ident).alias("id"), F.struct(*docs.columns).alias("row")).join(bounded(dropped), "id", "left_anti")
    if not repeated.isEmpty():
        again = rows.join(bounded(repeated), "id", "left_semi").dropDuplicates(["id"])
        rows = rows.join(bounded(repeated), "id", "left_anti").unionByName(again)
    return rows.select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
