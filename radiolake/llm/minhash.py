"""Near-duplicate documents by b-bit MinHash.

A document's set of distinct word shingles becomes its minima under many hash functions. Sets that agree in all minima of
a band are candidates and meet in its group. Of each minimum only the lowest bits are kept and packed to a signature;
two candidates' signatures are compared by bit counts, and the share of equal minima is corrected for those that only
collide: it is J + (1 - J) / 2**b for sets of a similarity of J. Candidates whose estimate isn't far below the limit are
confirmed on their full sets. How groups of candidates are dealt, however large, is in :func:`simhash.copy_links`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import simhash, wordcodes
from radiolake.llm.common import documents, staged

#: Words of a shingle, and the Jaccard similarity (numerator, denominator) from which on documents are linked.
SHINGLE, JACCARD = 3, (85, 100)
#: Bits kept of each minimum. Their number times that of the minima is filled up to whole 64-bit words.
BITS = 2
#: Standard deviations by which a candidate's estimate may fall short of the limit; of pairs at exactly the limit about
#: one in a million falls shorter.
SHORT = 5.5
#: Pairs of signatures compared at once.
AT_ONCE = 1 << 18


def shingles(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; A-Z are lower-cased, ASCII white space separates words.

    A text with fewer words has one, of the whole sequence; one without words has none.
    """
    out = []
    for batch in wordcodes.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
        found, first = wordcodes.words(batch.column(0), lower=True)
        code, distinct = wordcodes.codes(found)
        digest = xxhash.xxh64_intdigest
        hashed = np.array([digest(w, simhash.SEED) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)[code]
        count = np.diff(first)
        whole = hashed if len(hashed) else np.zeros(0, np.uint64)
        mix = np.zeros(max(0, len(whole) - width + 1), np.uint64)
        for k in range(width):
            mix = simhash.mixed(mix ^ whole[k : k + len(mix)], k + 1)
        for row, n in enumerate(count.tolist()):
            at = first[row]
            if n >= width:
                out.append(np.unique(mix[at : at + n - width + 1]))
            else:
                short = np.zeros(min(n, 1), np.uint64)
                for w in whole[at : at + n]:
                    short = simhash.mixed(short ^ w, width + 1)
                out.append(short)
    return out


def signature(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The minima's lowest bits, packed into 64-bit words."""
    low = np.unpackbits(least.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :1], axis=1, bitorder="little", count=bits)
    return np.packbits(np.append(low.ravel(), np.zeros(-low.size % 64, np.uint8)), bitorder="little").view("<u8")


def unequal(left: np.ndarray, right: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Number of minima in which signatures (one row for each word) differ, by bit counts."""
    mask = np.uint64(sum(1 << k for k in range(0, 64, bits)))
    total = np.zeros(np.broadcast_shapes(left.shape[1:], right.shape[1:]), np.uint16)
    for a, b in zip(left, right, strict=True):
        x = a ^ b
        for k in (1 << i for i in range(bits.bit_length() - 1)):
            x = x | (x >> np.uint64(k))
        total += np.bitwise_count(x & mask)
    return total


def estimate(unequal_minima: np.ndarray, count: int, bits: int = BITS) -> np.ndarray:
    """Jaccard similarity from the number of unequal minima out of ``count``, corrected for collisions."""
    collide = 2.0**-bits
    return (1 - unequal_minima / count - collide) / (1 - collide)


def shortest(jaccard: tuple[int, int], count: int, bits: int = BITS, deviations: float = SHORT) -> int:
    """Unequal minima at most so many candidates may have: the mean at the limit and ``deviations`` of its spread."""
    differ = (1 - jaccard[0] / jaccard[1]) * (1 - 2.0**-bits)
    return math.floor(count * differ + deviations * math.sqrt(count * differ * (1 - differ)))


def near(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in two arrays of signatures whose estimated similarity may reach the limit."""
    count = simhash.BANDS * simhash.MINIMA
    least = estimate(shortest(JACCARD, count), count)
    step = max(1, AT_ONCE // max(1, right.shape[1]))
    for at in range(0, left.shape[1], step):
        q, found = np.nonzero(estimate(unequal(left[:, at : at + step, None], right[:, None, :]), count) >= least)
        if len(q):
            yield q + at, found


RULE = simhash.Rule(JACCARD, shingles, lambda hashes, least: signature(least), near)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key reachable over links) and ``kept`` for each row of ``docs``.

    Rows are linked if the Jaccard similarity of their sets of distinct shingles is ``JACCARD`` or more, each link being
    confirmed on the full sets (of 64-bit hashes). Texts without words, null ones included, have empty sets and link to
    nothing, so their ``component_id`` is their own key, null if that is null. Repeated rows and texts of one set count once in the search and
    each keeps its row in the result. A null key is never the smallest of a component unless it has no other. ``kept``
    says if the row's key is its component's, nulls being equal. Extra columns are ignored; an empty table gives no rows.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(F.col(key).isNull().alias("anonymous"), name.alias("name"), F.xxhash64(text).alias("tie")).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    own = F.when(~F.col("id.anonymous"), F.col("id.name").cast(kind))
    marked = staged(simhash.similar(keyed, keyed.schema["id"].dataType.simpleString(), RULE))
    nodes = marked.where("size > 0").groupBy("node").agg(*[F.min(c).alias(c) for c in ("id", "size", "words", "bands", "low")], F.min(own).alias("least"))
    nodes = staged(nodes)
    roots = staged(simhash.components(simhash.copy_links(keyed, nodes, RULE)))
    rooted = staged(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(staged(least), "root").select("node", "component_id"))
    rows = marked.select("node", "size", own.alias("own"))
    linked = rows.where("size > 0").join(named, "node").select("own", "size", "component_id")
    out = linked.unionByName(rows.where("size = 0").select("own", "size", F.col("own").alias("component_id")))
    return out.select(F.col("own").alias(key), F.col("size").alias("n_shingles"), "component_id", F.col("own").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op12_minhash": op12_minhash}
SQL: dict[str, str] = {}
