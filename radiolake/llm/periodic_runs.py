"""Periodic runs of words by an enhanced suffix array and its branching tandem repeats.

The words of a batch of documents become numbers, and the suffixes of all documents one suffix array (prefix doubling,
each round only over suffixes that are not yet told apart), its inverse and its table of longest common prefixes (from
irreducible places by a running maximum). An LCP interval of depth d holds the suffixes that share d words. A tandem
repeat of period d at i is two equal stretches of d words, so suffixes i and i + d lie in one interval of that depth;
it branches if it can't be shifted to the right, and then the two lie in different children of the interval. So it is
enough to take each suffix i of all children but the largest and to ask if i + d or i - d lies between the interval's
bounds by the inverse array: every suffix is asked for at most a logarithmic number of times. A branching repeat shifted to the left as far as it goes
is a run; of the periods that give one stretch the smallest is its own. There are no tree nodes: intervals are pairs of
bounds, found for all places at once on a tree of block minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import wordcodes
from radiolake.llm.common import documents, let, words

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of two places compared at once, at least, and suffixes of children asked for at once.
STEP, AT_ONCE = 32, 1 << 19
RUN = "array<struct<start:long,length:long,period:long>>"


# --- the enhanced suffix array ------------------------------------------------------------------------------------


def suffix_ranks(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of each suffix in sorted order; ``end`` is the end of its document, whose suffixes stand together."""
    n = len(codes)
    order = np.lexsort((codes, end))
    rank, open_ = np.empty(n, np.int64), order
    keys = (end[order], codes[order])
    fresh, h = np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])]), 1
    base = np.zeros(n, np.int64)
    while len(open_):
        # a group is named by the place of its first suffix, so splitting one leaves all others as they are
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))
        old = np.maximum.accumulate(np.where(np.concatenate([[True], base[1:] != base[:-1]]), np.arange(len(open_)), 0))
        rank[open_] = base + first - old
        last = np.concatenate([fresh[1:], [True]])
        open_ = open_[~(fresh & last)]
        after = np.where(open_ + h < end[open_], rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        order = np.lexsort((after, rank[open_]))
        open_, after = open_[order], after[order]
        base = rank[open_]
        fresh = np.concatenate([[True], (base[1:] != base[:-1]) | (after[1:] != after[:-1])])[: len(open_)]
        h *= 2
    return rank


def in_common(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words from places ``a`` and ``b`` on (``way`` 1 or -1) agree, at most ``most`` for each pair."""
    out = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        step = max(STEP, min(1 << 12, (1 << 16) // len(open_)))  # few pairs are compared over more words
        at = out[open_, None] + np.arange(step)
        inside = at < most[open_, None]
        at = np.where(inside, at, 0) * way
        same = inside & (codes[a[open_, None] + at] == codes[b[open_, None] + at])
        got = np.where(same.all(axis=1), step, np.argmin(same, axis=1))
        out[open_] += got
        open_ = open_[got == step]
    return out


def common_prefixes(codes: np.ndarray, end: np.ndarray, rank: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Words that the suffix at each place of the sorted order shares with the one before it; 0 across documents."""
    n = len(codes)
    place = np.arange(n)
    before = np.where(rank > 0, suffixes[rank - 1], -1)
    before = np.where((before >= 0) & (end[before] == end), before, -1)
    starts = np.concatenate([[True], end[1:] != end[:-1]])
    reducible = (before >= 0) & ~starts
    reducible &= ~starts[np.maximum(before, 0)] & (codes[np.maximum(place - 1, 0)] == codes[np.maximum(before - 1, 0)])
    asked = np.flatnonzero(~reducible & (before >= 0))
    reach = np.zeros(n, np.int64)
    reach[~reducible] = place[~reducible]
    reach[asked] += in_common(codes, asked, before[asked], end[asked] - np.maximum(asked, before[asked]), 1)
    out = np.empty(n, np.int64)
    out[rank] = np.maximum.accumulate(reach) - place
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the first one after it with a smaller value, or the end; by a tree of pairwise minima."""
    n = len(values)
    low = -1
    levels = [np.append(values, low)]
    while len(levels[-1]) > 1:
        under = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], low)
        levels.append(np.minimum(under[::2], under[1::2]))
    at, level = np.arange(1, n + 1), np.zeros(n, np.int64)
    climbing = np.arange(n)
    for k, tree in enumerate(levels):
        # go up until a node that begins here holds something smaller
        odd = climbing[(at[climbing] >> k) % 2 == 1] if k < len(levels) - 1 else climbing
        stop = tree[np.minimum(at[odd] >> k, len(tree) - 1)] < values[odd]
        level[odd[stop]] = k
        at[odd[~stop]] += 1 << k
        done = np.zeros(n, bool)
        done[odd[stop]] = True
        climbing = climbing[~done[climbing]]
        if not len(climbing):
            break
    for k in range(len(levels) - 2, -1, -1):
        down = np.flatnonzero(level > k)
        skip = levels[k][np.minimum(at[down] >> k, len(levels[k]) - 1)] >= values[down]
        at[down[skip]] += 1 << k
    return at


# --- runs ---------------------------------------------------------------------------------------------------------


def tandems(codes: np.ndarray, end: np.ndarray, rank: np.ndarray, suffixes: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the branching tandem repeats that can end a long enough run."""
    n = len(codes)
    begin = np.concatenate([[0], np.flatnonzero(end[1:] != end[:-1]) + 1]) if n else np.zeros(0, np.int64)
    begin = np.repeat(begin, np.diff(np.append(begin, n)))
    right = next_smaller(lcp) - 1
    left = n - 1 - next_smaller(lcp[::-1])[::-1]
    size = right - left + 1
    # words at the run's first places stand LEAST_PERIODS times or more, and that many periods must fit the document
    use = np.flatnonzero((lcp > 0) & (size >= LEAST_PERIODS) & (LEAST_PERIODS * lcp <= (end - begin)[suffixes]))
    order = use[np.lexsort((use, left[use]))]
    depth, lb, rb = lcp[order], left[order], right[order]
    order = np.lexsort((order, depth, lb))
    at, depth, lb, rb = use[np.lexsort((use, left[use]))][order], depth[order], lb[order], rb[order]
    # the children of an interval lie between its places of smallest LCP; the last one ends with the interval
    fresh = np.concatenate([[True], (lb[1:] != lb[:-1]) | (depth[1:] != depth[:-1])])[: len(at)]
    last = np.concatenate([fresh[1:], [True]])[: len(at)]
    interval = np.cumsum(fresh) - 1
    from_ = np.concatenate([np.where(fresh, lb, np.concatenate([[0], at[:-1]])), at[last]])
    upto = np.concatenate([at, rb[last] + 1])
    interval = np.concatenate([interval, interval[last]])
    depth, lb, rb = (np.concatenate([x, x[last]]) for x in (depth, lb, rb))
    width = upto - from_
    order = np.lexsort((from_, -width, interval))
    largest = np.zeros(len(width), bool)
    largest[order[np.concatenate([[True], interval[order][1:] != interval[order][:-1]])[: len(order)]]] = True
    children = np.flatnonzero(~largest)
    places, periods = [], []
    ends = np.cumsum(width[children])
    done = 0
    while done < len(children):
        upto_child = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, "right")))
        part = children[done:upto_child]
        done = upto_child
        mine = np.repeat(part, width[part])
        inside = np.arange(len(mine)) - np.repeat(np.cumsum(width[part]) - width[part], width[part])
        i, d, lo, hi = suffixes[from_[mine] + inside], depth[mine], lb[mine], rb[mine]
        for first, other in ((i, i + d), (i - d, i - d)):
            there = (other >= begin[i]) & (other < end[i])
            r = rank[np.where(there, other, 0)]
            there &= (r >= lo) & (r <= hi)
            a, p = first[there], d[there]
            stop = end[a]
            branching = (a + 2 * p >= stop) | (codes[np.minimum(a + p, n - 1)] != codes[np.minimum(a + 2 * p, n - 1)])
            places.append(a[branching])
            periods.append(p[branching])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.unique(np.stack([np.concatenate(places), np.concatenate(periods)]), axis=1)
    return found[0], found[1]


def runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of the documents whose first words (and the end) are ``first``.

    A document without five equal consecutive words at two places has no run; only the others' suffixes are sorted.
    """
    size = np.diff(first)
    end = np.repeat(first[1:], size)
    inner = _repeating(codes, end)
    keep = np.zeros(len(size), bool)
    keep[np.repeat(np.arange(len(size)), size)[inner]] = True
    kept = np.flatnonzero(np.repeat(keep, size))
    if not len(kept):
        return (np.zeros(0, np.int64),) * 3
    own, size = codes[kept], size[keep]
    end = np.repeat(np.cumsum(size), size)
    rank = suffix_ranks(own, end)
    suffixes = np.empty_like(rank)
    suffixes[rank] = np.arange(len(rank))
    at, period = tandems(own, end, rank, suffixes, common_prefixes(own, end, rank, suffixes))
    begin = np.repeat(np.cumsum(size) - size, size)
    start, length, period = _merged(own, begin, at, period)
    order = np.lexsort((period, start))
    return kept[start[order]], length[order], period[order]


def _merged(codes: np.ndarray, begin: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The long enough runs (start, length, period) that branching repeats end, each once, with its smallest period.

    Repeats that end at one place are taken by period. Once the smallest has been shifted to its run's start, those
    whose two periods fit this run repeat a multiple of its period, so they are the same run and are done with it. What
    is left is longer, so the rounds are few and no run is walked through again for its multiples.
    """
    order = np.lexsort((period, at + 2 * period))
    at, period = at[order], period[order]
    out = [np.zeros((3, 0), np.int64)]
    while len(at):
        stop = at + 2 * period
        smallest = np.concatenate([[True], stop[1:] != stop[:-1]])
        group = np.cumsum(smallest) - 1
        i, q = at[smallest], period[smallest]
        back = in_common(codes, np.maximum(i - 1, 0), np.maximum(i + q - 1, 0), i - begin[i], -1)
        length = back + 2 * q
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        out.append(np.stack([i - back, length, q])[:, long])
        left = 2 * period > length[group]
        at, period = at[left], period[left]
    return tuple(np.concatenate(out, axis=1))


def _repeating(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places whose next words, as many as two places of any run share, come again in the document (or seem to, by a hash)."""
    width = LEAST_WORDS - 1
    whole = np.flatnonzero(np.arange(len(codes)) + width <= end)
    hashed = end[whole].astype(np.uint64)
    for k in range(width):
        hashed = (hashed ^ codes[whole + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    order = np.argsort(hashed)
    again = np.flatnonzero(hashed[order][1:] == hashed[order][:-1])
    return whole[order[again]]


# --- documents ----------------------------------------------------------------------------------------------------


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed`` for each row.

    A run is a stretch of consecutive words with smallest period q, of at least ``LEAST_WORDS`` words and
    ``LEAST_PERIODS`` periods, that no neighbour extends. ``collapsed`` is the text's words joined by one space, without
    those that lie in a run after its first period. Words are runs without ASCII white space, compared as they are.

    A null or empty text has no words, no runs and an empty ``collapsed``; each repeated row is worked on by itself, as
    are rows with a null or equal key; a text is one unit of work, however long, with memory in proportion to its
    words; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in wordcodes.slices(whole, 1):
                found, first = wordcodes.words(batch.column(1))
                start, length, period = runs(wordcodes.codes(found)[0], first)
                row = np.searchsorted(first, start, "right") - 1
                drop = np.zeros(len(found) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                keep = np.cumsum(drop)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(keep)])[first]
                collapsed = wordcodes.joined(found if keep.all() else found.filter(pa.array(keep)), left)
                each = pa.StructArray.from_arrays([pa.array(start - first[row]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), lists, collapsed], names=["key", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return found.mapInArrow(run, f"key {kind}, n_words long, runs {RUN}, collapsed string").withColumnRenamed("key", key)


def made_periodic(key: Column, text: Column) -> Column:
    """The text, but for keys whose crc32 is divisible by 10: of these the words from a place on repeat a period.

    Place and period come from the same hash. A row without a key stays as it is.
    """
    h = F.crc32(key.cast("string").cast("binary"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (source(i) + 1).cast("int")))
        return F.when(n > 0, F.array_join(made, " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    # quotients of whole numbers below 2**26 are equal as doubles only if they are equal
    rated = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_max(rated).alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return best.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL: dict[str, str] = {}
