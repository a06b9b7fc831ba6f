"""Spelling variants: words of a vocabulary that are one error apart, by search schemes on bidirectional FM-indexes.

An error (one inserted, deleted or replaced code point) lies in one half of a word, so the other half is matched
exactly. Words are dealt by that half: a word asks where the words with its first half, and those with its second half,
are, and each word enters under the halves that words of its own length or one more or less may ask for. A task packs
words into blocks, writes each block as one delimited text and builds its FM-index, forwards and backwards. A search holds
the suffix-rank interval of its pattern in both; it starts at the delimiter, takes the exact half, extends over the other half with at most one error, branching
only into code points that do follow, and ends at the next delimiter. All searches of a block go in step.

The vocabulary itself is counted over all texts in batches, each word's rarely deleted code point included.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import wordcodes
from radiolake.llm.common import documents, staged
from radiolake.llm.simhash import bounded

#: Words have at least so many code points and occurrences; one of ``SLIPS`` loses a code point.
LEAST_LENGTH, LEAST_COUNT, SLIPS = 5, 3, 97
#: A word's form must be at least so many times as frequent.
TIMES = 2
#: Words of an FM-index, and searches that go in step.
BLOCK = 20_000
#: Intervals up to this size are read place by place for the code points that follow; larger ones are asked for each.
SMALL = 24
PREFIX, SUFFIX = 0, 1


# --- the vocabulary -----------------------------------------------------------------------------------------------


def _letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of a-z and of U+00C0 to U+00FF (C3 80 to C3 BF) in lower-cased UTF-8."""
    lead = data == 0xC3
    tail = np.concatenate([[False], lead[:-1]]) & (data >= 0x80) & (data < 0xC0) if len(data) else lead
    lead = lead & np.concatenate([tail[1:], [False]]) if len(data) else lead
    return ((data >= 97) & (data <= 122)) | tail | lead


#: One step of crc32 over a zero byte, for each lowest byte.
CRC = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)


def _slipped(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def occurrences(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """Words and their numbers of occurrences in the rows (key as text, text), after the deletions.

    crc32(key + ":" + word) is crc32(key + ":"), moved on by the word's bytes, with crc32(word) added, so it is worked out for
    each key and length and each distinct word rather than for each pair.
    """
    data, offsets = wordcodes.flat(batch.column(1))
    data = wordcodes.LOWER[data]
    inside = _letters(data)
    starts, ends, first = wordcodes.runs(inside, offsets)
    code, distinct = wordcodes.codes(wordcodes.cut(data, inside, starts, ends, pa.string()))
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    raw = distinct.cast(pa.binary()).to_pylist()
    own = np.array([zlib.crc32(w) for w in raw], np.uint32)
    sizes, size = np.unique(np.array([len(w) for w in raw], np.int64), return_inverse=True)
    moved = np.empty((batch.num_rows, len(sizes)), np.uint32)
    now = np.array([zlib.crc32(f"{k}:".encode()) for k in batch.column(0).to_pylist()], np.uint32)
    done = 0
    for j, upto in enumerate(sizes.tolist()):
        for _ in range(upto - done):
            now = (now >> np.uint32(8)) ^ CRC[now & np.uint32(255)]
        moved[:, j], done = now, upto
    keyed = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
    h = moved[row, size[code]] ^ own[code]
    slips = (h % SLIPS == 0) & keyed[row]
    words = distinct.to_pylist()
    counts = np.bincount(code[~slips], minlength=len(words))
    lost = [_slipped(words[c], int(x)) for c, x in zip(code[slips].tolist(), h[slips].tolist(), strict=True)]
    return words + lost, np.concatenate([counts, np.ones(len(lost), np.int64)])


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: the words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with only A-Z lower-cased. Where ``SLIPS`` divides the crc32
    of key, colon and word, the word stands without one code point, which the hash chooses; rows without a key have no such deletions.
    A null text has no words; repeated rows count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in wordcodes.slices(whole, 1):
                words, counts = occurrences(batch)
                found = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts)], names=["word", "n"])
                yield found.filter(pc.and_(pc.greater_equal(pc.utf8_length(found.column(0)), LEAST_LENGTH), pc.greater(found.column(1), 0)))

    found = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- the index ----------------------------------------------------------------------------------------------------


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a text that ends with a unique smallest code, by prefix doubling."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    fresh = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    open_, h = order, 1
    while True:
        # a suffix is settled if no other has its rank
        open_ = open_[np.bincount(rank, minlength=n)[rank[open_]] > 1]
        if not len(open_):
            break
        after = rank[np.minimum(open_ + h, n - 1)]
        order = np.lexsort((after, rank[open_]))
        open_, after = open_[order], after[order]
        base = rank[open_]
        at = np.arange(len(open_))
        group = np.concatenate([[True], base[1:] != base[:-1]])
        part = group | np.concatenate([[True], after[1:] != after[:-1]])
        rank[open_] = base + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Ranks:
    """For a text of codes: how many of a code, and how many smaller ones, stand before a place; bits in words of 64."""

    def __init__(self, codes: np.ndarray, sigma: int):
        n = len(codes)
        wide = -(-(n + 1) // 64)
        padded = np.full(wide * 64, sigma, np.int64)
        padded[:n] = codes
        pack = lambda marked: np.packbits(marked, bitorder="little").view("<u8")
        self.equal = np.stack([pack(padded == c) for c in range(sigma)])
        self.below = np.stack([pack(padded < c) for c in range(sigma)])
        before = lambda bits: np.concatenate([np.zeros((sigma, 1), np.int64), np.cumsum(np.bitwise_count(bits), axis=1, dtype=np.int64)], axis=1)
        self.equal_before, self.below_before = before(self.equal), before(self.below)

    def count(self, c: np.ndarray, at: np.ndarray, below: bool = False) -> np.ndarray:
        bits, before = (self.below, self.below_before) if below else (self.equal, self.equal_before)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[c, at >> 6] + np.bitwise_count(bits[c, at >> 6] & mask)


class TwoWayIndex:
    """A bidirectional FM-index over words, each with a delimiter before and after it.

    The text is read forwards and backwards. A pattern is an interval (first rank, first rank backwards, size) of the
    suffixes that begin with it, forwards, and with its mirror image, backwards; a code may be added at either end.
    """

    DELIMITER = 1

    def __init__(self, words: list[str]):
        text = "\x01" + "\x01".join(words) + "\x01"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        codes = np.searchsorted(self.alphabet, points).astype(np.int64) + self.DELIMITER
        self.sigma = len(self.alphabet) + self.DELIMITER
        self.word_at = np.cumsum(codes == self.DELIMITER) - 1  # the delimiter before a word stands for it
        forward, backward = np.append(codes, 0), np.append(codes[::-1], 0)
        self.suffixes = suffix_array(forward)
        # the codes before the sorted suffixes: forwards they extend a pattern to the left, backwards to the right
        self.left = forward[self.suffixes - 1]
        self.right = backward[suffix_array(backward) - 1]
        self.ranks = {False: Ranks(self.left, self.sigma), True: Ranks(self.right, self.sigma)}
        self.first = np.concatenate([[0], np.cumsum(np.bincount(forward, minlength=self.sigma))])

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Codes of the index, or -1 for code points that no word has."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + self.DELIMITER, -1)

    def extend(self, state: np.ndarray, c: np.ndarray, right: bool) -> np.ndarray:
        """The intervals (3, n) of the patterns with one more code each; unknown codes give empty ones."""
        own, other = (1, 0) if right else (0, 1)
        ranks, known = self.ranks[right], np.maximum(c, 0)
        lo, hi = state[own], state[own] + state[2]
        a, b = ranks.count(known, lo), ranks.count(known, hi)
        out = np.empty_like(state)
        out[own] = self.first[known] + a
        out[other] = state[other] + ranks.count(known, hi, True) - ranks.count(known, lo, True)
        out[2] = np.where(c >= 0, b - a, 0)
        return out

    def following(self, state: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a pattern's place and a code, delimiters apart, that stands after it (or before it)."""
        own, codes = (1, self.right) if right else (0, self.left)
        small = np.flatnonzero(state[2] <= SMALL)
        size = state[2, small]
        each = np.repeat(small, size)
        inside = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        pairs = [each * self.sigma + codes[state[own, each] + inside]]
        large = np.flatnonzero(state[2] > SMALL)
        for c in range(self.DELIMITER + 1, self.sigma):
            lo = state[own, large]
            there = self.ranks[right].count(np.full(len(large), c), lo + state[2, large]) > self.ranks[right].count(np.full(len(large), c), lo)
            pairs.append(large[there] * self.sigma + c)
        pair = np.unique(np.concatenate(pairs))
        pair = pair[pair % self.sigma > self.DELIMITER]
        return pair // self.sigma, pair % self.sigma

    def search(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word's place and that of an indexed word, with one error in the half that isn't the ``side`` one."""
        n, right = len(words), side == PREFIX
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size) - size
        codes = self.encode(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
        half = size // 2 if right else size - size // 2
        # the k-th code in the order of the search: from the left end to the right, or the other way
        code = lambda q, k: codes[begin[q] + (k if right else size[q] - 1 - k)]
        state = np.tile(np.array([[0], [0], [len(self.suffixes)]], np.int64), (1, n))
        state = self.extend(state, np.full(n, self.DELIMITER), right)
        q = np.arange(n)
        k = 0
        exact_q, exact = [], []
        while len(q):
            ready = half[q] == k
            exact_q.append(q[ready])
            exact.append(state[:, ready])
            q, state = q[~ready], state[:, ~ready]
            state = self.extend(state, code(q, np.full(len(q), k)), right)
            q, state, k = q[state[2] > 0], state[:, state[2] > 0], k + 1
        q, state = np.concatenate(exact_q), np.concatenate(exact, axis=1)
        at, wrong = half[q], np.zeros(len(q), bool)
        out = [np.zeros((2, 0), np.int64)]
        while len(q):
            done = at == size[q]
            ended = np.flatnonzero(done & wrong)
            last = self.extend(state[:, ended], np.full(len(ended), self.DELIMITER), right)
            hit = last[2] > 0
            place = self.suffixes[last[0, hit]]
            out.append(np.stack([q[ended[hit]], self.word_at[place]]))
            # without an error so far: one more code (inserted), another code (replaced), or none (deleted)
            free = np.flatnonzero(~wrong)
            which, c = self.following(state[:, free], right)
            source = free[which]
            more = self.extend(state[:, source], c, right)
            inside = ~done[source]
            replaced = inside & (c != np.where(inside, code(q[source], np.minimum(at[source], size[q[source]] - 1)), -1))
            parts = [(q[source], at[source], more, True), (q[source[replaced]], at[source[replaced]] + 1, more[:, replaced], True)]
            deleted = free[~done[free]]
            parts.append((q[deleted], at[deleted] + 1, state[:, deleted], True))
            going = np.flatnonzero(~done)
            same = self.extend(state[:, going], code(q[going], at[going]), right)
            live = same[2] > 0
            parts.append((q[going[live]], at[going[live]] + 1, same[:, live], wrong[going[live]]))
            q = np.concatenate([p[0] for p in parts])
            at = np.concatenate([p[1] for p in parts])
            state = np.concatenate([p[2] for p in parts], axis=1)
            wrong = np.concatenate([np.broadcast_to(p[3], len(p[0])) for p in parts])
            # one pattern may be reached by errors at several places; both intervals together tell patterns apart
            if len(q):
                _, only = np.unique(np.stack([q, at, wrong, *state]), axis=1, return_index=True)
                q, at, state, wrong = q[only], at[only], state[:, only], wrong[only]
        return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


# --- dealing ------------------------------------------------------------------------------------------------------


def keys(word: str) -> list[tuple[int, bool, int]]:
    """(side, whether the word asks or is found, hash of a half) of all halves under which a word is dealt.

    A word asks with its own halves; it is found by words of lengths one less to one more, which have two different
    lengths of halves at each side.
    """
    out = []
    for side in (PREFIX, SUFFIX):
        halves = {(m // 2 if side == PREFIX else m - m // 2) for m in (len(word) - 1, len(word), len(word) + 1)}
        own = len(word) // 2 if side == PREFIX else len(word) - len(word) // 2
        for h in sorted(halves):
            part = word[:h] if side == PREFIX else word[len(word) - h :]
            digest = xxhash.xxh64_intdigest(part, h * 2 + side) - (1 << 63)
            out.append((side, False, digest))
            if h == own:
                out.append((side, True, digest))
    return out


def near_words(vocab: DataFrame) -> DataFrame:
    """``word``, ``near`` and ``near_n`` for all pairs of the distinct words (word, n) that differ by exactly one error.

    A half that more than ``BLOCK`` words share is dealt into several blocks, and those who ask go to each of them. The
    words that ask are taken in lots, so a task holds one block and one lot, whatever it gets.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, a, h, i) for i, w in enumerate(batch.column(0).to_pylist()) for s, a, h in keys(w)]
            side, asks, half, row = (np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int32()), pa.array(half, pa.int64()), pa.array(asks.astype(bool)), batch.column(0).take(take), batch.column(1).take(take)], names=["side", "half", "asks", "word", "n"])

    dealt = staged(vocab.select("word", "n").mapInArrow(deal, "side int, half long, asks boolean, word string, n long"))
    counts = dealt.groupBy("side", "half").agg(F.count_if(~F.col("asks")).alias("words"), F.count_if("asks").alias("asking"))
    # a half with one word that only asks for itself has no pair
    large = staged(counts.where(F.col("words") > BLOCK).select("side", "half", F.ceil(F.col("words") / BLOCK).cast("int").alias("parts")))
    rows = dealt.join(bounded(large), ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    one = F.array(F.pmod(F.xxhash64("word"), "parts").cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(one)))
    rows = rows.select("side", "half", "part", "parts", "asks", "word", "n").repartition("side", "half", "part").sortWithinPartitions("side", "half", "part", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if start < end:
                    yield from block.take(tuple(key[:, start].tolist()), batch.slice(start, end - start))
        yield from block.searched()

    return rows.mapInArrow(search, "word string, near string, near_n long")


class _Block:
    """Whole groups (side, half, part, parts) of one side, up to ``BLOCK`` words to be found; of a long group those who ask in lots.

    A group that is dealt into parts has its blocks for itself, so that no other group's words are found there again.
    """

    def __init__(self):
        self.key, self.side = None, None
        self.clear()

    def clear(self) -> None:
        self.found: dict[str, int] = {}
        self.asking: list[str] = []
        self.index = None

    def take(self, key: tuple, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        alone = key[3] > 1 or (self.key is not None and self.key[3] > 1)
        if key != self.key and (alone or key[0] != self.side or len(self.found) + rows.num_rows > BLOCK):
            yield from self.searched()
            self.clear()
        self.key, self.side = key, key[0]
        asks = rows.column(4).to_numpy(zero_copy_only=False)
        words, n = rows.column(5).to_pylist(), rows.column(6).to_pylist()
        upto = int(np.argmax(asks)) if asks.any() else len(words)  # the words to be found come first in a group
        if upto:
            self.index = None
            self.found.update(zip(words[:upto], n[:upto], strict=True))
        for at in range(upto, len(words), BLOCK):
            self.asking += words[at : at + BLOCK]
            if len(self.asking) >= BLOCK and len(self.found) >= BLOCK // 2:
                yield from self.searched()

    def searched(self) -> Iterator[pa.RecordBatch]:
        asking, self.asking = list(dict.fromkeys(self.asking)), []
        if not asking or len(self.found) < 2:
            return
        words = list(self.found)
        self.index = self.index or TwoWayIndex(words)
        q, hit = self.index.search(asking, self.side)
        other = [words[i] for i in hit.tolist()]
        mine = [asking[i] for i in q.tolist()]
        # a pair that both sides find is the first one's
        keep = [w != v and not (self.side == SUFFIX and v.startswith(w[: len(w) // 2])) for w, v in zip(mine, other, strict=True)]
        out = [(w, v, self.found[v]) for w, v, k in zip(mine, other, keep, strict=True) if k]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], names=["word", "near", "near_n"])


def group_variants(vocab: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` for each row of a vocabulary (word, n).

    A word's form is the most frequent word near it (of equal ones the first by code points), if that is at least
    ``TIMES`` times as frequent, else null; its root is the last of the forms that it leads to. Counts at least double at each
    step, so there are few; they are followed by doubling. A word without near ones is its own root. Null words and counts are left out; an
    empty vocabulary gives no rows.
    """
    vocab = staged(vocab.where("word is not null and n is not null").select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= TIMES * F.col("n")
    known = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    known = staged(known)
    leading = staged(known.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = leading.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(leading.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        leading = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return known.join(leading, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(documents(spark, sf_dir)))


QUERIES = {"op13_spelling": op13_spelling}
SQL: dict[str, str] = {}
