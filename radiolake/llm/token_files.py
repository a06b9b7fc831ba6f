"""Token ids in a word-aligned binary format, written in document order and read back.

Ids are packed by Simple-8b: each 64-bit little-endian word has a 4-bit selector and as many ids of equal width as fit
the other 60 bits. An id over 60 bits is an escape: its word names a place in the block's list of raw words. A file has

    magic ``TID1``, then four counts as int64: documents, ids, blocks, raw words
    for each document: ids (int64)
    for each block of up to 4096 ids: first word, words, first raw word, ids (int64)
    the packed words, the raw words (uint64)

so any block can be decoded by itself, and all words of a selector at once. Files travel as a binary column of a table
in the shared folder: Spark's writers commit them, so a task that is lost and run again leaves no half file.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from radiolake.llm.bpe import slices, spread
from radiolake.llm.common import documents, staged

VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Ids in one word for each selector; 60 // n bits each. Selector 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([60 // n if n else 0 for n in COUNTS])
ESCAPE, BLOCK_IDS, MAGIC = 15, 4096, b"TID1"
#: Ids after which a file is closed (at the next document's end), and ids that are packed at a time (whole blocks).
FILE_IDS, PACK_IDS = 1_000_000, 64 * BLOCK_IDS
#: Bytes of texts that are encoded together, and characters of their different parts.
BATCH_BYTES, TOGETHER = 6_000_000, 5_000
#: Bytes of texts of a range of keys, and files up to which their first places are broadcast (three numbers each).
RANGE_BYTES, BROADCAST_FILES = 32_000_000, 100_000
#: Ranges at most, whatever the corpus: their ends are a list on the driver and in each task. Beyond RANGE_BYTES times this, ranges grow;
#: each is sorted on disk, and a file of it is as small as any other.
MOST_RANGES = 20_000


# --- Simple-8b ------------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, raw words and block table (first word, words, first raw word, ids) of unsigned ids.

    Each word takes as many ids as fit. The narrowest selector for each place comes from the widest id of each length
    of window, and the words of all blocks are found step by step together, as no word goes on into the next block.
    """
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
    n_blocks = -(-len(ids) // BLOCK_IDS)
    # for each id the first selector that is wide enough; zeros behind each block
    need = np.zeros((n_blocks, BLOCK_IDS + int(COUNTS[0])), np.uint8)
    own = np.zeros(n_blocks * BLOCK_IDS, np.uint8)
    own[: len(ids)] = narrowest(ids)
    need[:, :BLOCK_IDS] = own.reshape(n_blocks, BLOCK_IDS)
    widest, best = {1: need}, np.where(need < ESCAPE, 13, ESCAPE).astype(np.uint8)[:, :BLOCK_IDS]
    for selector in range(12, -1, -1):
        n = int(COUNTS[selector])
        half = max(k for k in widest if k >= (n + 1) // 2)
        window = need.copy()
        window[:, : need.shape[1] - n + half] = np.maximum(widest[half][:, : need.shape[1] - n + half], widest[half][:, n - half :])
        widest = {k: w for k, w in widest.items() if 2 * k > n} | {n: window}
        best[window[:, :BLOCK_IDS] <= selector] = selector
    best = best.reshape(-1)
    at = np.arange(n_blocks, dtype=np.int64) * BLOCK_IDS
    stop = np.minimum(at + BLOCK_IDS, len(ids))
    is_start = np.zeros(len(ids), bool)
    while len(at):
        is_start[at] = True
        at = at + COUNTS[best[at]]
        at, stop = at[at < stop], stop[at < stop]
    starts = np.flatnonzero(is_start)
    chosen = best[starts].astype(np.int64)
    left = np.minimum(BLOCK_IDS - starts % BLOCK_IDS, len(ids) - starts)
    taken = np.minimum(COUNTS[chosen], left)
    words = chosen.astype(np.uint64)
    raw = ids[starts[chosen == ESCAPE]].astype(np.uint64)
    for selector in np.unique(chosen):
        which = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            continue
        full = which[taken[which] == COUNTS[selector]]
        for k in range(COUNTS[selector]):
            some = full if len(full) == len(which) else which[taken[which] > k]
            words[some] |= ids[starts[some] + k].astype(np.uint64) << np.uint64(4 + k * WIDTHS[selector])
    first = np.searchsorted(starts, np.arange(0, len(ids), BLOCK_IDS))
    last = np.append(first[1:], len(starts))
    raws = np.concatenate([[0], np.cumsum(chosen == ESCAPE)])
    within = np.flatnonzero(chosen == ESCAPE)
    block = np.searchsorted(first, within, side="right") - 1
    words[within] |= (np.arange(len(within)) - raws[first[block]]).astype(np.uint64) << np.uint64(4)
    counts = np.minimum(BLOCK_IDS, len(ids) - np.arange(0, len(ids), BLOCK_IDS))
    return words, raw, np.stack([first, last - first, raws[first], counts], axis=1).astype(np.int64)


def narrowest(ids: np.ndarray) -> np.ndarray:
    """For each id the first selector whose width holds it, or the escape."""
    limits = np.array([1 << int(w) for w in WIDTHS[:14]], np.uint64)
    find = lambda x: np.searchsorted(limits, x, "right").astype(np.uint8)
    if ids.max() < 1 << 16:
        return find(np.arange(1 << 16, dtype=np.uint64))[ids.astype(np.uint16)]
    need = find(ids.astype(np.uint64))
    return np.where(need > 13, ESCAPE, need).astype(np.uint8)


def unpack(words: np.ndarray, raw: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The ids of some blocks one after the other; all words of a selector at a time."""
    if not len(blocks):
        return np.zeros(0, np.uint64)
    # words of the wanted blocks, and for each the ids that its block has up to and with it
    sizes = blocks[:, 1]
    which = np.repeat(blocks[:, 0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    chosen = (words[which] & np.uint64(15)).astype(np.int64)
    upto = np.cumsum(COUNTS[chosen])
    ends = np.cumsum(sizes) - 1
    before_block = np.concatenate([[0], upto[ends][:-1]])
    filled = np.minimum(upto - np.repeat(before_block, sizes), np.repeat(blocks[:, 3], sizes))  # the last word may not be full
    base = np.repeat(np.concatenate([[0], np.cumsum(blocks[:, 3])[:-1]]), sizes)
    end = base + filled
    start = np.concatenate([[0], end[:-1]])
    out = np.zeros(int(blocks[:, 3].sum()), np.uint64)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        word = words[which[mine]] >> np.uint64(4)
        if selector == ESCAPE:
            out[start[mine]] = raw[np.repeat(blocks[:, 2], sizes)[mine] + word.astype(np.int64)]
            continue
        width = np.uint64(WIDTHS[selector])
        for k in range(COUNTS[selector]):
            full = start[mine] + k < end[mine]
            out[start[mine][full] + k] = (word[full] >> (np.uint64(k) * width)) & ((np.uint64(1) << width) - np.uint64(1))
    return out


def to_file(documents_ids: list[np.ndarray]) -> bytes:
    """The bytes of a file that holds the ids of some documents."""
    ids = np.concatenate([np.zeros(0, np.uint16), *documents_ids])
    counts = np.array([len(x) for x in documents_ids], "<i8").tobytes()
    packed, n_words, n_raw = [], 0, 0
    for at in range(0, len(ids), PACK_IDS):  # whole blocks, for bounded memory
        words, raw, blocks = pack(ids[at : at + PACK_IDS])
        packed.append((words, raw, blocks + np.array([n_words, 0, n_raw, 0])))
        n_words, n_raw = n_words + len(words), n_raw + len(raw)
    words, raw, blocks = (np.concatenate(x) for x in zip(*(packed or [pack(ids)]), strict=True))
    head = np.array([len(documents_ids), len(ids), len(blocks), len(raw)], "<i8").tobytes()
    return b"".join([MAGIC, head, counts, blocks.astype("<i8").tobytes(), words.astype("<u8").tobytes(), raw.astype("<u8").tobytes()])


def from_file(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each document (their number) and all ids, from a file's bytes."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks, n_raw = np.frombuffer(content, "<i8", 4, 4).tolist()
    at = 4 + 32
    counts = np.frombuffer(content, "<i8", n_docs, at)
    at += 8 * n_docs
    blocks = np.frombuffer(content, "<i8", 4 * n_blocks, at).reshape(-1, 4)
    at += 32 * n_blocks
    words = np.frombuffer(content, "<u8", (len(content) - at) // 8 - n_raw, at)
    raw = np.frombuffer(content, "<u8", n_raw, len(content) - 8 * n_raw)
    ids = unpack(words, raw, blocks)
    if len(ids) != n_ids:
        raise ValueError("a token file's counts disagree")
    return counts, ids


# --- encoding -------------------------------------------------------------------------------------------------------


class Parts:
    """The vocabulary's ids of the parts of texts between blanks. A worker loads each vocabulary once.

    The vocabulary's normalizer turns white space into blanks and no token holds any, so the ids of a text are those
    of its parts one after the other, and each part of a batch of texts is encoded once.
    """

    loaded: dict[str, Parts] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    @classmethod
    def load(cls, path: str) -> Parts:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def encode_joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts one after the other, and how many each has.

        Some thousand characters are encoded as one text, on which the library is fastest; a token belongs to the part
        in which it begins.
        """
        ids, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(parts):
            some, size = [], 0
            while at < len(parts) and size < TOGETHER:
                some.append(parts[at])
                size += len(parts[at])
                at += 1
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begin = np.array([o[0] for o in found.offsets], np.int64)
            starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in some])])
            ids.append(np.array(found.ids, np.uint32))
            counts.append(np.diff(np.searchsorted(begin, starts)))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces one after the other, and how many each has.

        What the normalizer and the pre-tokenizer leave as it is, small ASCII letters, goes to the vocabulary's model
        itself; anything else takes the whole way.
        """
        letters = pc.match_substring_regex(pieces, "^[a-z]+$")
        tokens = list(map(self.tokenizer.model.tokenize, pieces.filter(letters).to_pylist()))
        rest, n_rest = self.encode_joined(pieces.filter(pc.invert(letters)).to_pylist())
        letters = letters.to_numpy(zero_copy_only=False)
        size, start = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        flat = np.array([t.id for found in tokens for t in found], np.uint32)
        size[letters], size[~letters] = list(map(len, tokens)), n_rest
        for of, n, base in ((letters, size[letters], 0), (~letters, n_rest, len(flat))):
            start[of] = base + np.cumsum(n) - n
        return spread(np.concatenate([flat, rest]), start, size), size

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, each with the end id if there is one, and how many each has.

        Parts in ASCII are lower-cased before they are compared, as the normalizer would, and a mark that follows a
        letter is cut off, as the pre-tokenizer would.
        """
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
        ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        words = cut.flatten().dictionary_encode()
        known = words.dictionary
        known = pc.if_else(pc.string_is_ascii(known), pc.ascii_lower(known), known)
        parts = pc.split_pattern(pc.replace_substring_regex(known, "([a-z])([.,;:!?])", "\\1 \\2"), " ")
        pieces = parts.flatten().dictionary_encode()
        ids, size = self.encode_pieces(pieces.dictionary)
        order = pieces.indices.to_numpy()
        flat = spread(ids, (np.cumsum(size) - size)[order], size[order])
        upto = np.concatenate([[0], np.cumsum(size[order])])[parts.offsets.to_numpy()]
        start, size, index = upto[:-1], np.diff(upto), words.indices.to_numpy()
        if end_id is not None:
            index = np.insert(index, ends[1:], len(size))
            flat, start, size = np.append(flat, np.uint32(end_id)), np.append(start, len(flat)), np.append(size, 1)
            ends = ends + np.arange(len(ends))
        counts = size[index]
        sums = np.concatenate([[0], np.cumsum(counts)])
        return spread(flat, start[index], counts), np.diff(sums[ends])


def encoded(docs: DataFrame, vocabulary: str, end_id: int | None, ends: list) -> DataFrame:
    """``part``, ``key``, ``tie``, and ``ids`` of the rows' ``text``: their width in bytes, 2 or 4, and then the ids.

    ``part`` is the number of ranges that end before the row, found in their sorted ends, one for each partition.
    """
    kind = docs.schema["key"].dataType.simpleString()
    last = [(k is not None, k, tie) for k, tie in ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts.load(vocabulary)
        for batch in batches:
            for some in slices(batch.column(2), BATCH_BYTES):
                key, tie, texts = (batch.column(c)[some] for c in range(3))
                ids, counts = parts.encode(texts, end_id)
                width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
                raw, head = ids.astype(f"<u{width}").tobytes(), bytes([width])
                upto = (width * np.concatenate([[0], np.cumsum(counts)])).tolist()
                packed = [head + raw[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]
                part = [bisect_left(last, (k is not None, k, t)) for k, t in zip(key.to_pylist(), tie.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), key, tie, pa.array(packed, pa.binary())], names=["part", "key", "tie", "ids"])

    return docs.select("key", "tie", "text").mapInArrow(run, f"part int, key {kind}, tie long, ids binary")


def unwrapped(raw: bytes) -> np.ndarray:
    """The ids of one row of :func:`encoded`."""
    return np.frombuffer(raw, f"<u{raw[0]}", -1, 1)


def range_ends(keys: DataFrame, n: int) -> list:
    """Last (key, tie) of each of ``n`` even ranges but the last; only keys are dealt, and ``n`` rows collected."""
    dealt = keys.repartitionByRange(n, F.col("key").asc_nulls_first(), F.col("tie").asc()).withColumn("part", F.spark_partition_id())
    ends = dealt.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("end")).orderBy("part").collect()
    return [r["end"] for r in ends[:-1]]


def write_files(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Encodes every text and writes the ids as files in ascending order of the key; the table of files.

    Each row is a file: ``part`` and ``seq`` (their order is the order of the documents), ``n_ids``, the documents'
    ``keys`` and the file's ``content``. Null keys come first; rows of equal keys are ordered by their text's hash. A
    null text is empty and has the end id alone. Texts are encoded where they are read, and the ids, a fraction of
    their size, are dealt by range of the key; the ranges come from the keys alone, as many as the texts' size asks
    for, up to MOST_RANGES. A file is closed after FILE_IDS ids.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    keys = staged(rows.select("key", "tie", F.octet_length("text").cast("long").alias("bytes")))
    n = min(MOST_RANGES, max(1, -(-(keys.agg(F.sum("bytes")).first()[0] or 0) // RANGE_BYTES)))
    ends = range_ends(keys, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part, keys, found, size = 0, None, [], [], 0
        kinds = pa.int64()

        def file() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), pa.array([keys], pa.list_(kinds)), pa.array([to_file(found)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_ids", "keys", "content"])

        for batch in batches:
            kinds = batch.schema.field(1).type
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py()
                if keys and (own != part or size >= FILE_IDS):
                    yield file()
                    keys, found, size, seq = [], [], 0, seq + 1
                part = own
                keys.append(batch.column(1)[i].as_py())
                found.append(unwrapped(batch.column(2)[i].as_py()))
                size += len(found[-1])
        if keys:
            yield file()

    dealt = encoded(rows, path, end_id, ends).repartitionById(n, "part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "tie").select("part", "key", "ids")
    return staged(dealt.mapInArrow(run, f"part int, seq long, n_ids long, keys array<{kind}>, content binary"))


def _contents(files: DataFrame) -> DataFrame:
    """``first`` (ids of all files before it), ``keys`` and ``content`` of each file.

    Only the files' sizes are added up: those of one part in that part, and the parts' totals, one row each. The sums
    go to the files by broadcast up to a counted number of files; beyond, the join is shuffled.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seqs = files.select("part", "seq", "n_ids")
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = seqs.withColumn("inside", inside).join(totals.select("part", before.alias("before")), "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first"))
    if files.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    return files.join(starts, ["part", "seq"]).select("first", "keys", "content")


def read_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``start`` (ids of all documents before it) and ``ids`` of each document, from the files' contents."""
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts, ids = from_file(batch.column(2)[i].as_py())
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64)))
                starts = pa.array(ends - counts + batch.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, starts, lists], names=["key", "start", "ids"])

    return _contents(files).mapInArrow(run, f"key {kind}, start long, ids array<long>").withColumnRenamed("key", key)


def digest_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the files' contents.

    The CRC-32 is that of the ids as little-endian unsigned 32-bit integers. The ids stay in the task that reads them.
    """
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts, ids = from_file(batch.column(2)[i].as_py())
                ends, raw = np.cumsum(counts), memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [batch.column(1)[i].values, pa.array(ends - counts + batch.column(0)[i].as_py()), pa.array(counts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32"])

    return _contents(files).mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_files(write_files(documents(spark, sf_dir)))


QUERIES = {"op10_token_files": op10_token_files}
SQL: dict[str, str] = {}
