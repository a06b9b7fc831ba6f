"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

The bytes of a piece become Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds every
token at every place of the piece in one pass. The encoder takes the longest token at the current place that is
compatible with the token before it; where none is left, the place is marked dead and the last token is shortened.
Two adjacent tokens are compatible if the merges applied to their joined bytes give back these two; this is memoised,
as are pieces. Texts of a batch are cut and compared in Arrow, so that each part of them is looked at once.
A sequence in which all neighbours are compatible is the one that the merges produce, so the result is exact, and as
each place dies at most once and has boundedly many tokens, the time is linear in the piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import documents

RANKS = "byte_bpe_50k.tiktoken"
#: Token pairs that a worker remembers at most, and what their keys are multiplied by to find their places.
PAIRS, HASH = 1 << 20, np.int64(-7046029254386353131)
#: Stands between pieces that are searched together; UTF-8 hasn't this byte.
APART = b"\xff"
#: Bytes of text that are encoded together, and rows that are decoded together.
BATCH_BYTES, DECODE_ROWS = 4_000_000, 1_000


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id of a rank file."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return {int(rank): base64.b64decode(token) for token, rank in pairs}


class Bpe:
    """One vocabulary of ranks: pieces to ids and ids to bytes. A worker builds it once for each path."""

    loaded: dict[tuple[str, str], Bpe] = {}

    def __init__(self, path: str, pattern: str):
        self.bytes = token_bytes(path)
        self.rank = {token.decode("latin-1"): rank for rank, token in self.bytes.items()}
        # the pattern's \s is Unicode white space; the regex module's \s has a few control characters more
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.automaton = ahocorasick.Automaton()  # tokens of one byte need no search
        for token, rank in self.rank.items():
            if len(token) > 1 and APART.decode("latin-1") not in token:
                self.automaton.add_word(token, (len(token) - 1, rank))
        self.automaton.make_automaton()
        top = max(self.bytes) + 1
        self.single = np.full(256, -1, np.int32)
        self.length, self.shorter = np.zeros(top, np.int32), np.full(top, -1, np.int32)
        for token, rank in self.rank.items():
            self.length[rank] = len(token)
            if len(token) == 1:
                self.single[ord(token)] = rank
            else:  # the longest token that is a proper prefix
                self.shorter[rank] = next(self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank)
        # whether pairs are compatible, each in the one place of its hash; what comes later takes the place
        self.pair, self.fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.sound: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        if (path, pattern) not in cls.loaded:
            cls.loaded[path, pattern] = cls(path, pattern)
        return cls.loaded[path, pattern]

    def merged(self, s: str, stop: int = 1) -> list[int]:
        """The merges themselves, lowest rank first, until ``stop`` parts are left."""
        parts = list(s)
        while len(parts) > stop:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the merges of a token's own bytes join last; None for single bytes."""
        if token not in self.halves:
            self.halves[token] = tuple(self.merged(self.bytes[token].decode("latin-1"), 2)) if len(self.bytes[token]) > 1 else None
        return self.halves[token]

    def makes(self, token: int) -> bool:
        """Whether the merges make the token from its own bytes."""
        if token not in self.sound:
            self.sound[token] = self.merged(self.bytes[token].decode("latin-1")) == [token]
        return self.sound[token]

    def compatible(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` (-1: nothing): do the merges of their joined bytes give back these two.

        They do unless some merge over the border comes before the merges that make its two sides part of larger tokens.
        The tokens that face each other at the border are followed back in time, the later merge undone first; a pair of
        them that is a token was joined if its rank is below those of the merges undone so far.
        """
        if not self.makes(right) or left >= 0 and not self.makes(left):
            return False
        if left < 0:
            return True
        a, b, undone = left, right, 1 << 40
        while True:
            joint = self.rank.get((self.bytes[a] + self.bytes[b]).decode("latin-1"))
            if joint is not None and joint < undone:
                return False
            before_a, before_b = self.last_merge(a), self.last_merge(b)
            if before_a is None and before_b is None:
                return True
            if before_b is None or before_a is not None and a > b:
                undone, a = a, before_a[1]
            else:
                # of equal ranks the left one is merged first, so the border may still take this rank
                undone, b = b + 1, before_b[0]

    def compatibles(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`compatible` of many pairs, memoised."""
        key = (left.astype(np.int64) << 32) | right
        place = ((key * HASH) >> 20) % PAIRS
        ok, new = self.fits[place], np.flatnonzero(self.pair[place] != key)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array([self.compatible(x, y) for x, y in zip(left[new[first]].tolist(), right[new[first]].tolist(), strict=True)], bool)
            self.pair[place[new[first]]], self.fits[place[new[first]]] = keys, found
            ok[new] = found[back]
        return ok

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has.

        All pieces take their steps together: each tries the longest token at its place, a shorter one if that isn't
        compatible with the token before or ends at a dead place, and gives up its last token where none is left.
        """
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        joint = pc.binary_join_element_wise(pieces.cast(pa.binary()), APART, b"")
        raw = joint.buffers()[2].slice(0, np.frombuffer(joint.buffers()[1], np.int32, len(joint) + 1)[-1]).to_pybytes()
        codes, flat = np.frombuffer(raw, np.uint8), raw.decode("latin-1")
        stop = np.flatnonzero(codes == APART[0])
        longest = self.single[codes].tolist()
        for end, (offset, token) in self.automaton.iter(flat):  # ends ascend, so the longest is written last
            longest[end - offset] = token
        longest = np.array(longest, np.int32)
        dead, out = np.zeros(len(flat) + 1 + self.length.max(), bool), np.zeros(len(flat), np.int32)  # a token is kept at its first byte
        before = np.full(len(flat), -1, np.int64)  # and the place of the token before it
        begin = np.concatenate([[0], stop[:-1] + 1])
        who = np.flatnonzero(stop > begin)
        place, last_place, limit = begin[who].astype(np.int64), np.full(len(who), -1, np.int64), stop[who]
        last, token = np.full(len(who), -1, np.int32), longest[place]
        taken = np.zeros(len(flat), bool)
        while len(place):
            left = token >= 0
            end = place + self.length[token]
            ok = left & ~dead[end]
            some = np.flatnonzero(ok)
            ok[some] = self.compatibles(last[some], token[some])
            # those that fit go on behind their token
            took = place[ok]
            out[took], before[took], taken[took] = token[ok], last_place[ok], True
            last[ok], last_place[ok], place[ok] = token[ok], took, end[ok]
            # those without any token give up the one before
            gone = ~left
            back = last_place[gone]
            dead[place[gone]], taken[back] = True, False
            given = out[back]
            place[gone], last_place[gone] = back, before[back]
            last[gone] = np.where(before[back] >= 0, out[before[back]], -1)
            token = np.where(ok, longest[np.minimum(place, limit)], np.where(left, self.shorter[token], -1))
            token[gone] = self.shorter[given]
            go = place < limit
            if not go.all():
                place, last_place, last, token, limit = place[go], last_place[go], last[go], token[go], limit[go]
        upto = np.concatenate([[0], np.cumsum(taken)])
        return out[taken], upto[stop] - upto[begin]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and how many each has; nulls are empty.

        No piece goes on over a space between two characters that aren't white space, and such a space begins a piece.
        So texts are cut there, and equal parts of all of them are encoded once; a text with other white space beside a
        space is split by the pattern alone.
        """
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        words = cut.flatten().dictionary_encode()
        index, known = words.indices.to_numpy(), words.dictionary
        # a space and letters are one piece; other parts are split by the pattern
        letters = pc.utf8_is_alpha(known)
        mixed, split = known.filter(pc.invert(letters)).to_pylist(), self.split.findall
        letters = letters.to_numpy(zero_copy_only=False)
        odd = np.zeros(len(known), bool)
        odd[~letters] = [not w or w[0].isspace() or w[-1].isspace() for w in mixed]
        plain = ~np.bitwise_or.reduceat(odd[index], ends[:-1])
        lone = pc.if_else(pa.array(plain), pc.list_element(cut, 0), texts).to_pylist()
        parts = [split(" " + w) for w in mixed] + list(map(split, lone))
        pieces = pa.concat_arrays([pc.binary_join_element_wise("", known.filter(pa.array(letters)), " "), pa.array([p for part in parts for p in part], pa.string())])
        pieces = pieces.dictionary_encode()
        ids, size = self.encode_pieces(pieces.dictionary)
        order = pieces.indices.to_numpy()
        start, counted = np.cumsum(size) - size, np.concatenate([[0], np.cumsum(size[order])])
        flat = spread(ids, start[order], size[order])
        # where the ids of each part are, and of each text's first part or, if it isn't plain, of all of it
        many = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]) + letters.sum()
        begin, end = np.empty(len(known) + len(lone), np.int64), np.empty(len(known) + len(lone), np.int64)
        where = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters), len(known) + np.arange(len(lone))])
        begin[where] = counted[np.concatenate([np.arange(letters.sum()), many[:-1]])]
        end[where] = counted[np.concatenate([np.arange(letters.sum()) + 1, many[1:]])]
        kept = np.repeat(plain, np.diff(ends))
        kept[ends[:-1]] = True
        index = index.astype(np.int64)
        index[ends[:-1]] = len(known) + np.arange(len(lone))
        counts = np.where(kept, (end - begin)[index], 0)
        sums = np.concatenate([[0], np.cumsum(counts)])
        return spread(flat, begin[index], counts), np.diff(sums[ends])

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes.__getitem__, ids))


def spread(flat: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, of which each has a start and a length, one after the other."""
    total = int(counts.sum())
    return flat[np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(total)]


def slices(texts: pa.Array, most: int) -> Iterator[slice]:
    """Parts of an array of texts of about ``most`` bytes each; a longer text is a part of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begun, before = 0, 0
    while begun < len(texts):
        end = max(begun + 1, int(np.searchsorted(size, before + most, "right")))
        yield slice(begun, end)
        begun, before = end, int(size[end - 1])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``key`` and ``ids`` (array of int) for each row of ``docs``: its whole text, encoded.

    Null and empty texts give no ids; null keys, repeated rows and other columns do no harm, as each row is encoded by
    itself and only the two columns are read. Special tokens in a text are ordinary text. Memory is bounded by the
    longest text and a memo of fixed size.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path, pattern)
        for batch in batches:
            for some in slices(batch.column(1), BATCH_BYTES):
                ids, counts = bpe.encode(batch.column(1)[some])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[some], pa.ListArray.from_arrays(ends, ids)], names=["key", "ids"])
                pa.default_memory_pool().release_unused()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for; null or no ids give no bytes. Unknown ids fail."""
    path = ranks or public_tokenizers.path(RANKS)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        top = max(known) + 2
        size = np.full(top, -1, np.int64)
        size[list(known)] = [len(token) for token in known.values()]
        flat = np.frombuffer(b"".join(known.values()), np.uint8)
        start = np.zeros(top, np.int64)
        start[list(known)] = np.cumsum([0, *(len(token) for token in known.values())])[:-1]
        for whole in batches:
            for lot in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(lot, DECODE_ROWS)
                lists = batch.column(at)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                tokens = lists.flatten().to_numpy(zero_copy_only=False)
                if len(tokens) and (tokens.min() < 0 or tokens.max() >= top or (size[tokens] < 0).any()):
                    raise ValueError("an id isn't in the vocabulary")
                lengths = size[tokens]
                ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
                content = spread(flat, start[tokens], lengths)
                decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(content.tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, _schema(encoded) + ", decoded binary")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def digest(encoded: DataFrame) -> DataFrame:
    """Number of ids, SHA-256 of their decimal forms joined by spaces, and SHA-256 of the decoded bytes."""
    return decode(encoded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(documents(spark, sf_dir)))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
SQL: dict[str, str] = {}
