"""Words of a batch of texts as numbers, found over all bytes of the batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together, except for a longer text, which is worked on alone.
BATCH_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What each byte becomes when only A-Z are lower-cased; no byte of a longer UTF-8 sequence is among them.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``BATCH_BYTES`` of the column's texts, one row at least."""
    texts = batch.column(column)
    ends = np.cumsum(lengths(texts), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + BATCH_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; null has none."""
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, null ones being empty, and the offsets of the rows in them."""
    texts = pa.concat_arrays([texts.fill_null("")])
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[: offsets[-1]], offsets


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of marked bytes in the rows, and each row's first run (and the end)."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(inside) else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def cut(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The runs as an array of ``kind`` (text or binary), which shares one buffer."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) of the rows as one array, and each row's first word (and the end)."""
    data, offsets = flat(texts)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    starts, ends, first = runs(inside, offsets)
    return cut(data, inside, starts, ends, pa.string()), first


def codes(found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words, and the distinct words that these numbers index."""
    coded = found.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def joined(found: pa.Array, first: np.ndarray) -> pa.Array:
    """The rows' words joined by one space."""
    lists = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), found)
    return pc.binary_join(lists, " ").cast(pa.string())
