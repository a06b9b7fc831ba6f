"""Media columns: baseline JPEG written, parsed and decoded in numpy, with DC-only luminance thumbnails.

A payload of bytes is stored without loss as the quantised coefficients of a one-component baseline JPEG: a byte b is
the coefficient b - 128 if b < 128, else b - 127, so none is zero. 64 bytes fill a block in zigzag order, nine blocks (576 bytes)
are a row of the image and a restart interval. All intervals of many images are decoded together, one symbol of each at
a time, so the work is in numpy although Huffman codes of one interval must be read one after the other. An image is at
most 65,528 lines high; a longer payload is a sequence of images.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.common import documents

BLOCK, ROW_BLOCKS = 64, 9
UNIT = BLOCK * ROW_BLOCKS
MOST_ROWS = 8191
#: All coefficients are in units of 8, so that a DC coefficient is eight times the block's mean and a thumbnail has the
#: full range of a byte.
QUANTUM = 8
#: Huffman code lengths of the files written here: symbols by size of the coefficient, most frequent first in prose.
DC_LENGTHS = {5: 2, 4: 2, 3: 3, 6: 3, 2: 4, 7: 4, 1: 5, 8: 6, 0: 7, 9: 8}
AC_LENGTHS = {0x05: 1, 0x07: 3, 0x04: 3, 0x06: 4, 0x03: 4, 0x08: 5, 0x02: 6, 0x01: 7, 0x00: 8, 0xF0: 9}
#: Payload bytes that are encoded or decoded together.
TOGETHER = 1 << 20

MARKERS = {"SOI": 0xD8, "EOI": 0xD9, "SOF0": 0xC0, "DHT": 0xC4, "DQT": 0xDB, "DRI": 0xDD, "SOS": 0xDA}


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical code and length of each symbol."""
    out, code, last = {}, 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= length - last
        out[symbol] = (code, length)
        code, last = code + 1, length
    return out


def lookup(lengths: dict[int, int]) -> np.ndarray:
    """For each next 16 bits: symbol and length of the code that they begin with, as symbol * 32 + length (0: none)."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in codes(lengths).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return table


# --- writing --------------------------------------------------------------------------------------------------------


def _segment(marker: str, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, MARKERS[marker], len(body) + 2) + body


def _huffman_segment(kind: int, lengths: dict[int, int]) -> bytes:
    ordered = sorted(lengths.items(), key=lambda x: x[1])
    counts = [sum(1 for _, n in ordered if n == k) for k in range(1, 17)]
    return bytes([kind, *counts, *[s for s, _ in ordered]])


def header(rows: int) -> bytes:
    """Everything before the scan's data of an image of ``rows`` rows of blocks."""
    return b"".join([
        b"\xff\xd8",
        _segment("DQT", bytes([0] + [QUANTUM] * 64)),
        _segment("SOF0", struct.pack(">BHHB", 8, 8 * rows, 8 * ROW_BLOCKS, 1) + bytes([1, 0x11, 0])),
        _segment("DHT", _huffman_segment(0x00, DC_LENGTHS) + _huffman_segment(0x10, AC_LENGTHS)),
        _segment("DRI", struct.pack(">H", ROW_BLOCKS)),
        _segment("SOS", bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _code_arrays(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for symbol, (c, n) in codes(lengths).items():
        code[symbol], size[symbol] = c, n
    return code, size


DC_CODE, DC_SIZE = _code_arrays(DC_LENGTHS)
AC_CODE, AC_SIZE = _code_arrays(AC_LENGTHS)
BIT_LENGTH = np.array([x.bit_length() for x in range(512)])


def intervals(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes (with stuffing, padded by ones) of each 576-byte unit, and where each ends."""
    value = payload.astype(np.int16)
    value = np.where(value < 128, value - 128, value - 127).reshape(-1, ROW_BLOCKS, BLOCK)
    coded = value.copy()
    coded[:, 1:, 0] -= value[:, :-1, 0]  # DC coefficients are differences within the interval
    coded = coded.reshape(len(value), UNIT)
    size = BIT_LENGTH[np.abs(coded)]
    first = np.arange(UNIT) % BLOCK == 0
    code = np.where(first, DC_CODE[size], AC_CODE[size])
    length = np.where(first, DC_SIZE[size], AC_SIZE[size])
    extra = (np.where(coded < 0, coded + (1 << size) - 1, coded)).astype(np.uint64)
    word, bits = (code << size.astype(np.uint64)) | extra, length + size
    ends = np.cumsum(bits, axis=1)
    n_bytes = -(-ends[:, -1] // 8)
    base = np.concatenate([[0], np.cumsum(n_bytes)])
    at = (ends - bits + 8 * base[:-1, None]).ravel()
    # each word, of at most 17 bits, is put into the three bytes that it may touch
    shifted = word.ravel() << (24 - (at & 7) - bits.ravel()).astype(np.uint64)
    out = np.zeros(base[-1] + 3, np.int64)
    for k in range(3):
        out += np.bincount((at >> 3) + k, ((shifted >> np.uint64(16 - 8 * k)) & np.uint64(255)).astype(np.float64), len(out)).astype(np.int64)
    data = out[: base[-1]]
    data[base[1:] - 1] |= (1 << (8 * n_bytes - ends[:, -1])) - 1
    data = data.astype(np.uint8)
    stuffed = np.flatnonzero(data == 255)
    return np.insert(data, stuffed + 1, 0), base[1:] + np.searchsorted(stuffed, base[1:])


def store(payloads: list[bytes]) -> list[bytes]:
    """The media bytes of payloads whose lengths are positive multiples of 576."""
    data, ends = intervals(np.frombuffer(b"".join(payloads), np.uint8))
    data, ends, out, unit, begun = data.tobytes(), ends.tolist(), [], 0, 0
    restart = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
    for payload in payloads:
        images, left = [], len(payload) // UNIT
        while left:
            rows = min(left, MOST_ROWS)
            parts = [header(rows)]
            for k in range(rows):
                if k:
                    parts.append(restart[(k - 1) % 8])
                parts.append(data[begun : ends[unit]])
                begun, unit = ends[unit], unit + 1
            images += [*parts, b"\xff\xd9"]
            left -= rows
        out.append(b"".join(images))
    return out


# --- reading --------------------------------------------------------------------------------------------------------


class Image:
    """One parsed baseline image: size, components, tables, and its scan's intervals."""

    def __init__(self) -> None:
        self.width = self.height = self.interval = 0
        #: Of each component: number, blocks across and down in a unit of the scan, quantum of DC, tables of DC and AC.
        self.numbers: list[int] = []
        self.samples: list[tuple[int, int]] = []
        self.quanta: list[int] = []
        self.used: list[tuple[int, int]] = []
        self.tables: dict[int, bytes] = {}
        self.scan: list[bytes] = []

    @property
    def units(self) -> tuple[int, int]:
        """Units of the scan down and across: blocks of a lone component, else the blocks of all components."""
        across, down = (max(x) for x in zip(*self.samples, strict=True)) if len(self.samples) > 1 else (1, 1)
        return -(-self.height // (8 * down)), -(-self.width // (8 * across))

    @property
    def pattern(self) -> list[int]:
        """The component of each block of a unit."""
        return [c for c, (h, v) in enumerate(self.samples) for _ in range(h * v)] if len(self.samples) > 1 else [0]

    def luminance(self, coefficients: np.ndarray) -> np.ndarray:
        """DC coefficients of the first component, by block rows and columns."""
        rows, columns = self.units
        h, v = self.samples[0] if len(self.samples) > 1 else (1, 1)
        across, down = (max(x) for x in zip(*self.samples, strict=True)) if len(self.samples) > 1 else (1, 1)
        dc = coefficients[:, 0].reshape(rows, columns, len(self.pattern))[:, :, : h * v]
        whole = dc.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
        return whole[: -(-self.height * v // (8 * down)), : -(-self.width * h // (8 * across))]


def parse(media: bytes) -> list[Image]:
    """The images of a sequence of baseline JPEGs, by their markers.

    Images have one component or several in one scan, of which the first is the luminance. Other processes and sizes of
    sample raise; unknown segments are skipped.
    """
    images, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of an image")
        image, at = Image(), at + 2
        quanta: dict[int, int] = {}
        wanted: list[int] = []
        while True:
            if media[at] != 0xFF:
                raise ValueError("no marker")
            marker = media[at + 1]
            if marker == MARKERS["EOI"]:
                at += 2
                break
            (size,) = struct.unpack_from(">H", media, at + 2)
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == MARKERS["DQT"]:
                while body:
                    wide = body[0] >> 4
                    quanta[body[0] & 15] = int(np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)[0])
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == MARKERS["SOF0"]:
                bits, image.height, image.width, components = struct.unpack_from(">BHHB", body)
                if bits != 8 or not 1 <= components <= 4:
                    raise ValueError("only components of 8 bits are read")
                for number, sample, table in zip(*[iter(body[6 : 6 + 3 * components])] * 3, strict=True):
                    image.numbers.append(number)
                    image.samples.append((sample >> 4, sample & 15))
                    wanted.append(table)
            elif 0xC1 <= marker <= 0xCF and marker != MARKERS["DHT"]:
                raise ValueError("not a baseline image")
            elif marker == MARKERS["DHT"]:
                while body:
                    n = sum(body[1:17])
                    image.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == MARKERS["DRI"]:
                (image.interval,) = struct.unpack(">H", body)
            elif marker == MARKERS["SOS"]:
                chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                if image.scan or set(chosen) != set(image.numbers):
                    raise ValueError("only one scan of all components is read")
                image.used = [(chosen[n] >> 4, 0x10 | (chosen[n] & 15)) for n in image.numbers]
                end = at
                while True:  # a marker ends the interval unless it is a stuffed byte
                    end = media.index(b"\xff", end)
                    if media[end + 1] == 0:
                        end += 2
                        continue
                    image.scan.append(media[at:end])
                    if not 0xD0 <= media[end + 1] <= 0xD7:
                        at = end
                        break
                    at = end = end + 2
        image.quanta = [quanta.get(t, 1) for t in wanted]
        if not image.scan or not image.width or not image.height:
            raise ValueError("an image without a scan")
        images.append(image)
    return images


def _lengths(table: bytes) -> dict[int, int]:
    sizes = np.repeat(np.arange(1, 17), list(table[:16])).tolist()
    return dict(zip(table[16:], sizes, strict=True))


def decode(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients (blocks of the scan, 64), in zigzag order, of each image; all with equal tables at a time."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        tables = tuple((image.tables[dc], image.tables[ac]) for dc, ac in image.used)
        groups.setdefault((tables, tuple(image.pattern)), []).append(i)
    for (tables, pattern), members in groups.items():
        scans = [s for i in members for s in images[i].scan]
        blocks = []
        for i in members:
            rows, columns = images[i].units
            per = images[i].interval or rows * columns
            blocks += [len(pattern) * max(0, min(per, rows * columns - per * k)) for k in range(len(images[i].scan))]
        dc, ac = (np.stack([lookup(_lengths(t[k])) for t in tables]) for k in (0, 1))
        found = _decode(scans, np.array(blocks), dc, ac, np.array(pattern))
        at = 0
        for i in members:
            n = images[i].units[0] * images[i].units[1] * len(pattern)
            out[i] = found[at : at + n]
            if len(out[i]) != n:
                raise ValueError("an image has too few intervals")
            at += n
    return out


def _decode(scans: list[bytes], blocks: np.ndarray, dc: np.ndarray, ac: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """Coefficients of all intervals; in each step every unfinished interval reads one symbol and its extra bits.

    ``pattern`` has the component of each block of a unit, ``dc`` and ``ac`` the tables of each component.
    """
    plain = [s.replace(b"\xff\x00", b"\xff") for s in scans]
    data = np.frombuffer(b"".join(plain) + bytes(8), np.uint8).astype(np.uint64)
    # the 48 bits from each byte on: a symbol of up to 16 bits with up to 16 more, at any bit of the byte
    window = np.zeros(len(data) - 7, np.uint64)
    for k in range(6):
        window |= data[k : k + len(window)] << np.uint64(40 - 8 * k)
    bit = 8 * np.concatenate([[0], np.cumsum([len(p) for p in plain])[:-1]]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    out = np.zeros(int(blocks.sum()) * BLOCK, np.int64)
    place, end = first * BLOCK, (first + blocks) * BLOCK
    open_, previous, begun = np.flatnonzero(place < end), np.zeros((len(scans), len(dc)), np.int64), place.copy()
    while len(open_):
        at, b = place[open_], bit[open_]
        next32 = (window[b >> 3] >> (16 - (b & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        is_dc = at % BLOCK == 0
        of = pattern[(at - begun[open_]) // BLOCK % len(pattern)] if len(pattern) > 1 else 0
        entry = np.where(is_dc, dc[of, next32 >> np.uint64(16)], ac[of, next32 >> np.uint64(16)]).astype(np.int64)
        length, symbol = entry & 31, entry >> 5
        if (length == 0).any():
            raise ValueError("a code that isn't in the table")
        size, run = np.where(is_dc, symbol, symbol & 15), np.where(is_dc, 0, symbol >> 4)
        extra = ((next32 >> (32 - length - size).astype(np.uint64)) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        bit[open_] = b + length + size
        value = np.where(is_dc, value + previous[open_, of], value)
        previous[open_, of] = np.where(is_dc, value, previous[open_, of])
        stop = ~is_dc & (size == 0) & (run == 0)  # the rest of the block is zero
        target = at + run
        has = is_dc | (size > 0)
        out[target[has]] = value[has]
        place[open_] = np.where(stop, (at // BLOCK + 1) * BLOCK, target + 1)
        if (place[open_] > end[open_]).any():
            raise ValueError("an interval has too many coefficients")
        open_ = open_[place[open_] < end[open_]]
    return out.reshape(-1, BLOCK)


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """One luminance sample for each block, from the DC coefficients alone: an eighth of the size both ways."""
    mean = np.floor(image.luminance(coefficients) * image.quanta[0] / 8 + 128 + 0.5)
    return np.clip(mean, 0, 255).astype(np.uint8)


def described(images: list[Image], coefficients: list[np.ndarray]) -> tuple[bytes, str]:
    """Payload (that of images of one component) and feature of a media's images.

    The feature has each image's width and height, the SHA-256 (first half) of its thumbnail and a difference hash of
    the thumbnail's columns' means.
    """
    payload, feature = [], []
    for image, c in zip(images, coefficients, strict=True):
        if len(image.samples) == 1:
            payload.append(np.where(c < 0, c + 128, c + 127).astype(np.uint8).tobytes())
        small = thumbnail(image, c)
        steps = "".join("1" if d > 0 else "0" for d in np.diff(small.mean(axis=0)))
        feature.append(f"{image.width}x{image.height}:{hashlib.sha256(small.tobytes()).hexdigest()[:32]}:{steps}")
    return b"".join(payload), ",".join(feature)


def read(medias: list[bytes]) -> list[tuple[bytes, str] | None]:
    """Payload and feature of each stored media, all decoded together; None for media that can't be read."""
    try:
        parsed = [parse(m) for m in medias]
        found, at, out = decode([i for p in parsed for i in p]), 0, []
        for own in parsed:
            out.append(described(own, found[at : at + len(own)]))
            at += len(own)
        return out
    except (ValueError, KeyError, IndexError, struct.error):
        return [None] if len(medias) == 1 else [x for m in medias for x in read([m])]


# --- columns --------------------------------------------------------------------------------------------------------


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about TOGETHER bytes each; a larger row is one by itself."""
    begun, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > TOGETHER:
            yield begun, i
            begun, total = i, 0
        total += n
    if begun < len(sizes):
        yield begun, len(sizes)


def store_column(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key``, ``n_bytes`` and ``media``: each row's bytes (null: none), padded with 255 to a positive multiple of 576."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in _chunks(sizes):
                own = [x.as_py() or b"" for x in batch.column(1).slice(a, b - a)]
                medias = store([x + b"\xff" * (max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x)) for x in own])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in own], pa.int64()), pa.array(medias, pa.binary())], names=["key", "n_bytes", "media"])

    import pyarrow.compute  # noqa: F401  makes pa.compute known where the function runs

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(payload).alias("payload")).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def read_column(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the ``media`` column back: digests of the payload and of the media, sizes, and the features.

    Media that are null or can't be read have null for all that is read from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _chunks([len(x.as_buffer() or b"") for x in batch.column(2)]):
                medias = [x.as_py() or b"" for x in batch.column(2).slice(a, b - a)]
                found = [(None, None) if x is None or not m else x for x, m in zip(read(medias), medias, strict=True)]
                each = lambda use: [None if p is None else use(p) for p, _ in found]  # noqa: B023, E731
                columns = [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                    pa.array(each(len), pa.int64()), pa.array(each(lambda p: hashlib.sha256(p).hexdigest()), pa.string()),
                    pa.array(each(lambda p: zlib.crc32(p[-32:])), pa.int64()), pa.array([len(m) for m in medias], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in medias]), pa.array([f for _, f in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(key).alias("key"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("key", key)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("payload"))
    return read_column(store_column(docs, "doc_id", "payload"))


QUERIES = {"op6_media": op6_media}
SQL: dict[str, str] = {}
