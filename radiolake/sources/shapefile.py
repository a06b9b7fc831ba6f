"""Shapefiles as a data source: one layer is many tasks, each of which reads a range of records.

The index beside a layer (``.shx``) says where each record begins, so the driver reads it and deals its records into
ranges; a task reads its range of the layer (``.shp``) and the same range of the attributes (``.dbf``, whose records are of one
length) and nothing else. A layer is opened through Arrow's file systems, so its path may be local, shared or in a store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Fixed values of the format: the length of a layer's header, the codes of polygons (plain, with measures, with heights), a field's description.
HEADER, RECORD_HEADER = 100, 8
POLYGONS, NO_SHAPE = (5, 15, 25), 0
FIELD = 32
#: Records of a range, unless the layer is read with another number.
RECORDS = 20_000
RINGS = "array<array<array<struct<lat:double,lon:double>>>>"


class Layer:
    """The files of a layer, whose path is given with or without an ending."""

    def __init__(self, path: str):
        self.path = path[:-4] if path[-4:].lower() == ".shp" else path

    def open(self, kind: str) -> pa.NativeFile:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        for ending in (kind, kind.upper()):
            if system.get_file_info(f"{path}.{ending}").type == fs.FileType.File:
                return system.open_input_file(f"{path}.{ending}")
        raise FileNotFoundError(f"the layer {self.path} has no .{kind}")

    def index(self) -> np.ndarray:
        """Where each record begins and how long its content is, in bytes."""
        with self.open("shx") as file:
            raw = file.read()
        return np.frombuffer(raw, ">i4", (len(raw) - HEADER) // 8 * 2, HEADER).reshape(-1, 2).astype(np.int64) * 2

    def fields(self) -> tuple[dict[str, tuple[int, int]], int, int]:
        """Place and length of each attribute in a record, the records' length, and where the first one begins."""
        with self.open("dbf") as file:
            head = file.read(FIELD)
            begin, size = (int.from_bytes(head[at : at + 2], "little") for at in (8, 10))
            described = file.read(begin - FIELD)
        out, at = {}, 1  # the first byte marks deleted records
        for i in range(0, len(described) - FIELD + 1, FIELD):
            if described[i] == 0x0D:
                break
            name, length = described[i : i + 11].split(b"\0")[0].decode("ascii"), described[i + 16]
            out[name] = (at, length)
            at += length
        return out, size, begin


def polygon_rings(content: bytes) -> list[np.ndarray] | None:
    """The rings of a polygon's record as arrays of (x, y); None for a record without shape; another kind raises."""
    kind = int.from_bytes(content[:4], "little")
    if kind == NO_SHAPE:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"a layer of polygons has a shape of kind {kind}")
    n_rings, n_points = np.frombuffer(content, "<i4", 2, 36)
    first = np.append(np.frombuffer(content, "<i4", n_rings, 44), n_points)
    points = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_rings).reshape(-1, 2)
    return [points[a:b] for a, b in zip(first[:-1], first[1:], strict=True) if b > a]


def turn(ring: np.ndarray) -> float:
    """Twice a ring's area: negative for outlines, which go clockwise, positive for holes."""
    x, y = (ring - ring[0]).T
    return float(x[:-1] @ y[1:] - x[1:] @ y[:-1])


def holds(ring: np.ndarray, point: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    across = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    a, b = a[across], b[across]
    return bool((point[0] < (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).sum() % 2)


def grouped(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons, each its outline and then its holes: a hole belongs to the smallest outline that holds its first point.

    Where no ring goes clockwise, or no outline holds a hole, each such ring is an outline.
    """
    turns = [turn(r) for r in rings]
    outlines = [i for i, t in enumerate(turns) if t < 0]
    groups = {i: [rings[i]] for i in outlines}
    for i, t in enumerate(turns):
        if t >= 0:
            around = [j for j in outlines if holds(rings[j], rings[i][0])]
            if around:
                groups[max(around, key=lambda j: turns[j])].append(rings[i])
            else:
                groups[i] = [rings[i]]
    return [groups[i] for i in sorted(groups)]


class Range(InputPartition):
    def __init__(self, first: int, upto: int, begin: int, end: int):
        self.first, self.upto, self.begin, self.end = first, upto, begin, end


class ShapefileReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.layer, self.encoding, self.records = Layer(options["path"]), options.get("encoding", "utf-8"), int(options.get("records", RECORDS))
        self.names = [f.name for f in schema.fields if f.name not in ("record", "parts")]
        self.columns = [f.name for f in schema.fields]
        have = self.layer.fields()[0]
        if missing := [n for n in self.names if n not in have]:
            raise ValueError(f"the layer {self.layer.path} has no {', '.join(missing)}; it has {', '.join(sorted(have))}")

    def partitions(self) -> list[InputPartition]:
        """Ranges of records; records stand in the layer as in its index."""
        index = self.layer.index()
        out = []
        for first in range(0, len(index), self.records):
            some = index[first : first + self.records]
            out.append(Range(first, first + len(some), int(some[0, 0]), int(some[-1].sum()) + RECORD_HEADER))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition is None:  # a layer without records
            return
        fields, size, begin = self.layer.fields()
        with self.layer.open("dbf") as file:
            file.seek(begin + partition.first * size)
            attributes = file.read((partition.upto - partition.first) * size)
        with self.layer.open("shp") as file:
            file.seek(partition.begin)
            left = partition.end - partition.begin
            for record in range(partition.first, partition.upto):
                head = file.read(RECORD_HEADER)
                content = file.read(2 * int.from_bytes(head[4:8], "big"))
                left -= len(head) + len(content)
                rings = polygon_rings(content)
                row = attributes[(record - partition.first) * size : (record - partition.first + 1) * size]
                if not rings or row[:1] == b"*":
                    continue
                of = {n: row[fields[n][0] : sum(fields[n])].decode(self.encoding).strip(" \0") or None for n in self.names}
                of["record"] = record
                of["parts"] = [[[(float(y), float(x)) for x, y in ring] for ring in part] for part in grouped(rings)]
                yield tuple(of[c] for c in self.columns)


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile")`` with the options ``path``, ``encoding`` and ``records`` and a schema of attributes as text, ``record`` and ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        fields = Layer(self.options["path"]).fields()[0]
        return ", ".join([*[f"`{n}` string" for n in fields], "record long", f"parts {RINGS}"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShapefileReader(schema, self.options)


def layer(spark: SparkSession, path: str, fields: list[str], encoding: str = "utf-8", records: int = RECORDS) -> DataFrame:
    """A layer of polygons: the attributes ``fields`` as trimmed text, ``record`` (its number) and ``parts`` (polygons of rings of (lat, lon)).

    A layer that lacks one of the fields raises before anything is read. Records without a shape and deleted ones are
    left out; blank attributes are null; another kind of shape raises. Layers are read unzipped.
    """
    spark.dataSource.register(ShapefileSource)
    schema = ", ".join([*[f"`{f}` string" for f in fields], "record long", f"parts {RINGS}"])
    return spark.read.format("shapefile").schema(schema).option("encoding", encoding).option("records", str(records)).load(path)
