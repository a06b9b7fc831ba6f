"""Readers of licensee dumps, park lists, region layers and prefix lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of a prefix list's entries that are prefixes, and the fewest rows of a whole park list.
PREFIX_KINDS, LEAST_PARKS = (1, 2, 3, 6, 9), 50_000


def pipe_records(spark: SparkSession, path: str, tag: str, names: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Rows of a pipe-delimited dump, with their ``position`` (file, block, place in the block: the order of the file).

    A record ends where the next line begins with the tag, so a line that doesn't begin with it belongs to the record
    before. Spark's reader splits files at that separator, so a dump of any size is read by many tasks. Short rows are
    padded, blank fields are null, a row with too many fields raises when it is read.
    """
    raw = spark.read.option("lineSep", f"\n{tag}|").text(path).withColumn("at", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")))
    text = F.decode(F.col("value").cast("binary"), encoding)
    body = F.rtrim(F.regexp_replace(F.regexp_replace(text, f"^(\\xEF\\xBB\\xBF)?{tag}\\|", ""), "[\\r\\n]+$", ""), F.lit("\r"))
    rows = raw.select(F.col("at").alias("position"), F.regexp_replace(body, "\r?\n", " ").alias("line")).where("trim(line) <> ''")
    fields = F.concat(F.array(F.lit(tag)), F.split("line", "\\|"))
    checked = F.when(F.size(fields) <= len(names), fields).otherwise(F.raise_error(F.concat(F.lit(f"{tag}: too many fields in "), F.substring("line", 1, 60))))
    return rows.select("position", checked.alias("f")).select("position", *[F.nullif(F.trim(F.try_element_at("f", F.lit(i + 1))), F.lit("")).alias(n) for i, n in enumerate(names)])


def prefix_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a prefix list: ``id`` in the order of the file, ``kind``, ``level``, ``parent`` and the attributes.

    Three header lines are skipped, a flag before the kind is dropped, kind and level are hexadecimal, and only the
    kinds that are callsign prefixes stay; ids count those that stay. One file of some thousand lines.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where("n >= 3")
    cells = lines.select("n", F.transform(F.split("line", "\\|"), lambda c: F.trim(c)).alias("c"))
    code = F.regexp_replace(F.element_at("c", 1), "^[LM-]", "")
    hexadecimal = lambda at: F.conv(F.substring(code, at, 2), 16, 10).cast("int")
    cell = lambda i: F.nullif(F.try_element_at("c", F.lit(i)), F.lit(""))
    places = {"lon": 2, "lat": 3, "territory": 4, "prefix": 5, "cq": 6, "itu": 7, "continent": 8, "tz": 9, "dxcc": 10, "province": 11, "mask": 14}
    entries = cells.where(F.size("c") > 3).select("n", hexadecimal(1).alias("kind"), hexadecimal(3).alias("level"), *[cell(i).alias(n) for n, i in places.items()])
    kept = entries.where(F.col("kind").isin(*PREFIX_KINDS)).withColumn("id", F.row_number().over(Window.orderBy("n"))).drop("n")
    return parents(kept, 15)


def semicolon_dump(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A dump whose header must be exactly these names; a row with another number of fields raises."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.option("sep", ";").option("quote", "").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)


def parks(spark: SparkSession, path: str, least: int = LEAST_PARKS) -> DataFrame:
    """A park list by its header: needed columns must be there, others are ignored, rows without reference are skipped.

    A list of fewer than ``least`` rows was cut off on its way and raises.
    """
    raw = spark.read.option("header", True).csv(path)
    if (n := raw.count()) < least:
        raise ValueError(f"the park list has {n} rows, fewer than {least}")
    return park_columns(raw)


def park_columns(raw: DataFrame) -> DataFrame:
    """The park table's columns from a raw list; numbers that can't be read are null."""
    needed = ["reference", "name", "active", "entityId", "locationDesc", "latitude", "longitude", "grid"]
    missing = [c for c in needed if c not in raw.columns]
    if missing:
        raise ValueError(f"the park list has no {', '.join(missing)}")
    number = lambda c, t: F.trim(c).try_cast(t)
    return raw.where(F.trim("reference") != "").select(
        F.trim("reference").alias("reference"), "name", number("active", "int").alias("active"), number("entityId", "int").alias("entity_id"),
        F.nullif(F.trim("locationDesc"), F.lit("")).alias("location_desc"), number("latitude", "double").alias("latitude"), number("longitude", "double").alias("longitude"), F.substring(F.trim("grid"), 1, 4).alias("grid"),
    )


def rings(geometry: Column, kind: Column) -> Column:
    """Rings of a GeoJSON geometry's coordinates (text): a polygon's, or those of each part; as arrays of (lat, lon)."""
    point = "array<array<array<array<double>>>>"
    parts = F.when(kind == "MultiPolygon", F.from_json(geometry, point)).otherwise(F.array(F.from_json(geometry, "array<array<array<double>>>")))
    to_point = lambda p: F.struct(F.element_at(p, 2).alias("lat"), F.element_at(p, 1).alias("lon"))
    return F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, to_point)))


def geojson(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """One row for each part of each feature of a collection, with its box and the given properties as text."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    features = spark.read.option("multiLine", True).schema(schema).json(path).select(F.posexplode("features").alias("feature", "f"))
    parts = features.select("feature", *[F.col("f.properties")[p].alias(p) for p in properties], F.posexplode(rings(F.col("f.geometry.coordinates"), F.col("f.geometry.type"))).alias("part", "rings"))
    outer = lambda field: F.transform(F.element_at("rings", 1), lambda p: p[field])
    return parts.select("*", F.array_min(outer("lon")).alias("minx"), F.array_max(outer("lon")).alias("maxx"), F.array_min(outer("lat")).alias("miny"), F.array_max(outer("lat")).alias("maxy"))


def max_by_call(rows: DataFrame, call: str, value: str) -> DataFrame:
    """The largest value of each callsign; a callsign whose values are all null stays."""
    return rows.groupBy(call).agg(F.max(value).alias(value))


def parents(entries: DataFrame, most: int) -> DataFrame:
    """Adds ``parent``: the nearest earlier entry of a smaller level. ``entries`` has ``id`` in file order and ``level``.

    For each level up to ``most`` the last id so far is carried along the file; the parent is the largest of those of
    smaller levels. A prefix list is one small file, so its order is one window.
    """
    file_order = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.last(F.when(F.col("level") == n, F.col("id")), True).over(file_order) for n in range(most + 1)}
    seen = entries.select("*", *[c.alias(f"__l{n}") for n, c in last.items()])
    smaller = F.array(*[F.when(F.col("level") > n, F.col(f"__l{n}")) for n in range(most + 1)])
    return seen.select(*entries.columns, F.array_max(smaller).alias("parent"))
