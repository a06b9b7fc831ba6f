"""Spatial joins: points to region parts through grid cells, anchors, nearest keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from radiolake.functions import geo
from radiolake.functions import rings as polygons
from radiolake.shared import ranked, staged

#: Degrees of a grid cell.
CELL = 5.0
#: A part's box.
BOX = ["minx", "maxx", "miny", "maxy"]


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def region_of(points: DataFrame, parts: DataFrame, order: list[Column], key: str, attributes: list[str], cell: float = CELL, part: str = "part") -> DataFrame:
    """The region of each point: of the parts that hold it, the first by ``order``; points outside all are left out.

    Each part's box is put into the grid cells that it touches, each point into its one cell, so the join is an
    equality; only what passes the box meets the part's rings, by the part's number, and the exact test. So rings are
    not copied into cells. A point outside the range of coordinates has no cell. A crowded cell has no group that must
    meet in a task: the joins may be split, and the choice is a partial aggregation. Parts are numbered in their order
    before, so what is aggregated is one number, in a hash table with a row for each point, and hits aren't sorted.
    """
    here = points.where(geo.valid(F.col("lat"), F.col("lon"))).withColumn("lon", geo.west(F.col("lon")))
    here = here.select(F.col(key).alias("__key"), "lat", "lon", F.floor(F.col("lat") / cell).alias("cy"), F.floor(F.col("lon") / cell).alias("cx"))
    named = parts.select(F.col(part).alias("__part"), F.struct(*attributes).alias("__attributes"), F.struct(*order).alias("__order"))
    # numbers rise along the order; they have gaps, and are the same for all who read them
    numbered = staged(named.orderBy("__order", "__part").select("__part", "__attributes", F.monotonically_increasing_id().alias("__number")))
    boxes = parts.select(F.col(part).alias("__part"), *BOX).join(numbered.select("__part", "__number"), "__part")
    gridded = boxes.withColumn("cy", F.explode(_cells(F.col("miny"), F.col("maxy"), cell))).withColumn("cx", F.explode(_cells(F.col("minx"), F.col("maxx"), cell)))
    boxed = here.join(gridded, ["cy", "cx"]).where(F.col("lon").between(F.col("minx"), F.col("maxx")) & F.col("lat").between(F.col("miny"), F.col("maxy")))
    met = boxed.select("__key", "lat", "lon", "__part", "__number").join(parts.select(F.col(part).alias("__part"), "rings"), "__part")
    inside = met.where(geo.in_polygon(F.col("rings"), F.col("lat"), F.col("lon")))
    first = inside.groupBy(F.col("__key").alias(key)).agg(F.min("__number").alias("__number"))
    return first.join(numbered.select("__number", F.col("__attributes").alias("r")), "__number").select(key, "r.*")


def anchors(members: DataFrame, key: str, ident: str) -> DataFrame:
    """For each key the member nearest to the mean of all its members on the sphere; ties by id.

    The mean is one aggregation; the nearest one is another, over the members joined to their key's mean.
    """
    x, y, z = geo.unit(F.col("lat"), F.col("lon"))
    placed = members.withColumns({"x": x, "y": y, "z": z})
    means = placed.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.count("*").alias("members"))
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    apart = F.round(square("x", "mx") + square("y", "my") + square("z", "mz"), 9)
    return placed.join(means, key).groupBy(key, "members").agg(F.min_by(F.struct(ident, "lat", "lon"), F.struct(apart.alias("d"), F.col(ident).alias("i"))).alias("m")).select(key, "members", "m.*")


#: Numbers that are looked at together by :func:`nearest_key`.
NUMBERS = 10_000


def nearest_key(rows: DataFrame, known: DataFrame, group: str, number: str, ident: str, position: str) -> DataFrame:
    """For each row the known entry of its group whose number is nearest; of two as near, the earlier by position.

    Rows with equal group and number share their answer, so each is looked up once. Numbers are dealt by range: within
    a range the last known entry below and the next one above come from a window; where a range has none, they come
    from a table with one row for each group and range. So a group of any size is as many tasks' work as it has ranges.
    """
    lot = F.floor(F.col(number) / NUMBERS)
    wanted = rows.select(group, number).distinct()
    entries = known.groupBy(group, number).agg(F.min(position).cast("long").alias("p"))
    marked = wanted.select(group, number, F.lit(None).cast("long").alias("p")).unionByName(entries).withColumn("__lot", lot)
    entry = F.when(F.col("p").isNotNull(), F.struct(F.col(number).alias("n"), "p"))
    order = Window.partitionBy(group, "__lot").orderBy(number)
    inside = marked.select(
        group, number, "p", "__lot",
        F.last(entry, True).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("below"),
        F.first(entry, True).over(order.rangeBetween(0, Window.unboundedFollowing)).alias("above"),
    )
    lots = marked.groupBy(group, "__lot").agg(F.max(entry).alias("last"), F.min(entry).alias("first"))
    by_lot = Window.partitionBy(group).orderBy("__lot")
    around = lots.select(
        group, "__lot",
        F.last("last", True).over(by_lot.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", True).over(by_lot.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    near = inside.where("p IS NULL").join(around, [group, "__lot"])
    options = F.filter(F.array(F.coalesce("below", "before"), F.coalesce("above", "after")), lambda e: e.isNotNull())
    best = F.array_min(F.transform(options, lambda e: F.struct(F.abs(e["n"] - F.col(number)).alias("d"), e["p"].alias("p"))))
    return rows.select(ident, group, number).join(near.select(group, number, best["p"].alias(position)), [group, number]).where(F.col(position).isNotNull())


#: Degrees beyond which no part of the map is farther.
FARTHEST = 512.0


def _boxed(parts: DataFrame) -> DataFrame:
    """Adds each part's box, from its rings."""
    ends = lambda f, field: f(F.transform(F.flatten("rings"), lambda p: p[field]))
    return parts.withColumns({"minx": ends(F.array_min, "lon"), "maxx": ends(F.array_max, "lon"), "miny": ends(F.array_min, "lat"), "maxy": ends(F.array_max, "lat")})


def nearest_part(points: DataFrame, parts: DataFrame, key: str, name: str, position: str, group: str | None = None, reach: float | None = None, cell: float = CELL) -> DataFrame:
    """For each point the part that holds it, else the nearest one, else null; of its own group, if ``group`` names one.

    Of several that hold it the last by position wins; of equally near ones the first. ``reach`` is the farthest distance in
    degrees; None: no limit. Points of one place are looked up once.

    Parts meet points by grid cells. What no part holds is looked for in growing circles: with each part's box widened
    by the circle's radius, and cells as large, so that a box is in few of them. The distance to a box is a lower bound, so a part within the
    radius that is found is the nearest one, and only those that find none go on to twice the radius: few points and few
    rounds, as a radius is soon as wide as the map.
    """
    groups = [group] if group else []
    known = staged(_boxed(parts.select(*groups, name, position, "rings")).withColumn("__part", F.monotonically_increasing_id()))
    boxes, rings = known.select(*groups, "__part", "minx", "maxx", "miny", "maxy"), known.select("__part", name, position, "rings")
    place = [*groups, "lat", "lon"]
    asked = points.where(geo.valid(F.col("lat"), F.col("lon"))).select(*place).distinct()
    asked = staged(asked.join(known.select(*groups).distinct(), groups, "left_semi") if groups else asked)

    def met(left: DataFrame, far: float) -> DataFrame:
        """The points with the parts within a distance and that distance, ``d``."""
        size = max(cell, far)
        wide = boxes.withColumn("cy", F.explode(_cells(F.col("miny") - far, F.col("maxy") + far, size))).withColumn("cx", F.explode(_cells(F.col("minx") - far, F.col("maxx") + far, size)))
        here = left.withColumns({"cy": F.floor(F.col("lat") / size), "cx": F.floor(F.col("lon") / size)})
        off = lambda low, at, high: F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0))
        near = here.join(wide, [*groups, "cy", "cx"]).where(F.hypot(off("minx", "lon", "maxx"), off("miny", "lat", "maxy")) <= far)
        return near.select(*place, "__part").join(rings, "__part").withColumn("d", geo.distance(F.col("rings"), F.col("lat"), F.col("lon"))).where(F.col("d") <= far)

    found = [staged(met(asked, 0.0).groupBy(*place).agg(F.max_by(name, position).alias(name)))]
    left = staged(asked.join(found[0], place, "left_anti"))
    far = cell if reach is None else reach
    while (reach is None or len(found) == 1) and far <= FARTHEST and not left.isEmpty():
        found.append(staged(met(left, far).groupBy(*place).agg(F.min_by(name, F.struct("d", position)).alias(name))))
        left, far = staged(left.join(found[-1], place, "left_anti")), 2 * far
    return points.select(key, *place).join(reduce(DataFrame.unionByName, found), place, "left").select(key, name)


def county_of(points: DataFrame, parts: DataFrame, key: str, group: str, name: str, position: str, reach: float | None = 0.5) -> DataFrame:
    """For each point the part of its own group that holds it, else the nearest one within ``reach`` degrees, else null."""
    return nearest_part(points, parts, key, name, position, group, reach)


def in_area_order(parts: DataFrame, key: str, ties: list[str], first: Column | None = None) -> DataFrame:
    """``key``, ``ties``, ``area`` (square degrees, all parts) and ``id`` from 1: smaller features first, so that an enclave is
    asked before what is around it; ``first`` (a condition) comes before all others, and equal areas go by ``ties``.

    The order is dealt by range, so no task holds all features.
    """
    ahead = F.lit(True) if first is None else F.coalesce(first, F.lit(False))
    sized = parts.groupBy(key, *ties).agg(F.sum(polygons.area(F.col("rings"))).alias("area"), F.bool_or(ahead).alias("__first"))
    ids = ranked(sized, F.desc("__first"), F.round("area", 9), *ties, F.col(key), name="id")
    return ids.select(key, *ties, "area", (F.col("id") + 1).alias("id"))


#: Members of a shape that are looked at together by :func:`_features`.
MEMBERS = 1_000


def _alike(parts: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Parts (``key``, ``same``, ``__part``) with ``__shape``, the first of the parts that are alike in ``same``, the number of ``__lots``
    into which these are dealt and the part's own, and whether its feature has several parts."""
    first = parts.groupBy(*same).agg(F.min("__part").alias("__shape"), F.ceil(F.count("*") / MEMBERS).alias("__lots"))
    several = parts.groupBy(key).agg((F.count("*") > 1).alias("__several"))
    named = parts.select(key, *same, "__part").join(first, same).join(several, key)
    return named.select(key, "__part", "__shape", "__lots", F.pmod(F.xxhash64("__part"), F.col("__lots")).alias("__lot"), "__several")


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has, for work that its bytes don't show."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _met_boxes(shapes: DataFrame, cell: float) -> DataFrame:
    """Pairs of shapes (``__shape`` up to ``__shape2``) whose boxes share an area, each once: in the cell of the corner where it begins."""
    gridded = shapes.select("__shape", "__lots", *BOX).withColumn("cy", F.explode(_cells(F.col("miny"), F.col("maxy"), cell))).withColumn("cx", F.explode(_cells(F.col("minx"), F.col("maxx"), cell)))
    other = gridded.select("cy", "cx", *[F.col(c).alias(f"{c}2") for c in ("__shape", "__lots", *BOX)])
    here = (F.col("cy") == F.floor(F.greatest("miny", "miny2") / cell)) & (F.col("cx") == F.floor(F.greatest("minx", "minx2") / cell))
    wide = F.least("maxx", "maxx2") - F.greatest("minx", "minx2")
    high = F.least("maxy", "maxy2") - F.greatest("miny", "miny2")
    met = gridded.join(other, ["cy", "cx"]).where((F.col("__shape") <= F.col("__shape2")) & here).withColumns({"wide": wide, "high": high})
    return met.where("wide > 0 AND high > 0")


#: Pairs of features that one task makes, about: a file of some 100 MB.
PAIRS = 4_000_000


def _features(met: DataFrame, members: DataFrame, key: str, total: Callable[[str], Column]) -> DataFrame:
    """Pairs of different features (``key`` and ``key2``) from pairs of shapes with both's ``__lots`` and their ``area``.

    Lots meet lots, each a row with its members' keys, so no key of a shape with many members is one task's work. There are more pairs
    than any table's bytes show, so they are counted from the lots' sizes, and lots are dealt over as many tasks as there are
    ``PAIRS``: a task's work stays the same as tables grow. It makes its pairs from the two lists, without a join. Only where one
    of the features has several parts, a pair's areas meet for their ``total``. All others have one area, so they aren't shuffled.
    """
    a, b = F.col("__a"), F.col("__b")
    lots = staged(members.groupBy("__shape", "__lot", "__several").agg(F.collect_list(key).alias("__keys"), F.count(key).alias("__n")))
    sizes = lots.groupBy("__shape", "__several").agg(F.sum("__n").alias("__n"))
    second = lambda df: df.withColumnsRenamed({c: f"{c}2" for c in df.columns})
    counted = met.join(sizes, "__shape").join(second(sizes), "__shape2").groupBy("__several", "__several2").agg(F.sum(F.col("__n") * F.col("__n2")).alias("pairs"))
    tasks = {(r["__several"], r["__several2"]): -(-r["pairs"] // PAIRS) for r in counted.collect()}
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = met.withColumn("__lot", every("__lots")).withColumn("__lot2", every("__lots2"))

    def pairs(left: bool, right: bool, alike: Column) -> DataFrame:
        """Of members that have several parts or one, as ``left`` and ``right`` say; ``alike``: which pairs of two members of one shape count."""
        of = lambda several: lots.where("__several" if several else "NOT __several").select("__shape", "__lot", "__keys")
        both = asked.join(of(left), ["__shape", "__lot"]).join(second(of(right)), ["__shape2", "__lot2"])
        dealt = both.repartition(max(1, tasks.get((left, right), 1)), "__shape", "__lot", "__shape2", "__lot2")
        each = dealt.select("__shape", "__shape2", "area", "__keys2", F.explode("__keys").alias("__a")).select("__shape", "__shape2", "area", "__a", F.explode("__keys2").alias("__b"))
        return each.where((a != b) & ((F.col("__shape") != F.col("__shape2")) | alike)).select(F.least(a, b).alias(key), F.greatest(a, b).alias(f"{key}2"), "area")

    together = [pairs(True, True, a < b), pairs(True, False, F.lit(True)), pairs(False, True, F.lit(False))]
    return pairs(False, False, a < b).unionByName(reduce(DataFrame.unionByName, together).groupBy(key, f"{key}2").agg(total("area").alias("area")))


def polygon_overlaps(parts: DataFrame, key: str, least: float = 1e-7, cell: float = CELL) -> DataFrame:
    """Pairs of different features (``key`` and ``key2``) that share more than ``least`` square degrees, with the exact ``area``.

    ``parts`` has ``key`` and ``rings``; parts of one feature don't overlap each other. Parts with equal rings are one shape. Boxes of shapes meet
    by cells, rings are joined only to pairs whose boxes share an area, and pairs are dealt over all tasks, however few bytes
    they have, before their areas are worked out, a batch together.
    """
    known = staged(_boxed(parts.select(key, "rings")).withColumns({"__part": F.monotonically_increasing_id(), "__digest": F.sha2(F.col("rings").cast("string"), 256)}))
    members = staged(_alike(known, key, ["__digest"]))
    shapes = known.join(members.where("__part = __shape").select("__part", "__shape", "__lots"), "__part")
    met = _dealt(_met_boxes(shapes, cell).select("__shape", "__shape2", "__lots", "__lots2"), "__shape", "__shape2")
    rings = shapes.select("__shape", "rings")
    pairs = met.join(rings, "__shape").join(rings.select(F.col("__shape").alias("__shape2"), F.col("rings").alias("rings2")), "__shape2").select("__shape", "__shape2", "__lots", "__lots2", "rings", "rings2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = pa.array(polygons.shared_areas(batch.column(4), batch.column(5)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], areas], names=["__shape", "__shape2", "__lots", "__lots2", "area"])

    sized = staged(pairs.mapInArrow(run, "__shape long, __shape2 long, __lots long, __lots2 long, area double"))
    return _features(sized, members, key, F.sum).where(F.col("area") > least)


def overlaps(parts: DataFrame, key: str, cell: float = CELL) -> DataFrame:
    """Pairs of different features whose parts' boxes share an area, the largest such area; equal boxes meet through the grid cells once."""
    known = staged(parts.select(key, *BOX).withColumn("__part", F.monotonically_increasing_id()))
    members = staged(_alike(known, key, BOX))
    shapes = known.join(members.where("__part = __shape").select("__part", "__shape", "__lots"), "__part")
    met = staged(_met_boxes(shapes, cell).select("__shape", "__shape2", "__lots", "__lots2", (F.col("wide") * F.col("high")).alias("area")))
    return _features(met, members, key, F.max)
