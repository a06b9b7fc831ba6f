"""Where a contact's station is: operators' entries over looked-up records, and what follows from a position.

Everything works on tables of records with ``latitude``, ``longitude``, ``gridsquare``, ``state``, ``section``,
``county``, ``country``, ``dxcc``, ``cq_zone`` and ``itu_zone``; layers are region parts as in :mod:`spatial`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions import geo, scalars
from radiolake.operators import lookup, spatial

#: Fields that follow from a position, by the layer that gives them; the grid square needs none.
FROM_LAYER = {"cq": ["cq_zone"], "itu": ["itu_zone"], "dxcc": ["country", "dxcc"], "county": ["county", "state", "section"]}
DERIVED = ["gridsquare", *[f for fields in FROM_LAYER.values() for f in fields]]
#: What an entry of each kind recalculates from its position, and what it makes unknown.
RECALCULATED = {
    "coordinates": DERIVED,
    "park": DERIVED,
    "section": ["state", "country", "dxcc", "cq_zone", "itu_zone"],
    "state": ["country", "dxcc", "cq_zone", "itu_zone"],
    "grid": ["country", "dxcc", "cq_zone", "itu_zone"],
}
BLANKED = {"section": ["gridsquare", "county"], "state": ["gridsquare", "county", "section"], "grid": ["county", "section", "state"]}


@dataclass
class Layer:
    """Region parts with the attributes that a position takes from the first part, by ``order``, that holds it."""

    parts: DataFrame
    order: list[Column]
    attributes: list[str] = field(default_factory=list)


def derived(points: DataFrame, layers: dict[str, Layer], key: str) -> DataFrame:
    """``key`` and all fields that follow from ``lat`` and ``lon``: one spatial join for each layer.

    A point in no region of a layer, or without a valid position, has null for its fields.
    """
    usable = geo.valid(F.col("lat"), F.col("lon"))
    out = points.select(key, F.when(usable, geo.maidenhead(F.col("lat"), geo.west(F.col("lon")))).alias("gridsquare"))
    for layer in layers.values():
        found = spatial.region_of(points.select(key, "lat", "lon"), layer.parts, layer.order, key, layer.attributes)
        out = out.join(found, key, "left")
    return out


def recalculated(records: DataFrame, layers: dict[str, Layer], key: str, fields: list[str] | None = None) -> DataFrame:
    """The records with the named fields (all by default) rewritten from their position.

    A field that the position doesn't give becomes null; a record without coordinates stays as it is.
    """
    names = DERIVED if fields is None else fields
    wanted = {n: layer for n, layer in layers.items() if set(layer.attributes) & set(names)}
    found = derived(records.select(key, F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), wanted, key)
    renamed = found.select(key, *[F.col(f).alias(f"__{f}") for f in names])
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    joined = records.join(renamed, key, "left")
    return joined.select(*[F.when(placed, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in records.columns])


def park_reference(typed: Column) -> Column:
    """The first reference of a typed list, without the marks around it, in upper case; null if there is none."""
    first = F.try_element_at(F.filter(F.split(F.trim(typed), ","), lambda t: t != ""), F.lit(1))
    return F.nullif(F.upper(F.btrim(first, F.lit(".,;:()[]"))), F.lit(""))


def parks_of(rows: DataFrame, parks: DataFrame, typed: str) -> DataFrame:
    """Rows with ``park_name``, ``park_lat`` and ``park_lon`` of the park that they name exactly.

    A park at (0, 0), which stands for an unknown position, or without a valid one, is no match. Of repeated
    references the first by name counts.
    """
    usable = geo.valid(F.col("latitude"), F.col("longitude")) & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))
    known = parks.where(usable).groupBy(F.col("reference").alias("__reference")).agg(F.min(F.struct("name", "latitude", "longitude")).alias("__park"))
    joined = rows.withColumn("__ref", park_reference(F.col(typed))).join(known, F.col("__ref") == F.col("__reference"), "left")
    return joined.select(*rows.columns, F.col("__park.name").alias("park_name"), F.col("__park.latitude").alias("park_lat"), geo.west(F.col("__park.longitude")).alias("park_lon"))


def _anchored(rows: DataFrame, anchors: DataFrame, code: str, name: str) -> DataFrame:
    """Rows with ``<name>_lat`` and ``<name>_lon``, where the members of the code in column ``code`` are."""
    known = anchors.select(F.col("code").alias("__code"), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
    return rows.join(known, F.col(code) == F.col("__code"), "left").drop("__code")


def postprocess(records: DataFrame, key: str, layers: dict[str, Layer], parks: DataFrame, sections: DataFrame, states: DataFrame, section_of_state: DataFrame, home: tuple[float, float]) -> DataFrame:
    """Records after what the operator typed: position, the fields that follow from it, ``distance`` and ``pota_park``.

    ``typed_latitude``, ``typed_longitude``, ``typed_park``, ``typed_section``, ``typed_state`` and ``typed_grid`` are
    raw text. The first kind of entry that is there, differs from the record and can be resolved is applied, in this
    order: both coordinates, a park, a section, a state, a grid square; one that can't be resolved changes nothing.
    Each kind recalculates some fields and makes others unknown (RECALCULATED, BLANKED); a state that has one section
    only gives it. Without an entry only missing zones are filled. ``sections`` and ``states`` have the anchors of
    their codes (code, lat, lon), ``section_of_state`` the states with one section. Each layer is joined once.
    """
    rows = parks_of(records, parks, "typed_park").withColumns({
        "__lat": scalars.number(F.col("typed_latitude")), "__lon": scalars.number(F.col("typed_longitude")), "__section": scalars.upper(F.col("typed_section")),
        "__state": scalars.state(F.col("typed_state")), "__as_typed": scalars.upper(F.col("typed_state")), "__grid": scalars.gridsquare(F.col("typed_grid")),
    })
    rows = _anchored(_anchored(_anchored(rows, sections, "__section", "s"), states, "__as_typed", "t"), states, "__state", "u")
    differs = lambda typed, of: F.col(typed).isNotNull() & ~F.col(typed).eqNullSafe(F.col(of))
    both = F.col("__lat").isNotNull() & F.col("__lon").isNotNull()
    kind = (
        F.when(both & (~F.col("__lat").eqNullSafe(F.col("latitude")) | ~F.col("__lon").eqNullSafe(F.col("longitude"))), "coordinates")
        .when(F.col("park_lat").isNotNull(), "park")
        .when(differs("__section", "section") & F.col("s_lat").isNotNull(), "section")
        .when(differs("__state", "state") & F.coalesce("t_lat", "u_lat").isNotNull(), "state")
        .when(differs("__grid", "gridsquare"), "grid")
    )
    center = geo.grid_center(F.col("__grid"))
    by_kind = {
        "coordinates": ("__lat", "__lon"), "park": ("park_lat", "park_lon"), "section": ("s_lat", "s_lon"),
        "state": (F.coalesce("t_lat", "u_lat"), F.coalesce("t_lon", "u_lon")), "grid": (center[0].cast("double"), center[1].cast("double")),
    }

    def chosen(axis: int, otherwise: str) -> Column:
        out = None
        for name, pair in by_kind.items():
            value = F.col(pair[axis]) if isinstance(pair[axis], str) else pair[axis]
            out = F.when(F.col("__kind") == name, value) if out is None else out.when(F.col("__kind") == name, value)
        return out.otherwise(F.col(otherwise))

    rows = rows.withColumn("__kind", kind).withColumns({"__y": chosen(0, "latitude"), "__x": chosen(1, "longitude")})
    found = derived(rows.select(key, F.col("__y").alias("lat"), F.col("__x").alias("lon")), layers, key)
    rows = rows.join(found.select(key, *[F.col(f).alias(f"__new_{f}") for f in DERIVED]), key, "left")
    one = section_of_state.select(F.col("state").alias("__one_state"), F.col("section").alias("__one_section"))
    code = F.when(F.col("t_lat").isNotNull(), F.col("__as_typed")).otherwise(F.col("__state"))
    rows = rows.withColumn("__code", code).join(one, F.col("__code") == F.col("__one_state"), "left")

    def after(name: str) -> Column:
        value = F.col(name)
        new, of = F.col(f"__new_{name}"), F.col("__kind")
        cases = F.when(of.isin(*[k for k, fields in RECALCULATED.items() if name in fields]), new)
        typed = {"section": [("section", "__section"), ("state", "__one_section")], "state": [("state", "__code")], "gridsquare": [("grid", "__grid")]}
        for branch, given in typed.get(name, []):
            cases = cases.when(of == branch, F.col(given))
        cases = cases.when(of.isin(*[k for k, fields in BLANKED.items() if name in fields]), F.lit(None))
        if name in ("cq_zone", "itu_zone"):
            cases = cases.when(value.isNull(), new)
        return cases.otherwise(value).alias(name)

    far = geo.valid(F.col("__y"), F.col("__x"))
    distance = F.when(far, geo.kilometres(F.lit(home[0]), F.lit(home[1]), F.col("__y"), geo.west(F.col("__x"))))
    park = F.when(F.col("__kind") == "park", F.nullif("park_name", F.lit("")))
    return rows.select(key, F.col("__y").alias("latitude"), F.col("__x").alias("longitude"), *map(after, DERIVED), distance.alias("distance"), park.alias("pota_park"), F.col("__kind").alias("override"))


def parsed_record(resolved: DataFrame, call: str = "call") -> tuple[list[Column], Column]:
    """A prefix list's answer (territory, continent, zones, number, coordinates in its units) as a record's fields."""
    raw = {"callsign": F.col(call), "source": F.lit("prefix list"), "country": F.col("territory"), "continent": F.col("continent"), "itu_zone": F.col("itu"), "cq_zone": F.col("cq"), "dxcc": F.col("dxcc")}
    if "lat" in resolved.columns:
        raw |= {"latitude": geo.prefix_degrees(F.col("lat").cast("double")), "longitude": geo.prefix_degrees(F.col("lon").cast("double"))}
    return scalars.record(raw)


def section_of_state(places: DataFrame) -> DataFrame:
    """``state`` and ``section`` of the states whose places are all in one section."""
    return lookup.single_valued(places.where("section IS NOT NULL"), "state", "section")


# States without a place, those that several sections share, territories and states with another's section.
MILITARY, SPLIT = ("AA", "AE", "AP"), ("CA", "FL", "MA", "NJ", "NY", "PA", "TX", "WA")
OTHER_SECTION = {"MD": "MDC", "DC": "MDC", "HI": "PAC", "GU": "PAC", "AS": "PAC", "MP": "PAC", "PR": "PR", "VI": "VI"}
PROVINCE_SECTION = {"NL": "NL", "NS": "NS", "NB": "NB", "PE": "PE", "QC": "QC", "MB": "MB", "SK": "SK", "AB": "AB", "BC": "BC", "YT": "TER", "NT": "TER", "NU": "TER"}


def with_section(rows: DataFrame, counties: DataFrame, state: str = "state", county: str = "county") -> DataFrame:
    """Rows with the ``section`` of their state or province, and of their county where several sections share it.

    ``counties`` has the shared ones: state, county, section. A row of a shared state without a known county has null.
    """
    code = F.upper(F.trim(F.coalesce(F.col(state), F.lit(""))))
    own = [s for s in scalars.STATES.values() if s not in (*SPLIT, *OTHER_SECTION)]
    known = counties.select(F.col("state").alias("__state"), F.col("county").alias("__county"), F.col("section").alias("__section"))
    joined = rows.withColumn("__code", code).join(known, (F.col("__code") == F.col("__state")) & (F.col(county) == F.col("__county")), "left")
    fixed = F.when(F.col("__code").isin(*own), F.col("__code")).otherwise(scalars.lookup(OTHER_SECTION | PROVINCE_SECTION, F.col("__code")))
    section = F.when(F.col("__code").isin(*SPLIT, "ON"), F.col("__section")).when(~F.col("__code").isin(*MILITARY), fixed)
    return joined.select(*rows.columns, section.alias("section"))
