"""Place and street names: accents, variants, WKB polygons."""

from __future__ import annotations

import struct
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words for kinds of streets and for directions, markers of units and of rural routes, abbreviations.
STREET_TYPES = (
    "STREET ST STR AVENUE AVE AV ROAD RD DRIVE DR COURT CRT CT CRESCENT CRES CRESC CR BOULEVARD BLVD BOUL BLV PARKWAY PKY PKWY PWY PLACE PL LANE LN "
    "TRAIL TR TRL HIGHWAY HWY ROUTE RTE TERRACE TERR CIRCLE CIR CIRCUIT SQUARE SQ WAY CLOSE CL GATE GROVE GRV HEIGHTS HTS GARDENS GARDEN GDNS GDN MEWS "
    "RIDGE POINT PT BAY PARK PK GREEN GRN LINK LOOP ROW RISE VIEW VILLAS COMMON COMMONS LANDING MANOR HILL HOLLOW PATH WALK WYND CONCESSION CONC "
    "SIDEROAD SIDERD LINE RUE CHEMIN CH MONTEE RANG IMPASSE ALLEE COTE PROMENADE SENTIER CARRE CROISSANT TERRASSE"
)
DIRECTIONS = "N S E W NE NW SE SW NORTH SOUTH EAST WEST NORTHEAST NORTHWEST SOUTHEAST SOUTHWEST NORD SUD EST OUEST"
UNITS = "APT APP APPT SUITE UNIT BUREAU PH PENTHOUSE FLOOR FL RM ROOM LOT BOX CP PO CO"
ROUTES = "RR R S C SITE COMP STN STATION GD"
ABBREVIATED = {"LK": "LAKE", "MT": "MOUNT", "FT": "FORT", "PTE": "POINTE"}


@F.pandas_udf(T.StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """Letters without their combining marks; null stays null. There is no built-in for Unicode decomposition."""
    return texts.map(lambda t: None if t is None else t if t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def place_key(name: Column) -> Column:
    """A town's name for comparing: no accents or apostrophes, upper case, single spaces, Saint and Sainte as ST and STE."""
    plain = F.regexp_replace(F.upper(strip_accents(F.coalesce(name, F.lit("")))), "[.'’`]", "")
    plain = F.regexp_replace(plain, "[^A-Z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "\\bSAINTE\\b", "STE"), "\\bSAINT\\b", "ST"))


# Kinds of populated places, and kinds that are too large to stand for a town.
POPULATED = (
    "CITY", "TOWN", "VILLAGE", "HAMLET", "MUNICIPALITY", "TOWNSHIP", "COMMUNITY", "LOCALITY", "SETTLEMENT", "BOROUGH", "PARISH", "UNINCORPORATED AREA", "INDIAN RESERVE", "INDIAN SETTLEMENT",
    "RURAL COMMUNITY", "NORTHERN HAMLET", "NORTHERN VILLAGE", "NORTHERN COMMUNITY", "RESORT VILLAGE", "SUMMER VILLAGE", "DISTRICT MUNICIPALITY", "REGIONAL MUNICIPALITY", "RURAL MUNICIPALITY", "CHARTERED COMMUNITY",
)
TOO_LARGE = ("PROVINCE", "TERRITORY", "COUNTRY")


def title_parts(title: Column) -> tuple[Column, Column, Column]:
    """Name, province and kind of a geocoder's title ``Name, ..., Province (Kind)``; blank where it has none."""
    kind = F.upper(F.trim(F.regexp_extract(title, "\\(([^)]*)\\)\\s*$", 1)))
    province = F.trim(F.regexp_replace(F.regexp_extract(title, "([^,]*)$", 1), "\\s*\\(.*\\)\\s*$", ""))
    return F.trim(F.split_part(title, F.lit(","), F.lit(1))), province, kind


def street_variants(street: Column) -> Column:
    """The keys under which a street may be known; two names may be the same street if they share one.

    The plain words of the name, without unit and rural-route marks, are read in each of these ways: ``SAINT`` as it is
    or as ``ST``; with all numbers, or without the first or the first two of those it begins with; with or without
    kinds of streets and directions. Numbers at the end of several words don't count, nor does a long word's last S.
    """
    any_of = lambda words: "(?:" + "|".join(words.split()) + ")"
    number = "[0-9]+[A-Z]?"
    plain = F.regexp_replace(F.upper(strip_accents(F.coalesce(street, F.lit("")))), "[.'’`]", "")
    plain = F.trim(F.regexp_replace(plain, "[^A-Z0-9]+", " "))
    plain = F.regexp_replace(plain, "\\b([0-9]+)(?:ST|ND|RD|TH|E|ER|RE)\\b", "$1")
    for short, full in ABBREVIATED.items():
        plain = F.regexp_replace(plain, f"\\b{short}\\b", full)
    tidy = lambda c: F.trim(F.regexp_replace(c, " +", " "))
    plain = tidy(F.regexp_replace(plain, f"\\b(?:{any_of(UNITS)}|STE(?= {number}\\b))\\b(?: {number}\\b)?", ""))
    plain = F.trim(F.regexp_replace(plain, f"(?:(?:^| ){any_of(ROUTES)}[0-9]*)+$", ""))
    # each step gives several texts, of which equal ones go on once; a lambda's text is computed once
    each = lambda texts, use: F.array_distinct(F.flatten(F.transform(texts, lambda t: F.array(*use(t)))))
    saint = lambda t: F.regexp_replace(F.regexp_replace(t, "\\bSAINTE\\b", "STE"), "\\bSAINT\\b", "ST")
    named = lambda t, n: F.trim(F.regexp_replace(t, f"^(?:{number}(?: |$)){{0,{n}}}", ""))
    typeless = lambda t: tidy(F.regexp_replace(t, f"\\b(?:{any_of(STREET_TYPES)}|{any_of(DIRECTIONS)})\\b", ""))
    short = lambda t: F.regexp_replace(t, f"^([^ ]+(?: [^ ]+)*?)(?: {number})+$", "$1")
    key = lambda t: F.replace(F.regexp_replace(short(t), "\\b([A-Z0-9]{4,})S\\b", "$1"), F.lit(" "), F.lit(""))
    texts = each(F.array(plain), lambda t: (t, saint(t)))
    texts = each(texts, lambda t: (t, named(t, 1), named(t, 2)))
    texts = each(texts, lambda t: (t, typeless(t)))
    return F.array_sort(F.filter(each(texts, lambda t: (key(t),)), lambda k: k != ""))


def same_street(a: Column, b: Column) -> Column:
    """Whether two names may be the same street."""
    return F.arrays_overlap(street_variants(a), street_variants(b))


def wkb_rings(value: bytes | None) -> list[list[tuple[float, float]]]:
    """Rings of (lat, lon) of a WKB polygon in either byte order; none of anything else or of a cut-off value."""
    try:
        order = "<" if value[0] == 1 else ">"
        kind, count = struct.unpack_from(f"{order}II", value, 1)
        if kind != 3:
            return []
        rings, at = [], 9
        for _ in range(count):
            (points,) = struct.unpack_from(f"{order}I", value, at)
            flat = struct.unpack_from(f"{order}{2 * points}d", value, at + 4)
            rings.append([(flat[i + 1], flat[i]) for i in range(0, len(flat), 2)])
            at += 4 + 16 * points
        return rings
    except (struct.error, IndexError, TypeError):
        return []


POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


@F.pandas_udf(T.ArrayType(T.ArrayType(POINT)))
def rings_of(values: pd.Series) -> pd.Series:
    """The same for a column of values, to be run once when a layer is taken in."""
    return values.map(lambda v: [[{"lat": y, "lon": x} for y, x in ring] for ring in wkb_rings(v)])
