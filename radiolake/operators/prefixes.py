"""Callsigns resolved by a prefix list: the call's deciding part, masks as patterns, and a tree walked by joins.

An entry of the list has masks. A mask has characters that stand for themselves, ``#`` for a digit, ``@`` for a letter,
``?`` for either, a class of these in brackets, a final ``.`` (the call ends here; where it ends before, it ends with a digit), and
an ending after a slash. Entities (kinds 1 and 6) are found by the call's first two characters; below an entity that is hit, provinces, cities
and stations are asked level by level. An entity is hit by a mask that the call fills, or that the call begins (with
any ending); the others only by a mask that the call fills, with the same ending. Hits without a place become attributes
of what is above them; every other hit that has no placed hit below it is an answer, with what it lacks from above. The
answers go from the last to the first in the order of the tree, and the first answer is the best one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.shared import staged

# The grammar's kinds, one-character prefixes, endings that decide nothing, and special forms.
ENTITIES, BELOW = (1, 6), (2, 3, 9)
ENTITY, PROVINCE, STATION, CITY = 1, 2, 3, 9
SAFE_ONE_CHARACTER, ONE_CHARACTER = "UGFIKNW", "UGFIKNWRBM"
IGNORED_ENDINGS = ("AM", "MM", "QRP", "A", "B", "BCN", "LH")
ANTARCTICA = "ADIF013"
#: Entries up to which a list's masks are broadcast; prefixes of the world are some thousands.
MOST_BROADCAST = 100_000
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What an answer takes from its deepest entry with a place that has it.
PLACED = ["prefix", "cq", "itu", "continent", "tz", "dxcc", "province_code"]
HIT = ["kind", "territory", "lon", "lat", *PLACED]


# --- the call -----------------------------------------------------------------------------------------------------


def formatted(calls: DataFrame, call: str = "call", name: str = "formatted") -> DataFrame:
    """Adds the part of the call that decides, with its ending after a slash; null if the call can't be resolved.

    Upper case without white space; ``/MM`` at the end is at sea and nowhere, ``/ANT`` is Antarctica. Endings of no meaning are dropped;
    of what stays there are at most three parts and the third has one character. A lone digit replaces the district's in the first part. Some
    letters are prefixes by themselves and get a 0. The shorter of two parts decides if it has two characters.
    """
    white = "[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
    s = F.regexp_replace(F.upper(F.coalesce(F.col(call), F.lit(""))), white, "")
    df = calls.withColumn("__s", s)
    s = F.col("__s")
    able = (F.length(s) >= 2) & ~s.rlike("^/|//|/MM$") & s.rlike("^[A-Z0-9/]+$")
    parts = F.split(F.regexp_replace(s, "/$", ""), "/")
    told = F.filter(parts, lambda p, i: (i == 0) | ~p.isin(*IGNORED_ENDINGS))
    df = df.withColumn("__p", F.when(able, told)).withColumn("__p", F.when(F.size("__p") <= 3, F.col("__p")))
    for i in (1, 2, 3):
        df = df.withColumn(f"__{i}", F.coalesce(F.try_element_at("__p", F.lit(i)), F.lit("")))
    df = df.withColumn("__ok", F.col("__p").isNotNull() & (F.length("__3") <= 1))
    one, two, three = (F.col(f"__{i}") for i in (1, 2, 3))
    kept = (one.startswith("HK") & (two == "0M")) | (one.startswith("FR") & (two == "G"))
    district = two.rlike("^[0-9]$")
    stem = F.when(one.rlike("^[IKNWR][0-9]"), F.substring(one, 1, 1)).when(one.rlike("^..[0-9]"), F.substring(one, 1, 2)).when(one.rlike("^...[0-9]"), F.substring(one, 1, 3))
    moved = F.when(~three.rlike("^[0-9]$"), F.concat(stem, two))
    df = df.withColumns({"__kept": kept, "__district": district, "__moved": moved}).withColumns(
        {"__ok": F.col("__ok") & (kept | ~district | moved.isNotNull()), "__1": F.when(district & ~kept, moved).otherwise(one), "__2": F.when(district & ~kept, F.lit("")).otherwise(two)}
    )
    one, two = F.col("__1"), F.col("__2")
    alone = one.rlike(f"^[{ONE_CHARACTER}]$")
    second = ~alone & (((F.length(two) == 1) & (F.length(three) == 1) & one.rlike(f"^[{ONE_CHARACTER}]")) | two.rlike(f"^[{SAFE_ONE_CHARACTER}]$"))
    df = df.withColumns({"__1": F.when(alone, F.concat(one, F.lit("0"))).otherwise(one), "__2": F.when(second, F.concat(two, F.lit("0"))).otherwise(two)})
    body = F.when((F.length(two) > 1) & (F.length(two) < F.length(one)), two).otherwise(one)
    ending = F.when(F.length(two) == 1, two).otherwise(three)
    able = F.col("__ok") & (F.length(body) >= 2) & ~((F.length(two) == 1) & (three != ""))
    usual = F.when(able, F.concat(body, F.when(ending != "", F.concat(F.lit("/"), ending)).otherwise("")))
    special = F.when(F.col("__s").endswith("/MM"), None).when(F.col("__s").endswith("/ANT"), ANTARCTICA).when(F.col("__ok") & F.col("__kept"), F.concat_ws("/", F.element_at("__p", 1), F.element_at("__p", 2))).otherwise(usual)
    return df.withColumn(name, special).drop("__s", "__p", "__1", "__2", "__3", "__ok", "__kept", "__district", "__moved")


# --- the masks ----------------------------------------------------------------------------------------------------


def elements(mask: Column) -> Column:
    """The mask's places as classes of a regular expression; a bracket that isn't closed allows nothing."""
    inside = lambda e: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(e, 2, 1 << 20), "([\\\\^&\\[])", "\\\\$1"), "#", "0-9"), "@", "A-Z"), "\\?", "0-9A-Z")
    place = lambda e: F.when(e.rlike("^\\[."), F.when(e == "[]", "(?!)").otherwise(F.concat(F.lit("["), inside(e)))).when(e == "[", "(?!)").when(e == "#", "[0-9]").when(e == "@", "[A-Z]").when(e == "?", "[0-9A-Z]").when(e.rlike("[A-Za-z0-9]"), e).otherwise(F.concat(F.lit("\\"), e))
    return F.transform(F.regexp_extract_all(mask, F.lit("\\[[^\\]]*\\]|."), F.lit(0)), place)


def masks(entries: DataFrame) -> DataFrame:
    """One row for each mask of each entry (see :func:`dumps.prefix_list`).

    ``filled`` is the pattern of calls that fill the mask, ``begun`` that of shorter ones that begin it (null if
    there is none), ``ending`` the mask's from its slash on, ``stems`` the first two characters that lead to it.
    """
    each = entries.select("id", "kind", "parent", F.explode(F.filter(F.transform(F.split("mask", ","), lambda m: F.trim(m)), lambda m: m != "")).alias("mask"))
    # the first slash outside brackets parts the prefix from the ending
    prefix = F.regexp_extract("mask", "^((?:\\[[^\\]]*\\]|[^/])*)", 1)
    each = each.withColumns({"__e": elements(prefix), "ending": F.nullif(F.expr("substring(mask, length(regexp_extract(mask, '^((?:\\\\[[^\\\\]]*\\\\]|[^/])*)', 1)) + 1)"), F.lit("")), "__a": elements(F.col("mask"))})
    e = F.col("__e")
    n, stops = F.size(e), F.element_at(e, -1) == "\\."
    filled = F.concat(F.lit("^"), F.array_join(F.when(stops, F.slice(e, 1, n - 1)).otherwise(e), ""), F.when(stops, "$").otherwise(""))
    # what may be missing at the end, from the last place inwards: one place or more is missing
    places = F.when(stops, F.slice(e, 1, n - 1)).otherwise(e)
    longest = F.when(F.size(places) > 1, F.slice(places, 1, F.size(places) - 1))
    nested = F.aggregate(F.slice(F.reverse(longest), 1, F.size(longest) - 1), F.lit(""), lambda rest, p: F.concat(F.lit("(?:"), p, rest, F.lit(")?")))
    begun = F.concat(F.lit("^"), F.element_at(longest, 1), nested, F.when(stops, "(?<=[0-9])").otherwise(""), F.lit("$"))
    characters = F.array(*[F.lit(c) for c in ALPHABET])
    of = lambda k: F.filter(characters, lambda c: F.regexp_like(c, F.concat(F.lit("^"), F.element_at("__a", k))))
    stems = F.flatten(F.transform(of(1), lambda a: F.transform(F.when(F.size("__a") > 1, of(2)).otherwise(characters), lambda b: F.concat(a, b))))
    return each.where(n > 0).withColumns({"filled": filled, "begun": begun, "stems": stems}).drop("__e", "__a", "mask")


def _bounded(df: DataFrame) -> DataFrame:
    """A part of the list, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _fills(prefix: Column, ending: Column) -> Column:
    """Whether a call fills a mask (``filled``, ``m_ending``) with the ending that it asks for, or with M or P if it asks for none."""
    equal = F.col("m_ending").eqNullSafe(ending) | (F.col("m_ending").isNull() & ending.isin("/M", "/P"))
    return F.regexp_like(prefix, F.col("filled")) & equal


# --- the walk -----------------------------------------------------------------------------------------------------


def asked(calls: DataFrame, call: str = "call") -> DataFrame:
    """The distinct calls that can be formatted, with ``formatted``, written once; null calls are left out.

    It is written so that no filter on the formatted call is worked out of its whole expression again.
    """
    return staged(formatted(calls.select(call).where(F.col(call).isNotNull()).distinct(), call)).where("formatted is not null")


def hits(calls: DataFrame, entries: DataFrame, call: str = "call") -> DataFrame:
    """All entries that take each of the calls ``asked``: ``call``, ``path`` (ids from the entity down) and the entry's columns.

    Entities by stems and patterns, then one join for each level below; the walk ends where a level has no hit. The list
    is broadcast while it is small, and each level is written once.
    """
    parts = {"__prefix": F.substring_index("formatted", "/", 1), "__ending": F.nullif(F.expr("substring(formatted, length(substring_index(formatted, '/', 1)) + 1)"), F.lit(""))}
    rules = staged(masks(entries)).withColumnRenamed("ending", "m_ending")
    top = rules.where(F.col("kind").isin(*ENTITIES))
    stems = _bounded(top.select("id", F.explode("stems").alias("stem")).distinct())
    patterns = _bounded(top.select("id", "filled", "begun", "m_ending"))
    prefix, ending = F.col("__prefix"), F.col("__ending")
    taken = _fills(prefix, ending) | F.coalesce(F.regexp_like(prefix, F.col("begun")), F.lit(False))
    keys = [call, "__prefix", "__ending"]
    found = calls.withColumns(parts).withColumn("stem", F.substring("__prefix", 1, 2)).join(stems, "stem").join(patterns, "id").where(taken)
    level = staged(found.select(*keys, "id").distinct().withColumn("path", F.array("id")))
    below = _bounded(rules.where(F.col("kind").isin(*BELOW) & F.col("parent").isNotNull()).select(F.col("id").alias("child"), F.col("parent").alias("id"), "filled", "m_ending"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        level = staged(level.join(below, "id").where(_fills(prefix, ending)).select(*keys, F.col("child").alias("id"), F.concat("path", F.array("child")).alias("path")).distinct())
    number = lambda c: F.try_to_number(c, F.lit("S99999")).cast("int").alias(c)
    data = entries.withColumnRenamed("province", "province_code").select("id", *[number(c) if c in ("lon", "lat") else c for c in HIT])
    return reduce(DataFrame.unionByName, levels or [level]).select(call, "id", "path").join(_bounded(staged(data)), "id")


def resolve_all(calls: DataFrame, entries: DataFrame, call: str = "call") -> DataFrame:
    """Each distinct call with all its answers and their ``place``, the best one first.

    Columns: the answer's entry (``id``), ``territory``, ``province``, ``city``, the columns of ``PLACED``, ``lat`` and
    ``lon`` (degrees) and ``attributes`` (territories of hits without a place). ``entries`` is a prefix list (see
    :func:`dumps.prefix_list`). A call that is null, can't be formatted or that no entry takes has no row; repeated calls
    count once; an empty list gives no rows. A call's hits are at most the list's entries, so they are one row's array.
    """
    calls = asked(calls, call)
    each = hits(calls, entries, call)
    row = F.struct("path", "id", *HIT)
    groups = each.groupBy(call).agg(F.reverse(F.array_sort(F.collect_list(row))).alias("hits"))
    above = lambda h, a: F.slice(h["path"], 1, F.size(a["path"])) == a["path"]
    placed = lambda h: h["lon"].isNotNull()
    answers = F.filter("hits", lambda h: placed(h) & ~F.exists("hits", lambda d: placed(d) & above(d, h) & (F.size(d["path"]) > F.size(h["path"]))))
    opened = groups.select(call, "hits", F.posexplode(answers).alias("at", "h"))
    # deepest first, as the hits are in the tree's order backwards
    opened = opened.withColumn("line", F.filter("hits", lambda a: above(F.col("h"), a)))
    first = lambda c: F.try_element_at(F.filter(F.transform(F.filter("line", placed), lambda a: a[c]), lambda v: v.isNotNull() & (v != "")), F.lit(1))
    of = lambda condition: F.transform(F.filter("line", condition), lambda a: F.coalesce(a["territory"], F.lit("")))
    named = lambda names: F.nullif(F.coalesce(names, F.lit("")), F.lit(""))
    last = lambda names: named(F.try_element_at(names, F.lit(-1)))
    lost = F.flatten(F.transform("line", lambda a: F.transform(F.filter("hits", lambda u: ~placed(u) & (F.size(u["path"]) == F.size(a["path"]) + 1) & above(u, a)), lambda u: F.coalesce(u["territory"], F.lit("")))))
    tree = opened.select(
        call,
        (F.col("at") + 1).alias("place"),
        F.col("h.id").alias("id"),
        last(of(lambda a: a["kind"].isin(*ENTITIES))).alias("territory"),
        named(F.array_join(F.reverse(of(lambda a: a["kind"] == PROVINCE)), ", ")).alias("province"),
        last(of(lambda a: (a["kind"] == CITY) | ((a["kind"] == STATION) & placed(a)))).alias("city"),
        *[first(c).alias(c) for c in PLACED],
        (F.col("h.lat") / 180).alias("lat"),
        (F.col("h.lon") / 180).alias("lon"),
        lost.alias("attributes"),
    )
    return _by_number(calls, entries, call, tree)


def _by_number(calls: DataFrame, entries: DataFrame, call: str, tree: DataFrame) -> DataFrame:
    """The answers, where calls that stand for an entity's number have that entity as it is listed, if it is."""
    numbered = calls.select(call, F.regexp_extract("formatted", "^ADIF0*([1-9][0-9]*)", 1).alias("number")).where("number <> ''")
    number = F.regexp_replace(F.trim("dxcc"), "^0+", "")
    listed = entries.where((F.col("kind") == ENTITY) & F.trim("dxcc").rlike("^[0-9]+$")).groupBy(number.alias("number")).agg(F.min_by(F.struct("*"), "id").alias("e"))
    degrees = lambda c: (F.try_to_number(F.col(f"e.{c}"), F.lit("S99999")).cast("int") / 180).alias(c)
    own = numbered.join(_bounded(listed), "number").select(
        call,
        F.lit(1).alias("place"),
        "e.id",
        "e.territory",
        *[F.lit(None).cast("string").alias(c) for c in ("province", "city")],
        *[F.col("e." + ("province" if c == "province_code" else c)).alias(c) for c in PLACED],
        degrees("lat"),
        degrees("lon"),
        F.array().cast("array<string>").alias("attributes"),
    )
    return tree.join(own.select(call), call, "left_anti").unionByName(own)


def resolve(calls: DataFrame, entries: DataFrame, call: str = "call") -> DataFrame:
    """Each distinct call with its best answer (see :func:`resolve_all`)."""
    return resolve_all(calls, entries, call).where("place = 1").drop("place")


def distances(answers: DataFrame, lat: Column, lon: Column, radius: float = 3958.8) -> DataFrame:
    """Adds ``miles``, the great-circle distance of each answer's place from a point, rounded; null without a place."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    part = half(F.col("lat"), lat) + F.cos(F.radians(lat)) * F.cos(F.radians("lat")) * half(F.col("lon"), lon)
    return answers.withColumn("miles", F.floor(radius * 2 * F.atan2(F.sqrt(part), F.sqrt(1 - part)) + 0.5).cast("long"))
