"""Queries that resolve callsigns by a prefix list, which is written from a made-up one and the nations and read from its file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.operators import prefixes
from radiolake.plans.tables import table
from radiolake.shared import shared_dir
from radiolake.sources import dumps

QUERIES, SQL = {}, {}

#: A made-up list: kind, level, longitude and latitude (180 times), territory, prefix, zones, continent, time, number, province, masks.
LIST = [
    (1, 0, "-18000", "7200", "Northland", "N", "4", "8", "NA", "-6", "291", "", "K,W,N,A[A-L]"),
    (2, 1, "-21600", "6300", "Westprov", "N6", "3", "6", "", "-8", "", "WP", "[KNW]6, A[A-L]6"),
    (9, 2, "-21500", "6200", "Baycity", "", "", "", "", "", "", "", "[KNW]6[A-C]"),
    (3, 2, "", "", "Club station", "", "", "", "", "", "", "", "[KNW]6@A"),
    (3, 3, "", "", "Club house", "", "", "", "", "", "", "", "K6BA"),
    (2, 1, "-14000", "7600", "Eastprov", "N1", "5", "", "", "", "", "EP", "[KNW]1"),
    (2, 2, "-14100", "7650", "Smallprov", "", "", "", "", "", "", "", "[KNW]1[A-M]"),
    (3, 3, "-13900", "7500", "Oldstation", "", "", "", "", "", "", "", "W1AW"),
    (1, 0, "-28440", "3780", "Far Isles", "KH6", "31", "61", "OC", "-10", "110", "", "KH6.,KH7,[NW]H6#"),
    (1, 0, "0", "9360", "Midland", "G", "14", "27", "EU", "0", "223", "", "G,M,2[DE]"),
    (2, 1, "100", "9300", "Midprov", "", "", "", "", "", "", "MP", "G#.,2E#[A-C]"),
    (1, 0, "-660", "7200", "Southland", "EA", "14", "37", "EU", "-1", "281", "", "E[A-H]"),
    (1, 0, "-2700", "5040", "South Isles", "EA8", "33", "36", "AF", "0", "029", "", "E[A-H]8"),
    (1, 0, "0", "-16200", "Icecap", "CE9", "13", "74", "AN", "", "013", "", "CE9,KC4[A-U],[KW]C4/X"),
    (6, 0, "", "", "Odd land", "X", "", "", "", "", "", "", "X@#"),
    (2, 1, "900", "900", "Odd province", "XP", "1", "2", "AF", "", "", "OP", "X@#[X-Z]"),
    (4, 0, "1", "1", "Skipped", "K", "", "", "", "", "", "", "K"),
    (6, 0, "720", "360", "Rally", "R", "16", "29", "EU", "3", "54", "", "R,U[A-I],R#@/M"),
    (2, 1, "750", "370", "Rallyprov", "R9", "17", "30", "AS", "5", "15", "RP", "R9,U[A-I]9/R,[A-"),
    (1, 0, "540", "90", "Twin", "T", "20", "20", "EU", "2", "77", "", "TA[#?]X,T[A-C]1234567"),
]
_STARTS = ["K6", "K6BA", "W1AW", "N1Z", "KH6", "KH6X", "WH65", "EA8/W1", "EA5", "G4", "G", "2E0", "2E0B", "ZZ9", "EC8", "AK6C", "W1AW/6", "CE9", "KC4A", "WC4", "XA1Y", "XA1B", "R9", "R1A", "UA9", "TA12", "TA1", "T", "HK1", "FR5", "/K1", "K1//", "K-1", " k 6 a", "F/W1", "I2", "9A1", "ABC", "R1"]
_ENDS = ["", "A", "BC", "X/P", "A/6", "XYZ/MM", "/ANT", "/QRP/P", "/", "/0M", "/G", "/R", "/M", "/X", "/B/A/5", "/5/6", "/1/2/3", "/W/Q", "/LH/AM", "/KH6", "/PP/XX"]
_PICK = f"CASE o_orderkey % {len(_STARTS)} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STARTS)) + " END || CASE o_custkey % " + f"{len(_ENDS)} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_ENDS)) + " END"
#: Calls of the list and of the nations' own prefixes.
_CALL = f"CASE WHEN o_orderstatus = 'F' THEN 'Z' || chr(CAST(65 + o_custkey % 26 AS INT)) || (o_orderkey % 10) || CASE WHEN o_orderkey % 2 = 0 THEN 'A/P' ELSE 'BB' END ELSE {_PICK} END"


def _line(r: tuple) -> str:
    return f"{r[0]:02X}{r[1]:02X}|" + "|".join(r[2:12]) + f"|||{r[12]}|"


def prefix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list in one file: the made-up lines, then for each nation an entity and a province below it."""
    nation = table(spark, sf_dir, "nation")
    own = [F.concat(F.lit("Z"), F.char(65 + F.col("n_nationkey") % 26)), (F.col("n_nationkey") * 180).cast("string")]
    entity = F.concat(F.lit("0100|"), own[1], F.lit("|-360|"), "n_name", F.lit("|"), own[0], F.lit("|1|2|AS|4|"), (500 + F.col("n_nationkey")).cast("string"), F.lit("||||"), own[0], F.lit("|"))
    province = F.concat(F.lit("L0201|||"), "n_name", F.lit(" 0||||||||||"), own[0], F.lit("0|"))  # without a place
    lines = nation.select((F.col("n_nationkey") + 1).alias("n"), F.concat_ws("\n", entity, province).alias("value"))
    head = spark.createDataFrame([(0, "a\nb\nc\n" + "\n".join(map(_line, LIST)))], "n long, value string")
    path = shared_dir(spark)
    text = head.unionByName(lines).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda r: r["value"]), "\n").alias("value"))
    text.coalesce(1).write.text(path)
    return dumps.prefix_list(spark, path)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.expr(_CALL).alias("call"))


QUERIES["call_format"] = lambda spark, sf_dir: prefixes.formatted(calls(spark, sf_dir).distinct())
QUERIES["call_parser_all"] = lambda spark, sf_dir: prefixes.resolve_all(calls(spark, sf_dir), prefix_entries(spark, sf_dir)).withColumn("attributes", F.concat_ws(";", "attributes"))
QUERIES["call_parser"] = lambda spark, sf_dir: prefixes.resolve(calls(spark, sf_dir), prefix_entries(spark, sf_dir)).select("call", "territory", "province", "city", "cq", "itu", "continent", "dxcc", "lat", "lon")
QUERIES["call_distance"] = lambda spark, sf_dir: prefixes.distances(prefixes.resolve(calls(spark, sf_dir), prefix_entries(spark, sf_dir)), F.lit(40.0), F.lit(-75.0)).select("call", "miles")

_FORMAT = f"""c AS (SELECT DISTINCT {_CALL} AS call FROM orders), s AS (SELECT call, regexp_replace(upper(call), '\\s', '', 'g') AS s FROM c),
p AS (SELECT call, s, CASE WHEN length(s) >= 2 AND s[1] <> '/' AND NOT contains(s, '//') AND regexp_full_match(s, '[A-Z0-9/]*') THEN list_filter(string_split(regexp_replace(s, '/$', ''), '/'), lambda x, i: i = 1 OR x NOT IN ('AM', 'MM', 'QRP', 'A', 'B', 'BCN', 'LH')) END AS l FROM s),
q AS (SELECT call, s, l, coalesce(l[1], '') AS a, coalesce(l[2], '') AS b, coalesce(l[3], '') AS d, l IS NOT NULL AND len(l) <= 3 AND length(coalesce(l[3], '')) <= 1 AS ok FROM p),
r AS (SELECT *, ok AND ((starts_with(a, 'HK') AND b = '0M') OR (starts_with(a, 'FR') AND b = 'G')) AS whole, regexp_full_match(b, '[0-9]') AS lone FROM q),
t AS (SELECT *, CASE WHEN regexp_matches(a, '^[IKNWR][0-9]') THEN a[1] WHEN regexp_matches(a, '^..[0-9]') THEN a[1:2] WHEN regexp_matches(a, '^...[0-9]') THEN a[1:3] END AS stem FROM r),
u AS (SELECT call, s, l, whole, d, ok AND (NOT lone OR (stem IS NOT NULL AND NOT regexp_full_match(d, '[0-9]'))) AS ok, CASE WHEN lone THEN stem || b ELSE a END AS a, CASE WHEN lone THEN '' ELSE b END AS b FROM t),
v AS (SELECT call, s, l, whole, ok, d, CASE WHEN a IN ('U','G','F','I','K','N','W','R','B','M') THEN a || '0' ELSE a END AS a,
  CASE WHEN a IN ('U','G','F','I','K','N','W','R','B','M') THEN b WHEN length(b) = 1 AND length(d) = 1 AND a[1] IN ('U','G','F','I','K','N','W','R','B','M') THEN b || '0' WHEN b IN ('U','G','F','I','K','N','W') THEN b || '0' ELSE b END AS b FROM u),
f AS (SELECT call, CASE WHEN ends_with(s, '/MM') THEN NULL WHEN ends_with(s, '/ANT') THEN 'ADIF013' WHEN whole THEN l[1] || '/' || l[2] WHEN ok AND NOT (length(b) = 1 AND d <> '') AND length(CASE WHEN length(b) > 1 AND length(b) < length(a) THEN b ELSE a END) >= 2
  THEN CASE WHEN length(b) > 1 AND length(b) < length(a) THEN b ELSE a END || CASE WHEN length(b) = 1 THEN '/' || b WHEN d <> '' THEN '/' || d ELSE '' END END AS formatted FROM v)"""
SQL["call_format"] = f"WITH {_FORMAT} SELECT call, formatted FROM f"


def _rules() -> tuple[str, str]:
    """The made-up list's masks and entries as SQL values: every beginning of a mask is a row of its own."""
    alphabet = [*"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    own = {"#": set(alphabet[:10]), "@": set(alphabet[10:]), "?": set(alphabet)}
    entries, masks, above, n = [], [], {}, 0
    for r in LIST:
        if r[0] == 4:
            continue
        n += 1
        above[r[1]] = n
        entries.append((n, r[0], above[r[1] - 1] if r[1] else 0, *r[2:12]))
        for mask in (m.strip() for m in r[12].split(",")):
            prefix, slash, ending = mask.partition("/")
            places = []
            for p in re.findall(r"\[[^\]]*\]|.", prefix):
                inner = p[1:-1]
                sets = [own.get(x) or ({x} if len(x) == 1 else {c for c in alphabet if x[0] <= c <= x[2]}) for x in re.findall(".-.|.", inner)] if len(p) > 1 else [own.get(p, {p} if p in alphabet else set())]
                places.append("".join(sorted(set().union(*sets))))
            stops = prefix.endswith(".")
            places = places[:-1] if stops else places
            for k in range(len(places) + 1 if all(places) else 0):
                rest = "$" if stops or k < len(places) else ""
                last = "[0-9]" if stops and 0 < k < len(places) else ""
                body = "".join(f"[{p}]" for p in places[:k])
                masks.append((n, k == len(places), "^" + body + rest, last + "$" if last else "", slash + ending))
    return ", ".join(map(repr, masks)).replace('"', "'"), ", ".join(map(repr, entries))


_MASKS, _ENTRIES = _rules()
_TREE = f"""WITH RECURSIVE {_FORMAT}, g AS (SELECT call, formatted, regexp_extract(formatted, '^[^/]*') AS x, regexp_extract(formatted, '/.*$') AS y FROM f WHERE formatted IS NOT NULL),
e(id, kind, parent, lon, lat, territory, prefix, cq, itu, continent, tz, dxcc, prov) AS (VALUES {_ENTRIES} UNION ALL
  SELECT 100 + 2 * n_nationkey, 1, 0, CAST(n_nationkey * 180 AS VARCHAR), '-360', n_name, 'Z' || chr(CAST(65 + n_nationkey % 26 AS INT)), '1', '2', 'AS', '4', CAST(500 + n_nationkey AS VARCHAR), '' FROM nation UNION ALL
  SELECT 101 + 2 * n_nationkey, 2, 100 + 2 * n_nationkey, '', '', n_name || ' 0', '', '', '', '', '', '', '' FROM nation),
m(id, filled, pattern, last, ending) AS (VALUES {_MASKS} UNION ALL SELECT 100 + 2 * n_nationkey, true, '^Z' || chr(CAST(65 + n_nationkey % 26 AS INT)), '', '' FROM nation UNION ALL SELECT 101 + 2 * n_nationkey, true, '^Z' || chr(CAST(65 + n_nationkey % 26 AS INT)) || '0', '', '' FROM nation),
k AS (SELECT DISTINCT call, id, filled AND (ending = y OR (ending = '' AND y IN ('/M', '/P'))) AS full_ FROM g JOIN m ON regexp_matches(x, pattern) AND (last = '' OR regexp_matches(x, last))
  WHERE length(pattern) > 1 AND ((NOT filled) OR ending = y OR (ending = '' AND y IN ('/M', '/P')))),
w AS (SELECT call, k.id, [k.id] AS path FROM k JOIN e USING (id) WHERE kind IN (1, 6) UNION SELECT w.call, e.id, list_append(w.path, e.id) FROM w JOIN e ON e.parent = w.id AND e.kind IN (2, 3, 9) JOIN k ON k.id = e.id AND k.call = w.call AND k.full_),
h AS (SELECT w.call, w.path, e.* FROM w JOIN e USING (id)),
o AS (SELECT * FROM h WHERE lon <> '' AND NOT EXISTS (SELECT 1 FROM h d WHERE d.call = h.call AND d.lon <> '' AND len(d.path) > len(h.path) AND d.path[1:len(h.path)] = h.path)),
a AS (SELECT o.call, o.path AS of_, h.* EXCLUDE (call), len(h.path) AS depth FROM o JOIN h ON h.call = o.call AND o.path[1:len(h.path)] = h.path),
b AS (SELECT call, of_, {", ".join(f"arg_max({c}, depth) FILTER (WHERE lon <> '' AND {c} <> '') AS {c}" for c in ("prefix", "cq", "itu", "continent", "tz", "dxcc", "prov"))}, arg_max(lon, depth) AS lon, arg_max(lat, depth) AS lat,
  arg_min(territory, depth) FILTER (WHERE kind IN (1, 6)) AS territory, string_agg(territory, ', ' ORDER BY depth) FILTER (WHERE kind = 2) AS province, arg_min(territory, depth) FILTER (WHERE kind = 9 OR (kind = 3 AND lon <> '')) AS city FROM a GROUP BY call, of_),
x AS (SELECT a.call, a.of_, string_agg(u.territory, ';' ORDER BY a.depth DESC, u.path DESC) AS attributes FROM a JOIN h u ON u.call = a.call AND u.lon = '' AND len(u.path) = a.depth + 1 AND u.path[1:a.depth] = a.path GROUP BY ALL),
z AS (SELECT b.call, CAST(row_number() OVER (PARTITION BY b.call ORDER BY b.of_ DESC) AS INTEGER) AS place, territory, province, city, prefix, cq, itu, continent, tz, dxcc, prov AS province_code, CAST(lat AS INT) / 180.0::DOUBLE AS lat, CAST(lon AS INT) / 180.0::DOUBLE AS lon, coalesce(attributes, '') AS attributes, b.of_[-1] AS id
  FROM b LEFT JOIN x USING (call, of_) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.call = b.call AND g.formatted = 'ADIF013')
  UNION ALL SELECT g.call, 1, territory, NULL, NULL, prefix, cq, itu, continent, nullif(tz, ''), dxcc, nullif(prov, ''), CAST(lat AS INT) / 180.0::DOUBLE, CAST(lon AS INT) / 180.0::DOUBLE, '', id FROM g JOIN e ON kind = 1 AND dxcc = '013' WHERE g.formatted = 'ADIF013')"""
_NUMBER = f"CAST(CASE WHEN id < 100 THEN id ELSE {sum(r[0] != 4 for r in LIST)} + id - 99 END AS INTEGER) AS id"
SQL["call_parser_all"] = f"{_TREE} SELECT * REPLACE ({_NUMBER}) FROM z"
SQL["call_parser"] = f"{_TREE} SELECT call, territory, province, city, cq, itu, continent, dxcc, lat, lon FROM z WHERE place = 1"
SQL["call_distance"] = f"{_TREE} SELECT call, CAST(floor(2 * 3958.8 * atan2(sqrt(v), sqrt(1 - v)) + 0.5) AS BIGINT) AS miles FROM (SELECT call, sin(radians(lat - 40) / 2) ** 2 + cos(radians(40)) * cos(radians(lat)) * sin(radians(lon + 75) / 2) ** 2 AS v FROM z WHERE place = 1)"
