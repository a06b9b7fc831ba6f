"""Contacts' documents, caches, replicas, orders and small rules over the given tables; a table built from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import geo, places, scalars
from radiolake.operators import etl, forms, location, log, spatial, stats
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.plans.places import POINTS, REGIONS, points
from radiolake.plans.tables import table
from radiolake.shared import ranked

QUERIES, SQL = {}, {}

# --- contacts' documents --------------------------------------------------------------------------------------------

_WHOLE = '{"uuid":"a","remote_callsign":" K1 ","operator_callsign":"W1","operator_initials":"AB","client_uuid":"c","band":"20m","mode":"CW","qso_at":"2024-06-01T12:00:00.123456Z","last_edited":"2024-06-01T08:00:00-04:00","deleted":0,"fields":{"class":"3A"},"name":" Pat "}'
#: Documents of all kinds: whole ones, and what is wrong with the others.
_BODIES = [
    (_WHOLE, None), (_WHOLE.replace('"deleted":0', '"deleted":true'), None), (_WHOLE.replace('"band":"20m",', ""), "missing fields: band"), (_WHOLE.replace('"20m"', '" "'), "band must be a non-empty string"),
    (_WHOLE.replace('"CW"', "5"), "mode must be a non-empty string"), (_WHOLE.replace("2024-06-01T12", "soon"), "bad timestamp: qso_at"), (_WHOLE.replace('{"class":"3A"}', "[1]"), "fields must be a JSON object"),
    (_WHOLE.replace('" Pat "', "7"), "name must be a string"), ("[1, 2]", "contact must be a JSON object"), ('{"uuid":"a"', "contact must be a JSON object"), (None, "contact must be a JSON object"),
]


def contact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lit(None).cast("string")
    for i, (text, _) in enumerate(_BODIES):
        body = F.when(F.col("o_orderkey") % len(_BODIES) == i, F.lit(text)).otherwise(body)
    out = log.checked(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")))
    return out.select("o_orderkey", "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("remote_callsign", "qso_at", "last_edited", "deleted", "name", "comment", "fields")])


QUERIES["contact_check"] = contact_check
_QUOTED = ", ".join(f"({i}, " + ("NULL" if e is None else f"'{e}'") + ")" for i, (_, e) in enumerate(_BODIES))
SQL["contact_check"] = f"""SELECT o_orderkey, error, CASE WHEN error IS NULL THEN 'K1' END AS remote_callsign, CASE WHEN error IS NULL THEN 1717243200123 END AS qso_at, CASE WHEN error IS NULL THEN 1717243200000 END AS last_edited,
  CASE WHEN error IS NULL THEN k = 1 END AS deleted, CASE WHEN error IS NULL THEN 'Pat' END AS name, CASE WHEN error IS NULL THEN '' END AS comment, CASE WHEN error IS NULL THEN '{{"class":"3A"}}' END AS fields
FROM orders JOIN (VALUES {_QUOTED}) v(k, error) ON k = o_orderkey % {len(_BODIES)}"""

_VALUES = {
    "itu_zone": [" 8\t", "91", "08", "\u00a0"], "cq_zone": ["40", "41", "0", "5"], "continent": ["NA", "na", "XX", ""], "gridsquare": ["CN87", "CN8", "SN87", "cn87"], "distance": ["79", "123456", "-1", "0"],
    "state": ["OR", "DX", "ZZ", "or"], "section": ["EMA", "MX", "ZZZ", "WWA"], "rst_sent": ["599", "-13", "609", "5"], "rst_received": ["+05", "100", "59", "x"], "frequency": [" 14.250 ", "0.136\n", "014.250", "\t"],
}
_VALID = {"itu_zone": "1001", "cq_zone": "1001", "continent": "1001", "gridsquare": "1000", "distance": "1001", "state": "1100", "section": "1101", "rst_sent": "1101", "rst_received": "1010", "frequency": "1101"}


def pattern_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.element_at(F.array(*map(F.lit, v)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias(n) for n, v in _VALUES.items()])
    return log.validate(rows, [], log.BUILTIN_PATTERNS).select("o_orderkey", "errors")


QUERIES["pattern_check"] = pattern_check
_WRONG = ["; ".join(f"{n} is not valid" for n in log.BUILTIN_PATTERNS if _VALID[n][i] == "0") for i in range(4)]
SQL["pattern_check"] = "SELECT o_orderkey, CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WRONG)) + " END AS errors FROM orders"

QUERIES["json_records"] = lambda spark, sf_dir: log.responses(log.with_fields(log.migrated(contacts(spark, sf_dir).select("uuid", "band", F.when(F.col("uuid") % 3 != 0, F.col("mode")).alias("name"), F.when(F.col("uuid") % 2 == 0, F.concat(F.lit('{"class": "'), "band", F.lit('"}'))).otherwise("no").alias("fields")))).select("uuid", "name", "comment", "fields", F.lit(None).cast("int").alias("dxcc")))
SQL["json_records"] = f"""WITH {CONTACTS} SELECT '{{"uuid":' || uuid || ',"name":"' || CASE WHEN uuid % 3 <> 0 THEN mode ELSE '' END || '","comment":"","fields":{{' || CASE WHEN uuid % 2 = 0 THEN '"class":"' || band || '"' ELSE '' END || '}},"dxcc":null}}' AS record FROM contacts"""

# --- caches, replicas, orders ---------------------------------------------------------------------------------------


def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put into a cache, and what is still live later; of two answers fetched together the new one counts."""
    answers = lambda t, k, name, at: table(spark, sf_dir, t).select((F.col(k) % 700).alias("call"), F.expr(f"CASE {k} % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_found' ELSE 'error' END").alias("status"), at.cast("long").alias("fetched_ms"), F.lit(name).alias("payload"), F.col(k).alias("n"))
    one = lambda df: df.groupBy("call").agg(F.max_by(F.struct("status", "fetched_ms", "payload"), F.struct("fetched_ms", "n")).alias("s")).select("call", "s.*")
    old, new = one(answers("customer", "c_custkey", "old", F.col("c_custkey") % 900 * 1000)), one(answers("part", "p_partkey", "new", F.col("p_partkey") % 800 * 1000))
    put = forms.cache_put(old, new)
    return put.withColumn("live", F.col("expires_ms") > 1_500_000)


QUERIES["cache_put"] = cache_put
_ANSWER = "SELECT {k} % 700 AS call, CASE {k} % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_found' ELSE 'error' END AS status, {k} % {m} * 1000 AS fetched_ms, '{n}' AS payload, row_number() OVER (PARTITION BY {k} % 700 ORDER BY {k} % {m} DESC, {k} DESC) AS r FROM {t}"
SQL["cache_put"] = f"""WITH b AS (SELECT *, 0 AS new FROM ({_ANSWER.format(k="c_custkey", m=900, n="old", t="customer")}) WHERE r = 1 UNION ALL SELECT *, 1 FROM ({_ANSWER.format(k="p_partkey", m=800, n="new", t="part")}) WHERE r = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY call ORDER BY fetched_ms DESC, new DESC) AS place FROM b),
e AS (SELECT call, status, fetched_ms, payload, fetched_ms + CASE status WHEN 'ok' THEN 31536000000 WHEN 'not_found' THEN 2592000000 ELSE 900000 END AS expires_ms FROM k WHERE place = 1) SELECT *, expires_ms > 1500000 AS live FROM e"""


def replica_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replica's contacts after a pull of those that changed since a cursor; the pulled ones win even if older."""
    rows = contacts(spark, sf_dir).select("uuid", "mode", F.unix_millis(F.col("qso_at").cast("timestamp")).alias("synced_at"))
    local = rows.where("uuid % 3 <> 0").withColumns({"mode": F.lit("local"), "sync_state": F.when(F.col("uuid") % 2 == 0, "pending").otherwise("synced")})
    return log.apply_pull(local, rows.where("uuid % 5 < 3"))


QUERIES["replica_pull"] = replica_pull
SQL["replica_pull"] = f"""WITH {CONTACTS}, r AS (SELECT uuid, mode, epoch_us(qso_at) // 1000 AS synced_at FROM contacts)
SELECT uuid, 'local' AS mode, synced_at, CASE WHEN uuid % 2 = 0 THEN 'pending' ELSE 'synced' END AS sync_state FROM r WHERE uuid % 3 <> 0 AND uuid % 5 >= 3 UNION ALL SELECT uuid, mode, synced_at, 'synced' FROM r WHERE uuid % 5 < 3"""

_AT = "CASE uuid % 4 WHEN 0 THEN 'soon' WHEN 1 THEN concat({t}, 'Z') WHEN 2 THEN concat({t}, '+00:00') ELSE {t} END"
QUERIES["export_order"] = lambda spark, sf_dir: log.export_order(contacts(spark, sf_dir).select("uuid", F.expr(_AT.format(t="date_format(qso_at, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")")).alias("qso_at"))).select("uuid", "place")
SQL["export_order"] = f"WITH {CONTACTS} SELECT uuid, row_number() OVER (ORDER BY CASE WHEN uuid % 4 <> 0 THEN epoch_us(qso_at) // 1000 END NULLS LAST, uuid) - 1 AS place FROM contacts"
QUERIES["chat_order"] = lambda spark, sf_dir: ranked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), F.col("turn"), F.col("conv_id"), F.col("role"), name="place")
SQL["chat_order"] = "SELECT conv_id, turn, role, row_number() OVER (ORDER BY turn, conv_id, role) - 1 AS place FROM conversations"
QUERIES["other_events"] = lambda spark, sf_dir: forms.one_event(contacts(spark, sf_dir).select(F.when(F.col("uuid") % 9 != 0, F.col("band")).alias("event")), "1")
SQL["other_events"] = f"WITH {CONTACTS}, e AS (SELECT CASE WHEN uuid % 9 <> 0 THEN band END AS event FROM contacts) SELECT event, count(*) AS n FROM e WHERE event IS DISTINCT FROM '1' GROUP BY event"

QUERIES["rate_graph"] = lambda spark, sf_dir: stats.rate_graph(contacts(spark, sf_dir).select(F.when(F.col("uuid") % 97 == 0, F.expr("qso_at - INTERVAL 1000 YEARS")).when(F.col("uuid") % 89 != 0, F.col("qso_at")).alias("qso_at"), F.when(F.col("uuid") % 5 != 0, F.col("mode")).alias("mode")))
SQL["rate_graph"] = f"""WITH {CONTACTS}, c AS (SELECT epoch_us(qso_at) // 1000 AS ms, CASE WHEN uuid % 5 <> 0 THEN mode ELSE 'Unknown' END AS mode FROM contacts WHERE uuid % 97 <> 0 AND uuid % 89 <> 0),
w AS (SELECT CASE WHEN ceil((max(ms) - min(ms)) / 43200000) <= 50 THEN 720 ELSE 1440 END AS minutes FROM c), b AS (SELECT minutes, ms // (minutes * 60000) AS bin, mode FROM c, w),
n AS (SELECT minutes, bin, mode, count(*) AS n FROM b GROUP BY ALL), a AS (SELECT bin, sum(n) AS total FROM n GROUP BY bin), every AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin, min(minutes) AS minutes FROM n),
t AS (SELECT greatest(1.0, max(total * 60 / (SELECT minutes FROM w))) AS top FROM a), p AS (SELECT top, pow(10, floor(log10(top))) AS p FROM t)
SELECT every.bin * every.minutes * 60 AS bin_start, CAST(every.minutes AS INTEGER) AS minutes, mode, coalesce(n, 0) AS n, CAST(coalesce(total, 0) * 60 / every.minutes AS DOUBLE) AS rate,
  CASE WHEN top <= p THEN p WHEN top <= 2 * p THEN 2 * p WHEN top <= 5 * p THEN 5 * p ELSE 10 * p END AS top FROM every LEFT JOIN a USING (bin) LEFT JOIN n ON n.bin = every.bin, p"""

# --- small rules ----------------------------------------------------------------------------------------------------

_ADDRESS = "CASE o_orderkey % 8 WHEN 0 THEN 'P.O. Box 7' WHEN 1 THEN ' rr#2' WHEN 2 THEN '12 Boxwood Rd' WHEN 3 THEN 'CP 9' WHEN 4 THEN 'General Delivery X' WHEN 5 THEN 'Gdansk St' WHEN 6 THEN ' ' END"
_POSTAL = "CASE o_orderkey % 5 WHEN 0 THEN ' b4e2x8' WHEN 1 THEN 'B4E 2X8' WHEN 2 THEN 'bo4 2x8' WHEN 3 THEN '' END"


def postal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ADDRESS).alias("a"), F.expr(_POSTAL).alias("p"))
    letters, words = scalars.qualifications([F.when(F.col("o_orderkey") % m == 0, "x").otherwise(" ") for m in (2, 3, 5, 7, 11)])
    return rows.select("o_orderkey", scalars.has_street(F.col("a")).alias("street"), scalars.postal(F.col("p")).alias("postal"), scalars.postal_area(F.trim("p")).alias("area"), letters.alias("letters"), words.alias("words"))


QUERIES["postal_rules"] = postal_rules
SQL["postal_rules"] = """SELECT o_orderkey, o_orderkey % 8 IN (2, 5) AS street, CASE o_orderkey % 5 WHEN 0 THEN 'B4E 2X8' WHEN 1 THEN 'B4E 2X8' WHEN 2 THEN 'BO4 2X8' END AS postal, CASE WHEN o_orderkey % 5 < 2 THEN 'B4E' END AS area,
  nullif(concat(CASE WHEN o_orderkey % 2 = 0 THEN 'A' END, CASE WHEN o_orderkey % 3 = 0 THEN 'B' END, CASE WHEN o_orderkey % 5 = 0 THEN 'C' END, CASE WHEN o_orderkey % 7 = 0 THEN 'D' END, CASE WHEN o_orderkey % 11 = 0 THEN 'E' END), '') AS letters,
  nullif(concat_ws('; ', CASE WHEN o_orderkey % 2 = 0 THEN 'Basic' END, CASE WHEN o_orderkey % 3 = 0 THEN '5 WPM' END, CASE WHEN o_orderkey % 5 = 0 THEN '12 WPM' END, CASE WHEN o_orderkey % 7 = 0 THEN 'Advanced' END, CASE WHEN o_orderkey % 11 = 0 THEN 'Basic with Honours' END), '') AS words FROM orders"""


def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Greater  Town / Grande  Ville' WHEN 1 THEN ' K' WHEN 2 THEN 'US-' ELSE 'US-12' END").alias("t"), F.concat_ws(", ", (F.col("p_size") + 0.5).cast("string"), F.when(F.col("p_partkey") % 3 != 0, "-7.25").otherwise("x")).alias("c"))
    lat, lon = geo.coordinates(F.col("c"))
    return rows.select(
        "p_partkey", scalars.short_name(F.col("t")).alias("short"), scalars.plausible_call(F.col("t")).alias("plausible"), scalars.without_prefix(F.col("t"), "US-").alias("typed"), lat.alias("lat"), lon.alias("lon"),
        scalars.us_date(F.expr("CASE p_partkey % 3 WHEN 0 THEN '02/03/2024' WHEN 1 THEN 'soon' ELSE '' END")).alias("day"), scalars.state(F.expr("CASE p_partkey % 5 WHEN 0 THEN ' on' WHEN 1 THEN 'New  Mexico' WHEN 2 THEN 'ZZ' WHEN 3 THEN 'dc' END")).alias("state"),
        geo.miles(F.lit(45.0), F.lit(-123.0), F.col("p_size").cast("double"), F.col("p_size") * 2.0).alias("miles"),
    )


QUERIES["small_rules"] = small_rules
_M = "(pow(sin(radians(p_size - 45.0) / 2), 2) + cos(radians(45.0)) * cos(radians(CAST(p_size AS DOUBLE))) * pow(sin(radians(p_size * 2 + 123.0) / 2), 2))"
SQL["small_rules"] = f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Greater Town' WHEN 1 THEN 'K' WHEN 2 THEN 'US-' ELSE 'US-12' END AS short, p_partkey % 4 <> 1 AS plausible, CASE p_partkey % 4 WHEN 0 THEN 'Greater  Town / Grande  Ville' WHEN 1 THEN ' K' WHEN 2 THEN '' ELSE 'US-12' END AS typed,
  p_size + 0.5::DOUBLE AS lat, CASE WHEN p_partkey % 3 <> 0 THEN -7.25::DOUBLE END AS lon, CASE p_partkey % 3 WHEN 0 THEN '2024-02-03' WHEN 1 THEN 'soon' END AS day, CASE p_partkey % 5 WHEN 0 THEN 'ON' WHEN 1 THEN 'NM' WHEN 3 THEN 'DC' END AS state,
  floor(3958.8::DOUBLE * 2 * atan2(sqrt({_M}), sqrt(1 - {_M})) + 0.5) AS miles FROM part"""

_STREET = "CASE o_orderkey % 3 WHEN 0 THEN concat(o_custkey % 90, ' North Main Street') WHEN 1 THEN concat('St. Oaks Ave. Apt ', o_custkey % 90) ELSE concat('Saint ', o_custkey % 90, 'th Lanes RR2 S6') END"
QUERIES["street_variants"] = lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(places.street_variants(F.expr(_STREET)), ";").alias("variants"), places.same_street(F.expr(_STREET), F.lit("Main St")).alias("is_main"))
SQL["street_variants"] = """WITH n AS (SELECT o_orderkey, o_orderkey % 3 AS k, CAST(o_custkey % 90 AS VARCHAR) AS n FROM orders)
SELECT o_orderkey, array_to_string(list_sort(CASE k WHEN 0 THEN [n || 'MAIN', n || 'NORTHMAINSTREET', 'MAIN', 'NORTHMAINSTREET'] WHEN 1 THEN ['OAKS', 'STOAKSAVE'] ELSE ['SAINT' || n || 'LANE', 'ST' || n || 'LANE', n || 'LANE'] END), ';') AS variants, k = 0 AS is_main FROM n"""

QUERIES["wkb_layer"] = lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", places.rings_of(F.element_at(F.array(*[F.unhex(F.lit(_wkb(rings))) for _, _, rings in REGIONS], F.unhex(F.lit("0103"))), (F.col("c_custkey") % 6 + 1).cast("int"))).alias("rings")).select("c_custkey", F.size("rings").alias("n_rings"), F.try_element_at("rings", F.lit(1))[0]["lat"].alias("lat"), F.try_element_at("rings", F.lit(1))[0]["lon"].alias("lon"))


def _wkb(rings: list) -> str:
    """A polygon's WKB in hexadecimal, as layers come."""
    import struct

    body = b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *[v for lat, lon in r for v in (lon, lat)]) for r in rings)
    return (struct.pack("<BII", 1, 3, len(rings)) + body).hex()


_FIRST = ", ".join(f"({i}, {len(r)}, {r[0][0][0]}::DOUBLE, {r[0][0][1]}::DOUBLE)" for i, (_, _, r) in enumerate(REGIONS))
SQL["wkb_layer"] = f"SELECT c_custkey, CAST(coalesce(n, 0) AS INTEGER) AS n_rings, lat, lon FROM customer LEFT JOIN (VALUES {_FIRST}) v(k, n, lat, lon) ON k = c_custkey % 6"

QUERIES["suspect_coordinates"] = lambda spark, sf_dir: etl.suspect_coordinates(points(spark, sf_dir).select("c_custkey", F.expr("CASE WHEN c_custkey % 7 = 0 THEN 0D WHEN c_custkey % 9 = 1 THEN 92D ELSE lat END").alias("lat"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN 0D ELSE lon END").alias("lon")), "lat", "lon").select("c_custkey", "problem")
SQL["suspect_coordinates"] = f"WITH {POINTS} SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'placeholder' ELSE 'impossible' END AS problem FROM pts WHERE c_custkey % 7 = 0 OR c_custkey % 9 = 1"

# --- a table from end to end ----------------------------------------------------------------------------------------


def licensee_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licensees from dumps: merged, placed by address, else by area, else by the nearest area; then county and section.

    Each phase adds columns to the table of the one before; nothing is updated in place.
    """
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    merged = etl.merge_dumps(
        orders.select(F.col("o_orderkey").alias("usi"), F.col("o_custkey").alias("owner"), (F.col("o_custkey") % 50).cast("long").alias("area"), (F.col("o_orderkey") % 997).alias("zip")),
        orders.select(F.col("o_orderkey").alias("usi"), F.when(F.col("o_orderstatus") != "P", "A").otherwise("E").alias("status"), F.col("o_orderpriority").alias("service")),
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("usi"), F.col("l_linenumber").alias("position")).agg(F.max("l_quantity").cast("long").alias("class")), "usi", "position",
    )
    keyed = merged.withColumn("address", etl.address_key(F.concat(F.lit("Street "), F.col("owner").cast("string")), F.lit("town")))
    cache = part.select(etl.address_key(F.concat(F.lit("street "), F.col("p_partkey").cast("string")), F.lit("TOWN")).alias("address"), (F.col("p_size") > 10).alias("matched"), F.col("p_size").alias("fetched_at"), F.concat_ws(",", (F.col("p_partkey") % 60 + 0.25).cast("string"), (F.col("p_partkey") * 7 % 300 - 149.75).cast("string")).alias("coordinates"))
    placed = etl.with_coordinates(keyed, cache, "address")
    zips = part.select((F.col("p_partkey") % 50).cast("long").alias("area"), (F.col("p_partkey") * 3 % 997).alias("zip"), F.col("p_partkey").alias("position")).where("position % 4 = 1")
    near = spatial.nearest_key(placed.where("coordinates IS NULL").select("usi", "area", "zip"), zips, "area", "zip", "usi", "position").select("usi", F.concat_ws(",", (F.col("position") % 80 + 0.25).cast("string"), (F.col("position") % 170 + 0.25).cast("string")).alias("by_area"))
    placed = placed.join(near, "usi", "left").withColumn("how", F.when(F.col("coordinates").isNotNull(), "address").when(F.col("by_area").isNotNull(), "area").otherwise("none"))
    lat, lon = geo.coordinates(F.coalesce("coordinates", "by_area"))
    placed = placed.withColumns({"lat": lat, "lon": lon, "state": F.when(F.col("owner") % 2 == 0, "CA").otherwise("or")})
    parts = spark.createDataFrame([(p, f"c{p}", min(x for r in rings for _, x in r), max(x for r in rings for _, x in r), min(y for r in rings for y, _ in r), max(y for r in rings for y, _ in r), rings) for _, p, rings in REGIONS], "part int, county string, minx double, maxx double, miny double, maxy double, rings array<array<struct<lat:double,lon:double>>>")
    counties = spatial.region_of(placed, parts, [F.col("part")], "usi", ["county"])
    shared = spark.createDataFrame([("CA", f"c{p}", f"S{p}") for p in (1, 3, 5)], "state string, county string, section string")
    return location.with_section(placed.join(counties, "usi", "left"), shared).select("usi", "service", "class", "how", "lat", "lon", "county", "section")


QUERIES["licensee_build"] = licensee_build
_EDGE = ", ".join(f"({p}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for _, p, rings in REGIONS for r in rings for a, b in zip(r, r[1:], strict=False))
SQL["licensee_build"] = f"""WITH x AS (SELECT l_orderkey, arg_max(c, l_linenumber) AS class FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(max(l_quantity)) AS BIGINT) AS c FROM lineitem GROUP BY ALL) GROUP BY l_orderkey),
m AS (SELECT o_orderkey AS usi, o_custkey AS owner, o_custkey % 50 AS area, o_orderkey % 997 AS zip, o_orderpriority AS service, class FROM orders LEFT JOIN x ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
z AS (SELECT p_partkey % 50 AS area, p_partkey * 3 % 997 AS zip, p_partkey AS position FROM part WHERE p_partkey % 4 = 1),
near AS (SELECT area, zip, arg_min(position, (d, position)) AS position FROM (SELECT w.area, w.zip, position, abs(w.zip - z.zip) AS d FROM (SELECT DISTINCT area, zip FROM m) w JOIN z USING (area)) GROUP BY area, zip),
p AS (SELECT m.*, CASE WHEN p_partkey IS NOT NULL THEN 'address' WHEN position IS NOT NULL THEN 'area' ELSE 'none' END AS how, CAST(CASE WHEN p_partkey IS NOT NULL THEN p_partkey % 60 ELSE position % 80 END AS DOUBLE) + 0.25 AS lat,
  CASE WHEN p_partkey IS NOT NULL THEN CAST(p_partkey * 7 % 300 AS DOUBLE) - 149.75 ELSE CAST(position % 170 AS DOUBLE) + 0.25 END AS lon FROM m LEFT JOIN part ON p_partkey = owner AND p_size > 10 LEFT JOIN near ON near.area = m.area AND near.zip = m.zip),
e(part, y1, x1, y2, x2) AS (VALUES {_EDGE}), h AS (SELECT usi, min(part) AS part FROM (SELECT usi, part FROM p JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY usi, part HAVING count(*) % 2 = 1) GROUP BY usi)
SELECT usi, service, class, how, lat, lon, 'c' || part AS county, CASE WHEN owner % 2 = 1 THEN 'OR' WHEN part IN (1, 3, 5) THEN 'S' || part END AS section FROM p LEFT JOIN h USING (usi)"""
