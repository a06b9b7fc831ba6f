"""Files in the public formats, written from the given tables to the shared folder and read by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.operators import etl
from radiolake.plans.activity import CONTACTS, contacts
from radiolake.plans.tables import table
from radiolake.shared import shared_dir
from radiolake.sources import activity, dumps, exports

QUERIES, SQL = {}, {}


def lines(df: DataFrame, *values: Column) -> str:
    """A folder of text files with a line for each row and value."""
    path = shared_dir(df.sparkSession)
    df.select(F.explode(F.array(*values)).alias("value")).write.text(path)
    return path


def documents(df: DataFrame, group: Column, item: Column, start: str, end: str, between: str = ",") -> str:
    """A folder with one text file for each group: its items between a start and an end."""
    path = shared_dir(df.sparkSession)
    texts = df.groupBy(group.alias("g")).agg(F.concat(F.lit(start), F.array_join(F.array_sort(F.collect_list(item)), between), F.lit(end)).alias("value"))
    texts.repartition("g").write.partitionBy("g").text(path)
    return path


def csv(df: DataFrame, **options) -> str:
    path = shared_dir(df.sparkSession)
    df.write.options(header=True, **options).csv(path)
    return path


def file_pipe_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over two lines, short ones, blank fields; the text is Latin-1's part of UTF-8, that is ASCII."""
    orders = table(spark, sf_dir, "orders")
    record = F.concat_ws("|", F.lit("EN"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit("\r\nmore"))).otherwise(F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 4 != 0, F.lit(" ")), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
    return dumps.pipe_records(spark, lines(orders, record), "EN", ["tag", "key", "name", "blank", "status", "none"]).drop("position")


QUERIES["file_pipe_dump"] = file_pipe_dump
SQL["file_pipe_dump"] = """SELECT 'EN' AS tag, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' more' ELSE '' END AS name, CAST(NULL AS VARCHAR) AS blank, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status, CAST(NULL AS VARCHAR) AS none FROM orders"""

QUERIES["file_semicolon_dump"] = lambda spark, sf_dir: dumps.semicolon_dump(spark, csv(table(spark, sf_dir, "customer").select(F.col("c_name").alias("callsign"), F.concat(F.lit('"'), "c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("city")), sep=";", quote=""), ["callsign", "name", "city"])
SQL["file_semicolon_dump"] = """SELECT c_name AS callsign, '"' || c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS city FROM customer"""

_PARK = {"reference": "CASE WHEN p_partkey % 10 <> 0 THEN concat('US-', p_partkey) END", "name": "p_name", "active": "CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE 'x' END", "entityId": "'291'", "locationDesc": "CASE WHEN p_partkey % 3 = 0 THEN 'US-OR,US-WA' END", "latitude": "CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE concat(p_size, '.5') END", "longitude": "' -1.25'", "grid": "'CN87uo'", "more": "'ignored'"}
QUERIES["file_parks"] = lambda spark, sf_dir: dumps.parks(spark, csv(table(spark, sf_dir, "part").select(*[F.expr(e).alias(n) for n, e in _PARK.items()])), 1)
SQL["file_parks"] = """SELECT 'US-' || p_partkey AS reference, p_name AS name, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 END AS INTEGER) AS active, 291 AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN 'US-OR,US-WA' END AS location_desc,
  CASE WHEN p_partkey % 7 <> 0 THEN p_size + 0.5::DOUBLE END AS latitude, -1.25::DOUBLE AS longitude, 'CN87' AS grid FROM part WHERE p_partkey % 10 <> 0"""


def file_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each region: a triangle for each nation, every third one with a second part."""
    x = F.col("n_nationkey")
    ring = lambda a: F.format_string("[[%d,0],[%d,1],[%d,2],[%d,0]]", a, a + 1, a, a)
    shape = F.when(x % 3 == 0, F.concat(F.lit('"MultiPolygon","coordinates":[['), ring(x), F.lit("],["), ring(x + 50), F.lit("]]"))).otherwise(F.concat(F.lit('"Polygon","coordinates":['), ring(x), F.lit("]")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":'), shape, F.lit('},"properties":{"name":"'), F.col("n_name"), F.lit('"}}'))
    path = documents(table(spark, sf_dir, "nation"), F.col("n_regionkey"), feature, '{"type":"FeatureCollection","features":[', "]}")
    return dumps.geojson(spark, path, ["name"]).select("name", "part", "minx", "maxx", "miny", "maxy", F.size("rings").alias("n_rings"), F.size(F.element_at("rings", 1)).alias("n_points"))


QUERIES["file_geojson"] = file_geojson
SQL["file_geojson"] = """SELECT n_name AS name, CAST(p AS INTEGER) AS part, CAST(n_nationkey + 50 * p AS DOUBLE) AS minx, CAST(n_nationkey + 50 * p + 1 AS DOUBLE) AS maxx, 0.0::DOUBLE AS miny, 2.0::DOUBLE AS maxy, 1 AS n_rings, 4 AS n_points
FROM nation, (VALUES (0), (1)) v(p) WHERE p = 0 OR n_nationkey % 3 = 0"""

QUERIES["file_gazetteer"] = lambda spark, sf_dir: activity.gazetteer(spark, csv(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias(" ZCTA "), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.col("p_size").cast("string"), F.lit(".25"))).otherwise("bad").alias("LAT"), F.lit(" -7.5 ").alias("LON")), sep="|"), ("ZCTA", "LAT", "LON"))
SQL["file_gazetteer"] = "SELECT CAST(p_partkey AS VARCHAR) AS key, p_size + 0.25::DOUBLE AS lat, -7.5::DOUBLE AS lon FROM part WHERE p_partkey % 5 <> 0"

_RESULT = "CASE c_custkey % 4 WHEN 0 THEN concat('\"', c_custkey, '\",\"1 Main, Town\",\"Match\",\"Exact\",\"1 MAIN\",\"-', c_custkey % 90, '.5,', c_custkey % 80, '.25\"') WHEN 1 THEN concat(c_custkey, ',a,Match,Exact,b,oops') WHEN 2 THEN concat(c_custkey, ',a,Tie') ELSE concat(c_custkey, ',a,No_Match') END"
QUERIES["file_geocoder"] = lambda spark, sf_dir: activity.geocoder_results(spark, lines(table(spark, sf_dir, "customer"), F.expr(_RESULT)))
SQL["file_geocoder"] = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 4 = 0 AS matched, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 80 + 0.25::DOUBLE END AS lat, CASE WHEN c_custkey % 4 = 0 THEN -(c_custkey % 90) - 0.5::DOUBLE END AS lon FROM customer"

_CALL = "concat('k', {k} % 400, 'ab')"


def file_field_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years' sheets, whose cells may name two stations; of each call the last year."""
    orders = table(spark, sf_dir, "orders")
    call = F.expr(_CALL.format(k="o_custkey"))
    sheet = lambda df: csv(df.select(F.when(F.col("o_orderkey") % 5 == 0, F.concat(call, F.lit(" & w?1x"))).otherwise(call).alias("Call Used"), F.lit("W9CLUB").alias("Club Call"), F.lit("n/a").alias("GOTA")))
    both = activity.field_day(spark, sheet(orders.where("o_orderkey % 2 = 0")), 2023).unionByName(activity.field_day(spark, sheet(orders.where("o_orderkey % 2 = 1")), 2024))
    return dumps.max_by_call(both, "call", "value")


QUERIES["file_field_day"] = file_field_day
SQL["file_field_day"] = """WITH c AS (SELECT 'K' || (o_custkey % 400) || 'AB' AS call, 2023 + o_orderkey % 2 AS y FROM orders UNION ALL SELECT 'W01X', 2023 + o_orderkey % 2 FROM orders WHERE o_orderkey % 5 = 0) SELECT call, CAST(max(y) AS INTEGER) AS value FROM c GROUP BY call"""

_JSON_CALL = "concat('{\"callsign\":\"', " + _CALL.format(k="s_suppkey") + ", '\",\"qsos\":', s_suppkey % 77, '}')"
QUERIES["file_winter_field_day"] = lambda spark, sf_dir: activity.winter_field_day(spark, documents(table(spark, sf_dir, "supplier"), F.col("s_nationkey"), F.expr(_JSON_CALL), '{"aaData":[', "]}"), 2024)
SQL["file_winter_field_day"] = "SELECT DISTINCT 'K' || (s_suppkey % 400) || 'AB' AS call, 2024 AS value FROM supplier"
QUERIES["file_park_activity"] = lambda spark, sf_dir: activity.park_activity(spark, documents(table(spark, sf_dir, "supplier"), F.col("s_nationkey"), F.expr(_JSON_CALL), "[", "]"), "callsign", "qsos")
SQL["file_park_activity"] = "SELECT 'K' || (s_suppkey % 400) || 'AB' AS call, max(s_suppkey % 77) AS value FROM supplier GROUP BY 1"
_UPLOAD = "concat(" + _CALL.format(k="o_custkey") + ", ',', CASE WHEN o_orderkey % 6 = 0 THEN 'soon' ELSE {day} END, ',12:00:00')"
QUERIES["file_log_uploads"] = lambda spark, sf_dir: activity.log_uploads(spark, lines(table(spark, sf_dir, "orders"), F.expr(_UPLOAD.format(day="date_format(o_orderdate, 'yyyy-MM-dd')"))))
SQL["file_log_uploads"] = "SELECT 'K' || (o_custkey % 400) || 'AB' AS call, max(strftime(o_orderdate, '%Y-%m-%d')) AS value FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1"
_ENTRY = "concat('\"k', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '_1' ELSE '' END, '\":{{', CASE WHEN c_custkey % 2 = 0 THEN concat('\"lastqso\":\"2024-01-', 10 + c_custkey % 20, '\"') ELSE '' END, '}}')".replace("{{", "{").replace("}}", "}")
QUERIES["file_club_log"] = lambda spark, sf_dir: activity.club_log(spark, documents(table(spark, sf_dir, "customer"), F.col("c_nationkey"), F.expr(_ENTRY), "{", "}"))
SQL["file_club_log"] = "SELECT 'K' || c_custkey AS call, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-' || (10 + c_custkey % 20) END AS value FROM customer WHERE length('K' || c_custkey) >= 3"
QUERIES["file_check_partial"] = lambda spark, sf_dir: activity.check_partial(spark, lines(table(spark, sf_dir, "supplier"), F.lit("# list"), F.lit(" "), F.expr(_CALL.format(k="s_suppkey"))))
SQL["file_check_partial"] = "SELECT DISTINCT 'K' || (s_suppkey % 400) || 'AB' AS call, 1 AS value FROM supplier"
QUERIES["file_manifest"] = lambda spark, sf_dir: activity.manifest_counts(spark, lines(table(spark, sf_dir, "nation"), F.format_string("%d ./dir/T%d.dat", F.col("n_nationkey") * 10, F.col("n_nationkey")), F.lit("total 9")))
SQL["file_manifest"] = "SELECT 'T' || n_nationkey AS tag, CAST(n_nationkey * 10 AS BIGINT) AS lines FROM nation"


def file_prefix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix list with an entry for each nation below one for its region, and lines of other kinds."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rest = "|NA|5|291||||X#|"
    top = region.select((F.col("r_regionkey") * 1000).alias("n"), F.concat(F.lit("0100|180|-360|"), "r_name", F.lit("|R|4|"), F.col("r_regionkey").cast("string"), F.lit(rest)).alias("value"))
    below = nation.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("n"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "L").otherwise(""), F.lit("0201|1|2|"), "n_name", F.lit("|N|"), (F.col("n_nationkey") + 1).cast("string"), F.lit("||OC|6|||||M@|")).alias("value"))
    skipped = region.select((F.col("r_regionkey") * 1000 + 900).alias("n"), F.lit("0402|1|2|skip|X|1|2|||||||Z|").alias("value"))
    ordered = top.unionByName(below).unionByName(skipped).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda r: r["value"]), "\n").alias("t"))
    path = shared_dir(spark)
    ordered.select(F.concat(F.lit("a\nb\nc\n"), "t").alias("value")).coalesce(1).write.text(path)
    entries = dumps.prefix_list(spark, path)
    parents = entries.select(F.col("id").alias("parent"), F.col("territory").alias("below"))
    return entries.join(parents, "parent", "left").select("territory", "below", "kind", "level", "cq", "itu", "mask", F.col("lat").cast("int").alias("lat"))


QUERIES["file_prefix_list"] = file_prefix_list
SQL["file_prefix_list"] = """SELECT r_name AS territory, CAST(NULL AS VARCHAR) AS below, 1 AS kind, 0 AS level, '4' AS cq, CAST(r_regionkey AS VARCHAR) AS itu, 'X#' AS mask, -360 AS lat FROM region
UNION ALL SELECT n_name, r_name, 2, 1, CAST(n_nationkey + 1 AS VARCHAR), NULL, 'M@', 2 FROM nation JOIN region ON r_regionkey = n_regionkey"""

# --- sinks ----------------------------------------------------------------------------------------------------------


def file_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts written as a snapshot's JSON lines and read back."""
    path = shared_dir(spark)
    exports.snapshot({"contacts": contacts(spark, sf_dir).select("uuid", "band", F.when(F.col("uuid") % 3 != 0, F.col("mode")).alias("mode"))}, path)
    return spark.read.schema("uuid long, band string, mode string").json(f"{path}/contacts")


QUERIES["file_snapshot"] = file_snapshot
SQL["file_snapshot"] = f"WITH {CONTACTS} SELECT uuid, band, CASE WHEN uuid % 3 <> 0 THEN mode END AS mode FROM contacts"


def file_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    activity.unmatched(table(spark, sf_dir, "customer").select("c_name", F.when(F.col("c_custkey") % 3 != 0, F.lit("1,2")).alias("coordinates")), path, "coordinates", "c_name")
    return spark.read.option("header", True).csv(path).select("c_name")


QUERIES["file_unmatched"] = file_unmatched
SQL["file_unmatched"] = "SELECT c_name FROM customer WHERE c_custkey % 3 = 0"


def file_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that counts after a first version, one that fails its check, and a second one; and a dated copy of it."""
    path, customers = shared_dir(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")

    def check(version: DataFrame) -> None:
        if version.where("c_nationkey < 0").count():
            raise ValueError("impossible nation")

    etl.publish(customers.where("c_nationkey < 5"), path, check)
    try:
        etl.publish(customers.withColumn("c_nationkey", -F.col("c_nationkey")), path, check)
    except ValueError:
        etl.publish(customers.where("c_nationkey > 3"), path, check)
    return spark.read.parquet(exports.backup(etl.current(spark, path), shared_dir(spark), "customers", "20240601"))


QUERIES["file_published"] = file_published
SQL["file_published"] = "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey > 3"
