"""The contact log: last-write-wins folding, incremental reads, duplicates, validation, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from radiolake.functions import scalars
from radiolake.shared import ranked


def fold(changes: DataFrame, key: str = "uuid") -> DataFrame:
    """The current state of a change log: the change with the latest ``last_edited``, on a tie the later arrival.

    ``created_at`` is that of the first arrival. Tombstones are ordinary changes and stay; see :func:`active`. One
    aggregation with a partial step, so the order and the partitioning of the input don't matter.
    """
    others = [c for c in changes.columns if c not in (key, "created_at")]
    return (
        changes.groupBy(key)
        .agg(
            F.max_by(F.struct(*others), F.struct("last_edited", "arrival_seq")).alias("s"),
            F.min_by("created_at", "arrival_seq").alias("created_at"),
        )
        .select(key, "created_at", "s.*")
    )


def active(current: DataFrame) -> DataFrame:
    """Rows that aren't tombstones."""
    return current.where(~F.col("deleted"))


#: Arrivals that are looked at together by :func:`stored`.
ARRIVALS = 65_536


def stored(changes: DataFrame, key: str = "uuid") -> DataFrame:
    """Adds ``stored``: did the change win when it arrived, ties included.

    The latest edit so far is carried along lots of arrivals: within a lot by a window, from lot to lot by a table with
    one row for each key and lot. So a key with most of the changes is as many tasks' work as it has lots.
    """
    lot = F.floor(F.col("arrival_seq") / ARRIVALS).alias("__lot")
    lots = changes.groupBy(key, lot).agg(F.max("last_edited").alias("__latest"))
    upto = Window.partitionBy(key).orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
    before = lots.select(key, "__lot", F.max("__latest").over(upto).alias("__before"))
    inside = Window.partitionBy(key, "__lot").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    dated = changes.withColumn("__lot", lot).withColumn("__inside", F.max("last_edited").over(inside))
    joined = matched(dated, before, [key, "__lot"], "left")
    latest = F.greatest("__inside", "__before")
    return joined.select(*changes.columns, (latest.isNull() | (F.col("last_edited") >= latest)).alias("stored"))


def since(rows: DataFrame, cursor, at: str = "synced_at") -> DataFrame:
    """Rows from the cursor on, itself included; no cursor: all."""
    return rows if cursor is None else rows.where(F.col(at) >= F.lit(cursor))


def first_arrivals(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The first row of each key; an insert that is repeated changes nothing."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), arrival).alias("s")).select(*key, "s.*")


def accumulate(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merges two tables by key: the larger of each value (null counts least), earliest ``first_seen``, latest ``last_seen``."""
    both = old.unionByName(new)
    values = [c for c in both.columns if c not in (key, "first_seen", "last_seen")]
    return both.groupBy(key).agg(*[F.max(c).alias(c) for c in values], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def source_count(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Adds ``source_count``, the number of sources that have a value."""
    return rows.withColumn("source_count", sum((F.col(c).isNotNull().cast("int") for c in sources[1:]), F.col(sources[0]).isNotNull().cast("int")))


def matched(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """``left`` joined with ``right`` by equal names, null being equal to null; Spark joins it as an equality of keys."""
    renamed = right.withColumnsRenamed({n: f"__right_{n}" for n in names})
    condition = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__right_{n}")) for n in names])
    return left.join(renamed, condition, how).drop(*[f"__right_{n}" for n in names])


def previous(rows: DataFrame, keys: list[str], at: str, ident: str) -> DataFrame:
    """Adds ``previous``, the id of the latest earlier row with equal keys (by time, then id); null for the first.

    A null key is a key like any other, and rows without a time come after those with one. Rows are ranked within a day
    of a key; the first of a day takes the last of the key's previous day, from a table with one row for each key and
    day. So a key with many rows isn't sorted in one task, but each of its days.
    """
    dated = rows.withColumn("__day", F.to_date(at))
    order = [F.col(at).asc_nulls_last(), F.col(ident)]
    inside = dated.withColumn("__inside", F.lag(ident).over(Window.partitionBy(*keys, "__day").orderBy(*order)))
    days = dated.groupBy(*keys, "__day").agg(F.max(F.struct(at, ident))[ident].alias("__last"))
    by_day = Window.partitionBy(*keys).orderBy(F.col("__day").asc_nulls_last())
    before = days.select(*keys, "__day", F.lag("__last").over(by_day).alias("__before"))
    joined = matched(inside, before, [*keys, "__day"], "left")
    return joined.select(*rows.columns, F.coalesce("__inside", "__before").alias("previous"))


#: How contacts with one callsign are told apart, by the event's kind of duplicate.
DUPLICATE_KEYS = {"any": [], "band-mode": ["band", "mode"], "band-mode-day": ["band", "mode", "day"]}


def duplicates(contacts: DataFrame, kind: str) -> DataFrame:
    """Adds ``previous``: the contact that each one duplicates, under the event's rule; ``none`` finds nothing."""
    if kind == "none":
        return contacts.withColumn("previous", F.lit(None).cast(contacts.schema["uuid"].dataType))
    dated = contacts.withColumn("day", F.to_date("qso_at")) if kind == "band-mode-day" else contacts
    return previous(dated, ["remote_callsign", *DUPLICATE_KEYS[kind]], "qso_at", "uuid").drop("day")


def import_new(incoming: DataFrame, existing: DataFrame, position: str) -> DataFrame:
    """Incoming contacts whose call, band, mode and minute are neither in the log nor earlier in the same file.

    A blank or null band is a band like any other, and so is a null mode or time.
    """
    key = lambda df: df.withColumns({"__call": F.upper("remote_callsign"), "__minute": F.date_trunc("minute", "qso_at")})
    on = ["__call", "band", "mode", "__minute"]
    others = [c for c in incoming.columns if c not in on]
    first = key(incoming).groupBy(*on).agg(F.min_by(F.struct(*others), position).alias("s")).select(*on, "s.*")
    known = key(existing).select(*on).distinct()
    return matched(first, known, on, "left_anti").select(*incoming.columns)


#: White space in the log's sense: ASCII's, the no-break spaces, Unicode's separators and the byte-order mark.
WHITE = "[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def trimmed(c: Column) -> Column:
    """The value without white space of any kind at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^{WHITE}+|{WHITE}+\\z", "")


def blank(c: Column) -> Column:
    return trimmed(c) == ""


def validate(contacts: DataFrame, required: list[str], patterns: dict[str, str]) -> DataFrame:
    """Adds ``errors``: the required columns that are blank and the others that don't match their pattern as a whole.

    Values are trimmed before both tests, and a blank one isn't held against its pattern. Messages are joined by
    semicolons; an empty string is no error.
    """
    missing = [F.when(blank(F.col(c)), F.lit(f"{c} is required")) for c in required]
    wrong = [F.when(~blank(F.col(c)) & ~trimmed(F.col(c)).rlike(f"^(?:{p})\\z"), F.lit(f"{c} is not valid")) for c, p in patterns.items()]
    return contacts.withColumn("errors", F.concat_ws("; ", *missing, *wrong))


def missing_required(contacts: DataFrame, template: list[dict], fields: str = "fields") -> DataFrame:
    """Adds ``missing``: required fields of the entry form that a contact leaves blank, comma-joined; none for tombstones.

    A built-in field is a column of its own, any other is in the map.
    """
    names = [f["name"] for f in template if f.get("entry") and f.get("required")]
    value = lambda n: F.col(n) if n in BUILTINS else F.try_element_at(fields, F.lit(n))
    missing = F.concat_ws(",", *[F.when(blank(value(n)), F.lit(n)) for n in names])
    return contacts.withColumn("missing", F.when(F.col("deleted"), F.lit("")).otherwise(missing))


def latest_of(contacts: DataFrame, key: str, columns: list[str], at: str = "qso_at", ident: str = "uuid") -> DataFrame:
    """The named columns of each key's latest contact, which fill what a form remembers."""
    return contacts.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, ident)).alias("c")).select(key, "c.*")


def per_park(contacts: DataFrame, parks: str) -> DataFrame:
    """One contact for each park of a comma-separated list; a contact without parks stays as it is."""
    each = F.filter(F.transform(F.split(F.coalesce(F.col(parks), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    exploded = F.explode(F.when(F.size(each) > 0, each).otherwise(F.array(F.lit("")))).alias(parks)
    return contacts.select(*[c for c in contacts.columns if c != parks], exploded)


def has_member(column: Column, member: str) -> Column:
    """Is ``member`` one of a comma-separated list."""
    return F.array_contains(F.split(column, ","), member)


def reconcile(local: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """A local history after the server's arrives: the server's rows, and local ones that it doesn't have as failed."""
    lost = local.join(server.select(key), key, "left_anti").withColumn("state", F.lit("failed"))
    return server.withColumn("state", F.lit("confirmed")).unionByName(lost)


#: Built-in columns of a contact, blank where an older log hasn't them.
BUILTINS = ["country", "itu_zone", "cq_zone", "continent", "gridsquare", "distance", "state", "section", "county", "rst_sent", "rst_received", "name", "frequency", "comment"]
# Patterns of the built-in fields that have one.
_RST = "[1-5][1-9]\\d|[+-]?\\d{1,2}"
BUILTIN_PATTERNS = {
    "itu_zone": "[1-9]|[1-8]\\d|90",
    "cq_zone": "[1-9]|[1-3]\\d|40",
    "continent": "AF|AN|AS|EU|NA|OC|SA",
    "gridsquare": "[A-R]{2}\\d{2}",
    "distance": "\\d{1,5}",
    "state": "AB|AK|AL|AR|AZ|BC|CA|CO|CT|DC|DE|DX|FL|GA|HI|IA|ID|IL|IN|KS|KY|LA|MA|MB|MD|ME|MI|MN|MO|MS|MT|NB|NC|ND|NE|NH|NJ|NL|NM|NS|NT|NU|NV|NY|OH|OK|ON|OR|PA|PE|QC|RI|SC|SD|SK|TN|TX|UT|VA|VT|WA|WI|WV|WY|YT",
    "section": "AB|AK|AL|AR|AZ|BC|CO|CT|DE|DX|EB|EMA|ENY|EPA|EWA|GA|GH|IA|ID|IL|IN|KS|KY|LA|LAX|MB|MDC|ME|MI|MN|MO|MS|MT|MX|NB|NC|ND|NE|NFL|NH|NL|NLI|NM|NNJ|NNY|NS|NTX|NV|OH|OK|ONE|ONN|ONS|OR|ORG|PAC|PE|PR|QC|RI|SB|SC|SCV|SD|SDG|SF|SFL|SJV|SK|SNJ|STX|SV|TER|TN|UT|VA|VI|VT|WCF|WI|WMA|WNY|WPA|WTX|WV|WWA|WY",
    "rst_sent": _RST,
    "rst_received": _RST,
    "frequency": "(?:[1-9]\\d{0,3}|0)\\.\\d{3}",
}


def migrated(contacts: DataFrame) -> DataFrame:
    """An older log with all built-in columns: those that it hasn't, and nulls, are blank."""
    return contacts.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in contacts.columns else F.lit("") for c in BUILTINS})


def with_fields(contacts: DataFrame, column: str = "fields") -> DataFrame:
    """Custom fields as a map, from their JSON text; a text that isn't an object gives none."""
    return contacts.withColumn(column, F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>")))


def responses(rows: DataFrame, fields: str = "fields") -> DataFrame:
    """``record``: each row as JSON text, its map of custom fields as an object, nulls as null."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("record"))


def checked(bodies: DataFrame) -> DataFrame:
    """Contacts from JSON text (``body``): typed columns, and ``error``, the first thing that is wrong with each.

    All of the keys REQUIRED must be there, TEXTS must be text that isn't blank, times must be readable (without a zone they
    are UTC), and fields must be an object. Built-in fields may be missing. Text is trimmed; any value that isn't false,
    null, zero or blank marks a contact as deleted.
    """
    body = F.try_parse_json("body")
    part = lambda name, kind: F.try_variant_get(body, f"$.{name}", kind)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(body, f"$.{name}", "variant"))
    texts = {n: F.trim(part(n, "string")) for n in TEXTS}
    times = {n: F.unix_millis(F.try_to_timestamp(scalars.iso_ms(part(n, "string")))) for n in TIMES}
    absent = F.concat_ws(", ", *[F.when(part(n, "variant").isNull(), F.lit(n)) for n in REQUIRED])
    blanks = [F.when((kind(n) != "STRING") | blank(texts[n]), F.lit(f"{n} must be a non-empty string")) for n in TEXTS]
    unread = [F.when(times[n].isNull(), F.lit(f"bad timestamp: {n}")) for n in TIMES]
    objects = F.when(~F.startswith(kind("fields"), F.lit("OBJECT")), F.lit("fields must be a JSON object"))
    wrong = [F.when(part(n, "variant").isNotNull() & (kind(n) != "STRING"), F.lit(f"{n} must be a string")) for n in BUILTINS]
    is_object = F.coalesce(F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), F.lit(False))
    error = F.coalesce(F.when(~is_object, F.lit("contact must be a JSON object")), F.when(absent != "", F.concat(F.lit("missing fields: "), absent)), *blanks, *unread, objects, *wrong)
    deleted = F.coalesce(~F.lower(part("deleted", "string")).isin("false", "0", "", "null"), F.lit(False))
    columns = {**texts, **times, "deleted": deleted, **{n: F.coalesce(F.trim(part(n, "string")), F.lit("")) for n in BUILTINS}}
    return bodies.select(*bodies.columns, *[c.alias(n) for n, c in columns.items()], F.to_json(part("fields", "variant")).alias("fields"), error.alias("error"))


#: What a contact's document must have: texts, times, and the rest.
TEXTS, TIMES = ["uuid", "remote_callsign", "operator_callsign", "operator_initials", "client_uuid", "band", "mode"], ["qso_at", "last_edited"]
REQUIRED = [*TEXTS, *TIMES, "deleted", "fields"]


def apply_pull(local: DataFrame, pulled: DataFrame, key: str = "uuid") -> DataFrame:
    """A replica after a pull: pulled rows replace local ones whatever their edit times and are marked as synced."""
    kept = local.join(pulled.select(key).distinct(), key, "left_anti")
    last = pulled.groupBy(key).agg(F.max_by(F.struct(*[c for c in pulled.columns if c != key]), "synced_at").alias("s")).select(key, "s.*")
    return kept.unionByName(last.withColumn("sync_state", F.lit("synced")), allowMissingColumns=True)


def export_order(contacts: DataFrame, at: str = "qso_at", ident: str = "uuid") -> DataFrame:
    """Contacts with their ``place`` in an export: by time, however it is written; unreadable times come last."""
    parsed = F.unix_millis(F.try_to_timestamp(scalars.iso_ms(F.col(at).cast("string"))))
    return ranked(contacts.withColumn("__at", parsed), F.col("__at").asc_nulls_last(), F.col(ident), name="place").drop("__at")
