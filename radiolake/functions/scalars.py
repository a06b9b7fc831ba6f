"""Column functions that clean and coerce text: callsigns, grids, states, zones, dates, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How typed logs write a digit and a slashed zero, what they have instead of a callsign, what one looks
# like, and the portable endings in the order in which they are tried.
SHIFTED, UNSHIFTED = ")!@#$%^&*(", "0123456789"
ZEROS = ("Ã\u02dc", "Ø", "∅")
PLACEHOLDERS = ("(NONE)", "NONE", "N/A", "CALL")
CALL_FORM = "^[A-Z0-9]+(?:[/-][A-Z0-9]+)*$"
PORTABLE = ("/P", "/M", "/MM", "/QRP", "/ANT")

# States by name, provinces, classes and kinds of licensees.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT",
    "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL",
    "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE",
    "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC",
    "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA",
    "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
PROVINCES = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT")
CONTINENTS = ("AF", "AN", "AS", "EU", "NA", "OC", "SA")
CLASSES = {"A": "advanced", "E": "extra", "G": "general", "N": "novice", "P": "technician plus", "T": "technician"}
KINDS = {"Individual": "person", "Amateur Club": "club", "Military Recreation": "military", "Government Entity": "races"}
QUALIFICATIONS = {"A": "Basic", "B": "5 WPM", "C": "12 WPM", "D": "Advanced", "E": "Basic with Honours"}
SERVICES = {"HA": "Amateur", "HV": "Amateur Vanity"}
# Entities of the states that aren't in the main one, with their continents; provinces by postal letter.
ENTITIES = {
    "AK": ("Alaska", 6, "NA"), "HI": ("Hawaii", 110, "OC"), "PR": ("Puerto Rico", 202, "NA"), "VI": ("US Virgin Islands", 285, "NA"), "GU": ("Guam", 103, "OC"),
    "MP": ("Northern Mariana Islands", 166, "OC"), "AS": ("American Samoa", 9, "OC"),
}
MAINLAND, MILITARY, MILITARY_NAME = ("United States of America", 291, "NA"), ("AA", "AE", "AP"), "Military (APO/FPO)"
POSTAL_PROVINCES = {
    "A": ["NL"], "B": ["NS"], "C": ["PE"], "E": ["NB"], "G": ["QC"], "H": ["QC"], "J": ["QC"], "K": ["ON"], "L": ["ON"], "M": ["ON"], "N": ["ON"], "P": ["ON"],
    "R": ["MB"], "S": ["SK"], "T": ["AB"], "V": ["BC"], "X": ["NT", "NU"], "Y": ["YT"],
}
# Words at the start of an address without a street, and the form of a postal code.
NO_STREET = (
    "(?i)^\\s*(P\\.?\\s?O\\.?\\s*BOX|BOX|C\\.?P\\.?|CASE POSTALE|R\\.?\\s?R\\.?\\s*#?\\s*\\d|RURAL ROUTE|ROUTE RURALE|"
    "GENERAL DELIVERY|POSTE RESTANTE|GD|SITE|COMP)\\b"
)
POSTAL_FORM, POSTAL_START = "^[A-Z]\\d[A-Z]\\d[A-Z]\\d$", "^[A-Za-z][0-9][A-Za-z]"


def text(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def iso_ms(c: Column) -> Column:
    """A time as ISO text in UTC, cut to milliseconds, in whatever zone the session is; null if it can't be read.

    A time without a zone is taken as UTC.
    """
    zoned = F.when(F.trim(c).rlike("(Z|[+-][0-9]{2}(:?[0-9]{2})?)$") & F.contains(c, F.lit(":")), F.trim(c)).otherwise(F.concat(F.trim(c), F.lit("Z")))
    micros = F.unix_micros(F.try_to_timestamp(zoned))
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.floor(micros / 1000) / 1000).cast("decimal(18,6)"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def normalize_call(c: Column) -> Column:
    """Upper-cased callsign without trailing slashes and without each portable suffix, tried once in a fixed order."""
    out = F.rtrim(F.upper(F.trim(c)), F.lit("/"))
    for suffix in PORTABLE:
        out = F.regexp_replace(out, f"{suffix}$", "")
    return F.rtrim(F.trim(out), F.lit("/"))


def clean_call(c: Column) -> Column:
    """A callsign as typed, made plain (quotes, slashed zeros, shifted digits), or null if it can't be one."""
    plain = F.btrim(F.upper(F.trim(c)), F.lit("\"'` \t"))
    for zero in ZEROS:
        plain = F.replace(plain, F.lit(zero), F.lit("0"))
    plain = F.translate(plain, SHIFTED, UNSHIFTED)
    return F.when((F.length(plain) >= 3) & ~plain.isin(*PLACEHOLDERS) & plain.rlike(CALL_FORM), plain)


def suffixes(c: Column) -> Column:
    """All suffixes of a text, longest first; none of an empty one."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.length(c)))).otherwise(F.array().cast("array<string>"))


def gridsquare(c: Column) -> Column:
    """First four characters in upper case if they are a grid square."""
    cut = F.upper(F.substring(F.trim(c), 1, 4))
    return F.when(cut.rlike("^[A-R]{2}[0-9]{2}$"), cut)


def zone(c: Column, most: int) -> Column:
    """A whole number from 1 to ``most``, however it is written (``06``, ``6.0``)."""
    number = F.trim(c).try_cast("double")
    return F.when((number == F.floor(number)) & number.between(1, most), number.cast("int"))


def iso_date(c: Column) -> Column:
    """A date from ``YYYY-MM-DD`` or ``M/D/YYYY``; anything else, impossible days included, is null."""
    trimmed = F.trim(c)
    us = F.when(trimmed.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_timestamp(trimmed, F.lit("M/d/yyyy")))
    iso = F.when(trimmed.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd")))
    return F.date_format(F.coalesce(iso, us), "yyyy-MM-dd")


def us_date(c: Column) -> Column:
    """``MM/DD/YYYY`` as ``YYYY-MM-DD``; any other text stays as it is, a blank one is null."""
    return F.regexp_replace(F.nullif(c, F.lit("")), "^(\\d{2})/(\\d{2})/(\\d{4})$", "$3-$1-$2")


def number(c: Column) -> Column:
    """A number however it is written; null if it can't be read."""
    return F.trim(c.cast("string")).try_cast("double")


def lookup(known: dict[str, str], key: Column) -> Column:
    """The value of a small fixed map; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), key)


def state(c: Column) -> Column:
    """The code of a state or province, from its code in any case or a state's name; null for anything else."""
    plain = F.upper(F.trim(c))
    named = lookup(STATES, F.regexp_replace(plain, "\\s+", " "))
    return F.when(F.length(plain) == 2, F.when(plain.isin(*STATES.values(), *PROVINCES), plain)).otherwise(named)


def upper(c: Column) -> Column:
    """Trimmed text in upper case, null if nothing is left."""
    return F.upper(text(c))


def lower(c: Column) -> Column:
    """Trimmed text in lower case, null if nothing is left."""
    return F.lower(text(c))


#: How each field of a licensee's record is read from raw text.
RECORD = {
    **{f: text for f in ("callsign", "source", "fetched_at", "name", "previous_callsign", "trustee_callsign", "trustee_name", "address_line1", "address_line2", "address_attn", "county", "country", "continent", "frn")},
    **{f: lower for f in ("license_type", "license_class", "previous_license_class")},
    "state": state, "section": upper, "latitude": number, "longitude": number, "gridsquare": gridsquare,
    "itu_zone": lambda c: zone(c, 90), "cq_zone": lambda c: zone(c, 40), "dxcc": lambda c: zone(c, 999), "grant_date": iso_date, "expiry_date": iso_date,
}


def record(raw: dict[str, Column]) -> tuple[list[Column], Column]:
    """All 27 fields of a record from those that a source has, and the names of those that can't be read.

    A field that the source hasn't, and a blank one, is null without being an error.
    """
    kinds = {"latitude": "double", "longitude": "double", "itu_zone": "int", "cq_zone": "int", "dxcc": "int"}
    missing = [f for f in RECORD if f not in raw]
    columns, bad = coerced(**{f: (c, RECORD[f](c)) for f, c in raw.items() if f in RECORD})
    return [*columns, *[F.lit(None).cast(kinds.get(f, "string")).alias(f) for f in missing]], bad


def blanked(df: DataFrame, fields: list[str]) -> DataFrame:
    """The rows with the named fields set to null."""
    return df.withColumns({f: F.lit(None).cast(df.schema[f].dataType) for f in fields})


def coerced(**pairs: tuple[Column, Column]) -> tuple[list[Column], Column]:
    """Named columns of (raw, coerced) pairs, and the names whose raw value is there but can't be coerced."""
    columns = [value.alias(name) for name, (_, value) in pairs.items()]
    bad = [F.when(text(raw.cast("string")).isNotNull() & value.isNull(), F.lit(name)) for name, (raw, value) in pairs.items()]
    return columns, F.concat_ws(",", *bad)


def license_class(letters: Column) -> Column:
    """The highest privilege that qualification letters stand for; blank if they only stand for code speeds."""
    held = F.upper(F.trim(F.coalesce(letters, F.lit(""))))
    return F.when(F.contains(held, F.lit("D")), "advanced").when(F.contains(held, F.lit("E")), "basic with honours").when(F.contains(held, F.lit("A")), "basic").otherwise("")


def qualifications(flags: list[Column]) -> tuple[Column, Column]:
    """Letters and descriptions of the qualifications A to E whose flags aren't blank; null if there are none."""
    held = [(letter, F.coalesce(F.trim(flag), F.lit("")) != "") for letter, flag in zip(QUALIFICATIONS, flags, strict=True)]
    letters = F.concat_ws("", *[F.when(has, F.lit(letter)) for letter, has in held])
    words = F.concat_ws("; ", *[F.when(has, F.lit(QUALIFICATIONS[letter])) for letter, has in held])
    return F.nullif(letters, F.lit("")), F.nullif(words, F.lit(""))


def entity(code: Column) -> tuple[Column, Column, Column]:
    """Name, number and continent of a state's entity; a military state has the name alone, an unknown one nothing."""
    plain = F.upper(F.trim(code))
    own = plain.isin(*[s for s in STATES.values() if s not in ENTITIES])
    known = lambda i: lookup({k: str(v[i]) for k, v in ENTITIES.items()}, plain)
    name = F.when(own, MAINLAND[0]).when(plain.isin(*MILITARY), MILITARY_NAME).otherwise(known(0))
    return name, F.when(own, F.lit(MAINLAND[1])).otherwise(known(1).cast("int")), F.when(own, MAINLAND[2]).otherwise(known(2))


def postal_agrees(code: Column, province: Column) -> Column:
    """Whether a postal code's letter allows the province; a missing province is allowed everywhere."""
    pairs = [F.lit(f"{letter}{p}") for letter, ps in POSTAL_PROVINCES.items() for p in ps]
    return text(province).isNull() | F.array_contains(F.array(*pairs), F.concat(F.upper(F.substring(code, 1, 1)), F.trim(province)))


def address_parts(street: Column, city: Column, region: Column, code: Column) -> list[Column]:
    """The four parts by which addresses meet: trimmed, in upper case, blank if missing; five characters of the code."""
    plain = [F.coalesce(F.upper(F.trim(c)), F.lit("")) for c in (street, city, region)]
    return [*plain, F.substring(F.coalesce(F.upper(F.trim(code)), F.lit("")), 1, 5)]


def postal(c: Column) -> Column:
    """A postal code in upper case, with its space if it has the usual form; null if it is blank."""
    plain = F.upper(text(c))
    compact = F.replace(plain, F.lit(" "), F.lit(""))
    return F.when(compact.rlike(POSTAL_FORM), F.concat(F.substring(compact, 1, 3), F.lit(" "), F.substring(compact, 4, 3))).otherwise(plain)


def has_street(address: Column) -> Column:
    """Whether an address names a street, and not a post-office box or a rural route."""
    return F.coalesce(text(address).isNotNull() & ~address.rlike(NO_STREET), F.lit(False))


def postal_area(c: Column) -> Column:
    """The first three characters, in upper case, of what begins like a postal code; else null."""
    return F.when(c.rlike(POSTAL_START), F.upper(F.substring(c, 1, 3)))


def plausible_call(c: Column) -> Column:
    """Whether a text is long enough to be looked up as a callsign."""
    return F.coalesce(F.length(F.trim(c)) >= 2, F.lit(False))


def short_name(c: Column) -> Column:
    """The part of a bilingual name before its slash, with single spaces."""
    return F.trim(F.regexp_replace(F.split_part(c, F.lit(" / "), F.lit(1)), "\\s+", " "))


def address_lines(street: Column, box: Column, city: Column, region: Column, code: Column) -> tuple[Column, Column]:
    """The street or else the box, and ``CITY, ST ZIP`` as far as it is known from the city and state on."""
    first = F.coalesce(text(street), F.concat(F.lit("PO BOX "), text(box)), F.lit(""))
    town = F.concat(text(city), F.lit(", "), text(region))
    return first, F.coalesce(F.concat(town, F.lit(" "), text(code)), town, F.lit(""))


def full_name(first: Column, middle: Column, last: Column, suffix: Column) -> Column:
    """The parts that aren't blank, upper-cased, with single spaces."""
    return F.concat_ws(" ", *[F.upper(text(c)) for c in (first, middle, last, suffix)])


def licensee_name(kind: Column, first: Column, middle: Column, last: Column, suffix: Column, entity: Column) -> Column:
    """An individual's names that aren't blank, with single spaces; the entity's name for anyone else."""
    return F.when(F.trim(F.coalesce(kind, F.lit(""))) == "Individual", F.concat_ws(" ", *[text(c) for c in (first, middle, last, suffix)])).otherwise(F.coalesce(entity, F.lit("")))


def slug(c: Column) -> Column:
    """Lower-case letters and digits with single dashes between them."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def template_id(c: Column) -> Column:
    """Like :func:`slug`, but underscores and dashes of the name stay."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9_-]+", "-"), F.lit("-"))


def plain_text(c: Column) -> Column:
    """Only letters, digits and ``,_./-``."""
    return F.regexp_replace(c, "[^a-zA-Z0-9,_./-]", "")


def without_controls(c: Column) -> Column:
    """Runs of control and format characters as one space."""
    return F.regexp_replace(c, "[\\p{Cc}\\p{Cf}]+", " ")


def without_prefix(c: Column, prefix: str) -> Column:
    """A value that is only the prefix which the form writes by itself is blank; others stay as they are."""
    return F.when(F.trim(c) == prefix, F.lit("")).otherwise(c)


def shifted(t: Column, days: int, hours: int, minutes: int) -> Column:
    """A time moved by signed days, hours and minutes."""
    return F.timestamp_micros(F.unix_micros(t.cast("timestamp")) + ((days * 24 + hours) * 60 + minutes) * 60_000_000)


def expires(fetched_ms: Column, status: Column) -> Column:
    """When a cached answer ends: a year, thirty days, or a quarter of an hour after it was fetched."""
    return fetched_ms + F.when(status == "ok", F.lit(365 * 86_400_000)).when(status == "not_found", F.lit(30 * 86_400_000)).otherwise(F.lit(15 * 60_000))


def initial_mapping(value: Column, options: list[str]) -> Column:
    """The option that a file's value names in any case, else ``Other`` if that is an option, else blank."""
    return F.coalesce(lookup({o.lower(): o for o in options}, F.lower(value)), F.lit("Other" if "Other" in options else ""))


def mapped(value: Column, mapping: dict[str, str], fallback: str) -> Column:
    """The mapping's value for a key in any case, else the fallback."""
    return F.coalesce(lookup({k.lower(): v for k, v in mapping.items()}, F.lower(F.trim(value))), F.lit(fallback))
