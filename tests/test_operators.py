"""Operators on small hand-made rows."""

import struct
from datetime import datetime
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from radiolake.functions import geo, places, scalars
from radiolake.operators import etl, forms, location, log, lookup, prefixes, search, spatial, stats
from radiolake.sources import activity, adif, dumps, exports
from radiolake.streaming import jobs

T = [datetime(2024, 6, 1, 12), datetime(2024, 6, 1, 12, 30), datetime(2024, 6, 1, 13), datetime(2024, 6, 1, 13, 0, 1)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fold_ignores_order_and_replays(spark):
    changes = [("a", T[0], T[1], 1, "x", False), ("a", T[0], T[1], 2, "y", False), ("a", T[0], T[0], 3, "late", False), ("b", T[0], T[0], 4, "z", False), ("b", T[1], T[2], 5, "z", True)]
    schema = "uuid string, created_at timestamp, last_edited timestamp, arrival_seq long, mode string, deleted boolean"
    for order in list(permutations(changes))[::40]:
        out = log.fold(spark.createDataFrame([*order, *order], schema))
        assert rows(out.select("uuid", "mode", "created_at")) == [("a", "y", T[0]), ("b", "z", T[0])]
        assert rows(log.active(out).select("uuid")) == [("a",)]


def test_stored_flag_and_cursor(spark):
    df = spark.createDataFrame([("a", T[1], 1), ("a", T[0], 2), ("a", T[1], 3)], "uuid string, last_edited timestamp, arrival_seq long")
    assert [r["stored"] for r in log.stored(df).orderBy("arrival_seq").collect()] == [True, False, True]
    assert log.since(df, T[1], "last_edited").count() == 2 and log.since(df, None).count() == 3


def test_sliding_hour_counts_both_ends(spark):
    df = spark.createDataFrame([("o", t, i) for i, t in enumerate(T)], "operator string, qso_at timestamp, uuid int")
    assert rows(stats.sliding_hour(df)) == [("o", 3)]
    assert rows(stats.longest_gap(df)) == [(1_800_000, "0h 30m")]
    assert rows(stats.longest_gap(df.limit(0))) == [(None, "-")]


def test_previous_crosses_days_and_is_null_first(spark):
    df = spark.createDataFrame([(1, "K1", datetime(2024, 1, 1)), (2, "K1", datetime(2024, 1, 3)), (3, "K2", datetime(2024, 1, 3)), (4, "K1", datetime(2024, 1, 3))], "uuid int, remote_callsign string, qso_at timestamp")
    assert rows(log.duplicates(df, "any").select("uuid", "previous")) == [(1, None), (2, 1), (3, None), (4, 2)]
    assert log.duplicates(df, "none").where("previous IS NOT NULL").count() == 0


def test_accumulate_is_idempotent(spark):
    a = spark.createDataFrame([("K1", 2019, None, "2020", "2021")], "call string, year int, flag int, first_seen string, last_seen string")
    b = spark.createDataFrame([("K1", None, 1, "2019", "2022"), ("K2", 1, None, "2022", "2022")], a.schema)
    once = log.accumulate(a, b, "call")
    assert rows(once) == rows(log.accumulate(once, b, "call")) == [("K1", 2019, 1, "2019", "2022"), ("K2", 1, None, "2022", "2022")]


def test_callsigns(spark):
    df = spark.createDataFrame([(" k1aw/p/ ",), ("X/M/P",), ("X/P/M",), ("k2x/qrp",)], "c string")
    assert [r[0] for r in df.select(scalars.normalize_call(F.col("c"))).collect()] == ["K1AW", "X", "X/P", "K2X"]
    df = spark.createDataFrame([('"w1aw"',), ("kØab",), ("n!ab",), ("ab",), ("test",), ("a b c",), (None,)], "c string")
    assert [r[0] for r in df.select(scalars.clean_call(F.col("c"))).collect()] == ["W1AW", "K0AB", "N1AB", None, "TEST", None, None]


def test_coercers(spark):
    df = spark.createDataFrame([("06",), ("6.0",), ("6.5",), ("nan",), ("",), ("91",)], "z string")
    assert [r[0] for r in df.select(scalars.zone(F.col("z"), 90)).collect()] == [6, 6, None, None, None, None]
    df = spark.createDataFrame([("2/3/2024",), ("2024-02-30",), ("2024-02-29",), ("13/1/2024",), ("x",)], "d string")
    assert [r[0] for r in df.select(scalars.iso_date(F.col("d"))).collect()] == ["2024-02-03", None, "2024-02-29", None, None]


def test_geo(spark):
    df = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (45.5, -122.7)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.maidenhead(F.col("lat"), F.col("lon"))).collect()] == ["RR99", "AA00", "CN85"]
    gate = spark.createDataFrame([(float("nan"), 0.0), (91.0, 0.0), (None, 0.0), (0.0, 180.0)], "lat double, lon double")
    assert [r[0] for r in gate.select(geo.valid(F.col("lat"), F.col("lon"))).collect()] == [False, False, False, True]


def test_region_with_hole_and_enclave(spark):
    square = lambda a, b: [(a, a), (a, b), (b, b), (b, a), (a, a)]
    parts = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0, [square(0.0, 10.0), square(4.0, 6.0)]), (2, 1.0, 3.0, 1.0, 3.0, [square(1.0, 3.0)])], "feature int, minx double, maxx double, miny double, maxy double, rings array<array<struct<lat:double,lon:double>>>")
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 8.0, 8.0), (4, 20.0, 20.0), (5, None, 1.0)], "id int, lat double, lon double")
    assert rows(spatial.region_of(points, parts, [F.col("feature")], "id", ["feature"], part="feature")) == [(1, 1), (3, 1)]
    assert rows(spatial.region_of(points, parts, [-F.col("feature")], "id", ["feature"], part="feature")) == [(1, 2), (3, 1)]


def test_search_puts_the_exact_call_first(spark):
    calls = spark.createDataFrame([("W1AW", 1), ("W1AWX", 9), ("KW1AW", None), ("N0BOX", 5)], "call string, year int")
    terms = spark.createDataFrame([("W1AW",), ("1",), ("",)], "term string")
    top = search.top_matches(search.matches(calls, terms), [F.col("year").desc_nulls_last()], 2)
    assert rows(top.select("term", "place", "call", "truncated")) == [("1", 1, "W1AWX", True), ("1", 2, "W1AW", True), ("W1AW", 1, "W1AW", True), ("W1AW", 2, "W1AWX", True)]


def test_chain_keeps_the_first_error_only_for_misses(spark):
    calls = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "call string")
    one = spark.createDataFrame([("A", "one", None), ("B", None, "down"), ("C", None, "down")], "call string, name string, error string")
    two = spark.createDataFrame([("B", "two")], "call string, name string")
    assert rows(lookup.chain(calls, [("one", one), ("two", two)], "call")) == [("A", "one", "one", None), ("B", "two", "two", None), ("C", None, None, "down")]


def test_chain_takes_one_row_of_a_repeated_key(spark):
    calls = spark.createDataFrame([("A",), ("B",), (None,)], "call string")
    one = spark.createDataFrame([("A", "z", None), ("A", "b", None), ("B", None, "down"), ("B", "x", None), (None, "n", None)], "call string, name string, error string")
    assert rows(lookup.chain(calls, [("one", one)], "call")) == [("A", "b", "one", None), ("B", "x", "one", None), (None, None, None, None)]


def test_white_space_is_trimmed_before_a_contact_is_judged(spark):
    given = [(" 14.250 ", "K1"), ("\t", "\t"), ("14.25\n0", "\u00a0K1\u2003"), (None, None)]
    df = log.validate(spark.createDataFrame(given, "frequency string, call string"), ["call"], {"frequency": "\\d+\\.\\d{3}", "call": "K1"})
    assert [r["errors"] for r in df.collect()] == ["", "call is required", "frequency is not valid", "call is required"]


def prefix_list(spark, tmp_path, lines):
    (tmp_path / "list").write_text("a\nb\nc\n" + "\n".join(lines))
    return dumps.prefix_list(spark, str(tmp_path / "list"))


def test_prefix_tree(spark, tmp_path):
    """Entities by filled and begun masks, what is below only by filled ones, attributes, the last hit first."""
    lines = [
        "0100|-234|9540|England|G|14|27|EU|0|223||||G,M,2E|",
        "0201|||Club|||||||||||",
        "0201|-200|9500|County|G|||||||||G4[A-C]|",
        "0202|||Harbour||||||||||G4AB|",
        "0100|-2700|5040|Canary Is.|EA8|33|36|AF|0|029||||E[A-H]8|",
        "0100|0|-16200|Antarctica|CE9|13|74|AN||013||||CE9|",
        "0100|900|900|Twin|T|1|1|EU|0|77||||T#.,TA12|",
    ]
    entries = prefix_list(spark, tmp_path, lines)
    names = ["G4ABC", " g4zz ", "EA8/W1AW", "123ABC", "X", "ZZZZZZ", None, "G4ABC/MM", "K1AB/ANT", "T1", "T1A", "TA", "TA1", "TA1/P", "TA13", "G4ABC/QRP/B"]
    calls = spark.createDataFrame([(c,) for c in [*names, "G4ABC"]], "call string")
    got = {r["call"]: r for r in prefixes.resolve(calls, entries).collect()}
    assert set(got) == {"G4ABC", " g4zz ", "EA8/W1AW", "K1AB/ANT", "T1", "TA", "TA1", "TA1/P", "G4ABC/QRP/B"}
    england = got["G4ABC"]
    assert (england["territory"], england["province"], england["attributes"], england["dxcc"], england["cq"]) == ("England", "County", ["Harbour"], "223", "14")
    assert (england["lat"], england["lon"]) == (9500 / 180, -200 / 180) and got[" g4zz "]["province"] is None
    assert (got["EA8/W1AW"]["territory"], got["EA8/W1AW"]["dxcc"]) == ("Canary Is.", "029") and got["K1AB/ANT"]["territory"] == "Antarctica"
    assert prefixes.resolve_all(calls, entries.limit(0)).count() == prefixes.resolve_all(calls.limit(0), entries).count() == 0
    miles = {r["call"]: r["miles"] for r in prefixes.distances(prefixes.resolve(calls, entries), F.lit(5040 / 180), F.lit(-15.0)).collect()}
    assert miles["EA8/W1AW"] == 0 and miles["K1AB/ANT"] > 8000


def test_adif_reads_odd_files(spark):
    text = "note <EOH><CALL:4>W1AW<call:4>K1AB <QSO_DATE:8>20240601<TIME_ON:4>1230<EOR>\n<CALL:2>É1 <EOR><CALL:3>N0B"
    out = adif.parse(spark.createDataFrame([(text,), ("",), (None,)], "value string")).orderBy("position").collect()
    assert [r["fields"]["CALL"] for r in out] == ["K1AB", "É1", "N0B"]
    text = "<NAME:4>😀é<<CALL:4>K1AB<X><EOR><EOR><a:3:S>1<2<eor>"
    out = adif.parse(spark.createDataFrame([(text,), ("<CALL:2>K1<EOH>",), ("<CALL:9>K",)], "value string")).collect()
    assert sorted((r["position"], r["fields"]) for r in out if "CALL" not in r["fields"]) == [(1, {"A": "1<2"})]
    assert sorted((r["fields"] for r in out if "CALL" in r["fields"]), key=len) == [{"CALL": "K"}, {"NAME": "😀é<", "CALL": "K1AB", "X": ""}]


def test_written_logs_are_one_file_in_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"K{i}", T[i % 4]) for i in range(200)], "n int, call string, at timestamp")
    adif.write(rows, adif.line([("CALL", F.col("call")), ("QSO_DATE", F.lit(""))], F.col("at")), ["n"], str(tmp_path / "log"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "log").glob("part-*")))
    assert text.count("<EOH>") == 1 and text.index("<EOH>") < text.index("<EOR>")
    out = adif.parse(spark.createDataFrame([(text,)], "value string")).orderBy("position").collect()
    assert [r["fields"]["CALL"] for r in out] == [f"K{i}" for i in range(200)]


def test_dump_readers(spark, tmp_path):
    (tmp_path / "EN.dat").write_bytes("EN|1|a\r\nmore|é\r\nEN|2|\nEN|3\n".encode("latin-1"))
    out = dumps.pipe_records(spark, str(tmp_path / "EN.dat"), "EN", ["tag", "id", "name", "rest"])
    assert [tuple(r) for r in out.orderBy("position").select("tag", "id", "name", "rest").collect()] == [("EN", "1", "a more", "é"), ("EN", "2", None, None), ("EN", "3", None, None)]
    with pytest.raises(Exception, match="too many"):
        dumps.pipe_records(spark, str(tmp_path / "EN.dat"), "EN", ["tag", "id"]).collect()
    big = "".join(f"EN|{i}|name {i}\nwrapped {i}|x\n" for i in range(20_000))
    (tmp_path / "big.dat").write_text(big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        out = dumps.pipe_records(spark, str(tmp_path / "big.dat"), "EN", ["tag", "id", "name", "rest"])
        assert out.rdd.getNumPartitions() > 5
        assert [tuple(r) for r in out.orderBy("position").select("id", "name", "rest").collect()] == [(str(i), f"name {i} wrapped {i}", "x") for i in range(20_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    prefix = "h1\nh2\nh3\n-0100|100|-200|Land|K|4|8|NA|5|901||2000|2001|K\nL0401|1|2|skip|||||||||X|\n0301|360|540|Isle|KH6|||||||||KH6.\n"
    (tmp_path / "Prefix.lst").write_text(prefix)
    assert [(r["id"], r["kind"], r["level"], r["territory"], r["cq"], r["mask"], r["parent"]) for r in dumps.prefix_list(spark, str(tmp_path / "Prefix.lst")).orderBy("id").collect()] == [(1, 1, 0, "Land", "4", "K", None), (2, 3, 1, "Isle", None, "KH6.", 1)]
    (tmp_path / "z.json").write_text('{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,1],[2,1],[2,3],[0,1]]]},"properties":{"name":"p"}},{"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]},"properties":{"name":"m"}}]}')
    out = dumps.geojson(spark, str(tmp_path / "z.json"), ["name"])
    assert rows(out.select("feature", "part", "name", "minx", "maxy")) == [(0, 0, "p", 0.0, 3.0), (1, 0, "m", 0.0, 1.0), (1, 1, "m", 5.0, 6.0)]
    tree = dumps.parents(spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 1), (5, 0)], "id int, level int"), 3)
    assert rows(tree.select("id", "parent")) == [(1, None), (2, 1), (3, 2), (4, 1), (5, None)]


def test_wkb():
    ring = struct.pack("<I8d", 4, 0, 1, 2, 1, 2, 3, 0, 1)
    assert places.wkb_rings(struct.pack("<BII", 1, 3, 1) + ring) == [[(1, 0), (1, 2), (3, 2), (1, 0)]]
    assert places.wkb_rings(struct.pack(">BII", 0, 3, 1) + struct.pack(">I8d", 4, 0, 1, 2, 1, 2, 3, 0, 1)) == [[(1, 0), (1, 2), (3, 2), (1, 0)]]
    assert places.wkb_rings(b"\x01\x03") == places.wkb_rings(None) == places.wkb_rings(struct.pack("<BII", 1, 6, 1)) == []


def test_publish_keeps_the_old_table_if_a_check_fails(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    etl.publish(spark.range(3), path)
    with pytest.raises(ValueError):
        etl.publish(spark.range(0), path, lambda df: (_ for _ in ()).throw(ValueError("empty")))
    assert etl.current(spark, path).count() == 3
    etl.publish(spark.range(5), path)
    assert etl.current(spark, path).count() == 5


def test_stream_of_several_batches(spark, tmp_path):
    schema = "uuid string, created_at long, last_edited long, arrival_seq long, mode string"
    for i, batch in enumerate([[("a", 1, 5, 1, "first"), ("b", 1, 1, 2, "x")], [("a", 2, 5, 3, "tie"), ("a", 3, 4, 4, "old")], [("b", 4, 9, 5, "new")]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = jobs.upserts(stream, f"file://{tmp_path}/out")
    assert rows(out.select("uuid", "created_at", "mode")) == [("a", 1, "tie"), ("b", 1, "new")]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "uuid string, created_at long, last_edited long, arrival_seq long, mode string"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    put = lambda i, batch: spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    changes = [[("a", 1, 5, 1, "first"), ("b", 1, 1, 2, "x")], [("c", 4, 9, 3, "new"), ("b", 2, 0, 4, "late")]]
    out = f"file://{tmp_path}/out"
    put(0, changes[0])
    assert jobs.upserts(stream(), out).count() == 2
    put(1, changes[1])
    want = rows(log.fold(spark.createDataFrame(sum(changes, []), schema)).select("uuid", "created_at", "mode"))
    assert rows(jobs.upserts(stream(), out).select("uuid", "created_at", "mode")) == want == [("a", 1, "first"), ("b", 1, "x"), ("c", 4, "new")]
    assert rows(jobs.upserts(stream(), out).select("uuid", "created_at", "mode")) == want  # nothing new


def test_chat_stays_cleared(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "key string, turn long").write.parquet(str(tmp_path / "in/0"))
    stream = lambda: spark.readStream.schema("key string, turn long").parquet(str(tmp_path / "in/*"))
    out = f"file://{tmp_path}/out"
    assert rows(jobs.chat(stream(), out, ["key"], "turn")) == [("a", 1), ("b", 2)]
    jobs.clear_chat(spark, out, 1)
    assert rows(jobs.chat(stream(), out, ["key"], "turn")) == [("b", 2)]


def test_change_gate_holds_over_restarts(spark, tmp_path):
    done, path = [], f"file://{tmp_path}/gate"
    assert jobs.change_gated(spark, path, 1, lambda: done.append(1)) and not jobs.change_gated(spark, path, 1, lambda: done.append(2))
    assert jobs.change_gated(spark, path, 2, lambda: done.append(3)) and done == [1, 3]
    assert jobs.change_gated(spark, path, 1, lambda: done.append(4))


def test_log_operators_keep_nulls(spark):
    df = spark.createDataFrame([(1, "K1", None, "CW", T[0], "o"), (2, None, "20m", "CW", T[1], None), (3, "K1", None, "CW", None, None), (4, "K1", None, "CW", T[2], "o")], "uuid int, remote_callsign string, band string, mode string, qso_at timestamp, operator string")
    assert rows(log.duplicates(df, "band-mode").select("uuid", "previous")) == [(1, None), (2, None), (3, 4), (4, 1)]
    assert log.duplicates(df, "any").count() == log.duplicates(df, "band-mode-day").count() == 4
    assert rows(stats.operator_report(df).select("operator", "total", "best_hour")) == [("o", 2, 2), (None, 2, 1)]
    assert rows(log.import_new(df.where("uuid > 2"), df.where("uuid = 1"), "uuid").select("uuid")) == [(3,), (4,)]
    assert rows(log.import_new(df.where("uuid = 1"), df.where("uuid = 1"), "uuid").select("uuid")) == []
    cache = spark.createDataFrame([("a", True, 1, "old"), ("a", True, 2, "new"), ("b", False, 3, None)], "address string, matched boolean, fetched_at int, coordinates string")
    assert rows(etl.with_coordinates(spark.createDataFrame([("a",), ("b",)], "address string"), cache, "address")) == [("a", "new"), ("b", None)]


def test_times_in_another_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-06-01T12:00:00.123456Z",), ("2024-06-01 12:00:00",), ("2024-06-01T08:00:00-04:00",), ("soon",), (None,)], "t string")
        got = [r[0] for r in df.select(scalars.iso_ms(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2024-06-01T12:00:00.123+00:00", "2024-06-01T12:00:00.000+00:00", "2024-06-01T12:00:00.000+00:00", None, None]


def test_sources_in_their_orders(spark):
    columns = "call string, fd_last_year int, wfd_last_year int, pota_hunter_qsos int, pota_activations int, lotw_last_upload string, clublog int, clublog_last_qso string, scp int, source_count int"
    known = [
        ("W1AW", 2010, 2024, 1, 1, "2010-01-01", 1, "2010-01-01", 1, 7), ("W1AWX", 2026, 2026, 999, 999, "2026-01-01", 1, "2026-01-01", 1, 6), ("KW1AW", 2025, 2025, 500, 500, "2025-01-01", 1, "2025-01-01", 1, 7),
        ("W1AWZZ", 2024, 2024, 250, 250, "2024-01-01", 1, "2024-01-01", 1, 7), ("W1AWQ", None, None, None, None, None, 1, None, 0, 1), ("K9XYZ", 2026, 2026, 9999, 9999, "2026-01-01", 1, "2026-01-01", 1, 7),
    ]
    terms = spark.createDataFrame([("W1AW",), ("1AW",)], "term string")
    got = search.by_source(search.matches(spark.createDataFrame(known, columns), terms)).orderBy("place").collect()
    order = lambda term, source: [r["call"] for r in got if (r["term"], r["source"]) == (term, source)]
    for source in ("fd", "wfd", "pota_hunter", "pota_activator", "lotw"):
        assert order("W1AW", source) == ["W1AW", "W1AWX", "KW1AW", "W1AWZZ"]
    assert order("W1AW", "clublog") == ["W1AW", "W1AWX", "KW1AW", "W1AWZZ", "W1AWQ"]
    assert order("W1AW", "scp") == ["W1AW", "KW1AW", "W1AWX", "W1AWZZ"]
    assert order("1AW", "fd") == ["W1AWX", "KW1AW", "W1AWZZ", "W1AW"] and order("1AW", "scp") == ["W1AW", "KW1AW", "W1AWX", "W1AWZZ"]
    assert [r["value"] for r in got if (r["term"], r["source"]) == ("W1AW", "pota_hunter")] == ["1", "999", "500", "250"] and {r["value"] for r in got if r["source"] == "scp"} == {None}


def test_small_drivers_rules(spark, tmp_path):
    answers = spark.createDataFrame([("a", "power", " "), ("b", "power", "5 W"), ("b", "note", "n" * 21), (None, "power", "1")], "export string, name string, answer string")
    assert rows(forms.unanswered([{"name": "power", "required": True}, {"name": "note"}], answers, "export")) == [("a", "power", "missing"), ("b", "note", "too long")]
    assert exports.backup(spark.range(3), f"file://{tmp_path}", "log", "20240601").endswith("log-20240601")
    with pytest.raises(Exception, match="already exists"):
        exports.backup(spark.range(3), f"file://{tmp_path}", "log", "20240601")
    exports.snapshot({"a": spark.range(2)}, f"file://{tmp_path}/snap")
    assert spark.read.json(f"file://{tmp_path}/snap/a").count() == 2
    with pytest.raises(ValueError, match="fewer"):
        (tmp_path / "parks.csv").write_text("reference,name,active,entityId,locationDesc,latitude,longitude,grid\nUS-1,a,1,1,x,1,2,CN87uo\n")
        dumps.parks(spark, str(tmp_path / "parks.csv"))
    assert dumps.parks(spark, str(tmp_path / "parks.csv"), 1).first()["grid"] == "CN87"
    (tmp_path / "fd.csv").write_bytes("Call used,Club\nk1ab;w\u00d82x,Caf\u00e9\n".replace(";", " ").encode("cp1252"))
    assert rows(activity.field_day(spark, str(tmp_path / "fd.csv"), 2024)) == [("K1AB", 2024), ("W02X", 2024)]


def test_overrides_by_precedence(spark):
    """The first kind of entry that can be resolved counts; one that can't changes nothing and leaves the next its turn."""
    square = lambda lat, lon, d=3.0: [[(lat - d, lon - d), (lat - d, lon + d), (lat + d, lon + d), (lat + d, lon - d), (lat - d, lon - d)]]
    at = {"HI": (21.3, -157.8, "PAC", 31, 110), "ME": (44.3, -68.2, "ME", 5, 291), "TX": (32.8, -97.0, "NTX", 4, 291), "CT": (41.7, -72.7, "CT", 5, 291)}
    rows_ = [(i, lon - 3, lon + 3, lat - 3, lat + 3, square(lat, lon), f"{state} county", state, section, cq, cq + 1, f"Land {dxcc}", dxcc) for i, (state, (lat, lon, section, cq, dxcc)) in enumerate(at.items())]
    parts = spark.createDataFrame(rows_, "part int, minx double, maxx double, miny double, maxy double, rings array<array<struct<lat:double,lon:double>>>, county string, state string, section string, cq_zone int, itu_zone int, country string, dxcc int")
    layers = {n: location.Layer(parts, [F.col("part")], location.FROM_LAYER[n]) for n in location.FROM_LAYER}
    parks = spark.createDataFrame([("US-0001", "Acadia", 44.3, -68.2), ("US-0002", "Nowhere", 0.0, 0.0), ("US-0003", "", 21.3, -157.8)], "reference string, name string, latitude double, longitude double")
    sections = spark.createDataFrame([("NTX", 32.8, -97.0)], "code string, lat double, lon double")
    states = spark.createDataFrame([("HI", 21.3, -157.8), ("TX", 31.0, -98.0)], "code string, lat double, lon double")
    one = spark.createDataFrame([("HI", "PAC")], "state string, section string")
    entries = {
        "none": {}, "coords": {"latitude": "21.3", "longitude": "-157.8"}, "park": {"park": " us-0001,US-9"}, "section": {"section": "ntx"}, "one": {"state": "Hawaii"}, "split": {"state": "TX"}, "grid": {"grid": "bl11ab"},
        "all": {"latitude": "21.3", "longitude": "-157.8", "park": "US-0001", "section": "NTX", "state": "TX", "grid": "BL11"}, "park first": {"park": "US-0001", "section": "NTX"}, "section first": {"section": "NTX", "state": "HI"}, "same": {"state": "CT"},
        "no section": {"section": "ZZZ"}, "next": {"section": "ZZZ", "state": "HI"}, "emptied": {"latitude": "", "longitude": "", "state": "HI"}, "half": {"latitude": "21.3", "state": "HI"}, "no park": {"park": "US-0002", "state": "HI"}, "far": {"latitude": "95", "longitude": "5"},
    }
    names = ["latitude", "longitude", "park", "section", "state", "grid"]
    records = spark.createDataFrame(
        [(k, 41.7148, -72.7273, "FN31", "CT", "CT", "Capitol", "United States", 291, None, 8, *[v.get(n) for n in names]) for k, v in entries.items()],
        "key string, latitude double, longitude double, gridsquare string, state string, section string, county string, country string, dxcc int, cq_zone int, itu_zone int, " + ", ".join(f"typed_{n} string" for n in names),
    )
    got = {r["key"]: r for r in location.postprocess(records, "key", layers, parks, sections, states, one, (45.5152, -122.6784)).collect()}
    field = lambda k, *fs: tuple(got[k][f] for f in fs)
    assert field("none", "state", "county", "gridsquare", "cq_zone", "itu_zone", "pota_park", "override") == ("CT", "Capitol", "FN31", 5, 8, None, None)
    assert field("coords", "state", "dxcc", "cq_zone", "gridsquare", "section") == ("HI", 110, 31, "BL11", "PAC") and got["coords"]["distance"] != got["none"]["distance"]
    assert field("park", "state", "county", "pota_park", "latitude") == ("ME", "ME county", "Acadia", 44.3)
    assert field("section", "section", "state", "gridsquare", "county", "cq_zone") == ("NTX", "TX", None, None, 4)
    assert field("one", "state", "section", "cq_zone", "county") == ("HI", "PAC", 31, None) and field("split", "state", "section") == ("TX", None)
    assert field("grid", "gridsquare", "cq_zone", "state", "section", "county") == ("BL11", 31, None, None, None)
    assert field("all", "state", "pota_park", "override") == ("HI", None, "coordinates") and field("park first", "state") == ("ME",) and field("section first", "state", "section") == ("TX", "NTX")
    assert field("same", "county", "gridsquare", "override") == field("no section", "county", "gridsquare", "override") == ("Capitol", "FN31", None)
    assert all(field(k, "state", "override") == ("HI", "state") for k in ("next", "emptied", "half", "no park"))
    assert field("far", "latitude", "state", "gridsquare", "dxcc", "distance") == (95.0, None, None, None, None)
