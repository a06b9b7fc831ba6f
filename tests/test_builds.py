"""Builds: phases that resume, checks before publishing, newer inputs, callsigns that accumulate."""

import pytest
from pyspark.sql import functions as F

from radiolake.operators import builds, etl, search
from radiolake.shared import shared_dir


def phases(spark, made, fail=(), version="1"):
    def step(name, make):
        def run(*tables):
            if name in fail:
                raise RuntimeError(name)
            made.append(name)
            return make(*tables)

        return run

    return [
        builds.Phase("base", step("base", lambda: spark.range(6).toDF("k"))),
        builds.Phase("extra", step("extra", lambda: spark.createDataFrame([(2, version)], "k long, v string")), version=version),
        builds.Phase("joined", step("joined", lambda a, b: a.join(b, "k", "left")), ("base", "extra")),
        builds.Phase("last", step("last", lambda t: t.withColumn("w", F.upper("v"))), ("joined",)),
    ]


def test_a_build_goes_on_where_it_stopped(spark):
    path, made = shared_dir(spark), []
    with pytest.raises(RuntimeError, match="joined"):
        builds.run(spark, path, phases(spark, made, ("joined",)))
    assert made == ["base", "extra"]
    with pytest.raises(ValueError, match="nothing has been published"):
        etl.current(spark, f"{path}/published")
    assert builds.run(spark, path, phases(spark, made), builds.whole("k", 6)).count() == 6
    assert made == ["base", "extra", "joined", "last"]
    builds.run(spark, path, phases(spark, made))
    assert len(made) == 4 and etl.pointers(spark, f"{path}/published").count() == 1


def test_a_newer_input_begins_at_its_first_phase(spark):
    path, made = shared_dir(spark), []
    builds.run(spark, path, phases(spark, made))
    made.clear()
    newer = builds.run(spark, path, phases(spark, made, version="b"))
    assert made == ["extra", "joined", "last"] and newer.where("w = 'B'").count() == 1
    made.clear()
    older = builds.run(spark, path, phases(spark, made))
    assert made == [] and older.where("w = '1'").count() == 1


def test_a_failed_check_keeps_what_is_published(spark):
    path, made = shared_dir(spark), []
    builds.run(spark, path, phases(spark, made))
    with pytest.raises(ValueError, match="6 rows of at least 7"):
        builds.run(spark, path, phases(spark, made, version="b"), builds.whole("k", 7))
    assert etl.current(spark, f"{path}/published").where("w = '1'").count() == 1
    made.clear()
    assert builds.run(spark, path, phases(spark, made, version="b")).where("w = 'B'").count() == 1 and made == []
    for rows in ([(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(ValueError, match="different keys"):
            builds.whole("k", 0)(spark.createDataFrame(rows, "k long"))


def test_phases_must_be_in_order(spark):
    with pytest.raises(ValueError, match="reads what no earlier phase makes: b"):
        builds.keys([builds.Phase("a", lambda b: b, ("b",))])
    with pytest.raises(ValueError, match="two phases"):
        builds.keys([builds.Phase("a", lambda: None), builds.Phase("a", lambda: None)])


def test_places_by_street_then_town(spark):
    rows = spark.createDataFrame(
        [(1, "1 Main", "Québec", "QC", None, None, None), (2, " ", "Québec", "qc", None, None, None), (3, None, " ", "QC", None, None, None), (4, "9 Elm", "QUEBEC", "QC", 1.0, 2.0, "Street")],
        "usi long, street string, city string, state string, lat double, lon double, how string",
    )
    cache = "key string, matched boolean, fetched_at int, lat double, lon double, how string"
    streets = spark.createDataFrame([("1 MAIN|QUÉBEC|QC", True, 1, 5.0, 5.0, "Street"), ("1 MAIN|QUÉBEC|QC", True, 2, 6.0, 6.0, "Street_Approx"), ("1 MAIN|QUÉBEC|QC", False, 3, None, None, None), (None, True, 1, 9.0, 9.0, "Street")], cache)
    towns = spark.createDataFrame([("QUEBEC|QC", True, 1, 7.0, 8.0, "City_Centroid"), ("|QC", True, 1, 0.5, 0.5, "City_Centroid")], cache)
    placed = builds.place_unplaced(rows, streets, builds.street_key(F.col("street"), F.col("city"), F.col("state")), "usi")
    placed = builds.place_unplaced(placed, towns, builds.town_key(F.col("city"), F.col("state")), "usi")
    assert placed.columns == rows.columns
    assert sorted((r.usi, r.lat, r.how) for r in placed.collect()) == [(1, 6.0, "Street_Approx"), (2, 7.0, "City_Centroid"), (3, None, None), (4, 1.0, "Street")]


def test_a_skipped_phase_leaves_the_table(spark):
    licensees = spark.createDataFrame([(1, "1 Main", "Town", "ON", None), (2, None, None, "BC", None)], "usi long, street string, city string, state string, postal string")
    cache = spark.createDataFrame([("1 MAIN|TOWN|ON", True, 1, 0.5, 0.5, "Street")], "key string, matched boolean, fetched_at int, lat double, lon double, how string")
    square = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]]
    rings = "array<array<struct<lat:double,lon:double>>>"
    areas = spark.createDataFrame([], f"area string, rings {rings}, km2 double, mid_lat double, mid_lon double")
    divisions = spark.createDataFrame([("ON", "York", 1, square, 1.0, 0.5, 0.5), ("BC", "Capital", 2, [[(y, x + 5) for y, x in square[0]]], 1.0, 0.5, 5.5)], f"province string, county string, position int, rings {rings}, area double, mid_lat double, mid_lon double")
    counties = spark.createDataFrame([("ON", "York", "GTA")], "state string, county string, section string")
    build = lambda *skip: builds.run(spark, shared_dir(spark), builds.canadian(licensees, cache, cache, areas, divisions, counties, {}, skip))
    whole = {r.usi: (r.how, r.county, r.section, r.dxcc_id) for r in build().collect()}
    assert whole == {1: ("Street", "York", "GTA", 1), 2: ("Province_Centroid", None, "BC", 1)}
    assert {r.usi: (r.how, r.county, r.section) for r in build("county").collect()} == {1: ("Street", None, None), 2: ("Province_Centroid", None, "BC")}
    assert {r.usi: (r.how, r.county) for r in build("street", "town", "province").collect()} == {1: (None, None), 2: (None, None)}


def test_callsigns_accumulate_and_a_failed_run_goes_on(spark):
    path = shared_dir(spark)
    fd = lambda *rows: spark.createDataFrame(rows, "call string, fd_last_year int")
    builds.call_index(spark, path, {"fd": (fd(("K1A", 2020), ("W7X", 2021), (None, 1)), "1"), "scp": (spark.createDataFrame([("K1A", 1)], "call string, scp int"), "1")}, "2024-01-01")
    # a source that can't be read stops the run; the table, the index and the phases that are finished stay
    broken = fd(("N0W", 1)).select("call", F.raise_error(F.lit("unreadable")).cast("int").alias("fd_last_year"))
    with pytest.raises(Exception, match="unreadable"):
        builds.call_index(spark, path, {"wfd": (spark.createDataFrame([("N1K1", 2023)], "call string, wfd_last_year int"), "1"), "fd": (broken, "2")}, "2024-02-01")
    assert etl.current(spark, f"{path}/published").count() == 2
    unread = spark.createDataFrame([("BAD", 0)], "call string, wfd_last_year int")  # the finished phase is not made again
    calls = builds.call_index(spark, path, {"wfd": (unread, "1"), "fd": (fd(("K1A", 2019), ("W7X", 2022)), "2")}, "2024-02-01")
    got = {r.call: (r.fd_last_year, r.wfd_last_year, r.scp, r.source_count, r.first_seen[5:7], r.last_seen[5:7]) for r in calls.collect()}
    assert got == {"K1A": (2020, None, 1, 2, "01", "02"), "W7X": (2022, None, 0, 1, "01", "02"), "N1K1": (None, 2023, 0, 1, "02", "02")}
    assert sorted(search.in_index(spark, f"{path}/suffixes", ["K1"]).collect()) == [("K1", "K1A"), ("K1", "N1K1")]
