"""Readers of activity lists on small files."""

import json

import pytest
from pyspark.sql import functions as F

from radiolake.operators import forms, spatial
from radiolake.sources import activity, dumps


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def put(path, text):
    path.write_text(text)
    return str(path)


def test_lists(spark, tmp_path):
    assert rows(activity.field_day(spark, put(tmp_path / "fd.csv", "Call,GOTA Call,Club Call,N\nw1aw,K?AB & n1xyz,W9CLB,3\n??,,,1\n"), 2023)) == [("K0AB", 2023), ("N1XYZ", 2023), ("W1AW", 2023)]
    assert rows(activity.winter_field_day(spark, put(tmp_path / "w.json", '{"aaData":[{"callsign":"k1ab"},{"callsign":"x"}]}'), 2022)) == [("K1AB", 2022)]
    assert rows(activity.park_activity(spark, put(tmp_path / "p.json", '[{"c":"k1ab","n":3},{"c":"K1AB","n":7}]'), "c", "n")) == [("K1AB", 7)]
    assert rows(activity.log_uploads(spark, put(tmp_path / "l.csv", "K1AB,2024-01-02,00:00\nK1AB,2023-12-31,1\nK2AB,soon,1\n"))) == [("K1AB", "2024-01-02")]
    assert rows(activity.club_log(spark, put(tmp_path / "c.json", '{"K1AB_2":{"lastqso":null},"K1AB":{},"K2AB":{"lastqso":"2024-01-01"}}'))) == [("K1AB", None), ("K2AB", "2024-01-01")]
    assert rows(activity.check_partial(spark, put(tmp_path / "s.txt", "# note\n!x\n\nk1ab\nK1AB\n"))) == [("K1AB", 1)]


def test_places(spark, tmp_path):
    for sep in ("|", "\t"):
        text = sep.join(["GEOID", "INTPTLAT", "INTPTLONG "]) + "\n" + sep.join(["97201", "45.5", "-122.7"]) + "\n" + sep.join(["97202", "x", "1"]) + "\n"
        assert rows(activity.gazetteer(spark, put(tmp_path / f"g{ord(sep)}.txt", text), ("GEOID", "INTPTLAT", "INTPTLONG"))) == [("97201", 45.5, -122.7)]
    got = activity.geocoder_results(spark, put(tmp_path / "r.csv", '1,"a","Match","Exact","A","-122.7,45.5"\n2,"b","No_Match"\n3,"c","Match","Exact","C","oops"\n'))
    assert rows(got) == [("1", True, 45.5, -122.7), ("2", False, None, None), ("3", False, None, None)]
    assert rows(activity.manifest_counts(spark, put(tmp_path / "m", "  12 ./EN.dat\n 3 counts/HD.dat\nnothing\n"))) == [("EN", 12), ("HD", 3)]


def test_semicolon_dump_and_parks(spark, tmp_path):
    assert rows(dumps.semicolon_dump(spark, put(tmp_path / "a.txt", "callsign;name\nVE1A;Pat\n"), ["callsign", "name"])) == [("VE1A", "Pat")]
    parks = dumps.parks(spark, put(tmp_path / "p.csv", "reference,name,active,entityId,locationDesc,latitude,longitude,grid,more\nUS-1,One,1,291,US-OR,45.5,x,CN85ab,z\n,None,,,,,,,\n"), 1)
    assert rows(parks) == [("US-1", "One", 1, 291, "US-OR", 45.5, None, "CN85")]


def test_call_index_keeps_members_without_a_value(spark):
    a = spark.createDataFrame([("K1AB", None), ("K2AB", 5)], "call string, value long")
    b = spark.createDataFrame([("K1AB", 9)], "call string, value long")
    assert rows(forms.call_index({"a": a, "b": b})) == [("K1AB", None, 9, 2), ("K2AB", 5, None, 1)]


def test_county_of_snaps_only_within_reach(spark):
    square = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]]
    parts = spark.createDataFrame([("OR", "x", 1, square), ("OR", "y", 2, square)], "state string, county string, position int, rings array<array<struct<lat:double,lon:double>>>")
    points = spark.createDataFrame([(1, "OR", 0.5, 0.5), (2, "OR", 1.25, 0.5), (3, "OR", 9.0, 9.0), (4, "WA", 0.5, 0.5), (5, "OR", None, 0.5)], "id int, state string, lat double, lon double")
    got = spatial.county_of(points, parts, "id", "state", "county", "position")
    assert rows(got) == [(1, "y"), (2, "x"), (3, None), (4, None), (5, None)]
    assert rows(spatial.county_of(points.where("id = 3"), parts, "id", "state", "county", "position", None).select(F.col("county"))) == [("x",)]


def test_a_keyed_document_is_many_tasks_work(spark, tmp_path, request):
    """The same rows from a document cut at any byte, on one line or many; entries of another form raise."""
    entries = {f"K{i}AB_{i % 3}": ({"lastqso": f"2024-01-{1 + i % 28:02d} 10:00:00", "n": "\u00e9" * (i % 7)} if i % 2 else {}) for i in range(400)}
    entries['W1"X'] = {"lastqso": "soon"}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text(json.dumps(entries))
    (tmp_path / "b.json").write_text(json.dumps(entries, indent=1, ensure_ascii=False), encoding="utf-8")
    want = {f"K{i}AB": f"2024-01-{1 + i % 28:02d}" if i % 2 else None for i in range(400)}
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.files.maxPartitionBytes"))
    for size in (997, 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        for path in (tmp_path / "a", tmp_path / "b.json"):
            got = {r["call"]: r["value"] for r in activity.club_log(spark, str(path)).collect()}
            assert {k: v and v[:10] for k, v in got.items() if k.startswith("K")} == want
        assert (spark.read.option("lineSep", "},").text(str(tmp_path / "a")).rdd.getNumPartitions() > 3) == (size < 1000)
    (tmp_path / "c.json").write_text('{"K1":{"a":[{"b":1}]}}')
    with pytest.raises(Exception, match="not an entry"):
        activity.club_log(spark, str(tmp_path / "c.json")).collect()
