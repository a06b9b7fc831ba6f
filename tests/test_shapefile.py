"""Layers written by hand and read back: ranges of records, holes, odd records, missing fields."""

import pytest

from radiolake.plans.geometry import write_layer
from radiolake.sources import shapefile


def square(x, y, s):
    return [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]


def write(path, n):
    shape = lambda k: None if k % 5 == 4 else [square(k, 0.0, 10.0), square(k + 1.0, 1.0, 6.0)[::-1], square(k + 2.0, 2.0, 4.0), square(k + 3.0, 3.0, 1.0)[::-1]]
    write_layer(f"file://{path}", [({"NAME": f"n{k}é", "CODE": " " if k % 2 else str(k)}, shape(k)) for k in range(n)])


def test_a_layer_is_read_in_ranges(spark, tmp_path):
    write(tmp_path / "l" / "a", 23)
    df = shapefile.layer(spark, str(tmp_path / "l" / "a.shp"), ["CODE", "NAME"], "latin-1", 4)
    got = sorted(df.collect(), key=lambda r: r["record"])
    assert df.rdd.getNumPartitions() == 6 and [r["record"] for r in got] == [k for k in range(23) if k % 5 != 4]
    assert all((r["NAME"], r["CODE"]) == (f"n{r['record']}é", None if r["record"] % 2 else str(r["record"])) for r in got)
    # an island in a lake is an outline of its own, and its pond belongs to it
    assert all([len(p) for p in r["parts"]] == [2, 2] and r["parts"][1][0][0]["lon"] == r["record"] + 2.0 for r in got)
    whole = shapefile.layer(spark, str(tmp_path / "l" / "a"), ["CODE", "NAME"], "latin-1")
    assert whole.rdd.getNumPartitions() == 1 and sorted(map(str, whole.collect())) == sorted(map(str, got))


def test_odd_layers(spark, tmp_path):
    write(tmp_path / "l" / "a", 2)
    with pytest.raises(Exception, match="has no ZONE"):
        shapefile.layer(spark, str(tmp_path / "l" / "a"), ["ZONE"], "latin-1").count()
    with pytest.raises(Exception, match="has no .dbf"):
        shapefile.layer(spark, str(tmp_path / "l" / "b"), ["NAME"]).count()
    raw = (tmp_path / "l" / "a.dbf").read_bytes()
    (tmp_path / "l" / "a.dbf").write_bytes(raw[:97] + b"*" + raw[98:])  # the first record is deleted
    assert [r["record"] for r in shapefile.layer(spark, str(tmp_path / "l" / "a"), ["NAME"], "latin-1").collect()] == [1]
    write_layer(f"file://{tmp_path}/l/none", [({"NAME": "x"}, None)])
    assert shapefile.layer(spark, str(tmp_path / "l" / "none"), ["NAME"]).count() == 0
    shx = (tmp_path / "l" / "none.shx").read_bytes()
    (tmp_path / "l" / "none.shx").write_bytes(shx[:100])
    assert shapefile.layer(spark, str(tmp_path / "l" / "none"), ["NAME"]).count() == 0
    with pytest.raises(ValueError, match="kind 3"):
        shapefile.polygon_rings((3).to_bytes(4, "little") + bytes(60))
