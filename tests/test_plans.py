"""Physical plans: what must reach the scan, and what must not appear."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from radiolake.operators import etl, search
from radiolake.plans import registry
from radiolake.sources import adif

QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["spatial_join", "county_snap", "box_overlaps", "nearest_zip", "partial_search_topk", "call_parser", "dupe_any", "import_dedupe", "chain_lookup"])
def test_joins_are_equalities(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["pull_since"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan(QUERIES["value_breakdown"](spark, sf_dir))


def test_terms_are_ranges_of_the_stored_index(spark, tmp_path, request):
    """A term reaches the scan, and an index sorted by suffix has few row groups that its statistics let through."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these calls are too few for several files
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    calls = spark.range(4000).selectExpr("concat('K', id % 10, chr(65 + id % 26), id) AS call")
    path = f"file://{tmp_path}/index"
    search.write_index(calls.where("call < 'K5'"), path)
    assert search.extend_index(calls, path) == 1
    found = search.in_index(spark, path, ["7Z", "K", "", "K", "zz"])
    assert "StringStartsWith(suffix,7Z)" in plan(found) and "Exchange" not in plan(found)
    want = search.matches(calls, spark.createDataFrame([("7Z",), ("K",), ("zz",)], "term string")).select("term", "call")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    files = {f: pq.read_metadata(f).row_group(0).column(0).statistics for f in glob.glob(f"{tmp_path}/index/increment=0/*.parquet")}
    ends = sorted((s.min, s.max) for s in files.values())
    assert len(ends) > 1 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert search.in_index(spark, path, [""]).count() == 0


def test_no_window_over_all_contacts(spark, sf_dir):
    for name in ("sliding_hour_max", "lww_fold", "accumulate_merge", "band_mode_cube"):
        assert "SinglePartition" not in plan(QUERIES[name](spark, sf_dir)), name


def test_imported_records_are_read_once(spark, sf_dir):
    """The tallies count records that are already read: no parser in their plan."""
    text = plan(QUERIES["import_tallies"](spark, sf_dir))
    assert "MapInArrow" not in text and "collect_list" not in text


def test_data_in_units_are_taken_from_the_text():
    """Lengths in UTF-16 units, over characters of two units and ending inside one: as by reading the text unit by unit."""
    texts = ["<A:3>a😀<B:1>x", "<A:2>a😀<B:1>x", "<A:1>😀<B:2>é￿<C:9>😀😀", "<A:2>😀<a:0><EOR>", "<A:1>￿<B:3>😀<C:1>y"]
    for text in texts:
        assert adif.specifiers(text) == list(adif.by_units(adif.units(text)))
    assert adif.specifiers(texts[0]) == [("A", "a😀"), ("B", "x")] and dict(adif.specifiers(texts[1]))["A"] == "a�"


def test_answers_texts_are_judged_once(spark):
    """Names are compared once for each combination of texts, nulls among them, and not for each candidate."""
    given = [(k, k % 7 + i, "ca.Street", "Main Street, Town, Ontario", "OTHER", 1.0 + i, 2.0, street, None, province) for i, (street, province) in enumerate([("MAIN ST", None), (None, None), ("MAIN ST", "Alberta"), ("MAIN AVE", "ontario")]) for k in range(i * 100, i * 100 + 20)]
    candidates = spark.createDataFrame(given, "k int, position int, type string, title string, qualifier string, lat double, lon double, street string, city string, province string")
    df = etl.pick_places(candidates.unionByName(candidates.withColumn("lat", F.lit(None).cast("double")).withColumn("position", F.lit(-1))), "k")
    got = {r["k"]: (r["lat"], r["how"]) for r in df.collect()}
    assert len(got) == 80 and {got[k] for k in range(20)} == {(1.0, "Street_Approx")} and {got[k] for k in range(100, 220) if k in got} == {(None, None)} and {got[k] for k in range(300, 320)} == {(4.0, "Street_Approx")}
    assert "ArrowEvalPython" not in plan(df) and "RLIKE" not in plan(df) and "CartesianProduct" not in plan(df)


def test_regions_are_chosen_without_a_sort(spark, sf_dir):
    """A point's hits meet as one number in a hash table: nothing that grows with the hits is sorted."""
    for name in ("enclave_lookup", "spatial_join"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and "min(__number" in text, name
