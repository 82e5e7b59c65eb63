from tabwise.operators import locate
from tabwise.sources import empty_cache, import_json_cache

PTS = "id INT, latitude DOUBLE, longitude DOUBLE, location STRING"


def test_resolve_from_responses(spark):
    pts = spark.createDataFrame([(1, 51.5074, -0.1278, None), (2, 40.7128, -74.006, None)], PTS)
    resp = spark.createDataFrame([(51.5074, -0.1278, {"country": "United Kingdom"}),
                                  (40.7128, -74.006, {"country": "United States"})],
                                 "lat DOUBLE, lon DOUBLE, components MAP<STRING,STRING>")
    out = locate.enrich_location(pts, empty_cache(spark), responses=resp)
    assert [r.location for r in out.orderBy("id").collect()] == ["United Kingdom", "United States"]


def test_rule_order(spark):
    resp = spark.createDataFrame([(1.0, 1.0, {"country": "", "body_of_water": "Sea"}),
                                  (2.0, 2.0, {"body_of_water": None}), (3.0, 3.0, {"country": "C"})],
                                 "lat DOUBLE, lon DOUBLE, components MAP<STRING,STRING>")
    got = {r.lat_key: r.location for r in locate.resolve_responses(resp).collect()}
    assert got == {1.0: "Sea", 2.0: "Unknown", 3.0: "C"}


def test_cache_hit_and_budget(spark):
    pts = spark.createDataFrame([(1, 51.5074, -0.1278, None), (2, 40.7128, -74.006, None)], PTS)
    cache = spark.createDataFrame([(51.5074, -0.1278, "Cached UK")], "lat_key DOUBLE, lon_key DOUBLE, location STRING")
    out = locate.enrich_location(pts, cache, id_cols=["id"], limit=1)
    assert [r.location for r in out.orderBy("id").collect()] == ["Cached UK", None]


def test_null_coordinates_unknown_and_existing_kept(spark):
    pts = spark.createDataFrame([(1, None, 105.0, None), (2, 10.0, None, None), (3, 1.0, 1.0, "Kept")], PTS)
    out = locate.enrich_location(pts, empty_cache(spark))
    assert [r.location for r in out.orderBy("id").collect()] == ["Unknown", "Unknown", "Kept"]


def test_missing_keys_and_json_import(spark):
    raw = spark.createDataFrame([('{"(51.5074, -0.1278)": "Unknown", "(1.0E-4, 2.5)": "X"}',)], "value STRING")
    cache = import_json_cache(raw)
    got = sorted((r.lat_key, r.lon_key, r.location) for r in cache.collect())
    assert got == [(0.0001, 2.5, "X"), (51.5074, -0.1278, "Unknown")]
    pts = spark.createDataFrame([(1, 51.50741, -0.12779, None), (2, 3.0, 4.0, None)], PTS)
    keys = [(r.lat_key, r.lon_key) for r in locate.missing_keys(pts, cache).collect()]
    assert keys == [(3.0, 4.0)]


def test_budget_counts_rows_without_id_and_rows_of_one_id_once(spark):
    cache = spark.createDataFrame([(1.0, 1.0, "A")], "lat_key DOUBLE, lon_key DOUBLE, location STRING")
    pts = spark.createDataFrame([(None, 1.0, 1.0, None), (1, 1.0, 1.0, None), (1, 1.0, 1.0, None), (1, 1.0, 1.0, None),
                                 (2, 1.0, 1.0, None), (1, 1.0, 1.0, "Kept")], PTS)
    for limit, want in ((1, 1), (3, 3), (4, 4), (9, 5)):
        out = locate.enrich_location(pts, cache, id_cols=["id"], limit=limit).collect()
        assert sorted((r.id or 0) for r in out) == [0, 1, 1, 1, 1, 2]
        assert sum(r.location == "A" for r in out) == want and sum(r.location == "Kept" for r in out) == 1
        assert [r.location for r in out if r.id is None] == ["A"]
