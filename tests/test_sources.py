import pytest
from pyspark.sql import functions as F

from tabwise.operators import encode, learn, locate
from tabwise.sources import (append_cache, load_cache, load_model, load_params, load_split, save_model, save_params,
                             write_encoded, write_mapping)


def test_encoded_frames_and_mapping_partitions(spark, tmp_path):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c STRING, x DOUBLE")
    test = spark.createDataFrame([("b", 3.0), ("z", 4.0)], "c STRING, x DOUBLE")
    tr, te, mapping = encode.encode(train, ["c"], test)
    write_encoded(tr, te, str(tmp_path), "enc")
    back = spark.read.option("header", True).csv(str(tmp_path / "enc_X_test_encoded.csv"))
    assert sorted(float(r.c) for r in back.collect()) == [-1.0, 1.0]
    write_mapping(mapping, str(tmp_path), "enc")
    m = spark.read.parquet(str(tmp_path / "enc_encoders.parquet"))
    assert m.where(F.col("column_name") == "c").count() == 2


def test_cache_append_and_reload(spark, tmp_path):
    path = str(tmp_path / "cache.parquet")
    assert load_cache(spark, path, allow_missing=True).count() == 0
    first = spark.createDataFrame([(1.0, 2.0, "A")], "lat_key DOUBLE, lon_key DOUBLE, location STRING")
    append_cache(first, path)
    resolved = spark.createDataFrame([(1.0, 2.0, "dup"), (3.0, 4.0, "B")],
                                     "lat_key DOUBLE, lon_key DOUBLE, location STRING")
    cache = load_cache(spark, path)
    new = resolved.join(cache.select("lat_key", "lon_key"), ["lat_key", "lon_key"], "left_anti")
    append_cache(new, path)
    got = sorted((r.lat_key, r.location) for r in load_cache(spark, path).collect())
    assert got == [(1.0, "A"), (3.0, "B")]
    assert locate.update_cache(first, resolved).count() == 2


def test_split_table_params_and_model_roundtrip(spark, tmp_path):
    df = spark.range(40).select("id", (F.col("id") % 5).cast("double").alias("a"),
                                (F.col("id") % 2).cast("int").alias("label"),
                                F.when(F.col("id") < 30, "train").otherwise("test").alias("split"))
    df.write.partitionBy("split").parquet(str(tmp_path / "ds"))
    tr, te = load_split(spark, str(tmp_path / "ds"))
    assert tr.count() == 30 and te.count() == 10 and "split" not in tr.columns
    save_params({"n_estimators": 3, "max_depth": 2}, str(tmp_path / "p.json"))
    assert load_params(str(tmp_path / "p.json")) == {"n_estimators": 3, "max_depth": 2}
    assert load_params(str(tmp_path / "missing.json")) == {}
    built = learn.build_model(tr, "label", ["a"], model_type="rf", best_param_path=str(tmp_path / "p.json"),
                              exclude=["id"])
    save_model(built.model, str(tmp_path / "model"))
    again = load_model(str(tmp_path / "model"))
    a = [r.prediction for r in built.model.transform(te).orderBy("id").collect()]
    b = [r.prediction for r in again.transform(te).orderBy("id").collect()]
    assert a == b


def _write_lines(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(path)


def test_rejected_records_are_kept_with_their_reason(spark, tmp_path):
    from tabwise.sources import read_checked

    path = f"file://{tmp_path}/a.csv"
    lines = ["k,x,s", "1,2.5,a", "two,1,b", "3,,", '4,"1",""', "5,1", "6,1,c,d", '7,x,"q,""r"', "8,NaN,e"]
    _write_lines(spark, path, lines)
    read = read_checked(spark, path, "k LONG, x DOUBLE, s STRING")
    assert sorted(map(tuple, read.rows.collect())) == [(1, 2.5, "a"), (3, None, None), (4, 1.0, ""), (8, None, "e")]
    assert sorted((r.record, r.reason) for r in read.rejects.collect()) == sorted(
        [("two,1,b", "k"), ("5,1", "fields"), ("6,1,c,d", "fields"), ('7,x,"q,""r"', "x")])
    assert {r.reason: r.n for r in read.counts().collect()} == {"k": 1, "fields": 2, "x": 1}
    with pytest.raises(ValueError, match="a.csv"):
        read.require_clean()
    _write_lines(spark, f"file://{tmp_path}/b.json", ['{"k": 1, "x": 2.0}', '{"k": "a"}', "{broken", '{"x": null}'])
    read = read_checked(spark, f"file://{tmp_path}/b.json", "k LONG, x DOUBLE")
    assert sorted(map(str, read.rows.collect())) == sorted(["Row(k=1, x=2.0)", "Row(k=None, x=None)"])
    assert {(r.record, r.reason) for r in read.rejects.collect()} == {('{"k": "a"}', "record"), ("{broken", "record")}
    _write_lines(spark, f"file://{tmp_path}/c.csv", ["k", "1"])
    assert read_checked(spark, f"file://{tmp_path}/c.csv", "k LONG").require_clean().count() == 1
    with pytest.raises(ValueError):
        read_checked(spark, "x.parquet", "k LONG")


def test_cache_table_is_read_in_buckets_and_appends_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from tabwise.operators import locate
    from tabwise.sources import CacheTable

    path = f"file://{tmp_path}/cache"
    entries = spark.createDataFrame([(1.0, 2.0, "b"), (1.0, 2.0, "a"), (3.0, 4.0, "c"), (None, 4.0, "x")], "lat_key DOUBLE, lon_key DOUBLE, location STRING")
    cache = CacheTable(spark, path, buckets=16)
    assert cache.append(entries, "one") and not cache.append(entries, "one")
    assert cache.append(entries.unionByName(entries.withColumn("lon_key", F.col("lon_key") + 1)), "two")
    assert cache.append(entries, "three")  # nothing new: no file holds a key twice
    cache.forget()
    again = CacheTable(spark, path)
    assert again.buckets == 16
    got = {(r.lat_e4 / 1e4, r.lon_e4 / 1e4): (r.location, r.batch) for r in again.entries().collect()}
    assert got == {(1.0, 2.0): ("a", "one"), (3.0, 4.0): ("c", "one"), (1.0, 3.0): ("a", "two"), (3.0, 5.0): ("c", "two")} and again.entries().count() == 4
    points = spark.createDataFrame([(1, 1.00001, 2.0), (2, 3.0, 4.0), (3, 9.0, 9.0), (4, None, 1.0)], "id INT, latitude DOUBLE, longitude DOUBLE")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert locate.lookup(points, again.read()).where("cached_location IS NOT NULL").count() == 2
        found = locate.lookup_stored(points, again)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r.id: r.cached_location for r in found.collect()} == {1: "a", 2: "c", 3: None, 4: None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # only the points are shuffled
    again.forget()
