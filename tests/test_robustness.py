"""Inputs on which rows or characters could get lost silently."""

import datetime
import decimal

import pytest
from brute import brute_force_knn
from pyspark.sql import functions as F

from tabwise import session
from tabwise.operators import learn, locate, prep
from tabwise.operators.knn import knn
from tabwise.operators.quantiles import exact_quantiles
from tabwise.operators.resample import smote
from tabwise.sources import (append_cache, import_json_cache, load_cache, load_params, load_split, read_table, save_params,
                             write_table)

CACHE = "lat_key DOUBLE, lon_key DOUBLE, location STRING"


def test_paths_may_be_uris(spark, tmp_path):
    cache = spark.createDataFrame([(1.0, 2.0, "A"), (3.0, 4.0, "B")], CACHE)
    path = str(tmp_path / "cache.parquet")
    append_cache(cache, f"file:{path}")
    assert load_cache(spark, path).count() == load_cache(spark, f"file:{path}").count() == 2
    with pytest.raises(FileNotFoundError):
        load_cache(spark, f"file:{path}-none")
    assert load_cache(spark, f"file:{path}-none", allow_missing=True).count() == 0
    save_params({"max_depth": 3}, f"file:{tmp_path}/p.json")
    assert load_params(f"file:{tmp_path}/p.json") == load_params(str(tmp_path / "p.json")) == {"max_depth": 3}
    with pytest.raises(FileNotFoundError):
        load_params(str(tmp_path / "none.json"), allow_missing=False)


def test_csv_text_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", now', 1.5), (2, "two\nlines\r\nand \r three", None), (3, "", 2.0), (4, None, 3.0), (5, "  spaces  ", 4.0), (6, "\\n \\", 5.0), (7, "'", 6.0)]
    df = spark.createDataFrame(rows, "id INT, t STRING, v DOUBLE")
    write_table(df, str(tmp_path / "t.csv"))
    back = read_table(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert dict(back.dtypes) == {"id": "int", "t": "string", "v": "double"}
    assert sorted(map(tuple, back.collect())) == rows


def test_cache_holds_one_row_per_key(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    entries = spark.createDataFrame([(1.0, 2.0, "B"), (1.0, 2.0, "A"), (None, 2.0, "x")], CACHE)
    append_cache(entries, path)
    append_cache(entries, path)
    assert [tuple(r) for r in load_cache(spark, path).collect()] == [(1.0, 2.0, "A")]
    twice = entries.unionByName(entries)
    points = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 9.0, 9.0)], "id INT, latitude DOUBLE, longitude DOUBLE")
    assert sorted((r.id, r.cached_location) for r in locate.lookup(points, twice).collect()) == [(1, "A"), (2, None), (3, None)]
    assert sorted((r.id, r.location) for r in locate.enrich_location(points, twice).collect()) == [(1, "A"), (2, "Unknown"), (3, None)]


def test_cache_import_survives_bad_keys(spark):
    raw = spark.createDataFrame([('{"(1.0, 2.0)": "A", "(nan, 105.0)": "B", "(1e, 2)": "C", "x": "D"}',), ('{"(1.0, 2.0)": "Z"}',), (None,)], "value STRING")
    assert [tuple(r) for r in import_json_cache(raw).collect()] == [(1.0, 2.0, "A")]


def test_constants_keep_every_character_and_type(spark):
    big, day, moment = 2**60 + 1, datetime.date(2020, 2, 29), datetime.datetime(2020, 1, 2, 3, 4, 5, 678)
    values = ["a\\nb'`\"é\n", big, day, moment, True, decimal.Decimal("12.340")]
    schema = "`a.b` STRING, i BIGINT, d DATE, t TIMESTAMP_NTZ, f BOOLEAN, m DECIMAL(10, 3)"
    df = spark.createDataFrame([tuple(values), tuple(values), tuple([None] * 6)], schema)
    spec = prep.PrepSpec([], ["a.b", "i", "d", "t", "f", "m"], None, None)
    out = prep.fit_prep(df, spec).transform(df)
    assert [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    assert {tuple(r) for r in out.collect()} == {tuple(values)}


def test_split_load_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), "train"), (1.0, "train"), (float("nan"), "test")], "x DOUBLE, split STRING")
    df.write.parquet(str(tmp_path / "s"))
    train, test = load_split(spark, str(tmp_path / "s"))
    assert train.where("x IS NULL").count() == 1 and test.where("x IS NULL").count() == 1


def test_null_group_has_neighbours(spark):
    rows = [("a" if i % 4 else None, i, float(i * i % 17), float(i % 5)) for i in range(40)]
    for kind, conv in (("STRING", lambda g: g), ("INT", lambda g: None if g is None else 7)):
        df = spark.createDataFrame([(conv(g), i, x, y) for g, i, x, y in rows], f"g {kind}, id LONG, x DOUBLE, y DOUBLE")
        got = {}
        for r in knn(df, "id", ["x", "y"], 2, "g", block_rows=8).collect():
            got.setdefault(r.qid, []).append((r["rank"], r.nid))
        want = brute_force_knn([(g, i, (x, y)) for g, i, x, y in rows], 2)
        assert {q: [n for _, n in sorted(v)] for q, v in got.items()} == want


def test_tiny_class_is_an_error(spark):
    df = spark.createDataFrame([(i, 0 if i < 10 else 1 if i < 11 else 2, float(i)) for i in range(21)], "id LONG, y INT, x DOUBLE")
    with pytest.raises(ValueError, match="class 1 has 1 rows"):
        smote(df, "id", "y", ["x"])


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(101)], "`a.b` DOUBLE, `c``d` INT")
    got = {(r.column_name, r.p): r.value for r in exact_quantiles(df, ["a.b", "c`d"], [0.0, 0.25, 0.999, 1.0]).collect()}
    assert got[("a.b", 0.25)] == got[("c`d", 0.25)] == 25.0 and got[("a.b", 1.0)] == 100.0 and got[("a.b", 0.999)] == pytest.approx(99.9)


def test_shared_folder_is_needed_beyond_local_masters(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return type("C", (), {"get": lambda self, k, d=None: d})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, k, d=None: d})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_deep_trees_are_an_error():
    with pytest.raises(ValueError, match="30"):
        learn.spark_params("rf", {"max_depth": 31})
