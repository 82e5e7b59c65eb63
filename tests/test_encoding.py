import pytest

from tabwise.operators.encode import encode, inspect_encoder


def test_ordinal_codes_nulls_and_unseen(spark):
    train = spark.createDataFrame([("red", "S"), ("blue", "M"), ("green", "L"), (None, "S")], "color STRING, size STRING")
    test = spark.createDataFrame([("blue", "L"), ("yellow", "M")], "color STRING, size STRING")
    tr, te, mapping = encode(train, ["color", "size"], test)
    assert [r.color for r in tr.collect()] == [2.0, 0.0, 1.0, 3.0]
    assert sorted(r.color for r in te.collect()) == [-1.0, 0.0]
    assert tr.where("color IS NULL").count() == 0
    assert [(r.category, r.code) for r in inspect_encoder(mapping, "size").collect()] == [
        ("L", 0.0), ("M", 1.0), ("S", 2.0)]


def test_only_ordinal(spark):
    df = spark.createDataFrame([("a",)], "c STRING")
    with pytest.raises(ValueError):
        encode(df, ["c"], method="label")
