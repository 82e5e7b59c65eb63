import pytest

from tabwise.operators.clean import count_sources, count_sources_scoring


def _df(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, sources STRING")


def test_column_not_found(spark):
    with pytest.raises(ValueError, match="invalid_column"):
        count_sources(_df(spark, ["a"]), "invalid_column")


def test_counting_sources(spark):
    df = _df(spark, ["source1, source2", "source3", "", None, "source1, source2, source3"])
    out = count_sources(df, "sources")
    assert out.columns == ["i", "source_counter"]
    assert [r.source_counter for r in out.orderBy("i").collect()] == [2, 1, 0, 0, 3]


def test_quotes_and_unicode_whitespace(spark):
    df = _df(spark, ["'us,ak,at'", "''", " , ,", "a, b　,", "x,\x0b,y"])
    out = [r.source_counter for r in count_sources(df, "sources").orderBy("i").collect()]
    assert out == [3, 0, 0, 2, 2]


def test_scoring_variant_blank_is_missing(spark):
    df = _df(spark, ["ax,us", "   ", None, "a,,b"])
    out = [r.source_counter for r in count_sources_scoring(df, "sources").orderBy("i").collect()]
    assert out == [2, None, None, 2]
