import pytest
from pyspark.sql import functions as F

from eventmine.functions.props import parse_props, props_quality
from eventmine.sources.tables import SchemaMismatch, check_schema, read_table, SCHEMAS

from support import SF001


def test_read_table_checks_schema(spark):
    df = read_table(spark, SF001, "events")
    assert df.count() == 1000
    bad = df.drop("value")
    with pytest.raises(SchemaMismatch, match="missing column value"):
        check_schema(bad, SCHEMAS["events"], "events")
    retyped = df.withColumn("user_id", F.col("user_id").cast("string"))
    with pytest.raises(SchemaMismatch, match="user_id"):
        check_schema(retyped, SCHEMAS["events"], "events")


def test_parse_props_malformed_empty_null(spark):
    df = spark.createDataFrame(
        [(1, '{"k": 5}'), (2, '{"k": "x"}'), (3, "not json"), (4, ""), (5, None), (6, '{"j": 1}')],
        "id long, props string")
    got = {r.id: r.k for r in parse_props(df).collect()}
    assert got == {1: 5, 2: None, 3: None, 4: None, 5: None, 6: None}
    q = props_quality(df).first().asDict()
    assert q["n_rows"] == 6 and q["n_null"] == 1 and q["n_parsed"] == 1
    assert q["n_malformed"] == 2  # "not json" and ""
    assert q["n_missing"] == 2    # wrong type, absent key
