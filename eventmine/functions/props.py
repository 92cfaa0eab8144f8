"""JSON ``props`` text to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROPS_SCHEMA = "k INT"


def parse_props(events: DataFrame, col: str = "props", schema: str = PROPS_SCHEMA,
                prefix: str = "") -> DataFrame:
    """Add one typed column per field of ``schema``. Malformed text, a missing
    field or a value of another type gives NULL (PERMISSIVE mode)."""
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    names = [f.strip().split()[0] for f in schema.split(",")]
    return events.select("*", *[parsed[n].alias(prefix + n) for n in names])


def props_quality(events: DataFrame, col: str = "props", field: str = "k",
                  schema: str = PROPS_SCHEMA) -> DataFrame:
    """One-row count of how the parse went: rows, NULL text, text that is not
    a JSON object, and objects without a usable ``field``. One pass, partial
    aggregation only."""
    txt = F.col(col)
    parsed = F.from_json(txt, schema, {"mode": "PERMISSIVE"})
    is_obj = F.from_json(txt, "MAP<STRING,STRING>", {"mode": "PERMISSIVE"}).isNotNull()
    return events.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(txt.isNull()).alias("n_null"),
        F.count_if(txt.isNotNull() & ~is_obj).alias("n_malformed"),
        F.count_if(is_obj & parsed[field].isNull()).alias("n_missing"),
        F.count_if(parsed[field].isNotNull()).alias("n_parsed"),
    )
