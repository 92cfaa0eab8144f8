"""Table sources (P01): read a parquet table and hold it to its declared schema.

The schema is compared after the read instead of being handed to the reader:
a reader given a schema turns a column the files lack into NULLs silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
}


class SchemaMismatch(ValueError):
    pass


def check_schema(df: DataFrame, expected: T.StructType, name: str = "table",
                 allow_extra: bool = True) -> DataFrame:
    """Raise if a declared column is missing or has another type."""
    got = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for f in expected.fields:
        if f.name not in got:
            problems.append(f"missing column {f.name}")
        elif got[f.name] != f.dataType:
            problems.append(f"{f.name}: expected {f.dataType.simpleString()}, "
                            f"found {got[f.name].simpleString()}")
    if not allow_extra:
        extra = set(got) - {f.name for f in expected.fields}
        problems += [f"unexpected column {c}" for c in sorted(extra)]
    if problems:
        raise SchemaMismatch(f"{name}: " + "; ".join(problems))
    return df


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base: str, name: str, check: bool = True) -> DataFrame:
    """P01. Read ``<base>/<name>.parquet`` and verify it against ``SCHEMAS``."""
    df = spark.read.parquet(table_path(base, name))
    if check and name in SCHEMAS:
        check_schema(df, SCHEMAS[name], name)
    return df
