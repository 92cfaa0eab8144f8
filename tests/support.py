"""What several test modules share."""

import datetime as dt

from pyspark.sql import types as T

from eventmine.sources.tables import SCHEMAS

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
T0 = dt.datetime(2024, 1, 1)
NTZ = T.TimestampNTZType()


def ts(minutes=0.0, micros=0, days=0, hours=0.0):
    return T0 + dt.timedelta(days=days, hours=hours, minutes=minutes, microseconds=micros)


def make_events(spark, rows):
    """rows: (event_id, ts, user_id, event_type[, value[, props]])"""
    full = []
    for r in rows:
        r = list(r)
        if len(r) < 5:
            r.append(1.0)
        if len(r) < 6:
            r.append('{"k": 1}')
        full.append(tuple(r))
    return spark.createDataFrame(full, SCHEMAS["events"])
