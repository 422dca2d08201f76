"""Fixtures written as literals, and small conversions."""

import datetime as dt

SAMPLE = """timestamp,flow,level,power
2024-06-03 08:00:00,4.1,210,1.30
2024-06-03 08:05:00,4.4,212,1.28
2024-06-03 08:10:00,4.0,215,1.35
2024-06-03 08:15:00,4.7,,1.31
2024-06-03 08:20:00,5.2,219,1.40
2024-06-03 08:25:00,n/a,220,1.38
2024-06-03 08:30:00,4.9,224,1.33
2024-06-03 08:35:00,5.0,221,
,5.1,223,1.36
2024-06-03 08:45:00,4.6,226,1.29
2024-06-03 08:50:00,4.3,229,1.45
2024-06-03 08:55:00,31.0,231,1.37
2024-06-03 09:00:00,4.8,230,1.34
2024-06-03 09:05:00,4.2,233,1.32
2024-06-03 09:10:00,5.3,236,1.41
2024-06-03 09:15:00,4.5,238,1.39
2024-06-03 09:20:00,4.0,237,1.27
2024-06-03 09:25:00,4.6,240,1.43
"""

READING_SCHEMA = "batch_id STRING, row_number BIGINT, ts TIMESTAMP_NTZ, sensor STRING, value DOUBLE"
START = dt.datetime(2025, 1, 1)


def minute(n: int) -> dt.datetime:
    return START + dt.timedelta(minutes=n)


def lines_frame(spark, files: dict[str, str]):
    """Numbered lines of several files given as text."""
    rows = [
        (name, i, line)
        for name, text in files.items()
        for i, line in enumerate(text.splitlines(), start=1)
    ]
    return spark.createDataFrame(rows, "batch_id STRING, row_number BIGINT, line STRING")


def series_frame(spark, series: dict[tuple[str, str], list]):
    """Readings of several series, one value per minute."""
    rows = [
        (batch, i + 2, minute(i), sensor, value)
        for (batch, sensor), values in series.items()
        for i, value in enumerate(values)
    ]
    return spark.createDataFrame(rows, READING_SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
