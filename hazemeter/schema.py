"""Table shapes, as Spark DDL."""

_READING = (
    "STRUCT<timestamp: STRUCT<seconds: BIGINT, nanos: INT>, "
    "latitude: FLOAT, longitude: FLOAT, p1: FLOAT, p2: FLOAT>"
)

BATCH = f"seq_id BIGINT, last BOOLEAN, current ARRAY<{_READING}>, lastyear ARRAY<{_READING}>"

LOCATION = (
    "zipcode STRING, city STRING, qkm DOUBLE, population INT, "
    "polygons ARRAY<STRUCT<points: ARRAY<STRUCT<longitude: DOUBLE, latitude: DOUBLE>>>>"
)

READING = (
    "seq BIGINT, pos BIGINT, city STRING, period STRING, ts_ms BIGINT, "
    "p1 DOUBLE, p2 DOUBLE, lat FLOAT, lon FLOAT"
)

PROBE = "seq BIGINT, wm BIGINT, city STRING, period STRING"

AQI24 = (
    "seq BIGINT, city STRING, period STRING, ts_ms BIGINT, "
    "aqi INT, aqi_p1 INT, aqi_p2 INT, is_probe BOOLEAN"
)

AQI5D = (
    "seq BIGINT, city STRING, period STRING, ts_ms BIGINT, "
    "aqi DOUBLE, aqi_p1 INT, aqi_p2 INT"
)

STREAK = "seq BIGINT, city STRING, ts_last BIGINT, good_since BIGINT"

Q1 = (
    "batch_seq_id BIGINT, position INT, city STRING, avg_improvement INT, current_p1 INT, current_p2 INT"
)

Q2 = "batch_seq_id BIGINT, bucket_from INT, bucket_to INT, bucket_percent INT"

CURRENT = "current"
LAST_YEAR = "lastyear"
