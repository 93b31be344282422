"""Fixed schemas of the canonical tables; nothing is inferred."""

from pyspark.sql import types as T

#: Sample metrics, in column order; heart rate is the only integer.
METRICS = ("altitude", "speed", "watts", "temperature", "cadence", "power", "heart_rate",
           "enhanced_altitude", "enhanced_speed", "position_lat", "position_long")

SESSION_FIELDS = {
    "sport": T.StringType(), "sub_sport": T.StringType(), "timestamp": T.TimestampNTZType(),
    "total_elapsed_time": T.DoubleType(), "avg_heart_rate": T.DoubleType(),
    "total_distance": T.DoubleType(), "total_calories": T.DoubleType(),
}


def metric_type(name: str) -> T.DataType:
    return T.IntegerType() if name == "heart_rate" else T.DoubleType()


SESSIONS = T.StructType([
    T.StructField("name", T.StringType(), False), T.StructField("seq", T.IntegerType(), False),
    *[T.StructField(k, t) for k, t in SESSION_FIELDS.items()],
    T.StructField("present", T.ArrayType(T.StringType()))])

RECORDS = T.StructType([
    T.StructField("name", T.StringType(), False), T.StructField("idx", T.IntegerType(), False),
    T.StructField("timestamp", T.TimestampNTZType()), *[T.StructField(m, metric_type(m)) for m in METRICS],
    T.StructField("present", T.ArrayType(T.StringType()))])

METRIC_COLUMNS = ("date", "trimp", "atl", "ctl", "tsb", "status")
SUMMARY_COLUMNS = ("name", "activity_type", "sub_sport", "timestamp", "duration_min", "avg_heart_rate", "trimp")
ACTIVITY_COLUMNS = (
    "name", "activity_type", "sub_sport", "timestamp", "duration_min", "avg_heart_rate", "altitude", "speed", "watts",
    "distance", "calories", "temperature", "cadence", "power", "heart_rate", "enhanced_altitude", "enhanced_speed",
    "position_lat", "position_long", "trimp")
