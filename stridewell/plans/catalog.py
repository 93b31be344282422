"""Queries of the training-load engine over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring as S
from ..operators import activities as A
from ..operators import load as L
from ..operators import messages, validate, weights
from ..schemas import METRICS
from ..scratch import fresh_path
from ..sources import exports, fit
from .. import sinks
from . import standin, views
from .store import MetricsStore

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f
    return add


ACTIVITIES = """
WITH RECURSIVE raw AS (
  SELECT event_id, user_id AS athlete_id, 'e' || event_id || '.fit' AS name, ts, value * 60.0::DOUBLE AS elapsed,
         CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'cycling' WHEN 'purchase' THEN 'swimming' ELSE 'generic' END AS sport,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS hr
  FROM events
), a AS (
  SELECT event_id, athlete_id, name, sport AS activity_type, CAST(NULL AS VARCHAR) AS sub_sport, ts AS timestamp, elapsed / 60.0::DOUBLE AS duration_min, hr AS avg_heart_rate,
         elapsed / 60.0::DOUBLE * CASE WHEN hr IS NULL OR hr = 0 THEN 1.0::DOUBLE ELSE hr / 100.0::DOUBLE END
         * CASE sport WHEN 'running' THEN 1.2::DOUBLE WHEN 'cycling' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS trimp
  FROM raw WHERE sport <> 'generic'
)"""

DAILY = ACTIVITIES + """, daily AS (
  SELECT athlete_id, CAST(timestamp AS DATE) AS date, sum(trimp) AS trimp FROM a WHERE timestamp IS NOT NULL GROUP BY ALL
)"""

DENSE = """, bounds AS (
  SELECT athlete_id, min(date) AS lo, max(date) AS hi FROM daily GROUP BY ALL
), spine AS (
  SELECT athlete_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds
), dense AS (
  SELECT s.athlete_id, s.date, coalesce(d.trimp, 0.0::DOUBLE) AS trimp,
         row_number() OVER (PARTITION BY s.athlete_id ORDER BY s.date) AS n
  FROM spine s LEFT JOIN daily d ON s.athlete_id = d.athlete_id AND s.date = d.date
)"""

MEANS = """, ewm AS (
  SELECT athlete_id, date, n, trimp, trimp AS atl, trimp AS ctl FROM dense WHERE n = 1
  UNION ALL
  SELECT d.athlete_id, d.date, d.n, d.trimp,
         (1 - 2.0::DOUBLE / 8) * e.atl + 2.0::DOUBLE / 8 * d.trimp, (1 - 2.0::DOUBLE / 43) * e.ctl + 2.0::DOUBLE / 43 * d.trimp
  FROM ewm e JOIN dense d ON d.athlete_id = e.athlete_id AND d.n = e.n + 1
), metrics AS (
  SELECT athlete_id, date, trimp, atl, ctl, ctl - atl AS tsb FROM ewm
)"""

ZONE = """CASE WHEN tsb > 25 THEN 'Transition (Fitness Loss)' WHEN tsb > 5 THEN 'Freshness (Tapering/Race)' WHEN tsb >= -10 THEN 'Neutral'
  WHEN tsb >= -30 THEN 'Optimal Training' ELSE 'High Risk (Overreaching)' END"""


#: Means of loads with few decimals end in exact halves, which the last bit of a
#: sum rounds either way: both sides are shifted off them before rounding.
NUDGE = 1e-9


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    nudge = F.lit(NUDGE)
    return df.withColumns({c: F.round(F.col(c) + nudge if c in ("atl", "ctl", "tsb") else F.col(c), digits) for c in columns})


@query(ACTIVITIES + " SELECT event_id, round(trimp, 6) AS trimp FROM a")
def trimp_per_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(standin.activities(spark, sf_dir).select("event_id", "trimp"), "trimp")


@query(DAILY + " SELECT athlete_id, date, round(trimp, 6) AS trimp FROM daily")
def daily_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.daily_load(standin.activities(spark, sf_dir)), "trimp")


@query(DAILY + " SELECT athlete_id, min(date) AS first_date, max(date) AS last_date FROM daily GROUP BY ALL")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.date_bounds(L.daily_load(standin.activities(spark, sf_dir)))


@query(DAILY + DENSE + " SELECT athlete_id, date, round(trimp, 6) AS trimp FROM dense")
def dense_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.dense_daily(L.daily_load(standin.activities(spark, sf_dir))), "trimp")


@query(DAILY + DENSE + MEANS + " SELECT athlete_id, date, round(trimp, 6) AS trimp, round(atl + 1e-9, 6) AS atl, round(ctl + 1e-9, 6) AS ctl FROM metrics")
def atl_ctl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.atl_ctl(L.daily_load(standin.activities(spark, sf_dir))), "trimp", "atl", "ctl")


METRICS_SELECT = f" SELECT athlete_id, date, round(trimp, 6) AS trimp, round(atl + 1e-9, 6) AS atl, round(ctl + 1e-9, 6) AS ctl, round(tsb + 1e-9, 6) AS tsb, {ZONE} AS status FROM metrics"


@query(DAILY + DENSE + MEANS + METRICS_SELECT)
def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.training_metrics(standin.activities(spark, sf_dir)), "trimp", "atl", "ctl", "tsb")


@query("WITH RECURSIVE daily AS (SELECT 0 AS athlete_id, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS trimp FROM orders GROUP BY ALL)"
       + DENSE + MEANS + METRICS_SELECT.replace("athlete_id, date", "date", 1).replace(", 6)", ", 4)"))
def training_metrics_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = standin.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("trimp"))
    return rounded(L.training_metrics(one, ()), "trimp", "atl", "ctl", "tsb", digits=4)


@query(f"SELECT event_id, tsb, {ZONE} AS status FROM (SELECT event_id, (event_id * 7 % 321 - 160) / 4.0::DOUBLE AS tsb FROM events)")
def zone_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of events whose balance is on a grid that has every bound."""
    grid = standin.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 7 % 321 - 160) / 4.0).alias("tsb"))
    return grid.withColumn("status", S.zone(F.col("tsb")))


@query(DAILY + DENSE + MEANS + METRICS_SELECT + " QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC) = 1")
def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.latest(L.training_metrics(standin.activities(spark, sf_dir))), "trimp", "atl", "ctl", "tsb")


SUMMARY = " SELECT name, activity_type, sub_sport, timestamp, round(duration_min, 6) AS duration_min, avg_heart_rate, round(trimp, 6) AS trimp FROM a"


@query(ACTIVITIES + SUMMARY)
def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.summary(standin.activities(spark, sf_dir)), "duration_min", "trimp")


@query(ACTIVITIES + SUMMARY + " WHERE name = 'e100.fit'")
def single_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.summary(views.single_activity(standin.activities(spark, sf_dir), "e100.fit")), "duration_min", "trimp")


@query(ACTIVITIES + SUMMARY + " ORDER BY timestamp DESC NULLS LAST, name LIMIT 3")
def recent_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.summary(views.recent(standin.activities(spark, sf_dir))), "duration_min", "trimp")


@query("SELECT CAST(conv_id AS VARCHAR) AS name, arg_max(role, turn) AS sport, arg_max(text, turn) FILTER (role = 'assistant') AS sub_sport FROM conversations GROUP BY ALL")
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as session messages: the last role, and the last text that an answer carries."""
    turns = standin.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("name"), F.col("turn").alias("seq"), F.col("role").alias("sport"), F.col("text").alias("sub_sport"),
        F.when(F.col("role") == "assistant", F.array(F.lit("sport"), F.lit("sub_sport"))).otherwise(F.array(F.lit("sport"))).alias("present"))
    return A.fold_sessions(turns, ("sport", "sub_sport")).drop("keys")


@query("""SELECT CAST(user_id AS VARCHAR) AS name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
       nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS power FROM events""")
def sample_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = A.sample_arrays(standin.samples(spark, sf_dir), ("power",))
    return arrays.select("name", F.posexplode("power").alias("idx", "power"))


@query("""SELECT CAST(user_id AS VARCHAR) AS name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
       nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS power FROM events""")
def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arrays in pieces of bounded length."""
    pieces = A.sample_chunks(standin.samples(spark, sf_dir), ("power",), 16)
    return pieces.select("name", "chunk", F.posexplode("power").alias("at", "power")).select("name", (F.col("chunk") * 16 + F.col("at")).cast("int").alias("idx"), "power")


@query("""SELECT CAST(user_id AS VARCHAR) AS name, event_id AS idx, round(event_id * 1000.0::DOUBLE * (180.0::DOUBLE / 2147483648), 9) AS lat,
       round(event_id * -500.0::DOUBLE * (180.0::DOUBLE / 2147483648), 9) AS lon FROM events WHERE event_id % 10 <> 0 AND event_id % 7 <> 0""")
def gps_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gps_track(standin.tracks(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("lat", "lon")})


@query("""SELECT CAST(user_id AS VARCHAR) AS name, event_id AS idx, round((CASE WHEN user_id % 2 = 1 THEN value + 1 ELSE value END) * 3.6::DOUBLE, 6) AS speed_kmh
       FROM events WHERE user_id % 2 = 0 OR event_id % 10 <> 0""")
def speed_kmh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.speed_kmh(standin.tracks(spark, sf_dir)), "speed_kmh")


@query("""SELECT CAST(user_id AS VARCHAR) AS name, event_id AS idx, round(CASE WHEN user_id % 2 = 0 THEN value * 2 WHEN event_id % 10 <> 0 THEN value * 3 END, 6) AS elevation FROM events""")
def column_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.elevation(standin.tracks(spark, sf_dir)), "elevation")


@query("SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, coalesce(strftime(CASE WHEN event_id % 5 <> 0 THEN ts END, '%Y-%m-%d'), 'Unknown Date') AS shown FROM events")
def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.table(spark, sf_dir, "events").select(
        "event_id", S.iso_date(F.to_date("ts")).alias("day"), S.shown_date(F.when(F.col("event_id") % 5 != 0, F.col("ts"))).alias("shown"))


@query("""SELECT event_id, lpad(CAST(s // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
       FROM (SELECT event_id, CAST(floor(value * 20 * 60) AS BIGINT) AS s FROM events)""")
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.table(spark, sf_dir, "events").select("event_id", S.clock(F.col("value") * 20).alias("clock"))


@query("""SELECT event_id, coalesce(v, 0.0::DOUBLE) AS value, coalesce(CAST(CAST(round(v, 1) AS DECIMAL(18, 1)) AS VARCHAR), 'N/A') AS shown
       FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)""")
def null_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return standin.table(spark, sf_dir, "events").select("event_id", S.or_zero(v).alias("value"), S.shown(v, 1).alias("shown"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS heart_rate, TRY_CAST(event_type AS DOUBLE) AS speed, regexp_extract('in/put/' || event_type || '.fit', '[^/]*$') AS name FROM events")
def coerced_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("int").alias("heart_rate"), F.col("event_type").try_cast("double").alias("speed"),
        S.file_name(F.concat(F.lit("in/put/"), F.col("event_type"), F.lit(".fit"))).alias("name"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through one JSON array in one file and back."""
    rows, path = standin.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), fresh_path(spark) + ".json"
    sinks.write_json_file(rows, path)
    return exports.read_export(spark, path, rows.schema)


FILES = """
WITH m AS (
  SELECT 'o' || event_id // 4 || '.fit' AS name, event_id % 4 AS seq, event_id % 2 = 1 AS odd, user_id AS s, event_id * 7 AS p, floor(value) AS q, event_type AS mode, ts AS ship,
         CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'cycling' WHEN 'purchase' THEN 'swimming' ELSE 'rowing' END AS sport
  FROM events
), f AS (
  SELECT name, arg_max(sport, seq) AS activity_type, arg_max({'v': mode}, seq) FILTER (odd) AS mode, arg_max(ship, seq) AS ship,
         arg_max({'v': q * 60.0::DOUBLE}, seq) FILTER (s % 3 <> 0) AS elapsed, arg_max({'v': CASE WHEN odd THEN CAST(p % 200 AS DOUBLE) END}, seq) FILTER (s % 2 = 0) AS hr,
         arg_max(s, seq) AS s,
         CASE WHEN bool_or(s % 4 <> 0) THEN string_agg(CASE WHEN s % 4 <> 0 THEN CAST(CAST(q AS BIGINT) AS VARCHAR) ELSE '-' END, ',' ORDER BY seq) END AS power,
         CASE WHEN bool_or(p % 3 = 0) THEN string_agg(CASE WHEN p % 3 = 0 THEN CAST(p % 200 AS VARCHAR) ELSE '-' END, ',' ORDER BY seq) END AS heart_rate
  FROM m GROUP BY name
), act AS (
  SELECT name, activity_type, mode.v AS sub_sport, CAST(ship AS TIMESTAMP) AS timestamp,
         CASE WHEN elapsed IS NULL THEN 0.0::DOUBLE ELSE elapsed.v / 60.0::DOUBLE END AS duration_min,
         CASE WHEN hr IS NULL THEN 0.0::DOUBLE ELSE hr.v END AS avg_heart_rate, CAST(s AS DOUBLE) AS distance, CAST(NULL AS DOUBLE) AS calories, power, heart_rate
  FROM f WHERE activity_type <> 'rowing'
), scored AS (
  SELECT *, duration_min * CASE WHEN avg_heart_rate IS NULL OR avg_heart_rate = 0 THEN 1.0::DOUBLE ELSE avg_heart_rate / 100.0::DOUBLE END
         * CASE activity_type WHEN 'running' THEN 1.2::DOUBLE WHEN 'cycling' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS trimp
  FROM act
)"""


def file_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activities(standin.file_sessions(spark, sf_dir), standin.file_records(spark, sf_dir))


@query(FILES + " SELECT name, activity_type, sub_sport, timestamp, round(duration_min, 6) AS duration_min, avg_heart_rate, distance, calories, "
       + ", ".join(m if m in ("power", "heart_rate") else f"CAST(NULL AS VARCHAR) AS {m}" for m in METRICS) + ", round(trimp, 6) AS trimp FROM scored")
def activity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 20 columns; arrays as text, gaps as dashes."""
    text = {m: F.array_join(F.transform(m, lambda x: x.cast("bigint").cast("string")), ",", "-") for m in METRICS}
    return rounded(file_activities(spark, sf_dir).withColumns(text), "duration_min", "trimp")


@query(FILES + " SELECT name, activity_type, sub_sport, timestamp, round(duration_min, 6) AS duration_min, avg_heart_rate, round(trimp, 6) AS trimp FROM scored")
def analysis_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of an analysis."""
    return rounded(views.analysis(file_activities(spark, sf_dir)).activities, "duration_min", "trimp")


@query(FILES.replace("WITH m", "WITH RECURSIVE m") + """, daily AS (
  SELECT 0 AS athlete_id, CAST(timestamp AS DATE) AS date, coalesce(sum(trimp), 0) AS trimp FROM scored WHERE timestamp IS NOT NULL GROUP BY ALL
)""" + DENSE + MEANS + METRICS_SELECT.replace("athlete_id, date", "strftime(date, '%Y-%m-%d') AS date", 1))
def analysis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second part: metrics with dates as text."""
    return rounded(views.analysis(file_activities(spark, sf_dir)).metrics, "trimp", "atl", "ctl", "tsb")


EXPORTED = """SELECT CAST(event_id AS BIGINT) AS id, CASE WHEN event_id % 9 <> 0 THEN 'a "quoted" ride, ' || event_type END AS name, event_type AS type, strftime(ts, '%Y-%m-%d') AS start_date,
       value AS elapsed_time, value * 2 AS distance, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS average_heartrate FROM events"""


@query(EXPORTED)
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported activities through the sink of JSON lines and the reader."""
    path = fresh_path(spark)
    sinks.write_json(standin.exports(spark, sf_dir), path)
    return exports.read_export(spark, path, array=False)


@query(EXPORTED)
def export_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON arrays."""
    path = fresh_path(spark)
    sinks.write_json_array(standin.exports(spark, sf_dir), path)
    return exports.read_export(spark, path)


@query(EXPORTED)
def export_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service without a connection beside one with activities: it adds no rows."""
    return exports.no_activities(spark).unionByName(standin.exports(spark, sf_dir))


@query(DAILY + " SELECT athlete_id, date, round(trimp, 6) AS trimp FROM daily WHERE date >= DATE '2024-01-03'")
def stored_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily loads kept as a table by day; a later read takes only some days' files."""
    path = fresh_path(spark)
    sinks.write_table(rounded(L.daily_load(standin.activities(spark, sf_dir)), "trimp"), path, "date")
    return spark.read.parquet(path).where("date >= date'2024-01-03'").select("athlete_id", "date", "trimp")


@query(FILES + " SELECT activity_type, count(*) AS n, round(sum(trimp), 4) AS trimp FROM scored GROUP BY ALL")
def published_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published result read again by its name, and withdrawn."""
    name = "activities_" + fresh_path(spark)[-8:]
    kept = sinks.publish(file_activities(spark, sf_dir).select("activity_type", "trimp"), name)
    out = spark.table(name).groupBy("activity_type").agg(F.count("*").alias("n"), F.sum("trimp").alias("trimp"))
    path = fresh_path(spark)
    rounded(out, "trimp", digits=4).write.parquet(path)
    sinks.withdraw(kept, name)
    return spark.read.parquet(path)


FIT = """
WITH e AS (
  SELECT 'u' || user_id || '.fit' AS name, event_id AS i, event_type, date_trunc('second', ts) AS moment, value,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx FROM events
), s AS (
  SELECT name, arg_max(CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'cycling' WHEN 'purchase' THEN 'swimming' ELSE 'generic' END, idx) AS sport,
         max(moment) AS moment, arg_max(i % 7200 + 0.5::DOUBLE, idx) AS elapsed, CAST(arg_max(i, idx) AS DOUBLE) AS distance,
         arg_max({'v': CASE WHEN i % 2 = 0 THEN CAST(i % 200 AS DOUBLE) END}, idx) FILTER (i % 3 = 0) AS hr
  FROM e WHERE i % 5 = 0 GROUP BY name
)"""


def fit_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of FIT files, one per user, written from events."""
    path = fresh_path(spark)
    fit.register(spark)
    fit.write_fit(*standin.fit_messages(spark, sf_dir), path)
    return path


@query(FIT + """ SELECT name, idx, CAST(moment AS TIMESTAMP) AS timestamp, i % 500 / 8.0::DOUBLE AS speed, floor(value) AS power,
  CAST(CASE WHEN i % 3 = 0 AND i % 2 = 0 THEN i % 200 END AS DOUBLE) AS heart_rate, i % 3 = 0 AS has_rate FROM e""")
def fit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples through FIT files and back: encoded, with checksums, found and decoded."""
    r = fit.read_fit(spark, fit_files(spark, sf_dir), "record")
    return r.select("name", "idx", "timestamp", "speed", "power", F.col("heart_rate").cast("double").alias("heart_rate"), F.array_contains("present", "heart_rate").alias("has_rate"))


@query(FIT + """ SELECT name, sport AS activity_type, CAST(moment AS TIMESTAMP) AS timestamp, round(elapsed / 60, 6) AS duration_min,
  CASE WHEN hr IS NULL THEN 0.0::DOUBLE ELSE hr.v END AS avg_heart_rate, distance,
  round(elapsed / 60 * CASE WHEN hr IS NULL OR hr.v IS NULL OR hr.v = 0 THEN 1.0::DOUBLE ELSE hr.v / 100 END
        * CASE sport WHEN 'running' THEN 1.2::DOUBLE WHEN 'cycling' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END, 6) AS trimp FROM s WHERE sport <> 'generic'""")
def fit_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of FIT files, folded to activities."""
    a = A.activities(fit.read_fit(spark, fit_files(spark, sf_dir)))
    return rounded(a.select("name", "activity_type", "timestamp", "duration_min", "avg_heart_rate", "distance", "trimp"), "duration_min", "trimp")


@query(DAILY + DENSE + MEANS + METRICS_SELECT)
def refreshed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a store that took in three batches: half a month, what follows, and
    activities of both halves that came late."""
    kept = MetricsStore(spark, fresh_path(spark))
    acts, early, late = standin.activities(spark, sf_dir), F.col("timestamp") < "2024-01-16", F.col("event_id") % 7 == 0
    for i, which in enumerate((early & ~late, ~early & ~late, late)):
        kept.apply(acts.where(which), i)
    return rounded(kept.metrics(), "trimp", "atl", "ctl", "tsb")


@query(FIT + """ SELECT name, idx, i % 500 / 8.0::DOUBLE AS speed, CASE WHEN i % 4 = 0 THEN value END AS field_200 FROM e""")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of FIT files with a metric that no schema knows: the union of the keys
    makes it a column."""
    r = fit.read_fit(spark, fit_files(spark, sf_dir), "record", others=True)
    return messages.widen(r.select("name", "idx", "speed", "others"), "others")


ENTRIES = """
WITH e AS (
  SELECT event_id // 4 AS name, event_id AS i, event_type AS key, CASE WHEN event_id % 11 <> 0 THEN value END AS v, event_id % 3 = 0 AS of_sample FROM events
)"""


@query(ENTRIES + """ SELECT name, key, arg_max({'v': v}, (CASE WHEN of_sample THEN 1 ELSE 0 END, i)).v AS value FROM e GROUP BY ALL""")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions' keys and values as maps, of repeated keys the last; samples' maps win over them."""
    i = F.col("event_id")
    own = F.struct(i.alias("i"), F.struct(F.col("event_type").alias("key"), F.when(i % 11 != 0, F.col("value")).alias("value")).alias("e"))
    each = standin.table(spark, sf_dir, "events").groupBy(F.floor(i / 4).alias("name")).agg(
        *[F.array_sort(F.collect_list(F.when(test, own))).alias(n) for n, test in (("session", i % 3 != 0), ("sample", i % 3 == 0))])
    both = messages.merged(messages.last_wins(F.col("session.e")), messages.last_wins(F.col("sample.e")))
    return each.select("name", F.explode(both).alias("key", "value"))


@query(ENTRIES + """ SELECT name, key, arg_max({'v': v}, i).v AS value FROM e GROUP BY ALL""")
def map_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of several messages folded to one: each key's last value."""
    i = F.col("event_id")
    each = standin.table(spark, sf_dir, "events").select(F.floor(i / 4).alias("name"), i.alias("seq"), F.create_map("event_type", F.when(i % 11 != 0, F.col("value"))).alias("m"))
    return messages.fold_maps(each, "name", "seq", "m").select("name", F.explode("m").alias("key", "value"))


@query(ACTIVITIES.replace("WITH RECURSIVE", "WITH") + """, w AS (
  SELECT CASE event_type WHEN 'click' THEN 'running' ELSE 'cycling' END AS sport, CAST(ts AS DATE) AS valid_from, max(0.5 + event_id % 10 / 8.0::DOUBLE) AS weight
  FROM events WHERE event_id % 97 = 5 AND event_type IN ('click', 'view') GROUP BY ALL
) SELECT event_id, activity_type, (SELECT arg_max(weight, valid_from) FROM w WHERE sport = activity_type AND valid_from <= CAST(timestamp AS DATE)) AS weight FROM a""")
def changing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipliers of a sport that change with the day; some sports have none."""
    e = standin.table(spark, sf_dir, "events")
    table = e.where((F.col("event_id") % 97 == 5) & F.col("event_type").isin("click", "view")).select(
        F.when(F.col("event_type") == "click", "running").otherwise("cycling").alias("sport"), F.to_date("ts").alias("valid_from"),
        (F.lit(0.5) + F.col("event_id") % 10 / 8.0).alias("weight"))
    return weights.weigh(standin.activities(spark, sf_dir), table).select("event_id", "activity_type", "weight")


@query(ACTIVITIES.replace("WITH RECURSIVE", "WITH") + SUMMARY + " WHERE event_id % 101 = 0")
def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities of a look-up table, found by a list of names."""
    acts, path = standin.activities(spark, sf_dir), fresh_path(spark)
    table = f"activities_{path[-12:]}"
    sinks.write_lookup(views.summary(acts), table, path, "name")
    asked = acts.where("event_id % 101 = 0").select("name")
    return rounded(spark.table(table).join(asked, "name", "left_semi"), "duration_min", "trimp")


TYPED = """
WITH r AS (
  SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE json_extract_string(props, '$.k') END AS heart_rate,
         CASE event_id % 5 WHEN 0 THEN 'x' || event_id ELSE strftime(ts, '%Y-%m-%d') END AS day, CASE event_id % 6 WHEN 0 THEN NULL ELSE event_type END AS name FROM events
)"""


def typed_rows(spark: SparkSession, sf_dir: str) -> validate.Validated:
    i = F.col("event_id")
    rows = standin.table(spark, sf_dir, "events").select(
        "event_id", F.when(i % 7 == 0, "none").when(i % 7 != 1, F.get_json_object("props", "$.k")).alias("heart_rate"),
        F.when(i % 5 == 0, F.concat(F.lit("x"), i)).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"), F.when(i % 6 != 0, F.col("event_type")).alias("name"))
    return validate.validate(rows, T.StructType.fromDDL("event_id bigint, heart_rate int, day date, name string"), required=("name",))


@query(TYPED + " SELECT event_id, TRY_CAST(heart_rate AS INTEGER) AS heart_rate, CAST(day AS DATE) AS day, name FROM r WHERE event_id % 7 > 1 AND event_id % 5 <> 0 AND event_id % 6 <> 0")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have the declared types."""
    return typed_rows(spark, sf_dir).good.where("heart_rate is not null")


@query(TYPED + """ SELECT event_id, concat_ws('; ', CASE WHEN event_id % 7 = 0 THEN 'heart_rate: no int' END, CASE WHEN event_id % 5 = 0 THEN 'day: no date' END,
  CASE WHEN event_id % 6 = 0 THEN 'name: missing' END) AS reasons FROM r WHERE event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 6 = 0""")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that do not, with the reasons."""
    out = typed_rows(spark, sf_dir).rejects
    return out.select(F.get_json_object("row", "$.event_id").cast("bigint").alias("event_id"), F.array_join("reasons", "; ").alias("reasons"))


@query("""SELECT event_id, coalesce(CAST(CAST(round(v, 0) AS BIGINT) AS VARCHAR), 'N/A') AS shown
       FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 40 / 8.0::DOUBLE END AS v FROM events)""")
def shown_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers without decimals, halves up."""
    v = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 40 / 8.0)
    return standin.table(spark, sf_dir, "events").select("event_id", S.shown(v, 0).alias("shown"))


@query(DAILY.replace("FROM a WHERE timestamp IS NOT NULL", "FROM a WHERE athlete_id % 2 = 0") + DENSE + MEANS + METRICS_SELECT)
def undated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Athletes without a dated activity have no metrics."""
    acts = standin.activities(spark, sf_dir)
    return rounded(L.training_metrics(acts.withColumn("timestamp", F.when(F.col("athlete_id") % 2 == 0, F.col("timestamp")))), "trimp", "atl", "ctl", "tsb")


@query(ACTIVITIES.replace("WITH RECURSIVE", "WITH") + """ SELECT 'e' || event_id || '.fit' AS name, a.name IS NOT NULL AS found FROM events LEFT JOIN a USING (event_id) WHERE event_id % 211 = 0""")
def unknown_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the asked names there are activities of."""
    asked = standin.table(spark, sf_dir, "events").where("event_id % 211 = 0").select(F.concat(F.lit("e"), "event_id", F.lit(".fit")).alias("name"))
    return views.answered(standin.activities(spark, sf_dir), asked)
