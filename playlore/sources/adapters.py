"""Plays, shows, vectors and snapshots derived from the star-schema and event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlore.functions.shared import exists, file_system, new_folder, stored
from playlore.schema import TRACK_PREFIX

#: The clock of questions that depend on it.
HISTORY_AS_OF = "2001-12-31 12:00:00"
EVENTS_AS_OF = "2024-01-31 12:00:00"


#: Raw platforms, by the number that an order's priority begins with.
PLATFORMS = ("Windows 10 (10.0.19041; x64)", "iOS 14.8.1 (iPhone11,6)", "Android OS 11", "OS X 12.6", "web_player")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}
_made_from: dict[tuple[str, str, str], tuple] = {}


def _as_it_is(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and times of the files in a folder of tables, so that changed tables are told from those before."""
    system, path = file_system(spark, sf_dir)
    found = []
    for status in system.listStatus(path):
        inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in inside]
    return tuple(sorted(found))


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], DataFrame]) -> DataFrame:
    """What ``make`` writes to the path it is given: made once in each session, and again if the files are gone or the tables changed."""
    key, now = (spark.sparkContext.applicationId, sf_dir, name), _as_it_is(spark, sf_dir)
    if key not in _stored or _made_from[key] != now or not exists(spark, _stored[key][0]):
        path = new_folder(spark, name)
        _stored[key], _made_from[key] = (path, make(path)), now
    return _stored[key][1]


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``joined_history``, stored by year and read from there."""
    plays = lambda: joined_history(spark, sf_dir).withColumn("year", F.year("played_at"))
    return _once(spark, sf_dir, "plays", lambda path: stored(plays(), path, "year", ("user_id", "played_at")))


def joined_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of plays of twenty listeners: line items are plays, parts songs, suppliers artists."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(part, F.col("l_partkey") == part["p_partkey"]).join(supplier, F.col("l_suppkey") == supplier["s_suppkey"])
    minutes = (F.col("l_partkey") % 24) * 60 + 7 * F.col("l_linenumber")
    return joined.select(
        (F.col("o_custkey") % 20).alias("user_id"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))).alias("played_at"),
        F.concat(F.lit(TRACK_PREFIX), F.col("l_partkey").cast("string")).alias("track_uri"),
        F.col("p_name").alias("track_name"),
        F.col("s_name").alias("artist_name"),
        F.col("p_brand").alias("album_name"),
        (F.col("l_quantity") * 8000).cast("long").alias("ms_played"),
        F.element_at(F.array(*[F.lit(x) for x in PLATFORMS]), F.substring("o_orderpriority", 1, 1).cast("int")).alias("platform"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("skipped"),
        F.lit("export").alias("source"),
    )


HISTORY_SQL = f"""
    SELECT o_custkey % 20 AS user_id,
           CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST((l_partkey % 24) * 60 + 7 * l_linenumber AS BIGINT)) AS played_at,
           'track:' || l_partkey AS track_uri, p_name AS track_name, s_name AS artist_name, p_brand AS album_name,
           CAST(l_quantity * 8000 AS BIGINT) AS ms_played, list_extract({list(PLATFORMS)}, CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS platform,
           CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false END AS skipped, 'export' AS source
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""


def genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist, genre, region): a genre is a region with the number of the supplier's nation; artists are lower case.

    Written once, as a lookup table is.
    """
    return _once(spark, sf_dir, "genres", lambda path: stored(_genres(spark, sf_dir), path))


def _genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.lower("s_name").alias("artist"), F.concat_ws(" ", F.lower("r_name"), F.col("n_nationkey").cast("string")).alias("genre"), F.lower("r_name").alias("region"))


GENRES_SQL = """
    SELECT lower(s_name) AS artist, lower(r_name) || ' ' || n_nationkey AS genre, lower(r_name) AS region
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of plays of five listeners from events, with new, renamed and joint acts."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    user = F.col("user_id") % 5
    late = F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")
    k = F.col("k").cast("string")
    artist = (
        F.when((F.col("k") >= 90) & late, F.concat(F.lit("Fresh "), k))
        .when((F.col("k") >= 85) & (F.col("k") < 90) & late, F.concat(F.lit("Renamed "), k))
        .when(F.col("k") % 7 == 0, F.concat(F.lit("Artist "), k, F.lit(", Artist "), (F.col("k") + 1).cast("string")))
        .otherwise(F.concat(F.lit("Artist "), k))
    )
    title = F.concat(F.when((F.col("k") >= 90) & late, "new ").otherwise(""), F.col("event_type"), F.lit(" "), k)
    return e.select(
        user.alias("user_id"),
        F.col("ts").cast("timestamp_ntz").alias("played_at"),
        F.concat(F.lit(TRACK_PREFIX), title).alias("track_uri"),
        title.alias("track_name"),
        artist.alias("artist_name"),
        F.col("event_type").alias("album_name"),
        (F.col("value") * 4000).cast("long").alias("ms_played"),
        F.lit("web").alias("platform"),
        F.lit(None).cast("boolean").alias("skipped"),
        F.lit("live").alias("source"),
    )


RECENT_SQL = """
    SELECT u AS user_id, ts AS played_at, 'track:' || title AS track_uri, title AS track_name,
           CASE WHEN k >= 90 AND late THEN 'Fresh ' || k WHEN k >= 85 AND k < 90 AND late THEN 'Renamed ' || k
                WHEN k % 7 = 0 THEN 'Artist ' || k || ', Artist ' || (k + 1) ELSE 'Artist ' || k END AS artist_name,
           event_type AS album_name, CAST(trunc(value * 4000) AS BIGINT) AS ms_played, 'web' AS platform,
           CAST(NULL AS BOOLEAN) AS skipped, 'live' AS source
    FROM (SELECT *, ts >= TIMESTAMP '2024-01-24' AS late,
                 CASE WHEN k >= 90 AND ts >= TIMESTAMP '2024-01-24' THEN 'new ' ELSE '' END || event_type || ' ' || k AS title
          FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, user_id % 5 AS u, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k FROM events))"""


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The history as three overlapping sources: an export, an account file, captured plays."""
    plays = history(spark, sf_dir)
    day = F.year("played_at")
    return {
        "export": plays.filter(day <= 1998).withColumn("source", F.lit("export")),
        "account": plays.filter((day >= 1998) & (day <= 2000)).select("user_id", F.date_trunc("minute", "played_at").cast("timestamp_ntz").alias("played_at"), "track_name", "artist_name", "ms_played").withColumn("source", F.lit("account")),
        "live": plays.filter(day >= 2000).select("user_id", "played_at", "track_uri", "track_name", "artist_name", "album_name", "ms_played").withColumn("source", F.lit("live")),
    }


SOURCES_SQL = f"""
    plays AS ({HISTORY_SQL}),
    export AS (SELECT * FROM plays WHERE year(played_at) <= 1998),
    account AS (SELECT user_id, date_trunc('minute', played_at) AS played_at, track_name, artist_name, ms_played FROM plays WHERE year(played_at) BETWEEN 1998 AND 2000),
    live AS (SELECT user_id, played_at, track_uri, track_name, artist_name, album_name, ms_played FROM plays WHERE year(played_at) >= 2000)"""


def shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist, date, distance_mi, fans): each supplier's first order day of every month."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    first = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", F.trunc("day", "month")).agg(F.min("day").alias("date"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return first.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("artist"),
        "date",
        F.when(F.col("s_suppkey") % 9 != 0, (F.abs("s_acctbal") % 120).cast("double")).alias("distance_mi"),
        F.when(F.col("s_suppkey") % 4 != 0, F.abs(F.col("s_acctbal") * 10).cast("long")).alias("fans"),
    )


SHOWS_SQL = """
    SELECT s_name AS artist, date,
           CASE WHEN s_suppkey % 9 <> 0 THEN abs(s_acctbal) % 120 END AS distance_mi,
           CASE WHEN s_suppkey % 4 <> 0 THEN CAST(trunc(abs(s_acctbal * 10)) AS BIGINT) END AS fans
    FROM (SELECT l_suppkey, min(CAST(o_orderdate AS DATE)) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          GROUP BY l_suppkey, date_trunc('month', CAST(o_orderdate AS DATE))) JOIN supplier ON l_suppkey = s_suppkey"""


def space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist, region, z): unit vectors, for which a label is a region."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return e.select(F.col("vec_id").alias("artist"), F.col("label").alias("region"), F.transform("v", lambda x: x / norm).alias("z"))


SPACE_SQL = """
    SELECT vec_id AS artist, label AS region,
           list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS z
    FROM embeddings"""
