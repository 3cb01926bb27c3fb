"""Reading plays from their sources, merging them, and storing captured days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from playlore import schema as S
from playlore.functions import expressions as X
from playlore.functions.shared import checkpointed, exists
from playlore.sources.store import DayStore

EXPORT = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("ms_played", T.LongType()),
        T.StructField("conn_country", T.StringType()),
        T.StructField("master_metadata_track_name", T.StringType()),
        T.StructField("master_metadata_album_artist_name", T.StringType()),
        T.StructField("master_metadata_album_album_name", T.StringType()),
        T.StructField("track_uri", T.StringType()),
        T.StructField("reason_start", T.StringType()),
        T.StructField("reason_end", T.StringType()),
        T.StructField("shuffle", T.BooleanType()),
        T.StructField("skipped", T.BooleanType()),
        T.StructField("offline", T.BooleanType()),
        T.StructField("incognito_mode", T.BooleanType()),
    ]
)
ACCOUNT = T.StructType([T.StructField(c, T.StringType()) for c in ("endTime", "artistName", "trackName")] + [T.StructField("msPlayed", T.LongType())])
RECENT = "array<struct<played_at:string,track:struct<uri:string,name:string,duration_ms:bigint,artists:array<struct<name:string>>,album:struct<name:string>>>>"


class IngestError(ValueError):
    """A load that must not replace what is there."""


def read_export(spark: SparkSession, path: str, user_id: int, uri_field: str = "track_uri") -> DataFrame:
    """Plays of an extended export: JSON arrays, one file for each task.

    Columns that a file lacks read as null; addresses and other fields are not read.  Rows
    without a track or a time are not plays.  A malformed file fails the load.
    """
    fields = T.StructType([T.StructField(uri_field, f.dataType) if f.name == "track_uri" else f for f in EXPORT.fields])
    raw = spark.read.schema(fields).option("multiLine", True).option("mode", "FAILFAST").json(path)
    at = F.to_timestamp_ntz(F.regexp_replace("ts", "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss "))
    rows = raw.select(
        F.lit(user_id).cast("long").alias("user_id"),
        at.alias("played_at"),
        F.col(uri_field).alias("track_uri"),
        F.col("master_metadata_track_name").alias("track_name"),
        F.col("master_metadata_album_artist_name").alias("artist_name"),
        F.col("master_metadata_album_album_name").alias("album_name"),
        "ms_played",
        "platform",
        "skipped",
        F.lit("export").alias("source"),
    )
    return rows.filter("track_uri IS NOT NULL AND played_at IS NOT NULL").withColumn("year", F.year("played_at"))


def read_account(spark: SparkSession, path: str, user_id: int) -> DataFrame:
    """Plays of an account file: four fields, times to the minute."""
    raw = spark.read.schema(ACCOUNT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.lit(user_id).cast("long").alias("user_id"), F.to_timestamp_ntz("endTime", F.lit("yyyy-MM-dd HH:mm")).alias("played_at"), F.col("trackName").alias("track_name"), F.col("artistName").alias("artist_name"), F.col("msPlayed").alias("ms_played")).filter("played_at IS NOT NULL")


def store_verified(plays: DataFrame, folder: str) -> dict:
    """Write plays by year beside the old ones, read them back, and only then name them current.

    Returns rows, kept, first and last.  The data go to ``folder/load=<n>``; the highest
    number that was verified is the current load, so an interrupted load changes nothing.
    """
    spark = plays.sparkSession
    music = plays.filter("track_name IS NOT NULL").limit(1).count()
    if not music:
        raise IngestError("no music in this load")
    expected = plays.count()
    number = _loads(spark, folder)
    path = f"{folder}/load={number + 1}"
    plays.withColumn("year", F.year("played_at")).write.partitionBy("year").option("compression", "zstd").parquet(path)
    seen = spark.read.parquet(path).agg(F.count("*").alias("kept"), F.min("played_at").alias("first"), F.max("played_at").alias("last")).first()
    if seen["kept"] != expected:
        raise IngestError(f"{expected} rows were written, {seen['kept']} read back")
    spark.createDataFrame([(number + 1,)], "load int").coalesce(1).write.mode("append").json(f"{folder}/verified")
    return {"rows": expected, **seen.asDict()}


def _loads(spark: SparkSession, folder: str) -> int:
    if not exists(spark, f"{folder}/verified"):
        return 0
    return spark.read.schema("load int").json(f"{folder}/verified").agg(F.max("load")).first()[0] or 0


def current_load(spark: SparkSession, folder: str) -> DataFrame:
    """The plays of the newest verified load; a filter on year prunes its folders."""
    number = _loads(spark, folder)
    if not number:
        raise IngestError(f"nothing was loaded to {folder}")
    return spark.read.parquet(f"{folder}/load={number}")


def uri_table(*sources: DataFrame) -> DataFrame:
    """(t, a, track_uri): the most frequent uri of each title and artist; ties to the smaller uri."""
    every = sources[0].select("track_name", "artist_name", "track_uri")
    for s in sources[1:]:
        every = every.unionByName(s.select("track_name", "artist_name", "track_uri"))
    counted = every.filter("track_uri IS NOT NULL AND track_name IS NOT NULL AND artist_name IS NOT NULL").groupBy(X.name_key("track_name").alias("t"), X.name_key("artist_name").alias("a"), "track_uri").agg(F.count("*").alias("n"))
    order = Window.partitionBy("t", "a").orderBy(F.desc("n"), "track_uri")
    return counted.withColumn("r", F.row_number().over(order)).filter("r = 1").select("t", "a", "track_uri")


def recover_uris(plays: DataFrame, known: DataFrame) -> DataFrame:
    """Plays without uris, with the known uri of their title and artist."""
    keyed = plays.withColumns({"t": X.name_key("track_name"), "a": X.name_key("artist_name")})
    return keyed.join(known, ["t", "a"], "left").drop("t", "a")


def recovered_share(plays: DataFrame) -> DataFrame:
    return plays.groupBy("user_id").agg(F.count("*").alias("plays"), F.count("track_uri").alias("recovered"), F.round(F.count("track_uri") / F.count("*"), 4).alias("share"))


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.PLAYS.fields])


def merge_sources(export: DataFrame | None = None, account: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """All plays, the better-informed source winning for each period of each listener.

    Account plays count only past the listener's newest export play, captured ones only past
    the newest of both.  Any source may be missing; what it can't know is null.
    """
    have = {k: _typed(v.withColumn("source", F.lit(k))) for k, v in (("export", export), ("account", account), ("live", live)) if v is not None}
    if not have:
        raise IngestError("no source of plays")
    tip = lambda rows, name: rows.groupBy("user_id").agg(F.max("played_at").alias(name))
    out = []
    bounds: list[DataFrame] = []
    for k in ("export", "account", "live"):
        if k not in have:
            continue
        rows = have[k]
        for i, b in enumerate(bounds):
            rows = rows.join(b, "user_id", "left").filter(F.col(f"tip{i}").isNull() | (F.col("played_at") > F.col(f"tip{i}"))).drop(f"tip{i}")
        out.append(rows)
        bounds.append(tip(have[k], f"tip{len(bounds)}"))
    made = out[0]
    for rows in out[1:]:
        made = made.unionByName(rows)
    return made


def coverage(plays: DataFrame) -> DataFrame:
    return plays.groupBy("user_id", "source").agg(F.count("*").alias("plays"), F.min("played_at").alias("first"), F.max("played_at").alias("last"))


def captured_lately(plays: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    """Plays of each listener and source in the last hours, and the newest of them."""
    since = F.lit(as_of.isoformat(" ")).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return plays.filter(F.col("played_at") >= since).groupBy("user_id", "source").agg(F.count("*").alias("plays"), F.max("played_at").alias("newest"))


def first_day(live: DataFrame, export: DataFrame, reread: int = 2) -> DataFrame:
    """(user_id, first_day) to pull again from: two days before the newest captured play, or the export's end."""
    newest = live.groupBy("user_id").agg(F.date_sub(F.to_date(F.max("played_at")), reread).alias("a"))
    end = export.groupBy("user_id").agg(F.to_date(F.max("played_at")).alias("b"))
    return newest.join(end, "user_id", "full").select("user_id", F.greatest("a", "b").alias("first_day"))


def replace_days(spark: SparkSession, pulled: DataFrame, folder: str, since: DataFrame, buckets: int = 64) -> DataFrame:
    """Make each day from ``since(user_id, first_day)`` on hold exactly the pulled rows, in the day store at ``folder``.

    Days whose rows are as they were are not written; days that vanished are emptied.
    Returns (user_id, day, gone) of the days that changed.
    """
    store = DayStore(spark, folder, pulled.schema, buckets)
    day = F.to_date("played_at")
    digest = lambda rows, d, n: rows.groupBy("user_id", "day").agg(F.sum(F.xxhash64("played_at", "track_uri", "track_name", "artist_name", "album_name", "ms_played").cast("decimal(38,0)")).alias(d), F.count("*").alias(n))
    due = lambda rows: rows.withColumn("day", day).join(since, "user_id").filter(F.col("day") >= F.col("first_day")).drop("first_day")
    fresh = due(pulled)
    both = digest(fresh, "d", "n").join(digest(due(store.read(store.parts_since(since))), "od", "on"), ["user_id", "day"], "full")
    different = both.filter(~(F.col("d").eqNullSafe(F.col("od")) & F.col("n").eqNullSafe(F.col("on"))))
    changed = checkpointed(different.select("user_id", "day", F.col("n").isNull().alias("gone")))
    days = changed.select("user_id", "day")
    store.replace_days(fresh.join(days, ["user_id", "day"], "left_semi"), days)
    return changed.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def prunable_days(live: DataFrame, export: DataFrame) -> DataFrame:
    """(user_id, day) of captured days that the export covers whole."""
    newest = live.groupBy("user_id", F.to_date("played_at").alias("day")).agg(F.max("played_at").alias("newest"))
    tip = export.groupBy("user_id").agg(F.max("played_at").alias("tip"))
    return newest.join(tip, "user_id").filter(F.col("newest") <= F.col("tip")).select("user_id", "day")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(artist, tags) of a CSV with a header and columns artist and tags, tags parted by semicolons.

    An artist has as many rows as tracks, with the same tags in each; one of its longest lists stays.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).select("artist", F.split("tags", ";").alias("tags"))
    named = raw.filter("artist IS NOT NULL AND trim(artist) <> '' AND tags IS NOT NULL").groupBy(X.name_key("artist").alias("artist"))
    return named.agg(F.max_by("tags", F.struct(F.size("tags"), F.col("tags"))).alias("tags"))


def flatten_recent(payloads: DataFrame) -> DataFrame:
    """Plays of recently-played payloads ``(user_id, body)``: one row for each item, acts joined in order."""
    items = payloads.select("user_id", F.explode(F.from_json(F.get_json_object("body", "$.items"), RECENT)).alias("i"))
    return items.select(
        "user_id",
        F.to_timestamp_ntz(F.regexp_replace(F.substring("i.played_at", 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).alias("played_at"),
        F.col("i.track.uri").alias("track_uri"),
        F.col("i.track.name").alias("track_name"),
        F.array_join(F.transform("i.track.artists", lambda a: a["name"]), ", ").alias("artist_name"),
        F.col("i.track.album.name").alias("album_name"),
        F.col("i.track.duration_ms").alias("duration_ms"),
    )


def estimate_heard(recent: DataFrame) -> DataFrame:
    """ms_played of plays that only say when they ended: the track's length or the gap before, if shorter."""
    order = Window.partitionBy("user_id").orderBy("played_at", "track_uri")
    gap = F.timestamp_diff("MILLISECOND", F.lag("played_at").over(order), F.col("played_at"))
    return recent.withColumn("ms_played", F.greatest(F.lit(0).cast("long"), F.least(F.col("duration_ms"), F.coalesce(gap, F.col("duration_ms")))))


def same_track(left: str, right: str) -> Column:
    """Equal uris, or equal names and artists after trimming and lower-casing."""
    c = lambda side, name: F.col(f"{side}.{name}")
    names = (X.name_key(c(left, "track_name")) == X.name_key(c(right, "track_name"))) & (X.name_key(c(left, "artist_name")) == X.name_key(c(right, "artist_name")))
    return F.coalesce(c(left, "track_uri") == c(right, "track_uri"), F.lit(False)) | F.coalesce(names, F.lit(False))


def reconcile(watched: DataFrame, estimated: DataFrame, seconds: int = 30) -> DataFrame:
    """Measured plays, and estimated ones with no measured play of the track ending near them.

    Near means within ``seconds``.  Both sides meet in buckets of that length, the estimated
    side also in its two neighbours, once by uri and once by name.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)
    est = estimated.withColumn("__row", F.xxhash64("user_id", "played_at", "track_uri", "track_name", "artist_name"))
    spread = est.select("user_id", "__row", F.col("played_at").alias("e_at"), F.col("track_uri").alias("e_uri"), F.concat_ws("\u001f", X.name_key("track_name"), X.name_key("artist_name")).alias("e_name"), F.explode(F.array(*[bucket(F.col("played_at")) + d for d in (-1, 0, 1)])).alias("b"))
    seen = watched.select("user_id", F.col("played_at").alias("w_at"), F.col("track_uri").alias("w_uri"), F.concat_ws("\u001f", X.name_key("track_name"), X.name_key("artist_name")).alias("w_name"), bucket(F.col("played_at")).alias("b"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    near = F.abs(micros("e_at") - micros("w_at")) <= seconds * 1_000_000
    by_uri = spread.join(seen.withColumnRenamed("w_uri", "e_uri"), ["user_id", "b", "e_uri"]).filter(near).select("__row")
    by_name = spread.join(seen.withColumnRenamed("w_name", "e_name"), ["user_id", "b", "e_name"]).filter(near).select("__row")
    left = est.join(by_uri.union(by_name).distinct(), "__row", "left_anti").drop("__row")
    return watched.withColumn("how", F.lit("watch")).unionByName(left.withColumn("how", F.lit("recent")), allowMissingColumns=True)


#: A listing as it lands: what is read of it.
_ACT = "struct<name:string,externalLinks:map<string,array<struct<url:string>>>,images:array<struct<url:string,width:int,ratio:string>>,upcomingEvents:struct<_total:int>>"
_LISTING = f"struct<id:string,name:string,url:string,dates:struct<start:struct<localDate:string,localTime:string>>,distance:double,priceRanges:array<struct<min:double,max:double>>,images:array<struct<url:string,width:int,ratio:string>>,_embedded:struct<attractions:array<{_ACT}>,venues:array<struct<name:string,city:struct<name:string>,location:struct<latitude:string,longitude:string>>>>>"


def chosen_image(images: Column, width: int = 640) -> Column:
    """The url of one of some pictures: of ratio 3:2 if there is one, and then nearest to ``width``.

    Of equal ones the first; where none tells its width, the first of all.
    """
    sized = F.filter(images, lambda i: F.coalesce(i["width"], F.lit(0)) != 0)
    order = F.transform(sized, lambda i, n: F.struct((~i["ratio"].eqNullSafe("3_2")).alias("other"), F.abs(i["width"] - width).alias("off"), n.alias("n"), i["url"].alias("url")))
    return F.when(F.size(sized) > 0, F.array_min(order)["url"]).otherwise(F.get(images, F.lit(0))["url"])


def normal_events(events: DataFrame) -> DataFrame:
    """Shows of landed event JSON ``(body, fetched)``: one row for each act, whatever its case, and date.

    The headliner is the first attraction, else the event's name, else Unknown; support is the
    next three.  Of several copies that stays which tells most of image, least price, distance,
    the act's id and the time of day; of equal ones that fetched first.
    """
    e = events.select("fetched", F.from_json("body", _LISTING).alias("e"))
    acts = F.col("e._embedded.attractions")
    head = F.get(acts, F.lit(0))
    venue = F.get(F.col("e._embedded.venues"), F.lit(0))
    given = lambda c: F.when(c != "", c)
    links = F.transform(F.flatten(F.map_values(head["externalLinks"])), lambda x: F.regexp_extract(x["url"], r"artist/(\w+)", 1))
    price = lambda end: (lambda p: F.when(p != 0, p.cast("int")))(F.get(F.col("e.priceRanges"), F.lit(0))[end])
    images = F.when(F.size(head["images"]) > 0, head["images"]).otherwise(F.col("e.images"))
    rows = e.select(
        F.col("e.id").alias("id"),
        F.coalesce(given(head["name"]), given(F.col("e.name")), F.lit("Unknown")).alias("artist"),
        F.to_date("e.dates.start.localDate").alias("date"),
        given(F.substring("e.dates.start.localTime", 1, 5)).alias("time"),
        F.get(F.filter(links, lambda x: x != ""), F.lit(0)).alias("external_id"),
        F.transform(F.slice(acts, 2, 3), lambda a: a["name"]).alias("support"),
        venue["name"].alias("venue"),
        venue["city"]["name"].alias("city"),
        venue["location"]["latitude"].cast("double").alias("lat"),
        venue["location"]["longitude"].cast("double").alias("lon"),
        F.round("e.distance", 1).alias("distance_mi"),
        price("min").alias("price_min"),
        price("max").alias("price_max"),
        chosen_image(images).alias("image"),
        F.col("e.url").alias("url"),
        head["upcomingEvents"]["_total"].alias("upcoming_total"),
        "fetched",
    ).filter("date IS NOT NULL")
    tells = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("image", "external_id", "time")] + [F.coalesce(F.col(c) != 0, F.lit(False)) for c in ("price_min", "distance_mi")]
    order = Window.partitionBy(F.lower("artist"), "date").orderBy(F.desc("rich"), "fetched", "venue", "price_min", "distance_mi", "time", "image", "external_id", "artist", "id")
    return rows.withColumn("rich", sum(t.cast("int") for t in tells)).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r", "rich", "fetched")


def fan_counts(candidates: DataFrame) -> DataFrame:
    """(name, fans): of candidates ``(name, found, fans)`` the largest count under exactly that name; 0 is unknown."""
    exact = candidates.filter(F.lower("name") == F.lower("found"))
    best = exact.groupBy("name").agg(F.max("fans").alias("fans"))
    return candidates.select("name").distinct().join(best, "name", "left").select("name", F.when(F.col("fans") > 0, F.col("fans")).alias("fans"))


def stamped(table: DataFrame, **stamp: object) -> DataFrame:
    """An artefact with the settings it was made with, as one struct column."""
    return table.withColumn("stamp", F.create_map(*[F.lit(str(x)) for kv in sorted(stamp.items()) for x in kv]))


def stamp_warnings(table: DataFrame, **wanted: object) -> list[str]:
    """What differs between an artefact's stamp and the settings it is about to be used with."""
    if "stamp" not in table.columns:
        return ["no stamp"]
    row = table.select("stamp").first()
    seen = dict(row["stamp"]) if row else {}
    return [f"{k}: {seen.get(k)} instead of {v}" for k, v in sorted((k, str(v)) for k, v in wanted.items()) if seen.get(k) != v]
