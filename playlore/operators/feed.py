"""The weekly feed, for all listeners at once: movers, discoveries, rotation, repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlore import schema as S
from playlore.functions import expressions as X
from playlore.functions.shared import checkpointed
from playlore.plans.chart import most_played, tips


def anchored(plays: DataFrame) -> DataFrame:
    """Plays with their listener's newest play as ``tip``."""
    return plays.join(tips(plays), "user_id")


def _after(days: int) -> Column:
    return F.col("played_at") > F.col("tip") - F.expr(f"INTERVAL {days} days")


def _listens(plays: DataFrame) -> DataFrame:
    return anchored(plays).filter(X.is_listen())


def _ranked(rows: DataFrame, *order: Column, limit: int) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def week_stats(plays: DataFrame) -> DataFrame:
    """This week against the one before: plays, tracks, artists, hours."""
    rows = anchored(plays).filter(_after(14) & X.is_listen())
    now = _after(7)
    out = []
    for suffix, inside in (("", now), ("_prev", ~now)):
        out += [
            F.count_if(inside).alias("plays" + suffix),
            F.countDistinct(F.when(inside, F.col("track_uri"))).alias("tracks" + suffix),
            F.countDistinct(F.when(inside, F.col("artist_name"))).alias("artists" + suffix),
            F.round(F.coalesce(F.sum(F.when(inside, F.col("ms_played"))), F.lit(0)) / 3600000.0, 1).alias("hours" + suffix),
        ]
    return rows.groupBy("user_id").agg(*out)


def _moved(counted: DataFrame, direction: str, prior: int, recent: int, name: str, limit: int) -> DataFrame:
    up = direction == "up"
    kept = counted.filter((F.col("prior") >= prior) & (F.col("recent") > F.col("prior") if up else (F.col("recent") < F.col("prior")) & (F.col("recent") >= recent)))
    change = (F.col("recent") - F.col("prior")) * 1.0 / F.col("prior")
    return _ranked(kept.withColumn("pct", F.round(change * 100).cast("int")), change.desc() if up else change.asc(), F.col(name), limit=limit)


def artist_movers(plays: DataFrame, direction: str = "up", limit: int = 10) -> DataFrame:
    rows = _listens(plays).filter(_after(14) & F.col("artist_name").isNotNull())
    counted = rows.groupBy("user_id", "artist_name").agg(F.count_if(_after(7)).alias("recent"), F.count_if(~_after(7)).alias("prior"))
    return _moved(counted, direction, S.PRIOR_ARTIST, S.RECENT_ARTIST, "artist_name", limit)


def song_movers(plays: DataFrame, direction: str = "up", limit: int = 10) -> DataFrame:
    rows = _listens(plays).filter(_after(14) & F.col("track_uri").isNotNull())
    counted = rows.groupBy("user_id", "track_uri").agg(F.min("track_name").alias("name"), F.count_if(_after(7)).alias("recent"), F.count_if(~_after(7)).alias("prior"))
    return _moved(counted, direction, S.PRIOR_SONG, S.RECENT_SONG, "track_uri", limit)


def discoveries(plays: DataFrame, limit: int = 10) -> DataFrame:
    """New acts that were kept: no act of the credit known before, and not a new name for old songs."""
    recent = _after(S.DISCOVER_DAYS)
    day = F.to_date("played_at")
    # The plays are read once: everything else is told from these counts.
    counts = checkpointed(
        _listens(plays)
        .groupBy("user_id", "artist_name", X.name_key("track_name").alias("title"))
        .agg(F.count_if(~recent).alias("old"), F.count_if(recent).alias("plays"), F.collect_set(F.when(recent, F.col("track_uri"))).alias("uris"), F.collect_set(F.when(recent, day)).alias("days"), F.min(F.when(recent, F.col("played_at"))).alias("since"))
    )
    by = ["user_id", "artist_name"]
    heard = counts.filter("old > 0")
    known = heard.filter("artist_name IS NOT NULL").select("user_id", F.explode(X.credited_acts("artist_name")).alias("act")).distinct()
    fresh = counts.filter("artist_name IS NOT NULL").groupBy(*by).agg(F.sum("old").alias("old")).filter("old = 0").select(*by)
    joint = fresh.select(*by, F.explode(X.credited_acts("artist_name")).alias("act")).join(known, ["user_id", "act"], "left_semi").select(*by).distinct()
    theirs = counts.drop("old").join(fresh.join(joint, by, "left_anti"), by)
    titles = heard.filter("title IS NOT NULL").select("user_id", "title").distinct()
    renamed = theirs.join(titles, ["user_id", "title"], "left_semi").groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > S.FAMILIAR_TITLES)
    different = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    made = theirs.join(renamed, by, "left_anti").groupBy(*by).agg(F.sum("plays").alias("plays"), different("uris").alias("tracks"), different("days").alias("days"), F.to_date(F.min("since")).alias("since"))
    kept = made.filter((F.col("days") >= S.DISCOVER_DISTINCT) & (F.col("plays") >= S.DISCOVER_PLAYS))
    return _ranked(kept, F.desc("plays"), F.desc("days"), F.col("artist_name"), limit=limit)


def song_discoveries(plays: DataFrame, limit: int = 10) -> DataFrame:
    """New songs that were kept; a new uri of an old title and artist is a re-release, not new."""
    rows = _listens(plays).filter("track_uri IS NOT NULL").withColumns({"t": X.name_key("track_name"), "a": X.name_key("artist_name")})
    old = rows.filter(~_after(S.DISCOVER_DAYS)).select("user_id", "t", "a").distinct()
    by = rows.groupBy("user_id", "track_uri").agg(F.min("played_at").alias("since"), F.max("tip").alias("tip"), F.min("t").alias("t"), F.min("a").alias("a"))
    fresh = by.filter(F.col("since") > F.col("tip") - F.expr(f"INTERVAL {S.DISCOVER_DAYS} days")).join(old, ["user_id", "t", "a"], "left_anti").select("user_id", "track_uri")
    made = rows.join(fresh, ["user_id", "track_uri"]).groupBy("user_id", "track_uri").agg(F.count("*").alias("plays"), F.countDistinct(F.to_date("played_at")).alias("days"), F.to_date(F.min("played_at")).alias("since"))
    kept = made.filter((F.col("days") >= S.DISCOVER_DISTINCT) & (F.col("plays") >= S.DISCOVER_PLAYS))
    return _ranked(kept, F.desc("plays"), F.desc("days"), F.col("track_uri"), limit=limit)


def _three_spans() -> list[Column]:
    return [F.count_if(_after(7)).alias("recent"), F.count_if(_after(14) & ~_after(7)).alias("prior"), F.count_if(~_after(14)).alias("earlier")]


def back_in_rotation(plays: DataFrame, limit: int = 10) -> DataFrame:
    """Artists played again a lot after a quiet week, who were known before."""
    counted = _listens(plays).filter("artist_name IS NOT NULL").groupBy("user_id", "artist_name").agg(*_three_spans())
    kept = counted.filter((F.col("recent") >= S.BACK_ARTIST) & (F.col("prior") < S.PRIOR_ARTIST) & (F.col("earlier") > 0))
    return _ranked(kept, F.desc("recent"), F.col("artist_name"), limit=limit)


def songs_back_in_rotation(plays: DataFrame, limit: int = 10) -> DataFrame:
    """The same for songs by title and artist, shown with the newest spelling and uri."""
    rows = _listens(plays).filter("track_name IS NOT NULL AND artist_name IS NOT NULL AND track_uri IS NOT NULL").withColumns({"t": X.name_key("track_name"), "a": X.name_key("artist_name")})
    newest = F.max_by(F.struct("track_name", "track_uri"), F.struct("played_at", "track_uri", "track_name"))
    counted = rows.groupBy("user_id", "t", "a").agg(*_three_spans(), newest.alias("shown"))
    kept = counted.filter((F.col("recent") >= S.BACK_SONG) & (F.col("prior") < S.PRIOR_SONG) & (F.col("earlier") > 0))
    out = kept.select("user_id", "t", "a", "recent", "prior", "earlier", F.col("shown.track_name").alias("name"), F.col("shown.track_uri").alias("uri"))
    return _ranked(out, F.desc("recent"), F.col("t"), F.col("a"), limit=limit)


def on_repeat(plays: DataFrame, limit: int = 10) -> DataFrame:
    counted = _listens(plays).filter(_after(7) & F.col("track_uri").isNotNull()).groupBy("user_id", "track_uri").agg(F.count("*").alias("plays"))
    return _ranked(counted.filter(F.col("plays") >= S.REPEAT_PLAYS), F.desc("plays"), F.col("track_uri"), limit=limit)


def artist_songs(plays: DataFrame) -> DataFrame:
    """The song to play for each artist: the most played one."""
    return most_played(plays.filter(X.is_listen() & F.col("artist_name").isNotNull()), ["user_id", "artist_name"])


def build(plays: DataFrame, limit: int = 10, cached: DataFrame | None = None) -> DataFrame:
    """The feed as one table: user_id, section, rank, name, plays, plays_prev, through.

    ``through`` is the tip the rows were computed at.  With ``cached`` rows only listeners
    whose tip has moved are computed again.
    """
    at = tips(plays)
    if cached is not None:
        same = cached.select("user_id", F.col("through").alias("tip")).distinct().join(at, ["user_id", "tip"])
        kept = cached.join(same.select("user_id"), "user_id", "left_semi")
        plays = plays.join(same.select("user_id"), "user_id", "left_anti")
    none = F.lit(None).cast("long")

    def section(name: str, rows: DataFrame, label: str, now: str, before: str | None = None) -> DataFrame:
        return rows.select("user_id", F.lit(name).alias("section"), "rank", F.col(label).alias("name"), F.col(now).alias("plays"), (F.col(before) if before else none).alias("plays_prev"))

    parts = [
        section("artists_up", artist_movers(plays, "up", limit), "artist_name", "recent", "prior"),
        section("artists_down", artist_movers(plays, "down", limit), "artist_name", "recent", "prior"),
        section("songs_up", song_movers(plays, "up", limit), "track_uri", "recent", "prior"),
        section("songs_down", song_movers(plays, "down", limit), "track_uri", "recent", "prior"),
        section("discoveries", discoveries(plays, limit), "artist_name", "plays"),
        section("song_discoveries", song_discoveries(plays, limit), "track_uri", "plays"),
        section("back", back_in_rotation(plays, limit), "artist_name", "recent", "prior"),
        section("songs_back", songs_back_in_rotation(plays, limit), "uri", "recent", "prior"),
        section("repeat", on_repeat(plays, limit), "track_uri", "plays"),
    ]
    made = reduce(DataFrame.unionByName, parts).join(at.withColumnRenamed("tip", "through"), "user_id")
    return made if cached is None else kept.unionByName(made)
