"""Facts about listeners: card, streak, pins, top lists, familiarity, shows, names."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlore import schema as S
from playlore.functions import expressions as X
from playlore.plans.chart import ChartSpec, cover, tips, with_genres


def card(plays: DataFrame) -> DataFrame:
    """Hours, plays, distinct artists and first year, of listens; null artists count as plays."""
    rows = plays.filter(X.is_listen())
    return rows.groupBy("user_id").agg(F.round(F.sum("ms_played") / 3600000.0, 1).alias("hours"), F.count("*").alias("plays"), F.countDistinct("artist_name").alias("artists"), F.year(F.min("played_at")).alias("since"))


def card_genres(plays: DataFrame, genres: DataFrame) -> DataFrame:
    """Top genres by hours over the last 365 days, and how many reach five hours."""
    rows = plays.join(tips(plays), "user_id").filter(X.is_listen() & (F.col("played_at") > F.col("tip") - F.expr("INTERVAL 365 days")))
    named = rows.join(genres, F.lower("artist_name") == genres["artist"])
    made = named.groupBy("user_id", "genre").agg((F.sum("ms_played") / 3600000.0).alias("h"))
    whole = Window.partitionBy("user_id")
    order = whole.orderBy(F.desc("h"), "genre")
    ranked = made.withColumns({"rank": F.row_number().over(order), "deep": F.count_if(F.col("h") >= S.CARD_GENRE_HOURS).over(whole)})
    return ranked.filter(F.col("rank") <= S.CARD_GENRES).select("user_id", "rank", "genre", F.round("h", 1).alias("hours"), F.col("deep").alias("deep_genres"))


def day_streak(plays: DataFrame, as_of: dt.datetime, zone: str = S.ZONE, gaps: DataFrame | None = None) -> DataFrame:
    """(user_id, streak, start): consecutive local days up to today or yesterday; 0 if broken.

    Any play makes a day, however short.  ``gaps(user_id, after, before)`` are stretches that
    no source observed, by default those of ``unobserved``; the days strictly between count
    as played.
    """
    days = plays.select("user_id", F.to_date(X.local("played_at", zone)).alias("day"))
    gaps = unobserved(plays, zone) if gaps is None and "source" in plays.columns else gaps
    if gaps is not None:
        unseen = gaps.filter(F.datediff("before", "after") > 1).select("user_id", F.explode(F.sequence(F.date_add("after", 1), F.date_sub("before", 1))).alias("day"))
        days = days.unionByName(unseen)
    days = days.distinct()
    today = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit(as_of.isoformat(" ")).cast("timestamp_ntz")))
    days = days.filter(F.col("day") <= today)
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("day").alias("start"), F.max("day").alias("end"))
    newest = runs.groupBy("user_id").agg(F.max_by(F.struct("n", "start", "end"), "end").alias("run"))
    alive = F.col("run.end") >= F.date_sub(today, 1)
    return newest.select("user_id", F.when(alive, F.col("run.n")).otherwise(0).alias("streak"), F.when(alive, F.col("run.start")).alias("start"))


def unobserved(plays: DataFrame, zone: str = S.ZONE) -> DataFrame:
    """(user_id, after, before): from the last local day of a listener's export to the first of capture."""
    day = F.to_date(X.local("played_at", zone))
    edges = plays.groupBy("user_id").agg(F.max(F.when(F.col("source") == "export", day)).alias("after"), F.min(F.when(F.col("source") == "live", day)).alias("before"))
    return edges.filter("after IS NOT NULL AND before IS NOT NULL")


def _top(made: DataFrame, value: str, *names: str, limit: int) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc(value), *names)
    return made.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_tracks(plays: DataFrame, limit: int = 20) -> DataFrame:
    rows = plays.filter(X.is_listen() & F.col("track_uri").startswith(S.TRACK_PREFIX))
    return _top(rows.groupBy("user_id", "track_uri").agg(F.count("*").alias("plays")), "plays", "track_uri", limit=limit)


def top_artists(plays: DataFrame, limit: int = 20) -> DataFrame:
    rows = plays.filter(X.is_listen() & F.col("artist_name").isNotNull())
    made = rows.groupBy("user_id", "artist_name").agg(F.sum("ms_played").alias("ms"))
    return _top(made, "ms", "artist_name", limit=limit).select("user_id", "rank", "artist_name", F.round(F.col("ms") / 3600000.0, 2).alias("hours"))


def top_albums(plays: DataFrame, limit: int = 20) -> DataFrame:
    rows = plays.filter(X.is_listen() & F.col("album_name").isNotNull() & F.col("artist_name").isNotNull())
    made = rows.groupBy("user_id", "album_name", "artist_name").agg(F.sum("ms_played").alias("ms"))
    return _top(made, "ms", "album_name", "artist_name", limit=limit).select("user_id", "rank", "album_name", "artist_name", F.round(F.col("ms") / 3600000.0, 2).alias("hours"))


def artist_days(plays: DataFrame) -> DataFrame:
    """Hours, plays and distinct UTC days of each listener and artist, case folded."""
    rows = plays.filter(X.is_listen() & F.col("artist_name").isNotNull())
    return rows.groupBy("user_id", F.lower("artist_name").alias("artist")).agg(F.round(F.sum("ms_played") / 3600000.0, 1).alias("hours"), F.count("*").alias("plays"), F.countDistinct(F.to_date("played_at")).alias("days"))


def artist_familiarity(plays: DataFrame) -> DataFrame:
    return artist_days(plays).withColumn("level", X.familiarity(F.col("days")))


def last_played(plays: DataFrame) -> DataFrame:
    rows = plays.filter("track_name IS NOT NULL")
    last = F.max_by(F.struct("track_name", "artist_name", "track_uri"), F.struct("played_at", "track_uri", "artist_name"))
    return rows.groupBy("user_id").agg(F.max("played_at").alias("played_at"), last.alias("l")).select("user_id", "played_at", "l.track_name", "l.artist_name", "l.track_uri")


def _credit_keys(name: str) -> Column:
    """(key, whole) for an act and each of its leading parts before a comma, in lower case."""
    parts = F.split(X.name_key(name), ", ")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ", ").alias("key"), (n == F.size(parts)).alias("whole")))
    return F.inline(leading)


def pin_stats(plays: DataFrame, pins: DataFrame, zone: str = S.ZONE) -> DataFrame:
    """Hours, plays and first local day of each pin; zeros where it was never played.

    ``pins(user_id, pin, kind, uri, title, artist)``: a song matches by uri, or by title key
    and act; an artist by act; an album by title key and act.  Plays meet the pins by uri and
    by act: an act is joined under its whole credit and under the credit's leading parts, of
    which one side's must be whole.  Titles are normalised only where the act agrees.  Plays
    without an artist don't count.
    """
    rows = plays.filter("artist_name IS NOT NULL").select("user_id", "track_uri", "track_name", "artist_name", "album_name", "ms_played", "played_at")
    asked = pins.select("user_id", "pin", "kind", "uri", X.title_key("title").alias("want"), "artist")
    found = ["user_id", "pin", "ms_played", "played_at"]
    by_uri = rows.join(asked.filter("kind = 'song'").select("user_id", "pin", F.col("uri").alias("track_uri")), ["user_id", "track_uri"]).select(*found)
    theirs = rows.select("*", _credit_keys("artist_name")).withColumnRenamed("whole", "whole_play")
    named = asked.select("*", _credit_keys("artist")).drop("artist")
    title = F.when(F.col("kind") == "song", X.title_key("track_name") == F.col("want")).when(F.col("kind") == "album", X.title_key("album_name") == F.col("want")).otherwise(F.lit(True))
    counted = (F.col("kind") == "song") & (F.col("track_uri") == F.col("uri"))  # by its uri
    acts = theirs.join(named, ["user_id", "key"]).filter((F.col("whole") | F.col("whole_play")) & ~F.coalesce(counted, F.lit(False)))
    # An act that is whole on both sides meets once; a longer credit meets a shorter one under the shorter's key only.
    by_act = acts.filter(title).select(*found)
    listen = F.col("ms_played") >= S.LISTEN_MS
    total = by_uri.unionByName(by_act).groupBy("user_id", "pin").agg(F.sum("ms_played").alias("ms"), F.count_if(listen).alias("n"), F.min(F.when(listen, F.col("played_at"))).alias("first"))
    return pins.select("user_id", "pin").join(total, ["user_id", "pin"], "left").select(
        "user_id", "pin", F.round(F.coalesce("ms", F.lit(0)) / 3600000.0, 2).alias("hours"), F.coalesce("n", F.lit(0)).alias("plays"), F.to_date(X.local("first", zone)).alias("first_day")
    )


def listener_shows(shows: DataFrame, plays: DataFrame, genres: DataFrame, fans: DataFrame | None = None, asked: tuple[int, ...] = ()) -> DataFrame:
    """Shows as a listener sees them: familiarity, hours, fans and genre of the headliner.

    Rows are made for acts that the listener has heard, and for the listeners in ``asked``
    for all other shows too, which are ``new`` to them.
    """
    known = artist_familiarity(plays).select("user_id", F.col("artist").alias("key"), "level", "hours")
    if fans is not None:
        shows = shows.drop("fans").join(fans.select(F.lower("name").alias("fan_key"), "fans"), F.lower("artist") == F.col("fan_key"), "left").drop("fan_key")
    named = with_genres(shows.withColumnRenamed("artist", "artist_name"), genres).withColumnRenamed("artist_name", "artist")
    keyed = named.withColumn("key", F.lower("artist"))
    view = keyed.join(known, "key")
    if asked:
        every = keyed.withColumn("user_id", F.explode(F.array(*[F.lit(u).cast("long") for u in asked])))
        view = view.unionByName(every.join(known, ["user_id", "key"], "left_anti"), allowMissingColumns=True)
    return view.select("user_id", "artist", "date", "distance_mi", "fans", "genre", F.coalesce("level", F.lit("new")).alias("familiarity"), F.coalesce("hours", F.lit(0.0)).alias("hours"))


def filter_shows(shows: DataFrame, as_of: dt.date, *, familiarity: str | None = None, radius_mi: float = 50, within_days: int = 90, min_fans: int | None = None, max_fans: int | None = None, artists: tuple[str, ...] = (), genres: tuple[str, ...] = (), regions: DataFrame | None = None) -> DataFrame:
    """Shows near enough and soon enough.

    A null distance and a null date are kept, null fans go only if a bound was asked for, a
    null genre goes if genres were asked for.
    """
    if not 1 <= radius_mi <= 500 or not 1 <= within_days <= 365:
        raise ValueError("radius is 1 to 500 miles, days are 1 to 365")
    if min_fans is not None and max_fans is not None and min_fans > max_fans:
        raise ValueError("the bounds of fans are reversed")
    ok: Column = F.col("distance_mi").isNull() | (F.col("distance_mi") <= radius_mi)
    first = F.lit(as_of)
    ok &= F.col("date").isNull() | F.col("date").between(first, F.date_add(first, within_days))
    if familiarity == "new":
        ok &= F.col("familiarity") == "new"
    elif familiarity:
        ok &= X.familiarity_order(F.col("familiarity")) >= X.familiarity_order(F.lit(familiarity))
    if min_fans is not None:
        ok &= F.coalesce(F.col("fans") >= min_fans, F.lit(False))
    if max_fans is not None:
        ok &= F.coalesce(F.col("fans") <= max_fans, F.lit(False))
    if artists:
        ok &= F.lower("artist").isin(*[a.strip().lower() for a in artists])
    out = shows.filter(ok)
    if genres:
        if regions is None:
            raise ValueError("genres need regions")
        out = out.join(cover(regions, genres).select("genre"), "genre", "left_semi")
    return out


def show_totals(shows: DataFrame, matching: DataFrame) -> DataFrame:
    a = shows.groupBy("user_id").agg(F.count("*").alias("total"))
    b = matching.groupBy("user_id").agg(F.count("*").alias("matching"))
    return a.join(b, "user_id", "left").na.fill(0, ["matching"])


def namesakes(plays: DataFrame, shown: int = 3, limit: int = 8) -> DataFrame:
    """Other artists with a song of the same title as a listener's most played artist for it.

    Of the first ``limit`` others by plays, the first ``shown`` acts: an act that is spelt in several
    ways, or like the most played one but for case and space, is named once.
    """
    rows = plays.filter(X.is_listen() & F.col("artist_name").isNotNull()).withColumn("title", X.title_key("track_name"))
    counted = rows.groupBy("user_id", "title", "artist_name").agg(F.count("*").alias("plays"))
    order = Window.partitionBy("user_id", "title").orderBy(F.desc("plays"), "artist_name")
    first = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit + 1).withColumn("key", X.name_key("artist_name"))
    # The most played spelling of each act; the act in the first place is the one that is meant.
    spelt = Window.partitionBy("user_id", "title", "key").orderBy("place")
    acts = first.withColumn("spelling", F.row_number().over(spelt)).filter("spelling = 1")
    ranked = acts.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "title").orderBy("place")) - 1)
    return ranked.filter((F.col("rank") > 0) & (F.col("rank") <= shown)).select("user_id", "title", F.trim("artist_name").alias("artist_name"), "plays", "rank")


def index_keys(key: str, asked: bool) -> Column:
    """Keys under which a name can be found: itself, its words, its beginning, and its rarer letters.

    A name that is asked for needs just one of its words, the longest, to be found by words.  For
    close spellings, let two names agree in m letters, letters that come again counted again, and
    be as near as 0.9.  Then they begin with the same four letters; or with the same one, and m is
    at least 4/7 of the length of either; or m is at least 7/10 of it.  With all letters in one order,
    two names that share m letters share the first of them among the first (length - m + 1) of
    either, and the first two among one more.  Letters' second and later places come first in
    that order, as fewer names have them.
    """
    text = F.col(key)
    words = F.filter(F.split(text, " "), lambda w: w != "")
    if asked:
        words = F.slice(F.array_sort(words, lambda a, b: F.length(b) - F.length(a)), 1, 1)
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    numbered = F.transform(letters, lambda c, i: F.struct((-F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c))).alias("place"), F.xxhash64(c).alias("order"), c.alias("letter")))
    ordered = F.transform(F.array_sort(numbered), lambda x: F.concat(x["letter"], x["place"].cast("string")))
    n = F.size(letters)
    first = lambda share, more: F.slice(ordered, 1, F.greatest(n - F.ceil(n * share).cast("int") + more, F.lit(0)))
    two = first(F.lit(7) / 10, 2)
    pairs = F.flatten(F.transform(two, lambda x, i: F.transform(F.slice(two, i + 2, F.size(two)), lambda y: F.concat(F.lit("n"), x, y))))
    tagged = lambda kind, values: F.transform(values, lambda v: F.concat(kind, v))
    beginning = F.when(n >= 4, F.array(F.concat(F.lit("p"), F.substring(text, 1, 4)))).otherwise(F.array().cast("array<string>"))
    near = F.concat(beginning, tagged(F.concat(F.lit("f"), F.substring(text, 1, 1)), first(F.lit(4) / 7, 1)), pairs)
    whole = F.array(F.concat(F.lit("="), text))
    found = F.concat(whole, tagged(F.lit("w"), F.array_distinct(words)), near)
    # Short names are meant whole only, so others needn't be looked for.
    return F.when(F.length(text) >= 4, found).otherwise(whole) if asked else found


def name_candidates(names: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs of ``names(user_id, kind, key, ...)`` and ``asked(user_id, kind, want, ...)`` that share an index key, once each."""
    by = [*names.columns, *[c for c in asked.columns if c not in ("user_id", "kind")]]
    left = names.withColumn("at", F.explode(F.array_distinct(index_keys("key", asked=False))))
    right = asked.withColumn("at", F.explode(F.array_distinct(index_keys("want", asked=True))))
    return left.join(right, ["user_id", "kind", "at"]).select(*by).distinct()


def resolve(plays: DataFrame, spec: ChartSpec, user_id: int) -> tuple[ChartSpec, list[tuple[str, str]]]:
    """A spec with each name as one listener's history has it, and (typed, name) of those read as something else.

    Artists are read first, and titles then among the songs and albums of these.  A name
    that means nothing stays as it was typed.
    """
    spark = plays.sparkSession
    own = plays.filter(F.col("user_id") == user_id)
    notes: list[tuple[str, str]] = []

    def read(kind: str, typed: tuple[str, ...], artists: tuple[str, ...]) -> tuple[str, ...]:
        if not typed:
            return ()
        rows = [(user_id, t, kind, [a.strip().lower() for a in artists] or None) for t in dict.fromkeys(typed)]
        asked = spark.createDataFrame(rows, "user_id long, typed string, kind string, artists array<string>")
        found = {r["typed"]: r for r in resolve_names(own, asked).collect()}  # as many as the spec names
        notes.extend((t.strip(), found[t]["name"]) for t in dict.fromkeys(typed) if t in found and found[t]["tier"] < 3)
        return tuple(found[t]["name"] if t in found else t for t in typed)

    artists = read("artist", spec.artists, ())
    return replace(spec, artists=artists, tracks=read("track", spec.tracks, artists), albums=read("album", spec.albums, artists)), notes


def resolve_names(plays: DataFrame, typed: DataFrame) -> DataFrame:
    """The played name that a typed one means: exact before whole words before close spelling.

    ``typed(user_id, typed)`` are artists; with a column ``kind`` (artist, track or album) and
    optionally ``artists`` (lower-case names) titles are read too, and those named with their
    artists are looked for among these artists' only.  Names are compared without version
    tails, punctuation and case.  Within close spellings nearness goes first, then plays, then
    the name.  Whole words and close spellings need four letters.  Names and typed ones meet in an
    index (``index_keys``), so a typed name is compared with those that may be meant only.
    """
    from playlore.functions.similarity import jaro_winkler, may_reach

    asked = typed
    if "kind" not in asked.columns:
        asked = asked.withColumn("kind", F.lit("artist"))
    if "artists" not in asked.columns:
        asked = asked.withColumn("artists", F.lit(None).cast("array<string>"))
    asked = asked.select("user_id", "typed", "kind", "artists", X.title_key(F.trim("typed")).alias("want")).filter("want <> ''")
    kinds = (("artist", "artist_name"), ("track", "track_name"), ("album", "album_name"))
    names = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for kind, c in kinds])
    counted = plays.select("user_id", F.lower("artist_name").alias("act"), F.inline(names)).filter("name IS NOT NULL")
    counted = counted.groupBy("user_id", "kind", "name", F.when(F.col("kind") != "artist", F.col("act")).alias("act")).agg(F.count("*").alias("plays"))
    scoped = name_candidates(counted.withColumn("key", X.title_key("name")), asked)
    scoped = scoped.filter((F.col("kind") == "artist") | F.col("artists").isNull() | (F.size("artists") == 0) | F.array_contains("artists", F.col("act")))
    enough = F.length("want") >= 4
    words = enough & F.concat(F.lit(" "), F.col("key"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("want"), F.lit(" ")))
    tier = F.when(F.col("key") == F.col("want"), 3).when(words, 2).when(enough & may_reach("key", "want", 0.9), 1)
    by = ["user_id", "typed", "kind", "artists", "name", "key", "want", "tier"]
    pairs = scoped.withColumn("tier", tier).filter("tier IS NOT NULL").groupBy(*by).agg(F.sum("plays").alias("plays"))
    certain = pairs.filter("tier > 1").withColumn("near", F.lit(0.0))
    close = pairs.filter("tier = 1").withColumn("near", jaro_winkler("key", "want")).filter("near >= 0.9")
    order = Window.partitionBy("user_id", "kind", "typed", "artists").orderBy(F.desc("tier"), F.desc("near"), F.desc("plays"), "name")
    best = certain.unionByName(close.select(certain.columns)).withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.select("user_id", "kind", "typed", "name", "tier", "plays")


def day_timeline(plays: DataFrame, day: dt.date, zone: str = S.ZONE, metric: str = "hours", as_of: dt.datetime | None = None) -> DataFrame:
    """One day's listening as a running total: (user_id, at, value) points of a line.

    The line starts at (0, 0).  Hours are ramps from start to end of each play, which never go
    back in time; plays are steps where each ended.  A day that is over runs flat to 24; the
    day of the clock ``as_of`` stops at its minute, or at the last play if that is later.
    """
    rows = plays.withColumn("local", X.local("played_at", zone)).filter(F.to_date("local") == F.lit(day))
    if metric == "plays":
        rows = rows.filter(X.is_listen())
    heard = F.col("ms_played") / 3600000.0 if metric == "hours" else F.lit(1.0)
    order = Window.partitionBy("user_id").orderBy("local", "track_uri", "ms_played")
    timed = rows.select("user_id", "local", "track_uri", "ms_played", X.fractional_hour(F.col("local")).alias("end"), heard.alias("heard"))
    before = F.greatest(F.coalesce(F.lag("end").over(order), F.lit(0.0)), F.col("end") - F.col("heard")) if metric == "hours" else F.col("end")
    timed = timed.withColumns({"start": before, "total": F.sum("heard").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(order)})
    step = lambda n, at, value: F.struct(n.cast("long").alias("n"), at.alias("at"), value.alias("value"))
    points = timed.select("user_id", F.inline(F.array(step(F.col("n") * 2, F.col("start"), F.col("total") - F.col("heard")), step(F.col("n") * 2 + 1, F.col("end"), F.col("total")))))
    now = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit(as_of.isoformat(" ")).cast("timestamp_ntz")) if as_of else None
    today = F.to_date(now) == F.lit(day) if as_of else F.lit(False)
    until = F.when(today, F.greatest(X.fractional_hour(now), F.max("end"))).otherwise(F.lit(24.0)) if as_of else F.lit(24.0)
    last = timed.groupBy("user_id").agg(until.alias("at"), F.sum("heard").alias("value"), (F.max("n") * 2 + 2).alias("n"))
    zero = timed.select("user_id").distinct().select("user_id", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("at"), F.lit(0.0).alias("value"))
    line = zero.unionByName(points).unionByName(last.select("user_id", F.col("n").cast("long").alias("n"), "at", "value"))
    return line.select("user_id", "n", F.round("at", 4).alias("at"), F.round("value", 3).alias("value"))
