"""All registered queries over the listening domain, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlore.functions import expressions as X
from playlore.operators import feed, profile, scoring, taste
from playlore.plans import chart as C
from playlore.plans.chart import ChartSpec, chart
from playlore.plans.compare import compare
from playlore.plans.gallery import PRESETS
from playlore.sources import adapters as A
from playlore.sources import ingest
from playlore.streaming import watch

from . import oracles as O

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.datetime.fromisoformat(A.HISTORY_AS_OF)
EVENTS_AS_OF = dt.datetime.fromisoformat(A.EVENTS_AS_OF)

#: Charts: spec, whether it needs genres.
CHARTS: dict[str, ChartSpec] = {
    "top_artists_hours": ChartSpec(),
    "top_artists_plays": ChartSpec(metric="plays"),
    "bottom_artists_hours": ChartSpec(sort="asc", limit=5),
    "top_albums_hours": ChartSpec(dimension="album"),
    "top_tracks_plays": ChartSpec(dimension="track", metric="plays", limit=8),
    "genres_hours": ChartSpec(dimension="genre"),
    "platforms_plays": ChartSpec(dimension="platform", metric="plays"),
    "hours_of_day": ChartSpec(dimension="hour_of_day"),
    "days_of_week_plays": ChartSpec(dimension="day_of_week", metric="plays"),
    "months_distinct_tracks": ChartSpec(dimension="date", grain="month", metric="distinct_tracks"),
    "years_distinct_artists": ChartSpec(dimension="date", grain="year", metric="distinct_artists"),
    "weeks_hours_2000": ChartSpec(dimension="date", grain="week", year=2000),
    "skip_rate_artists": ChartSpec(dimension="artist", metric="skip_rate"),
    "skip_rate_hours_of_day": ChartSpec(dimension="hour_of_day", metric="skip_rate"),
    "range_30d_artists": ChartSpec(range="30d", metric="plays"),
    "range_12mo_months": ChartSpec(range="12mo", dimension="date", grain="month"),
    "last_2_years_artists": ChartSpec(last=2, last_unit="year"),
    "span_1996_1998_months": ChartSpec(from_year=1996, to_year=1998, dimension="date", grain="month", metric="plays"),
    "since_1999_albums": ChartSpec(from_year=1999, dimension="album"),
    "winter_years": ChartSpec(months=(12, 1, 2), dimension="date", grain="year", metric="plays"),
    "weekend_evenings": ChartSpec(days=("sat", "sun"), hours=(18, 19, 20, 21, 22, 23), dimension="artist"),
    "running_total_2000": ChartSpec(year=2000, dimension="date", grain="month", cumulative=True),
    "running_total_hours": ChartSpec(dimension="hour_of_day", cumulative=True, metric="plays"),
    "named_genres": ChartSpec(dimension="genre", genres=("america", "east", "asia 8")),
    "genre_lines": ChartSpec(dimension="date", grain="year", series="genre", limit=4),
    "album_lines_running": ChartSpec(dimension="date", grain="year", series="album", limit=3, cumulative=True, metric="plays"),
    "top3_artists_each_year": ChartSpec(dimension="date", grain="year", series="artist", per_period=True, limit=3),
    "top_album_each_month_2000": ChartSpec(dimension="date", grain="month", series="album", per_period=True, limit=1, year=2000, metric="plays"),
    "top_track_each_year": ChartSpec(dimension="date", grain="year", series="track", per_period=True, limit=1, metric="plays"),
    "best_month": ChartSpec(answer="top", dimension="date", grain="month", metric="plays"),
    "most_skipped_platform": ChartSpec(answer="top", dimension="platform", metric="skip_rate"),
    "numbers_1998": ChartSpec(answer="number", year=1998),
    "recent_plays": ChartSpec(answer="recent", limit=10),
}


def _chart(name: str) -> Query:
    spec = CHARTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        needs = "genre" in (spec.dimension, spec.series) or bool(spec.genres)
        return chart(A.history(spark, sf_dir), spec, A.genres(spark, sf_dir) if needs else None, AS_OF).drop("year")

    return run


def _history(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(A.history(spark, sf_dir))


def _recent(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(A.recent(spark, sf_dir))


def _long_songs(plays: DataFrame) -> DataFrame:
    """Plays with one song for each artist, so that songs are played often enough to move."""
    return plays.withColumn("track_uri", F.concat(F.lit("track:"), F.col("artist_name")))


def today_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays of one day by the hour, where the clock says that day."""
    return chart(A.recent(spark, sf_dir), ChartSpec(range="today", dimension="date", metric="plays"), as_of=dt.datetime(2024, 1, 20, 12), back=1)


def stepped_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart(A.recent(spark, sf_dir), ChartSpec(range="7d", metric="plays"), back=1)


def today_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays of the clock's own day by the hour; it is eleven in the morning there."""
    return chart(A.recent(spark, sf_dir), ChartSpec(range="today", dimension="date", metric="plays"), as_of=dt.datetime(2024, 1, 20, 16, 40))


def _told(answer: str) -> Query:
    """When each listener played some artists, asked of one year."""
    spec = ChartSpec(answer=answer, year=1995, artists=("supplier#000000003", "Supplier#000000007"))
    return lambda spark, sf_dir: chart(A.history(spark, sf_dir), spec)


def behind_1997(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rows_behind(A.history(spark, sf_dir), ChartSpec(year=1997, metric="plays"))


def last_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest play of each listener: weekday, month, and how much of its hour had passed."""
    newest = X.local("tip")
    return C.tips(A.recent(spark, sf_dir)).select("user_id", X.weekday_name(newest).alias("weekday"), X.month_name(newest).alias("month"), X.into_hour(newest).alias("into_hour"))


def named_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays of an album by year, pinned to the artist with most plays under that title."""
    return chart(A.history(spark, sf_dir), ChartSpec(dimension="date", grain="year", metric="plays", albums=("Brand#13", "Brand#22")))


def named_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart(A.history(spark, sf_dir), ChartSpec(dimension="date", grain="year", series="artist", artists=("supplier#000000001", "Supplier#000000002", "nobody")))


def facts_1999(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facts(C.selected(A.history(spark, sf_dir), ChartSpec(year=1999)))


def bounds_1999(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = A.history(spark, sf_dir)
    return C.window_bounds(plays, C.selected(plays, ChartSpec(year=1999)))


def album_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.most_played(A.history(spark, sf_dir).filter(X.is_listen()), ["user_id", "album_name"])


def aligned_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chart(A.history(spark, sf_dir), ChartSpec(dimension="date", grain="month", year=1998, metric="plays")).select("user_id", "label", "value")
    return C.aligned(lines)


def genre_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chart(A.history(spark, sf_dir), CHARTS["genre_lines"], A.genres(spark, sf_dir))
    return C.shares(made).select("user_id", "label", "series", "share")


def hour_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.intensity(chart(A.history(spark, sf_dir), CHARTS["days_of_week_plays"])).select("user_id", "label", "intensity")


def merged_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.coverage(ingest.merge_sources(**A.sources(spark, sf_dir)))


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sources(spark, sf_dir)
    return ingest.recovered_share(ingest.recover_uris(s["account"], ingest.uri_table(s["export"], s["live"])))


def uri_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sources(spark, sf_dir)
    return ingest.uri_table(s["export"], s["live"])


def reread_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sources(spark, sf_dir)
    return ingest.first_day(s["live"], s["export"])


def prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.sources(spark, sf_dir)
    return ingest.prunable_days(s["live"], s["account"])


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured plays against the same ones, some seconds off, as the other source estimates them."""
    p = A.recent(spark, sf_dir).select("user_id", "played_at", "track_uri", "track_name", "artist_name", "ms_played")
    off = F.make_dt_interval(secs=(F.col("ms_played") % 61 - 30).cast("int") * 2)
    est = p.withColumn("played_at", F.col("played_at") + off).distinct()
    made = ingest.reconcile(p, est)
    return made.groupBy("user_id", "how").agg(F.count("*").alias("plays"), F.sum("ms_played").alias("ms"))


def gap_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.recent(spark, sf_dir).select("user_id", "played_at", "track_uri", F.col("ms_played").alias("duration_ms")).groupBy("user_id", "played_at").agg(F.min("track_uri").alias("track_uri"), F.min("duration_ms").alias("duration_ms"))
    return ingest.estimate_heard(p)


def card_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.card_genres(A.history(spark, sf_dir), A.genres(spark, sf_dir))


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.day_streak(A.recent(spark, sf_dir), EVENTS_AS_OF)


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each listener of the history: a song, an artist and an album pinned, the first of each by name."""
    p = A.history(spark, sf_dir)
    first = p.groupBy("user_id").agg(F.min("track_uri").alias("uri"), F.min("artist_name").alias("artist"), F.min("album_name").alias("album"))
    kinds = F.array(
        F.struct(F.lit("s").alias("pin"), F.lit("song").alias("kind"), F.col("uri").alias("u"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("artist")),
        F.struct(F.lit("a").alias("pin"), F.lit("artist").alias("kind"), F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("title"), F.col("artist")),
        F.struct(F.lit("l").alias("pin"), F.lit("album").alias("kind"), F.lit(None).cast("string").alias("u"), F.col("album").alias("title"), F.col("artist")),
    )
    return first.select("user_id", F.explode(kinds).alias("k")).select("user_id", "k.pin", "k.kind", F.col("k.u").alias("uri"), "k.title", "k.artist")


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pin_stats(A.history(spark, sf_dir), _pins(spark, sf_dir))


def shows_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = profile.listener_shows(A.shows(spark, sf_dir), A.history(spark, sf_dir), A.genres(spark, sf_dir))
    return view.select("user_id", "artist", "date", "fans", "genre", "familiarity")


def shows_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = profile.listener_shows(A.shows(spark, sf_dir), A.history(spark, sf_dir), A.genres(spark, sf_dir))
    kept = profile.filter_shows(view, dt.date(1998, 2, 1), familiarity="regular", radius_mi=60, within_days=60, max_fans=90_000)
    return profile.show_totals(view, kept)


def namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.history(spark, sf_dir).withColumn("track_name", F.col("album_name"))
    return profile.namesakes(p)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.day_timeline(A.recent(spark, sf_dir), dt.date(2024, 1, 20))


def timeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays of a day that is still going on, as steps up to its minute."""
    return profile.day_timeline(A.recent(spark, sf_dir), dt.date(2024, 1, 20), metric="plays", as_of=dt.datetime(2024, 1, 20, 20, 30))


def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each listener means by every name of theirs with its last letter off, and by titles of those acts."""
    p = A.recent(spark, sf_dir).filter("artist_name IS NOT NULL")
    off = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    acts = p.select("user_id", off("artist_name").alias("typed"), F.lit("artist").alias("kind"), F.array().cast("array<string>").alias("artists"))
    titles = p.groupBy("user_id", "artist_name").agg(F.max("track_name").alias("title")).select("user_id", off("title").alias("typed"), F.lit("track").alias("kind"), F.array(F.lower("artist_name")).alias("artists"))
    made = profile.resolve_names(p, acts.unionByName(titles).distinct())
    return made.groupBy("user_id", "kind", "typed", "name", "tier").agg(F.max("plays").alias("plays"))


def map_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.map_regions(A.history(spark, sf_dir), _points(spark, sf_dir))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("artist"), F.col("s_nationkey").alias("region"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_suppkey") % 100).cast("double").alias("y"))
    return s


def listener_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.listener_map(A.history(spark, sf_dir), _points(spark, sf_dir))


def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.occupancy(taste.artist_weights(A.history(spark, sf_dir)), _points(spark, sf_dir).select("artist", "region"))


def coverage_of_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _points(spark, sf_dir).filter("x > 0").select("artist")
    return taste.coverage(taste.artist_weights(A.history(spark, sf_dir)), known)


def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.region_cohesion(A.space(spark, sf_dir)).withColumn("cohesion", F.round("cohesion", 6))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.space(spark, sf_dir).select("artist", "region", F.element_at("z", 1).alias("x"), F.element_at("z", 2).alias("y"))
    return taste.region_positions(points)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest region centre."""
    space = A.space(spark, sf_dir)
    return taste.nearest_centre(space, taste.region_centres(space)).withColumn("cosine", F.round("cosine", 6))


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.region_twins(A.space(spark, sf_dir), floor=0.1).withColumn("cosine", F.round("cosine", 6))


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = A.space(spark, sf_dir)
    fame = space.select("artist", F.when(F.col("artist") % 3 == 0, F.col("artist") % 101).alias("fame"))
    return taste.region_exemplars(space, fame)


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    words = F.split(F.lower("text"), r"\s+")
    return d.select(F.col("doc_id").cast("string").alias("artist"), F.concat(F.array("lang", "source"), words).alias("tags"))


def corpus_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each document, but for names of languages and what speaks of oneself."""
    languages = A.table(spark, sf_dir, "documents").select(F.col("lang").alias("tag")).filter("tag IS NOT NULL")
    made = taste.tag_corpus(_tagged(spark, sf_dir), dropped=languages, markers=("mine", "wir", "nous"))
    return made.select("artist", F.size("tags").cast("long").alias("n_tags"))


def tag_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.tag_weights(_tagged(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(genre, artist, tags): parts by brand, tagged with the words of their type."""
    p = A.table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("genre"), F.col("p_partkey").alias("artist"), F.split(F.lower("p_type"), " ").alias("tags"))


def tag_says(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of parts' types, brands and sizes as tags, by how much their parts have in common otherwise."""
    p = A.table(spark, sf_dir, "part")
    words = F.split(F.lower(F.concat_ws(" ", "p_type", F.concat(F.lit("brand"), F.substring("p_brand", 7, 1)), F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string")))), " ")
    corpus = p.select(F.col("p_partkey").alias("artist"), words.alias("tags"))
    made = taste.tag_cohesion(taste.tag_matrix(corpus)).withColumn("cohesion", F.round("cohesion", 6))
    return made.withColumn("rank", F.row_number().over(Window.orderBy("cohesion", "tag")))


def dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = taste.dominant_tags(part_tags(spark, sf_dir), share=0.25)
    return made.select("genre", F.explode("tags").alias("tag"))


def labels_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.region_labels(part_tags(spark, sf_dir).withColumnRenamed("genre", "region"))


def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cover(A.genres(spark, sf_dir).select("genre").distinct(), ("america", "east", "asia 8"))


def serving_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist to genre and region, with the fallback to the first act of a credit."""
    g = A.genres(spark, sf_dir)
    return C.with_genres(A.history(spark, sf_dir).select("artist_name").distinct(), g).select("artist_name", "genre")


def _event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a landed listing: its supplier plays on the order's day, under names of either case; some know more."""
    line, orders = A.table(spark, sf_dir, "lineitem"), A.table(spark, sf_dir, "orders")
    s = A.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name"))
    time = F.when(F.col("l_returnflag") == "N", F.lit("19:30:00"))
    start = F.struct(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("localDate"), time.alias("localTime")).alias("start"))
    venue = F.when(F.col("l_returnflag") == "R", F.array(F.struct(F.col("o_orderpriority").alias("name"))))
    quantity = F.col("l_quantity").cast("double")
    price = F.when(F.col("l_linestatus") == "F", F.array(F.struct(quantity.alias("min"), (quantity * 2).alias("max"))))
    picture = lambda url, width, ratio: F.struct(F.lit(url).alias("url"), width.cast("int").alias("width"), F.lit(ratio).alias("ratio"))
    images = F.when(F.col("l_linenumber") <= 4, F.array(picture("wide", F.lit(640), "16_9"), picture("near", F.lit(740), "3_2"), picture("other", quantity * 10 + 300, "3_2")))
    links = F.create_map(F.lit("site"), F.array(F.struct(F.concat(F.lit("https://example.org/artist/"), F.col("l_suppkey").cast("string")).alias("url"))))
    acts = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.struct(name.alias("name"), links.alias("externalLinks"))))
    distance = F.when(F.col("l_tax") > 0.04, F.col("l_partkey") % 500 / 4)
    body = F.struct(name.alias("name"), start.alias("dates"), distance.alias("distance"), price.alias("priceRanges"), images.alias("images"), F.struct(acts.alias("attractions"), venue.alias("venues")).alias("_embedded"))
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fetched"), F.to_json(body).alias("body"))


def deduped_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing for each supplier and day, the one that tells most."""
    return ingest.normal_events(_event_bodies(spark, sf_dir)).select("artist", "date", "time", "venue", "price_min", "price_max", "distance_mi", "image", "external_id")


def genre_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widening index of parts by brand: dominant tags and number of parts of each."""
    tagged = part_tags(spark, sf_dir)
    atlas = tagged.select(F.col("genre").alias("region"), F.col("genre").alias("name")).distinct().select("region", "name", F.array().cast("array<string>").alias("tags"), F.lit("calm").alias("state"))
    _, index = taste.serving_tables(tagged.select("artist", F.col("genre").alias("region")), atlas, tagged.select("artist", "tags"))
    return index.select("genre", F.array_join("dominant", ",").alias("dominant"), "n_artists", "state")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of jobs read from events: a purchase adds, an error fails."""
    e = A.table(spark, sf_dir, "events")
    runs = e.select(F.col("event_type").alias("job"), (F.col("user_id") % 5).alias("user_id"), F.col("ts").cast("timestamp_ntz").alias("at"), (F.col("value") >= 5).alias("ok"), F.concat(F.lit("code "), F.col("event_id").cast("string")).alias("error"), F.floor("value").alias("added"))
    beats = watch.heartbeat(runs)
    return watch.stalled(beats, dt.datetime(2024, 1, 31, 0, 0), minutes=60).drop("last_error")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    uri = F.concat(F.lit("track:"), (F.col("event_id") % 7).cast("string"))
    return e.select(
        "user_id",
        F.col("ts").cast("timestamp").alias("at"),
        F.lit(200).alias("status"),
        (F.col("value") > 10).alias("is_playing"),
        F.when(F.col("event_type") == "signup", "none").otherwise("track").alias("kind"),
        (F.col("value") * 1000).cast("long").alias("progress_ms"),
        uri.alias("uri"),
        uri.alias("name"),
        F.lit("someone").alias("artist"),
        F.lit("somewhere").alias("album"),
        F.lit(200_000).cast("long").alias("duration_ms"),
    )


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.replay(_snapshots(spark, sf_dir))


def spec_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as produced specs: the segment exact, the balance between, the nation one of three."""
    c = A.table(spark, sf_dir, "customer")
    case, none = F.col("c_custkey").alias("case"), F.lit(None)
    got = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    produced = c.select(case, F.explode(got).alias("field", "value"))
    text, number, names = none.cast("string"), none.cast("double"), none.cast("array<string>")
    parts = [
        c.select(case, F.lit("segment").alias("field"), F.lit("exact").alias("kind"), F.lit("BUILDING").alias("value"), number.alias("low"), number.alias("high"), names.alias("among")),
        c.select(case, F.lit("balance").alias("field"), F.lit("between").alias("kind"), text.alias("value"), F.lit(0.0).alias("low"), F.lit(5000.0).alias("high"), names.alias("among")),
        c.select(case, F.lit("nation").alias("field"), F.lit("in").alias("kind"), text.alias("value"), number.alias("low"), number.alias("high"), F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("among")),
    ]
    return scoring.pass_rate(scoring.field_scores(produced, parts[0].unionByName(parts[1]).unionByName(parts[2])))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as answers of a run: returned ones failed, quantity is latency, key and number are tokens."""
    line = A.table(spark, sf_dir, "lineitem")
    error = F.when(F.col("l_returnflag") == "R", F.lit("failed"))
    return scoring.run_totals(line.select(F.col("l_orderkey").alias("case"), error.alias("error"), F.col("l_quantity").alias("latency_ms"), F.col("l_partkey").alias("input_tokens"), F.col("l_linenumber").alias("output_tokens")))


def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    before = o.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("case"), (F.col("o_totalprice") > 100_000).alias("ok"))
    after = o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("case"), (F.col("o_orderpriority") < "3").alias("ok"))
    return scoring.run_diff(before, after).groupBy("change").agg(F.count("*").alias("cases"))


def tag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cases, tagged by region and by sign of balance; poor ones are expected to be rejected."""
    s = A.table(spark, sf_dir, "supplier").join(A.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    case, poor = F.col("s_suppkey").alias("case"), F.col("s_acctbal") < 2000
    got = F.create_map(F.lit("understood"), (F.col("s_suppkey") % 4 != 0).cast("string"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    wanted = F.create_map(F.lit("understood"), (~poor).cast("string"), F.lit("nation"), F.when(F.col("s_suppkey") % 3 == 0, "0").otherwise(F.col("s_nationkey").cast("string")))
    expected = s.select(case, F.explode(wanted).alias("field", "value"), F.lit("exact").alias("kind"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("array<string>").alias("among"))
    tags = s.select(case, F.array(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), F.when(poor, "poor").otherwise("rich")).alias("tags"))
    return scoring.pass_rate_by_tag(scoring.field_scores(s.select(case, F.explode(got).alias("field", "value")), expected), tags)


def _label_modes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Listeners as groups of vectors: each label's centre is a mode of listener label % 3; and all pairs of the three."""
    centres = taste.region_centres(A.space(spark, sf_dir))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))
    modes = centres.select((F.col("region") % 3).cast("long").alias("user_id"), F.col("region").alias("mode"), "n", F.lit(1.0).alias("one"), F.col("z").alias("centre"))
    modes = modes.withColumn("recent_share", share).withColumnRenamed("one", "share").drop("n")
    pairs = spark.range(3).select(F.col("id").alias("a"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("b")).filter("a <> b")
    return pairs, modes


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.match(*_label_modes(spark, sf_dir))


def mode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = taste.mode_pairs(*_label_modes(spark, sf_dir), recent=True)
    return made.withColumn("cosine", F.round("cosine", 6)).withColumn("share", F.round("share", 6))


def profile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles over modes that are the nations of the suppliers a listener hears."""
    space, weights = _artist_space(spark, sf_dir), taste.artist_weights(A.history(spark, sf_dir))
    nation = A.table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("artist"), F.col("s_nationkey").alias("region"))
    centres = taste.region_centres(space.join(nation, "artist").select("artist", "region", "z"))
    modes = weights.join(nation, "artist").select("user_id", F.col("region").alias("mode")).distinct().join(centres.select(F.col("region").alias("mode"), F.col("z").alias("centre")), "mode")
    return taste.listener_profile(modes, weights, space, dims=64).drop("stamp").withColumn("coverage", F.round("coverage", 3))


def _artist_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist, tags, z): suppliers have the vector of their number; the other vectors are artists nobody plays."""
    v = A.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    z = A.space(spark, sf_dir).select(F.col("artist").alias("vec_id"), "z")
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vec_id"), F.lower("s_name").alias("artist"), "s_nationkey")
    joined = z.join(v, "vec_id").join(s, "vec_id", "left")
    nation = F.coalesce("s_nationkey", F.col("label"))
    tags = F.array(*[F.concat(F.lit(x), c.cast("string")) for x, c in (("label ", F.col("label")), ("nation ", nation), ("a ", F.col("label")), ("b ", nation))])
    return joined.select(F.coalesce("artist", F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("artist"), tags.alias("tags"), "z")


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.listener_modes(A.history(spark, sf_dir), _artist_space(spark, sf_dir)).select("user_id", "mode", "share", "recent_share", "label", "coverage")


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each mode of a listener, artists to try of those never played."""
    plays, space = A.history(spark, sf_dir), _artist_space(spark, sf_dir)
    return taste.recommendations(taste.listener_modes(plays, space), space, plays).withColumn("score", F.round("score", 6))


def winners_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ChartSpec(answer="top", metric="plays")
    return C.winner_facts(C.selected(A.history(spark, sf_dir), spec), spec)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ChartSpec(dimension="date", grain="month", year=1999, cumulative=True, metric="plays")
    return compare(A.history(spark, sf_dir), spec, [1, 2, 3])


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.captured_lately(A.recent(spark, sf_dir), dt.datetime(2024, 1, 25))


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.space(spark, sf_dir).select("artist", F.element_at("z", 1).alias("x"), F.element_at("z", 2).alias("y"))
    return taste.backdrop(points, n=200)


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each preset chart, and the form it is drawn in."""
    made = [_chart(name)(spark, sf_dir).select(F.lit(name).alias("preset"), F.lit(CHARTS[name].form).alias("form"), "user_id") for name in PRESETS]
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    return every.groupBy("preset", "form").agg(F.count("*").alias("rows"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with the tails that versions of a song carry, by key."""
    k = F.col("p_partkey") % 6
    tail = F.element_at(F.array(*[F.lit(x) for x in VERSION_TAILS]), (k + 1).cast("int"))
    return A.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.initcap("p_name"), tail).alias("title"))


#: Tails of titles, by key; the last two are no versions.
VERSION_TAILS = (" - Remastered 2011", " (feat. Somebody)", " [Live]", "", " - Part One", " & Friends!")


def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("p_partkey", X.short_title("title").alias("short"), X.title_key("title").alias("key"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers at made-up places: their cells, and miles to one point."""
    lat, lon = F.col("s_acctbal") % 90, F.col("s_acctbal") % 180
    miles = X.distance_miles(lat, lon, F.lit(40.7), F.lit(-74.0))
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", F.round(miles, 3).alias("miles"), X.geo_cell(lat, lon).alias("cell"), X.geo_cell(lat * 3, lon).alias("outside"))


def show_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.build(A.recent(spark, sf_dir)).select("user_id", "section", "rank", "name", "plays", "plays_prev")


QUERIES: dict[str, Query] = {name: _chart(name) for name in CHARTS}
QUERIES |= {
    "today_hours": today_hours,
    "today_so_far": today_so_far,
    "first_played": _told("first_played"),
    "last_told": _told("last_played"),
    "behind_1997": behind_1997,
    "last_clock": last_clock,
    "timeline_steps": timeline_steps,
    "genre_index": genre_index,
    "run_totals": run_totals,
    "stepped_back": stepped_back,
    "named_title": named_title,
    "named_artists": named_artists,
    "facts_1999": facts_1999,
    "bounds_1999": bounds_1999,
    "album_songs": album_songs,
    "scale_peak": _recent(lambda p: C.scale_peak(p, ChartSpec(range="7d", dimension="hour_of_day", metric="plays"))),
    "aligned_years": aligned_years,
    "genre_shares": genre_shares,
    "hour_intensity": hour_intensity,
    "merged_coverage": merged_coverage,
    "recovered": recovered,
    "uri_table": uri_table,
    "reread_days": reread_days,
    "prunable": prunable,
    "reconciled": reconciled,
    "gap_estimates": gap_estimates,
    "last_played": _history(profile.last_played),
    "week_stats": _recent(feed.week_stats),
    "artists_up": _recent(lambda p: feed.artist_movers(p, "up")),
    "artists_down": _recent(lambda p: feed.artist_movers(p, "down")),
    "songs_up": _recent(lambda p: feed.song_movers(_long_songs(p), "up")),
    "songs_down": _recent(lambda p: feed.song_movers(_long_songs(p), "down")),
    "discoveries": _recent(feed.discoveries),
    "song_discoveries": _recent(feed.song_discoveries),
    "back_in_rotation": _recent(feed.back_in_rotation),
    "songs_back_in_rotation": _recent(feed.songs_back_in_rotation),
    "on_repeat": _recent(feed.on_repeat),
    "artist_songs": _recent(feed.artist_songs),
    "weekly_feed": show_feed,
    "card": _history(profile.card),
    "card_genres": card_genres,
    "streaks": streaks,
    "top_tracks": _history(profile.top_tracks),
    "top_artists": _history(profile.top_artists),
    "top_albums": _history(profile.top_albums),
    "familiarity": _history(profile.artist_familiarity),
    "pins": pins,
    "shows_joined": shows_joined,
    "shows_filtered": shows_filtered,
    "namesakes": namesakes,
    "timeline": timeline,
    "resolved_names": resolved_names,
    "artist_weights": _history(lambda p: taste.artist_weights(p, 90)),
    "map_regions": map_regions,
    "listener_map": listener_map,
    "occupancy": occupancy,
    "coverage_of_space": coverage_of_space,
    "cohesion": cohesion,
    "positions": positions,
    "placed": placed,
    "twins": twins,
    "exemplars": exemplars,
    "corpus_tags": corpus_tags,
    "tag_says": tag_says,
    "tag_idf": tag_idf,
    "dominant": dominant,
    "labels_of_regions": labels_of_regions,
    "widened": widened,
    "serving_table": serving_table,
    "deduped_listings": deduped_listings,
    "heartbeats": heartbeats,
    "watched": watched,
    "spec_scores": spec_scores,
    "run_changes": run_changes,
    "matches": matches,
    "mode_pairs": mode_pairs,
    "profile_totals": profile_totals,
    "tag_rates": tag_rates,
    "short_titles": short_titles,
    "cells": cells,
    "modes": modes,
    "recommended": recommended,
    "winners_facts": winners_facts,
    "compared": compared,
    "captured": captured,
    "background": background,
    "gallery": gallery,
}
ORACLES: dict[str, str] = {k: v for k, v in O.ORACLES.items() if k in QUERIES}
