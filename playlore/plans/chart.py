"""Charts: a closed description of a question, and the DataFrame that answers it for all listeners.

``chart(plays, spec)`` filters once, aggregates once by listener and axis, and ranks inside
each listener.  Windows are anchored on each listener's newest play; whatever depends on the
clock takes ``as_of``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playlore.functions import expressions as X
from playlore.schema import LISTEN_MS, RATE_SAMPLE, TABLE_CAP, TRACK_PREFIX, ZONE

METRICS = ("hours", "plays", "distinct_tracks", "distinct_artists", "skip_rate")
DIMENSIONS = ("artist", "album", "track", "genre", "platform", "hour_of_day", "day_of_week", "date")
ORDERED = ("hour_of_day", "day_of_week", "date")
GRAINS = ("day", "week", "month", "year")
RANGES = {"7d": "7 days", "30d": "30 days", "90d": "90 days", "6mo": "6 months", "12mo": "12 months"}
STEPS = {"7d": 7, "30d": 30, "90d": 90}
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: Labels of an axis that several listeners share; fifty years have fewer days.
LABELS = 20_000
#: Lines of a split chart.
LINES = 6


@dataclass(frozen=True)
class ChartSpec:
    """What to count, along what, in which window, of which plays."""

    answer: str = "chart"  # chart, number, first_played, last_played, top, recent
    metric: str = "hours"
    dimension: str = "artist"
    grain: str | None = None
    range: str = "all"
    year: int | None = None
    last: int | None = None
    last_unit: str | None = None
    from_year: int | None = None
    to_year: int | None = None
    months: tuple[int, ...] = ()
    hours: tuple[int, ...] = ()
    days: tuple[str, ...] = ()
    artists: tuple[str, ...] = ()
    tracks: tuple[str, ...] = ()
    albums: tuple[str, ...] = ()
    genres: tuple[str, ...] = ()
    series: str = "none"
    per_period: bool = False
    cumulative: bool = False
    sort: str = "desc"
    limit: int = 10

    def validate(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.answer in ("chart", "number", "first_played", "last_played", "top", "recent"), f"unknown answer {self.answer}")
        need(self.metric in METRICS, f"unknown metric {self.metric}")
        need(self.dimension in DIMENSIONS, f"unknown dimension {self.dimension}")
        need(self.range in ("all", "today", "this_year", *RANGES), f"unknown range {self.range}")
        need(self.dimension != "date" or self.grain in GRAINS or self.range == "today", "a date axis needs a grain")
        need((self.last is None) == (self.last_unit is None), "last and last_unit go together")
        need(self.last_unit in (None, *GRAINS), f"unknown unit {self.last_unit}")
        need(self.to_year is None or self.from_year is not None, "to_year needs from_year")
        need(self.to_year is None or self.to_year >= (self.from_year or 0), "the span of years is reversed")
        ordered = self.dimension in ORDERED
        need(self.series == "none" or ordered, "series need an ordered axis")
        need(not self.per_period or (ordered and self.series != "none"), "per_period needs an ordered axis and a series")
        need(not self.cumulative or (ordered and self.metric in ("hours", "plays") and not self.per_period), "cumulative needs an ordered axis and a sum")
        need(len(self.artists) <= 12 and len(self.tracks) <= 12 and len(self.albums) <= 12, "at most twelve names")
        need(len(self.genres) <= 6, "at most six genres")
        need(1 <= self.limit <= 40, "limit is 1 to 40")
        need(all(1 <= m <= 12 for m in self.months) and all(0 <= h <= 23 for h in self.hours) and all(d in DAYS for d in self.days), "unknown part of the calendar")

    def effective(self) -> ChartSpec:
        """Today over dates is drawn by the hour."""
        return replace(self, dimension="hour_of_day", grain=None) if self.range == "today" and self.dimension == "date" else self

    @property
    def form(self) -> str:
        if self.per_period:
            return "table"
        return "line" if self.dimension == "date" or self.series != "none" or self.cumulative else "bar"

    @property
    def can_step_back(self) -> bool:
        return (self.range in STEPS or self.range == "today") and not (self.year or self.from_year or self.last)


def with_genres(plays: DataFrame, genres: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Left join of genres by artist, falling back to the first act of a credit.

    The names are looked up once each; the rows meet the names and their genres in one join.
    ``named`` has the names where they are cheaper to read than from ``plays``, as from the
    plays that these are sums of.
    """
    credits = (plays if named is None else named).select(F.col("artist_name").alias("__credit")).filter("__credit IS NOT NULL").distinct()
    named = genres.select(F.col("artist").alias("__artist"), F.col("genre").alias("__genre"))
    known = credits.withColumn("__key", F.lower("__credit")).join(named, F.col("__key") == F.col("__artist"), "left")
    first = F.element_at(X.credited_acts("__credit"), 1)
    lone = genres.select(F.col("artist").alias("__first"), F.col("genre").alias("__lone"))
    missed = known.filter("__genre IS NULL").select("__credit", first.alias("__act")).join(lone, F.col("__act") == F.col("__first"))
    found = known.filter("__genre IS NOT NULL").select("__credit", "__genre").unionByName(missed.select("__credit", F.col("__lone").alias("__genre")))
    return plays.join(found, F.col("artist_name") == F.col("__credit"), "left").withColumn("genre", F.col("__genre")).drop("__credit", "__genre")


def cover(regions: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """(genre, word): genres that a wanted word is, starts a word in, or dominates; first word wins.

    ``regions`` has genre and, optionally, tags: its dominant tags.
    """
    words = [w.strip().lower() for w in wanted]
    named = F.col("genre")
    hits = F.array(*[F.when((named == w) | named.rlike(r"(?<!\w)" + _quoted(w)) | (F.array_contains("tags", w) if "tags" in regions.columns else F.lit(False)), w) for w in words])
    return regions.select("genre", F.get(F.array_compact(hits), F.lit(0)).alias("word") if words else F.lit(None)).filter("word IS NOT NULL").distinct() if words else regions.select("genre", F.lit("").alias("word")).limit(0)


def _quoted(word: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in word)


def _shift(spec: ChartSpec) -> int:
    """Months at the end of a year that belong to the next one: chosen months across New Year."""
    chosen = set(spec.months)
    if not {12, 1} <= chosen or len(chosen) == 12:
        return 0
    n = 0
    while 12 - n in chosen:
        n += 1
    return n


def _season(spec: ChartSpec, at: Column) -> Column:
    n = _shift(spec)
    return at + F.make_ym_interval(F.lit(0), F.lit(n)) if n else at


def tips(plays: DataFrame) -> DataFrame:
    """(user_id, tip): each listener's newest play."""
    return plays.groupBy("user_id").agg(F.max("played_at").alias("tip"))


def between(plays: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Plays from the day before ``first`` to the day after ``last``, in UTC.

    A local day lies inside that, whatever the zone, so this drops nothing that a window on
    local time keeps; and it is about stored columns, so files and folders are skipped.
    """
    for day, step, kept in ((first, -1, lambda c, x: c >= x), (last, 2, lambda c, x: c < x)):
        if day is not None:
            edge = day + dt.timedelta(days=step)
            plays = plays.filter(kept(F.col("played_at"), F.lit(edge.isoformat()).cast("timestamp_ntz")))
            if "year" in plays.columns:
                plays = plays.filter(F.col("year") >= edge.year if step < 0 else F.col("year") <= edge.year)
    return plays


def _years(plays: DataFrame, spec: ChartSpec, first: int, last: int | None) -> DataFrame:
    """``between`` for seasons: a season's year begins some months before its calendar year."""
    n = _shift(spec)
    opens = dt.date(first - 1, 13 - n, 1) if n else dt.date(first, 1, 1)
    return between(plays, opens, dt.date(last, 12, 31) if last else None)


def windowed(plays: DataFrame, spec: ChartSpec, as_of: dt.datetime, zone: str = ZONE, back: int = 0) -> DataFrame:
    """Plays inside the window of the spec, with a column ``local``.  Year goes before a span, before last, before range."""
    on_clock = lambda rows: rows.withColumn("local", X.local("played_at", zone))
    rows = on_clock(plays)
    year = F.year(_season(spec, F.col("local")))
    clock = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit(as_of.isoformat(" ")).cast("timestamp_ntz"))
    if spec.year is not None:
        return on_clock(_years(plays, spec, spec.year, spec.year)).filter(year == spec.year)
    if spec.from_year is not None:
        return on_clock(_years(plays, spec, spec.from_year, spec.to_year)).filter((year >= spec.from_year) & (year <= spec.to_year if spec.to_year else F.lit(True)))
    if spec.last is not None:
        length = F.expr(f"INTERVAL {int(spec.last)} {spec.last_unit}")
        return rows.join(tips(plays), "user_id").filter(F.col("played_at") >= F.col("tip") - length)
    if spec.range == "today":
        day = as_of.date() - dt.timedelta(days=back)
        return on_clock(between(plays, day - dt.timedelta(days=1), day + dt.timedelta(days=1))).filter(F.to_date("local") == F.date_sub(F.to_date(clock), back))
    if spec.range == "this_year":
        return on_clock(_years(plays, spec, as_of.year - 1, as_of.year + 1)).filter(year == F.year(clock))
    if spec.range in RANGES:
        anchored = rows.join(tips(plays), "user_id")
        if back:
            step = STEPS[spec.range]
            return anchored.filter((F.col("played_at") >= F.col("tip") - F.expr(f"INTERVAL {(back + 1) * step} days")) & (F.col("played_at") < F.col("tip") - F.expr(f"INTERVAL {back * step} days")))
        return anchored.filter(F.col("played_at") >= F.col("tip") - F.expr(f"INTERVAL {RANGES[spec.range]}"))
    return rows


def _titled(plays: DataFrame, rows: DataFrame, column: str, names: tuple[str, ...], pinned: bool) -> DataFrame:
    """Rows of the named titles; without an artist, of the artist with most plays under each title."""
    named = plays.sparkSession.createDataFrame([(n,) for n in names], "typed string").select(X.title_key("typed").alias("title")).distinct()
    keyed = rows.withColumn("title", X.title_key(column))
    if pinned:
        return keyed.join(F.broadcast(named), "title", "left_semi").drop("title")
    counted = plays.withColumn("title", X.title_key(column)).join(F.broadcast(named), "title", "left_semi").filter("artist_name IS NOT NULL").groupBy("user_id", "title", "artist_name").count()
    order = Window.partitionBy("user_id", "title").orderBy(F.desc("count"), "artist_name")
    chosen = counted.withColumn("r", F.row_number().over(order)).filter("r = 1").select("user_id", "title", "artist_name")
    return keyed.join(chosen, ["user_id", "title", "artist_name"], "left_semi").drop("title")


def _condenses(spec: ChartSpec) -> bool:
    """Whether a chart by genre can meet the genres after its plays were added up: sums along one axis do."""
    plain = spec.answer == "chart" and not spec.per_period and spec.metric in ("hours", "plays")
    axes = {spec.dimension, spec.series} - {"none"}
    return plain and "genre" in axes and axes <= {"genre", "date", "day_of_week", "hour_of_day", "artist"}


def condensed(rows: DataFrame, spec: ChartSpec) -> DataFrame:
    """Plays of an artist in one bucket as one row: user_id, artist_name, local, ms_played, n.

    A hot artist is then no more rows of the join with the genres than there are listeners and buckets.
    """
    if _needs_floor(spec.metric):
        rows = rows.filter(F.col("ms_played") >= LISTEN_MS)
    unit = "hour" if "hour_of_day" in (spec.dimension, spec.series) else "day"
    if spec.dimension == "date" and unit == "day" and spec.series != "day_of_week" and not _shift(spec):
        unit = spec.grain or "day"
    at = F.date_trunc(unit, "local") if {spec.dimension, spec.series} & set(ORDERED) else F.lit(None).cast("timestamp_ntz")
    return rows.groupBy("user_id", "artist_name", at.alias("local")).agg(F.sum("ms_played").alias("ms_played"), F.count("*").alias("n"))


def selected(plays: DataFrame, spec: ChartSpec, genres: DataFrame | None = None, as_of: dt.datetime | None = None, zone: str = ZONE, back: int = 0, condense: bool = False) -> DataFrame:
    """The plays a spec is about, before the listen floor; with ``condense`` sums of them where the spec allows."""
    rows = windowed(plays, spec, as_of or dt.datetime(1970, 1, 1), zone, back).filter("artist_name IS NOT NULL")
    if 0 < len(set(spec.months)) < 12:
        rows = rows.filter(F.month("local").isin(*spec.months))
    if 0 < len(set(spec.hours)) < 24:
        rows = rows.filter(F.hour("local").isin(*spec.hours))
    if 0 < len(set(spec.days)) < 7:
        rows = rows.filter(F.expr("extract(DAYOFWEEK_ISO FROM local)").isin(*[DAYS.index(d) + 1 for d in spec.days]))
    if spec.artists:
        rows = rows.filter(F.lower("artist_name").isin(*[a.strip().lower() for a in spec.artists]))
    for column, names in (("track_name", spec.tracks), ("album_name", spec.albums)):
        if names:
            rows = _titled(plays, rows, column, names, bool(spec.artists))
    if spec.genres or "genre" in (spec.dimension, spec.series):
        if genres is None:
            raise ValueError("this chart needs genres")
        each = rows
        if condense and _condenses(spec):
            rows = condensed(rows, spec)
        rows = with_genres(rows, genres, each).filter("genre IS NOT NULL")
        if spec.genres:
            covered = cover(genres, spec.genres)
            rows = rows.join(covered, "genre")
            if "genre" in (spec.dimension, spec.series):
                rows = rows.withColumn("genre", F.col("word"))
    return rows


def _metric(metric: str, rows: DataFrame | None = None) -> Column:
    """A metric's value; ``rows`` may be sums of plays, with their number in ``n``."""
    if metric == "plays" and rows is not None and "n" in rows.columns:
        return F.sum("n").cast("double")
    skip = F.when(F.col("skipped"), 1.0).when(~F.col("skipped"), 0.0)
    return {
        "hours": F.sum("ms_played") / 3600000.0,
        "plays": F.count("*").cast("double"),
        "distinct_tracks": F.countDistinct("track_uri").cast("double"),
        "distinct_artists": F.countDistinct("artist_name").cast("double"),
        "skip_rate": F.avg(skip) * 100,
    }[metric]


def _strength(metric: str, rows: DataFrame | None = None) -> Column:
    """What a metric's values are ranked by: exact, and not rounded as they are shown."""
    return F.sum("ms_played") if metric == "hours" else _metric(metric, rows)


def _needs_floor(metric: str) -> bool:
    return metric in ("plays", "distinct_tracks", "distinct_artists")


def _axis(spec: ChartSpec, name: str) -> tuple[Column, Column]:
    """Label and second label (the artist of a song or album) of an axis."""
    none = F.lit(None).cast("string")
    local = F.col("local")
    return {
        "artist": (F.col("artist_name"), none),
        "album": (F.col("album_name"), F.coalesce("artist_name", F.lit(""))),
        "track": (F.col("track_name"), F.coalesce("artist_name", F.lit(""))),
        "genre": (F.col("genre") if name == "genre" else none, none),
        "platform": (X.platform_family(), none),
        "hour_of_day": (F.hour(local).cast("string"), none),
        "day_of_week": (F.expr("extract(DAYOFWEEK_ISO FROM local)").cast("string"), none),
        "date": (F.date_format(F.date_trunc(spec.grain or "day", _season(spec, local)), "yyyy-MM-dd"), none),
    }[name]


def _ordinal(spec: ChartSpec, label: str = "label") -> Column:
    return F.col(label) if spec.dimension == "date" else F.col(label).cast("int")


def chart(plays: DataFrame, spec: ChartSpec, genres: DataFrame | None = None, as_of: dt.datetime | None = None, zone: str = ZONE, back: int = 0) -> DataFrame:
    """Answer of a spec for all listeners.

    A plain chart has user_id, rank, label, sub and value; one with series also series (and
    for tables plays).  rank runs inside each listener: by value and label on ranked axes, in
    natural order on ordered ones.
    """
    spec.validate()
    spec = spec.effective()
    if back and not spec.can_step_back:
        raise ValueError("this window can't be stepped back")
    rows = selected(plays, spec, genres, as_of, zone, back, condense=True)
    if spec.answer == "recent":
        return recent_runs(plays, spec, rows)
    if spec.answer in ("first_played", "last_played"):
        return first_or_last(plays, spec, rows, genres)
    if spec.answer == "number":
        return single_answer(rows)
    if spec.answer == "top":
        return winner(rows, spec)
    if _needs_floor(spec.metric) and "n" not in rows.columns:
        rows = rows.filter(F.col("ms_played") >= LISTEN_MS)
    if spec.per_period:
        return per_period(rows, spec)
    if spec.series != "none":
        return split(rows, spec)
    label, sub = _axis(spec, spec.dimension)
    made = rows.filter(label.isNotNull()).groupBy("user_id", label.alias("label"), sub.alias("sub")).agg(F.round(_metric(spec.metric, rows), 2).alias("value"), _strength(spec.metric, rows).alias("strength"), F.count("*").alias("n")).filter("value IS NOT NULL")
    shown = finished(made, spec, hour_of(as_of, zone) if spec.range == "today" and spec.year is None and not back and as_of else 23)
    if spec.dimension != "track":
        return shown
    theirs = rows.select("user_id", label.alias("label"), sub.alias("sub"), "track_uri")
    return with_most_played(shown, theirs, ["user_id", "label", "sub"])


def finished(made: DataFrame, spec: ChartSpec, last_hour: int = 23) -> DataFrame:
    """A chart's rows from what was counted: user_id, label, sub, value, strength and n.

    Ordered axes come whole, with hours up to ``last_hour``, others as their first bars.
    """
    if spec.metric == "skip_rate" and spec.dimension not in ORDERED:
        made = made.filter(F.col("n") >= RATE_SAMPLE)
    made = made.drop("n")
    if spec.dimension in ORDERED:
        made = made.drop("strength")
        if spec.dimension == "hour_of_day" and spec.metric != "skip_rate":
            made = every_hour(made, spec, last_hour)
        order = Window.partitionBy("user_id").orderBy(_ordinal(spec))
        made = made.withColumn("rank", F.row_number().over(order))
        if spec.cumulative:
            made = made.withColumn("value", F.round(F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2))
        return made
    order = Window.partitionBy("user_id").orderBy(_falling(spec, "strength"), "label", "sub")
    return made.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= spec.limit).drop("strength")


def _falling(spec: ChartSpec, column: str) -> Column:
    return F.desc(column) if spec.sort == "desc" else F.asc(column)


def with_most_played(shown: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """``shown`` with the ``uri`` most played in each of its groups; only plays of these groups are counted."""
    kept = rows.join(shown.select(*by), by, "left_semi")
    return shown.join(most_played(kept, by), by, "left").withColumnRenamed("track_uri", "uri")


def rows_behind(plays: DataFrame, spec: ChartSpec, genres: DataFrame | None = None, as_of: dt.datetime | None = None, zone: str = ZONE, back: int = 0) -> DataFrame:
    """(user_id, total_rows): how many plays a chart of the spec counts."""
    rows = selected(plays, spec.effective(), genres, as_of, zone, back)
    if _needs_floor(spec.metric):
        rows = rows.filter(F.col("ms_played") >= LISTEN_MS)
    return rows.groupBy("user_id").agg(F.count("*").alias("total_rows"))


def hour_of(as_of: dt.datetime, zone: str = ZONE) -> int:
    """The local hour of a UTC clock."""
    return as_of.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(zone)).hour


def every_hour(made: DataFrame, spec: ChartSpec, last: int = 23) -> DataFrame:
    """All hours asked for up to ``last``, for each listener that has any; hours without plays are 0.

    A chart of today ends at the current hour: those to come have not happened.
    """
    asked = [h for h in sorted(set(spec.hours)) or range(24) if h <= last]
    if not asked:
        return made.limit(0)
    spine = made.select("user_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(str(h)) for h in asked])))
    return spine.join(made, ["user_id", "label"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def per_period(rows: DataFrame, spec: ChartSpec) -> DataFrame:
    """The top of every period, newest period first, at most a table's rows for each listener.

    ``plays`` counts listens; where series are songs each cell has the uri of its most played
    track.  ``truncated`` says that the listener's table was full.
    """
    label, _ = _axis(spec, spec.dimension)
    series, sub = _axis(spec, spec.series)
    made = rows.filter(series.isNotNull()).groupBy("user_id", label.alias("label"), series.alias("series"), sub.alias("sub")).agg(F.round(_metric(spec.metric), 2).alias("value"), _strength(spec.metric).alias("strength"), F.count_if(F.col("ms_played") >= LISTEN_MS).alias("plays")).filter("value IS NOT NULL")
    inside = Window.partitionBy("user_id", "label").orderBy(_falling(spec, "strength"), "series", "sub")
    ranked = made.withColumn("rank", F.row_number().over(inside)).filter(F.col("rank") <= spec.limit).drop("strength")
    newest = Window.partitionBy("user_id").orderBy(_ordinal(spec).desc(), "rank")
    cells = ranked.withColumn("row", F.row_number().over(newest)).filter(F.col("row") <= TABLE_CAP)
    cells = cells.withColumn("truncated", F.count("*").over(Window.partitionBy("user_id")) >= TABLE_CAP)
    if spec.series != "track":
        return cells
    by = ["user_id", "label", "series", "sub"]
    theirs = rows.select("user_id", label.alias("label"), series.alias("series"), sub.alias("sub"), "track_uri")
    return with_most_played(cells, theirs, by)


def split(rows: DataFrame, spec: ChartSpec) -> DataFrame:
    """A line for each of the strongest series, or for the named artists; gaps filled.

    At most ``limit`` lines, and never more than six.  Lines are ranked by their total along
    the axis, unrounded, as decimals, so that equal totals are equal in whatever order they
    are added.  Named artists are lines in the order of the names, each once, with all their
    spellings counted together.  Missing points are 0 for sums and counts and null for rates.
    """
    label, _ = _axis(spec, spec.dimension)
    series, sub = _axis(spec, spec.series)
    key = F.concat_ws("\u001f", series, sub)
    most = min(spec.limit, LINES)
    named = spec.artists if spec.series == "artist" else ()
    if named:
        key = X.name_key(key)
    made = rows.filter(series.isNotNull()).groupBy("user_id", label.alias("label"), key.alias("series")).agg(F.round(_metric(spec.metric, rows), 2).alias("value"), _strength(spec.metric, rows).alias("strength")).filter("value IS NOT NULL")
    if named:
        first = dict.fromkeys(a.strip().lower() for a in [a for a in named if a.strip()][:most])
        wanted = rows.sparkSession.createDataFrame([(a, i) for i, a in enumerate(first, 1)], "series string, line int")
        lines = made.select("user_id").distinct().join(F.broadcast(wanted))
    else:
        total = made.groupBy("user_id", "series").agg(F.sum(F.col("strength").cast("decimal(28,6)")).alias("total"))
        order = Window.partitionBy("user_id").orderBy(F.desc("total"), "series")
        lines = total.withColumn("line", F.row_number().over(order)).filter(F.col("line") <= most).select("user_id", "series", "line")
    made = made.drop("strength")
    spine = made.select("user_id", "label").distinct().join(lines, "user_id")
    fill = F.lit(None).cast("double") if spec.metric == "skip_rate" else F.lit(0.0)
    filled = spine.join(made, ["user_id", "label", "series"], "left").withColumn("value", F.coalesce("value", fill))
    if spec.cumulative:
        run = Window.partitionBy("user_id", "series").orderBy(_ordinal(spec)).rowsBetween(Window.unboundedPreceding, 0)
        filled = filled.withColumn("value", F.round(F.sum("value").over(run), 2))
    return filled


def most_played(rows: DataFrame, by: list[str]) -> DataFrame:
    """The most played track of each group; ties go to the smaller uri.  Other things than tracks don't count."""
    counted = rows.filter(F.col("track_uri").startswith(TRACK_PREFIX)).groupBy(*by, "track_uri").agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.min_by("track_uri", F.struct(-F.col("n"), "track_uri")).alias("track_uri"))


def first_or_last(plays: DataFrame, spec: ChartSpec, rows: DataFrame, genres: DataFrame | None = None) -> DataFrame:
    """(user_id, day, status) for every listener: the first or last local day of the plays asked about.

    status is ``played``, ``not_in_window`` where the listener has played it at another time,
    and ``never``.
    """
    edge = F.min("local") if spec.answer == "first_played" else F.max("local")
    listens = lambda some: some.filter(F.col("ms_played") >= LISTEN_MS)
    inside = listens(rows).groupBy("user_id").agg(F.to_date(edge).alias("day"))
    always = replace(spec, range="all", year=None, last=None, last_unit=None, from_year=None, to_year=None, months=(), hours=(), days=())
    ever = listens(selected(plays, always, genres)).select("user_id").distinct().withColumn("ever", F.lit(True))
    told = plays.select("user_id").distinct().join(ever, "user_id", "left").join(inside, "user_id", "left")
    status = F.when(F.col("day").isNotNull(), "played").when(F.col("ever"), "not_in_window").otherwise("never")
    return told.select("user_id", "day", status.alias("status"))


def single_answer(rows: DataFrame) -> DataFrame:
    """One row for each listener: plays, hours, distinct tracks and artists, skips, first and last day."""
    listen = F.col("ms_played") >= LISTEN_MS
    known = F.when(F.col("skipped"), 1.0).when(~F.col("skipped"), 0.0)
    return rows.groupBy("user_id").agg(
        F.count_if(listen).alias("plays"),
        F.round(F.sum("ms_played") / 3600000.0, 2).alias("hours"),
        F.countDistinct(F.when(listen, F.col("track_uri"))).alias("tracks"),
        F.countDistinct(F.when(listen, F.col("artist_name"))).alias("artists"),
        F.round(F.avg(known) * 100, 2).alias("skip_rate"),
        F.count("skipped").alias("rated"),
        F.to_date(F.min(F.when(listen, F.col("local")))).alias("first_day"),
        F.to_date(F.max(F.when(listen, F.col("local")))).alias("last_day"),
    )


def winner(rows: DataFrame, spec: ChartSpec) -> DataFrame:
    """The first and the second by the metric, on any axis; nothing of zero unless ascending."""
    if _needs_floor(spec.metric):
        rows = rows.filter(F.col("ms_played") >= LISTEN_MS)
    label, sub = _axis(spec, spec.dimension)
    made = rows.filter(label.isNotNull()).groupBy("user_id", label.alias("label"), sub.alias("sub")).agg(F.round(_metric(spec.metric), 2).alias("value"), _strength(spec.metric).alias("strength"), F.count("*").alias("n")).filter("value IS NOT NULL")
    ordered = spec.dimension in ORDERED
    if spec.metric == "skip_rate" and not ordered:
        made = made.filter(F.col("n") >= RATE_SAMPLE)
    if spec.sort == "desc":
        made = made.filter("value > 0")
    # Points of an ordered axis are compared as they are drawn, bars by what they stand for.
    by = [_falling(spec, "value"), _ordinal(spec)] if ordered else [_falling(spec, "strength"), F.col("label"), F.col("sub")]
    order = Window.partitionBy("user_id").orderBy(*by)
    return made.drop("n").withColumn("rank", F.row_number().over(order)).filter("rank <= 2").drop("strength")


def winner_facts(rows: DataFrame, spec: ChartSpec) -> DataFrame:
    """The first by the metric, with what single answers say about it."""
    label, sub = _axis(spec, spec.dimension)
    first = winner(rows, spec).filter("rank = 1").select("user_id", F.col("label").alias("__label"), F.coalesce("sub", F.lit("")).alias("__sub"))
    keyed = rows.withColumns({"__label": label, "__sub": F.coalesce(sub, F.lit(""))})
    theirs = keyed.join(first, ["user_id", "__label", "__sub"], "left_semi")
    return single_answer(theirs).join(first.select("user_id", F.col("__label").alias("label")), "user_id")


def recent_runs(plays: DataFrame, spec: ChartSpec, rows: DataFrame) -> DataFrame:
    """Newest listens with consecutive repeats of a song folded; runs are found before filters.

    A song is its uri, or its title and artist where it has none.  Runs are numbered from the
    newest, so without filters the first ones are the answer.
    """
    key = ("user_id", "played_at", "track_uri", "ms_played")
    newest = Window.partitionBy("user_id").orderBy(F.desc("played_at"), F.desc("track_uri"), F.desc("ms_played"))
    song = F.coalesce("track_uri", F.concat_ws("\u001f", "track_name", F.coalesce("artist_name", F.lit(""))))
    every = plays.filter((F.col("ms_played") >= LISTEN_MS) & F.col("track_name").isNotNull()).select(*key, "track_name", "artist_name", song.alias("song"))
    marked = every.withColumn("fresh", (~F.col("song").eqNullSafe(F.lag("song").over(newest))).cast("int"))
    runs = marked.withColumn("run", F.sum("fresh").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    if replace(spec, answer="chart", limit=10, metric="hours") != ChartSpec():
        runs = runs.join(rows.select(*key).distinct(), list(key), "left_semi")
    else:
        runs = runs.filter(F.col("artist_name").isNotNull())
    at = F.struct("played_at", "track_uri", "ms_played")
    folded = runs.groupBy("user_id", "run").agg(F.max("played_at").alias("played_at"), F.max_by("track_name", at).alias("label"), F.max_by("artist_name", at).alias("sub"), F.count("*").alias("times"))
    order = Window.partitionBy("user_id").orderBy("run")
    shown = folded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= spec.limit)
    return shown.select("user_id", "rank", "label", "sub", "times", F.date_format("played_at", "yyyy-MM-dd'T'HH:mm:ss").alias("played_at"))


def scale_peak(plays: DataFrame, spec: ChartSpec, zone: str = ZONE) -> DataFrame:
    """Largest bar over all windows of the spec's length, so that stepping back keeps one scale."""
    step = STEPS[spec.range]
    rows = selected(plays, replace(spec, range="all"), zone=zone).join(tips(plays), "user_id")
    if _needs_floor(spec.metric):
        rows = rows.filter(F.col("ms_played") >= LISTEN_MS)
    age = F.floor(F.datediff("tip", "played_at") / step)
    by_hour = rows.groupBy("user_id", age.alias("window"), F.hour("local").alias("hour")).agg(F.round(_metric(spec.metric), 2).alias("v"))
    whole = by_hour.groupBy("user_id", "window").agg((F.sum("v") if spec.cumulative else F.max("v")).alias("v"))
    return whole.groupBy("user_id").agg(F.round(F.max("v"), 2).alias("peak"))


def facts(rows: DataFrame) -> DataFrame:
    """Distinct artists and songs of a window and, over 62 days or more, its busiest month."""
    listens = rows.filter(F.col("ms_played") >= LISTEN_MS)
    month = F.date_format("local", "yyyy-MM")
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), F.desc("month"))
    busiest = listens.groupBy("user_id", month.alias("month")).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).filter("r = 1").select("user_id", "month")
    whole = listens.groupBy("user_id").agg(F.countDistinct("artist_name").alias("artists"), F.countDistinct("track_uri").alias("songs"), F.datediff(F.max("local"), F.min("local")).alias("span"))
    return whole.join(busiest, "user_id").select("user_id", "artists", "songs", F.when(F.col("span") > 62, F.col("month")).alias("busiest_month"))


def window_bounds(plays: DataFrame, rows: DataFrame, zone: str = ZONE) -> DataFrame:
    """First and last local day inside a window, and whether anything was played before it."""
    inside = rows.groupBy("user_id").agg(F.to_date(F.min("local")).alias("first_day"), F.to_date(F.max("local")).alias("last_day"), F.min("played_at").alias("opens"))
    whole = plays.groupBy("user_id").agg(F.min("played_at").alias("oldest"))
    return inside.join(whole, "user_id").select("user_id", "first_day", "last_day", (F.col("oldest") < F.col("opens")).alias("earlier"))


def aligned(lines: DataFrame, fill: str = "zero") -> DataFrame:
    """Several listeners' lines on the union of their labels; gaps are 0, null, or the last value."""
    labels = lines.select("label").distinct()
    if labels.limit(LABELS + 1).count() > LABELS:
        raise ValueError(f"lines are aligned on at most {LABELS} labels")
    spine = lines.select("user_id").distinct().join(F.broadcast(labels))
    joined = spine.join(lines, ["user_id", "label"], "left")
    if fill == "zero":
        return joined.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if fill == "carry":
        before = Window.partitionBy("user_id").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
        return joined.withColumn("value", F.coalesce(F.last("value", ignorenulls=True).over(before), F.lit(0.0)))
    return joined


def shares(made: DataFrame) -> DataFrame:
    """Each series as a share of its bucket, in percent; null where the bucket is empty.

    Values have two places and are added and divided as decimals: a share that ends in a half
    is rounded up, in whatever order the bucket was added.
    """
    bucket = Window.partitionBy("user_id", "label")
    value = F.col("value").cast("decimal(16,2)")
    whole = F.sum("value").over(bucket)
    exact = made.withColumn("value", value)
    share = F.round(F.col("value") * 100 / F.nullif(whole, F.lit(0).cast("decimal(26,2)")), 2)
    return exact.withColumn("share", share.cast("double")).withColumn("value", F.col("value").cast("double"))


def intensity(made: DataFrame) -> DataFrame:
    """Each value against the listener's largest."""
    return made.withColumn("intensity", F.round(F.col("value") / F.nullif(F.max("value").over(Window.partitionBy("user_id")), F.lit(0.0)), 4))
