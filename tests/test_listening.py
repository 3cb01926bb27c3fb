"""Charts, feed, profile and ingest on small histories with counts known by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from playlore import schema as S
from playlore.functions import expressions as X
from playlore.functions.similarity import jaro_winkler_pair
from playlore.operators import feed, profile, scoring, taste
from playlore.plans import chart as C
from playlore.plans.chart import ChartSpec, chart
from playlore.sources import ingest
from playlore.sources.store import DayStore

T0 = dt.datetime(2024, 1, 15, 18)


def plays(spark, rows):
    """rows: (user, time, title, artist, ms, skipped)"""
    made = [(u, t, f"track:{n}", n, a, "album", ms, "Windows 10", s, "export") for u, t, n, a, ms, s in rows]
    return spark.createDataFrame(made, S.PLAYS)


@pytest.fixture(scope="module")
def history(spark):
    rows = [(1, T0 + dt.timedelta(days=9 * i), "Stay", "Ann", 60_000, None if i % 4 == 0 else i % 4 == 1) for i in range(12)]
    rows += [(1, T0 + dt.timedelta(days=9 * i, hours=1), "Stay (Remix)", "Bob", 10_000, True) for i in range(3)]
    rows += [(2, T0, "Other", None, 60_000, None)]
    return plays(spark, rows)


def test_hours_count_every_play_and_plays_count_listens(history):
    hours = {(r.user_id, r.label): r.value for r in chart(history, ChartSpec()).collect()}
    counts = {(r.user_id, r.label): r.value for r in chart(history, ChartSpec(metric="plays")).collect()}
    assert hours == {(1, "Ann"): 0.2, (1, "Bob"): 0.01}
    assert counts == {(1, "Ann"): 12.0}


def test_rates_leave_unknown_out(history):
    r = chart(history, ChartSpec(answer="number", artists=("ann",))).first()
    assert (r.rated, r.skip_rate, r.plays) == (9, 33.33, 12)


def test_windows_are_anchored_on_each_listener(history):
    got = chart(history, ChartSpec(range="30d", metric="plays")).collect()
    assert [(r.user_id, r.value) for r in got] == [(1, 4.0)]
    assert [r.value for r in chart(history, ChartSpec(range="7d", metric="plays"), back=1).collect()] == [1.0]
    assert chart(history, ChartSpec(range="7d", metric="plays"), back=4).count() == 0


def test_title_is_pinned_to_the_artist_with_most_plays(history):
    got = chart(history, ChartSpec(tracks=("stay",), metric="plays")).collect()
    assert [(r.label, r.value) for r in got] == [("Ann", 12.0)]


@pytest.mark.parametrize("spec", [ChartSpec(dimension="date"), ChartSpec(last=3), ChartSpec(to_year=2000), ChartSpec(from_year=2001, to_year=2000), ChartSpec(series="artist"), ChartSpec(per_period=True), ChartSpec(cumulative=True), ChartSpec(limit=0), ChartSpec(genres=tuple("abcdefg"))])
def test_specs_that_mean_nothing_are_refused(history, spec):
    with pytest.raises(ValueError):
        chart(history, spec)


def test_runs_are_folded_before_filters(spark):
    t = lambda m: T0 + dt.timedelta(minutes=m)
    p = plays(spark, [(1, t(0), "A", "x", 60_000, None), (1, t(1), "A", "x", 60_000, None), (1, t(2), "B", "y", 60_000, None), (1, t(3), "A", "x", 5_000, None), (1, t(4), "A", "x", 40_000, None)])
    runs = lambda **k: [(r.label, r.times, r.played_at[-5:]) for r in chart(p, ChartSpec(answer="recent", **k)).orderBy("rank").collect()]
    # What is under half a minute is no listen; the runs of A are two although the filter leaves nothing between.
    assert runs(artists=("x",)) == [("A", 1, "04:00"), ("A", 2, "01:00")]
    assert runs() == [("A", 1, "04:00"), ("B", 1, "02:00"), ("A", 2, "01:00")]
    bare = p.withColumn("track_uri", F.lit(None).cast("string"))
    assert [r.times for r in chart(bare, ChartSpec(answer="recent")).orderBy("rank").collect()] == [1, 1, 2]


def test_a_chart_of_today_ends_at_the_current_hour(spark):
    p = plays(spark, [(1, dt.datetime(2024, 1, 15, 14), "A", "x", 60_000, None)])
    day = lambda **k: [r.label for r in chart(p, ChartSpec(range="today", dimension="date", metric="plays"), **k).orderBy("rank").collect()]
    assert day(as_of=dt.datetime(2024, 1, 15, 16, 30)) == [str(h) for h in range(12)]
    assert len(day(as_of=dt.datetime(2024, 1, 16, 16, 30), back=1)) == 24


def test_first_and_last_played_tell_never_from_not_then(history):
    ask = lambda **k: {r.user_id: (str(r.day), r.status) for r in chart(history, ChartSpec(**k)).collect()}
    assert ask(answer="first_played", artists=("ann",)) == {1: ("2024-01-15", "played"), 2: ("None", "never")}
    assert ask(answer="last_played", artists=("ann",), year=2020)[1] == ("None", "not_in_window")
    assert ask(answer="last_played", artists=("ann",))[1][0] == "2024-04-23"


def test_equal_totals_are_ranked_by_name_whatever_the_order_of_addition(spark):
    parts = {"b": (0.1, 0.2, 0.3), "a": (0.3, 0.2, 0.1)}
    rows = [(1, dt.datetime(2001 + i, 6, 1), "t", a, int(h * 3_600_000), None) for a, hours in parts.items() for i, h in enumerate(hours)]
    got = chart(plays(spark, rows), ChartSpec(dimension="date", grain="year", series="artist", limit=1)).collect()
    assert {r.series for r in got} == {"a"}


def test_windows_reach_the_folders_of_a_stored_table(history, spark, tmp_path):
    history.withColumn("year", F.year("played_at")).write.partitionBy("year").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    for spec in (ChartSpec(year=2024, metric="plays"), ChartSpec(months=(12, 1), year=2024, metric="plays"), ChartSpec(from_year=2023, to_year=2024, metric="plays")):
        made = chart(stored, spec)
        assert sorted(map(str, made.collect())) == sorted(map(str, chart(history, spec).collect()))
        assert "PartitionFilters: [isnotnull(year" in made._jdf.queryExecution().executedPlan().toString()


def test_stored_plays_are_made_again_if_they_are_gone(spark):
    from playlore.functions.shared import file_system
    from playlore.sources import adapters

    sf = "/root/testdata/sf0.001"
    n = adapters.history(spark, sf).count()
    path, _ = adapters._stored[spark.sparkContext.applicationId, sf, "plays"]
    system, at = file_system(spark, path)
    system.delete(at, True)
    assert adapters.history(spark, sf).count() == n == adapters.joined_history(spark, sf).count()


def test_a_day_line_starts_at_nothing_and_ends_with_the_day(spark):
    p = plays(spark, [(1, dt.datetime(2024, 1, 15, 15), "A", "x", 1_800_000, None), (1, dt.datetime(2024, 1, 15, 15, 15), "B", "x", 1_800_000, None)])
    line = lambda **k: [(r["at"], r["value"]) for r in profile.day_timeline(p, dt.date(2024, 1, 15), **k).orderBy("n").collect()]
    assert line() == [(0.0, 0.0), (9.5, 0.0), (10.0, 0.5), (10.0, 0.5), (10.25, 1.0), (24.0, 1.0)]
    assert line(metric="plays", as_of=dt.datetime(2024, 1, 15, 17))[-3:] == [(10.25, 1.0), (10.25, 2.0), (12.0, 2.0)]


def test_winter_belongs_to_the_year_it_ends_in(spark):
    p = plays(spark, [(1, dt.datetime(2022, 12, 20, 12), "A", "x", 60_000, None), (1, dt.datetime(2023, 1, 20, 12), "A", "x", 60_000, None)])
    got = chart(p, ChartSpec(months=(12, 1, 2), dimension="date", grain="year", metric="plays")).collect()
    assert [(r.label, r.value) for r in got] == [("2023-01-01", 2.0)]


def test_local_time_follows_the_clock_change(spark):
    p = plays(spark, [(1, dt.datetime(2024, 3, 9, 17), "A", "x", 60_000, None), (1, dt.datetime(2024, 3, 10, 17), "A", "x", 60_000, None)])
    assert [r.h for r in p.select(F.hour(X.local("played_at")).alias("h")).orderBy("h").collect()] == [12, 13]


def test_title_keys_and_platforms(spark):
    titles = ["Rock & Roll - Live", "(Intro)", "It’s  Me [Demo]"]
    d = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in d.select(X.title_key("t")).collect()] == ["rock and roll", "intro", "its me"]
    p = spark.createDataFrame([("iOS 14 (iPhone)",), ("Windows 10",), ("OS X",), ("web_player",), ("tv",)], "platform string")
    assert [r[0] for r in p.select(X.platform_family()).collect()] == ["iOS", "Windows", "Mac", "Web", "Other"]


def test_jaro_winkler_values():
    assert round(jaro_winkler_pair("martha", "marhta"), 4) == 0.9611
    assert round(jaro_winkler_pair("dixon", "dicksonx"), 4) == 0.8133
    assert jaro_winkler_pair("abc", "xyz") == 0.0


def test_streak_bridges_what_no_source_saw(spark):
    day = lambda d: dt.datetime(2024, 1, d, 17)
    p = plays(spark, [(1, day(d), "A", "x", 60_000, None) for d in (1, 2, 6, 7)])
    now = dt.datetime(2024, 1, 8, 17)
    assert profile.day_streak(p, now).first().streak == 2
    gaps = spark.createDataFrame([(1, dt.date(2024, 1, 2), dt.date(2024, 1, 6))], "user_id long, after date, before date")
    assert profile.day_streak(p, now, gaps=gaps).first().streak == 7
    assert profile.day_streak(p, dt.datetime(2024, 1, 10, 17)).first().streak == 0
    # The gap between the export's last day and capture's first is derived from the plays, and short plays make days too.
    both = p.withColumns({"source": F.when(F.dayofmonth("played_at") <= 2, "export").otherwise("live"), "ms_played": F.lit(5).cast("long")})
    assert profile.day_streak(both, now).first().streak == 7


def test_show_filter_keeps_what_it_does_not_know(spark):
    rows = [(1, "a", dt.date(2024, 2, 1), None, None, None, "new"), (1, "b", dt.date(2024, 2, 1), 80.0, 10, "rock", "regular"), (1, "c", None, 10.0, 10, "rock", "favorite"), (1, "d", dt.date(2025, 2, 1), 10.0, 10, "rock", "heard")]
    shows = spark.createDataFrame(rows, "user_id long, artist string, date date, distance_mi double, fans long, genre string, familiarity string")
    names = lambda **k: sorted(r.artist for r in profile.filter_shows(shows, dt.date(2024, 1, 20), **k).collect())
    assert names() == ["a", "c"]
    assert names(radius_mi=100) == ["a", "b", "c"]
    assert names(max_fans=50) == ["c"]
    assert names(familiarity="new") == ["a"]
    assert names(familiarity="regular", radius_mi=100) == ["b", "c"]
    with pytest.raises(ValueError):
        names(min_fans=5, max_fans=1)


def test_better_source_wins_for_its_period(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    row = lambda d, ms: (1, at(d), "track:t", "t", "a", "b", ms, None, None, None)
    export = spark.createDataFrame([row(1, 1), row(3, 1)], S.PLAYS)
    account = spark.createDataFrame([(1, at(2), "t", "a", 2), (1, at(4), "t", "a", 2)], "user_id long, played_at timestamp_ntz, track_name string, artist_name string, ms_played long")
    live = spark.createDataFrame([row(3, 3), row(4, 3), row(5, 3)], S.PLAYS)
    got = sorted((r.played_at.day, r.source) for r in ingest.merge_sources(export, account, live).collect())
    assert got == [(1, "export"), (3, "export"), (4, "account"), (5, "live")]
    assert ingest.merge_sources(live=live).count() == 3
    with pytest.raises(ingest.IngestError):
        ingest.merge_sources()


def test_export_is_read_and_replaced_only_when_verified(spark, tmp_path):
    src = tmp_path / "e.json"
    good = {"ts": "2024-01-01T10:00:00Z", "ms_played": 40_000, "track_uri": "track:1", "master_metadata_track_name": "T", "master_metadata_album_artist_name": "A", "ip_addr": "1.2.3.4"}
    src.write_text(json.dumps([good, {**good, "track_uri": None}, {"ts": "2024-01-02T10:00:00Z", "track_uri": "episode:1"}]))
    rows = ingest.read_export(spark, str(src), 1)
    assert rows.count() == 2 and "ip_addr" not in rows.columns
    folder = str(tmp_path / "store")
    told = ingest.store_verified(rows, folder)
    assert (told["rows"], told["kept"]) == (2, 2)
    with pytest.raises(ingest.IngestError):
        ingest.store_verified(rows.filter("track_name IS NULL"), folder)
    assert ingest.current_load(spark, folder).count() == 2


def test_days_are_replaced_whole(spark, tmp_path):
    folder = str(tmp_path / "days")
    since = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "user_id long, first_day date")
    row = lambda d, u: (1, dt.datetime(2024, 1, d, 10), u, "t", "a", "b", 1000)
    shape = "user_id long, played_at timestamp_ntz, track_uri string, track_name string, artist_name string, album_name string, ms_played long"
    pull = lambda rows: sorted((r.user_id, r.day) for r in ingest.replace_days(spark, spark.createDataFrame(rows, shape), folder, since).collect())
    assert pull([row(1, "x"), row(2, "y")]) == [(1, "2024-01-01"), (1, "2024-01-02")]
    assert pull([row(1, "x"), row(2, "z"), row(2, "y")]) == [(1, "2024-01-02")]
    assert pull([row(1, "x")]) == [(1, "2024-01-02")]
    store = DayStore(spark, folder, spark.createDataFrame([], shape).schema)
    assert [r.track_uri for r in store.read().collect()] == ["x"] and len(store.current()) == 1
    # A pull from later on leaves earlier days alone, and a reader of the old version keeps it.
    before = store.read()
    since = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (2, dt.date(2024, 1, 5))], "user_id long, first_day date")
    assert pull([row(1, "ignored"), row(7, "w"), (2, dt.datetime(2024, 2, 3), "v", "t", "a", "b", 5)]) == [(1, "2024-01-07"), (2, "2024-02-03")]
    assert sorted(r.track_uri for r in store.read().collect()) == ["v", "w", "x"] and before.count() == 1


def test_stored_plays_are_made_again_if_the_tables_change(spark, tmp_path):
    import shutil

    import pyarrow.parquet as pq

    from playlore.sources import adapters

    folder = tmp_path / "tables"
    folder.mkdir()
    for name in ("lineitem", "orders", "part", "supplier"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", folder / f"{name}.parquet")
    whole = adapters.history(spark, str(folder)).count()
    assert adapters.history(spark, str(folder)).count() == whole
    lines = pq.read_table(folder / "lineitem.parquet")
    pq.write_table(lines.slice(0, lines.num_rows // 2), folder / "lineitem.parquet")
    assert 0 < adapters.history(spark, str(folder)).count() < whole


def test_measured_plays_replace_estimates_near_them(spark):
    shape = "user_id long, played_at timestamp_ntz, track_uri string, track_name string, artist_name string, ms_played long"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    w = spark.createDataFrame([(1, at(29), "u", "T", "A", 1)], shape)
    e = spark.createDataFrame([(1, at(59), "u", "x", "y", 2), (1, at(60), "u", "x", "y", 2), (1, at(0), "v", " t ", "a", 2), (2, at(29), "u", "T", "A", 2)], shape)
    got = sorted((r.user_id, r.how, r.played_at.second + 60 * r.played_at.minute) for r in ingest.reconcile(w, e).collect())
    assert got == [(1, "recent", 60), (1, "watch", 29), (2, "recent", 29)]


def test_recent_payload_and_gap_estimate(spark):
    item = lambda t, d: {"played_at": f"2024-01-01T10:{t}.000Z", "track": {"uri": "u" + t, "name": "n", "duration_ms": d, "artists": [{"name": "A"}, {"name": "B"}], "album": {"name": "al"}}}
    body = json.dumps({"items": [item("10:45", 200_000), item("10:00", 300_000), item("05:00", 200_000)]})
    rows = ingest.flatten_recent(spark.createDataFrame([(1, body)], "user_id long, body string"))
    got = ingest.estimate_heard(rows).orderBy("played_at").collect()
    assert [r.ms_played for r in got] == [200_000, 300_000, 45_000] and got[0].artist_name == "A, B"


def test_event_listings_keep_the_richest_copy(spark):
    base = {"name": "Fest", "dates": {"start": {"localDate": "2024-05-01"}}}
    rich = {**base, "dates": {"start": {"localDate": "2024-05-01", "localTime": "20:00:00"}}, "_embedded": {"attractions": [{"name": "Head"}, {"name": "S1"}, {"name": "S2"}, {"name": "S3"}, {"name": "S4"}], "venues": [{"name": "Hall"}]}}
    poor = {**base, "_embedded": {"attractions": [{"name": "Head"}]}}
    rows = spark.createDataFrame([(1, json.dumps(poor)), (2, json.dumps(rich)), (3, json.dumps(base))], "fetched long, body string")
    got = {r.artist: r for r in ingest.normal_events(rows).collect()}
    assert set(got) == {"Head", "Fest"} and got["Head"].venue == "Hall" and got["Head"].support == ["S1", "S2", "S3"]


def test_event_listings_are_one_for_names_of_either_case_and_choose_their_image(spark):
    def body(**more):
        return json.dumps({"dates": {"start": {"localDate": "2024-05-01"}}, **more})

    images = [{"url": "widest", "width": 2048, "ratio": "16_9"}, {"url": "large", "width": 1024, "ratio": "3_2"}, {"url": "near", "width": 620, "ratio": "3_2"}, {"url": "exact", "width": 640, "ratio": "16_9"}]
    links = {"site": [{"url": "https://x.org/a"}], "music": [{"url": "https://y.org/artist/Ab1"}]}
    rows = [
        (1, body(name="Act", priceRanges=[{"min": 0, "max": 40.9}], distance=0)),
        (2, body(name="ACT", images=images, distance=3.14, url="u", _embedded={"venues": [{"name": "Hall", "city": {"name": "Town"}, "location": {"latitude": "1.5", "longitude": "-2"}}]})),
        (3, body(name="act", priceRanges=[{"min": 12.7, "max": 40.9}], images=[{"url": "only"}])),
        (4, body(name=None)),
        (5, body(name="x", _embedded={"attractions": [{"name": "Linked", "externalLinks": links, "images": images[:1], "upcomingEvents": {"_total": 7}}]})),
        (6, json.dumps({"name": "no date"})),
        (7, None),
    ]
    got = {r.artist: r for r in ingest.normal_events(spark.createDataFrame(rows, "fetched long, body string")).collect()}
    assert set(got) == {"ACT", "Unknown", "Linked"}
    act = got["ACT"]
    assert (act.image, act.distance_mi, act.city, act.lat, act.lon, act.url, act.price_min) == ("near", 3.1, "Town", 1.5, -2.0, "u", None)
    assert (got["Linked"].external_id, got["Linked"].image, got["Linked"].upcoming_total) == ("Ab1", "widest", 7)
    poorer = ingest.normal_events(spark.createDataFrame(rows[:1] + rows[2:3], "fetched long, body string")).first()
    assert (poorer.artist, poorer.price_min, poorer.price_max, poorer.image) == ("act", 12, 40, "only")


def test_ranks_go_by_values_that_are_not_rounded(spark):
    t = [(1, T0, "s", "Aaa", 36_001_000, None), (1, T0, "s", "Zzz", 36_010_000, None)]
    own = plays(spark, t)
    assert [(r.label, r.value) for r in chart(own, ChartSpec(limit=1)).collect()] == [("Zzz", 10.0)]
    assert [r.label for r in chart(own, ChartSpec(answer="top")).orderBy("rank").collect()] == ["Zzz", "Aaa"]
    cells = chart(own, ChartSpec(dimension="date", grain="year", series="artist", per_period=True, limit=1)).collect()
    assert [(r.series, r.value) for r in cells] == [("Zzz", 10.0)]
    lines = chart(own, ChartSpec(dimension="date", grain="year", series="artist", limit=1)).collect()
    assert [r.series for r in lines] == ["Zzz"]


def test_named_lines_are_as_many_as_asked_once_each_and_rates_are_not_added(spark):
    rows = [(1, T0, "s", "x", 60_000, True), (1, T0, "s", "X", 60_000, True), (1, T0, "s", "y", 60_000, False)]
    names = ("X", "x", "nobody", "y", "a", "b", "c", "d")
    spec = ChartSpec(dimension="date", grain="year", series="artist", artists=names, metric="skip_rate")
    got = {r.series: (r.line, r.value) for r in chart(plays(spark, rows), C.replace(spec, limit=4)).collect()}
    assert got == {"x": (1, 100.0), "nobody": (2, None), "y": (3, 0.0)}
    assert len(chart(plays(spark, rows), C.replace(spec, limit=40)).collect()) == 5


def test_shares_end_in_a_half_rounded_up(spark):
    made = spark.createDataFrame([(1, "a", "x", 0.29), (1, "a", "y", 1.31), (1, "b", "x", 0.0)], "user_id long, label string, series string, value double")
    assert {(r.label, r.series): r.share for r in C.shares(made).collect()} == {("a", "x"): 18.13, ("a", "y"): 81.88, ("b", "x"): None}


@pytest.mark.parametrize(
    ("title", "short"),
    [
        *[(f"Song - {tail}", "Song") for tail in ("Instrumental", "Sped Up", "2010 Remastered Version", "Radio Edit", "Slowed + Reverb", "Re-Recorded", "Single Version", "Extended Mix", "Live at Home")],
        *[("Song (feat. Someone)", "Song"), ("Song [Live]", "Song"), ("Song (with A & B) - Remix", "Song")],
        *[(same, same) for same in ("Song (Interlude)", "(What's the Story)", "Song - Part One", "Alive - Delivered", "Mixed-up", "Live", "(Live)")],
        ("Song (Interlude) - Live", "Song (Interlude)"),
    ],
)
def test_version_tails(spark, title, short):
    assert spark.createDataFrame([(title,)], "t string").select(X.short_title("t")).first()[0] == short


def test_fan_counts_need_the_exact_name(spark):
    c = spark.createDataFrame([("A", "a", 5), ("A", "A", 9), ("A", "A b", 99), ("B", "x", 3), ("C", "c", 0)], "name string, found string, fans long")
    assert {r.name: r.fans for r in ingest.fan_counts(c).collect()} == {"A": 9, "B": None, "C": None}


def test_stamps_warn_of_differences(spark):
    t = ingest.stamped(spark.range(1), dims=200, seed=7)
    assert ingest.stamp_warnings(t, dims=200, seed=7) == []
    assert ingest.stamp_warnings(t, dims=100) == ["dims: 200 instead of 100"]
    assert ingest.stamp_warnings(spark.range(1), dims=1) == ["no stamp"]


def _space(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for g in range(3):
        for i in range(60):
            z = np.zeros(24)
            z[g * 8] = 1
            z += rng.normal(0, 0.05, 24)
            rows.append((f"g{g}-{i}", [f"tag{g}", f"more{g}", "x", "y"], (z / np.linalg.norm(z)).tolist()))
    return spark.createDataFrame(rows, "artist string, tags array<string>, z array<double>")


def test_one_genre_is_two_modes_at_least(spark):
    space = _space(spark).filter("artist LIKE 'g0%'")
    p = plays(spark, [(1, T0, "t", f"g0-{i}", 600_000, None) for i in range(60)])
    got = taste.listener_modes(p, space).collect()
    assert len(got) == 2 and all(r.label.startswith("more0, tag0") and r.tags == ["more0", "tag0", "x", "y"] for r in got)
    assert sum(r.artists for r in got) == 60 and abs(sum(r.hours for r in got) - 10) < 0.02


def test_recommendations_are_those_of_brute_force(spark):
    import numpy as np

    space = _space(spark)
    p = plays(spark, [(1, T0, "t", f"g{g}-{i}", 600_000, None) for g in range(2) for i in range(40)] + [(1, T0, "t", f"g2-{i}", 60_000, None) for i in range(57)])
    modes = taste.listener_modes(p, space)
    z = {r.artist: np.array(r.z) for r in space.collect()}
    played = {r[0] for r in p.select("artist_name").distinct().collect()}
    got = {}
    for r in taste.recommendations(modes, space, p).orderBy("rank").collect():
        got.setdefault(r["mode"], []).append(r.artist)
    for m in modes.collect():
        score = {a: min(v @ np.array(m.centre), max(v @ z[x] for x in m.members)) for a, v in z.items() if a not in played}
        assert got[m.mode] == sorted(score, key=lambda a: (-score[a], a))[:6]


def test_tags_are_cleaned(spark, tmp_path):
    (tmp_path / "tags.csv").write_text('artist,tags\nAnn,Hip-Hop;hip_hop; junk ;our songs\n ann ,"rock;Hip Hop;northern;junk;what our songs say"\nBob,\n,x\n')
    raw = ingest.read_tags(spark, str(tmp_path / "tags.csv"))
    assert [r.artist for r in raw.collect()] == ["ann"]
    assert taste.tag_corpus(raw).first().tags == ["rock", "hip hop", "northern", "junk", "what our songs say"]
    dropped = spark.createDataFrame([("northern",), ("junk",), ("junk",)], "tag string")
    assert taste.tag_corpus(raw, dropped=dropped, markers=("our", "my")).first().tags == ["rock", "hip hop"]
    every = spark.createDataFrame([(t,) for t in ("rock", "hip hop", "northern", "junk", "what our songs say")], "tag string")
    assert taste.tag_corpus(raw, dropped=every).count() == 0 and taste.tag_corpus(raw, min_tags=0, dropped=every).first().tags == []


def test_tags_whose_artists_differ_are_quiet(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    lists = [[f"g{i % 3}", *(f"g{i % 3}w{rng.integers(4)}" for _ in range(3)), *(["anyone"] if i % 2 else [])] for i in range(60)] + [["alone"], ["alone"], ["alone"]]
    corpus = spark.createDataFrame([(f"a{i}", t) for i, t in enumerate(lists)], "artist string, tags array<string>")
    matrix = taste.tag_matrix(corpus)
    rows = {}
    for r in matrix.collect():
        rows.setdefault(r.artist, {})[r.tag] = r.weight
    got = {r.tag: (r.artists, r.cohesion) for r in taste.tag_cohesion(matrix).collect()}
    for tag in {t for row in rows.values() for t in row}:
        left = [{t: w for t, w in row.items() if t != tag} for row in rows.values() if tag in row]
        unit = [{t: w / sum(v * v for v in row.values()) ** 0.5 for t, w in row.items()} for row in left if row]
        cosines = [sum(w * b.get(t, 0) for t, w in a.items()) for a, b in itertools.combinations(unit, 2)]
        assert got[tag][0] == len(left) and (got[tag][1] is None if not cosines else abs(got[tag][1] - np.mean(cosines)) < 1e-9)
    assert got["alone"] == (3, None)
    assert "anyone" in {r.tag for r in taste.quiet_tags(taste.tag_cohesion(matrix), below=0.5 * got["g1"][1]).collect()}


def test_account_files_are_read(spark, tmp_path):
    rows = [{"endTime": "2024-01-02 03:04", "artistName": "A", "trackName": "T", "msPlayed": 5}, {"endTime": None, "artistName": "A", "trackName": "T", "msPlayed": 5}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = ingest.read_account(spark, str(tmp_path / "a.json"), 7).collect()
    assert [(r.user_id, r.played_at, r.track_name, r.artist_name, r.ms_played) for r in got] == [(7, dt.datetime(2024, 1, 2, 3, 4), "T", "A", 5)]


def test_serving_tables_are_built_and_stored(spark, tmp_path):
    placed = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "artist string, region int")
    atlas = spark.createDataFrame([(1, "rock", ["loud"], "calm"), (2, "jazz", [], None), (3, "polka", [], None)], "region int, name string, tags array<string>, state string")
    tagged = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"])], "artist string, tags array<string>")
    table, index = taste.serving_tables(placed, atlas, tagged)
    taste.store_serving(table, index, str(tmp_path))
    assert {(r.artist, r.genre) for r in spark.read.parquet(str(tmp_path / "artist_genre")).collect()} == {("a", "rock"), ("b", "rock"), ("c", "jazz")}
    assert {r.genre: (r.dominant, r.n_artists) for r in spark.read.json(str(tmp_path / "index")).collect()} == {"rock": (["x", "y"], 2), "jazz": ([], 1), "polka": ([], 0)}
    with pytest.raises(ValueError):
        taste.serving_tables(placed, atlas.filter("region = 1"), tagged)


def test_names_are_read_as_what_was_played(spark):
    p = plays(spark, [(1, T0, t, a, 60_000, None) for t, a in (("Creep - Live", "Radiohead"), ("Help!", "The Beatles"), ("Yesterday", "Beatles"), ("Creep", "TLC"), ("Creep", "TLC"))])
    ask = lambda *rows: {r.typed: (r.name, r.tier) for r in profile.resolve_names(p, spark.createDataFrame([(1, *r) for r in rows], "user_id long, typed string, kind string, artists array<string>")).collect()}
    assert ask(("radio", "artist", None), ("beat", "artist", None), ("beatles", "artist", None), ("zzzz", "artist", None)) == {"radio": ("Radiohead", 1), "beat": ("Beatles", 1), "beatles": ("Beatles", 3)}
    assert ask(("creep", "track", ["radiohead"])) == {"creep": ("Creep - Live", 3)}
    assert ask(("creep", "track", None), ("help", "track", None)) == {"creep": ("Creep", 3), "help": ("Help!", 3)}


def test_no_close_name_is_ruled_out_unread(spark):
    import random

    from playlore.functions.similarity import may_reach

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
    pairs = [(word(), word()) for _ in range(4000)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", may_reach("a", "b", 0.9).alias("may")).collect()
    assert all(r.may for r in got if jaro_winkler_pair(r.a, r.b) >= 0.9) and not all(r.may for r in got)


def test_the_index_of_names_loses_none_and_compares_few(spark):
    import random

    rng = random.Random(6)
    part = lambda n: "".join(rng.choice("aeiourstlnmkd") for _ in range(n))
    names = list(dict.fromkeys(" ".join(part(rng.randint(2, 9)) for _ in range(rng.randint(1, 3))) for _ in range(500)))

    def near(name):
        letters = list(name)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(letters))
            letters[i : i + 1] = rng.choice([[], [letters[i], rng.choice("abc")], ["x"]])
        return "".join(letters)

    typed = list(dict.fromkeys([near(rng.choice(names)) for _ in range(60)] + [rng.choice(names).split()[0] for _ in range(20)] + ["ab", "zq zq"]))
    p = plays(spark, [(1, T0, "t", n, 60_000, None) for n in names])
    got = {r.typed: (r.name, r.tier) for r in profile.resolve_names(p, spark.createDataFrame([(1, t) for t in typed], "user_id long, typed string")).collect()}
    norm = lambda x: " ".join(x.split())
    want = {}
    for t in typed:
        q, best = norm(t), []
        for n in names:
            tier = 3 if n == q else 2 if len(q) >= 4 and f" {q} " in f" {n} " else 1 if len(q) >= 4 and jaro_winkler_pair(n, q) >= 0.9 else 0
            if tier and q:
                best.append((-tier, -jaro_winkler_pair(n, q) if tier == 1 else 0, n))
        if best:
            want[t] = (min(best)[2], -min(best)[0])
    assert got == want and {v[1] for v in want.values()} == {1, 2, 3}
    asked = spark.createDataFrame([(1, "artist", t) for t in typed], "user_id long, kind string, want string")
    pairs = profile.name_candidates(spark.createDataFrame([(1, "artist", n) for n in names], "user_id long, kind string, key string"), asked).count()
    assert pairs < 0.25 * len(names) * len(typed)


def test_namesakes_are_three_acts_each_named_once(spark):
    acts = [("Main", 9), ("main ", 8), ("Ann", 7), (" ANN", 6), ("Bob", 5), ("Cy", 4), ("Di", 3)]
    p = plays(spark, [(1, T0 + dt.timedelta(minutes=i), "Stay (Live)" if i % 2 else "Stay", a, 60_000, None) for a, n in acts for i in range(n)])
    got = profile.namesakes(p).orderBy("rank").collect()
    assert [(r.title, r.artist_name, r.plays, r["rank"]) for r in got] == [("stay", "Ann", 7, 1), ("stay", "Bob", 5, 2), ("stay", "Cy", 4, 3)]


def test_specs_are_rewritten_artists_before_titles(spark):
    p = plays(spark, [(1, T0, "Creep", "Radiohead", 60_000, None), (1, T0, "Creep - Live", "Stone Temple", 60_000, None), (1, T0, "Creep - Live", "Stone Temple", 60_000, None), (2, T0, "Creeps", "Radioheads", 60_000, None)])
    spec, notes = profile.resolve(p, ChartSpec(artists=("radiohed", "nobody at all"), tracks=("creep",)), 1)
    assert (spec.artists, spec.tracks, notes) == (("Radiohead", "nobody at all"), ("Creep",), [("radiohed", "Radiohead")])
    assert profile.resolve(p, ChartSpec(tracks=("creep",)), 1)[0].tracks == ("Creep - Live",)
    assert profile.resolve(p, ChartSpec(), 1) == (ChartSpec(), [])


def test_pins_are_those_of_brute_force(spark):
    acts = ["Ann", "Ann, Bob", "Bob, Ann", "Ann, Bob, Cy", " ann ", "Anna", None]
    rows = [(u, T0 + dt.timedelta(hours=i), t, a, 40_000 + i, None) for u in (1, 2) for i, (t, a) in enumerate((t, a) for t in ("Stay", "Stay (Live)", "Go") for a in acts)]
    p = plays(spark, rows)
    asked = [(1, "a", "artist", None, None, "Ann, Bob"), (1, "s", "song", "track:Go", "Stay", "Ann"), (1, "l", "album", None, "Album", "Bob"), (2, "n", "artist", None, None, "nobody")]
    got = {r.pin: (r.plays, r.hours) for r in profile.pin_stats(p, spark.createDataFrame(asked, "user_id long, pin string, kind string, uri string, title string, artist string")).collect()}
    same = lambda a, b: (lambda x, y: x == y or x.startswith(y + ", ") or y.startswith(x + ", "))(a.strip().lower(), b.lower())
    mine = [r for r in rows if r[0] == 1 and r[3] is not None]
    hits = {"a": [r for r in mine if same(r[3], "Ann, Bob")], "s": [r for r in mine if r[2] == "Go" or (r[2].startswith("Stay") and same(r[3], "Ann"))], "l": [r for r in mine if same(r[3], "Bob")], "n": []}
    assert got == {k: (len(v), round(sum(r[4] for r in v) / 3_600_000, 2)) for k, v in hits.items()}


def test_modes_find_the_three_genres(spark):
    space = _space(spark)
    rows = [(1, T0 - dt.timedelta(days=200), "t", f"g{g}-{i}", 600_000, None) for g in range(3) for i in range(60)]
    rows += [(1, T0, "t", "g0-1", 600_000, None)]
    modes = taste.listener_modes(plays(spark, rows), space)
    got = modes.collect()
    assert len(got) == 3 and {r.label.split(", ")[1] for r in got} == {"tag0", "tag1", "tag2"} and all(len(r.tags) == 4 for r in got)
    assert taste.drift(modes).filter("rank = 1").first().points > 50
    few = plays(spark, rows[:60])
    rec = taste.recommendations(taste.listener_modes(few, space, least=20), space, few).collect()
    assert all(not r.artist.startswith("g0") for r in rec)


def test_regions_are_split_until_they_cohere(spark):
    space = _space(spark)
    got = taste.fit_regions(space, k=3).collect()
    assert len(got) == 180
    by = {}
    for r in got:
        by.setdefault(r.region, set()).add(r.artist[:2])
    assert all(len(v) == 1 for v in by.values())


def test_loose_regions_are_split_in_the_same_rounds(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for g in range(8):
        for i in range(30):
            z = np.zeros(16)
            z[g] = 1
            z[8 + g // 2] = 0.6
            z += rng.normal(0, 0.03, 16)
            rows.append((f"g{g}-{i}", (z / np.linalg.norm(z)).tolist()))
    space = spark.createDataFrame(rows, "artist string, z array<double>")
    monkeypatch.setattr(taste, "REGION_MIN", 20)
    monkeypatch.setattr(taste, "COHESION_FLOOR", 0.9)
    calls = []
    halved = taste.halved
    monkeypatch.setattr(taste, "halved", lambda members: calls.append(1) or halved(members))
    by = {}
    for r in taste.fit_regions(space, k=2).collect():
        by.setdefault(r.region, []).append(r.artist[:2])
    assert len(by) == 8 and all(len(set(v)) == 1 and len(v) == 30 for v in by.values())
    assert len(calls) <= 4  # six splits, in rounds
    # Halves of regions all at once are those of each by itself.
    two = space.withColumn("region", F.when(F.substring("artist", 2, 1).cast("int") < 4, 0).otherwise(1))
    split = lambda df: {(r.artist, r.side) for r in halved(df).collect()}
    assert split(two) == split(two.filter("region = 0")) | split(two.filter("region = 1"))


def test_sums_of_vectors_are_those_of_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(int(g), rng.normal(0, 1, 5).tolist()) for g in rng.integers(0, 4, 200)] + [(9, None)]
    got = {r.g: (r.n, r.z) for r in taste._vector_sums(spark.createDataFrame(rows, "g int, z array<double>").repartition(5), "g").collect()}
    assert set(got) == {0, 1, 2, 3}
    for g, (n, z) in got.items():
        own = np.array([v for k, v in rows if k == g])
        assert n == len(own) and np.allclose(z, own.sum(axis=0))


@pytest.mark.parametrize("held", [3, 100_000])
def test_medians_by_narrowing_are_exact(spark, monkeypatch, held):
    import random
    import statistics

    from playlore.operators import medians as M

    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "CELLS", 4)
    rng = random.Random(held)
    groups = {"a": [rng.gauss(0, 1) for _ in range(301)], "b": [rng.choice([1.0, 2.0]) for _ in range(200)], "c": [5.0] * 50, "d": [1e300, -1e300, 3.5, 3.5], "e": [7.0], "f": [None, 2.0], "g": [None]}
    rows = [(g, x, None if x is None else -x) for g, xs in groups.items() for x in xs]
    got = {r.k: (r.x, r.y, r.n) for r in M.medians(spark.createDataFrame(rows, "k string, x double, y double"), "k", ["x", "y"]).collect()}
    for g, xs in groups.items():
        known = [x for x in xs if x is not None]
        want = (statistics.median(known), statistics.median([-x for x in known])) if known else (None, None)
        assert got[g] == (*want, len(xs)), g
    assert M.medians(spark.createDataFrame([], "k string, x double, y double"), "k", ["x"]).count() == 0


def test_tag_space_keeps_like_with_like(spark):
    rows = [(f"a{i}", ["rock", "loud", "guitar"] if i % 2 else ["jazz", "sax", "calm"]) for i in range(20)]
    z = {r.artist: r.z for r in taste.tag_space(spark.createDataFrame(rows, "artist string, tags array<string>"), dims=3).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(z[a], z[b], strict=True))
    assert cos("a1", "a3") > 0.99 and abs(cos("a1", "a2")) < 0.01


def test_singular_values_are_those_of_numpy(spark, monkeypatch):
    import numpy as np

    from playlore.operators import svd

    monkeypatch.setattr(svd, "COLUMNS", 40)
    monkeypatch.setattr(svd, "MEET", 2)
    rng = np.random.default_rng(4)
    names = [f"t{i}" for i in range(90)]
    rows, dense = [], np.zeros((300, 90))
    for i in range(300):
        # Groups of tags that go together, and some noise.
        own = rng.choice(18, 6, replace=False) + 18 * (i % 5)
        other = rng.choice(90, 3, replace=False)
        at = np.unique(np.concatenate([own, other]))
        w = rng.uniform(0.2, 1, len(at))
        dense[i, at] = w / np.linalg.norm(w)
        rows.append((f"a{i}", [names[j] for j in at], dense[i, at].tolist()))
    made, s = svd.decompose(spark.createDataFrame([*rows, ("none", [], [])], "key string, columns array<string>, weights array<double>").repartition(5), 8)
    u, want, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.abs(s / want[:8] - 1).max() < 0.01
    z = {r.key: np.array(r.z) for r in made.collect()}
    assert len(z) == 300
    # The strong directions give the same angles between artists.
    full, got = u[:, :5] * want[:5], np.array([z[f"a{i}"][:5] for i in range(300)])
    assert np.abs(got @ got.T - full @ full.T).max() < 0.01
    # Less rank than asked for.
    few, s = svd.decompose(spark.createDataFrame([("a", ["x", "y"], [1.0, 2.0]), ("b", ["x", "y"], [2.0, 4.0]), ("c", ["z"], [3.0])], "key string, columns array<string>, weights array<double>"), 5)
    assert np.allclose(s, [5.0, 3.0]) and {r.key: len(r.z) for r in few.collect()} == {"a": 2, "b": 2, "c": 2}
    assert svd.decompose(spark.createDataFrame([], "key string, columns array<string>, weights array<double>"), 3)[0].count() == 0


def test_feed_is_rebuilt_only_where_the_tip_moved(spark):
    p = plays(spark, [(u, T0 + dt.timedelta(hours=i), "A", "x", 60_000, None) for u in (1, 2) for i in range(4)])
    first = feed.build(p)
    again = feed.build(p.union(plays(spark, [(2, T0 + dt.timedelta(hours=9), "A", "x", 60_000, None)])), cached=first)
    got = {r.user_id: r.plays for r in again.filter("section = 'repeat'").collect()}
    assert got == {1: 4, 2: 5}


def test_scoring_of_fields(spark):
    produced = spark.createDataFrame([(1, "a", "x"), (1, "n", "7"), (1, "l", "q, p")], "case long, field string, value string")
    shape = "case long, field string, kind string, value string, low double, high double, among array<string>"
    expected = spark.createDataFrame([(1, "a", "in", None, None, None, ["x", "y"]), (1, "n", "between", None, 5.0, 9.0, None), (1, "l", "list", "p,q", None, None, None), (1, "z", "exact", "v", None, None, None)], shape)
    ok = {r.field: r.ok for r in scoring.field_scores(produced, expected).collect()}
    assert ok == {"a": True, "n": True, "l": True, "z": False}
    s = scoring.summary(scoring.field_scores(produced, expected)).first()
    assert (s.cases, s.exact, s.field_accuracy) == (1, 0, 0.75)


def test_wanted_genres_widen_to_words_inside_names(spark):
    g = spark.createDataFrame([("indie rock", ["guitar"]), ("trap", ["rap"]), ("bedrock", [])], "genre string, tags array<string>")
    assert {r.genre: r.word for r in C.cover(g, ("rock", "rap")).collect()} == {"indie rock": "rock", "trap": "rap"}
    assert [r.word for r in taste.unreached(g, ("rock", "polka")).collect()] == ["polka"]
