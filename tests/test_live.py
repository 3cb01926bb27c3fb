"""Stores in parts behind a pointer, and charts from partial aggregates against full runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from playlore.plans.chart import ChartSpec, chart
from playlore.schema import PLAYS
from playlore.sources.store import PartStore, bucket_of
from playlore.streaming import live

ROW = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("x", T.StringType())])


def test_parts_are_replaced_whole_and_readers_keep_their_version(spark, tmp_path):
    store = PartStore(spark, str(tmp_path / "s"), ROW, ("user_id",))
    make = lambda rows: spark.createDataFrame(rows, "user_id long, x string, part string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(store.read()) == []
    store.replace(make([(1, "a", "p1"), (2, "b", "p2")]), ["p1", "p2"])
    before = store.read()
    store.replace(make([(3, "c", "p1"), (4, "d", "p3")]), ["p1", "p2", "p3"])
    assert got(before) == [(1, "a"), (2, "b")]
    assert got(store.read()) == [(3, "c"), (4, "d")] and got(store.read(["p3", "p9"])) == [(4, "d")]
    assert set(store.current()) == {"p1", "p3"}
    with pytest.raises(ValueError):
        store.replace(make([(1, "a", "other")]), ["p1"])
    # What was begun and not named changes nothing.
    make([(9, "z", "p1")]).write.partitionBy("part").parquet(str(tmp_path / "s" / "version-begun"))
    assert got(store.read()) == [(3, "c"), (4, "d")]
    assert store.clean(keep=1) >= 2 and got(store.read()) == [(3, "c"), (4, "d")]


def test_the_second_of_two_writers_fails(spark, tmp_path):
    store = PartStore(spark, str(tmp_path / "s"), ROW)
    store.replace(spark.createDataFrame([(1, "a", "p")], "user_id long, x string, part string"), ["p"])
    with pytest.raises(RuntimeError):
        store._point("{}", 1)
    assert store.read().count() == 1


def _history(rng, n, users, first):
    rows = []
    for _ in range(n):
        user, song = rng.choice(users), rng.randrange(40)
        at = first + dt.timedelta(seconds=rng.randrange(200 * 86_400))
        artist = None if rng.random() < 0.05 else f"act {song % 9}"
        rows.append((user, at, f"track:{song}-{rng.randrange(2)}", f"song {song % 25}", artist, f"album {song % 7}", rng.choice([5_000, 40_000, 200_000]), rng.choice(["iOS 9", "windows", None]), rng.choice([True, False, None]), "export"))
    return rows


SPECS = {
    "hours": ChartSpec(limit=5),
    "bottom": ChartSpec(metric="plays", sort="asc", limit=4, year=2024),
    "songs": ChartSpec(dimension="track", metric="plays", limit=6),
    "albums": ChartSpec(dimension="album", range="30d"),
    "months": ChartSpec(dimension="date", grain="month", metric="plays", cumulative=True),
    "winters": ChartSpec(dimension="date", grain="year", metric="hours", months=(12, 1, 2)),
    "hours_of_day": ChartSpec(dimension="hour_of_day", metric="hours", last=6, last_unit="week"),
    "weekdays": ChartSpec(dimension="day_of_week", metric="skip_rate", days=("sat", "sun", "mon")),
    "rates": ChartSpec(metric="skip_rate", from_year=2023, to_year=2024),
    "named": ChartSpec(dimension="artist", artists=("Act 1", "act 2"), range="90d"),
    "platforms": ChartSpec(dimension="platform", metric="plays"),
}


def _plain(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


def test_charts_from_cells_are_those_of_full_runs_after_each_batch(spark, tmp_path):
    rng = random.Random(11)
    first = dt.datetime(2023, 11, 20)
    batches = [_history(rng, 500, [1, 2, 3, 4], first), _history(rng, 60, [2], first), _history(rng, 40, [4, 5], first + dt.timedelta(days=100))]
    batches.append(batches[1][:20] + [(1, dt.datetime(2024, 6, 20, 3, 59), "track:new", "song new", "act 1", "album 1", 3_600_000, None, None, "export")])
    kept = live.LiveCharts(spark, str(tmp_path / "live"), SPECS, buckets=2)
    seen = []
    for n, batch in enumerate(batches):
        kept.take(spark.createDataFrame(batch, PLAYS))
        seen += batch
        if n in (0, 3):
            whole = spark.createDataFrame(seen, PLAYS).dropDuplicates(["user_id", "source", "track_uri", "played_at"])
            for name, spec in SPECS.items():
                assert _plain(kept.drawn(name)) == _plain(chart(whole, spec)), name


def test_different_tracks_are_estimated_within_the_stated_error(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=i), f"track:{i % 3000}", f"s{i % 3000}", f"act {i % 700}", "b", 60_000, None, None, "export") for i in range(6000)]
    kept = live.LiveCharts(spark, str(tmp_path / "live"), {"t": ChartSpec(dimension="date", grain="year", metric="distinct_tracks"), "a": ChartSpec(dimension="date", grain="month", metric="distinct_artists")}, buckets=2)
    kept.take(spark.createDataFrame(rows, PLAYS))
    assert abs(kept.drawn("t").first().value / 3000 - 1) < 0.05 and abs(kept.drawn("a").first().value / 700 - 1) < 0.05


def test_only_parts_of_touched_months_and_listeners_are_written(spark, tmp_path):
    kept = live.LiveCharts(spark, str(tmp_path / "live"), {"hours": ChartSpec()}, buckets=4)
    rng = random.Random(2)
    kept.take(spark.createDataFrame(_history(rng, 200, [1, 2, 3, 4, 5, 6], dt.datetime(2023, 11, 20)), PLAYS))
    before = kept.plays.current(), kept.cells.current()
    kept.take(spark.createDataFrame([(3, dt.datetime(2024, 2, 10, 12), "track:x", "s", "act 1", "b", 60_000, None, None, "export")], PLAYS))
    own = spark.createDataFrame([(3,)], "user_id long").select(bucket_of("user_id", 4)).first()[0]
    changed = [{p for p in now if now[p] != old.get(p)} for now, old in zip((kept.plays.current(), kept.cells.current()), before, strict=True)]
    assert changed == [{f"{own}-2024-02"}, {f"artist-{own}-2024", f"tip-{own}-2024"}]


def test_streams_feed_the_charts_and_repeats_change_nothing(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "live")
    kept = live.LiveCharts(spark, folder, {"hours": ChartSpec()}, buckets=2)
    rows = _history(random.Random(5), 50, [1, 2], dt.datetime(2024, 1, 1))
    for batch in (rows[:30], rows[20:]):
        spark.createDataFrame(batch, PLAYS).coalesce(1).write.mode("append").parquet(source)
        query = kept.stream(spark.readStream.schema(PLAYS).parquet(source), str(tmp_path / "ck"))
        assert query.awaitTermination(180) and query.exception() is None
    assert _plain(kept.drawn("hours")) == _plain(chart(spark.createDataFrame(rows, PLAYS), ChartSpec()))


def test_specs_that_cells_don_t_answer_are_refused(spark, tmp_path):
    for spec in (ChartSpec(dimension="genre"), ChartSpec(hours=(1, 2)), ChartSpec(tracks=("x",)), ChartSpec(dimension="album", artists=("a",)), ChartSpec(range="today"), ChartSpec(answer="number")):
        with pytest.raises(ValueError):
            live.LiveCharts(spark, str(tmp_path), {"x": spec})
