"""Presence, maps by modes, and streams over stored plays."""

import datetime as dt

from playlore.operators import taste
from playlore.plans.chart import ChartSpec
from playlore.schema import PLAYS
from playlore.streaming import watch


def test_presence_is_sleeping_a_state_or_unknown(spark):
    latest = spark.createDataFrame([(1, True, "Ann, Bob"), (2, False, "Ann"), (3, True, "Nobody"), (4, None, None)], "user_id long, is_playing boolean, artist string")
    genres = spark.createDataFrame([("ann", "calm")], "artist string, state string")
    got = {r.user_id: r.state for r in watch.presence(latest, genres).collect()}
    assert got == {1: "calm", 2: "sleeping", 3: "unknown", 4: "sleeping"}


def test_map_by_modes_puts_labels_at_medians(spark):
    at = dt.datetime(2024, 1, 1)
    plays = spark.createDataFrame([(1, at, "u", "t", a, "b", 60_000, None, None, "live") for a in ("p", "q", "r")], PLAYS)
    space = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.9, 0.1]), ("r", [0.0, 1.0])], "artist string, z array<double>")
    points = spark.createDataFrame([("p", 0.0, 0.0), ("q", 2.0, 4.0), ("r", 9.0, 9.0)], "artist string, x double, y double")
    modes = spark.createDataFrame([(1, 0, [1.0, 0.0], "one"), (1, 1, [0.0, 1.0], "two")], "user_id long, mode int, centre array<double>, label string")
    artists, labels = taste.mode_map(modes, space, plays, points)
    assert {r.artist: r.mode for r in artists.collect()} == {"p": 0, "q": 0, "r": 1}
    assert {(r.label, r.x, r.y) for r in labels.collect()} == {("one", 1.0, 2.0), ("two", 9.0, 9.0)}


def _stream(spark, folder, rows, shape):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], shape).schema).parquet(folder)


def test_repeated_plays_pass_once(spark, tmp_path):
    row = (1, "watch", "u", dt.datetime(2024, 1, 1))
    stream = _stream(spark, str(tmp_path / "in"), [row, row, (1, "recent", "u", row[3])], "user_id long, source string, track_uri string, played_at timestamp")
    query = watch.unique_plays(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_charts_of_touched_listeners_are_run_again(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    stored = str(tmp_path / "plays")
    spark.createDataFrame([(u, at, "u", "t", "Ann", "b", 3_600_000, None, None, "live") for u in (1, 2)], PLAYS).write.parquet(stored)
    stream = _stream(spark, str(tmp_path / "in"), [(2,)], "user_id long")
    query = watch.refresh_charts(stream, stored, {"top": ChartSpec()}, str(tmp_path / "charts"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "charts" / "top")).collect()
    assert [(r.user_id, r.label, r.value) for r in got] == [(2, "Ann", 1.0)]
