"""The player's state machine, by sequences of (seconds, snapshot)."""

import datetime as dt
import random
import time

import pandas as pd

from playlore.streaming import watch


def snap(uri="u1", progress=0, playing=True, duration=200_000):
    return {"uri": uri, "name": uri, "artist": "a", "album": "b", "duration_ms": duration, "progress_ms": progress, "is_playing": playing}


def run(*steps):
    state, plays = None, []
    for second, s in steps:
        state, play = watch.step(state, s, second * 1000)
        if play:
            plays.append((play["track_uri"], play["ms_played"], play["played_at"] // 1000))
    return state, plays


def test_first_sight_takes_the_progress_as_heard():
    state, plays = run((0, snap(progress=5_000)), (30, snap(progress=35_000)), (60, snap(progress=65_000)))
    assert plays == [] and state["heard"] == 65_000


def test_next_track_ends_the_last_one_when_it_began():
    assert run((0, snap(progress=170_000)), (30, snap("u2", progress=5_000)))[1] == [("u1", 195_000, 25)]
    assert run((0, snap(progress=1_000)), (30, snap(progress=31_000)), (60, snap("u2", progress=20_000)))[1] == [("u1", 41_000, 40)]


def test_what_was_left_bounds_the_end():
    assert run((0, snap(progress=190_000)), (60, snap("u2", progress=5_000)))[1] == [("u1", 200_000, 10)]


def test_credit_is_bounded_by_the_time_that_passed():
    state, _ = run((0, snap(progress=50_000)), (30, snap(progress=150_000)))
    assert state["heard"] == 82_000
    assert run((0, snap()), (1, snap("u2", progress=90_000)))[0]["heard"] == 3_000


def test_seeking_back_earns_nothing_and_is_no_movement():
    state, plays = run((0, snap(progress=150_000)), (30, snap(progress=60_000)))
    assert state["heard"] == 150_000 and not plays and state["moved"] == 0


def test_each_repeat_is_a_play():
    steps = [(30 * (4 * i + j), snap(progress=10_000 + 30_000 * j, duration=110_000)) for i in range(3) for j in range(4)]
    _, plays = run(*steps)
    assert [p[:2] for p in plays] == [("u1", 110_000)] * 2 and [p[2] for p in plays] == [100, 220]


def test_one_empty_snapshot_ends_nothing():
    state, plays = run((0, snap(progress=10_000)), (30, None), (60, snap(progress=70_000)))
    assert plays == [] and state["gone"] is None and state["heard"] == 70_000


def test_blackout_counts_from_its_first_empty_snapshot():
    state, plays = run((0, snap(progress=10_000)), (30, None), (60, None), (79, None))
    assert plays == [] and state["gone"] == 30_000
    assert run((0, snap(progress=10_000)), (30, None), (60, None), (80, None)) == (None, [("u1", 40_000, 30)])


def test_paused_track_ends_when_it_last_moved():
    paused = [(0, snap(progress=100_000)), (30, snap(progress=110_000, playing=False)), (600, snap(progress=110_000, playing=False))]
    assert run(*paused, (630, snap("u2", progress=3_000)))[1] == [("u1", 110_000, 30)]
    assert run(*paused, (620, None), (670, None))[1] == [("u1", 110_000, 30)]


def test_plays_under_a_second_are_dropped_and_long_ones_capped():
    assert run((0, snap(progress=100)), (1, snap("u2", progress=500)))[1] == []
    assert watch.finished(watch._begin(snap(duration=5_000), 0, 0), 9_000, 9)["ms_played"] == 5_000
    assert run((0, snap(progress=4_000, duration=None)), (30, snap("u2", progress=1_000)))[1] == [("u1", 4_000, 0)]


def test_late_snapshot_changes_nothing():
    state, _ = run((20, snap(progress=20_000)))
    assert watch.step(state, snap(progress=0), 10_000) == (state, None)


def _frame(spark, rows):
    at = dt.datetime(2024, 1, 1)
    made = [(1, at + dt.timedelta(seconds=s), 200, True, "track", p, u, u, "a", "b", 200_000) for s, u, p in rows]
    return spark.createDataFrame(made, watch.SNAPSHOT)


ROWS = [(0, "u1", 0), (20, "u1", 20_000), (40, "u2", 5_000), (60, "u2", 25_000)]


def test_replay_of_snapshots_at_rest(spark):
    got = [(r.track_uri, r.ms_played) for r in watch.replay(_frame(spark, ROWS)).orderBy("played_at").collect()]
    assert got == [("u1", 35_000)]


def test_other_things_than_tracks_read_as_nothing_playing(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at + dt.timedelta(seconds=s), 200, True, kind, 30_000, "u1" if kind == "track" else "e", "n", "a", "b", 200_000) for s, kind in ((0, "track"), (20, "episode"), (40, "ad"), (70, "episode"))]
    assert [(r.ms_played, r.played_at.second) for r in watch.replay(spark.createDataFrame(rows, watch.SNAPSHOT)).collect()] == [(50_000, 20)]


def test_stream_gives_the_same_plays(spark, tmp_path):
    _frame(spark, ROWS + [(4000, "u3", 0)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = watch.plays_from(spark.readStream.schema(watch.SNAPSHOT).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.schema(watch.FINISHED).parquet(str(tmp_path / "out")).toPandas()
    assert set(got["track_uri"]) == {"u1", "u2"}
    assert isinstance(got, pd.DataFrame) and int(got.loc[got["track_uri"] == "u1", "ms_played"].iloc[0]) == 35_000


def test_nothing_on_is_silence_and_ends_a_play(spark):
    at = dt.datetime(2024, 1, 1)
    on = [(1, at + dt.timedelta(seconds=20 * i), 200, True, "track", 20_000 * i, "u1", "n", "a", "b", 200_000) for i in range(2)]
    off = [(1, at + dt.timedelta(seconds=40 + 20 * i), 204, None, None, None, None, None, None, None, None) for i in range(8)]
    failed = [(1, at + dt.timedelta(seconds=30), 500, None, None, None, None, None, None, None, None)]
    got = watch.replay(spark.createDataFrame(on + off + failed, watch.SNAPSHOT)).collect()
    assert [(r.track_uri, r.ms_played, r.played_at.second) for r in got] == [("u1", 40_000, 40)]


def test_shuffled_stream_gives_what_replay_gives(spark, tmp_path):
    rng = random.Random(3)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for user in (1, 2, 3):
        second, uri, progress = 0, 0, 0
        for _ in range(120):
            second += rng.choice((10, 20, 30))
            kind = rng.random()
            if kind < 0.15:
                rows.append((user, at + dt.timedelta(seconds=second), 204, None, None, None, None, None, None, None, None))
                continue
            uri, progress = (uri + 1, rng.randrange(5000)) if kind < 0.35 else (uri, progress + rng.randrange(30_000))
            rows.append((user, at + dt.timedelta(seconds=second), 200, rng.random() < 0.9, "track", progress, f"u{uri}", "n", "a", "b", 200_000))
    # Batches as they come: each row up to 100 seconds later than it was taken.
    came = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(100)))
    end = [(u, at + dt.timedelta(hours=9), 500 if u == 3 else 204, None, None, None, None, None, None, None, None) for u in (1, 2, 3)]
    source = str(tmp_path / "in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for n, part in enumerate([came[:90], came[90:200], came[200:], end, [(9, at + dt.timedelta(hours=10), 204, *[None] * 8)]]):
        spark.createDataFrame(part, watch.SNAPSHOT).coalesce(1).write.mode("append").parquet(source)
        stream = watch.plays_in_order(spark.readStream.schema(watch.SNAPSHOT).parquet(source), "100 seconds")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None, n
    plain = lambda df: sorted((r.user_id, str(r.played_at), r.track_uri, r.ms_played) for r in df.collect())
    got = plain(spark.read.schema(watch.FINISHED).parquet(str(tmp_path / "out")))
    assert len(got) > 30 and got == plain(watch.replay(spark.createDataFrame(rows + end, watch.SNAPSHOT)))


def test_stalled_jobs_are_told_without_a_later_row(spark, tmp_path):
    shape = "job string, user_id long, at timestamp, ok boolean"
    source = str(tmp_path / "in")
    now = dt.datetime.now

    def arrive(*rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)

    arrive(("watch", 1, now(), True), ("watch", 2, now(), False))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = watch.stall_notices(spark.readStream.schema(spark.createDataFrame([], shape).schema).parquet(source), seconds=4)
    query = stream.writeStream.format("memory").queryName("notices").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    told = lambda: sorted((r.user_id, r.state) for r in spark.table("notices").collect())

    def wait(want):
        end = time.time() + 90
        while told() != want and time.time() < end:
            assert query.exception() is None
            time.sleep(0.5)
        assert told() == want

    try:
        wait([(1, "stalled"), (2, "stalled")])
        arrive(("watch", 1, now() + dt.timedelta(minutes=5), True), ("watch", 2, now(), False))
        wait([(1, "recovered"), (1, "stalled"), (2, "stalled")])
    finally:
        query.stop()


def test_presence_looks_up_whole_credits_first(spark):
    genres = spark.createDataFrame([("tyler, the creator", "rap"), ("ann", "calm"), ("tyler", "wrong")], "artist string, state string")
    rows = [(1, 200, True, " Tyler, The Creator"), (2, 200, True, "Ann, Bob"), (3, 200, True, None), (4, 200, False, "Ann"), (5, 204, True, "Ann"), (6, 200, True, "Zed"), (7, 200, True, "")]
    got = watch.presence(spark.createDataFrame(rows, "user_id long, status int, is_playing boolean, artist string"), genres)
    assert {r.user_id: r.state for r in got.collect()} == {1: "rap", 2: "calm", 3: "sleeping", 4: "sleeping", 5: "sleeping", 6: "unknown", 7: "sleeping"}


def _captured(spark, rows):
    at = dt.datetime(2024, 1, 1, 23, 59, 50)
    made = [(1, at + dt.timedelta(seconds=s), u, "t", "a", "b", 1000, source) for s, u, source in rows]
    return spark.createDataFrame(made, "user_id long, played_at timestamp, track_uri string, track_name string, artist_name string, album_name string, ms_played long, source string")


def test_stored_days_hold_measured_plays_in_either_order_of_arrival(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "days")

    def arrive(rows):
        made = _captured(spark, rows)
        made.coalesce(1).write.mode("append").parquet(source)
        query = watch.store_stream(spark.readStream.schema(made.schema).parquet(source), folder, str(tmp_path / "ck"))
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r.track_uri, r.source, r.played_at.second) for r in watch.captured_days(spark, folder).read().collect())

    assert arrive([(0, "x", "recent"), (100, "y", "watch")]) == [("x", "recent", 50), ("y", "watch", 30)]
    # The measured play ends twenty seconds later, past midnight; a repeat changes nothing.
    assert arrive([(20, "x", "watch"), (170, "z", "recent"), (100, "y", "watch")]) == [("x", "watch", 10), ("y", "watch", 30), ("z", "recent", 40)]
