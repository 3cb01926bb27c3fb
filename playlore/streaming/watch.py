"""From playback snapshots to finished plays: the state of each listener's player.

``step`` is the pure rule; ``plays_from`` runs it in a stateful stream operator, keyed by
listener.  Nothing is finished by the first empty snapshot.  If none with a track follows for
the length of a blackout, an empty one or an event-time timer ends the play.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from playlore.functions import expressions as X
from playlore.functions.shared import checkpointed
from playlore.sources.store import DayStore, parts_of

# Fixed values, in milliseconds.
REPEAT_MS, SLACK_MS, BLACKOUT_MS, SHORTEST_MS = 3000, 2000, 50_000, 1000
#: Statuses of a fetch that say something: what is on, and that nothing is.
ON, SILENT = 200, 204

SNAPSHOT = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("status", T.IntegerType()),  # of the fetch: 200, 204 when nothing is on, or an error
        T.StructField("is_playing", T.BooleanType()),
        T.StructField("kind", T.StringType()),  # track, episode, ad, ...
        T.StructField("progress_ms", T.LongType()),
        T.StructField("uri", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("album", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)
FINISHED = T.StructType(
    [T.StructField(c, t) for c, t in (("user_id", T.LongType()), ("played_at", T.TimestampType()), ("track_uri", T.StringType()), ("track_name", T.StringType()), ("artist_name", T.StringType()), ("album_name", T.StringType()), ("duration_ms", T.LongType()), ("ms_played", T.LongType()))]
)
_STATE = T.StructType(
    [T.StructField(c, t) for c, t in (("uri", T.StringType()), ("name", T.StringType()), ("artist", T.StringType()), ("album", T.StringType()), ("duration", T.LongType()), ("progress", T.LongType()), ("heard", T.LongType()), ("seen", T.LongType()), ("moved", T.LongType()), ("playing", T.BooleanType()), ("gone", T.LongType()))]
)


def finished(state: dict | None, heard: int, ended: int) -> dict | None:
    """The play of a state, heard for at most its duration; None if too short to count."""
    if not state:
        return None
    heard = int(heard if state["duration"] is None else min(heard, state["duration"]))
    if heard < SHORTEST_MS:
        return None
    return {"played_at": ended, "track_uri": state["uri"], "track_name": state["name"], "artist_name": state["artist"], "album_name": state["album"], "duration_ms": state["duration"], "ms_played": heard}


def _begin(snap: dict, at: int, heard: int) -> dict:
    return {"uri": snap["uri"], "name": snap["name"], "artist": snap["artist"], "album": snap["album"], "duration": snap["duration_ms"], "progress": snap["progress_ms"], "heard": heard, "seen": at, "moved": at, "playing": bool(snap["is_playing"]), "gone": None}


def _over(state: dict, room: int) -> dict | None:
    """The play of a state that ended within ``room`` milliseconds of when it was last seen.

    What was playing went on until its end or for that long; what was paused ended when it
    last moved.
    """
    if not state["playing"]:
        return finished(state, state["heard"], state["moved"])
    whole = state["progress"] if state["duration"] is None else state["duration"]
    rest = max(0, min(whole - state["progress"], room))
    return finished(state, state["heard"] + rest, state["seen"] + rest)


def blacked_out(state: dict) -> dict | None:
    """The play of a state after a blackout: it ended somewhere before the first empty snapshot."""
    return _over(state, max(0, state["gone"] - state["seen"]))


def step(state: dict | None, snap: dict | None, at: int) -> tuple[dict | None, dict | None]:
    """(next state, finished play) after a snapshot taken at ``at`` milliseconds.

    ``snap`` is None when nothing is playing, or something that isn't a track.  Time counts
    as heard as far as the track moved on, but never more than the time that passed.
    """
    if state and at < state["seen"]:
        return state, None  # older than what has been seen
    if snap is None:
        if state is None:
            return None, None
        if state["gone"] is None:
            return state | {"gone": at}, None
        return (None, blacked_out(state)) if at - state["gone"] >= BLACKOUT_MS else (state, None)
    now = snap["progress_ms"]
    if state is None:
        return _begin(snap, at, now), None
    elapsed = at - state["seen"]
    if snap["uri"] != state["uri"]:
        # The new track began ``now`` ago, and the old one ended by then.
        return _begin(snap, at, min(now, elapsed + SLACK_MS)), _over(state, elapsed - now)
    before = state["progress"]
    if now + REPEAT_MS < before and now <= elapsed + REPEAT_MS:
        # Near its start again, with time enough to have been started over.
        return _begin(snap, at, now), _over(state, elapsed - now)
    credit = min(now - before, elapsed + SLACK_MS) if now > before else 0
    return state | {"progress": now, "heard": state["heard"] + credit, "seen": at, "moved": at if credit else state["moved"], "playing": bool(snap["is_playing"]), "gone": None}, None


def _snapshot(row: dict) -> tuple[dict | None, int]:
    """What a row of a table of snapshots says is playing, and its time in milliseconds."""
    at = pd.Timestamp(row["at"]).value // 1_000_000
    if row["status"] == SILENT or row["kind"] != "track" or not isinstance(row["uri"], str):
        return None, at
    plain = {k: None if pd.isna(v) else v for k, v in row.items()}
    plain["progress_ms"] = max(0, int(plain["progress_ms"] or 0))
    plain["duration_ms"] = None if plain["duration_ms"] is None else int(plain["duration_ms"])
    return plain, at


def _frame(plays: list[tuple[int, dict]]) -> pd.DataFrame:
    rows = [{"user_id": user, **p, "played_at": pd.Timestamp(p["played_at"], unit="ms")} for user, p in plays]
    return pd.DataFrame(rows, columns=[f.name for f in FINISHED.fields]).astype({"duration_ms": "Int64"})


class Watcher(StatefulProcessor):
    """Applies ``step`` to each listener's snapshots in the order of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("player", _STATE)

    def _load(self) -> dict | None:
        if not self.state.exists():
            return None
        return dict(zip([f.name for f in _STATE.fields], self.state.get(), strict=True))

    def _save(self, state: dict | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.state.clear()
            return
        self.state.update(tuple(state[f.name] for f in _STATE.fields))
        if state["gone"] is not None:
            self.handle.registerTimer(state["gone"] + BLACKOUT_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("at", kind="stable")
        state, done = self._load(), []
        for row in every.to_dict("records"):
            state, play = step(state, *_snapshot(row))
            if play:
                done.append((key[0], play))
        self._save(state)
        yield _frame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        play = blacked_out(state) if state and state["gone"] is not None else None
        self._save(None)
        yield _frame([(key[0], play)] if play else [])

    def close(self) -> None:
        pass


_WAITING = T.StructType([T.StructField("at", T.LongType()), *(T.StructField(f.name, f.dataType) for f in SNAPSHOT.fields if f.name not in ("user_id", "at"))])


def _in_order(waiting: tuple) -> tuple:
    """The order in which snapshots are stepped through: by time, track and progress, null first."""
    row = dict(zip([f.name for f in _WAITING.fields], waiting, strict=True))
    return row["at"], *((row[c] is not None, row[c] if row[c] is not None else kind) for c, kind in (("uri", ""), ("progress_ms", 0)))


class PatientWatcher(StatefulProcessor):
    """Applies ``step`` to snapshots that come out of order: each waits until the watermark has passed it.

    What waits is one listener's snapshots of the time that the watermark allows.  A timer at the
    earliest of them releases those that no later one can precede.  Nothing else ends a play than
    in ``replay``, so the plays are the same.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("player", _STATE)
        self.waiting = handle.getListState("waiting", _WAITING)

    def _release(self, user: int, fresh: list[tuple], watermark: int) -> list[tuple[int, dict]]:
        every = sorted([*(tuple(x) for x in self.waiting.get()), *fresh], key=_in_order) if self.waiting.exists() else sorted(fresh, key=_in_order)
        names = [f.name for f in _WAITING.fields]
        state = dict(zip([f.name for f in _STATE.fields], self.state.get(), strict=True)) if self.state.exists() else None
        done, n = [], 0
        while n < len(every) and every[n][0] <= watermark:
            row = dict(zip(names, every[n], strict=True))
            state, play = step(state, *_snapshot(row | {"at": pd.Timestamp(row["at"], unit="ms")}))
            if play:
                done.append((user, play))
            n += 1
        if state is None:
            self.state.clear()
        else:
            self.state.update(tuple(state[f.name] for f in _STATE.fields))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if every[n:]:
            self.waiting.put(every[n:])
            self.handle.registerTimer(every[n][0])
        else:
            self.waiting.clear()
        return done

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in _WAITING.fields][1:]
        fresh = []
        for batch in rows:
            plain = batch[names].astype(object).where(batch[names].notna(), None)
            at = batch["at"].astype("datetime64[ms]").astype("int64")
            fresh += [(int(t), *(int(v) if c in ("status", "progress_ms", "duration_ms") and v is not None else v for c, v in zip(names, row, strict=True))) for t, row in zip(at, plain.itertuples(index=False), strict=True)]
        yield _frame(self._release(key[0], fresh, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame(self._release(key[0], [], timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def plays_in_order(snapshots: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Finished plays of a stream whose snapshots may come in any order, up to ``late`` behind the newest.

    A snapshot counts when the watermark has passed it, so plays come ``late`` later than with
    ``plays_from``, which takes snapshots as they come.  Those still later are dropped.
    """
    good = snapshots.filter(F.col("status").isin(ON, SILENT)).withWatermark("at", late)
    return good.groupBy("user_id").transformWithStateInPandas(statefulProcessor=PatientWatcher(), outputStructType=FINISHED, outputMode="Append", timeMode="EventTime")


def plays_from(snapshots: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Finished plays of a stream of snapshots.  Failed fetches say nothing and are dropped."""
    good = snapshots.filter(F.col("status").isin(ON, SILENT)).withWatermark("at", late)
    return good.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Watcher(), outputStructType=FINISHED, outputMode="Append", timeMode="EventTime")


def replay(snapshots: DataFrame) -> DataFrame:
    """The same rule over snapshots at rest, listener by listener, in batches.

    Rows are dealt by listener and sorted by time, so that a listener's snapshots stream
    through one task without being held.  What is still playing at the end is not finished.
    """
    dealt = snapshots.filter(F.col("status").isin(ON, SILENT)).repartition("user_id").sortWithinPartitions("user_id", "at", "uri", "progress_ms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, None
        for batch in batches:
            done: list[tuple[int, dict]] = []
            for row in batch.to_dict("records"):
                if row["user_id"] != user:
                    user, state = row["user_id"], None
                state, play = step(state, *_snapshot(row))
                if play:
                    done.append((user, play))
            if done:
                yield _frame(done)

    return dealt.mapInPandas(run, FINISHED)


def unique_plays(plays: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of plays without repeats of (listener, source, track, time)."""
    return plays.withWatermark("played_at", late).dropDuplicatesWithinWatermark(["user_id", "source", "track_uri", "played_at"])


def heartbeat(runs: DataFrame) -> DataFrame:
    """(job, user_id): last run, last success (kept on failure), last error, runs, rows added.

    ``runs(job, user_id, at, ok, error, added)``, a stream or a table.
    """
    return runs.groupBy("job", "user_id").agg(
        F.max("at").alias("last_run"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"),
        F.max_by(F.when(~F.col("ok"), F.col("error")), "at").alias("last_error"),
        F.count("*").alias("runs"),
        F.sum(F.coalesce("added", F.lit(0))).alias("added"),
    )


def stalled(beats: DataFrame, as_of: dt.datetime, minutes: int = 5) -> DataFrame:
    """Beats with whether the job has had no success for ``minutes``, or never."""
    now = F.lit(as_of.isoformat(" ")).cast("timestamp_ntz")
    old = F.col("last_ok").cast("timestamp_ntz") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return beats.withColumn("stalled", F.coalesce(old, F.lit(True)))


NOTICE = T.StructType([T.StructField("job", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("state", T.StringType())])
_BEAT = T.StructType([T.StructField("last_ok", T.LongType()), T.StructField("stalled", T.BooleanType())])


class StallWatcher(StatefulProcessor):
    """Says when a job has had no success for a while, without a row that says so, and when it has again.

    A success sets a timer on the clock.  If it expires first, the job is stalled; the next
    success tells that it has recovered.
    """

    def __init__(self, seconds: float):
        self.length = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", _BEAT)

    def _told(self, key, at: int, state: str) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "user_id": [key[1]], "at": [pd.Timestamp(at, unit="ms")], "state": [state]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        last, stalled = self.beat.get() if self.beat.exists() else (None, False)
        for batch in rows:
            for at in batch.loc[batch["ok"].fillna(False).astype(bool), "at"]:
                at = pd.Timestamp(at).value // 1_000_000
                last = at if last is None else max(last, at)
        # A job that has never had a success is due as long after it was first seen.
        due = (now if last is None else last) + self.length
        if stalled and last is not None and due > now:
            stalled = False
            yield self._told(key, now, "recovered")
        if not stalled:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(due, now + 1))
        self.beat.update((last, stalled))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.beat.get()
        self.beat.update((last, True))
        yield self._told(key, timerValues.getCurrentProcessingTimeInMs(), "stalled")

    def close(self) -> None:
        pass


def stall_notices(runs: DataFrame, seconds: float = 300) -> DataFrame:
    """A stream of (job, user_id, at, state): stalled when a job has had no success for ``seconds``, and recovered.

    ``runs(job, user_id, at, ok)`` is the stream that ``heartbeat`` reads.
    """
    return runs.groupBy("job", "user_id").transformWithStateInPandas(statefulProcessor=StallWatcher(seconds), outputStructType=NOTICE, outputMode="Update", timeMode="ProcessingTime")


def presence(latest: DataFrame, genres: DataFrame) -> DataFrame:
    """(user_id, state) of the latest snapshots: sleeping, the state of what plays, or unknown.

    A credit is looked up whole, then by its first act, as names may hold commas.  Without an
    artist, paused or with nothing on, a listener sleeps.
    """
    whole = X.name_key("artist")
    first = F.trim(F.element_at(F.split(whole, ","), 1))
    known = genres.filter("artist IS NOT NULL").groupBy("artist").agg(F.min("state").alias("known"))
    by = lambda name: known.select(F.col("artist").alias(f"{name}_artist"), F.col("known").alias(name))
    named = latest.join(by("all_acts"), whole == F.col("all_acts_artist"), "left").join(by("first_act"), first == F.col("first_act_artist"), "left")
    listening = F.coalesce("is_playing", F.lit(False)) & (F.coalesce("artist", F.lit("")) != "")
    if "status" in latest.columns:
        listening = listening & (F.coalesce("status", F.lit(ON)) != SILENT)
    return named.select("user_id", F.when(~listening, "sleeping").otherwise(F.coalesce("all_acts", "first_act", F.lit("unknown"))).alias("state"))


#: What the day store of a stream holds of each play.
CAPTURED = T.StructType([*(f for f in FINISHED.fields if f.name != "duration_ms"), T.StructField("source", T.StringType())])


def captured_days(spark, folder: str, buckets: int = 64) -> DayStore:
    """The day store that ``store_stream`` writes."""
    return DayStore(spark, folder, CAPTURED, buckets)


def store_stream(plays: DataFrame, folder: str, checkpoint: str, buckets: int = 64, **trigger: object):
    """Write each batch of plays to the day store at ``folder``, replacing the days it touches.

    The days' stored plays are read, reconciled with the batch by source, and written again.
    """
    from playlore.sources.ingest import reconcile

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        store = captured_days(spark, folder, buckets)
        names = [f.name for f in CAPTURED.fields]
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in CAPTURED.fields])
        day = F.to_date("played_at")
        near = rows.select("user_id", F.explode(F.array(F.date_sub(day, 1), day, F.date_add(day, 1))).alias("day")).distinct()
        days = checkpointed(near)
        before = store.read(parts_of(days.select(store.part("day").alias("part")))).withColumn("day", day).join(days, ["user_id", "day"], "left_semi")
        every = rows.unionByName(before.select(*names)).dropDuplicates(["user_id", "source", "track_uri", "played_at"])
        merged = reconcile(every.filter("source = 'watch'").drop("source"), every.filter("source = 'recent'").drop("source"))
        store.replace_days(merged.withColumnRenamed("how", "source"), days)

    return plays.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def refresh_charts(plays: DataFrame, stored: str, specs: dict, folder: str, checkpoint: str):
    """Run saved charts again for the listeners of each batch of new plays."""
    from playlore.plans.chart import chart

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        users = rows.select("user_id").distinct()
        theirs = spark.read.parquet(stored).join(users, "user_id", "left_semi")
        for name, spec in specs.items():
            chart(theirs, spec).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return plays.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
