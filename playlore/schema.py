"""The plays table: one row for each play of each listener, and the constants of its questions."""

from __future__ import annotations

from pyspark.sql import types as T

PLAYS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("played_at", T.TimestampNTZType()),  # UTC, when the play ended
        T.StructField("track_uri", T.StringType()),
        T.StructField("track_name", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("album_name", T.StringType()),
        T.StructField("ms_played", T.LongType()),
        T.StructField("platform", T.StringType()),
        T.StructField("skipped", T.BooleanType()),  # null: not known
        T.StructField("source", T.StringType()),
    ]
)

# Fixed values.
LISTEN_MS = 30_000  # a play is a listen from here on
RATE_SAMPLE = 25  # plays that a rate needs
ZONE = "America/New_York"
TRACK_PREFIX = "track:"
PRIOR_ARTIST, RECENT_ARTIST, PRIOR_SONG, RECENT_SONG = 4, 2, 3, 2
BACK_ARTIST, BACK_SONG = 6, 3
DISCOVER_DAYS, DISCOVER_DISTINCT, DISCOVER_PLAYS, STILL_DAYS, FAMILIAR_TITLES = 7, 2, 4, 7, 1
REPEAT_PLAYS = 3
REGULAR_DAYS, FAVORITE_DAYS = 15, 50
CARD_GENRE_HOURS, CARD_GENRES = 5, 6
TABLE_CAP = 60
