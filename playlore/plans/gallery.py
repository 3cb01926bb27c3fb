"""Preset charts: one for each form of answer, by the names under which they are also queries."""

from __future__ import annotations

PRESETS = (
    "top_albums_hours",  # bars with an artist under each
    "top_tracks_plays",  # bars that can be played
    "hours_of_day",  # bars in natural order, every hour
    "skip_rate_artists",  # a rate, of enough plays only
    "months_distinct_tracks",  # a line over dates
    "genre_lines",  # several lines with gaps filled
    "running_total_2000",  # a running total
    "top_track_each_year",  # a table by period
    "winter_years",  # seasons across New Year
    "range_30d_artists",  # a window up to each listener's newest play
    "best_month",  # a winner and its runner-up
    "recent_plays",  # the newest plays themselves
)
