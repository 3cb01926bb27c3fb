"""SQL for the registered queries, over the same tables."""

from __future__ import annotations

from playlore.plans.gallery import PRESETS
from playlore.sources import adapters as A

L = "((played_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
H = f"WITH plays AS ({A.HISTORY_SQL}), p AS (SELECT *, {L} AS local FROM plays), genres AS ({A.GENRES_SQL})"
E = f"WITH plays AS ({A.RECENT_SQL}), p AS (SELECT *, {L} AS local FROM plays), tips AS (SELECT user_id, max(played_at) AS tip FROM plays GROUP BY 1), a AS (SELECT p.*, tip FROM p JOIN tips USING (user_id)), w AS (SELECT * FROM a WHERE ms_played >= 30000)"

HOURS = "sum(ms_played) / 3600000.0"
PLAYS = "CAST(count(*) AS DOUBLE)"
SKIPS = "avg(CASE WHEN skipped THEN 1.0 WHEN NOT skipped THEN 0.0 END) * 100"
LISTEN = "ms_played >= 30000"
NONE = "CAST(NULL AS VARCHAR)"


def ranked(label: str, sub: str = NONE, metric: str = HOURS, where: str = "true", limit: int = 10, sort: str = "DESC", having: str = "true", source: str = "p") -> str:
    return f"""{H}, m AS (SELECT user_id, {label} AS label, {sub} AS sub, round({metric}, 2) AS value, {metric} AS raw FROM {source}
        WHERE artist_name IS NOT NULL AND ({where}) AND {label} IS NOT NULL GROUP BY 1, 2, 3 HAVING {having})
        SELECT user_id, label, sub, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY raw {sort}, label, sub) AS rank FROM m WHERE value IS NOT NULL) WHERE rank <= {limit}"""


def along(label: str, metric: str = HOURS, where: str = "true", order: str = "label", value: str = "value") -> str:
    return f"""{H}, m AS (SELECT user_id, {label} AS label, {NONE} AS sub, round({metric}, 2) AS v FROM p
        WHERE artist_name IS NOT NULL AND ({where}) GROUP BY 1, 2)
        SELECT user_id, label, sub, {value.replace('value', 'v')} AS value, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rank FROM m WHERE v IS NOT NULL"""


def month(at: str = "local") -> str:
    return f"strftime(date_trunc('month', {at}), '%Y-%m-%d')"


def year(at: str = "local") -> str:
    return f"strftime(date_trunc('year', {at}), '%Y-%m-%d')"


TIP = "(SELECT max(q.played_at) FROM plays q WHERE q.user_id = p.user_id)"
PLATFORM = """CASE WHEN lower(platform) LIKE '%ios%' OR lower(platform) LIKE '%iphone%' THEN 'iOS' WHEN lower(platform) LIKE '%android%' THEN 'Android'
    WHEN lower(platform) LIKE '%windows%' THEN 'Windows' WHEN lower(platform) LIKE '%mac%' OR lower(platform) LIKE '%os x%' THEN 'Mac' WHEN lower(platform) LIKE '%web%' THEN 'Web' ELSE 'Other' END"""
GENRED = "(SELECT p.*, g.genre FROM p JOIN genres g ON lower(p.artist_name) = g.artist)"
COVER = "(CASE WHEN regexp_matches(genre, '\\bamerica') THEN 'america' WHEN regexp_matches(genre, '\\beast') THEN 'east' WHEN regexp_matches(genre, '\\basia 8') THEN 'asia 8' END)"

def split(label: str, series: str, metric: str, source: str, where: str, limit: int, value: str = "value") -> str:
    return f"""{H}, m AS (SELECT user_id, {label} AS label, {series} AS series, round({metric}, 2) AS value, {'sum(ms_played)' if metric == HOURS else metric} AS strength FROM {source} WHERE {where} AND {series} IS NOT NULL GROUP BY 1, 2, 3),
        lines AS (SELECT user_id, series, row_number() OVER (PARTITION BY user_id ORDER BY sum(CAST(strength AS DECIMAL(28, 6))) DESC, series) AS line FROM m GROUP BY 1, 2),
        spine AS (SELECT DISTINCT m.user_id, m.label, l.series, l.line FROM m JOIN lines l ON m.user_id = l.user_id WHERE l.line <= {limit}),
        f AS (SELECT s.user_id, s.label, s.series, s.line, coalesce(m.value, 0.0) AS value FROM spine s LEFT JOIN m USING (user_id, label, series))
        SELECT user_id, label, series, line, {value} AS value FROM f"""


def told(edge: str) -> str:
    """First or last day in 1995 of two artists, for every listener."""
    named = "lower(artist_name) IN ('supplier#000000003', 'supplier#000000007')"
    return f"""{H}, i AS (SELECT user_id, CAST({edge}(local) AS DATE) AS day FROM p WHERE {LISTEN} AND {named} AND year(local) = 1995 GROUP BY 1)
        SELECT p.user_id, i.day, CASE WHEN i.day IS NOT NULL THEN 'played' WHEN bool_or({LISTEN} AND {named}) THEN 'not_in_window' ELSE 'never' END AS status FROM p LEFT JOIN i ON i.user_id = p.user_id GROUP BY 1, 2"""


def timeline(heard: str, where: str, until: str, ramps: bool = True) -> str:
    """A day's points: a start, two for each play, and an end."""
    start = "greatest(coalesce(lag(stop) OVER o, 0), stop - heard)" if ramps else "stop"
    return f"""{E}, d AS (SELECT user_id, local, track_uri, ms_played, hour(local) + minute(local) / 60 + second(local) / 3600 AS stop, {heard} AS heard FROM p WHERE CAST(local AS DATE) = DATE '2024-01-20' AND {where}),
        t AS (SELECT user_id, stop, heard, {start} AS start, sum(heard) OVER (o ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER o AS n FROM d WINDOW o AS (PARTITION BY user_id ORDER BY local, track_uri, ms_played))
        SELECT user_id, n * 2 AS n, round(start, 4) AS at, round(total - heard, 3) AS value FROM t UNION ALL SELECT user_id, n * 2 + 1, round(stop, 4), round(total, 3) FROM t
        UNION ALL SELECT DISTINCT user_id, 0, 0.0, 0.0 FROM t UNION ALL SELECT user_id, max(n) * 2 + 2, round({until}, 4), round(sum(heard), 3) FROM t GROUP BY 1"""


def movers(key: str, extra: str, prior: int, recent: int, up: bool) -> str:
    cond = "recent > prior" if up else f"recent < prior AND recent >= {recent}"
    return f"""{E}, m AS (SELECT user_id, {key}, {extra} count(*) FILTER (WHERE played_at > tip - INTERVAL 7 DAY) AS recent, count(*) FILTER (WHERE played_at <= tip - INTERVAL 7 DAY) AS prior
        FROM w WHERE played_at > tip - INTERVAL 14 DAY AND {key} IS NOT NULL GROUP BY user_id, {key}),
        r AS (SELECT *, CAST(round((recent - prior) * 1.0 / prior * 100) AS INTEGER) AS pct, row_number() OVER (PARTITION BY user_id ORDER BY (recent - prior) * 1.0 / prior {'DESC' if up else 'ASC'}, {key}) AS rank FROM m WHERE prior >= {prior} AND {cond})
        SELECT * FROM r WHERE rank <= 10"""


def resolved() -> str:
    """Each listener's names without their last letter, and the titles of each act, read back."""
    key = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '(.)(\\s+-\\s.*|\\(.*|\\[.*)$', '\\1'), '[[:punct:]‘’“”]', '', 'g'), '\\s+', ' ', 'g'))"
    return f"""{E}, asked AS (SELECT DISTINCT user_id, 'artist' AS kind, left(artist_name, length(artist_name) - 1) AS typed, NULL AS act FROM p
            UNION SELECT user_id, 'track', left(max(track_name), length(max(track_name)) - 1), lower(artist_name) FROM p GROUP BY user_id, artist_name),
        q AS (SELECT *, {key('trim(typed)')} AS want FROM asked),
        n AS (SELECT user_id, 'artist' AS kind, artist_name AS name, NULL AS act, count(*) AS n FROM p GROUP BY 1, 3 UNION ALL SELECT user_id, 'track', track_name, lower(artist_name), count(*) FROM p GROUP BY user_id, track_name, lower(artist_name)),
        k AS (SELECT *, {key('name')} AS key FROM n),
        j AS (SELECT k.user_id, k.kind, typed, q.act, name, CASE WHEN key = want THEN 3 WHEN length(want) >= 4 AND contains(' ' || key || ' ', ' ' || want || ' ') THEN 2 WHEN length(want) >= 4 AND jaro_winkler_similarity(key, want) >= 0.9 THEN 1 END AS tier, jaro_winkler_similarity(key, want) AS near, k.n
              FROM k JOIN q ON k.user_id = q.user_id AND k.kind = q.kind AND (k.kind = 'artist' OR k.act = q.act) WHERE want <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind, typed, act ORDER BY tier DESC, CASE WHEN tier = 1 THEN near ELSE 0 END DESC, n DESC, name) AS r FROM j WHERE tier IS NOT NULL)
        SELECT user_id, kind, typed, name, tier, max(n) AS plays FROM r WHERE r = 1 GROUP BY 1, 2, 3, 4, 5"""


def watched() -> str:
    """The player's rules, a snapshot of each listener at a time."""
    rest = lambda room: f"CASE WHEN s.playing THEN greatest(0, least(200000 - s.progress, {room})) ELSE 0 END"
    base = "CASE WHEN s.playing THEN s.seen ELSE s.moved END"
    repeat = "(n.uri = s.uri AND n.progress + 3000 < s.progress AND n.progress <= n.at - s.seen + 3000)"
    other, over = "(s.uri IS NOT NULL AND n.uri IS NOT NULL AND n.uri <> s.uri)", "(s.uri IS NOT NULL AND n.uri IS NULL AND s.gone IS NOT NULL AND n.at - s.gone >= 50000)"
    same = f"(n.uri = s.uri AND NOT {repeat})"
    credit = "CASE WHEN n.progress > s.progress THEN least(n.progress - s.progress, n.at - s.seen + 2000) ELSE 0 END"
    kept = lambda fresh, stays, moves: f"CASE WHEN {over} THEN NULL WHEN n.uri IS NULL THEN {stays} WHEN {same} THEN {moves} ELSE {fresh} END"
    return f"""WITH RECURSIVE n AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS at, value > 10 AS playing, CASE WHEN event_type <> 'signup' THEN 'track:' || (event_id % 7) END AS uri, greatest(0, CAST(trunc(value * 1000) AS BIGINT)) AS progress,
            row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP), 'track:' || (event_id % 7), CAST(trunc(value * 1000) AS BIGINT)) AS k FROM events),
        s AS (SELECT CAST(0 AS BIGINT) AS k, user_id, CAST(NULL AS VARCHAR) AS uri, CAST(NULL AS BIGINT) AS progress, CAST(NULL AS BIGINT) AS heard, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS moved, CAST(NULL AS BOOLEAN) AS playing, CAST(NULL AS BIGINT) AS gone,
                     CAST(NULL AS VARCHAR) AS done, CAST(NULL AS BIGINT) AS played, CAST(NULL AS BIGINT) AS ended FROM (SELECT DISTINCT user_id FROM n)
              UNION ALL
              SELECT n.k, n.user_id, {kept('n.uri', 's.uri', 's.uri')}, {kept('n.progress', 's.progress', 'n.progress')},
                     CASE WHEN {other} THEN least(n.progress, n.at - s.seen + 2000) ELSE {kept('n.progress', 's.heard', f's.heard + {credit}')} END,
                     {kept('n.at', 's.seen', 'n.at')}, {kept('n.at', 's.moved', f'CASE WHEN {credit} > 0 THEN n.at ELSE s.moved END')}, {kept('n.playing', 's.playing', 'n.playing')},
                     CASE WHEN {over} OR n.uri IS NOT NULL THEN NULL WHEN s.uri IS NULL THEN NULL ELSE coalesce(s.gone, n.at) END,
                     CASE WHEN {other} OR {repeat} OR {over} THEN s.uri END,
                     least(200000, s.heard + CASE WHEN {over} THEN {rest('greatest(0, s.gone - s.seen)')} ELSE {rest('n.at - s.seen - n.progress')} END),
                     {base} + CASE WHEN {over} THEN {rest('greatest(0, s.gone - s.seen)')} ELSE {rest('n.at - s.seen - n.progress')} END
              FROM s JOIN n ON n.user_id = s.user_id AND n.k = s.k + 1)
        SELECT user_id, make_timestamp(ended * 1000) AS played_at, done AS track_uri, done AS track_name, 'someone' AS artist_name, 'somewhere' AS album_name, CAST(200000 AS BIGINT) AS duration_ms, played AS ms_played FROM s WHERE done IS NOT NULL AND played >= 1000"""


SPANS = """count(*) FILTER (WHERE played_at > tip - INTERVAL 7 DAY) AS recent, count(*) FILTER (WHERE played_at > tip - INTERVAL 14 DAY AND played_at <= tip - INTERVAL 7 DAY) AS prior, count(*) FILTER (WHERE played_at <= tip - INTERVAL 14 DAY) AS earlier"""
POINTS = "points AS (SELECT lower(s_name) AS artist, s_nationkey AS region, s_acctbal / 1000 AS x, CAST(s_suppkey % 100 AS DOUBLE) AS y FROM supplier)"
WEIGHTS = "weights AS (SELECT user_id, lower(trim(artist_name)) AS artist, sum(ms_played) AS ms FROM plays WHERE ms_played >= 30000 AND artist_name IS NOT NULL GROUP BY 1, 2)"
OCCUPIED = f"""{WEIGHTS}, {POINTS}, held AS (SELECT user_id, region, sum(ms) AS ms, count(*) AS artists FROM weights JOIN points USING (artist) GROUP BY 1, 2),
    whole AS (SELECT user_id, sum(ms) AS total FROM held GROUP BY 1),
    occ AS (SELECT w.user_id, r.region, round(coalesce(ms, 0) / 3600000.0, 2) AS hours, round(coalesce(ms, 0) / total, 3) AS share, coalesce(artists, 0) AS artists
            FROM whole w CROSS JOIN (SELECT DISTINCT region FROM points) r LEFT JOIN held h ON h.user_id = w.user_id AND h.region = r.region)"""
SEEN = "seen AS (SELECT user_id, lower(artist_name) AS artist, count(DISTINCT CAST(played_at AS DATE)) AS days FROM plays WHERE ms_played >= 30000 GROUP BY 1, 2)"
LEVEL = "CASE WHEN days >= 50 THEN 'favorite' WHEN days >= 15 THEN 'regular' WHEN days >= 1 THEN 'heard' ELSE 'new' END"
CELLS = f"cells AS (SELECT artist, region, unnest(z) AS x, unnest(range(len(z))) AS i FROM ({A.SPACE_SQL}))"
CENTRES = f"{CELLS}, sums AS (SELECT region, i, sum(x) AS s, count(*) AS n FROM cells GROUP BY 1, 2), lengths AS (SELECT region, sqrt(sum(s * s)) AS length, max(n) AS n FROM sums GROUP BY 1), centres AS (SELECT region, i, s / length AS c FROM sums JOIN lengths USING (region))"

WHOLE_YEAR = "year(local) = 2000"
SONG = "lower(trim(track_name))"
ACT = "lower(trim(artist_name))"

ORACLES: dict[str, str] = {
    "top_artists_hours": ranked("artist_name"),
    "top_artists_plays": ranked("artist_name", metric=PLAYS, where=LISTEN),
    "bottom_artists_hours": ranked("artist_name", sort="ASC", limit=5),
    "top_albums_hours": ranked("album_name", "coalesce(artist_name, '')"),
    "top_tracks_plays": f"""{H}, c AS (SELECT user_id, track_name AS label, artist_name AS sub, track_uri, count(*) AS n FROM p WHERE {LISTEN} GROUP BY 1, 2, 3, 4),
        u AS (SELECT *, row_number() OVER (PARTITION BY user_id, label, sub ORDER BY n DESC, track_uri) AS k, sum(n) OVER (PARTITION BY user_id, label, sub) AS total FROM c),
        r AS (SELECT user_id, label, sub, CAST(total AS DOUBLE) AS value, track_uri AS uri, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, label, sub) AS rank FROM u WHERE k = 1)
        SELECT * FROM r WHERE rank <= 8""",
    "genres_hours": ranked("genre", source=GENRED),
    "platforms_plays": ranked(PLATFORM, metric=PLAYS, where=LISTEN),
    "hours_of_day": f"""{H}, m AS (SELECT user_id, hour(local) AS h, round({HOURS}, 2) AS v FROM p GROUP BY 1, 2),
        s AS (SELECT DISTINCT user_id, h.h FROM m CROSS JOIN (SELECT unnest(range(24)) AS h) h)
        SELECT user_id, CAST(s.h AS VARCHAR) AS label, {NONE} AS sub, coalesce(v, 0.0) AS value, row_number() OVER (PARTITION BY user_id ORDER BY s.h) AS rank FROM s LEFT JOIN m USING (user_id, h)""",
    "days_of_week_plays": along("CAST(isodow(local) AS VARCHAR)", PLAYS, LISTEN),
    "months_distinct_tracks": along(month(), "CAST(count(DISTINCT track_uri) AS DOUBLE)", LISTEN),
    "years_distinct_artists": along(year(), "CAST(count(DISTINCT artist_name) AS DOUBLE)", LISTEN),
    "weeks_hours_2000": along("strftime(date_trunc('week', local), '%Y-%m-%d')", where=WHOLE_YEAR),
    "skip_rate_artists": ranked("artist_name", NONE, SKIPS, having="count(*) >= 25"),
    "skip_rate_hours_of_day": along("CAST(hour(local) AS VARCHAR)", SKIPS, order="CAST(label AS INTEGER)"),
    "range_30d_artists": ranked("artist_name", metric=PLAYS, where=f"{LISTEN} AND played_at >= {TIP} - INTERVAL 30 DAY"),
    "range_12mo_months": along(month(), where=f"played_at >= {TIP} - INTERVAL 12 MONTH"),
    "last_2_years_artists": ranked("artist_name", where=f"played_at >= {TIP} - INTERVAL 2 YEAR"),
    "span_1996_1998_months": along(month(), PLAYS, f"{LISTEN} AND year(local) BETWEEN 1996 AND 1998"),
    "since_1999_albums": ranked("album_name", "coalesce(artist_name, '')", where="year(local) >= 1999"),
    "winter_years": along(year("(local + INTERVAL 1 MONTH)"), PLAYS, f"{LISTEN} AND month(local) IN (12, 1, 2)"),
    "weekend_evenings": ranked("artist_name", where="isodow(local) IN (6, 7) AND hour(local) >= 18"),
    "running_total_2000": along(month(), where=WHOLE_YEAR, value="round(sum(value) OVER (PARTITION BY user_id ORDER BY label ROWS UNBOUNDED PRECEDING), 2)"),
    "running_total_hours": f"""{H}, m AS (SELECT user_id, hour(local) AS h, {PLAYS} AS v FROM p WHERE {LISTEN} GROUP BY 1, 2),
        s AS (SELECT DISTINCT user_id, h.h FROM m CROSS JOIN (SELECT unnest(range(24)) AS h) h)
        SELECT user_id, CAST(s.h AS VARCHAR) AS label, {NONE} AS sub, sum(coalesce(v, 0.0)) OVER (PARTITION BY user_id ORDER BY s.h ROWS UNBOUNDED PRECEDING) AS value, row_number() OVER (PARTITION BY user_id ORDER BY s.h) AS rank FROM s LEFT JOIN m USING (user_id, h)""",
    "named_genres": ranked(COVER, source=GENRED),
    "genre_lines": split(year(), "genre", HOURS, GENRED, "true", 4),
    "album_lines_running": split(year(), "album_name || chr(31) || artist_name", PLAYS, "p", LISTEN, 3, "sum(value) OVER (PARTITION BY user_id, series ORDER BY label ROWS UNBOUNDED PRECEDING)"),
    "top3_artists_each_year": f"""{H}, m AS (SELECT user_id, {year()} AS label, artist_name AS series, {NONE} AS sub, round({HOURS}, 2) AS value, sum(ms_played) AS ms, count(*) FILTER (WHERE {LISTEN}) AS plays FROM p GROUP BY 1, 2, 3),
        r AS (SELECT * EXCLUDE (ms), row_number() OVER (PARTITION BY user_id, label ORDER BY ms DESC, series) AS rank FROM m)
        SELECT *, count(*) OVER (PARTITION BY user_id) >= 60 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY label DESC, rank) AS row FROM r WHERE rank <= 3) WHERE row <= 60""",
    "top_album_each_month_2000": f"""{H}, m AS (SELECT user_id, {month()} AS label, album_name AS series, artist_name AS sub, {PLAYS} AS value, count(*) AS plays FROM p WHERE {LISTEN} AND {WHOLE_YEAR} GROUP BY 1, 2, 3, 4),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY value DESC, series, sub) AS rank FROM m)
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY label DESC, rank) AS row, false AS truncated FROM r WHERE rank = 1""",
    "top_track_each_year": f"""{H}, c AS (SELECT user_id, {year()} AS label, track_name AS series, artist_name AS sub, track_uri, count(*) AS n FROM p WHERE {LISTEN} GROUP BY 1, 2, 3, 4, 5),
        u AS (SELECT *, row_number() OVER (PARTITION BY user_id, label, series, sub ORDER BY n DESC, track_uri) AS k, CAST(sum(n) OVER (PARTITION BY user_id, label, series, sub) AS BIGINT) AS plays FROM c),
        r AS (SELECT user_id, label, series, sub, CAST(plays AS DOUBLE) AS value, plays, track_uri AS uri, row_number() OVER (PARTITION BY user_id, label ORDER BY plays DESC, series, sub) AS rank FROM u WHERE k = 1)
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY label DESC) AS row, false AS truncated FROM r WHERE rank = 1""",
    "best_month": ranked(month(), metric=PLAYS, where=LISTEN, limit=2),
    "most_skipped_platform": ranked(PLATFORM, NONE, SKIPS, limit=2, having=f"count(*) >= 25 AND {SKIPS} > 0"),
    "numbers_1998": f"""{H} SELECT user_id, count(*) FILTER (WHERE {LISTEN}) AS plays, round({HOURS}, 2) AS hours, count(DISTINCT track_uri) FILTER (WHERE {LISTEN}) AS tracks,
        count(DISTINCT artist_name) FILTER (WHERE {LISTEN}) AS artists, round({SKIPS}, 2) AS skip_rate, count(skipped) AS rated,
        CAST(min(local) FILTER (WHERE {LISTEN}) AS DATE) AS first_day, CAST(max(local) FILTER (WHERE {LISTEN}) AS DATE) AS last_day FROM p WHERE year(local) = 1998 GROUP BY 1""",
    "recent_plays": f"""{H}, o AS (SELECT *, lag(track_uri) OVER (PARTITION BY user_id ORDER BY played_at DESC, track_uri DESC, ms_played DESC) AS prior FROM p WHERE {LISTEN} AND track_name IS NOT NULL),
        r AS (SELECT *, sum(CASE WHEN prior IS NULL OR prior <> track_uri THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY played_at DESC, track_uri DESC, ms_played DESC ROWS UNBOUNDED PRECEDING) AS run FROM o),
        f AS (SELECT user_id, CAST(run AS INTEGER) AS rank, max(played_at) AS ended, arg_max(track_name, (played_at, track_uri, ms_played)) AS label, arg_max(artist_name, (played_at, track_uri, ms_played)) AS sub, count(*) AS times FROM r GROUP BY 1, 2)
        SELECT user_id, rank, label, sub, times, strftime(ended, '%Y-%m-%dT%H:%M:%S') AS played_at FROM f WHERE rank <= 10""",
    "today_so_far": f"""{E}, m AS (SELECT user_id, hour(local) AS h, {PLAYS} AS v FROM p WHERE {LISTEN} AND CAST(local AS DATE) = DATE '2024-01-20' GROUP BY 1, 2),
        s AS (SELECT DISTINCT user_id, h.h FROM m CROSS JOIN (SELECT unnest(range(12)) AS h) h)
        SELECT user_id, CAST(s.h AS VARCHAR) AS label, {NONE} AS sub, coalesce(v, 0.0) AS value, row_number() OVER (PARTITION BY user_id ORDER BY s.h) AS rank FROM s LEFT JOIN m USING (user_id, h)""",
    "first_played": told("min"),
    "last_told": told("max"),
    "behind_1997": f"""{H} SELECT user_id, count(*) AS total_rows FROM p WHERE {LISTEN} AND year(local) = 1997 AND artist_name IS NOT NULL GROUP BY 1""",
    "last_clock": f"""{E}, t AS (SELECT user_id, ((tip AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS tick FROM tips)
        SELECT user_id, strftime(tick, '%a') AS weekday, strftime(tick, '%b') AS month, round((minute(tick) + second(tick) / 60) / 60, 3) AS into_hour FROM t""",
    "today_hours": f"""{E}, m AS (SELECT user_id, hour(local) AS h, {PLAYS} AS v FROM p WHERE {LISTEN} AND CAST(local AS DATE) = DATE '2024-01-19' GROUP BY 1, 2),
        s AS (SELECT DISTINCT user_id, h.h FROM m CROSS JOIN (SELECT unnest(range(24)) AS h) h)
        SELECT user_id, CAST(s.h AS VARCHAR) AS label, {NONE} AS sub, coalesce(v, 0.0) AS value, row_number() OVER (PARTITION BY user_id ORDER BY s.h) AS rank FROM s LEFT JOIN m USING (user_id, h)""",
    "stepped_back": f"""{E}, m AS (SELECT user_id, artist_name AS label, {NONE} AS sub, {PLAYS} AS value FROM w WHERE played_at >= tip - INTERVAL 14 DAY AND played_at < tip - INTERVAL 7 DAY GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, label) AS rank FROM m) WHERE rank <= 10""",
    "named_title": f"""{H}, c AS (SELECT user_id, album_name, artist_name, row_number() OVER (PARTITION BY user_id, album_name ORDER BY count(*) DESC, artist_name) AS r FROM plays WHERE album_name IN ('Brand#13', 'Brand#22') GROUP BY 1, 2, 3),
        m AS (SELECT p.user_id, {year()} AS label, {NONE} AS sub, {PLAYS} AS value FROM p JOIN c ON p.user_id = c.user_id AND p.album_name = c.album_name AND p.artist_name = c.artist_name AND c.r = 1 WHERE {LISTEN} GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY label) AS rank FROM m""",
    "named_artists": f"""{H}, n AS (SELECT 'supplier#000000001' AS series, 1 AS line UNION ALL SELECT 'supplier#000000002', 2 UNION ALL SELECT 'nobody', 3),
        m AS (SELECT user_id, {year()} AS label, lower(artist_name) AS series, round({HOURS}, 2) AS value FROM p WHERE lower(artist_name) IN (SELECT series FROM n) GROUP BY 1, 2, 3)
        SELECT s.user_id, s.label, s.series, s.line, coalesce(m.value, 0.0) AS value FROM (SELECT DISTINCT user_id, label, n.series, line FROM m CROSS JOIN n) s LEFT JOIN m USING (user_id, label, series)""",
    "facts_1999": f"""{H}, l AS (SELECT * FROM p WHERE {LISTEN} AND year(local) = 1999), mo AS (SELECT user_id, strftime(local, '%Y-%m') AS month, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, strftime(local, '%Y-%m') DESC) AS r FROM l GROUP BY 1, 2)
        SELECT l.user_id, count(DISTINCT artist_name) AS artists, count(DISTINCT track_uri) AS songs, CASE WHEN date_diff('day', CAST(min(local) AS DATE), CAST(max(local) AS DATE)) > 62 THEN min(month) END AS busiest_month FROM l JOIN mo ON l.user_id = mo.user_id AND r = 1 GROUP BY 1""",
    "bounds_1999": f"""{H}, o AS (SELECT user_id, min(played_at) AS oldest FROM plays GROUP BY 1)
        SELECT p.user_id, CAST(min(local) AS DATE) AS first_day, CAST(max(local) AS DATE) AS last_day, min(oldest) < min(played_at) AS earlier FROM p JOIN o ON p.user_id = o.user_id WHERE year(local) = 1999 GROUP BY 1""",
    "album_songs": f"""{H} SELECT user_id, album_name, track_uri FROM (SELECT user_id, album_name, track_uri, row_number() OVER (PARTITION BY user_id, album_name ORDER BY count(*) DESC, track_uri) AS r FROM plays WHERE {LISTEN} GROUP BY 1, 2, 3) WHERE r = 1""",
    "scale_peak": f"""{E}, m AS (SELECT user_id, date_diff('day', CAST(played_at AS DATE), CAST(tip AS DATE)) // 7 AS win, hour(local) AS h, {PLAYS} AS v FROM w WHERE artist_name IS NOT NULL GROUP BY 1, 2, 3)
        SELECT user_id, max(v) AS peak FROM m GROUP BY 1""",
    "aligned_years": f"""{H}, m AS (SELECT user_id, {month()} AS label, {PLAYS} AS value FROM p WHERE {LISTEN} AND year(local) = 1998 GROUP BY 1, 2)
        SELECT u.user_id, l.label, coalesce(m.value, 0.0) AS value FROM (SELECT DISTINCT user_id FROM m) u CROSS JOIN (SELECT DISTINCT label FROM m) l LEFT JOIN m ON m.user_id = u.user_id AND m.label = l.label""",
    "hour_intensity": f"""{H}, m AS (SELECT user_id, CAST(isodow(local) AS VARCHAR) AS label, {PLAYS} AS v FROM p WHERE {LISTEN} GROUP BY 1, 2) SELECT user_id, label, round(v / max(v) OVER (PARTITION BY user_id), 4) AS intensity FROM m""",
    "merged_coverage": f"""WITH {A.SOURCES_SQL}, et AS (SELECT user_id, max(played_at) AS t FROM export GROUP BY 1), act AS (SELECT user_id, max(played_at) AS t FROM account GROUP BY 1),
        u AS (SELECT user_id, played_at, 'export' AS source FROM export UNION ALL SELECT a.user_id, a.played_at, 'account' FROM account a LEFT JOIN et ON a.user_id = et.user_id WHERE et.t IS NULL OR a.played_at > et.t
              UNION ALL SELECT l.user_id, l.played_at, 'live' FROM live l LEFT JOIN et ON l.user_id = et.user_id LEFT JOIN act ON l.user_id = act.user_id WHERE (et.t IS NULL OR l.played_at > et.t) AND (act.t IS NULL OR l.played_at > act.t))
        SELECT user_id, source, count(*) AS plays, min(played_at) AS first, max(played_at) AS last FROM u GROUP BY 1, 2""",
    "uri_table": f"""WITH {A.SOURCES_SQL}, k AS (SELECT track_name, artist_name, track_uri FROM export UNION ALL SELECT track_name, artist_name, track_uri FROM live)
        SELECT t, a, track_uri FROM (SELECT {SONG} AS t, {ACT} AS a, track_uri, row_number() OVER (PARTITION BY {SONG}, {ACT} ORDER BY count(*) DESC, track_uri) AS r FROM k GROUP BY 1, 2, 3) WHERE r = 1""",
    "recovered": f"""WITH {A.SOURCES_SQL}, k AS (SELECT DISTINCT {SONG} AS t, {ACT} AS a FROM (SELECT track_name, artist_name FROM export UNION ALL SELECT track_name, artist_name FROM live))
        SELECT user_id, count(*) AS plays, count(k.t) AS recovered, round(count(k.t) / count(*), 4) AS share FROM account LEFT JOIN k ON {SONG} = k.t AND {ACT} = k.a GROUP BY 1""",
    "reread_days": f"""WITH {A.SOURCES_SQL}, n AS (SELECT user_id, CAST(CAST(max(played_at) AS DATE) - INTERVAL 2 DAY AS DATE) AS a FROM live GROUP BY 1), e AS (SELECT user_id, CAST(max(played_at) AS DATE) AS b FROM export GROUP BY 1)
        SELECT coalesce(n.user_id, e.user_id) AS user_id, greatest(a, b) AS first_day FROM n FULL JOIN e ON n.user_id = e.user_id""",
    "prunable": f"""WITH {A.SOURCES_SQL}, t AS (SELECT user_id, max(played_at) AS tip FROM account GROUP BY 1) SELECT l.user_id, CAST(l.played_at AS DATE) AS day FROM live l JOIN t ON l.user_id = t.user_id GROUP BY 1, 2 HAVING max(l.played_at) <= min(t.tip)""",
    "last_played": f"""{H} SELECT user_id, played_at, track_name, artist_name, track_uri FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY played_at DESC, track_uri DESC, artist_name DESC) AS r FROM plays WHERE track_name IS NOT NULL) WHERE r = 1""",
    "gap_estimates": f"""{E}, g AS (SELECT user_id, played_at, min(track_uri) AS track_uri, min(ms_played) AS duration_ms FROM plays GROUP BY 1, 2),
        l AS (SELECT *, (epoch_us(played_at) - epoch_us(lag(played_at) OVER (PARTITION BY user_id ORDER BY played_at, track_uri))) // 1000 AS gap FROM g)
        SELECT user_id, played_at, track_uri, duration_ms, greatest(0, least(duration_ms, coalesce(gap, duration_ms))) AS ms_played FROM l""",
    "week_stats": f"""{E}, b AS (SELECT *, played_at > tip - INTERVAL 7 DAY AS now FROM w WHERE played_at > tip - INTERVAL 14 DAY)
        SELECT user_id, count(*) FILTER (WHERE now) AS plays, count(DISTINCT track_uri) FILTER (WHERE now) AS tracks, count(DISTINCT artist_name) FILTER (WHERE now) AS artists, round(coalesce(sum(ms_played) FILTER (WHERE now), 0) / 3600000.0, 1) AS hours,
        count(*) FILTER (WHERE NOT now) AS plays_prev, count(DISTINCT track_uri) FILTER (WHERE NOT now) AS tracks_prev, count(DISTINCT artist_name) FILTER (WHERE NOT now) AS artists_prev, round(coalesce(sum(ms_played) FILTER (WHERE NOT now), 0) / 3600000.0, 1) AS hours_prev FROM b GROUP BY 1""",
    "artists_up": movers("artist_name", "", 4, 2, True),
    "artists_down": movers("artist_name", "", 4, 2, False),
    "songs_up": movers("track_uri", "min(track_name) AS name,", 3, 2, True),
    "songs_down": movers("track_uri", "min(track_name) AS name,", 3, 2, False),
    "discoveries": f"""{E}, known AS (SELECT DISTINCT user_id, lower(trim(act)) AS act FROM (SELECT user_id, unnest(string_split(artist_name, ',')) AS act FROM w WHERE played_at <= tip - INTERVAL 7 DAY)),
        fresh AS (SELECT user_id, artist_name FROM w GROUP BY 1, 2 HAVING min(played_at) > min(tip) - INTERVAL 7 DAY),
        joint AS (SELECT DISTINCT f.user_id, f.artist_name FROM (SELECT user_id, artist_name, lower(trim(unnest(string_split(artist_name, ',')))) AS act FROM fresh) f JOIN known k ON f.user_id = k.user_id AND f.act = k.act),
        solo AS (SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM joint j WHERE j.user_id = f.user_id AND j.artist_name = f.artist_name)),
        titles AS (SELECT DISTINCT user_id, {SONG} AS title FROM w WHERE played_at <= tip - INTERVAL 7 DAY),
        renamed AS (SELECT w.user_id, w.artist_name FROM w JOIN solo s ON w.user_id = s.user_id AND w.artist_name = s.artist_name JOIN titles t ON t.user_id = w.user_id AND t.title = {SONG} GROUP BY 1, 2 HAVING count(DISTINCT t.title) > 1),
        m AS (SELECT w.user_id, w.artist_name, count(*) AS plays, count(DISTINCT track_uri) AS tracks, count(DISTINCT CAST(played_at AS DATE)) AS days, CAST(min(played_at) AS DATE) AS since FROM w JOIN solo s ON w.user_id = s.user_id AND w.artist_name = s.artist_name
              WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.user_id = w.user_id AND r.artist_name = w.artist_name) GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, days DESC, artist_name) AS rank FROM m WHERE days >= 2 AND plays >= 4) WHERE rank <= 10""",
    "song_discoveries": f"""{E}, old AS (SELECT DISTINCT user_id, {SONG} AS t, {ACT} AS a FROM w WHERE played_at <= tip - INTERVAL 7 DAY),
        fresh AS (SELECT user_id, track_uri, min({SONG}) AS t, min({ACT}) AS a FROM w WHERE track_uri IS NOT NULL GROUP BY 1, 2 HAVING min(played_at) > min(tip) - INTERVAL 7 DAY),
        kept AS (SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = f.user_id AND o.t = f.t AND o.a = f.a)),
        m AS (SELECT w.user_id, w.track_uri, count(*) AS plays, count(DISTINCT CAST(played_at AS DATE)) AS days, CAST(min(played_at) AS DATE) AS since FROM w JOIN kept k ON w.user_id = k.user_id AND w.track_uri = k.track_uri GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, days DESC, track_uri) AS rank FROM m WHERE days >= 2 AND plays >= 4) WHERE rank <= 10""",
    "back_in_rotation": f"""{E}, m AS (SELECT user_id, artist_name, {SPANS} FROM w WHERE artist_name IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recent DESC, artist_name) AS rank FROM m WHERE recent >= 6 AND prior < 4 AND earlier > 0) WHERE rank <= 10""",
    "songs_back_in_rotation": f"""{E}, m AS (SELECT user_id, {SONG} AS t, {ACT} AS a, {SPANS} FROM w WHERE track_uri IS NOT NULL GROUP BY 1, 2, 3),
        n AS (SELECT user_id, {SONG} AS t, {ACT} AS a, track_name AS name, track_uri AS uri, row_number() OVER (PARTITION BY user_id, {SONG}, {ACT} ORDER BY played_at DESC, track_uri DESC, track_name DESC) AS r FROM w)
        SELECT * FROM (SELECT m.*, name, uri, row_number() OVER (PARTITION BY m.user_id ORDER BY recent DESC, m.t, m.a) AS rank FROM m JOIN n ON m.user_id = n.user_id AND m.t = n.t AND m.a = n.a AND r = 1 WHERE recent >= 3 AND prior < 3 AND earlier > 0) WHERE rank <= 10""",
    "on_repeat": f"""{E}, m AS (SELECT user_id, track_uri, count(*) AS plays FROM w WHERE played_at > tip - INTERVAL 7 DAY GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, track_uri) AS rank FROM m) WHERE rank <= 10""",
    "artist_songs": f"""{E} SELECT user_id, artist_name, track_uri FROM (SELECT user_id, artist_name, track_uri, row_number() OVER (PARTITION BY user_id, artist_name ORDER BY count(*) DESC, track_uri) AS r FROM w GROUP BY 1, 2, 3) WHERE r = 1""",
    "card": f"""{H} SELECT user_id, round({HOURS}, 1) AS hours, count(*) AS plays, count(DISTINCT artist_name) AS artists, year(min(played_at)) AS since FROM plays WHERE {LISTEN} GROUP BY 1""",
    "card_genres": f"""{H}, t AS (SELECT user_id, max(played_at) AS tip FROM plays GROUP BY 1), m AS (SELECT p.user_id, genre, {HOURS} AS h FROM plays p JOIN t ON p.user_id = t.user_id JOIN genres g ON lower(artist_name) = g.artist WHERE {LISTEN} AND played_at > tip - INTERVAL 365 DAY GROUP BY 1, 2)
        SELECT user_id, rank, genre, round(h, 1) AS hours, deep AS deep_genres FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h DESC, genre) AS rank, count(*) FILTER (WHERE h >= 5) OVER (PARTITION BY user_id) AS deep FROM m) WHERE rank <= 6""",
    "streaks": f"""{E}, d AS (SELECT DISTINCT user_id, CAST(local AS DATE) AS day FROM p WHERE CAST(local AS DATE) <= DATE '2024-01-31'),
        i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
        r AS (SELECT user_id, count(*) AS n, min(day) AS start, max(day) AS stop FROM i GROUP BY user_id, island), x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stop DESC) AS k FROM r)
        SELECT user_id, CASE WHEN stop >= DATE '2024-01-30' THEN n ELSE 0 END AS streak, CASE WHEN stop >= DATE '2024-01-30' THEN start END AS start FROM x WHERE k = 1""",
    "top_tracks": f"""{H}, m AS (SELECT user_id, track_uri, count(*) AS plays FROM plays WHERE {LISTEN} GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, track_uri) AS rank FROM m) WHERE rank <= 20""",
    "top_artists": f"""{H}, m AS (SELECT user_id, artist_name, sum(ms_played) AS ms FROM plays WHERE {LISTEN} GROUP BY 1, 2) SELECT user_id, rank, artist_name, round(ms / 3600000.0, 2) AS hours FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, artist_name) AS rank FROM m) WHERE rank <= 20""",
    "top_albums": f"""{H}, m AS (SELECT user_id, album_name, artist_name, sum(ms_played) AS ms FROM plays WHERE {LISTEN} GROUP BY 1, 2, 3) SELECT user_id, rank, album_name, artist_name, round(ms / 3600000.0, 2) AS hours FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, album_name, artist_name) AS rank FROM m) WHERE rank <= 20""",
    "familiarity": f"""{H} SELECT user_id, lower(artist_name) AS artist, round({HOURS}, 1) AS hours, count(*) AS plays, count(DISTINCT CAST(played_at AS DATE)) AS days, {LEVEL.replace('days', 'count(DISTINCT CAST(played_at AS DATE))')} AS level FROM plays WHERE {LISTEN} GROUP BY 1, 2""",
    "pins": f"""{H}, f AS (SELECT user_id, min(track_uri) AS uri, min(artist_name) AS artist, min(album_name) AS album FROM plays GROUP BY 1),
        k AS (SELECT user_id, unnest(['s', 'a', 'l']) AS pin FROM f)
        SELECT k.user_id, k.pin, round(coalesce(sum(ms_played), 0) / 3600000.0, 2) AS hours, count(*) FILTER (WHERE {LISTEN}) AS plays, CAST(min(local) FILTER (WHERE {LISTEN}) AS DATE) AS first_day
        FROM k JOIN f ON k.user_id = f.user_id LEFT JOIN p ON p.user_id = k.user_id AND ((pin = 's' AND p.track_uri = f.uri) OR (pin = 'a' AND p.artist_name = f.artist) OR (pin = 'l' AND p.album_name = f.album AND p.artist_name = f.artist)) GROUP BY 1, 2""",
    "shows_joined": f"""{H}, shows AS ({A.SHOWS_SQL}), {SEEN}
        SELECT user_id, s.artist, date, fans, genre, {LEVEL} AS familiarity FROM shows s JOIN seen ON lower(s.artist) = seen.artist LEFT JOIN genres g ON g.artist = lower(s.artist)""",
    "shows_filtered": f"""{H}, shows AS ({A.SHOWS_SQL}), {SEEN}, v AS (SELECT user_id, s.*, days FROM shows s JOIN seen ON lower(s.artist) = seen.artist)
        SELECT user_id, count(*) AS total, count(*) FILTER (WHERE days >= 15 AND (distance_mi IS NULL OR distance_mi <= 60) AND date BETWEEN DATE '1998-02-01' AND DATE '1998-04-02' AND fans <= 90000) AS matching FROM v GROUP BY 1""",
    "namesakes": f"""{H}, c AS (SELECT user_id, lower(replace(album_name, '#', '')) AS title, artist_name, count(*) AS plays FROM plays WHERE {LISTEN} GROUP BY 1, 2, 3),
        o AS (SELECT *, row_number() OVER (PARTITION BY user_id, title ORDER BY plays DESC, artist_name) AS place FROM c),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id, title, lower(trim(artist_name)) ORDER BY place) AS spelling FROM o WHERE place <= 9),
        r AS (SELECT user_id, title, trim(artist_name) AS artist_name, plays, row_number() OVER (PARTITION BY user_id, title ORDER BY place) - 1 AS rank FROM k WHERE spelling = 1)
        SELECT * FROM r WHERE rank BETWEEN 1 AND 3""",
    "artist_weights": f"""{H}, t AS (SELECT user_id, max(played_at) AS tip FROM plays GROUP BY 1) SELECT p.user_id, {ACT} AS artist, sum(ms_played) AS ms FROM plays p JOIN t ON p.user_id = t.user_id WHERE {LISTEN} AND played_at >= tip - INTERVAL 90 DAY GROUP BY 1, 2""",
    "occupancy": f"{H}, {OCCUPIED} SELECT * FROM occ",
    "map_regions": f"""{H}, {OCCUPIED}, r AS (SELECT region, round(median(x), 6) AS x, round(median(y), 6) AS y, count(*) AS all_artists FROM points GROUP BY 1)
        , t AS (SELECT user_id, max(played_at) AS tip FROM plays GROUP BY 1),
        n AS (SELECT p.user_id, region, sum(ms_played) AS ms FROM plays p JOIN t ON p.user_id = t.user_id JOIN points ON points.artist = {ACT} WHERE {LISTEN} AND played_at >= tip - INTERVAL 14 DAY GROUP BY 1, 2),
        q AS (SELECT user_id, region, round(ms / sum(ms) OVER (PARTITION BY user_id), 4) AS recent_share FROM n)
        SELECT occ.user_id, occ.region, x, y, artists, all_artists, share, coalesce(recent_share, 0.0) AS recent_share, hours >= 1 AS yours FROM occ JOIN r USING (region) LEFT JOIN q ON q.user_id = occ.user_id AND q.region = occ.region""",
    "listener_map": f"""{H}, {WEIGHTS}, {POINTS}, t AS (SELECT user_id, max(played_at) AS tip FROM plays GROUP BY 1), r AS (SELECT p.user_id, {ACT} AS artist, sum(ms_played) AS ms FROM plays p JOIN t ON p.user_id = t.user_id WHERE {LISTEN} AND played_at >= tip - INTERVAL 14 DAY GROUP BY 1, 2)
        SELECT w.user_id, w.artist, region, x, y, round(w.ms / 3600000.0, 2) AS hours, round(coalesce(r.ms, 0) / 3600000.0, 2) AS recent_hours FROM weights w JOIN points USING (artist) LEFT JOIN r ON r.user_id = w.user_id AND r.artist = w.artist""",
    "coverage_of_space": f"""{H}, {WEIGHTS}, {POINTS} SELECT user_id, round(sum(CASE WHEN x > 0 THEN ms ELSE 0 END) / sum(ms), 3) AS coverage, count(*) FILTER (WHERE x > 0) AS matched FROM weights LEFT JOIN points USING (artist) GROUP BY 1""",
    "cohesion": f"""WITH {CENTRES} SELECT region, n, CASE WHEN n > 1 THEN round((length * length - n) / (n * n - n), 6) END AS cohesion FROM lengths""",
    "positions": f"""WITH s AS ({A.SPACE_SQL}) SELECT region, round(median(z[1]), 6) AS x, round(median(z[2]), 6) AS y, count(*) AS artists FROM s GROUP BY 1""",
    "placed": f"""WITH {CENTRES}, d AS (SELECT artist, c.region, sum(x * c) AS cosine FROM cells JOIN centres c ON cells.i = c.i GROUP BY 1, 2)
        SELECT artist, region, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY cosine DESC, region) AS r FROM d) WHERE r = 1""",
    "twins": f"""WITH {CENTRES}, d AS (SELECT a.region AS a, b.region AS b, sum(a.c * b.c) AS cosine FROM centres a JOIN centres b ON a.i = b.i AND a.region < b.region GROUP BY 1, 2) SELECT a, b, round(cosine, 6) AS cosine FROM d WHERE cosine > 0.1""",
    "exemplars": f"""WITH {CENTRES}, n AS (SELECT cells.artist, cells.region, sum(x * c) AS near FROM cells JOIN centres c ON cells.i = c.i AND cells.region = c.region GROUP BY 1, 2),
        k AS (SELECT *, CASE WHEN artist % 3 = 0 THEN artist % 101 END AS fame, count(*) OVER (PARTITION BY region) AS size FROM n),
        r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY near DESC, artist) AS by_near, CASE WHEN fame IS NULL THEN size ELSE row_number() OVER (PARTITION BY region ORDER BY fame DESC NULLS LAST, artist) END AS by_fame FROM k)
        SELECT region, rank, artist FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY by_near + by_fame, artist) AS rank FROM r) WHERE rank <= 8""",
    "tag_idf": """WITH t AS (SELECT doc_id, unnest(list_distinct(list_concat([lang, source], regexp_split_to_array(lower(text), '\\s+')))) AS tag FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
        SELECT tag, count(*) AS df, round(ln((1 + min(n)) / (1 + count(*))) + 1, 6) AS idf FROM t CROSS JOIN n GROUP BY 1 HAVING count(*) >= 3""",
    "dominant": """WITH t AS (SELECT DISTINCT p_brand AS genre, p_partkey, unnest(string_split(lower(p_type), ' ')) AS tag FROM part), n AS (SELECT p_brand AS genre, count(*) AS n FROM part GROUP BY 1)
        SELECT t.genre, tag FROM t JOIN n ON t.genre = n.genre GROUP BY 1, 2 HAVING count(*) >= 0.25 * min(n)""",
    "labels_of_regions": """WITH t AS (SELECT p_brand AS region, unnest(string_split(lower(p_type), ' ')[1:4]) AS tag FROM part), c AS (SELECT region, tag, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, tag) AS r FROM t GROUP BY 1, 2)
        SELECT region, string_agg(tag, ', ' ORDER BY r) AS label FROM c WHERE r <= 2 GROUP BY 1""",
    "widened": f"""WITH genres AS ({A.GENRES_SQL}) SELECT DISTINCT genre, {COVER} AS word FROM genres WHERE {COVER} IS NOT NULL""",
    "serving_table": f"""{H} SELECT DISTINCT artist_name, genre FROM plays LEFT JOIN genres g ON lower(artist_name) = g.artist""",
    "deduped_listings": """WITH c AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(s_name) ELSE s_name END AS artist, CAST(o_orderdate AS DATE) AS date, l_orderkey * 8 + l_linenumber AS fetched, CASE WHEN l_returnflag = 'N' THEN '19:30' END AS time,
            CASE WHEN l_returnflag = 'R' THEN o_orderpriority END AS venue, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INTEGER) END AS price_min, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity * 2 AS INTEGER) END AS price_max,
            CASE WHEN l_tax > 0.04 THEN round(l_partkey % 500 / 4.0, 1) END AS distance_mi, CASE WHEN l_linenumber <= 4 THEN CASE WHEN abs(l_quantity * 10 - 340) < 100 THEN 'other' ELSE 'near' END END AS image,
            CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS external_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
        r AS (SELECT *, row_number() OVER (PARTITION BY lower(artist), date ORDER BY (image IS NOT NULL)::INT + coalesce(price_min <> 0, false)::INT + coalesce(distance_mi <> 0, false)::INT + (external_id IS NOT NULL)::INT + (time IS NOT NULL)::INT DESC, fetched, venue NULLS FIRST, price_min NULLS FIRST, distance_mi NULLS FIRST, time NULLS FIRST, image NULLS FIRST, external_id NULLS FIRST, artist) AS r FROM c)
        SELECT artist, date, time, venue, price_min, price_max, distance_mi, image, external_id FROM r WHERE r = 1""",
    "genre_index": """WITH t AS (SELECT DISTINCT p_brand AS genre, p_partkey, unnest(string_split(lower(p_type), ' ')) AS tag FROM part), n AS (SELECT p_brand AS genre, count(*) AS n FROM part GROUP BY 1),
        d AS (SELECT t.genre, tag FROM t JOIN n ON t.genre = n.genre GROUP BY 1, 2 HAVING count(*) >= 0.5 * min(n))
        SELECT n.genre, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS dominant, min(n) AS n_artists, 'calm' AS state FROM n LEFT JOIN d ON n.genre = d.genre GROUP BY 1""",
    "run_totals": """SELECT count(*) AS cases, count(*) FILTER (WHERE l_returnflag = 'R') AS errors, CAST(round(avg(l_quantity)) AS BIGINT) AS avg_latency_ms, CAST(sum(l_partkey) AS BIGINT) AS input_tokens, CAST(sum(l_linenumber) AS BIGINT) AS output_tokens FROM lineitem""",
    "heartbeats": """SELECT event_type AS job, user_id % 5 AS user_id, max(CAST(ts AS TIMESTAMP)) AS last_run, max(CASE WHEN value >= 5 THEN CAST(ts AS TIMESTAMP) END) AS last_ok, count(*) AS runs, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS added,
        coalesce(max(CASE WHEN value >= 5 THEN CAST(ts AS TIMESTAMP) END) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 60 MINUTE, true) AS stalled FROM events GROUP BY 1, 2""",
    "spec_scores": """WITH s AS (SELECT 'segment' AS field, c_mktsegment = 'BUILDING' AS ok FROM customer UNION ALL SELECT 'balance', c_acctbal BETWEEN 0 AND 5000 FROM customer UNION ALL SELECT 'nation', c_nationkey IN (1, 2, 3) FROM customer)
        SELECT field, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 4) AS rate FROM s GROUP BY 1""",
    "reconciled": f"""WITH plays AS ({A.RECENT_SQL}), w AS (SELECT * FROM plays),
        e AS (SELECT DISTINCT user_id, played_at + to_seconds(CAST((ms_played % 61 - 30) * 2 AS BIGINT)) AS played_at, track_uri, track_name, artist_name, ms_played FROM plays),
        x AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = e.user_id AND w.track_uri = e.track_uri AND abs(epoch_us(w.played_at) - epoch_us(e.played_at)) <= 30000000)
              AND NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = e.user_id AND lower(trim(w.track_name)) = lower(trim(e.track_name)) AND lower(trim(w.artist_name)) = lower(trim(e.artist_name)) AND abs(epoch_us(w.played_at) - epoch_us(e.played_at)) <= 30000000))
        SELECT user_id, 'watch' AS how, count(*) AS plays, CAST(sum(ms_played) AS BIGINT) AS ms FROM w GROUP BY 1 UNION ALL SELECT user_id, 'recent', count(*), CAST(sum(ms_played) AS BIGINT) FROM x GROUP BY 1""",
    "timeline": timeline("ms_played / 3600000.0", "true", "24.0"),
    "timeline_steps": timeline("1.0", LISTEN, "greatest(15.5, max(stop))", ramps=False),
    "captured": f"""{E} SELECT user_id, source, count(*) AS plays, max(played_at) AS newest FROM plays WHERE played_at >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2""",
    "compared": f"""{H}, m AS (SELECT user_id, {month()} AS label, {PLAYS} AS v FROM p WHERE {LISTEN} AND year(local) = 1999 AND user_id IN (1, 2, 3) GROUP BY 1, 2)
        SELECT u.user_id, l.label, 'lines' AS kind, sum(coalesce(v, 0.0)) OVER (PARTITION BY u.user_id ORDER BY l.label ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT DISTINCT user_id FROM m) u CROSS JOIN (SELECT DISTINCT label FROM m) l LEFT JOIN m ON m.user_id = u.user_id AND m.label = l.label""",
    "winners_facts": f"""{H}, f AS (SELECT user_id, artist_name, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, artist_name) AS r FROM p WHERE {LISTEN} GROUP BY 1, 2)
        SELECT p.user_id, count(*) FILTER (WHERE {LISTEN}) AS plays, round({HOURS}, 2) AS hours, count(DISTINCT track_uri) FILTER (WHERE {LISTEN}) AS tracks, count(DISTINCT p.artist_name) FILTER (WHERE {LISTEN}) AS artists, round({SKIPS}, 2) AS skip_rate, count(skipped) AS rated,
        CAST(min(local) FILTER (WHERE {LISTEN}) AS DATE) AS first_day, CAST(max(local) FILTER (WHERE {LISTEN}) AS DATE) AS last_day, min(p.artist_name) AS label FROM p JOIN f ON p.user_id = f.user_id AND p.artist_name = f.artist_name AND f.r = 1 GROUP BY 1""",
    "short_titles": """WITH v AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || list_extract([' - Remastered 2011', ' (feat. Somebody)', ' [Live]', '', ' - Part One', ' & Friends!'], CAST(p_partkey % 6 + 1 AS INTEGER)) AS title FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN regexp_replace(title, '( - Remastered 2011| \\(feat. Somebody\\)| \\[Live\\])$', '') ELSE title END AS short,
               CASE WHEN p_partkey % 6 = 5 THEN lower(replace(replace(title, '&', 'and'), '!', '')) ELSE lower(regexp_replace(title, '( - .*| \\(.*| \\[.*)$', '')) END AS key FROM v""",
    "cells": """WITH s AS (SELECT s_suppkey, s_acctbal % 90 AS lat, s_acctbal % 180 AS lon, radians(s_acctbal % 90) AS la, radians(s_acctbal % 180) AS lo, radians(40.7) AS lb, radians(-74.0) AS lp FROM supplier)
        SELECT s_suppkey, round(2 * 3958.8 * asin(sqrt(least(1.0, power(sin((lb - la) / 2), 2) + cos(la) * cos(lb) * power(sin((lp - lo) / 2), 2)))), 3) AS miles, printf('%.2f,%.2f', round(lat, 2), round(lon, 2)) AS cell,
               CASE WHEN lat * 3 BETWEEN -90 AND 90 THEN printf('%.2f,%.2f', round(lat * 3, 2), round(lon, 2)) END AS outside FROM s""",
    "matches": f"""WITH {CENTRES}, d AS (SELECT a.region AS mode_a, a.region % 3 AS a, b.region % 3 AS b, b.region AS mode_b, sum(a.c * b.c) AS cosine FROM centres a JOIN centres b ON a.i = b.i AND a.region % 3 <> b.region % 3 GROUP BY 1, 2, 3, 4),
        n AS (SELECT a, b, mode_a, max(cosine) AS near FROM d GROUP BY 1, 2, 3)
        SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(greatest(0.0, least(1.0, (avg(near) - 0.709) / 0.291)), 3) AS match FROM n GROUP BY 1, 2""",
    "mode_pairs": f"""WITH {CENTRES}, d AS (SELECT a.region AS mode, b.region AS theirs, sum(a.c * b.c) AS cosine FROM centres a JOIN centres b ON a.i = b.i AND a.region % 3 <> b.region % 3 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY mode, theirs % 3 ORDER BY cosine DESC, theirs) AS r FROM d), n AS (SELECT region, n * 1.0 / sum(n) OVER (PARTITION BY region % 3) AS share FROM lengths)
        SELECT CAST(mode % 3 AS BIGINT) AS a, CAST(theirs % 3 AS BIGINT) AS b, mode, theirs, round(cosine, 6) AS cosine, round(share, 6) AS share, 1.0 AS their_share, cosine < 0.709 AS alone FROM r JOIN n ON n.region = mode WHERE r = 1""",
    "profile_totals": f"""{H}, {WEIGHTS}, v AS (SELECT lower(s_name) AS artist, s_nationkey AS region, z FROM supplier JOIN ({A.SPACE_SQL}) e ON e.artist = s_suppkey), c AS (SELECT region, unnest(z) AS x, unnest(range(len(z))) AS i FROM v),
        s AS (SELECT region, i, sum(x) AS s FROM c GROUP BY 1, 2), l AS (SELECT region, sqrt(sum(s * s)) AS length FROM s GROUP BY 1), u AS (SELECT region, i, s / length AS c FROM s JOIN l USING (region)),
        d AS (SELECT a.region AS a, b.region AS b, sum(a.c * b.c) AS cosine FROM u a JOIN u b ON a.i = b.i AND a.region < b.region GROUP BY 1, 2),
        m AS (SELECT DISTINCT user_id, region FROM weights JOIN v USING (artist)),
        o AS (SELECT x.user_id, round(max(cosine), 3) AS overlap FROM d JOIN m x ON x.region = d.a JOIN m y ON y.region = d.b AND y.user_id = x.user_id GROUP BY 1),
        k AS (SELECT user_id, count(*) AS k FROM m GROUP BY 1),
        t AS (SELECT user_id, count(*) AS n_artists, count(v.artist) AS n_matched, round(sum(ms) / 3600000.0, 1) AS hours, round(sum(CASE WHEN v.artist IS NOT NULL THEN ms ELSE 0 END) / sum(ms), 3) AS coverage FROM weights LEFT JOIN v USING (artist) GROUP BY 1)
        SELECT user_id, n_artists, n_matched, hours, coverage, k, coalesce(overlap, 0.0) AS overlap FROM t JOIN k USING (user_id) LEFT JOIN o USING (user_id)""",
    "tag_rates": """WITH c AS (SELECT s_suppkey, n_regionkey, s_acctbal < 2000 AS poor, CASE WHEN s_acctbal < 2000 THEN s_suppkey % 4 = 0 ELSE s_suppkey % 4 <> 0 AND (s_suppkey % 3 <> 0 OR s_nationkey = 0) END AS ok FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        t AS (SELECT 'region ' || n_regionkey AS tag, ok FROM c UNION ALL SELECT CASE WHEN poor THEN 'poor' ELSE 'rich' END, ok FROM c)
        SELECT tag, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 4) AS rate FROM t GROUP BY 1""",
    "run_changes": """WITH x AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'new' WHEN o_orderstatus = 'F' THEN 'gone' WHEN o_totalprice > 100000 AND NOT o_orderpriority < '3' THEN 'regression' WHEN o_totalprice <= 100000 AND o_orderpriority < '3' THEN 'fixed' END AS change FROM orders)
        SELECT change, count(*) AS cases FROM x WHERE change IS NOT NULL GROUP BY 1""",
    "corpus_tags": """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS artist, trim(regexp_replace(lower(unnest(list_concat([lang, source], regexp_split_to_array(lower(text), '\\s+')))), '[\\s_/-]+', ' ', 'g')) AS tag FROM documents WHERE text IS NOT NULL)
        SELECT artist, count(DISTINCT tag) AS n_tags FROM t WHERE tag <> '' AND length(tag) < 40 AND tag NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL) AND NOT list_has_any(regexp_split_to_array(tag, '[^\\p{L}\\p{N}]+'), ['mine', 'wir', 'nous']) GROUP BY 1""",
    "tag_says": """WITH t AS (SELECT DISTINCT p_partkey AS artist, unnest(string_split(lower(p_type || ' brand' || p_brand[7:7] || ' size' || (p_size % 5)), ' ')) AS tag FROM part),
        n AS (SELECT count(DISTINCT artist) AS n FROM t), d AS (SELECT tag, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 3), i AS (SELECT tag, ln((1 + n) / (1 + df)) + 1 AS idf FROM d, n),
        w AS (SELECT artist, tag, idf / sqrt(sum(idf * idf) OVER (PARTITION BY artist)) AS w, count(*) OVER (PARTITION BY artist) AS k FROM t JOIN i USING (tag)),
        s AS (SELECT a.tag, b.tag AS other, sum(b.w / sqrt(1 - a.w * a.w)) AS s FROM w a JOIN w b ON a.artist = b.artist AND a.tag <> b.tag GROUP BY 1, 2),
        h AS (SELECT tag, count(*) AS artists, count(*) FILTER (WHERE k > 1) AS m FROM w GROUP BY 1), l AS (SELECT tag, sum(s * s) AS q FROM s GROUP BY 1),
        c AS (SELECT h.tag, artists, round(CASE WHEN m > 1 THEN (q - m) / (m * (m - 1)) END, 6) AS cohesion FROM h LEFT JOIN l USING (tag))
        SELECT *, row_number() OVER (ORDER BY cohesion NULLS FIRST, tag) AS rank FROM c""",
    "resolved_names": resolved(),
    "watched": watched(),
}
ORACLES["genre_shares"] = f"""WITH f AS ({ORACLES['genre_lines']}) SELECT user_id, label, series, CAST((sign(cents) * ((abs(cents) * 20000 + abs(whole)) // (2 * abs(whole)))) AS DOUBLE) / 100 AS share
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, nullif(CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, label) AS BIGINT), 0) AS whole FROM f)"""

#: How presets are drawn: by period as tables, along dates, in lines or running totals as lines, else as bars.
FORMS = {"top_track_each_year": "table", **dict.fromkeys(("months_distinct_tracks", "genre_lines", "running_total_2000", "winter_years", "best_month"), "line")}
ORACLES["gallery"] = " UNION ALL ".join(f"SELECT '{name}' AS preset, '{FORMS.get(name, 'bar')}' AS form, count(*) AS rows FROM ({ORACLES[name]})" for name in PRESETS)

_SECTIONS = [
    ("artists_up", "artists_up", "artist_name", "recent", "prior"),
    ("artists_down", "artists_down", "artist_name", "recent", "prior"),
    ("songs_up", "songs_up", "track_uri", "recent", "prior"),
    ("songs_down", "songs_down", "track_uri", "recent", "prior"),
    ("discoveries", "discoveries", "artist_name", "plays", "NULL"),
    ("song_discoveries", "song_discoveries", "track_uri", "plays", "NULL"),
    ("back", "back_in_rotation", "artist_name", "recent", "prior"),
    ("songs_back", "songs_back_in_rotation", "uri", "recent", "prior"),
    ("repeat", "on_repeat", "track_uri", "plays", "NULL"),
]
_LONG = E.replace(f"({A.RECENT_SQL})", f"(SELECT * REPLACE ('track:' || artist_name AS track_uri) FROM ({A.RECENT_SQL}))")
ORACLES["weekly_feed"] = " UNION ALL ".join(f"SELECT user_id, '{section}' AS section, rank, {name} AS name, {plays} AS plays, CAST({before} AS BIGINT) AS plays_prev FROM ({ORACLES[query]})" for section, query, name, plays, before in _SECTIONS)
for _name in ("songs_up", "songs_down"):
    ORACLES[_name] = ORACLES[_name].replace(E, _LONG)
