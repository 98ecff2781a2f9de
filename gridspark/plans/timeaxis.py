"""Queries of time axes and calendars (TIM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import calendars
from gridspark.operators import timeaxis
from gridspark.plans.registry import query

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def iso(x: str) -> str:
    return ISO.format(f"CAST({x} AS TIMESTAMP)")


INDEX = """ti AS (SELECT layer_id, t, CAST(row_number() OVER (PARTITION BY layer_id ORDER BY t) - 1 AS INT) AS t_index FROM steps)"""


def index(v):
    return timeaxis.timestep_index(v.file_times)


@query("tim1_timestep_index", ("file_times",), """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY layer_id, t ORDER BY index_in_file, filename, seen_order) AS rn FROM file_times)
SELECT layer_id, t, CAST(row_number() OVER (PARTITION BY layer_id ORDER BY t) - 1 AS INT) AS t_index, filename, index_in_file FROM f WHERE rn = 1""")
def tim1(v):
    return index(v)


@query("tim1_first_seen", ("file_times",), """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY layer_id, t ORDER BY seen_order) AS rn FROM file_times)
SELECT layer_id, t, CAST(row_number() OVER (PARTITION BY layer_id ORDER BY t) - 1 AS INT) AS t_index, filename, index_in_file FROM f WHERE rn = 1""")
def tim1b(v):
    return timeaxis.timestep_index(v.file_times, "first_seen")


@query("tim2_unit_length", ("cf_times",), """
SELECT event_id, CAST(CASE split_part(units, ' ', 1) WHEN 'days' THEN 86400000 WHEN 'hours' THEN 3600000 WHEN 'min' THEN 60000 WHEN 's' THEN 1000 END AS BIGINT) AS ms FROM cf_times""")
def tim2(v):
    return v.cf_times.select("event_id", calendars.unit_length_ms(F.substring_index("units", " ", 1)).alias("ms"))


@query("tim3_parse_time_base", (), """
SELECT event_id, epoch_ms(make_timestamp(1950 + event_id % 120, 1 + user_id % 12, 1 + event_id % 28, event_id % 24, user_id % 60, 0)) + 1500 * (event_id % 30) - (event_id % 13 - 6) * 3600000 AS ms FROM events""")
def tim3(v):
    e, u = F.col("event_id"), F.col("user_id")
    text = F.concat((e % 120 + 1950).cast("string"), F.lit("-"), (u % 12 + 1).cast("string"), F.lit("-"), (e % 28 + 1).cast("string"), F.lit(" "), (e % 24).cast("string"), F.lit(":"), (u % 60).cast("string"), F.lit(":"), (e % 30 * 1.5).cast("string"), F.lit(" "), (e % 13 - 6).cast("string"), F.lit(":00"))
    return v.table("events").select("event_id", calendars.parse_time_base(text, F.lit("gregorian")).alias("ms"))


def _days(calendar: str, y: int, m: int, d: int) -> int:
    """Days of a date in a fixed calendar since 1970, for the SQL."""
    months = calendars.FIXED[calendar]
    return (y - 1970) * sum(months) + sum(months[: m - 1]) + d - 1


BASES = {"view": (1970, 1, 1, 0), "click": (2000, 2, 28, 43_200_000), "purchase": (1999, 12, 30, 500), "signup": (1990, 6, 1, 21_600_000)}
LENGTHS = {"view": 86_400_000, "click": 3_600_000, "purchase": 60_000, "signup": 1000}
STARTS = {"view": "days", "click": "hours", "purchase": "min", "signup": "s"}


def _cf_sql() -> str:
    """The instant of each encoded time: its base per calendar, worked out on days."""
    julian = {"view": 13, "click": 11015 + 13, "purchase": 10955 + 13, "signup": 7456 + 13}  # 13 days behind the Gregorian calendar
    whens = []
    for kind, (y, m, d, ms) in BASES.items():
        gregorian = f"date_diff('day', DATE '1970-01-01', DATE '{y}-{m:02d}-{d:02d}')"
        per = [f"WHEN '{c}' THEN {_days(c, y, m, d)}" for c in calendars.FIXED] + [f"WHEN 'gregorian' THEN {gregorian}", f"WHEN 'julian' THEN {julian[kind]}"]
        whens.append(f"WHEN '{STARTS[kind]}' THEN (CASE calendar {' '.join(per)} END) * 86400000 + {ms} + CAST(trunc(num * {LENGTHS[kind]}) AS BIGINT)")
    return f"CAST(CASE split_part(units, ' ', 1) {' '.join(whens)} END AS BIGINT)"


@query("tim4_decode_cf_time", ("cf_times",), f"SELECT event_id, {_cf_sql()} AS ms, CASE WHEN units LIKE 'fortnights%' THEN 'unknown unit' END AS error FROM cf_times")
def tim4(v):
    ms, error = calendars.decode_cf_time(F.col("num"), F.col("units"), F.col("calendar"))
    return v.cf_times.select("event_id", ms.alias("ms"), error.alias("error"))


def _starts_sql(lengths) -> str:
    return "[" + ", ".join(str(sum(lengths[:k])) for k in range(12)) + "]"


def _fields_sql(day: str) -> str:
    """struct(year, month, day) of a day number, by calendar: the year, the day of the year, then the months' first days."""
    fixed = {c: (f"CAST(floor({day} / {sum(m)}.0) AS BIGINT) + 1970", f"({day} % {sum(m)} + {sum(m)}) % {sum(m)}", _starts_sql(m)) for c, m in calendars.FIXED.items()}
    # the Julian calendar is 13 days behind in 1970, and its years come in fours that begin with a leap year: 1968
    four = f"({day} - 13 + 731)"
    rest = f"(({four} % 1461 + 1461) % 1461)"
    late = f"CASE WHEN {rest} < 366 THEN 0 ELSE 1 + ({rest} - 366) // 365 END"
    of_year = f"CASE WHEN {rest} < 366 THEN {rest} ELSE ({rest} - 366) % 365 END"
    starts = f"CASE WHEN {rest} < 366 THEN {_starts_sql(calendars.FIXED['all_leap'])} ELSE {_starts_sql(calendars.FIXED['noleap'])} END"
    fixed["julian"] = (f"1968 + 4 * CAST(floor({four} / 1461.0) AS BIGINT) + {late}", of_year, starts)
    cases = "".join(f" WHEN '{c}' THEN {{'y': {y}, 'd': {d}, 's': {s}}}" for c, (y, d, s) in fixed.items())
    return f"CASE calendar{cases} END"


_DATE_SQL = f"""d AS (SELECT *, {_fields_sql('day')} AS f FROM n),
e AS (SELECT *, CASE WHEN calendar = 'gregorian' THEN year(DATE '1970-01-01' + CAST(day AS INT)) ELSE f.y END AS year, CASE WHEN calendar = 'gregorian' THEN month(DATE '1970-01-01' + CAST(day AS INT)) ELSE len(list_filter(f.s, lambda x: x <= f.d)) END AS month FROM d)"""


@query("tim5_calendar_fields", ("cf_times",), f"""
WITH n AS (SELECT event_id, calendar, CAST(floor(num * 30) AS BIGINT) AS day FROM cf_times), {_DATE_SQL}
SELECT event_id, calendar, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(CASE WHEN calendar = 'gregorian' THEN day(DATE '1970-01-01' + CAST(day AS INT)) ELSE f.d - f.s[month] + 1 END AS INT) AS day FROM e""")
def tim5(v):
    day = F.floor(F.col("num") * 30).cast("long") * calendars.DAY
    f = calendars.calendar_fields(day, F.col("calendar"))
    return v.cf_times.select("event_id", "calendar", *[f[k].alias(k) for k in ("year", "month", "day")])


@query("tim5_round_trip", ("cf_times",), """
SELECT event_id, calendar, CAST(floor(num * 86400000 * 3) AS BIGINT) AS ms FROM cf_times""")
def tim5b(v):
    """Fields and back again, in every calendar."""
    parts = ("year", "month", "day", "hour", "minute", "second", "ms")
    f = calendars.calendar_fields(F.floor(F.col("num") * 86_400_000 * 3).cast("long"), F.col("calendar"))
    fields = v.cf_times.select("event_id", "calendar", f.alias("f"))
    return fields.select("event_id", "calendar", calendars.calendar_ms(F.col("calendar"), *[F.col(f"f.{k}") for k in parts]).alias("ms"))


_SIZES = "CASE calendar" + "".join(f" WHEN '{c}' THEN {sum(m)}" for c, m in calendars.FIXED.items()) + " END"


@query("tim6_calendar_add_months", ("cf_times",), f"""
WITH n AS (SELECT event_id, calendar, CAST(floor(num * 30) AS BIGINT) AS day, event_id % 41 - 20 AS add FROM cf_times), {_DATE_SQL},
k AS (SELECT *, {_SIZES} AS size, CAST(trunc(add / 12.0) AS BIGINT) AS years, month - 1 + add - 12 * CAST(trunc(add / 12.0) AS BIGINT) AS to_month FROM e WHERE calendar NOT IN ('gregorian', 'julian'))
SELECT event_id, calendar, (day + years * size + CAST(floor(to_month / 12.0) AS BIGINT) * size + f.s[CAST((to_month % 12 + 12) % 12 AS INT) + 1] - f.s[month]) * 86400000 AS ms FROM k
UNION ALL SELECT event_id, calendar, NULL FROM cf_times WHERE calendar IN ('gregorian', 'julian')""")
def tim6(v):
    """In the calendars whose years are all alike; null in the others."""
    start = F.floor(F.col("num") * 30).cast("long") * calendars.DAY
    return v.cf_times.select("event_id", "calendar", calendars.calendar_add_months(start, F.col("event_id") % 41 - 20, F.col("calendar")).alias("ms"))


@query("tim7_julian_fields", ("cf_times",), f"""
WITH n AS (SELECT event_id, 'julian' AS calendar, CAST(floor(num * 1000) AS BIGINT) AS day FROM cf_times), {_DATE_SQL}
SELECT event_id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(f.d - f.s[month] + 1 AS INT) AS day FROM e""")
def tim7(v):
    f = calendars.julian_fields(F.floor(F.col("num") * 1000).cast("long") * calendars.DAY)
    return v.cf_times.select("event_id", *[f[k].alias(k) for k in ("year", "month", "day")])


@query("tim8_iso", (), f"SELECT event_id, {iso('ts')} AS iso, strftime(ts, '%H:%M:%S.%g') || 'Z' AS clock, date_trunc('millisecond', ts) AS back FROM events")
def tim8(v):
    text = calendars.format_iso(F.col("ts"))
    return v.table("events").select("event_id", text.alias("iso"), calendars.format_time_only(F.col("ts")).alias("clock"), calendars.parse_iso(text).cast("timestamp_ntz").alias("back"))


@query("tim9_nearest_time", ("event_steps", "event_targets"), """
WITH b AS (SELECT r.request_id, r.layer_id, max(s.t) FILTER (s.t <= r.ts) AS b, min(s.t) FILTER (s.t >= r.ts) AS a FROM event_targets r JOIN event_steps s ON s.layer_id = r.layer_id GROUP BY 1, 2)
SELECT r.request_id, r.layer_id, CASE WHEN a IS NULL OR epoch_us(r.ts) - epoch_us(b) <= epoch_us(a) - epoch_us(r.ts) THEN coalesce(b, a) ELSE a END AS t FROM event_targets r JOIN b ON b.request_id = r.request_id""")
def tim9(v):
    return timeaxis.nearest_time(v.event_steps, v.event_targets).drop("ts")


@query("tim10_current_time", ("event_steps", "event_targets"), """
SELECT r.request_id, r.layer_id, coalesce(max(s.t) FILTER (s.t <= r.ts), min(s.t)) AS t FROM event_targets r JOIN event_steps s ON s.layer_id = r.layer_id GROUP BY 1, 2""")
def tim10(v):
    return timeaxis.current_time(v.event_steps, v.event_targets).drop("ts")


ASKED = "rq AS (SELECT event_id AS request_id, CASE user_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS layer_id, DATE '1992-01-01' + CAST((event_id * 37) % 2600 AS INT) AS t FROM events)"


def asked(v):
    e = v.table("events")
    return e.select(F.col("event_id").alias("request_id"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("user_id") % 3 + 1).cast("int")).alias("layer_id"), F.date_add(F.lit("1992-01-01").cast("date"), ((F.col("event_id") * 37) % 2600).cast("int")).alias("t"))


@query("tim11_match_time", ("steps",), f"WITH {INDEX}, {ASKED} SELECT rq.request_id, rq.layer_id, rq.t, ti.t_index FROM rq JOIN ti ON ti.layer_id = rq.layer_id AND ti.t = rq.t")
def tim11(v):
    return timeaxis.match_time(asked(v), index(v)).select("request_id", "layer_id", "t", "t_index")


@query("tim11_unmatched_time", ("steps",), f"WITH {INDEX}, {ASKED} SELECT rq.* FROM rq ANTI JOIN ti ON ti.layer_id = rq.layer_id AND ti.t = rq.t")
def tim11b(v):
    return timeaxis.unmatched_time(asked(v), index(v)).select("request_id", "layer_id", "t")


EXPR = """rq AS (SELECT c_custkey AS request_id, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS layer_id, DATE '1992-01-01' + CAST((c_custkey * 37) % 2400 AS INT) AS a, DATE '1992-01-01' + CAST((c_custkey * 37) % 2400 + c_custkey % 9 - 1 AS INT) AS b, c_custkey % 4 AS kind FROM customer)"""


def expressions(v):
    k = F.col("c_custkey")
    a, b = (F.date_add(F.lit("1992-01-01").cast("date"), ((k * 37) % 2400 + d).cast("int")).cast("string") for d in (F.lit(0), k % 9 - 1))
    text = F.when(k % 4 == 0, F.concat(a, F.lit("/"), b)).when(k % 4 == 1, F.concat(a, F.lit(",current"))).when(k % 4 == 2, F.concat_ws("/", a, b, b))
    return v.table("customer").select(k.alias("request_id"), F.element_at(F.array(*map(F.lit, "FOP")), (k % 3 + 1).cast("int")).alias("layer_id"), text.alias("time"))


NOW = "1996-06-15"
RESOLVED = f"""{INDEX}, {EXPR},
cur AS (SELECT layer_id, coalesce(max(t) FILTER (t <= DATE '{NOW}'), min(t)) AS t FROM steps GROUP BY 1),
part AS (SELECT request_id, layer_id, 0 AS seq, a, b, 2 AS n FROM rq WHERE kind = 0 UNION ALL SELECT request_id, layer_id, 0, a, a, 1 FROM rq WHERE kind = 1
  UNION ALL SELECT rq.request_id, rq.layer_id, CASE kind WHEN 1 THEN 1 ELSE 0 END, cur.t, cur.t, 1 FROM rq LEFT JOIN cur ON cur.layer_id = rq.layer_id WHERE kind IN (1, 3) UNION ALL SELECT request_id, layer_id, 0, a, b, 3 FROM rq WHERE kind = 2),
fd AS (SELECT p.*, x.t_index AS ai, y.t_index AS bi FROM part p LEFT JOIN ti x ON x.layer_id = p.layer_id AND x.t = p.a LEFT JOIN ti y ON y.layer_id = p.layer_id AND y.t = p.b),
er AS (SELECT request_id, arg_min(CASE WHEN n > 2 THEN 'more than one /' WHEN ai IS NULL OR bi IS NULL THEN 'no such time' ELSE 'ends before it begins' END, seq) AS error FROM fd WHERE n > 2 OR ai IS NULL OR bi IS NULL OR ai > bi GROUP BY 1)"""


@query("tim12_resolve_time_expr", ("steps",), f"""WITH {RESOLVED}
SELECT fd.request_id, CAST(fd.seq AS INT) AS seq, ti.t_index, ti.t FROM fd ANTI JOIN er ON er.request_id = fd.request_id JOIN ti ON ti.layer_id = fd.layer_id AND ti.t_index BETWEEN fd.ai AND fd.bi""")
def tim12(v):
    return timeaxis.resolve_time_expr(expressions(v), index(v), NOW)[0]


@query("tim12_time_expr_errors", ("steps",), f"WITH {RESOLVED} SELECT * FROM er")
def tim12b(v):
    return timeaxis.resolve_time_expr(expressions(v), index(v), NOW)[1]


@query("tim13_dates_with_data", ("steps",), """
SELECT DISTINCT layer_id, CAST(year(t) AS INT) AS y, CAST(month(t) - 1 AS INT) AS m, CAST(day(t) AS INT) AS d, CAST(dense_rank() OVER (PARTITION BY layer_id, year(t), month(t) ORDER BY day(t)) - 1 AS INT) AS place FROM steps""")
def tim13(v):
    """The whole nested map taken apart, as maps can't be compared; place is a day's place in its month's list."""
    out = timeaxis.dates_with_data(v.steps).select("layer_id", F.explode("dates").alias("y", "months")).select("layer_id", "y", F.explode("months").alias("m", "days"))
    return out.select("layer_id", "y", "m", F.posexplode("days").alias("place", "d"))


@query("tim14_timesteps_on_day", ("event_steps", "event_targets"), """
SELECT r.request_id, r.layer_id, CAST(r.ts AS DATE) AS day, s.t, strftime(s.t, '%H:%M:%S.%g') || 'Z' AS time FROM event_targets r JOIN event_steps s ON s.layer_id = r.layer_id AND CAST(s.t AS DATE) = CAST(r.ts AS DATE)""")
def tim14(v):
    return timeaxis.timesteps_on_day(v.event_steps, v.event_targets.select("request_id", "layer_id", F.to_date("ts").alias("day")))


@query("tim15_animation_timesteps", ("steps",), f"""
WITH RECURSIVE pr AS (SELECT * FROM (VALUES ('Daily', INTERVAL 1 DAY), ('Weekly', INTERVAL 7 DAY), ('Monthly', INTERVAL 1 MONTH), ('Bi-monthly', INTERVAL 2 MONTH), ('Twice-yearly', INTERVAL 6 MONTH), ('Yearly', INTERVAL 12 MONTH)) AS v(label, period)),
nx AS (SELECT s.layer_id, pr.label, s.t, (SELECT min(u.t) FROM steps u WHERE u.layer_id = s.layer_id AND u.t >= s.t + pr.period) AS next FROM steps s CROSS JOIN pr),
k AS (SELECT layer_id, label, min(t) AS t FROM nx GROUP BY 1, 2 UNION ALL SELECT n.layer_id, n.label, n.next FROM k JOIN nx n ON n.layer_id = k.layer_id AND n.label = k.label AND n.t = k.t WHERE n.next IS NOT NULL)
SELECT layer_id, label, CAST(count(*) AS INT) AS frames, string_agg({iso('t')}, ',' ORDER BY t) AS times FROM k GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT layer_id, 'Full', CAST(count(*) AS INT), {iso('min(t)')} || '/' || {iso('max(t)')} FROM steps GROUP BY 1""")
def tim15(v):
    return timeaxis.animation_timesteps(v.steps)


@query("tim16_regular_runs", ("event_steps",), """
WITH g AS (SELECT layer_id, t, epoch_us(t) // 1000 AS ms, epoch_us(lead(t) OVER w) // 1000 - epoch_us(t) // 1000 AS gap FROM event_steps WINDOW w AS (PARTITION BY layer_id ORDER BY t)),
n AS (SELECT *, CASE WHEN gap = lag(gap) OVER (PARTITION BY layer_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM g WHERE gap IS NOT NULL),
r AS (SELECT *, sum(new) OVER (PARTITION BY layer_id ORDER BY t) - 1 AS run FROM n)
SELECT layer_id, CAST(run AS BIGINT) AS run, min(ms) AS first, min(ms) + count(*) * max(gap) AS last, max(gap) AS spacing, CAST(count(*) + 1 AS INT) AS n FROM r GROUP BY 1, 2""")
def tim16a(v):
    return timeaxis.regular_runs(v.event_steps)


RUNS = """g AS (SELECT layer_id, epoch_us(CAST(t AS TIMESTAMP)) // 1000 AS ms, epoch_us(CAST(lead(t) OVER w AS TIMESTAMP)) // 1000 - epoch_us(CAST(t AS TIMESTAMP)) // 1000 AS gap, count(*) OVER (PARTITION BY layer_id) AS steps FROM {steps} WINDOW w AS (PARTITION BY layer_id ORDER BY t)),
gn AS (SELECT *, CASE WHEN gap = lag(gap) OVER (PARTITION BY layer_id ORDER BY ms) THEN 0 ELSE 1 END AS new FROM g WHERE gap IS NOT NULL OR steps = 1),
gr AS (SELECT *, sum(new) OVER (PARTITION BY layer_id ORDER BY ms) - 1 AS run FROM gn),
runs AS (SELECT layer_id, CAST(run AS BIGINT) AS run, min(ms) AS first, coalesce(max(gap), 0) AS spacing, count(gap) + 1 AS n FROM gr GROUP BY 1, 2)"""

#: One run is chosen in each step of the walk: the longest still to choose, the first of equals, takes its borders.
TIME_RANGES = RUNS + f""",
walk AS (
  SELECT layer_id, 0 AS depth, list({{'k': run, 'size': n, 'waits': true, 'f': 0, 'b': 0, 'l': run > 0, 'r': run < last}} ORDER BY run) AS s FROM (SELECT *, max(run) OVER (PARTITION BY layer_id) AS last FROM runs) GROUP BY layer_id
  UNION ALL
  SELECT layer_id, depth + 1, list_transform(s, lambda x: {{'k': x.k, 'size': x.size - CASE WHEN (x.k = i - 1 AND x.r) OR (x.k = i + 1 AND x.l) THEN 1 ELSE 0 END, 'waits': x.waits AND x.k <> i,
         'f': CASE WHEN x.k = i + 1 AND x.l THEN 1 ELSE x.f END, 'b': CASE WHEN x.k = i - 1 AND x.r THEN 1 ELSE x.b END, 'l': x.l AND x.k NOT IN (i, i + 1), 'r': x.r AND x.k NOT IN (i, i - 1)}})
  FROM (SELECT layer_id, depth, s, -(list_max(list_transform(list_filter(s, lambda x: x.waits), lambda x: {{'a': x.size, 'b': -x.k}})).b) AS i FROM walk WHERE len(list_filter(s, lambda x: x.r)) > 0) AS q),
ended AS (SELECT layer_id, unnest(arg_max(s, depth)) AS x FROM walk GROUP BY 1),
cut AS (SELECT r.layer_id, r.run, r.first + e.x.f * r.spacing AS a, r.first + (r.n - 1 - e.x.b) * r.spacing AS z, r.spacing, r.n - e.x.f - e.x.b AS n FROM ended e JOIN runs r ON r.layer_id = e.layer_id AND r.run = e.x.k)
SELECT layer_id, string_agg({ISO.format("make_timestamp(a * 1000)")} || CASE n WHEN 1 THEN '' WHEN 2 THEN ',' || {ISO.format("make_timestamp(z * 1000)")} ELSE '/' || {ISO.format("make_timestamp(z * 1000)")} || '/' || PERIOD END, ',' ORDER BY run) AS times FROM cut WHERE n > 0 GROUP BY 1""".replace("PERIOD", """'P' || CASE WHEN spacing >= 86400000 THEN CAST(spacing // 86400000 AS VARCHAR) || 'D' ELSE '' END || CASE WHEN spacing % 86400000 > 0 THEN 'T' ELSE '' END || CASE WHEN spacing % 86400000 >= 3600000 THEN CAST(spacing % 86400000 // 3600000 AS VARCHAR) || 'H' ELSE '' END || CASE WHEN spacing % 3600000 >= 60000 THEN CAST(spacing % 3600000 // 60000 AS VARCHAR) || 'M' ELSE '' END || CASE WHEN spacing % 60000 > 0 THEN CAST(spacing % 60000 // 1000 AS VARCHAR) || CASE WHEN spacing % 1000 > 0 THEN '.' || rtrim(lpad(CAST(spacing % 1000 AS VARCHAR), 3, '0'), '0') ELSE '' END || 'S' ELSE '' END""")


@query("tim16_time_ranges", ("steps",), "WITH RECURSIVE " + TIME_RANGES.replace("{steps}", "steps"))
def tim16(v):
    return timeaxis.time_ranges(v.steps)


@query("tim16_time_ranges_of_events", ("event_steps",), "WITH RECURSIVE " + TIME_RANGES.replace("{steps}", "event_steps"))
def tim16e(v):
    """Axes to the millisecond, most of whose runs are two steps."""
    return timeaxis.time_ranges(v.event_steps)


@query("tim17_format_period", (), """
WITH p AS (SELECT event_id, event_id * 123457 % 400000000 AS ms FROM events),
q AS (SELECT event_id, ms // 86400000 AS d, ms % 86400000 AS r, ms % 86400000 // 3600000 AS h, ms % 3600000 // 60000 AS m, ms % 60000 AS l FROM p)
SELECT event_id, 'P' || CASE WHEN d > 0 THEN d || 'D' ELSE '' END || CASE WHEN r > 0 THEN 'T' ELSE '' END || CASE WHEN h > 0 THEN h || 'H' ELSE '' END || CASE WHEN m > 0 THEN m || 'M' ELSE '' END ||
       CASE WHEN l > 0 THEN (l // 1000) || CASE WHEN l % 1000 > 0 THEN '.' || rtrim(lpad(CAST(l % 1000 AS STRING), 3, '0'), '0') ELSE '' END || 'S' ELSE '' END AS period FROM q""")
def tim17(v):
    return v.table("events").select("event_id", calendars.format_period((F.col("event_id") * 123457) % 400_000_000).alias("period"))


@query("tim18_calendar_name", ("cf_times",), "SELECT event_id, CASE calendar WHEN 'gregorian' THEN 'ISO8601' ELSE calendar END AS name FROM cf_times")
def tim18(v):
    return v.cf_times.select("event_id", calendars.calendar_name(F.col("calendar")).alias("name"))
