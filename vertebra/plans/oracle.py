"""DuckDB oracle SQL for every registered query (same tables, same column names).

Fragments below spell out the same arithmetic as the Column helpers, in the
same evaluation order, so doubles agree bit for bit.
"""

from __future__ import annotations

from ..schemas import AVG_COLUMNS

TS_TEXT = "strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S.%f') || ' +0900'"
HEX = "lower(hex(encode(props)))"

FRAMES = """
n AS (SELECT count(*) AS n FROM embeddings),
fr AS (
  SELECT e.event_id, e.user_id, e.ts, e.event_type, e.props,
         CASE WHEN e.event_type <> 'error' THEN v.embedding[1:12]::DOUBLE[] END AS lm
  FROM events e CROSS JOIN n LEFT JOIN embeddings v ON v.vec_id = ((e.event_id % n.n) + n.n) % n.n
)"""


def _angle(a, b, c):
    """angle3d over coordinate triples of SQL expressions."""
    ba = [f"(({a[i]}) - ({b[i]}))" for i in range(3)]
    bc = [f"(({c[i]}) - ({b[i]}))" for i in range(3)]
    dot = f"({ba[0]} * {bc[0]} + {ba[1]} * {bc[1]} + {ba[2]} * {bc[2]})"
    n1 = f"sqrt({ba[0]} * {ba[0]} + {ba[1]} * {ba[1]} + {ba[2]} * {ba[2]})"
    n2 = f"sqrt({bc[0]} * {bc[0]} + {bc[1]} * {bc[1]} + {bc[2]} * {bc[2]})"
    cos = f"(CASE WHEN ({n1} * {n2}) = 0 THEN NULL ELSE {dot} / ({n1} * {n2}) END)"
    return f"(round_even(degrees(acos({cos})), 2))"


C7 = ["((lm[1] + lm[4]) / 2)", "((lm[2] + lm[5]) / 2)", "((lm[3] + lm[6]) / 2)"]
LE = ["lm[7]", "lm[8]", "lm[9]"]
RE = ["lm[10]", "lm[11]", "lm[12]"]
C7_DOWN = [C7[0], C7[1], f"({C7[2]} + -0.1)"]
C7_FWD = [f"({C7[0]} + 0.1)", C7[1], C7[2]]

ANALYZED = f"""
an0 AS (
  SELECT *, {_angle(LE, C7, C7_DOWN)} AS cva_left, {_angle(RE, C7, C7_DOWN)} AS cva_right,
            {_angle(LE, C7, C7_FWD)} AS fha_left, {_angle(RE, C7, C7_FWD)} AS fha_right
  FROM fr
),
an AS (
  SELECT *, CASE WHEN lm IS NULL THEN NULL ELSE
    (coalesce(cva_left >= 50 AND NOT isnan(cva_left), false)
     OR coalesce(cva_right >= 50 AND NOT isnan(cva_right), false))
    AND (coalesce(fha_left >= 80 AND NOT isnan(fha_left), false)
     OR coalesce(fha_right >= 80 AND NOT isnan(fha_right), false)) END AS posture_correct
  FROM an0
)"""

CAL = """
  year(ts + INTERVAL 9 HOUR)::INTEGER AS year_id,
  month(ts + INTERVAL 9 HOUR)::INTEGER AS month_id,
  day(ts + INTERVAL 9 HOUR)::INTEGER AS day_id,
  weekofyear(ts + INTERVAL 9 HOUR)::INTEGER AS week_id"""

FACTS = f"""
facts AS (
  SELECT sha256(concat_ws('|', 'posture', event_id::VARCHAR, {TS_TEXT})) AS posture_id,
         'image_' || sha256(concat_ws('|', 'file', event_id::VARCHAR, {TS_TEXT})) || '.jpg' AS img_filename,
         user_id::VARCHAR AS user_id,
         cva_left AS cva_left_value, cva_right AS cva_right_value,
         fha_left AS fha_left_value, fha_right AS fha_right_value,
         posture_correct AS posture_status, {CAL}, ts AS timestamp, lm
  FROM an
)"""

_PT = {"left_shoulder": (1, 2, 3), "right_shoulder": (4, 5, 6), "left_ear": (7, 8, 9),
       "right_ear": (10, 11, 12)}


def _coord(p, i):
    if p == "c7":
        return C7[i]
    return f"lm[{_PT[p][i]}]"


_MART_AVGS = ",\n         ".join(
    f"round_even(avg({_coord(c[4:c.rindex('_')], 'xyz'.index(c[-1]))}), 3) AS {c}" for c in AVG_COLUMNS)

MART = f"""
mart AS (
  SELECT sha256(concat_ws('|', 'daily', year_id::VARCHAR, month_id::VARCHAR, day_id::VARCHAR,
                          posture_status::VARCHAR)) AS daily_stat_id,
         year_id, month_id, day_id,
         {_MART_AVGS},
         posture_status AS posture_correct,
         printf('average_%s_%d-%d-%d.png', CASE WHEN posture_status THEN 'correct' ELSE 'incorrect' END,
                year_id, month_id, day_id) AS img_filename,
         count(*) AS cnt
  FROM facts WHERE posture_status IS NOT NULL
  GROUP BY year_id, month_id, day_id, posture_status
)"""

MSGS = f"""
msgs AS (
  SELECT event_id, user_id, ts, {TS_TEXT} AS timestamp, {HEX} AS image_data, props FROM events
)"""

CORRUPT = f"""
cmsgs AS (
  SELECT event_id, user_id, ts,
         CASE WHEN event_id % 50 = 2 THEN 'bad' ELSE {TS_TEXT} END AS timestamp,
         CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 'zz' ELSE {HEX} END AS image_data
  FROM events
)"""

SCORE = ("CASE WHEN correct_cnt + incorrect_cnt = 0 THEN 0.0 ELSE "
         "round_even(correct_cnt::DOUBLE / (correct_cnt + incorrect_cnt) * 100, 2) END")

COUNTS = ("coalesce(sum(CASE WHEN posture_correct THEN cnt END), 0)::BIGINT AS correct_cnt, "
          "coalesce(sum(CASE WHEN NOT coalesce(posture_correct, false) THEN cnt END), 0)::BIGINT AS incorrect_cnt")


def _with(*parts):
    return "WITH " + ",".join(parts) + "\n"


BASE = (FRAMES, ANALYZED, FACTS, MART)

WEEK_CAL = ("year_id BETWEEN 2024 AND 2024 AND make_date(year_id, month_id, day_id) "
            "BETWEEN DATE '2024-01-24' AND DATE '2024-01-31'")
# the literal rule for 2024-01-24 .. 2024-01-31, as numbers yyyymmdd
_YMD = "(year_id * 10000 + month_id * 100 + day_id)"
LIT_HEAD = f"{_YMD} BETWEEN 20240124 AND 20240131"
LIT_REST = f"{_YMD} BETWEEN 20240201 AND 20241231 OR {_YMD} BETWEEN 20240101 AND 20240131"
WEEK_LIT = f"{LIT_HEAD} OR {LIT_REST}"


def _weekly_landmarks(mode):
    sel = []
    for cls in ("true", "false"):
        if mode == "calendar":
            pred = f"posture_correct = {cls} AND {WEEK_CAL}"
        else:
            pred = f"(posture_correct = {cls} AND {LIT_HEAD}) OR {LIT_REST}"
        cols = ", ".join(
            f"sum(CASE WHEN {pred} THEN round_even({c} * 1000.0, 0)::BIGINT END)::DOUBLE / "
            f"(count(CASE WHEN {pred} THEN round_even({c} * 1000.0, 0)::BIGINT END) * 1000.0) AS {c}"
            for c in AVG_COLUMNS)
        sel.append(f"SELECT {cls} AS posture_correct, {cols} FROM mart")
    return _with(*BASE) + "\nUNION ALL\n".join(sel)


GOOD, BAD = "옳은 자세입니다", "자세를 바르게 해주세요"
LABEL = f"CASE WHEN posture_correct = true THEN '{GOOD}' WHEN posture_correct = false THEN '{BAD}' END"

_JSON_NUM = "coalesce({0}::VARCHAR, 'null')"

SQL: dict[str, str] = {
    "q_decode_messages": _with(MSGS) + """
SELECT event_id, timestamp, image_data, ts AS event_ts, true AS json_ok FROM msgs""",

    "q_nonnull_frames": _with(CORRUPT) + """
SELECT event_id, timestamp, image_data FROM cmsgs WHERE image_data IS NOT NULL""",

    "q_quarantine": _with(CORRUPT) + """
SELECT event_id, CASE WHEN image_data = 'zz' THEN 'bad_hex' ELSE 'bad_timestamp' END AS reason
FROM cmsgs WHERE event_id % 50 IN (1, 2)""",

    "q_decode_hex": """
SELECT event_id, octet_length(encode(props))::INTEGER AS n_bytes, props AS text FROM events""",

    "q_encode_frames": _with(FRAMES) + f"""
SELECT event_id, '{{"timestamp":"' || {TS_TEXT} || '","image_data":"' || {HEX} || '"}}' AS value FROM fr""",

    "q_surrogate_keys": _with(FRAMES) + f"""
SELECT event_id,
       sha256(concat_ws('|', 'posture', event_id::VARCHAR, {TS_TEXT})) AS posture_id,
       sha256(concat_ws('|', 'image', event_id::VARCHAR, {TS_TEXT})) AS img_id,
       'image_' || sha256(concat_ws('|', 'file', event_id::VARCHAR, {TS_TEXT})) || '.jpg' AS img_filename
FROM fr""",

    "q_archive_names": f"""
SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d') AS ingest_date,
       'kafka_' || replace(replace({TS_TEXT}, ':', '-'), ' ', '_') || '.json' AS archive_name
FROM events""",

    "q_preview": _with(MSGS) + """
SELECT event_id, timestamp, image_data FROM msgs ORDER BY ts, event_id LIMIT 20""",

    "q_ingest_counts": """
SELECT strftime(ts + INTERVAL 9 HOUR, '%Y%m%d') AS ingest_date, count(*) AS n_messages
FROM events GROUP BY 1""",

    "q_calendar_parts": _with(FRAMES) + f"""
SELECT event_id, {CAL},
       isoyear(ts + INTERVAL 9 HOUR)::INTEGER AS iso_year,
       monthname(ts + INTERVAL 9 HOUR) AS month_value,
       strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day_value,
       strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS local_ts
FROM fr""",

    "q_c7": _with(FRAMES) + f"""
SELECT event_id, {C7[0]} AS c7_x, {C7[1]} AS c7_y, {C7[2]} AS c7_z FROM fr""",

    "q_angles": _with(FRAMES, ANALYZED) + """
SELECT event_id, cva_left, cva_right, fha_left, fha_right FROM an""",

    "q_posture": _with(FRAMES, ANALYZED) + """
SELECT event_id, user_id, posture_correct FROM an""",

    "q_result_feed": _with(FRAMES, ANALYZED) + """
SELECT event_id, '{"cva_left":' || coalesce(cva_left::VARCHAR, 'null')
  || ',"cva_right":' || coalesce(cva_right::VARCHAR, 'null')
  || ',"fha_left":' || coalesce(fha_left::VARCHAR, 'null')
  || ',"fha_right":' || coalesce(fha_right::VARCHAR, 'null')
  || ',"posture_correct":' || coalesce(posture_correct::VARCHAR, 'null') || '}' AS value
FROM an""",

    "q_status_label": _with(FRAMES, ANALYZED) + f"""
SELECT event_id, posture_correct, {LABEL} AS status_label FROM an""",

    "q_status_carry": _with(FRAMES, ANALYZED) + f"""
SELECT event_id, user_id,
       last_value({LABEL} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS status
FROM an""",

    "q_live_status": _with(FRAMES, ANALYZED) + f""",
lab AS (SELECT *, {LABEL} AS status_label FROM an),
lastlab AS (
  SELECT user_id, arg_max(status_label, (ts, event_id)) AS status
  FROM lab WHERE status_label IS NOT NULL GROUP BY user_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM lab)
SELECT r.user_id, r.ts, r.event_id, r.cva_left, r.cva_right, r.fha_left, r.fha_right,
       r.posture_correct, l.status
FROM ranked r LEFT JOIN lastlab l USING (user_id) WHERE r.rn = 1""",

    "q_image_dim": _with(MSGS) + f"""
SELECT sha256(concat_ws('|', 'image', event_id::VARCHAR, {TS_TEXT})) AS img_id,
       'image_' || sha256(concat_ws('|', 'file', event_id::VARCHAR, {TS_TEXT})) || '.jpg' AS img_filename,
       ts AS capture_time, octet_length(encode(props))::INTEGER AS file_size
FROM msgs""",

    "q_user_dim": _with(*BASE[:3]) + """
SELECT DISTINCT user_id, 'user_' || user_id AS user_name, NULL::INTEGER AS user_age,
       NULL::VARCHAR AS user_gender FROM facts""",

    "q_dim_year": _with(*BASE[:3]) + """
SELECT DISTINCT year_id, year_id AS year_value FROM facts""",

    "q_dim_month": _with(*BASE[:3]) + """
SELECT DISTINCT month_id, monthname(make_date(year_id, month_id, 1)) AS month_value, year_id FROM facts""",

    "q_dim_week": _with(*BASE[:3]) + """
SELECT DISTINCT week_id, week_id AS week_value, year_id FROM facts""",

    "q_dim_day": _with(*BASE[:3]) + """
SELECT DISTINCT day_id, strftime(make_date(year_id, month_id, day_id), '%Y-%m-%d') AS day_value,
       month_id, week_id, year_id FROM facts""",

    "q_dim_upsert": _with(*BASE[:3]) + """
SELECT DISTINCT day_id, strftime(make_date(year_id, month_id, day_id), '%Y-%m-%d') AS day_value,
       month_id, week_id, year_id,
       make_date(year_id, month_id, day_id) >= DATE '2024-01-15' AS inserted
FROM facts""",

    "q_star_join": _with(*BASE[:3]) + """
SELECT posture_id, f.user_id, 'user_' || f.user_id AS user_name, year_id AS year_value,
       monthname(make_date(year_id, month_id, 1)) AS month_value, week_id AS week_value,
       strftime(make_date(year_id, month_id, day_id), '%Y-%m-%d') AS day_value,
       octet_length(encode(e.props))::INTEGER AS file_size
FROM facts f JOIN events e ON f.posture_id = sha256(concat_ws('|', 'posture', e.event_id::VARCHAR,
     strftime(e.ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S.%f') || ' +0900'))""",

    "q_day_class_scan": _with(*BASE[:3]) + """
SELECT img_filename, posture_status FROM facts
WHERE year_id = 2024 AND month_id = 1 AND day_id = 2 AND posture_status IS NOT NULL""",

    "q_daily_stat": _with(*BASE) + """
SELECT * FROM mart""",

    "q_calendar_days": _with(*BASE) + """
SELECT DISTINCT year_id, month_id, day_id FROM mart WHERE year_id = 2024""",

    "q_calendar_map": _with(*BASE) + """
SELECT year_id, month_id, string_agg(day_id::VARCHAR, ',' ORDER BY day_id) AS days
FROM (SELECT DISTINCT year_id, month_id, day_id FROM mart WHERE year_id = 2024)
GROUP BY year_id, month_id""",

    "q_daily_report": _with(*BASE) + f""",
d AS (
  SELECT year_id, month_id, day_id, {COUNTS},
         max(CASE WHEN posture_correct THEN img_filename END) AS correct_img_filename,
         max(CASE WHEN NOT coalesce(posture_correct, false) THEN img_filename END) AS incorrect_img_filename
  FROM mart WHERE year_id = 2024 AND month_id = 1 AND day_id = 2
  GROUP BY year_id, month_id, day_id)
SELECT *, {SCORE} AS score FROM d""",

    "q_daily_score": _with(*BASE) + f""",
d AS (
  SELECT year_id, month_id, day_id, {COUNTS},
         max(CASE WHEN posture_correct THEN img_filename END) AS correct_img_filename,
         max(CASE WHEN NOT coalesce(posture_correct, false) THEN img_filename END) AS incorrect_img_filename
  FROM mart GROUP BY year_id, month_id, day_id)
SELECT *, {SCORE} AS score FROM d""",

    "q_weekly_score": _with(*BASE) + f""",
w AS (SELECT {COUNTS} FROM mart WHERE {WEEK_CAL})
SELECT *, {SCORE} AS score FROM w""",

    "q_weekly_score_literal": _with(*BASE) + f""",
w AS (SELECT {COUNTS} FROM mart WHERE {WEEK_LIT})
SELECT *, {SCORE} AS score FROM w""",

    "q_weekly_landmarks": _weekly_landmarks("calendar"),
    "q_weekly_landmarks_literal": _weekly_landmarks("literal"),

    "q_calendar_grid": _with(*BASE) + """,
days AS (SELECT DISTINCT year_id, month_id, day_id FROM mart),
months AS (SELECT year_id, month_id, count(*) AS days_with_data FROM days GROUP BY year_id, month_id),
g AS (
  SELECT year_id, month_id, days_with_data, unnest(generate_series(make_date(year_id, month_id, 1),
         last_day(make_date(year_id, month_id, 1)), INTERVAL 1 DAY))::DATE AS d
  FROM months)
SELECT g.year_id, g.month_id, day(d)::INTEGER AS day_id, g.days_with_data, dayofweek(d)::INTEGER AS weekday,
       ((day(d) + dayofweek(make_date(g.year_id, g.month_id, 1)) - 1) // 7)::INTEGER AS week_row,
       dayofweek(d) = 0 AS is_sunday, dayofweek(d) = 6 AS is_saturday,
       d = DATE '2024-01-31' AS is_today, days.day_id IS NOT NULL AS has_data
FROM g LEFT JOIN days ON days.year_id = g.year_id AND days.month_id = g.month_id AND days.day_id = day(d)""",

    "q_skeleton_segments": _with(*BASE) + """,
b AS (
  SELECT *, least(avg_left_shoulder_y, avg_right_shoulder_y, avg_left_ear_y, avg_right_ear_y, avg_c7_y) AS lo,
            greatest(avg_left_shoulder_y, avg_right_shoulder_y, avg_left_ear_y, avg_right_ear_y, avg_c7_y) AS hi
  FROM mart)
SELECT daily_stat_id, year_id, month_id, day_id, posture_correct, p.point, p.x, p.y, p.z,
       avg_c7_x AS c7_x, avg_c7_y AS c7_y, avg_c7_z AS c7_z,
       lo - (hi - lo) * 0.6 AS y_lo, hi + (hi - lo) * 0.6 AS y_hi
FROM b, (SELECT unnest([
   {'point': 'left_shoulder', 'x': avg_left_shoulder_x, 'y': avg_left_shoulder_y, 'z': avg_left_shoulder_z},
   {'point': 'right_shoulder', 'x': avg_right_shoulder_x, 'y': avg_right_shoulder_y, 'z': avg_right_shoulder_z},
   {'point': 'left_ear', 'x': avg_left_ear_x, 'y': avg_left_ear_y, 'z': avg_left_ear_z},
   {'point': 'right_ear', 'x': avg_right_ear_x, 'y': avg_right_ear_y, 'z': avg_right_ear_z}], recursive := true)) p""",

    "q_score_rollup": _with(*BASE) + f""",
r AS (
  SELECT year_id, month_id, day_id, {COUNTS}, grouping(year_id, month_id, day_id)::INTEGER AS level
  FROM mart GROUP BY ROLLUP (year_id, month_id, day_id))
SELECT *, {SCORE} AS score FROM r""",

    "q_capture_gaps": _with(FRAMES) + """,
g AS (
  SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day_value,
         epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
  FROM fr)
SELECT user_id, day_value, count(*) AS n_frames, count(gap) AS n_gaps,
       max(gap) / 1000000.0 AS max_gap_s,
       sum(gap)::DOUBLE / (count(gap)::DOUBLE * 1000000.0) AS mean_gap_s,
       count(CASE WHEN gap > 1200000 THEN 1 END) AS n_slow
FROM g GROUP BY user_id, day_value""",
}
