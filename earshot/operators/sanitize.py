"""Raw listening lines: parsing, validation with the first reason of rejection, de-duplication and noise flags."""

from __future__ import annotations

from earshot.plans.catalog import frame, kept, query

#: The accepted span of timestamps, and the noise thresholds (scaled to the tables).
TS_LOW, TS_HIGH = 946684800, 1788220800 + 86400
FLOOD, REPEATS = 1, 1
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def uuid_text(x: str) -> str:
    return f"concat(substr({x}, 1, 8), '-', substr({x}, 9, 4), '-', substr({x}, 13, 4), '-', substr({x}, 17, 4), '-', substr({x}, 21, 12))"


@frame
def raw_lines(d):
    """Tab-separated lines made of listens, some of them broken by the remainder of their number."""
    rec = uuid_text("mbid")
    kind = d.mod("event_id", 23)
    return f"""SELECT usr, event_id AS line_no, CASE {kind}
    WHEN 3 THEN CAST(ts AS VARCHAR(20))
    WHEN 5 THEN concat('x', CAST(ts AS VARCHAR(20)), chr(9), '', chr(9), '', chr(9), {rec})
    WHEN 7 THEN concat('12', chr(9), '', chr(9), '', chr(9), {rec})
    WHEN 9 THEN concat(CAST(ts AS VARCHAR(20)), chr(9), '', chr(9), '', chr(9), 'not-an-id')
    WHEN 11 THEN concat(CAST(ts AS VARCHAR(20)), chr(9), '', chr(9), '', chr(9), '')
    WHEN 13 THEN concat(CAST(ts AS VARCHAR(20)), chr(9), {rec}, chr(9), 'bad-release', chr(9), {rec})
    ELSE concat(CAST(ts AS VARCHAR(20)), chr(9), {rec}, chr(9), {rec}, chr(9), {rec}) END AS line FROM listens
  UNION ALL SELECT usr, event_id + 1000000000 AS line_no, concat(CAST(ts AS VARCHAR(20)), chr(9), '', chr(9), '', chr(9), {rec}) AS line FROM listens WHERE {d.mod("event_id", 17)} = 0"""


@kept
def parsed(d):
    """Fields of the lines that aren't blank. Written once, as every check reads them."""
    parts = d.split("line", "\\t")
    return f"""SELECT usr, line_no, line, {d.size('p')} AS n_cols, trim({d.at('p', 0)}) AS ts_text, {d.try_int(f"trim({d.at('p', 0)})")} AS ts,
    coalesce({d.at('p', 1)}, '') AS artists, coalesce({d.at('p', 2)}, '') AS release_id, coalesce({d.at('p', 3)}, '') AS recording
  FROM (SELECT usr, line_no, line, {parts} AS p FROM raw_lines WHERE trim(line) <> '') AS x"""


@kept
def judged(d):
    return f"""SELECT *, CASE WHEN n_cols < 2 THEN 'bad_col_count'
    WHEN NOT {d.matches('ts_text', '^[+-]?[0-9]+$')} OR ts IS NULL THEN 'bad_ts'
    WHEN ts < {TS_LOW} OR ts > {TS_HIGH} THEN 'ts_out_of_range'
    WHEN recording <> '' AND NOT {d.matches('recording', UUID)} THEN 'malformed_recording'
    WHEN recording = '' THEN 'no_recording_mbid' END AS reason FROM parsed"""


@kept
def clean(d):
    """Accepted lines, the first of each (user, second, recording)."""
    return f"""SELECT usr, line_no, ts, recording, release_id FROM (
    SELECT usr, line_no, ts, recording, CASE WHEN {d.matches('release_id', UUID)} THEN release_id END AS release_id,
           row_number() OVER (PARTITION BY usr, ts, recording ORDER BY line_no) AS k FROM judged WHERE reason IS NULL) AS x WHERE k = 1"""


@frame
def noise(d):
    """Most distinct recordings of a user in an hour, and most listens of one in a day, among the clean rows."""
    return f"""SELECT f.usr, f.max_hour, r.max_day, f.max_hour > {FLOOD} AS is_flood, r.max_day > {REPEATS} AS is_repeat FROM
  (SELECT usr, max(n) AS max_hour FROM (SELECT usr, {d.idiv('ts', '3600')} AS h, count(DISTINCT recording) AS n FROM clean GROUP BY usr, {d.idiv('ts', '3600')}) AS x GROUP BY usr) AS f
  JOIN (SELECT usr, max(n) AS max_day FROM (SELECT usr, {d.idiv('ts', '86400')} AS h, recording, count(*) AS n FROM clean GROUP BY usr, {d.idiv('ts', '86400')}, recording) AS x GROUP BY usr) AS r ON f.usr = r.usr"""


@query
def src_parse_lines(d):
    return "SELECT usr, line_no, n_cols, ts_text, release_id, recording FROM parsed"


@query
def flt_reject_reason(d):
    return "SELECT usr, line_no, reason FROM judged"


@query
def flt_reject_summary(d):
    return "SELECT reason, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM judged), 4) AS pct FROM judged WHERE reason IS NOT NULL GROUP BY reason"


@query
def flt_reject_examples(d):
    return "SELECT reason, k, usr, line FROM (SELECT reason, usr, line, row_number() OVER (PARTITION BY reason ORDER BY usr, line_no) AS k FROM judged WHERE reason IS NOT NULL) AS x WHERE k <= 3"


@query
def flt_release_null_out(d):
    return f"SELECT count(*) AS n, sum(CASE WHEN release_id <> '' AND NOT {d.matches('release_id', UUID)} THEN 1 ELSE 0 END) AS n_malformed_release FROM judged WHERE reason IS NULL OR reason IN ('no_recording_mbid')"


@query
def set_dedup(d):
    return "SELECT usr, line_no, ts, recording, release_id FROM clean"


@query
def agg_coverage(d):
    return """SELECT round(100e0 * sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) / count(*), 4) AS pct_valid, count(DISTINCT usr) AS n_users,
  count(DISTINCT CASE WHEN reason IS NULL THEN usr END) AS n_retained FROM judged"""


@query
def agg_noise_flags(d):
    return "SELECT usr, max_hour, max_day, is_flood, is_repeat FROM noise"


@query
def agg_noise_top10(d):
    return "SELECT usr, max_hour FROM noise WHERE is_flood ORDER BY max_hour DESC, usr LIMIT 10"


def sensitivity(d, seconds: int, limits: tuple[int, ...]) -> str:
    parts = ", ".join(f"sum(CASE WHEN m > {t} THEN 1 ELSE 0 END) AS over_{t}" for t in limits)
    return f"SELECT {parts} FROM (SELECT usr, max(n) AS m FROM (SELECT usr, {d.idiv('ts', str(seconds))} AS b, recording, count(*) AS n FROM clean GROUP BY usr, {d.idiv('ts', str(seconds))}, recording) AS x GROUP BY usr) AS y"


@query
def agg_sensitivity_day(d):
    return sensitivity(d, 86400, (1, 2, 10, 25, 50, 100, 250))


@query
def agg_sensitivity_hour(d):
    return sensitivity(d, 3600, (1, 2, 100, 250, 500, 1000))


@query
def flt_uuid_bytes(d):
    """The sixteen bytes of each identifier, as hex digits; null for a malformed one."""
    return f"SELECT DISTINCT recording AS u, CASE WHEN {d.matches('recording', UUID)} THEN lower(hex(unhex(replace(recording, '-', '')))) END AS hex16 FROM parsed"


@query
def agg_ts_quality(d):
    """Timestamps by quality; one in milliseconds would be in range as seconds."""
    return f"""SELECT count(*) AS n_lines, sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS n_unparsable, sum(CASE WHEN ts < 0 THEN 1 ELSE 0 END) AS n_negative, sum(CASE WHEN ts < {TS_LOW} THEN 1 ELSE 0 END) AS n_early,
  sum(CASE WHEN ts > {TS_HIGH} THEN 1 ELSE 0 END) AS n_future, sum(CASE WHEN ts > {TS_HIGH} AND {d.idiv('ts', '1000')} BETWEEN {TS_LOW} AND {TS_HIGH} THEN 1 ELSE 0 END) AS n_milliseconds, min(ts) AS min_ts, max(ts) AS max_ts FROM parsed"""


@query
def flt_artist_lists(d):
    """Lines by their artist lists: absent, a list of ids, or malformed. A malformed list rejects no line."""
    one = UUID[1:-1]
    kind = f"CASE WHEN trim(artists) = '' THEN 'absent' WHEN {d.matches('trim(artists)', f'^{one}( *, *{one})*$')} THEN 'ids' ELSE 'malformed' END"
    return f"SELECT {kind} AS kind, count(*) AS n FROM judged WHERE n_cols >= 2 GROUP BY {kind}"


@query
def dst_expected(d):
    """What the clean rows are expected to be, and whether they are: exact counts, the vocabulary within a hundredth."""
    return """SELECT e.name, e.found, e.expected, CASE WHEN abs(e.found - e.expected) <= e.slack * e.expected THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
    SELECT 'rows' AS name, (SELECT count(*) FROM clean) AS found, (SELECT count(DISTINCT concat(CAST(usr AS VARCHAR(20)), ':', CAST(ts AS VARCHAR(20)), ':', recording)) FROM judged WHERE reason IS NULL) AS expected, 0e0 AS slack
    UNION ALL SELECT 'users' AS name, (SELECT count(DISTINCT usr) FROM clean) AS found, (SELECT count(DISTINCT usr) FROM listens) AS expected, 0e0 AS slack
    UNION ALL SELECT 'items' AS name, (SELECT count(DISTINCT recording) FROM clean) AS found, (SELECT count(DISTINCT mbid) FROM listens) AS expected, 0e0 AS slack
    UNION ALL SELECT 'mapped' AS name, (SELECT count(a.mbid) FROM vocab_train AS t LEFT JOIN vocab_all AS a ON a.mbid = t.mbid) AS found, (SELECT count(*) FROM vocab_train) AS expected, 0e0 AS slack
    UNION ALL SELECT 'vocabulary' AS name, (SELECT count(*) FROM vocab_train) AS found, (SELECT count(*) FROM vocab_all) AS expected, 0.01e0 AS slack) AS e"""


@query
def src_schema_discovery(d):
    kind = f"CASE WHEN v = '' THEN 'empty' WHEN {d.matches('v', UUID)} THEN 'uuid' WHEN {d.matches('v', '^[+-]?[0-9]+$')} THEN 'int' ELSE 'text' END"
    return f"SELECT col, {kind} AS kind, count(*) AS n, min({d.try_int('v')}) AS least, max({d.try_int('v')}) AS most FROM (SELECT 0 AS col, ts_text AS v FROM parsed UNION ALL SELECT 1 AS col, artists AS v FROM parsed UNION ALL SELECT 2 AS col, release_id AS v FROM parsed UNION ALL SELECT 3 AS col, recording AS v FROM parsed) AS x GROUP BY col, {kind}"
