"""Listens, vocabularies, temporal splits and cohorts."""

from __future__ import annotations

from earshot.plans.catalog import frame, kept, query

#: Fixed values of the data model, scaled to tables of thirty days: days of the test and validation spans, least count
#: of a vocabulary item, least training events of a cohort user.
TEST_DAYS, VAL_DAYS, MIN_COUNT, MIN_TRAIN = 2, 4, 10, 10
DAY = 86400


@frame
def listens(d):
    return f"SELECT event_id, user_id AS usr, {d.seconds('ts')} AS ts, {d.json_int('props', 'k')} AS item, md5(CAST({d.json_int('props', 'k')} AS VARCHAR(20))) AS mbid, event_type AS signal FROM events"


@kept
def splits(d):
    return f"""SELECT *, CASE WHEN top - ts < {TEST_DAYS * DAY} THEN 2 WHEN top - ts < {VAL_DAYS * DAY} THEN 1 ELSE 0 END AS split
  FROM (SELECT *, max(ts) OVER (PARTITION BY usr) AS top FROM listens) AS dated"""


def numbered(rows: str, order: str, of: str, name: str = "rnk") -> str:
    """Rows with their place in an order (from 1), without a task that sorts them all.

    `of` (an integer column, the first in the order if descending) deals rows into ranges whose sizes are counted; a row's
    place is its place in its range plus the rows of the ranges before.
    """
    ranges = f"SELECT *, CAST(floor(log2({of} + 1e0) * 8e0) AS INT) AS range_no FROM ({rows}) AS r"
    before = f"SELECT range_no, sum(m) OVER (ORDER BY range_no DESC) - m AS m FROM (SELECT range_no, count(*) AS m FROM ({ranges}) AS a GROUP BY range_no) AS b"
    return f"SELECT x.*, row_number() OVER (PARTITION BY x.range_no ORDER BY {order}) + y.m AS {name} FROM ({ranges}) AS x JOIN ({before}) AS y ON x.range_no = y.range_no"


def vocabulary(where: str, id_name: str) -> str:
    counted = f"SELECT item, mbid, count(*) AS n FROM splits WHERE {where} GROUP BY item, mbid HAVING count(*) >= {MIN_COUNT}"
    return f"SELECT item, mbid, n, CAST(rnk - 1 AS INT) AS {id_name} FROM ({numbered(counted, 'n DESC, mbid', 'n')}) AS z"


@kept
def vocab_all(d):
    return vocabulary("1 = 1", "v1_item_id")


@kept
def vocab_train(d):
    return vocabulary("split = 0", "item_id")


@frame
def in_vocab(d):
    return "SELECT splits.* FROM splits JOIN vocab_train ON splits.mbid = vocab_train.mbid"


@kept
def cohort(d):
    return f"SELECT usr, sum(CASE WHEN split < 2 THEN 1 ELSE 0 END) AS n_history FROM in_vocab GROUP BY usr HAVING sum(CASE WHEN split = 0 THEN 1 ELSE 0 END) >= {MIN_TRAIN} AND sum(CASE WHEN split = 2 THEN 1 ELSE 0 END) >= 1"


@kept
def history(d):
    """Training and validation events of the cohort, numbered backwards in time."""
    return """SELECT e.usr, e.item, e.ts, e.event_id, max(e.ts) OVER (PARTITION BY e.usr) AS last_ts,
  row_number() OVER (PARTITION BY e.usr ORDER BY e.ts DESC, e.event_id DESC) AS back
  FROM in_vocab AS e JOIN cohort ON e.usr = cohort.usr WHERE e.split < 2"""


@kept
def train_history(d):
    return """SELECT e.usr, e.item, e.ts, e.event_id, max(e.ts) OVER (PARTITION BY e.usr) AS last_ts,
  row_number() OVER (PARTITION BY e.usr ORDER BY e.ts DESC, e.event_id DESC) AS back
  FROM in_vocab AS e JOIN cohort ON e.usr = cohort.usr WHERE e.split = 0"""


@kept
def truth(d):
    """Test items of the cohort; whether the user's history has them."""
    return """SELECT t.usr, t.item, CASE WHEN h.item IS NULL THEN 0 ELSE 1 END AS is_repeat
  FROM (SELECT DISTINCT e.usr, e.item FROM in_vocab AS e JOIN cohort ON e.usr = cohort.usr WHERE e.split = 2) AS t
  LEFT JOIN (SELECT DISTINCT usr, item FROM history) AS h ON t.usr = h.usr AND t.item = h.item"""


@frame
def truth_split(d):
    return """SELECT usr, item, 'overall' AS part FROM truth
  UNION ALL SELECT usr, item, CASE WHEN is_repeat = 1 THEN 'repeat' ELSE 'discovery' END AS part FROM truth
  UNION ALL SELECT usr, item, 'discovery_known' AS part FROM truth WHERE is_repeat = 0 AND EXISTS (SELECT 1 FROM vocab_all WHERE vocab_all.item = truth.item)
  UNION ALL SELECT usr, item, 'discovery_cold' AS part FROM truth WHERE is_repeat = 0 AND NOT EXISTS (SELECT 1 FROM vocab_all WHERE vocab_all.item = truth.item)"""


@query
def win_vocab_v1(d):
    return "SELECT item, mbid, n, v1_item_id FROM vocab_all"


@query
def win_vocab_v2(d):
    return "SELECT item, mbid, n, item_id FROM vocab_train"


@query
def join_v2_to_v1(d):
    return "SELECT t.item_id, a.v1_item_id, t.mbid FROM vocab_train AS t LEFT JOIN vocab_all AS a ON t.mbid = a.mbid"


@query
def win_assign_splits(d):
    return "SELECT event_id, usr, ts, item, split FROM splits"


@query
def join_events_to_v1(d):
    return "SELECT e.event_id, e.usr, a.v1_item_id, e.split FROM in_vocab AS e JOIN vocab_all AS a ON e.mbid = a.mbid"


@query
def agg_user_max_ts(d):
    return "SELECT usr, max(ts) AS max_ts FROM listens GROUP BY usr"


@query
def agg_train_item_counts(d):
    return "SELECT item, count(*) AS n FROM splits WHERE split = 0 GROUP BY item"


@query
def agg_cohort_item_counts(d):
    return "SELECT item, count(*) AS n FROM history GROUP BY item"


@query
def src_n_items(d):
    return "SELECT CAST(max(item_id) + 1 AS BIGINT) AS n_items FROM vocab_train"


@query
def agg_split_stats(d):
    return "SELECT split, count(*) AS n_events, count(DISTINCT usr) AS n_users, count(DISTINCT item) AS n_items FROM in_vocab GROUP BY split"


@query
def flt_oov_per_split(d):
    return "SELECT s.split, count(*) AS n_events, sum(CASE WHEN v.mbid IS NULL THEN 1 ELSE 0 END) AS n_oov FROM splits AS s LEFT JOIN vocab_train AS v ON s.mbid = v.mbid GROUP BY s.split"


@query
def win_order_check(d):
    return """SELECT sum(CASE WHEN ts < before THEN 1 ELSE 0 END) AS n_regressions, count(*) AS n_events
  FROM (SELECT ts, lag(ts) OVER (PARTITION BY usr ORDER BY event_id) AS before FROM listens) AS x"""


@query
def win_boundary_check(d):
    return """SELECT count(*) AS n_users, sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS train_after_val, sum(CASE WHEN b2 > c THEN 1 ELSE 0 END) AS val_after_test
  FROM (SELECT usr, max(CASE WHEN split = 0 THEN ts END) AS a, min(CASE WHEN split = 1 THEN ts END) AS b, max(CASE WHEN split = 1 THEN ts END) AS b2, min(CASE WHEN split = 2 THEN ts END) AS c FROM splits GROUP BY usr) AS x"""


@query
def agg_thin_users(d):
    return f"""SELECT sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS n_empty, sum(CASE WHEN n > 0 AND n < {MIN_TRAIN} THEN 1 ELSE 0 END) AS n_thin, count(*) AS n_users
  FROM (SELECT usr, sum(CASE WHEN split = 0 THEN 1 ELSE 0 END) AS n FROM splits GROUP BY usr) AS x"""


@query
def set_missing_users(d):
    return "SELECT usr FROM splits GROUP BY usr HAVING sum(CASE WHEN split = 0 THEN 1 ELSE 0 END) = 0"


@query
def srt_cohort(d):
    return "SELECT usr, n_history FROM cohort"


@query
def set_repeat_discovery(d):
    return "SELECT usr, item, is_repeat FROM truth"


@query
def set_known_cold(d):
    return "SELECT part, count(*) AS n, count(DISTINCT usr) AS n_users FROM truth_split GROUP BY part"


@query
def met_universe_coverage(d):
    return "SELECT round(avg(CASE WHEN v.mbid IS NULL THEN 0e0 ELSE 1e0 END), 6) AS coverage FROM (SELECT DISTINCT usr, item, mbid FROM splits WHERE split = 2) AS t LEFT JOIN vocab_train AS v ON t.mbid = v.mbid"
