"""DuckDB SQL with the same rows as the queries, written on its own: it shares no frame, constant or helper with them.

BASE holds common table expressions that the texts may read; DuckDB evaluates only those that a text names.
"""

from __future__ import annotations

BASE = """
ev AS MATERIALIZED (
  SELECT event_id, user_id AS u, floor(epoch(ts))::BIGINT AS t, (props->>'$.k')::INT AS i, md5(props->>'$.k') AS mb, event_type AS kind FROM events
), lastly AS (SELECT u, max(t) AS top FROM ev GROUP BY u
), sp AS MATERIALIZED (
  SELECT ev.*, (t > top - 2 * 86400)::INT + (t > top - 4 * 86400)::INT AS s FROM ev JOIN lastly USING (u)
), va AS MATERIALIZED (
  SELECT *, (rank() OVER (ORDER BY n DESC, mb) - 1)::INT AS id FROM (SELECT i, mb, count(*) AS n FROM sp GROUP BY ALL) WHERE n >= 10
), vt AS MATERIALIZED (
  SELECT *, (rank() OVER (ORDER BY n DESC, mb) - 1)::INT AS id FROM (SELECT i, mb, count(*) FILTER (s = 0) AS n FROM sp GROUP BY ALL) WHERE n >= 10
), ok AS MATERIALIZED (SELECT * FROM sp SEMI JOIN vt USING (mb)
), co AS MATERIALIZED (
  SELECT u, count(*) FILTER (s < 2) AS nh FROM ok GROUP BY u HAVING count(*) FILTER (s = 0) > 9 AND bool_or(s = 2)
), hi AS MATERIALIZED (
  SELECT *, (max(t) OVER (PARTITION BY u) - t) / 86400.0::DOUBLE AS age, row_number() OVER (PARTITION BY u ORDER BY t DESC, event_id DESC) AS back FROM ok SEMI JOIN co USING (u) WHERE s < 2
), th AS MATERIALIZED (
  SELECT *, (max(t) OVER (PARTITION BY u) - t) / 86400.0::DOUBLE AS age, row_number() OVER (PARTITION BY u ORDER BY t DESC, event_id DESC) AS back FROM ok SEMI JOIN co USING (u) WHERE s = 0
), own AS MATERIALIZED (SELECT u, i, count(*) AS n FROM hi GROUP BY ALL
), tr AS MATERIALIZED (
  SELECT DISTINCT ok.u, ok.i, own.n IS NOT NULL AS again FROM ok SEMI JOIN co USING (u) LEFT JOIN own ON own.u = ok.u AND own.i = ok.i WHERE s = 2
), tp AS MATERIALIZED (
  SELECT u, i, again, unnest(['overall', CASE WHEN again THEN 'repeat' ELSE 'discovery' END] || CASE WHEN again THEN [] WHEN va.i IS NULL THEN ['discovery_cold'] ELSE ['discovery_known'] END) AS part
  FROM (SELECT tr.u, tr.i, tr.again, va.i AS known FROM tr LEFT JOIN va ON va.i = tr.i) AS x LEFT JOIN va USING (i)
), nt AS MATERIALIZED (SELECT u, part, count(*) AS n FROM tp GROUP BY ALL
), ve AS MATERIALIZED (
  SELECT vec_id::INT AS i, vec_id, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8)) AS v FROM embeddings
), gram AS MATERIALIZED (
  SELECT a.i AS a, b.i AS b, list_dot_product(a.v, b.v) AS g FROM (SELECT * FROM ve SEMI JOIN vt USING (i)) AS a, (SELECT * FROM ve SEMI JOIN vt USING (i)) AS b
), by_events AS (
  SELECT u, i, unnest([
    {'s': 'user_frequency', 'x': count(*)::DOUBLE}, {'s': 'decay_30d', 'x': sum(pow(2, -age / 30))}, {'s': 'decay_90d', 'x': sum(pow(2, -age / 90))}, {'s': 'decay_365d', 'x': sum(pow(2, -age / 365))},
    {'s': 'decay_power1', 'x': sum(1 / (1 + age))}, {'s': 'decay_linear365', 'x': sum(greatest(0, 1 - age / 365))},
    {'s': 'decay_step_7d', 'x': count(*) FILTER (age <= 7)::DOUBLE}, {'s': 'decay_step_30d', 'x': count(*) FILTER (age <= 30)::DOUBLE},
    {'s': 'decay_step_90d', 'x': count(*) FILTER (age <= 90)::DOUBLE}, {'s': 'decay_step_365d', 'x': count(*) FILTER (age <= 365)::DOUBLE}], recursive := true) FROM hi GROUP BY u, i
), by_counts AS (
  SELECT u, i, 'popularity' AS s, n::DOUBLE AS x FROM co, (SELECT i, va.n FROM va SEMI JOIN vt USING (i))
  UNION ALL SELECT u, i, 'popularity_train', n::DOUBLE FROM co, (SELECT i, sum(n) AS n FROM own GROUP BY i)
  UNION ALL SELECT u, i, 'popularity_train_global', n::DOUBLE FROM co, vt
), ctx AS MATERIALIZED (
  SELECT 'item2vec' AS s, u, i, count(*)::DOUBLE AS w FROM hi WHERE back <= 50 GROUP BY ALL
  UNION ALL SELECT 'item2vec_w10', u, i, count(*) FROM hi WHERE back <= 10 GROUP BY ALL
  UNION ALL SELECT 'item2vec_w100', u, i, count(*) FROM hi WHERE back <= 100 GROUP BY ALL
  UNION ALL SELECT 'item2vec_unique', u, i, 1 FROM hi WHERE back <= 50 GROUP BY ALL
  UNION ALL SELECT 'item2vec_recency', u, i, sum(pow(2, -age / 90)) FROM hi WHERE back <= 50 GROUP BY ALL
  UNION ALL SELECT 'val', u, i, count(*) FROM th WHERE back <= 50 GROUP BY ALL
), ctx_norm AS (
  SELECT s, c.u, sqrt(sum(c.w * e.w * g)) / any_value(m.w) AS norm, any_value(m.w) AS total FROM ctx AS c JOIN ctx AS e USING (s, u) JOIN gram ON gram.a = c.i AND gram.b = e.i
  JOIN (SELECT s, u, sum(ctx.w) AS w FROM ctx SEMI JOIN ve USING (i) GROUP BY ALL) AS m USING (s, u) GROUP BY s, c.u
), by_vectors AS MATERIALIZED (
  SELECT c.u, g.b AS i, c.s, sum(c.w * g.g) / any_value(k.total) / (any_value(k.norm) + 1e-8) AS x FROM ctx AS c JOIN gram AS g ON g.a = c.i JOIN ctx_norm AS k ON k.s = c.s AND k.u = c.u GROUP BY c.u, g.b, c.s
), top_own AS (SELECT u, i FROM own QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, i) <= 100
), draws AS MATERIALIZED (
  SELECT u, unnest([0, 42, 43, 44]) AS seed FROM co
), cohorts AS MATERIALIZED (SELECT seed, u FROM draws WHERE seed = 0 OR md5(seed || ':' || u)[1] IN ('0', '1', '2', '3', '4', '5', '6', '7')
), heard AS (SELECT seed, i, sum(n) AS n FROM cohorts JOIN own USING (u) GROUP BY ALL
), near AS MATERIALIZED (
  SELECT seed, a, b, sim FROM (
    SELECT seed, a, b, round(together / sqrt(x.n::DOUBLE * y.n), 9) AS sim FROM (
      SELECT seed, p.i AS a, q.i AS b, count(*) AS together FROM cohorts JOIN top_own AS p USING (u) JOIN top_own AS q USING (u) WHERE p.i <> q.i GROUP BY ALL)
    JOIN heard AS x USING (seed) JOIN heard AS y USING (seed) WHERE x.i = a AND y.i = b)
  QUALIFY row_number() OVER (PARTITION BY seed, a ORDER BY sim DESC, b) <= 20
), by_neighbours AS MATERIALIZED (SELECT seed, u, b AS i, round(sum(n * sim), 9) AS x FROM cohorts JOIN own USING (u) JOIN near USING (seed) WHERE near.a = own.i GROUP BY ALL
), single AS (
  SELECT s, u, i, round(x, 9) + 0 AS x FROM (
    SELECT s, u, i, x FROM by_events UNION ALL SELECT s, u, i, x FROM by_counts UNION ALL SELECT s, u, i, x FROM by_vectors WHERE s <> 'val' UNION ALL SELECT 'item_knn', u, i, x FROM by_neighbours WHERE seed = 0)
), tops AS MATERIALIZED (
  SELECT s, u, i, x, r FROM (SELECT *, row_number() OVER (PARTITION BY s, u ORDER BY x DESC, i) - 1 AS r FROM single) WHERE r < 200
), vtruth AS MATERIALIZED (
  SELECT DISTINCT ok.u, ok.i, h.i IS NOT NULL AS again FROM ok SEMI JOIN co USING (u) LEFT JOIN (SELECT DISTINCT u, i FROM th) AS h ON h.u = ok.u AND h.i = ok.i WHERE s = 1
), vdecay AS MATERIALIZED (
  SELECT hl, u, i, row_number() OVER (PARTITION BY hl, u ORDER BY x DESC, i) - 1 AS r FROM (SELECT hl, u, i, round(sum(pow(2, -age / hl)), 9) AS x FROM th, (SELECT unnest([30, 90, 365]) AS hl) GROUP BY ALL) QUALIFY r < 100
), vhl AS MATERIALIZED (
  SELECT hl, round(avg(hits / n), 6) AS recall FROM (
    SELECT hl, u, n, count(d.i) AS hits FROM (SELECT unnest([30, 90, 365]) AS hl) JOIN (SELECT u, i, count(*) OVER (PARTITION BY u) AS n FROM vtruth WHERE again) AS v ON true LEFT JOIN vdecay AS d USING (hl, u, i) GROUP BY hl, u, n) GROUP BY hl
), bhl AS (SELECT arg_max(hl, recall - hl * 1e-12) AS hl FROM vhl
), ws AS (SELECT x / 10.0::DOUBLE AS w FROM range(11) AS t(x)
), vpair AS MATERIALIZED (
  SELECT u, i, min(a) AS a, min(b) AS b FROM (
    SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY round(x, 9) DESC, i) - 1 AS a, 200 AS b FROM by_vectors WHERE s = 'val' QUALIFY a < 200
    UNION ALL SELECT u, i, 200, r FROM vdecay WHERE hl = (SELECT hl FROM bhl)) GROUP BY u, i
), vw AS MATERIALIZED (
  SELECT w, round(avg(hits / n), 6) AS recall FROM (
    SELECT w, u, n, count(f.i) AS hits FROM ws JOIN (SELECT u, i, count(*) OVER (PARTITION BY u) AS n FROM vtruth) AS v ON true
    LEFT JOIN (SELECT w, u, i FROM vpair, ws QUALIFY row_number() OVER (PARTITION BY w, u ORDER BY round(w / (61 + a) + (1 - w) / (61 + b), 9) DESC, i) <= 100) AS f USING (w, u, i) GROUP BY w, u, n) GROUP BY w
), bw AS (SELECT arg_max(w, recall - w * 1e-12) AS w FROM vw
), ranks AS MATERIALIZED (
  SELECT u, i, min(a) AS a, min(b) AS b, min(c) AS c FROM (
    SELECT u, i, r AS a, 200 AS b, 200 AS c FROM tops WHERE s = 'item2vec' UNION ALL SELECT u, i, 200, r, 200 FROM tops WHERE s = 'decay_' || (SELECT hl FROM bhl) || 'd'
    UNION ALL SELECT u, i, 200, 200, r FROM tops WHERE s = 'decay_30d') GROUP BY u, i
), lists AS MATERIALIZED (
  SELECT * FROM tops UNION ALL
  SELECT s, u, i, x, row_number() OVER (PARTITION BY s, u ORDER BY x DESC, i) - 1 AS r FROM (
    SELECT 'rrf_fusion' AS s, u, i, round(w / (61 + a) + (1 - w) / (61 + b), 9) AS x FROM ranks, bw WHERE a < 200 OR b < 200
    UNION ALL SELECT 'weighted_rrf_07', u, i, round(0.7::DOUBLE / (61 + a) + (1 - 0.7::DOUBLE) / (61 + c), 9) FROM ranks WHERE a < 200 OR c < 200) QUALIFY r < 200
), names AS (SELECT DISTINCT s FROM lists
), um AS MATERIALIZED (
  SELECT s, u, part, n, coalesce(len(list_filter(rs, lambda r: r < 20)), 0) / n AS recall_20, coalesce(len(rs), 0) / n AS recall_100, coalesce(len(list_filter(rs, lambda r: r < 20)), 0) / 20 AS precision_20,
    coalesce(list_sum(list_transform(list_filter(rs, lambda r: r < 20), lambda r: 1 / log2(r + 2))), 0) / list_sum(list_transform(range(least(n, 20)), lambda r: 1 / log2(r + 2))) AS ndcg_20,
    CASE WHEN list_min(rs) < 10 THEN 1 / (list_min(rs) + 1) ELSE 0 END AS mrr_10, coalesce(list_min(rs) < 20, false)::INT::DOUBLE AS hitrate_20
  FROM names CROSS JOIN nt LEFT JOIN (SELECT l.s, l.u, part, list(r) AS rs FROM lists AS l JOIN tp ON tp.u = l.u AND tp.i = l.i WHERE r < 100 GROUP BY ALL) AS h USING (s, u, part)
), pop AS (SELECT i, row_number() OVER (ORDER BY n DESC, i) - 1 AS place, count(*) OVER () AS m FROM vt
), first AS (SELECT s, u, i, x, r, tr.i IS NOT NULL AS hit, coalesce(again, false) AS again FROM lists LEFT JOIN tr USING (u, i) WHERE r < 20
), calib AS (
  SELECT s, hit::INT AS hit, CASE WHEN max(x) OVER o - min(x) OVER o < 1e-12 THEN 0 ELSE round((x - min(x) OVER o) / (max(x) OVER o - min(x) OVER o), 9) END AS p FROM first WINDOW o AS (PARTITION BY s, u)
), calib_bins AS (SELECT s, least(9, floor(p * 10 + 1e-9))::INT AS bin, count(*) AS n, avg(p) AS mp, avg(hit) AS mh FROM calib GROUP BY ALL
), lines AS MATERIALIZED (
  SELECT u, event_id AS no, array_to_string(CASE event_id % 23 WHEN 3 THEN [t::VARCHAR] WHEN 5 THEN ['x' || t, '', '', id] WHEN 7 THEN ['12', '', '', id] WHEN 9 THEN [t::VARCHAR, '', '', 'not-an-id']
    WHEN 11 THEN [t::VARCHAR, '', '', ''] WHEN 13 THEN [t::VARCHAR, id, 'bad-release', id] ELSE [t::VARCHAR, id, id, id] END, chr(9)) AS line
  FROM (SELECT *, regexp_replace(mb, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS id FROM ev)
  UNION ALL SELECT u, event_id + 1000000000, array_to_string([t::VARCHAR, '', '', regexp_replace(mb, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')], chr(9)) FROM ev WHERE event_id % 17 = 0
), fields AS MATERIALIZED (
  SELECT u, no, line, len(f) AS n, trim(f[1]) AS tt, try_cast(trim(f[1]) AS BIGINT) AS t, coalesce(f[2], '') AS artists, coalesce(f[3], '') AS rel, coalesce(f[4], '') AS rec FROM (SELECT *, str_split(line, chr(9)) AS f FROM lines) WHERE trim(line) <> ''
), verdicts AS MATERIALIZED (
  SELECT *, coalesce(CASE WHEN n = 1 THEN 'bad_col_count' END, CASE WHEN NOT regexp_full_match(tt, '[-+]?\\d+') OR t IS NULL THEN 'bad_ts' END, CASE WHEN t NOT BETWEEN 946684800 AND 1788307200 THEN 'ts_out_of_range' END,
    CASE WHEN rec <> '' AND try_cast(rec AS UUID) IS NULL THEN 'malformed_recording' END, CASE WHEN rec = '' THEN 'no_recording_mbid' END) AS why FROM fields
), good AS MATERIALIZED (SELECT u, t, rec, min(no) AS no, arg_min(rel, no) AS rel FROM verdicts WHERE why IS NULL GROUP BY u, t, rec
), hours AS (SELECT u, max(n) AS h FROM (SELECT u, count(DISTINCT rec) AS n FROM good GROUP BY u, t // 3600) GROUP BY u
), days AS (SELECT u, max(n) AS d FROM (SELECT u, count(*) AS n FROM good GROUP BY u, rec, t // 86400) GROUP BY u
), users AS MATERIALIZED (SELECT u, count(*) AS n, count(DISTINCT i) AS k, min(t) AS a, max(t) AS z FROM ev GROUP BY u
), items AS (SELECT i, count(*) AS n FROM ev GROUP BY i
), prof AS MATERIALIZED (
  SELECT u, i, count(*) AS n, max(t) AS seen, round(sum(CASE kind WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 2.0 WHEN 'signup' THEN 1.5 WHEN 'click' THEN 0.3 WHEN 'error' THEN 0.0 END)::DOUBLE, 6) AS w FROM ev GROUP BY u, i
), rep AS MATERIALIZED (SELECT u, i, round(w * pow(2, -greatest(0, 1706745600 - seen) / (90 * 86400)), 9) AS x FROM prof
), clock AS MATERIALIZED (
  SELECT u, kind, b, round(coalesce(c.n, 0) / m, 9) AS p FROM (SELECT u, count(*) AS m FROM ev GROUP BY u)
  CROSS JOIN (SELECT 'hour' AS kind, x AS b FROM range(24) AS t(x) UNION ALL SELECT 'day', x FROM range(7) AS t(x))
  LEFT JOIN (SELECT u, 'hour' AS kind, hour(make_timestamp(t * 1000000)) AS b, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT u, 'day', isodow(make_timestamp(t * 1000000)) - 1, count(*) FROM ev GROUP BY ALL) AS c USING (u, kind, b)
), ctxw AS (
  SELECT u, round(0.9 + 0.2 * (0.7 * max(p) FILTER (kind = 'hour' AND b = hour(make_timestamp(1706745600000000))) + 0.3 * max(p) FILTER (kind = 'day' AND b = isodow(make_timestamp(1706745600000000)) - 1)), 9) AS w FROM clock GROUP BY u
), taste AS MATERIALIZED (
  SELECT u, pos, 0.7::DOUBLE * sum((x + 1e-6) * c) / sum(x + 1e-6) + 0.3::DOUBLE * avg(c) AS c FROM rep JOIN (SELECT i, unnest(v) AS c, unnest(range(len(v))) AS pos FROM ve) USING (i) GROUP BY u, pos
), unit AS MATERIALIZED (SELECT i, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS v FROM ve
), hybrid AS MATERIALIZED (
  SELECT u, i, played, plain, round(w * 0.7 * r + 0.3 * d, 9) + 0 AS now FROM (
    SELECT *, round(0.7 * r + 0.3 * d, 9) + 0 AS plain FROM (
      SELECT u, i, played, CASE WHEN max(x) OVER o - min(x) OVER o < 1e-12 THEN 0 ELSE (x - min(x) OVER o) / (max(x) OVER o - min(x) OVER o) END AS r,
        CASE WHEN max(y) OVER o - min(y) OVER o < 1e-12 THEN 0 ELSE (y - min(y) OVER o) / (max(y) OVER o - min(y) OVER o) END AS d
      FROM (SELECT q.u, unit.i, rep.x IS NOT NULL AS played, coalesce(rep.x, 0) AS x, list_dot_product(q.v, unit.v) / (sqrt(list_dot_product(q.v, q.v)) + 1e-12) AS y
        FROM (SELECT u, list(c ORDER BY pos) AS v FROM taste GROUP BY u) AS q CROSS JOIN unit LEFT JOIN rep ON rep.u = q.u AND rep.i = unit.i) WINDOW o AS (PARTITION BY u)) ) JOIN ctxw USING (u)
), exact AS MATERIALIZED (
  SELECT a.i AS q, b.i, round(list_dot_product(a.v, b.v), 9) + 0 AS x FROM ve AS a, ve AS b WHERE a.i % 100 = 0
), found AS (
  SELECT CASE event_id % 11 WHEN 1 THEN NULL WHEN 2 THEN 'unknown' ELSE mb END AS mb, u, t FROM ev
), seq AS MATERIALIZED (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY t, event_id) AS pos FROM th
), drawn_seq AS MATERIALIZED (
  SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY pos) AS pos FROM seq JOIN (SELECT i, n / sum(n) OVER () AS f FROM vt) USING (i)
  WHERE ('0x' || md5('keep:' || u || ':' || pos)[:8])::BIGINT / 4294967296 < least(1, sqrt(0.001 / f) + 0.001 / f)
)
"""


def _lloyd(iterations: int = 15, codes: int = 256, subspaces: int = 8, width: int = 8) -> str:
    """Lloyd's iterations as a chain of tables."""
    out = [
        f"""pv AS MATERIALIZED (SELECT i, s, list_slice(v, s * {width} + 1, s * {width} + {width}) AS v FROM ve, range({subspaces}) AS t(s)
), place AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY vec_id * 7919 % 1000003, vec_id) - 1 AS k0, count(*) OVER () AS n FROM ve
), c0 AS MATERIALIZED (SELECT s, k0 AS c, v FROM place JOIN pv USING (i) WHERE k0 < {codes}"""
    ]
    for k in range(iterations):
        near = f"SELECT i, s, arg_min(c, [d, c]) AS c FROM (SELECT pv.i, s, c, round(list_dot_product(pv.v, pv.v) - 2 * list_dot_product(pv.v, b.v) + list_dot_product(b.v, b.v), 12) AS d FROM pv JOIN c{k} AS b USING (s)) GROUP BY i, s"
        means = f"SELECT s, c, list(x ORDER BY pos) AS v FROM (SELECT s, c, pos, round(avg(x), 12) AS x FROM (SELECT s, c, unnest(v) AS x, unnest(range(len(v))) AS pos FROM ({near}) JOIN pv USING (i, s)) GROUP BY s, c, pos) GROUP BY s, c"
        out.append(
            f"""), m{k} AS MATERIALIZED ({means}
), c{k + 1} AS MATERIALIZED (SELECT s, c, coalesce(m.v, pv.v) AS v FROM (SELECT s, c FROM c{k}) LEFT JOIN m{k} AS m USING (s, c) JOIN place ON k0 = ({k} * (SELECT count(DISTINCT c) FROM c0) + c) % n JOIN pv USING (i, s)"""
        )
    out.append(
        f"""), cb AS (SELECT s, c, v FROM c{iterations}
), pqc AS MATERIALIZED (SELECT i, s, min([d, c]) AS b FROM (SELECT pv.i, s, c, round(list_dot_product(pv.v, pv.v) - 2 * list_dot_product(pv.v, b.v) + list_dot_product(b.v, b.v), 12) AS d, pv.v FROM pv JOIN cb AS b USING (s)) GROUP BY i, s
), dec AS MATERIALIZED (SELECT i, s, c, v FROM (SELECT i, s, b[2]::INT AS c FROM pqc) JOIN cb USING (s, c)
), whole AS MATERIALIZED (SELECT i, flatten(list(v ORDER BY s)) AS v FROM dec GROUP BY i
), adc AS MATERIALIZED (SELECT q.i AS q, w.i, round(list_dot_product(q.v, w.v), 9) + 0 AS x, round(list_dot_product(q.v, w.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(w.v, w.v)) + 1e-12), 9) + 0 AS cosine FROM ve AS q, whole AS w WHERE q.i % 100 = 0
), ptaste AS (
  SELECT u, list(c ORDER BY pos) AS v FROM (SELECT u, pos, 0.7::DOUBLE * sum((x + 1e-6) * c) / sum(x + 1e-6) + 0.3::DOUBLE * avg(c) AS c FROM rep JOIN (SELECT i, unnest(v) AS c, unnest(range(len(v))) AS pos FROM whole) USING (i) GROUP BY u, pos) GROUP BY u
), phybrid AS (
  SELECT u, i, CASE WHEN played THEN -1 ELSE round(0.7 * CASE WHEN xh - xl < 1e-12 THEN 0 ELSE (x - xl) / (xh - xl) END + 0.3 * CASE WHEN yh - yl < 1e-12 THEN 0 ELSE (y - yl) / (yh - yl) END, 9) + 0 END AS score FROM (
    SELECT *, max(x) OVER o AS xh, min(x) OVER o AS xl, max(y) OVER o AS yh, min(y) OVER o AS yl FROM (
      SELECT q.u, w.i, rep.x IS NOT NULL AS played, coalesce(rep.x, 0) AS x, list_dot_product(q.v, w.v) / (sqrt(list_dot_product(q.v, q.v)) + 1e-12) / (sqrt(list_dot_product(w.v, w.v)) + 1e-12) AS y
      FROM ptaste AS q CROSS JOIN whole AS w LEFT JOIN rep ON rep.u = q.u AND rep.i = w.i) WINDOW o AS (PARTITION BY u)))"""
    )
    return "\n".join(out)


QUANTIZED = _lloyd()


def _text(body: str) -> str:
    return f"WITH {BASE.strip()}\n{body}"


def _quantized(body: str) -> str:
    return f"WITH {BASE.strip()}, {QUANTIZED}\n{body}"


METRICS = ("recall_20", "recall_100", "precision_20", "ndcg_20", "mrr_10", "hitrate_20")
UUID = "try_cast({0} AS UUID) IS NOT NULL AND length({0}) = 36"
_nearest = "(least(m - 1, floor(m * {}::DOUBLE))::BIGINT + 1)"
_pairs = {"decay_90d_vs_user_frequency": ("decay_90d", "user_frequency"), "decay_90d_vs_popularity_train_global": ("decay_90d", "popularity_train_global"), "item2vec_w10_vs_popularity_train_global": ("item2vec_w10", "popularity_train_global"), "rrf_fusion_vs_decay_90d": ("rrf_fusion", "decay_90d")}
_diffs = " UNION ALL ".join(f"SELECT '{n}' AS pair, a.part, a.u, a.recall_100 - b.recall_100 AS d FROM um AS a JOIN um AS b USING (u, part) WHERE a.s = '{x}' AND b.s = '{y}' AND part IN ('overall', 'repeat', 'discovery')" for n, (x, y) in _pairs.items())

#: The texts by query.
ORACLES: dict[str, str] = {
    # sources and checks of lines
    "src_parse_lines": _text("SELECT u AS usr, no AS line_no, n AS n_cols, tt AS ts_text, rel AS release_id, rec AS recording FROM fields"),
    "flt_reject_reason": _text("SELECT u AS usr, no AS line_no, why AS reason FROM verdicts"),
    "flt_reject_summary": _text("SELECT why AS reason, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM fields), 4) AS pct FROM verdicts GROUP BY why HAVING why IS NOT NULL"),
    "flt_reject_examples": _text("SELECT why AS reason, row_number() OVER o AS k, u AS usr, line FROM verdicts WHERE why IS NOT NULL WINDOW o AS (PARTITION BY why ORDER BY u, no) QUALIFY k < 4"),
    "flt_release_null_out": _text(f"SELECT count(*) AS n, count(*) FILTER (rel <> '' AND NOT ({UUID.format('rel')}))::BIGINT AS n_malformed_release FROM verdicts WHERE coalesce(why, 'no_recording_mbid') = 'no_recording_mbid'"),
    "flt_artist_lists": _text(f"SELECT CASE WHEN trim(artists) = '' THEN 'absent' WHEN len(list_filter(str_split(trim(artists), ','), lambda a: NOT ({UUID.format('trim(a)')}))) = 0 THEN 'ids' ELSE 'malformed' END AS kind, count(*) AS n FROM fields WHERE n > 1 GROUP BY ALL"),
    "flt_uuid_bytes": _text(f"SELECT DISTINCT rec AS u, CASE WHEN {UUID.format('rec')} THEN lower(replace(rec::VARCHAR, '-', '')) END AS hex16 FROM fields"),
    "set_dedup": _text(f"SELECT u AS usr, no AS line_no, t AS ts, rec AS recording, CASE WHEN {UUID.format('rel')} THEN rel END AS release_id FROM good"),
    "agg_coverage": _text("SELECT round(100 * avg((why IS NULL)::INT), 4) AS pct_valid, count(DISTINCT u) AS n_users, count(DISTINCT u) FILTER (why IS NULL) AS n_retained FROM verdicts"),
    "agg_noise_flags": _text("SELECT u AS usr, h AS max_hour, d AS max_day, h >= 2 AS is_flood, d >= 2 AS is_repeat FROM hours JOIN days USING (u)"),
    "agg_noise_top10": _text("SELECT u AS usr, h AS max_hour FROM hours WHERE h >= 2 ORDER BY h DESC, u LIMIT 10"),
    "agg_sensitivity_day": _text("SELECT " + ", ".join(f"count(*) FILTER (d > {k}) AS over_{k}" for k in (1, 2, 10, 25, 50, 100, 250)) + " FROM days"),
    "agg_sensitivity_hour": _text("SELECT " + ", ".join(f"count(*) FILTER (m > {k}) AS over_{k}" for k in (1, 2, 100, 250, 500, 1000)) + " FROM (SELECT u, max(n) AS m FROM (SELECT u, count(*) AS n FROM good GROUP BY u, rec, t // 3600) GROUP BY u)"),
    "agg_ts_quality": _text("SELECT count(*) AS n_lines, count(*) - count(t) AS n_unparsable, count(*) FILTER (t < 0) AS n_negative, count(*) FILTER (t < 946684800) AS n_early, count(*) FILTER (t > 1788307200) AS n_future, count(*) FILTER (t > 1788307200 AND t // 1000 BETWEEN 946684800 AND 1788307200) AS n_milliseconds, min(t) AS min_ts, max(t) AS max_ts FROM fields"),
    "src_schema_discovery": _text(f"SELECT col, CASE WHEN v = '' THEN 'empty' WHEN {UUID.format('v')} THEN 'uuid' WHEN regexp_full_match(v, '[-+]?[0-9]+') THEN 'int' ELSE 'text' END AS kind, count(*) AS n, min(try_cast(v AS BIGINT)) AS least, max(try_cast(v AS BIGINT)) AS most FROM (UNPIVOT (SELECT tt AS \"0\", artists AS \"1\", rel AS \"2\", rec AS \"3\" FROM fields) ON COLUMNS(*) INTO NAME c VALUE v) AS x, (SELECT 1) AS y, LATERAL (SELECT c::INT AS col) AS z GROUP BY ALL"),
    "dst_expected": _text("SELECT name, found, expected, CASE WHEN found BETWEEN expected * (1 - slack) AND expected * (1 + slack) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT unnest([{'name': 'rows', 'found': (SELECT count(*) FROM good), 'expected': (SELECT count(DISTINCT (u, t, rec)) FROM verdicts WHERE why IS NULL), 'slack': 0.0}, {'name': 'users', 'found': (SELECT count(DISTINCT u) FROM good), 'expected': (SELECT count(*) FROM users), 'slack': 0.0}, {'name': 'items', 'found': (SELECT count(DISTINCT rec) FROM good), 'expected': (SELECT count(*) FROM items), 'slack': 0.0}, {'name': 'mapped', 'found': (SELECT count(*) FROM vt SEMI JOIN va USING (mb)), 'expected': (SELECT count(*) FROM vt), 'slack': 0.0}, {'name': 'vocabulary', 'found': (SELECT count(*) FROM vt), 'expected': (SELECT count(*) FROM va), 'slack': 0.01}], recursive := true))"),
    # vocabularies, splits, cohorts
    "win_vocab_v1": _text("SELECT i AS item, mb AS mbid, n, id AS v1_item_id FROM va"),
    "win_vocab_v2": _text("SELECT i AS item, mb AS mbid, n, id AS item_id FROM vt"),
    "join_v2_to_v1": _text("SELECT vt.id AS item_id, va.id AS v1_item_id, mb AS mbid FROM vt LEFT JOIN va USING (mb)"),
    "win_assign_splits": _text("SELECT event_id, u AS usr, t AS ts, i AS item, s AS split FROM sp"),
    "join_events_to_v1": _text("SELECT event_id, u AS usr, va.id AS v1_item_id, s AS split FROM ok JOIN va USING (mb)"),
    "agg_user_max_ts": _text("SELECT u AS usr, top AS max_ts FROM lastly"),
    "agg_train_item_counts": _text("SELECT i AS item, count(*) AS n FROM sp WHERE s = 0 GROUP BY i"),
    "agg_cohort_item_counts": _text("SELECT i AS item, sum(n)::BIGINT AS n FROM own GROUP BY i"),
    "src_n_items": _text("SELECT count(*) AS n_items FROM vt"),
    "agg_split_stats": _text("SELECT s AS split, count(*) AS n_events, count(DISTINCT u) AS n_users, count(DISTINCT mb) AS n_items FROM ok GROUP BY s"),
    "flt_oov_per_split": _text("SELECT s AS split, count(*) AS n_events, count(*) FILTER (mb NOT IN (SELECT mb FROM vt)) AS n_oov FROM sp GROUP BY s"),
    "win_order_check": _text("SELECT count(*) FILTER (t < p)::BIGINT AS n_regressions, count(*) AS n_events FROM (SELECT t, lag(t) OVER (PARTITION BY u ORDER BY event_id) AS p FROM ev)"),
    "win_boundary_check": _text("SELECT count(*) AS n_users, count(*) FILTER (a > b) AS train_after_val, count(*) FILTER (c > d) AS val_after_test FROM (SELECT max(t) FILTER (s = 0) AS a, min(t) FILTER (s = 1) AS b, max(t) FILTER (s = 1) AS c, min(t) FILTER (s = 2) AS d FROM sp GROUP BY u)"),
    "agg_thin_users": _text("SELECT count(*) FILTER (n = 0) AS n_empty, count(*) FILTER (n BETWEEN 1 AND 9) AS n_thin, count(*) AS n_users FROM (SELECT count(*) FILTER (s = 0) AS n FROM sp GROUP BY u)"),
    "set_missing_users": _text("SELECT u AS usr FROM users EXCEPT SELECT u FROM sp WHERE s = 0"),
    "srt_cohort": _text("SELECT u AS usr, nh AS n_history FROM co"),
    "set_repeat_discovery": _text("SELECT u AS usr, i AS item, again::INT AS is_repeat FROM tr"),
    "set_known_cold": _text("SELECT part, count(*) AS n, count(DISTINCT u) AS n_users FROM tp GROUP BY part"),
    "met_universe_coverage": _text("SELECT round(avg((mb IN (SELECT mb FROM vt))::INT), 6) AS coverage FROM (SELECT DISTINCT u, mb FROM sp WHERE s = 2)"),
    # distributions
    "agg_user_span": _text("SELECT u AS usr, n, a AS first_ts, z AS last_ts FROM users"),
    "agg_item_counts": _text("SELECT i AS item, n FROM items"),
    "dst_user_stats": _text(f"SELECT round(sum(n) / count(*), 1) AS mean_n, list_sort(list(n))[{_nearest.format(0.5).replace('m', 'count(*)')}] AS median_n, list_sort(list(n))[{_nearest.format(0.9).replace('m', 'count(*)')}] AS p90_n, min(n) AS min_n, max(n) AS max_n FROM users"),
    "dst_percentiles": _text("SELECT round(quantile_cont(n, 0.5), 6) AS median_n, round(quantile_cont(n, 0.9), 6) AS p90_n FROM users"),
    "dst_density": _text("SELECT round((SELECT count(*) FROM ev) / ((SELECT count(*) FROM users) * (SELECT count(*) FROM items)), 8) AS density"),
    "dst_top_share": _text("SELECT " + ", ".join(f"round(list_sum(list_reverse_sort(list(n))[:greatest(1, floor(count(*) * {p}::DOUBLE))::BIGINT]) / sum(n), 8) AS top_{k}" for p, k in ((0.01, 1), (0.1, 10))) + " FROM users"),
    "dst_gini_rank": _text("SELECT round(sum(abs(a.n - b.n)) / (2 * count(*) * avg(a.n)), 9) AS gini FROM users AS a, users AS b"),
    "dst_gini_lorenz": _text("SELECT round(sum(abs(a.n - b.n)) / (2 * count(*) * avg(a.n)), 9) AS gini FROM users AS a, users AS b"),
    "dst_lorenz_curve": _text("SELECT x::INT AS i, round(list_sum(l[:least(floor(x * len(l) / 50), len(l) - 1)::BIGINT + 1]) / list_sum(l), 8) AS share FROM (SELECT list_sort(list(n)) AS l FROM users), range(51) AS t(x)"),
    "dst_item_thresholds": _text("SELECT " + ", ".join(f"count(*) FILTER (n >= {k}) AS at_least_{k}" for k in (2, 5, 10, 50, 100)) + " FROM items"),
    "dst_long_tail": _text("SELECT row_number() OVER (ORDER BY n DESC, i) AS rnk, n FROM items"),
    "dst_sampled_repeat": _text(f"SELECT round(avg(k), 6) AS mean_distinct, round(avg(n / k), 6) AS mean_ratio, max(n - k) AS max_repeats, list_sort(list(n - k))[{_nearest.format(0.5).replace('m', 'count(*)')}] AS median_repeats, list_sort(list(n - k))[{_nearest.format(0.9).replace('m', 'count(*)')}] AS p90_repeats FROM (SELECT * FROM users ORDER BY u LIMIT 1000)"),
    "dst_tolerance_compare": _text("SELECT name, CASE WHEN name = 'n_users' THEN if(a = b, 'PASS', 'FAIL') WHEN abs(a - b) <= abs(a) / 1000 THEN 'PASS' WHEN abs(a - b) <= abs(a) / 100 THEN 'SOFT-PASS' ELSE 'FAIL' END AS verdict FROM (SELECT 'gini' AS name, (SELECT sum(abs(a.n - b.n)) / (2 * count(*) * avg(a.n)) FROM users AS a, users AS b) AS a, (SELECT list_sum(list_transform(l, lambda n, k: n * (2 * k - len(l) - 1))) / (len(l) * list_sum(l)) FROM (SELECT list_sort(list(n)) AS l FROM users)) AS b UNION ALL SELECT 'n_users', (SELECT count(*) FROM users), (SELECT count(DISTINCT u) FROM ev))"),
    "tmp_year_counts": _text("SELECT year(make_timestamp(t * 1000000)) AS year, count(*) AS n FROM ev GROUP BY ALL"),
    "tmp_hour_buckets": _text("SELECT t // 3600 AS hour_bucket, count(*) AS n FROM ev GROUP BY ALL"),
    "agg_census": _text("SELECT u % 7 AS shard, CASE WHEN u % 7 IN (0, 1, 2) THEN 'full' ELSE 'partial' END AS tier, count(DISTINCT u) AS n_users, count(*) AS n_rows, count(*) FILTER (rec = '')::BIGINT AS n_empty, min(t) AS min_ts, max(t) AS max_ts, round(100 * (1 - count(*) FILTER (rec = '') / count(*)), 4) AS coverage FROM fields GROUP BY ALL"),
    "agg_census_rollup": _text("""SELECT tier, shard, count(DISTINCT u)::BIGINT AS n_users, count(*)::BIGINT AS n_rows, min(t) AS min_ts, max(t) AS max_ts, count(DISTINCT s7) AS n_shards FROM (SELECT *, u % 7 AS s7, u % 7 AS shard, CASE WHEN u % 7 < 3 THEN 'full' ELSE 'partial' END AS tier FROM fields) GROUP BY GROUPING SETS ((tier, shard), (tier), ())"""),
    "src_shard_selection": _text("SELECT u % 7 AS shard, count(*) AS n_rows FROM fields WHERE u % 7 > 2 GROUP BY ALL ORDER BY n_rows, shard LIMIT 1"),
    # lists
    **{f"scr_{s}": _text(f"SELECT u AS usr, i AS item, x AS score, r AS rank0 FROM lists WHERE s = '{s}' AND r < 20") for s in (
        "user_frequency", "decay_30d", "decay_90d", "decay_365d", "decay_power1", "decay_linear365", "decay_step_7d", "decay_step_30d", "decay_step_90d", "decay_step_365d", "popularity", "popularity_train",
        "popularity_train_global", "item2vec", "item2vec_w10", "item2vec_w100", "item2vec_unique", "item2vec_recency", "item_knn", "rrf_fusion", "weighted_rrf_07")},
    "scr_knn_graph": _text("SELECT a, b, sim FROM near WHERE seed = 0"),
    "scr_keep_probs": _text("SELECT i AS item, round(least(1, sqrt(0.001 / f) + 0.001 / f), 9) AS keep FROM (SELECT i, n / sum(n) OVER () AS f FROM vt)"),
    "win_frequency_then_popularity": _text("SELECT u AS usr, i AS item, row_number() OVER (PARTITION BY u ORDER BY own.n IS NULL, coalesce(own.n, vt.n) DESC, i) AS rnk FROM co CROSS JOIN vt LEFT JOIN own USING (u, i) QUALIFY rnk <= 20"),
    # evaluation
    "met_ranking": _text("SELECT s AS scorer, part, count(*) AS n_users, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM um GROUP BY ALL"),
    "met_per_user": _text("SELECT s AS scorer, u AS usr, part, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM um"),
    "met_flat": _text(f"SELECT scorer, part || '.' || name AS metric, value FROM (UNPIVOT (SELECT s AS scorer, part, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM um GROUP BY ALL) ON {', '.join(METRICS)} INTO NAME name VALUE value)"),
    "met_percentiles": _text("SELECT s AS scorer, " + ", ".join(f"round(quantile_cont(recall_100, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM um WHERE part = 'overall' GROUP BY s"),
    "met_segments": _text("SELECT s AS scorer, CASE WHEN nh >= 70 THEN 'heavy' WHEN nh >= 50 THEN 'medium' ELSE 'light' END AS activity, count(*) AS n_users, round(avg(recall_100), 6) AS recall_100 FROM um JOIN co USING (u) WHERE part = 'overall' GROUP BY ALL"),
    "win_popularity_places": _text("SELECT i AS item, place FROM pop"),
    "met_novelty": _text("SELECT s AS scorer, round(avg(x), 6) AS novelty FROM (SELECT s, avg(place / m) AS x FROM first JOIN pop USING (i) GROUP BY s, u) GROUP BY s"),
    "met_diversity": _text("SELECT s AS scorer, round(avg(x), 6) AS mean_cosine FROM (SELECT p.s, avg(g) AS x FROM first AS p JOIN first AS q USING (s, u) JOIN gram ON a = p.i AND b = q.i WHERE p.i <> q.i GROUP BY p.s, p.u) GROUP BY s"),
    "met_calibration": _text("SELECT s AS scorer, bin, n, round(mp, 6) AS mean_p, round(mh, 6) AS mean_hit FROM calib_bins"),
    "met_ece": _text("SELECT s AS scorer, round(sum(n * abs(mp - mh)) / sum(n), 6) AS ece FROM calib_bins GROUP BY s"),
    "met_tail": _text("SELECT s AS scorer, CASE WHEN 100 * place < m THEN 'head' WHEN 10 * place < m THEN 'mid' ELSE 'tail' END AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY s), 6) AS share, round(avg(hit::INT), 6) AS hit_share FROM first JOIN pop USING (i) GROUP BY s, bucket"),
    "met_coverage": _text("SELECT s AS scorer, round(count(DISTINCT i) / (SELECT count(*) FROM vt), 6) AS coverage FROM first GROUP BY s"),
    "met_saturation": _text("SELECT k, round(avg(coalesce(n, 0) / least(k, 200)), 6) AS seen_share FROM (SELECT k, u, count(l.i) FILTER (r < k) AS n FROM co CROSS JOIN (SELECT unnest([10, 20, 50, 100, 200, 500]) AS k) LEFT JOIN (SELECT lists.* FROM lists SEMI JOIN own USING (u, i) WHERE s = 'decay_' || (SELECT hl FROM bhl) || 'd') AS l USING (u) GROUP BY k, u) GROUP BY k"),
    "met_repeat_share": _text("SELECT s AS scorer, round(avg(x), 6) AS repeat_share FROM (SELECT s, avg(again::INT) AS x FROM first GROUP BY s, u) GROUP BY s"),
    "met_fusion_sweep": _text("""SELECT w, round(sum(coalesce(a20, 0)) / count(*), 6) AS recall_20, round(sum(coalesce(a100, 0)) / count(*), 6) AS recall_100, round(sum(coalesce(d100, 0)) / count(*), 6) AS discovery_recall_100 FROM ws CROSS JOIN co LEFT JOIN (
      SELECT w, f.u, count(*) FILTER (r < 20) / any_value(n) AS a20, count(*) / any_value(n) AS a100, count(*) FILTER (NOT again) / nullif(any_value(nd), 0) AS d100
      FROM (SELECT w, u, i, row_number() OVER (PARTITION BY w, u ORDER BY round(w / (61 + a) + (1 - w) / (61 + b), 9) DESC, i) - 1 AS r FROM ranks, ws WHERE a < 200 OR b < 200) AS f
      JOIN (SELECT *, count(*) OVER (PARTITION BY u) AS n, count(*) FILTER (NOT again) OVER (PARTITION BY u) AS nd FROM tr) AS t ON t.u = f.u AND t.i = f.i WHERE r < 100 GROUP BY w, f.u) USING (w, u) GROUP BY w"""),
    "met_val_selection": _text("SELECT 'half_life' AS stage, hl::DOUBLE AS candidate, recall AS recall_100, hl = (SELECT hl FROM bhl) AS chosen FROM vhl UNION ALL SELECT 'weight', w, recall, w = (SELECT w FROM bw) FROM vw"),
    "met_bootstrap": _text(f"""SELECT pair, part, round(avg(d), 6) AS mean_diff, round(any_value(lo), 6) AS low, round(any_value(hi), 6) AS high, round(any_value(p), 4) AS p_positive FROM ({_diffs}) JOIN (
      SELECT pair, part, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, avg((x > 0)::INT) AS p FROM (
        SELECT pair, part, b, avg(l[((b * 7919 + j * 104729 + (j + 1) * (b + 1)) % 1000003) % len(l) + 1]) AS x FROM (
          SELECT pair, part, l, unnest(range(len(l))) AS j FROM (SELECT pair, part, list(d ORDER BY u) AS l FROM ({_diffs}) GROUP BY ALL)), range(1000) AS t(b) GROUP BY pair, part, b) GROUP BY ALL) USING (pair, part) GROUP BY pair, part"""),
    "met_leakage_delta": _text("SELECT p AS all_events, t AS train_only, round(t - p, 6) AS delta FROM (SELECT round(avg(recall_100) FILTER (s = 'popularity'), 6) AS p, round(avg(recall_100) FILTER (s = 'popularity_train'), 6) AS t FROM um WHERE part = 'overall')"),
    "met_multiseed": _text("""SELECT s AS scorer, count(*) AS n_seeds, round(avg(x), 6) AS mean_recall, round(coalesce(stddev_samp(x), 0), 6) AS sd_recall FROM (
      SELECT s, seed, avg(recall) AS x FROM (
        SELECT s, seed, recall_100 AS recall FROM um JOIN cohorts USING (u) WHERE part = 'overall' AND s NOT IN ('item_knn', 'popularity_train')
        UNION ALL SELECT s.s, c.seed, count(f.i) / n FROM cohorts AS c CROSS JOIN (SELECT unnest(['item_knn', 'popularity_train']) AS s) AS s JOIN (SELECT u, i, count(*) OVER (PARTITION BY u) AS n FROM tr) AS t USING (u)
          LEFT JOIN (SELECT 'item_knn' AS s, seed, u, i FROM by_neighbours QUALIFY row_number() OVER (PARTITION BY seed, u ORDER BY x DESC, i) <= 100
            UNION ALL SELECT 'popularity_train', seed, u, i FROM cohorts JOIN (SELECT * FROM heard QUALIFY row_number() OVER (PARTITION BY seed ORDER BY n DESC, i) <= 100) USING (seed)) AS f ON f.s = s.s AND f.seed = c.seed AND f.u = t.u AND f.i = t.i GROUP BY s.s, c.seed, t.u, n) WHERE seed > 0 GROUP BY s, seed) GROUP BY s"""),
    "met_global_split": _text("SELECT count(*) AS n_truth, count(DISTINCT u) AS n_users, round(avg((l.i IS NOT NULL)::INT), 6) AS recall_20 FROM (SELECT DISTINCT u, i FROM ok SEMI JOIN co USING (u) WHERE t > (SELECT max(t) FROM hi) - 2 * 86400) LEFT JOIN (SELECT u, i FROM first WHERE s = 'decay_30d') AS l USING (u, i)"),
    "set_jaccard": _text("SELECT u AS usr, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS jaccard FROM (SELECT u, list(i) FILTER (s = 'decay_30d') AS a, list(i) FILTER (s = 'item2vec') AS b FROM first GROUP BY u)"),
    # serving
    "srv_profile_state": _text("SELECT u AS usr, i AS item, n, seen AS last_seen, w AS wscore FROM prof"),
    "srv_decay_scores": _text("SELECT u AS usr, i AS item, x AS score FROM rep"),
    "srv_repeat_only": _text("SELECT u AS usr, i AS item, x AS score FROM rep QUALIFY row_number() OVER (PARTITION BY u ORDER BY x DESC, i) <= 20"),
    "srv_rhythm": _text("SELECT u AS usr, kind, b AS bucket, p FROM clock"),
    "srv_context_weight": _text("SELECT u AS usr, w FROM ctxw"),
    "srv_taste_center": _text("SELECT u AS usr, pos, round(c, 6) AS x FROM taste"),
    "srv_recommend": _text("SELECT u AS usr, i AS item, CASE WHEN played THEN -1 ELSE plain END AS score FROM hybrid QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, i) <= 20"),
    "srv_recommend_with_played": _text("SELECT u AS usr, i AS item, plain AS score FROM hybrid QUALIFY row_number() OVER (PARTITION BY u ORDER BY plain DESC, i) <= 20"),
    "srv_recommend_in_context": _text("SELECT u AS usr, i AS item, now AS score FROM hybrid QUALIFY row_number() OVER (PARTITION BY u ORDER BY now DESC, i) <= 20"),
    "srv_breakdown": _text("SELECT u AS usr, count(*) FILTER (played) AS n_repeat, count(*) AS n FROM (FROM hybrid QUALIFY row_number() OVER (PARTITION BY u ORDER BY plain DESC, i) <= 20) GROUP BY u"),
    "srv_resolve": _text("SELECT mb AS mbid, any_value(id) AS item, count(*) AS n FROM found LEFT JOIN va USING (mb) GROUP BY mb"),
    "srv_import_stats": _text("SELECT u AS usr, count(*) AS n_listens, count(id) AS n_resolved, count(*) FILTER (id IS NULL) AS n_unresolved, count(DISTINCT id) AS n_items, round(avg((id IS NOT NULL)::INT), 6) AS coverage FROM found LEFT JOIN va USING (mb) GROUP BY u"),
    "srv_contribution": _text("SELECT u AS usr, i AS item, n, strftime(make_timestamp(seen * 1000000), '%Y-%m') AS last_seen_month FROM prof WHERE n > 2 QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, i) <= 200"),
    "srv_top_items": _text("SELECT id AS v1_item_id, mb AS mbid, n FROM va WHERE id < 200"),
    "srt_every_sixth": _text("SELECT id AS v1_item_id FROM va WHERE id < 180 AND id % 6 = 0"),
    # vectors
    "vec_exact_topk": _text("SELECT q AS query_id, i AS item, x AS score, row_number() OVER (PARTITION BY q ORDER BY x DESC, i) AS rnk FROM exact QUALIFY rnk <= 100"),
    "vec_neighbors": _text("SELECT q AS query_id, i AS item, x AS score, row_number() OVER (PARTITION BY q ORDER BY x DESC, i) AS rnk FROM exact WHERE q <> i QUALIFY rnk <= 100"),
    "vec_normalise": _text("SELECT i AS item, unnest(range(64))::INT AS pos, round(unnest(v), 9) AS x FROM ve"),
    "agg_same_brand_rate": _text("SELECT round(avg((a.p_brand = b.p_brand)::INT), 6) AS rate, count(*) AS n FROM (FROM exact WHERE q <> i QUALIFY row_number() OVER (PARTITION BY q ORDER BY x DESC, i) <= 10) AS e JOIN part AS a ON a.p_partkey = q JOIN part AS b ON b.p_partkey = i"),
    "pq_codebooks": _quantized("SELECT s::INT AS subspace, c::INT AS code, unnest(range(8))::INT AS pos, round(unnest(v), 9) AS x FROM cb"),
    "pq_encode": _quantized("SELECT i AS item, s::INT AS subspace, c AS code FROM dec"),
    "pq_decode": _quantized("SELECT i AS item, unnest(range(64))::INT AS dim, round(unnest(v), 9) AS x FROM whole"),
    "pq_norms": _quantized("SELECT i AS item, round(sqrt(list_dot_product(v, v)), 9) AS norm FROM whole"),
    "pq_mse": _quantized("SELECT round(avg(d), 9) AS mse, 32.0::DOUBLE AS compression FROM (SELECT list_sum(list_transform(range(1, 65), lambda k: pow(ve.v[k] - whole.v[k], 2))) / 64 AS d FROM ve JOIN whole USING (i))"),
    "pq_adc_dot": _quantized("SELECT q AS query_id, i AS item, x AS score, row_number() OVER (PARTITION BY q ORDER BY x DESC, i) AS rnk FROM adc QUALIFY rnk <= 100"),
    "pq_cosine": _quantized("SELECT q AS query_id, i AS item, cosine AS score, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, i) AS rnk FROM adc QUALIFY rnk <= 100"),
    "pq_ann_recall": _quantized("SELECT round(sum(len(list_intersect(a, b))) / sum(len(a)), 6) AS recall FROM (SELECT q, list(i ORDER BY x DESC, i)[:100] AS a FROM exact GROUP BY q) JOIN (SELECT q, list(i ORDER BY x DESC, i)[:100] AS b FROM adc GROUP BY q) USING (q)"),
    "pq_reranked_recall": _quantized("SELECT round(sum(len(list_intersect(a, b))) / sum(len(a)), 6) AS recall FROM (SELECT q, list(i ORDER BY x DESC, i)[:100] AS a FROM exact GROUP BY q) JOIN (SELECT q, list(i ORDER BY exact.x DESC, i)[:100] AS b FROM exact SEMI JOIN (FROM adc QUALIFY row_number() OVER (PARTITION BY q ORDER BY x DESC, i) <= 400) USING (q, i) GROUP BY q) USING (q)"),
    "srv_recommend_pq": _quantized("SELECT u AS usr, i AS item, score FROM phybrid QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, i) <= 20"),
    # training data
    "srt_negative_weights": _text("SELECT i AS item, round(sqrt(n) / sum(sqrt(n)) OVER (), 9) AS p FROM vt"),
    "win_first_positives": _text("SELECT u AS usr, i AS item, pos FROM seq WHERE pos <= 100"),
    "agg_sequence_lengths": _text("SELECT u AS usr, max(pos) AS n FROM seq GROUP BY u"),
    "win_context_windows": _text("SELECT u AS usr, pos, i AS target, len(c) AS n_context, array_to_string(c, ',') AS context FROM (SELECT u, pos, i, list(i) OVER (PARTITION BY u ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS c, md5('window:' || u || ':' || pos)[:8] AS h FROM seq) WHERE pos > 1 QUALIFY row_number() OVER (PARTITION BY u ORDER BY h, pos) <= 100"),
    "win_skipgram_pairs": _text("""SELECT a.i AS centre, b.i AS other, count(*) AS n FROM (SELECT *, 1 + floor(5 * ('0x' || md5('reach:' || u || ':' || pos)[:8])::BIGINT / 4294967296)::INT AS reach FROM drawn_seq) AS a JOIN drawn_seq AS b USING (u) WHERE a.pos <> b.pos AND abs(a.pos - b.pos) <= reach GROUP BY ALL"""),
    "srt_anchors": _text("SELECT i AS item, id AS item_id FROM vt WHERE id < 20 OR i IN (SELECT b FROM (FROM near WHERE seed = 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 5) JOIN vt ON vt.i = a WHERE id < 20)"),
    "stm_rhythm": _text("SELECT u AS usr, 'hour' AS kind, hour(make_timestamp(t * 1000000))::INT AS bucket, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT u, 'day', (isodow(make_timestamp(t * 1000000)) - 1)::INT, count(*) FROM ev GROUP BY ALL"),
    "stm_profile_update": _text("SELECT u AS usr, i AS item, n, seen AS last_seen, w AS wscore FROM prof"),
}
