"""Evaluation of top lists against the test items of the cohort."""

from __future__ import annotations

from earshot.operators.prep import numbered
from earshot.operators.scorers import FUSED, LIST, SCORERS, knn_graph_of, list_of, rrf
from earshot.plans.catalog import frame, kept, query

#: All scorers are evaluated.
EVALUATED = (*SCORERS, *FUSED)
PARTS = ("overall", "repeat", "discovery")


@frame
def n_truth(d):
    return "SELECT usr, part, count(*) AS n FROM truth_split GROUP BY usr, part"


@frame
def ideal_gain(d):
    """Gain of a perfect list of each length up to 20."""
    return f"SELECT a.i + 1 AS n, sum(1e0 / log2(b.i + 2e0)) AS gain FROM ({d.range_rows('i', 20)}) AS a JOIN ({d.range_rows('i', 20)}) AS b ON b.i <= a.i GROUP BY a.i"


@kept
def user_metrics(d):
    """One row per scorer, user and part of the truth."""
    names = ", ".join(f"('{s}')" for s in EVALUATED)
    return f"""SELECT s.scorer, t.usr, t.part, t.n,
    1e0 * coalesce(h.hits_20, 0) / t.n AS recall_20, 1e0 * coalesce(h.hits_100, 0) / t.n AS recall_100, coalesce(h.hits_20, 0) / 20e0 AS precision_20,
    coalesce(h.gain, 0e0) / g.gain AS ndcg_20, CASE WHEN h.first < 10 THEN 1e0 / (h.first + 1) ELSE 0e0 END AS mrr_10, CASE WHEN h.hits_20 > 0 THEN 1e0 ELSE 0e0 END AS hitrate_20
  FROM (SELECT * FROM (VALUES {names}) AS v(scorer)) AS s JOIN n_truth AS t ON 1 = 1
  LEFT JOIN (SELECT l.scorer, l.usr, t.part, sum(CASE WHEN l.rank0 < 20 THEN 1 ELSE 0 END) AS hits_20, count(*) AS hits_100, min(l.rank0) AS first,
      sum(CASE WHEN l.rank0 < 20 THEN 1e0 / log2(l.rank0 + 2e0) ELSE 0e0 END) AS gain
    FROM lists AS l JOIN truth_split AS t ON l.usr = t.usr AND l.item = t.item WHERE l.rank0 < 100 GROUP BY l.scorer, l.usr, t.part) AS h
    ON h.scorer = s.scorer AND h.usr = t.usr AND h.part = t.part
  JOIN ideal_gain AS g ON g.n = least(t.n, 20)"""


NAMES = ("recall_20", "recall_100", "precision_20", "ndcg_20", "mrr_10", "hitrate_20")


@query
def met_ranking(d):
    return f"SELECT scorer, part, count(*) AS n_users, {', '.join(f'round(avg({m}), 6) AS {m}' for m in NAMES)} FROM user_metrics GROUP BY scorer, part"


@query
def met_per_user(d):
    return f"SELECT scorer, usr, part, {', '.join(f'round({m}, 6) AS {m}' for m in NAMES)} FROM user_metrics"


@query
def met_flat(d):
    names = ", ".join(f"('{m}')" for m in NAMES)
    value = "CASE m.name " + " ".join(f"WHEN '{m}' THEN u.{m}" for m in NAMES) + " END"
    return f"SELECT u.scorer, concat(u.part, '.', m.name) AS metric, round(avg({value}), 6) AS value FROM user_metrics AS u JOIN (SELECT * FROM (VALUES {names}) AS t(name)) AS m ON 1 = 1 GROUP BY u.scorer, u.part, m.name"


@query
def met_percentiles(d):
    parts = ", ".join(f"round({d.percentile('recall_100', p)}, 6) AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))
    return f"SELECT scorer, {parts} FROM user_metrics WHERE part = 'overall' GROUP BY scorer"


@query
def met_segments(d):
    seg = "CASE WHEN c.n_history < 50 THEN 'light' WHEN c.n_history < 70 THEN 'medium' ELSE 'heavy' END"
    return f"SELECT m.scorer, {seg} AS activity, count(*) AS n_users, round(avg(m.recall_100), 6) AS recall_100 FROM user_metrics AS m JOIN cohort AS c ON m.usr = c.usr WHERE m.part = 'overall' GROUP BY m.scorer, {seg}"


@frame
def item_places(d):
    """Popularity place of each item, and the size of the catalogue."""
    return f"SELECT item, rnk - 1 AS place, (SELECT count(*) FROM vocab_train) AS m FROM ({numbered('SELECT item, n FROM vocab_train', 'n DESC, item', 'n')}) AS z"


@query
def win_popularity_places(d):
    return "SELECT item, place FROM item_places"


@query
def met_novelty(d):
    return "SELECT scorer, round(avg(x), 6) AS novelty FROM (SELECT l.scorer, l.usr, avg(1e0 * p.place / p.m) AS x FROM lists AS l JOIN item_places AS p ON l.item = p.item WHERE l.rank0 < 20 GROUP BY l.scorer, l.usr) AS y GROUP BY scorer"


@query
def met_diversity(d):
    """Mean cosine of the pairs in a list, from the square of the vectors' sum: no pair is formed."""
    sums = "SELECT l.scorer, l.usr, p.pos, sum(p.x) AS x, sum(p.x * p.x) AS xx, count(*) AS n FROM lists AS l JOIN unit_parts AS p ON l.item = p.item WHERE l.rank0 < 20 GROUP BY l.scorer, l.usr, p.pos"
    return f"SELECT scorer, round(avg(c), 6) AS mean_cosine FROM (SELECT scorer, usr, (sum(x * x) - sum(xx)) / (max(n) * (max(n) - 1e0)) AS c FROM ({sums}) AS s WHERE n > 1 GROUP BY scorer, usr) AS y GROUP BY scorer"


@frame
def calibrated(d):
    return """SELECT l.scorer, CASE WHEN t.item IS NULL THEN 0e0 ELSE 1e0 END AS hit,
    CASE WHEN max(l.score) OVER w - min(l.score) OVER w < 1e-12 THEN 0e0 ELSE round((l.score - min(l.score) OVER w) / (max(l.score) OVER w - min(l.score) OVER w), 9) END AS p
  FROM (SELECT * FROM lists WHERE rank0 < 20) AS l LEFT JOIN truth AS t ON l.usr = t.usr AND l.item = t.item WINDOW w AS (PARTITION BY l.scorer, l.usr)"""


@frame
def bins(d):
    b = "CAST(least(floor(p * 10e0 + 1e-9), 9e0) AS INT)"
    return f"SELECT scorer, {b} AS bin, count(*) AS n, avg(p) AS mean_p, avg(hit) AS mean_hit FROM calibrated GROUP BY scorer, {b}"


@query
def met_calibration(d):
    return "SELECT scorer, bin, n, round(mean_p, 6) AS mean_p, round(mean_hit, 6) AS mean_hit FROM bins"


@query
def met_ece(d):
    return "SELECT scorer, round(sum(n * abs(mean_p - mean_hit)) / sum(n), 6) AS ece FROM bins GROUP BY scorer"


@query
def met_tail(d):
    """Share of the recommendations by popularity bucket, and of those the share of hits."""
    bucket = "CASE WHEN p.place < p.m * 0.01e0 THEN 'head' WHEN p.place < p.m * 0.1e0 THEN 'mid' ELSE 'tail' END"
    rows = f"""SELECT l.scorer, {bucket} AS bucket, count(*) AS n, sum(CASE WHEN t.item IS NULL THEN 0 ELSE 1 END) AS hits
  FROM lists AS l JOIN item_places AS p ON l.item = p.item LEFT JOIN truth AS t ON l.usr = t.usr AND l.item = t.item WHERE l.rank0 < 20 GROUP BY l.scorer, {bucket}"""
    return f"SELECT scorer, bucket, n, round(1e0 * n / sum(n) OVER (PARTITION BY scorer), 6) AS share, round(1e0 * hits / n, 6) AS hit_share FROM ({rows}) AS x"


@query
def met_coverage(d):
    return "SELECT scorer, round(1e0 * count(DISTINCT item) / (SELECT count(*) FROM vocab_train), 6) AS coverage FROM lists WHERE rank0 < 20 GROUP BY scorer"


@query
def met_saturation(d):
    """Share of the first k places that hold an item of the user's history, in the chosen decayed list; k ends at its length."""
    ks = ", ".join(f"({k}, {min(k, LIST)})" for k in (10, 20, 50, 100, 200, 500))
    seen = f"SELECT l.usr, l.rank0 FROM chosen_decay_list AS l JOIN (SELECT DISTINCT usr, item FROM history) AS h ON h.usr = l.usr AND h.item = l.item"
    per = f"SELECT k.k, k.reach, u.usr, sum(CASE WHEN s.rank0 < k.reach THEN 1 ELSE 0 END) AS n FROM (SELECT * FROM (VALUES {ks}) AS t(k, reach)) AS k JOIN cohort AS u ON 1 = 1 LEFT JOIN ({seen}) AS s ON s.usr = u.usr GROUP BY k.k, k.reach, u.usr"
    return f"SELECT k, round(avg(1e0 * n / reach), 6) AS seen_share FROM ({per}) AS x GROUP BY k"


@query
def met_repeat_share(d):
    return "SELECT scorer, round(avg(x), 6) AS repeat_share FROM (SELECT l.scorer, l.usr, avg(CASE WHEN t.is_repeat = 1 THEN 1e0 ELSE 0e0 END) AS x FROM lists AS l LEFT JOIN truth AS t ON l.usr = t.usr AND l.item = t.item WHERE l.rank0 < 20 GROUP BY l.scorer, l.usr) AS y GROUP BY scorer"


@frame
def sweep_lists(d):
    """The fusion by each weight of the vector list."""
    return f"SELECT w, usr, item, row_number() OVER (PARTITION BY w, usr ORDER BY {rrf('w', 'ra', 'rb')} DESC, item) - 1 AS rank0 FROM fusion_ranks JOIN sweep_weights ON 1 = 1"


@query
def met_fusion_sweep(d):
    """Recall of each weight, over all users of the cohort; a user without a discovery counts as 0 there."""
    hits = """SELECT s.w, t.usr, t.part, sum(CASE WHEN s.rank0 < 20 THEN 1 ELSE 0 END) AS hits_20, count(*) AS hits_100 FROM sweep_lists AS s
    JOIN truth_split AS t ON s.usr = t.usr AND s.item = t.item WHERE s.rank0 < 100 AND t.part IN ('overall', 'discovery') GROUP BY s.w, t.usr, t.part"""
    per = f"SELECT h.w, h.part, 1e0 * h.hits_20 / n.n AS r20, 1e0 * h.hits_100 / n.n AS r100 FROM ({hits}) AS h JOIN n_truth AS n ON n.usr = h.usr AND n.part = h.part"
    of = "(SELECT count(*) FROM cohort)"
    return f"""SELECT w.w, round(coalesce(sum(CASE WHEN x.part = 'overall' THEN x.r20 END), 0e0) / {of}, 6) AS recall_20, round(coalesce(sum(CASE WHEN x.part = 'overall' THEN x.r100 END), 0e0) / {of}, 6) AS recall_100,
  round(coalesce(sum(CASE WHEN x.part = 'discovery' THEN x.r100 END), 0e0) / {of}, 6) AS discovery_recall_100 FROM sweep_weights AS w LEFT JOIN ({per}) AS x ON x.w = w.w GROUP BY w.w"""


@query
def met_val_selection(d):
    """What the validation span alone chooses: the half-life by its repeats, then the weight of the fusion."""
    return """SELECT 'half_life' AS stage, CAST(v.half_life AS DOUBLE) AS candidate, v.recall_100, v.half_life = b.half_life AS chosen FROM val_half_lives AS v JOIN best_half_life AS b ON 1 = 1
  UNION ALL SELECT 'weight' AS stage, CAST(v.w AS DOUBLE) AS candidate, v.recall_100, v.w = b.w AS chosen FROM val_weights AS v JOIN best_weight AS b ON 1 = 1"""


#: Pairs of scorers whose recalls are compared.
PAIRS = (("decay_90d", "user_frequency"), ("decay_90d", "popularity_train_global"), ("item2vec_w10", "popularity_train_global"), ("rrf_fusion", "decay_90d"))
RESAMPLES = 1000


@kept
def paired(d):
    """Differences of the pairs by user, in one row per part and user, numbered from 0 within the part."""
    scorers = sorted({s for p in PAIRS for s in p})
    wide = ", ".join(f"max(CASE WHEN scorer = '{s}' THEN recall_100 END) AS {s}" for s in scorers)
    rows = f"SELECT part, usr, {wide} FROM user_metrics WHERE part IN ('overall', 'repeat', 'discovery') GROUP BY part, usr"
    diffs = ", ".join(f"{a} - {b} AS d{i}" for i, (a, b) in enumerate(PAIRS))
    # users are numbered in ranges of their id, as no task may sort them all
    dealt = f"SELECT *, CAST(floor(usr / 4096e0) AS BIGINT) AS range_no FROM ({rows}) AS r"
    before = f"SELECT part, range_no, sum(k) OVER (PARTITION BY part ORDER BY range_no) - k AS k, sum(k) OVER (PARTITION BY part) AS m FROM (SELECT part, range_no, count(*) AS k FROM ({dealt}) AS a GROUP BY part, range_no) AS b"
    return f"SELECT x.part, x.usr, y.m, row_number() OVER (PARTITION BY x.part, x.range_no ORDER BY x.usr) - 1 + y.k AS j, {diffs} FROM ({dealt}) AS x JOIN ({before}) AS y ON x.part = y.part AND x.range_no = y.range_no"


@query
def met_bootstrap(d):
    """Paired bootstrap of the differences. Draws are an arithmetic hash of resample and place, so that any engine draws alike.

    A draw is one row that all pairs share; draws meet the drawn user in an equi-join and are summed by resample before
    the shuffle.
    """
    h = d.mod("(CAST(b.i AS BIGINT) * 7919 + p.j * 104729 + (p.j + 1) * (b.i + 1))", 1000003)
    n = range(len(PAIRS))
    draws = f"SELECT p.part, b.i AS b, {h} - p.m * {d.idiv(h, 'p.m')} AS at FROM ({d.range_rows('i', RESAMPLES)}) AS b JOIN paired AS p ON 1 = 1"
    means = f"SELECT w.part, w.b, {', '.join(f'avg(q.d{i}) AS x{i}' for i in n)} FROM ({draws}) AS w JOIN paired AS q ON q.part = w.part AND q.j = w.at GROUP BY w.part, w.b"
    names = " ".join(f"WHEN {i} THEN '{a}_vs_{b}'" for i, (a, b) in enumerate(PAIRS))
    value = "CASE k.i " + " ".join(f"WHEN {i} THEN y.x{i}" for i in n) + " END"
    diff = "CASE k.i " + " ".join(f"WHEN {i} THEN y.d{i}" for i in n) + " END"
    numbers = d.range_rows("i", len(PAIRS))
    spread = f"SELECT y.part, k.i, {value} AS x FROM ({means}) AS y JOIN ({numbers}) AS k ON 1 = 1"
    real = f"SELECT y.part, k.i, round(avg({diff}), 6) AS mean_diff FROM paired AS y JOIN ({numbers}) AS k ON 1 = 1 GROUP BY y.part, k.i"
    return f"""SELECT CASE s.i {names} END AS pair, s.part, max(r.mean_diff) AS mean_diff, round({d.percentile('s.x', 0.025)}, 6) AS low, round({d.percentile('s.x', 0.975)}, 6) AS high,
  round(avg(CASE WHEN s.x > 0 THEN 1e0 ELSE 0e0 END), 4) AS p_positive FROM ({spread}) AS s JOIN ({real}) AS r ON r.part = s.part AND r.i = s.i GROUP BY s.i, s.part"""


@query
def met_leakage_delta(d):
    """What counting the test span adds to popularity: the cohort's training counts less those of all events."""
    mean = "SELECT round(avg(recall_100), 6) AS x FROM user_metrics WHERE part = 'overall' AND scorer = '{}'"
    return f"SELECT b.x AS all_events, a.x AS train_only, round(a.x - b.x, 6) AS delta FROM ({mean.format('popularity_train')}) AS a JOIN ({mean.format('popularity')}) AS b ON 1 = 1"


@kept
def drawn_cohorts(d):
    """Three cohorts: each eligible user by a coin for each seed."""
    coin = "substr(md5(concat(CAST(s.seed AS VARCHAR(20)), ':', CAST(c.usr AS VARCHAR(20)))), 1, 1) < '8'"
    return f"SELECT s.seed, c.usr FROM cohort AS c JOIN (SELECT * FROM (VALUES (42), (43), (44)) AS t(seed)) AS s ON {coin}"


@query
def met_multiseed(d):
    """Mean and deviation of the recall over the drawn cohorts; the scorers that learn from a cohort are scored anew for each."""
    cohorts = "SELECT seed, usr FROM drawn_cohorts"
    counts = f"SELECT c.seed, h.item, count(*) AS n FROM ({cohorts}) AS c JOIN history AS h ON h.usr = c.usr GROUP BY c.seed, h.item"
    popular = f"SELECT c.seed, c.usr, p.item, 'popularity_train' AS scorer FROM ({cohorts}) AS c JOIN (SELECT seed, item, row_number() OVER (PARTITION BY seed ORDER BY n DESC, item) AS k FROM ({counts}) AS x) AS p ON p.seed = c.seed WHERE p.k <= 100"
    near = f"SELECT c.seed, h.usr, g.b AS item, round(sum(h.n * g.sim), 9) AS score FROM ({cohorts}) AS c JOIN (SELECT usr, item, count(*) AS n FROM history GROUP BY usr, item) AS h ON h.usr = c.usr JOIN ({knn_graph_of(cohorts)}) AS g ON g.seed = c.seed AND h.item = g.a GROUP BY c.seed, h.usr, g.b"
    knn = f"SELECT seed, usr, item, 'item_knn' AS scorer FROM (SELECT *, row_number() OVER (PARTITION BY seed, usr ORDER BY score DESC, item) AS k FROM ({near}) AS x) AS y WHERE k <= 100"
    hits = f"SELECT z.seed, z.usr, z.scorer, count(*) AS hits FROM ({popular} UNION ALL {knn}) AS z JOIN truth AS t ON t.usr = z.usr AND t.item = z.item GROUP BY z.seed, z.usr, z.scorer"
    anew = f"SELECT c.seed, s.scorer, 1e0 * coalesce(h.hits, 0) / n.n AS recall FROM ({cohorts}) AS c JOIN (SELECT * FROM (VALUES ('popularity_train'), ('item_knn')) AS v(scorer)) AS s ON 1 = 1 JOIN n_truth AS n ON n.usr = c.usr AND n.part = 'overall' LEFT JOIN ({hits}) AS h ON h.seed = c.seed AND h.usr = c.usr AND h.scorer = s.scorer"
    same = f"SELECT c.seed, u.scorer, u.recall_100 AS recall FROM ({cohorts}) AS c JOIN user_metrics AS u ON u.usr = c.usr WHERE u.part = 'overall' AND u.scorer NOT IN ('popularity_train', 'item_knn')"
    return f"SELECT scorer, count(*) AS n_seeds, round(avg(x), 6) AS mean_recall, round(coalesce(stddev_samp(x), 0e0), 6) AS sd_recall FROM (SELECT seed, scorer, avg(recall) AS x FROM ({anew} UNION ALL {same}) AS w GROUP BY seed, scorer) AS y GROUP BY scorer"


@query
def met_global_split(d):
    """Truth after one date for all: the cohort's last history event less the test span."""
    return f"""SELECT count(*) AS n_truth, count(DISTINCT s.usr) AS n_users, round(avg(CASE WHEN l.item IS NULL THEN 0e0 ELSE 1e0 END), 6) AS recall_20
  FROM (SELECT DISTINCT e.usr, e.item FROM in_vocab AS e JOIN cohort ON e.usr = cohort.usr WHERE e.ts > (SELECT max(ts) - 172800 FROM history)) AS s
  LEFT JOIN ({list_of('decay_30d')} AND rank0 < 20) AS l ON l.usr = s.usr AND l.item = s.item"""


@query
def set_jaccard(d):
    """Overlap of each user's first twenty in two lists."""
    both = f"SELECT usr, item, count(*) AS n FROM ({list_of('decay_30d')} AND rank0 < 20 UNION ALL {list_of('item2vec')} AND rank0 < 20) AS x GROUP BY usr, item"
    return f"SELECT usr, round(1e0 * sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) / count(*), 6) AS jaccard FROM ({both}) AS y GROUP BY usr"
