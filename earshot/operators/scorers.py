"""Ranking scorers over a user's history. Each gives (usr, item, score); scores are rounded before they are ranked, and
ties go to the smaller item, so any engine ranks alike. Only scored items are listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earshot.operators import grid
from earshot.plans.catalog import BUILT, FRAMES, KEPT, frame, kept, query, run_sql, table

K = 20
#: Length of the lists that are evaluated and fused, and the rank of an item that a list lacks.
LIST = 200
HALF_LIVES = (30, 90, 365)
AGE = "((last_ts - ts) / 86400e0)"
LN2 = "0.6931471805599453e0"
RRF = 60
#: Dimensions of the item embeddings.
DIM = 64


def decay(weight: str, source: str = "history") -> str:
    return f"SELECT usr, item, round(sum({weight}), 9) AS score FROM {source} GROUP BY usr, item"


def ranked(scored: str, k: int = K) -> str:
    """The top k of each user, ranks from 0; the window's limit is applied before the shuffle."""
    return f"SELECT usr, item, score, rnk - 1 AS rank0 FROM (SELECT usr, item, score, row_number() OVER (PARTITION BY usr ORDER BY score DESC, item) AS rnk FROM {scored}) AS x WHERE rnk <= {k}"


#: The scorers, and which of them fuse lists of others.
SCORERS: list[str] = []
FUSED: list[str] = []


def scorer(name: str, text, fuses: bool = False) -> None:
    """Registers a scorer: the frame of its scores (or what builds its lists), its lists and its query."""
    (FUSED if fuses else SCORERS).append(name)
    if isinstance(text, tuple):
        BUILT[f"top_{name}"] = text
    else:
        FRAMES[f"score_{name}"] = text
        FRAMES[f"top_{name}"] = lambda d: ranked(f"score_{name}", LIST)
    query(_named(f"scr_{name}", lambda d: f"SELECT usr, item, score, rank0 FROM top_{name} WHERE rank0 < {K}"))


def _named(name, f):
    f.__name__ = name
    return f


scorer("user_frequency", lambda d: decay("1e0"))
for days in HALF_LIVES:
    scorer(f"decay_{days}d", lambda d, days=days: decay(f"exp(-{LN2} * {AGE} / {days}e0)"))
scorer("decay_power1", lambda d: decay(f"1e0 / (1e0 + {AGE})"))
scorer("decay_linear365", lambda d: decay(f"greatest(0e0, 1e0 - {AGE} / 365e0)"))
for days in (7, 30, 90, 365):
    scorer(f"decay_step_{days}d", lambda d, days=days: decay(f"CASE WHEN {AGE} <= {days}e0 THEN 1e0 ELSE 0e0 END"))


def popularity(counts: str) -> str:
    return f"SELECT c.usr, p.item, CAST(p.n AS DOUBLE) AS score FROM cohort AS c JOIN ({counts}) AS p ON 1 = 1"


#: The top of a popularity list that a user's list can reach; what can't be listed is left out before.
TOP_ITEMS = "SELECT item, n FROM ({}) AS y WHERE item IN (SELECT item FROM vocab_train) ORDER BY n DESC, item LIMIT {}"
scorer("popularity", lambda d: popularity(TOP_ITEMS.format("SELECT item, n FROM vocab_all", LIST)))
scorer("popularity_train", lambda d: popularity(TOP_ITEMS.format("SELECT item, count(*) AS n FROM history GROUP BY item", LIST)))
scorer("popularity_train_global", lambda d: popularity(TOP_ITEMS.format("SELECT item, n FROM vocab_train", LIST)))


@kept
def unit_vectors(d):
    """Normalised embeddings of the vocabulary's items."""
    return f"SELECT CAST(vec_id AS INT) AS item, {d.scale('embedding')} AS v FROM embeddings WHERE vec_id IN (SELECT item FROM vocab_train)"


@frame
def unit_parts(d):
    return d.explode("v", "pos", "x", "unit_vectors", "item")


def means(d, events: str) -> str:
    """Weighted mean vector of the events (usr, item, w) of each user, normalised."""
    parts = f"SELECT h.usr, p.pos, sum(h.w * p.x) / sum(h.w) AS x FROM ({events}) AS h JOIN unit_parts AS p ON h.item = p.item GROUP BY h.usr, p.pos"
    return f"SELECT usr, transform(v, x -> x / (norm + 1e-8)) AS v FROM (SELECT usr, {d.collect('x', 'pos')} AS v, sqrt(sum(x * x)) AS norm FROM ({parts}) AS m GROUP BY usr) AS y"


def context(weight: str, where: str, source: str = "history"):
    """What builds the lists of a scorer by the mean vector of the chosen events."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        from earshot.functions.dialect import SPARK

        users = run_sql(spark, sf_dir, means(SPARK, f"SELECT usr, item, {weight} AS w FROM {source} AS s WHERE {where}"))
        return grid.top_scores(users, table(spark, sf_dir, "unit_vectors"), LIST)

    return build, ("events", "embeddings")


scorer("item2vec", context("1e0", "back <= 50"))
scorer("item2vec_w10", context("1e0", "back <= 10"))
scorer("item2vec_w100", context("1e0", "back <= 100"))
scorer("item2vec_unique", context("1e0", "1 = 1", "(SELECT DISTINCT usr, item FROM history WHERE back <= 50)"))
scorer("item2vec_recency", context(f"exp(-{LN2} * {AGE} / 90e0)", "back <= 50"))
#: The same from training events alone, for the choice by the validation span.
BUILT["val_item2vec"] = context("1e0", "back <= 50", "train_history")


@frame
def knn_items(d):
    """At most 100 items of a user, the most frequent, before they are paired."""
    return "SELECT usr, item FROM (SELECT usr, item, row_number() OVER (PARTITION BY usr ORDER BY count(*) DESC, item) AS k FROM history GROUP BY usr, item) AS x WHERE k <= 100"


def knn_graph_of(cohorts: str) -> str:
    """The 20 nearest neighbours of each item by users in common over listens of both, for cohorts (seed, usr)."""
    return f"""SELECT seed, a, b, sim FROM (SELECT p.seed, p.a, p.b, round(p.n / sqrt(1e0 * ca.n * cb.n), 9) AS sim,
      row_number() OVER (PARTITION BY p.seed, p.a ORDER BY round(p.n / sqrt(1e0 * ca.n * cb.n), 9) DESC, p.b) AS k
    FROM (SELECT c.seed, x.item AS a, y.item AS b, count(*) AS n FROM ({cohorts}) AS c JOIN knn_items AS x ON x.usr = c.usr JOIN knn_items AS y ON x.usr = y.usr AND x.item <> y.item GROUP BY c.seed, x.item, y.item) AS p
    JOIN (SELECT c.seed, h.item, count(*) AS n FROM ({cohorts}) AS c JOIN history AS h ON h.usr = c.usr GROUP BY c.seed, h.item) AS ca ON ca.seed = p.seed AND ca.item = p.a
    JOIN (SELECT c.seed, h.item, count(*) AS n FROM ({cohorts}) AS c JOIN history AS h ON h.usr = c.usr GROUP BY c.seed, h.item) AS cb ON cb.seed = p.seed AND cb.item = p.b) AS z WHERE k <= 20"""


@kept
def knn_graph(d):
    return knn_graph_of("SELECT 0 AS seed, usr FROM cohort")


@query
def scr_knn_graph(d):
    return "SELECT a, b, sim FROM knn_graph"


scorer("item_knn", lambda d: "SELECT h.usr, g.b AS item, round(sum(h.n * g.sim), 9) AS score FROM (SELECT usr, item, count(*) AS n FROM history GROUP BY usr, item) AS h JOIN knn_graph AS g ON h.item = g.a GROUP BY h.usr, g.b")

#: The lists of all scorers that fuse none.
FRAMES["base_lists"] = lambda d: "\nUNION ALL ".join(f"SELECT '{s}' AS scorer, usr, item, score, rank0 FROM top_{s}" for s in SCORERS)
KEPT.add("base_lists")


def rrf(w: str, ra: str, rb: str) -> str:
    return f"round({w} / ({RRF + 1} + {ra}) + (1e0 - {w}) / ({RRF + 1} + {rb}), 9)"


def paired_lists(a: str, b: str) -> str:
    """Items of either list, with their rank in both; an item that a list lacks has the rank after a full list."""
    return f"""SELECT coalesce(x.usr, y.usr) AS usr, coalesce(x.item, y.item) AS item, coalesce(x.rank0, {LIST}) AS ra, coalesce(y.rank0, {LIST}) AS rb
  FROM ({a}) AS x FULL OUTER JOIN ({b}) AS y ON x.usr = y.usr AND x.item = y.item"""


def list_of(name: str) -> str:
    return f"SELECT usr, item, rank0 FROM base_lists WHERE scorer = '{name}'"


@frame
def val_truth(d):
    """Items of the cohort's validation span; whether the training events have them."""
    return """SELECT v.usr, v.item, CASE WHEN h.item IS NULL THEN 0 ELSE 1 END AS is_repeat FROM (SELECT DISTINCT e.usr, e.item FROM in_vocab AS e JOIN cohort ON e.usr = cohort.usr WHERE e.split = 1) AS v
  LEFT JOIN (SELECT DISTINCT usr, item FROM train_history) AS h ON v.usr = h.usr AND v.item = h.item"""


@kept
def val_lists(d):
    """Decayed lists of 100 from training events alone, for each half-life."""
    return "\nUNION ALL ".join(f"SELECT {h} AS half_life, usr, item, rank0 FROM ({ranked('(' + decay(f'exp(-{LN2} * {AGE} / {h}e0)', 'train_history') + f') AS s{h}', 100)}) AS z{h}" for h in HALF_LIVES)


@kept
def val_half_lives(d):
    """Recall of repeats in the validation span, by half-life."""
    hits = "SELECT l.half_life, t.usr, count(*) AS hits FROM val_lists AS l JOIN val_truth AS t ON l.usr = t.usr AND l.item = t.item WHERE t.is_repeat = 1 GROUP BY l.half_life, t.usr"
    lives = ", ".join(f"({h})" for h in HALF_LIVES)
    return f"""SELECT f.half_life, round(avg(1e0 * coalesce(h.hits, 0) / n.n), 6) AS recall_100 FROM (SELECT * FROM (VALUES {lives}) AS t(half_life)) AS f
  JOIN (SELECT usr, count(*) AS n FROM val_truth WHERE is_repeat = 1 GROUP BY usr) AS n ON 1 = 1 LEFT JOIN ({hits}) AS h ON h.half_life = f.half_life AND h.usr = n.usr GROUP BY f.half_life"""


@frame
def best_half_life(d):
    return "SELECT half_life FROM val_half_lives ORDER BY recall_100 DESC, half_life LIMIT 1"


@frame
def sweep_weights(d):
    return f"SELECT i / 10e0 AS w FROM ({d.range_rows('i', 11)}) AS x"


@kept
def val_weights(d):
    """Recall in the validation span, by the weight of the vector list in its fusion with the chosen decayed list."""
    both = paired_lists("SELECT usr, item, rank0 FROM val_item2vec", "SELECT v.usr, v.item, v.rank0 FROM val_lists AS v JOIN best_half_life AS b ON v.half_life = b.half_life")
    fused = f"SELECT w, usr, item, row_number() OVER (PARTITION BY w, usr ORDER BY {rrf('w', 'ra', 'rb')} DESC, item) AS rnk FROM ({both}) AS p JOIN sweep_weights ON 1 = 1"
    hits = f"SELECT f.w, t.usr, count(*) AS hits FROM ({fused}) AS f JOIN val_truth AS t ON f.usr = t.usr AND f.item = t.item WHERE f.rnk <= 100 GROUP BY f.w, t.usr"
    return f"""SELECT s.w, round(avg(1e0 * coalesce(h.hits, 0) / n.n), 6) AS recall_100 FROM sweep_weights AS s JOIN (SELECT usr, count(*) AS n FROM val_truth GROUP BY usr) AS n ON 1 = 1
  LEFT JOIN ({hits}) AS h ON h.w = s.w AND h.usr = n.usr GROUP BY s.w"""


@frame
def best_weight(d):
    return "SELECT w FROM val_weights ORDER BY recall_100 DESC, w LIMIT 1"


@frame
def chosen_decay_list(d):
    return "SELECT l.usr, l.item, l.rank0 FROM base_lists AS l JOIN best_half_life AS b ON l.scorer = concat('decay_', CAST(b.half_life AS VARCHAR(10)), 'd')"


@kept
def fusion_ranks(d):
    """Ranks of items in the vector list and in the chosen decayed list."""
    return paired_lists(list_of("item2vec"), "SELECT usr, item, rank0 FROM chosen_decay_list")


scorer("rrf_fusion", lambda d: f"SELECT p.usr, p.item, {rrf('b.w', 'p.ra', 'p.rb')} AS score FROM fusion_ranks AS p JOIN best_weight AS b ON 1 = 1", fuses=True)
scorer("weighted_rrf_07", lambda d: f"SELECT usr, item, {rrf('0.7e0', 'ra', 'rb')} AS score FROM ({paired_lists(list_of('item2vec'), list_of('decay_30d'))}) AS p", fuses=True)

FRAMES["fused_lists"] = lambda d: "\nUNION ALL ".join(f"SELECT '{s}' AS scorer, usr, item, score, rank0 FROM top_{s}" for s in FUSED)
KEPT.add("fused_lists")


@frame
def lists(d):
    return "SELECT scorer, usr, item, score, rank0 FROM base_lists UNION ALL SELECT scorer, usr, item, score, rank0 FROM fused_lists"


@frame
def popular_first(d):
    """The items that can follow a short history: one of fewer than K items needs places up to 2 K at most."""
    return f"SELECT item, n, row_number() OVER (ORDER BY n DESC, item) AS place FROM (SELECT item, n FROM vocab_train ORDER BY n DESC, item LIMIT {2 * K}) AS v"


@frame
def remaining_catalogue(d):
    """Catalogue items that a user with fewer than K own items lacks, joined by place, so rows are at most 2 K a user."""
    own = f"SELECT usr, count(DISTINCT item) AS m FROM history GROUP BY usr HAVING count(DISTINCT item) < {K}"
    places = f"SELECT o.usr, i.i + 1 AS place FROM ({own}) AS o JOIN ({d.range_rows('i', 2 * K)}) AS i ON i.i < {K} + o.m"
    return f"SELECT c.usr, p.item, p.n FROM ({places}) AS c JOIN popular_first AS p ON p.place = c.place LEFT JOIN (SELECT DISTINCT usr, item FROM history) AS h ON h.usr = c.usr AND h.item = p.item WHERE h.item IS NULL"


@query
def win_frequency_then_popularity(d):
    return f"""SELECT usr, item, rnk FROM (SELECT usr, item, row_number() OVER (PARTITION BY usr ORDER BY block, n DESC, item) AS rnk FROM
    (SELECT usr, item, 0 AS block, count(*) AS n FROM history GROUP BY usr, item UNION ALL SELECT usr, item, 1 AS block, n FROM remaining_catalogue) AS x) AS y WHERE rnk <= {K}"""


@query
def scr_keep_probs(d):
    f = "(1e0 * n / (SELECT sum(n) FROM vocab_train))"
    return f"SELECT item, round(least(1e0, sqrt(0.001e0 / {f}) + 0.001e0 / {f}), 9) AS keep FROM vocab_train"
