"""The serving path: profile state, decayed repeat scores, rhythm, taste, hybrid ranking, import and contribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import grid
from earshot.plans.catalog import BUILT, frame, kept, query, table

#: Weight of each signal, half-life, blend weights, least and most items of a contribution.
SIGNALS = {"play": 1.0, "completion": 1.2, "replay": 1.0, "like": 2.0, "save": 1.5, "playlist_add": 1.5, "short_play": 0.3, "skip": 0.0}
#: What the table's event types stand for.
EVENTS = {"view": "play", "purchase": "like", "signup": "save", "click": "short_play", "error": "skip"}
HALF_LIFE, W_REPEAT, W_DISCOVERY, EXPLORATION = 90, 0.7, 0.3, 0.3
NOW = 1706745600
K, MIN_COUNT, MAX_ITEMS = 20, 3, 200
LN2 = "0.6931471805599453e0"


@frame
def signal_weights(d):
    return "SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{s}', {SIGNALS[s]}e0)" for e, s in EVENTS.items()) + ") AS t(signal, kind, w)"


@kept
def profile_state(d):
    return "SELECT l.usr, l.item, count(*) AS n, max(l.ts) AS last_seen, round(sum(s.w), 6) AS wscore FROM listens AS l JOIN signal_weights AS s ON l.signal = s.signal GROUP BY l.usr, l.item"


@query
def srv_profile_state(d):
    return "SELECT usr, item, n, last_seen, wscore FROM profile_state"


@frame
def repeat_scores(d):
    return f"SELECT usr, item, round(wscore * power(0.5e0, greatest(0, {NOW} - last_seen) / ({HALF_LIFE} * 86400e0)), 9) AS score FROM profile_state"


@query
def srv_decay_scores(d):
    return "SELECT usr, item, score FROM repeat_scores"


@query
def srv_repeat_only(d):
    return f"SELECT usr, item, score FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY score DESC, item) AS k FROM repeat_scores) AS x WHERE k <= {K}"


def hour(d, ts: str) -> str:
    return f"({d.idiv(ts, '3600')} % 24)"


def weekday(d, ts: str) -> str:
    """Monday is 0; the first of January 1970 was a Thursday."""
    return f"(({d.idiv(ts, '86400')} + 3) % 7)"


@kept
def rhythm(d):
    """Share of each hour and weekday in a user's listens; all hours and days are listed."""
    def shares(kind, n, expr):
        return f"""SELECT u.usr, '{kind}' AS kind, b.i AS bucket, round(coalesce(c.n, 0) * 1e0 / u.m, 9) AS p FROM (SELECT usr, count(*) AS m FROM listens GROUP BY usr) AS u
    JOIN ({d.range_rows('i', n)}) AS b ON 1 = 1 LEFT JOIN (SELECT usr, {expr} AS b, count(*) AS n FROM listens GROUP BY usr, {expr}) AS c ON c.usr = u.usr AND c.b = b.i"""
    return shares("hour", 24, hour(d, "ts")) + " UNION ALL " + shares("day", 7, weekday(d, "ts"))


@query
def srv_rhythm(d):
    return "SELECT usr, kind, bucket, p FROM rhythm"


@frame
def context_weights(d):
    now = str(NOW)
    return f"SELECT h.usr, round(0.9e0 + 0.2e0 * (0.7e0 * h.p + 0.3e0 * w.p), 9) AS w FROM rhythm AS h JOIN rhythm AS w ON h.usr = w.usr WHERE h.kind = 'hour' AND h.bucket = {hour(d, now)} AND w.kind = 'day' AND w.bucket = {weekday(d, now)}"


@query
def srv_context_weight(d):
    return "SELECT usr, w FROM context_weights"


@frame
def catalogue(d):
    return f"SELECT CAST(vec_id AS INT) AS item, {d.scale('embedding')} AS v FROM embeddings"


def taste_of(vectors: str):
    """What builds each user's blend of the weighted centre of played items and their plain mean, by the exploration."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores = table(spark, sf_dir, "repeat_scores").select("usr", "item", (F.col("score") + 1e-6).alias("score"))
        return grid.centres(scores, table(spark, sf_dir, vectors), EXPLORATION)

    return build, ("events", "embeddings")


BUILT["taste_vectors"] = taste_of("catalogue")


@frame
def taste(d):
    return d.explode("v", "pos", "x", "taste_vectors", "usr")


@query
def srv_taste_center(d):
    return "SELECT usr, pos, round(x, 6) AS x FROM taste"


def repeat_vectors(d, vectors: str) -> str:
    """Users with their normalised taste, the weight of the present hour and day, and their repeat scores by item."""
    means = f"SELECT usr, v, sqrt({d.dot('v', 'v')}) AS norm FROM {vectors}"
    scores = "SELECT usr, array_sort(collect_list(struct(item, score))) AS s FROM repeat_scores GROUP BY usr"
    return f"SELECT m.usr, transform(m.v, x -> x / (m.norm + 1e-12)) AS v, c.w, s.s.item AS items, s.s.score AS repeat FROM ({means}) AS m JOIN ({scores}) AS s ON s.usr = m.usr JOIN context_weights AS c ON c.usr = m.usr"


@kept
def user_vectors(d):
    return repeat_vectors(d, "taste_vectors")


def recommended(users: str, items: str, in_context: bool, exclude: bool, opened=lambda spark, sf_dir: grid.divided("scaled", "unit")):
    """What builds the lists of K of the hybrid ranking; opened(spark, folder) is what makes unit vectors of a block of the items."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, users)
        rows = rows if in_context else rows.withColumn("w", F.lit(1.0))
        return grid.blended(rows, table(spark, sf_dir, items), K, W_REPEAT, W_DISCOVERY, exclude, opened(spark, sf_dir))

    return build, ("events", "embeddings")


@frame
def unit_catalogue(d):
    """All items as they are given, and what their vectors are divided by one after the other to be of length one."""
    v = d.scale("embedding")
    return f"SELECT CAST(vec_id AS INT) AS item, embedding AS v, sqrt({d.dot('embedding', 'embedding')}) + 1e-8 AS scaled, sqrt({d.dot(v, v)}) + 1e-12 AS unit FROM embeddings"


BUILT["recommended_new"] = recommended("user_vectors", "unit_catalogue", False, True)
BUILT["recommended_all"] = recommended("user_vectors", "unit_catalogue", False, False)
BUILT["recommended_now"] = recommended("user_vectors", "unit_catalogue", True, False)


@query
def srv_recommend(d):
    """Played items get -1, so they fill a list only where the catalogue ends."""
    return "SELECT usr, item, score FROM recommended_new"


@query
def srv_recommend_with_played(d):
    return "SELECT usr, item, score FROM recommended_all"


@query
def srv_recommend_in_context(d):
    return "SELECT usr, item, score FROM recommended_now"


@query
def srv_breakdown(d):
    return "SELECT usr, sum(played) AS n_repeat, count(*) AS n FROM recommended_all GROUP BY usr"


@frame
def export_rows(d):
    """A listening export: an identifier in one of two places, sometimes unknown or empty."""
    kind = d.mod("event_id", 11)
    return f"SELECT usr, ts, CASE {kind} WHEN 1 THEN '' WHEN 2 THEN 'unknown' WHEN 3 THEN '' ELSE mbid END AS a, CASE {kind} WHEN 3 THEN mbid ELSE '' END AS b FROM listens"


@frame
def resolved(d):
    return "SELECT e.usr, e.ts, coalesce(nullif(e.a, ''), nullif(e.b, '')) AS mbid, v.v1_item_id AS item FROM export_rows AS e LEFT JOIN vocab_all AS v ON v.mbid = coalesce(nullif(e.a, ''), nullif(e.b, ''))"


@query
def srv_resolve(d):
    return "SELECT mbid, max(item) AS item, count(*) AS n FROM resolved GROUP BY mbid"


@query
def srv_import_stats(d):
    return "SELECT usr, count(*) AS n_listens, count(item) AS n_resolved, count(*) - count(item) AS n_unresolved, count(DISTINCT item) AS n_items, round(CASE WHEN count(*) = 0 THEN 0e0 ELSE 1e0 * count(item) / count(*) END, 6) AS coverage FROM resolved GROUP BY usr"


@query
def srv_contribution(d):
    return f"SELECT usr, item, n, {d.month('last_seen')} AS last_seen_month FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY n DESC, item) AS k FROM profile_state WHERE n >= {MIN_COUNT}) AS x WHERE k <= {MAX_ITEMS}"


@query
def srv_top_items(d):
    return "SELECT v1_item_id, mbid, n FROM vocab_all ORDER BY v1_item_id LIMIT 200"


@query
def srt_every_sixth(d):
    return f"SELECT v1_item_id FROM vocab_all WHERE v1_item_id < 200 AND {d.mod('v1_item_id', 6)} = 0 ORDER BY v1_item_id LIMIT 30"
