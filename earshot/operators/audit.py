"""Distribution statistics of a listening table, twice where two definitions must agree."""

from __future__ import annotations

from earshot.operators.prep import numbered
from earshot.plans.catalog import frame, kept, query


@frame
def per_user(d):
    return "SELECT usr, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT item) AS n_distinct FROM listens GROUP BY usr"


@frame
def per_item(d):
    return "SELECT item, mbid, count(*) AS n FROM listens GROUP BY item, mbid"


@kept
def ranked_users(d):
    """Users by listens, with what a rank needs, by ranges of the number of listens, so no task sorts all users."""
    ranges = "SELECT usr, n, n_distinct, CAST(floor(log2(n + 1e0) * 8e0) AS INT) AS range_no FROM per_user"
    sums = f"SELECT range_no, count(*) AS k, sum(n) AS s FROM ({ranges}) AS a GROUP BY range_no"
    before = f"SELECT range_no, sum(k) OVER (ORDER BY range_no) - k AS k, sum(s) OVER (ORDER BY range_no) - s AS s, sum(k) OVER () AS m, sum(s) OVER () AS total FROM ({sums}) AS b"
    return f"""SELECT x.usr, x.n, x.n_distinct, row_number() OVER (PARTITION BY x.range_no ORDER BY x.n, x.usr) + y.k AS r, y.m, y.total,
    sum(x.n) OVER (PARTITION BY x.range_no ORDER BY x.n, x.usr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + y.s AS upto
  FROM ({ranges}) AS x JOIN ({before}) AS y ON x.range_no = y.range_no"""


def nearest(p: float) -> str:
    """The nearest-rank percentile's place: floor(n p), at most n - 1, from 0."""
    return f"least(m - 1, CAST(floor(m * {p}e0) AS BIGINT))"


@query
def agg_user_span(d):
    return "SELECT usr, n, first_ts, last_ts FROM per_user"


@query
def agg_item_counts(d):
    return "SELECT item, n FROM per_item"


@query
def dst_user_stats(d):
    return f"""SELECT round(avg(n), 1) AS mean_n, max(CASE WHEN r - 1 = {nearest(0.5)} THEN n END) AS median_n, max(CASE WHEN r - 1 = {nearest(0.9)} THEN n END) AS p90_n,
  min(n) AS min_n, max(n) AS max_n FROM ranked_users"""


@query
def dst_percentiles(d):
    return f"SELECT round({d.percentile('n', 0.5)}, 6) AS median_n, round({d.percentile('n', 0.9)}, 6) AS p90_n FROM per_user"


@query
def dst_density(d):
    return "SELECT round(count(*) * 1e0 / (count(DISTINCT usr) * count(DISTINCT item)), 8) AS density FROM listens"


@query
def dst_top_share(d):
    def share(p):
        return f"round(1e0 * sum(CASE WHEN m - r < greatest(1, CAST(floor(m * {p}e0) AS BIGINT)) THEN n ELSE 0 END) / max(total), 8)"

    return f"SELECT {share(0.01)} AS top_1, {share(0.1)} AS top_10 FROM ranked_users"


@query
def dst_gini_rank(d):
    return "SELECT round(sum(n * (2 * r - m - 1)) * 1e0 / (max(m) * max(total)), 9) AS gini FROM ranked_users"


@query
def dst_gini_lorenz(d):
    return "SELECT round(1e0 - sum((upto + upto - n) * 1e0 / total / m), 9) AS gini FROM ranked_users"


@query
def dst_lorenz_curve(d):
    return f"SELECT p.i, round(1e0 * u.upto / u.total, 8) AS share FROM ({d.range_rows('i', 51)}) AS p JOIN ranked_users AS u ON u.r - 1 = least(CAST(floor(p.i * u.m / 50e0) AS BIGINT), u.m - 1)"


@query
def dst_item_thresholds(d):
    return "SELECT " + ", ".join(f"sum(CASE WHEN n >= {t} THEN 1 ELSE 0 END) AS at_least_{t}" for t in (2, 5, 10, 50, 100)) + " FROM per_item"


@query
def dst_long_tail(d):
    return f"SELECT rnk, n FROM ({numbered('SELECT item, n FROM per_item', 'n DESC, item', 'n')}) AS z"


@query
def dst_sampled_repeat(d):
    return """SELECT round(avg(n_distinct), 6) AS mean_distinct, round(avg(1e0 * n / n_distinct), 6) AS mean_ratio, max(n - n_distinct) AS max_repeats,
  max(CASE WHEN k - 1 = least(m - 1, CAST(floor(m * 0.5e0) AS BIGINT)) THEN n - n_distinct END) AS median_repeats,
  max(CASE WHEN k - 1 = least(m - 1, CAST(floor(m * 0.9e0) AS BIGINT)) THEN n - n_distinct END) AS p90_repeats
  FROM (SELECT *, row_number() OVER (ORDER BY n - n_distinct, usr) AS k, count(*) OVER () AS m FROM (SELECT usr, n, n_distinct FROM per_user ORDER BY usr LIMIT 1000) AS first_users) AS x"""


@frame
def gini_pair(d):
    return "SELECT sum(n * (2 * r - m - 1)) * 1e0 / (max(m) * max(total)) AS a, 1e0 - sum((upto + upto - n) * 1e0 / total / m) AS b FROM ranked_users"


@query
def dst_tolerance_compare(d):
    return """SELECT 'gini' AS name, CASE WHEN abs(a - b) <= 0.001e0 * abs(a) THEN 'PASS' WHEN abs(a - b) <= 0.01e0 * abs(a) THEN 'SOFT-PASS' ELSE 'FAIL' END AS verdict FROM gini_pair
  UNION ALL SELECT 'n_users' AS name, CASE WHEN max(m) = count(DISTINCT usr) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ranked_users"""


@query
def tmp_year_counts(d):
    return f"SELECT {d.year('ts')} AS year, count(*) AS n FROM listens GROUP BY {d.year('ts')}"


@query
def tmp_hour_buckets(d):
    return f"SELECT {d.idiv('ts', '3600')} AS hour_bucket, count(*) AS n FROM listens GROUP BY {d.idiv('ts', '3600')}"


@frame
def census(d):
    """Users stand for files, the remainder of their number for shards and tiers."""
    shard = d.mod("usr", 7)
    return f"""SELECT {shard} AS shard, CASE WHEN {shard} < 3 THEN 'full' ELSE 'partial' END AS tier, count(DISTINCT usr) AS n_users, count(*) AS n_rows,
  sum(CASE WHEN recording = '' THEN 1 ELSE 0 END) AS n_empty, min({d.try_int('ts_text')}) AS min_ts, max({d.try_int('ts_text')}) AS max_ts FROM parsed GROUP BY {shard}"""


@query
def agg_census(d):
    return "SELECT *, CASE WHEN n_rows > 0 THEN round(100e0 * (1 - 1e0 * n_empty / n_rows), 4) END AS coverage FROM census"


@query
def agg_census_rollup(d):
    return "SELECT tier, shard, sum(n_users) AS n_users, sum(n_rows) AS n_rows, min(min_ts) AS min_ts, max(max_ts) AS max_ts, count(DISTINCT shard) AS n_shards FROM census GROUP BY ROLLUP (tier, shard)"


@query
def src_shard_selection(d):
    return "SELECT shard, n_rows FROM census WHERE tier = 'partial' ORDER BY n_rows, shard LIMIT 1"
