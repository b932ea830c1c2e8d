"""Training data of the sequence and factor models: windows, pairs, positives and sampling weights.

Draws are hashes (the first eight hex digits of an MD5), so reruns and engines agree.
"""

from __future__ import annotations

from earshot.plans.catalog import frame, kept, query

#: Longest context, widest reach of a pair, most windows of a user, and first positives of a user.
WINDOW, REACH, MOST, FIRST = 50, 5, 100, 100


def draw(d, seed: str, *columns: str) -> str:
    """A hashed number from 0 to 1, exclusive."""
    text = "md5(concat('" + seed + "'" + "".join(f", ':', CAST({c} AS VARCHAR(20))" for c in columns) + "))"
    return f"(CAST(conv(substr({text}, 1, 8), 16, 10) AS BIGINT) / 4294967296e0)"


@kept
def sequence(d):
    return "SELECT usr, item, row_number() OVER (PARTITION BY usr ORDER BY ts, event_id) AS pos FROM train_history"


@frame
def windows(d):
    """What stands before each position after the first, and the item there; of a long history a drawn MOST positions."""
    chosen = f"SELECT usr, pos FROM (SELECT usr, pos, row_number() OVER (PARTITION BY usr ORDER BY {draw(d, 'window', 'usr', 'pos')}, pos) AS k FROM sequence WHERE pos > 1) AS x WHERE k <= {MOST}"
    every = f"SELECT usr, pos, item AS target, collect_list(item) OVER (PARTITION BY usr ORDER BY pos ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS context FROM sequence"
    return f"SELECT e.usr, e.pos, e.target, e.context FROM ({every}) AS e JOIN ({chosen}) AS c ON c.usr = e.usr AND c.pos = e.pos"


@query
def win_context_windows(d):
    """Contexts as text, oldest item first."""
    return "SELECT usr, pos, target, size(context) AS n_context, array_join(transform(context, x -> CAST(x AS STRING)), ',') AS context FROM windows"


@kept
def kept_sequence(d):
    """Positions that the subsampling of frequent items keeps, numbered anew."""
    f = "(1e0 * n / (SELECT sum(n) FROM vocab_train))"
    keep = f"SELECT item, least(1e0, sqrt(0.001e0 / {f}) + 0.001e0 / {f}) AS keep FROM vocab_train"
    return f"SELECT s.usr, s.item, row_number() OVER (PARTITION BY s.usr ORDER BY s.pos) AS pos FROM sequence AS s JOIN ({keep}) AS k ON k.item = s.item WHERE {draw(d, 'keep', 's.usr', 's.pos')} < k.keep"


@query
def win_skipgram_pairs(d):
    """Pairs within a drawn reach of 1 to REACH of each centre; equi-joined on the offset, so a user's history is never squared."""
    offsets = f"SELECT i - {REACH} AS o FROM ({d.range_rows('i', 2 * REACH + 1)}) AS r WHERE i <> {REACH}"
    reach = f"1 + CAST(floor({REACH}e0 * {draw(d, 'reach', 's.usr', 's.pos')}) AS INT)"
    return f"SELECT a.item AS centre, b.item AS other, count(*) AS n FROM (SELECT s.usr, s.item, s.pos, s.pos + o.o AS at FROM kept_sequence AS s JOIN ({offsets}) AS o ON abs(o.o) <= {reach}) AS a JOIN kept_sequence AS b ON a.usr = b.usr AND a.at = b.pos GROUP BY a.item, b.item"


@query
def srt_negative_weights(d):
    return "SELECT item, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM vocab_train), 9) AS p FROM vocab_train"


@query
def win_first_positives(d):
    return f"SELECT usr, item, pos FROM sequence WHERE pos <= {FIRST}"


@query
def agg_sequence_lengths(d):
    return "SELECT usr, count(*) AS n FROM sequence GROUP BY usr"


@query
def srt_anchors(d):
    """The twenty most listened items with their nearest five, and the distinct items to look up for them."""
    near = "SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM knn_graph"
    return f"SELECT DISTINCT v.item, v.item_id FROM vocab_train AS v JOIN (SELECT item FROM vocab_train WHERE item_id < 20 UNION SELECT n.b AS item FROM ({near}) AS n JOIN vocab_train AS t ON t.item = n.a WHERE t.item_id < 20 AND n.k <= 5) AS w ON w.item = v.item"
