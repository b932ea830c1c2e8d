"""Vector search and product quantization over item embeddings.

Codebooks, a table (subspace, code, centroid) of bounded size, are fitted by Lloyd's iterations over at most SAMPLE rows
in the order of a hash; an iteration is one job that sums by code within each task, so the driver holds only centroids.
A code that no part is nearest to is seeded anew with the next row of that order. All embeddings are coded. Sums and
distances are rounded, so every engine has the same. Searches take every row whose id is divisible by EACH as a query,
against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import grid
from earshot.operators.profile import recommended, repeat_vectors, taste_of
from earshot.operators.scorers import DIM
from earshot.plans.catalog import BUILT, built, frame, kept, query, table
from earshot.plans.scratch import discard, ship, written

#: Codes of a subspace, iterations, rows that codebooks are fitted on; and the subspaces (8 or 16).
CODES, ITERATIONS, SAMPLE = 256, 15, 200_000
SUBSPACES = 8
WIDTH = DIM // SUBSPACES
#: Nearest rows that a search lists, what divides the ids of queries, and the candidates that are compared exactly.
NEAREST, EACH, CANDIDATES = 100, 100, 400


@kept
def raw_vectors(d):
    return f"SELECT CAST(vec_id AS INT) AS item, {d.scale('embedding')} AS v FROM embeddings"


@frame
def query_vectors(d):
    return f"SELECT CAST(item AS BIGINT) AS usr, v FROM raw_vectors WHERE {d.mod('item', EACH)} = 0"


def nearest_codes(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance of each row's nearest centroid, the first one at ties."""
    dist = np.round((x * x).sum(axis=1)[:, None] - 2.0 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :], 12)
    code = dist.argmin(axis=1)
    return code, dist[np.arange(len(x)), code]


def parts_of(x: np.ndarray, subspaces: int) -> list[np.ndarray]:
    return np.split(x, subspaces, axis=1)


def fitted(rows: DataFrame, subspaces: int = SUBSPACES, codes: int = CODES, iterations: int = ITERATIONS, sample: int = SAMPLE) -> np.ndarray:
    """Centroids (subspace, code, dimension) fitted on rows (item, v)."""
    ship(rows.sparkSession)
    order = F.pmod(F.col("item") * 7919, F.lit(1000003))
    chosen = written(rows.orderBy(order, "item").limit(sample).select("v", F.monotonically_increasing_id().alias("at")), "sample")
    n = chosen.count()
    if not n:
        return np.empty((subspaces, 0, 0))
    # places in the order, from 0, by the partitions that the sort left
    starts = np.array(sorted(r["at"] for r in chosen.groupBy(F.shiftright("at", 33)).agg(F.min("at").alias("at")).collect()))
    counts = {r["p"]: r["n"] for r in chosen.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    offset, before = {}, 0
    for s in starts.tolist():
        offset[s >> 33], before = before - s, before + counts[s >> 33]

    def at_places(places: list[int]) -> dict[int, np.ndarray]:
        ids = {}
        for p in places:
            part = max((q for q in offset if p >= offset[q] + (q << 33)), key=lambda q: offset[q] + (q << 33))
            ids[p - offset[part]] = p
        found = chosen.where(F.col("at").isin(list(ids))).collect() if ids else []
        return {ids[r["at"]]: np.array(r["v"]) for r in found}

    codes = min(codes, n)
    first = at_places(list(range(codes)))
    centroids = np.stack([np.stack(parts_of(first[c][None, :], subspaces))[:, 0] for c in range(codes)], axis=1)
    spark = rows.sparkSession
    for step in range(iterations):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, count = np.zeros(c.shape), np.zeros(c.shape[:2], np.int64)
            for batch in batches:
                for s, x in enumerate(parts_of(grid.matrix(batch.column(0)), subspaces) if batch.num_rows else []):
                    code, _ = nearest_codes(x, c[s])
                    np.add.at(total[s], code, x)
                    count[s] += np.bincount(code, minlength=c.shape[1])
            s, k = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(k), pa.array(count[s, k]), pa.array(list(total[s, k]), pa.list_(pa.float64()))], names=["s", "k", "n", "x"])

        found = chosen.select("v").mapInArrow(sums, "s bigint, k bigint, n bigint, x array<double>").collect()
        total, count = np.zeros(centroids.shape), np.zeros(centroids.shape[:2], np.int64)
        for r in found:
            total[r["s"], r["k"]] += r["x"]
            count[r["s"], r["k"]] += r["n"]
        centroids = np.round(total / np.maximum(count, 1)[:, :, None], 12)
        empty = np.argwhere(count == 0)
        seeds = at_places(sorted({(step * codes + int(k)) % n for _, k in empty}))
        for s, k in empty:
            centroids[s, k] = parts_of(seeds[(step * codes + int(k)) % n][None, :], subspaces)[s][0]
    discard(chosen)
    return centroids


@built("embeddings")
def codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (subspace, code, centroid)."""
    c = fitted(table(spark, sf_dir, "raw_vectors"))
    rows = [(s, k, c[s, k].tolist()) for s in range(c.shape[0]) for k in range(c.shape[1])]
    return spark.createDataFrame(rows, "subspace int, code int, centroid array<double>")


def book(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The centroids as one array: bounded, as their number is."""
    rows = table(spark, sf_dir, "codebooks").orderBy("subspace", "code").collect()
    return np.array([r["centroid"] for r in rows]).reshape(SUBSPACES, -1, WIDTH)


@built("embeddings")
def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (item, codes, dist): the codes of all embeddings, a byte per subspace, and their squared distances."""
    ship(spark)
    shared = spark.sparkContext.broadcast(book(spark, sf_dir))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = [nearest_codes(x, shared.value[s]) for s, x in enumerate(parts_of(grid.matrix(batch.column(1)), SUBSPACES))]
                codes, dist = (np.stack([b[i] for b in both], axis=1) for i in range(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.astype(np.uint8).tobytes() for c in codes], pa.binary()), pa.array(list(dist), pa.list_(pa.float64()))], names=["item", "codes", "dist"])

    return table(spark, sf_dir, "raw_vectors").mapInArrow(code, "item int, codes binary, dist array<double>")


@query
def pq_codebooks(d):
    return "SELECT subspace, code, CAST(p AS INT) AS pos, round(x, 9) AS x FROM codebooks LATERAL VIEW posexplode(centroid) AS p, x"


@frame
def pq_codes(d):
    """One row per item and subspace."""
    return f"SELECT c.item, s.s AS subspace, CAST(conv(hex(substr(c.codes, s.s + 1, 1)), 16, 10) AS INT) AS code, c.dist[s.s] AS dist FROM coded AS c JOIN ({d.range_rows('s', SUBSPACES)}) AS s ON 1 = 1"


@query
def pq_encode(d):
    return "SELECT item, subspace, code FROM pq_codes"


@frame
def decoded(d):
    return "SELECT c.item, c.subspace, c.code, b.centroid FROM pq_codes AS c JOIN codebooks AS b ON c.subspace = b.subspace AND c.code = b.code"


@query
def pq_decode(d):
    return f"SELECT item, subspace * {WIDTH} + CAST(p AS INT) AS dim, round(x, 9) AS x FROM decoded LATERAL VIEW posexplode(centroid) AS p, x"


@query
def pq_norms(d):
    return f"SELECT item, round(sqrt(sum({d.dot('centroid', 'centroid')})), 9) AS norm FROM decoded GROUP BY item"


@query
def pq_mse(d):
    return f"SELECT round(sum(greatest(dist, 0e0)) / (count(*) / {SUBSPACES}e0 * {DIM}), 9) AS mse, round({DIM} * 4e0 / {SUBSPACES}, 2) AS compression FROM pq_codes"


def adc_kernel(centroids: np.ndarray, k: int, by_norm: bool):
    """The best items of each query by asymmetric distances: sums over a table of subspaces x codes per query."""
    squares = (centroids * centroids).sum(axis=2)

    def kernel(u: pa.Table, i: pa.Table) -> pa.RecordBatch:
        q, codes = grid.matrix(u.column("v")), np.frombuffer(b"".join(i.column("codes").to_pylist()), np.uint8).reshape(len(i), -1)
        s = np.zeros((len(q), len(codes)))
        norm = np.zeros(len(codes))
        for j, x in enumerate(parts_of(q, len(centroids))):
            s += (x @ centroids[j].T)[:, codes[:, j]]
            norm += squares[j][codes[:, j]]
        if by_norm:
            s = s / (np.sqrt(norm)[None, :] * np.sqrt((q * q).sum(axis=1))[:, None] + 1e-12)
        s = np.round(s, 9) + 0.0
        row, col = grid.best(s, k)
        usr, item = u.column("usr").to_numpy(), i.column("item").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(usr[row], pa.int64()), pa.array(item[col], pa.int32()), pa.array(s[row, col])], names=["usr", "item", "score"])

    return kernel


def adc_lists(k: int, by_norm: bool = False):
    """What builds each query's k best items by their codes."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        kernel = adc_kernel(book(spark, sf_dir), k, by_norm)
        return grid.listed(grid.cells(table(spark, sf_dir, "query_vectors"), table(spark, sf_dir, "coded").select("item", "codes"), kernel, "usr bigint, item int, score double"), k)

    return build, ("embeddings",)


BUILT["adc"] = adc_lists(CANDIDATES)
BUILT["pq_cosines"] = adc_lists(NEAREST, by_norm=True)


@built("embeddings")
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's nearest items, one more than a search lists, as the query may be among them."""
    return grid.top_scores(table(spark, sf_dir, "query_vectors"), table(spark, sf_dir, "raw_vectors"), NEAREST + 1)


def top(source: str, where: str = "1 = 1", k: int = NEAREST) -> str:
    return f"SELECT query_id, item, score, rnk FROM (SELECT CAST(usr AS INT) AS query_id, item, score, row_number() OVER (PARTITION BY usr ORDER BY score DESC, item) AS rnk FROM {source} WHERE {where}) AS x WHERE rnk <= {k}"


@query
def pq_adc_dot(d):
    return top("adc")


@query
def pq_cosine(d):
    """Dot products by codes over both norms."""
    return top("pq_cosines")


@query
def vec_exact_topk(d):
    return top("exact")


@query
def vec_neighbors(d):
    return top("exact", "usr <> item")


@query
def pq_ann_recall(d):
    return f"SELECT round(1e0 * count(*) / (SELECT count(*) FROM ({top('exact')}) AS t), 6) AS recall FROM ({top('exact')}) AS a JOIN ({top('adc')}) AS b ON a.query_id = b.query_id AND a.item = b.item"


@query
def pq_reranked_recall(d):
    """Recall of the nearest after the best candidates by codes are compared exactly."""
    again = f"SELECT a.usr, a.item, round({d.dot('q.v', 'r.v')}, 9) AS score FROM adc AS a JOIN query_vectors AS q ON q.usr = a.usr JOIN raw_vectors AS r ON r.item = a.item"
    return f"SELECT round(1e0 * count(*) / (SELECT count(*) FROM ({top('exact')}) AS t), 6) AS recall FROM ({top('exact')}) AS a JOIN ({top(f'({again}) AS g')}) AS b ON a.query_id = b.query_id AND a.item = b.item"


@query
def vec_normalise(d):
    return "SELECT item, CAST(p AS INT) AS pos, round(x, 9) AS x FROM raw_vectors LATERAL VIEW posexplode(v) AS p, x"


@query
def agg_same_brand_rate(d):
    """Nearest ten items of the same brand, for those that have one."""
    return f"SELECT round(avg(CASE WHEN a.p_brand = b.p_brand THEN 1e0 ELSE 0e0 END), 6) AS rate, count(*) AS n FROM ({top('exact', 'usr <> item', 10)}) AS t JOIN part AS a ON a.p_partkey = t.query_id JOIN part AS b ON b.p_partkey = t.item"


@frame
def decoded_vectors(d):
    return f"SELECT item, flatten({d.collect('centroid', 'subspace')}) AS v FROM decoded GROUP BY item"


#: The taste of each user from decoded vectors.
BUILT["taste_by_codes"] = taste_of("decoded_vectors")


@kept
def user_vectors_by_codes(d):
    return repeat_vectors(d, "taste_by_codes")


@frame
def item_codes(d):
    return "SELECT item, codes FROM coded"


def decoding(spark: SparkSession, sf_dir: str):
    """What makes decoded vectors of length one of a block of codes, so that codes are sent and not vectors."""
    c = book(spark, sf_dir)

    def opened(rows: pa.Scalar) -> pa.Table:
        t = grid.read(rows)
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(t), -1)
        x = np.concatenate([c[s][codes[:, s]] for s in range(len(c))], axis=1)
        # summed one by one, as SQL does
        return grid.opened_as(t, x / (np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1:]) + 1e-12))

    return opened


BUILT["recommended_pq"] = recommended("user_vectors_by_codes", "item_codes", False, True, decoding)


@query
def srv_recommend_pq(d):
    """The hybrid ranking from codes alone."""
    return "SELECT usr, item, score FROM recommended_pq"
