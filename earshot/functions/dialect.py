"""Expressions of Spark SQL that the queries share; frames and queries get them as their argument."""

from __future__ import annotations


class Spark:
    """Spark SQL."""

    def seconds(self, ts: str) -> str:
        return f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))"

    def json_int(self, doc: str, key: str) -> str:
        return f"CAST(get_json_object({doc}, '$.{key}') AS INT)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0e0, (s, x) -> s + x)"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p}e0)"

    def idiv(self, a: str, b: str) -> str:
        return f"CAST(({a}) DIV ({b}) AS BIGINT)"

    def year(self, s: str) -> str:
        return f"CAST(extract(YEAR FROM (TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {s}))) AS BIGINT)"

    def month(self, s: str) -> str:
        return f"date_format(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {s}), 'yyyy-MM')"

    def range_rows(self, name: str, n: int) -> str:
        return f"SELECT CAST(id AS INT) AS {name} FROM range({n})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, '{sep}')"

    def at(self, x: str, i: int) -> str:
        return f"get({x}, {i})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE '{pattern}')"

    def try_int(self, x: str) -> str:
        return f"try_cast({x} AS BIGINT)"

    def mod(self, a: str, b: int) -> str:
        return f"pmod({a}, {b})"

    def scale(self, v: str) -> str:
        """The vector divided by its norm, which a one-element transform names, so that it is computed once."""
        return f"transform(array(sqrt({self.dot(v, v)}) + 1e-8), n -> transform({v}, x -> CAST(x AS DOUBLE) / n))[0]"

    def explode(self, v: str, pos: str, val: str, frame: str, keep: str) -> str:
        return f"SELECT {keep}, CAST(p AS INT) AS {pos}, CAST(x AS DOUBLE) AS {val} FROM {frame} LATERAL VIEW posexplode({v}) AS p, x"

    def collect(self, val: str, pos: str) -> str:
        return f"transform(array_sort(collect_list(struct({pos} AS p, {val} AS x))), s -> s.x)"


SPARK = Spark()
