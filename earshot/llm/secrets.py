"""Operator 6: secrets by fixed patterns and by a battery of randomness tests.

The patterns (assign, access, hex) give base spans. The battery looks at every maximal token of the base64 alphabets of
at least LEAST characters, cut where base spans are; '=' is part of a token only as padding at its end. A token of no
common alphabet, or one that isn't random as a whole, is split at '/' and '+', at '-' and '_', or at all four; the split
with the least p-value counts, times the number of splits. The encoding is inferred from the characters seen. Three tests ask
how likely a structured token (a word, an identifier, a number) would look that random: the chi-squared statistic of
alphabet uniformity against its non-central distribution under structure (so length counts), the runs of character
classes against a binomial with fewer changes, and the lag-1 serial correlation of the alphabet's positions against a
correlated series. Fisher's method joins them. A token must also pass the same tests as a random string would.

False discoveries are controlled over the whole table by Benjamini-Hochberg within length classes: candidates are
counted by (length class, bin of log p), a table of bounded size, from which each class gets its threshold.

Cases: a null or empty text has no spans; texts of any length are searched whole; ties in start are ordered by kind;
repeated rows are treated alike; an empty table gives no rows; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import arrow, cut, free_name, lean, ship

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")

#: Shortest token of the battery, and the level of false discoveries within a length class.
LEAST = 20
Q = 0.01
#: A token of this class fails if a random string looks so structured with less than this probability.
RANDOM_P = 1e-4
CLASSES = (20, 24, 32, 48, 80)
#: Bins of -log10 p: width and number; the last holds all beyond.
BIN, BINS = 0.25, 160

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:=+(?![A-Za-z0-9+/_=-]))?" % (LEAST - 2))
#: Parts between separators: no common alphabet has '/' or '+' and '-' or '_'.
PARTS = tuple(re.compile(r"[^%s]{%d,}" % (x, LEAST - 2)) for x in ("/+", "_-", "/+_-"))

#: Encodings: name, alphabet, excess of structured text over uniformity (sum p^2 * size - 1) at least.
ENCODINGS = (
    ("hex", "0123456789abcdef", 0.6),
    ("HEX", "0123456789ABCDEF", 0.6),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.8),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789", 0.8),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 1.6),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 1.6),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", 1.6),
)
SETS = tuple(frozenset(a) for _, a, _ in ENCODINGS)


def _tail(z: float) -> float:
    """P(N(0,1) <= z)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def battery(token: str) -> tuple[str, float, float]:
    """Inferred encoding, p-value of a structured token looking that random, p-value of a random one that structured."""
    body = token.rstrip("=")
    seen = set(body)
    at = next((i for i, s in enumerate(SETS) if seen <= s), None)
    n = len(body)
    if at is None or n < LEAST - 2:
        return "", 1.0, 0.0
    name, alphabet, excess = ENCODINGS[at]
    k = len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in body], float)
    # alphabet uniformity: chi-squared, by its normal approximation with and without the excess
    count = np.bincount(x.astype(int), minlength=k)
    chi = float(((count - n / k) ** 2).sum() * k / n)
    more = n * excess
    p_chi = _tail((chi - (k - 1 + more)) / math.sqrt(2 * (k - 1 + 2 * more)))
    r_chi = 1 - _tail((chi - (k - 1)) / math.sqrt(2 * (k - 1)))
    # runs of character classes: changes between neighbours, expected for random and a third of that for structure
    classes = [_kind(c) for c in body]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    share = [sum(map(lambda c, i=i: _kind(c) == i, alphabet)) / k for i in range(4)]
    change = 1 - sum(s * s for s in share)
    low = change / 3
    sd = math.sqrt((n - 1) * low * (1 - low))
    p_runs = 1 - _tail((changes - 0.5 - (n - 1) * low) / sd)
    r_runs = _tail((changes + 0.5 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
    # lag-1 serial correlation of alphabet positions: none for random, 0.4 in size for structure
    d = x - x.mean()
    var = float((d * d).sum())
    r = abs(float((d[:-1] * d[1:]).sum()) / var) if var else 1.0
    p_serial = _tail((r - 0.4) * math.sqrt(n) / 0.84)
    r_serial = 2 * (1 - _tail(r * math.sqrt(n)))
    fisher = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    structured = math.exp(-fisher) * (1 + fisher + fisher * fisher / 2)
    return name, structured, min(r_chi, r_runs, r_serial)


def bin_of(p: float) -> int:
    """The bin of a p-value: the least whose bound 10^(-BIN * bin) is not below p, so bins never flatter it."""
    return min(BINS - 1, int(-math.log10(max(p, 1e-300)) / BIN))


def class_of(length: int) -> int:
    return sum(length >= c for c in CLASSES) - 1


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower() if text.isascii() else text.translate(_LOWER)
        if any(k in low for k in KEYWORDS):
            out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


def tested(token: str, at: int) -> list[tuple[int, int, int, int]]:
    """Candidates (start, end, length class, bin of p) of a token that starts at a place, or of its parts."""
    if len(token) < LEAST:
        return []
    name, structured, random = battery(token)
    if name and random >= RANDOM_P:
        return [(at, at + len(token), class_of(len(token)), bin_of(structured))]
    best, least = [], 2.0
    for parts in PARTS:
        found = [(m, *battery(m[0])) for m in parts.finditer(token) if LEAST <= len(m[0]) < len(token)]
        p = min((s if r >= RANDOM_P else 1.0 for _, _, s, r in found), default=2.0)
        if p < least:
            best, least = found, p
    if not best:
        return [(at, at + len(token), class_of(len(token)), 0)]
    return [(at + m.start(), at + m.end(), class_of(len(m[0])), bin_of(min(1.0, len(PARTS) * s)) if r >= RANDOM_P else 0) for m, _, s, r in best]


def union(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The places that spans cover, as disjoint spans in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and candidates of the battery: (start, end, length class, bin of p)."""
    if not text:
        return [], []
    spans = base_spans(text)
    tests = []
    if max(map(len, text.split()), default=0) >= LEAST:
        spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
        # base spans and tokens are both in order of their starts, so one sweep pairs them
        taken, k = union((s, e) for s, _, e, _ in spans), 0
        for m in TOKEN.finditer(text):
            at = m.start()
            while k < len(taken) and taken[k][1] <= at:
                k += 1
            while k < len(taken) and taken[k][0] < m.end():
                tests += tested(text[at : taken[k][0]], at)
                at = taken[k][1]
                if at >= m.end():
                    break
                k += 1
            tests += tested(text[at : m.end()], at)
    return sorted(spans), tests


SCAN = "struct<start:array<int>,kind:array<int>,`end`:array<int>,secret:array<int>,t_start:array<int>,t_end:array<int>,t_class:array<int>,t_bin:array<int>>"
_FIELDS = ("start", "kind", "end", "secret", "t_start", "t_end", "t_class", "t_bin")


def _scanned(texts: pa.Array) -> pa.Array:
    lean()
    columns: list[list] = [[] for _ in _FIELDS]
    for t in texts:
        spans, tests = scan(t.as_py())
        for i in range(4):
            columns[i].append([s[i] for s in spans])
            columns[4 + i].append([s[i] for s in tests])
    return pa.StructArray.from_arrays([pa.array(c, pa.list_(pa.int32())) for c in columns], names=list(_FIELDS))


def thresholds(scans: DataFrame, found: str = "found", q: float = Q) -> dict[int, int]:
    """The lowest accepted bin of each length class, by Benjamini-Hochberg over all candidates of the table."""
    pairs = F.explode(F.arrays_zip(F.col(found)["t_class"].alias("c"), F.col(found)["t_bin"].alias("b")))
    counts = scans.select(pairs.alias("x")).groupBy(F.col("x.c").alias("c"), F.col("x.b").alias("b")).agg(F.count("*").alias("n")).collect()
    out = {}
    for c in range(len(CLASSES)):
        n = [0] * BINS
        for r in counts:
            if r["c"] == c:
                n[r["b"]] += r["n"]
        total, above = sum(n), 0
        for b in range(BINS - 1, 0, -1):
            above += n[b]
            if n[b] and 10 ** (-BIN * b) <= q * above / total:
                out[c] = b
    return out


def _accepted(limits: dict[int, int]):
    """SQL test of a candidate's class and bin."""
    return lambda x: F.array(*[F.lit(limits.get(c, BINS)) for c in range(len(CLASSES))])[x["t_class"]] <= x["t_bin"]


def spans_column(found: str, limits: dict[int, int]):
    """A sorted array of structs (start, kind, end, secret) of base and battery spans."""
    s = F.col(found)
    base = F.arrays_zip(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["secret"].alias("secret"))
    tests = F.arrays_zip(s["t_start"].alias("t_start"), s["t_end"].alias("t_end"), s["t_class"].alias("t_class"), s["t_bin"].alias("t_bin"))
    more = F.transform(F.filter(tests, _accepted(limits)), lambda x: F.struct(x["t_start"].alias("start"), F.lit(3).alias("kind"), x["t_end"].alias("end"), x["t_start"].alias("secret")))
    return F.array_sort(F.concat(base, more))


def secret_spans(docs: DataFrame, q: float = Q) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of the contract.

    The scan's findings, without texts, are a table in the shared folder, so each text is searched once.
    """
    ship(docs.sparkSession)
    found = cut(docs.select("doc_id", arrow(_scanned, SCAN)(F.col("text")).alias("found")), "secrets")
    spans = spans_column("found", thresholds(found, q=q))
    name = F.array(*[F.lit(k) for k in KINDS])

    def joined(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ",")

    def counted(k: int):
        return F.size(F.filter("s", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    n = [counted(k) for k in range(len(KINDS))]
    base = joined(F.filter("s", lambda x: x["kind"] < 3))
    return found.select("doc_id", spans.alias("s")).select("doc_id", *n, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def _masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, s in zip(texts, spans, strict=True):
        text = t.as_py()
        if text:
            end = len(text) + 1
            for x in sorted(s.as_py(), key=lambda x: (x["secret"], x["end"]), reverse=True):
                stop = min(x["end"], end)
                if stop > x["secret"]:
                    text = text[: x["secret"]] + MASK + text[stop:]
                    end = x["secret"]
        out.append(text)
    return pa.array(out, pa.string())


MASK = "[SECRET]"


def masked_docs(docs: DataFrame, q: float = Q) -> DataFrame:
    """docs with every secret in its text replaced by a mask; the keyword before an assigned one stays.

    Rows with what was found in them are a table in the shared folder, so each text is searched once; only texts with a
    secret are taken to Python again.
    """
    ship(docs.sparkSession)
    f, s = free_name(docs.columns, "found"), free_name(docs.columns, "spans")
    rows = cut(docs.withColumn(f, arrow(_scanned, SCAN)(F.col("text"))), "secrets")
    rows = rows.withColumn(s, spans_column(f, thresholds(rows, f, q)))
    held = F.when(F.size(s) > 0, F.col("text"))
    masked = F.when(held.isNotNull(), arrow(_masked, "string")(held, F.when(held.isNotNull(), F.col(s)))).otherwise(F.col("text"))
    return rows.withColumn("text", masked).select(*[F.col(f"`{c}`") for c in docs.columns])
