"""Operator 1: quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one failure bit per rule; versioned
policies are masks over the bits, and ablations are bitwise aggregates over the (few) distinct bit patterns.

Cases: a null or empty text has zero words, fails the word-count rule and is never kept; texts of any length are
measured whole; repeated rows are measured alike; an empty table gives an empty ledger; the input's other columns,
whatever their names, are not touched by `measure` and `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import arrow, free_name, lean, ship

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")
MEASURE_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"

#: The rules in the order of their bits: name and SQL condition of failure over the measurements. Integers only, so any
#: engine evaluates them alike. New rules go to the end; a bit's meaning never changes.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "2 * n_upper > n_letters"),
    ("many_bangs", "2 * n_bangs > n_words"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 15 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_words"]

#: Versioned policies: the bits that reject a document.
POLICIES = {
    "base.v1": BASE_MASK,
    "web.v1": sum(BIT.values()),
    "lenient.v1": BASE_MASK | BIT["many_symbols"],
}
POLICY = "web.v1"


def repeated(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of so many words found twice or more in the list, the first one included."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    base = len(seen)
    key = ids[: n - size + 1]
    for k in range(1, size):
        if base and key.size and int(key.max()) >= (1 << 62) // max(base, 1):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * base + ids[k : n - size + 1 + k]
    order = np.argsort(key, kind="stable")
    run = key[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - size + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(size):
        cover[k : n - size + 1 + k] |= twice
    return int(cover.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(count[:128].sum() + count[192:].sum())
    lines = raw.split(b"\n")
    held = [x for x in lines if x and not x.isspace()]
    return (
        len(words),
        points - int(sum(count[b] for b in SPACES)),
        int(sum(count[b] for b in SYMBOLS)),
        len(held) - len(set(held)),
        repeated(words),
        len(held),
        int(count[65:91].sum()),
        int(count[65:91].sum() + count[97:123].sum()),
        int(count[33]),
    )


def _measured(texts: pa.Array) -> pa.Array:
    lean()
    rows = [measure_text(t.as_py()) for t in texts]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def fail_bits(measure: str) -> Column:
    """The failure bits of all rules, from a struct column of measurements."""
    bits = F.lit(0).cast("bigint")
    for i, (_, rule) in enumerate(RULES):
        for m in MEASURES:
            rule = " ".join(f"`{measure}`.{m}" if x == m else x for x in rule.split(" "))
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def ledger(df: DataFrame, text: str = "text", measure: str = "measure", bits: str = "fail_bits") -> DataFrame:
    """df with a struct of measurements and the failure bits of every rule."""
    ship(df.sparkSession)
    return df.withColumn(measure, arrow(_measured, MEASURE_TYPE)(F.col(text))).withColumn(bits, fail_bits(measure))


def passes(bits: str, policy: str = POLICY) -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def keep(df: DataFrame, text: str = "text", policy: str = POLICY) -> DataFrame:
    """The rows of df whose text passes the policy, with df's own columns."""
    m, b = free_name(df.columns, "measure"), free_name(df.columns, "fail_bits")
    return ledger(df, text, m, b).where(passes(b, policy)).select(*[F.col(f"`{c}`") for c in df.columns])


def ablations(ledger_df: DataFrame, bits: str = "fail_bits", policy: str = POLICY) -> DataFrame:
    """Per rule of the policy: rows that fail it, that only it rejects, and that would be kept without it.

    Rows are first counted by bit pattern (at most 2^rules rows, map-side), then the patterns alone are compared.
    """
    mask = POLICIES[policy]
    patterns = ledger_df.groupBy(bits).agg(F.count("*").alias("n"))
    names = [n for n in BIT if BIT[n] & mask]
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("bigint").alias("bit")) for n in names]))
    x = patterns.select(F.col(bits).bitwiseAND(F.lit(mask)).alias("failed"), "n", rules.alias("r"))
    left = F.col("failed").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("r.bit")))
    zero = F.lit(0).cast("bigint")
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(zero)).alias("n_only"),
        F.sum(F.when(F.col("failed") == 0, F.col("n")).otherwise(zero)).alias("n_kept"),
        F.sum(F.when(left == 0, F.col("n")).otherwise(zero)).alias("n_kept_without"),
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, the base measurements, base_failed, kept, fail_bits, ...) of the contract."""
    led = ledger(docs.select("doc_id", "text"))
    return led.select(
        "doc_id",
        *[F.col(f"measure.{m}").alias(m) for m in MEASURES],
        F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)).cast("bigint").alias("base_bits"),
        "fail_bits",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"),
        passes("fail_bits").alias("kept"),
    )


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), tri AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1
), cover AS (
  SELECT r, count(DISTINCT i) AS n FROM (
    SELECT r, i FROM twice UNION ALL SELECT r, i + 1 FROM twice UNION ALL SELECT r, i + 2 FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs
  FROM w LEFT JOIN cover USING (r)
), b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, {", ".join(MEASURES)}, CAST(fail_bits & {BASE_MASK} AS BIGINT) AS base_bits, fail_bits,
       (fail_bits & {BASE_MASK}) <> 0 AS base_failed, (fail_bits & {POLICIES[POLICY]}) = 0 AS kept
FROM b
"""
