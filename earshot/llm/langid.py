"""Operator 7: language by compression with per-language dictionaries.

Each language's dictionary is raw content: the whole texts of a bounded sample of its labelled rows. A text, in pieces short enough
that a compressor can't learn the language from the piece itself, is compressed with every dictionary; the language of
the smallest total is predicted. Where the runner-up comes within MARGIN of it the answer is marked as rejected.

Cases: a null text or one without a letter is `und` with score 0; texts of any length are compressed whole; ties go to
the first language in code-point order; repeated rows are treated alike; an empty table gives no rows; with no labelled
row there is no language, and all are `und`; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import arrow, ship

FOLDS = 5
#: Bound of the sample: labelled rows per language, whole texts.
ROWS = 64
#: Bytes compressed at once, and the level.
PIECE, LEVEL = 2000, 9
#: Least relative gap to the runner-up.
MARGIN = 0.01

_compressors: dict[bytes, list] = {}
_MARKS = re.compile(r"[^\w\s]+|[\d_]+")


def held_out(doc_id: str = "doc_id"):
    """True where the CRC-32 of the id as text is divisible by the number of folds; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, rows: int = ROWS) -> dict[str, bytes]:
    """Raw dictionaries by language, from at most `rows` labelled rows each, chosen by a hash of the id.

    Labels are counted first; then only rows whose hash is below a language's share are read, about four times as many
    as are used, so what is shuffled is bounded however many rows a language has. The model grows with the number of
    languages, as each needs a dictionary.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    whole = 1 << 40
    # one row a language, as the model itself has, so what is broadcast is far smaller than the model
    counts = [(r["lang"], min(whole, 4 * rows * whole // r["n"])) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    shares = F.broadcast(docs.sparkSession.createDataFrame(counts, "lang string, share bigint"))
    low = F.pmod(F.xxhash64("doc_id"), F.lit(whole))
    known = labelled.where(F.col("text").isNotNull()).join(shares, "lang").where(low < F.col("share")).select("lang", "doc_id", "text")
    seeded = Window.partitionBy("lang").orderBy(low, "doc_id", "text")
    chosen = known.withColumn("i", F.row_number().over(seeded)).where(F.col("i") <= rows).orderBy("lang", "i").collect()
    out: dict[str, list[bytes]] = {}
    for r in chosen:
        out.setdefault(r["lang"], []).append(folded(r["text"]))
    return {k: b"\n".join(v) for k, v in sorted(out.items())}


def folded(text: str) -> bytes:
    """What is compressed of a text: its words in lower case, without the marks around them."""
    return " ".join(_MARKS.sub(" ", text.lower()).split()).encode("utf-8", "replace")


def compressors(model: dict[str, bytes]) -> list:
    """A compressor per language, and the bytes that an empty piece takes."""
    key = b"\0".join(k.encode() for k in model) + b"\0" + b"\0".join(model.values())
    if key not in _compressors:
        _compressors.clear()
        made = []
        for raw in model.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _compressors[key] = made
    return _compressors[key]


def predict(text: str | None, names: list[str], packers: list) -> tuple[str, float, bool]:
    """Language, score from 0 (no gap to the runner-up) to 1, and whether it is rejected."""
    if not text or not names or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    size = [0] * len(names)
    body = folded(text)
    for i in range(0, len(body), PIECE):
        piece = body[i : i + PIECE]
        for k, packer in enumerate(packers):
            size[k] += len(packer.compress(piece))
    order = sorted(range(len(names)), key=lambda k: (size[k], k))
    best = order[0]
    if len(order) == 1:
        return names[best], 1.0, False
    gap = (size[order[1]] - size[best]) / size[order[1]]
    return names[best], min(1.0, gap / (gap + 10 * MARGIN) * 1.1) if gap > 0 else 0.0, gap < MARGIN


PREDICTED = "struct<lang_pred:string,score:double,rejected:boolean>"


def predicted(docs: DataFrame, model: dict[str, bytes], text: str = "text"):
    """A struct column of predictions; the model (ROWS texts a language) is broadcast."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        names, packers = list(shared.value), compressors(shared.value)
        rows = [predict(t.as_py(), names, packers) for t in texts]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang_pred", "score", "rejected"])

    return arrow(run, PREDICTED)(F.col(text))


def languages(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected) of the contract."""
    rows = docs.select("doc_id", "text", "lang")
    out = rows.select("doc_id", held_out().alias("held_out"), predicted(rows, learn(rows)).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
