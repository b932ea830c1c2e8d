"""Operator 5: byte-level BPE encoding and decoding.

Documents are packed into blocks of bounded text: the block's distinct words (the matches of the split pattern) and
each document as places in that list. Spark's higher-order functions then fold the ranked merges over the bytes of the
distinct words alone, with the rank file as a literal map, and the blocks are unpacked into ids per document. It is
one stage without a shuffle.

Words that occur nearly everywhere would be folded in every block. So the most frequent words of a bounded sample of
rows (HEAD words of at most LONG bytes) are folded first, by the same fold, and broadcast; blocks hold the other words.
The sample only decides what is folded once: ids don't depend on it.

A word in the fold is a string of one character per token (code point id + 256, past the surrogates), at first one per
byte. The literal maps every two-character string whose bytes form a token to that token's character, in slots by hash,
so a look-up reads one short map. Each step merges the leftmost pair of lowest rank, as the rank file defines it, and
with it all equal pairs where that gives the same: where no other pair has this rank and the new token is part of no
token of lower rank, so that nothing could come between. A step so takes a rank, not a place, and long words need few.

Words over LONG bytes are first cut where no token crosses (between two bytes that stand side by side in no token), at
which no merge can cross either; the parts are folded as all words are.

Decoding concatenates the ids' binary pieces.

Cases: a null or empty text has no ids and decodes to an empty string; texts and words of any length are encoded whole;
repeated rows are encoded alike; an empty table gives no rows; the other columns asked for, whatever their names, are
carried along.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.common import arrow, free_name, lean, ship
from earshot.llm.tokenio import _LETTERS, coded, gather, slices

SLOTS = 1 << 17
#: Words of text in a block, at which it is closed.
BLOCK_WORDS = 6_000_000
#: Bytes of carried columns, at which it is closed too, and of text that is looked at at once.
BLOCK_BYTES, TEXT_BYTES = 2_500_000, 2_000_000
#: Bytes from which on a word is cut where no token crosses, and doesn't enter the head.
LONG = 256
#: Rows of the sample, and words of the head (at most HEAD * LONG bytes, in fact some MB).
SAMPLE, HEAD = 24_000, 400_000
#: Chunks that are one word of the split pattern for certain.
_ONE_WORD = f"^( ?[A-Za-z{_LETTERS}]+| ?[0-9]+| ?[.,]+|\\n)$"


def char(i: int) -> str:
    """The character that stands for a token."""
    return chr(i + 256 if i + 256 < 0xD800 else i + 256 + 0x800)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Rank (which is the id) of each token of a rank file: base64 and number per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pairs(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """Each pair of tokens whose bytes join to a token, and that token, as characters."""
    out = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out.append((char(a) + char(b), char(rank)))
    return out


def slot(pair: Column) -> Column:
    return F.hash(pair).bitwiseAND(F.lit(SLOTS - 1))


_literals: dict[tuple[str, str], tuple[Column, Column]] = {}


def literal(spark: SparkSession, value, kind: T.DataType) -> Column:
    """A literal of any type and size."""
    from pyspark.sql.classic.column import Column as Classic

    row = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", kind)]))._jdf
    first = row.queryExecution().executedPlan().executeCollect()[0]
    jvm, of = spark._jvm, row.schema().apply(0).dataType()
    return Classic(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(first.get(0, of), of)))


def rank_literals(spark: SparkSession, path: str) -> tuple[Column, Column]:
    """The rank map as a literal array of maps, by slot; and by code point whether a token is part of one of lower rank."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _literals:
        import pandas as pd

        found = pairs(load_ranks(path))
        rows = spark.createDataFrame(pd.DataFrame(found, columns=["pair", "token"]))
        slots: list[dict | None] = [None] * SLOTS
        for pair, token, at in rows.select("pair", "token", slot(F.col("pair"))).toPandas().itertuples(index=False):
            if slots[at] is None:
                slots[at] = {}
            slots[at][pair] = token
        early = [False] * (max((ord(token) for _, token in found), default=0) + 1)
        for pair, token in found:
            for part in pair:
                # characters sort as ranks do
                if part > token:
                    early[ord(part)] = True
        _literals[key] = literal(spark, slots, T.ArrayType(T.MapType(T.StringType(), T.StringType()))), literal(spark, early, T.ArrayType(T.BooleanType()))
    return _literals[key]


def bound(x: Column, f) -> Column:
    """f of x, with x computed once: a one-element transform names it."""
    return F.transform(F.array(x), f)[0]


def fold_merges(word: Column, slots: Column, early: Column, bytes_from: str, bytes_to: str) -> Column:
    """The token characters of a binary word: a fold of the merge step over its length."""
    start = F.translate(F.decode(word, "ISO-8859-1"), bytes_from, bytes_to)
    rest, done = F.lit(1 << 30), F.lit("!")

    def step(s: Column, _: Column) -> Column:
        def merge(two: Column, found: Column) -> Column:
            # token characters sort as their ranks do; the position is the leftmost of the lowest
            def at_lowest(lowest: Column) -> Column:
                at = F.array_position(found, lowest).cast("int")
                one = F.concat(F.substring(s, F.lit(1), at - 1), lowest, F.substring(s, at + 2, rest))
                others = F.exists(F.zip_with(found, two, lambda f, p: (f == lowest) & (p != F.get(two, at - 1))), lambda x: F.coalesce(x, F.lit(False)))
                alone = F.size(F.array_remove(found, lowest)) == F.size(found) - 1
                merged = F.when(alone | F.get(early, F.ascii(lowest)) | others, one).otherwise(F.replace(s, F.get(two, at - 1), lowest))
                return F.when(lowest.isNull(), F.concat(done, s)).otherwise(merged)

            return bound(F.array_min(found), at_lowest)

        def looked_up(two: Column) -> Column:
            return bound(F.transform(two, lambda pair: F.get(slots, slot(pair))[pair]), lambda found: merge(two, found))

        # a word without a pair left is marked, so the fold's other steps pass it on
        two = bound(F.split(s, F.lit("")), lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.concat(a, b)))
        return F.when(F.startswith(s, done), s).otherwise(bound(two, looked_up))

    n = F.octet_length(word)
    return F.when(n < 2, start).otherwise(F.replace(F.aggregate(F.sequence(F.lit(2), n), start, step), done, F.lit("")))


@lru_cache(maxsize=4)
def side_by_side(path: str) -> np.ndarray:
    """For two bytes, whether they stand side by side in a token."""
    out = np.zeros((256, 256), bool)
    for token in load_ranks(path):
        b = np.frombuffer(token, np.uint8)
        out[b[:-1], b[1:]] = True
    return out


def parts(word: str, path: str) -> list[str]:
    """The word, or where it is over LONG bytes its parts between characters that no token spans."""
    raw = word.encode()
    if len(raw) <= LONG:
        return [word]
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(~side_by_side(path)[b[:-1], b[1:]] & (b[1:] & 0xC0 != 0x80)) + 1
    return [raw[i:j].decode() for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(raw)], strict=True)]


def words_of(names: pa.Array, pattern: str, path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words (or parts of long ones) of distinct chunks; and of each chunk how many it has, and their places in that list."""
    import regex

    short = pc.less_equal(pc.binary_length(names), LONG)
    one = pc.and_(short, pc.match_substring_regex(names, _ONE_WORD)).to_numpy(zero_copy_only=False)
    find = regex.compile(pattern).findall
    split = [find(c) if len(c) <= LONG // 4 else [p for w in find(c) for p in parts(w, path)] for c in names.filter(pa.array(~one)).to_pylist()]
    count = np.ones(len(names), np.int64)
    count[~one] = [len(x) for x in split]
    many = pa.array([w for x in split for w in x], pa.large_string())
    coded_words = pa.concat_arrays([names.filter(pa.array(one)), many]).dictionary_encode()
    at = coded_words.indices.to_numpy()
    places = np.empty(int(count.sum()), np.int32)
    first = np.repeat(one, count)
    places[first], places[~first] = at[: int(one.sum())], at[int(one.sum()) :]
    return coded_words.dictionary, count, places


def split_words(texts: pa.Array, pattern: str, path: str) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of texts, and how often each occurs."""
    names, seen = [], []
    for start, end in slices(texts, 5_000_000):
        codes, _, found = coded(texts.slice(start, end - start))
        names.append(found)
        seen.append(np.bincount(codes, minlength=len(found)))
    chunks = pa.concat_arrays([pa.array([], pa.large_string()), *names]).dictionary_encode()
    times = np.bincount(chunks.indices.to_numpy(), weights=np.concatenate([np.empty(0), *seen]), minlength=len(chunks.dictionary)).astype(np.int64)
    words, count, places = words_of(chunks.dictionary, pattern, path)
    return words, np.bincount(places, weights=np.repeat(times, count), minlength=len(words)).astype(np.int64)


def head_words(df: DataFrame, ranks_path: str, pattern: str, text: str, size: int = HEAD) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The most frequent words of a bounded sample of rows (an Arrow stream), their ids on end and how many each has."""
    spark = df.sparkSession
    n = df.count()
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    if n > SAMPLE:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.lit((1 << 40) * SAMPLE // n))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            words, n = split_words(batch.column(0), pattern, ranks_path)
            short = pc.less_equal(pc.binary_length(words), LONG)
            yield pa.RecordBatch.from_arrays([words.filter(short).cast(pa.string()), pa.array(n).filter(short)], names=["word", "n"])

    words = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).repartition(24)
    folded = words.select("word", _folded(spark, ranks_path, F.col("word").cast("binary")).alias("tokens")).toArrow()
    return as_stream(folded.select(["word"])), *flat_ids(folded.column("tokens").to_pylist())


def as_stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def flat_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the token characters of all words on end, and how many each has."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int32)
    flat -= np.where(flat >= 0xE000, 0x900, 0x100).astype(np.int32)
    return flat, np.fromiter(map(len, words), np.int64, len(words))


def _folded(spark: SparkSession, ranks_path: str, word: Column) -> Column:
    ranks = load_ranks(ranks_path)
    octets = [bytes([b]) for b in range(256) if bytes([b]) in ranks]
    return fold_merges(word, *rank_literals(spark, ranks_path), "".join(o.decode("latin-1") for o in octets), "".join(char(ranks[o]) for o in octets))


PACKED = "rows binary, counts binary, places binary, words array<binary>"


def _pack(path: str, pattern: str, carried: int, text_at: int, head):
    """Packs batches of the carried columns first into one row per block."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        top = pa.ipc.open_stream(head.value[0]).read_all().column(0).combine_chunks().cast(pa.large_string())
        rows: list[pa.RecordBatch] = []
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            names = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
            words, count, at = words_of(names.dictionary, pattern, path)
            # a word's place: in the head, or after it among the block's own
            known = pc.index_in(words, top)
            place = pc.fill_null(known, 0).to_numpy().astype(np.int32)
            own = known.is_null().to_numpy(zero_copy_only=False)
            place[own] = len(top) + np.arange(int(own.sum()))
            flat, of_name, counts, places, start = place[at], names.indices.to_numpy(), [], [], 0
            for codes, n, found in held:
                here, n = gather(flat, count, of_name[start : start + len(found)][codes], n)
                places.append(here)
                counts.append(n.astype(np.int32))
                start += len(found)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([as_stream(pa.Table.from_batches(rows))], pa.binary()),
                    pa.array([as_stream(pa.table({"n": np.concatenate(counts)}))], pa.binary()),
                    pa.array([as_stream(pa.table({"place": np.concatenate(places)}))], pa.binary()),
                    _one_list(words.filter(pa.array(own)).cast(pa.large_binary()).cast(pa.binary())),
                ],
                names=["rows", "counts", "places", "words"],
            )
            rows.clear()
            held.clear()
            return out

        size = room = 0
        for batch in batches:
            texts = batch.column(text_at)
            for start, end in slices(texts, TEXT_BYTES):
                held.append(coded(texts.slice(start, end - start)))
                rows.append(batch.slice(start, end - start).select(list(range(carried))))
                size += len(held[-1][0])
                room += rows[-1].nbytes
                if size >= BLOCK_WORDS or room >= BLOCK_BYTES:
                    size = room = 0
                    yield close()
        if rows:
            yield close()

    return pack


def _one_list(values: pa.Array) -> pa.Array:
    """An array of one list of these values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _unpack(head, finish):
    """Unpacks blocks with their words' token characters into what `finish` makes of (carried columns, ids)."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        _, top_flat, top_length = head.value
        for batch in batches:
            for r in range(batch.num_rows):
                table, counts, places = (pa.ipc.open_stream(batch.column(c)[r].as_buffer()).read_all() for c in ("rows", "counts", "places"))
                counts, places = (t.column(0).to_numpy() for t in (counts, places))
                flat, length = flat_ids(batch.column("tokens")[r].as_py())
                flat, length = np.concatenate([top_flat, flat]), np.concatenate([top_length, length])
                at, done, ends = 0, 0, np.cumsum(counts, dtype=np.int64)
                while done < len(counts):
                    # so many documents at once that their words stay near a quarter of a million
                    upto = done + max(1, int(np.searchsorted(ends[done:] - at, 250_000)))
                    ids, n = gather(flat, length, places[at : int(ends[upto - 1])], counts[done:upto])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
                    part = table.slice(done, upto - done).combine_chunks()
                    yield finish([c.chunk(0) for c in part.columns], lists)
                    at, done = int(ends[upto - 1]), upto

    return unpack


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", carry: tuple[str, ...] | None = None, ids: str = "ids", finish=None) -> DataFrame:
    """The columns to carry and an array of the text's token ids.

    finish: (function of lists of ids, its schema as DDL), to give columns made of the ids in place of the ids, so that
    they needn't leave the Python worker.
    """
    spark = df.sparkSession
    ship(spark)
    carry = tuple(c for c in df.columns if c != text) if carry is None else carry
    tmp = [f"c{i}" for i in range(len(carry))]
    plain = df.select(*[F.col(f"`{c}`").alias(t) for c, t in zip(carry, tmp, strict=True)], *([] if text in carry else [F.col(f"`{text}`").cast("string").alias("text")]))
    text_at = carry.index(text) if text in carry else len(carry)
    head = spark.sparkContext.broadcast(head_words(df, ranks_path, pattern, text))
    packed = plain.mapInArrow(_pack(ranks_path, pattern, len(carry), text_at, head), PACKED)
    folded = F.transform("words", lambda w: _folded(spark, ranks_path, w))
    made = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]) if finish is None else T._parse_datatype_string(finish[1])
    kind = T.StructType([*[T.StructField(t, plain.schema[t].dataType) for t in tmp], *[T.StructField(f"m{i}", f.dataType) for i, f in enumerate(made)]])

    def last(columns: list[pa.Array], lists: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, *([lists] if finish is None else finish[0](lists))], names=kind.names)

    rows = packed.select("rows", "counts", "places", folded.alias("tokens")).mapInArrow(_unpack(head, last), kind)
    return rows.select(*[F.col(t).alias(c) for c, t in zip(carry, tmp, strict=True)], *[F.col(f"m{i}").alias(f.name) for i, f in enumerate(made)])


def decode_lists(lists: pa.Array, ranks_path: str) -> list[bytes]:
    """The bytes that each list of ids stands for: its pieces joined."""
    pieces, flat, at = _pieces(ranks_path), lists.flatten().to_numpy().tolist(), 0
    out = []
    for n in pc.fill_null(pc.list_value_length(lists), 0).to_pylist():
        out.append(b"".join([pieces[i] for i in flat[at : at + n]]))
        at += n
    return out


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for."""
    ship(df.sparkSession)

    def join(column: pa.Array) -> pa.Array:
        return pa.array(decode_lists(column, ranks_path), pa.binary())

    return df.withColumn(to, arrow(join, "binary")(F.col(ids)))


@lru_cache(maxsize=4)
def _pieces(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the contract, from encoded ids and their decoding."""

    def digests(lists: pa.Array) -> list[pa.Array]:
        n = pc.list_value_length(lists).to_pylist()
        raw, at, shas = lists.flatten().to_numpy().astype("<u4").tobytes(), 0, []
        for k in n:
            shas.append(hashlib.sha256(raw[at : at + 4 * k]).hexdigest())
            at += 4 * k
        decoded = [hashlib.sha256(x).hexdigest() for x in decode_lists(lists, ranks_path)]
        return [pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]

    return encode(docs, ranks_path, pattern, carry=("doc_id",), finish=(digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def encoded_docs(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with their token ids and the number of them, in columns of names that are free."""
    ids, n = free_name(docs.columns, "ids"), free_name(docs.columns, "n_tokens")
    out = encode(docs, ranks_path, pattern, carry=tuple(docs.columns), ids=ids)
    return out.withColumn(n, F.size(ids).cast("bigint"))
