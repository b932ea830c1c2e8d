"""Operator 2: token ids in a binary file format of shuffled planes.

Ids of all documents, in ascending order of doc_id, run on through files of fixed-size blocks. A block's ids (32 bits
each) are transposed into byte planes or bit planes, each plane is compressed alone with zstandard, and the file ends
with a chunk index, a document index and their place:

    "EPL1" | plane, plane, ... | index (zstandard of JSON) | documents (zstandard of int64 ids, int64 counts) | footer

The footer is four little-endian 64-bit integers (place and size of the two indexes) and "EPL1" again. The folder's
manifest, one row per file, is what the writing job returns: a file of a failed or repeated attempt is in no manifest.

Cases: a null or empty text is the end id alone; texts of any length are encoded whole; equal doc_ids keep all their
rows, ordered by a hash of the text; null doc_ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.common import scratch, ship

MAGIC = b"EPL1"
BLOCK = 1 << 16
END_ID = 2
#: Bytes of text for a file, and most files (they grow beyond that).
FILE, MOST_FILES = 1 << 27, 100_000
LEVEL = 3
#: Distinct chunks whose ids a Python worker remembers; then it forgets the older half.
CACHE = 2_000_000

_encoders: dict[str, "Encoder"] = {}
_ENDS_IN_SPACE = "[ \\t\\n\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]$"
#: Stands between chunks; texts that hold it take the slower way.
MARK = "\U0010ffff"
#: Some of the characters that the split pattern takes for letters.
_LETTERS = "\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}"
_ODD_TEXT = "  | \n|\n |\n\n|^ | $|[\\t\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


class Encoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library.

    With byte-level pre-splitting no match crosses the place before a single space between two non-space characters,
    so the library encodes each distinct chunk between such places once and its ids are joined. A tokenizer of any
    other kind gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_chunk = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer")
        self.names, self.flat, self.length = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.empty(0, np.int64)
        vocabulary = self.tokenizer.get_vocab()
        # byte-level tokens are spelt with one character per byte
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each text has."""
        if not self.by_chunk:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.empty(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)
        codes, counts, names = coded(texts)
        if len(self.names) > CACHE:
            half = len(self.names) // 2
            self.names, self.flat, self.length = self.names[half:], self.flat[int(self.length[:half].sum()) :], self.length[half:]
        self.learn(names.filter(pc.is_null(pc.index_in(names, self.names))))
        place = pc.index_in(names, self.names).to_numpy()
        return gather(self.flat, self.length, place[codes], counts)

    def learn(self, new: pa.Array) -> None:
        """Remembers the ids of distinct chunks.

        Chunks that begin with a space and end in no white space are again cut where one text of them all is, so
        the library encodes them as texts of many chunks, and the tokens' widths tell where each chunk ends.
        """
        joins = pc.and_(pc.starts_with(new, " "), pc.invert(pc.match_substring_regex(new, _ENDS_IN_SPACE)))
        joined, rest = new.filter(joins), new.filter(pc.invert(joins))
        flat, length = [self.flat], [self.length]
        for i in range(0, len(joined), 4096):
            part = joined[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part.to_pylist())], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(pc.binary_length(part).to_numpy())
            at = np.searchsorted(np.cumsum(self.width[ids]), ends, side="left") + 1
            flat.append(ids)
            length.append(np.diff(at, prepend=0))
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(rest.to_pylist(), add_special_tokens=False)]
        self.names = pa.concat_arrays([self.names, joined, rest])
        self.flat = np.concatenate([*flat, *found])
        self.length = np.concatenate([*length, np.array([len(x) for x in found], np.int64)])


def chunks(text: str) -> list[str]:
    """The text cut before every space that stands between two characters that are no white space."""
    first, *rest = text.split(" ")
    out = [first]
    for part in rest:
        before = out[-1]
        if part and not part[0].isspace() and before and not before[-1].isspace():
            out.append(" " + part)
        else:
            out[-1] = before + " " + part
    return out


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The chunks of all texts on end, as places in a list of distinct ones; how many each text has; and that list.

    All in Arrow's own code, but for texts with unusual white space.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        parts = pa.array([chunks(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
    else:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", MARK + "\n" + MARK)
        # a full stop or comma between a letter or digit and a cut is a match of its own
        marked = pc.replace_substring_regex(marked, f"([0-9A-Za-z{_LETTERS}])([.,])({MARK}|$)", f"\\1{MARK}\\2\\3")
        odd = pc.match_substring_regex(texts, _ODD_TEXT)
        if pc.any(odd).as_py():
            marked = pc.replace_with_mask(marked, odd, pa.array([MARK.join(chunks(t)) for t in texts.filter(odd).to_pylist()], pa.large_string()))
        parts = pc.split_pattern(marked, MARK)
    flat = parts.flatten().dictionary_encode()
    return flat.indices.to_numpy(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary


def gather(flat: np.ndarray, length: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins pieces of flat (one of each length after another) in the order of codes, and sums lengths by counts."""
    first = np.cumsum(length) - length
    n = length[codes]
    ends = np.cumsum(n)
    place = np.repeat(first[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    upto = np.concatenate([[0], ends])[np.cumsum(counts)] if len(counts) else np.empty(0, np.int64)
    return flat[place], np.diff(upto, prepend=0)


def slices(texts: pa.Array, size: int = 16_000_000) -> Iterator[tuple[int, int]]:
    """Places (start, end) that cut an array into runs of about so many bytes of text."""
    if not len(texts):
        return
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    ends = [*(np.flatnonzero(np.diff(held)) + 1).tolist(), len(texts)]
    start = 0
    for end in ends:
        yield start, end
        start = end


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block: byte planes, or bit planes of 8 ids a byte, least significant first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, k].tobytes() for k in range(4)]
    one = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(one[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a block from its planes."""
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    one = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(one, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.held, self.index = len(MAGIC), bytearray(), []
        self.docs: list[int] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, doc: int, ids: bytes) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids) // 4)
        self.held += ids
        size = 4 * self.block
        if len(self.held) >= size:
            whole = len(self.held) // size * size
            for i in range(0, whole, size):
                self._block(bytes(self.held[i : i + size]))
            del self.held[:whole]

    def _block(self, ids: bytes) -> None:
        planes = [self.zip.compress(p) for p in to_planes(np.frombuffer(ids, "<u4"), self.bits)]
        self.index.append([self.at, len(ids) // 4, [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        if self.held:
            self._block(bytes(self.held))
        index = self.zip.compress(json.dumps({"bits": self.bits, "chunks": self.index}).encode())
        docs = self.zip.compress(np.array([self.docs, self.counts], "<i8").tobytes())
        self.out.write(index + docs + struct.pack("<4Q", self.at, len(index), self.at + len(index), len(docs)) + MAGIC)
        return len(self.docs), sum(self.counts)


def read(stream, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc, place of its first id in the file, ids) of each document, block by block."""
    stream.seek(size - 36)
    tail = stream.read(36)
    if tail[32:] != MAGIC:
        raise ValueError("not a file of token planes")
    at, n, docs_at, docs_n = struct.unpack("<4Q", tail[:32])
    unzip = zstandard.ZstdDecompressor()
    stream.seek(at)
    index = json.loads(unzip.decompress(stream.read(n)))
    stream.seek(docs_at)
    docs, counts = np.frombuffer(unzip.decompress(stream.read(docs_n)), "<i8").reshape(2, -1)
    blocks = iter(index["chunks"])
    held, start = np.empty(0, "<u4"), 0
    for doc, count in zip(docs.tolist(), counts.tolist(), strict=True):
        parts = [held[:count]]
        held = held[count:]
        need = count - len(parts[0])
        while need:
            where, ids, sizes = next(blocks)
            stream.seek(where)
            data = stream.read(sum(sizes))
            planes, k = [], 0
            for s in sizes:
                planes.append(unzip.decompress(data[k : k + s], max_output_size=8 * BLOCK))
                k += s
            block = from_planes(planes, ids, index["bits"])
            parts.append(block[:need])
            held = block[len(parts[-1]) :]
            need -= len(parts[-1])
        yield doc, start, parts[0] if len(parts) == 1 else np.concatenate(parts)
        start += count


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, bits: bool = False, end_id: int | None = END_ID, partitions: int | None = None) -> list[dict]:
    """Encodes docs (doc_id, text) into files in a folder that all executors share; the manifest in document order.

    One row per file, so the driver holds as many rows as the job has output partitions.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_FILES, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE)))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = path = None
        first = first_hash = None
        for batch in batches:
            for begin, upto in slices(batch.column(1)):
                part = batch.slice(begin, upto - begin)
                if writer is None:
                    system, base = _files(folder)
                    system.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.epl"
                    out = system.open_output_stream(path)
                    writer = Writer(out, bits)
                    first, first_hash = part.column(0)[0].as_py(), part.column(2)[0].as_py()
                ids, counts = encoder(tokenizer).encode(part.column(1))
                raw, at = ids.tobytes(), 0
                for doc, n_ids in zip(part.column(0).to_pylist(), (4 * counts).tolist(), strict=True):
                    writer.add(NULL_DOC if doc is None else doc, raw[at : at + n_ids] + end)
                    at += n_ids
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            size = _files(folder)[0].get_file_info(path).size
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "first": pa.array([first], pa.int64()), "first_hash": [first_hash], "n_docs": [n_docs], "n_ids": [n_ids]})

    # many rows of one doc_id (as of null) are dealt by their texts' hashes too
    order = (F.col("doc_id").asc_nulls_first(), "h", "text")
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h")).repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    rows = ordered.mapInArrow(write, "path string, size bigint, first bigint, first_hash bigint, n_docs bigint, n_ids bigint").collect()
    out, start = [], 0
    for r in sorted((r.asDict() for r in rows), key=lambda r: (r["first"] is not None, r["first"] or 0, r["first_hash"])):
        out.append(r | {"start": start})
        start += r["n_ids"]
    return out


#: Stands for a null doc_id in a file.
NULL_DOC = -(1 << 63)

READ_TYPE = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _scan(spark: SparkSession, manifest: list[dict], folder: str, schema: str, make) -> DataFrame:
    ship(spark)
    rows = [(r["path"], r["size"], r["start"]) for r in manifest]
    files = spark.createDataFrame(rows, "path string, size bigint, start bigint").repartition(max(1, len(rows)), "path")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, _ = _files(folder)
                with system.open_input_file(r["path"]) as f:
                    yield from make(read(f, r["size"]), r["start"])

    return files.mapInArrow(scan, schema)


def read_ids(spark: SparkSession, manifest: list[dict], folder: str) -> DataFrame:
    """Rows (doc_id, start, ids) of the files of a manifest, one task per file."""

    def make(docs, base):
        for doc, start, ids in docs:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None if doc == NULL_DOC else doc], pa.int64()), "start": [base + start], "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})

    return _scan(spark, manifest, folder, "doc_id bigint, start bigint, ids array<bigint>", make)


def read_digests(spark: SparkSession, manifest: list[dict], folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) computed from the ids in the files."""

    def make(docs, base):
        rows: list[tuple] = []
        for doc, start, ids in docs:
            rows.append((None if doc == NULL_DOC else doc, base + start, len(ids), zlib.crc32(ids.tobytes())))
            if len(rows) == 4096:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    return _scan(spark, manifest, folder, READ_TYPE, make)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str, bits: bool = False) -> DataFrame:
    """Writes the ids of docs to files in the shared folder and returns the digests read back from them."""
    spark = docs.sparkSession
    folder = scratch(spark, "ids")
    manifest = write_ids(docs, folder, tokenizer, bits)
    return read_digests(spark, manifest, folder)
