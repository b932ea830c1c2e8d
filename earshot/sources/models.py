"""Model files, input discovery, manifests and downloads."""

from __future__ import annotations

import hashlib
import io
import json
import os
import struct
import urllib.request
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.plans.scratch import ship

#: Bytes of a file that a task reads at a time.
CHUNK = 1 << 23


def opened(path: str) -> pa.NativeFile:
    """A file of any store that pyarrow knows, for reading at any place."""
    system, inner = pafs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())
    return system.open_input_file(inner)


def npy_header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and first byte of the values of a .npy file; values by columns are refused."""
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran:
        raise ValueError("values stand by columns")
    return shape, kind, f.tell()


def read_matrix(spark: SparkSession, path: str, n_items: int | None = None) -> DataFrame:
    """Rows (item, embedding) of a .npy matrix whose row number is the item, read by tasks, a range of rows each.

    Not two-dimensional, not floating, or not of n_items rows (where that is given) is an error.
    """
    ship(spark)
    with opened(path) as f:
        shape, kind, start = npy_header(f)
    if len(shape) != 2 or kind.kind != "f":
        raise ValueError(f"not a matrix of floats: {shape} {kind}")
    if n_items is not None and shape[0] != n_items:
        raise ValueError(f"{shape[0]} rows, expected {n_items}")
    rows, width = shape
    each = max(1, CHUNK // max(1, width * kind.itemsize))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as f:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    n = min(each, rows - k * each)
                    f.seek(start + k * each * width * kind.itemsize)
                    m = np.frombuffer(f.read(n * width * kind.itemsize), kind).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(m))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * each, k * each + n, dtype=np.int32)), lists], names=["item", "embedding"])

    return spark.range(-(-rows // each)).mapInArrow(read, "item int, embedding array<float>")


def write_matrix(vectors: DataFrame, path: str, item: str = "item", embedding: str = "embedding") -> None:
    """A .npy matrix of rows (item, embedding) in the order of the items, streamed partition by partition."""
    n, width = vectors.agg(F.count("*"), F.max(F.size(embedding))).first()
    system, inner = pafs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (n, width or 0)})
    with system.open_output_stream(inner) as out:
        out.write(head.getvalue())
        for r in vectors.orderBy(item).select(embedding).toLocalIterator():
            out.write(np.asarray(r[0], "<f4").tobytes())


def quantized_norms(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Norm of each decoded vector, from the squares of the centroids."""
    squares = (books.astype(float) ** 2).sum(axis=2)
    return np.sqrt(squares[np.arange(books.shape[0])[None, :], codes].sum(axis=1))


def read_quantized(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(item, codes, norm) and (subspace, code, centroid) of a .npz model; an item is its row's number if the file has no ids."""
    with opened(path) as f:
        z = np.load(io.BytesIO(f.read()))
        codes, books = z["codes"], z["centroids"] if "centroids" in z else z["codebooks"]
        items = z["item_ids"] if "item_ids" in z else np.arange(len(codes))
    if codes.shape[1] != books.shape[0]:
        raise ValueError(f"{codes.shape[1]} codes a row, {books.shape[0]} codebooks")
    lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.astype(np.int16).reshape(-1)), codes.shape[1]).cast(pa.list_(pa.int16()))
    rows = pa.table({"item": pa.array(items.astype(np.int32)), "codes": lists, "norm": pa.array(quantized_norms(codes, books))})
    flat = [(s, c, books[s, c].astype(float).tolist()) for s in range(books.shape[0]) for c in range(books.shape[1])]
    return spark.createDataFrame(rows), spark.createDataFrame(flat, "subspace int, code int, centroid array<double>")


def write_quantized(codes: DataFrame, books: DataFrame, path: str) -> None:
    """A .npz model of (item, subspace, code) and (subspace, code, centroid). The file is one array, so it is made in one place."""
    centres = books.orderBy("subspace", "code").collect()
    m = max((r["subspace"] for r in centres), default=-1) + 1
    c = np.array([r["centroid"] for r in centres], np.float32).reshape(m, -1, len(centres[0]["centroid"]) if centres else 0)
    wide = codes.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("subspace", "code"))), lambda x: x["code"]).alias("codes")).orderBy("item").toArrow()
    rows = np.array(wide.column("codes").to_pylist(), np.uint8).reshape(-1, m)
    held = io.BytesIO()
    np.savez(held, codes=rows, centroids=c, codebooks=c, item_ids=wide.column("item").to_numpy(), n_items=len(rows), d=c.shape[0] * c.shape[2], m=m)
    system, inner = pafs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())
    with system.open_output_stream(inner) as out:
        out.write(held.getvalue())


def read_top_items(path: str) -> list[tuple[int, int]]:
    """(item, count) of a JSON list of popular items, the most popular first."""
    with opened(path) as f:
        rows = json.loads(f.read())
    return [(int(r["item_id"]), int(r["count"])) for r in rows]


def search_dirs(variable: str = "EARSHOT_MODELS", default: str = "models") -> list[Path]:
    """Folders that models are looked for in: those of an environment variable, then a default one."""
    return [*[Path(p) for p in os.environ.get(variable, "").split(os.pathsep) if p], Path(default)]


def discover_model(folders: Iterable[Path]) -> tuple[str, Path] | None:
    """The first model below the folders: ('codes', a .npz with codes and centroids) before ('vectors', a .npy matrix of floats)."""
    for base in folders:
        if not base.exists():
            continue
        for f in sorted(base.rglob("*.npz")):
            try:
                with np.load(f) as z:
                    if "codes" in z and "centroids" in z:
                        return "codes", f
            except (OSError, ValueError):
                continue
        for f in sorted(base.rglob("*.npy")):
            try:
                with open(f, "rb") as g:
                    shape, kind, _ = npy_header(g)
            except (OSError, ValueError, struct.error):
                continue
            if len(shape) == 2 and kind.kind == "f":
                return "vectors", f
    return None


def find_input(folders: Iterable[Path], name: str) -> Path:
    """The one file of this name below the folders; none or several are errors."""
    found = sorted({f for base in folders if base.exists() for f in base.rglob(name)})
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files are called {name}" + "".join(f"\n{f}" for f in found))
    return found[0]


def read_md5s(text: str) -> dict[str, str]:
    """Digest by file name of a manifest: a digest and a name per line, the name perhaps after a star."""
    return {p[1].lstrip("*"): p[0] for p in map(str.split, text.splitlines()) if len(p) == 2}


def download(url: str, to: str, md5: str | None = None) -> int:
    """Copies a file and gives its bytes; another digest than expected is an error, and the copy is removed."""
    seen, n = hashlib.md5(), 0
    with urllib.request.urlopen(url, timeout=600) as source, open(to, "wb") as out:
        while block := source.read(CHUNK):
            out.write(block)
            seen.update(block)
            n += len(block)
    if md5 and seen.hexdigest() != md5:
        os.unlink(to)
        raise ValueError(f"digest {seen.hexdigest()}, expected {md5}")
    return n


def sizes_of(urls: Iterable[str]) -> dict[str, int]:
    """Bytes of each file by its address, from its header; one that can't be reached or tells no size is left out."""
    out = {}
    for url in urls:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as r:
                if (n := r.headers.get("Content-Length")) is not None:
                    out[url] = int(n)
        except OSError:
            continue
    return out


def largest_under(sizes: dict[str, int], most: int) -> str | None:
    """The name of the largest file of at most so many bytes, the first at ties."""
    fit = [(-n, name) for name, n in sizes.items() if n <= most]
    return min(fit)[1] if fit else None


def metadata(ids: Iterable[str], fetch, tries: int = 3) -> dict[str, dict]:
    """What `fetch` (an id to a dict, or an OSError) knows of each distinct id; one that fails so often is left out."""
    out = {}
    for i in sorted(set(ids)):
        for _ in range(tries):
            try:
                out[i] = fetch(i)
                break
            except OSError:
                continue
    return out


def synthetic_profile(n_items: int, span_days: int, now: int, seed: int = 42, most_plays: int = 10, first_item: int = 1000) -> list[tuple[int, int, int]]:
    """(item, n, last_seen) of a made-up listener: items in a row, plays and times drawn by the seed."""
    rng = np.random.default_rng(seed)
    plays, age = rng.integers(1, most_plays + 1, n_items), rng.uniform(0, span_days * 86400, n_items)
    return [(first_item + i, int(plays[i]), int(now - age[i])) for i in range(n_items)]
