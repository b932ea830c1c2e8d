"""Raw archives, exports, profiles, models and the binary id index."""

from __future__ import annotations

import bisect
import io
import json
import re
import struct
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.plans.scratch import ship
from earshot.sources.models import opened


#: Bytes of text that a batch of lines holds.
TEXT = 1 << 23


def read_archive(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows (user_uuid, line_no, line) of tar files with one zstd-compressed text per user.

    One task per archive walks its headers, seeking over the contents; then members are dealt over tasks, each of which
    reads its members' bytes at their places and decompresses them as a stream. So an archive may have any size.
    """

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found: list[tuple] = []
                with opened(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(".txt.zst"):
                            found.append((path, m.name.rsplit("/", 1)[-1][: -len(".txt.zst")], m.offset_data, m.size))
                        tar.members = []
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["path", "user_uuid", "at", "size"])

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def rows(user: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"user_uuid": [user] * len(held), "line_no": pa.array([i for i, _ in held], pa.int64()), "line": pa.array([x for _, x in held], pa.string())})

        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as f:
                    f.seek(r["at"])
                    held, size = [], 0
                    part = io.BytesIO(f.read(r["size"])) if r["size"] <= TEXT else _Part(f, r["size"])
                    text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(part, read_across_frames=True), "utf-8", "replace", newline="\n")
                    for i, line in enumerate(text):
                        line = line.rstrip("\n")
                        if line.strip():
                            held.append((i, line))
                            size += len(line)
                        if size >= TEXT:
                            yield rows(r["user_uuid"], held)
                            held, size = [], 0
                    yield rows(r["user_uuid"], held)

    ship(spark)
    archives = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    found = archives.mapInArrow(members, "path string, user_uuid string, at bigint, size bigint")
    return found.repartition(F.col("path"), F.col("user_uuid")).mapInArrow(lines, "user_uuid string, line_no bigint, line string")


class _Part(io.RawIOBase):
    """The next n bytes of a file."""

    def __init__(self, f, n: int):
        self.f, self.left = f, n

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        got = self.f.read(min(len(to), self.left))
        self.left -= len(got)
        to[: len(got)] = got
        return len(got)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (user_uuid, line) of already extracted text files, the user from the file's name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt(?:\.\w+)?)?$", 1)
    return spark.read.text(path).where(F.trim("value") != "").select(name.alias("user_uuid"), F.col("value").alias("line"))


def number_users(lines: DataFrame) -> DataFrame:
    """(user_uuid, usr): users numbered from 0 in the order of their names, by ranges of names, so no task sorts them all."""
    from pyspark.sql import Window

    users = lines.select("user_uuid").distinct().withColumn("head", F.substring("user_uuid", 1, 4))
    before = users.groupBy("head").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("head")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("head").orderBy("user_uuid")) - 1
    return users.withColumn("place", place).join(before, "head").select("user_uuid", (F.col("place") + F.col("before")).cast("int").alias("usr"))


EXPORT = T.ArrayType(
    T.StructType(
        [
            T.StructField("listened_at", T.LongType()),
            T.StructField("track_metadata", T.StructType([T.StructField("additional_info", T.StructType([T.StructField("recording_mbid", T.StringType())])), T.StructField("mbid", T.StringType())])),
        ]
    )
)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows (listened_at, mbid) of a JSON export, an object with `listens` or a bare list."""
    text = spark.read.text(path, wholetext=True).select("value")
    listens = F.coalesce(F.from_json("value", T.StructType([T.StructField("listens", EXPORT)]))["listens"], F.from_json("value", EXPORT))
    meta = "x.track_metadata"
    one = F.nullif(F.col(f"{meta}.additional_info.recording_mbid"), F.lit(""))
    return text.select(F.explode(listens).alias("x")).select("x.listened_at", F.coalesce(one, F.nullif(F.col(f"{meta}.mbid"), F.lit(""))).alias("mbid"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rows (item, n, last_seen, wscore, exploration) of a JSON profile; absent weighted scores are the counts."""
    kind = "item_counts map<string,bigint>, last_seen_ts map<string,double>, weighted_scores map<string,double>, created_at double, exploration double"
    p = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("p")).select("p.*")
    exploration = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce("exploration", F.lit(0.3))))
    rows = p.select(F.explode("item_counts").alias("k", "n"), "last_seen_ts", "weighted_scores", exploration.alias("exploration"))
    return rows.select(F.col("k").cast("int").alias("item"), "n", F.col("last_seen_ts")[F.col("k")].alias("last_seen"), F.coalesce(F.col("weighted_scores")[F.col("k")], F.when(F.col("weighted_scores").isNull(), F.col("n").cast("double")), F.lit(0.0)).alias("wscore"), "exploration")


def profile_json(state: DataFrame, created_at: float, exploration: float = 0.3) -> DataFrame:
    """Rows (usr, profile) with the profile's JSON; a user's items are bounded by the catalogue."""
    def as_map(c):
        return F.map_from_entries(F.collect_list(F.struct(F.col("item").cast("string"), F.col(c))))

    made = state.groupBy("usr").agg(as_map("n").alias("item_counts"), as_map("last_seen").alias("last_seen_ts"), as_map("wscore").alias("weighted_scores"))
    return made.select("usr", F.to_json(F.struct("item_counts", "last_seen_ts", "weighted_scores", F.lit(created_at).alias("created_at"), F.lit(exploration).alias("exploration"))).alias("profile"))


def write_listens(df: DataFrame, path: str) -> None:
    """Events clustered by user and time, zstd, without dictionaries."""
    df.repartition("usr").sortWithinPartitions("usr", "ts").write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


#: A record of the index: 16 key bytes and a little-endian number.
RECORD, RECORD_SIZE = "<16sI", 20


def pack_records(keys: list[bytes], items: list[int]) -> bytes:
    return b"".join(struct.pack(RECORD, k, i) for k, i in zip(keys, items, strict=True))


def unpack_record(record: bytes) -> tuple[bytes, int]:
    return struct.unpack(RECORD, bytes(record))


def write_index(vocab: DataFrame, folder: str) -> None:
    """The binary index of a vocabulary (mbid_bytes, item): sorted records of 16 key bytes and a little-endian number.

    Tasks write a file each, of a range of keys, named in their order, so the files on end are one sorted index.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, inner = pafs.FileSystem.from_uri(folder)
        system.create_dir(inner)
        part = TaskContext.get().partitionId()
        n = 0
        # a task that runs again writes the same bytes under the same name
        with system.open_output_stream(f"{inner}/part-{part:05d}.bin") as out:
            for batch in batches:
                out.write(pack_records(*[c.to_pylist() for c in batch.columns]))
                n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64())})

    ship(vocab.sparkSession)
    rows = vocab.select("mbid_bytes", F.col("item").cast("bigint")).repartitionByRange("mbid_bytes").sortWithinPartitions("mbid_bytes")
    rows.mapInArrow(write, "part int, n bigint").agg(F.sum("n")).collect()


def index_files(folder: str) -> list[str]:
    """The index's files in the order of their keys."""
    system, inner = pafs.FileSystem.from_uri(folder)
    found = [f for f in system.get_file_info(pafs.FileSelector(inner)) if f.path.endswith(".bin")]
    for f in found:
        if f.size % RECORD_SIZE:
            raise ValueError("not a whole number of records")
    return [folder.split("://")[0] + "://" + f.path for f in sorted(found, key=lambda f: f.path) if f.size]


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (mbid_bytes, item) of an index; files are split over tasks at records."""
    ship(spark)
    index_files(folder)
    records = spark.sparkContext.binaryRecords(f"{folder}/*.bin", RECORD_SIZE)
    return spark.createDataFrame(records.map(unpack_record), "mbid_bytes binary, item bigint")


class Resolver:
    """Point look-ups by binary search in an index's files, of which only the records on the way are read."""

    def __init__(self, folder: str):
        self.files = [opened(p) for p in index_files(folder)]
        self.sizes = [f.size() // RECORD_SIZE for f in self.files]
        self.firsts = [self.record(f, 0)[0] for f in self.files]

    def __len__(self) -> int:
        return sum(self.sizes)

    @staticmethod
    def record(f, i: int) -> tuple[bytes, int]:
        f.seek(i * RECORD_SIZE)
        return unpack_record(f.read(RECORD_SIZE))

    def resolve(self, text: str) -> int | None:
        """The item of an identifier; None for an unknown or malformed one."""
        key = uuid_bytes(text)
        part = bisect.bisect_right(self.firsts, key) - 1 if key is not None else -1
        if part < 0:
            return None
        at = bisect.bisect_left(range(self.sizes[part]), key, key=lambda i: self.record(self.files[part], i)[0])
        found = self.record(self.files[part], at) if at < self.sizes[part] else (None, None)
        return found[1] if found[0] == key else None


def resolved(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (mbid, item) of all identifiers, item null where unknown; an equi-join, for many at once."""
    good = F.col("mbid").rlike(UUID)
    key = F.when(good, F.unhex(F.regexp_replace("mbid", "-", "")))
    return keys.select("mbid", key.alias("k")).join(index.select(F.col("mbid_bytes").alias("k"), "item"), "k", "left").select("mbid", "item")


def misses(found: DataFrame) -> DataFrame:
    """Numbers of distinct identifiers found and not found."""
    return found.distinct().agg(F.count("item").alias("n_found"), F.sum(F.col("item").isNull().cast("bigint")).alias("n_missing"))


UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def uuid_bytes(text: str) -> bytes | None:
    """The 16 bytes of an identifier, or None if it is malformed."""
    if not re.fullmatch(UUID[1:-1], text or ""):
        return None
    return bytes.fromhex(text.replace("-", ""))


def contribution(state: DataFrame, consent: bool, n_items: int, max_items: int = 200, min_count: int = 5, coarse_time: bool = True) -> str:
    """The payload of one user's profile state (item, n, last_seen), of at most max_items items."""
    if not consent:
        raise ValueError("a contribution needs consent")
    month = F.date_format(F.timestamp_seconds("last_seen"), "yyyy-MM").alias("last_seen_month")
    rows = state.where(F.col("n") >= min_count).orderBy(F.desc("n"), "item").limit(max_items).select("item", "n", *([month] if coarse_time else []))
    items = [{"item_id": r["item"], "count": r["n"]} | ({"last_seen_month": r["last_seen_month"]} if coarse_time else {}) for r in rows.collect()]
    return json.dumps({"schema": "contribution.v1", "n_items": n_items, "items": items})


def read_contributions(spark: SparkSession, path: str) -> DataFrame:
    """Rows (payload, item, n, month) of contribution payloads, a JSON text per file; other schemas are left out."""
    kind = "schema string, n_items bigint, items array<struct<item_id:int,count:bigint,last_seen_month:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.xxhash64("value").alias("payload"), F.from_json("value", kind).alias("p")).where(F.col("p.schema") == "contribution.v1")
    return rows.select("payload", F.explode("p.items").alias("x")).select("payload", F.col("x.item_id").alias("item"), F.col("x.count").alias("n"), F.col("x.last_seen_month").alias("month"))


def with_contributions(counts: DataFrame, contributed: DataFrame) -> DataFrame:
    """Training counts (item, n) with what was contributed added, for the next training."""
    return counts.select("item", "n").unionByName(contributed.select("item", "n")).groupBy("item").agg(F.sum("n").alias("n"))
