"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by page_id, digest and url, and cut into shards of about SHARD_BYTES by the bytes that come before
each of them, so the same table gives the same files on any cluster: neither an outlying id, nor one id that a third of
all rows have, nor one page that they all are, makes a shard larger. Running sums are taken over narrow rows (a key and
bytes for each distinct record) in range-cut blocks with offsets. Only the first key of each shard comes to the driver,
MOST_SHARDS at most, as shards grow with the table beyond that. Copies of one record that fill more than a shard travel
as one row with a count for each of their shards.

Each shard's task writes one gzip member per record, starts a new file once FILE_BYTES of compressed data are reached,
writes under a temporary name and renames it when it is closed; the names of finished files come back as a manifest
that Spark commits in one step. Files that no manifest names (of lost or repeated tasks) are never read. Headers, record
ids and digests are made anew from the rows, with a fixed date. The reader deals the manifest's rows over tasks, which
stream their files.

Equal payloads of LEAST_REVISIT bytes or more: the row with the largest page_id is the response, the others are
revisits of it. Only keys and digests of rows are compared for that; the marks of revisits travel in the same shuffle
as the pages, so payloads move once.

Defined cases: null html is an empty payload; a null page_id has no id header, sorts first and is never referred to
(if all of a group are null, all are responses); rows with equal page_id and payload are all responses or all
revisits; any long is an id; an empty table writes no file and reads back empty; other columns aren't read. One page is
held at once by its task.

The output folder has to be one that pyarrow's filesystems reach from the executors (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_map, bounded_batches, join_counted, materialise

LEAST_REVISIT = 1000
SHARD_BYTES = 24 << 20
FILE_BYTES = 6 << 20
#: Most shards, about; larger tables have larger ones.
MOST_SHARDS = 50_000
#: What a record weighs beside its payload, and bytes of files that one task reads.
HEAD_BYTES = 500
READ_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, *, http: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n") -> bytes:
    """A response, or where refers_to is given a revisit, whose block is the HTTP head alone."""
    revisit = refers_to is not None
    head = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record(fields, block)


def _gzip(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class ShardFiles:
    """The files of one task's shards: rolled by compressed size, renamed when complete."""

    def __init__(self, folder: str, file_bytes: int):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.file_bytes, self.attempt = file_bytes, uuid.uuid4().hex
        self.shard, self.part, self.out, self.done = None, 0, None, []

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.temp = f"{self.root}/_temporary/{self.attempt}-{self.name}"
        self.out = self.store.open_output_stream(self.temp, compression=None)
        self.size, self.records, self.sha1 = 0, 0, hashlib.sha1()
        self._put(_gzip(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, self.name)}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.out is None:
            self._open()
        self._put(_gzip(record))
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()
            self.part += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.sha1.hexdigest()))
            self.out = None

    def take_done(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "shard", "records", "bytes", "sha1"])


def _ordered(rows: DataFrame, weight: str) -> DataFrame:
    """rows (distinct in key) with `before`, the sum of weight over all rows with smaller keys; no row is sorted in one task."""
    cut = materialise(rows.repartitionByRange("key").withColumn("block", F.spark_partition_id()), "warc-blocks")
    per = cut.groupBy("block").agg(F.sum(weight).alias("held"))  # a row per block
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("block", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("inside", inside).join(starts, "block").withColumn("before", (F.col("inside") + F.col("start")).cast("long")).drop("block", "inside", "start")


def write(pages: DataFrame, folder: str, *, shard_bytes: int | None = None, file_bytes: int | None = None, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) to folder; returns the committed manifest: file, shard, records, bytes, sha1."""
    spark = pages.sparkSession
    bounded_batches(spark)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # hexadecimal digits of the id with its sign turned sort like ids; "!" sorts before them
    id_key = F.coalesce(F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("!"))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.concat(id_key, "digest", F.coalesce(F.sha1(F.col("url").cast("binary")), F.lit("!"))))
    per_key = keyed.select("key", "page_id", "digest", F.length("payload").cast("long").alias("size")).groupBy("key", "page_id", "digest", "size").agg(F.count("*").alias("copies"))
    records = materialise(_ordered(per_key.withColumn("weight", (F.col("size") + HEAD_BYTES) * F.col("copies")), "weight"), "warc-records")
    total = records.agg(F.sum("weight")).first()[0] or 0
    shard_bytes = shard_bytes or max(SHARD_BYTES, total // MOST_SHARDS + 1)
    file_bytes = file_bytes or max(FILE_BYTES, shard_bytes // 4)

    shard_at = lambda x: F.floor(x / F.lit(shard_bytes)).cast("long")
    one = F.col("size") + HEAD_BYTES
    last = F.col("before") + (F.col("copies") - 1) * one
    # distinct shards and their first keys: MOST_SHARDS at most, about
    spans = records.select("key", F.explode(F.sequence(shard_at(F.col("before")), shard_at(last))).alias("shard"), (F.col("weight") > shard_bytes).alias("heavy"), "before", "copies", one.alias("one"))
    spans = spans.where("heavy or shard = floor(before / {0})".format(shard_bytes))
    firsts = spans.where("not heavy").groupBy("shard").agg(F.min("key").alias("key"))
    border = [(r["key"], r["shard"]) for r in firsts.orderBy("key").collect()]
    heavy = spans.where("heavy").select("key", "shard", (F.least(F.col("copies"), F.ceil(((F.col("shard") + 1) * shard_bytes - F.col("before")) / F.col("one"))) - F.greatest(F.lit(0), F.ceil((F.col("shard") * shard_bytes - F.col("before")) / F.col("one")))).cast("long").alias("copies")).where("copies > 0")
    heavy = materialise(heavy, "warc-heavy")
    crowded = sorted(r["key"] for r in heavy.select("key").distinct().collect())  # each fills a shard, so there are fewer than shards
    number = {shard: i for i, shard in enumerate(sorted({s for _, s in border} | {r["shard"] for r in heavy.select("shard").distinct().collect()}))}
    shared = spark.sparkContext.broadcast(([k for k, _ in border], [number[s] for _, s in border], frozenset(crowded)))

    @F.arrow_udf("int")
    def route(keys: pa.Array) -> pa.Array:
        starts, shards, many = shared.value
        return pa.array([-1 if k in many else shards[bisect.bisect_right(starts, k) - 1] for k in keys.to_pylist()], pa.int32())

    large = records.where(F.col("size") >= least_revisit)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"), F.sum("copies").alias("rows")).where("rows > 1 and refers_to is not null").drop("rows")
    groups = materialise(groups, "warc-groups")
    marks = join_counted(large.select("key", "page_id", "digest"), groups, "digest", large.count()).where("page_id is null or page_id <> refers_to").select("key", "refers_to")
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["shard", "key", "page_id", "url", "payload", "digest", "copies", "refers_to"]
    routed = keyed.withColumn("shard", route("key"))
    both = routed.withColumns({"copies": F.lit(1).cast("long"), "refers_to": none("long")}).select(columns)
    both = both.where("shard >= 0") if crowded else both
    told = marks.withColumn("shard", route("key")).where("shard >= 0").select("shard", "key", none("long").alias("page_id"), none("string").alias("url"), none("binary").alias("payload"), none("string").alias("digest"), F.lit(0).cast("long").alias("copies"), "refers_to")
    both = both.unionByName(told)
    if crowded:
        numbers = spark.createDataFrame(list(number.items()), "shard long, place int")
        each = routed.where("shard < 0").drop("shard").dropDuplicates(["key"])
        dealt_copies = heavy.join(marks, "key", "left").join(numbers, "shard").drop("shard").withColumnRenamed("place", "shard")
        both = both.unionByName(each.join(dealt_copies, "key").select(columns))
    shards = max(1, len(number))
    # a mark stands right before the pages of its key
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", F.col("copies") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, mark = ShardFiles(folder, file_bytes), (None, None)
        for batch in batches:
            for shard, key, page_id, url, payload, digest, copies, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not copies:
                    mark = (key, refers_to)
                    continue
                record = page_record(page_id, url, payload, digest, refers_to if refers_to is not None else mark[1] if mark[0] == key else None)
                for _ in range(copies):
                    files.add(shard, record)
            yield files.take_done()
        files.close()
        yield files.take_done()

    manifest = arrow_map(dealt.select(columns), run, "file string, shard int, records bigint, bytes bigint, sha1 string")
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest")
    store.delete_dir(f"{root}/_temporary")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, read chunk by chunk."""
    unpack, parts, fresh = zlib.decompressobj(31), [], True
    while data := stream.read(chunk):
        while data:
            parts.append(unpack.decompress(data))
            data, fresh = unpack.unused_data, False
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("an archive ends within a record")


def parse(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (fields, block) of each record of an archive (bytes or a stream)."""
    for record in members(io.BytesIO(data) if isinstance(data, bytes) else data):
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


SCHEMA = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def read(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """The page records of the archives that folder's manifest names: SCHEMA (payload null for revisits, or unless asked for).

    Digests of blocks and payloads are checked; a damaged archive raises.
    """
    manifest = spark.read.schema("file string, shard int, records bigint, bytes bigint, sha1 string").parquet(f"{folder}/_manifest").select("file", "bytes")
    held = manifest.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files")).first()
    tasks = max(1, min(held["files"], max(-(-(held["bytes"] or 0) // READ_BYTES), spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    yield from _pages(stream, payloads)

    return arrow_map(manifest.select("file").repartition(tasks), run, SCHEMA)


def _pages(stream, payloads: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for fields, block in parse(stream):
        if fields["WARC-Type"] == "warcinfo":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(head.rpartition(b"Content-Length: ")[2])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        response = fields["WARC-Type"] == "response"
        if fields["WARC-Block-Digest"] != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}" or response and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
        rows.append((number("X-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], size, digest, number("X-Refers-To-Page-ID"), payload if response and payloads else None))
        held += len(payload) if payloads else 0
        if len(rows) >= 512 or held > 4 << 20:
            yield _batch(rows)
            rows, held = [], 0
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
