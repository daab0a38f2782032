"""What several operators share: scratch tables, bounded Arrow batches and samples, joins with hot keys, safe splits and memos."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII blanks. On UTF-8 bytes, bytes.split() splits at just these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


#: Rows and bytes of one Arrow batch between the JVM and Python, at most (a longer text stands alone).
ARROW_ROWS = 1024
ARROW_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one (tests) gets a new
    temporary folder; on a cluster that would be a folder of one machine, so it raises there."""
    path = spark.conf.get(_CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CHECKPOINT_CONF} names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-newsloom-")
        spark.conf.set(_CHECKPOINT_CONF, path)
    return path.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to ARROW_ROWS and ARROW_BYTES: texts make the usual 10,000 rows too large."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(name, None)
        digits = re.fullmatch(r"\d+", now or "")
        if not digits or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def arrow_map(source: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """source.mapInArrow(run, schema) in bounded batches; a task gives the memory that it no longer uses back at its end."""
    bounded_batches(source.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return source.mapInArrow(task, schema)


def release_memory() -> None:
    """Return free memory of Arrow's pool and of the C library to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        return


_worker: dict = {}


def of_worker(key: tuple, make: Callable):
    """What make() gives, kept by this Python worker until an operator with another key[0] asks for something: workers
    live on between stages, and tokenizers and memos of one stage would weigh on the next."""
    if key not in _worker:
        if any(k[0] != key[0] for k in _worker):
            _worker.clear()
            release_memory()
        _worker[key] = make()
    return _worker[key]


def _drop_made() -> None:
    for spark, path in _made:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may have ended; the folder is scratch anyway
            continue


atexit.register(_drop_made)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has; it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors, prunes columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of batch whose texts in that column hold about `most` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


_SPACE_PAIR = re.compile(r" \s|\s |^\s|\s$")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def split_at_single_spaces(text: str) -> list[str]:
    """Parts of text between single blanks that have no white space on either side; ' '.join() restores it."""
    return _SAFE_SPACE.split(text) if _SPACE_PAIR.search(text) else text.split(" ")


class Memo(dict):
    """Results by word in two generations of about `most` bytes: the older one goes when the younger is full, but for what
    has been asked for since. Words of more than LONGEST characters aren't kept. So memory is bounded, and frequent
    words stay."""

    LONGEST = 128
    #: What a key, a value and their place in a dict take beside their characters.
    ENTRY = 200

    def __init__(self, make, most: int = 24 << 20):
        super().__init__()
        self.make, self.most, self.older, self.held = make, most, {}, 0

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.LONGEST:
            self[word] = value
            self.held += self.ENTRY + len(word) + len(value)
        return value

    def put(self, word, value) -> None:
        """A value that was made elsewhere, for a word of LONGEST characters at most."""
        self[word] = value
        self.held += self.ENTRY + len(word) + len(value)

    def trim(self) -> None:
        if self.held > self.most:
            self.older, self.held = dict(self), 0
            self.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPAN = 1 << 30


def row_hash(columns: Sequence[str], seed: int = 17) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(_SPAN))


def bounded_sample(df: DataFrame, columns: Sequence[str], bound: int, seed: int = 17) -> DataFrame:
    """At most `bound` rows of `columns`, distinct in them: those with the smallest hashes, so the same ones on every run.

    Ids may repeat or be null, and one row may make up the whole table: equal rows count once, at least one row is taken
    of a table that has any, and the bound is a hard one.
    """
    hashed = df.select(*columns, row_hash(columns, seed).alias("hash_of_row"))
    seen = hashed.agg(F.count("*").alias("n"), F.min("hash_of_row").alias("least")).first()
    if not seen["n"]:
        return df.select(*columns).limit(0)
    limit = max(int(1.25 * _SPAN * bound / seen["n"]), seen["least"] + 1)
    once = hashed.where(F.col("hash_of_row") < limit).groupBy("hash_of_row").agg(F.first(F.struct(*columns)).alias("row"))
    return once.orderBy("hash_of_row").limit(bound).select("row.*")


#: A key is hot if it has more than this share of all rows; so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1024


def join_counted(rows: DataFrame, values: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to values, which has one row per key with the column n, the number of rows of that key (n goes).

    Rows of hot keys meet their value by a broadcast of fewer than 1 / HOT_SHARE rows, whatever the table; the others by
    a shuffle in which no key has more than HOT_SHARE of all rows. So no key fills a task.
    """
    hot = F.col("n") > total * HOT_SHARE
    heavy = F.broadcast(values.where(hot).withColumnRenamed(key, "hot_key").drop("n").withColumn("is_hot", F.lit(True)))
    marked = rows.join(heavy, F.col(key) == F.col("hot_key"), "left").drop("hot_key")
    found = [c for c in values.columns if c not in (key, "n")]
    first = marked.where("is_hot").select(*rows.columns, *found)
    rest = marked.where("is_hot is null").select(*rows.columns).join(values.where(~hot).drop("n"), key, how).select(*rows.columns, *found)
    return first.unionByName(rest)
