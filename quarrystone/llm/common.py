"""What the operators share: the folder all executors see, staged tables, text batches, word and shingle ids."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []

#: Words one worker remembers at most; further ones are hashed or encoded anew.
MEMO_WORDS = 250_000
_HELD: dict[str, Callable[[], None]] = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share. Where none is set, a folder of its own, which only a
    local master's executors can see; others must be given `spark.checkpoint.dir`."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="quarrystone-"))
            spark.sparkContext.setCheckpointDir(_OWN[0])
        root = _OWN[0]
    return f"{root.rstrip('/')}/quarrystone/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_table(df: DataFrame, path: str, *by: str) -> None:
    out = df.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read from there: later reads neither compute it again nor need its executors."""
    path = shared_path(df.sparkSession, label)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables that are deleted together, when what was made from them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        path = shared_path(self.spark, label)
        self.paths.append(path)
        write_table(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            delete_path(self.spark, path)
        self.paths.clear()


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, `_row`; staged, so that every read gives a row the same one."""
    return staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", budget: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about `budget` bytes of text each, and their texts as UTF-8 (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        sizes = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + budget, "right")) - 1)
            yield batch.slice(start, end - start), [t or b"" for t in texts.slice(start, end - start).to_pylist()]
            start = end
    batch = texts = None
    give_back()


def give_back() -> None:
    """Memory that this worker has freed goes back to the system; workers outlive their tasks, beside stages of the JVM alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Says that this worker now remembers things for `owner`; what it remembered for others goes, as workers outlive stages."""
    for other in [x for x in _HELD if x != owner]:
        _HELD.pop(other)()
    _HELD[owner] = clear


class WordIds(dict):
    """64-bit id of each word (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        found = self.make(word)
        if len(self) < MEMO_WORDS:
            self[word] = found
        return found

    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids of all `width`-word shingles in order; fewer words make one shingle, no words none."""
    if not len(ids):
        return ids
    k = min(width, len(ids))
    n = len(ids) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _ODD + ids[j : j + n]
    return mix(out)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def fold(column: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))
