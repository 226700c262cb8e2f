"""Where the operators keep tables between steps: the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path

#: Bytes that each of the two generations of a worker's memo may hold; bytes of an Arrow batch of texts.
MEMO_BYTES, BATCH_BYTES = 32 << 20, "8m"

_built: dict[tuple[str, str], object] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back, which cuts its lineage.

    Lost executors do not matter: the rows are in a file system that outlives them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the steps of one operator, in a folder of the shared one that goes when the ``with`` block ends.

    A result must be written elsewhere before that (``materialize``); a table written again replaces the one before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.held = spark, fresh_path(spark, name), {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._remove(self.path)

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.mode("error").parquet(path)
        if name in self.held:
            self._remove(self.held[name])
        self.held[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.held.pop(name))


class Shared:
    """A broadcast value, and what each Python worker builds from it once.

    Only for vocabularies and models, whose size does not depend on the data that they are applied to. A worker holds
    what it built for one value at a time: workers live on through the stages of a pipeline, and what an earlier one
    built is let go before the next one's is made.
    """

    def __init__(self, spark: SparkSession, value):
        self.token, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def built(self, build):
        key = (self.token, build.__qualname__)
        if key not in _built:
            forget()
            _built[key] = build(self.sent.value)
        return _built[key]


def forget() -> None:
    """Lets go of what earlier stages built in this Python worker."""
    _built.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class Memo(dict):
    """What a worker knows already: two generations of at most ``most`` bytes each, so what is asked for again stays.

    ``make`` gives the value of a key that is not known."""

    def __init__(self, most: int = MEMO_BYTES):
        super().__init__()
        self.most, self.size, self.older = most, 0, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        need = getsizeof(key) + getsizeof(value) + 80  # its share of the table, as measured
        if need < self.most >> 10:  # a key of many kilobytes hardly comes twice
            if self.size + need > self.most:
                self.older, self.size = dict(self), 0
                self.clear()
            self.size += need
            self[key] = value
        return value


def bounded_batches(df: DataFrame) -> DataFrame:
    """Has the session hand texts to Python in Arrow batches of about 8 MB, unless it sets a size itself: with several
    Python workers to an executor, batches of the default size are most of their memory."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) in ("64MB", str(64 << 20), f"{64 << 20}b"):  # the default
        conf.set(name, BATCH_BYTES)
    return df


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[dict[str, list]]:
    """Python values of some rows at a time, so that a batch of long texts is never held twice as a whole."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()


def remainder(id_column: str, modulus: int):
    """crc32 of the id's text modulo ``modulus``; a null id has the remainder of an empty text, 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(0)) % F.lit(modulus)


def thinned(rows: DataFrame, key: str, by: str, about: int) -> DataFrame:
    """A sample of about ``about`` rows of each value of ``by``, by a hash of ``key``; all rows of a rarer value.

    Only counts of each value are gathered, no rows; the choice is the same at every size and partitioning.
    """
    counts = rows.groupBy(by).count().collect()  # a row for each class
    spread = 1 << 30
    chosen = F.lit(False)
    for value, n in counts:
        chosen = chosen | ((F.col(by) == F.lit(value)) & (F.pmod(F.xxhash64(key), F.lit(spread)) < min(spread, spread * about // n)))
    return rows.filter(chosen)
