"""Helpers that several corpus operators use."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextvars import ContextVar
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ASCII white space that separates words: space, and tab to carriage return.
SPACES = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The folders of local sessions without spark.checkpoint.dir.
_local: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: The folders that the run in this thread made, where it keeps account of them (Scratch.of_run).
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a new
    folder; on a cluster that is an error, as executors would write where nobody else can read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark not in _local:
            _local[spark] = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        found = _local[spark]
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no lineage to recompute. `made` has the folders of
    all of them: who has read a result may discard() what it was made of."""

    made: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.made.append(self.base)
        if (own := _owned.get()) is not None:
            own.append(self.base)

    @classmethod
    @contextlib.contextmanager
    def of_run(cls, spark: SparkSession) -> Iterator[None]:
        """In the end, delete what was made in here, by this thread; what other queries made meanwhile stays."""
        token = _owned.set(own := [])
        try:
            yield
        finally:
            _owned.reset(token)
            cls._delete(spark, own)
            cls.made[:] = [base for base in cls.made if base not in own]

    @classmethod
    def discard(cls, spark: SparkSession, since: int = 0) -> None:
        """Delete the folders that were made after the first `since` ones."""
        cls._delete(spark, cls.made[since:])
        del cls.made[since:]

    @staticmethod
    def _delete(spark: SparkSession, folders: list[str]) -> None:
        for base in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(base)
            with contextlib.suppress(Exception):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n}-{name}"

    def table(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """df, written as Parquet and read again; by: the columns whose values become folders."""
        path, schema = self.path(name), df.schema
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that is needed no more."""
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0] if "=" not in file.rsplit("/", 2)[1] else file.rsplit("/", 2)[0]
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            with contextlib.suppress(Exception):
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Let the system have what this process has freed: Python workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, and of at most some `most` bytes unless a row has more: what is made of many documents at
    once is several times as large as their texts. In the end free memory is given back."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > most:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows
    give_back()


def ascii_lower(c: Column) -> Column:
    """A-Z only; letters outside ASCII stay."""
    return F.translate(c, UPPER, UPPER.lower())


def pow2_at_least(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def source_key(c: Column) -> Column:
    """A non-null join key: null and any string stay apart."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def join_unique(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner", share: int = 500) -> DataFrame:
    """left joined to right, whose keys are unique, such that no task gets a hot key's rows. left's keys aren't null.

    weight is a column of right, left out of the result: how many rows of left have the key. Keys with more than a
    share-th of these rows, of which there are fewer than `share`, are broadcast; the others are shuffled. right is
    read several times, so it should be a written table.
    """
    rows = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * share > rows
    hot, few = F.broadcast(right.filter(is_hot).drop(weight)), right.filter(~is_hot).drop(weight)
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(few, on, how))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not, with more underscores if need be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_hash(df: DataFrame, salt: int = 0) -> Column:
    """A 64-bit hash over all columns; those that hold maps, which have no hash, are hashed as JSON."""

    def holds_map(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(holds_map(f.dataType) for f in kind.fields)
        return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and holds_map(kind.elementType)

    cell = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if holds_map(f.dataType) else F.col(f"`{f.name}`")
    return F.xxhash64(F.lit(salt), *(cell(f) for f in df.schema.fields))
