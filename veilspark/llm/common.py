"""Pieces shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of code points other than ASCII space, tab, newline, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

#: Bytes and rows of one Arrow batch handed to a Python worker; either limit ends a batch, so memory follows neither
#: the length of a text nor the number of rows in a partition.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Copies of the side with one row a key in a salted join, and the bits of the largest broadcast filter.
SALTS, MOST_BITS = 16, 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, through Spark's own reader (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: list[str]) -> list[str]:
    """Column names that hold any character, as Spark resolves them."""
    return [f"`{x.replace('`', '``')}`" for x in names]


def map_rows(df: DataFrame, run: Run, column: int) -> DataFrame:
    """``df.mapInArrow(run)`` with the schema of ``df``, whatever its columns are called, in slices by ``column``."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(in_slices(run, column), plain.schema).toDF(*df.columns)


def bound_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches of this session by bytes as well as by rows; ``in_slices`` holds where the session's limits are reset."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(run: Run) -> Run:
    """``run``, after which its worker gives the memory of its arrays back: workers are used again by later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def in_slices(run: Run, column: int) -> Run:
    """``run`` over batches cut so that the strings of one column have ``BATCH_BYTES`` at most, but for single rows of more.

    What an operator makes of a batch is a multiple of it: this bounds it by the call, whatever the session's settings.
    """
    limit = BATCH_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column)
            if texts.nbytes <= limit:
                yield b
                continue
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + limit, "right")))
                yield b.slice(at, stop - at)
                at = stop

    return released(lambda batches: run(cut(batches)))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent in a local session (tests) a temporary folder is made and set; on a cluster that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/veilspark/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cuts lineage, survives lost executors.

    The path is added to ``scratch``, for tables that are to be discarded.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that no plan still to be run reads."""
    for x in scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    scratch.clear()


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``unique`` (a row per key, repeated ``salts`` times), so that no key's rows meet in one task.

    ``spread`` is the column of ``rows`` by which the rows of one key are dealt. For sides of a few numbers a row.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def _field_bits(n: int) -> int:
    return min(MOST_BITS, max(1 << 12, 1 << (16 * max(1, n) - 1).bit_length()))


def bit_filter(hashes: DataFrame, column: str, n: int) -> DataFrame:
    """Words of a bit field that holds ``column`` of ``hashes`` (about ``n`` values): 16 bits a value, ``MOST_BITS`` at most.

    Rows ``(__word, __bits)``, at most ``MOST_BITS / 64`` of them, for broadcasting. With more values than that the field
    fills up and tells less; what it lets through is always met exactly afterwards.
    """
    size = _field_bits(n)
    at = F.pmod(F.col(column), F.lit(size))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(`{column}`, {size}L) % 64 AS INT))")
    return hashes.select(F.floor(at / 64).alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def may_hold(rows: DataFrame, column: str, words: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``__maybe``: false where the filter of ``n`` values surely does not hold ``column``."""
    size = _field_bits(n)
    marked = rows.withColumn("__word", F.floor(F.pmod(F.col(column), F.lit(size)) / 64))
    met = marked.join(F.broadcast(words), "__word", "left")
    bit = F.expr(f"(shiftrightunsigned(__bits, CAST(pmod(`{column}`, {size}L) % 64 AS INT)) & 1L) = 1L")
    return met.withColumn("__maybe", F.coalesce(bit, F.lit(False))).drop("__word", "__bits")


def strings(texts: pa.Array, divider: str) -> list[str]:
    """The Python strings of an array without nulls, in none of which ``divider`` stands: one conversion, then one cut."""
    if not len(texts):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return pc.binary_join(one, divider)[0].as_py().split(divider)


class UnitIds:
    """Ids of texts given as lists of units, remembering the ids of every unit met, in arrays, up to so many bytes.

    ``learn`` takes new units and gives them back in an order of its own, with their ids joined and the number of each.
    Distinct units of a batch are found in Arrow; only they become Python strings. No unit holds ``divider``.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], divider: str, limit: int, kind: type = np.uint32) -> None:
        self.learn, self.divider, self.limit, self.kind = learn, divider, limit, kind
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start, self.size, self.held = np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def _places(self, units: list[str]) -> np.ndarray:
        own = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(own < 0)
        if len(new):
            names, flat, size = self.learn([units[i] for i in new.tolist()])
            first = len(self.size)
            self.place.update(zip(names, range(first, first + len(names)), strict=True))
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
            self.size, self.flat = np.r_[self.size, size], np.r_[self.flat, flat.astype(self.kind)]
            self.held += sum(map(len, names)) + 200 * len(names) + flat.nbytes
            own[new] = np.fromiter(map(self.place.__getitem__, (units[i] for i in new.tolist())), np.int64, len(new))
        return own

    def __call__(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and the number of ids of each text."""
        if self.held > self.limit:
            self._forget()
        coded = lists.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        which = self._places(strings(coded.dictionary, self.divider))[coded.indices.to_numpy(zero_copy_only=False)]
        own = self.size[which]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        joined = self.flat[np.arange(total) + np.repeat(self.start[which] - (ends - own), own)]
        bounds = np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return joined, np.diff(bounds)
