"""Shared plumbing: shared-folder tables, Arrow text batches, key filters and 64-bit mixing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one vectorised step; a text longer than this is a step of its own.
CHUNK_BYTES = 2 << 20
#: A key filter has eight bits a key, between these limits, so it is at most 64 MB and may be sent to
#: all tasks. Beyond some hundred million keys it lets more rows through to the exact join behind it.
FILTER_LEAST, FILTER_MOST = 1 << 20, 1 << 29
#: Bits of a piece of a filter, which is a row on the way to the driver.
PIECE_BITS = 1 << 16
#: Keys of a fixed width that may be broadcast, after they have been counted: some 50 MB.
BROADCAST_KEYS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made by `shared_dir` and not yet removed.
_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below `spark.checkpoint.dir`, as a URI that executors resolve as the driver does.
    Only a local session may go without that setting, as tests do; its folder goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sheafmill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _folders.append(f"{base.rstrip('/')}/sheafmill-{uuid.uuid4().hex}")
    return _folders[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the shared folders made inside, whose tables must then have been read for good."""
    before = len(_folders)
    try:
        yield
    finally:
        for folder in _folders[before:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _folders[before:]


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again: lineage ends at files that
    every executor can reach, so a lost executor costs no recomputation of what came before."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers, the same in every process."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


#: Keys of a table of counts that is sent to all tasks: it grows with the input up to some 100 MB.
TABLE_KEYS = 1 << 21


def frequent(counts: DataFrame, n: Column, most: int = TABLE_KEYS) -> Column:
    """A condition that the rows with the largest `n` (1 at least) meet, all of them if there are no more
    than `most`, else those from the lowest eighth of a power of two on that leaves no more than that."""
    level = F.floor(F.log2(n) * 8)
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total = np.cumsum([n for _, n in sizes])
    if not len(total) or total[-1] <= most:
        return F.lit(True)
    return level > sizes[int(np.searchsorted(total, most, side="right"))][0]


class KeyTable:
    """Rows of numbers by distinct 64-bit keys, exactly, for lookups of many keys at once: open
    addressing with at least two slots a key, so that the table grows with its keys. Keys that aren't in
    it share the rows of `pool` by hash, a power of two of them, if there are any."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, pool: np.ndarray | None = None) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        self.pool = 0 if pool is None else len(pool)
        #: One row more than there are keys and pool rows: without a pool, that of all other keys.
        self.values = np.concatenate([values, *([] if pool is None else [pool]), np.zeros_like(values, shape=(1, *values.shape[1:]))])
        left, at = np.arange(len(keys), dtype=np.int32), self._home(self.keys[:-1])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> self.shift).astype(np.int64)

    @staticmethod
    def pool_of(keys: np.ndarray, size: int) -> np.ndarray:
        return (mix64(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(size - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key in `values`; for keys that aren't there that of the pool, or -1, the last."""
        at = self._home(keys)
        row = self.slots[at]
        wrong = np.flatnonzero((self.keys[row] != keys) & (row >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            row[wrong] = found = self.slots[at[wrong]]
            wrong = wrong[(self.keys[found] != keys[wrong]) & (found >= 0)]
        if self.pool:
            other = np.flatnonzero(row < 0)
            row[other] = len(self.keys) - 1 + self.pool_of(keys[other], self.pool)
        return row


# -- key filters -------------------------------------------------------------------------------


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap with the bits of all values of the one column of `keys`, an integer; nulls are left out."""
    bits = min(max(1 << int(8 * keys.count()).bit_length(), FILTER_LEAST), FILTER_MOST)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at // PIECE_BITS, pa.int32()), "at": pa.array(at % PIECE_BITS, pa.int32())})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, at = batch.column("piece").to_numpy(), batch.column("at").to_numpy()
            order = np.argsort(piece, kind="stable")
            cuts = np.flatnonzero(np.diff(piece[order])) + 1
            for own in np.split(order, cuts) if len(order) else ():
                used = np.zeros(PIECE_BITS, bool)
                used[at[own]] = True
                k = int(piece[own[0]])
                held[k] = np.packbits(used) | held.get(k, np.uint8(0))
        for k, used in held.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "bits": pa.array([used.tobytes()], pa.binary())})

    found = keys.mapInArrow(places, "piece int, at int").repartition("piece").mapInArrow(pieces, "piece int, bits binary").toPandas()
    packed = np.zeros((bits // PIECE_BITS, PIECE_BITS // 8), np.uint8)
    for k, used in zip(found["piece"], found["bits"]):
        packed[k] = np.frombuffer(used, np.uint8)
    return packed.ravel()


def in_filter(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the filter's; true for all that are."""
    bit = _bit(keys, 8 * len(packed))
    return (packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def may_be_in(packed: np.ndarray, key: Column, spark: SparkSession) -> Column:
    """`in_filter` as a column; only the keys leave the JVM. A null key counts as 0."""
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def inside(keys: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, keys.to_numpy()))

    return inside(F.coalesce(key.cast("long"), F.lit(0)))


def without(rows: DataFrame, keys: DataFrame, made: dict[str, Column]) -> DataFrame:
    """`rows` without those whose key is a row of `keys`, integers whose columns are the names in `made`;
    rows with a null in their key stay. Keys up to BROADCAST_KEYS go to the rows; of more, a filter goes
    first, and only rows that pass it are shuffled."""
    names = {name: f"__{name}__{k}" for k, name in enumerate(made)}
    keyed = rows.withColumns({names[name]: column for name, column in made.items()})
    dropped = keys.select(*(F.col(name).alias(names[name]) for name in made)).distinct()
    own = quoted(rows)
    if keys.count() <= BROADCAST_KEYS:
        return keyed.join(F.broadcast(dropped), list(names.values()), "left_anti").select(own)
    first = next(iter(made))
    maybe = may_be_in(key_filter(keys.select(first)), F.col(names[first]), rows.sparkSession)
    left = keyed.where(maybe).join(dropped, list(names.values()), "left_anti")
    return keyed.where(~maybe).select(own).union(left.select(own))


def spread(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """`n` small rows that each stand for much work, such as files to read, in even ranges by the columns
    `by` over as many tasks as there are rows, up to 32 a core. The number is given, as adaptive
    execution would join them all into one task by their few bytes."""
    return rows.repartitionByRange(max(1, min(n, 32 * rows.sparkSession.sparkContext.defaultParallelism)), *by)


def quoted(rows: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in rows.columns]
