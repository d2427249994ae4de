"""Token counts of flat token files: a separator scan over blocks, stitched by a prefix scan.

A flat file is nothing but little-endian token ids, each document ended by `eod`; there is no index.
Files are cut into blocks of equal size, each block is searched for `eod` in one vectorised pass,
and two running values over the blocks of a file, the number of separators and the place of the
last one, number the documents and measure those that begin in an earlier block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import shared_dir, spread, stored, text_batches
from .files import opened

#: Bytes of a block; documents may span any number of them.
BLOCK_BYTES = 8 << 20


def write_files(docs: DataFrame, folder: str, path: str, pattern: str, eod: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text whole and append it and `eod` to its task's file below `folder`.

    Returns file, ordinal and id_col of each document; computing it writes the files, so store it
    once. A task that is run again writes a new file, and only the committed one is returned.
    Null and empty texts are documents of no tokens; ids may be null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, ordinal = codec(path, pattern), None, 0
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.tokens"
        try:
            for batch in text_batches(batches, "text"):
                out = out or opened(name, "w")
                parts = []
                for text in batch.column("text"):
                    ids = own.encode(text.as_py() or "")
                    ids.append(eod)
                    parts.append(np.array(ids, dtype))
                out.write(np.concatenate(parts).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * n, pa.string()), "ordinal": pa.array(range(ordinal, ordinal + n), pa.int64()), "id": batch.column("id")})
                ordinal += n
        finally:
            if out:
                out.close()

    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pair.schema["id"].dataType.simpleString()
    return pair.mapInArrow(run, f"file string, ordinal long, id {kind}").withColumnRenamed("id", id_col)


def _blocks(files: DataFrame, width: int, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with opened(name) as file:
                    size = file.size()
                starts = np.arange(0, max(size, 1), block_bytes)
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(starts), pa.string()), "start": pa.array(starts // width, pa.int64()), "size": pa.array(np.minimum(size - starts, block_bytes) // width, pa.int64())})

    return files.select("file").mapInArrow(run, "file string, start long, size long")


def scan(files: DataFrame, eod: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES, folder: str | None = None) -> DataFrame:
    """file, ordinal, start, n_tokens and terminated of each document in `files` (column file).

    The prefix scan of a file sees a number or two per block; the separators' places, however many,
    stay in rows by block and meet it in a join. n_tokens doesn't count `eod`. Tokens after a file's last `eod` are one more document, with
    terminated false; a file without tokens has no documents, and no files give an empty result.
    """
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, start, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size"))):
                with opened(name) as file:
                    file.seek(start * width)
                    found.append(start + np.flatnonzero(np.frombuffer(file.read(size * width), dtype) == eod))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            ends = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("file", "start", "size")}, "ends": ends})

    folder = folder or shared_dir(files.sparkSession)
    sized = stored(_blocks(files, width, block_bytes), f"{folder}/sizes")
    found = spread(sized, sized.count(), "file", "start").mapInArrow(run, "file string, start long, size long, ends array<long>")
    blocks = stored(found, f"{folder}/blocks")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    scanned = blocks.select("file", "start", F.size("ends").alias("n"), last.alias("last")).select(
        "file", "start",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
        F.lead("start").over(order).isNull().alias("final"),
    )
    stitched = blocks.hint("merge").join(scanned, ["file", "start"]).withColumn("upto", F.col("start") + F.col("size"))
    # the last block of a file also closes what no separator ends
    open_end = F.col("final") & (F.col("upto") > F.coalesce(last, F.col("carry")) + 1)
    stitched = stitched.withColumn("all_ends", F.when(open_end, F.concat("ends", F.array("upto"))).otherwise(F.col("ends")))
    rows = stitched.select("file", "base", "carry", "all_ends", F.size("ends").alias("closed"), F.posexplode("all_ends").alias("k", "end"))
    start = F.when(F.col("k") > 0, F.try_element_at("all_ends", F.col("k"))).otherwise(F.col("carry")) + 1
    return rows.select("file", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("k") < F.col("closed")).alias("terminated"))
