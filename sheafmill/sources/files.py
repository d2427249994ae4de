"""Scans of documents, page ranges, result files and logs."""

from __future__ import annotations

import json
import os
import re
import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import prefix
from . import storage

#: An image, the characters of the page if there are any, and the image's height and width, 0 if left out.
Page = tuple
#: A renderer takes (path, content or None, first page, last page) and gives its pages.
Renderer = Callable[[str, bytes | None, int, int], list[Page]]
PAGE_SCHEMA = "path string, page_index int, image binary, chars string, h int, w int"
_PAGE_ARROW = pa.schema([("path", pa.string()), ("page_index", pa.int32()), ("image", pa.binary()), ("chars", pa.string()), ("h", pa.int32()), ("w", pa.int32())])
#: Pages, and bytes of images and characters, that a task gathers before it hands them on, besides those of one range.
_HELD_PAGES, _HELD_BYTES = 4096, 1 << 23


def scan(spark: SparkSession, target: str, content: bool = False, pattern: str = "*.pdf") -> DataFrame:
    """path, name and length of the PDF files (those of a pattern) below a folder, or of one file, whose
    suffix may be in any case; without `content` no file is opened. A target that is neither gives an
    empty result."""
    columns = ["path", "length", *(["content"] if content else [])]
    known = os.path.isdir(target) or "://" in target
    if not known and not (os.path.isfile(target) and target.lower().endswith(".pdf")):
        rows = spark.createDataFrame([], f"path string, length long{', content binary' * content}")
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        rows = (reader.option("pathGlobFilter", pattern) if known else reader).load(target).select(columns)
    return rows.select("path", text.stem(F.col("path")).alias("name"), *columns[1:])


def in_folders(rows: DataFrame, target: str, suffix: str) -> DataFrame:
    """`rows` (path, name, length) of the files below `target`, where those inside a folder with the suffix, as
    Spark writes a table, are one row: the folder's path and name, and the sum of their lengths."""
    root = "/" + target.partition("://")[2].partition("/")[2] if "://" in target else os.path.abspath(target)
    before = F.length(F.regexp_extract("path", r"^(\w[\w+.-]*:(//[^/]*)?)?", 0)) + len(os.path.normpath(root).rstrip("/"))
    below = F.substring("path", before + 1, F.length("path"))
    inner = F.regexp_extract(below, rf"^.*?(?i:{re.escape(suffix)})(?=/|$)", 0)
    path = F.when(inner == "", F.col("path")).otherwise(F.concat(F.substring("path", F.lit(1), before), inner))
    whole = rows.groupBy(path.alias("path")).agg(F.sum("length").alias("length"))
    return whole.select("path", text.stem(F.col("path")).alias("name"), "length")


def documents(spark: SparkSession, target: str, content: bool = False, pattern: str = "*.pdf") -> DataFrame:
    """The files of `scan` with doc_index, their place in order of the path. Numbering joins them by path, so
    contents of many files are better worked on in `scan`, where they are read, and numbered afterwards."""
    return numbered(scan(spark, target, content, pattern))


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` (path, which is unique) with doc_index, their place in order of the path."""
    paths = rows.select("path")
    ranked = prefix.row_rank(paths, "path", "doc_index", place=prefix.text_place(paths, "path"))
    return rows.join(ranked, "path").select("doc_index", *rows.columns)


def page_ranges(docs: DataFrame, size: int) -> DataFrame:
    """path, first and last of page ranges of at most `size` pages; none for a document without pages."""
    starts = F.sequence(F.lit(0), F.col("page_count") - 1, F.lit(size))
    ranges = docs.where("page_count > 0").select(*docs.columns, F.explode(starts).alias("first"))
    return ranges.withColumn("first", F.col("first").cast("int")).withColumn("last", (F.least(F.col("first") + size, F.col("page_count")) - 1).cast("int"))


def page_counts(docs: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    """`docs` (path, content) with page_count, 0 for a document that can't be read."""

    def safe(content: bytes | None) -> int:
        try:
            return max(int(count(content)), 0) if content is not None else 0
        except Exception:  # noqa: BLE001 - whatever a damaged document raises
            return 0

    @F.pandas_udf(T.IntegerType())
    def counted(contents: pd.Series) -> pd.Series:
        return contents.map(safe).astype("int32")

    return docs.withColumn("page_count", counted("content"))


@contextmanager
def _limited(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError inside if it takes longer; a worker runs its tasks in its main thread."""

    def stop(*_: Any) -> None:
        raise TimeoutError(f"rendering took more than {seconds} s")

    if not seconds:
        yield
        return
    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _rendered(batches: Iterator[pa.RecordBatch], render: Renderer, by_bytes: Renderer | None, timeout: float | None, fetch: Callable[[str], bytes]) -> Iterator[pa.RecordBatch]:
    """The pages of batches of ranges, in batches of their own size."""
    columns: list[list] = [[] for _ in _PAGE_ARROW]
    held = 0

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, _PAGE_ARROW)], schema=_PAGE_ARROW)
        for c in columns:
            c.clear()
        return made

    for batch in batches:
        for path, first, last in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "last"))):
            try:
                with _limited(timeout):
                    made = render(path, None, first, last)
            except Exception:
                if by_bytes is None:
                    raise
                made = by_bytes(path, fetch(path), first, last)
            whole = len(made) == last - first + 1 and all(m[1] is not None for m in made)
            for at, m in enumerate(made, first):
                h, w = m[2:4] if len(m) > 2 else (0, 0)
                chars = m[1] if whole else None
                for c, value in zip(columns, (path, at, m[0], chars, h, w)):
                    c.append(value)
                held += len(m[0] or b"") + len(chars or "")
            if held >= _HELD_BYTES or len(columns[0]) >= _HELD_PAGES:
                yield out()
                held = 0
    if columns[0]:
        yield out()


def pages(ranges: DataFrame, render: Renderer, by_bytes: Renderer | None = None, timeout: float | None = None, fetch: Callable[[str], bytes] = storage.read_bytes) -> DataFrame:
    """path, page_index, image and chars of the pages of `ranges` (path, first, last), spread over tasks
    by range. Where `render` fails, or takes more seconds than `timeout`, and there is `by_bytes`, that is
    given the file's content. If the characters of any page of a range are missing, those of the whole
    range are null. The number of tasks is given, four a core, as a range of few bytes is much work; pages of
    many ranges leave a task as one batch, up to some bytes, as a batch of its own for each costs more than they do."""
    tasks = 4 * ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.where("last >= first").select("path", "first", "last").repartition(tasks, "path", "first").mapInArrow(lambda batches: _rendered(batches, render, by_bytes, timeout, fetch), PAGE_SCHEMA)


def with_cached_chars(wanted: DataFrame, cached: DataFrame, compute) -> DataFrame:
    """Pages with characters from the cache (doc_index, page_index, chars), computed where it has none."""
    joined = wanted.join(cached, ["doc_index", "page_index"], "left")
    return joined.withColumn("chars", F.coalesce("chars", compute))


def blank_pages(spark: SparkSession, n: int, width: int = 1024, height: int = 768) -> DataFrame:
    """White pages for warming up, one at least."""
    made = spark.range(max(1, n)).select(F.col("id").cast("int").alias("page_index"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    return made.withColumn("image", F.unhex(F.repeat(F.lit("FF"), width * height * 3)))


def first_result(spark: SparkSession, folder: str) -> DataFrame:
    """path and document of the result file with the smallest path below a folder; empty without any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_middle.json").load(folder)
    first = files.agg(F.min("path").alias("path")).where("path is not null")
    return files.join(F.broadcast(first), "path").select("path", F.decode("content", "UTF-8").alias("document"))


RESULT_MARK = "###RESULT###"


def worker_results(lines: DataFrame, schema: str, mark: str = RESULT_MARK) -> DataFrame:
    """The JSON records of lines (value) that begin with the mark."""
    rest = F.substring("value", len(mark) + 1, 1 << 30)
    return lines.where(F.startswith("value", F.lit(mark))).select(F.from_json(rest, schema).alias("r")).select("r.*")


def build_log(spark: SparkSession, path: str, tail: int = 15) -> dict[str, Any]:
    """Whether one build's log says PASSED, its compute times, and its last lines if it doesn't."""
    log = spark.read.text(path, wholetext=True).select(F.explode(F.array("value")).alias("log"))
    rows = text.lines(F.col("log"))
    found = log.select(
        F.contains("log", F.lit("PASSED")).alias("passed"),
        F.filter(rows, lambda r: F.contains(r, F.lit("GPU Compute Time"))).alias("times"),
        F.slice(rows, F.greatest(F.size(rows) - tail + 1, F.lit(1)), tail).alias("tail"),
    ).first()  # one row, of one log
    return {"passed": found.passed, "times": found.times, "tail": [] if found.passed else found.tail}


def existing(paths: dict[str, str]) -> dict[str, str]:
    """The engine files that are there; a missing one means its stage runs without."""
    return {name: path for name, path in paths.items() if os.path.isfile(path)}


def read_json(path: str) -> Any:
    with open(path, encoding="utf-8") as file:
        return json.load(file)
