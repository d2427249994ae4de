"""Results per document: files in a folder that its path determines, written again without harm."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import storage


def output_dir(base: str, path: Column, method: Column) -> Column:
    """Folder of a document's results; documents of one name in different folders don't collide."""
    tag = F.substring(F.sha1(path.cast("binary")), 1, 8)
    return F.concat_ws("/", F.lit(base), F.concat_ws("-", text.stem(path), tag), method)


def tag_of(path: str) -> str:
    return hashlib.sha1(path.encode()).hexdigest()[:8]


def write_documents(results: DataFrame, render: bool = True) -> DataFrame:
    """Write the files of each row of `results` (doc_index, path, name, folder, middle_json, content_list,
    markdown, model_json) where the rows are, and return doc_index, folder, the number of files and
    the time when they were written. The middle result and the content list are always written; Markdown, the models'
    result and a copy of the document only with `render`. The folder is one that all executors share."""

    def run(frames):
        for frame in frames:
            counts, times = [], []
            for row in frame.itertuples():
                files = {f"{row.name}_middle.json": row.middle_json, f"{row.name}_content_list.json": row.content_list}
                if render:
                    files |= {f"{row.name}.md": row.markdown, f"{row.name}_model.json": row.model_json}
                made = {k: v.encode() for k, v in files.items() if v is not None}
                if render:
                    made[f"{row.name}_origin.pdf"] = storage.read_bytes(row.path)
                for name, value in made.items():
                    storage.write_bytes(f"{row.folder}/{name}", value)
                counts.append(len(made))
                times.append(time.time())
            yield frame[["doc_index", "folder"]].assign(files=counts, written=times)

    return results.mapInPandas(run, "doc_index long, folder string, files int, written double")


def write_images(images: DataFrame) -> DataFrame:
    """Write `images` (folder, name, data) as files; returns their paths."""

    def run(frames):
        for frame in frames:
            paths = [f"{f}/{n}" for f, n in zip(frame["folder"], frame["name"])]
            for path, data in zip(paths, frame["data"]):
                storage.write_bytes(path, bytes(data))
            yield frame[[]].assign(path=paths)

    return images.mapInPandas(run, "path string")


def write_results(results: DataFrame, path: str, by: str = "path") -> None:
    """Results as JSON lines, a folder per document, named by its path as in `output_dir`."""
    tag = F.concat_ws("-", text.stem(F.col(by)), F.substring(F.sha1(F.col(by).cast("binary")), 1, 8))
    results.withColumn("document", tag).write.mode("overwrite").partitionBy("document").json(path)


def timing_table(rows: Iterable[Any], title: str = "") -> str:
    """A plain table of (stage, calls, wall_ms, pct) rows, sorted by stage."""
    lines = [title] if title else []
    lines += [f"{r['stage']:<16}{r['calls']:>8}{r['wall_ms']:>12.1f}{r['pct']:>8.1f}" for r in sorted(rows, key=lambda r: r["stage"])]
    return "\n".join(lines)


def panel(title: str, values: dict[str, Any]) -> str:
    width = max((len(k) for k in values), default=0)
    return "\n".join([title, "-" * len(title), *(f"{k:<{width}}  {v}" for k, v in values.items())])
